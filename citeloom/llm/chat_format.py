"""Chat formatting: layouts are told by the fingerprint of their nested field paths.

A layout is a declarative mapping from field paths to turns. The paths of a table's
schema, or of each JSON record, are hashed; a known fingerprint selects its layout, an
unknown one takes the layout with the most paths that are all present. Every layout
yields the canonical turns array<struct<role, text>>, which one template formats. All of
it is DataFrame expressions.
"""

from __future__ import annotations

import hashlib
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import ArrayType, DataType, StructType

TURNS = "array<struct<role:string,text:string>>"


@dataclass(frozen=True)
class Layout:
    """How one layout becomes turns.

    ``rows``: one row per turn, with columns (order, role, text). ``items``: a list field
    and the role and text fields of its elements. ``fields``: (role, field) pairs, each a
    turn if present. ``roles`` renames roles.
    """

    name: str
    rows: tuple[str, str, str] | None = None
    items: tuple[str, str, str] | None = None
    fields: tuple[tuple[str, str], ...] = ()
    optional: tuple[str, ...] = ()
    roles: tuple[tuple[str, str], ...] = ()

    @property
    def paths(self) -> tuple[str, ...]:
        """The field paths that the layout must have, in order."""
        if self.rows:
            return tuple(sorted(self.rows))
        if self.items:
            field, role, text = self.items
            return tuple(sorted((f"{field}[].{role}", f"{field}[].{text}")))
        return tuple(sorted(f for _, f in self.fields if f not in self.optional))


_ALIASES = (("human", "user"), ("gpt", "assistant"), ("bot", "assistant"), ("model", "assistant"))
LAYOUTS: tuple[Layout, ...] = (
    Layout("turn_rows", rows=("turn", "role", "text")),
    Layout("messages", items=("messages", "role", "content")),
    Layout("conversations", items=("conversations", "from", "value"), roles=_ALIASES),
    Layout("turns", items=("turns", "role", "text"), roles=_ALIASES),
    Layout("prompt_completion", fields=(("system", "system"), ("user", "prompt"), ("assistant", "completion")), optional=("system",)),
    Layout("prompt_response", fields=(("system", "system"), ("user", "prompt"), ("assistant", "response")), optional=("system",)),
    Layout("instruction", fields=(("system", "system"), ("user", "instruction"), ("user", "input"), ("assistant", "output")), optional=("system", "input")),
    Layout("question_answer", fields=(("system", "context"), ("user", "question"), ("assistant", "answer")), optional=("context",)),
)


def fingerprint(paths: Sequence[str]) -> str:
    return hashlib.sha256("\n".join(sorted(set(paths))).encode()).hexdigest()[:16]


def field_paths(kind: DataType, prefix: str = "") -> list[str]:
    """Paths of the leaves of a schema; list elements are written []."""
    if isinstance(kind, ArrayType):
        return field_paths(kind.elementType, f"{prefix}[]")
    if isinstance(kind, StructType):
        return [p for f in kind.fields for p in field_paths(f.dataType, f"{prefix}.{f.name}" if prefix else f.name)]
    return [prefix]


def choose_layout(paths: Sequence[str], layouts: Sequence[Layout] = LAYOUTS) -> Layout | None:
    """The layout of this very fingerprint, else the one with the most required paths, all present; first of equals."""
    known = {fingerprint(x.paths): x for x in reversed(layouts)}
    if (exact := known.get(fingerprint(paths))) is not None:
        return exact
    fitting = [x for x in layouts if set(x.paths) <= set(paths)]
    return max(fitting, key=lambda x: len(x.paths), default=None)


def _renamed(role: Column, layout: Layout) -> Column:
    for old, new in layout.roles:
        role = F.when(F.lower(role) == old, new).otherwise(role)
    return role


def table_turns(df: DataFrame, key: str, layouts: Sequence[Layout] = LAYOUTS) -> DataFrame:
    """``key`` and turns for a table with typed columns, whose schema selects the layout.

    Rows per turn are ordered by their order column, null first, then role and text; null
    role or text is empty. Extra columns play no part. A null key is a conversation of its own.
    """
    layout = choose_layout(field_paths(df.drop(key).schema), layouts)
    if layout is None:
        raise ValueError(f"no layout fits the fields {sorted(field_paths(df.schema))}")
    empty = F.lit("")
    if layout.rows:
        order, role, text = layout.rows
        turn = F.struct(F.col(order).alias("o"), F.coalesce(_renamed(F.col(role), layout), empty).alias("role"), F.coalesce(text, empty).alias("text"))
        grouped = df.select(F.col(key), turn.alias("t")).groupBy(key).agg(F.array_sort(F.collect_list("t"), lambda a, b: _compare(a, b)).alias("s"))
        return grouped.select(key, F.transform("s", lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text"))).alias("turns"))
    if layout.items:
        field, role, text = layout.items
        made = F.transform(F.coalesce(F.col(field), F.array()), lambda t: F.struct(F.coalesce(_renamed(t[role], layout), empty).alias("role"), F.coalesce(t[text], empty).alias("text")))
        return df.select(key, made.alias("turns"))
    parts = [F.when(F.col(f).isNotNull(), F.struct(F.lit(r).alias("role"), F.col(f).cast("string").alias("text"))) for r, f in layout.fields if f in df.columns]
    return df.select(key, F.filter(F.array(*parts), lambda t: t.isNotNull()).alias("turns"))


def _compare(a: Column, b: Column) -> Column:
    """Ascending by order (null first), role, text."""
    out = F.lit(0)
    for name in ("text", "role"):
        out = F.when(a[name] < b[name], -1).when(a[name] > b[name], 1).otherwise(out)
    first = F.when(a["o"].isNull() & b["o"].isNull(), out).when(a["o"].isNull(), -1).when(b["o"].isNull(), 1)
    return first.when(a["o"] < b["o"], -1).when(a["o"] > b["o"], 1).otherwise(out)


def record_paths(variant: Column) -> Column:
    """Sorted paths of a JSON record to the depth that layouts use: fields, and fields of list elements.

    A nested object is written {}, a list without objects []; what they hold plays no part.
    """

    def written(path: Column, value: Column) -> Column:
        kind = F.coalesce(F.schema_of_variant(value), F.lit("VOID"))
        return F.concat(path, F.when(kind.startswith("OBJECT<"), "{}").when(kind.startswith("ARRAY<"), "[]").otherwise(""))

    def below(field: Column) -> Column:
        elements = F.filter(F.try_variant_get(field["value"], "$", "array<variant>"), lambda e: F.schema_of_variant(e).startswith("OBJECT<"))
        inner = F.flatten(F.transform(elements, lambda e: F.map_entries(F.try_variant_get(e, "$", "map<string,variant>"))))
        paths = F.transform(inner, lambda f: written(F.concat(field["key"], F.lit("[]."), f["key"]), f["value"]))
        return F.when(F.size(paths) > 0, paths).otherwise(F.array(written(field["key"], field["value"])))

    fields = F.map_entries(F.try_variant_get(variant, "$", "map<string,variant>"))
    return F.array_sort(F.array_distinct(F.flatten(F.transform(fields, below))))


def record_turns(records: DataFrame, key: str, record: str = "record", layouts: Sequence[Layout] = LAYOUTS) -> DataFrame:
    """``key``, fingerprint, layout (null: none fits) and turns for JSON records of mixed layouts.

    Text that is not JSON, and a record that no layout fits, has no layout and no turns.
    """
    parsed = records.select(key, F.try_parse_json(record).alias("v"))
    seen = parsed.select(key, "v", F.coalesce(record_paths(F.col("v")), F.array().cast("array<string>")).alias("paths"))
    seen = seen.withColumn("fingerprint", F.substring(F.sha2(F.array_join("paths", "\n"), 256), 1, 16))
    nested = [x for x in layouts if not x.rows]
    by_size = sorted(nested, key=lambda x: -len(x.paths))
    exact = [(F.col("fingerprint") == fingerprint(x.paths), x) for x in nested]
    fits = [(F.size(F.array_intersect("paths", F.array(*map(F.lit, x.paths)))) == len(x.paths), x) for x in by_size]
    layout = turns = None
    for test, x in [*exact, *fits]:
        layout = F.when(test, x.name) if layout is None else layout.when(test, x.name)
    for x in nested:
        test = F.col("layout") == x.name
        turns = F.when(test, _variant_turns(x)) if turns is None else turns.when(test, _variant_turns(x))
    return seen.withColumn("layout", layout).select(key, "fingerprint", "layout", F.coalesce(turns, F.array().cast(TURNS)).alias("turns"))


def _variant_turns(layout: Layout) -> Column:
    empty = F.lit("")
    if layout.items:
        field, role, text = layout.items
        items = F.try_variant_get(F.col("v"), f"$.{field}", "array<variant>")
        part = lambda t, name: F.try_variant_get(t, f"$.{name}", "string")  # noqa: E731; other fields of an element play no part
        return F.transform(items, lambda t: F.struct(F.coalesce(_renamed(part(t, role), layout), empty).alias("role"), F.coalesce(part(t, text), empty).alias("text")))
    parts = []
    for role, field in layout.fields:
        value = F.try_variant_get(F.col("v"), f"$.{field}", "string")
        parts.append(F.when(value.isNotNull(), F.struct(F.lit(role).alias("role"), value.alias("text"))))
    return F.filter(F.array(*parts), lambda t: t.isNotNull())


# The template. Inside roles and texts no "<" is left, so its marks cannot be forged; in
# escapes a backslash is followed by b (backslash), l (<), g (>) or n (line feed).
OPEN, CLOSE = "<turn ", "</turn>\n"


def escape(text: Column, role: bool = False) -> Column:
    text = F.replace(F.replace(text, F.lit("\\"), F.lit("\\b")), F.lit("<"), F.lit("\\l"))
    return F.replace(F.replace(text, F.lit(">"), F.lit("\\g")), F.lit("\n"), F.lit("\\n")) if role else text


def unescape(text: Column, role: bool = False) -> Column:
    text = F.replace(F.replace(text, F.lit("\\g"), F.lit(">")), F.lit("\\n"), F.lit("\n")) if role else text
    return F.replace(F.replace(text, F.lit("\\l"), F.lit("<")), F.lit("\\b"), F.lit("\\"))


def format_turns(df: DataFrame, turns: str = "turns", learned_role: str = "assistant") -> DataFrame:
    """``df`` without ``turns`` but with formatted and loss_spans.

    loss_spans are (start, length) in code points of formatted, from 0: the escaped text
    of each turn of ``learned_role``. No turns give an empty string and no spans.
    """
    pieces = F.transform(turns, lambda t: F.struct(
        F.concat(F.lit(OPEN), escape(t["role"], role=True), F.lit(">\n")).alias("head"), escape(t["text"]).alias("body"), (t["role"] == learned_role).alias("learned")))
    made = df.withColumn("_pieces", pieces)
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,length:int>>").alias("spans"))
    spans = F.aggregate("_pieces", start, lambda a, p: F.struct(
        (a["at"] + F.length(p["head"]) + F.length(p["body"]) + len(CLOSE)).alias("at"),
        F.when(p["learned"], F.concat(a["spans"], F.array(F.struct((a["at"] + F.length(p["head"])).alias("start"), F.length(p["body"]).alias("length"))))).otherwise(a["spans"]).alias("spans")), lambda a: a["spans"])
    whole = F.array_join(F.transform("_pieces", lambda p: F.concat(p["head"], p["body"], F.lit(CLOSE))), "")
    return made.select(*(c for c in df.columns if c != turns), whole.alias("formatted"), spans.alias("loss_spans"))


def parse_turns(formatted: Column) -> Column:
    """The turns of a formatted conversation, read from its marks."""
    pieces = F.filter(F.split(formatted, CLOSE), lambda p: p != "")
    return F.transform(pieces, lambda p: F.struct(
        unescape(F.substring_index(F.substr(p, F.lit(len(OPEN) + 1)), ">\n", 1), role=True).alias("role"),
        unescape(F.substr(p, F.locate(">\n", p) + 2)).alias("text")))


def loss_texts(formatted: Column, spans: Column) -> Column:
    """The texts under the loss mask, unescaped, in order."""
    return F.transform(spans, lambda s: unescape(F.substr(formatted, s["start"] + 1, s["length"])))
