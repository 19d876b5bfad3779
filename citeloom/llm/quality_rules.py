"""Quality rules: text statistics and the frequency of lines across the documents of a host.

A line is normalised (trimmed, lower case, digit runs as 0) and hashed. Lines that too
many distinct texts of a host hold are boilerplate there and go; a document that loses
most of its words this way is depleted and rejected. All of it is DataFrame expressions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from citeloom.llm.common import stored

SPACE = r"[\x20\x09-\x0D]+"
#: A line is above the limits if at least so many distinct texts of a host, and at least this share of them, hold it.
LINE_DOCS = 10
LINE_SHARE = 0.02
#: A document is depleted if boilerplate lines hold more than this share of its words.
DEPLETED_SHARE = 0.5
MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50


def words_of(text: Column) -> Column:
    return F.filter(F.split(text, SPACE), lambda w: w != "")


def normal_line(line: Column) -> Column:
    return F.regexp_replace(F.lower(F.btrim(line, F.lit(" \t\n\x0b\x0c\r"))), "[0-9]+", "0")


def text_statistics(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with n_words, word_chars, n_symbols, n_dup_lines and n_repeat_words of the whole text; null is empty.

    A word counts as repeated if a window of three words that holds it is found twice or
    more in the text. Windows are compared by 64-bit hashes, sorted inside the row.
    """
    body = F.coalesce(F.col(text), F.lit(""))
    first = docs.withColumns({
        "_words": words_of(body),
        "_lines": _filled(body),
        "n_symbols": F.length(F.regexp_replace(body, r"[^#*$%&|<>]+", "")).cast("long"),
    })
    second = first.withColumns({
        "n_words": F.size("_words").cast("long"),
        "word_chars": F.length(F.array_join("_words", "")).cast("long"),
        "n_dup_lines": (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long"),
        "_windows": F.transform(
            F.slice("_words", 1, F.greatest(F.size("_words") - 2, F.lit(0))),
            lambda w, i: F.xxhash64(w, F.get("_words", i + 1), F.get("_words", i + 2))),
    })
    # Only texts with a repeated window sort their windows.
    repeats = F.size(F.array_distinct("_windows")) < F.size("_windows")
    third = second.withColumn("_sorted", F.when(repeats, F.array_sort(F.transform("_windows", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))))
    same = lambda j: F.get(F.col("_sorted"), j)["h"]
    fourth = third.withColumn("_at", F.array_sort(F.transform(
        F.filter("_sorted", lambda s, j: (s["h"] == F.when(j > 0, same(j - 1))) | F.coalesce(s["h"] == same(j + 1), F.lit(False))), lambda s: s["i"])))
    # Each window covers three words, fewer where the next one starts within them.
    covered = F.aggregate(
        F.col("_at"), F.struct(F.lit(0).cast("long").alias("n"), F.lit(-3).alias("last")),
        lambda a, p: F.struct((a["n"] + F.least(F.lit(3), p - a["last"])).alias("n"), p.alias("last")), lambda a: a["n"])
    return fourth.withColumn("n_repeat_words", F.coalesce(covered, F.lit(0)).cast("long")).drop("_words", "_lines", "_windows", "_sorted", "_at")


def _line_hash(line: Column) -> Column:
    return F.xxhash64(normal_line(line))


def _filled(text: Column) -> Column:
    return F.filter(F.split(F.coalesce(text, F.lit("")), "\n"), lambda x: F.btrim(x, F.lit(" \t\n\x0b\x0c\r")) != "")


def _lines(docs: DataFrame) -> DataFrame:
    """host, row key and the distinct hashes of the lines with words of each document."""
    hashes = F.array_distinct(F.transform(_filled(F.col("text")), _line_hash))
    return docs.select(F.coalesce("source", F.lit("")).alias("host"), F.col("doc_id").alias("row_id"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("row_text"), F.explode(hashes).alias("line"))


def boilerplate_lines(docs: DataFrame, line_docs: int = LINE_DOCS, line_share: float = LINE_SHARE) -> DataFrame:
    """host, line, n_docs of every line above the limits. Copies of a text count as one document of the host."""
    lines = _lines(docs)
    counts = lines.select("host", "line", "row_text").distinct().groupBy("host", "line").agg(F.count("*").alias("n_docs"))
    hosts = docs.select(F.coalesce("source", F.lit("")).alias("host"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("row_text")).distinct()
    sizes = hosts.groupBy("host").agg(F.count("*").alias("host_docs"))
    frequent = counts.where(F.col("n_docs") >= line_docs)
    common = frequent.join(sizes, "host").where(F.col("n_docs") >= line_share * F.col("host_docs"))
    return stored(common.select("host", "line", "n_docs"))  # small, and a plain side of later joins


def apply_quality_rules(docs: DataFrame, line_docs: int = LINE_DOCS, line_share: float = LINE_SHARE, depleted_share: float = DEPLETED_SHARE,
                        min_words: int = MIN_WORDS, max_repeat_percent: int = MAX_REPEAT_PERCENT) -> DataFrame:
    """doc_id, clean_text, the statistics, n_boilerplate_words, base_failed and kept for every row of ``docs`` (doc_id, text, source).

    A document fails the base rules if it has fewer than ``min_words`` words or if more than
    ``max_repeat_percent`` percent of its words are in repeated windows. It is kept if it
    passes them and its boilerplate lines hold at most ``depleted_share`` of its words.
    Null text is empty, null source is a host of its own, rows with equal or null doc_id
    are judged by their own text. Other columns are ignored.
    """
    narrow = docs.select("doc_id", "text", "source")
    lines, common = _lines(narrow), boilerplate_lines(narrow, line_docs, line_share)
    # The line shuffle can be split: a common line meets one row of `common`.
    met = lines.join(common.select("host", "line"), ["host", "line"])
    hits = met.groupBy("row_id", F.col("row_text").alias("hit_text"), F.col("host").alias("hit_host")).agg(F.collect_set("line").alias("gone"))
    base = text_statistics(narrow).withColumns({
        "row_text": F.xxhash64(F.coalesce("text", F.lit(""))), "host": F.coalesce("source", F.lit("")),
        "base_failed": (F.col("n_words") < min_words) | (100 * F.col("n_repeat_words") > max_repeat_percent * F.col("n_words")),
    })
    joined = base.join(hits, F.col("doc_id").eqNullSafe(F.col("row_id")) & (F.col("row_text") == F.col("hit_text")) & (F.col("host") == F.col("hit_host")), "left")
    text = F.coalesce("text", F.lit(""))
    dropped = F.filter(_filled(text), lambda x: F.array_contains("gone", _line_hash(x)))
    lost = F.when(F.col("gone").isNull(), 0).otherwise(F.size(words_of(F.array_join(dropped, "\n")))).cast("long")
    clean = F.when(F.col("gone").isNull(), text).otherwise(F.array_join(F.filter(F.split(text, "\n"), lambda x: ~F.array_contains("gone", _line_hash(x))), "\n"))
    counted = joined.select("*", clean.alias("clean_text"), lost.alias("n_boilerplate_words"))
    return counted.select(
        "doc_id", "clean_text", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_boilerplate_words",
        "base_failed", (~F.col("base_failed") & (F.col("n_boilerplate_words") <= depleted_share * F.col("n_words"))).alias("kept"))
