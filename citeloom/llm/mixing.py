"""Mixing sources to target weights by iterative proportional fitting.

Token weights of the (source, language, topic) cells are raked to the three target
marginals: each step rescales the factor of every value of one dimension so that its
weight meets its target. The fitted cell weight over the cell's tokens, scaled so that
the largest is one, is the probability with which a document of the cell is sampled, so
the expected token mix of the sample is the raked one. DataFrame expressions throughout.
"""

from __future__ import annotations

import functools
from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, functions as F

from citeloom.llm.common import stored

DIMENSIONS = ("source", "lang", "topic")
#: Targets where none are given: a value's share of all tokens to this power, made to add up to one.
FLATTEN: dict[str, float] = {"source": 0.8, "lang": 0.9, "topic": 1.0}
#: A value below this share is raised no more than one that has it, so a few odd documents do not thin out all others.
RARE_SHARE = 0.03
#: The fit ends when no factor moves by more than this share in a round, or after so many rounds.
TOLERANCE = 1e-4
MAX_ROUNDS = 25


def form_topic(text: Column, n_tokens: Column) -> Column:
    """Topic of a text by its form, for corpora without a topic column."""
    lines = F.length(text) - F.length(F.replace(text, F.lit("\n"), F.lit(""))) + 1
    bars = F.length(text) - F.length(F.replace(text, F.lit("|"), F.lit("")))
    return (F.when(n_tokens == 0, "empty").when(10 * bars > n_tokens, "table").when(n_tokens < 5 * lines, "list")
            .when(n_tokens < 100, "note").when(n_tokens < 1000, "article").otherwise("book"))


def token_weights(docs: DataFrame) -> DataFrame:
    """``docs`` with _source, _lang, _topic (null: empty string) and _tokens, the words of the whole text."""
    text = F.coalesce("text", F.lit(""))
    counted = docs.withColumn("_tokens", F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")).cast("long"))
    return counted.withColumns({"_source": F.coalesce("source", F.lit("")), "_lang": F.coalesce("lang", F.lit("")), "_topic": form_topic(text, F.col("_tokens"))})


def _flat_targets(cells: DataFrame, dim: str) -> DataFrame:
    total = F.lit(float(cells.agg(F.sum("tokens")).first()[0] or 1))
    raised = F.pow(F.greatest(F.col("n") / total, F.lit(RARE_SHARE)), F.lit(FLATTEN[dim] - 1))
    return cells.groupBy(dim).agg(F.sum("tokens").alias("n")).select(dim, (F.col("n") * raised).alias("target"))


def _shares(rows: DataFrame, dim: str) -> DataFrame:
    """Targets of the values that the corpus has tokens of, adding up to one."""
    total = rows.agg(F.sum("target")).first()[0]
    return rows.select(dim, (F.col("target") / F.lit(total or 1.0)).alias("target"))


def rake(cells: DataFrame, targets: Mapping[str, DataFrame] | None = None, tolerance: float = TOLERANCE, max_rounds: int = MAX_ROUNDS) -> dict[str, DataFrame]:
    """Factor table (value, factor) of each dimension for ``cells`` (source, lang, topic, tokens).

    ``targets`` may hold, for a dimension, a table (value column named as the dimension,
    target) of non-negative weights; a value without a row there gets factor zero, a
    target for a value without tokens is left out and the rest made to add up to one.
    Cells and factors stay tables: their number grows with the sources. Marginals that
    contradict each other have no solution; the fit then ends after ``max_rounds``, and
    ``marginals`` shows what is left of the gap.
    """
    cells = stored(cells.where("tokens > 0"))
    goal = {d: stored(_shares((targets or {}).get(d, _flat_targets(cells, d)).join(cells.select(d).distinct(), d, "left_semi"), d)) for d in DIMENSIONS}
    factors = {d: stored(goal[d].select(d, F.lit(1.0).alias("factor"))) for d in DIMENSIONS}
    for _ in range(max_rounds):
        for d in DIMENSIONS:
            others = [o for o in DIMENSIONS if o != d]
            joined = cells
            for o in others:
                joined = joined.join(factors[o].withColumnRenamed("factor", f"f_{o}"), o)
            have = joined.groupBy(d).agg(F.sum(F.col("tokens") * F.col(f"f_{others[0]}") * F.col(f"f_{others[1]}")).alias("have"))
            new = goal[d].join(have, d).join(factors[d].select(d, F.col("factor").alias("old")), d)
            factor = F.when(F.col("have") > 0, F.col("target") / F.col("have")).otherwise(0.0)
            moved = F.when(F.col("old") > 0, F.abs(factor / F.col("old") - 1)).otherwise(0.0)
            factors[d] = stored(new.select(d, factor.alias("factor"), moved.alias("moved")))
        moves = functools.reduce(DataFrame.union, (factors[d].select("moved") for d in DIMENSIONS))
        if (moves.agg(F.max("moved")).first()[0] or 0.0) <= tolerance:
            break
    return {d: factors[d].select(d, "factor") for d in DIMENSIONS}


def _with_factors(rows: DataFrame, factors: Mapping[str, DataFrame], prefix: str = "") -> DataFrame:
    """``rate``: product of the factors of a row's values, zero where a value has none."""
    for d in DIMENSIONS:
        rows = rows.join(factors[d].select(F.col(d).alias(f"{prefix}{d}"), F.col("factor").alias(f"f_{d}")), f"{prefix}{d}", "left")
    rate = F.coalesce(F.col("f_source") * F.col("f_lang") * F.col("f_topic"), F.lit(0.0))
    return rows.withColumn("rate", rate).drop("f_source", "f_lang", "f_topic")


def marginals(cells: DataFrame, factors: Mapping[str, DataFrame], dim: str) -> DataFrame:
    """Value and raked share of one dimension."""
    raked = _with_factors(cells, factors).groupBy(dim).agg(F.sum(F.col("rate") * F.col("tokens")).alias("w"))
    total = raked.agg(F.sum("w")).first()[0]
    return raked.select(dim, (F.col("w") / F.lit(total or 1.0)).alias("share"))


def cell_tokens(weighted: DataFrame) -> DataFrame:
    return weighted.groupBy(*(F.col(f"_{d}").alias(d) for d in DIMENSIONS)).agg(F.sum("_tokens").alias("tokens"))


def uniform(doc_id: Column, seed: int) -> Column:
    """A number in [0, 1) that depends on the id and the seed alone."""
    return F.shiftrightunsigned(F.xxhash64(doc_id, F.lit(seed)), 11) / F.lit(float(1 << 53))


def mix_sources(docs: DataFrame, targets: Mapping[str, DataFrame] | None = None, seed: int = 17, tolerance: float = TOLERANCE, max_rounds: int = MAX_ROUNDS) -> DataFrame:
    """``docs`` (doc_id, text, source, lang, ...) with _source, _lang, _topic, _tokens, _probability and _sampled.

    A document is sampled if its number falls below its cell's probability, so reruns and
    repeated rows of an id agree; a null id has a number of its own. The highest
    probability of a cell with tokens is one. Null text has no tokens and topic ``empty``, which
    has a factor only if targets name it; where no document has tokens all probabilities are
    zero, and an empty table gives no rows.
    """
    weighted = token_weights(docs)
    cells = stored(cell_tokens(weighted))
    factors = rake(cells, targets, tolerance, max_rounds)
    rates = _with_factors(cells, factors)
    top = rates.where("tokens > 0").agg(F.max("rate")).first()[0]
    chance = stored(rates.select(*(F.col(d).alias(f"_{d}") for d in DIMENSIONS), F.least(F.lit(1.0), F.col("rate") / F.lit(top) if top else F.lit(0.0)).alias("_probability")))
    # One narrow row per cell; the documents are broadcast to or split by their cell as the sizes ask.
    return weighted.join(chance, ["_source", "_lang", "_topic"]).withColumn("_sampled", uniform(F.col("doc_id"), seed) < F.col("_probability"))
