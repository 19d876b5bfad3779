"""Ordered computations that spread a hot key over buckets of its order column.

A plain window puts all rows of a key into one task. Here rows are ordered only
inside (key, bucket); what a bucket inherits from earlier ones comes from a window
over per-bucket aggregates, which are few.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

MICROS = 1_000_000


def _join_keys(keys: Sequence[str]) -> list[str]:
    return [*keys, "_b"]


#: A key with more rows than this is cut into up to EVEN_BUCKETS buckets of about equal size.
EVEN_ROWS = 50_000
EVEN_BUCKETS = 256


def even_buckets(df: DataFrame, keys: Sequence[str], value: Column, name: str = "_bucket", rows: int = EVEN_ROWS, buckets: int = EVEN_BUCKETS) -> DataFrame:
    """Add a bucket number that ascends with ``value``, from counts of the data rather than fixed bounds.

    Quantile sketches, merged before the shuffle, give the bounds of the keys with more than ``rows``
    rows; every bucket of such a key has about ``rows`` rows, or a share of 1 / ``buckets`` if that is more.
    Other keys, and rows without a value, are in bucket 0. Equal values share a bucket.
    """
    fractions = [i / buckets for i in range(1, buckets)]
    large = df.groupBy(*keys).agg(F.count("*").alias("_n"), F.percentile_approx(value, fractions, 10 * buckets).alias("_cuts")).filter(F.col("_n") > rows)
    every = F.greatest(F.lit(1), F.floor(F.lit(float(buckets * rows)) / F.col("_n")).cast("int"))
    bounds = large.select(*keys, F.array_distinct(F.filter("_cuts", lambda c, i: (i + 1) % every == 0)).alias("_cuts"))
    placed = df.join(bounds, list(keys), "left")
    return placed.withColumn(name, F.coalesce(F.size(F.filter("_cuts", lambda c: c < value)), F.lit(0))).drop("_cuts")


def running_sums(
    df: DataFrame, keys: Sequence[str], order: Sequence[str | Column], bucket: Column, sums: dict[str, Column]
) -> DataFrame:
    """Add inclusive running sums per key. Buckets must ascend with the order columns."""
    df = df.withColumn("_b", bucket)
    base = df.groupBy(*_join_keys(keys)).agg(*[F.sum(c).alias(f"_s_{n}") for n, c in sums.items()])
    before = Window.partitionBy(*keys).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    offsets = base.select(*_join_keys(keys), *[F.coalesce(F.sum(f"_s_{n}").over(before), F.lit(0)).alias(f"_o_{n}") for n in sums])
    inside = Window.partitionBy(*_join_keys(keys)).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    local = df.withColumns({f"_r_{n}": F.sum(c).over(inside) for n, c in sums.items()})
    out = local.join(offsets, _join_keys(keys))
    out = out.withColumns({n: F.col(f"_r_{n}") + F.col(f"_o_{n}") for n in sums})
    return out.drop("_b", *[f"_r_{n}" for n in sums], *[f"_o_{n}" for n in sums])


def row_numbers(df: DataFrame, keys: Sequence[str], order: Sequence[str | Column], bucket: Column, name: str = "rn") -> DataFrame:
    return running_sums(df, keys, order, bucket, {name: F.lit(1)})


def previous_value(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], bucket: Column, value: str, name: str
) -> DataFrame:
    """Add the value of the preceding row of the key (NULL for its first row)."""
    df = df.withColumn("_b", bucket)
    last = F.max(F.struct(*order, F.col(value).alias("_v")))
    per = df.groupBy(*_join_keys(keys)).agg(last.alias("_last"))
    carry = per.select(*_join_keys(keys), F.lag("_last").over(Window.partitionBy(*keys).orderBy("_b"))["_v"].alias("_carry"))
    inside = Window.partitionBy(*_join_keys(keys)).orderBy(*order)
    out = df.withColumns({"_rn": F.row_number().over(inside), "_lag": F.lag(value).over(inside)}).join(carry, _join_keys(keys))
    return out.withColumn(name, F.when(F.col("_rn") == 1, F.col("_carry")).otherwise(F.col("_lag"))).drop("_b", "_rn", "_lag", "_carry")


def epoch_micros(ts: Column) -> Column:
    return F.unix_micros(ts.cast("timestamp"))


def trailing_counts(df: DataFrame, keys: Sequence[str], ts: str, windows: dict[str, int]) -> DataFrame:
    """Rows of the same key in ``(ts - w, ts]`` for each window length in seconds.

    Each row counts in its own time bucket and is lent to the next one, the only
    other bucket whose windows can reach it.
    """
    width = max(windows.values()) * MICROS
    us = epoch_micros(F.col(ts))
    df = df.withColumns({"_us": us, "_b": F.floor(us / width)})
    lent = df.select("*", F.explode(F.array(F.lit(0), F.lit(1))).alias("_shift")).withColumn("_b", F.col("_b") + F.col("_shift"))
    over = lambda w: Window.partitionBy(*_join_keys(keys)).orderBy("_us").rangeBetween(1 - w * MICROS, 0)
    counted = lent.withColumns({name: F.count(F.lit(1)).over(over(w)) for name, w in windows.items()})
    return counted.filter("_shift = 0").drop("_us", "_b", "_shift")


def exact_median(df: DataFrame, keys: Sequence[str], value: str, buckets: int = 64) -> DataFrame:
    """Exact median per key without gathering a key's values in one place.

    Equal values are merged first. Approximate quantiles cut each key into
    buckets; only the buckets holding the middle ranks are then ordered exactly.
    """
    merged = df.filter(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count("*").alias("_c"))
    fractions = [i / buckets for i in range(1, buckets)]
    cuts = df.groupBy(*keys).agg(
        F.percentile_approx(value, fractions, 10 * buckets).alias("_cuts"), F.count(value).alias("_n"))
    placed = merged.join(cuts, list(keys)).withColumn(
        "_b", F.size(F.filter("_cuts", lambda c: c < F.col(value)))).drop("_cuts")
    sizes = placed.groupBy(*keys, "_b", "_n").agg(F.sum("_c").alias("_bc"))
    before = Window.partitionBy(*keys).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.withColumn("_before", F.coalesce(F.sum("_bc").over(before), F.lit(0)))
    lo, hi = F.floor((F.col("_n") - 1) / 2), F.floor(F.col("_n") / 2)
    middle = sizes.filter((F.col("_before") <= hi) & (F.col("_before") + F.col("_bc") > lo)).drop("_bc", "_n")
    inside = Window.partitionBy(*keys, "_b").orderBy(value).rowsBetween(Window.unboundedPreceding, -1)
    ranked = placed.join(middle, [*keys, "_b"]).withColumn(
        "_start", F.col("_before") + F.coalesce(F.sum("_c").over(inside), F.lit(0)))
    end = F.col("_start") + F.col("_c")
    return ranked.groupBy(*keys).agg(
        ((F.max(F.when((F.col("_start") <= lo) & (end > lo), F.col(value)))
          + F.max(F.when((F.col("_start") <= hi) & (end > hi), F.col(value)))) / 2).alias("median"))
