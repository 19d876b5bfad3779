"""Windows and rankings, sorts, limits and table search."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from citeloom.functions import constants as K, scoring as S, text as X

from . import ordered


def top_per_group(df: DataFrame, keys: Sequence[str], order: Sequence[Column | str], k: int, rank: str = "rank") -> DataFrame:
    """First ``k`` rows per key; Spark trims each partition to k rows before the shuffle."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn(rank, F.row_number().over(w)).filter(F.col(rank) <= k)


# Experiments ----------------------------------------------------------------

def final_metrics(metrics: DataFrame) -> DataFrame:
    """Last value per (run, metric) by epoch, then step."""
    last = F.max(F.struct("epoch", "step", F.col("metric_value").alias("value")))
    return metrics.groupBy("run_id", "metric_name").agg(last.alias("m")).select("run_id", "metric_name", "m.value")


def best_worst(finals: DataFrame) -> DataFrame:
    """Best and worst run per metric by its direction; ties go to the earlier run."""
    up = X.higher_is_better(F.col("metric_name"))
    signed = F.when(up, F.col("value")).otherwise(-F.col("value"))
    best = F.max(F.struct(signed.alias("v"), (-F.col("run_id")).alias("r")))
    worst = F.max(F.struct((-signed).alias("v"), (-F.col("run_id")).alias("r")))
    return finals.groupBy("metric_name").agg((-best["r"]).alias("best_run"), (-worst["r"]).alias("worst_run"), F.bool_or(up).alias("higher_better"))


def overall_winner(best: DataFrame) -> DataFrame:
    wins = best.groupBy("best_run").agg(F.count("*").alias("wins"))
    top = F.max(F.struct("wins", (-F.col("best_run")).alias("r")))
    return wins.agg(top.alias("m")).select((-F.col("m.r")).alias("winner"), "m.wins")


def pivot_metrics(finals: DataFrame, metrics: Sequence[str]) -> DataFrame:
    """run x metric table for a given list of metrics."""
    return finals.groupBy("run_id").pivot("metric_name", list(metrics)).agg(F.max("value"))


def rank_variants(variants: DataFrame, group: str, pos: str, score: str) -> DataFrame:
    """Completed variants ranked by falling score; failed ones share rank n + 1. A large group is ordered in score ranges of equal size."""
    done = variants.filter("status = 'completed'")
    spread = ordered.even_buckets(done, [group], -F.col(score))
    ranked = ordered.row_numbers(spread, [group], [F.desc(score), F.asc(pos)], F.col("_bucket"), "rank").drop("_bucket")
    n = done.groupBy(group).agg(F.count("*").alias("_n"))
    failed = variants.filter("status <> 'completed'").join(n, group, "left").withColumn("rank", F.coalesce("_n", F.lit(0)) + 1).drop("_n")
    return ranked.unionByName(failed)


# Logs -----------------------------------------------------------------------

RATE_WINDOWS = {"last_minute": 60, "last_hour": 3600, "last_day": 86400}


def rolling_rate_counts(usage: DataFrame, key: str = "key_id") -> DataFrame:
    """Requests of the key in the trailing minute, hour and day at each request."""
    return ordered.trailing_counts(usage, [key], "ts", RATE_WINDOWS)


def latest_per_group(df: DataFrame, keys: Sequence[str], order: Sequence[str], values: Sequence[str]) -> DataFrame:
    """Newest row and row count per key, as a partial aggregate rather than a window."""
    return df.groupBy(*keys).agg(F.max(F.struct(*order, *[v for v in values if v not in order])).alias("m"), F.count("*").alias("n")).select(
        *keys, "n", *[F.col(f"m.{c}") for c in dict.fromkeys([*order, *values])])


def keep_newest(df: DataFrame, repo: str, status: str, order: Sequence[Column], limited: Sequence[str], n: int) -> DataFrame:
    """Newest ``n`` rows per repo of each limited status, and every row of the others."""
    kept = top_per_group(df.filter(F.col(status).isin(*limited)), [repo, status], order, n).drop("rank")
    return kept.unionByName(df.filter(~F.col(status).isin(*limited)))


def phase_durations(events: DataFrame, run: str, phase: str) -> DataFrame:
    """Start, end, duration, retries and state per (run, phase)."""
    at = lambda kind: F.when(F.col("kind") == kind, F.col("ts"))
    agg = events.groupBy(run, phase).agg(
        F.min(at("start")).alias("started"), F.max(at("complete")).alias("ended"), F.count_if(F.col("kind") == "retry").alias("retries"))
    seconds = (ordered.epoch_micros(F.col("ended")) - ordered.epoch_micros(F.col("started"))) / ordered.MICROS
    state = F.when(F.col("started").isNull(), "orphan").when(F.col("ended").isNull(), "running").otherwise("completed")
    return agg.select(run, phase, seconds.alias("seconds"), "retries", state.alias("state"))


def audit_timeline(parts: Sequence[DataFrame], key: str) -> DataFrame:
    """One ascending timeline per key from several event tables ``(key, ts, prio, label, ref)``."""
    merged = parts[0]
    for part in parts[1:]:
        merged = merged.unionByName(part)
    return ordered.row_numbers(merged, [key], ["ts", "prio", "ref"], F.trunc("ts", "month"), "seq")


def running_totals(df: DataFrame, label: str, order: Sequence[str], sums: dict[str, Column]) -> DataFrame:
    spread = ordered.even_buckets(df, [label], F.col(order[0]))
    return ordered.running_sums(spread, [label], order, F.col("_bucket"), sums).drop("_bucket")


def event_gaps(df: DataFrame, key: str, order: Sequence[str]) -> DataFrame:
    """Seconds since the previous event of the key."""
    with_prev = ordered.previous_value(df, [key], order, F.to_date(order[0]), order[0], "prev_ts")
    gap = (ordered.epoch_micros(F.col(order[0])) - ordered.epoch_micros(F.col("prev_ts"))) / ordered.MICROS
    return with_prev.withColumn("gap_seconds", gap)


# Relevance and selection ----------------------------------------------------

def repo_relevance(df: DataFrame, needle: str) -> Column:
    q = needle.lower()
    has = lambda c: F.lower(c).contains(q)
    stars = F.col("stars")
    score = (
        F.when(stars > 1000, 30.0).when(stars > 100, 20.0).when(stars > 10, 10.0).otherwise(0.0)
        + F.when(has(F.col("name")), 25.0).otherwise(0.0) + F.when(has(F.coalesce("description", F.lit(""))), 15.0).otherwise(0.0)
        + F.when(F.exists("topics", has), 10.0).otherwise(0.0)
        + F.when(F.col("updated").rlike("2024|2025|2026"), 10.0).otherwise(0.0))
    return F.least(score, F.lit(100.0))


def tool_relevance(needle: str, capabilities: Sequence[str] = ()) -> Column:
    q = needle.lower()
    points = lambda cond, n: F.when(cond, n).otherwise(0)
    score = (
        points(F.lower("name").contains(q), 10) + points(F.lower("description").contains(q), 5)
        + points(F.exists("tags", lambda t: F.lower(t).contains(q)), 3))
    if capabilities:
        score = score + points(F.arrays_overlap("capabilities", F.array(*[F.lit(c) for c in capabilities])), 7)
    return score


def pick_models(models: DataFrame, by: Sequence[str], min_reliability: float = 0.0) -> DataFrame:
    """Cheapest, fastest, most reliable and least used model per capability."""
    able = models.filter(F.col("enabled") & (F.col("reliability") >= min_reliability))
    low = lambda c: F.min(F.struct(F.col(c), F.col("model_id").alias("m")))["m"]
    return able.groupBy(*by).agg(
        low("cost").alias("cheapest"), low("latency_ms").alias("fastest"),
        (-F.max(F.struct("reliability", (-F.col("model_id")).alias("m")))["m"]).alias("most_reliable"), low("used").alias("least_used"))


def top_endpoints(usage: DataFrame, k: int = 10) -> DataFrame:
    return usage.groupBy("endpoint").agg(F.count("*").alias("requests")).orderBy(F.desc("requests"), "endpoint").limit(k)


def status_listing(df: DataFrame, status: str, order: Sequence[Column], k: int) -> DataFrame:
    return df.filter(F.col("status") == status).orderBy(*order).limit(k)


def tag_search(memories: DataFrame, tag: str, k: int = 10) -> DataFrame:
    hit = F.exists("tags", lambda t: F.lower(t) == tag.lower())
    return memories.filter(hit).orderBy(F.desc("importance"), F.desc("access_count"), "id").limit(k)


def category_order(df: DataFrame, category: str, pos: str) -> DataFrame:
    """Priority of each row's category (99 when unknown) for a stable order."""
    return df.withColumn("priority", S.lookup(F.col(category), K.CATEGORY_PRIORITY, 99)).orderBy("priority", pos)


def suggestion_confidence(pattern: Column, category: Column, year: Column) -> Column:
    score = 50.0 + F.when(F.lower(category).contains(pattern), 30.0).otherwise(0.0) + F.when(year >= 2022, 10.0).otherwise(0.0)
    return F.least(score, F.lit(100.0))


def select_plan(suggestions: DataFrame, plan: str, pos: str, name: str, max_specs: int, defaults: Sequence[str], categories: Sequence[str] | None = None) -> DataFrame:
    """First ``max_specs`` suggestions per plan, then deduplicated by name; defaults where none is left."""
    first = top_per_group(suggestions, [plan], [pos], max_specs, "_rk").drop("_rk")
    kept = first if categories is None else first.filter(F.col("category").isin(*categories))
    unique = kept.groupBy(plan, name).agg(F.min(pos).alias(pos))
    empty = suggestions.select(plan).distinct().join(unique.select(plan).distinct(), plan, "left_anti")
    fill = empty.select(plan, F.posexplode(F.array(*[F.lit(d) for d in defaults])).alias(pos, name))
    return unique.unionByName(fill.select(plan, name, F.col(pos).cast(unique.schema[pos].dataType)))


# Memories -------------------------------------------------------------------

CRITICAL_TAGS = ["important", "critical", "key", "essential"]


def keyword_relevance(content: Column, tags: Column, terms: Sequence[str]) -> Column:
    wanted = F.array(*[F.lit(t) for t in dict.fromkeys(terms)])
    words = F.array_distinct(F.split(F.lower(content), r"\s+"))
    overlap = F.size(F.array_intersect(wanted, words)) + 2.0 * F.size(F.array_intersect(wanted, F.transform(tags, F.lower)))
    return F.least(F.lit(1.0), overlap / len(set(terms))) if terms else F.lit(0.5)


def recency(created: Column, accessed: Column, access_count: Column, now: Column) -> Column:
    hours = (ordered.epoch_micros(now) - ordered.epoch_micros(created)) / (3600.0 * ordered.MICROS)
    idle = ordered.epoch_micros(now) - ordered.epoch_micros(accessed)
    boost = F.least(F.lit(0.2), access_count * 0.02) + F.when(idle < 3600 * ordered.MICROS, 0.1).otherwise(0.0)
    return F.least(F.lit(1.0), S.age_score(hours) + boost)


def importance_boost(importance: Column, tags: Column, memory_type: Column) -> Column:
    tagged = F.arrays_overlap(tags, F.array(*[F.lit(t) for t in CRITICAL_TAGS]))
    return F.least(F.lit(1.0), importance / 5.0 + F.when(tagged, 0.2).otherwise(0.0) + F.when(memory_type == "semantic", 0.1).otherwise(0.0))


def memory_scores(memories: DataFrame, query: str, as_of: str, similarity: Column | None = None) -> DataFrame:
    """Retrieval score of every live memory: relevance .5, recency .3, importance .2."""
    from .rules import instant, is_expired

    terms = query.lower().split()
    live = memories.filter(F.col("memory_type").isin("episodic", "semantic", "procedural") & ~is_expired(F.col("expires_at").cast("string"), as_of))
    relevance = keyword_relevance(F.col("content"), F.col("tags"), terms)
    if similarity is not None:
        relevance = F.when(similarity.isNotNull(), similarity * 0.7 + relevance * 0.3).otherwise(relevance)
    score = (
        relevance * 0.5 + recency(F.col("created_at"), F.col("accessed_at"), F.col("access_count"), instant(as_of)) * 0.3
        + importance_boost(F.col("importance"), F.col("tags"), F.col("memory_type")) * 0.2)
    return live.withColumn("score", score)
