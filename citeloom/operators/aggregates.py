"""Aggregations: dashboards, calibration, reports, record merging."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from citeloom.functions import constants as K, scoring as S
from citeloom.session import cut_lineage

from . import ordered
from .rules import days_before, instant


# Usage ----------------------------------------------------------------------

def with_cost(usage: DataFrame) -> DataFrame:
    return usage.withColumn("cost_usd", S.estimate_cost(F.col("provider"), F.col("tokens_used")))


def _usage_measures() -> list[Column]:
    return [
        F.count("*").alias("requests"),
        F.coalesce(F.sum("tokens_used"), F.lit(0)).alias("tokens"),
        S.rounded(F.coalesce(F.sum("cost_usd"), F.lit(0.0)), 6).alias("cost"),
        F.count_if(F.col("status") == "error").alias("errors"),
    ]


def usage_analytics(usage: DataFrame) -> DataFrame:
    """Totals, daily, provider and daily-by-provider measures in one pass."""
    day = with_cost(usage).withColumn("day", F.to_date("ts"))
    return day.groupingSets([[], ["day"], ["provider"], ["day", "provider"]], "day", "provider").agg(
        F.grouping_id().cast("int").alias("level"), *_usage_measures())


def usage_cube(usage: DataFrame) -> DataFrame:
    """The same measures over every combination of day, provider and endpoint."""
    day = with_cost(usage).withColumn("day", F.to_date("ts"))
    return day.cube("day", "provider", "endpoint").agg(F.grouping_id().cast("int").alias("level"), *_usage_measures())


def running_mean_latency(usage: DataFrame) -> DataFrame:
    """Daily mean latency updated only by rows that carry one.

    The fold ``avg_n = (avg_{n-1} (n-1) + lat) / n`` skips rows without latency but
    counts them in n. With S_n = n avg_n a skipped row multiplies S by n / (n-1), so
    the result is a sum of latencies weighted by the factors that follow each row:
    a closed form over ranks and prefix sums instead of a sequential fold.
    """
    rows = usage.select(F.to_date("ts").alias("day"), "ts", "event_id", F.coalesce("latency_ms", F.lit(0)).alias("lat"))
    rows = cut_lineage(ordered.even_buckets(rows, ["day"], F.col("ts")))
    bucket = F.col("_bucket")
    ranked = cut_lineage(ordered.row_numbers(rows, ["day"], ["ts", "event_id"], bucket, "n"))
    growth = F.when((F.col("lat") == 0) & (F.col("n") > 1), F.log(F.col("n") / (F.col("n") - 1))).otherwise(0.0)
    grown = ordered.running_sums(ranked.withColumn("_g", growth), ["day"], ["ts", "event_id"], bucket, {"g": F.col("_g")})
    total = ranked.withColumn("_g", growth).groupBy("day").agg(F.sum("_g").alias("total_g"), F.count("*").alias("requests"))
    weighted = grown.join(total, "day").withColumn("w", F.col("lat") * F.exp(F.col("total_g") - F.col("g")))
    return weighted.groupBy("day", "requests").agg(
        S.rounded(F.sum("w") / F.col("requests"), 6).alias("avg_latency_ms"))


def dashboard_periods(usage: DataFrame, as_of: str, periods: Sequence[int] = (7, 30)) -> DataFrame:
    """Totals of several trailing periods from one scan."""
    costed = with_cost(usage).filter(F.col("ts") >= days_before(as_of, max(periods)))
    sums = []
    for d in periods:
        recent = F.col("ts") >= days_before(as_of, d)
        sums += [
            F.count_if(recent).alias(f"r{d}"),
            F.coalesce(F.sum(F.when(recent, F.col("tokens_used"))), F.lit(0)).alias(f"t{d}"),
            S.rounded(F.coalesce(F.sum(F.when(recent, F.col("cost_usd"))), F.lit(0.0)), 6).alias(f"c{d}"),
            F.count_if(recent & (F.col("status") == "error")).alias(f"e{d}")]
    rows = F.array(*[
        F.struct(F.lit(d).alias("days"), F.col(f"r{d}").alias("requests"), F.col(f"t{d}").alias("tokens"),
                 F.col(f"c{d}").alias("cost"), F.col(f"e{d}").alias("errors")) for d in periods])
    return costed.agg(*sums).select(F.inline(rows))


def daily_trend(usage: DataFrame, days: int = 14) -> DataFrame:
    return with_cost(usage).groupBy(F.to_date("ts").alias("day")).agg(*_usage_measures()).orderBy(F.desc("day")).limit(days)


def cost_alerts(usage: DataFrame, as_of: str, budget: float = 100.0) -> DataFrame:
    """Budget and error-rate alerts of the trailing 30 days."""
    recent = with_cost(usage).filter(F.col("ts") >= days_before(as_of, 30))
    total = recent.agg(
        F.coalesce(F.sum("cost_usd"), F.lit(0.0)).alias("cost"), F.count("*").alias("n"),
        F.count_if(F.col("status") == "error").alias("errors"))
    alert = lambda kind, severity: F.struct(F.lit(kind).alias("type"), F.lit(severity).alias("severity"))
    alerts = F.array_compact(F.array(
        F.when(F.col("cost") > budget, alert("budget_exceeded", "critical"))
        .when(F.col("cost") > budget * 0.8, alert("budget_warning", "warning")),
        F.when((F.col("n") > 0) & (F.col("errors") / F.col("n") > 0.1), alert("high_error_rate", "warning"))))
    return total.select(F.inline(alerts))


def key_usage_stats(usage: DataFrame, as_of: str, limits: DataFrame | None = None) -> DataFrame:
    """Per key counts of the last minute, hour and day, first and last use, limited or not."""
    now = F.unix_micros(instant(as_of).cast("timestamp"))
    age = now - ordered.epoch_micros(F.col("ts"))
    stats = usage.groupBy("key_id").agg(
        F.count("*").alias("total"),
        *[F.count_if(age < w * ordered.MICROS).alias(n) for n, w in (("last_minute", 60), ("last_hour", 3600), ("last_day", 86400))],
        F.min("ts").alias("first_used"), F.max("ts").alias("last_used"))
    if limits is not None:
        stats = stats.join(limits, "key_id", "left")
    per = lambda c, default: F.coalesce(F.col(c), F.lit(default)) if limits is not None else F.lit(default)
    limited = (
        (F.col("last_minute") >= per("per_minute", 60)) | (F.col("last_hour") >= per("per_hour", 1000))
        | (F.col("last_day") >= per("per_day", 10000)))
    return stats.select("key_id", "total", "last_minute", "last_hour", "last_day", "first_used", "last_used", limited.alias("is_rate_limited"))


# Calibration ----------------------------------------------------------------

def calibration_metrics(predictions: DataFrame, bins: int = 10) -> DataFrame:
    """Accuracy, mean confidence error, expected calibration error, sample count."""
    b = F.least(F.floor(F.col("confidence") * bins), F.lit(bins - 1))
    per = predictions.filter("correct IS NOT NULL").groupBy(b.alias("bin")).agg(
        F.count("*").alias("n"), F.sum("correct").alias("hits"), F.sum("confidence").alias("conf"),
        F.sum(F.abs(F.col("confidence") - F.col("correct"))).alias("err"))
    total = F.sum("n")
    return per.agg(
        S.rounded(F.sum("hits") / total, 6).alias("accuracy"), S.rounded(F.sum("err") / total, 6).alias("confidence_error"),
        S.rounded(F.sum(F.abs(F.col("hits") - F.col("conf"))) / total, 6).alias("calibration_error"), total.alias("n_samples"))


def calibration_curve(predictions: DataFrame, bins: int = 10, by: Sequence[str] = ()) -> DataFrame:
    """Half-open confidence bins: a confidence of exactly 1.0 falls in none."""
    return predictions.filter("correct IS NOT NULL AND confidence < 1").groupBy(
        *by, F.floor(F.col("confidence") * bins).alias("bin")).agg(
        S.rounded(F.avg("confidence"), 6).alias("confidence"), S.rounded(F.avg("correct"), 6).alias("accuracy"),
        F.count("*").alias("n"))


def response_uncertainty(df: DataFrame, key: str, response: str, confidence: str) -> DataFrame:
    """``1 - distinct/total`` of responses and capped double variance of confidences."""
    # Equal responses merge before the per-key step, so a hot key ships few rows.
    merged = df.groupBy(key, response).agg(
        F.count("*").alias("c"), F.count(confidence).alias("k"), F.sum(confidence).alias("s"),
        F.sum(F.col(confidence) * F.col(confidence)).alias("q"))
    mean = F.sum("s") / F.sum("k")
    variance = F.sum("q") / F.sum("k") - mean * mean
    return merged.groupBy(key).agg(
        F.when(F.sum("c") < 2, 0.0).otherwise(S.rounded(1.0 - F.count("*") / F.sum("c"), 6)).alias("response_uncertainty"),
        F.when(F.sum("k") == 0, 1.0).otherwise(S.rounded(F.least(F.lit(1.0), F.greatest(F.lit(0.0), variance) * 2), 6)).alias("confidence_uncertainty"))


# Experiments ----------------------------------------------------------------

def metric_statistics(finals: DataFrame, runs: DataFrame) -> DataFrame:
    """count, mean, sample deviation, min, max and exact median per metric over completed runs."""
    done = finals.join(runs.filter("status = 'completed'").select("run_id").distinct(), "run_id", "left_semi")
    stats = done.groupBy("metric_name").agg(
        F.count("*").alias("n"), S.rounded(F.avg("value"), 6).alias("mean"),
        S.rounded(F.coalesce(F.stddev_samp("value"), F.lit(0.0)), 6).alias("std"),
        F.min("value").alias("min"), F.max("value").alias("max"))
    return stats.join(ordered.exact_median(done, ["metric_name"], "value"), "metric_name").withColumn("median", S.rounded(F.col("median"), 6))


def tracker_stats(runs: DataFrame, metrics: DataFrame) -> DataFrame:
    r = runs.agg(
        F.count("*").alias("total_runs"), *[F.count_if(F.col("status") == s).alias(s) for s in ("completed", "running", "failed")],
        F.count_distinct("experiment").alias("unique_experiments"))
    m = metrics.agg(F.count("*").alias("metric_entries"))
    # Two one-row tables meet on a constant.
    return r.withColumn("_one", F.lit(1)).join(m.withColumn("_one", F.lit(1)), "_one").drop("_one")


def reproducibility(claimed: DataFrame, achieved: DataFrame, key: str, groups: DataFrame) -> DataFrame:
    """Mean capped ratio of achieved to claimed metrics per group, with a verdict."""
    a = achieved.select(key, "metric", F.col("value").alias("got"))
    ratio = F.least(F.col("got") / F.col("value"), F.col("value") / F.col("got"))
    score = F.when(F.coalesce("got", F.lit(0.0)) <= 0, 0.0).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), ratio)))
    per = claimed.join(a, [key, "metric"], "left").groupBy(key).agg(
        F.coalesce(F.avg(F.when(F.col("value") != 0, score)), F.lit(0.0)).alias("s"))
    out = groups.select(key).distinct().join(per, key, "left").withColumn("score", F.coalesce("s", F.lit(0.5)))
    verdict = F.when(F.col("score") > 0.9, "reproduced").when(F.col("score") > 0.5, "partial").otherwise("failed")
    return out.select(key, S.rounded(F.col("score"), 6).alias("score"), verdict.alias("verdict"))


# Repositories ---------------------------------------------------------------

def language_stats(files: DataFrame) -> DataFrame:
    """Files and lines per language under both line-count rules."""
    from citeloom.functions.text import line_count

    return files.groupBy("language").agg(
        F.count("*").alias("files"), F.sum(F.size(F.split("content", "\n"))).alias("lines_split"),
        F.sum(line_count(F.col("content"))).alias("lines_splitlines"))


def item_overlap(items: DataFrame, item: str, detail: Column) -> DataFrame:
    """(item, repo) rows with the occurrences there and how many repos have the item."""
    per_repo = items.groupBy(item, "repo_id").agg(detail.alias("occurrences"))
    n = per_repo.groupBy(item).agg(F.count("*").alias("n_repos"))
    return per_repo.join(n, item)


def shared_and_unique(items: DataFrame, item: str) -> DataFrame:
    """Items present in every repository, or in exactly one (then with that repo)."""
    n_repos = items.agg(F.count_distinct("repo_id").alias("n")).withColumn("_one", F.lit(1))
    per = items.groupBy(item).agg(F.count_distinct("repo_id").alias("k"), F.min("repo_id").alias("only_repo")).withColumn("_one", F.lit(1))
    scope = F.when(F.col("k") == F.col("n"), "shared").when(F.col("k") == 1, "unique")
    return per.join(n_repos, "_one").withColumn("scope", scope).filter("scope IS NOT NULL").select(
        item, "scope", F.when(F.col("scope") == "unique", F.col("only_repo")).alias("only_repo"))


def group_members(df: DataFrame, category: Column, name: str) -> DataFrame:
    """Distinct (category, name) members with the size of their category, in long form."""
    members = df.select(F.coalesce(F.when(category != "", category), F.lit("other")).alias("category"), name).distinct()
    n = members.groupBy("category").agg(F.count("*").alias("n_members"))
    return members.join(n, "category")


def frameworks_from_imports(imports: DataFrame, repo: str) -> DataFrame:
    """Framework flags by import prefix, in long form."""
    m = F.lower(F.trim("module"))
    tests = [F.when((m == f) | m.startswith(f + "."), f) for f in K.DOTTED_FRAMEWORKS]
    tests += [F.when((m == p) | m.startswith(p + "/"), f) for f, p in K.PATH_FRAMEWORKS]
    tests.append(F.when(m.startswith("@angular/"), "angular"))
    return imports.select(repo, F.explode(F.array_compact(F.array(*tests))).alias("framework")).distinct()


def dependency_lists(imports: DataFrame) -> DataFrame:
    """file -> imported modules in long form with their number of occurrences."""
    return imports.groupBy("file", "module").agg(F.count("*").alias("n"))


# Metrics and monitoring -----------------------------------------------------

def histogram(df: DataFrame, keys: Sequence[str], value: str, bounds: Sequence[float] = tuple(K.HISTOGRAM_BOUNDS)) -> DataFrame:
    """Cumulative bucket counts with sum and count per key, one row per bound (+Inf = NULL)."""
    per = df.groupBy(*keys).agg(
        *[F.count_if(F.col(value) <= b).alias(f"b{i}") for i, b in enumerate(bounds)],
        F.sum(value).alias("total"), F.count(value).alias("n"))
    rows = F.array(*[
        F.struct(F.lit(float(b)).alias("le"), F.col(f"b{i}").alias("cumulative")) for i, b in enumerate(bounds)
    ], F.struct(F.lit(None).cast("double").alias("le"), F.col("n").alias("cumulative")))
    return per.select(*keys, "total", "n", F.explode(rows).alias("r")).select(*keys, "r.*", "total", "n")


def histogram_quantile(buckets: DataFrame, keys: Sequence[str], q: float) -> DataFrame:
    """Quantile by linear interpolation inside the first bucket that reaches it."""
    w = Window.partitionBy(*keys).orderBy(F.col("le").asc_nulls_last())
    steps = buckets.withColumns({
        "prev_le": F.coalesce(F.lag("le").over(w), F.lit(0.0)), "prev_cum": F.coalesce(F.lag("cumulative").over(w), F.lit(0))})
    rank = F.col("n") * q
    share = F.try_divide(rank - F.col("prev_cum"), F.col("cumulative") - F.col("prev_cum"))
    inside = F.col("prev_le") + (F.col("le") - F.col("prev_le")) * share
    reached = steps.filter((F.col("cumulative") >= rank) & (F.col("n") > 0)).withColumn(
        "v", F.when(F.col("le").isNull(), F.col("prev_le")).otherwise(inside))
    return reached.groupBy(*keys).agg(S.rounded(F.min_by("v", F.coalesce("le", F.lit(float("inf")))), 6).alias("quantile"))


def error_ratio(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    return df.groupBy(*keys).agg(
        S.rounded(F.count_if(F.col("status_code") >= 500) / F.greatest(F.count("*"), F.lit(0.001)), 6).alias("error_ratio"),
        F.count("*").alias("n"))


def tool_metrics(calls: DataFrame) -> DataFrame:
    """Per tool and overall: calls, outcomes, durations and cost."""
    return calls.rollup("tool").agg(
        F.count("*").alias("calls"), F.count_if("success").alias("succeeded"), F.count_if(~F.col("success")).alias("failed"),
        F.sum("duration_ms").alias("total_ms"), F.min("duration_ms").alias("min_ms"), F.max("duration_ms").alias("max_ms"),
        S.rounded(F.sum("cost"), 6).alias("cost"), S.rounded(F.avg("duration_ms"), 6).alias("avg_ms"))


def workflow_summary(workflows: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    done = F.col("status") == "completed"
    failed = F.col("status") == "failed"
    finished = F.count_if(done | failed)
    return workflows.groupBy(*keys).agg(
        F.count("*").alias("total"), F.count_if(~done & ~failed).alias("active"), F.count_if(done).alias("completed"),
        F.count_if(failed).alias("failed"),
        S.rounded(F.coalesce(F.avg(F.when(done & (F.col("duration") > 0), F.col("duration"))), F.lit(0.0)), 6).alias("avg_duration"),
        S.rounded(F.when(finished > 0, F.count_if(done) / finished * 100).otherwise(0.0), 6).alias("success_rate"))


def stage_summary(stages: DataFrame, run: str) -> DataFrame:
    """Stage count, total duration and slowest stage per run."""
    return stages.groupBy(run).agg(
        F.count("*").alias("stages"), F.sum("duration").alias("total"),
        F.max(F.struct("duration", (-F.col("stage")).alias("s"))).alias("m")).select(
        run, "stages", "total", (-F.col("m.s")).alias("slowest_stage"), F.col("m.duration").alias("slowest_duration"))


def memory_stats(memories: DataFrame, as_of: str) -> DataFrame:
    from .rules import is_expired

    flagged = memories.withColumn("expired", is_expired(F.col("expires_at").cast("string"), as_of))
    return flagged.groupingSets([["memory_type"], ["tier"], []], "memory_type", "tier").agg(
        F.grouping_id().cast("int").alias("level"), F.count("*").alias("memories"), F.sum("access_count").alias("accesses"), F.count_if("expired").alias("expired"))


def approval_summary(approvals: DataFrame, key: str) -> DataFrame:
    return approvals.groupBy(key).agg(*[F.count_if(F.col("status") == s).alias(s) for s in ("approved", "rejected", "pending")])


def circuit_health(states: DataFrame) -> DataFrame:
    return states.agg(
        F.count("*").alias("circuits"), F.count_if(F.col("state") == "open").alias("open_circuits"),
        F.sum("calls").alias("calls"), F.sum("failures").alias("failures"))


# Reports --------------------------------------------------------------------

def acceptance_report(cases: DataFrame) -> DataFrame:
    """Patch, test and review rates with coverage and the gate verdict."""
    rate = lambda a, b: F.when(b > 0, S.rounded(a / b, 3))
    total = F.count("*")
    tested, reviewed = F.col("tests_status") != "not_configured", F.col("human_review") != "unreviewed"
    agg = cases.agg(
        total.alias("total_cases"), F.coalesce(rate(F.count_if("patch_applied"), total), F.lit(0.0)).alias("patch_rate"),
        rate(F.count_if(F.col("tests_status") == "passed"), F.count_if(tested)).alias("test_rate"),
        F.coalesce(rate(F.count_if(tested), total), F.lit(0.0)).alias("test_coverage"),
        rate(F.count_if(F.col("human_review") == "accepted"), F.count_if(reviewed)).alias("review_rate"),
        F.coalesce(rate(F.count_if(reviewed), total), F.lit(0.0)).alias("review_coverage"))
    complete = (F.col("test_coverage") == 1.0) & (F.col("review_coverage") == 1.0)
    passes = F.coalesce(
        (F.col("patch_rate") >= K.ACCEPT_PATCH_RATE) & (F.col("test_rate") >= K.ACCEPT_TEST_RATE) & (F.col("review_rate") >= K.ACCEPT_REVIEW_RATE), F.lit(False))
    return agg.withColumn("gate", F.when(~complete, "incomplete").when(passes, "passed").otherwise("failed"))


def failure_counts(cases: DataFrame) -> DataFrame:
    return cases.filter("failure_stage <> ''").groupBy("failure_stage").agg(F.count("*").alias("n"))


def benchmark_cases(cases: DataFrame, key: str, expected: str, candidate: str, exact: Column) -> DataFrame:
    """Case status and score from an exact match or the overlap of symbol sets."""
    overlap = S.rounded(F.size(F.array_intersect(F.array_distinct(expected), F.col(candidate))) / F.greatest(F.size(F.array_distinct(expected)), F.lit(1)), 3)
    status = (F.when(F.size(candidate) == 0, "missing_candidate").when(exact, "matched")
              .when(F.col("overlap") >= 0.5, "partial").otherwise("mismatch"))
    scored = cases.withColumn("overlap", overlap).withColumn("status", status)
    return scored.select(key, "overlap", "status", S.lookup(F.col("status"), {"matched": 1.0, "partial": 0.5}, 0.0).alias("score"))


def benchmark_aggregate(results: DataFrame) -> DataFrame:
    supported = F.col("status") != "unsupported_spec"
    return results.agg(
        S.rounded(F.avg("score"), 3).alias("aggregate_score"), S.rounded(F.avg(F.when(supported, F.col("score"))), 3).alias("supported_score"),
        F.count("*").alias("cases"), F.count_if(F.col("status") == "matched").alias("matched"), F.count_if(F.col("status") == "partial").alias("partial"))


def capped_confidence(targets: DataFrame, spec: str, template: Column) -> DataFrame:
    """Additive 0-100 confidence per spec from its match tiers and validation errors."""
    tier = F.col("match_tier")
    agg = targets.groupBy(spec).agg(
        F.count("*").alias("n_targets"), F.count_if(tier == "exact").alias("n_exact"), F.count_if(tier.startswith("fuzzy")).alias("n_fuzzy"),
        F.count_if(tier == "import").alias("n_import"),
        F.count_distinct(F.when(tier == "text_scan", F.col("matched_pattern"))).alias("n_text"),
        F.count_if(F.col("issue") == "error").alias("n_errors"))
    bonus = lambda cond, pts: F.when(cond, pts).otherwise(0)
    total = (
        35 + bonus(F.col("n_targets") > 0, 20) + F.least(F.col("n_exact") * 10, F.lit(40)) + bonus(F.col("n_fuzzy") > 0, 10)
        + bonus(F.col("n_import") > 0, 10) + F.least(F.col("n_text") * 5, F.lit(15)) + bonus(F.col("n_errors") == 0, 10)
        + bonus(template, 10) - F.col("n_errors") * 10)
    scored = agg.withColumn("total", F.greatest(F.lit(0), F.least(total, F.lit(100))))
    return scored.select(spec, "n_targets", "n_errors", "total", (F.col("total") < 70).alias("approval_required"))


def signature_regression(before: DataFrame, after: DataFrame) -> DataFrame:
    """Symbols removed or with a changed signature; both sides ``(file, symbol, signature)``."""
    b = before.groupBy("file", "symbol").agg(F.max("signature").alias("old"))
    a = after.groupBy("file", "symbol").agg(F.max("signature").alias("new"))
    both = b.join(a, ["file", "symbol"], "left")
    change = F.when(F.col("new").isNull(), "removed").when(F.col("old") != F.col("new"), "signature_changed")
    return both.withColumn("change", change).filter("change IS NOT NULL").select("file", "symbol", "change")


def trust_status(runs: DataFrame) -> DataFrame:
    """failed / trusted / needs_review with the notes that explain it."""
    gen, rep, cov, total = (F.col(c) for c in ("generation_rate", "reproducibility", "coverage", "total_equations"))
    trace_ok = (total == 0) | (cov >= K.MIN_TRACEABILITY)
    status = (
        F.when(~F.col("execution_ok") | (gen < K.MIN_TRACEABILITY), "failed")
        .when((gen >= 0.9) & (rep >= K.TRUSTED_REPRODUCIBILITY) & trace_ok, "trusted").otherwise("needs_review"))
    notes = F.array_compact(F.array(
        F.when(gen < 1.0, "generation_incomplete"), F.when(~F.col("execution_ok"), "validation_failed"),
        F.when(rep < K.TRUSTED_REPRODUCIBILITY, "reproducibility_low"),
        F.when(total == 0, "no_equations").when(cov < K.MIN_TRACEABILITY, "traceability_low")))
    return runs.select("run_id", status.alias("status"), F.array_join(notes, ",").alias("notes"))


def citation_trends(nodes: DataFrame, edges: DataFrame, min_year: int = 2000) -> DataFrame:
    cited = edges.groupBy(F.col("dst").alias("id")).agg(F.count_distinct("src").alias("c"))
    return nodes.filter(F.col("year") >= min_year).join(cited, "id", "left").groupBy("year").agg(
        F.count("*").alias("papers"), F.coalesce(F.sum("c"), F.lit(0)).alias("citations"))


def test_outcomes(results: DataFrame, key: str) -> DataFrame:
    """Mutation score, and distinct crashing and hanging inputs by content hash."""
    out = F.col("outcome")
    digest = F.sha2(F.col("input"), 256)
    merged = results.groupBy(key, "outcome", digest.alias("h")).agg(F.count("*").alias("c"))
    killed, survived = (F.sum(F.when(out == s, F.col("c")).otherwise(0)) for s in ("killed", "survived"))
    return merged.groupBy(key).agg(
        killed.alias("killed"), survived.alias("survived"),
        S.rounded(F.when(killed + survived > 0, killed / (killed + survived)).otherwise(0.0), 6).alias("score"),
        F.count_if(out == "crash").alias("unique_crashes"), F.count_if(out == "hang").alias("unique_hangs"))


def reflection_report(reflections: DataFrame, k: int = 5) -> tuple[DataFrame, DataFrame]:
    """Totals per type, and up to ``k`` distinct lessons per type in sorted order."""
    totals = reflections.groupBy("kind").agg(F.count("*").alias("n"), S.rounded(F.avg("rating"), 6).alias("avg_rating"))
    lessons = reflections.select("kind", F.explode("lessons").alias("lesson")).distinct()
    ranked = lessons.withColumn("rn", F.row_number().over(Window.partitionBy("kind").orderBy("lesson"))).filter(F.col("rn") <= k)
    return totals, ranked


def plan_progress(tasks: DataFrame, plan: str) -> DataFrame:
    done = F.col("status") == "completed"
    return tasks.groupBy(plan).agg(
        F.count("*").alias("total"), F.count_if(done).alias("completed"),
        S.rounded(F.count_if(done) / F.count("*"), 6).alias("success_rate"), F.bool_and(done).alias("all_complete"))


# Record merging -------------------------------------------------------------

def merge_papers(papers: DataFrame, group: str, pos: str) -> DataFrame:
    """One record per duplicate group.

    The base is the fullest record; blanks are filled from the others in order,
    abstract is the longest, numbers the largest. Everything folds in partial
    aggregates; list fields are merged in long form by ``merge_lists``.
    """
    text = lambda c: F.coalesce(F.col(c), F.lit(""))
    filled = sum((F.when(text(c) != "", 1).otherwise(0) for c in ("title", "abstract", "url", "doi", "journal")), F.lit(0))
    rank = F.struct(filled.alias("a"), F.length(text("abstract")).alias("b"), F.col("citations").alias("c"), (-F.col(pos)).alias("p"))
    base_pos = papers.groupBy(group).agg((-F.max(rank)["p"]).alias("_base"))
    rows = papers.join(base_pos, group).withColumn("_o", F.when(F.col(pos) == F.col("_base"), -1).otherwise(F.col(pos)))

    def first_filled(c: str) -> Column:
        return F.coalesce(F.min(F.when(text(c) != "", F.struct("_o", F.col(c).alias("v"))))["v"], F.lit("")).alias(c)

    longest = F.max(F.struct(F.length(text("abstract")).alias("n"), (-F.col("_o")).alias("o"), text("abstract").alias("v")))["v"]
    return rows.groupBy(group).agg(
        F.min("_base").alias("base_pos"), *[first_filled(c) for c in ("title", "url", "doi", "journal")],
        longest.alias("abstract"), F.max("year").alias("year"), F.max("citations").alias("citations"), F.count("*").alias("n_merged"))


def merge_lists(papers: DataFrame, group: str, pos: str, column: str) -> DataFrame:
    """Union of a list field over a group, in first-seen order, as (group, value, order) rows."""
    items = papers.select(group, pos, F.posexplode(column).alias("i", "value"))
    first = items.groupBy(group, "value").agg(F.min(F.struct(pos, "i")).alias("seen"))
    return first.select(group, "value", F.col(f"seen.{pos}").alias("first_pos"), F.col("seen.i").alias("first_index"))


def merge_keyed(rows: DataFrame, keys: Sequence[str], pos: str, value: str, weight: str) -> DataFrame:
    """Last value per key wins; weights keep their maximum."""
    return rows.groupBy(*keys).agg(F.max(F.struct(pos, F.col(value).alias("v")))["v"].alias(value), F.max(weight).alias(weight))


def merge_specs(specs: DataFrame, group: str, pos: str) -> DataFrame:
    """Scalars of a combined plan: earliest year, size, last parameter value.

    Names and authors are merged in long form by ``merge_lists``.
    """
    return specs.groupBy(group).agg(
        F.count("*").alias("n_specs"), F.min("year").alias("year"),
        F.max(F.struct(pos, F.col("parameter").alias("v")))["v"].alias("parameter"))
