"""Aggregation families over whole tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from citeloom.functions import constants as K, scoring as S
from citeloom.operators import aggregates as A, joins as J, ranking as N, rules as R

from .registry import query
from .scalar_plans import COST_SQL
from .views import AS_OF

NOW = f"TIMESTAMP '{AS_OF}'"
COSTED = f"c AS (SELECT *, CAST(ts AS DATE) AS day, {COST_SQL} AS cost_usd FROM usage)"
MEASURES = """COUNT(*) AS requests, CAST(coalesce(SUM(tokens_used), 0) AS BIGINT) AS tokens, round(coalesce(SUM(cost_usd), 0), 6) AS cost,
  COUNT(*) FILTER (status = 'error') AS errors"""


@query("usage_analytics", f"""
WITH {COSTED} SELECT day, provider, CAST(GROUPING(day) * 2 + GROUPING(provider) AS INT) AS level, {MEASURES}
FROM c GROUP BY GROUPING SETS ((), (day), (provider), (day, provider))""")
def usage_analytics(t):
    return A.usage_analytics(t("usage"))


# The fold itself: a row without latency counts and leaves the mean as it is.
@query("running_mean_latency", """
WITH RECURSIVE r AS (SELECT CAST(ts AS DATE) AS day, coalesce(latency_ms, 0) AS lat, row_number() OVER (PARTITION BY CAST(ts AS DATE) ORDER BY ts, event_id) AS n FROM usage),
f AS (SELECT day, n, lat::DOUBLE AS mean FROM r WHERE n = 1
  UNION ALL SELECT r.day, r.n, CASE WHEN lat = 0 THEN mean ELSE (mean * (r.n - 1) + lat) / r.n END FROM f JOIN r ON r.day = f.day AND r.n = f.n + 1)
SELECT day, MAX(n) AS requests, round(arg_max(mean, n), 6) AS avg_latency_ms FROM f GROUP BY day""")
def running_mean_latency(t):
    return A.running_mean_latency(t("usage"))


@query("usage_rollup_cube", f"""
WITH {COSTED} SELECT day, provider, endpoint, CAST(GROUPING(day) * 4 + GROUPING(provider) * 2 + GROUPING(endpoint) AS INT) AS level, {MEASURES}
FROM c GROUP BY CUBE (day, provider, endpoint)""")
def usage_rollup_cube(t):
    return A.usage_cube(t("usage"))


@query("dashboard_periods", f"""
WITH {COSTED} SELECT 7 AS days, {MEASURES} FROM c WHERE ts >= {NOW} - INTERVAL 7 DAY
UNION ALL SELECT 30, {MEASURES} FROM c WHERE ts >= {NOW} - INTERVAL 30 DAY""")
def dashboard_periods(t):
    return A.dashboard_periods(t("usage"), AS_OF)


@query("dashboard_daily_trend", f"WITH {COSTED} SELECT day, {MEASURES} FROM c GROUP BY day ORDER BY day DESC LIMIT 14")
def dashboard_daily_trend(t):
    return A.daily_trend(t("usage"))


@query("cost_alerts", f"""
WITH {COSTED}, s AS (SELECT coalesce(SUM(cost_usd), 0) AS cost, COUNT(*) AS n, COUNT(*) FILTER (status = 'error') AS e FROM c WHERE ts >= {NOW} - INTERVAL 30 DAY)
SELECT CASE WHEN cost > 100 THEN 'budget_exceeded' ELSE 'budget_warning' END AS type, CASE WHEN cost > 100 THEN 'critical' ELSE 'warning' END AS severity FROM s WHERE cost > 80
UNION ALL SELECT 'high_error_rate', 'warning' FROM s WHERE n > 0 AND e / n > 0.1""")
def cost_alerts(t):
    return A.cost_alerts(t("usage"), AS_OF)


@query("key_usage_stats", f"""
WITH s AS (SELECT key_id, COUNT(*) AS total, COUNT(*) FILTER (ts > {NOW} - INTERVAL 60 SECOND) AS last_minute, COUNT(*) FILTER (ts > {NOW} - INTERVAL 1 HOUR) AS last_hour,
  COUNT(*) FILTER (ts > {NOW} - INTERVAL 1 DAY) AS last_day, MIN(ts) AS first_used, MAX(ts) AS last_used FROM usage GROUP BY key_id)
SELECT s.*, last_minute >= 60 OR last_hour >= 1000 OR last_day >= coalesce(CASE WHEN key_id % 5 = 0 THEN 2 END, 10000) AS is_rate_limited FROM s""")
def key_usage_stats(t):
    limits = t("customer").filter("c_custkey % 5 = 0").select(
        F.col("c_custkey").alias("key_id"), F.lit(60).alias("per_minute"), F.lit(1000).alias("per_hour"), F.lit(2).alias("per_day"))
    return A.key_usage_stats(t("usage"), AS_OF, limits)


@query("calibration_metrics", """
WITH b AS (SELECT least(CAST(floor(confidence * 10) AS BIGINT), 9) AS bin, COUNT(*) AS n, SUM(correct) AS hits, SUM(confidence) AS conf, SUM(abs(confidence - correct)) AS err FROM predictions WHERE correct IS NOT NULL GROUP BY 1)
SELECT round(SUM(hits) / SUM(n), 6) AS accuracy, round(SUM(err) / SUM(n), 6) AS confidence_error, round(SUM(n / (SELECT SUM(n) FROM b) * abs(hits / n - conf / n)), 6) AS calibration_error, CAST(SUM(n) AS BIGINT) AS n_samples FROM b""")
def calibration_metrics(t):
    return A.calibration_metrics(t("predictions"))


@query("calibration_curve", """
SELECT category, CAST(floor(confidence * 10) AS BIGINT) AS bin, round(AVG(confidence), 6) AS confidence, round(AVG(correct), 6) AS accuracy, COUNT(*) AS n
FROM predictions WHERE correct IS NOT NULL AND confidence < 1 GROUP BY 1, 2""")
def calibration_curve(t):
    return A.calibration_curve(t("predictions"), by=["category"])


@query("response_uncertainty", """
SELECT user_id, CASE WHEN COUNT(*) < 2 THEN 0.0e0 ELSE round(1.0 - COUNT(DISTINCT props) / COUNT(*), 6) END AS response_uncertainty,
  round(least(1.0, var_pop(value / 500) * 2), 6) AS confidence_uncertainty
FROM events GROUP BY user_id""")
def response_uncertainty(t):
    df = t("events").withColumn("confidence", F.col("value") / 500)
    return A.response_uncertainty(df, "user_id", "props", "confidence")


@query("metric_statistics", """
SELECT metric_name, COUNT(*) AS n, round(AVG(value), 6) AS mean, round(coalesce(stddev_samp(value), 0), 6) AS std, MIN(value) AS min, MAX(value) AS max, round(median(value), 6) AS median
FROM final_metrics_sql WHERE run_id IN (SELECT run_id FROM runs WHERE status = 'completed') GROUP BY metric_name""")
def metric_statistics(t):
    return A.metric_statistics(N.final_metrics(t("metrics")), t("runs"))


@query("tracker_stats", """
SELECT COUNT(*) AS total_runs, COUNT(*) FILTER (status = 'completed') AS completed, COUNT(*) FILTER (status = 'running') AS running, COUNT(*) FILTER (status = 'failed') AS failed,
  COUNT(DISTINCT experiment) AS unique_experiments, (SELECT COUNT(*) FROM metrics) AS metric_entries FROM runs""")
def tracker_stats(t):
    return A.tracker_stats(t("runs"), t("metrics"))


@query("language_stats", """
SELECT lang AS language, COUNT(*) AS files, CAST(SUM(len(string_split(text, chr(10)))) AS BIGINT) AS lines_split,
  CAST(SUM(CASE WHEN text = '' THEN 0 ELSE len(string_split(text, chr(10))) - CASE WHEN text LIKE '%' || chr(10) THEN 1 ELSE 0 END END) AS BIGINT) AS lines_splitlines
FROM documents GROUP BY lang""")
def language_stats(t):
    return A.language_stats(t("documents").select(F.col("lang").alias("language"), F.col("text").alias("content")))


@query("pattern_overlap", """
WITH p AS (SELECT pattern, repo_id, CAST(SUM(n_lines) AS BIGINT) AS occurrences FROM profiles GROUP BY pattern, repo_id)
SELECT *, COUNT(*) OVER (PARTITION BY pattern) AS n_repos FROM p""")
def pattern_overlap(t):
    return A.item_overlap(t("profiles"), "pattern", F.sum("n_lines"))


@query("language_overlap", """
WITH l AS (SELECT lower(language) AS language, repo_id, CAST(SUM(n_lines) AS BIGINT) AS lines, COUNT(*) AS files FROM profiles GROUP BY 1, 2)
SELECT language, COUNT(*) AS n_repos, CAST(SUM(lines) AS BIGINT) AS total_lines, CAST(SUM(files) AS BIGINT) AS total_files FROM l GROUP BY language""")
def language_overlap(t):
    per = t("profiles").groupBy(F.lower("language").alias("language"), "repo_id").agg(F.sum("n_lines").alias("lines"), F.count("*").alias("files"))
    return per.groupBy("language").agg(F.count("*").alias("n_repos"), F.sum("lines").alias("total_lines"), F.sum("files").alias("total_files"))


@query("shared_unique_sets", """
WITH i AS (SELECT repo_id, framework AS item FROM profiles UNION SELECT repo_id, pattern || '/' || n_lines FROM profiles),
u AS (SELECT item, COUNT(DISTINCT repo_id) AS k, MIN(repo_id) AS r FROM i GROUP BY 1), n AS (SELECT COUNT(DISTINCT repo_id) AS n FROM profiles)
SELECT item, CASE WHEN k = n THEN 'shared' ELSE 'unique' END AS scope, CASE WHEN k = 1 THEN r END AS only_repo FROM u, n WHERE k = n OR k = 1""")
def shared_unique_sets(t):
    items = t("profiles").select("repo_id", F.explode(F.array("framework", F.concat_ws("/", "pattern", F.col("n_lines").cast("string")))).alias("item"))
    return A.shared_and_unique(items, "item")


@query("group_categories", """
WITH m AS (SELECT DISTINCT CASE WHEN contains(p_name, ' ') THEN split_part(p_name, ' ', 1) ELSE 'other' END AS category, p_name FROM part)
SELECT category, p_name, COUNT(*) OVER (PARTITION BY category) AS n_members FROM m""")
def group_categories(t):
    category = F.when(F.contains("p_name", F.lit(" ")), F.split_part("p_name", F.lit(" "), F.lit(1))).otherwise("")
    return A.group_members(t("part"), category, "p_name")


_IMPORTS = """imports AS (SELECT DISTINCT file, regexp_extract(content, '^import\\s+(\\S+)', 1) AS module FROM code_lines WHERE starts_with(content, 'import '))"""


def _imports(t):
    lines = t("code_lines").withColumn("module", R.import_module(F.col("content")))
    return lines.filter("module IS NOT NULL")


@query("frameworks_from_imports", f"""
WITH {_IMPORTS} SELECT DISTINCT file, CASE WHEN split_part(module, '.', 1) IN ({", ".join(f"'{f}'" for f in K.DOTTED_FRAMEWORKS)}) THEN split_part(module, '.', 1) END AS framework
FROM imports WHERE split_part(module, '.', 1) IN ({", ".join(f"'{f}'" for f in K.DOTTED_FRAMEWORKS)})""")
def frameworks_from_imports(t):
    return A.frameworks_from_imports(_imports(t), "file")


@query("dependency_lists", """
SELECT file, regexp_extract(content, '^import\\s+(\\S+)', 1) AS module, COUNT(*) AS n FROM code_lines WHERE starts_with(content, 'import ') GROUP BY 1, 2""")
def dependency_lists(t):
    return A.dependency_lists(_imports(t))


_HIST = " UNION ALL ".join(
    f"SELECT route, CAST({b} AS DOUBLE) AS le, COUNT(*) FILTER (latency_s <= {b}) AS cumulative, round(SUM(latency_s), 6) AS total, COUNT(*) AS n FROM http_requests GROUP BY route"
    for b in K.HISTOGRAM_BOUNDS) + " UNION ALL SELECT route, NULL, COUNT(*), round(SUM(latency_s), 6), COUNT(*) FROM http_requests GROUP BY route"


@query("histogram_buckets", _HIST)
def histogram_buckets(t):
    return A.histogram(t("http_requests"), ["route"], "latency_s").withColumn("total", S.rounded(F.col("total"), 6))


@query("histogram_quantile", f"""
WITH h AS ({_HIST}),
s AS (SELECT *, coalesce(lag(le) OVER w, 0.0) AS ple, coalesce(lag(cumulative) OVER w, 0) AS pc FROM h WINDOW w AS (PARTITION BY route ORDER BY le ASC NULLS LAST)),
r AS (SELECT route, row_number() OVER (PARTITION BY route ORDER BY le ASC NULLS LAST) AS rn, CASE WHEN le IS NULL THEN ple ELSE ple + (le - ple) * (n * 0.95 - pc) / (cumulative - pc) END AS v FROM s WHERE cumulative >= n * 0.95)
SELECT route, round(v, 6) AS quantile FROM r WHERE rn = 1""")
def histogram_quantile(t):
    return A.histogram_quantile(A.histogram(t("http_requests"), ["route"], "latency_s"), ["route"], 0.95)


@query("error_ratio", """
SELECT CAST(ts AS DATE) AS day, round(COUNT(*) FILTER (status_code >= 500) / greatest(COUNT(*), 0.001), 6) AS error_ratio, COUNT(*) AS n FROM http_requests GROUP BY 1""")
def error_ratio(t):
    return A.error_ratio(t("http_requests").withColumn("day", F.to_date("ts")), ["day"])


@query("tool_metrics", """
SELECT event_type AS tool, COUNT(*) AS calls, COUNT(*) FILTER (event_type <> 'error' OR value < 20) AS succeeded, COUNT(*) FILTER (NOT (event_type <> 'error' OR value < 20)) AS failed,
  round(SUM(value), 6) AS total_ms, MIN(value) AS min_ms, MAX(value) AS max_ms, round(SUM(value / 1000), 6) AS cost, round(AVG(value), 6) AS avg_ms
FROM events GROUP BY ROLLUP (event_type)""")
def tool_metrics(t):
    calls = t("events").select(
        F.col("event_type").alias("tool"), F.col("value").alias("duration_ms"), (F.col("value") / 1000).alias("cost"),
        ((F.col("event_type") != "error") | (F.col("value") < 20)).alias("success"))
    return A.tool_metrics(calls).withColumn("total_ms", S.rounded(F.col("total_ms"), 6))


@query("workflow_summary", """
WITH w AS (SELECT o_orderpriority AS kind, CASE o_orderstatus WHEN 'F' THEN 'completed' WHEN 'P' THEN 'failed' ELSE 'running' END AS status, o_totalprice AS duration FROM orders)
SELECT kind, COUNT(*) AS total, COUNT(*) FILTER (status = 'running') AS active, COUNT(*) FILTER (status = 'completed') AS completed, COUNT(*) FILTER (status = 'failed') AS failed,
  round(coalesce(AVG(CASE WHEN status = 'completed' AND duration > 0 THEN duration END), 0), 6) AS avg_duration,
  round(COUNT(*) FILTER (status = 'completed') / COUNT(*) FILTER (status <> 'running') * 100, 6) AS success_rate
FROM w GROUP BY kind""")
def workflow_summary(t):
    s = F.col("o_orderstatus")
    w = t("orders").select(F.col("o_orderpriority").alias("kind"), F.when(s == "F", "completed").when(s == "P", "failed").otherwise("running").alias("status"),
                           F.col("o_totalprice").alias("duration"))
    return A.workflow_summary(w, ["kind"])


@query("stage_metrics_summary", """
WITH s AS (SELECT run_id, phase AS stage, CAST(floor(epoch(ended - started) / 86400) AS BIGINT) AS duration FROM phase_spans),
r AS (SELECT *, row_number() OVER (PARTITION BY run_id ORDER BY duration DESC, stage) AS rn, COUNT(*) OVER (PARTITION BY run_id) AS stages, SUM(duration) OVER (PARTITION BY run_id) AS total FROM s)
SELECT run_id, stages, CAST(total AS BIGINT) AS total, stage AS slowest_stage, duration AS slowest_duration FROM r WHERE rn = 1""")
def stage_metrics_summary(t):
    s = t("phase_spans").select("run_id", F.col("phase").alias("stage"), F.datediff("ended", "started").cast("bigint").alias("duration"))
    return A.stage_summary(s, "run_id")


@query("memory_stats", f"""
SELECT memory_type, tier, CAST(GROUPING(memory_type) * 2 + GROUPING(tier) AS INT) AS level, COUNT(*) AS memories, CAST(SUM(access_count) AS BIGINT) AS accesses,
  COUNT(*) FILTER (expires_at < {NOW}) AS expired FROM memories GROUP BY GROUPING SETS ((memory_type), (tier), ())""")
def memory_stats(t):
    return A.memory_stats(t("memories"), AS_OF)


@query("approval_summary", """
SELECT l_orderkey, COUNT(*) FILTER (l_returnflag = 'N') AS approved, COUNT(*) FILTER (l_returnflag = 'R') AS rejected, COUNT(*) FILTER (l_returnflag = 'A') AS pending FROM lineitem GROUP BY l_orderkey""")
def approval_summary(t):
    f = F.col("l_returnflag")
    status = F.when(f == "N", "approved").when(f == "R", "rejected").otherwise("pending")
    return A.approval_summary(t("lineitem").select("l_orderkey", status.alias("status")), "l_orderkey")


_METRIC_LONG = "SELECT p_brand AS grp, id AS metric, score AS value FROM {0} JOIN part ON id = p_partkey"


@query("reproducibility_score", f"""
WITH c AS ({_METRIC_LONG.format('snap_base')}), a AS ({_METRIC_LONG.format('snap_cur')}),
s AS (SELECT c.grp, AVG(CASE WHEN c.value <> 0 THEN CASE WHEN coalesce(a.value, 0) <= 0 THEN 0.0 ELSE greatest(0, least(1, a.value / c.value, c.value / a.value)) END END) AS s FROM c LEFT JOIN a USING (grp, metric) GROUP BY c.grp),
g AS (SELECT DISTINCT p_brand AS grp FROM part),
o AS (SELECT g.grp, coalesce(s.s, 0.5) AS score FROM g LEFT JOIN s USING (grp))
SELECT grp, round(score, 6) AS score, CASE WHEN score > 0.9 THEN 'reproduced' WHEN score > 0.5 THEN 'partial' ELSE 'failed' END AS verdict FROM o""")
def reproducibility_score(t):
    part = t("part").select(F.col("p_partkey").alias("id"), F.col("p_brand").alias("grp"))
    long = lambda v: t(v).join(part, "id").select("grp", F.col("id").alias("metric"), F.col("score").alias("value"))
    return A.reproducibility(long("snap_base"), long("snap_cur"), "grp", part)


_CASES = """cases AS (SELECT o_orderkey, o_totalprice > 20000 AS patch_applied, CASE o_orderstatus WHEN 'O' THEN 'passed' WHEN 'F' THEN 'passed' ELSE 'failed' END AS tests_status,
  CASE WHEN o_orderpriority = '5-LOW' THEN 'unreviewed' WHEN o_orderpriority = '1-URGENT' THEN 'rejected' ELSE 'accepted' END AS human_review,
  CASE WHEN o_totalprice <= 20000 THEN 'patch' WHEN o_orderstatus = 'P' THEN 'tests' ELSE '' END AS failure_stage FROM orders)"""


def _cases(t):
    st, pr = F.col("o_orderstatus"), F.col("o_orderpriority")
    return t("orders").select(
        "o_orderkey", (F.col("o_totalprice") > 20000).alias("patch_applied"), F.when(st.isin("O", "F"), "passed").otherwise("failed").alias("tests_status"),
        F.when(pr == "5-LOW", "unreviewed").when(pr == "1-URGENT", "rejected").otherwise("accepted").alias("human_review"),
        F.when(F.col("o_totalprice") <= 20000, "patch").when(st == "P", "tests").otherwise("").alias("failure_stage"))


@query("acceptance_report", f"""
WITH {_CASES}, a AS (SELECT COUNT(*) AS total_cases, round(COUNT(*) FILTER (patch_applied) / COUNT(*), 3) AS patch_rate,
  round(COUNT(*) FILTER (tests_status = 'passed') / COUNT(*) FILTER (tests_status <> 'not_configured'), 3) AS test_rate, round(COUNT(*) FILTER (tests_status <> 'not_configured') / COUNT(*), 3) AS test_coverage,
  round(COUNT(*) FILTER (human_review = 'accepted') / COUNT(*) FILTER (human_review <> 'unreviewed'), 3) AS review_rate, round(COUNT(*) FILTER (human_review <> 'unreviewed') / COUNT(*), 3) AS review_coverage FROM cases)
SELECT *, CASE WHEN NOT (test_coverage = 1 AND review_coverage = 1) THEN 'incomplete' WHEN patch_rate >= 0.9 AND test_rate >= 0.8 AND review_rate >= 0.7 THEN 'passed' ELSE 'failed' END AS gate FROM a""")
def acceptance_report(t):
    return A.acceptance_report(_cases(t))


@query("acceptance_failures", f"WITH {_CASES} SELECT failure_stage, COUNT(*) AS n FROM cases WHERE failure_stage <> '' GROUP BY 1")
def acceptance_failures(t):
    return A.failure_counts(_cases(t))


_BENCH = r"""w AS (SELECT pair_id, list_distinct(regexp_extract_all(lower(original), '[a-z0-9_]+')) AS e, list_distinct(regexp_extract_all(lower(modified), '[a-z0-9_]+')) AS c, original = modified AS same FROM versions),
o AS (SELECT *, round(len(list_intersect(e, c)) / greatest(len(e), 1), 3) AS overlap FROM w),
r AS (SELECT pair_id, overlap, CASE WHEN len(c) = 0 THEN 'missing_candidate' WHEN same THEN 'matched' WHEN overlap >= 0.5 THEN 'partial' ELSE 'mismatch' END AS status FROM o),
results AS (SELECT *, CASE status WHEN 'matched' THEN 1.0e0 WHEN 'partial' THEN 0.5e0 ELSE 0e0 END AS score FROM r)"""


def _bench(t):
    from citeloom.functions.text import identifier_tokens

    w = t("versions").select("pair_id", F.array_distinct(identifier_tokens(F.col("original"))).alias("e"),
                             F.array_distinct(identifier_tokens(F.col("modified"))).alias("c"), (F.col("original") == F.col("modified")).alias("same"))
    return A.benchmark_cases(w, "pair_id", "e", "c", F.col("same"))


@query("benchmark_cases", f"WITH {_BENCH} SELECT pair_id, overlap, status, score FROM results")
def benchmark_cases(t):
    return _bench(t)


@query("benchmark_aggregate", """
WITH results AS (SELECT id, status, CASE WHEN status = 'matched' THEN 1.0e0 WHEN status = 'partial' THEN 0.5e0 ELSE 0e0 END AS score FROM results_base)
SELECT round(AVG(score), 3) AS aggregate_score, round(AVG(CASE WHEN status <> 'unsupported_spec' THEN score END), 3) AS supported_score, COUNT(*) AS cases,
  COUNT(*) FILTER (status = 'matched') AS matched, COUNT(*) FILTER (status = 'partial') AS partial FROM results""")
def benchmark_aggregate(t):
    scored = t("results_base").withColumn("score", S.lookup(F.col("status"), {"matched": 1.0, "partial": 0.5}, 0.0))
    return A.benchmark_aggregate(scored)


@query("capped_confidence", """
WITH a AS (SELECT spec, COUNT(*) AS n_targets, COUNT(*) FILTER (match_tier = 'exact') AS x, COUNT(*) FILTER (starts_with(match_tier, 'fuzzy')) AS f, COUNT(*) FILTER (match_tier = 'import') AS i,
  COUNT(DISTINCT CASE WHEN match_tier = 'text_scan' THEN matched_pattern END) AS tx, COUNT(*) FILTER (issue = 'error') AS n_errors FROM candidates GROUP BY spec),
s AS (SELECT *, greatest(0, least(100, 35 + 20 + least(x * 10, 40) + CASE WHEN f > 0 THEN 10 ELSE 0 END + CASE WHEN i > 0 THEN 10 ELSE 0 END + least(tx * 5, 15)
  + CASE WHEN n_errors = 0 THEN 10 ELSE 0 END + CASE WHEN spec % 2 = 0 THEN 10 ELSE 0 END - n_errors * 10)) AS total FROM a)
SELECT spec, n_targets, n_errors, total, total < 70 AS approval_required FROM s""")
def capped_confidence(t):
    return A.capped_confidence(t("candidates"), "spec", F.col("spec") % 2 == 0)


@query("signature_regression", r"""
WITH s AS (SELECT file, line_no, regexp_extract(content, '^def (\w+)', 1) AS fn, regexp_extract(content, '^class (\w+)', 1) AS cl, regexp_extract(content, '\(([^)]*)\)', 1) AS sig FROM code_lines WHERE starts_with(content, 'def ') OR starts_with(content, 'class ')),
y AS (SELECT file, line_no, CASE WHEN fn <> '' THEN 'fn:' || fn ELSE 'class:' || cl END AS symbol, sig FROM s),
b AS (SELECT file, symbol, MAX(sig) AS old FROM y WHERE line_no <= 3 GROUP BY 1, 2), a AS (SELECT file, symbol, MAX(CASE WHEN line_no = 2 THEN sig || ', z' ELSE sig END) AS new FROM y WHERE line_no >= 2 GROUP BY 1, 2)
SELECT b.file, b.symbol, CASE WHEN new IS NULL THEN 'removed' ELSE 'signature_changed' END AS change FROM b LEFT JOIN a USING (file, symbol) WHERE new IS NULL OR old <> new""")
def signature_regression(t):
    from citeloom.operators.documents import code_symbols

    y = code_symbols(t("code_lines"))
    after = y.filter("line_no >= 2").withColumn("signature", F.when(F.col("line_no") == 2, F.concat("signature", F.lit(", z"))).otherwise(F.col("signature")))
    return A.signature_regression(y.filter("line_no <= 3"), after)


@query("trust_status", """
WITH r AS (SELECT l_orderkey AS run_id, COUNT(*) FILTER (l_returnflag <> 'R') / COUNT(*) AS generation_rate, MAX(l_tax) < 0.08 AS execution_ok, 0.6 + MIN(l_discount) * 4 AS reproducibility,
  COUNT(*) FILTER (l_quantity > 25) / COUNT(*) AS coverage, COUNT(*) FILTER (l_linestatus = 'F') AS total_equations FROM lineitem GROUP BY l_orderkey)
SELECT run_id, CASE WHEN NOT execution_ok OR generation_rate < 0.5 THEN 'failed' WHEN generation_rate >= 0.9 AND reproducibility >= 0.75 AND (total_equations = 0 OR coverage >= 0.5) THEN 'trusted' ELSE 'needs_review' END AS status,
  concat_ws(',', CASE WHEN generation_rate < 1 THEN 'generation_incomplete' END, CASE WHEN NOT execution_ok THEN 'validation_failed' END, CASE WHEN reproducibility < 0.75 THEN 'reproducibility_low' END,
    CASE WHEN total_equations = 0 THEN 'no_equations' WHEN coverage < 0.5 THEN 'traceability_low' END) AS notes FROM r""")
def trust_status(t):
    n = F.count("*")
    runs = t("lineitem").groupBy(F.col("l_orderkey").alias("run_id")).agg(
        (F.count_if(F.col("l_returnflag") != "R") / n).alias("generation_rate"), (F.max("l_tax") < 0.08).alias("execution_ok"),
        (F.min("l_discount") * 4 + 0.6).alias("reproducibility"), (F.count_if(F.col("l_quantity") > 25) / n).alias("coverage"),
        F.count_if(F.col("l_linestatus") == "F").alias("total_equations"))
    return A.trust_status(runs)


@query("citation_trends", """
WITH c AS (SELECT dst AS id, COUNT(DISTINCT src) AS c FROM cites GROUP BY dst)
SELECT year, COUNT(*) AS papers, CAST(coalesce(SUM(c), 0) AS BIGINT) AS citations FROM cite_nodes LEFT JOIN c USING (id) WHERE year >= 2000 GROUP BY year""")
def citation_trends(t):
    return A.citation_trends(t("cite_nodes"), t("cites"))


@query("test_outcome_scores", """
WITH r AS (SELECT l_suppkey AS suite, CASE l_returnflag WHEN 'A' THEN 'killed' WHEN 'N' THEN 'survived' ELSE CASE l_linestatus WHEN 'F' THEN 'crash' ELSE 'hang' END END AS outcome, CAST(CAST(l_quantity AS INT) AS VARCHAR) AS input FROM lineitem)
SELECT suite, COUNT(*) FILTER (outcome = 'killed') AS killed, COUNT(*) FILTER (outcome = 'survived') AS survived,
  round(coalesce(COUNT(*) FILTER (outcome = 'killed') / nullif(COUNT(*) FILTER (outcome IN ('killed', 'survived')), 0), 0), 6) AS score,
  COUNT(DISTINCT CASE WHEN outcome = 'crash' THEN input END) AS unique_crashes, COUNT(DISTINCT CASE WHEN outcome = 'hang' THEN input END) AS unique_hangs FROM r GROUP BY suite""")
def test_outcome_scores(t):
    f = F.col("l_returnflag")
    outcome = F.when(f == "A", "killed").when(f == "N", "survived").when(F.col("l_linestatus") == "F", "crash").otherwise("hang")
    r = t("lineitem").select(F.col("l_suppkey").alias("suite"), outcome.alias("outcome"), F.col("l_quantity").cast("int").cast("string").alias("input"))
    return A.test_outcomes(r, "suite")


_RECORDS = """recs AS (SELECT md5(text) AS grp, doc_id AS pos, CASE WHEN doc_id % 3 = 0 THEN '' ELSE 'T' || doc_id END AS title, 'u' || doc_id AS url, CASE WHEN doc_id % 4 = 0 THEN '10.1/' || doc_id ELSE '' END AS doi,
  '' AS journal, substring(md5(CAST(doc_id AS VARCHAR)), 1, CAST(doc_id % 20 AS INT)) AS abstract, CAST(2000 + doc_id % 25 AS INT) AS year, CAST(doc_id % 9 AS INT) AS citations FROM documents)"""


def _records(t):
    d, s = F.col("doc_id"), F.col("doc_id").cast("string")
    return t("documents").select(
        F.md5("text").alias("grp"), d.alias("pos"), F.when(d % 3 == 0, "").otherwise(F.concat(F.lit("T"), s)).alias("title"), F.concat(F.lit("u"), s).alias("url"),
        F.when(d % 4 == 0, F.concat(F.lit("10.1/"), s)).otherwise("").alias("doi"), F.lit("").alias("journal"),
        F.expr("substring(md5(cast(doc_id as string)), 1, cast(doc_id % 20 as int))").alias("abstract"),
        (2000 + d % 25).cast("int").alias("year"), (d % 9).cast("int").alias("citations"), F.array("lang", "source").alias("keywords"))


@query("merge_records", f"""
WITH {_RECORDS}, f AS (SELECT *, CAST(title <> '' AS INT) + CAST(abstract <> '' AS INT) + CAST(url <> '' AS INT) + CAST(doi <> '' AS INT) AS filled FROM recs),
b AS (SELECT *, row_number() OVER (PARTITION BY grp ORDER BY filled DESC, length(abstract) DESC, citations DESC, pos) AS rn FROM f),
o AS (SELECT *, CASE WHEN rn = 1 THEN -1 ELSE pos END AS ord FROM b)
SELECT grp, MAX(CASE WHEN rn = 1 THEN pos END) AS base_pos, coalesce(arg_min(title, ord) FILTER (title <> ''), '') AS title, coalesce(arg_min(url, ord) FILTER (url <> ''), '') AS url,
  coalesce(arg_min(doi, ord) FILTER (doi <> ''), '') AS doi, coalesce(arg_min(journal, ord) FILTER (journal <> ''), '') AS journal,
  arg_max(abstract, length(abstract) * 1000000 - ord) AS abstract, MAX(year) AS year, MAX(citations) AS citations, COUNT(*) AS n_merged FROM o GROUP BY grp""")
def merge_records(t):
    return A.merge_papers(_records(t), "grp", "pos")


@query("merge_record_lists", """
WITH l AS (SELECT md5(text) AS grp, doc_id AS pos, unnest([lang, source]) AS value, unnest([0, 1]) AS i FROM documents),
f AS (SELECT *, row_number() OVER (PARTITION BY grp, value ORDER BY pos, i) AS rn FROM l)
SELECT grp, value, pos AS first_pos, i AS first_index FROM f WHERE rn = 1""")
def merge_record_lists(t):
    return A.merge_lists(_records(t), "grp", "pos", "keywords")


@query("merge_specs", """
SELECT o_custkey AS plan_id, COUNT(*) AS n_specs, CAST(MIN(EXTRACT(YEAR FROM o_orderdate)) AS INT) AS year, arg_max(o_orderpriority, o_orderkey) AS parameter FROM orders GROUP BY o_custkey""")
def merge_specs(t):
    s = t("orders").select(F.col("o_custkey").alias("plan_id"), "o_orderkey", F.year("o_orderdate").alias("year"), F.col("o_orderpriority").alias("parameter"))
    return A.merge_specs(s, "plan_id", "o_orderkey")


@query("merge_keyed_lists", """
SELECT l_partkey, l_returnflag, arg_max(l_suppkey, l_orderkey * 1000 + l_linenumber * 100 + l_suppkey % 100) AS l_suppkey, MAX(l_discount) AS l_discount
FROM lineitem GROUP BY l_partkey, l_returnflag""")
def merge_keyed_lists(t):
    pos = F.col("l_orderkey") * 1000 + F.col("l_linenumber") * 100 + F.col("l_suppkey") % 100
    return A.merge_keyed(t("lineitem").withColumn("pos", pos), ["l_partkey", "l_returnflag"], "pos", "l_suppkey", "l_discount")


@query("circuit_health", """
WITH c AS (SELECT user_id, COUNT(*) AS calls, COUNT(*) FILTER (event_type = 'error') AS failures FROM events GROUP BY user_id)
SELECT COUNT(*) AS circuits, COUNT(*) FILTER (failures >= 5) AS open_circuits, CAST(SUM(calls) AS BIGINT) AS calls, CAST(SUM(failures) AS BIGINT) AS failures FROM c""")
def circuit_health(t):
    c = t("events").groupBy("user_id").agg(F.count("*").alias("calls"), F.count_if(F.col("event_type") == "error").alias("failures"))
    return A.circuit_health(c.withColumn("state", F.when(F.col("failures") >= 5, "open").otherwise("closed")))


@query("reflection_report", """
WITH r AS (SELECT CASE role WHEN 'user' THEN 'success_pattern' WHEN 'system' THEN 'error_analysis' ELSE 'improvement' END AS kind, 1 + turn % 5 AS rating, unnest(regexp_extract_all(lower(text), '[a-z]{6,}')) AS lesson FROM conversations),
d AS (SELECT DISTINCT kind, lesson FROM r), k AS (SELECT *, row_number() OVER (PARTITION BY kind ORDER BY lesson) AS rn FROM d),
n AS (SELECT CASE role WHEN 'user' THEN 'success_pattern' WHEN 'system' THEN 'error_analysis' ELSE 'improvement' END AS kind, COUNT(*) AS n, round(AVG(1 + turn % 5), 6) AS avg_rating FROM conversations GROUP BY 1)
SELECT kind, n, avg_rating, lesson, CAST(rn AS INT) AS rn FROM k JOIN n USING (kind) WHERE rn <= 5""")
def reflection_report(t):
    role = F.col("role")
    kind = F.when(role == "user", "success_pattern").when(role == "system", "error_analysis").otherwise("improvement")
    r = t("conversations").select(kind.alias("kind"), (1 + F.col("turn") % 5).alias("rating"), F.regexp_extract_all(F.lower("text"), F.lit("([a-z]{6,})"), F.lit(1)).alias("lessons"))
    totals, lessons = A.reflection_report(r)
    return lessons.join(totals, "kind").select("kind", "n", "avg_rating", "lesson", "rn")


@query("plan_progress", """
SELECT plan_id, COUNT(*) AS total, COUNT(*) FILTER (status = 'completed') AS completed, round(COUNT(*) FILTER (status = 'completed') / COUNT(*), 6) AS success_rate, bool_and(status = 'completed') AS all_complete
FROM tasks GROUP BY plan_id""")
def plan_progress(t):
    return A.plan_progress(t("tasks"), "plan_id")
