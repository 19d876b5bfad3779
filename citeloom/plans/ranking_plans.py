"""Windows, rankings, search and set families over whole tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from citeloom.functions import constants as K, scoring as S, text as X
from citeloom.operators import ordered as O, ranking as N, rules as R, search as Q, sets as D, vectors as V
from citeloom.session import cut_lineage

from .registry import query
from .scalar_plans import SEARCH_TOKENS, _in
from .views import AS_OF, AS_OF_YEAR

NOW = f"TIMESTAMP '{AS_OF}'"
METRICS = ["click", "error", "purchase", "signup", "view"]


# F: windows -----------------------------------------------------------------

@query("last_value_per_metric", """
SELECT run_id, metric_name, metric_value AS value FROM metrics QUALIFY row_number() OVER (PARTITION BY run_id, metric_name ORDER BY epoch DESC, step DESC) = 1""")
def last_value_per_metric(t):
    return N.final_metrics(t("metrics"))


@query("best_worst_run", f"""
WITH f AS (SELECT *, metric_name NOT IN ({_in(K.LOWER_IS_BETTER)}) AS up FROM final_metrics_sql),
r AS (SELECT *, row_number() OVER (PARTITION BY metric_name ORDER BY CASE WHEN up THEN value ELSE -value END DESC, run_id) AS b,
  row_number() OVER (PARTITION BY metric_name ORDER BY CASE WHEN up THEN value ELSE -value END, run_id) AS w FROM f)
SELECT metric_name, MAX(CASE WHEN b = 1 THEN run_id END) AS best_run, MAX(CASE WHEN w = 1 THEN run_id END) AS worst_run, bool_or(up) AS higher_better FROM r GROUP BY metric_name""")
def best_worst_run(t):
    return N.best_worst(N.final_metrics(t("metrics")))


@query("overall_winner", f"""
WITH f AS (SELECT *, metric_name NOT IN ({_in(K.LOWER_IS_BETTER)}) AS up FROM final_metrics_sql),
r AS (SELECT *, row_number() OVER (PARTITION BY metric_name ORDER BY CASE WHEN up THEN value ELSE -value END DESC, run_id) AS b FROM f)
SELECT run_id AS winner, COUNT(*) AS wins FROM r WHERE b = 1 GROUP BY run_id ORDER BY wins DESC, run_id LIMIT 1""")
def overall_winner(t):
    return N.overall_winner(N.best_worst(N.final_metrics(t("metrics"))))


@query("delta_from_baseline", """
SELECT run_id, metric_name, value - first_value(value) OVER (PARTITION BY metric_name ORDER BY run_id) AS delta FROM final_metrics_sql""")
def delta_from_baseline(t):
    finals = N.final_metrics(t("metrics"))
    first = finals.groupBy("metric_name").agg(F.min(F.struct("run_id", "value"))["value"].alias("base"))
    return finals.join(first, "metric_name").select("run_id", "metric_name", (F.col("value") - F.col("base")).alias("delta"))


@query("pivot_metric_matrix", "SELECT run_id, " + ", ".join(
    f"MAX(CASE WHEN metric_name = '{m}' THEN value END) AS {m}" for m in METRICS) + " FROM final_metrics_sql GROUP BY run_id")
def pivot_metric_matrix(t):
    return N.pivot_metrics(N.final_metrics(t("metrics")), METRICS)


@query("rank_variants", """
WITH v AS (SELECT event_id, user_id % 5 AS experiment, CASE WHEN event_type = 'error' THEN 'failed' ELSE 'completed' END AS status, value AS score FROM events),
n AS (SELECT experiment, COUNT(*) FILTER (status = 'completed') AS n FROM v GROUP BY experiment)
SELECT event_id, experiment, status, CASE WHEN status = 'completed' THEN row_number() OVER (PARTITION BY experiment, status ORDER BY score DESC, event_id) ELSE n + 1 END AS rank FROM v JOIN n USING (experiment)""")
def rank_variants(t):
    v = t("events").select("event_id", (F.col("user_id") % 5).alias("experiment"), F.when(F.col("event_type") == "error", "failed").otherwise("completed").alias("status"),
                           F.col("value").alias("score"))
    return N.rank_variants(v, "experiment", "event_id", "score").select("event_id", "experiment", "status", "rank")


@query("rolling_rate_counts", """
SELECT event_id, COUNT(*) OVER (PARTITION BY key_id ORDER BY us RANGE BETWEEN 59999999 PRECEDING AND CURRENT ROW) AS last_minute,
  COUNT(*) OVER (PARTITION BY key_id ORDER BY us RANGE BETWEEN 3599999999 PRECEDING AND CURRENT ROW) AS last_hour,
  COUNT(*) OVER (PARTITION BY key_id ORDER BY us RANGE BETWEEN 86399999999 PRECEDING AND CURRENT ROW) AS last_day
FROM (SELECT *, epoch_us(ts) AS us FROM usage)""")
def rolling_rate_counts(t):
    return N.rolling_rate_counts(t("usage").select("event_id", "key_id", "ts")).select("event_id", "last_minute", "last_hour", "last_day")


@query("latest_per_group", """
SELECT o_custkey, COUNT(*) AS n, arg_max(o_orderkey, o_orderdate || lpad(CAST(o_orderkey AS VARCHAR), 12, '0')) AS o_orderkey FROM orders WHERE o_orderstatus = 'F' GROUP BY o_custkey""")
def latest_per_group(t):
    done = t("orders").filter("o_orderstatus = 'F'")
    return N.latest_per_group(done, ["o_custkey"], ["o_orderdate", "o_orderkey"], ["o_orderkey"]).select("o_custkey", "n", "o_orderkey")


@query("keep_n_per_status", """
SELECT o_orderkey FROM orders WHERE o_orderstatus NOT IN ('F', 'P')
UNION ALL SELECT o_orderkey FROM (SELECT o_orderkey, row_number() OVER (PARTITION BY o_custkey, o_orderstatus ORDER BY o_orderdate DESC, o_orderkey DESC) AS rn FROM orders WHERE o_orderstatus IN ('F', 'P')) WHERE rn <= 2""")
def keep_n_per_status(t):
    return N.keep_newest(t("orders"), "o_custkey", "o_orderstatus", [F.desc("o_orderdate"), F.desc("o_orderkey")], ["F", "P"], 2).select("o_orderkey")


@query("phase_durations", """
WITH a AS (SELECT run_id, phase, MIN(CASE WHEN kind = 'start' THEN ts END) AS s, MAX(CASE WHEN kind = 'complete' THEN ts END) AS e, COUNT(*) FILTER (kind = 'retry') AS retries FROM phase_events GROUP BY run_id, phase)
SELECT run_id, phase, epoch(e - s) AS seconds, retries, CASE WHEN s IS NULL THEN 'orphan' WHEN e IS NULL THEN 'running' ELSE 'completed' END AS state FROM a""")
def phase_durations(t):
    return N.phase_durations(t("phase_events"), "run_id", "phase")


@query("audit_timeline", """
WITH m AS (SELECT o_custkey AS key, o_orderdate AS ts, 0 AS prio, 'created' AS label, o_orderkey AS ref FROM orders
  UNION ALL SELECT o_custkey, l_shipdate, 1, 'decision', l_orderkey * 10 + l_linenumber FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE l_returnflag = 'A'
  UNION ALL SELECT o_custkey, l_shipdate, 2, 'failure', l_orderkey * 10 + l_linenumber FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE l_returnflag = 'R')
SELECT key, label, CAST(seq AS BIGINT) AS seq FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY ts, prio, ref) AS seq FROM m)""")
def audit_timeline(t):
    o = t("orders")
    made = o.select(F.col("o_custkey").alias("key"), F.col("o_orderdate").alias("ts"), F.lit(0).alias("prio"), F.lit("created").alias("label"), F.col("o_orderkey").alias("ref"))
    li = t("lineitem").join(o, F.col("l_orderkey") == F.col("o_orderkey"))
    part = lambda flag, prio, label: li.filter(F.col("l_returnflag") == flag).select(
        F.col("o_custkey").alias("key"), F.col("l_shipdate").alias("ts"), F.lit(prio).alias("prio"), F.lit(label).alias("label"),
        (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("ref"))
    return N.audit_timeline([made, part("A", 1, "decision"), part("R", 2, "failure")], "key").select("key", "label", "seq")


@query("running_totals", """
SELECT event_id, COUNT(*) OVER w AS requests, CAST(SUM(latency_ms) OVER w AS BIGINT) AS latency, COUNT(*) FILTER (status = 'error') OVER w AS errors
FROM usage WINDOW w AS (PARTITION BY provider ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING)""")
def running_totals(t):
    sums = {"requests": F.lit(1), "latency": F.col("latency_ms"), "errors": F.when(F.col("status") == "error", 1).otherwise(0)}
    return N.running_totals(t("usage"), "provider", ["ts", "event_id"], sums).select("event_id", "requests", "latency", "errors")


@query("session_history", """
SELECT key_id, id FROM (SELECT *, row_number() OVER (PARTITION BY key_id ORDER BY ts DESC, id DESC) AS rn FROM audit) WHERE rn <= 5""")
def session_history(t):
    return N.top_per_group(t("audit"), ["key_id"], [F.desc("ts"), F.desc("id")], 5).select("key_id", "id")


@query("event_gap_analytics", """
SELECT id, epoch_us(ts) - epoch_us(lag(ts) OVER (PARTITION BY key_id ORDER BY ts, id)) AS gap_us FROM audit""")
def event_gap_analytics(t):
    return N.event_gaps(t("audit"), "key_id", ["ts", "id"]).select("id", F.round(F.col("gap_seconds") * O.MICROS).cast("bigint").alias("gap_us"))


_HOURS = "(epoch({now}) - epoch(created_at)) / 3600".format(now=NOW)


@query("retrieval_rank", rf"""
WITH m AS (SELECT *, list_distinct(regexp_split_to_array(lower(content), '\s+')) AS words, {_HOURS} AS h FROM memories WHERE memory_type IN ('episodic', 'semantic', 'procedural') AND NOT coalesce(expires_at < {NOW}, false)),
s AS (SELECT id, least(1.0, (len(list_intersect(['the', 'user', 'for'], words)) + 2.0 * len(list_intersect(['the', 'user', 'for'], [lower(tag)]))) / 3) AS rel,
  least(1.0, CASE WHEN h < 1 THEN 1.0 WHEN h < 24 THEN 0.9 WHEN h < 168 THEN 0.7 WHEN h < 720 THEN 0.5 WHEN h < 2160 THEN 0.3 WHEN h < 8760 THEN 0.2 ELSE 0.1 END + least(0.2, access_count * 0.02)
    + CASE WHEN epoch({NOW}) - epoch(accessed_at) < 3600 THEN 0.1 ELSE 0 END) AS rec,
  least(1.0, importance / 5 + CASE WHEN memory_type = 'semantic' THEN 0.1 ELSE 0 END) AS imp FROM m)
SELECT id, round(rel * 0.5 + rec * 0.3 + imp * 0.2, 6) AS score FROM s""")
def retrieval_rank(t):
    m = t("memories").withColumn("tags", F.array("tag"))
    return N.memory_scores(m, "the user for", AS_OF).select("id", S.rounded(F.col("score"), 6).alias("score"))


# G: search and top-k --------------------------------------------------------

@query("doc_frequency_idf", f"""
WITH t AS (SELECT DISTINCT paper_id, unnest({SEARCH_TOKENS.format("concat_ws(' ', title, abstract)")}) AS term FROM papers),
n AS (SELECT COUNT(*) AS n FROM papers)
SELECT term, COUNT(*) AS df, round(ln(n / (1 + COUNT(*))) + 1, 6) AS idf, round(ln((1 + n) / (1 + COUNT(*))) + 1, 6) AS idf_smooth FROM t, n GROUP BY term, n""")
def doc_frequency_idf(t):
    p = t("papers")
    counts = cut_lineage(Q.search_terms(p, "paper_id", F.concat_ws(" ", "title", "abstract")))
    n = p.count()
    plain, smooth = Q.document_frequency(counts, n), Q.document_frequency(counts, n, smooth=True)
    return plain.join(smooth.select("term", F.col("idf").alias("idf_smooth")), "term").select(
        "term", "df", S.rounded(F.col("idf"), 6).alias("idf"), S.rounded(F.col("idf_smooth"), 6).alias("idf_smooth"))


@query("term_frequency", f"""
WITH t AS (SELECT paper_id, unnest({SEARCH_TOKENS.format('abstract')}) AS term FROM papers), c AS (SELECT paper_id, term, COUNT(*) AS n FROM t GROUP BY 1, 2)
SELECT paper_id, term, round(n / SUM(n) OVER (PARTITION BY paper_id), 6) AS tf FROM c""")
def term_frequency(t):
    return Q.term_frequency(Q.search_terms(t("papers"), "paper_id", F.col("abstract")), "paper_id").withColumn("tf", S.rounded(F.col("tf"), 6))


@query("tfidf_cosine", f"""
WITH t AS (SELECT doc_id, unnest({SEARCH_TOKENS.format('text')}) AS term FROM documents), c AS (SELECT doc_id, term, COUNT(*) AS n FROM t GROUP BY 1, 2),
tf AS (SELECT doc_id, term, n / SUM(n) OVER (PARTITION BY doc_id) AS tf FROM c),
idf AS (SELECT term, ln((SELECT COUNT(*) FROM documents) / (1 + COUNT(*))) + 1 AS idf FROM c GROUP BY term),
w AS (SELECT doc_id, term, tf * idf AS w FROM tf JOIN idf USING (term)), nn AS (SELECT doc_id, sqrt(SUM(w * w)) AS nn FROM w GROUP BY doc_id),
p AS (SELECT pair_id AS a_id, pair_id + 20 AS b_id FROM versions), d AS (SELECT a_id, b_id, SUM(x.w * y.w) AS dot FROM p JOIN w x ON x.doc_id = a_id JOIN w y ON y.doc_id = b_id AND y.term = x.term GROUP BY 1, 2)
SELECT p.a_id, p.b_id, round(coalesce(dot / (x.nn * y.nn), 0), 6) AS cosine FROM p LEFT JOIN d USING (a_id, b_id) LEFT JOIN nn x ON x.doc_id = a_id LEFT JOIN nn y ON y.doc_id = b_id""")
def tfidf_cosine(t):
    docs = t("documents")
    counts = cut_lineage(Q.search_terms(docs, "doc_id", F.col("text")))
    idf = Q.document_frequency(counts, docs.count())
    weights = cut_lineage(Q.tfidf_weights(Q.term_frequency(counts, "doc_id"), idf, "doc_id"))
    pairs = t("versions").select(F.col("pair_id").alias("a_id"), (F.col("pair_id") + 20).alias("b_id"))
    return Q.tfidf_cosine(weights.withColumnRenamed("doc_id", "a_id"), weights.withColumnRenamed("doc_id", "b_id"), pairs)


@query("search_similar", f"""
WITH pt AS (SELECT paper_id, unnest({SEARCH_TOKENS.format("concat_ws(' ', title, abstract)")}) AS term FROM papers), pc AS (SELECT paper_id, term, COUNT(*) AS n FROM pt GROUP BY 1, 2),
qt AS (SELECT item_id AS query_id, unnest({SEARCH_TOKENS.format('text')}) AS term FROM benchmark), qc AS (SELECT query_id, term, COUNT(*) AS n FROM qt GROUP BY 1, 2),
dfq AS (SELECT term, COUNT(*) AS df FROM pc GROUP BY term), nn AS (SELECT COUNT(*) + 1 AS n FROM papers),
qn AS (SELECT query_id, COUNT(*) AS terms, sqrt(SUM(pow(qc.n * (ln(nn.n / (1.0 + coalesce(df, 0) + 1)) + 1), 2))) AS qnorm FROM qc LEFT JOIN dfq USING (term), nn GROUP BY query_id),
pairs AS (SELECT q.query_id, p.paper_id, p.year FROM (SELECT DISTINCT query_id FROM qc) q, papers p),
hits AS (SELECT query_id, paper_id, COUNT(*) AS shared, SUM(pc.n * qc.n * pow(ln(nn.n / (2.0 + df)) + 1, 2)) AS dot, SUM(pow(pc.n, 2) * (pow(ln(nn.n / (2.0 + df)) + 1, 2) - pow(ln(nn.n / (1.0 + df)) + 1, 2))) AS fix
  FROM pc JOIN qc USING (term) JOIN dfq USING (term), nn GROUP BY 1, 2),
pn AS (SELECT paper_id, SUM(pow(pc.n * (ln(nn.n / (1.0 + df)) + 1), 2)) AS sq FROM pc JOIN dfq USING (term), nn GROUP BY paper_id),
sc AS (SELECT query_id, paper_id, round(0.4 * coalesce(shared / terms, 0) + 0.4 * coalesce(dot / (qnorm * sqrt(sq + fix)), 0) + 0.2 / (1 + 0.1 * abs({AS_OF_YEAR} - year)), 6) AS score
  FROM pairs LEFT JOIN hits USING (query_id, paper_id) LEFT JOIN pn USING (paper_id) LEFT JOIN qn USING (query_id)),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, paper_id) AS rank FROM sc WHERE score > 0.1)
SELECT query_id, paper_id, CAST(rank AS INT) AS rank, score FROM r WHERE rank <= 10""")
def search_similar(t):
    queries = t("benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("query"))
    return Q.search_similar(t("papers"), queries, 10, AS_OF_YEAR).select("query_id", "paper_id", "rank", "score")


@query("related_by_keywords", f"""
WITH tk AS (SELECT DISTINCT paper_id, unnest({SEARCH_TOKENS.format("concat_ws(' ', title, abstract)")}) AS term FROM papers),
src AS (SELECT doc_id FROM labels WHERE toxic = 1), w AS (SELECT DISTINCT term FROM tk WHERE paper_id IN (SELECT doc_id FROM src))
SELECT paper_id, COUNT(*) AS overlap, COUNT(*) / (SELECT COUNT(*) FROM w) AS score FROM tk JOIN w USING (term) WHERE paper_id NOT IN (SELECT doc_id FROM src)
GROUP BY paper_id HAVING COUNT(*) / (SELECT COUNT(*) FROM w) > 0.05 ORDER BY overlap DESC, paper_id LIMIT 10""")
def related_by_keywords(t):
    read = t("labels").filter("toxic = 1").select(F.col("doc_id").alias("paper_id"))
    p = t("papers")
    return Q.related_by_keywords(p.join(read, "paper_id", "left_semi"), p.join(read, "paper_id", "left_anti"))


_BY_WORD = "contains(lower(concat_ws(' ', title, abstract)), '{0}')"


# Two searches: one with hits by meaning, of which the query words' own are left out, and one without any.
@query("keyword_search_fallback", f"""
WITH q AS (SELECT vec_id AS qid, embedding AS qv FROM embeddings ORDER BY vec_id LIMIT 1),
s AS (SELECT e.vec_id, round(list_cosine_similarity(CAST(q.qv AS DOUBLE[]), CAST(e.embedding AS DOUBLE[])), 6) AS score FROM embeddings e, q),
r AS (SELECT vec_id, row_number() OVER (ORDER BY score DESC, vec_id) AS rank FROM s WHERE score > 0)
SELECT * FROM (SELECT 'meaning' AS search, vec_id AS paper_id, 0 AS source_rank, rank AS pos FROM r WHERE rank <= 10)
UNION ALL SELECT * FROM (SELECT 'words', paper_id, 1, paper_id FROM papers WHERE {_BY_WORD.format("rethe oning")} OR {_BY_WORD.format("rethe")} OR {_BY_WORD.format("oning")} ORDER BY paper_id LIMIT 10)""")
def keyword_search_fallback(t):
    p, e = t("papers"), t("embeddings")
    query = e.orderBy("vec_id").limit(1).select(F.col("vec_id").alias("query_id"), "embedding")
    found = V.semantic_topk(e, query, 10).select(F.col("vec_id").alias("paper_id"), "rank")
    searches = {"meaning": found, "words": found.filter("rank < 0")}
    parts = [Q.keyword_fallback(p, hits, "Rethe oning").select(F.lit(name).alias("search"), "paper_id", "source_rank", "pos") for name, hits in searches.items()]
    return parts[0].unionByName(parts[1])


_REPOS = "SELECT p_partkey, CAST(p_retailprice AS INT) % 1500 AS stars, p_name AS name, p_type AS description, [p_brand, p_name] AS topics, CAST(2015 + p_size % 12 AS VARCHAR) AS updated FROM part"


def _repos(t):
    return t("part").select(
        "p_partkey", (F.col("p_retailprice").cast("int") % 1500).alias("stars"), F.col("p_name").alias("name"), F.col("p_type").alias("description"),
        F.array("p_brand", "p_name").alias("topics"), (2015 + F.col("p_size") % 12).cast("string").alias("updated"))


@query("repo_relevance_rank", f"""
WITH r AS (SELECT p_partkey, CAST(floor(p_retailprice) AS INT) % 1500 AS stars, p_name AS name, p_type AS description, [p_brand, p_name] AS topics, CAST(2015 + p_size % 12 AS VARCHAR) AS updated FROM part)
SELECT p_partkey, CAST(least(CASE WHEN stars > 1000 THEN 30 WHEN stars > 100 THEN 20 WHEN stars > 10 THEN 10 ELSE 0 END + CASE WHEN contains(lower(name), 'widget') THEN 25 ELSE 0 END
  + CASE WHEN contains(lower(description), 'widget') THEN 15 ELSE 0 END + CASE WHEN contains(lower(topics[1]), 'widget') OR contains(lower(topics[2]), 'widget') THEN 10 ELSE 0 END
  + CASE WHEN updated IN ('2024', '2025', '2026') THEN 10 ELSE 0 END, 100) AS DOUBLE) AS relevance FROM r""")
def repo_relevance_rank(t):
    r = _repos(t)
    return r.select("p_partkey", N.repo_relevance(r, "Widget").alias("relevance"))


@query("tool_search_rank", """
WITH s AS (SELECT p_partkey, CASE WHEN contains(lower(p_name), 'ring') THEN 10 ELSE 0 END + CASE WHEN contains(lower(p_type), 'ring') THEN 5 ELSE 0 END
  + CASE WHEN contains(lower(p_brand), 'ring') THEN 3 ELSE 0 END + CASE WHEN p_type IN ('PROMO', 'SMALL') THEN 7 ELSE 0 END AS score FROM part)
SELECT p_partkey, score FROM s WHERE score > 0""")
def tool_search_rank(t):
    tools = t("part").select("p_partkey", F.col("p_name").alias("name"), F.col("p_type").alias("description"), F.array("p_brand").alias("tags"), F.array("p_type").alias("capabilities"))
    return tools.select("p_partkey", N.tool_relevance("Ring", ["PROMO", "SMALL"]).alias("score")).filter("score > 0")


@query("argmin_selection", """
WITH m AS (SELECT p_partkey AS model_id, p_type AS capability, p_size <> 7 AS enabled, (p_size % 10) / 10e0 AS reliability, p_retailprice AS cost, p_size AS latency_ms, (p_partkey * 7) % 1000 AS used FROM part),
a AS (SELECT * FROM m WHERE enabled AND reliability >= 0.3)
SELECT capability, arg_min(model_id, cost * 1e7 + model_id) AS cheapest, arg_min(model_id, latency_ms * 1e7 + model_id) AS fastest, arg_max(model_id, reliability * 1e9 - model_id) AS most_reliable, arg_min(model_id, used * 1e7 + model_id) AS least_used
FROM a GROUP BY capability""")
def argmin_selection(t):
    m = t("part").select(
        F.col("p_partkey").alias("model_id"), F.col("p_type").alias("capability"), (F.col("p_size") != 7).alias("enabled"), ((F.col("p_size") % 10) / 10.0).alias("reliability"),
        F.col("p_retailprice").alias("cost"), F.col("p_size").alias("latency_ms"), ((F.col("p_partkey") * 7) % 1000).alias("used"))
    return N.pick_models(m, ["capability"], 0.3)


@query("top_endpoints", "SELECT endpoint, COUNT(*) AS requests FROM usage GROUP BY endpoint ORDER BY requests DESC, endpoint LIMIT 10")
def top_endpoints(t):
    return N.top_endpoints(t("usage"))


@query("status_listing", "SELECT id, ts FROM tasks WHERE status = 'pending' ORDER BY ts, id LIMIT 100")
def status_listing(t):
    return N.status_listing(t("tasks"), "pending", [F.asc("ts"), F.asc("id")], 100).select("id", "ts")


@query("tag_search", "SELECT id, importance, access_count FROM memories WHERE lower(tag) = 'user' ORDER BY importance DESC, access_count DESC, id LIMIT 10")
def tag_search(t):
    return N.tag_search(t("memories").withColumn("tags", F.array("tag")), "User").select("id", "importance", "access_count")


@query("order_by_category", """
WITH s AS (SELECT o_orderkey AS pos, CASE o_orderpriority WHEN '1-URGENT' THEN 'normalization' WHEN '2-HIGH' THEN 'activation' WHEN '3-MEDIUM' THEN 'attention' ELSE 'misc' END AS category FROM orders)
SELECT pos, category, CASE category WHEN 'normalization' THEN 1 WHEN 'activation' THEN 2 WHEN 'attention' THEN 3 WHEN 'position_encoding' THEN 4 ELSE 99 END AS priority FROM s""")
def order_by_category(t):
    p = F.col("o_orderpriority")
    category = F.when(p == "1-URGENT", "normalization").when(p == "2-HIGH", "activation").when(p == "3-MEDIUM", "attention").otherwise("misc")
    return N.category_order(t("orders").select(F.col("o_orderkey").alias("pos"), category.alias("category")), "category", "pos")


@query("suggestion_rank", """
WITH s AS (SELECT row_id, CASE l.line_no % 4 WHEN 3 THEN 'norm' ELSE 'cache' END AS pattern, CASE line_no % 2 WHEN 1 THEN 'Normalization' ELSE 'Attention' END AS category, 2018 + line_no AS year FROM code_lines l)
SELECT pattern, category, year, COUNT(*) AS n, CAST(least(100, 50 + CASE WHEN contains(lower(category), pattern) THEN 30 ELSE 0 END + CASE WHEN year >= 2022 THEN 10 ELSE 0 END) AS DOUBLE) AS confidence FROM s GROUP BY ALL""")
def suggestion_rank(t):
    n = F.col("line_no")
    s = t("code_lines").select(F.when(n % 4 == 3, "norm").otherwise("cache").alias("pattern"), F.when(n % 2 == 1, "Normalization").otherwise("Attention").alias("category"), (2018 + n).alias("year"))
    return s.groupBy("pattern", "category", "year").agg(F.count("*").alias("n")).withColumn(
        "confidence", N.suggestion_confidence(F.col("pattern"), F.col("category"), F.col("year")))


@query("select_plan_topk", """
WITH s AS (SELECT o_custkey AS plan_id, o_orderkey AS pos, o_orderpriority AS name, o_orderstatus AS category FROM orders),
f AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY plan_id ORDER BY pos) <= 5), k AS (SELECT plan_id, name, MIN(pos) AS pos FROM f WHERE category = 'F' GROUP BY 1, 2)
SELECT * FROM k UNION ALL SELECT DISTINCT plan_id, unnest(['rmsnorm', 'swiglu']), unnest([0, 1]) FROM s WHERE plan_id NOT IN (SELECT plan_id FROM k)""")
def select_plan_topk(t):
    s = t("orders").select(F.col("o_custkey").alias("plan_id"), F.col("o_orderkey").alias("pos"), F.col("o_orderpriority").alias("name"), F.col("o_orderstatus").alias("category"))
    return N.select_plan(s, "plan_id", "pos", "name", 5, ["rmsnorm", "swiglu"], ["F"])


# H: sets --------------------------------------------------------------------

_KEYED = """k AS (SELECT doc_id, 'title' AS kind, regexp_replace(lower(split_part(text, chr(10), 1)), '[^a-z0-9]+', '', 'g') AS v FROM documents
  UNION ALL SELECT doc_id, 'doi', '10.1/' || (doc_id - doc_id % 6) FROM documents WHERE doc_id % 6 < 2),
ks AS (SELECT doc_id, list(kind || ':' || v) AS ks FROM k WHERE (kind = 'title' AND length(v) >= 20) OR kind = 'doi' GROUP BY doc_id),
p AS (SELECT d.doc_id, {rank} AS source_rank, coalesce(ks, []) AS ks FROM documents d LEFT JOIN ks USING (doc_id)),
r AS (SELECT *, row_number() OVER (ORDER BY source_rank, doc_id) AS i FROM p),
g AS (SELECT 0::BIGINT AS i, NULL::BIGINT AS doc_id, NULL::BIGINT AS entity, []::STRUCT(k VARCHAR, f BIGINT)[] AS founders
  UNION ALL SELECT i, doc_id, coalesce(e, doc_id), CASE WHEN e IS NULL THEN list_concat(founders, [{{'k': x, 'f': doc_id}} for x in ks]) ELSE founders END
  FROM (SELECT r.i, r.doc_id, r.ks, g.founders, ([x for x in g.founders if list_contains(r.ks, x.k)])[1].f AS e FROM g JOIN r ON r.i = g.i + 1))"""
_SOURCES = {"arxiv": ["en"], "pubmed": ["de"], "ieee": ["fr", "es"]}
_RANK = "CASE d.lang WHEN 'en' THEN 0 WHEN 'de' THEN 1 ELSE 2 END"


@query("union_sources", f"""
WITH RECURSIVE {_KEYED.format(rank=_RANK)}, e AS (SELECT g.doc_id, g.entity, r.source_rank FROM g JOIN r USING (doc_id)),
m AS (SELECT entity, list(DISTINCT source_rank ORDER BY source_rank) AS ranks FROM e GROUP BY entity)
SELECT r.doc_id AS id, r.source_rank, array_to_string([['arxiv', 'pubmed', 'ieee'][x + 1] for x in ranks], ',') AS merged_sources FROM m JOIN r ON r.doc_id = m.entity""")
def union_sources(t):
    rows = _identified(t).join(t("documents").select("doc_id", "lang"), "doc_id")
    parts = [(name, rows.filter(F.col("lang").isin(langs))) for name, langs in _SOURCES.items()]
    return D.union_deduplicated(parts, "doc_id").select(F.col("doc_id").alias("id"), "source_rank", F.array_join("merged_sources", ",").alias("merged_sources"))


@query("dedupe_entities", """
WITH k AS (SELECT doc_id, 'title' AS kind, regexp_replace(lower(split_part(text, chr(10), 1)), '[^a-z0-9]+', '', 'g') AS v FROM documents
  UNION ALL SELECT doc_id, 'doi', '10.1/' || (doc_id - doc_id % 6) FROM documents WHERE doc_id % 6 < 2),
f AS (SELECT * FROM k WHERE (kind = 'title' AND length(v) >= 20) OR kind = 'doi'),
m AS (SELECT a.doc_id AS x, b.doc_id AS y FROM f a JOIN f b ON a.kind = b.kind AND a.v = b.v),
l1 AS (SELECT d.doc_id AS id, least(d.doc_id, coalesce(MIN(y), d.doc_id)) AS c FROM documents d LEFT JOIN m ON m.x = d.doc_id GROUP BY d.doc_id),
l2 AS (SELECT l1.id, least(l1.c, coalesce(MIN(o.c), l1.c)) AS c FROM l1 LEFT JOIN m ON m.x = l1.id LEFT JOIN l1 o ON o.id = m.y GROUP BY l1.id, l1.c),
l3 AS (SELECT l2.id, least(l2.c, coalesce(MIN(o.c), l2.c)) AS c FROM l2 LEFT JOIN m ON m.x = l2.id LEFT JOIN l2 o ON o.id = m.y GROUP BY l2.id, l2.c),
l4 AS (SELECT l3.id, least(l3.c, coalesce(MIN(o.c), l3.c)) AS c FROM l3 LEFT JOIN m ON m.x = l3.id LEFT JOIN l3 o ON o.id = m.y GROUP BY l3.id, l3.c),
l5 AS (SELECT l4.id, least(l4.c, coalesce(MIN(o.c), l4.c)) AS c FROM l4 LEFT JOIN m ON m.x = l4.id LEFT JOIN l4 o ON o.id = m.y GROUP BY l4.id, l4.c),
l6 AS (SELECT l5.id, least(l5.c, coalesce(MIN(o.c), l5.c)) AS c FROM l5 LEFT JOIN m ON m.x = l5.id LEFT JOIN l5 o ON o.id = m.y GROUP BY l5.id, l5.c),
l7 AS (SELECT l6.id, least(l6.c, coalesce(MIN(o.c), l6.c)) AS c FROM l6 LEFT JOIN m ON m.x = l6.id LEFT JOIN l6 o ON o.id = m.y GROUP BY l6.id, l6.c),
l8 AS (SELECT l7.id, least(l7.c, coalesce(MIN(o.c), l7.c)) AS c FROM l7 LEFT JOIN m ON m.x = l7.id LEFT JOIN l7 o ON o.id = m.y GROUP BY l7.id, l7.c)
SELECT id AS doc_id, c AS entity FROM l8""")
def dedupe_entities(t):
    return D.connected_entities(_identified(t), "doc_id")


def _identified(t):
    d = F.col("doc_id")
    blank = F.lit("")
    return t("documents").select(
        "doc_id", F.split_part("text", F.lit("\n"), F.lit(1)).alias("title"),
        F.when(d % 6 < 2, F.concat(F.lit("doi:10.1/"), (d - d % 6).cast("string"))).otherwise("").alias("doi"),
        blank.alias("arxiv_id"), blank.alias("pubmed_id"), blank.alias("ieee_id"))


@query("dedupe_entities_greedy", f"WITH RECURSIVE {_KEYED.format(rank=0)} SELECT doc_id, entity FROM g WHERE i > 0")
def dedupe_entities_greedy(t):
    return D.greedy_entities(_identified(t), "doc_id")


@query("dedupe_first", "SELECT md5(lower(text)) AS _key, MIN(doc_id) AS doc_id, arg_min(source, doc_id) AS source FROM documents GROUP BY 1")
def dedupe_first(t):
    return D.dedupe_first(t("documents").select("doc_id", "source", F.lower("text").alias("low")), F.md5("low"), ["doc_id"]).select("_key", "doc_id", "source")


@query("intersect_sets", """
SELECT p_brand FROM part JOIN lineitem ON p_partkey = l_partkey WHERE l_returnflag = 'R' INTERSECT SELECT p_brand FROM part WHERE p_type = 'PROMO'""")
def intersect_sets(t):
    returned = t("part").join(t("lineitem").filter("l_returnflag = 'R'"), F.col("p_partkey") == F.col("l_partkey"), "left_semi").select("p_brand")
    return returned.intersect(t("part").filter("p_type = 'PROMO'").select("p_brand"))


@query("except_sets", "SELECT p_partkey FROM part EXCEPT SELECT l_partkey FROM lineitem WHERE l_quantity > 49")
def except_sets(t):
    return t("part").select("p_partkey").subtract(t("lineitem").filter("l_quantity > 49").select(F.col("l_partkey").alias("p_partkey")))


@query("upsert_last_wins", """
WITH b AS (SELECT o_custkey AS id, o_orderdate AS version, 0 AS n, o_orderkey AS payload FROM orders WHERE o_orderstatus = 'F' UNION ALL SELECT o_custkey, o_orderdate, 1, o_orderkey FROM orders WHERE o_orderstatus = 'O')
SELECT id, version, payload FROM b QUALIFY row_number() OVER (PARTITION BY id ORDER BY version DESC, n DESC, payload DESC) = 1""")
def upsert_last_wins(t):
    rows = lambda s: t("orders").filter(F.col("o_orderstatus") == s).select(
        F.col("o_custkey").alias("id"), F.col("o_orderdate").alias("version"), F.col("o_orderkey").alias("payload"))
    return D.upsert_last_wins(rows("F"), rows("O"), "id", "version")


@query("upsert_by_key", """
WITH r AS (SELECT CASE doc_id % 3 WHEN 0 THEN '1' || lpad(CAST(doc_id % 50 AS VARCHAR), 3, '0') || '.12345' WHEN 1 THEN '10.1/' || (doc_id % 40) ELSE 'hash-' || substring(sha256(text), 1, 16) END AS id, doc_id AS version, source FROM documents)
SELECT id, version, source FROM r QUALIFY row_number() OVER (PARTITION BY id ORDER BY version DESC) = 1""")
def upsert_by_key(t):
    d = F.col("doc_id")
    arxiv = F.when(d % 3 == 0, F.concat(F.lit("1"), F.lpad((d % 50).cast("string"), 3, "0"), F.lit(".12345"))).otherwise("")
    doi = F.when(d % 3 == 1, F.concat(F.lit("10.1/"), (d % 40).cast("string"))).otherwise("")
    r = t("documents").select(D.composed_id(arxiv, doi, F.col("text")).alias("id"), d.alias("version"), "source")
    return D.upsert_last_wins(r.filter("version % 2 = 0"), r.filter("version % 2 = 1"), "id", "version")


@query("incremental_refresh", """
WITH n AS (SELECT doc_id, md5(text) AS h, CAST(length(text) AS BIGINT) AS size FROM documents), c AS (SELECT pair_id + 20 AS doc_id, md5(original) AS h, CAST(length(original) AS BIGINT) AS size FROM versions)
SELECT n.doc_id, n.h, n.size, c.doc_id IS NULL AS recomputed FROM n LEFT JOIN c ON n.doc_id = c.doc_id AND n.h = c.h""")
def incremental_refresh(t):
    new = t("documents").select("doc_id", F.md5("text").alias("h"), "text")
    cache = t("versions").select((F.col("pair_id") + 20).alias("doc_id"), F.md5("original").alias("h"), F.length("original").cast("bigint").alias("size"))
    return D.incremental_refresh(new, cache, ["doc_id", "h"], lambda df: df.withColumn("size", F.length("text").cast("bigint")), "size")
