"""Readers and writers exercised by round trips of whole tables through files."""

from __future__ import annotations

from pyspark.sql import functions as F

from citeloom.operators import rules as R
from citeloom.sources import readers, sinks, tables
from citeloom.session import scratch_dir

from .registry import query
from .views import AS_OF


@query("read_jsonl_log", """
SELECT CASE WHEN event_id % 50 = 1 THEN 'reject' ELSE 'event' END AS kind, CASE WHEN event_id % 50 = 1 THEN '' WHEN event_id % 7 = 0 THEN 'success' ELSE status END AS status, COUNT(*) AS n FROM usage GROUP BY 1, 2""")
def read_jsonl_log(t):
    u = t("usage")
    e = F.col("event_id")
    doc = F.to_json(F.struct(F.col("ts").cast("string").alias("timestamp"), "provider", F.col("endpoint"), "key_id", "tokens_used", "latency_ms",
                             F.when(e % 7 != 0, F.col("status")).alias("status")))
    line = F.when(e % 100 == 1, F.lit("not json {")).when(e % 100 == 51, F.lit('{"provider": "openai"}')).otherwise(doc)
    path = scratch_dir(t.spark)
    u.select(line.alias("value")).write.text(path)
    events, rejects = readers.read_jsonl_log(t.spark, path)
    good = events.select(F.lit("event").alias("kind"), "status")
    bad = rejects.select(F.lit("reject").alias("kind"), F.lit("").alias("status"))
    return good.unionByName(bad).groupBy("kind", "status").agg(F.count("*").alias("n"))


@query("append_jsonl_sink", "SELECT CAST(ts AS DATE) AS date, COUNT(*) AS n FROM usage GROUP BY 1")
def append_jsonl_sink(t):
    path = scratch_dir(t.spark)
    rows = t("usage").select(F.col("ts").cast("string").alias("timestamp"), "provider", "endpoint", "status")
    sinks.append_jsonl(rows.filter("status = 'error'"), path)
    sinks.append_jsonl(rows.filter("status <> 'error'"), path)
    back = t.spark.read.schema("timestamp string, provider string, endpoint string, status string, date date").json(path)
    return back.groupBy("date").agg(F.count("*").alias("n"))


_GRAPH_NODES = "SELECT src FROM cites UNION SELECT dst FROM cites"


@query("read_graph_json", f"""
SELECT 'node' AS kind, CAST(src AS VARCHAR) AS id, CASE WHEN src IN (SELECT src FROM cites) THEN '2020' ELSE '0' END AS other FROM ({_GRAPH_NODES})
UNION ALL SELECT 'edge', CAST(src AS VARCHAR), CAST(dst AS VARCHAR) FROM cites""")
def read_graph_json(t):
    path = scratch_dir(t.spark)
    node = t("cites").groupBy(F.col("src").cast("string").alias("id")).agg(F.collect_set(F.col("dst").cast("string")).alias("r"))  # the references of one part
    doc = F.concat(F.lit('{"nodes": {"'), F.col("id"), F.lit('": '), F.to_json(F.struct(F.lit("t").alias("title"), F.lit(2020).alias("year"), F.array().cast("array<string>").alias("citations"), F.col("r").alias("references"))), F.lit("}}"))
    node.select(doc.alias("value")).write.text(path)
    nodes, edges = readers.read_graph_json(t.spark, path, multi_line=False)
    n = nodes.select(F.lit("node").alias("kind"), F.col("id").cast("string").alias("id"), F.col("year").cast("string").alias("other"))
    return n.unionByName(edges.select(F.lit("edge").alias("kind"), F.col("src").cast("string").alias("id"), F.col("dst").cast("string").alias("other")))


@query("write_graph_json", """
SELECT 'node' AS type, CAST(id AS VARCHAR) AS a, title AS b FROM cite_nodes UNION ALL SELECT 'link', CAST(src AS VARCHAR), CAST(dst AS VARCHAR) FROM cites""")
def write_graph_json(t):
    path = scratch_dir(t.spark)
    sinks.write_graph_json(t("cite_nodes"), t("cites"), path)
    back = t.spark.read.schema("type string, id string, title string, source string, target string").json(path)
    return back.select("type", F.coalesce("id", "source").alias("a"), F.coalesce("title", "target").alias("b"))


@query("read_paper_documents", """
SELECT split_part(text, chr(10), 1) AS title, '' AS doi, 0 AS year, COUNT(*) AS n, CAST(SUM(len(string_split(text, chr(10)))) AS BIGINT) AS sections, 0 AS refs FROM documents GROUP BY 1""")
def read_paper_documents(t):
    path = scratch_dir(t.spark)
    section = F.transform(F.split("text", "\n"), lambda s: F.struct(F.lit("").alias("title"), F.lit(1).alias("level"), s.alias("content"), F.lit(1).alias("page_start")))
    sinks.write_paper_documents(t("documents").select(F.split_part("text", F.lit("\n"), F.lit(1)).alias("title"), F.array("lang").alias("authors"), section.alias("sections")), path)
    back = readers.read_paper_documents(t.spark, path)
    return back.groupBy("title").agg(
        F.max("doi").alias("doi"), F.max("year").alias("year"), F.count("*").alias("n"), F.sum(F.size("sections")).alias("sections"), F.max(F.size("references")).alias("refs"))


@query("write_paper_documents", "SELECT source, COUNT(*) AS n, CAST(SUM(length(text)) AS BIGINT) AS chars FROM documents GROUP BY source")
def write_paper_documents(t):
    path = scratch_dir(t.spark)
    sinks.write_paper_documents(t("documents").select(F.col("source").alias("domain"), F.col("text").alias("full_text")), path)
    return readers.read_paper_documents(t.spark, path).groupBy(F.col("domain").alias("source")).agg(F.count("*").alias("n"), F.sum(F.length("full_text")).alias("chars"))


@query("scan_source_tree", "SELECT source AS folder, CAST(SUM(length(replace(text, chr(10), ' '))) AS BIGINT) AS chars FROM documents WHERE source <> 'src3' GROUP BY source")
def scan_source_tree(t):
    path = scratch_dir(t.spark)
    folder = F.when(F.col("source") == "src3", "node_modules").otherwise(F.col("source"))
    t("documents").select(folder.alias("folder"), F.replace("text", F.lit("\n"), F.lit(" ")).alias("value")).write.partitionBy("folder").text(path)
    files = readers.scan_source_tree(t.spark, path, "*.txt").select(
        F.regexp_extract("path", "folder=([^/]+)", 1).alias("folder"), F.length(F.regexp_replace("content", "\n", "")).alias("chars"))
    return files.filter("folder <> 'node_modules'").groupBy("folder").agg(F.sum("chars").alias("chars"))


def _xml(c):
    return F.replace(F.replace(F.replace(c, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))


@query("read_feed_xml", r"""
SELECT (1000 + doc_id % 9000) || '.' || (10000 + doc_id) AS paper_id, trim(regexp_replace(split_part(text, chr(10), 1), '\s+', ' ', 'g')) AS title, CASE WHEN doc_id % 5 = 0 THEN 2024 ELSE CAST(2000 + doc_id % 25 AS INT) END AS year,
  CASE WHEN doc_id % 5 = 0 THEN 1 ELSE CAST(1 + doc_id % 12 AS INT) END AS month, lang || '|' || source AS categories, 'http://x.org/pdf/' || doc_id AS pdf_url FROM documents""")
def read_feed_xml(t):
    path = scratch_dir(t.spark)
    d = F.col("doc_id")
    k = d.cast("string")
    title = _xml(F.split_part("text", F.lit("\n"), F.lit(1)))
    published = F.when(d % 5 == 0, "unknown").otherwise(F.format_string("%04d-%02d-15T00:00:00Z", 2000 + d % 25, 1 + d % 12))
    line = F.concat(
        F.lit("<entry><id>http://x.org/abs/"), (1000 + d % 9000).cast("string"), F.lit("."), (10000 + d).cast("string"), F.lit("v1</id><title> "), title, F.lit(" </title><summary>"), _xml(F.col("source")),
        F.lit("</summary><published>"), published, F.lit("</published><author><name>A</name></author><author><name>B</name></author><category term=\""), F.col("lang"), F.lit("\"/><category term=\""), F.col("source"),
        F.lit("\"/><link href=\"http://x.org/abs\"/><link title=\"pdf\" href=\"http://x.org/pdf/"), k, F.lit("\"/></entry>"))
    t("documents").select(line.alias("value")).write.text(path)
    return readers.read_feed_xml(t.spark, path).select("paper_id", "title", "year", "month", F.array_join("categories", "|").alias("categories"), "pdf_url")


@query("read_article_xml", """
SELECT CAST(c_custkey AS VARCHAR) AS pubmed_id, c_name AS title, 'Fore ' || c_mktsegment AS author, CASE WHEN c_custkey % 3 = 0 THEN 2024 ELSE CAST(1990 + c_custkey % 30 AS INT) END AS year, CASE WHEN c_custkey % 2 = 0 THEN 3 ELSE 1 END AS month,
  'J' || c_nationkey AS journal, CASE WHEN c_custkey % 4 = 0 THEN '10.5/' || c_custkey ELSE '' END AS doi FROM customer""")
def read_article_xml(t):
    path = scratch_dir(t.spark)
    c = F.col("c_custkey")
    k = c.cast("string")
    year = F.when(c % 3 == 0, "").otherwise(F.concat(F.lit("<Year>"), (1990 + c % 30).cast("string"), F.lit("</Year>")))
    month = F.when(c % 2 == 0, "<Month>Mar</Month>").otherwise("")
    doi = F.when(c % 4 == 0, F.concat(F.lit('<ArticleId IdType="doi">10.5/'), k, F.lit("</ArticleId>"))).otherwise("")
    line = F.concat(
        F.lit("<PubmedArticle><MedlineCitation><PMID>"), k, F.lit("</PMID><Article><Journal><JournalIssue><PubDate>"), year, month, F.lit("</PubDate></JournalIssue><Title>J"), F.col("c_nationkey").cast("string"),
        F.lit("</Title></Journal><ArticleTitle>"), F.col("c_name"), F.lit("</ArticleTitle><AuthorList><Author><LastName>"), F.col("c_mktsegment"), F.lit("</LastName><ForeName>Fore</ForeName></Author></AuthorList></Article></MedlineCitation><PubmedData><ArticleIdList><ArticleId IdType=\"pubmed\">"),
        k, F.lit("</ArticleId>"), doi, F.lit("</ArticleIdList></PubmedData></PubmedArticle>"))
    t("customer").select(line.alias("value")).write.text(path)
    return readers.read_article_xml(t.spark, path).select("pubmed_id", "title", F.get("authors", F.lit(0)).alias("author"), "year", "month", "journal", "doi")


@query("import_records_csv_env", """
WITH k AS (SELECT CASE WHEN c_custkey % 9 = 0 THEN '' ELSE CASE c_custkey % 3 WHEN 0 THEN 'sk-ant-' WHEN 1 THEN 'ghp_' ELSE 'zz' END || c_custkey % 200 END AS key, CASE WHEN c_nationkey = 3 THEN 'openai' END AS named FROM customer),
p AS (SELECT key, coalesce(named, CASE WHEN starts_with(key, 'sk-ant') THEN 'anthropic' WHEN starts_with(key, 'ghp_') THEN 'github' ELSE 'custom' END) AS provider FROM k)
SELECT 'csv' AS source, provider, COUNT(*) FILTER (key <> '') AS imported, COUNT(*) FILTER (key = '') AS skipped, COUNT(DISTINCT CASE WHEN key <> '' THEN key END) AS distinct_keys FROM p GROUP BY provider
UNION ALL SELECT 'env', CASE s_suppkey % 2 WHEN 0 THEN 'openai' ELSE 'groq' END, COUNT(*), 0, COUNT(*) FROM supplier GROUP BY 2""")
def import_records_csv_env(t):
    csv, env = scratch_dir(t.spark), scratch_dir(t.spark)
    c = F.col("c_custkey")
    prefix = F.when(c % 3 == 0, "sk-ant-").when(c % 3 == 1, "ghp_").otherwise("zz")
    key = F.when(c % 9 == 0, "").otherwise(F.concat(prefix, (c % 200).cast("string")))
    t("customer").select(F.col("c_name").alias("Title"), key.alias("Password"), F.lit("").alias("URL"), F.when(F.col("c_nationkey") == 3, "my GPT key").otherwise("").alias("Notes")).write.option("header", True).csv(csv)
    s = F.col("s_suppkey")
    line = F.concat(F.lit("API_KEY_"), s.cast("string"), F.lit('="'), F.when(s % 2 == 0, "sk-").otherwise("gsk_"), s.cast("string"), F.lit('"'))
    t("supplier").select(F.explode(F.array(F.lit("# comment"), line)).alias("value")).write.text(env)
    both = readers.read_key_csv(t.spark, csv).withColumn("source", F.lit("csv")).unionByName(readers.read_dotenv(t.spark, env).withColumn("source", F.lit("env")))
    return both.groupBy("source", "provider").agg(
        F.count_if(~F.col("skipped")).alias("imported"), F.count_if("skipped").alias("skipped"), F.count_distinct(F.when(~F.col("skipped"), F.col("key"))).alias("distinct_keys"))


@query("experiment_tables", "SELECT experiment, COUNT(DISTINCT run_id) AS runs, COUNT(*) AS entries FROM metrics JOIN runs USING (run_id) WHERE status <> 'failed' GROUP BY experiment")
def experiment_tables(t):
    root = scratch_dir(t.spark)
    m = t("metrics").join(t("runs").select("run_id", "experiment"), "run_id")
    sinks.write_table(m, f"{root}/metrics", ["experiment"], ["run_id", "metric_name"])
    sinks.write_table(t("runs"), f"{root}/runs")
    failed = t.spark.read.parquet(f"{root}/runs").filter("status = 'failed'").select("run_id")
    left = sinks.delete_rows(t.spark.read.parquet(f"{root}/metrics"), failed, ["run_id"])
    return left.groupBy(F.col("experiment").cast("bigint").alias("experiment")).agg(F.count_distinct("run_id").alias("runs"), F.count("*").alias("entries"))


@query("integration_tables", """
SELECT 'integrations' AS name, 'rows' AS rule, COUNT(*) AS n FROM orders
UNION ALL SELECT 'integrations', 'status is no literal', COUNT(*) FILTER (o_orderstatus = 'P') FROM orders HAVING COUNT(*) FILTER (o_orderstatus = 'P') > 0
UNION ALL SELECT 'validation_runs', 'rows', COUNT(*) FROM lineitem
UNION ALL SELECT 'validation_runs', 'passed is null', COUNT(*) FROM lineitem WHERE l_returnflag = 'N' HAVING COUNT(*) > 0
UNION ALL SELECT 'approvals', 'rows', COUNT(*) FROM lineitem
UNION ALL SELECT 'approvals', 'action is no literal', COUNT(*) FROM lineitem WHERE l_returnflag = 'N' HAVING COUNT(*) > 0
UNION ALL SELECT 'integration_logs', 'rows', COUNT(*) FROM events
UNION ALL SELECT 'paper_library', 'rows', COUNT(*) FROM documents
UNION ALL SELECT 'paper_library', 'paper_title is null', COUNT(*) FROM documents WHERE split_part(text, chr(10), 1) = '' OR text IS NULL HAVING COUNT(*) > 0
UNION ALL SELECT 'session_history', 'rows', COUNT(*) FROM conversations
UNION ALL SELECT 'session_history', 'duration is null', COUNT(*) FROM conversations WHERE turn = 0 HAVING COUNT(*) > 0""")
def integration_tables(t):
    c, text = F.col, lambda name: F.col(name).cast("string")
    flag = c("l_returnflag")
    start = F.lit(AS_OF).cast("timestamp_ntz")
    rows = {
        "integrations": t("orders").select(
            text("o_orderkey").alias("integration_id"), F.lit("").alias("repo_url"), F.when(c("o_orderstatus") == "F", "completed").when(c("o_orderstatus") == "O", "pending").otherwise("other").alias("status"),
            F.when(c("o_custkey") % 2 == 0, "autonomous").otherwise("step_approval").alias("mode"), (c("o_custkey") % 6).alias("current_phase"), c("o_orderdate").alias("created_at"),
            c("o_orderdate").alias("updated_at"), F.lit(0).alias("retry_count")),
        "validation_runs": t("lineitem").select(
            text("l_orderkey").alias("integration_id"), F.create_map(F.lit("loss"), c("l_tax")).alias("new_metrics"), F.when(flag == "A", True).when(flag == "R", False).alias("passed"), F.lit("").alias("logs"), c("l_shipdate").alias("created_at")),
        "approvals": t("lineitem").select(
            text("l_orderkey").alias("integration_id"), c("l_linenumber").alias("phase"), F.when(flag == "A", "approved").when(flag == "R", "rejected").otherwise("open").alias("action"), c("l_shipdate").alias("created_at")),
        "integration_logs": t("events").select(text("user_id").alias("integration_id"), c("event_type").alias("message"), "ts"),
        "paper_library": t("documents").select(
            text("doc_id").alias("paper_id"), F.nullif(F.split_part("text", F.lit("\n"), F.lit(1)), F.lit("")).alias("paper_title"), start.alias("analysis_date"), F.lit(0).alias("integration_count"), start.alias("last_used")),
        "session_history": t("conversations").select(
            text("conv_id").alias("integration_id"), c("role").alias("action"), F.lit("done").alias("status"), F.lit("").alias("repo_path"), F.nullif(c("turn"), F.lit(0)).alias("duration"), start.alias("created_at")),
    }
    out = None
    for name, part in rows.items():
        path = scratch_dir(t.spark)
        sinks.write_table(tables.conform(part, name), path, *tables.LAYOUT[name])
        back = t.spark.read.parquet(path)
        found = tables.contract_violations(back, name).select(F.lit(name).alias("name"), "rule", "n")
        out = found if out is None else out.unionByName(found)
    return out


@query("report_sinks", "SELECT '| ' || l_returnflag || ' | ' || COUNT(*) || ' |' AS value FROM lineitem GROUP BY l_returnflag")
def report_sinks(t):
    path = scratch_dir(t.spark)
    sinks.write_report(t("lineitem").groupBy("l_returnflag").agg(F.count("*").alias("n")), path)
    return t.spark.read.text(f"{path}/markdown")


@query("prometheus_text_sink", """
SELECT 'requests_total{endpoint="' || endpoint || '",provider="' || provider || '"} ' || COUNT(*) AS value FROM usage GROUP BY provider, endpoint UNION ALL SELECT 'errors_total ' || COUNT(*) FROM usage WHERE status = 'error'""")
def prometheus_text_sink(t):
    u = t("usage")
    labelled = u.groupBy("provider", "endpoint").agg(F.count("*").alias("value")).select(
        F.lit("requests_total").alias("name"), F.create_map(F.lit("provider"), F.col("provider"), F.lit("endpoint"), F.col("endpoint")).alias("labels"), "value")
    errors = u.agg(F.count_if(F.col("status") == "error").alias("value")).select(F.lit("errors_total").alias("name"), F.create_map().cast("map<string,string>").alias("labels"), "value")
    path = scratch_dir(t.spark)
    sinks.prometheus_lines(labelled.unionByName(errors)).write.text(path)
    return t.spark.read.text(path)


@query("ttl_result_table", f"""
WITH r AS (SELECT substring(sha256(concat_ws('|', source, CAST(doc_id % 300 AS VARCHAR))), 1, 32) AS k, doc_id, text, CASE WHEN doc_id % 4 = 0 THEN NULL ELSE TIMESTAMP '{AS_OF}' + to_days(CAST(doc_id % 20 AS INT) - 10) END AS x FROM documents),
l AS (SELECT * FROM r QUALIFY row_number() OVER (PARTITION BY k ORDER BY doc_id DESC) = 1)
SELECT COUNT(*) AS entries, CAST(SUM(length(text)) AS BIGINT) AS total_bytes FROM l WHERE x IS NULL OR x >= TIMESTAMP '{AS_OF}'""")
def ttl_result_table(t):
    from citeloom.operators.sets import upsert_last_wins

    d = F.col("doc_id")
    expires = F.when(d % 4 != 0, R.instant(AS_OF) + F.make_dt_interval((d % 20).cast("int") - 10))
    rows = t("documents").select(sinks.result_key(F.col("source"), d % 300).alias("key"), d.alias("version"), expires.alias("expires_at"), F.col("text").alias("payload"))
    stored = upsert_last_wins(rows.filter("version % 2 = 0"), rows.filter("version % 2 = 1"), "key", "version")
    return sinks.result_stats(sinks.live_results(stored, R.instant(AS_OF)))
