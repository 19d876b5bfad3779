"""Filters, predicates and rule scans over whole tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from citeloom.functions import constants as K
from citeloom.operators import rules as R

from .registry import query
from .scalar_plans import _in
from .views import AS_OF

NOW = f"TIMESTAMP '{AS_OF}'"


@query("time_window_filter", f"""
SELECT event_id, provider, key_id FROM usage WHERE ts >= {NOW} - INTERVAL 7 DAY AND provider = 'openai'""")
def time_window_filter(t):
    return R.time_window_filter(t("usage"), AS_OF, 7, provider="openai").select("event_id", "provider", "key_id")


@query("log_filter", "SELECT conv_id, turn FROM conversations WHERE role = 'user' AND contains(lower(text), 'the ')")
def log_filter(t):
    return R.log_filter(t("conversations"), "role", "text", "user", "The ").select("conv_id", "turn")


@query("retention_filter", f"""
SELECT 'usage' AS log, COUNT(*) AS kept FROM usage WHERE ts >= {NOW} - INTERVAL 20 DAY
UNION ALL SELECT 'audit', COUNT(*) FROM audit WHERE ts > {NOW} - INTERVAL 10 DAY""")
def retention_filter(t):
    usage = R.retention_filter(t("usage"), AS_OF, 20).agg(F.count("*").alias("kept")).select(F.lit("usage").alias("log"), "kept")
    audit = R.retention_filter(t("audit"), AS_OF, 10, strict=True).agg(F.count("*").alias("kept")).select(F.lit("audit").alias("log"), "kept")
    return usage.unionByName(audit)


@query("expired_filter", f"SELECT id, coalesce(expires_at < {NOW}, false) AS expired FROM memories")
def expired_filter(t):
    return t("memories").select("id", R.is_expired(F.col("expires_at").cast("string"), AS_OF).alias("expired"))


_PATH_SQL = """CASE l_linenumber WHEN 1 THEN 'src/' WHEN 2 THEN 'node_modules/' WHEN 3 THEN 'tests/' WHEN 4 THEN 'app/generated/' WHEN 5 THEN 'build/' ELSE 'lib/' END
  || CASE CAST(l_quantity AS INT) % 6 WHEN 0 THEN 'main.py' WHEN 1 THEN 'test_' || l_partkey || '.py' WHEN 2 THEN 'a' || l_partkey || '.min.js'
     WHEN 3 THEN 'index.ts' WHEN 4 THEN 'x' || l_partkey || '.spec.ts' ELSE 'mod' || l_partkey || '.go' END"""


def _paths(t):
    q, n, p = F.col("l_quantity").cast("int") % 6, F.col("l_linenumber"), F.col("l_partkey").cast("string")
    folder = (F.when(n == 1, "src/").when(n == 2, "node_modules/").when(n == 3, "tests/").when(n == 4, "app/generated/")
              .when(n == 5, "build/").otherwise("lib/"))
    name = (F.when(q == 0, "main.py").when(q == 1, F.concat(F.lit("test_"), p, F.lit(".py")))
            .when(q == 2, F.concat(F.lit("a"), p, F.lit(".min.js"))).when(q == 3, "index.ts")
            .when(q == 4, F.concat(F.lit("x"), p, F.lit(".spec.ts"))).otherwise(F.concat(F.lit("mod"), p, F.lit(".go"))))
    return t("lineitem").select(F.concat(folder, name).alias("path"))


@query("ignore_path_filter", f"""
WITH paths AS (SELECT {_PATH_SQL} AS path FROM lineitem)
SELECT path, COUNT(*) AS n FROM paths
WHERE NOT (list_has_any(string_split(path, '/'), [{_in(K.IGNORED_DIRS)}]) OR {" OR ".join(f"contains(path, '{p}')" for p in K.IGNORED_PARTS)})
GROUP BY path""")
def ignore_path_filter(t):
    return _paths(t).filter(~R.is_ignored_path(F.col("path"))).groupBy("path").agg(F.count("*").alias("n"))


@query("entry_test_file_filter", f"""
WITH paths AS (SELECT DISTINCT {_PATH_SQL} AS path FROM lineitem)
SELECT path, string_split(path, '/')[-1] IN ({_in(K.ENTRY_FILES)}) AS entry_point, regexp_matches(path, '{K.TEST_FILE}') AS test_file
FROM paths WHERE string_split(path, '/')[-1] IN ({_in(K.ENTRY_FILES)}) OR regexp_matches(path, '{K.TEST_FILE}')""")
def entry_test_file_filter(t):
    path = F.col("path")
    flagged = _paths(t).select("path", R.is_entry_point(path).alias("entry_point"), R.is_test_file(path).alias("test_file"))
    return flagged.filter("entry_point OR test_file").distinct()


# Rules that occur in prose and pages, beside the fixed code rules.
TEXT_RULES = [
    ("secret", r"(?i)(token|key|password|secret)\s*=", "error", "Assigned secret"),
    ("ip_address", r"\b\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3}\b", "warning", "IP address"),
    ("email", r"[A-Za-z0-9._]+@[A-Za-z0-9.]+\.[a-z]+", "warning", "E-mail address"),
    ("long_number", r"\b\d{13,19}\b", "warning", "Card-like number"),
    ("license", r"(?i)license|copyright", "info", "License text"),
]


def _esc(p: str) -> str:
    return p.replace("'", "''")


def _scan_sql(table: str, key: str, text: str, rules) -> str:
    return " UNION ALL ".join(
        f"SELECT {key}, '{rule}' AS rule, '{sev}' AS severity FROM {table} WHERE regexp_matches({text}, '{_esc(p)}')"
        for rule, p, sev, _ in rules)


@query("rule_scan_findings", _scan_sql("documents", "doc_id", "text", [*TEXT_RULES, *K.SECURITY_RULES, *K.ANTIPATTERN_RULES]))
def rule_scan_findings(t):
    rules = [*TEXT_RULES, *K.SECURITY_RULES, *K.ANTIPATTERN_RULES]
    return R.rule_findings(t("documents"), ["doc_id"], "text", rules).select("doc_id", "rule", "severity")


WEB_RULES = {"markup": [r"<script", r"onclick\s*=", r"<iframe"]}


@query("categorized_rule_scan", f"""
WITH c AS (SELECT page_id, CAST({" + ".join(f"CAST(regexp_matches(html, '(?i){_esc(p)}') AS INT)" for p in K.DESTRUCTIVE_RULES)} AS INT) AS destructive,
  CAST({" + ".join(f"CAST(regexp_matches(html, '(?i){_esc(p)}') AS INT)" for p in K.ESCAPE_RULES)} AS INT) AS escape_hits,
  CAST({" + ".join(f"CAST(regexp_matches(html, '(?i){_esc(p)}') AS INT)" for p in WEB_RULES["markup"])} AS INT) AS markup FROM pages)
SELECT page_id, destructive, escape_hits, markup, destructive = 0 AND escape_hits = 0 AND markup = 0 AS safe FROM c""")
def categorized_rule_scan(t):
    return R.rule_counts(t("pages"), ["page_id"], "html", {
        "destructive": K.DESTRUCTIVE_RULES, "escape_hits": K.ESCAPE_RULES, "markup": WEB_RULES["markup"]})


def _cnt(c: str, text: str) -> str:
    return f"(length({text}) - length(replace({text}, '{c}', '')))"


@query("bracket_balance", f"""
SELECT page_id, concat_ws(',', {", ".join(f"CASE WHEN {_cnt(a, 'html')} <> {_cnt(b, 'html')} THEN '{n}' END" for n, a, b in (("parentheses", "(", ")"), ("square", "[", "]"), ("curly", "{", "}")))}) AS issues
FROM pages""")
def bracket_balance(t):
    return t("pages").select("page_id", F.array_join(R.bracket_issues(F.col("html")), ",").alias("issues"))


@query("import_whitelist_check", f"""
WITH m AS (SELECT file, regexp_extract(content, '^(?:import|from)\\s+(\\S+)', 1) AS module FROM code_lines WHERE regexp_matches(content, '^(import\\s+\\S+|from\\s+\\S+\\s+import)')),
r AS (SELECT *, split_part(module, '.', 1) AS root FROM m)
SELECT module, COUNT(*) AS n_files FROM r WHERE root NOT IN ({_in(K.KNOWN_MODULES)})
  AND root NOT IN (SELECT 'pkg' || s_suppkey FROM supplier WHERE s_acctbal > 5000) GROUP BY module""")
def import_whitelist_check(t):
    roots = t("supplier").filter("s_acctbal > 5000").select(F.concat(F.lit("pkg"), F.col("s_suppkey").cast("string")).alias("root"))
    return R.unknown_imports(t("code_lines"), repo_roots=roots).groupBy("module").agg(F.count("*").alias("n_files"))


@query("line_grep", """
WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS line_no FROM documents)
SELECT doc_id, CAST(line_no AS INT) AS line_no, trim(line) AS content FROM l WHERE contains(lower(line), 'token')""")
def line_grep(t):
    return R.line_grep(t("documents"), ["doc_id"], "text", "Token")


_TAGS = " UNION ALL ".join(
    f"SELECT l, '{bucket}' AS tag FROM e WHERE regexp_matches(n, '{'|'.join(words)}')" for bucket, words in K.NAME_PATTERNS)


@query("name_pattern_tags", f"""
WITH e AS (SELECT file || ':' || line_no AS l, lower(content) AS n FROM code_lines WHERE NOT starts_with(content, 'import'))
SELECT tag, COUNT(*) AS n, COUNT(DISTINCT l) AS n_locations FROM ({_TAGS}) GROUP BY tag""")
def name_pattern_tags(t):
    e = t("code_lines").filter("NOT startswith(content, 'import')")
    tagged = e.select(F.concat("file", F.lit(":"), F.col("line_no").cast("string")).alias("l"), F.explode(R.name_tags(F.col("content"))).alias("tag"))
    return tagged.groupBy("tag").agg(F.count("*").alias("n"), F.count_distinct("l").alias("n_locations"))


@query("quality_gates", f"""
WITH g AS (SELECT o_orderkey AS id, COUNT(l_orderkey) AS target_count, MAX(l_quantity) * 2 AS confidence, MAX(CASE WHEN l_returnflag = 'A' THEN 1 + l_discount - 0.06 END) AS speedup,
    MAX(CASE WHEN l_returnflag = 'R' THEN l_tax * 100 - 2 END) AS loss_change
  FROM orders LEFT JOIN lineitem ON o_orderkey = l_orderkey GROUP BY o_orderkey),
c AS (SELECT id, 'mapping_target_count' AS name, CASE WHEN target_count >= {K.GATE_MIN_TARGETS} THEN 'pass' ELSE 'fail' END AS status FROM g
  UNION ALL SELECT id, 'mapping_confidence', 'warn' FROM g
  UNION ALL SELECT id, 'validation_speedup', CASE WHEN speedup >= {K.GATE_MIN_SPEEDUP} THEN 'pass' ELSE 'warn' END FROM g WHERE speedup IS NOT NULL
  UNION ALL SELECT id, 'validation_abs_loss_change_pct', CASE WHEN abs(loss_change) <= {K.GATE_MAX_LOSS_CHANGE} THEN 'pass' ELSE 'warn' END FROM g WHERE loss_change IS NOT NULL)
SELECT id, name, status, CASE WHEN bool_or(status = 'fail') OVER (PARTITION BY id) THEN 'fail' ELSE 'pass' END AS summary FROM c""")
def quality_gates(t):
    li = t("lineitem").groupBy(F.col("l_orderkey").alias("id")).agg(
        F.count("*").alias("target_count"), (F.max("l_quantity") * 2).alias("confidence"),
        F.max(F.when(F.col("l_returnflag") == "A", 1 + F.col("l_discount") - 0.06)).alias("speedup"),
        F.max(F.when(F.col("l_returnflag") == "R", F.col("l_tax") * 100 - 2)).alias("loss_change"))
    g = t("orders").select(F.col("o_orderkey").alias("id")).join(li, "id", "left").fillna(0, ["target_count"])
    return R.quality_gates(g, "id").select("id", "name", "status", "summary")


@query("payload_contract_check", """
WITH tk AS (SELECT CASE WHEN o_orderstatus = 'P' AND o_orderkey % 2 = 1 THEN o_orderkey - 1 ELSE o_orderkey END AS k FROM orders),
ids AS (SELECT 'o' || k AS id FROM tk)
SELECT id, 'duplicate_id' AS issue, CAST(NULL AS VARCHAR) AS dep FROM ids GROUP BY id HAVING COUNT(*) > 1
UNION ALL SELECT id, 'self_dependency', dep FROM task_deps WHERE id = dep
UNION ALL SELECT id, 'unknown_dependency', dep FROM task_deps WHERE dep NOT IN (SELECT id FROM ids)""")
def payload_contract_check(t):
    k = F.when((F.col("o_orderstatus") == "P") & (F.col("o_orderkey") % 2 == 1), F.col("o_orderkey") - 1).otherwise(F.col("o_orderkey"))
    ids = t("orders").select(F.concat(F.lit("o"), k.cast("string")).alias("id"))
    return R.task_contract(ids, t("task_deps"))


@query("expiring_window", f"""
SELECT key_id, coalesce(is_active AND expires_at <= {NOW} + INTERVAL 7 DAY, false) AS expiring_soon,
  created_at < {NOW} - INTERVAL 90 DAY AS too_old, is_active AND coalesce({NOW} > expires_at, false) AS deactivated,
  CASE WHEN is_active AND coalesce({NOW} > expires_at, false) THEN 'key_expired' END AS audit_event
FROM credentials""")
def expiring_window(t):
    return R.expiring_window(t("credentials"), AS_OF, 7, 90).select(
        "key_id", "expiring_soon", "too_old", "deactivated", "audit_event")
