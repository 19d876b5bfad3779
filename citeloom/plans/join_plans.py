"""Join families over whole tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from citeloom.functions import constants as K
from citeloom.operators import joins as J

from .registry import query
from .views import AS_OF

NOW = f"TIMESTAMP '{AS_OF}'"
PATTERNS = ["red widget", "small ring", "class ECONOMY", "widget", "STANDARD", "nn.gelu", "fn_1", "x1", "numpy.linalg", "django.db"]


@query("baseline_equi_join", """
WITH base AS (SELECT metric_name, value AS base FROM final_metrics_sql WHERE run_id = (SELECT MIN(user_id) FROM events)),
j AS (SELECT f.*, coalesce(base, 0.0) AS base FROM final_metrics_sql f LEFT JOIN base USING (metric_name))
SELECT run_id, metric_name, value, value - base AS delta, CASE WHEN base <> 0 THEN (value - base) / abs(base) * 100 ELSE 0.0 END AS pct_change FROM j""")
def baseline_equi_join(t):
    from citeloom.operators.ranking import final_metrics

    first = t("events").agg(F.min("user_id")).first()[0]
    return J.baseline_deltas(final_metrics(t("metrics")), first)


_RANK = "CASE {0} " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in K.STATUS_RANK.items()) + " ELSE -1 END"


@query("snapshot_full_outer", f"""
WITH j AS (SELECT coalesce(b.id, c.id) AS id, b.id IS NULL AS nb, c.id IS NULL AS nc, b.score AS base_score, c.score AS cur_score,
  b.status AS base_status, c.status AS cur_status, round(c.score - b.score, 4) AS delta
  FROM results_base b FULL OUTER JOIN results_cur c ON b.id = c.id)
SELECT id, base_score, cur_score, base_status, cur_status, delta,
  CASE WHEN nb THEN 'added' WHEN nc THEN 'removed' WHEN {_RANK.format('cur_status')} < {_RANK.format('base_status')} THEN 'regression'
    WHEN abs(delta) < 1e-9 THEN 'unchanged' WHEN delta < 0 AND abs(delta) < 0.1 THEN 'unchanged' WHEN delta < 0 THEN 'regression' ELSE 'improvement' END AS direction
FROM j""")
def snapshot_full_outer(t):
    return J.snapshot_diff(t("results_base"), t("results_cur"))


def _norm(x: str) -> str:
    return f"trim(replace(replace(lower({x}), 'class ', ''), 'self.', ''))"


def _fuzzy_sql(name: str, p: str) -> str:
    forms = [J._normal_py(p), *map(J._normal_py, K.PATTERN_ALIASES.get(J._normal_py(p), []))]
    return "(" + " OR ".join(f"contains({_norm(name)}, '{f}') OR contains('{f}', {_norm(name)})" for f in forms) + ")"


_TIERS = []
for _pos, _p in enumerate(PATTERNS):
    _TIERS += [
        f"SELECT file, line, 1 AS tier, {_pos} AS pos, 'exact' AS match_tier, '{_p}' AS pattern FROM elements WHERE name = '{_p}' OR 'class ' || name = '{_p}'",
        f"SELECT file, line, 2, {_pos}, 'fuzzy_name', '{_p}' FROM elements WHERE {_fuzzy_sql('name', _p)}",
        f"SELECT file, line, 2, {_pos}, 'fuzzy_snippet', '{_p}' FROM elements WHERE NOT {_fuzzy_sql('name', _p)} AND contains(lower(snippet), '{_p.lower()}')",
        f"SELECT file, line, 3, {_pos}, 'import', '{_p}' FROM elements WHERE contains(lower(module), '{_p.lower()}')",
    ]


_USAGE = [p for p in PATTERNS if "." in p]


@query("tiered_theta_match", f"""
WITH RECURSIVE hits AS ({" UNION ALL ".join(_TIERS)}),
ranked AS (SELECT *, row_number() OVER (PARTITION BY file, line ORDER BY tier, pos, match_tier) AS rn FROM hits),
direct AS (SELECT file, line, match_tier, pattern FROM ranked WHERE rn = 1),
scan AS (SELECT l.file, l.line_no::BIGINT AS line, p.pos, p.pattern FROM code_lines l JOIN (SELECT unnest({list(range(len(_USAGE)))}) AS pos, unnest({_USAGE}) AS pattern) p ON contains(l.content, p.pattern)
  WHERE l.file IN (SELECT file FROM scan_elements) AND p.pattern NOT IN (SELECT pattern FROM direct) AND NOT EXISTS (SELECT 1 FROM direct d WHERE d.file = l.file AND d.line = l.line_no)),
o AS (SELECT *, row_number() OVER (ORDER BY file, line, pos) AS n FROM (SELECT DISTINCT * FROM scan)),
w AS (SELECT 0::BIGINT AS n, NULL::VARCHAR AS file, NULL::BIGINT AS line, NULL::VARCHAR AS pattern, []::VARCHAR[] AS pats, []::VARCHAR[] AS spots, false AS took
  UNION ALL SELECT o.n, o.file, o.line, o.pattern, CASE WHEN free THEN list_append(pats, o.pattern) ELSE pats END, CASE WHEN free THEN list_append(spots, o.file || ':' || o.line) ELSE spots END, free
  FROM (SELECT w.n AS k, w.pats, w.spots FROM w) w JOIN (SELECT * FROM o) o ON o.n = w.k + 1, LATERAL (SELECT NOT list_contains(w.pats, o.pattern) AND NOT list_contains(w.spots, o.file || ':' || o.line) AS free) x WHERE len(w.pats) < {len(_USAGE)})
SELECT * FROM direct UNION ALL SELECT file, line, 'text_scan', pattern FROM w WHERE took""".replace("FROM elements", "FROM scan_elements"))
def tiered_theta_match(t):
    e = t("scan_elements")
    lines = t("code_lines").select("file", F.col("line_no").cast("bigint").alias("line"), "content")
    return J.tiered_match(e, e, lines, PATTERNS)


@query("legacy_tier_match", """
SELECT 'm' || s_nationkey || '.py' AS file, 1::BIGINT AS line, 'legacy_architecture' AS match_tier, p AS pattern
FROM supplier, (SELECT unnest(['SUPPLIER#0', 'supplier#00']) AS p) WHERE contains(lower(s_name), lower(p))""")
def legacy_tier_match(t):
    e = t("scan_elements")
    lines = t("code_lines").select("file", F.col("line_no").cast("bigint").alias("line"), "content")
    components = t("supplier").select(F.concat(F.lit("m"), F.col("s_nationkey").cast("string"), F.lit(".py")).alias("file"), F.lit("norm").alias("kind"), F.col("s_name").alias("value"))
    return J.tiered_match(e, e, lines, ["SUPPLIER#0", "supplier#00"], components)


@query("alias_fuzzy_join", " UNION ALL ".join(
    f"SELECT line, name, '{p}' AS pattern FROM elements WHERE {_fuzzy_sql('name', p)}" for p in PATTERNS))
def alias_fuzzy_join(t):
    return J.alias_matches(t("elements"), ["line"], PATTERNS)


_KW = ", ".join(f"({kpos}, {spos}, '{key}', '{spec}')" for kpos, (key, specs) in enumerate(K.KEYWORD_SPECS) for spos, spec in enumerate(specs))


@query("keyword_lookup_join", f"""
WITH kw(kpos, spos, keyword, spec) AS (VALUES {_KW}),
h AS (SELECT row_id, spec, keyword, row_number() OVER (PARTITION BY row_id, spec ORDER BY kpos, spos) AS rn
  FROM (SELECT DISTINCT row_id, content FROM code_lines WHERE starts_with(content, 'class')) c JOIN kw ON contains(lower(content), keyword))
SELECT row_id, spec, 'Matches ''' || keyword || ''' pattern' AS reason FROM h WHERE rn = 1""")
def keyword_lookup_join(t):
    classes = t("code_lines").filter("startswith(content, 'class')")
    return J.keyword_specs(classes, ["row_id"], F.col("content"))


# The two parts cited most often (ties to the smaller key) stand for "two papers".
_TOP2 = "(SELECT dst AS id, COUNT(*) AS n FROM cites GROUP BY dst ORDER BY n DESC, id LIMIT 2)"
_LINKING2 = "(SELECT src AS id, COUNT(*) AS n FROM part_suppliers GROUP BY src ORDER BY n DESC, id LIMIT 2)"


def _top(edges, col, k):
    return edges.groupBy(F.col(col).alias("id")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "id").limit(k)


@query("common_ancestors", f"""
SELECT src AS id FROM part_suppliers WHERE dst IN (SELECT id FROM (SELECT dst AS id, COUNT(*) AS n FROM part_suppliers GROUP BY dst ORDER BY n DESC, id LIMIT 2))
GROUP BY src HAVING COUNT(DISTINCT dst) = 2""")
def common_ancestors(t):
    e = t("part_suppliers")
    a, b = (r.id for r in _top(e, "dst", 2).collect())
    return J.common_neighbours(e, a, b, "citations")


@query("common_descendants", f"""
SELECT dst AS id FROM part_suppliers WHERE src IN (SELECT id FROM {_LINKING2}) GROUP BY dst HAVING COUNT(DISTINCT src) = 2""")
def common_descendants(t):
    e = t("part_suppliers")
    a, b = (r.id for r in _top(e, "src", 2).collect())
    return J.common_neighbours(e, a, b)


@query("coupling_self_join", """
WITH seeds AS (SELECT dst AS seed FROM cites GROUP BY dst ORDER BY COUNT(*) DESC, dst LIMIT 10),
both_ways AS (
  SELECT s.seed, b.src AS id FROM seeds s JOIN cites a ON a.src = s.seed JOIN cites b ON b.dst = a.dst WHERE b.src <> s.seed
  UNION ALL SELECT s.seed, b.dst FROM seeds s JOIN cites a ON a.dst = s.seed JOIN cites b ON b.src = a.src WHERE b.dst <> s.seed),
sc AS (SELECT seed, id, COUNT(*) AS score FROM both_ways GROUP BY seed, id),
r AS (SELECT *, row_number() OVER (PARTITION BY seed ORDER BY score DESC, id) AS rank FROM sc)
SELECT seed, id, score, CAST(rank AS INT) AS rank FROM r WHERE rank <= 10""")
def coupling_self_join(t):
    e = t("cites")
    return J.related_papers(e, _top(e, "dst", 10).select("id"), 10)


_ITEMS = """items AS (SELECT DISTINCT repo_id, 'pattern' AS kind, pattern AS item, 0.5 AS w FROM profiles
  UNION ALL SELECT DISTINCT repo_id, 'framework', lower(framework), 0.3 FROM profiles
  UNION ALL SELECT DISTINCT repo_id, 'language', lower(language), 0.2 FROM profiles),
sz AS (SELECT repo_id, kind, COUNT(*) AS n FROM items GROUP BY repo_id, kind),
inter AS (SELECT a.repo_id AS a, b.repo_id AS b, a.kind, a.w, COUNT(*) AS m FROM items a JOIN items b ON a.kind = b.kind AND a.item = b.item AND a.repo_id < b.repo_id GROUP BY ALL),
sim AS (SELECT i.a, i.b, round(SUM(w * m / (x.n + y.n - m)), 4) AS similarity FROM inter i JOIN sz x ON x.repo_id = i.a AND x.kind = i.kind JOIN sz y ON y.repo_id = i.b AND y.kind = i.kind GROUP BY i.a, i.b)"""


@query("pairwise_jaccard", f"WITH {_ITEMS} SELECT x.n_nationkey AS a, y.n_nationkey AS b, coalesce(similarity, 0) AS similarity FROM nation x JOIN nation y ON x.n_nationkey < y.n_nationkey LEFT JOIN sim ON a = x.n_nationkey AND b = y.n_nationkey WHERE x.n_nationkey IN (SELECT repo_id FROM profiles) AND y.n_nationkey IN (SELECT repo_id FROM profiles)")
def pairwise_jaccard(t):
    return J.pairwise_similarity(t("profiles"), zero_pairs=True)


@query("pairwise_jaccard_threshold", f"WITH {_ITEMS} SELECT a, b, similarity FROM sim WHERE similarity >= 0.62")
def pairwise_jaccard_threshold(t):
    return J.pairwise_similarity(t("profiles"), 0.62)


@query("anti_join_exclude", """
SELECT paper_id FROM papers WHERE paper_id NOT IN (SELECT doc_id FROM labels WHERE quality = 1)""")
def anti_join_exclude(t):
    read = t("labels").filter("quality = 1").select(F.col("doc_id").alias("paper_id"))
    return t("papers").select("paper_id").join(read, "paper_id", "left_anti")


_TRANSFER = """
WITH it AS (SELECT DISTINCT repo_id, 'p' AS kind, pattern AS item FROM profiles UNION ALL SELECT DISTINCT repo_id, 'f', lower(framework) FROM profiles
  UNION ALL SELECT DISTINCT repo_id, 'l', lower(language) FROM profiles),
sz AS (SELECT repo_id, SUM(n_lines) AS n FROM profiles GROUP BY repo_id),
pairs AS (SELECT a.repo_id AS source, b.repo_id AS target, CASE WHEN least(a.n, b.n) / greatest(a.n, b.n) > 0.3 THEN 10 ELSE 0 END AS size_points FROM sz a JOIN sz b ON a.repo_id <> b.repo_id),
sh AS (SELECT a.repo_id AS source, b.repo_id AS target, a.kind, a.item FROM it a JOIN it b ON a.kind = b.kind AND a.item = b.item AND a.repo_id <> b.repo_id),
f AS (SELECT source, target, COUNT(*) FILTER (kind = 'l') AS nl, COUNT(*) FILTER (kind = 'f') AS nf, COUNT(*) FILTER (kind = 'p') AS np FROM sh GROUP BY source, target),
o AS (SELECT p.source, p.target, s.spec, s.category, CAST(least(100, least(30, coalesce(nl, 0) * 15) + least(30, coalesce(nf, 0) * 15)
    + CASE WHEN EXISTS (SELECT 1 FROM sh WHERE sh.source = p.source AND sh.target = p.target AND sh.kind = 'p' AND lower(sh.item) = s.category) THEN 20
      WHEN coalesce(np, 0) > 0 THEN 10 ELSE 0 END + size_points) AS BIGINT) AS confidence
  FROM pairs p LEFT JOIN f USING (source, target) JOIN suggestions s ON s.repo_id = p.source
  WHERE NOT EXISTS (SELECT 1 FROM suggestions x WHERE x.repo_id = p.target AND x.spec = s.spec)),
opp AS (SELECT * FROM o WHERE confidence >= 10)"""


@query("transfer_opportunities", _TRANSFER + " SELECT source, target, spec, category, confidence FROM opp")
def transfer_opportunities(t):
    return J.transfer_opportunities(t("profiles"), t("suggestions"))


@query("transfer_plans", _TRANSFER + """ SELECT source, target, COUNT(*) AS n_specs, CAST(round_even(AVG(confidence), 0) AS BIGINT) AS overall_score FROM opp GROUP BY source, target""")
def transfer_plans(t):
    return J.transfer_plans(J.transfer_opportunities(t("profiles"), t("suggestions")))


@query("asof_section_for_page", """
WITH pages_of AS (SELECT o_custkey AS doc, l_shipdate AS page, COUNT(*) AS n FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY ALL),
sections AS (SELECT o_custkey AS doc, o_orderdate AS start, MAX('S' || o_orderkey) AS title FROM orders GROUP BY ALL)
SELECT p.doc, p.page, p.n, coalesce(s.title, '') AS title FROM pages_of p ASOF LEFT JOIN sections s ON p.doc = s.doc AND p.page >= s.start""")
def asof_section_for_page(t):
    o = t("orders")
    pages = t("lineitem").join(o, F.col("l_orderkey") == F.col("o_orderkey")).groupBy(
        F.col("o_custkey").alias("doc"), F.col("l_shipdate").alias("page")).agg(F.count("*").alias("n"))
    sections = o.select(F.col("o_custkey").alias("doc"), F.col("o_orderdate").alias("start"),
                        F.concat(F.lit("S"), F.col("o_orderkey").cast("string")).alias("title"))
    return J.asof_join(pages, sections, "doc", "page", "start", "title").select("doc", "page", "n", "title")


_EQ = """eq AS (SELECT p_partkey AS pos, CASE p_size % 3 WHEN 0 THEN 'eq_' || p_partkey WHEN 1 THEN 'sec_a_' || p_partkey ELSE CAST(p_partkey AS VARCHAR) END AS eq_id FROM part),
refs AS (SELECT DISTINCT CASE WHEN l_linenumber = 1 THEN 'eq_' || l_partkey WHEN l_linenumber = 2 THEN 'x' || l_partkey ELSE CAST(l_partkey AS VARCHAR) END AS ref FROM lineitem)"""


def _equations(t):
    s, p = F.col("p_size") % 3, F.col("p_partkey").cast("string")
    eq = F.when(s == 0, F.concat(F.lit("eq_"), p)).when(s == 1, F.concat(F.lit("sec_a_"), p)).otherwise(p)
    return t("part").select(F.col("p_partkey").alias("pos"), eq.alias("eq_id"), "p_brand")


def _equation_refs(t):
    n, p = F.col("l_linenumber"), F.col("l_partkey").cast("string")
    return t("lineitem").select(
        F.when(n == 1, F.concat(F.lit("eq_"), p)).when(n == 2, F.concat(F.lit("x"), p)).otherwise(p).alias("ref")).distinct()


@query("flexible_id_join", f"""
WITH {_EQ}, k AS (SELECT ref, eq_id, row_number() OVER (PARTITION BY ref ORDER BY CASE WHEN eq_id = ref THEN 0 ELSE 1 END, pos) AS rn
  FROM refs JOIN (SELECT pos, eq_id, unnest(list_distinct([eq_id, replace(eq_id, 'eq_', ''), string_split(eq_id, '_')[-1]])) AS key FROM eq) ON key = ref)
SELECT r.ref, k.eq_id FROM refs r LEFT JOIN k ON k.ref = r.ref AND k.rn = 1""")
def flexible_id_join(t):
    return J.flexible_id_join(_equation_refs(t), _equations(t))


@query("traceability_coverage", """
WITH m AS (SELECT DISTINCT l_partkey FROM lineitem WHERE l_quantity > 48 AND l_returnflag = 'A')
SELECT p_brand, COUNT(*) AS total, COUNT(l_partkey) AS mapped, COUNT(l_partkey) / greatest(COUNT(*), 1) AS coverage
FROM part LEFT JOIN m ON p_partkey = l_partkey GROUP BY p_brand""")
def traceability_coverage(t):
    eqs = t("part").select("p_brand", F.col("p_partkey").alias("eq_id"))
    used = t("lineitem").filter("l_quantity > 48 AND l_returnflag = 'A'").select(F.col("l_partkey").alias("eq_id")).distinct()
    return J.traceability_coverage(eqs, eqs.join(used, "eq_id"), "p_brand")


@query("plan_result_outer", """
WITH plan AS (SELECT o_orderkey AS module_id, o_totalprice AS estimated FROM orders WHERE o_orderstatus <> 'P'),
res AS (SELECT l_orderkey AS module_id, COUNT(*) AS attempts, COUNT(*) FILTER (l_returnflag = 'R') AS n_errors FROM lineitem GROUP BY l_orderkey)
SELECT coalesce(p.module_id, r.module_id) AS module_id, p.module_id IS NOT NULL AS planned,
  CASE WHEN r.module_id IS NULL THEN 'missing' WHEN n_errors > 0 THEN 'failed' ELSE 'generated' END AS status, coalesce(attempts, 0) AS attempts
FROM plan p FULL OUTER JOIN res r ON p.module_id = r.module_id""")
def plan_result_outer(t):
    plan = t("orders").filter("o_orderstatus <> 'P'").select(F.col("o_orderkey").alias("module_id"), F.col("o_totalprice").alias("estimated"))
    res = t("lineitem").groupBy(F.col("l_orderkey").alias("module_id")).agg(
        F.count("*").alias("attempts"), F.count_if(F.col("l_returnflag") == "R").alias("n_errors"))
    return J.plan_results(plan, res, "module_id").select("module_id", "planned", "status", F.coalesce("attempts", F.lit(0)).alias("attempts"))


@query("due_for_rotation", f"""
WITH last AS (SELECT key_id, MAX(ts) AS ts FROM audit WHERE event_type = 'login_success' GROUP BY key_id),
j AS (SELECT c.*, CAST(coalesce(floor(epoch({NOW} - ts) / 86400), 365) AS BIGINT) AS age, CAST(floor(epoch(expires_at - {NOW}) / 86400) AS BIGINT) AS left_days FROM credentials c LEFT JOIN last USING (key_id))
SELECT key_id, 'age' AS reason, age AS days FROM j WHERE age >= rotation_days
UNION ALL SELECT key_id, 'expiry', left_days FROM j WHERE left_days <= rotate_before_days""")
def due_for_rotation(t):
    rotations = t("audit").filter("event_type = 'login_success'")
    return J.due_for_rotation(t("credentials"), rotations, AS_OF)


@query("resolve_failing_modules", """
WITH logs AS (SELECT l_orderkey AS run_id, l_partkey, CASE l_returnflag WHEN 'A' THEN 'm' || l_partkey WHEN 'R' THEN 'm' || l_partkey ELSE NULL END AS module_id FROM lineitem)
SELECT DISTINCT run_id, module_id FROM logs WHERE module_id IS NOT NULL""")
def resolve_failing_modules(t):
    p = F.col("l_partkey").cast("string")
    text = (F.when(F.col("l_returnflag") == "A", F.concat(F.lit("FAILED tests/test_unit"), p, F.lit(".py::case - boom")))
            .when(F.col("l_returnflag") == "R", F.concat(F.lit('File "/workspace/src/pkg/unit'), p, F.lit('.py", line 3')))
            .otherwise("1 passed"))
    logs = t("lineitem").select(F.col("l_orderkey").alias("run_id"), text.alias("text"))
    k = F.col("p_partkey").cast("string")
    modules = t("part").select(
        F.concat(F.lit("m"), k).alias("module_id"), F.concat(F.lit("src/pkg/unit"), k, F.lit(".py")).alias("file_path"),
        F.concat(F.lit("tests/test_unit"), k, F.lit(".py")).alias("test_path"))
    return J.failing_modules(logs, modules)


@query("external_calls", """
SELECT e.src, e.dst, a.file AS src_file, b.file AS dst_file FROM cites e JOIN cite_nodes a ON a.id = e.src JOIN cite_nodes b ON b.id = e.dst
WHERE b.file <> '' AND a.file <> b.file""")
def external_calls(t):
    return J.external_calls(t("cites"), t("cite_nodes"))


@query("spec_relevance_pivot", """
PIVOT (SELECT spec, repo_id, true AS there FROM suggestions) ON repo_id USING coalesce(bool_or(there), false) GROUP BY spec""")
def spec_relevance_pivot(t):
    return J.spec_matrix(t("suggestions"))


@query("reference_lookup_join", """
SELECT p_partkey, 'r' || p_partkey AS name, CASE WHEN p_size % 3 = 0 THEN 'own' ELSE '' END AS owner, 'https://x.org/r' || p_partkey AS url, CASE WHEN p_size % 3 = 0 THEN p_size ELSE 0 END AS stars
FROM part WHERE p_size % 3 <> 2
UNION ALL SELECT p_partkey, 'second', '', 'https://x.org/second', 7 FROM part WHERE p_size % 3 = 1""")
def reference_lookup_join(t):
    k, s = F.col("p_partkey").cast("string"), F.col("p_size") % 3
    js = (F.when(s == 0, F.concat(F.lit('{"official": {"url": "https://x.org/r'), k, F.lit('", "owner": "own", "stars": '), F.col("p_size").cast("string"), F.lit("}}")))
          .when(s == 1, F.concat(F.lit('{"code": [{"repo_url": "https://x.org/r'), k, F.lit('"}, {"html_url": "https://x.org/second", "star_count": 7}]}')))
          .otherwise('{"results": [{"name": "no url"}]}'))
    return J.reference_repositories(t("part").withColumn("payload", js), "p_partkey", "payload")


@query("ready_tasks", """
WITH d AS (SELECT x.id, coalesce(s.status = 'completed', false) AS ok, coalesce(s.status = 'failed', false) AS skip FROM task_deps x LEFT JOIN tasks s ON s.id = x.dep),
a AS (SELECT id, bool_and(ok) AS ok, bool_or(skip) AS skip FROM d GROUP BY id)
SELECT tasks.id, CASE WHEN coalesce(skip, false) THEN 'skipped' WHEN coalesce(ok, true) THEN 'runnable' ELSE 'blocked' END AS state
FROM tasks LEFT JOIN a USING (id) WHERE status = 'pending'""")
def ready_tasks(t):
    return J.ready_tasks(t("tasks"), t("task_deps"))


@query("phase_report", """
WITH v AS (SELECT l_orderkey AS run_id, MAX(l_quantity) * 2 AS confidence, CASE WHEN COUNT(*) FILTER (l_returnflag = 'R') = 0 THEN true WHEN COUNT(*) FILTER (l_returnflag = 'N') > 0 THEN false END AS passed,
  AVG(CASE WHEN l_returnflag = 'A' THEN 1 + (l_discount - 0.03) END) AS speedup, MAX(l_tax) * 100 - 2.5 AS loss_change FROM lineitem GROUP BY l_orderkey)
SELECT o_orderkey AS run_id, CASE WHEN coalesce(passed, false) THEN 'completed' ELSE 'needs_review' END AS status, CASE WHEN coalesce(passed, false) THEN 95 ELSE 60 END AS report_confidence,
  concat_ws('; ', CASE WHEN speedup < 1.0 THEN 'Performance regression detected - review required' END, CASE WHEN loss_change > 5 THEN 'Significant loss change observed - verify model quality' END,
    CASE WHEN confidence < 70 THEN 'Low mapping confidence - manual review recommended' END) AS notes,
  CASE WHEN passed IS NULL THEN 'review' WHEN NOT passed THEN 'reject' WHEN speedup < 1.05 THEN 'review' ELSE 'approve' END AS action
FROM orders LEFT JOIN v ON o_orderkey = run_id""")
def phase_report(t):
    flag = F.col("l_returnflag")
    v = t("lineitem").groupBy(F.col("l_orderkey").alias("run_id")).agg(
        (F.max("l_quantity") * 2).alias("confidence"),
        F.when(F.count_if(flag == "R") == 0, True).when(F.count_if(flag == "N") > 0, False).alias("passed"),
        F.avg(F.when(flag == "A", 1 + (F.col("l_discount") - 0.03))).alias("speedup"), (F.max("l_tax") * 100 - 2.5).alias("loss_change"))
    runs = t("orders").select(F.col("o_orderkey").alias("run_id")).join(v, "run_id", "left")
    return J.phase_report(runs).select("run_id", "status", "report_confidence", F.array_join("risk_notes", "; ").alias("notes"), "action")


@query("positional_line_diff", """
WITH p AS (SELECT pair_id, string_split(original, chr(10)) AS a, string_split(modified, chr(10)) AS b FROM versions),
c AS (SELECT pair_id, len(a) AS na, len(b) AS nb, len([1 for i in range(1, least(len(a), len(b)) + 1) if a[i] <> b[i]]) AS changed FROM p)
SELECT pair_id, CAST(changed + greatest(nb - na, 0) AS INT) AS additions, CAST(changed + greatest(na - nb, 0) AS INT) AS deletions FROM c""")
def positional_line_diff(t):
    return J.positional_line_diff(t("versions"), "pair_id", "original", "modified")
