"""Derived tables: the engine's record shapes laid over the given base tables.

Every view reads whole tables; each is plain SQL so the same text can feed the
independent oracle.
"""

from __future__ import annotations

from .registry import view

AS_OF = "2024-01-31 00:00:00"
AS_OF_YEAR = 2024

view("usage", """
SELECT event_id, ts, user_id AS key_id,
  CASE user_id % 4 WHEN 0 THEN 'anthropic' WHEN 1 THEN 'openai' WHEN 2 THEN 'google' ELSE 'github' END AS provider,
  event_type AS endpoint,
  CASE WHEN event_id % 10 = 0 THEN NULL ELSE CAST(FLOOR(value*100) AS BIGINT) END AS tokens_used,
  CAST(FLOOR(value*10) AS BIGINT) AS latency_ms,
  CASE WHEN event_type = 'error' THEN 'error' ELSE 'success' END AS status
FROM events""")

# Events as they arrive: by thirds of the time, each seventh a third late. Within an arrival they come in no order.
_ARRIVAL = """
SELECT event_id, ts, user_id, event_type, value, props, LEAST(3, 1 + CASE WHEN us >= lo + third THEN 1 ELSE 0 END + CASE WHEN us >= lo + 2 * third THEN 1 ELSE 0 END
  + CASE WHEN event_id % 7 = 3 THEN 1 ELSE 0 END) AS arrival
FROM (SELECT *, {us} AS us FROM events) e CROSS JOIN (SELECT MIN({us}) AS lo, CAST(FLOOR((MAX({us}) - MIN({us})) / 3) AS BIGINT) AS third FROM events) b"""
view("arrivals", _ARRIVAL.format(us="unix_micros(CAST(ts AS TIMESTAMP))"), _ARRIVAL.format(us="epoch_us(ts)"))

view("audit", """
SELECT event_id AS id, ts,
  CASE event_type WHEN 'signup' THEN 'login_success' WHEN 'error' THEN 'login_failed' ELSE 'key_accessed' END AS event_type,
  user_id AS key_id
FROM events""")

view("predictions", """
SELECT d.doc_id AS id, (d.doc_id % 101) / 100e0 AS confidence, d.lang AS category, l.quality AS correct
FROM documents d JOIN labels l ON d.doc_id = l.doc_id""")

view("papers", """
SELECT doc_id AS paper_id, SPLIT_PART(text, CHR(10), 1) AS title, text AS abstract,
  CAST(2000 + doc_id % 25 AS INT) AS year, source
FROM documents""")

# Citation graph over parts: a part cites the part on the next line of one of its orders. Cyclic, all lines and orders.
view("cites", """
SELECT DISTINCT a.l_partkey AS src, b.l_partkey AS dst
FROM lineitem a JOIN lineitem b ON a.l_orderkey = b.l_orderkey AND b.l_linenumber = a.l_linenumber + 1
WHERE a.l_partkey <> b.l_partkey""")
view("cite_nodes", """
SELECT p_partkey AS id, p_name AS title, CAST(2000 + p_size % 25 AS INT) AS year, p_brand AS file
FROM part""")

# Dependency graph over typed entities (acyclic, five layers).
view("dep_edges", """
SELECT CONCAT('nation:', CAST(n_nationkey AS VARCHAR(20))) AS src, CONCAT('region:', CAST(n_regionkey AS VARCHAR(20))) AS dst FROM nation
UNION ALL SELECT CONCAT('customer:', CAST(c_custkey AS VARCHAR(20))), CONCAT('nation:', CAST(c_nationkey AS VARCHAR(20))) FROM customer
UNION ALL SELECT CONCAT('supplier:', CAST(s_suppkey AS VARCHAR(20))), CONCAT('nation:', CAST(s_nationkey AS VARCHAR(20))) FROM supplier
UNION ALL SELECT CONCAT('order:', CAST(o_orderkey AS VARCHAR(20))), CONCAT('customer:', CAST(o_custkey AS VARCHAR(20))) FROM orders
UNION ALL SELECT DISTINCT CONCAT('part:', CAST(l_partkey AS VARCHAR(20))), CONCAT('supplier:', CAST(l_suppkey AS VARCHAR(20))) FROM lineitem""")
view("dep_nodes", """
SELECT CONCAT('region:', CAST(r_regionkey AS VARCHAR(20))) AS id, 'region' AS file FROM region
UNION ALL SELECT CONCAT('nation:', CAST(n_nationkey AS VARCHAR(20))), 'nation' FROM nation
UNION ALL SELECT CONCAT('customer:', CAST(c_custkey AS VARCHAR(20))), 'customer' FROM customer
UNION ALL SELECT CONCAT('supplier:', CAST(s_suppkey AS VARCHAR(20))), 'supplier' FROM supplier
UNION ALL SELECT CONCAT('order:', CAST(o_orderkey AS VARCHAR(20))), 'order' FROM orders
UNION ALL SELECT CONCAT('part:', CAST(p_partkey AS VARCHAR(20))), 'part' FROM part""")

view("metrics", """
SELECT user_id AS run_id, event_type AS metric_name, CAST(EXTRACT(DAY FROM ts) AS INT) AS epoch,
  event_id AS step, value AS metric_value, ts
FROM events""")
view("runs", """
SELECT DISTINCT user_id AS run_id, user_id % 5 AS experiment,
  CASE WHEN user_id % 7 = 0 THEN 'failed' ELSE 'completed' END AS status
FROM events""")

# One profile row per (repository = supplier nation, pattern, framework, language), over all lines.
view("profiles", """
SELECT n.n_nationkey AS repo_id, CONCAT(p.p_brand, '/', p.p_name, '/', CAST(p.p_size AS VARCHAR(20))) AS pattern, CONCAT(p.p_type, '/', p.p_name) AS framework,
  CONCAT('L', CAST(p.p_size AS VARCHAR(20)), p.p_type, p.p_name) AS language, COUNT(*) AS n_lines
FROM lineitem l JOIN supplier s ON l.l_suppkey = s.s_suppkey
JOIN nation n ON s.s_nationkey = n.n_nationkey JOIN part p ON l.l_partkey = p.p_partkey
GROUP BY ALL""")

view("snap_base", """
SELECT l_partkey AS id, FLOOR(SUM(CAST(FLOOR(l_discount * 100 + 0.5) AS BIGINT)) * 1000e0 / COUNT(*)) / 10000e0 AS score
FROM lineitem WHERE l_returnflag IN ('A', 'N') GROUP BY l_partkey""")
view("snap_cur", """
SELECT l_partkey AS id, FLOOR(SUM(CAST(FLOOR(l_discount * 100 + 0.5) AS BIGINT)) * 1000e0 / COUNT(*)) / 10000e0 AS score
FROM lineitem WHERE l_returnflag IN ('R', 'N') GROUP BY l_partkey""")
for side in ("base", "cur"):
    view(f"results_{side}", f"""
SELECT id, score, CASE WHEN score >= 0.55 THEN 'matched' WHEN score >= 0.45 THEN 'partial' ELSE 'mismatch' END AS status
FROM snap_{side}""")

view("memories", """
SELECT conv_id * 1000 + turn AS id, text AS content,
  CASE turn % 4 WHEN 0 THEN 'episodic' WHEN 1 THEN 'semantic' WHEN 2 THEN 'procedural' ELSE 'working' END AS memory_type,
  CAST(1 + turn % 5 AS INT) AS importance, role AS tag, CAST(turn % 6 AS BIGINT) AS access_count,
  TIMESTAMP_NTZ '2024-01-31 00:00:00' - make_dt_interval(CAST(conv_id * 3 AS INT), CAST(turn AS INT)) AS created_at,
  TIMESTAMP_NTZ '2024-01-31 00:00:00' - make_dt_interval(0, 0, CAST(conv_id * 7 + turn AS INT)) AS accessed_at,
  CASE WHEN conv_id % 3 = 0 THEN NULL ELSE TIMESTAMP_NTZ '2024-01-31 00:00:00' + make_dt_interval(CAST(conv_id AS INT) - 50) END AS expires_at,
  CASE CAST(1 + turn % 5 AS INT) WHEN 5 THEN 'frozen' WHEN 4 THEN 'hot' WHEN 3 THEN 'warm' ELSE 'cold' END AS tier
FROM conversations""", """
SELECT conv_id * 1000 + turn AS id, text AS content,
  CASE turn % 4 WHEN 0 THEN 'episodic' WHEN 1 THEN 'semantic' WHEN 2 THEN 'procedural' ELSE 'working' END AS memory_type,
  CAST(1 + turn % 5 AS INT) AS importance, role AS tag, CAST(turn % 6 AS BIGINT) AS access_count,
  TIMESTAMP '2024-01-31 00:00:00' - to_days(CAST(conv_id * 3 AS INT)) - to_hours(turn) AS created_at,
  TIMESTAMP '2024-01-31 00:00:00' - to_minutes(conv_id * 7 + turn) AS accessed_at,
  CASE WHEN conv_id % 3 = 0 THEN NULL ELSE TIMESTAMP '2024-01-31 00:00:00' + to_days(CAST(conv_id - 50 AS INT)) END AS expires_at,
  CASE CAST(1 + turn % 5 AS INT) WHEN 5 THEN 'frozen' WHEN 4 THEN 'hot' WHEN 3 THEN 'warm' ELSE 'cold' END AS tier
FROM conversations""")

view("phase_spans", """
SELECT o_orderkey AS run_id, l_linenumber AS phase, MIN(o_orderdate) AS started, MAX(l_shipdate) AS ended,
  COUNT(*) - 1 AS retries, MIN(o_orderstatus) AS o_status
FROM orders JOIN lineitem ON o_orderkey = l_orderkey GROUP BY o_orderkey, l_linenumber""")
view("phase_events", """
SELECT o_orderkey AS run_id, 0 AS phase, o_orderdate AS ts, 'start' AS kind FROM orders
UNION ALL SELECT l_orderkey, 0, l_shipdate,
  CASE l_linestatus WHEN 'F' THEN 'complete' ELSE 'retry' END FROM lineitem""")

view("tasks", """
SELECT CONCAT('o', CAST(o_orderkey AS VARCHAR(20))) AS id, CAST(o_custkey AS BIGINT) AS plan_id,
  CASE o_orderstatus WHEN 'F' THEN 'completed' WHEN 'O' THEN 'pending' ELSE 'failed' END AS status,
  o_orderdate AS ts, o_orderpriority AS priority
FROM orders""")
view("task_deps", """
SELECT CONCAT('o', CAST(o_orderkey AS VARCHAR(20))) AS id,
  CONCAT('o', CAST(o_orderkey - o_custkey % 7 AS VARCHAR(20))) AS dep
FROM orders""")

view("suggestions", """
SELECT repo_id, language AS spec, LOWER(MIN(pattern)) AS category FROM profiles GROUP BY repo_id, language""")

view("final_metrics_sql", """
SELECT user_id AS run_id, event_type AS metric_name, MAX(NAMED_STRUCT('d', EXTRACT(DAY FROM ts), 's', event_id, 'v', value)).v AS value
FROM events GROUP BY user_id, event_type""", """
SELECT user_id AS run_id, event_type AS metric_name, MAX({'d': EXTRACT(DAY FROM ts), 's': event_id, 'v': value}).v AS value
FROM events GROUP BY user_id, event_type""")

view("credentials", """
SELECT c_custkey AS key_id, c_nationkey AS owner_id, c_acctbal > 1000 AS is_active, CAST(30 + c_custkey % 90 AS INT) AS rotation_days,
  CAST(5 + c_custkey % 20 AS INT) AS rotate_before_days,
  TIMESTAMP_NTZ '2024-01-31 00:00:00' - make_dt_interval(CAST(c_custkey % 400 AS INT)) AS created_at,
  CASE WHEN c_custkey % 4 = 0 THEN NULL ELSE TIMESTAMP_NTZ '2024-01-31 00:00:00' + make_dt_interval(CAST(c_custkey % 120 AS INT) - 40) END AS expires_at
FROM customer""", """
SELECT c_custkey AS key_id, c_nationkey AS owner_id, c_acctbal > 1000 AS is_active, CAST(30 + c_custkey % 90 AS INT) AS rotation_days,
  CAST(5 + c_custkey % 20 AS INT) AS rotate_before_days,
  TIMESTAMP '2024-01-31 00:00:00' - to_days(CAST(c_custkey % 400 AS INT)) AS created_at,
  CASE WHEN c_custkey % 4 = 0 THEN NULL ELSE TIMESTAMP '2024-01-31 00:00:00' + to_days(CAST(c_custkey % 120 AS INT) - 40) END AS expires_at
FROM customer""")

view("versions", """
SELECT a.doc_id AS pair_id, a.source, CONCAT(a.source, '/f', CAST(a.doc_id AS VARCHAR(20)), '.py') AS path,
  a.text AS original, b.text AS modified
FROM documents a JOIN documents b ON b.doc_id = a.doc_id + 20 AND a.source = b.source""")

view("elements", """
SELECT p_partkey AS line, p_name AS name, p_brand AS file, CONCAT('class ', p_type) AS snippet, p_type AS module
FROM part""")

# Elements of the files in code_lines.
view("scan_elements", """
SELECT p_partkey AS line, p_name AS name, CONCAT('f', CAST(p_partkey AS VARCHAR(20)), '.py') AS file, CONCAT('class ', p_type) AS snippet, p_type AS module
FROM part""")

view("candidates", """
SELECT l_orderkey AS spec, l_linenumber AS pos,
  CASE l_linenumber WHEN 1 THEN 'exact' WHEN 2 THEN 'exact' WHEN 3 THEN 'fuzzy_name' WHEN 4 THEN 'fuzzy_snippet'
    WHEN 5 THEN 'import' ELSE 'text_scan' END AS match_tier,
  l_returnflag AS matched_pattern, CASE WHEN l_tax >= 0.07 THEN 'error' ELSE 'ok' END AS issue
FROM lineitem""")

view("http_requests", """
SELECT event_id, ts, user_id, event_type AS route, value / 100e0 AS latency_s,
  CASE WHEN event_type = 'error' AND value > 20 THEN 500 WHEN event_type = 'error' THEN 404 ELSE 200 END AS status_code
FROM events""")

view("code_lines", """
SELECT l_orderkey * 10 + l_linenumber AS row_id, CONCAT('f', CAST(l_orderkey AS VARCHAR(20)), '.py') AS file,
  l_linenumber AS line_no,
  CASE l_linenumber % 4
    WHEN 1 THEN CONCAT('import ', CASE CAST(l_suppkey AS INT) % 5 WHEN 0 THEN 'os' WHEN 1 THEN 'numpy.linalg' WHEN 2 THEN 'torch' WHEN 3 THEN CONCAT('pkg', CAST(l_suppkey AS VARCHAR(20))) ELSE 'django.db' END)
    WHEN 2 THEN CONCAT('def fn_', CAST(l_partkey AS VARCHAR(20)), '(a, b', CASE WHEN l_quantity > 25 THEN ', c' ELSE '' END, '):')
    WHEN 3 THEN CONCAT('class LayerNorm', CAST(l_partkey AS VARCHAR(20)), ':')
    ELSE CONCAT('    return cache_', l_returnflag, '(x1, 42)  # note') END AS content
FROM lineitem""")

view("part_suppliers", """
SELECT DISTINCT l_partkey AS src, l_suppkey AS dst FROM lineitem""")
