"""Graph families: an acyclic dependency graph and a cyclic citation graph over whole tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from citeloom.functions import scoring as S
from citeloom.operators import graph as G
from citeloom.session import cut_lineage

from .registry import query
from .views import AS_OF_YEAR

# On an acyclic graph the ranks are final once the longest chain is walked.
_PR = ["r0 AS (SELECT id, 1e0 / (SELECT COUNT(*) FROM dep_nodes) AS r FROM dep_nodes)"]
for _i in range(1, 9):
    _PR.append(f"""r{_i} AS (SELECT n.id, 0.15e0 / (SELECT COUNT(*) FROM dep_nodes) + 0.85e0 * coalesce(SUM(r.r * o.share), 0) AS r
  FROM dep_nodes n LEFT JOIN dep_edges e ON e.dst = n.id LEFT JOIN r{_i - 1} r ON r.id = e.src LEFT JOIN o ON o.src = e.src GROUP BY n.id)""")


@query("pagerank", f"WITH o AS (SELECT src, 1e0 / COUNT(*) AS share FROM dep_edges GROUP BY src), {', '.join(_PR)} SELECT id, round(r * 1000000, 6) AS rank_ppm FROM r8")
def pagerank(t):
    return G.pagerank(t("dep_nodes"), t("dep_edges")).select("id", S.rounded(F.col("rank") * 1_000_000, 6).alias("rank_ppm"))


_PC = ["r0 AS (SELECT id, 1e0 / (SELECT COUNT(*) FROM cite_nodes) AS r FROM cite_nodes)"]
for _i in range(1, 13):
    _PC.append(f"""r{_i} AS (SELECT n.id, 0.15e0 / (SELECT COUNT(*) FROM cite_nodes) + 0.85e0 * coalesce(SUM(r.r * o.share), 0) AS r
  FROM cite_nodes n LEFT JOIN cites e ON e.dst = n.id LEFT JOIN r{_i - 1} r ON r.id = e.src LEFT JOIN o ON o.src = e.src GROUP BY n.id)""")


@query("pagerank_citations", f"WITH o AS (SELECT src, 1e0 / COUNT(*) AS share FROM cites GROUP BY src), {', '.join(_PC)} SELECT id, round(r * 1000000, 6) AS rank_ppm FROM r12")
def pagerank_citations(t):
    return G.pagerank(t("cite_nodes"), t("cites"), iterations=12).select("id", S.rounded(F.col("rank") * 1_000_000, 6).alias("rank_ppm"))


def _ends(t):
    """Source = smallest citing part; target = most cited part."""
    e = t("cites")
    source = e.agg(F.min("src")).first()[0]
    target = G.key_hubs(e, 1).first()["id"]
    return e, source, target


_ENDS = "s AS (SELECT MIN(src) AS s FROM cites), g AS (SELECT dst AS g FROM cites GROUP BY dst ORDER BY COUNT(*) DESC, dst LIMIT 1)"
# Walks of at most eight edges; a step is taken only if the end can still be reached within them (``kept``).
_WALK = """near AS (SELECT g AS id, 0 AS dist FROM g UNION SELECT e.src, near.dist + 1 FROM near JOIN cites e ON e.dst = near.id WHERE near.dist < 8),
d AS (SELECT id, MIN(dist) AS dist FROM near GROUP BY id),
w AS (SELECT s AS id, [s] AS path FROM s UNION ALL SELECT e.dst, list_append(w.path, e.dst) FROM w JOIN cites e ON e.src = w.id JOIN d ON d.id = e.dst
  WHERE len(w.path) + d.dist {kept} AND NOT list_contains(w.path, e.dst) AND w.id <> (SELECT g FROM g))"""


@query("shortest_path", f"WITH RECURSIVE {_ENDS}, {_WALK.format(kept='= (SELECT dist FROM d JOIN s ON d.id = s.s)')} SELECT array_to_string(path, '>') AS path, CAST(len(path) - 1 AS INT) AS length FROM w WHERE id = (SELECT g FROM g) ORDER BY len(path), w.path LIMIT 1")
def shortest_path(t):
    e, source, target = _ends(t)
    return G.shortest_path(e, source, target, 8).select(F.array_join(F.col("path").cast("array<string>"), ">").alias("path"), "length")


@query("all_simple_paths", f"WITH RECURSIVE {_ENDS}, {_WALK.format(kept='<= 8')} SELECT array_to_string(path, '>') AS path, CAST(len(path) - 1 AS INT) AS length FROM w WHERE id = (SELECT g FROM g) AND len(path) <= 9")
def all_simple_paths(t):
    e, source, target = _ends(t)
    return G.all_simple_paths(e, source, target, 9).select(F.array_join(F.col("path").cast("array<string>"), ">").alias("path"), "length")


_DEP_CLOSURE = "c AS (SELECT src AS seed, dst AS id FROM dep_edges UNION SELECT c.seed, e.dst FROM c JOIN dep_edges e ON e.src = c.id)"

_DEP_DEPTHS = "w AS (SELECT src AS seed, dst AS id, 1 AS depth FROM dep_edges UNION SELECT w.seed, e.dst, w.depth + 1 FROM w JOIN dep_edges e ON e.src = w.id)"


@query("transitive_closure", f"WITH RECURSIVE {_DEP_DEPTHS} SELECT seed, id, CAST(MIN(depth) AS INT) AS depth FROM w GROUP BY seed, id")
def transitive_closure(t):
    return G.closure(t("dep_edges")).select("seed", "id", "depth")


@query("transitive_closure_seeded", f"WITH RECURSIVE {_ENDS}, c AS (SELECT dst AS id FROM cites, s WHERE src = s UNION SELECT e.dst FROM c JOIN cites e ON e.src = c.id) SELECT id FROM c")
def transitive_closure_seeded(t):
    e = t("cites")
    return G.closure(e, e.agg(F.min("src").alias("id"))).select("id")


@query("graph_depth", """
WITH RECURSIVE l AS (SELECT id AS seed, id, 0 AS d FROM dep_nodes UNION SELECT l.seed, e.dst, l.d + 1 FROM l JOIN dep_edges e ON e.src = l.id)
SELECT seed AS id, CAST(MAX(m) AS INT) AS depth FROM (SELECT seed, id, MIN(d) AS m FROM l GROUP BY seed, id) GROUP BY seed""")
def graph_depth(t):
    return G.graph_depth(t("dep_edges"), t("dep_nodes"))


@query("find_cycles", """
WITH RECURSIVE p AS (SELECT src AS start, dst AS id, [src, dst] AS path FROM cites WHERE src < dst
  UNION ALL SELECT p.start, e.dst, list_append(p.path, e.dst) FROM p JOIN cites e ON e.src = p.id WHERE len(p.path) <= 4 AND p.id <> p.start AND (e.dst = p.start OR (e.dst > p.start AND NOT list_contains(p.path, e.dst))))
SELECT array_to_string(path[1:-2], '>') AS cycle FROM p WHERE id = start AND len(path) <= 5 UNION ALL SELECT CAST(src AS VARCHAR) FROM cites WHERE src = dst""")
def find_cycles(t):
    return G.find_cycles(t("cites"), 4).select(F.array_join(F.col("cycle").cast("array<string>"), ">").alias("cycle"))


@query("topological_layers", """
WITH RECURSIVE l AS (SELECT id, 0 AS layer FROM dep_nodes WHERE id NOT IN (SELECT src FROM dep_edges) UNION SELECT e.src, l.layer + 1 FROM l JOIN dep_edges e ON e.dst = l.id)
SELECT id, CAST(MAX(layer) AS INT) AS layer FROM l GROUP BY id""")
def topological_layers(t):
    return G.topological_layers(t("dep_nodes"), t("dep_edges"))


@query("impact_score", f"""
WITH RECURSIVE {_DEP_CLOSURE}, tr AS (SELECT id, COUNT(*) AS transitive FROM c GROUP BY id), d AS (SELECT dst AS id, COUNT(*) AS direct FROM dep_edges GROUP BY dst)
SELECT id, direct, transitive, direct + transitive * 0.5e0 AS impact, direct + transitive * 0.5e0 >= 5 AS critical FROM tr JOIN d USING (id)""")
def impact_score(t):
    return G.impact_scores(t("dep_edges"))


@query("leaf_and_entry_nodes", """
SELECT id, 'leaf' AS role FROM dep_nodes WHERE id NOT IN (SELECT src FROM dep_edges) UNION ALL SELECT id, 'entry' FROM dep_nodes WHERE id NOT IN (SELECT dst FROM dep_edges)""")
def leaf_and_entry_nodes(t):
    return G.leaf_and_entry(t("dep_nodes"), t("dep_edges"))


_PROFILE = f"""{_DEP_CLOSURE}, i AS (SELECT dst AS id, COUNT(*) AS in_degree FROM dep_edges GROUP BY 1), o AS (SELECT src AS id, COUNT(*) AS out_degree FROM dep_edges GROUP BY 1),
dn AS (SELECT seed AS id, COUNT(*) AS dependencies FROM c GROUP BY 1), up AS (SELECT id, COUNT(*) AS dependents FROM c GROUP BY 1),
prof AS (SELECT n.id, coalesce(in_degree, 0) AS in_degree, coalesce(out_degree, 0) AS out_degree, coalesce(dependencies, 0) AS dependencies, coalesce(dependents, 0) AS dependents
  FROM dep_nodes n LEFT JOIN i USING (id) LEFT JOIN o USING (id) LEFT JOIN dn USING (id) LEFT JOIN up USING (id))"""


@query("node_profile", f"""WITH RECURSIVE {_PROFILE}, {_DEP_DEPTHS}, x AS (SELECT seed AS id, MAX(m) AS far FROM (SELECT seed, id, MIN(depth) AS m FROM w GROUP BY 1, 2) GROUP BY 1)
SELECT prof.*, CAST(coalesce(far, 0) AS INT) AS depth, in_degree + dependents * 0.5e0 AS impact, out_degree AS external_calls FROM prof LEFT JOIN x USING (id)""")
def node_profile(t):
    return G.node_profile(t("dep_nodes"), t("dep_edges")).select(
        "id", "in_degree", "out_degree", "dependencies", "depth", "dependents", "impact", "external_calls")


@query("compare_nodes", """
WITH p AS (SELECT src AS id FROM part_suppliers GROUP BY src ORDER BY COUNT(*) DESC, src LIMIT 2), a AS (SELECT MIN(id) AS a, MAX(id) AS b FROM p)
SELECT 0 AS a_citations, (SELECT COUNT(*) FROM part_suppliers WHERE src = a) AS a_references, 0 AS b_citations, (SELECT COUNT(*) FROM part_suppliers WHERE src = b) AS b_references,
  (SELECT COUNT(*) FROM (SELECT dst FROM part_suppliers WHERE src IN (a, b) GROUP BY dst HAVING COUNT(*) = 2)) AS common_references, 0 AS common_citations, -1 AS path_length FROM a""")
def compare_nodes(t):
    e = t("part_suppliers").select(F.concat(F.lit("p"), F.col("src").cast("string")).alias("src"), F.concat(F.lit("s"), F.col("dst").cast("string")).alias("dst"))
    top = t("part_suppliers").groupBy("src").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "src").limit(2).collect()
    a, b = sorted(r["src"] for r in top)
    return G.compare_nodes(None, e, f"p{a}", f"p{b}")


@query("refactor_flags", f"""
WITH RECURSIVE {_PROFILE}, l AS (SELECT id AS seed, id, 0 AS d FROM dep_nodes UNION SELECT l.seed, e.dst, l.d + 1 FROM l JOIN dep_edges e ON e.src = l.id),
x AS (SELECT seed AS id, MAX(m) AS depth FROM (SELECT seed, id, MIN(d) AS m FROM l GROUP BY seed, id) GROUP BY seed), y AS (SELECT * FROM prof JOIN x USING (id)),
f AS (SELECT id, unnest([CASE WHEN out_degree > 15 THEN 'calls_many' END, CASE WHEN in_degree > 10 THEN 'wide_impact' END, CASE WHEN dependencies > 30 THEN 'many_transitive_callees' END,
  CASE WHEN depth > 10 THEN 'deep_call_chain' END, CASE WHEN out_degree > 10 THEN 'split_module' END, CASE WHEN dependencies > 20 THEN 'many_transitive_dependencies' END,
  CASE WHEN out_degree > 5 THEN 'extract_logic' END, CASE WHEN depth > 5 THEN 'break_up_function' END, CASE WHEN dependencies > 10 THEN 'split_focused_modules' END]) AS flag FROM y)
SELECT id, flag FROM f WHERE flag IS NOT NULL""")
def refactor_flags(t):
    nodes, edges = t("dep_nodes"), t("dep_edges")
    sizes = G.closure_sizes(edges, depth_limit=11).withColumnRenamed("reachable", "dependencies")  # the rules look no deeper
    profile = nodes.select("id").join(G.degrees(edges), "id", "left").join(sizes, "id", "left").fillna(0)
    return G.refactor_flags(profile)


@query("circular_flags", """
WITH RECURSIVE p AS (SELECT src AS start, dst AS id, [src, dst] AS path FROM cites WHERE src < dst
  UNION ALL SELECT p.start, e.dst, list_append(p.path, e.dst) FROM p JOIN cites e ON e.src = p.id WHERE len(p.path) <= 3 AND p.id <> p.start AND (e.dst = p.start OR (e.dst > p.start AND NOT list_contains(p.path, e.dst))))
SELECT DISTINCT unnest(path) AS id, 'circular_dependency' AS flag FROM p WHERE id = start AND len(path) <= 4""")
def circular_flags(t):
    e = t("cites")
    profile = G.degrees(e).withColumns({"dependencies": F.lit(0), "depth": F.lit(0)})
    return G.refactor_flags(profile, G.find_cycles(e, 3)).filter("flag = 'circular_dependency'")


@query("concept_graph_metrics", """
WITH RECURSIVE l AS (SELECT id, 0 AS layer FROM dep_nodes WHERE id NOT IN (SELECT src FROM dep_edges) UNION SELECT e.src, l.layer + 1 FROM l JOIN dep_edges e ON e.dst = l.id),
y AS (SELECT id, MAX(layer) AS layer FROM l GROUP BY id)
SELECT (SELECT COUNT(*) FROM dep_nodes) AS n, (SELECT COUNT(*) FROM dep_edges) AS m, round((SELECT COUNT(*) FROM dep_edges) / ((SELECT COUNT(*) FROM dep_nodes) * ((SELECT COUNT(*) FROM dep_nodes) - 1)) * 1e6, 6) AS density_ppm,
  CAST((SELECT MAX(layer) FROM y) + 1 AS BIGINT) AS longest_path_nodes, (SELECT string_agg(id, ',' ORDER BY in_degree DESC, id) FROM (SELECT dst AS id, COUNT(*) AS in_degree FROM dep_edges GROUP BY dst ORDER BY in_degree DESC, id LIMIT 5)) AS hubs""")
def concept_graph_metrics(t):
    nodes, edges = t("dep_nodes"), cut_lineage(t("dep_edges"))
    one = F.lit(1).alias("_one")
    d = G.density(nodes, edges).select("n", "m", S.rounded(F.col("density") * 1e6, 6).alias("density_ppm"), one)
    steps = G.longest_path(nodes, edges).agg(F.count("*").alias("longest_path_nodes")).select("longest_path_nodes", one)
    ranked = F.array_sort(F.collect_list(F.struct((-F.col("in_degree")).alias("d"), "id")))
    hubs = G.key_hubs(edges).agg(F.array_join(F.transform(ranked, lambda s: s["id"]), ",").alias("hubs")).select("hubs", one)
    return d.join(steps, "_one").join(hubs, "_one").drop("_one")


@query("build_edges", """
WITH r AS (SELECT DISTINCT l_partkey AS src, l_suppkey AS dst FROM lineitem)
SELECT 'forward' AS side, src AS id, COUNT(*) AS degree FROM r GROUP BY src UNION ALL SELECT 'reverse', dst, COUNT(*) FROM r GROUP BY dst""")
def build_edges(t):
    e = G.build_edges(t("lineitem").select(F.col("l_partkey").alias("src"), F.col("l_suppkey").alias("dst")))
    side = lambda df, name: df.groupBy(F.col("src").alias("id")).agg(F.count("*").alias("degree")).select(F.lit(name).alias("side"), "id", "degree")
    return side(e, "forward").unionByName(side(G.reverse(e), "reverse"))


@query("ghost_nodes", "SELECT DISTINCT dst AS id, '' AS title, 0 AS year FROM cites WHERE dst NOT IN (SELECT p_partkey FROM part WHERE p_size > 10) UNION SELECT DISTINCT src, '', 0 FROM cites WHERE src NOT IN (SELECT p_partkey FROM part WHERE p_size > 10)")
def ghost_nodes(t):
    known = t("part").filter("p_size > 10").select(F.col("p_partkey").alias("id"))
    return G.ghost_nodes(known, t("cites"))
