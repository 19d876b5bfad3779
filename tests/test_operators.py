"""Operators against brute force on small random inputs, and their edge cases."""

import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from citeloom.operators import aggregates as A, documents as C, extensions as E, graph as G, joins as J, ordered as O, rules as R, sets as D, vectors as V
from citeloom.streaming import operators as L, replay as P, steps
from citeloom.streaming.run import run_arrivals


def rows(df):
    return sorted(tuple(r) for r in df.collect())


# Graphs ---------------------------------------------------------------------

def edges(spark, pairs):
    return spark.createDataFrame(pairs, "src string, dst string")


def test_path_limits(spark):
    e = edges(spark, [("a", "b"), ("b", "c"), ("c", "d"), ("a", "x"), ("x", "d")])
    assert G.shortest_path(e, "a", "d", 2).first()["path"] == ["a", "x", "d"]
    assert G.shortest_path(e, "a", "d", 1).count() == 0
    assert G.shortest_path(e, "a", "a").first()["length"] == 0
    assert {tuple(r["path"]) for r in G.all_simple_paths(e, "a", "d", 4).collect()} == {("a", "x", "d"), ("a", "b", "c", "d")}
    assert {tuple(r["path"]) for r in G.all_simple_paths(e, "a", "d", 3).collect()} == {("a", "x", "d")}


def test_cycles_layers_closure(spark):
    e = edges(spark, [("a", "b"), ("b", "c"), ("c", "a"), ("c", "d"), ("e", "e")])
    nodes = spark.createDataFrame([(x,) for x in "abcde"], "id string")
    assert {tuple(r["cycle"]) for r in G.find_cycles(e, 3).collect()} == {("a", "b", "c"), ("e",)}
    layers = {r["id"]: r["layer"] for r in G.topological_layers(nodes, e).collect()}
    assert layers["d"] == 0 and layers["a"] is None and layers["e"] is None
    assert ("a", "a") in {(r["seed"], r["id"]) for r in G.closure(e).collect()}
    assert G.longest_path(nodes, e).count() == 0


def test_pagerank_matches_matrix(spark):
    rng = random.Random(3)
    n = 25
    pairs = sorted({(rng.randrange(n), rng.randrange(n)) for _ in range(60)})
    m = np.zeros((n, n))
    for s in range(n):
        out = [d for a, d in pairs if a == s]
        for d in out:
            m[d, s] = 1 / len(out)
    r = np.full(n, 1 / n)
    for _ in range(100):
        r = 0.15 / n + 0.85 * m @ r
    nodes = spark.createDataFrame([(i,) for i in range(n)], "id bigint")
    got = {x["id"]: x["rank"] for x in G.pagerank(nodes, spark.createDataFrame(pairs, "src bigint, dst bigint")).collect()}
    assert max(abs(got[i] - r[i]) for i in range(n)) < 1e-12
    single = G.pagerank(spark.createDataFrame([(1,)], "id bigint"), spark.createDataFrame([], "src bigint, dst bigint"))
    assert abs(single.first()["rank"] - 0.15) < 1e-12


# Sets and joins -------------------------------------------------------------

def greedy(papers):
    founders, out = [], {}
    for pos, doi, title in papers:
        for f, fd, ft in founders:
            if (doi and doi == fd) or (len(title) >= 20 and title == ft):
                out[pos] = f
                break
        else:
            founders.append((pos, doi, title))
            out[pos] = pos
    return out


@pytest.mark.parametrize("seed", [1, 2])
def test_greedy_entities(spark, seed):
    rng = random.Random(seed)
    papers = [(i, rng.choice(["", "d1", "d2", "d3", "d4"]), rng.choice(["t", "x" * 20, "y" * 21, "z" * 22])) for i in range(40)]
    df = spark.createDataFrame(papers, "pos bigint, doi string, title string").withColumns({c: F.lit("") for c in ("arxiv_id", "pubmed_id", "ieee_id")})
    assert {r["pos"]: r["entity"] for r in D.greedy_entities(df, "pos").collect()} == greedy(papers)
    linked = {r["pos"]: r["entity"] for r in D.connected_entities(df, "pos").collect()}
    assert all(linked[p] <= g for p, g in greedy(papers).items())


def test_similarity_threshold_equals_full(spark):
    rng = random.Random(5)
    data = [(r, f"p{rng.randrange(8)}", f"f{rng.randrange(3)}", f"l{rng.randrange(3)}", 1) for r in range(12) for _ in range(6)]
    prof = spark.createDataFrame(data, "repo_id bigint, pattern string, framework string, language string, n_lines bigint")
    full = [r for r in rows(J.pairwise_similarity(prof)) if r[2] >= 0.7]
    assert full and rows(J.pairwise_similarity(prof, 0.7)) == full


def test_text_scan_tier(spark):
    el = spark.createDataFrame([("f1", 1, "Attention", "x", "os")], "file string, line bigint, name string, snippet string, module string")
    lines = spark.createDataFrame([("f2", 5, "y = nn.GELU()"), ("f1", 9, "z = nn.GELU()"), ("f1", 7, "nn.GELU")], "file string, line bigint, content string")
    got = rows(J.tiered_match(el, el, lines, ["Attention", "nn.GELU"]))
    assert got == [("f1", 1, "exact", "Attention"), ("f1", 7, "text_scan", "nn.GELU")]


def test_asof_ties_and_buckets(spark):
    pages = spark.createDataFrame([("d", p) for p in (1, 5, 12, 30)], "doc string, page int")
    sections = spark.createDataFrame([("d", 2, "A"), ("d", 12, "B"), ("d", 12, "C")], "doc string, start int, title string")
    got = J.asof_join(pages, sections, "doc", "page", "start", "title")
    assert {r["page"]: r["title"] for r in got.collect()} == {1: "", 5: "A", 12: "C", 30: "C"}


def test_snapshot_rules(spark):
    b = spark.createDataFrame([(1, 0.9, "matched"), (2, 0.9, "matched"), (3, 0.9, "matched"), (4, 0.5, "partial")], "id int, score double, status string")
    c = spark.createDataFrame([(1, 0.85, "matched"), (2, 0.89, "partial"), (3, 0.5, "matched"), (5, 1.0, "matched")], "id int, score double, status string")
    got = {r["id"]: r["direction"] for r in J.snapshot_diff(b, c).collect()}
    assert got == {1: "unchanged", 2: "regression", 3: "regression", 4: "removed", 5: "added"}


def test_exact_median(spark):
    rng = random.Random(7)
    data = [("a", rng.random()) for _ in range(101)] + [("b", float(rng.randrange(5))) for _ in range(60)] + [("c", 1.0)] * 50
    got = {r["k"]: r["median"] for r in O.exact_median(spark.createDataFrame(data, "k string, v double"), ["k"], "v", 8).collect()}
    for k in "abc":
        assert abs(got[k] - float(np.median([v for x, v in data if x == k]))) < 1e-12


# Vectors --------------------------------------------------------------------

def test_neighbours_across_blocks_with_copies(spark):
    rng = np.random.default_rng(1)
    centres = rng.normal(size=(4, 8))
    m = np.vstack([c + 0.15 * rng.normal(size=(12, 8)) for c in centres])
    m[40:] = m[40]  # a hot group of copies
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(m)], "vec_id bigint, embedding array<double>")
    distinct, copies = V.exact_copies(df)
    assert copies.count() == 7
    u = m[:41] / np.linalg.norm(m[:41], axis=1, keepdims=True)
    sims = u @ u.T
    want = set()
    for i in range(41):
        order = [j for j in np.argsort(-sims[i], kind="stable") if j != i and sims[i, j] >= 0.9][:5]
        want |= {(i, int(j)) for j in order}
    got = {(r["id"], r["other"]) for r in V.neighbours(distinct, 5, 0.9, block_rows=4).collect()}
    assert got == want
    assert V.near_duplicates(df, 0.9).filter("a = 40").count() >= 7


def test_cosine_edge_cases(spark):
    df = spark.createDataFrame([([1.0, 0.0], [1.0, 0.0]), ([0.0, 0.0], [1.0, 0.0]), ([1.0], [1.0, 0.0]), ([], [])], "a array<double>, b array<double>")
    assert [r["c"] for r in df.select(V.cosine(F.col("a"), F.col("b")).alias("c")).collect()] == [1.0, 0.0, 0.0, 0.0]


# Replays, streams, diffs ----------------------------------------------------

def usage(spark, n=300):
    rng = random.Random(11)
    t, data = 0, []
    for i in range(n):
        t += rng.choice([1, 5, 40, 4000, 100000])
        data.append((i, rng.randrange(3), t, rng.random() < 0.5))
    df = spark.createDataFrame(data, "event_id bigint, user_id bigint, sec bigint, ok boolean")
    return data, df.withColumn("ts", F.timestamp_seconds("sec"))


@pytest.mark.parametrize("machine", [steps.admission(2, 3, 5), steps.token_bucket(0.01, 2), steps.circuit_breaker(2, 60, 2), steps.combined_limiter(2, 3, 2)])
def test_replay_equals_sequential_fold(spark, machine):
    data, df = usage(spark)
    states, want = {}, {}
    for e, k, sec, ok in data:
        states[k], verdict = machine.fold(states.get(k, machine.start), sec * 1_000_000, ok)
        want[e] = verdict["allowed"]
    got = P.replay(df, machine, "allowed boolean", key="user_id", ok="ok")
    assert {r["event_id"]: r["allowed"] for r in got.collect()} == want


def test_stream_equals_replay_whatever_the_order(spark):
    """Parts that mix all times give the verdicts of the replay once the watermark has passed; events behind it change no state."""
    _, df = usage(spark, 120)
    machine, verdicts = steps.admission(2, 3, 5), "allowed boolean, reason string"
    events = df.select("event_id", "user_id", F.col("ts").cast("timestamp_ntz").alias("ts"))
    end = spark.sql("SELECT 9999L AS event_id, 999L AS user_id, TIMESTAMP_NTZ '2100-01-01 00:00:00' AS ts")
    year = 366 * 86_400_000_000
    mixed = run_arrivals([events.filter(F.col("event_id") % 2 == k) for k in (1, 0)] + [end], lambda s: L.run_machine(s, machine, verdicts, delay="366 days", delay_us=year))
    assert rows(mixed.drop("late")) == rows(P.replay(df, machine, verdicts, key="user_id")) and not mixed.filter("late").count()
    half = events.agg(F.percentile_approx("ts", 0.5)).first()[0]
    new, old = events.filter(F.col("ts") >= half), events.filter(F.col("ts") < half)
    late_first = run_arrivals([new, old, end], lambda s: L.run_machine(s, machine, verdicts, delay="0 seconds", delay_us=1))
    assert rows(late_first.filter("late").select("event_id")) == rows(old.select("event_id"))
    kept = df.filter(F.col("ts").cast("timestamp_ntz") >= half)
    assert rows(late_first.filter("NOT late AND user_id <> 999").drop("late")) == rows(P.replay(kept, machine, verdicts, key="user_id"))


def test_diffs(spark):
    pairs = [("a\nb\nc\n", "a\nx\nc\nd\n"), ("same", "same"), ("", "new\n")]
    signed = lambda sign, x: "\n".join(sign + line for line in x.split("\n"))
    diffs = [("--- a\n+++ b\n@@ @@\n" + signed("-", a) + "\n" + signed("+", b), len(b.split("\n")), len(a.split("\n"))) for a, b in pairs]
    df = spark.createDataFrame(diffs, "diff string, added int, taken int")
    for r in df.select("added", "taken", E.diff_changes(F.col("diff")).alias("d")).collect():
        assert (r["d"]["additions"], r["d"]["deletions"]) == (r["added"], r["taken"])


def test_algorithms_sections_chunks(spark):
    text = "1 Intro\nhello\nAlgorithm 1: Sort\nInput: xs, n\n  for i in xs\n\nafter\nRESULTS\nfine"
    df = spark.createDataFrame([(1, text)], "id int, t string")
    algo = C.extract_algorithms(df, "id", "t").collect()
    assert algo[0]["name"] == "Algorithm 1: Sort" and algo[0]["hint"] == "python-like"
    assert algo[0]["pseudocode"] == "Algorithm 1: Sort\nInput: xs, n\n  for i in xs" and algo[0]["inputs"] == ["xs", "n"] and algo[0]["outputs"] == []
    titles = [r["title"] for r in C.extract_sections(df, "id", "t").orderBy("pos").collect()]
    assert titles[0] == "1 Intro" and "RESULTS" in titles
    chunks = C.chunk_by_size(df, "id", "t", F.lit("s"), 20).orderBy("chunk_index").collect()
    assert "\n".join(c["content"] for c in chunks) == text
    assert chunks[1]["legacy_start"] == chunks[0]["end_line"] and chunks[1]["start_line"] == chunks[0]["end_line"] + 1


def test_capped_confidence_bounds(spark):
    t = spark.createDataFrame([(1, "exact", "", "ok")] * 6 + [(2, "import", "", "error")] * 9, "spec int, match_tier string, matched_pattern string, issue string")
    got = {r["spec"]: r["total"] for r in A.capped_confidence(t, "spec", F.lit(False)).collect()}
    assert got == {1: 100 if 35 + 20 + 40 + 10 >= 100 else 105, 2: 0}


def test_long_chain_of_records_is_one_entity(spark):
    rows = [(i, f"10.1/{(i + 1) // 2}", f"a{i // 2}") for i in range(200)]
    df = spark.createDataFrame([(i, d, a, "", "", "") for i, d, a in rows], "pos int, doi string, arxiv_id string, pubmed_id string, ieee_id string, title string")
    assert {r["entity"] for r in D.connected_entities(df, "pos").collect()} == {0}


def test_query_blocks_give_the_same_neighbours(spark, monkeypatch):
    rows = [(i, [float((i * k) % 7 + 1) for k in range(1, 5)]) for i in range(60)]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>")
    q = df.withColumnRenamed("vec_id", "query_id")
    run = lambda: sorted(tuple(r) for r in V.semantic_topk(df, q, 3, exclude_self=True).collect())
    whole = run()
    monkeypatch.setattr(V, "BLOCK_BYTES", 256)
    assert run() == whole and len(whole) == 180


def test_scratch_folder_must_be_shared(spark):
    from citeloom import session

    class Cluster:
        applicationId, master = "x", "spark://host:7077"
        conf = type("Conf", (), {"get": staticmethod(lambda key, default=None: default)})
        getCheckpointDir = staticmethod(lambda: None)

        @property
        def sparkContext(self):
            return self

    with pytest.raises(ValueError):
        session.scratch_dir(Cluster())


def test_text_scan_gives_a_line_to_the_first_listed_pattern(spark):
    elements = spark.createDataFrame([("Thing", "class Thing", "mod", "a.py", 1)], "name string, snippet string, module string, file string, line bigint")
    lines = spark.createDataFrame([("a.py", 5, "x = nn.Zed(self.abc)"), ("a.py", 11, "self.abc"), ("other.py", 1, "nn.Zed"), ("a.py", 12, "nn.Zed")], "file string, line bigint, content string")
    found = lambda patterns: {(r["pattern"], r["line"]) for r in J.tiered_match(elements, elements, lines, patterns).collect() if r["match_tier"] == "text_scan"}
    assert found(["nn.Zed", "self.abc"]) == {("nn.Zed", 5), ("self.abc", 11)}
    assert found(["self.abc", "nn.Zed"]) == {("self.abc", 5), ("nn.Zed", 12)}


def _reached(edges):
    ahead = {}
    for a, b in edges:
        ahead.setdefault(a, set()).add(b)
    out = {}
    for start in ahead:
        level, seen = {start}, {}
        for depth in range(1, 100):
            level = {b for a in level for b in ahead.get(a, ()) if b not in seen}
            seen.update(dict.fromkeys(level, depth))
        out[start] = seen
    return out


def test_reach_counts_on_cyclic_graphs(spark):
    """Counts, depths and components equal a walk from every node: rings, self loops, chains between rings, a hub, random edges."""
    rnd = random.Random(4)
    edges = [(1, 2), (2, 3), (3, 1), (3, 4), (4, 5), (5, 4), (6, 1), (7, 7), (8, 7), (8, 9), (1, 2)]
    edges += [(20, i) for i in range(21, 90)] + [(100 + rnd.randrange(30), 100 + rnd.randrange(30)) for _ in range(38)]
    e = spark.createDataFrame(edges, "src long, dst long")
    want = _reached(edges)
    assert {r["id"]: r["reachable"] for r in G.reach_counts(e).collect()} == {k: len(v) for k, v in want.items()}
    assert {r["id"]: r["depth"] for r in G.eccentricities(e).collect()} == {k: max(v.values()) for k, v in want.items()}
    rings = {}
    for a in want:
        mates = sorted(b for b in want[a] if a in want.get(b, ()))
        if a in mates and len(mates) > 1:
            rings[a] = mates[0]
    assert {r["id"]: r["root"] for r in G.strong_components(e).collect()} == rings


def test_closure_by_layers(spark):
    edges = [(i, j) for i in range(12) for j in (i + 1, i + 5)] + [(100, 3), (100, 7), (200, 201)]
    want = _reached(edges)
    e = spark.createDataFrame(edges, "src long, dst long")
    assert {(r["seed"], r["id"], r["depth"]) for r in G.closure(e).collect()} == {(k, i, d) for k, v in want.items() for i, d in v.items()}
    assert G.reach_counts(spark.createDataFrame([], "src long, dst long")).count() == 0


def test_ball_tree_on_clusters(spark):
    """On clustered vectors most leaves never meet, and what is found equals all pairs."""
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(12, 16))
    m = np.concatenate([c + 0.05 * rng.normal(size=(25, 16)) for c in centres])
    m /= np.linalg.norm(m, axis=1, keepdims=True)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(m)], "vec_id long, embedding array<double>")
    placed, leaves = V.ball_tree(df)
    assert placed.count() == len(m) == leaves["n"].sum()
    compared = V.leaf_pairs(leaves, 0.9, spark).selectExpr("sum(CASE WHEN a = b THEN n_a * (n_a - 1) / 2 ELSE n_a * n_b END)").first()[0]
    assert compared < len(m) ** 2 / 4
    sims = m @ m.T
    np.fill_diagonal(sims, -1)
    want = {(i, j) for i in range(len(m)) for j in np.lexsort((np.arange(len(m)), -sims[i]))[:5].tolist() if sims[i, j] >= 0.9}
    assert {(r["id"], r["other"]) for r in V.neighbours(df, 5, 0.9, block_rows=7).collect()} == want and len(want) > 500
    assert V.neighbours(df.filter("false"), 5, 0.9).count() == 0


def test_truncate_context_keeps_the_separator_before_a_part_outside(spark):
    df = spark.createDataFrame([(1, 0, "user", "abc"), (1, 1, "user", "defg"), (1, 2, "user", "hi")], "k int, pos int, role string, text string")
    whole = "abc\n\ndefg\n\nhi"
    for budget in range(1, len(whole) + 2):
        assert C.truncate_context(df, "k", "pos", "role", "text", ["user"], budget).first()["prompt"] == whole[:budget]


def test_rule_words_end_at_ascii_letters(spark):
    df = spark.createDataFrame([(1, "e del osíra"), (2, "del osx"), (3, "DEL OS."), (4, "ñdel os")], "k int, text string")
    rule = r"\bdel\s+os\b|del\s+sys\b"
    assert rows(R.rule_counts(df, ["k"], "text", {"n": [rule]}).select("k", "n")) == [(1, 1), (2, 0), (3, 1), (4, 1)]
    assert rows(R.rule_findings(df, ["k"], "text", [("r", rule, "error", "m")]).select("k")) == [(1,), (4,)]
    assert R.ascii_edges(r"a\\b") == r"a\\b"


def test_cycles_and_paths_against_enumeration(spark):
    rng = random.Random(11)
    pairs = sorted({(rng.randrange(14), rng.randrange(14)) for _ in range(60)})
    follow = {}
    for a, b in pairs:
        follow.setdefault(a, []).append(b)

    def walk(path, limit, done):
        if len(path) == limit:
            return
        for b in follow.get(path[-1], []):
            if b not in path:
                done.append((*path, b))
                walk((*path, b), limit, done)

    simple = []
    for start in range(14):
        walk((start,), 9, simple)
    e = spark.createDataFrame(pairs, "src bigint, dst bigint")
    loops = [(a,) for a, b in pairs if a == b]
    for length in (2, 3, 4, 5):
        want = loops + [p for p in simple if len(p) <= length and p[0] == min(p) and p[0] in follow.get(p[-1], [])]
        assert sorted(tuple(r["cycle"]) for r in G.find_cycles(e, length).collect()) == sorted(want)
    ends = {p[-1] for p in simple if p[0] == 0} - {0}
    goal = max(ends)

    def first(path):  # a path ends where it first meets the goal
        return goal not in path[:-1]

    assert sorted(tuple(r["path"]) for r in G.all_simple_paths(e, 0, goal, 9).collect()) == sorted(p for p in simple if p[0] == 0 and p[-1] == goal and first(p))


def test_path_and_cycle_queries_keep_their_length():
    import __spark_entry__ as entry

    sql = entry.oracle_sql()
    assert "len(path) <= 9" in sql["all_simple_paths"] and "near.dist < 8" in sql["shortest_path"] and "len(path) <= 5" in sql["find_cycles"]


def test_stream_shards_hold_several_keys_apart(spark):
    """The verdicts of a key do not depend on the keys that share its shard."""
    _, df = usage(spark, 80)
    machine, verdicts = steps.circuit_breaker(2, 60, 2), "allowed boolean, state string"
    events = df.select("event_id", "user_id", F.col("ts").cast("timestamp_ntz").alias("ts"), "ok")
    end = spark.sql("SELECT 9999L AS event_id, 999L AS user_id, TIMESTAMP_NTZ '2100-01-01 00:00:00' AS ts, true AS ok")
    got = run_arrivals([events, end], lambda s: L.run_machine(s, machine, verdicts, ok=F.col("ok"), shards=1))
    assert events.select("user_id").distinct().count() > 1 and rows(got.drop("late")) == rows(P.replay(df, machine, verdicts, key="user_id", ok="ok"))


def test_model_embed_encodes_in_bounded_parts(spark):
    def factory():
        def encode(texts):
            return np.full((len(texts), 2), float(len(texts)))  # every vector tells how many were encoded with it
        return encode

    n = 2 * V.ENCODED_ROWS + 7
    got = spark.range(n, numPartitions=1).select("id", V.model_embed(F.col("id").cast("string"), factory).alias("v")).collect()
    assert sorted(r["id"] for r in got) == list(range(n)) and max(r["v"][0] for r in got) == V.ENCODED_ROWS
    plain = V._default_encoder()
    words = spark.range(n, numPartitions=1).select("id", V.model_embed(F.col("id").cast("string")).alias("v")).collect()
    assert all(r["v"] == plain([str(r["id"])])[0].tolist() for r in words)


def test_graded_graphs(spark):
    """Every edge goes down by one layer: closure, counts and depths equal a walk from every node."""
    rng = random.Random(31)
    pairs = [(10 * u + rng.randrange(8), 10 * u - 10 + rng.randrange(5)) for u in range(1, 5) for _ in range(15)]
    pairs += [(10 * u + k, 10 * u - 10) for u in range(1, 5) for k in range(5)]  # no chain ends early
    e = G.cut_lineage(spark.createDataFrame(pairs, "src long, dst long").distinct())
    assert G._graded(G.cut_lineage(e.union(spark.createDataFrame([(41, 3)], e.schema)))) is None  # passes over layers
    want, up = _reached(pairs), {}
    for met in want.values():
        for d in met:
            up[d] = up.get(d, 0) + 1
    assert {(r.seed, r.id): r.depth for r in G.closure(e).collect()} == {(s, d): n for s, met in want.items() for d, n in met.items()}
    assert {r.id: (r.reachable, r.depth) for r in G.closure_sizes(e, depth_limit=2).collect()} == {s: (len(met), min(2, max(met.values()))) for s, met in want.items()}
    nodes = e.selectExpr("explode(array(src, dst)) AS id").distinct().withColumn("file", F.lit("f"))
    got = {r.id: (r.dependencies, r.dependents, r.depth) for r in G.node_profile(nodes, e).collect()}
    assert got == {i: (len(want.get(i, ())), up.get(i, 0), max(want.get(i, {0: 0}).values())) for i in {x for p in pairs for x in p}}


def test_node_profile_writes_few_tables(spark, monkeypatch):
    written, write = [], G.cut_lineage
    monkeypatch.setattr(G, "cut_lineage", lambda df: written.append(1) or write(df))
    e = spark.createDataFrame([(f"{u}:{k}", f"{u - 1}:{k % 3}") for u in range(1, 5) for k in range(6)], "src string, dst string")
    nodes = e.selectExpr("explode(array(src, dst)) AS id").distinct().withColumn("file", F.lit("f"))
    assert G.node_profile(nodes, e).count() == 27
    assert len(written) < 25  # over 60 when each direction was layered, folded and walked on its own


def test_layers_above_unknown_nodes(spark):
    e = spark.createDataFrame([("a", "b"), ("b", "c"), ("d", "gone"), ("f", "d"), ("x", "y"), ("y", "x"), ("z", "x"), ("x", "c")], "src string, dst string")
    nodes = spark.createDataFrame([(i,) for i in "abcdfxyz"], "id string")
    assert {r.id: r.layer for r in G.topological_layers(nodes, e).collect()} == {"a": 2, "b": 1, "c": 0, "d": None, "f": None, "x": None, "y": None, "z": None}


def test_code_vectors_move_names_once(spark):
    names = [(1, "load data load"), (1, "data"), (2, "load"), (3, "x y z"), (None, "x")]
    df = spark.createDataFrame(names, "k long, name string")
    tokens = F.split("name", " ")
    got = V.hash_embed_code(df, "k", tokens, 64)
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and "Join" not in plan
    want = {}
    for k, name in names:
        parts = name.split(" ")
        for pos, token in enumerate(parts):
            for j in range(8):
                idx = int(hashlib.sha256(token.encode()).hexdigest()[j * 8:j * 8 + 8], 16) % 64
                want[k, idx] = want.get((k, idx), 0.0) + (len(parts) - pos) / len(parts)
    norm = {k: sum(v * v for (o, _), v in want.items() if o == k) ** 0.5 for k, _ in names}
    rows = {(r.k, r.idx): round(r.value, 9) for r in got.collect()}
    assert rows == {(k, i): round(v / norm[k], 9) for (k, i), v in want.items()}


def test_text_vectors_move_texts_once(spark):
    from citeloom.operators import search as Q
    from citeloom.session import dealt

    docs = spark.createDataFrame([(1, "a b a"), (1, "b c"), (2, "c"), (None, "a")], "k long, text string")
    counts = Q.term_counts(dealt(docs, "k", 2), "k", F.split("text", " "))
    for got in (V.hash_embed_signed(counts, "k", 64), V.tfidf_embed(counts, "k", 4)):
        plan = got._jdf.queryExecution().executedPlan().toString()
        assert plan.count("Exchange hashpartitioning") == 1 and "SortMergeJoin" not in plan
    idf = {t: np.log(5 / (d + 1)) + 1 for t, d in (("a", 2), ("b", 1), ("c", 2))}
    w = {(1, "a"): 2 / 5 * idf["a"], (1, "b"): 2 / 5 * idf["b"], (1, "c"): 1 / 5 * idf["c"], (2, "c"): idf["c"], (None, "a"): idf["a"]}
    norm = {k: sum(v * v for (o, _), v in w.items() if o == k) ** 0.5 for k in (1, 2, None)}
    got = {(r.k, "acb"[r.idx]): round(r.value, 9) for r in V.tfidf_embed(counts, "k", 4).collect()}
    assert got == {(k, t): round(v / norm[k], 9) for (k, t), v in w.items()}


def test_failing_modules_look_up_each_candidate_once(spark):
    logs = spark.createDataFrame([(r, "FAILED tests/test_unit1.py::case - boom") for r in range(5)] + [(9, "1 passed"), (None, 'File "/w/src/pkg/unit2.py", line 3')], "run_id long, text string")
    modules = spark.createDataFrame([("m1", "src/pkg/unit1.py", "tests/test_unit1.py"), ("m2", "src/pkg/unit2.py", "tests/test_unit2.py")], "module_id string, file_path string, test_path string")
    got = J.failing_modules(logs, modules)
    assert sorted(map(tuple, got.collect()), key=str) == sorted([*((r, "m1") for r in range(5)), (None, "m2")], key=str)
    assert "Aggregate [candidate#" in got._jdf.queryExecution().optimizedPlan().toString()


def _many_tops():
    pairs = [(f"t{k}", f"m{k % 3}") for k in range(40)] + [("u", "m0"), ("u", "m1")] + [(f"m{k}", f"n{k % 2}") for k in range(3)] + [("n0", "o"), ("n1", "o")]
    return pairs, _reached(pairs)


def _recorded(monkeypatch, column):
    """Row counts of the tables with that column that are written."""
    sizes, write = [], G.cut_lineage

    def spy(df):
        out = write(df)
        if column in out.columns:
            sizes.append(out.count())
        return out

    monkeypatch.setattr(G, "cut_lineage", spy)
    return sizes


def test_lone_tops_need_no_sets(spark, monkeypatch):
    """Nodes with one edge that nothing points to are counted from the node they point to."""
    pairs, want = _many_tops()
    e = spark.createDataFrame(pairs, "src string, dst string")
    sizes = _recorded(monkeypatch, "bits")
    assert {r.id: (r.reachable, r.depth) for r in G.closure_sizes(e).collect()} == {s: (len(met), max(met.values())) for s, met in want.items()}
    assert max(sizes) < 15  # 48 and more when every top had its sets
    assert {(r.seed, r.id): r.depth for r in G.closure(e).collect()} == {(s, d): n for s, met in want.items() for d, n in met.items()}


def test_layer_rounds_leave_out_tops(spark, monkeypatch):
    pairs, want = _many_tops()
    e = G.cut_lineage(spark.createDataFrame(pairs, "src string, dst string"))
    sizes = _recorded(monkeypatch, "id")
    heights, stuck = G._heights(e)
    assert stuck is None and {r.id: r.layer for r in heights.collect()} == {s: max(met.values()) for s, met in want.items()}
    assert max(sizes) == 5  # 46 in the first round before
    assert {r.id for r in G._heights(G.cut_lineage(e.union(spark.createDataFrame([("o", "n1")], e.schema))))[1].collect()} == set(want) | {"o"}


def test_pagerank_rounds_leave_out_tops(spark, monkeypatch):
    pairs, _ = _many_tops()
    e = spark.createDataFrame(pairs, "src string, dst string")
    ids = sorted({x for p in pairs for x in p})
    out = {i: sum(s == i for s, _ in pairs) for i in ids}
    sizes = _recorded(monkeypatch, "rank")
    nodes = spark.createDataFrame([(i,) for i in ids], "id string")
    for rounds in (0, 1, 2, 50):
        want = {i: 1 / len(ids) for i in ids}
        for _ in range(rounds):
            want = {i: 0.15 / len(ids) + 0.85 * sum(want[s] / out[s] for s, d in pairs if d == i) for i in ids}
        got = {r.id: r["rank"] for r in G.pagerank(nodes, e, iterations=rounds).collect()}
        assert got == pytest.approx(want, rel=1e-12)
    assert max(sizes) == 6  # all 47 nodes before


def test_small_leaves_meet_in_packs(spark, monkeypatch):
    """Leaves are put together up to a block, so a vector is sent to few blocks; the neighbours are those of all pairs."""
    assert V._packed(np.array([3, 4, 2, 9, 1, 5]), 7).tolist() == [0, 0, 1, 2, 3, 3]
    rng = np.random.default_rng(18)
    m = rng.normal(size=(300, 8))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(m)], "vec_id long, embedding array<double>")
    tables, write = [], V.cut_lineage

    def spy(frame):
        out = write(frame)
        tables.append((set(out.columns), out))
        return out

    monkeypatch.setattr(V, "cut_lineage", spy)
    got = {(r["id"], r["other"]) for r in V.neighbours(df, 5, 0.35, block_rows=100).collect()}
    u = m / np.linalg.norm(m, axis=1, keepdims=True)
    sims = u @ u.T - 2 * np.eye(300)
    want = {(i, int(j)) for i in range(300) for j in np.argsort(-sims[i])[:5] if sims[i, j] >= 0.35}
    assert got == want
    met = next(t for columns, t in tables if columns == {"a", "i", "b", "j"})
    assert met.count() <= 15  # each two of the leaves met on their own before


def test_neighbours_sort_only_what_may_be_near(spark):
    """Few pairs of a product are looked at again, also in a tight group with copies, and the vectors travel as they are given."""
    rng = np.random.default_rng(34)
    m = np.concatenate([rng.normal(size=16) + 0.3 * rng.normal(size=(1100, 16)), rng.normal(size=(100, 16))])
    m[100:150] = m[100]
    m = m.astype(np.float32)
    u = m.astype(float) / np.linalg.norm(m.astype(float), axis=1, keepdims=True)
    ids = np.arange(len(m))
    sims = np.round(u @ u.T, 12) - 3 * np.eye(len(m))
    want = {(i, j) for i in range(len(m)) for j in np.lexsort((ids, -sims[i]))[:5].tolist() if sims[i, j] >= 0.35}
    assert sum(len(r) for r, _ in V._close(ids, u, ids, u, 5, 0.35)) < len(m) ** 2 / 10 < (sims >= 0.35).sum() / 4
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(m)], "vec_id long, embedding array<float>")
    assert dict(V.ball_tree(df)[0].dtypes)["embedding"] == "array<float>"
    assert {(r["id"], r["other"]) for r in V.neighbours(df, 5, 0.35).collect()} == want
    assert {(r["id"], r["other"]) for r in V.neighbours(df, 5, 0.35, block_rows=100).collect()} == want


def test_consolidation_sends_no_texts_of_pairs_ruled_out(spark, monkeypatch):
    """Pairs that share a rare word, but whose signatures differ by too much, never leave the join; a memory with a similar one needs one pair."""
    rng = np.random.default_rng(5)
    text = lambda i: " ".join(["rare"] * (i % 2) + [f"w{x}" for x in rng.choice(4000, 24, replace=False)])
    rows = [(i, "episodic", 3, 3, text(i)) for i in range(40)] + [(1000 + i, "semantic", 0, 0, text(i)) for i in range(40)]
    rows += [(2000 + 40 * j + i, "semantic", 0, 0, rows[i][4] + f" more{j}") for i in range(8) for j in range(3)]  # rows 0 to 7 have similar ones
    rows += [(90, "episodic", 3, 3, rows[9][4]), (91, "episodic", 3, 3, rows[3][4].upper()), (92, "episodic", 3, 3, None), (93, "episodic", 3, 3, " "), (94, "episodic", 2, 3, "low")]
    df = spark.createDataFrame(rows, "id long, memory_type string, access_count long, importance int, content string")
    tables, write = [], E.cut_lineage

    def spy(frame):
        out = write(frame)
        tables.append((set(out.columns), out))
        return out

    monkeypatch.setattr(E, "cut_lineage", spy)
    got = sorted(r["id"] for r in E.consolidation_candidates(df).collect())
    words = {i: set((t or "").lower().split()) for i, _, _, _, t in rows}
    near = lambda i: any(i != j and len(words[i] & words[j]) >= 0.8 * len(words[i]) for j, kind, *_ in rows if kind == "semantic")
    assert got == [i for i, kind, n, *_ in rows if kind == "episodic" and n >= 3 and (not words[i] or not near(i))]
    assert sorted(set(range(40)) - set(got)) == list(range(8)) and 91 not in got
    pairs = next(t for columns, t in tables if columns == {"id", "sid", "absent"})
    assert pairs.count() <= 8 * 3 + 8 * 4 + 4  # 400 and more share the word "rare"


def test_impact_walks_only_what_is_pointed_to(spark, monkeypatch):
    walked, walks = [], G._walks
    monkeypatch.setattr(G, "_walks", lambda e: walked.append(e.count()) or walks(e))
    rows = [(f"p{i}", f"s{j}") for i in range(60) for j in {i % 4, i % 3}] + [(f"s{j}", f"n{j % 2}") for j in range(4)] + [("n0", "r"), ("n1", "r")]
    e = spark.createDataFrame(rows, "src string, dst string")
    got = {r.id: (r.direct, r.transitive, r.impact, r.critical) for r in G.impact_scores(e).collect()}
    below = {}
    for s, d in rows:
        below.setdefault(d, set()).add(s)
    reach = lambda v: set().union(*({u} | reach(u) for u in below.get(v, ())))
    assert got == {v: (len(below[v]), len(reach(v)), len(below[v]) + len(reach(v)) / 2, len(below[v]) + len(reach(v)) / 2 >= 5) for v in below}
    assert walked == [6]  # 109 of the 111 edges when layers were found on the graph turned over
