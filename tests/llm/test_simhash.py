import random

import numpy as np
import xxhash

from citeloom.operators.components import connected_components
from citeloom.llm.simhash import keep_one_of_each, near_duplicates, near_links, parity, parity_distance, similar_links, simhash, shingle_hashes


def brute_print(text):
    words = (text or "").encode().lower().split()
    shingles = [b" ".join(words[k:k + 3]) for k in range(max(1, len(words) - 2))] if words else []
    hashes = [xxhash.xxh64_intdigest(s, seed=42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def components(values, linked):
    parent = list(range(len(values)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(values)):
        for j in range(i):
            if linked(values[i], values[j]):
                parent[find(i)] = find(j)
    return [find(i) for i in range(len(values))]


def test_fingerprint():
    for text in ("", "a", "A b", "x Y z", "one two three four five six", "É é\tÀ\x0bq  r", "w " * 500):
        assert simhash(shingle_hashes(text.encode())) == brute_print(text)


def test_links_are_complete(spark):
    rng = random.Random(4)
    values = {0}
    for _ in range(60):
        v = rng.getrandbits(64)
        values.add(v)
        for _ in range(4):
            for b in rng.sample(range(64), rng.randint(1, 4)):
                v ^= 1 << b
            values.add(v)
    values = sorted(values)
    signed = [int(np.uint64(v).astype(np.int64)) for v in values]
    got = {tuple(r) for r in near_links(spark.createDataFrame([(v,) for v in signed], "fp long")).collect()}
    want = {tuple(sorted((signed[i], signed[j]))) for i in range(len(values)) for j in range(i) if (values[i] ^ values[j]).bit_count() <= 3}
    assert got == want and len(want) > 50


def test_near_duplicates(spark, make_docs):
    rng = random.Random(1)
    words = [f"w{i}" for i in range(300)]
    base = [rng.choice(words) for _ in range(400)]
    rows = [(5, None), (3, ""), (9, " \n"), (None, "lone text here"), (7, "a b"), (7, "c d"), (2, "a  B"), (11, "x" * 50000)]
    for i in range(20):
        copy = list(base)
        copy[rng.randrange(400)] = "changed"
        rows.append((100 + i, " ".join(copy if i % 3 else base)))
    prints = [brute_print(t) for _, t in rows]
    group = components(prints, lambda a, b: (a ^ b).bit_count() <= 3)
    smallest = {g: min((rows[i][0] for i in range(len(rows)) if group[i] == g and rows[i][0] is not None), default=None) for g in group}
    want = sorted((str(rows[i][0]), prints[i], str(smallest[group[i]])) for i in range(len(rows)))
    got = sorted((str(r.doc_id), r.fp % (1 << 64), str(r.component_id)) for r in near_duplicates(make_docs(rows)).collect())
    assert got == want
    assert near_duplicates(make_docs(rows).where("false")).count() == 0


def test_keep_one(spark, make_docs):
    rng = random.Random(2)
    one = [f"t{rng.randrange(500)}" for _ in range(200)]
    two = [*one[:100], "new", *one[101:]]
    rows = [(4, " ".join(one)), (2, " ".join(two)), (8, " ".join(one)), (8, " ".join(one)), (1, "other words that stand alone here"), (None, " ".join(one)), (None, "no id"), (6, None), (5, "")]
    kept = keep_one_of_each(make_docs(rows))
    assert sorted((str(r.doc_id), r.text) for r in kept.collect()) == sorted([("2", " ".join(two)), ("1", rows[4][1]), ("None", "no id"), ("5", "")])
    assert kept.columns == make_docs(rows).columns


def test_components_of_a_long_chain(spark):
    n = 200
    order = list(range(n))
    random.Random(3).shuffle(order)
    links = [(order[i], order[i + 1]) for i in range(n - 1)] + [(500, 501), (7, 7)]
    got = {r.node: r.root for r in connected_components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(n)}, 500: 500, 501: 500}


def test_members_that_no_head_links(spark, make_docs):
    rng = random.Random(5)
    fresh = iter(range(10**7))

    def unique(n):
        return [f"u{next(fresh)}" for _ in range(n)]

    passage = unique(870)
    rows = [(1000 + i, " ".join(passage + unique(130))) for i in range(150)]
    # Pairs of 1,000 words that share the passage and 70 words more (0.88), among other holders of the passage (0.77).
    for k in range(12):
        common = unique(70)
        rows += [(2 * k + i, " ".join(passage + common + unique(60))) for i in range(2)]
    docs = make_docs(rows)
    node = {r.doc_id: r.node for r in docs.selectExpr("doc_id", "xxhash64(text) as node").collect()}
    got = {tuple(sorted(r)) for r in similar_links(docs).collect()}
    assert got == {tuple(sorted((node[2 * k], node[2 * k + 1]))) for k in range(12)}


def test_a_hot_line_joins_no_other_texts(spark, make_docs):
    line = "this one line comes again and again in both texts now\n"
    rows = [(i, line * 3000 + " ".join(f"w{i}x{k}" for k in range(1000))) for i in range(2)]
    a, b = (brute_print(t) for _, t in rows)
    assert (a ^ b).bit_count() <= 3
    rows += [(2, line * 20 + rows[0][1]), (5, None), (4, " \v\n"), (3, "\u00a0")]
    assert sorted(r.doc_id for r in keep_one_of_each(make_docs(rows)).collect()) == [0, 1, 3, 4]


def test_shingles_that_several_texts_hold(spark):
    from citeloom.llm.simhash import _shared

    rng = random.Random(6)
    rows = [(rng.randrange(40), rng.randrange(6), 0) for _ in range(120)] + [(100, 1, 0)] * 30 + [(101, k % 2, 0) for k in range(30)]
    nodes = {}
    for s, n, _ in rows:
        nodes.setdefault(s, set()).add(n)
    want = sorted((s, n, 0) for s, held in nodes.items() if len(held) > 1 for n in held)
    df = spark.createDataFrame(rows, "shingle long, node long, packed long")
    for size in ("3", "10000"):
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", size)
        assert sorted(map(tuple, _shared(df).collect())) == want
    spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_parity_distance_is_a_lower_bound():
    rng = np.random.default_rng(8)
    for n, m, common in [(1, 1, 1), (1, 0, 0), (300, 320, 290), (511, 514, 480), (512, 513, 512), (1000, 1100, 990), (5000, 900, 0), (3000, 3000, 2900)]:
        both, x, y = (rng.integers(0, 2**63, k).astype(np.uint64) for k in (common, n - common, m - common))
        a, b = (parity(np.concatenate([both, own])) for own in (x, y))
        apart = len(x) + len(y)
        short = int(np.bitwise_count((a[1] ^ b[1]).view(np.uint64)).sum())
        assert short <= apart and parity_distance(a[0], b[0]) <= apart and parity_distance(a[0], b[0]) == parity_distance(b[0], a[0])
        assert (apart - short) % 2 == 0 and (apart > 20 or parity_distance(a[0], b[0]) > 0 or not apart)
    assert parity_distance(parity(both)[0], parity(both)[0]) == 0


def test_pairs_around_the_threshold(spark, make_docs):
    rng, rows = random.Random(9), []
    for k, n in enumerate([30, 120, 400, 520, 700, 1100, 2100] * 3):
        words = [f"g{k}w{i}" for i in range(n)]
        rows.append((10 * k, " ".join(words)))
        for copy in range(1, 5):  # several end close to 0.8
            other = list(words)
            for i in rng.sample(range(n), max(1, int(n * 0.024 * rng.uniform(0.6, 1.4)))):
                other[i] = f"g{k}c{copy}x{i}"
            rows.append((10 * k + copy, " ".join(other)))
    docs = make_docs(rows)
    node = {r.doc_id: r.node for r in docs.selectExpr("doc_id", "xxhash64(text) as node").collect()}
    sets = {node[i]: set(shingle_hashes(t.encode(), 5).tolist()) for i, t in rows}

    def similar(x, y):
        return len(sets[x] & sets[y]) >= 0.8 * len(sets[x] | sets[y])

    want = {(x, y) for x in sets for y in sets if x < y and similar(x, y)}
    apart = [(node[10 * k + a], node[10 * k + b]) for k in range(21) for a in range(5) for b in range(a) if not similar(node[10 * k + a], node[10 * k + b])]
    links = [tuple(sorted(r)) for r in similar_links(docs).collect()]
    assert set(links) <= want and len(apart) > 20
    roots = lambda pairs: {tuple(r) for r in connected_components(spark.createDataFrame(sorted(pairs), "a long, b long")).collect()}
    assert roots(links) == roots(want)


def test_the_operators_links_come_first(spark, make_docs, monkeypatch):
    import citeloom.llm.simhash as module

    rng, rows = random.Random(11), []
    for k in range(6):
        words = [f"k{k}w{i}" for i in range(600)]
        for copy in range(4):
            other = list(words)
            if copy:
                other[rng.randrange(600)] = f"k{k}c{copy}"
            rows.append((10 * k + copy, " ".join(other)))
    rows += [(90, None), (91, " \n")]
    docs = make_docs(rows)
    prints = {i: brute_print(t) for i, t in rows[:24]}
    node = {r.doc_id: r.node for r in docs.selectExpr("doc_id", "xxhash64(text) as node").collect()}
    near = {frozenset((node[x], node[y])) for x in prints for y in prints if x != y and (prints[x] ^ prints[y]).bit_count() <= 3}
    pairs = [frozenset(r) for r in module.fingerprint_pairs(docs).collect()]
    assert near and set(pairs) <= near and len(pairs) <= 48 and {n for p in near for n in p} == {n for p in pairs for n in p}
    asked = []
    monkeypatch.setattr(module, "near_links", lambda *a: asked.append(a) or near_links(*a))
    assert sorted(r.doc_id for r in keep_one_of_each(docs).collect()) == [0, 10, 20, 30, 40, 50, 90] and asked


def test_shingles_of_all_texts_set_their_order(spark, make_docs):
    """Shingles that three of 9,000 texts hold come after those of one text, wherever the three are."""
    from citeloom.llm.simhash import BUCKET_BITS, _levels, prefixes

    rows = [(i, " ".join([f"g{i // 3}w{k}" for k in range(14)] + [f"u{i}w{k}" for k in range(40)])) for i in range(9000)]
    docs = make_docs(rows)
    held = {}
    for i, text in rows:
        for h in np.unique(shingle_hashes(text.encode(), 5)).tolist():
            held[h] = held.get(h, 0) + 1
    buckets = np.bincount(np.repeat(np.array(list(held), np.uint64) >> np.uint64(64 - BUCKET_BITS), list(held.values())).astype(np.int64), minlength=1 << BUCKET_BITS)
    assert (_levels(docs, 5) == np.round(8 * np.log2(1 + buckets))).all()
    assert all(held[r.shingle % (1 << 64)] == 1 for r in prefixes(docs, 5, 0.8).select("shingle").collect())
