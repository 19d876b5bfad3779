import math
import random
import re
from collections import Counter

import pytest

from citeloom.llm import lexical_index
from citeloom.llm.lexical_index import build_index, search

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def terms(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", (text or "").translate(LOWER))


def brute_force(docs, items, k=10):
    held = [(i, Counter(t), len(t)) for i, t in ((i, terms(x)) for i, x in docs) if t]
    n_docs, n_terms = len(held), sum(n for *_, n in held)
    df = Counter(t for _, c, _ in held for t in c)
    asked = {}
    for item, text in items:
        asked.setdefault(item, []).extend(terms(text))
    out = []
    for item, ts in asked.items():
        scores = []
        for i, c, n in held:
            m = 25 + 75 * n * n_docs // n_terms
            s = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 8 * m)) for t in ts if t in c)
            if s > 0:
                scores.append((-s, i is not None, i or 0, i))
        out += [(item, rank + 1, x[3], -x[0]) for rank, x in enumerate(sorted(scores)[:k])]
    return sorted(out, key=str)


def some_docs(n=400):
    rnd = random.Random(8)
    words = ["the", "of", "Ab", "é", "日本", "x1", *(f"w{i}" for i in range(200))]
    weights = [60, 30, 10, 5, 5, 5, *[1] * 200]
    text = lambda: "".join(w + rnd.choice(" \n,.-\x7f_") for w in rnd.choices(words, weights, k=rnd.choice([1, 5, 5, 5, 20, 90])))
    docs = [(i, text()) for i in range(n)]
    docs += [(5, docs[7][1]), (None, docs[9][1]), (None, docs[9][1]), (900, None), (901, ""), (902, " ._"), *((1000 + i, docs[3][1]) for i in range(60)), (2000, "w1 " * 40_000)]
    items = [(i, text()) for i in range(25)] + [(3, "the the w5"), (None, "w7 w8"), (50, None), (51, ""), (52, "unseen words"), (53, docs[3][1])]
    return docs, items


def frames(make_docs, spark, docs, items):
    return make_docs(docs, parts=6), spark.createDataFrame([(i, t, "m", 3) for i, t in items], "item_id long, text string, term string, m int")


@pytest.mark.parametrize("small", [False, True])
def test_brute_force(spark, make_docs, monkeypatch, small):
    if small:
        for name, value in {"CHUNK_DOCS": 7, "CHUNK_POSTINGS": 60, "BLOCK_ITEMS": 13, "BROADCAST_BYTES": 0, "BROADCAST_STRATA": 0, "PART_TERMS": 90}.items():
            monkeypatch.setattr(lexical_index, name, value)
    docs, items = some_docs()
    d, q = frames(make_docs, spark, docs, items)
    index = build_index(d)
    got = sorted((tuple(r) for r in search(index, q).collect()), key=str)
    assert got == brute_force(docs, items)
    if not small:
        assert sorted((tuple(r) for r in search(index, q, k=3).collect()), key=str) == brute_force(docs, items, 3)


def test_index_rows(spark, make_docs):
    docs, items = some_docs(60)
    index = build_index(frames(make_docs, spark, docs, items)[0])
    assert index.n_docs == sum(bool(terms(t)) for _, t in docs) and index.n_terms == sum(len(terms(t)) for _, t in docs)
    rows = index.postings.collect()
    assert sum(len(r.docs) for r in rows if r.term) == sum(len(set(terms(t))) for _, t in docs)
    assert all(r.docs == sorted(r.docs) for r in rows if r.term)


def test_empty_tables(spark, make_docs):
    docs, items = some_docs(20)
    d, q = frames(make_docs, spark, docs, items)
    assert search(build_index(d.where("false")), q).count() == 0
    assert search(build_index(d), q.where("false")).count() == 0
