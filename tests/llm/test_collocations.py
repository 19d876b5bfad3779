import random
import re
from collections import Counter, defaultdict

import pytest

from citeloom.llm import collocations
from citeloom.llm.collocations import mine_collocations

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute_force(rows, min_count=10, covered=50, top=2000):
    f = defaultdict(Counter)
    for text, lang in rows:
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(LOWER)):
            words = re.findall(r"[^\x20\x09]+", piece)
            for k in (1, 2, 3):
                f[lang or "und"].update(tuple(words[i:i + k]) for i in range(len(words) - k + 1))
    out = []
    for lang, counts in f.items():
        n = sum(c for p, c in counts.items() if len(p) == 1)
        found = []
        for p, a in counts.items():
            if len(p) > 1 and a >= min_count:
                score, _, l, r = min((1000000 * a * a // (counts[p[:k]] * counts[p[k:]]), k, counts[p[:k]], counts[p[k:]]) for k in range(1, len(p)))
                if len(p) == 2 and any(len(q) == 3 and c >= min_count and p in (q[:2], q[1:]) and 100 * c >= covered * a for q, c in counts.items()):
                    continue
                found.append((-score, -a, " ".join(p).encode(), l, r))
        out += [(lang, i + 1, p.decode(), -a, l, r, n, -s) for i, (s, a, p, l, r) in enumerate(sorted(found)[:top])]
    return sorted(out)


def some_rows(n=300):
    rnd = random.Random(3)
    words = ["the", "of", "De", "la", "ab", "ab\x01", "x", "É", "é", "日本", "\U0001f600", "a b", "\x1c", *"abcdefgh"]
    weights = [40, 20, 20, 10, *[3] * (len(words) - 4)]
    rows = []
    for i in range(n):
        sep = lambda: rnd.choice([" "] * 12 + ["  ", "\t", ". ", ",", "\n", "\r\n", "; "])
        rows.append(("".join(w + sep() for w in rnd.choices(words, weights, k=rnd.randint(0, 60))), rnd.choice(["en", "en", "en", "de", None])))
    return rows + [(None, "en"), ("", None), (" \t", "fr"), ("new york city " * 15, "en"), ("same row. " * 2, "en"), ("same row. " * 2, "en"), ("z " * 30_000, "de")]


def docs_of(spark, rows):
    return spark.createDataFrame([(t, lang, 1, 2.0, "x") for t, lang in rows], "text string, lang string, n long, score double, phrase string").repartition(5)


@pytest.mark.parametrize("small", [False, True])
def test_brute_force(spark, monkeypatch, small):
    if small:  # bursts, spills, emptied vocabularies, blocks and batches of a few rows
        for name, value in {"PENDING_WINDOWS": 20, "BURST_ENTRIES": 33, "TRIE_ENTRIES": 40, "TRIE_WORDS": 15, "BLOCK_WORDS": 6, "SLICE_BYTES": 50, "RUN_ROWS": 7}.items():
            monkeypatch.setattr(collocations, name, value)
        monkeypatch.setattr(collocations.phrase_counts, "__defaults__", (10, 20))
        monkeypatch.setattr(collocations.phrase_filter, "__defaults__", (64,))  # a full filter
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "11")
    rows = some_rows()
    try:
        got = sorted(tuple(r) for r in mine_collocations(docs_of(spark, rows)).collect())
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert got == brute_force(rows) and len(got) > 20


def test_top_and_empty(spark):
    rows = some_rows(120)
    got = sorted(tuple(r) for r in mine_collocations(docs_of(spark, rows), min_count=5, covered_percent=80, top=7).collect())
    assert got == brute_force(rows, 5, 80, 7)
    assert mine_collocations(docs_of(spark, rows).where("false")).count() == 0
    assert mine_collocations(docs_of(spark, [("one two", "en")])).count() == 0


def test_counts_beyond_64_bits(spark):
    """The score's products pass 64 bits."""
    value = "(cast(1000000 as decimal(7,0)) * cast(a as decimal(15,0)) * cast(a as decimal(15,0))) div (cast(l as decimal(15,0)) * cast(r as decimal(15,0)))"
    a, l, r = 98_765_432_101, 123_456_789_012_345, 98_765_432_109
    assert spark.createDataFrame([(a, l, r)], "a long, l long, r long").selectExpr(value).first()[0] == 1000000 * a * a // (l * r)
