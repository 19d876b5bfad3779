import random

import pytest

from citeloom.llm.repeated_text import anchors, remove_repeated


def brute(texts, length):
    seen = {}
    for t in texts:
        for i in range(len(t) - length + 1):
            seen[t[i:i + length]] = seen.get(t[i:i + length], 0) + 1
    out = []
    for t in texts:
        cover = bytearray(len(t))
        for i in range(len(t) - length + 1):
            if seen[t[i:i + length]] > 1:
                cover[i:i + length] = b"\1" * length
        spans = sum(1 for i in range(len(t)) if cover[i] and (i == 0 or not cover[i - 1]))
        out.append((bytes(c for c, x in zip(t, cover) if not x), len(t), sum(cover), spans))
    return out


def texts(length):
    rng = random.Random(length)
    word = lambda: "".join(rng.choice("abcdeé ") for _ in range(rng.randint(3, 9)))
    prose = lambda n: " ".join(word() for _ in range(n))
    passage, other = prose(length // 3), prose(length // 4)
    out = ["", None, "short", prose(200), "a" * (4 * length), "ab" * length, "a" * length, passage, passage[:-1]]
    out += [prose(rng.randint(1, 40)) + passage + prose(rng.randint(1, 40)) for _ in range(12)]
    out += [prose(20) + other + prose(3) + other + prose(20)]  # within one text
    base = prose(300)
    out += [base, base, base[:700] + "X" + base[701:], base[5:], "é" + base[:400]]
    out += [passage[k:k + length] for k in range(0, 12, 3)]
    return out


@pytest.mark.parametrize(("length", "options"), [(200, {}), (40, {}), (64, {"chunk": 5}), (64, {"max_group": 2})])
def test_matches_brute_force(spark, make_docs, length, options):
    rows = list(enumerate(texts(length)))
    want = brute([(t or "").encode() for _, t in rows], length)
    got = {r.doc_id: (bytes(r.kept), r.n_bytes, r.n_removed, r.n_spans) for r in remove_repeated(make_docs(rows), length, **options).collect()}
    assert [got[i] for i, _ in rows] == want


def test_repeated_rows_null_ids_and_empty_table(spark, make_docs):
    long = "".join(chr(97 + (i * i + i // 7) % 26) for i in range(500))
    docs = make_docs([(1, long), (1, long), (None, "once " + long[:150]), (2, "tiny"), (2, "tiny")])
    got = sorted((r.n_bytes, r.n_removed, r.n_spans) for r in remove_repeated(docs).collect())
    assert got == [(4, 0, 0), (4, 0, 0), (155, 0, 0), (500, 500, 1), (500, 500, 1)]
    assert remove_repeated(docs.where("false")).count() == 0


def test_anchors_of_long_texts_are_local():
    rng = random.Random(9)
    text = bytes(rng.randrange(97, 123) for _ in range(2_300_000))
    places, hashes = anchors(text)
    assert all(b - a <= 169 for a, b in zip(places.tolist(), places[1:].tolist()))
    part, part_hashes = anchors(text[1_000_000:1_200_000])
    inner = [(p + 1_000_000, h) for p, h in zip(part.tolist(), part_hashes.tolist()) if 200 < p < 199_700]
    assert set(inner) <= set(zip(places.tolist(), hashes.tolist()))
