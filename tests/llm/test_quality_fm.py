import numpy as np

from citeloom.llm.quality_fm import FactorisationMachine, FeatureMaker, N_FEATURES, fit_quality, score_quality


def naive(model, pairs):
    total = model.bias + sum(model.weights[f] * x for f, x in pairs)
    for i in range(len(pairs)):
        for j in range(i):
            total += (model.factors[pairs[i][0]] @ model.factors[pairs[j][0]]) * pairs[i][1] * pairs[j][1]
    return total


def test_linear_time_score_equals_pairwise_sum():
    rng = np.random.default_rng(0)
    model = FactorisationMachine(0.3, rng.normal(size=N_FEATURES), rng.normal(size=(N_FEATURES, 4)))
    texts = [b"", b"one two three two", b"### ||| !!!", b"a" * 5000]
    rows, features, values = FeatureMaker().rows(texts)
    got = model.margins(rows, features, values, len(texts))
    for i in range(len(texts)):
        assert np.isclose(got[i], naive(model, [(f, x) for r, f, x in zip(rows, features, values) if r == i]))


def sample(n):
    rng = np.random.default_rng(5)
    words = [f"word{i}" for i in range(200)]
    rows = []
    for i in range(n):
        good = i % 4 != 0
        text = " ".join(rng.choice(words, 80)) if good else " ".join(f"{w}$$$ ||" for w in rng.choice(words, 60)) if i % 8 else "Same " * 90
        rows.append((i, text, int(good)))
    return rows


def test_learns_and_scores_every_row(spark, make_docs):
    rows = sample(240)
    docs = make_docs([(i, t) for i, t, _ in rows] + [(900, None), (901, ""), (None, "word1"), (5, "dup"), (902, "x" * 100000)])
    labels = spark.createDataFrame([(i, q, 0) for i, _, q in rows] + [(None, 1, 0), (3, None, 0), (7, 0, 0), (7, 1, 0)], "doc_id long, quality int, toxic int")
    scored = score_quality(docs, fit_quality(docs, labels))
    got = scored.select("doc_id", "fm_score").collect()  # the name score is taken by an extra column
    assert len(got) == docs.count() and all(0 <= r.fm_score <= 1 for r in got)
    right = [(r.fm_score >= 0.3) == bool(q) for r in got for i, _, q in rows if r.doc_id == i and i != 7]
    assert np.mean(right) > 0.97


def test_one_class_no_labels_empty(spark, make_docs):
    docs = make_docs([(1, "a b c"), (2, None)])
    for rows in ([], [(1, 1, 0)]):
        labels = spark.createDataFrame(rows, "doc_id long, quality int, toxic int")
        assert score_quality(docs, fit_quality(docs, labels)).count() == 2
    assert score_quality(docs.where("false"), fit_quality(docs, labels)).count() == 0
