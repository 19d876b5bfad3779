import numpy as np
from pyspark.sql import functions as F

from citeloom.llm.mixing import DIMENSIONS, cell_tokens, marginals, mix_sources, rake, token_weights


def corpus(make_docs):
    rng = np.random.default_rng(0)
    rows = []
    for i in range(400):
        source = "hot" if i % 3 == 0 else f"s{rng.integers(4)}"
        rows.append((i, "w " * int(rng.integers(20, 1500)) + ("| a " * 60 if i % 7 == 0 else ""), str(rng.choice(["en", "de", "fr"], p=[0.7, 0.2, 0.1])), source))
    return make_docs(rows)


def brute(cells, targets, rounds=200):
    table = {k: float(v) for k, v in cells.items()}
    for _ in range(rounds):
        for d in range(3):
            have = {}
            for k, w in table.items():
                have[k[d]] = have.get(k[d], 0) + w
            total = sum(t for v, t in targets[d].items() if v in have)
            table = {k: w * targets[d].get(k[d], 0) / total / have[k[d]] if have[k[d]] else 0.0 for k, w in table.items()}
    return table


def test_probabilities_match_brute_force(spark, make_docs):
    docs = corpus(make_docs)
    cells = {(r.source, r.lang, r.topic): r.tokens for r in cell_tokens(token_weights(docs)).collect()}
    targets = [{"hot": 1.0, "s0": 1.0, "s1": 2.0, "s2": 1.0, "s3": 1.0, "absent": 9.0}, {"en": 5.0, "de": 3.0, "fr": 2.0}, {t: 1.0 for t in {k[2] for k in cells}}]
    tables = {d: spark.createDataFrame(list(t.items()), f"{d} string, target double") for d, t in zip(DIMENSIONS, targets)}
    want = brute(cells, targets)
    top = max(want[k] / cells[k] for k in cells)
    mixed = mix_sources(docs, tables, tolerance=1e-9)
    for r in mixed.select("_source", "_lang", "_topic", "_probability").distinct().collect():
        key = (r._source, r._lang, r._topic)
        assert np.isclose(r._probability, want[key] / cells[key] / top, rtol=1e-5)
    # The expected token mix of the sample meets the targets.
    expected = mixed.groupBy("_source").agg(F.sum(F.col("_probability") * F.col("_tokens")).alias("w")).collect()
    total = sum(r.w for r in expected)
    assert all(np.isclose(r.w / total, targets[0][r._source] / 6, rtol=1e-4) for r in expected)
    assert mixed.where("_sampled <> (_probability > 0 and _sampled)").count() == 0
    again = mix_sources(docs, tables, tolerance=1e-9).where("_sampled").select("doc_id").collect()
    assert sorted(again) == sorted(mixed.where("_sampled").select("doc_id").collect())


def test_raked_marginals(spark, make_docs):
    cells = cell_tokens(token_weights(corpus(make_docs)))
    lang = spark.createDataFrame([("en", 1.0), ("de", 1.0), ("fr", 2.0)], "lang string, target double")
    got = {r.lang: r.share for r in marginals(cells, rake(cells, {"lang": lang}), "lang").collect()}
    assert np.allclose([got["en"], got["de"], got["fr"]], [0.25, 0.25, 0.5], atol=1e-4)


def test_nulls_empty_texts_and_tables(spark, make_docs):
    docs = make_docs([(1, None, None, None), (2, "", "en", "a"), (3, "some words here", None, "a"), (None, "more words " * 300, "en", None), (3, "some words here", None, "a"), (5, "x " * 60000, "en", "a")])
    mixed = mix_sources(docs)
    assert mixed.count() == 6 and mixed.where("_probability is null or _probability < 0 or _probability > 1").count() == 0
    assert mixed.where("doc_id = 3").select("_sampled").distinct().count() == 1
    assert mix_sources(docs.where("false")).count() == 0 and mix_sources(docs.where("doc_id < 3")).where("_sampled").count() == 0
