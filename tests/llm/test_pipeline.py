"""Every stage of the pipeline against a brute-force version, on a small corpus with edge rows."""

import zlib

import numpy as np
import pytest
from tokenizers import Tokenizer

import corpus_pipeline
from citeloom.llm.quality_fm import FeatureMaker, fit_quality
from citeloom.llm.queries import word_vocabulary
from citeloom.llm.simhash import shingle_hashes

SF_DIR = "/root/testdata/sf0.001"
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("sf"))
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    bench = spark.read.parquet(f"{SF_DIR}/benchmark.parquet")
    labels = spark.read.parquet(f"{SF_DIR}/labels.parquet")
    item = bench.orderBy("item_id").first().text
    odd = [(900, None, "en", "a", 0), (901, "", None, None, None), (902, docs.first().text, "en", "a", 1), (903, "Some lead. " + item + " And some more words.", "en", "b", 1), (None, "a text without an id " * 30, "en", "b", 1),
           (904, docs.first().text + " one more", "de", None, 1), (905, "long words here and there " * 20000, "en", "a", 1)]
    docs.select(*COLUMNS).union(spark.createDataFrame(odd, docs.select(*COLUMNS).schema)).write.parquet(f"{folder}/documents.parquet")
    bench.write.parquet(f"{folder}/benchmark.parquet")
    labels.write.parquet(f"{folder}/labels.parquet")
    return folder


@pytest.fixture(scope="module")
def stages(spark, corpus, tmp_path_factory):
    """Rows before the first and after each stage."""
    out = [spark.read.parquet(f"{corpus}/documents.parquet")]
    for name, stage in corpus_pipeline.STAGES:
        path = str(tmp_path_factory.mktemp(name) / "t")
        stage(spark, out[-1], corpus).write.parquet(path)
        out.append(spark.read.parquet(path))
    return out


def rows(df):
    return [tuple(r) for r in df.select(*COLUMNS).collect()]


def test_columns(stages):
    assert all(df.columns == COLUMNS for df in stages[:-1])


def test_quality_stage(spark, corpus, stages):
    model = fit_quality(stages[0], spark.read.parquet(f"{corpus}/labels.parquet"))
    before = rows(stages[0])
    margin = model.margins(*FeatureMaker().rows([(r[1] or "").encode() for r in before]), len(before))
    want = [r for r, m in zip(before, margin) if 1 / (1 + np.exp(-m)) >= corpus_pipeline.MIN_QUALITY]
    assert sorted(map(repr, rows(stages[1]))) == sorted(map(repr, want))


def test_near_dedup_stage(stages):
    before = rows(stages[1])
    sets = [set(shingle_hashes((r[1] or "").encode(), 5).tolist()) for r in before]
    group = list(range(len(before)))

    def find(x):
        while group[x] != x:
            x = group[x]
        return x

    for i in range(len(before)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            blank = not sets[i] and not sets[j]  # texts without words
            if blank or both and both >= 0.8 * (len(sets[i]) + len(sets[j]) - both):
                group[find(i)] = find(j)
    first = {}
    for i, r in enumerate(before):
        first[find(i)] = min(first.get(find(i), (np.inf, len(before))), (np.inf if r[0] is None else r[0], i))
    want = sorted(repr(before[i]) for _, i in first.values())
    assert sorted(map(repr, rows(stages[2]))) == want and len(want) < len(before)


def test_decontamination_stage(spark, corpus, stages):
    items = [r.text for r in spark.read.parquet(f"{corpus}/benchmark.parquet").collect()]
    before = rows(stages[2])
    want = [r for r in before if not any(x in (r[1] or "") for x in items)]
    assert sorted(map(repr, rows(stages[3]))) == sorted(map(repr, want)) and len(want) < len(before)


def test_mixing_stage(stages):
    before, after = set(map(repr, rows(stages[3]))), set(map(repr, rows(stages[4])))
    assert after < before and len(after) > 0.15 * len(before)  # so few documents leave cells of one


def test_token_stage_and_run(spark, corpus, stages):
    tokenizer = Tokenizer.from_file(word_vocabulary())
    start, want = 0, []
    for doc_id, text, *_ in sorted(rows(stages[4]), key=lambda r: -1 if r[0] is None else r[0]):
        ids = tokenizer.encode(text or "", add_special_tokens=False).ids + [1]
        want.append((doc_id, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    assert sorted(map(tuple, stages[5].collect()), key=lambda r: r[1]) == want
    assert sorted(map(tuple, corpus_pipeline.run(spark, corpus).collect()), key=lambda r: r[1]) == want
