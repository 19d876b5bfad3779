import zlib

import numpy as np
import public_tokenizers
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from citeloom.llm.token_output import ChunkEncoder, read_metadata, read_tokens, token_digests, write_tokens

VOCABULARY = public_tokenizers.path("word_bpe_49k.json")
TEXTS = [
    "The cat, the DOG. It's 3.14 don't", "", None, " \n ", "É\u0301a é ñ, Ñ. ß", "a<|endoftext|>B <|STARTOFTEXT|>", "x\x01y \x01 z", "tab\tcr\r\nvt\x0bx\x1cy\u0085q",
    "日本語 テスト。 😀😀", "ΑΣ Σ. İstanbul ª º µ ŉ", "word," * 3000, "the the the the", "the the the the",
]


def expected(texts, end_id=1):
    tokenizer = Tokenizer.from_file(VOCABULARY)
    return [tokenizer.encode(t or "", add_special_tokens=False).ids + [end_id] for t in texts]


def test_digests_match_whole_text_encoding(spark, make_docs, tmp_path):
    path = str(tmp_path / "t")
    write_tokens(make_docs(list(enumerate(TEXTS))), path, VOCABULARY, slice_bytes=64)
    got = {r.doc_id: r for r in token_digests(spark, path).collect()}
    start = 0
    for i, ids in enumerate(expected(TEXTS)):
        assert (got[i].start, got[i].n_tokens, got[i].ids_crc32) == (start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)


def test_selective_reads_and_order(spark, make_docs, tmp_path):
    path = str(tmp_path / "t")
    write_tokens(make_docs([(3, "c"), (1, "a b"), (2, None), (None, "n"), (2, "again")]), path, VOCABULARY)
    meta = read_metadata(spark, path).orderBy("start").collect()
    assert [r.doc_id for r in meta] == [None, 1, 2, 2, 3]
    one = read_tokens(spark, path, F.col("doc_id") == 3, "tokens")
    assert [list(r.tokens) for r in one.collect()] == expected(["c"])
    assert "PushedFilters: [IsNotNull(doc_id), EqualTo(doc_id,3)]" in one._jdf.queryExecution().toString()


def test_cache_renewal_keeps_results():
    small, large = ChunkEncoder(VOCABULARY, cached_chunks=3), ChunkEncoder(VOCABULARY)
    for text in TEXTS:
        assert small.encode([text or ""]) == large.encode([text or ""])


def test_empty_table(spark, make_docs, tmp_path):
    path = str(tmp_path / "t")
    write_tokens(make_docs([(1, "a")]).where("doc_id > 5"), path, VOCABULARY)
    assert token_digests(spark, path).count() == 0
