import random

import public_tokenizers
import pytest
from tokenizers import Tokenizer

from citeloom.llm import token_counts
from citeloom.llm.token_counts import TokenCounter, count_tokens

VOCABULARY = public_tokenizers.path("byte_bpe_50k.json")


def odd_texts():
    rnd = random.Random(5)
    pick = lambda letters, n: "".join(rnd.choice(letters) for _ in range(n))
    return [
        "", " ", "a", "it's we'll 'S", "a  b\n\n\tc  ", "x" * 5001, "aaa" * 7, "he" * 4000, pick("abcdefghij", 9000), pick("etaoin shrdlu\n'", 4000),
        "one<|endoftext|> two <|endoftext|><|endoftext|>", "<|endoftext|", "\x1c\x1d a\x85b᠎  c　 ", "👩‍👩‍👧 é́ ñ 42½ ٣٤", "\u0000\u0000",
        "࢏֋ ₏꟎xx \U000107bb1 \U0002ebf0\U0002ebf0", pick("日本語中文字 ", 500), "1,000.50€ " * 50,
    ]


def expected(texts):
    return [len(e.ids) for e in Tokenizer.from_file(VOCABULARY).encode_batch(texts, add_special_tokens=False)]


def test_counts_are_the_librarys(spark, make_docs):
    texts = odd_texts() + ["the same text"] * 3
    rows = [*enumerate(texts), (1000, None), (None, "null id"), (0, "a second row of one id")]
    got = sorted(((r.doc_id, r.n_bytes, r.n_tokens, r.over_limit) for r in count_tokens(make_docs(rows), VOCABULARY).collect()), key=str)
    counts = expected([t or "" for _, t in rows])
    assert got == sorted(((i, len((t or "").encode()), n, n > 1024) for (i, t), n in zip(rows, counts)), key=str)
    assert count_tokens(make_docs(rows).where("false"), VOCABULARY).count() == 0


@pytest.mark.parametrize("name, value", [("LONG_SEQUENCE", 2), ("ARRAY_SYMBOLS", 50), ("SLICE_BYTES", 1)])
def test_bounds_do_not_change_counts(monkeypatch, name, value):
    monkeypatch.setattr(token_counts, name, value)
    texts = odd_texts()
    counter = TokenCounter(VOCABULARY, cached_pieces=5)
    assert counter.count(texts) == expected(texts) == [n for t in texts for n in counter.count([t])]


def test_every_character_is_cut_as_by_the_library():
    cut = Tokenizer.from_file(VOCABULARY).pre_tokenizer.pre_tokenize_str
    counter = TokenCounter(VOCABULARY)
    for c in [*range(0x3100), *range(0xA000, 0xAC00), *range(0xF900, 0x11000), *range(0x1D000, 0x1FB00), *sorted(counter.stand_ins)[::97]]:
        s = f"a{chr(c)}{chr(c)}1 {chr(c)} b"
        assert [b - a for _, (a, b) in cut(s)] == [len(p) for p in counter.cut(s)], hex(c)


def test_other_vocabularies_are_refused():
    with pytest.raises(ValueError):
        TokenCounter(public_tokenizers.path("word_bpe_49k.json"))
