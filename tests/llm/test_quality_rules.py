import re
from collections import defaultdict

from citeloom.llm.quality_rules import apply_quality_rules, text_statistics

SPACE = " \t\n\x0b\x0c\r"


def words(text):
    return [w for w in re.split(r"[\x20\x09-\x0D]+", text or "") if w]


def statistics(text):
    text = text or ""
    w = words(text)
    lines = [x for x in text.split("\n") if words(x)]
    grams = [tuple(w[i:i + 3]) for i in range(len(w) - 2)]
    covered = {i + k for i, g in enumerate(grams) if grams.count(g) > 1 for k in range(3)}
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(covered)


def test_statistics(spark, make_docs):
    texts = ["", None, " \n", "a b", "a b c", "a a a a", "a b c a b c d", "x#*$%&|<> é\u00a0ü\nL\n L\nL\n\n", "to be or not to be or not\x0bto\x0cbe", "one two three\r\none two three", "z " * 3000]
    got = {r.doc_id: r for r in text_statistics(make_docs(list(enumerate(texts)))).collect()}
    for i, t in enumerate(texts):
        assert (got[i].n_words, got[i].word_chars, got[i].n_symbols, got[i].n_dup_lines, got[i].n_repeat_words) == statistics(t), t


def test_frequent_lines_and_depletion(spark, make_docs):
    letters = str.maketrans("0123456789", "abcdefghij")
    own = lambda i, n: " ".join(f"w{i}x{k}" for k in range(n)).translate(letters)
    menu = " ".join(f"menu{k}" for k in range(60))
    rows = [(i, f"{own(i, 70)}\n {menu.upper()} ", "en", "h") for i in range(12)]
    rows += [(20, f"{own(20, 30)}\n{menu}", "en", "h"), (21, f"{own(21, 30)}\n{menu}", "en", "other"), (22, None, "en", None), (23, "", "en", "h"), (23, own(23, 80), "en", None), (None, own(24, 90), "en", "h")]
    rows += [(100 + i, own(50, 55), "en", "h") for i in range(30)]  # copies of one text are one document
    got = defaultdict(list)
    for r in apply_quality_rules(make_docs(rows)).collect():
        got[r.doc_id].append(r)
    assert all(got[i][0].kept and got[i][0].clean_text == own(i, 70) and got[i][0].n_boilerplate_words == 60 for i in range(12))
    assert not got[20][0].kept and not got[20][0].base_failed and got[20][0].n_boilerplate_words == 60
    assert got[21][0].kept and got[21][0].n_boilerplate_words == 0
    assert got[22][0].base_failed and not got[22][0].kept and sorted(r.kept for r in got[23]) == [False, True] and got[None][0].kept
    assert all(got[100 + i][0].kept for i in range(30))
    assert apply_quality_rules(make_docs(rows).where("false")).count() == 0
