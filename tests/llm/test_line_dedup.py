from pyspark.sql import functions as F

from citeloom.llm.line_dedup import LineIndex, build_index, drop_repeated_lines

LONG = "This very line is long enough to be a key of its own"


def brute(rows, min_docs=5, min_chars=40):
    def key(line):
        return "".join(c.lower() if "A" <= c <= "Z" else c for c in line.strip(" \t\n\x0b\x0c\r"))

    docs = [(i, (t or "").split("\n")) for i, t in rows]
    holders = {}
    for n, (i, lines) in enumerate(docs):
        for k in {key(x) for x in lines}:
            holders.setdefault(k, []).append(i)
    out = []
    for i, lines in docs:
        kept = [x for x in lines if not (len(key(x)) >= min_chars and len(holders[key(x)]) >= min_docs and i < max(holders[key(x)]))]
        out.append((i, "\n".join(kept), len(lines), len(lines) - len(kept)))
    return sorted(out)


def run(spark, docs, tmp_path, **options):
    index = build_index(docs, str(tmp_path / "index"), **options)
    return index, sorted(tuple(r) for r in drop_repeated_lines(docs, index).select("doc_id", "kept", "n_lines", "n_dropped").collect())


def test_matches_brute_force(spark, make_docs, tmp_path):
    rows = [(i, f"own {i}\n{LONG}\n\t {LONG.upper()} \x0b\nshort") for i in range(7)]
    rows += [(20, "é" * 39), (21, "é" * 40), (22, "É" * 40), (23, None), (24, ""), (25, "\n\n"), (26, LONG + "!" * 30000)]
    rows += [(30 + i, "é" * 40 + "\n" + "é" * 39) for i in range(5)]
    docs = make_docs(rows)
    index, got = run(spark, docs, tmp_path, batches=5, fanout=2)
    assert got == brute(rows)
    assert len(index.levels) > 1 and all(len(level) < 2 for level in index.levels)  # compacted
    firsts = index.runs().where("NOT seen")
    assert firsts.count() == firsts.select("high", "low").distinct().count() == index.totals().count()


def test_batch_against_runs(spark, make_docs, tmp_path):
    index = LineIndex(spark, str(tmp_path / "index"))
    index.add(make_docs([(1, LONG)]))
    new = index.novel(make_docs([(2, LONG + "\n" + LONG + " two")]))
    assert [(r.doc_id, r.line) for r in new.collect()] == [(2, 1)]
    index.add(make_docs([(2, LONG + "\n" + LONG + " two")]))
    assert sorted((r.seen, r.n_docs, r.last_doc) for r in index.runs().collect()) == [(False, 1, 1), (False, 1, 2), (True, 1, 2)]
    assert [(r.n_docs, r.last_doc) for r in index.repeated(2).collect()] == [(2, 2)]


def test_repeated_rows_null_ids_and_empty(spark, make_docs, tmp_path):
    docs = make_docs([(1, LONG)] * 4 + [(None, LONG), (9, LONG)])
    index = build_index(docs, str(tmp_path / "a"))
    kept = {(r.doc_id, r.kept) for r in drop_repeated_lines(docs, index).collect()}
    assert kept == {(1, ""), (None, ""), (9, LONG)}
    none = docs.where(F.lit(False))
    assert drop_repeated_lines(none, build_index(none, str(tmp_path / "b"))).count() == 0
