"""Term statistics and ranked search over papers."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, functions as F

from citeloom.functions import constants as K, scoring as S, text as X
from citeloom.session import cut_lineage

from .ranking import top_per_group


def term_counts(docs: DataFrame, key: str, tokens: Column) -> DataFrame:
    """(key, term, n) rows. A text's tokens meet in its own task, so the shuffle carries distinct pairs."""
    return docs.select(key, F.explode(tokens).alias("term")).groupBy(key, "term").agg(F.count("*").alias("n"))


def search_terms(docs: DataFrame, key: str, text: Column) -> DataFrame:
    """Like ``term_counts`` for search tokens, filtering after the explode to stay in generated code."""
    words = F.regexp_extract_all(F.lower(text), F.lit("([a-z0-9]+)"), F.lit(1))
    kept = docs.select(key, F.explode(words).alias("term")).filter((F.length("term") > 2) & ~F.col("term").isin(*K.SEARCH_STOP_WORDS))
    return kept.groupBy(key, "term").agg(F.count("*").alias("n"))


def document_frequency(counts: DataFrame, n_docs: int, smooth: bool = False) -> DataFrame:
    """df and idf per term: ``ln(N/(1+df))+1``, or ``ln((1+N)/(1+df))+1`` when smoothed."""
    df = counts.groupBy("term").agg(F.count("*").alias("df"))
    top = F.lit(float(n_docs + 1 if smooth else n_docs))
    return df.select("term", "df", (F.log(top / (F.col("df") + 1)) + 1.0).alias("idf"))


def term_frequency(counts: DataFrame, key: str) -> DataFrame:
    total = counts.groupBy(key).agg(F.sum("n").alias("total"))
    return counts.join(total, key).select(key, "term", (F.col("n") / F.col("total")).alias("tf"))


def tfidf_weights(tf: DataFrame, idf: DataFrame, key: str) -> DataFrame:
    """(key, term, w): term frequency times idf, 1 for a term without one."""
    return tf.join(idf.select("term", "idf"), "term", "left").select(key, "term", (F.col("tf") * F.coalesce("idf", F.lit(1.0))).alias("w"))


def tfidf_cosine(a: DataFrame, b: DataFrame, pairs: DataFrame) -> DataFrame:
    """Cosine of tf-idf vectors, weights ``(a_id, term, w)`` and ``(b_id, term, w)``, for pairs ``(a_id, b_id)``; 0 when a side is empty.

    Give weights that are stored tables: each side is read for the products and for its norms.
    """
    na = a.groupBy("a_id").agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("na"))
    nb = b.groupBy("b_id").agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("nb"))
    dot = pairs.join(a.withColumnRenamed("w", "w1"), "a_id").join(b.withColumnRenamed("w", "w2"), ["b_id", "term"]).groupBy(
        "a_id", "b_id").agg(F.sum(F.col("w1") * F.col("w2")).alias("dot"))
    out = pairs.join(dot, ["a_id", "b_id"], "left").join(na, "a_id", "left").join(nb, "b_id", "left")
    return out.select("a_id", "b_id", S.rounded(F.coalesce(F.try_divide(F.col("dot"), F.col("na") * F.col("nb")), F.lit(0.0)), 6).alias("cosine"))


#: Bytes of the query terms that go to the tasks at a time, and (paper, query) cells that are scored at a time.
QUERY_BYTES = 64 << 20
SCORED_CELLS = 1 << 20
_HITS = "query_id bigint, paper_id bigint, keyword double, tfidf double"


def _score_block(papers: DataFrame, q: pd.DataFrame, k: int, as_of_year: int) -> DataFrame:
    """The k best papers of a few for each query of a block; ``papers(paper_id, year, base_sq, hits)``.

    The block holds, for each of its terms, the queries that have it. A paper's hits are expanded to these
    queries and added up by cell, so the work is the hits that count and memory is bounded by the cells.
    """
    q = q.sort_values("term_id")
    term_ids, starts = np.unique(q["term_id"].to_numpy(), return_index=True)
    ends = np.append(starts[1:], len(q))
    queries = np.unique(q["query_id"].to_numpy())
    col = np.searchsorted(queries, q["query_id"].to_numpy())
    product = (q["qn"] * q["idf_in"] ** 2).to_numpy()
    change = (q["idf_in"] ** 2 - q["idf_out"] ** 2).fillna(0.0).to_numpy()
    n_terms = np.bincount(col, minlength=len(queries))
    norm = np.sqrt(np.bincount(col, (q["qn"] * q["idf_in"]).to_numpy() ** 2, minlength=len(queries)))
    shared = papers.sparkSession.sparkContext.broadcast((term_ids, starts, ends, queries, col, product, change, n_terms, norm))  # about QUERY_BYTES

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        term_ids, starts, ends, queries, col, product, change, n_terms, norm = shared.value
        step = max(1, SCORED_CELLS // len(queries))
        for batch in batches:
            if not batch.num_rows:
                continue
            hits = batch.column("hits")
            offsets = hits.offsets.to_numpy().astype(np.int64)
            inside = slice(offsets[0], offsets[-1])
            found, count = (hits.values.field(f).to_numpy()[inside] for f in ("term_id", "n"))
            rows = np.repeat(np.arange(batch.num_rows), np.diff(offsets))
            at = np.minimum(np.searchsorted(term_ids, found), len(term_ids) - 1)
            mine = term_ids[at] == found
            rows, at, count = rows[mine], at[mine], count[mine].astype(float)
            ids, base = batch.column("paper_id").to_numpy(), batch.column("base_sq").to_numpy()
            made = pc.fill_null(batch.column("year").cast(pa.float64()), 0.0).to_numpy()
            year = np.where(made > 0, 1.0 / (1.0 + 0.1 * np.abs(as_of_year - made)), 0.0)
            for low in range(0, batch.num_rows, step):
                high = min(low + step, batch.num_rows)
                some = slice(*np.searchsorted(rows, [low, high]))
                size = ends[at[some]] - starts[at[some]]
                each = np.arange(size.sum()) + np.repeat(starts[at[some]] - np.cumsum(size) + size, size)
                cell = np.repeat(rows[some] - low, size) * len(queries) + col[each]
                n = np.repeat(count[some], size)
                shape = (high - low, len(queries))
                common, dot, moved = (np.bincount(cell, w, minlength=shape[0] * shape[1]).reshape(shape) for w in (None, n * product[each], n * n * change[each]))
                length = np.sqrt(np.maximum(base[low:high, None] + moved, 0.0)) * norm
                tfidf = np.divide(dot, length, out=np.zeros(shape), where=length > 0)
                keyword = common / n_terms
                total = np.where(common > 0, np.floor((keyword * 0.4 + tfidf * 0.4 + year[low:high, None] * 0.2) * 1e6 + 0.5), -1.0)
                order = np.lexsort((np.broadcast_to(ids[low:high, None], shape), -total), axis=0)[:k]
                where = np.broadcast_to(np.arange(len(queries)), order.shape)
                keep = total[order, where] > 0
                order, where = order[keep], where[keep]
                yield pa.RecordBatch.from_arrays([pa.array(queries[where]), pa.array(ids[low + order]), pa.array(keyword[order, where]), pa.array(tfidf[order, where])],
                                                 names=["query_id", "paper_id", "keyword", "tfidf"])

    return papers.mapInArrow(score, _HITS)


def search_similar(papers: DataFrame, queries: DataFrame, k: int, as_of_year: int) -> DataFrame:
    """Top-k papers per query by 0.4 keyword + 0.4 tf-idf + 0.2 year, scores above 0.1.

    ``papers(paper_id, title, abstract, year)``, ``queries(query_id, query)``.

    The papers' terms are counted once into a stored table. The queries' term weights go
    to the tasks in blocks of bounded size; each task scores its papers in place and
    passes on k of them for a query and batch, so no (query, paper) table is shuffled. A
    query counts as one document, so the idf of its own terms differs from the corpus idf;
    a paper's norm is the corpus norm plus the correction over the shared terms. Papers
    that share no term score by year alone, so the k newest papers cover them.
    """
    counts = cut_lineage(search_terms(papers, "paper_id", F.concat_ws(" ", "title", "abstract")))
    n_docs = float(papers.count() + 1)
    log_idf = lambda seen: F.log(F.lit(n_docs) / (1.0 + seen)) + 1.0
    corpus = cut_lineage(counts.groupBy("term").agg(F.count("*").alias("df")).select("term", "df", log_idf(F.col("df")).alias("idf")))
    qc = search_terms(queries, "query_id", F.col("query"))
    # idf of a query term counts the query itself; unseen terms have df 0.
    numbered = cut_lineage(qc.select("term").distinct().withColumn("term_id", F.monotonically_increasing_id()))
    weighted = cut_lineage(qc.join(numbered, "term").join(corpus, "term", "left").select(
        "query_id", "term_id", F.col("n").alias("qn"), F.col("idf").alias("idf_out"), log_idf(F.coalesce("df", F.lit(0)) + 1).alias("idf_in")))
    norms = counts.join(corpus.select("term", "idf"), "term").groupBy("paper_id").agg(F.sum(F.pow(F.col("n") * F.col("idf"), 2)).alias("base_sq"))
    asked = counts.join(numbered, "term")
    hits = asked.groupBy("paper_id").agg(F.collect_list(F.struct("term_id", "n")).alias("hits"))  # at most the terms of one paper
    held = cut_lineage(papers.select("paper_id", "year").join(norms, "paper_id").join(hits, "paper_id"))
    blocks = max(1, -(-weighted.count() * 40 // QUERY_BYTES))
    parts = []
    for block in range(blocks):
        q = weighted.where(F.pmod(F.xxhash64("query_id"), F.lit(blocks)) == block).toPandas()
        if len(q):
            part = _score_block(held, q, k, as_of_year)
            parts.append(part if blocks == 1 else cut_lineage(part))
    newest = papers.select("paper_id", "year").orderBy(F.desc(S.year_score(F.col("year"), as_of_year)), "paper_id").limit(k)
    ids = [r["paper_id"] for r in newest.collect()]  # k rows
    cand = queries.select("query_id", F.explode(F.array(*map(F.lit, ids)).cast("array<bigint>")).alias("paper_id"), F.lit(0.0).alias("keyword"), F.lit(0.0).alias("tfidf"))
    for part in parts:
        cand = cand.unionByName(part)
    cand = cand.groupBy("query_id", "paper_id").agg(F.max("keyword").alias("keyword"), F.max("tfidf").alias("tfidf"))
    scored = cand.join(papers.select("paper_id", "year"), "paper_id").withColumn("year_score", S.year_score(F.col("year"), as_of_year))
    scored = scored.withColumn("score", S.rounded(F.col("keyword") * 0.4 + F.col("tfidf") * 0.4 + F.col("year_score") * 0.2, 6))
    top = top_per_group(scored.filter("score > 0.1"), ["query_id"], [F.desc("score"), F.asc("paper_id")], k)
    pct = lambda c: F.format_string("%.0f%%", F.col(c) * 100)
    reasons = F.array_compact(F.array(
        F.when(F.col("keyword") > 0.3, F.concat(F.lit("keyword_match ("), pct("keyword"), F.lit(")"))),
        F.when(F.col("tfidf") > 0.2, F.concat(F.lit("tfidf ("), pct("tfidf"), F.lit(")"))),
        F.when(F.col("year_score") > 0.7, F.concat(F.lit("recent ("), F.col("year").cast("string"), F.lit(")")))))
    return top.select("query_id", "paper_id", "rank", "score", "keyword", "tfidf", "year_score", reasons.alias("reasons"))


def related_by_keywords(source: DataFrame, candidates: DataFrame, k: int = 10, floor: float = 0.05) -> DataFrame:
    """Candidates by the share of the source papers' terms they contain."""
    text = F.concat_ws(" ", "title", "abstract")
    wanted = search_terms(source, "paper_id", text).select("term").distinct()
    wanted = cut_lineage(wanted)
    n = wanted.count()
    have = search_terms(candidates, "paper_id", text).join(wanted, "term", "left_semi").groupBy("paper_id").agg(F.count("*").alias("overlap"))
    scored = have.withColumn("score", F.col("overlap") / F.lit(max(1, n)))
    return scored.filter(F.col("score") > floor).orderBy(F.desc("score"), "paper_id").limit(k).select("paper_id", "overlap", "score")


def keyword_fallback(papers: DataFrame, semantic: DataFrame, query: str, k: int = 10) -> DataFrame:
    """Semantic hits; when there are none, rows holding the query or any of its words."""
    text = F.lower(F.concat_ws(" ", "title", "abstract"))
    hit = text.contains(query.lower())
    for word in query.lower().split():
        hit = hit | text.contains(word)
    some = semantic.limit(1).select(F.lit(1).alias("_one"))
    by_word = papers.filter(hit).select("paper_id", F.lit(1).alias("source_rank"), F.col("paper_id").alias("pos"), F.lit(1).alias("_one"))
    by_word = by_word.join(some, "_one", "left_anti").drop("_one")
    by_meaning = semantic.select("paper_id", F.lit(0).alias("source_rank"), F.col("rank").cast("bigint").alias("pos"))
    return by_meaning.unionByName(by_word).orderBy("source_rank", "pos").limit(k)
