"""Ranked lexical search over a length-stratified index.

A document's normaliser m depends on its length alone, so documents are grouped by equal
m into strata, and a stratum's documents into chunks of bounded size. A row of the index
holds the documents of a chunk in which a term occurs tf times, so an impact is computed
once for a row, not once for a posting. A search bounds what each stratum can reach for
each item, visits the most promising strata first, and leaves out chunks whose bound
stays below the item's k-th score so far.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from citeloom.llm.common import small, stored, utf8_values

TOP = 10
#: Documents and postings of a chunk.
CHUNK_DOCS = 4_096
CHUNK_POSTINGS = 400_000
#: Terms of the documents that are dealt out together.
PART_TERMS = 500_000
#: Items that are scored together, and bytes of their terms.
BLOCK_ITEMS = 1_024
BLOCK_BYTES = 16 << 20
#: Query terms up to this size go to every task; beyond it the index is joined with them.
BROADCAST_BYTES = 32 << 20
#: Strata up to this number go to every task; there are at most as many as the longest text has terms.
BROADCAST_STRATA = 1_000_000
#: Strata that each item visits first, to learn what score its k-th document has at least.
FIRST_STRATA = 2
#: The row of a chunk that lists its doc_ids; other rows name documents by their place in it.
DIRECTORY = ""
#: Stands for a null doc_id inside tasks; it comes first among equal scores, as null does.
NO_ID = np.iinfo(np.int64).min

#: Lower-cases A-Z and turns what is outside terms into blanks.
_PLAIN = bytes(b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else b + 32 if 65 <= b <= 90 else 32 for b in range(256))

_POSTINGS = "m long, chunk long, term string, tf long, docs array<long>"


def terms_of(raw: bytes) -> list[bytes]:
    return raw.translate(_PLAIN).split()


@dataclass
class LexicalIndex:
    """``postings`` (m, chunk, term, tf, docs) and the corpus counts N (documents with a term) and L (their terms)."""

    postings: DataFrame
    n_docs: int
    n_terms: int


class _Chunk:
    """Documents of one stratum on their way into the index."""

    def __init__(self, m: int, chunk: int) -> None:
        self.m, self.chunk = m, chunk
        self.docs: list[int | None] = []
        self.ids: dict[bytes, int] = {}
        self.terms: list[int] = []
        self.tf: list[int] = []
        self.sizes: list[int] = []

    def add(self, doc_id: int | None, terms: list[bytes]) -> None:
        counts, ids = Counter(terms), self.ids
        self.docs.append(doc_id)
        self.terms += [ids.setdefault(t, len(ids)) for t in counts]
        self.tf += counts.values()
        self.sizes.append(len(counts))

    @property
    def full(self) -> bool:
        return len(self.docs) >= CHUNK_DOCS or len(self.terms) >= CHUNK_POSTINGS

    def rows(self) -> pa.RecordBatch:
        words = np.array([*self.ids, b""], dtype=object)[:-1]
        by_word = np.argsort(words, kind="stable")
        rank = np.empty(len(words), np.int64)
        rank[by_word] = np.arange(len(words))
        term, tf = rank[np.array(self.terms, np.int64)], np.array(self.tf, np.int64)
        place = np.repeat(np.arange(len(self.docs)), self.sizes)
        order = np.lexsort((place, tf, term))
        term, tf, place = term[order], tf[order], place[order]
        starts = np.flatnonzero(np.concatenate([[True], (term[1:] != term[:-1]) | (tf[1:] != tf[:-1])]))
        spelled = pa.array([DIRECTORY.encode(), *words[by_word].tolist()], pa.binary()).cast(pa.string())
        offsets = np.concatenate([[0], len(self.docs) + np.append(starts, len(term))]).astype(np.int32)
        values = pa.concat_arrays([pa.array(self.docs, pa.int64()), pa.array(place)])
        n = len(starts) + 1
        return pa.RecordBatch.from_arrays([
            pa.array(np.full(n, self.m)), pa.array(np.full(n, self.chunk)), spelled.take(pa.array(np.concatenate([[0], term[starts] + 1]))),
            pa.array(np.concatenate([[0], tf[starts]])), pa.ListArray.from_arrays(pa.array(offsets), values)], names=["m", "chunk", "term", "tf", "docs"])


def term_lengths(docs: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """The lengths in terms that occur, ascending, and the documents of each; documents without a term are left out.

    A row for each length reaches the driver, so at most as many as the longest text has terms.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter[int] = Counter()
        for batch in batches:
            for part in small([batch], 200):
                seen.update(len(terms_of(raw)) for raw in utf8_values(part.column("text")))
        yield pa.RecordBatch.from_arrays([pa.array([*seen], pa.int64()), pa.array([*seen.values()], pa.int64())], names=["n", "docs"])

    found = docs.select("text").mapInArrow(run, "n long, docs long").where("n > 0").groupBy("n").agg(F.sum("docs").alias("docs")).toArrow().sort_by("n")
    return found.column("n").to_numpy(), found.column("docs").to_numpy()


def build_index(docs: DataFrame) -> LexicalIndex:
    """Index every row of ``docs`` (doc_id, text; other columns are ignored).

    Rows are dealt out by ranges of length with about PART_TERMS terms each; the rows of a length that has more share several
    parts by a hash of their doc_id and text, so a stratum of any size is shared by many tasks. Rows without a term are in no stratum. Rows
    of equal doc_id are separate documents, null doc_ids stay null, a table without rows gives an empty index.
    """
    lengths, held = term_lengths(docs)
    n_docs, n_terms = int(held.sum()), int((lengths * held).sum())
    before = np.cumsum(lengths * held) - lengths * held
    first, width = before // PART_TERMS, -(-lengths * held // PART_TERMS)

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in small([batch], 200):
                n = np.array([len(terms_of(raw)) for raw in utf8_values(part.column("text"))], np.int64)
                rows = np.flatnonzero(n)
                at, tie = np.searchsorted(lengths, n[rows]), part.column("tie").to_numpy()[rows]
                kept = part.take(pa.array(rows))
                yield pa.RecordBatch.from_arrays([pa.array(first[at] + tie % width[at]), pa.array(25 + 75 * n[rows] * n_docs // max(n_terms, 1)), kept.column("doc_id"), kept.column("text")],
                                                 names=["part", "m", "doc_id", "text"])

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, made, open_chunk = TaskContext.get().partitionId(), 0, None
        for batch in batches:
            for rows in small([batch], 200):
                for m, doc_id, raw in zip(rows.column("m").to_pylist(), rows.column("doc_id").to_pylist(), utf8_values(rows.column("text"))):
                    if open_chunk and (open_chunk.m != m or open_chunk.full):
                        yield open_chunk.rows()
                        open_chunk = None
                    if not open_chunk:
                        open_chunk, made = _Chunk(m, task << 32 | made), made + 1
                    open_chunk.add(doc_id, terms_of(raw))
        if open_chunk:
            yield open_chunk.rows()

    keyed = docs.select(F.col("doc_id").cast("long"), "text", F.pmod(F.xxhash64("doc_id", "text"), F.lit(1 << 30)).alias("tie"))
    dealt = keyed.mapInArrow(measure, "part long, m long, doc_id long, text string").repartition("part").sortWithinPartitions("m", "doc_id")
    options = {"compression": "zstd", "parquet.writer.version": "PARQUET_2_0", "parquet.enable.dictionary": "false"}
    return LexicalIndex(stored(dealt.select("m", "doc_id", "text").mapInArrow(build, _POSTINGS), **options), n_docs, n_terms)


class _Block:
    """Items with the weights of their terms: for term t, ``items[ends[t]:ends[t + 1]]`` hold it with ``weight`` (repeats included)."""

    def __init__(self, rows: pa.Table) -> None:
        self.item_ids = sorted(set(rows.column("item_id").to_pylist()), key=lambda i: (i is not None, i))
        place = {i: k for k, i in enumerate(self.item_ids)}
        rows = rows.sort_by("term")
        names = rows.column("term").to_pylist()
        self.terms: dict[str, int] = {t: k for k, t in enumerate(dict.fromkeys(names))}
        at = np.array([self.terms[t] for t in names], np.int64)
        self.ends = np.concatenate([[0], np.cumsum(np.bincount(at, minlength=len(self.terms)))])
        self.items = np.array([place[i] for i in rows.column("item_id").to_pylist()], np.int64)
        self.weight = rows.column("weight").to_numpy()

    def bounds(self, terms: np.ndarray, impacts: np.ndarray) -> np.ndarray:
        """What each item scores with the given impact of each term."""
        size = self.ends[terms + 1] - self.ends[terms]
        at = np.repeat(self.ends[terms] - np.concatenate([[0], np.cumsum(size)[:-1]]), size) + np.arange(size.sum())
        out = np.zeros(len(self.item_ids), np.int64)
        np.add.at(out, self.items[at], self.weight[at] * np.repeat(impacts, size))
        return out


def impact(tf: np.ndarray, m: np.ndarray | int) -> np.ndarray:
    return (1_000_000_000 * tf) // (1_000 * tf + 8 * m)


_HITS = "item int, item_id long, doc_id long, score long"


def _groups(batches: Iterator[pa.RecordBatch], key: str) -> Iterator[pa.Table]:
    """The rows of one key after the other, of a stream in which they stand together."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        keys = batch.column(key).to_numpy()
        edges = [0, *(np.flatnonzero(np.diff(keys)) + 1).tolist(), len(keys)]
        for a, b in zip(edges, edges[1:]):
            piece = batch.slice(a, b - a)
            if held and held[0].column(key)[0].as_py() != keys[a]:
                yield pa.Table.from_batches(held)
                held = []
            held.append(piece)
    if held:
        yield pa.Table.from_batches(held)


def _stratum_bounds(block: _Block):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _groups(batches, "m"):
            m = rows.column("m")[0].as_py()
            known = [(block.terms[t], tf) for t, tf in zip(rows.column("term").to_pylist(), rows.column("tf").to_pylist()) if t in block.terms]
            if known:
                terms, tf = np.array(known, np.int64).T
                bound = block.bounds(terms, impact(tf, m))
                some = np.flatnonzero(bound)
                yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array(np.full(len(some), m)), pa.array(bound[some])], names=["item", "m", "bound"])

    return run


def _score(block: _Block, k: int, floor: dict[int, int]):
    """Top ``k`` of each item among the chunks of a task, from a stream in order of visits."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n_items = len(block.item_ids)
        least = np.array([max(1, floor.get(i, 1)) for i in range(n_items)], np.int64)
        best: list[tuple[np.ndarray, np.ndarray]] = [(np.zeros(0, np.int64), np.zeros(0, np.int64))] * n_items
        for rows in _groups(batches, "chunk"):
            names = rows.column("term").to_pylist()
            m = rows.column("m")[0].as_py()
            docs = rows.column("docs").combine_chunks()
            offsets, values = docs.offsets.to_numpy().astype(np.int64), docs.values
            at = names.index(DIRECTORY)
            doc_ids = values.slice(offsets[at], offsets[at + 1] - offsets[at]).fill_null(NO_ID).to_numpy()
            values = values.fill_null(NO_ID).to_numpy()
            term = np.array([block.terms.get(t, -1) for t in names], np.int64)
            impacts = impact(rows.column("tf").to_numpy(), m)
            starts = np.concatenate([[0], np.flatnonzero(np.diff(term)) + 1])
            ends = np.append(starts[1:], len(term))  # the rows of a term stand together by ascending tf
            known = term[starts] >= 0  # others are terms of other blocks
            starts, ends = starts[known], ends[known]
            if not len(starts):
                continue
            bound = block.bounds(term[starts], impacts[ends - 1])
            active = bound >= least
            if not active.any():
                continue
            row_of = np.cumsum(active) - 1
            scores = np.zeros((int(active.sum()), len(doc_ids)), np.int64)
            for t, a, b in zip(term[starts].tolist(), starts.tolist(), ends.tolist()):
                low, high = block.ends[t], block.ends[t + 1]
                items, weight = block.items[low:high], block.weight[low:high]
                wanted = active[items]
                if not wanted.all():
                    items, weight = items[wanted], weight[wanted]
                    if not len(items):
                        continue
                where = values[offsets[a]:offsets[b]]
                gain = np.repeat(impacts[a:b], np.diff(offsets[a:b + 1]))
                scores[np.ix_(row_of[items], where)] += weight[:, None] * gain[None, :]
            for i in np.flatnonzero(active).tolist():
                own = scores[row_of[i]]
                found = np.flatnonzero(own >= least[i])
                if not len(found):
                    continue
                ids, points = np.concatenate([best[i][0], doc_ids[found]]), np.concatenate([best[i][1], own[found]])
                order = np.lexsort((ids, -points))[:k]
                best[i] = ids[order], points[order]
                if len(order) == k:
                    least[i] = max(least[i], points[order[-1]])
        size = [len(ids) for ids, _ in best]
        if sum(size):
            doc_id = np.concatenate([ids for ids, _ in best])
            yield pa.RecordBatch.from_arrays([
                pa.array(np.repeat(np.arange(n_items, dtype=np.int32), size)),
                pa.array([block.item_ids[i] for i in np.repeat(np.arange(n_items), size).tolist()], pa.int64()),
                pa.array(doc_id, mask=doc_id == NO_ID), pa.array(np.concatenate([points for _, points in best]))], names=["item", "item_id", "doc_id", "score"])

    return run


def _query_terms(items: DataFrame) -> DataFrame:
    """(item_id, term, qf)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for item_id, raw in zip(batch.column("item_id").to_pylist(), utf8_values(batch.column("text"))):
                counts = Counter(terms_of(raw))
                yield pa.RecordBatch.from_arrays([pa.array([item_id] * len(counts), pa.int64()), pa.array([*counts], pa.binary()).cast(pa.string()),
                                                  pa.array([*counts.values()], pa.int64())], names=["item_id", "term", "qf"])

    found = items.select(F.col("item_id").cast("long"), "text").mapInArrow(run, "item_id long, term string, qf long")
    return found.groupBy("item_id", "term").agg(F.sum("qf").alias("qf"))


def _top(hits: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("item_id").orderBy(F.desc("score"), F.asc("doc_id"))
    return hits.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def search(index: LexicalIndex, items: DataFrame, k: int = TOP) -> DataFrame:
    """item_id, rank, doc_id, score: the ``k`` highest-scoring documents of each item of ``items`` (item_id, text), all if fewer score above 0.

    A term's weight is floor(1000 ln((2 N + 2) / (2 df + 1))), its impact (10^9 tf) div (1000 tf + 8 m). Equal scores are in
    order of doc_id, null first. The terms of all rows of an item_id count together, repeats included; an item without
    a term, or with none that a document holds, has no rows. The result is exact: a chunk is left out only if its bound is below a
    score that k documents reach.
    """
    asked = stored(_query_terms(items))
    terms = asked.select("term").distinct().union(asked.sparkSession.createDataFrame([(DIRECTORY,)], "term string"))
    n_items, n_bytes = asked.agg(F.count_distinct(F.struct("item_id")), F.coalesce(F.sum(F.octet_length("term") + 32), F.lit(0))).first()
    named = F.broadcast(terms) if n_bytes <= BROADCAST_BYTES else terms
    matched = stored(index.postings.join(named, "term", "left_semi").select("m", "chunk", "term", "tf", "docs"))
    found = matched.where(F.col("term") != DIRECTORY)
    df = found.groupBy("term").agg(F.sum(F.size("docs")).alias("df"))
    weight = F.floor(1000 * F.log((2 * F.lit(index.n_docs) + 2) / (2 * F.col("df") + 1)))
    weighted = stored(asked.join(df, "term").select("item_id", "term", (F.col("qf") * weight).alias("weight")))
    highest = stored(found.groupBy("m", "term").agg(F.max("tf").alias("tf")))
    blocks = max(1, -(-n_items // BLOCK_ITEMS), -(-n_bytes // BLOCK_BYTES))
    hits = None
    for number in range(blocks):
        rows = weighted.where(F.pmod(F.xxhash64("item_id"), F.lit(blocks)) == number).toArrow()  # a block of bounded size
        if rows.num_rows:
            part = _search_block(matched, highest, _Block(rows), k)
            hits = part if hits is None else hits.unionByName(part)
    if hits is None:
        hits = asked.sparkSession.createDataFrame([], _HITS)
    return _top(hits, k).select("item_id", "rank", "doc_id", "score")


def _search_block(matched: DataFrame, highest: DataFrame, block: _Block, k: int) -> DataFrame:
    bounds = stored(highest.repartition("m").sortWithinPartitions("m", "term").mapInArrow(_stratum_bounds(block), "item int, m long, bound long"))

    def visit(strata: DataFrame, floor: dict[int, int]) -> DataFrame:
        strata = stored(strata)
        strata = F.broadcast(strata) if strata.count() <= BROADCAST_STRATA else strata
        ordered = matched.join(strata, "m").repartition("chunk").sortWithinPartitions(F.desc("best"), "chunk", "term", "tf")
        return stored(ordered.select("m", "chunk", "term", "tf", "docs").mapInArrow(_score(block, k, floor), _HITS))

    promising = Window.partitionBy("item").orderBy(F.desc("bound"), "m")
    first = bounds.withColumn("place", F.row_number().over(promising)).where(F.col("place") <= FIRST_STRATA)
    first = first.groupBy("m").agg(F.max("bound").alias("best"))
    early = visit(first, {})
    floor = {r["item"]: r["score"] for r in _top(early, k).where(F.col("rank") == k).collect()}  # a row for each item of the block
    known = matched.sparkSession.createDataFrame([(i, s) for i, s in floor.items()], "item int, floor long")
    left = bounds.join(first.select("m"), "m", "left_anti").join(F.broadcast(known), "item", "left").where(F.col("bound") >= F.coalesce("floor", F.lit(1)))
    return early.unionByName(visit(left.groupBy("m").agg(F.max("bound").alias("best")), floor))
