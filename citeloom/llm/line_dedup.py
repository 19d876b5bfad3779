"""Line deduplication against levelled sorted runs of line hashes.

The index is a set of runs: tables of (high, low, n_docs, last_doc, seen), one row per line
hash, dealt out by the hash and sorted within. Each batch of documents is merge-joined with the
runs: hashes that none of them holds are the batch's own, the others are marked ``seen`` and only
update counts. Both make one run of level 0. A level that holds ``fanout`` runs is compacted into one run of the
next level, so a hash is looked up in few runs and rewritten a logarithmic number of
times. Equal hashes of several runs add up: counts are summed, the last document is the
largest. A line is repeated only if a later batch has seen its hash or one batch holds it often enough, so
all other hashes stay out of the sums.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, functions as F

from citeloom.llm.common import ASCII_SPACE, stored
from citeloom.session import scratch_dir

RUN_SCHEMA = "high long, low long, n_docs long, last_doc long, seen boolean"
LINE_SCHEMA = "doc_id long, line int, high long, low long"
_SPACE = ASCII_SPACE.encode()


def _key(line: bytes) -> bytes:
    return line.strip(_SPACE).lower()  # bytes.lower() changes A-Z alone


def _long_enough(key: bytes, least: int) -> bool:
    # A code point has at most four bytes, so most keys need no decoding.
    return len(key) >= least and (len(key) >= 4 * least or len(key.decode("utf-8", "replace")) >= least)


def line_hashes(docs: DataFrame, min_chars: int = 40, distinct: bool = True) -> DataFrame:
    """doc_id, line number and 128-bit hash of every line key of at least ``min_chars`` code points.

    ``distinct``: a document yields each hash once, so a row stands for one document.
    """

    def hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, lines, digests = [], [], []
            for doc, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").cast(pa.binary()).to_pylist()):
                seen = set()
                for number, line in enumerate((text or b"").split(b"\n")):
                    key = _key(line)
                    if _long_enough(key, min_chars):
                        digest = xxhash.xxh3_128_digest(key)
                        if distinct:
                            if digest in seen:
                                continue
                            seen.add(digest)
                        ids.append(doc)
                        lines.append(number)
                        digests.append(digest)
            pair = np.frombuffer(b"".join(digests), ">i8").astype(np.int64).reshape(-1, 2)
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(lines, pa.int32()), pa.array(pair[:, 0]), pa.array(pair[:, 1])],
                                             names=["doc_id", "line", "high", "low"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(hashes, LINE_SCHEMA)


@dataclass
class LineIndex:
    """Levelled runs below ``path`` in shared storage. ``levels[i]`` lists the folders of the runs of level i."""

    spark: SparkSession
    path: str
    fanout: int = 4
    levels: list[list[str]] = field(default_factory=list)

    def runs(self) -> DataFrame | None:
        """All rows of all runs; a hash may come once per run."""
        folders = [run for level in self.levels for run in level]
        return self.spark.read.schema(RUN_SCHEMA).parquet(*folders) if folders else None

    def totals(self) -> DataFrame:
        """One row per hash over all runs."""
        rows = self.runs()
        if rows is None:
            return self.spark.createDataFrame([], RUN_SCHEMA)
        return _merged(rows)

    def repeated(self, min_docs: int) -> DataFrame:
        """(high, low, n_docs, last_doc) of the hashes that at least ``min_docs`` documents hold."""
        rows = self.runs()
        if rows is None:
            return self.totals()
        often = rows.where(F.col("seen") | (F.col("n_docs") >= min_docs)).select("high", "low").distinct()
        return _merged(rows.join(often, ["high", "low"], "left_semi")).where(F.col("n_docs") >= min_docs)

    def add(self, batch: DataFrame, min_chars: int = 40) -> str:
        """Write the run of one batch of documents (doc_id, text), compact full levels, return the run's folder.

        The batch is combined per hash before the shuffle, so a line that every document
        holds costs one row per task, and one row of the runs meets it.
        """
        rows = _merged(line_hashes(batch, min_chars).select("high", "low", F.lit(1).cast("long").alias("n_docs"), F.col("doc_id").alias("last_doc"), F.lit(False).alias("seen")))
        run = self._write(self._told_apart(rows), 0)
        level = 0
        while level < len(self.levels) and len(self.levels[level]) >= self.fanout:
            self._write(_merged(self.spark.read.schema(RUN_SCHEMA).parquet(*self.levels[level])), level + 1)
            self.levels[level] = []  # the old folders stay readable for queries that hold them
            level += 1
        return run

    def _told_apart(self, rows: DataFrame) -> DataFrame:
        """``rows`` of a batch with ``seen`` set for hashes that a run holds: a merge join with the first row of each hash."""
        runs = self.runs()
        if runs is None:
            return rows
        held = runs.where(~F.col("seen")).select("high", "low", F.lit(True).alias("held"))
        return rows.drop("seen").join(held.hint("merge"), ["high", "low"], "left").select("high", "low", "n_docs", "last_doc", F.coalesce("held", F.lit(False)).alias("seen"))

    def novel(self, batch: DataFrame, min_chars: int = 40) -> DataFrame:
        """Lines of a batch (doc_id, line, high, low) whose hash no run holds: a merge anti-join on the sorted hash."""
        lines, rows = line_hashes(batch, min_chars), self.runs()
        return lines if rows is None else lines.join(rows.select("high", "low"), ["high", "low"], "left_anti")

    def _write(self, rows: DataFrame, level: int) -> str:
        while len(self.levels) <= level:
            self.levels.append([])
        folder = f"{self.path}/level{level}-{scratch_dir(self.spark).rpartition('/')[2]}"
        # The aggregate left the rows dealt by their hash; sorting the parts makes them runs.
        rows.sortWithinPartitions("high", "low").write.option("compression", "zstd").parquet(folder)
        self.levels[level].append(folder)
        return folder


def _merged(rows: DataFrame) -> DataFrame:
    return rows.groupBy("high", "low").agg(F.sum("n_docs").alias("n_docs"), F.max("last_doc").alias("last_doc"), F.min("seen").alias("seen"))


def build_index(docs: DataFrame, path: str, batches: int = 5, fanout: int = 4, min_chars: int = 40) -> LineIndex:
    """Add ``docs`` to a new index batch by batch; batches are equal ranges of doc_id, null first."""
    index = LineIndex(docs.sparkSession, path, fanout)
    low, high = docs.agg(F.min("doc_id"), F.max("doc_id")).first()
    if low is None:
        index.add(docs, min_chars)
        return index
    width = max(1, -(-(high - low + 1) // batches))
    for k in range(batches):
        start = low + k * width
        inside = (F.col("doc_id") >= start) & (F.col("doc_id") < start + width)
        index.add(docs.where(inside | F.col("doc_id").isNull()) if k == 0 else docs.where(inside), min_chars)
    return index


def drop_repeated_lines(docs: DataFrame, index: LineIndex, min_docs: int = 5, min_chars: int = 40) -> DataFrame:
    """doc_id, kept (text), n_lines, n_dropped for every row of ``docs``.

    A line whose key is in at least ``min_docs`` documents of the index goes, except in
    the rows of the largest doc_id that holds it. Other lines stay, joined by line feeds.
    A null or empty text is one empty line. Each row counts as a document. A row with a null doc_id
    counts and loses its repeated lines; a line that only such rows hold stays. Other columns are ignored.
    """
    # Stored, so that both sides of the join below are plain exchanges, which AQE can split.
    often = stored(index.repeated(min_docs).where(F.col("last_doc").isNotNull()).select("high", "low", "last_doc"))
    # A hot line meets one row of `often`; AQE splits its partition and only (doc, line) pairs move on.
    hits = (
        line_hashes(docs, min_chars, distinct=False).join(often, ["high", "low"])
        .where(F.col("doc_id").isNull() | (F.col("doc_id") < F.col("last_doc")))
        .groupBy("doc_id").agg(F.collect_set(F.struct("high", "low")).alias("drop"))
    )
    joined = docs.select(F.col("doc_id").cast("long"), "text").join(hits.withColumnRenamed("doc_id", "hit_id"), F.col("doc_id").eqNullSafe(F.col("hit_id")), "left").select("doc_id", "text", "drop")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kept, n_lines, n_dropped = [], [], []
            for text, drop in zip(batch.column("text").cast(pa.binary()).to_pylist(), batch.column("drop").to_pylist()):
                lines = (text or b"").split(b"\n")
                n_lines.append(len(lines))
                if drop:
                    gone = {(d["high"].to_bytes(8, "big", signed=True) + d["low"].to_bytes(8, "big", signed=True)) for d in drop}
                    lines = [x for x in lines if not (_long_enough(key := _key(x), min_chars) and xxhash.xxh3_128_digest(key) in gone)]
                n_dropped.append(n_lines[-1] - len(lines))
                kept.append(b"\n".join(lines))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(kept, pa.binary()).cast(pa.string()), pa.array(n_lines, pa.int64()), pa.array(n_dropped, pa.int64())],
                                             names=["doc_id", "kept", "n_lines", "n_dropped"])

    return joined.mapInArrow(cut, "doc_id long, kept string, n_lines long, n_dropped long")
