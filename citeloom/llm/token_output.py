"""Token-ID output: documents as Parquet list columns that can be read selectively.

A token table is a folder with one Parquet file per range of ``doc_id``. Rows are in
ascending ``doc_id`` order within and across files. ``tokens`` is a dictionary-encoded
list column; ``doc_id``, ``n_tokens`` and ``local_start`` are delta-encoded. Row groups
and pages have fixed sizes and every file has a page index, so a filter on ``doc_id`` or
a metadata-only read touches only the pages it needs.
"""

from __future__ import annotations

import os
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

#: Bytes of a row group and of a page, and rows of a page.
ROW_GROUP_BYTES = 64 << 20
PAGE_BYTES = 256 << 10
PAGE_ROWS = 2_000
#: Distinct chunks (and twice as many words) a worker keeps encoded; beyond it the memory starts anew, results stay the same.
CACHED_CHUNKS = 200_000

TOKEN_SCHEMA = "doc_id long, part int, local_start long, n_tokens long, tokens array<int>"


#: Letters whose lower case is one letter each.
_LATIN = re.compile("[A-Za-zÀ-ÖØ-öø-ÿ]+").fullmatch
_MARK = "\x01"


class ChunkEncoder:
    """Encodes texts chunk by chunk and keeps the ids of the chunks seen.

    A vocabulary whose pre-tokenizer never joins text across blanks gives a text the ids
    of its blank-separated chunks, one after the other. Only the blank and the line feed
    are cut at; any other white space stays inside a chunk for the tokenizer to treat.
    A vocabulary that also ignores case and cuts punctuation off (``folds``, found out by
    trying it) shares the ids of a plain word between its spellings.
    """

    def __init__(self, vocabulary: str, cached_chunks: int = CACHED_CHUNKS) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(vocabulary)
        self.cached_chunks = cached_chunks
        self.chunks: dict[str, bytes] = {}
        self.words: dict[str, bytes] = {}
        ids = lambda text: self.tokenizer.encode(text, add_special_tokens=False).ids
        self.mark = ids(_MARK)[0] if len(ids(_MARK)) == 1 else None
        self.tail = {c: np.array(ids(c), "<i4").tobytes() for c in ("", ",", ".")}
        self.folds = ids("Éa, b.") == ids("éa") + ids(",") + ids("b") + ids(".")
        self.direct = self.folds and [t.id for t in self.tokenizer.model.tokenize("tokenizers")] == ids("tokenizers")
        vocab = self.tokenizer.get_vocab()
        self.last = np.zeros(max(vocab.values()) + 1, bool)  # ids that end a word
        self.last[[i for piece, i in vocab.items() if piece.endswith("</w>")]] = True

    def _encode(self, parts: list[str]) -> list[bytes]:
        """Ids of each part: many parts in one text, told apart by a mark that none of them holds."""
        out: dict[str, bytes] = {}
        alone = [p for p in parts if self.mark is None or _MARK in p or " " in p or not p]
        for p, e in zip(alone, self.tokenizer.encode_batch_fast(alone, add_special_tokens=False)):
            out[p] = np.array(e.ids, "<i4").tobytes()
        plain = [p for p in parts if p not in out]
        blocks = [plain[i:i + 500] for i in range(0, len(plain), 500)]
        for block, e in zip(blocks, self.tokenizer.encode_batch_fast([f" {_MARK} ".join([*block, ""]) for block in blocks], add_special_tokens=False)):
            ids = np.array(e.ids, "<i4")
            start = 0
            for p, end in zip(block, np.flatnonzero(ids == self.mark).tolist()):
                out[p] = ids[start:end].tobytes()
                start = end + 1
        return [out[p] for p in parts]

    def _encode_words(self, words: list[str]) -> list[bytes]:
        """Ids of each plain word. Letters of ASCII are their own byte symbols, so the library's model takes
        those words as they are; for the others a word's last piece carries the vocabulary's end-of-word mark."""
        pieces, out = self.tokenizer.model.tokenize, {}
        if self.direct:
            out = {w: np.array([t.id for t in pieces(w)], "<i4").tobytes() for w in words if w.isascii()}
        other = [w for w in words if w not in out]
        blocks = [other[i:i + 1000] for i in range(0, len(other), 1000)]
        for block, e in zip(blocks, self.tokenizer.encode_batch_fast([" ".join(block) for block in blocks], add_special_tokens=False)):
            ids = np.array(e.ids, "<i4")
            ends = (4 * np.flatnonzero(self.last[ids]) + 4).tolist()
            if len(ends) == len(block):
                whole = ids.tobytes()
                out.update(zip(block, [whole[a:b] for a, b in zip([0, *ends], ends)]))
            else:
                out.update(zip(block, self._encode(block)))
        return [out[w] for w in words]

    def _learn(self, chunks: list[str]) -> None:
        spelled = {end: ([], []) for end in self.tail}  # chunks and their words, by what is behind the word
        rest = []
        for chunk in chunks:
            end = chunk[-1:]
            word = chunk[:-1] if end == "," or end == "." else chunk
            if self.folds and word.isalpha() and (word.isascii() or _LATIN(word)):
                pair = spelled[end if word is not chunk else ""]
                pair[0].append(chunk)
                pair[1].append(word.lower())
            else:
                rest.append(chunk)
        if len(self.words) > 2 * self.cached_chunks:
            self.words = {}
        new = list(set().union(*(words for _, words in spelled.values())).difference(self.words))
        self.words.update(zip(new, self._encode_words(new)))
        for end, (found, words) in spelled.items():
            ids = map(self.words.__getitem__, words)
            self.chunks.update(zip(found, ids) if not end else zip(found, [i + self.tail[end] for i in ids]))
        self.chunks.update(zip(rest, self._encode(rest)))

    def encode(self, texts: list[str]) -> list[bytes]:
        """The ids of each text as little-endian 32-bit integers."""
        if self.folds:  # fewer spellings to keep; a special token's string is left as it is
            texts = [t.lower() if t.isascii() and "<|" not in t else t for t in texts]
        parts = [text.replace("\n", " ").split(" ") for text in texts]
        if len(self.chunks) > self.cached_chunks:
            self.chunks = {}
        if new := list(set().union(*parts).difference(self.chunks)):
            self._learn(new)
        ids = self.chunks.__getitem__
        return [b"".join(map(ids, part)) for part in parts]


_ENCODERS: dict[str, ChunkEncoder] = {}


def encoder_for(vocabulary: str, cached_chunks: int) -> ChunkEncoder:
    """The encoder of this Python worker; it serves one task after the other."""
    if vocabulary not in _ENCODERS:
        _ENCODERS[vocabulary] = ChunkEncoder(vocabulary, cached_chunks)
    return _ENCODERS[vocabulary]


def write_tokens(docs: DataFrame, path: str, vocabulary: str, end_id: int = 1, slice_bytes: int = 2 << 20,
                 cached_chunks: int = CACHED_CHUNKS) -> None:
    """Encode ``docs`` (doc_id, text; other columns are ignored) into a token table at ``path``.

    Whole texts are encoded and ``end_id`` is appended to each. A null or empty text has
    the end id alone. Rows of equal doc_id stay separate rows, ordered by a hash of their
    text; a null doc_id comes first. An empty table gives a table without rows. The files
    of a lost task are written again by Spark's committer.
    """

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        encoder, end = encoder_for(vocabulary, cached_chunks), np.array([end_id], "<i4").tobytes()
        part, start = TaskContext.get().partitionId(), 0
        for batch in batches:
            column, doc_ids = batch.column("text"), batch.column("doc_id")
            sizes = pc.fill_null(pc.binary_length(column), 0).to_numpy().tolist()
            low = 0
            while low < len(sizes):  # slices of bounded size, one long text at least
                high, size = low + 1, sizes[low]
                while high < len(sizes) and size + sizes[high] <= slice_bytes:
                    size += sizes[high]
                    high += 1
                encoded = [ids + end for ids in encoder.encode([t or "" for t in column.slice(low, high - low).to_pylist()])]
                tokens = np.frombuffer(b"".join(encoded), "<i4")
                counts = np.fromiter(map(len, encoded), np.int64, len(encoded)) // 4
                offsets = np.concatenate([[0], np.cumsum(counts)])
                yield pa.RecordBatch.from_arrays([
                    doc_ids.slice(low, high - low),
                    pa.array(np.full(high - low, part, np.int32)),
                    pa.array(start + offsets[:-1]),
                    pa.array(counts),
                    pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(tokens)),
                ], names=["doc_id", "part", "local_start", "n_tokens", "tokens"])
                start += int(offsets[-1])
                low = high

    ordered = (
        docs.select(F.col("doc_id").cast("long"), "text", F.xxhash64("text").alias("tie"))
        .repartitionByRange("doc_id", "tie")
        .sortWithinPartitions("doc_id", "tie")
        .select("doc_id", "text")
    )
    (
        ordered.mapInArrow(encode, TOKEN_SCHEMA).write
        .option("compression", "zstd")
        .option("parquet.writer.version", "PARQUET_2_0")
        .option("parquet.block.size", ROW_GROUP_BYTES)
        .option("parquet.page.size", PAGE_BYTES)
        .option("parquet.page.row.count.limit", PAGE_ROWS)
        .option("parquet.enable.dictionary", "false")
        .option("parquet.enable.dictionary#tokens.list.element", "true")
        .option("parquet.dictionary.page.size", 1 << 20)
        .parquet(path)
    )


def read_metadata(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, part, local_start, n_tokens and start (ids of all documents before it); no token page is read."""
    rows = spark.read.schema(TOKEN_SCHEMA).parquet(path).select("doc_id", "part", "local_start", "n_tokens")
    return rows.join(part_starts(spark, path), "part", "left").withColumn("start", F.col("part_start") + F.col("local_start")).drop("part_start")


def part_starts(spark: SparkSession, path: str) -> DataFrame:
    """part and part_start, the ids in all parts before it: a running sum over one row per file."""
    sums = spark.read.schema(TOKEN_SCHEMA).parquet(path).groupBy("part").agg(F.sum("n_tokens").alias("n"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    return sums.select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("part_start"))


def read_tokens(spark: SparkSession, path: str, where: Column | None = None, *columns: str) -> DataFrame:
    """Rows of a token table; ``where`` on doc_id prunes row groups and pages, ``columns`` prunes columns."""
    rows = spark.read.schema(TOKEN_SCHEMA).parquet(path)
    rows = rows if where is None else rows.where(where)
    return rows.select(*columns) if columns else rows


def token_digests(spark: SparkSession, path: str) -> DataFrame:
    """Per document: doc_id, start, n_tokens and the crc32 of its ids as little-endian unsigned 32-bit integers."""

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            tokens = batch.column("tokens")
            values = memoryview(tokens.values.to_numpy(zero_copy_only=False)).cast("B")  # 32-bit, little-endian; no copy without nulls
            offsets = tokens.offsets.to_numpy().tolist()
            crc = [zlib.crc32(values[4 * a:4 * b]) for a, b in zip(offsets, offsets[1:])]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("doc_id", "part", "local_start", "n_tokens")), pa.array(crc, pa.int64())],
                                             names=["doc_id", "part", "local_start", "n_tokens", "ids_crc32"])

    rows = spark.read.schema(TOKEN_SCHEMA).parquet(path)
    digests = rows.mapInArrow(digest, "doc_id long, part int, local_start long, n_tokens long, ids_crc32 long")
    return digests.join(part_starts(spark, path), "part").select(
        "doc_id", (F.col("part_start") + F.col("local_start")).alias("start"), "n_tokens", "ids_crc32")
