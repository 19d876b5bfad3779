"""Removal of long repeated strings by column-wise construction over aligned contexts.

Every string of ``length`` bytes holds an anchor: the smallest hashed k-gram of its first
window, which depends on the string alone, so equal strings hold equal anchors at equal
places. The text around an anchor that comes more than once is its context; all contexts
of an anchor are one collection, aligned at the anchor. The collection is taken column by
column from the right: each round inserts one symbol of every context, stably re-sorts
the contexts by it (the positional Burrows-Wheeler order) and updates how far each agrees
with its neighbour. Neighbours that agree for ``length`` symbols hold a repeated string.

Spark deals out and sorts the contexts by anchor; a task takes them from its sorted
stream, which spills to files read in order, in chunks of whole anchors.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame, functions as F

from citeloom.llm.common import stored

LENGTH = 200
GRAM = 32
#: Contexts of an anchor that one task takes; an anchor with more is settled by hashed windows.
MAX_GROUP = 50_000
CHUNK = 16_000

_PIECE = 1 << 20
_RANDOM = np.random.default_rng(20).integers(0, 2**63, 256).astype(np.uint64) * np.uint64(2) + np.uint64(1)


def _gram_hashes(data: np.ndarray) -> np.ndarray:
    """A hash of each GRAM-byte string (GRAM is a power of two), by doubling."""
    h, size, factor = _RANDOM[data], 1, 0x9E3779B97F4A7C15
    while size < GRAM:
        h = h[:-size] * np.uint64(factor) + h[size:]
        size, factor = 2 * size, factor * factor % (1 << 64)
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(32))


def anchors(text: bytes, length: int = LENGTH) -> tuple[np.ndarray, np.ndarray]:
    """Places and hashes of the anchors: the leftmost smallest gram of each ``length``-byte string."""
    window = length - GRAM + 1
    places, hashes = [], []
    for low in range(0, max(0, len(text) - length + 1), _PIECE - window + 1):
        h = _gram_hashes(np.frombuffer(text, np.uint8, min(len(text) - low, _PIECE + GRAM - 1), low))
        if len(h) < window:
            break
        # The place breaks ties of the upper bits, so the leftmost wins in every copy.
        smallest = (h & ~np.uint64(_PIECE - 1)) | np.arange(len(h), dtype=np.uint64)
        size = 1
        while 2 * size <= window:
            smallest = np.minimum(smallest[:-size], smallest[size:])
            size *= 2
        if size < window:
            smallest = np.minimum(smallest[: len(smallest) - (window - size)], smallest[window - size:])
        at = smallest & np.uint64(_PIECE - 1)
        at = np.unique(at[np.concatenate([[True], at[1:] != at[:-1]])]).astype(np.int64)
        places.append(at + low)
        hashes.append(h[at])
    if not places:
        return np.empty(0, np.int64), np.empty(0, np.uint64)
    places, first = np.unique(np.concatenate(places), return_index=True)
    return places, np.concatenate(hashes)[first]


def _contexts(text: bytes, places: list[int], length: int) -> list[tuple[int, bytes, int]]:
    """Bytes before the anchor, context and its hash: all that a string of ``length`` bytes with the anchor may cover."""
    before = length - GRAM
    out = []
    for p in places:
        left = min(p, before)
        context = text[p - left:p + length]
        out.append((left, context, xxhash.xxh3_64_intdigest(context, seed=left)))
    return out


def _long(values) -> pa.Array:
    return pa.array(np.array(values, np.uint64).view(np.int64))


def _rows(docs: DataFrame) -> DataFrame:
    """uid and text; equal rows share a uid."""
    return docs.select(F.xxhash64("doc_id", "text").alias("uid"), "text")


def occurrences(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """anchor, context hash, uid and place of every anchor of every text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for uid, text in zip(batch.column("uid").to_pylist(), batch.column("text").cast(pa.binary()).to_pylist()):
                places, hashes = anchors(text or b"", length)
                if len(places):
                    digests = [h for _, _, h in _contexts(text, places.tolist(), length)]
                    yield pa.RecordBatch.from_arrays([pa.array(hashes.view(np.int64)), _long(digests), pa.array(np.full(len(places), uid)), pa.array(places.astype(np.int32))],
                                                     names=["anchor", "context", "uid", "place"])

    return _rows(docs).mapInArrow(_joined(run), "anchor long, context long, uid long, place int")


def _joined(run, rows: int = 20_000):
    """``run`` with its small batches put together."""

    def wrapped(batches):
        held, count = [], 0
        for out in run(batches):
            held.append(out)
            count += out.num_rows
            if count >= rows:
                yield from pa.Table.from_batches(held).combine_chunks().to_batches()
                held, count = [], 0
        if held:
            yield from pa.Table.from_batches(held).combine_chunks().to_batches()

    return wrapped


def distinct_contexts(repeated: DataFrame) -> DataFrame:
    """Each context with the bounds of its occurrences; equal bounds mean a single one. Combined before the shuffle."""
    return repeated.groupBy("anchor", "context").agg(F.min("uid").alias("uid"), F.max("uid").alias("uid_high"), F.min("place").alias("place"), F.max("place").alias("place_high"))


def context_texts(docs: DataFrame, needed: DataFrame, length: int = LENGTH) -> DataFrame:
    """``needed`` (anchor, context, uid, ...) with bytes before the anchor and the context's bytes, cut from the text of uid."""
    lists = needed.groupBy("uid").agg(F.collect_list(F.struct(*(c for c in needed.columns if c != "uid"))).alias("wanted"))
    texts = _packed(docs).dropDuplicates(["uid"]).join(lists, "uid")
    names = [f for f in needed.columns if f != "uid"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpack = zstandard.ZstdDecompressor()
        for batch in batches:
            for uid, packed, wanted in zip(*(batch.column(c).to_pylist() for c in ("uid", "packed", "wanted"))):
                text = unpack.decompress(packed)
                places, _ = anchors(text, length)
                found = {np.uint64(h).view(np.int64).item(): (left, context) for left, context, h in _contexts(text, places.tolist(), length)}
                hits = [found[w["context"]] for w in wanted]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([uid] * len(wanted), pa.int64()), *(pa.array([w[c] for w in wanted], pa.int32() if "place" in c else pa.int64()) for c in names),
                     pa.array([h[0] for h in hits], pa.int32()), pa.array([h[1] for h in hits], pa.binary())], names=["uid", *names, "before", "bytes"])

    kinds = ", ".join(f"{c} {'int' if 'place' in c else 'long'}" for c in ["uid", *names])
    return texts.mapInArrow(_joined(run, 4_000), f"{kinds}, before int, bytes binary")


def _packed(docs: DataFrame) -> DataFrame:
    """uid and the compressed text, which halves what the shuffle moves."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pack = zstandard.ZstdCompressor(level=3)
        for batch in batches:
            packed = [pack.compress(t or b"") for t in batch.column("text").cast(pa.binary()).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("uid"), pa.array(packed, pa.binary())], names=["uid", "packed"])

    return _rows(docs).mapInArrow(run, "uid long, packed binary")


def repeated_spans(columns: np.ndarray, before: np.ndarray, sizes: np.ndarray, uid: np.ndarray, uid_high: np.ndarray, place: np.ndarray, place_high: np.ndarray,
                   length: int = LENGTH) -> tuple[np.ndarray, np.ndarray]:
    """First and last column at which each context starts a repeated string (first > last: none).

    ``columns[j]`` holds symbol j of every context, 255 where it has none; the anchor is at
    column length - GRAM. Rounds run from the last column to the first. ``order`` is the
    positional Burrows-Wheeler order and ``agree[i]`` the column up to which context i of
    the order agrees with the one before it.
    """
    width, n = columns.shape
    lead = length - GRAM
    first, last = np.full(n, width), np.full(n, -1)
    order, agree = np.arange(n), np.full(n, width)
    low, high = lead - before, lead - before + sizes - length  # columns where a whole string may start
    for j in range(width - 1, -1, -1):
        symbols = columns[j][order]
        moved = np.argsort(symbols, kind="stable")
        symbols = symbols[moved]
        new = np.full(n, j)
        same = np.flatnonzero(symbols[1:] == symbols[:-1]) + 1
        p, q = moved[same], moved[same - 1]
        new[same] = agree[p]
        far = np.flatnonzero(p - q > 1)
        if len(far):  # the least agreement on the way between the two
            pairs = np.stack([q[far] + 1, p[far] + 1], axis=1).ravel()
            new[same[far]] = np.minimum.reduceat(np.append(agree, width), pairs)[::2]
        order, agree = order[moved], new
        if j > lead:
            continue
        linked = agree - j >= length
        linked[0] = False
        if not linked.any():
            continue
        starts = np.flatnonzero(~linked)
        runs = np.diff(np.append(starts, n))
        many = np.repeat(runs > 1, runs)
        rows = order[many]
        heads = np.concatenate([[0], np.cumsum(runs[runs > 1])[:-1]])
        lo, hi = np.minimum.reduceat, np.maximum.reduceat
        apart = (lo(uid[rows], heads) != hi(uid_high[rows], heads)) | (lo(place[rows], heads) != hi(place_high[rows], heads))
        rows = rows[np.repeat(apart, runs[runs > 1])]
        rows = rows[(low[rows] <= j) & (j <= high[rows])]
        first[rows] = j
        last[rows] = np.maximum(last[rows], j)
    return first, last


SPAN_SCHEMA = "anchor long, context long, start int, stop int"


def _span_batch(anchor, context, start, stop) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(anchor, pa.int64()), pa.array(context, pa.int64()), pa.array(start, pa.int32()), pa.array(stop, pa.int32())], names=["anchor", "context", "start", "stop"])


def collection_spans(texts: DataFrame, length: int = LENGTH, chunk: int = CHUNK) -> DataFrame:
    """anchor, context and the span, relative to the anchor, that repeated strings cover in it; texts of small groups."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def solve(table: pa.Table) -> pa.RecordBatch:
            n, width, lead = table.num_rows, 2 * length - GRAM, length - GRAM
            column = {c: table.column(c).to_numpy() for c in ("anchor", "context", "uid", "uid_high", "place", "place_high", "before")}
            data = table.column("bytes").combine_chunks()
            data = data.chunk(0) if isinstance(data, pa.ChunkedArray) else data
            offsets = np.frombuffer(data.buffers()[1], np.int32)[data.offset:data.offset + n + 1].astype(np.int64)
            raw, sizes = np.frombuffer(data.buffers()[2], np.uint8), np.diff(offsets)
            matrix = np.full((n, width), 255, np.uint8)
            row = np.repeat(np.arange(n), sizes)
            matrix[row, np.arange(offsets[0], offsets[-1]) - np.repeat(offsets[:-1] - (lead - column["before"]), sizes)] = raw[offsets[0]:offsets[-1]]
            first, last = repeated_spans(np.ascontiguousarray(matrix.T), column["before"], sizes, column["uid"], column["uid_high"], column["place"], column["place_high"], length)
            hit = last >= first
            return _span_batch(column["anchor"][hit], column["context"][hit], (first[hit] - lead).astype(np.int32), (last[hit] - lead + length).astype(np.int32))

        rows = 0
        for batch in batches:
            held.append(batch)
            rows += batch.num_rows
            if rows >= chunk:
                table = pa.Table.from_batches(held).combine_chunks()
                keys = table.column("anchor").to_numpy()
                cut = int(np.searchsorted(keys, keys[-1]))  # the last anchor may go on
                if cut:
                    yield solve(table.slice(0, cut).combine_chunks())
                held, rows = [table.slice(cut).combine_chunks().to_batches()[0]], len(keys) - cut
        if rows:
            yield solve(pa.Table.from_batches(held).combine_chunks())

    return texts.repartition("anchor").sortWithinPartitions("anchor").mapInArrow(run, SPAN_SCHEMA)


def hashed_spans(texts: DataFrame, length: int = LENGTH) -> DataFrame:
    """The same for contexts of very large groups: equal strings meet by their 128-bit hash, combined before the shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ("anchor", "context", "uid", "uid_high", "place", "place_high", "before", "bytes")
        for batch in batches:
            for anchor, context, uid, uid_high, place, place_high, before, data in zip(*(batch.column(c).to_pylist() for c in names)):
                count = len(data) - length + 1
                if count < 1:
                    continue
                hashes = np.array([divmod(xxhash.xxh3_128_intdigest(data[x:x + length]), 1 << 64) for x in range(count)], np.uint64).view(np.int64)
                at = np.arange(count, dtype=np.int32) - before
                full = lambda v: pa.array(np.full(count, v))
                yield pa.RecordBatch.from_arrays([full(anchor), full(context), pa.array(at), pa.array(hashes[:, 0]), pa.array(hashes[:, 1]), full(uid), full(uid_high), full(place), full(place_high)],
                                                 names=["anchor", "context", "at", "high", "low", "uid", "uid_high", "place", "place_high"])

    windows = texts.mapInArrow(_joined(run), "anchor long, context long, at int, high long, low long, uid long, uid_high long, place long, place_high long")
    # Aligned contexts of one anchor: a string starts at one distance from it.
    seen = windows.groupBy("anchor", "at", "high", "low").agg(
        (F.min("uid") != F.max("uid_high")).alias("uids"), (F.min("place") != F.max("place_high")).alias("places"))
    twice = stored(seen.where("uids or places").select("anchor", "at", "high", "low"))
    hit = windows.join(twice, ["anchor", "at", "high", "low"])
    return hit.groupBy("anchor", "context").agg(F.min("at").cast("int").alias("start"), (F.max("at") + length).cast("int").alias("stop"))


def remove_repeated(docs: DataFrame, length: int = LENGTH, max_group: int = MAX_GROUP, chunk: int = CHUNK) -> DataFrame:
    """doc_id, kept (binary), n_bytes, n_removed, n_spans for every row of ``docs`` (doc_id, text).

    Each byte covered by a string of ``length`` bytes that also starts anywhere else, in
    the same or another text, is removed; strings are judged on the input and never cross
    texts. Null and empty texts have no bytes. Equal rows are texts of their own, so a
    text of ``length`` bytes or more that has an equal row goes. Other columns are ignored.
    """
    docs = docs.select(F.col("doc_id").cast("long"), "text")
    found = occurrences(docs, length)
    often = stored(found.groupBy("anchor").agg(F.count("*").alias("n")).where("n > 1").select("anchor"))
    repeated = stored(found.join(often, "anchor"), compression="zstd")
    contexts = stored(distinct_contexts(repeated), compression="zstd")
    sizes = stored(contexts.groupBy("anchor").agg(F.count("*").alias("n_contexts")).where("n_contexts > 1"))
    # Contexts alone with their anchor need no comparison: they are repeated as a whole or not at all.
    shared = contexts.join(sizes, "anchor")
    spans = collection_spans(context_texts(docs, shared.where(F.col("n_contexts") <= max_group).drop("n_contexts"), length), length, chunk)
    large = sizes.where(F.col("n_contexts") > max_group)
    if not large.isEmpty():
        spans = spans.union(hashed_spans(stored(context_texts(docs, shared.where(F.col("n_contexts") > max_group).drop("n_contexts"), length)), length))
    spans = stored(spans)
    # A context that occurs twice is repeated as a whole; its bounds follow from the text, so they are cut there.
    whole = contexts.where("uid <> uid_high or place <> place_high").select("anchor", "context", F.lit(GRAM - length).alias("start"), F.lit(length).alias("stop"))
    marks = whole.union(spans.join(whole.select("anchor", "context"), ["anchor", "context"], "left_anti"))
    cover = (repeated.join(marks, ["anchor", "context"])
             .groupBy("uid").agg(F.collect_list(F.struct((F.col("place") + F.col("start")).alias("a"), (F.col("place") + F.col("stop")).alias("b"))).alias("spans")))
    twins = _rows(docs).groupBy("uid").agg((F.count("*") > 1).alias("twin")).where("twin")
    keyed = docs.withColumn("uid", F.xxhash64("doc_id", "text"))
    joined = keyed.join(cover.join(twins, "uid", "full"), "uid", "left").select("doc_id", "text", "spans", "twin")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for doc, text, spans, twin in zip(batch.column("doc_id").to_pylist(), batch.column("text").cast(pa.binary()).to_pylist(), batch.column("spans").to_pylist(), batch.column("twin").to_pylist()):
                text = text or b""
                n = len(text)
                runs: list[list[int]] = []
                pieces = [(0, n)] if twin and n >= length else sorted((max(0, s["a"]), min(n, s["b"])) for s in spans or ())
                for a, b in pieces:
                    if runs and a <= runs[-1][1]:
                        runs[-1][1] = max(runs[-1][1], b)
                    else:
                        runs.append([a, b])
                kept, at = [], 0
                for a, b in runs:
                    kept.append(text[at:a])
                    at = b
                kept = b"".join([*kept, text[at:]])
                out.append((doc, kept, n, n - len(kept), len(runs)))
            columns = list(zip(*out))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(columns[1], pa.binary()), *(pa.array(c, pa.int64()) for c in columns[2:])], names=["doc_id", "kept", "n_bytes", "n_removed", "n_spans"])

    return joined.mapInArrow(run, "doc_id long, kept binary, n_bytes long, n_removed long, n_spans long")
