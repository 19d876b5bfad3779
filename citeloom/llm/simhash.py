"""SimHash near-duplicates through segment popcounts.

A 64-bit fingerprint is embedded as the bit counts of its 32 two-bit segments. The
Manhattan distance of two embeddings never exceeds the Hamming distance of the
fingerprints, so it serves as a lower bound. The embedding is cut into two halves of 16
segments. If two fingerprints differ in at most three bits, their embeddings differ by at
most one in one of the halves: the grid's cells are the half embeddings, every
fingerprint lies in one cell of each half and also looks into the cells at distance one.
Pairs that meet are held against the Manhattan bound over both halves and then against
the exact Hamming distance.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from operator import add

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from citeloom.llm.common import small, stored
from citeloom.operators.components import connected_components

SEED = 42
MAX_BITS = 3


def shingle_hashes(text: bytes, size: int = 3) -> np.ndarray:
    """XXH64 of each word shingle of the lower-cased text; the whole sequence if it has fewer words, none if it has none."""
    words = text.lower().split()  # bytes: A-Z alone change, [\x20\x09-\x0D] alone split
    if not words:
        return np.empty(0, np.uint64)
    joined, digest = b" ".join(words), xxhash.xxh64_intdigest
    if len(words) <= size:
        return np.array([digest(joined, SEED)], np.uint64)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
    starts = [0, *ends[: len(words) - size].tolist()]
    return np.array([digest(joined[a:b], SEED) for a, b in zip(starts, (ends[size - 1:] - 1).tolist())], np.uint64)


def simhash(hashes: np.ndarray) -> int:
    """A bit is set if it is set in over half the hashes; no hash gives zero."""
    if not len(hashes):
        return 0
    bits = np.unpackbits(hashes.astype(">u8").view(np.uint8).reshape(-1, 8), axis=1)
    majority = 2 * bits.sum(axis=0, dtype=np.int64) > len(hashes)
    return int.from_bytes(np.packbits(majority).tobytes(), "big")


def fingerprints(docs: DataFrame, size: int = 3) -> DataFrame:
    """doc_id, row key, text key and the signed 64-bit fingerprint of every whole text; a null text has fingerprint zero."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small(batches):
            values = [simhash(shingle_hashes(t or b"", size)) for t in batch.column("text").cast(pa.binary()).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("row"), batch.column("node"), pa.array(np.array(values, np.uint64).view(np.int64))], names=["doc_id", "row", "node", "fp"])

    return docs.select(F.col("doc_id").cast("long"), row_key().alias("row"), F.xxhash64("text").alias("node"), "text").mapInArrow(run, "doc_id long, row long, node long, fp long")


def row_key():
    return F.xxhash64("doc_id", "text")


_LOW = 0x5555555555555555  # the lower bit of each segment


def _signed(value: int) -> int:
    return value - (1 << 64) if value >> 63 else value


def _embed(fp):
    """Bit counts of the 32 two-bit segments in unary form: 0, 1, 2 as 00, 01, 11.

    The Manhattan distance of two embeddings is the number of bits in which they differ.
    """
    up = F.shiftrightunsigned(fp, 1)
    low = fp.bitwiseOR(up).bitwiseAND(F.lit(_LOW))
    high = fp.bitwiseAND(up).bitwiseAND(F.lit(_LOW))
    return low.bitwiseOR(F.shiftleft(high, 1))


def _cells(classes: DataFrame) -> DataFrame:
    """fp, embedding, half and cell: the half embedding a fingerprint lies in."""
    halves = F.explode(F.array(*(F.struct(F.lit(h).alias("half"), F.col("e").bitwiseAND(F.lit(_signed(mask))).alias("cell"))
                                 for h, mask in enumerate((0xFFFFFFFF00000000, 0xFFFFFFFF)))))
    return classes.select("fp", _embed(F.col("fp")).alias("e")).select("fp", "e", halves.alias("c")).select("fp", "e", "c.half", "c.cell")


def _probes(cells: DataFrame) -> DataFrame:
    """Each cell and its neighbours with one segment count higher; the lower of two neighbours finds the other."""

    def higher(bit):
        double = F.shiftleft(bit, 1)
        cell = F.col("cell")
        return (F.when(cell.bitwiseAND(bit) == 0, cell.bitwiseOR(bit))
                .when(cell.bitwiseAND(double) == 0, cell.bitwiseOR(double)))

    def bits(half: int):
        return F.array(*(F.lit(_signed(1 << (2 * s + 32 * (1 - half)))) for s in range(16)))

    ups = F.transform(F.when(F.col("half") == 0, bits(0)).otherwise(bits(1)), higher)
    around = F.concat(F.array("cell"), F.filter(ups, lambda c: c.isNotNull()))
    return cells.select("fp", "e", "half", F.col("cell").alias("own"), F.explode(around).alias("cell"))


def near_links(classes: DataFrame, max_bits: int = MAX_BITS) -> DataFrame:
    """All pairs a < b of distinct fingerprints (column fp) that differ in at most ``max_bits`` (up to 3) bits.

    A pair must differ by at most one in one half of the embedding, so both halves' grids
    together miss none. The bounds are part of the join, so only true links leave it.
    """
    if not 0 <= max_bits <= 3:
        raise ValueError("two halves at distance one cover up to three bits")
    cells = _cells(classes)
    home, probe = cells.alias("h"), _probes(cells).alias("p")
    meet = (
        (F.col("h.half") == F.col("p.half")) & (F.col("h.cell") == F.col("p.cell"))
        & ((F.col("p.own") != F.col("p.cell")) | (F.col("p.fp") < F.col("h.fp")))
        & (F.bit_count(F.col("h.e").bitwiseXOR(F.col("p.e"))) <= max_bits)  # Manhattan lower bound
        & (F.bit_count(F.col("h.fp").bitwiseXOR(F.col("p.fp"))) <= max_bits)
    )
    pairs = home.join(probe, meet)
    return pairs.select(F.least("h.fp", "p.fp").alias("a"), F.greatest("h.fp", "p.fp").alias("b")).distinct()


def near_duplicates(docs: DataFrame, size: int = 3, max_bits: int = MAX_BITS) -> DataFrame:
    """doc_id, row, fp and component_id, the smallest doc_id that can be reached over links.

    Equal fingerprints are one class; links are sought between classes, so copies cost no
    pairs. Texts without words have fingerprint zero and link like any other. Rows with
    equal doc_id each have their own fingerprint; a null doc_id never names a component
    that has another member. Other columns are ignored; an empty table gives no rows.
    """
    prints = stored(fingerprints(docs, size))
    classes = stored(prints.groupBy("fp").agg(F.min("doc_id").alias("first_doc")))
    roots = connected_components(near_links(classes, max_bits))
    members = classes.join(roots.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "first_doc", F.coalesce("root", "fp").alias("root"))
    named = members.groupBy("root").agg(F.min("first_doc").alias("component_id"))
    labels = members.join(named, "root").select("fp", "component_id")
    return prints.join(labels, "fp")


#: Sketches of a text and the shingles in each: texts of similarity 0.8 share a sketch with probability 0.99.
SKETCHES = 10
SKETCH_SHINGLES = 4


#: Bits of the shortest parity vector of a set, which travels with its shingles.
PARITY_BITS = 512
PARITY_WORDS = [f"e{i}" for i in range(PARITY_BITS // 64)]


def parity(hashes: np.ndarray) -> tuple[bytes, np.ndarray]:
    """Parity vector of a set of at least as many bits as it has hashes, a power of two, and its PARITY_BITS-bit fold in words.

    A bit is set if an odd number of hashes have its number as their low bits. Two vectors of one length differ in at
    most as many bits as the sets have hashes that are not common, so the distance is a lower bound. The exclusive or
    of its halves is the vector of half the length.
    """
    bits = max(PARITY_BITS, 1 << max(len(hashes) - 1, 1).bit_length())
    odd = np.bincount((hashes & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1
    fold = odd.reshape(-1, PARITY_BITS).sum(axis=0) & 1
    packed = np.packbits(odd.astype(np.uint8), bitorder="little").tobytes()
    return packed, np.packbits(fold.astype(np.uint8), bitorder="little").view("<i8")


def parity_distance(a: bytes, b: bytes) -> int:
    """Bits in which two parity vectors differ, the longer one folded to the length of the other."""
    if len(a) < len(b):
        a, b = b, a
    x, size = int.from_bytes(a, "little"), len(a)
    while size > len(b):
        size //= 2
        x = x >> 8 * size ^ x & (1 << 8 * size) - 1
    return (x ^ int.from_bytes(b, "little")).bit_count()


def sketches(docs: DataFrame, size: int = 5) -> DataFrame:
    """node, sketch number and fingerprint of SKETCHES samples of each text's distinct shingles.

    The last number has the hash of the whole set, equal for equal sets, the set's size ``n`` and its parity vector.
    Sample t is the SKETCH_SHINGLES smallest shingle hashes under the t-th rehash, so
    similar texts often have an equal sample and thus fingerprints at distance zero.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        odd = np.random.default_rng(SEED).integers(1, 2**63, SKETCHES).astype(np.uint64) * np.uint64(2) + np.uint64(1)
        for batch in small(batches):
            nodes, values, last = [], [], []  # last: what the last number alone has
            for node, text in zip(batch.column("node").to_pylist(), batch.column("text").cast(pa.binary()).to_pylist()):
                hashes = np.unique(shingle_hashes(text or b"", size))
                if len(hashes):
                    nodes.append(node)
                    last += [(None, None, None)] * SKETCHES + [(len(hashes), *parity(hashes))]
                    rehashed = hashes[None, :] * odd[:, None]
                    rehashed ^= rehashed >> np.uint64(31)
                    k = min(SKETCH_SHINGLES, len(hashes))
                    least = np.sort(np.partition(rehashed, k - 1, axis=1)[:, :k], axis=1)
                    values.extend(map(simhash, least))
                    values.append(xxhash.xxh64_intdigest(hashes.tobytes(), SEED))
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(np.array(nodes, np.int64), SKETCHES + 1)), pa.array(np.tile(np.arange(SKETCHES + 1, dtype=np.int32), len(nodes))),
                                              pa.array(np.array(values, np.uint64).view(np.int64)), pa.array([x for x, _, _ in last], pa.int64()), pa.array([x for _, x, _ in last], pa.binary()),
                                              *(pa.array([None if x is None else x[i] for _, _, x in last], pa.int64()) for i in range(len(PARITY_WORDS)))],
                                             names=["node", "sketch", "fp", "n", "parity", *PARITY_WORDS])

    return docs.select(F.xxhash64("text").alias("node"), "text").mapInArrow(run, "node long, sketch int, fp long, n long, parity binary, " + ", ".join(f"{w} long" for w in PARITY_WORDS))


#: The shingles of all rows are counted in buckets named by so many high bits of their hash, and the buckets summed in
#: blocks of so many. Counts only set the order of shingles.
BUCKET_BITS = 22
BLOCK_BITS = 14


def _levels(docs: DataFrame, size: int) -> np.ndarray:
    """How many shingles of all rows fall into each bucket, a row's equal ones once, as a byte: eight steps for twice the count.

    A task counts its rows in one table; the tables are summed block by block, so a table of bytes is all that the driver gets.
    """
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(1 << BUCKET_BITS, np.uint32)
        for batch in small(batches, 50):
            for text in batch.column("text").cast(pa.binary()).to_pylist():
                np.add.at(counts, np.unique(shingle_hashes(text or b"", size)) >> np.uint64(64 - BUCKET_BITS), 1)
        for block, part in enumerate(counts.reshape(-1, 1 << BLOCK_BITS)):
            if part.any():
                yield pa.RecordBatch.from_arrays([pa.array([block], pa.int32()), pa.array([part.tobytes()], pa.binary())], names=["block", "counts"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = {}
        for batch in batches:
            for block, part in zip(batch.column("block").to_pylist(), batch.column("counts").to_pylist()):
                sums[block] = sums.get(block, 0) + np.frombuffer(part, np.uint32).astype(np.int64)
        levels = [np.minimum(np.round(8 * np.log2(1 + n)), 255).astype(np.uint8).tobytes() for n in sums.values()]
        yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int32()), pa.array(levels, pa.binary())], names=["block", "levels"])

    counted = docs.select("text").mapInArrow(count, "block int, counts binary")
    summed = counted.repartition("block").mapInArrow(add, "block int, levels binary").toArrow()
    out = np.zeros((1 << BUCKET_BITS - BLOCK_BITS, 1 << BLOCK_BITS), np.uint8)
    for block, levels in zip(summed.column("block").to_pylist(), summed.column("levels").to_pylist()):
        out[block] = np.frombuffer(levels, np.uint8)
    return out.reshape(-1)


def _prefix(n, part: float):
    """How many of the first of ``n`` shingles, in a common order, a set must share one of if it shares ``part`` of all."""
    return n - np.ceil(part * n - 1e-9).astype(np.int64) + 1


def prefixes(docs: DataFrame, size: int, similarity: float) -> DataFrame:
    """shingle, node, packed: the first shingles of each text, rarest first, that a text of ``similarity`` must share one of.

    ``packed`` holds the number of shingles, the place of this one and, as its last bit, whether it is among the
    fewer that do for a partner with no fewer shingles.
    """
    sent = docs.sparkSession.sparkContext.broadcast(_levels(docs, size))  # a byte for each bucket

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        levels = sent.value
        for batch in small(batches, 100):
            nodes, firsts, sizes = [], [np.empty(0, np.uint64)], []
            for node, text in zip(batch.column("node").to_pylist(), batch.column("text").cast(pa.binary()).to_pylist()):
                hashes = np.unique(shingle_hashes(text or b"", size))
                if len(hashes):
                    hashes = hashes[np.argsort(levels[hashes >> np.uint64(64 - BUCKET_BITS)], kind="stable")]
                    nodes.append(node)
                    sizes.append(len(hashes))
                    firsts.append(hashes[:_prefix(np.int64(len(hashes)), similarity)])
            lengths = np.array([len(x) for x in firsts[1:]], np.int64)
            n = np.repeat(np.array(sizes, np.int64), lengths)
            place = np.arange(len(n)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
            packed = n << 32 | place << 1 | (place < _prefix(n, 2 * similarity / (1 + similarity)))
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(firsts).view(np.int64)), pa.array(np.repeat(np.array(nodes, np.int64), lengths)), pa.array(packed)],
                                             names=["shingle", "node", "packed"])

    return docs.select(F.xxhash64("text").alias("node"), "text").mapInArrow(run, "shingle long, node long, packed long")


def _shared(rows: DataFrame) -> DataFrame:
    """The distinct rows of the shingles that more than one node holds.

    Rows are dealt out once and read in order of (shingle, node); copies of a text give equal rows next to each other,
    of which the first counts. Only one row waits: the first of a shingle, until another node follows.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, waiting, open_shared = None, None, False  # the row before, the only row of its shingle so far, whether that has several
        for batch in batches:
            if not batch.num_rows:
                continue
            shingle, node = batch.column("shingle").to_numpy(), batch.column("node").to_numpy()
            goes_on = last is not None and last[0] == shingle[0]
            fresh = np.concatenate([[not goes_on], shingle[1:] != shingle[:-1]])
            again = np.concatenate([[goes_on and last[1] == node[0]], (node[1:] == node[:-1]) & ~fresh[1:]])
            group = np.cumsum(fresh) - (not goes_on)  # 0: the shingle of the batch before, if it goes on
            several = np.bincount(group, weights=~fresh & ~again, minlength=group[-1] + 1) > 0
            if goes_on:
                several[0] |= open_shared
                if several[0] and waiting is not None:
                    yield waiting
                    waiting = None
            else:
                waiting = None
            kept = several[group] & ~again
            if kept.any():
                yield batch.take(pa.array(np.flatnonzero(kept)))
            open_shared = bool(several[-1])
            alone = np.flatnonzero((group == group[-1]) & fresh)
            if open_shared:
                waiting = None
            elif len(alone):
                waiting = batch.take(pa.array(alone))
            last = (shingle[-1], node[-1])

    return rows.repartition("shingle").sortWithinPartitions("shingle", "node").mapInArrow(run, "shingle long, node long, packed long")


def _several(rows: DataFrame, key: str, value: str) -> DataFrame:
    """The rows of the keys that have more than one value."""
    keys = rows.groupBy(key).agg(F.min(value).alias("low"), F.max(value).alias("high")).where("low <> high").select(key)
    return rows.join(keys, key)


#: Partners that are held against one copy of a text's shingles.
PARTNERS = 1_000
#: Keys up to this number go to every task; beyond it texts and keys are joined by a shuffle.
BROADCAST_KEYS = 4_000_000
#: Bytes of a shingle's hash in the sets that are compared.
HASH_BYTES = 5


def _blank():
    """Whether a text has no words."""
    return ~F.coalesce("text", F.lit("")).rlike("[^\\x20\\x09-\\x0D]")


def fingerprint_pairs(docs: DataFrame, max_bits: int = MAX_BITS) -> DataFrame:
    """Pairs (a, b) of different texts that the operator's links suggest as near-duplicates, at most two for a text.

    Texts of one fingerprint meet the first of them. The first ones of linked fingerprints meet too, each fingerprint
    the one of its links that has most links itself (the original of its copies), so a group costs a row per member.
    """
    texts = stored(fingerprints(docs.where(~_blank())).select("node", "fp").distinct(), compression="zstd")
    classes = stored(texts.groupBy("fp").agg(F.min("node").alias("first")), compression="zstd")
    links = stored(near_links(classes, max_bits), compression="zstd")
    ends = links.union(links.select("b", "a"))
    weights = ends.groupBy(F.col("a").alias("b")).agg(F.count("*").alias("weight"))
    heads = ends.join(weights, "b").groupBy("a").agg(F.max(F.struct("weight", "b"))["b"].alias("b"))
    first = lambda end: classes.select(F.col("fp").alias(end), F.col("first").alias(f"{end}_first"))
    linked = heads.join(first("a"), "a").join(first("b"), "b").select(F.col("b_first").alias("a"), F.col("a_first").alias("b"))
    equal = texts.join(classes, "fp").where("node <> first").select(F.col("first").alias("a"), F.col("node").alias("b"))
    return linked.union(equal)


def _named(keys: DataFrame) -> DataFrame:
    """A stored table of keys, sent to every task if it has at most BROADCAST_KEYS rows."""
    return F.broadcast(keys) if keys.count() <= BROADCAST_KEYS else keys


def _one_row_each(docs: DataFrame) -> DataFrame:
    """The keys of one row of each distinct text."""
    return docs.groupBy(F.xxhash64("text").alias("node")).agg(F.min(row_key()).alias("_row"))


def _verified(docs: DataFrame, pairs: DataFrame, size: int, similarity: float) -> DataFrame:
    """The ``pairs`` (a, b) of texts whose shingle sets reach ``similarity``.

    The sets of all partners b of a text travel to that text's set, once each; a text with many partners has
    copies of its set, one for PARTNERS of them.
    """
    def shingles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small(batches):
            sets = [np.unique(shingle_hashes(t or b"", size) >> np.uint64(64 - 8 * HASH_BYTES)).astype("<u8").view(np.uint8).reshape(-1, 8)[:, :HASH_BYTES].tobytes()
                    for t in batch.column("text").cast(pa.binary()).to_pylist()]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("a", "part", "b")), pa.array(sets, pa.binary())], names=["a", "part", "b", "shingles"])

    def unpacked(raw: bytes) -> np.ndarray:
        out = np.zeros((len(raw) // HASH_BYTES, 8), np.uint8)
        out[:, :HASH_BYTES] = np.frombuffer(raw, np.uint8).reshape(-1, HASH_BYTES)
        return out.reshape(-1).view("<u8")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, own = None, np.empty(0, np.uint64)
        for batch in small(batches):
            found = []
            for a, part, b, raw in zip(*(batch.column(c).to_pylist() for c in ("a", "part", "b", "shingles"))):
                if a == b:  # comes first in its part
                    held, own = (a, part), unpacked(raw)
                elif held == (a, part):
                    other = unpacked(raw)
                    both = len(np.intersect1d(own, other, assume_unique=True))
                    if both >= similarity * (len(own) + len(other) - both):
                        found.append((a, b))
            yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in found], pa.int64()), pa.array([x for _, x in found], pa.int64())], names=["a", "b"])

    parts = stored(pairs.groupBy("a").agg((F.count("*") / PARTNERS).cast("int").alias("more")), compression="zstd")
    sent = pairs.join(parts, "a").select("a", F.pmod(F.xxhash64("b"), F.col("more") + 1).cast("int").alias("part"), "b")
    own = parts.select("a", F.explode(F.sequence(F.lit(0), F.col("more"))).alias("part"), F.col("a").alias("b"))
    wanted = sent.unionByName(own)
    rows = _one_row_each(docs).withColumnRenamed("node", "b")
    wanted = stored(wanted.join(rows, "b"), compression="zstd")
    texts = docs.select(row_key().alias("_row"), "text").join(_named(wanted), "_row")
    sets = texts.select("a", "part", "b", "text").mapInArrow(shingles, "a long, part int, b long, shingles binary")
    met = sets.repartition("a", "part").sortWithinPartitions("a", "part", F.col("a") != F.col("b"), "b").mapInArrow(compare, "a long, b long")
    return met.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def _possible(pairs: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """The ``pairs`` (a, b) whose parity vectors do not rule ``similarity`` out."""

    def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small(batches, 2000):
            most = (batch.column("n").to_numpy() * ((1 - similarity) / (1 + similarity)) + 1e-6).tolist()
            kept = [parity_distance(x, y) <= m for x, y, m in zip(batch.column("x").to_pylist(), batch.column("y").to_pylist(), most)]
            yield batch.select(["a", "b"]).filter(pa.array(kept, pa.bool_()))

    own = sets.select(F.col("node").alias("a"), F.col("n").alias("_n"), F.col("parity").alias("x"))
    other = sets.select(F.col("node").alias("b"), "n", F.col("parity").alias("y"))
    return pairs.join(own, "a").join(other, "b").select("a", "b", (F.col("_n") + F.col("n")).alias("n"), "x", "y").mapInArrow(near, "a long, b long")


def _meeting(first: DataFrame, similarity: float) -> DataFrame:
    """Pairs (a, b) of texts of different roots that share a first shingle and may reach ``similarity``, a row per such shingle."""
    x, y = first.where("small").alias("x"), first.alias("y")
    apart = reduce(add, (F.bit_count(F.col(f"x.{w}").bitwiseXOR(F.col(f"y.{w}"))) for w in PARITY_WORDS))
    most = F.lit((1 - similarity) / (1 + similarity)) * (F.col("x.n") + F.col("y.n")) + 1e-6  # shingles not in common
    least = F.lit(similarity / (1 + similarity)) * (F.col("x.n") + F.col("y.n")) - 1e-6  # shingles in common
    meet = (
        (F.col("x.shingle") == F.col("y.shingle")) & (F.col("x.root") != F.col("y.root"))
        & ((F.col("x.n") < F.col("y.n")) | ((F.col("x.n") == F.col("y.n")) & (F.col("x.node") < F.col("y.node"))))
        & (F.least(F.col("x.n") - F.col("x.place"), F.col("y.n") - F.col("y.place")) >= least)  # true of the first shingle that a pair shares
        & (apart <= most)
    )
    return x.join(y, meet).select(F.col("x.node").alias("a"), F.col("y.node").alias("b"))


def similar_links(docs: DataFrame, size: int = 5, similarity: float = 0.8) -> DataFrame:
    """Links (a, b) of distinct texts whose shingle sets have a Jaccard similarity of at least ``similarity``.

    The components of the links are those of all such pairs; of a group not every pair is
    named. First come the links of operator 5: fingerprints within MAX_BITS bits, found over the grid of half
    embeddings (``fingerprint_pairs``). Texts of equal sets are linked to one of them. Texts that share a sketch meet the
    one of them that shares the most sketches with others (the original of its copies), each text the one such
    head that it shares most sketches with, so a group costs a row per member. What these links
    leave apart meets by an exact prefix filter: similar texts share one of their first
    shingles, rarest first, with enough behind it in both, and their parity vectors are near
    enough: the short ones inside the join, the whole ones of the pairs that are left. All pairs that remain are verified.
    """
    every = stored(sketches(docs, size), compression="zstd")
    drawn = every.select("node", "sketch", "fp").distinct()
    shared = drawn.groupBy("sketch", "fp").agg(F.count("*").alias("n")).where("n > 1")
    drawn = stored(drawn.join(shared, ["sketch", "fp"]), compression="zstd")
    weights = drawn.groupBy("node").agg(F.sum("n").alias("weight"))
    heads = drawn.join(weights, "node").groupBy("sketch", "fp").agg(F.max(F.struct("weight", "node"))["node"].alias("head"))
    met = drawn.join(heads, ["sketch", "fp"]).where("node <> head").groupBy("node", "head").agg(F.count("*").alias("shared"))
    sketched = met.groupBy("node").agg(F.max(F.struct("shared", "head"))["head"].alias("a")).select("a", F.col("node").alias("b"))
    pairs = stored(fingerprint_pairs(docs).union(sketched).distinct(), compression="zstd")
    linked = stored(_verified(docs, pairs, size, similarity), compression="zstd")

    roots = stored(connected_components(linked), compression="zstd")
    first = stored(_shared(prefixes(docs, size, similarity)), compression="zstd")
    rooted = first.join(roots, "node", "left").select("shingle", "node", "packed", F.coalesce("root", "node").alias("root"))
    first = stored(_several(rooted, "shingle", "root").select(
        "shingle", "node", "root", F.shiftright("packed", 32).alias("n"), F.shiftright(F.col("packed").bitwiseAND(0xFFFFFFFF), 1).alias("place"), (F.col("packed").bitwiseAND(1) == 1).alias("small")), compression="zstd")
    sets = every.where(F.col("n").isNotNull()).select("node", "n", "parity", *PARITY_WORDS)
    sets = stored(sets.join(first.select("node").distinct(), "node", "left_semi").dropDuplicates(["node"]), compression="zstd")
    first = first.join(sets.select("node", *PARITY_WORDS), "node")
    met = _meeting(first, similarity).distinct()
    rest = stored(_possible(met, sets, similarity), compression="zstd")
    return linked.union(_verified(docs, rest, size, similarity))


def keep_one_of_each(docs: DataFrame, words: int = 5, similarity: float = 0.8) -> DataFrame:
    """``docs`` without the near-duplicates of a document with a smaller doc_id.

    Near-duplicates are texts whose ``words``-word shingle sets reach ``similarity``; groups
    are the components of their links. The fingerprints' links name pairs first, and every pair
    is verified: a line repeated often decides the fingerprint of otherwise different texts. Of each group the row with the smallest
    doc_id stays (a row without one only if all lack it), of equal rows one. Texts without
    words are one group.
    """
    keyed = stored(docs.select(F.col("doc_id").cast("long"), row_key().alias("row"), F.when(_blank(), F.lit(0).cast("long")).otherwise(F.xxhash64("text")).alias("node")), compression="zstd")
    roots = connected_components(similar_links(docs, words, similarity))
    grouped = keyed.join(roots, "node", "left").withColumn("group", F.coalesce("root", "node"))
    first = F.min(F.struct(F.coalesce("doc_id", F.lit((1 << 63) - 1)), "row"))  # smallest doc_id, null last
    kept = grouped.groupBy("group").agg(first["row"].alias("_row")).select("_row")
    copies = keyed.groupBy(F.col("row").alias("_row")).agg((F.count("*") > 1).alias("_copies"))
    keep = stored(kept.join(copies, "_row"), compression="zstd")
    rows = docs.withColumn("_row", row_key())
    single = rows.join(_named(keep.where("NOT _copies").select("_row")), "_row", "left_semi")
    # Equal rows share a key; only they are gathered by it.
    equal = rows.join(_named(keep.where("_copies").select("_row")), "_row", "left_semi").dropDuplicates(["_row"])
    return single.unionByName(equal).select(*docs.columns)
