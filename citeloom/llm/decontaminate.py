"""Benchmark decontamination on canonical templates.

Numbers, units and names become typed placeholders, other words their lower-case form
without punctuation. A capitalised word that starts a sentence may be a name or not, and a
copy may have lost its capitals, so a text has three readings: with such words as words,
as names, and with no names at all. Windows of five template tokens of documents
and benchmark items are joined on their hash. Windows that meet on one alignment must
fill the item's slots consistently, one value for one slot and the other way round;
windows that go against the most frequent filling do not count. An item whose windows
are covered to 80 % marks the document, also if its numbers and names were exchanged.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from citeloom.llm.common import stored

WINDOW = 5
COVERED = 0.8
#: Literal words that a window must hold to be evidence.
MIN_LITERALS = 2
#: Items of fewer words mark a document only if they are all of it.
SHORTEST = 3
#: Bits of the filter that a document's windows pass before the join. Its size is fixed, a full one only lets more rows through.
FILTER_BITS = 1 << 22
#: The number of the exact reading, after three of templates.
EXACT = 3
#: In place of the slot of a token that is none in any reading; -1 as a long.
NO_SLOT = (1 << 64) - 1
CACHED_CHUNKS = 150_000
SLICE_CHARS = 2 << 20

UNITS = frozenset(
    "% mm cm m km in inch inches ft foot feet yd yard yards mi mile miles mg g kg t lb lbs pound pounds oz ounce ounces ml cl l liter liters litre litres gallon gallons "
    "ms s sec second seconds min minute minutes h hr hour hours day days week weeks month months year years hz khz mhz ghz b kb mb gb tb w kw mw v kv a ma j kj cal kcal pa kpa bar "
    "c f k °c °f degree degrees percent dollar dollars euro euros cent cents usd eur gbp mph kmh km/h m/s".split())
_NUMBER = re.compile(r"[-+]?[$€£¥]?\d[\d.,:/]*%?[$€£¥]?")
_JOINED = re.compile(r"([-+]?[$€£¥]?\d[\d.,]*)([A-Za-z°µ][A-Za-z/°]*)")
_EDGE = "!\"#&'()*,-./:;<=>?@[\\]^_`{|}~“”‘’„«»…–—¿¡+"
WORD, SKIP, NUMBER, UNIT_LIKE, CAPITAL = range(5)
_PLACE = {NUMBER: 0x9E3779B97F4A7C15, UNIT_LIKE: 0xC2B2AE3D27D4EB4F, CAPITAL: 0x165667B19E3779F9}
_FACTOR = np.uint64(0xD6E8FEB86659FD93)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * _FACTOR
    return x ^ (x >> np.uint64(29))


class TemplateReader:
    """Turns texts into template tokens; chunks keep their class in a bounded memory."""

    def __init__(self) -> None:
        self._reset()

    def _reset(self) -> None:
        self.code: dict[str, int] = {}
        self.pairs: list[tuple[int, int]] = []
        self.hash, self.kind, self.ends = [], [], []
        self.arrays = None

    def _single(self, core: str, kind: int, ends: bool) -> int:
        self.hash.append(xxhash.xxh64_intdigest(core.lower()))
        self.kind.append(kind)
        self.ends.append(ends)
        return len(self.hash) - 1

    def _learn(self, chunk: str) -> int:
        """Code of a chunk; a number with its unit attached is a pair of codes, written -1 - its place."""
        core = chunk.strip(_EDGE)
        ends = chunk.rstrip("\"'”»)]*")[-1:] in (".", "!", "?", ":")
        if not core:
            return self._single("", SKIP, ends)
        if _NUMBER.fullmatch(core):
            return self._single(core, NUMBER, ends)
        if joined := _JOINED.fullmatch(core):
            self.pairs.append((self._single(joined[1], NUMBER, False), self._single(joined[2], UNIT_LIKE if joined[2].lower() in UNITS else WORD, ends)))
            return -len(self.pairs)
        kind = UNIT_LIKE if core.lower() in UNITS else CAPITAL if core[0].isupper() else WORD
        return self._single(core, kind, ends)

    def read(self, texts: list[str]) -> dict[str, np.ndarray]:
        """Per token, over all texts: owner, place, word hash, kind as read (capitals that start a sentence stay apart)."""
        parts = [t.split() for t in texts]
        if len(self.code) > CACHED_CHUNKS:
            self._reset()
        for chunk in set().union(*parts).difference(self.code):
            self.code[chunk] = self._learn(chunk)
            self.arrays = None
        if self.arrays is None:
            self.arrays = np.array(self.hash, np.uint64), np.array(self.kind, np.int8), np.array(self.ends, bool)
        look = self.code.__getitem__
        codes = np.fromiter((c for part in parts for c in map(look, part)), np.int64, sum(map(len, parts)))
        owner = np.repeat(np.arange(len(texts)), np.fromiter(map(len, parts), np.int64, len(parts)))
        if (joined := np.flatnonzero(codes < 0)).size:
            first, second = (np.array([self.pairs[-1 - c][i] for c in codes[joined].tolist()], np.int64) for i in (0, 1))
            codes[joined] = first
            codes, owner = np.insert(codes, joined + 1, second), np.insert(owner, joined + 1, owner[joined])
        if not len(codes):
            return {"owner": owner, "place": owner, "hash": np.empty(0, np.uint64), "kind": np.empty(0, np.int8), "start": np.empty(0, bool)}
        hashes, kind, ends = (a[codes] for a in self.arrays)
        start = np.concatenate([[True], ends[:-1] | (owner[1:] != owner[:-1])])
        # A mark alone passes its end of sentence on to the next token.
        keep = kind != SKIP
        if not keep.all():
            lone = np.flatnonzero(~keep)
            for i in lone.tolist():
                if i + 1 < len(start) and start[i]:
                    start[i + 1] = True
            owner, hashes, kind, start = owner[keep], hashes[keep], kind[keep], start[keep]
        after_number = np.concatenate([[False], (kind[:-1] == NUMBER) & (owner[1:] == owner[:-1])]) if len(kind) else np.zeros(0, bool)
        kind = np.where((kind == UNIT_LIKE) & ~after_number, WORD, kind)
        counts = np.bincount(owner, minlength=len(texts))
        place = np.arange(len(owner)) - np.repeat(np.cumsum(counts) - counts, counts)
        return {"owner": owner, "place": place, "hash": hashes, "kind": kind, "start": start}


def _readings(t: dict[str, np.ndarray]) -> list[tuple[np.ndarray, np.ndarray]]:
    """(token hashes, is a slot) with capitals that start a sentence read as words, as names, and with no names at all."""
    out, capital = [], t["kind"] == CAPITAL
    for words in (capital & t["start"], np.zeros(len(capital), bool), capital):
        kind = np.where(words, WORD, t["kind"])
        tokens = t["hash"].copy()
        for k, place in _PLACE.items():
            tokens[kind == k] = place
        out.append((tokens, kind != WORD))
    return out


def _rolled(tokens: np.ndarray, at: np.ndarray, n: int, seed: int) -> np.ndarray:
    """Hashes of the windows of ``n`` tokens that start at ``at``."""
    hashes = np.full(len(at), seed, np.uint64)
    for j in range(n):
        hashes = _mix(hashes * np.uint64(31) + tokens[at + j])
    return hashes


def _windows(t: dict[str, np.ndarray], n_texts: int, size: int, lengths: tuple[int, ...] = ()) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """For each reading: first token, length and hash of every window with evidence.

    Windows have ``size`` tokens. A shorter text is one window, and ``lengths`` below ``size`` are read everywhere. Later readings leave out
    the windows that are the same in the first. A last, exact one takes numbers and units as they are, for windows
    that have too few other words even with names as words.
    """
    counts = np.bincount(t["owner"], minlength=n_texts)
    first = np.cumsum(counts) - counts
    room = np.repeat(counts, counts) - t["place"]
    cases = [(np.flatnonzero(room >= n) if n == size or n in lengths else first[counts == n], n) for n in range(1, size + 1)]
    least = lambda n: MIN_LITERALS if n == size else 1
    readings = _readings(t)
    out = []
    for k, (tokens, slot) in enumerate(readings):
        starts, sizes, values = [], [], []
        for at, n in cases:
            literals, differs = np.zeros(len(at), np.int64), np.full(len(at), k == 0)
            for j in range(n):
                literals += ~slot[at + j]
                differs |= tokens[at + j] != readings[0][0][at + j]
            good = at[(literals >= least(n)) & differs]
            starts.append(good)
            sizes.append(np.full(len(good), n))
            values.append(_rolled(tokens, good, n, 0 if n == size else n))
        out.append((np.concatenate(starts), np.concatenate(sizes), np.concatenate(values)))
    starts, sizes, values = [], [], []
    for at, n in cases:
        bare = at[sum((~slot[at + j]).astype(np.int64) for j in range(n)) < least(n)]
        starts.append(bare)
        sizes.append(np.full(len(bare), n))
        values.append(_rolled(t["hash"], bare, n, size + n))
    out.append((np.concatenate(starts), np.concatenate(sizes), np.concatenate(values)))
    return out


def _tokens(values: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> pa.ListArray:
    """The values of the tokens of each window, in order."""
    if not len(starts):
        return pa.array([], pa.list_(pa.int64()))
    ends = np.cumsum(lengths)
    at = np.repeat(starts - (ends - lengths), lengths) + np.arange(ends[-1])
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], ends]).astype(np.int32)), pa.array(values[at].view(np.int64)))


def _slices(texts: list[str]) -> Iterator[tuple[int, int]]:
    low = 0
    while low < len(texts):
        high, size = low + 1, len(texts[low])
        while high < len(texts) and size + len(texts[high]) <= SLICE_CHARS:
            size += len(texts[high])
            high += 1
        yield low, high
        low = high


ITEM_SCHEMA = "item_id long, class long, reading int, item_place int, window long, item_slots array<long>"


def item_windows(benchmark: DataFrame, size: int = WINDOW) -> DataFrame:
    """Windows of benchmark items (item_id, text). ``class`` is equal for items of one template and one pattern of equal slots.

    Windows without evidence in their templates are in the exact reading. An item that has no other windows
    shares its class only with items of the same tokens.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = TemplateReader()
        for batch in batches:
            texts = [t or "" for t in batch.column("text").to_pylist()]
            for low, high in _slices(texts):
                t = reader.read(texts[low:high])
                counts = np.bincount(t["owner"], minlength=high - low)
                ends = np.cumsum(counts)
                (plain, _), (named, slot), _ = _readings(t)
                # A slot's value becomes the place of its first occurrence in the item, also where a reading takes it as a word.
                index = np.zeros(len(t["hash"]), np.uint64)
                classes = np.zeros(high - low, np.uint64)
                for i, (a, b) in enumerate(zip((ends - counts).tolist(), ends.tolist())):
                    seen: dict[int, int] = {}
                    index[a:b] = [seen.setdefault(v, len(seen)) if s else NO_SLOT for v, s in zip(t["hash"][a:b].tolist(), slot[a:b].tolist())]
                    classes[i] = xxhash.xxh64_intdigest(plain[a:b].tobytes() + named[a:b].tobytes() + index[a:b].tobytes())
                read = _windows(t, high - low, size)
                bare = np.ones(high - low, bool)
                for starts, _, _ in read[:-1]:
                    bare[t["owner"][starts]] = False
                for i in np.flatnonzero(bare).tolist():
                    classes[i] = xxhash.xxh64_intdigest(t["hash"][ends[i] - counts[i]:ends[i]].tobytes(), seed=EXACT)
                for reading, (starts, lengths, values) in enumerate(read):
                    owner = t["owner"][starts]
                    yield pa.RecordBatch.from_arrays([
                        pa.array(batch.column("item_id").slice(low, high - low).take(pa.array(owner))), pa.array(classes[owner].view(np.int64)), pa.array(np.full(len(owner), reading, np.int32)),
                        pa.array(t["place"][starts].astype(np.int32)), pa.array(values.view(np.int64)), _tokens(index, starts, lengths)],
                        names=["item_id", "class", "reading", "item_place", "window", "item_slots"])

    return benchmark.select(F.col("item_id").cast("long"), "text").mapInArrow(run, ITEM_SCHEMA)


def document_windows(docs: DataFrame, passing: np.ndarray, size: int = WINDOW, lengths: tuple[int, ...] = ()) -> DataFrame:
    """doc_id, reading, doc_place, window and doc_slots of the documents' windows whose hash may be an item's."""
    sent = docs.sparkSession.sparkContext.broadcast(np.packbits(passing))  # FILTER_BITS / 8 bytes

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader, passes = TemplateReader(), np.unpackbits(sent.value).astype(bool)
        for batch in batches:
            texts = [t or "" for t in batch.column("text").to_pylist()]
            for low, high in _slices(texts):
                t = reader.read(texts[low:high])
                for starts, sizes, values in _windows(t, high - low, size, lengths):
                    hit = passes[(values & np.uint64(FILTER_BITS - 1)).astype(np.int64)]
                    starts, sizes, values = starts[hit], sizes[hit], values[hit]
                    yield pa.RecordBatch.from_arrays([
                        pa.array(batch.column("doc_id").slice(low, high - low).take(pa.array(t["owner"][starts]))), pa.array(t["place"][starts].astype(np.int32)),
                        pa.array(values.view(np.int64)), _tokens(t["hash"], starts, sizes)], names=["doc_id", "doc_place", "window", "doc_slots"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, doc_place int, window long, doc_slots array<long>")


def item_templates(benchmark: DataFrame, size: int = WINDOW) -> DataFrame:
    """item_id and template_id, the smallest item_id of its template, which stands for it in ``find_contaminated``."""
    items = stored(item_windows(benchmark, size).select("item_id", "class").distinct())
    return items.join(items.groupBy("class").agg(F.min("item_id").alias("template_id")), "class").select("item_id", "template_id")


def _main_filling():
    """Of ``filled`` the pairs of slot and value, the most frequent in ``pairs`` first, whose slot and value are not taken."""
    counted = F.transform("filled", lambda p: F.struct((-F.size(F.filter("pairs", lambda x: x == p))).alias("n"), p.alias("p")))
    none = F.filter("filled", lambda p: F.lit(False))
    return F.aggregate(F.array_sort(counted), none, lambda kept, c: F.when(
        F.exists(kept, lambda k: (k["item_slots"] == c["p"]["item_slots"]) | (k["doc_slots"] == c["p"]["doc_slots"])), kept).otherwise(F.concat(kept, F.array(c["p"]))))


def find_contaminated(docs: DataFrame, benchmark: DataFrame, size: int = WINDOW, covered: float = COVERED) -> DataFrame:
    """doc_id, coverage, item_id and item_ids of every document that holds a benchmark item.

    ``coverage`` is the largest share of an item's windows that the document holds on
    consistent alignments, ``item_id`` the smallest such item, ``item_ids`` one (the
    smallest) of each template found; ``item_templates`` has the items of each. All windows of an item count; those without evidence
    in their templates (too few words outside slots) are sought as they are, with their numbers and units. An item of fewer
    words than a window is one window, sought in all documents, or, with fewer than SHORTEST words, as a whole document only. Null texts are empty; rows of one doc_id, and rows without one, count as one document each; an
    empty table on either side gives no rows.
    """
    items = stored(item_windows(benchmark, size))
    # One template stands for all items that share it.
    names = items.groupBy("class").agg(F.min("item_id").alias("item_id"), F.count_distinct("item_place").alias("n_windows"))
    windows = stored(items.select("class", "item_place", "window", "item_slots").distinct())
    bits = windows.select((F.col("window").bitwiseAND(FILTER_BITS - 1)).cast("int").alias("bit")).distinct().toArrow().column("bit")  # at most FILTER_BITS
    passing = np.zeros(FILTER_BITS, bool)
    passing[bits.to_numpy()] = True
    lengths = tuple(sorted(r["n"] for r in windows.select(F.size("item_slots").alias("n")).distinct().collect() if SHORTEST <= r["n"] < size))
    met = document_windows(docs, passing, size, lengths).join(windows, "window").where(F.size("doc_slots") == F.size("item_slots"))
    # One alignment of one item: at most one row per window of the item and reading.
    lines = met.groupBy("doc_id", "class", (F.col("doc_place") - F.col("item_place")).alias("shift")).agg(
        F.collect_set(F.struct("item_place", F.filter(F.arrays_zip("item_slots", "doc_slots"), lambda x: x["item_slots"] >= 0).alias("pairs"))).alias("rows"))
    lines = lines.withColumn("pairs", F.flatten("rows.pairs")).withColumn("filled", F.array_distinct("pairs"))
    one_to_one = (F.size("filled") == F.size(F.array_distinct(F.transform("filled", lambda x: x["item_slots"])))) & (F.size("filled") == F.size(F.array_distinct(F.transform("filled", lambda x: x["doc_slots"]))))
    # The list of one has the filling computed once.
    agreeing = F.transform(F.array(_main_filling()), lambda main: F.filter("rows", lambda r: F.size(F.array_except(r["pairs"], main)) == 0))[0]
    found = (lines.select("doc_id", "class", F.explode(F.when(one_to_one, F.col("rows")).otherwise(agreeing)["item_place"]).alias("place")).distinct()
             .groupBy("doc_id", "class").agg(F.count("*").alias("n")).join(names, "class").where(F.col("n") >= covered * F.col("n_windows")))
    return found.groupBy("doc_id").agg(F.max(F.col("n") / F.col("n_windows")).alias("coverage"), F.min("item_id").alias("item_id"), F.array_sort(F.collect_set("item_id")).alias("item_ids"))


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, size: int = WINDOW, covered: float = COVERED) -> DataFrame:
    """``docs`` without the documents that hold a benchmark item."""
    found = stored(find_contaminated(docs, benchmark, size, covered).select(F.col("doc_id").alias("found_id")))
    return docs.join(found, F.col("doc_id").eqNullSafe(F.col("found_id")), "left_anti")
