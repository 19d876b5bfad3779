"""Phrase collocation mining with burst tries.

Phrases are counted length by length. Each task counts windows of words in a shallow trie
over word ids: a hash container holds the windows of many first words, and when it grows
too large it bursts, which gives the first words with many windows containers of their
own. A full trie lets its largest containers go, whole subtrees at a time, as runs in
the order of their phrases. The runs of a prefix - the first word, the whole phrase for a frequent first
word - meet in one partition and are merged in order. Longer windows enter a trie only if
the shorter ones in them are frequent, which a bit filter of bounded size tells without misses.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, Window, functions as F

from citeloom.llm.common import stored, utf8_values

MIN_COUNT = 10
#: A phrase goes if a longer one holds it in at least this percentage of its occurrences.
COVERED_PERCENT = 50
TOP = 2_000
#: Windows a container takes between two counts, entries at which it bursts, and entries at which a trie lets containers go until half are left.
PENDING_WINDOWS = 1 << 19
BURST_ENTRIES = 1 << 19
TRIE_ENTRIES = 1_500_000
#: Words a trie numbers before it is emptied and numbers anew, and words of text that enter at once. Both together stay below 2^ID_BITS.
TRIE_WORDS = 600_000
BLOCK_WORDS = 500_000
ID_BITS = 21
#: Bytes of text held as Python objects at a time, one text at least.
SLICE_BYTES = 2 << 20
#: A first word with at least one in so many of all words has its phrases dealt out one by one. At most so many words are that frequent.
HOT_SHARE = 200
#: Bits for each frequent phrase in a filter, and of a filter at most; a full filter lets more windows in, results stay the same.
PHRASE_BITS = 16
FILTER_BITS = 1 << 28
RUN_ROWS = 1 << 16

#: Lower-cases A-Z and turns the signs that end a piece into full stops. What else ASCII counts as white space separates words.
_PLAIN = bytes(46 if b in b".,;:!?\n\x0b\x0c\r" else b + 32 if 65 <= b <= 90 else b for b in range(256))
_STOP = b"."

_RUNS = "lang string, phrase string, n long"
_ODD = np.uint64(0x9E3779B97F4A7C15)


class _Ids(dict):
    """Numbers words in order of arrival; 0 is the end of a piece."""

    def __init__(self) -> None:
        super().__init__({_STOP: 0})
        self.words: list[bytes] = [_STOP]

    def __missing__(self, word: bytes) -> int:
        self[word] = n = len(self.words)
        self.words.append(word)
        return n


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * _ODD
    return h ^ (h >> np.uint64(29))


class PhraseFilter:
    """A bit set that holds every frequent phrase of one length, and some others by chance."""

    def __init__(self, words: int, bits: np.ndarray) -> None:
        self.words, self.bits = words, bits
        self.mask = np.uint64(64 * len(bits) - 1)

    @staticmethod
    def hashes(lang: str, parts: list[np.ndarray]) -> np.ndarray:
        """Of phrases given by the hashes of their first, second ... words."""
        h = np.full(len(parts[0]), xxhash.xxh64_intdigest(lang.encode()), np.uint64)
        for part in parts:
            h = _mixed(h + part)
        return h

    def slots(self, h: np.ndarray) -> Iterator[np.ndarray]:
        yield h & self.mask
        yield (h >> np.uint64(32) | h << np.uint64(32)) & self.mask

    def holds(self, lang: str, parts: list[np.ndarray]) -> np.ndarray:
        held = np.ones(len(parts[0]), bool)
        for slot in self.slots(self.hashes(lang, parts)):
            held &= (self.bits[slot >> np.uint64(6)] >> (slot & np.uint64(63)) & np.uint64(1)).astype(bool)
        return held


def word_hashes(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words))


class _Container:
    """Windows as integers and their counts; what has arrived since the last count waits."""

    def __init__(self) -> None:
        self.keys, self.counts = np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.waiting: list[np.ndarray] = []
        self.n_waiting = 0

    def __len__(self) -> int:
        return len(self.keys) + self.n_waiting

    def add(self, keys: np.ndarray) -> None:
        self.waiting.append(keys)
        self.n_waiting += len(keys)

    def count(self) -> None:
        if self.n_waiting:
            found = pa.array(np.concatenate(self.waiting)).value_counts()
            self._merge(found.field("values").to_numpy(), found.field("counts").to_numpy())
            self.waiting, self.n_waiting = [], 0

    def _merge(self, keys: np.ndarray, counts: np.ndarray) -> None:
        if len(self.keys):
            both = pa.table({"k": np.concatenate([self.keys, keys]), "n": np.concatenate([self.counts, counts])}).group_by("k").aggregate([("n", "sum")])
            keys, counts = both.column("k").to_numpy(), both.column("n_sum").to_numpy()
        self.keys, self.counts = keys, counts

    def take(self, where: np.ndarray) -> _Container:
        out = _Container()
        out.keys, out.counts = self.keys[where], self.counts[where]
        self.keys, self.counts = self.keys[~where], self.counts[~where]
        return out


class BurstTrie:
    """Counts of windows of ``size`` words. ``containers[lang][0]`` is shared by all first words that have no container of their own."""

    def __init__(self, size: int, frequent: PhraseFilter | None = None) -> None:
        self.size, self.frequent, self.shift = size, frequent, ID_BITS * (size - 1)
        self._clear()

    def _clear(self) -> None:
        self.ids = _Ids()
        self.hashes = np.zeros(1, np.uint64)
        self.containers: dict[str, dict[int, _Container]] = {}

    def add(self, lang: str, texts: list[bytes]) -> Iterator[pa.RecordBatch]:
        """Count texts of one language; yields runs whenever the trie is full."""
        words = b"\n".join(texts).translate(_PLAIN).replace(b".", b" . ").split()
        for low in range(0, len(words), BLOCK_WORDS):
            block = words[low:low + BLOCK_WORDS + self.size - 1]  # windows start in the first BLOCK_WORDS
            ids = np.fromiter(map(self.ids.__getitem__, block), np.int64, len(block))
            keys = self._windows(lang, ids, min(BLOCK_WORDS, len(words) - low))
            if len(keys):
                self._place(self.containers.setdefault(lang, {0: _Container()}), keys)
            yield from self._relieve()

    def _windows(self, lang: str, ids: np.ndarray, starts: int) -> np.ndarray:
        n = max(0, min(starts, len(ids) - self.size + 1))
        parts = [ids[k:k + n] for k in range(self.size)]
        ok = np.logical_and.reduce([p > 0 for p in parts])
        if self.frequent:
            if len(self.ids.words) > len(self.hashes):
                self.hashes = np.concatenate([self.hashes, word_hashes(self.ids.words[len(self.hashes):])])
            h, k = self.hashes[ids], self.frequent.words
            held = self.frequent.holds(lang, [h[j:len(h) - k + 1 + j] for j in range(k)])
            for j in range(self.size - k + 1):
                ok &= held[j:j + n]
        keys = np.zeros(n, np.int64)
        for p in parts:
            keys = keys << ID_BITS | p
        return keys[ok]

    def _place(self, containers: dict[int, _Container], keys: np.ndarray) -> None:
        if len(containers) > 1:
            own = np.zeros(len(self.ids.words), bool)
            own[[first for first in containers if first]] = True
            mine = own[keys >> self.shift]
            if mine.any():
                single = keys[mine]
                single = single[np.argsort(single >> self.shift, kind="stable")]
                firsts = single >> self.shift
                for part, first in zip(np.split(single, np.flatnonzero(np.diff(firsts)) + 1), np.unique(firsts).tolist()):
                    containers[first].add(part)
                keys = keys[~mine]
        containers[0].add(keys)
        for container in list(containers.values()):
            if container.n_waiting >= PENDING_WINDOWS:
                container.count()
        if len(containers[0].keys) > BURST_ENTRIES:
            firsts, sizes = np.unique(containers[0].keys >> self.shift, return_counts=True)
            for first in firsts[sizes > BURST_ENTRIES // 32].tolist():
                containers[first] = containers[0].take(containers[0].keys >> self.shift == first)

    def _relieve(self) -> Iterator[pa.RecordBatch]:
        sizes = [(len(c), lang, first) for lang, containers in self.containers.items() for first, c in containers.items()]
        entries = sum(s[0] for s in sizes)
        if len(self.ids.words) > TRIE_WORDS:
            yield from self.spill()
        elif entries > TRIE_ENTRIES:
            for size, lang, first in sorted(sizes, reverse=True):
                if entries <= TRIE_ENTRIES // 2:
                    break
                entries -= size
                container = self.containers[lang][first]
                self.containers[lang][first] = _Container()
                yield from self._runs(lang, [container])

    def spill(self) -> Iterator[pa.RecordBatch]:
        """All that is left, as runs; the trie is empty afterwards."""
        for lang, containers in self.containers.items():
            yield from self._runs(lang, list(containers.values()))
        self._clear()

    def _runs(self, lang: str, containers: list[_Container]) -> Iterator[pa.RecordBatch]:
        for container in containers:
            container.count()
        keys, n = np.concatenate([c.keys for c in containers]), np.concatenate([c.counts for c in containers])
        if not len(keys):
            return
        low = (1 << ID_BITS) - 1
        at = [keys >> ID_BITS * k & low for k in reversed(range(self.size))]
        used = np.flatnonzero(np.bincount(np.concatenate(at)))
        used = np.array(sorted(used.tolist(), key=self.ids.words.__getitem__), np.int64)
        rank = np.zeros(len(self.ids.words), np.int64)
        rank[used] = np.arange(len(used))
        spelled = pa.array([self.ids.words[i] for i in used.tolist()], pa.binary())
        place = np.zeros(len(keys), np.int64)
        for k in at:
            place = place << ID_BITS | rank[k]
        order = np.argsort(place)
        for start in range(0, len(order), RUN_ROWS):
            rows = order[start:start + RUN_ROWS]
            parts = [spelled.take(pa.array(rank[k[rows]])) for k in at]
            phrase = parts[0] if self.size == 1 else pc.binary_join_element_wise(*parts, b" ")
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(rows), pa.string()), phrase.cast(pa.string()), pa.array(n[rows])], names=["lang", "phrase", "n"])


def _merge(batches: Iterator[pa.RecordBatch], min_count: int) -> Iterator[pa.RecordBatch]:
    """Sums of equal (lang, phrase) of a sorted stream that reach ``min_count``; the last sum of a batch waits for the next batch."""
    open_row: tuple[str, str, int] | None = None

    def out(lang, phrase, n) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([lang, phrase, pa.array(n, pa.int64())], names=["lang", "phrase", "n"])

    def closed() -> Iterator[pa.RecordBatch]:
        if open_row and open_row[2] >= min_count:
            yield out(pa.array([open_row[0]]), pa.array([open_row[1]]), [open_row[2]])

    for batch in batches:
        if not batch.num_rows:
            continue
        lang, phrase = batch.column("lang"), batch.column("phrase")
        new = pc.or_(pc.not_equal(phrase[1:], phrase[:-1]), pc.not_equal(lang[1:], lang[:-1])).to_numpy(zero_copy_only=False)
        starts = np.concatenate([[0], np.flatnonzero(new) + 1])
        sums = np.add.reduceat(batch.column("n").to_numpy(), starts)
        if open_row and open_row[:2] == (lang[0].as_py(), phrase[0].as_py()):
            sums[0] += open_row[2]
        else:
            yield from closed()
        last = int(starts[-1])
        open_row = (lang[last].as_py(), phrase[last].as_py(), int(sums[-1]))
        shown = np.flatnonzero(sums[:-1] >= min_count)
        at = pa.array(starts[shown])
        yield out(lang.take(at), phrase.take(at), sums[shown])
    yield from closed()


def _slices(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, list[bytes]]]:
    """The texts of each language, about SLICE_BYTES at a time."""
    for batch in batches:
        sizes = pc.fill_null(pc.binary_length(batch.column("text")), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        low = 0
        while low < len(sizes):
            high = max(low + 1, low + int(np.searchsorted(np.cumsum(sizes[low:]), SLICE_BYTES, "right")))
            part, texts = batch.slice(low, high - low), {}
            for lang, raw in zip(part.column("lang").to_pylist(), utf8_values(part.column("text"))):
                texts.setdefault(lang, []).append(raw)
            yield from texts.items()
            low = high


def phrase_runs(docs: DataFrame, size: int, frequent: PhraseFilter | None = None) -> DataFrame:
    """(lang, phrase, n): runs of the tries of all tasks. ``docs`` has lang and text, lang without nulls."""
    sent = docs.sparkSession.sparkContext.broadcast(frequent) if frequent else None  # at most FILTER_BITS

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trie = BurstTrie(size, sent.value if sent else None)
        for lang, texts in _slices(batches):
            yield from trie.add(lang, texts)
        yield from trie.spill()

    return docs.select("lang", "text").mapInArrow(count, _RUNS)


def merge_runs(runs: DataFrame, min_count: int, hot: list[str]) -> DataFrame:
    """(lang, phrase, n) of the phrases with at least ``min_count`` occurrences, merged per prefix partition."""
    first = F.substring_index("phrase", " ", 1)
    prefix = F.when(first.isin(hot), F.col("phrase")).otherwise(first) if hot else first
    return runs.repartition(F.col("lang"), prefix).sortWithinPartitions("lang", "phrase").mapInArrow(lambda batches: _merge(batches, min_count), _RUNS)


def phrase_filter(phrases: DataFrame, words: int, filter_bits: int = FILTER_BITS) -> PhraseFilter:
    """The filter of (lang, phrase) rows: at most ``filter_bits`` bits reach the driver, however many rows there are."""
    wanted = PHRASE_BITS * max(phrases.count(), 64)
    n_bits = min(1 << (wanted - 1).bit_length(), filter_bits)
    empty = PhraseFilter(words, np.zeros(n_bits // 64, np.uint64))
    mask = empty.mask

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            split = [raw.split(b" ") for raw in utf8_values(batch.column("phrase"))]
            langs = np.array(batch.column("lang").to_pylist(), dtype=object)
            parts = [word_hashes([p[k] for p in split]) for k in range(words)]
            for lang in set(langs.tolist()):
                own = np.flatnonzero(langs == lang)
                h = PhraseFilter.hashes(lang, [p[own] for p in parts])
                for slot in (h & mask, (h >> np.uint64(32) | h << np.uint64(32)) & mask):
                    yield pa.RecordBatch.from_arrays([pa.array((slot >> np.uint64(6)).astype(np.int64)), pa.array((np.uint64(1) << (slot & np.uint64(63))).view(np.int64))], names=["place", "bits"])

    rows = phrases.select("lang", "phrase").mapInArrow(run, "place long, bits long").groupBy("place").agg(F.bit_or("bits").alias("bits")).toArrow()
    empty.bits[rows.column("place").to_numpy()] = rows.column("bits").to_numpy().view(np.uint64)
    return empty


def _cut(k: int, size: int):
    words = F.split("phrase", " ")
    side = lambda start, n: F.array_join(F.slice(words, start, n), " ")
    return F.struct(F.lit(k).cast("long").alias("k"), side(1, k).alias("left"), side(k + 1, size - k).alias("right"))


def phrase_counts(docs: DataFrame, min_count: int = MIN_COUNT, hot_share: int = HOT_SHARE) -> tuple[DataFrame, DataFrame]:
    """(lang, words, phrase, f) of all phrases of one to three words with at least ``min_count`` occurrences, and (lang, n) with all words."""
    rows = docs.select(F.coalesce("lang", F.lit("und")).alias("lang"), "text")
    words = stored(merge_runs(phrase_runs(rows, 1), 1, []), compression="zstd")
    totals = stored(words.groupBy("lang").agg(F.sum("n").alias("n")))
    total = totals.agg(F.sum("n")).first()[0] or 0
    hot = [r["phrase"] for r in words.groupBy("phrase").agg(F.sum("n").alias("n")).where(F.col("n") * hot_share >= total).select("phrase").collect()]  # at most hot_share
    found = words.where(F.col("n") >= min_count)
    levels = [found]
    for size in (2, 3):
        runs = phrase_runs(rows, size, phrase_filter(levels[-1], size - 1))
        levels.append(stored(merge_runs(runs, min_count, hot), compression="zstd"))
    counts = None
    for size, level in enumerate(levels, 1):
        part = level.select("lang", F.lit(size).alias("words"), "phrase", F.col("n").alias("f"))
        counts = part if counts is None else counts.unionByName(part)
    return counts, totals


def mine_collocations(docs: DataFrame, min_count: int = MIN_COUNT, covered_percent: int = COVERED_PERCENT, top: int = TOP) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: each language's ``top`` phrases of two and three words.

    Reads ``docs`` (lang, text; other columns are ignored). A-Z are lower-cased, pieces end at ``.,;:!?`` and line ends, words
    are separated by blanks and tabs. A phrase found ``a`` >= ``min_count`` times scores floor(1000000 a a / (l r)) at its
    lowest-scoring cut, the smallest one of equal cuts, in exact decimals. It goes if a longer counted phrase holds it in at least
    ``covered_percent`` percent of its occurrences. Order: score and ``a`` descending, phrase ascending by UTF-8 bytes.
    Null and empty texts have no words, a null language is ``und``, repeated rows count as often as they stand there, a table
    without rows or without frequent phrases gives no rows. Texts of any length are counted whole.
    """
    counts, totals = phrase_counts(docs, min_count)
    phrases = counts.where("words > 1").withColumn(
        "cut", F.explode(F.when(F.col("words") == 2, F.array(_cut(1, 2))).otherwise(F.array(_cut(1, 3), _cut(2, 3)))))
    part = lambda side, name: counts.select("lang", F.col("phrase").alias(side), F.col("f").alias(name))
    cut = phrases.select("lang", "phrase", "words", F.col("f").alias("a"), "cut.*").join(part("left", "l"), ["lang", "left"]).join(part("right", "r"), ["lang", "right"])
    value = F.expr("(cast(1000000 as decimal(7,0)) * cast(a as decimal(15,0)) * cast(a as decimal(15,0))) div (cast(l as decimal(15,0)) * cast(r as decimal(15,0)))")
    scored = cut.groupBy("lang", "phrase", "words", "a").agg(F.min(F.struct(value.alias("score"), "k", "l", "r")).alias("x"))
    longer = counts.where("words = 3").select("lang", "f", F.explode(F.array(F.substring_index("phrase", " ", 2), F.substring_index("phrase", " ", -2))).alias("phrase"))
    held = longer.groupBy("lang", "phrase").agg(F.max("f").alias("longest"))
    kept = scored.join(held, ["lang", "phrase"], "left").where(F.col("longest").isNull() | (F.col("words") == 3) | (100 * F.col("longest") < covered_percent * F.col("a")))
    order = Window.partitionBy("lang").orderBy(F.desc("x.score"), F.desc("a"), "phrase")
    ranked = kept.withColumn("rank", F.row_number().over(order).cast("long")).where(F.col("rank") <= top)
    return ranked.join(F.broadcast(totals), "lang").select("lang", "rank", "phrase", "a", "x.l", "x.r", "n", "x.score")
