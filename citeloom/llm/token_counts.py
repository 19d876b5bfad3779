"""Token counts by rank-synchronous merging of ragged arrays.

The distinct pre-tokens of a batch lie one after the other in numpy arrays of symbols.
In every round each sequence finds its lowest-ranked pair and merges all places of that
pair at once; sequences without a mergeable pair leave, and their surviving symbols are
their token count. The documents' counts are sums over their pre-tokens. Nothing is
shuffled: a document is counted where it is read.
"""

from __future__ import annotations

import heapq
import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame

#: Rank of a pair that no merge joins.
NONE = np.iinfo(np.int32).max
#: Distinct pre-tokens whose counts a worker keeps; beyond it the memory starts anew, results stay the same.
CACHED_PIECES = 300_000
#: Symbols merged together in one set of arrays, and of a sequence that is merged by itself.
ARRAY_SYMBOLS = 1 << 20
LONG_SEQUENCE = 4_096
#: Bytes of text held as Python objects at a time, one text at least.
SLICE_BYTES = 2 << 20
OVER_LIMIT = 1_024

# Fixed: how this kind of vocabulary cuts text before its merges.
PIECES = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


class MergeTable:
    """The merges of a byte-level vocabulary file as arrays.

    Only vocabularies are taken whose every merge makes a token of its own out of tokens
    known before; then a pair with a new token always ranks behind the merge that made it,
    and merging all places of the lowest pair together gives the library's result.
    """

    def __init__(self, vocabulary: str) -> None:
        with open(vocabulary, encoding="utf-8") as f:
            spec = json.load(f)
        model, cut = spec["model"], spec["pre_tokenizer"] or {}
        plain = not any(model.get(k) for k in ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback", "ignore_merges"))
        added = spec["added_tokens"]
        if (model["type"] != "BPE" or not plain or spec["normalizer"] or cut.get("type") != "ByteLevel" or cut.get("add_prefix_space")
                or not cut.get("use_regex", True) or any(t[k] for t in added for k in ("single_word", "lstrip", "rstrip", "normalized"))):
            raise ValueError(f"{vocabulary} is not a plain byte-level vocabulary")
        ids: dict[str, int] = model["vocab"]
        merges = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        self.width = max(ids.values()) + 1
        left, right = (np.array([ids[m[k]] for m in merges], np.int64) for k in (0, 1))
        self.made = np.array([ids[a + b] for a, b in merges], np.int32)
        self.left, self.right = left.astype(np.int32), right.astype(np.int32)
        at = np.full(self.width, -1, np.int64)
        at[self.made] = np.arange(len(merges))
        if len(set(self.made.tolist())) < len(merges) or (np.maximum(at[left], at[right]) >= np.arange(len(merges))).any():
            raise ValueError(f"{vocabulary} has merges whose order decides beyond their rank")
        keys = left * self.width + right
        order = np.argsort(keys)
        self.keys, self.rank_at = keys[order], order.astype(np.int32)
        self.byte = np.array([ids[c] for c in _byte_letters()], np.int32)
        self.first = self.rank(np.repeat(self.byte, 256), np.tile(self.byte, 256)).reshape(256, 256)
        self.specials = regex.compile("|".join(regex.escape(t["content"]) for t in sorted(added, key=lambda t: -len(t["content"])))) if added else None

    def rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        key = left.astype(np.int64) * self.width + right
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.rank_at[at], NONE).astype(np.int32)

    def count(self, pieces: list[bytes]) -> np.ndarray:
        """The number of symbols that are left of each piece."""
        out = np.zeros(len(pieces), np.int64)
        sizes = np.fromiter(map(len, pieces), np.int64, len(pieces))
        for i in np.flatnonzero(sizes > LONG_SEQUENCE).tolist():
            out[i] = self._count_long(np.frombuffer(pieces[i], np.uint8))
        rest = np.flatnonzero((sizes > 0) & (sizes <= LONG_SEQUENCE))
        for low, high in _cuts(sizes[rest]):
            block = rest[low:high]
            out[block] = self._count_block(np.frombuffer(b"".join([pieces[i] for i in block.tolist()]), np.uint8), sizes[block])
        return out

    def _count_block(self, raw: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        counts = np.zeros(len(sizes), np.int64)
        symbol, row = self.byte[raw], np.repeat(np.arange(len(sizes), dtype=np.int32), sizes)
        rank = np.full(len(raw), NONE, np.int32)
        rank[:-1] = np.where(row[:-1] == row[1:], self.first[raw[:-1], raw[1:]], NONE)
        while len(symbol):
            starts = np.flatnonzero(np.concatenate([[True], row[1:] != row[:-1]]))
            length = np.diff(np.append(starts, len(symbol)))
            lowest = np.minimum.reduceat(rank, starts)
            done = lowest == NONE
            counts[row[starts[done]]] = length[done]
            lowest_here = np.repeat(lowest, length)
            hit = np.flatnonzero((rank == lowest_here) & (rank != NONE))
            if not len(hit):
                break
            hit = _apart(hit)
            symbol[hit] = self.made[rank[hit]]
            keep = lowest_here != NONE
            keep[hit + 1] = False
            place = np.cumsum(keep) - 1
            symbol, row, rank = symbol[keep], row[keep], rank[keep]
            changed = place[hit]
            before = changed[changed > 0] - 1
            changed = np.concatenate([changed, before])
            after = np.minimum(changed + 1, len(symbol) - 1)
            joined = (after > changed) & (row[changed] == row[after])
            rank[changed] = np.where(joined, self.rank(symbol[changed], symbol[after]), NONE)
        return counts

    def _count_long(self, raw: np.ndarray) -> int:
        """One sequence, rank after rank: each rank keeps the places of its pair, so a round costs its own merges only."""
        n = len(raw)
        symbol, alive = np.append(self.byte[raw], -1), np.ones(n + 1, bool)
        after, before = np.arange(1, n + 2), np.arange(-1, n)
        places: dict[int, list[np.ndarray]] = {}
        heap: list[int] = []

        def note(at: np.ndarray) -> None:
            ranks = self.rank(symbol[at], symbol[after[at]])
            order = np.argsort(ranks, kind="stable")
            ranks, at = ranks[order], at[order]
            for part, rank in zip(np.split(at, np.flatnonzero(np.diff(ranks)) + 1), np.unique(ranks).tolist()):
                if rank != NONE:
                    if rank not in places:
                        places[rank] = []
                        heapq.heappush(heap, rank)
                    places[rank].append(part)

        note(np.arange(n - 1))
        left = n
        while heap:
            rank = heapq.heappop(heap)
            at = np.unique(np.concatenate(places.pop(rank)))
            at = at[alive[at] & (symbol[at] == self.left[rank])]
            at = at[(symbol[after[at]] == self.right[rank]) & (after[at] < n)]
            if not len(at):
                continue
            if self.left[rank] == self.right[rank]:  # runs of one symbol: every second place
                chained = np.concatenate([[False], after[at[:-1]] == at[1:]])
                first = np.maximum.accumulate(np.where(chained, 0, np.arange(len(at))))
                at = at[(np.arange(len(at)) - first) % 2 == 0]
            gone = after[at]
            symbol[at], alive[gone] = self.made[rank], False
            after[at] = after[gone]
            before[after[at]] = at
            left -= len(at)
            pairs = np.concatenate([at, before[at]])
            pairs = np.unique(pairs[pairs >= 0])
            note(pairs[alive[pairs] & (after[pairs] < n)])
        return left


def _byte_letters() -> list[str]:
    """The letter that stands for each byte in a byte-level vocabulary: printable bytes are themselves, the others follow from U+0100."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = iter(range(0x100, 0x200))
    return [chr(b) if b in shown else chr(next(others)) for b in range(256)]


def _apart(hit: np.ndarray) -> np.ndarray:
    """Of places next to each other every second one, from the left: overlapping pairs of one symbol."""
    chained = np.concatenate([[False], np.diff(hit) == 1])
    if not chained.any():
        return hit
    first = np.maximum.accumulate(np.where(chained, 0, np.arange(len(hit))))
    return hit[(np.arange(len(hit)) - first) % 2 == 0]


def _cuts(sizes: np.ndarray) -> Iterator[tuple[int, int]]:
    """Bounds of blocks of at most ARRAY_SYMBOLS symbols."""
    block = np.cumsum(sizes) // ARRAY_SYMBOLS
    edges = [0, *(np.flatnonzero(np.diff(block)) + 1).tolist(), len(sizes)]
    return ((a, b) for a, b in zip(edges, edges[1:]) if b > a)


def class_corrections(vocabulary: str) -> dict[int, str]:
    """Code points that the library puts into another class than the ``regex`` module, whose Unicode version differs, each with a stand-in of its class.

    All letters form one piece, and so do all digits, spaces and other signs; where the library cuts such a string, the classes part.
    """
    from tokenizers import Tokenizer

    cut = Tokenizer.from_file(vocabulary).pre_tokenizer.pre_tokenize_str
    every = "".join(map(chr, [*range(0x80, 0xD800), *range(0xE000, 0x110000)]))

    def stand_in(c: str) -> str:
        ends = [{b for _, (_, b) in cut(f"\x00{c}{after}")} for after in "a1"]
        if 2 not in ends[0]:
            return "a"
        return "1" if 2 not in ends[1] else "\u2003" if 1 in ends[0] else "\u2020"

    out = {}
    for one, own in ((r"\p{L}", "a"), (r"\p{N}", "1"), (r"\s", "\u2003"), (r"[^\s\p{L}\p{N}]", "\u2020")):
        row = "".join(regex.findall(f"(?:{one})+", every))
        for _, (a, b) in cut(row):
            if (found := stand_in(row[a])) != own:
                out.update((ord(c), found) for c in row[a:b])
    return out


class TokenCounter:
    """Counts the tokens of texts and keeps the counts of the pre-tokens seen."""

    def __init__(self, vocabulary: str, cached_pieces: int = CACHED_PIECES) -> None:
        self.table = MergeTable(vocabulary)
        self.cached_pieces = cached_pieces
        self.pieces = regex.compile(PIECES)
        self.stand_ins = class_corrections(vocabulary)
        self.odd = frozenset(map(chr, self.stand_ins))
        self.known: dict[str, int] = {}

    def cut(self, text: str) -> list[str]:
        """The pre-tokens of a text without special tokens."""
        if text.isascii() or self.odd.isdisjoint(text):
            return self.pieces.findall(text)
        return [text[m.start():m.end()] for m in self.pieces.finditer(text.translate(self.stand_ins))]

    def count(self, texts: list[str]) -> list[int]:
        parts, extra = [], []
        for text in texts:
            specials = self.table.specials.findall(text) if self.table.specials else []
            extra.append(len(specials))
            parts.append([p for s in self.table.specials.split(text) for p in self.cut(s)] if specials else self.cut(text))
        if len(self.known) > self.cached_pieces:
            self.known = {}
        new = list(set().union(*parts).difference(self.known))
        if new:
            self.known.update(zip(new, self.table.count([p.encode() for p in new]).tolist()))
        known = self.known.__getitem__
        return [sum(map(known, part)) + n for part, n in zip(parts, extra)]


_COUNTERS: dict[tuple[str, int], TokenCounter] = {}


def counter_for(vocabulary: str, cached_pieces: int) -> TokenCounter:
    """The counter of this Python worker; it serves one task after the other."""
    key = (vocabulary, cached_pieces)
    if key not in _COUNTERS:
        _COUNTERS[key] = TokenCounter(vocabulary, cached_pieces)
    return _COUNTERS[key]


def count_tokens(docs: DataFrame, vocabulary: str, limit: int = OVER_LIMIT, cached_pieces: int = CACHED_PIECES) -> DataFrame:
    """doc_id, n_bytes, n_tokens and over_limit (more than ``limit`` tokens) of every row of ``docs`` (doc_id, text).

    Special tokens written out in a text count as one token each, as the library reads them; none are added.
    Null and empty texts have no tokens. Rows of equal or null doc_id are counted one by one, other columns
    are ignored, a table without rows gives none. A text of any length is counted whole.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = counter_for(vocabulary, cached_pieces)
        for batch in batches:
            column = batch.column("text")
            sizes = pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64)
            counts: list[int] = []
            low = 0
            while low < len(sizes):
                high = max(low + 1, low + int(np.searchsorted(np.cumsum(sizes[low:]), SLICE_BYTES, "right")))
                counts += counter.count([t or "" for t in column.slice(low, high - low).to_pylist()])
                low = high
            n = np.array(counts, np.int64)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(sizes), pa.array(n), pa.array(n > limit)],
                                             names=["doc_id", "n_bytes", "n_tokens", "over_limit"])

    rows = docs.select(docs["doc_id"].cast("long"), "text")
    return rows.mapInArrow(run, "doc_id long, n_bytes long, n_tokens long, over_limit boolean")
