"""Quality classifier: a factorisation machine over hashed words and structure statistics.

score = sigmoid(b + sum_i w_i x_i + 1/2 sum_f [(sum_i v_if x_i)^2 - sum_i v_if^2 x_i^2]),
so all pairwise interactions cost one pass over a document's features. Features are the
hashed lower-case words (length-normalised log counts) and one-hot bins of statistics of
the text and its size. Language, source, id and labels are never inputs.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

WORD_BUCKETS = 1 << 12
#: Labelled rows the model is fitted on at most: those with the smallest hash of their id.
TRAINING_ROWS = 6_000
CACHED_WORDS = 150_000
SLICE_BYTES = 2 << 20

#: Upper bin edges of each statistic.
STATISTICS: dict[str, tuple[float, ...]] = {
    "words": (1, 3, 10, 30, 100, 300, 1000, 5000),
    "mean_word_bytes": (2, 3.5, 4.5, 5.5, 6.5, 8, 12, 30),
    "distinct_words": (0.02, 0.05, 0.1, 0.2, 0.35, 0.5, 0.7, 0.9),
    "repeated_next_word": (0.001, 0.01, 0.05, 0.1, 0.3, 0.6, 0.9),
    "repeated_lines": (0.001, 0.05, 0.1, 0.2, 0.4, 0.6, 0.8),
    "upper_letters": (0.005, 0.02, 0.05, 0.1, 0.2, 0.5, 0.8),
    "digits": (0.001, 0.005, 0.02, 0.05, 0.1, 0.3),
    "symbols": (0.0005, 0.002, 0.005, 0.01, 0.03, 0.1, 0.3),
    "exclamations": (0.0005, 0.002, 0.005, 0.01, 0.03, 0.1, 0.3),
    "bars": (0.0005, 0.002, 0.005, 0.01, 0.03, 0.1, 0.3),
    "non_ascii": (0.005, 0.02, 0.05, 0.1, 0.3, 0.6),
    "words_per_line": (2, 5, 10, 20, 50, 100, 500),
}
STEP = 1 + max(map(len, STATISTICS.values()))
N_FEATURES = WORD_BUCKETS + STEP * len(STATISTICS)

_CLASS = np.zeros((256, 6))  # byte histogram -> letters in upper case, digits, symbols, !, |, lead and tail bytes above ASCII
_CLASS[65:91, 0] = 1
_CLASS[48:58, 1] = 1
for _symbol in b"#*$%&|<>":
    _CLASS[_symbol, 2] = 1
_CLASS[33, 3] = _CLASS[124, 4] = 1
_CLASS[128:, 5] = 1


class FeatureMaker:
    """Turns UTF-8 texts into sparse rows; words keep their bucket in a bounded memory."""

    def __init__(self) -> None:
        self.bucket: dict[bytes, int] = {}

    def rows(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Row number, feature and value of every non-zero feature, in row order."""
        n = len(texts)
        stats = np.zeros((n, len(STATISTICS)))
        parts = []
        for i, text in enumerate(texts):
            words = text.lower().split()
            parts.append(words)
            lines = [x for x in text.split(b"\n") if x.strip()]
            share = np.bincount(np.frombuffer(text, np.uint8), minlength=256) @ _CLASS / max(1, len(text))
            count = len(words)
            stats[i] = (count, sum(map(len, words)) / max(1, count), len(set(words)) / max(1, count), 0,
                        1 - len(set(lines)) / len(lines) if lines else 0, *share, count / max(1, len(lines)))
        flat = [w for words in parts for w in words]
        if len(self.bucket) > CACHED_WORDS:
            self.bucket = {}
        for w in set(flat).difference(self.bucket):
            self.bucket[w] = zlib.crc32(w) % WORD_BUCKETS
        codes = np.fromiter(map(self.bucket.__getitem__, flat), np.int64, len(flat))
        sizes = np.fromiter(map(len, parts), np.int64, n)
        owner = np.repeat(np.arange(n), sizes)
        same = np.concatenate([(codes[1:] == codes[:-1]) & (owner[1:] == owner[:-1]), [False]]) if len(codes) else np.zeros(0, bool)
        stats[:, 3] = np.bincount(owner[same], minlength=n) / np.maximum(1, sizes)
        pair, counts = np.unique(owner * WORD_BUCKETS + codes, return_counts=True)
        row, value = pair // WORD_BUCKETS, np.log1p(counts)
        norm = np.sqrt(np.bincount(row, value**2, minlength=n))
        value = value / np.maximum(norm[row], 1e-9)
        bins = np.stack([np.searchsorted(edges, stats[:, j], "right") + WORD_BUCKETS + j * STEP for j, edges in enumerate(STATISTICS.values())], axis=1)
        rows = np.concatenate([row, np.repeat(np.arange(n), bins.shape[1])])
        order = np.argsort(rows, kind="stable")
        features = np.concatenate([pair % WORD_BUCKETS, bins.ravel()])
        values = np.concatenate([value, np.full(bins.size, 0.5)])
        return rows[order], features[order], values[order]


@dataclass
class FactorisationMachine:
    bias: float
    weights: np.ndarray  # (features,)
    factors: np.ndarray  # (features, rank)

    def margins(self, rows: np.ndarray, features: np.ndarray, values: np.ndarray, n: int) -> np.ndarray:
        """Each row has a feature at least, in row order."""
        starts = np.searchsorted(rows, np.arange(n))
        linear = np.add.reduceat(self.weights[features] * values, starts)
        parts = self.factors[features] * values[:, None]
        pairs = (np.add.reduceat(parts, starts) ** 2 - np.add.reduceat(parts**2, starts)).sum(axis=1) / 2
        return self.bias + linear + pairs

    @classmethod
    def fit(cls, rows: np.ndarray, features: np.ndarray, values: np.ndarray, target: np.ndarray, rank: int = 6, epochs: int = 12,
            batch: int = 64, rate: float = 0.05, penalty: float = 1e-4, seed: int = 7) -> FactorisationMachine:
        """Adagrad on the logistic loss. One class only, or no row, gives a constant score."""
        rng, n = np.random.default_rng(seed), len(target)
        prior = (target.sum() + 0.5) / (n + 1)
        model = cls(float(np.log(prior / (1 - prior))), np.zeros(N_FEATURES), rng.normal(0, 0.02, (N_FEATURES, rank)))
        if n == 0 or target.min() == target.max():
            model.factors[:] = 0
            return model
        starts = np.searchsorted(rows, np.arange(n + 1))
        past_w, past_v = np.full(N_FEATURES, 1e-3), np.full((N_FEATURES, rank), 1e-3)
        for _ in range(epochs):
            order = rng.permutation(n)
            for low in range(0, n, batch):
                chosen = order[low:low + batch]
                size = starts[chosen + 1] - starts[chosen]
                ends = np.cumsum(size)
                where = np.repeat(starts[chosen] - (ends - size), size) + np.arange(ends[-1])
                row, f, x = np.repeat(np.arange(len(chosen)), size), features[where], values[where]
                margin = model.margins(row, f, x, len(chosen))
                slope = (1 / (1 + np.exp(-np.clip(margin, -30, 30))) - target[chosen]) / len(chosen)
                own = model.factors[f] * x[:, None]
                total = np.add.reduceat(own, ends - size)
                touched, at = np.unique(f, return_inverse=True)
                grad_w = np.bincount(at, slope[row] * x) + penalty * model.weights[touched]
                grad_v = np.zeros((len(touched), rank))
                np.add.at(grad_v, at, (slope[row] * x)[:, None] * (total[row] - own))
                grad_v += penalty * model.factors[touched]
                past_w[touched] += grad_w**2
                past_v[touched] += grad_v**2
                model.weights[touched] -= rate * grad_w / np.sqrt(past_w[touched])
                model.factors[touched] -= rate * grad_v / np.sqrt(past_v[touched])
                model.bias -= rate * slope.sum() * 0.1
        return model


def training_rows(docs: DataFrame, labels: DataFrame, limit: int = TRAINING_ROWS) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Features and targets of a bounded sample of labelled rows.

    Only ids whose crc32, written as text, is not divisible by 5 count; null labels and ids
    are left out, and of repeated labels of an id the lower holds.
    """
    usable = labels.where(F.col("doc_id").isNotNull() & F.col("quality").isNotNull() & (F.crc32(F.col("doc_id").cast("string")) % 5 != 0))
    sample = usable.groupBy("doc_id").agg(F.min("quality").alias("quality")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(limit)
    rows = docs.select("doc_id", "text").join(F.broadcast(sample), "doc_id")  # at most `limit` narrow rows

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        maker = FeatureMaker()
        for batch in batches:
            n = batch.num_rows
            row, features, values = maker.rows([t or b"" for t in batch.column("text").cast(pa.binary()).to_pylist()])
            offsets = pa.array(np.searchsorted(row, np.arange(n + 1)).astype(np.int32))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("quality").cast(pa.int32()), pa.ListArray.from_arrays(offsets, pa.array(features.astype(np.int32))),
                                              pa.ListArray.from_arrays(offsets, pa.array(values.astype(np.float32)))], names=["doc_id", "quality", "features", "values"])

    found = rows.mapInArrow(run, "doc_id long, quality int, features array<int>, values array<float>").toArrow().sort_by("doc_id").slice(0, limit).combine_chunks()
    if found.num_rows == 0:
        return np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0), np.empty(0)
    lists = found.column("features").chunk(0), found.column("values").chunk(0)
    sizes = np.diff(lists[0].offsets.to_numpy())
    return (np.repeat(np.arange(found.num_rows), sizes), lists[0].flatten().to_numpy().astype(np.int64),
            lists[1].flatten().to_numpy().astype(float), found.column("quality").to_numpy().astype(float))


def fit_quality(docs: DataFrame, labels: DataFrame, limit: int = TRAINING_ROWS) -> FactorisationMachine:
    """Fit on at most ``limit`` labelled documents (doc_id, text joined to doc_id, quality)."""
    return FactorisationMachine.fit(*training_rows(docs, labels, limit))


def score_quality(docs: DataFrame, model: FactorisationMachine) -> DataFrame:
    """All columns of ``docs`` and ``score``, the chance that a text is of good quality.

    Whole texts are scored in slices of bounded size. A null text is scored as an empty one.
    """
    name = "score" if "score" not in docs.columns else "fm_score"
    sent = docs.sparkSession.sparkContext.broadcast((model.bias, model.weights, model.factors))  # fixed size

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        maker, machine = FeatureMaker(), FactorisationMachine(*sent.value)
        for batch in batches:
            texts = [t or b"" for t in batch.column("text").cast(pa.binary()).to_pylist()]
            scores, low = [], 0
            while low < len(texts):
                high, size = low + 1, len(texts[low])
                while high < len(texts) and size + len(texts[high]) <= SLICE_BYTES:
                    size += len(texts[high])
                    high += 1
                margin = machine.margins(*maker.rows(texts[low:high]), high - low)
                scores.append(1 / (1 + np.exp(-np.clip(margin, -500, 500))))
                low = high
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.concatenate(scores))], names=[*batch.schema.names, name])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema) + f", `{name}` double"
    return docs.mapInArrow(run, schema)
