"""Vectors: hash and tf-idf encoders, cosine, exact neighbour search."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from citeloom.functions import scoring as S, text as X
from citeloom.session import cut_lineage, dealt

from .ranking import top_per_group

#: Bytes of query vectors that go to the tasks at a time.
BLOCK_BYTES = 64 << 20
BLOCK_ROWS = 2048
#: Packs of vectors that larger tables are cut into, as far as PACK_BLOCKS blocks hold them.
PACKS = 32
PACK_BLOCKS = 16
#: Vectors on a side of one product, and pairs whose exact cosine is taken at a time.
TILE = 512
HITS = 1 << 16
NORM_FLOOR = 1e-9
#: Names or lines of code whose vectors are made in one task.
CODE_ROWS = 50_000
#: Texts whose words are counted in one task.
TEXT_ROWS = 4_000


# Column forms ---------------------------------------------------------------

def _dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two array columns; 0 for empty, unequal or near-zero vectors."""
    norms = F.sqrt(_dot(a, a)) * F.sqrt(_dot(b, b))
    return F.when((F.size(a) != F.size(b)) | (F.size(a) == 0) | (norms < NORM_FLOOR), 0.0).otherwise(F.try_divide(_dot(a, b), norms))


# Encoders in long form (key, idx, value) --------------------------------------

def _unit(weights: DataFrame, key: str) -> DataFrame:
    """L2-normalise long-form vectors; a window holds the entries of one vector."""
    norm = F.sqrt(F.sum(F.col("w") * F.col("w")).over(Window.partitionBy(key)))
    value = F.when(F.col("norm") > NORM_FLOOR, F.col("w") / F.col("norm")).otherwise(F.col("w"))
    return weights.withColumn("norm", norm).select(key, "idx", value.alias("value")).filter("value <> 0")


def dense(vectors: DataFrame, key: str, dim: int) -> DataFrame:
    """Long-form vectors as ``array<double>`` of a fixed dimension."""
    m = vectors.groupBy(key).agg(F.map_from_entries(F.collect_list(F.struct("idx", "value"))).alias("m"))
    return m.select(key, F.transform(F.sequence(F.lit(0), F.lit(dim - 1)), lambda i: F.coalesce(F.col("m")[i], F.lit(0.0))).alias("embedding"))


def _hex(text: Column) -> Column:
    return F.conv(text, 16, 10).cast("bigint")


def sha_bucket(token: Column, dim: int, part: int = 0) -> Column:
    """Bucket of a token from the ``part``-th 8 hex digits of its sha256."""
    return (_hex(F.substring(F.sha2(token, 256), part * 8 + 1, 8)) % dim).cast("int")


def hash_embed_sha(counts: DataFrame, key: str, dim: int = 768) -> DataFrame:
    """Bag-of-words hashing over ``(key, term, n)``: each distinct term is hashed once per text."""
    return _unit(counts.groupBy(key, sha_bucket(F.col("term"), dim).alias("idx")).agg(F.sum("n").cast("double").alias("w")), key)


def hash_embed_signed(counts: DataFrame, key: str, dim: int = 512) -> DataFrame:
    """Signed hashing; bucket and sign come from the low bits of md5 (dim a power of two up to 2048)."""
    low = _hex(F.right(F.md5("term"), F.lit(4)))
    sign = F.when(F.floor(low / dim) % 2 == 0, 1.0).otherwise(-1.0)
    return _unit(counts.groupBy(key, (low % dim).cast("int").alias("idx")).agg(F.sum(sign * F.col("n")).alias("w")), key)


def hash_embed_code(df: DataFrame, key: str, tokens: Column, dim: int = 512) -> DataFrame:
    """Eight buckets per code token, earlier tokens weigh more."""
    rows = dealt(df, key, CODE_ROWS).select(key, F.size(tokens).alias("size"), F.posexplode(tokens).alias("pos", "token"))
    digest = rows.withColumn("h", F.sha2("token", 256))
    parts = digest.select(key, ((F.col("size") - F.col("pos")) / F.col("size")).alias("w"), F.explode(F.array(
        *[(_hex(F.substring("h", j * 8 + 1, 8)) % dim).cast("int") for j in range(8)])).alias("idx"))
    return _unit(parts.groupBy(key, "idx").agg(F.sum("w").alias("w")), key)


def hash_embed_text(df: DataFrame, key: str, text: Column, dim: int = 512) -> DataFrame:
    """Whole-text fingerprint: value i from sha256('i:text'), normalised, as an array."""
    raw = F.transform(F.sequence(F.lit(0), F.lit(dim - 1)), lambda i: _hex(
        F.substring(F.sha2(F.concat(i.cast("string"), F.lit(":"), text), 256), 1, 8)) / float(16**8))
    # Each explode of a one-element array keeps the value below it from being
    # copied into the expressions above.
    with_raw = df.select(key, F.explode(F.array(raw)).alias("raw"))
    norm = F.sqrt(F.aggregate("raw", F.lit(0.0), lambda s, x: s + x * x))
    return with_raw.select(key, "raw", F.explode(F.array(norm)).alias("norm")).select(
        key, F.transform("raw", lambda x: x / F.col("norm")).alias("embedding"))


def tfidf_embed(counts: DataFrame, key: str, n_docs: int, max_features: int = 2048) -> DataFrame:
    """tf/total x smoothed idf over the most frequent terms (df falling, then term), normalised."""
    df = counts.groupBy("term").agg(F.count("*").alias("df"))
    vocab = df.orderBy(F.desc("df"), "term").limit(max_features)
    ranked = cut_lineage(vocab.withColumn("idx", F.row_number().over(Window.orderBy(F.desc("df"), "term")) - 1).select(
        "term", "idx", (F.log(F.lit(1.0 + n_docs) / (F.col("df") + 1)) + 1.0).alias("idf")))
    total = F.sum("n").over(Window.partitionBy(key))
    # The vocabulary holds at most max_features rows.
    w = counts.withColumn("total", total).join(F.broadcast(ranked), "term")
    return _unit(w.select(key, "idx", (F.col("n") / F.col("total") * F.col("idf")).alias("w")), key)


def tfidf_embed_code(counts: DataFrame, key: str, idf: DataFrame, dim: int = 512) -> DataFrame:
    """Feature-hashed tf-idf with a stable hash in place of the interpreter's seeded one."""
    w = counts.join(idf.select("term", "idf"), "term", "left").select(
        key, F.pmod(F.xxhash64("term"), F.lit(dim)).cast("int").alias("idx"), (F.col("n") * F.coalesce("idf", F.lit(1.0))).alias("w"))
    return _unit(w.groupBy(key, "idx").agg(F.sum("w").alias("w")), key)


def _default_encoder() -> Callable[[list[str]], np.ndarray]:
    """Offline encoder: the sha256 bag of words."""
    import hashlib
    import re

    word = re.compile("[a-z0-9_]+")

    def encode(texts: list[str], dim: int = 768) -> np.ndarray:
        out = np.zeros((len(texts), dim))
        words = [word.findall((text or "").lower()) for text in texts]
        place = {w: int.from_bytes(hashlib.sha256(w.encode()).digest()[:4], "big") % dim for w in set().union(*words)}  # each word of the batch once
        rows = np.repeat(np.arange(len(texts)), [len(w) for w in words])
        np.add.at(out, (rows, np.fromiter((place[w] for row in words for w in row), np.int64, len(rows))), 1.0)
        norms = np.linalg.norm(out, axis=1, keepdims=True)
        return np.divide(out, norms, out=out, where=norms > NORM_FLOOR)

    return encode


ENCODED_ROWS = 512


def model_embed(text: Column, factory: Callable[[], Callable[[list[str]], np.ndarray]] = _default_encoder) -> Column:
    """Embed with a pluggable encoder that is built once per Python worker.

    An Arrow batch is encoded and handed on in parts of ENCODED_ROWS texts, so a worker never holds its vectors as a whole.
    """

    @F.pandas_udf("array<double>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        encode = factory()
        for batch in batches:
            for start in range(0, len(batch), ENCODED_ROWS):
                yield pd.Series(list(encode(batch.iloc[start:start + ENCODED_ROWS].tolist())))

    return run(text)


# Neighbour search -----------------------------------------------------------

def _matrix(column: pd.Series) -> np.ndarray:
    return _unit_rows(np.array(column.tolist(), dtype=np.float64))


def _unit_rows(m: np.ndarray) -> np.ndarray:
    norms = np.linalg.norm(m, axis=1, keepdims=True)
    return np.divide(m, norms, out=np.zeros_like(m), where=norms >= NORM_FLOOR)


def _query_blocks(queries: DataFrame, query_id: str, vector: str) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The query vectors in blocks of about BLOCK_BYTES, one at a time on the driver."""
    n, dim = queries.agg(F.count("*"), F.max(F.size(vector))).first()
    blocks = -(-n * 8 * max(1, dim or 1) // BLOCK_BYTES)
    for block in range(blocks):
        part = queries if blocks == 1 else queries.where(F.pmod(F.xxhash64(query_id), F.lit(blocks)) == block)
        rows = part.select(query_id, vector).toPandas()
        if len(rows):
            yield rows[query_id].to_numpy(), _matrix(rows[vector])


def _over_blocks(queries: DataFrame, query_id: str, vector: str, schema: str, apply: Callable[[tuple[np.ndarray, np.ndarray]], DataFrame]) -> DataFrame:
    """Union of ``apply(block)``; all but a single block are written out in turn, so that one is held at a time."""
    spark, out, held = queries.sparkSession, None, None
    for block in _query_blocks(queries, query_id, vector):
        if held is not None:
            done = cut_lineage(apply(held))
            out = done if out is None else out.unionAll(done)
        held = block
    if held is None:
        return spark.createDataFrame([], schema)
    last = apply(held)
    return last if out is None else out.unionAll(cut_lineage(last))


def cosine_matrix(corpus: DataFrame, queries: DataFrame, key: str = "vec_id", query_id: str = "query_id", vector: str = "embedding") -> DataFrame:
    """(key, query_id, similarity) of a corpus against a set of vectors, one product per block and Arrow batch."""
    schema = f"{key} bigint, {query_id} bigint, similarity double"

    def against(block: tuple[np.ndarray, np.ndarray]) -> DataFrame:
        shared = corpus.sparkSession.sparkContext.broadcast(block)  # about BLOCK_BYTES

        def score(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            qids, qm = shared.value
            for batch in batches:
                if len(batch):
                    sims = _matrix(batch[vector]) @ qm.T
                    yield pd.DataFrame({key: np.repeat(batch[key].to_numpy(), len(qids)), query_id: np.tile(qids, len(batch)), "similarity": sims.ravel()})

        return corpus.select(key, vector).mapInPandas(score, schema)

    return _over_blocks(queries, query_id, vector, schema, against)


def semantic_topk(
    corpus: DataFrame, queries: DataFrame, k: int, key: str = "vec_id", query_id: str = "query_id", vector: str = "embedding", exclude_self: bool = False
) -> DataFrame:
    """Top-k positive cosines per query. Each batch keeps its own top k, so few rows are shuffled."""
    schema = f"{query_id} bigint, {key} bigint, score double"

    def against(block: tuple[np.ndarray, np.ndarray]) -> DataFrame:
        shared = corpus.sparkSession.sparkContext.broadcast(block)  # about BLOCK_BYTES

        def score(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            qids, qm = shared.value
            for batch in batches:
                if not len(batch):
                    continue
                keys = batch[key].to_numpy()
                sims = np.round(qm @ _matrix(batch[vector]).T, 6)
                if exclude_self:
                    sims[qids[:, None] == keys[None, :]] = -np.inf
                # Ties at the k-th place go to the smaller key, as in the final ranking.
                order = np.lexsort((np.broadcast_to(keys, sims.shape), -sims), axis=1)[:, :k]
                best = np.take_along_axis(sims, order, axis=1)
                out = pd.DataFrame({query_id: np.repeat(qids, order.shape[1]), key: keys[order].ravel(), "score": best.ravel()})
                yield out[out["score"] > 0]

        return corpus.select(key, vector).mapInPandas(score, schema)

    part = _over_blocks(queries, query_id, vector, schema, against)
    return top_per_group(part, [query_id], [F.desc("score"), F.asc(key)], k)


def code_neighbours(corpus: DataFrame, queries: DataFrame, k: int = 10) -> DataFrame:
    """Top-k neighbours per query element, typed by name, structure (token count within 5) or meaning.

    ``corpus`` and ``queries`` carry ``vec_id, embedding, name, n_tokens``.
    """
    q = queries.withColumnRenamed("vec_id", "query_id")
    top = semantic_topk(corpus, q, k, exclude_self=True)
    info = corpus.select("vec_id", "name", "n_tokens")
    joined = top.join(info, "vec_id").join(q.select("query_id", F.col("name").alias("q_name"), F.col("n_tokens").alias("q_tokens")), "query_id")
    kind = F.when(F.col("name") == F.col("q_name"), "name").when(F.abs(F.col("n_tokens") - F.col("q_tokens")) < 5, "structural").otherwise("semantic")
    return joined.select("query_id", "vec_id", "rank", "score", kind.alias("match_type"))


def exact_copies(vectors: DataFrame, key: str = "vec_id", vector: str = "embedding") -> tuple[DataFrame, DataFrame]:
    """(distinct vectors with their first key, (first key, copy) rows)."""
    first = vectors.groupBy(vector).agg(F.min(key).alias("rep"))
    copies = vectors.join(first, vector).filter(F.col(key) != F.col("rep")).select("rep", F.col(key).alias("copy"))
    return first.select(F.col("rep").alias(key), vector), copies


def _nearest(m: np.ndarray, centre: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nearest centre of each vector and its distance."""
    chord = np.sqrt(np.maximum(0.0, (m * m).sum(1)[:, None] + (centre * centre).sum(1)[None, :] - 2.0 * (m @ centre.T)))
    near = chord.argmin(1)
    return near, chord[np.arange(len(m)), near]


def ball_tree(vectors: DataFrame, key: str = "vec_id", vector: str = "embedding") -> tuple[DataFrame, pd.DataFrame]:
    """(key, vector, leaf, dist) of every vector, as it was given, and the leaves (leaf, centre, n, radius) of the normalised ones.

    Two levels of balls: N^1/4 pivots, and as many again inside each of their cells, so a vector is compared with
    2 N^1/4 pivots and the leaves grow with the square root of N. That many centres reach the driver and the tasks.
    """
    spark = vectors.sparkSession
    width = max(2, int(np.ceil(vectors.count() ** 0.25)))
    rows = f"{key} bigint, {vector} {vectors.schema[vector].dataType.simpleString()}"
    first = vectors.select(key, vector).orderBy(F.xxhash64(key)).limit(width).toPandas()
    if first.empty:
        return spark.createDataFrame([], f"{rows}, leaf bigint, dist double"), pd.DataFrame({"leaf": [], "centre": [], "n": [], "radius": []})
    top = spark.sparkContext.broadcast(_matrix(first[vector]))

    def into_cells(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame({key: batch[key], vector: batch[vector], "cell": _nearest(_matrix(batch[vector]), top.value)[0].astype("int64")})

    cells = cut_lineage(vectors.select(key, vector).mapInPandas(into_cells, f"{rows}, cell bigint"))
    ranked = cells.withColumn("_r", F.row_number().over(Window.partitionBy("cell").orderBy(F.xxhash64(key)))).filter(F.col("_r") <= width)
    inner = ranked.toPandas()  # at most width squared
    pivots = {int(c): _matrix(part[vector]) for c, part in inner.groupby("cell")}
    shared = spark.sparkContext.broadcast(pivots)

    def into_leaves(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for cell, part in batch.groupby("cell"):
                near, dist = _nearest(_matrix(part[vector]), shared.value[int(cell)])
                yield pd.DataFrame({key: part[key].to_numpy(), vector: part[vector].to_numpy(), "leaf": int(cell) * width + near, "dist": dist})

    placed = cut_lineage(cells.mapInPandas(into_leaves, f"{rows}, leaf bigint, dist double"))
    leaves = placed.groupBy("leaf").agg(F.count("*").alias("n"), F.max("dist").alias("radius")).toPandas().sort_values("leaf")
    leaves["centre"] = [pivots[leaf // width][leaf % width] for leaf in leaves["leaf"]]
    return placed, leaves


def leaf_pairs(leaves: pd.DataFrame, threshold: float, spark) -> DataFrame:
    """(a, b, n_a, n_b), a <= b: the leaves that can hold a pair of that cosine, by the triangle inequality.

    Two balls whose centres are farther apart than both radii plus the chord of the threshold hold none.
    """
    leaf, n, radius, centre = leaves["leaf"].to_numpy(), leaves["n"].to_numpy(), leaves["radius"].to_numpy(), np.array(leaves["centre"].tolist())
    limit = float(np.sqrt(max(0.0, 2.0 - 2.0 * threshold))) + 1e-9
    shared = spark.sparkContext.broadcast((leaf, n, radius, centre))

    def find(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        leaf, n, radius, centre = shared.value
        for batch in batches:
            for i in batch["id"]:
                square = (centre * centre).sum(1) + (centre[i] * centre[i]).sum() - 2.0 * (centre @ centre[i])
                gap = np.sqrt(np.maximum(0.0, square)) - 1e-7
                other = np.flatnonzero((gap <= radius + radius[i] + limit) & (np.arange(len(leaf)) >= i))
                yield pd.DataFrame({"a": leaf[i], "b": leaf[other], "n_a": n[i], "n_b": n[other]})

    return spark.range(len(leaves)).mapInPandas(find, "a bigint, b bigint, n_a bigint, n_b bigint")


def _packed(sizes: np.ndarray, rows: int) -> np.ndarray:
    """Numbers of packs of consecutive leaves of at most ``rows`` rows in all; a larger leaf is a pack of its own."""
    packs, pack, held = [], 0, 0
    for n in sizes.tolist():
        if held and held + n > rows:
            pack, held = pack + 1, 0
        packs.append(pack)
        held += n
    return np.array(packs, dtype=np.int64)


def _vectors(column: pa.ChunkedArray) -> np.ndarray:
    """The normalised vectors of an Arrow column of lists of one length."""
    values = column.combine_chunks().flatten().to_numpy(zero_copy_only=False)
    return _unit_rows(values.astype(np.float64).reshape(len(column), -1))


def _cosines(va: np.ndarray, vb: np.ndarray, r: np.ndarray, c: np.ndarray) -> np.ndarray:
    """The exact cosines of the pairs (va[r], vb[c]), HITS at a time; they don't depend on the block that a pair is in."""
    parts = [np.einsum("ij,ij->i", va[r[at:at + HITS]], vb[c[at:at + HITS]]) for at in range(0, len(r), HITS)]
    return np.concatenate(parts) if parts else np.empty(0)


def _best(k: int, ids: np.ndarray, others: np.ndarray, sims: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The first k rows of each id, the most similar first, then the smaller other."""
    order = np.lexsort((others, -sims, ids))
    ids, others, sims = ids[order], others[order], sims[order]
    starts = np.flatnonzero(np.concatenate([np.ones(min(1, len(ids)), bool), ids[1:] != ids[:-1]]))
    kept = np.arange(len(ids)) - np.repeat(starts, np.diff(np.append(starts, len(ids)))) < k
    return ids[kept], others[kept], sims[kept]


def _close(ka: np.ndarray, va: np.ndarray, kb: np.ndarray, vb: np.ndarray, k: int, threshold: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(r, c) of the pairs (va[r], vb[c]) that may have a cosine of ``threshold`` and be among the k best of either end.

    Products of single precision, less their rounding error, rule the other pairs out. The k best of a product are looked
    for only if many of its pairs reach the threshold.
    """
    a, b = va.astype(np.float32), vb.astype(np.float32)
    slack = np.float32(1e-6 * (8 + a.shape[1] / 8))  # over twice the rounding error of a product of unit vectors
    least = np.float32(threshold) - slack
    room, marks = np.empty(TILE * TILE, np.float32), np.empty(TILE * TILE, bool)
    for u in range(0, len(a), TILE):
        for v in range(0, len(b), TILE):
            x, y = a[u:u + TILE], b[v:v + TILE]
            size = len(x) * len(y)
            product, met = room[:size].reshape(len(x), len(y)), marks[:size].reshape(len(x), len(y))
            np.matmul(x, y.T, out=product)
            np.greater_equal(product, least, out=met)
            if np.count_nonzero(met) > 8 * k * TILE:
                product[ka[u:u + TILE, None] == kb[None, v:v + TILE]] = -np.inf
                bars = [np.partition(product, n - k, axis=axis).take([n - k], axis=axis) - slack if n > k else least for axis, n in enumerate(product.shape)]
                met &= (product >= bars[0]) | (product >= bars[1])
            r, c = np.divmod(np.flatnonzero(met), len(y))
            yield r + u, c + v


def neighbours(
    vectors: DataFrame, k: int, threshold: float, key: str = "vec_id", vector: str = "embedding", block_rows: int = BLOCK_ROWS
) -> DataFrame:
    """Exact (id, other, similarity): up to ``k`` nearest others of each vector with cosine >= threshold.

    Vectors lie in the leaves of a ball tree. Leaves that lie side by side are put together in packs of up to PACK_BLOCKS
    blocks, so a vector is sent once to each pack it meets and not to each leaf. Only packs with leaves that can hold a close pair
    meet, each two of them once. A task compares two packs by matrix products of bounded size in single precision, takes the exact
    cosine of the few pairs that these leave and gives at most k rows per vector.
    """
    placed, leaves = ball_tree(vectors, key, vector)
    spark, schema = vectors.sparkSession, "id bigint, other bigint, similarity double"
    if not len(leaves):
        return spark.createDataFrame([], schema)
    pack_rows = int(min(PACK_BLOCKS * block_rows, max(block_rows, leaves["n"].sum() // PACKS)))
    leaves["pack"] = _packed(leaves["n"].to_numpy(), pack_rows)
    packs = cut_lineage(spark.createDataFrame(leaves[["leaf", "pack"]].merge(leaves.groupby("pack", as_index=False)["n"].sum(), on="pack")))
    end = lambda side: packs.select(F.col("leaf").alias(side), F.col("pack").alias(f"p_{side}"), F.col("n").alias(f"n_{side}"))
    near = leaf_pairs(leaves, threshold, spark).select("a", "b").join(end("a"), "a").join(end("b"), "b")
    met = cut_lineage(near.select(F.col("p_a").alias("a"), F.col("p_b").alias("b"), "n_a", "n_b").distinct())
    last = lambda n: F.floor((F.col(n) - 1) / pack_rows)
    pairs = met.select("a", "b", F.explode(F.sequence(F.lit(0).cast("bigint"), last("n_a"))).alias("i"), "n_b")
    pairs = cut_lineage(pairs.select("a", "b", "i", F.explode(F.sequence(F.lit(0).cast("bigint"), last("n_b"))).alias("j")).filter("a < b OR i <= j"))
    rows = placed.drop("dist").join(packs, "leaf").withColumn("block", F.pmod(F.xxhash64(key), last("n") + 1)).drop("n", "leaf")
    group = ["a", "i", "b", "j"]
    left = rows.withColumnsRenamed({"pack": "a", "block": "i"}).join(pairs, ["a", "i"])
    right = rows.withColumnsRenamed({"pack": "b", "block": "j", key: "r_key", vector: "r_vec"}).join(pairs, ["b", "j"])

    def compare(a: pa.Table, b: pa.Table) -> pa.Table:
        ka, kb = a.column(key).to_numpy(), b.column("r_key").to_numpy()
        own = bool(len(ka) and len(kb)) and all(a.column(x)[0] == b.column(y)[0] for x, y in (("a", "b"), ("i", "j")))
        found, near, held = [(ka[:0], kb[:0], np.empty(0))], [], 0

        def take() -> None:
            r, c = map(np.concatenate, zip(*near))
            sims = _cosines(va, vb, r, c)
            kept = (sims >= threshold) & (ka[r] != kb[c])
            one, other, sims = ka[r[kept]], kb[c[kept]], sims[kept]
            found.extend([(one, other, sims)] if own else [(one, other, sims), (other, one, sims)])
            found[:] = [_best(k, *map(np.concatenate, zip(*found)))]
            near.clear()

        if len(ka) and len(kb):
            va, vb = _vectors(a.column(vector)), _vectors(b.column("r_vec"))
            for r, c in _close(ka, va, kb, vb, k, threshold):
                near.append((r, c))
                held += len(r)
                if held > 8 * HITS:
                    take()
                    held = 0
            take()
        ids, others, sims = found[0]
        return pa.table({"id": pa.array(ids, pa.int64()), "other": pa.array(others, pa.int64()), "similarity": pa.array(sims, pa.float64())})

    hits = left.groupBy(*group).cogroup(right.groupBy(*group)).applyInArrow(compare, schema)
    return top_per_group(hits, ["id"], [F.desc("similarity"), F.asc("other")], k)


def near_duplicates(vectors: DataFrame, threshold: float = 0.9, k: int = 5, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """Canonical (a, b, similarity) pairs among top-k neighbours, exact copies tied to their first one.

    Copies are merged before the search and come back as one row each, so a third
    of all rows being equal costs a third of all rows, not their pairs.
    """
    distinct, copies = exact_copies(vectors, key, vector)
    near = neighbours(distinct, k, threshold, key, vector).select(
        F.least("id", "other").alias("a"), F.greatest("id", "other").alias("b"), "similarity")
    pairs = near.groupBy("a", "b").agg(F.max("similarity").alias("similarity"))
    return pairs.unionByName(copies.select(F.col("rep").alias("a"), F.col("copy").alias("b"), F.lit(1.0).alias("similarity")))
