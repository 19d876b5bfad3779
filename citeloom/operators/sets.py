"""Set operations, deduplication, upserts and incremental refresh."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from citeloom.functions import text as X
from citeloom.session import cut_lineage

from .components import connected_components


def union_sources(sources: Sequence[DataFrame], pos: str) -> DataFrame:
    """Union of per-source results keeping source order, then the order inside each source."""
    out = None
    for rank, part in enumerate(sources):
        ranked = part.withColumn("source_rank", F.lit(rank))
        out = ranked if out is None else out.unionByName(ranked, allowMissingColumns=True)
    return out


def union_deduplicated(sources: Sequence[tuple[str, DataFrame]], pos: str, max_results: int | None = None) -> DataFrame:
    """Union of named sources without repeated papers: the first record of each, with the sources that have it.

    Records are in source order, then in the order of ``pos`` inside each source. A record joins the first earlier one
    that shares a key with it (``greedy_entities``); ``merged_sources`` lists the sources of a paper's records in
    source order. The first ``max_results`` papers stay.
    """
    rows = union_sources([part.withColumn("source", F.lit(name)) for name, part in sources], pos)
    rows = cut_lineage(rows.withColumn("_at", F.struct("source_rank", pos)))
    groups = greedy_entities(rows, "_at")
    named = groups.join(rows.select("_at", "source_rank", "source"), "_at").groupBy("entity").agg(F.array_sort(F.collect_set(F.struct("source_rank", "source"))).alias("s"))
    papers = rows.join(named.select(F.col("entity").alias("_at"), F.transform("s", lambda x: x["source"]).alias("merged_sources")), "_at")
    if max_results is not None:
        papers = papers.orderBy("_at").limit(max_results)
    return papers.drop("_at")


def dedupe_first(df: DataFrame, key: Column, order: Sequence[str]) -> DataFrame:
    """Keep the first row per key; a partial aggregate, so copies merge before the shuffle."""
    row = F.struct(*order, *[c for c in df.columns if c not in order])
    return df.groupBy(key.alias("_key")).agg(F.min(row).alias("r")).select("_key", "r.*")


def upsert_last_wins(current: DataFrame, incoming: DataFrame, key: str, version: str) -> DataFrame:
    """Insert or replace by key: the highest version wins, incoming rows win ties."""
    both = current.withColumn("_new", F.lit(0)).unionByName(incoming.withColumn("_new", F.lit(1)))
    rest = [c for c in current.columns if c not in (key, version)]
    best = both.groupBy(key).agg(F.max(F.struct(version, "_new", *rest)).alias("r"))
    return best.select(key, f"r.{version}", *[f"r.{c}" for c in rest])


def composed_id(arxiv: Column, doi: Column, fallback: Column) -> Column:
    nz = lambda c: F.when(F.trim(c) != "", F.trim(c))
    return F.coalesce(nz(arxiv), nz(doi), F.concat(F.lit("hash-"), F.substring(F.sha2(fallback, 256), 1, 16)))


def incremental_refresh(new: DataFrame, cache: DataFrame, keys: Sequence[str], compute, output: str) -> DataFrame:
    """Recompute only rows whose key (id, text hash, dimension) is not cached."""
    stale = new.join(cache.select(*keys), list(keys), "left_anti")
    fresh = compute(stale).select(*keys, output, F.lit(True).alias("recomputed"))
    kept = cache.join(new.select(*keys), list(keys), "left_semi").select(*keys, output, F.lit(False).alias("recomputed"))
    return fresh.unionByName(kept)


# Entity resolution ----------------------------------------------------------

MIN_TITLE_KEY = 20


def identity_keys(papers: DataFrame, pos: str) -> DataFrame:
    """(pos, kind, value) identity keys; titles count from 20 normalised characters."""
    title = X.normalize_title(F.col("title"))
    low = lambda c: F.lower(F.trim(F.coalesce(F.col(c), F.lit(""))))
    key = lambda kind, value: F.struct(F.lit(kind).alias("kind"), value.alias("value"))
    keys = F.array(
        key("doi", X.normalize_doi(F.coalesce("doi", F.lit("")))),
        key("arxiv", low("arxiv_id")), key("pubmed", low("pubmed_id")), key("ieee", low("ieee_id")),
        key("title", F.when(F.length(title) >= MIN_TITLE_KEY, title).otherwise("")))
    return papers.select(pos, F.explode(keys).alias("k")).select(pos, "k.kind", "k.value").filter("value <> ''")


def connected_entities(papers: DataFrame, pos: str) -> DataFrame:
    """Entity = all records linked by any chain of shared keys; label is its first record.

    Each record links to the first record of each of its keys, so a key shared by a third
    of all records costs one row per record. Components are found to the end, however
    long the chain, in rounds that grow with the logarithm of its length.
    """
    keys = cut_lineage(identity_keys(papers, pos))
    first = keys.groupBy("kind", "value").agg(F.min(pos).alias("a"))
    links = keys.join(first, ["kind", "value"]).select("a", F.col(pos).alias("b"))
    roots = connected_components(links).withColumnRenamed("node", pos)
    return papers.select(pos).join(roots, pos, "left").select(pos, F.coalesce("root", pos).alias("entity"))


def greedy_entities(papers: DataFrame, pos: str) -> DataFrame:
    """Order-dependent grouping: a record joins the first earlier group whose founder shares a key.

    The founders are the lexicographically first independent set of records under
    "shares a key". Each round founds every record that is the earliest undecided
    one on all of its keys and settles the records next to a founder; key minima
    carry all messages.
    """
    keys = cut_lineage(identity_keys(papers, pos))
    open_rows = papers.select(pos)
    founders = None
    while True:  # each round settles the earliest undecided record at least
        live = keys.join(open_rows, pos, "left_semi")
        first = live.groupBy("kind", "value").agg(F.min(pos).alias("first"))
        beaten = live.join(first, ["kind", "value"]).filter(F.col("first") < F.col(pos)).select(pos).distinct()
        new = cut_lineage(open_rows.join(beaten, pos, "left_anti"))
        founders = new if founders is None else cut_lineage(founders.unionAll(new))
        taken = keys.join(new, pos, "left_semi").select("kind", "value").distinct()
        settled = live.join(taken, ["kind", "value"], "left_semi").select(pos).distinct()
        open_rows = cut_lineage(open_rows.join(new, pos, "left_anti").join(settled, pos, "left_anti"))
        if not open_rows.limit(1).count():
            break
    founder_of = keys.join(founders, pos, "left_semi").groupBy("kind", "value").agg(F.min(pos).alias("founder"))
    joined = keys.join(founder_of, ["kind", "value"]).groupBy(pos).agg(F.min("founder").alias("founder"))
    own = founders.select(pos, F.lit(True).alias("_founder"))
    return papers.select(pos).join(own, pos, "left").join(joined, pos, "left").select(
        pos, F.when(F.col("_founder"), F.col(pos)).otherwise(F.coalesce("founder", F.col(pos))).alias("entity"))
