"""Extension surface: plugin transforms, diff functions, memory and library tables."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from functools import reduce
from operator import add

from pyspark.sql import Column, DataFrame, Window, functions as F

from citeloom.functions import constants as K
from citeloom.session import cut_lineage

from .rules import instant, is_expired
from .sets import upsert_last_wins


# Plugins --------------------------------------------------------------------

@dataclass
class PluginRegistry:
    """Named DataFrame transforms run by priority; a failing plugin is logged and skipped."""

    plugins: list[tuple[int, int, str, str, Callable[[DataFrame], DataFrame]]] = field(default_factory=list)
    log: list[dict] = field(default_factory=list)

    def register(self, point: str, name: str, fn: Callable[[DataFrame], DataFrame], priority: int = 100) -> None:
        self.plugins.append((priority, len(self.plugins), point, name, fn))

    def apply(self, point: str, df: DataFrame) -> DataFrame:
        for priority, _, at, name, fn in sorted(self.plugins, key=lambda p: p[:2]):
            if at != point:
                continue
            try:
                df = df.transform(fn)
                df.schema  # analysis errors surface here, before the next plugin
                self.log.append({"plugin": name, "priority": priority, "ok": True, "error": None})
            except Exception as exc:
                self.log.append({"plugin": name, "priority": priority, "ok": False, "error": str(exc)})
        return df

    def register_sql(self, spark, name: str, fn) -> None:
        spark.udf.register(name, fn)


# Diffs ----------------------------------------------------------------------

def diff_changes(diff: Column) -> Column:
    """(additions, deletions) of a diff, file headers excluded."""
    lines = F.split(diff, "\n")
    count = lambda sign: F.size(F.filter(lines, lambda l: l.startswith(sign) & ~l.startswith(sign * 3)))
    return F.struct(count("+").alias("additions"), count("-").alias("deletions"))


def normalize_decision(value: Column) -> Column:
    v = F.lower(F.trim(F.coalesce(value, F.lit(""))))
    return (F.when(v.isin(*K.ACCEPT_WORDS), "accepted").when(v.isin(*K.REJECT_WORDS), "rejected")
            .when(v.isin(*K.REGENERATE_WORDS), "regenerate").otherwise("accepted"))


# Analyzer -------------------------------------------------------------------

def analyze_packages(files: DataFrame, repo: str, manifest: Column) -> DataFrame:
    """File counts per repo and kind, and the dependency names its manifests list."""
    deps = F.map_keys(F.coalesce(F.from_json(F.get_json_object(manifest, "$.dependencies"), "map<string,string>"), F.create_map().cast("map<string,string>")))
    counts = files.groupBy(repo, "kind").agg(F.count("*").alias("n")).select(repo, F.col("kind").alias("item"), F.lit("files").alias("what"), "n")
    names = files.select(repo, F.explode(deps).alias("item")).groupBy(repo, "item").agg(F.count("*").alias("n")).select(repo, "item", F.lit("dependency").alias("what"), "n")
    return counts.unionByName(names)


# Memory table ---------------------------------------------------------------

# Lifetime of each memory type in hours.
TTL_HOURS = {"episodic": 30 * 24, "semantic": 365 * 24, "working": 24, "procedural": 180 * 24, "archived": 5 * 365 * 24}


def memory_tier(importance: Column) -> Column:
    return F.when(importance == 5, "frozen").when(importance == 4, "hot").when(importance == 3, "warm").otherwise("cold")


def add_memories(current: DataFrame, new: DataFrame, as_of: str, ttl_hours: dict[str, int] | None = None) -> DataFrame:
    """Append memories with a tier from importance and an expiry from their type."""
    ttl = TTL_HOURS if ttl_hours is None else ttl_hours
    hours = None
    for kind, h in ttl.items():
        hours = F.when(F.col("memory_type") == kind, h) if hours is None else hours.when(F.col("memory_type") == kind, h)
    expires = F.when(hours.isNotNull(), instant(as_of) + F.make_dt_interval(F.lit(0), hours))
    prepared = new.withColumns({"tier": memory_tier(F.col("importance")), "expires_at": expires, "created_at": instant(as_of), "accessed_at": instant(as_of), "access_count": F.lit(0).cast("bigint")})
    return current.unionByName(prepared.select(*current.columns))


def access_memories(memories: DataFrame, touched: DataFrame, as_of: str) -> DataFrame:
    """Count one access for the touched ids and promote their tier by one."""
    hit = memories.join(touched.select("id").distinct().withColumn("_hit", F.lit(True)), "id", "left")
    on = F.coalesce("_hit", F.lit(False))
    tier = F.when(on & (F.col("tier") == "cold"), "warm").when(on & (F.col("tier") == "warm"), "hot").otherwise(F.col("tier"))
    return hit.withColumns({
        "tier": tier, "access_count": F.col("access_count") + F.when(on, 1).otherwise(0),
        "accessed_at": F.when(on, instant(as_of)).otherwise(F.col("accessed_at"))}).drop("_hit")


def _word_set(text: Column) -> Column:
    return F.array_distinct(F.filter(F.split(F.lower(text), r"\s+"), lambda w: w != ""))


#: 64-bit words of a text's signature.
SIGNATURE_WORDS = 8


def _signed_sets(texts: DataFrame) -> DataFrame:
    """(id, n, hashes, s0, s1, ...) of distinct word sets (id, words): hashes of the words and a signature, in which each word sets one bit."""
    h = texts.select("id", F.size("words").alias("n"), F.transform("words", lambda w: F.xxhash64(w)).alias("hashes"))
    bit = lambda x: F.call_function("shiftleft", F.lit(1).cast("long"), x.bitwiseAND(F.lit(63)).cast("int"))

    def word(i: int) -> Column:
        mine = F.filter("hashes", lambda x: F.shiftrightunsigned(x, 6).bitwiseAND(F.lit(SIGNATURE_WORDS - 1)) == i)
        return F.aggregate(mine, F.lit(0).cast("long"), lambda acc, x: acc.bitwiseOR(bit(x)))

    return h.select("*", *(word(i).alias(f"s{i}") for i in range(SIGNATURE_WORDS)))


def consolidation_candidates(memories: DataFrame, threshold: float = 0.8) -> DataFrame:
    """Episodic memories (3 accesses, medium importance) without a similar semantic one.

    Similar = the share of the memory's words found in a semantic memory reaches
    the threshold. Such a pair must share one of the memory's rarest
    ``n - ceil(t n) + 1`` words, so only those are joined. Memories of equal words are one. A bit of the memory's signature
    that the other's lacks stands for a word that it lacks, so signatures rule most pairs out inside the join, and no texts
    are sent for them. Of the pairs left, each memory's nearest by signature is checked first, the others only if that is not similar.
    """
    words = _word_set(F.col("content"))
    own = lambda rows: rows.select("id", F.array_sort(words).alias("words")).withColumn("key", F.sha2(F.array_join("words", " "), 256))
    distinct = lambda rows: cut_lineage(rows.groupBy("key").agg(F.min("id").alias("id"), F.any_value("words").alias("words")))
    ready = own(memories.filter("memory_type = 'episodic' AND access_count >= 3 AND importance >= 3"))
    mine, others = distinct(ready), distinct(own(memories.filter("memory_type = 'semantic'")))
    sets, known = cut_lineage(_signed_sets(mine)), cut_lineage(_signed_sets(others))

    freq = known.select(F.explode("hashes").alias("h")).groupBy("h").agg(F.count("*").alias("df"))
    each = sets.select("id", "n", F.explode("hashes").alias("h")).join(freq, "h", "left").fillna(0, ["df"])
    lacking = F.col("n") - F.ceil(F.lit(threshold) * F.col("n") - 1e-9)
    rare = each.withColumn("rk", F.row_number().over(Window.partitionBy("id").orderBy("df", "h"))).filter((F.col("rk") <= lacking + 1) & (F.col("df") > 0))
    signature = [f"s{i}" for i in range(SIGNATURE_WORDS)]
    x = rare.select("id", "h").join(sets.select("id", lacking.alias("most"), *signature), "id").alias("x")
    y = known.select(F.col("id").alias("sid"), F.explode("hashes").alias("h"), *signature).alias("y")
    absent = reduce(add, (F.bit_count(F.col(f"x.{s}").bitwiseAND(F.bitwise_not(F.col(f"y.{s}")))) for s in signature))
    near = x.join(y, (F.col("x.h") == F.col("y.h")) & (absent <= F.col("x.most")))
    pairs = cut_lineage(near.select("x.id", "y.sid", absent.alias("absent")).distinct())

    def similar(pairs: DataFrame) -> DataFrame:
        met = pairs.join(mine.select("id", "words"), "id").join(others.select(F.col("id").alias("sid"), F.col("words").alias("swords")), "sid")
        return cut_lineage(met.filter(F.size(F.array_intersect("words", "swords")) / F.size("words") >= threshold).select("id").distinct())

    nearest = pairs.groupBy("id").agg(F.min(F.struct("absent", "sid"))["sid"].alias("sid"))
    found = similar(nearest)
    rest = pairs.select("id", "sid").join(found, "id", "left_anti").join(nearest, ["id", "sid"], "left_anti")
    found = found.unionByName(similar(rest))
    return ready.join(mine.join(found, "id").select("key"), "key", "left_anti").select("id")


def consolidate(memories: DataFrame, next_id: Column, as_of: str) -> DataFrame:
    """Copy each candidate as a semantic memory of high importance."""
    fresh = memories.join(consolidation_candidates(memories), "id").withColumns({
        "id": next_id, "memory_type": F.lit("semantic"), "importance": F.lit(4), "tier": F.lit("hot"), "access_count": F.lit(0).cast("bigint"),
        "created_at": instant(as_of), "accessed_at": instant(as_of), "expires_at": F.lit(None).cast("timestamp_ntz")})
    return memories.unionByName(fresh.select(*memories.columns))


def _age_days(created: Column, as_of: str) -> Column:
    return (F.unix_micros(instant(as_of).cast("timestamp")) - F.unix_micros(created.cast("timestamp"))) / 86_400_000_000


def archive_memories(memories: DataFrame, as_of: str, days: int = 30) -> DataFrame:
    old = (F.col("memory_type") == "episodic") & (_age_days(F.col("created_at"), as_of) > days) & (F.col("access_count") < 2)
    return memories.withColumns({"memory_type": F.when(old, "archived").otherwise(F.col("memory_type")), "tier": F.when(old, "cold").otherwise(F.col("tier"))})


def decay_memories(memories: DataFrame, as_of: str) -> DataFrame:
    """Lower importance after 90 days and tier after 180 days."""
    age, imp = _age_days(F.col("created_at"), as_of), F.col("importance")
    lowered = F.when((age > 90) & imp.isin(3, 4), imp - 1).otherwise(imp)
    tier = F.when((age > 180) & ~F.col("tier").isin("frozen", "cold"), "cold").otherwise(F.col("tier"))
    return memories.withColumns({"importance": lowered.cast(memories.schema["importance"].dataType), "tier": tier})


def drop_expired(memories: DataFrame, as_of: str) -> DataFrame:
    return memories.filter(~is_expired(F.col("expires_at").cast("string"), as_of))


def merge_memories(memories: DataFrame, groups: DataFrame) -> DataFrame:
    """Archive the members of each merge group ``(id, merged_into)``."""
    m = memories.join(groups.select("id", "merged_into"), "id", "left")
    return m.withColumn("memory_type", F.when(F.col("merged_into").isNotNull(), "archived").otherwise(F.col("memory_type"))).drop("merged_into")


# Paper library --------------------------------------------------------------

def library_key(arxiv: Column, url: Column, title: Column) -> Column:
    nz = lambda c: F.when(c != "", c)
    return F.coalesce(nz(arxiv), nz(url), title)


def save_to_library(library: DataFrame, incoming: DataFrame) -> DataFrame:
    return upsert_last_wins(library, incoming, "library_id", "saved_at")


def library_usage(uses: DataFrame) -> DataFrame:
    return uses.groupBy("library_id").agg(F.sum("uses").alias("uses"), F.max("ts").alias("last_used"))
