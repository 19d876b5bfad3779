"""Graph analytics on edge tables ``(src, dst)``: src references / depends on dst.

Loops carry their state through tables written to the shared folder and ask the driver only for
a stop test of one row.
"""

from __future__ import annotations

import itertools
from collections.abc import Callable
from functools import reduce
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, functions as F

from citeloom.functions import scoring as S
from citeloom.session import cut_lineage, scratch_dir


def _any(df: DataFrame) -> bool:
    return df.limit(1).count() > 0


# Structure ------------------------------------------------------------------

def build_edges(raw: DataFrame) -> DataFrame:
    """Distinct edges; the reverse adjacency is the same table read backwards."""
    return raw.select("src", "dst").filter("src IS NOT NULL AND dst IS NOT NULL").distinct()


def reverse(edges: DataFrame) -> DataFrame:
    return edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"))


def ghost_nodes(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Endpoints missing from the node table, with title '' and year 0."""
    ends = edges.select(F.explode(F.array("src", "dst")).alias("id")).distinct()
    return ends.join(nodes, "id", "left_anti").select("id", F.lit("").alias("title"), F.lit(0).alias("year"))


def degrees(edges: DataFrame) -> DataFrame:
    """In and out degree per node; one partial aggregation over both ends."""
    ends = edges.select(F.explode(F.array(
        F.struct(F.col("src").alias("id"), F.lit(1).alias("o"), F.lit(0).alias("i")),
        F.struct(F.col("dst").alias("id"), F.lit(0).alias("o"), F.lit(1).alias("i")),
    )).alias("e")).select("e.*")
    return ends.groupBy("id").agg(F.sum("i").alias("in_degree"), F.sum("o").alias("out_degree"))


def leaf_and_entry(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Nodes without outgoing edges (leaf) and without incoming edges (entry)."""
    ids = nodes.select("id")
    leaf = ids.join(edges.select(F.col("src").alias("id")), "id", "left_anti").select("id", F.lit("leaf").alias("role"))
    entry = ids.join(edges.select(F.col("dst").alias("id")), "id", "left_anti").select("id", F.lit("entry").alias("role"))
    return leaf.unionAll(entry)


# PageRank -------------------------------------------------------------------

def pagerank(
    nodes: DataFrame, edges: DataFrame, damping: float = 0.85, iterations: int = 100, tolerance: float = 1e-13, every: int = 3
) -> DataFrame:
    """r = (1-d)/n + d M r over distinct references; dangling mass is not spread.

    Nodes that nothing points to have their rank after the first round. What they give to others is summed once, and
    the rounds walk only the links between the nodes that are pointed to. Every few rounds these ranks are written out
    and compared with those of the round before. Once no rank moves by more than the share ``tolerance`` of itself
    (rounding noise by default) the remaining rounds would change nothing visible.
    """
    ids = nodes.select("id")
    n = ids.count()
    if n == 0:
        return ids.withColumn("rank", F.lit(0.0))
    e = cut_lineage(edges.select("src", "dst").distinct())
    known = e.join(ids.withColumnRenamed("id", "dst"), "dst", "left_semi")
    pointed = cut_lineage(known.select(F.col("dst").alias("id")).distinct())
    out = e.groupBy("src").agg((1.0 / F.count("*")).alias("share")).join(ids.withColumnRenamed("id", "src"), "src", "left_semi")
    out = out.join(pointed.select(F.col("id").alias("src"), F.lit(True).alias("inner")), "src", "left")
    links = cut_lineage(known.join(out, "src").select("src", "dst", "share", F.coalesce("inner", F.lit(False)).alias("inner")))
    given = links.filter("NOT inner").groupBy(F.col("dst").alias("id")).agg(F.sum("share").alias("given"))
    moving = cut_lineage(pointed.join(given, "id", "left").select("id", F.coalesce("given", F.lit(0.0)).alias("given")))
    links = cut_lineage(links.filter("inner").select("src", "dst", "share"))
    teleport, outer = (1.0 - damping) / n, 1.0 / n
    ranks = moving.select("id", F.lit(outer).alias("rank"))
    done = 0
    while done < iterations:
        for _ in range(min(every, iterations - done)):
            previous = ranks
            sums = links.join(ranks, links["src"] == ranks["id"]).groupBy("dst").agg(F.sum(F.col("rank") * F.col("share")).alias("s"))
            gained = F.col("given") * F.lit(outer) + F.coalesce("s", F.lit(0.0))
            ranks = moving.join(sums, moving["id"] == sums["dst"], "left").select("id", (F.lit(teleport) + F.lit(damping) * gained).alias("rank"))
            outer = teleport
            done += 1
        ranks = cut_lineage(ranks.join(previous.withColumnRenamed("rank", "prev"), "id"))
        moved = ranks.filter(F.abs(F.col("rank") - F.col("prev")) > tolerance * F.col("prev"))
        ranks = ranks.select("id", "rank")
        if done > 1 and not _any(moved):
            break
    return ids.join(ranks, "id", "left").select("id", F.coalesce("rank", F.lit(outer)).alias("rank"))


# Paths ----------------------------------------------------------------------

def shortest_path(edges: DataFrame, source, target, max_depth: int = 5) -> DataFrame:
    """One shortest path of at most ``max_depth`` edges; ties take the smallest path."""
    e = edges.select("src", "dst")
    spark, kind = edges.sparkSession, edges.schema["src"].dataType
    start = spark.range(1).select(F.lit(source).cast(kind).alias("id"), F.array(F.lit(source).cast(kind)).alias("path"))
    if source == target:
        return start.select("path", F.lit(0).alias("length"))
    frontier, visited = start, start.select("id")
    for _ in range(max_depth):
        step = frontier.join(e, frontier["id"] == e["src"]).select(F.col("dst").alias("id"), F.concat("path", F.array("dst")).alias("path"))
        frontier = cut_lineage(step.groupBy("id").agg(F.min("path").alias("path")).join(visited, "id", "left_anti"))
        hit = frontier.filter(F.col("id") == F.lit(target).cast(kind))
        if _any(hit):
            return hit.select("path", (F.size("path") - 1).alias("length"))
        if not _any(frontier):
            break
        visited = cut_lineage(visited.unionAll(frontier.select("id")))
    return start.filter("false").select("path", F.lit(0).alias("length"))


def _within(edges: DataFrame, target: Column, hops: int) -> DataFrame:
    """Nodes that reach the target in at most ``hops`` edges, with that distance."""
    near = edges.sparkSession.range(1).select(target.alias("id"), F.lit(0).alias("dist"))
    frontier = near
    for d in range(1, hops + 1):
        step = edges.join(frontier, edges["dst"] == frontier["id"]).select(edges["src"].alias("id")).distinct()
        frontier = cut_lineage(step.join(near, "id", "left_anti").withColumn("dist", F.lit(d)))
        near = near.unionAll(frontier)
    return near


def all_simple_paths(edges: DataFrame, source, target, max_depth: int = 4) -> DataFrame:
    """Simple paths of at most ``max_depth`` nodes.

    Partial paths that cannot reach the target in the steps left are dropped, so
    only paths between the two ends are ever expanded.
    """
    kind = edges.schema["src"].dataType
    e = cut_lineage(edges.select("src", "dst").distinct())
    goal = F.lit(target).cast(kind)
    reach = cut_lineage(_within(e, goal, max_depth - 2).withColumnRenamed("id", "dst"))
    leading = cut_lineage(e.join(reach, "dst").select("src", "dst", "dist"))
    paths = e.sparkSession.range(1).select(F.lit(source).cast(kind).alias("id"), F.array(F.lit(source).cast(kind)).alias("path"))
    found = paths.filter("false")
    for used in range(1, max_depth):
        useful = leading.filter(F.col("dist") <= max_depth - 1 - used)
        step = paths.join(useful, paths["id"] == useful["src"]).filter(~F.array_contains("path", F.col("dst")))
        step = cut_lineage(step.select(F.col("dst").alias("id"), F.concat("path", F.array("dst")).alias("path")))
        found = found.unionAll(step.filter(F.col("id") == goal))
        paths = step.filter(F.col("id") != goal)
    return found.select("path", (F.size("path") - 1).alias("length"))


def _fold_layers(layers: DataFrame, edges: DataFrame, own: DataFrame, merge: Callable[[DataFrame], DataFrame], step: Callable[[DataFrame], DataFrame]) -> DataFrame | None:
    """What every node gathers from the nodes it points to, on an acyclic graph, layer by layer.

    ``layers(id, layer)`` counts from the sinks, ``own(id, ...)`` are the rows a node hands on besides
    those it has gathered. A finished layer is pushed over its incoming edges and filed under the layers of the
    nodes it goes to, so every row is written once, and read once by the layer that merges it.
    """
    spark = edges.sparkSession
    aimed = cut_lineage(edges.join(layers.withColumnsRenamed({"id": "src", "layer": "to"}), "src").select("src", "to", F.col("dst").alias("id")))
    filed, done, shape = scratch_dir(spark), None, None
    top = layers.agg(F.max("layer")).first()[0]
    for layer in range((-1 if top is None else top) + 1):
        handed = own.join(layers.filter(F.col("layer") == layer).select("id"), "id", "left_semi")
        if shape is not None:
            got = spark.read.schema(shape).parquet(filed).filter(F.col("to") == layer).drop("to")
            reach = cut_lineage(merge(got.select(*own.columns)))
            done = reach if done is None else done.unionByName(reach)
            handed = handed.unionByName(reach)
        if layer < top:
            pushed = step(handed).join(aimed, "id").drop("id").withColumnRenamed("src", "id")
            merged = merge(pushed.select(*own.columns, "to"), "to").select(*own.columns, "to")
            merged.write.mode("append").partitionBy("to").parquet(filed)
            shape = merged.schema
    return done


class Graded(NamedTuple):
    """An acyclic graph each of whose edges goes down by exactly one layer."""

    heights: DataFrame  # (id, layer) of the nodes that point to others
    steps: DataFrame  # (src, dst, upper, lower, inner, lone): the layers of both ends, whether something points to src, and whether this is its only edge
    top: int

    def reversed(self) -> Graded:
        turned = self.steps.select(F.col("dst").alias("src"), F.col("src").alias("dst"), (self.top - F.col("lower")).alias("upper"),
                                   (self.top - F.col("upper")).alias("lower"), (F.col("lower") > 0).alias("inner"), F.lit(False).alias("lone"))  # not asked for: merged like others
        return self._replace(steps=turned)


def _graded(e: DataFrame) -> Graded | None:
    """A stored table of distinct edges with its layers, or None if it has a cycle or an edge that passes over a layer.

    Rounds walk only the edges of nodes that are pointed to; the others take their layer from the one pass that places all edges.
    """
    pointed = e.select(F.col("dst").alias("src")).distinct().withColumn("inner", F.lit(True))
    out = e.groupBy("src").agg((F.count("*") == 1).alias("lone")).join(pointed, "src", "left")
    flagged = cut_lineage(e.join(out, "src").select("src", "dst", F.coalesce("inner", F.lit(False)).alias("inner"), "lone"))
    inner, stuck = _walks(cut_lineage(flagged.filter("inner").select("src", "dst")))
    if stuck is not None:
        return None
    low = cut_lineage(inner).select(F.col("id").alias("dst"), F.col("layer").alias("lower"))
    placed = flagged.join(low, "dst", "left").withColumn("lower", F.coalesce("lower", F.lit(0)))
    steps = cut_lineage(placed.select("src", "dst", (F.col("lower") + 1).alias("upper"), "lower", "inner", "lone"))
    several = steps.filter("NOT lone").groupBy(F.col("src").alias("id"))
    if _any(several.agg((F.min("upper") != F.max("upper")).alias("uneven")).filter("uneven")):
        return None
    heights = steps.filter("lone").select(F.col("src").alias("id"), F.col("upper").alias("layer")).unionByName(several.agg(F.max("upper").alias("layer")))
    return Graded(heights, steps, steps.agg(F.max("upper")).first()[0] or 0)


def _fold_graded(g: Graded, direct: Callable[[int], DataFrame], step: Callable[[DataFrame], DataFrame], merge: Callable[[DataFrame], DataFrame]) -> DataFrame | None:
    """What every node gathers from two or more layers below, on a graded graph.

    ``direct(layer)`` are the rows that the nodes of a layer have of the nodes they point to. These never meet what lies
    deeper, so they are not merged with it; each layer is written once and handed on to the next one only. A node with one
    edge takes the rows as they are, only those of others are merged.
    """
    deep, done = None, None
    for layer in range(1, g.top):
        rows = cut_lineage(step(direct(layer) if deep is None else direct(layer).unionByName(deep)))
        up = g.steps.filter(F.col("lower") == layer).select("src", F.col("dst").alias("id"), "lone")
        alone, several = (rows.join(up.filter(F.col("lone") == lone), "id").drop("id", "lone").withColumnRenamed("src", "id") for lone in (True, False))
        deep = cut_lineage(merge(several).unionByName(alone))
        done = deep if done is None else done.unionByName(deep)
    return done


def _graded_counts(g: Graded) -> DataFrame:
    """(id, reachable, layer) on a graded graph: the nodes pointed to are counted, only what lies deeper is kept as sets of bits.

    A node with one edge that nothing points to needs no set: it reaches one node more than the one it points to.
    """
    kept = g._replace(steps=g.steps.filter("inner OR NOT lone"))
    beside = g.steps.groupBy(F.col("dst").alias("id")).agg(F.min("src").alias("beside"), F.max("lower").alias("layer"))
    own = _placed_bits(cut_lineage(beside))

    def direct(layer: int) -> DataFrame:
        inner = g.steps.filter((F.col("upper") == layer) & F.col("inner")).select("src", F.col("dst").alias("id"))
        return _or_words(inner.join(own, "id").select(F.col("src").alias("id"), "word", "bits"))

    sizes = kept.steps.groupBy(F.col("src").alias("id")).agg(F.count("*").alias("reachable"), F.max("upper").alias("layer"))
    deep = _fold_graded(kept, direct, lambda rows: rows, _or_words)
    if deep is not None:
        far = deep.groupBy("id").agg(F.sum(F.bit_count("bits")).alias("far"))
        sizes = sizes.join(far, "id", "left").select("id", (F.col("reachable") + F.coalesce("far", F.lit(0))).alias("reachable"), "layer")
    sizes = cut_lineage(sizes)
    lone = g.steps.filter("lone AND NOT inner").select(F.col("src"), F.col("dst").alias("id"), "upper")
    ends = lone.join(sizes, "id", "left").select(F.col("src").alias("id"), (F.coalesce("reachable", F.lit(0)) + 1).alias("reachable"), F.col("upper").alias("layer"))
    return sizes.unionByName(ends)


def strong_components(edges: DataFrame) -> DataFrame:
    """(id, root) of every node of a strongly connected component of several nodes; root is its smallest node.

    Each round takes the smallest node that reaches each node as its colour; the nodes of a colour that
    reach the colour's own node are that node's component. Only nodes on or between cycles enter the rounds.
    """
    left = cut_lineage(_between_cycles(edges.filter("src <> dst").select("src", "dst").distinct()))
    found = None
    while _any(left):
        ids = left.select(F.explode(F.array("src", "dst")).alias("id")).distinct()
        colour = _spread_least(cut_lineage(ids.select("id", F.col("id").alias("c"))), left)
        tinted = cut_lineage(left.join(colour.withColumnsRenamed({"id": "src", "c": "cs"}), "src").join(colour.withColumnsRenamed({"id": "dst", "c": "cd"}), "dst")
                             .filter("cs = cd").select("src", "dst", F.col("cs").alias("c")))
        part = colour.filter("id = c").select("id", F.col("c").alias("root"))
        members = part
        while True:
            back = tinted.join(part, (tinted["dst"] == part["id"]) & (tinted["c"] == part["root"])).select(tinted["src"].alias("id"), "root").distinct()
            part = cut_lineage(back.join(members, "id", "left_anti"))
            if not _any(part):
                break
            members = members.unionByName(part)
        members = cut_lineage(members)
        found = members if found is None else found.unionByName(members)
        for end in ("src", "dst"):
            left = left.join(members.select(F.col("id").alias(end)), end, "left_anti")
        left = cut_lineage(_between_cycles(left.select("src", "dst")))
    if found is None:
        return edges.select(F.col("src").alias("id"), F.col("src").alias("root")).filter("false")
    several = found.groupBy("root").agg(F.count("*").alias("n")).filter("n > 1").select("root")
    return cut_lineage(found.join(several, "root").select("id", "root"))


def _between_cycles(edges: DataFrame) -> DataFrame:
    """The edges left when nodes without incoming or without outgoing edges go, again and again."""
    left, n = cut_lineage(edges), None
    while n is None or 0 < left.count() < n:
        n = left.count()
        left = left.join(left.select(F.col("dst").alias("src")).distinct(), "src", "left_semi").join(left.select(F.col("src").alias("dst")).distinct(), "dst", "left_semi")
        left = cut_lineage(left.select("src", "dst"))
    return left


def _spread_least(labels: DataFrame, edges: DataFrame) -> DataFrame:
    """(id, c): the smallest label ``c`` of all nodes that reach a node, itself included. Only changed labels are sent on."""
    changed = labels
    while _any(changed):
        sent = changed.join(edges, changed["id"] == edges["src"]).groupBy(F.col("dst").alias("id")).agg(F.min("c").alias("new"))
        both = cut_lineage(labels.join(sent, "id", "left"))
        changed = cut_lineage(both.filter("new < c").select("id", F.col("new").alias("c")))
        labels = both.select("id", F.least("c", "new").alias("c"))
    return labels


def closure(edges: DataFrame, seeds: DataFrame | None = None) -> DataFrame:
    """(seed, id, depth): everything reachable from each seed and the first level it is met.

    A node on a cycle is in its own closure. Without seeds every source starts. On an acyclic graph without
    seeds a node's pairs are made from those of the nodes it points to, layer by layer. Otherwise only
    newly found pairs are extended, each level is written once and the rounds end when one finds nothing.
    """
    e = cut_lineage(edges.select("src", "dst").distinct())
    graded = _graded(e) if seeds is None else None
    if graded is not None:
        direct = lambda layer: graded.steps.filter(F.col("upper") == layer).select(F.col("src").alias("id"), F.col("dst").alias("met"), F.lit(1).alias("depth"))
        deep = _fold_graded(graded, direct, lambda rows: rows.withColumn("depth", F.col("depth") + 1), lambda rows: rows.groupBy("id", "met").agg(F.min("depth").alias("depth")))
        near = e.select(F.col("src").alias("seed"), F.col("dst").alias("id"), F.lit(1).alias("depth"))
        return near if deep is None else near.unionByName(deep.select(F.col("id").alias("seed"), F.col("met").alias("id"), "depth"))
    if seeds is None:
        layers = cut_lineage(_layers(_ends_of(e), e))
        if not _any(layers.filter("layer IS NULL")):
            own = layers.select("id", F.col("id").alias("met"), F.lit(0).alias("depth"))
            nearest = lambda rows, *by: rows.groupBy("id", "met", *by).agg(F.min("depth").alias("depth"))
            pairs = _fold_layers(layers, e, own, nearest, lambda rows: rows.withColumn("depth", F.col("depth") + 1))
            if pairs is not None:
                return pairs.select(F.col("id").alias("seed"), F.col("met").alias("id"), "depth")
    starts = e.select(F.col("src").alias("seed")).distinct() if seeds is None else seeds.select(F.col("id").alias("seed")).distinct()
    delta = cut_lineage(starts.join(e, F.col("seed") == F.col("src")).select("seed", F.col("dst").alias("id"), F.lit(1).alias("depth")))
    found = delta
    for level in itertools.count(2):
        step = delta.join(e, F.col("id") == F.col("src")).select("seed", F.col("dst").alias("id")).distinct()
        delta = cut_lineage(step.join(found, ["seed", "id"], "left_anti").withColumn("depth", F.lit(level)))
        if not _any(delta):
            break
        found = found.unionAll(delta)  # the tables of the levels, none is written again
    return found


def _ends_of(edges: DataFrame) -> DataFrame:
    return edges.select(F.explode(F.array("src", "dst")).alias("id")).distinct()


def _or_words(rows: DataFrame, *by: str) -> DataFrame:
    return rows.groupBy("id", "word", *by).agg(F.bit_or("bits").alias("bits"))


def _bit_places(layers: DataFrame, edges: DataFrame) -> DataFrame:
    """(id, word, bits): a bit of its own for every node. Nodes that one node points to stand side by side, so sets of them fill their words."""
    beside = edges.groupBy(F.col("dst").alias("id")).agg(F.min("src").alias("beside"))
    return _placed_bits(layers.join(beside, "id", "left"))


def _placed_bits(rows: DataFrame) -> DataFrame:
    """(id, word, bits) of rows (id, layer, beside)."""
    ordered = rows.repartitionByRange("layer", "beside", "id").sortWithinPartitions("layer", "beside", "id")
    place = ordered.select("id", F.monotonically_increasing_id().alias("place"))  # partition number, then row number
    return cut_lineage(place.select("id", F.shiftright("place", 6).alias("word"), F.expr("shiftleft(1L, CAST(place & 63 AS INT))").alias("bits")))


def reach_counts(edges: DataFrame) -> DataFrame:
    """(id, reachable): how many nodes each node with an outgoing edge reaches, without the table of pairs.

    Strongly connected components become one node each. On the acyclic graph that is left, sets of nodes are rows
    of 64 bits, merged by OR layer by layer and counted by their bits. A node on a cycle reaches itself.
    """
    return _counts(cut_lineage(edges.select("src", "dst").distinct()))


def _counts(e: DataFrame) -> DataFrame:
    """``reach_counts`` of a stored table of distinct edges."""
    graded = _graded(e)
    return _reach_counts(e) if graded is None else _graded_counts(graded).select("id", "reachable")


def _reach_counts(e: DataFrame) -> DataFrame:
    """``reach_counts`` of any stored table of distinct edges, graded or not."""
    nodes = cut_lineage(_ends_of(e))
    layers = cut_lineage(_layers(nodes, e))
    kind = e.schema["src"].dataType
    if _any(layers.filter("layer IS NULL")):
        roots = cut_lineage(strong_components(e).select("id", F.col("root").cast(kind).alias("root")))
        mapped = cut_lineage(nodes.join(roots, "id", "left").select("id", F.coalesce("root", "id").alias("node")))
        dag = e.join(mapped.withColumnsRenamed({"id": "src", "node": "s"}), "src").join(mapped.withColumnsRenamed({"id": "dst", "node": "d"}), "dst")
        cyclic = roots.select(F.col("root").alias("id")).union(e.filter("src = dst").select("src")).distinct()
        dag = cut_lineage(dag.filter("s <> d").select(F.col("s").alias("src"), F.col("d").alias("dst")).distinct())
        layers = cut_lineage(_layers(mapped.select(F.col("node").alias("id")).distinct(), dag))
    else:
        mapped, dag, cyclic = nodes.select("id", F.col("id").alias("node")), e, None
    places = _bit_places(cut_lineage(mapped.join(layers.withColumnRenamed("id", "node"), "node").select("id", "layer")), e)
    own = cut_lineage(_or_words(places.join(mapped, "id").select(F.col("node").alias("id"), "word", "bits")))
    reach = _fold_layers(layers, dag, own, _or_words, lambda rows: rows)
    if cyclic is not None:
        rings = own.join(cyclic, "id", "left_semi")
        reach = rings if reach is None else reach.unionByName(rings)
    if reach is None:
        return nodes.select("id", F.lit(0).cast("long").alias("reachable")).filter("false")
    sizes = reach.groupBy("id").agg(F.sum(F.bit_count("bits")).alias("reachable"))
    return mapped.join(sizes.withColumnRenamed("id", "node"), "node").select("id", "reachable")


def eccentricities(edges: DataFrame, limit: int | None = None) -> DataFrame:
    """(id, depth): the breadth-first depth of each node with an outgoing edge, at most ``limit``.

    If every edge goes down by one layer, all ways to a node are equally long and the depth is the layer.
    """
    e = cut_lineage(edges.select("src", "dst").distinct())
    graded = _graded(e)
    return _eccentricities(e, limit) if graded is None else _graded_depths(graded, limit)


def _graded_depths(g: Graded, limit: int | None = None) -> DataFrame:
    depth = F.col("layer") if limit is None else F.least("layer", F.lit(limit))
    return g.heights.select("id", depth.alias("depth"))


def _eccentricities(e: DataFrame, limit: int | None) -> DataFrame:
    """``eccentricities`` of any stored table of distinct edges.

    All nodes walk at once: a round hands the bits that are new at a node to those that point to it.
    """
    fresh = _bit_places(_ends_of(e).withColumn("layer", F.lit(0)), e)
    known, depth = None, None
    for level in itertools.count(1):
        step = _or_words(fresh.join(e, fresh["id"] == e["dst"]).select(e["src"].alias("id"), "word", "bits"))
        if known is not None:
            had = known.withColumnRenamed("bits", "had")
            step = step.join(had, ["id", "word"], "left").select("id", "word", F.expr("bits & ~coalesce(had, 0L)").alias("bits")).filter("bits <> 0")
        fresh = cut_lineage(step)
        if not _any(fresh):
            break
        here = fresh.select("id").distinct().withColumn("depth", F.lit(level))
        depth = here if depth is None else depth.unionByName(here)
        if limit is not None and level >= limit:
            break
        known = fresh if known is None else cut_lineage(_or_words(known.unionByName(fresh)))
    if depth is None:
        return e.select(F.col("src").alias("id"), F.lit(0).alias("depth")).filter("false")
    return depth.groupBy("id").agg(F.max("depth").alias("depth"))


def closure_sizes(edges: DataFrame, seeds: DataFrame | None = None, depth_limit: int | None = None) -> DataFrame:
    """(id, reachable, depth) of every seed that reaches something; without seeds of every node, from sets of bits."""
    if seeds is None:
        e = cut_lineage(edges.select("src", "dst").distinct())
        graded = _graded(e)
        if graded is None:
            return _reach_counts(e).join(_eccentricities(e, depth_limit), "id")
        depth = F.col("layer") if depth_limit is None else F.least("layer", F.lit(depth_limit))
        return _graded_counts(graded).select("id", "reachable", depth.alias("depth"))
    return closure(edges, seeds).groupBy(F.col("seed").alias("id")).agg(F.count("*").alias("reachable"), F.max("depth").alias("depth"))


def graph_depth(edges: DataFrame, seeds: DataFrame) -> DataFrame:
    """Breadth-first eccentricity per seed: the order-independent form of call depth."""
    e = cut_lineage(edges.select("src", "dst").distinct())
    graded = _graded(e)
    deep = closure_sizes(e, seeds).select("id", "depth") if graded is None else _graded_depths(graded)
    return seeds.select("id").distinct().join(deep, "id", "left").select("id", F.coalesce("depth", F.lit(0)).alias("depth"))


def find_cycles(edges: DataFrame, max_length: int = 4) -> DataFrame:
    """Simple cycles up to ``max_length`` edges, each once, starting at its smallest node.

    A cycle is a path from its start and a path back to it that meet half way. Paths are expanded to half
    the length only, and no path that does not close is ever handed on.
    """
    e = cut_lineage(edges.select("src", "dst").distinct())
    found = e.filter("src = dst").select(F.array("src").alias("cycle"))
    out = e.filter("src < dst").select(F.col("src").alias("start"), F.col("dst").alias("id"), F.array("src", "dst").alias("path"))
    back = e.filter("src > dst").select(F.col("dst").alias("start"), F.col("src").alias("id"), F.slice(F.array("src"), 1, 0).alias("rest"))
    for length in range(2, max_length + 1):
        if length > 2 and length % 2:
            step = out.join(e, (F.col("id") == F.col("src")) & (F.col("dst") > F.col("start"))).filter(~F.array_contains("path", F.col("dst")))
            out = cut_lineage(step.select("start", F.col("dst").alias("id"), F.concat("path", F.array("dst")).alias("path")))
        elif length > 2:
            step = back.join(e, (F.col("id") == F.col("dst")) & (F.col("src") > F.col("start"))).filter((F.col("src") != F.col("id")) & ~F.array_contains("rest", F.col("src")))
            back = cut_lineage(step.select("start", F.col("src").alias("id"), F.concat(F.array("id"), "rest").alias("rest")))
        met = out.join(back, ["start", "id"]).filter(~F.arrays_overlap("path", "rest"))
        found = found.unionAll(met.select(F.concat("path", "rest").alias("cycle")))
    return found


# Layers ---------------------------------------------------------------------

def topological_layers(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """layer = 1 + highest layer of a node's dependencies; nodes on or above a cycle, or above an unknown node, get NULL."""
    return _layers(nodes.select("id"), cut_lineage(edges.select("src", "dst")))


def _layers(ids: DataFrame, left: DataFrame) -> DataFrame:
    """``topological_layers`` of a stored edge table."""
    unknown = cut_lineage(left.select(F.col("dst").alias("id")).distinct().join(ids, "id", "left_anti"))
    if _any(unknown):  # never free, as if it pointed to itself
        left = cut_lineage(left.unionByName(unknown.select(F.col("id").alias("src"), F.col("id").alias("dst"))))
    heights, stuck = _heights(left)
    out = ids.join(heights, "id", "left").select("id", F.coalesce("layer", F.lit(0)).alias("layer"))
    if stuck is None:
        return out
    marked = out.join(stuck.withColumn("_stuck", F.lit(True)), "id", "left")
    return marked.select("id", F.when(F.col("_stuck").isNull(), F.col("layer")).alias("layer"))


def _heights(edges: DataFrame) -> tuple[DataFrame, DataFrame | None]:
    """(id, layer) of every node of a stored edge table that points to another, and those on or above a cycle (None: there are none).

    Rounds walk only the edges of nodes that are pointed to; one pass over all edges places the others above them.
    """
    pointed = edges.select(F.col("dst").alias("src")).distinct()
    inner, stuck = _walks(cut_lineage(edges.join(pointed, "src", "left_semi").select("src", "dst")))
    low = cut_lineage(inner).select(F.col("id").alias("dst"), "layer")
    heights = edges.join(low, "dst", "left").groupBy(F.col("src").alias("id")).agg((F.coalesce(F.max("layer"), F.lit(0)) + 1).alias("layer"))
    if stuck is None:
        return heights, None
    above = edges.join(stuck.withColumnRenamed("id", "dst"), "dst", "left_semi").select(F.col("src").alias("id"))
    return heights, cut_lineage(above.unionByName(stuck).distinct())


def _walks(edges: DataFrame) -> tuple[DataFrame, DataFrame | None]:
    """``_heights`` in rounds.

    Round k keeps the nodes from which a walk of k edges starts. A node's layer is the last round that has it;
    rounds that no longer lose a node have those that never end. The edges are written again when half the nodes have gone.
    """
    left, rounds, before, written = edges, [], None, None
    while True:
        above = cut_lineage(left.select(F.col("src").alias("id")).distinct())
        n = above.count()
        if n == 0 or n == before:
            break
        rounds.append(above.withColumn("layer", F.lit(len(rounds) + 1)))
        left = edges.join(above.withColumnRenamed("id", "dst"), "dst", "left_semi")
        if written is None:
            written = n
        elif n <= written / 2:
            edges, written = cut_lineage(left.select("src", "dst")), n
            left = edges
        before = n
    if not rounds:
        return edges.select(F.col("src").alias("id"), F.lit(0).alias("layer")).filter("false"), None
    heights = reduce(DataFrame.unionByName, rounds).groupBy("id").agg(F.max("layer").alias("layer"))
    return heights, above if n else None


def longest_path(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(step, id) of a longest dependency path; empty when the graph has a cycle.

    Layers give the length; the path walks down one layer per step, smallest id first.
    """
    e = cut_lineage(edges.filter("src <> dst").select("src", "dst").distinct())
    layers = cut_lineage(_layers(nodes.select("id"), e))
    if _any(layers.filter("layer IS NULL")):
        return layers.select(F.col("layer").alias("step"), "id").filter("false")
    top = layers.agg(F.max(F.struct("layer", "id"))["layer"].alias("m")).first()["m"] or 0
    current = layers.filter(F.col("layer") == top).agg(F.min("id").alias("id"))
    walk = current.select(F.lit(0).alias("step"), "id")
    for layer in range(top - 1, -1, -1):
        below = current.join(e, F.col("id") == F.col("src")).select(F.col("dst").alias("id"))
        current = cut_lineage(below.join(layers.filter(F.col("layer") == layer), "id").agg(F.min("id").alias("id")))
        walk = walk.unionAll(current.select(F.lit(top - layer).alias("step"), "id"))
    return walk


def density(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    n = nodes.agg(F.count("*").alias("n")).withColumn("_one", F.lit(1))
    m = edges.agg(F.count("*").alias("m")).withColumn("_one", F.lit(1))
    value = F.when(F.col("n") > 1, F.col("m") / (F.col("n") * (F.col("n") - 1))).otherwise(0.0)
    return n.join(m, "_one").select("n", "m", value.alias("density"))


def key_hubs(edges: DataFrame, k: int = 5) -> DataFrame:
    return edges.groupBy(F.col("dst").alias("id")).agg(F.count("*").alias("in_degree")).orderBy(F.desc("in_degree"), "id").limit(k)


# Node reports ---------------------------------------------------------------

def impact_scores(edges: DataFrame, seeds: DataFrame | None = None, critical: float = 5.0) -> DataFrame:
    """Direct dependents plus half of all transitive dependents.

    Layers are found from the side of the edges, where rounds walk only the nodes that are pointed to, and turned over afterwards.
    """
    e = cut_lineage(edges.select("src", "dst").distinct())
    direct = e.groupBy(F.col("dst").alias("id")).agg(F.count("*").alias("direct"))
    if seeds is not None:
        total = closure_sizes(reverse(e), seeds)
    else:
        graded = _graded(e)
        total = _reach_counts(cut_lineage(reverse(e))) if graded is None else _graded_counts(graded.reversed())
    total = total.select("id", F.col("reachable").alias("transitive"))
    joined = total.join(direct, "id")
    score = F.col("direct") + F.col("transitive") * 0.5
    return joined.select("id", "direct", "transitive", score.alias("impact"), (score >= critical).alias("critical"))


def node_profile(nodes: DataFrame, edges: DataFrame, as_of_year: int | None = None, with_rank: bool = False) -> DataFrame:
    """Degrees, closure sizes, depth, impact, external calls and influence per node, on request its rank.

    What a node reaches, what reaches it and its depth are counted over sets of bits; no table of pairs is made.
    """
    e = cut_lineage(edges.select("src", "dst").distinct())
    named = nodes.select("id", "file", *(["year"] if "year" in nodes.columns else []))
    deg = degrees(e)
    graded = _graded(e)
    if graded is None:
        down, up, depth = _reach_counts(e), _reach_counts(cut_lineage(reverse(e))), _eccentricities(e, None)
    else:
        down, up, depth = _graded_counts(graded).drop("layer"), _graded_counts(graded.reversed()).drop("layer"), _graded_depths(graded)
    down, up = down.withColumnRenamed("reachable", "dependencies"), up.withColumnRenamed("reachable", "dependents")
    files = nodes.select("id", "file")
    ext = e.join(files.withColumnsRenamed({"id": "src", "file": "f1"}), "src").join(
        files.withColumnsRenamed({"id": "dst", "file": "f2"}), "dst").filter("f2 <> '' AND f1 <> f2").groupBy(
        F.col("src").alias("id")).agg(F.count("*").alias("external_calls"))
    out = named
    for part in (deg, down, depth, up, ext, *([pagerank(nodes, e)] if with_rank else [])):
        out = out.join(part, "id", "left")
    out = out.fillna(0, ["in_degree", "out_degree", "dependencies", "depth", "dependents", "external_calls"])
    out = out.withColumn("impact", F.col("in_degree") + F.col("dependents") * 0.5)
    if as_of_year is not None:
        out = out.withColumn("influence", S.influence_score(F.col("in_degree"), F.col("out_degree"), F.col("year"), as_of_year))
    return out


def compare_nodes(nodes: DataFrame, edges: DataFrame, a, b, max_depth: int = 5) -> DataFrame:
    """Degrees of two nodes, their common neighbours and the path between them, as one row."""
    from .joins import common_neighbours

    one = F.lit(1).alias("_one")
    refs = common_neighbours(edges, a, b).agg(F.count("*").alias("common_references")).select("common_references", one)
    cits = common_neighbours(edges, a, b, "citations").agg(F.count("*").alias("common_citations")).select("common_citations", one)
    path = shortest_path(edges, a, b, max_depth).agg(F.coalesce(F.max("length"), F.lit(-1)).alias("path_length")).select("path_length", one)
    deg = degrees(edges.filter(F.col("src").isin(a, b) | F.col("dst").isin(a, b)))
    pick = lambda c, node: F.coalesce(F.max(F.when(F.col("id") == node, F.col(c))), F.lit(0))
    pair = deg.agg(
        pick("in_degree", a).alias("a_citations"), pick("out_degree", a).alias("a_references"),
        pick("in_degree", b).alias("b_citations"), pick("out_degree", b).alias("b_references")).withColumn("_one", F.lit(1))
    return pair.join(refs, "_one").join(cits, "_one").join(path, "_one").drop("_one")


def refactor_flags(profile: DataFrame, cycles: DataFrame | None = None) -> DataFrame:
    """Threshold rules on degree, closure, depth and cycle membership."""
    calls, called, deps, depth = (F.col(c) for c in ("out_degree", "in_degree", "dependencies", "depth"))
    tests = [
        F.when(calls > 15, "calls_many"), F.when(called > 10, "wide_impact"), F.when(deps > 30, "many_transitive_callees"),
        F.when(depth > 10, "deep_call_chain"), F.when(calls > 10, "split_module"), F.when(deps > 20, "many_transitive_dependencies"),
        F.when(calls > 5, "extract_logic"), F.when(depth > 5, "break_up_function"), F.when(deps > 10, "split_focused_modules")]
    out = profile
    if cycles is not None:
        members = cycles.select(F.explode("cycle").alias("id")).distinct().withColumn("_cyclic", F.lit(True))
        out = out.join(members, "id", "left")
        tests.append(F.when(F.col("_cyclic"), "circular_dependency"))
    return out.select("id", F.explode(F.array_compact(F.array(*tests))).alias("flag"))
