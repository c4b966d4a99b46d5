"""Bounded reachability for many roots at once, strongly connected components, simple cycles, layers."""

from __future__ import annotations

from collections.abc import Iterable
from itertools import count

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.operators.store import one_of
from graphloom.runtime import cut
from graphloom.schema import GATE_EDGES

#: Simple cycles longer than this are reported by their component's members only.
MAX_CYCLE = 16
CYCLE_LIMIT = 1000


def gate_edges(edges: DataFrame, types: Iterable[str] | None = None) -> DataFrame:
    """The only edges a block may rest on: extracted ones of the structural types, narrowed by `types`, never widened."""
    wanted = GATE_EDGES if types is None else [t for t in types if t in GATE_EDGES]
    return edges.filter(one_of("type", wanted) & (F.col("confidence") == "EXTRACTED"))


def known_types(names: Iterable[str] | None) -> list[str] | None:
    """Edge types of a caller's list: unknown names are dropped, a list of only those means no edge at all."""
    from graphloom.schema import EDGE_TYPES

    return None if names is None else [n for n in names if n in EDGE_TYPES]


def reachable(edges: DataFrame, roots: DataFrame, depth: int, forward: bool = True) -> DataFrame:
    """root, node, distance (1..depth) of every node within reach of each root, roots excluded.

    Level by level for all roots together: the frontier meets the edges once a level and is checked against what was
    seen; each level is checkpointed, so lineage stays short and a lost executor costs one level. The edges, which every
    level reads, are cut once beforehand, so that the store behind them is not built again. Depth below 1 gives no rows;
    the loop ends early when nothing new is found.
    """
    a, b = ("src", "dst") if forward else ("dst", "src")
    steps = edges.select(F.col(a).alias("at"), F.col(b).alias("next")).distinct()
    start = roots.select(F.col("id").alias("root")).distinct().withColumn("node", F.col("root")).withColumn("distance", F.lit(0))
    if depth > 1:
        steps, start = cut(steps), cut(start)
    seen = frontier = start
    for level in range(1, depth + 1):
        found = frontier.join(steps, F.col("node") == F.col("at")).select("root", F.col("next").alias("node")).distinct()
        new = cut(found.join(seen.select("root", "node"), ["root", "node"], "left_anti").withColumn("distance", F.lit(level)))
        if new.isEmpty():
            break
        seen, frontier = seen.unionByName(new), new
    return seen.filter("distance > 0")


def edges_walked(edges: DataFrame, roots: DataFrame, depth: int, forward: bool = True) -> DataFrame:
    """root, n_edges: how many edges (parallel ones once) a search of that depth looks at: those that leave what it visits."""
    a, b = ("src", "dst") if forward else ("dst", "src")
    degree = edges.select(F.col(a).alias("node"), b).distinct().groupBy("node").agg(F.count("*").alias("n"))
    start = roots.select(F.col("id").alias("root")).distinct()
    visited = start.withColumn("node", F.col("root"))
    if depth > 1:
        visited = visited.unionByName(reachable(edges, roots, depth - 1, forward).select("root", "node"))
    met = visited.join(degree, "node").groupBy("root").agg(F.sum("n").alias("n_edges"))
    return start.join(met, "root", "left").fillna(0, ["n_edges"]) if depth > 0 else start.withColumn("n_edges", F.lit(0).cast("bigint"))


def components(edges: DataFrame, rounds: int | None = None) -> DataFrame:
    """node, component (its smallest node) of every strongly connected component with more than one node.

    Nodes without an in- or out-edge are trimmed first. Then colours: each node takes the greatest node that reaches
    it; within a colour, whatever reaches its root backwards is one component, which is taken out; and so on until no edge
    is left. A round takes out at least one component; if edges are left after so many `rounds`, that is an error.
    """
    left = cut(edges.select("src", "dst").filter("src != dst").distinct())
    done = None
    for k in count():
        while True:  # trim
            n = left.count()
            left = cut(left.join(left.select(F.col("dst").alias("src")).distinct(), "src", "left_semi").join(left.select(F.col("src").alias("dst")).distinct(), "dst", "left_semi"))
            if left.count() == n:
                break
        if not n:
            break
        if rounds is not None and k >= rounds:
            raise RuntimeError(f"components: edges are left after {rounds} rounds")
        colour = left.select(F.col("src").alias("node")).union(left.select("dst")).distinct().withColumn("colour", F.col("node"))
        while True:  # the greatest node that reaches each
            pushed = left.join(colour.withColumnRenamed("node", "src"), "src").select(F.col("dst").alias("node"), "colour")
            new = cut(colour.unionByName(pushed).groupBy("node").agg(F.max("colour").alias("colour")))
            moved = new.join(colour.withColumnRenamed("colour", "old"), "node").filter("colour != old").limit(1).count()
            colour = new
            if not moved:
                break
        inside = cut(left.join(colour.withColumnRenamed("node", "src").withColumnRenamed("colour", "cs"), "src").join(colour.withColumnRenamed("node", "dst").withColumnRenamed("colour", "cd"), "dst").filter("cs = cd").select("src", "dst", F.col("cs").alias("colour")))
        members = frontier = colour.filter("node = colour").select("node", "colour")
        while True:  # backwards from each colour's root
            found = frontier.join(inside.withColumnRenamed("dst", "node").withColumnRenamed("colour", "c2"), "node").select(F.col("src").alias("node"), F.col("c2").alias("colour")).distinct()
            frontier = cut(found.join(members, ["node", "colour"], "left_anti"))
            if frontier.isEmpty():
                break
            members = cut(members.unionByName(frontier))
        done = members if done is None else done.unionByName(members)
        taken = members.select("node")
        left = cut(left.join(taken.withColumnRenamed("node", "src"), "src", "left_anti").join(taken.withColumnRenamed("node", "dst"), "dst", "left_anti"))
    if done is None:
        return left.select(F.col("src").alias("node"), F.col("dst").alias("component")).limit(0)
    named = done.groupBy("colour").agg(F.min("node").alias("component"), F.count("*").alias("n"))
    return cut(done.join(named.filter("n > 1"), "colour").select("node", "component"))


def simple_cycles(edges: DataFrame, max_length: int = MAX_CYCLE, limit: int = CYCLE_LIMIT) -> DataFrame:
    """cycle (array of nodes from the smallest on): the `limit` smallest cycles in order.

    This limit is the report's feature; whether it cut anything off, truncated_cycles tells.
    """
    return all_cycles(edges, max_length).orderBy("cycle").limit(limit)


def truncated_cycles(edges: DataFrame, max_length: int = MAX_CYCLE, limit: int = CYCLE_LIMIT) -> DataFrame:
    """cycle, truncated: the rows of simple_cycles, each telling whether the limit cut off others."""
    found = cut(all_cycles(edges, max_length).orderBy("cycle").limit(limit + 1))
    return found.orderBy("cycle").limit(limit).withColumn("truncated", F.lit(found.count() > limit))


#: Open paths that one level of the search for cycles may hold. A dense component has exponentially many.
MOST_PATHS = 50_000_000


def all_cycles(edges: DataFrame, max_length: int | None = MAX_CYCLE, touching: DataFrame | None = None, most_paths: int = MOST_PATHS) -> DataFrame:
    """cycle: every simple cycle up to max_length (None: of any length) within a component.

    A path starts at its smallest node and only visits greater ones, so each cycle appears once and already rotated. A
    component with longer cycles only is reported as its sorted members. With `touching` (src, dst) only the components
    that hold both ends of one of its edges are searched. More open paths than most_paths are an error, not a loss.
    """
    scc = components(edges)
    if touching is not None:
        ends = touching.join(scc.select(F.col("node").alias("src"), "component"), "src").join(scc.select(F.col("node").alias("dst"), F.col("component").alias("c2")), "dst")
        scc = scc.join(ends.filter("component = c2").select("component").distinct(), "component", "left_semi")
    a, b = scc.select(F.col("node").alias("src"), "component"), scc.select(F.col("node").alias("dst"), F.col("component").alias("c2"))
    inside = cut(edges.select("src", "dst").filter("src != dst").distinct().join(a, "src").join(b, "dst").filter("component = c2").select("src", "dst", "component"))
    paths = inside.filter("dst > src").select("component", F.array("src", "dst").alias("path"), F.col("src").alias("first"), F.col("dst").alias("last"))
    found = None
    for _ in count(2) if max_length is None else range(2, max_length + 1):
        closed = paths.join(inside.select(F.col("src").alias("last"), F.col("dst").alias("first")), ["last", "first"], "left_semi").select("component", F.col("path").alias("cycle"))
        found = closed if found is None else found.unionByName(closed)
        grown = paths.join(inside.select(F.col("src").alias("last"), F.col("dst").alias("next")), "last").filter((F.col("next") > F.col("first")) & ~F.array_contains("path", F.col("next")))
        paths = cut(grown.select("component", F.concat("path", F.array("next")).alias("path"), "first", F.col("next").alias("last")))
        n = paths.count()
        if n > most_paths:
            raise RuntimeError(f"cycles: {n} open paths in a dense component")
        if not n:
            break
    whole = scc.join(found.select("component").distinct(), "component", "left_anti").groupBy("component").agg(F.array_sort(F.collect_set("node")).alias("cycle"))
    return found.select("cycle").unionByName(whole.select("cycle"))


def layers(edges: DataFrame, nodes: DataFrame, rounds: int | None = None) -> DataFrame:
    """node, layer: nothing depends on layer 0, every edge goes to a higher layer; a component's nodes share one.

    Longest paths over the condensation: a node's layer is one above the highest that points to it. Layers beyond so many
    `rounds` are an error.
    """
    scc = components(edges)
    ids = nodes.select(F.col("id").alias("node")).distinct().join(scc, "node", "left").withColumn("component", F.coalesce("component", "node"))
    ids = cut(ids)
    s, d = ids.select(F.col("node").alias("src"), F.col("component").alias("a")), ids.select(F.col("node").alias("dst"), F.col("component").alias("b"))
    dag = cut(edges.select("src", "dst").distinct().join(s, "src").join(d, "dst").filter("a != b").select("a", "b").distinct())
    level = ids.select(F.col("component").alias("a")).distinct().withColumn("layer", F.lit(0))
    active = level
    for k in count(1):
        active = cut(active.select("a").join(dag, "a").select(F.col("b").alias("a")).distinct())
        if active.isEmpty():
            break
        if rounds is not None and k > rounds:
            raise RuntimeError(f"layers: nodes are left after {rounds} rounds")
        level = cut(level.join(active.withColumn("k", F.lit(k)), "a", "left").select("a", F.coalesce("k", "layer").alias("layer")))
    return ids.join(level.withColumnRenamed("a", "component"), "component").select("node", "layer")
