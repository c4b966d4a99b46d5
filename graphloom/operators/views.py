"""Views of the graph: files, families, degrees, rings, communities, deltas of snapshots, call sites."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from graphloom.functions.paths import family_of, subpackage
from graphloom.operators.store import GraphStore
from graphloom.operators.traverse import gate_edges
from graphloom.runtime import cut
from graphloom.schema import EXTERNALS_UNIT, FILE_GRAPH_EDGES


def _place(nodes: DataFrame) -> DataFrame:
    return nodes.select("id", F.concat_ws("/", "repo_id", "unit").alias("place"), "unit")


def _between(store: GraphStore, edges: DataFrame, what: DataFrame, *names: str) -> DataFrame:
    """Edges with columns of their two ends, prefixed src_ and dst_."""
    s = what.select(F.col("id").alias("src"), *[F.col(c).alias(f"src_{c}") for c in names])
    d = what.select(F.col("id").alias("dst"), *[F.col(c).alias(f"dst_{c}") for c in names])
    return edges.join(s, "src").join(d, "dst")


def file_graph(store: GraphStore) -> DataFrame:
    """src, dst, weight: edges of four types between units, externals left out."""
    e = store.edges.filter(F.col("type").isin(*FILE_GRAPH_EDGES))
    met = _between(store, e, _place(store.nodes), "place", "unit").filter((F.col("src_place") != F.col("dst_place")) & (F.col("dst_unit") != EXTERNALS_UNIT))
    return met.groupBy(F.col("src_place").alias("src"), F.col("dst_place").alias("dst")).agg(F.count("*").alias("weight"))


def unit_edges(store: GraphStore) -> DataFrame:
    return file_graph(store).select("src", "dst")


def unit_nodes(store: GraphStore) -> DataFrame:
    return _place(store.nodes.filter(F.col("unit") != EXTERNALS_UNIT)).select(F.col("place").alias("id")).distinct()


def family_matrix(store: GraphStore) -> DataFrame:
    """src_family, dst_family, type, n_edges, without definitions and edges within a family."""
    f = store.nodes.select("id", family_of(F.col("unit")).alias("family"))
    met = _between(store, store.edges.filter("type != 'defines'"), f, "family").filter("src_family != dst_family")
    return met.groupBy("src_family", "dst_family", "type").agg(F.count("*").alias("n_edges"))


def family_cube(store: GraphStore) -> DataFrame:
    """The family matrix with all its subtotals."""
    m = family_matrix(store)
    return m.cube("src_family", "dst_family", "type").agg(F.sum("n_edges").alias("n_edges"), F.grouping_id().alias("level"))


def subpackage_matrix(store: GraphStore) -> DataFrame:
    f = store.nodes.select("id", family_of(F.col("unit")).alias("family"), subpackage(F.col("unit")).alias("sub"))
    met = _between(store, store.edges.filter("type != 'defines'"), f, "family", "sub").filter("src_family = dst_family AND src_sub != dst_sub")
    return met.groupBy(F.col("src_family").alias("family"), "src_sub", "dst_sub").agg(F.count("*").alias("n_edges"))


def degrees(store: GraphStore) -> DataFrame:
    """id, degree (in and out; a loop counts twice) of every node."""
    ends = store.edges.select(F.col("src").alias("id")).union(store.edges.select("dst"))
    return store.nodes.select("id").join(ends.groupBy("id").agg(F.count("*").alias("degree")), "id", "left").fillna(0, ["degree"])


def top_nodes(store: GraphStore, k: int) -> DataFrame:
    """The k nodes of the highest degree, ties by name and id."""
    return degrees(store).join(store.nodes.select("id", "qualified_name"), "id").orderBy(F.desc("degree"), "qualified_name", "id").limit(k).select("id", "qualified_name", "degree")


def heaviest_edges(store: GraphStore, k: int) -> DataFrame:
    return file_graph(store).orderBy(F.desc("weight"), "src", "dst").limit(k)


def multiplicity(store: GraphStore) -> DataFrame:
    return store.edges.groupBy("src", "dst", "type").agg(F.count("*").alias("n_edges"))


def unit_weight(store: GraphStore) -> DataFrame:
    """Per unit: nodes plus their degrees."""
    return degrees(store).join(store.nodes.select("id", "repo_id", "unit"), "id").groupBy("repo_id", "unit").agg((F.count("*") + F.sum("degree")).alias("weight"))


def language_counts(store: GraphStore) -> DataFrame:
    return store.nodes.filter("kind = 'symbol'").groupBy("repo_id", "language").agg(F.count("*").alias("n_symbols"))


def ring_positions(store: GraphStore) -> DataFrame:
    """Place of each node on its unit's ring: top-level nodes first, then by name."""
    w = Window.partitionBy("repo_id", "unit")
    return store.nodes.select("id", "repo_id", "unit", (F.row_number().over(w.orderBy(~F.col("is_top_level"), "qualified_name", "id")) - 1).alias("position"), F.count("*").over(w).alias("n"))


def ring_layout(store: GraphStore, radius: float = 12.0) -> DataFrame:
    """x and y of each node on a ring whose radius grows with the logarithm of the unit's size."""
    angle = 2 * math.pi * F.col("position") / F.col("n")
    r = F.lit(radius) * F.log2(F.col("n") + 1)
    return ring_positions(store).select("id", "repo_id", "unit", (r * F.cos(angle)).alias("x"), (r * F.sin(angle)).alias("y"))


def spiral_layout(nodes: DataFrame, spacing: float = 8.0) -> DataFrame:
    """Units of a repository on a golden-angle spiral, the greatest in the middle."""
    k = F.row_number().over(Window.partitionBy("repo_id").orderBy(F.desc("weight"), "unit")) - 1
    golden = math.pi * (3 - math.sqrt(5))
    return nodes.withColumn("k", k).select("repo_id", "unit", (F.sqrt("k") * spacing * F.cos(F.col("k") * golden)).alias("x"), (F.sqrt("k") * spacing * F.sin(F.col("k") * golden)).alias("y"))


def sphere_layout(nodes: DataFrame, radius: float = 100.0) -> DataFrame:
    """Units of a repository evenly on a sphere."""
    w = Window.partitionBy("repo_id")
    k, n = F.row_number().over(w.orderBy("unit")) - 1, F.count("*").over(w)
    golden = math.pi * (3 - math.sqrt(5))
    out = nodes.withColumn("k", k).withColumn("z", 1 - 2 * (k + 0.5) / n)
    flat = F.sqrt(1 - F.col("z") * F.col("z"))
    return out.select("repo_id", "unit", (radius * flat * F.cos(F.col("k") * golden)).alias("x"), (radius * flat * F.sin(F.col("k") * golden)).alias("y"), (radius * F.col("z")).alias("z"))


def label_centroids(store: GraphStore) -> DataFrame:
    """Label of each unit: over the middle of its nodes, above the highest."""
    return ring_layout(store).groupBy("repo_id", "unit").agg(F.round(F.avg("x"), 6).alias("x"), F.round(F.min("y"), 6).alias("y"))


def communities(store: GraphStore, rounds: int = 10) -> DataFrame:
    """node, community, rank: weighted label propagation over the file graph, made deterministic.

    Even and odd rounds move the nodes of one hash parity only, so neighbours never swap labels for ever; a node takes
    the label of the greatest weight around it, ties the smallest. Ranks order the communities by size, then label.
    """
    g = file_graph(store)
    both = cut(g.unionByName(g.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "weight")).groupBy("src", "dst").agg(F.sum("weight").alias("weight")))
    labels = both.select(F.col("src").alias("node")).distinct().withColumn("community", F.col("node"))
    for k in range(rounds):
        votes = both.join(labels.withColumnRenamed("node", "dst"), "dst").groupBy(F.col("src").alias("node"), "community").agg(F.sum("weight").alias("w"))
        best = votes.groupBy("node").agg(F.min(F.struct((-F.col("w")).alias("w"), "community")).alias("b")).select("node", F.col("b.community").alias("new"))
        moves = F.pmod(F.xxhash64("node"), F.lit(2)) == k % 2
        labels = cut(labels.join(best, "node").select("node", F.when(moves, F.col("new")).otherwise(F.col("community")).alias("community")))
    sizes = labels.groupBy("community").agg(F.count("*").alias("n"))
    # one row a community: the ranking sees labels, not nodes
    ranks = sizes.select("community", "n", F.row_number().over(Window.orderBy(F.desc("n"), "community")).alias("rank"))
    return labels.join(ranks, "community").select("node", "community", "rank")


def snapshot_delta(units: DataFrame, old: int, new: int) -> DataFrame:
    """Units added, deleted or modified from one snapshot to another; a null hash equals only null."""
    key = ["repo_id", "unit"]
    a = units.filter(F.col("snapshot_id") == old).select(*key, F.col("content_hash").alias("was"), F.lit(True).alias("had")).distinct()
    b = units.filter(F.col("snapshot_id") == new).select(*key, F.col("content_hash").alias("now"), F.lit(True).alias("has")).distinct()
    change = F.when(F.col("had").isNull(), "added").when(F.col("has").isNull(), "deleted").when(~F.col("was").eqNullSafe(F.col("now")), "modified")
    return a.join(b, key, "full_outer").withColumn("change", change).filter("change IS NOT NULL").select(*key, "change")


def call_sites(store: GraphStore) -> DataFrame:
    """Each place of a call with the number of what it may call."""
    e = gate_edges(store.edges, ("calls",)).filter("source_location IS NOT NULL")
    return e.groupBy("src", F.col("source_location.path").alias("path"), F.col("source_location.line").alias("line")).agg(F.count_distinct("dst").alias("n_callees"))


def sites_in_spans(store: GraphStore) -> DataFrame:
    """The innermost symbol around each site of an edge: the smallest span, ties the smallest id."""
    from graphloom.operators.store import LINE_SLICE

    sites = store.edges.filter("source_location IS NOT NULL").join(store.nodes.select(F.col("id").alias("src"), "repo_id"), "src").select("repo_id", F.col("source_location.path").alias("path"), F.col("source_location.line").alias("line")).distinct()
    spans = store.nodes.filter("kind = 'symbol' AND location.end_line >= location.start_line").select("repo_id", F.col("location.path").alias("path"), "id", F.col("location.start_line").alias("lo"), F.col("location.end_line").alias("hi"))
    sliced = spans.withColumn("slice", F.explode(F.sequence(F.floor(F.col("lo") / LINE_SLICE), F.floor(F.col("hi") / LINE_SLICE))))
    met = sites.withColumn("slice", F.floor(F.col("line") / LINE_SLICE)).join(sliced, ["repo_id", "path", "slice"]).filter("line BETWEEN lo AND hi")
    return met.groupBy("repo_id", "path", "line").agg(F.min(F.struct((F.col("hi") - F.col("lo")).alias("n"), "id")).alias("m")).select("repo_id", "path", "line", "m.id")


# ---------------------------------------------------------------- neighbours, names and layouts of views


def adjacency(store: GraphStore) -> DataFrame:
    """id, other: every undirected neighbour of a node once, loops left out: the rows of its adjacency list."""
    e = store.edges.filter("src != dst").select("src", "dst")
    return e.unionByName(e.select(F.col("dst").alias("src"), F.col("src").alias("dst"))).select(F.col("src").alias("id"), F.col("dst").alias("other")).distinct()


def dominant_subpackages(members: DataFrame) -> DataFrame:
    """community, dominant, n_files: the commonest directory of each community's units (community, unit), ties the smallest."""
    each = members.select("community", "unit", subpackage(F.col("unit")).alias("sub")).distinct()
    counts = each.groupBy("community", "sub").agg(F.count("*").alias("n"))
    best = counts.groupBy("community").agg(F.min(F.struct((-F.col("n")).alias("n"), "sub")).alias("b"), F.sum("n").alias("n_files"))
    return best.select("community", F.col("b.sub").alias("dominant"), "n_files")


# The form of a label.
def community_labels(members: DataFrame) -> DataFrame:
    """community, label: its dominant directory and size; of equal labels each gets its number, in the order of communities."""
    d = dominant_subpackages(members)
    base = F.concat(F.col("dominant"), F.lit(" · "), F.col("n_files").cast("string"), F.when(F.col("n_files") == 1, " file").otherwise(" files"))
    w = Window.partitionBy("base")
    numbered = d.withColumn("base", base).withColumn("k", F.row_number().over(w.orderBy("community"))).withColumn("n", F.count("*").over(w))
    return numbered.select("community", F.when(F.col("n") > 1, F.concat("base", F.lit(" (#"), F.col("k").cast("string"), F.lit(")"))).otherwise(F.col("base")).alias("label"))


def block_layout(units: DataFrame, gap: float = 1.0) -> DataFrame:
    """Units (repo_id, unit, weight) as squares in rows of about the square root of their number, the greatest first."""
    w = Window.partitionBy("repo_id")
    k, n = F.row_number().over(w.orderBy(F.desc("weight"), "unit")) - 1, F.count("*").over(w)
    placed = units.withColumn("k", k).withColumn("columns", F.ceil(F.sqrt(n)))
    return placed.select("repo_id", "unit", (F.pmod("k", "columns") * gap).cast("double").alias("x"), (F.floor(F.col("k") / F.col("columns")) * gap).cast("double").alias("y"))


def layer_layout(units: DataFrame, gap: float = 1.0) -> DataFrame:
    """Units (repo_id, unit, layer) in one row a layer, centred, by name."""
    w = Window.partitionBy("repo_id", "layer")
    k, n = F.row_number().over(w.orderBy("unit")) - 1, F.count("*").over(w)
    return units.select("repo_id", "unit", ((k - (n - 1) / 2) * gap).alias("x"), (F.col("layer") * gap).cast("double").alias("y"))


def orbit_layout(units: DataFrame, gap: float = 10.0) -> DataFrame:
    """Units (repo_id, unit, family) on one circle a family, families in the order of their names from the middle out."""
    ring = F.dense_rank().over(Window.partitionBy("repo_id").orderBy("family"))
    w = Window.partitionBy("repo_id", "family")
    angle = 2 * math.pi * (F.row_number().over(w.orderBy("unit")) - 1) / F.count("*").over(w)
    out = units.withColumn("r", ring * gap).withColumn("angle", angle)
    return out.select("repo_id", "unit", (F.col("r") * F.cos("angle")).alias("x"), (F.col("r") * F.sin("angle")).alias("y"))


def compute_layout(store: GraphStore) -> DataFrame:
    """view, repo_id, unit, x, y, z of every unit in each of seven views: block, layer, orbit, galaxy, globe, family, ring."""
    from graphloom.operators.traverse import layers

    weights = unit_weight(store).filter(F.col("unit") != EXTERNALS_UNIT)
    weights = cut(weights)
    depth = layers(unit_edges(store), unit_nodes(store))
    placed = weights.withColumn("node", F.concat_ws("/", "repo_id", "unit")).join(depth, "node", "left").fillna(0, ["layer"])
    families = weights.withColumn("family", family_of(F.col("unit")))
    middle = ring_layout(store).filter(F.col("unit") != EXTERNALS_UNIT).groupBy("repo_id", "unit").agg(F.avg("x").alias("x"), F.avg("y").alias("y"))
    views = {
        "block": block_layout(weights), "layer": layer_layout(placed), "orbit": orbit_layout(families), "galaxy": spiral_layout(weights), "globe": sphere_layout(weights),
        "family": block_layout(families.withColumn("repo_id", F.concat_ws(":", "repo_id", "family"))).withColumn("repo_id", F.substring_index("repo_id", ":", 1)), "ring": middle,
    }
    out = None
    for name, frame in views.items():
        flat = frame if "z" in frame.columns else frame.withColumn("z", F.lit(0.0))
        one = flat.select(F.lit(name).alias("view"), "repo_id", "unit", F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y"), F.col("z").cast("double").alias("z"))
        out = one if out is None else out.unionByName(one)
    return out


def family_counts(store: GraphStore) -> DataFrame:
    """family, language, n_units, n_symbols: what stands where, externals too."""
    n = store.nodes.withColumn("family", family_of(F.col("unit")))
    return n.groupBy("family", "language").agg(F.count_distinct("repo_id", "unit").alias("n_units"), F.count(F.when(F.col("kind") == "symbol", 1)).alias("n_symbols"))


def overflow_names(store: GraphStore, k: int, most: int = 5000) -> DataFrame:
    """The names after the first k of top_nodes, in order; at most `most`, as a page shows no more."""
    ranked = degrees(store).join(store.nodes.select("id", "qualified_name"), "id").orderBy(F.desc("degree"), "qualified_name", "id")
    return ranked.offset(k).limit(most).select("id", "qualified_name")


def calls_in_lines(store: GraphStore, lines: DataFrame) -> DataFrame:
    """Calls whose site is one of the lines (path, line): src, dst, path, line."""
    e = gate_edges(store.edges, ("calls",)).filter("source_location IS NOT NULL")
    sites = e.select("src", "dst", F.col("source_location.path").alias("path"), F.col("source_location.line").alias("line")).distinct()
    return sites.join(lines.select("path", "line").distinct(), ["path", "line"], "left_semi")
