"""The fact store: visible facts of stacked loads, lookups, neighbours, regions, snapshots."""

from __future__ import annotations

import time
import uuid
from collections.abc import Iterable

from py4j.protocol import Py4JJavaError
from pyspark.errors import PySparkException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from graphloom.functions.signatures import normalize_signature
from graphloom.schema import EDGES, NODES

FORMAT_VERSION = 3
ID_SCHEME_VERSION = 2


def one_of(column: str, wanted: Iterable[str] | None) -> Column:
    """A filter on a set of values: None filters nothing, an empty set lets nothing pass."""
    if wanted is None:
        return F.lit(True)
    wanted = list(wanted)
    return F.col(column).isin(wanted) if wanted else F.lit(False)


def latest(rows: DataFrame, key: list[str], order: str) -> DataFrame:
    """The last row by `order` of each key, whatever the number of rows of a key.

    Only keys and orders are merged, by hash and before the shuffle; the rows that carry the last order are then kept, all
    of them if a key has several (load_seq is unique).
    """
    named = [f"{k}_of_last" for k in key]
    last = rows.groupBy(*[F.col(k).alias(n) for k, n in zip(key, named, strict=True)]).agg(F.max(order).alias("last_order"))
    same = F.lit(True)
    for k, n in zip(key, named, strict=True):
        same = same & rows[k].eqNullSafe(F.col(n))
    return rows.join(last, same & (rows[order] == F.col("last_order")), "left_semi")


def visible_nodes(nodes: DataFrame) -> DataFrame:
    """Each node as last loaded."""
    return latest(nodes.filter(F.col("id").isNotNull()), ["id"], "load_seq")


def hidden_loads(nodes: DataFrame) -> DataFrame:
    """load_seq of the loads that a later load of the same node superseded."""
    last = nodes.groupBy("id").agg(F.max("load_seq").alias("last_seq"))
    return nodes.join(last, "id").filter(F.col("load_seq") < F.col("last_seq")).select("id", "load_seq")


def visible_edges(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges with two visible ends; parallel edges are kept, rows delivered twice (equal but for loaded_at) are one edge."""
    ids = nodes.select("id").distinct()
    once = edges.groupBy(*[c for c in edges.columns if c != "loaded_at"]).agg(F.min("loaded_at").alias("loaded_at"))
    return once.join(ids.withColumnRenamed("id", "src"), "src", "left_semi").join(ids.withColumnRenamed("id", "dst"), "dst", "left_semi")


def repeated_ids(nodes: DataFrame) -> DataFrame:
    """Ids that more than one unit claims: such facts may not be published."""
    return nodes.groupBy("id").agg(F.count_distinct("unit").alias("n_units")).filter("n_units > 1")


class GraphStore:
    """Visible nodes and edges with the lookups of the store."""

    def __init__(self, nodes: DataFrame, edges: DataFrame, strict: bool = False):
        """`strict` refuses nodes that several units claim, as a published graph must."""
        if strict:
            refuse_repeated(nodes)
        self.loads = nodes
        self.nodes = visible_nodes(nodes)
        self.edges = visible_edges(edges, self.nodes)

    def get_node(self, ids: DataFrame) -> DataFrame:
        """Batch lookup by id."""
        return self.nodes.join(ids.select("id").distinct(), "id", "left_semi")

    def get_symbol(self, names: DataFrame | None = None) -> DataFrame:
        """The last writer of each qualified name of a repository, of any kind."""
        last = latest(self.nodes, ["repo_id", "qualified_name"], "load_seq")
        return last if names is None else last.join(names, ["repo_id", "qualified_name"], "left_semi")

    def gate_symbols(self) -> DataFrame:
        """The signature index: extracted top-level nodes with a signature, and its normal form."""
        kept = self.nodes.filter(F.col("signature").isNotNull() & (F.col("confidence") == "EXTRACTED") & F.col("is_top_level"))
        return kept.withColumn("norm_signature", normalize_signature("signature", "language"))

    def find_symbols_by_signature(self, wanted: DataFrame) -> DataFrame:
        """Hits of (signature, language) rows, with the asked signature."""
        asked = wanted.select(F.col("signature").alias("asked"), "language").withColumn("norm_signature", normalize_signature("asked", "language"))
        return self.gate_symbols().join(asked, ["language", "norm_signature"])

    def exists(self, wanted: DataFrame) -> DataFrame:
        """The asked rows that some symbol answers."""
        asked = wanted.withColumn("norm_signature", normalize_signature("signature", "language"))
        return asked.join(self.gate_symbols().select("language", "norm_signature"), ["language", "norm_signature"], "left_semi").drop("norm_signature")

    def units(self) -> DataFrame:
        return self.nodes.select("repo_id", "unit").distinct()

    def unit_facts(self) -> DataFrame:
        """Numbers of nodes and edges of each unit of a repository; an edge is in the repository of its source."""
        n = self.nodes.groupBy("repo_id", "unit").agg(F.count("*").alias("n_nodes"))
        owned = self.edges.join(self.nodes.select(F.col("id").alias("src"), "repo_id"), "src")
        e = owned.groupBy("repo_id", "unit").agg(F.count("*").alias("n_edges"))
        a, b = n.alias("a"), e.alias("b")
        same = F.col("a.repo_id").eqNullSafe(F.col("b.repo_id")) & F.col("a.unit").eqNullSafe(F.col("b.unit"))
        both = a.join(b, same, "full_outer")
        return both.select(F.coalesce("a.repo_id", "b.repo_id").alias("repo_id"), F.coalesce("a.unit", "b.unit").alias("unit"), F.coalesce("n_nodes", F.lit(0)).alias("n_nodes"), F.coalesce("n_edges", F.lit(0)).alias("n_edges"))

    def neighbors(self, types=None, confidences=None, direction: str = "both") -> DataFrame:
        """node, direction, type, other of every incident edge; a loop has both directions."""
        kept = self.edges.filter(one_of("type", types) & one_of("confidence", confidences))
        out = kept.select(F.col("src").alias("node"), F.lit("out").alias("direction"), "type", F.col("dst").alias("other"))
        into = kept.select(F.col("dst").alias("node"), F.lit("in").alias("direction"), "type", F.col("src").alias("other"))
        return {"out": out, "in": into, "both": out.unionByName(into)}[direction]

    def subgraph(self, ids: DataFrame, types=None, confidences=None) -> tuple[DataFrame, DataFrame]:
        """Nodes of the ids and the edges between them; unknown ids are ignored."""
        known = ids.select("id").distinct()
        inside = self.edges.filter(one_of("type", types) & one_of("confidence", confidences))
        for end in ("src", "dst"):
            inside = inside.join(known.withColumnRenamed("id", end), end, "left_semi")
        return self.nodes.join(known, "id", "left_semi"), inside

    def changed_set(self, regions: DataFrame) -> DataFrame:
        """Ids of nodes whose span overlaps a region (path, start_line, end_line) of the same path."""
        return overlapping(self.nodes, regions).select("id").distinct()


#: Lines of a slice of a file: spans and regions meet only in a slice that both touch.
LINE_SLICE = 64


def overlapping(nodes: DataFrame, regions: DataFrame) -> DataFrame:
    """Nodes with the regions they overlap, once a pair; null spans and paths overlap nothing.

    The join is an equality of (path, slice of lines), so a file with very many spans is spread over its slices.
    """
    spans = nodes.filter("location.start_line IS NOT NULL AND location.path IS NOT NULL").withColumn("lo", F.col("location.start_line")).withColumn("hi", F.greatest("lo", F.coalesce("location.end_line", "lo")))
    a = spans.select(F.col("location.path").alias("path"), "lo", "hi", F.explode(F.sequence(F.floor(F.col("lo") / LINE_SLICE), F.floor(F.col("hi") / LINE_SLICE))).alias("slice"), *[c for c in nodes.columns])
    r = regions.filter("start_line IS NOT NULL AND end_line >= start_line").select("path", "start_line", "end_line").distinct()
    b = r.withColumn("slice", F.explode(F.sequence(F.floor(F.col("start_line") / LINE_SLICE), F.floor(F.col("end_line") / LINE_SLICE))))
    met = a.join(b, ["path", "slice"]).filter((F.col("lo") <= F.col("end_line")) & (F.col("start_line") <= F.col("hi")))
    # of the slices that a pair shares only the first counts
    first = F.greatest(F.floor(F.col("lo") / LINE_SLICE), F.floor(F.col("start_line") / LINE_SLICE))
    return met.filter(F.col("slice") == first).drop("slice", "lo", "hi")


def unit_key(*frames: DataFrame | None) -> list[str]:
    """What names a unit: its repository too, where all frames tell it."""
    return ["repo_id", "unit"] if all("repo_id" in f.columns for f in frames if f is not None) else ["unit"]


def publish(unit_facts: DataFrame, stacked: DataFrame | None, version: int, units: DataFrame | None = None) -> DataFrame:
    """Stack a new version of whole units over the old facts; `units` names units that become empty (tombstones)."""
    new = unit_facts.withColumn("unit_version", F.lit(version)).withColumn("deleted", F.lit(False))
    if units is not None:
        key = unit_key(unit_facts, units)
        gone = units.select(*key).distinct().join(unit_facts.select(*key).distinct(), key, "left_anti")
        new = new.unionByName(gone.withColumn("unit_version", F.lit(version)).withColumn("deleted", F.lit(True)), allowMissingColumns=True)
    return new if stacked is None else stacked.unionByName(new, allowMissingColumns=True)


def current_facts(stacked: DataFrame) -> DataFrame:
    """Facts of the newest version of each unit that is not a tombstone."""
    key = unit_key(stacked)
    newest = stacked.groupBy(*key).agg(F.max("unit_version").alias("unit_version"))
    return stacked.join(newest, [*key, "unit_version"], "left_semi").filter(~F.col("deleted"))


def save_graph(nodes: DataFrame, edges: DataFrame, path: str) -> None:
    """A snapshot with its versions. Nodes and edges go to folders of their own; the row that names them is written last, so
    a save that breaks off leaves the snapshot before it, and no reader sees parts of two."""
    refuse_repeated(nodes)
    spark, name = nodes.sparkSession, uuid.uuid4().hex
    nodes.write.parquet(f"{path}/data/{name}/nodes")
    edges.write.parquet(f"{path}/data/{name}/edges")
    saved = spark.createDataFrame([(FORMAT_VERSION, ID_SCHEME_VERSION, name, time.time_ns())], META)
    saved.coalesce(1).write.mode("append").parquet(f"{path}/meta")


#: One row a save; the newest counts.
META = "format_version int, id_scheme_version int, name string, saved_ns bigint"


def refuse_repeated(nodes: DataFrame) -> None:
    repeated = repeated_ids(nodes).limit(1).collect()
    if repeated:
        raise ValueError(f"node {repeated[0].id} is claimed by several units")


def path_exists(spark: SparkSession, path: str) -> bool:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at)


def load_graph(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame] | None:
    """The snapshot, or None when it is missing, broken or of other versions."""
    if not path_exists(spark, f"{path}/meta"):
        return None
    try:
        meta = spark.read.schema(META).parquet(f"{path}/meta").orderBy(F.desc("saved_ns")).first()
    except (Py4JJavaError, PySparkException):  # no row of a snapshot can be read
        return None
    if meta is None or (meta.format_version, meta.id_scheme_version) != (FORMAT_VERSION, ID_SCHEME_VERSION):
        return None
    parts = [f"{path}/data/{meta.name}/{x}" for x in ("nodes", "edges")]
    return tuple(spark.read.parquet(x) for x in parts) if all(path_exists(spark, x + "/_SUCCESS") for x in parts) else None


def overload_ordinals(nodes: DataFrame) -> DataFrame:
    """id, ordinal of each symbol with overloads: the rank of its normal signature among those of its name; else null."""
    symbols = nodes.filter((F.col("kind") == "symbol") & F.col("signature").isNotNull()).withColumn("ns", normalize_signature("signature", "language"))
    distinct = symbols.select("repo_id", "language", "qualified_name", "ns").distinct()
    w = Window.partitionBy("repo_id", "language", "qualified_name")
    ranked = distinct.withColumn("ordinal", F.when(F.count("*").over(w) > 1, F.row_number().over(w.orderBy("ns")) - 1))
    return symbols.select("id", "repo_id", "language", "qualified_name", "ns").join(ranked, ["repo_id", "language", "qualified_name", "ns"]).select("id", "ordinal")


def export_json(nodes: DataFrame, edges: DataFrame, path: str) -> None:
    """A snapshot as compressed JSON lines, for other programs; its versions stand beside it."""
    refuse_repeated(nodes)
    for name, frame in (("nodes", nodes), ("edges", edges)):
        frame.write.mode("overwrite").option("compression", "gzip").option("ignoreNullFields", "false").json(f"{path}/{name}")
    nodes.sparkSession.createDataFrame([(FORMAT_VERSION, ID_SCHEME_VERSION)], "format_version int, id_scheme_version int").coalesce(1).write.mode("overwrite").json(f"{path}/meta")


def import_json(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame] | None:
    """What export_json wrote, or None where it is missing or of other versions."""
    if not path_exists(spark, f"{path}/meta/_SUCCESS"):
        return None
    meta = spark.read.schema("format_version int, id_scheme_version int").json(f"{path}/meta").first()
    if meta is None or tuple(meta) != (FORMAT_VERSION, ID_SCHEME_VERSION):
        return None
    return spark.read.schema(NODES).json(f"{path}/nodes"), spark.read.schema(EDGES).json(f"{path}/edges")
