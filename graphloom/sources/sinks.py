"""Exports of the graph: node-link JSON, GraphML, SCIP-shaped JSON, an HTML page, append-only spans."""

from __future__ import annotations

import html
import json
from xml.sax.saxutils import escape, quoteattr

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.operators.store import GraphStore

_NODE = ("id", "qualified_name", "kind", "language", "unit")


def node_link_rows(store: GraphStore) -> DataFrame:
    """One JSON text per node and edge, in the order of the export: nodes by id, edges by src, dst, type."""
    nodes = store.nodes.select(F.lit("node").alias("part"), F.col("id").alias("a"), F.lit("").alias("b"), F.lit("").alias("c"), F.to_json(F.struct(*_NODE)).alias("json"))
    edges = store.edges.select(F.lit("edge"), "src", "dst", "type", F.to_json(F.struct("src", "dst", "type", "confidence")))
    return nodes.union(edges)


def write_node_link(store: GraphStore, path: str) -> None:
    """The export as sorted JSON lines, written in parallel."""
    node_link_rows(store).orderBy(F.desc("part"), "a", "b", "c", "json").select(F.col("json").alias("value")).write.mode("overwrite").text(path)


def graphml_lines(store: GraphStore) -> DataFrame:
    """Lines of a GraphML document with their order; the text is made in the JVM, so any size can be written."""
    esc = lambda c: F.regexp_replace(F.regexp_replace(F.regexp_replace(F.coalesce(c, F.lit("")), "&", "&amp;"), "<", "&lt;"), '"', "&quot;")
    spark = store.nodes.sparkSession
    head = [(0, "", "", '<graphml xmlns="http://graphml.graphdrawing.org/xmlns">')] + [(1, k, "", f'<key id="{k}" for="node" attr.name="{k}" attr.type="string"/>') for k in _NODE[1:]] + [(1, "type", "", '<key id="type" for="edge" attr.name="type" attr.type="string"/>'), (2, "", "", '<graph edgedefault="directed">'), (5, "", "", "</graph></graphml>")]
    frame = spark.createDataFrame(head, "part int, a string, b string, line string")
    data = [F.concat(F.lit(f'<data key="{k}">'), esc(F.col(k)), F.lit("</data>")) for k in _NODE[1:]]
    nodes = store.nodes.select(F.lit(3).alias("part"), F.col("id").alias("a"), F.lit("").alias("b"), F.concat(F.lit('<node id="'), F.col("id"), F.lit('">'), *data, F.lit("</node>")).alias("line"))
    edges = store.edges.select(F.lit(4), F.col("src"), F.concat_ws("|", "dst", "type"), F.concat(F.lit('<edge source="'), F.col("src"), F.lit('" target="'), F.col("dst"), F.lit('"><data key="type">'), F.col("type"), F.lit("</data></edge>")))
    return frame.union(nodes).union(edges)


def write_graphml(store: GraphStore, path: str) -> None:
    graphml_lines(store).orderBy("part", "a", "b", "line").select(F.col("line").alias("value")).write.mode("overwrite").text(path)


def scip_documents(store: GraphStore, manager: str = "graphloom") -> DataFrame:
    """One row per unit: its symbols and the occurrences of references, each with its moniker."""
    moniker = F.format_string(f"{manager} %s %s %s", "repo_id", "language", "qualified_name")
    named = store.nodes.filter("kind IN ('symbol', 'module')").select("id", "repo_id", "unit", moniker.alias("symbol"), F.col("location.start_line").alias("line"))
    own = named.groupBy("repo_id", F.col("unit").alias("path")).agg(F.array_sort(F.collect_list(F.struct("symbol", "line"))).alias("symbols"))
    used = store.edges.filter("source_location IS NOT NULL AND type != 'defines'").join(named.select(F.col("id").alias("dst"), "symbol", "repo_id"), "dst")
    seen = used.groupBy("repo_id", F.col("source_location.path").alias("path")).agg(F.array_sort(F.collect_set(F.struct(F.col("source_location.line").alias("line"), "symbol"))).alias("occurrences"))
    return own.join(seen, ["repo_id", "path"], "left")


def html_page(store: GraphStore, title: str = "Graph", limit: int = 1500) -> str:
    """A page of the limit most connected nodes and the edges among them, 20 a node at most; the limit bounds what the
    driver holds, and the page says so where it cut edges off."""
    from graphloom.operators.views import ring_layout, top_nodes

    top = top_nodes(store, limit).join(ring_layout(store), "id").select("id", "qualified_name", "degree", "x", "y")
    nodes = [r.asDict() for r in top.orderBy(F.desc("degree"), "qualified_name", "id").collect()]
    ids = store.nodes.sparkSession.createDataFrame([(n["id"],) for n in nodes], "id string")
    among = store.subgraph(ids)[1].groupBy("src", "dst", "type").count()
    edges = [list(r) for r in among.orderBy("src", "dst", "type").limit(20 * limit + 1).collect()]
    cut_off = len(edges) > 20 * limit
    edges = edges[: 20 * limit]
    dots = "".join(f'<circle cx="{n["x"]:.1f}" cy="{n["y"]:.1f}" r="2"><title>{html.escape(n["qualified_name"] or "")}</title></circle>' for n in nodes)
    note = f"<p>The first {len(edges)} edges among these nodes are shown.</p>" if cut_off else ""
    payload = json.dumps({"nodes": nodes, "edges": edges, "edges_cut_off": cut_off}).replace("</", "<\\/")
    return f'<!doctype html><meta charset="utf-8"><title>{escape(title)}</title><svg viewBox="-120 -120 240 240" data-name={quoteattr(title)}>{dots}</svg>{note}<script type="application/json" id="graph">{payload}</script>'


def append_spans(spans: DataFrame, path: str) -> None:
    """Timing rows (phase, name, duration_ns, node_count, edge_count, rss_bytes) as JSON lines."""
    spans.write.mode("append").json(path)
