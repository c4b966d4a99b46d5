"""Incremental maintenance: streams of unit changes, ledger lines and timed events."""

from __future__ import annotations

import time
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from graphloom.operators.store import current_facts, load_graph, unit_key


def change_signature(state: DataFrame) -> DataFrame:
    """One hash over (unit, size, mtime) in the order of the units, built from hashes of 256 buckets."""
    row = F.sha2(F.concat_ws("|", "unit", "size", "mtime"), 256)
    parts = state.groupBy(F.pmod(F.xxhash64("unit"), F.lit(256)).alias("bucket")).agg(F.sum(F.conv(F.substring(row, 1, 12), 16, 10).cast("decimal(38,0)")).alias("h"), F.count("*").alias("n"))
    return parts.agg(F.sha2(F.concat_ws(",", F.array_sort(F.collect_list(F.concat_ws(":", "bucket", "h", "n")))), 256).alias("signature"))


def file_delta(old: DataFrame, new: DataFrame) -> DataFrame:
    """unit, change (added, deleted, modified) between two states of (unit, mtime, size)."""
    a, b = old.select("unit", F.struct("mtime", "size").alias("was")), new.select("unit", F.struct("mtime", "size").alias("now"))
    kind = F.when(F.col("was").isNull(), "added").when(F.col("now").isNull(), "deleted").when(F.col("was") != F.col("now"), "modified")
    return a.join(b, "unit", "full_outer").withColumn("change", kind).filter("change IS NOT NULL").select("unit", "change")


def may_refresh_incrementally(delta: DataFrame, modules: DataFrame, resolved: bool = True, most: int = 20) -> bool:
    """Whether only the changed units need to be read again: no deletions, few units, every module with one owner."""
    counts = {r["change"]: r["count"] for r in delta.groupBy("change").count().collect()}
    if resolved and (counts.get("deleted", 0) or sum(counts.values()) > most):
        return False
    return modules.groupBy("module").agg(F.count_distinct("unit").alias("n")).filter("n > 1").isEmpty()


def maintain_units(stream: DataFrame, path: str, checkpoint: str, trigger: dict | None = None) -> StreamingQuery:
    """Stack every micro-batch of unit facts (unit, fact, deleted) as a new version under `path`.

    A batch is written to its own directory by number, so one that is repeated after a failure replaces itself.
    """

    def stack(batch: DataFrame, number: int) -> None:
        batch.withColumn("unit_version", F.lit(number + 1)).write.mode("overwrite").parquet(f"{path}/version={number + 1}")

    return stream.writeStream.foreachBatch(stack).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def served_units(spark: SparkSession, path: str) -> DataFrame:
    """The facts a reader sees: of each unit the last version."""
    return current_facts(spark.read.parquet(path))


def event_windows(events: DataFrame, width: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Counts and sums of events by type in tumbling windows; as a stream, windows close `late` after their end."""
    timed = events.withWatermark("ts", late) if events.isStreaming else events
    return timed.groupBy(F.window("ts", width).alias("w"), "event_type").agg(F.count("*").alias("n_events"), F.round(F.sum("value"), 6).alias("total")).select(F.col("w.start").alias("window_start"), "event_type", "n_events", "total")


def session_windows(events: DataFrame, gap: str = "30 minutes") -> DataFrame:
    """Sessions of each user, ended by a gap without events."""
    timed = events.withWatermark("ts", "2 hours") if events.isStreaming else events
    return timed.groupBy(F.session_window("ts", gap).alias("w"), "user_id").agg(F.count("*").alias("n_events")).select("user_id", F.col("w.start").alias("session_start"), "n_events")


def invalidated(changed: DataFrame, known: DataFrame) -> DataFrame:
    """The changed units that a graph knows."""
    key = unit_key(changed, known)
    return changed.select(*key).intersect(known.select(*key))


def prime(spark: SparkSession, path: str, hashes: DataFrame, reextract: Callable[[DataFrame], tuple[DataFrame, DataFrame]], stored_hashes: DataFrame | None, most: int = 20) -> tuple[DataFrame, DataFrame, str]:
    """nodes, edges and how they came about: snapshot, snapshot+delta or full.

    hashes (repo_id, unit, content_hash) is the state of the files, stored_hashes that of the snapshot. An unchanged state
    takes the snapshot as it is. Up to `most` changed or new units, and none deleted, are extracted again and replace their
    facts; if ids of units that were not touched would be lost by that, or there is no snapshot, everything is extracted.
    reextract takes the (repo_id, unit) to read, all of them for a full build.
    """
    key = ["repo_id", "unit"]
    loaded = None if stored_hashes is None else load_graph(spark, path)
    if loaded is not None:
        a, b = stored_hashes.select(*key, F.col("content_hash").alias("was")), hashes.select(*key, F.col("content_hash").alias("now"))
        gone = a.join(b, key, "left_anti")
        changed = b.join(a, key, "left").filter(~F.col("was").eqNullSafe(F.col("now"))).select(*key)
        n_changed, n_gone = changed.limit(most + 1).count(), gone.limit(1).count()
        if not n_changed and not n_gone:
            return *loaded, "snapshot"
        if n_changed <= most and not n_gone:
            merged = replace_units(loaded, changed, *reextract(changed))
            if merged is not None:
                return *merged, "snapshot+delta"
    return *reextract(hashes.select(*key)), "full"


def replace_units(graph: tuple[DataFrame, DataFrame], units: DataFrame, nodes: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame] | None:
    """The graph with the facts of some units (repo_id, unit) replaced; None if an edge that stays would lose its end.

    An edge belongs to the unit it names, in the repository of its source.
    """
    old_nodes, old_edges = graph
    key = ["repo_id", "unit"]
    kept_nodes = old_nodes.join(units, key, "left_anti")
    owner = old_nodes.select(F.col("id").alias("src"), "repo_id")
    kept_edges = old_edges.join(owner, "src").join(units, key, "left_anti").drop("repo_id").select(*old_edges.columns)
    fresh = nodes.join(kept_nodes.select("id"), "id", "left_anti")
    all_nodes = kept_nodes.unionByName(fresh.select(*kept_nodes.columns))
    lost = old_nodes.join(units, key, "left_semi").select("id").join(all_nodes.select("id"), "id", "left_anti")
    if not kept_edges.join(lost.withColumnRenamed("id", "dst"), "dst", "left_semi").isEmpty():
        return None
    return all_nodes, kept_edges.unionByName(edges.select(*kept_edges.columns)).distinct()


class Served:
    """The last good graph: a refresh that fails leaves it in place and is counted."""

    def __init__(self, graph: tuple[DataFrame, DataFrame], debounce: float = 0.25, clock: Callable[[], float] = time.monotonic):
        self.graph, self.errors, self.signature = graph, 0, None
        self.debounce, self.clock, self.checked = debounce, clock, None

    def maybe_refresh(self, signature: str, build: Callable[[], tuple[DataFrame, DataFrame]]) -> bool:
        """Build anew if the state's signature is another one and the last look is long enough ago."""
        now = self.clock()
        if self.checked is not None and now - self.checked < self.debounce:
            return False
        self.checked = now
        if signature == self.signature:
            return False
        try:
            self.graph = build()
        except Exception:
            self.errors += 1
            return False
        self.signature = signature
        return True
