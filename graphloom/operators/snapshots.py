"""What changed between full snapshots: validity intervals by gaps and islands, change events from their borders."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from graphloom.runtime import small

KEY = ["repo_id", "record_kind", "record_key"]


def snapshot_order(runs: DataFrame) -> DataFrame:
    """snapshot_id, ord (1, 2, ... by saved_at) and the number of runs.

    Runs without saved_at are left out; of repeated rows of a snapshot the earliest counts; ties go by snapshot_id.
    There is one row per delivered snapshot, so the single-partition ordering is bounded by the number of deliveries.
    """
    one = runs.filter(F.col("saved_at").isNotNull()).groupBy("snapshot_id").agg(F.min("saved_at").alias("saved_at"))
    w = Window.orderBy("saved_at", "snapshot_id")
    return one.select("snapshot_id", F.row_number().over(w).alias("ord"), F.count("*").over(w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)).alias("n_runs"))


def snapshot_records(units: DataFrame, nodes: DataFrame) -> DataFrame:
    """Units and nodes in one shape: snapshot_id, repo_id, record_kind, record_key, content_hash."""
    return units.select("snapshot_id", "repo_id", F.lit("unit").alias("record_kind"), F.col("unit").alias("record_key"), "content_hash").unionByName(
        nodes.select("snapshot_id", "repo_id", F.lit("node").alias("record_kind"), F.col("id").alias("record_key"), "content_hash")
    )


#: Runs of a chunk; neighbouring chunks share the run at their border.
CHUNK = 16


def _packed(text: Column) -> Column:
    """A text as bytes, half as many where it is lower-case hexadecimal; see _unpacked. Null stays null."""
    whole = text.rlike(r"^(?:[0-9a-f]{2})+$")
    return F.when(whole, F.concat(F.lit(b"\x02"), F.unhex(text))).otherwise(F.concat(F.lit(b"\x01"), text.cast("binary")))


def _unpacked(data: Column) -> Column:
    body = F.substring(data, 2, 1 << 30)
    return F.when(F.hex(F.substring(data, 1, 1)) == "02", F.lower(F.hex(body))).otherwise(body.cast("string"))


def _states(records: DataFrame, runs: DataFrame, chunk: int) -> tuple[DataFrame, int]:
    """Of each key and chunk of runs the hash in every run of the chunk (null: not there), and the number of runs.

    Rows are merged before the only shuffle, which is by the key: a row repeated very often, or a key with very many
    hashes in one run, is one row a task. The number of columns is bounded by the chunk, however many runs there are.
    """
    order = snapshot_order(runs)
    n_runs = order.count()  # one row per delivery
    width = max(1, min(chunk + 1, n_runs))
    known = (
        records.filter(F.col("record_key").isNotNull())
        .join(small(order.select("snapshot_id", "ord")), "snapshot_id")
        .select("repo_id", "record_kind", _packed(F.col("record_key")).alias("packed_key"), F.coalesce(_packed(F.col("content_hash")), F.lit(b"\x00")).alias("h"), "ord")
    )
    own = F.floor((F.col("ord") - 1) / chunk).cast("int")
    if n_runs > width:
        border = (F.col("ord") > 1) & ((F.col("ord") - 1) % chunk == 0)
        known = known.withColumn("chunk", F.explode(F.when(border, F.array(own - 1, own)).otherwise(F.array(own))))
    else:
        known = known.withColumn("chunk", F.lit(0))
    place = F.col("ord") - F.col("chunk") * chunk
    columns = [F.max(F.when(place == j, F.col("h"))).alias(f"h{j}") for j in range(1, width + 1)]
    states = known.groupBy("repo_id", "record_kind", "packed_key", "chunk").agg(*columns)
    return states.select("repo_id", "record_kind", "packed_key", "chunk", F.array(*[f"h{j}" for j in range(1, width + 1)]).alias("hashes")), n_runs


_INTERVALS = "array<struct<hash:binary,first:int,last:int>>"


def _islands(hashes: Column) -> Column:
    """Maximal stretches of one hash in neighbouring runs: hash, first and last place."""

    def step(found: Column, at: Column) -> Column:
        h, last = F.element_at(hashes, at), F.try_element_at(found, F.lit(-1))
        fresh = F.struct(h.alias("hash"), at.alias("first"), at.alias("last"))
        grown = F.concat(F.slice(found, 1, F.size(found) - 1), F.array(F.struct(last["hash"].alias("hash"), last["first"].alias("first"), at.alias("last"))))
        goes_on = (F.size(found) > 0) & (last["last"] == at - 1) & (last["hash"] == h)
        return F.when(h.isNull(), found).when(goes_on, grown).otherwise(F.concat(found, F.array(fresh)))

    return F.aggregate(F.sequence(F.lit(1), F.size(hashes)), F.array().cast(_INTERVALS), step)


def validity_intervals(records: DataFrame, runs: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """Islands of consecutive snapshots in which a key kept one hash: KEY, content_hash, first_ord, last_ord, n_runs.

    Rows repeated in a snapshot count once; if they disagree, the greatest hash counts (one in lower-case hexadecimal
    before any other), any hash before null. Null hashes equal each other. Rows of unknown snapshots, and rows with a null
    record_key, are left out; a null repo_id is a repository of its own.
    """
    states, n_runs = _states(records, runs, chunk)
    base = F.col("chunk") * chunk
    spans = states.select("repo_id", "record_kind", "packed_key", "chunk", F.explode(_islands(F.col("hashes"))).alias("i")).select("repo_id", "record_kind", "packed_key", F.col("i.hash").alias("h"), (base + F.col("i.first")).alias("first_ord"), (base + F.col("i.last")).alias("last_ord"))
    if n_runs > chunk + 1:  # islands of neighbouring chunks that share their border are one
        key = ["repo_id", "record_kind", "packed_key"]
        w = Window.partitionBy(*key).orderBy("first_ord", "last_ord")
        starts = ~F.coalesce((F.lag("last_ord").over(w) >= F.col("first_ord")) & (F.lag("h").over(w) == F.col("h")), F.lit(False))
        numbered = spans.withColumn("starts", starts.cast("int")).withColumn("island", F.sum("starts").over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
        spans = numbered.groupBy(*key, "island").agg(F.max("h").alias("h"), F.min("first_ord").alias("first_ord"), F.max("last_ord").alias("last_ord"))
    return spans.select("repo_id", "record_kind", _unpacked(F.col("packed_key")).alias("record_key"), F.when(F.col("h") != F.lit(b"\x00"), _unpacked(F.col("h"))).alias("content_hash"), "first_ord", "last_ord", F.lit(n_runs).alias("n_runs"))


def change_events(records: DataFrame, runs: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """snapshot_id, KEY, change_kind (added, removed, changed) of every run but the first, against the run before it.

    An interval start is an addition, or a change if the interval before ends right before it; an interval end without
    a following adjacent interval is a removal in the next run. Two neighbouring runs always lie in one chunk.
    """
    states, n_runs = _states(records, runs, chunk)
    runs_here = F.least(F.lit(chunk + 1), F.lit(n_runs) - F.col("chunk") * chunk)

    def borders(i: Column, k: Column) -> Column:
        before, after = F.get("islands", k - 1), F.get("islands", k + 1)
        start = F.when(i["first"] > 1, F.struct(i["first"].alias("ord"), F.when(before["last"] == i["first"] - 1, "changed").otherwise("added").alias("change_kind")))
        gone = (i["last"] < F.col("runs_here")) & ~F.coalesce(after["first"] == i["last"] + 1, F.lit(False))
        return F.array(start, F.when(gone, F.struct((i["last"] + 1).alias("ord"), F.lit("removed").alias("change_kind"))))

    spans = states.select("repo_id", "record_kind", "packed_key", "chunk", runs_here.alias("runs_here"), _islands(F.col("hashes")).alias("islands"))
    # a key that never changed has one interval over all runs: it has no borders
    moved = spans.filter((F.size("islands") > 1) | (F.col("islands")[0]["first"] > 1) | (F.col("islands")[0]["last"] < F.col("runs_here")))
    events = moved.select("repo_id", "record_kind", "packed_key", "chunk", F.explode(F.array_compact(F.flatten(F.transform("islands", lambda i, k: borders(i, k))))).alias("e"))
    dated = events.select("repo_id", "record_kind", "packed_key", (F.col("chunk") * chunk + F.col("e.ord")).alias("ord"), F.col("e.change_kind").alias("change_kind"))
    out = dated.join(small(snapshot_order(runs).select("ord", "snapshot_id")), "ord")
    return out.select("snapshot_id", "repo_id", "record_kind", _unpacked(F.col("packed_key")).alias("record_key"), "change_kind")


def change_summary(events: DataFrame) -> DataFrame:
    """Number of events by snapshot, repository, kind of record and kind of change."""
    return events.groupBy("snapshot_id", "repo_id", "record_kind", "change_kind").agg(F.count("*").alias("n_records"))
