"""Queries on logs, snapshots and changes: chains, percentiles, windows, advisories."""

from __future__ import annotations

from pyspark.sql import functions as F

from graphloom.catalog import graph
from graphloom.catalog.sql import VISIBLE
from graphloom.operators import audit, gates, views
from graphloom.operators import store as s
from graphloom.runtime import load
from graphloom.streaming import units


def _events(spark, d):
    return load(spark, d, "events")


def _store(spark, d):
    return s.GraphStore(load(spark, d, "nodes"), load(spark, d, "edges"))


def _at(spark, d, snapshot):
    return load(spark, d, "snapshot_nodes").filter(F.col("snapshot_id") == snapshot)


def _first_and_last(spark, d):
    n = load(spark, d, "nodes").filter("kind = 'symbol'")
    first = n.groupBy("id").agg(F.min_by(F.struct(*n.columns), "load_seq").alias("r")).select("r.*")
    return first, s.visible_nodes(n)


def _units_as(spark, d, snapshot):
    return load(spark, d, "snapshot_units").filter(F.col("snapshot_id") == snapshot).select("repo_id", "unit")


QUERIES = {
    "w_hash_chain": lambda spark, d: audit.hash_chain(_events(spark, d), "user_id", ["event_id"], F.concat_ws("|", "event_id", "event_type")).select("event_id", "digest", "prev"),
    "w_transitions": lambda spark, d: _transitions(_events(spark, d)),
    "a_phase_percentiles": lambda spark, d: audit.phase_percentiles(_events(spark, d), "event_type", "value"),
    "a_summary": lambda spark, d: audit.summary(_events(spark, d), "event_type", "value"),
    "a_precision_recall": lambda spark, d: audit.precision_recall(_units_as(spark, d, 101), _units_as(spark, d, 104), "repo_id", "unit"),
    "t_event_windows": lambda spark, d: units.event_windows(_events(spark, d)),
    "t_sessions": lambda spark, d: units.session_windows(_events(spark, d)),
    "t_refusals": lambda spark, d: audit.refusal_budget(_events(spark, d).select(F.col("user_id").alias("session"), F.col("event_id").alias("seq"), (F.col("event_type") == "purchase").alias("satisfied"))),
    "k_signature_changes": lambda spark, d: gates.contract_changes(*_first_and_last(spark, d)),
    "k_deleted_nodes": lambda spark, d: _at(spark, d, 101).select("id").distinct().join(_at(spark, d, 104).select("id").distinct(), "id", "left_anti"),
    "k_deletion_advisory": lambda spark, d: gates.deletion_advisory(_store(spark, d), _at(spark, d, 101).select("id").distinct().join(_at(spark, d, 104).select("id").distinct(), "id", "left_anti")),
    "k_lost_ids": lambda spark, d: gates.lost_ids(_at(spark, d, 102), _at(spark, d, 103)),
    "k_fresh_units": lambda spark, d: gates.fresh_units(load(spark, d, "snapshot_units").filter("snapshot_id = 101").select("repo_id", "unit", "content_hash").distinct(), load(spark, d, "snapshot_units").filter("snapshot_id = 104")),
    "k_follow_through": lambda spark, d: (lambda st: gates.follow_through(st, st.nodes.filter("load_seq % 20 = 0").select("id"), st.nodes.filter("load_seq % 20 = 0").select("repo_id", "unit")))(_store(spark, d)),
    "k_expand_scope": lambda spark, d: (lambda st: gates.expand_scope(st, st.nodes.filter("kind = 'symbol' AND load_seq % 20 = 0").select("id")))(_store(spark, d)),
    "a_family_cube": lambda spark, d: views.family_cube(_store(spark, d)),
    "j_order_spans": lambda spark, d: _order_spans(load(spark, d, "orders"), load(spark, d, "lineitem")),
}


def _transitions(events):
    """How often each kind of event follows another of the same user."""
    from pyspark.sql import Window

    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    return events.withColumn("before", F.lag("event_type").over(w)).filter("before IS NOT NULL").groupBy("before", "event_type").agg(F.count("*").alias("n"))


def _order_spans(orders, items):
    """Orders whose 30 days from the order overlap the week after a returned item of the same customer was shipped."""
    back = items.filter("l_returnflag = 'R'").select("l_orderkey", "l_shipdate").join(orders.select(F.col("o_orderkey").alias("l_orderkey"), "o_custkey"), "l_orderkey")
    regions = back.select("o_custkey", F.col("l_shipdate").alias("a"), F.expr("l_shipdate + INTERVAL 7 DAYS").alias("b")).distinct()
    spans = orders.select("o_custkey", "o_orderkey", F.col("o_orderdate").alias("lo"), F.expr("o_orderdate + INTERVAL 30 DAYS").alias("hi"))
    return spans.join(regions, "o_custkey").filter("lo <= b AND a <= hi").select("o_orderkey").distinct()


_GONE = "(SELECT DISTINCT id FROM snapshot_nodes WHERE snapshot_id = 101 AND id NOT IN (SELECT id FROM snapshot_nodes WHERE snapshot_id = 104))"
SQL = {
    "w_hash_chain": "SELECT event_id, h AS digest, coalesce(lag(h) OVER (PARTITION BY user_id ORDER BY event_id), '') AS prev FROM (SELECT *, sha256(event_id || '|' || event_type) AS h FROM events)",
    "w_transitions": "SELECT before, event_type, count(*) AS n FROM (SELECT event_type, lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS before FROM events) WHERE before IS NOT NULL GROUP BY 1, 2",
    "a_phase_percentiles": "SELECT event_type, count(*) AS n, round(quantile_cont(value, 0.5), 9) AS p50, round(quantile_cont(value, 0.95), 9) AS p95, round(quantile_cont(value, 0.99), 9) AS p99 FROM events WHERE value IS NOT NULL GROUP BY 1",
    "a_summary": "SELECT event_type, round(avg(value), 6) AS mean, round(stddev_samp(value), 6) AS stdev, min(value) AS least, max(value) AS greatest FROM events GROUP BY 1",
    "a_precision_recall": """WITH p AS (SELECT DISTINCT repo_id, unit FROM snapshot_units WHERE snapshot_id = 101), t AS (SELECT DISTINCT repo_id, unit FROM snapshot_units WHERE snapshot_id = 104),
c AS (SELECT coalesce(p.repo_id, t.repo_id) AS repo_id, count(p.unit) AS np, count(t.unit) AS nt, count(CASE WHEN p.unit IS NOT NULL AND t.unit IS NOT NULL THEN 1 END) AS hit FROM p FULL JOIN t ON p.repo_id = t.repo_id AND p.unit = t.unit GROUP BY 1),
r AS (SELECT repo_id, CASE WHEN np = 0 THEN 1.0 ELSE CAST(hit AS DOUBLE) / np END AS precision, CASE WHEN nt = 0 THEN 1.0 ELSE CAST(hit AS DOUBLE) / nt END AS recall FROM c)
SELECT repo_id, CAST(precision AS DOUBLE) AS precision, CAST(recall AS DOUBLE) AS recall, CAST(CASE WHEN precision + recall = 0 THEN 0 ELSE 2 * precision * recall / (precision + recall) END AS DOUBLE) AS f1 FROM r""",
    "t_event_windows": "SELECT time_bucket(INTERVAL 1 HOUR, ts) AS window_start, event_type, count(*) AS n_events, round(sum(value), 6) AS total FROM events GROUP BY 1, 2",
    "t_sessions": "SELECT user_id, min(ts) AS session_start, count(*) AS n_events FROM (SELECT *, sum(CASE WHEN p IS NULL OR ts >= p + INTERVAL 30 MINUTE THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM (SELECT *, lag(ts) OVER (PARTITION BY user_id ORDER BY ts) AS p FROM events)) GROUP BY user_id, k",
    "t_refusals": "SELECT session, seq, satisfied, CASE WHEN satisfied THEN 'allowed' WHEN sum(CASE WHEN satisfied THEN 0 ELSE 1 END) OVER (PARTITION BY session ORDER BY seq ROWS UNBOUNDED PRECEDING) <= 3 THEN 'refused' ELSE 'unsatisfied_stop' END AS outcome FROM (SELECT user_id AS session, event_id AS seq, event_type = 'purchase' AS satisfied FROM events)",
    "k_deleted_nodes": f"SELECT id FROM {_GONE}",
    "k_deletion_advisory": VISIBLE + f" SELECT dst AS id, count(DISTINCT src) AS n_references FROM gate WHERE type IN ('calls','references','imports','inherits','implements') AND src <> dst AND dst IN {_GONE} GROUP BY 1",
    "k_lost_ids": "SELECT DISTINCT id FROM snapshot_nodes WHERE snapshot_id = 102 AND id NOT IN (SELECT id FROM snapshot_nodes WHERE snapshot_id = 103)",
    "k_fresh_units": "SELECT DISTINCT o.repo_id, o.unit, o.content_hash FROM snapshot_units o JOIN snapshot_units n USING (repo_id, unit, content_hash) WHERE o.snapshot_id = 101 AND n.snapshot_id = 104",
    "k_follow_through": VISIBLE + ", ch AS (SELECT id, repo_id, unit FROM v WHERE load_seq % 20 = 0) SELECT a.repo_id, a.unit, count(DISTINCT gate.dst) AS n_changed FROM gate JOIN ch ON ch.id = gate.dst JOIN v a ON a.id = gate.src WHERE type IN ('calls','references','imports','inherits','implements') AND src <> dst AND NOT EXISTS (SELECT 1 FROM ch c WHERE c.repo_id = a.repo_id AND c.unit = a.unit) GROUP BY 1, 2",
    "k_expand_scope": VISIBLE + ", r AS (SELECT id FROM v WHERE kind = 'symbol' AND load_seq % 20 = 0) SELECT DISTINCT repo_id, unit FROM v WHERE id IN (SELECT id FROM r) OR id IN (SELECT src FROM gate WHERE dst IN (SELECT id FROM r))",
    "j_order_spans": """WITH r AS (SELECT DISTINCT o_custkey, l_shipdate AS a, l_shipdate + INTERVAL 7 DAY AS b FROM lineitem JOIN orders ON o_orderkey = l_orderkey WHERE l_returnflag = 'R')
SELECT DISTINCT o.o_orderkey FROM orders o JOIN r ON r.o_custkey = o.o_custkey WHERE o.o_orderdate <= b AND a <= o.o_orderdate + INTERVAL 30 DAY""",
    "a_family_cube": f"SELECT src_family, dst_family, type, sum(n_edges) AS n_edges, CAST(grouping_id(src_family, dst_family, type) AS BIGINT) AS level FROM ({graph.SQL['a_family_matrix']}) GROUP BY CUBE (src_family, dst_family, type)",
}
