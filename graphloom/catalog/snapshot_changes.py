"""Queries on full snapshots (problem 4)."""

from __future__ import annotations

from graphloom.operators.snapshots import change_events, change_summary, snapshot_records, validity_intervals
from graphloom.runtime import load


def _inputs(spark, d):
    return snapshot_records(load(spark, d, "snapshot_units"), load(spark, d, "snapshot_nodes")), load(spark, d, "snapshot_runs")


QUERIES = {
    "p4_found": lambda spark, d: change_events(*_inputs(spark, d)),
    "p4_summary": lambda spark, d: change_summary(change_events(*_inputs(spark, d))),
    "p4_intervals": lambda spark, d: validity_intervals(*_inputs(spark, d)).select("repo_id", "record_kind", "record_key", "content_hash", "first_ord", "last_ord"),
}

_STATE = """
WITH runs AS (SELECT snapshot_id, row_number() OVER (ORDER BY min(saved_at), snapshot_id) AS ord FROM snapshot_runs WHERE saved_at IS NOT NULL GROUP BY snapshot_id),
rec AS (SELECT snapshot_id, repo_id, 'unit' AS record_kind, unit AS record_key, content_hash FROM snapshot_units
        UNION ALL SELECT snapshot_id, repo_id, 'node', id, content_hash FROM snapshot_nodes),
state AS (SELECT ord, repo_id, record_kind, record_key, max(content_hash) AS content_hash FROM rec JOIN runs USING (snapshot_id)
          WHERE record_key IS NOT NULL GROUP BY ALL)"""
_EVENTS = (
    _STATE
    + """,
pairs AS (SELECT coalesce(n.ord, o.ord + 1) AS ord, coalesce(n.repo_id, o.repo_id) AS repo_id, coalesce(n.record_kind, o.record_kind) AS record_kind,
                 coalesce(n.record_key, o.record_key) AS record_key, o.ord IS NULL AS fresh, n.ord IS NULL AS gone, n.content_hash AS new_hash, o.content_hash AS old_hash
          FROM state n FULL JOIN state o ON n.ord = o.ord + 1 AND n.repo_id IS NOT DISTINCT FROM o.repo_id AND n.record_kind = o.record_kind AND n.record_key = o.record_key),
events AS (SELECT runs.snapshot_id, repo_id, record_kind, record_key, CASE WHEN fresh THEN 'added' WHEN gone THEN 'removed' ELSE 'changed' END AS change_kind
           FROM pairs JOIN runs USING (ord) WHERE ord > 1 AND (fresh OR gone OR new_hash IS DISTINCT FROM old_hash))"""
)
SQL = {
    "p4_found": _EVENTS + " SELECT * FROM events",
    "p4_summary": _EVENTS + " SELECT snapshot_id, repo_id, record_kind, change_kind, count(*) AS n_records FROM events GROUP BY ALL",
    "p4_intervals": _STATE
    + """,
marked AS (SELECT *, CASE WHEN lag(ord) OVER w = ord - 1 AND lag(content_hash) OVER w IS NOT DISTINCT FROM content_hash THEN 0 ELSE 1 END AS starts
           FROM state WINDOW w AS (PARTITION BY repo_id, record_kind, record_key ORDER BY ord)),
islands AS (SELECT *, sum(starts) OVER (PARTITION BY repo_id, record_kind, record_key ORDER BY ord ROWS UNBOUNDED PRECEDING) AS island FROM marked)
SELECT repo_id, record_kind, record_key, max(content_hash) AS content_hash, CAST(min(ord) AS INTEGER) AS first_ord, CAST(max(ord) AS INTEGER) AS last_ord
FROM islands GROUP BY repo_id, record_kind, record_key, island""",
}
