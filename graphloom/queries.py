"""All core queries and their SQL."""

from __future__ import annotations

from graphloom.catalog import graph, names, pieces, records, snapshot_changes, texts

_MODULES = [graph, names, pieces, texts, records, snapshot_changes]
QUERIES = {name: query for m in _MODULES for name, query in m.QUERIES.items()}
SQL = {name: sql for m in _MODULES for name, sql in m.SQL.items()}
