"""Queries on the tools, the index job's pieces, versions of units and views."""

from __future__ import annotations

from pyspark.sql import functions as F

from graphloom.catalog import graph
from graphloom.catalog.signature_sql import norm_cte
from graphloom.catalog.sql import VISIBLE
from graphloom.catalog.texts import last_files
from graphloom.functions.paths import is_test_unit, language_of, posix
from graphloom.operators import audit, gates, tools, traverse, views
from graphloom.operators import queries as q
from graphloom.operators import store as s
from graphloom.runtime import load
from graphloom.schema import EXTERNALS_UNIT
from graphloom.sources import index
from graphloom.streaming import units


def _store(spark, d):
    return s.GraphStore(load(spark, d, "nodes"), load(spark, d, "edges"))


def _sources(spark, d):
    return last_files(spark, d).select("repo_id", posix(F.col("rel_path")).alias("unit"), "source_text")


def _raw(spark, d):
    r = load(spark, d, "raw_symbols").filter("signature IS NOT NULL AND qualified_name IS NOT NULL AND start_line IS NOT NULL")
    unit = posix(F.col("rel_path"))
    return r.select("repo_id", language_of(unit).alias("language"), "qualified_name", "signature", unit.alias("unit"), "start_line").filter("language IS NOT NULL AND repo_id IS NOT NULL").distinct()


def _call_overloads(spark, d):
    st = _store(spark, d)
    named = st.nodes.filter("kind = 'symbol'").select("repo_id", "qualified_name", "id", F.col("location.start_line").alias("start_line"), F.col("location.end_line").alias("end_line"))
    sites = st.edges.filter("type = 'calls' AND source_location IS NOT NULL").join(named.select(F.col("id").alias("src"), "repo_id", "qualified_name"), "src").select("repo_id", "qualified_name", F.col("source_location.line").alias("line")).distinct()
    return index.enclosing_overloads(sites, named)


def _stacked(spark, d):
    u = load(spark, d, "snapshot_units").groupBy("snapshot_id", "repo_id", "unit").agg(F.max("content_hash").alias("content_hash"))
    return u.select("repo_id", "unit", "content_hash", F.col("snapshot_id").cast("int").alias("unit_version"), F.col("content_hash").isNull().alias("deleted"))


def _introduced(spark, d):
    st = _store(spark, d)
    staged = st.nodes.filter("kind = 'symbol' AND load_seq % 20 = 0 AND signature IS NOT NULL").select("unit", "qualified_name", "signature", "language")
    return gates.introduced_duplicates(st, staged)


def _checks(spark, d):
    e = load(spark, d, "events")
    return audit.check_runs(e.select(F.array(F.struct(F.col("event_type").alias("run"), (F.col("value") < 1).alias("failed"))).alias("checks")))


QUERIES = {
    "s_get_node": lambda spark, d: _store(spark, d).get_node(load(spark, d, "edges").select(F.col("dst").alias("id"))).select("id", "kind", "qualified_name"),
    "s_exists": lambda spark, d: _store(spark, d).exists(load(spark, d, "raw_symbols").filter("signature IS NOT NULL").select("signature", language_of(F.col("rel_path")).alias("language")).distinct()),
    "s_current_facts": lambda spark, d: s.current_facts(_stacked(spark, d)).select("repo_id", "unit", "content_hash", "unit_version"),
    "u_invalidated": lambda spark, d: units.invalidated(views.snapshot_delta(load(spark, d, "snapshot_units"), 103, 104), _store(spark, d).units()),
    "p_full_nodes": lambda spark, d: tools.full_nodes(_store(spark, d).nodes).select("id", "kind", "name", "visibility", "is_top_level", F.col("place.path").alias("path"), F.col("place.start_line").alias("start_line"), F.col("place.end_line").alias("end_line")),
    "p_symbol_shaped": lambda spark, d: load(spark, d, "nodes").select(F.explode(F.array("name", "signature", "qualified_name")).alias("pattern")).filter("pattern IS NOT NULL").distinct().select("pattern", tools.is_symbol_shaped(F.col("pattern")).alias("shaped")),
    "g_read_symbol": lambda spark, d: tools.read_symbols(_store(spark, d).nodes.filter("kind = 'symbol'"), _sources(spark, d)),
    "g_map_candidates": lambda spark, d: tools.map_candidates(_store(spark, d).nodes, load(spark, d, "file_facts").select(F.col("rel_path").alias("asked"))),
    "a_adjacency": lambda spark, d: views.adjacency(_store(spark, d)),
    "v_dominant_subpackages": lambda spark, d: views.dominant_subpackages(_members(spark, d)),
    "v_community_labels": lambda spark, d: views.community_labels(_members(spark, d)),
    "v_blocks": lambda spark, d: views.block_layout(views.unit_weight(_store(spark, d))),
    "v_layout": lambda spark, d: views.compute_layout(_store(spark, d)),
    "j_call_overloads": _call_overloads,
    "x_overloads": lambda spark, d: index.distinct_overloads(_raw(spark, d)).select("repo_id", "language", "qualified_name", "norm_signature", "unit", "start_line", "ordinal"),
    "x_module_owners": lambda spark, d: index.module_owners(_store(spark, d).nodes.filter("kind = 'module' AND module IS NOT NULL").select("repo_id", "language", "module", "unit")),
    "x_index_nodes": lambda spark, d: _index(spark, d)[0].groupBy("repo_id", "kind", "language").agg(F.count("*").alias("n_nodes")),
    "x_index_edges": lambda spark, d: _index(spark, d)[1].groupBy("type").agg(F.count("*").alias("n_edges")),
    "g_edges_walked": lambda spark, d: (lambda st: traverse.edges_walked(traverse.gate_edges(st.edges), st.nodes.filter("kind = 'symbol' AND load_seq % 20 = 0").select("id"), 2, False))(_store(spark, d)),
    "g_ranked_suspects": lambda spark, d: (lambda st, ch: q.ranked_suspects(st, st.nodes.filter(is_test_unit(F.col("unit")) & (F.col("kind") == "symbol")).select("id"), ch, 3))(*graph._changed(spark, d)),
    "g_tests_of_names": lambda spark, d: (lambda st: q.tests_of_names(st, st.nodes.filter("kind = 'symbol' AND load_seq % 20 = 0").select("repo_id", F.col("qualified_name").alias("name")))[0])(_store(spark, d)),
    "g_unresolved_names": lambda spark, d: (lambda st: q.tests_of_names(st, st.nodes.filter("kind = 'symbol'").select("repo_id", F.concat("name", F.lit("_of_none")).alias("name")))[1])(_store(spark, d)),
    "a_repo_totals": lambda spark, d: q.repo_totals(_store(spark, d)),
    "a_family_counts": lambda spark, d: views.family_counts(_store(spark, d)),
    "a_overflow_names": lambda spark, d: views.overflow_names(_store(spark, d), 1500),
    "j_calls_in_lines": lambda spark, d: views.calls_in_lines(_store(spark, d), load(spark, d, "edges").filter("type IN ('calls', 'references') AND confidence = 'INFERRED' AND source_location IS NOT NULL").select(F.col("source_location.path").alias("path"), F.col("source_location.line").alias("line"))),
    "k_introduced_duplicates": _introduced,
    "a_check_runs": _checks,
}


def _members(spark, d):
    n = _store(spark, d).nodes.filter(F.col("unit") != EXTERNALS_UNIT)
    return n.select(F.concat_ws(":", "repo_id", "language").alias("community"), "unit")


def _index(spark, d):
    docs = load(spark, d, "documents").select("doc_id", "repo_id", "path", "text")
    return index.index_package(_sources(spark, d), docs)


_NORM = VISIBLE + "," + norm_cte("SELECT signature, language FROM nodes")
_OF = "norm.raw = {0}.signature AND norm.l = coalesce({0}.language, 'python')"
_SUB = "CASE WHEN contains(unit, '/') THEN regexp_replace(unit, '/[^/]*$', '') ELSE unit END"
_LANG = (
    "CASE " + " ".join(f"WHEN lower({{0}}) SIMILAR TO '.*\\.({x})' THEN '{language}'" for language, x in (("python", "py|pyi"), ("typescript", "ts|tsx|mts|cts"), ("javascript", "js|jsx|mjs|cjs"), ("java", "java"), ("go", "go"), ("rust", "rs"), ("csharp", "cs"), ("c", "c|h"), ("cpp", "cpp|cxx|cc|hpp|hxx|hh"), ("kotlin", "kt|kts"), ("swift", "swift"))) + " END"
)
_UNIT = "regexp_replace(replace(rel_path, chr(92), '/'), '^(?:\\./)+', '')"
_MEMBERS = VISIBLE + f", m AS (SELECT DISTINCT repo_id || ':' || language AS community, unit, {_SUB} AS sub FROM v WHERE unit <> '<externals>'), c AS (SELECT community, sub, count(*) AS n FROM m GROUP BY ALL), dom AS (SELECT community, arg_min(sub, (-n, sub)) AS dominant, CAST(sum(n) AS BIGINT) AS n_files FROM c GROUP BY community)"
SQL = {
    "g_edges_walked": VISIBLE
    + ", dg AS (SELECT dst AS node, count(DISTINCT src) AS n FROM gate GROUP BY 1), r AS (SELECT id AS root FROM v WHERE kind = 'symbol' AND load_seq % 20 = 0), vi AS (SELECT root, root AS node FROM r UNION SELECT root, src FROM r JOIN gate ON dst = root) SELECT r.root, CAST(coalesce(sum(dg.n), 0) AS BIGINT) AS n_edges FROM r JOIN vi USING (root) LEFT JOIN dg USING (node) GROUP BY 1",
    "g_ranked_suspects": f"SELECT *, rank() OVER (PARTITION BY test ORDER BY distance, suspect) AS place FROM ({graph.SQL['g_localize']})",
    "g_tests_of_names": VISIBLE
    + f" SELECT test, unit, string_agg(symbol, ',' ORDER BY symbol) AS exercises FROM (SELECT DISTINCT a.qualified_name AS test, a.unit AS unit, c.qualified_name AS symbol FROM gate JOIN (SELECT w.* FROM v w JOIN (SELECT repo_id, qualified_name, max(load_seq) AS load_seq FROM v GROUP BY ALL) l USING (repo_id, qualified_name, load_seq) WHERE (repo_id, qualified_name) IN (SELECT (repo_id, qualified_name) FROM v WHERE kind = 'symbol' AND load_seq % 20 = 0 AND length(qualified_name) <= 512)) c ON c.id = gate.dst JOIN v a ON a.id = gate.src WHERE type IN ('calls','references','inherits','implements') AND src <> dst AND {graph._TEST.replace('unit,', 'a.unit,')}) GROUP BY 1, 2",
    "g_unresolved_names": VISIBLE + " SELECT DISTINCT repo_id, name || '_of_none' AS asked, CAST(NULL AS VARCHAR) AS candidates FROM v WHERE kind = 'symbol'",
    "a_repo_totals": VISIBLE + " SELECT repo_id, count(*) AS n_units, CAST(sum(n) AS BIGINT) AS n_symbols FROM (SELECT repo_id, unit, count(*) AS n FROM v WHERE kind = 'symbol' AND unit <> '<externals>' GROUP BY 1, 2) GROUP BY ROLLUP (repo_id)",
    "a_family_counts": VISIBLE + f" SELECT family, language, count(DISTINCT (repo_id, unit)) AS n_units, count(*) FILTER (kind = 'symbol') AS n_symbols FROM (SELECT *, {graph._FAMILY} AS family FROM v) GROUP BY 1, 2",
    "a_overflow_names": VISIBLE + " SELECT v.id, any_value(qualified_name) AS qualified_name FROM v LEFT JOIN (SELECT src AS id FROM e UNION ALL SELECT dst FROM e) d ON d.id = v.id GROUP BY 1 ORDER BY count(d.id) DESC, qualified_name, v.id LIMIT 5000 OFFSET 1500",
    "j_calls_in_lines": VISIBLE + " SELECT DISTINCT src, dst, source_location.path AS path, source_location.line AS line FROM gate WHERE type = 'calls' AND source_location IS NOT NULL AND (source_location.path, source_location.line) IN (SELECT (source_location.path, source_location.line) FROM edges WHERE type IN ('calls','references') AND confidence = 'INFERRED' AND source_location IS NOT NULL)",
    "s_get_node": VISIBLE + " SELECT id, kind, qualified_name FROM v WHERE id IN (SELECT dst FROM edges)",
    "s_exists": VISIBLE
    + f", w AS (SELECT DISTINCT signature, {_LANG.format('rel_path')} AS language FROM raw_symbols WHERE signature IS NOT NULL),"
    + norm_cte("SELECT signature, language FROM nodes UNION SELECT signature, language FROM w")
    + f" SELECT w.signature, w.language FROM w JOIN norm ON {_OF.format('w')} WHERE EXISTS (SELECT 1 FROM v JOIN norm q ON q.raw = v.signature AND q.l = coalesce(v.language, 'python') WHERE confidence = 'EXTRACTED' AND is_top_level AND v.language = w.language AND q.ns = norm.ns)",
    "s_current_facts": "WITH s AS (SELECT snapshot_id, repo_id, unit, max(content_hash) AS content_hash FROM snapshot_units GROUP BY ALL) SELECT repo_id, unit, content_hash, CAST(snapshot_id AS INTEGER) AS unit_version FROM s WHERE content_hash IS NOT NULL AND snapshot_id = (SELECT max(q.snapshot_id) FROM s q WHERE q.repo_id = s.repo_id AND q.unit = s.unit)",
    "u_invalidated": VISIBLE
    + ", o AS (SELECT DISTINCT repo_id, unit, content_hash AS h FROM snapshot_units WHERE snapshot_id = 103), n AS (SELECT DISTINCT repo_id, unit, content_hash AS h FROM snapshot_units WHERE snapshot_id = 104) SELECT DISTINCT coalesce(o.repo_id, n.repo_id) AS repo_id, coalesce(o.unit, n.unit) AS unit FROM o FULL JOIN n ON o.repo_id = n.repo_id AND o.unit = n.unit WHERE (o.unit IS NULL OR n.unit IS NULL OR o.h IS DISTINCT FROM n.h) AND (coalesce(o.repo_id, n.repo_id), coalesce(o.unit, n.unit)) IN (SELECT (repo_id, unit) FROM v)",
    "p_full_nodes": VISIBLE + " SELECT id, kind, name, visibility, is_top_level, location.path AS path, location.start_line AS start_line, location.end_line AS end_line FROM v",
    "p_symbol_shaped": "SELECT pattern, length(pattern) >= 3 AND regexp_full_match(pattern, '[A-Za-z_][A-Za-z0-9_]*(?:\\.[A-Za-z_][A-Za-z0-9_]*)*') AS shaped FROM (SELECT name AS pattern FROM nodes UNION SELECT signature FROM nodes UNION SELECT qualified_name FROM nodes) WHERE pattern IS NOT NULL",
    "g_read_symbol": VISIBLE
    + f""", f AS (SELECT DISTINCT ON (file_id) repo_id, {_UNIT} AS unit, source_text FROM (SELECT * FROM file_facts QUALIFY loaded_at IS NOT DISTINCT FROM max(loaded_at) OVER (PARTITION BY file_id))),
j AS (SELECT v.id, v.location.path AS path, greatest(1, v.location.start_line) AS lo, coalesce(v.location.end_line, v.location.start_line) AS hi, source_text, string_split(regexp_replace(source_text, '\\r\\n?', chr(10), 'g'), chr(10)) AS ls FROM v LEFT JOIN f ON f.repo_id IS NOT DISTINCT FROM v.repo_id AND f.unit = v.location.path WHERE v.kind = 'symbol'),
k AS (SELECT *, greatest(0, least(len(ls), hi) - lo + 1) AS n FROM j)
SELECT id, CASE WHEN source_text IS NOT NULL THEN array_to_string(ls[lo:(lo + least(n, 120) - 1)], chr(10)) END AS source, source_text IS NOT NULL AND n > 120 AS truncated, CASE WHEN source_text IS NULL THEN 'no text of: ' || path END AS note FROM k""",
    "g_map_candidates": VISIBLE
    + """, u AS (SELECT DISTINCT unit FROM v WHERE unit IS NOT NULL), a AS (SELECT DISTINCT rel_path AS asked FROM file_facts WHERE rel_path NOT IN (SELECT unit FROM u)),
h AS (SELECT asked, list_sort(list(unit))[:5] AS c FROM a JOIN u ON ends_with(regexp_extract(unit, '[^/]*$'), regexp_extract(asked, '[^/]*$')) GROUP BY asked)
SELECT asked, coalesce(array_to_string(c, ','), '') AS candidates FROM a LEFT JOIN h USING (asked)""",
    "a_adjacency": VISIBLE + " SELECT src AS id, dst AS other FROM e WHERE src <> dst UNION SELECT dst, src FROM e WHERE src <> dst",
    "v_dominant_subpackages": _MEMBERS + " SELECT * FROM dom",
    "v_community_labels": _MEMBERS
    + ", b AS (SELECT community, dominant || ' · ' || n_files || CASE WHEN n_files = 1 THEN ' file' ELSE ' files' END AS base FROM dom) SELECT community, CASE WHEN count(*) OVER (PARTITION BY base) > 1 THEN base || ' (#' || row_number() OVER (PARTITION BY base ORDER BY community) || ')' ELSE base END AS label FROM b",
    "v_blocks": VISIBLE
    + ", w AS (SELECT repo_id, unit, count(DISTINCT v.id) + count(d.id) AS weight FROM v LEFT JOIN (SELECT src AS id FROM e UNION ALL SELECT dst FROM e) d ON d.id = v.id GROUP BY 1, 2), k AS (SELECT *, row_number() OVER (PARTITION BY repo_id ORDER BY weight DESC, unit) - 1 AS k, CAST(ceil(sqrt(count(*) OVER (PARTITION BY repo_id))) AS BIGINT) AS c FROM w) SELECT repo_id, unit, CAST(k % c AS DOUBLE) AS x, CAST(k // c AS DOUBLE) AS y FROM k",
    "j_call_overloads": VISIBLE
    + """, n AS (SELECT repo_id, qualified_name, id, location.start_line AS lo, location.end_line AS hi FROM v WHERE kind = 'symbol'),
t AS (SELECT DISTINCT n.repo_id, n.qualified_name, e.source_location.line AS line FROM e JOIN n ON n.id = e.src WHERE e.type = 'calls' AND e.source_location IS NOT NULL)
SELECT repo_id, qualified_name, line, arg_min(id, (CASE WHEN line BETWEEN lo AND hi THEN 0 ELSE 1 END, lo, id)) AS id FROM t JOIN n USING (repo_id, qualified_name) GROUP BY ALL""",
    "x_overloads": f"WITH r AS (SELECT DISTINCT repo_id, {_LANG.format('rel_path')} AS language, qualified_name, signature, {_UNIT} AS unit, start_line FROM raw_symbols WHERE signature IS NOT NULL AND qualified_name IS NOT NULL AND start_line IS NOT NULL AND repo_id IS NOT NULL),"
    + norm_cte("SELECT signature, language FROM r WHERE language IS NOT NULL")
    + f""", g AS (SELECT repo_id, r.language, qualified_name, ns, min((unit, start_line)) AS spot FROM r JOIN norm ON {_OF.format('r')} WHERE r.language IS NOT NULL GROUP BY ALL)
SELECT repo_id, language, qualified_name, ns AS norm_signature, spot[1] AS unit, spot[2] AS start_line, CAST(CASE WHEN count(*) OVER (PARTITION BY repo_id, language, qualified_name) > 1 THEN row_number() OVER (PARTITION BY repo_id, language, qualified_name ORDER BY ns) - 1 END AS INTEGER) AS ordinal FROM g""",
    "x_module_owners": VISIBLE + " SELECT repo_id, language, module, min(unit) AS unit FROM v WHERE kind = 'module' AND module IS NOT NULL GROUP BY ALL",
    "k_introduced_duplicates": _NORM
    + f""", m AS (SELECT v.repo_id, v.language, ns, unit, qualified_name FROM v JOIN norm ON {_OF.format('v')} WHERE kind = 'symbol' AND name <> 'main' AND confidence = 'EXTRACTED' AND is_top_level),
g AS (SELECT repo_id, language, ns, count(DISTINCT qualified_name) AS n_names FROM m GROUP BY ALL HAVING count(DISTINCT qualified_name) > 1),
st AS (SELECT v.language, ns, unit, qualified_name AS staged FROM v JOIN norm ON {_OF.format('v')} WHERE kind = 'symbol' AND load_seq % 20 = 0)
SELECT g.repo_id, g.language, g.ns AS norm_signature, n_names FROM g WHERE EXISTS (SELECT 1 FROM m JOIN st ON st.language = m.language AND st.ns = m.ns AND st.unit = m.unit WHERE m.repo_id = g.repo_id AND m.language = g.language AND m.ns = g.ns AND (m.qualified_name = staged OR ends_with(m.qualified_name, '.' || staged)))""",
    "a_check_runs": "SELECT event_type AS run, count(*) AS runs, CAST(sum(CASE WHEN value < 1 THEN 1 ELSE 0 END) AS BIGINT) AS failures, count(*) >= 5 AND sum(CASE WHEN value < 1 THEN 1 ELSE 0 END) = 0 AS unfalsified FROM events GROUP BY 1",
}
