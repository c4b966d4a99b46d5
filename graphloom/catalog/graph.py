"""Queries on the code graph."""

from __future__ import annotations

from pyspark.sql import functions as F

from graphloom.catalog.sql import VISIBLE, reach
from graphloom.functions.paths import SUFFIXES, family_of, is_test_unit, language_of, module_qname, posix
from graphloom.operators import queries as q
from graphloom.operators import store as s
from graphloom.operators import traverse as t
from graphloom.operators import views
from graphloom.runtime import load


def _store(spark, d):
    return s.GraphStore(load(spark, d, "nodes"), load(spark, d, "edges"))


def _roots(store):
    return store.nodes.filter((F.col("kind") == "symbol") & (F.col("load_seq") % 20 == 0)).select("id")


def _regions(spark, d):
    e = load(spark, d, "edges")
    line = F.col("source_location.line")
    return e.filter("source_location IS NOT NULL").select(F.col("source_location.path").alias("path"), line.alias("start_line"), (line + 2).alias("end_line"))


def _changed(spark, d):
    store = _store(spark, d)
    return store, q.changed_symbols(store, _regions(spark, d))


def _with(f):
    return lambda spark, d: f(_store(spark, d))


_ROOTS = "SELECT id FROM v WHERE kind = 'symbol' AND load_seq % 20 = 0"
_CHANGED = (
    VISIBLE
    + """,
reg AS (SELECT DISTINCT source_location.path AS path, source_location.line AS a, source_location.line + 2 AS b FROM edges WHERE source_location IS NOT NULL),
hit AS (SELECT DISTINCT v.* FROM v JOIN reg ON v.location.path = reg.path AND v.location.start_line <= b AND a <= greatest(v.location.start_line, coalesce(v.location.end_line, v.location.start_line))),
changed AS (SELECT id, repo_id, qualified_name, unit FROM hit WHERE kind = 'symbol')"""
)
_TEST = r"(regexp_matches(unit, '(?:^|/)(?:tests|test|__tests__)/') OR regexp_matches(regexp_extract(unit, '[^/]*$'), '^conftest\.py$|^test_|_test\.(?:py|go|c|cc|cpp|cxx)$|(?:Test|Tests|IT)\.java$|^Test.*\.java$|Tests?\.(?:cs|kt|swift)$|\.test\.|\.spec\.'))"
_REF = "('calls','references','imports','inherits','implements')"
_EXE = "('calls','references','inherits','implements')"

QUERIES = {
    "g_blast_radius": _with(lambda st: q.blast_radius(st, _roots(st), 3)),
    "g_callees": _with(lambda st: q.callees(st, _roots(st), 2)),
    "s_visible_nodes": _with(lambda st: st.nodes.select("id", "unit", "load_seq")),
    "s_hidden_loads": lambda spark, d: s.hidden_loads(load(spark, d, "nodes")),
    "s_get_symbol": _with(lambda st: st.get_symbol().select("repo_id", "qualified_name", "id")),
    "s_units": _with(lambda st: st.units()),
    "s_edge_count": _with(lambda st: st.edges.groupBy("type", "confidence").agg(F.count("*").alias("n_edges"))),
    "s_unit_facts": _with(lambda st: st.unit_facts()),
    "s_neighbors": _with(lambda st: st.neighbors().groupBy("node", "direction", "type").agg(F.count("*").alias("n_edges"), F.count_distinct("other").alias("n_others"))),
    "s_neighbors_filtered": _with(lambda st: st.neighbors(("calls", "inherits"), ("INFERRED", "AMBIGUOUS"), "in")),
    "s_changed_set": lambda spark, d: _store(spark, d).changed_set(_regions(spark, d)),
    "s_subgraph": _with(lambda st: st.subgraph(st.nodes.filter("visibility = 'exported'"), ("calls", "references"), ("EXTRACTED",))[1].select("type", "src", "dst", "unit", F.col("source_location.line").alias("line"))),
    "s_repeated_ids": lambda spark, d: s.repeated_ids(load(spark, d, "nodes")),
    "s_find_by_signature": _with(lambda st: st.find_symbols_by_signature(st.nodes.filter(F.col("load_seq") % 20 == 0).filter("signature IS NOT NULL").select("signature", "language").distinct()).select("asked", "language", "id")),
    "s_overload_ordinals": _with(lambda st: s.overload_ordinals(st.nodes)),
    "p_brief": _with(lambda st: q.brief(st.nodes)),
    "p_test_units": _with(lambda st: st.units().filter(is_test_unit(F.col("unit")))),
    "f_paths": lambda spark, d: load(spark, d, "file_facts").select("rel_path").distinct().select("rel_path", posix(F.col("rel_path")).alias("unit"), language_of(F.col("rel_path")).alias("language"), module_qname(posix(F.col("rel_path")), language_of(F.col("rel_path"))).alias("module"), family_of(posix(F.col("rel_path"))).alias("family")),
    "g_find_references": _with(q.find_references),
    "g_implementations": _with(q.implementations),
    "g_changed_symbols": lambda spark, d: _changed(spark, d)[1],
    "g_suggest_tests": lambda spark, d: q.suggest_tests(*_changed(spark, d)),
    "g_affected": lambda spark, d: q.affected_by(*_changed(spark, d)),
    "g_impact": lambda spark, d: q.impact_summary(*_changed(spark, d)),
    "g_localize": lambda spark, d: (lambda st, ch: q.localize(st, st.nodes.filter(is_test_unit(F.col("unit")) & (F.col("kind") == "symbol")).select("id"), ch, 3))(*_changed(spark, d)),
    "g_dead_code": _with(q.dead_code),
    "g_repo_map": _with(q.repo_map),
    "g_unit_dependents": _with(q.unit_dependents),
    "g_owning_modules": _with(lambda st: q.owning_modules(st.nodes)),
    "g_module_graph": _with(q.module_graph),
    "g_cycles": _with(lambda st: t.simple_cycles(views.unit_edges(st)).select(F.array_join("cycle", ">").alias("cycle"))),
    "g_import_cycles": _with(lambda st: t.truncated_cycles(q.module_graph(st)).select(F.array_join("cycle", ">").alias("cycle"), "truncated")),
    "g_layers": _with(lambda st: t.layers(views.unit_edges(st), views.unit_nodes(st))),
    "g_duplicate_bodies": _with(lambda st: q.duplicate_bodies(st.nodes)),
    "g_duplicate_signatures": _with(lambda st: q.duplicate_signatures(st.nodes)),
    "g_check_duplicate": _with(lambda st: q.check_duplicates(st, st.nodes.filter("kind = 'symbol' AND signature IS NOT NULL").select(F.col("id").alias("key"), "signature", "language", F.col("unit").alias("exclude_unit"), "body_hash", "is_type_decl"))),
    "g_check_contract": lambda spark, d: q.check_contracts(_store(spark, d), load(spark, d, "nodes").filter("kind = 'symbol'").select(F.col("load_seq").cast("string").alias("key"), "repo_id", "qualified_name", F.col("signature").alias("new_signature"), F.col("visibility").alias("new_visibility"))),
    "g_resolve_names": _with(lambda st: q.resolve_names(st.nodes, st.nodes.filter("kind = 'symbol'").select("repo_id", F.substring_index("qualified_name", ".", -2).alias("name")))),
    "a_file_graph": _with(views.file_graph),
    "a_family_matrix": _with(views.family_matrix),
    "a_subpackage_matrix": _with(views.subpackage_matrix),
    "a_degrees": _with(views.degrees),
    "a_top_nodes": _with(lambda st: views.top_nodes(st, 1500)),
    "a_heaviest_edges": _with(lambda st: views.heaviest_edges(st, 400)),
    "a_multiplicity": _with(views.multiplicity),
    "a_unit_weight": _with(views.unit_weight),
    "a_counts": _with(views.language_counts),
    "a_ring_positions": _with(views.ring_positions),
    "v_communities": _with(views.communities),
    "v_labels": _with(views.label_centroids),
    "u_snapshot_delta": lambda spark, d: views.snapshot_delta(load(spark, d, "snapshot_units"), 101, 104),
    "j_call_sites": _with(views.call_sites),
    "j_sites_in_spans": _with(views.sites_in_spans),
}
_PAIR = " FROM e JOIN v a ON a.id = e.src JOIN v b ON b.id = e.dst"
_FILE = VISIBLE + ", ue AS (SELECT a.repo_id || '/' || a.unit AS src, b.repo_id || '/' || b.unit AS dst, count(*) AS weight" + _PAIR + " WHERE e.type IN ('calls','imports','references','inherits') AND (a.repo_id <> b.repo_id OR a.unit <> b.unit) AND b.unit <> '<externals>' GROUP BY 1, 2)"
_PARTS = "string_split(lower(unit), '/')"
_FAMILY = f"""CASE WHEN unit = '<externals>' THEN 'external'
 WHEN regexp_matches(lower(regexp_extract(unit, '[^/]*$')), '^(?:test_[^/]*|[^/]*_test\\.[^/.]+|conftest\\.py)$') THEN 'tests'
 WHEN lower(regexp_extract(unit, '[^/]*$')) IN ('setup.py', 'noxfile.py') THEN 'ci'
 WHEN list_has_any({_PARTS}[2:-2], ['tests','test','testing']) THEN 'tests'
 WHEN list_has_any({_PARTS}[2:-2], ['ci','hooks']) OR len(list_filter({_PARTS}[2:-2], lambda x: x[1] = '.')) > 0 THEN 'ci'
 WHEN list_has_any({_PARTS}[2:-2], ['docs','doc']) THEN 'docs'
 WHEN list_has_any({_PARTS}[2:-2], ['examples','example','samples','sample','demos','demo','evaluation','benchmarks','benchmark']) THEN 'examples'
 WHEN list_has_any({_PARTS}[2:-2], ['scripts','script','tools','tool','bin']) THEN 'scripts' ELSE 'core' END"""
_SUB = "CASE WHEN contains(unit, '/') THEN regexp_replace(unit, '/[^/]*$', '') ELSE unit END"

_CLOSURE = _FILE.replace("\nWITH", "\nWITH RECURSIVE", 1) + """, rc AS (SELECT src AS a, dst AS b FROM ue UNION SELECT r.a, u.dst FROM rc r JOIN ue u ON u.src = r.b),
core AS (SELECT ue.src, ue.dst FROM ue JOIN rc ON rc.a = ue.dst AND rc.b = ue.src)"""
_IMPORT_CLOSURE = VISIBLE.replace("\nWITH", "\nWITH RECURSIVE", 1) + """, own AS (SELECT n.id, arg_max(m.id, (length(m.qualified_name), m.id)) AS module_id FROM v n JOIN v m ON m.kind = 'module' AND m.repo_id = n.repo_id AND (n.qualified_name = m.qualified_name OR starts_with(n.qualified_name, m.qualified_name || '.')) WHERE n.kind IN ('module','symbol') GROUP BY 1),
ue AS (SELECT DISTINCT a.module_id AS src, b.module_id AS dst FROM gate JOIN own a ON a.id = gate.src JOIN own b ON b.id = gate.dst WHERE type = 'imports' AND a.module_id <> b.module_id),
rc AS (SELECT src AS a, dst AS b FROM ue UNION SELECT r.a, u.dst FROM rc r JOIN ue u ON u.src = r.b),
core AS (SELECT ue.src, ue.dst FROM ue JOIN rc ON rc.a = ue.dst AND rc.b = ue.src)"""
_LANGUAGE = " ".join(f"WHEN regexp_matches(lower(rel_path), '(?:{'|'.join(x.replace('.', chr(92) + '.') for x in suffixes)})$') THEN '{language}'" for language, suffixes in reversed(SUFFIXES.items()))

SQL = {
    "g_blast_radius": VISIBLE + ",\n" + reach("r", "SELECT * FROM gate", _ROOTS, 3, False) + " SELECT * FROM r",
    "g_callees": VISIBLE + ",\n" + reach("r", "SELECT * FROM gate", _ROOTS, 2, True) + " SELECT * FROM r",
    "s_visible_nodes": VISIBLE + " SELECT id, unit, load_seq FROM v",
    "s_hidden_loads": "SELECT id, load_seq FROM nodes QUALIFY load_seq < max(load_seq) OVER (PARTITION BY id)",
    "s_get_symbol": VISIBLE + " SELECT repo_id, qualified_name, arg_max(id, load_seq) AS id FROM v GROUP BY 1, 2",
    "s_units": VISIBLE + " SELECT DISTINCT repo_id, unit FROM v",
    "s_edge_count": VISIBLE + " SELECT type, confidence, count(*) AS n_edges FROM e GROUP BY 1, 2",
    "s_unit_facts": VISIBLE + " SELECT coalesce(n.repo_id, x.repo_id) AS repo_id, coalesce(n.unit, x.unit) AS unit, coalesce(n.c, 0) AS n_nodes, coalesce(x.c, 0) AS n_edges FROM (SELECT repo_id, unit, count(*) c FROM v GROUP BY 1, 2) n FULL JOIN (SELECT v.repo_id, e.unit, count(*) c FROM e JOIN v ON v.id = e.src GROUP BY 1, 2) x ON n.unit IS NOT DISTINCT FROM x.unit AND n.repo_id IS NOT DISTINCT FROM x.repo_id",
    "s_neighbors": VISIBLE + " SELECT node, direction, type, count(*) AS n_edges, count(DISTINCT other) AS n_others FROM (SELECT src AS node, 'out' AS direction, type, dst AS other FROM e UNION ALL SELECT dst, 'in', type, src FROM e) GROUP BY 1, 2, 3",
    "s_neighbors_filtered": VISIBLE + " SELECT dst AS node, 'in' AS direction, type, src AS other FROM e WHERE type IN ('calls','inherits') AND confidence IN ('INFERRED','AMBIGUOUS')",
    "s_changed_set": _CHANGED + " SELECT DISTINCT id FROM hit",
    "s_subgraph": VISIBLE + " SELECT type, src, dst, unit, source_location.line AS line FROM e WHERE type IN ('calls','references') AND confidence = 'EXTRACTED' AND src IN (SELECT id FROM v WHERE visibility = 'exported') AND dst IN (SELECT id FROM v WHERE visibility = 'exported')",
    "s_repeated_ids": "SELECT id, count(DISTINCT unit) AS n_units FROM nodes GROUP BY 1 HAVING count(DISTINCT unit) > 1",
    "p_brief": VISIBLE + " SELECT repo_id, qualified_name, kind, unit, location.path || ':' || location.start_line AS place, signature FROM v",
    "p_test_units": VISIBLE + f" SELECT DISTINCT repo_id, unit FROM v WHERE {_TEST}",
    "g_find_references": VISIBLE
    + f" SELECT dst, src, b.qualified_name AS target, a.qualified_name AS caller, coalesce(string_agg(site, ',' ORDER BY site), '') AS sites FROM (SELECT DISTINCT dst, src, source_location.path || ':' || source_location.line AS site FROM gate WHERE type IN {_REF} AND src <> dst) x JOIN v a ON a.id = src JOIN v b ON b.id = dst GROUP BY 1, 2, 3, 4",
    "g_implementations": VISIBLE + " SELECT DISTINCT dst AS base, src AS implementation FROM gate WHERE type IN ('inherits','implements') AND src <> dst",
    "g_changed_symbols": _CHANGED + " SELECT id, repo_id, qualified_name, unit FROM changed",
    "g_suggest_tests": _CHANGED + f" SELECT test, unit, string_agg(symbol, ',' ORDER BY symbol) AS exercises FROM (SELECT DISTINCT a.qualified_name AS test, a.unit AS unit, c.qualified_name AS symbol FROM gate JOIN changed c ON c.id = gate.dst JOIN v a ON a.id = gate.src WHERE type IN {_EXE} AND src <> dst AND {_TEST.replace('unit,', 'a.unit,')}) GROUP BY 1, 2",
    "g_affected": _CHANGED + f" SELECT DISTINCT a.repo_id, a.qualified_name FROM gate JOIN changed c ON c.id = gate.dst JOIN v a ON a.id = gate.src WHERE type IN {_REF} AND src <> dst AND NOT EXISTS (SELECT 1 FROM changed k WHERE k.repo_id = a.repo_id AND k.qualified_name = a.qualified_name)",
    "g_impact": _CHANGED
    + f""", aff AS (SELECT DISTINCT a.repo_id, a.qualified_name FROM gate JOIN changed c ON c.id = gate.dst JOIN v a ON a.id = gate.src WHERE type IN {_REF} AND src <> dst AND NOT EXISTS (SELECT 1 FROM changed k WHERE k.repo_id = a.repo_id AND k.qualified_name = a.qualified_name)),
tst AS (SELECT DISTINCT a.qualified_name, a.unit FROM gate JOIN changed c ON c.id = gate.dst JOIN v a ON a.id = gate.src WHERE type IN {_EXE} AND src <> dst AND {_TEST.replace('unit,', 'a.unit,')})
SELECT (SELECT count(*) FROM (SELECT DISTINCT repo_id, qualified_name FROM changed)) AS changed, (SELECT count(*) FROM aff) AS affected, (SELECT count(*) FROM tst) AS tests,
       (SELECT count(DISTINCT src) FROM e JOIN changed c ON c.id = e.dst WHERE type = 'documents' AND confidence = 'EXTRACTED') AS docs""",
    "g_localize": _CHANGED + ",\n" + reach("r", f"SELECT * FROM gate WHERE type IN {_EXE}", f"SELECT id FROM v WHERE kind = 'symbol' AND {_TEST}", 3, True) + " SELECT root AS test, qualified_name AS suspect, distance FROM r JOIN changed c ON c.id = r.node",
    "g_dead_code": VISIBLE
    + f""" SELECT repo_id, id, qualified_name, location.path || ':' || location.start_line AS place FROM v WHERE kind = 'symbol' AND confidence = 'EXTRACTED' AND visibility = 'internal' AND name <> 'main' AND NOT regexp_matches(name, '^__.*__$')
AND NOT (regexp_matches(lower(replace(coalesce(location.path, unit), '\\', '/')), '/tests?/') OR regexp_matches(regexp_extract(lower(replace(coalesce(location.path, unit), '\\', '/')), '[^/]*$'), '^test_|^conftest|_test\\.|\\.test\\.|\\.spec\\.'))
AND id IN (SELECT dst FROM e JOIN v m ON m.id = e.src WHERE e.type = 'defines' AND m.kind = 'module') AND id NOT IN (SELECT dst FROM e WHERE type IN {_REF})""",
    "g_repo_map": VISIBLE
    + """, s AS (SELECT * FROM v WHERE kind = 'symbol' AND unit <> '<externals>'),
x AS (SELECT *, row_number() OVER (PARTITION BY repo_id, unit ORDER BY qualified_name, id) AS k FROM s WHERE visibility <> 'internal' AND is_top_level),
y AS (SELECT repo_id, unit, count(*) AS n, string_agg(CASE WHEN k <= 8 THEN qualified_name END, ',' ORDER BY qualified_name) AS exports FROM x GROUP BY 1, 2)
SELECT s.repo_id, s.unit, count(*) AS n_symbols, coalesce(any_value(exports), '') AS exports, greatest(coalesce(any_value(n), 0) - 8, 0) AS more FROM s LEFT JOIN y ON s.repo_id = y.repo_id AND s.unit = y.unit GROUP BY 1, 2""",
    "g_unit_dependents": VISIBLE + " SELECT DISTINCT b.repo_id, b.unit, a.unit AS dependent FROM gate JOIN v a ON a.id = src JOIN v b ON b.id = dst WHERE type = 'imports' AND a.unit <> b.unit AND b.unit <> '<externals>'",
    "g_owning_modules": VISIBLE + " SELECT n.id, arg_max(m.id, (length(m.qualified_name), m.id)) AS module_id FROM v n JOIN v m ON m.kind = 'module' AND m.repo_id = n.repo_id AND (n.qualified_name = m.qualified_name OR starts_with(n.qualified_name, m.qualified_name || '.')) WHERE n.kind IN ('module','symbol') GROUP BY 1",
    "g_module_graph": VISIBLE
    + """, own AS (SELECT n.id, arg_max(m.id, (length(m.qualified_name), m.id)) AS module_id FROM v n JOIN v m ON m.kind = 'module' AND m.repo_id = n.repo_id AND (n.qualified_name = m.qualified_name OR starts_with(n.qualified_name, m.qualified_name || '.')) WHERE n.kind IN ('module','symbol') GROUP BY 1)
SELECT DISTINCT a.module_id AS src, b.module_id AS dst FROM gate JOIN own a ON a.id = gate.src JOIN own b ON b.id = gate.dst WHERE type = 'imports' AND a.module_id <> b.module_id""",
    "g_duplicate_bodies": VISIBLE
    + " SELECT repo_id, body_hash, string_agg(q, ',' ORDER BY q) AS names, CAST(count(*) AS INTEGER) AS n_names FROM (SELECT DISTINCT repo_id, body_hash, qualified_name AS q FROM v WHERE kind = 'symbol' AND confidence = 'EXTRACTED' AND body_hash IS NOT NULL AND location.end_line - location.start_line + 1 >= 3) GROUP BY 1, 2 HAVING count(*) > 1",
    "a_file_graph": _FILE + " SELECT * FROM ue",
    "a_family_matrix": VISIBLE + f", f AS (SELECT id, {_FAMILY} AS fam FROM v) SELECT a.fam AS src_family, b.fam AS dst_family, type, count(*) AS n_edges FROM e JOIN f a ON a.id = src JOIN f b ON b.id = dst WHERE type <> 'defines' AND a.fam <> b.fam GROUP BY 1, 2, 3",
    "a_subpackage_matrix": VISIBLE + f", f AS (SELECT id, {_FAMILY} AS fam, {_SUB} AS sub FROM v) SELECT a.fam AS family, a.sub AS src_sub, b.sub AS dst_sub, count(*) AS n_edges FROM e JOIN f a ON a.id = src JOIN f b ON b.id = dst WHERE type <> 'defines' AND a.fam = b.fam AND a.sub <> b.sub GROUP BY 1, 2, 3",
    "a_degrees": VISIBLE + " SELECT v.id, count(d.id) AS degree FROM v LEFT JOIN (SELECT src AS id FROM e UNION ALL SELECT dst FROM e) d ON d.id = v.id GROUP BY 1",
    "a_top_nodes": VISIBLE + " SELECT v.id, any_value(qualified_name) AS qualified_name, count(d.id) AS degree FROM v LEFT JOIN (SELECT src AS id FROM e UNION ALL SELECT dst FROM e) d ON d.id = v.id GROUP BY 1 ORDER BY degree DESC, qualified_name, v.id LIMIT 1500",
    "a_heaviest_edges": _FILE + " SELECT * FROM ue ORDER BY weight DESC, src, dst LIMIT 400",
    "a_multiplicity": VISIBLE + " SELECT src, dst, type, count(*) AS n_edges FROM e GROUP BY 1, 2, 3",
    "a_unit_weight": VISIBLE + " SELECT repo_id, unit, count(DISTINCT v.id) + count(d.id) AS weight FROM v LEFT JOIN (SELECT src AS id FROM e UNION ALL SELECT dst FROM e) d ON d.id = v.id GROUP BY 1, 2",
    "a_counts": VISIBLE + " SELECT repo_id, language, count(*) AS n_symbols FROM v WHERE kind = 'symbol' GROUP BY 1, 2",
    "a_ring_positions": VISIBLE + " SELECT id, repo_id, unit, CAST(row_number() OVER (PARTITION BY repo_id, unit ORDER BY NOT is_top_level, qualified_name, id) - 1 AS INTEGER) AS position, count(*) OVER (PARTITION BY repo_id, unit) AS n FROM v",
    "u_snapshot_delta": "SELECT coalesce(o.repo_id, n.repo_id) AS repo_id, coalesce(o.unit, n.unit) AS unit, CASE WHEN o.unit IS NULL THEN 'added' WHEN n.unit IS NULL THEN 'deleted' ELSE 'modified' END AS change FROM (SELECT DISTINCT repo_id, unit, content_hash AS h FROM snapshot_units WHERE snapshot_id = 101) o FULL JOIN (SELECT DISTINCT repo_id, unit, content_hash AS h FROM snapshot_units WHERE snapshot_id = 104) n ON o.repo_id = n.repo_id AND o.unit = n.unit WHERE o.unit IS NULL OR n.unit IS NULL OR o.h IS DISTINCT FROM n.h",
    "j_call_sites": VISIBLE + " SELECT src, source_location.path AS path, source_location.line AS line, count(DISTINCT dst) AS n_callees FROM gate WHERE type = 'calls' AND source_location IS NOT NULL GROUP BY 1, 2, 3",
    "j_sites_in_spans": VISIBLE
    + """, site AS (SELECT DISTINCT a.repo_id, source_location.path AS path, source_location.line AS line FROM e JOIN v a ON a.id = e.src WHERE source_location IS NOT NULL)
SELECT site.repo_id, site.path, site.line, arg_min(v.id, (greatest(location.end_line, location.start_line) - location.start_line, v.id)) AS id FROM site JOIN v ON v.kind = 'symbol' AND v.repo_id = site.repo_id AND v.location.path = site.path AND site.line BETWEEN location.start_line AND location.end_line GROUP BY 1, 2, 3""",
    "g_cycles": _CLOSURE
    + """, paths AS (SELECT src AS f, dst AS l, [src, dst] AS path FROM core WHERE dst > src UNION ALL SELECT f, c.dst, list_append(path, c.dst) FROM paths p JOIN core c ON c.src = p.l WHERE c.dst > f AND NOT list_contains(path, c.dst) AND len(path) < 16)
SELECT DISTINCT array_to_string(path, '>') AS cycle FROM paths JOIN core ON core.src = l AND core.dst = f ORDER BY 1 LIMIT 1000""",
    "g_import_cycles": _IMPORT_CLOSURE
    + """, paths AS (SELECT src AS f, dst AS l, [src, dst] AS path FROM core WHERE dst > src UNION ALL SELECT f, c.dst, list_append(path, c.dst) FROM paths p JOIN core c ON c.src = p.l WHERE c.dst > f AND NOT list_contains(path, c.dst) AND len(path) < 16)
, cycles AS (SELECT DISTINCT path FROM paths JOIN core ON core.src = l AND core.dst = f),
members AS (SELECT DISTINCT r.a AS node, (SELECT min(o.b) FROM rc o JOIN rc i ON i.a = o.b AND i.b = o.a WHERE o.a = r.a) AS c FROM rc r WHERE r.a = r.b),
whole AS (SELECT list(node ORDER BY node) AS path FROM members GROUP BY c HAVING NOT bool_or(node IN (SELECT unnest(path) FROM cycles)))
SELECT array_to_string(path, '>') AS cycle, count(*) OVER () > 1000 AS truncated FROM (SELECT path FROM cycles UNION ALL SELECT path FROM whole) ORDER BY path LIMIT 1000""",
    "g_layers": _CLOSURE
    + """, n AS (SELECT DISTINCT repo_id || '/' || unit AS node FROM v WHERE unit <> '<externals>'),
comp AS (SELECT node, least(node, coalesce((SELECT min(r.b) FROM rc r JOIN rc q ON q.a = r.b AND q.b = r.a WHERE r.a = n.node), node)) AS c FROM n),
dag AS (SELECT DISTINCT a.c AS a, b.c AS b FROM ue JOIN comp a ON a.node = ue.src JOIN comp b ON b.node = ue.dst WHERE a.c <> b.c),
up AS (SELECT DISTINCT c, 0 AS k FROM comp UNION SELECT dag.b, k + 1 FROM up JOIN dag ON dag.a = up.c)
SELECT node, CAST((SELECT max(k) FROM up WHERE up.c = comp.c) AS INTEGER) AS layer FROM comp""",
    "f_paths": f"""
WITH f AS (SELECT DISTINCT rel_path, regexp_replace(replace(rel_path, '\\', '/'), '^(?:\\./)+', '') AS unit FROM file_facts),
l AS (SELECT *, CASE {_LANGUAGE} END AS language, string_split(regexp_replace(unit, '\\.[^./]+$', ''), '/') AS p FROM f)
SELECT rel_path, unit, language, array_to_string(list_filter(list_concat(CASE WHEN language = 'rust' THEN ['crate'] ELSE [] END,
  CASE WHEN (language = 'python' AND p[-1] = '__init__') OR (language IN ('typescript','javascript') AND p[-1] = 'index') OR (language = 'rust' AND p[-1] IN ('mod','lib','main')) OR language IN ('java','go') THEN p[:-2] ELSE p END), lambda x: x <> ''), '.') AS module,
  {_FAMILY} AS family FROM l""",
}
