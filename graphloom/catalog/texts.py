"""Queries on source texts and documents: extraction, program analysis, diffs, references."""

from __future__ import annotations

from pyspark.sql import functions as F

from graphloom.analysis import operators as an
from graphloom.catalog.sql import VISIBLE
from graphloom.operators import gates
from graphloom.operators import store as s
from graphloom.runtime import load
from graphloom.sources import diffs, extract


def last_files(spark, d):
    """Each file once: deliveries repeat their text."""
    f = load(spark, d, "file_facts")
    # the last delivery counts: its stamp and hash are found first, so that texts are joined and not merged
    version = F.struct("loaded_at", "content_hash", F.xxhash64("rel_path", "source_text").alias("text")).alias("version")
    last = f.groupBy("file_id").agg(F.max(version).alias("version"))
    kept = f.select("file_id", "repo_id", F.col("rel_path").alias("unit"), "rel_path", "source_text", version).join(last, ["file_id", "version"], "left_semi")
    return kept.drop("version").dropDuplicates(["file_id"])


def _facts(spark, d):
    return extract.python_facts(last_files(spark, d))


def _diff_lines(spark, d):
    f = last_files(spark, d).filter("source_text LIKE '%@@%'")
    return f.select(F.col("file_id").alias("diff_id"), F.posexplode(F.split("source_text", r"\r?\n")).alias("line_no", "line"))


QUERIES = {
    "x_python_symbols": lambda spark, d: _facts(spark, d).filter("fact = 'symbol'").select("repo_id", "unit", "qualified_name", "signature", "start_line", "end_line", "visibility", "is_type_decl", "is_top_level"),
    "x_python_errors": lambda spark, d: _facts(spark, d).filter("fact = 'error'").select("repo_id", "unit", "error"),
    "x_python_edges": lambda spark, d: extract.resolve_python(_facts(spark, d)),
    "x_import_graph": lambda spark, d: extract.import_graph(_facts(spark, d)),
    "x_external_packages": lambda spark, d: extract.external_packages(extract.resolve_python(_facts(spark, d))),
    "x_definitions": lambda spark, d: extract.definitions(last_files(spark, d)),
    "x_routes": lambda spark, d: extract.declared_routes(last_files(spark, d)),
    "x_doc_references": lambda spark, d: extract.doc_references(load(spark, d, "documents"), s.visible_nodes(load(spark, d, "nodes"))),
    "w_changed_regions": lambda spark, d: diffs.changed_regions(_diff_lines(spark, d)),
    "d_control_flow": lambda spark, d: an.control_flow(last_files(spark, d)),
    "d_unreachable": lambda spark, d: an.unreachable_code(last_files(spark, d)),
    "d_post_dominators": lambda spark, d: an.post_dominance(last_files(spark, d)),
    "d_definition_uses": lambda spark, d: an.definition_uses(last_files(spark, d)),
    "d_dependences": lambda spark, d: an.dependence_edges(last_files(spark, d)),
    "d_slices": lambda spark, d: an.output_slices(last_files(spark, d)),
    "k_test_metrics": lambda spark, d: gates.test_metrics(last_files(spark, d)),
}
SQL = {
    "x_doc_references": VISIBLE
    + r""", docs AS (SELECT doc_id, repo_id, text FROM documents WHERE text IS NOT NULL AND repo_id IS NOT NULL),
sp AS (SELECT DISTINCT doc_id, repo_id, trim(regexp_replace(trim(raw), '\(\)$', '')) AS t FROM (SELECT doc_id, repo_id, unnest(regexp_extract_all(text, '`{1,2}([^`\n]+)`{1,2}', 1)) AS raw FROM docs)),
sy AS (SELECT * FROM v WHERE kind = 'symbol'), bq AS (SELECT repo_id, qualified_name AS t, arg_max(id, load_seq) AS id FROM sy GROUP BY 1, 2), bn AS (SELECT repo_id, name AS t, min(id) AS id FROM sy GROUP BY 1, 2 HAVING count(*) = 1),
li AS (SELECT DISTINCT doc_id, repo_id, regexp_replace(p, '^[./]+', '') AS t FROM (SELECT doc_id, repo_id, regexp_replace(trim(raw), '[#?\s].*$', '') AS p FROM (SELECT doc_id, repo_id, unnest(regexp_extract_all(text, '\[[^\]\n]*\]\(([^()\n]+)\)', 1)) AS raw FROM docs)) WHERE string_split(p, '.')[-1] IN ('py', 'ts', 'tsx')),
mo AS (SELECT repo_id, id, unit FROM v WHERE kind = 'module'),
lx AS (SELECT li.doc_id, li.t, li.repo_id, (SELECT min(id) FROM mo WHERE mo.repo_id = li.repo_id AND mo.unit = li.t) AS ex, (SELECT CASE WHEN count(*) = 1 THEN min(id) END FROM mo WHERE mo.repo_id = li.repo_id AND ends_with(mo.unit, '/' || li.t)) AS suf FROM li)
SELECT doc_id, coalesce(bq.id, bn.id) AS id FROM sp LEFT JOIN bq USING (repo_id, t) LEFT JOIN bn USING (repo_id, t) WHERE coalesce(bq.id, bn.id) IS NOT NULL
UNION SELECT doc_id, coalesce(ex, suf) FROM lx WHERE coalesce(ex, suf) IS NOT NULL""",
    "w_changed_regions": r"""
WITH f AS (SELECT DISTINCT ON (file_id) file_id, source_text FROM (SELECT * FROM file_facts QUALIFY loaded_at = max(loaded_at) OVER (PARTITION BY file_id)) WHERE source_text LIKE '%@@%'),
l AS (SELECT file_id AS diff_id, unnest(string_split(replace(source_text, chr(13) || chr(10), chr(10)), chr(10))) AS line, generate_subscripts(string_split(replace(source_text, chr(13) || chr(10), chr(10)), chr(10)), 1) AS no FROM f),
h AS (SELECT *, CASE WHEN starts_with(line, '+++ ') THEN CASE WHEN trim(line[5:]) = '/dev/null' THEN '' ELSE regexp_replace(trim(line[5:]), '^[ab]/', '') END END AS p FROM l),
w AS (SELECT *, last_value(p IGNORE NULLS) OVER (PARTITION BY diff_id ORDER BY no ROWS UNBOUNDED PRECEDING) AS path FROM h),
x AS (SELECT *, CAST(regexp_extract(line, '^@@ -\d+(?:,\d+)? \+(\d+)(?:,(\d+))? @@', 1) AS INTEGER) AS a, regexp_extract(line, '^@@ -\d+(?:,\d+)? \+(\d+)(?:,(\d+))? @@', 2) AS c FROM w WHERE regexp_matches(line, '^@@ -\d+(?:,\d+)? \+(\d+)(?:,(\d+))? @@'))
SELECT diff_id, path, a AS start_line, CAST(a + CASE WHEN c = '' THEN 1 ELSE CAST(c AS INTEGER) END - 1 AS INTEGER) AS end_line FROM x WHERE path <> '' AND (c = '' OR CAST(nullif(c, '') AS INTEGER) > 0)""",
}
