"""Queries on names and signatures, with SQL that has a normal form of signatures of its own."""

from __future__ import annotations

from pyspark.sql import functions as F

from graphloom.catalog.signature_sql import norm_cte
from graphloom.catalog.sql import VISIBLE
from graphloom.functions import paths as p
from graphloom.functions.signatures import normalize_signature
from graphloom.operators import navmap
from graphloom.runtime import load


def _signatures(spark, d):
    n = load(spark, d, "nodes").filter("signature IS NOT NULL").select("signature", F.coalesce("language", F.lit("python")).alias("language")).distinct()
    return n.withColumn("norm_signature", normalize_signature("signature", "language"))


def _units(spark, d):
    return load(spark, d, "file_facts").select(p.posix(F.col("rel_path")).alias("unit")).distinct()


def _names(spark, d):
    u = F.col("unit")
    name = p.base_name(u)
    return _units(spark, d).select("unit", p.module_name_for(u).alias("import_name"), p.visibility_of(name).alias("visibility"), p.is_test_path_commit(u).alias("is_commit_test"), p.is_test_path_dead_code(u).alias("is_dead_code_test"), p.subpackage(u).alias("subpackage"))


def _urls(spark, d):
    pattern = F.concat(F.lit("/"), F.regexp_replace("unit", "/", "/:"))
    u = _units(spark, d).select("unit", pattern.alias("pattern"))
    c = F.col("pattern")
    return u.select("pattern", p.url_regex(c).alias("regex"), p.url_params(c).alias("n_params"), p.state_id(c).alias("state"), p.href_matches(F.concat(F.lit("/"), "unit", F.lit("/")), c).alias("matches"), p.hash_route(c).alias("hashed"))


def _pages(spark, d):
    u = _units(spark, d)
    page = F.concat(F.lit("app/(group)/"), F.regexp_replace("unit", r"([^/]+)\.[^./]+$", "[$1]"), F.lit("/page.tsx"))
    return u.select("unit", p.nextjs_pattern(page).alias("pattern"), p.join_route(F.lit("/root/"), F.substring_index("unit", "/", 1)).alias("joined"))


def _draft(spark, d):
    n = load(spark, d, "nodes").filter("kind = 'symbol'")
    pattern = F.concat(F.lit("/"), "language", F.when(F.length("name") % 2 == 0, "/:").otherwise("/"), F.substring("name", 1, 3))
    return navmap.draft_map(n.select(F.col("repo_id").alias("map_id"), pattern.alias("pattern")))


QUERIES = {"f_signatures": _signatures, "f_names": _names, "f_urls": _urls, "f_pages": _pages, "w_draft_map": _draft}

_NORM = VISIBLE + "," + norm_cte("SELECT signature, language FROM nodes")
_OF = "norm.raw = {0}.signature AND norm.l = coalesce({0}.language, 'python')"
_GATE = _NORM + f", gs AS (SELECT v.*, ns FROM v JOIN norm ON {_OF.format('v')} WHERE confidence = 'EXTRACTED' AND is_top_level)"
_PLACE = "{0}.location.path || ':' || {0}.location.start_line"
_RANK = "CASE {0} WHEN 'internal' THEN 0 WHEN 'exported' THEN 1 WHEN 'public' THEN 2 END"

_UNITS = "u AS (SELECT DISTINCT regexp_replace(replace(rel_path, chr(92), '/'), '^(?:\\./)+', '') AS unit FROM file_facts)"
SQL = {
    "f_names": f"""WITH {_UNITS}, b AS (SELECT unit, regexp_extract(unit, '[^/]*$') AS n, lower(unit) AS low FROM u)
SELECT unit, regexp_replace(replace(regexp_replace(regexp_replace(unit, '\\.py$', ''), '^src/', ''), '/', '.'), '(?:^|\\.)__init__$', '') AS import_name, CASE WHEN starts_with(n, '_') THEN 'internal' ELSE 'exported' END AS visibility,
  NOT contains('/' || unit || '/', '/fixtures/') AND (starts_with(n, 'test_') OR ends_with(n, '_test.py') OR contains('/' || unit, '/tests/')) AS is_commit_test,
  regexp_matches(low, '/tests?/') OR regexp_matches(regexp_extract(low, '[^/]*$'), '^test_|^conftest|_test\\.|\\.test\\.|\\.spec\\.') AS is_dead_code_test, CASE WHEN contains(unit, '/') THEN regexp_replace(unit, '/[^/]*$', '') ELSE unit END AS subpackage FROM b""",
    "f_urls": f"""WITH {_UNITS}, p AS (SELECT unit, '/' || replace(unit, '/', '/:') AS pattern FROM u)
SELECT pattern, '^' || regexp_replace(regexp_replace(pattern, '([.+*?^$()\\[\\]{{}}|\\\\])', '\\\\\\1', 'g'), '/:\\w+', '/[^/]+', 'g') || '$' AS regex, CAST(len(regexp_extract_all(split_part(pattern, '#', 1), '/:\\w+')) AS INTEGER) AS n_params,
  array_to_string(list_transform(list_filter(string_split(pattern, '/'), lambda s: s <> ''), lambda s: regexp_replace(s, '^:', '')), '.') AS state, true AS matches, '/#' || pattern AS hashed FROM p""",
    "f_pages": f"""WITH {_UNITS}
SELECT unit, '/' || array_to_string(list_transform(string_split(unit, '/'), lambda s, i: CASE WHEN i = len(string_split(unit, '/')) THEN ':' || regexp_replace(s, '\\.[^./]+$', '') ELSE s END), '/') AS pattern, '/root/' || split_part(unit, '/', 1) AS joined FROM u""",
    "w_draft_map": """WITH r AS (SELECT DISTINCT repo_id AS map_id, '/' || language || CASE WHEN length(name) % 2 = 0 THEN '/:' ELSE '/' END || name[1:3] AS url, language || '.' || name[1:3] AS base FROM nodes WHERE kind = 'symbol')
SELECT map_id, CASE WHEN row_number() OVER w > 1 THEN base || '~' || row_number() OVER w ELSE base END AS id, url FROM r WINDOW w AS (PARTITION BY map_id, base ORDER BY url)""",
    "f_signatures": "WITH" + norm_cte("SELECT signature, language FROM nodes") + " SELECT raw AS signature, l AS language, ns AS norm_signature FROM norm",
    "s_find_by_signature": _GATE + f" SELECT a.signature AS asked, gs.language, gs.id FROM (SELECT DISTINCT signature, language FROM v WHERE load_seq % 20 = 0 AND signature IS NOT NULL) a JOIN norm ON {_OF.format('a')} JOIN gs ON gs.language = a.language AND gs.ns = norm.ns",
    "s_overload_ordinals": _NORM
    + f""", sy AS (SELECT v.id, v.repo_id, v.language, v.qualified_name, ns FROM v JOIN norm ON {_OF.format('v')} WHERE kind = 'symbol'),
rk AS (SELECT *, CASE WHEN count(*) OVER w > 1 THEN row_number() OVER (PARTITION BY repo_id, language, qualified_name ORDER BY ns) - 1 END AS ordinal FROM (SELECT DISTINCT repo_id, language, qualified_name, ns FROM sy) WINDOW w AS (PARTITION BY repo_id, language, qualified_name))
SELECT id, CAST(ordinal AS INTEGER) AS ordinal FROM sy JOIN rk USING (repo_id, language, qualified_name, ns)""",
    "g_duplicate_signatures": _NORM
    + f""", k AS (SELECT v.repo_id, v.language, ns, qualified_name, body_hash, coalesce(is_type_decl, false) AS ty FROM v JOIN norm ON {_OF.format('v')} WHERE kind = 'symbol' AND is_top_level AND name <> 'main'),
b AS (SELECT repo_id, language, ns, max(c) AS same_body FROM (SELECT repo_id, language, ns, body_hash, count(DISTINCT qualified_name) AS c FROM k WHERE ty AND body_hash IS NOT NULL GROUP BY ALL) GROUP BY ALL),
g AS (SELECT repo_id, language, ns, count(DISTINCT qualified_name) AS n_names, count(DISTINCT CASE WHEN NOT ty THEN qualified_name END) AS n_callables FROM k GROUP BY ALL)
SELECT g.repo_id, g.language, g.ns AS norm_signature, n_names FROM g LEFT JOIN b USING (repo_id, language, ns) WHERE n_names > 1 AND (n_callables > 1 OR same_body > 1)""",
    "g_check_duplicate": _GATE
    + f""", p AS (SELECT v.id AS key, v.language, v.unit, v.body_hash, v.is_type_decl, ns FROM v JOIN norm ON {_OF.format('v')} WHERE kind = 'symbol'),
h AS (SELECT p.key, CASE WHEN NOT coalesce(gs.is_type_decl, false) AND NOT coalesce(p.is_type_decl, false) THEN 1 WHEN coalesce(gs.is_type_decl, false) AND coalesce(p.is_type_decl, true) THEN CASE WHEN gs.body_hash = p.body_hash THEN 2 ELSE 3 END END AS rank,
  gs.id, gs.qualified_name, {_PLACE.format('gs')} AS place FROM p JOIN gs ON gs.language = p.language AND gs.ns = p.ns AND gs.unit <> p.unit),
b AS (SELECT key, min((rank, id)) AS m, arg_min(qualified_name, (rank, id)) AS name, arg_min(place, (rank, id)) AS place FROM h WHERE rank IS NOT NULL GROUP BY key)
SELECT p.key, coalesce(m[1] < 3, false) AS blocked, CASE WHEN m[1] < 3 THEN 'duplicate' WHEN m[1] = 3 THEN 'near' ELSE 'ok' END AS kind, m[2] AS existing_id, name AS existing_name, place AS existing_location FROM p LEFT JOIN b USING (key)""",
    "g_check_contract": VISIBLE
    + ", lw AS (SELECT * FROM v QUALIFY row_number() OVER (PARTITION BY repo_id, qualified_name ORDER BY load_seq DESC) = 1),"
    + norm_cte("SELECT n.signature, lw.language FROM nodes n JOIN lw USING (repo_id, qualified_name) UNION SELECT signature, language FROM lw")
    + f""", j AS (SELECT CAST(n.load_seq AS VARCHAR) AS key, a.ns AS was, b.ns AS new, {_RANK.format('n.visibility')} AS nv, {_RANK.format('lw.visibility')} AS ov, {_PLACE.format('lw')} AS place
  FROM nodes n LEFT JOIN lw USING (repo_id, qualified_name) LEFT JOIN norm a ON a.raw = lw.signature AND a.l = coalesce(lw.language, 'python') LEFT JOIN norm b ON b.raw = n.signature AND b.l = coalesce(lw.language, 'python') WHERE n.kind = 'symbol'),
r AS (SELECT *, CASE WHEN was <> new THEN 'signature' WHEN nv < ov THEN 'visibility' END AS reason FROM j)
SELECT key, reason IS NOT NULL AS blocked, reason, CASE WHEN reason IS NOT NULL THEN place END AS existing_location FROM r""",
    "k_signature_changes": _NORM
    + f""", sy AS (SELECT * FROM nodes WHERE kind = 'symbol'), fi AS (SELECT * FROM sy QUALIFY row_number() OVER (PARTITION BY id ORDER BY load_seq) = 1), la AS (SELECT * FROM sy QUALIFY row_number() OVER (PARTITION BY id ORDER BY load_seq DESC) = 1),
j AS (SELECT fi.repo_id, fi.qualified_name, fi.language, fi.signature AS was, la.signature AS now FROM fi JOIN la ON la.repo_id = fi.repo_id AND la.qualified_name = fi.qualified_name WHERE fi.signature <> la.signature)
SELECT j.* FROM j JOIN norm a ON a.raw = was AND a.l = coalesce(j.language, 'python') JOIN (SELECT * FROM norm) b ON b.raw = now AND b.l = coalesce(j.language, 'python') WHERE a.ns <> b.ns""",
    "g_resolve_names": VISIBLE
    + """, sy AS (SELECT repo_id, id, qualified_name AS q, '.' || qualified_name AS dq, string_split(qualified_name, '.')[-1] AS seg FROM v WHERE kind = 'symbol'),
a AS (SELECT DISTINCT repo_id, array_to_string(string_split(q, '.')[-2:], '.') AS asked, seg FROM sy WHERE length(array_to_string(string_split(q, '.')[-2:], '.')) <= 512),
ex AS (SELECT repo_id, qualified_name AS asked, arg_max(id, load_seq) AS exact_id FROM v GROUP BY ALL),
h AS (SELECT a.repo_id, a.asked, 1 AS rank, id, q FROM a JOIN sy ON sy.repo_id = a.repo_id AND sy.seg = a.seg AND ends_with(q, '.' || asked)
  UNION ALL SELECT a.repo_id, a.asked, 2, id, q FROM a JOIN sy ON sy.repo_id = a.repo_id AND sy.seg = a.seg
  UNION ALL SELECT a.repo_id, a.asked, 3, id, q FROM a JOIN sy ON sy.repo_id = a.repo_id AND contains(q, '.' || asked || '.')),
t AS (SELECT *, min(rank) OVER (PARTITION BY repo_id, asked) AS top FROM h),
b AS (SELECT repo_id, asked, any_value(rank) AS rank, count(*) AS n, min(id) AS id, array_to_string(list_sort(list(DISTINCT q))[:8], ',') AS names FROM t WHERE rank = top GROUP BY ALL)
SELECT a.repo_id, a.asked, coalesce(exact_id, CASE WHEN rank = 1 AND n = 1 THEN b.id END) AS id, CASE WHEN exact_id IS NULL AND NOT coalesce(rank = 1 AND n = 1, false) THEN names END AS candidates
FROM a LEFT JOIN ex USING (repo_id, asked) LEFT JOIN b USING (repo_id, asked)""",
}
