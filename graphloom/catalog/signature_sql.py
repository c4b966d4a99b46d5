"""The normal form of signatures in SQL, by characters and running sums; it shares no code with functions/signatures.py."""

from __future__ import annotations

from graphloom.functions.signatures import LEADING


#: White space as the normal form sees it, the no-break space too.
S = r"[\s\x{a0}]"


def _heads() -> str:
    """One branch for each language: the words that may stand before a name, removed."""
    out = []
    for language, words in LEADING.items():
        listed = {"python": ["async def", "def", "class"]}.get(language) or words.split()
        if language in ("typescript", "javascript"):
            listed = ["export default", *[w for w in listed if w != "default"]]
        pattern = "|".join(w.replace("(", r"\(").replace(")", r"\)") for w in sorted(listed, key=len, reverse=True))
        out.append(f"WHEN '{language}' THEN regexp_replace(s, '^(?:(?:{pattern}) {S}*)+', '')")
    return " ".join(out)


def norm_cte(source: str) -> str:
    """CTEs that end in norm(raw, l, ns) for the (signature, language) rows of a relation."""
    strip = lambda x: rf"regexp_replace({x}, '^{S}+|{S}+$', '', 'g')"
    generics = r"regexp_replace(x, '@\w[\w.]*(?:\s*\([^)]*\))?', ' ', 'g')"  # annotations first
    for _ in range(6):
        generics = f"regexp_replace({generics}, '<[^<>]*>', '', 'g')"
    return rf"""
ns0 AS (SELECT DISTINCT signature AS raw, coalesce(language, 'python') AS l FROM ({source}) WHERE signature IS NOT NULL),
ns1 AS (SELECT raw, l, {strip("rtrim(" + strip("raw") + ", ':')")} AS s FROM ns0),
ns2 AS (SELECT raw, l, CASE l {_heads()} ELSE s END AS s FROM ns1),
ns3 AS (SELECT raw, l, s, strpos(s, '(') AS o, CASE WHEN strpos(s, '(') > 0 THEN s[:strpos(s, '(') - 1] ELSE s END AS before FROM ns2),
ns4 AS (SELECT *, CASE WHEN o > 0 AND l = 'java' AND len(regexp_extract_all(before, '[A-Za-z_$][\w$]*')) > 0 THEN regexp_extract_all(before, '[A-Za-z_$][\w$]*')[-1]
  ELSE {strip("rtrim(regexp_extract(" + strip("before") + r", '^[^<{ \t]*'), '=')")} END AS name FROM ns3),
ns5 AS (SELECT raw, l, s, unnest(range(o + 1, length(s) + 1)) AS pos FROM ns4 WHERE o > 0),
ns6 AS (SELECT raw, l, pos, s[pos] AS c, sum(CASE s[pos] WHEN '(' THEN 1 WHEN ')' THEN -1 ELSE 0 END) OVER (PARTITION BY raw, l ORDER BY pos) AS pd FROM ns5),
ns7 AS (SELECT raw, l, pos, c, sum(CASE WHEN c IN ('(', '[', '{{', '<') THEN 1 WHEN c IN (')', ']', '}}', '>') THEN -1 ELSE 0 END) OVER (PARTITION BY raw, l ORDER BY pos) AS d
  FROM ns6 WHERE pos < coalesce((SELECT min(q.pos) FROM ns6 q WHERE q.raw = ns6.raw AND q.l = ns6.l AND q.pd = -1), 1000000)),
ns8 AS (SELECT *, d - least(0, min(d) OVER (PARTITION BY raw, l ORDER BY pos)) AS depth FROM ns7),
ns9 AS (SELECT *, sum(CASE WHEN c = ',' AND depth = 0 THEN 1 ELSE 0 END) OVER (PARTITION BY raw, l ORDER BY pos) AS part FROM ns8),
nsp AS (SELECT raw, l, part, string_agg(c, '' ORDER BY pos) AS x FROM ns9 WHERE NOT (c = ',' AND depth = 0) GROUP BY ALL),
nsj AS (SELECT raw, l, part, list_filter(string_split_regex((replace({generics}, '...', '[]')), '{S}+'), lambda w: w NOT IN ('', 'final')) AS ws FROM nsp WHERE l = 'java'),
nsk AS (SELECT raw, l, part, CASE WHEN len(ws) = 0 OR ws[1] = '/' THEN NULL WHEN len(ws) = 1 THEN ws[1] ELSE array_to_string(ws[:-2], '') || regexp_extract(ws[-1], '((?:\[\])*)$', 1) END AS k FROM nsj),
nsq AS (SELECT raw, l, part, regexp_extract(regexp_replace(k, '(?:\[\])+$', ''), '[^.]*$') || regexp_extract(k, '((?:\[\])*)$', 1) AS p FROM nsk WHERE k IS NOT NULL
  UNION ALL SELECT raw, l, part, regexp_extract(regexp_replace(ltrim({strip("x")}, '*.&'), '^mut {S}*', ''), '^[^:=? \t]*') FROM nsp WHERE l <> 'java' AND ltrim({strip("x")}, '*.&') <> '/'),
nsr AS (SELECT raw, l, string_agg(p, ',' ORDER BY part) AS ps FROM nsq WHERE p <> '' AND NOT (l = 'python' AND p IN ('self', 'cls')) AND NOT (l = 'rust' AND p = 'self') GROUP BY ALL),
norm AS (SELECT a.raw, a.l, CASE WHEN o > 0 THEN name || '(' || coalesce(ps, '') || ')' ELSE name END AS ns FROM ns4 a LEFT JOIN nsr b ON a.raw = b.raw AND a.l = b.l)"""
