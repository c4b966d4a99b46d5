"""Common table expressions that the SQL of several queries shares."""

VISIBLE = """
WITH v AS (SELECT * FROM nodes WHERE id IS NOT NULL QUALIFY row_number() OVER (PARTITION BY id ORDER BY load_seq DESC) = 1),
e AS (SELECT type, src, dst, weight, provenance, confidence, source_location, unit FROM edges
      WHERE src IN (SELECT id FROM v) AND dst IN (SELECT id FROM v) GROUP BY ALL),
gate AS (SELECT * FROM e WHERE confidence = 'EXTRACTED' AND type IN ('calls','imports','depends_on','defines','references','inherits','implements'))"""


def reach(name: str, edges: str, roots: str, depth: int, forward: bool) -> str:
    """Levels of a bounded search without recursion: name(root, node, distance)."""
    a, b = ("src", "dst") if forward else ("dst", "src")
    parts = [f"{name}_0 AS (SELECT DISTINCT id AS root, id AS node, 0 AS distance FROM ({roots}))", f"{name}_e AS (SELECT DISTINCT {a} AS at, {b} AS nxt FROM ({edges}))"]
    for k in range(1, depth + 1):
        seen = " UNION ALL ".join(f"SELECT root, node FROM {name}_{j}" for j in range(k))
        parts.append(f"{name}_{k} AS (SELECT DISTINCT f.root, x.nxt AS node, {k} AS distance FROM {name}_{k - 1} f JOIN {name}_e x ON f.node = x.at WHERE NOT EXISTS (SELECT 1 FROM ({seen}) s WHERE s.root = f.root AND s.node = x.nxt))")
    parts.append(f"{name} AS (" + " UNION ALL ".join(f"SELECT * FROM {name}_{k}" for k in range(1, depth + 1)) + ")")
    return ",\n".join(parts)
