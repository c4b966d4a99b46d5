"""The tools of the graph as one catalogue: source of symbols, candidates of missed names, dispatch by name."""

from __future__ import annotations

import ipaddress
from collections.abc import Callable
from dataclasses import dataclass, field
from urllib.parse import urlsplit

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from graphloom.functions.paths import base_name, posix
from graphloom.operators import queries as q
from graphloom.operators import traverse as t
from graphloom.operators.store import GraphStore
from graphloom.operators.traverse import known_types

#: Lines of a symbol's source that are shown, and names offered for a missed unit.
MAX_SOURCE_LINES, MISS_CANDIDATES = 120, 5


# ---------------------------------------------------------------- source of symbols


def inside_workspace(path: Column) -> Column:
    """Whether a recorded path stays in the workspace: relative, and never above its root."""
    parts = F.filter(F.split(posix(path), "/"), lambda s: ~s.isin("", "."))
    depths = F.transform(parts, lambda s, i: F.aggregate(F.slice(parts, 1, i + 1), F.lit(0), lambda acc, x: acc + F.when(x == "..", -1).otherwise(1)))
    return ~path.rlike(r"^(?:[/\\]|[A-Za-z]:)") & F.forall(depths, lambda d: d >= 0)


def read_symbols(nodes: DataFrame, sources: DataFrame, most: int = MAX_SOURCE_LINES) -> DataFrame:
    """id, source, truncated, note of each node: its lines (at most `most`) in the text of its file.

    sources has repo_id, unit and source_text, one row a file. A place outside the workspace and a file without text give
    a note instead of a source. Lines end with a line feed, whatever the file's own line ends.
    """
    here = nodes.select("id", "repo_id", F.col("location.path").alias("path"), F.col("location.start_line").alias("lo"), F.coalesce("location.end_line", "location.start_line").alias("hi"))
    texts = sources.select(F.col("repo_id").alias("r"), F.col("unit").alias("u"), "source_text")
    met = here.join(texts, F.col("repo_id").eqNullSafe(F.col("r")) & (F.col("path") == F.col("u")), "left")
    lines = F.split(F.regexp_replace("source_text", r"\r\n?", "\n"), "\n")
    start, end = F.greatest(F.lit(1), F.col("lo")), F.least(F.size(lines), F.col("hi"))
    count = F.greatest(F.lit(0), end - start + 1)
    inside = F.coalesce(inside_workspace(F.col("path")), F.lit(False))
    note = F.when(~inside, F.concat(F.lit("outside the workspace: "), F.coalesce("path", F.lit("")))).when(F.col("source_text").isNull(), F.concat(F.lit("no text of: "), F.col("path")))
    source = F.when(note.isNull(), F.array_join(F.slice(lines, start, F.least(count, F.lit(most))), "\n"))
    return met.select("id", source.alias("source"), (note.isNull() & (count > most)).alias("truncated"), note.alias("note"))


# ---------------------------------------------------------------- candidates and guards


def map_candidates(nodes: DataFrame, asked: DataFrame, most: int = MISS_CANDIDATES) -> DataFrame:
    """asked, candidates: the first units that end with the base name of a unit (asked) that no node has.

    Suffixes are taken of base names: units are joined by the endings of their own base name, not compared with all.
    """
    units = nodes.filter(F.col("unit").isNotNull()).select("unit").distinct()
    missed = asked.select("asked").distinct().join(units.withColumnRenamed("unit", "asked"), "asked", "left_anti").withColumn("ending", base_name(F.col("asked")))
    base = base_name(F.col("unit"))
    endings = units.withColumn("ending", F.explode(F.transform(F.sequence(F.lit(1), F.length(base)), lambda k: F.substr(base, k))))
    wanted = missed.select("ending").distinct()
    # names longer than a base name hold a slash only where the asked one does
    met = missed.join(endings.join(wanted, "ending", "left_semi"), "ending")
    w = Window.partitionBy("asked").orderBy("unit")
    first = met.withColumn("k", F.row_number().over(w)).filter(F.col("k") <= most)
    named = first.groupBy("asked").agg(F.array_join(F.array_sort(F.collect_list("unit")), ",").alias("candidates"))
    return missed.select("asked").join(named, "asked", "left").fillna("", ["candidates"])


def is_symbol_shaped(pattern: Column) -> Column:
    """Whether a search pattern could name a symbol: at least three characters, identifiers joined by dots."""
    parts = F.split(pattern, r"\.", -1)
    return (F.length(pattern) >= 3) & F.forall(parts, lambda s: s.rlike(r"^[A-Za-z_]\w*$") & ~s.rlike(r"[^\x00-\x7F]"))


def is_loopback(url: str) -> bool:
    """Whether a URL's host is this machine: localhost, a loopback address, or the address of all interfaces."""
    try:
        host = urlsplit(url).hostname
        address = None if host in (None, "localhost") else ipaddress.ip_address(host)
    except ValueError:
        return False
    return host == "localhost" or address is not None and (address.is_loopback or int(address) == 0 and address.version == 4)


def same_origin(a: str, b: str) -> bool:
    one, two = urlsplit(a), urlsplit(b)
    return (one.scheme, one.hostname, one.port) == (two.scheme, two.hostname, two.port)


def full_nodes(nodes: DataFrame) -> DataFrame:
    """Every field of a node with its place as one value."""
    fields = ["id", "repo_id", "kind", "name", "qualified_name", "language", "unit", "signature", "visibility", "confidence", "provenance", "is_top_level"]
    return nodes.select(*fields, F.struct(F.col("location.path").alias("path"), F.col("location.start_line").alias("start_line"), F.col("location.end_line").alias("end_line")).alias("place"))


# ---------------------------------------------------------------- the catalogue


@dataclass(frozen=True)
class Tool:
    """One tool: what it answers, its parameters by name (type, and default if it has one), and the function."""

    name: str
    about: str
    call: Callable[..., DataFrame]
    parameters: dict[str, tuple[type, object]] = field(default_factory=dict)
    frames: tuple[str, ...] = ()

    def schema(self) -> dict:
        kinds = {int: "integer", str: "string", list: "array", bool: "boolean"}
        properties = {k: {"type": kinds[kind]} for k, (kind, _) in self.parameters.items()} | {f: {"type": "array", "items": {"type": "object"}} for f in self.frames}
        return {"name": self.name, "description": self.about, "inputSchema": {"type": "object", "properties": properties, "required": list(self.frames)}}


_DEPTH, _TYPES = {"depth": (int, 1)}, {"types": (list, None)}

TOOLS = {
    x.name: x
    for x in (
        Tool("check_duplicate", "a verdict for each proposed symbol", lambda st, proposals: q.check_duplicates(st, proposals), frames=("proposals",)),
        Tool("check_contract", "a verdict for each changed signature or visibility", lambda st, changes: q.check_contracts(st, changes), frames=("changes",)),
        Tool("blast_radius", "what depends on each root", lambda st, roots, depth, types: q.blast_radius(st, roots, depth, known_types(types)), _DEPTH | _TYPES, ("roots",)),
        Tool("callees", "what each root depends on", lambda st, roots, depth, types: q.callees(st, roots, depth, known_types(types)), _DEPTH | _TYPES, ("roots",)),
        Tool("find_symbol", "names to symbols, or hints", lambda st, names: q.resolve_names(st.nodes, names), frames=("names",)),
        Tool("find_references", "callers with their sites", lambda st: q.find_references(st)),
        Tool("suggest_tests", "tests that exercise changed symbols", lambda st, changed, depth: q.suggest_tests(st, changed, depth), _DEPTH, ("changed",)),
        Tool("doc_drift", "documents that mention changed symbols", lambda st, changed: q.doc_drift(st, changed), frames=("changed",)),
        Tool("find_cycles", "import cycles of modules", lambda st, limit: t.truncated_cycles(q.module_graph(st), limit=limit), {"limit": (int, t.CYCLE_LIMIT)}),
        Tool("find_duplicate_bodies", "bodies that several names share", lambda st, min_lines: q.duplicate_bodies(st.nodes, min_lines), {"min_lines": (int, 3)}),
        Tool("impact_summary", "counts of what a change touches", lambda st, changed, depth: q.impact_summary(st, changed, depth), _DEPTH, ("changed",)),
        Tool("localize", "changed symbols that failing tests reach", lambda st, tests, changed, depth: q.localize(st, tests, changed, depth), {"depth": (int, 4)}, ("tests", "changed")),
        Tool("find_dead_code", "internal symbols that nothing references", lambda st: q.dead_code(st)),
        Tool("read_symbol", "source of symbols", lambda st, ids, sources: read_symbols(st.get_node(ids), sources), frames=("ids", "sources")),
        Tool("implementations", "subtypes of each base", lambda st: q.implementations(st)),
        Tool("repo_map", "units with their exports", lambda st, exports: q.repo_map(st, exports), {"exports": (int, q.EXPORTS)}),
    )
}


def dispatch(store: GraphStore, name: str, **arguments) -> DataFrame:
    """Run a tool by its name. Numbers and lists may come as texts; an unknown tool or argument is an error."""
    if name not in TOOLS:
        raise KeyError(f"unknown tool: {name}")
    tool = TOOLS[name]
    if unknown := set(arguments) - set(tool.parameters) - set(tool.frames):
        raise TypeError(f"{name}: unknown arguments {sorted(unknown)}")
    if missing := set(tool.frames) - set(arguments):
        raise TypeError(f"{name}: missing arguments {sorted(missing)}")
    given = {f: arguments[f] for f in tool.frames}
    for key, (kind, default) in tool.parameters.items():
        value = arguments.get(key, default)
        if kind is int and not isinstance(value, int):
            value = int(value)
        elif kind is list and isinstance(value, str):
            value = [x.strip() for x in value.split(",") if x.strip()]
        given[key] = value
    return tool.call(store, **given)
