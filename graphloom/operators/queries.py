"""The catalogue of graph queries, each over whole tables: one row per answer, keyed by what was asked."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from graphloom.functions.paths import is_test_path_dead_code, is_test_unit
from graphloom.functions.signatures import normalize_signature
from graphloom.operators.store import GraphStore, one_of, overlapping
from graphloom.operators.traverse import gate_edges, reachable
from graphloom.schema import EXERCISE_EDGES, EXTERNALS_UNIT, REFERENCE_EDGES, VISIBILITY_RANK

CANDIDATES = 8
MAX_NAME = 512
EXPORTS = 8


def place(location: str = "location") -> Column:
    return F.concat_ws(":", F.col(f"{location}.path"), F.col(f"{location}.start_line").cast("string"))


def brief(nodes: DataFrame) -> DataFrame:
    """qualified_name, kind, unit, place, signature."""
    return nodes.select("repo_id", "qualified_name", "kind", "unit", place().alias("place"), "signature")


# ---------------------------------------------------------------- duplicates and contracts


def check_duplicates(store: GraphStore, proposals: DataFrame) -> DataFrame:
    """A verdict for each proposal (key, signature, language, exclude_unit, body_hash, is_type_decl).

    Callables block on the normal signature, type declarations only on an equal body; neither is held against the
    other, and a proposal of unknown kind follows the rule for callables. A type that agrees in the signature alone is
    named as near but not blocked. Of several hits the one with the smallest id is reported.
    """
    asked = proposals.withColumn("norm", normalize_signature("signature", "language"))
    hit = F.struct("id", "unit", "qualified_name", place().alias("existing_location"), F.col("signature").alias("existing_signature"))
    found = store.gate_symbols().select("language", F.col("norm_signature").alias("norm"), F.coalesce("is_type_decl", F.lit(False)).alias("hit_type"), F.col("body_hash").alias("hit_body"), "unit", hit.alias("hit"))
    # a proposal needs the least hit outside one unit: of each signature, and of each body, the least hits of the two
    # units that come first are enough, so no proposal meets all symbols of a common signature
    by_signature = _two_units(found, ["language", "norm", "hit_type"])
    by_body = _two_units(found.filter("hit_type AND hit_body IS NOT NULL"), ["language", "norm", "hit_type", "hit_body"]).withColumnRenamed("hit_body", "body_hash")
    as_callable = ~F.col("hit_type") & (F.col("is_type_decl").isNull() | ~F.col("is_type_decl"))
    as_type = F.col("hit_type") & (F.col("is_type_decl").isNull() | F.col("is_type_decl"))
    outside = lambda: F.array_min(F.filter("hits", lambda h: F.col("exclude_unit").isNull() | (h["unit"] != F.col("exclude_unit"))))
    ranked = (
        asked.join(by_signature, ["language", "norm"]).select("key", F.when(as_callable, 1).when(as_type, 3).alias("rank"), outside().alias("hit"))
        .unionByName(asked.join(by_body, ["language", "norm", "body_hash"]).select("key", F.when(as_type, 2).alias("rank"), outside().alias("hit")))
    )
    best = ranked.filter("rank IS NOT NULL AND hit IS NOT NULL").groupBy("key").agg(F.min(F.struct("rank", "hit.id", "hit.qualified_name", "hit.existing_location", "hit.existing_signature")).alias("hit"))
    out = asked.join(best, "key", "left")
    return out.select(
        "key",
        F.coalesce(F.col("hit.rank") < 3, F.lit(False)).alias("blocked"),
        F.when(F.col("hit.rank") < 3, "duplicate").when(F.col("hit.rank") == 3, "near").otherwise("ok").alias("kind"),
        F.col("hit.id").alias("existing_id"),
        F.col("hit.qualified_name").alias("existing_name"),
        F.col("hit.existing_location").alias("existing_location"),
    )


def _two_units(found: DataFrame, key: list[str]) -> DataFrame:
    """key, hits: the least hit of each of the two units whose least hits come first."""
    each = found.groupBy(*key, "unit").agg(F.min("hit").alias("hit"))
    first = each.groupBy(*key).agg(F.min("hit").alias("first"))
    w = Window.partitionBy(*key).orderBy("hit")
    return each.withColumn("k", F.row_number().over(w)).filter("k <= 2").groupBy(*key).agg(F.collect_list("hit").alias("hits"))


def rank_of(visibility: Column) -> Column:
    out = F.lit(None).cast("int")
    for name, rank in VISIBILITY_RANK.items():
        out = F.when(visibility == name, rank).otherwise(out)
    return out


def check_contracts(store: GraphStore, changes: DataFrame) -> DataFrame:
    """A verdict for each change (key, repo_id, qualified_name, new_signature, new_visibility).

    The signature is judged first, then a narrower visibility; a new name breaks nothing, nor does a missing signature.
    """
    old = store.get_symbol().select("repo_id", "qualified_name", "language", "signature", "visibility", place().alias("existing_location"))
    both = changes.join(old, ["repo_id", "qualified_name"], "left")
    both = both.withColumn("was", normalize_signature("signature", "language")).withColumn("new", normalize_signature("new_signature", "language"))
    reason = F.when(F.col("was") != F.col("new"), "signature").when(rank_of(F.col("new_visibility")) < rank_of(F.col("visibility")), "visibility")
    return both.select("key", reason.isNotNull().alias("blocked"), reason.alias("reason"), F.when(reason.isNotNull(), F.col("existing_location")).alias("existing_location"))


# The wording of a block.
def verdict_text(kind: Column, name: Column, location: Column, signature: Column, reason: Column) -> Column:
    """The message of a block: what, evidence, the one next step; null for anything else."""
    sig = F.trim(F.regexp_replace(F.regexp_replace(signature, "`", "'"), r"\s+", " "))
    where = F.coalesce(F.concat(F.lit(" ("), location, F.lit(")")), F.lit(""))
    dup = F.concat(
        F.lit("BLOCKED: creating this symbol would duplicate an existing one.\nEVIDENCE (EXTRACTED): same normalized signature as "), name, where, F.when(sig != "", F.concat(F.lit(", defined as `"), sig, F.lit("`"))).otherwise(""),
        F.lit(".\nACTION: reuse "), name, F.lit(" — import/call it instead of re-implementing it.\nDo NOT retry with identical arguments, and do NOT rename the new symbol to evade this gate — the fix is reuse, not a new name."),
    )
    con = F.concat(
        F.lit("BLOCKED: this change breaks the established contract of "), name, F.lit(".\nEVIDENCE (EXTRACTED): "), reason, where, F.lit(".\nACTION: keep the existing contract, or update every caller of "), name,
        F.lit(' in the same change — run find_references("'), name, F.lit('") to list them.\nDo NOT retry with identical arguments.'),
    )
    return F.when(kind == "duplicate", dup).when(kind == "contract", con)


def duplicate_bodies(nodes: DataFrame, min_lines: int = 3) -> DataFrame:
    """body_hash, names, n_names: extracted symbols of at least min_lines lines that share a body under several names."""
    long = F.col("location.end_line") - F.col("location.start_line") + 1 >= min_lines
    kept = nodes.filter((F.col("kind") == "symbol") & (F.col("confidence") == "EXTRACTED") & F.col("body_hash").isNotNull() & long)
    # distinct first: a body with very many copies is merged name by name before its list is built
    return kept.select("repo_id", "body_hash", "qualified_name").distinct().groupBy("repo_id", "body_hash").agg(F.array_sort(F.collect_list("qualified_name")).alias("names")).filter(F.size("names") > 1).select("repo_id", "body_hash", F.array_join("names", ",").alias("names"), F.size("names").alias("n_names"))


def duplicate_signatures(nodes: DataFrame) -> DataFrame:
    """repo_id, language, norm_signature, n_names of real duplications among top-level symbols not named main.

    Callables duplicate under a shared signature, type declarations only if two of them share a body as well.
    """
    kept = nodes.filter((F.col("kind") == "symbol") & F.col("signature").isNotNull() & F.col("is_top_level") & (F.col("name") != "main"))
    kept = kept.withColumn("norm_signature", normalize_signature("signature", "language")).withColumn("is_type", F.coalesce("is_type_decl", F.lit(False)))
    key = ["repo_id", "language", "norm_signature"]
    bodies = kept.filter("is_type AND body_hash IS NOT NULL").groupBy(*key, "body_hash").agg(F.count_distinct("qualified_name").alias("n")).groupBy(*key).agg(F.max("n").alias("same_body"))
    groups = kept.groupBy(*key).agg(F.count_distinct("qualified_name").alias("n_names"), F.count_distinct(F.when(~F.col("is_type"), F.col("qualified_name"))).alias("n_callables"))
    return groups.join(bodies, key, "left").filter((F.col("n_names") > 1) & ((F.col("n_callables") > 1) | (F.col("same_body") > 1))).select(*key, "n_names")


# ---------------------------------------------------------------- names


def _first_names(named: DataFrame) -> DataFrame:
    """repo_id, asked, n, id (the least), names (the first in order): a window keeps no more names than are shown."""
    key = ["repo_id", "asked"]
    counts = named.groupBy(*key).agg(F.count("*").alias("n"), F.min("id").alias("id"))
    w = Window.partitionBy(*key).orderBy("qualified_name")
    first = named.select(*key, "qualified_name").distinct().withColumn("k", F.row_number().over(w)).filter(F.col("k") <= CANDIDATES)
    return counts.join(first.groupBy(*key).agg(F.array_sort(F.collect_list("qualified_name")).alias("names")), key)


def resolve_names(nodes: DataFrame, asked: DataFrame) -> DataFrame:
    """asked, resolved id (or null), candidates: exact name, else the only name with that dotted suffix, else hints.

    Hints are, in this order, the names with the suffix, those with the same last segment, those inside a module of
    that name; the first eight of the first kind that has any. Names over 512 characters resolve to nothing.
    """
    q = asked.select(F.col("name").alias("asked"), "repo_id").distinct().filter(F.length("asked") <= MAX_NAME)
    symbols = nodes.filter(F.col("kind") == "symbol").select("repo_id", "id", "qualified_name")
    exact = nodes.groupBy("repo_id", "qualified_name").agg(F.max_by("id", "load_seq").alias("exact_id")).withColumnRenamed("qualified_name", "asked")
    parts = F.split("qualified_name", r"\.")
    n = F.size(parts)
    suffixes = symbols.filter(n > 1).select("repo_id", "id", "qualified_name", F.explode(F.transform(F.sequence(F.lit(2), n), lambda k: F.array_join(F.slice(parts, k, n), "."))).alias("asked"))
    inner = F.when(n > 2, F.flatten(F.transform(F.sequence(F.lit(2), n - 1), lambda a: F.transform(F.sequence(a, n - 1), lambda b: F.array_join(F.slice(parts, a, b - a + 1), ".")))))
    infixes = symbols.select("repo_id", "id", "qualified_name", F.explode(F.array_distinct(inner)).alias("asked"))
    last = symbols.select("repo_id", "id", "qualified_name", F.element_at(parts, -1).alias("asked"))
    # each key is reduced to its count, its least id and its first names before any asked name meets it
    wanted = q.withColumn("last", F.substring_index("asked", ".", -1))
    counted = (
        q.join(_first_names(suffixes), ["repo_id", "asked"]).withColumn("rank", F.lit(1))
        .unionByName(wanted.join(_first_names(last).withColumnRenamed("asked", "last"), ["repo_id", "last"]).drop("last").withColumn("rank", F.lit(2)))
        .unionByName(q.join(_first_names(infixes), ["repo_id", "asked"]).withColumn("rank", F.lit(3)))
    )
    w = Window.partitionBy("repo_id", "asked")
    best = counted.withColumn("top", F.min("rank").over(w)).filter("rank = top")
    out = q.join(exact, ["repo_id", "asked"], "left").join(best, ["repo_id", "asked"], "left")
    unique = (F.col("rank") == 1) & (F.col("n") == 1)
    return out.select("repo_id", "asked", F.coalesce("exact_id", F.when(unique, F.col("id"))).alias("id"), F.when(F.col("exact_id").isNull() & ~F.coalesce(unique, F.lit(False)), F.array_join("names", ",")).alias("candidates"))


def owning_modules(nodes: DataFrame) -> DataFrame:
    """id, module_id: the module whose dotted name is the longest prefix of each node's."""
    modules = nodes.filter(F.col("kind") == "module").select("repo_id", F.col("qualified_name").alias("prefix"), F.col("id").alias("module_id"))
    parts = F.split("qualified_name", r"\.")
    prefixes = nodes.filter(F.col("kind").isin("module", "symbol")).select("repo_id", "id", F.explode(F.transform(F.sequence(F.lit(1), F.size(parts)), lambda k: F.array_join(F.slice(parts, 1, k), "."))).alias("prefix"))
    met = prefixes.join(modules, ["repo_id", "prefix"])
    return met.groupBy("id").agg(F.max(F.struct(F.length("prefix").alias("n"), "module_id")).alias("m")).select("id", "m.module_id")


# ---------------------------------------------------------------- references and impact


def find_references(store: GraphStore) -> DataFrame:
    """Each symbol's depth-1 callers over extracted reference edges with their distinct sites in order."""
    e = gate_edges(store.edges, REFERENCE_EDGES).filter("src != dst")
    site = F.when(F.col("source_location").isNotNull(), F.concat_ws(":", F.col("source_location.path"), F.format_string("%d", F.col("source_location.line"))))
    per = e.select("dst", "src", site.alias("site")).distinct().groupBy("dst", "src").agg(F.array_join(F.array_sort(F.collect_list("site")), ",").alias("sites"))
    ends = store.nodes.select("id", "qualified_name")
    return per.join(ends.select(F.col("id").alias("src"), F.col("qualified_name").alias("caller")), "src").join(ends.select(F.col("id").alias("dst"), F.col("qualified_name").alias("target")), "dst").select("dst", "src", "target", "caller", "sites")


def blast_radius(store: GraphStore, roots: DataFrame, depth: int = 1, types=None) -> DataFrame:
    """root, node, distance: what depends on each root, over the whole gate set unless narrowed (containers included)."""
    return reachable(gate_edges(store.edges, types), roots, depth, forward=False)


def callees(store: GraphStore, roots: DataFrame, depth: int = 1, types=None) -> DataFrame:
    return reachable(gate_edges(store.edges, types), roots, depth)


def implementations(store: GraphStore) -> DataFrame:
    """base, implementation of every extracted inherits and implements edge."""
    return gate_edges(store.edges, ("inherits", "implements")).filter("src != dst").select(F.col("dst").alias("base"), F.col("src").alias("implementation")).distinct()


def changed_symbols(store: GraphStore, regions: DataFrame) -> DataFrame:
    """Symbols whose span a changed region overlaps."""
    return overlapping(store.nodes.filter(F.col("kind") == "symbol"), regions).select("id", "repo_id", "qualified_name", "unit").distinct()


def suggest_tests(store: GraphStore, changed: DataFrame, depth: int = 1) -> DataFrame:
    """test, unit and the changed symbols (names, in order) that it exercises; imports do not exercise anything."""
    reach = reachable(gate_edges(store.edges, EXERCISE_EDGES), changed, depth, forward=False)
    tests = store.nodes.filter(is_test_unit(F.col("unit"))).select(F.col("id").alias("node"), F.col("qualified_name").alias("test"), "unit")
    names = store.nodes.select(F.col("id").alias("root"), F.col("qualified_name").alias("symbol"))
    pairs = reach.join(tests, "node").join(names, "root").select("test", "unit", "symbol").distinct()
    return pairs.groupBy("test", "unit").agg(F.array_join(F.array_sort(F.collect_list("symbol")), ",").alias("exercises"))


def doc_drift(store: GraphStore, changed: DataFrame) -> DataFrame:
    """Documents that mention a changed symbol, with the symbols they mention."""
    e = store.edges.filter((F.col("type") == "documents") & (F.col("confidence") == "EXTRACTED"))
    hit = e.join(changed.select(F.col("id").alias("dst"), F.col("qualified_name").alias("symbol")).distinct(), "dst").join(store.nodes.select(F.col("id").alias("src"), F.col("qualified_name").alias("doc"), F.col("unit").alias("doc_unit")), "src")
    return hit.select("doc", "doc_unit", "symbol").distinct().groupBy("doc", "doc_unit").agg(F.array_join(F.array_sort(F.collect_list("symbol")), ",").alias("mentions"))


def affected_by(store: GraphStore, changed: DataFrame, depth: int = 1) -> DataFrame:
    """Names of symbols that depend on a changed one over reference edges, changed ones left out; overloads are one name."""
    reach = reachable(gate_edges(store.edges, REFERENCE_EDGES), changed, depth, forward=False)
    hit = reach.select(F.col("node").alias("id")).distinct().join(store.nodes, "id").select("repo_id", "qualified_name").distinct()
    return hit.join(changed.select("repo_id", "qualified_name").distinct(), ["repo_id", "qualified_name"], "left_anti")


def impact_summary(store: GraphStore, changed: DataFrame, depth: int = 1) -> DataFrame:
    """One row of counts: changed, affected, tests, docs."""
    counts = [
        changed.select("repo_id", "qualified_name").distinct().agg(F.count("*").alias("changed")),
        affected_by(store, changed, depth).agg(F.count("*").alias("affected")),
        suggest_tests(store, changed, depth).agg(F.count("*").alias("tests")),
        doc_drift(store, changed).agg(F.count("*").alias("docs")),
    ]
    tagged = [c.withColumn("one", F.lit(1)) for c in counts]
    out = tagged[0]
    for c in tagged[1:]:
        out = out.join(c, "one")
    return out.drop("one")


def localize(store: GraphStore, tests: DataFrame, changed: DataFrame, depth: int = 4) -> DataFrame:
    """test, suspect, distance: changed symbols that a failing test reaches, nearest first by distance and name."""
    reach = reachable(gate_edges(store.edges, EXERCISE_EDGES), tests, depth)
    return reach.join(changed.select(F.col("id").alias("node"), F.col("qualified_name").alias("suspect")).distinct(), "node").select(F.col("root").alias("test"), "suspect", "distance")


def dead_code(store: GraphStore) -> DataFrame:
    """Internal extracted symbols that a module defines and nothing references, whatever the reference's confidence."""
    n, e = store.nodes, store.edges
    modules = n.filter(F.col("kind") == "module").select(F.col("id").alias("src"))
    defined = e.filter(F.col("type") == "defines").join(modules, "src", "left_semi").select(F.col("dst").alias("id")).distinct()
    referenced = e.filter(F.col("type").isin(*REFERENCE_EDGES)).select(F.col("dst").alias("id")).distinct()
    kept = n.filter((F.col("kind") == "symbol") & (F.col("confidence") == "EXTRACTED") & (F.col("visibility") == "internal"))
    excluded = (F.col("name") == "main") | F.col("name").rlike("^__.*__$") | is_test_path_dead_code(F.coalesce("location.path", "unit"))
    return kept.filter(~excluded).join(defined, "id", "left_semi").join(referenced, "id", "left_anti").select("repo_id", "id", "qualified_name", place().alias("place"))


# ---------------------------------------------------------------- overviews


def repo_map(store: GraphStore, exports: int = EXPORTS) -> DataFrame:
    """Per unit: number of symbols, the first exported names, and how many more there are; externals are left out."""
    s = store.nodes.filter((F.col("kind") == "symbol") & (F.col("unit") != EXTERNALS_UNIT))
    w = Window.partitionBy("repo_id", "unit").orderBy("qualified_name", "id")
    shown = s.filter((F.col("visibility") != "internal") & F.col("is_top_level"))
    first = shown.withColumn("k", F.row_number().over(w)).groupBy("repo_id", "unit").agg(F.count("*").alias("n_exports"), F.array_join(F.array_sort(F.collect_list(F.when(F.col("k") <= exports, F.col("qualified_name")))), ",").alias("exports"))
    out = s.groupBy("repo_id", "unit").agg(F.count("*").alias("n_symbols")).join(first, ["repo_id", "unit"], "left")
    return out.select("repo_id", "unit", "n_symbols", F.coalesce("exports", F.lit("")).alias("exports"), F.greatest(F.coalesce("n_exports", F.lit(0)) - exports, F.lit(0)).alias("more"))


def unit_dependents(store: GraphStore) -> DataFrame:
    """unit, dependent: units that import something of a unit."""
    ends = store.nodes.select("id", "repo_id", "unit")
    e = gate_edges(store.edges, ("imports",)).select("src", "dst")
    s, d = ends.select(F.col("id").alias("src"), F.col("unit").alias("dependent"), F.col("repo_id").alias("r")), ends.select(F.col("id").alias("dst"), "unit", "repo_id")
    return e.join(s, "src").join(d, "dst").filter((F.col("unit") != F.col("dependent")) & (F.col("unit") != EXTERNALS_UNIT)).select("repo_id", "unit", "dependent").distinct()


def module_graph(store: GraphStore) -> DataFrame:
    """src, dst of import edges between owning modules of a repository, without loops."""
    own = owning_modules(store.nodes)
    e = gate_edges(store.edges, ("imports",))
    s, d = own.select(F.col("id").alias("src"), F.col("module_id").alias("a")), own.select(F.col("id").alias("dst"), F.col("module_id").alias("b"))
    return e.join(s, "src").join(d, "dst").filter("a != b").select(F.col("a").alias("src"), F.col("b").alias("dst")).distinct()


def edge_types(edges: DataFrame, wanted) -> DataFrame:
    return edges.filter(one_of("type", wanted))


def tests_of_names(store: GraphStore, names: DataFrame, depth: int = 1) -> tuple[DataFrame, DataFrame]:
    """The tests that exercise symbols asked by name (repo_id, name), and the names that resolve to none, with hints."""
    found = resolve_names(store.nodes, names)
    changed = found.filter("id IS NOT NULL").select("id").distinct()
    return suggest_tests(store, changed, depth), found.filter("id IS NULL").select("repo_id", "asked", "candidates")


def ranked_suspects(store: GraphStore, tests: DataFrame, changed: DataFrame, depth: int = 4) -> DataFrame:
    """localize with the place of each suspect: nearest first, then by name."""
    w = Window.partitionBy("test").orderBy("distance", "suspect")
    return localize(store, tests, changed, depth).withColumn("place", F.rank().over(w))


def impact_markdown(store: GraphStore, changed: DataFrame, depth: int = 1, most: int = 50) -> str:
    """The impact of a change as Markdown: counts, and the first names of each kind; the lists say where they end."""
    parts = [
        ("Changed", changed.select(F.col("qualified_name").alias("x")).distinct()), ("Affected", affected_by(store, changed, depth).select(F.col("qualified_name").alias("x")).distinct()),
        ("Tests", suggest_tests(store, changed, depth).select(F.col("test").alias("x")).distinct()), ("Documents", doc_drift(store, changed).select(F.col("doc").alias("x")).distinct()),
    ]
    out = ["# Impact"]
    for title, frame in parts:
        names = [r.x for r in frame.orderBy("x").limit(most + 1).collect()]
        total = frame.count() if len(names) > most else len(names)
        out += [f"## {title} ({total})", *[f"- `{n}`" for n in names[:most]], *([f"- … {total - most} more"] if total > most else [])]
    return "\n".join(out) + "\n"


def repo_totals(store: GraphStore) -> DataFrame:
    """Units and symbols of each repository, and in a row without repository those of all."""
    s = store.nodes.filter((F.col("kind") == "symbol") & (F.col("unit") != EXTERNALS_UNIT))
    per = s.groupBy("repo_id", "unit").agg(F.count("*").alias("n"))
    return per.rollup("repo_id").agg(F.count("*").alias("n_units"), F.sum("n").alias("n_symbols"))
