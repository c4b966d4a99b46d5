"""The index job: a tree of sources to nodes and edges, ready to be published as a graph.

Files are read once, by extract.py; everything after that is joins of rows. Symbols of all languages, documents, routes
and external packages end in one set of facts, with stable ids.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from graphloom.functions.paths import language_of, module_qname, nextjs_pattern, posix
from graphloom.functions.signatures import body_hash, node_id, normalize_signature
from graphloom.runtime import cut
from graphloom.schema import EDGES, EXTERNALS_UNIT, NODES
from graphloom.sources import extract, walkers

NODE_COLUMNS = [f.name for f in NODES.fields]
EDGE_COLUMNS = [f.name for f in EDGES.fields]


# ---------------------------------------------------------------- pieces


def module_owners(modules: DataFrame) -> DataFrame:
    """repo_id, language, module, unit of each module's owner: the first unit by name of those that share it."""
    return modules.groupBy("repo_id", "language", "module").agg(F.min("unit").alias("unit"))


def distinct_overloads(symbols: DataFrame) -> DataFrame:
    """Symbols of one name and normal signature once, the first by unit and line, with their ordinal where names are shared.

    Symbols have repo_id, language, qualified_name, signature, unit and start_line; norm_signature and ordinal are added. A
    null signature is a signature of its own.
    """
    key = ["repo_id", "language", "qualified_name"]
    s = symbols.withColumn("norm_signature", F.coalesce(normalize_signature("signature", "language"), F.lit("")))
    first = s.groupBy(*key, "norm_signature").agg(F.min(F.struct("unit", "start_line")).alias("at"))
    w = Window.partitionBy(*key)
    ranked = first.withColumn("ordinal", F.when(F.count("*").over(w) > 1, F.row_number().over(w.orderBy("norm_signature")) - 1))
    return s.join(ranked, [*key, "norm_signature"]).filter((F.col("unit") == F.col("at.unit")) & (F.col("start_line") == F.col("at.start_line"))).drop("at").dropDuplicates([*key, "norm_signature"])


def enclosing_overloads(sites: DataFrame, symbols: DataFrame) -> DataFrame:
    """Sites (repo_id, qualified_name, line, ...) with the id of the overload whose span holds the line, else of the first.

    symbols have repo_id, qualified_name, id, start_line and end_line. Sites of unknown names are dropped.
    """
    tagged = sites.withColumn("site", F.monotonically_increasing_id())
    met = tagged.join(symbols.select("repo_id", "qualified_name", "id", "start_line", "end_line"), ["repo_id", "qualified_name"])
    holds = (F.col("start_line") <= F.col("line")) & (F.col("line") <= F.col("end_line"))
    best = met.groupBy(*[c for c in sites.columns], "site").agg(F.min(F.struct((~F.coalesce(holds, F.lit(False))).cast("int").alias("outside"), "start_line", "id")).alias("b"))
    return best.select(*sites.columns, F.col("b.id").alias("id"))


def definitions_at(positions: DataFrame, symbols: DataFrame, modules: DataFrame) -> DataFrame:
    """Positions (repo_id, path, line, relation, ...) with the id of the symbol defined there.

    An import whose target is no symbol falls to the module of the path; any other miss is dropped.
    """
    at = symbols.select("repo_id", F.col("unit").alias("path"), F.col("start_line").alias("line"), F.col("id").alias("symbol_id"))
    owner = modules.select("repo_id", F.col("unit").alias("path"), F.col("id").alias("module_id"))
    met = positions.withColumn("path", posix(F.col("path"))).join(at, ["repo_id", "path", "line"], "left").join(owner, ["repo_id", "path"], "left")
    found = F.coalesce("symbol_id", F.when(F.col("relation") == "imports", F.col("module_id")))
    return met.withColumn("id", found).drop("symbol_id", "module_id").filter("id IS NOT NULL")


def next_projects(configs: DataFrame) -> DataFrame:
    """repo_id, directory of the projects (repo_id, unit, source_text) that are shown to use Next.js: by a configuration file of it,
    or a package.json that depends on it. Text that is no JSON shows nothing."""
    name, directory = F.substring_index("unit", "/", -1), F.when(F.col("unit").contains("/"), F.regexp_replace("unit", "/[^/]*$", "")).otherwise("")
    parsed = F.get_json_object("source_text", "$.dependencies.next").isNotNull() | F.get_json_object("source_text", "$.devDependencies.next").isNotNull()
    shown = name.rlike(r"^next\.config\.(?:[cm]?js|ts)$") | (name == "package.json") & F.coalesce(parsed, F.lit(False))
    return configs.filter(shown).select("repo_id", directory.alias("directory")).distinct()


def page_routes(files: DataFrame, projects: DataFrame) -> DataFrame:
    """repo_id, unit, line, pattern of page files under app/ or pages/ of a Next.js project (also below its src/)."""
    parts = F.split("unit", "/")
    spots = files.filter(language_of(F.col("unit")).isin("typescript", "javascript")).select("repo_id", "unit", F.posexplode(parts).alias("at", "segment")).filter(F.col("segment").isin("app", "pages"))
    before = F.slice(F.split("unit", "/"), 1, F.col("at"))
    trimmed = F.when(F.element_at(before, -1) == "src", F.slice(before, 1, F.size(before) - 1)).otherwise(before)
    rooted = spots.withColumn("directory", F.when(F.col("at") == 0, "").otherwise(F.array_join(trimmed, "/"))).withColumn("rest", F.array_join(F.slice(F.split("unit", "/"), F.col("at") + 1, F.size(F.split("unit", "/"))), "/"))
    kept = rooted.join(projects, ["repo_id", "directory"], "left_semi").withColumn("pattern", nextjs_pattern(F.col("rest"))).filter("pattern IS NOT NULL")
    return kept.groupBy("repo_id", "unit").agg(F.min_by("pattern", "at").alias("pattern")).select("repo_id", "unit", F.lit(1).alias("line"), "pattern")


# ---------------------------------------------------------------- the job


def _node(df: DataFrame, kind: str, **columns: Column) -> DataFrame:
    """Rows in the shape of nodes; what is not given is null."""
    given = {"kind": F.lit(kind), "provenance": F.lit("tree-sitter"), "confidence": F.lit("EXTRACTED"), "is_top_level": F.lit(True), "is_type_decl": F.lit(False)} | columns
    given["id"] = node_id("repo_id", given["qualified_name"], F.lit(kind), given.get("stmt_ordinal", F.lit(None).cast("int")).cast("double"), given["language"])
    types = {f.name: f.dataType for f in NODES.fields}
    cols = [(given[c] if c in given else F.col(c) if c in df.columns else F.lit(None)).cast(types[c]).alias(c) for c in NODE_COLUMNS]
    return df.select(*cols)


def _span(path: Column, lo: Column, hi: Column) -> Column:
    return F.struct(path.alias("path"), lo.cast("int").alias("start_line"), hi.cast("int").alias("end_line"))


def _edge(df: DataFrame, kind: Column, provenance: str = "tree-sitter") -> DataFrame:
    """Rows with src, dst, unit and line in the shape of edges."""
    site = F.when(F.col("line").isNotNull(), F.struct(F.col("unit").alias("path"), F.col("line").cast("int").alias("line")))
    return df.select(kind.alias("type"), "src", "dst", F.lit(1.0).alias("weight"), F.lit(provenance).alias("provenance"), F.lit("EXTRACTED").alias("confidence"), site.alias("source_location"), "unit", F.lit(None).cast("timestamp").alias("loaded_at"))


def index_package(files: DataFrame, documents: DataFrame | None = None, configs: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """Nodes and edges of source files (repo_id, unit, source_text), documents (doc_id, repo_id, path, text) and configurations.

    Symbols, imports, calls and bases come from all eleven languages, references from Python. Names bind by joins: to
    imports, to the own module, to the own class; an edge may be lost, none is invented. Dangling edges do not arise: both
    ends of every edge are among the nodes. Files that do not parse give their module only.
    """
    files = files.withColumn("unit", posix(F.col("unit"))).withColumn("language", language_of(F.col("unit")))
    read = files.select("repo_id", "unit", "source_text")
    facts = cut(extract.python_facts(read).unionByName(walkers.code_facts(read)))
    known = files.filter("language IS NOT NULL").select("repo_id", "unit", "language", module_qname(F.col("unit"), F.col("language")).alias("module"), F.col("source_text"))
    owners = module_owners(known)
    lines = F.size(F.split(F.coalesce("source_text", F.lit("")), "\n"))
    owned = known.join(owners, ["repo_id", "language", "module", "unit"], "left_semi").filter("module != ''")
    modules = _node(owned, "module", name=F.substring_index("module", ".", -1), qualified_name=F.col("module"), language=F.col("language"), location=_span(F.col("unit"), F.lit(1), lines), visibility=F.lit("exported"), content_hash=body_hash("source_text"))
    found = facts.filter("fact = 'symbol'").withColumn("language", language_of(F.col("unit")))
    once = cut(distinct_overloads(found.select("repo_id", "unit", "module", "language", "name", "qualified_name", "container", "signature", "start_line", "end_line", "visibility", "body_hash", "is_type_decl", "is_top_level")))
    symbols = _node(once, "symbol", qualified_name=F.col("qualified_name"), language=F.col("language"), location=_span(F.col("unit"), F.col("start_line"), F.col("end_line")), stmt_ordinal=F.col("ordinal"), is_top_level=F.col("is_top_level"), is_type_decl=F.col("is_type_decl"), content_hash=body_hash("signature"))
    base = cut(modules.unionByName(symbols))
    # names of edges to ids
    resolved = extract.resolve_python(facts)
    spans = base.filter("kind IN ('symbol', 'module')").select("repo_id", "qualified_name", "id", F.col("location.start_line").alias("start_line"), F.col("location.end_line").alias("end_line"))
    sourced = enclosing_overloads(resolved.withColumnRenamed("src", "qualified_name"), spans).withColumnRenamed("id", "src").drop("qualified_name")
    first = spans.groupBy("repo_id", F.col("qualified_name").alias("dst")).agg(F.min_by("id", F.struct("start_line", "id")).alias("dst_id"))
    inner = sourced.filter("NOT external").join(first, ["repo_id", "dst"]).drop("dst").withColumnRenamed("dst_id", "dst")
    packages = sourced.filter("external AND dst != ''").groupBy("repo_id", F.col("dst").alias("name")).agg(F.min(language_of(F.col("unit"))).alias("language"))
    externals = _node(packages, "external_package", qualified_name=F.col("name"), language=F.col("language"), unit=F.lit(EXTERNALS_UNIT), location=_span(F.lit(EXTERNALS_UNIT), F.lit(1), F.lit(1)), visibility=F.lit("public"))
    outer = sourced.filter("external").join(externals.select("repo_id", F.col("qualified_name").alias("dst"), F.col("id").alias("dst_id")), ["repo_id", "dst"]).drop("dst").withColumnRenamed("dst_id", "dst")
    columns = ["type", "src", "dst", "unit", "line"]
    edges = _edge(inner.select(*columns).unionByName(outer.select(*columns)), F.col("type"))
    nodes = base.unionByName(externals)
    for more_nodes, more_edges in (_documents(documents, base), _routes(files, configs, base)):
        nodes = nodes if more_nodes is None else nodes.unionByName(more_nodes)
        edges = edges if more_edges is None else edges.unionByName(more_edges)
    return nodes, edges.distinct()


def _documents(documents: DataFrame | None, nodes: DataFrame):
    """One section node for each document that mentions something, and its documents edges."""
    if documents is None:
        return None, None
    found = extract.doc_references(documents, nodes.withColumn("load_seq", F.coalesce("load_seq", F.lit(0))))
    titled = found.join(documents.select("doc_id", "repo_id", F.coalesce("path", F.concat(F.lit("doc/"), F.col("doc_id").cast("string"))).alias("unit")), "doc_id")
    sections = _node(titled.select("repo_id", "unit").distinct(), "doc_section", name=F.substring_index("unit", "/", -1), qualified_name=F.col("unit"), language=F.lit("python"), location=_span(F.col("unit"), F.lit(1), F.lit(1)), provenance=F.lit("doc"), visibility=F.lit("exported"))
    met = titled.select("repo_id", "unit", F.col("id").alias("dst")).join(sections.select("repo_id", "unit", F.col("id").alias("src")), ["repo_id", "unit"]).withColumn("line", F.lit(None).cast("int"))
    return sections, _edge(met, F.lit("documents"), "doc")


def _routes(files: DataFrame, configs: DataFrame | None, base: DataFrame):
    """Route nodes in the units that declare them, exposed by their modules; links go from the only route of their file."""
    declared = extract.declared_routes(files.filter("source_text IS NOT NULL"))
    routes = declared.filter("kind = 'route'").select("repo_id", "unit", "line", "pattern")
    if configs is not None:
        routes = routes.unionByName(page_routes(files, next_projects(configs)))
    one = cut(routes.groupBy("repo_id", "pattern").agg(F.min(F.struct("unit", "line")).alias("at")).select("repo_id", "pattern", "at.*"))
    nodes = _node(one, "route", name=F.col("pattern"), qualified_name=F.concat(F.lit("route:"), F.col("pattern")), language=language_of(F.col("unit")), location=_span(F.col("unit"), F.col("line"), F.col("line")), visibility=F.lit("public"))
    at = nodes.select("repo_id", "unit", F.col("name").alias("pattern"), F.col("id").alias("dst"), F.col("location.start_line").alias("line"))
    owner = base.filter("kind = 'module'").select("repo_id", "unit", F.col("id").alias("src"))
    exposes = _edge(at.join(owner, ["repo_id", "unit"]), F.lit("exposes"))
    single = at.groupBy("repo_id", "unit").agg(F.count("*").alias("n"), F.min("dst").alias("src")).filter("n = 1").drop("n")
    links = declared.filter("kind = 'href'").join(single, ["repo_id", "unit"]).withColumn("link_id", F.concat_ws("|", "repo_id", "unit", "line", "pattern"))
    matched = extract.link_routes(links.select("link_id", F.col("pattern").alias("href")), one.select("pattern", F.col("unit").alias("path"), "line")).select("link_id", F.col("pattern").alias("to"))
    linked = links.join(matched, "link_id").join(at.select("repo_id", F.col("pattern").alias("to"), "dst"), ["repo_id", "to"]).filter("src != dst").select("src", "dst", "unit", "line").distinct()
    return nodes, exposes.unionByName(_edge(linked, F.lit("links_to")))


def resolution_context(changed: DataFrame, nodes: DataFrame) -> DataFrame:
    """The edges of changed files' facts against a whole graph: names of other files come from its nodes."""
    there = nodes.filter("kind IN ('symbol', 'module')").join(changed.select("repo_id", "unit").distinct(), ["repo_id", "unit"], "left_anti")
    known = there.select("repo_id", "unit", F.when(F.col("kind") == "module", F.col("qualified_name")).alias("module"), F.when(F.col("kind") == "module", "module").otherwise("symbol").alias("fact"), F.when(F.col("kind") == "symbol", F.col("qualified_name")).alias("qualified_name"))
    facts = changed.unionByName(known, allowMissingColumns=True)
    mine = changed.select("repo_id", "unit").distinct()
    return extract.resolve_python(facts).join(mine, ["repo_id", "unit"], "left_semi")
