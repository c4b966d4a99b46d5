"""From source texts to facts: Python symbols, imports and names, resolved relationally; documents and routes.

Python is read with the standard library's parser; for the other languages definitions are found by their signatures.
Texts are read where they lie; only rows move. A file that does not parse gives one error row and fails nothing.
"""

from __future__ import annotations

import ast
import os
import re
import warnings
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.functions.paths import SUFFIXES, href_matches, language_of, module_qname, posix
from graphloom.functions.signatures import body_digest

MAX_BYTES = 2_000_000
# Directories that are never walked.
EXCLUDED_DIRS = (".git", ".hg", ".svn", "__pycache__", "node_modules", ".venv", "venv", ".tox", ".mypy_cache", ".pytest_cache", ".ruff_cache", "dist", "build", ".eggs", "site-packages")


def source_files(spark: SparkSession, root: str) -> DataFrame:
    """path, language, text of the indexable files under a directory: known suffix, not excluded, not over 2 MB.

    The tree is walked first, without excluded directories and symbolic links; only the files that count are read.
    """
    files = read_files(spark, root)
    return files.select("rel_path", language_of(F.col("rel_path")).alias("language"), F.make_valid_utf8(F.col("content").cast("string")).alias("source_text")).filter("language IS NOT NULL OR rel_path LIKE '%.md'")


_SUFFIXES = tuple(s for suffixes in SUFFIXES.values() for s in suffixes) + (".md",)


def walked_dirs(root: str) -> list[str]:
    """The directories under a root that hold files to read, in order: a listing of directories, which the driver holds."""
    out = []
    for at, dirs, names in os.walk(root, followlinks=False):
        dirs[:] = sorted(d for d in dirs if d not in EXCLUDED_DIRS and not os.path.islink(os.path.join(at, d)))
        if any(n.lower().endswith(_SUFFIXES) for n in names):
            out.append(at)
    return out


def read_files(spark: SparkSession, root: str) -> DataFrame:
    """rel_path, content, length of the files with a known suffix; bytes of larger files and of links are never read.

    A root of another file system is listed by Spark: there excluded directories are left out after the listing.
    """
    if "://" in root:
        found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
        rel = F.regexp_replace("path", "^" + re.escape(root.rstrip("/")) + "/", "")
        excluded = F.exists(F.split(rel, "/"), lambda s: s.isin(*EXCLUDED_DIRS))
        return found.filter(F.col("length") <= MAX_BYTES).filter(~excluded & F.lower("path").rlike("(?:" + "|".join(map(re.escape, _SUFFIXES)) + ")$")).select(rel.alias("rel_path"), "length", "content")
    dirs = walked_dirs(root)
    schema = "rel_path string, length bigint, content binary"
    if not dirs:
        return spark.createDataFrame([], schema)
    found = spark.read.format("binaryFile").load(dirs)
    rel = F.regexp_replace(F.regexp_replace("path", "^file:/*", "/"), "^" + re.escape(os.path.abspath(root).rstrip("/")) + "/", "")
    links = [os.path.relpath(os.path.join(d, n), root) for d in dirs for n in os.listdir(d) if os.path.islink(os.path.join(d, n))]
    kept = found.filter(F.col("length") <= MAX_BYTES).filter(F.lower("path").rlike("(?:" + "|".join(map(re.escape, _SUFFIXES)) + ")$")).select(rel.alias("rel_path"), "length", "content")
    return kept.filter(~F.col("rel_path").isin(links)) if links else kept


def content_hashes(spark: SparkSession, root: str) -> DataFrame:
    """rel_path and hash of each file's bytes."""

    @F.pandas_udf("string")
    def digest(content: pd.Series) -> pd.Series:
        import hashlib

        return content.map(lambda b: hashlib.blake2b(b, digest_size=16).hexdigest())

    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    return files.select(F.regexp_replace(F.regexp_replace("path", "^file:", ""), "^" + re.escape(root.rstrip("/")) + "/", "").alias("rel_path"), digest("content").alias("content_hash"))


# ---------------------------------------------------------------- Python facts


def _signature(node: ast.AST) -> str:
    if isinstance(node, ast.ClassDef):
        bases = ", ".join(ast.unparse(b) for b in node.bases)
        return f"class {node.name}({bases}):" if bases else f"class {node.name}:"
    args = ast.unparse(node.args)
    returns = f" -> {ast.unparse(node.returns)}" if node.returns else ""
    return f"{'async ' if isinstance(node, ast.AsyncFunctionDef) else ''}def {node.name}({args}){returns}:"


class _Python(ast.NodeVisitor):
    def __init__(self, module: str, text: str, package: bool):
        self.module, self.lines, self.package = module, text.split("\n"), package
        self.symbols: list[tuple] = []
        self.imports: list[tuple] = []
        self.names: list[tuple] = []
        self.scope: list[tuple[str, str]] = []  # (name, kind)
        self.locals: list[set[str]] = []
        self.type_only = False

    def _qname(self, name: str) -> str:
        return ".".join([self.module, *(n for n, _ in self.scope), name])

    def _source(self) -> str:
        for k in range(len(self.scope), 0, -1):
            if self.scope[k - 1][1] == "function":
                return ".".join([self.module, *(n for n, _ in self.scope[:k])])
        return self.module

    def _define(self, node, kind: str) -> None:
        container = ".".join([self.module, *(n for n, _ in self.scope)])
        body = "\n".join(self.lines[node.body[0].lineno - 1 : node.end_lineno])
        self.symbols.append((node.name, self._qname(node.name), container, _signature(node), node.lineno, node.end_lineno, "internal" if node.name.startswith("_") else "exported", isinstance(node, ast.ClassDef), body_digest(body), not self.scope))
        for d in node.decorator_list:
            self.visit(d)
        if isinstance(node, ast.ClassDef):
            for b in node.bases:
                self._name(b, "inherits", self._qname(node.name))
        self.scope.append((node.name, kind))
        if kind == "function":
            a = node.args
            own = {x.arg for x in (*a.posonlyargs, *a.args, *a.kwonlyargs, *filter(None, (a.vararg, a.kwarg)))}
            own |= {n.id for n in ast.walk(node) if isinstance(n, ast.Name) and isinstance(n.ctx, ast.Store)}
            self.locals.append(own - {x for n in ast.walk(node) if isinstance(n, ast.Global) for x in n.names})
        for child in node.body:
            self.visit(child)
        if kind == "function":
            self.locals.pop()
        self.scope.pop()

    def visit_FunctionDef(self, node) -> None:
        self._define(node, "function")

    visit_AsyncFunctionDef = visit_FunctionDef

    def visit_ClassDef(self, node) -> None:
        self._define(node, "class")

    def _base(self, level: int) -> str:
        parts = self.module.split(".")
        return ".".join(parts[: len(parts) - level + (1 if self.package else 0)]) if level else ""

    def visit_Import(self, node) -> None:
        for a in node.names:
            self.imports.append(((a.asname or a.name.split(".")[0]), a.name if a.asname else a.name.split(".")[0], a.name, None, node.lineno, self._source(), self.type_only))

    def visit_ImportFrom(self, node) -> None:
        base = ".".join(filter(None, (self._base(node.level), node.module or "")))
        for a in node.names:
            self.imports.append((a.asname or a.name, f"{base}.{a.name}", base, a.name, node.lineno, self._source(), self.type_only))

    def visit_If(self, node) -> None:
        """What stands under TYPE_CHECKING is there for types only."""
        self.visit(node.test)
        known, checked = self.type_only, _dotted(node.test) or ""
        self.type_only = known or checked.rpartition(".")[2] == "TYPE_CHECKING"
        for child in node.body:
            self.visit(child)
        self.type_only = known
        for child in node.orelse:
            self.visit(child)

    def _name(self, node: ast.AST, relation: str, source: str | None = None) -> None:
        dotted = _dotted(node)
        if dotted:
            first = dotted.split(".")[0]
            shadowed = first not in ("self", "cls") and any(first in s for s in self.locals)
            enclosing = ".".join([self.module, *(n for n, _ in self.scope)])
            self.names.append((relation, dotted, node.lineno, shadowed, source or self._source(), enclosing))
        else:
            self.visit(node)

    def visit_Call(self, node) -> None:
        self._name(node.func, "calls")
        for child in (*node.args, *node.keywords):
            self.visit(child)

    def visit_Name(self, node) -> None:
        if isinstance(node.ctx, ast.Load):
            self._name(node, "references")

    def visit_Attribute(self, node) -> None:
        if isinstance(node.ctx, ast.Load) and _dotted(node):
            self._name(node, "references")
        else:
            self.generic_visit(node)


def _dotted(node: ast.AST) -> str | None:
    parts = []
    while isinstance(node, ast.Attribute):
        parts.append(node.attr)
        node = node.value
    return ".".join([node.id, *reversed(parts)]) if isinstance(node, ast.Name) else None


FACTS = (
    "repo_id string, unit string, module string, fact string, error string, name string, qualified_name string, container string, signature string, start_line int, end_line int, visibility string, "
    "is_type_decl boolean, body_hash string, is_top_level boolean, type_only boolean, alias string, target string, target_module string, target_name string, relation string, shadowed boolean, source string, enclosing string"
)


def python_facts(files: DataFrame) -> DataFrame:
    """One row per symbol, import, name or error of the Python files (repo_id, unit, source_text): see `fact`."""
    columns = [c.split()[0] for c in FACTS.split(", ")]

    def rows(repo: str, unit: str, module: str, text: str) -> list[dict]:
        base = {"repo_id": repo, "unit": unit, "module": module}
        try:
            with warnings.catch_warnings():
                warnings.simplefilter("ignore")
                tree = ast.parse((text or "").removeprefix("﻿"))
            v = _Python(module, text, unit.endswith("__init__.py"))
            v.visit(tree)
        except (SyntaxError, ValueError, RecursionError, MemoryError) as x:
            return [base | {"fact": "error", "error": type(x).__name__}]
        out = [base | {"fact": "module", "start_line": 1, "end_line": text.count("\n") + 1}]
        keys = ("name", "qualified_name", "container", "signature", "start_line", "end_line", "visibility", "is_type_decl", "body_hash", "is_top_level")
        out += [base | {"fact": "symbol"} | dict(zip(keys, s, strict=True)) for s in v.symbols]
        out += [base | {"fact": "import"} | dict(zip(("alias", "target", "target_module", "target_name", "start_line", "source", "type_only"), s, strict=True)) for s in v.imports]
        out += [base | {"fact": "name"} | dict(zip(("relation", "name", "start_line", "shadowed", "source", "enclosing"), s, strict=True)) for s in v.names]
        return out

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            found = [r for args in zip(b["repo_id"], b["unit"], b["module"], b["source_text"], strict=True) for r in rows(*args)]
            out = pd.DataFrame(found, columns=columns).astype(object)
            yield out.where(out.notna(), None)

    unit = posix(F.col("unit"))
    python = files.filter((language_of(F.col("unit")) == "python") & F.col("source_text").isNotNull())
    return python.select("repo_id", unit.alias("unit"), module_qname(unit, F.lit("python")).alias("module"), "source_text").mapInPandas(run, FACTS)


def snippet_symbols(snippets: DataFrame) -> DataFrame:
    """key, unit, qualified_name (within the snippet), signature, start_line, body_hash, is_type_decl of each symbol that a
    Python text (key, unit, source_text) defines; a text that does not parse defines none."""
    keyed = snippets.select(F.concat_ws("\x1f", F.col("key").cast("string"), "unit").alias("repo_id"), F.lit("snippet.py").alias("unit"), "source_text")
    found = python_facts(keyed).filter("fact = 'symbol'")
    parts = F.split("repo_id", "\x1f")
    return found.select(parts[0].alias("key"), parts[1].alias("unit"), F.regexp_replace("qualified_name", r"^snippet\.", "").alias("qualified_name"), "signature", "start_line", "body_hash", "is_type_decl")


def resolve_python(facts: DataFrame) -> DataFrame:
    """type, src, dst (qualified names), repo_id, unit, line, external: the edges of Python facts.

    A name binds to an import, else to a top-level symbol of its module, else (self.) to a method of its class; names of
    locals bind to nothing. Only unambiguous targets count: an edge may be lost, none is invented. An import of
    what is not in the repository goes to an external package; any other outside target is dropped.
    """
    symbols = facts.filter("fact = 'symbol'").select("repo_id", F.col("qualified_name").alias("q"), F.col("module").alias("m")).distinct()
    modules = facts.filter("fact = 'module'").select("repo_id", F.col("module").alias("q")).distinct()
    known = symbols.select("repo_id", "q").unionByName(modules).distinct()
    imports = facts.filter("fact = 'import'").select("repo_id", "unit", "module", "alias", "target", "target_module", "start_line", "source")
    imports = imports.filter("alias IS NOT NULL")
    names = facts.filter("fact = 'name' AND NOT shadowed").select("repo_id", "unit", "module", "relation", "name", "start_line", "source", "enclosing")
    # a dotted name under an import: its first segment is the alias
    first = F.substring_index("name", ".", 1)
    rest = F.when(F.col("name").contains("."), F.regexp_replace("name", r"^[^.]+", "")).otherwise("")
    bound = names.withColumn("alias", first).join(imports.groupBy("repo_id", "unit", "alias").agg(F.max("target").alias("target"), F.count_distinct("target").alias("n")).filter("n = 1"), ["repo_id", "unit", "alias"])
    via_import = bound.select("repo_id", "unit", "relation", "start_line", "source", F.concat("target", rest).alias("q"), F.lit(1).alias("rank"), "name")
    local = names.select("repo_id", "unit", "relation", "start_line", "source", F.concat_ws(".", "module", "name").alias("q"), F.lit(2).alias("rank"), "name")
    klass = F.regexp_replace("source", r"\.[^.]+$", "")
    method = names.filter(F.col("name").rlike(r"^(?:self|cls)\.\w+$")).select("repo_id", "unit", "relation", "start_line", "source", F.concat(klass, F.lit("."), F.substring_index("name", ".", -1)).alias("q"), F.lit(0).alias("rank"), "name")
    candidates = via_import.unionByName(local).unionByName(method).join(symbols.select("repo_id", "q"), ["repo_id", "q"])
    best = candidates.groupBy("repo_id", "unit", "relation", "start_line", "source", "name").agg(F.min(F.struct("rank", "q")).alias("b"))
    edges = best.filter("b.q != source OR relation = 'calls'").select(F.col("relation").alias("type"), F.col("source").alias("src"), F.col("b.q").alias("dst"), "repo_id", "unit", F.col("start_line").alias("line"), F.lit(False).alias("external"))
    i = imports.join(known.withColumnRenamed("q", "target").withColumn("exact", F.lit(True)), ["repo_id", "target"], "left").join(known.withColumnRenamed("q", "target_module").withColumn("whole", F.lit(True)), ["repo_id", "target_module"], "left")
    dst = F.when(F.col("exact"), F.col("target")).when(F.col("whole"), F.col("target_module")).otherwise(F.substring_index("target_module", ".", 1))
    imported = i.select(F.lit("imports").alias("type"), F.col("module").alias("src"), dst.alias("dst"), "repo_id", "unit", F.col("start_line").alias("line"), (F.col("exact").isNull() & F.col("whole").isNull()).alias("external"))
    defines = facts.filter("fact = 'symbol'").select(F.lit("defines").alias("type"), F.col("container").alias("src"), F.col("qualified_name").alias("dst"), "repo_id", "unit", F.col("start_line").alias("line"), F.lit(False).alias("external"))
    return edges.unionByName(imported).unionByName(defines).distinct()


def import_graph(facts: DataFrame) -> DataFrame:
    """repo_id, src, dst of Python modules by their imports: the longest known module that an import's name begins with.

    Names are import names (`src/` and `__init__` dropped), imports under TYPE_CHECKING and of a module by itself do not
    count. The names' prefixes are exploded and joined for equality, so no import meets modules that it does not name.
    """
    known = facts.filter("fact = 'module'").select("repo_id", import_name(F.col("module")).alias("owner")).distinct()
    asked = facts.filter("fact = 'import' AND NOT type_only").select("repo_id", import_name(F.col("module")).alias("src"), import_name(F.col("target")).alias("dst")).distinct()
    parts = F.split("dst", r"\.")
    prefixes = asked.select("repo_id", "src", "dst", F.explode(F.transform(F.sequence(F.lit(1), F.size(parts)), lambda k: F.array_join(F.slice(parts, 1, k), "."))).alias("owner"))
    best = prefixes.join(known, ["repo_id", "owner"]).groupBy("repo_id", "src", "dst").agg(F.max_by("owner", F.length("owner")).alias("to"))
    return best.filter("src != to").select("repo_id", "src", F.col("to").alias("dst")).distinct()


def import_name(module: Column) -> Column:
    """A dotted module name without the source directory before it."""
    return F.regexp_replace(module, r"^src\.(?=.)", "")


def external_packages(edges: DataFrame) -> DataFrame:
    return edges.filter("external").select("repo_id", F.col("dst").alias("name")).distinct()


# ---------------------------------------------------------------- definitions of the other languages

_DEFINITION = {
    "java": r"^[ \t]*(?:(?:public|private|protected|static|final|abstract|synchronized|default|native)\s+)*(?:(?P<type>class|interface|enum|record)\s+(?P<tname>\w+)|[\w<>\[\],.? ]+\s+(?P<name>\w+)\s*\([^;{]*\)\s*(?:throws [\w., ]+)?\s*\{)",
    "csharp": r"^[ \t]*(?:(?:public|private|protected|internal|static|sealed|abstract|virtual|override|async|partial|readonly)\s+)*(?:(?P<type>class|interface|struct|enum|record)\s+(?P<tname>\w+)|[\w<>\[\],.?]+\s+(?P<name>\w+)\s*\([^;{]*\)\s*\{)",
    "go": r"^(?:type\s+(?P<tname>\w+)\s+(?P<type>struct|interface)|func\s*(?:\([^)]*\)\s*)?(?P<name>\w+)\s*\()",
    "rust": r"^[ \t]*(?:pub(?:\([^)]*\))?\s+)?(?:(?:async|unsafe|const|extern)\s+)*(?:(?P<type>struct|enum|trait)\s+(?P<tname>\w+)|fn\s+(?P<name>\w+))",
    "kotlin": r"^[ \t]*(?:(?:public|private|protected|internal|open|abstract|override|suspend|inline|data|sealed)\s+)*(?:(?P<type>class|interface|object)\s+(?P<tname>\w+)|fun\s+(?:[\w.]+\.)?(?P<name>\w+)\s*\()",
    "swift": r"^[ \t]*(?:(?:public|private|fileprivate|internal|open|final|static|override|mutating)\s+)*(?:(?P<type>class|struct|enum|protocol)\s+(?P<tname>\w+)|func\s+(?P<name>\w+))",
    "typescript": r"^[ \t]*(?:(?:export|default|async|abstract|declare|public|private|protected|static|readonly)\s+)*(?:(?P<type>class|interface|enum)\s+(?P<tname>\w+)|function\s*\*?\s*(?P<name>\w+)|(?!(?:if|for|while|switch|catch|return|function)\b)(?P<method>\w+)\s*\([^;{]*\)\s*(?::\s*[\w<>\[\]|., ]+)?\s*\{)",
    "c": r"^(?!\s*(?:return|else|if|for|while|switch)\b)[ \t]*(?:(?:static|inline|extern|const|unsigned|struct|constexpr|virtual)\s+)*(?:(?P<type>class|struct|union|enum)\s+(?P<tname>\w+)\s*\{|[\w:<>]+[\s*&]+(?P<name>\w+)\s*\([^;{]*\)\s*(?:const\s*)?\{)",
}
_DEFINITION["javascript"], _DEFINITION["cpp"] = _DEFINITION["typescript"], _DEFINITION["c"]
_DEFINITION = {k: re.compile(v, re.M) for k, v in _DEFINITION.items()}


def _line_end(text: str, at: int) -> int:
    end = text.find("\n", at)
    return len(text) if end < 0 else end


def definitions(files: DataFrame) -> DataFrame:
    """repo_id, unit, language, name, start_line, is_type, head of the definitions in files of the ten other languages.

    head is the text from the definition's line to its body or end, in one line.
    """

    @F.pandas_udf("array<struct<name:string,start_line:int,is_type:boolean,head:string>>")
    def found(language: pd.Series, text: pd.Series) -> pd.Series:
        out = []
        for x, t in zip(language, text, strict=True):
            t = re.sub(r"/\*.*?\*/|//[^\n]*", lambda m: re.sub(r"[^\n]", " ", m[0]), t.replace("\r\n", "\n").replace("\r", "\n"), flags=re.S)
            rows = []
            for m in _DEFINITION[x].finditer(t):
                g = m.groupdict()
                name = g.get("name") or g.get("tname") or g.get("method")
                rows.append({"name": name, "start_line": t.count("\n", 0, m.start() + len(m[0]) - len(m[0].lstrip())) + 1, "is_type": g.get("tname") is not None, "head": " ".join(re.split(r"[{;]", t[m.start() : _line_end(t, m.end())], maxsplit=1)[0].split())})
            out.append(rows)
        return pd.Series(out, dtype=object)

    known = files.withColumn("language", language_of(F.col("unit"))).filter(F.col("language").isin(*_DEFINITION) & F.col("source_text").isNotNull())
    return known.select("repo_id", posix(F.col("unit")).alias("unit"), "language", F.explode(found("language", "source_text")).alias("d")).select("repo_id", "unit", "language", "d.*")


# ---------------------------------------------------------------- documents and routes


#: A code span on one line, between single or double marks; the target of a link; suffixes of files that links may name.
CODE_SPAN, LINK, LINKED = r"`{1,2}([^`\n]+)`{1,2}", r"\[[^\]\n]*\]\(([^()\n]+)\)", ("py", "ts", "tsx")


def doc_references(documents: DataFrame, nodes: DataFrame) -> DataFrame:
    """doc_id, node id of every mention: code spans by exact name or the only bare name, links by unit or its only suffix.

    Spans name symbols, links to .py, .ts and .tsx files name modules; what is ambiguous in the document's repository
    names nothing. Documents without repository mention nothing.
    """
    docs = documents.filter(F.col("text").isNotNull() & F.col("repo_id").isNotNull())
    # a span that names a source file is no symbol; runs of blanks are folded by trim only, as spans are single lines
    span = F.trim(F.regexp_replace(F.trim(F.col("raw")), r"\(\)$", ""))
    spans = docs.select("doc_id", "repo_id", F.explode(F.regexp_extract_all("text", F.lit(CODE_SPAN), 1)).alias("raw")).select("doc_id", "repo_id", span.alias("text")).distinct()
    symbols = nodes.filter("kind = 'symbol'").select("repo_id", "id", "name", "qualified_name", "load_seq")
    by_q = symbols.groupBy("repo_id", F.col("qualified_name").alias("text")).agg(F.max_by("id", "load_seq").alias("exact"))
    by_name = symbols.groupBy("repo_id", F.col("name").alias("text")).agg(F.count("*").alias("n"), F.min("id").alias("only")).filter("n = 1")
    hit = spans.join(by_q, ["repo_id", "text"], "left").join(by_name, ["repo_id", "text"], "left").select("doc_id", F.coalesce("exact", "only").alias("id")).filter("id IS NOT NULL")
    # the place that any link names, up to its fragment, query or title; those of source files count
    place = F.regexp_replace(F.trim(F.col("raw")), r"[#?\s].*$", "")
    links = docs.select("doc_id", "repo_id", F.explode(F.regexp_extract_all("text", F.lit(LINK), 1)).alias("raw")).select("doc_id", "repo_id", F.regexp_replace(place, r"^[./]+", "").alias("target"), F.substring_index(place, ".", -1).alias("suffix")).filter(F.col("suffix").isin(*LINKED)).drop("suffix").distinct()
    modules = nodes.filter("kind = 'module'").select("repo_id", "id", "unit")
    exact = modules.groupBy("repo_id", F.col("unit").alias("target")).agg(F.min("id").alias("exact"))
    parts = F.split("unit", "/")
    suffix = modules.filter(F.size(parts) > 1).select("repo_id", "id", F.explode(F.transform(F.sequence(F.lit(2), F.size(parts)), lambda k: F.array_join(F.slice(parts, k, F.size(parts)), "/"))).alias("target")).groupBy("repo_id", "target").agg(F.count("*").alias("n"), F.min("id").alias("only")).filter("n = 1")
    linked = links.join(exact, ["repo_id", "target"], "left").join(suffix, ["repo_id", "target"], "left").select("doc_id", F.coalesce("exact", "only").alias("id")).filter("id IS NOT NULL")
    return hit.unionByName(linked).distinct()


def link_routes(links: DataFrame, routes: DataFrame) -> DataFrame:
    """links (link_id, href) with the first declared route (pattern, path, line) that each matches."""
    parts = lambda c: F.split(F.rtrim(c, F.lit("/")), "/")
    first = routes.groupBy("pattern").agg(F.min(F.struct("path", "line")).alias("at"))
    # a link meets the patterns of its length that begin, and end, with its own segment or with a parameter
    shape = lambda p: F.when(p.startswith(":"), F.lit(":")).otherwise(p)
    own = parts(F.col("pattern"))
    keyed = first.withColumn("n", F.size(own)).withColumn("first", shape(F.try_element_at(own, F.lit(2)))).withColumn("last", shape(F.element_at(own, -1)))
    asked = parts(F.col("href"))
    either = lambda s: F.array(s, F.lit(":"))
    spread = links.withColumn("n", F.size(asked)).withColumn("first", F.explode(either(F.try_element_at(asked, F.lit(2))))).withColumn("last", F.explode(either(F.element_at(asked, -1))))
    same = (F.col("l.n") == F.col("r.n")) & F.col("l.first").eqNullSafe(F.col("r.first")) & (F.col("l.last") == F.col("r.last"))
    met = spread.alias("l").join(keyed.alias("r"), same).filter(href_matches(F.col("href"), F.col("pattern")))
    return met.groupBy("link_id", "href").agg(F.min(F.struct("at", "pattern")).alias("m")).select("link_id", "href", "m.pattern")


_IMPORTED = re.compile(r"""\b(?:import|from|require)\b[^'"\n;]*['"]([^'"\n]+)""")
_ROUTERS = ("react-router", "vue-router")
_ROUTE = re.compile(r"""<Route\b[^>]*?\bpath\s*=\s*\{?\s*["']([^"'{}]*)["']|\bpath\s*:\s*["']([^"']*)["']""")
_HREF = re.compile(r"""<(?:a|Link|NavLink|router-link)\b[^>]*?\b(?:href|to)\s*=\s*\{?\s*["'](/[^"'{}]*)["']""")


def declared_routes(files: DataFrame) -> DataFrame:
    """unit, line, pattern of routes in files that import a router, and hrefs (kind href) of links to absolute paths."""

    @F.pandas_udf("array<struct<kind:string,line:int,pattern:string>>")
    def found(text: pd.Series) -> pd.Series:
        out = []
        for t in text:
            rows = [{"kind": "href", "line": t.count("\n", 0, m.start()) + 1, "pattern": m[1]} for m in _HREF.finditer(t)]
            if any(m[1].startswith(_ROUTERS) for m in _IMPORTED.finditer(t)):
                for m in _ROUTE.finditer(t):
                    path = m[1] if m[1] is not None else m[2]
                    if path and "*" not in path:
                        rows.append({"kind": "route", "line": t.count("\n", 0, m.start()) + 1, "pattern": path if path.startswith("/") else "/" + path})
            out.append(rows)
        return pd.Series(out, dtype=object)

    # the cheap test comes first: Python only sees texts that can hold a route or a link
    js = files.filter(language_of(F.col("unit")).isin("typescript", "javascript") & F.col("source_text").rlike(r"(?:href|to|path)\s*[=:]"))
    return js.select("repo_id", posix(F.col("unit")).alias("unit"), F.explode(found("source_text")).alias("r")).select("repo_id", "unit", "r.*")


# ---------------------------------------------------------------- listings


def tracked_files(spark: SparkSession, repository: str) -> DataFrame | None:
    """rel_path, language of the tracked and the untracked, not ignored files; None outside a repository.

    The listing is one subprocess on the driver: it is bounded by one checkout.
    """
    import subprocess

    done = subprocess.run(["git", "-C", repository, "ls-files", "-z", "--cached", "--others", "--exclude-standard"], capture_output=True, check=False)
    if done.returncode:
        return None
    paths = sorted({p for p in done.stdout.decode("utf-8", "replace").split("\0") if p})
    return spark.createDataFrame([(p,) for p in paths], "rel_path string").withColumn("language", language_of(F.col("rel_path")))


def scale_warning(n_nodes: int, seconds: float, most_nodes: int = 200_000, most_seconds: float = 30.0) -> str | None:
    """What to say of a graph beyond the size or time that one process should hold; None within both."""
    over = [f"{n_nodes} nodes (over {most_nodes})"] * (n_nodes > most_nodes) + [f"{seconds:.1f} s (over {most_seconds:g})"] * (seconds > most_seconds)
    return "large graph: " + ", ".join(over) if over else None
