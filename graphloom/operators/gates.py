"""Gates and advisories on a change: old and new facts compared in batch, one row per finding."""

from __future__ import annotations

import ast
import warnings

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.functions.paths import is_test_path_commit
from graphloom.functions.signatures import normalize_signature
from graphloom.operators.store import GraphStore
from graphloom.operators.traverse import gate_edges
from graphloom.runtime import cut
from graphloom.schema import REFERENCE_EDGES

_KEY = ["repo_id", "qualified_name"]


def new_symbols(old: DataFrame, new: DataFrame) -> DataFrame:
    """Symbols of the new side whose name the old side lacks."""
    return new.join(old.select(*_KEY).distinct(), _KEY, "left_anti")


def deleted_symbols(old: DataFrame, new: DataFrame) -> DataFrame:
    return old.join(new.select(*_KEY).distinct(), _KEY, "left_anti")


def introduced_duplicates(store: GraphStore, staged: DataFrame) -> DataFrame:
    """Duplicate groups (language, normal signature) that a staged new symbol (unit, qualified_name, signature) joins.

    A staged name counts if it equals a member's name or its dotted suffix, in the member's unit with its signature.
    """
    members = store.gate_symbols().filter("kind = 'symbol' AND name != 'main'").select("repo_id", "language", "norm_signature", "unit", "qualified_name")
    groups = members.groupBy("repo_id", "language", "norm_signature").agg(F.count_distinct("qualified_name").alias("n_names")).filter("n_names > 1")
    s = staged.withColumn("norm_signature", normalize_signature("signature", "language")).select("language", "norm_signature", "unit", F.col("qualified_name").alias("staged"))
    met = members.join(s, ["language", "norm_signature", "unit"]).filter((F.col("qualified_name") == F.col("staged")) | F.col("qualified_name").endswith(F.concat(F.lit("."), "staged")))
    return groups.join(met.select("repo_id", "language", "norm_signature").distinct(), ["repo_id", "language", "norm_signature"], "left_semi")


def contract_changes(old: DataFrame, new: DataFrame) -> DataFrame:
    """Names on both sides whose normal signature differs."""
    o = old.select(*_KEY, "language", F.col("signature").alias("was"))
    both = o.join(new.select(*_KEY, F.col("signature").alias("now")), _KEY).filter("was IS NOT NULL AND now IS NOT NULL AND was != now")
    return both.filter(normalize_signature("was", "language") != normalize_signature("now", "language"))


def reference_counts(store: GraphStore) -> DataFrame:
    """dst, number of distinct callers over extracted reference edges."""
    return gate_edges(store.edges, REFERENCE_EDGES).filter("src != dst").groupBy("dst").agg(F.count_distinct("src").alias("n_references"))


def deletion_advisory(store: GraphStore, gone: DataFrame) -> DataFrame:
    """Deleted nodes (id) that live code still references, and how often."""
    return gone.select(F.col("id").alias("dst")).distinct().join(reference_counts(store), "dst").select(F.col("dst").alias("id"), "n_references")


def follow_through(store: GraphStore, changed: DataFrame, touched: DataFrame) -> DataFrame:
    """Callers of changed symbols (id) in units (repo_id, unit) that the change does not touch."""
    e = gate_edges(store.edges, REFERENCE_EDGES).filter("src != dst").join(changed.select(F.col("id").alias("dst")).distinct(), "dst", "left_semi")
    callers = e.select(F.col("src").alias("id"), "dst").distinct().join(store.nodes.select("id", "repo_id", "unit"), "id")
    return callers.join(touched.select("repo_id", "unit").distinct(), ["repo_id", "unit"], "left_anti").groupBy("repo_id", "unit").agg(F.count_distinct("dst").alias("n_changed"))


def fresh_units(cited: DataFrame, current: DataFrame) -> DataFrame:
    """Rows (repo_id, unit, content_hash) whose evidence still stands: the stored hash is the current one."""
    return cited.join(current.select("repo_id", "unit", "content_hash").distinct(), ["repo_id", "unit", "content_hash"], "left_semi")


def test_counts(source: str | None) -> tuple[int, int, int, int]:
    """assertions, skip marks, test functions, parametrize marks of a Python test file."""
    text = source or ""
    try:
        with warnings.catch_warnings():
            warnings.simplefilter("ignore")
            tree = ast.parse(text.removeprefix("﻿"))
    except (SyntaxError, ValueError, RecursionError, MemoryError):
        return 0, 0, 0, 0
    asserts = tests = 0
    for n in ast.walk(tree):
        asserts += isinstance(n, ast.Assert) or isinstance(n, ast.Call) and isinstance(n.func, ast.Attribute) and isinstance(n.func.value, ast.Name) and n.func.value.id == "self" and n.func.attr.startswith("assert")
        tests += isinstance(n, ast.FunctionDef | ast.AsyncFunctionDef) and n.name.startswith("test_")
    skips = sum(text.count(m) for m in ("pytest.mark.skip", "pytest.mark.xfail", "unittest.skip"))
    return asserts, skips, tests, text.count("pytest.mark.parametrize")


def test_metrics(files: DataFrame) -> DataFrame:
    """Counts of each Python test file (repo_id, unit, source_text)."""

    @F.pandas_udf("assertions int, skips int, tests int, parametrized int")
    def count(text: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([test_counts(t) for t in text], columns=["assertions", "skips", "tests", "parametrized"])

    python = files.filter(F.col("unit").endswith(".py") & is_test_path_commit(F.col("unit")) & F.col("source_text").isNotNull())
    return python.select("repo_id", "unit", count("source_text").alias("m")).select("repo_id", "unit", "m.*")


def test_integrity(old: DataFrame, new: DataFrame, touched: DataFrame | None = None) -> DataFrame:
    """Test files with fewer assertions or tests, or more skip marks, than before.

    With `touched` (repo_id, unit) only tests of repositories in which the change touches other than test files count.
    """
    if touched is not None:
        sources = touched.filter(~is_test_path_commit(F.col("unit"))).select("repo_id").distinct()
        old = old.join(sources, "repo_id", "left_semi")
    n = test_metrics(new).select("repo_id", "unit", *[F.col(c).alias(f"new_{c}") for c in ("assertions", "skips", "tests")])
    return test_metrics(old).join(n, ["repo_id", "unit"]).filter("new_assertions < assertions OR new_tests < tests OR new_skips > skips")


def scope_deviation(staged: DataFrame, scope: DataFrame) -> DataFrame:
    """Staged units that no glob of their contract's scope (contract, pattern) covers."""
    regex = F.concat(F.lit("^"), F.regexp_replace(F.regexp_replace(F.regexp_replace("pattern", r"([.+^$()\[\]{}|\\])", r"\\$1"), r"\*\*", "\u0001"), r"\*", "[^/]*"), F.lit("$"))
    rules = scope.withColumn("regex", F.regexp_replace(regex, "\u0001", ".*"))
    s = staged.alias("s")
    covered = s.join(rules.alias("r"), "contract").filter(F.expr("unit RLIKE regex")).select("contract", "unit").distinct()
    return staged.join(covered, ["contract", "unit"], "left_anti")


def expand_scope(store: GraphStore, symbols: DataFrame) -> DataFrame:
    """Units of the symbols (id) and of what depends on them directly."""
    e = gate_edges(store.edges).join(symbols.select(F.col("id").alias("dst")).distinct(), "dst", "left_semi")
    ids = e.select(F.col("src").alias("id")).union(symbols.select("id")).distinct()
    return store.nodes.join(ids, "id", "left_semi").select("repo_id", "unit").distinct()


def lost_ids(before: DataFrame, after: DataFrame) -> DataFrame:
    """Ids that an incremental refresh lost: such a refresh is replaced by a full one."""
    return before.select("id").subtract(after.select("id"))


def new_cycles(old: DataFrame, new: DataFrame, limit: int = 25) -> DataFrame:
    """Cycles of the new module graph that the old one lacks, of any length; the first `limit` in order.

    A cycle is new exactly if one of its edges is: only the components that a new edge touches are searched.
    """
    from graphloom.operators.traverse import all_cycles

    e = lambda df: df.select("src", "dst").filter("src != dst").distinct()
    fresh = cut(e(new).join(e(old), ["src", "dst"], "left_anti"))
    cycles = all_cycles(new, None, touching=fresh)
    after = F.transform("cycle", lambda x, i: F.struct(x.alias("src"), F.element_at("cycle", F.pmod(i + 1, F.size("cycle")).cast("int") + 1).alias("dst")))
    steps = cycles.select("cycle", F.explode(after).alias("step")).select("cycle", "step.*")
    hit = steps.join(fresh, ["src", "dst"], "left_semi").select("cycle").distinct()
    return hit.orderBy("cycle").limit(limit).select(F.array_join("cycle", ">").alias("cycle"))


def staged_new_symbols(old: DataFrame, new: DataFrame, renames: DataFrame | None = None) -> DataFrame:
    """unit, language, qualified_name, signature of staged symbols that are new or whose signature changed.

    old and new have unit, language, qualified_name and signature of the files before and after. A renamed file
    (old_unit, unit) is judged with its old one as a pair, so that moving a file makes nothing new.
    """
    norm = normalize_signature("signature", "language").alias("was")
    before = old.select("unit", "qualified_name", norm)
    if renames is not None:
        moved = before.withColumnRenamed("unit", "old_unit").join(renames.select("old_unit", "unit"), "old_unit").select("unit", "qualified_name", "was")
        before = before.join(renames.select(F.col("old_unit").alias("unit")), "unit", "left_anti").unionByName(moved)
    known = before.distinct().withColumnRenamed("was", "norm_signature")
    return new.withColumn("norm_signature", normalize_signature("signature", "language")).join(known, ["unit", "qualified_name", "norm_signature"], "left_anti").drop("norm_signature")


def commit_gate(store: GraphStore, old: DataFrame | None, new: DataFrame, touched: DataFrame, renames: DataFrame | None = None) -> DataFrame:
    """kind, what, detail of every finding on a commit, blocks first by kind: what a commit introduces, and advice.

    old is None where the state before could not be told: then every duplicate group counts as introduced. touched are
    the units (repo_id, unit) of the commit. Kinds: duplicate (blocks), deleted, follow_through.
    """
    staged = new if old is None else staged_new_symbols(old, new, renames)
    groups = introduced_duplicates(store, staged)
    found = groups.select(F.lit("duplicate").alias("kind"), F.concat_ws(" ", "language", "norm_signature").alias("what"), F.col("n_names").cast("string").alias("detail"), F.lit(True).alias("blocks"))
    changed = store.nodes.join(staged.select("unit", "qualified_name").distinct(), ["unit", "qualified_name"], "left_semi").select("id")
    follow = follow_through(store, changed, touched).select(F.lit("follow_through"), F.concat_ws("/", "repo_id", "unit"), F.col("n_changed").cast("string"), F.lit(False))
    if old is None:
        return found.unionByName(follow.toDF(*found.columns))
    lost = old.select("unit", "qualified_name").distinct().join(new.select("unit", "qualified_name").distinct(), ["unit", "qualified_name"], "left_anti")
    if renames is not None:
        lost = lost.join(renames.select(F.col("old_unit").alias("unit")), "unit", "left_anti")
    gone = deletion_advisory(store, store.nodes.join(lost, ["unit", "qualified_name"], "left_semi").select("id")).select(F.lit("deleted"), F.col("id"), F.col("n_references").cast("string"), F.lit(False))
    return found.unionByName(gone.toDF(*found.columns)).unionByName(follow.toDF(*found.columns))


def write_gate(store: GraphStore, snippets: DataFrame) -> DataFrame:
    """A verdict for each symbol that a Python snippet (key, unit, source_text) would create; its own unit is excluded."""
    from graphloom.operators.queries import check_duplicates
    from graphloom.sources.extract import snippet_symbols

    symbols = snippet_symbols(snippets)
    proposals = symbols.select(F.concat_ws("#", "key", "qualified_name", "start_line").alias("key"), "signature", F.lit("python").alias("language"), F.col("unit").alias("exclude_unit"), "body_hash", "is_type_decl")
    return check_duplicates(store, proposals)
