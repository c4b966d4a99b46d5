import os

import pytest
from pyspark.sql import functions as F

from graphloom.sources import extract, index, walkers

DIR = "/root/testdata/sf0.001"
PROJECT = {
    "app/auth/Auth.java": "package app.auth;\n\nimport app.model.User;\nimport java.util.List;\n\npublic class Auth extends Base implements Checks {\n    @Override\n    public boolean check(User u) {\n        return valid(u) && User.known(u);\n    }\n\n    private boolean valid(User u) {\n        return this.check(u);\n    }\n}\n",
    "app/auth/Base.java": "package app.auth;\n\nclass Base { }\n\ninterface Checks { boolean check(String s); }\n",
    "app/model/User.java": "package app.model;\n\npublic class User {\n    public static boolean known(User u) { return true; }\n}\n",
    "web/store.ts": "import { load as read } from './lib/io';\nimport fs from 'fs';\n\nexport class Store {\n  open(): void {\n    read();\n    this.close();\n  }\n  private close(): void {}\n}\n\nexport const make = () => new Store();\n",
    "web/lib/io.ts": "export function load(): void {}\n",
    "src/auth.rs": "use crate::model::{User, check as verify};\n\npub struct Auth;\n\nimpl Auth {\n    pub fn run(&self) -> bool {\n        self.inner() && verify()\n    }\n    fn inner(&self) -> bool { true }\n}\n",
    "src/model.rs": "pub struct User;\npub fn check() -> bool { true }\n",
    "pkg/a.go": "package pkg\n\nimport \"fmt\"\n\ntype T struct{}\n\nfunc (t *T) Run() int {\n\tfmt.Println(1)\n\treturn helper() + t.step()\n}\n\nfunc (t *T) step() int { return 1 }\n",
    "pkg/b.go": "package pkg\n\nfunc helper() int { return 2 }\n",
    "bad.java": "class {",
}


@pytest.fixture(scope="module")
def graph(spark):
    files = spark.createDataFrame([("r", u, t) for u, t in PROJECT.items()], "repo_id string, unit string, source_text string")
    nodes, edges = index.index_package(files)
    names = nodes.select("id", "qualified_name")
    flat = edges.join(names.withColumnsRenamed({"id": "src", "qualified_name": "a"}), "src").join(names.withColumnsRenamed({"id": "dst", "qualified_name": "b"}), "dst")
    return nodes.cache(), {(r.type, r.a, r.b) for r in flat.collect()}


def test_symbols_of_the_project(graph):
    names = {r.qualified_name for r in graph[0].filter("kind = 'symbol'").collect()}
    assert names == {
        "app.auth.Auth", "app.auth.Auth.check", "app.auth.Auth.valid", "app.auth.Base", "app.auth.Checks", "app.auth.Checks.check", "app.model.User", "app.model.User.known",
        "web.store.Store", "web.store.Store.open", "web.store.Store.close", "web.store.make", "web.lib.io.load", "crate.src.auth.Auth", "crate.src.auth.Auth.run", "crate.src.auth.Auth.inner", "crate.src.model.User", "crate.src.model.check",
        "pkg.T", "pkg.T.Run", "pkg.T.step", "pkg.helper",
    }
    modules = [r.qualified_name for r in graph[0].filter("kind = 'module'").collect()]
    assert len(modules) == len(set(modules)) and "app.auth" in modules  # two files of one package have one module


def test_edges_of_the_project(graph):
    found = graph[1]
    assert {x for x in found if x[0] in ("inherits", "implements")} == {("inherits", "app.auth.Auth", "app.auth.Base"), ("implements", "app.auth.Auth", "app.auth.Checks")}
    calls = {x[1:] for x in found if x[0] == "calls"}
    assert calls == {
        ("app.auth.Auth.check", "app.auth.Auth.valid"), ("app.auth.Auth.check", "app.model.User.known"), ("app.auth.Auth.valid", "app.auth.Auth.check"), ("web.store.Store.open", "web.lib.io.load"), ("web.store.Store.open", "web.store.Store.close"),
        ("crate.src.auth.Auth.run", "crate.src.auth.Auth.inner"), ("pkg.T.Run", "pkg.helper"), ("pkg.T.Run", "pkg.T.step"),
    }
    imports = {x[1:] for x in found if x[0] == "imports"}
    assert {("app.auth", "app.model.User"), ("web.store", "web.lib.io.load"), ("web.store", "fs"), ("app.auth", "java"), ("pkg", "fmt")} <= imports
    assert ("defines", "app.auth", "app.auth.Auth") in found and ("defines", "app.auth.Auth", "app.auth.Auth.valid") in found


def test_kinds_signatures_and_errors(spark):
    files = spark.createDataFrame([("r", u, t) for u, t in PROJECT.items()], "repo_id string, unit string, source_text string")
    rows = walkers.code_facts(files).collect()
    by = {(r.qualified_name, r.unit): r for r in rows if r.fact == "symbol"}
    check = by["app.auth.Auth.check", "app/auth/Auth.java"]
    assert (check.signature, check.start_line, check.end_line, check.visibility, check.is_type_decl) == ("public boolean check(User u)", 8, 10, "exported", False)
    assert by["app.auth.Auth.valid", "app/auth/Auth.java"].visibility == "internal" and by["app.auth.Auth", "app/auth/Auth.java"].is_type_decl
    assert [(r.unit, r.error) for r in rows if r.fact == "error"] == [("bad.java", "Bad")]


@pytest.mark.skipif(not os.path.isdir(DIR), reason="no test tables here")
def test_the_symbols_of_the_tables(spark):
    """Every raw symbol of a file that parses is found with its name, container, signature and lines."""
    f = spark.read.parquet(f"{DIR}/file_facts.parquet").filter("source_text IS NOT NULL")
    files = f.select(F.col("file_id").cast("string").alias("repo_id"), F.regexp_replace("rel_path", r"\\", "/").alias("unit"), "source_text").dropDuplicates(["repo_id"])
    facts = walkers.code_facts(files).unionByName(extract.python_facts(files)).cache()
    parsed = facts.filter("fact = 'module'").select(F.col("repo_id").cast("bigint").alias("file_id"))
    raw = spark.read.parquet(f"{DIR}/raw_symbols.parquet").filter("end_line IS NOT NULL").join(parsed, "file_id", "left_semi")
    lower = F.lower("rel_path")
    raw = raw.filter(~lower.endswith(".py"))
    want = {(r.file_id, r.name, r.start_line, r.end_line, r.signature) for r in raw.collect()}
    got = {(int(r.repo_id), r.name, r.start_line, r.end_line, r.signature) for r in facts.filter("fact = 'symbol'").collect()}
    assert len(want) > 100 and not want - got
