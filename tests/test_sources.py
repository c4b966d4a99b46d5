import json

from graphloom.functions.signatures import canonical_digest
from graphloom.operators import audit, gates, navmap
from graphloom.operators import store as s
from graphloom.schema import EDGES, NODES
from graphloom.sources import diffs, extract, sinks
from graphloom.streaming import units
from tests.test_store_and_queries import edge, node

AUTH = '''"""Doc."""
from sample_pkg.models import User
import os

DEFAULT = User


def validate(token):
    return token


def authenticate(name):
    return validate(name)


def make_user(name):
    return User(name)


def pid():
    os = 1
    return os.getpid()
'''
MODELS = "class Base:\n    def greet(self):\n        return self.name()\n\n    def name(self): return 1\n\n\nclass User(Base):\n    def __init__(self, n):\n        self.n = n\n"


def files(spark, *rows):
    return spark.createDataFrame([("r", u, t) for u, t in rows], "repo_id string, unit string, source_text string")


def test_python_facts_and_edges(spark, rows):
    f = extract.python_facts(files(spark, ("sample_pkg/auth.py", AUTH), ("sample_pkg\\models.py", MODELS), ("sample_pkg/broken.py", "def ("), ("x.go", "func"), ("n.py", None)))
    assert rows(f.filter("fact = 'error'").select("unit", "error")) == [("sample_pkg/broken.py", "SyntaxError")]
    symbols = dict(rows(f.filter("fact = 'symbol'").select("qualified_name", "signature")))
    assert set(symbols) == {"sample_pkg." + x for x in ("models.Base", "models.Base.greet", "models.Base.name", "models.User", "models.User.__init__", "auth.validate", "auth.authenticate", "auth.make_user", "auth.pid")}
    assert symbols["sample_pkg.models.User"] == "class User(Base):"
    e = {(a, b.removeprefix("sample_pkg."), c.removeprefix("sample_pkg.")) for a, b, c in rows(extract.resolve_python(f).filter("type != 'defines'").select("type", "src", "dst"))}
    assert e == {
        ("calls", "auth.authenticate", "auth.validate"), ("calls", "auth.make_user", "models.User"), ("references", "auth", "models.User"), ("imports", "auth", "models.User"), ("imports", "auth", "os"),
        ("inherits", "models.User", "models.Base"), ("calls", "models.Base.greet", "models.Base.name"),
    }
    assert rows(extract.external_packages(extract.resolve_python(f))) == [("r", "os")]
    assert rows(extract.import_graph(f)) == [("r", "sample_pkg.auth", "sample_pkg.models")]


def test_definitions_of_other_languages(spark, rows):
    f = files(spark, ("a/A.java", "package a;\n/* void no() { */\npublic class A {\n  int f(int x) {\n    return 1;\n  }\n}\n"), ("b.go", "package b\n\ntype T struct {}\n\nfunc (t *T) F() {}\n"), ("c.rs", "pub(crate) fn f() {}\n"), ("d.ts", "export class C {\n  m(x: number): void {\n    if (x) {\n    }\n  }\n}\nfunction g() {}\n"))
    assert rows(extract.definitions(f).select("name", "start_line", "is_type")) == [("A", 3, True), ("C", 1, True), ("F", 5, False), ("T", 3, True), ("f", 1, False), ("f", 4, False), ("g", 7, False), ("m", 2, False)]


def test_source_files(spark, rows, tmp_path):
    for name, text in (("a.py", "x"), ("node_modules/b.js", "x"), ("c.txt", "x"), ("README.md", "x"), ("d/e.go", "y" * 2_000_001)):
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_bytes(text.encode() + b"\xff")
    assert rows(extract.source_files(spark, str(tmp_path)).select("rel_path", "language")) == [("README.md", None), ("a.py", "python")]
    assert extract.content_hashes(spark, str(tmp_path)).count() == 5


def test_doc_references(spark, rows):
    n = spark.createDataFrame([node("1", "p.auth.login", repo_id="r"), node("2", "p.a.x", repo_id="r"), node("3", "p.b.x", repo_id="r"), node("4", "p.auth", repo_id="r", kind="module", unit="p/auth.py")], NODES)
    docs = [(1, "see `login()` and `p.a.x`", "r"), (2, "ambiguous `x`, and [a](./auth.py#L3)", "r"), (3, "`login`", "other"), (4, None, "r"), (5, "[b](p/auth.py) [c](no.py)", "r"), (6, "`login`", None)]
    d = spark.createDataFrame(docs, "doc_id bigint, text string, repo_id string")
    assert rows(extract.doc_references(d, n)) == [(1, "1"), (1, "2"), (2, "4"), (5, "4")]


def test_routes(spark, rows):
    f = files(spark, ("a.tsx", 'import { Route } from "react-router";\n<Route path="/items/:id" />\n<Link to="/items/3">x</Link>'), ("b.tsx", '<Route path="/no" />\n<a href="/items/4/">y</a>'), ("c.py", "path = '/x'"))
    found = extract.declared_routes(f)
    assert rows(found.select("unit", "line", "kind", "pattern")) == [("a.tsx", 2, "route", "/items/:id"), ("a.tsx", 3, "href", "/items/3"), ("b.tsx", 2, "href", "/items/4/")]
    links = spark.createDataFrame([(1, "/items/3"), (2, "/items/4/"), (3, "/other/1/2")], "link_id bigint, href string")
    routes = spark.createDataFrame([("/:any/:id", "b.ts", 1), ("/items/:id", "a.ts", 9)], "pattern string, path string, line int")
    assert rows(extract.link_routes(links, routes)) == [(1, "/items/3", "/items/:id"), (2, "/items/4/", "/items/:id")]


def test_diff_regions(spark, rows):
    text = "diff --git a/p/auth.py b/p/auth.py\n+++ b/p/auth.py\n@@ -1,2 +5,2 @@\n+a\n@@ -9 +21 @@ def\n@@ -30,2 +29,0 @@\n--- /dev/null\n+++ b/p\\new.py\n@@ -0,0 +1,3 @@\n+++ /dev/null\n@@ -1,2 +0,0 @@"
    lines = spark.createDataFrame([(7, k, x) for k, x in enumerate(text.split("\n"))], "diff_id bigint, line_no int, line string")
    assert rows(diffs.changed_regions(lines)) == [(7, "p/auth.py", 21, 21), (7, "p/auth.py", 5, 6), (7, "p/new.py", 1, 3)]
    assert diffs.changed_regions(lines.limit(0)).count() == 0


def test_diff_of_no_repository(spark, tmp_path):
    assert diffs.diff_text(spark, str(tmp_path)).count() == 0


def ledger(spark, change=None):
    out, prev = [], ""
    for k in range(4):
        e = {"v": 1, "seq": k, "type": "commit_pass", "tree": f"t{k}", "evidence": {"b": 1, "a": [2]}, "prev": prev}
        e["hash"] = prev = canonical_digest(e)
        out.append(e)
    if change:
        change(out)
    return spark.createDataFrame([(k, x if isinstance(x, str) else json.dumps(x)) for k, x in enumerate(out)], "pos bigint, line string")


def test_ledger(spark, rows):
    assert rows(audit.verify_ledger(ledger(spark))) == [(True, None, None)]
    assert rows(audit.verify_ledger(ledger(spark, lambda e: e[2].update(tree="x")))) == [(False, 2, "hash mismatch")]
    assert rows(audit.verify_ledger(ledger(spark, lambda e: e.pop(1)))) == [(False, 1, "chain break")]
    assert rows(audit.verify_ledger(ledger(spark, lambda e: e.__setitem__(3, "{")))) == [(False, 3, "corrupt")]
    assert rows(audit.verify_ledger(ledger(spark).limit(0))) == [(True, None, None)]
    assert audit.decision_hash("t", None, {"a": 1, "b": 2}) == audit.decision_hash("t", None, {"b": 2, "a": 1})


def test_coverage_and_locks(spark, rows):
    commits = spark.createDataFrame([(1, "s1", "t1"), (2, "s2", "t2")], "seq bigint, sha string, tree string")
    passes = spark.createDataFrame([("t1",), ("t9",), (None,)], "tree string")
    assert rows(audit.gate_coverage(commits, passes)) == [("s1", "verified"), ("s2", "bypass"), ("t9", "pending")]
    import hashlib

    lock = hashlib.blake2b(b"k").hexdigest()
    schema = "contract_key string, seq bigint, type string, lock_hash string, prior_token string, lock_token string, disposition string"
    forged = [("a", 1, "contract_declared", lock, None, None, None), ("a", 2, "contract_declared", None, "bad", None, None), ("a", 3, "contract_closed", None, None, None, "done"), ("b", 1, "contract_declared", lock, None, None, None), ("b", 2, "contract_closed", None, None, "k", "done"), ("c", 1, "contract_declared", lock, None, None, None), ("c", 2, "contract_closed", None, None, None, "abandoned: late")]
    assert rows(audit.lock_walk(spark.createDataFrame(forged, schema))) == [("a", True, 1), ("b", False, None), ("c", False, None)]


def test_runs_scores_and_budget(spark, rows):
    runs = spark.createDataFrame([([("x", False)],)] * 5 + [([("y", True), ("x", False)],)], "checks array<struct<run:string,failed:boolean>>")
    assert rows(audit.check_runs(runs)) == [("x", 6, 0, True), ("y", 1, 1, False)]
    p = spark.createDataFrame([("c", "a"), ("c", "b"), ("c", "b"), ("e", "z")], "k string, v string")
    t = spark.createDataFrame([("c", "b"), ("d", "q")], "k string, v string")
    assert rows(audit.precision_recall(p, t, "k", "v")) == [("c", 0.5, 1.0, 2 / 3), ("d", 1.0, 0.0, 0.0), ("e", 0.0, 1.0, 0.0)]
    stops = spark.createDataFrame([("s", k, k == 2) for k in range(1, 7)], "session string, seq bigint, satisfied boolean")
    assert [r.outcome for r in audit.refusal_budget(stops).orderBy("seq").collect()] == ["refused", "allowed", "refused", "refused", "unsatisfied_stop", "unsatisfied_stop"]
    spans = spark.createDataFrame([("p", float(k)) for k in range(10)], "phase string, v double")
    assert rows(audit.phase_percentiles(spans, "phase", "v")) == [("p", 10, 4.5, 8.55, 8.91)]


def test_gates(spark, rows):
    sym = lambda *x: spark.createDataFrame([("r", q, "python", g) for q, g in x], "repo_id string, qualified_name string, language string, signature string")
    old, new = sym(("f", "f(a)"), ("g", "g(a)"), ("h", "h()")), sym(("f", "f(a: int)"), ("g", "g(a, b)"), ("n", "n()"))
    assert rows(gates.contract_changes(old, new).select("qualified_name")) == [("g",)]
    assert rows(gates.new_symbols(old, new).select("qualified_name")) == [("n",)] and rows(gates.deleted_symbols(old, new).select("qualified_name")) == [("h",)]
    g = s.GraphStore(spark.createDataFrame([node("1", "p.a.f", signature="def f(x)", unit="a.py"), node("2", "p.b.f", signature="def f(x)", unit="b.py"), node("3", "p.c", unit="c.py")], NODES), spark.createDataFrame([edge("3", "1")], EDGES))
    staged = spark.createDataFrame([("b.py", "f", "def f(x: int)", "python"), ("z.py", "f", "def f(x)", "python")], "unit string, qualified_name string, signature string, language string")
    assert rows(gates.introduced_duplicates(g, staged).select("norm_signature", "n_names")) == [("f(x)", 2)]
    assert rows(gates.introduced_duplicates(g, staged.filter("unit = 'z.py'"))) == []
    assert rows(gates.deletion_advisory(g, spark.createDataFrame([("1",), ("2",)], "id string"))) == [("1", 1)]
    touched = spark.createDataFrame([("test", "a.py")], "repo_id string, unit string")
    assert rows(gates.follow_through(g, spark.createDataFrame([("1",)], "id string"), touched)) == [("test", "c.py", 1)]
    assert rows(gates.expand_scope(g, spark.createDataFrame([("1",)], "id string"))) == [("test", "a.py"), ("test", "c.py")]
    t1, t2 = files(spark, ("tests/test_a.py", "def test_a():\n    assert 1\n    assert 2\n")), files(spark, ("tests/test_a.py", "def test_a():\n    assert 1\n"))
    assert gates.test_integrity(t1, t2).count() == 1 and gates.test_integrity(t2, t1).count() == 0
    scope = spark.createDataFrame([("k", "src/**"), ("k", "*.md")], "contract string, pattern string")
    st = spark.createDataFrame([("k", "src/a/b.py"), ("k", "x.md"), ("k", "docs/x.md"), ("j", "src/a.py")], "contract string, unit string")
    assert rows(gates.scope_deviation(st, scope)) == [("j", "src/a.py"), ("k", "docs/x.md")]
    cyc = lambda *x: spark.createDataFrame(list(x), "src string, dst string")
    assert rows(gates.new_cycles(cyc(("a", "b"), ("b", "a")), cyc(("a", "b"), ("b", "a"), ("b", "c"), ("c", "a")))) == [("a>b>c",)]


def test_navigation(spark, rows):
    lm, af = [("heading", "Home", True)], [("go", "link", "Go", None)]
    states = spark.createDataFrame([("m", "home", "/", lm, af, None, False), ("m", "item", "/items/:id", lm, [], None, False), ("m", "new", "/items/new", lm, [], {"tab": "a"}, False), ("m", "bare", "/b", [], [("x", None, None, None), ("x", "a", "b", "c")], None, False)], navmap.STATES)
    tr = spark.createDataFrame([("m", 0, "home", '{"click":"go"}', "item"), ("m", 1, "item", '{"click":"zz"}', "new"), ("m", 2, "home", '{"click":"go"}', "nowhere"), ("m", 3, "home", "{}", "new")], navmap.TRANSITIONS)
    assert {r for _, r, _ in rows(navmap.violations(states, tr))} == {"no landmark", "repeated ref", "no locator", "unknown state", "unknown ref", "repeated action", "not one action"}
    visits = spark.createDataFrame([(1, "m", "http://h/items/7?q=1"), (2, "m", "http://h/items/new#tab=a&x=1"), (3, "m", "http://h/items/new"), (4, "m", "http://h"), (5, "m", "/no/such/page")], "visit_id bigint, map_id string, url string")
    assert rows(navmap.where(visits, states)) == [(1, "item"), (2, "new"), (3, "item"), (4, "home"), (5, "LOST")]
    ways = navmap.find_paths(tr, spark.createDataFrame([("m", "home")], "map_id string, state string"))
    assert [(r.state, r.path) for r in ways.orderBy("state").collect()] == [("item", [0]), ("new", [3]), ("nowhere", [2])]
    drafts = spark.createDataFrame([("m", "/a/:b"), ("m", "/a/b"), ("m", "/")], "map_id string, pattern string")
    assert rows(navmap.draft_map(drafts).select("id")) == [("a.b",), ("a.b~2",), ("root",)]
    assert rows(navmap.removed_routes(drafts, drafts.filter("pattern != '/'"), states).select("id")) == [("home",)]


def test_sinks(spark, tmp_path):
    from xml.etree import ElementTree

    g = s.GraphStore(spark.createDataFrame([node("a", 'p.<x>&"'), node("b")], NODES), spark.createDataFrame([edge("a", "b", line=2)], EDGES))
    sinks.write_graphml(g, str(tmp_path / "g"))
    text = "\n".join(r.value for r in spark.read.text(str(tmp_path / "g"), wholetext=True).collect())
    assert len(list(ElementTree.fromstring(text).iter())) == 1 + 5 + 1 + 2 * 5 + 2
    sinks.write_node_link(g, str(tmp_path / "j"))
    assert spark.read.json(str(tmp_path / "j")).count() == 3
    assert sinks.scip_documents(g).count() == 1
    assert "<circle" in sinks.html_page(g)
    sinks.append_spans(spark.createDataFrame([("p", "n", 5)], "phase string, name string, duration_ns bigint"), str(tmp_path / "s"))
    assert spark.read.json(str(tmp_path / "s")).count() == 1


def test_unit_stream_equals_batch(spark, rows, tmp_path):
    schema = "unit string, fact string, deleted boolean"
    src = str(tmp_path / "in")
    for k, batch in enumerate([[("a", "1", False), ("b", "1", False)], [("a", "2", False)], [("b", None, True)]]):
        spark.createDataFrame(batch, schema).coalesce(1).write.mode("append").parquet(src)
        stream = spark.readStream.schema(schema).parquet(src)
        units.maintain_units(stream, str(tmp_path / "out"), str(tmp_path / "ck")).awaitTermination()
        del k
    assert rows(units.served_units(spark, str(tmp_path / "out")).select("unit", "fact")) == [("a", "2")]


def test_event_stream(spark, rows, tmp_path):
    e = spark.sql("SELECT timestamp'2031-01-01 00:10:00' AS ts, 'x' AS event_type, 1.5D AS value, 7L AS user_id UNION ALL SELECT timestamp'2031-01-01 00:20:00', 'x', 2D, 7 UNION ALL SELECT timestamp'2031-01-01 09:00:00', 'y', 1D, 7")
    e.write.parquet(str(tmp_path / "e"))
    q = units.event_windows(spark.readStream.schema(e.schema).parquet(str(tmp_path / "e"))).writeStream.format("memory").queryName("w").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination()
    assert rows(spark.table("w")) == rows(units.event_windows(e)) and spark.table("w").count() == 2
    assert units.session_windows(e).count() == 2


def test_deltas(spark, rows):
    st = lambda *x: spark.createDataFrame(list(x), "unit string, mtime bigint, size bigint")
    a, b = st(("a", 1, 1), ("b", 1, 1), ("c", 1, 1)), st(("a", 1, 1), ("b", 2, 1), ("d", 1, 1))
    delta = units.file_delta(a, b)
    assert rows(delta) == [("b", "modified"), ("c", "deleted"), ("d", "added")]
    own = spark.createDataFrame([("m", "a"), ("n", "b")], "module string, unit string")
    assert not units.may_refresh_incrementally(delta, own) and units.may_refresh_incrementally(delta.filter("change != 'deleted'"), own)
    assert rows(units.change_signature(a)) == rows(units.change_signature(a.orderBy("unit", ascending=False))) != rows(units.change_signature(b))


def test_listings_and_warnings(spark, rows, tmp_path):
    import subprocess

    assert extract.tracked_files(spark, str(tmp_path)) is None
    subprocess.run(["git", "init", "-q", str(tmp_path)], check=True)
    (tmp_path / "a.py").write_text("x")
    (tmp_path / ".gitignore").write_text("b.py\n")
    (tmp_path / "b.py").write_text("x")
    assert rows(extract.tracked_files(spark, str(tmp_path))) == [(".gitignore", None), ("a.py", "python")]
    assert extract.scale_warning(1, 1) is None and "nodes" in extract.scale_warning(300_000, 1) and "40.0 s" in extract.scale_warning(1, 40)


def test_read_maps(spark, rows):
    good = json.dumps({"version": 1, "states": [{"id": "home", "url": "/", "landmarks": [{"role": "h", "name": "n"}], "affordances": [{"ref": "go", "css": "a"}]}], "transitions": [{"from": "home", "do": {"click": "go"}, "to": "home"}]})
    states, moves, bad = navmap.read_maps(spark.createDataFrame([("m", good), ("x", "{"), ("n", None)], "map_id string, json string"))
    assert rows(bad) == [("n",), ("x",)] and states.count() == 1
    assert rows(moves) == [("m", 0, "home", '{"click":"go"}', "home")]
    assert navmap.violations(states, moves).count() == 0


def test_contracts_and_attestations(spark, rows):
    import pytest

    assert audit.parse_contract('{"checks": ["pytest"]}')["timeout_s"] == 600
    for text in ("[]", "{", '{"checks": []}', '{"checks": ["x"], "other": 1}', '{"checks": ["x"], "timeout_s": NaN}', '{"checks": [1]}'):
        with pytest.raises(ValueError):
            audit.parse_contract(text)
    need = spark.createDataFrame([("h", "t", "a"), ("h", "t", "b")], "contract_hash string, tree string, name string")
    lines = spark.createDataFrame([("attestation", "h", "t", "a"), ("attestation", "h", "other", "b"), ("note", "h", "t", "b")], "type string, contract_hash string, tree string, name string")
    assert rows(audit.missing_attestations(need, lines)) == [("h", "t", "b")]
