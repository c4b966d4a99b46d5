import json

import pytest
from pyspark.sql import functions as F

from graphloom.operators import audit, gates, navmap, tools, views
from graphloom.operators.store import GraphStore, load_graph, save_graph
from graphloom.schema import EDGES, NODES
from graphloom.sources import index
from graphloom.streaming import units

MODELS = "class Base:\n    def greet(self):\n        return 1\n\n\nclass User(Base):\n    def __init__(self, name):\n        self.name = name\n"
AUTH = 'import os\n\nfrom sample_pkg.models import User\n\nDEFAULT = User\n\n\ndef authenticate(name, secret):\n    return validate(name, secret)\n\n\ndef validate(name, secret):\n    return bool(name)\n\n\ndef make_user(name):\n    return User(name)\n\n\ndef pid():\n    return os.getpid()\n'


@pytest.fixture(scope="module")
def sample(spark):
    files = spark.createDataFrame([("r", "sample_pkg/auth.py", AUTH), ("r", "sample_pkg\\models.py", MODELS), ("r", "x/T.java", "package x;\npublic class T {\n    public int f(int a) {\n        return a;\n    }\n}\n")], "repo_id string, unit string, source_text string")
    docs = spark.createDataFrame([(1, "r", "README.md", "See `validate()` and [models](sample_pkg/models.py)."), (2, "r", "b.md", "Nothing.")], "doc_id bigint, repo_id string, path string, text string")
    nodes, edges = index.index_package(files, docs)
    return nodes.cache(), edges.cache()


def test_facts_of_the_sample(sample):
    nodes, edges = sample
    name = {r.id: r.qualified_name for r in nodes.collect()}
    assert len(name) == nodes.count()
    of = lambda kind: {r.qualified_name for r in nodes.filter(F.col("kind") == kind).collect()}
    py = {q for q in of("symbol") if q.startswith("sample_pkg")}
    assert py == {f"sample_pkg.{x}" for x in ("models.Base", "models.Base.greet", "models.User", "models.User.__init__", "auth.authenticate", "auth.validate", "auth.make_user", "auth.pid")}
    assert {m for m in of("module") if m.startswith("sample_pkg")} == {"sample_pkg.models", "sample_pkg.auth"} and of("external_package") == {"os"}
    got = {}
    for e in edges.collect():
        got.setdefault(e.type, set()).add((name[e.src].removeprefix("sample_pkg."), name[e.dst].removeprefix("sample_pkg.")))
    assert {x for x in got["defines"] if not x[0].startswith("x")} == {("models", "models.Base"), ("models", "models.User"), ("models.Base", "models.Base.greet"), ("models.User", "models.User.__init__"), *(("auth", f"auth.{x}") for x in ("authenticate", "validate", "make_user", "pid"))}
    assert got["inherits"] == {("models.User", "models.Base")}
    assert got["calls"] == {("auth.authenticate", "auth.validate"), ("auth.make_user", "models.User")}
    assert got["imports"] == {("auth", "models.User"), ("auth", "os")}
    assert got["references"] == {("auth", "models.User")}
    assert got["documents"] == {("README.md", "auth.validate"), ("README.md", "models")}
    assert {r.confidence for r in edges.collect()} == {"EXTRACTED"}
    assert {("x", "x.T"), ("x.T", "x.T.f")} <= got["defines"]
    assert [f.name for f in nodes.schema] == [f.name for f in NODES.fields] and [f.name for f in edges.schema] == [f.name for f in EDGES.fields]


def test_graph_of_the_sample_answers(sample, spark, rows):
    st = GraphStore(sample[0].withColumn("load_seq", F.lit(1).cast("bigint")), sample[1])
    callers = {(r.target, r.caller) for r in tools.dispatch(st, "find_references").collect()}
    assert ("sample_pkg.auth.validate", "sample_pkg.auth.authenticate") in callers
    root = st.nodes.filter("qualified_name = 'sample_pkg.auth.validate'").select("id")
    assert tools.dispatch(st, "blast_radius", roots=root, depth="2", types="calls,unknown").count() == 1
    assert tools.dispatch(st, "blast_radius", roots=root, types="unknown").count() == 0
    with pytest.raises(KeyError):
        tools.dispatch(st, "nothing")
    with pytest.raises(TypeError):
        tools.dispatch(st, "blast_radius", roots=root, dept=1)
    assert {t.name for t in tools.TOOLS.values()} >= {"read_symbol", "repo_map", "implementations"} and json.dumps([t.schema() for t in tools.TOOLS.values()])
    verdicts = gates.write_gate(st, spark.createDataFrame([("s", "new.py", "def validate(name, secret):\n    pass\n\ndef other(q):\n    pass\n"), ("t", "sample_pkg/auth.py", "def validate(name, secret): pass"), ("u", "b.py", "def (")], "key string, unit string, source_text string"))
    assert sorted((r.key.split("#")[0], r.kind) for r in verdicts.collect()) == [("s", "duplicate"), ("s", "ok"), ("t", "ok")]


def test_read_symbols(spark, rows):
    n = "struct<path string, start_line int, end_line int>".replace(" ", ":").replace(",:", ",")
    nodes = spark.createDataFrame([("a", "r", ("a.py", 2, 3)), ("b", "r", ("a.py", 1, 500)), ("c", "r", ("../x.py", 1, 1)), ("d", "r", ("no.py", 1, 1)), ("e", "r", ("/etc/x", 1, 1)), ("f", "r", ("b/../../c", 1, 1))], f"id string, repo_id string, location {n}")
    text = "\r\n".join(f"line {k}" for k in range(1, 200))
    got = {r.id: r for r in tools.read_symbols(nodes, spark.createDataFrame([("r", "a.py", text)], "repo_id string, unit string, source_text string")).collect()}
    assert got["a"].source == "line 2\nline 3" and not got["a"].truncated
    assert got["b"].truncated and got["b"].source.split("\n")[-1] == "line 120"
    assert [got[k].note for k in "cdef"] == ["outside the workspace: ../x.py", "no text of: no.py", "outside the workspace: /etc/x", "outside the workspace: b/../../c"]


def test_candidates_and_guards(spark, rows):
    nodes = spark.createDataFrame([(u,) for u in ("r/a/auth.py", "r/b/auth.py", "r/xauth.py", "r/c.py", "auth.py")], "unit string")
    asked = spark.createDataFrame([("q/auth.py",), ("r/c.py",), ("zz.go",)], "asked string")
    assert rows(tools.map_candidates(nodes, asked)) == [("q/auth.py", "auth.py,r/a/auth.py,r/b/auth.py,r/xauth.py"), ("zz.go", "")]
    shaped = spark.createDataFrame([(x,) for x in ("abc", "a.b_c", "ab", "a..b", "1abc", "a b", "naïve", "a.b.")], "p string").select("p", tools.is_symbol_shaped(F.col("p")).alias("s"))
    assert {r.p for r in shaped.collect() if r.s} == {"abc", "a.b_c"}
    assert [tools.is_loopback(u) for u in ("http://localhost:3/x", "http://127.8.9.1", "http://[::1]:8", "http://0.0.0.0", "http://127.0.0.1@evil.com", "http://[bad")] == [True, True, True, True, False, False]


def test_pieces(spark, rows):
    sy = spark.createDataFrame([("r", "java", "a.f", "int f(int a)", "u1", 3), ("r", "java", "a.f", "int f(String a)", "u1", 9), ("r", "java", "a.f", "long f(int b)", "u2", 1), ("r", "java", "a.g", "int g()", "u1", 20)], "repo_id string, language string, qualified_name string, signature string, unit string, start_line int")
    got = {(r.qualified_name, r.norm_signature): (r.unit, r.start_line, r.ordinal) for r in index.distinct_overloads(sy).collect()}
    assert got == {("a.f", "f(String)"): ("u1", 9, 0), ("a.f", "f(int)"): ("u1", 3, 1), ("a.g", "g()"): ("u1", 20, None)}
    spans = spark.createDataFrame([("r", "a.f", "1", 3, 8), ("r", "a.f", "2", 9, 12)], "repo_id string, qualified_name string, id string, start_line int, end_line int")
    sites = spark.createDataFrame([("r", "a.f", 10), ("r", "a.f", 3), ("r", "a.f", 99), ("r", "no", 1), ("r", "a.f", 10)], "repo_id string, qualified_name string, line int")
    assert rows(index.enclosing_overloads(sites, spans).select("line", "id")) == [(10, "2"), (10, "2"), (3, "1"), (99, "1")]
    conf = spark.createDataFrame([("r", "web/package.json", '{"dependencies": {"next": "1"}}'), ("r", "lib/package.json", '{"dependencies": {"react": "1"}}'), ("r", "c/package.json", "no json"), ("r", "next.config.mjs", "")], "repo_id string, unit string, source_text string")
    projects = index.next_projects(conf)
    assert rows(projects) == [("r", ""), ("r", "web")]
    files = spark.createDataFrame([("r", "web/src/app/items/[id]/page.tsx"), ("r", "lib/pages/x.tsx"), ("r", "pages/about.tsx")], "repo_id string, unit string")
    assert rows(index.page_routes(files, projects).select("unit", "pattern")) == [("pages/about.tsx", "/about"), ("web/src/app/items/[id]/page.tsx", "/items/:id")]
    at = index.definitions_at(spark.createDataFrame([("r", "./a.py", 3, "calls"), ("r", "a.py", 7, "imports"), ("r", "a.py", 7, "calls")], "repo_id string, path string, line int, relation string"), spark.createDataFrame([("r", "a.py", 3, "s")], "repo_id string, unit string, start_line int, id string"), spark.createDataFrame([("r", "a.py", "m")], "repo_id string, unit string, id string"))
    assert rows(at.select("line", "relation", "id")) == [(3, "calls", "s"), (7, "imports", "m")]


def test_commit_gate(sample, spark, rows):
    st = GraphStore(sample[0].withColumn("load_seq", F.lit(1).cast("bigint")), sample[1])
    s = "unit string, language string, qualified_name string, signature string"
    old = spark.createDataFrame([("sample_pkg/auth.py", "python", "validate", "def validate(name, secret):"), ("old.py", "python", "moved", "def moved(a):")], s)
    new = spark.createDataFrame([("sample_pkg/auth.py", "python", "validate", "def validate(name, secret, now):"), ("new.py", "python", "moved", "def moved(a):"), ("new.py", "python", "fresh", "def fresh():")], s)
    renames = spark.createDataFrame([("old.py", "new.py")], "old_unit string, unit string")
    assert {r.qualified_name for r in gates.staged_new_symbols(old, new, renames).collect()} == {"validate", "fresh"}
    assert {r.qualified_name for r in gates.staged_new_symbols(old, new).collect()} == {"validate", "moved", "fresh"}
    touched = spark.createDataFrame([("r", "new.py")], "repo_id string, unit string")
    assert gates.commit_gate(st, None, new, touched).filter("blocks").count() == 0
    assert {r.kind for r in gates.commit_gate(st, old, new, touched, renames).collect()} <= {"duplicate", "deleted", "follow_through"}


def test_new_cycles_of_any_length(spark, rows):
    e = lambda pairs: spark.createDataFrame(list(pairs), "src string, dst string")
    ring = [(f"n{k:02d}", f"n{(k + 1) % 30:02d}") for k in range(30)]
    assert rows(gates.new_cycles(e([("a", "b"), ("b", "a"), *ring[:-1]]), e([("a", "b"), ("b", "a"), *ring]))) == [(">".join(f"n{k:02d}" for k in range(30)),)]
    assert rows(gates.new_cycles(e([("a", "b"), ("b", "a")]), e([("a", "b"), ("b", "a"), ("b", "c"), ("c", "a")]))) == [("a>b>c",)]


def test_ledger_is_appended_with_its_chain(spark, tmp_path, rows):
    path = str(tmp_path / "ledger")
    check = {"type": "contract_pass", "evidence": {"checks": [{"run": "pytest  -x", "exit": 0}, {"run": "ruff", "exit": 1}]}}
    assert audit.append_ledger(spark, path, [{"type": "contract_declared", "evidence": {"contract": {"checks": [{"run": "a"}, {"run": "b"}], "attest": ["x"]}}}, check]) == 2
    assert audit.append_ledger(spark, path, [check] * 4) == 6 and audit.append_ledger(spark, path, []) == 6
    lines = audit.ledger_lines(spark, path)
    assert rows(audit.verify_ledger(lines)) == [(True, None, None)] and lines.count() == 6
    assert rows(audit.contract_evidence(lines)) == [(1, 2, 1, "pytest -x")]
    broken = lines.withColumn("line", F.when(F.col("pos") == 3, F.regexp_replace("line", "ruff", "tuff")).otherwise(F.col("line")))
    assert rows(audit.verify_ledger(broken)) == [(False, 3, "hash mismatch")]


def test_prime(spark, tmp_path, sample):
    path, key = str(tmp_path / "graph"), "repo_id string, unit string, content_hash string"
    nodes, edges = sample
    save_graph(nodes, edges, path)
    state = [(r.repo_id, r.unit, "h") for r in nodes.filter("kind = 'module'").collect()]
    stored = spark.createDataFrame(state, key)
    asked = []

    def again(wanted):
        asked.append(wanted.count())
        n = nodes.join(wanted.select("repo_id", "unit"), ["repo_id", "unit"], "left_semi")
        return n, edges.join(n.select(F.col("id").alias("src")), "src", "left_semi").select(*edges.columns)

    assert units.prime(spark, path, stored, again, stored)[2] == "snapshot" and not asked
    one = spark.createDataFrame([(r, u, "new" if u.endswith("auth.py") else h) for r, u, h in state], key)
    n, e, how = units.prime(spark, path, one, again, stored)
    assert how == "snapshot+delta" and asked == [1] and n.count() == nodes.count() and e.count() == edges.count()
    assert units.prime(spark, path, stored.limit(1), again, stored)[2] == "full" and units.prime(spark, str(tmp_path / "no"), stored, again, None)[2] == "full"
    served = units.Served((nodes, edges), clock=iter([0.0, 0.1, 1.0, 2.0, 3.0]).__next__)
    assert served.maybe_refresh("a", lambda: (nodes, edges)) and not served.maybe_refresh("b", lambda: 1 / 0)
    assert not served.maybe_refresh("b", lambda: 1 / 0) and served.errors == 1 and served.graph == (nodes, edges)
    assert load_graph(spark, str(tmp_path / "no")) is None


def test_resolution_context(spark, sample, rows):
    from graphloom.sources import extract

    changed = extract.python_facts(spark.createDataFrame([("r", "sample_pkg/auth.py", AUTH + "\n\ndef more():\n    return User('x')\n")], "repo_id string, unit string, source_text string"))
    found = index.resolution_context(changed, sample[0])
    assert ("sample_pkg.auth.more", "sample_pkg.models.User") in {(r.src, r.dst) for r in found.filter("type = 'calls'").collect()}


def test_views(spark, rows, sample):
    members = spark.createDataFrame([(1, "a/x.py"), (1, "a/y.py"), (1, "b/z.py"), (2, "a/q.py"), (3, "c/r.py"), (4, "a/s.py")], "community int, unit string")
    assert rows(views.dominant_subpackages(members)) == [(1, "a", 3), (2, "a", 1), (3, "c", 1), (4, "a", 1)]
    assert rows(views.community_labels(members)) == [(1, "a · 3 files"), (2, "a · 1 file (#1)"), (3, "c · 1 file"), (4, "a · 1 file (#2)")]
    st = GraphStore(sample[0].withColumn("load_seq", F.lit(1).cast("bigint")), sample[1])
    laid = views.compute_layout(st)
    per = {r.view: r.n for r in laid.groupBy("view").agg(F.count("*").alias("n")).collect()}
    assert set(per) == {"block", "layer", "orbit", "galaxy", "globe", "family", "ring"} and len(set(per.values())) == 1


def test_goto(spark, rows):
    t = spark.createDataFrame([("m", 1, "a", "b"), ("m", 2, "b", "c")], "map_id string, seq int, src string, dst string")
    s = spark.createDataFrame([("m", *x) for x in (("a", "/"), ("b", "/b"), ("c", "/c/:id"), ("d", "/d"), ("e", "/e/:x"))], "map_id string, id string, url string")
    asked = spark.createDataFrame([("m", *x) for x in (("a", "c"), ("a", "a"), ("a", "d"), ("a", "e"), (None, "b"))], "map_id string, start string, state string")
    got = {(r.start, r.state): r.how for r in navmap.goto_plans(asked, t, s).collect()}
    assert got == {("a", "c"): "path", ("a", "a"): "there", ("a", "d"): "direct", ("a", "e"): "unreachable", (None, "b"): "direct"}


def test_json_export(spark, tmp_path, sample, rows):
    from graphloom.operators.store import export_json, import_json

    path = str(tmp_path / "json")
    assert import_json(spark, path) is None
    export_json(*sample, path)
    nodes, edges = import_json(spark, path)
    assert rows(nodes.select("id", "qualified_name", "location.start_line")) == rows(sample[0].select("id", "qualified_name", "location.start_line")) and edges.count() == sample[1].count()


def test_maps_as_texts(spark, rows):
    from graphloom.functions.signatures import canonical_digest

    good = {"version": 1, "states": []}
    texts = [("a", json.dumps(good | {"hash": canonical_digest(good)})), ("b", json.dumps(good | {"hash": "x", "extra": 1})), ("c", "[1]"), ("d", json.dumps({"version": 2})), ("e", None)]
    assert rows(navmap.map_problems(spark.createDataFrame(texts, "map_id string, text string"))) == [("b", "hash"), ("b", "unknown key extra"), ("c", "no object"), ("d", "version"), ("e", "no object")]
    t = spark.createDataFrame([("m", 1, "a", "b"), ("m", 2, "a", "z")], "map_id string, seq int, src string, dst string")
    assert rows(navmap.known_transitions(t, spark.createDataFrame([("m", "a"), ("m", "b")], "map_id string, id string")).select("seq")) == [(1,)]


def test_impact_as_markdown(spark, sample):
    from graphloom.operators import queries as q

    st = GraphStore(sample[0].withColumn("load_seq", F.lit(1).cast("bigint")), sample[1])
    text = q.impact_markdown(st, st.nodes.filter("name = 'validate'"), most=1)
    assert "## Changed (1)" in text and "- `sample_pkg.auth.validate`" in text and "## Documents (1)" in text


def test_held_frames_are_given_up(spark):
    from graphloom.runtime import held

    kept = spark.range(5).persist()
    out = held(kept.filter("id > 1"), kept)
    assert out.count() == 3 and kept.is_cached
    del out
    import gc

    gc.collect()
    assert not kept.is_cached or not kept.storageLevel.useMemory
