import pytest
from pyspark.sql import functions as F

from graphloom.operators import queries as q
from graphloom.operators import store as s
from graphloom.operators import traverse as t
from graphloom.operators import views
from graphloom.schema import EDGES, NODES


def node(id, qname=None, seq=0, **kw):
    qname = qname or id
    unit = kw.pop("unit", "m.py")
    lines = kw.pop("lines", (1, 2))
    row = dict(
        load_seq=seq, id=id, repo_id="test", kind="symbol", name=qname.rsplit(".", 1)[-1], qualified_name=qname, language="python", unit=unit, signature=None, body_hash=None, module=None, layer=None,
        location={"path": kw.pop("path", unit), "start_line": lines[0], "end_line": lines[1]}, visibility="exported", provenance="tree-sitter", confidence="EXTRACTED", content_hash=None, is_top_level=True, is_type_decl=False, stmt_ordinal=None, loaded_at=None,
    )
    return row | kw


def edge(src, dst, type="calls", line=None, **kw):
    return dict(type=type, src=src, dst=dst, weight=1.0, provenance="tree-sitter", confidence="EXTRACTED", source_location=None if line is None else {"path": "m.py", "line": line}, unit="m.py", loaded_at=None) | kw


@pytest.fixture
def graph(spark):
    return lambda nodes, edges=(): s.GraphStore(spark.createDataFrame(list(nodes), NODES), spark.createDataFrame(list(edges), EDGES))


def ids(spark, *names):
    return spark.createDataFrame([(n,) for n in names], "id string")


def test_last_load_wins_and_dangling_edges_vanish(graph, rows):
    g = graph([node("a", seq=1, unit="old"), node("a", seq=2, unit="new"), node("b")], [edge("a", "b"), edge("a", "b"), edge("a", "b", line=3), edge("a", "gone")])
    assert rows(g.nodes.select("id", "unit")) == [("a", "new"), ("b", "m.py")]
    assert g.edges.count() == 2
    assert rows(s.hidden_loads(g.loads)) == [("a", 1)]


def test_neighbors_of_a_loop(graph, rows):
    g = graph([node("a")], [edge("a", "a")])
    assert rows(g.neighbors().select("node", "direction")) == [("a", "in"), ("a", "out")]
    assert g.neighbors(types=[]).count() == 0


def test_changed_set_slices(graph, rows, spark):
    g = graph([node("wide", lines=(1, 500)), node("low", lines=(60, 70)), node("far", lines=(900, 901)), node("open", lines=(64, None))])
    regions = spark.createDataFrame([("m.py", 63, 130), ("m.py", 63, 130), ("other", 1, 9), ("m.py", None, None)], "path string, start_line int, end_line int")
    assert rows(g.changed_set(regions)) == [("low",), ("open",), ("wide",)]
    assert s.overlapping(g.nodes, regions).count() == 3


def test_reach_is_level_by_level_with_cycles(graph, rows, spark):
    g = graph([node(x) for x in "abcd"], [edge("a", "b"), edge("b", "c"), edge("c", "a"), edge("c", "d"), edge("d", "d", confidence="INFERRED"), edge("a", "d", "documents")])
    assert rows(q.callees(g, ids(spark, "a"), 9)) == [("a", "b", 1), ("a", "c", 2), ("a", "d", 3)]
    assert rows(q.blast_radius(g, ids(spark, "d"), 1)) == [("d", "c", 1)]
    assert rows(q.blast_radius(g, ids(spark, "d"), 0)) == []
    assert rows(q.callees(g, ids(spark, "a"), 2, types=["no such type"])) == []


def test_components_cycles_layers(spark, rows):
    e = spark.createDataFrame([("a", "b"), ("b", "a"), ("b", "c"), ("c", "d"), ("d", "e"), ("e", "c"), ("d", "c"), ("e", "f"), ("x", "x")], "src string, dst string")
    assert rows(t.components(e)) == [("a", "a"), ("b", "a"), ("c", "c"), ("d", "c"), ("e", "c")]
    assert [r.cycle for r in t.simple_cycles(e).collect()] == [["a", "b"], ["c", "d"], ["c", "d", "e"]]
    assert [r.cycle for r in t.simple_cycles(e, max_length=2).collect()] == [["a", "b"], ["c", "d"]]
    n = spark.createDataFrame([(x,) for x in "abcdefx"], "id string")
    assert dict(rows(t.layers(e, n))) == {"a": 0, "b": 0, "c": 1, "d": 1, "e": 1, "f": 2, "x": 0}


def test_import_cycles(graph, rows, spark):
    g = graph([node(x, kind="module", qualified_name=x) for x in "abcd"], [edge("a", "b", "imports"), edge("b", "a", "imports"), edge("c", "d", "calls"), edge("d", "c", "calls"), edge("b", "c", "imports", confidence="INFERRED"), edge("c", "b", "imports")])
    assert rows(t.truncated_cycles(q.module_graph(g))) == [(["a", "b"], False)]
    e = spark.createDataFrame([("a", "b"), ("b", "a"), ("c", "d"), ("d", "c")], "src string, dst string")
    assert rows(t.truncated_cycles(e, limit=1)) == [(["a", "b"], True)]
    assert rows(t.truncated_cycles(e, limit=2)) == [(["a", "b"], False), (["c", "d"], False)]


def test_no_round_is_dropped(spark, rows):
    e = spark.createDataFrame([x for k in range(3) for x in ((f"{9 - k}a", f"{9 - k}b"), (f"{9 - k}b", f"{9 - k}a"), (f"{9 - k}a", f"{8 - k}a"))], "src string, dst string")
    assert rows(t.components(e).select("component").distinct()) == [("7a",), ("8a",), ("9a",)]
    with pytest.raises(RuntimeError):
        t.components(e, rounds=2)
    chain = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "d")], "src string, dst string")
    n = spark.createDataFrame([(x,) for x in "abcd"], "id string")
    assert dict(rows(t.layers(chain, n, rounds=3)))["d"] == 3
    with pytest.raises(RuntimeError):
        t.layers(chain, n, rounds=2)
    assert t.components.__defaults__ == t.layers.__defaults__ == (None,)


def test_empty_graph(graph, rows, spark):
    g = graph([])
    assert t.components(g.edges).count() == 0
    assert t.simple_cycles(g.edges).count() == 0
    assert q.find_references(g).count() == 0 and q.dead_code(g).count() == 0 and views.communities(g).count() == 0


DUP = [
    node("a", "p.auth.login", signature="def login(user)", unit="a.py"), node("t", "p.T", signature="class T(B)", is_type_decl=True, body_hash="h", unit="t.py"),
    node("m", "p.C.login", signature="def login(self, user)", is_top_level=False), node("i", "p.x", signature="def other(z)", confidence="INFERRED"),
]


def test_duplicate_gate(graph, rows, spark):
    g = graph(DUP)
    asked = [
        ("annotated", "def login(user: str) -> bool:", None, None, None), ("same unit", "def login(user)", "a.py", None, None), ("arity", "def login(user, x)", None, None, None), ("inferred", "def other(z)", None, None, None),
        ("type", "class T(B)", None, "h", True), ("type other body", "class T(B)", None, "x", True), ("type unknown", "class T(B)", None, None, None), ("callable vs type", "def T(B)", None, "h", False),
    ]
    p = spark.createDataFrame([(k, sig, "python", u, b, ty) for k, sig, u, b, ty in asked], "key string, signature string, language string, exclude_unit string, body_hash string, is_type_decl boolean")
    got = {k: (b, kind) for k, b, kind, *_ in rows(q.check_duplicates(g, p))}
    assert got == {"annotated": (True, "duplicate"), "same unit": (False, "ok"), "arity": (False, "ok"), "inferred": (False, "ok"), "type": (True, "duplicate"), "type other body": (False, "near"), "type unknown": (False, "near"), "callable vs type": (False, "ok")}


def test_contracts(graph, spark, rows):
    g = graph([node("a", "p.f", signature="def f(x)", visibility="public"), node("b", "p.g")])
    c = spark.createDataFrame([("add", "test", "p.f", "def f(x, y)", None), ("note", "test", "p.f", "def f(x: int) -> int", "public"), ("narrow", "test", "p.f", None, "internal"), ("new", "test", "p.h", "def h()", None), ("nosig", "test", "p.g", "def g(z)", "public")], "key string, repo_id string, qualified_name string, new_signature string, new_visibility string")
    assert {k: (b, r) for k, b, r, _ in rows(q.check_contracts(g, c))} == {"add": (True, "signature"), "note": (False, None), "narrow": (True, "visibility"), "new": (False, None), "nosig": (False, None)}


def test_verdict_text(spark):
    d = spark.createDataFrame([("duplicate", "p.f", "a.py:1", "def `f`\n (x)", None)], "k string, n string, l string, s string, r string")
    text = d.select(q.verdict_text(F.col("k"), F.col("n"), F.col("l"), F.col("s"), F.col("r"))).first()[0]
    assert text.startswith("BLOCKED: creating") and "defined as `def 'f' (x)`" in text and "ACTION: reuse p.f" in text


def test_names(graph, rows, spark):
    g = graph([node("1", "p.auth.login"), node("2", "p.web.login"), node("3", "p.kb.ask"), node("4", "p.kb.tell")])
    asked = spark.createDataFrame([(n, "test") for n in ("p.auth.login", "auth.login", "login", "kb", "zz.ask", "nothing", "x" * 600)], "name string, repo_id string")
    got = {a: (i, c) for _, a, i, c in rows(q.resolve_names(g.nodes, asked))}
    assert got == {"p.auth.login": ("1", None), "auth.login": ("1", None), "login": (None, "p.auth.login,p.web.login"), "kb": (None, "p.kb.ask,p.kb.tell"), "zz.ask": (None, "p.kb.ask"), "nothing": (None, None)}


def test_references_tests_docs_and_impact(graph, rows, spark):
    n = [node("f", "p.f", unit="p/f.py", lines=(5, 9)), node("g", "p.g", unit="p/g.py"), node("t", "tests.t", unit="tests/test_f.py"), node("d", "README", kind="doc_section", unit="README.md")]
    e = [edge("g", "f", line=7), edge("g", "f", line=3), edge("t", "f", "references"), edge("d", "f", "documents"), edge("t", "g", "imports")]
    g = graph(n, e)
    assert [(x.caller, x.sites) for x in q.find_references(g).filter("dst = 'f'").orderBy("caller").collect()] == [("p.g", "m.py:3,m.py:7"), ("tests.t", "")]
    ch = q.changed_symbols(g, spark.createDataFrame([("p/f.py", 9, 20)], "path string, start_line int, end_line int"))
    assert rows(ch.select("id")) == [("f",)]
    assert rows(q.suggest_tests(g, ch)) == [("tests.t", "tests/test_f.py", "p.f")]
    assert rows(q.doc_drift(g, ch)) == [("README", "README.md", "p.f")]
    assert rows(q.impact_summary(g, ch)) == [(1, 2, 1, 1)]
    assert rows(q.localize(g, ids(spark, "t"), ch)) == [("t", "p.f", 1)]


def test_duplicates_of_bodies_and_signatures(graph, rows):
    n = [node("1", "p.a", body_hash="h", lines=(1, 3)), node("2", "p.b", body_hash="h", lines=(1, 3)), node("3", "p.c", body_hash="h", lines=(1, 2)), node("4", "p.main", signature="def main()", unit="x"), node("5", "q.main", signature="def main()", unit="y"), node("6", "p.P", signature="class P", is_type_decl=True), node("7", "q.P", signature="class P", is_type_decl=True), node("8", "p.z", signature="def z(a)"), node("9", "q.z", signature="def z(a: int)")]
    g = graph(n)
    assert rows(q.duplicate_bodies(g.nodes)) == [("test", "h", "p.a,p.b", 2)]
    assert rows(q.duplicate_signatures(g.nodes)) == [("test", "python", "z(a)", 2)]


def test_dead_code(graph, rows):
    n = [node("m", "p", kind="module"), *[node(x, f"p.{x}", visibility="internal") for x in ("dead", "used", "main", "__x__", "method")], node("out", "p.out")]
    e = [*[edge("m", x, "defines") for x in ("dead", "used", "main", "__x__", "out")], edge("out", "used", confidence="AMBIGUOUS")]
    assert rows(q.dead_code(graph(n, e)).select("id")) == [("dead",)]


def test_stacked_units(spark, rows):
    f = lambda *x: spark.createDataFrame(list(x), "unit string, fact string")
    v1 = s.publish(f(("a", "1"), ("b", "1")), None, 1)
    v2 = s.publish(f(("a", "2"), ("a", "3")), v1, 2, units=f(("a", ""), ("b", "")))
    assert rows(s.current_facts(v2).select("unit", "fact")) == [("a", "2"), ("a", "3")]


def test_save_and_load(graph, spark, tmp_path):
    g = graph([node("a")], [])
    s.save_graph(g.nodes, g.edges, str(tmp_path / "g"))
    nodes, _ = s.load_graph(spark, str(tmp_path / "g"))
    assert nodes.count() == 1 and s.load_graph(spark, str(tmp_path / "none")) is None
    with pytest.raises(ValueError):
        s.save_graph(g.nodes.unionByName(g.nodes.withColumn("unit", F.lit("other"))), g.edges, str(tmp_path / "h"))


def test_overloads_and_repeated_ids(graph, rows):
    g = graph([node("1", "p.f", signature="f(a)"), node("2", "p.f", signature="f(b, c)"), node("3", "p.g", signature="g(x)"), node("4", "p.f", signature="f(a: int)")])
    assert rows(s.overload_ordinals(g.nodes)) == [("1", 0), ("2", 1), ("3", None), ("4", 0)]
