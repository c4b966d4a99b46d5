import ast
import random

import pytest

from graphloom.analysis import flow as fl
from graphloom.analysis import operators as an


def flow(text):
    return fl.build(fl.functions(text)[0][1])


def test_control_flow():
    g = flow("def f(a):\n    if a:\n        return 1\n    for x in a:\n        if x:\n            break\n        continue\n    raise E\n")
    assert (1, 2, "true") in g.edges and (2, -1, "return") in g.edges and (4, 5, "true") in g.edges and (5, 7, "break") in g.edges and (6, 3, "continue") in g.edges and (3, 7, "false") in g.edges


def test_unreachable_outermost():
    assert fl.unreachable(flow("def f():\n    return 1\n    if a:\n        b = 1\n    c = 2\n")) == [(3, 4), (5, 5)]


def test_post_dominators():
    g = flow("def f(a):\n    if a:\n        x = 1\n    else:\n        x = 2\n    return x\n")
    assert fl.immediate_post_dominators(fl.post_dominators(g))[1] == 4
    assert {(1, 2, "true"), (1, 3, "false")} == fl.control_dependences(g)


def test_slices():
    text = "def f(a, b):\n    x = a\n    y = b\n    x += 1\n    o.append(y)\n    return x\n"
    g = flow(text)
    assert fl.slice_lines(g, 6) == [2, 4, 6]
    assert fl.slice_lines(g, 3, backward=False) == [3, 5]
    assert 4 in fl.output_nodes(g, fl.functions(text)[0][1])


def test_weak_definitions_do_not_kill():
    g = flow("def f():\n    d = {}\n    d['a'] = 1\n    return d\n")
    assert {(1, 3, "d"), (2, 3, "d")} <= fl.data_dependences(g)


def test_a_slice_is_enough_to_compute_its_line():
    """Random straight and branching code: running only the slice gives the returned value again."""
    r = random.Random(4)
    for _ in range(60):
        body, names = [], ["a", "b"]
        for k in range(r.randint(2, 8)):
            e = f"{r.choice(names)} {r.choice('+-*')} {r.choice([*names, '2'])}"
            n = r.choice(["a", "b", f"v{k}"])
            if r.random() < 0.3:
                body += [f"    if {r.choice(names)} > 1:", f"        {r.choice(names)} = {e}"]
            else:
                body.append(f"    {n} = {e}")
                names.append(n)
        body.append(f"    return {r.choice(names)}")
        text = "def f(a, b):\n" + "\n".join(body) + "\n"
        kept = set(fl.slice_lines(flow(text), len(body) + 1))
        lines = [x if k in kept or k == 1 else (x[: len(x) - len(x.lstrip())] + "pass") for k, x in enumerate(text.rstrip("\n").split("\n"), 1)]
        lines = [x if not (x.strip() == "pass" and k < len(lines) and lines[k].startswith("        ")) else "    if True:" for k, x in enumerate(lines, 1)]
        one, two = {}, {}
        exec(text, one)
        exec("\n".join(lines), two)
        for args in ((0, 1), (3, 2), (-1, 5)):
            assert one["f"](*args) == two["f"](*args), (text, lines)


def test_interprocedural():
    text = "def g(x):\n    y = x\n    z = 3\n    return y\n\ndef f(a):\n    b = g(a)\n    c = 1\n    return b\n"
    assert fl.interprocedural_slice(text, 9) == {"f": [7, 9], "g": [2, 4]}


@pytest.mark.parametrize("text", [None, "", "def f(:", "x = 1"])
def test_nothing_to_analyse(text):
    assert fl.functions(text) == []


def test_operators(spark, rows):
    f = spark.createDataFrame([(1, "a.py", "def f(a):\n    return a\n    x = 1\n"), (1, "a.py", "def f(a):\n    return a\n    x = 1\n"), (2, "b.py", "def ("), (3, "c.go", "func f() {}"), (4, "d.py", None)], "file_id bigint, rel_path string, source_text string")
    assert rows(an.unreachable_code(f)) == [(1, "f", 1, 3, 3)]
    assert rows(an.dependence_edges(f).select("src", "dst", "dep", "what")) == [(0, 1, "data", "a")]
    assert an.control_flow(f.limit(0)).count() == 0
    s = spark.createDataFrame([(1, "f", 3), (1, "g", 2)], "file_id bigint, suspect string, changed_line int")
    assert rows(an.refine_suspects(s, f).select("suspect", "shows")) == [("g", True)]


def test_nested_functions_are_named():
    assert [n for n, _ in fl.functions("class A:\n    def f(self):\n        def g(): pass\n")] == ["A.f", "A.f.g"]
    assert isinstance(fl.function_at("def f():\n    x = 1\n", 2)[1], ast.FunctionDef)
