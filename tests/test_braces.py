import pytest

from graphloom.analysis import braces
from graphloom.analysis import flow as fl

JAVA = "class A {\n    int f(int a, int b) {\n        int c = a + 1;\n        if (c > b) {\n            c = b;\n        } else {\n            log(c);\n        }\n        while (c < 9) {\n            c++;\n            if (c == 7) break;\n        }\n        return c;\n    }\n}\n"


def one(text, language):
    found = braces.flows(text, language)
    assert len(found) == 1
    return found[0]


def test_flow_of_java():
    name, function, flow = one(JAVA, "java")
    assert (name, function.lineno, function.parameters) == ("A.f", 2, ["a", "b"])
    assert [(a, b) for a, b, _ in flow.statements.values()] == [(3, 3), (4, 8), (5, 5), (7, 7), (9, 12), (10, 10), (11, 11), (11, 11), (13, 13)]
    assert flow.edges == {(0, 1, "seq"), (1, 2, "seq"), (2, 3, "true"), (2, 4, "false"), (3, 5, "seq"), (4, 5, "seq"), (5, 6, "true"), (6, 7, "seq"), (7, 8, "true"), (7, 5, "false"), (8, 9, "break"), (5, 9, "false"), (9, -1, "return")}
    names = {k: (sorted(s.strong), sorted(s.uses)) for k, (_, _, s) in flow.statements.items()}
    assert names[1] == (["c"], ["a"]) and names[2] == ([], ["b", "c"]) and names[3] == (["c"], ["b"]) and names[6] == (["c"], ["c"]) and names[9] == ([], ["c"])
    assert fl.slice_lines(flow, 13) == [3, 4, 5, 7, 9, 10, 11, 13] and fl.unreachable(flow) == []


@pytest.mark.parametrize(
    "language,text",
    [
        ("go", "package p\n\nfunc F(xs []int, lim int) (int, error) {\n\ttotal := 0\n\tfor i, x := range xs {\n\t\tif x > lim {\n\t\t\tcontinue\n\t\t}\n\t\ttotal += x * i\n\t}\n\treturn total, nil\n}\n"),
        ("javascript", "function F(xs, lim) {\n  let total = 0\n  for (const x of xs) {\n    if (x > lim) {\n      continue\n    }\n    total += x\n  }\n  return total\n}\n"),
        ("typescript", "function F(xs: number[], lim: number): number {\n  let total: number = 0;\n  for (const x of xs) {\n    if (x > lim) {\n      continue;\n    }\n    total += x;\n  }\n  return total;\n}\n"),
        ("c", "int F(int *xs, int lim) {\n    int total = 0;\n    for (int x = 0; x < lim; x++) {\n        if (xs[x] > lim) {\n            continue;\n        }\n        total += x;\n    }\n    return total;\n}\n"),
        ("cpp", "int F(const std::vector<int> &xs, int lim) {\n    int total = 0;\n    for (auto x : xs) {\n        if (x > lim) {\n            continue;\n        }\n        total += x;\n    }\n    return total;\n}\n"),
        ("csharp", "class A {\n    int F(int[] xs, int lim) {\n        int total = 0;\n        foreach (var x in xs) {\n            if (x > lim) { continue; }\n            total += x;\n        }\n        return total;\n    }\n}\n"),
    ],
)
def test_loops_and_sums_of_each_language(language, text):
    _, function, flow = one(text, language)
    assert function.parameters == ["xs", "lim"]
    assert flow.edges == {(0, 1, "seq"), (1, 2, "seq"), (2, 3, "true"), (3, 4, "true"), (4, 2, "continue"), (3, 5, "false"), (5, 2, "seq"), (2, 6, "false"), (6, -1, "return")}
    what = {k: s for k, (_, _, s) in flow.statements.items()}
    assert what[1].strong == {"total"} and "total" in what[5].strong & what[5].uses and "total" in what[6].uses and what[6].shows
    assert {"x", "xs"} & what[2].uses and "x" in what[2].strong
    deps = fl.data_dependences(flow)
    assert {(1, 6, "total"), (5, 6, "total"), (1, 5, "total"), (5, 5, "total")} <= deps
    assert (3, 5, "false") in fl.control_dependences(flow)


def test_switch_do_and_opaque():
    text = "int f(int a) {\n    int r;\n    switch (a) {\n    case 1:\n        r = 1;\n        break;\n    case 2:\n        r = 2;\n    default:\n        r = 3;\n    }\n    do {\n        r--;\n    } while (r > 0);\n    p->q = r;\n    g(&a, r);\n    return r;\n}\n"
    _, _, flow = one(text, "c")
    lines = {k: (a, b) for k, (a, b, _) in flow.statements.items()}
    assert lines == {1: (2, 2), 2: (3, 11), 3: (5, 5), 4: (6, 6), 5: (8, 8), 6: (10, 10), 7: (13, 13), 8: (14, 14), 9: (15, 15), 10: (16, 16), 11: (17, 17)}
    assert {(2, 3, "case"), (2, 5, "case"), (5, 6, "seq"), (2, 6, "case"), (4, 7, "break"), (6, 7, "seq"), (7, 8, "seq"), (8, 7, "true"), (8, 9, "false")} <= flow.edges
    assert (2, 7, "false") not in flow.edges and flow.statements[9][2].weak == {"p"} and "r" in flow.statements[10][2].weak
    _, _, flow = one("class A { void f() {\n  try {\n    g();\n  } catch (E e) {\n    h();\n  } finally { }\n  return;\n  k();\n} }", "java")
    assert [(a, b) for a, b, _ in flow.statements.values()] == [(2, 6), (7, 7), (8, 8)] and fl.unreachable(flow) == [(8, 8)]
    assert braces.flows("class {", "java") == [] and braces.flows(None, "c") == []
