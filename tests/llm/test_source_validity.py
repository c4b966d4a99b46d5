import datetime as dt

import pytest

from graphloom.llm import source_validity as sv
from graphloom.llm.grammars import LANGUAGES, language_of, parses

VALID = {
    "python": ["def f(a: int = 1, *, b) -> str:\n    return f'{a}}}'\n", "﻿import os\r\nx = 1\r\n", "x = '''\n<<<<<<< a\n=======\n'''\n"],
    "java": [
        'package a.b;\nimport java.util.*;\nimport static a.B.c;\n@Deprecated\npublic final class A<T extends B<T>> extends C implements D, E {\n    private static final int[] X = {1, 2};\n    A() { super(); }\n    @Override\n    public <K> Map<String, List<K>> f(final List<? extends K> x, int... ys) throws IOException {\n        for (String s : xs) { if (s == null) continue; else break; }\n        try (var r = open()) { g(); } catch (A | B e) { throw new X("}"); } finally { }\n'
        "        switch (x) { case 1: return 2; default: y++; }\n        Runnable r = () -> { go(); };\n        int z = a < b ? c : d;\n        do { z--; } while (z > 0);\n        char c = '\"';\n        return xs.stream().map(q -> q.length()).collect(Collectors.toList());\n    }\n    enum E2 { P, Q(1) { int v() { return 1; } }; int v() { return 0; } }\n    interface I { int q(); default void w() {} }\n    record R(int a, String b) {}\n}\n",
    ],
    "csharp": ["using System;\nnamespace A.B {\n  [Obsolete(\"x\")]\n  public class C<T> : D, IE where T : class {\n    public int P { get; set; } = 3;\n    public string Q => \"x\";\n    private readonly List<int> xs = new List<int>();\n    public async Task<int> F(ref int a, string b = null) {\n      foreach (var x in xs) { await G(x); }\n      using (var y = Z()) { }\n      var s = $\"{a}\" + @\"c:\\\";\n      return a ?? 0;\n    }\n  }\n}\n", "namespace X;\n\npublic struct S { }\n#region r\npublic enum E { A, B = 2 }\n#endregion\n"],
    "go": ["package main\n\nimport (\n\t\"fmt\"\n\tx \"os\"\n)\n\ntype T struct {\n\ta, b int `json:\"a\"`\n\t*x.Y\n}\n\ntype I interface {\n\tF(a int) (int, error)\n}\n\nvar m = map[string][]int{\"a\": {1, 2}}\n\nfunc (t *T) F(a, b int, cs ...string) (r int, err error) {\n\tif v, ok := m[\"a\"]; ok && v != nil {\n\t\treturn 1, nil\n\t} else if a > 2 {\n\t\tgo f()\n\t}\n\tfor i, x := range cs {\n\t\tfmt.Println(i, x)\n\t}\n\tswitch a {\n\tcase 1, 2:\n\t\tb++\n\tdefault:\n\t\tdefer g(func() { h() })\n\t}\n\tfor {\n\t\tbreak\n\t}\n\ts := []int{\n\t\t1,\n\t}\n\treturn len(s), err\n}\n"],
    "rust": ["use std::{fmt, io::Result};\n#[derive(Debug)]\npub struct P<'a, T: Clone> { pub x: &'a str, y: Vec<T> }\nenum E { A, B(i32), C { x: u8 } }\nimpl<'a, T> fmt::Display for P<'a, T> {\n    fn fmt(&self, f: &mut fmt::Formatter<'_>) -> fmt::Result { write!(f, \"{}\", self.x) }\n}\nfn g(a: &[i32], mut b: u8) -> Option<i32> {\n    let r = r#\"a \" b\"#;\n    let c = '\"';\n    let v = if b > 1 { 2 } else { 3 };\n    match v { 1 | 2 => println!(\"x\"), _ => {} }\n    for i in 0..v { continue; }\n    while let Some(x) = it.next() { y += x?; }\n    let f = |x: i32| x + 1;\n    Some(a.iter().map(|q| q * 2).sum())\n}\n"],
    "kotlin": ["package a.internal.b\n\nimport c.d.*\n\n@Suppress(\"x\")\ndata class P(val a: Int, private var b: String? = null) : Q(a), R {\n    val c: Int\n        get() = a + 1\n    companion object {\n        const val X = 1\n    }\n    override fun f(x: List<Int>): Int = x.map { it + 1 }.sum()\n    fun g(open: Int) {\n        val y = when (open) {\n            1, 2 -> \"a\"\n            in 3..4 -> \"b\"\n            else -> throw E()\n        }\n        for (i in 0 until 5 step 2) println(i)\n        if (open > 1) {\n            return\n        } else {\n            y?.let { z -> h(z!!) }\n        }\n    }\n}\nenum class E { A, B }\n"],
    "swift": ["import Foundation\n\n@objc public final class A: B, C {\n    private(set) var x: [String: Int] = [:]\n    let open = \"{\"\n    init(a: Int) { self.a = a }\n    func f(_ a: Int, with b: String? = nil) throws -> [Int] {\n        guard let c = b, a > 1 else { return [] }\n        for i in 0..<a where i > 2 { print(i) }\n        switch a {\n        case 1, 2: return [1]\n        default: break\n        }\n        if let d = e { return d.map { $0 + 1 } } else { }\n        do { try g() } catch { h() }\n        return x.values.sorted()\n    }\n}\nenum E { case a, b(Int) }\nextension A { var y: Int { return 1 } }\n"],
    "javascript": ["import a, { b as c } from './d';\nexport default class X extends Y {\n  static z = 1;\n  constructor(q = {}) { super(); this.q = q; }\n  async *g() { yield 1; }\n  get v() { return `a${1 + {}.x}b`; }\n}\nexport const f = async ({ a, ...r }, [x]) => { await a; };\nfor (const k of xs) if (k) continue;\nlet re = /[/\"]+/g, o = { a, 'b': 1, [c]: 2, d() {}, ...e };\n!function(a){return a?1:void 0}(2)\nvar t = a ? b : c ? d : e\nswitch (x) { case 1: break; default: y() }\ntry { f() } catch { g() }\nexport { t, re as q };\nconst el = <div a=\"b\" {...p}>{x < 3 ? <br/> : null} text</div>;\n"],
    "typescript": ["import type { A } from 'a';\nexport interface I<T> extends J { a?: string; f(x: T): void; [k: string]: unknown }\ntype U = 'a' | { b: number } & C<D>;\nenum E { A = 1, B }\nabstract class K<T> extends L<T> implements I<T> {\n  private readonly a: Map<string, number[]> = new Map<string, number[]>();\n  constructor(public b: string, c?: number) { super(); }\n  protected static f<Q>(x: Q, ...ys: number[]): Promise<Q | undefined> { return x as any; }\n}\ndeclare module Z;\nexport function g(a: (x: number) => void, b = 1): a is string { return b! > 1; }\n".replace("declare module Z;\n", "")],
    "c": ["#include <stdio.h>\n#define X(a) \\\n  ((a) + 1)\ntypedef struct s { int a[3]; char *b; } s_t;\nenum e { A, B = 2 };\nstatic const char *const names[] = {\"a\", \"b\"};\nint f(const char **a, unsigned b);\nstatic inline int g(int (*h)(int), ...) {\n    s_t *p = (s_t *) malloc(sizeof(s_t));\n    for (int i = 0, j = 1; i < 3; i++, j--) { p->a[i] = j & 1 ? 2 : *names[0]; }\n    switch (b) { case A: case 'x': goto end; default: break; }\n    do { b >>= 1; } while (b);\n#if 0\n    if (broken) {\n#endif\nend:\n    return !h(1);\n}\n".replace("goto end", "break")],
    "cpp": ["#include <vector>\nnamespace a::b {\ntemplate <typename T, int N = 3>\nclass X final : public Y<T>, private Z {\npublic:\n    explicit X(int a) : a_(a), b_{1} {}\n    ~X() override = default;\n    virtual const std::string &f(const std::vector<std::vector<int>> &v) const noexcept;\n    bool operator==(const X &o) const { return a_ == o.a_; }\nprivate:\n    int a_ = 0;\n};\n}\nusing namespace std;\nstd::string a::b::g(int x) {\n    auto l = [&](int y) { return y + x; };\n    for (const auto &i : xs) { std::cout << i << R\"(a\")\" << std::endl; }\n    try { throw std::runtime_error(\"x\"); } catch (const std::exception &e) { }\n    return x ? \"a\" : \"b\";\n}\n"],
}


@pytest.mark.parametrize("language", LANGUAGES)
def test_valid(language):
    for text in [*VALID[language], "", " \n"]:
        assert parses(text, language), text


@pytest.mark.parametrize("language", LANGUAGES)
def test_damage(language):
    for text in VALID[language]:
        lines = text.rstrip("\n").split("\n")
        body = next((k for k in range(len(lines) // 2, len(lines)) if not lines[k].strip().startswith(("#", "'''", "=====", "<<<"))), 1)
        for marks in (["<<<<<<< HEAD"], ["======="], [">>>>>>> main"]):
            if "'''" not in text:
                assert not parses("\n".join(lines[:body] + marks + lines[body:]) + "\n", language), marks
        if language != "python":
            assert not parses(text + "}", language) and not parses(text + '"', language)
            assert not parses(text[: text.rindex("}")] if language not in ("javascript", "typescript", "csharp", "swift", "kotlin") else text.rstrip()[:-1] + " {", language)


@pytest.mark.parametrize("language", LANGUAGES)
def test_other_texts(language):
    for text in ("This file used to hold the walker.\nIt was moved (sorry).\n", "<!DOCTYPE html>\n<p>It isn't here.</p>\n", "#!/bin/sh\nset -e\nif [ -f \"$1\" ]; then\n  x --y \"$1\"\nfi\n", "CREATE TABLE a (id BIGINT, t TEXT);\nINSERT INTO a SELECT id, t FROM b WHERE id > 3;\n", "a:\n  steps:\n    - run: index b\n  on: [push]\n", "id,unit name,owner\n0,a b,the c team\n", "--- a/x\n+++ b/x\n@@ -1 +1 @@\n-a b\n+c d\n"):
        assert not parses(text, language), text


def test_foreign_code_is_recognised():
    for language in LANGUAGES:
        for text in VALID[language]:
            others = [x for x in LANGUAGES if x != language and parses(text, x)]
            assert set(others) <= {"javascript": {"typescript"}, "c": {"cpp"}, "python": {"swift"}}.get(language, set()), (language, others)


def test_verdicts():
    assert sv.verdict("a.java", VALID["go"][0]) == ("java", "wrong_extension", "go")
    assert sv.verdict("a.java", "this is { nothing") == ("java", "corrupt", None)
    assert sv.verdict("a\\B.JAVA", VALID["java"][0]) == ("java", "valid", "java")
    assert sv.verdict("a.txt", VALID["rust"][0]) == (None, "unknown", "rust")
    assert sv.verdict("a.py", None) == ("python", "absent", None) and sv.verdict(None, "")[1] == "unknown"
    assert language_of("x/.bashrc") is None and language_of("a.b/c") is None


def test_long_texts_take_linear_time():
    import time

    began = time.time()
    assert parses("const A = [" + "1, " * 100_000 + "];\n", "typescript")
    assert parses("int a[] = {" + "0x5a, " * 100_000 + "};\n", "c")
    assert not parses("class A {" * 3000, "java")
    assert parses("function f() {\n" + "  x = x + 1;\n" * 20_000 + "}\n", "javascript")
    assert not parses("(" * 50_000, "go")
    assert time.time() - began < 20


def test_operator(spark, rows):
    t = [dt.datetime(2031, 1, k) for k in (1, 2)]
    data = [(1, "r", "a.py", "x = 1", t[0]), (2, "r", "b.py", "def (", t[0]), (3, "r", "c.go", VALID["rust"][0], t[0]), (4, "r", "d.go", None, t[0]), (5, None, "e.java", "", t[0]), (6, "r", "f.py", "x =", t[0]), (6, "r", "f.py", "x = 1", t[1]), (7, "r", "g.py", "y =", None), (7, "r", "g.py", "y =", None), (None, "r", "h.py", "z =", t[0]), (8, "r", None, "a b", t[0])]
    f = spark.createDataFrame([(*x, "clash") for x in data], "file_id bigint, repo_id string, rel_path string, source_text string, loaded_at timestamp, verdict string")
    assert rows(sv.invalid_files(f)) == [(2,), (3,), (7,)]
    assert rows(sv.invalid_rates(f)) == sorted([("r", "python", 4, 2, 0, 0.5), ("r", "go", 1, 1, 1, 1.0), (None, "java", 1, 0, 0, 0.0)], key=repr)
    assert sv.parse_files(f.limit(0)).count() == 0


def test_nodes_tell_the_language_where_the_path_does_not(spark, rows):
    t = dt.datetime(2031, 1, 1)
    cpp, go = VALID["cpp"][0], VALID["go"][0]
    f = spark.createDataFrame([(1, "r", "./a\\b.h", cpp, t), (2, "r", "c.h", cpp, t), (3, None, "d.txt", go, t), (4, "r", "e.java", go, t), (5, "s", "a/b.h", cpp, t)], "file_id bigint, repo_id string, rel_path string, source_text string, loaded_at timestamp")
    n = spark.createDataFrame([("r", "a/b.h", "cpp"), ("r", "a/b.h", "cpp"), (None, "d.txt", "go"), ("r", "e.java", "go"), ("r", "c.h", None)], "repo_id string, unit string, language string")
    assert rows(sv.invalid_files(f, n)) == [(2,), (4,), (5,)]
    assert rows(sv.invalid_files(f)) == [(1,), (2,), (4,), (5,)]
    found = {r.file_id: r for r in sv.parse_files(f, n).collect()}
    assert found[3].language == "go" and found[3].verdict == "valid" and found[4].parses_in == ["go"] and found[4].parses_as == "go"
    assert rows(sv.invalid_files(f.limit(0), n)) == [] and len(rows(sv.invalid_files(f, n.limit(0)))) == 4


@pytest.mark.parametrize("language", LANGUAGES)
def test_the_opening_of_a_foreign_text_tells_nothing_else(language):
    from tests.llm.test_grammars import BROKEN, GOOD

    texts = [frame[x].format(p) for x in GOOD for cases in (GOOD, BROKEN) for frame, pieces in cases[x] for p in pieces]
    for text in texts + [v for vs in VALID.values() for v in vs]:
        assert parses(text, language, True) == parses(text, language), text
