import datetime as dt

import pytest

from graphloom.llm import documented_functions as df
from graphloom.llm import unwritten_files as uf

HAND = "# Copyright 2027 the x team.\n# Licensed under the terms in the file NOTICE.\n\nimport os\n\nCACHE = [8, 36, 56, 9083, 2, 67]\n\ndef f(a):\n    # do not edit without asking the owners\n    s = 'Code generated by x. DO NOT EDIT.'\n    if a > 3:\n        return 0\n    return a\n"
MIN = "!function(a,b){var d=87;for(var i=0;i<a;i++){d+=b*i}return d}(9,9);" * 12
NUMBERS = "X = [\n" + "    0x5a, 0xdb, 0x0f, 17, 2.5,\n" * 20 + "]\n"
ENCODED = 'const X = "' + "aB3+/xYz9QwErTy7" * 40 + '";\n'


@pytest.mark.parametrize(
    "path,text,want",
    [
        ("a/b.py", HAND, None), ("a/vendors/b.py", HAND, None), ("a/generators/b.py", HAND, None), ("generated_ids_x.py", HAND, None), ("a/minify_x.js", "// " + "word " * 200 + "\nfunction f() {}\n", None), ("a.py", None, None), ("a.py", "", None),
        ("a.min.js", "x", "minified"), ("a/b.js", MIN, "minified"), ("static\\js\\a.bundle.0bf3.js", "x", "minified"), ("a.py", NUMBERS, "blob"), ("a.ts", ENCODED, "blob"), ("a.js", "const A = [" + "1, " * 30 + "];\n" + "function f(a) {\n    return a + left + right;\n}\n" * 20, None),
        ("vendor/x/a.py", HAND, "vendored"), ("a\\node_modules\\x\\a.js", "x", "vendored"), ("lib/foo-1.2.3/a.go", "package a\n", "vendored"), ("a.py", "# Vendored from x 1.2.3\n" + HAND, "vendored"), ("a.go", "// foo v1.2.3 | (c) The foo Authors | https://foo.invalid\npackage a\n", "vendored"),
        ("a_pb2.py", HAND, "generated"), ("gen/a.py", HAND, "generated"), ("a.py", "# Code generated by x-gen v1. DO NOT EDIT.\n" + HAND, "generated"), ("a.ts", "let a = 1;\n\n// schema-checksum: 0123abcd\n", "generated"), ("a.cs", "// <auto-generated>\nclass A { }\n", "generated"),
        ("a.go", "package a\n\n" + "".join(f"func GetField{k}() int {{\n\treturn {k}\n}}\n\n" for k in range(9)), "generated"), ("a.ts", "/** Auto-generated method stub. */\nfunction f() {}\n", None), ("zz_generated_x.c", "SELECT", "generated"),
    ],
)
def test_reason(spark, path, text, want):
    f = spark.createDataFrame([(1, "r", path, text, None, "clash")], "file_id bigint, repo_id string, rel_path string, source_text string, loaded_at timestamp, reason string")
    assert uf.classified_files(f).first().reason == want


@pytest.mark.parametrize("run", ["data:image/png;base64," + "aB3+/xYz9QwErTy7" * 8, "-" * 60, "0123456789abcdef" * 4, "assets/" + "long_folder/" * 6 + "a.png", "aB3+/xYz9QwErTy7" * 20])
def test_a_run_on_a_long_line_hides_nothing(run):
    assert uf.layout("a/b.js", MIN + f'var u="{run}";' + MIN)["minified"]
    assert not uf.layout("a/b.js", f'const u = "{run * 9}";\n' + "function f(a) {\n    return a + left + right;\n}\n" * 60)["minified"]


def wrapped(text, width):
    return "\n".join(text[k : k + width] for k in range(0, len(text), width))


@pytest.mark.parametrize("suffix", ["js", "ts", "java", "rs", "cs", "kt", "swift", "go", "c", "cpp", "py"])
def test_wrapped_minified_text(suffix):
    assert uf.layout(f"a/b.{suffix}", wrapped(MIN * 2, 78))["minified"]
    assert not uf.layout(f"a/b.{suffix}", "    if (left > right) { total = total + compute_something(left, right); }\n" * 30)["minified"]
    assert not uf.layout(f"a/b.{suffix}", 'X = "' + wrapped("aB3+/xYz9QwErTy7" * 90, 76) + '"\n')["minified"]


def test_border_comments_have_no_cap():
    licence = "".join(f"# clause {k} of the terms\n" for k in range(60))
    assert uf.layout("a.py", licence + "# Code generated by x-gen v1. DO NOT EDIT.\n" + HAND)["generated_note"]
    assert uf.layout("a.py", HAND + "# Vendored from x 1.2.3\n" + licence)["vendored_note"]
    assert not uf.layout("a.py", HAND + licence + "x = 1\n# Vendored from x 1.2.3\ny = 2\n")["vendored_note"]


def test_files_operator(spark, rows):
    t = [dt.datetime(2031, 1, k) for k in (1, 2)]
    f = spark.createDataFrame([(1, "r", "a.py", HAND, t[0]), (2, "r", "b.js", MIN, t[0]), (2, "r", "b.js", MIN, t[1]), (3, "r", "c.py", NUMBERS, t[0]), (3, "r", "c.py", HAND, t[1]), (None, "r", "d.min.js", "x", None), (4, None, None, None, None)], "file_id bigint, repo_id string, rel_path string, source_text string, loaded_at timestamp")
    assert rows(uf.unwritten_files(f)) == [(2,)]
    assert rows(uf.hand_written_files(f)) == sorted([(1, "r"), (3, "r"), (4, None)], key=repr)
    assert uf.unwritten_files(f.limit(0)).count() == 0


# ---------------------------------------------------------------- functions

CASES = {
    "py": ('def f(a,\n      b: str = ")"):\n    # note\n    r"""Counts the edges\n    of one unit.\n\n    :param a: the a\n    """\n    return 1\n\ndef g():\n    """TODO"""\n\ndef count_edges(x):\n    "This function counts the edges."\n\ndef h():\n    f"""not {a} docstring"""\n\nclass C:\n    """Says a lot about types."""\n    @deco(a="x")\n    async def m(self):\n\n        \'\'\'Folds what was read before.\'\'\'\n    def n(self): "One line about order."\n    def p(self):\n        """\n        Args:\n            a: the value\n        """\n    def q(self):\n        "a" + "b"\n', {1: "Counts the edges of one unit.", 23: "Folds what was read before.", 26: "One line about order."}),
    "java": ('class A {\n    /**\n     * Joins two tables.\n     * @param a the value\n     */\n    @Override\n    @X("}{")\n    public int f(int a) { return "/** no */".length(); }\n\n    /** Lost by a blank line. */\n\n    void g() { }\n    // plain remark about order\n    void h() { }\n    /** {@inheritDoc} */\n    void i() { }\n    /** Ranks the entry xy. */\n    void rankEntryXy() { }\n    /**\n     *\n     * @param a upper bound\n     */\n    void j(int a) { }\n    /** Kept, says more. */ // aside\n    void k() { }\n}\n', {8: "Joins two tables.", 25: "Kept, says more."}),
    "go": ("package a\n\n// F reads what the store\n// has kept.\n//\n//go:noinline\nfunc F() int {\n\treturn 1\n}\n\n// TODO: rename\nfunc G() {}\n\n// ---- helpers ----\nfunc H() {}\n\n// Copyright 2030, see NOTICE\nfunc (t *T) I() {}\n\n/* Walks all open edges once. */\nfunc (t *T) J() {}\n\n// MarkUnit marks the unit.\nfunc MarkUnit() {}\n", {7: "F reads what the store has kept.", 21: "Walks all open edges once."}),
    "rs": ('/// Orders open nodes\n/// by name.\n#[inline]\npub(crate) fn f<T>(a: T) -> i64 {\n    /* outer /* inner { */ still */ 1\n}\n#[doc = "Finds late hunks."]\nfn g() {}\n///\nfn h() {}\n// plain words here\nfn i() {}\n', {4: "Orders open nodes by name.", 8: "Finds late hunks."}),
    "cs": ("class A {\n    /// <summary>\n    /// Lists what is stale.\n    /// </summary>\n    /// <param name=\"a\">upper bound</param>\n    [Obsolete]\n    public int F(int a) { return 1; }\n    /// <summary></summary>\n    /// <param name=\"a\"></param>\n    int G(int a) { return 1; }\n    /// <inheritdoc/>\n    int H() { return 1; }\n}\n", {7: "Lists what is stale."}),
    "c": ("#include <a.h>\n/*\n * Drops the local edges.\n */\nstatic int f(int a) {\n    return 1;\n}\n// Stops once the budget is spent.\nint g(void) { return 2; }\n/* n/a */\nint h(void) { return 2; }\n/// -----\nint i(void) { return 2; }\n", {5: "Drops the local edges.", 9: "Stops once the budget is spent."}),
    "swift": ("/// Checks every window.\n/// - Parameter a: may be null\n@discardableResult\nfunc f(a: Int) -> Int {\n    return 1\n}\n/** Safe to call twice. */\npublic func g() {}\n", {4: "Checks every window.", 8: "Safe to call twice."}),
    "ts": ("/** Prüft alle Einträge der Reihe nach. */\nexport function f(a: number): void {\n    const s = `${'/** x */'}`;\n}\n/* not a doc comment */\nfunction g() {}\n", {2: "Prüft alle Einträge der Reihe nach."}),
    "kt": ("/**\n * Gives zero if locked.\n */\n@Suppress(\"a\", \"b\")\nprivate fun f(): Int {\n    return 1\n}\n", {5: "Gives zero if locked."}),
}


@pytest.mark.parametrize("suffix", CASES)
@pytest.mark.parametrize("ends", ["\n", "\r\n", "\r"])
def test_documented(suffix, ends):
    text, want = CASES[suffix]
    got = {line: said for line, _, said, _ in df.documented(f"x.{suffix}", "﻿" + text.replace("\n", ends))}
    assert got == want


def test_bodies():
    by_line = {line: code for line, _, _, code in df.documented("x.py", CASES["py"][0])}
    assert by_line[1].startswith("def f(a,") and by_line[1].endswith("return 1")
    java = {line: code for line, _, _, code in df.documented("x.java", CASES["java"][0])}
    assert java[8].strip() == 'public int f(int a) { return "/** no */".length(); }'


@pytest.mark.parametrize("path,text", [(None, "x"), ("a.py", None), ("a.py", ""), ("a.txt", "/** x */\nf() {}"), ("a.py", 'def f():\n    """never closed'), ("a.java", "/** never closed"), ("a.rs", "/* /* x */"), ("a.go", "// F says it\nfunc F(")])
def test_odd_texts_do_not_fail(path, text):
    df.documented(path, text)


def test_what_names_say():
    assert not df.says_something("This function applys the slice plitamipoth.", "apply_slice_plitamipoth")
    assert not df.says_something("Indexes the cycle xy.", "indexCycleXy") and not df.says_something("No description available.", "f") and not df.says_something("", "f")
    assert df.says_something("Stops early once the budget is spent.", "stop") and df.says_something("Liefert die Anzahl.", "count")


def test_functions_operator(spark, rows):
    t = [dt.datetime(2031, 1, k) for k in (1, 2)]
    f = [(1, "r", "x.py", CASES["py"][0], t[0]), (1, "r", "x.py", CASES["py"][0], t[1]), (2, "r", "y.go", CASES["go"][0], None), (3, "r", "z.c", None, t[0])]
    files = spark.createDataFrame([(*x, "clash") for x in f], "file_id bigint, repo_id string, rel_path string, source_text string, loaded_at timestamp, code string")
    s = [(1, 1, "def f(a, b)", False), (1, 1, "def f(a, b)", False), (1, 23, None, None), (1, 11, "def g()", False), (2, 7, "func F() int", False), (2, 21, "type J struct", False), (2, 999, "func Z()", False), (3, 1, "int f()", None), (None, 1, "x", None)]
    symbols = spark.createDataFrame(s, "file_id bigint, start_line int, signature string, is_type_decl boolean")
    assert rows(df.found_functions(files, symbols)) == [(1, 1), (1, 23), (2, 7)]
    pairs = df.documented_functions(files, symbols)
    assert rows(pairs.filter("file_id = 2").select("description")) == [("F reads what the store has kept.",)]
    assert df.found_functions(files.limit(0), symbols).count() == 0 and df.found_functions(files, symbols.limit(0)).count() == 0


def test_signatures_of_any_length():
    types = ", ".join(f"Map<String, List<Type{k}>> argument{k}" for k in range(60))
    long_head = "<" + ", ".join(f"T{k} extends Comparable<T{k}>" for k in range(40)) + "> "
    java = f"class A {{\n    /** Joins what the walker left open. */\n    public {long_head}Map<String, T0> resolve({types}) {{\n        return null;\n    }}\n}}\n"
    assert len(long_head) > 800
    assert [(line, name) for line, name, _, _ in df.documented("A.java", java)] == [(3, "resolve")]
    receiver = "r *" + "a" * 600
    go = f"package p\n\n// Fetch joins what the walker left open.\nfunc ({receiver}) Fetch(a int) int {{\n\treturn 1\n}}\n"
    assert [(line, name) for line, name, _, _ in df.documented("a.go", go)] == [(4, "Fetch")]
    swift = "/// Joins what the walker left open.\nfunc fetch(" + ",\n    ".join(f"a{k}: Int" for k in range(100)) + "\n)\n" + "\n" * 0 + "    -> Int {\n    1\n}\n"
    found = df.documented("a.swift", swift)
    assert [(line, name) for line, name, _, _ in found] == [(2, "fetch")] and found[0][3].rstrip().endswith("}")
    assert df.documented("a.kt", "/** Says how many there are. */\nval x = 3\n\nfun f() { }\n") == []


def test_deliveries_with_one_stamp(spark, rows):
    import datetime as dt

    t = dt.datetime(2031, 1, 1)
    a, b = "def f():\n    '''Reads the open units.'''\n", "\ndef f():\n    '''Reads the closed units.'''\n"
    files = spark.createDataFrame([(1, "a.py", a, t), (1, "a.py", b, t), (1, "a.py", b, t)], "file_id bigint, rel_path string, source_text string, loaded_at timestamp")
    symbols = spark.createDataFrame([(1, 1, "def f():", False), (1, 2, "def f():", False)], "file_id bigint, start_line int, signature string, is_type_decl boolean")
    assert len(rows(df.found_functions(files, symbols))) == 1


def test_layout_alone_and_the_nodes_of_hand_written_units(spark, rows):
    import datetime as dt

    t = dt.datetime(2031, 1, 1)
    files = spark.createDataFrame(
        [(1, "r", "./a.js", MIN * 3, t), (2, "r", "b\\c.py", "# This file was produced automatically from x.schema.\n" + HAND, t), (3, None, "vendor/d.py", HAND, t), (4, "r", "e.py", HAND, t), (5, "r", "f.c", "".join(f"int get_x_{k}(void) {{\n    return 0;\n}}\n" for k in range(5)), t)],
        "file_id bigint, repo_id string, rel_path string, source_text string, loaded_at timestamp",
    )
    assert rows(uf.unwritten_files(files)) == [(1,), (2,), (3,), (5,)]
    assert rows(uf.unwritten_files(files, notes=False, paths=False)) == [(1,), (5,)]
    assert rows(uf.unwritten_files(files, paths=False)) == [(1,), (2,), (5,)]
    nodes = spark.createDataFrame([("r", "a.js", 1), ("r", "b/c.py", 2), (None, "vendor/d.py", 3), ("r", "vendor/d.py", 4), ("r", "e.py", 5), ("r", None, 6)], "repo_id string, unit string, load_seq bigint")
    assert rows(uf.hand_written_nodes(files, nodes).select("load_seq")) == [(4,), (5,), (6,)]


@pytest.mark.parametrize("note,kind", [("Emitted by protoc-gen 1.2 from api.schema", "generated"), ("Do not modify.", "generated"), ("do not modify without asking", None), ("Written by the storage team", None), ("Taken from libfoo 2.1.3", "vendored"), ("Mirrored from upstream@4.12.0", "vendored"), ("taken from the store in one pass", None), ("sha256: 0f3a9b7c11", "generated")])
def test_notes_by_their_parts(note, kind):
    s = uf.layout("a.py", f"# {note}\n" + HAND)
    assert ("generated" if s["generated_note"] else "vendored" if s["vendored_note"] else None) == kind
