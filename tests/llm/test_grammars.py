"""Texts with one error each, and valid ones with constructs that are easy to lose, for each of the ten parsers."""

import pytest

from graphloom.llm.grammars import parses

#: Where a statement, a member and a declaration stand in each language.
BODY = {
    "java": "class A {{ void f() {{ {} }} }}\n", "csharp": "class A {{ void F() {{ {} }} }}\n", "javascript": "function f() {{ {} }}\n", "typescript": "function f() {{ {} }}\n", "c": "void f(void) {{ {} }}\n", "cpp": "void f() {{ {} }}\n",
    "go": "package p\n\nfunc f() {{\n{}\n}}\n", "rust": "fn f() {{ {} }}\n", "kotlin": "fun f() {{\n{}\n}}\n", "swift": "func f() {{\n{}\n}}\n",
}
MEMBER = {"java": "class A {{ {} }}\n", "csharp": "class A {{ {} }}\n", "javascript": "class A {{ {} }}\n", "typescript": "class A {{ {} }}\n", "cpp": "class A {{ {} }};\n", "c": "struct a {{ {} }};\n", "go": "package p\n\ntype T struct {{\n{}\n}}\n", "rust": "impl A {{ {} }}\n", "kotlin": "class A {{\n{}\n}}\n", "swift": "class A {{\n{}\n}}\n"}
TOP = {x: "{}\n" for x in BODY} | {"go": "package p\n\n{}\n"}

#: Wrong in a body of every language (statements end with the semicolon that all of them allow).
EVERYWHERE = ["foo(a b);", "x = ;", "foo(a,, b);", "x = a + ;", "x = (a;", "x = a);", "x = a b c + ;", 'x = "abc;', "x = 12ab3;", "/* open", "x = a . ;", "x = f(1 2);", "f(;", "x = [1;", "foo(a) { b ] }", "<<<<<<< HEAD\nx = 1;", "y = x\n>>>>>>> side/branch;", "y = x\n=======\nz;", "f(a,;"]
CURLY = ["if (a { }", "if a) { }", "else { }", "try { }", "catch (e) { }", "while () { }", "while { }", "do { } x();", "for (a; b) { }", "for (;; { }", "switch (x) { foo(); }", "switch (x) { case : y(); }", "case 1: y();", "return return;", "x = a ? b;", "x = a ? : c;", "break 1 + 2;", "if { x(); }", "x == = y;", "3 = x;", "f() = ;", "x = new ;", "try { } finally", "{ x();"]
BROKEN = {
    "java": [
        (BODY, [*EVERYWHERE, *CURLY, "int = 3;", "int x y;", "a + b;", "String s = new String(;", "throw;", "x = (int) ;", "for (int i : ) { }", "x -> ;", "int[] a = {1, 2;", "a.b.;", "x++ ++ y;", "List<String x;", "synchronized { }", "assert ;", "try (var r) ) { }"]),
        (MEMBER, ["void f( { }", "int f(int) { }", "void f(a) { }", "int x", "public public(", "f() { }}", "void f() throws { }", "enum { A }", "@ int x;", "int f() = 3;", "void 3f() { }"]),
        (TOP, ["import a.b", "package a;;; package b;", "class { }", "class A extends { }", "class A { } }", "int x = 3;", "import a.*.b;", "interface A implements B { }", "class A(", "record R { }"]),
    ],
    "csharp": [
        (BODY, [*EVERYWHERE, *CURLY, "int = 3;", "int x y;", "a + b;", "foreach (x in y) { }", "foreach (var x y) { }", "var x = new List<int>(;", "using () { }", "lock { }", "x = a is ;", "x = a switch { 1 > 2 };", "await;", "var = ;", "goto;", "yield x;", 'var s = $"{a + }";', 'var s = $"{}";', "x => ;"]),
        (MEMBER, ["void F( { }", "int F(int) { }", "int P { gett; }", "int P { get set }", "int x", "public int F() => ;", "event x;", "operator +(A a) { }", "int this[] { get; }", "enum { A }", "[Obsolete int x;"]),
        (TOP, ["using System", "namespace { }", "class { }", "class A : { }", "class A { } }", "struct S { int }", "using = A;", "namespace A { int x = 1; }", "enum E { A B }", "delegate F();"]),
    ],
    "javascript": [
        (BODY, [*EVERYWHERE, *CURLY, "let = = 3;", "let x y;", "const;", "function () { }", "x => => y;", "for (let x y of z) { }", "var x = {a: };", "var x = {a b};", "var x = {,};", "class { }", "x = `a${ 1 + }`;", "x = `a${}`;", "throw\nx;", "x = <a>text</b>;", "x = <a b={>;", "x = a?.;", "new;", "async function { }", "f(...);", "[a, b] => c;", "import x from 'y' z;", "export { a b };", "x = {get a};"]),
        (MEMBER, ["f( { }", "f() ", "get { }", "constructor() { ", "x: number;", "static static() x", "f() => 1;", "a b;"]),
        (TOP, ["import from 'a';", "import {a b} from 'c';", "import a b from 'c';", "export default;", "export x;", "class A extends { }", "interface A { }", "function f(a b) { }", "let x: number = 1;", "enum A { B }"]),
    ],
    "typescript": [
        (BODY, [*EVERYWHERE, *CURLY, "let x: = 3;", "let x: number number;", "const x: Map<string = y;", "x as ;", "function g(a: ) { }", "function () { }", "var x = {a b};", "for (const x y of z) { }", "type T = ;", "type T = string |;", "type T = { a: };", "type T = [string;", "let x: (a: string) = y;", "x = `a${ 1 + }`;", "class { }", "enum { A }", "enum E { A B }", "x satisfies ;", "let x = <T>;"]),
        (MEMBER, ["f( { }", "x: ;", "private readonly;x y", "constructor(private) x { }", "get { }", "f(a: string b: number) { }", "x?: string number;", "a b;"]),
        (TOP, ["import from 'a';", "import {a b} from 'c';", "export default;", "interface { a: string }", "interface A extends { }", "interface A { a: string b: number }", "interface A { f(: string }", "namespace { }", "declare x;", "abstract x;", "export type;", "class A implements { }"]),
    ],
    "c": [
        (BODY, [*EVERYWHERE, *[x for x in CURLY if "catch" not in x and "new" not in x and "try" not in x and "switch (x) { foo" not in x and x != "case 1: y();" and x not in ("f() = ;", "x = a ? : c;")], "int = 3;", "int x y;", "int a[3;", "x = sizeof;", "goto;", "struct { int a } x;", "int x = {1, 2;", "x->;", "*;", "x = (int);", "for (int i = 0, i < 3) { }", "char c = 'ab", "return int;", "x = &;", "try { }", "class a b;"]),
        (MEMBER, ["int a", "int;", "a;", "int a b;", "int a[;", "int f() { }", "= 3;"]),
        (TOP, ["int f( { }", "int f(int a, ) { }", "int f(int a int b) { }", "struct s { int a; }", "typedef;", "enum e { A, B = };", "enum { A B };", "int f() { } }", "#if A\nint x;\n#else\nint f( { return\n#endif", "#if A\nint x;", "int x;\n#endif", "#if A\nint x;\n#else\nint y;\n#else\nint z;\n#endif", "#unknown x", "foo();", "int x = ;", "static;", "void f() { return 1 }"]),
    ],
    "cpp": [
        (BODY, [*EVERYWHERE, *[x for x in CURLY if "switch (x) { foo" not in x and x != "case 1: y();"], "int = 3;", "int x y;", "std::vector<int x;", "auto f = [&( { };", "auto f = [=](int) -> { };", "x = static_cast<int>;", "x = static_cast<>(y);", "for (auto x y : z) { }", "for (auto x : ) { }", "using = int;", "delete;", "throw 1 2;", "namespace = a;", "x = new int[;", "a::;", "co_await;", "auto [a b] = c;"]),
        (MEMBER, ["public int x;", "virtual;", "A( { }", "A() : { }", "A() : a(1 { }", "int f() const const(", "int x", "operator();", "~() { }", "template <> ;", "friend;", "int f() = ;"]),
        (TOP, ["namespace a { int x;", "template <typename T class A { };", "template <typename T> ;", "class A : { };", "class A { }", "using namespace;", "int f(int a int b) { }", "enum class { A B };", "#if A\nint x;\n#else\nint f( {\n#endif", "foo bar baz;", "int f() { } }", "struct : A { int };"]),
    ],
    "go": [
        (BODY, [*EVERYWHERE, "if { }", "else { }", "for i := 0; i < 3 { }", "for i in x { }", "switch x { foo() }", "case 1:", "var x int int", "x := ", ":= 3", "a, b := ", "x y", "a + b", "func() { }", "go f", "defer x", "return return", "try { }", "while x { }", "x = map[string int{}", "x = []int{1 2}", "x = []int{1,\n2\n}", "var = 3", "const x", "if x\n{ }", "x := a ? b : c", "for ;; ; { }", "select { x }", "x.(type", "f(...)", "struct { }", "goto", "x++ + 1", "3 := x", "a, 1 := b()"]),
        (MEMBER, ["a b c int", "a,", "a int b int", "func f()", "= 3", "a [int"]),
        (TOP, ["import fmt", "func f( { }", "func f(a int b int) { }", "func (t T f() { }", "type T struct { a int", "var x", "x := 3", "func f() int int { }", "type T", "func f(a int, string) { }", "import (\"a\" \"b\")", "package q", "func { }", "type I interface { F( }", "const (\nA = \n)"]),
    ],
    "rust": [
        (BODY, [*EVERYWHERE, "let = 3;", "let x y;", "let x: = 3;", "if { }", "else { }", "while { }", "match x { 1 2 => 3 }", "match x { 1 => }", "match { }", "match x { 1 => 2 2 => 3 }", "for x y { }", "for x in { }", "for in y { }", "loop x { }", "let x = if a 1 else 2;", "x = |a b| c;", "let v = vec![1, 2;", "x as ;", "x.;", "x?.?y;", "let x = A { a: 1 b: 2 };", "let x = A { a: };", "foo::<i32;", "try { }", "let mut;", "fn g( { }", "let x = &;", "unsafe x;", "let x = y else 3;", "let (a, = b;"]),
        (MEMBER, ["fn f( { }", "fn f(a) { }", "fn f(a: i32 b: i32) { }", "fn f() -> { }", "pub;", "const X = ;", "let x = 1;", "fn { }", "fn f<T>>() { }", "x: i32,"]),
        (TOP, ["struct A { a i32 }", "struct A { a: i32 b: i32 }", "enum E { A B }", "enum { A }", "use a::;", "use a b;", "impl { }", "impl for A { }", "fn f() { } }", "trait { }", "mod;", "type A;B = C;", "let x = 1;", "static X: i32 = ;", "#[derive(Debug] struct A;", "pub struct;", "x();"]),
    ],
    "kotlin": [
        (BODY, [*EVERYWHERE, "val = 3", "val x Int = 3", "var x y", "if { }", "if (a { }", "else { }", "while { }", "for (x y) { }", "for (x in ) { }", "for x in y { }", "when (x) { 1 2 -> 3 }", "when (x) { -> 3 }", "when (x) { 1 3 }", "try { }", "fun ( { }", "x?.", "x!!.", "val f = { a b -> c }; ]", 'val s = "a${ 1 + }"', 'val s = "a${}"', "return return )", "do { } x", "x is ", "x as ", "x = = 3", "throw", "val (a b) = c", "class { }", "3 = x", "x ?: ", "val x: = 3", "a b", "val x by"]),
        (MEMBER, ["fun f( { }", "fun f(a) { }", "fun f(a: Int b: Int) { }", "fun f(): { }", "val x: ", "init x", "constructor { }", "fun { }", "x = 3", "companion { }", "foo()", "override x"]),
        (TOP, ["import", "package", "class A(a: Int) { ", "class A : { }", "class { }", "class A(a: Int b: Int)", "interface A { val }", "fun f() { } }", "enum class E { A B }", "object", "typealias A", "foo()", "data class", "x = 3"]),
    ],
    "swift": [
        (BODY, [*EVERYWHERE, "let = 3", "let x y", "let x: = 3", "if { }", "else { }", "while { }", "for x y { }", "for x in { }", "for in y { }", "switch x { foo() }", "switch x { case : y() }", "switch x { case 1: }", "case 1: y()", "guard let a = b { return }", "guard a else", "do { } catch {", "repeat { } x", "func ( { }", "x = = 3", "x as ", "x is ", 'let s = "a\\( 1 + )"', 'let s = "a\\()"', "return return )", "throw", "let (a b) = c", "if let = b { }", "class { }", "x?.", "3 = x", "defer x", "let f = { (a b) in c }"]),
        (MEMBER, ["func f( { }", "func f(a) { }", "func f(a: Int b: Int) { }", "func f() -> { }", "var x: ", "init { }", "let", "foo()", "x = 3", "var x: Int { gett { 1 } sett }; ]", "subscript { 1 }", "func { }", "case"]),
        (TOP, ["import", "class A { ", "class A : { }", "struct { }", "enum E { case a b }", "extension { }", "func f() { } }", "protocol { }", "typealias A", "#if A\nlet x = 1\n", "let x = 1\n#endif", "@ class A { }", "struct A<T { }", "func f<T(a: T) { }"]),
    ],
}
GOOD = {
    "java": [
        (BODY, ["x = a < b ? c : d;", "int[] a = {1, 2,};", "List<Map<String, ? extends T>> x = new ArrayList<>();", "Runnable r = () -> { };", "f((a, b) -> a + b);", "x = (int) y;", "x = (A & B) y;", "x = (a) - b;", "for (;;) break;", "for (int i = 0, j = 1; i < j; i++, j--) ;", "for (final var x : xs) { }", "lab: for (;;) { continue lab; }", "switch (x) { case A, B -> f(); case C -> { } default -> throw new E(); }", "int y = switch (x) { case 1: yield 2; default: yield 3; };", "if (o instanceof String s && s.isEmpty()) { }", "if (o instanceof P(int a, var b)) { }", "switch (o) { case P(int a, Q q) when a > 1 -> f(); case String s -> g(); case null, default -> h(); }", "String t = \"\"\"\n a \"b\" {\n \"\"\";", "x = y >>> 2 >> 1 << 3;", "x >>>= 2;", "a[i++] = b[--j];", "this.<T>f().g(A::new, int[]::new, List<String>::size);", "new A() { int x; }.f();", "synchronized (x) { }", "try (A a = b(); c) { } finally { }", "class L { } record R(int a) { }", "char c = '\\u0041';", "var v = int.class;", "assert a : b;", "final int z;", "A.B<C>[] q = null;", "x = -1_000L + 0x1F + .5e3f + 1.;", "yield = 3;", "if (a) b(); else if (c) d(); else e();", "@A int n = 0;", "long m = (long) -x;", "f(x -> { return x; }, y -> y);"]),
        (MEMBER, ["A() { this(1); }", "<T extends A & B> T f(T... x) throws E, F { return null; }", "abstract int f();", "static { }", "{ }", "@A(b = {1, 2}, c = @D) int x;", "int a[], b = 3;", "interface I { default void f() { } int X = 1; }", "@interface N { int v() default 3; String[] w() default {}; }", "enum E { A, B(1) { void g() { } }, ; E() { } }", "sealed interface S permits P, Q { } non-sealed class P implements S { }", "record R<T>(T a, int... b) implements I { R { } static int x; }", "void f(A this, final @B int[] c) { }", "int f()[] { return null; }", ";"]),
        (TOP, ["package a.b;\nimport static a.B.*;\nimport a.*;\n;class A { }", "@A package b;", "module a.b { requires transitive c; exports d to e, f; }"]),
    ],
    "csharp": [
        (BODY, ["x = a < b ? c : d;", "var x = new Dictionary<string, List<int>> { [\"a\"] = new() { 1, 2 }, };", "int? y = null; y ??= 3;", "var (a, b) = f();", "(int a, string b) t = (1, \"x\");", "foreach (var (k, v) in d) { }", "if (x is not null and > 3 or < 1) { }", "if (o is string { Length: > 3 } s) { }", "var r = x switch { 1 or 2 => \"a\", > 5 when y => \"b\", _ => \"c\" };", "f(out var z, ref q, in w, name: 3);", "f(x => x.Y, (a, b) => { }, async () => await g());", "using var s = g();", "using (var s = g()) { }", "lock (x) { }", "await foreach (var x in y) { }", "var q = from a in b where a > 1 orderby a descending select a.c;", "goto done; done: ;", "switch (x) { case 1: case 2 when y: break; case string s: break; default: return; }", "var s = $\"a{b,5:F2}c{{d}}{(x ? 1 : 2)}\";", "var s = @\"a\\\"\"b\";", "var s = \"\"\"\n  raw \"x\"\n  \"\"\";", "x = y as string ?? z;", "a?.b?[0]?.c();", "checked { x++; }", "int[] p = { 1, 2 }; int[,] m = new int[2, 3]; int[][] j = new int[2][];", "const int k = 3;", "int L(int x) => x * 2;", "static void M<T>(T x) where T : new() { }", "throw new E(x ?? throw new F());", "x = a is B b ? b : null;", "var e = nameof(x); var d = default(int); var t = typeof(List<>);", "x >>= 2; x = y >> 3;", "int i = (int)x + (-1);", "var w = y with { A = 1 };", "for (int i = 0, n = 3; i < n; i++, n--) ;", "do { } while (x);", "try { } catch (E e) when (e.A) { } catch { } finally { }", "yield return 1;", "List<int> l = [1, 2, ..z];", "var last = x[^1]; var r = x[1..^2];", "if (f<int>(x)) { }", "unsafe { int* p = &x; }", "_ = f();"]),
        (MEMBER, ["public int P { get; private set; } = 3;", "public int Q => 3;", "public int R { get => x; set => x = value; }", "public string this[int i] { get { return null; } }", "public static A operator +(A a, A b) => a;", "public static implicit operator int(A a) => 1;", "A() : base(1) { }", "~A() { }", "event EventHandler E;", "event H F { add { } remove { } }", "[Obsolete(\"x\", false)] public int X, Y = 3;", "public delegate void D<in T>(T x);", "int I.F<T>(T x) where T : class, new() { return 1; }", "public required int Z { get; init; }", "async Task<int> F(params int[] xs) { return await g(); }", "partial void G();", "record R(int A, string B) : S(A);", "const int K = 1;", "enum E : byte { [X] A = 1, B, }", "interface I<out T> { T F(); }"]),
        (TOP, ["using A = B.C<int>;\nusing static D;\nglobal using E;\nnamespace F;\n[assembly: X]\nclass G { }".replace("[assembly: X]\n", ""), "namespace A { using B; class C { } namespace D { } }", "using System;\nConsole.WriteLine(1);\n", "#if A\nclass B { }\n#else\nclass C { }\n#endif\n#region x\n#endregion", "public record struct P(int X);"]),
    ],
    "javascript": [
        (BODY, ["x = a\n++b\ny = 1", "a = b\n(c)", "let {a, b: {c = 1}, ...d} = e, [f,, g = 2, ...h] = i;", "x = a ?? b?.c?.[0]?.(1);", "for (const [k, v] of Object.entries(o)) { }", "for (let i = 0, n = a in b ? 1 : 2; i < n; i++) ;".replace("a in b ? 1 : 2", "(a in b) ? 1 : 2"), "for (x in y) z();", "for await (const q of r) { }", "x = y / 2 / z; r = /[/\\]]+/gi.test(s);", "if (a) /re/.test(b);", "x = `a${b ? `c${d}` : 'e'}f`;", "x = { a, b: 1, [c]: 2, 'd': 3, 4: 5, get e() { return 1; }, set e(v) { }, async f() { }, *g() { }, async *h() { }, ...i, if: 1, get: 2 };", "x = async a => await a; y = async (a, b) => { };", "x = function* g() { yield* h(); yield; };", "lab: for (;;) { continue lab; }", "switch (a) { case 1: { } default: }", "x = class A extends (B, C) { static #p = 1; static { } get a() { return 1; } 'b'() { } [c] = 2; async *d() { } };", "a = b ? c : d ? e : f; x **= 2; y ||= 3; z >>>= 1;", "new A; new a.B(1).c; new (f())();", "var el = <a.b c='d' {...e} f={g}>{h} text <></> {/* no */}</a.b>;", "import('a').then(b => c);", "do x++; while (x < 3) y();", "throw new E(`x`);", "delete a.b, void 0, typeof c;", "try { } catch { } finally { }", "let async = 1, of = 2, get = 3;", "x = a\n  .b()\n  .c", "if (a) ; else b()", "label: { break label; }", "a = b ? (c, d) : (e) => f;", "x = (a, b) => ({ c: a })"]),
        (TOP, ["import a, * as b from 'c';\nimport 'd';\nimport { default as e, f as g } from 'h' with { type: 'json' };\nexport * from 'i';\nexport * as j from 'k';\nexport { l as default, m };\nexport default async function () { }\nexport const n = 1, o = 2;", "#!/usr/bin/env node\n'use strict'\nmodule.exports = { }", "export default class { }", "export default (a) => a", "const a = 1\nlet b\nvar c = a\n[1].d"]),
    ],
    "typescript": [
        (BODY, ["let x: Array<Map<string, number[]>> = [];", "const f = <T,>(x: T): T => x;", "let g: (a: string, b?: number) => void = () => { };", "x = y as unknown as Z; w = v!; u = <T>t;", "for (const k of xs as string[]) { }", "let u: 'a' | `b${string}` | -1 | null | undefined;", "let t: [a: string, b?: number, ...c: boolean[]];", "let m: { readonly [K in keyof T]?: T[K] } & { -readonly [k: string]: U };", "let c: T extends (infer U)[] ? U : never;", "let n: typeof x.y[number]['z'];", "function a(this: A, x?: B, ...y: C[]): x is D { return true; }", "function b(x: string): void;\nfunction b(x: any) { }", "f<string>(x); new Map<string, A<B>>();", "let x = a < b, c = d > e;", "if (a < b && c > d) { }", "x = a ? (b) : c; x = a ? (b, c) => d : e;", "let o = { f<T>(x: T): T { return x; }, async g(): Promise<void> { } };", "x satisfies Y;", "enum E { A = 1 << 2, B = 'x' }", "let f2: new (...args: any[]) => object;", "let v: unique symbol; let w: abstract new () => void;", "try { } catch (e: unknown) { }", "const { a, b }: { a: string; b: number } = c;", "asserts: for (;;) break asserts;", "let z = (x: number): string => `${x}`;", "type A<T = string> = T;"]),
        (MEMBER, ["private readonly a: string = 'x';", "static b?: number;", "declare c: string;", "d!: E;", "constructor(private readonly x: A, public y = 1) { super(); }", "get f(): string { return ''; }", "abstract g(): void;", "h<T extends U>(x: T): asserts x is T;", "[key: string]: any;", "override async *i() { }", "@Dec() @A.b(1) j: string;", "k = (x: string): void => { }", "static { }", "readonly = 1; get = 2; static async = 3"]),
        (TOP, ["import type { A } from 'b'; import { type C, D } from 'e'; import F = require('g'); export type { H } from 'i'; export = J;", "declare module 'x' { export const y: string; } declare global { interface Window { a: string } }", "export abstract class A<T> extends B<T> implements C, D<E> { }", "export declare function f(x: string): void;", "namespace A.B { export const x = 1; }", "export default interface A { }", "export const enum E { A }", "interface A extends B<C>, D { new (x: string): A; (y: number): B; readonly z?: C; get w(): string; 'q-r': 1, m?(): void }", "abstract class A { abstract b: string; }", "type F = { (a: string): void; [k: string]: unknown; }", "export * as ns from './x'", "export as namespace Foo;"]),
    ],
    "c": [
        (BODY, ["int *p = &x, **q, a[3] = {1, [2] = 3}, (*f)(int, char *) = 0;", "x = (int) y + (char *) z - sizeof(int) * sizeof x;", "struct s t = { .a = 1, .b.c = 2 };", "f((struct s){ 1, 2 });", "for (int i = 0, *j = a; i < 3; i++, j--) ;", "a = b ? c : d, e++;", "switch (x) { case 1 ... 3: case 'a': { } break; default: ; }", "goto out; out: return;", "unsigned long long int x = 0xFFULL;", "const char *const s = \"a\" \"b\" PRIu64 \"\\n\";", "x->y.z[i]->w(a, b)++;", "*p++ = -*q--;", "do x(); while (0);", "static const struct { int a; } t[] = { { 1 }, };", "if (!(x & ~y) && z) ; else if (w) { }", "typedef int t; t v;", "foo * bar; a * b;", "void (*signal(int, void (*)(int)))(int);", "int x : 3;".replace(" : 3", ""), "enum { A, B } e = A;", "return (x) ? (y) : (z);", "va_list ap; va_arg(ap, int);", "LOG(\"x\", a);", "size_t n = sizeof (struct s) / sizeof *p;"]),
        (TOP, ["#include <a.h>\n#define X(a, b) \\\n  ((a) + (b))\nextern int x;\nstatic inline int f(void) { return 0; }\nint g(int, char *, ...);\nint h();\ntypedef struct s s_t, *s_p;\nunion u { int a; float b; };\n", "#ifdef A\nint f(int a) {\n#else\nint f(long a) {\n#endif\n  return 0;\n}\n", "#ifdef __cplusplus\nextern \"C\" {\n#endif\nint x;\n#ifdef __cplusplus\n}\n#endif\n", "#if 0\nthis is not ( C\n#endif\nint x;", "struct s { unsigned a : 3, b : 5; struct { int c; }; union { int d; } e; int (*f)(void); char g[]; };", "int f(a) int a; { return a; }".replace("(a) int a;", "(int a)"), "DEFINE_THING(foo, bar)\nint x;", "__attribute__((unused)) static int y;", "enum e { A = 1, B = A << 2, };", "int main(int argc, char **argv) { return 0; }", "const int (*p)[3];"]),
    ],
    "cpp": [
        (BODY, ["std::map<std::string, std::vector<int>> m{{\"a\", {1, 2}}};", "auto f = [&, x = 1, this](auto &&y) mutable noexcept -> int { return y; };", "for (const auto &[k, v] : m) { }", "if (auto it = m.find(x); it != m.end()) { }", "if constexpr (a<b>::value) { }", "x = static_cast<int>(y) + reinterpret_cast<A *>(z)->w;", "auto p = std::make_unique<A<B>>(1);", "delete[] p; new (q) A(1); new int[3]{};", "std::cout << a << \"b\" << std::endl;", "A a(1), b{2}, c = {3}; A d;", "x = a < b && c > d;", "throw; try { } catch (...) { } ", "using B = A<int>; using namespace std; typedef int T;", "auto s = R\"x(a)\" b)x\";", "int n = 1'000'000; auto d = 3.5_km; auto u = 10ms;", "a.template f<int>(); typename A::B c;", "decltype(auto) e = (f);", "[[maybe_unused]] int g = 0;", "return {1, 2};", "(void) x; int(y); T::f(z);", "static_assert(sizeof(int) == 4, \"x\");", "co_await f(); co_return;", "auto [a, b] = c;", "while (auto x = f()) { }", "A::B::C<D> *e = nullptr;", "x = y ? A{1} : A{2};", "std::function<int(int, char)> h = [](int a, char) { return a; };", "lbl: for (;;) { goto lbl; }", "x <=> y; a ->* b;", "f(std::forward<T>(args)...);"]),
        (MEMBER, ["public: explicit A(int x) : a_(x), b_{1} { }", "virtual ~A() = default;", "A(const A &) = delete; A &operator=(A &&) noexcept;", "bool operator==(const A &o) const { return true; }", "operator bool() const { return true; }", "int operator()(int x) const;", "template <typename T, typename... Ts> void f(T &&t, Ts &&...ts);", "static constexpr int k = 3; mutable int m_ = 0; int x, *y;", "friend class B; friend std::ostream &operator<<(std::ostream &, const A &);", "virtual void g() const override final;", "virtual int h() = 0;", "using Base::Base; typedef int T; enum class E : int { A, B };", "unsigned a : 3; struct { int z; } w; std::vector<int> v{1, 2};", "auto f() const -> int; [[nodiscard]] int q() const noexcept;", "A &operator++(); A operator++(int);", "std::function<void()> cb = [] { };", "int arr[3] = {1, 2, 3};", "private:\n  class Impl;\n  std::unique_ptr<Impl> p_;"]),
        (TOP, ["namespace a::b { inline namespace c { int x; } } namespace d = a::b;", "template <class T, int N = 3> struct A<T[N]> : public B<T>, private virtual C { };", "template <> void f<int>(int);", "extern \"C\" { int g(); }", "A::A() : b(1) { }\nA::~A() { }\nint A::f() const { return 1; }\nA::operator int() const { return 1; }\nA &A::operator=(const A &) { return *this; }", "template <typename T> concept C = requires(T t) { { t.f() } -> std::same_as<int>; typename T::x; };", "template <typename T> requires C<T> auto g(T t) -> decltype(t.f());", "using X = int (*)(int);", "std::ostream &operator<<(std::ostream &o, const A &a) { return o; }", "#pragma once\n#if A\nint x;\n#elif B\nint y;\n#endif", "static const std::map<int, std::string> kM = {{1, \"a\"}};", "constexpr auto k = 3; thread_local int t;", "template <typename... Ts> auto sum(Ts... ts) { return (ts + ... + 0); }", "int A::x_ = 0;", "enum E { A, B = 1 << 2 };", "TEST(Foo, Bar) { int x = 1; }"]),
    ],
    "go": [
        (BODY, ["x := map[string][]int{\"a\": {1, 2}, \"b\": nil}", "for i := range 10 { _ = i }", "for range ch { }", "for k, v := range m { _, _ = k, v }", "for i := 0; i < 3; i++ { }", "for x < 3 { }", "if v, ok := m[k]; !ok { } else if x := f(); x > 1 { } else { }", "switch x := y.(type) { case int, *T: case nil: default: }", "switch { case a > 1: fallthrough; case b: }", "select { case v := <-ch: _ = v; case ch <- 1: default: }", "go func() { }()", "defer func(x int) { }(1)", "var a, b int = 1, 2", "a, b = b, a", "p := &T{A: 1, B: []int{1}}", "x.y.z(1, 2, xs...)", "s[1:2], t = u[:3], v[::]".replace(", t", "").replace(", v[::]", ""), "s = t[1:2:3]", "f := func(a, b int, c ...string) (x int, err error) { return }", "var c chan<- int = make(chan int, 1)", "type L struct{ a int }", "const (\n\tA = iota\n\tB\n)", "L: for { break L }", "x = a.(T).b", "x := []struct{ a int }{{1}, {2}}", "y := [...]int{1, 2}", "return a, b", "x <<= 2; y &^= 3; z = a &^ b >> 1", "if x == (T{}) { }", "var f func(int) error = nil", "x := g[int](1)", "<-done", "i++", "{ }", "var _ = x", "a = *p.q", "ch <- <-other"]),
        (MEMBER, ["A, B int `json:\"a\"`", "*T", "io.Reader", "m map[string]func(int) error", "x struct{ y int }", "G[int]", "arr [3]int"]),
        (TOP, ["import (\n\tf \"fmt\"\n\t. \"a\"\n\t_ \"b\"\n)\n", "type (\n\tA = int\n\tB[T any, U ~int | ~string] struct{ x T }\n)", "func (t *T[K]) F(int, string) (a int, err error) { return 0, nil }", "func G[T any](xs []T, f func(T) bool) []T { return nil }", "type I interface {\n\tio.Reader\n\tF(a int) error\n\t~int | string\n}", "var (\n\ta = 1\n\tb, c int\n)", "func ext(x int) int", "var x = struct{ a int }{1}", "func h(a, b int, c []string, d map[string]int, e ...interface{}) { }"]),
    ],
    "rust": [
        (BODY, ["let x = if a { 1 } else if let Some(b) = c { b } else { 3 };", "let Some(x) = y else { return };", "match x { 1 | 2 => 3, 4..=5 if z => { } n @ 6.. => n, A::B { c, .. } => 1, (a, _) => 2, &mut q => q, _ => unreachable!() }", "let v: Vec<Vec<i32>> = vec![vec![1]; 3];", "for (i, x) in xs.iter().enumerate() { }", "'a: loop { break 'a 3; }", "let f = |a: i32, (b, c)| -> i32 { a + b }; let g = move || 1;", "x.iter().map(|&q| q * 2).collect::<Vec<_>>()?;", "let s = S { a: 1, b, ..Default::default() };", "if x < y as usize && z > 3 { }", "while let Some(x) = it.next() { }", "let r = 0..n; let t = ..=3; let u = &a[1..];", "unsafe { *p = 1; }", "return Err(E::new())", "let (mut a, ref b): (i32, &str) = c;", "println!(\"{} {x}\", y);", "a.0.1 = 3; b[i] += 1; *c <<= 2;", "let x = &mut *y; let z = !w; let q = -1i32;", "let c = b'x'; let s = br#\"a\"#; let t = 'static_;'".replace(" let t = 'static_;'", ""), "match x { } ", "{ 1 } ", "async move { f().await }", "let n = <T as Trait>::f::<u8>(1);", "if let A(x) | B(x) = y && x > 1 { }", "fn inner<T>(x: T) where T: Clone { }", "const X: [u8; 2] = [1, 2]; static mut Y: i32 = 0;", "x = y || z; x = a | b & c;", "if a == B::C { }", "let f: fn(i32) -> i32 = g; let h: &dyn Fn(&str) -> bool = &k;", "let x = loop { break; };", "let a = b as *const u8 as usize;", "macro_rules! m { ($x:expr) => { $x }; }", "f(|| {}, x)", "let _ = match x { A => B { c: 1 }, D => E };"]),
        (MEMBER, ["pub(crate) async fn f<'a, T: Clone + 'a>(&'a self, mut x: T) -> Result<T, Box<dyn Error + Send>> where T: Debug { todo!() }", "const N: usize = 1;", "type A = B;", "unsafe extern \"C\" fn g() { }", "fn h(self: &Self, _: i32) { }", "fn k(&mut self) { }"]),
        (TOP, ["use a::{self, b::*, c as d}; pub use crate::e;", "#![allow(x)]\n#[derive(Debug, Clone)]\npub struct A<'a, const N: usize = 3>(pub &'a str, [u8; N]);", "enum E { A, B(i32, String), C { x: u8 }, D = 3 }", "impl<'a, T> Tr<T> for A<'a, T> where T: ?Sized { }", "pub trait T: A + B { type X: C; const Y: i32 = 1; fn f(&self) -> Self::X; fn g() { } }", "mod a { pub mod b; }", "extern \"C\" { fn f(x: *const u8); }", "static X: &[&str] = &[\"a\"];", "struct U;", "type F<T> = Box<dyn Fn(T) -> Result<(), E>>;", "thread_local! { static A: i32 = 1; }", "union U2 { a: i32 }", "impl !Send for A { }", "fn f(x: impl Into<String>) -> impl Iterator<Item = u8> + '_ { x }", "#[test]\nfn t() { assert_eq!(1, 1); }"]),
    ],
    "kotlin": [
        (BODY, ["val (a, _) = b", "x?.y?.let { it + 1 } ?: return", "val f: (Int, String) -> Unit = { a, b -> println(a) }", "when { x > 1 -> a(); else -> { } }", "when (val z = g()) { is A -> 1; in 1..3, !in xs -> 2; else -> 3 }", "for ((i, x) in xs.withIndex()) { }", "for (i in 10 downTo 1 step 2) println(i)", "val s = \"a$b ${c.d { \"e\" }} f\"", "val t = \"\"\"raw ${x} \"q\" \"\"\"", "val o = object : A(), B { override fun f() = 1 }", "try { a() } catch (e: E) { } finally { }", "val r = if (a) 1 else 2", "if (a) b() else if (c) d() else { }", "return@forEach", "run label@{ return@label }", "x as? String", "a !is B && c !in d", "val g = A::b; val h = ::c; val k = String::class.java", "xs.map { (a, b) -> a to b }.filter { it.x }\n  .sumOf { it.y }", "var i = 0; i++; i += 2", "do { } while (x)", "outer@ for (x in y) { break@outer }", "val lazyV by lazy { 1 }", "fun local(x: Int) = x * 2", "listOf<Map<String, List<Int>>>()", "x = y ?: throw E()", "a.b[1] = c", "val n = x!!.y!!", "f(a = 1, *xs) { }", "val c = 'x'; val l = 1_000L; val d = 1.5e3f; val u = 0xFFu", "val e = fun(x: Int): Int { return x }", "while (i < 3) i++", "a\n  && b", "if (x < y && z > w) { }", "val q = a < b", "@Suppress(\"x\") val z = 1", "x shl 2 and 3", "println(if (a) { 1 } else { 2 })"]),
        (MEMBER, ["val a: Int get() = 1", "var b: Int = 1\n  private set", "var c: String\n  get() { return \"\" }\n  set(v) { field = v }", "init { }", "constructor(x: Int) : this(x, 1) { }", "companion object { const val X = 1 }", "override suspend fun <T : Any> f(x: T, y: Int = 1, vararg z: String): List<T> where T : B = listOf()", "fun String.ext() = length", "operator fun plus(o: A): A = this", "lateinit var d: String", "inner class I", "private val e by lazy { 1 }", "fun interface F { fun g() }", "abstract fun h()", "val <T> List<T>.p: Int get() = 1", "enum class E(val x: Int) { A(1) { override fun y() = 1 }, B(2); abstract fun y(): Int }"]),
        (TOP, ["@file:JvmName(\"X\")\npackage a.b\nimport c.d as e\nimport f.*\n", "data class P<out T : Any>(val a: T, private var b: Int = 1) : Q(a), R by s", "sealed interface S\nobject O : S\nannotation class N(val x: Int)\ntypealias T = (Int) -> Unit\nconst val X = 1\nval y get() = 1", "internal inline fun <reified T> f(noinline x: () -> T): T = x()", "class A @Inject constructor(val b: B)", "fun <T> T.also2(f: (T) -> Unit): T { f(this); return this }", "class B private constructor()", "fun f(x: suspend CoroutineScope.() -> Unit) { }"]),
    ],
    "swift": [
        (BODY, ["guard let a = b, case .c(let d) = e, f > 1 else { return }", "if let x, let y = z as? A { }", "let f: (Int, String) -> Void = { a, b in print(a) }", "xs.map { $0 + 1 }.filter { $0 > 2 }\n  .reduce(0, +)", "switch x { case .a, .b(let c) where c > 1: f(); case 1...3: g(); case let (p, q): h(); case is A: i(); default: break }", "for (i, x) in xs.enumerated() where x > 1 { }", "for case let .some(x) in ys { }", "let s = \"a\\(b + \"c\") \\(x ? 1 : 2)\"", "let t = \"\"\"\n  a \"b\" \\(c)\n  \"\"\"", "let r = #\"raw \\ \"q\" \"#", "do { try f() } catch let e as E { } catch { }", "let v = try? f(); let w = try! g()", "x = a ? b : c; y = z ?? w", "let d: [String: [Int]] = [:]; let e = [1: \"a\", 2: \"b\"]", "let k = \\A.b.c", "await f(); async let g = h()", "repeat { } while x", "defer { f() }", "outer: for x in y { break outer }", "func local<T: A>(_ x: T) -> T where T: B { x }", "let c = a as! B; let i = x is Y", "f(a: 1, b: &c) { d in } e: { }", "let o = a?.b?.c?[0]", "x += 1; y &= ~z; p = q << 2", "let u = -1; let n = !a; let m = 0x1F; let h = 1_000.5e3", "if #available(iOS 13, *) { }", "let (a, b) = (1, 2)", "return", "let p = (x: 1, y: 2).x", "var z: Int { 1 }", "let g = { (a: Int) -> Int in a }", "let q = { [weak self] in self?.f() }", "if a < b, c > d { }", "let arr = [Int](); let dict = [String: Int]()", "if case .a = b { }", "let x = if a { 1 } else { 2 }", "a = b...c; d = e..<f; g = h[1...]", "while let x = it.next() { }", "let l = self.a.b\n  .c", "fallthrough_()"]),
        (MEMBER, ["private(set) var a: Int = 1", "lazy var b: String = { \"x\" }()", "var c: Int { get { 1 } set { d = newValue } }", "var e: Int = 0 { didSet { f() } }", "static let shared = A()", "init?(a: Int) throws { }", "convenience init() { self.init(a: 1) }", "deinit { }", "@objc func f(_ a: Int, with b: String? = nil, rest: Int...) async throws -> [Int] { [] }", "subscript(i: Int) -> Int { 1 }", "override class func g() { }", "static func == (l: A, r: A) -> Bool { true }", "typealias T = (Int) -> Void", "enum E: String, CaseIterable { case a = \"x\", b; indirect case c(Int, d: E) }", "@Published var h: [String: Int] = [:]", "func k<T>(_ x: T) -> some View where T: P { x }", "weak var w: B?", "required init(from d: Decoder) throws { }", "let cb: ((Int) -> Void)?"]),
        (TOP, ["import Foundation\n@main\nstruct A<T: B>: C, D where T: E { }", "protocol P: AnyObject { associatedtype T: Q; var a: Int { get set }; func f() -> T; init(); static var b: Int { get } }", "extension A: B where T == Int { }", "#if DEBUG\nlet x = 1\n#else\nlet x = 2\n#endif", "infix operator +++: AdditionPrecedence", "actor Z { nonisolated func f() { } }", "public final class K<V>: L<V>.M { }", "let a = 1, b = 2\nprint(a)", "func +++ (l: Int, r: Int) -> Int { l }"]),
    ],
}


@pytest.mark.parametrize("language", list(BROKEN))
def test_one_error_is_found(language):
    cases = [(frame[language].format(x), x) for frame, xs in BROKEN[language] for x in xs]
    assert len(cases) >= 40
    wrong = [x for text, x in cases if parses(text, language)]
    assert len(wrong) <= 0.02 * len(cases), wrong


@pytest.mark.parametrize("language", list(GOOD))
def test_no_valid_text_is_lost(language):
    wrong = [x for frame, xs in GOOD[language] for x in xs if not parses(frame[language].format(x), language)]
    assert not wrong, wrong


@pytest.mark.parametrize("language", list(GOOD))
def test_valid_pieces_together(language):
    for frame, xs in GOOD[language]:
        if frame is BODY:
            assert parses(frame[language].format("\n".join(f"if (x) {{\n{x}\n}}" if language not in ("go", "rust", "swift") else x + ";" * (language == "rust") for x in xs if "case" not in x or language != "c")), language)
