import pytest
from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F

from graphloom.functions import paths as p
from graphloom.functions.signatures import body_digest, node_key, normal_signature, normalize_signature

SIGNATURES = [
    ("def authenticate(self, user, password) -> bool:", "python", "authenticate(user,password)"), ("async def fetch(url: str, *, timeout: float = 5.0)", "python", "fetch(url,timeout)"), ("def handler(*args, **kwargs)", "python", "handler(args,kwargs)"),
    ("build(x: Dict[str, int], y=[1, 2, 3])", "python", "build(x,y)"), ("g(a, b, /, c, *, d)", "python", "g(a,b,c,d)"), ("class UserService(BaseService):", "python", "UserService(BaseService)"), ("  authenticate ", "python", "authenticate"),
    ("public static <T> java.util.List<T> of(final java.util.Map<K, V> m, int... xs)", "java", "of(Map,int[])"), ("pub fn f(&mut self, a: i32) -> i32", "rust", "f(a)"), ("export default function run(x?: number)", "typescript", "run(x)"), ("func Add(a int, b int) int", "go", "Add(a,b)"),
]


@pytest.mark.parametrize("raw,language,want", SIGNATURES)
def test_normal_signature(raw, language, want):
    assert normal_signature(raw, language) == want


@given(st.text("ab (,:)=*[]", max_size=30))
def test_normal_form_is_stable(text):
    once = normal_signature("f(" + text)
    assert normal_signature(once) == once or "*" in once or "[" in once or "(" in once[2:]


@given(st.text(min_size=1), st.text(min_size=1))
def test_ids(a, b):
    assert len(node_key(a, b, "symbol")) == 32 and node_key(a, b, "symbol") != node_key(a, b, "module") and node_key(a, b, "symbol") != node_key(a + "x", b, "symbol")


def test_ids_need_names():
    with pytest.raises(ValueError):
        node_key("", "q", "symbol")


def test_body_digest():
    assert body_digest("a  b\n") == body_digest(" a b") and body_digest(" \n") is None


def test_columns(spark, rows):
    df = spark.createDataFrame([("def f(a)", None), (None, "go")], "s string, l string")
    assert rows(df.select(normalize_signature("s", "l"))) == [("f(a)",), (None,)]


def values(spark, fn, *args):
    df = spark.createDataFrame([tuple(a) if isinstance(a, tuple) else (a,) for a in args], ["a", "b"][: len(args[0]) if isinstance(args[0], tuple) else 1])
    return [r[0] for r in df.select(fn(*[F.col(c) for c in df.columns])).collect()]


def test_paths(spark):
    assert values(spark, p.posix, "./a\\b.py", "a/b") == ["a/b.py", "a/b"]
    assert values(spark, p.language_of, "a.py", "b.TSX", "c.h", "d.hpp", "e.txt") == ["python", "typescript", "c", "cpp", None]
    assert values(spark, p.module_qname, ("a/b/__init__.py", "python"), ("a/B.java", "java"), ("src/lib.rs", "rust"), ("a/index.ts", "typescript"), ("x.go", "go")) == ["a.b", "a", "crate.src", "a", ""]
    assert values(spark, p.module_name_for, "src/a/b.py", "a/__init__.py", "__init__.py") == ["a.b", "a", ""]
    assert values(spark, p.family_of, "r/tests/a.py", "<externals>", "r/x/test_a.py", "r/.github/a.py", "r/docs/a.py", "r/tools/a.py", "r/setup.py", "r/a.py") == ["tests", "external", "tests", "ci", "docs", "scripts", "ci", "core"]


def test_four_notions_of_a_test(spark):
    units = ("tests/a.py", "a/test.py", "a/FooTest.java", "a/fixtures/test_a.py", "a/Foo.spec.ts", "a/conftest.py", "a/x_test.go")
    assert values(spark, p.is_test_unit, *units) == [True, False, True, True, True, True, True]
    assert values(spark, p.is_test_path_dead_code, *units) == [False, False, False, True, True, True, True]
    assert values(spark, p.is_test_path_commit, *units) == [True, False, False, False, False, False, False]


def test_routes(spark):
    assert values(spark, p.nextjs_pattern, "app/(shop)/items/[id]/page.tsx", "app/page.tsx", "app/x.tsx", "pages/index.tsx", "pages/a/[[...slug]].tsx", "lib/a.ts") == ["/items/:id", "/", None, "/", "/a/:slug", None]
    assert values(spark, p.join_route, ("/a", "b"), ("/a/", ""), (None, ""), (None, "x"), ("/a", "/c"), ("/a", "b/*")) == ["/a/b", "/a/", "/", None, "/c", None]
    assert values(spark, p.href_matches, ("/a/1", "/a/:id"), ("/a/1/", "/a/:id"), ("/a", "/a/:id"), ("/b/1", "/a/:id")) == [True, True, False, False]
    assert values(spark, p.fragment_pairs, "/x#a=1&b=2&a=3&junk&=z", "/x") == [{"b": "2", "a": "3"}, {}]
    assert values(spark, p.url_params, "/a/:id/b/:x#/:y", "/a:b") == [2, 0]
    assert values(spark, p.state_id, "/", "/items/:id") == ["root", "items.id"]


def test_lint(spark):
    assert values(spark, p.lint_check, "true", "pytest -q", "pytest || true", "pytest -q && echo ok", "x == 1 or x != 2") == [["cannot fail"], ["silent on failure"], ["cannot fail", "tautology"], [], ["tautology"]]
