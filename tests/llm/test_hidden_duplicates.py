import datetime as dt
import random

import pytest
from hypothesis import given
from hypothesis import strategies as st

from graphloom.llm import hidden_duplicates as hd
from graphloom.llm.hidden_duplicates import canonical_signature as canon

SAME = [
    ("def f(a: Dict[str, int], b=(1,2)) -> int:", "def  F(b=(1,2), a: Dict[str,int],)->int"),
    ("func Fetch(seed string,\n    p string,) int", "func Fetch(p string, seed string) int"),
    ('f(offset: str = "x, y", b)', '`f(b,offset: str = "x, y")`.'),
    ("f(,)", "f-(  )"), ("f()", "f"), ("has_field()", "has-field ();"),
    ("f(Map<String, Integer> a, int b)", "f(int b, Map<String, Integer> a)"),
    ("f(cb: (a: number, b: string) => void, x)", "f(x, cb: (a: number, b: string) => void)"),
    ("f(d, a = b < c)", "f(a = b < c, d)"), ("(r *T) f(a, b)", "(r *T) f(b, a)"),
]
OTHER = [("f(a: str, b: int)", "f(a: int, b: str)"), ("f1(a)", "f2(a)"), ("f(a)", "f(a, b)"), ("f(Map<A, B> x)", "f(Map<B, A> x)"), ("f(g(a, b))", "f(g(b, a))"), ("f(a)(b)", "f(b)(a)")]


@pytest.mark.parametrize("a,b", SAME)
def test_same(a, b):
    assert canon(a) == canon(b)


@pytest.mark.parametrize("a,b", OTHER)
def test_other(a, b):
    assert canon(a) != canon(b)


@given(st.lists(st.text("abcXY12", min_size=1, max_size=5), max_size=6), st.randoms())
def test_order_of_parameters_never_counts(parameters, r):
    mixed = list(parameters)
    r.shuffle(mixed)
    assert canon(f"fn x({', '.join(parameters)})") == canon(f"FN  x( {' ,'.join(mixed)},);")


@given(st.text(max_size=60))
def test_any_text_has_a_key(text):
    assert canon(text) == canon(text.upper().lower()) or text.upper().lower() != text.lower()


def frame(spark, data):
    return spark.createDataFrame(data, "load_seq bigint, repo_id string, language string, signature string, loaded_at timestamp, copy_key string")


def brute(data):
    groups = {}
    for seq, repo, lang, sig, *_ in data:
        if sig is not None and seq is not None:
            groups.setdefault((repo, lang, canon(sig)), []).append(seq)
    return sorted((min(g), s) for g in groups.values() for s in g if s != min(g))


def test_found_matches_brute_force_with_a_hot_group(spark, rows):
    r = random.Random(3)
    data = []
    for k in range(3000):
        hot = k % 3 == 0
        a, b = ("a", "b") if r.random() < 0.5 else ("b", "a")
        sig = r.choice([f"f({a}, {b})", f" F( {a},{b} );"]) if hot else f"g{r.randrange(900)}({a},{b})"
        data.append((k, None if r.random() < 0.1 else "r", r.choice(["go", None]), None if r.random() < 0.05 else sig, dt.datetime(2031, 1, 1 + r.randrange(28)), "clash"))
    r.shuffle(data)
    assert rows(hd.hidden_duplicates(frame(spark, data))) == sorted(brute(data), key=repr)


def test_incremental_equals_whole(spark, rows):
    data = [(k, "r", "go", f"f{k % 7}(a)", None, "x") for k in range(50)]
    whole = hd.update_ledger(None, hd.keyed(frame(spark, data)))
    ledger = hd.empty_ledger(spark)
    for part in (data[30:], data[:10], data[10:30]):
        ledger = hd.update_ledger(ledger, hd.keyed(frame(spark, part)))
    assert rows(ledger) == rows(whole) and whole.count() == 7


def test_stored_ledger(spark, rows, tmp_path):
    import os
    import shutil

    data = [(k, "r", "go", f"f{k % 7}(a)", None, "x") for k in range(50)]
    path = str(tmp_path / "ledger")
    stored = hd.StoredLedger(spark, path)
    assert rows(stored.read()) == [] and stored.versions() == []
    for k, part in enumerate((data[30:], data[:10], data[10:30])):
        assert stored.add(hd.keyed(frame(spark, part)), f"b{k}")
    whole = hd.update_ledger(None, hd.keyed(frame(spark, data)))
    assert rows(stored.read()) == rows(whole)
    # a batch told twice counts once
    assert not stored.add(hd.keyed(frame(spark, data[10:30])), "b2") and rows(stored.read()) == rows(whole)
    # only the buckets of a batch are written, one file each
    assert stored.add(hd.keyed(frame(spark, data[:1])), "b3")
    written = [d for d in os.listdir(f"{path}/data/version=4") if d.startswith("bucket=")]
    assert len(written) == 1 and len([f for f in os.listdir(f"{path}/data/version=4/{written[0]}") if f.endswith(".parquet")]) == 1
    # an update that broke off before its manifest was whole does not count, and can be repeated
    shutil.copytree(f"{path}/data/version=4", f"{path}/data/version=5")
    os.makedirs(f"{path}/manifest/version=5/_temporary")
    after = rows(stored.read())
    assert stored.versions() == [1, 2, 3, 4] and sum(r[2] for r in after) == 51
    assert stored.add(hd.keyed(frame(spark, data[1:2])), "b4") and sum(r[2] for r in rows(stored.read())) == 52
    stored.expire()
    assert stored.versions() == [4, 5] and sum(r[2] for r in rows(stored.read())) == 52
    assert stored.add(hd.keyed(frame(spark, data).limit(0)), "b5") and sum(r[2] for r in rows(stored.read())) == 52
    # anything but a missing ledger is an error
    shutil.rmtree(f"{path}/data/version=5")
    with pytest.raises(Exception):
        stored.read().collect()


def test_only_named_buckets_meet_the_batch(spark, rows):
    data = [(k, "r", "go", f"f{k}(a)", None, "x") for k in range(40)]
    ledger = hd.update_ledger(None, hd.keyed(frame(spark, data)))
    more = hd.update_ledger(ledger, hd.keyed(frame(spark, data[:1])))
    assert {r.n_copies for r in more.collect()} == {1, 2} and more.count() == 40


def test_empty(spark, rows):
    assert rows(hd.hidden_duplicates(frame(spark, []))) == []
    assert rows(hd.deduplicated(frame(spark, [(1, "r", "go", None, None, "")]))) == []
