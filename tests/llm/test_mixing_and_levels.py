import random
from collections import Counter

import numpy as np
import pytest

from graphloom.llm import mixing as mx
from graphloom.llm import prose
from graphloom.llm import reading_level as rl
from graphloom.llm.tokenizer import TOKENIZERS

TARGETS = "mix_name string, source string, target_share double, max_repeats int, total_ratio double"


def test_permutations_are_bijections():
    for n in (1, 2, 3, 17, 64, 1000):
        for key in (0, 5, -7):
            got = mx.permuted(np.arange(n), np.full(n, n), np.full(n, key, np.int64))
            assert sorted(got.tolist()) == list(range(n))
    a, b = (mx.permuted(np.arange(500), np.full(500, 500), np.full(500, k, np.int64)).tolist() for k in (1, 2))
    assert a != b


def test_draws_have_exact_totals_at_any_size():
    rng = np.random.default_rng(1)
    for k in range(200):
        totals = rng.integers(0, 50 if k < 190 else 10**13, 4)
        d = mx.dealt(rng, totals, 8)
        assert (d.sum(0) == totals).all() and (d >= 0).all() and d.sum(1).max() - d.sum(1).min() <= 1
    shares = np.mean([mx.dealt(rng, np.array([600, 300, 100]), 10) for _ in range(300)], 0)
    assert np.abs(shares - [60, 30, 10]).max() < 2
    spread = np.var([mx.dealt(rng, np.array([500, 500]), 10)[0, 0] for _ in range(2000)])
    assert 18 < spread < 32  # a multinomial draw's, 25, and not that of rounded shares


def test_blocks_have_one_length(spark, rows):
    data = [(k, "a" if k % 4 else "b", 1 + k * 37 % 700) for k in range(200)]
    pieces = mx.pack(docs(spark, data), 200, 64).collect()
    for source in "ab":
        size = sum(n for _, s, n in data if s == source)
        filled = {}
        for p in pieces:
            if p.source == source:
                filled[p.block] = filled.get(p.block, 0) + p.n_tokens
        assert sorted(filled) == list(range(-(-size // 64)))
        assert [filled[k] for k in sorted(filled)][:-1] == [64] * (len(filled) - 1) and sum(filled.values()) == size
    for k, _, n in data:
        own = sorted((p.first_token, p.n_tokens) for p in pieces if p.doc_id == k)
        assert own[0][0] == 0 and all(a + b == c for (a, b), (c, _) in zip(own, own[1:], strict=False)) and sum(x for _, x in own) == n


def docs(spark, rows):
    return spark.createDataFrame([(*r, 7) for r in rows], "doc_id bigint, source string, n_tokens bigint, n_uses int")


def test_prefix_sums(spark):
    r = random.Random(2)
    data = [(k % 3, k // 40, k, r.randrange(9)) for k in range(300)]
    df = spark.createDataFrame(data, "g int, bucket int, pos int, v int")
    got = {(x.g, x.pos): x.s for x in mx.prefix_sums(df, ["g"], "bucket", ["pos"], "v", "s").collect()}
    for g in range(3):
        total = 0
        for _, _, pos, v in sorted((d for d in data if d[0] == g), key=lambda d: (d[1], d[2])):
            assert got[g, pos] == total
            total += v


def test_mix_reaches_its_shares(spark, rows):
    r = random.Random(3)
    data = [(k, "big" if k % 3 else "small", r.randrange(1, 900)) for k in range(600)] + [(600, "tiny", 40), (601, None, 5000), (602, "big", 0), (603, "long", 90_000)]
    t = [("m", "big", 0.5, 1, 0.8), ("m", "small", 0.4, 3, 0.8), ("m", "tiny", 0.1, 2, 0.8), ("m", "absent", 0.1, 9, 0.8), ("n", "small", 1.0, 1, 0.1), ("n", None, 1.0, 1, 0.1), ("z", "big", 0.0, 1, 1.0), ("l", "long", 1.0, 5, 2.0)]
    mix = mx.Mix(docs(spark, data), spark.createDataFrame(t, TARGETS))
    total = sum(x[2] for x in data)
    have = {}
    for _, s, n in data:
        have[s] = have.get(s, 0) + n
    size = {k: n for k, _, n in data}
    uses = mix.documents().collect()
    assert len({(u.mix_name, u.doc_id) for u in uses}) == len(uses)
    shares = {(x.mix_name, x.source): x for x in mix.shares().collect()}
    for name, source, share, cap, ratio in t:
        if source is None:
            continue
        own = [u for u in uses if (u.mix_name, u.source) == (name, source)]
        assert all(1 <= u.n_uses <= cap and data[u.doc_id][1] == source and u.used_tokens <= u.n_uses * size[u.doc_id] for u in own)
        reached = sum(u.used_tokens for u in own)
        want = min(round(share * ratio * total), cap * have.get(source, 0))
        assert abs(reached - want) <= 1.5 * mx.BLOCK_TOKENS, (name, source, reached, want)
        assert shares[name, source].reached_tokens == reached
    assert shares["m", "absent"].reached_tokens == 0 and abs(sum(x.reached_share for k, x in shares.items() if k[0] == "m") - 1) < 1e-9
    placed = mix.shards().collect()
    assert {p.shard for p in placed} == set(range(mx.SHARDS))
    used = {}
    for p in placed:
        used[p.mix_name, p.doc_id] = used.get((p.mix_name, p.doc_id), 0) + p.n_tokens
    assert used == {(u.mix_name, u.doc_id): u.used_tokens for u in uses}
    again = mx.Mix(docs(spark, data[::-1]), spark.createDataFrame(t, TARGETS))
    assert rows(again.documents()) == rows(mix.documents())


def test_empty_mixes(spark):
    t = spark.createDataFrame([("m", "a", 1.0, 1, 1.0)], TARGETS)
    empty = mx.Mix(docs(spark, []), t)
    assert empty.documents().count() == 0 and empty.shards().count() == 0 and empty.shares().first().reached_share == 0.0
    assert mx.Mix(docs(spark, [(1, "a", 5)]), t.limit(0)).documents().count() == 0


def test_sizes(spark, rows):
    d = spark.createDataFrame([(1, "a", "It's"), (2, None, None), (3, "a", "")], "doc_id bigint, source string, text string")
    assert rows(mx.sized(d, TOKENIZERS)) == [(1, "a", 2), (2, None, 0), (3, "a", 0)]


# ---------------------------------------------------------------- reading level

EASY = "Each tree has a spot. Do not keep it yet. You can see the red door. It is a big file. "
HARD = "Notwithstanding the conservative congruence established in the preceding section, the monotonicity of the underlying lattice precludes an asymptotic fixpoint formulation, whose parametricity is invariant under arbitrary permutations of the dependence relation. "
GERMAN = "Danach wird der Graph neu aufgebaut und geprüft. Bitte führen Sie den Befehl noch einmal aus, wenn das Modul fehlt und nicht gelesen wird. " * 4
CODE = "import os\n\ndef f(a: int) -> int:\n    # keep the order of what is read in the file\n    x = a + 1\n    if x > 3:\n        x = x - 1\n    return x\n" * 4


def words(text):
    return prose.words_and_sentences(prose.strip_markup(prose.unfenced(text)))[0]


def test_markup_is_no_prose():
    text = "# A heading here\n\nSee [the page](http://x.y/z) and `some code` **now**.\n\n```py\ncode = 1\n```\n\n| a | b |\n|---|---|\n| c | d |\n\n- one item\n1. two items\n\n    indented code\n\n<b>bold</b> https://a.b/c\n2031-01-01T00:00:00Z INFO x=1\n"
    assert words(text) == "see the page and now one item two items bold".split()


def test_sentences():
    text = "We use it (e.g. here) cf. Fig. 4 of v2.1. Then stop! Is it done? yes"
    assert prose.words_and_sentences(text) == ("we use it cf fig of v then stop is it done yes".split(), 4)
    assert prose.words_and_sentences(text.replace("done", "doné")) == ("we use it cf fig of v then stop is it doné yes".split(), 4)
    assert prose.words_and_sentences("") == ([], 0) and prose.words_and_sentences("...\n\n!!!") == ([], 0)
    assert prose.words_and_sentences("It isn't a one-off…\n\n- and so\n\nNo.") == ("it isn't a one-off and so no".split(), 3)


@pytest.mark.parametrize("text,ok", [(EASY * 4, True), (HARD * 3, True), (GERMAN, False), (CODE, False), ("", False), (None, False), (EASY, False), ("日本語の文章です。" * 30, False), ("Herein stratification precludes asymptotic bisimilarity. Flow-insensitive canonicalisation presupposes totality. " * 8, True), ("2031-01-01T00:00:00Z INFO phase=a unit=b\n" * 30, False), ("```\n" + CODE + "```\n\n" + EASY * 3, True), ("x" * 200_000, False), (EASY * 3000, True)])
def test_what_has_a_level(text, ok):
    assert (prose.prose_counts(text, 40) is not None) == ok


def test_long_lines_count_as_what_they_are():
    log = "2031-01-01T00:00:00Z INFO phase=a " + "unit of the store is read and then it is written to the file " * 60 + "n=1\n"
    code = 'function store(a){if(a.is)return the.of(a,"in that order of the file");for(var to=0;to<a.length;to++)and(a[to]);return{not:a,it:1};}' * 40 + "\n"
    assert len(log) > 3000 and prose.prose_counts(log * 3, 40) is None and prose.prose_counts(log, 40) is None
    assert len(code) > 3000 and prose.prose_counts(code, 40) is None and prose.prose_counts(code * 3, 40) is None
    prose_line = EASY * 60
    assert len(prose_line) > 3000 and prose.prose_counts(prose_line, 40)[1] == 240


def test_levels(spark, rows):
    r = random.Random(5)

    def passage(level):
        return " ".join(r.choice([EASY, "The tree is red. "]) if level == 1 or level == 2 and r.random() < 0.5 else HARD for _ in range(6 if level < 3 else 3))

    data = [(k, passage(1 + 3 * (k % 2)), 1 + 3 * (k % 2)) for k in range(40)] + [(98, None, 3), (99, "x", None)]
    p = spark.createDataFrame([(*d, "c") for d in data], "passage_id bigint, text string, read_level int, words string")
    d = spark.createDataFrame([(1, EASY * 5, "s", "c"), (2, HARD * 4, "s", "c"), (3, GERMAN, None, "c"), (4, None, "s", "c"), (5, "", "s", "c"), (6, EASY * 5, "s", "c")], "doc_id bigint, text string, source string, counts string")
    assert rows(rl.reading_levels(d, p)) == [(1, 1), (2, 4), (6, 1)]
    assert rows(rl.level_profile(d, p)) == [("s", 1, 2), ("s", 4, 1)]
    assert rl.reading_levels(d.limit(0), p).count() == 0 and rl.reading_levels(d, p.limit(0)).count() == 0


def test_held_out_passages_of_the_project(spark):
    """Accuracy on passages that took no part in the fit."""
    d = "/root/testdata/sf0.01"
    counts = rl.prose_counts(spark.read.parquet(f"{d}/documents.parquet"))
    rank = {w: k for k, w in enumerate(rl.familiar_words(counts))}
    counted = ((Counter(w), n, x.read_level) for x in spark.read.parquet(f"{d}/level_passages.parquet").collect() for w, n in [prose.words_and_sentences(prose.strip_markup(prose.unfenced(x.text)))])
    known = [(rl.features(list(c), list(c.values()), n, rank), level) for c, n, level in counted if n]
    x, y = np.array([a for a, _ in known]), np.array([b for _, b in known])
    order = np.random.default_rng(0).permutation(len(y))
    right = sum((rl.Model(x[np.setdiff1d(order, fold)], y[np.setdiff1d(order, fold)]).predict(x[fold]) == y[fold]).sum() for fold in np.array_split(order, 5))
    assert right / len(y) >= 0.95


def test_wrapped_prose_is_no_code():
    wrapped = "You may open it\nfrom the menu, or with a short command. Choose the\npackage that you want to change. The\nnamespace can be computed lazily, and the unit -> module map is kept;\nif the following hold:\nuse it yet. Save the\npackage.\n"
    assert words(wrapped) == prose._WORD.findall(wrapped.lower())
    code = "package main\n\nimport os\nimport sys\nfrom a.b import c\nimport \"fmt\"\n\nreturn x\nx = a + 1\nif not done:\n    return the_value;\n"
    assert words(code) == []
    assert words("Run it\nfrom the shell:\n$ make all\n") == "run it from the shell".split()
    assert words("- import files\n- export files\n") == "import files export files".split()
    assert prose.prose_counts(wrapped * 3, 40) is not None and prose.is_source(code * 3)
