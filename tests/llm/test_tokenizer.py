import base64
import random

import numpy as np
import pytest
import tiktoken
from pyspark.sql import functions as F

from graphloom.llm import tokenizer as tk

PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


@pytest.fixture(scope="module")
def truth():
    with open(f"{tk.TOKENIZERS}/{tk.VOCABULARY}", "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def texts():
    r = random.Random(5)
    alphabet = list("abslvrdmtel'''' \n\t   09½é世界🙂_-.\x1c\x1f\x85​ Ⅷ'")
    yield from ["", " ", "\n", "'", "''s", " 's", "\n's", "don't've'll'dx", "'re'", "<|endoftext|> hi", "a" * 20000, " " * 3000 + "x", "'" * 2000, "é" * 999, "x" * 63 + "'ll" + "y" * 70]
    for _ in range(4000):
        yield "".join(r.choice(alphabet) for _ in range(r.randint(0, 40)))


def test_same_ids_as_the_public_library(truth):
    all_texts = list(texts())
    e = tk.encoder(f"{tk.TOKENIZERS}/{tk.VOCABULARY}")
    got = [e.encode(p) for b in tk._batches(all_texts, 5000) for p in tk.slices(b)]
    assert got == [truth.encode_ordinary(t) for t in all_texts]
    assert all(e.decode(ids) == t for ids, t in zip(got, all_texts, strict=True))


def test_scan_equals_a_loop():
    r = np.random.default_rng(1)
    t = tk._transitions()
    for n in (0, 1, 63, 64, 65, 1000):
        s = r.integers(0, 12, n).astype(np.uint8)
        state, want = 0, []
        for x in s:
            state = t[x, state]
            want.append(state)
        assert tk.scan(s).tolist() == want


def test_operator(spark, rows, truth):
    data = [(1, "It's <|endoftext|>"), (2, None), (3, ""), (4, "   "), (5, "übergroß 世界"), (5, "übergroß 世界")]
    df = spark.createDataFrame([(*x, "clash") for x in data], "doc_id bigint, text string, ids string")
    assert rows(tk.encode_corpus(df)) == sorted([(k, truth.encode_ordinary(t or "")) for k, t in data], key=repr)
    full = df.select("text", tk.encode_with_offsets(F.col("text")).alias("e"), tk.token_count(F.col("text")).alias("n"))
    for text, e, n in full.collect():
        raw = (text or "").encode()
        assert len(e.ids) == len(e.ends) == n and (e.ends[-1] if n else 0) == len(raw)
    back = full.select("text", tk.decoded(F.col("e.ids")).alias("back")).collect()
    assert all((text or "") == b for text, b in back)
    assert tk.encode_corpus(df.limit(0)).count() == 0
