"""Reading level by a familiar-word formula.

A word is familiar when it is among the n commonest by document frequency over all English prose of the corpus. The
shares of unfamiliar words for several n and the average sentence length place a document between the levels of
passages whose level is known; weights and centres are fitted on those passages.
"""

from __future__ import annotations

from array import array
from collections import Counter

import numpy as np
import pandas as pd
from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.llm.prose import prose_counts as counted
from graphloom.llm.prose import strip_markup, unfenced, words_and_sentences
from graphloom.runtime import held

#: Sizes of the lists of familiar words; the greatest bounds what the driver holds of the corpus.
LIST_SIZES = (60, 120, 180, 240, 300, 360, 420)
LEAST_WORDS = 40
#: The fit uses at most so many passages, those with the smallest ids.
MAX_PASSAGES = 10_000
RIDGE = 1e-2


def prose_counts(documents: DataFrame, least: int = LEAST_WORDS) -> DataFrame:
    """doc_id, distinct words (between blanks), their counts (32 bits each) and the number of sentences, of each document
    with enough English prose. One text and one run of bytes a document take a fraction of what arrays of both take."""

    @F.pandas_udf("words string, counts binary, n_sentences int")
    def run(text: pd.Series) -> pd.DataFrame:
        words, counts, n_sentences = [], [], []
        for t in text:  # one document's counts at a time are held as objects
            found = counted(t, least)
            words.append(" ".join(found[0]) if found else None)
            counts.append(array("I", found[0].values()).tobytes() if found else None)
            n_sentences.append(found[1] if found else 0)
        return pd.DataFrame({"words": words, "counts": counts, "n_sentences": n_sentences})

    # marked so that the planner does not evaluate it again for the filter
    run = run.asNondeterministic()
    return documents.select("doc_id", run("text").alias("p")).filter("p.n_sentences > 0").select("doc_id", "p.*")


def familiar_words(counts: DataFrame, size: int = LIST_SIZES[-1]) -> list[str]:
    """The commonest words by document frequency, the commonest first, ties in alphabetical order: at most `size`."""
    df = counts.select(F.explode(F.split("words", " ")).alias("word")).groupBy("word").agg(F.count("*").alias("n"))
    return [r.word for r in df.orderBy(F.desc("n"), "word").limit(size).collect()]


def _numbers(data: bytes) -> np.ndarray:
    return np.frombuffer(data, np.uintc)


def features(words, counts, n_sentences: int, rank: dict[str, int], sizes=LIST_SIZES) -> list[float]:
    """The share of unfamiliar words for each list size, and the logarithm of the mean length of sentences."""
    n = np.asarray(counts, float)
    total = n.sum()
    known = [(k, c) for k, c in zip(map(rank.get, words), n, strict=True) if k is not None]
    within = np.bincount(np.searchsorted(sizes, [k for k, _ in known], side="right"), [c for _, c in known], len(sizes) + 1)
    return [*(1 - np.cumsum(within)[: len(sizes)] / total), np.log(total / n_sentences)]


class Model:
    """Linear discriminants with a shared, ridged covariance."""

    def __init__(self, x: np.ndarray, y: np.ndarray):
        self.levels = np.unique(y)
        self.mean, self.spread = x.mean(0), x.std(0) + 1e-9
        z = (x - self.mean) / self.spread
        self.centres = np.array([z[y == k].mean(0) for k in self.levels])
        within = z - self.centres[np.searchsorted(self.levels, y)]
        cov = within.T @ within / max(1, len(y) - len(self.levels)) + RIDGE * np.eye(x.shape[1])
        self.inverse = np.linalg.inv(cov)

    def predict(self, x: np.ndarray) -> np.ndarray:
        z = (x - self.mean) / self.spread
        d = z[:, None, :] - self.centres[None]
        return self.levels[np.einsum("nkf,fg,nkg->nk", d, self.inverse, d).argmin(1)]


def fit(passages: DataFrame, rank: dict[str, int], limit: int = MAX_PASSAGES) -> Model | None:
    """The model of the passages with prose and a level; None if there are none. Of repeated passages each counts."""
    rows = passages.filter(F.col("text").isNotNull() & F.col("read_level").isNotNull()).orderBy("passage_id").limit(limit).select("text", "read_level").collect()
    counts = ((Counter(words), n, r.read_level) for r in rows for words, n in [words_and_sentences(strip_markup(unfenced(r.text)))] if n)
    known = [(features(list(c), list(c.values()), n, rank), level) for c, n, level in counts]
    return Model(np.array([x for x, _ in known]), np.array([y for _, y in known])) if known else None


def reading_levels(documents: DataFrame, passages: DataFrame) -> DataFrame:
    """doc_id, read_level of each document with at least 40 words of English prose.

    Null, empty and foreign texts, logs and source files give no row; whole texts count, however long. Without passages
    there is no scale and the result is empty.
    """
    counts = prose_counts(documents).persist(StorageLevel.MEMORY_AND_DISK)
    rank = {w: k for k, w in enumerate(familiar_words(counts))}
    model = fit(passages, rank)

    @F.pandas_udf("int")
    def level(words: pd.Series, n: pd.Series, n_sentences: pd.Series) -> pd.Series:
        if not len(words):
            return pd.Series([], dtype="int32")
        x = np.array([features(a, b, c, rank) for a, b, c in zip(words.str.split(" "), map(_numbers, n), n_sentences, strict=True)])
        return pd.Series(model.predict(x).astype("int32"))

    if model is None:
        counts.unpersist()
        return counts.limit(0).select("doc_id", F.lit(None).cast("int").alias("read_level"))
    return held(counts.select("doc_id", level("words", "counts", "n_sentences").alias("read_level")), counts)


def level_profile(documents: DataFrame, passages: DataFrame) -> DataFrame:
    """Number of documents by source and level."""
    levels = reading_levels(documents, passages)
    return held(levels.join(documents.select("doc_id", "source"), "doc_id").groupBy("source", "read_level").agg(F.count("*").alias("n_documents")), levels)
