"""Source files that do not parse, per file, with rates per repository and language.

Each text is tried against all grammars, in the order of a ranking by its tokens, the language of its path first. A text
that fails its own grammar but passes another has a wrong suffix; one that passes none is corrupt.
"""

from __future__ import annotations

import re
from collections import Counter

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.llm.grammars import LANGUAGES, SUFFIXES, language_of, normal_text, parses_normal

#: Words and signs by which a text's language is guessed; the order of the ranking decides only what is tried first.
_MARKS = {
    "python": "def self elif None True False import from pass lambda yield async",
    "typescript": "export const let function interface type readonly number string boolean => import",
    "javascript": "const let function export => require module typeof undefined === import var",
    "java": "public private protected package import final void static String class extends implements",
    "go": "func package := fmt defer chan range struct string int import",
    "rust": "fn let mut pub impl use crate -> &str match i64 :: struct",
    "csharp": "using namespace public private static string void class var internal readonly",
    "c": "#include #define static const char int void struct unsigned typedef",
    "cpp": "#include std :: const template constexpr namespace class auto vector string",
    "kotlin": "fun val var package import private internal override when Int String until",
    "swift": "func let var import -> guard struct public private Int String ..<",
}
_OF_MARK = {mark: [x for x in LANGUAGES if mark in _MARKS[x].split()] for words in _MARKS.values() for mark in words.split()}
_TOKEN = re.compile(r"#?[A-Za-z_]\w*|:=|=>|->|::|===|\.\.<|&str")


def ranked(text: str) -> list[str]:
    """All languages, the likeliest first: a mark counts once a text, the less the more languages share it."""
    score: Counter = Counter()
    for mark in set(_TOKEN.findall(text)):
        for language in _OF_MARK.get(mark, ()):
            score[language] += 1 / len(_OF_MARK[mark])
    return sorted(LANGUAGES, key=lambda x: (-score[x], x))


def accepting(path: str | None, text: str) -> list[str]:
    """All languages in which the text is valid: the path's own first, then by the ranking. Blank texts: all of them."""
    text, own = normal_text(text), language_of(path)
    if not text or text.isspace():
        return sorted(LANGUAGES, key=lambda x: (x != own, x))
    order = sorted(ranked(text), key=lambda x: x != own)
    return [x for x in order if parses_normal(text, x, x != own)]


def verdict(path: str | None, text: str | None) -> tuple[str | None, str, str | None]:
    """language of the path, verdict and the language in which the text parses, as parse_files tells them without nodes."""
    language = language_of(path)
    if text is None:
        return language, "absent", None
    found = accepting(path, text)
    if language in found:
        return language, "valid", language
    other = found[0] if found and text.strip("\ufeff \n\r\t") else None
    return language, "unknown" if language is None else "wrong_extension" if other else "corrupt", other


def _accepted():
    @F.pandas_udf("array<string>")
    def run(path: pd.Series, text: pd.Series) -> pd.Series:
        return pd.Series([None if pd.isna(t) else accepting(None if pd.isna(p) else p, t) for p, t in zip(path, text, strict=True)], dtype=object)

    return run


#: Suffixes that two languages share: which of them it is, a file's node may tell.
SHARED = r"(?i)\.h$"


def node_languages(nodes: DataFrame) -> DataFrame:
    """repo_id, unit, node_language: what the nodes of a unit say, the smallest where they disagree."""
    known = nodes.filter(F.col("language").isin(*LANGUAGES) & F.col("unit").isNotNull())
    return known.groupBy("repo_id", "unit").agg(F.min("language").alias("node_language"))


def parse_files(files: DataFrame, nodes: DataFrame | None = None) -> DataFrame:
    """file_id, repo_id, language, verdict, parses_as, parses_in; of a file delivered more than once the last counts.

    verdict is valid, wrong_extension (parses in other languages), corrupt (in none), unknown (no language is known) or
    absent (null text); empty and blank texts are valid. parses_as is the language itself or the likeliest other one,
    parses_in are all languages in which the text is valid. The language is that of the path; where the path names none,
    or a suffix that C and C++ share, the nodes of the unit tell it.

    Every text is tried against all grammars where it is read and never shuffled: only the verdicts of repeated
    deliveries, and of nodes, meet. Ties of loaded_at go to the greater list of languages, a null loaded_at is the
    earliest, rows without file_id are left out.
    """
    unit = F.regexp_replace(F.regexp_replace("rel_path", r"\\", "/"), r"^(?:\./)+", "")
    seen = files.filter(F.col("file_id").isNotNull()).select("file_id", "loaded_at", F.col("source_text").isNull().alias("absent"), _accepted()("rel_path", "source_text").alias("parses_in"), "repo_id", "rel_path", unit.alias("unit"))
    last = seen.groupBy("file_id").agg(F.max(F.struct("loaded_at", "parses_in", "absent", "repo_id", "rel_path", "unit")).alias("m")).select("file_id", "m.*")
    path_language = language_column(F.col("rel_path"))
    if nodes is None:
        language = path_language
    else:
        told = node_languages(nodes).withColumnRenamed("unit", "of_unit").withColumnRenamed("repo_id", "of_repo")
        last = last.join(told, F.col("repo_id").eqNullSafe(F.col("of_repo")) & (F.col("unit") == F.col("of_unit")), "left")
        shared = F.col("rel_path").rlike(SHARED) & F.col("node_language").isin("c", "cpp")
        language = F.coalesce(F.when(shared, F.col("node_language")), path_language, F.col("node_language"))
    out = last.withColumn("language", language)
    own = F.array_contains("parses_in", F.col("language"))
    other = F.try_element_at("parses_in", F.lit(1))
    verdict_ = F.when(F.col("absent"), "absent").when(F.col("language").isNull(), "unknown").when(own, "valid").when(F.size("parses_in") > 0, "wrong_extension").otherwise("corrupt")
    blank = F.size("parses_in") == len(LANGUAGES)
    return out.select("file_id", "repo_id", "language", verdict_.alias("verdict"), F.when(own, F.col("language")).when(~blank, other).alias("parses_as"), "parses_in")


def language_column(path: Column) -> Column:
    """The same as language_of, as an expression."""
    out = F.lit(None).cast("string")
    suffix = F.lower(F.regexp_extract(path, r"(\.[^./\\]*)$", 1))
    for language in LANGUAGES:
        out = F.when(suffix.isin(*[s for s, x in SUFFIXES.items() if x == language]), language).otherwise(out)
    return out


def invalid_files(files: DataFrame, nodes: DataFrame | None = None) -> DataFrame:
    return parse_files(files, nodes).filter(F.col("verdict").isin("wrong_extension", "corrupt")).select("file_id")


def invalid_rates(files: DataFrame, nodes: DataFrame | None = None) -> DataFrame:
    """repo_id, language, n_files with a text, n_invalid, of them n_wrong_extension, and invalid_rate."""
    wrong, corrupt = (F.sum((F.col("verdict") == x).cast("bigint")) for x in ("wrong_extension", "corrupt"))
    return (
        parse_files(files, nodes)
        .filter((F.col("verdict") != "absent") & F.col("language").isNotNull())
        .groupBy("repo_id", "language")
        .agg(F.count("*").alias("n_files"), (wrong + corrupt).alias("n_invalid"), wrong.alias("n_wrong_extension"))
        .withColumn("invalid_rate", F.col("n_invalid") / F.col("n_files"))
    )
