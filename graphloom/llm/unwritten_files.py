"""Generated, minified or vendored source files and data blobs, so that only hand-written source remains.

Layout statistics against thresholds per language find minified files, data kept as code and numbered accessors; the
place of a file and the notes that tools leave in the comments at its borders find the other generated and vendored
ones. Notes inside code or string literals do not count, nor do words of a name that merely sound like a tool.
"""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.llm.grammars import language_of

#: By language: characters of a dense line, its greatest white-space share, least share of the text in such lines (encoded
#: runs and rules of dashes are left out of all three), least share of numbers among the tokens, least number of numbers,
#: least share of the text in encoded runs. Languages of long types and names (Java, C#, Kotlin, Swift) and such whose
#: formatters leave long lines (Go, C) need longer lines to be dense; scripts, which are squeezed most, shorter ones.
THRESHOLDS = {
    None: (200, 0.10, 0.50, 0.80, 40, 0.40),
    "python": (200, 0.08, 0.50, 0.80, 40, 0.40),
    "javascript": (180, 0.10, 0.40, 0.80, 40, 0.40),
    "typescript": (180, 0.10, 0.40, 0.80, 40, 0.40),
    "java": (220, 0.09, 0.50, 0.80, 40, 0.40),
    "csharp": (220, 0.09, 0.50, 0.80, 40, 0.40),
    "kotlin": (220, 0.09, 0.50, 0.80, 40, 0.40),
    "swift": (220, 0.09, 0.50, 0.80, 40, 0.40),
    "rust": (200, 0.09, 0.50, 0.80, 40, 0.40),
    "c": (240, 0.08, 0.50, 0.85, 48, 0.40),
    "cpp": (240, 0.08, 0.50, 0.85, 48, 0.40),
    "go": (240, 0.08, 0.50, 0.85, 48, 0.40),
}
#: By language, of a whole file: least mean and maximum line length, greatest white-space share, least and greatest
#: alphanumeric share. All must hold: they show minified text wrapped into lines too short to be dense.
FILE_THRESHOLDS = {
    None: (55, 70, 0.08, 0.40, 0.80),
    "python": (55, 70, 0.08, 0.40, 0.80),
    "javascript": (50, 60, 0.09, 0.40, 0.80),
    "typescript": (50, 60, 0.09, 0.40, 0.80),
    "c": (55, 70, 0.10, 0.40, 0.80),
    "cpp": (55, 70, 0.10, 0.40, 0.80),
    "go": (55, 70, 0.10, 0.40, 0.80),
    "java": (55, 70, 0.10, 0.40, 0.80),
    "rust": (55, 70, 0.10, 0.40, 0.80),
    "csharp": (55, 70, 0.10, 0.40, 0.80),
    "kotlin": (55, 70, 0.10, 0.40, 0.80),
    "swift": (55, 70, 0.10, 0.40, 0.80),
}
#: Characters from which the whole-file thresholds count; of a shorter text the shares mean little.
LEAST_TEXT = 400
_NUMBER = re.compile(r"(?<![\w.])(?:0[xX][0-9a-fA-F]+|\d[\d_]*(?:\.\d+)?(?:[eE][+-]?\d+)?)[fFlLuU]?(?![\w.])")
_WORD = re.compile(r"(?<!\w)[^\W\d]\w*")
_SIGN = re.compile(r"[\W_]+")
_RUN = re.compile(r"[A-Za-z0-9+/=_-]{48,}|(?:\\x[0-9a-fA-F]{2}){12,}|(?:\\u[0-9a-fA-F]{4}){8,}")
_NUMBERED = re.compile(r"\b([^\W\d]\w*?)_?(\d+)\s*\(\s*(?:void\s*)?\)")
_DEFINED = re.compile(r"\b[^\W\d]\w*\s*\([^()\n]*\)[^;\n]*[{:]\s*$", re.M)
#: Least number of numbered accessors, and their least share of all definitions.
SERIES, SERIES_SHARE = 3, 0.8

_COMMENT = re.compile(r"\s*(?://|#(?!\s*(?:include|define|if|ifdef|ifndef|endif|pragma)\b)|/\*|\*|--|;;|<!--)")
#: What a note says, by its parts and not by its phrase: who made the file (a participle, "by" or "from", and for the
#: weaker participles a tool), that it must not be edited (a prohibition without exception), that edits do not last.
_MADE = re.compile(r"(?i)\b(?:(?:auto|machine)[- ]?(?:matically\s+)?)?(?:generated|made|produced)\b(?:\s+\w+){0,2}?\s+(?:by|from|with|using)\s+\S|(?:^|\W)@generated\b|<auto-?generated|\bauto-?\s?(?:matically\s+)?generated\b|\b[\w-]*(?:checksum|sha\d+|md5|digest)\s*[:=]\s*[0-9a-f]{4,}")
_MADE_BY_TOOL = re.compile(r"(?i)\b(?:created|written|emitted|compiled|exported|built|re-?generated?)\b.{0,60}?\b(?:by|from|with|using)\b.{0,40}?(?:generator|exporter|compiler|codegen|schema|template|\btool\b|-gen\b|protoc)")
_FORBIDDEN = re.compile(r"(?i)\b(?:do not|don't|never)\s+(?:edit|modify|change)\b(?:\s+(?:it|this|this file|by hand|manually|directly))?\s*(?:\W*$|[.;:!*-])|\b(?:edits?|changes|modifications)\b.{0,20}\bwill be (?:lost|overwritten|discarded)\b|\bedit the (?:template|schema|source) instead\b")
#: Where a file comes from: a verb of copying with a release, or a banner of name, release and rights.
_RELEASE = r"(?:\b[vV]?|@)\d+\.\d+(?:\.\d+)?\b"
_ORIGIN = re.compile(rf"(?i)\b(?:vendored|imported|copied|bundled|mirrored|forked|taken)\b.{{0,40}}?\b(?:from|of)\b.{{0,80}}?{_RELEASE}|^\W*\S+ {_RELEASE} ?\|.*(?:\(c\)|©|licen[cs]e|https?:)|\bvendored (?:from|copy)\b|\bcopied (?:verbatim )?from upstream\b")
_STUB = re.compile(r"(?i)auto-?generated method stub")
_VENDORED_PATH = r"(?:^|/)(?:vendor|node_modules|third[_-]?party|external|Pods|deps|\.?venv|site-packages|bower_components|Godeps|Carthage)/|(?:^|/)[^/]+-\d+\.\d+(?:\.\d+)?[^/]*/"
_GENERATED_PATH = r"(?:^|/)(?:generated|__generated__|autogen|gen)/|_pb2(?:_grpc)?\.pyi?$|(?:_grpc)?_pb\.[cm]?[jt]sx?$|\.pb\.[\w.]+$|\.generated\.\w+$|\.g\.\w+$|\.designer\.\w+$|\.tab\.[ch]\w*$|OuterClass\.java$|(?:^|/)zz_generated[^/]*$|_bindings\.rs$|\.freezed\.\w+$"
_MINIFIED_PATH = r"\.min\.[cm]?[jt]sx?$|\.bundle(?:\.[0-9a-f]+)?\.[cm]?[jt]sx?$"


def _border(lines: list[str]) -> tuple[list[str], list[str]]:
    """The comment lines before the first code and after the last, however many."""

    def edge(ordered):
        out, inside = [], False
        for line in ordered:
            s = line.strip()
            if s and not _COMMENT.match(line) and not inside and not s.endswith("*/"):
                break
            inside = (inside or "/*" in s) and "*/" not in s
            if s:
                out.append(s)
        return out

    tail = []
    for line in reversed(lines):
        if line.strip() and not _COMMENT.match(line):
            break
        if line.strip():
            tail.append(line.strip())
    return edge(lines), tail


def layout(path: str | None, text: str | None) -> dict:
    """Layout statistics of a text, what its thresholds make of them, and what the notes at its borders say."""
    text = (text or "").removeprefix("﻿")
    lines = re.split(r"\r\n|\n|\r", text)
    filled = [x for x in lines if x.strip()]
    n = max(1, len(text))
    dense_length, dense_space, dense_share, number_share, numbers, encoded_share = THRESHOLDS.get(language_of(path), THRESHOLDS[None])
    plain = [_RUN.sub("", x) for x in filled] if _RUN.search(text) else filled
    dense = sum(len(x) for x in plain if len(x) >= dense_length and sum(map(str.isspace, x)) < dense_space * len(x))
    outside = max(1, n - sum(map(len, filled)) + sum(map(len, plain)))
    found = len(_NUMBER.findall(text))
    tokens = found + len(_WORD.findall(text))
    runs = sum(len(m[0]) for m in _RUN.finditer(text) if re.search(r"\d", m[0]) and re.search(r"[A-Za-z]", m[0]) and len(set(m[0])) > 8)
    series, last = 0, {}
    for m in _NUMBERED.finditer(text):
        series += last.get("k", int(m[2]) - 1) == int(m[2]) - 1
        last["k"] = int(m[2])
    series = series if series >= SERIES and series >= SERIES_SHARE * len(_DEFINED.findall(text)) else 0
    head, tail = _border(lines)
    notes = [x for x in head + tail if not _STUB.search(x)]
    max_line, mean_line = max(map(len, lines)), sum(map(len, filled)) / max(1, len(filled))
    space_share, alnum_share = (len(text) - sum(map(len, text.split()))) / n, len(_SIGN.sub("", text)) / n
    blob = found >= numbers and found >= number_share * tokens or runs >= encoded_share * n and runs >= 200
    least_mean, least_max, most_space, least_alnum, most_alnum = FILE_THRESHOLDS.get(language_of(path), FILE_THRESHOLDS[None])
    packed = n >= LEAST_TEXT and mean_line >= least_mean and max_line >= least_max and space_share <= most_space and least_alnum <= alnum_share <= most_alnum
    return {
        "max_line": max_line,
        "mean_line": mean_line,
        "space_share": space_share,
        "alnum_share": alnum_share,
        "number_density": found / max(1, tokens),
        "encoded_share": runs / n,
        "dense_share": dense / outside,
        "minified": dense >= dense_share * outside or packed and not blob,
        "blob": blob,
        "series": series,
        "generated_note": any(_MADE.search(x) or _MADE_BY_TOOL.search(x) or _FORBIDDEN.search(x) for x in notes),
        "vendored_note": any(map(_ORIGIN.search, notes)),
    }


_FIELDS = "max_line int, mean_line double, space_share double, alnum_share double, number_density double, encoded_share double, dense_share double, minified boolean, blob boolean, series int, generated_note boolean, vendored_note boolean"


def _layouts():
    @F.pandas_udf(_FIELDS)
    def run(path: pd.Series, text: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([layout(None if pd.isna(p) else p, None if pd.isna(t) else t) for p, t in zip(path, text, strict=True)], columns=[x.split()[0] for x in _FIELDS.split(", ")])

    return run


def reason(path: Column, stats: str = "s", notes: bool = True, paths: bool = True) -> Column:
    """minified, blob, vendored or generated, the first that holds; null for hand-written files.

    Layout decides alone if `notes` and `paths` are off. Both are additions to it: code that a tool or another project
    laid out like hand-written code has no layout of its own.
    """
    p = F.regexp_replace(path, r"\\", "/")
    at = lambda pattern: F.coalesce(p.rlike(pattern), F.lit(False)) & F.lit(paths)
    note = lambda name: F.col(f"{stats}.{name}") & F.lit(notes)
    return (
        F.when(F.col(f"{stats}.minified") | at(_MINIFIED_PATH), "minified")
        .when(F.col(f"{stats}.blob"), "blob")
        .when(note("vendored_note") | at(_VENDORED_PATH), "vendored")
        .when(note("generated_note") | (F.col(f"{stats}.series") > 0) | at(_GENERATED_PATH), "generated")
    )


def classified_files(files: DataFrame, notes: bool = True, paths: bool = True) -> DataFrame:
    """file_id, repo_id, unit, reason (null: hand-written) and the layout statistics of each file.

    Texts are judged where they are read and never shuffled. Of a file delivered more than once the last delivery
    counts; a null loaded_at is the earliest, ties go to the greater reason. Files with null or empty text are judged
    by their path. Rows without file_id are left out. `unit` is the path as nodes.unit has it.
    """
    seen = files.filter(F.col("file_id").isNotNull()).select("file_id", "repo_id", "loaded_at", "rel_path", _layouts()("rel_path", "source_text").alias("s"))
    unit = F.regexp_replace(F.regexp_replace("rel_path", r"\\", "/"), r"^(?:\./)+", "")
    judged = seen.select("file_id", F.struct("loaded_at", reason(unit, notes=notes, paths=paths).alias("reason"), "repo_id", unit.alias("unit"), "s").alias("m"))
    return judged.groupBy("file_id").agg(F.max("m").alias("m")).select("file_id", "m.repo_id", "m.unit", "m.reason", "m.s.*")


def unwritten_files(files: DataFrame, notes: bool = True, paths: bool = True) -> DataFrame:
    return classified_files(files, notes, paths).filter(F.col("reason").isNotNull()).select("file_id")


def hand_written_files(files: DataFrame) -> DataFrame:
    return classified_files(files).filter(F.col("reason").isNull()).select("file_id", "repo_id")


def hand_written_nodes(files: DataFrame, nodes: DataFrame) -> DataFrame:
    """The nodes of hand-written units: those whose unit is no unwritten file of their repository."""
    unwritten = classified_files(files).filter(F.col("reason").isNotNull()).select(F.col("repo_id").alias("r"), F.col("unit").alias("u")).distinct()
    return nodes.join(unwritten, F.col("repo_id").eqNullSafe(F.col("r")) & (F.col("unit") == F.col("u")), "left_anti")
