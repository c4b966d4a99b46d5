"""Functions and methods paired with their documentation, by island grammars.

Of each file only islands are parsed: comments and literals (so that nothing in them is taken for code), documentation
and annotations right above a definition or, in Python, the literal that opens its body, the line of the signature and
the balanced body. All other code is water. Which definitions are functions is what raw_symbols says.
"""

from __future__ import annotations

import re
from bisect import bisect_right

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.llm.grammars import language_of

# ---------------------------------------------------------------- islands

_C_STRING = r'"(?:[^"\\\n]|\\(?s:.))*"'
_CHAR = r"'(?:[^'\\\n]|\\.)[^'\n]{0,6}'"
_LITERALS = {
    "python": r'[rRuUbBfF]{0,3}(?:"""(?s:(?:[^\\]|\\.)*?)(?:"""|\Z)|\'\'\'(?s:(?:[^\\]|\\.)*?)(?:\'\'\'|\Z)|"(?:[^"\\\n]|\\(?s:.))*"|\'(?:[^\'\\\n]|\\(?s:.))*\')',
    "java": r'"""(?s:.*?)"""|' + _C_STRING + "|" + _CHAR,
    "csharp": r'\$?"""(?s:.*?)"""|(?:\$@|@\$|@)"(?:[^"]|"")*"|' + _C_STRING + "|" + _CHAR,
    "kotlin": r'"""(?s:.*?)"""+|' + _C_STRING + "|" + _CHAR,
    "swift": r'(?P<q>#+)"(?s:.*?)"(?P=q)|"""(?s:.*?)"""|' + _C_STRING,
    "go": r"`[^`]*`|" + _C_STRING + "|" + _CHAR,
    "rust": r'b?r(?P<q>#*)"(?s:.*?)"(?P=q)|"(?:[^"\\]|\\(?s:.))*"|' + r"'(?:[^'\\\n]|\\[^\n]{1,8}?)'",
    "javascript": r"`(?:[^`\\]|\\(?s:.))*`|" + _C_STRING + r"|'(?:[^'\\\n]|\\(?s:.))*'",
    "c": _C_STRING + "|" + _CHAR,
}
_LITERALS["typescript"], _LITERALS["cpp"] = _LITERALS["javascript"], r'R"(?P<q>[^()\\\s]*)\((?s:.*?)\)(?P=q)"|' + _LITERALS["c"]
_ISLANDS = {
    language: re.compile(rf"(?P<line>#[^\n]*)|(?P<text>{rx})" if language == "python" else rf"(?P<line>//[^\n]*)|(?P<block>/\*(?s:.*?)(?:\*/|\Z))|(?P<text>{rx})")
    for language, rx in _LITERALS.items()
}
_NEST = re.compile(r"/\*|\*/")
_NESTING = ("rust", "kotlin", "swift")
#: By language: how a comment that documents what follows may begin.
_OPENERS = {
    "java": ("/**",), "kotlin": ("/**",), "javascript": ("/**",), "typescript": ("/**",), "swift": ("///", "/**"), "rust": ("///", "/**"), "csharp": ("///", "/**"),
    "go": ("//", "/*"), "c": ("//", "/*"), "cpp": ("//", "/*"),
}
_ANNOTATION = {
    "java": r"\s*@", "kotlin": r"\s*@", "swift": r"\s*@", "typescript": r"\s*@", "javascript": r"\s*@", "csharp": r"\s*\[", "rust": r"\s*#!?\[", "cpp": r"\s*(?:\[\[|template\s*<)", "c": r"\s*(?:\[\[|__attribute__)", "go": r"(?!)",
}
_ANNOTATION = {k: re.compile(v) for k, v in _ANNOTATION.items()}
_DEFINES = re.compile(r"[\w$]+(?:\s*<[^<>()]*>)?\s*\(|\b(?:func|fun|fn|def|function|operator|get|set)\b")
_RUST_DOC = re.compile(r'\s*#\[\s*doc\s*=\s*"')
_NAME = re.compile(r"([^\W\d][\w$]*|operator\s*\S+?)(?:\s*<[^<>()]*>)?\s*\(")
_BEFORE_NAME = re.compile(r"^\s*func\s*\([^()]*\)|\bpub\s*\([^()]*\)|__attribute__\s*\(\(.*?\)\)")
_PYTHON_DEF = re.compile(r"[ \t]*(?:async[ \t]+)?def[ \t]+([^\W\d]\w*)")


class File:
    """The islands of one text: comments as (start, end, kind), and the text with comments and literals blanked."""

    def __init__(self, text: str, language: str):
        text = text.removeprefix("﻿").replace("\r\n", "\n").replace("\r", "\n")
        self.text, self.language = text, language
        self.comments: list[tuple[int, int, str]] = []
        self.literals: list[tuple[int, int]] = []
        water, at = [], 0
        find = _ISLANDS[language].search
        end = 0
        while m := find(text, end):
            start, end = m.span()
            if m.lastgroup == "block" and language in _NESTING:
                end = self._nested(start)
            if m.lastgroup in ("line", "block"):
                self.comments.append((start, end, m.lastgroup))
            else:
                self.literals.append((start, end))
            water.append(text[at:start])
            water.append(re.sub(r"[^\n]", " ", text[start:end]) if m.lastgroup != "text" and m[0][:1] in "/#" else re.sub(r"[^\n]", "\x01", text[start:end]))
            at = end
            if end == start:
                end += 1
        water.append(text[at:])
        self.water = "".join(water)
        self.starts = [0, *(m.end() for m in re.finditer("\n", text))]

    def _nested(self, start: int) -> int:
        depth = 0
        for m in _NEST.finditer(self.text, start):
            depth += 1 if m[0] == "/*" else -1
            if not depth:
                return m.end()
        return len(self.text)

    def line_of(self, at: int) -> int:
        """0-based line of an offset."""
        return bisect_right(self.starts, at) - 1

    def line(self, k: int, of: str | None = None) -> str:
        of = self.text if of is None else of
        return of[self.starts[k] : self.starts[k + 1] - 1 if k + 1 < len(self.starts) else len(of)]

    def balanced(self, at: int, opens: str = "([{", closes: str = ")]}") -> int:
        """Offset after the bracket that closes the one at `at`; the end of the text if none does."""
        depth = 0
        for m in re.compile(r"[()\[\]{}]").finditer(self.water, at):
            if m[0] in opens:
                depth += 1
            elif m[0] in closes:
                depth -= 1
                if depth <= 0:
                    return m.end()
        return len(self.water)


_GOES_ON = re.compile(r"(?:\(|,|->|:)\s*\Z")
_CONTINUES = re.compile(r"\s*(?:\{|->|:|where\b|throws\b)")
_SIGNATURE_MARK = re.compile(r"[(\[{};\n]")


def _signature(f: File, start: int) -> str:
    """The text of a definition up to its body: to the brace, semicolon or line end after its parameters, however long.

    Without parameters it ends at the next brace or semicolon, blank line or comment at the latest.
    """
    at, closed = start, False
    while m := _SIGNATURE_MARK.search(f.water, at):
        at = m.end()
        if m[0] in "([":
            at = f.balanced(m.start())
            closed |= m[0] == "("
        elif m[0] in "{};":
            return f.water[start : m.start()]
        elif closed and not _CONTINUES.match(f.water, at) or not f.line(f.line_of(m.start()) + 1, f.water).strip():
            return f.water[start : m.start()]
    return f.water[start:]


def _body_end(f: File, start: int) -> int:
    """Offset of the end of a definition in braces: its balanced body, or the end of its statement."""
    at = start
    while m := re.compile(r"[(\[{;=\n]").search(f.water, at):
        if m[0] in "([":
            at = f.balanced(m.start())
        elif m[0] == "{":
            return f.balanced(m.start(), "{", "}")
        elif m[0] == ";":
            return m.end()
        elif m[0] == "\n" and not _GOES_ON.search(f.water, f.starts[f.line_of(m.start())], m.start()) and not _CONTINUES.match(f.water, m.end()):
            return m.start()
        else:
            at = m.end()
    return len(f.water)


def _python(f: File) -> list[tuple[int, str, str, str]]:
    """(1-based line, name, documentation, code) of every def that a documentation literal opens."""
    out = []
    literal_at = dict(f.literals)
    for k in range(len(f.starts)):
        m = _PYTHON_DEF.match(f.water, f.starts[k])
        if not m or m.end() > (f.starts[k + 1] if k + 1 < len(f.starts) else len(f.text)):
            continue
        at = m.end()
        while c := re.compile(r"[(\[{:\n]").search(f.water, at):  # the colon after the signature
            if c[0] in "([{":
                at = f.balanced(c.start())
            elif c[0] == ":":
                break
            else:
                c = None
                break
        if c is None:
            continue
        body = re.compile(r"[ \t\\]*(?:\n[ \t]*)*").match(f.water, c.end()).end()
        indent = len(m[0]) - len(m[0].lstrip())
        text = f.text
        if body not in literal_at:
            continue
        line_start = f.starts[f.line_of(body)]
        if line_start > c.end() and body - line_start <= indent:
            continue
        end = literal_at[body]
        literal = text[body:end]
        rest = f.water[end : (f.starts[f.line_of(end) + 1] if f.line_of(end) + 1 < len(f.starts) else len(text))]
        quote = re.match(r"[rRuU]?(\"\"\"|'''|\"|')", literal)
        if quote is None or rest.strip(" \t\n;") and not rest.lstrip().startswith(";"):
            continue
        q = quote[1]
        inner = literal[quote.end() : -len(q)] if literal.endswith(q) and len(literal) >= quote.end() + len(q) else literal[quote.end() :]
        last = f.line_of(end)
        for j in range(last, len(f.starts)):
            row = f.line(j, f.water)
            if row.strip() and j > f.line_of(c.start()) and len(row) - len(row.lstrip()) <= indent and "\x01" not in row[: indent + 1]:
                break
            if row.strip():
                last = j
        out.append((k + 1, m[1], inner, text[f.starts[k] : f.starts[last] + len(f.line(last))]))
    return out


def _braces(f: File) -> list[tuple[int, str, str, str]]:
    openers, annotation = _OPENERS[f.language], _ANNOTATION[f.language]
    n = len(f.starts)
    groups: list[tuple[int, int, str]] = []  # first line, last line, text
    for start, end, kind in f.comments:
        first, last = f.line_of(start), f.line_of(end - 1)
        raw = f.text[start:end]
        if f.water[f.starts[first] : start].strip(" \t") or not raw.startswith(openers) or raw.startswith(("/**/", "////")) and f.language != "go":
            continue
        if kind == "line" and groups and groups[-1][1] == first - 1 and groups[-1][2].startswith("//"):
            groups[-1] = (groups[-1][0], last, groups[-1][2] + "\n" + raw)
        else:
            groups.append((first, last, raw))
    if f.language == "rust":
        for k in range(n):
            m = _RUST_DOC.match(f.text, f.starts[k])
            if m:
                literal = next((x for x in f.literals if x[0] == m.end() - 1), None)
                if literal:
                    groups.append((k, f.line_of(literal[1]), f.text[literal[0] + 1 : literal[1] - 1]))
        groups.sort()
    out: dict[int, tuple[int, str, str, str]] = {}
    comment_lines = {k for s, e, _ in f.comments for k in range(f.line_of(s), f.line_of(e - 1) + 1)}
    for _, last, raw in groups:
        k = last + 1
        while k < n:
            row = f.line(k, f.water)
            if not row.strip():
                if k in comment_lines:  # a comment that documents nothing may stand between
                    k += 1
                    continue
                break
            a = annotation.match(row)
            if not a:
                break
            at = f.starts[k] + a.end()
            if f.language == "cpp" and "template" in a[0]:
                after = f.line(k, f.water).rfind(">")
                if after >= 0 and f.line(k, f.water)[after + 1 :].strip():
                    break
                k += 1
                continue
            bracket = re.compile(r"[\[(]|(?<=\w)(?=[\s\x01])|\n").search(f.water, at - (f.language in ("csharp", "rust", "cpp")))
            stop = f.balanced(bracket.start()) if bracket and bracket[0] in ("[", "(") else (bracket.start() if bracket else len(f.water))
            j = f.line_of(max(stop - 1, f.starts[k]))
            tail = f.water[stop : f.starts[j + 1] if j + 1 < n else len(f.water)]
            if tail.strip() and not annotation.match(tail):
                break
            k = j + 1
        if k >= n or not f.line(k, f.water).strip():
            continue
        start = f.starts[k]
        head = _signature(f, start)
        name = _NAME.search(_BEFORE_NAME.sub(" ", head, count=1))
        if not _DEFINES.search(head):
            continue
        out[k + 1] = (k + 1, name[1] if name else "", raw, f.text[start : _body_end(f, start)])
    return list(out.values())


# ---------------------------------------------------------------- what documentation says

_MARKUP = re.compile(r"^\s*(?:/\*[*!]?|\*+/|\*(?!\w)|//[/!]?|\*/)?[ \t]?")
_TAIL = re.compile(r"\s*\*+/\s*$")
#: Lines from which on only parameters and results are listed.
_SECTION = re.compile(r"(?i)^\s*(?:args|arguments|parameters|params|keyword args|attributes)\s*:?\s*$")
_OTHER_SECTION = re.compile(r"(?i)^\s*(?:returns?|yields?|raises|throws|notes?|examples?|see also|warnings?|todo)\s*:?\s*$")
_PARAMETER = re.compile(r"(?i)^\s*(?:[@\\](?:param|tparam|arg|argument)\b|:(?:param|parameter|arg|argument|key|type)\b|[-*+]\s*parameters?\b|<(?:param|typeparam)\b|#\s*(?:arguments|parameters)\s*$|[-*+]\s*`?\w+`?\s*:)")
_SILENT = re.compile(
    r"(?i)^\W*(?:todo\b.*|fixme\b.*|xxx\b.*|hack\b.*|tbd|n/?a|none|nil|null|see (?:above|below|base|super|parent|interface)\w*|\{?@?inheritdoc\}?|<inheritdoc\s*/?>|add (?:a )?(?:documentation|docs?|description)( here)?|(?:documentation|description|docs?|comment)( is)? (?:missing|pending|to come|goes here)|"
    r"(?:method|function|class|constructor)? ?(?:description|documentation|summary|comment) (?:goes )?here|no (?:description|documentation|docs?)( available| yet| provided)?|auto-?generated (?:method |constructor |function )?stub|undocumented|not documented( yet)?|document (?:this|me)|insert (?:description|documentation) here|"
    r"placeholder|stub|lorem ipsum.*|description|documentation|summary|documentation pending|write me|fill (?:me )?in|to be (?:done|documented|written))\W*$"
)
_ASIDE = re.compile(r"(?i)^\W*(?:copyright\b.*|licensed under\b.*|all rights reserved.*|spdx-.*|see (?:also )?(?:the )?[\w./-]+(?: [\w./-]+){0,3} for (?:more |further )?(?:details|information)|#?(?:end)?region:.*|#(?:end)?region\b.*|noqa\b.*|nolint\b.*|eslint-\S+.*|prettier-\S+.*|pylint:.*|type: ignore.*|clang-format .*|go:\w+.*|\+build .*|mark: .*|pragma .*|nosec.*)$")
_HEADING = re.compile(r"^\s*([-=~*#_+/]{2,}).*?\1?\s*$")
_WORDS = re.compile(r"[^\W\d_]+|\d+")
_CAMEL = re.compile(r"[A-ZÄÖÜ]+(?![a-zäöüß])|[A-ZÄÖÜ]?[a-zäöüß]+|[^\W\d_]+|\d+")
#: Words that say nothing beyond a name.
_EMPTY = frozenset("a an the this that it its these those of for to from in on at by with and or is are be was does do did will can function method procedure routine helper def fn func fun which given self".split())


def description(raw: str) -> str:
    """What a documentation comment says in prose: without comment signs, parameter lists and notes that say nothing."""
    out, listing, indent = [], False, 0
    for line in raw.split("\n"):
        line = _TAIL.sub("", _MARKUP.sub("", line, count=1)) if raw.lstrip().startswith("/") else line
        line = line.rstrip()
        bare = re.sub(r"(?i)</?(?:summary|remarks|para|p|returns?|code|c|br|see|inheritdoc)\b[^>]*?>", lambda m: m[0] if "inheritdoc" in m[0].lower() else " ", line).strip()
        if listing:
            deeper = len(line) - len(line.lstrip()) > indent
            if not bare:
                continue
            if deeper or _PARAMETER.match(bare):
                continue
            listing = False
        if _SECTION.match(line):
            listing, indent = True, len(line) - len(line.lstrip())
            continue
        if _PARAMETER.match(line) or _PARAMETER.match(bare):
            listing, indent = True, len(line) - len(line.lstrip())
            continue
        if not bare or _OTHER_SECTION.match(bare) or _HEADING.match(bare) or _ASIDE.match(bare) or _SILENT.match(bare):
            continue
        out.append(bare)
    return " ".join(out)


def _stem(word: str) -> str:
    word = word.lower()
    for end, put in (("ies", "y"), ("sses", "ss"), ("shes", "sh"), ("ches", "ch"), ("xes", "x"), ("ing", ""), ("ed", ""), ("es", "e"), ("s", "")):
        if word.endswith(end) and len(word) - len(end) >= 2 and not word.endswith("ss"):
            word = word[: -len(end)] + put
            break
    return re.sub(r"(.)\1$", r"\1", word.rstrip("e"))


def says_something(text: str, name: str) -> bool:
    """Whether a description has a word that neither the name nor an empty phrase has."""
    if not text or _SILENT.match(text):
        return False
    named = {_stem(x) for x in _CAMEL.findall(name)}
    whole = re.sub(r"\W|_", "", name).lower()
    return any(w.lower() not in _EMPTY and _stem(w) not in named and w.lower() != whole for w in _WORDS.findall(re.sub(r"\b" + re.escape(name) + r"\b", " ", text) if name else text))


def documented(path: str | None, text: str | None) -> list[tuple[int, str, str, str]]:
    """(line, name, description, code) of each definition whose own documentation says something beyond its name."""
    language = language_of(path)
    if not text or language is None:
        return []
    f = File(text, language)
    found = _python(f) if language == "python" else _braces(f)
    return [(line, name, said, code) for line, name, raw, code in found if says_something(said := description(raw), name)]


# ---------------------------------------------------------------- operators


def _islands(with_code: bool):
    kind = "array<struct<start_line:int" + (",description:string,code:string>>" if with_code else ">>")

    @F.pandas_udf(kind)
    def run(path: pd.Series, text: pd.Series) -> pd.Series:
        rows = (documented(None if pd.isna(p) else p, None if pd.isna(t) else t) for p, t in zip(path, text, strict=True))
        return pd.Series([[{"start_line": a, "description": c, "code": d} if with_code else {"start_line": a} for a, _, c, d in r] for r in rows], dtype=object)

    return run


#: A signature that declares a type, where is_type_decl is not set.
_TYPE = r"(?:^|[\s>\]])(?:class|interface|enum|record|struct|trait|object|protocol|extension|namespace|union|type|typealias|typedef|actor|impl|mod)\s+[\w@<(*]"


def functions_of(symbols: DataFrame) -> DataFrame:
    """file_id, start_line of the functions and methods; repeated rows once, types left out by mark or signature."""
    head = F.regexp_extract("signature", r"^[^(=]*", 0)
    typed = F.coalesce("is_type_decl", F.lit(False)) | F.coalesce(head.rlike(_TYPE), F.lit(False))
    return symbols.filter(~typed & F.col("file_id").isNotNull() & F.col("start_line").isNotNull()).select("file_id", "start_line").distinct()


def documented_functions(files: DataFrame, symbols: DataFrame, with_code: bool = True) -> DataFrame:
    """file_id, start_line of every documented function or method, with its description and code.

    Files are parsed where they are read; only the pairs move. Of a file delivered more than once the last delivery
    counts (a null loaded_at is the earliest). Files without text or of other languages give no pairs; no row repeats.
    """
    udf = _islands(with_code)
    # of two deliveries with one stamp the one with the greater hash of path and text counts
    version = F.struct("loaded_at", F.xxhash64("rel_path", "source_text").alias("text")).alias("version")
    known = files.filter(F.col("file_id").isNotNull())
    parsed = known.select("file_id", version, udf("rel_path", "source_text").alias("found"))
    last = known.groupBy("file_id").agg(F.max(version).alias("last"))
    fields = ["start_line", "description", "code"] if with_code else ["start_line"]
    pairs = parsed.select("file_id", "version", F.explode("found").alias("x")).select("file_id", "version", *[F.col(f"x.{c}") for c in fields])
    kept = pairs.join(last, "file_id").filter(F.col("version").eqNullSafe(F.col("last"))).select("file_id", *fields).dropDuplicates(["file_id", "start_line"])
    return kept.join(functions_of(symbols), ["file_id", "start_line"], "left_semi")


def found_functions(files: DataFrame, symbols: DataFrame) -> DataFrame:
    return documented_functions(files, symbols, with_code=False).select("file_id", "start_line")
