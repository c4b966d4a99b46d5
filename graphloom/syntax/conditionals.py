"""Conditional compilation: the texts that a file with directives stands for.

Of every conditional the k-th text has the k-th branch (the last, where there are fewer; none, if the conditional has no
`else` and all its branches are taken already), so each branch is in at least one text, and a file has as many texts as
its widest conditional has branches. A branch whose condition is a plain false constant is dropped, as compilers do.
"""

from __future__ import annotations

import re

from graphloom.syntax.lexing import Bad

_DIRECTIVE = {
    "c": re.compile(r"[ \t]*#[ \t]*([A-Za-z]*)((?:[^\n\\]|\\(?:\n|.))*)"),
    "csharp": re.compile(r"[ \t]*#[ \t]*(if|elif|else|endif|region|endregion|pragma|nullable|define|undef|error|warning|line|r|load)\b([^\n]*)"),
    "swift": re.compile(r"[ \t]*#(if|elseif|else|endif|sourceLocation|error|warning)\b([^\n]*)"),
}
_DIRECTIVE["cpp"] = _DIRECTIVE["c"]
_OPEN, _NEXT = ("if", "ifdef", "ifndef"), ("elif", "elseif", "elifdef", "elifndef", "else")
#: Directives of C that may stand in a text.
_KNOWN = frozenset("define undef include include_next import pragma error warning line ident embed".split()) | {""}
_STRING_OR_COMMENT = {
    "c": re.compile(r'/\*(?s:.*?)\*/|//(?:[^\n\\]|\\(?s:.))*|"(?:[^"\\\n]|\\(?s:.))*"|\'(?:[^\'\\\n]|\\.)*\''),
    "cpp": re.compile(r'R"(?P<m>[^()\\\s]*)\((?s:.*?)\)(?P=m)"|/\*(?s:.*?)\*/|//(?:[^\n\\]|\\(?s:.))*|"(?:[^"\\\n]|\\(?s:.))*"|\'(?:[^\'\\\n]|\\.)*\''),
    "csharp": re.compile(r'"""(?s:.*?)"""|/\*(?s:.*?)\*/|//[^\n]*|[@$]*@[@$]*"(?:[^"]|"")*"|"(?:[^"\\\n]|\\.)*"'),
    "swift": re.compile(r'"""(?s:.*?)"""|/\*(?s:.*?)\*/|//[^\n]*|"(?:[^"\\\n]|\\.)*"'),
}


#: Texts without any of these have no directive. A text of C has one wherever a line begins with the sign.
_HINT = {"csharp": re.compile(r"#[ \t]*(?:if|elif|else|endif|region|endregion|pragma|nullable|define|undef|error|warning|line|r|load)\b"), "swift": re.compile(r"#(?:if|elseif|else|endif|sourceLocation|error|warning)\b")}


def _constant(language: str, word: str, condition: str) -> bool | None:
    """What a condition is known to be; None if that depends."""
    c = re.sub(r"/\*.*?\*/|//.*", "", condition).strip()
    if c in ("0", "false"):
        return False
    if language in ("c", "cpp") and c in ("__cplusplus", "defined(__cplusplus)", "defined __cplusplus", "defined (__cplusplus)"):
        return (language == "cpp") == (word != "ifndef")
    return None


def variants(text: str, language: str) -> list[str]:
    """The texts without directives; the text itself if it has none."""
    if "#" not in text or language in _HINT and not _HINT[language].search(text):
        return [text]
    directive = _DIRECTIVE[language]
    covered = (m.span() for m in _STRING_OR_COMMENT[language].finditer(text) if "\n" in m[0])
    low, high = next(covered, (len(text), len(text)))
    pieces: list = []  # texts and conditionals in order
    stack: list[tuple[list, list, list]] = []  # (outer pieces, branches, known conditions)
    current, at, n = pieces, 0, len(text)
    while at < n:
        while high <= at:  # the next literal or comment of several lines
            low, high = next(covered, (n, n + 1))
        end = text.find("\n", at)
        end = n if end < 0 else end
        m = None if low < at else directive.match(text, at)
        if m is None:
            current.append(text[at : end + 1])
            at = end + 1
            continue
        word, rest = m[1], m[2]
        begin, at = at, max(m.end(), at)
        if "/*" in rest and "*/" not in rest:  # a comment that begins on the directive's line
            close = text.find("*/", at)
            if close < 0:
                raise Bad
            at = close + 2
        else:
            at += 1
        current.append("\n" * text.count("\n", begin, min(at, n)) or "\n")
        if word in _OPEN:
            stack.append((current, [[]], [_constant(language, word, rest)]))
            current = stack[-1][1][0]
        elif word in _NEXT:
            if not stack or "else" in stack[-1][2]:
                raise Bad
            stack[-1][1].append([])
            stack[-1][2].append("else" if word == "else" else _constant(language, word, rest))
            current = stack[-1][1][-1]
        elif word == "endif":
            if not stack:
                raise Bad
            outer, branches, known = stack.pop()
            outer.append((branches, known))
            current = outer
        elif language in ("c", "cpp") and word not in _KNOWN:
            raise Bad
    if stack:
        raise Bad
    width = _width(pieces)
    return list(dict.fromkeys("".join(_text(pieces, j)) for j in range(width)))


def _options(branches: list, known: list) -> list:
    """The branches that may be compiled, and an empty one if none need be."""
    if True in known:
        return [branches[known.index(True)]]
    kept = [b for b, c in zip(branches, known, strict=True) if c is not False]
    return kept if "else" in known and kept else [*kept, []]


def _width(pieces: list) -> int:
    out = 1
    for x in pieces:
        if isinstance(x, tuple):
            options = _options(*x)
            out = max(out, len(options), *map(_width, options))
    return out


def _text(pieces: list, j: int) -> list[str]:
    """The j-th text; what is not in it leaves its line ends, so that all texts have the lines of the file."""
    out: list[str] = []
    for x in pieces:
        if isinstance(x, str):
            out.append(x)
        else:
            options = _options(*x)
            chosen = options[min(j, len(options) - 1)]
            for branch in x[0]:
                out += _text(branch, j) if branch is chosen else ["\n" * _lines(branch)]
    return out


def _lines(pieces: list) -> int:
    return sum(x.count("\n") if isinstance(x, str) else sum(map(_lines, x[0])) for x in pieces)
