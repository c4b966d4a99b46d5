"""Validity of source texts in eleven programming languages.

Python is compiled by the interpreter itself; the other ten languages have recursive-descent parsers (see graphloom/syntax) that
read every token of a text: all branches of conditional compilation, and the expressions within templates,
interpolations and markup elements too. Types and names are never looked up.
"""

from __future__ import annotations

import warnings
from functools import lru_cache

from graphloom.syntax.base import Parser, refused, valid
from graphloom.syntax.cfamily import C, Cpp
from graphloom.syntax.conditionals import variants
from graphloom.syntax.csharp import CSharp
from graphloom.syntax.ecma import JavaScript, TypeScript
from graphloom.syntax.golang import Go
from graphloom.syntax.java import Java
from graphloom.syntax.kotlin import Kotlin
from graphloom.syntax.lexing import Bad, Lexer
from graphloom.syntax.rust import Rust
from graphloom.syntax.swift import Swift

LANGUAGES = ("python", "typescript", "javascript", "java", "go", "rust", "csharp", "c", "cpp", "kotlin", "swift")
#: The language of each file suffix.
SUFFIXES = {
    ".py": "python", ".pyi": "python", ".ts": "typescript", ".tsx": "typescript", ".mts": "typescript", ".cts": "typescript",
    ".js": "javascript", ".jsx": "javascript", ".mjs": "javascript", ".cjs": "javascript", ".java": "java", ".go": "go",
    ".rs": "rust", ".cs": "csharp", ".c": "c", ".h": "c", ".cpp": "cpp", ".cc": "cpp", ".cxx": "cpp", ".hpp": "cpp",
    ".hh": "cpp", ".hxx": "cpp", ".kt": "kotlin", ".kts": "kotlin", ".swift": "swift",
}


def language_of(path: str | None) -> str | None:
    """The language that a path's suffix names; None for any other."""
    name = (path or "").replace("\\", "/").rpartition("/")[2]
    return SUFFIXES.get("." + name.rpartition(".")[2].lower()) if "." in name else None


@lru_cache(len(LANGUAGES))
def _parser(name: str) -> tuple[type[Parser], Lexer]:
    # JavaScript has the tokens of TypeScript
    return _PARSERS[name], _parser("typescript")[1] if name == "javascript" else Lexer(name)


_PARSERS = {x.LANGUAGE: x for x in (TypeScript, JavaScript, Java, Go, Rust, CSharp, C, Cpp, Kotlin, Swift)}
_DIRECTIVES = ("c", "cpp", "csharp", "swift")


def normal_text(text: str) -> str:
    """Without a byte-order mark, and with one kind of line ends."""
    return text.removeprefix("\ufeff").replace("\r\n", "\n").replace("\r", "\n")


def compiles(text: str) -> bool:
    try:
        with warnings.catch_warnings():
            warnings.simplefilter("ignore")
            compile(text, "<source>", "exec", dont_inherit=True)
    except (SyntaxError, ValueError, RecursionError, MemoryError, OverflowError):
        return False
    return True


def parses(text: str, language: str, foreign: bool = False) -> bool:
    """Whether the text is valid in the language. A byte-order mark and any line ends are ignored; empty text is valid.

    `foreign` says that it most likely is not: then its first statements are judged before the rest is tokenised. The
    answer is the same.
    """
    return parses_normal(normal_text(text), language, foreign)


def parses_normal(text: str, language: str, foreign: bool = False) -> bool:
    """The same for a text that normal_text has been over."""
    if not text or text.isspace():
        return True
    if language == "python":
        return compiles(text)
    parser, lexer = _parser(language)
    try:
        texts = variants(text, language) if language in _DIRECTIVES else [text]
    except Bad:
        return False
    if foreign and any(refused(parser, lexer, x) for x in texts):
        return False
    return all(valid(parser, lexer, x) for x in texts)
