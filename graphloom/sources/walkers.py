"""Facts of the ten languages beside Python: definitions with container, signature and body, imports, calls, bases.

The parsers of `syntax` tell what they read; here that becomes rows of the shape that extract.python_facts gives, so that
one resolution serves all languages. A file that does not parse gives one error row.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.functions.paths import language_of, module_qname, posix
from graphloom.functions.signatures import body_digest
from graphloom.sources.extract import FACTS
from graphloom.syntax.base import Parser
from graphloom.syntax.cfamily import C, Cpp
from graphloom.syntax.conditionals import variants
from graphloom.syntax.csharp import CSharp
from graphloom.syntax.ecma import JavaScript, TypeScript
from graphloom.syntax.golang import Go
from graphloom.syntax.java import Java
from graphloom.syntax.kotlin import Kotlin
from graphloom.syntax.lexing import Bad, Lexer, Tokens
from graphloom.syntax.rust import Rust
from graphloom.syntax.swift import Swift

_PARSERS = {x.LANGUAGE: x for x in (TypeScript, JavaScript, Java, Go, Rust, CSharp, C, Cpp, Kotlin, Swift)}
#: Languages in which a bare call may mean a method of the own type.
_BARE_METHODS = frozenset(["java", "csharp", "kotlin", "swift", "cpp"])
_EXPORTED = {"java": ("public", "protected"), "csharp": ("public", "protected"), "kotlin": (), "swift": ("public", "open"), "rust": ("pub",)}


@lru_cache(len(_PARSERS))
def _lexer(language: str) -> Lexer:
    return Lexer(language)


def visibility(language: str, name: str, head: list[str]) -> str:
    if language == "go":
        return "exported" if name[:1].isupper() else "internal"
    if language == "kotlin":
        return "internal" if {"private", "internal"} & set(head) else "exported"
    if language in ("typescript", "javascript"):
        return "internal" if {"private", "protected"} & set(head) or name.startswith(("_", "#")) else "exported"
    if language in ("c", "cpp"):
        return "internal" if "static" in head else "exported"
    return "exported" if any(w in head for w in _EXPORTED[language]) else "internal"


def _joined(base: str, *parts: str) -> str:
    return ".".join(x for x in (base, *parts) if x)


def _imports(language: str, words: list[str], extra: str, module: str, unit: str) -> list[tuple[str, str, str, str | None]]:
    """(alias, target, target module, target name) of each name that an import statement binds."""
    if language in ("java", "kotlin", "csharp", "swift"):
        path = "".join(words)
        if extra == "*":
            return [("*", path, path, None)]
        base, _, last = path.rpartition(".")
        return [(extra or last, path, base, last)]
    if language == "go":
        path = words[-1].strip('"`')
        alias = words[0] if len(words) > 1 else path.rpartition("/")[2]
        dotted = path.replace("/", ".")
        return [(alias, dotted, dotted, None)]
    if language == "rust":
        return _uses("".join(" as " if w == "as" else w for w in words))
    if language in ("typescript", "javascript"):
        return _module_imports(words, unit)
    return []


def _uses(text: str, prefix: str = "") -> list[tuple[str, str, str, str | None]]:
    """The names of a use tree."""
    text = text.strip().removeprefix("::")
    if text.endswith("}"):
        head, _, inner = text.partition("{")
        parts, depth, start, inner = [], 0, 0, inner[:-1]
        for k, c in enumerate(inner):
            depth += (c == "{") - (c == "}")
            if c == "," and not depth:
                parts.append(inner[start:k])
                start = k + 1
        parts.append(inner[start:])
        return [x for p in parts if p.strip() for x in _uses(p, prefix + head)]
    path, _, alias = (prefix + text).partition(" as ")
    dotted = path.replace("::", ".").strip(".")
    if dotted.endswith("*"):
        dotted = dotted.removesuffix("*").strip(".")
        return [("*", dotted, dotted, None)]
    dotted = dotted.removesuffix(".self")
    base, _, last = dotted.rpartition(".")
    return [(alias.strip() or last, dotted, base, last)]


def _module_imports(words: list[str], unit: str) -> list[tuple[str, str, str, str | None]]:
    source = words[-1].strip("'\"")
    if source.startswith("."):
        parts = unit.split("/")[:-1]
        for p in source.split("/"):
            if p == "..":
                parts = parts[:-1]
            elif p not in (".", ""):
                parts.append(re.sub(r"\.(?:[cm]?[jt]sx?)$", "", p))
        if parts and parts[-1] == "index":
            parts.pop()
        target = ".".join(parts)
    else:
        target = source.replace("/", ".")
    out, k, named = [], 1, False
    while k < len(words) - 1:
        w = words[k]
        if w in ("{", "}"):
            named = w == "{"
        elif w == "*" and words[k + 1] == "as":
            out.append((words[k + 2], target, target, None))
            k += 2
        elif w == "from" and not named:
            break
        elif w not in (",", "type") and named:
            alias = words[k + 2] if words[k + 1] == "as" else w
            out.append((alias, f"{target}.{w}", target, w))
            k += 2 if words[k + 1] == "as" else 0
        elif w not in (",", "type"):
            out.append((w, target, target, "default"))
        k += 1
    return out or [("", target, target, None)]


def parsed(text: str, language: str) -> tuple[Tokens, Parser, str]:
    """Tokens, parser and normal text; a ValueError for a text that is not valid.

    Of conditional compilation the first text counts: its lines are those of the file.
    """
    text = text.removeprefix("\ufeff").replace("\r\n", "\n").replace("\r", "\n")
    try:
        source = variants(text, language)[0] if language in ("c", "cpp", "csharp", "swift") else text
        tokens, _ = _lexer(language).run(source)
        parser: Parser = _PARSERS[language](tokens)
        parser.parse()
    except (Bad, RecursionError, IndexError) as x:
        raise ValueError(type(x).__name__) from x
    return tokens, parser, source


def walk(repo: str, unit: str, language: str, module: str, text: str) -> list[dict]:
    """The facts of one file: see extract.FACTS."""
    base = {"repo_id": repo, "unit": unit, "module": module}
    try:
        tokens, parser, source = parsed(text, language)
    except ValueError as x:
        return [base | {"fact": "error", "error": str(x)}]
    V, ends, starts = tokens.words, tokens.places, [0, *(m.end() for m in re.finditer("\n", source))]
    line = lambda k: bisect_right(starts, max(0, ends[k] - 1)) if ends else 1
    out = [base | {"fact": "module", "start_line": 1, "end_line": source.count("\n") + 1}]
    for kind, name, first, last, within in parser.found:
        if kind in ("type", "callable"):
            inner = within.split(".")
            at = first - 1
            while at >= 0 and V[at] in ("public", "private", "protected", "internal", "static", "final", "abstract", "export", "default", "async", "open", "override", "data", "sealed", "suspend", "fileprivate", "pub", "readonly", "inline", "const", "enum", "companion", "inner", "partial", "virtual") and line(at) >= line(first) - 1:
                at -= 1
            begin = at + 1
            while V[begin] == "@" and begin < name:  # annotations stand before the definition
                begin += 2
                while V[begin] == "." and begin < name:
                    begin += 2
                if V[begin] == "(":
                    begin = parser.ends[begin] + 1
            body = next((k for k in range(name, last + 1) if V[k] == "{" and not _within_parens(tokens.kinds, name, k)), last + 1)
            lo, hi = ends[begin] - len(V[begin]), ends[body - 1] if body > begin else ends[begin]
            signature = source[lo:hi].strip()
            container = _joined(module, *inner[:-1])
            own = source[ends[body] - 1 : ends[last]] if body <= last else ""
            out.append(base | {
                "fact": "symbol", "name": inner[-1], "qualified_name": _joined(module, within), "container": container, "signature": signature, "start_line": line(begin), "end_line": line(last), "visibility": visibility(language, inner[-1], V[begin:name]),
                "is_type_decl": kind == "type", "body_hash": body_digest(own), "is_top_level": len(inner) == 1,
            })
        elif kind == "import":
            words = V[first : last + 1]
            for alias, target, target_module, target_name in _imports(language, words, within, module, unit):
                out.append(base | {"fact": "import", "alias": alias, "target": target, "target_module": target_module, "target_name": target_name, "start_line": line(first), "source": module, "type_only": "type" in words[:2]})
        else:
            relation = "calls" if kind == "call" else kind
            dotted = ".".join("self" if w in ("this", "self", "Self") else w for w in V[first : last + 1] if w not in (".", "?.", "::", "->"))
            source_name = _joined(module, within)
            shared = {"fact": "name", "relation": relation, "start_line": line(first), "shadowed": False, "source": source_name, "enclosing": source_name}
            out.append(base | shared | {"name": dotted})
            if relation == "calls" and "." not in dotted and language in _BARE_METHODS:
                out.append(base | shared | {"name": f"self.{dotted}"})
            if relation == "calls" and language == "go" and "." in within and "." in dotted:
                out.append(base | shared | {"name": "self." + dotted.partition(".")[2]})
    # a container that is no symbol (a namespace) gives way to what contains it
    known = {r["qualified_name"] for r in out if r["fact"] == "symbol"}
    for r in out:
        if r["fact"] == "symbol":
            while r["container"] != module and r["container"] not in known:
                r["container"] = r["container"].rpartition(".")[0] if r["container"].startswith(module + ".") or not module else module
                if not r["container"]:
                    r["container"] = module
                    break
    return out


def _within_parens(kinds: list[str], start: int, at: int) -> bool:
    depth = 0
    for k in range(start, at):
        depth += (kinds[k] in ("(", "[")) - (kinds[k] in (")", "]"))
    return depth > 0


def code_facts(files: DataFrame) -> DataFrame:
    """The rows of python_facts for files (repo_id, unit, source_text) of the ten other languages."""
    columns = [c.split()[0] for c in FACTS.split(", ")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            found = [r for args in zip(b["repo_id"], b["unit"], b["language"], b["module"], b["source_text"], strict=True) for r in walk(*args)]
            out = pd.DataFrame(found, columns=columns).astype(object)
            yield out.where(out.notna(), None)

    unit = posix(F.col("unit"))
    kept = files.withColumn("language", language_of(F.col("unit"))).filter(F.col("language").isin(*_PARSERS) & F.col("source_text").isNotNull())
    return kept.select("repo_id", unit.alias("unit"), "language", module_qname(unit, F.col("language")).alias("module"), "source_text").mapInPandas(run, FACTS)
