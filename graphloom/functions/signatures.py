"""Normal form of signatures, node ids and content hashes, as vectorised functions."""

from __future__ import annotations

import hashlib
import json
import re
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Words that may stand before a declaration's name, by language.
LEADING = {
    "python": "async def class",
    "typescript": "export default declare abstract async function class interface public private protected static readonly const let var get set",
    "java": "public private protected static final abstract default synchronized native strictfp transient volatile class interface enum record",
    "go": "func type",
    "rust": "pub(crate) pub(super) pub(self) pub async unsafe const extern default fn struct enum trait union type impl",
    "javascript": "export default async function class static const let var get set",
    "csharp": "public private protected internal static abstract sealed virtual override readonly async partial extern unsafe new class interface struct enum record delegate",
    "c": "static extern inline register auto const volatile typedef struct union enum unsigned signed",
    "cpp": "static extern inline virtual explicit friend constexpr const volatile typedef struct union enum class namespace template unsigned signed",
    "kotlin": "public private protected internal open abstract final sealed data inner override suspend inline operator infix fun class object interface enum val var const companion",
    "swift": "public private fileprivate internal open final static class override convenience required lazy mutating func struct enum protocol extension let var init",
}
_HEAD = {k: re.compile(r"(?:(?:%s)[ ]\s*)+" % "|".join(sorted(map(re.escape, v.split()), key=len, reverse=True))) for k, v in LEADING.items()}
_HEAD["python"] = re.compile(r"(?:(?:async def|def|class)[ ]\s*)+")
for _k in ("typescript", "javascript"):  # `default` only follows `export`
    _HEAD[_k] = re.compile(r"(?:(?:export default|%s)[ ]\s*)+" % "|".join(w for w in LEADING[_k].split() if w != "default"))
_RECEIVERS = {"python": {"self", "cls"}, "rust": {"self"}}
_PARTS = re.compile(r"[(\[{<]|[)\]}>]|,|[^(\[{<)\]}>,]+")
_NAME_END = re.compile(r"[:=? \t]")
_ANNOTATION = re.compile(r"@\w[\w.]*(?:\s*\([^)]*\))?")


def split_parameters(text: str) -> list[str]:
    """Parameters between commas outside all brackets; an empty last one is none."""
    out, part, depth = [], [], 0
    for piece in _PARTS.findall(text):
        if piece == "," and not depth:
            out.append("".join(part))
            part = []
            continue
        depth = depth + 1 if piece in "([{<" else max(0, depth - 1) if piece in ")]}>" else depth
        part.append(piece)
    last = "".join(part).strip()
    return [*out, last] if last else out


def _name(text: str) -> str:
    text = re.split(r"[<{ \t]", text.strip(), maxsplit=1)[0]
    return text.rstrip("=").strip()


def _java_type(parameter: str) -> str | None:
    text, depth = [], 0
    for c in _ANNOTATION.sub(" ", parameter):
        depth = depth + 1 if c == "<" else max(0, depth - 1) if c == ">" else depth
        if not depth and c != ">":
            text.append(c)
    words = [w for w in "".join(text).replace("...", "[]").split() if w != "final"]
    if not words or words[0] == "/":
        return None
    arrays = ""
    if len(words) > 1:
        name = words.pop()
        arrays = "[]" * ((len(name) - len(re.sub(r"(?:\[\])+$", "", name))) // 2)
    kind = "".join(words) + arrays
    bare = re.sub(r"(?:\[\])+$", "", kind)
    return bare.rsplit(".", 1)[-1] + kind[len(bare) :]


def _parameter(text: str, language: str) -> str | None:
    if language == "java":
        return _java_type(text)
    text = text.strip().lstrip("*.&")
    if text.startswith("mut "):
        text = text[4:].lstrip()
    return None if text == "/" else _NAME_END.split(text, maxsplit=1)[0] or None


@lru_cache(1 << 16)
def normal_signature(raw: str, language: str = "python") -> str:
    """name(p1,p2,...): leading words and receivers dropped, types and defaults too (Java is keyed by parameter type)."""
    text = raw.strip().rstrip(":").strip()
    if head := _HEAD.get(language, _HEAD["python"]).match(text):
        text = text[head.end() :]
    before, paren, rest = text.partition("(")
    if not paren:
        return _name(text)
    words = re.findall(r"[A-Za-z_$][\w$]*", before) if language == "java" else []
    name = words[-1] if words else _name(before)
    depth, end = 1, len(rest)
    for m in re.finditer(r"[()]", rest):
        depth += 1 if m[0] == "(" else -1
        if not depth:
            end = m.start()
            break
    skipped = _RECEIVERS.get(language, ())
    kept = [p for x in split_parameters(rest[:end]) if (p := _parameter(x, language)) and p not in skipped]
    return f"{name}({','.join(kept)})"


@F.pandas_udf(T.StringType())
def normalize_signature(signature: pd.Series, language: pd.Series) -> pd.Series:
    """Null for a null signature; a null language counts as Python."""
    return pd.Series([None if pd.isna(s) else normal_signature(s, "python" if pd.isna(x) else x) for s, x in zip(signature, language, strict=True)], dtype=object)


ID_VERSION = 2


def node_key(repo_id: str, qualified_name: str, kind: str, ordinal: int | None = None, language: str = "python") -> str:
    if not repo_id or not qualified_name:
        raise ValueError("repo_id and qualified_name must not be empty")
    fields = (f"v{ID_VERSION}", repo_id, language, qualified_name, kind, "" if ordinal is None else str(ordinal))
    return hashlib.blake2b("\x1f".join(fields).encode(), digest_size=16).hexdigest()


@F.pandas_udf(T.StringType())
def node_id(repo_id: pd.Series, qualified_name: pd.Series, kind: pd.Series, ordinal: pd.Series, language: pd.Series) -> pd.Series:
    """The stable id of a node; null where repository or name is null or empty."""
    return pd.Series([node_key(r, q, k, None if pd.isna(o) else int(o), "python" if pd.isna(x) else x) if r and q else None for r, q, k, o, x in zip(repo_id, qualified_name, kind, ordinal, language, strict=True)], dtype=object)


def body_digest(text: str | None) -> str | None:
    folded = re.sub(r"[ \t\n\r\x0b\f]+", " ", text or "").strip()
    return hashlib.blake2b(folded.encode("utf-8", "replace"), digest_size=16).hexdigest() if folded else None


@F.pandas_udf(T.StringType())
def body_hash(text: pd.Series) -> pd.Series:
    return pd.Series([None if pd.isna(x) else body_digest(x) for x in text], dtype=object)


def canonical_json(value: object) -> bytes:
    return json.dumps(value, sort_keys=True, separators=(",", ":")).encode()


def canonical_digest(value: object) -> str:
    return hashlib.blake2b(canonical_json(value)).hexdigest()


@F.pandas_udf(T.StringType())
def canonical_hash(text: pd.Series) -> pd.Series:
    """Hash of a JSON text in canonical form; null for what is not JSON."""

    def one(x):
        try:
            return canonical_digest(json.loads(x))
        except (TypeError, ValueError):
            return None

    return pd.Series([one(x) for x in text], dtype=object)


def folded(text: Column) -> Column:
    """Runs of white space as single blanks, in the JVM; null for nothing but white space."""
    out = F.trim(F.regexp_replace(text, r"[ \t\n\r\x0B\f]+", " "))
    return F.when(out != "", out)
