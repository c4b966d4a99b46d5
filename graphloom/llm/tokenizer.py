"""Encoding with a public byte-level BPE vocabulary, from its rank file alone.

Pre-tokenisation uses no regular expression: a batch of texts becomes one array of symbol classes, each class is a
transition function over eight states, and an associative scan composes the functions in blocks, so that the state at
every code point, and with it every boundary, comes from array operations. The slices go through a cached merge of
pairs. Their lengths in bytes are kept for decoding and for cutting texts at token borders.
"""

from __future__ import annotations

import base64
import heapq
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Where the vocabulary files lie; a parameter of every operator, as they are never part of this repository.
TOKENIZERS = "/opt/tokenizers"
VOCABULARY = "byte_bpe_50k.tiktoken"

# Symbols: what a code point is to the pattern. States: what the code point before was.
_WS, _SP, _SDMT, _L_, _V_, _R_, _E_, _LETTER, _NUMBER, _APOS, _OTHER, _END = range(12)
_S_START, _S_WS, _S_SP, _S_L, _S_N, _S_O, _S_A, _S_D = range(8)  # A: an apostrophe that begins a slice, D: a contraction's last letter
_WHITE = [*range(9, 14), 32, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]
_BLOCK = 64


@lru_cache(1)
def _symbols() -> np.ndarray:
    table = np.full(0x110001, _OTHER, np.uint8)
    kinds = "".join(unicodedata.category(chr(c))[0] for c in range(0x110000))
    kinds = np.frombuffer(kinds.encode("ascii"), np.uint8)
    table[:-1][kinds == ord("L")] = _LETTER
    table[:-1][kinds == ord("N")] = _NUMBER
    table[_WHITE] = _WS
    for c, s in ((" ", _SP), ("'", _APOS), ("l", _L_), ("v", _V_), ("r", _R_), ("e", _E_), *((x, _SDMT) for x in "sdmt")):
        table[ord(c)] = s
    table[0x110000] = _END
    return table


@lru_cache(1)
def _transitions() -> np.ndarray:
    """next state by (symbol, state). The two-letter contractions are settled before the scan: their last letters come as _SDMT."""
    t = np.empty((12, 8), np.uint8)
    t[_WS], t[_SP], t[_NUMBER], t[_OTHER], t[_END] = _S_WS, _S_SP, _S_N, _S_O, _S_START
    t[[_SDMT, _L_, _V_, _R_, _E_, _LETTER]] = _S_L
    t[_SDMT, _S_A] = _S_D
    t[_APOS] = _S_A
    t[_APOS, [_S_SP, _S_O, _S_A]] = _S_O
    return t


def scan(symbols: np.ndarray) -> np.ndarray:
    """State after each symbol, by an associative scan: functions composed within blocks, then across them."""
    n = len(symbols)
    if not n:
        return np.empty(0, np.uint8)
    t = _transitions()
    rows = -(-n // _BLOCK)
    grid = np.full(rows * _BLOCK, _END, np.uint8)
    grid[:n] = symbols
    grid = grid.reshape(rows, _BLOCK)
    whole = np.tile(np.arange(8, dtype=np.uint8), (rows, 1))  # the function of each block, composed symbol by symbol
    for k in range(_BLOCK):
        whole = t[grid[:, k][:, None], whole]
    step = 1  # inclusive scan of the blocks' functions: composition is associative, so strides double
    while step < rows:
        later = whole.copy()
        later[step:] = np.take_along_axis(whole[step:], whole[:-step], axis=1)
        whole, step = later, step * 2
    state = np.empty(rows, np.uint8)
    state[0], state[1:] = _S_START, whole[:-1, _S_START]
    out = np.empty((rows, _BLOCK), np.uint8)
    for k in range(_BLOCK):
        state = out[:, k] = t[grid[:, k], state]
    return out.reshape(-1)[:n]


def slice_starts(codes: np.ndarray) -> np.ndarray:
    """True where a slice begins; codes are code points with 0x110000 after each text."""
    s = _symbols()[codes].copy()
    n = len(s)
    if n < 2:
        return np.ones(n, bool)
    pair = np.zeros(n, bool)  # an apostrophe followed by ll, ve or re
    a, b, c = s[:-2], s[1:-1], s[2:]
    pair[:-2] = (a == _APOS) & (((b == _L_) & (c == _L_)) | (((b == _V_) | (b == _R_)) & (c == _E_)))
    state = scan(s)
    begins = (state == _S_A) & (s == _APOS)
    two = np.flatnonzero(pair & begins)
    state[two + 1] = state[two + 2] = _S_D
    before = np.empty(n, np.uint8)
    before[0], before[1:] = _S_START, state[:-1]
    kind = np.array([_S_START, _S_WS, _S_WS, _S_L, _S_N, _S_O, _S_O, _S_D], np.uint8)
    now, was = kind[state], kind[before]
    start = now != was
    start |= begins
    start &= ~((before == _S_SP) & (now != _S_WS) & (now != _S_START))  # a single space goes with what follows it
    done = np.flatnonzero(state == _S_D)
    start[done] = False
    start[1:] |= (state[:-1] == _S_D) & (state[1:] != _S_D)
    # a run of white space leaves its last code point to what follows, unless the text ends there
    ws = now == _S_WS
    follows = np.zeros(n, bool)
    follows[:-1] = ~ws[1:] & (codes[1:] != 0x110000)
    start |= ws & follows & (was == _S_WS)
    start[codes == 0x110000] = True
    start[0] = True
    start[1:] |= codes[:-1] == 0x110000
    return start


def slices(texts: list[str]) -> Iterator[list[str]]:
    """The slices of each text; joined they give the text again."""
    joined = "".join(t + "\x00" for t in texts)
    codes = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32).copy()
    ends = np.cumsum([len(t) + 1 for t in texts]) - 1
    codes[ends] = 0x110000
    starts = np.flatnonzero(slice_starts(codes))
    firsts = np.searchsorted(starts, np.concatenate(([0], ends[:-1] + 1))) if len(ends) else []
    lasts = np.searchsorted(starts, ends) if len(ends) else []
    at = starts.tolist()
    for a, b in zip(firsts, lasts, strict=True):
        yield [joined[at[k] : at[k + 1]] for k in range(a, b)]


class Encoder:
    """Pair merging over a rank file, with a bounded cache of slices."""

    CACHE = 1 << 18

    def __init__(self, path: str):
        with open(path, "rb") as f:
            self.ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}
        self.tokens = {rank: token for token, rank in self.ranks.items()}
        self.cache: dict[str, list[int]] = {}

    def merge(self, data: bytes) -> list[int]:
        """The lowest-ranked adjacent pair is merged first, the leftmost of equals; a heap keeps long slices in n log n."""
        ranks = self.ranks
        if data in ranks:
            return [ranks[data]]
        n = len(data)
        after, before, part = list(range(1, n + 1)), list(range(-1, n - 1)), [data[k : k + 1] for k in range(n)]
        heap = [(r, k, 2) for k in range(n - 1) if (r := ranks.get(data[k : k + 2])) is not None]
        heapq.heapify(heap)
        while heap:
            _, k, size = heapq.heappop(heap)
            j = after[k] if part[k] else n
            if j >= n or len(part[k]) + len(part[j]) != size:
                continue
            part[k], part[j] = part[k] + part[j], b""
            after[k] = after[j]
            if after[k] < n:
                before[after[k]] = k
            for left in (before[k], k):
                right = after[left] if left >= 0 else n
                if right < n and (r := ranks.get(part[left] + part[right])) is not None:
                    heapq.heappush(heap, (r, left, len(part[left]) + len(part[right])))
        return [ranks[p] for p in part if p]

    def slice_ids(self, piece: str) -> list[int]:
        ids = self.cache.get(piece)
        if ids is None:
            ids = self.merge(piece.encode("utf-8", "replace"))
            if len(piece) <= 64:
                if len(self.cache) >= self.CACHE:
                    self.cache.clear()
                self.cache[piece] = ids
        return ids

    def encode(self, pieces: list[str]) -> list[int]:
        get, out = self.cache.get, []
        for piece in pieces:
            out += get(piece) or self.slice_ids(piece)
        return out

    def decode(self, ids) -> str:
        return b"".join(self.tokens[k] for k in ids).decode("utf-8", "replace")


@lru_cache(4)
def encoder(path: str) -> Encoder:
    return Encoder(path)


def _batches(texts: list[str], code_points: int = 1 << 20) -> Iterator[list[str]]:
    batch, size = [], 0
    for t in texts:
        batch.append(t)
        size += len(t)
        if size >= code_points:
            yield batch
            batch, size = [], 0
    if batch:
        yield batch


def _path(tokenizers: str, vocabulary: str) -> str:
    return f"{tokenizers}/{vocabulary}"


def token_ids(text: Column, tokenizers: str = TOKENIZERS, vocabulary: str = VOCABULARY) -> Column:
    """ids of a text, without special tokens (a text that spells one is plain text); an empty array for null or empty."""
    path = _path(tokenizers, vocabulary)

    @F.pandas_udf("array<int>")
    def encode(column: pd.Series) -> pd.Series:
        e = encoder(path)
        return pd.Series([np.array(e.encode(p), np.int32) for b in _batches(column.fillna("").tolist()) for p in slices(b)], dtype=object)

    return encode(text)


def token_count(text: Column, tokenizers: str = TOKENIZERS, vocabulary: str = VOCABULARY) -> Column:
    """Number of ids of a text; 0 for null or empty."""
    path = _path(tokenizers, vocabulary)

    @F.pandas_udf("int")
    def count(column: pd.Series) -> pd.Series:
        e = encoder(path)
        return pd.Series([len(e.encode(p)) for b in _batches(column.fillna("").tolist()) for p in slices(b)], dtype="int32")

    return count(text)


def encode_with_offsets(text: Column, tokenizers: str = TOKENIZERS, vocabulary: str = VOCABULARY) -> Column:
    """struct<ids, ends>: the ids, and the byte of the text's UTF-8 form at which each token ends."""
    path = _path(tokenizers, vocabulary)

    @F.pandas_udf("ids array<int>, ends array<bigint>")
    def encode(column: pd.Series) -> pd.DataFrame:
        e = encoder(path)
        ids = [np.array(e.encode(p), np.int32) for b in _batches(column.fillna("").tolist()) for p in slices(b)]
        return pd.DataFrame({"ids": ids, "ends": [np.cumsum([len(e.tokens[int(k)]) for k in x], dtype=np.int64) for x in ids]})

    return encode(text)


def decoded(ids: Column, tokenizers: str = TOKENIZERS, vocabulary: str = VOCABULARY) -> Column:
    """The text of an array of ids; null for null."""
    path = _path(tokenizers, vocabulary)

    @F.pandas_udf("string")
    def decode(column: pd.Series) -> pd.Series:
        e = encoder(path)
        return column.map(lambda x: None if x is None else e.decode(x))

    return decode(ids)


def encode_corpus(documents: DataFrame, tokenizers: str = TOKENIZERS, vocabulary: str = VOCABULARY) -> DataFrame:
    """doc_id, ids of every document, one row each; needs no shuffle."""
    return documents.select("doc_id", token_ids(F.col("text"), tokenizers, vocabulary).alias("ids"))
