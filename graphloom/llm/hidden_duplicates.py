"""Duplicates hidden by formatting: an incremental ledger of canonical keys.

Rows are copies of each other when repo_id and language are equal (null equal to null) and their signatures agree
after canonical_signature: letter case, white space and punctuation do not count, nor does the order of the parameters
within parentheses, nor empty parameters. What belongs to one parameter stays together.
"""

from __future__ import annotations

import hashlib
import re
from functools import lru_cache

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from graphloom.plans.skew import join_groups
from graphloom.runtime import cut

#: Literals, arrows and comparison signs pass as one piece, so that their signs neither split nor nest.
_PIECE = re.compile(r""""(?:[^"\\]|\\.)*"|'(?:[^'\\]|\\.)*'|[-=]>|[<>]=|[()\[\]{},<>]|[^()\[\]{},<>"'=-]+|.""", re.S)
#: Buckets of a ledger, and batches that a whole table is taken for.
BUCKETS, BATCHES = 256, 4
_CLOSE = {"(": ")", "[": "]", "{": "}", "<": ">"}
_PLAIN = re.compile(r"[a-z0-9]*\Z")


def _plain(text: str) -> str:
    text = text.casefold()
    return text if _PLAIN.match(text) else "".join(filter(str.isalnum, text))


def canonical_signature(signature: str) -> str:
    """Letters and digits in lower case; the top-level parameters of every parenthesis sorted, empty ones dropped.

    A bracket inside a parameter (generic types, defaults, function types) keeps the commas in it together; an angle
    bracket nests only if it is closed before the parenthesis ends. An unclosed parenthesis ends with the text,
    and one without parameters is punctuation like any other.
    """
    pieces = _PIECE.findall(signature)
    n, out, water, at = len(pieces), [], [], 0
    while at < n:
        if pieces[at] != "(":
            water.append(pieces[at])
            at += 1
            continue
        out.append(_plain("".join(water)))
        water, parameters, current, nest = [], [], [], []
        at += 1
        while at < n:
            p = pieces[at]
            if p == ")" and ")" not in nest:
                break
            if p in _CLOSE and (p != "<" or _angle_closes(pieces, at)):
                nest.append(_CLOSE[p])
            elif p in nest:
                while nest.pop() != p:
                    pass
            elif p == "," and not nest:
                parameters.append(_plain("".join(current)))
                current = []
                at += 1
                continue
            current.append(p)
            at += 1
        at += 1
        parameters.append(_plain("".join(current)))
        if kept := sorted(filter(None, parameters)):
            out.append("(" + ",".join(kept) + ")")
    out.append(_plain("".join(water)))
    return "".join(out)


def _angle_closes(pieces: list[str], at: int) -> bool:
    depth = round_depth = 0
    for p in pieces[at:]:
        if p == "<":
            depth += 1
        elif p == ">":
            depth -= 1
            if not depth:
                return True
        elif p == "(":
            round_depth += 1
        elif p == ")":
            round_depth -= 1
            if round_depth < 0:
                return False
    return False


@lru_cache(1 << 16)
def _digest(signature: str) -> bytes:
    return hashlib.blake2b(canonical_signature(signature).encode("utf-8", "replace"), digest_size=16).digest()


@F.pandas_udf(T.BinaryType())
def canonical_digest(signature: pd.Series) -> pd.Series:
    return signature.map(_digest, na_action="ignore")


def keyed(rows: DataFrame, text: str = "signature", order: str = "load_seq", scope: tuple[str, ...] = ("repo_id", "language"), more: tuple[str, ...] = ()) -> DataFrame:
    """copy_key (binary), copy_seq and `more` columns of each row with a text; rows without text or order have no copies."""
    parts = [F.concat(F.coalesce(F.concat(F.lit("="), F.col(c)), F.lit("-")), F.lit("\x1f")).cast("binary") for c in scope]
    whole = F.unhex(F.md5(F.concat(*parts, F.col("digest"))))
    return rows.filter(F.col(text).isNotNull() & F.col(order).isNotNull()).select(*scope, F.col(order).alias("copy_seq"), *more, canonical_digest(F.col(text)).alias("digest")).select(whole.alias("copy_key"), "copy_seq", *more)


def empty_ledger(spark) -> DataFrame:
    return spark.createDataFrame([], "bucket int, copy_key binary, n_copies bigint, keep_seq bigint")


def batch_counts(batch: DataFrame, buckets: int) -> DataFrame:
    """A batch in the ledger's shape, counted before the shuffle, so a key with a third of all rows is one row a task."""
    return batch.groupBy("copy_key").agg(F.count("*").alias("n_copies"), F.min("copy_seq").alias("keep_seq")).select(F.pmod(F.xxhash64("copy_key"), F.lit(buckets)).cast("int").alias("bucket"), "copy_key", "n_copies", "keep_seq")


def update_ledger(ledger: DataFrame | None, batch: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """Add a batch of keyed rows to the ledger: counts are added, the earliest representative is kept.

    Only the buckets that the batch names (their list has at most `buckets` entries) meet it; the others pass untouched.
    """
    new = batch_counts(batch, buckets)
    if ledger is None:
        return new
    new = cut(new)
    touched = F.col("bucket").isin([r.bucket for r in new.select("bucket").distinct().collect()])
    return ledger.filter(~touched).unionByName(_merged(ledger.filter(touched), new))


def _merged(ledger: DataFrame, new: DataFrame) -> DataFrame:
    a, b = ledger.alias("a"), new.alias("b")
    return a.join(b, ["bucket", "copy_key"], "full_outer").select(
        "bucket",
        "copy_key",
        (F.coalesce("a.n_copies", F.lit(0)) + F.coalesce("b.n_copies", F.lit(0))).alias("n_copies"),
        F.least("a.keep_seq", "b.keep_seq").alias("keep_seq"),
    )


# ---------------------------------------------------------------- ledgers in files

_LEDGER = "copy_key binary, n_copies bigint, keep_seq bigint, bucket int"


class StoredLedger:
    """A ledger in files. An update writes the buckets that its batch names, and no others, to a folder of its own, and
    then a manifest, which tells of every bucket the folder that holds it, and of all batches added so far. Readers see
    the newest whole manifest: a broken update leaves the ledger as it was, and to repeat a batch changes nothing.
    """

    def __init__(self, spark, path: str, buckets: int = BUCKETS):
        self.spark, self.path, self.buckets = spark, path.rstrip("/"), buckets

    def _files(self):
        root = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
        return root.getFileSystem(self.spark._jsc.hadoopConfiguration()), self.spark._jvm.org.apache.hadoop.fs.Path

    def versions(self) -> list[int]:
        """Versions whose manifest is whole. Errors of the file system are not taken for an empty ledger."""
        fs, path = self._files()
        at = path(f"{self.path}/manifest")
        if not fs.exists(at):
            return []
        named = [s.getPath().getName() for s in fs.listStatus(at)]
        return sorted(int(n.removeprefix("version=")) for n in named if n.startswith("version=") and fs.exists(path(f"{self.path}/manifest/{n}/_SUCCESS")))

    def _manifest(self) -> tuple[int, dict[int, int], set[str]]:
        known = self.versions()
        if not known:
            return 0, {}, set()
        rows = self.spark.read.schema("bucket int, held_by int, batch_id string").parquet(f"{self.path}/manifest/version={known[-1]}").collect()
        return known[-1], {r.bucket: r.held_by for r in rows if r.bucket is not None}, {r.batch_id for r in rows if r.batch_id is not None}

    def read(self, only: list[int] | None = None) -> DataFrame:
        """bucket, copy_key, n_copies, keep_seq of all buckets, or of those named."""
        _, held, _ = self._manifest()
        folders = [f"{self.path}/data/version={v}/bucket={b}" for b, v in sorted(held.items()) if only is None or b in only]
        if not folders:
            return empty_ledger(self.spark)
        return self.spark.read.option("basePath", f"{self.path}/data").schema(_LEDGER + ", version int").parquet(*folders).select("bucket", "copy_key", "n_copies", "keep_seq")

    def add(self, batch: DataFrame, batch_id: str) -> bool:
        """Add a batch of keyed rows; False if it has been added before."""
        version, held, done = self._manifest()
        if batch_id in done:
            return False
        new = cut(batch_counts(batch, self.buckets))
        touched = [r.bucket for r in new.select("bucket").distinct().collect()]
        merged = _merged(self.read(touched), new) if set(touched) & held.keys() else new
        if touched:  # one file a bucket
            merged.repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(f"{self.path}/data/version={version + 1}")
        rows = [(b, v, None) for b, v in (held | dict.fromkeys(touched, version + 1)).items()] + [(None, None, x) for x in done | {batch_id}]
        self.spark.createDataFrame(rows, "bucket int, held_by int, batch_id string").coalesce(1).write.mode("overwrite").parquet(f"{self.path}/manifest/version={version + 1}")
        return True

    def expire(self) -> None:
        """Remove what neither the newest manifest nor the one before it names."""
        fs, path = self._files()
        kept = self.versions()[-2:]
        named = set()
        for v in kept:
            rows = self.spark.read.schema("bucket int, held_by int, batch_id string").parquet(f"{self.path}/manifest/version={v}").filter("bucket IS NOT NULL").collect()
            named |= {(r.held_by, r.bucket) for r in rows}
        for v in fs.listStatus(path(f"{self.path}/data")) if kept else []:
            number = int(v.getPath().getName().removeprefix("version="))
            if number <= kept[-1]:
                for b in fs.listStatus(v.getPath()):
                    name = b.getPath().getName()
                    if name.startswith("bucket=") and (number, int(name.removeprefix("bucket="))) not in named:
                        fs.delete(b.getPath(), True)
        for v in self.versions()[:-2]:
            fs.delete(path(f"{self.path}/manifest/version={v}"), True)


# ---------------------------------------------------------------- whole tables


def numbered_batches(keys: DataFrame, stamp: str, n: int = BATCHES) -> DataFrame:
    """Rows with their batch: which of n equal spans of time they were loaded in; rows without a stamp are in the first."""
    lo, hi = keys.agg(F.min(stamp), F.max(stamp)).first()
    if lo is None or lo == hi:
        return keys.withColumn("batch", F.lit(0))
    spans = [F.lit(lo + (hi - lo) * k / n) for k in range(1, n)]
    late = sum(((F.col(stamp) > x).cast("int") for x in spans), F.lit(0))
    return keys.withColumn("batch", F.coalesce(late, F.lit(0)))


def ledger_of(keys: DataFrame, n: int = BATCHES, buckets: int = BUCKETS) -> DataFrame:
    """The ledger after all batches of keyed rows (copy_key, copy_seq, batch), one after the other."""
    ledger = None
    for k in range(n):
        ledger = cut(update_ledger(ledger, keys.filter(F.col("batch") == k), buckets))
    return ledger


def _keys_and_ledger(rows: DataFrame, stamp: str) -> tuple[DataFrame, DataFrame]:
    """The kernel runs once: keys and stamps are cut, and feed the batches as well as the join with the groups."""
    keys = cut(keyed(rows, more=(stamp,)))
    keys = numbered_batches(keys, stamp).drop(stamp)
    return keys, ledger_of(keys)


def copies(keys: DataFrame, ledger: DataFrame) -> DataFrame:
    """keep_seq, copy_seq of every row that is not its group's representative (load order is unique)."""
    groups = ledger.filter(F.col("n_copies") > 1).select("copy_key", "n_copies", "keep_seq")
    total = groups.agg(F.sum("n_copies")).first()[0] or 0
    return join_groups(keys, groups, "copy_key", F.col("n_copies"), total).filter(F.col("copy_seq") != F.col("keep_seq")).select("keep_seq", "copy_seq")


def hidden_duplicates(rows: DataFrame, stamp: str = "loaded_at") -> DataFrame:
    """keep_seq, copy_seq of all rows with a signature, by the bucketed ledger of their batches.

    Rows without signature, or without load_seq, have no copies; a null repo_id or language equals null. Repeated rows of
    one load_seq are copies of each other.
    """
    return copies(*_keys_and_ledger(rows, stamp))


def deduplicated(rows: DataFrame, stamp: str = "loaded_at") -> DataFrame:
    """One record for each symbol, the earliest, with the number of its copies."""
    return _keys_and_ledger(rows, stamp)[1].select("keep_seq", "n_copies")
