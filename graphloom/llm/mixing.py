"""Mixes of sources with target shares of the tokens, small sources repeated up to a cap.

Per source the documents, in a pseudorandom order, form one stream of tokens, which is cut into blocks of fixed length
without regard to where documents begin or end. A mix has as many slots as its tokens need, each for one block; how many
slots of which source every output shard gets is drawn from a multinomial distribution. The slots of a source run through
its blocks epoch after epoch, each in the order of a pseudorandom permutation of the block indices, and the blocks are
joined to the slots by index.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from graphloom.llm.tokenizer import TOKENIZERS, VOCABULARY, token_count
from graphloom.runtime import cut, small

BLOCK_TOKENS = 256
SEED = 20310301
SHARDS = 64
#: Slots that one row stands for until the rows are spread over all tasks.
SLOT_RUN = 1 << 16


def sized(documents: DataFrame, tokenizers: str = TOKENIZERS, vocabulary: str = VOCABULARY) -> DataFrame:
    """doc_id, source, n_tokens; null and empty texts have 0 tokens."""
    return documents.select("doc_id", "source", token_count(F.col("text"), tokenizers, vocabulary).cast("bigint").alias("n_tokens"))


def prefix_sums(df: DataFrame, group: list[str], bucket: str, order: list[str], value: str, out: str) -> DataFrame:
    """Sum of `value` over the rows before, within `group`, in the order of (bucket, order).

    Two levels: sums of buckets, then within each bucket. No task holds more than a bucket, or the buckets of a group.
    """
    sums = df.groupBy(*group, bucket).agg(F.sum(value).alias("bucket_sum"))
    w = Window.partitionBy(*group).orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)
    base = sums.select(*group, bucket, F.coalesce(F.sum("bucket_sum").over(w), F.lit(0)).alias("base"))
    v = Window.partitionBy(*group, bucket).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    inner = df.withColumn("before", F.coalesce(F.sum(value).over(v), F.lit(0)))
    return inner.join(small(base), [*group, bucket]).withColumn(out, F.col("base") + F.col("before")).drop("base", "before")


def pack(docs: DataFrame, n_docs: int, block: int = BLOCK_TOKENS, seed: int = SEED) -> DataFrame:
    """source, doc_id, block, first_token, n_tokens: the pieces of the documents with tokens and a source in each block.

    Every block of a source but its last has exactly `block` tokens; first_token is the place in the document. Both levels
    of the prefix sum hold about the square root of the number of documents.
    """
    buckets = max(16, int(n_docs**0.5))
    mixed = docs.filter((F.col("n_tokens") > 0) & F.col("source").isNotNull()).select("doc_id", "source", "n_tokens", F.xxhash64(F.lit(seed), "doc_id").alias("mixed")).withColumn("bucket", F.pmod("mixed", F.lit(buckets)).cast("int"))
    placed = prefix_sums(mixed, ["source"], "bucket", ["mixed", "doc_id"], "n_tokens", "at")
    first, last = F.floor(F.col("at") / block), F.floor((F.col("at") + F.col("n_tokens") - 1) / block)
    spread = placed.select("source", "doc_id", "at", F.col("n_tokens").alias("size"), F.explode(F.sequence(first, last)).alias("block"))
    begin = F.greatest(F.col("at"), F.col("block") * block)
    end = F.least(F.col("at") + F.col("size"), (F.col("block") + 1) * block)
    return spread.select("source", "doc_id", F.col("block").cast("bigint").alias("block"), (begin - F.col("at")).alias("first_token"), (end - begin).alias("n_tokens"))


def permuted(index: np.ndarray, n: np.ndarray, key: np.ndarray) -> np.ndarray:
    """Position of each index under its key's permutation of range(n): a Feistel network with cycle walking."""
    index, n, key = index.astype(np.uint64), n.astype(np.uint64), key.astype(np.uint64)
    half = np.maximum(1, np.ceil(np.log2(np.maximum(n, np.uint64(2)).astype(float)) / 2)).astype(np.uint64)
    mask = (np.uint64(1) << half) - np.uint64(1)
    out, todo = index.copy(), np.ones(len(index), bool)
    with np.errstate(over="ignore"):
        while todo.any():
            x, h, m, k = out[todo], half[todo], mask[todo], key[todo]
            left, right = x >> h, x & m
            for r in range(4):
                f = (right + k + np.uint64(r * 0x9E3779B9)) * np.uint64(0x9E3779B97F4A7C15)
                f ^= f >> np.uint64(29)
                f *= np.uint64(0xBF58476D1CE4E5B9)
                f ^= f >> np.uint64(32)
                left, right = right, left ^ (f & m)
            out[todo] = (left << h) | right
            todo = out >= n
    return out.astype(np.int64)


def _positions():
    @F.pandas_udf("bigint")
    def run(index: pd.Series, n: pd.Series, key: pd.Series) -> pd.Series:
        return pd.Series(permuted(index.to_numpy(), n.to_numpy(), key.to_numpy()))

    return run


def dealt(rng: np.random.Generator, totals: np.ndarray, shards: int) -> np.ndarray:
    """Slots of each shard (rows) and source (columns): a multinomial draw per shard, then brought to the exact totals.

    Free draws miss a source's total by about its square root, which in a small mix is several per cent of a share. What a
    source has too much goes to one that has too little, within shards drawn by what they hold of the first, so that no
    shard changes its size. The same is done at every size.
    """
    totals = np.asarray(totals, np.int64)
    whole = int(totals.sum())
    sizes = [whole * (k + 1) // shards - whole * k // shards for k in range(shards)]
    share = totals / max(1, whole)
    counts = np.array([rng.multinomial(n, share) for n in sizes], np.int64).reshape(shards, len(totals))
    while (off := counts.sum(0) - totals).any():
        much, little = int(off.argmax()), int(off.argmin())
        held = counts[:, much]
        moved = np.minimum(rng.multinomial(min(off[much], -off[little]), held / held.sum()), held)
        counts[:, much] -= moved
        counts[:, little] += moved
    return counts


class Mix:
    """The plan of all mixes over sized documents. The driver holds one number per mix, source and shard.

    A source gives its wanted tokens, or max_repeats times all it has, to within one and a half blocks: the slots are
    whole, and the last block of a source is shorter than the others.
    """

    def __init__(self, docs: DataFrame, targets: DataFrame, block: int = BLOCK_TOKENS, seed: int = SEED, shards: int = SHARDS):
        spark = docs.sparkSession
        docs = cut(docs.select("doc_id", "source", "n_tokens"))  # counted once: a row of three numbers a document
        n_docs, total = docs.agg(F.count("*"), F.coalesce(F.sum("n_tokens"), F.lit(0))).first()
        self.block = block
        self.pieces = pack(docs, n_docs, block, seed)
        supply = docs.filter(F.col("n_tokens") > 0).groupBy("source").agg(F.sum("n_tokens").alias("have"))
        ask = (
            targets.filter(F.col("mix_name").isNotNull() & F.col("source").isNotNull())
            .groupBy("mix_name", "source")
            .agg(F.sum("target_share").alias("target_share"), F.min("max_repeats").alias("max_repeats"), F.max("total_ratio").alias("total_ratio"))
            .join(small(supply), "source", "left")
            .fillna(0, ["have"])
        )
        wanted = F.greatest(F.coalesce(F.round(F.col("target_share") * F.col("total_ratio") * F.lit(total)).cast("bigint"), F.lit(0)), F.lit(0))
        blocks = F.ceil(F.col("have") / block).cast("bigint")
        most = blocks * F.greatest(F.coalesce("max_repeats", F.lit(1)), F.lit(0))
        self.ask = cut(ask.withColumn("wanted_tokens", wanted).withColumn("n_blocks", blocks).withColumn("n_slots", F.least(F.coalesce(F.round(F.try_divide(F.col("wanted_tokens") * blocks, F.col("have"))), F.lit(0)).cast("bigint"), most)))
        slots = _slots(spark, self._draw(seed, shards), seed)
        #: mix_name, shard, source, slot, block: one row for every use of a block.
        self.slots = slots
        # by source and block first: the uses are counted, and then meet their pieces, without another shuffle
        self.uses = slots.repartition("source", "block").groupBy("source", "block", "mix_name").agg(F.count("*").cast("int").alias("n_uses"))

    def _draw(self, seed: int, shards: int) -> list[tuple]:
        """mix_name, source, shard, first slot, number of slots, number of the source's blocks."""
        asked = self.ask.filter("n_slots > 0").select("mix_name", "source", "n_slots", "n_blocks").collect()
        out = []
        for mix in sorted({r.mix_name for r in asked}):
            own = sorted((r.source, r.n_slots, r.n_blocks) for r in asked if r.mix_name == mix)
            counts = dealt(np.random.default_rng([seed, *mix.encode()]), np.array([n for _, n, _ in own]), shards)
            for j, (source, _, n_blocks) in enumerate(own):
                ends = np.cumsum(counts[:, j])
                out += [(mix, source, k, int(ends[k] - counts[k, j]), int(counts[k, j]), n_blocks) for k in range(shards) if counts[k, j]]
        return out

    def documents(self) -> DataFrame:
        """mix_name, source, doc_id, n_uses, used_tokens: the documents of each mix, how often each is used at most, and how
        many of its tokens the mix has in all. A document at the end of a partial epoch may be used in part."""
        met = self.pieces.join(self.uses, ["source", "block"])
        return met.groupBy("mix_name", "source", "doc_id").agg(F.max("n_uses").alias("n_uses"), F.sum(F.col("n_uses") * F.col("n_tokens")).alias("used_tokens"))

    def shares(self) -> DataFrame:
        """mix_name, source, target_share, wanted_tokens, reached_tokens and reached_share of the mix's tokens.

        All blocks are full but the last of each source.
        """
        last = self.uses.join(small(self.ask.select("mix_name", "source", F.col("n_blocks") - 1)).toDF("mix_name", "source", "block"), ["mix_name", "source", "block"], "left_semi")
        short = last.select("mix_name", "source", F.col("n_uses").alias("last_uses"))
        lacking = F.coalesce("last_uses", F.lit(0)) * (F.col("n_blocks") * self.block - F.col("have"))
        reached = F.col("n_slots") * self.block - lacking
        all_ = F.sum("reached_tokens").over(Window.partitionBy("mix_name"))
        return (
            self.ask.join(short, ["mix_name", "source"], "left")
            .withColumn("reached_tokens", reached)
            .select("mix_name", "source", "target_share", "wanted_tokens", "reached_tokens", F.coalesce(F.try_divide(F.col("reached_tokens").cast("double"), all_), F.lit(0.0)).alias("reached_share"))
        )

    def shards(self) -> DataFrame:
        """mix_name, shard, source, slot, block, doc_id, first_token, n_tokens: the pieces of every shard of the output."""
        return self.slots.join(self.pieces, ["source", "block"]).select("mix_name", "shard", "source", "slot", "block", "doc_id", "first_token", "n_tokens")


def _slots(spark, runs: list[tuple], seed: int, run: int = SLOT_RUN) -> DataFrame:
    """One row for each slot, with its block: the slot's place in its epoch, through that epoch's permutation."""
    drawn = spark.createDataFrame(runs, "mix_name string, source string, shard int, first bigint, n bigint, n_blocks bigint")
    parts = drawn.withColumn("part", F.explode(F.sequence(F.lit(0).cast("bigint"), F.floor((F.col("n") - 1) / run).cast("bigint"))))
    low = F.col("first") + F.col("part") * run
    high = F.least(low + run, F.col("first") + F.col("n")) - 1
    spread = parts.withColumn("low", low).withColumn("high", high).repartition("mix_name", "source", "shard", "part")
    each = spread.select("mix_name", "source", "shard", "n_blocks", F.explode(F.sequence("low", "high")).alias("slot"))
    key = F.xxhash64(F.lit(seed), "mix_name", "source", F.floor(F.col("slot") / F.col("n_blocks")))
    return each.select("mix_name", "shard", "source", "slot", _positions()(F.pmod("slot", "n_blocks"), "n_blocks", key).alias("block"))


def plan(documents: DataFrame, targets: DataFrame, tokenizers: str = TOKENIZERS) -> Mix:
    """The mixes of mix_targets over the documents' tokens; see Mix. Documents of other sources or without tokens are unused."""
    return Mix(sized(documents, tokenizers), targets)
