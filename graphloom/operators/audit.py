"""The decision ledger, its chain and coverage; contracts; statistics of runs; precision and recall."""

from __future__ import annotations

import hashlib
import json

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from graphloom.functions.signatures import canonical_digest

RECENT_COMMITS = 20


def decision_hash(kind: str, tree: str | None, evidence: dict) -> str:
    """Token of a decision; the same gate on the same tree gives it again."""
    return canonical_digest({"type": kind, "tree": tree, "evidence": evidence})


@F.pandas_udf(T.StringType())
def entry_hash(entry: pd.Series) -> pd.Series:
    """Hash of a ledger line without its own hash; null for what is not a JSON object."""
    import json

    def one(x):
        try:
            e = json.loads(x)
            return canonical_digest({k: v for k, v in e.items() if k != "hash"})
        except (TypeError, ValueError, AttributeError):
            return None

    return pd.Series([one(x) for x in entry], dtype=object)


def verify_ledger(lines: DataFrame) -> DataFrame:
    """ok, failing position and reason of a ledger (pos, line): the first broken line, changed entry or broken link.

    A ledger is written by one writer, one line a decision, so its order is one window.
    """
    e = lines.withColumn("hash", F.get_json_object("line", "$.hash")).withColumn("prev", F.get_json_object("line", "$.prev")).withColumn("own", entry_hash("line"))
    before = F.coalesce(F.lag("hash").over(Window.orderBy("pos")), F.lit(""))
    reason = F.when(F.col("own").isNull(), "corrupt").when(~F.col("own").eqNullSafe(F.col("hash")), "hash mismatch").when(~F.col("prev").eqNullSafe(before), "chain break")
    bad = e.withColumn("reason", reason).filter("reason IS NOT NULL")
    return bad.agg(F.min(F.struct("pos", "reason")).alias("first")).select(F.col("first").isNull().alias("ok"), F.col("first.pos").alias("pos"), F.col("first.reason").alias("reason"))


def hash_chain(events: DataFrame, key: str, order: list[str], payload: Column) -> DataFrame:
    """Each row's digest and the one before it within its key: links of many independent chains."""
    w = Window.partitionBy(key).orderBy(*order)
    own = F.sha2(payload.cast("binary"), 256)
    return events.withColumn("digest", own).withColumn("prev", F.coalesce(F.lag("digest").over(w), F.lit("")))


def gate_coverage(commits: DataFrame, passes: DataFrame, recent: int = RECENT_COMMITS) -> DataFrame:
    """status of each of the newest commits (seq, sha, tree): verified or bypass; and pending stamps without commit."""
    stamped = passes.filter("tree IS NOT NULL").select("tree").distinct()
    last = commits.orderBy(F.desc("seq")).limit(recent)
    seen = last.join(stamped.withColumn("stamped", F.lit(True)), "tree", "left").select(F.col("sha").alias("what"), F.when(F.col("stamped"), "verified").otherwise("bypass").alias("status"))
    return seen.unionByName(stamped.join(commits.select("tree"), "tree", "left_anti").select(F.col("tree").alias("what"), F.lit("pending").alias("status")))


def proves(token: object, lock: object) -> bool:
    return isinstance(token, str) and isinstance(lock, str) and hashlib.blake2b(token.encode()).hexdigest() == lock


def lock_walk(entries: DataFrame) -> DataFrame:
    """contract_key, is_open, governing seq after an ordered walk of each contract's entries (seq, type, lock_hash, ...).

    A locked contract is taken over only with the proof of its lock, and closed only as abandoned or with that proof;
    any other line is ignored. One contract's entries are few: declarations and closings by hand.
    """

    def walk(pdf: pd.DataFrame) -> pd.DataFrame:
        governing, is_open = None, False
        for r in pdf.sort_values("seq").itertuples():
            lock = governing.lock_hash if is_open and governing is not None else None
            if r.type == "contract_declared":
                if isinstance(lock, str) and not proves(r.prior_token, lock):
                    continue
                governing, is_open = r, True
            elif r.type == "contract_closed":
                if isinstance(lock, str) and not str(r.disposition or "").startswith("abandoned") and not proves(r.lock_token, lock):
                    continue
                governing, is_open = None, False
        return pd.DataFrame([(pdf["contract_key"].iloc[0], is_open, None if governing is None else int(governing.seq))], columns=["contract_key", "is_open", "seq"])

    return entries.groupBy("contract_key").applyInPandas(walk, "contract_key string, is_open boolean, seq bigint")


def check_runs(runs: DataFrame) -> DataFrame:
    """Per check command: runs, failures and whether it never failed in at least five runs."""
    each = runs.select(F.explode("checks").alias("c")).select("c.run", "c.failed")
    return each.groupBy("run").agg(F.count("*").alias("runs"), F.sum(F.col("failed").cast("int")).alias("failures")).withColumn("unfalsified", (F.col("runs") >= 5) & (F.col("failures") == 0))


def phase_percentiles(spans: DataFrame, phase: str, value: str) -> DataFrame:
    """count, p50, p95, p99 of a value by phase, exact and interpolated."""
    p = F.percentile(value, F.array(F.lit(0.5), F.lit(0.95), F.lit(0.99)))
    return spans.filter(F.col(value).isNotNull()).groupBy(phase).agg(F.count("*").alias("n"), p.alias("p")).select(phase, "n", *[F.round(F.col("p")[k], 9).alias(x) for k, x in enumerate(("p50", "p95", "p99"))])


def summary(df: DataFrame, by: str, value: str) -> DataFrame:
    """mean, sample deviation, least and greatest."""
    return df.groupBy(by).agg(F.round(F.avg(value), 6).alias("mean"), F.round(F.stddev_samp(value), 6).alias("stdev"), F.min(value).alias("least"), F.max(value).alias("greatest"))


def precision_recall(predicted: DataFrame, truth: DataFrame, case: str, item: str) -> DataFrame:
    """precision, recall, f1 by case over sets; an empty denominator counts as 1."""
    p = predicted.select(case, item).distinct().withColumn("p", F.lit(1))
    t = truth.select(case, item).distinct().withColumn("t", F.lit(1))
    both = p.join(t, [case, item], "full_outer").groupBy(case).agg(F.coalesce(F.sum("p"), F.lit(0)).alias("np"), F.coalesce(F.sum("t"), F.lit(0)).alias("nt"), F.coalesce(F.sum(F.col("p") * F.col("t")), F.lit(0)).alias("hit"))
    pr = both.withColumn("precision", F.when(F.col("np") == 0, 1.0).otherwise(F.col("hit") / F.col("np"))).withColumn("recall", F.when(F.col("nt") == 0, 1.0).otherwise(F.col("hit") / F.col("nt")))
    s = F.col("precision") + F.col("recall")
    return pr.select(case, "precision", "recall", F.when(s == 0, 0.0).otherwise(2 * F.col("precision") * F.col("recall") / s).alias("f1"))


def refusal_budget(stops: DataFrame, budget: int = 3) -> DataFrame:
    """Each stop (session, seq, satisfied): refused while the unsatisfied ones of its session are within the budget."""
    w = Window.partitionBy("session").orderBy("seq").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    n = F.sum((~F.col("satisfied")).cast("int")).over(w)
    return stops.withColumn("outcome", F.when(F.col("satisfied"), "allowed").when(n <= budget, "refused").otherwise("unsatisfied_stop"))


def parse_contract(text: str) -> dict:
    """A contract of JSON text: known keys only, sane timeouts, at least one check or attestation; else ValueError."""
    import json

    raw = json.loads(text)
    if not isinstance(raw, dict) or (unknown := set(raw) - {"title", "checks", "attestations", "scope", "timeout_s"}):
        raise ValueError(f"unknown keys: {sorted(unknown) if isinstance(raw, dict) else 'not an object'}")
    timeout = raw.get("timeout_s", 600)
    if isinstance(timeout, bool) or not isinstance(timeout, int | float) or not 0 < timeout < 1e6:
        raise ValueError("timeout_s must be a positive number of seconds")
    for key in ("checks", "attestations", "scope"):
        if not isinstance(raw.get(key, []), list) or not all(isinstance(x, str) and x.strip() for x in raw.get(key, [])):
            raise ValueError(f"{key} must be a list of texts")
    if not raw.get("checks") and not raw.get("attestations"):
        raise ValueError("a contract needs a check or an attestation")
    return {"title": raw.get("title", ""), "checks": raw.get("checks", []), "attestations": raw.get("attestations", []), "scope": raw.get("scope", []), "timeout_s": float(timeout)}


def missing_attestations(required: DataFrame, ledger: DataFrame) -> DataFrame:
    """Attestations (contract_hash, tree, name) that no ledger line gives for the same contract and tree."""
    given = ledger.filter("type = 'attestation'").select("contract_hash", "tree", "name").distinct()
    return required.join(given, ["contract_hash", "tree", "name"], "left_anti")


# ---------------------------------------------------------------- writing ledgers, evidence of contracts


def ledger_entry(seq: int, prev: str, kind: str, evidence: dict, actor: dict, tree: str | None = None, ts: int = 0) -> dict:
    """One entry, linked to the one before it by `prev` and sealed by its own hash."""
    entry = {"v": 1, "seq": seq, "ts": ts, "type": kind, "actor": actor, "tree": tree, "evidence": evidence, "decision_hash": decision_hash(kind, tree, evidence), "prev": prev}
    return entry | {"hash": canonical_digest(entry)}


def append_ledger(spark, path: str, decisions: list[dict]) -> int:
    """Append decisions (type, evidence, actor, tree, ts) to a ledger of JSON lines; the number of the last entry.

    A ledger has one writer. Its head (the last number and hash) is read from the newest part, whose name is its first
    number, so an append reads one part however long the ledger is. A part that was not finished does not count.
    """
    fs_path = spark._jvm.org.apache.hadoop.fs.Path
    root = fs_path(path)
    fs = root.getFileSystem(spark._jsc.hadoopConfiguration())
    names = [s.getPath().getName() for s in fs.listStatus(root)] if fs.exists(root) else []
    parts = sorted(n for n in names if n.startswith("from=") and fs.exists(fs_path(f"{path}/{n}/_SUCCESS")))
    seq, prev = 0, ""
    if parts:
        last = max((json.loads(r.value) for r in spark.read.text(f"{path}/{parts[-1]}").collect()), key=lambda e: e["seq"])
        seq, prev = last["seq"], last["hash"]
    lines = []
    for d in decisions:
        seq += 1
        e = ledger_entry(seq, prev, d["type"], d.get("evidence", {}), d.get("actor", {}), d.get("tree"), d.get("ts", 0))
        prev = e["hash"]
        lines.append((json.dumps(e, sort_keys=True),))
    if lines:
        first = seq - len(lines) + 1
        spark.createDataFrame(lines, "value string").coalesce(1).write.mode("overwrite").text(f"{path}/from={first:020d}")
    return seq


def ledger_lines(spark, path: str) -> DataFrame:
    """pos, line of a written ledger, in the order of its entries."""
    lines = spark.read.text(path).select(F.col("value").alias("line"))
    return lines.select(F.get_json_object("line", "$.seq").cast("bigint").alias("pos"), "line")


def append_stream(stream: DataFrame, path: str, checkpoint: str, trigger: dict | None = None):
    """Append the decisions of a stream (type, evidence as JSON, at) with a running chain: one writer, batch by batch.

    A batch that is repeated after a failure is told by its number, which its entries carry, and not written twice.
    """

    def write(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        rows = batch.orderBy("at").collect()  # decisions are made one by one: a batch of them is small
        there = spark._jvm.org.apache.hadoop.fs.Path(path)
        if there.getFileSystem(spark._jsc.hadoopConfiguration()).exists(there):
            done = ledger_lines(spark, path).filter(F.get_json_object("line", "$.evidence.batch").cast("bigint") == number)
            if not done.isEmpty():
                return
        append_ledger(spark, path, [{"type": r["type"], "evidence": json.loads(r["evidence"] or "{}") | {"batch": number}} for r in rows])

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def contract_evidence(lines: DataFrame) -> DataFrame:
    """One row: contracts declared, their checks and attestations, and the checks that never failed in at least five runs."""
    e = lines.select(F.get_json_object("line", "$.type").alias("type"), "line")
    texts = lambda path: F.coalesce(F.from_json(F.get_json_object("line", path), "array<string>"), F.array().cast("array<string>"))
    declared = e.filter("type = 'contract_declared'").agg(F.count("*").alias("declared"), F.coalesce(F.sum(F.size(texts("$.evidence.contract.checks"))), F.lit(0)).alias("checks"), F.coalesce(F.sum(F.size(texts("$.evidence.contract.attest"))), F.lit(0)).alias("attests"))
    runs = e.filter(F.col("type").isin("contract_pass", "contract_fail", "sealed_pass", "sealed_fail")).select(F.explode(F.from_json(F.get_json_object("line", "$.evidence.checks"), "array<struct<run:string,exit:int>>")).alias("c"))
    folded = runs.select(F.array_join(F.filter(F.split(F.coalesce("c.run", F.lit("")), r"\s+"), lambda x: x != ""), " ").alias("run"), (F.coalesce("c.exit", F.lit(1)) != 0).alias("failed"))
    never = folded.groupBy("run").agg(F.count("*").alias("n"), F.sum(F.col("failed").cast("int")).alias("bad")).filter("n >= 5 AND bad = 0")
    return declared.crossJoin(never.agg(F.array_join(F.array_sort(F.collect_list("run")), "\n").alias("unfalsified")))
