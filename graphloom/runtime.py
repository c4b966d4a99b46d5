"""Session helpers shared by all operators: table loading, checkpoints, checked broadcasts."""

from __future__ import annotations

import tempfile
import weakref

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A side may be broadcast by hint only when its estimated size is below this.
BROADCAST_BYTES = 8 << 20


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One table of a data directory."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The folder that spark.checkpoint.dir names. Where the setting is absent, a folder of this machine serves in local
    mode only; on a cluster, whose executors share no such folder, that is an error."""
    sc = spark.sparkContext
    current = sc._jsc.sc().getCheckpointDir()
    if current.isDefined():
        return current.get()
    named = spark.conf.get("spark.checkpoint.dir", "") or sc.getConf().get("spark.checkpoint.dir", "")
    if not named and not sc.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="graphloom-"))
    return sc._jsc.sc().getCheckpointDir().get()


def cut(df: DataFrame) -> DataFrame:
    """Cut lineage with a reliable checkpoint: the files lie in the shared folder, so a lost executor loses nothing."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def estimated_bytes(df: DataFrame) -> int:
    """The optimizer's size estimate of a plan; an upper bound for filtered scans."""
    return int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())


def small(df: DataFrame, limit: int = BROADCAST_BYTES) -> DataFrame:
    """Hint a broadcast only when the estimate proves the side small; otherwise leave the choice to the optimizer."""
    return F.broadcast(df) if estimated_bytes(df) <= limit else df


def held(result: DataFrame, *frames: DataFrame) -> DataFrame:
    """The result, which keeps frames that it reads: persisted ones are given up as soon as the result is no longer used."""
    result._held = frames
    for f in frames:
        if f.is_cached:
            weakref.finalize(result, _release, f)
    return result


def _release(df: DataFrame) -> None:
    try:
        df.unpersist(blocking=False)
    except Exception:  # the session may have ended before
        return
