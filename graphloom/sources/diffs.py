"""Unified diffs: text to changed regions."""

from __future__ import annotations

import subprocess

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def diff_text(spark: SparkSession, repository: str, reference: str | None = None) -> DataFrame:
    """Lines of `git diff -U0` (staged, or against a reference) as diff_id, line_no, line; no rows outside a repository."""
    command = ["git", "-C", repository, "diff", "-U0", "--no-color", *([reference] if reference else ["--cached"])]
    done = subprocess.run(command, capture_output=True, check=False)
    text = done.stdout.decode("utf-8", "replace") if done.returncode == 0 else ""
    return spark.createDataFrame([(0, k, line) for k, line in enumerate(text.split("\n") if text else [])], "diff_id bigint, line_no int, line string")


def changed_regions(lines: DataFrame) -> DataFrame:
    """diff_id, path, start_line, end_line of the new side of each hunk.

    A +++ header names the file of the hunks below it (a/ and b/ dropped, backslashes turned); /dev/null names none. A
    hunk without count has one line, a count of 0 gives no region. A content line that itself begins with `+++ ` reads
    as a header. One diff is one ordered text, so its lines share a window.
    """
    header = F.regexp_extract("line", r"^\+\+\+ ([^\t]+)", 1)
    name = F.when(F.col("line").startswith("+++ "), F.when(F.trim(header) == "/dev/null", "").otherwise(F.regexp_replace(F.regexp_replace(F.trim(header), r"\\", "/"), "^[ab]/", "")))
    w = Window.partitionBy("diff_id").orderBy("line_no").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    hunk = r"^@@ -\d+(?:,\d+)? \+(\d+)(?:,(\d+))? @@"
    start, count = F.regexp_extract("line", hunk, 1), F.regexp_extract("line", hunk, 2)
    out = lines.withColumn("path", F.last(name, ignorenulls=True).over(w)).filter(F.col("line").rlike(hunk))
    out = out.withColumn("start_line", start.cast("int")).withColumn("n", F.when(count == "", 1).otherwise(F.expr("try_cast(regexp_extract(line, '^@@ -[0-9]+(?:,[0-9]+)? [+]([0-9]+)(?:,([0-9]+))? @@', 2) AS INT)")))
    return out.filter("path != '' AND n > 0").select("diff_id", "path", "start_line", (F.col("start_line") + F.col("n") - 1).alias("end_line"))
