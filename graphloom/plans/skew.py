"""Joins that stay balanced when one key holds a large share of the rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: A key is heavy when it holds more than 1/HEAVY_SHARE of all rows, so there are fewer than HEAVY_SHARE heavy keys.
HEAVY_SHARE = 1000


def join_groups(rows: DataFrame, groups: DataFrame, key: str, n_rows: Column, total: int) -> DataFrame:
    """Inner join of rows with one record per group, for groups of any size.

    Groups above total/HEAVY_SHARE rows number fewer than HEAVY_SHARE, whatever the data: only they are broadcast, so
    their rows never move. Every other key has at most that share of the rows and takes the shuffle join.
    """
    heavy = groups.filter(n_rows * HEAVY_SHARE > F.lit(total))
    light = groups.filter(n_rows * HEAVY_SHARE <= F.lit(total))
    near = rows.join(F.broadcast(heavy), key)
    far = rows.join(F.broadcast(heavy.select(key)), key, "left_anti").join(light, key)
    return near.unionByName(far)
