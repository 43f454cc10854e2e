"""Broadcast hints only behind a check of the side's size; joins whose left side has hot keys."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BROADCAST_ROWS = 20_000


def small_side(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """The frame with a broadcast hint if it has at most `rows` rows, else as it is (a shuffled join).

    The check reads at most rows + 1 rows.
    """
    return F.broadcast(df) if len(df.select(F.lit(1)).limit(rows + 1).take(rows + 1)) <= rows else df


HOT_ROWS = 50_000  # a key with as many rows on the left is joined by broadcast; of n rows at most n / HOT_ROWS keys are


def hot_keys(left: DataFrame, keys: list[str], rows: int = HOT_ROWS) -> DataFrame | None:
    """The keys that fill at least `rows` rows, as a frame to broadcast with the flag `kw_hot`; None if there are none."""
    found = left.groupBy(*keys).count().where(F.col("count") >= rows).select(*keys).collect()
    if not found:
        return None
    kinds = dict(left.dtypes)
    return F.broadcast(left.sparkSession.createDataFrame(found, ", ".join(f"`{k}` {kinds[k]}" for k in keys)).withColumn("kw_hot", F.lit(True)))


def join_hot(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner", rows: int = HOT_ROWS) -> DataFrame:
    """left joined with right, which holds one row a key at most; `how` is inner or left.

    A small right side is broadcast. Else the keys that fill many rows of the left are joined by broadcast of their few
    right rows and the others by a shuffle, so that no task gets a hot key's rows. Null keys match nothing.
    """
    small = small_side(right)
    return left.join(small, keys, how) if small is not right else join_split(left, right, keys, hot_keys(left, keys, rows), how)


def join_split(left: DataFrame, right: DataFrame, keys: list[str], hot: DataFrame | None, how: str = "inner") -> DataFrame:
    """The same for a right side of any size and hot keys found before."""
    if hot is None:
        return left.join(right, keys, how)
    parts = left.join(hot, keys, "left")
    cold = parts.where("kw_hot is null").drop("kw_hot").join(right, keys, how)
    return cold.unionByName(parts.where("kw_hot").drop("kw_hot").join(F.broadcast(right.join(hot, keys).drop("kw_hot")), keys, how))
