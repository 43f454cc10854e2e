"""Running totals over a distributed order, without gathering a group into one task."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from knotwork.session import durable


def running_total(df: DataFrame, group: str, order: list[str], value: str, name: str) -> DataFrame:
    """Adds the sum of `value` over the rows of the group that come before the row."""
    return running_totals(df, group, order, {value: name})


def running_totals(df: DataFrame, group: str, order: list[str], names: dict[str, str]) -> DataFrame:
    """Adds, for each value column, its sum over the rows of the group that come before the row.

    Range-partitioned by group and order; the sums within a partition are shifted by the totals of the partitions
    before it, of which there is one row a partition and group. A group may span any number of partitions. Null values
    count 0; rows equal in group and order come in an arbitrary order.
    """
    ranged = durable(df.repartitionByRange(group, *order).withColumn("kw_part", F.spark_partition_id()))
    values = list(names)
    totals = ranged.groupBy("kw_part", group).agg(*[F.coalesce(F.sum(v), F.lit(0)).alias(f"kw_sum_{i}") for i, v in enumerate(values)])
    before = Window.partitionBy(group).orderBy("kw_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select("kw_part", group, *[F.coalesce(F.sum(f"kw_sum_{i}").over(before), F.lit(0)).alias(f"kw_shift_{i}") for i in range(len(values))])
    inside = Window.partitionBy("kw_part", group).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    inner = ranged.withColumns({n: F.coalesce(F.sum(v).over(inside), F.lit(0)) for v, n in names.items()}).join(offsets, ["kw_part", group], "left")
    return inner.withColumns({n: F.col(n) + F.coalesce(f"kw_shift_{i}", F.lit(0)) for i, n in enumerate(names.values())}).drop("kw_part", *[f"kw_shift_{i}" for i in range(len(values))])
