"""Catalogue views and per-key running state: visibility, counts, rotation, moving averages, quotas, caches."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from knotwork.operators.prefix import running_total

# Words of an error and the class they put it in, the first that fits.
ERROR_RULES = [("unauthorized|invalid api key|401", "disable"), ("quota|insufficient_quota|billing", "disable"), ("rate limit|429|too many", "cooldown"), ("timeout|timed out", "cooldown"), ("connection|unreachable|5[0-9][0-9]", "cooldown")]


def visible(owner: Column, user: Column, legacy: bool) -> Column:
    """Rows of the user's own, and without an owner if legacy rows are shown; without a user all rows."""
    own = F.coalesce(owner == user, F.lit(False))
    return user.isNull() | own | (owner.isNull() if legacy else F.lit(False))


def status_counts(files: DataFrame, by: str, status: str, size: str, kinds: list[str]) -> DataFrame:
    """by, one count for each status, total size (2 digits) and rows."""
    return files.groupBy(by).agg(*[F.count_if(F.col(status) == k).alias(f"n_{k.lower()}") for k in kinds], F.round(F.sum(size), 2).alias("total_size"), F.count("*").alias("files"))


def error_class(text: Column) -> Column:
    low = F.lower(text)
    return F.coalesce(*[F.when(low.rlike(p), F.lit(c)) for p, c in ERROR_RULES], F.lit("fail"))


def rotation(providers: DataFrame, group: str, order: list, cursor: int) -> DataFrame:
    """Adds `turn`: the place of each provider of a group after the round-robin cursor has moved on `cursor` places."""
    n = F.count("*").over(Window.partitionBy(group))
    place = F.row_number().over(Window.partitionBy(group).orderBy(*order)) - 1
    return providers.withColumns({"place": place, "n": n}).withColumn("turn", F.pmod(F.col("place") - cursor, F.col("n")).cast("int")).drop("place", "n")


def latest(rows: DataFrame, key: str, at: str, columns: list[str]) -> DataFrame:
    return rows.groupBy(key).agg(F.max_by(F.struct(*columns), F.struct(at, *columns)).alias("r")).select(key, "r.*")


def cache_split(calls: DataFrame, cache: DataFrame, key: str, answer: str) -> DataFrame:
    """calls with the cached answer and `hit`; a key cached more than once counts once."""
    held = cache.groupBy(key).agg(F.min(answer).alias("cached"), F.lit(True).alias("held"))
    return calls.join(held, key, "left").withColumn("hit", F.coalesce("held", F.lit(False))).drop("held")


def moving_average(events: DataFrame, key: str, order: list[str], value: str, keep: float = 0.8) -> DataFrame:
    """key, ema, n: the average e = keep * e + (1 - keep) * x over the key's rows in order, the first row as it is.

    Written as a weighted sum by the row's distance from the end, so a key of any size is summed in parts.
    """
    rows = events.where(F.col(value).isNotNull()).withColumn("one", F.lit(1))
    placed = running_total(rows, key, order, "one", "before")
    sizes = rows.groupBy(key).agg(F.count("*").alias("n"))
    weight = F.pow(F.lit(keep), F.col("n") - 1 - F.col("before")) * F.when(F.col("before") == 0, F.lit(1.0)).otherwise(F.lit(1.0 - keep))
    return placed.join(sizes, key).groupBy(key).agg(F.sum(weight * F.col(value)).alias("ema"), F.first("n").alias("n"))


def greedy_windows(events: DataFrame, key: str, at: str, length: float, limit: int, tie: str) -> DataFrame:
    """key, tie, window_start, used, allowed: windows that open with the first row outside the one before.

    A row is allowed while its window has fewer than `limit` rows. The rows of a key come sorted through one task, as
    each window depends on the one before; the task holds one key's state and one batch, whatever the key's size.
    """
    kinds = dict(events.dtypes)
    rows = events.where(F.col(key).isNotNull() & F.col(at).isNotNull()).select(key, tie, F.unix_micros(F.col(at).cast("timestamp")).alias("us")).repartition(F.col(key)).sortWithinPartitions(key, "us", tie)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held, start, used = None, 0, 0
        for batch in batches:
            out = []
            for k, t, us in batch.itertuples(index=False, name=None):
                if k != held or us - start >= length * 1_000_000:
                    held, start, used = k, us, 0
                used += 1
                out.append((k, t, start, used, used <= limit))
            yield pd.DataFrame(out, columns=[key, tie, "start", "used", "allowed"])

    out = rows.mapInPandas(run, f"{key} {kinds[key]}, {tie} {kinds[tie]}, start bigint, used int, allowed boolean")
    return out.select(key, tie, F.timestamp_micros("start").cast(kinds[at]).alias("window_start"), "used", "allowed")
