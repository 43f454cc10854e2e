"""Queries on token sizes: containers and mixes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from knotwork.llm.mixing import mix, shares
from knotwork.llm.packing import pack
from knotwork.llm.tokens import token_sizes
from knotwork.session import durable, table


def p8_containers(spark: SparkSession, folder: str) -> DataFrame:
    return pack(durable(token_sizes(table(spark, folder, "documents"), [])), table(spark, folder, "pack_tiers"))


def p8_fill(spark: SparkSession, folder: str) -> DataFrame:
    """Containers, tokens and share of the room filled, by tier."""
    packed = p8_containers(spark, folder)
    tiers = table(spark, folder, "pack_tiers")
    each = packed.groupBy("tier", "container").agg(F.sum("tokens").alias("tokens"))
    return each.groupBy("tier").agg(F.count("*").alias("containers"), F.sum("tokens").alias("tokens")).join(tiers, "tier").select("tier", "containers", "tokens", F.ceil(F.col("tokens") / F.col("capacity_tokens")).alias("least_containers"), F.round(F.col("tokens") / (F.col("containers") * F.col("capacity_tokens")), 6).alias("filled"))


def p9_mix(spark: SparkSession, folder: str) -> DataFrame:
    return mix(durable(token_sizes(table(spark, folder, "documents"), ["source"])), table(spark, folder, "mix_targets"))


def p9_shares(spark: SparkSession, folder: str) -> DataFrame:
    return shares(durable(p9_mix(spark, folder)), table(spark, folder, "mix_targets"))


QUERIES = {"p8_containers": p8_containers, "p8_fill": p8_fill, "p9_mix": p9_mix, "p9_shares": p9_shares}
ORACLES: dict[str, str] = {}
