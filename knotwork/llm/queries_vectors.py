"""Queries on vectors."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from knotwork.llm.neighbours import most_similar
from knotwork.session import table


def p4_found(spark: SparkSession, folder: str) -> DataFrame:
    near = most_similar(table(spark, folder, "base_vector_storage"), k=10, least=0.85)
    return near.select(F.least("query", "other").alias("vec_a"), F.greatest("query", "other").alias("vec_b")).distinct()


def p4_neighbours(spark: SparkSession, folder: str) -> DataFrame:
    """The ten nearest of every vector, however far: far ones lie in more cells and their codes tell less, so more of both are looked at."""
    return most_similar(table(spark, folder, "base_vector_storage"), k=10, probes=8, rerank=200).select("query", "other", F.round("similarity", 6).alias("similarity"))


QUERIES = {"p4_found": p4_found, "p4_neighbours": p4_neighbours}
ORACLES: dict[str, str] = {}
