"""Queries on question-answer pairs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from knotwork.llm.defects import find_defects, validation
from knotwork.session import table


def p1_found(spark: SparkSession, folder: str) -> DataFrame:
    """The likeliest defect of each defective pair (this table's answers have at most one)."""
    marked = find_defects(table(spark, folder, "evaluate_qa_answers"))
    first = marked.groupBy("answer_id").agg(F.max_by("defect_type", F.struct(F.round("posterior", 2), -F.col("defect_no"))).alias("defect_type"))
    return first.select("answer_id", "defect_type")


def p1_labels(spark: SparkSession, folder: str) -> DataFrame:
    """Every defect over its cutoff, several to a pair if need be."""
    return find_defects(table(spark, folder, "evaluate_qa_answers")).select("answer_id", "defect_type", F.round("posterior", 4).alias("posterior"))


def p1_validation(spark: SparkSession, folder: str) -> DataFrame:
    """Found and wrongly found pairs by defect and language on the held-out half of the damaged and invented pairs."""
    return validation(table(spark, folder, "evaluate_qa_answers"))


QUERIES = {"p1_found": p1_found, "p1_labels": p1_labels, "p1_validation": p1_validation}
ORACLES: dict[str, str] = {}
