"""Queries of the unit conversion operator."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from knotwork.operators.quantities import convert_quantities, reliability
from knotwork.session import table


def p3_found(spark: SparkSession, folder: str) -> DataFrame:
    out = convert_quantities(table(spark, folder, "parsed_quantity"))
    return out.where("status = 'converted' and origin in ('text', 'field')").select("quantity_id", "lo_milli", "hi_milli")


def p3_predicted(spark: SparkSession, folder: str) -> DataFrame:
    """Quantities whose missing unit the ensemble predicts, converted or routed for review."""
    out = convert_quantities(table(spark, folder, "parsed_quantity"))
    return out.where("origin = 'model'").select("quantity_id", "quantity_type", "unit", "lo_milli", "hi_milli", F.round("sure", 4).alias("sure"), "status")


def p3_reliability(spark: SparkSession, folder: str) -> DataFrame:
    """Accuracy of the predicted units by type and calibrated probability, on quantities kept out of the fit."""
    return reliability(table(spark, folder, "parsed_quantity"))


QUERIES = {"p3_found": p3_found, "p3_predicted": p3_predicted, "p3_reliability": p3_reliability}
ORACLES: dict[str, str] = {}
