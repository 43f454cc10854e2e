"""Quantities recorded in different units, brought to one unit a quantity type.

A text names its unit, or a field does, or a tree ensemble predicts it from magnitude, category, the source (how its
text writes numbers, the units its paper uses) and the neighbouring quantities of the same chunk. The same ensemble settles numbers that can be read in two
ways ("2,784"). Confident readings are converted; uncertain ones are routed for review.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import IsotonicRegression
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from knotwork.functions.sizes import join_hot
from knotwork.functions.units import UNITS, parse, unit_of
from knotwork.session import durable

TRAIN_ROWS = 12_000  # bound of the labelled sample the ensemble is fitted on
CONFIDENT = 0.9  # calibrated probability from which a predicted unit is converted
NAMES = list(UNITS)
TYPES = sorted({t for t, _, _ in UNITS.values()})
PARSED = "quantity_id bigint, quantity_type string, chunk_id string, paper_id string, source_kind int, notation int, lo double, hi double, alt_lo double, alt_hi double, unit_no int, origin string"


def _notation(raw: str | None) -> int:
    """How a text writes its number: 0 not at all, 1 plain, 2 with a decimal comma, 3 with powers of ten, 4 in words."""
    if not raw:
        return 0
    if not any(c.isdigit() for c in raw):
        return 4
    if re.search(r"\d\s?[×xX*]\s?10|\d[eE][-+]?\d", raw):
        return 3
    return 2 if re.search(r"\d,\d", raw) else 1


def _parsed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for rows in batches:
        out = []
        for quantity_id, raw, kind, value, low, high, unit, chunk, paper in rows.itertuples(index=False, name=None):
            p = parse(raw)
            origin = "text" if p["unit"] else None
            lo, hi, alt_lo, alt_hi = p["lo"], p["hi"], p["alt_lo"], p["alt_hi"]
            if value == value and value is not None:
                field = (value, value)
            elif low is not None and high is not None and low == low and high == high:
                field = (min(low, high), max(low, high))
            else:
                field = None
            named = p["unit"]
            if named is None:
                named = unit_of(unit)
                if named and kind in TYPES and UNITS[named][0] != kind:
                    named = None
                origin = "field" if named else None
                if field:  # without a unit beside it, a number in the text may be any number
                    (lo, hi), alt_lo, alt_hi = field, None, None
            elif lo is None and field:
                lo, hi = field
            elif alt_lo is not None and field:
                if abs(alt_lo - field[0]) < abs(lo - field[0]):
                    lo, hi = alt_lo, alt_hi
                alt_lo = alt_hi = None
            out.append((quantity_id, kind if kind in TYPES else (UNITS[named][0] if named else kind), chunk, paper, 0 if not raw else 1 if p["lo"] is not None else 2, _notation(raw), lo, hi, alt_lo, alt_hi, NAMES.index(named) if named else None, origin))
        frame = pd.DataFrame(out, columns=[c.split()[0] for c in PARSED.split(", ")])
        yield frame.astype({"unit_no": "Int32", "source_kind": "Int32", "notation": "Int32", "lo": "float64", "hi": "float64", "alt_lo": "float64", "alt_hi": "float64"})


def parse_quantities(df: DataFrame) -> DataFrame:
    """One row a quantity_id (redelivered rows count once) with its numbers, unit and where the unit came from."""
    rows = df.where("quantity_id is not null").select("quantity_id", "raw", "quantity_type", "value", "min_value", "max_value", "unit", "chunk_id", F.col("paper_id") if "paper_id" in df.columns else F.lit(None).cast("string").alias("paper_id")).dropDuplicates(["quantity_id"])
    return rows.mapInPandas(_parsed, PARSED)


def _commonest(parsed: DataFrame, key: str, name: str) -> DataFrame:
    """The commonest unit among the other quantities of the type that share the key. Counts are aggregated before the join, and hot keys are joined by broadcast."""
    counts = parsed.where(F.col("unit_no").isNotNull() & F.col(key).isNotNull()).groupBy(key, "quantity_type", "unit_no").count()
    near = counts.groupBy(key, "quantity_type").agg(F.collect_list(F.struct(F.col("count").alias("n"), F.col("unit_no").alias("u"))).alias("near"))  # at most one entry a unit
    others = F.filter(F.transform("near", lambda x: F.struct((x.n - F.when(x.u == F.col("unit_no"), 1).otherwise(0)).alias("n"), x.u.alias("u"))), lambda x: x.n > 0)
    return join_hot(parsed, near, [key, "quantity_type"], "left").withColumn(name, F.coalesce(F.array_max(others).u, F.lit(-1))).drop("near")


def with_neighbours(parsed: DataFrame) -> DataFrame:
    """`near_no` and `paper_no`: the commonest unit of the type in the rest of the chunk and of the paper (-1 where there is none)."""
    return _commonest(_commonest(parsed, "chunk_id", "near_no"), "paper_id", "paper_no")


def _features(df: DataFrame, lo: str, hi: str) -> DataFrame:
    size = F.log10(F.greatest(F.abs(F.col(lo)), F.abs(F.col(hi)), F.lit(1e-9)))
    small = F.log10(F.greatest(F.least(F.abs(F.col(lo)), F.abs(F.col(hi))), F.lit(1e-9)))
    kind = F.coalesce(*[F.when(F.col("quantity_type") == t, F.lit(i)) for i, t in enumerate(TYPES)], F.lit(-1))
    near = [(F.col("near_no") == i).cast("double").alias(f"near_{i}") for i in range(len(NAMES))]
    paper = [(F.col("paper_no") == i).cast("double").alias(f"paper_{i}") for i in range(len(NAMES))]
    is_kind = [(kind == i).cast("double").alias(f"kind_{i}") for i in range(len(TYPES))]
    extra = [size.alias("size"), small.alias("small"), (F.col(lo) != F.col(hi)).cast("double").alias("is_range"), (F.col(lo) < 0).cast("double").alias("negative"), (F.col(lo) == F.floor(lo)).cast("double").alias("whole"), F.col("source_kind").cast("double").alias("source"), F.col("notation").cast("double").alias("written")]
    names = ["size", "small", "is_range", "negative", "whole", "source", "written", *[f"near_{i}" for i in range(len(NAMES))], *[f"paper_{i}" for i in range(len(NAMES))], *[f"kind_{i}" for i in range(len(TYPES))]]
    return VectorAssembler(inputCols=names, outputCol="features").transform(df.select("*", *extra, *near, *paper, *is_kind)).drop(*names)


class UnitModel:
    """Random forest over a bounded sample of quantities whose unit is stated, with isotonic calibration on a fifth of it; a tenth (`test`) is kept out of both."""

    def __init__(self, known: DataFrame, rows: int = TRAIN_ROWS, seed: int = 7):
        known = known.where("unit_no is not null and lo is not null and alt_lo is null")
        total = known.count()
        self.ready = total >= 50
        if not self.ready:
            return
        share = min(1.0, rows / total)
        part = F.pmod(F.xxhash64("quantity_id", F.lit(seed)), F.lit(1_000_000)) / 1_000_000
        sample = _features(known.where(part < share), "lo", "hi").withColumn("label", F.col("unit_no").cast("double")).withColumn("fold", F.pmod(F.xxhash64("quantity_id", F.lit(seed + 1)), F.lit(10)))
        self.test = sample.where("fold = 0").drop("features", "label", "fold")
        forest = RandomForestClassifier(numTrees=24, maxDepth=10, minInstancesPerNode=3, seed=seed, probabilityCol="by_unit", featureSubsetStrategy="0.5")
        self.forest = forest.fit(sample.where("fold > 2").select("features", "label"))
        held = self.forest.transform(sample.where("fold in (1, 2)").select("features", "label"))
        self.calibration = IsotonicRegression(featuresCol="p", labelCol="right", predictionCol="sure").fit(held.select(F.array_max(vector_to_array("by_unit")).alias("p"), (F.col("prediction") == F.col("label")).cast("double").alias("right")))
        self.classes = self.forest.numClasses

    def score(self, df: DataFrame, lo: str, hi: str, prefix: str) -> DataFrame:
        """Adds <prefix>_unit, <prefix>_sure (calibrated) and <prefix>_stated (probability of the stated unit)."""
        scored = self.forest.transform(_features(df, lo, hi)).withColumn("by_unit", vector_to_array("by_unit"))
        scored = self.calibration.transform(scored.withColumn("p", F.array_max("by_unit")))
        stated = F.coalesce(F.get("by_unit", F.col("unit_no")), F.lit(0.0))
        return scored.select(*df.columns, F.col("prediction").cast("int").alias(f"{prefix}_unit"), F.col("sure").alias(f"{prefix}_sure"), stated.alias(f"{prefix}_stated"))


def _common(value: str, unit: str) -> F.Column:
    factors = F.array(*[F.lit(f) for _, f, _ in UNITS.values()])
    offsets = F.array(*[F.lit(o) for _, _, o in UNITS.values()])
    return F.bround((F.col(value) * F.get(factors, F.col(unit)) + F.get(offsets, F.col(unit))) * 1000, 0).cast("bigint")


def convert_quantities(df: DataFrame, confident: float = CONFIDENT) -> DataFrame:
    """quantity_id, quantity_type, unit, origin (text, field, model), lo_milli, hi_milli, sure, status.

    status: converted; review (the unit is missing and the ensemble is unsure, or nothing can be fitted); no_number.
    Null, blank and wordy texts give no_number; ties and redelivered rows change nothing; an empty table gives an
    empty result; extra columns are ignored.
    """
    parsed = durable(parse_quantities(df))
    near = with_neighbours(parsed)
    model = UnitModel(near)
    sound = parsed.where("lo is not null and unit_no is not null and alt_lo is null").select("quantity_id", "quantity_type", "unit_no", "origin", "lo", "hi", F.lit(1.0).alias("sure"))
    open_rows = near.where("lo is not null and (unit_no is null or alt_lo is not null)")
    if model.ready:
        both = model.score(model.score(open_rows, "lo", "hi", "a").withColumns({"alt_lo": F.coalesce("alt_lo", "lo"), "alt_hi": F.coalesce("alt_hi", "hi")}), "alt_lo", "alt_hi", "b")
        # The thousands reading stands unless the other one is clearly likelier: two to one for a stated unit.
        other = F.when(F.col("unit_no").isNotNull(), F.col("b_stated") > 2 * F.col("a_stated")).otherwise(F.col("b_sure") > F.col("a_sure"))
        pick = lambda a, b: F.when(other, F.col(b)).otherwise(F.col(a))
        known = F.col("unit_no").isNotNull()
        settled = both.select(
            "quantity_id", "quantity_type", F.coalesce("unit_no", pick("a_unit", "b_unit")).alias("unit_no"), F.coalesce("origin", F.lit("model")).alias("origin"),
            pick("lo", "alt_lo").alias("lo"), pick("hi", "alt_hi").alias("hi"), F.when(known, 1.0).otherwise(pick("a_sure", "b_sure")).alias("sure"),
        )
    else:
        settled = open_rows.select("quantity_id", "quantity_type", "unit_no", F.coalesce("origin", F.lit("model")).alias("origin"), "lo", "hi", F.when(F.col("unit_no").isNull(), 0.0).otherwise(1.0).alias("sure"))
    blank = parsed.where("lo is null").select("quantity_id", "quantity_type", "unit_no", "origin", "lo", "hi", F.lit(None).cast("double").alias("sure"))
    types = F.array(*[F.lit(t) for t, _, _ in UNITS.values()])
    fits = (F.col("quantity_type").isNull()) | (F.col("quantity_type") == F.get(types, F.col("unit_no")))
    status = F.when(F.col("lo").isNull(), "no_number").when(F.col("unit_no").isNull() | (F.col("sure") < confident) | ~fits, "review").otherwise("converted")
    names = F.array(*[F.lit(n) for n in NAMES])
    low, high = _common("lo", "unit_no"), _common("hi", "unit_no")
    return sound.unionByName(settled).unionByName(blank).select("quantity_id", F.coalesce("quantity_type", F.get(types, F.col("unit_no"))).alias("quantity_type"), F.get(names, F.col("unit_no")).alias("unit"), "origin", low.alias("lo_milli"), high.alias("hi_milli"), "sure", status.alias("status"))


def reliability(df: DataFrame, bins: int = 10) -> DataFrame:
    """quantity_type, sure_from, n, sure, right: quantities kept out of the fit, their stated units hidden and predicted.

    One row for each type and tenth of the calibrated probability: how many fall there, their mean probability and the
    share predicted right. Rows of 0.9 and more are those that would be converted; the others go to review.
    """
    model = UnitModel(with_neighbours(durable(parse_quantities(df))))
    if not model.ready:
        return df.sparkSession.createDataFrame([], "quantity_type string, sure_from double, n bigint, sure double, right double")
    scored = model.score(model.test, "lo", "hi", "a")
    at = F.least(F.floor(F.col("a_sure") * bins + 1e-9), F.lit(bins - 1)) / bins
    return scored.groupBy("quantity_type", at.alias("sure_from")).agg(F.count("*").alias("n"), F.round(F.avg("a_sure"), 4).alias("sure"), F.round(F.avg((F.col("a_unit") == F.col("unit_no")).cast("double")), 4).alias("right"))
