"""Evaluation of retrieval: evidence ranked for claims, facts judged by coverage, judgements rolled up."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from knotwork.functions.text import compact, compared_unit_slug, normalise, terms
from knotwork.operators import scoring
from knotwork.operators.instances import number_slug
from knotwork.session import durable

FACTS, LEAST = 20_000, 500  # claims that a task ranks for: at most, and at least where slices only spread the work
# Words of a claim and the relation they speak for.
BONUS = [(["achieved", "reached", "current density", " at "], "OPERATION_PERFORMANCE"), (["compared", "lower than", "higher than", "versus"], "COMPARISON"), (["due to", "attributed to", "caused by", "mechanism"], "DEGRADATION_CHAIN|MECHANISM_EVIDENCE"), (["prepared", "modified", "iec", "sulfonation"], "COMPOSITION")]
LABELS = {"SUPPORTED": 3, "PARTIALLY_SUPPORTED": 2, "UNSUPPORTED": 1}


def evidence_text(edges: DataFrame, view: str = "hyper") -> DataFrame:
    """evidence_id, vertices, relation_type, arity, text of each edge; the view `graph` keeps pairs only."""
    rows = edges.where(F.size("vertices") == 2) if view == "graph" else edges
    text = F.concat_ws("\n", F.concat(F.lit("relation_type: "), F.coalesce("relation_type", F.lit("RELATION"))), F.concat(F.lit("canonical_vertices: "), F.array_join("vertices", ", ")), F.concat(F.lit("description: "), F.coalesce("description", F.lit(""))))
    return rows.select(F.col("ord").alias("evidence_id"), "vertices", "relation_type", F.size("vertices").alias("arity"), text.alias("text"))


def wanted_relation(claim: Column) -> Column:
    text = normalise(claim)
    out = None
    for words, kind in BONUS:
        test = F.lit(False)
        for w in words:
            test = test | F.contains(text, F.lit(w))
        out = F.when(test, kind) if out is None else out.when(test, kind)
    return F.coalesce(out, F.lit(""))


def prepare(evidence: DataFrame) -> DataFrame:
    """Adds what scoring needs of an evidence row, worked out once a row: normal text, name parts of its vertices, compact conditions, numbers of its measurements."""
    part = lambda v: F.filter(F.split(F.element_at(F.split(normalise(v), ":"), -1), "_"), lambda p: p != "")
    numbers = lambda v: F.transform(F.regexp_extract_all(v, F.lit(r"([0-9]+(?:_[0-9]+)?)"), F.lit(1)), lambda n: F.replace(n, F.lit("_"), F.lit(".")))
    begins = lambda kind: F.filter("vertices", lambda v: F.startswith(v, F.lit(kind)))
    return evidence.withColumns({"norm": normalise(F.col("text")), "parts": F.transform("vertices", part), "conditions": F.transform(begins("condition:"), compact), "measures": F.transform(begins("measurement:"), numbers)})


def rank(facts: DataFrame, evidence: DataFrame, k: int, hybrid: bool = True) -> DataFrame:
    """fact_id, evidence_id, score, rank: the k best evidence rows of each fact, those with a score over 0 only after the cut.

    Equal claims are ranked once. Each task holds evidence rows and meets a slice of at most about FACTS claims
    (`scoring`); only each group's k best of a claim are shuffled. facts: fact_id, claim.
    """
    claims = facts.where("claim is not null").select("claim").distinct()
    claims = durable(claims.select("claim", normalise(F.col("claim")).alias("claim_norm"), terms(F.col("claim")).alias("claim_terms"), wanted_relation(F.col("claim")).alias("claim_relation"), F.monotonically_increasing_id().alias("cid")))
    cores = evidence.sparkSession.sparkContext.defaultParallelism
    columns = ["evidence_id", "norm", "parts", "conditions", "measures", "arity", F.coalesce("relation_type", F.lit("")).alias("relation_type")]
    ready = durable(prepare(evidence.where("vertices is not null").repartition(2 * cores)).select(*columns))
    n, rows = claims.count(), ready.count()
    ready = ready.coalesce(max(1, min(2 * cores, -(-rows // scoring.GROUP))))
    slices = max(-(-n // FACTS), min(-(-n // LEAST), -(-2 * cores // ready.rdd.getNumPartitions())), 1)
    out = None
    for i in range(slices):
        held = evidence.sparkSession.sparkContext.broadcast(claims.where(F.pmod("cid", F.lit(slices)) == i).drop("claim").toArrow())
        part = ready.mapInArrow(lambda batches, held=held: scoring.best_rows(batches, held.value, k, scoring.HYBRID if hybrid else scoring.PLAIN), f"cid long, evidence_id {dict(evidence.dtypes)['evidence_id']}, score double")
        out = part if out is None else out.unionByName(part)
    place = F.row_number().over(Window.partitionBy("cid").orderBy(F.desc("score"), "evidence_id"))
    best = out.withColumn("score", F.round("score", 6)).withColumn("rank", place).where(F.col("rank") <= k).where("score > 0")
    return facts.select("fact_id", "claim").join(claims.select("claim", "cid"), "claim").join(best, "cid").select("fact_id", "evidence_id", "score", "rank")


def judge(required: DataFrame, ranked: DataFrame, evidence: DataFrame) -> DataFrame:
    """fact_id, label, support, integrity, missing: how much of what a fact requires its evidence names.

    required: fact_id, kind (entities, conditions, measurements, mechanisms), element. An element is there if an
    evidence row has it as a vertex, or the words of its name, run together, occur in an evidence text.
    """
    shown = ranked.select("fact_id", "evidence_id").join(evidence.select("evidence_id", "vertices", compact(F.col("text")).alias("said")), "evidence_id")
    context = shown.groupBy("fact_id").agg(F.array_distinct(F.flatten(F.collect_list("vertices"))).alias("ids"), F.array_join(F.collect_list("said"), "\n").alias("said"))
    name = compact(F.replace(F.element_at(F.split("element", ":"), -1), F.lit("_"), F.lit(" ")))
    there = F.coalesce(F.array_contains("ids", F.col("element")) | F.contains(F.col("said"), name), F.lit(False))
    rows = required.join(context, "fact_id", "left").withColumn("there", there)
    sums = rows.groupBy("fact_id").agg(F.count("*").alias("n"), F.count_if("there").alias("hits"), F.count_if(F.col("kind") == "conditions").alias("n_cond"), F.count_if(F.col("there") & (F.col("kind") == "conditions")).alias("cond"), F.array_sort(F.collect_list(F.when(~F.col("there"), F.concat_ws(":", "kind", "element")))).alias("missing"))
    support, integrity = F.col("hits") / F.greatest(F.lit(1), F.col("n")), F.col("cond") / F.greatest(F.lit(1), F.col("n_cond"))
    label = F.when((support >= 0.85) & (integrity >= 0.8), "SUPPORTED").when(support >= 0.45, "PARTIALLY_SUPPORTED").otherwise("UNSUPPORTED")
    return sums.select("fact_id", label.alias("label"), F.round(support, 4).alias("support"), F.round(integrity, 4).alias("integrity"), "missing")


def coverage(required: DataFrame, ranked: DataFrame, evidence: DataFrame, ks: list[int]) -> DataFrame:
    """k, facts, strict, soft, integrity, budget, density, supported, partial, unsupported: facts judged at every k in one pass.

    An element is there at k if the first evidence row that names it has a rank of k at most. `budget` is the mean
    number of blank-separated tokens of a fact's k evidence texts, `density` the soft coverage for each thousand of
    them. Facts without evidence count with nothing there.
    """
    held = evidence.select("evidence_id", "vertices", compact(F.col("text")).alias("said"), F.size(F.filter(F.split("text", r"\s+"), lambda t: t != "")).alias("tokens"))
    shown = ranked.select("fact_id", "evidence_id", "rank").join(held, "evidence_id")
    name = compact(F.replace(F.element_at(F.split("element", ":"), -1), F.lit("_"), F.lit(" ")))
    named = required.withColumn("kw_name", name).join(shown, "fact_id", "left")
    there = F.array_contains("vertices", F.col("element")) | F.contains(F.col("said"), F.col("kw_name"))
    first = named.groupBy("fact_id", "kind", "element").agg(F.min(F.when(there, F.col("rank"))).alias("first"))
    at = F.explode(F.array(*[F.lit(k) for k in ks])).alias("k")
    hit = F.coalesce(F.col("first") <= F.col("k"), F.lit(False))
    sums = first.select("*", at).groupBy("k", "fact_id").agg(F.count("*").alias("n"), F.count_if(hit).alias("hits"), F.count_if(F.col("kind") == "conditions").alias("n_cond"), F.count_if(hit & (F.col("kind") == "conditions")).alias("cond"))
    used = shown.select("fact_id", "rank", "tokens", at).where("rank <= k").groupBy("k", "fact_id").agg(F.sum("tokens").alias("tokens"))
    support, integrity = F.col("hits") / F.greatest(F.lit(1), F.col("n")), F.col("cond") / F.greatest(F.lit(1), F.col("n_cond"))
    label = F.when((support >= 0.85) & (integrity >= 0.8), "SUPPORTED").when(support >= 0.45, "PARTIALLY_SUPPORTED").otherwise("UNSUPPORTED")
    rows = sums.join(used, ["k", "fact_id"], "left").select("k", label.alias("label"), F.round(support, 4).alias("support"), F.round(integrity, 4).alias("integrity"), F.coalesce("tokens", F.lit(0)).alias("tokens"))
    counts = [F.count_if(F.col("label") == name).alias(short) for name, short in (("SUPPORTED", "supported"), ("PARTIALLY_SUPPORTED", "partial"), ("UNSUPPORTED", "unsupported"))]
    out = rows.groupBy("k").agg(F.count("*").alias("facts"), F.avg("support").alias("soft"), F.avg("integrity").alias("integrity"), F.avg("tokens").alias("budget"), *counts)
    return out.select("k", "facts", F.round(F.col("supported") / F.col("facts"), 4).alias("strict"), F.round("soft", 4).alias("soft"), F.round("integrity", 4).alias("integrity"), F.round("budget", 2).alias("budget"), F.round(F.col("soft") / F.greatest(F.lit(1.0), F.col("budget") / 1000), 4).alias("density"), "supported", "partial", "unsupported")


def majority_label(judgements: DataFrame, key: str, label: str, order: dict[str, int] = LABELS) -> DataFrame:
    """key, label: the commonest label, of equally common ones the one of higher order."""
    weight = F.coalesce(*[F.when(F.col(label) == k, v) for k, v in order.items()], F.lit(0))
    counts = judgements.where(F.col(label).isNotNull()).groupBy(key, label).agg(F.count("*").alias("n"), F.first(weight).alias("w"))
    return counts.groupBy(key).agg(F.max_by(label, F.struct("n", "w", label)).alias(label))


def rollup(judged: DataFrame, by: list[str]) -> DataFrame:
    """Strict and soft coverage, mean support and integrity of judged facts."""
    return judged.groupBy(*by).agg(F.count("*").alias("facts"), F.round(F.avg((F.col("label") == "SUPPORTED").cast("double")), 4).alias("strict"), F.round(F.avg("support"), 4).alias("soft"), F.round(F.avg("integrity"), 4).alias("integrity"))


# Fixed values, in order: words of a condition's type (normalised), the id's stem, and the unit's slug or the unit that stands in for a missing one.
EXPECTED_CONDITIONS = [(["current"], "current_density", "ma_cm2", None), (["temperature"], "temperature", "c", None), (["cycle"], "cycle_number", "cycle", None), (["ph"], "ph", "", None), (["bi"], "bi3_concentration", None, "mmol/L"), (["vanadium"], "vanadium_concentration", None, "mol/L"), (["acid", "h2so4"], "acid_concentration", None, "mol/L")]
# Fixed values, in order: names and words of a metric's type, the id's stem, the unit's slug, whether whole numbers keep a decimal.
EXPECTED_METRICS = [(["ce"], ["coulombic"], "ce", "percent", True), (["ve", "voltaic efficiency"], ["voltage efficiency"], "ve", "percent", True), (["ee"], ["energy efficiency"], "ee", "percent", True), ([], ["capacity retention"], "capacity_retention", "percent", True), ([], ["iec", "ion exchange"], "iec", "mmol_g", False), ([], ["contact angle"], "contact_angle", "degree", False), ([], ["polarization voltage", "voltage loss"], "polarization_voltage_delta", "v", False)]


def expected_condition(kind: Column, value: Column, unit: Column) -> Column:
    """The id a required condition is looked for under; one that is an id already stays."""
    said, number = normalise(kind), number_slug(value)
    stem = lambda name: F.concat(F.lit(f"condition:{name}_"), number)
    rows = []
    for words, name, slug, fallback in EXPECTED_CONDITIONS:
        tail = F.lit(f"_{slug}") if slug else F.lit("") if slug == "" else F.concat(F.lit("_"), compared_unit_slug(F.when(F.coalesce(unit, F.lit("")) == "", fallback).otherwise(unit)))
        rows.append(F.when(said.rlike("|".join(words)), F.concat(stem(name), tail)))
    other = F.concat(F.lit("condition:"), F.replace(compact(kind), F.lit("/"), F.lit("_")), F.lit("_"), number, F.lit("_"), compared_unit_slug(unit))
    return F.when(F.startswith(kind, F.lit("condition:")), kind).otherwise(F.coalesce(*rows, other))


def expected_metric(kind: Column, value: Column, unit: Column) -> Column:
    """The id a required metric is looked for under; one that is an id already stays."""
    said, number = normalise(kind), number_slug(value)
    whole = F.when(value == F.floor(value), F.replace(F.concat(value.cast("bigint").cast("string"), F.lit("_0")), F.lit("-"), F.lit("minus_"))).otherwise(number)
    rows = [F.when(said.isin(*names) if names and not words else said.isin(*(names or ["\0"])) | said.rlike("|".join(words)), F.concat(F.lit(f"measurement:{stem}_"), whole if keeps else number, F.lit(f"_{slug}"))) for names, words, stem, slug, keeps in EXPECTED_METRICS]
    other = F.concat(F.lit("measurement:"), F.replace(compact(kind), F.lit("/"), F.lit("_")), F.lit("_"), number, F.lit("_"), compared_unit_slug(unit))
    return F.when(kind.rlike("^(metric|measurement|evidence|degradation):"), kind).otherwise(F.coalesce(*rows, other))
