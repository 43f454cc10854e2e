"""Queries of evaluation: ranking, coverage, judgement and score roll-ups, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from knotwork.operators import evaluate as e
from knotwork.plans import bindings as b
from knotwork.plans.bindings import HYPEREDGES
from knotwork.plans.text_queries import _NORMAL, _TERM_STOP
from knotwork.session import durable, table


def _evidence(spark: SparkSession, d: str) -> DataFrame:
    return e.evidence_text(b.hyperedges(spark, d))


def _facts(spark: SparkSession, d: str) -> DataFrame:
    """The query set of gold facts: every hyperedge whose number is divisible by 20; the description is the claim, the vertices are required."""
    return _all_facts(spark, d).where("fact_id % 20 = 0")


def _all_facts(spark: SparkSession, d: str) -> DataFrame:
    return b.hyperedges(spark, d).where("description is not null").select(F.col("ord").alias("fact_id"), F.col("description").alias("claim"), "vertices")


def _required(facts: DataFrame) -> DataFrame:
    rows = facts.select("fact_id", F.explode("vertices").alias("element"))
    kind = F.when(F.startswith("element", F.lit("condition:")), "conditions").when(F.startswith("element", F.lit("metric:")), "measurements").when(F.startswith("element", F.lit("degradation:")), "mechanisms").otherwise("entities")
    return rows.select("fact_id", kind.alias("kind"), "element")


def evidence_views(spark: SparkSession, d: str) -> DataFrame:
    return e.evidence_text(b.hyperedges(spark, d), "graph").select("evidence_id", "arity", F.md5("text").alias("text_md5"))


def evidence_rank(spark: SparkSession, d: str) -> DataFrame:
    return e.rank(_facts(spark, d), _evidence(spark, d), 10)


def evidence_rank_all(spark: SparkSession, d: str) -> DataFrame:
    """Every hyperedge with a description as a fact; those divisible by 20 of evidence_rank are those of its SQL."""
    return e.rank(_all_facts(spark, d), _evidence(spark, d), 10)


def evidence_rank_plain(spark: SparkSession, d: str) -> DataFrame:
    return e.rank(_facts(spark, d), _evidence(spark, d), 5, hybrid=False)


def _judged(facts: DataFrame, evidence: DataFrame) -> DataFrame:
    return e.judge(_required(facts), e.rank(facts, evidence, 10), evidence).select("fact_id", "label", "support", "integrity", F.array_join("missing", "|").alias("missing"))


def _covered(facts: DataFrame, evidence: DataFrame) -> DataFrame:
    """Coverage at 1, 3, 5 and 10; the evidence is ranked once."""
    evidence = durable(evidence)
    ranked = durable(e.rank(facts, evidence, 10))
    return e.coverage(_required(facts), ranked, evidence, [1, 3, 5, 10])


def _missed(facts: DataFrame, evidence: DataFrame) -> DataFrame:
    judged = e.judge(_required(facts), e.rank(facts, evidence, 3), evidence)
    return judged.select(F.explode("missing").alias("element")).groupBy("element").agg(F.count("*").alias("n"))


def evidence_rank_plain_all(spark: SparkSession, d: str) -> DataFrame:
    return e.rank(_all_facts(spark, d), _evidence(spark, d), 5, hybrid=False)


def fact_judge(spark: SparkSession, d: str) -> DataFrame:
    return _judged(_facts(spark, d), _evidence(spark, d))


def fact_judge_all(spark: SparkSession, d: str) -> DataFrame:
    return _judged(_all_facts(spark, d), _evidence(spark, d))


def coverage_at_k(spark: SparkSession, d: str) -> DataFrame:
    return _covered(_facts(spark, d), _evidence(spark, d))


def coverage_at_k_all(spark: SparkSession, d: str) -> DataFrame:
    return _covered(_all_facts(spark, d), _evidence(spark, d))


def missing_counts(spark: SparkSession, d: str) -> DataFrame:
    return _missed(_facts(spark, d), _evidence(spark, d))


def missing_counts_all(spark: SparkSession, d: str) -> DataFrame:
    return _missed(_all_facts(spark, d), _evidence(spark, d))


def _judgements(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "evaluate_qa_answers").select("answer_id", "mode", "question_id", "per_model_judgments").dropDuplicates(["answer_id"])
    each = rows.select("answer_id", "mode", "question_id", F.posexplode("per_model_judgments").alias("pos", "j")).select("answer_id", "mode", "question_id", "pos", F.lower(F.trim("j.judge_name")).alias("judge"), F.col("j.factual_correctness").alias("score"), F.col("j.overall_score").alias("overall"))
    return each


def judge_majority(spark: SparkSession, d: str) -> DataFrame:
    label = F.when(F.col("score") >= 4, "SUPPORTED").when(F.col("score") >= 2, "PARTIALLY_SUPPORTED").when(F.col("score").isNotNull(), "UNSUPPORTED")
    return e.majority_label(_judgements(spark, d).withColumn("label", label), "answer_id", "label")


def judge_spread(spark: SparkSession, d: str) -> DataFrame:
    """Mean and population deviation of an answer's scores."""
    return _judgements(spark, d).where("score is not null").groupBy("answer_id").agg(F.round(F.avg("score"), 4).alias("mean_score"), F.round(F.stddev_pop("score"), 4).alias("std_score"), F.count("*").alias("n"))


def qa_rollup(spark: SparkSession, d: str) -> DataFrame:
    """Means per answer, then per mode."""
    per = _judgements(spark, d).groupBy("mode", "answer_id").agg(F.avg("score").alias("factual"), F.avg("overall").alias("overall"))
    return per.groupBy("mode").agg(F.round(F.avg("factual"), 4).alias("factual"), F.round(F.avg("overall"), 4).alias("overall"), F.count("*").alias("answers"))


def score_mean(spark: SparkSession, d: str) -> DataFrame:
    """Mean score of each judge and over all of them."""
    return _judgements(spark, d).where("score between 1 and 5").rollup("judge").agg(F.round(F.avg("score"), 4).alias("mean_score"), F.count("*").alias("n"))


def win_rate(spark: SparkSession, d: str) -> DataFrame:
    """How often an answer's first judge scores over its second, by mode."""
    first = _judgements(spark, d).where("pos < 2 and score is not null").groupBy("mode", "answer_id").agg(F.max(F.when(F.col("pos") == 0, F.col("score"))).alias("a"), F.max(F.when(F.col("pos") == 1, F.col("score"))).alias("b"))
    return first.where("a is not null and b is not null").groupBy("mode").agg(F.round(F.avg((F.col("a") > F.col("b")).cast("double")), 4).alias("win_rate"), F.count("*").alias("n"))


def zip_answers(spark: SparkSession, d: str) -> DataFrame:
    """Two modes' answers to a question side by side, by question and order of answering."""
    from pyspark.sql import Window

    rows = table(spark, d, "evaluate_qa_answers").select("answer_id", "mode", "question_id", "answer").distinct()
    numbered = rows.withColumn("nth", F.row_number().over(Window.partitionBy("question_id", "mode").orderBy("answer_id")))
    modes = [r[0] for r in rows.where("mode is not null").select("mode").distinct().orderBy("mode").limit(2).collect()]
    a = numbered.where(F.col("mode") == modes[0]).select("question_id", "nth", F.col("answer_id").alias("left_id"))
    b_ = numbered.where(F.col("mode") == modes[-1]).select("question_id", "nth", F.col("answer_id").alias("right_id"))
    return a.join(b_, ["question_id", "nth"])


def flat_report(spark: SparkSession, d: str) -> DataFrame:
    """One row a normalisation status with fixed columns, missing counts as 0."""
    rows = table(spark, d, "rewritten_hyperedge").select("edge_id", "normalization_status", "level_hg", "unresolved_vertices").distinct()
    return rows.groupBy(F.coalesce("normalization_status", F.lit("none")).alias("status")).agg(F.count("*").alias("edges"), F.count_if(F.col("level_hg") == "High-order").alias("high"), F.count_if(F.col("level_hg") == "Low-order").alias("low"), F.sum(F.greatest(F.coalesce(F.size("unresolved_vertices"), F.lit(0)), F.lit(0))).alias("open_names"))


def expected_ids(spark: SparkSession, d: str) -> DataFrame:
    """Ids that a fact's conditions and metrics are expected under, by ordered rules on the type; every quantity is taken as a condition and, with a metric's name, as a metric."""
    rows = table(spark, d, "parsed_quantity").where("value is not null and quantity_type is not null").select("quantity_id", "quantity_type", "value", "unit").distinct()
    kinds = F.array(*[F.lit(k) for k in _EXPECTED_KINDS])
    named = F.element_at(kinds, (F.col("quantity_id") % len(_EXPECTED_KINDS) + 1).cast("int"))
    return rows.select("quantity_id", e.expected_condition(F.col("quantity_type"), F.col("value"), F.col("unit")).alias("condition_id"), e.expected_metric(named, F.col("value"), F.col("unit")).alias("metric_id"))


_EXPECTED_KINDS = ["CE", "coulombic efficiency", "voltage efficiency", "EE", "capacity retention", "IEC", "contact angle", "polarization voltage", "metric:given", "power density"]


QUERIES = {f.__name__: f for f in (evidence_views, evidence_rank, evidence_rank_all, evidence_rank_plain, evidence_rank_plain_all, fact_judge, fact_judge_all, coverage_at_k, coverage_at_k_all, missing_counts, missing_counts_all, judge_majority, judge_spread, qa_rollup, score_mean, win_rate, zip_answers, flat_report, expected_ids)}

_TERMS = f"list_sort(list_distinct(list_filter(list_transform(list_filter(regexp_extract_all(description, '([a-zA-Z][a-zA-Z0-9.+/-]*|[0-9]+(?:\\.[0-9]+)?)', 1), lambda w: length(w) > 1), lambda w: {_NORMAL.format('w')}), lambda w: w <> '' AND w NOT IN ({_TERM_STOP}))))"
_REL = "CASE " + " ".join("WHEN " + " OR ".join(f"contains(cn, '{w}')" for w in words) + f" THEN '{kind}'" for words, kind in e.BONUS) + " ELSE '' END"
_PARTS = f"list_filter(string_split(list_last(string_split({_NORMAL.format('v')}, ':')), '_'), lambda p: p <> '')"
_EV = f"""{HYPEREDGES}, ev AS (SELECT ord AS evidence_id, vertices, relation_type, len(vertices)::INT AS arity, 'relation_type: ' || coalesce(relation_type, 'RELATION') || chr(10) || 'canonical_vertices: ' || array_to_string(vertices, ', ') || chr(10) || 'description: ' || coalesce(description, '') AS text FROM hyperedges),
    evn AS (SELECT *, {_NORMAL.format('text')} AS norm FROM ev),
    vp AS (SELECT evidence_id, unnest(vertices) AS v FROM ev), vparts AS (SELECT evidence_id, v, unnest({_PARTS}) AS p FROM vp),
    fact AS (SELECT ord AS fact_id, description, vertices, {_NORMAL.format('description')} AS cn, {_TERMS} AS ct FROM hyperedges WHERE description IS NOT NULL AND ord % 20 = 0), fr AS (SELECT *, replace(cn, ' ', '') AS cc, {_REL} AS cr FROM fact),
    ov AS (SELECT fact_id, evidence_id, count(DISTINCT v) AS n FROM fr JOIN vparts ON contains(cn, p) GROUP BY ALL),
    cond AS (SELECT evidence_id, v, replace({_NORMAL.format('v')}, ' ', '') AS c FROM vp WHERE starts_with(v, 'condition:')), nc AS (SELECT evidence_id, count(*) AS n FROM cond GROUP BY 1), oc AS (SELECT fact_id, evidence_id, count(*) AS n FROM fr JOIN cond ON contains(cc, c) GROUP BY ALL),
    sc AS (SELECT fr.fact_id, x.evidence_id, len(list_filter(ct, lambda t: contains(norm, t))) / greatest(1, len(ct)) AS lex, coalesce(ov.n, 0) / greatest(1, len(x.vertices)) AS ent, coalesce(oc.n, 0) / greatest(1, coalesce(nc.n, 0)) AS con, CASE WHEN cr <> '' AND len(list_filter(string_split(cr, '|'), lambda t: contains(coalesce(relation_type, ''), t))) > 0 THEN 1.0 ELSE 0.0 END AS bonus, arity
        FROM fr CROSS JOIN evn x LEFT JOIN ov ON ov.fact_id = fr.fact_id AND ov.evidence_id = x.evidence_id LEFT JOIN nc ON nc.evidence_id = x.evidence_id LEFT JOIN oc ON oc.fact_id = fr.fact_id AND oc.evidence_id = x.evidence_id)"""
_RANK = """rk AS (SELECT * FROM (SELECT fact_id, evidence_id, score, (row_number() OVER (PARTITION BY fact_id ORDER BY score DESC, evidence_id))::INT AS rank FROM (SELECT fact_id, evidence_id, round({s}, 6) AS score FROM sc)) WHERE rank <= {k} AND score > 0)"""
_HYB, _PLAIN = "0.45::DOUBLE * lex + 0.25::DOUBLE * ent + 0.15::DOUBLE * con + 0.05::DOUBLE * bonus + least(arity, 6) * 0.01::DOUBLE", "0.75::DOUBLE * lex + 0.25::DOUBLE * ent"
_JUDGE = f"""req AS (SELECT fact_id, CASE WHEN starts_with(el, 'condition:') THEN 'conditions' WHEN starts_with(el, 'metric:') THEN 'measurements' WHEN starts_with(el, 'degradation:') THEN 'mechanisms' ELSE 'entities' END AS kind, el FROM (SELECT fact_id, unnest(vertices) AS el FROM fact)),
    ctx AS (SELECT k, fact_id, list(vertices) AS ids, string_agg(replace(norm, ' ', ''), chr(10)) AS said FROM rk JOIN evn USING (evidence_id), (VALUES (1), (3), (5), (10)) ks(k) WHERE rank <= k GROUP BY ALL),
    th AS (SELECT ks.k, req.*, coalesce(list_contains(flatten(ids), el) OR contains(said, replace({_NORMAL.format("replace(list_last(string_split(el, ':')), '_', ' ')")}, ' ', '')), false) AS there FROM req CROSS JOIN (VALUES (1), (3), (5), (10)) ks(k) LEFT JOIN ctx ON ctx.k = ks.k AND ctx.fact_id = req.fact_id),
    s AS (SELECT k, fact_id, count(*) FILTER (there) / greatest(1, count(*)) AS support, count(*) FILTER (there AND kind = 'conditions') / greatest(1, count(*) FILTER (kind = 'conditions')) AS integrity, coalesce(list_sort(list(kind || ':' || el) FILTER (NOT there)), []) AS missing FROM th GROUP BY ALL),
    jd AS (SELECT k, fact_id, CASE WHEN support >= 0.85 AND integrity >= 0.8 THEN 'SUPPORTED' WHEN support >= 0.45 THEN 'PARTIALLY_SUPPORTED' ELSE 'UNSUPPORTED' END AS label, round(support, 4) AS support, round(integrity, 4) AS integrity, missing FROM s)"""
_J = "j AS (SELECT answer_id, mode, question_id, pos, lower(trim(j.judge_name)) AS judge, j.factual_correctness AS score, j.overall_score AS overall FROM (SELECT answer_id, mode, question_id, unnest(per_model_judgments) AS j, generate_subscripts(per_model_judgments, 1) - 1 AS pos FROM (SELECT DISTINCT answer_id, mode, question_id, per_model_judgments FROM evaluate_qa_answers)))"
_SLUG = "replace(replace(printf('%g', value), '-', 'minus_'), '.', '_')"
ORACLES = {
    "evidence_views": f"WITH {_EV} SELECT evidence_id, arity, md5(text) AS text_md5 FROM ev WHERE arity = 2",
    "evidence_rank": f"WITH {_EV}, {_RANK.format(s=_HYB, k=10)} SELECT * FROM rk",
    "evidence_rank_plain": f"WITH {_EV}, {_RANK.format(s=_PLAIN, k=5)} SELECT * FROM rk",
    "fact_judge": f"WITH {_EV}, {_RANK.format(s=_HYB, k=10)}, {_JUDGE} SELECT fact_id, label, support, integrity, array_to_string(missing, '|') AS missing FROM jd WHERE k = 10",
    "coverage_at_k": f"""WITH {_EV}, {_RANK.format(s=_HYB, k=10)}, {_JUDGE}, tk AS (SELECT ks.k, rk.fact_id, sum(len(list_filter(string_split_regex(text, '\\s+'), lambda t: t <> ''))) AS tokens FROM rk JOIN ev USING (evidence_id), (VALUES (1), (3), (5), (10)) ks(k) WHERE rank <= k GROUP BY ALL),
        a AS (SELECT k, count(*) AS facts, avg(support) AS soft, avg(integrity) AS integrity, avg(coalesce(tokens, 0)) AS budget, count(*) FILTER (label = 'SUPPORTED') AS supported, count(*) FILTER (label = 'PARTIALLY_SUPPORTED') AS partial, count(*) FILTER (label = 'UNSUPPORTED') AS unsupported FROM jd LEFT JOIN tk USING (k, fact_id) GROUP BY k)
        SELECT k, facts, round(supported / facts, 4) AS strict, round(soft, 4) AS soft, round(integrity, 4) AS integrity, round(budget, 2) AS budget, round(soft / greatest(1.0::DOUBLE, budget / 1000), 4) AS density, supported, partial, unsupported FROM a""",
    "missing_counts": f"WITH {_EV}, {_RANK.format(s=_HYB, k=10)}, {_JUDGE} SELECT element, count(*) AS n FROM (SELECT unnest(missing) AS element FROM jd WHERE k = 3) GROUP BY 1",
    "judge_majority": f"WITH {_J}, l AS (SELECT answer_id, CASE WHEN score >= 4 THEN 'SUPPORTED' WHEN score >= 2 THEN 'PARTIALLY_SUPPORTED' WHEN score IS NOT NULL THEN 'UNSUPPORTED' END AS label FROM j), c AS (SELECT answer_id, label, count(*) AS n FROM l WHERE label IS NOT NULL GROUP BY ALL) SELECT answer_id, label FROM (SELECT *, row_number() OVER (PARTITION BY answer_id ORDER BY n DESC, CASE label WHEN 'SUPPORTED' THEN 3 WHEN 'PARTIALLY_SUPPORTED' THEN 2 ELSE 1 END DESC) AS r FROM c) WHERE r = 1",
    "judge_spread": f"WITH {_J} SELECT answer_id, round(avg(score), 4) AS mean_score, round(stddev_pop(score), 4) AS std_score, count(*) AS n FROM j WHERE score IS NOT NULL GROUP BY 1",
    "qa_rollup": f"WITH {_J}, p AS (SELECT mode, answer_id, avg(score) AS f, avg(overall) AS o FROM j GROUP BY ALL) SELECT mode, round(avg(f), 4) AS factual, round(avg(o), 4) AS overall, count(*) AS answers FROM p GROUP BY mode",
    "score_mean": f"WITH {_J} SELECT judge, round(avg(score), 4) AS mean_score, count(*) AS n FROM j WHERE score BETWEEN 1 AND 5 GROUP BY ROLLUP (judge)",
    "win_rate": f"WITH {_J}, f AS (SELECT mode, answer_id, max(score) FILTER (pos = 0) AS a, max(score) FILTER (pos = 1) AS b FROM j WHERE pos < 2 AND score IS NOT NULL GROUP BY ALL) SELECT mode, round(avg(CASE WHEN a > b THEN 1.0 ELSE 0.0 END), 4) AS win_rate, count(*) AS n FROM f WHERE a IS NOT NULL AND b IS NOT NULL GROUP BY mode",
    "zip_answers": "WITH r AS (SELECT DISTINCT answer_id, mode, question_id FROM evaluate_qa_answers), n AS (SELECT *, (row_number() OVER (PARTITION BY question_id, mode ORDER BY answer_id))::INT AS nth FROM r), m AS (SELECT DISTINCT mode FROM r WHERE mode IS NOT NULL ORDER BY mode LIMIT 2) SELECT a.question_id, a.nth, a.answer_id AS left_id, b.answer_id AS right_id FROM n a JOIN n b ON a.question_id = b.question_id AND a.nth = b.nth WHERE a.mode = (SELECT min(mode) FROM m) AND b.mode = (SELECT max(mode) FROM m)",
    "flat_report": "SELECT coalesce(normalization_status, 'none') AS status, count(*) AS edges, count(*) FILTER (level_hg = 'High-order') AS high, count(*) FILTER (level_hg = 'Low-order') AS low, sum(coalesce(len(unresolved_vertices), 0))::BIGINT AS open_names FROM (SELECT DISTINCT edge_id, normalization_status, level_hg, unresolved_vertices FROM rewritten_hyperedge) GROUP BY 1",
    "expected_ids": f"""WITH q AS (SELECT DISTINCT quantity_id, quantity_type, value, unit, {_NORMAL.format('unit')} AS n, replace({_NORMAL.format('quantity_type')}, ' ', '') AS ck, {_NORMAL.format('quantity_type')} AS nk, [{", ".join(f"'{k}'" for k in _EXPECTED_KINDS)}][(quantity_id % {len(_EXPECTED_KINDS)} + 1)::INT] AS mk FROM parsed_quantity WHERE value IS NOT NULL AND quantity_type IS NOT NULL),
        u AS (SELECT *, {_SLUG} AS num, CASE WHEN value = floor(value) THEN replace(value::BIGINT || '_0', '-', 'minus_') ELSE {_SLUG} END AS whole, CASE WHEN n IN ('%', 'percent') THEN 'percent' WHEN n IN ('degree', 'deg') THEN 'degree' WHEN n IN ('cycle', 'cycles') THEN 'cycle' WHEN n = '' THEN 'unitless' ELSE replace(replace(n, ' ', ''), '/', '_') END AS slug FROM q)
        SELECT quantity_id, CASE WHEN contains(nk, 'current') THEN 'condition:current_density_' || num || '_ma_cm2' WHEN contains(nk, 'temperature') THEN 'condition:temperature_' || num || '_c' WHEN contains(nk, 'cycle') THEN 'condition:cycle_number_' || num || '_cycle' WHEN contains(nk, 'ph') THEN 'condition:ph_' || num
            WHEN contains(nk, 'bi') THEN 'condition:bi3_concentration_' || num || '_' || CASE WHEN coalesce(unit, '') = '' THEN 'mmol_l' ELSE slug END WHEN contains(nk, 'vanadium') THEN 'condition:vanadium_concentration_' || num || '_' || CASE WHEN coalesce(unit, '') = '' THEN 'mol_l' ELSE slug END
            WHEN contains(nk, 'acid') OR contains(nk, 'h2so4') THEN 'condition:acid_concentration_' || num || '_' || CASE WHEN coalesce(unit, '') = '' THEN 'mol_l' ELSE slug END ELSE 'condition:' || replace(ck, '/', '_') || '_' || num || '_' || slug END AS condition_id,
        CASE mk WHEN 'CE' THEN 'measurement:ce_' || whole || '_percent' WHEN 'coulombic efficiency' THEN 'measurement:ce_' || whole || '_percent' WHEN 'voltage efficiency' THEN 'measurement:ve_' || whole || '_percent' WHEN 'EE' THEN 'measurement:ee_' || whole || '_percent' WHEN 'capacity retention' THEN 'measurement:capacity_retention_' || whole || '_percent'
            WHEN 'IEC' THEN 'measurement:iec_' || num || '_mmol_g' WHEN 'contact angle' THEN 'measurement:contact_angle_' || num || '_degree' WHEN 'polarization voltage' THEN 'measurement:polarization_voltage_delta_' || num || '_v' WHEN 'metric:given' THEN mk ELSE 'measurement:powerdensity_' || num || '_' || slug END AS metric_id FROM u""",
}
