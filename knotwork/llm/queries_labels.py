"""Queries on names and on judges' labels."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from knotwork.functions.sizes import join_hot
from knotwork.llm.consensus import Consensus, agreement, votes
from knotwork.llm.names import resolve_names, spellings, typed_names
from knotwork.session import table


def p2_found(spark: SparkSession, folder: str) -> DataFrame:
    names = typed_names(table(spark, folder, "alias_match"), table(spark, folder, "rewritten_hyperedge"))
    won = resolve_names(names, spellings(table(spark, folder, "canonical_entity")))
    return join_hot(names, won, ["name"]).select("src", "row_id", "pos", "canonical_id")


def p2_unresolved(spark: SparkSession, folder: str) -> DataFrame:
    """The values no entry could be found for, with how often they were typed."""
    names = typed_names(table(spark, folder, "alias_match"), table(spark, folder, "rewritten_hyperedge"))
    won = resolve_names(names, spellings(table(spark, folder, "canonical_entity"))).where("canonical_id = 'UNRESOLVED'")
    return names.groupBy("src", "name").count().join(won.select("name"), "name").select("src", "name", "count")


def p7_found(spark: SparkSession, folder: str) -> DataFrame:
    return Consensus(votes(table(spark, folder, "evaluate_qa_answers"))).labels().select("answer_id", "label")


def p7_judges(spark: SparkSession, folder: str) -> DataFrame:
    return Consensus(votes(table(spark, folder, "evaluate_qa_answers"))).judges()


def p7_agreement(spark: SparkSession, folder: str) -> DataFrame:
    return agreement(votes(table(spark, folder, "evaluate_qa_answers")))


QUERIES = {"p2_found": p2_found, "p2_unresolved": p2_unresolved, "p7_found": p7_found, "p7_judges": p7_judges, "p7_agreement": p7_agreement}
ORACLES = {
    # Krippendorff's alpha by its definition: coincidences of every pair of scores within an answer, ordinal distance.
    "p7_agreement": r"""
        WITH a AS (SELECT DISTINCT ON (answer_id) answer_id, per_model_judgments AS js FROM evaluate_qa_answers WHERE answer_id IS NOT NULL),
        e AS (SELECT answer_id, generate_subscripts(js, 1) AS pos, unnest(js) AS j FROM a),
        u AS (SELECT answer_id, pos, lower(regexp_replace(j.judge_name, '^[\s\p{Z}]+|[\s\p{Z}]+$', '', 'g')) AS name, j.factual_correctness AS score FROM e),
        v AS (SELECT answer_id, name, arg_min(score, pos)::INT AS score FROM u WHERE name <> '' AND score BETWEEN 1 AND 5 AND score = floor(score) GROUP BY answer_id, name),
        w AS (SELECT *, count(*) OVER (PARTITION BY answer_id) AS m FROM v),
        o AS (SELECT x.score AS c, y.score AS k, sum(1.0::DOUBLE / (x.m - 1)) AS o FROM w x JOIN w y ON x.answer_id = y.answer_id AND x.name <> y.name GROUP BY 1, 2),
        n AS (SELECT c, sum(o) AS n FROM o GROUP BY c),
        d AS (SELECT a.c, b.c AS k, a.n AS nc, b.n AS nk, power((SELECT sum(n) FROM n WHERE c BETWEEN least(a.c, b.c) AND greatest(a.c, b.c)) - (a.n + b.n) / 2, 2) AS d FROM n a, n b WHERE a.c <> b.c),
        t AS (SELECT sum(n) AS n FROM n)
        SELECT round(t.n, 6) AS pairable, round(1 - (SELECT sum(o.o * d.d) FROM o JOIN d USING (c, k)) / ((SELECT sum(nc * nk * d) FROM d) / (t.n - 1)), 4) AS alpha FROM t""",
}
