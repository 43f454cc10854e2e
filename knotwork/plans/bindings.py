"""Frames of the data model drawn from the given tables, and the same as SQL for the checks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from knotwork.operators.graph import edge_id, edge_key
from knotwork.session import table


def mentions(spark: SparkSession, d: str) -> DataFrame:
    """One edge mention a lineitem: brand, supplier's nation and customer's segment."""
    t = lambda n: table(spark, d, n)
    rows = t("lineitem").join(t("part").select("p_partkey", "p_brand", "p_type"), F.col("l_partkey") == F.col("p_partkey")).join(t("supplier").select("s_suppkey", "s_nationkey"), F.col("l_suppkey") == F.col("s_suppkey")).join(t("nation").select("n_nationkey", "n_name"), F.col("s_nationkey") == F.col("n_nationkey")).join(t("orders").select("o_orderkey", "o_custkey"), F.col("l_orderkey") == F.col("o_orderkey")).join(t("customer").select("c_custkey", "c_mktsegment"), F.col("o_custkey") == F.col("c_custkey"))
    vertices = edge_key(F.array("p_brand", "n_name", "c_mktsegment"))
    return rows.select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).cast("bigint").alias("ord"), vertices.alias("vertices"), edge_id(vertices).alias("edge_id"), (F.col("l_quantity") / 10).alias("weight"), F.col("l_returnflag").alias("relation_type"), F.col("l_linestatus").alias("keywords"), F.concat(F.lit("chunk-"), (F.col("l_orderkey") % 97).cast("string")).alias("source_id"), F.concat_ws(" ", "p_type", "l_returnflag").alias("description"))


MENTIONS = """
mentions AS (
    SELECT ord, vertices, md5(array_to_string(vertices, chr(1))) AS edge_id, weight, relation_type, keywords, source_id, description FROM (
        SELECT (l_orderkey * 10 + l_linenumber)::BIGINT AS ord, list_sort(list_distinct([p_brand, n_name, c_mktsegment])) AS vertices, l_quantity / 10 AS weight,
            l_returnflag AS relation_type, l_linestatus AS keywords, 'chunk-' || (l_orderkey % 97) AS source_id, p_type || ' ' || l_returnflag AS description
        FROM lineitem JOIN part ON l_partkey = p_partkey JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey
        JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey))"""


def hyperedges(spark: SparkSession, d: str) -> DataFrame:
    """The stored hyperedges, each edge_id once, with canonical vertices; the table's edge_id is the mention's number `ord`."""
    rows = table(spark, d, "rewritten_hyperedge").select(F.col("edge_id").alias("ord"), "vertices", "canonical_vertices", "relation_type", "level_hg", "description", "keywords", "strength", "evidence_span", "source_id", "paper_id").dropDuplicates(["ord"])  # by the id, so that queries read only the columns they use
    key = edge_key(F.col("canonical_vertices"))
    return rows.withColumns({"raw_vertices": F.col("vertices"), "vertices": key}).where(F.size("vertices") > 0).withColumn("edge_id", edge_id(F.col("vertices"))).drop("canonical_vertices")


HYPEREDGES = """
hyperedges AS (
    SELECT *, md5(array_to_string(vertices, chr(1))) AS edge_id FROM (
        SELECT DISTINCT edge_id AS ord, vertices AS raw_vertices, list_sort(list_distinct(list_filter(canonical_vertices, lambda x: x IS NOT NULL))) AS vertices,
            relation_type, level_hg, description, keywords, strength, evidence_span, source_id, paper_id FROM rewritten_hyperedge)
    WHERE len(vertices) > 0)"""


def edges(spark: SparkSession, d: str) -> DataFrame:
    """Distinct edges of the hyperedge table: edge_id, vertices, mentions, weight (sum of strengths over ten)."""
    return hyperedges(spark, d).groupBy("edge_id", "vertices").agg(F.count("*").alias("mentions"), F.sum(F.coalesce("strength", F.lit(5))).alias("strength"))


EDGES = HYPEREDGES + """,
edges AS (SELECT edge_id, any_value(vertices) AS vertices, count(*) AS mentions, sum(coalesce(strength, 5))::BIGINT AS strength FROM hyperedges GROUP BY edge_id),
incidence AS (SELECT edge_id, unnest(vertices) AS vertex_id FROM edges)"""


def vertices(spark: SparkSession, d: str) -> DataFrame:
    """The canonical entities as stored vertices (names that no entity has occur in edges only)."""
    return table(spark, d, "canonical_entity").select(F.col("canonical_id").alias("vertex_id"), "canonical_name", "entity_type", "semantic_group")


VERTICES = "vertices AS (SELECT canonical_id AS vertex_id, canonical_name, entity_type, semantic_group FROM canonical_entity)"


def node_mentions(spark: SparkSession, d: str) -> DataFrame:
    """One entity mention a part: name is the brand, type, description, value and sources from the part."""
    return table(spark, d, "part").select(F.col("p_partkey").alias("ord"), F.col("p_brand").alias("entity_name"), F.col("p_type").alias("entity_type"), F.col("p_name").alias("description"), F.col("p_retailprice").alias("value"), F.when(F.col("p_size") % 3 == 0, F.lit(None)).otherwise(F.concat(F.lit("u"), (F.col("p_size") % 3).cast("string"))).alias("unit"), F.concat(F.lit("chunk-"), (F.col("p_partkey") % 97).cast("string")).alias("source_id"), (F.col("p_size") % 7 == 0).alias("need_review"), (F.col("p_size") / 50).alias("confidence"))


NODES = """
nodes AS (
    SELECT p_partkey AS ord, p_brand AS entity_name, p_type AS entity_type, p_name AS description, p_retailprice AS value,
        CASE WHEN p_size % 3 <> 0 THEN 'u' || (p_size % 3) END AS unit, 'chunk-' || (p_partkey % 97) AS source_id, p_size % 7 = 0 AS need_review, p_size / 50 AS confidence FROM part)"""
