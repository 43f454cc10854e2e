"""Queries of the merge operators over lineitem edge mentions and part node mentions, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from knotwork.operators import merge as m
from knotwork.plans import bindings as b
from knotwork.plans.bindings import HYPEREDGES, MENTIONS, NODES
from knotwork.session import table


def merge_nodes(spark: SparkSession, d: str) -> DataFrame:
    return b.node_mentions(spark, d).groupBy("entity_name").agg(F.count("*").alias("mentions"), F.count_distinct("entity_type").alias("types"))


def merge_type_vote(spark: SparkSession, d: str) -> DataFrame:
    return m.majority(b.node_mentions(spark, d), "entity_name", "entity_type", "ord")


def merge_description(spark: SparkSession, d: str) -> DataFrame:
    return b.node_mentions(spark, d).groupBy("entity_name").agg(m.joined("description").alias("description"))


def merge_sources(spark: SparkSession, d: str) -> DataFrame:
    return b.node_mentions(spark, d).groupBy("entity_name").agg(m.joined("source_id").alias("source_id"))


def merge_structured(spark: SparkSession, d: str) -> DataFrame:
    rows = b.node_mentions(spark, d).withColumn("entity_name", F.concat_ws(" ", "entity_name", "description"))
    return m.structured(rows, "entity_name", ["unit", "entity_type"], "value")


def merge_properties(spark: SparkSession, d: str) -> DataFrame:
    return b.node_mentions(spark, d).select("ord", m.properties(["unit", "entity_type", "description"]).alias("properties"))


def merge_metadata(spark: SparkSession, d: str) -> DataFrame:
    return m.metadata(b.node_mentions(spark, d), "entity_name", "ord", "unit", "description", "need_review", "confidence")


def merge_edges(spark: SparkSession, d: str) -> DataFrame:
    return m.merge_edges(b.mentions(spark, d))


def edge_canonical_desc(spark: SparkSession, d: str) -> DataFrame:
    return m.longest(b.mentions(spark, d), "edge_id", "description")


def evidence_instances(spark: SparkSession, d: str) -> DataFrame:
    rows = b.hyperedges(spark, d).withColumns({c: F.coalesce(c, F.lit("")) for c in ("source_id", "description", "evidence_span", "relation_type")})
    return m.evidence(rows, "edge_id", ["source_id", "description", "evidence_span", "relation_type"], "ord").select("edge_id", F.size("evidence_instances").alias("instances"), F.array_join("evidence_instances.description", "|").alias("descriptions"))


def incremental_upsert(spark: SparkSession, d: str) -> DataFrame:
    rows = b.mentions(spark, d)
    return m.incremental(rows.where("ord % 2 = 0"), rows.where("ord % 2 = 1"), m.merge_edges)


def index_rows(spark: SparkSession, d: str) -> DataFrame:
    return m.index_rows(merge_description(spark, d), "entity_name", "description")


def edge_index_rows(spark: SparkSession, d: str) -> DataFrame:
    return m.edge_index_rows(b.hyperedges(spark, d))


def type_distribution(spark: SparkSession, d: str) -> DataFrame:
    return b.node_mentions(spark, d).groupBy("source_id", "entity_type").agg(F.count("*").alias("n"))


def progress_counters(spark: SparkSession, d: str) -> DataFrame:
    return b.hyperedges(spark, d).groupBy("source_id").agg(F.count_if(F.size("vertices") == 2).alias("low"), F.count_if(F.size("vertices") > 2).alias("high"), F.count("*").alias("edges"))


def kv_insert_only(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").select("doc_id", "section")
    stored = docs.where("section = 'abstract'")
    return stored.select("doc_id", F.lit("stored").alias("section")).unionByName(m.insert_only(stored, docs, "doc_id"))


def kv_get_by_ids(spark: SparkSession, d: str) -> DataFrame:
    ids = table(spark, d, "lineitem").select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("pos"), (F.col("l_partkey") + 50).alias("id"))
    return m.by_ids(table(spark, d, "part"), ids, "p_partkey", ["p_name", "p_brand"])


def summarise_descriptions(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").where("text is not null and length(trim(text)) > 0").select("doc_id", F.md5(m.summarise(F.regexp_replace("text", r"[\s\p{Z}]+", " "), 50)).alias("summary"))


def token_truncate(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "documents").where("paper_id is not null").select("paper_id", "doc_id", F.coalesce("n_chars", F.lit(0)).alias("tokens"))
    return m.token_prefix(rows, "paper_id", ["doc_id"], "tokens", 4000).select("paper_id", "doc_id", "upto")


def sources_union(spark: SparkSession, d: str) -> DataFrame:
    """Set union, difference and intersection of two edges' vertex lists, order of the first kept."""
    rows = b.hyperedges(spark, d).where(F.size("raw_vertices") > 0).select("ord", F.array_compact("raw_vertices").alias("a"), "vertices")
    return rows.select("ord", F.size(F.array_union("a", "vertices")).alias("n_union"), F.array_except("a", "vertices").alias("only_raw"), F.size(F.array_intersect("a", "vertices")).alias("n_both"), F.array_distinct("a").alias("distinct_raw"))


QUERIES = {f.__name__: f for f in (merge_nodes, merge_type_vote, merge_description, merge_sources, merge_structured, merge_properties, merge_metadata, merge_edges, edge_canonical_desc, evidence_instances, incremental_upsert, index_rows, edge_index_rows, type_distribution, progress_counters, kv_insert_only, kv_get_by_ids, summarise_descriptions, token_truncate, sources_union)}

_VOTE = "v AS (SELECT {k}, {v}, count(*) AS n, min(ord) AS f FROM {t} WHERE {v} IS NOT NULL GROUP BY ALL), w AS (SELECT {k}, {v}, row_number() OVER (PARTITION BY {k} ORDER BY n DESC, f) AS r FROM v)"
_EDGES = "SELECT edge_id, any_value(vertices) AS vertices, round(sum(weight), 6) AS weight, count(*) AS n, string_agg(DISTINCT keywords, '<SEP>' ORDER BY keywords) AS keywords, string_agg(DISTINCT relation_type, '<SEP>' ORDER BY relation_type) AS relation_types, string_agg(DISTINCT source_id, '<SEP>' ORDER BY source_id) AS sources FROM mentions GROUP BY edge_id"
ORACLES = {
    "merge_nodes": f"WITH {NODES} SELECT entity_name, count(*) AS mentions, count(DISTINCT entity_type) AS types FROM nodes GROUP BY 1",
    "merge_type_vote": f"WITH {NODES}, {_VOTE.format(k='entity_name', v='entity_type', t='nodes')} SELECT entity_name, entity_type FROM w WHERE r = 1",
    "merge_description": f"WITH {NODES} SELECT entity_name, string_agg(DISTINCT description, '<SEP>' ORDER BY description) AS description FROM nodes GROUP BY 1",
    "merge_sources": f"WITH {NODES} SELECT entity_name, string_agg(DISTINCT source_id, '<SEP>' ORDER BY source_id) AS source_id FROM nodes GROUP BY 1",
    "merge_structured": f"WITH {NODES} SELECT entity_name || ' ' || description AS entity_name, coalesce(list_sort(list(DISTINCT unit) FILTER (unit IS NOT NULL)), []) AS unit, list_sort(list(DISTINCT entity_type)) AS entity_type, CASE WHEN count(value) <= 1 THEN min(value) END AS value, CASE WHEN count(value) > 1 THEN min(value) END AS value_min, CASE WHEN count(value) > 1 THEN max(value) END AS value_max FROM nodes GROUP BY 1",
    "merge_properties": f"WITH {NODES} SELECT ord, array_to_string(list_sort(list_filter(['unit=' || unit, 'entity_type=' || entity_type, 'description=' || description], lambda x: x IS NOT NULL)), '<SEP>') AS properties FROM nodes",
    "merge_metadata": f"WITH {NODES}, {_VOTE.format(k='entity_name', v='unit', t='nodes')} SELECT n.entity_name, coalesce(bool_or(need_review), false) AS need_review, list_sort(list(DISTINCT description)) AS mentions, max(confidence) AS confidence, any_value(w.unit) AS unit FROM nodes n LEFT JOIN w ON w.entity_name = n.entity_name AND r = 1 GROUP BY 1",
    "merge_edges": f"WITH {MENTIONS} {_EDGES}",
    "edge_canonical_desc": f"WITH {MENTIONS}, p AS (SELECT edge_id, trim(unnest(string_split(description, '<SEP>'))) AS description FROM mentions), r AS (SELECT *, row_number() OVER (PARTITION BY edge_id ORDER BY length(description) DESC, description DESC) AS r FROM p WHERE description <> '') SELECT edge_id, description FROM r WHERE r = 1",
    "evidence_instances": f"""WITH {HYPEREDGES}, f AS (SELECT edge_id, coalesce(source_id, '') s, coalesce(description, '') AS description, coalesce(evidence_span, '') e, coalesce(relation_type, '') t, min(ord) AS ord FROM hyperedges GROUP BY ALL)
        SELECT edge_id, count(*)::INT AS instances, string_agg(description, '|' ORDER BY ord, s, description, e, t) AS descriptions FROM f GROUP BY edge_id""",
    "incremental_upsert": f"WITH {MENTIONS} {_EDGES}",
    "index_rows": f"WITH {NODES} SELECT 'ent-' || md5(entity_name) AS id, entity_name || string_agg(DISTINCT description, '<SEP>' ORDER BY description) AS content FROM nodes GROUP BY entity_name",
    "edge_index_rows": f"WITH {HYPEREDGES} SELECT 'rel-' || md5(array_to_string(vertices, ',')) AS id, concat_ws(' ', keywords, array_to_string(vertices, ','), description) AS content FROM hyperedges",
    "type_distribution": f"WITH {NODES} SELECT source_id, entity_type, count(*) AS n FROM nodes GROUP BY ALL",
    "progress_counters": f"WITH {HYPEREDGES} SELECT source_id, count(*) FILTER (len(vertices) = 2) AS low, count(*) FILTER (len(vertices) > 2) AS high, count(*) AS edges FROM hyperedges GROUP BY 1",
    "kv_insert_only": "SELECT doc_id, CASE WHEN section = 'abstract' THEN 'stored' ELSE section END AS section FROM documents",
    "kv_get_by_ids": "SELECT l_orderkey * 10 + l_linenumber AS pos, l_partkey + 50 AS id, p_name, p_brand FROM lineitem LEFT JOIN part ON p_partkey = l_partkey + 50",
    "token_truncate": "WITH t AS (SELECT paper_id, doc_id, (sum(coalesce(n_chars, 0)) OVER (PARTITION BY paper_id ORDER BY doc_id ROWS UNBOUNDED PRECEDING))::BIGINT AS upto FROM documents WHERE paper_id IS NOT NULL) SELECT * FROM t WHERE upto <= 4000",
    "sources_union": f"""WITH {HYPEREDGES}, r AS (SELECT ord, list_filter(raw_vertices, lambda x: x IS NOT NULL) AS a, vertices AS v FROM hyperedges WHERE len(raw_vertices) > 0),
        p AS (SELECT ord, unnest(a) AS x, generate_subscripts(a, 1) AS i FROM r), f AS (SELECT ord, x, min(i) AS i FROM p GROUP BY ALL), q AS (SELECT ord, list(x ORDER BY i) AS da FROM f GROUP BY ord)
        SELECT r.ord, len(list_distinct(list_concat(a, v)))::INT AS n_union, coalesce(list_filter(da, lambda x: NOT list_contains(v, x)), []) AS only_raw, len(list_filter(da, lambda x: list_contains(v, x)))::INT AS n_both, coalesce(da, []) AS distinct_raw FROM r LEFT JOIN q USING (ord)""",
}
