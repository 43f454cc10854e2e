"""Queries of catalogue changes and views over two graphs, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from knotwork.operators import graph as g
from knotwork.operators import merge as m
from knotwork.operators import resolve as s
from knotwork.operators.service import visible
from knotwork.plans import bindings as b
from knotwork.plans.bindings import HYPEREDGES
from knotwork.plans.resolve_queries import _M, RULES
from knotwork.plans.text_queries import _KEY
from knotwork.session import table


def _files(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "orders").select(F.col("o_orderkey").alias("file_id"), F.col("o_orderstatus").alias("status"), (F.col("o_custkey") % 50).cast("string").alias("kb"))


def catalog_status(spark: SparkSession, d: str) -> DataFrame:
    """Files with a new status for some: the changed rows replace theirs, the others stay."""
    files = _files(spark, d)
    changed = files.where("file_id % 5 = 0").select("file_id", F.lit("done").alias("status"), "kb")
    return g.upsert(files, changed, "file_id", ["status", "kb"])


def catalog_delete(spark: SparkSession, d: str) -> DataFrame:
    files = _files(spark, d)
    return files.join(files.where("kb = '7'").select("file_id"), "file_id", "left_anti").select("file_id", "kb")


def kb_names(spark: SparkSession, d: str) -> DataFrame:
    """Knowledge bases created from files: one a name, the first file founds it."""
    return _files(spark, d).groupBy("kb").agg(F.min("file_id").alias("first_file"))


def access_predicate(spark: SparkSession, d: str) -> DataFrame:
    """Databases a user may open: administrators all, others their own by prefix or file, and those without an owner."""
    rows = table(spark, d, "customer").select(F.concat(F.when(F.col("c_custkey") % 3 == 0, F.concat(F.lit("u_"), (F.col("c_custkey") % 5).cast("string"), F.lit("__"))).otherwise(F.lit("")), "c_name").alias("db"), F.when(F.col("c_custkey") % 4 == 0, (F.col("c_custkey") % 5).cast("string")).alias("owner"))
    user, admin = F.lit("2"), F.lit(False)
    open_to = admin | F.startswith("db", F.concat(F.lit("u_"), user, F.lit("__"))) | F.coalesce(F.col("owner") == user, F.lit(False)) | (visible(F.col("owner"), user, True) & ~F.startswith("db", F.lit("u_")))
    return rows.where(open_to).select("db", "owner")


def response_shape(spark: SparkSession, d: str) -> DataFrame:
    """Answers that are null, text or JSON brought to one shape."""
    rows = table(spark, d, "part").select("p_partkey", F.when(F.col("p_partkey") % 3 == 0, F.lit(None)).when(F.col("p_partkey") % 3 == 1, F.col("p_name")).otherwise(F.concat(F.lit('{"response": "'), F.col("p_name"), F.lit('", "entities": ["a", "b"]}'))).alias("raw"))
    parsed = F.from_json(F.when(F.startswith("raw", F.lit("{")), F.col("raw")), "response string, entities array<string>")
    return rows.select("p_partkey", F.coalesce(parsed.response, F.when(~F.startswith("raw", F.lit("{")), F.col("raw")), F.lit("")).alias("response"), F.coalesce(parsed.entities, F.array().cast("array<string>")).alias("entities"))


def theme_views(spark: SparkSession, d: str) -> DataFrame:
    """The same view over two graphs, told apart by a column: edges and arities of high-order and low-order mentions."""
    rows = b.hyperedges(spark, d).withColumn("graph", F.when(F.col("level_hg") == "High-order", "theme").otherwise("entity"))
    return rows.groupBy("graph").agg(F.count_distinct("edge_id").alias("edges"), F.sum(F.size("vertices")).alias("incidences"))


def decompose_roles(spark: SparkSession, d: str) -> DataFrame:
    """Entities that a mention names in its surface beside the one it resolves to: name words of the registry contained in the text."""
    rules = table(spark, d, "canonical_entity").where("entity_type in ('CONDITION', 'METRIC', 'DEGRADATION')").select("canonical_id", F.lower("canonical_name").alias("word"))
    said = b.hyperedges(spark, d).where("description is not null").select("ord", F.lower("description").alias("text"), "vertices")
    listed = [(r[0], r[1]) for r in rules.orderBy("canonical_id").collect()]  # role words of the registry, a configured table
    out = None
    for low in range(0, len(listed), 1_000):  # an expression holds a thousand words; further ones take further passes
        table_ = F.array(*[F.struct(F.lit(i).alias("canonical_id"), F.lit(w).alias("word")) for i, w in listed[low : low + 1_000]])
        found = F.filter(table_, lambda r: F.contains(F.col("text"), r["word"]) & ~F.array_contains("vertices", r["canonical_id"]))
        part = said.select("ord", F.explode(found).alias("r")).select("ord", "r.canonical_id")
        out = part if out is None else out.unionByName(part)
    return out if out is not None else said.select("ord", F.lit(None).cast("string").alias("canonical_id")).limit(0)


def adjudicated(spark: SparkSession, d: str) -> DataFrame:
    """The cascade with its open cases put to a provider; the offline one takes the first candidate of a name of letters only."""
    rows = table(spark, d, "alias_match").select(F.col("match_id").alias("mention_id"), F.col("canonical_name").alias("name"), "entity_type").dropDuplicates(["mention_id"])
    entities = table(spark, d, "canonical_entity")
    judged = s.cascade(rows, entities, RULES)

    def offline(batches):
        for batch in batches:
            plain = batch["name"].str.fullmatch(r"[A-Za-z \-]+")
            yield batch[["mention_id"]].assign(ruling=["MERGE" if x else "CREATE_NEW" for x in plain], target=[c[0] for c in batch["candidates"]], sure=0.9, review=False)

    return s.adjudicate(judged, rows, entities, RULES, offline).groupBy("decision", "method").agg(F.count("*").alias("n"), F.count_if(F.col("blocked_reason").isNotNull()).alias("blocked"))


def merge_upsert_nodes(spark: SparkSession, d: str) -> DataFrame:
    """Node mentions in two deliveries, merged as one: type by vote, sources and descriptions joined."""
    nodes = b.node_mentions(spark, d)
    merge = lambda df: m.majority(df, "entity_name", "entity_type", "ord").join(df.groupBy("entity_name").agg(m.joined("source_id").alias("sources"), F.count("*").alias("n")), "entity_name")
    return m.incremental(nodes.where("ord < 100"), nodes.where("ord >= 100"), merge)


def type_compatible_alias(spark: SparkSession, d: str) -> DataFrame:
    """Mentions whose name the registry holds under another type than the one typed: wrong types by pair."""
    names = s.registry(table(spark, d, "canonical_entity")).select("key", F.col("entity_type").alias("listed_type"), "canonical_id")
    rows = table(spark, d, "alias_match").select("match_id", "canonical_name", "entity_type").distinct().withColumn("key", s.match_key(F.col("canonical_name")))
    return rows.join(names, "key").where("entity_type is not null and entity_type <> listed_type").groupBy("entity_type", "listed_type").agg(F.count_distinct("match_id").alias("mentions"))


QUERIES = {f.__name__: f for f in (catalog_status, catalog_delete, kb_names, access_predicate, response_shape, theme_views, decompose_roles, adjudicated, merge_upsert_nodes, type_compatible_alias)}

_F = "f AS (SELECT o_orderkey AS file_id, o_orderstatus AS status, (o_custkey % 50)::VARCHAR AS kb FROM orders)"
_P = "(SELECT p_partkey, p_name, p_partkey % 3 AS k FROM part)"
ORACLES = {
    "catalog_status": f"WITH {_F} SELECT file_id, CASE WHEN file_id % 5 = 0 THEN 'done' ELSE status END AS status, kb FROM f",
    "catalog_delete": f"WITH {_F} SELECT file_id, kb FROM f WHERE kb <> '7'",
    "kb_names": f"WITH {_F} SELECT kb, min(file_id) AS first_file FROM f GROUP BY kb",
    "access_predicate": "WITH c AS (SELECT CASE WHEN c_custkey % 3 = 0 THEN 'u_' || (c_custkey % 5) || '__' ELSE '' END || c_name AS db, CASE WHEN c_custkey % 4 = 0 THEN (c_custkey % 5)::VARCHAR END AS owner FROM customer) SELECT db, owner FROM c WHERE starts_with(db, 'u_2__') OR owner = '2' OR (owner IS NULL AND NOT starts_with(db, 'u_'))",
    "response_shape": f"SELECT p_partkey, CASE WHEN k = 0 THEN '' ELSE p_name END AS response, CASE WHEN k = 2 THEN ['a', 'b'] ELSE [] END AS entities FROM {_P}",
    "theme_views": f"WITH {HYPEREDGES} SELECT CASE WHEN level_hg = 'High-order' THEN 'theme' ELSE 'entity' END AS graph, count(DISTINCT edge_id) AS edges, sum(len(vertices))::BIGINT AS incidences FROM hyperedges GROUP BY 1",
    "decompose_roles": f"WITH {HYPEREDGES} SELECT ord, canonical_id FROM hyperedges JOIN canonical_entity ON contains(lower(description), lower(canonical_name)) WHERE entity_type IN ('CONDITION', 'METRIC', 'DEGRADATION') AND NOT list_contains(vertices, canonical_id)",
    "merge_upsert_nodes": f"WITH {b.NODES}, v AS (SELECT entity_name, entity_type, count(*) AS n, min(ord) AS f FROM nodes GROUP BY ALL), w AS (SELECT entity_name, entity_type, row_number() OVER (PARTITION BY entity_name ORDER BY n DESC, f) AS r FROM v) SELECT n.entity_name, any_value(w.entity_type) AS entity_type, string_agg(DISTINCT source_id, '<SEP>' ORDER BY source_id) AS sources, count(*) AS n FROM nodes n JOIN w ON w.entity_name = n.entity_name AND r = 1 GROUP BY 1",
    "type_compatible_alias": f"WITH {_M}, n AS (SELECT DISTINCT canonical_id, entity_type, {_KEY.format('name')} AS key FROM (SELECT canonical_id, entity_type, unnest(list_concat([canonical_name], aliases)) AS name FROM canonical_entity)) SELECT m.entity_type, n.entity_type AS listed_type, count(DISTINCT mention_id) AS mentions FROM m JOIN n ON n.key = {_KEY.format('m.name')} WHERE m.entity_type <> n.entity_type GROUP BY ALL",
}
