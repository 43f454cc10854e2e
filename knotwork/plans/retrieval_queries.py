"""Queries of vector search and retrieval, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from knotwork.functions.text import strip
from knotwork.operators import retrieval as r
from knotwork.operators import vectors as v
from knotwork.plans import bindings as b
from knotwork.plans.bindings import HYPEREDGES, VERTICES
from knotwork.session import durable, table


def _query(spark: SparkSession, d: str) -> list[float]:
    return list(table(spark, d, "embeddings").orderBy("vec_id").limit(1).first()["embedding"])


def vec_topk(spark: SparkSession, d: str) -> DataFrame:
    return v.top_k(table(spark, d, "embeddings"), _query(spark, d), 60).select("vec_id", F.round("similarity", 6).alias("similarity"))


def vec_topk_multi(spark: SparkSession, d: str) -> DataFrame:
    """Every row whose id is divisible by 20 as a query against all rows."""
    rows = table(spark, d, "embeddings")
    return v.top_k_many(rows, rows.where("vec_id % 20 = 0"), 10).select("query", "id", F.round("similarity", 6).alias("similarity"), "rank")


def _edges(spark: SparkSession, d: str) -> DataFrame:
    return b.hyperedges(spark, d).groupBy("edge_id").agg(F.first("vertices").alias("vertices"), F.sum(F.coalesce("strength", F.lit(5))).alias("strength"), F.min_by("description", "ord").alias("description"))


def _sources(spark: SparkSession, d: str) -> DataFrame:
    return b.hyperedges(spark, d).where("source_id is not null").select(F.explode("vertices").alias("vertex_id"), F.col("source_id").alias("chunk_id")).distinct()


def _edge_sources(spark: SparkSession, d: str) -> DataFrame:
    return b.hyperedges(spark, d).where("source_id is not null").select("edge_id", F.col("source_id").alias("chunk_id")).distinct()


def _chunks(spark: SparkSession, d: str) -> DataFrame:
    """A chunk's text: the descriptions of its hyperedges in order."""
    rows = b.hyperedges(spark, d).where("source_id is not null").groupBy(F.col("source_id").alias("chunk_id")).agg(F.array_sort(F.collect_list(F.struct("ord", F.coalesce("description", F.lit("")).alias("t")))).alias("l"))
    return rows.select("chunk_id", F.array_join("l.t", " ").alias("content"))


def _hits(spark: SparkSession, d: str, k: int = 12) -> DataFrame:
    """The entities whose vectors (by entity_no) are nearest to the first vector."""
    entity = table(spark, d, "canonical_entity").select(F.col("entity_no").alias("vec_id"), F.col("canonical_id").alias("vertex_id"))
    hits = v.top_k(table(spark, d, "embeddings").join(F.broadcast(entity.select("vec_id")), "vec_id", "left_semi"), _query(spark, d), k, threshold=-1.0)
    return hits.join(entity, "vec_id").select("vertex_id", (F.row_number().over(Window.orderBy(F.desc("similarity"), "vec_id")) - 1).alias("place"))


def _edge_hits(spark: SparkSession, d: str, k: int = 40) -> DataFrame:
    """The edges of the mentions with the least hash: a stand-in for edge vectors."""
    return b.hyperedges(spark, d).select("edge_id", F.md5(F.col("ord").cast("string")).alias("h")).orderBy("h").limit(k)


def entity_context_nodes(spark: SparkSession, d: str) -> DataFrame:
    return r.entity_rows(_hits(spark, d), b.vertices(spark, d), _edges(spark, d))


def entity_context_edges(spark: SparkSession, d: str) -> DataFrame:
    return r.edges_of_entities(durable(_hits(spark, d)), durable(_edges(spark, d)), 400)


def entity_context_units(spark: SparkSession, d: str) -> DataFrame:
    return r.units_of_entities(durable(_hits(spark, d)), durable(_edges(spark, d)), durable(_sources(spark, d)), _chunks(spark, d), 1600)


def relation_context_edges(spark: SparkSession, d: str) -> DataFrame:
    return r.relation_rows(_edge_hits(spark, d), _edges(spark, d), 400)


def relation_context_entities(spark: SparkSession, d: str) -> DataFrame:
    return r.entities_of_relations(r.relation_rows(_edge_hits(spark, d), _edges(spark, d), 400), b.vertices(spark, d), 100)


def relation_context_units(spark: SparkSession, d: str) -> DataFrame:
    return r.units_of_relations(r.relation_rows(_edge_hits(spark, d), _edges(spark, d), 400), _edge_sources(spark, d), _chunks(spark, d), 1600)


def context_combine(spark: SparkSession, d: str) -> DataFrame:
    """Entities of the relation side, then of the entity side, each once."""
    one = relation_context_entities(spark, d).select("place", F.concat_ws(",", "vertex_id", "canonical_name").alias("payload"))
    two = entity_context_nodes(spark, d).select("place", F.concat_ws(",", "vertex_id", "canonical_name").alias("payload"))
    return r.combine(one, two)


def json_dedupe(spark: SparkSession, d: str) -> DataFrame:
    return r.dedupe_by_key(b.hyperedges(spark, d).select("ord", "raw_vertices", "relation_type"), "raw_vertices", "ord").select("ord", "relation_type")


def graph_mode(spark: SparkSession, d: str) -> DataFrame:
    engine = r.Engine(b.vertices(spark, d), _edges(spark, d), _sources(spark, d), _edge_sources(spark, d), _chunks(spark, d), r.Budget(relations=400))
    return engine.context("graph", edge_hits=_edge_hits(spark, d))["relations"]


def naive_mode(spark: SparkSession, d: str) -> DataFrame:
    """The chunks of the least hash as hits, cut to the budget, as one text."""
    hits = _chunks(spark, d).select("chunk_id", F.md5("chunk_id").alias("h")).orderBy("h").limit(60).select("chunk_id", (F.row_number().over(Window.orderBy("h")) - 1).alias("place"))
    engine = r.Engine(b.vertices(spark, d), _edges(spark, d), _sources(spark, d), _edge_sources(spark, d), _chunks(spark, d))
    units = engine.context("naive", chunk_hits=hits)["units"]
    listed = F.array_sort(F.collect_list(F.struct("place", "content")))
    return units.agg(F.md5(F.array_join(F.transform(listed, lambda x: x["content"]), "--New Chunk--\n")).alias("context_md5"), F.count("*").alias("chunks"))


def context_sections(spark: SparkSession, d: str) -> DataFrame:
    """The entity section of a context as text."""
    return r.section(entity_context_nodes(spark, d), "place", ["vertex_id", "entity_type", "degree"])


def echo_cleanup(spark: SparkSession, d: str) -> DataFrame:
    """An answer that repeats its prompt, without the prompt and the role names."""
    said = F.concat(F.lit("system text user"), "question", F.lit("model"), "answer")
    out = F.replace(F.replace(F.replace(F.replace(said, F.lit("system text "), F.lit("")), F.lit("user"), F.lit("")), F.lit("model"), F.lit("")), F.col("question"), F.lit(""))
    return table(spark, d, "evaluate_qa_answers").select("answer_id", "question", "answer").distinct().where("question is not null and question <> ''").select("answer_id", strip(out).alias("answer"))


def embed_rows(spark: SparkSession, d: str) -> DataFrame:
    """The offline embedding of the entities' names."""
    return v.embed_hashed(table(spark, d, "canonical_entity"), "entity_no", "canonical_name").select("entity_no", F.size("embedding").alias("dim"), F.round(F.aggregate("embedding", F.lit(0.0), lambda s, x: s + x * x), 3).alias("length"))


QUERIES = {f.__name__: f for f in (vec_topk, vec_topk_multi, entity_context_nodes, entity_context_edges, entity_context_units, relation_context_edges, relation_context_entities, relation_context_units, context_combine, json_dedupe, graph_mode, naive_mode, context_sections, echo_cleanup, embed_rows)}

_COS = "list_dot_product({a}::DOUBLE[], {b}::DOUBLE[]) / (sqrt(list_dot_product({a}::DOUBLE[], {a}::DOUBLE[])) * sqrt(list_dot_product({b}::DOUBLE[], {b}::DOUBLE[])))"
_TOK = "len(list_filter(string_split_regex(coalesce({}, ''), '\\s+'), lambda x: x <> ''))"
_Q0 = "q0 AS (SELECT embedding AS q FROM embeddings ORDER BY vec_id LIMIT 1)"
_BASE = f"""{HYPEREDGES}, {VERTICES}, {_Q0}, e AS (SELECT edge_id, any_value(vertices) AS vertices, sum(coalesce(strength, 5))::BIGINT AS strength, arg_min_null(description, ord) AS description FROM hyperedges GROUP BY edge_id),
    inc AS (SELECT edge_id, unnest(vertices) AS vertex_id FROM e), src AS (SELECT DISTINCT unnest(vertices) AS vertex_id, source_id AS chunk_id FROM hyperedges WHERE source_id IS NOT NULL), esrc AS (SELECT DISTINCT edge_id, source_id AS chunk_id FROM hyperedges WHERE source_id IS NOT NULL),
    ch AS (SELECT source_id AS chunk_id, string_agg(coalesce(description, ''), ' ' ORDER BY ord) AS content FROM hyperedges WHERE source_id IS NOT NULL GROUP BY 1),
    hits AS (SELECT canonical_id AS vertex_id, (row_number() OVER (ORDER BY s DESC, vec_id) - 1)::INT AS place FROM (SELECT vec_id, {_COS.format(a='embedding', b='q')} AS s FROM embeddings, q0 WHERE vec_id IN (SELECT entity_no FROM canonical_entity)) JOIN canonical_entity ON entity_no = vec_id QUALIFY place < 12),
    eh AS (SELECT edge_id FROM hyperedges ORDER BY md5(ord::VARCHAR) LIMIT 40)"""


def _prefix(rows: str, order: str, budget: int, columns: str) -> str:
    return f"SELECT {columns} FROM (SELECT *, (row_number() OVER (ORDER BY {order}) - 1)::INT AS place, sum(size) OVER (ORDER BY {order} ROWS UNBOUNDED PRECEDING) AS upto FROM ({rows})) WHERE upto <= {budget}"


_REL = _prefix(f"SELECT edge_id, vertices, len(vertices)::INT AS arity, strength, {_TOK.format('description')} AS size FROM e WHERE edge_id IN (SELECT edge_id FROM eh)", "arity DESC, strength DESC, edge_id", 400, "place, edge_id, vertices, arity, strength")
_NODES = "SELECT place, h.vertex_id, canonical_name, entity_type, count(inc.edge_id) AS degree FROM hits h JOIN vertices USING (vertex_id) LEFT JOIN inc ON inc.vertex_id = h.vertex_id GROUP BY ALL"
_RELENT = _prefix(f"SELECT vertex_id, canonical_name, min((place, pos)) AS at_, {_TOK.format('canonical_name')} AS size FROM (SELECT place, unnest(vertices) AS vertex_id, generate_subscripts(vertices, 1) AS pos FROM rel) JOIN vertices USING (vertex_id) GROUP BY vertex_id, canonical_name", "at_", 100, "place, vertex_id, canonical_name")
ORACLES = {
    "vec_topk": f"WITH {_Q0} SELECT vec_id, round(s, 6) AS similarity FROM (SELECT vec_id, {_COS.format(a='embedding', b='q')} AS s FROM embeddings, q0) WHERE s >= 0.2 ORDER BY s DESC, vec_id LIMIT 60",
    "vec_topk_multi": f"WITH s AS (SELECT a.vec_id AS query, b.vec_id AS id, {_COS.format(a='a.embedding', b='b.embedding')} AS s FROM embeddings a, embeddings b WHERE a.vec_id % 20 = 0), r AS (SELECT *, (row_number() OVER (PARTITION BY query ORDER BY s DESC, id))::INT AS rank FROM s WHERE s >= 0.2) SELECT query, id, round(s, 6) AS similarity, rank FROM r WHERE rank <= 10",
    "entity_context_nodes": f"WITH {_BASE} {_NODES}",
    "entity_context_edges": f"WITH {_BASE} " + _prefix(f"SELECT edge_id, len(vertices)::INT AS arity, strength, {_TOK.format('description')} AS size FROM e WHERE edge_id IN (SELECT edge_id FROM inc JOIN hits USING (vertex_id))", "arity DESC, strength DESC, edge_id", 400, "place, edge_id, arity, strength"),
    "entity_context_units": f"""WITH {_BASE}, own AS (SELECT chunk_id, min(place) AS hit FROM src JOIN hits USING (vertex_id) GROUP BY 1), ar AS (SELECT h.place AS hit, s.chunk_id, count(*) AS shared FROM hits h JOIN inc i ON i.vertex_id = h.vertex_id JOIN inc j ON j.edge_id = i.edge_id JOIN src s ON s.vertex_id = j.vertex_id GROUP BY ALL) """ + _prefix(f"SELECT own.chunk_id, own.hit, coalesce(shared, 0) AS shared, {_TOK.format('content')} AS size FROM own LEFT JOIN ar ON ar.hit = own.hit AND ar.chunk_id = own.chunk_id JOIN ch ON ch.chunk_id = own.chunk_id", "hit, shared DESC, chunk_id", 1600, "place, chunk_id, hit, shared"),
    "relation_context_edges": f"WITH {_BASE} {_REL}",
    "relation_context_entities": f"WITH {_BASE}, rel AS ({_REL}) {_RELENT}",
    "relation_context_units": f"WITH {_BASE}, rel AS ({_REL}) " + _prefix(f"SELECT chunk_id, min(place) AS relation, any_value({_TOK.format('content')}) AS size FROM rel JOIN esrc USING (edge_id) JOIN ch USING (chunk_id) GROUP BY chunk_id", "relation, chunk_id", 1600, "place, chunk_id, relation"),
    "context_combine": f"WITH {_BASE}, rel AS ({_REL}), a AS ({_RELENT}), b AS ({_NODES}), u AS (SELECT 0 AS side, place, vertex_id || ',' || canonical_name AS payload FROM a UNION ALL SELECT 1, place, vertex_id || ',' || canonical_name FROM b), f AS (SELECT payload, min((side, place)) AS at_ FROM u GROUP BY 1) SELECT (row_number() OVER (ORDER BY at_))::INT AS id, payload FROM f",
    "json_dedupe": f"WITH {HYPEREDGES}, r AS (SELECT ord, relation_type, row_number() OVER (PARTITION BY list_sort(raw_vertices) ORDER BY ord) AS r FROM hyperedges WHERE raw_vertices IS NOT NULL) SELECT ord, relation_type FROM r WHERE r = 1",
    "graph_mode": f"WITH {_BASE} " + _REL.replace("WHERE edge_id IN (SELECT edge_id FROM eh)", "WHERE len(vertices) = 2 AND edge_id IN (SELECT edge_id FROM eh)"),
    "naive_mode": f"WITH {_BASE}, nh AS (SELECT chunk_id, content, row_number() OVER (ORDER BY md5(chunk_id)) AS hit FROM ch QUALIFY hit <= 60), p AS (" + _prefix(f"SELECT chunk_id, content, hit, {_TOK.format('content')} AS size FROM nh", "hit", 1600, "place, content") + ") SELECT md5(string_agg(content, '--New Chunk--' || chr(10) ORDER BY place)) AS context_md5, count(*) AS chunks FROM p",
    "context_sections": f"WITH {_BASE}, n AS ({_NODES}) SELECT 'vertex_id,entity_type,degree' || chr(10) || string_agg(vertex_id || ',' || entity_type || ',' || degree, chr(10) ORDER BY place) AS text FROM n",
    "echo_cleanup": "SELECT answer_id, regexp_replace(replace(replace(replace(replace('system text user' || question || 'model' || answer, 'system text ', ''), 'user', ''), 'model', ''), question, ''), '^\\s+|\\s+$', '', 'g') AS answer FROM (SELECT DISTINCT answer_id, question, answer FROM evaluate_qa_answers WHERE question IS NOT NULL AND question <> '')",
}
