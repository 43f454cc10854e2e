"""Queries of the graph operators over the stored hyperedges, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from knotwork.operators import graph as g
from knotwork.plans import bindings as b
from knotwork.plans.bindings import EDGES, HYPEREDGES, VERTICES
from knotwork.session import durable, table

FEW = "SELECT vertex_id FROM incidence GROUP BY vertex_id ORDER BY count(*) DESC, vertex_id LIMIT 5"


def _hubs(edges: DataFrame) -> DataFrame:
    """The five vertices of most edges: a top-k report that seeds the traversals."""
    return g.incidence(edges).groupBy("vertex_id").count().orderBy(F.desc("count"), "vertex_id").limit(5).select("vertex_id")


def vertex_degree(spark: SparkSession, d: str) -> DataFrame:
    return g.vertex_degree(b.vertices(spark, d), b.edges(spark, d))


def edge_encode(spark: SparkSession, d: str) -> DataFrame:
    edges = b.edges(spark, d)
    return edges.join(g.known_edges(edges, b.vertices(spark, d)), "edge_id").select("edge_id", "vertices", F.size("vertices").alias("arity"), "mentions", "complete")


def edge_arity(spark: SparkSession, d: str) -> DataFrame:
    return b.edges(spark, d).groupBy(F.size("vertices").alias("arity")).agg(F.count("*").alias("edges"), F.sum("strength").alias("strength"))


def edge_exists(spark: SparkSession, d: str) -> DataFrame:
    """Which mentioned edges of the raw names also are edges of canonical ids."""
    raw = b.hyperedges(spark, d).select("ord", g.edge_key(F.col("raw_vertices")).alias("vertices")).where(F.size("vertices") > 0).withColumn("edge_id", g.edge_id(F.col("vertices")))
    return raw.join(b.edges(spark, d).select("edge_id", F.lit(True).alias("hit")), "edge_id", "left").select("ord", F.coalesce("hit", F.lit(False)).alias("present"))


def incident_edges(spark: SparkSession, d: str) -> DataFrame:
    edges = durable(b.edges(spark, d))
    return g.incident_edges(edges, _hubs(edges))


def neighbors(spark: SparkSession, d: str) -> DataFrame:
    edges = durable(b.edges(spark, d))
    return g.neighbours(edges, _hubs(edges))


def hop1_subgraph(spark: SparkSession, d: str) -> DataFrame:
    edges = durable(b.edges(spark, d))
    seeds = b.vertices(spark, d).where("entity_type = 'SYSTEM'").select("vertex_id")
    return g.reach(edges, seeds, 1)


def hop2_subgraph(spark: SparkSession, d: str) -> DataFrame:
    """Two hops over edges of two vertices, as the SQL has it; hop2_subgraph_all takes all edges."""
    edges = durable(b.edges(spark, d))
    return g.reach(g.pairwise(edges), _hubs(edges), 2)


def hop2_subgraph_all(spark: SparkSession, d: str) -> DataFrame:
    edges = durable(b.edges(spark, d))
    return g.reach(edges, _hubs(edges), 2)


def edge_neighbourhood(spark: SparkSession, d: str) -> DataFrame:
    edges = durable(b.edges(spark, d))
    return g.edge_neighbourhood(edges, edges.where("mentions > 1").orderBy(F.desc("mentions"), "edge_id").limit(3))


def induced_subgraph(spark: SparkSession, d: str) -> DataFrame:
    return g.induced(b.edges(spark, d), b.vertices(spark, d).where("entity_type in ('MEMBRANE', 'SYSTEM', 'METRIC')")).select("edge_id", "vertices")


def remove_vertex(spark: SparkSession, d: str) -> DataFrame:
    edges = durable(b.edges(spark, d))
    return g.remove_vertices(edges, _hubs(edges))


def remove_edge(spark: SparkSession, d: str) -> DataFrame:
    edges = b.edges(spark, d)
    return g.remove_edges(edges, edges.where("mentions > 1")).select("edge_id", "mentions")


def update_vertex(spark: SparkSession, d: str) -> DataFrame:
    stored = b.vertices(spark, d)
    new = stored.where("entity_type = 'METRIC'").select("vertex_id", F.upper("canonical_name").alias("canonical_name"), F.lit("").alias("semantic_group"))
    return g.update_given(stored, new, "vertex_id", ["canonical_name", "semantic_group"])


def upsert_vertex(spark: SparkSession, d: str) -> DataFrame:
    edges, stored = b.edges(spark, d), b.vertices(spark, d)
    new = g.implicit_vertices(edges, stored).select("vertex_id", F.lit(None).cast("string").alias("canonical_name"), "entity_type").unionByName(stored.where("entity_type = 'SYSTEM'").select("vertex_id", F.lit(None).cast("string").alias("canonical_name"), "entity_type"))
    return g.upsert(stored, new, "vertex_id", ["canonical_name", "entity_type"])


def frequent_vertices(spark: SparkSession, d: str) -> DataFrame:
    return g.frequent_vertices(b.edges(spark, d))


def edge_page(spark: SparkSession, d: str) -> DataFrame:
    return g.page(b.edges(spark, d).select("edge_id", "mentions"), "edge_id", 3, 20)


def clique_expand(spark: SparkSession, d: str) -> DataFrame:
    return g.clique_pairs(b.edges(spark, d))


def pairwise_edges(spark: SparkSession, d: str) -> DataFrame:
    return g.pairwise(b.edges(spark, d)).select("edge_id", "vertices", "strength")


def edge_signature_dedupe(spark: SparkSession, d: str) -> DataFrame:
    return g.signature_dedupe(b.hyperedges(spark, d))


def rewrite_edges(spark: SparkSession, d: str) -> DataFrame:
    """Raw names to canonical ids by the names and aliases, in lower case."""
    entity = table(spark, d, "canonical_entity").select("canonical_id", F.explode(F.array_union(F.array("canonical_name"), "aliases")).alias("mention"))
    mapping = entity.groupBy("mention").agg(F.min("canonical_id").alias("canonical_id"))
    named = b.hyperedges(spark, d).where(F.size("raw_vertices") > 0).select(F.col("ord").alias("edge_id"), F.array_compact("raw_vertices").alias("vertices"))
    return g.rewrite_edges(named, mapping)


def implicit_vertices(spark: SparkSession, d: str) -> DataFrame:
    return g.implicit_vertices(b.edges(spark, d), b.vertices(spark, d))


def graph_stats(spark: SparkSession, d: str) -> DataFrame:
    return g.graph_stats(b.vertices(spark, d), b.edges(spark, d))


def whole_graph_detail(spark: SparkSession, d: str) -> DataFrame:
    """Every edge mention with its keywords as a comma list."""
    return b.hyperedges(spark, d).select("ord", "edge_id", F.replace(F.col("keywords"), F.lit("<SEP>"), F.lit(",")).alias("keywords"), "description")


def vertex_edges_by_type(spark: SparkSession, d: str) -> DataFrame:
    """Stored vertices joined to their edges: degree and strength by type (vertices of no edge count too)."""
    inc = g.incidence(b.edges(spark, d)).join(b.edges(spark, d).select("edge_id", "strength"), "edge_id")
    return b.vertices(spark, d).join(inc, "vertex_id", "left").groupBy("entity_type").agg(F.count_distinct("vertex_id").alias("vertices"), F.count("edge_id").alias("incidences"), F.coalesce(F.sum("strength"), F.lit(0)).alias("strength"))


QUERIES = {f.__name__: f for f in (vertex_degree, edge_encode, edge_arity, edge_exists, incident_edges, neighbors, hop1_subgraph, hop2_subgraph, hop2_subgraph_all, edge_neighbourhood, induced_subgraph, remove_vertex, remove_edge, update_vertex, upsert_vertex, frequent_vertices, edge_page, clique_expand, pairwise_edges, edge_signature_dedupe, rewrite_edges, implicit_vertices, graph_stats, whole_graph_detail, vertex_edges_by_type)}

ORACLES = {
    "vertex_degree": f"WITH {EDGES}, {VERTICES} SELECT v.vertex_id, count(i.edge_id) AS degree FROM vertices v LEFT JOIN incidence i USING (vertex_id) GROUP BY v.vertex_id",
    "edge_encode": f"WITH {EDGES}, {VERTICES} SELECT e.edge_id, e.vertices, len(e.vertices)::INT AS arity, e.mentions, bool_and(v.vertex_id IS NOT NULL) AS complete FROM edges e JOIN incidence i USING (edge_id) LEFT JOIN vertices v USING (vertex_id) GROUP BY ALL",
    "edge_arity": f"WITH {EDGES} SELECT len(vertices)::INT AS arity, count(*) AS edges, sum(strength)::BIGINT AS strength FROM edges GROUP BY 1",
    "edge_exists": f"WITH {EDGES}, raw AS (SELECT ord, list_sort(list_distinct(list_filter(raw_vertices, lambda x: x IS NOT NULL))) AS v FROM hyperedges) SELECT ord, md5(array_to_string(v, chr(1))) IN (SELECT edge_id FROM edges) AS present FROM raw WHERE len(v) > 0",
    "incident_edges": f"WITH {EDGES} SELECT vertex_id, edge_id FROM incidence WHERE vertex_id IN ({FEW})",
    "neighbors": f"WITH {EDGES} SELECT DISTINCT a.vertex_id, b.vertex_id AS neighbour FROM incidence a JOIN incidence b USING (edge_id) WHERE a.vertex_id <> b.vertex_id AND a.vertex_id IN ({FEW})",
    "hop1_subgraph": f"""WITH {EDGES}, {VERTICES}, seed AS (SELECT vertex_id FROM vertices WHERE entity_type = 'SYSTEM'), one AS (SELECT b.vertex_id FROM incidence a JOIN seed USING (vertex_id) JOIN incidence b ON a.edge_id = b.edge_id)
        SELECT vertex_id, min(hop)::INT AS hop FROM (SELECT vertex_id, 0 AS hop FROM seed UNION ALL SELECT vertex_id, 1 FROM one) GROUP BY vertex_id""",
    "hop2_subgraph": f"""WITH {EDGES}, seed AS ({FEW}), p AS (SELECT edge_id, unnest(vertices) AS vertex_id FROM edges WHERE len(vertices) = 2),
        one AS (SELECT DISTINCT b.vertex_id FROM p a JOIN seed USING (vertex_id) JOIN p b ON a.edge_id = b.edge_id), two AS (SELECT DISTINCT b.vertex_id FROM p a JOIN one USING (vertex_id) JOIN p b ON a.edge_id = b.edge_id)
        SELECT vertex_id, min(hop)::INT AS hop FROM (SELECT vertex_id, 0 AS hop FROM seed UNION ALL SELECT vertex_id, 1 FROM one UNION ALL SELECT vertex_id, 2 FROM two) GROUP BY vertex_id""",
    "edge_neighbourhood": f"""WITH {EDGES}, of AS (SELECT edge_id FROM edges WHERE mentions > 1 ORDER BY mentions DESC, edge_id LIMIT 3),
        t AS (SELECT DISTINCT a.edge_id, b.edge_id AS other FROM incidence a JOIN of USING (edge_id) JOIN incidence b ON a.vertex_id = b.vertex_id)
        SELECT DISTINCT t.edge_id, 'vertex' AS kind, i.vertex_id AS id FROM t JOIN incidence i ON i.edge_id = t.other UNION ALL SELECT edge_id, 'edge', other FROM t""",
    "induced_subgraph": f"WITH {EDGES}, {VERTICES} SELECT edge_id, vertices FROM edges WHERE edge_id NOT IN (SELECT edge_id FROM incidence WHERE vertex_id NOT IN (SELECT vertex_id FROM vertices WHERE entity_type IN ('MEMBRANE', 'SYSTEM', 'METRIC')))",
    "remove_vertex": f"""WITH {EDGES}, gone AS ({FEW}), l AS (SELECT edge_id AS old_id, list_sort(list(vertex_id)) AS vertices FROM incidence WHERE vertex_id NOT IN (SELECT vertex_id FROM gone) GROUP BY edge_id)
        SELECT md5(array_to_string(vertices, chr(1))) AS edge_id, min(old_id) AS old_id, any_value(vertices) AS vertices FROM l WHERE len(vertices) >= 2 GROUP BY 1""",
    "remove_edge": f"WITH {EDGES} SELECT edge_id, mentions FROM edges WHERE mentions <= 1",
    "update_vertex": f"WITH {VERTICES} SELECT vertex_id, CASE WHEN entity_type = 'METRIC' THEN upper(canonical_name) ELSE canonical_name END AS canonical_name, semantic_group FROM vertices",
    "upsert_vertex": f"WITH {EDGES}, {VERTICES} SELECT vertex_id, CASE WHEN entity_type <> 'SYSTEM' THEN canonical_name END AS canonical_name, entity_type FROM vertices UNION ALL SELECT DISTINCT vertex_id, NULL, 'UNKNOWN' FROM incidence WHERE vertex_id NOT IN (SELECT vertex_id FROM vertices)",
    "frequent_vertices": f"WITH {EDGES} SELECT vertex_id, count(*) AS degree FROM incidence GROUP BY vertex_id HAVING count(*) >= 2",
    "edge_page": f"WITH {EDGES} SELECT edge_id, mentions, (SELECT count(*) FROM edges) AS total, ((SELECT count(*) FROM edges) + 19) // 20 AS pages FROM edges ORDER BY edge_id LIMIT 20 OFFSET 40",
    "clique_expand": f"WITH {EDGES}, p AS (SELECT edge_id, unnest(vertices) AS v, generate_subscripts(vertices, 1) AS i FROM edges) SELECT a.edge_id, a.v AS left, b.v AS right FROM p a JOIN p b ON a.edge_id = b.edge_id AND a.i < b.i",
    "pairwise_edges": f"WITH {EDGES} SELECT edge_id, vertices, strength FROM edges WHERE len(vertices) = 2",
    "edge_signature_dedupe": f"WITH {HYPEREDGES} SELECT sha1(coalesce(relation_type, '') || '|' || array_to_string(vertices, ',')) AS signature, any_value(vertices) AS vertices, any_value(relation_type) AS relation_type, coalesce(list_sort(list(DISTINCT source_id) FILTER (source_id IS NOT NULL)), []) AS sources FROM hyperedges GROUP BY 1",
    "rewrite_edges": f"""WITH {HYPEREDGES}, names AS (SELECT canonical_id, unnest(list_concat([canonical_name], aliases)) AS mention FROM canonical_entity), m AS (SELECT mention, min(canonical_id) AS canonical_id FROM names GROUP BY mention),
        p AS (SELECT ord, unnest(list_filter(raw_vertices, lambda x: x IS NOT NULL)) AS mention, generate_subscripts(list_filter(raw_vertices, lambda x: x IS NOT NULL), 1) AS pos FROM hyperedges WHERE len(raw_vertices) > 0),
        j AS (SELECT ord, pos, mention, canonical_id, coalesce(canonical_id, mention) AS t FROM p LEFT JOIN m USING (mention)),
        f AS (SELECT ord, t, min(pos) AS pos FROM j GROUP BY ord, t), c AS (SELECT ord, list(t ORDER BY pos) AS canonical_vertices FROM f GROUP BY ord),
        u AS (SELECT ord, coalesce(list(mention ORDER BY pos) FILTER (canonical_id IS NULL), []) AS unresolved FROM j GROUP BY ord)
        SELECT ord AS edge_id, canonical_vertices, unresolved, CASE WHEN len(unresolved) > 0 THEN 'unresolved' ELSE 'resolved' END AS status FROM c JOIN u USING (ord)""",
    "implicit_vertices": f"WITH {EDGES}, {VERTICES} SELECT DISTINCT vertex_id, 'UNKNOWN' AS entity_type FROM incidence WHERE vertex_id NOT IN (SELECT vertex_id FROM vertices)",
    "graph_stats": f"WITH {EDGES}, {VERTICES} SELECT count(*) AS n_edges, sum(len(vertices))::BIGINT AS n_incidences, max(len(vertices))::INT AS max_arity, round(avg(len(vertices)), 6) AS mean_arity, count(*) FILTER (len(vertices) = 2) AS n_pairwise, (SELECT count(*) FROM vertices) AS n_vertices FROM edges",
    "whole_graph_detail": f"WITH {HYPEREDGES} SELECT ord, edge_id, replace(keywords, '<SEP>', ',') AS keywords, description FROM hyperedges",
    "vertex_edges_by_type": f"WITH {EDGES}, {VERTICES} SELECT entity_type, count(DISTINCT v.vertex_id) AS vertices, count(i.edge_id) AS incidences, coalesce(sum(e.strength), 0)::BIGINT AS strength FROM vertices v LEFT JOIN incidence i USING (vertex_id) LEFT JOIN edges e USING (edge_id) GROUP BY entity_type",
}
