"""Hypergraph operators over three frames: vertices (vertex_id, ...), edges (edge_id, vertices array, ...), incidence (edge_id, vertex_id).

An edge's identity is its set of vertices: sorted, without repetitions. Every operator is a plan of joins on
vertex_id or edge_id, so a hub vertex is left to the adaptive skew handling; nothing is gathered per vertex unless the
result is such an array.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from knotwork.functions.sizes import small_side

SEPARATOR = "\u0001"


def edge_key(vertices: Column) -> Column:
    """Canonical form of a vertex list: nulls out, sorted, distinct."""
    return F.array_sort(F.array_distinct(F.array_compact(vertices)))


def edge_id(vertices: Column) -> Column:
    """Identity of a canonical vertex list."""
    return F.md5(F.array_join(vertices, SEPARATOR))


def encode_edges(mentions: DataFrame, column: str = "vertices") -> DataFrame:
    """Adds edge_id and arity and canonicalises the vertices; mentions without vertices are left out."""
    out = mentions.withColumn(column, edge_key(F.col(column))).where(F.size(column) > 0)
    return out.withColumns({"edge_id": edge_id(F.col(column)), "arity": F.size(column)})


def incidence(edges: DataFrame) -> DataFrame:
    return edges.select("edge_id", F.explode("vertices").alias("vertex_id"))


def known_edges(edges: DataFrame, vertices: DataFrame) -> DataFrame:
    """edge_id, complete: whether every member is a stored vertex."""
    members = incidence(edges).join(vertices.select("vertex_id", F.lit(True).alias("stored")), "vertex_id", "left")
    return members.groupBy("edge_id").agg(F.every(F.coalesce("stored", F.lit(False))).alias("complete"))


def vertex_degree(vertices: DataFrame, edges: DataFrame) -> DataFrame:
    """vertex_id, degree; isolated vertices have 0."""
    counts = incidence(edges).groupBy("vertex_id").agg(F.count("*").alias("degree"))
    return vertices.select("vertex_id").join(counts, "vertex_id", "left").select("vertex_id", F.coalesce("degree", F.lit(0)).cast("bigint").alias("degree"))


def incident_edges(edges: DataFrame, of: DataFrame) -> DataFrame:
    """vertex_id, edge_id: the edges of the given vertices."""
    return incidence(edges).join(small_side(of.select("vertex_id").distinct()), "vertex_id")


def neighbours(edges: DataFrame, of: DataFrame) -> DataFrame:
    """vertex_id, neighbour: vertices that share an edge with the given ones, without themselves; none for an isolated vertex."""
    mine = incident_edges(edges, of)
    others = incidence(edges).select("edge_id", F.col("vertex_id").alias("neighbour"))
    return mine.join(others, "edge_id").where(F.col("neighbour") != F.col("vertex_id")).select("vertex_id", "neighbour").distinct()


def reach(edges: DataFrame, seeds: DataFrame, hops: int) -> DataFrame:
    """vertex_id, hop: vertices within so many hops of the seeds, by the least hop."""
    found = seeds.select("vertex_id", F.lit(0).alias("hop")).distinct()
    edge_of = incidence(edges)
    for hop in range(1, hops + 1):
        touched = edge_of.join(found.where(F.col("hop") == hop - 1).select("vertex_id"), "vertex_id", "left_semi").select("edge_id").distinct()
        step = edge_of.join(touched, "edge_id", "left_semi").select("vertex_id", F.lit(hop).alias("hop")).distinct()
        found = found.unionByName(step).groupBy("vertex_id").agg(F.min("hop").alias("hop"))
    return found


def edge_neighbourhood(edges: DataFrame, of: DataFrame) -> DataFrame:
    """edge_id, kind (vertex, edge), id: members with their neighbours, and all edges incident to a member."""
    members = edges.join(of.select("edge_id").distinct(), "edge_id", "left_semi").select("edge_id", F.explode("vertices").alias("vertex_id"))
    touching = members.join(incidence(edges).withColumnRenamed("edge_id", "other"), "vertex_id").select("edge_id", "other").distinct()
    around = touching.join(edges.select(F.col("edge_id").alias("other"), F.explode("vertices").alias("id")), "other")
    return around.select("edge_id", F.lit("vertex").alias("kind"), "id").distinct().unionByName(touching.select("edge_id", F.lit("edge").alias("kind"), F.col("other").alias("id")))


def induced(edges: DataFrame, keep: DataFrame) -> DataFrame:
    """Edges all of whose vertices are kept."""
    members = incidence(edges)
    outside = members.join(keep.select("vertex_id"), "vertex_id", "left_anti").select("edge_id").distinct()
    return edges.join(outside, "edge_id", "left_anti")


def remove_vertices(edges: DataFrame, gone: DataFrame) -> DataFrame:
    """edge_id, vertices after removal: edges shrink, fall away below two vertices, and of edges that become equal the one with the least old id stays."""
    members = edges.select(F.col("edge_id").alias("old_id"), F.explode("vertices").alias("vertex_id")).join(small_side(gone.select("vertex_id").distinct()), "vertex_id", "left_anti")
    left = members.groupBy("old_id").agg(F.array_sort(F.collect_set("vertex_id")).alias("vertices")).where(F.size("vertices") >= 2)
    return left.withColumn("edge_id", edge_id(F.col("vertices"))).groupBy("edge_id").agg(F.min("old_id").alias("old_id"), F.first("vertices").alias("vertices"))


def remove_edges(edges: DataFrame, gone: DataFrame) -> DataFrame:
    return edges.join(gone.select("edge_id"), "edge_id", "left_anti")


def upsert(stored: DataFrame, new: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """Shallow merge by key: a new row's columns replace the stored ones, nulls included; other rows stay."""
    s = stored.select(key, *columns)
    n = new.select(key, *[F.col(c).alias(f"new_{c}") for c in columns], F.lit(True).alias("is_new"))
    return s.join(n, key, "full_outer").select(key, *[F.when(F.col("is_new"), F.col(f"new_{c}")).otherwise(F.col(c)).alias(c) for c in columns])


def update_given(stored: DataFrame, new: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """Update in place of existing keys, where falsy new values (null, empty, zero) leave the stored ones."""
    kinds = dict(new.dtypes)
    blank = lambda c: F.col(c) == (F.lit("") if kinds[c] == "string" else F.lit(0))
    given = [F.when(F.col(c).isNull() | blank(c), None).otherwise(F.col(c)).alias(f"new_{c}") for c in columns]
    return stored.select(key, *columns).join(new.select(key, *given), key, "left").select(key, *[F.coalesce(f"new_{c}", c).alias(c) for c in columns])


def frequent_vertices(edges: DataFrame, least: int = 2) -> DataFrame:
    return incidence(edges).groupBy("vertex_id").agg(F.count("*").alias("degree")).where(F.col("degree") >= least)


def page(frame: DataFrame, key: str, number: int, size: int) -> DataFrame:
    """One page in key order with the total and the number of pages. Only the rows up to the page's end are sorted out of each partition."""
    total = frame.count()
    top = frame.orderBy(key).limit(number * size).withColumn("position", F.row_number().over(Window.orderBy(key)))
    return top.where(F.col("position") > (number - 1) * size).withColumns({"total": F.lit(total).cast("bigint"), "pages": F.lit(-(-total // size)).cast("bigint")}).drop("position")


def clique_pairs(edges: DataFrame) -> DataFrame:
    """edge_id, left, right: the vertex pairs of each edge, first position before second, made inside the edge's row."""
    pairs = F.flatten(F.transform("vertices", lambda v, i: F.transform(F.slice("vertices", i + 2, F.size("vertices")), lambda w: F.struct(v.alias("left"), w.alias("right")))))
    return edges.select("edge_id", F.explode(pairs).alias("p")).select("edge_id", "p.left", "p.right")


def pairwise(edges: DataFrame) -> DataFrame:
    return edges.where(F.size("vertices") == 2)


def signature_dedupe(edges: DataFrame) -> DataFrame:
    """signature, vertices, relation_type, sources (sorted): edges equal in relation type and vertices merge their sources."""
    signed = edges.withColumn("signature", F.sha1(F.concat_ws("|", F.coalesce("relation_type", F.lit("")), F.array_join("vertices", ","))))
    return signed.groupBy("signature", "vertices", "relation_type").agg(F.array_sort(F.collect_set("source_id")).alias("sources"))


def rewrite_edges(edges: DataFrame, mapping: DataFrame) -> DataFrame:
    """edge_id, canonical_vertices (order kept, first occurrence), unresolved (in order), status; mapping: mention, canonical_id."""
    named = edges.select("edge_id", F.posexplode("vertices").alias("pos", "mention"))
    mapped = named.join(mapping.select("mention", "canonical_id"), "mention", "left")
    rows = mapped.groupBy("edge_id").agg(F.array_sort(F.collect_list(F.struct("pos", F.coalesce("canonical_id", "mention").alias("to"), F.when(F.col("canonical_id").isNull(), F.col("mention")).alias("open")))).alias("m"))
    out = rows.select("edge_id", F.array_distinct(F.col("m.to")).alias("canonical_vertices"), F.array_compact(F.col("m.open")).alias("unresolved"))
    return out.withColumn("status", F.when(F.size("unresolved") > 0, "unresolved").otherwise("resolved"))


def implicit_vertices(edges: DataFrame, vertices: DataFrame) -> DataFrame:
    """Vertices that only edges mention, as rows of type UNKNOWN."""
    return incidence(edges).select("vertex_id").distinct().join(vertices.select("vertex_id"), "vertex_id", "left_anti").withColumn("entity_type", F.lit("UNKNOWN"))


def graph_stats(vertices: DataFrame, edges: DataFrame) -> DataFrame:
    """One row: vertices, edges, incidences, largest and mean arity, pairwise edges."""
    v = vertices.agg(F.count("*").alias("n_vertices"))
    e = edges.agg(F.count("*").alias("n_edges"), F.sum(F.size("vertices")).alias("n_incidences"), F.max(F.size("vertices")).alias("max_arity"), F.round(F.avg(F.size("vertices")), 6).alias("mean_arity"), F.count_if(F.size("vertices") == 2).alias("n_pairwise"))
    return e.withColumn("one", F.lit(1)).join(F.broadcast(v.withColumn("one", F.lit(1))), "one").drop("one")
