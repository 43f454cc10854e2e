"""Context for a question: vector hits expanded over the hypergraph, ranked, cut to token budgets and combined.

Hits are at most top_k rows, so the joins broadcast them; the graph's frames are only filtered and joined.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from knotwork.functions.sizes import small_side
from knotwork.operators.chunking import tokens
from knotwork.operators.graph import incidence, vertex_degree
from knotwork.operators.prefix import running_totals
from knotwork.session import durable

MODES = ("hyper", "hyper-lite", "graph", "naive")


@dataclass(frozen=True)
class Budget:
    """Rows of a vector search and tokens of each section."""

    top_k: int = 60
    units: int = 1600
    entities: int = 300
    relations: int = 1600


def count_tokens(column: str) -> F.Column:
    return F.size(tokens(F.coalesce(F.col(column), F.lit(""))))


def prefix(df: DataFrame, order: list[str], size: str, budget: int) -> DataFrame:
    """The longest prefix of the ranked frame whose sizes sum to the budget at most, with `place` from 0.

    Order columns go up, those written with a minus before them (numbers) down. The sums run over range partitions, so
    a hub's many rows are ranked in many tasks.
    """
    keys = {f"kw_o{i}": -F.col(c[1:]) if c.startswith("-") else F.col(c) for i, c in enumerate(order)}
    rows = df.withColumns(keys | {"kw_all": F.lit(0), "kw_one": F.lit(1)})
    rows = durable(rows)  # the range partitioning reads its input twice, once for the bounds
    placed = running_totals(rows, "kw_all", list(keys), {size: "kw_before", "kw_one": "place"})
    return placed.where(F.col("kw_before") + F.col(size) <= budget).drop(*keys, "kw_all", "kw_one", "kw_before").withColumn("place", F.col("place").cast("int"))


def entity_rows(hits: DataFrame, vertices: DataFrame, edges: DataFrame) -> DataFrame:
    """place, vertex_id, canonical_name, entity_type, degree of the hits that are stored, in hit order. hits: vertex_id, place."""
    near = small_side(hits)
    mine = vertices.join(near, "vertex_id")
    touched = incidence(edges).join(small_side(mine.select("vertex_id")), "vertex_id", "left_semi")
    degree = touched.groupBy("vertex_id").agg(F.count("*").alias("degree"))
    return mine.join(degree, "vertex_id", "left").select("place", "vertex_id", "canonical_name", "entity_type", F.coalesce("degree", F.lit(0)).alias("degree"))


def edges_of_entities(hits: DataFrame, edges: DataFrame, budget: int) -> DataFrame:
    """place, edge_id, arity, strength: edges of the hits, larger first, then stronger, cut on their descriptions' tokens."""
    ids = incidence(edges).join(small_side(hits.select("vertex_id")), "vertex_id", "left_semi").select("edge_id").distinct()
    rows = edges.join(ids, "edge_id", "left_semi").select("edge_id", F.size("vertices").alias("arity"), "strength", count_tokens("description").alias("size"))
    return prefix(rows, ["-arity", "-strength", "edge_id"], "size", budget).drop("size")


def units_of_entities(hits: DataFrame, edges: DataFrame, sources: DataFrame, chunks: DataFrame, budget: int) -> DataFrame:
    """place, chunk_id: chunks of the hits by hit order, then by how many members of the hit's edges share the chunk, cut on tokens.

    sources: vertex_id, chunk_id; chunks: chunk_id, content. A chunk belongs to the first hit that mentions it; members
    count once for each edge they share with the hit, the hit itself among them.
    """
    near = small_side(hits.select("vertex_id", F.col("place").alias("hit")))
    own = sources.join(near, "vertex_id").select("vertex_id", "hit", "chunk_id")
    owner = own.groupBy("chunk_id").agg(F.min("hit").alias("hit"))
    # How many edges a hit shares with each vertex comes first; a chunk then needs only its own hit's counts.
    asked = incidence(edges).join(near, "vertex_id").select("hit", "edge_id")
    together = incidence(edges).join(asked, "edge_id").groupBy("hit", "vertex_id").agg(F.count("*").alias("n"))
    around = sources.join(owner, "chunk_id").join(together, ["hit", "vertex_id"]).groupBy("hit", "chunk_id").agg(F.sum("n").alias("shared"))
    rows = owner.join(around, ["hit", "chunk_id"], "left").join(chunks, "chunk_id").select("chunk_id", "hit", F.coalesce("shared", F.lit(0)).alias("shared"), count_tokens("content").alias("size"))
    return prefix(rows, ["hit", "-shared", "chunk_id"], "size", budget).select("place", "chunk_id", "hit", "shared")


def relation_rows(hits: DataFrame, edges: DataFrame, budget: int) -> DataFrame:
    """place, edge_id, vertices, arity, strength of the hit edges, larger first, then stronger, cut on tokens. hits: edge_id."""
    rows = edges.join(small_side(hits.select("edge_id").distinct()), "edge_id").select("edge_id", "vertices", F.size("vertices").alias("arity"), "strength", count_tokens("description").alias("size"))
    return prefix(rows, ["-arity", "-strength", "edge_id"], "size", budget).drop("size")


def entities_of_relations(relations: DataFrame, vertices: DataFrame, budget: int) -> DataFrame:
    """place, vertex_id, canonical_name: stored members of the relations by first relation and position, cut on their names' tokens."""
    members = relations.select("place", F.posexplode("vertices").alias("pos", "vertex_id"))
    first = members.groupBy("vertex_id").agg(F.min(F.struct("place", "pos")).alias("at"))
    rows = first.join(vertices, "vertex_id").select("vertex_id", "canonical_name", "at", count_tokens("canonical_name").alias("size"))
    return prefix(rows, ["at"], "size", budget).select("place", "vertex_id", "canonical_name")


def units_of_relations(relations: DataFrame, edge_sources: DataFrame, chunks: DataFrame, budget: int) -> DataFrame:
    """place, chunk_id: chunks of the relations by first relation, cut on tokens. edge_sources: edge_id, chunk_id."""
    first = edge_sources.join(small_side(relations.select("edge_id", "place")), "edge_id").groupBy("chunk_id").agg(F.min("place").alias("relation"))
    rows = first.join(chunks, "chunk_id").select("chunk_id", "relation", count_tokens("content").alias("size"))
    return prefix(rows, ["relation", "chunk_id"], "size", budget).select("place", "chunk_id", "relation")


def combine(*sides: DataFrame) -> DataFrame:
    """id, payload: rows of the sides in order, a repeated payload only once, numbered from 1. Each side: place, payload."""
    rows = None
    for i, side in enumerate(sides):
        part = side.select(F.lit(i).alias("side"), "place", "payload")
        rows = part if rows is None else rows.unionByName(part)
    first = rows.groupBy("payload").agg(F.min(F.struct("side", "place")).alias("at"))
    return first.select(F.row_number().over(Window.orderBy("at")).alias("id"), "payload")


def dedupe_by_key(rows: DataFrame, key: str, order: str) -> DataFrame:
    """The first row of each key; list keys are compared as sorted lists, rows with a null key are dropped."""
    same = F.array_sort(key) if dict(rows.dtypes)[key].startswith("array") else F.col(key)
    kept = rows.where(F.col(key).isNotNull()).withColumn("same", same)
    return kept.groupBy("same").agg(F.min_by(F.struct(*rows.columns), order).alias("r")).select("r.*")


def section(rows: DataFrame, order: str, columns: list[str]) -> DataFrame:
    """One row, `text`: the rows as lines of comma-separated values in order, under a header."""
    line = F.to_csv(F.struct(*columns))
    body = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(order, line.alias("line")))), lambda x: x["line"]), "\n")
    return rows.agg(F.concat_ws("\n", F.lit(",".join(columns)), body).alias("text"))


class Engine:
    """Retrieval over one hypergraph's frames; the answer itself is left to a model provider.

    vertices: vertex_id, canonical_name, entity_type; edges: edge_id, vertices, strength, description; sources:
    vertex_id, chunk_id; edge_sources: edge_id, chunk_id; chunks: chunk_id, content.
    """

    def __init__(self, vertices: DataFrame, edges: DataFrame, sources: DataFrame, edge_sources: DataFrame, chunks: DataFrame, budget: Budget = Budget()):
        self.vertices, self.edges, self.sources, self.edge_sources, self.chunks, self.budget = vertices, edges, sources, edge_sources, chunks, budget

    def context(self, mode: str, entity_hits: DataFrame | None = None, edge_hits: DataFrame | None = None, chunk_hits: DataFrame | None = None) -> dict[str, DataFrame]:
        """Sections of a mode's context. A side without hits is empty; an unknown mode is refused."""
        if mode not in MODES:
            raise ValueError(f"unknown mode {mode!r}; one of {MODES}")
        b, out = self.budget, {}
        if mode == "naive":
            rows = self.chunks.join(small_side(chunk_hits), "chunk_id").select("place", "chunk_id", "content", count_tokens("content").alias("size"))
            return {"units": prefix(rows.withColumnRenamed("place", "hit"), ["hit"], "size", b.units).select("place", "chunk_id", "content")}
        if mode in ("hyper", "hyper-lite") and entity_hits is not None:
            out["entities"] = entity_rows(entity_hits, self.vertices, self.edges)
            out["entity_edges"] = edges_of_entities(entity_hits, self.edges, b.relations)
            out["entity_units"] = units_of_entities(entity_hits, self.edges, self.sources, self.chunks, b.units)
        if mode in ("hyper", "graph") and edge_hits is not None:
            edges = self.edges.where(F.size("vertices") == 2) if mode == "graph" else self.edges
            out["relations"] = relation_rows(edge_hits, edges, b.relations)
            out["relation_entities"] = entities_of_relations(out["relations"], self.vertices, b.entities)
            out["relation_units"] = units_of_relations(out["relations"], self.edge_sources, self.chunks, b.units)
        return out


__all__ = ["Budget", "Engine", "MODES", "combine", "count_tokens", "dedupe_by_key", "edges_of_entities", "entities_of_relations", "entity_rows", "prefix", "relation_rows", "section", "units_of_entities", "units_of_relations", "vertex_degree"]
