"""Relations resolved against known entities, repaired and validated."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from knotwork.functions.sizes import small_side
from knotwork.functions.text import bare_reference, edge_reference


def lookup(entities: DataFrame, target: str, names: str, numeric: str | None = None) -> DataFrame:
    """key, target: reference keys that lead to one entity only; a key of two entities is dropped.

    entities: one row an entity with an array of names; rows whose `numeric` flag holds also give keys without numbers.
    """
    each = entities.select(target, F.col(numeric).alias("flag") if numeric else F.lit(False).alias("flag"), F.explode(names).alias("name"))
    keys = each.select(target, F.explode(F.array_compact(F.array(edge_reference(F.col("name")), F.when(F.col("flag"), bare_reference(F.col("name")))))).alias("key")).where("key <> ''")
    return keys.groupBy("key").agg(F.min(target).alias(target), F.max(target).alias("other")).where(F.col(target) == F.col("other")).drop("other")


def resolve_members(relations: DataFrame, keys: DataFrame, target: str) -> DataFrame:
    """edge_id, pos, name, target (null if no key leads anywhere): the whole name's key first, then the key without numbers."""
    named = relations.select("edge_id", F.posexplode("vertices").alias("pos", "name")).withColumns({"key": edge_reference(F.col("name")), "bare": bare_reference(F.col("name"))})
    first = small_side(keys.select("key", F.col(target).alias("whole")))
    second = small_side(keys.select(F.col("key").alias("bare"), F.col(target).alias("part")))
    return named.join(first, "key", "left").join(second, "bare", "left").select("edge_id", "pos", "name", F.coalesce("whole", "part").alias(target))


def known_relations(relations: DataFrame, keys: DataFrame, target: str, least: int) -> DataFrame:
    """edge_id, vertices (distinct, order kept), accepted: relations all of whose members resolve, to `least` different entities or more."""
    members = resolve_members(relations, keys, target)
    rows = members.groupBy("edge_id").agg(F.array_sort(F.collect_list(F.struct("pos", target))).alias("m"), F.count_if(F.col(target).isNull()).alias("open"))
    out = rows.select("edge_id", F.array_distinct(F.array_compact(F.col(f"m.{target}"))).alias("vertices"), "open")
    return out.select("edge_id", "vertices", ((F.col("open") == 0) & (F.size("vertices") >= least)).alias("accepted"))


def repair_edges(edges: DataFrame, kinds: DataFrame, chunk: str, wanted: list[str]) -> DataFrame:
    """edge_id, vertices, rules: to an edge of three vertices or more without a vertex of a wanted type, the only vertex of that type in its chunk is added.

    kinds: vertex_id, entity_type. Of each chunk and type only the least and the largest vertex are kept, so the
    aggregate is one row however many mentions a chunk holds.
    """
    members = edges.select("edge_id", chunk, F.explode("vertices").alias("vertex_id")).join(kinds, "vertex_id").where(F.col("entity_type").isin(wanted))
    single = members.groupBy(chunk, "entity_type").agg(F.min("vertex_id").alias("one"), F.max("vertex_id").alias("last")).where(F.col("one") == F.col("last"))
    per_chunk = single.groupBy(chunk).pivot("entity_type", wanted).agg(F.first("one"))
    has = members.groupBy("edge_id").agg(F.collect_set("entity_type").alias("has"))
    rows = edges.where(F.size("vertices") >= 3).join(has, "edge_id", "left").join(per_chunk, chunk, "left")
    lacks = lambda t: ~F.coalesce(F.array_contains("has", t), F.lit(False)) & F.col(t).isNotNull()
    added = F.array_compact(F.array(*[F.when(lacks(t), F.col(t)) for t in wanted]))
    rules = F.array_compact(F.array(*[F.when(lacks(t), F.lit(f"add_{t.lower()}")) for t in wanted]))
    return rows.select("edge_id", F.array_union("vertices", added).alias("vertices"), rules.alias("rules"))


def unknown_summary(edges: DataFrame, vertices: DataFrame, relation: str) -> DataFrame:
    """relation type, members, unknown, rate in percent: how many members no stored vertex has."""
    rows = edges.select(relation, F.explode("vertices").alias("vertex_id")).join(vertices.select("vertex_id", F.lit(1).alias("hit")), "vertex_id", "left")
    return rows.groupBy(relation).agg(F.count("*").alias("members"), F.count_if(F.col("hit").isNull()).alias("unknown")).withColumn("rate", F.round(100 * F.col("unknown") / F.col("members"), 2))


def top_unknown(edges: DataFrame, vertices: DataFrame, k: int = 20) -> DataFrame:
    rows = edges.select(F.explode("vertices").alias("vertex_id")).join(vertices.select("vertex_id"), "vertex_id", "left_anti")
    return rows.groupBy("vertex_id").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "vertex_id").limit(k)


def errors(*checks: tuple[Column, str]) -> Column:
    """The messages of the checks that hold, in order."""
    return F.array_compact(F.array(*[F.when(test, F.lit(message)) for test, message in checks]))


def entity_errors(types: list[str]) -> Column:
    """Errors of an entity row: name, type, value and range."""
    ranged = F.col("min_value").isNotNull() & F.col("max_value").isNotNull()
    return errors(
        (F.coalesce(F.trim("raw"), F.lit("")) == "", "name is required"),
        (F.col("quantity_type").isNull(), "type is required"),
        (F.col("quantity_type").isNotNull() & ~F.col("quantity_type").isin(types), "type is not allowed"),
        (F.col("value").isNotNull() & ranged, "value and range exclude each other"),
        (ranged & (F.col("min_value") > F.col("max_value")), "range is reversed"),
        (F.col("value").isNotNull() & F.col("unit").isNull() & (F.coalesce("quantity_type", F.lit("")) != "pH"), "unit is required with a value"),
    )


def relation_errors() -> Column:
    """Errors of a hyperedge row: members, strength, span, level."""
    return errors(
        (F.coalesce(F.size("vertices"), F.lit(0)) < 2, "at least two vertices"),
        (F.col("strength").isNotNull() & ~F.col("strength").between(0, 10), "strength is not between 0 and 10"),
        (F.length("evidence_span") > 500, "evidence span is longer than 500"),
        (F.col("relation_type").isNull(), "relation type is required"),
        (F.col("level_hg").isNotNull() & ~F.col("level_hg").isin("Low-order", "High-order"), "level is not allowed"),
    )
