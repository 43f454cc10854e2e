"""Merging repeated mentions into one record: votes, unions, ranges, sums and evidence, each a partial + final aggregation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from knotwork.operators.prefix import running_total

SEP = "<SEP>"


def majority(df: DataFrame, key: str, value: str, order: str) -> DataFrame:
    """key, value: the commonest value, of equally common ones the first seen. Null values do not vote."""
    counts = df.where(F.col(value).isNotNull()).groupBy(key, value).agg(F.count("*").alias("n"), F.min(order).alias("first"))
    return counts.groupBy(key).agg(F.max_by(value, F.struct("n", -F.col("first"))).alias(value))


def joined(value: str) -> Column:
    """Aggregate: sorted distinct values joined by the separator; null values are left out."""
    return F.array_join(F.array_sort(F.collect_set(value)), SEP)


def split_values(df: DataFrame, value: str) -> DataFrame:
    """One row for each part of a joined value, blanks around it trimmed and empty parts left out."""
    return df.withColumn(value, F.explode(F.split(F.col(value), SEP))).withColumn(value, F.trim(value)).where(F.col(value) != "")


def structured(df: DataFrame, key: str, categorical: list[str], numeric: str) -> DataFrame:
    """Categorical fields as sorted distinct lists; a number seen once stays a value, two or more become a range, equal ones a degenerate range."""
    sets = [F.array_sort(F.collect_set(c)).alias(c) for c in categorical]
    out = df.groupBy(key).agg(*sets, F.count(numeric).alias("seen"), F.min(numeric).alias("low"), F.max(numeric).alias("high"))
    many = F.col("seen") > 1
    return out.select(key, *categorical, F.when(~many, F.col("low")).alias(numeric), F.when(many, F.col("low")).alias(f"{numeric}_min"), F.when(many, F.col("high")).alias(f"{numeric}_max"))


def properties(fields: list[str]) -> Column:
    """field=value parts of the given columns, sorted, joined; null fields are left out."""
    parts = [F.when(F.col(f).isNotNull(), F.concat(F.lit(f"{f}="), F.col(f).cast("string"))) for f in fields]
    return F.array_join(F.array_sort(F.array_compact(F.array(*parts))), SEP)


def metadata(df: DataFrame, key: str, order: str, scalar: str, mention: str, flag: str, confidence: str) -> DataFrame:
    """Commonest scalar (first seen on ties), any flag, sorted distinct mentions, highest confidence."""
    rest = df.groupBy(key).agg(F.coalesce(F.bool_or(flag), F.lit(False)).alias(flag), F.array_sort(F.collect_set(mention)).alias("mentions"), F.max(confidence).alias(confidence))
    return rest.join(majority(df, key, scalar, order), key, "left")


def merge_edges(mentions: DataFrame) -> DataFrame:
    """edge_id, vertices, weight (sum, 6 digits), n, keywords, relation_types, sources: mentions merged by vertex set."""
    return mentions.groupBy("edge_id").agg(F.first("vertices").alias("vertices"), F.round(F.sum("weight"), 6).alias("weight"), F.count("*").alias("n"), joined("keywords").alias("keywords"), joined("relation_type").alias("relation_types"), joined("source_id").alias("sources"))


def longest(df: DataFrame, key: str, value: str) -> DataFrame:
    """The longest part of the values, of equally long ones the last in order."""
    return split_values(df, value).groupBy(key).agg(F.max_by(value, F.struct(F.length(value), F.col(value))).alias(value))


def evidence(df: DataFrame, key: str, same: list[str], order: str) -> DataFrame:
    """key and its evidence instances: of mentions equal in `same` the first, in order of appearance."""
    first = df.groupBy(key, *same).agg(F.min(order).alias(order))
    return first.groupBy(key).agg(F.array_sort(F.collect_list(F.struct(order, *same))).alias("evidence_instances"))


def incremental(stored: DataFrame, new: DataFrame, merge) -> DataFrame:
    """The merge of stored and new mentions: the state is mentions in order, so ingesting in parts equals ingesting at once."""
    return merge(stored.unionByName(new))


def index_rows(entities: DataFrame, name: str, description: str) -> DataFrame:
    """id, content: what a vector index embeds for each entity."""
    return entities.select(F.concat(F.lit("ent-"), F.md5(name)).alias("id"), F.concat(F.col(name), F.coalesce(description, F.lit(""))).alias("content"))


def edge_index_rows(edges: DataFrame) -> DataFrame:
    """id, content for each edge: keywords, members and description."""
    listed = F.array_join("vertices", ",")
    return edges.select(F.concat(F.lit("rel-"), F.md5(listed)).alias("id"), F.concat_ws(" ", "keywords", listed, "description").alias("content"))


def insert_only(stored: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """Rows of `new` whose key is not stored, each key once; stored rows are never overwritten."""
    return new.dropDuplicates([key]).join(stored.select(key), key, "left_anti")


def by_ids(store: DataFrame, ids: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """pos, key and the columns for a list of ids (pos, id): order and repetitions kept, null where nothing is stored."""
    return ids.join(store.select(F.col(key).alias("id"), *columns), "id", "left").select("pos", "id", *columns)


def summarise(text: Column, limit: int) -> Column:
    """Text within `limit` blank-separated tokens as it is, longer text cut to its first `limit` tokens: the offline stand-in for a model's summary."""
    tokens = F.split(F.trim(text), r"\s+")
    return F.when(F.size(tokens) < limit, text).otherwise(F.array_join(F.slice(tokens, 1, limit), " "))


def token_prefix(df: DataFrame, group: str, order: list[str], tokens: str, budget: int) -> DataFrame:
    """Per group the longest prefix in order whose tokens sum to the budget at most; the first overflow ends it.

    Adds `upto`, the sum with the row. The sums are taken over a range partitioning, so a hot group spans tasks.
    """
    placed = running_total(df, group, order, tokens, "before")
    return placed.withColumn("upto", F.col("before") + F.col(tokens)).drop("before").where(F.col("upto") <= budget)
