"""Documents cut into chunks, and the keys of documents and chunks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from knotwork.functions.text import strip

HEADING = r"(?m)(?=^#{1,6}[ \t]*Chunk[ \t]+[A-Za-z0-9_.-]+)"


def tokens(text: Column) -> Column:
    """Blank-separated tokens; the empty text has none."""
    return F.filter(F.split(text, r"\s+"), lambda t: t != "")


def windows(docs: DataFrame, size: int = 1200, overlap: int = 100, key: str = "doc_id") -> DataFrame:
    """key, chunk_order_index, tokens, content: windows of `size` tokens that start every size - overlap tokens.

    The last window may lie within the one before it. Null and blank texts give no window; an overlap of the size or
    more is refused.
    """
    if not 0 <= overlap < size:
        raise ValueError("the overlap must be smaller than the size")
    step = size - overlap
    listed = docs.where("text is not null").select(key, tokens(F.col("text")).alias("t")).where(F.size("t") > 0)
    starts = F.sequence(F.lit(0), F.size("t") - 1, F.lit(step))
    return listed.select(key, "t", F.posexplode(starts).alias("chunk_order_index", "start")).select(key, "chunk_order_index", F.least(F.lit(size), F.size("t") - F.col("start")).alias("tokens"), F.array_join(F.slice("t", F.col("start") + 1, size), " ").alias("content"))


def by_heading(docs: DataFrame, key: str = "doc_id") -> DataFrame:
    """key, source_chunk_id, chunk_order_index, content: one chunk a `# Chunk id` heading; text before the first is dropped."""
    parts = docs.where(F.col("text").rlike(HEADING)).select(key, F.explode(F.split("text", HEADING)).alias("part"))
    named = parts.where(F.col("part").rlike(r"^#{1,6}[ \t]*Chunk[ \t]+")).withColumn("source_chunk_id", F.regexp_extract("part", r"^#{1,6}[ \t]*Chunk[ \t]+([A-Za-z0-9_.-]+)", 1))
    body = strip(F.regexp_replace("part", r"^[^\n]*\n?", ""))
    return named.select(key, "source_chunk_id", body.alias("content")).where("content <> ''")


def document_key(text: Column, prefix: str = "doc-") -> Column:
    return F.concat(F.lit(prefix), F.md5(strip(text)))


def dedupe_documents(docs: DataFrame) -> DataFrame:
    """doc_key and the first doc_id of each different text."""
    return docs.where("text is not null").groupBy(document_key(F.col("text")).alias("doc_key")).agg(F.min("doc_id").alias("doc_id"))


def chunk_keys(chunks: DataFrame, source: str, content: str, order: str) -> DataFrame:
    """Adds chunk_key: the sanitised source id, with the end of the content's hash where different contents share it, or the hash alone."""
    name = F.regexp_replace(F.regexp_replace(F.coalesce(F.col(source), F.lit("")), r"[^A-Za-z0-9._-]", ""), r"^[._-]+|[._-]+$", "")
    hashed = F.md5(F.coalesce(F.col(content), F.lit("")))
    rows = chunks.withColumns({"name": name, "hashed": hashed})
    first = rows.groupBy("name").agg(F.min_by("hashed", order).alias("first_hash"))
    joined = rows.join(first, "name")
    key = F.when(F.col("name") == "", F.concat(F.lit("chunk-"), F.col("hashed"))).when(F.col("hashed") == F.col("first_hash"), F.col("name")).otherwise(F.concat_ws("-", "name", F.right("hashed", F.lit(8))))
    return joined.withColumn("chunk_key", key).drop("name", "hashed", "first_hash")


def unique_contexts(rows: DataFrame, text: str, order: str) -> DataFrame:
    """Distinct texts with the place of their first occurrence."""
    return rows.where(F.col(text).isNotNull()).groupBy(text).agg(F.min(order).alias(order))


def context_windows(rows: DataFrame, group: str, order: str, text: str, width: int = 3) -> DataFrame:
    """Each row's text with the next width - 1 ones of its group, joined by blanks. Groups are chunks' or papers' rows; a hot group is one sorted, spilling task."""
    w = Window.partitionBy(group).orderBy(order)
    ahead = [F.lead(text, i).over(w) for i in range(1, width)]
    return rows.select(group, order, F.concat_ws(" ", text, *ahead).alias("context"))


def token_budget(rows: DataFrame, group: str, text: str) -> DataFrame:
    """Sum over texts of their tokens, of at least one each."""
    return rows.groupBy(group).agg(F.sum(F.greatest(F.lit(1), F.size(tokens(F.coalesce(F.col(text), F.lit("")))))).cast("bigint").alias("token_budget"))
