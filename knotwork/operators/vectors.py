"""Exact cosine search: one query by a sorted limit, many queries in blocks against all rows."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

THRESHOLD = 0.2
QUERY_BLOCK, BASE_BLOCK = 2_000, 20_000


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity in double; null where a vector has no length."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    return dot(a, b) / F.nullif(F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)), F.lit(0.0))


def top_k(vectors: DataFrame, query: list[float], k: int, key: str = "vec_id", column: str = "embedding", threshold: float = THRESHOLD) -> DataFrame:
    """key, similarity: the k most similar rows at the threshold or over, ties by key. Each partition keeps only its own k best."""
    q = F.array(*[F.lit(float(x)) for x in query])
    return vectors.where(F.size(column) == len(query)).select(key, cosine(F.col(column), q).alias("similarity")).where(F.col("similarity") >= threshold).orderBy(F.desc("similarity"), key).limit(k)


def top_k_many(vectors: DataFrame, queries: DataFrame, k: int, key: str = "vec_id", column: str = "embedding", threshold: float = THRESHOLD) -> DataFrame:
    """query, key, similarity, rank for every query row against all rows: blocks of queries meet blocks of rows in one matrix product each."""
    usable = F.col(column).isNotNull() & ~F.exists(column, lambda v: v.isNull() | F.isnan(v))
    n_q, n_b = queries.count(), vectors.count()
    q_blocks, b_blocks = max(1, -(-n_q // QUERY_BLOCK)), max(1, -(-n_b // BASE_BLOCK))
    asked = queries.where(usable).select(F.col(key).alias("query"), F.col(column).alias("v"), F.pmod(F.xxhash64(key), F.lit(q_blocks)).cast("int").alias("qb"), F.explode(F.sequence(F.lit(0), F.lit(b_blocks - 1))).alias("bb"))
    rows = vectors.where(usable).select(F.col(key).alias("id"), F.col(column).alias("v"), F.pmod(F.xxhash64(key), F.lit(b_blocks)).cast("int").alias("bb"), F.explode(F.sequence(F.lit(0), F.lit(q_blocks - 1))).alias("qb"))

    def run(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        out = []
        for width, part in b.groupby(b["v"].map(len)):
            mine = a[a["v"].map(len) == width]
            if not len(mine) or not width:
                continue
            x, y = np.stack(mine["v"]).astype(np.float64), np.stack(part["v"]).astype(np.float64)
            lengths = np.outer(np.linalg.norm(x, axis=1), np.linalg.norm(y, axis=1))
            score = np.divide(x @ y.T, lengths, out=np.full(lengths.shape, -2.0), where=lengths > 0)
            ids = part["id"].to_numpy()
            order = np.lexsort((np.broadcast_to(ids, score.shape), -score), axis=1)[:, :k]
            best = np.take_along_axis(score, order, axis=1)
            good = best >= threshold
            out.append(pd.DataFrame({"query": np.repeat(mine["query"].to_numpy(), good.sum(axis=1)), "id": ids[order[good]], "similarity": best[good]}))
        return pd.concat(out) if out else pd.DataFrame({"query": pd.Series(dtype="int64"), "id": pd.Series(dtype="int64"), "similarity": pd.Series(dtype="float64")})

    found = asked.groupBy("qb", "bb").cogroup(rows.groupBy("qb", "bb")).applyInPandas(run, "query bigint, id bigint, similarity double")
    rank = F.row_number().over(Window.partitionBy("query").orderBy(F.desc("similarity"), "id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k)


def decode_float32(column: str) -> Column:
    """Base64 text of little-endian float32 numbers as an array of floats."""
    from pyspark.sql.functions import pandas_udf

    @pandas_udf("array<float>")
    def decode(texts: pd.Series) -> pd.Series:
        import base64

        return texts.map(lambda t: None if t is None else np.frombuffer(base64.b64decode(t), dtype="<f4"))

    return decode(F.col(column))


def embed_hashed(texts: DataFrame, key: str, column: str, dim: int = 64) -> DataFrame:
    """key, embedding: the offline embedding, a hashed bag of words of unit length."""
    from collections.abc import Iterator

    import xxhash

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = np.zeros((len(batch), dim), dtype=np.float32)
            for i, text in enumerate(batch[column]):
                for word in (text or "").lower().split():
                    h = xxhash.xxh64_intdigest(word)
                    out[i, h % dim] += 1 if h >> 32 & 1 else -1
            length = np.linalg.norm(out, axis=1, keepdims=True)
            yield pd.DataFrame({key: batch[key], "embedding": list(np.divide(out, length, out=out, where=length > 0))})

    return texts.select(key, column).mapInPandas(run, f"{key} {dict(texts.dtypes)[key]}, embedding array<float>")
