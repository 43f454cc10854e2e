"""Queries of catalogue views, running state, and (ext_) windows over events, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from knotwork.operators import service as s
from knotwork.session import table


def _files(spark: SparkSession, d: str) -> DataFrame:
    """Orders as files: owner (none for some), knowledge base, status, size."""
    return table(spark, d, "orders").select(F.col("o_orderkey").alias("file_id"), F.when(F.col("o_custkey") % 10 != 0, F.col("o_custkey")).alias("owner"), (F.col("o_custkey") % 50).alias("kb"), F.col("o_orderstatus").alias("status"), F.col("o_totalprice").alias("size"), F.col("o_orderdate").alias("created_at"))


def file_visibility(spark: SparkSession, d: str) -> DataFrame:
    return _files(spark, d).where(s.visible(F.col("owner"), F.lit(7).cast("bigint"), True)).select("file_id", "owner")


def files_by_kb(spark: SparkSession, d: str) -> DataFrame:
    return _files(spark, d).where("kb = 3 and status = 'F'").select("file_id", "size")


def kb_stats(spark: SparkSession, d: str) -> DataFrame:
    return s.status_counts(_files(spark, d), "kb", "status", "size", ["F", "O", "P"])


def provider_latest(spark: SparkSession, d: str) -> DataFrame:
    return s.latest(_files(spark, d), "kb", "created_at", ["file_id"])


def provider_rotation(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "supplier").select("s_suppkey", "s_nationkey", F.floor("s_acctbal").alias("priority"))
    return s.rotation(rows, "s_nationkey", ["priority", "s_suppkey"], 2).select("s_nationkey", "s_suppkey", "turn")


def error_classes(spark: SparkSession, d: str) -> DataFrame:
    text = F.concat(F.lit("HTTP "), (400 + F.col("event_id") % 150).cast("string"), F.when(F.col("event_id") % 5 == 0, F.lit(" request timed out")).when(F.col("event_id") % 7 == 0, F.lit(" Insufficient_Quota")).otherwise(F.lit("")))
    return table(spark, d, "events").select("event_id", s.error_class(text).alias("error_class"))


def ema_latency(spark: SparkSession, d: str) -> DataFrame:
    return s.moving_average(table(spark, d, "events"), "user_id", ["ts", "event_id"], "value").select("user_id", F.round("ema", 6).alias("ema"), "n")


def rate_limit_aligned(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "events").groupBy("user_id", F.window("ts", "1 hour").alias("w")).agg(F.count("*").alias("n"))
    return rows.select("user_id", F.col("w.start").alias("window_start"), "n", (F.col("n") > 3).alias("limited"))


def rate_limit_exact(spark: SparkSession, d: str) -> DataFrame:
    return s.greedy_windows(table(spark, d, "events"), "user_id", "ts", 3600.0, 3, "event_id")


def quota_usage(spark: SparkSession, d: str) -> DataFrame:
    """Windows of thirty days from a user's first call: calls and calls over the quota."""
    calls = s.greedy_windows(table(spark, d, "events"), "user_id", "ts", 30 * 86400.0, 50, "event_id")
    return calls.groupBy("user_id", "window_start").agg(F.count("*").alias("calls"), F.count_if(~F.col("allowed")).alias("refused"))


def llm_cache_split(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "evaluate_qa_answers").select("answer_id", "question", "answer").distinct().withColumn("args_hash", F.md5(F.coalesce("question", F.lit(""))))
    return s.cache_split(rows.where("answer_id % 3 <> 0").select("answer_id", "args_hash"), rows.where("answer_id % 3 = 0"), "args_hash", "answer").select("answer_id", "args_hash", "cached", "hit")


def structured_filter(spark: SparkSession, d: str) -> DataFrame:
    """Quantities by number: temperatures over 40 in degrees Celsius fields."""
    return table(spark, d, "parsed_quantity").where("quantity_type = 'temperature' and value > 40").select("quantity_id", "value", "unit").distinct()


def database_status(spark: SparkSession, d: str) -> DataFrame:
    """Rows and characters of each paper's documents: the status view of a text database."""
    return table(spark, d, "documents").groupBy("paper_id").agg(F.count("*").alias("docs"), F.coalesce(F.sum("n_chars"), F.lit(0)).alias("chars"), F.round(F.coalesce(F.sum("n_chars"), F.lit(0)) / 1048576, 2).alias("mb"))


def ext_tumbling(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "events").groupBy(F.window("ts", "1 day").alias("w"), "event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"))
    return rows.select(F.col("w.start").alias("day"), "event_type", "n", "total")


def ext_session_window(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "events").groupBy("user_id", F.session_window("ts", "30 minutes").alias("w")).agg(F.count("*").alias("n"))
    return rows.select("user_id", F.col("w.start").alias("session_start"), "n")


def ext_cube(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "lineitem").cube("l_returnflag", "l_linestatus").agg(F.count("*").alias("n"), F.round(F.sum("l_quantity"), 2).alias("quantity"))
    return rows.select("l_returnflag", "l_linestatus", "n", "quantity")


QUERIES = {f.__name__: f for f in (file_visibility, files_by_kb, kb_stats, provider_latest, provider_rotation, error_classes, ema_latency, rate_limit_aligned, rate_limit_exact, quota_usage, llm_cache_split, structured_filter, database_status, ext_tumbling, ext_session_window, ext_cube)}

_F = "f AS (SELECT o_orderkey AS file_id, CASE WHEN o_custkey % 10 <> 0 THEN o_custkey END AS owner, o_custkey % 50 AS kb, o_orderstatus AS status, o_totalprice AS size, o_orderdate AS created_at FROM orders)"
_GREEDY = """WITH RECURSIVE e AS (SELECT user_id, event_id, ts, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS r FROM events),
    w AS (SELECT user_id, r, event_id, ts AS window_start, 1 AS used FROM e WHERE r = 1 UNION ALL
        SELECT e.user_id, e.r, e.event_id, CASE WHEN e.ts - w.window_start >= INTERVAL '{length}' THEN e.ts ELSE w.window_start END, CASE WHEN e.ts - w.window_start >= INTERVAL '{length}' THEN 1 ELSE w.used + 1 END FROM w JOIN e ON e.user_id = w.user_id AND e.r = w.r + 1)"""
ORACLES = {
    "file_visibility": f"WITH {_F} SELECT file_id, owner FROM f WHERE owner = 7 OR owner IS NULL",
    "files_by_kb": f"WITH {_F} SELECT file_id, size FROM f WHERE kb = 3 AND status = 'F'",
    "kb_stats": f"WITH {_F} SELECT kb, count(*) FILTER (status = 'F') AS n_f, count(*) FILTER (status = 'O') AS n_o, count(*) FILTER (status = 'P') AS n_p, round(sum(size), 2) AS total_size, count(*) AS files FROM f GROUP BY kb",
    "provider_latest": f"WITH {_F} SELECT kb, file_id FROM (SELECT kb, file_id, row_number() OVER (PARTITION BY kb ORDER BY created_at DESC, file_id DESC) AS r FROM f) WHERE r = 1",
    "provider_rotation": "WITH p AS (SELECT s_nationkey, s_suppkey, row_number() OVER (PARTITION BY s_nationkey ORDER BY floor(s_acctbal), s_suppkey) - 1 AS place, count(*) OVER (PARTITION BY s_nationkey) AS n FROM supplier) SELECT s_nationkey, s_suppkey, ((((place - 2) % n) + n) % n)::INT AS turn FROM p",
    "error_classes": "WITH t AS (SELECT event_id, lower('HTTP ' || (400 + event_id % 150) || CASE WHEN event_id % 5 = 0 THEN ' request timed out' WHEN event_id % 7 = 0 THEN ' Insufficient_Quota' ELSE '' END) AS x FROM events) SELECT event_id, CASE " + " ".join(f"WHEN regexp_matches(x, '{p}') THEN '{c}'" for p, c in s.ERROR_RULES) + " ELSE 'fail' END AS error_class FROM t",
    "ema_latency": "WITH e AS (SELECT user_id, value, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS r, count(*) OVER (PARTITION BY user_id) AS n FROM events WHERE value IS NOT NULL) SELECT user_id, round(sum(power(0.8, n - r) * CASE WHEN r = 1 THEN 1.0 ELSE 0.2 END * value), 6) AS ema, any_value(n) AS n FROM e GROUP BY user_id",
    "rate_limit_aligned": "SELECT user_id, date_trunc('hour', ts) AS window_start, count(*) AS n, count(*) > 3 AS limited FROM events GROUP BY ALL",
    "rate_limit_exact": _GREEDY.format(length="1 hour") + " SELECT user_id, event_id, window_start, used, used <= 3 AS allowed FROM w",
    "quota_usage": _GREEDY.format(length="30 days") + " SELECT user_id, window_start, count(*) AS calls, count(*) FILTER (used > 50) AS refused FROM w GROUP BY ALL",
    "llm_cache_split": "WITH r AS (SELECT DISTINCT answer_id, md5(coalesce(question, '')) AS args_hash, answer FROM evaluate_qa_answers), c AS (SELECT args_hash, min(answer) AS cached FROM r WHERE answer_id % 3 = 0 GROUP BY 1) SELECT answer_id, r.args_hash, cached, c.args_hash IS NOT NULL AS hit FROM r LEFT JOIN c USING (args_hash) WHERE answer_id % 3 <> 0",
    "structured_filter": "SELECT DISTINCT quantity_id, value, unit FROM parsed_quantity WHERE quantity_type = 'temperature' AND value > 40",
    "database_status": "SELECT paper_id, count(*) AS docs, coalesce(sum(n_chars), 0)::BIGINT AS chars, round(coalesce(sum(n_chars), 0) / 1048576, 2) AS mb FROM documents GROUP BY 1",
    "ext_tumbling": "SELECT date_trunc('day', ts) AS day, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL",
    "ext_session_window": "WITH g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 30 MINUTES THEN 0 ELSE 1 END AS s FROM events), k AS (SELECT *, sum(s) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS n_ FROM g) SELECT user_id, min(ts) AS session_start, count(*) AS n FROM k GROUP BY user_id, n_",
    "ext_cube": "SELECT l_returnflag, l_linestatus, count(*) AS n, round(sum(l_quantity), 2) AS quantity FROM lineitem GROUP BY CUBE (l_returnflag, l_linestatus)",
}
