"""Streams: documents ingested as they come, events counted in windows, rate limits kept per key."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from knotwork.operators.chunking import document_key, windows


def stream_documents(spark: SparkSession, folder: str, schema: str, files_per_batch: int = 100) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(folder)


def ingest(stream: DataFrame, root: str, size: int = 1200, overlap: int = 100, merge: Callable[[DataFrame, int], None] | None = None) -> StreamingQuery:
    """Append new documents and their chunks to tables under the root, each different text once.

    Each batch writes a folder of its own number, in both tables, over whatever an earlier attempt left there, and
    compares its documents with those of the other batches only; so a batch that is run again after a failure at any
    point ends in the same tables. `merge` gets the batch's chunks and number for what else is kept up to date, such as
    the merged graph.
    """

    def batch(df: DataFrame, number: int) -> None:
        spark = df.sparkSession
        new = df.where("text is not null").withColumn("doc_key", document_key(F.col("text"))).dropDuplicates(["doc_key"])
        try:
            new = new.join(spark.read.parquet(f"{root}/documents").where(F.col("batch") != number).select("doc_key"), "doc_key", "left_anti")
        except Exception as e:  # the first batch finds no table
            if "PATH_NOT_FOUND" not in str(e):
                raise
        from knotwork.session import durable

        new = durable(new)
        chunks = windows(new, size, overlap, "doc_key")
        chunks.write.mode("overwrite").parquet(f"{root}/chunks/batch={number}")
        if merge is not None:
            merge(chunks, number)
        new.select("doc_key", "doc_id", "text").write.mode("overwrite").parquet(f"{root}/documents/batch={number}")

    return stream.writeStream.foreachBatch(batch).option("checkpointLocation", f"{root}/_checkpoint").trigger(availableNow=True).start()


def tumbling_counts(events: DataFrame, length: str = "1 hour", late: str | None = "10 minutes") -> DataFrame:
    """Counts by window and type; rows later than the watermark are dropped by the stream. `late` is None where the stream has its watermark already."""
    return (events.withWatermark("ts", late) if late else events).groupBy(F.window("ts", length).alias("w"), "event_type").agg(F.count("*").alias("n")).select("w.start", "event_type", "n")


def deduplicated(events: DataFrame, late: str = "1 hour") -> DataFrame:
    """Redelivered events once, within the watermark."""
    return events.withWatermark("ts", late).dropDuplicatesWithinWatermark(["event_id"])


def rate_limited(events: DataFrame, seconds: float, limit: int) -> DataFrame:
    """user_id, event_id, allowed: windows that open with a user's first event outside the one before, state kept per user.

    The state of a user is two numbers and is kept as long as the stream: an expiry by processing time would keep a
    stream that runs once over what there is from ending.
    """
    from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        start, used = state.get if state.exists else (None, 0)
        rows = pd.concat(list(batches)).sort_values(["ts", "event_id"])
        out = []
        for event_id, ts in zip(rows["event_id"], rows["ts"]):
            at = int(pd.Timestamp(ts).value // 1000)
            if start is None or at - start >= seconds * 1_000_000:
                start, used = at, 0
            used += 1
            out.append((key[0], int(event_id), used <= limit))
        state.update((start, used))
        yield pd.DataFrame(out, columns=["user_id", "event_id", "allowed"])

    return events.groupBy("user_id").applyInPandasWithState(run, "user_id bigint, event_id bigint, allowed boolean", "start bigint, used bigint", "append", GroupStateTimeout.NoTimeout)


def watch(spark: SparkSession, tell: Callable[[dict], None]):
    """Progress of the session's streams told as plain records: started, progress (batch, rows, seconds), ended (error or null).

    Returns the listener; `spark.streams.removeListener` ends it.
    """
    from pyspark.sql.streaming.listener import StreamingQueryListener

    class Listener(StreamingQueryListener):
        def onQueryStarted(self, event):
            tell({"event": "started", "id": str(event.id), "name": event.name})

        def onQueryProgress(self, event):
            p = event.progress
            tell({"event": "progress", "id": str(p.id), "name": p.name, "batch": p.batchId, "rows": p.numInputRows, "seconds": p.batchDuration / 1000})

        def onQueryIdle(self, event):
            tell({"event": "idle", "id": str(event.id)})

        def onQueryTerminated(self, event):
            tell({"event": "ended", "id": str(event.id), "error": event.exception})

    listener = Listener()
    spark.streams.addListener(listener)
    return listener
