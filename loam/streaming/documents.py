"""Streams of documents.

Splitting, merging and enrichment keep a document in one row, so they run on a stream as they do on a table. Methods
with windows over a document's blocks run in ``foreachBatch``: a document arrives whole, so a micro-batch is a table.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.streaming.query import StreamingQuery

from loam.operators.merging import merge
from loam.operators.splitting import split_spans


def read_documents(spark: SparkSession, path: str, schema: T.StructType, max_files: int = 1000, source: str = "parquet") -> DataFrame:
    """New files of a folder; ``max_files`` a trigger bounds a micro-batch."""
    return spark.readStream.format(source).schema(schema).option("maxFilesPerTrigger", max_files).load(path)


def stream_chunks(docs: DataFrame, budget: int = 512, delimiters: str = "\n.?") -> DataFrame:
    """Packed chunks of a stream of documents. Stateless."""
    return merge(docs, split_spans(F.col("text"), delimiters), budget)


def each_batch(docs: DataFrame, method: Callable[[DataFrame], DataFrame], path: str, checkpoint: str) -> StreamingQuery:
    """Writes ``method`` of every micro-batch as Parquet under the batch's own folder: a repeated batch replaces itself."""

    def write(batch: DataFrame, number: int) -> None:
        method(batch).write.mode("overwrite").parquet(f"{path}/batch={number}")

    return docs.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def each_update(agg: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Writes the groups that every micro-batch changed, with the batch's number, under its own folder."""

    def write(batch: DataFrame, number: int) -> None:
        batch.withColumn("batch", F.lit(number).cast("long")).write.mode("overwrite").parquet(f"{path}/part={number}")

    return agg.writeStream.outputMode("update").foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def latest(rows: DataFrame, *keys: str) -> DataFrame:
    """The newest row of each group that ``each_update`` wrote."""
    rest = [c for c in rows.columns if c not in keys]
    newest = F.max(F.struct("batch", *[c for c in rest if c != "batch"]))
    return rows.groupBy(*keys).agg(newest.alias("_r")).select(*keys, *[F.col(f"_r.{c}").alias(c) for c in rest if c != "batch"])


def key_dictionary(keys: DataFrame) -> DataFrame:
    """(semantic_key, places, n): a rolling dictionary over a stream of (semantic_key, doc_id, idx), in state by key.

    The state is the number of places a key has had; each update emits the places that are new, numbered on from there,
    so all places together are those of the sink and state stays one number a key.
    """
    out = "semantic_key string, places array<string>, n long"

    def update(key: tuple, frames, held: GroupState):
        import pandas as pd

        (n,) = held.get if held.exists else (0,)
        for frame in frames:
            found = [f"{d}:{i}" for d, i in zip(frame["doc_id"], frame["idx"])]
            n += len(found)
            yield pd.DataFrame({"semantic_key": [key[0]], "places": [found], "n": [n]})
        held.update((n,))

    return keys.groupBy("semantic_key").applyInPandasWithState(update, out, "n long", "update", GroupStateTimeout.NoTimeout)


def event_windows(events: DataFrame, length: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Counts and sums by window and event type; events later than ``late`` behind the watermark are left out."""
    return (
        events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late).groupBy(F.window("ts", length), "event_type")
        .agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"))
        .select(F.col("window.start").alias("start"), "event_type", "n", "total")
    )


def event_sessions(events: DataFrame, gap: str = "30 minutes", late: str = "2 hours") -> DataFrame:
    """Sessions of each user: events no further apart than ``gap``."""
    return (
        events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late).groupBy(F.session_window("ts", gap), "user_id")
        .agg(F.count(F.lit(1)).alias("n"))
        .select("user_id", F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), "n")
    )
