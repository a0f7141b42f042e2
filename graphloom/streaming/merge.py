"""Streams of edge changes and usage events."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..core import shared_folder
from ..operators.analytics import latest_writes


def merge_stream(deltas: DataFrame, key: list[str], folder: str | None = None) -> DataFrame:
    """Merges a stream of (key, seq, op) into a last-writer-wins table.

    Each micro-batch adds its own winners under its number, so that a batch that runs again
    replaces what it wrote; the winners of all batches are the table. With the same ``folder`` a
    new run goes on where the last one stopped. A stream without rows gives an empty table.
    """
    spark = deltas.sparkSession
    folder = folder or f"{shared_folder(spark)}/merge-{uuid.uuid4().hex}"

    def winners(df: DataFrame) -> DataFrame:
        return df.groupBy(*key).agg(F.max(F.struct("seq", "op")).alias("w")).select(*key, "w.seq", "w.op")

    def add(batch: DataFrame, number: int) -> None:
        winners(batch.select(*key, "seq", "op")).write.mode("overwrite").parquet(f"{folder}/changes/batch={number}")

    schema = deltas.select(*key, "seq", "op").schema
    spark.createDataFrame([], schema).write.mode("overwrite").parquet(f"{folder}/changes/batch=-1")
    deltas.writeStream.foreachBatch(add).option("checkpointLocation", f"{folder}/log").trigger(availableNow=True).start().awaitTermination()
    return latest_writes(spark.read.schema(schema).parquet(f"{folder}/changes"), key, [F.col("seq")])


def weekly_counts(events: DataFrame, folder: str | None = None) -> DataFrame:
    """What ``weekly_stream`` has counted when the stream has been read: week, event_type, n."""
    spark = events.sparkSession
    folder = folder or f"{shared_folder(spark)}/weekly-{uuid.uuid4().hex}"

    def put(batch: DataFrame, _: int) -> None:
        batch.select(F.to_date("window.start").cast("string").alias("week"), "event_type", "n").write.mode("overwrite").parquet(f"{folder}/now")

    spark.createDataFrame([], "week string, event_type string, n long").write.mode("ignore").parquet(f"{folder}/now")
    weekly_stream(events).writeStream.outputMode("complete").foreachBatch(put).option("checkpointLocation", f"{folder}/log").trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(f"{folder}/now")


def prune(events: DataFrame, days: int) -> DataFrame:
    """Events of the last ``days`` days before the latest one."""
    last = events.agg(F.max("ts").alias("last"))
    return events.join(F.broadcast(last)).filter(F.col("ts") >= F.col("last") - F.expr(f"interval {days} days")).drop("last")


def weekly_stream(events: DataFrame, late: str = "1 day") -> DataFrame:
    """Weekly counts by event type, weeks from Monday, with a watermark."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", "7 days", startTime="4 days"), "event_type").agg(F.count("*").alias("n"))
