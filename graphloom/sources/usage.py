"""Usage events and query history as JSON lines by day, read whole or as a stream with back-pressure."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SCHEMA = "ts timestamp, command string, user string, ok boolean, took_ms long"


def write_events(events: DataFrame, folder: str, mode: str = "append") -> None:
    """Appends events as JSON lines, one folder for each day; with mode "overwrite" only the days that occur are replaced.

    Events without a time go to the folder of the null day and stay.
    """
    dealt = events.withColumn("day", F.to_date("ts")).repartition("day", F.pmod(F.xxhash64("ts", "command", "user"), F.lit(8)))
    dealt.write.mode(mode).option("partitionOverwriteMode", "dynamic").partitionBy("day").json(folder)


def read_events(spark: SparkSession, folder: str, since: str | None = None) -> DataFrame:
    """The events of a folder; ``since`` (a date) prunes the folders of earlier days."""
    got = spark.read.schema(f"{SCHEMA}, day date").json(folder)
    return (got.filter(F.col("day") >= F.lit(since).cast("date")) if since else got).drop("day")


def stream_events(spark: SparkSession, folder: str, most_bytes: int = 1 << 30) -> DataFrame:
    """The same as a stream that admits about ``most_bytes`` of new files to a micro-batch."""
    return spark.readStream.schema(f"{SCHEMA}, day date").option("maxBytesPerTrigger", str(most_bytes)).json(folder).drop("day")


def history(events: DataFrame) -> DataFrame:
    """(command, n, failed, last): how often each command ran and failed, and when last."""
    return events.groupBy("command").agg(F.count("*").alias("n"), F.count_if(~F.coalesce("ok", F.lit(True))).alias("failed"), F.max("ts").alias("last"))
