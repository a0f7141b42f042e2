"""Checkpoints shared by the iterative operators."""

from __future__ import annotations

import re
import tempfile
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder that spark.checkpoint.dir names; one of our own only in a single local process, as in tests."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        named = spark.conf.get("spark.checkpoint.dir", None)
        if not named and not re.fullmatch(r"local(\[[^\]]*\])?", sc.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="graphloom-"))
    return sc.getCheckpointDir()


def cut(df: DataFrame) -> DataFrame:
    """Cuts lineage with a reliable checkpoint in the shared folder."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


@contextmanager
def _static(spark: SparkSession) -> Iterator[None]:
    """Plans made inside are not adaptive: an adaptive plan does not tell its partitioning to a checkpoint."""
    was = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        yield
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", was)


def cut_placed(df: DataFrame) -> DataFrame:
    """As ``cut``, and the checkpoint keeps the partitioning of the plan's last shuffle, so a join on its keys reads it as it lies."""
    shared_folder(df.sparkSession)
    with _static(df.sparkSession):
        # select() makes a plan of its own, in case df was planned before
        return df.select("*").checkpoint(eager=True)


def dealt(df: DataFrame, *keys: str) -> DataFrame:
    """A checkpoint dealt by ``keys`` over the session's shuffle partitions and sorted by them."""
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return cut_placed(df.repartition(parts, *keys).sortWithinPartitions(*keys))
