"""Helpers shared by the corpus operators: checkpoints, words, and skew-safe ranks and joins."""

from __future__ import annotations

import contextlib
import ctypes
import gc
import math
import re
import tempfile
from collections.abc import Callable, Iterator

import pyarrow as pa
from py4j.protocol import Py4JError
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: ASCII white space as the contracts define it, and the words between.
SPACE = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]+"


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/labels.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The checkpoint folder that the cluster names; one of our own only in a single local process, as in tests."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        named = spark.conf.get("spark.checkpoint.dir", None)
        if not named and not re.fullmatch(r"local(\[[^\]]*\])?", sc.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="graphloom-ckpt-"))
    return sc.getCheckpointDir()


def fresh(columns: list[str], name: str) -> str:
    """``name``, or with underscores until no column has it (column names ignore case)."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def cut(df: DataFrame) -> DataFrame:
    """Cuts the lineage with a reliable checkpoint in the shared folder."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def release(spark: SparkSession | None = None) -> None:
    """Gives memory that this process has freed back to the system, where the C library can; with ``spark``, the driver's JVM too.

    A loop of small plans fills the JVM's heap with plans and relations that nothing uses any more.
    Checkpoints and broadcasts among them go with them. Outside the heap, compiling their code
    leaves freed memory with the C library's arenas, which the JVM's own trim gives back.
    """
    gc.collect()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL(None).malloc_trim(0)
    if spark is not None:
        spark.sparkContext._jvm.System.gc()
        trim_native(spark)


def trim_native(spark: SparkSession) -> str:
    """Has the driver's JVM give freed native memory back, and returns what it says; empty where the JVM has no such command."""
    gateway = spark.sparkContext._gateway
    jvm = gateway.jvm
    with contextlib.suppress(Py4JError):
        server = jvm.java.lang.management.ManagementFactory.getPlatformMBeanServer()
        name = jvm.javax.management.ObjectName("com.sun.management:type=DiagnosticCommand")
        # the server's own class is closed to reflection, its interface is not
        kind = jvm.java.lang.Class.forName
        types = gateway.new_array(jvm.java.lang.Class, 4)
        types[0], types[1], types[2], types[3] = kind("javax.management.ObjectName"), kind("java.lang.String"), kind("[Ljava.lang.Object;"), kind("[Ljava.lang.String;")
        args = gateway.new_array(jvm.java.lang.Object, 4)
        args[0], args[1] = name, "systemTrimNativeHeap"
        return str(kind("javax.management.MBeanServer").getMethod("invoke", types).invoke(server, args))
    return ""


def lean(make: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """A function for mapInArrow whose Python worker gives back what its task has freed, as workers stay beside the tasks that follow."""

    def run(batches: Iterator) -> Iterator:
        yield from make(batches)
        release()

    return run


def gathered(df: DataFrame, rows: int) -> DataFrame:
    """A checkpoint read in tasks of about ``rows`` rows, so that small tables don't make many small shuffle files."""
    done = cut(df)
    # counted as it lies, without a plan of its own
    return done.coalesce(max(1, -(-done._jdf.queryExecution().toRdd().count() // rows)))


def whole_text(col: str = "text") -> Column:
    return F.coalesce(F.col(col).cast("string"), F.lit(""))


def word_count(text: Column) -> Column:
    return F.regexp_count(text, F.lit(WORD)).cast("long")


def held_out_third(doc_id: Column) -> Column:
    """True for rows whose labels must not be learned from."""
    return (F.crc32(doc_id.cast("string").cast("binary")) % 3) == 1


def partitions_for(spark: SparkSession, n_bytes: int, per_part: int) -> int:
    """Partitions so that each holds about ``per_part`` bytes, not fewer than the session's."""
    least = int(spark.conf.get("spark.sql.shuffle.partitions"))
    return max(least, -(-int(n_bytes) // per_part))


def running_offset(df: DataFrame, group: list[str], order: list, weight: Column, out: str, rows: int, seed: int = 17) -> DataFrame:
    """Adds the sum of ``weight`` over the rows before this one within its group.

    Groups of any size are dealt over cells by a seeded hash of ``order``; a cell's start comes
    from a table of one row per group and cell, so no task needs a whole group. The order within
    a group is (cell, order). ``rows`` is the row count; cells hold about its square root, so that
    neither a cell nor a group's table of cells grows faster than that.
    """
    cells = max(1, -(-rows // max(1000, math.isqrt(rows))))
    cell = F.pmod(F.xxhash64(F.lit(seed), *order), F.lit(cells)).cast("int")
    df = df.withColumn("_cell", cell).withColumn("_w", weight.cast("long"))
    sums = df.groupBy(*group, "_cell").agg(F.sum("_w").alias("_cw"))
    before = Window.partitionBy(*group).orderBy("_cell").rowsBetween(Window.unboundedPreceding, -1)
    starts = sums.withColumn("_start", F.coalesce(F.sum("_cw").over(before), F.lit(0))).drop("_cw")
    starts = starts.select(*[F.col(c).alias(f"_s_{c}") for c in group], F.col("_cell").alias("_s_cell"), "_start")
    on = F.col("_cell") == F.col("_s_cell")
    for c in group:
        on = on & F.col(c).eqNullSafe(F.col(f"_s_{c}"))
    within = Window.partitionBy(*group, "_cell").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    joined = df.join(starts, on, "left")
    joined = joined.withColumn(out, F.col("_start") + F.coalesce(F.sum("_w").over(within), F.lit(0)))
    return joined.drop("_cell", "_w", "_start", "_s_cell", *[f"_s_{c}" for c in group])


def join_sized(left: DataFrame, right: DataFrame, key: str, size: str, total: int, spread: Column) -> DataFrame:
    """Left join on a string or long ``key`` that one value may dominate.

    ``right`` has one row per key, with the number of left rows in ``size``. The keys that hold
    1/share of all rows or more are at most ``share`` in number, which bounds the broadcast; share
    is the number of shuffle partitions, 200 at least. The others are joined by a shuffle, and
    rows that the broadcast served are dealt by ``spread`` meanwhile. So a key brings a task no
    more than the even share of all rows.
    """
    cols = [c for c in right.columns if c != key]
    share = max(200, int(left.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    limit = max(1000, total // share)
    hot = right.filter(F.col(size) >= limit).select(F.col(key).alias("_hk"), F.lit(True).alias("_hot"), *[F.col(c).alias(f"_h_{c}") for c in cols])
    marked = left.join(F.broadcast(hot), F.col(key) == F.col("_hk"), "left")
    marked = marked.withColumn("_jk", F.when(F.col("_hot").isNull(), F.concat(F.lit("k"), F.col(key).cast("string"))).otherwise(F.concat(F.lit("h"), spread.cast("string"))))
    cold = right.filter(F.col(size) < limit).select(F.concat(F.lit("k"), F.col(key).cast("string")).alias("_jk"), *[F.col(c).alias(f"_c_{c}") for c in cols])
    joined = marked.join(cold, "_jk", "left")
    return joined.select(*left.columns, *[F.coalesce(F.col(f"_h_{c}"), F.col(f"_c_{c}")).alias(c) for c in cols])


def join_salted(left: DataFrame, right: DataFrame, key: str, hot: DataFrame, spread: Column) -> DataFrame:
    """Inner join on ``key`` where a few keys have very many rows on the left.

    ``hot`` has ``key`` and ``salts``, the number of parts that the key's left rows are dealt over
    by ``spread``; its right rows are repeated for each part. ``hot`` is broadcast: see ``hot_keys``.
    """
    some = F.broadcast(hot.select(F.col(key).alias("_hk"), "salts"))
    parts = F.coalesce("salts", F.lit(1))
    l_ = left.join(some, F.col(key) == F.col("_hk"), "left").withColumn("_salt", F.pmod(spread, parts)).drop("_hk", "salts")
    r_ = right.join(some, F.col(key) == F.col("_hk"), "left").withColumn("_salt", F.explode(F.sequence(F.lit(0).cast("long"), parts - 1))).drop("_hk", "salts")
    return l_.join(r_.hint("merge"), [key, "_salt"]).drop("_salt")


def hot_keys(sizes: DataFrame, key: str, size: str, total: int) -> DataFrame:
    """The keys over an even share of ``total`` rows, with the parts to cut them into: at most as many as there are shares."""
    share = max(200, int(sizes.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    limit = max(2000, total // share)
    return cut(sizes.filter(F.col(size) > limit).select(key, F.ceil(F.col(size) / limit).cast("long").alias("salts")))
