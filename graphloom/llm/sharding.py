"""Two-pass external shuffle into shards: scatter into memory-sized buckets, then shuffle and write each."""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import fresh, shared_folder, whole_text


def shard_of(key: Column, shards: int, seed: int) -> Column:
    """Rendezvous hashing: the shard with the highest seeded hash wins, so another shard only gains."""
    marks = [F.struct(F.xxhash64(F.lit(seed), key, F.lit(s)).alias("h"), F.lit(s).alias("s")) for s in range(shards)]
    return F.greatest(*marks).getField("s") if shards > 1 else reduce(lambda a, _: a, marks).getField("s")


#: The columns that the shuffle adds.
ADDED = ("size", "shard", "grown_shard", "slot")


def kept_names(columns: list[str]) -> dict[str, str]:
    """What each input column is called in the result: its name, or input_<name> where an added column has it."""
    out: dict[str, str] = {}
    for c in columns:
        name = c
        while name.lower() in ADDED or name.lower() in {x.lower() for x in [*out.values(), *(o for o in columns if o != c)]}:
            name = f"input_{name}"
        out[c] = name
    return out


def external_shuffle(docs: DataFrame, shards: int = 24, seed: int = 11, bucket_bytes: int = 8 << 20, folder: str | None = None) -> DataFrame:
    """Deals all rows into shards, gives each its place in its shard, and writes the shards.

    Law ``key``: doc_id and the number of shards decide the shard; with one more shard, rows
    move only into the new one. Pass 1 scatters the records by seeded hashes into buckets of
    about ``bucket_bytes`` inside their shard; pass 2 orders each bucket, applies a Fisher-Yates
    shuffle (``F.shuffle`` with a seed) and writes it as Parquet under ``folder`` (a new one in
    the shared folder unless given), a directory for each shard, with each row's bucket and place
    in it; reading it back turns them into slots. The number of partitions, the buckets and their
    order follow from the rows, so a task that runs again gives the same places.

    Adds size (UTF-8 bytes plus 8; a null text has none), shard, grown_shard and slot (gapless
    from 0 in each shard). All input columns stay; one that has an added column's name is
    ``input_<name>`` in the result. A null doc_id is a key like any other. Repeated rows, equal in
    doc_id and text, each get a slot; where they are more than a bucket's share of all rows they
    are dealt over their shard's buckets by where they were read, which tells them apart. A very
    long text is a record like any other. An empty table gives an empty result.
    """
    spark = docs.sparkSession
    folder = folder or f"{shared_folder(spark)}/shuffle-{uuid.uuid4().hex}"
    size = F.coalesce(F.octet_length(F.col("text")), F.lit(0)).cast("long") + 8
    names = kept_names(docs.columns)
    row = F.struct(*[F.col(c).alias(n) for c, n in names.items()]).alias("row")
    keys = docs.select(size.alias("size"), F.xxhash64(F.lit(seed + 1), F.col("doc_id").isNull(), F.col("doc_id"), F.xxhash64(whole_text())).alias("mark"))
    total, rows = keys.agg(F.coalesce(F.sum("size"), F.lit(0)), F.count("*")).first()
    buckets = max(1, -(-int(total) // (bucket_bytes * shards)))
    most = max(1000, rows // (buckets * shards))
    often = keys.groupBy("mark").agg(F.count("*").alias("n")).filter(F.col("n") > most).select("mark", F.lit(True).alias("often"))  # buckets * shards rows at most
    keyed = docs.select(size.alias("size"), shard_of(F.col("doc_id"), shards, seed).alias("shard"), shard_of(F.col("doc_id"), shards + 1, seed).alias("grown_shard"), F.xxhash64(F.lit(seed + 1), F.col("doc_id").isNull(), F.col("doc_id"), F.xxhash64(whole_text())).alias("mark"), F.monotonically_increasing_id().alias("read"), row)
    told = F.when(F.col("often"), F.xxhash64("mark", "read")).otherwise(F.col("mark"))
    bucket = F.col("shard") * F.lit(buckets) + F.pmod(told, F.lit(buckets)).cast("long")
    scattered = keyed.join(F.broadcast(often), "mark", "left").withColumn("bucket", bucket)
    parts = max(1, -(-buckets * shards // 2))
    record = F.struct(F.xxhash64(F.lit(seed + 2), "mark").alias("o"), "size", "shard", "grown_shard", "row")
    gathered = scattered.repartition(parts, "bucket").groupBy("bucket").agg(F.sort_array(F.collect_list(record)).alias("records"))
    mixed = gathered.select("bucket", F.shuffle("records", seed).alias("records")).select("bucket", F.posexplode("records").alias("at", "r"))
    inner, place = fresh([*names.values(), *ADDED], "bucket"), fresh([*names.values(), *ADDED], "place")
    out = mixed.select(*[F.col("r.row")[n].alias(n) for n in names.values()], "r.size", "r.grown_shard", F.col("bucket").alias(inner), F.col("at").alias(place), F.col("r.shard").alias("shard"))
    out.write.partitionBy("shard").parquet(folder)

    written = spark.read.schema(out.schema).parquet(folder)
    counts = written.groupBy("shard", inner).agg(F.count("*").alias("n"))
    before = Window.partitionBy("shard").orderBy(inner).rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select(inner, F.coalesce(F.sum("n").over(before), F.lit(0)).alias("_start"))  # buckets * shards rows of 16 bytes
    slot = (F.col("_start") + F.col(place)).cast("long").alias("slot")
    return written.join(F.broadcast(starts), inner).select(*names.values(), "size", "shard", "grown_shard", slot)
