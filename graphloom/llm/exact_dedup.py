"""Exact dedup through an extendible-hash index.

Keys are 64-bit hashes of the normalised text. A directory over key prefixes is doubled until
no bucket is over its capacity (or one cell alone fills it). The rows are scattered by bucket;
an owner task reads its buckets in key order, chains the distinct texts of a key, compares
bytes along the chain, and writes one index entry per distinct text to the shared folder.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import SPACE, cut, join_sized, lean, partitions_for, shared_folder, whole_text


def normalised(col: str = "text") -> Column:
    return F.regexp_replace(whole_text(col), SPACE, " ")


class Directory:
    """An extendible-hash directory over the first bits of 64-bit keys.

    Slots point to buckets. A bucket that overfills is split by its next bit; where it has as
    many bits as the directory, the directory doubles first. Loads come in by cells, prefixes of
    ``bits`` bits, which are not split further.
    """

    def __init__(self, capacity: int, bits: int):
        self.capacity, self.bits = capacity, bits
        self.depth, self.slots = 0, [0]
        self.local, self.prefix, self.load, self.cells = [0], [0], [0], [[]]

    def add(self, cell: int, load: int) -> None:
        b = self.slots[cell >> (self.bits - self.depth)]
        self.cells[b].append((cell, load))
        self.load[b] += load
        todo = [b]
        while todo:
            b = todo.pop()
            if self.load[b] > self.capacity and self.local[b] < self.bits:
                todo += [b, self._split(b)]

    def _split(self, b: int) -> int:
        if self.local[b] == self.depth:
            self.slots = [s for s in self.slots for _ in (0, 1)]
            self.depth += 1
        new, bit = len(self.load), self.bits - self.local[b] - 1
        self.local[b] += 1
        self.prefix[b] <<= 1
        self.local.append(self.local[b])
        self.prefix.append(self.prefix[b] + 1)
        mine = [c for c in self.cells[b] if not c[0] >> bit & 1]
        self.cells.append([c for c in self.cells[b] if c[0] >> bit & 1])
        self.cells[b] = mine
        self.load.append(sum(n for _, n in self.cells[new]))
        self.load[b] -= self.load[new]
        wide = self.depth - self.local[new]
        for i in range(self.prefix[new] << wide, (self.prefix[new] + 1) << wide):
            self.slots[i] = new
        return new


def _combine(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row per distinct text of a batch: a group of copies arrives as one row from each."""
    for b in batches:
        seen: dict[bytes, list] = {}
        bucket, key, ids, text = (b.column(i) for i in range(4))
        for i, (d, t) in enumerate(zip(ids.to_pylist(), text.to_pylist(), strict=True)):
            e = seen.setdefault(t, [i, d, 0])
            e[2] += 1
            if d is not None and (e[1] is None or d < e[1]):
                e[1] = d
        at = pa.array([e[0] for e in seen.values()], pa.int64())
        yield pa.RecordBatch.from_arrays([bucket.take(at), key.take(at), pa.array([e[1] for e in seen.values()], pa.int64()), pa.array([e[2] for e in seen.values()], pa.int64()), text.take(at)], names=["bucket", "key", "doc_id", "n", "text"])


def _own(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows in key order: chains the distinct texts of each key, comparing bytes."""
    names = ["bucket", "key", "chain", "text_sha256", "keep_id", "group_size"]
    out: list[tuple] = []
    at: tuple | None = None
    chain: list[list] = []

    def close() -> None:
        for i, (text, keep, n) in enumerate(chain):
            out.append((*at, i, hashlib.sha256(text).hexdigest(), keep, n))

    def batch() -> pa.RecordBatch:
        kinds = [pa.int32(), pa.int64(), pa.int32(), pa.string(), pa.int64(), pa.int64()]
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], k) for i, k in enumerate(kinds)], names=names)

    for b in batches:
        for bucket, key, d, n, text in zip(*(c.to_pylist() for c in b.columns), strict=True):
            if at != (bucket, key):
                close()
                at, chain = (bucket, key), []
            for e in chain:
                if e[0] == text:
                    e[2] += n
                    if d is not None and (e[1] is None or d < e[1]):
                        e[1] = d
                    break
            else:
                chain.append([text, d, n])
        if len(out) > 5000:
            yield batch()
            out.clear()
    close()
    if out:
        yield batch()


#: Buckets that a directory may have on the average; with more bytes, buckets are larger. So the
#: directory, which the driver holds and broadcasts, is 2**22 numbers at most.
MOST_BUCKETS = 1 << 20


@dataclass
class Index:
    """An index on shared files: ``entries`` (bucket, key, chain, text_sha256, keep_id, group_size) and ``directory``."""

    folder: str

    def entries(self, spark: SparkSession) -> DataFrame:
        return spark.read.parquet(f"{self.folder}/entries")

    def directory(self, spark: SparkSession) -> DataFrame:
        """slot, bucket, local_depth"""
        return spark.read.parquet(f"{self.folder}/directory")


def keys(docs: DataFrame) -> DataFrame:
    """doc_id, text_sha256, key and bytes of every row's normalised text."""
    text = normalised()
    return docs.select("doc_id", text.alias("text")).select("doc_id", F.sha2("text", 256).alias("text_sha256"), F.xxhash64("text").alias("key"), F.octet_length("text").alias("bytes"))


def build_index(docs: DataFrame, keyed: DataFrame, bucket_bytes: int = 8 << 20, folder: str | None = None) -> Index:
    """Writes the index of ``docs`` to ``folder`` (a new one in the shared folder unless given)."""
    spark = docs.sparkSession
    folder = folder or f"{shared_folder(spark)}/exact-index-{uuid.uuid4().hex}"
    total = keyed.agg(F.coalesce(F.sum(F.col("bytes") + 64), F.lit(0))).first()[0]
    capacity = max(bucket_bytes, -(-total // MOST_BUCKETS))
    bits = max(1, (-(-total // capacity)).bit_length() + 1)
    cells = keyed.groupBy(F.shiftrightunsigned("key", 64 - bits).alias("cell")).agg(F.sum(F.col("bytes") + 64).alias("load")).collect()
    made = Directory(capacity, bits)
    for r in sorted(cells):
        made.add(r["cell"], r["load"])
    table = spark.createDataFrame([(i, b, made.local[b]) for i, b in enumerate(made.slots)], "slot int, bucket int, local_depth int")
    table.coalesce(1).write.parquet(f"{folder}/directory")

    slot = F.shiftrightunsigned("key", 64 - made.depth).cast("int") if made.depth else F.lit(0)
    entries = docs.select("doc_id", normalised().alias("text")).select("doc_id", F.xxhash64("text").alias("key"), F.col("text").cast("binary").alias("text"))
    entries = entries.withColumn("slot", slot).join(F.broadcast(table), "slot").select("bucket", "key", F.col("doc_id").cast("long").alias("doc_id"), "text")
    entries = entries.mapInArrow(lean(_combine), "bucket int, key long, doc_id long, n long, text binary")
    owners = partitions_for(spark, total, 64 << 20)
    dealt = entries.repartition(owners, "bucket").sortWithinPartitions("bucket", "key")
    dealt.mapInArrow(lean(_own), "bucket int, key long, chain int, text_sha256 string, keep_id long, group_size long").write.parquet(f"{folder}/entries")
    return Index(folder)


def exact_dedup(docs: DataFrame, bucket_bytes: int = 8 << 20, folder: str | None = None) -> DataFrame:
    """Marks the copies of each text (equal after collapsing white space to one space).

    Adds ``keep_id`` (the smallest doc_id of the group), ``group_size``, ``kept`` and
    ``text_sha256`` to doc_id, which must be an integer (or a string of one). A null text counts
    as empty; empty texts form a group like any other. Repeated rows are rows of the group, and
    each gets a row in the result: all of them with the smallest doc_id are kept. Rows that
    share a doc_id are judged each by its text. A null doc_id never stays where another doc_id
    does. Very long texts are compared whole. An empty table gives an empty result; other columns
    take no part.

    Each row finds its entry by the digest that the owner task gave the text on the key's chain.
    """
    spark = docs.sparkSession
    keyed = cut(keys(docs))
    index = build_index(docs, keyed, bucket_bytes, folder).entries(spark)
    joined = join_sized(keyed.select("doc_id", "text_sha256"), index.select("text_sha256", "keep_id", "group_size"), "text_sha256", "group_size", keyed.count(), F.xxhash64("doc_id"))
    kept = F.col("doc_id").eqNullSafe(F.col("keep_id"))
    return joined.select("doc_id", "keep_id", "group_size", kept.alias("kept"), "text_sha256")
