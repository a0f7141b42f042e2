"""The corpus pipeline: toxicity, exact dedup, near-dedup, mixing to target weights, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and
read again as the next stage's docs. All but the last keep the columns of documents.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable
from functools import wraps

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.llm.common import documents, fresh, labels, release, shared_folder, whole_text
from graphloom.llm.exact_dedup import exact_dedup, normalised
from graphloom.llm.mixing import mix, mixed_documents
from graphloom.llm.near_dedup import near_dedup
from graphloom.llm.packing import pack
from graphloom.llm.toxicity import fit_toxicity, score_toxicity


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score 0.7 or more go; all other rows stay as they are, repeated ones too.

    A null or empty text is scored like any other, and a very long one by all of its windows. An
    empty table gives an empty result, and without labels of both kinds all rows get one score.
    """
    net = fit_toxicity(docs, labels(spark, sf_dir))
    score = fresh(docs.columns, "toxicity")
    return score_toxicity(docs, net, score).filter(F.col(score) < 0.7).drop(score)


def _row(text: Column) -> list[Column]:
    """Two keys that tell rows of one doc_id apart by a hash of their text."""
    return [F.xxhash64(F.col("doc_id").isNull(), F.col("doc_id").cast("long")), text]


def _only(docs: DataFrame, text: Column, kept: DataFrame) -> DataFrame:
    """One row of ``docs`` for each row key (two longs) that ``kept`` has; equal ones are combined before the shuffle."""
    k0, k1 = fresh(docs.columns, "k0"), fresh(docs.columns, "k1")
    a, b = _row(text)
    one = docs.withColumns({k0: a, k1: b}).dropDuplicates([k0, k1])
    return one.join(kept.toDF(k0, k1).distinct().hint("merge"), [k0, k1], "left_semi").select(*docs.columns)


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each text stays, of those with its smallest doc_id.

    Rows that share a doc_id are told apart by their text. Null and empty texts are one group. Of
    repeated rows, which may differ in other columns, any one stays. An empty table stays empty.
    """
    digest = exact_dedup(docs.select("doc_id", "text")).filter("kept")
    # the owner tasks compared the bytes; their digests lead back to the rows
    return _only(docs, F.xxhash64(F.sha2(normalised(), 256)), digest.select(*_row(F.xxhash64("text_sha256"))))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near copies stays: of those with its smallest doc_id, the first by its text's hash.

    Texts without words are in no group and stay, one for each doc_id and text; so do rows that
    share a doc_id but are no near copies. Shingles have five words. An empty table stays empty.
    """
    judged = near_dedup(docs.select("doc_id", "text")).filter("kept")
    a, b = _row(F.col("text_key"))
    first = judged.filter("group is not null").groupBy("group").agg(F.min(F.struct(b.alias("k1"), a.alias("k0"))).alias("o")).select("o.k0", "o.k1")
    return _only(docs, F.xxhash64(whole_text()), first.unionByName(judged.filter("group is null").select(a.alias("k0"), b.alias("k1"))))


def mix_to_weights(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix as documents: up to two rows of a document, with the words that a pass takes of it.

    Documents without words leave, as the mix has none of them. Null sources form one source, and
    repeated rows each have their own words. An empty table stays empty.
    """
    return mixed_documents(docs, mix(docs.select("doc_id", "source", "text")))


def pack_batches(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every row's bucket, batch and place. Rows without words go to the first bucket; an empty table gives an empty result."""
    return pack(docs)


def _lean(stage: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
    """The stage, begun with the driver's memory that the stage before, written meanwhile, has left."""

    @wraps(stage)
    def begin(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        release(spark)
        return stage(spark, docs, sf_dir)

    return begin


STAGES = [("toxicity", _lean(drop_toxic)), ("exact dedup", _lean(drop_copies)), ("near-dedup", _lean(drop_near_copies)), ("mixing", _lean(mix_to_weights)), ("packing", _lean(pack_batches))]

#: A trained network and seeded draws have no SQL form; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    folder = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    for k, (_, stage) in enumerate(STAGES):
        out = stage(spark, docs, sf_dir)
        if k == len(STAGES) - 1:
            return out
        out.write.parquet(f"{folder}/{k}")
        docs = spark.read.parquet(f"{folder}/{k}")
    return docs
