"""Stupid-backoff scores from n-gram count tables partitioned by hash.

Three relations, and the joins between them:

- exploded(block, n-gram, n): the n-grams of the documents of a block, with how often it has them;
- counts(n-gram, total): the sum of n by n-gram, partitioned by hash buckets;
- exploded join counts by n-gram, back in the block, and the sum of the log scores by document.

They are packed: a row of ``exploded`` holds the n-grams of a block in one bucket, as sorted
hashes and counts in binary columns, and a row of the join the totals in the same order. A
block has each n-gram once, so a frequent n-gram costs a bucket one entry per block and never a
row per occurrence.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import whole_text, word_count

_GOLD, _M1, _M2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
START = xxhash.xxh64_intdigest(b"\0start")


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


def hash_bits(grams: int) -> int:
    """24 bits more than tell ``grams`` n-grams apart: one shares its hash with another with a probability under 2**-24."""
    return max(32, min(64, grams.bit_length() + 24))


def exploded(texts: list[bytes], order: int, bits: int = 64) -> tuple[np.ndarray, list[np.ndarray], np.ndarray]:
    """For texts end to end, each led by a start mark: the n-gram hashes that end at each place, by
    length from 1 (0 where the text's start cuts them off), the text of each place, and which
    places are words."""
    seen: dict[bytes, int] = {}
    hashes, owner = [], []
    for i, t in enumerate(texts):
        words = t.split()
        if words:
            hashes.append(START)
            for w in words:
                h = seen.get(w)
                if h is None:
                    h = seen[w] = xxhash.xxh64_intdigest(w)
                hashes.append(h)
            owner.append((i, len(words) + 1))
    one = _mix(np.array(hashes, np.uint64) + _GOLD)
    doc = np.repeat(np.array([i for i, _ in owner], np.int64), [n for _, n in owner])
    first = np.concatenate([[True], doc[1:] != doc[:-1]]) if len(doc) else np.zeros(0, bool)
    grams, last = [one], one
    for k in range(2, order + 1):
        nxt = np.zeros_like(one)
        nxt[1:] = _mix(last[:-1] * _GOLD + one[1:] + np.uint64(k))
        near = np.arange(len(one)) - np.maximum.accumulate(np.where(first, np.arange(len(one)), 0)) if len(one) else np.zeros(0, int)
        nxt[near < k - 1] = 0
        last = nxt
        grams.append(nxt)
    cut = np.uint64(64 - bits)
    return doc, [np.where(g != 0, np.maximum(g >> cut, np.uint64(1)), g) for g in grams], ~first


def _planes(x: np.ndarray) -> bytes:
    """Integers byte plane by byte plane: the zeros of small numbers lie together and compress."""
    return x.view(np.uint8).reshape(len(x), x.itemsize).T.tobytes()


def _numbers(x: bytes, kind: type) -> np.ndarray:
    width = np.dtype(kind).itemsize
    return np.ascontiguousarray(np.frombuffer(x, np.uint8).reshape(width, -1).T).view(kind).ravel()


def _steps(x: np.ndarray) -> np.ndarray:
    return np.concatenate([x[:1], np.diff(x)])


def _buckets(sorted_grams: np.ndarray, buckets: int, bits: int) -> np.ndarray:
    """Where each bucket begins in the sorted n-grams; buckets are equal ranges of hashes."""
    edges = np.array([(b << bits) // buckets for b in range(1, buckets)], np.uint64)
    return np.concatenate([[0], np.searchsorted(sorted_grams, edges), [len(sorted_grams)]])


def _texts(table: pa.Table) -> list[bytes]:
    return [zlib.decompress(t) for t in table.column("text").to_pylist()]


def _small(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts compressed, as they are shuffled."""
    for b in batches:
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array([zlib.compress(t, 1) for t in b.column(1).to_pylist()], pa.binary()), b.column(2)], names=["doc_id", "text", "blk"])


def _packer(order: int, buckets: int, bits: int):
    def pack(key: tuple, table: pa.Table) -> pa.Table:
        _, grams, _ = exploded(_texts(table), order, bits)
        flat = np.concatenate(grams)
        own, n = np.unique(flat[flat != 0], return_counts=True)
        at = _buckets(own, buckets, bits)
        some = [b for b in range(buckets) if at[b] < at[b + 1]]
        return pa.table({
            "bucket": pa.array(some, pa.int32()), "blk": pa.array([key[0].as_py()] * len(some), pa.int32()),
            "grams": pa.array([_planes(_steps(own[at[b] : at[b + 1]])) for b in some], pa.binary()),
            "n": pa.array([_planes(n[at[b] : at[b + 1]].astype(np.uint32)) for b in some], pa.binary()),
        })

    return pack


def _total(key: tuple, table: pa.Table) -> pa.Table:
    """Sums the counts of a bucket and gives each block the totals of its n-grams, in its order."""
    grams = [np.cumsum(_numbers(x, np.uint64), dtype=np.uint64) for x in table.column("grams").to_pylist()]
    counts = np.concatenate([_numbers(x, np.uint32) for x in table.column("n").to_pylist()])
    _, at = np.unique(np.concatenate(grams), return_inverse=True)
    sums = np.bincount(at, counts).astype(np.int64)[at]
    ends = np.cumsum([len(g) for g in grams])
    parts = [_planes(s) for s in np.split(sums, ends[:-1])]
    return pa.table({"blk": table.column("blk"), "bucket": table.column("bucket"), "totals": pa.array(parts, pa.binary())})


def _scorer(order: int, alpha: float, corpus: int, bits: int):
    def score(key: tuple, docs: pa.Table, totals: pa.Table) -> pa.Table:
        texts = _texts(docs)
        doc, grams, word = exploded(texts, order, bits)
        flat = np.concatenate(grams)
        own, at = np.unique(flat, return_inverse=True)
        rows = sorted(zip(totals.column("bucket").to_pylist(), totals.column("totals").to_pylist(), strict=True))
        found = np.concatenate([np.zeros(0, np.int64), *(_numbers(x, np.int64) for _, x in rows)])
        if len(own) and own[0] == 0:
            found = np.concatenate([[0], found])
        if len(found) != len(own):
            raise RuntimeError("a block's n-grams and totals differ")
        at = at.reshape(order, -1)
        del flat
        rest = np.zeros((order, len(doc)), np.int64)
        for k in range(order):  # without the document's own occurrences; a length at a time bounds what is held
            _, inverse, mine = np.unique(doc * max(1, len(own)) + at[k], return_inverse=True, return_counts=True)
            rest[k] = np.where(grams[k] != 0, found[at[k]] - mine[inverse], 0)
        n = np.bincount(doc[word], minlength=len(texts)) if len(doc) else np.zeros(len(texts), np.int64)
        outside = np.maximum(1, corpus - n)
        logs = np.log(np.maximum(rest[0], 0.5) / outside[doc]) + (order - 1) * math.log(alpha)
        level = np.ones(len(doc), np.int64)
        for k in range(2, order + 1):
            den = np.concatenate([[0], rest[k - 2][:-1]]) if len(doc) else rest[k - 2]
            hit = (rest[k - 1] > 0) & (den > 0)
            logs = np.where(hit, np.log(np.maximum(rest[k - 1], 1) / np.maximum(den, 1)) + (order - k) * math.log(alpha), logs)
            level = np.where(hit, k, level)
        total = np.bincount(doc[word], logs[word], len(texts)) if len(doc) else np.zeros(len(texts))
        full = np.bincount(doc[word], level[word] == order, len(texts)) if len(doc) else np.zeros(len(texts))
        return pa.table({
            "doc_id": docs.column("doc_id"), "n_words": pa.array(n.astype(np.int64)), "n_full": pa.array(full.astype(np.int64)),
            "log_score": pa.array(total, pa.float64()), "mean_log_score": pa.array(np.where(n > 0, total / np.maximum(1, n), np.nan), pa.float64(), from_pandas=True),
        })

    return score


def lm_scores(docs: DataFrame, order: int = 3, alpha: float = 0.4, block_bytes: int = 6 << 20, seed: int = 13) -> DataFrame:
    """doc_id, n_words, n_full, log_score and mean_log_score for every row.

    Every n-gram up to ``order`` of the whole corpus is counted. A word's score is
    count(n-gram) / count(context) without the document's own occurrences, for the longest
    n-gram that other documents have, times ``alpha`` for each step down; a word found nowhere
    else counts as half an occurrence. n_full words were scored at the full order. Words are
    runs of non-space bytes; a start mark leads each text. A text without words (or null) has
    0 words, a sum of 0 and no mean. Copies and repeated rows count for each other. A very long
    text lies in one block, whose size it then sets. An empty table gives an empty result; other
    columns take no part. doc_id must be an integer (or a string of one).

    Hashes have ``hash_bits`` bits, so that they grow with the corpus. Blocks hold about
    ``block_bytes`` bytes of text, and buckets, as many as blocks, about the n-grams of one. A
    block has a row for each bucket that it has n-grams in: as the corpus grows, rows get shorter
    until each has one n-gram, and are never more than the n-grams of the blocks.
    """
    spark = docs.sparkSession
    text = whole_text()
    size, corpus = docs.agg(F.coalesce(F.sum(F.octet_length(text)), F.lit(0)), F.coalesce(F.sum(word_count(text)), F.lit(0))).first()
    blocks = max(1, -(-size // block_bytes))
    bits = hash_bits(corpus * order)
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-blocks // 2))
    blk = F.pmod(F.xxhash64(F.lit(seed), F.col("doc_id"), F.xxhash64(text)), F.lit(blocks)).cast("int")
    small = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.cast("binary").alias("text"), blk.alias("blk")).mapInArrow(_small, "doc_id long, text binary, blk int")
    dealt = small.repartition(parts, "blk")
    grams = dealt.groupBy("blk").applyInArrow(_packer(order, blocks, bits), "bucket int, blk int, grams binary, n binary")
    totals = grams.groupBy("bucket").applyInArrow(_total, "blk int, bucket int, totals binary")
    return dealt.groupBy("blk").cogroup(totals.groupBy("blk")).applyInArrow(_scorer(order, alpha, corpus, bits), "doc_id long, n_words long, n_full long, log_score double, mean_log_score double")
