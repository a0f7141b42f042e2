"""Packing into optimal length buckets and token-budget batches."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, running_offset, whole_text, word_count


def boundaries(hist: list[tuple[int, int]], buckets: int) -> list[int]:
    """Upper lengths of at most ``buckets`` buckets that minimise total padding.

    ``hist`` has (length, rows) for every length, in order. Dynamic programming: best[j] is the
    least padding of the lengths up to j. The last cut of an optimum moves right with j, so each
    layer halves: the middle length's cut bounds those of the lengths on both its sides. A layer
    takes n log n steps over n lengths.
    """
    n = len(hist)
    if not n:
        return []
    top = np.array([h[0] for h in hist], float)
    rows = np.concatenate([[0], np.cumsum([h[1] for h in hist], dtype=float)])
    best = rows[1:] * top  # one bucket; the sum of true lengths is a constant
    layers: list[np.ndarray] = []
    for _ in range(1, min(buckets, n)):
        new, at = best.copy(), np.full(n, -1)
        todo = [(1, n - 1, 0, n - 2)]
        while todo:
            a, b, lo, hi = todo.pop()
            if a > b:
                continue
            j = (a + b) // 2
            end = min(hi, j - 1)
            cost = best[lo : end + 1] + (rows[j + 1] - rows[lo + 1 : end + 2]) * top[j]
            i = lo + int(cost.argmin())
            if cost[i - lo] < new[j]:
                new[j], at[j] = cost[i - lo], i
            todo += [(a, j - 1, lo, i), (j + 1, b, i, hi)]
        best = new
        layers.append(at)
    out, j = [], n - 1
    for at in reversed(layers):
        if at[j] >= 0:
            out.append(int(top[j]))
            j = int(at[j])
    return [*reversed([*out, int(top[j])])]


def pack(docs: DataFrame, buckets: int = 16, token_budget: int = 16_384, tokens: Column | None = None, seed: int = 3) -> DataFrame:
    """Adds n_tokens, bucket, boundary, batch, place and padding to every row.

    The global histogram of lengths (words unless ``tokens`` says otherwise) has one row for each
    length that occurs, so with n rows the corpus has n * n / 2 words at least; the DP over it
    puts the boundaries where total padding is least. A batch of a bucket holds
    floor(token_budget / boundary) rows, one at least, each padded to the boundary: a row longer
    than the budget is a batch by itself, never cut. Batches are gapless in a bucket and only
    its last one may be short. Empty and null texts have length 0 and go to the first bucket
    (with a boundary of 0, a batch holds ``token_budget`` rows). Repeated rows are packed each.
    An empty table gives an empty result, and other columns of ``docs`` take no part.
    """
    spark = docs.sparkSession
    n = word_count(whole_text()) if tokens is None else tokens
    sized = docs.select("doc_id", F.xxhash64(whole_text()).alias("text_key"), n.alias("n_tokens"))
    sized = cut(sized)
    hist = [(r[0], r[1]) for r in sized.groupBy("n_tokens").agg(F.count("*")).orderBy("n_tokens").collect()]
    tops = boundaries(hist, buckets)
    rows = sum(h[1] for h in hist)
    bucket = F.lit(max(0, len(tops) - 1))
    for i in range(len(tops) - 2, -1, -1):
        bucket = F.when(F.col("n_tokens") <= tops[i], F.lit(i)).otherwise(bucket)
    table = F.array(*[F.lit(t).cast("long") for t in tops or [0]])
    sized = sized.withColumn("bucket", bucket.cast("int")).withColumn("boundary", F.get(table, F.col("bucket")))
    ranked = running_offset(sized, ["bucket"], [F.col("doc_id"), F.col("text_key")], F.lit(1), "at", rows, seed)
    per = F.greatest(F.lit(1), F.floor(F.lit(token_budget) / F.greatest(F.col("boundary"), F.lit(1)))).cast("long")
    out = ranked.withColumn("batch", F.floor(F.col("at") / per)).withColumn("place", (F.col("at") % per).cast("int"))
    return out.select("doc_id", "n_tokens", "bucket", "boundary", "batch", "place", (F.col("boundary") - F.col("n_tokens")).alias("padding"))
