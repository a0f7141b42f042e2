"""Connected components by union-find per partition and alternating star contractions."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, hot_keys, join_salted


def _forest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Union-find over a partition's links: each node with the smallest node of its set."""
    parent: dict[int, int] = {}

    def find(x: int) -> int:
        root = x
        while parent[root] != root:
            root = parent[root]
        while parent[x] != root:
            parent[x], x = root, parent[x]
        return root

    for b in batches:
        for u, v in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
            parent.setdefault(u, u)
            parent.setdefault(v, v)
            a, c = find(u), find(v)
            if a != c:
                parent[max(a, c)] = min(a, c)
    pairs = [(x, find(x)) for x in parent]
    pairs = [(x, r) for x, r in pairs if x != r]
    yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in pairs], pa.int64()), pa.array([r for _, r in pairs], pa.int64())], names=["u", "v"])


def _large(links: DataFrame) -> DataFrame:
    both = links.unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n")).withColumn("m", F.least("m", "u"))
    hot = hot_keys(least, "u", "n", 2 * links.count())  # a hub's links are dealt over tasks
    return join_salted(both.filter("v > u"), least.drop("n"), "u", hot, F.xxhash64("v")).select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()


def _small(links: DataFrame) -> DataFrame:
    down = links.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = down.groupBy("u").agg(F.min("v").alias("m"))
    own = down.join(least, "u")
    return own.filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v"))).distinct()


def components(links: DataFrame, most: int = 60, links_per_task: int = 500_000) -> DataFrame:
    """node, component (its smallest node) for all nodes of ``links`` (u, v: long), which are read again and so should be cheap to read.

    Each task joins up to about ``links_per_task`` links by union-find. Where that takes several
    tasks, rounds of stars follow, each of which makes every node point to smaller ones; the links
    end as stars about each component's smallest node. Only sums and numbers come to the driver.
    """
    links = links.select("u", "v")
    tasks = max(1, -(-links.count() // links_per_task))
    now = cut(links.coalesce(tasks).mapInArrow(_forest, "u long, v long"))
    mark = None
    for _ in range(most if tasks > 1 else 0):
        now = cut(_small(_large(now)))
        new = tuple(now.agg(F.count("*"), F.coalesce(F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")), F.lit(0))).first())
        if new == mark:
            break
        mark = new
    else:
        if tasks > 1:
            raise RuntimeError(f"components did not settle in {most} rounds")
    roots = now.select(F.col("v").alias("node")).distinct()
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots.select("node", F.col("node").alias("component")))
