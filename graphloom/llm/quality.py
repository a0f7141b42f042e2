"""Quality classifier: regularised quadratic discriminant over transformed document statistics."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, held_out_third, whole_text

N_FEATURES = 17
_LOWER = np.arange(97, 123)
_UPPER = np.arange(65, 91)
_DIGIT = np.arange(48, 58)
_ODD = np.frombuffer(b"#$%&*|<>{}[]~^_=+\\@", np.uint8)
_PUNCT = np.frombuffer(b"!\"'(),-./:;?`", np.uint8)
_ENDS = np.frombuffer(b".!?", np.uint8)


def statistics(text: bytes) -> list[float]:
    """The transformed statistics of a whole text; zeros for an empty one."""
    words = text.split()
    n, size = len(words), len(text)
    if not n:
        return [0.0] * N_FEATURES
    hist = np.bincount(np.frombuffer(text, np.uint8), minlength=256)
    lower, upper, digit, odd, punct, ends = (int(hist[k].sum()) for k in (_LOWER, _UPPER, _DIGIT, _ODD, _PUNCT, _ENDS))
    letters = lower + upper
    lengths = np.fromiter(map(len, words), np.int64, n)
    counts = Counter(words)
    triples = len(set(zip(words, words[1:], words[2:], strict=False))) if n > 2 else 0
    lines = [x for x in text.split(b"\n") if x.strip()]
    p = hist[hist > 0] / size
    root = np.sqrt
    return [
        np.log1p(n), root(upper / max(1, letters)), root(odd / size), root(digit / size), root(punct / size), root(ends / n),
        np.log(lengths.mean()), lengths.std() / lengths.mean(), np.log(len(counts)) / np.log(n + 1), root(max(counts.values()) / n),
        1 - triples / max(1, n - 2) if n > 2 else 0.0, root(len(lines) / n), 1 - len(set(lines)) / max(1, len(lines)),
        -(p * np.log(p)).sum(), root((lengths <= 3).mean()), root(int(hist[10]) / size), root(int(hist[128:].sum()) / size),
    ]


def _measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        rows = [statistics(t or b"") for t in b.column(1).to_pylist()]
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array([list(map(float, r)) for r in rows], pa.list_(pa.float64()))], names=["doc_id", "stats"])


@dataclass
class Discriminant:
    mean: np.ndarray
    scale: np.ndarray
    centres: list[np.ndarray]
    factors: list[np.ndarray]  # inverse Cholesky factors, kept for all scoring
    constants: list[float]

    def score(self, x: np.ndarray) -> np.ndarray:
        """Probability of class 1 from the difference of Mahalanobis log densities.

        The statistics depend on each other, which makes the difference too sure of itself: a
        quarter of it keeps scores apart near 0 and 1. It does not move the threshold of 1/2.
        """
        z = (x - self.mean) / self.scale
        d = [c - 0.5 * (((z - m) @ f.T) ** 2).sum(1) for c, m, f in zip(self.constants, self.centres, self.factors, strict=True)]
        return 1 / (1 + np.exp(-np.clip((d[1] - d[0]) / 4, -40, 40)))


def fit(x: np.ndarray, y: np.ndarray, shrink: float = 0.1) -> Discriminant:
    """Class covariances shrunk towards the pooled diagonal. Without rows of both classes, score is 1/2."""
    p = x.shape[1]
    if len(y) == 0 or len(set(y.tolist())) < 2:
        eye = np.eye(p)
        return Discriminant(np.zeros(p), np.ones(p), [np.zeros(p)] * 2, [eye, eye], [0.0, 0.0])
    mean, scale = x.mean(0), x.std(0) + 1e-6
    z = (x - mean) / scale
    pooled = sum(np.cov(z[y == k].T, bias=True) * (y == k).mean() for k in (0, 1))
    target = np.diag(np.maximum(np.diag(pooled), 0.02))
    centres, factors, constants = [], [], []
    for k in (0, 1):
        own = z[y == k]
        a = max(shrink, min(1.0, p / max(1, len(own))))
        cov = (1 - a) * np.cov(own.T, bias=True) + a * target
        low = np.linalg.cholesky(cov)
        centres.append(own.mean(0))
        factors.append(np.linalg.inv(low))
        constants.append(float(-np.log(np.diag(low)).sum() + np.log((y == k).mean())))
    return Discriminant(mean, scale, centres, factors, constants)


def score_quality(docs: DataFrame, labels: DataFrame, sample: int = 6000, threshold: float = 0.5, seed: int = 7) -> DataFrame:
    """doc_id, held_out, score, predicted for every row.

    The discriminant is fitted on at most ``sample`` labelled rows (the first by a seeded hash)
    outside the held-out third; their statistics, not their texts, come to the driver. Null
    labels are ignored, a document with two labels enters the fit with both, a null text counts
    as empty, and repeated rows get equal scores. A very long text is measured whole, by one task.
    An empty table gives an empty result. Only the text enters a score; other columns take no
    part, and doc_id must be an integer (or a string of one).
    """
    src = docs.select(F.col("doc_id").cast("long").alias("doc_id"), whole_text().cast("binary").alias("text"))
    measured = cut(src.mapInArrow(_measure, "doc_id long, stats array<double>"))
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("y")).dropna().filter(~held_out_third(F.col("doc_id")))
    rows = measured.join(known, "doc_id").orderBy(F.xxhash64(F.lit(seed), "doc_id"), "y").limit(sample).collect()
    rows.sort(key=lambda r: (r.doc_id, r.y))
    x = np.array([r.stats for r in rows], float).reshape(len(rows), N_FEATURES)
    model = fit(x, np.array([r.y for r in rows], int))

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = b.column(1).flatten().to_numpy(zero_copy_only=False).reshape(-1, N_FEATURES)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(model.score(x))], names=["doc_id", "score"])

    out = measured.mapInArrow(judge, "doc_id long, score double")
    return out.select("doc_id", F.coalesce(held_out_third(F.col("doc_id")), F.lit(False)).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
