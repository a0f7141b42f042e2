"""Toxicity: a bidirectional gated recurrent network with attention pooling, trained in numpy.

A token's input joins a hashed word embedding with the maximum of its hashed character n-gram
embeddings. The network scores all overlapping windows of a text; a small logistic layer over
the windows' greatest and mean logits gives the document's score.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import held_out_third, lean, release, whole_text

WINDOW, STRIDE = 64, 48
PIECE = 24  # bytes of a token; longer words are several tokens
GRAMS = (3, 6)
WORD_BITS, GRAM_BITS = 17, 18
STEPS = 90  # weight updates that a small sample gets by further epochs
LEAST = 5  # training texts with a slot, else it stays 0 and is not trained
DW = DC = 6
H = 8
A = 8
_TRIM = b".,;:!?\"'()"


def pieces(word: bytes) -> list[bytes]:
    """The tokens of a lower-cased word: without marks at its ends, long ones in pieces."""
    word = word.strip(_TRIM) or word
    return [word[i : i + PIECE] for i in range(0, len(word), PIECE)]


class Vocabulary(dict):
    """Numbers for words as they are met; a word of several tokens has a negative number."""

    def __init__(self):
        super().__init__()
        self.types: dict[bytes, int] = {}
        self.long: list[list[int]] = [[]]

    def __missing__(self, word: bytes) -> int:
        types = self.types
        own = [types.setdefault(p, len(types)) for p in pieces(word)]
        if len(own) == 1:
            self[word] = own[0]
        else:
            self[word] = -len(self.long)
            self.long.append(own)
        return self[word]

    def read(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Token numbers of the texts end to end, and each text's number of tokens."""
        runs = [np.array([self[w] for w in t.lower().encode().split()], np.int64) for t in texts]
        lengths = np.fromiter(map(len, runs), np.int64, len(runs))
        ids = np.concatenate([np.zeros(0, np.int64), *runs])
        at = np.flatnonzero(ids < 0)
        if len(at):
            many = np.ones(len(ids), np.int64)
            many[at] = [len(self.long[-i]) for i in ids[at].tolist()]
            ends = np.concatenate([[0], np.cumsum(many)])
            bounds = np.concatenate([[0], np.cumsum(lengths)])
            lengths = np.diff(ends[bounds])
            wide = np.repeat(ids, many)
            for i in at.tolist():
                wide[ends[i] : ends[i + 1]] = self.long[-ids[i]]
            ids = wide
        return ids, lengths


def hashed(types: list[bytes], most: int = 2000) -> tuple[np.ndarray, np.ndarray]:
    """Word slots, and n-gram slots (-1: none) of each token; ^ and $ mark its ends. ``most`` tokens at a time."""
    if len(types) > most:
        word, grams = zip(*(hashed(types[i : i + most]) for i in range(0, len(types), most)), strict=True)
        return np.concatenate(word), np.concatenate(grams)
    word = np.fromiter((xxhash.xxh32_intdigest(t) & ((1 << WORD_BITS) - 1) for t in types), np.int64, len(types))
    width = PIECE + 2
    raw = np.frombuffer(b"".join((b"^" + t + b"$").ljust(width, b"\0") for t in types), np.uint8).reshape(-1, width).astype(np.uint32)
    parts = []
    for n in GRAMS:
        h = np.full((len(types), width - n + 1), 2166136261 + n, np.uint32)
        for k in range(n):
            h = (h ^ raw[:, k : width - n + 1 + k]) * np.uint32(16777619)
        h ^= h >> np.uint32(15)
        slot = (h & np.uint32((1 << GRAM_BITS) - 1)).astype(np.int32)
        slot[raw[:, n - 1 :] == 0] = -1
        parts.append(slot)
    return word, np.concatenate(parts, 1)


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * np.tanh(0.5 * x) + 0.5


@dataclass
class Network:
    p: dict[str, np.ndarray] = field(default_factory=dict)
    head: np.ndarray = field(default_factory=lambda: np.array([0.5, 0.5, 0.0, 0.0]))

    @staticmethod
    def start(seed: int = 1) -> Network:
        r = np.random.default_rng(seed)
        g = lambda *s, k=0.3: (r.standard_normal(s) * k).astype(np.float32)
        d = DW + DC
        return Network({"word": g(1 << WORD_BITS, DW, k=0.05), "gram": g((1 << GRAM_BITS) + 1, DC, k=0.05), "wx": g(2, d, 3 * H), "wh": g(2, H, 3 * H), "b": np.zeros((2, 1, 3 * H), np.float32), "wa": g(2 * H, A), "ba": np.zeros(A, np.float32), "va": g(A), "wo": g(2 * H), "bo": np.zeros(1, np.float32)})

    def inputs(self, word: np.ndarray, grams: np.ndarray, most: int = 2000) -> np.ndarray:
        """The inputs of many token types, ``most`` at a time."""
        parts = [self.vectors(word[i : i + most], grams[i : i + most])[0] for i in range(0, len(word), most)]
        return np.concatenate([np.zeros((0, DW + DC), np.float32), *parts])

    def vectors(self, word: np.ndarray, grams: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The inputs of token types, and which n-gram gave each maximum."""
        g = self.p["gram"][grams]  # -1 is the last row, kept far below
        top = g.argmax(1)
        return np.concatenate([self.p["word"][word], np.take_along_axis(g, top[:, None], 1)[:, 0]], 1), top

    def forward(self, x: np.ndarray, ids: np.ndarray, mask: np.ndarray, keep: bool = False) -> tuple:
        """x: vectors of types; ids and mask: windows x positions. Logits, and what backward needs."""
        p, (n, steps) = self.p, ids.shape
        proj = np.matmul(x, p["wx"]) + p["b"]  # 2, types, 3H
        both = np.stack([ids, ids[:, ::-1]])
        on = np.stack([mask, mask[:, ::-1]])[..., None]
        h = np.zeros((2, n, H), np.float32)
        states = np.empty((2, steps, n, H), np.float32)
        saved = []
        for t in range(steps):
            a = np.stack([proj[0][both[0, :, t]], proj[1][both[1, :, t]]])
            u = np.matmul(h, p["wh"])
            zr = _sigmoid(a[..., : 2 * H] + u[..., : 2 * H])
            z, r = zr[..., :H], zr[..., H:]
            c = np.tanh(a[..., 2 * H :] + r * u[..., 2 * H :])
            new = c + z * (h - c)
            m = on[:, :, t]
            if keep:
                saved.append((h, u, z, r, c, m))
            h = np.where(m, new, h)
            states[:, t] = h
        seq = np.concatenate([states[0], states[1, ::-1]], 2)  # steps, n, 2H
        e = np.tanh(seq @ p["wa"] + p["ba"])
        s = np.where(mask.T, e @ p["va"], -1e9)
        w = np.exp(s - s.max(0))
        w /= w.sum(0)
        pooled = (w[..., None] * seq).sum(0)
        return pooled @ p["wo"] + p["bo"][0], (x, both, on, saved, seq, e, w, pooled)

    def backward(self, grad: np.ndarray, kept: tuple) -> tuple[dict, np.ndarray]:
        """Gradients of the weights and of the types' vectors, for the logits' gradient."""
        p = self.p
        x, both, on, saved, seq, e, w, pooled = kept
        out = {"wo": pooled.T @ grad, "bo": np.array([grad.sum()], np.float32)}
        dp = grad[:, None] * p["wo"]
        dw = (seq * dp).sum(2)
        ds = w * (dw - (w * dw).sum(0))
        de = ds[..., None] * p["va"] * (1 - e * e)
        out["va"] = (e * ds[..., None]).sum((0, 1))
        out["wa"] = np.tensordot(seq, de, ((0, 1), (0, 1)))
        out["ba"] = de.sum((0, 1))
        dseq = w[..., None] * dp + de @ p["wa"].T
        dstates = np.stack([dseq[..., :H], dseq[::-1, :, H:]])
        dproj = np.zeros((2, len(x), 3 * H), np.float32)
        dwh = np.zeros_like(p["wh"])
        dh = np.zeros_like(dstates[:, 0])
        for t in range(len(saved) - 1, -1, -1):
            h, u, z, r, c, m = saved[t]
            dh = dh + dstates[:, t]
            dn = np.where(m, dh, 0)
            dc = dn * (1 - z) * (1 - c * c)
            dz = dn * (h - c) * z * (1 - z)
            dr = dc * u[..., 2 * H :] * r * (1 - r)
            da = np.concatenate([dz, dr, dc], 2)
            du = np.concatenate([dz, dr, dc * r], 2)
            dwh += np.matmul(h.transpose(0, 2, 1), du)
            for k in (0, 1):
                np.add.at(dproj[k], both[k, :, t], da[k])
            dh = np.where(m, dn * z, dh) + np.matmul(du, p["wh"].transpose(0, 2, 1))
        out["wh"], out["b"] = dwh, dproj.sum(1, keepdims=True)
        out["wx"] = np.matmul(x.T, dproj)
        return out, np.matmul(dproj, p["wx"].transpose(0, 2, 1)).sum(0)


def windows(lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, length and document of all overlapping windows of texts laid end to end."""
    lengths = np.asarray(lengths, np.int64)
    many = np.where(lengths > 0, np.maximum(1, -(-(lengths - (WINDOW - STRIDE)) // STRIDE)), 0)
    doc = np.repeat(np.arange(len(lengths)), many)
    inner = (np.arange(len(doc)) - np.repeat(np.cumsum(many) - many, many)) * STRIDE
    return (np.cumsum(lengths) - lengths)[doc] + inner, np.minimum(WINDOW, lengths[doc] - inner), doc


def window_logits(net: Network, x: np.ndarray, ids: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Logit and document of all windows of texts laid end to end, from the inputs ``x`` of their token types."""
    start, size, doc = windows(lengths)
    out = np.empty(len(start), np.float32)
    order = np.argsort(size, kind="stable")
    for i in range(0, len(order), 1024):
        some = order[i : i + 1024]
        at = np.arange(int(size[some].max()))
        mask = at < size[some][:, None]
        picked = ids[np.minimum(start[some][:, None] + at, len(ids) - 1)]
        used, local = np.unique(picked, return_inverse=True)
        out[some] = net.forward(x[used], local.reshape(picked.shape), mask)[0]
    return out, doc


class Scorer:
    """Scores texts in groups of about ``budget`` bytes; keeps the vectors of known tokens."""

    def __init__(self, net: Network, budget: int = 1_500_000, known: int = 200_000):
        self.net, self.budget, self.known = net, budget, known
        self._clear()

    def _clear(self) -> None:
        self.words = Vocabulary()
        self.x = np.zeros((0, DW + DC), np.float32)

    def scores(self, texts: list[str]) -> np.ndarray:
        out, group, n = [], [], 0
        for t in texts:
            group.append(t)
            n += len(t)
            if n >= self.budget:
                out.append(self._group(group))
                group, n = [], 0
        if group:
            out.append(self._group(group))
        return np.concatenate(out) if out else np.zeros(0)

    def logits(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        if len(self.words) > self.known:
            self._clear()
        ids, lengths = self.words.read(texts)
        if len(self.words.types) > len(self.x):
            new = list(self.words.types)[len(self.x) :]
            self.x = np.concatenate([self.x, self.net.inputs(*hashed(new))])
        return window_logits(self.net, self.x, ids, lengths)

    def _group(self, texts: list[str]) -> np.ndarray:
        logit, doc = self.logits(texts)
        return _sigmoid(summaries(logit, doc, len(texts)) @ self.net.head)


def summaries(logit: np.ndarray, doc: np.ndarray, n: int) -> np.ndarray:
    """For each document: greatest and mean logit, log of the number of windows, and 1."""
    count = np.bincount(doc, minlength=n)
    top = np.full(n, -6.0)
    np.maximum.at(top, doc, logit)
    mean = np.where(count > 0, np.bincount(doc, logit, n) / np.maximum(1, count), -6.0)
    return np.stack([top, mean, np.log1p(count), np.ones(n)], 1)


def train(texts: list[str], y: np.ndarray, epochs: int = 3, batch: int = 128, per_text: int = 3, seed: int = 1) -> Network:
    """Trains on up to ``per_text`` windows of each text, then fits the document layer.

    A label holds for a text, not for each of its windows. So each epoch takes the strongest
    windows of a text by what is known so far, and for label 0 also one at random. The first dimension of each embedding starts from smoothed log odds of its slot.
    """
    net, r = Network.start(seed), np.random.default_rng(seed)
    net.p["gram"][-1] = -4
    if len(set(y.tolist())) < 2:
        net.head = np.array([0, 0, 0, -4.0 if not y.sum() else 4.0])
        return net
    vocabulary = Vocabulary()
    flat, lengths = vocabulary.read(texts)
    types = list(vocabulary.types)
    del vocabulary
    word, grams = hashed(types)
    del types
    seen = {"word": np.zeros((2, 1 << WORD_BITS)), "gram": np.zeros((2, (1 << GRAM_BITS) + 1))}
    for own, k in zip(np.split(flat, np.cumsum(lengths)[:-1]), y, strict=True):
        own = np.unique(own)
        seen["word"][k, np.unique(word[own])] += 1
        seen["gram"][k, np.unique(grams[own])] += 1
    total = np.array([(y == 0).sum(), (y == 1).sum()]) + 4.0
    cue, known = {}, {}
    for k in seen:
        odds = np.log((seen[k][1] + 2) / total[1]) - np.log((seen[k][0] + 2) / total[0])
        known[k] = (seen[k].sum(0) >= LEAST).astype(np.float32)
        cue[k] = np.clip(odds, -3, 3) * known[k]
        net.p[k] *= known[k][:, None]
        net.p[k][:, 0] += 0.5 * cue[k]
    net.p["gram"][-1] = -4
    start, size, doc = windows(lengths)
    cue["gram"][-1] = -4
    strength = np.concatenate([np.maximum(cue["word"][word[i : i + 5000]], cue["gram"][grams[i : i + 5000]].max(1)) for i in range(0, len(word), 5000)])
    sums = np.concatenate([[0], np.cumsum(np.maximum(0, strength[flat] - 1))])
    logit = sums[start + size] - sums[start]
    moment: dict[str, list] = {}
    step = 0

    def adam(key: str, rows, grad: np.ndarray, rate: float) -> None:
        m, v = moment.setdefault(key, [np.zeros_like(net.p[key]), np.zeros_like(net.p[key])])
        m[rows] = 0.9 * m[rows] + 0.1 * grad
        v[rows] = 0.99 * v[rows] + 0.01 * grad * grad
        net.p[key][rows] -= rate * (m[rows] / (1 - 0.9**step)) / (np.sqrt(v[rows] / (1 - 0.99**step)) + 1e-6)

    epochs = max(epochs, min(30, -(-STEPS // max(1, len(choose(logit, doc, y, per_text, r)) // batch))))
    for epoch in range(epochs):
        if epoch:
            logit, _ = window_logits(net, net.inputs(word, grams), flat, lengths)
        order = r.permutation(choose(logit, doc, y, per_text, r))
        for i in range(0, len(order), batch):
            some = order[i : i + batch]
            step += 1
            at = np.arange(int(size[some].max()))
            mask = at < size[some][:, None]
            picked = flat[np.minimum(start[some][:, None] + at, len(flat) - 1)]
            used, local = np.unique(picked, return_inverse=True)
            x, top = net.vectors(word[used], grams[used])
            logit, kept = net.forward(x, local.reshape(picked.shape), mask, keep=True)
            want = y[doc[some]]
            grads, dx = net.backward(((_sigmoid(logit) - want) / len(some)).astype(np.float32), kept)
            for k, g in grads.items():
                adam(k, slice(None), np.clip(g, -1, 1), 0.01)
            wu, wi = np.unique(word[used], return_inverse=True)
            gw = np.zeros((len(wu), DW), np.float32)
            np.add.at(gw, wi, dx[:, :DW])
            adam("word", wu, gw * known["word"][wu, None], 0.003)
            hit = np.take_along_axis(grams[used], top, 1)
            slot, gi = np.unique(hit, return_inverse=True)
            gg = np.zeros((len(slot), DC), np.float32)
            gi = gi.reshape(hit.shape)
            for c in range(DC):
                np.add.at(gg[:, c], gi[:, c], dx[:, DW + c])
            adam("gram", slot, gg * known["gram"][slot, None], 0.003)
            net.p["gram"][-1] = -4
    logit, docs = window_logits(net, net.inputs(word, grams), flat, lengths)
    net.head = logistic(summaries(logit, docs, len(texts)), y)
    return net


def choose(logit: np.ndarray, doc: np.ndarray, y: np.ndarray, per_text: int, r: np.random.Generator) -> np.ndarray:
    """The windows of an epoch: the strongest ``per_text`` of each text; the last of them at random for label 0."""
    order = np.lexsort((-logit, doc))
    rank = np.arange(len(order)) - np.searchsorted(doc[order], doc[order])
    keep = order[rank < np.where(y[doc[order]] == 1, max(1, per_text - 1), per_text - 1)]
    extra = r.permutation(len(doc))
    _, one = np.unique(doc[extra], return_index=True)
    return np.unique(np.concatenate([keep, extra[one][y[doc[extra[one]]] == 0]]))


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 0.02) -> np.ndarray:
    """Newton steps of a ridge logistic regression."""
    w = np.zeros(x.shape[1])
    for _ in range(30):
        q = _sigmoid(x @ w)
        g = x.T @ (q - y) / len(y) + ridge * w * [1, 1, 1, 0]
        hess = (x * (q * (1 - q))[:, None]).T @ x / len(y) + ridge * np.diag([1, 1, 1, 1e-3])
        w = w - np.linalg.solve(hess, g)
    return w


#: Passages of EXCERPT words that a training text may have; a longer one is trained on so many of them.
EXCERPT, PASSAGES = 64, 200


def excerpt(text: str, seed: int) -> str:
    """The whole text up to ``PASSAGES`` passages; of a longer one, as many passages drawn from all of it."""
    words = text.split()
    n = -(-len(words) // EXCERPT)
    if n <= PASSAGES:
        return text
    rng = np.random.default_rng([seed, xxhash.xxh32_intdigest(text)])
    some = np.sort(rng.choice(n, PASSAGES, replace=False)).tolist()
    return "\n".join(" ".join(words[i * EXCERPT : (i + 1) * EXCERPT]) for i in some)


def fit_toxicity(docs: DataFrame, labels: DataFrame, per_class: int = 1000, seed: int = 7) -> Network:
    """Trains on at most ``per_class`` labelled rows of each class outside the held-out third.

    The rows are the first by a seeded hash, whatever their length. What comes to the driver is
    their texts, of very long ones the passages of ``excerpt`` (12,800 words), which bounds it.
    Null labels are ignored; a document with two labels is trained on with both.
    """
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("y")).dropna().filter(~held_out_third(F.col("doc_id"))).distinct()
    by = [F.xxhash64(F.lit(seed), "doc_id"), F.col("doc_id")]
    ids = known.filter("y = 1").orderBy(*by).limit(per_class).unionByName(known.filter("y = 0").orderBy(*by).limit(per_class))

    def cut_down(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([excerpt(t, seed) for t in b.column(2).to_pylist()], pa.string())], names=["doc_id", "y", "text"])

    found = docs.select(F.col("doc_id").cast("long").alias("doc_id"), whole_text().alias("text")).join(F.broadcast(ids), "doc_id")
    rows = found.select("doc_id", "y", "text").mapInArrow(lean(cut_down), "doc_id long, y int, text string").distinct().collect()
    rows.sort(key=lambda r: (r.doc_id, r.y, r.text))
    net = train([r.text for r in rows], np.array([r.y for r in rows], int))
    # the driver's Python would keep what training freed beside the stages that follow
    del rows
    release()
    return net


def score_toxicity(docs: DataFrame, net: Network, out: str = "score") -> DataFrame:
    """Adds the score of each whole text; all other columns stay as they are.

    A null text counts as empty; a text without words has no window and gets the document
    layer's value for none. Repeated rows get equal scores, and a very long text is scored by all
    of its windows. An empty table gives an empty result. ``out`` must be no column of ``docs``.
    """
    shared = docs.sparkSession.sparkContext.broadcast((net.p, net.head))  # a few MB, by the constants above

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(Network(*shared.value))
        for b in batches:
            at = b.schema.get_field_index("text")
            s = scorer.scores([t or "" for t in b.column(at).to_pylist()])
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(s, pa.float64())], names=[*b.schema.names, out])

    fields = T.StructType([*docs.schema.fields, T.StructField(out, T.DoubleType())])
    return docs.mapInArrow(lean(judge), fields)


def toxicity(docs: DataFrame, labels: DataFrame, threshold: float = 0.7) -> DataFrame:
    """doc_id, held_out, score, predicted for every row of ``docs``; other columns take no part.

    doc_id must be an integer (or a string of one); a null one is not held out.
    """
    net = fit_toxicity(docs, labels)
    scored = score_toxicity(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), net)
    return scored.select("doc_id", F.coalesce(held_out_third(F.col("doc_id")), F.lit(False)).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
