"""Near-dedup: SuperMinHash signatures, banding, verification on full sets, union-find grouping."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, gathered, hot_keys, join_salted, join_sized, lean, release, whole_text
from .components import components

_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_GOLD = np.uint64(0x9E3779B97F4A7C15)


def _mix(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser, on whole arrays."""
    x = (x ^ (x >> np.uint64(30))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


class _Words(dict):
    def __missing__(self, word: bytes) -> int:
        h = self[word] = xxhash.xxh64_intdigest(word)
        return h


class Shingler:
    """Sets of hashed word shingles; keeps the hashes of known words."""

    def __init__(self, words: int, known: int = 300_000):
        self.words, self.known, self.hashes = words, known, _Words()

    def sets(self, texts: list[bytes]) -> list[np.ndarray]:
        """For each text its sorted distinct shingles; fewer words make one shingle, none make none."""
        if len(self.hashes) > self.known:
            self.hashes = _Words()
        out = []
        for t in texts:
            w = t.lower().split()
            n = len(w)
            if not n:
                out.append(np.zeros(0, np.uint64))
                continue
            h = np.fromiter(map(self.hashes.__getitem__, w), np.uint64, n)
            k = min(n, self.words)
            s = np.full(n - k + 1, k, np.uint64)
            for i in range(k):
                s = _mix(s * _GOLD + h[i : n - k + 1 + i])
            out.append(np.unique(s))
        return out


def superminhash(sets: list[np.ndarray], size: int, seed: int = 1) -> np.ndarray:
    """SuperMinHash signatures of non-empty sets, as an array of sets x ``size``.

    Element d has its own random permutation of the slots; round j offers rank j plus a uniform
    fraction to slot perm_d[j]. A slot that holds a value below j + 1 can't be improved in later
    rounds, so a set stops after the first round that leaves no open slot. All elements of all
    sets go through a round at once.
    """
    lengths = np.array([len(s) for s in sets])
    elements = np.concatenate(sets) if len(sets) else np.zeros(0, np.uint64)
    owner = np.repeat(np.arange(len(sets)), lengths)
    out = np.full(len(sets) * size, np.inf)
    perm = None
    for j in range(size):
        word = _mix(elements + np.uint64((int(_GOLD) * (2 * j + 1) + seed) & ((1 << 64) - 1)))
        rank = j + (word >> np.uint64(11)).astype(np.float64) * 2.0**-53
        pick = j + (_mix(word + _GOLD) % np.uint64(size - j)).astype(np.int64)
        if j == 0:
            slot, picked = pick, [pick]
        else:
            # the value at position ``pick`` after the swaps of earlier rounds
            if perm is None:
                perm = _first_swap(picked[0], size)
            rows = np.arange(len(elements))
            slot = perm[rows, pick].astype(np.int64)
            perm[rows, pick] = perm[:, j]
            perm[:, j] = slot
        np.minimum.at(out, owner * size + slot, rank)
        open_ = (out.reshape(-1, size) >= j + 1).any(1)
        if not open_.any():
            break
        keep = open_[owner]
        if perm is not None:
            perm = perm[keep]
        else:
            picked = [picked[0][keep]]
        elements, owner = elements[keep], owner[keep]
    return out.reshape(-1, size)


def _first_swap(pick: np.ndarray, size: int) -> np.ndarray:
    """Permutations after round 0's swap of positions 0 and ``pick``."""
    kind = np.uint8 if size <= 256 else np.uint16
    perm = np.tile(np.arange(size, dtype=kind), (len(pick), 1))
    perm[:, 0] = pick
    perm[np.arange(len(pick)), pick] = 0
    return perm


def _grouped(texts: list[bytes], most: int = 400_000) -> Iterator[tuple[int, int]]:
    """Runs of texts of about ``most`` bytes; a longer text is a run by itself."""
    start, n = 0, 0
    for i, t in enumerate(texts):
        if n and n + len(t) > most:
            yield start, i
            start, n = i, 0
        n += len(t)
    if start < len(texts):
        yield start, len(texts)


def _signer(words: int, bands: int, rows: int):
    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler = Shingler(words)
        for b in batches:
            ids, texts = b.column(0), b.column(1).to_pylist()
            for i, k in _grouped(texts):
                sets = shingler.sets(texts[i:k])
                some = [s for s in sets if len(s)]
                sig = superminhash(some, bands * rows)
                lanes = _mix(sig.view(np.uint64)).reshape(len(some), bands, rows)
                key = np.arange(1, bands + 1, dtype=np.uint64)[None, :] * _GOLD
                for r in range(rows):
                    key = _mix(key + lanes[:, :, r])
                keys, bytes_ = iter(key.view(np.int64)), iter((lanes.reshape(len(some), -1) & np.uint64(255)).astype(np.uint8))
                mark = [xxhash.xxh128_digest(s.tobytes()) if len(s) else None for s in sets]
                yield pa.RecordBatch.from_arrays([ids.slice(i, k - i), b.column(2).slice(i, k - i), pa.array([len(s) for s in sets], pa.int64()), pa.array(mark, pa.binary()), pa.array([next(keys) if len(s) else [] for s in sets], pa.list_(pa.int64())), pa.array([next(bytes_).tobytes() if len(s) else None for s in sets], pa.binary())], names=["doc_id", "text_key", "n_shingles", "mark", "bands", "lanes"])

    return sign


def _setter(words: int):
    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler = Shingler(words)
        for b in batches:
            ids, texts = b.column(0), b.column(1).to_pylist()
            for i, k in _grouped(texts):
                sets = shingler.sets(texts[i:k])
                mark = [xxhash.xxh128_hexdigest(s.tobytes()).upper() for s in sets]
                yield pa.RecordBatch.from_arrays([ids.slice(i, k - i), pa.array(mark), pa.array([s.view(np.int64) for s in sets], pa.list_(pa.int64()))], names=["doc_id", "mark", "shingles"])

    return make


def _likely(least: int):
    """Keeps the pairs whose signatures agree in ``least`` lanes or more."""

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x, y = (np.frombuffer(b"".join(b.column(i).to_pylist()), np.uint8).reshape(b.num_rows, -1) for i in (2, 3))
            good = pa.array((x == y).sum(1) >= least)
            yield pa.RecordBatch.from_arrays([b.column(0).filter(good), b.column(1).filter(good)], names=["u", "v"])

    return keep


#: Nodes up to this number (under 100 bytes each: 20 MB) may be broadcast; more are joined by a shuffle.
FEW_NODES = 200_000
#: Rows that a task reads of checkpoints of short rows, and of rows with a signature.
PAIRS, NODES = 200_000, 50_000


class Verifier:
    """Confirms pairs of nodes on their full sets."""

    def __init__(self, nodes: DataFrame, lanes: DataFrame, docs: DataFrame, words: int, percent: int, slots: int):
        """``nodes`` has node, doc_id and mark: the document that stands for it and its set's digest."""
        some = F.broadcast if nodes.count() <= FEW_NODES else lambda d: d
        texts = docs.join(some(nodes.select("doc_id").distinct()), "doc_id", "left_semi")
        sets = texts.select("doc_id", "text").mapInArrow(lean(_setter(words)), "doc_id long, mark string, shingles array<long>")
        self.sets = cut(sets.join(some(nodes), ["doc_id", "mark"]).select("node", "shingles").dropDuplicates(["node"]))
        self.lanes, self.percent = lanes, percent
        # five and a half standard deviations below the threshold: a linked pair falls out once in 10**7
        p = percent / 100
        self.least = int(slots * p - 5.5 * (slots * p * (1 - p)) ** 0.5)

    def __call__(self, pairs: DataFrame) -> DataFrame:
        """The pairs (u, v) with 100 * intersection >= percent * union. Unlikely ones leave by signature first.

        A leader ``u`` of very many pairs has them dealt over tasks, each with a copy of its set.
        """
        lanes = self.lanes
        by = F.xxhash64("v")
        hot = hot_keys(pairs.groupBy("u").agg(F.count("*").alias("n")), "u", "n", pairs.count())
        marked = join_salted(pairs, lanes.select(F.col("node").alias("u"), F.col("lanes").alias("lu")), "u", hot, by).join(lanes.select(F.col("node").alias("v"), F.col("lanes").alias("lv")), "v")
        likely = gathered(marked.select("u", "v", "lu", "lv").mapInArrow(lean(_likely(self.least)), "u long, v long"), PAIRS)
        release(pairs.sparkSession)
        first = likely.join(self.sets.select(F.col("node").alias("v"), F.col("shingles").alias("sv")), "v")
        both = join_salted(first, self.sets.select(F.col("node").alias("u"), F.col("shingles").alias("su")), "u", hot, by)
        same = F.size(F.array_intersect("su", "sv"))
        return gathered(both.filter(100 * same >= self.percent * (F.size("su") + F.size("sv") - same)).select("u", "v"), PAIRS)


def _between(apart: DataFrame, tried: DataFrame, seed: int) -> DataFrame:
    """For each bucket, its leader by a seeded order with one node of each other component of the bucket."""
    order = F.struct(F.xxhash64(F.lit(seed), "node").alias("h"), F.col("node").alias("node"))
    one = apart.groupBy("key", "component").agg(F.min(order).alias("o"))
    lead = one.groupBy("key").agg(F.min(F.struct(F.col("o"), F.col("component").alias("c"))).alias("l"))
    both = one.join(lead, "key").filter(F.col("component") != F.col("l.c"))
    pairs = both.select(F.least("o.node", "l.o.node").alias("u"), F.greatest("o.node", "l.o.node").alias("v")).distinct()
    return gathered(pairs.join(tried, ["u", "v"], "left_anti"), PAIRS)


def prefix_pairs(nodes: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Pairs (u, v) of ``nodes`` (node, n, component) of different components that may be linked: none is missed.

    A set's shingles are ordered by their frequency among the nodes, rarest first. When the first
    shingle that two sets share has positions i and j, they share n - i + 1 and m - j + 1 at most,
    so links meet in a short prefix. The smaller set of a pair is found by shingle and size class
    (steps of 5 %); the larger one looks in the classes that its position still allows. Copies that
    differ by more than the threshold have shingles of their own first, and so do not meet.
    """
    nodes = gathered(nodes, NODES)
    few = nodes.count() <= FEW_NODES
    own = sets.join(F.broadcast(nodes.select("node")) if few else nodes.select("node"), "node", "left_semi")
    tokens = own.select("node", F.explode("shingles").alias("s"))
    often = tokens.groupBy("s").agg(F.count("*").alias("f")).filter("f > 1")
    each = Window.partitionBy("node")
    total = own.agg(F.coalesce(F.sum(F.size("shingles")), F.lit(0))).first()[0]
    met_often = join_salted(tokens, often, "s", hot_keys(often, "s", "f", total), F.col("node"))
    ranked = met_often.select("node", "s", F.row_number().over(each.orderBy("f", "s")).alias("k"), F.count("*").over(each).alias("m"))
    placed = ranked.join(F.broadcast(nodes) if few else nodes, "node").withColumn("i", F.col("n") - F.col("m") + F.col("k"))
    both = 100 + percent
    rest = both * (F.col("n") - F.col("i") + 1)
    low = F.ceil(F.lit(percent) * F.col("n") / 100)
    prefix = placed.withColumn("most", F.least("n", F.floor((rest - percent * F.col("n")) / percent))).withColumn("low", low).filter("most >= low")
    release(nodes.sparkSession)
    prefix = gathered(prefix.select("s", "node", "n", "component", "i", "low", "most", (rest >= 2 * percent * F.col("n")).alias("first")), PAIRS)
    release(nodes.sparkSession)
    mixed = prefix.groupBy("s").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).filter("lo <> hi").select("s")
    prefix = gathered(prefix.join(mixed, "s", "left_semi"), PAIRS)
    release(nodes.sparkSession)
    size_class = lambda n: F.floor(F.log(n) / F.log(F.lit(1.05)))
    x = prefix.filter("first").select("s", size_class(F.col("n")).alias("c"), F.col("node").alias("x"), F.col("n").alias("nx"), F.col("i").alias("ix"), F.col("component").alias("cx"))
    y = prefix.select("s", F.explode(F.sequence(size_class(F.col("low")), size_class(F.col("most")))).alias("c"), "node", "n", "component", "low", "most")
    order = (F.col("nx") < F.col("n")) | ((F.col("nx") == F.col("n")) & (F.col("x") < F.col("node")))
    fits = F.col("nx").between(F.col("low"), F.col("most")) & (both * (F.col("nx") - F.col("ix") + 1) >= percent * (F.col("nx") + F.col("n")))
    met = x.join(y, ["s", "c"]).filter(order & fits & (F.col("cx") != F.col("component")))
    return met.select(F.least("x", "node").alias("u"), F.greatest("x", "node").alias("v")).distinct()


def near_dedup(docs: DataFrame, words: int = 5, percent: int = 80, bands: int = 32, rows: int = 4, rounds: int = 1) -> DataFrame:
    """doc_id, n_shingles, component_id, kept, text_key and group for every row.

    A document's set holds the distinct ``words``-word shingles of its lower-cased (A-Z) text.
    Documents with a similarity of ``percent`` or more are linked. Signatures of bands * rows
    slots are cut into bands; a pair at 0.8 shares no band with probability 5e-8 at 32 x 4.
    Equal sets are one node from the start. Each node is first compared with the leader it
    shares most buckets with. Then, for ``rounds`` rounds, each bucket that holds several
    components compares one node of each with another leader. At last, the nodes of buckets that
    still hold several components are searched by shingle prefixes (``prefix_pairs``), which find
    every link between them. So a large group of copies costs a few comparisons for each member,
    while no shared bucket goes unexamined.

    An empty or null text has no shingles, is linked with nothing and keeps itself. Rows that
    share a doc_id are judged each by its text: a doc_id links nothing, and component_id is the
    smallest doc_id among the rows linked with this one. ``group`` tells the groups of linked rows
    apart where component_id can't (null without shingles), and ``text_key`` is the text's hash.
    Repeated rows are members of one group. A null doc_id has a null component_id unless linked
    with another. A text's shingles are held at once, with 160 bytes each while its signature is
    made, in one task. doc_id must be an integer (or a string of one). An empty table gives an
    empty result; other columns take no part.
    """
    src = docs.select(F.col("doc_id").cast("long").alias("doc_id"), whole_text().cast("binary").alias("text"), F.xxhash64(whole_text()).alias("text_key"))
    signed = cut(src.mapInArrow(lean(_signer(words, bands, rows)), "doc_id long, text_key long, n_shingles long, mark binary, bands array<long>, lanes binary"))
    some = signed.filter("n_shingles > 0").select("doc_id", "n_shingles", F.hex("mark").alias("mark"), "bands", "lanes")
    classes = gathered(some.groupBy("mark").agg(F.min("doc_id").alias("first"), F.count("*").alias("members")), NODES)
    total = classes.agg(F.sum("members")).first()[0] or 0
    # the node of a class is its first doc_id; classes that share one, or have none, take numbers over 2**62
    shared = classes.groupBy("first").agg(F.count("*").alias("c"), F.min("mark").alias("own")).filter("c > 1 or first is null").select(F.coalesce("first", F.lit(0)).alias("_f"), F.col("first").isNull().alias("_n"), "own")
    odd = (F.xxhash64(F.lit(2), "mark").bitwiseAND((1 << 62) - 1)).bitwiseOR(1 << 62)
    named = classes.join(shared, (F.coalesce("first", F.lit(0)) == F.col("_f")) & (F.col("first").isNull() == F.col("_n")), "left")
    classes = gathered(named.select("mark", "first", "members", F.when(F.col("first").isNull() | (F.col("own") != F.col("mark")), odd).otherwise(F.col("first")).alias("node")), NODES)
    nodes = some.join(classes.select("mark", F.col("first").alias("_first"), "node"), "mark").filter(F.col("doc_id").eqNullSafe(F.col("_first"))).dropDuplicates(["mark"])

    exploded = nodes.select("node", F.col("n_shingles").alias("n"), F.explode("bands").alias("key"))
    buckets = exploded.groupBy("key").agg(F.min("node").alias("least"), F.count("*").alias("inside")).filter("inside > 1")
    shared = gathered(join_sized(exploded.select("key", "node", "n"), gathered(buckets, PAIRS), "key", "inside", total * bands, F.col("node")).filter("least is not null"), PAIRS)
    lanes = gathered(nodes.select("node", "doc_id", "mark", "lanes").join(shared.select("node").distinct(), "node", "left_semi"), NODES)
    release(docs.sparkSession)
    verify = Verifier(lanes.select("node", "doc_id", "mark"), lanes, src, words, percent, bands * rows)
    common = shared.filter("node <> least").groupBy(F.col("least").alias("u"), F.col("node").alias("v")).agg(F.count("*").alias("n"))
    best = common.groupBy("v").agg(F.max(F.struct(F.col("n"), (-F.col("u")).alias("u"))).alias("b"))
    tried = gathered(best.select((-F.col("b.u")).alias("u"), "v"), PAIRS)
    release(docs.sparkSession)
    links = verify(tried)
    found = components(links)
    release(docs.sparkSession)

    def still_apart() -> DataFrame:
        now = shared.select("key", "node", "n").join(found.select("node", "component"), "node", "left").withColumn("component", F.coalesce("component", "node"))
        mixed = now.groupBy("key").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).filter("lo <> hi").select("key")
        return gathered(now.join(mixed, "key", "left_semi").select("key", "node", "n", "component"), PAIRS)

    def joined_up(more: DataFrame) -> DataFrame:
        return components(more.unionByName(found.filter("node <> component").select(F.col("node").alias("u"), F.col("component").alias("v"))))

    for k in range(rounds):
        more = _between(still_apart(), tried, k)
        if more.isEmpty():
            continue
        new = verify(more)
        if not new.isEmpty():
            found = joined_up(new)
        tried = tried.unionByName(more)
        release(docs.sparkSession)
    open_ = still_apart()
    if not open_.isEmpty():
        more = gathered(prefix_pairs(open_.select("node", "n", "component").distinct(), verify.sets, percent).join(tried, ["u", "v"], "left_anti"), PAIRS)
        release(docs.sparkSession)
        new = None if more.isEmpty() else verify(more)
        if new is not None and not new.isEmpty():
            found = joined_up(new)

    grouped = classes.join(found, "node", "left").withColumn("group", F.coalesce("component", "node"))
    release(docs.sparkSession)
    least = cut(grouped.groupBy("group").agg(F.min("first").alias("component_id"), F.count("*").alias("_in")))
    final = gathered(join_sized(grouped, least, "group", "_in", least.agg(F.coalesce(F.sum("_in"), F.lit(0))).first()[0], F.xxhash64("mark")).select("mark", "members", "group", "component_id"), NODES)
    release(docs.sparkSession)
    out = join_sized(signed.filter("n_shingles > 0").select("doc_id", "text_key", "n_shingles", F.hex("mark").alias("mark")), final, "mark", "members", total, F.xxhash64("doc_id", "text_key"))
    alone = signed.filter("n_shingles = 0").select("doc_id", "text_key", "n_shingles", F.col("doc_id").alias("component_id"), F.lit(None).cast("long").alias("group"))
    out = out.select("doc_id", "text_key", "n_shingles", "component_id", "group").unionByName(alone)
    return out.select("doc_id", "n_shingles", "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"), "text_key", "group")
