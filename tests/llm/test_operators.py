"""The corpus operators against brute force on small tables with nulls, ties, repeats and odd columns."""

import hashlib
import itertools
import math
import random
import re
import zlib
from collections import Counter

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from graphloom.llm import queries as Q
from graphloom.llm.components import components
from graphloom.llm.exact_dedup import Directory, Index, exact_dedup
from graphloom.llm.lm_scoring import lm_scores
from graphloom.llm.media import decode_png, encode_png, media_features, pad, to_media, unfilter
from graphloom.llm.mixing import mix, mixed_documents, permuted, radices, taken_words, targets
from graphloom.llm.near_dedup import near_dedup, prefix_pairs, superminhash
from graphloom.llm.packing import boundaries, pack
from graphloom.llm.quality import fit, score_quality
from graphloom.llm.secrets import scan_secrets
from graphloom.llm.sharding import external_shuffle
from graphloom.llm.toxicity import Network, excerpt, fit_toxicity, score_toxicity, toxicity, windows

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score double, bucket int"
LONG = " ".join(f"w{i % 977}" for i in range(30_000))
ROWS = [(1, None, "en", None), (2, "", None, "a"), (3, "a  b\tc d e f", "en", "a"), (4, "a b c d e f", "en", "b"), (5, "A b c d e f", "en", "b"), (6, "é\n" + "x y z " * 30, "fr", "c"), (7, LONG, "en", "a"), (7, LONG, "en", "a"), (8, LONG + " tail", "en", "b"), (9, "one", "en", None)]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(i, t, a, s, len(t or ""), 0.5, 1) for i, t, a, s in ROWS], SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def test_exact_dedup(docs, none):
    got = sorted((r.doc_id, r.keep_id, r.group_size, r.kept) for r in exact_dedup(docs, bucket_bytes=64).collect())
    assert got == [(1, 1, 2, True), (2, 1, 2, False), (3, 3, 2, True), (4, 3, 2, False), (5, 5, 1, True), (6, 6, 1, True), (7, 7, 2, True), (7, 7, 2, True), (8, 8, 1, True), (9, 9, 1, True)]
    assert exact_dedup(none).count() == 0
    rng = random.Random(4)
    for bits, capacity, n in ((4, 15, 16), (17, 40, 60_000)):  # the second needs more than 2**14 buckets
        d = Directory(capacity, bits)
        loads = Counter()
        for _ in range(n):
            cell, load = rng.randrange(1 << bits), rng.randrange(1, 20)
            loads[cell] += load
            d.add(cell, load)
        held = Counter()
        for cell, load in loads.items():
            held[d.slots[cell >> (bits - d.depth)]] += load
        assert all(x <= capacity or d.local[b] == bits for b, x in held.items()) and len(d.slots) == 1 << d.depth
        assert all(d.slots.count(b) == 1 << (d.depth - d.local[b]) for b in range(0, len(d.load), 1 + len(d.load) // 50))
    assert len(d.load) > 1 << 13


def test_exact_index_reopens(spark, docs, tmp_path):
    exact_dedup(docs, bucket_bytes=64, folder=str(tmp_path / "i")).count()
    index = Index(str(tmp_path / "i"))
    entries, directory = index.entries(spark).collect(), {r.slot: r.bucket for r in index.directory(spark).collect()}
    depth = len(directory).bit_length() - 1
    assert depth > 0 and all(directory[(r.key % 2**64) >> (64 - depth)] == r.bucket for r in entries)
    assert sum(r.group_size for r in entries) == len(ROWS) and len({r.text_sha256 for r in entries}) == len(entries)
    # texts that share a doc_id are judged each
    odd = spark.createDataFrame([(3, "same text"), (5, "other words"), (5, "same  text"), (None, "other words"), (None, "x")], "doc_id long, text string")
    got = sorted(((r.doc_id or 0), r.keep_id or 0, r.group_size, r.kept) for r in exact_dedup(odd.withColumn("key", F.lit(1)).withColumn("slot", F.lit(1))).collect())
    assert got == [(0, 0, 1, True), (0, 5, 2, False), (3, 3, 2, True), (5, 3, 2, False), (5, 5, 2, True)]


def test_shuffle(docs, none):
    rows = external_shuffle(docs, shards=3, bucket_bytes=1000).collect()
    assert len(rows) == len(ROWS)
    for s, own in itertools.groupby(sorted(rows, key=lambda r: r["shard"]), lambda r: r["shard"]):
        assert sorted(r["slot"] for r in own) == list(range(sum(r["shard"] == s for r in rows)))
    assert all(r["grown_shard"] in (r["shard"], 3) for r in rows)
    again = external_shuffle(docs, shards=3, bucket_bytes=1000).collect()
    key = lambda r: (r["doc_id"], r["shard"], r["slot"])
    assert sorted(map(key, rows)) == sorted(map(key, again))
    assert external_shuffle(none).count() == 0


def test_shuffle_keeps_columns_and_splits_repeats(spark, tmp_path):
    rows = [(i, f"text {i}", i * 9, "b", i + 1) for i in range(50)] + [(7, "same", 1, "b", 2)] * 3000 + [(None, None, 0, "n", 0)]
    d = spark.createDataFrame(rows, "doc_id long, text string, size long, bucket string, Slot int").repartition(5)
    out = external_shuffle(d, shards=4, bucket_bytes=1000, folder=str(tmp_path / "x"))
    assert out.columns == ["doc_id", "text", "input_size", "bucket", "input_Slot", "size", "shard", "grown_shard", "slot"]
    got = out.collect()
    assert Counter((r.doc_id, r.text, r.input_size, r.bucket, r.input_Slot) for r in got) == Counter(rows)
    assert all(r["size"] == len(r.text or "") + 8 and r.grown_shard in (r["shard"], 4) for r in got)
    shard = {}
    for r in got:
        assert shard.setdefault(r.doc_id, r["shard"]) == r["shard"]
    for k in {*shard.values()}:
        own = sorted((r.slot, r.doc_id) for r in got if r["shard"] == k)
        assert [x for x, _ in own] == list(range(len(own)))
    # written, and the same whatever the session's number of shuffle partitions
    assert {r["shard"] for r in spark.read.parquet(str(tmp_path / "x")).collect()} == {*shard.values()}
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "9")
    again = external_shuffle(d, shards=4, bucket_bytes=1000).collect()
    spark.conf.set("spark.sql.shuffle.partitions", before)
    assert sorted(map(str, got)) == sorted(map(str, again))
    order = [r.doc_id for r in sorted(external_shuffle(spark.range(500).selectExpr("id as doc_id", "'t' as text"), shards=1).collect(), key=lambda r: r.slot)]
    assert sorted(order) == list(range(500)) != order


def test_media(docs, none):
    rows = media_features(to_media(docs)).collect()
    for r in rows:
        payload = pad(next((t or "") for i, t, *_ in ROWS if i == r.doc_id).encode())
        assert (r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]))
    assert media_features(to_media(none)).count() == 0
    bad = bytearray(encode_png(pad(b"abc")))
    bad[45] ^= 1
    with pytest.raises(ValueError, match="checksum"):
        decode_png(bytes(bad))


def test_unfilter_all_kinds():
    image = np.random.default_rng(1).integers(0, 256, (10, 12)).astype(int)
    lines = np.zeros((10, 13), np.uint8)
    for y in range(10):
        lines[y, 0] = kind = y % 5
        for x in range(12):
            a, b, c = (image[y, x - 3] if x >= 3 else 0), (image[y - 1, x] if y else 0), (image[y - 1, x - 3] if y and x >= 3 else 0)
            p = a + b - c
            near = min((abs(p - v), k, v) for k, v in enumerate((a, b, c)))[2]
            lines[y, x + 1] = (image[y, x] - (0, a, b, (a + b) // 2, near)[kind]) % 256
    assert (unfilter(lines, 3) == image).all()


def test_mix(docs, none):
    got = {r.doc_id: r for r in taken_words(mix(docs, block_words=4)).collect()}
    assert all(r.taken <= 2 * r.size for r in got.values()) and got[1].taken == 0
    assert targets([("a", 100), ("b", 100), (None, 10)]) == {"a": pytest.approx(200), "b": pytest.approx(95), None: pytest.approx(20)}
    m = mix(docs, block_words=4)
    texts = mixed_documents(docs, m).collect()
    assert sum(len((r.text or "").split()) for r in texts) == sum(r.taken for r in taken_words(m).collect())
    assert taken_words(mix(none)).count() == 0
    # repeated rows and columns with clashing names keep their own words
    odd = docs.unionByName(docs).withColumn("_k0", F.col("doc_id")).withColumn("size", F.lit("x")).withColumn("_uses", F.lit(1))
    m = mix(odd, block_words=4)
    texts = mixed_documents(odd, m).collect()
    assert sum(len((r.text or "").split()) for r in texts) == sum(r.taken for r in taken_words(m).collect())
    assert texts and all(r.size == "x" and r._k0 == r.doc_id for r in texts)
    assert mixed_documents(none, mix(none)).count() == 0


def test_mix_by_brute_force(spark, docs):
    """Rebuilds the draw, the permutations and the words taken from the plan's tables, in plain Python."""
    for n in [*range(1, 70), 997, 4097, 10_000]:
        a, b = radices(n)
        assert n <= a * b <= n + math.isqrt(n) + 1
    for n in (1, 2, 3, 5, 7, 13, 997):
        a, b = radices(n)
        r = permuted(spark.range(0, n).withColumns({"n": F.lit(n), "a": F.lit(a), "b": F.lit(b)}), F.col("id"), "n", "a", "b", [F.lit(3)], "x")
        got = [x.x for x in r.collect()]
        assert sorted(got) == list(range(n))
    assert len({b - a for a, b in itertools.pairwise(got)}) > 500
    m = mix(docs, shards=5, block_words=4)
    placed = [r for r in m.placed.collect() if r["size"]]
    sizes = {r.sid: (r.source_size, r.target) for r in placed}
    blocks = {s: -(-n // 4) for s, (n, _) in sizes.items()}
    slots = m.slots.collect()
    counts = {(r.shard, r.sid): r.n for r in m.counts.collect()}
    assert counts == Counter((x.shard, x.sid) for x in slots) and len({k for k, _ in counts}) == 5
    uses = Counter()
    for s, (n, target) in sizes.items():
        own = sorted((x.k, x.block, x.turn, x.shard) for x in slots if x.sid == s)
        assert [x[0] for x in own] == list(range(min(2 * blocks[s], round(target * blocks[s] / n)))) and [x[3] for x in own] == sorted(x[3] for x in own)
        for t in (0, 1):  # each pass goes through a permutation
            pass_ = [x[1] for x in own if x[2] == t]
            assert len(set(pass_)) == len(pass_) == max(0, min(blocks[s], len(own) - t * blocks[s])) and all(0 <= x < blocks[s] for x in pass_)
        uses.update((s, x[1]) for x in own)
    words = [(s, at, i) for r in placed for s, at, i in [(r.sid, r.at + j, r.doc_id) for j in range(r["size"])]]
    assert len(words) == len({w[:2] for w in words}) == sum(n for n, _ in sizes.values())
    taken = Counter()
    for s, at, i in words:
        taken[i] += uses[s, at // 4]
    assert taken == Counter({i: n for i, n in Counter({k: sum(r.taken for r in g) for k, g in itertools.groupby(sorted(taken_words(m).collect(), key=lambda r: r.doc_id), lambda r: r.doc_id)}).items() if n})
    assert "shard" in taken_words(m)._jdf.queryExecution().optimizedPlan().toString()


def test_pack(docs, none):
    rows = pack(docs, buckets=3, token_budget=100).collect()
    assert len(rows) == len(ROWS) and all(r.padding >= 0 for r in rows)
    per = Counter((r.bucket, r.batch) for r in rows)
    assert all(n <= max(1, 100 // max(1, next(r.boundary for r in rows if (r.bucket, r.batch) == k))) for k, n in per.items())
    assert pack(none).count() == 0
    rng = np.random.default_rng(8)
    for _ in range(40):  # lengths beyond a few thousand words too
        lengths = np.unique(rng.integers(0, rng.choice([40, 30_000]), rng.integers(1, 13)))
        hist = [(int(x), int(rng.integers(1, 50))) for x in lengths]
        waste = lambda tops: sum(k * (min(t for t in tops if t >= n) - n) for n, k in hist)  # noqa: B023, E731
        for buckets in (1, 2, 3, 5, 20):
            cuts = itertools.combinations([h[0] for h in hist[:-1]], min(buckets, len(hist)) - 1)
            tops = boundaries(hist, buckets)
            assert len(tops) <= buckets and tops == sorted(set(tops)) and waste(tops) == min(waste((*c, hist[-1][0])) for c in cuts)
    assert boundaries([], 3) == []


def test_secrets(spark, none):
    key = "AKIA" + "Q" * 16
    rows = [(i, f"é password = hunter22 {key} x", "en", f"s{i}") for i in range(4)] + [(9, "token: abc\nsecret='Zx9Zx9Zx9Zx9Zx9Zx9Zx' 0123456789abcdef01234567 and q1" + "w2E3" * 6, "en", "s1"), (10, None, None, None)]
    d = spark.createDataFrame([(i, t, a, s, 0, 0.0, 0) for i, t, a, s in rows], SCHEMA)
    got = {r.doc_id: r for r in scan_secrets(d).collect()}
    assert [(s.kind, s.start, s.end) for s in got[0].base] == [(0, 2, 21), (1, 22, 42)]
    assert (got[0].n_live, got[0].n_example) == (0, 2)
    assert [s.kind for s in got[9].spans] == [0, 2, 3] and got[9].n_live == 3 and got[10].spans == []
    assert scan_secrets(none).count() == 0


def brute_components(rows, words=4):
    sets = {}
    for i, t, *_ in rows:
        w = (t or "").encode().lower().split()
        k = min(words, len(w))
        sets[i] = {tuple(w[j : j + k]) for j in range(len(w) - k + 1)} if w else set()
    root = {i: i for i in sets}
    for a, b in itertools.combinations(sorted(sets), 2):
        if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
            x, y = root[a], root[b]
            root = {k: min(x, y) if v in (x, y) else v for k, v in root.items()}
    return {i: (len(s), root[i]) for i, s in sets.items()}


def test_near_dedup(spark, docs, none):
    base = [f"t{j}" for j in range(60)]
    extra = [(100 + i, " ".join(w if (j * 7 + i * 13) % 61 > 2 else f"u{i}_{j}" for j, w in enumerate(base)), "en", "s") for i in range(40)]
    d = spark.createDataFrame([(i, t, a, s, 0, 0.0, 0) for i, t, a, s in ROWS + extra], SCHEMA)
    want = brute_components(ROWS + extra)
    got = near_dedup(d, words=4).collect()
    assert len(got) == len(ROWS) + 40
    assert all((r.n_shingles, r.component_id) == want[r.doc_id] and r.kept == (r.component_id == r.doc_id) for r in got)
    assert near_dedup(none).count() == 0


def test_near_dedup_judges_rows_that_share_a_doc_id(spark):
    a, b, c = (" ".join(f"{p}{i}" for i in range(60)) for p in "abc")
    rows = [(3, a), (5, b), (5, a + " tail"), (5, a), (7, c), (2, c + " tail"), (2, b + " tail"), (None, "x y z"), (None, a), (None, "q r s"), (9, ""), (9, None), (2, "alone here")]
    d = spark.createDataFrame([(*r, 1, "k") for r in rows], "doc_id long, text string, node long, mark string")
    got = near_dedup(d).collect()
    key = {r.text_key: None for r in got}
    assert len(got) == len(rows)
    want = {a: 3, a + " tail": 3, b: 2, b + " tail": 2, c: 2, c + " tail": 2, "x y z": None, "q r s": None, "alone here": 2}
    of = {t: spark.range(1).select(F.xxhash64(F.lit(t))).first()[0] for t in want}
    assert all(r.component_id == want[t] and r.kept == (r.doc_id == want[t]) for t, k in of.items() for r in got if r.text_key == k)
    group = lambda t: {r.group for r in got if r.text_key == of[t]}
    assert len(key) == 10 and group(b) == group(b + " tail") != group(c) == group(c + " tail") and len(group(a)) == 1
    assert {(r.doc_id, r.component_id, r.kept, r.group) for r in got if not r.n_shingles} == {(9, 9, True, None)}


def test_superminhash():
    r = np.random.default_rng(3)
    base = r.integers(0, 2**63, 150).astype(np.uint64)
    x, y = base[:100], base[50:]
    est = [(lambda s: (s[0] == s[1]).mean())(superminhash([x, y], 128, seed=k)) for k in range(40)]
    assert abs(np.mean(est) - 1 / 3) < 0.02 and np.std(est) < 1.1 * math.sqrt(2 / 9 / 128)


def test_lm_scores(docs, none):
    rows = [(i, ["\0"] + (t or "").encode().split()) for i, t, *_ in ROWS]
    own = [Counter(tuple(w[j - k + 1 : j + 1]) for k in (1, 2) for j in range(k - 1, len(w)) if len(w) > 1) for _, w in rows]
    all_ = sum(own, Counter())
    total = sum(len(w) - 1 for _, w in rows)
    want = []
    for (i, w), mine in zip(rows, own, strict=True):
        s = 0.0
        for a, b in zip(w, w[1:], strict=False):
            r = lambda *g: all_[g] - mine[g]  # noqa: B023, E731
            s += math.log(r(a, b) / r(a)) if r(a, b) > 0 and r(a) > 0 else math.log(0.4 * max(r(b), 0.5) / max(1, total - len(w) + 1))
        want.append((i, len(w) - 1, pytest.approx(s)))
    got = sorted((r.doc_id, r.n_words, r.log_score) for r in lm_scores(docs, order=2, block_bytes=1000).collect())
    assert got == sorted(want, key=lambda x: (x[0], x[1]))
    assert lm_scores(none).count() == 0


def test_lm_query_counts_trigrams(spark, docs, tmp_path):
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    rows = [(i, ["\0"] + (t or "").encode().split()) for i, t, *_ in ROWS]
    own = [Counter(tuple(w[j - k + 1 : j + 1]) for k in (1, 2, 3) for j in range(k - 1, len(w)) if len(w) > 1) for _, w in rows]
    all_ = sum(own, Counter())
    total = sum(len(w) - 1 for _, w in rows)
    want = []
    for (i, w), mine in zip(rows, own, strict=True):
        r = lambda g: all_[g] - mine[g]  # noqa: B023, E731
        s = full = 0
        for j in range(1, len(w)):
            for k in range(min(3, j + 1), 1, -1):
                g = tuple(w[j - k + 1 : j + 1])
                if r(g) > 0 and r(g[:-1]) > 0:
                    s += math.log(r(g) / r(g[:-1])) + (3 - k) * math.log(0.4)
                    full += k == 3
                    break
            else:
                s += math.log(max(r((w[j],)), 0.5) / max(1, total - len(w) + 1)) + 2 * math.log(0.4)
        want.append((i, len(w) - 1, full, pytest.approx(s)))
    got = sorted((r.doc_id, r.n_words, r.n_full, r.log_score) for r in Q.op8_lm_backoff(spark, str(tmp_path)).collect())
    assert got == sorted(want, key=lambda x: x[:3])


def test_quality_held_out(spark):
    d, lab = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    r = score_quality(d, lab).filter("held_out").join(lab, "doc_id").select(F.avg((F.col("predicted") == F.col("quality")).cast("int"))).first()[0]
    assert r > 0.95


def test_classifiers_on_odd_rows(spark, docs, none):
    lab = spark.createDataFrame([(i, i % 2, None if i == 5 else int(i > 6), "x") for i in range(1, 10)], "doc_id long, quality int, toxic int, text string")
    for f in (score_quality, toxicity):
        rows = f(docs, lab).collect()
        assert len(rows) == len(ROWS) and all(0 <= r.score <= 1 for r in rows)
        assert f(none, lab.limit(0)).count() == 0


def test_toxicity_learns(spark):
    r = np.random.default_rng(0)
    texts = [" ".join(r.choice([f"word{j}" for j in range(40)], 90)) for _ in range(240)]
    y = [i % 3 == 0 for i in range(240)]
    texts = [" ".join("vile" + w if bad and k % 20 == 7 else w for k, w in enumerate(t.split())) for t, bad in zip(texts, y, strict=True)]
    d = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    lab = spark.createDataFrame([(i, int(b)) for i, b in enumerate(y)], "doc_id long, toxic int")
    held = [x for x in toxicity(d, lab).collect() if x.held_out]
    assert sum(x.predicted == y[x.doc_id] for x in held) > 0.9 * len(held)


def test_long_texts_take_part_in_training(spark):
    r = np.random.default_rng(1)
    whole = " ".join(f"w{i}" for i in range(12_800))
    assert excerpt(whole, 1) == whole
    words = [f"w{i}" for i in range(40_000)]
    part = excerpt(" ".join(words), 1).split()
    assert len(part) == 12_800 and len(set(part)) == 12_800 and max(int(w[1:]) for w in part) > 39_000
    # toxic texts are all over 60,000 characters here
    texts = [" ".join(r.choice([f"word{j}" for j in range(40)], 12_000 if i % 3 == 0 else 60)) for i in range(45)]
    texts = [" ".join("vileness" if i % 3 == 0 and k % 5 == 2 else w for k, w in enumerate(t.split())) for i, t in enumerate(texts)]
    assert min(len(t) for t in texts[::3]) > 60_000
    d = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    lab = spark.createDataFrame([(i, int(i % 3 == 0)) for i in range(45)], "doc_id long, toxic int")
    net = fit_toxicity(d, lab)
    assert {x.doc_id: x.score > 0.5 for x in score_toxicity(d, net, "score").collect()} == {i: i % 3 == 0 for i in range(45)}


def plain_logit(net, x, steps):
    """The network's forward pass over one window, one number at a time."""
    sig = lambda v: 1 / (1 + math.exp(-v))
    p, size = net.p, net.p["wh"].shape[1]
    states = []
    for k, seq in ((0, steps), (1, steps[::-1])):
        h, own = [0.0] * size, []
        for t in seq:
            a = [sum(x[t][i] * p["wx"][k][i][j] for i in range(len(x[t]))) + p["b"][k][0][j] for j in range(3 * size)]
            u = [sum(h[i] * p["wh"][k][i][j] for i in range(size)) for j in range(3 * size)]
            z, g = ([sig(a[o + j] + u[o + j]) for j in range(size)] for o in (0, size))
            c = [math.tanh(a[2 * size + j] + g[j] * u[2 * size + j]) for j in range(size)]
            h = [(1 - z[j]) * c[j] + z[j] * h[j] for j in range(size)]
            own.append(h)
        states.append(own if k == 0 else own[::-1])
    both = [f + b for f, b in zip(*states, strict=True)]
    score = [sum(math.tanh(sum(s[i] * p["wa"][i][j] for i in range(len(s))) + p["ba"][j]) * p["va"][j] for j in range(len(p["va"]))) for s in both]
    w = [math.exp(s - max(score)) for s in score]
    return sum(w[t] / sum(w) * sum(both[t][i] * p["wo"][i] for i in range(2 * size)) for t in range(len(both))) + p["bo"][0]


def test_network_by_plain_arithmetic():
    net, r = Network.start(4), np.random.default_rng(2)
    net.p = {k: v.astype(np.float64) for k, v in net.p.items()}
    x, ids = r.standard_normal((9, 12)), r.integers(0, 9, (4, 6))
    sizes = [6, 4, 1, 3]
    got = net.forward(x, ids, np.arange(6) < np.array(sizes)[:, None])[0]
    assert got == pytest.approx([plain_logit(net, x, ids[i, :n].tolist()) for i, n in enumerate(sizes)], abs=1e-5)


def test_discriminant_by_densities():
    r = np.random.default_rng(6)
    x = np.concatenate([r.standard_normal((60, 5)) * [1, 2, 1, 3, 1] + 1, r.standard_normal((40, 5))])
    y = np.repeat([0, 1], [60, 40])
    z = (x - x.mean(0)) / (x.std(0) + 1e-6)
    pooled = 0.6 * np.cov(z[:60].T, bias=True) + 0.4 * np.cov(z[60:].T, bias=True)
    dens = []
    for own, share in ((z[:60], 0.6), (z[60:], 0.4)):
        a = max(0.1, 5 / len(own))
        cov = (1 - a) * np.cov(own.T, bias=True) + a * np.diag(np.diag(pooled))
        d = z - own.mean(0)
        dens.append(math.log(share) - 0.5 * np.linalg.slogdet(cov)[1] - 0.5 * (d * np.linalg.solve(cov, d.T).T).sum(1))
    assert fit(x, y).score(x) == pytest.approx(1 / (1 + np.exp(-(dens[1] - dens[0]) / 4)))


def test_gradients():
    net, r = Network.start(2), np.random.default_rng(0)
    net.p = {k: v.astype(np.float64) for k, v in net.p.items()}
    x, ids = r.standard_normal((7, 12)), r.integers(0, 7, (3, 5))
    mask = np.arange(5) < np.array([5, 3, 1])[:, None]
    up = r.standard_normal(3)
    _, kept = net.forward(x, ids, mask, keep=True)
    grads, dx = net.backward(up, kept)
    for k in ("wx", "wh", "wa", "va", "wo", "b"):
        at = tuple(0 for _ in net.p[k].shape)
        old = net.p[k][at]
        vals = []
        for e in (1e-2, -1e-2):
            net.p[k][at] = old + e
            vals.append((net.forward(x, ids, mask)[0] * up).sum())
        net.p[k][at] = old
        assert abs((vals[0] - vals[1]) / 2e-2 - grads[k][at]) < 2e-3
    start, size, doc = windows(np.array([0, 1, 64, 65, 200]))
    assert doc.tolist() == [1, 2, 3, 3, 4, 4, 4, 4] and (size[-1] + start[-1]) == 330


@pytest.mark.parametrize(("name", "sf"), [("op6_near_dedup", "sf0.001"), ("op8_lm_backoff", "sf0.001"), ("op10_exact_dedup", "sf0.001"), ("op10_exact_dedup", "sf0.01")])
def test_queries_match_their_sql(spark, name, sf):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '/root/testdata/{sf}/documents.parquet'")
    want = con.execute(Q.oracle_sql()[name])
    names = sorted(d[0] for d in want.description)
    df = Q.queries()[name](spark, f"/root/testdata/{sf}")
    assert sorted(df.columns) == names
    want = sorted(map(repr, want.df()[names].itertuples(index=False, name=None)))
    assert sorted(map(repr, df.select(names).toPandas().itertuples(index=False, name=None))) == want


@pytest.mark.parametrize("name", ["op1_secret_ownership", "op4_media_png", "op9_external_shuffle", "op10_exact_dedup"])
def test_queries_cover_all_rows(spark, name):
    assert Q.queries()[name](spark, SF).count() == spark.read.parquet(f"{SF}/documents.parquet").count()


def test_secret_base_matches_python(spark):
    got = {r.doc_id: r.base_sha256 for r in Q.op1_secret_ownership(spark, SF).collect()}
    assign = re.compile(r"""(?:(?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII)
    for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect():
        s = [(m.start(), 0, m.end()) for m in assign.finditer(r.text) if len(m[1]) >= 6] + [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", r.text) if len(m[0]) >= 20] + [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", r.text) if len(m[0]) >= 24]
        assert got[r.doc_id] == hashlib.sha256(",".join(f"{('assign', 'access', 'hex')[k]}:{a}:{b}" for a, k, b in sorted(s)).encode()).hexdigest()


def pipeline_rows():
    """Labelled toxic and clean texts, exact and near copies, rows that share a doc_id, repeats and empty texts."""
    r = np.random.default_rng(11)
    word = lambda n: [f"w{i}" for i in r.integers(0, 4000, n)]
    rows, lab = [], []
    for i in range(90):
        toxic = i % 3 == 0
        rows.append((i, " ".join("vileness" if toxic and k % 6 == 2 else w for k, w in enumerate(word(70 + i))), f"s{i % 4}"))
        lab.append((i, 1, int(toxic)))
    clean = [x for x in rows if x[0] % 3]
    rows += [(200 + i, "  ".join(t.split()), s) for i, (_, t, s) in enumerate(clean[:9])]
    rows += [(300 + i, t + " tail", s) for i, (_, t, s) in enumerate(clean[5:20])]
    rows += [(1, " ".join(word(40)), "s9"), clean[0], clean[0], (400, None, "s1"), (401, "", None), (402, " \n", "s2"), (403, "one two", None)]
    return rows, lab


def test_pipeline_stages_by_brute_force(spark, tmp_path):
    import corpus_pipeline as P

    rows, lab = pipeline_rows()
    schema = "doc_id long, text string, source string, kept boolean, toxicity double, k0 int, size string, batch int"
    docs = spark.createDataFrame([(*r, False, 0.5, 1, "x", 3) for r in rows], schema).repartition(3)
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(lab, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    outs, now = [], docs
    for k, (_, stage) in enumerate(P.STAGES):
        out = stage(spark, now, str(tmp_path))
        assert k == 4 or out.columns == docs.columns
        out.write.parquet(f"{tmp_path}/{k}")
        now = spark.read.parquet(f"{tmp_path}/{k}")
        outs.append(now.collect())
    pairs = lambda x: Counter((r.doc_id, r.text) for r in x)
    assert pairs(outs[0]) == Counter((i, t) for i, t, _ in rows if "vileness" not in (t or ""))
    least: dict = {}
    for r in outs[0]:
        t = " ".join((r.text or "").split()) if (r.text or "").split() else " " if r.text else ""
        least[t] = min(least.get(t, r.doc_id), r.doc_id)
    squeezed = lambda t: re.sub(r"[ \t-\r]+", " ", t or "")
    assert Counter((r.doc_id, squeezed(r.text)) for r in outs[1]) == Counter((i, t) for t, i in least.items())
    sets = [{tuple(w[j : j + 5]) for j in range(max(1, len(w) - 4))} if (w := (r.text or "").lower().split()) else set() for r in outs[1]]
    group = list(range(len(sets)))
    for a, b in itertools.combinations(range(len(sets)), 2):
        if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
            group = [group[a] if g == group[b] else g for g in group]
    want = Counter(min(outs[1][k].doc_id for k in range(len(sets)) if group[k] == g) for g in set(group))
    assert Counter(r.doc_id for r in outs[2]) == want and pairs(outs[2]) <= pairs(outs[1])
    taken = {(r.doc_id, r.size): r.taken for r in taken_words(mix(spark.read.parquet(f"{tmp_path}/2"))).collect()}
    mixed = Counter()
    for r in outs[3]:
        mixed[r.doc_id] += len(r.text.split())
    assert mixed == Counter({i: sum(v for (j, _), v in taken.items() if j == i) for i in {j for j, _ in taken}} | {}) + Counter()
    assert Counter((r.doc_id, r.n_tokens) for r in outs[4]) == Counter((r.doc_id, len((r.text or "").split())) for r in outs[3])
    assert P.run(spark, str(tmp_path)).count() == len(outs[4])
    empty = docs.limit(0)
    for _, stage in P.STAGES:
        assert stage(spark, empty, str(tmp_path)).count() == 0


def test_prefix_pairs_miss_no_link(spark):
    rng = np.random.default_rng(3)
    base = [rng.integers(0, 400, 60) for _ in range(4)]
    sets = {k: sorted({int(x) if rng.random() > 0.08 else int(rng.integers(1000, 3000)) for x in base[k % 4][: int(rng.integers(40, 61))]}) for k in range(120)}
    part = {k: k % 7 for k in sets}
    nodes = spark.createDataFrame([(k, len(v), part[k]) for k, v in sets.items()], "node long, n long, component long")
    frame = spark.createDataFrame([*sets.items()], "node long, shingles array<long>")
    got = {(r.u, r.v) for r in prefix_pairs(nodes, frame, 80).collect()}
    links = {(a, b) for a, b in itertools.combinations(sets, 2) if part[a] != part[b] and 100 * len({*sets[a]} & {*sets[b]}) >= 80 * len({*sets[a]} | {*sets[b]})}
    assert len(links) > 20 and links <= got and all(a < b and part[a] != part[b] for a, b in got)
    assert prefix_pairs(nodes.limit(0), frame, 80).count() == 0


def test_components_by_many_tasks(spark):
    rng = np.random.default_rng(5)
    links = [(int(min(a, b)), int(max(a, b))) for a, b in rng.integers(0, 200, (150, 2)) if a != b]
    root = {x: x for uv in links for x in uv}
    for a, b in links:
        x, y = root[a], root[b]
        root = {k: min(x, y) if v in (x, y) else v for k, v in root.items()}
    frame = spark.createDataFrame(links, "u long, v long").repartition(8)
    for per_task in (10, 500_000):
        got = components(frame, links_per_task=per_task).collect()
        assert len(got) == len(root) and {r.node: r.component for r in got} == root


def test_dedup_stages_keep_one_row_of_a_group(spark):
    import corpus_pipeline as P

    a, b, c = (" ".join(f"{p}{i}" for i in range(60)) for p in "abc")
    rows = [(1, a), (1, a), (1, a.replace(" ", "  ")), (2, b), (1, b), (3, a), (3, c), (3, c + " tail"), (4, c + " tail"), (None, "x y z")]
    frame = lambda r: spark.createDataFrame([(i, t, "en", "s", 0, 0.0, 0) for i, t in r], SCHEMA)
    out = sorted((r.doc_id or 0, " ".join(r.text.split())) for r in P.drop_copies(spark, frame(rows), SF).collect())
    # the smallest doc_id of each text
    assert out == sorted([(1, a), (1, b), (3, c), (3, c + " tail"), (0, "x y z")])
    out = P.drop_near_copies(spark, frame([(1, a), (1, b), (3, c), (3, c + " tail"), (5, b + " end"), (None, "x y z")]), SF).collect()
    texts = [r.text for r in out]
    assert len(texts) == 4 and a in texts and "x y z" in texts
    assert sum(t.startswith("b0") for t in texts) == sum(t.startswith("c0") for t in texts) == 1


def test_near_dedup_skips_the_last_search_when_no_bucket_is_open(spark, monkeypatch):
    def searched(*_):
        raise AssertionError("searched by prefixes")

    monkeypatch.setattr("graphloom.llm.near_dedup.prefix_pairs", searched)
    a, b = (" ".join(f"{p}{i}" for i in range(60)) for p in "ab")
    got = near_dedup(spark.createDataFrame([(1, a), (2, a + " tail"), (3, b)], "doc_id long, text string")).collect()
    assert {r.doc_id: r.component_id for r in got} == {1: 1, 2: 1, 3: 3}


def test_training_gives_its_memory_back(spark, monkeypatch):
    calls = []
    monkeypatch.setattr("graphloom.llm.toxicity.release", lambda: calls.append(1))
    docs = spark.createDataFrame([(i, "bad word" if i % 2 else "good word") for i in range(20)], "doc_id long, text string")
    fit_toxicity(docs, docs.select("doc_id", (F.col("doc_id") % 2).cast("int").alias("toxic")))
    assert calls == [1]


def test_near_dedup_gives_memory_back_between_its_steps(spark, monkeypatch):
    calls = []
    monkeypatch.setattr("graphloom.llm.near_dedup.release", calls.append, raising=False)
    a, b = (" ".join(f"{p}{i}" for i in range(60)) for p in "ab")
    got = near_dedup(spark.createDataFrame([(1, a), (2, a + " tail"), (3, b)], "doc_id long, text string")).collect()
    assert {r.doc_id: r.component_id for r in got} == {1: 1, 2: 1, 3: 3}
    assert len(calls) > 4 and all(c is not None for c in calls)


def test_mixing_and_stages_give_memory_back(spark, docs, monkeypatch):
    import corpus_pipeline as P

    calls = []
    monkeypatch.setattr("graphloom.llm.mixing.release", calls.append, raising=False)
    assert mix(docs, block_words=4).slots.count() and len(calls) > 2 and all(c is not None for c in calls)
    monkeypatch.setattr(P, "release", lambda s: calls.append("stage"), raising=False)
    assert P.STAGES[3][1](spark, docs.withColumn("n_chars", F.length("text")), "").count()
    assert "stage" in calls


def test_release_trims_the_native_memory_of_the_jvm(spark, monkeypatch):
    from graphloom.llm import common

    assert common.trim_native(spark).startswith("Trim native heap")  # on glibc
    calls = []
    monkeypatch.setattr(common, "trim_native", calls.append)
    common.release(spark)
    common.release()
    assert calls == [spark]


def test_python_workers_give_memory_back_after_a_task(monkeypatch):
    from graphloom.llm import common

    calls = []
    monkeypatch.setattr(common, "release", lambda: calls.append(1))
    made = common.lean(lambda batches: (b + 1 for b in batches))(iter([1, 2]))
    assert next(made) == 2 and not calls
    assert list(made) == [3] and calls == [1]
