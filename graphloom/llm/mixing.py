"""Mixing sources to target weights over fixed-length blocks of words."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, cut, join_sized, release, running_offset, whole_text, word_count

#: Cyclic weights of the sources in code-point order, null last.
WEIGHTS = (3, 1, 2)


def targets(sizes: list[tuple[str | None, int]], weights: tuple = WEIGHTS, share: float = 1.5, most: float = 2.0) -> dict[str | None, float]:
    """Words wanted of each source: ``share`` of all words by weight, ``most`` times its size at the top.

    What a source can't give is dealt again to the others by weight until none is above.
    """
    order = sorted(sizes, key=lambda x: (x[0] is None, x[0] or ""))
    weight = {s: weights[i % len(weights)] for i, (s, _) in enumerate(order)}
    top = {s: most * n for s, n in order}
    left, open_, out = share * sum(n for _, n in order), dict(weight), {}
    while open_:
        unit = left / sum(open_.values())
        full = [s for s in open_ if open_[s] * unit > top[s]]
        if not full:
            return out | {s: w * unit for s, w in open_.items()}
        for s in full:
            out[s] = top[s]
            left -= top[s]
            del open_[s]
    return out


@dataclass
class Mix:
    """``placed``: one row per document with its source's number, word offset and target.
    ``fragments``: the words of a document in a block. ``counts``: the blocks drawn for each shard
    and source, and where the shard's slots of the source start. ``slots``: the drawn blocks, with
    shard and pass."""

    placed: DataFrame
    fragments: DataFrame
    counts: DataFrame
    slots: DataFrame


#: Source rows are under 100 bytes, so a broadcast of so many is under 10 MB.
FEW_SOURCES = 100_000
#: Steps of a cycle walk that are written out; see ``permuted``.
WALK = 64


def radices(n: int) -> tuple[int, int]:
    """Two factors whose product is ``n`` or little more: under sqrt(n) + 1 more."""
    a = max(1, math.isqrt(n))
    return a, -(-n // a)


def _rounds(left: Column, right: Column, a: Column, b: Column, key: list, seed: int) -> list:
    """The four rounds of the network: which half changes (0 left, 1 right), and how it comes from both."""
    step = lambda j, own, other, n: F.pmod(own + F.pmod(F.xxhash64(F.lit(seed), F.lit(j), *key, other), n), n)
    return [lambda x, y: step(0, x, y, a), lambda x, y: step(1, y, x, b), lambda x, y: step(2, x, y, a), lambda x, y: step(3, y, x, b)]


def permuted(df: DataFrame, k: Column, n: str, a: str, b: str, key: list, out: str, seed: int = 5) -> DataFrame:
    """Adds where a keyed pseudorandom permutation of 0..n-1 sends ``k``.

    A Feistel network of four rounds over pairs below ``a`` and ``b`` permutes 0..a*b-1; what it
    sends to n or beyond walks on along its cycle until it is below n. A walk meets each of the
    a*b-n places outside once at most, so it is complete where these are up to ``WALK``; beyond,
    n is over 4,000 and a walk of more steps has a probability under 2**-384, and raises.
    """
    n_, a_, b_ = F.col(n), F.col(a), F.col(b)
    df = df.withColumn("_l", k % a_).withColumn("_r", F.floor(k / a_))
    for j, f in enumerate(_rounds(F.col("_l"), F.col("_r"), a_, b_, key, seed)):
        df = df.withColumn("_r" if j % 2 else "_l", f(F.col("_l"), F.col("_r")))

    def once(x: Column) -> Column:
        left, right = x % a_, F.floor(x / a_)
        for j, f in enumerate(_rounds(left, right, a_, b_, key, seed)):
            left, right = (left, f(left, right)) if j % 2 else (f(left, right), right)
        return left + a_ * right

    df = df.withColumn("_x", F.col("_l") + a_ * F.col("_r"))
    steps = F.sequence(F.lit(1), F.least(a_ * b_ - n_, F.lit(WALK)).cast("int"))
    walk = F.aggregate(steps, F.col("_x"), lambda x, _: F.when(x < n_, x).otherwise(once(x)))
    df = df.withColumn(out, F.when(F.col("_x") < n_, F.col("_x")).otherwise(walk))
    checked = F.when(F.col(out) < n_, F.col(out)).otherwise(F.raise_error(F.lit("a cycle walk is too long")).cast("long"))
    return df.withColumn(out, checked).drop("_l", "_r", "_x")


def _each(runs: DataFrame, n: Column, start: Column, out: str, total: int, run: int = 4096) -> DataFrame:
    """A row for each number from ``start`` to ``start`` + ``n`` - 1; runs are dealt over tasks before they are written out."""
    tasks = max(int(runs.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-total // 1_000_000))
    dealt = runs.withColumn("_n", n).withColumn("_s", start).filter("_n > 0")
    dealt = dealt.withColumn("_run", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("_n") - 1) / run)))).repartition(tasks, "sid", "_s", "_run")
    at = F.col("_s") + F.col("_run") * run
    end = F.least(F.col("_s") + F.col("_n") - 1, at + run - 1)
    return dealt.withColumn(out, F.explode(F.sequence(at, end))).drop("_n", "_s", "_run")


def mix(docs: DataFrame, shards: int = 64, block_words: int = 64, seed: int = 5) -> Mix:
    """Plans the mix with DataFrame functions only.

    Each source's words, documents in a seeded order, are packed into blocks of ``block_words``
    (its last one may be shorter). A source gets as many blocks as make them worth its target;
    how many of them go to each output shard is a multinomial draw, made by seeded throws. A
    shard's count is a run of the source's slots. A slot's number maps to a block through the
    source's keyed pseudorandom index permutation (another one in each pass), and blocks are
    joined by (source, index). As slots never exceed twice the blocks, no block is used over twice.

    Documents without words take part with size 0, and an empty table gives an empty mix. Null
    sources form one source. Repeated rows each have their own words; a very long text spans
    many blocks. The sources' totals come to the driver, one row per source.
    """
    spark = docs.sparkSession
    key = F.coalesce(F.concat(F.lit("s"), F.col("source").cast("string")), F.lit("n"))
    sized = docs.select("doc_id", "source", key.alias("_key"), word_count(whole_text()).alias("size"), F.xxhash64(whole_text()).alias("text_key"))
    sized = cut(sized)
    totals = [(r[0], int(r[1]), r[2]) for r in sized.groupBy("source").agg(F.sum("size"), F.count("*")).collect()]
    release(spark)
    rows = sum(n for _, _, n in totals)
    want = targets([(s, w) for s, w, _ in totals])
    order = sorted(totals, key=lambda x: (x[0] is None, x[0] or ""))
    table = []
    for i, (s, words, n_rows) in enumerate(order):
        blocks = -(-words // block_words)
        slots = min(2 * blocks, round(want[s] * blocks / words)) if words else 0
        table.append((i, "n" if s is None else f"s{s}", words, float(want[s]), blocks, slots, *radices(blocks), n_rows))
    sources = spark.createDataFrame(table, "sid int, _key string, source_size long, target double, blocks long, slots long, _a long, _b long, _rows long")

    dim = sources.select("_key", "sid", "source_size", "target", "_rows")
    placed = sized.join(F.broadcast(dim), "_key") if len(table) <= FEW_SOURCES else join_sized(sized, dim, "_key", "_rows", rows, F.xxhash64("doc_id", "text_key"))
    placed = running_offset(placed.drop("_key", "_rows"), ["sid"], [F.col("doc_id"), F.col("text_key")], F.col("size"), "at", rows, seed)
    placed = cut(placed)
    release(spark)

    first, last = F.floor(F.col("at") / block_words), F.floor((F.col("at") + F.col("size") - 1) / block_words)
    some = placed.filter("size > 0").withColumn("block", F.explode(F.sequence(first, last)))
    begin = F.greatest(F.col("at"), F.col("block") * block_words)
    end = F.least(F.col("at") + F.col("size"), (F.col("block") + 1) * block_words)
    fragments = some.select("doc_id", "sid", "at", "block", (begin - F.col("at")).alias("start"), (end - begin).alias("n"))

    own = sources.select("sid", "blocks", "slots", "_a", "_b")
    all_slots = sum(r[5] for r in table)
    throws = _each(own, F.col("slots"), F.lit(0).cast("long"), "k", all_slots)
    shard = F.pmod(F.xxhash64(F.lit(seed), "sid", "k"), F.lit(shards)).cast("int")
    drawn = throws.groupBy("sid", "blocks", "_a", "_b", shard.alias("shard")).agg(F.count("*").alias("n"))
    before = Window.partitionBy("sid").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    counts = cut(drawn.withColumn("start", F.coalesce(F.sum("n").over(before), F.lit(0)).cast("long")))  # shards x sources rows
    release(spark)

    slot = _each(counts, F.col("n"), F.col("start"), "k", all_slots).withColumn("turn", F.floor(F.col("k") / F.col("blocks")).cast("int"))
    slot = permuted(slot, F.col("k") % F.col("blocks"), "blocks", "_a", "_b", [F.col("sid"), F.col("turn")], "block", seed)
    slots = slot.select("sid", "block", "turn", "shard", "k")
    return Mix(placed, fragments, counts.select("shard", "sid", "n", "start"), slots)


def taken_words(m: Mix) -> DataFrame:
    """doc_id, size, source_size, target, taken: the words that the mix takes of each document.

    ``shards``, an added column, is the number of output shards that take some of it.
    """
    uses = m.slots.groupBy("sid", "block").agg(F.count("*").alias("uses"), F.collect_set("shard").alias("_shards"))
    used = m.fragments.join(uses.hint("merge"), ["sid", "block"]).groupBy("sid", "at", "doc_id").agg(F.sum(F.col("n") * F.col("uses")).alias("taken"), F.array_distinct(F.flatten(F.collect_list("_shards"))).alias("_shards"))
    used = used.select(F.col("sid").alias("_sid"), F.col("at").alias("_at"), F.col("doc_id").alias("_id"), "taken", F.size("_shards").alias("shards"))
    on = (F.col("sid") == F.col("_sid")) & (F.col("at") == F.col("_at")) & F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("size") > 0)
    out = m.placed.join(used.hint("merge"), on, "left")
    return out.select("doc_id", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("long").alias("taken"), F.coalesce("shards", F.lit(0)).alias("shards"))


def _words(text: Column, parts: str) -> Column:
    words = F.regexp_extract_all(text, F.lit(WORD), 0)
    return F.array_join(F.flatten(F.transform(F.sort_array(F.col(parts)), lambda p: F.slice(words, p["start"].cast("int") + 1, p["n"].cast("int")))), " ")


def mixed_documents(docs: DataFrame, m: Mix) -> DataFrame:
    """The mix as documents: for each pass, a row with the words it takes of a document.

    A document of which a pass takes every word keeps its text as it is. The columns are those
    of ``docs``; n_chars follows the text. Texts and the words wanted of them are brought
    together in one shuffle by two hashes (of 64 bits each) of id, source and text; repeated
    rows, equal in all three, are numbered on both sides and meet by their number. Joins are
    sorted ones: both sides grow with the input, and a size guessed from compressed files must
    not turn one into a broadcast.
    """
    used = m.fragments.join(m.slots.select("sid", "block", "turn").hint("merge"), ["sid", "block"])
    uses = used.groupBy("sid", "at").agg(F.collect_list(F.struct("turn", "start", "n")).alias("_uses"))

    def keys(text_key: Column) -> list[Column]:
        row = F.xxhash64(F.col("doc_id").isNull(), "doc_id", F.col("source").isNull(), "source", text_key)
        return [row.alias("_k0"), text_key.alias("_k1")]

    placed = m.placed.filter("size > 0").select("sid", "at", "size", *keys(F.col("text_key")))
    wanted = uses.join(placed.hint("merge"), ["sid", "at"])
    row = F.struct(*[F.col(c) for c in docs.columns])
    row_type = docs.select(row.alias("r")).schema["r"].dataType
    none = lambda c: F.lit(None).cast(wanted.schema[c].dataType).alias(c)
    texts = docs.select(row.alias("_row"), *keys(F.xxhash64(whole_text())), F.lit(True).alias("_is_row"), none("at"), none("_uses"), none("size"))
    wanted = wanted.select(F.lit(None).cast(row_type).alias("_row"), "_k0", "_k1", F.lit(False).alias("_is_row"), "at", "_uses", "size")

    both = texts.unionByName(wanted).repartition("_k0", "_k1")
    both = both.withColumn("_twin", F.row_number().over(Window.partitionBy("_k0", "_k1", "_is_row").orderBy("at")))
    pair = Window.partitionBy("_k0", "_k1", "_twin")
    both = both.withColumn("_uses", F.first("_uses", True).over(pair)).withColumn("size", F.first("size", True).over(pair))
    out = both.filter(F.col("_is_row") & F.col("_uses").isNotNull())

    turn = F.explode(F.array_distinct(F.transform("_uses", lambda u: u["turn"]))).alias("_turn")
    out = out.select("_row", "size", "_uses", turn).withColumn("_uses", F.filter("_uses", lambda u: u["turn"] == F.col("_turn")))
    got = F.aggregate("_uses", F.lit(0).cast("long"), lambda s, u: s + u["n"])
    old = F.col("_row.text")
    out = out.withColumn("_text", F.when(got == F.col("size"), old).otherwise(_words(F.coalesce(old.cast("string"), F.lit("")), "_uses")))
    new = {"text": F.col("_text"), "n_chars": F.length("_text")}
    return out.select(*[new.get(c, F.col("_row")[c]).cast(docs.schema[c].dataType).alias(c) for c in docs.columns])
