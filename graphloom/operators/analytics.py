"""Aggregations and reports over a graph: pipelines, degrees, hubs, subsystems, duplicates, usage."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..core import cut
from ..functions.scalars import directory
from ..project import Graph

#: Removed, and added, nodes of one kind and signature that a key of the pairing of renames holds at most about, the fewest
#: removed ones that are dealt apart, the added ones that lie in one row there, and the tasks in which one signature meets its grid.
SHARE, LEAST, BLOCK, SALTS = 4096, 64, 1024, 16
MISSING = {"name": "<anonymous>", "visibility": "unspecified", "path": "<unknown>"}


def field_value(field: str) -> Column:
    if field in ("async", "static"):
        return F.coalesce(F.col(f"is_{field}").cast("string"), F.lit("unknown"))
    if field not in ("kind", "lang", "name", "visibility", "path"):
        return F.lit("<unsupported>")
    return F.coalesce(F.col(field), F.lit(MISSING.get(field, "unknown")))


def group_by(nodes: DataFrame, field: str) -> DataFrame:
    return nodes.groupBy(field_value(field).alias("value")).agg(F.count("*").alias("n"))


def top(nodes: DataFrame, n: int, field: str) -> DataFrame:
    return group_by(nodes, field).orderBy(F.desc("n"), "value").limit(n)


def stats(nodes: DataFrame) -> DataFrame:
    """Total and counts by kind, language and visibility in one pass of grouping sets."""
    v = nodes.select(field_value("kind").alias("kind"), field_value("lang").alias("lang"), field_value("visibility").alias("visibility"))
    sets = v.groupingSets([["kind"], ["lang"], ["visibility"], []], "kind", "lang", "visibility").agg(F.count("*").alias("n"), F.grouping_id().alias("g"))
    by = F.when(F.col("g") == 3, "kind").when(F.col("g") == 5, "lang").when(F.col("g") == 6, "visibility").otherwise("total")
    return sets.select(by.alias("section"), F.coalesce("kind", "lang", "visibility", F.lit("all")).alias("value"), "n")


def degrees(g: Graph, *kinds: str) -> DataFrame:
    """(id, fan_in, fan_out) of nodes with an edge; each side is summed before the join."""
    e = g.of(*kinds)
    into = e.groupBy(F.col("dst").alias("id")).agg(F.count("*").alias("fan_in"))
    out = e.groupBy(F.col("src").alias("id")).agg(F.count("*").alias("fan_out"))
    return into.join(out, "id", "full").select("id", *[F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("fan_in", "fan_out")])


def hubs(g: Graph, kinds: tuple = ("function", "method", "struct", "class", "trait"), n: int = 10, score: str = "fan_in") -> DataFrame:
    by = {"fan_in": F.col("fan_in"), "fan_out": F.col("fan_out"), "product": F.col("fan_in") * F.col("fan_out")}[score]
    d = degrees(g, "calls", "references").join(g.nodes.filter(F.col("kind").isin(*kinds)).select("id", "kind", "name"), "id")
    return d.withColumn("score", by).orderBy(F.desc("score"), "kind", "name", "id").limit(n)


def subsystems(g: Graph, depth: int = 2, kinds: tuple = ("calls", "imports", "references")) -> DataFrame:
    """Buckets by leading directories: size, internal edges and the member with most edges in."""
    b = g.nodes.select("id", directory(F.col("path"), depth).alias("bucket"))
    e = g.of(*kinds).select("src", "dst")
    into = e.groupBy(F.col("dst").alias("id")).agg(F.count("*").alias("fan_in"))
    size = b.join(into, "id", "left").groupBy("bucket").agg(F.count("*").alias("size"), F.max_by("id", F.struct(F.coalesce("fan_in", F.lit(0)), -F.col("id"))).alias("hub"))
    inside = couplings(g, depth, kinds).filter("bucket = target").groupBy("bucket").agg(F.sum("n").alias("internal_edges"))
    return size.join(inside, "bucket", "left").select("bucket", "size", F.coalesce("internal_edges", F.lit(0)).alias("internal_edges"), "hub")


def couplings(g: Graph, depth: int = 2, kinds: tuple = ("calls", "imports", "references")) -> DataFrame:
    b = g.nodes.select("id", directory(F.col("path"), depth).alias("bucket"))
    e = g.of(*kinds).select("src", "dst", "kind")
    e = e.join(b.select(F.col("id").alias("src"), "bucket"), "src").join(b.select(F.col("id").alias("dst"), F.col("bucket").alias("target")), "dst")
    return e.groupBy("bucket", "target", "kind").agg(F.count("*").alias("n"))


def duplicates(nodes: DataFrame, key: list[str], shown: int = 10, most: int = 1000) -> DataFrame:
    """Groups of two or more by key, the first members by (path, name, id), largest groups first."""
    w = Window.partitionBy(*key).orderBy("path", "name", "id")
    sized = nodes.groupBy(*key).agg(F.count("*").alias("size")).filter("size > 1")
    first = nodes.join(sized.select(*key), key, "left_semi").withColumn("r", F.row_number().over(w)).filter(F.col("r") <= shown)
    members = first.groupBy(*key).agg(F.concat_ws(",", F.transform(F.sort_array(F.collect_list(F.struct("r", "id"))), lambda x: x["id"].cast("string"))).alias("members"))
    return sized.join(members, key).orderBy(F.desc("size"), *key).limit(most)


def innermost(items: DataFrame, spans: DataFrame, width: int = 64) -> DataFrame:
    """For each (item, file, at) the smallest span (span, file, lo, hi) around it.

    Spans are cut over bins of ``width`` positions, so the join is an equi-join on file and bin.
    """
    cells = spans.withColumn("bin", F.explode(F.sequence(F.floor(F.col("lo") / width), F.floor(F.col("hi") / width))))
    found = items.withColumn("bin", F.floor(F.col("at") / width)).join(cells, ["file", "bin"]).filter("at between lo and hi and item <> span")
    return found.groupBy("item").agg(F.min_by("span", F.struct(F.col("hi") - F.col("lo"), F.col("span"))).alias("span"))


def as_of(uses: DataFrame, bindings: DataFrame, by: list[str]) -> DataFrame:
    """For each use (``by``, at, use) the latest binding (``by``, at, node) at or before it: one shuffle, no range join."""
    both = uses.select(*by, "at", F.lit(1).alias("o"), "use", F.lit(None).cast("long").alias("node")).unionByName(bindings.select(*by, "at", F.lit(0).alias("o"), F.lit(None).cast("long").alias("use"), "node"))
    w = Window.partitionBy(*by).orderBy("at", "o", "node").rowsBetween(Window.unboundedPreceding, 0)
    return both.withColumn("node", F.last("node", ignorenulls=True).over(w)).filter("o = 1").select("use", "node")


def latest_writes(deltas: DataFrame, key: list[str], order: list) -> DataFrame:
    """Last writer wins for each key; removed ones go. Combines before the shuffle."""
    last = deltas.groupBy(*key).agg(F.max(F.struct(*order, F.col("op").alias("_op"))).alias("w"))
    return last.filter("w._op = 'add'").select(*key, F.col("w").getField("seq").alias("seq"))


def diff(old: DataFrame, new: DataFrame) -> DataFrame:
    """(qualified_name, change) of added, removed, signature_changed and modified nodes."""
    cols = ["signature", "path", "start_line", "end_line"]
    o = old.select("qualified_name", *[F.col(c).alias(f"o_{c}") for c in cols], F.lit(True).alias("o"))
    n = new.select("qualified_name", *[F.col(c).alias(f"n_{c}") for c in cols], F.lit(True).alias("n"))
    j = o.join(n, "qualified_name", "full")
    differ = lambda c: ~F.col(f"o_{c}").eqNullSafe(F.col(f"n_{c}"))
    change = F.when(F.col("o").isNull(), "added").when(F.col("n").isNull(), "removed").when(differ("signature"), "signature_changed").when(differ("path") | differ("start_line") | differ("end_line"), "modified")
    return j.select("qualified_name", change.alias("change")).filter("change is not null")


def replaced(old: DataFrame, new: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The nodes that ``diff`` calls removed, and those it calls added, found by one join that is kept in a checkpoint."""
    side = lambda d, p: d.select("qualified_name", F.struct("kind", "signature", "path", "start_line").alias(p))
    j = cut(side(old, "o").join(side(new, "n"), "qualified_name", "full").filter("qualified_name is not null and (o is null or n is null)"))
    return tuple(j.filter(F.col(p).isNotNull()).select("qualified_name", f"{p}.*") for p in ("o", "n"))


def rename_score(old_sig: Column, new_sig: Column, old_path: Column, new_path: Column, lines: Column) -> Column:
    from ..functions.scalars import levenshtein_similarity

    return _rename_score(levenshtein_similarity(F.coalesce(old_sig, F.lit("")), F.coalesce(new_sig, F.lit("")), by_bytes=True), old_path, new_path, lines)


def _rename_score(sig: Column, old_path: Column, new_path: Column, lines: Column) -> Column:
    loc = F.when(old_path != new_path, 0.7).when(lines <= 50, 1 - F.least(lines / 100, F.lit(0.5))).otherwise(0.3)
    return F.when(sig >= 0.7, 0.7 * sig + 0.3 * loc).otherwise(0.0)


def renames(gone: DataFrame, come: DataFrame, least: float = 0.9) -> DataFrame:
    """(old_name, new_name, score) of every removed and added node of one kind that score ``least`` or more.

    Names play no part. The distinct signatures of a kind are compared once (null goes with null alone); a pair
    of signatures whose best score is under ``least`` is never paired by node. The pairs of a kind and signature are a
    grid of some ``SHARE`` removed by ``SHARE`` added nodes, of more rows where that is too few to deal over all
    tasks. A node's copies for it are bounded by the number of shuffle partitions.
    """
    from ..functions.scalars import levenshtein_similarity

    of = lambda d, p: d.select(*[F.col(c).alias(f"{p}_{c}") for c in ("qualified_name", "kind", "signature", "path", "start_line")])
    o, n = of(gone, "o"), of(come, "n")
    a, b = o.select("o_kind", "o_signature").distinct(), n.select("n_kind", "n_signature").distinct()
    short, long = F.least(F.octet_length("o_signature"), F.octet_length("n_signature")), F.greatest(F.octet_length("o_signature"), F.octet_length("n_signature"))
    floor = (least - 0.3) / 0.7 - 1e-9
    both = F.col("o_signature").isNotNull() & F.col("n_signature").isNotNull()
    alike = F.col("o_signature").eqNullSafe(F.col("n_signature")) | (both & (short >= long * floor) & (levenshtein_similarity(F.col("o_signature"), F.col("n_signature"), by_bytes=True) >= floor))
    sim = levenshtein_similarity(F.coalesce("o_signature", F.lit("")), F.coalesce("n_signature", F.lit("")), by_bytes=True)
    pairs = a.join(b, (F.col("o_kind") == F.col("n_kind")) & alike).select(F.col("o_kind").alias("kind"), "o_signature", "n_signature", sim.alias("sig"))
    # null signatures get a plain key, as a null-safe join would deal the rows anew
    key = lambda c: (F.col(c).isNull(), F.coalesce(c, F.lit("")))
    pairs = pairs.select("kind", *[x.alias(f"{p}{i}") for p, c in (("a", "o_signature"), ("b", "n_signature")) for i, x in enumerate(key(c))], "sig")
    removed = o.select(F.col("o_kind").alias("kind"), *[x.alias(f"a{i}") for i, x in enumerate(key("o_signature"))], "o_qualified_name", "o_path", "o_start_line")
    added = n.select(F.col("n_kind").alias("kind"), *[x.alias(f"b{i}") for i, x in enumerate(key("n_signature"))], "n_qualified_name", "n_path", "n_start_line")
    parts = int(gone.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    sizes = removed.groupBy("kind", "a0", "a1").agg(F.count("*").alias("n"))
    tall = pairs.join(sizes, ["kind", "a0", "a1"]).groupBy("kind", "b0", "b1").agg(F.sum("n").alias("gone"))
    grid = added.groupBy("kind", "b0", "b1").agg(F.count("*").alias("come")).join(tall, ["kind", "b0", "b1"])
    share = lambda n: F.least(F.ceil(F.col(n) / SHARE), F.lit(parts))
    # of a kind and signature of added nodes: the grid's columns and rows, and the blocks of a column
    grid = grid.withColumn("columns", share("come")).withColumn("rows", F.least(F.ceil(F.col("gone") / LEAST), F.greatest(share("gone"), F.ceil(4 * parts / F.col("columns")))))
    grid = grid.withColumn("blocks", F.ceil(F.col("come") / F.col("columns") / BLOCK)).drop("gone", "come")
    each = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))
    deal = lambda c, n, seed: F.pmod(F.xxhash64(c, F.lit(seed)), F.col(n))
    # most nodes may have one signature, so they meet its grid in many tasks
    salted, salts = lambda d, c: d.withColumn("salt", F.pmod(F.xxhash64(c, F.lit(2)), F.lit(SALTS).cast("long"))), F.explode(F.sequence(*[F.lit(x).cast("long") for x in (0, SALTS - 1)]))
    # one column, as keys that are literals would leave the join, without nulls, as a type that differs would be cast: either has the join deal the rows anew
    at = F.struct(*[F.coalesce(c, F.lit(x)).alias(c) for c, x in (("kind", ""), ("b0", False), ("b1", ""), ("row", 0), ("column", 0))]).alias("at")
    far = _rename_score(F.col("sig"), F.lit("o"), F.lit("n"), F.lit(0))
    sides = salted(removed, "o_qualified_name").join(pairs.join(grid, ["kind", "b0", "b1"]).withColumn("salt", salts), ["kind", "a0", "a1", "salt"]).withColumn("row", deal("o_qualified_name", "rows", 0)).withColumn("column", each("columns"))
    sides = sides.select(at, "sig", far.alias("far"), F.round(far, 6).alias("far_round"), "o_qualified_name", "o_path", "o_start_line")
    # a removed node meets a block after the other, so that names come again soon and what is written gets small
    blocks = salted(added, "n_qualified_name").join(grid.withColumn("salt", salts), ["kind", "b0", "b1", "salt"]).withColumn("column", deal("n_qualified_name", "columns", 0)).withColumn("block", deal("n_qualified_name", "blocks", 1))
    blocks = blocks.groupBy("kind", "b0", "b1", "rows", "column", "block").agg(F.collect_list(F.struct("n_qualified_name", "n_path", "n_start_line")).alias("added"))
    blocks = blocks.withColumn("row", each("rows")).select(at, "added")
    # the rows are few, their pairs many: a number of parts that is asked for is not put together again
    j = blocks.repartition(parts, "at").join(sides.repartition(parts, "at").hint("merge"), "at").select("*", F.inline("added"))
    elsewhere = F.col("o_path") != F.col("n_path")
    near = _rename_score(F.col("sig"), F.col("o_path"), F.col("n_path"), F.abs(F.col("o_start_line") - F.col("n_start_line")))
    # most pairs are of two files: their score and its rounding, which is slow, are those of their signatures
    j = j.filter(F.when(elsewhere, F.col("far")).otherwise(near) >= least)
    return j.select(F.col("o_qualified_name").alias("old_name"), F.col("n_qualified_name").alias("new_name"), F.when(elsewhere, F.col("far_round")).otherwise(F.round(near, 6)).alias("score"))


def replace_files(old: DataFrame, new: DataFrame, file: str) -> DataFrame:
    """The rows of every file that ``new`` has are replaced by its own."""
    files = new.select(F.col(file).alias("_file")).distinct()
    return old.join(files, F.col(file) == F.col("_file"), "left_anti").unionByName(new)


def compaction(changes: DataFrame, operations: int, tombstones: float) -> DataFrame:
    """(operations, by_tombstones, by_operations): whether a change buffer is due for compaction."""
    n, gone = F.count("*"), F.count_if(F.col("op") == "remove")
    return changes.agg(n.alias("operations"), F.coalesce(gone / F.when(n > 0, n) > tombstones, F.lit(False)).alias("by_tombstones"), (n > operations).alias("by_operations"))


def guarded(result: DataFrame, most: int) -> DataFrame:
    """The first ``most`` rows with a status: complete, or truncated where there are more."""
    more = result.limit(most + 1).agg((F.count("*") > most).alias("_more"))
    return result.limit(most).join(F.broadcast(more)).withColumn("status", F.when(F.col("_more"), "truncated").otherwise("complete")).drop("_more")
