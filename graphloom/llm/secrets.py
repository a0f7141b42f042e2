"""Secret scan with corpus-wide ownership frequency of the candidates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, join_sized, whole_text

#: The base kinds in their order, each with its pattern.
KINDS = ("assign", "access", "hex")
ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]{24,}"
#: Bare tokens of the added kind: letters and digits mixed, 20 characters or more.
BARE = r"(?<![A-Za-z0-9+/_=-])(?=[A-Za-z+/_=-]*[0-9])(?=[0-9+/_=-]*[A-Za-z])[A-Za-z0-9+/_=-]{20,}"
BARE_KIND = "bare"


def _prefix_sums(lengths: Column, block: int = 64) -> Column:
    """Sums of the elements before each one. Two levels, so that k elements take about 64 k steps."""
    zero = F.lit(0).cast("long")
    add = lambda a, x: a + x.cast("long")
    n = F.size(lengths)
    heads = F.sequence(F.lit(0), F.greatest(F.lit(0), F.floor((n - 1) / block).cast("int")))
    totals = F.transform(heads, lambda b: F.aggregate(F.slice(lengths, b * block + 1, F.lit(block)), zero, add))
    starts = F.aggregate(totals, F.array(zero), lambda a, x: F.array_append(a, F.element_at(a, -1) + x))
    inner = F.transform(heads, lambda b: F.transform(F.slice(lengths, b * block + 1, F.lit(block)), lambda _, i: F.get(starts, b) + F.aggregate(F.slice(lengths, b * block + 1, i), zero, add)))
    return F.flatten(inner)


def matches(text: Column, pattern: str, kind: int, value_group: int = 0) -> Column:
    """Leftmost non-overlapping matches as array<struct<start, kind, end, value>>, in code points.

    ``split`` and ``regexp_extract_all`` cut the text at the same matches, so the lengths of the
    pieces give the places.
    """
    found = F.regexp_extract_all(text, F.lit(pattern), 0)
    values = found if value_group == 0 else F.regexp_extract_all(text, F.lit(pattern), value_group)
    gaps = F.split(text, pattern, -1)
    return F.struct(found.alias("m"), values.alias("v"), F.when(F.size(found) > 0, gaps).alias("g"))


def _spans(parts: Column, kind: int) -> Column:
    steps = F.zip_with(F.slice(parts["g"], 1, F.size(parts["m"])), parts["m"], lambda g, m: F.length(g) + F.length(m))
    ends = F.zip_with(_prefix_sums(steps), steps, lambda a, b: a + b)
    spans = F.zip_with(ends, F.arrays_zip(parts["m"].alias("m"), parts["v"].alias("v")), lambda e, x: F.struct((e - F.length(x["m"])).alias("start"), F.lit(kind).alias("kind"), e.alias("end"), x["v"].alias("value")))
    return F.when(F.size(parts["m"]) > 0, spans).otherwise(F.array().cast("array<struct<start:bigint,kind:int,end:bigint,value:string>>"))


def find_candidates(docs: DataFrame) -> DataFrame:
    """doc_id, text_key, repository, owner, base (spans of the base kinds) and bare (other tokens)."""
    text = whole_text()
    src = docs.select("doc_id", "source", "lang", text.alias("text")).withColumn("text_key", F.xxhash64("text"))
    src = src.withColumns({"p0": matches(F.col("text"), ASSIGN, 0, 2), "p1": matches(F.col("text"), ACCESS, 1), "p2": matches(F.col("text"), HEX, 2), "p3": matches(F.col("text"), BARE, 3)}).drop("text")
    src = src.withColumns({f"s{i}": _spans(F.col(f"p{i}"), i) for i in range(4)})
    assign = F.filter("s0", lambda s: F.length(s["value"]) >= 6)
    access = F.filter("s1", lambda s: F.length(s["value"]) >= 20)
    src = src.withColumn("base", F.array_sort(F.concat(assign, access, F.col("s2"))))
    apart = F.filter("s3", lambda s: ~F.exists("base", lambda b: (b["start"] < s["end"]) & (s["start"] < b["end"])))
    owner = F.coalesce(F.col("source"), F.lit(""))
    return src.select("doc_id", "text_key", F.concat_ws("/", owner, F.coalesce("lang", F.lit(""))).alias("repository"), owner.alias("owner"), "base", apart.alias("bare"))


def ownership(candidates: DataFrame) -> DataFrame:
    """value_key, n_repositories, n_owners, n_found over the whole corpus, for every candidate value.

    Rows are combined before the shuffle: a value found everywhere leaves each task once per
    repository.
    """
    by_repo = candidates.groupBy("value_key", "owner", "repository").agg(F.count("*").alias("n"))
    by_owner = by_repo.groupBy("value_key", "owner").agg(F.count("*").alias("r"), F.sum("n").alias("n"))
    return by_owner.groupBy("value_key").agg(F.sum("r").alias("n_repositories"), F.count("*").alias("n_owners"), F.sum("n").alias("n_found"))


def scan_secrets(docs: DataFrame, common_owners: int = 3) -> DataFrame:
    """Every row's secrets, with the class that corpus-wide ownership gives them.

    A candidate value that ``common_owners`` owners (sources) or more have is a widely copied
    example; one that fewer have looks live. Base spans (assign, access, hex) always stay. The
    method adds spans of kind ``bare``: long tokens of letters and digits outside base spans
    that look live. Repository is source/lang, owner is source; null counts as an empty name.

    Returns doc_id, spans (array of start, kind, end, value, live in order), n_live, n_example
    and base. A null text counts as empty and has no spans; repeated rows each get their row,
    and all count in the frequencies. A very long text is searched whole. An empty table gives an
    empty result; columns beside doc_id, text, source and lang take no part.
    """
    found = cut(find_candidates(docs))
    some = found.filter((F.size("base") > 0) | (F.size("bare") > 0))
    one = some.select("doc_id", "text_key", "owner", "repository", F.explode(F.array_distinct(F.transform(F.concat("base", "bare"), lambda s: F.xxhash64(s["value"])))).alias("value_key"))
    seen = cut(ownership(one))
    total = seen.agg(F.sum("n_found")).first()[0] or 0
    judged = join_sized(one, seen, "value_key", "n_found", int(total), F.xxhash64("doc_id", "text_key"))
    live = judged.filter(F.col("n_owners") < common_owners).groupBy("doc_id", "text_key").agg(F.collect_set("value_key").alias("live"))
    live = live.select(F.col("doc_id").alias("_d"), F.col("text_key").alias("_t"), "live")
    out = found.join(live, F.col("doc_id").eqNullSafe(F.col("_d")) & (F.col("text_key") == F.col("_t")), "left")
    out = out.withColumn("live", F.coalesce("live", F.array().cast("array<bigint>")))
    mark = lambda s: F.struct(s["start"].alias("start"), s["kind"].alias("kind"), s["end"].alias("end"), s["value"].alias("value"), F.array_contains("live", F.xxhash64(s["value"])).alias("live"))
    out = out.withColumn("spans", F.array_sort(F.concat(F.transform("base", mark), F.filter(F.transform("bare", mark), lambda s: s["live"]))))
    count = lambda keep: F.size(F.filter("spans", keep)).cast("long")
    return out.select("doc_id", "base", "spans", count(lambda s: s["live"]).alias("n_live"), count(lambda s: ~s["live"]).alias("n_example"))


def span_list(spans: str) -> Column:
    names = F.array(*[F.lit(k) for k in (*KINDS, BARE_KIND)])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")
