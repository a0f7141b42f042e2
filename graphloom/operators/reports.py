"""Hotspots, call hierarchies, sketches of shapes, links by name, exports as text, and rules with witnesses."""

from __future__ import annotations

import tomllib
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..core import cut
from ..project import Graph
from . import relations as R
from . import traversal as T


def _chains(k: int, most: int) -> Callable[[Iterator], Iterator]:
    """A task that takes all edges that start a chain of ``k`` and gives (c, chain) for that and each longer chain."""

    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        src, dst = T.ends(batches)
        for chain in range(k, most + 1):
            if not len(src):
                break
            heads = np.unique(src)
            yield from pa.table({"c": heads, "chain": np.full(len(heads), chain, np.int32)}).to_batches(max_chunksize=100_000)
            on = np.isin(dst, heads)
            src, dst = src[on], dst[on]

    return run


def chain_depths(nodes: DataFrame, calls: DataFrame, labels: DataFrame, most: int = 20) -> DataFrame:
    """(id, chain): the longest chain of calls from each node, up to ``most``. Calls inside a cycle don't extend it."""
    step = cut(T.condense(calls, labels))
    heads = []
    for k in range(1, most + 1):
        n = step.count()
        if n <= T.TASK:
            # few enough for one task, which goes on to the last chain
            heads += [cut(step.coalesce(1).mapInArrow(_chains(k, most), "c long, chain int"))] if n else []
            break
        # the edges that start a chain of k; those that start one of k + 1 are among them
        heads.append(step.select(F.col("src").alias("c"), F.lit(k).alias("chain")))
        if k < most:
            step = cut(step.join(step.select(F.col("src").alias("dst")).distinct(), "dst", "left_semi").select("src", "dst"))
    if not heads:
        return nodes.select("id", F.lit(0).alias("chain"))
    depth = reduce(DataFrame.unionByName, heads).groupBy("c").agg(F.max("chain").alias("chain"))
    own = labels.select("id", F.col("component").alias("c")).join(depth, "c").select("id", "chain")
    return nodes.select("id").join(own, "id", "left").select("id", F.coalesce("chain", F.lit(0)).alias("chain"))


def hotspots(nodes: DataFrame, calls: DataFrame, labels: DataFrame) -> DataFrame:
    """(id, out_calls, chain, score) of the nodes that call or head a chain, in order of score and id."""
    out = calls.groupBy(F.col("src").alias("id")).agg(F.count("*").alias("out_calls"))
    d = chain_depths(nodes, calls, labels).join(out, "id", "left").withColumn("out_calls", F.coalesce("out_calls", F.lit(0)))
    return d.withColumn("score", F.col("out_calls") + F.col("chain")).filter("score > 0")


def reach_pairs(pairs: DataFrame, edges: DataFrame) -> DataFrame:
    """(a, b, reaches) for the asked pairs, walking on from all starts at once until none moves."""
    step = edges.select("src", "dst").distinct()
    seen = now = cut(pairs.select("a", F.col("a").alias("at")).distinct())
    while not now.isEmpty():
        new = now.join(step, F.col("at") == F.col("src")).select("a", F.col("dst").alias("at")).distinct()
        now = cut(new.join(seen, ["a", "at"], "left_anti"))
        seen = cut(seen.unionByName(now))
    hit = seen.select("a", F.col("at").alias("b"), F.lit(True).alias("reaches"))
    return pairs.join(hit, ["a", "b"], "left").select("a", "b", F.coalesce("reaches", F.lit(False)).alias("reaches"))


def hierarchy(seeds: DataFrame, edges: DataFrame, depth: int) -> DataFrame:
    """(level, parent, id) rows of the call tree below the seeds: a node is placed at its least level, under each parent there."""
    step = edges.select("src", "dst").distinct()
    rows = seeds.select(F.lit(0).alias("level"), F.lit(None).cast("long").alias("parent"), "id")
    seen, now = seeds.select("id"), seeds.select("id")
    for k in range(1, depth + 1):
        down = now.withColumnRenamed("id", "src").join(step, "src").join(seen.withColumnRenamed("id", "dst"), "dst", "left_anti")
        level = cut(down.select(F.lit(k).alias("level"), F.col("src").alias("parent"), F.col("dst").alias("id")))
        rows, now = rows.unionByName(level), level.select("id").distinct()
        seen = seen.unionByName(now)
    return rows


def ancestors(nodes: DataFrame, contains: DataFrame) -> DataFrame:
    """(id, depth, ancestor) up the containing nodes, to the outermost."""
    up = contains.select(F.col("dst").alias("at"), F.col("src").alias("ancestor")).filter("at <> ancestor")
    now = cut(nodes.select("id", F.col("id").alias("at")).join(up, "at").select("id", F.lit(1).alias("depth"), "ancestor"))
    out = []
    while not now.isEmpty():
        out.append(now)
        now = cut(now.withColumnRenamed("ancestor", "at").join(up, "at").select("id", (F.col("depth") + 1).alias("depth"), "ancestor").filter("id <> ancestor"))
    return reduce(DataFrame.unionByName, out) if out else now


def sketch(tokens: Column, lanes: int = 64) -> Column:
    """MinHash lanes of a set of strings: the least of 32 bits of md5(lane:token)."""

    def lane(k: int) -> Column:
        return F.array_min(F.transform(tokens, lambda t: F.conv(F.substr(F.md5(F.concat(F.lit(f"{k}:"), t)), F.lit(1), F.lit(8)), 16, 10).cast("long")))

    return F.array(*[lane(k) for k in range(lanes)])


def lsh_pairs(shapes: DataFrame, bands: int = 16, rows: int = 4, floor: float = 0.5) -> DataFrame:
    """(a, b, jaccard) of shapes (id, hash, lanes) that share a band and agree in ``floor`` of the lanes.

    Equal shapes are one node while bands are compared, so that a group of twins makes no pairs
    of its own: the result has the pairs of their representatives (the least id of each hash).
    """
    one = cut(shapes.groupBy("hash").agg(F.min("id").alias("id"), F.min("lanes").alias("lanes")).select("id", "lanes"))
    keys = F.array(*[F.concat(F.lit(f"{b}:"), F.md5(F.array_join(F.slice("lanes", b * rows + 1, rows), ","))) for b in range(bands)])
    b = one.select("id", F.explode(keys).alias("key"))
    pairs = b.select(F.col("id").alias("a"), "key").join(b.select(F.col("id").alias("b"), "key"), "key").filter("a < b").select("a", "b").distinct()
    both = pairs.join(one.select(F.col("id").alias("a"), F.col("lanes").alias("x")), "a").join(one.select(F.col("id").alias("b"), F.col("lanes").alias("y")), "b")
    same = F.size(F.filter(F.zip_with("x", "y", lambda p, q: p == q), lambda e: e)) / F.size("x")
    return both.select("a", "b", same.alias("jaccard")).filter(F.col("jaccard") >= floor)


def quoted(col: Column, delimiter: str = ",") -> Column:
    """A CSV field: quoted where it holds a delimiter, quote or line end."""
    return F.when(col.rlike(f'[{delimiter}"\\n\\r]'), F.concat(F.lit('"'), F.replace(col, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(col)


def csv_lines(df: DataFrame, columns: list[str], delimiter: str = ",") -> Column:
    from ..functions.scalars import csv_guard

    return F.concat_ws(delimiter, *[quoted(csv_guard(F.coalesce(F.col(c).cast("string"), F.lit(""))), delimiter) for c in columns])


def diagram(edges: DataFrame, names: DataFrame, style: str) -> DataFrame:
    """(src, dst, line): edges as lines of a DOT, Mermaid or D2 diagram, with escaped labels."""
    n = names.select("id", F.replace(F.replace("name", F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"')).alias("label"))
    e = edges.join(n.select(F.col("id").alias("src"), F.col("label").alias("a")), "src").join(n.select(F.col("id").alias("dst"), F.col("label").alias("b")), "dst")
    shape = {"dot": '  "%s" -> "%s" [label="%s"];', "mermaid": '  n%s["%s"] -->|%s| n%s["%s"]', "d2": '"%s" -> "%s": %s'}[style]
    line = F.format_string(shape, "src", "a", "kind", "dst", "b") if style == "mermaid" else F.format_string(shape, "a", "b", "kind")
    return e.select("src", "dst", line.alias("line"))


@dataclass(frozen=True)
class Rule:
    """A rule: its node, what the node asks for, and what a hit is called."""

    name: str
    node: str
    severity: str = "info"
    args: dict = field(default_factory=dict)


def load_rules(text: str) -> list[Rule]:
    """A TOML pack: ``schema`` 1 or 2 and [[rule]] tables."""
    pack = tomllib.loads(text)
    if pack.get("schema") not in (1, 2):
        raise ValueError("a rule pack has schema 1 or 2")
    own = ("name", "node", "severity", "description", "remediation", "cwe")
    return [Rule(r["name"], r["node"], r.get("severity", "info"), {k: v for k, v in r.items() if k not in own}) for r in pack.get("rule", [])]


def run_rule(g: Graph, rule: Rule) -> DataFrame:
    """(rule, severity, id, witness): the nodes that a rule finds, each with the other node that shows why (null where none does)."""
    from ..plans.text import run_plan

    a = rule.args
    none = F.lit(None).cast("long").alias("witness")
    kinds = a.get("kinds", ["calls"])
    if rule.node == "scan":
        hit = run_plan(g, a["plan"]).select("id", none)
    elif rule.node == "edge_traversal":
        seeds = run_plan(g, a["from"])
        emit = a.get("emit", "reached")
        if emit == "reached":
            hit = T.traverse(seeds, g.of(*kinds), a.get("depth", 1), a.get("direction", "forward"), include_seeds=True).select("id", none)
        else:
            e = g.of(*kinds).join(seeds.withColumnRenamed("id", "src"), "src", "left_semi").select("src", "dst").distinct()
            hit = e.select(F.col("src").alias("id"), F.col("dst").alias("witness")) if emit == "sources" else e.select(F.col("dst").alias("id"), F.col("src").alias("witness"))
    elif rule.node == "relation_edges":
        hit = g.of(*kinds).select(F.col("src").alias("id"), F.col("dst").alias("witness")).distinct()
    elif rule.node == "references_at":
        to = run_plan(g, a["target"])
        hit = g.of("references").join(to.withColumnRenamed("id", "dst"), "dst", "left_semi").select(F.col("src").alias("id"), F.col("dst").alias("witness")).distinct()
    elif rule.node == "cycle_witness":
        e = g.of(*kinds).select("src", "dst").distinct()
        hit = T.cyclic(e).select("id", F.col("component").alias("witness"))
    elif rule.node == "entry_points":
        hit = g.nodes.filter(R.is_entry_point()).select("id", none)
    elif rule.node == "similar_to":
        twin = g.nodes.filter("body_hash is not null").groupBy("body_hash").agg(F.min("id").alias("witness"), F.count("*").alias("n")).filter("n > 1")
        hit = g.nodes.join(twin, "body_hash").filter("id <> witness").select("id", "witness")
    elif rule.node == "subgraph":
        ids = T.traverse(run_plan(g, a["from"]), g.of(*kinds), a.get("depth", 1), a.get("direction", "both"), include_seeds=True)
        e = g.of(*kinds).join(ids.withColumnRenamed("id", "src"), "src", "left_semi").join(ids.withColumnRenamed("id", "dst"), "dst", "left_semi")
        hit = e.select(F.col("src").alias("id"), F.col("dst").alias("witness")).distinct()
    else:
        raise ValueError(f"unknown rule node {rule.node!r}")
    return hit.select(F.lit(rule.name).alias("rule"), F.lit(rule.severity).alias("severity"), "id", "witness")


def run_rules(g: Graph, rules: list[Rule]) -> DataFrame:
    return reduce(DataFrame.unionByName, [run_rule(g, r) for r in rules])


def resolve_indirect(calls: DataFrame, functions: DataFrame, most: int = 4) -> DataFrame:
    """(src, dst, outcome): calls through a pointer, resolved to the address-taken functions of the caller's file.

    Up to ``most`` candidates are linked as type_match; a call with more is promiscuous, with a
    null target.
    """
    sites = calls.filter("resolved_via = 'binding_plane'").select("src").distinct()
    at = sites.join(functions.select(F.col("id").alias("src"), "path"), "src")
    able = functions.filter("address_taken").select(F.col("id").alias("dst"), "path")
    few = able.groupBy("path").agg(F.count("*").alias("n"))
    sized = at.join(few, "path")
    found = sized.filter(F.col("n") <= most).join(able, "path").select("src", "dst", F.lit("type_match").alias("outcome"))
    return found.unionByName(sized.filter(F.col("n") > most).select("src", F.lit(None).cast("long").alias("dst"), F.lit("promiscuous").alias("outcome")))


def numbered(df: DataFrame, order: list, out: str) -> DataFrame:
    """Row numbers over a small result."""
    return df.withColumn(out, F.row_number().over(Window.orderBy(*order)))
