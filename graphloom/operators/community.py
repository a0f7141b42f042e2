"""Communities of files, alias resolution and context leaks."""

from __future__ import annotations

from collections import defaultdict
from fractions import Fraction

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..project import Graph


def file_graph(g: Graph, kinds: tuple = ("calls", "imports", "references", "inherits", "implements")) -> DataFrame:
    """(a, b, weight) with a < b: edges between the files of their ends, both directions as one."""
    at = g.nodes.select("id", "path").filter("path is not null")
    # combined by node pair first, so that the joins with paths see each pair once
    e = g.of(*kinds).groupBy("src", "dst").agg(F.count("*").alias("n"))
    e = e.join(at.select(F.col("id").alias("src"), F.col("path").alias("p")), "src").join(at.select(F.col("id").alias("dst"), F.col("path").alias("q")), "dst")
    return e.filter("p <> q").groupBy(F.least("p", "q").alias("a"), F.greatest("p", "q").alias("b")).agg(F.sum("n").alias("weight"))


def louvain(edges: list[tuple[str, str, int]], resolution: Fraction = Fraction(1), passes: int = 100) -> dict[str, str]:
    """Community of each node, named by its least node; integers only, so that equal input gives equal output.

    A node moves where 2m * weight to a community - resolution * both degrees gains strictly; of
    equal gains the least community wins. Communities that fall apart are split at the end.
    """
    names = sorted({x for a, b, _ in edges for x in (a, b)})
    number = {x: i for i, x in enumerate(names)}
    near: list[dict[int, int]] = [defaultdict(int) for _ in names]
    for a, b, w in edges:
        near[number[a]][number[b]] += w
        near[number[b]][number[a]] += w
    first, loops = near, [0] * len(names)
    member = list(range(len(names)))
    total = sum(sum(n.values()) for n in near)
    while True:
        degree = [sum(n.values()) + loop for n, loop in zip(near, loops, strict=True)]
        home, held = list(range(len(near))), list(degree)
        for _ in range(passes):
            moved = False
            for v, links in enumerate(near):
                own = home[v]
                held[own] -= degree[v]
                to: dict[int, int] = defaultdict(int)
                for u, w in links.items():
                    to[home[u]] += w
                gain = {c: resolution.denominator * total * to.get(c, 0) - resolution.numerator * degree[v] * held[c] for c in {own, *to}}
                best = min(gain, key=lambda c: (-gain[c], c))
                if gain[best] <= gain[own]:
                    best = own
                held[best] += degree[v]
                home[v], moved = best, moved or best != own
            if not moved:
                break
        used = {c: i for i, c in enumerate(sorted(set(home)))}
        if len(used) == len(near):
            break
        member = [used[home[m]] for m in member]
        wider: list[dict[int, int]] = [defaultdict(int) for _ in used]
        inner = [0] * len(used)
        for v, links in enumerate(near):
            c = used[home[v]]
            inner[c] += loops[v]
            for u, w in links.items():
                if used[home[u]] == c:
                    inner[c] += w
                else:
                    wider[c][used[home[u]]] += w
        near, loops = wider, inner
    out: dict[str, str] = {}
    for i, name in enumerate(names):  # in order of names: the first of a connected part names it
        if name in out:
            continue
        out[name], todo = name, [i]
        while todo:
            for u in first[todo.pop()]:
                if member[u] == member[i] and names[u] not in out:
                    out[names[u]] = name
                    todo.append(u)
    return out


def communities(g: Graph, resolution: Fraction = Fraction(1), most_edges: int = 500_000) -> DataFrame:
    """(path, community) of every file with an edge to another.

    The graph of files is a summary; one of more than ``most_edges`` is refused, with nothing cut
    off, as the moves go on one after the other on the driver.
    """
    spark = g.nodes.sparkSession
    rows = file_graph(g).limit(most_edges + 1).collect()
    if len(rows) > most_edges:
        raise ValueError(f"the graph of files has over {most_edges} edges")
    return spark.createDataFrame(sorted(louvain([tuple(r) for r in rows], resolution).items()), "path string, community string")


def resolve_aliases(uses: DataFrame, imports: DataFrame) -> DataFrame:
    """``uses`` (scope, symbol, ...) with the ``target`` that their scope imports under that name: null where none, the least of several."""
    table = imports.groupBy("scope", "symbol").agg(F.min("target").alias("target"))
    return uses.join(table, ["scope", "symbol"], "left")


def accepts_context(signature: Column) -> Column:
    return F.coalesce(signature.contains("context.Context"), F.lit(False))


def context_leaks(nodes: DataFrame, calls: DataFrame, mode: str = "all") -> DataFrame:
    """(caller, callee, seq, mode) of the calls (src, dst, seq, is_async, threads) to a function that takes a context and gets none.

    An asynchronous call is an unthreaded_goroutine; one of a HTTP handler a http_handler_leak; one
    of a function that has a context itself a break_site. Other callers have none to pass on.
    """
    own = nodes.select(F.col("id").alias("src"), F.col("signature").alias("s"))
    takes = nodes.filter(accepts_context(F.col("signature"))).select(F.col("id").alias("dst"))
    handler = F.coalesce(F.col("s").rlike(r"http\.ResponseWriter.*\*http\.Request"), F.lit(False))
    why = F.when(F.col("is_async"), "unthreaded_goroutine").when(handler, "http_handler_leak").when(accepts_context(F.col("s")), "break_site")
    lost = calls.filter("not coalesce(threads, false)").join(takes, "dst", "left_semi").join(own, "src")
    found = lost.select(F.col("src").alias("caller"), F.col("dst").alias("callee"), "seq", why.alias("mode")).filter("mode is not null")
    return found if mode == "all" else found.filter(F.col("mode") == mode)
