"""Registered queries of communities, aliases, context leaks and command history."""

from __future__ import annotations

from pyspark.sql import functions as F

from .operators import community as C
from .registry import graph_query, table_query
from .sources import usage


@graph_query(None)
def communities(g):
    """Moves that depend on one another have no SQL; tests hold them against brute force."""
    return C.communities(g)


@graph_query("SELECT least(p.path, q.path) AS a, greatest(p.path, q.path) AS b, count(*) AS weight FROM edges JOIN nodes p ON p.id = src JOIN nodes q ON q.id = dst WHERE edges.kind IN ('calls','imports','references','inherits','implements') AND p.path <> q.path GROUP BY 1, 2")
def file_graph(g):
    return C.file_graph(g)


@graph_query("SELECT u.scope, u.symbol, target FROM (SELECT DISTINCT p.path AS scope, s.name AS symbol FROM edges r JOIN edges c ON c.src = r.src AND c.kind = 'calls' JOIN nodes p ON p.id = r.dst JOIN nodes s ON s.id = c.dst WHERE r.kind = 'references') u LEFT JOIN (SELECT p.path AS scope, s.name AS symbol, min(s.id) AS target FROM edges JOIN nodes p ON p.id = src JOIN nodes s ON s.id = dst WHERE edges.kind = 'imports' GROUP BY 1, 2) i ON i.scope = u.scope AND i.symbol = u.symbol")
def alias_resolution(g):
    """What a file's functions call beside a part, looked up among the imports of the part's file."""
    scope = g.nodes.select(F.col("id").alias("p"), F.col("path").alias("scope"))
    symbol = g.nodes.select(F.col("id").alias("s"), F.col("name").alias("symbol"))
    beside = g.of("references").select("src", F.col("dst").alias("p")).distinct().join(g.of("calls").select("src", F.col("dst").alias("s")).distinct(), "src").select("p", "s").distinct()
    uses = beside.join(scope, "p").join(symbol, "s").select("scope", "symbol").distinct()
    imports = g.of("imports").select(F.col("src").alias("p"), F.col("dst").alias("s")).join(scope, "p").join(symbol, "s").select("scope", "symbol", F.col("s").alias("target"))
    return C.resolve_aliases(uses, imports)


_SIG = "CASE start_line % 3 WHEN 0 THEN 'func(ctx context.Context)' WHEN 1 THEN 'func(w http.ResponseWriter, r *http.Request)' END"


@graph_query("SELECT src AS caller, dst AS callee, seq, CASE WHEN is_async THEN 'unthreaded_goroutine' WHEN contains(a.sig, 'http') THEN 'http_handler_leak' ELSE 'break_site' END AS mode FROM edges JOIN g a ON a.id = src JOIN g b ON b.id = dst WHERE kind = 'calls' AND seq % 2 <> 0 AND contains(b.sig, 'context.Context') AND (is_async OR a.sig IS NOT NULL)", f"g AS (SELECT id, {_SIG} AS sig FROM nodes)")
def context_leaks(g):
    """The tables have no signatures of Go: a node's follows from its line, and calls of even ``seq`` pass the context."""
    nodes = g.nodes.select("id", F.expr(_SIG).alias("signature"))
    return C.context_leaks(nodes, g.of("calls").select("src", "dst", "seq", "is_async", (F.col("seq") % 2 == 0).alias("threads")))


@table_query("SELECT event_type AS command, count(*) AS n, count(*) FILTER (value <= 50) AS failed, max(ts) AS last FROM events GROUP BY 1")
def command_history(spark, sf_dir):
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    return usage.history(e.select("ts", F.col("event_type").alias("command"), (F.col("value") > 50).alias("ok")))
