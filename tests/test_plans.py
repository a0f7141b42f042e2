"""Plan trees, the boolean language's values, chains, sketches, rules, exports and streams on small inputs."""

import pytest
from pyspark.sql import functions as F

from graphloom.core import cut_placed, dealt
from graphloom.functions import scalars as X
from graphloom.operators import analytics as A
from graphloom.operators import reports as P
from graphloom.operators import traversal as T
from graphloom.plans import ir
from graphloom.plans.boolean import parse, run_boolean
from graphloom.plans.text import PlanError, run_plan
from graphloom.project import open_graph
from graphloom.streaming.merge import merge_stream, prune

NODES = [(0, "function", "f", "a.rs", "public", True), (1, "function", "Main", "a.rs", "private", False), (2, "struct", "S", "a.rs", "public", None), (3, "function", "g", "b.rs", "private", True), (4, "class", "C", "b.rs", None, None)]
EDGES = [(0, 1, "calls", None), (1, 3, "calls", None), (3, 0, "calls", None), (0, 2, "type_of", "return"), (1, 2, "type_of", "parameter"), (4, 3, "contains", None), (3, 2, "wraps", "errors")]


@pytest.fixture(scope="module")
def g(spark):
    n = spark.createDataFrame(NODES, "id long, kind string, name string, path string, visibility string, address_taken boolean")
    n = n.withColumns({"qualified_name": F.col("name"), "lang": F.lit("rust"), "is_async": F.lit(False), "body_hash": F.lit(None).cast("string")})
    return open_graph(n, spark.createDataFrame(EDGES, "src long, dst long, kind string, context string"))


def ids(df):
    return sorted(r.id for r in df.collect())


@pytest.mark.parametrize(("text", "want"), [("address_taken:true", [0, 3]), ("kind:function address_taken:false", [1]), ("returns:S", [0]), ("returns:s", []), ("scope:class", [3]), ("wraps:errors", [3]), ("wraps:tracing", []), ("name~=/main/i", [1]), ("name~=/main/", [])])
def test_predicates(g, text, want):
    assert ids(run_plan(g, text)) == want


def test_predicate_that_is_not_recorded(g):
    with pytest.raises(PlanError):
        run_plan(g, "is_unsafe:true")


def test_plan_tree(g):
    p = ir.scan("function").filter("visibility", "private").union(ir.scan("class")).difference(ir.scan().filter("name", "g"))
    assert ids(ir.run(g, p)) == [1, 4] and ids(ir.run(g, p, limit=1)) == [1]
    assert ids(ir.run(g, ir.scan().filter("name", "f").traverse("forward", "calls", 1).intersect(ir.scan("function")))) == [1]
    base = ir.scan("function").filter("address_taken", "true")
    assert [ids(x) for x in ir.run_batch(g, [base, base.filter("name", "g"), base.traverse("forward", "calls", 1), ir.scan("class")])] == [[0, 3], [3], [1], [4]]  # seeds are left out
    for bad in (ir.Plan(), ir.Plan((ir.Filter("name", "f"),)), ir.scan().traverse("up", "calls", 1), ir.scan().traverse("forward", "calls", 0)):
        with pytest.raises(PlanError):
            bad.validate()
    with pytest.raises(PlanError):
        ir.run(g, p, limit=0)


def test_boolean_values(g):
    assert ids(run_boolean(g, "name:$xy", {"x": "a", "xy": "Main"})) == [1]
    assert ids(run_boolean(g, "name:$x", {"x": "f OR kind:class"})) == []
    assert ids(run_boolean(g, "callees:(kind:function AND callees:(name:f))")) == [1]
    assert ids(run_boolean(g, "circular:true AND NOT parent:C")) == [0, 1]
    for text in ("name:$x", "callees:(callees:(callees:(callees:(callees:(name:f)))))"):
        with pytest.raises(PlanError):
            parse(text)


def test_long_chains(spark):
    n = 60
    chain = spark.createDataFrame([(i, i + 1) for i in range(n)], "src long, dst long")
    labels = spark.range(0, n + 1).select("id", F.col("id").alias("component"))
    got = {r.id: r.chain for r in P.chain_depths(labels, chain, labels).collect()}
    assert got == {i: min(20, n - i) for i in range(n + 1)}
    assert T.closure(spark.range(0, 1), chain).count() == n + 1
    ring = spark.createDataFrame([(0, 1), (1, 0), (1, 2)], "src long, dst long")
    lab = spark.createDataFrame([(0, 0), (1, 0), (2, 2)], "id long, component long")
    assert {r.id: (r.out_calls, r.chain) for r in P.hotspots(lab, ring, lab).collect()} == {0: (1, 1), 1: (2, 1)}


@pytest.mark.parametrize(("plain", "hub"), [(0, 3), (1, 3), (0, 10_000), (2, 10_000)])
def test_kept_edges(spark, monkeypatch, plain, hub):
    """A walk over kept edges, with and without split sources, finds what a plain one does."""
    monkeypatch.setattr(T, "PLAIN", plain)
    monkeypatch.setattr(T, "HUB", hub)
    # 0 and 7 head most edges; 50 to 58 are a chain, 90 and 91 a part of its own
    pairs = [(0, i) for i in range(1, 30)] + [(7, i) for i in range(20, 51)] + [(i, i + 1) for i in range(50, 58)] + [(58, 0), (7, 7), (3, 7), (3, 7), (90, 91)]
    edges = spark.createDataFrame(pairs, "src long, dst long")
    if hub == 3:
        hops = T.Hops(edges)
        assert hops.split and {r.src for r in hops.hubs.collect()} == {0, 7}
    for start, way in ((0, "forward"), (57, "forward"), (29, "reverse"), (90, "both"), (1000, "both")):
        step = {"forward": pairs, "reverse": [p[::-1] for p in pairs], "both": pairs + [p[::-1] for p in pairs]}[way]
        want, front, k = {start: 0}, {start}, 0
        while front:
            k += 1
            front = {b for a, b in step if a in front} - set(want)
            want |= dict.fromkeys(front, k)
        got = T.levels(spark.range(start, start + 1), edges, None, way).collect()
        assert len(got) == len(want) and {r.id: r.level for r in got} == want
    nodes = spark.createDataFrame([(i,) for i in {x for p in pairs for x in p} | {1000}], "id long")
    assert {r.id: r.component for r in T.components(nodes, edges).collect()} == {r.id: 90 if r.id in (90, 91) else 1000 if r.id == 1000 else 0 for r in nodes.collect()}
    assert T.closure(spark.range(0), edges).isEmpty() and T.closure(spark.range(5, 6), edges.limit(0)).count() == 1


def test_kept_edges_are_not_shuffled(spark):
    """Two hops over kept edges, the second against all that was seen: its plan shuffles what is reached and nothing else."""
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        edges = spark.range(5000).selectExpr("id % 997 as src", "id as dst")
        hops, seen = T.Hops(edges), dealt(spark.range(20), "id")
        reach = lambda now: hops.follow(now.select(F.col("id").alias("src"))).select(F.col("dst").alias("id")).distinct()
        first = cut_placed(reach(seen).join(seen, "id", "left_anti"))
        plan = reach(first).join(seen.unionByName(first), "id", "left_anti")._jdf.queryExecution().toString().split("== Physical Plan ==")[1]
        assert plan.count("Exchange") == 1
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_sketches(spark):
    rows = [(i, "same", [f"t{k}" for k in range(30)]) for i in range(8)] + [(100 + i, f"h{i}", [f"t{k}" for k in range(27)] + [f"u{i}_{k}" for k in range(3)]) for i in range(2)] + [(200 + i, f"s{i}", [f"v{i}_{k}" for k in range(20)]) for i in range(60)]
    s = spark.createDataFrame(rows, "id long, hash string, tokens array<string>").select("id", "hash", P.sketch(F.col("tokens")).alias("lanes"))
    got = {(r.a, r.b): r.jaccard for r in P.lsh_pairs(s).collect()}
    assert set(got) == {(0, 100), (0, 101), (100, 101)} and all(abs(v - 27 / 33) < 0.2 for v in got.values())


def test_indirect_calls(spark):
    f = spark.createDataFrame([(i, "p" if i < 3 else "q", i not in (0, 3)) for i in range(9)], "id long, path string, address_taken boolean")
    c = spark.createDataFrame([(0, "binding_plane"), (3, "binding_plane"), (1, "direct")], "src long, resolved_via string")
    assert sorted(map(tuple, P.resolve_indirect(c, f).collect()), key=str) == [(0, 1, "type_match"), (0, 2, "type_match"), (3, None, "promiscuous")]


def test_exports(spark, g):
    d = spark.createDataFrame([('=a"b', "x,y", None)], "a string, b string, c string")
    assert d.select(P.csv_lines(d, ["a", "b", "c"])).first()[0] == '"\'=a""b","x,y",'
    assert d.select(P.csv_lines(d, ["b", "c"], "\t")).first()[0] == "x,y\t"
    assert [r.line for r in P.diagram(g.of("wraps"), g.nodes, "d2").collect()] == ['"g" -> "S": wraps']
    rows, token = X.page(g.nodes.orderBy("id"), None, 2)
    assert ids(rows) == [0, 1] and ids(X.page(g.nodes.orderBy("id"), token, 2)[0]) == [2, 3]
    with pytest.raises(ValueError):
        X.page(g.nodes, "eA", 2)


def test_rules(g):
    with pytest.raises(ValueError):
        P.load_rules("schema = 3")
    rules = P.load_rules('schema = 1\n[[rule]]\nname = "c"\nnode = "cycle_witness"\nseverity = "error"\n[[rule]]\nname = "e"\nnode = "entry_points"\n')
    assert sorted(map(str, map(tuple, P.run_rules(g, rules).collect()))) == sorted(map(str, [("c", "error", i, 0) for i in (0, 1, 3)] + [("e", "info", 0, None), ("e", "info", 2, None)]))


def test_merge_stream_goes_on_and_takes_empty_streams(spark, tmp_path):
    schema = "src long, dst long, seq long, op string"
    put = lambda rows, name: spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{tmp_path}/in/{name}")
    read = lambda: spark.readStream.schema(schema).option("recursiveFileLookup", "true").parquet(f"{tmp_path}/in")
    put([], "a")
    run = lambda: sorted(map(tuple, merge_stream(read(), ["src", "dst"], f"{tmp_path}/table").collect()))
    assert run() == []
    put([(1, 2, 1, "add"), (1, 3, 4, "add")], "b")
    assert run() == [(1, 2, 1), (1, 3, 4)]
    put([(1, 2, 5, "remove"), (1, 3, 2, "remove")], "c")
    assert run() == [(1, 3, 4)] == run()


def test_upkeep(spark):
    e = spark.sql("select id, timestamp'2024-03-10 00:00:00' - make_interval(0, 0, 0, int(id)) as ts from range(10)")
    assert ids(prune(e, 3)) == [0, 1, 2, 3]
    w = spark.createDataFrame([("2024-W01",), ("2026-W53",), ("2021-W01",)], "week string").select("week", *X.week_range(F.col("week")))
    assert sorted(map(tuple, w.collect())) == [("2021-W01", "2021-01-04", "2021-01-10"), ("2024-W01", "2024-01-01", "2024-01-07"), ("2026-W53", "2026-12-28", "2027-01-03")]
    c = A.compaction(spark.createDataFrame([("add",)], "op string").limit(0), 10, 0.2).first()
    assert tuple(c) == (0, False, False)
