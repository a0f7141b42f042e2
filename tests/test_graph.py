"""Operators on a nine-node graph whose answers are known by hand."""

import pytest
from pyspark.sql import functions as F

from graphloom.functions import scalars as X
from graphloom.operators import analytics as A
from graphloom.operators import relations as R
from graphloom.operators import traversal as T
from graphloom.plans.boolean import parse as parse_boolean
from graphloom.plans.boolean import run_boolean
from graphloom.plans.text import PlanError, format_plan, parse, run_plan
from graphloom.project import open_graph

NODES = [(0, "function", "parse_expr", "src/lib.rs", "public"), (1, "function", "parse_stmt", "src/lib.rs", "public"), (2, "function", "internal_helper", "src/lib.rs", "private"), (3, "struct", "Parser", "src/lib.rs", "public"), (4, "trait", "Visitor", "src/lib.rs", "public"), (5, "function", "run", "src/lib.rs", "public"), (6, "function", "main", "src/bin.rs", "private"), (7, "struct", "VisitorImpl", "src/bin.rs", "private"), (8, "function", "imports_lib", "src/bin.rs", "private")]
EDGES = [(6, 0, "calls", "direct"), (6, 1, "calls", "direct"), (0, 2, "calls", "direct"), (0, 3, "references", None), (7, 4, "implements", None), (8, 3, "imports", None), (5, 6, "exports", None)]


@pytest.fixture(scope="module")
def g(spark):
    nodes = spark.createDataFrame([(*n, n[2], None, False) for n in NODES], "id long, kind string, name string, path string, visibility string, qualified_name string, lang string, is_async boolean")
    return open_graph(nodes, spark.createDataFrame(EDGES, "src long, dst long, kind string, resolved_via string"))


def ids(df):
    return sorted(r[0] for r in df.select("id").collect())


@pytest.mark.parametrize(("direction", "depth", "seed", "want"), [("forward", 2, 6, [0, 1, 2]), ("forward", 1, 6, [0, 1]), ("reverse", 1, 0, [6])])
def test_traverse(g, direction, depth, seed, want):
    assert ids(T.traverse(g.nodes.filter(F.col("id") == seed), g.of("calls"), depth, direction)) == want


def test_traverse_both_any(g):
    assert ids(T.traverse(g.nodes.filter("id = 0"), g.edges, 1, "both")) == [2, 3, 6]


@pytest.mark.parametrize(("text", "want"), [("has:caller", [0, 1, 2]), ("has:callee", [0, 6]), ("kind:function unused", [5, 6, 8]), ("kind:function in:**/bin.rs", [6, 8]), ("callers:main", [0, 1]), ("callees:internal_helper", [0]), ("name:main traverse:forward(calls,2)", [0, 1, 2]), ("exports:run", [6]), ("implements:Visitor", [7])])
def test_plan_text(g, text, want):
    assert ids(run_plan(g, text)) == want
    assert parse(format_plan(parse(text))) == parse(text)


@pytest.mark.parametrize("text", ["", "kind:function | count", "nonsense:1"])
def test_plan_errors(g, text):
    with pytest.raises(PlanError):
        run_plan(g, text)


def test_boolean(g):
    assert ids(run_boolean(g, "kind:struct OR (kind:function AND NOT callers:main AND visibility:public)")) == [3, 5, 7]
    assert run_boolean(g, "kind:function | top 1 kind | count").collect()[0][0] == 6
    pairs = run_boolean(g, "(name:main) CALLS (name:parse)").collect()
    assert sorted(map(tuple, pairs)) == [(6, 0), (6, 1)]
    assert ids(run_boolean(g, "name:$x", {"x": "main"})) == [6]
    assert parse_boolean("NOT (kind:a AND kind:b)")[0] == "not"


def test_scc_components_paths(spark):
    e = spark.createDataFrame([(1, 2), (2, 3), (3, 1), (3, 4), (4, 5), (5, 4), (6, 1), (7, 7)], "src long, dst long")
    got = dict(map(tuple, T.scc(e).collect()))
    assert got == {1: 1, 2: 1, 3: 1, 4: 4, 5: 4, 6: 6}
    assert sorted(r[0] for r in T.cycles(e, self_loops=True, least=2).collect()) == [1, 4]
    nodes = spark.range(1, 9)
    assert {r.id: r.component for r in T.components(nodes, e).collect()} == {1: 1, 2: 1, 3: 1, 4: 1, 5: 1, 6: 1, 7: 7, 8: 8}
    p = T.paths(nodes.filter("id = 6"), nodes.filter("id = 4"), e, 4)
    assert [r.path for r in p.collect()] == [[6, 1, 2, 3, 4]]


def test_latest_writes(spark):
    d = spark.createDataFrame([(1, 2, 1, "add"), (1, 2, 5, "remove"), (1, 3, 2, "remove"), (1, 3, 4, "add")], "src long, dst long, seq long, op string")
    assert [tuple(r) for r in A.latest_writes(d, ["src", "dst"], [F.col("seq")]).collect()] == [(1, 3, 4)]


def test_scalars(spark):
    r = spark.sql("select '/a//b/{id}/<int:n>?q=1' u, 'martha' a, 'marhta' b, 'a::b::c' q")
    row = r.select(X.url_path(F.col("u")), X.jaro_winkler(F.col("a"), F.col("b")), R.segment_match(F.col("q"), "c"), R.segment_match(F.col("q"), "::c")).first()
    assert row[0] == "/a/b/:id/:n" and abs(row[1] - 0.9611) < 1e-4 and row[2] and not row[3]
