"""Communities, context leaks and usage events against brute force on small inputs."""

import random
from collections import Counter
from datetime import datetime
from fractions import Fraction

import pytest

from graphloom.operators import community as C
from graphloom.project import open_graph
from graphloom.sources import usage


def partitions(items):
    if not items:
        yield []
        return
    for rest in partitions(items[1:]):
        yield [[items[0]], *rest]
        for i in range(len(rest)):
            yield [*rest[:i], [items[0], *rest[i]], *rest[i + 1 :]]


def modularity(edges, label, resolution):
    degree = Counter()
    for a, b, w in edges:
        degree[a] += w
        degree[b] += w
    total = sum(degree.values())
    inside = sum(2 * w for a, b, w in edges if label[a] == label[b])
    held = Counter()
    for x, d in degree.items():
        held[label[x]] += d
    return Fraction(inside, total) - resolution * sum(Fraction(h * h, total * total) for h in held.values())


def cliques(*groups):
    return [(a, b, 1) for x in groups for i, a in enumerate(x) for b in x[i + 1 :]]


@pytest.mark.parametrize("edges", [[*cliques("abc", "def"), ("c", "d", 1)], [*cliques("abcd", "efg"), ("a", "e", 1)], cliques("ab", "cd", "ef"), cliques("abcde")])
@pytest.mark.parametrize("resolution", [Fraction(1), Fraction(3, 4)])
def test_louvain_finds_the_best_partition(edges, resolution):
    names = sorted({x for a, b, _ in edges for x in (a, b)})
    best = max(modularity(edges, {x: min(p) for p in ps for x in p}, resolution) for ps in partitions(names))
    got = C.louvain(edges, resolution)
    assert modularity(edges, got, resolution) == best
    assert got == C.louvain([(b, a, w) for a, b, w in reversed(edges)], resolution)
    assert all(min(x for x in names if got[x] == c) == c for c in got.values())


def test_louvain_communities_hold_together():
    rng = random.Random(4)
    for _ in range(20):
        edges = [(f"n{a:02}", f"n{b:02}", rng.randint(1, 5)) for a in range(30) for b in range(a) if rng.random() < 0.1]
        got = C.louvain(edges)
        assert modularity(edges, got, Fraction(1)) >= modularity(edges, {x: x for x in got}, Fraction(1))
        for c in set(got.values()):
            seen, todo = {c}, [c]
            while todo:
                x = todo.pop()
                for a, b, _ in edges:
                    for u, v in ((a, b), (b, a)):
                        if u == x and got[v] == c and v not in seen:
                            seen.add(v)
                            todo.append(v)
            assert seen == {x for x in got if got[x] == c}
    assert C.louvain([]) == {}


def test_communities_of_files(spark):
    rng = random.Random(1)
    path = {i: rng.choice(["a", "b", "c", "d", None]) for i in range(40)}
    edges = [(rng.randrange(40), rng.randrange(40), rng.choice(["calls", "imports", "contains"])) for _ in range(120)]
    g = open_graph(spark.createDataFrame(list(path.items()), "id long, path string"), spark.createDataFrame(edges, "src long, dst long, kind string"))
    want = Counter(tuple(sorted((path[a], path[b]))) for a, b, k in edges if k != "contains" and path[a] and path[b] and path[a] != path[b])
    assert {(r.a, r.b): r.weight for r in C.file_graph(g).collect()} == dict(want)
    assert {r.path: r.community for r in C.communities(g).collect()} == C.louvain([(*k, w) for k, w in want.items()])
    with pytest.raises(ValueError, match="over 1 edges"):
        C.communities(g, most_edges=1)
    assert C.communities(open_graph(g.nodes, g.edges.filter("false"))).collect() == []


def test_context_leaks(spark):
    ctx, http = "func(ctx context.Context) error", "func(w http.ResponseWriter, r *http.Request)"
    nodes = spark.createDataFrame([(1, ctx), (2, http), (3, None), (4, ctx), (5, "func()")], "id long, signature string")
    calls = [(1, 4, 1, False, False), (1, 4, 2, False, True), (2, 4, 3, False, None), (3, 4, 4, False, False), (3, 4, 5, True, False), (2, 4, 6, True, False), (1, 5, 7, True, False), (1, 3, 8, False, False), (1, 4, 1, False, False)]
    df = spark.createDataFrame(calls, "src long, dst long, seq long, is_async boolean, threads boolean")
    got = sorted((r.seq, r["mode"]) for r in C.context_leaks(nodes, df).collect())
    assert got == [(1, "break_site"), (1, "break_site"), (3, "http_handler_leak"), (5, "unthreaded_goroutine"), (6, "unthreaded_goroutine")]
    assert [r.seq for r in C.context_leaks(nodes, df, "http_handler_leak").collect()] == [3]


def test_usage_events_come_back(spark, tmp_path):
    at = [datetime(2024, 1, d, 12, 30) for d in (1, 2, 2, 5)]
    rows = [(at[0], "find", "u", True, 3), (at[1], "find", "v", False, 5), (at[2], "graph \"q\"", None, None, None), (at[3], "find", "u", True, 1), (None, "lost", "u", True, 1)]
    folder = str(tmp_path / "events")
    df = spark.createDataFrame(rows, usage.SCHEMA)
    usage.write_events(df.filter("ts < '2024-01-05' or ts is null"), folder)
    usage.write_events(df.filter("ts >= '2024-01-05'"), folder)
    key = lambda r: str(r)
    assert sorted(map(tuple, usage.read_events(spark, folder).collect()), key=key) == sorted(rows, key=key)
    assert {r.ts for r in usage.read_events(spark, folder, "2024-01-02").collect()} == {*at[1:]}
    got = {r.command: (r.n, r.failed, r["last"]) for r in usage.history(df).collect()}
    assert got == {"find": (3, 1, at[3]), 'graph "q"': (1, 0, at[2]), "lost": (1, 0, None)}
    usage.write_events(spark.createDataFrame([(at[0], "again", "u", True, 1)], usage.SCHEMA), folder, "overwrite")
    assert sorted(r.command for r in usage.read_events(spark, folder).collect()) == ["again", "find", "find", 'graph "q"', "lost"]
    q = usage.stream_events(spark, folder, 1000).writeStream.format("memory").queryName("usage_rows").option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
    q.awaitTermination(90)
    assert spark.table("usage_rows").count() == 5
