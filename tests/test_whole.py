"""The queries over the whole graph, which have no SQL, against brute force on small graphs."""

import random

import pytest
from pyspark.sql import functions as F

from graphloom import catalog, catalog_reports, project
from graphloom.operators import analytics as A
from graphloom.operators import traversal as T
from graphloom.project import open_graph

# ids of several tables: customer, order, supplier, user, turn
IDS = [k * 1_000_000_000 + i for k in (3, 6, 4, 7, 9) for i in range(1, 7)]


def reach(pairs, both=False):
    step = {i: {i} for i in IDS}
    for a, b in pairs:
        step[a].add(b)
        if both:
            step[b].add(a)
    while True:
        wider = {i: set().union(*(step[j] for j in r)) for i, r in step.items()}
        if wider == step:
            return step
        step = wider


@pytest.fixture(scope="module")
def small(spark):
    rng = random.Random(2)
    calls = [(rng.choice(IDS), rng.choice(IDS)) for _ in range(44)]
    contains = [(rng.choice(IDS), rng.choice(IDS)) for _ in range(14)]
    nodes = spark.createDataFrame([(i, "other" if i > 9_000_000_000 else "function") for i in IDS], "id long, kind string")
    edges = spark.createDataFrame([(*e, "calls") for e in calls] + [(*e, "contains") for e in contains], "src long, dst long, kind string")
    return open_graph(nodes, edges), calls, contains


def rows(df, *cols):
    return sorted(tuple(r) for r in df.select(*cols).collect())


def test_scc_queries_take_every_call(small):
    g, calls, _ = small
    to = reach(calls)
    label = {i: min(j for j in IDS if j in to[i] and i in to[j]) for i in IDS}
    size = {c: sum(x == c for x in label.values()) for c in label.values()}
    assert len({*size.values()}) > 1
    assert any(n > 1 and c < 7_000_000_000 for c, n in size.items())
    assert rows(catalog.scc_labels(g), "id", "component") == sorted(label.items())
    assert rows(catalog.cycles_bounded(g), "component", "size") == sorted((c, n) for c, n in size.items() if n > 1)
    assert rows(catalog.is_in_cycle(g), "id", "in_cycle") == sorted((i, size[c] > 1) for i, c in label.items())
    assert rows(catalog.condensation(g), "src", "dst") == sorted({(label[a], label[b]) for a, b in calls if label[a] != label[b]})


def test_components_take_every_node(small):
    g, _, contains = small
    assert rows(catalog.components(g), "id", "component") == sorted((i, min(r)) for i, r in reach(contains, both=True).items())


def test_scc_raises_when_it_does_not_settle(spark):
    chain = spark.createDataFrame([(i, i + 1) for i in range(1, 9)], "src long, dst long")
    with pytest.raises(RuntimeError, match="settle"):
        T.scc(chain, most=1).collect()


def jobs_of(spark, name, run):
    spark.sparkContext.setJobGroup(name, name)
    try:
        return run(), len(spark.sparkContext.statusTracker().getJobIdsForGroup(name))
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)


@pytest.fixture
def long_ring(spark):
    """A ring of 120 callers, the last of whom starts a chain of 30 calls: its hops must not each take jobs of their own."""
    ring = [(i, i % 120 + 1) for i in range(1, 121)] + [(120 + i, 121 + i) for i in range(30)]
    nodes = spark.range(1, 152).withColumn("kind", F.lit("function"))
    return open_graph(nodes, spark.createDataFrame([(a, b, "calls") for a, b in ring], "src long, dst long, kind string"))


LABEL = {i: 1 if i <= 120 else i for i in range(1, 152)}
#: What the queries give on the long ring, and the jobs they may take.
RING = {
    "scc_labels": (["id", "component"], sorted(LABEL.items()), 60),
    "call_chain_depth": (["id", "chain"], [(i, max(0, min(20, 150 - max(i, 120)))) for i in range(1, 152)], 200),
    "condensation": (["src", "dst"], [(1, 121)] + [(i, i + 1) for i in range(121, 150)], 60),
    "cycles_bounded": (["component", "size"], [(1, 120)], 60),
    "hotspots": (["id", "out_calls", "chain"], [(i, 1 + (i == 120), min(20, 150 - max(i, 120))) for i in range(1, 150)], 200),
    "is_in_cycle": (["id", "in_cycle"], [(i, i <= 120) for i in range(1, 152)], 60),
    "rule_cycles": (["id", "witness"], [(i, 1) for i in range(1, 121)], 60),
}


@pytest.mark.parametrize("name", RING)
def test_long_ring_takes_few_jobs(spark, long_ring, name):
    cols, want, most = RING[name]
    query = getattr(catalog, name, None) or getattr(catalog_reports, name)
    got, jobs = jobs_of(spark, f"ring-{name}", lambda: rows(query(long_ring), *cols))
    assert got == want
    assert jobs < most, jobs


@pytest.mark.parametrize("task", [0, 10**6])
def test_scc_by_rounds_and_in_one_task(spark, monkeypatch, task):
    monkeypatch.setattr(T, "TASK", task)
    rng = random.Random(5)
    pairs = [(rng.choice(IDS), rng.choice(IDS)) for _ in range(40)]
    to = reach(pairs)
    want = {i: min(j for j in IDS if j in to[i] and i in to[j]) for p in pairs if p[0] != p[1] for i in p}
    assert dict(map(tuple, T.scc(spark.createDataFrame(pairs, "src long, dst long")).collect())) == want


def distance(a, b):
    row = range(len(b) + 1)
    for i, x in enumerate(a, 1):
        last, row = row, [i]
        for j, y in enumerate(b, 1):
            row.append(min(last[j] + 1, row[-1] + 1, last[j - 1] + (x != y)))
    return row[-1]


def test_renames_by_score_alone(spark):
    rng = random.Random(7)
    sigs = [None, None, "", "fn(a: i32) -> i32", "fn(a: i64) -> i32", "fn(b)", "x" * 80, "x" * 79 + "y", "x" * 78 + "yz"]
    side = lambda p, n: [(f"{p}{i}", rng.choice(["function", "struct"]), rng.choice(sigs), rng.choice(["f", "g"]), rng.randrange(1, 90)) for i in range(n)]
    gone, come = side("old", 40), side("new", 40)
    want = {}
    for q, kind, sig, path, line in gone:
        for q2, kind2, sig2, path2, line2 in come:
            if kind != kind2 or (sig is None) != (sig2 is None):
                continue
            longer = max(len(sig or ""), len(sig2 or ""))
            like = 1 - distance(sig or "", sig2 or "") / longer if longer else 1.0
            far = abs(line - line2)
            place = 0.7 if path != path2 else 1 - min(far / 100, 0.5) if far <= 50 else 0.3
            if like >= 0.7 and 0.7 * like + 0.3 * place >= 0.9:
                want[q, q2] = pytest.approx(0.7 * like + 0.3 * place, abs=1e-6)
    schema = "qualified_name string, kind string, signature string, path string, start_line long"
    got = A.renames(spark.createDataFrame(gone, schema), spark.createDataFrame(come, schema)).collect()
    assert len(got) == len(want) and {(r.old_name, r.new_name): r.score for r in got} == want
    null = {q for q, _, sig, *_ in gone if sig is None}
    assert any(a in null for a, _ in want) and any(a not in null and abs(s.expected - 0.91) > 1e-3 and s.expected < 1 for (a, _), s in want.items())


def test_diff_takes_every_node(spark):
    nodes = [(k * 1_000_000_000 + i, kind) for k, kind in ((1, "module"), (2, "class"), (6, "function"), (7, "function"), (8, "function"), (9, "other")) for i in range(120)]
    rows_ = [(i, kind, f"n{i}", f"q{i}", "p", None, 1, 2) for i, kind in nodes]
    g = open_graph(spark.createDataFrame(rows_, "id long, kind string, name string, qualified_name string, path string, signature string, start_line long, end_line long"), None)
    want = {}
    for i, _ in nodes:
        if i % 97 == 0 or i % 101 == 0:
            want[f"q{i}"] = "removed"
            if i % 97:
                want[f"q{i}_new"] = "added"
        elif i % 89 == 0 or i % 83 == 0:
            want[f"q{i}"] = "signature_changed" if i % 89 == 0 else "modified"
    assert rows(catalog.diff_changes(g), "qualified_name", "change") == sorted(want.items())
    assert rows(catalog.diff_summary(g), "change", "n") == sorted((c, [*want.values()].count(c)) for c in {*want.values()})
    kind = {f"q{i}": k for i, k in nodes} | {f"q{i}_new": k for i, k in nodes}
    pairs = [(a, b) for a, x in want.items() if x == "removed" for b, y in want.items() if y == "added" and kind[a] == kind[b]]
    assert rows(catalog.rename_candidates(g), "old_name", "new_name") == sorted(pairs)


def test_renames_of_one_signature_are_paired_by_many_tasks(spark):
    """A large group without signatures: every pair comes, and no task makes most of them."""
    gone, come = (spark.range(n).selectExpr(f"concat('{p}', id) as qualified_name", "'function' as kind", "cast(null as string) as signature", f"concat('{p}', id % 3) as path", "id as start_line") for p, n in (("old", 1000), ("new", 40)))
    found = A.renames(gone, come)
    tasks = [r[0] for r in found.groupBy(F.spark_partition_id()).count().select("count").collect()]
    assert sum(tasks) == 40_000 and found.distinct().count() == 40_000
    assert max(tasks) < 30_000


def _unsigned(spark, *sizes):
    return (spark.range(n).selectExpr(f"concat('{p}', id) as qualified_name", "'function' as kind", "cast(null as string) as signature", f"concat('p', id % 3) as path", "id as start_line") for p, n in zip(("old", "new"), sizes))


def test_renames_shuffle_no_more_than_the_nodes_ask_for(spark):
    """18 million pairs of 9,000 nodes: what is shuffled grows with the nodes, not with their pairs."""
    found = A.renames(*_unsigned(spark, 6000, 3000)).groupBy().agg(F.count("*"))
    want = 3000 * 6000
    got = found.collect()[0][0]

    def records(p):
        below = p.executedPlan() if p.nodeName() == "AdaptiveSparkPlan" else p.plan() if "QueryStage" in p.nodeName() else None
        inner = [below] if below else [p.children().apply(i) for i in range(p.children().size())]
        return (p.metrics().apply("shuffleRecordsWritten").value() if p.nodeName() == "Exchange" else 0) + sum(map(records, inner))

    same = 2000 * 3000  # the pairs of one file, of which few are near enough
    assert want - same < got <= want
    assert records(found._jdf.queryExecution().executedPlan()) < 60_000


def test_renames_in_a_grid_of_many_cells_are_all_pairs(spark, monkeypatch):
    for name, n in (("SHARE", 16), ("LEAST", 4), ("BLOCK", 4)):
        monkeypatch.setattr(A, name, n)
    gone, come = (d.withColumn("signature", F.when(F.col("start_line") % 4 > 0, F.concat(F.lit("abcdefghij"), (F.col("start_line") % 2).cast("string")))) for d in _unsigned(spark, 150, 100))
    o, n = (d.select(*[F.col(c).alias(f"{p}_{c}") for c in d.columns]) for d, p in ((gone, "o"), (come, "n")))
    score = A.rename_score(F.col("o_signature"), F.col("n_signature"), F.col("o_path"), F.col("n_path"), F.abs(F.col("o_start_line") - F.col("n_start_line")))
    want = o.crossJoin(n).filter("(o_signature is null) = (n_signature is null)").withColumn("s", score).filter("s >= 0.9").selectExpr("o_qualified_name", "n_qualified_name", "round(s, 6)")
    assert want.select("round(s, 6)").distinct().count() > 3
    assert sorted(map(tuple, A.renames(gone, come).collect())) == sorted(map(tuple, want.collect()))


def test_nodes_are_saved_without_edges_for_a_query_of_nodes(spark, tmp_path):
    for name in project.TABLES:
        (tmp_path / f"{name}.parquet").symlink_to(f"/root/testdata/sf0.001/{name}.parquet")
    alone = project.load(spark, str(tmp_path), edges=False)
    assert alone.edges is None and project.load(spark, str(tmp_path), edges=False) is alone
    whole = project.load(spark, str(tmp_path))
    assert whole.edges.count() == project.projected(spark, str(tmp_path)).edges.count()
    assert whole.nodes.count() == alone.nodes.count() == project.projected(spark, str(tmp_path)).nodes.count()


def test_condensation_leaves_out_calls_of_no_node(spark):
    """As its SQL: a call whose target is in no table is no edge between components."""
    nodes = spark.createDataFrame([(i, "function") for i in (1, 2, 3, 3)], "id long, kind string")
    g = open_graph(nodes, spark.createDataFrame([(a, b, "calls") for a, b in ((1, 2), (2, 1), (2, 3), (3, 99))], "src long, dst long, kind string"))
    assert rows(catalog.scc_labels(g), "id", "component") == [(1, 1), (2, 1), (3, 3)]
    assert rows(catalog.condensation(g), "src", "dst") == [(1, 3)]


def test_scc_takes_edges_that_are_never_null(spark):
    ring = spark.range(5).select(F.col("id").alias("src"), ((F.col("id") + 1) % 5).alias("dst"))
    ring = ring.select("src", F.coalesce("dst", F.lit(0)).alias("dst"))
    assert rows(T.scc(ring), "id", "component") == [(i, 0) for i in range(5)]


@pytest.mark.parametrize("name", ["cycles_bounded", "is_in_cycle", "rule_cycles"])
def test_cycles_are_found_without_a_label_for_every_node(spark, long_ring, monkeypatch, name):
    def labelled(*_):
        raise AssertionError("labels every node")

    for maker in ("scc", "labelled"):
        monkeypatch.setattr(T, maker, labelled, raising=False)
    cols, want, _ = RING[name]
    query = getattr(catalog, name, None) or getattr(catalog_reports, name)
    assert rows(query(long_ring), *cols) == want


def test_hotspots_finish_chains_in_one_task(spark, long_ring):
    cols, want, _ = RING["hotspots"]
    got, jobs = jobs_of(spark, "chains", lambda: rows(catalog_reports.hotspots(long_ring), *cols))
    assert got == want
    assert jobs < 60, jobs


@pytest.mark.parametrize("task", [0, 3, 10**6])
def test_chains_by_rounds_and_in_one_task(spark, monkeypatch, task):
    monkeypatch.setattr(T, "TASK", task)
    calls = spark.createDataFrame([(i, i + 1) for i in range(8)] + [(0, 5)], "src long, dst long")
    labels = spark.range(10).select("id", F.col("id").alias("component"))
    assert rows(catalog_reports.P.chain_depths(labels, calls, labels, 6), "id", "chain") == [(i, max(0, min(6, 8 - i))) for i in range(10)]
