"""The registered graph queries with the SQL that says the same over the same projection."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .core import cut
from .functions import scalars as X
from .operators import analytics as A
from .operators import relations as R
from .operators import traversal as T
from .project import Graph
from .registry import QUERIES, SQL, graph_query, table_query

def _functions(g: Graph) -> DataFrame:
    return g.nodes.filter("kind = 'function'")


def _ids(df: DataFrame) -> DataFrame:
    return df.select("id")


def _named(g: Graph, name: str) -> DataFrame:
    return g.nodes.filter(F.col("name") == name)


U = "('calls','references','imports','inherits','implements','type_of')"


@graph_query("SELECT id, kind, name, path FROM nodes WHERE kind = 'function' AND visibility = 'private' AND name LIKE 'S%'")
def scan_kind_visibility_name(g):
    return g.nodes.filter((F.col("kind") == "function") & (F.col("visibility") == "private") & R.name_matches(F.col("name"), "S", "prefix")).select("id", "kind", "name", "path")


@graph_query("SELECT id FROM nodes WHERE kind IN ('method','function') AND regexp_full_match(path, '(.*/)?[^/]*A[^/]*/.*')")
def filter_path_glob(g):
    return _ids(g.nodes.filter(F.col("kind").isin("method", "function") & F.col("path").rlike(R.glob("**/*A*/**"))))


@graph_query("SELECT id, name = 'turn_3' AS exact, name LIKE 'order_1%' AS prefix, name LIKE '%7' AS suffix, name LIKE '%ring%' AS contains, lower(name) = 'blue bolt' AS caseless, regexp_full_match(name, 'user_[^/]') AS glob FROM nodes WHERE kind <> 'module'")
def filter_name_modes(g):
    n = F.col("name")
    modes = [R.name_matches(n, "turn_3").alias("exact"), R.name_matches(n, "order_1", "prefix").alias("prefix"), R.name_matches(n, "7", "suffix").alias("suffix"), R.name_matches(n, "ring", "contains").alias("contains"), R.name_matches(n, "BLUE bolt", "exact", True).alias("caseless"), R.name_matches(n, "user_?").alias("glob")]
    return g.nodes.filter("kind <> 'module'").select("id", *modes)


@graph_query("SELECT id FROM nodes WHERE is_async AND kind = 'function'")
def filter_flags(g):
    return _ids(_functions(g).filter("is_async"))


@graph_query("SELECT id FROM nodes WHERE kind = 'function' AND EXISTS (SELECT 1 FROM edges WHERE edges.kind = 'calls' AND dst = id)")
def has_caller(g):
    return _ids(R.with_incoming(_functions(g), g.of("calls")))


@graph_query("SELECT id FROM nodes WHERE EXISTS (SELECT 1 FROM edges WHERE edges.kind = 'calls' AND src = id)")
def has_callee(g):
    return _ids(R.with_outgoing(g.nodes, g.of("calls")))


@graph_query(f"SELECT id FROM nodes WHERE kind IN ('function','struct') AND NOT EXISTS (SELECT 1 FROM edges WHERE edges.kind IN {U} AND dst = id)")
def unused_inbound(g):
    return _ids(R.without_incoming(g.nodes.filter(F.col("kind").isin("function", "struct")), g.of(*R.USES)))


@graph_query("SELECT id FROM nodes WHERE id IN (SELECT dst FROM edges JOIN nodes s ON s.id = src WHERE edges.kind = 'calls' AND s.name LIKE 'order_12%')")
def pred_callers(g):
    return _ids(R.targets_of(g, g.nodes, g.nodes.filter(R.name_matches(F.col("name"), "order_12*")), "calls"))


@graph_query("SELECT id FROM nodes WHERE id IN (SELECT src FROM edges JOIN nodes t ON t.id = dst WHERE edges.kind = 'calls' AND t.visibility = 'private')")
def pred_callees(g):
    return _ids(R.sources_of(g, g.nodes, g.nodes.filter("visibility = 'private'"), "calls"))


@graph_query("SELECT DISTINCT src AS id FROM edges WHERE kind = 'calls' AND dst = 4000000007")
def direct_callers(g):
    return _ids(R.sources_of(g, g.nodes, g.nodes.filter("id = 4000000007"), "calls"))


@graph_query("SELECT DISTINCT dst AS id FROM edges WHERE kind = 'calls' AND src = 6000000007")
def direct_callees(g):
    return _ids(R.targets_of(g, g.nodes, g.nodes.filter("id = 6000000007"), "calls"))


@graph_query("SELECT id FROM nodes WHERE id IN (SELECT src FROM edges WHERE kind = 'imports' AND dst IN (4000000003, 4000000004))")
def imports_of(g):
    return _ids(R.sources_of(g, g.nodes, g.nodes.filter("id in (4000000003, 4000000004)"), "imports"))


@graph_query("SELECT id FROM nodes WHERE id IN (SELECT dst FROM edges WHERE kind = 'exports' AND src = 2000000003 AND src <> dst UNION SELECT src FROM edges WHERE kind = 'exports' AND dst = 2000000003 AND src <> dst)")
def exports_either_side(g):
    return _ids(R.either_side(g, g.nodes, g.nodes.filter("id = 2000000003"), "exports"))


@graph_query("SELECT id FROM nodes WHERE id IN (SELECT dst FROM edges JOIN nodes s ON s.id = src WHERE edges.kind IN ('calls','references','imports','ffi_call') AND regexp_matches(s.name, '^order_[12]0+$'))")
def references_regex(g):
    return _ids(R.targets_of(g, g.nodes, g.nodes.filter(F.col("name").rlike("^order_[12]0+$")), "calls", "references", "imports", "ffi_call"))


@graph_query("SELECT id FROM nodes WHERE id IN (SELECT src FROM edges JOIN nodes t ON t.id = dst WHERE edges.kind = 'implements' AND t.qualified_name LIKE 'Brand#1%')")
def implements_of(g):
    return _ids(R.sources_of(g, g.nodes, g.nodes.filter(F.col("qualified_name").startswith("Brand#1")), "implements"))


@graph_query("SELECT id, EXISTS (SELECT 1 FROM edges WHERE edges.kind = 'calls' AND src = id AND resolved_via = 'type_match') AS one, EXISTS (SELECT 1 FROM edges WHERE edges.kind = 'calls' AND src = id AND resolved_via IN ('type_match','binding_plane')) AS several FROM nodes WHERE kind = 'function'")
def resolved_via_any(g):
    calls = g.of("calls")
    out = R.flag(_functions(g), calls.filter("resolved_via = 'type_match'").select(F.col("src").alias("id")), "one")
    return R.flag(out, calls.filter("resolved_via in ('type_match', 'binding_plane')").select(F.col("src").alias("id")), "several").select("id", "one", "several")


@graph_query("SELECT id FROM nodes WHERE kind = 'function' AND (EXISTS (SELECT 1 FROM edges WHERE edges.kind = 'calls' AND dst = id) OR coalesce(visibility = 'private', FALSE)) AND NOT (EXISTS (SELECT 1 FROM edges WHERE edges.kind = 'imports' AND dst = id) AND is_async = FALSE AND coalesce(visibility = 'public', FALSE))")
def bool_and_or_not(g):
    n = R.flag(_functions(g), g.of("calls").select(F.col("dst").alias("id")), "called")
    n = R.flag(n, g.of("imports").select(F.col("dst").alias("id")), "imported")
    yes = lambda c: F.coalesce(c, F.lit(False))
    return _ids(n.filter((F.col("called") | yes(F.col("visibility") == "private")) & ~(F.col("imported") & ~F.col("is_async") & yes(F.col("visibility") == "public"))))


@graph_query("SELECT id FROM nodes WHERE id IN (SELECT src FROM edges WHERE kind = 'calls' AND dst IN (SELECT dst FROM edges WHERE kind = 'imports' AND src IN (SELECT id FROM nodes WHERE name = 'blue bolt')))")
def subquery_value(g):
    inner = R.targets_of(g, g.nodes, _named(g, "blue bolt"), "imports")
    return _ids(R.sources_of(g, g.nodes, inner, "calls"))


_A, _B = "SELECT id FROM nodes WHERE kind = 'method' AND visibility = 'private'", "SELECT src AS id FROM edges WHERE kind = 'calls'"


def _sets(g):
    return g.nodes.filter("kind = 'method' and visibility = 'private'"), g.of("calls").select(F.col("src").alias("id"))


@graph_query(f"{_A} UNION {_B}")
def set_union(g):
    return R.union(*_sets(g))


@graph_query(f"{_A} INTERSECT {_B}")
def set_intersect(g):
    return R.intersect(*_sets(g))


@graph_query(f"{_B} EXCEPT {_A}")
def set_difference(g):
    private, callers = _sets(g)
    return R.difference(callers, private)


@graph_query("SELECT DISTINCT e.src AS left_id, e.dst AS right_id FROM edges e JOIN nodes l ON l.id = e.src JOIN nodes r ON r.id = e.dst WHERE e.kind = 'calls' AND l.kind = 'method'")
def edge_join_calls(g):
    return R.edge_join(g, g.nodes.filter("kind = 'method'"), g.nodes, "calls")


@graph_query("SELECT DISTINCT e.src AS left_id, e.dst AS right_id FROM edges e JOIN nodes l ON l.id = e.src JOIN nodes r ON r.id = e.dst WHERE e.kind = 'inherits' AND l.name LIKE 'red%' AND r.path LIKE 'Brand#1%'")
def edge_join_filtered(g):
    return R.edge_join(g, g.nodes.filter("name like 'red%'"), g.nodes.filter("path like 'Brand#1%'"), "inherits")


@graph_query("SELECT count(*) AS n FROM nodes WHERE kind = 'function'")
def pipe_count(g):
    return _functions(g).agg(F.count("*").alias("n"))


@graph_query("SELECT coalesce(visibility, 'unspecified') AS value, count(*) AS n FROM nodes GROUP BY 1")
def pipe_group_by(g):
    return A.group_by(g.nodes, "visibility")


@graph_query("SELECT coalesce(name, '<anonymous>') AS value, count(*) AS n FROM nodes GROUP BY 1 ORDER BY n DESC, value LIMIT 7")
def pipe_top_n(g):
    return A.top(g.nodes, 7, "name")


@graph_query("SELECT 'kind' AS section, kind AS value, count(*) AS n FROM nodes GROUP BY 2 UNION ALL SELECT 'lang', coalesce(lang, 'unknown'), count(*) FROM nodes GROUP BY 2 UNION ALL SELECT 'visibility', coalesce(visibility, 'unspecified'), count(*) FROM nodes GROUP BY 2 UNION ALL SELECT 'total', 'all', count(*) FROM nodes")
def pipe_stats(g):
    return A.stats(g.nodes)


@graph_query("SELECT count(*) AS symbols, count(DISTINCT path) AS files, count(DISTINCT kind) AS kinds, (SELECT count(*) FROM edges) AS edges FROM nodes")
def graph_stats(g):
    return g.nodes.agg(F.count("*").alias("symbols"), F.countDistinct("path").alias("files"), F.countDistinct("kind").alias("kinds")).join(g.edges.agg(F.count("*").alias("edges")))


@graph_query("SELECT (SELECT count(*) FROM (SELECT DISTINCT src, dst FROM edges WHERE kind = 'calls' AND src < dst) a WHERE EXISTS (SELECT 1 FROM edges b WHERE b.kind = 'calls' AND b.src = a.dst AND b.dst = a.src)) AS two_cycles, (SELECT count(*) FROM nodes WHERE id IN (SELECT src FROM edges WHERE kind = 'calls') AND id NOT IN (SELECT dst FROM edges WHERE kind = 'calls')) AS no_callers, (SELECT count(*) FROM (SELECT name FROM nodes GROUP BY name HAVING count(*) > 1) d) AS repeated_names")
def insight_estimates(g):
    c = g.of("calls").select("src", "dst").distinct()
    two = c.filter("src < dst").intersect(c.select(F.col("dst").alias("src"), F.col("src").alias("dst"))).agg(F.count("*").alias("two_cycles"))
    idle = R.without_incoming(R.with_outgoing(g.nodes, c), c).agg(F.count("*").alias("no_callers"))
    names = g.nodes.groupBy("name").count().filter("count > 1").agg(F.count("*").alias("repeated_names"))
    return two.join(idle).join(names)


@graph_query("SELECT id, n.kind, name, coalesce(fan_in, 0) AS fan_in, coalesce(fan_out, 0) AS fan_out, coalesce(fan_in, 0) AS score FROM nodes n LEFT JOIN (SELECT dst, count(*) AS fan_in FROM edges WHERE kind IN ('calls','references') GROUP BY dst) i ON i.dst = id LEFT JOIN (SELECT src, count(*) AS fan_out FROM edges WHERE kind IN ('calls','references') GROUP BY src) o ON o.src = id WHERE n.kind IN ('function','method','struct','class','trait') ORDER BY score DESC, n.kind, name, id LIMIT 10")
def hubs(g):
    return A.hubs(g).select("id", "kind", "name", "fan_in", "fan_out", "score")


_BUCKET = "array_to_string(string_split(path, '/')[1:2], '/')"


@graph_query("SELECT s.bucket, size, coalesce(internal_edges, 0) AS internal_edges, hub FROM (SELECT bucket, count(*) AS size, arg_max(id, coalesce(f, 0) * 100000000000 - id) AS hub FROM b LEFT JOIN (SELECT dst, count(*) AS f FROM edges WHERE kind IN ('calls','imports','references') GROUP BY dst) i ON dst = id GROUP BY bucket) s LEFT JOIN (SELECT x.bucket, count(*) AS internal_edges FROM edges JOIN b x ON x.id = src JOIN b y ON y.id = dst WHERE kind IN ('calls','imports','references') AND x.bucket = y.bucket GROUP BY x.bucket) e ON e.bucket = s.bucket", f"b AS (SELECT id, {_BUCKET} AS bucket FROM nodes)")
def subsystems(g):
    return A.subsystems(g)


@graph_query("SELECT x.bucket, y.bucket AS target, kind, count(*) AS n FROM edges JOIN b x ON x.id = src JOIN b y ON y.id = dst WHERE kind IN ('calls','imports','references') GROUP BY 1, 2, 3", f"b AS (SELECT id, {_BUCKET} AS bucket FROM nodes)")
def couplings(g):
    return A.couplings(g)


@graph_query("SELECT id, 1 + coalesce(c, 0) // 5 + (end_line - start_line) // 20 AS complexity FROM nodes LEFT JOIN (SELECT src, count(*) AS c FROM edges WHERE kind = 'calls' GROUP BY src) o ON src = id WHERE kind IN ('function','method')")
def complexity(g):
    c = g.of("calls").groupBy(F.col("src").alias("id")).agg(F.count("*").alias("c"))
    return g.nodes.filter("kind in ('function', 'method')").join(c, "id", "left").selectExpr("id", "1 + coalesce(c, 0) div 5 + (end_line - start_line) div 20 as complexity")


@graph_query("SELECT a.kind AS from_kind, b.kind AS to_kind, e.kind AS kind, count(*) AS n FROM edges e JOIN nodes a ON a.id = src JOIN nodes b ON b.id = dst WHERE a.kind <> b.kind GROUP BY 1, 2, 3")
def cross_kind_edges(g):
    k = g.nodes.select("id", "kind")
    e = g.edges.join(k.select(F.col("id").alias("src"), F.col("kind").alias("from_kind")), "src").join(k.select(F.col("id").alias("dst"), F.col("kind").alias("to_kind")), "dst")
    return e.filter("from_kind <> to_kind").groupBy("from_kind", "to_kind", "kind").agg(F.count("*").alias("n"))


@graph_query("SELECT id, (SELECT count(*) FROM edges WHERE edges.kind = 'calls' AND dst = id) AS fan_in, (SELECT count(*) FROM edges WHERE edges.kind = 'calls' AND src = id) AS fan_out FROM nodes WHERE name IN ('order_5', 'order_6', 'user_9')")
def batch_counts(g):
    some = g.nodes.filter(F.col("name").isin("order_5", "order_6", "user_9")).select("id")
    return some.join(A.degrees(g, "calls"), "id", "left").select("id", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("fan_in", "fan_out")])


@graph_query("SELECT body_hash, count(*) AS size, array_to_string(list(CAST(id AS VARCHAR) ORDER BY path, name, id)[1:10], ',') AS members FROM nodes WHERE body_hash IS NOT NULL GROUP BY 1 HAVING count(*) > 1 ORDER BY size DESC, body_hash LIMIT 1000")
def duplicates_body(g):
    return A.duplicates(g.nodes.filter("body_hash is not null"), ["body_hash"])


@graph_query("SELECT signature, kind, count(*) AS size, array_to_string(list(CAST(id AS VARCHAR) ORDER BY path, name, id)[1:10], ',') AS members FROM nodes WHERE signature IS NOT NULL GROUP BY 1, 2 HAVING count(*) > 1 ORDER BY size DESC, signature, kind LIMIT 1000")
def duplicates_signature(g):
    return A.duplicates(g.nodes.filter("signature is not null"), ["signature", "kind"])


def _bfs(seed: str, kinds: str, depth: int, step: str = "SELECT dst, level + 1 FROM b JOIN edges ON src = id", extra: str = "") -> str:
    return f"b(id, level) AS ({seed} UNION {step} WHERE kind IN {kinds} AND level < {depth} {extra}), found AS (SELECT id, min(level) AS level FROM b GROUP BY id)"


_S = "SELECT id, 0 FROM nodes WHERE id IN (3000000001, 3000000002, 3000000010)"


def _three(g):
    return g.nodes.filter("id in (3000000001, 3000000002, 3000000010)")


@graph_query("SELECT id, level FROM found", _bfs(_S, "('calls')", 2))
def traverse_depth2(g):
    return T.levels(_three(g), g.of("calls"), 2)


@graph_query("SELECT id FROM found WHERE level > 0", _bfs("SELECT CAST(2000000004 AS BIGINT), 0", "('contains')", 2, "SELECT CASE WHEN src = id THEN dst ELSE src END, level + 1 FROM b JOIN edges ON src = id OR dst = id"))
def traverse_both(g):
    return T.traverse(g.nodes.filter("id = 2000000004"), g.of("contains"), 2, "both")


@graph_query("SELECT id FROM found WHERE level > 0", _bfs("SELECT id, 0 FROM nodes WHERE name LIKE 'order_2%'", "('calls')", 1, extra="AND resolved_via = 'type_match'"))
def traverse_resolved_via(g):
    return T.traverse(g.nodes.filter("name like 'order_2%'"), g.of("calls").filter("resolved_via = 'type_match'"), 1)


@graph_query("SELECT id, level, level = 1 AS direct FROM found WHERE level > 0", _bfs("SELECT CAST(4000000005 AS BIGINT), 0", U, 3, "SELECT src, level + 1 FROM b JOIN edges ON dst = id"))
def impact(g):
    return T.levels(g.nodes.filter("id = 4000000005"), g.of(*R.USES), 3, "reverse").filter("level > 0").withColumn("direct", F.col("level") == 1)


@graph_query("SELECT DISTINCT src, dst, kind FROM edges WHERE kind IN ('calls','imports') AND src IN (SELECT id FROM found) AND dst IN (SELECT id FROM found)", _bfs(_S, "('calls','imports')", 2))
def subgraph_edges(g):
    e = g.of("calls", "imports")
    ids = T.traverse(_three(g), e, 2, include_seeds=True)
    return e.join(ids.withColumnRenamed("id", "src"), "src", "left_semi").join(ids.withColumnRenamed("id", "dst"), "dst", "left_semi").select("src", "dst", "kind").distinct()


@graph_query("SELECT id, level FROM found", _bfs("SELECT CAST(6000000011 AS BIGINT), 0", "('calls','imports','references')", 3))
def dependency_tree(g):
    return T.levels(g.nodes.filter("id = 6000000011"), g.of("calls", "imports", "references"), 3)


_ENTRY = "(visibility IN ('public','pub') OR name = 'main' OR name LIKE 'test\\_%' ESCAPE '\\' OR name LIKE '%\\_test' ESCAPE '\\' OR kind IN ('export','test'))"


def _entries(g):
    return g.nodes.filter(R.is_entry_point())


@graph_query(f"SELECT id FROM nodes WHERE {_ENTRY}")
def entry_points(g):
    return _ids(_entries(g))


_CLOSE = f"r(id) AS (SELECT id FROM nodes WHERE {_ENTRY} UNION SELECT dst FROM r JOIN edges ON src = id WHERE kind IN {U})"


@graph_query("SELECT id FROM r", _CLOSE)
def reachable_from_entry(g):
    return T.closure(_entries(g), g.of(*R.USES))


@graph_query("SELECT id FROM nodes WHERE kind IN ('function','struct') AND id NOT IN (SELECT id FROM r)", _CLOSE)
def unused_reachability(g):
    return _ids(g.nodes.filter("kind in ('function', 'struct')").join(T.closure(_entries(g), g.of(*R.USES)), "id", "left_anti"))


@graph_query("SELECT id FROM nodes n WHERE kind IN ('function','struct') AND id NOT IN (SELECT id FROM r) AND NOT EXISTS (SELECT 1 FROM nodes p JOIN r ON r.id = p.id WHERE p.path = n.path AND p.kind = n.kind AND regexp_extract(p.name, '([^:./]*)$', 1) = regexp_extract(n.name, '([^:./]*)$', 1))", _CLOSE)
def unused_post_filter(g):
    reach = T.closure(_entries(g), g.of(*R.USES))
    keyed = g.nodes.withColumn("simple", X.simple_name(F.col("name")))
    peers = keyed.join(reach, "id", "left_semi").select("path", "kind", "simple")
    return _ids(keyed.filter("kind in ('function', 'struct')").join(reach, "id", "left_anti").join(peers, ["path", "kind", "simple"], "left_anti"))


_RU = "r(id) AS (SELECT id FROM nodes WHERE name = 'user_3' UNION SELECT dst FROM r JOIN edges ON src = id WHERE kind = 'calls')"


@graph_query("SELECT id FROM r", _RU)
def reachability(g):
    return T.closure(_named(g, "user_3"), g.of("calls"))


# Nodes without a call in or out lie on no cycle; three rounds of leaving them out make the closure of the rest small.
_UC = "c AS MATERIALIZED (SELECT DISTINCT src, dst FROM edges WHERE kind = 'calls'), c1 AS MATERIALIZED (SELECT src, dst FROM c WHERE src <> dst AND src IN (SELECT dst FROM c) AND dst IN (SELECT src FROM c)), c2 AS MATERIALIZED (SELECT src, dst FROM c1 WHERE src IN (SELECT dst FROM c1) AND dst IN (SELECT src FROM c1)), c3 AS MATERIALIZED (SELECT src, dst FROM c2 WHERE src IN (SELECT dst FROM c2) AND dst IN (SELECT src FROM c2)), p(a, b) AS (SELECT src, dst FROM c3 UNION SELECT a, dst FROM p JOIN c3 ON src = b), s AS MATERIALIZED (SELECT v.id, coalesce(min(least(v.id, x.b)), v.id) AS component FROM (SELECT DISTINCT id FROM nodes) v LEFT JOIN (SELECT p.a, p.b FROM p JOIN p q ON q.a = p.b AND q.b = p.a) x ON x.a = v.id GROUP BY v.id)"


def _calls(g):
    return g.of("calls").select("src", "dst").distinct()


_DERIVED: dict[tuple[int, str], tuple[Graph, DataFrame]] = {}


def _derived(g, name, make):
    """Derived once for a snapshot."""
    if (id(g), name) not in _DERIVED:
        _DERIVED[id(g), name] = (g, cut(make()))
    return _DERIVED[id(g), name][1]


def _cyclic(g):
    """The nodes on cycles of calls, with their components."""
    return _derived(g, "cyclic", lambda: T.cyclic(_calls(g)))


def _labels(g):
    """The components of all calls; a node on no cycle is one of its own."""
    return _derived(g, "labels", lambda: T.labelled(g.nodes, _cyclic(g)))


@graph_query("SELECT id, component FROM s", _UC)
def scc_labels(g):
    return _labels(g)


@graph_query("SELECT component, count(*) AS size FROM s GROUP BY 1 HAVING count(*) BETWEEN 2 AND 500", _UC)
def cycles_bounded(g):
    return T.cycles(_calls(g), 2, 500, labels=_cyclic(g))


@graph_query("SELECT id, count(*) OVER (PARTITION BY component) > 1 AS in_cycle FROM s", _UC)
def is_in_cycle(g):
    found = _cyclic(g).select("id", F.lit(True).alias("in_cycle"))
    return g.nodes.select("id").distinct().join(found, "id", "left").select("id", F.coalesce("in_cycle", F.lit(False)).alias("in_cycle"))


@graph_query("SELECT DISTINCT a.component AS src, b.component AS dst FROM c JOIN s a ON a.id = c.src JOIN s b ON b.id = c.dst WHERE a.component <> b.component", _UC)
def condensation(g):
    return T.condense(_calls(g), _labels(g))


@graph_query("SELECT t.id, min(t.id) OVER (PARTITION BY root) AS component FROM t", "t(id, root) AS (SELECT id, id FROM nodes WHERE id NOT IN (SELECT dst FROM edges WHERE kind = 'contains') UNION ALL SELECT dst, root FROM t JOIN edges ON src = id WHERE kind = 'contains')")
def components(g):
    return T.components(g.nodes, g.of("contains"))


_PATHS = "w(path, last, steps) AS (SELECT [id], id, 0 FROM nodes WHERE id IN (3000000001, 3000000004) UNION ALL SELECT list_append(path, dst), dst, steps + 1 FROM w JOIN (SELECT DISTINCT src, dst FROM edges WHERE kind = 'calls' AND src <> dst) e ON src = last WHERE steps < 3 AND NOT list_contains(path, dst) AND NOT (steps > 0 AND last BETWEEN 4000000000 AND 4000000030))"
_HIT = "steps > 0 AND last BETWEEN 4000000000 AND 4000000030"


def _route(g, avoid=None):
    return T.paths(g.nodes.filter("id in (3000000001, 3000000004)"), g.nodes.filter("id between 4000000000 and 4000000030"), g.of("calls"), 3, avoid)


def _text(path: str = "path"):
    return F.concat_ws(">", F.transform(path, lambda x: x.cast("string"))).alias("path")


@graph_query(f"SELECT array_to_string(path, '>') AS path, steps FROM w WHERE {_HIT} ORDER BY steps, path LIMIT 20", _PATHS)
def paths_k_shortest(g):
    return _route(g).select(_text(), "steps").orderBy("steps", "path").limit(20)


@graph_query(f"SELECT array_to_string(path, '>') AS path, steps FROM w WHERE {_HIT} AND NOT list_has_any(path, (SELECT list(id) FROM nodes WHERE kind = 'function' AND is_async))", _PATHS)
def paths_avoiding(g):
    return _route(g, g.nodes.filter("kind = 'function' and is_async")).select(_text(), "steps")


@graph_query(f"SELECT array_to_string(path, '>') AS path, round(1.0 / steps, 6) AS score FROM w WHERE {_HIT}", _PATHS)
def path_score(g):
    return _route(g).select(_text(), F.round(1.0 / F.col("steps"), 6).alias("score"))


_OLD = "old AS (SELECT * FROM nodes)"
_NEW = _OLD + ", new AS (SELECT id, kind, CASE WHEN id % 101 = 0 THEN name || '_new' ELSE name END AS name, CASE WHEN id % 101 = 0 THEN qualified_name || '_new' ELSE qualified_name END AS qualified_name, path, CASE WHEN id % 89 = 0 THEN coalesce(signature, '') || 'x' ELSE signature END AS signature, CASE WHEN id % 83 = 0 THEN start_line + 5 ELSE start_line END AS start_line, end_line FROM old WHERE id % 97 <> 0)"


def _snapshots(g):
    """All nodes before and after the planted changes."""
    old = g.nodes
    new = old.filter("id % 97 <> 0").withColumns({"name": F.when(F.col("id") % 101 == 0, F.concat("name", F.lit("_new"))).otherwise(F.col("name")), "qualified_name": F.when(F.col("id") % 101 == 0, F.concat("qualified_name", F.lit("_new"))).otherwise(F.col("qualified_name")), "signature": F.when(F.col("id") % 89 == 0, F.concat(F.coalesce("signature", F.lit("")), F.lit("x"))).otherwise(F.col("signature")), "start_line": F.when(F.col("id") % 83 == 0, F.col("start_line") + 5).otherwise(F.col("start_line"))})
    unique = lambda d: d.groupBy("qualified_name").agg(*[F.min(c).alias(c) for c in ("signature", "path", "start_line", "end_line", "kind", "name")])
    return unique(old), unique(new)


_UQ = _NEW + "".join(f", {k}1 AS (SELECT qualified_name, min(signature) AS signature, min(path) AS path, min(start_line) AS start_line, min(end_line) AS end_line, min(kind) AS kind, min(name) AS name FROM {k} GROUP BY 1)" for k in ("old", "new"))
_CH = _UQ + ", ch AS (SELECT * FROM (SELECT coalesce(o.qualified_name, n.qualified_name) AS qualified_name, CASE WHEN o.qualified_name IS NULL THEN 'added' WHEN n.qualified_name IS NULL THEN 'removed' WHEN o.signature IS DISTINCT FROM n.signature THEN 'signature_changed' WHEN o.path IS DISTINCT FROM n.path OR o.start_line IS DISTINCT FROM n.start_line OR o.end_line IS DISTINCT FROM n.end_line THEN 'modified' END AS change FROM old1 o FULL JOIN new1 n ON o.qualified_name = n.qualified_name) x WHERE change IS NOT NULL)"


@graph_query("SELECT qualified_name, change FROM ch", _CH)
def diff_changes(g):
    return A.diff(*_snapshots(g))


@graph_query("SELECT change, count(*) AS n FROM ch GROUP BY 1", _CH)
def diff_summary(g):
    return A.diff(*_snapshots(g)).groupBy("change").agg(F.count("*").alias("n"))


_SIM = "CASE WHEN o.signature IS NULL AND n.signature IS NULL THEN 1.0 WHEN o.signature IS NULL OR n.signature IS NULL THEN 0.0 WHEN greatest(length(o.signature), length(n.signature)) = 0 THEN 1.0 ELSE 1 - levenshtein(o.signature, n.signature) * 1.0 / greatest(length(o.signature), length(n.signature)) END"
_PLACE = "CASE WHEN o.path <> n.path THEN 0.7 WHEN abs(o.start_line - n.start_line) <= 50 THEN 1 - least(abs(o.start_line - n.start_line) / 100.0, 0.5) ELSE 0.3 END"


@graph_query(f"SELECT old_name, new_name, round(score, 6) AS score FROM (SELECT o.qualified_name AS old_name, n.qualified_name AS new_name, {_SIM} AS sim, 0.7 * ({_SIM}) + 0.3 * ({_PLACE}) AS score FROM old1 o JOIN ch a ON a.qualified_name = o.qualified_name AND a.change = 'removed' JOIN new1 n ON n.kind = o.kind JOIN ch b ON b.qualified_name = n.qualified_name AND b.change = 'added') x WHERE sim >= 0.7 AND score >= 0.9", _CH, edges=False)
def rename_candidates(g):
    """Renames to any name and place, by score alone."""
    return A.renames(*A.replaced(*_snapshots(g)))


@table_query("SELECT 'removed' AS change, l_partkey, l_suppkey, count(*) AS n FROM (SELECT l_partkey, l_suppkey FROM lineitem WHERE l_linenumber <= 3 EXCEPT ALL SELECT l_partkey, l_suppkey FROM lineitem WHERE l_linenumber >= 3) a GROUP BY 2, 3 UNION ALL SELECT 'added', l_partkey, l_suppkey, count(*) FROM (SELECT l_partkey, l_suppkey FROM lineitem WHERE l_linenumber >= 3 EXCEPT ALL SELECT l_partkey, l_suppkey FROM lineitem WHERE l_linenumber <= 3) b GROUP BY 2, 3")
def edge_multiset_delta(spark, sf_dir):
    li = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    counts = li.groupBy("l_partkey", "l_suppkey").agg(F.count_if(F.col("l_linenumber") <= 3).alias("o"), F.count_if(F.col("l_linenumber") >= 3).alias("m"))
    return counts.filter("o <> m").select(F.when(F.col("o") > F.col("m"), "removed").otherwise("added").alias("change"), "l_partkey", "l_suppkey", F.abs(F.col("o") - F.col("m")).alias("n"))


def _deltas(spark, sf_dir):
    li = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    return li.select(F.col("l_orderkey").alias("src"), F.col("l_suppkey").alias("dst"), (F.unix_date(F.to_date("l_shipdate")).cast("long") * 100 + F.col("l_linenumber")).alias("seq"), F.when(F.col("l_returnflag") == "R", "remove").otherwise("add").alias("op"))


@table_query("SELECT src, dst, seq FROM (SELECT *, row_number() OVER (PARTITION BY src, dst ORDER BY seq DESC, op DESC) AS r FROM (SELECT l_orderkey AS src, l_suppkey AS dst, CAST(CAST(l_shipdate AS DATE) - DATE '1970-01-01' AS BIGINT) * 100 + l_linenumber AS seq, CASE WHEN l_returnflag = 'R' THEN 'remove' ELSE 'add' END AS op FROM lineitem) d) x WHERE r = 1 AND op = 'add'")
def lww_merge(spark, sf_dir):
    return A.latest_writes(_deltas(spark, sf_dir), ["src", "dst"], [F.col("seq")])


@table_query("SELECT src, dst, seq FROM (SELECT *, row_number() OVER (PARTITION BY src, dst ORDER BY seq DESC, op DESC) AS r FROM (SELECT l_orderkey AS src, l_suppkey AS dst, CAST(CAST(l_shipdate AS DATE) - DATE '1970-01-01' AS BIGINT) * 100 + l_linenumber AS seq, CASE WHEN l_returnflag = 'R' THEN 'remove' ELSE 'add' END AS op FROM lineitem) d) x WHERE r = 1 AND op = 'add'")
def stream_lww(spark, sf_dir):
    from .streaming.merge import merge_stream

    src = spark.readStream.schema(spark.read.parquet(f"{sf_dir}/lineitem.parquet").schema).option("pathGlobFilter", "lineitem.parquet").parquet(sf_dir)
    deltas = src.select(F.col("l_orderkey").alias("src"), F.col("l_suppkey").alias("dst"), (F.unix_date(F.to_date("l_shipdate")).cast("long") * 100 + F.col("l_linenumber")).alias("seq"), F.when(F.col("l_returnflag") == "R", "remove").otherwise("add").alias("op"))
    return merge_stream(deltas, ["src", "dst"])


_TRI = "t AS (SELECT DISTINCT p_name AS name FROM part), g AS (SELECT DISTINCT name, substr(name, i, 3) AS tri FROM t, range(1, 200) r(i) WHERE i <= length(name) - 2)"


@table_query(f"WITH {_TRI} SELECT a.name AS a, b.name AS b, count(*) AS shared FROM g a JOIN g b ON a.tri = b.tri AND a.name < b.name GROUP BY 1, 2")
def trigram_candidates(spark, sf_dir):
    names = spark.read.parquet(f"{sf_dir}/part.parquet").select(F.col("p_name").alias("name")).distinct()
    g = names.select("name", F.explode(X.trigrams(F.col("name"))).alias("tri"))
    a, b = g.withColumnRenamed("name", "a"), g.withColumnRenamed("name", "b")
    return a.join(b, "tri").filter("a < b").groupBy("a", "b").agg(F.count("*").alias("shared"))


@table_query(f"WITH {_TRI}, l AS (SELECT name, list(tri) AS x FROM g GROUP BY name) SELECT a.name AS a, b.name AS b, round(len(list_intersect(a.x, b.x)) * 1.0 / len(list_distinct(list_concat(a.x, b.x))), 6) AS jaccard FROM l a JOIN l b ON a.name < b.name WHERE len(list_intersect(a.x, b.x)) > 0")
def jaccard_pairs(spark, sf_dir):
    names = spark.read.parquet(f"{sf_dir}/part.parquet").select(F.col("p_name").alias("name")).distinct()
    g = names.select("name", X.trigrams(F.col("name")).alias("x"), F.explode(X.trigrams(F.col("name"))).alias("tri"))
    a, b = g.select(F.col("name").alias("a"), F.col("x").alias("xa"), "tri"), g.select(F.col("name").alias("b"), F.col("x").alias("xb"), "tri")
    return a.join(b, "tri").filter("a < b").groupBy("a", "b").agg(F.round(F.first(X.jaccard(F.col("xa"), F.col("xb"))), 6).alias("jaccard"))


@table_query("SELECT p_name AS name, round(1 - levenshtein(p_name, 'small ring') * 1.0 / greatest(length(p_name), 10), 6) AS score FROM (SELECT DISTINCT p_name FROM part) p WHERE 1 - levenshtein(p_name, 'small ring') * 1.0 / greatest(length(p_name), 10) >= 0.3")
def similar_levenshtein(spark, sf_dir):
    names = spark.read.parquet(f"{sf_dir}/part.parquet").select(F.col("p_name").alias("name")).distinct()
    score = X.levenshtein_similarity(F.col("name"), F.lit("small ring"))
    return names.filter(score >= 0.3).select("name", F.round(score, 6).alias("score"))


@table_query("SELECT p_name AS name, round(jaro_winkler_similarity(p_name, 'blue bolt'), 6) AS score FROM (SELECT DISTINCT p_name FROM part) p WHERE jaro_winkler_similarity(p_name, 'blue bolt') >= 0.6")
def fuzzy_jaro_winkler(spark, sf_dir):
    names = spark.read.parquet(f"{sf_dir}/part.parquet").select(F.col("p_name").alias("name")).distinct()
    return names.withColumn("score", F.round(X.jaro_winkler(F.struct("name").getField("name"), F.lit("blue bolt")), 6)).filter("score >= 0.6")


@table_query("SELECT item, span FROM (SELECT a.p_partkey AS item, b.p_partkey AS span, row_number() OVER (PARTITION BY a.p_partkey ORDER BY 2 * b.p_size, b.p_partkey) AS r FROM part a JOIN part b ON a.p_brand = b.p_brand AND a.p_partkey BETWEEN b.p_partkey - b.p_size AND b.p_partkey + b.p_size AND a.p_partkey <> b.p_partkey) x WHERE r = 1")
def innermost_container(spark, sf_dir):
    p = spark.read.parquet(f"{sf_dir}/part.parquet")
    return A.innermost(p.select(F.col("p_partkey").alias("item"), F.col("p_brand").alias("file"), F.col("p_partkey").alias("at")), p.select(F.col("p_partkey").alias("span"), F.col("p_brand").alias("file"), (F.col("p_partkey") - F.col("p_size")).alias("lo"), (F.col("p_partkey") + F.col("p_size")).alias("hi")))


@table_query("SELECT u.event_id AS use, b.event_id AS node FROM (SELECT * FROM events WHERE value > 150) u ASOF LEFT JOIN (SELECT * FROM events WHERE value <= 50) b ON u.user_id = b.user_id AND u.ts >= b.ts")
def asof_binding(spark, sf_dir):
    e = spark.read.parquet(f"{sf_dir}/events.parquet").withColumn("at", F.col("ts"))
    return A.as_of(e.filter("value > 150").select("user_id", "at", F.col("event_id").alias("use")), e.filter("value <= 50").select("user_id", "at", F.col("event_id").alias("node")), ["user_id"])


@table_query("SELECT o_orderpriority, o_orderkey, r FROM (SELECT *, row_number() OVER (PARTITION BY o_orderpriority ORDER BY o_totalprice DESC, o_orderkey) AS r FROM orders) x WHERE r <= 10")
def topn_per_group(spark, sf_dir):
    w = Window.partitionBy("o_orderpriority").orderBy(F.desc("o_totalprice"), "o_orderkey")
    return spark.read.parquet(f"{sf_dir}/orders.parquet").withColumn("r", F.row_number().over(w)).filter("r <= 10").select("o_orderpriority", "o_orderkey", "r")


@table_query("SELECT conv_id, turn, 5 + 2 * (len(regexp_extract_all(text, 'the')) - 1) + CASE WHEN role = 'user' THEN 1 ELSE 0 END AS score FROM conversations WHERE regexp_matches(text, 'the')")
def rank_text(spark, sf_dir):
    c = spark.read.parquet(f"{sf_dir}/conversations.parquet").filter(F.col("text").rlike("the"))
    return c.select("conv_id", "turn", (5 + 2 * (F.regexp_count("text", F.lit("the")) - 1) + F.when(F.col("role") == "user", 1).otherwise(0)).alias("score"))


@graph_query("SELECT id, path, name FROM nodes WHERE kind = 'function' ORDER BY path, name, id LIMIT 50 OFFSET 100")
def paginate(g):
    return _functions(g).select("id", "path", "name").orderBy("path", "name", "id").offset(100).limit(50)


@table_query("SELECT strftime(ts, '%G-W%V') AS week, count(*) AS total, round(avg(value), 6) AS mean_value, round(median(value), 6) AS median_value, round(sum(CASE WHEN event_type = 'error' THEN 1 ELSE 0 END) * 1.0 / count(*), 6) AS error_rate FROM events GROUP BY 1")
def weekly_usage(spark, sf_dir):
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    week = F.format_string("%d-W%02d", F.extract(F.lit("YEAROFWEEK"), "ts"), F.extract(F.lit("WEEK"), "ts"))
    return e.groupBy(week.alias("week")).agg(F.count("*").alias("total"), F.round(F.avg("value"), 6).alias("mean_value"), F.round(F.median("value"), 6).alias("median_value"), F.round(F.avg((F.col("event_type") == "error").cast("double")), 6).alias("error_rate"))


@table_query("SELECT user_id, round(CASE WHEN hi = lo THEN 0.5 ELSE (t - lo) * 1.0 / (hi - lo) END, 6) AS score FROM (SELECT user_id, max(epoch_us(ts)) AS t, min(max(epoch_us(ts))) OVER () AS lo, max(max(epoch_us(ts))) OVER () AS hi FROM events GROUP BY user_id) x")
def recency_score(spark, sf_dir):
    last = spark.read.parquet(f"{sf_dir}/events.parquet").groupBy("user_id").agg(F.max(F.unix_micros(F.col("ts").cast("timestamp"))).alias("t"))
    ends = last.agg(F.min("t").alias("lo"), F.max("t").alias("hi"))
    return last.join(F.broadcast(ends)).select("user_id", F.round(F.when(F.col("hi") == F.col("lo"), 0.5).otherwise((F.col("t") - F.col("lo")) / (F.col("hi") - F.col("lo"))), 6).alias("score"))


@table_query("SELECT round(sum(w) / count(*), 6) AS health, CASE WHEN sum(w) / count(*) >= 0.9 THEN 'excellent' WHEN sum(w) / count(*) >= 0.7 THEN 'good' WHEN sum(w) / count(*) >= 0.5 THEN 'fair' WHEN sum(w) / count(*) >= 0.3 THEN 'poor' ELSE 'critical' END AS label FROM (SELECT CASE o_orderstatus WHEN 'F' THEN 1.0 WHEN 'O' THEN 0.8 WHEN 'P' THEN 0.5 ELSE 0.2 END AS w FROM orders) x")
def health_score(spark, sf_dir):
    w = F.when(F.col("o_orderstatus") == "F", 1.0).when(F.col("o_orderstatus") == "O", 0.8).when(F.col("o_orderstatus") == "P", 0.5).otherwise(0.2)
    h = spark.read.parquet(f"{sf_dir}/orders.parquet").agg(F.avg(w).alias("h"))
    return h.select(F.round("h", 6).alias("health"), F.when(F.col("h") >= 0.9, "excellent").when(F.col("h") >= 0.7, "good").when(F.col("h") >= 0.5, "fair").when(F.col("h") >= 0.3, "poor").otherwise("critical").alias("label"))


@graph_query("SELECT kind, is_async, CASE kind WHEN 'calls' THEN 'call' WHEN 'imports' THEN 'import' WHEN 'exports' THEN 'export' WHEN 'references' THEN 'reference' WHEN 'wraps' THEN 'reference' ELSE kind END AS class, CASE kind WHEN 'calls' THEN CASE WHEN is_async THEN 0.9 ELSE 1.0 END WHEN 'imports' THEN 0.95 WHEN 'references' THEN 0.8 WHEN 'inherits' THEN 0.95 WHEN 'implements' THEN 0.95 ELSE 1.0 END AS confidence, count(*) AS n FROM edges GROUP BY ALL")
def edge_classes(g):
    k = F.col("kind")
    return g.edges.groupBy("kind", "is_async", X.edge_class(k).alias("class"), X.edge_confidence(k, F.col("is_async")).cast("decimal(3,2)").cast("double").alias("confidence")).agg(F.count("*").alias("n"))


@table_query("SELECT doc_id, CAST(greatest(1, ceil(ceil(strlen(text) / 4.0) * 6 / 5.0)) AS BIGINT) AS tokens FROM documents")
def token_estimates(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", X.token_estimate(F.col("text")).alias("tokens"))


@graph_query("SELECT id, CASE WHEN lower(name) = 'user_1' THEN 1.0 WHEN lower(name) LIKE 'user\\_1%' ESCAPE '\\' THEN 0.9 WHEN contains(lower(name), 'user_1') THEN 0.7 WHEN contains(lower(qualified_name), 'user_1') THEN 0.5 ELSE 0.3 END AS score FROM nodes WHERE kind = 'function'")
def name_relevance(g):
    return _functions(g).select("id", X.name_relevance(F.col("name"), F.col("qualified_name"), "USER_1").alias("score"))


@table_query("SELECT page_id, regexp_replace(regexp_replace(regexp_replace(url, '[?#].*$', ''), '/+', '/', 'g'), '(.)/$', '\\1') AS path FROM pages")
def url_paths(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", X.url_path(F.col("url")).alias("path"))


@table_query("SELECT doc_id, n AS line, text FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS text, generate_subscripts(string_split(text, chr(10)), 1) AS n FROM documents) x WHERE contains(text, 'License')")
def text_search(spark, sf_dir):
    d = spark.read.parquet(f"{sf_dir}/documents.parquet").filter(F.col("text").contains("License"))
    return d.select("doc_id", F.posexplode(F.split("text", "\n"))).filter(F.col("col").contains("License")).select("doc_id", (F.col("pos") + 1).alias("line"), F.col("col").alias("text"))


@graph_query("SELECT id, CASE WHEN regexp_matches(qualified_name, '^[=+\\-@\\t\\r]') THEN '''' || qualified_name ELSE qualified_name END AS cell FROM nodes WHERE kind IN ('struct','class')")
def csv_cells(g):
    return g.nodes.filter("kind in ('struct', 'class')").select("id", X.csv_guard(F.col("qualified_name")).alias("cell"))


@graph_query("SELECT id, chain FROM (SELECT n.id, m.name || '>' || c.name || '>' || n.name AS chain FROM nodes n JOIN edges e ON e.dst = n.id AND e.kind = 'contains' JOIN nodes c ON c.id = e.src JOIN edges f ON f.dst = c.id AND f.kind = 'contains' JOIN nodes m ON m.id = f.src WHERE n.kind = 'method') x")
def scope_chain(g):
    c = g.of("contains").select("src", "dst")
    names = g.nodes.select("id", "name")
    up = names.join(g.nodes.filter("kind = 'method'").select("id"), "id", "left_semi").select("id", F.array("name").alias("chain"), F.col("id").alias("dst"))
    for _ in range(2):
        up = up.join(c, "dst").join(names.select(F.col("id").alias("src"), "name"), "src").select("id", F.array_prepend("chain", F.col("name")).alias("chain"), F.col("src").alias("dst"))
    return up.select("id", F.concat_ws(">", "chain").alias("chain"))


@graph_query("SELECT coalesce(a.w, src) AS src, coalesce(b.w, dst) AS dst, count(*) AS n FROM edges LEFT JOIN m a ON a.l = src LEFT JOIN m b ON b.l = dst WHERE kind = 'references' GROUP BY 1, 2", "m AS (SELECT id AS l, min(id) OVER (PARTITION BY name) AS w FROM nodes WHERE kind = 'struct')")
def node_unification(g):
    win = g.nodes.filter("kind = 'struct'").groupBy("name").agg(F.min("id").alias("w"))
    m = g.nodes.filter("kind = 'struct'").join(win, "name").select(F.col("id").alias("l"), "w")
    e = g.of("references").join(m.select(F.col("l").alias("src"), F.col("w").alias("a")), "src", "left").join(m.select(F.col("l").alias("dst"), F.col("w").alias("b")), "dst", "left")
    return e.groupBy(F.coalesce("a", "src").alias("src"), F.coalesce("b", "dst").alias("dst")).agg(F.count("*").alias("n"))


@graph_query("SELECT id FROM nodes WHERE kind = 'function' AND EXISTS (SELECT 1 FROM edges WHERE edges.kind = 'calls' AND dst = id) AND visibility = 'private'")
def plan_text(g):
    from .plans.text import run_plan

    return run_plan(g, "kind:function has:caller visibility:private")


@graph_query("SELECT id FROM nodes WHERE (kind = 'function' AND contains(name, 'order_77')) OR (kind = 'method' AND NOT coalesce(visibility = 'public', FALSE) AND regexp_matches(path, 'ASIA'))")
def boolean_text(g):
    from .plans.boolean import run_boolean

    return run_boolean(g, "(kind:function AND name:order_77) OR (kind:method AND NOT visibility:public AND path~=/ASIA/)")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    from . import catalog_fields, catalog_links, catalog_reports  # noqa: F401  (they register theirs)

    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    queries()
    return dict(SQL)
