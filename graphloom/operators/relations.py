"""Relation predicates as semi- and anti-joins, edge joins, and set algebra on node sets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..project import Graph

#: Edges that count as a use of their target.
USES = ("calls", "references", "imports", "inherits", "implements", "type_of")


def is_entry_point() -> Column:
    """Public, named main, test_* or *_test, or of kind export or test."""
    n = F.col("name")
    return F.coalesce(F.col("visibility").isin("public", "pub") | (n == "main") | n.startswith("test_") | n.endswith("_test") | F.col("kind").isin("export", "test"), F.lit(False))


def with_incoming(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    return nodes.join(edges.select(F.col("dst").alias("id")), "id", "left_semi")


def with_outgoing(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    return nodes.join(edges.select(F.col("src").alias("id")), "id", "left_semi")


def without_incoming(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    return nodes.join(edges.select(F.col("dst").alias("id")), "id", "left_anti")


def targets_of(g: Graph, nodes: DataFrame, sources: DataFrame, *kinds: str) -> DataFrame:
    """The nodes that an edge from ``sources`` reaches (the planner's ``callers:``)."""
    e = g.of(*kinds).join(sources.select(F.col("id").alias("src")), "src", "left_semi")
    return with_incoming(nodes, e)


def sources_of(g: Graph, nodes: DataFrame, targets: DataFrame, *kinds: str) -> DataFrame:
    """The nodes with an edge to ``targets`` (the planner's ``callees:``)."""
    e = g.of(*kinds).join(targets.select(F.col("id").alias("dst")), "dst", "left_semi")
    return with_outgoing(nodes, e)


def either_side(g: Graph, nodes: DataFrame, others: DataFrame, kind: str) -> DataFrame:
    """Nodes joined to ``others`` by an edge in either direction; self-loops don't count."""
    e = g.of(kind).filter("src <> dst")
    ids = others.select("id")
    out = e.join(ids.withColumnRenamed("id", "src"), "src", "left_semi").select(F.col("dst").alias("id"))
    back = e.join(ids.withColumnRenamed("id", "dst"), "dst", "left_semi").select(F.col("src").alias("id"))
    return nodes.join(out.unionByName(back), "id", "left_semi")


def flag(nodes: DataFrame, ids: DataFrame, name: str) -> DataFrame:
    """A two-valued column for a relation predicate, for use under OR and NOT."""
    marked = ids.select("id").distinct().withColumn(name, F.lit(True))
    return nodes.join(marked, "id", "left").withColumn(name, F.coalesce(F.col(name), F.lit(False)))


def edge_join(g: Graph, left: DataFrame, right: DataFrame, *kinds: str) -> DataFrame:
    """All (left, right) node pairs that an edge of the kinds joins."""
    e = g.of(*kinds).select("src", "dst").distinct()
    return e.join(left.select(F.col("id").alias("src")), "src", "left_semi").join(right.select(F.col("id").alias("dst")), "dst", "left_semi").select(F.col("src").alias("left_id"), F.col("dst").alias("right_id"))


def inside(g: Graph, nodes: DataFrame, scope: Column) -> DataFrame:
    """The nodes whose enclosing node, which contains them, is such a scope."""
    e = g.of("contains").join(g.nodes.filter(scope).select(F.col("id").alias("src")), "src", "left_semi")
    return with_incoming(nodes, e)


def returning(g: Graph, nodes: DataFrame, name: str) -> DataFrame:
    """The nodes with a return type of exactly this name."""
    e = g.of("type_of").filter("context = 'return'").join(g.nodes.filter(F.col("name") == name).select(F.col("id").alias("dst")), "dst", "left_semi")
    return with_outgoing(nodes, e)


def cfg_flags(cfg: Column) -> Column:
    """The flags of a condition, sorted: of ``all(a, b)`` a and b, of a bare one itself."""
    return F.sort_array(F.transform(F.split(F.regexp_replace(cfg, r"^(all|any|not)\((.*)\)$", "$2"), ","), lambda x: F.trim(x)))


def cfg_matches(cfg: Column, asked: str) -> Column:
    """One flag: is among them and not under not(). A compound: the same operator over the same set. Quoted: the same bytes."""
    if asked.startswith('"'):
        return cfg == asked.strip('"')
    if "(" not in asked:
        return F.array_contains(cfg_flags(cfg), asked) & ~cfg.startswith("not(")
    op = asked[: asked.index("(")]
    want = sorted(x.strip() for x in asked[len(op) + 1 : -1].split(","))
    return cfg.startswith(f"{op}(") & (F.array_distinct(cfg_flags(cfg)) == F.array(*[F.lit(x) for x in dict.fromkeys(want)]))


def union(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.select("id").unionByName(b.select("id")).distinct()


def intersect(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.select("id").intersect(b.select("id"))


def difference(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.select("id").subtract(b.select("id"))


def glob(pattern: str) -> str:
    """A regex for a glob: ** crosses separators, * and ? don't."""
    out, i = "", 0
    while i < len(pattern):
        if pattern.startswith("**/", i):
            out, i = out + "(?:.*/)?", i + 3
        elif pattern.startswith("**", i):
            out, i = out + ".*", i + 2
        else:
            c = pattern[i]
            out, i = out + {"*": "[^/]*", "?": "[^/]"}.get(c, "\\" + c if not c.isalnum() and c not in "_/- #" else c), i + 1
    return f"^{out}$"


def name_matches(col: Column, pattern: str, mode: str = "auto", ignore_case: bool = False) -> Column:
    """exact, glob, prefix, suffix or contains; auto takes glob where the pattern has * or ?."""
    if ignore_case:
        col, pattern = F.lower(col), pattern.lower()
    if mode == "auto":
        mode = "glob" if set("*?") & set(pattern) else "exact"
    made = {"exact": lambda: col == pattern, "glob": lambda: col.rlike(glob(pattern)), "prefix": lambda: col.startswith(pattern), "suffix": lambda: col.endswith(pattern), "contains": lambda: col.contains(pattern)}[mode]()
    return F.coalesce(made, F.lit(False))


def segment_match(col: Column, wanted: str) -> Column:
    """Equal, or ends in ``wanted`` after one of the separators of qualified names."""
    before = F.substring(col, -len(wanted) - 1, 1)
    return F.coalesce((col == wanted) | (col.endswith(wanted) & before.isin(":", ".", "#", "$", "/", "\\")), F.lit(False))
