"""The boolean language: AND, OR, NOT over fields, edge joins, variables and one pipeline stage."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators import analytics as A
from ..operators import relations as R
from ..operators import traversal as T
from ..project import Graph
from .text import BACK, RELATIONS, Clause, PlanError, _matching

_TOKEN = re.compile(r'\s*(?:(\(|\)|\|)|(AND|OR|NOT|CALLS|IMPORTS|INHERITS|IMPLEMENTS)\b|([\w.]+)\s*(~=|>=|<=|:|>|<)\s*("[^"]*"|/(?:\\.|[^/])*/[ims]*|\((?!\))|[^\s()|]+)|(\w+))')
JOINS = {"CALLS": "calls", "IMPORTS": "imports", "INHERITS": "inherits", "IMPLEMENTS": "implements"}


def tokens(text: str, variables: dict[str, str] | None = None) -> list[tuple]:
    """Variables are whole values, put in after the text is cut into tokens; true, false and numbers read as such."""

    def value(v: str) -> str:
        if not v.startswith("$"):
            return v
        if v[1:] not in (variables or {}):
            raise PlanError(f"unbound variable {v}")
        return f'"{variables[v[1:]]}"'

    out, at, text = [], 0, text.rstrip()
    while at < len(text):
        m = _TOKEN.match(text, at)
        if not m:
            raise PlanError(f"no token at {at}")
        if m[3] and m[5] == "(":
            out += [("sub", m[3]), ("word", "(")]
        else:
            out.append(("field", m[3], m[4], value(m[5])) if m[3] else ("word", m[1] or m[2] or m[6]))
        at = m.end()
    return out


def parse(text: str, variables: dict[str, str] | None = None) -> tuple:
    """("and"|"or", [..]), ("not", x), ("field", f, op, v), ("join", l, kind, r), ("pipe", x, [words])."""
    toks, at, depth = tokens(text, variables), 0, 0

    def word() -> str | None:
        return toks[at][1] if at < len(toks) and toks[at][0] == "word" else None

    def several(name: str, inner) -> tuple:
        nonlocal at
        parts = [inner()]
        while word() == name.upper():
            at += 1
            parts.append(inner())
        return parts[0] if len(parts) == 1 else (name, parts)

    def unary() -> tuple:
        nonlocal at, depth
        if word() == "NOT":
            at += 1
            return ("not", unary())
        if word() == "(":
            at += 1
            x = either()
            if word() != ")":
                raise PlanError("missing )")
            at += 1
            return x
        if at < len(toks) and toks[at][0] == "sub":
            field = toks[at][1]
            at, depth = at + 1, depth + 1
            if depth > 4:
                raise PlanError("subqueries are nested over 4 deep")
            x = unary()
            depth -= 1
            return ("subquery", field, x)
        if at >= len(toks) or toks[at][0] != "field":
            raise PlanError("a field is missing")
        at += 1
        return toks[at - 1]

    def either() -> tuple:
        return several("or", lambda: several("and", unary))

    x = either()
    if word() in JOINS:
        kind = JOINS[word()]
        at += 1
        x = ("join", x, kind, either())
    while word() == "|":
        at += 1
        stage = []
        while word() not in (None, "|"):
            stage.append(word())
            at += 1
        x = ("pipe", x[1] if x[0] == "pipe" else x, stage)  # only the last stage counts
    if at != len(toks):
        raise PlanError("text after the query")
    return x


def _truth(ids: DataFrame, g: Graph, value: str) -> DataFrame:
    return ids if value != "false" else g.nodes.select("id").join(ids, "id", "left_anti")


def _in_scope(g: Graph, scope: Column) -> DataFrame:
    return R.inside(g, g.nodes, scope).select("id")


def _circular(g: Graph) -> DataFrame:
    calls = g.of("calls").select("src", "dst").distinct()
    return T.scc(calls).join(T.cycles(calls), "component", "left_semi").select("id")


#: Fields that follow from the graph: the ids that have the value.
DERIVED = {
    "parent": lambda g, v: _in_scope(g, F.col("name") == v),
    "scope.name": lambda g, v: _in_scope(g, F.col("name") == v),
    "scope": lambda g, v: _in_scope(g, F.col("kind") == v),
    "scope.type": lambda g, v: _in_scope(g, F.col("kind") == v),
    "scope.parent": lambda g, v: R.with_incoming(g.nodes, g.of("contains").join(_in_scope(g, F.col("name") == v).withColumnRenamed("id", "src"), "src", "left_semi")).select("id"),
    "scope.ancestor": lambda g, v: T.traverse(g.nodes.filter(F.col("name") == v), g.of("contains"), None),
    "duplicates": lambda g, v: g.nodes.join(g.nodes.groupBy("signature" if v == "signature" else "body_hash").count().filter("count > 1"), "signature" if v == "signature" else "body_hash", "left_semi").select("id"),
    "unused": lambda g, v: _truth(R.without_incoming(g.nodes, g.of(*R.USES)).select("id"), g, v),
    "circular": lambda g, v: _truth(_circular(g), g, v),
    "imported": lambda g, v: _truth(R.with_incoming(g.nodes, g.of("imports")).select("id"), g, v),
    "resolved_via": lambda g, v: R.with_outgoing(g.nodes, g.of("calls").filter(F.col("resolved_via") == v)).select("id"),
    "returns": lambda g, v: R.returning(g, g.nodes, v).select("id"),
    "exports": lambda g, v: R.either_side(g, g.nodes, g.nodes.filter(F.col("name") == v), "exports").select("id"),
}


class _Frame:
    """Relation fields become flag columns, so that they work under OR and NOT."""

    def __init__(self, g: Graph):
        self.g, self.nodes, self.n = g, g.nodes, 0

    def _flag(self, ids: DataFrame) -> Column:
        self.n += 1
        self.nodes = R.flag(self.nodes, ids, f"_f{self.n}")
        return F.col(f"_f{self.n}")

    def column(self, x: tuple) -> Column:
        if x[0] in ("and", "or"):
            return reduce(lambda a, b: a & b if x[0] == "and" else a | b, [self.column(y) for y in x[1]])
        if x[0] == "not":
            return ~self.column(x[1])
        if x[0] == "subquery":
            if x[1] not in RELATIONS and x[1] not in BACK:
                raise PlanError(f"{x[1]!r} takes no subquery")
            of = R.targets_of if x[1] in RELATIONS else R.sources_of
            return self._flag(of(self.g, self.g.nodes, _nodes(self.g, x[2]), *(RELATIONS | BACK)[x[1]]))
        _, f, op, v = x
        value = v.strip('"')
        if f in DERIVED:
            return self._flag(DERIVED[f](self.g, value))
        if f in RELATIONS or f in BACK:
            of = R.targets_of if f in RELATIONS else R.sources_of
            ids = of(self.g, self.g.nodes, _matching(self.g, Clause(f, op, v)), *(RELATIONS | BACK)[f])
            return self._flag(ids)
        if f == "repo":
            return F.coalesce(F.split("path", "/")[0].rlike(f"^(?:{R.glob(value)})$"), F.lit(False))
        f = {"file": "path", "language": "lang", "async": "is_async", "static": "is_static"}.get(f, f)
        if f not in self.g.nodes.columns:
            raise PlanError(f"unknown field {f!r}")
        col = F.col(f)
        if op == "~=":
            body, flags = re.fullmatch(r"/(.*)/([ims]*)", v).groups()
            made = col.rlike(f"(?{flags}){body}" if flags else body)
        elif op != ":":
            made = {">": col > int(value), "<": col < int(value), ">=": col >= int(value), "<=": col <= int(value)}[op]
        elif self.g.nodes.schema[f].dataType.typeName() == "boolean":
            made = F.coalesce(col, F.lit(False)) == (value == "true")
        elif f == "name":
            made = col.contains(value)
        elif f == "path":
            made = col.rlike(R.glob(value))
        else:
            made = col == value
        return F.coalesce(made, F.lit(False))


def _nodes(g: Graph, x: tuple) -> DataFrame:
    frame = _Frame(g)
    keep = frame.column(x)
    return frame.nodes.filter(keep).select(*g.nodes.columns)


def run_boolean(g: Graph, text: str, variables: dict[str, str] | None = None) -> DataFrame:
    """Ids, the pairs of an edge join, or what the last pipeline stage makes of the base result."""
    x = parse(text, variables)
    if x[0] == "join":
        return R.edge_join(g, _nodes(g, x[1]), _nodes(g, x[3]), x[2])
    if x[0] == "pipe":
        base, stage = _nodes(g, x[1]), x[2]
        if stage == ["count"]:
            return base.agg(F.count("*").alias("n"))
        if stage == ["stats"]:
            return A.stats(base)
        if stage[:1] == ["group_by"] and len(stage) == 2:
            return A.group_by(base, stage[1])
        if stage[:1] == ["top"] and len(stage) == 3:
            return A.top(base, int(stage[1]), stage[2])
        raise PlanError(f"unknown stage {stage}")
    return _nodes(g, x).select("id")
