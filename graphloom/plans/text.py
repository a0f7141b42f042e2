"""The planner's text form: clauses joined by spaces, each narrowing or moving the node set."""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import relations as R
from ..operators import traversal as T
from ..project import Graph

RELATIONS = {"callers": ("calls",), "references": ("calls", "references", "imports", "ffi_call")}
BACK = {"callees": ("calls",), "imports": ("imports",), "impl": ("implements",), "implements": ("implements",)}
_CLAUSE = re.compile(r'(\w+)(~=|:)((?:"[^"]*")|(?:/(?:\\.|[^/])*/[ims]*)|(?:\w+\([^)]*\))|\S+)|(unused)\b')


class PlanError(ValueError):
    pass


@dataclass(frozen=True)
class Clause:
    field: str
    op: str
    value: str

    def __str__(self) -> str:
        return self.field if self.op == "" else f"{self.field}{self.op}{self.value}"


def parse(text: str) -> tuple[Clause, ...]:
    """White space joins clauses; a pipe is refused."""
    if "|" in re.sub(r'"[^"]*"|/(?:\\.|[^/])*/', "", text):
        raise PlanError("pipelines belong to the boolean language")
    out, at = [], 0
    text = text.strip()
    while at < len(text):
        m = _CLAUSE.match(text, at)
        if not m:
            raise PlanError(f"no clause at {at}: {text[at:at + 20]!r}")
        out.append(Clause("unused", "", "") if m[4] else Clause(m[1], m[2], m[3]))
        at = m.end()
        while at < len(text) and text[at].isspace():
            at += 1
    if not out:
        raise PlanError("empty plan")
    return tuple(out)


def format_plan(plan: tuple[Clause, ...]) -> str:
    return " ".join(map(str, plan))


def _regex(col, value: str):
    """A match of /pattern/flags."""
    body, flags = re.fullmatch(r"/(.*)/([ims]*)", value).groups()
    return col.rlike(f"(?{flags}){body}" if flags else body)


def _matching(g: Graph, c: Clause) -> DataFrame:
    if c.op == "~=":
        return g.nodes.filter(_regex(F.col("name"), c.value))
    return g.nodes.filter(R.name_matches(F.col("name"), c.value.strip('"')))


def apply(g: Graph, nodes: DataFrame, c: Clause) -> DataFrame:
    f, v = c.field, c.value.strip('"')
    if f in ("kind", "visibility", "lang"):
        return nodes.filter(F.coalesce(F.col(f) == v, F.lit(False)))
    if f == "name":
        return nodes.filter(_regex(F.col("name"), c.value) if c.op == "~=" else R.name_matches(F.col("name"), v))
    if f in ("address_taken", "callsite_promiscuous", "is_definition", "is_unsafe"):
        if f not in nodes.columns:
            raise PlanError(f"the snapshot does not record {f}")
        return nodes.filter(F.coalesce(F.col(f), F.lit(False)) == (v != "false"))
    if f == "framework":
        return nodes.filter(F.col("framework") == v)
    if f == "scope":
        return R.inside(g, nodes, F.col("kind") == v)
    if f == "returns":
        return R.returning(g, nodes, v)
    if f == "cfg":
        return nodes.filter(R.cfg_matches(F.col("cfg"), c.value))
    if f == "wraps":
        return R.with_outgoing(nodes, g.of("wraps").filter((F.col("context") == v) if v not in ("", "true") else F.lit(True)))
    if f == "in":
        return nodes.filter(F.col("path").rlike(R.glob(v)))
    if f == "async":
        return nodes.filter(F.coalesce("is_async", F.lit(False)) == (v == "true"))
    if f == "has":
        return {"caller": R.with_incoming, "callee": R.with_outgoing}[v](nodes, g.of("calls"))
    if f == "unused":
        return R.without_incoming(nodes, g.of(*R.USES))
    if f in ("resolved_via", "resolved_via_in"):
        wanted = [x.strip() for x in v.strip("()").split(",")]
        return R.with_outgoing(nodes, g.of("calls").filter(F.col("resolved_via").isin(*wanted)))
    if f == "exports":
        return R.either_side(g, nodes, _matching(g, c), "exports")
    if f in RELATIONS:
        return R.targets_of(g, nodes, _matching(g, c), *RELATIONS[f])
    if f in BACK:
        return R.sources_of(g, nodes, _matching(g, c), *BACK[f])
    if f == "traverse":
        m = re.fullmatch(r"(forward|reverse|both)\((\w+),\s*(\d+)\)", v)
        if not m or int(m[3]) < 1:
            raise PlanError(f"bad traversal {v!r}")
        ids = T.traverse(nodes, g.edges if m[2] == "any" else g.of(m[2]), int(m[3]), m[1])
        return g.nodes.join(ids, "id", "left_semi")
    raise PlanError(f"unknown field {f!r}")


def run_plan(g: Graph, text: str) -> DataFrame:
    """The ids of a plan's result; each clause takes the set that the one before it left."""
    nodes = g.nodes
    for c in parse(text):
        nodes = apply(g, nodes, c)
    return nodes.select("id").distinct()
