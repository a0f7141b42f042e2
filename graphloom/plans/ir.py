"""The plan tree: scans, filters, set operations, traversals and chains of them, with a builder."""

from __future__ import annotations

from dataclasses import dataclass, replace
from functools import reduce

from pyspark.sql import DataFrame

from ..operators import relations as R
from ..operators import traversal as T
from ..project import Graph
from .text import Clause, PlanError, apply

DIRECTIONS = ("forward", "reverse", "both")


@dataclass(frozen=True)
class Scan:
    kind: str | None = None


@dataclass(frozen=True)
class Filter:
    field: str
    value: str
    op: str = ":"


@dataclass(frozen=True)
class Traverse:
    direction: str
    kind: str
    depth: int


@dataclass(frozen=True)
class SetOp:
    """Combines the set that the chain has so far with a plan's; at the head of a chain, two plans."""

    op: str
    right: Plan
    left: Plan | None = None


@dataclass(frozen=True)
class Plan:
    """A chain: its first step makes a set of nodes, each other one narrows, moves or combines it."""

    steps: tuple = ()

    def _and(self, step) -> Plan:
        return replace(self, steps=(*self.steps, step))

    def filter(self, field: str, value: str = "", op: str = ":") -> Plan:
        return self._and(Filter(field, value, op))

    def traverse(self, direction: str, kind: str, depth: int) -> Plan:
        return self._and(Traverse(direction, kind, depth))

    def union(self, other: Plan) -> Plan:
        return self._and(SetOp("union", other))

    def intersect(self, other: Plan) -> Plan:
        return self._and(SetOp("intersect", other))

    def difference(self, other: Plan) -> Plan:
        return self._and(SetOp("difference", other))

    def validate(self) -> Plan:
        if not self.steps or not isinstance(self.steps[0], Scan):
            raise PlanError("a chain starts with a scan")
        for s in self.steps[1:]:
            if isinstance(s, Scan):
                raise PlanError("a scan inside a chain")
            if isinstance(s, Traverse) and (s.depth < 1 or s.direction not in DIRECTIONS):
                raise PlanError(f"bad traversal {s}")
            if isinstance(s, SetOp):
                if s.op not in ("union", "intersect", "difference"):
                    raise PlanError(f"unknown set operation {s.op!r}")
                s.right.validate()
        return self


def scan(kind: str | None = None) -> Plan:
    return Plan((Scan(kind),))


_OPS = {"union": R.union, "intersect": R.intersect, "difference": R.difference}


def nodes_of(g: Graph, plan: Plan) -> DataFrame:
    """The nodes that a plan leaves, one row each."""

    return reduce(lambda now, s: _step(g, now, s), plan.validate().steps, None)


def run(g: Graph, plan: Plan, limit: int = 1_000, most: int = 10_000) -> DataFrame:
    """The first ``limit`` ids in order (``most`` at most), as the planner's queries answer."""
    if limit < 1:
        raise PlanError("a limit is 1 at least")
    return nodes_of(g, plan).select("id").distinct().orderBy("id").limit(min(limit, most))


def run_batch(g: Graph, plans: list[Plan]) -> list[DataFrame]:
    """Plans that share a prefix share its result, kept in the shared folder."""
    from ..core import cut

    uses: dict[tuple, int] = {}
    for p in plans:
        for k in range(2, len(p.validate().steps) + 1):
            uses[p.steps[:k]] = uses.get(p.steps[:k], 0) + 1
    done: dict[tuple, DataFrame] = {}
    out = []
    for p in plans:
        shared = max((k for k in range(2, len(p.steps) + 1) if uses[p.steps[:k]] > 1), default=0)
        if shared and p.steps[:shared] not in done:
            done[p.steps[:shared]] = cut(nodes_of(g, Plan(p.steps[:shared])))
        if not shared:
            out.append(nodes_of(g, p).select("id").distinct())
            continue
        now = done[p.steps[:shared]]
        out.append(reduce(lambda now, s: _step(g, now, s), p.steps[shared:], done[p.steps[:shared]]).select("id").distinct())
    return out


def _step(g: Graph, now: DataFrame | None, s) -> DataFrame:
    if isinstance(s, Scan):
        return g.nodes if s.kind is None else g.nodes.filter(g.nodes.kind == s.kind)
    if isinstance(s, Filter):
        return apply(g, now, Clause(s.field, "" if s.field == "unused" else s.op, s.value))
    if isinstance(s, Traverse):
        ids = T.traverse(now, g.edges if s.kind == "any" else g.of(s.kind), s.depth, s.direction)
    else:
        ids = _OPS[s.op](now, nodes_of(g, s.right))
    return g.nodes.join(ids.select("id").distinct(), "id", "left_semi")
