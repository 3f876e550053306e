"""Which names a query's clauses know, and of what kind, and where aggregates may stand."""

from __future__ import annotations

from dataclasses import dataclass

from ..errors import QueryError
from .parser import AGGREGATES
from .syntax import Call, Expr, Match, Pattern, Projection, Variable


@dataclass(frozen=True)
class Scoped:
    """A clause with the kinds of the names before and after it: node, edge, edges, path or value."""

    clause: Match | Projection
    before: dict[str, str]
    after: dict[str, str]


def is_aggregate(e: Expr) -> bool:
    return isinstance(e, Call) and e.name in AGGREGATES


def has_aggregate(e: Expr) -> bool:
    return any(map(is_aggregate, e.all()))


def analyse(clauses: list[Match | Projection]) -> list[Scoped]:
    out, scope = [], {}
    for clause in clauses:
        after = matched(clause, scope) if isinstance(clause, Match) else projected(clause, scope)
        out.append(Scoped(clause, scope, after))
        scope = after
    return out


def expressions(clause: Match | Projection) -> list[Expr]:
    """Those written in a clause."""
    if isinstance(clause, Match):
        maps = [p for pattern in clause.patterns for part in (*pattern.nodes, *pattern.edges) for _, p in part.properties]
        return [*maps, *([clause.where] if clause.where else [])]
    return [*(e for e, _, _ in clause.items or ()), *(e for e, _ in clause.order), *(e for e in (clause.where, clause.skip, clause.limit) if e)]


def check(e: Expr, scope: dict[str, str], aggregates: bool = False) -> None:
    for part in e.all():
        if isinstance(part, Variable) and part.name not in scope:
            raise QueryError(f"The name {part.name} is not known here.", part.at)
        if is_aggregate(part):
            if not aggregates:
                raise QueryError("Aggregates stand in what WITH and RETURN compute only.", part.at)
            if any(has_aggregate(a) for a in part.args):
                raise QueryError("An aggregate can't stand in another.", part.at)


def matched(clause: Match, scope: dict[str, str]) -> dict[str, str]:
    after = dict(scope)

    def bind(name: str | None, kind: str, at: int) -> None:
        if name is None:
            return
        if after.get(name, "value") not in (kind, "value"):
            raise QueryError(f"{name} stands for a {after[name]} already.", at)
        after[name] = kind

    def bind_all(pattern: Pattern) -> None:
        bind(pattern.name, "path", pattern.at)
        bind(pattern.nodes[0].name, "node", pattern.nodes[0].at)
        for edge, node in zip(pattern.edges, pattern.nodes[1:], strict=True):
            bind(edge.name, "edges" if edge.hops else "edge", edge.at)
            bind(node.name, "node", node.at)

    for pattern in clause.patterns:
        bind_all(pattern)
        for part in (*pattern.nodes, *pattern.edges):
            for _, e in part.properties:
                check(e, {})
    if clause.where:
        check(clause.where, after)
    return after


def projected(clause: Projection, scope: dict[str, str]) -> dict[str, str]:
    if clause.items is None:
        if not scope:
            raise QueryError("There are no names that * could stand for.", clause.at)
        items = [(Variable(name), name) for name in scope]
    else:
        items = [(e, name) for e, name, _ in clause.items]
    after: dict[str, str] = {}
    for e, name in items:
        check(e, scope, aggregates=True)
        if name in after:
            raise QueryError(f"Two columns are called {name}; give one another name by AS.", e.at)
        after[name] = scope[e.name] if isinstance(e, Variable) else "value"
    grouped = [e for e, _ in items if has_aggregate(e)]
    for e in grouped:
        outside(e)
    if clause.where:
        check(clause.where, after)
    for e, _ in clause.order:
        check(e, after if grouped or clause.distinct else {**scope, **after})
    for e in (clause.skip, clause.limit):
        if e:
            check(e, {})
    return after


def outside(e: Expr) -> None:
    """No names beside aggregates in one expression."""
    if isinstance(e, Variable):
        raise QueryError("What rows are grouped by can't stand in one expression with an aggregate; combine them in another WITH.", e.at)
    if not is_aggregate(e):
        for part in e.parts():
            outside(part)
