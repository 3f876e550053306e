"""The syntax tree of a query. at: where in the text a part starts."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field


@dataclass(frozen=True)
class Expr:
    at: int = field(default=0, kw_only=True, compare=False)

    def parts(self) -> tuple[Expr, ...]:
        return ()

    def all(self) -> Iterator[Expr]:
        yield self
        for part in self.parts():
            yield from part.all()


@dataclass(frozen=True)
class Literal(Expr):
    value: object


@dataclass(frozen=True)
class Parameter(Expr):
    name: str


@dataclass(frozen=True)
class Variable(Expr):
    name: str


@dataclass(frozen=True)
class ListOf(Expr):
    items: tuple[Expr, ...]

    def parts(self):
        return self.items


@dataclass(frozen=True)
class MapOf(Expr):
    items: tuple[tuple[str, Expr], ...]

    def parts(self):
        return tuple(e for _, e in self.items)


@dataclass(frozen=True)
class Property(Expr):
    of: Expr
    key: str

    def parts(self):
        return (self.of,)


@dataclass(frozen=True)
class Index(Expr):
    of: Expr
    index: Expr

    def parts(self):
        return self.of, self.index


@dataclass(frozen=True)
class Unary(Expr):
    op: str
    of: Expr

    def parts(self):
        return (self.of,)


@dataclass(frozen=True)
class Binary(Expr):
    op: str
    left: Expr
    right: Expr

    def parts(self):
        return self.left, self.right


@dataclass(frozen=True)
class Call(Expr):
    """star: count(*)."""

    name: str
    args: tuple[Expr, ...]
    distinct: bool = False
    star: bool = False

    def parts(self):
        return self.args


@dataclass(frozen=True)
class NodePattern:
    name: str | None
    type: str | None
    properties: tuple[tuple[str, Expr], ...]
    at: int = 0


@dataclass(frozen=True)
class EdgePattern:
    """direction: out, in or any; hops: least and most if the length varies."""

    name: str | None
    types: tuple[str, ...]
    direction: str
    hops: tuple[int, int] | None
    properties: tuple[tuple[str, Expr], ...]
    at: int = 0


@dataclass(frozen=True)
class Pattern:
    name: str | None
    nodes: tuple[NodePattern, ...]
    edges: tuple[EdgePattern, ...]
    at: int = 0


@dataclass(frozen=True)
class Match:
    patterns: tuple[Pattern, ...]
    optional: bool
    where: Expr | None


@dataclass(frozen=True)
class Projection:
    """items: expression, name, whether the name was given; None for *."""

    items: tuple[tuple[Expr, str, bool], ...] | None
    distinct: bool
    where: Expr | None
    order: tuple[tuple[Expr, bool], ...]
    skip: Expr | None
    limit: Expr | None
    final: bool
    at: int = 0
