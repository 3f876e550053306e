"""Tokens to a syntax tree, by rules of the grammar only; names and aggregates are checked in analysis."""

from __future__ import annotations

from collections.abc import Callable

from ..errors import QueryError, QueryLimitError
from .lexer import Token, tokens
from .syntax import (Binary, Call, EdgePattern, Expr, Index, ListOf, Literal, MapOf, Match, NodePattern, Parameter, Pattern, Projection, Property, Unary, Variable)

DEEPEST, MOST_CLAUSES, MOST_PATTERNS, MOST_SEGMENTS, MOST_HOPS = 48, 24, 12, 12, 6

#: Least and most arguments of each function.
AGGREGATES = {name: (1, 1) for name in ("count", "sum", "avg", "min", "max", "collect")}
FUNCTIONS = AGGREGATES | {name: (1, 1) for name in "tolower lower toupper upper size length id type labels nodes relationships abs".split()} | {"degree": (1, 2), "coalesce": (1, 32)}
#: Operators from the loosest to the tightest level; all group from the left.
LEVELS = (("OR",), ("AND",), ("=", "!=", "<>", "<", ">", "<=", ">=", "IN", "IS", "CONTAINS", "STARTS", "ENDS"), ("+", "-"), ("*", "/", "%"))
LEVEL = {op: n for n, ops in enumerate(LEVELS) for op in ops}
COMPARING, SIGN = LEVEL["="], len(LEVELS)
WORDS = {"TRUE": True, "FALSE": False, "NULL": None}


def parse(text: str, most_hops: int = MOST_HOPS) -> list[Match | Projection]:
    return _Parser(text, most_hops).statement()


class _Parser:
    def __init__(self, text: str, most_hops: int):
        self.text, self.most_hops, self.tokens, self.n, self.depth = text, most_hops, tokens(text), 0, 0

    # tokens

    @property
    def now(self) -> Token:
        return self.tokens[self.n]

    def next(self) -> Token:
        self.n += 1
        return self.tokens[self.n - 1]

    def took(self, *keys: str) -> bool:
        """Goes over the keywords or symbols if they come next."""
        if any(self.tokens[min(self.n + k, len(self.tokens) - 1)].key != key for k, key in enumerate(keys)):
            return False
        self.n += len(keys)
        return True

    def need(self, key: str) -> None:
        if not self.took(key):
            raise QueryError(f"{key} should stand here, not {self.now.value or 'the end'}.", self.now.at)

    def named(self) -> bool:
        return self.now.kind in ("word", "quoted") and bool(self.now.value)

    def name(self) -> str:
        if not self.named():
            raise QueryError("A name should stand here.", self.now.at)
        return str(self.next().value)

    def several(self, item: Callable, between: str = ",") -> list:
        out = [item()]
        while self.took(between):
            out.append(item())
        return out

    # clauses

    def statement(self) -> list[Match | Projection]:
        out: list[Match | Projection] = []
        while not (out and isinstance(out[-1], Projection) and out[-1].final):
            if len(out) == MOST_CLAUSES:
                raise QueryLimitError(f"A query may have {MOST_CLAUSES} clauses.")
            out.append(self.clause())
        self.took(";")
        if self.now.kind != "end":
            raise QueryError("A query is one statement and ends with RETURN.", self.now.at)
        return out

    def clause(self) -> Match | Projection:
        if self.took("OPTIONAL"):
            self.need("MATCH")
            return self.match(True)
        if self.took("MATCH"):
            return self.match(False)
        if self.took("WITH"):
            return self.projection(False)
        if self.took("RETURN"):
            return self.projection(True)
        raise QueryError("A clause is MATCH, OPTIONAL MATCH, WITH or RETURN, and RETURN comes last.", self.now.at)

    def match(self, optional: bool) -> Match:
        patterns = self.several(self.pattern)
        if len(patterns) > MOST_PATTERNS:
            raise QueryLimitError(f"A MATCH may have {MOST_PATTERNS} patterns.")
        return Match(tuple(patterns), optional, self.expression() if self.took("WHERE") else None)

    def projection(self, final: bool) -> Projection:
        at, distinct = self.now.at, self.took("DISTINCT")
        items = None if self.took("*") else tuple(self.several(lambda: self.item(final)))
        where = self.expression() if not final and self.took("WHERE") else None
        order = self.several(self.sorted_by) if self.took("ORDER", "BY") else []
        skip = self.expression() if self.took("SKIP") else None
        limit = self.expression() if self.took("LIMIT") else None
        return Projection(items, distinct, where, tuple(order), skip, limit, final, at)

    def item(self, final: bool) -> tuple[Expr, str, bool]:
        start = self.now.at
        value = self.expression()
        end = self.tokens[self.n - 1].end
        if self.took("AS"):
            return value, self.name(), True
        if isinstance(value, Variable):
            return value, value.name, False
        if not final:
            raise QueryError("In WITH, what is computed needs a name by AS.", start)
        return value, self.text[start:end].strip(), False

    def sorted_by(self) -> tuple[Expr, bool]:
        value = self.expression()
        down = self.took("DESC")
        if not down:
            self.took("ASC")
        return value, down

    # patterns

    def pattern(self) -> Pattern:
        at, name = self.now.at, None
        if self.named() and self.tokens[self.n + 1].key == "=":
            name = self.name()
            self.next()
        nodes, edges = [self.node()], []
        while self.now.key in ("-", "<-"):
            edges.append(self.edge())
            nodes.append(self.node())
            if len(edges) > MOST_SEGMENTS:
                raise QueryLimitError(f"A pattern may have {MOST_SEGMENTS} relationships.")
        return Pattern(name, tuple(nodes), tuple(edges), at)

    def node(self) -> NodePattern:
        at = self.now.at
        self.need("(")
        name = self.name() if self.named() else None
        kind = self.name() if self.took(":") else None
        properties = self.properties() if self.took("{") else ()
        self.need(")")
        return NodePattern(name, kind, properties, at)

    def edge(self) -> EdgePattern:
        at, inward = self.now.at, self.now.key == "<-"
        self.next()
        name, types, hops, properties = None, [], None, ()
        if self.took("["):
            name = self.name() if self.named() else None
            if self.took(":"):
                types = self.several(lambda: (self.took(":"), self.name())[1], "|")
            hops = self.hops() if self.took("*") else None
            properties = self.properties() if self.took("{") else ()
            self.need("]")
        if inward:
            self.need("-")
            direction = "in"
        elif self.took("->"):
            direction = "out"
        else:
            self.need("-")
            direction = "any"
        return EdgePattern(name, tuple(types), direction, hops, properties, at)

    def hops(self) -> tuple[int, int]:
        at = self.now.at
        low = self.whole()
        high = self.whole() if self.took("..") else low
        if not low <= high <= self.most_hops:
            raise QueryError(f"A path has from 0 to {self.most_hops} relationships, the lower bound first.", at)
        return low, high

    def whole(self) -> int:
        if self.now.kind != "number" or not isinstance(self.now.value, int):
            raise QueryError("The length of a path needs whole numbers, as in *2 or *1..3.", self.now.at)
        return self.next().value

    # expressions

    def properties(self) -> tuple[tuple[str, Expr], ...]:
        """After the opening brace."""
        out: dict[str, Expr] = {}

        def one() -> None:
            at, key = self.now.at, self.name()
            if key in out:
                raise QueryError(f"The key {key} is there twice.", at)
            self.need(":")
            out[key] = self.expression()

        if not self.took("}"):
            self.several(one)
            self.need("}")
        return tuple(out.items())

    def expression(self, level: int = 0) -> Expr:
        """What binds at that level or tighter."""
        self.depth += 1
        if self.depth > DEEPEST:
            raise QueryLimitError(f"Expressions may be nested {DEEPEST} deep.", self.now.at)
        value = self.trailed(self.operand())
        while (op := self.now.key) in LEVEL and LEVEL[op] >= level:
            value = self.trailed(self.applied(op, value))
        self.depth -= 1
        return value

    def applied(self, op: str, left: Expr) -> Expr:
        at = self.next().at
        if op == "IS":
            negated = self.took("NOT")
            self.need("NULL")
            return Unary("IS NOT NULL" if negated else "IS NULL", left, at=left.at)
        if op in ("STARTS", "ENDS"):
            self.need("WITH")
            op += " WITH"
        return Binary({"<>": "!="}.get(op, op), left, self.expression(LEVEL[op.split()[0]] + 1), at=left.at if left.at else at)

    def trailed(self, value: Expr) -> Expr:
        """With the properties and indexes that follow."""
        while self.now.key in (".", "["):
            if self.next().key == ".":
                value = Property(value, self.name(), at=value.at)
            else:
                value = Index(value, self.expression(), at=value.at)
                self.need("]")
        return value

    def operand(self) -> Expr:
        token = self.now
        if token.kind in ("number", "string"):
            return Literal(self.next().value, at=token.at)
        if token.kind == "parameter":
            return Parameter(str(self.next().value), at=token.at)
        if token.key == "NOT":
            self.next()
            return Unary("NOT", self.expression(COMPARING), at=token.at)
        if token.key in WORDS:
            self.next()
            return Literal(WORDS[token.key], at=token.at)
        if token.key in ("-", "+"):
            self.next()
            return Unary(token.key, self.expression(SIGN), at=token.at)
        if self.took("("):
            value = self.expression()
            self.need(")")
            return value
        if self.took("["):
            items = [] if self.now.key == "]" else self.several(self.expression)
            self.need("]")
            return ListOf(tuple(items), at=token.at)
        if self.took("{"):
            return MapOf(self.properties(), at=token.at)
        if self.named():
            name = self.name()
            return self.call(name, token.at) if self.took("(") else Variable(name, at=token.at)
        raise QueryError("An expression should stand here.", token.at)

    def call(self, written: str, at: int) -> Call:
        """After the opening parenthesis."""
        name = written.lower()
        if name not in FUNCTIONS:
            raise QueryError(f"There is no function {written}.", at)
        distinct = self.took("DISTINCT")
        if self.took("*"):
            if name != "count" or distinct:
                raise QueryError("Only count(*) takes a star.", at)
            self.need(")")
            return Call(name, (), star=True, at=at)
        args = [] if self.now.key == ")" else self.several(self.expression)
        self.need(")")
        least, most = FUNCTIONS[name]
        if not least <= len(args) <= most:
            raise QueryError(f"{written} takes {least if least == most else f'{least} to {most}'} arguments.", at)
        if distinct and name not in AGGREGATES:
            raise QueryError(f"DISTINCT belongs in aggregates, not in {written}.", at)
        return Call(name, tuple(args), distinct, at=at)
