"""A checked query to a DataFrame.

Rows of bindings are a DataFrame whose columns have names of the compiler's own: a node or edge is its id, a
path a struct of ids, anything else its value. Attributes come by joins when an expression asks for them, or
with the scan if they are known to be asked for. Order and provenance are extra columns, made only if
something depends on them.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field, replace
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..errors import QueryError
from ..functions import typed as V
from ..functions.typed import BOOLEAN, EDGE, INTEGER, NODE, NULL, PATH, STRING, Kind, Typed
from ..graph import ORD, PROPERTIES, PropertyGraph
from .analysis import Scoped, expressions, has_aggregate, is_aggregate
from .syntax import (Binary, Call, EdgePattern, Expr, Index, ListOf, Literal, MapOf, Match, NodePattern, Parameter, Pattern, Projection, Property, Unary, Variable)

#: PRIOR: what a WITH ... ORDER BY has sorted by and the order before it; ORDER is the order of what was matched since.
ORDER, PRIOR, SEEN_NODES, SEEN_EDGES, FIRST = "__order", "__prior", "__nodes", "__edges", "__first"
#: Rows of one value that are met in several places if there are more, and the power of two of rows read one after the other of which those of one value meet others as one list.
FEW, RUN = 4096, 15


@dataclass
class Rows:
    """Bindings. frame None: the one empty row that a query starts from."""

    frame: DataFrame | None
    names: dict[str, Typed] = field(default_factory=dict)
    attributes: dict[tuple[str, str], Typed] = field(default_factory=dict)
    extras: tuple[str, ...] = ()
    #: All nodes of a type, or all there are, once each.
    plain: bool = False

    @property
    def place(self) -> list[Column]:
        """What rows are ordered by."""
        return [F.col(x) for x in (PRIOR, ORDER) if x in self.extras]

    def having(self, condition: Column) -> None:
        self.frame = self.frame.where(condition)


@dataclass
class Result:
    """frame: the rows in order, with a column c0, c1, ... for each name, and the extras asked for. counted: names of the metrics that the job takes, and whether each is of rows after a clause (else after a join). types: for each name those that its nodes or edges have, none if that isn't known."""

    frame: DataFrame
    columns: list[tuple[str, Kind]]
    counted: dict[str, bool]
    types: list[tuple[str, ...]] = field(default_factory=list)

    def named(self) -> DataFrame:
        return self.frame.select(*(F.col(f"c{k}").alias(name) for k, (name, _) in enumerate(self.columns)))


def conjuncts(e: Expr | None) -> list[Expr]:
    if isinstance(e, Binary) and e.op == "AND":
        return conjuncts(e.left) + conjuncts(e.right)
    return [] if e is None else [e]


class Compiler:
    def __init__(self, graph: PropertyGraph, parameters: dict, order: bool, provenance: bool, most: tuple[int, int] | None = None):
        """most: the rows after a scan or join, and after a clause, that are let through, and one more; None: all, and none are counted."""
        self.graph, self.spark, self.parameters, self.order, self.provenance, self.most, self.made = graph, graph.spark, parameters, order, provenance, most, 0
        self.counted: dict[str, bool] = {}
        self.wanted: dict[str, set[str]] = {}
        #: Aggregates of rows that stand for many each: how they are had, as aggregate() returns it.
        self.weighted: dict[Call, Callable] = {}
        #: By the column that holds them, the types that a pattern asks of nodes or edges.
        self.types: dict[str, tuple[str, ...]] = {}
        #: What the WHERE of the MATCH at work asks, and the frame that is a scan alone.
        self.asked: list[Expr] = []
        self.alone: DataFrame | None = None

    def fresh(self, kind: str) -> str:
        self.made += 1
        return f"__{kind}{self.made}"

    def compile(self, clauses: list[Scoped]) -> Result:
        for scoped in clauses:
            for e in expressions(scoped.clause):
                for part in e.all():
                    if isinstance(part, Parameter) and part.name not in self.parameters:
                        raise QueryError(f"There is no parameter ${part.name}.", part.at)
                    if isinstance(part, Property) and isinstance(part.of, Variable):
                        self.wanted.setdefault(part.of.name, set()).add(part.key)
                    if isinstance(part, Call) and part.name in ("type", "labels") and isinstance(part.args[0], Variable):
                        self.wanted.setdefault(part.args[0].name, set()).add("type")
        extras = (ORDER,) * self.order + (SEEN_NODES, SEEN_EDGES) * self.provenance
        rows, clauses = Rows(None, extras=extras), list(clauses)
        for k, scoped in enumerate(clauses):
            if isinstance(scoped.clause, Projection):
                rows = self.project(rows, scoped)
            elif left := self.without_matches(rows, scoped, clauses[k + 1]):
                rows, clauses[k + 1] = left
            elif folded := self.folded(rows, scoped, clauses[k + 1]):
                rows = folded
            elif self.only_asks(rows, scoped, clauses[k + 1 :]):
                rows = self.beside(rows, scoped.clause, "left_semi")
            else:
                rows = self.match(rows, scoped)
            if k < len(clauses) - 1:
                self.count(rows, after_clause=True)
        columns = [(name, value.kind) for name, value in rows.names.items()]
        frame = rows.frame.select(*(value.col.alias(f"c{k}") for k, value in enumerate(rows.names.values())), *extras)
        return Result(frame, columns, self.counted, [self.types.get(value.place, ()) for value in rows.names.values()])

    def count(self, rows: Rows, after_clause: bool = False) -> None:
        """Lets through one row more than are allowed at most, so that the job stops early, and has it count them."""
        if self.most is not None:
            name = f"{self.fresh('count')}-{id(self)}"
            self.counted[name] = after_clause
            rows.frame = rows.frame.limit(self.most[after_clause] + 1).observe(name, F.count(F.lit(1)).alias("n"))

    # attributes

    def start(self, rows: Rows) -> None:
        """Makes the one empty row a frame."""
        if rows.frame is None:
            kinds = {ORDER: "array<bigint>"}
            rows.frame = self.spark.range(1).select(F.lit(0).alias("__one"), *(F.array().cast(kinds.get(x, "array<string>")).alias(x) for x in rows.extras))

    def table(self, kind: Kind) -> DataFrame:
        return self.graph.nodes if kind is NODE else self.graph.edges

    def stored(self, table: DataFrame, key: str) -> Typed | None:
        """The attribute of that table's rows: a column of its own, else a property; None if no row has it."""
        schema = table.schema
        if key in schema.names and key != ORD:
            return V.of_type(F.col(f"`{key}`"), schema[key].dataType)
        own = schema[PROPERTIES].dataType if PROPERTIES in schema.names else None
        if isinstance(own, T.StructType) and key in own.names:
            return V.of_type(F.col(PROPERTIES)[key], own[key].dataType)
        if isinstance(own, (T.MapType, T.VariantType)):
            return V.field(V.of_type(F.col(PROPERTIES), own), key, 0)
        return None

    def attribute(self, rows: Rows, entity: Typed, key: str) -> Typed:
        if key == "id":
            return Typed(entity.col, STRING)
        table = self.table(entity.kind)
        found = self.stored(table, key)
        if found is None:
            return V.literal(None)
        name = self.column(rows, entity)
        if (name, key) not in rows.attributes:
            here, there = self.fresh("a"), self.fresh("j")
            rows.frame = rows.frame.join(table.select(F.col("id").alias(there), found.col.alias(here)), F.col(name) == F.col(there), "left").drop(there)
            rows.attributes[name, key] = replace(found, col=F.col(here), place=here)
        return rows.attributes[name, key]

    def column(self, rows: Rows, value: Typed) -> str:
        """The name of a column that holds the value, a new one if need be."""
        if value.place:
            return value.place
        name = self.fresh("v")
        rows.frame = rows.frame.withColumn(name, value.col)
        return name

    @staticmethod
    def at(place: str, kind: Kind) -> Typed:
        return Typed(F.col(place), kind, place=place)

    def scanned(self, kind: Kind, name: str | None, identity: str, extra: list[Column] = (), where: tuple[str, ...] = (), properties: tuple = (), table: DataFrame | None = None) -> tuple[DataFrame, dict]:
        """A scan with the attributes that the name is asked for later, filtered by types and properties, and where those attributes are."""
        table = self.table(kind) if table is None else table
        if where:
            table = table.where(F.col("type").isin(*where))
        for key, e in properties:
            found = self.stored(table, key)
            wanted = self.value(Rows(None), e)
            table = table.where(V.equal(found, wanted).col if found is not None else F.lit(False))
        columns, places = [F.col("id").alias(identity), *extra], {}
        for key in sorted(self.wanted.get(name, ())) if name else ():
            found = None if key == "id" else self.stored(table, key)
            if found is not None:
                here = self.fresh("a")
                columns.append(found.col.alias(here))
                places[identity, key] = replace(found, col=F.col(here), place=here)
                if found.kind is V.ANY:
                    columns += V.facts_of(found, here)
                    places[identity, key] = replace(places[identity, key], facts=here)
        return table.select(*columns), places

    # MATCH

    def match(self, rows: Rows, scoped: Scoped) -> Rows:
        clause: Match = scoped.clause
        if not clause.optional:
            node = clause.patterns[0].nodes[0]
            plain = rows.frame is None and len(clause.patterns) == 1 and not clause.patterns[0].edges and not node.properties and not clause.where
            return replace(self.matched(rows, clause), plain=plain)
        self.start(rows)
        shared = {n for n in self.mentioned(clause) if n in scoped.before}
        if not self.provenance and len(shared) <= 1 and all(rows.names[n].kind is NODE for n in shared):
            return self.optional_beside(rows, clause, shared)
        key, pieces = self.fresh("k"), rows.extras
        if ORDER not in pieces:
            raise AssertionError("an optional match of this kind needs the order")
        # rows of one place in the order differ in what they bind
        bound = [v.col for v in rows.names.values() if v.kind.group in ("node", "edge", "string", "number", "boolean")]
        rows.frame = rows.frame.withColumn(key, F.struct(*rows.place, *(c.alias(f"b{k}") for k, c in enumerate(bound))))
        inner = self.matched(replace(rows, names=dict(rows.names), attributes=dict(rows.attributes)), clause)
        new = {n: v for n, v in inner.names.items() if n not in scoped.before}
        other = self.fresh("k")
        columns = {self.fresh("v"): v for v in new.values()}
        found = inner.frame.select(F.col(key).alias(other), *(v.col.alias(c) for c, v in columns.items()), *(F.col(x).alias(f"{x}_found") for x in pieces))
        frame = rows.frame.join(found, F.col(key) == F.col(other), "left").drop(key, other)
        for x in pieces:
            frame = frame.withColumn(x, F.coalesce(F.col(f"{x}_found"), F.col(x))).drop(f"{x}_found")
        names = rows.names | {n: self.at(c, v.kind) for n, (c, v) in zip(new, columns.items(), strict=True)}
        return Rows(frame, names, dict(rows.attributes), pieces)

    def mentioned(self, clause: Match) -> set[str]:
        """Names in a MATCH, those in its WHERE too."""
        out = {p.name for pattern in clause.patterns for p in (pattern, *pattern.nodes, *pattern.edges) if p.name}
        return out | {e.name for e in (clause.where.all() if clause.where else ()) if isinstance(e, Variable)}

    def optional_beside(self, rows: Rows, clause: Match, shared: set[str]) -> Rows:
        """An optional match that knows one node of the rows at most: made once for all nodes, then joined by that node."""
        wanted = self.wanted
        # what is asked of the shared node elsewhere, its rows have already
        asked = {n: {p.key for p in (clause.where.all() if clause.where else ()) if isinstance(p, Property) and p.of == Variable(n)} for n in shared}
        self.wanted = wanted | asked
        inner = self.matched(self.around(rows, shared), clause)
        self.wanted = wanted
        new = {n: v for n, v in inner.names.items() if n not in shared}
        here = {n: self.column(inner, v) for n, v in new.items()}
        attributes = {k: replace(v, facts=None) for k, v in inner.attributes.items() if k[0] in here.values()}
        keep = [*here.values(), *(v.col for v in attributes.values()), *(F.col(x).alias(f"{x}_found") for x in inner.extras)]
        on = [(rows.names[n].col, self.fresh("k"), inner.names[n].col) for n in shared]
        found = inner.frame.select(*keep, *(col.alias(there) for _, there, col in on))
        condition = reduce(Column.__and__, (mine == F.col(there) for mine, there, _ in on), F.lit(True))
        frame = rows.frame.join(found, condition, "left").drop(*(there for _, there, _ in on))
        for x in inner.extras:
            frame = frame.withColumn(x, F.concat(F.col(x), F.coalesce(F.col(f"{x}_found"), F.array().cast("array<bigint>")))).drop(f"{x}_found")
        return Rows(frame, rows.names | {n: self.at(here[n], v.kind) for n, v in new.items()}, rows.attributes | attributes, rows.extras)

    def around(self, rows: Rows, shared: set[str]) -> Rows:
        """Where an optional match starts: the distinct nodes that the rows have, or nothing if they have all of a type anyway."""
        extras = tuple(x for x in rows.extras if x != PRIOR)
        if rows.plain or not shared:
            return Rows(None, extras=extras)
        (name,) = shared
        here = self.fresh("n")
        known = rows.frame.select(rows.names[name].col.alias(here)).where(F.col(here).isNotNull()).distinct()
        kinds = {ORDER: "array<bigint>"}
        return Rows(known.select("*", *(F.array().cast(kinds.get(x, "array<string>")).alias(x) for x in extras)), {name: self.at(here, NODE)}, {}, extras)

    def shared_node(self, rows: Rows, scoped: Scoped) -> str | None:
        """The one name that a MATCH shares with the rows, if it is a node and nothing depends on order or provenance."""
        shared = {n for n in self.mentioned(scoped.clause) if n in scoped.before}
        if self.order or self.provenance or len(shared) != 1 or rows.frame is None:
            return None
        (name,) = shared
        return name if rows.names[name].kind is NODE else None

    def beside(self, rows: Rows, clause: Match, how: str) -> Rows:
        """The rows for which the MATCH, which shares one node with them, has matches (left_semi) or none (left_anti)."""
        (name,) = {n for n in self.mentioned(clause) if n in rows.names}
        wanted, self.wanted = self.wanted, {n: {p.key for p in (clause.where.all() if clause.where else ()) if isinstance(p, Property) and p.of == Variable(n)} for n in self.mentioned(clause)}
        inner, there = self.matched(Rows(None), clause), self.fresh("k")
        self.wanted = wanted
        found = inner.frame.select(inner.names[name].col.alias(there))
        frame = rows.frame.join(found, rows.names[name].col == F.col(there), how)
        return Rows(frame, dict(rows.names), dict(rows.attributes), rows.extras)

    def without_matches(self, rows: Rows, scoped: Scoped, after: Scoped) -> tuple[Rows, Scoped] | None:
        """OPTIONAL MATCH, then a grouping by its node that keeps groups where the count of what it matched is 0: an anti join, and the groups without the count."""
        clause, then = scoped.clause, after.clause
        name = self.shared_node(rows, scoped)
        if not clause.optional or not isinstance(then, Projection) or then.items is None or name is None:
            return None
        new = {n for n in scoped.after if n not in scoped.before}
        counts = {alias for e, alias, _ in then.items if isinstance(e, Call) and e.name == "count" and not e.star and isinstance(e.args[0], Variable) and e.args[0].name in new}
        keys = [e for e, alias, _ in then.items if alias not in counts]
        by_node = any(e in (Variable(name), Property(Variable(name), "id"), Call("id", (Variable(name),))) for e in keys)
        settled = {p.left.name for p in conjuncts(then.where) if isinstance(p, Binary) and p.op == "=" and isinstance(p.left, Variable) and p.right == Literal(0) and not isinstance(p.right.value, bool)}
        touched = any(has_aggregate(e) or any(isinstance(p, Variable) and p.name in new for p in e.all()) for e in keys)
        if not by_node or touched or not counts & settled:
            return None
        items = tuple((Literal(0), alias, more) if alias in counts else (e, alias, more) for e, alias, more in then.items)
        return self.beside(rows, clause, "left_anti"), replace(after, clause=replace(then, items=items, distinct=True))

    def only_asks(self, rows: Rows, scoped: Scoped, later: list[Scoped]) -> bool:
        """Whether a MATCH only asks if there is something beside its one known node: nothing later names what it finds, and what comes next doesn't see how often."""
        then = later[0].clause
        if scoped.clause.optional or not isinstance(then, Projection) or then.items is None or self.shared_node(rows, scoped) is None:
            return False
        new = {n for n in scoped.after if n not in scoped.before}
        if any(isinstance(p, Variable) and p.name in new for e in expressions(then) for p in e.all()):
            return False
        calls = [p for e, _, _ in then.items for p in e.all() if is_aggregate(p)]
        if not calls:
            return then.distinct
        return all(p.name in ("min", "max") or p.distinct and p.name in ("count", "sum", "avg") for p in calls)

    def folded(self, rows: Rows, scoped: Scoped, after: Scoped) -> Rows | None:
        """Two patterns that share one node and are only counted and summed: rows of the first, each with what the second has at that node, counted there already, so that no pair is a row. None if that can't be."""
        clause, then = scoped.clause, after.clause
        if self.order or self.provenance or self.most is not None or rows.frame is not None or clause.optional or clause.where or len(clause.patterns) != 2 or not isinstance(then, Projection) or then.items is None:
            return None
        calls = list(dict.fromkeys(p for e, _, _ in then.items for p in e.all() if is_aggregate(p)))
        names = [self.mentioned(Match((p,), False, None)) for p in clause.patterns]
        asked = lambda e: {p.name for p in e.all() if isinstance(p, Variable)}
        keys = {n for e, _, _ in then.items if not has_aggregate(e) for n in asked(e)}
        shared = names[0] & names[1]
        if not calls or len(shared) != 1 or scoped.after[min(shared)] != "node" or any(p.name for p in clause.patterns) or not self.apart(clause):
            return None
        one, two = clause.patterns if keys <= names[0] else clause.patterns[::-1]
        mine, other = self.mentioned(Match((one,), False, None)), self.mentioned(Match((two,), False, None)) - shared
        parts = {c: self.sides(c, mine, other) for c in calls}
        if not keys <= mine or None in parts.values():
            return None
        # what is asked of the shared node, the first pattern has
        wanted, self.wanted = self.wanted, {n: keys for n, keys in self.wanted.items() if n in other}
        there = self.matched(Rows(None), Match((two,), False, None))
        self.wanted = wanted
        here = self.matched(Rows(None), Match((one,), False, None))
        node, much = min(shared), self.fresh("w")
        sums, how = [F.count(F.lit(1)).alias(much)], {}
        for call, (own, far, op) in parts.items():
            value = self.kept(there, self.value(there, far)) if far is not None else None
            mine_ = self.value(here, own) if own is not None else None
            fit = ("number", "string", "boolean", *(("node", "edge") if call.name == "count" else ()))
            if any(v is not None and (v.kind is not V.FLOAT if call.name == "sum" else v.kind.group not in fit) for v in (mine_, value)):
                return None
            at = self.fresh("w")
            if value is not None:
                sums += [f(value.col).alias(at + k) for k, f in (("n", F.count), ("low", F.min), ("high", F.max), *((("sum", F.sum),) if call.name == "sum" else ()))]
            how[call] = self.weighed(call, own, value, op, much, at)
        key = self.fresh("k")
        found = there.frame.groupBy(there.names[node].col.alias(key)).agg(*sums)
        here.frame = here.frame.join(found, here.names[node].col == F.col(key)).drop(key)
        self.weighted |= how
        return here

    @staticmethod
    def sides(call: Call, mine: set[str], other: set[str]) -> tuple[Expr | None, Expr | None, str] | None:
        """The part of what is aggregated that the first pattern knows, the part that the second does, and what joins them; None if it isn't made of two such parts."""
        if call.star:
            return None, None, ""
        if call.name not in ("count", "sum", "min", "max") or call.distinct and call.name in ("count", "sum"):
            return None
        e = call.args[0]
        names = lambda e: {p.name for p in e.all() if isinstance(p, Variable)}
        if names(e) <= mine:
            return e, None, ""
        if names(e) <= other:
            return None, e, ""
        if call.name == "sum" and isinstance(e, Binary) and e.op in ("+", "-"):
            if names(e.left) <= mine and names(e.right) <= other:
                return e.left, e.right, e.op
            if names(e.left) <= other and names(e.right) <= mine:
                return e.right, e.left, "turned" + e.op
        return None

    def weighed(self, call: Call, own: Expr | None, value: Typed | None, op: str, much: str, at: str) -> Callable:
        """An aggregate over rows that stand for as many as the column much says; value has its count, extremes and sum in columns that start with at."""

        def of(rows: Rows):
            number = lambda c: (F.coalesce(F.sum(c), F.lit(0).cast("bigint")), lambda x: Typed(x, INTEGER))
            weight = F.col(much)
            if call.star:
                return number(weight)
            mine = self.value(rows, own) if own is not None else None
            if call.name == "count":
                return number(F.when(mine.col.isNotNull(), weight) if mine is not None else F.col(at + "n"))
            if call.name in ("min", "max"):
                least = mine.col if mine is not None else F.col(at + ("low" if call.name == "min" else "high"))
                return (F.min if call.name == "min" else F.max)(least), lambda x: Typed(x, (mine or value).kind)
            if mine is None:
                total = F.col(at + "sum")
            elif value is None:
                total = mine.col * weight
            else:
                # the pairs of the least and the greatest value fail if any pair does
                less = lambda x: V.computed(op[-1], *((Typed(x, V.FLOAT), mine) if op[0] == "t" else (mine, Typed(x, V.FLOAT))), call.args[0].at).col
                n, total = F.col(at + "n"), F.col(at + "sum")
                pairs = {"+": mine.col * n + total, "-": mine.col * n - total, "turned+": mine.col * n + total, "turned-": total - mine.col * n}[op]
                total = F.when(less(F.col(at + "low")).isNotNull() & less(F.col(at + "high")).isNotNull(), pairs)
            return F.coalesce(F.sum(total), F.lit(0.0)), lambda x: V.finite(Typed(x, V.FLOAT), call.at)

        return of

    @staticmethod
    def apart(clause: Match) -> bool:
        """Whether no edge can stand in both patterns: by its types, or by the types of the nodes at one of its ends."""
        types = {n.name: n.type for p in clause.patterns for n in p.nodes if n.name and n.type}

        def ends(pattern: Pattern, k: int) -> list[str | None]:
            found = [n.type or types.get(n.name) for n in pattern.nodes[k : k + 2]]
            return {"out": found, "in": found[::-1]}.get(pattern.edges[k].direction, [None, None])

        def differ(a: tuple[Pattern, int], b: tuple[Pattern, int]) -> bool:
            one, two = (p.edges[k] for p, k in (a, b))
            if one.types and two.types and not set(one.types) & set(two.types):
                return True
            return not one.hops and not two.hops and any(x and y and x != y for x, y in zip(ends(*a), ends(*b), strict=True))

        one, two = ([(p, k) for k in range(len(p.edges))] for p in clause.patterns)
        return all(differ(a, b) for a in one for b in two)

    def matched(self, rows: Rows, clause: Match) -> Rows:
        used: list[tuple[str, bool, tuple[str, ...]]] = []
        self.asked = conjuncts(clause.where)
        for pattern in clause.patterns:
            rows = self.pattern(rows, pattern, used)
        if clause.where:
            keep = V.narrowed(self.value(rows, clause.where), "boolean", "WHERE needs a boolean.", clause.where.at)
            rows.having(keep.col)
        return rows

    def pattern(self, rows: Rows, pattern: Pattern, used: list) -> Rows:
        """Built from a node that is bound already, if there is one, to its right and then to its left."""
        rows = replace(rows, names=dict(rows.names), attributes=dict(rows.attributes))
        bound = [k for k, n in enumerate(pattern.nodes) if n.name in rows.names]
        first = bound[0] if bound else 0
        first_known = pattern.nodes[0].name in rows.names
        at: list[str] = [""] * len(pattern.nodes)
        if bound:
            at[first] = self.seek(rows, pattern.nodes[first])
        elif not self.bare(pattern):
            at[0] = self.scan(rows, pattern.nodes[0])
        hops: list[dict] = [{}] * len(pattern.edges)
        for k in range(first, len(pattern.edges)):
            if at[k + 1]:
                continue
            if at[k] and self.closes(rows, pattern, k):
                at[k + 1], at[k + 2], hops[k], hops[k + 1] = self.close(rows, at[k], pattern, k, used)
                continue
            if not at[k]:
                at[k] = self.fresh("n")
                self.begin(rows, at[k], pattern.nodes[k])
                at[k + 1], hops[k] = self.expand(rows, at[k], pattern.edges[k], pattern.nodes[k + 1], False, used, True)
                continue
            at[k + 1], hops[k] = self.expand(rows, at[k], pattern.edges[k], pattern.nodes[k + 1], False, used)
        for k in range(first - 1, -1, -1):
            at[k], hops[k] = self.expand(rows, at[k + 1], pattern.edges[k], pattern.nodes[k], True, used)
        nodes, edges = [F.array(F.col(at[0]))], [F.array().cast("array<string>")]
        for k, hop in enumerate(hops):
            if hop["many"]:
                between = F.col(hop["nodes"]) if k >= first else F.reverse(F.concat(F.array(F.col(at[k + 1])), F.slice(F.col(hop["nodes"]), F.lit(1), F.size(hop["nodes"]) - 1))) if hop["most"] else F.col(hop["nodes"])
                nodes.append(F.when(F.size(hop["edges"]) > 0, between).otherwise(F.array().cast("array<string>")))
                edges.append(F.col(hop["edges"]) if k >= first else F.reverse(hop["edges"]))
            else:
                nodes.append(F.array(F.col(at[k + 1])))
                edges.append(F.array(F.col(hop["edges"])))
        if pattern.name:
            path = F.struct(F.concat(*nodes).alias("nodes"), F.concat(*edges).alias("edges"))
            self.bind(rows, pattern.name, Typed(path, PATH))
        if ORDER in rows.extras:
            start = [] if first_known else [F.array(self.attribute_ord(rows, at[0]))]
            steps = [x for k, hop in enumerate(hops) for x in (F.col(hop["ord"]) if k >= first or not hop["many"] else F.reverse(hop["ord"]), F.array(F.lit(-1).cast("bigint")))]
            rows.frame = rows.frame.withColumn(ORDER, F.concat(F.col(ORDER), *start, *steps))
        if SEEN_NODES in rows.extras:
            rows.frame = rows.frame.withColumn(SEEN_NODES, F.concat(F.col(SEEN_NODES), *nodes)).withColumn(SEEN_EDGES, F.concat(F.col(SEEN_EDGES), *edges))
        return rows

    def bare(self, pattern: Pattern) -> bool:
        """Whether nothing is asked of the first node but its edge, so that the edges alone can start the pattern."""
        node = pattern.nodes[0]
        asked = node.type or node.properties or any(k != "id" for k in self.wanted.get(node.name, ()))
        return bool(pattern.edges) and not pattern.edges[0].hops and not asked and not self.order

    def begin(self, rows: Rows, here: str, node: NodePattern) -> None:
        if node.name:
            rows.names[node.name] = self.at(here, NODE)

    def attribute_ord(self, rows: Rows, name: str) -> Column:
        if (name, ORD) not in rows.attributes:
            here, there = self.fresh("a"), self.fresh("j")
            rows.frame = rows.frame.join(self.graph.nodes.select(F.col("id").alias(there), F.col(ORD).cast("bigint").alias(here)), F.col(name) == F.col(there), "left").drop(there)
            rows.attributes[name, ORD] = self.at(here, INTEGER)
        return rows.attributes[name, ORD].col

    def bind(self, rows: Rows, name: str, value: Typed) -> None:
        """A new name, or the condition that the old one is equal."""
        if name in rows.names:
            rows.having(V.equal(rows.names[name], value).col)
            return
        here = self.fresh("v")
        rows.frame = rows.frame.withColumn(here, value.col)
        rows.names[name] = self.at(here, value.kind)

    def scan(self, rows: Rows, pattern: NodePattern) -> str:
        here, extra = self.fresh("n"), []
        self.types[here] = (pattern.type,) if pattern.type else ()
        if self.order:
            extra = [F.col(ORD).cast("bigint").alias(f"{here}_ord")]
        found, places = self.scanned(NODE, pattern.name, here, extra, (pattern.type,) if pattern.type else (), pattern.properties)
        if rows.frame is None:
            kinds = {ORDER: "array<bigint>"}
            rows.frame = self.alone = found.select("*", *(F.array().cast(kinds.get(x, "array<string>")).alias(x) for x in rows.extras))
        elif keys := self.same(rows, pattern, {key: value for (_, key), value in places.items()}):
            rows.frame = self.met(rows.frame, found, *keys)
        else:
            # every row meets all others, so a table of one small file is dealt to all cores first
            rows.frame = rows.frame.repartition(4 * self.spark.sparkContext.defaultParallelism).crossJoin(found)
        self.count(rows)
        rows.attributes |= places
        if self.order:
            rows.attributes[here, ORD] = self.at(f"{here}_ord", INTEGER)
        if pattern.name:
            rows.names[pattern.name] = self.at(here, NODE)
        return here

    def same(self, rows: Rows, pattern: NodePattern, new: dict[str, Typed]) -> tuple[Column, Column] | None:
        """What WHERE asks to be equal of a scan and the node that is scanned next, if nothing depends on order, provenance or counts."""
        if rows.frame is not self.alone or self.order or self.provenance or self.most is not None:
            return None
        for e in self.asked:
            if not isinstance(e, Binary) or e.op != "=" or not all(isinstance(x, Property) and isinstance(x.of, Variable) for x in (e.left, e.right)):
                continue
            for old, other in ((e.left, e.right), (e.right, e.left)):
                mine, its = rows.attributes.get((rows.names[old.of.name].place, old.key)) if old.of.name in rows.names else None, new.get(other.key)
                if other.of.name != pattern.name or mine is None or its is None:
                    continue
                if V.ANY in (mine.kind, its.kind):
                    return V.canonical(mine), V.canonical(its)
                if mine.kind == its.kind and mine.kind.group in ("number", "string", "boolean"):
                    return mine.col, its.col
        return None

    def met(self, one: DataFrame, two: DataFrame, key: Column, other: Column) -> DataFrame:
        """Rows of one with those of two that have an equal key. Pairs may grow with the square of the rows of a key, so rows of two that are read one
        after the other meet those of one as one list: the pairs of a list are made side by side, there are few values among them, and what is
        written of them compresses. Frequent keys are met in as many places as there are cores. No task holds more pairs than a list has rows."""
        cores = self.spark.sparkContext.defaultParallelism
        mine, its, frequent, place, its_place, run, listed = (self.fresh(k) for k in ("k", "k", "k", "p", "p", "u", "l"))
        many = one.groupBy(key.alias(frequent)).count().where(F.col("count") > FEW).select(frequent)

        def dealt(table: DataFrame, key: Column, name: str, place: str, places: Column) -> DataFrame:
            table = table.withColumn(name, key).where(F.col(name).isNotNull()).withColumn(run, F.shiftright(F.monotonically_increasing_id(), RUN))
            return table.join(F.broadcast(many), F.col(name) == F.col(frequent), "left").withColumn(place, places).repartition(8 * cores, name, place)

        first = dealt(one, key, mine, place, F.when(F.col(frequent).isNotNull(), F.pmod(F.hash(F.col(one.columns[0])), F.lit(cores))).otherwise(0)).select(*one.columns, mine, place)
        second = dealt(two, other, its, its_place, F.explode(F.when(F.col(frequent).isNotNull(), F.sequence(F.lit(0), F.lit(cores - 1))).otherwise(F.array(F.lit(0)))))
        lists = second.groupBy(its, its_place, run).agg(F.collect_list(F.struct(*two.columns)).alias(listed))
        # the lists come first: a sort-merge join goes through the rows for each of them
        pairs = lists.join(first, (F.col(mine) == F.col(its)) & (F.col(place) == F.col(its_place)))
        return pairs.select(*one.columns, F.inline(listed).alias(*two.columns))

    def seek(self, rows: Rows, pattern: NodePattern) -> str:
        """A pattern that starts at a bound name: only nodes match, null doesn't."""
        value = rows.names[pattern.name]
        if value.kind is not NODE:
            self.start(rows)
            rows.having(F.lit(False))
            value = Typed(F.lit(None).cast("string"), NODE)
        here = self.column(rows, value)
        self.tested(rows, here, pattern)
        rows.having(F.col(here).isNotNull())
        return here

    def tested(self, rows: Rows, here: str, pattern: NodePattern) -> None:
        node = self.at(here, NODE)
        if pattern.type:
            rows.having(self.attribute(rows, node, "type").col == pattern.type)
        for key, e in pattern.properties:
            rows.having(V.equal(self.attribute(rows, node, key), self.value(rows, e)).col)

    def steps(self, pattern: EdgePattern, backwards: bool, identity: str, away: str, to: str, nth: str, far: bool = False) -> tuple[DataFrame, dict]:
        """Edges as steps from one node to another; far: they are met at the other node."""
        source, target = ("source", "target") if (pattern.direction == "in") == backwards else ("target", "source")
        ord_ = [F.col(ORD).cast("bigint").alias(nth)] if self.order else []
        ends = [F.col(source).alias(away), F.col(target).alias(to)]
        # edges that are stored by the end that they are met at needn't move
        stored = self.graph.by_target if (target if far else source) == "target" and pattern.direction != "any" else None
        found, places = self.scanned(EDGE, None if pattern.hops else pattern.name, identity, [*ends, *ord_], pattern.types, pattern.properties, stored)
        if pattern.direction == "any":
            turned = found.where(F.col(away) != F.col(to)).withColumns({away: F.col(to), to: F.col(away)})
            found = found.unionByName(turned)
        return found, places

    def unused(self, used: list, edge: str, types: tuple[str, ...]) -> Column:
        """The condition that the edge isn't one of those used before; patterns of other types needn't be asked."""
        out = F.lit(True)
        for other, many, others in used:
            if not types or not others or set(types) & set(others):
                out = out & (~F.array_contains(other, F.col(edge)) if many else F.col(other) != F.col(edge))
        return out

    def expand(self, rows: Rows, start: str, pattern: EdgePattern, node: NodePattern, backwards: bool, used: list, begins: bool = False, far: bool = False) -> tuple[str, dict]:
        """Rows with the edge and the node at its other end; begins: start is made from the edge too; far: the next join is at the other end."""
        if pattern.hops:
            here, hop = self.expand_many(rows, start, pattern, backwards, used)
        else:
            edge, away, here, nth = self.fresh("e"), start if begins else self.fresh("j"), self.fresh("n"), self.fresh("o")
            found, places = self.steps(pattern, backwards, edge, away, here, nth, far)
            self.types[edge] = pattern.types
            condition = self.unused(used, edge, pattern.types)
            if not begins:
                condition = (F.col(start) == F.col(away)) & condition
            if pattern.name in rows.names:
                old = rows.names[pattern.name]
                condition &= (old.col == F.col(edge)) if old.kind is EDGE else F.lit(False)
            if node.name in rows.names:
                old = rows.names[node.name]
                same = old.col == F.col(here)
                if self.graph.by_target is not None and not begins:
                    # no key of the join, which edges stored by one end would have to be moved for
                    same = (old.col <= F.col(here)) & (old.col >= F.col(here))
                condition &= same if old.kind is NODE else F.lit(False)
            if begins:
                rows.frame = found.where(condition) if rows.frame is None else rows.frame.join(found, condition)
            else:
                rows.frame = rows.frame.join(found, condition).drop(away)
            self.count(rows)
            rows.attributes |= places
            if pattern.name and pattern.name not in rows.names:
                rows.names[pattern.name] = self.at(edge, EDGE)
            used.append((edge, False, pattern.types))
            if self.order:
                rows.frame = rows.frame.withColumn(nth, F.array(F.col(nth)))
            hop = {"many": False, "edges": edge, "ord": nth}
        if node.name in rows.names:
            if pattern.hops:
                old = rows.names[node.name]
                rows.having((old.col == F.col(here)) if old.kind is NODE else F.lit(False))
            self.tested(rows, here, node)
            return here, hop
        if node.type or node.properties or any(k != "id" for k in self.wanted.get(node.name, ())):
            there = self.fresh("n")
            found, places = self.scanned(NODE, node.name, there, [], (node.type,) if node.type else (), node.properties)
            rows.frame = rows.frame.join(found, F.col(here) == F.col(there)).drop(here)
            rows.attributes |= places
            here = there
            self.types[here] = (node.type,) if node.type else ()
        if node.name:
            rows.names[node.name] = self.at(here, NODE)
        return here, hop

    def closes(self, rows: Rows, pattern: Pattern, k: int) -> bool:
        """Whether two edges lead over a new node back to a bound one, and nothing depends on order, provenance or counts."""
        if k + 2 >= len(pattern.nodes) or self.order or self.provenance or self.most is not None:
            return False
        edges, (between, last) = pattern.edges[k : k + 2], pattern.nodes[k + 1 : k + 3]
        new = [x.name for x in (*edges, between) if x.name]
        return last.name in rows.names and rows.names[last.name].kind is NODE and not any(e.hops for e in edges) and not set(new) & set(rows.names) and len(set(new)) == len(new)

    def close(self, rows: Rows, start: str, pattern: Pattern, k: int, used: list) -> tuple[str, str, dict, dict]:
        """The two edges joined on their own and then to the rows by both ends, so that no row meets all edges of one end first."""
        begun, own, known = self.fresh("n"), Rows(None), []
        end = replace(pattern.nodes[k + 2], name=None, type=None, properties=())
        between, one = self.expand(own, begun, pattern.edges[k], pattern.nodes[k + 1], False, known, True, True)
        last, two = self.expand(own, between, pattern.edges[k + 1], end, False, known)
        condition = (F.col(start) == F.col(begun)) & (rows.names[pattern.nodes[k + 2].name].col == F.col(last))
        for edge, _, types in known:
            condition &= self.unused(used, edge, types)
        rows.frame = rows.frame.join(own.frame, condition).drop(begun)
        rows.names |= own.names
        rows.attributes |= own.attributes
        used += known
        self.tested(rows, last, pattern.nodes[k + 2])
        return between, last, one, two

    def expand_many(self, rows: Rows, start: str, pattern: EdgePattern, backwards: bool, used: list) -> tuple[str, dict]:
        """Trails of bounded length, by one join for each hop.

        Before a hop, trails that are long enough are there twice, once to stop and once to go on; the ones that
        stop have a key that no edge has, and a left join lets them through.
        """
        low, high = pattern.hops
        here, edges, nodes, nth, stop, key = self.fresh("n"), self.fresh("t"), self.fresh("t"), self.fresh("o"), self.fresh("s"), self.fresh("k")
        kept = rows.frame.columns
        trail = rows.frame.withColumns({here: F.col(start), edges: F.array().cast("array<string>"), nodes: F.array().cast("array<string>"), stop: F.lit(False), **({nth: F.array().cast("array<bigint>")} if self.order else {})})
        for hop in range(1, high + 1):
            edge, away, to, o = self.fresh("e"), self.fresh("j"), self.fresh("n"), self.fresh("o")
            found, _ = self.steps(pattern, backwards, edge, away, to, o)
            splits = hop > low
            if splits:
                ways = F.when(F.col(stop), F.array(F.lit(True))).otherwise(F.array(F.lit(False), F.lit(True)))
                trail = trail.withColumn(key, F.explode(ways)).withColumn(stop, F.col(key)).withColumn(key, F.when(F.col(stop), F.concat(F.lit("\0"), F.col(here))).otherwise(F.col(here)))
            condition = (F.col(key if splits else here) == F.col(away)) & self.unused(used, edge, pattern.types)
            if hop > 1:
                condition &= ~F.array_contains(edges, F.col(edge))
            trail = trail.join(found, condition, "left" if splits else "inner")
            if splits:
                trail = trail.where(F.col(stop) | F.col(edge).isNotNull())

            def longer(column: str, item: str) -> Column:
                return F.when(F.col(stop), F.col(column)).otherwise(F.array_append(column, F.col(item)))

            trail = trail.withColumns({edges: longer(edges, edge), nodes: longer(nodes, to), here: F.when(F.col(stop), F.col(here)).otherwise(F.col(to)), **({nth: longer(nth, o)} if self.order else {})})
            step = Rows(trail.select(*kept, here, edges, nodes, stop, *([nth] if self.order else [])))
            self.count(step)
            trail = step.frame
        rows.frame = trail.drop(stop)
        used.append((edges, True, pattern.types))
        hop = {"many": True, "edges": edges, "nodes": nodes, "ord": nth, "most": high}
        if pattern.name:
            self.bind(rows, pattern.name, Typed(F.reverse(edges) if backwards else F.col(edges), V.list_of(EDGE)))
        return here, hop

    # WITH and RETURN

    def project(self, rows: Rows, scoped: Scoped) -> Rows:
        clause: Projection = scoped.clause
        self.start(rows)
        items = [(Variable(n), n) for n in scoped.before] if clause.items is None else [(e, n) for e, n, _ in clause.items]
        grouping = any(has_aggregate(e) for e, _ in items)
        before = rows
        if grouping:
            rows = self.grouped(rows, items)
        else:
            rows = replace(rows, names=dict(rows.names), attributes=dict(rows.attributes))
            rows.names = {name: self.kept(rows, self.value(rows, e)) for e, name in items}
        if clause.where:
            keep = V.narrowed(self.value(rows, clause.where), "boolean", "WHERE needs a boolean.", clause.where.at)
            rows.having(keep.col)
        if clause.distinct:
            rows = self.distinct(rows)
        paged = clause.skip is not None or clause.limit is not None
        keys, upward, before_key = [], [], []
        known = rows.names if grouping or clause.distinct else before.names | rows.names
        for e, down in clause.order if paged or clause.final or self.order else ():
            value = self.value_with(rows, known, e)
            if value.kind.group not in ("number", "string", "boolean", "null", "any"):
                value = V.wrong([value], "Only numbers, strings and booleans can be ordered.", e.at, STRING)
            col = value.col.cast("string") if value.kind is NULL else value.col
            if value.kind is V.ANY:
                value = self.kept(rows, value)
                col = self.any_key(rows, value, before_key, e.at)
            before_key.append(V.canonical(value) if value.kind is V.ANY else col)
            keys.append(col.desc_nulls_first() if down else col.asc_nulls_last())
            upward.append((Typed(col, value.kind), down))
        if keys:
            rows.frame = rows.frame.orderBy(*keys, *rows.place)
        elif paged and self.order or clause.final and self.order:
            rows.frame = rows.frame.orderBy(*rows.place)
        if clause.skip is not None:
            rows.frame = rows.frame.offset(self.page(clause.skip))
        if clause.limit is not None:
            rows.frame = rows.frame.limit(self.page(clause.limit))
        if self.order and keys and not clause.final:
            # later clauses see the rows in this order: by the keys, as columns that sort upwards, and then as before
            ups = [V.ascending(col, down) for col, down in upward]
            prior = F.struct(*(c.alias(f"k{k}") for k, c in enumerate([*ups, *rows.place])))
            rows.frame = rows.frame.withColumns({PRIOR: prior, ORDER: F.array().cast("array<bigint>")})
            rows.extras = (PRIOR, *(x for x in rows.extras if x != PRIOR))
        return rows

    def any_key(self, rows: Rows, value: Typed, earlier: list[Column], at: int) -> Column:
        """The key to sort values of several kinds by. It is an error if such values meet, which those do that are equal in all keys before; one row of a table aside says so."""
        here, group = self.fresh("k"), V.group_of(value)
        met = rows.frame.where(value.col.isNotNull()).groupBy(*(c.alias(f"__before{k}") for k, c in enumerate(earlier))).agg(F.min(group).alias("low"), F.max(group).alias("high"), F.count(F.lit(1)).alias("n"))
        rows.frame = rows.frame.crossJoin(F.broadcast(met.agg(F.max(V.unordered(F.col("low"), F.col("high"), F.col("n"))).alias(here))))
        return F.when(F.col(here), V.error("Only numbers, strings and booleans can be ordered, among themselves.", at)).otherwise(V.sort_key(value))

    def value_with(self, rows: Rows, known: dict[str, Typed], e: Expr) -> Typed:
        own, rows.names = rows.names, known
        value = self.value(rows, e)
        rows.names = own
        return value

    def kept(self, rows: Rows, value: Typed) -> Typed:
        """The value as a column of the frame."""
        if value.kind is NULL:
            value = Typed(value.col.cast("string"), NULL, place=value.place)
        return self.at(self.column(rows, value), value.kind)

    def page(self, e: Expr) -> int:
        value = self.value(Rows(None), e)
        found = self.spark.range(1).select(V.whole_of(value)).first()[0] if value.kind in (INTEGER, V.ANY) else None
        if found is None or found < 0:
            raise QueryError("SKIP and LIMIT need a whole number, 0 or more.", e.at)
        return min(found, 2**31 - 1)

    def group_keys(self, rows: Rows, values: list[Typed]) -> tuple[list[Column], list[Column]]:
        """What to group by, and what to take of each group's first row to have the values again."""
        by, also = [], []
        for v in values:
            name = v.place
            simple = v.kind.group in ("number", "string", "boolean", "null", "node", "edge") or v.kind.name == "list" and v.kind.item.group in ("string", "node", "edge", "boolean") or v.kind.name == "integer"
            if simple:
                by.append(F.col(name))
            else:
                by.append(V.canonical(v).alias(self.fresh("g")))
                also.append(F.first(name).alias(name))
        names = {v.place for v in values if v.kind in (NODE, EDGE)}
        also += [F.first(a.place).alias(a.place) for (n, _), a in rows.attributes.items() if n in names]
        return by, also

    def extras_of(self, rows: Rows) -> list[Column]:
        out = []
        for x in rows.extras:
            if x == ORDER:
                out.append(F.min(F.struct(*rows.place)).alias(FIRST))
            elif x != PRIOR:
                out.append(F.array_distinct(F.flatten(F.collect_list(x))).alias(x))
        return out

    def regrouped(self, rows: Rows, values: list[Typed], more: list[Column]) -> Rows:
        by, also = self.group_keys(rows, values)
        aggregates = [*also, *more, *self.extras_of(rows)]
        names = {v.place for v in values}
        grouped = rows.frame.groupBy(*by)
        frame = grouped.agg(*aggregates) if aggregates else rows.frame.select(*by).distinct()
        if ORDER in rows.extras:
            frame = frame.withColumns({x: F.col(FIRST)[x] for x in (PRIOR, ORDER) if x in rows.extras}).drop(FIRST)
        return Rows(frame, {}, {k: replace(a, facts=None) for k, a in rows.attributes.items() if k[0] in names}, rows.extras)

    def distinct(self, rows: Rows) -> Rows:
        out = self.regrouped(rows, list(rows.names.values()), [])
        out.names = dict(rows.names)
        return out

    def grouped(self, rows: Rows, items: list[tuple[Expr, str]]) -> Rows:
        rows = replace(rows, names=dict(rows.names), attributes=dict(rows.attributes))
        keys = {name: self.kept(rows, self.value(rows, e)) for e, name in items if not has_aggregate(e)}
        calls = list(dict.fromkeys(p for e, _ in items for p in e.all() if is_aggregate(p)))
        columns, made = [], {}
        for call in calls:
            here = self.fresh("g")
            out, after = self.aggregate(rows, call)
            columns.append(out.alias(here))
            made[call] = after(F.col(here))
        once = {v.place: v for v in keys.values()}
        out = self.regrouped(rows, list(once.values()), columns)
        if not keys and ORDER in out.extras:
            out.frame = out.frame.withColumn(ORDER, F.coalesce(F.col(ORDER), F.array().cast("array<bigint>")))
        for e, name in items:
            out.names[name] = keys[name] if name in keys else self.kept(out, self.value(out, e, made))
        return out

    def aggregate(self, rows: Rows, call: Call):
        """The Spark aggregate, and what makes the language's value of it."""
        if call in self.weighted:
            return self.weighted.pop(call)(rows)
        if call.star:
            return F.count(F.lit(1)), lambda c: Typed(c, INTEGER)
        value = self.value(rows, call.args[0])
        if value.kind is NULL:
            value = Typed(value.col.cast("string"), NULL)
        name, at = call.name, call.at
        if name == "count":
            if not call.distinct:
                return F.count(value.col), lambda c: Typed(c, INTEGER)
            plain = value.kind.group in ("number", "string", "boolean", "node", "edge", "null")
            return F.count_distinct(value.col if plain else V.canonical(value)), lambda c: Typed(c, INTEGER)
        if name in ("sum", "avg", "min", "max") and value.kind is V.ANY:
            return self.aggregate_any(call, value)
        if name in ("sum", "avg"):
            value = V.narrowed(value, "number", f"{name} needs numbers.", at)
            if name == "avg":
                here = self.column(rows, value)
                out = F.expr(f"avg({'distinct ' if call.distinct else ''}{here})")
                return out, lambda c: V.finite(Typed(c, V.FLOAT), at)
            out = F.sum_distinct(value.col) if call.distinct else F.sum(value.col)
            zero = F.lit(0).cast("bigint" if value.kind is INTEGER else "double")
            return F.coalesce(out, zero), lambda c: Typed(c, INTEGER) if value.kind is INTEGER else V.finite(Typed(c, V.FLOAT), at)
        if name in ("min", "max"):
            if value.kind.group not in ("number", "string", "boolean", "null"):
                value = V.wrong([value], f"{name} needs numbers, strings or booleans.", at, STRING)
            return (F.min if name == "min" else F.max)(value.col), lambda c: Typed(c, value.kind)
        kept = F.when(value.col.isNotNull(), F.struct(F.struct(*rows.place).alias("o"), value.col.alias("v")) if self.order else F.struct(value.col.alias("v")))
        lists = F.collect_list(kept)

        def listed(c: Column) -> Typed:
            # VARIANT has no order, but the order of rows is decided before it is looked at
            rows_ = c
            if self.order:
                rows_ = F.array_sort(c, lambda a, b: F.when(a["o"] < b["o"], -1).when(a["o"] > b["o"], 1).otherwise(0))
            out = F.transform(rows_, lambda x: x["v"])
            if call.distinct:
                if value.kind.group in ("number", "string", "boolean", "node", "edge", "null"):
                    out = F.array_distinct(out)
                else:
                    out = F.aggregate(out, F.slice(out, F.lit(1), F.lit(0)), lambda done, x: F.when(F.exists(done, lambda y: V.equal(Typed(x, value.kind), Typed(y, value.kind)).col), done).otherwise(F.array_append(done, x)))
            return Typed(out, V.list_of(value.kind))

        return lists, listed

    @staticmethod
    def aggregate_any(call: Call, value: Typed):
        """sum, avg, min and max of values of several kinds: whole numbers are summed as such, and the sum is a float if one of them is."""
        name, at, group = call.name, call.at, V.group_of(value)
        groups = [F.min(group).alias("low"), F.max(group).alias("high"), F.count(value.col).alias("n")]
        if name in ("min", "max"):
            key = (F.min if name == "min" else F.max)(V.sort_key(value)).alias("key")

            def least(c: Column) -> Typed:
                bad = V.unordered(c["low"], c["high"], c["n"]) | c["low"].isin("list", "map")
                return Typed(F.when(bad, V.error(f"{name} needs numbers, strings or booleans of one kind.", at).cast("variant")).otherwise(V.from_key(c["key"])), V.ANY, True)

            return F.struct(*groups, key), least
        whole, real = V.whole_of(value), V.real_of(value)
        if call.distinct:
            # a float that is a whole number is the same value
            same = F.when((F.rint(real) == real) & (F.abs(real) < V.WHOLE), real).cast("bigint")
            sums = [F.sum_distinct(F.coalesce(whole, same)), F.sum_distinct(F.when(same.isNull(), real)), F.count_distinct(V.canonical(value))]
        else:
            sums = [F.sum(whole), F.sum(real), F.count(value.col)]
        parts = [c.alias(k) for c, k in zip([*sums, F.count(real)], ("whole", "real", "count", "reals"), strict=True)]

        def total(c: Column) -> Typed:
            both = F.coalesce(c["whole"].cast("double"), F.lit(0.0)) + F.coalesce(c["real"], F.lit(0.0))
            wrong = F.when((c["low"] != "number") | (c["high"] != "number"), V.error(f"{name} needs numbers.", at))
            as_float = V.finite(Typed(both, V.FLOAT), at).col
            if name == "avg":
                return Typed(F.when(wrong.isNull() & (c["count"] > 0), as_float / c["count"]).otherwise(wrong.cast("double")), V.FLOAT, True)
            exact = F.when(c["reals"] > 0, as_float.cast("variant")).otherwise(F.coalesce(c["whole"], F.lit(0).cast("bigint")).cast("variant"))
            return Typed(F.when((c["low"] != "number") | (c["high"] != "number"), V.error(f"{name} needs numbers.", at).cast("variant")).otherwise(exact), V.ANY, True)

        return F.struct(*groups, *parts), total

    # expressions

    def value(self, rows: Rows, e: Expr, made: dict[Call, Typed] | None = None) -> Typed:
        if made and isinstance(e, Call) and e in made:
            return made[e]
        if isinstance(e, Literal):
            return V.literal(e.value)
        if isinstance(e, Parameter):
            return V.literal(self.parameters[e.name])
        if isinstance(e, Variable):
            return rows.names[e.name]
        if isinstance(e, ListOf):
            return V.make_list([self.value(rows, x, made) for x in e.items])
        if isinstance(e, MapOf):
            return V.make_map([(k, self.value(rows, x, made)) for k, x in e.items])
        if isinstance(e, Property):
            of = self.value(rows, e.of, made)
            return self.attribute(rows, of, e.key) if of.kind in (NODE, EDGE) else V.field(of, e.key, e.at)
        if isinstance(e, Index):
            return V.indexed(self.value(rows, e.of, made), self.value(rows, e.index, made), e.at)
        if isinstance(e, Unary):
            of = self.value(rows, e.of, made)
            if e.op.startswith("IS"):
                return Typed(of.col.isNull() if e.op == "IS NULL" else of.col.isNotNull(), BOOLEAN, of.fails)
            return V.negated(of, e.at) if e.op == "NOT" else V.signed(e.op, of, e.at)
        if isinstance(e, Binary):
            a, b = self.value(rows, e.left, made), self.value(rows, e.right, made)
            if e.op in ("AND", "OR"):
                return V.logic(e.op, a, b, e.at)
            if e.op in ("=", "!="):
                same = V.equal(a, b)
                return same if e.op == "=" else Typed(~same.col, BOOLEAN, same.fails)
            if e.op in ("<", "<=", ">", ">="):
                return V.ordered(e.op, a, b, e.at)
            if e.op == "IN":
                return V.contained(a, b, e.at)
            if e.op in ("CONTAINS", "STARTS WITH", "ENDS WITH"):
                return V.text_test(e.op, a, b, e.at)
            return V.computed(e.op, a, b, e.at)
        return self.called(rows, e, [self.value(rows, x, made) for x in e.args])

    def called(self, rows: Rows, e: Call, args: list[Typed]) -> Typed:
        a = args[0]
        if e.name not in ("id", "type", "labels", "degree"):
            return V.scalar(e.name, args, e.at)
        if a.kind is NULL:
            return V.literal(None)
        if a.kind is NODE or a.kind is EDGE and e.name in ("id", "type"):
            if e.name == "id":
                return Typed(a.col, STRING)
            if e.name == "type":
                return self.attribute(rows, a, "type")
            if e.name == "labels":
                return Typed(V.null_if_any([a], F.array(self.attribute(rows, a, "type").col)), V.list_of(STRING))
            return self.degree(rows, a, args[1:], e.at)
        return V.wrong([a], f"{e.name} can't be had of this value.", e.at)

    def degree(self, rows: Rows, node: Typed, of: list[Typed], at: int) -> Typed:
        """The number of edge ends at a node, counted once for all nodes and joined."""
        here, there, name = self.fresh("a"), self.fresh("j"), self.column(rows, node)
        ends = self.graph.ends()
        if not of:
            counts = ends.groupBy("id").agg(F.count(F.lit(1)).alias(here)).withColumnRenamed("id", there)
            rows.frame = rows.frame.join(counts, F.col(name) == F.col(there), "left").drop(there)
        elif of[0].kind is not STRING and of[0].kind is not V.ANY:
            return Typed(V.null_if_any([node], V.error("The type in degree must be a string.", at)).cast("bigint"), INTEGER, True)
        else:
            of = [self.kept(rows, V.narrowed(of[0], "string", "The type in degree must be a string.", at))]
            kind, type_ = self.column(rows, of[0]), self.fresh("j")
            counts = ends.groupBy("id", "edge_type").agg(F.count(F.lit(1)).alias(here)).withColumnsRenamed({"id": there, "edge_type": type_})
            rows.frame = rows.frame.join(counts, (F.col(name) == F.col(there)) & (F.col(kind) == F.col(type_)), "left").drop(there, type_)
        return Typed(V.null_if_any([node], F.coalesce(F.col(here), F.lit(0).cast("bigint"))), INTEGER)
