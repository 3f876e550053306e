"""Columns with the kind of value they hold, and the language's operators on them.

The language never converts: values of unlike kinds are unequal, and ordering or computing with them is an
error of the rows that do it. Kinds are known when the plan is built, so most of that is settled there; a
column that may hold several kinds is a VARIANT of kind any and asks each row.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..errors import QueryError

#: Fixed value: code points that a computed string may have.
LONGEST = 100_000
MARK = "quiverql-error"


@dataclass(frozen=True)
class Kind:
    """name: null, boolean, integer, float, string, list (of item), map (with fields, or of item), any, node, edge or path."""

    name: str
    item: Kind | None = None
    fields: tuple[tuple[str, Kind], ...] | None = None

    @property
    def group(self) -> str:
        """Kinds of one group can be compared."""
        return "number" if self.name in ("integer", "float") else self.name


NULL, BOOLEAN, INTEGER, FLOAT, STRING, ANY, NODE, EDGE, PATH = map(Kind, "null boolean integer float string any node edge path".split())


def list_of(item: Kind) -> Kind:
    return Kind("list", item)


@dataclass(frozen=True)
class Typed:
    """fails: whether a row may raise an error in it. parts: the items of a list, or of a map by key, written in the query. place: the column of the rows that holds it. facts: for kind any, what the names of the columns start with that hold what is asked of its value, see facts_of."""

    col: Column
    kind: Kind
    fails: bool = False
    parts: tuple | None = None
    place: str | None = None
    facts: str | None = None


def of_type(col: Column, type_: T.DataType) -> Typed:
    """A stored column as a value: whole numbers are bigint, others double; what the language has no kind for is text."""
    kind = kind_of(type_)
    if isinstance(type_, T.IntegralType):
        col = col.cast("bigint")
    elif kind is FLOAT:
        col = col.cast("double")
    elif kind is STRING and not isinstance(type_, T.StringType):
        col = col.cast("string")
    elif kind is ANY:
        col = known(col)
    return Typed(col, kind)


def kind_of(type_: T.DataType) -> Kind:
    if isinstance(type_, T.BooleanType):
        return BOOLEAN
    if isinstance(type_, T.IntegralType):
        return INTEGER
    if isinstance(type_, T.FractionalType):
        return FLOAT
    if isinstance(type_, T.ArrayType):
        return list_of(kind_of(type_.elementType))
    if isinstance(type_, T.StructType):
        return Kind("map", fields=tuple((f.name, kind_of(f.dataType)) for f in type_))
    if isinstance(type_, T.MapType):
        return Kind("map", kind_of(type_.valueType))
    if isinstance(type_, T.VariantType):
        return ANY
    return NULL if isinstance(type_, T.NullType) else STRING


def error(message: str, at: int | None = None, limit: bool = False) -> Column:
    """A column that raises in every row that computes it; see from_spark."""
    return F.raise_error(F.lit(f"{MARK}|{int(limit)}|{'' if at is None else at}|{message}"))


def literal(value: object) -> Typed:
    """A JSON value."""
    if value is None:
        return Typed(F.lit(None), NULL)
    if isinstance(value, bool):
        return Typed(F.lit(value), BOOLEAN)
    if isinstance(value, int) and -(2**63) <= value < 2**63:
        return Typed(F.lit(value).cast("bigint"), INTEGER)
    if isinstance(value, (int, float)):
        return Typed(F.lit(float(value)), FLOAT)
    if isinstance(value, str):
        return Typed(F.lit(value), STRING)
    if isinstance(value, (list, tuple)):
        return make_list([literal(v) for v in value])
    return make_map([(k, literal(v)) for k, v in value.items()])


def make_list(items: list[Typed]) -> Typed:
    if not items:
        return Typed(F.array().cast("array<string>"), list_of(NULL), parts=())
    cols, kind = united(items)
    return Typed(F.array(*cols), list_of(kind), any(i.fails for i in items), tuple(items))


def make_map(items: list[tuple[str, Typed]]) -> Typed:
    if not items:
        return Typed(F.create_map().cast("map<string,string>"), Kind("map", NULL), parts=())
    items = [(k, Typed(F.lit(None).cast("string"), NULL) if v.kind is NULL else v) for k, v in items]
    return Typed(F.struct(*(v.col.alias(k) for k, v in items)), Kind("map", fields=tuple((k, v.kind) for k, v in items)), any(v.fails for _, v in items), tuple(items))


def united(values: list[Typed]) -> tuple[list[Column], Kind]:
    """The values as columns of one type: the common kind, double for numbers of both kinds, else VARIANT."""
    kinds = {v.kind for v in values if v.kind is not NULL}
    if not kinds:
        return [v.col.cast("string") for v in values], NULL
    if len(kinds) == 1:
        return [v.col for v in values], next(iter(kinds))
    if all(k.group == "number" for k in kinds):
        return [v.col.cast("double") for v in values], FLOAT
    return [v.col.cast("variant") for v in values], ANY


def null_if_any(values: list[Typed], otherwise: Column) -> Column:
    """Null if one of the values is, else the other column, which isn't computed then."""
    return F.when(reduce(Column.__and__, (v.col.isNotNull() for v in values)), otherwise)


def wrong(values: list[Typed], message: str, at: int, kind: Kind = NULL) -> Typed:
    """An error in every row where no value is null."""
    if any(v.kind is NULL for v in values):
        return Typed(F.lit(None), kind)
    type_ = {"boolean": "boolean", "integer": "bigint", "float": "double"}.get(kind.name, "string")
    return Typed(null_if_any(values, error(message, at)).cast(type_), kind, True)


# values of kind any


def known(col: Column) -> Column:
    """A VARIANT, null if it is a null inside."""
    return F.when(~F.is_variant_null(col), col)


def group_of(value: Typed) -> Column:
    """The group of each row's value, for kind any."""
    if value.facts:
        return F.col(f"{value.facts}_group")
    name = F.schema_of_variant(value.col)
    return F.when(name.rlike("^(TINYINT|SMALLINT|INT|BIGINT|FLOAT|DOUBLE|DECIMAL)"), "number").when(name == "STRING", "string").when(name == "BOOLEAN", "boolean").when(name.startswith("ARRAY"), "list").when(name.startswith("OBJECT"), "map")


def as_group(value: Typed, group: str) -> Column:
    """The value of a row known to be of that group, else null."""
    if value.kind is not ANY:
        return value.col
    if group == "number":
        if value.facts:
            return F.coalesce(F.col(f"{value.facts}_whole").cast("double"), F.col(f"{value.facts}_real"))
        return F.try_variant_get(value.col, "$", "double")
    return F.when(group_of(value) == group, F.try_variant_get(value.col, "$", group))


def narrowed(value: Typed, group: str, message: str, at: int) -> Typed:
    """A value that must be of one group: settled now, or row by row for kind any."""
    kind = {"number": FLOAT, "string": STRING, "boolean": BOOLEAN}[group]
    if value.kind.group == group or value.kind is NULL:
        return Typed(value.col.cast({"number": "bigint", "string": "string", "boolean": "boolean"}[group]), kind if group != "number" else INTEGER) if value.kind is NULL else value
    if value.kind is ANY:
        return Typed(null_if_any([value], F.when(group_of(value) == group, as_group(value, group)).otherwise(error(message, at))), kind, True)
    return wrong([value], message, at, kind)


#: Beyond this no float is a whole number of 64 bits.
WHOLE = float(2**63)


def number_text(value: Column) -> Column:
    """Text of a float: that of the whole number that it equals, if there is one of 64 bits."""
    return F.when((F.rint(value) == value) & (F.abs(value) < WHOLE), value.try_cast("bigint").cast("string")).otherwise(value.cast("string"))


def is_whole(value: Typed) -> Column:
    """Whether the VARIANT of a row is a whole number of 64 bits."""
    if value.facts:
        return F.col(f"{value.facts}_whole").isNotNull()
    return F.schema_of_variant(value.col).rlike("^(TINYINT|SMALLINT|INT|BIGINT)")


def whole_of(value: Typed) -> Column:
    """A number as bigint where it is a whole number of the language, else null."""
    if value.facts:
        return F.col(f"{value.facts}_whole")
    if value.kind is ANY:
        return F.when(is_whole(value), F.try_variant_get(value.col, "$", "bigint"))
    return value.col if value.kind is INTEGER else F.lit(None).cast("bigint")


def real_of(value: Typed) -> Column:
    """A number as double where it is a float, else null."""
    if value.facts:
        return F.col(f"{value.facts}_real")
    if value.kind is ANY:
        return F.when((group_of(value) == "number") & ~is_whole(value), F.try_variant_get(value.col, "$", "double"))
    return value.col if value.kind is FLOAT else F.lit(None).cast("double")


def number_parts(value: Typed) -> tuple[Column, Column]:
    """near and off, in the order of the numbers themselves: the nearest double and how far a whole number is from it. Null for what is no number."""
    whole, real = whole_of(value), real_of(value)
    near = whole.cast("double")
    # the double nearest to a whole number may be 2^63 itself
    off = F.when(near >= WHOLE, whole - F.lit(2**63 - 1) - 1).otherwise(whole - F.when(near < WHOLE, near).cast("bigint"))
    return F.coalesce(near, real), F.when(whole.isNotNull(), off).when(real.isNotNull(), F.lit(0).cast("bigint"))


def number_key(value: Typed) -> Column:
    """The parts as one value."""
    near, off = number_parts(value)
    return F.when(near.isNotNull(), F.struct(near.alias("near"), off.alias("off")))


def sort_key(value: Typed) -> Column:
    """For kind any: a key in the order of values of one group, from which the value can be made again."""
    parts = F.struct(number_key(value).alias("number"), whole_of(value).alias("whole"), real_of(value).alias("real"), as_group(value, "string").alias("string"), as_group(value, "boolean").alias("boolean"))
    return F.when(value.col.isNotNull(), parts)


def ascending(value: Typed, down: bool) -> Column:
    """A key in the order of ORDER BY, for use within other keys: null last, or if down backwards and null first."""
    col = value.col
    if not down:
        return F.struct(col.isNull().alias("none"), col.alias("key"))
    if value.kind is ANY:
        number = F.struct((-col["number"]["near"]).alias("near"), (-col["number"]["off"]).alias("off"))
        col = F.when(col.isNotNull(), F.struct(F.when(col["number"].isNotNull(), number).alias("number"), backwards(col["string"]).alias("string"), (~col["boolean"]).alias("boolean")))
    elif value.kind is INTEGER:
        col = F.bitwise_not(col)
    elif value.kind is FLOAT:
        col = -col
    else:
        col = ~col if value.kind is BOOLEAN else backwards(col)
    return F.struct(col.isNotNull().alias("some"), col.alias("key"))


def backwards(text: Column) -> Column:
    """Text whose order is the reverse of that of the given text: digits of its bytes, each the other way round, and an end after all of them."""
    return F.concat(F.translate(F.hex(F.encode(text, "UTF-8")), "0123456789ABCDEF", "FEDCBA9876543210"), F.lit("~"))


def from_key(key: Column) -> Column:
    return F.coalesce(*(key[k].cast("variant") for k in ("whole", "real", "string", "boolean")))


def unordered(group_low: Column, group_high: Column, count: Column) -> Column:
    """Whether values of these groups (the least and greatest name) can't be put in an order: they are of several, or lists or maps and more than one."""
    return (group_low != group_high) | group_low.isin("list", "map") & (count > 1)


def canonical(value: Typed) -> Column:
    """Text that is equal for equal values only, whatever their kinds; null for null."""
    name = value.kind.name
    if value.facts:
        return F.col(f"{value.facts}_canonical")
    if name in ("integer", "float"):
        return F.concat(F.lit("number "), value.col.cast("string") if name == "integer" else number_text(value.col))
    if name == "any":
        other = F.concat(group_of(value), F.lit(" "), F.to_json(value.col))
        return F.when(is_whole(value), F.concat(F.lit("number "), F.try_variant_get(value.col, "$", "bigint").cast("string"))).when(group_of(value) == "number", F.concat(F.lit("number "), number_text(as_group(value, "number")))).when(group_of(value) == "string", F.concat(F.lit("string "), as_group(value, "string"))).when(group_of(value) == "boolean", F.concat(F.lit("boolean "), as_group(value, "boolean").cast("string"))).otherwise(other)
    if name == "list":
        if value.kind.item is NULL:
            return F.concat(F.lit("list "), F.to_json(value.col))
        inner = F.transform(value.col, lambda x: F.coalesce(canonical(Typed(x, value.kind.item)), F.lit("null")))
        return F.concat(F.lit("list "), F.to_json(inner))
    if name == "map" and value.kind.fields is not None:
        inner = [F.concat(F.lit(f"{k}="), F.coalesce(canonical(Typed(value.col[k], kind)), F.lit("null"))) for k, kind in sorted(value.kind.fields)]
        return F.when(value.col.isNotNull(), F.concat(F.lit("map "), F.to_json(F.array(*inner))))
    if name == "map":
        return F.concat(F.lit("map "), F.to_json(F.array_sort(F.transform(F.map_entries(value.col), lambda e: F.concat(e["key"], F.lit("="), F.coalesce(canonical(Typed(e["value"], value.kind.item or NULL)), F.lit("null")))))))
    if name == "path":
        return F.concat(F.lit("path "), F.to_json(value.col))
    return F.concat(F.lit(f"{name} "), value.col.cast("string"))


def facts_of(value: Typed, start: str) -> list[Column]:
    """What operators ask of a value of kind any, as columns: read from the VARIANT once a row where it is scanned, and not once for each operator and each pair of a join."""
    made = {"group": group_of(value), "whole": whole_of(value), "real": real_of(value), "canonical": canonical(value)}
    return [col.alias(f"{start}_{name}") for name, col in made.items()]


# operators


def equal(a: Typed, b: Typed) -> Typed:
    fails = a.fails or b.fails
    if NULL in (a.kind, b.kind):
        return Typed(F.lit(None).cast("boolean"), BOOLEAN, fails)
    plain = ("number", "string", "boolean", "node", "edge", "path")
    if {a.kind, b.kind} == {INTEGER, FLOAT}:
        return Typed(exactly("==", a, b), BOOLEAN, fails)
    if a.kind.group == b.kind.group and (a.kind.group in plain or a.kind == b.kind and a.kind.group == "list" and a.kind.item.group in plain):
        return Typed(a.col == b.col, BOOLEAN, fails)
    if ANY in (a.kind, b.kind) or a.kind.group == b.kind.group:
        return Typed(canonical(a) == canonical(b), BOOLEAN, fails)
    return Typed(null_if_any([a, b], F.lit(False)), BOOLEAN, fails)


def exactly(op: str, a: Typed, b: Typed) -> Column:
    """A comparison of a whole number and a float, in whole numbers as far as the float is among those of 64 bits."""
    if a.kind is FLOAT:
        a, b, op = b, a, {"<": ">", "<=": ">=", ">": "<", ">=": "<=", "==": "=="}[op]
    near = F.abs(b.col) < WHOLE
    if op == "==":
        return F.when(near & (F.rint(b.col) == b.col), a.col == b.col.try_cast("bigint")).when(b.col.isNotNull() & a.col.isNotNull(), F.lit(False))
    edge = (F.ceil if op in ("<", ">=") else F.floor)(F.when(near, b.col))
    inside = {"<": a.col < edge, "<=": a.col <= edge, ">": a.col > edge, ">=": a.col >= edge}[op]
    return F.when(near, inside).when(a.col.isNotNull(), b.col > 0 if op in ("<", "<=") else b.col < 0)


def ordered(op: str, a: Typed, b: Typed, at: int) -> Typed:
    """<, <=, > and >= of two numbers, strings or booleans."""
    do: Callable[[Column, Column], Column] = {"<": Column.__lt__, "<=": Column.__le__, ">": Column.__gt__, ">=": Column.__ge__}[op]
    message = "Only numbers, strings or booleans can be ordered, among themselves."
    if NULL in (a.kind, b.kind):
        return Typed(F.lit(None).cast("boolean"), BOOLEAN, a.fails or b.fails)
    if ANY in (a.kind, b.kind):
        groups = [group_of(v) if v.kind is ANY else F.lit(v.kind.group) for v in (a, b)]
        out = F.when(groups[0].eqNullSafe(groups[1]) & F.lit(False), F.lit(None).cast("boolean"))
        for group in ("number", "string", "boolean"):
            if all(v.kind is ANY or v.kind.group == group for v in (a, b)):
                if group == "number":
                    # in parts, since a struct would be made for each pair of a join
                    (near, off), (other, its) = number_parts(a), number_parts(b)
                    told = {"<": Column.__lt__, ">": Column.__gt__}[op[0]](near, other) | (near == other) & do(off, its)
                else:
                    told = do(*(as_group(v, group) for v in (a, b)))
                out = out.when((groups[0] == group) & (groups[1] == group), told)
        return Typed(null_if_any([a, b], out.otherwise(error(message, at))), BOOLEAN, True)
    if {a.kind, b.kind} == {INTEGER, FLOAT}:
        return Typed(exactly(op, a, b), BOOLEAN, a.fails or b.fails)
    if a.kind.group == b.kind.group and a.kind.group in ("number", "string", "boolean"):
        return Typed(do(a.col, b.col), BOOLEAN, a.fails or b.fails)
    return wrong([a, b], message, at, BOOLEAN)


def contained(a: Typed, b: Typed, at: int) -> Typed:
    """a IN b."""
    if NULL in (a.kind, b.kind):
        return Typed(F.lit(None).cast("boolean"), BOOLEAN)
    message = "IN needs a list on its right."
    if b.kind is ANY:
        inside = F.exists(b.col.try_cast("array<variant>"), lambda x: equal(a, Typed(known(x), ANY)).col)
        return Typed(null_if_any([a, b], F.when(group_of(b) == "list", inside).otherwise(error(message, at))), BOOLEAN, True)
    if b.kind.name != "list":
        return wrong([a, b], message, at, BOOLEAN)
    if b.parts is not None:
        each = [equal(a, part).col for part in b.parts]
        return Typed(null_if_any([a], reduce(Column.__or__, each, F.lit(False))), BOOLEAN, a.fails or b.fails)
    item = b.kind.item
    return Typed(null_if_any([a, b], F.exists(b.col, lambda x: equal(a, Typed(known(x) if item is ANY else x, item)).col if item is not NULL else F.lit(None).cast("boolean"))), BOOLEAN, a.fails or b.fails)


def text_test(op: str, a: Typed, b: Typed, at: int) -> Typed:
    a, b = (narrowed(v, "string", f"{op} needs strings.", at) for v in (a, b))
    do = {"CONTAINS": Column.contains, "STARTS WITH": Column.startswith, "ENDS WITH": Column.endswith}[op]
    return Typed(do(a.col, b.col), BOOLEAN, a.fails or b.fails)


def logic(op: str, a: Typed, b: Typed, at: int) -> Typed:
    """AND and OR; a right side that may fail is left alone where the left settles the result."""
    a, b = (narrowed(v, "boolean", f"{op} needs booleans.", at) for v in (a, b))
    both = a.col & b.col if op == "AND" else a.col | b.col
    if b.fails:
        both = F.when(a.col == F.lit(op == "OR"), F.lit(op == "OR")).otherwise(both)
    return Typed(both, BOOLEAN, a.fails or b.fails)


def negated(a: Typed, at: int) -> Typed:
    a = narrowed(a, "boolean", "NOT needs a boolean.", at)
    return Typed(~a.col, BOOLEAN, a.fails)


def computed(op: str, a: Typed, b: Typed, at: int) -> Typed:
    if op == "+" and a.kind is STRING and b.kind is STRING:
        size = F.length(a.col) + F.length(b.col)
        return Typed(F.when(size <= LONGEST, F.concat(a.col, b.col)).when(size > LONGEST, error("The string gets too long.", at, True)), STRING, True)
    message = "Only numbers can be computed with; + joins two strings too."
    if ANY in (a.kind, b.kind) and NULL not in (a.kind, b.kind):
        return computed_any(op, a, b, message, at)
    a, b = (narrowed(v, "number", message, at) for v in (a, b))
    kind = INTEGER if a.kind is INTEGER and b.kind is INTEGER and op != "/" else FLOAT
    x, y = (v.col if kind is INTEGER else v.col.cast("double") for v in (a, b))
    out = Typed(arithmetic(op, x, y, at), kind, True)
    return finite(out, at) if kind is FLOAT else out


def arithmetic(op: str, x: Column, y: Column, at: int) -> Column:
    """Of two columns of one type, bigint or double."""
    if op in "+-*":
        return {"+": x + y, "-": x - y, "*": x * y}[op]
    nonzero = F.when(y == 0, error("Nothing can be divided by zero.", at)).otherwise(y)
    return x / nonzero if op == "/" else ((x % nonzero) + y) % y


def computed_any(op: str, a: Typed, b: Typed, message: str, at: int) -> Typed:
    """Each row by the kinds of its own values: whole numbers stay whole, and + joins two strings."""
    numbers = [group_of(v) == "number" if v.kind is ANY else F.lit(v.kind.group == "number") for v in (a, b)]
    wholes, reals = ([F.coalesce(whole_of(v).cast("double"), real_of(v)) if real else whole_of(v) for v in (a, b)] for real in (False, True))
    real = finite(Typed(arithmetic(op, *reals, at), FLOAT, True), at).col
    if op == "/":
        return Typed(null_if_any([a, b], F.when(numbers[0] & numbers[1], real).otherwise(error(message, at))), FLOAT, True)
    out = F.when(wholes[0].isNotNull() & wholes[1].isNotNull(), arithmetic(op, *wholes, at).cast("variant")).when(numbers[0] & numbers[1], real.cast("variant"))
    if op == "+" and {a.kind, b.kind} <= {ANY, STRING}:
        texts = [as_group(v, "string") for v in (a, b)]
        long = F.length(texts[0]) + F.length(texts[1]) > LONGEST
        both = texts[0].isNotNull() & texts[1].isNotNull()
        out = out.when(both & long, error("The string gets too long.", at, True).cast("variant")).when(both, F.concat(*texts).cast("variant"))
    return Typed(null_if_any([a, b], out.otherwise(error(message, at).cast("variant"))), ANY, True)


def by_number(a: Typed, do: Callable[[Column], Column], message: str, at: int) -> Typed:
    """A function of one number that keeps whole numbers whole."""
    if a.kind is not ANY:
        a = narrowed(a, "number", message, at)
        return Typed(do(a.col), a.kind, a.fails or a.kind is INTEGER)
    whole, real = whole_of(a), real_of(a)
    out = F.when(whole.isNotNull(), do(whole).cast("variant")).when(real.isNotNull(), do(real).cast("variant"))
    return Typed(null_if_any([a], out.otherwise(error(message, at).cast("variant"))), ANY, True)


def finite(value: Typed, at: int) -> Typed:
    bad = F.isnan(value.col) | (F.abs(value.col) == F.lit(math.inf))
    return Typed(F.when(value.col.isNotNull(), F.when(bad, error("The number gets too large.", at, True)).otherwise(value.col)), value.kind, True)


def signed(op: str, a: Typed, at: int) -> Typed:
    return by_number(a, (lambda c: -c) if op == "-" else (lambda c: c), "A sign needs a number.", at)


def indexed(a: Typed, index: Typed, at: int) -> Typed:
    """An item of a list or string from either end, or of a map by key; null outside."""
    message = "A list or string is indexed by a whole number, a map by a string."
    if NULL in (a.kind, index.kind):
        return literal(None)
    name, fails = a.kind.name, a.fails or index.fails
    if name in ("list", "string") and index.kind is INTEGER:
        # an index beyond 32 bits is outside anyway
        at_ = index.col.try_cast("int")
        if name == "list":
            return Typed(item_at(a.col, at_), a.kind.item, fails)
        size = F.length(a.col)
        place = (F.when(at_ >= 0, at_).otherwise(size + at_) + 1).cast("int")
        return Typed(F.when((at_ < size) & (at_ >= -size), F.substring(a.col, F.when((at_ < size) & (at_ >= -size), place), F.lit(1))), STRING, fails)
    if name == "map" and index.kind is STRING:
        if a.kind.fields is None:
            return Typed(F.try_element_at(a.col, index.col), a.kind.item or NULL, fails)
        if not a.kind.fields:
            return literal(None)
        cols, kind = united([Typed(a.col[k], own) for k, own in a.kind.fields])
        out = F.when(F.lit(False), cols[0])
        for (key, _), col in zip(a.kind.fields, cols, strict=True):
            out = out.when(index.col == key, col)
        return Typed(out, kind, fails)
    if index.kind is ANY:
        return indexed_by_any(a, index, message, at)
    if a.kind is ANY and index.kind in (INTEGER, STRING):
        return Typed(null_if_any([a, index], any_at(a, index, group_of(a)).otherwise(error(message, at))), ANY, True)
    return wrong([a, index], message, at)


def item_at(items: Column, at_: Column) -> Column:
    return F.when(at_ >= 0, F.get(items, F.when(at_ >= 0, at_))).otherwise(F.try_element_at(items, F.when(at_ < 0, at_)))


def any_at(a: Typed, index: Typed, group: Column) -> Column:
    """The item of a VARIANT at an index of a known kind, as the first branches of a case."""
    if index.kind is STRING:
        inner = F.try_element_at(a.col.try_cast("map<string,variant>"), index.col)
        return F.when(group == "map", F.when(~F.is_variant_null(inner), inner))
    inner = item_at(a.col.try_cast("array<variant>"), index.col.try_cast("int"))
    text = indexed(Typed(as_group(a, "string"), STRING), index, 0).col
    return F.when(group == "list", F.when(~F.is_variant_null(inner), inner)).when(group == "string", text.cast("variant"))


def indexed_by_any(a: Typed, index: Typed, message: str, at: int) -> Typed:
    """The item of a value at an index that may be of several kinds."""
    whole, text = Typed(F.try_variant_get(index.col, "$", "bigint"), INTEGER), Typed(as_group(index, "string"), STRING)
    if a.kind is not ANY:
        own, fits = (text, group_of(index) == "string") if a.kind.name == "map" else (whole, is_whole(index))
        if a.kind.name not in ("map", "list", "string"):
            return wrong([a, index], message, at)
        found = indexed(a, own, at)
        return Typed(null_if_any([a, index], F.when(fits, found.col).otherwise(error(message, at))), found.kind, True)
    group = group_of(a)
    by_place = F.when(group.isin("list", "string"), any_at(a, whole, group)).otherwise(error(message, at))
    by_key = F.when(group == "map", any_at(a, text, group)).otherwise(error(message, at))
    return Typed(null_if_any([a, index], F.when(is_whole(index), by_place).when(group_of(index) == "string", by_key).otherwise(error(message, at))), ANY, True)


def field(a: Typed, key: str, at: int) -> Typed:
    """a.key of a map."""
    if a.kind is NULL:
        return a
    if a.kind.name == "map" and a.kind.fields is not None:
        own = dict(a.kind.fields).get(key)
        return Typed(a.col[key], own, a.fails) if own else literal(None)
    if a.kind.name == "map":
        return Typed(F.try_element_at(a.col, F.lit(key)), a.kind.item or NULL, a.fails)
    if a.kind is ANY:
        inner = F.try_variant_get(a.col, variant_path(key), "variant")
        return Typed(null_if_any([a], F.when(group_of(a) == "map", F.when(~F.is_variant_null(inner), inner)).otherwise(error(f"{key} can't be read from this value.", at))), ANY, True)
    return wrong([a], f"{key} can't be read from this value.", at)


def variant_path(key: str) -> str:
    """The path of a key; one with both kinds of quotes has none."""
    if "'" in key and '"' in key:
        raise QueryError(f"The key {key} has both kinds of quotes.")
    return f'$["{key}"]' if "'" in key else f"$['{key}']"


def scalar(name: str, args: list[Typed], at: int) -> Typed:
    """The functions that need no graph."""
    if name == "coalesce":
        cols, kind = united(args)
        return Typed(F.coalesce(*cols), kind, any(a.fails for a in args))
    a = args[0]
    if a.kind is NULL:
        return a
    if name in ("tolower", "lower", "toupper", "upper"):
        a = narrowed(a, "string", f"{name} needs a string.", at)
        return Typed((F.lower if "lower" in name else F.upper)(a.col), STRING, a.fails)
    if name == "abs":
        return by_number(a, F.abs, "abs needs a number.", at)
    if name == "size" and a.kind is ANY:
        group = group_of(a)
        sizes = {"string": F.length(as_group(a, "string")), "list": F.size(a.col.try_cast("array<variant>")), "map": F.size(F.map_keys(a.col.try_cast("map<string,variant>")))}
        out = F.when(F.lit(False), F.lit(0))
        for kind, size in sizes.items():
            out = out.when(group == kind, size)
        return Typed(null_if_any([a], out.otherwise(error("size can't be had of this value.", at).cast("int"))).cast("bigint"), INTEGER, True)
    if name == "size" and a.kind.name in ("string", "list", "map"):
        if a.kind.name == "map" and a.kind.fields is not None:
            return Typed(null_if_any([a], F.lit(len(a.kind.fields))).cast("bigint"), INTEGER, a.fails)
        size = {"string": F.length, "list": F.size, "map": lambda c: F.size(F.map_keys(c))}[a.kind.name](a.col)
        return Typed(null_if_any([a], size).cast("bigint"), INTEGER, a.fails)
    if name in ("length", "nodes", "relationships") and a.kind is PATH:
        if name == "length":
            return Typed(null_if_any([a], F.size(a.col["edges"])).cast("bigint"), INTEGER)
        return Typed(a.col["nodes"], list_of(NODE)) if name == "nodes" else Typed(a.col["edges"], list_of(EDGE))
    return wrong([a], f"{name} can't be had of this value.", at)


def from_spark(e: Exception) -> QueryError | None:
    """The query error that a failed job carries, if any."""
    from ..errors import QueryLimitError

    text = str(e)
    if MARK in text:
        limit, at, message = text[text.index(MARK) :].split("|", 3)[1:]
        message = message.split("\n")[0].split(" SQLSTATE")[0].rstrip(" '\"")
        return (QueryLimitError if limit == "1" else QueryError)(message, int(at) if at else None)
    if any(name in text for name in ("ARITHMETIC_OVERFLOW", "NUMERIC_VALUE_OUT_OF_RANGE", "CAST_OVERFLOW")):
        return QueryLimitError("A whole number is beyond 64 bits.")
    return None
