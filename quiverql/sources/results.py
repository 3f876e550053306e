"""Results of statements as JSON lines, entities and paths whole."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.typed import EDGE, NODE, PATH, Kind
from ..graph import ORD, PropertyGraph
from ..operators.analytics import kept
from ..plans.compiler import Result


#: Hashes that ids are told apart by before the entities are read: what is sent to all tasks has that many at most.
HASHES = 1 << 21


def among(table: DataFrame, ids: DataFrame) -> DataFrame:
    """The table's rows whose ids may be among ids (one column): all that are, and of the others as many as have a hash of theirs."""
    hashed = lambda c: F.pmod(F.xxhash64(c), F.lit(HASHES))
    wanted = ids.select(hashed(F.col(ids.columns[0])).alias("__hash")).distinct()
    return table.withColumn("__hash", hashed(F.col("id"))).join(F.broadcast(wanted), "__hash", "left_semi").drop("__hash")


def entity_texts(graph: PropertyGraph, kind: Kind, key: str, name: str, types: tuple[str, ...] = (), ids: DataFrame | None = None) -> DataFrame:
    """The id of each node or edge and its JSON: all columns but its place, what is null left out, and $type. types, ids: what is known of those that are asked for; others needn't be there."""
    table = graph.nodes if kind is NODE else graph.edges
    own = F.struct(*(F.col(f"`{c}`") for c in table.columns if c != ORD), F.lit("node" if kind is NODE else "relationship").alias("$type"))
    if types:
        table = table.where(F.col("type").isin(*types))
    elif ids is not None:
        table = among(table, ids)
    return table.select(F.col("id").alias(key), F.to_json(own).alias(name))


def with_entity(frame: DataFrame, graph: PropertyGraph, name: str, kind: Kind, types: tuple[str, ...] = (), ids: DataFrame | None = None) -> DataFrame:
    """The column of ids with the entities' JSON in their place."""
    found = entity_texts(graph, kind, "__id", "__text", types, ids)
    return frame.join(found, F.col(name) == F.col("__id"), "left").withColumn(name, F.col("__text")).drop("__id", "__text")


def with_lists(rows: DataFrame, graph: PropertyGraph, lists: dict[str, Kind]) -> DataFrame:
    """As with_entity, for columns of lists: a row for each item, all of one kind joined at once, and the lists made again in their order. __row tells rows apart."""
    out = rows
    for kind in dict.fromkeys(lists.values()):
        names = [n for n, of in lists.items() if of is kind]
        items = reduce(DataFrame.unionByName, (rows.select("__row", F.lit(n).alias("__of"), F.posexplode(n).alias("__at", "__item")) for n in names))
        found = items.join(entity_texts(graph, kind, "__id", "__text", ids=items.select("__item")), F.col("__item") == F.col("__id"), "left")
        own = [F.array_sort(F.collect_list(F.when(F.col("__of") == n, F.struct("__at", "__text")))) for n in names]
        out = out.join(found.groupBy("__row").agg(*(F.transform(o, lambda x: x["__text"]).alias(f"__{n}") for n, o in zip(names, own, strict=True))), "__row", "left")
    return out.withColumns({n: F.when(F.col(n).isNotNull(), F.coalesce(f"__{n}", F.array().cast("array<string>"))) for n in lists})


def listed(name: str) -> Column:
    return F.concat(F.lit("["), F.array_join(name, ","), F.lit("]"))


def hydrated(result: Result, graph: PropertyGraph) -> DataFrame:
    """The result under its own names; entities, lists of them and paths are objects (VARIANT) and not ids.

    Each comes by a join, so results of any size do. Of entities whose types the statement says only those are
    read; for others the rows are written with their ids first. Entities in maps and in lists of lists stay ids.
    """
    frame, types = result.frame.select(*(f"c{k}" for k in range(len(result.columns)))), result.types or [()] * len(result.columns)
    lists: dict[str, Kind] = {}
    for k, (_, kind) in enumerate(result.columns):
        if kind.name == "list" and kind.item in (NODE, EDGE):
            lists[f"c{k}"] = kind.item
        elif kind is PATH:
            frame = frame.withColumns({f"c{k}n": F.col(f"c{k}")["nodes"], f"c{k}e": F.col(f"c{k}")["edges"]})
            lists |= {f"c{k}n": NODE, f"c{k}e": EDGE}
    if lists or any(kind in (NODE, EDGE) and not t for (_, kind), t in zip(result.columns, types, strict=True)):
        # rows are told apart by a number, which is written so that it stays the same
        frame = kept(frame.withColumn("__row", F.monotonically_increasing_id()))
    known, out = frame, []
    if lists:
        frame = with_lists(frame, graph, lists)
    for k, (name, kind) in enumerate(result.columns):
        here = f"c{k}"
        if kind in (NODE, EDGE):
            frame, value = with_entity(frame, graph, here, kind, types[k], known.select(here)), F.col(here)
        elif here in lists:
            value = listed(here)
        elif kind is PATH:
            value = F.concat(F.lit('{"$type":"path","nodes":'), listed(f"{here}n"), F.lit(',"relationships":'), listed(f"{here}e"), F.lit("}"))
        else:
            out.append(F.col(here).alias(name))
            continue
        out.append(F.parse_json(value).alias(name))
    return frame.select(*out)


def export(result: Result, graph: PropertyGraph, folder: str) -> None:
    """JSON lines, an object for each row with all of the result's columns. Their order in files is no order of the rows."""
    hydrated(result, graph).write.option("ignoreNullFields", "false").json(folder)
