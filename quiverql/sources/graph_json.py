"""Graphs as JSON files and as Parquet folders."""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.typed import variant_path
from ..graph import ORD, PROPERTIES, PropertyGraph
from ..operators.analytics import tidy

#: Bytes of a JSON graph, and its version.
MOST_BYTES, VERSION = 50 * 1024 * 1024, 1
#: What is no number in JSON: escaped characters, and then strings.
ESCAPED, QUOTED, NUMBER = r"(?s)\\.", '"[^"]*"', r"-?\d[\d.eE+-]*"
NODE_KEYS, EDGE_KEYS = ("id", "label", "type"), ("id", "source", "target", "type")


def load_json(spark: SparkSession, path: str) -> PropertyGraph:
    """A validated graph from one JSON file of at most MOST_BYTES.

    Values stay VARIANT until the types of each property are known over all nodes or edges; a property that
    has one type becomes a column of it, one with several stays VARIANT, so nothing is converted.
    """
    source = spark.read.format("binaryFile").load(path).select("length", F.decode("content", "UTF-8").alias("text"))
    size = source.agg(F.sum("length")).first()[0] or 0
    if size > MOST_BYTES:
        raise ValueError("The graph's file is larger than 50 MiB.")
    parsed = source.select(F.try_parse_json("text").alias("v"), F.regexp_replace(F.regexp_replace("text", ESCAPED, ""), QUOTED, "").alias("bare"))
    infinite = F.exists(F.regexp_extract_all("bare", F.lit(NUMBER), F.lit(0)), lambda n: F.abs(n.try_cast("double")) == float("inf"))
    shape = parsed.select(*(F.schema_of_variant(F.try_variant_get("v", f"$.{k}", "variant")).alias(k) for k in ("nodes", "edges", "metadata")), F.try_variant_get("v", "$.schema_version", "variant").alias("version"), F.schema_of_variant("v").alias("whole"), infinite.alias("infinite")).first()
    if shape is None or shape.whole is None or shape.infinite:
        raise ValueError("The file is no JSON, or has a number that isn't finite.")
    version = shape.version.toPython() if shape and shape.version is not None else None
    if not shape.whole.startswith("OBJECT") or type(version) is not int or version != VERSION:
        raise ValueError("A graph is an object with schema_version 1.")
    if shape.metadata is not None and not shape.metadata.startswith("OBJECT"):
        raise ValueError("The metadata of a graph is an object.")
    for key in ("nodes", "edges"):
        if not (getattr(shape, key) or "").startswith("ARRAY"):
            raise ValueError(f"The {key} of a graph are an array.")
    nodes, edges = (spark.sql(f"select pos as {ORD}, value from {{parsed}}, lateral variant_explode(try_variant_get(v, '$.{k}', 'variant'))", parsed=parsed) for k in ("nodes", "edges"))
    graph = PropertyGraph(typed(nodes, NODE_KEYS), typed(edges, EDGE_KEYS), parsed.select(F.to_json(F.try_variant_get("v", "$.metadata", "variant"))).first()[0] and _metadata(parsed) or {})
    return validate(graph)


def _metadata(parsed: DataFrame) -> dict:
    return parsed.select(F.try_variant_get("v", "$.metadata", "variant").alias("m")).first().m.toPython()


def types_of(pairs: DataFrame) -> dict[str, set[str]]:
    """The types of each key in rows of key and value; as many rows come to the driver as there are keys and types."""
    known: dict[str, set[str]] = {}
    rows = pairs.where(~F.is_variant_null("value")).select("key", F.schema_of_variant("value").alias("t")).distinct()
    for key, name in rows.collect():
        known.setdefault(key, set()).add(name)
    return known


def common(names: set[str]) -> str:
    """The Spark type that holds all values as they are."""
    simple = {"number" if n.startswith("DECIMAL") or n in ("DOUBLE", "FLOAT") else n for n in names}
    if simple <= {"BIGINT"}:
        return "bigint"
    if simple <= {"number"}:
        return "double"
    if simple in ({"STRING"}, {"BOOLEAN"}):
        return simple.pop().lower()
    if simple <= {"ARRAY<STRING>", "ARRAY<VOID>"}:
        return "array<string>"
    if simple <= {"ARRAY<BIGINT>", "ARRAY<VOID>"}:
        return "array<bigint>"
    if simple <= {"ARRAY<BOOLEAN>", "ARRAY<VOID>"}:
        return "array<boolean>"
    # whole numbers among floats stay whole in a VARIANT
    return "variant"


def typed(rows: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    """Columns of the keys and of any further ones, and the struct of properties."""
    spark = rows.sparkSession
    if rows.where(~F.schema_of_variant("value").startswith("OBJECT")).limit(1).count():
        raise ValueError("Nodes and edges are objects.")
    top = types_of(spark.sql("select e.key, e.value from {rows} r, lateral variant_explode(r.value) e", rows=rows))
    for key in keys:
        if top.get(key, {"STRING"}) != {"STRING"}:
            raise ValueError(f"{key} is a string that isn't empty.")
    if not all(n.startswith("OBJECT") for n in top.get(PROPERTIES, ())):
        raise ValueError("Properties are an object.")
    own = types_of(spark.sql(f"select e.key, e.value from {{rows}} r, lateral variant_explode(try_variant_get(r.value, '$.{PROPERTIES}', 'variant')) e", rows=rows))

    def taken(path: str, names: set[str]):
        return F.try_variant_get("value", path, common(names))

    columns = [F.try_variant_get("value", f"$.{k}", "string").alias(k) for k in keys]
    columns += [taken(variant_path(k), n).alias(k) for k, n in sorted(top.items()) if k not in (*keys, PROPERTIES, ORD)]
    inner = [taken(f"$.{PROPERTIES}" + variant_path(k)[1:], n).alias(k) for k, n in sorted(own.items())]
    if inner:
        columns.append(F.struct(*inner).alias(PROPERTIES))
    return rows.select(F.col(ORD).cast("bigint").alias(ORD), *columns)


def validate(graph: PropertyGraph) -> PropertyGraph:
    """The graph itself; ValueError if a key is blank, an id is there twice or an edge ends nowhere."""
    for table, keys, what in ((graph.nodes, NODE_KEYS, "node"), (graph.edges, EDGE_KEYS, "edge")):
        blank = reduce(lambda a, b: a | b, (F.col(k).isNull() | (F.trim(F.col(k)) == "") for k in keys))
        if row := table.where(blank).select("id").first():
            raise ValueError(f"A {what} needs strings that aren't empty for {', '.join(keys)}: {row.id}")
        if row := table.groupBy("id").count().where("count > 1").first():
            raise ValueError(f"The id {row.id} is there more than once.")
    if graph.nodes.first() is None:
        raise ValueError("A graph has nodes.")
    ids = graph.nodes.select("id")
    for end in ("source", "target"):
        if row := graph.edges.join(ids.withColumnRenamed("id", end), end, "left_anti").select("id").first():
            raise ValueError(f"An end of the edge {row.id} is no node.")
    return graph


def save(graph: PropertyGraph, folder: str) -> None:
    """Parquet tables of nodes and edges by type, so a scan of one type reads its files only.

    The graph is validated first, and written beside the folder, which gets its name when all is there; an error if
    there is one of that name.
    """
    validate(graph)
    context = graph.spark.sparkContext
    target = context._jvm.org.apache.hadoop.fs.Path(folder)
    aside = context._jvm.org.apache.hadoop.fs.Path(f"{folder}.{uuid.uuid4().hex[:12]}.tmp")
    files = target.getFileSystem(context._jsc.hadoopConfiguration())
    if files.exists(target):
        raise ValueError(f"{folder} is there already.")
    try:
        for name, table in (("nodes", graph.nodes), ("edges", graph.edges)):
            table.write.partitionBy("type").parquet(f"{aside}/{name}")
        if not files.rename(aside, target):
            raise ValueError(f"{folder} can't be made.")
    finally:
        files.delete(aside, True)


def load(spark: SparkSession, folder: str) -> PropertyGraph:
    def read(name: str) -> DataFrame:
        table = spark.read.option("basePath", f"{folder}/{name}").parquet(f"{folder}/{name}")
        return table.withColumn("type", F.col("type").cast("string"))

    return PropertyGraph(read("nodes"), read("edges"))


def save_tables(graph: PropertyGraph, name: str, buckets: int = 64, folder: str | None = None, checked: bool = True) -> None:
    """Three tables of the catalog: nodes in buckets by id, edges by source and once more by target. Patterns over them join without moving the edges.

    A bucket of a type is one file; choose buckets so that one holds some 100 MB. The files go to the folder, else
    to the warehouse. The graph is validated first if it is to be checked. Edges are moved one type after the other, and
    what moved is dropped once it is written, so disk is needed for the tables and one type's rows; the third
    table is made from the second, so that the graph is computed once.
    """
    if checked:
        validate(graph)
    spark, kind = graph.spark, F.col("type")
    types = list(graph.between) or [t for (t,) in graph.edges.select("type").distinct().collect()]
    # edges of types that aren't known to whoever made the graph
    of_type = [*(kind.eqNullSafe(t) for t in types), *([~kind.isin(types) | kind.isNull()] if graph.between or not types else [])]
    for part, table, key, parts in (("nodes", lambda: graph.nodes, "id", [F.lit(True)]), ("edges_out", lambda: graph.edges, "source", of_type), ("edges_in", lambda: spark.table(f"{name}_edges_out"), "target", of_type)):
        for k, own in enumerate(parts):
            writer = table().where(own).repartition(buckets, key).write.option("compression", "zstd").partitionBy("type").bucketBy(buckets, key).sortBy(key)
            if folder and not k:
                writer = writer.option("path", f"{folder}/{part}")
            writer.mode("append" if k else "error").saveAsTable(f"{name}_{part}")
            tidy(spark)


def load_tables(spark: SparkSession, name: str) -> PropertyGraph:
    nodes, out, back = (spark.table(f"{name}_{part}") for part in ("nodes", "edges_out", "edges_in"))
    return PropertyGraph(nodes, out, {}, back)


def export_json(graph: PropertyGraph, folder: str) -> None:
    """The graph as one JSON object in one text file of the folder, entities in their order; null properties are left out. For graphs within MOST_BYTES."""
    import json

    def listed(table: DataFrame) -> DataFrame:
        one = F.struct(F.col(ORD), F.to_json(F.struct(*(F.col(f"`{c}`") for c in table.columns if c != ORD))).alias("j"))
        return table.agg(F.array_join(F.transform(F.array_sort(F.collect_list(one)), lambda x: x["j"]), ",").alias("all"))

    both = listed(graph.nodes).withColumnRenamed("all", "n").crossJoin(listed(graph.edges).withColumnRenamed("all", "e"))
    head = json.dumps({"schema_version": VERSION, "metadata": graph.metadata})[:-1]
    both.select(F.concat(F.lit(head + ', "nodes": ['), "n", F.lit('], "edges": ['), "e", F.lit("]}"))).coalesce(1).write.text(folder)


