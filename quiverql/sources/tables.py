"""The star-schema and event tables as a property graph."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..graph import PropertyGraph

#: Properties of nodes and edges and their types.
NODE_FIELDS = {"acctbal": "double", "segment": "string", "brand": "string", "kind": "string", "size": "bigint", "price": "double", "status": "string", "total": "double", "priority": "string", "year": "bigint"}
EDGE_FIELDS = {"line": "bigint", "quantity": "double", "extendedprice": "double", "discount": "double", "tax": "double", "returnflag": "string", "value": "double"}
#: The types of nodes that edges of a type lead from and to.
BETWEEN = {"IN_REGION": (("Nation",), ("Region",)), "IN_NATION": (("Customer", "Supplier"), ("Nation",)), "PLACED": (("Customer",), ("Order",)), "HAS_ITEM": (("Order",), ("Part",)), "SUPPLIED_BY": (("Part",), ("Supplier",)), "DID": (("User",), ("EventType",))}


def _id(prefix: str, *keys: str) -> Column:
    return F.concat_ws(":", F.lit(prefix), *(F.col(k).cast("string") for k in keys))


def _rows(frame: DataFrame, fields: dict[str, str], own: dict[str, Column], **columns: Column) -> DataFrame:
    properties = F.struct(*((own[k] if k in own else F.lit(None)).cast(t).alias(k) for k, t in fields.items()))
    # any order will do that is the same each time
    return frame.select(*(c.alias(k) for k, c in columns.items()), properties.alias("properties")).withColumn("ord", F.xxhash64("id"))


def commerce_graph(spark: SparkSession, sf_dir: str) -> PropertyGraph:
    """Regions, nations, customers, suppliers, parts, orders, users and event types, and what links them.

    A filter on type leaves the scans of that type's tables. A line item is known by order, line, part and
    supplier; line numbers alone repeat.
    """
    read = {n: spark.read.parquet(f"{sf_dir}/{n}.parquet") for n in "region nation customer supplier part orders lineitem events".split()}

    def node(table: str, type_: str, key: str, label: str, **own: Column) -> DataFrame:
        return _rows(read[table], NODE_FIELDS, own, id=_id(type_.lower(), key), label=F.col(label).cast("string"), type=F.lit(type_))

    def edge(frame: DataFrame, type_: str, key: tuple[str, ...], source: Column, target: Column, **own: Column) -> DataFrame:
        return _rows(frame, EDGE_FIELDS, own, id=_id(type_.lower(), *key), source=source, target=target, type=F.lit(type_))

    events = read["events"]
    nodes = [
        node("region", "Region", "r_regionkey", "r_name"),
        node("nation", "Nation", "n_nationkey", "n_name"),
        node("customer", "Customer", "c_custkey", "c_name", acctbal=F.col("c_acctbal"), segment=F.col("c_mktsegment")),
        node("supplier", "Supplier", "s_suppkey", "s_name", acctbal=F.col("s_acctbal")),
        node("part", "Part", "p_partkey", "p_name", brand=F.col("p_brand"), kind=F.col("p_type"), size=F.col("p_size"), price=F.col("p_retailprice")),
        node("orders", "Order", "o_orderkey", "o_orderkey", status=F.col("o_orderstatus"), total=F.col("o_totalprice"), priority=F.col("o_orderpriority"), year=F.year("o_orderdate")),
        _rows(events.select("user_id").distinct(), NODE_FIELDS, {}, id=_id("user", "user_id"), label=F.col("user_id").cast("string"), type=F.lit("User")),
        _rows(events.select("event_type").distinct(), NODE_FIELDS, {}, id=_id("event", "event_type"), label=F.col("event_type"), type=F.lit("EventType")),
    ]
    line = read["lineitem"]
    edges = [
        edge(read["nation"], "IN_REGION", ("n_nationkey",), _id("nation", "n_nationkey"), _id("region", "n_regionkey")),
        edge(read["customer"], "IN_NATION", ("c_custkey",), _id("customer", "c_custkey"), _id("nation", "c_nationkey")),
        edge(read["supplier"].withColumn("s", F.concat(F.lit("s"), F.col("s_suppkey"))), "IN_NATION", ("s",), _id("supplier", "s_suppkey"), _id("nation", "s_nationkey")),
        edge(read["orders"], "PLACED", ("o_orderkey",), _id("customer", "o_custkey"), _id("order", "o_orderkey")),
        edge(line, "HAS_ITEM", ("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"), _id("order", "l_orderkey"), _id("part", "l_partkey"), line=F.col("l_linenumber"), quantity=F.col("l_quantity"), extendedprice=F.col("l_extendedprice"), discount=F.col("l_discount"), tax=F.col("l_tax"), returnflag=F.col("l_returnflag")),
        edge(line.select("l_partkey", "l_suppkey").distinct(), "SUPPLIED_BY", ("l_partkey", "l_suppkey"), _id("part", "l_partkey"), _id("supplier", "l_suppkey")),
        edge(events, "DID", ("event_id",), _id("user", "user_id"), _id("event", "event_type"), value=F.col("value")),
    ]
    union = lambda frames: frames[0] if len(frames) == 1 else frames[0].unionByName(union(frames[1:]))
    return PropertyGraph(union(nodes), union(edges), {"title": "commerce"}, between=BETWEEN)


def measures_graph(spark: SparkSession, sf_dir: str) -> PropertyGraph:
    """Parts with properties of several kinds, held as VARIANT: value is a whole number, a float, a string or missing, list a list of unlike values or missing."""
    part = spark.read.parquet(f"{sf_dir}/part.parquet").withColumn("k", F.col("p_partkey") % 4)
    variant = lambda c: F.col(c).cast("variant")
    size, k = F.col("p_size").cast("bigint").cast("variant"), F.col("k")
    value = F.when(k == 0, size).when(k == 1, variant("p_retailprice")).when(k == 2, variant("p_brand")).when(F.col("p_size") % 2 == 0, variant("p_type"))
    items = F.when(k < 3, F.array(size, F.when(k == 1, variant("p_retailprice")).otherwise(variant("p_brand"))).cast("variant"))
    nodes = part.select(_id("part", "p_partkey").alias("id"), F.col("p_name").alias("label"), F.when(k < 2, "Number").otherwise("Name").alias("type"), F.struct(value.alias("value"), items.alias("list"), F.col("p_brand").alias("brand")).alias("properties"))
    edges = spark.createDataFrame([], "id string, source string, target string, type string, ord bigint, properties struct<weight: double>")
    return PropertyGraph(nodes.withColumn("ord", F.xxhash64("id")), edges, {"title": "measures"})
