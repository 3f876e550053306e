"""A bounded surface over one graph for callers that read a little at a time."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..engine import GraphEngine, QueryLimits, json_value
from ..errors import QueryError
from ..graph import PropertyGraph

#: Rows and bytes of a query, rows and characters of what is shown of it, characters of a schema and of a text, calls of a run.
ROWS, BYTES, SHOWN_ROWS, SHOWN_CHARACTERS, SCHEMA_CHARACTERS, TEXT_CHARACTERS, CALLS = 100, 256 * 1024, 12, 18_000, 32_000, 6_000, 50
#: Of a preview, characters of a string, items of a list, keys of a map, depth.
STRING, ITEMS, KEYS, DEPTH = 600, 12, 20, 5


def preview(value: object, depth: int = 0) -> object:
    """A value cut to a readable size."""
    if isinstance(value, str):
        return value if len(value) <= STRING else value[:STRING] + "…"
    if isinstance(value, (list, dict)) and depth >= DEPTH:
        return "…"
    if isinstance(value, list):
        return [preview(v, depth + 1) for v in value[:ITEMS]] + (["…"] if len(value) > ITEMS else [])
    if isinstance(value, dict):
        out = {k: preview(v, depth + 1) for k, v in list(value.items())[:KEYS]}
        return out | ({"…": len(value) - KEYS} if len(value) > KEYS else {})
    return value


def property_counts(graph: PropertyGraph) -> DataFrame:
    """what (node or edge), type, n, property and known: entities of each type and those of them that have each property, one row a pair; a property null where a type has none."""

    def counted(table: DataFrame, what: str) -> DataFrame:
        inner = table.schema["properties"].dataType if "properties" in table.columns else T.StructType()
        each = table.groupBy("type").agg(F.count(F.lit(1)).alias("n"), *(F.count(F.col("properties")[k]).alias(f"p{i}") for i, k in enumerate(inner.names)))
        pairs = [F.struct(F.lit(k).alias("property"), F.col(f"p{i}").alias("known")) for i, k in enumerate(inner.names)]
        known = F.filter(F.array(*pairs), lambda x: x["known"] > 0) if pairs else F.array().cast("array<struct<property: string, known: bigint>>")
        return each.select(F.lit(what).alias("what"), "type", "n", F.inline_outer(known))

    return counted(graph.nodes, "node").unionByName(counted(graph.edges, "edge"))


def schema_of(graph: PropertyGraph) -> dict:
    """Numbers of nodes and edges by type, property names by type, and numbers of edges by the types they join."""
    out: dict = {"node_types": {}, "relationship_types": {}}
    for row in sorted(property_counts(graph).collect(), key=lambda r: r.type):
        types = out["node_types" if row.what == "node" else "relationship_types"]
        own = types.setdefault(row.type, {"count": row.n, "properties": []})
        own["properties"] += [row.property] if row.property else []
    out["directions"] = [r.asDict() for r in directions(graph).orderBy(F.desc("n"), "source_type", "type", "target_type").collect()]
    return out


def directions(graph: PropertyGraph):
    """source_type, type, target_type and n: which types edges join, one row each."""
    kinds = graph.nodes.select("id", F.col("type").alias("t"))
    edges = graph.edges.select("source", "target", "type")
    # edges of one type at one target are counted together before they move again
    sources = edges.join(kinds.withColumnsRenamed({"id": "source", "t": "source_type"}), "source").groupBy("source_type", "type", "target").agg(F.count(F.lit(1)).alias("n"))
    return sources.join(kinds.withColumnsRenamed({"id": "target", "t": "target_type"}), "target").groupBy("source_type", "type", "target_type").agg(F.sum("n").alias("n"))


def text_within(value: dict, most: int, *places: tuple[str, ...]) -> str:
    """JSON of at most that many characters: the longest list or map at one of the places gives up its later entries, a half at a time, and truncated says so."""
    while len(text := json.dumps(value, ensure_ascii=False)) > most:
        lists = []
        for place in places:
            holder = value
            for key in place[:-1]:
                holder = holder.get(key, {})
            if found := holder.get(place[-1]):
                lists.append((len(json.dumps(found, ensure_ascii=False)), place, holder))
        if not lists:
            return json.dumps({"truncated": True})
        _, place, holder = max(lists, key=lambda x: x[0])
        found = holder[place[-1]]
        half = len(found) // 2
        holder[place[-1]] = dict(list(found.items())[:half]) if isinstance(found, dict) else found[:half]
        value["truncated"] = True
    return text


class GraphTools:
    """get_graph_schema, run_graph_query and read_graph_node as JSON texts, CALLS of them at most."""

    def __init__(self, graph: PropertyGraph):
        self.graph, self.left = graph, CALLS
        self.engine = GraphEngine(graph, QueryLimits(max_rows=ROWS, max_result_bytes=BYTES))

    def call(self) -> None:
        if not self.left:
            raise QueryError(f"A run may make {CALLS} calls.")
        self.left -= 1

    def get_graph_schema(self) -> str:
        self.call()
        return text_within(schema_of(self.graph), SCHEMA_CHARACTERS, ("node_types",), ("relationship_types",), ("directions",))

    def run_graph_query(self, text: str, parameters: dict | None = None) -> str:
        self.call()
        try:
            found = self.engine.execute(text, parameters)
        except QueryError as e:
            return json.dumps({"error": e.details(text)}, ensure_ascii=False)
        shown = {k: found[k] for k in ("columns", "truncated", "stats", "graph")} | {"rows": [preview(r) for r in found["rows"][:SHOWN_ROWS]]}
        return text_within(shown, SHOWN_CHARACTERS, ("rows",), ("graph", "node_ids"), ("graph", "edge_ids"), ("columns",))

    def read_graph_node(self, node_id: str) -> str:
        self.call()
        row = self.graph.nodes.where(F.col("id") == node_id).first()
        if row is None:
            return json.dumps({"error": {"message": f"There is no node {node_id}."}}, ensure_ascii=False)
        node = {k: v for k, v in json_value(row).items() if k != "ord" and v is not None}
        inner = {k: v for k, v in (node.get("properties") or {}).items() if v is not None}
        if isinstance(inner.get("text"), str):
            inner["text"] = inner["text"][:TEXT_CHARACTERS]
        return json.dumps(node | {"properties": inner}, ensure_ascii=False)
