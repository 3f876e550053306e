"""A property graph as two DataFrames."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Columns that hold the graph's shape; all others of nodes and edges are attributes.
ORD, PROPERTIES = "ord", "properties"


@dataclass(frozen=True)
class PropertyGraph:
    """nodes: id, label, type, ord (place in the graph's list) and properties, a struct, as well as any further columns.

    edges: id, source, target, type, ord, properties and any further columns. Ids are unique among nodes and
    among edges, and every edge's ends are nodes; validate (in sources.graph_json) checks it. by_target: the same
    edges once more, stored by their target, where edges are stored by their source. between: the types of nodes that
    edges of a type lead from and to, where whoever made the graph knows them.
    """

    nodes: DataFrame
    edges: DataFrame
    metadata: dict = field(default_factory=dict)
    by_target: DataFrame | None = None
    between: dict[str, tuple[tuple[str, ...], tuple[str, ...]]] = field(default_factory=dict)

    @property
    def spark(self) -> SparkSession:
        return self.nodes.sparkSession

    def cache(self) -> PropertyGraph:
        return PropertyGraph(self.nodes.cache(), self.edges.cache(), self.metadata, between=self.between)

    def unpersist(self) -> None:
        self.nodes.unpersist()
        self.edges.unpersist()

    def ends(self, *types: str) -> DataFrame:
        """id and edge_type of each end of each edge; a loop ends once."""
        edges = self.edges.where(F.col("type").isin(*types)) if types else self.edges
        out = edges.select(F.col("source").alias("id"), F.col("type").alias("edge_type"))
        return out.unionByName(edges.where("source <> target").select(F.col("target").alias("id"), F.col("type").alias("edge_type")))
