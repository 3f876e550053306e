"""Graph analytics: degrees, distributions, neighbourhoods, shortest paths, levels and clusters.

Searches go level by level: the frontier meets the edges and loses what was seen before. Each level is
checkpointed, so lineage stays short and a lost executor costs one level.
"""

from __future__ import annotations

import gc
import re
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..graph import PropertyGraph

#: Entities shown at once, of the directory, of the ranking, of connections; rows of a page and of a chat page.
SHOWN, DIRECTORY, RANKING, CONNECTIONS, PAGE, CHAT_PAGE = 600, 30, 5, 30, 50, 8
#: The edge types that each preset leaves out, all but which it keeps, and the node types it keeps.
LINK = "CO_OCCURS_WITH"
PRESETS = {"overview": {"without": (LINK,)}, "concepts": {"nodes": ("Concept",), "only": (LINK,)}, "structure": {"only": ("CONTAINS",), "nodes": ("Document", "Section", "Passage")}}
#: Rounds of pointer doubling: enough for 2^40 levels; nodes that contain one another have no section above.
MOST_DOUBLINGS = 40
CITATION = r"\[node:([^\]\s]+)\]"


def shared_folder(spark: SparkSession) -> str:
    """The folder named in spark.checkpoint.dir or set as the checkpoint folder; in local mode a temporary one, which goes when Python ends."""
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        named = context.getConf().get("spark.checkpoint.dir")
        if named is None:
            if not context.master.startswith("local"):
                raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
            global _own
            _own = tempfile.TemporaryDirectory(prefix="quiverql-")
            named = _own.name
        context.setCheckpointDir(named)
    return context.getCheckpointDir()


_own: tempfile.TemporaryDirectory | None = None


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder."""
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex[:12]}"


def kept(frame: DataFrame) -> DataFrame:
    """The frame from files in the shared folder, in columns and compressed."""
    path = shared_path(frame.sparkSession, "kept")
    frame.write.option("compression", "zstd").parquet(path)
    return frame.sparkSession.read.schema(frame.schema).parquet(path)


def tidy(spark: SparkSession) -> None:
    """Has the driver look for what is no longer in use, upon which Spark removes its shuffle files; else that waits until memory runs short."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def degrees(graph: PropertyGraph, *types: str) -> DataFrame:
    """id, label, type and degree of every node; a loop counts once."""
    counts = graph.ends(*types).groupBy("id").agg(F.count(F.lit(1)).alias("degree"))
    return graph.nodes.select("id", "label", "type").join(counts, "id", "left").withColumn("degree", F.coalesce("degree", F.lit(0)).cast("bigint"))


def top_degrees(graph: PropertyGraph, n: int = RANKING) -> DataFrame:
    return degrees(graph).orderBy(F.desc("degree"), "label", "id").limit(n)


def type_distribution(graph: PropertyGraph) -> DataFrame:
    """what (node or edge), type and n."""
    count = lambda t, what: t.groupBy("type").agg(F.count(F.lit(1)).alias("n")).select(F.lit(what).alias("what"), "type", "n")
    return count(graph.nodes, "node").unionByName(count(graph.edges, "edge"))


def properties(table: DataFrame, key: str) -> Column:
    """A property, null where the table has none of that name."""
    known = table.schema["properties"].dataType.names if "properties" in table.columns else []
    return F.col("properties")[key] if key in known else F.lit(None)


def matching_text(graph: PropertyGraph, query: str) -> DataFrame:
    """Nodes whose label or text has the query, whatever the case."""
    text = F.concat_ws(" ", "label", properties(graph.nodes, "text").cast("string"))
    return graph.nodes.where(F.contains(F.lower(text), F.lower(F.lit(query))))


def edge_weight(graph: PropertyGraph, missing: int) -> Column:
    return F.coalesce(properties(graph.edges, "weight").cast("double"), F.lit(float(missing)))


def enabled_edges(graph: PropertyGraph, types: list[str] | None = None, least_weight: float = 1) -> DataFrame:
    """Edges of enabled types (None: all); co-occurrences also need the weight, a missing one is 1."""
    chosen = graph.edges if types is None else graph.edges.where(F.col("type").isin(*types))
    return chosen.where((F.col("type") != LINK) | (edge_weight(graph, 1) >= least_weight))


def ends_kept(edges: DataFrame) -> DataFrame:
    """What searches ask of edges, written once: each level reads it, and makes no ids again."""
    return kept(edges.select("source", "target", "ord", "type"))


def preset(graph: PropertyGraph, name: str) -> PropertyGraph:
    """The graph as a preset view shows it: overview, concepts or structure."""
    rule, nodes, edges = PRESETS[name], graph.nodes, graph.edges
    if "without" in rule:
        edges = edges.where(~F.col("type").isin(*rule["without"]))
    if "only" in rule:
        edges = edges.where(F.col("type").isin(*rule["only"]))
    if "nodes" not in rule:
        # all nodes stay, so every edge has its ends
        return PropertyGraph(nodes, edges, graph.metadata)
    nodes = nodes.where(F.col("type").isin(*rule["nodes"]))
    # all nodes of the types are there, so edges between such types needn't be joined with them
    sure = [kind for kind, (sources, targets) in graph.between.items() if {*sources, *targets} <= {*rule["nodes"]}]
    return induced(PropertyGraph(nodes, edges, graph.metadata), sure)


def induced(graph: PropertyGraph, sure: list[str] | None = None) -> PropertyGraph:
    """Only the edges between nodes that are there. Edges of the sure types are known to have theirs."""
    is_sure = F.col("type").isin(*(sure or ()))
    edges = graph.edges.where(~is_sure) if sure else graph.edges
    for end in ("source", "target"):
        edges = edges.join(graph.nodes.select(F.col("id").alias(end)), end, "left_semi")
    edges = edges.select(*graph.edges.columns)
    return PropertyGraph(graph.nodes, graph.edges.where(is_sure).unionByName(edges) if sure else edges, graph.metadata)


def display(graph: PropertyGraph, most: int = SHOWN) -> PropertyGraph:
    """The first nodes in the graph's order and the edges between them."""
    return induced(PropertyGraph(graph.nodes.orderBy("ord", "id").limit(most), graph.edges, graph.metadata))


def steps(edges: DataFrame, directed: bool = False) -> DataFrame:
    """near, far and ord: the ways over edges. Directed ones go forward only, but co-occurrences both ways."""
    out = edges.select(F.col("source").alias("near"), F.col("target").alias("far"), "ord", "type")
    back = out.where(F.col("type") == LINK) if directed else out
    return out.unionByName(back.select(F.col("far").alias("near"), F.col("near").alias("far"), "ord", "type")).where("near <> far").drop("type")


def levels(ways: DataFrame, start: DataFrame, most: int | None = None) -> DataFrame:
    """id, depth, parent and place of all nodes that ways reach from start (id), up to a depth.

    The parent is the one first found, by the order it was found in and then by edge order. place is that
    order, an array: the parent's place and the edge's ord; so no level is ranked in one task. A job a level.
    """
    seen = kept(start.select("id", F.lit(0).alias("depth"), F.lit(None).cast("string").alias("parent"), F.array().cast("array<bigint>").alias("place")).distinct())
    frontier, depth = seen, 0
    while most is None or depth < most:
        depth += 1
        frontier = kept(next_level(frontier, seen, ways, depth))
        if frontier.isEmpty():
            break
        # each level is written once
        seen = seen.unionByName(frontier)
    return seen


def next_level(frontier: DataFrame, seen: DataFrame, ways: DataFrame, depth: int) -> DataFrame:
    """What the frontier's ways reach that wasn't seen, each node once; the least way is found before the shuffle."""
    met = frontier.select(F.col("id").alias("near"), F.col("place").alias("before")).join(ways, "near").join(seen.select(F.col("id").alias("far")), "far", "left_anti")
    first = met.groupBy(F.col("far").alias("id")).agg(F.min(F.struct("before", "ord", "near")).alias("m"))
    return first.select("id", F.lit(depth).alias("depth"), F.col("m.near").alias("parent"), F.array_append("m.before", F.col("m.ord")).alias("place"))


def k_hop(graph: PropertyGraph, start: str, hops: int, edges: DataFrame | None = None) -> DataFrame:
    """id and depth of the nodes within that many hops, in either direction, over enabled edges. Each hop reads them, so edges that are made from tables are best passed as ends_kept has them."""
    begun = graph.nodes.where(F.col("id") == start).select("id")
    return levels(steps(graph.edges if edges is None else edges), begun, hops).select("id", "depth")


def shortest_path(graph: PropertyGraph, start: str, goal: str, directed: bool = False, edges: DataFrame | None = None) -> list[str]:
    """The nodes of a shortest path; empty if there is none. The path, not the graph, comes to the driver, as one row."""
    found = path_between(graph, start, goal, directed, edges).orderBy("step").select("id").collect()
    return [row.id for row in found]


def path_between(graph: PropertyGraph, start: str, goal: str, directed: bool = False, edges: DataFrame | None = None) -> DataFrame:
    """step (from 0) and id of a shortest path, no rows if there is none.

    Searches from both ends, a level at a time and the smaller frontier first, until a level meets the other side,
    so each goes half the way. Of the shortest paths that is the one whose edges come first from the start, as a
    search from the start alone finds it.
    """
    ways = steps(graph.edges if edges is None else edges, directed)
    back = ways.select(F.col("near").alias("far"), F.col("far").alias("near"), "ord")
    ends = [levels(w, graph.nodes.where(F.col("id") == end).select("id"), 0) for w, end in ((ways, start), (back, goal))]
    seen, frontier, depth = list(ends), list(ends), [0, 0]
    schema = "step int, id string"
    if any(f.isEmpty() for f in ends):
        return graph.spark.createDataFrame([], schema)
    while frontier[0].join(seen[1].select("id"), "id", "left_semi").isEmpty():
        sizes = [f.count() for f in frontier]
        side = 0 if sizes[0] <= sizes[1] else 1
        depth[side] += 1
        frontier[side] = kept(next_level(frontier[side], seen[side], (ways, back)[side], depth[side]))
        if frontier[side].isEmpty():
            return graph.spark.createDataFrame([], schema)
        seen[side] = seen[side].unionByName(frontier[side])
        if side == 1 and not frontier[1].join(seen[0].select("id"), "id", "left_semi").isEmpty():
            break
    return first_path(seen, ways, start, goal, sum(depth))


def first_path(seen: list[DataFrame], ways: DataFrame, start: str, goal: str, length: int) -> DataFrame:
    """The path from the levels of both sides: only nodes on shortest paths are left, and from the start the first way to each wins."""
    sides = seen[0].select("id", F.col("depth").alias("from_start")).join(seen[1].select("id", (F.lit(length) - F.col("depth")).alias("to_goal")), "id", "outer")
    on = kept(sides.where("from_start is null or to_goal is null or from_start = to_goal").select("id", F.coalesce("from_start", "to_goal").alias("level")))
    near, far = (on.select(F.col("id").alias(k), F.col("level").alias(f"{k}_level")) for k in ("near", "far"))
    links = kept(ways.join(near, "near").join(far, "far").where("far_level = near_level + 1").select("near", "far", "far_level", "ord"))
    reached = on.where((F.col("id") == start) & (F.col("level") == 0)).select("id", F.array("id").alias("path"), F.array().cast("array<bigint>").alias("place"))
    for level in range(1, length + 1):
        met = reached.join(links.where(F.col("far_level") == level), F.col("id") == F.col("near"))
        reached = met.groupBy("far").agg(F.min(F.struct("place", "ord", "path")).alias("m")).select(F.col("far").alias("id"), F.array_append("m.path", F.col("far")).alias("path"), F.array_append("m.place", F.col("m.ord")).alias("place"))
    return reached.where(F.col("id") == goal).select(F.posexplode("path").alias("step", "id"))


def root(graph: PropertyGraph, selected: str | None = None) -> str | None:
    """Where levels start: the selected node, else the first document, else the node of highest degree."""
    if selected is not None:
        return selected
    if first := graph.nodes.where(F.col("type") == "Document").orderBy("ord", "id").select("id").first():
        return first.id
    best = degrees(graph).orderBy(F.desc("degree"), "id").first()
    return best.id if best else None


def bands(graph: PropertyGraph, selected: str | None = None) -> DataFrame:
    """id, label, type, cluster and depth from the root; what can't be reached is a level beyond the last. In order of depth, cluster and label."""
    start = root(graph, selected)
    found = levels(steps(graph.edges), graph.nodes.where(F.col("id") == start).select("id")).select("id", "depth")
    last = found.agg(F.max("depth")).first()[0]
    out = clusters(graph).join(found, "id", "left").withColumn("depth", F.coalesce("depth", F.lit((last or 0) + 1)))
    return out.orderBy("depth", "cluster", "label", "id")


def clusters(graph: PropertyGraph) -> DataFrame:
    """id, label, type and cluster: a section's own id or that of the nearest one above; for a concept the cluster of most of its mentions, the least id of equals."""
    nodes = graph.nodes.select("id", "label", "type")
    up = graph.edges.where("type = 'CONTAINS'").groupBy(F.col("target").alias("id")).agg(F.min(F.struct("ord", "source")).alias("m")).select("id", F.col("m.source").alias("above"))
    kinds = nodes.select(F.col("id").alias("above"), (F.col("type") == "Section").alias("heading"))
    # far: a section, or the node that is farthest up so far; each round doubles the way, so a deep tree takes few
    start = nodes.where("type <> 'Concept'").select("id", (F.col("type") == "Section").alias("own")).join(up, "id", "left").join(kinds, "above", "left")
    own = F.coalesce("own", F.lit(False))
    now = kept(start.select("id", F.when(own, F.col("id")).when(F.col("heading"), F.col("above")).alias("cluster"), F.when(~own & ~F.coalesce("heading", F.lit(False)), F.col("above")).alias("far")))
    rounds = 0
    while rounds < MOST_DOUBLINGS and not now.where("far is not null").isEmpty():
        rounds += 1
        there = now.select(F.col("id").alias("far"), F.col("cluster").alias("far_cluster"), F.col("far").alias("farther"))
        now = kept(now.join(there, "far", "left").select("id", F.coalesce("cluster", "far_cluster").alias("cluster"), F.when(F.coalesce("cluster", "far_cluster").isNull(), F.col("farther")).alias("far")))
    votes = graph.edges.where("type = 'MENTIONS'").join(now.select(F.col("id").alias("source"), "cluster"), "source").where("cluster is not null")
    most = votes.groupBy(F.col("target").alias("id"), "cluster").agg(F.count(F.lit(1)).alias("n")).groupBy("id").agg(F.min_by("cluster", F.struct(-F.col("n"), F.col("cluster"))).alias("cluster"))
    known = now.select("id", "cluster").unionByName(most.join(nodes.where("type = 'Concept'").select("id"), "id", "left_semi"))
    return nodes.join(known, "id", "left")


def evidence(graph: PropertyGraph, edge_id: str, table: DataFrame | None = None) -> DataFrame:
    """The passages behind a co-occurrence, in their order: position, id, label and text.

    table: extraction.evidence_of, in which the position is that in the passage's document; else the link's own list.
    """
    if table is None:
        ids, order = graph.edges.where(F.col("id") == edge_id).select(F.posexplode(properties(graph.edges, "evidence")).alias("position", "id")), ["position"]
    else:
        ids, order = table.where(F.col("edge_id") == edge_id).select("digest", "position", F.col("node_id").alias("id")), ["digest", "position"]
    return ids.join(graph.nodes.select("id", "label", properties(graph.nodes, "text").alias("text")), "id").orderBy(*order).select("position", "id", "label", "text")


def heaviest(graph: PropertyGraph) -> DataFrame:
    """weight: the largest of a co-occurrence, a missing one counts 1."""
    return graph.edges.where(F.col("type") == LINK).agg(F.max(edge_weight(graph, 1)).alias("weight"))


def connections(graph: PropertyGraph, node_id: str, types: list[str] | None = None, least_weight: float = 1, n: int = CONNECTIONS) -> DataFrame:
    """A node's edges: enabled ones first, then by weight (a missing one is 0)."""
    on = enabled_edges(graph, types, least_weight).select("id", F.lit(True).alias("enabled"))
    own = graph.edges.where((F.col("source") == node_id) | (F.col("target") == node_id)).withColumn("weight", edge_weight(graph, 0))
    out = own.join(on, "id", "left").withColumn("enabled", F.coalesce("enabled", F.lit(False)))
    return out.select("id", "source", "target", "type", "weight", "enabled", "ord").orderBy(F.desc("enabled"), F.desc("weight"), "ord").limit(n).drop("ord")


def page(frame: DataFrame, number: int, size: int = PAGE) -> DataFrame:
    """A page of an ordered result, the first is 0."""
    return frame.offset(number * size).limit(size)


def citations(graph: PropertyGraph, texts: DataFrame) -> DataFrame:
    """position, node_id, label and known of each [node:ID] in texts (text), for texts with their key columns; unknown ids have known = false."""
    keys = [c for c in texts.columns if c != "text"]
    found = texts.select(*keys, F.posexplode(F.regexp_extract_all("text", F.lit(CITATION), F.lit(1))).alias("position", "node_id"))
    nodes = graph.nodes.select(F.col("id").alias("node_id"), "label", F.lit(True).alias("known"))
    return found.join(nodes, "node_id", "left").withColumn("known", F.coalesce("known", F.lit(False))).select(*keys, "position", "node_id", "label", "known")


def linked_text(text: str, known: dict[str, str]) -> str:
    """The text with known citations as their labels in brackets; others stay as they are."""
    return re.sub(CITATION, lambda m: f"[{known[m[1]]}]" if m[1] in known else m[0], text)
