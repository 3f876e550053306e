"""Approximate nearest neighbours by balanced posting lists.

Centroids in two levels, coarse ones of the whole table and the lists of each coarse cell, are fitted in balance
on bounded samples and stand in memory with a neighbourhood graph that is searched for those near a vector, from the
nearest of STARTS of them. As
many lists are made as hold PER_LIST vectors each, so they grow in number with the table and not in length.
Every vector is stored in its nearest list and, if it lies near a boundary, in the next ones too. A query reads
the lists whose centroid is within a ratio of the nearest one's distance, however many these are: a few where
vectors lie in clusters, nearly all where they have no structure. Lists that lie side by side are read
together; what holds too many vectors or queries is split over tasks.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .base import Workspace

#: Numbers in the sample that coarse centroids are fitted on, at most; vectors that a cell's lists are fitted on for each of them, and at least.
SAMPLE, FIT, FIT_LEAST = 2_000_000, 8, 4096
#: Vectors of a list on average, cells at most, lists of a cell at most. Up to PER_LIST * CELLS vectors a cell is a list; lists get longer only beyond PER_LIST * CELLS * FAN_MOST.
PER_LIST, CELLS, FAN_MOST = 64, 4096, 2048
#: Lists or cells that may store a vector and how much farther than the nearest they may be.
REPLICAS, BOUNDARY = 4, 1.15
#: How much farther than the nearest list or cell those that a query reads may be.
RATIO = 1.5
#: Rows of a distance matrix.
ROWS = 2048
#: Parts of a split.
SPLIT = 8
#: Neighbours in the graph, centroids that a search starts from the nearest of, its first width, vectors searched at once.
DEGREE, STARTS, BEAM, BATCH = 16, 2048, 64, 256
#: Lists read together; stored vectors and queries of a task's group; vectors that get their lists in one task.
TOGETHER, GROUP_VECTORS, GROUP_QUERIES, PART = 16, 1024, 1024, 16_384


def usable(frame: DataFrame, column: str = "embedding") -> DataFrame:
    """vec_id and vector (doubles) of the vectors that take part: finite, not zero, of the commonest dimension; repeated rows once."""
    rows = frame.select(F.col("vec_id").cast("bigint").alias("vec_id"), F.col(column).cast("array<double>").alias("vector"))
    fine = F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("vector", lambda x: x != 0)
    rows = rows.where(F.coalesce(fine, F.lit(False)))
    common = rows.groupBy(F.size("vector").alias("d")).count().orderBy(F.desc("count"), "d").first()
    return rows.where(F.size("vector") == (common.d if common else 0)).dropDuplicates(["vec_id", "vector"])


def matrix(column: pd.Series) -> np.ndarray:
    return np.stack(column.to_numpy()).astype(float) if len(column) else np.empty((0, 0))


@dataclass
class Centroids:
    """scale: the median distance of a vector from its centroid."""

    points: np.ndarray
    links: np.ndarray
    scale: float

    def reach(self, vectors: np.ndarray, ratio: float = RATIO) -> list[tuple[np.ndarray, np.ndarray]]:
        """For each vector the places of all centroids found within the ratio of the nearest one's distance (of scale, if that is more), and their distances."""
        out: list = [None] * len(vectors)
        todo, width = np.arange(len(vectors)), BEAM
        while len(todo):
            near, far = self.search(vectors[todo], width) if 2 * width < len(self.points) else self.measured(vectors[todo])
            ends = (far <= ratio * np.maximum(far[:, :1], self.scale)).sum(axis=1)
            whole = (ends < far.shape[1]) | (far.shape[1] == len(self.points))
            for k in np.flatnonzero(whole):
                out[todo[k]] = near[k, : ends[k]], far[k, : ends[k]]
            todo, width = todo[~whole], 4 * width
        return out

    def measured(self, vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All centroids and their distances, nearest first."""
        far = np.vstack([((vectors[k : k + 1] - self.points) ** 2).sum(axis=1) for k in range(len(vectors))])
        near = np.argsort(far, axis=1, kind="stable")
        return near, np.sqrt(np.take_along_axis(far, near, axis=1))

    def search(self, vectors: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
        """For each vector the places of the nearest centroids found by the graph and their distances, nearest first."""
        n, width = len(self.points), min(width, len(self.points))
        parts = [self._search(vectors[k : k + BATCH], n, width) for k in range(0, len(vectors), BATCH)]
        return (np.vstack([p[0] for p in parts]), np.vstack([p[1] for p in parts])) if parts else (np.empty((0, width), int), np.empty((0, width)))

    def _search(self, q: np.ndarray, n: int, width: int) -> tuple[np.ndarray, np.ndarray]:
        rows = np.arange(len(q))[:, None]
        start = np.unique(np.linspace(0, n - 1, min(n, STARTS)).astype(int))
        gap = np.maximum(0, (q**2).sum(axis=1)[:, None] - 2 * q @ self.points[start].T + (self.points[start] ** 2).sum(axis=1))
        best = np.argpartition(gap, min(width, len(start)) - 1, axis=1)[:, : min(width, len(start))]
        ids, far = np.full((len(q), width), -1), np.full((len(q), width), np.inf)
        ids[:, : best.shape[1]] = start[best]
        far[:, : best.shape[1]] = ((q[:, None] - self.points[start[best]]) ** 2).sum(axis=2)
        seen, done = np.zeros((len(q), n + 1), bool), ids < 0
        seen[:, start] = True
        while True:
            order = np.argsort(far, axis=1, kind="stable")[:, :width]
            ids, far, done = ids[rows, order], far[rows, order], done[rows, order]
            waiting = np.where(done, np.inf, far)
            at = waiting.argmin(axis=1)[:, None]
            live = np.isfinite(waiting[rows, at])
            if not live.any():
                return ids, np.sqrt(far)
            done[rows, at] = True
            new = np.where(live, self.links[ids[rows, at][:, 0]], n)
            new = np.where(seen[rows, new], n, new)
            seen[rows, new] = True
            real = new < n
            gap = np.where(real, ((q[:, None] - self.points[np.where(real, new, 0)]) ** 2).sum(axis=2), np.inf)
            ids, far, done = np.hstack([ids, new]), np.hstack([far, gap]), np.hstack([done, ~real])


def linked(points: np.ndarray) -> np.ndarray:
    """Each centroid's neighbours: near ones of which none is nearer to an earlier one, then the nearest left; and the next by number, so that all can be reached."""
    n = len(points)
    out = np.tile(((np.arange(n) + 1) % n)[:, None], (1, DEGREE))
    for k in range(n):
        far = ((points - points[k]) ** 2).sum(axis=1)
        near = np.argsort(far, kind="stable")[1 : 4 * DEGREE]
        chosen: list[int] = []
        for c in near:
            if len(chosen) < DEGREE - 1 and all(((points[c] - points[o]) ** 2).sum() > far[c] for o in chosen):
                chosen.append(int(c))
        chosen += [int(c) for c in near if c not in chosen][: DEGREE - 1 - len(chosen)]
        out[k, : len(chosen)] = chosen
    return out


def nearest_of(rows: np.ndarray, points: np.ndarray, push: np.ndarray | float = 0.0) -> tuple[np.ndarray, np.ndarray]:
    """For each row the place of the nearest point, farther by push, and its squared distance; some rows of distances at a time."""
    own, gaps = np.empty(len(rows), np.int64), np.empty(len(rows))
    for k in range(0, len(rows), ROWS):
        part = slice(k, k + ROWS)
        gap = np.maximum(0, (rows[part] ** 2).sum(axis=1)[:, None] - 2 * rows[part] @ points.T + (points**2).sum(axis=1))
        own[part] = (gap + push).argmin(axis=1)
        gaps[part] = gap[np.arange(len(gap)), own[part]]
    return own, gaps


def lloyd(sample: np.ndarray, points: np.ndarray, rounds: int = 8) -> tuple[np.ndarray, np.ndarray]:
    """Centroids after some rounds in which full lists are farther away, and each row's list; empty lists restart at the rows worst served."""
    n = len(points)
    sizes, scale = np.full(n, len(sample) / n), 0.0
    for _ in range(rounds):
        own, gaps = nearest_of(sample, points, 0.3 * scale * np.maximum(0, sizes / sizes.mean() - 1))
        scale, sizes = float(np.median(gaps)), np.bincount(own, minlength=n).astype(float)
        sums = np.zeros_like(points)
        np.add.at(sums, own, sample)
        points = sums / np.maximum(sizes, 1)[:, None]
        points[sizes == 0] = sample[np.argsort(-gaps, kind="stable")[: int((sizes == 0).sum())]]
    return points, own


def balanced(sample: np.ndarray, lists: int) -> np.ndarray:
    """About as many centroids: the sample is split into SPLIT balanced parts, and each part again, until none has more than its share."""
    rng, share, done, waiting = np.random.default_rng(7), len(sample) / lists, [], [sample]
    while waiting:
        rows = waiting.pop()
        parts = min(SPLIT, -(-len(rows) // max(1, int(share))))
        if parts < 2 or len(rows) <= share:
            done.append(rows.mean(axis=0))
            continue
        _, own = lloyd(rows, rows[rng.choice(len(rows), parts, replace=False)])
        found = [rows[own == k] for k in range(parts)]
        # what can't be told apart stays together
        waiting += [f for f in found if 0 < len(f) < len(rows)]
        done += [f.mean(axis=0) for f in found if len(f) == len(rows)]
    return np.array(done)


def made(sample: np.ndarray, lists: int) -> Centroids:
    """Centroids of a sample, a fourth of its different vectors at most."""
    sample = np.unique(sample, axis=0)
    points = balanced(sample, max(1, min(lists, len(sample) // 4)))
    return Centroids(points, linked(points), float(np.sqrt(np.median(nearest_of(sample, points)[1]))))


def stored_in(near: np.ndarray, far: np.ndarray, points: np.ndarray) -> list[np.ndarray]:
    """The lists that store each vector: the nearest, and others within the boundary that no chosen list is nearer to than the vector is."""
    out = []
    for ids, gaps in zip(near, far, strict=True):
        chosen = [int(ids[0])]
        for c, gap in zip(ids[1:], gaps[1:], strict=True):
            if len(chosen) == REPLICAS or gap > BOUNDARY * gaps[0]:
                break
            if all(((points[c] - points[o]) ** 2).sum() > gap**2 for o in chosen):
                chosen.append(int(c))
        out.append(np.array(chosen))
    return out


@dataclass
class Index:
    """coarse: the cells. block, parts and base: by cell, the block of cells that get their lists together, its parts, and the number of the cell's first list. models: block and the lists' centroids and graph of each cell. stored: list, vec_id, vector."""

    coarse: Centroids
    block: np.ndarray
    parts: np.ndarray
    base: np.ndarray
    models: DataFrame
    stored: DataFrame
    space: Workspace


MODEL = "cell int, dim int, points array<double>, links array<int>, scale double"


def centroids(row) -> Centroids:
    points = np.asarray(row.points, float).reshape(-1, row.dim)
    return Centroids(points, np.asarray(row.links, np.int64).reshape(len(points), -1), float(row.scale))


def build(rows: DataFrame, space: Workspace) -> Index | None:
    """The index of vectors (vec_id, vector). To the driver come the sample and two numbers a cell."""
    spark, n = rows.sparkSession, rows.count()
    if not n:
        return None
    bound = max(256, SAMPLE // len(rows.first().vector))
    found = rows.orderBy(F.xxhash64("vec_id"), "vec_id").limit(bound).select("vector").toArrow().column("vector").combine_chunks()
    coarse = made(found.flatten().to_numpy(zero_copy_only=False).reshape(len(found), -1), int(np.clip(n // PER_LIST, 1, CELLS)))

    def to_cells(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if len(batch):
                chosen = stored_in(*coarse.search(matrix(batch["vector"]), BEAM // 4), coarse.points)
                yield batch.loc[batch.index.repeat([len(c) for c in chosen])].assign(cell=np.concatenate(chosen).astype(np.int32))

    dealt = space.save(rows.mapInPandas(to_cells, "vec_id bigint, vector array<double>, cell int"), "cells")
    sizes = np.zeros(len(coarse.points), np.int64)
    for cell, size in dealt.groupBy("cell").count().collect():
        sizes[cell] = size
    lists = np.clip(sizes // PER_LIST, 1, FAN_MOST)
    parts = np.maximum(1, -(-sizes // PART))
    # neighbours in number share a block up to PART vectors; a larger cell is one of its own, in parts
    block, held = np.zeros(len(sizes), np.int64), 0
    for k in range(1, len(sizes)):
        held += sizes[k - 1]
        apart = held + sizes[k] > PART
        block[k], held = block[k - 1] + apart, 0 if apart else held
    rate = np.minimum(1.0, np.maximum(FIT * lists, FIT_LEAST) / np.maximum(sizes, 1))
    known = spark.createDataFrame(list(zip(range(len(sizes)), lists.tolist(), block.tolist(), parts.tolist(), rate.tolist(), strict=True)), "cell int, lists int, block bigint, parts bigint, rate double")
    dealt = dealt.join(F.broadcast(known), "cell")
    sample = dealt.where(F.pmod(F.xxhash64(F.lit(1), "vec_id"), F.lit(1 << 20)) < F.col("rate") * (1 << 20))

    def fit(pdf: pd.DataFrame) -> pd.DataFrame:
        out = []
        for cell, own in pdf.groupby("cell"):
            one = made(matrix(own["vector"]), int(own["lists"].iloc[0]))
            # a cell that is one list may have but one vector
            scale = one.scale if len(one.points) > 1 else coarse.scale
            out.append((cell, one.points.shape[1], one.points.ravel(), one.links.ravel(), scale))
        return pd.DataFrame(out, columns=["cell", "dim", "points", "links", "scale"])

    models = space.save(sample.groupBy("block").applyInPandas(fit, MODEL), "lists").join(F.broadcast(known.select("cell", "block", "parts")), "cell")
    base = np.zeros(len(sizes) + 1, np.int64)
    for cell, count in models.select("cell", (F.size("points") / F.col("dim")).cast("int")).collect():
        base[cell + 1] = count
    base = np.cumsum(base)

    def to_lists(vectors: pd.DataFrame, own: pd.DataFrame) -> pd.DataFrame:
        out = [pd.DataFrame({"list": [], "vec_id": [], "vector": []})]
        for row in own.itertuples():
            mine, model = vectors[vectors["cell"] == row.cell], centroids(row)
            if len(mine):
                chosen = stored_in(*model.search(matrix(mine["vector"]), BEAM // 4), model.points)
                out.append(mine.loc[mine.index.repeat([len(c) for c in chosen])].assign(list=base[row.cell] + np.concatenate(chosen))[["list", "vec_id", "vector"]])
        return pd.concat(out[1:] or out)

    left = dealt.withColumn("part", F.pmod(F.xxhash64("vec_id"), F.col("parts"))).select(F.col("block").alias("block"), "part", "cell", "vec_id", "vector")
    stored = left.groupBy("block", "part").cogroup(by_part(models)).applyInPandas(to_lists, "list bigint, vec_id bigint, vector array<double>")
    return Index(coarse, block, parts, base, models, space.save(stored, "stored"), space)


def by_part(models: DataFrame):
    """The models of each block, for each of its parts."""
    return models.withColumn("part", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("parts") - 1))).drop("parts").groupBy("block", "part")


def reading(index: Index, asked: DataFrame) -> DataFrame:
    """query_id, vector and lists: the lists that each of the queries (query_id, vector) reads, in some rows."""
    coarse, block, parts, base = index.coarse, index.block, index.parts, index.base

    def to_cells(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for query_id, vector, (cells, _) in zip(batch["query_id"], batch["vector"], coarse.reach(matrix(batch["vector"])) if len(batch) else [], strict=True):
                at = block[cells]
                rows += [(query_id, vector, b, query_id % parts[cells[at == b][0]], cells[at == b].astype(np.int32)) for b in np.unique(at)]
            yield pd.DataFrame(rows, columns=["query_id", "vector", "block", "part", "cells"])

    def to_lists(queries: pd.DataFrame, models: pd.DataFrame) -> pd.DataFrame:
        lists: list[list] = [[] for _ in range(len(queries))]
        nearest, most, space = np.full(len(queries), np.inf), np.zeros(len(queries)), matrix(queries["vector"])
        for row in models.itertuples():
            own = np.flatnonzero([row.cell in cells for cells in queries["cells"]])
            model = centroids(row)
            for k, (ids, gaps) in zip(own, model.reach(space[own]) if len(own) else [], strict=True):
                lists[k].append((base[row.cell] + ids, gaps))
                if gaps[0] < nearest[k]:
                    nearest[k], most[k] = gaps[0], RATIO * max(gaps[0], model.scale)
        at = [k for k, found in enumerate(lists) if found]
        rows = [(queries["query_id"].iloc[k], queries["vector"].iloc[k], *map(np.concatenate, zip(*lists[k], strict=True)), nearest[k], most[k]) for k in at]
        return pd.DataFrame(rows, columns=["query_id", "vector", "lists", "gaps", "nearest", "most"])

    cells = asked.mapInPandas(to_cells, "query_id bigint, vector array<double>, block bigint, part bigint, cells array<int>")
    lists = cells.groupBy("block", "part").cogroup(by_part(index.models)).applyInPandas(to_lists, "query_id bigint, vector array<double>, lists array<bigint>, gaps array<double>, nearest double, most double")
    # of all lists those that the cell with the nearest one would read
    most = F.min(F.struct("nearest", "most")).over(Window.partitionBy("query_id", "vector"))["most"]
    lists = lists.withColumn("most", most)
    inside = F.filter(F.arrays_zip("lists", "gaps"), lambda x: x["gaps"] <= F.col("most"))
    return lists.select("query_id", "vector", F.transform(inside, lambda x: x["lists"]).alias("lists")).where(F.size("lists") > 0)


def nearest(index: Index, asked: DataFrame, k: int) -> DataFrame:
    """query_id, vec_id and score of the k nearest stored vectors in the lists read together, for each query and group."""
    place = [F.floor(F.col("list") / TOGETHER).alias("place")]
    stored = index.stored.select("*", *place)

    def to_places(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for query_id, vector, lists in zip(batch["query_id"], batch["vector"], batch["lists"], strict=True):
                places, at = np.unique(np.asarray(lists) // TOGETHER, return_inverse=True)
                rows += [(query_id, vector, place, np.asarray(lists)[at == k]) for k, place in enumerate(places.tolist())]
            yield pd.DataFrame(rows, columns=["query_id", "vector", "place", "lists"])

    read = index.space.save(reading(index, asked).mapInPandas(to_places, "query_id bigint, vector array<double>, place bigint, lists array<bigint>"), "reading")
    size = lambda t, most, name: t.groupBy("place").agg(F.ceil(F.count(F.lit(1)) / most).cast("bigint").alias(name))
    # a group's vectors are dealt to `down` parts and its queries to `across`; each meeting is one task's group
    shape = size(stored, GROUP_VECTORS, "downs").join(size(read, GROUP_QUERIES, "acrosss"), "place")

    def dealt(table: DataFrame, key: str, mine: str, theirs: str):
        every = F.explode(F.sequence(F.lit(0).cast("bigint"), F.col(f"{theirs}s") - 1))
        own = table.join(shape, "place").withColumn(mine, F.pmod(F.xxhash64(key), F.col(f"{mine}s"))).withColumn(theirs, every)
        return own.drop("downs", "acrosss").groupBy("place", "down", "across")

    def measured(vectors: pd.DataFrame, queries: pd.DataFrame) -> pd.DataFrame:
        if not len(vectors) or not len(queries):
            return pd.DataFrame({"query_id": [], "vec_id": [], "score": []})
        order = np.argsort(vectors["vec_id"].to_numpy(), kind="stable")
        ids, space, own, out = vectors["vec_id"].to_numpy()[order], matrix(vectors["vector"])[order], vectors["list"].to_numpy()[order], []
        for query_id, vector, lists in zip(queries["query_id"], queries["vector"], queries["lists"], strict=True):
            at = np.flatnonzero(np.isin(own, lists) & (ids != query_id))
            far = np.sqrt(((space[at] - np.asarray(vector, float)) ** 2).sum(axis=1))
            # of an id's vectors the nearest counts; then by distance and id
            at, far = at[(near := np.lexsort((far, ids[at])))], far[near]
            first = np.concatenate([[True], np.diff(ids[at]) != 0])[: len(at)]
            at, far = at[first], far[first]
            best = np.lexsort((ids[at], far))[:k]
            out.append(pd.DataFrame({"query_id": query_id, "vec_id": ids[at][best], "score": far[best]}))
        return pd.concat(out)

    return dealt(stored, "vec_id", "down", "across").cogroup(dealt(read, "query_id", "across", "down")).applyInPandas(measured, "query_id bigint, vec_id bigint, score double")


def neighbours(frame: DataFrame, every: int = 100, k: int = 10) -> DataFrame:
    """query_id, rank, vec_id and score (Euclidean distance) of the k nearest found, for the vectors whose id is divisible by every.

    Null, zero and non-finite vectors and those of other dimensions take no part; neither do vectors without an
    id. Rows equal in id and vector are one. An id with several vectors is one item: its distance to another is
    the least between any two of theirs, and it is never its own neighbour. Of equal vectors only the k + 1 with
    the least ids can be among a query's k nearest, so only those are stored. Ties go to the smaller id; a query
    with fewer candidates than k gets all that it finds; no vectors give no rows.
    """
    spark = frame.sparkSession
    space = Workspace(spark, "posting-lists")
    rows = space.save(usable(frame).where("vec_id is not null"), "vectors")
    copies = Window.partitionBy("vector").orderBy("vec_id")
    kept = rows.withColumn("copy", F.row_number().over(copies)).where(F.col("copy") <= k + 1).drop("copy")
    index = build(space.save(kept, "kept"), space)
    if index is None:
        return spark.createDataFrame([], "query_id bigint, rank int, vec_id bigint, score double")
    asked = rows.where(F.col("vec_id") % every == 0).withColumnRenamed("vec_id", "query_id")
    best = Window.partitionBy("query_id").orderBy("score", "vec_id")
    found = nearest(index, asked, k).groupBy("query_id", "vec_id").agg(F.min("score").alias("score"))
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
