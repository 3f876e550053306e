"""The prefix trie of conversations, its subtree totals by leaf peeling.

A node is known by its depth and a hash of its turns, the exclusive or of a hash of each turn with its place.
Nodes in a row with the same members are one chain, so chains alone pass messages: one whose count of unfinished
child chains is zero is complete, leaves the table and sends its totals to its parent, until only the root is left
and finishes. A chain of a single conversation is complete at once.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .base import Workspace, salted_join

WORD = r"[^\x20\x09-\x0D]+"
EMPTY = hashlib.sha256(b"").hexdigest()
NODE = ["depth", "x", "y"]


def turns(frame: DataFrame) -> DataFrame:
    """conv_id, place from 0, two hashes and the words of each turn; texts end after the sort."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    rows = frame.where(F.col("conv_id").isNotNull()).select(
        F.col("conv_id").cast("bigint").alias("conv_id"), F.col("turn").cast("bigint").alias("turn"), role.alias("role"), text.alias("text"), F.xxhash64(role, text).alias("a"), F.xxhash64(text, F.lit(1), role).alias("b"), F.size(F.regexp_extract_all(text, F.lit(WORD), F.lit(0))).cast("bigint").alias("words")
    )
    order = Window.partitionBy("conv_id").orderBy(F.asc_nulls_first("turn"), "role", "text")
    return rows.select("conv_id", (F.row_number().over(order) - 1).alias("place"), "a", "b", "words")


def rebuilt(own: DataFrame, group: int, most: int) -> tuple[DataFrame, DataFrame]:
    """The conversations' ids, and the turns that each has after the first h of its group's first conversation have taken the place of its own; h is crc32(id) % most."""
    h = F.crc32(F.col("conv_id").cast("string").cast("binary")) % most
    ids = own.select("conv_id").distinct()
    heads = own.where(F.col("place") < most - 1).withColumnRenamed("conv_id", "base")
    taken = ids.select("conv_id", (F.col("conv_id") - F.pmod("conv_id", F.lit(group))).alias("base"), h.alias("h")).where("h > 0").join(heads, "base").where("place < h")
    both = taken.select("conv_id", F.lit(0).alias("part"), "place", "a", "b", "words").unionByName(own.where(F.col("place") >= h).withColumn("part", F.lit(1)))
    order = Window.partitionBy("conv_id").orderBy("part", "place")
    so_far = order.rowsBetween(Window.unboundedPreceding, 0)
    placed = both.withColumn("depth", F.row_number().over(order)).withColumns({"a": F.xxhash64("depth", "a"), "b": F.xxhash64("b", "depth")})
    steps = placed.select("conv_id", "depth", F.bit_xor("a").over(so_far).alias("x"), F.bit_xor("b").over(so_far).alias("y"), "a", "b", "words", F.lead("depth").over(order).isNull().alias("last"))
    return ids, steps.select("conv_id", "depth", "x", "y", F.col("x").bitwiseXOR(F.col("a")).alias("px"), F.col("y").bitwiseXOR(F.col("b")).alias("py"), "words", "last")


def end_hashes(ends: DataFrame) -> DataFrame:
    """The SHA-256 of the ids that end at each node, ascending, in one pass over sorted rows: no list of them is held."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, state = None, None
        for batch in batches:
            if not batch.num_rows:
                continue
            ids = batch.column("conv_id").to_pylist()
            keys = np.stack([batch.column(c).to_numpy().astype(np.int64) for c in NODE])
            cuts = [0, *(np.flatnonzero((keys[:, 1:] != keys[:, :-1]).any(axis=0)) + 1).tolist(), len(ids)]
            out = []
            for low, high in zip(cuts, cuts[1:], strict=False):
                key, part = tuple(keys[:, low].tolist()), ",".join(map(str, ids[low:high])).encode()
                if key == now:
                    state.update(b"," + part)
                    continue
                if now is not None:
                    out.append((*now, state.hexdigest()))
                now, state = key, hashlib.sha256(part)
            yield found(out)
        if now is not None:
            yield found([(*now, state.hexdigest())])

    def found(rows: list[tuple]) -> pa.RecordBatch:
        columns = list(zip(*rows, strict=True)) or [[]] * 4
        return pa.RecordBatch.from_arrays([pa.array(columns[0], pa.int32()), pa.array(columns[1], pa.int64()), pa.array(columns[2], pa.int64()), pa.array(columns[3], pa.string())], names=[*NODE, "sha"])

    return ends.repartition(*NODE).sortWithinPartitions(*NODE, "conv_id").mapInArrow(run, "depth int, x bigint, y bigint, sha string")


def peeled(chains: DataFrame, space: Workspace) -> DataFrame:
    """conv_id, n_convs, leaves and below (what the child chains save in all) of every chain.

    chains: conv_id and n_convs (its key), up_id and up_n (its parent's key, null for the root), pending (the
    number of its child chains) and weight. Messages are summed before they are shuffled; a round handles the
    chains that wait only.
    """
    state = chains.withColumns({"leaves": F.when(F.col("pending") == 0, 1).otherwise(0).cast("bigint"), "below": F.lit(0).cast("bigint")})
    out, turn = [], 0
    while True:
        turn += 1
        state = space.save(state, f"waiting-{turn}")
        done = state.where("pending = 0")
        out.append(done.select("conv_id", "n_convs", "leaves", "below"))
        left = state.where("pending > 0")
        if left.isEmpty():
            break
        sent = done.groupBy(F.col("up_id").alias("conv_id"), F.col("up_n").alias("n_convs")).agg(F.count(F.lit(1)).alias("k"), F.sum("leaves").alias("more"), F.sum(F.col("weight") + F.col("below")).alias("save"))
        grown = left.join(sent, ["conv_id", "n_convs"], "left")
        state = grown.select("conv_id", "n_convs", "up_id", "up_n", (F.col("pending") - F.coalesce("k", F.lit(0))).alias("pending"), "weight", (F.col("leaves") + F.coalesce("more", F.lit(0))).alias("leaves"), (F.col("below") + F.coalesce("save", F.lit(0))).alias("below"))
    total = out[0]
    for other in out[1:]:
        total = total.unionByName(other)
    return total


def trie(frame: DataFrame, group: int = 20, most: int = 4) -> DataFrame:
    """One row a node: conv_id (the least member), depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens and ends_sha256.

    Turns are ordered by turn (null first), those of one turn by role and text, and repeated rows
    are turns of their own; a null role or text is empty. Rows with a null conv_id belong to no conversation and
    are left out. No conversations give no rows, not even a root. A conversation is sorted, and the ids that end
    at one node are hashed, in one task each, row by row; everything else is summed before it is shuffled.
    """
    space = Workspace(frame.sparkSession, "trie")
    ids, steps = rebuilt(space.save(turns(frame), "turns"), group, most)
    ids, steps = space.save(ids, "ids"), space.save(steps, "steps")
    none = F.lit(0).cast("bigint")
    turnless = ids.join(steps.where("depth = 1").select("conv_id"), "conv_id", "left_anti").select("conv_id", F.lit(0).alias("depth"), none.alias("x"), none.alias("y"))
    hashes = end_hashes(steps.where("last").select("conv_id", *NODE).unionByName(turnless))
    made = steps.groupBy(*NODE).agg(F.min("conv_id").alias("conv_id"), F.count(F.lit(1)).alias("n_convs"), F.min("px").alias("px"), F.min("py").alias("py"), F.max("words").alias("words"))
    root = ids.agg(F.min("conv_id").alias("conv_id"), F.count(F.lit(1)).alias("n_convs")).where("n_convs > 0").select(F.lit(0).alias("depth"), none.alias("x"), none.alias("y"), "conv_id", "n_convs", none.alias("px"), none.alias("py"), none.alias("words"))
    made = space.save(made.unionByName(root), "found")
    kids = made.where("depth > 0").groupBy((F.col("depth") - 1).alias("depth"), F.col("px").alias("x"), F.col("py").alias("y")).agg(F.count(F.lit(1)).alias("n_children"))
    nodes = space.save(made.join(kids, NODE, "left").join(hashes, NODE, "left").withColumn("n_children", F.coalesce("n_children", F.lit(0)).cast("bigint")), "nodes")

    # the least member of a node is that of its child on the way to that member, so only the top nodes of each member have another's node above them
    tops = nodes.groupBy("conv_id").agg(F.min_by(F.struct("depth", "px", "py"), "depth").alias("t")).select("conv_id", (F.col("t.depth") - 1).alias("depth"), F.col("t.px").alias("x"), F.col("t.py").alias("y")).where("depth >= 0")
    inner = space.save(nodes.where("n_children > 0").select(*NODE, F.col("conv_id").alias("up_id"), F.col("n_convs").alias("up_n"), F.col("n_children").alias("n")), "inner")
    tops = space.save(salted_join(tops, inner, NODE, F.col("conv_id")).select("conv_id", (F.col("depth") + 1).alias("depth"), "up_id", "up_n"), "tops")

    chains = nodes.groupBy("conv_id", "n_convs").agg(F.min("depth").alias("depth"), F.max_by("n_children", "depth").alias("pending"), F.sum((F.col("n_convs") - 1) * F.col("words")).alias("weight"))
    above = F.lag("n_convs").over(Window.partitionBy("conv_id").orderBy(F.desc("n_convs")))
    linked = chains.withColumn("above", above).join(tops, ["conv_id", "depth"], "left")
    linked = linked.select("conv_id", "n_convs", F.when(F.col("above").isNull(), F.col("up_id")).otherwise(F.col("conv_id")).alias("up_id"), F.coalesce("above", "up_n").alias("up_n"), "pending", "weight")
    totals = peeled(linked, space)

    shared = nodes.where("n_convs > 1").withColumn("on", F.sum((F.col("n_convs") - 1) * F.col("words")).over(Window.partitionBy("conv_id", "n_convs").orderBy(F.desc("depth")).rowsBetween(Window.unboundedPreceding, 0)))
    shared = shared.join(totals.where("n_convs > 1"), ["conv_id", "n_convs"]).withColumns({"n_leaves": F.col("leaves"), "saved_tokens": F.col("on") + F.col("below")})
    single = nodes.where("n_convs = 1").withColumns({"n_leaves": F.lit(1).cast("bigint"), "saved_tokens": none})
    columns = ["conv_id", "depth", "n_convs", "n_children", "n_leaves", "saved_tokens", "sha"]
    out = shared.select(*columns).unionByName(single.select(*columns)).join(tops.select("conv_id", "depth", "up_id"), ["conv_id", "depth"], "left")
    parent = F.when(F.col("depth") > 0, F.coalesce("up_id", "conv_id"))
    return out.select("conv_id", F.col("depth").cast("bigint").alias("depth"), parent.alias("parent_conv_id"), "n_convs", "n_children", "n_leaves", "saved_tokens", F.coalesce("sha", F.lit(EMPTY)).alias("ends_sha256"))
