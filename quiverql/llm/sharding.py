"""Sharding: global byte-size prefix sums from per-partition totals, cut at equal targets."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .base import Workspace, documents, shuffle_partitions


def sized(frame: DataFrame, overhead: int = 8) -> DataFrame:
    """doc_id, size and text_crc32; the texts end here, in the scan."""
    text = F.coalesce(F.col("text"), F.lit(""))
    return documents(frame).select("doc_id", (F.octet_length(text) + F.lit(overhead)).cast("bigint").alias("size"), F.crc32(F.encode(text, "UTF-8")).alias("text_crc32"))


def contiguous_shards(rows: DataFrame, shards: int) -> DataFrame:
    """rows (doc_id, size, text_crc32) with part, place and start: the row's place and first byte in the global order, and shard and slot.

    The order is by doc_id (null first), then size and checksum; rows equal in all three may be in any order.
    A row goes to the shard in whose equal share of all bytes its middle byte lies, so shards are contiguous
    and differ from the target by less than the largest row. One range shuffle of 24 bytes a row; partition
    and shard totals, as many rows as there are partitions and shards, are broadcast.
    """
    spark = rows.sparkSession
    space, n = Workspace(spark, "sharding"), shuffle_partitions(spark)
    # the row number only deals rows apart that are equal in all else
    keys = [F.asc_nulls_first("doc_id"), F.col("size"), F.col("text_crc32")]
    ordered = rows.withColumn("row", F.monotonically_increasing_id()).repartitionByRange(n, *keys, "row").sortWithinPartitions(*keys)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, place, start = TaskContext.get().partitionId(), 0, 0
        for batch in batches:
            size = batch.column("size").to_numpy()
            ends = start + np.cumsum(size)
            columns = [*(batch.column(c) for c in ("doc_id", "size", "text_crc32")), pa.array(np.full(len(size), part, np.int32)), pa.array(place + np.arange(len(size))), pa.array(ends - size)]
            place, start = place + len(size), int(ends[-1]) if len(size) else start
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "size", "text_crc32", "part", "place", "start"])

    saved = space.save(ordered.mapInArrow(run, "doc_id bigint, size bigint, text_crc32 bigint, part int, place bigint, start bigint"), "prefix")
    totals = saved.groupBy("part").agg(F.sum("size").alias("bytes"), F.count(F.lit(1)).alias("rows"))
    bases = totals.selectExpr("part", "sum(bytes) over (order by part rows between unbounded preceding and current row) - bytes as bytes_before", "sum(rows) over (order by part rows between unbounded preceding and current row) - rows as rows_before", "sum(bytes) over () as all_bytes")
    placed = saved.join(F.broadcast(bases), "part").selectExpr("doc_id", "size", "text_crc32", "rows_before + place as place", "bytes_before + start as start", f"cast(least({shards - 1}, ((2 * (bytes_before + start) + size) * {shards}) div (2 * all_bytes)) as int) as shard")
    firsts = placed.groupBy("shard").agg(F.min("place").alias("first"))
    return placed.join(F.broadcast(firsts), "shard").withColumn("slot", F.col("place") - F.col("first")).drop("first")


def balanced_shards(frame: DataFrame, shards: int = 24) -> DataFrame:
    """All documents with their shard and slot. A null text has no bytes but the overhead; repeated rows and null ids keep their own slots; no documents give no rows."""
    return contiguous_shards(sized(frame), shards).select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
