"""Token-ID output: patched frame-of-reference blocks.

A file is Parquet; a row of it is one segment of whole documents in ascending doc_id order, and its payload is

    magic, number of ids, number of blocks          3 x uint32
    block minimum                                   uint32 a block
    block start (in words, of the packed area)      uint32 a block, and the end
    block width in bits                             uint8 a block
    first exception of the block                    uint32 a block, and the end
    exception places in their block, high parts     uint16 and uint32 an exception
    packed area                                     uint32 words

A block holds 256 ids less their minimum, packed at the width that the given percentile of them needs; what
exceeds it has its high bits in the exception list. In the packed area, eight lanes of 32 values each stand
side by side, so packing and unpacking go over all blocks of a width at once.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe
from .base import Workspace, documents, shuffle_partitions, slices

MAGIC, BLOCK, LANES, DEEP = 0x31524650, 256, 8, 32
#: Ids after which a segment ends with the document at hand.
SEGMENT = 1 << 20


def pack(ids: np.ndarray, percentile: float = 0.9) -> bytes:
    """The payload of any sequence of 32-bit ids."""
    count, blocks = len(ids), -(-len(ids) // BLOCK)
    grid = np.empty(blocks * BLOCK, np.uint32)
    grid[:count] = ids
    grid[count:] = ids[-1] if count else 0
    grid = grid.reshape(blocks, BLOCK)
    low = grid.min(axis=1) if blocks else np.empty(0, np.uint32)
    grid = grid - low[:, None]
    at = min(BLOCK - 1, int(percentile * BLOCK))
    width = bits(np.partition(grid, at, axis=1)[:, at] if blocks else low)
    high = grid >> np.minimum(width, 31)[:, None].astype(np.uint32)
    high[width == 32] = 0
    block, place = np.nonzero(high)
    first = np.searchsorted(block, np.arange(blocks + 1)).astype(np.uint32)
    start = np.concatenate([[0], np.cumsum(width.astype(np.int64) * LANES)]).astype(np.uint32)
    packed = np.zeros(int(start[-1]), np.uint32)
    for w in np.unique(width[width > 0]):
        own = np.flatnonzero(width == w)
        values = grid[own] & np.uint32((1 << int(w)) - 1)
        values = values.reshape(len(own), DEEP, LANES)
        words = np.zeros((len(own), int(w), LANES), np.uint32)
        for depth in range(DEEP):
            word, shift = divmod(depth * int(w), 32)
            words[:, word] |= values[:, depth] << np.uint32(shift)
            if shift + int(w) > 32:
                words[:, word + 1] |= values[:, depth] >> np.uint32(32 - shift)
        packed[start[own].astype(np.int64)[:, None] + np.arange(int(w) * LANES)] = words.reshape(len(own), -1)
    parts = (np.array([MAGIC, count, blocks], "<u4"), low.astype("<u4"), start.astype("<u4"), width.astype("u1"), first.astype("<u4"), place.astype("<u2"), high[block, place].astype("<u4"), packed.astype("<u4"))
    return b"".join(x.tobytes() for x in parts)


def bits(values: np.ndarray) -> np.ndarray:
    """Bits that each value needs."""
    return np.frexp(values.astype(np.float64))[1].astype(np.uint8)


def unpack(payload: bytes, blocks: slice | None = None) -> np.ndarray:
    """All ids of a payload, or those of a range of its blocks, found by the block starts."""
    magic, count, total = np.frombuffer(payload, "<u4", 3)
    if magic != MAGIC:
        raise ValueError("not a patched frame-of-reference payload")
    total, at = int(total), 12

    def take(kind: str, n: int) -> np.ndarray:
        nonlocal at
        out = np.frombuffer(payload, kind, n, at)
        at += out.nbytes
        return out

    low, start, width, first = take("<u4", total), take("<u4", total + 1), take("u1", total), take("<u4", total + 1)
    place, high = take("<u2", int(first[-1])), take("<u4", int(first[-1]))
    packed = take("<u4", int(start[-1]))
    chosen = np.arange(total)[blocks or slice(None)]
    grid = np.zeros((len(chosen), BLOCK), np.uint32)
    for w in np.unique(width[chosen]):
        if not w:
            continue
        own = np.flatnonzero(width[chosen] == w)
        words = packed[start[chosen[own]].astype(np.int64)[:, None] + np.arange(int(w) * LANES)].reshape(len(own), int(w), LANES)
        values, mask = np.empty((len(own), DEEP, LANES), np.uint32), np.uint32((1 << int(w)) - 1)
        for depth in range(DEEP):
            word, shift = divmod(depth * int(w), 32)
            values[:, depth] = words[:, word] >> np.uint32(shift)
            if shift + int(w) > 32:
                values[:, depth] |= words[:, word + 1] << np.uint32(32 - shift)
        grid[own] = (values & mask).reshape(len(own), BLOCK)
    if len(chosen):
        one, two = int(first[chosen[0]]), int(first[chosen[-1] + 1])
        of = np.repeat(np.arange(len(chosen)), np.diff(first[chosen[0] : chosen[-1] + 2].astype(np.int64)))
        grid[of, place[one:two]] |= high[one:two] << width[chosen][of].astype(np.uint32)
    grid += low[chosen][:, None]
    end = min(int(count), (int(chosen[-1]) + 1) * BLOCK) if len(chosen) else 0
    return grid.reshape(-1)[: end - (int(chosen[0]) * BLOCK if len(chosen) else 0)]


SEGMENTS = "part int, seq int, part_start bigint, n_ids bigint, doc_ids array<bigint>, counts array<bigint>, payload binary"


def segments(frame: DataFrame, path: str, end_id: int, percentile: float = 0.9) -> DataFrame:
    """Segments of all documents: ids of each whole text and then end_id, in ascending doc_id order (null first, equal ones by text).

    One range shuffle, the rows of a task's share sorted; equal doc_ids are dealt apart by their text's hash.
    """
    n = shuffle_partitions(frame.sparkSession)
    keys = [F.asc_nulls_first("doc_id"), F.asc_nulls_first("text_hash")]
    rows = documents(frame).withColumn("text_hash", F.xxhash64("text")).repartitionByRange(n, *keys).sortWithinPartitions(*keys, "text").select("doc_id", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made, part = bpe.encoder(path), TaskContext.get().partitionId()
        seq, before, held, docs = 0, 0, [], []
        end = np.array([end_id], np.uint32)

        def flush() -> pa.RecordBatch:
            nonlocal seq, before, held, docs
            ids = np.concatenate([x for pair in held for x in (pair, end)])
            row = {"part": part, "seq": seq, "part_start": before, "n_ids": len(ids), "doc_ids": docs, "counts": [len(x) + 1 for x in held], "payload": pack(ids, percentile)}
            seq, before, held, docs = seq + 1, before + len(ids), [], []
            return pa.RecordBatch.from_pylist([row], schema=ARROW)

        size = 0
        for batch in slices(batches):
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), strict=True):
                held.append(made.encode(text))
                docs.append(doc_id)
                size += len(held[-1]) + 1
                if size >= SEGMENT:
                    yield flush()
                    size = 0
        if held:
            yield flush()

    return rows.mapInArrow(run, SEGMENTS)


ARROW = pa.schema([("part", pa.int32()), ("seq", pa.int32()), ("part_start", pa.int64()), ("n_ids", pa.int64()), ("doc_ids", pa.list_(pa.int64())), ("counts", pa.list_(pa.int64())), ("payload", pa.binary())])


def write(frame: DataFrame, folder: str, path: str, end_id: int, percentile: float = 0.9) -> None:
    """Writes the segments of all documents as files of the format above, by Spark's committers."""
    segments(frame, path, end_id, percentile).write.parquet(folder)


def read(spark: SparkSession, folder: str) -> DataFrame:
    """doc_id, start (ids of all documents before), n_tokens and ids_crc32 of each document, from the files alone.

    Segments know the ids before them in their part; parts are as many as the writer's tasks, so their totals
    (one row a part) are summed in one task and broadcast.
    """
    files = spark.read.schema(SEGMENTS).parquet(folder)
    totals = files.groupBy("part").agg(F.sum("n_ids").alias("n"))
    bases = totals.selectExpr("part", "sum(n) over (order by part rows between unbounded preceding and current row) - n as base")
    placed = files.join(F.broadcast(bases), "part").select((F.col("base") + F.col("part_start")).alias("at"), "doc_ids", "counts", "payload")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            for k in range(batch.num_rows):
                row = batch.slice(k, 1).to_pylist()[0]
                raw, counts = unpack(row["payload"]).astype("<u4").tobytes(), np.array(row["counts"], np.int64)
                ends = np.cumsum(counts)
                starts = ends - counts
                sums = [zlib.crc32(raw[4 * a : 4 * b]) for a, b in zip(starts.tolist(), ends.tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(row["doc_ids"], pa.int64()), pa.array(row["at"] + starts), pa.array(counts), pa.array(sums, pa.int64())], names=["doc_id", "start", "n_tokens", "ids_crc32"])

    return placed.mapInArrow(run, "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint")


def written_and_read(frame: DataFrame, path: str, end_id: int) -> DataFrame:
    """Writes the files in the shared folder and returns what read gives of them.

    Null and empty texts have the end id alone; equal rows each have their own ids; no documents give no rows.
    """
    space = Workspace(frame.sparkSession, "token-files")
    folder = f"{space.root}/files"
    write(frame, folder, path, end_id)
    return read(frame.sparkSession, folder)
