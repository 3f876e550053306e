"""Best-fit packing by exact-complement hashing.

Sequences are planned over the numbers of pieces of each length, never over the pieces: the counts have at
most as many entries as a sequence has tokens, whatever the corpus. Each step of the plan repeats one
combination as often as the counts allow and so uses up one length, which bounds the plan as well. Pieces then
find their place by their length and their rank among pieces of that length.
"""

from __future__ import annotations

import zlib
from bisect import bisect_right
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import bpe
from .base import Workspace, documents, slices


def exact_complements(counts: np.ndarray, cap: int) -> list[tuple[tuple[int, ...], int]]:
    """Combinations of lengths and how often each is used, over all pieces.

    From the longest length down: the gap that it leaves is looked up among single lengths, sums of pairs and
    of triples that are available, and the found combination is consumed. What has no exact complement goes
    best fit, longest first, into sequences of the residual.
    """
    left, plan = counts.astype(np.int64).copy(), []

    def use(lengths: tuple[int, ...]) -> bool:
        need = Counter(lengths)
        times = min(int(left[x]) // n for x, n in need.items())
        if times:
            for x, n in need.items():
                left[x] -= times * n
            plan.append((lengths, times))
        return times > 0

    if left[cap]:
        use((cap,))
    pairs: np.ndarray | None = None
    seen: np.ndarray | None = None
    for first in range(cap - 1, 0, -1):
        while left[first]:
            gap = cap - first
            if left[gap] and use((first, gap)):
                continue
            there = left > 0
            most = np.flatnonzero(there[1:gap] & there[gap - 1 : 0 : -1]) + 1
            if any(use((first, int(b), gap - int(b))) for b in most[most >= gap - most][::-1]):
                continue
            if seen is None or not np.array_equal(seen, there):
                seen = there
                sums = np.fft.irfft(np.fft.rfft(there[: cap + 1], 4 * cap) ** 2, 4 * cap)
                pairs = sums[: cap + 1] > 0.5
            if not any(use((first, int(b), int(c), gap - int(b) - int(c))) for b in np.flatnonzero(there[:gap] & pairs[gap:0:-1])[::-1] for c in pair_of(there, gap - int(b))):
                break
    plan += best_fit(left, cap)
    return plan


def pair_of(there: np.ndarray, total: int) -> np.ndarray:
    """Larger parts of the pairs with that sum, the largest first."""
    most = np.flatnonzero(there[1:total] & there[total - 1 : 0 : -1]) + 1
    return most[most >= total - most][::-1]


def best_fit(left: np.ndarray, cap: int) -> list[tuple[tuple[int, ...], int]]:
    """Longest first; each gap takes the longest length that fits it best, again and again."""
    plan, lengths = [], np.flatnonzero(left).tolist()
    while lengths:
        need, gap = Counter(), cap
        high = len(lengths)
        while gap and (high := min(high, bisect_right(lengths, gap))):
            length = lengths[high - 1]
            fits = min(gap // length, int(left[length]))
            need[length] += fits
            gap -= fits * length
            high -= 1
        times = min(int(left[x]) // n for x, n in need.items())
        for x, n in need.items():
            left[x] -= times * n
            if not left[x]:
                lengths.remove(x)
        plan.append((tuple(need.elements()), times))
    return plan


class Places:
    """Which sequence and offset the piece of a given length and rank has."""

    def __init__(self, plan: list[tuple[tuple[int, ...], int]], cap: int):
        taken, length, rank, sequence, offset, made = [0] * (cap + 1), [], [], [], [], 0
        for lengths, times in plan:
            at = 0
            for x in lengths:
                length.append(x)
                rank.append(taken[x])
                sequence.append(made)
                offset.append(at)
                taken[x] += times
                at += x
            made += times
        order = np.lexsort((rank, length))
        self.key = np.array(length, np.int64)[order] << 48 | np.array(rank, np.int64)[order]
        self.rank, self.sequence, self.offset, self.sequences = np.array(rank, np.int64)[order], np.array(sequence, np.int64)[order], np.array(offset, np.int64)[order], made

    def of(self, length: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        at = np.searchsorted(self.key, length << 48 | rank, side="right") - 1
        return self.sequence[at] + rank - self.rank[at], self.offset[at]


PIECES = "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint, part int, nth bigint"


def pieces(frame: DataFrame, path: str, cap: int, end_id: int) -> DataFrame:
    """Pieces of every whole document (its ids, then end_id), cut only if longer than cap, the rest first; nth counts pieces of a length in a task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made, part, seen = bpe.encoder(path), TaskContext.get().partitionId(), np.zeros(cap + 1, np.int64)
        for batch in slices(batches):
            rows: list[tuple] = []
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), strict=True):
                ids = made.encode(text)
                raw, n = ids.astype("<u4").tobytes() + end_id.to_bytes(4, "little"), len(ids) + 1
                edges = [0, *range(n % cap or cap, n + 1, cap)]
                for k, (a, b) in enumerate(zip(edges, edges[1:], strict=False)):
                    rows.append((doc_id, k, a, b - a, zlib.crc32(raw[4 * a : 4 * b]), int(seen[b - a])))
                    seen[b - a] += 1
            doc_ids, *numbers = zip(*rows, strict=True) if rows else [()] * 6
            columns = [pa.array(doc_ids, pa.int64()), pa.array(numbers[0], pa.int32()), *(pa.array(x, pa.int64()) for x in numbers[1:4]), pa.array([part] * len(rows), pa.int32()), pa.array(numbers[4], pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "piece", "start", "length", "ids_crc32", "part", "nth"])

    return documents(frame).mapInArrow(run, PIECES)


def pack(frame: DataFrame, path: str, cap: int = 2048, end_id: int = 0) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id and offset of every piece.

    A null or empty text is one piece of one id. Equal rows are packed each for itself; no documents give no
    rows. The pieces are written once (some 40 bytes each, no texts); to the driver come at most cap counts.
    """
    space = Workspace(frame.sparkSession, "packing")
    saved = space.save(pieces(frame, path, cap, end_id), "pieces")
    by_part = saved.groupBy("length", "part").agg(F.count(F.lit(1)).alias("n"))
    counts = np.zeros(cap + 1, np.int64)
    for length, n in by_part.groupBy("length").agg(F.sum("n")).collect():  # at most cap rows
        counts[length] = n
    places = Places(exact_complements(counts, cap), cap)
    before = by_part.selectExpr("length", "part", "sum(n) over (partition by length order by part rows between unbounded preceding and current row) - n as before")
    ranked = saved.join(before, ["length", "part"]).select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("before") + F.col("nth")).alias("rank"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            sequence, offset = places.of(batch.column("length").to_numpy(), batch.column("rank").to_numpy())
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in range(5)), pa.array(sequence), pa.array(offset)], names=["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])

    return ranked.mapInArrow(run, "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint, sequence_id bigint, offset bigint")
