"""Substring dedup: windows of words that repeat at one length alone are extended to twice that length, until none is left.

A level's table has, for each document, the windows of that length that stand in other documents too. Two of
them that meet end to end are a window of twice the length, whose hash comes from theirs, so only the first
levels read texts. The level before the asked length is sampled without loss: of the shorter windows within a
window of that length the one with the least hash is its anchor, and equal windows have equal anchors.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .base import Workspace, likely_among, salted_join, slices

WINDOW = 13
#: Ids that are null come before all others.
LEAST_ID = -(2**63)
#: Bytes of a text that are hashed at a time, up to the next blank.
CHUNK = 1 << 20
EMPTY = hashlib.sha256(b"").hexdigest()

U = np.uint64
BASE, BACK = U(0x9E3779B97F4A7C15), U(pow(0x9E3779B97F4A7C15, -1, 2**64))
BYTES = np.random.Generator(np.random.PCG64(13)).integers(1, 2**63, 256, np.uint64)
BLANK = np.zeros(256, bool)
BLANK[[0x20, *range(0x09, 0x0E)]] = True
SEED = U(0xD6E8FEB86659FD93)


def mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> U(30))) * U(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> U(27))) * U(0x94D049BB133111EB)
    return h ^ (h >> U(31))


def joined(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The hash of two windows that follow, or overlap, one another."""
    return mixed(a * SEED + ((b << U(23)) | (b >> U(41))))


def grown(h: np.ndarray, have: int, want: int) -> np.ndarray:
    """Hashes of windows of want words from those of have words, doubled and then overlapped."""
    while have < want:
        step = min(have, want - have)
        h, have = joined(h[:-step] if step < len(h) else h[:0], h[step:]), have + step
    return h


_powers = [np.ones(1, U), np.ones(1, U)]


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers[0]) < n:
        size = max(n, 2 * CHUNK)
        for k, base in enumerate((BASE, BACK)):
            out = np.full(size, base, U)
            out[0] = 1
            _powers[k] = np.multiply.accumulate(out)
    return _powers[0][:n], _powers[1][:n]


def word_hashes(raw: bytes) -> np.ndarray:
    """A hash of 64 bits for each word of a text."""
    if len(raw) <= CHUNK:
        return _hashes(np.frombuffer(raw, np.uint8))
    whole, out, low = np.frombuffer(raw, np.uint8), [], 0
    while low < len(whole):
        high = low + CHUNK
        while high < len(whole) and not len(next_blank := np.flatnonzero(BLANK[whole[high : high + CHUNK]])):
            high += CHUNK
        high = len(whole) if high >= len(whole) else high + int(next_blank[0])
        out.append(_hashes(whole[low:high]))
        low = high
    return np.concatenate(out)


def _hashes(text: np.ndarray) -> np.ndarray:
    if not len(text):
        return np.empty(0, U)
    inside = np.concatenate([[False], ~BLANK[text], [False]])
    edges = np.flatnonzero(inside[1:] != inside[:-1])
    starts, ends = edges[::2], edges[1::2]
    up, down = powers(len(text))
    sums = np.concatenate([np.zeros(1, U), np.cumsum(BYTES[text] * up)])
    return mixed((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(U))


def anchors(words: np.ndarray, window: int) -> np.ndarray:
    """For each window its anchor: the least hash of the windows of half its length, rounded up, within it."""
    half = (window + 1) // 2
    n = len(words) - window + 1
    if n <= 0:
        return np.empty(0, U)
    h = grown(words, 1, half)
    out = h[:n]
    for k in range(1, window - half + 1):
        out = np.minimum(out, h[k : k + n])
    return out


def lists(values: np.ndarray, counts: list[int], type_: pa.DataType) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(counts, dtype=np.int64)]).astype(np.int32)), pa.array(values, type_))


def together(parts: list[np.ndarray], dtype: type) -> np.ndarray:
    return np.concatenate(parts).astype(dtype) if parts else np.empty(0, dtype)


def texts(frame: DataFrame) -> DataFrame:
    """doc_id, text and what tells documents apart: oid orders them, rid has the text in it too."""
    doc, text = F.col("doc_id").cast("bigint"), F.col("text").cast("string")
    return frame.select(doc.alias("doc_id"), F.coalesce(doc, F.lit(LEAST_ID)).alias("oid"), F.xxhash64(doc, text).alias("rid"), F.coalesce(text, F.lit("")).cast("binary").alias("text"))


def read_once(rows: DataFrame, window: int) -> DataFrame:
    """Every row's number of words, the SHA-256 of its words joined by single blanks, and its distinct anchors."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            n, sha, found = [], [], []
            for raw in batch.column("text").to_pylist():
                hashes = word_hashes(raw)
                n.append(len(hashes))
                sha.append(hashlib.sha256(b" ".join(raw.split())).hexdigest())
                found.append(np.unique(anchors(hashes, window)))
            columns = [*(batch.column(c) for c in ("doc_id", "oid", "rid")), pa.array(n, pa.int64()), pa.array(sha, pa.string()), lists(together(found, U).view(np.int64), [len(f) for f in found], pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "oid", "rid", "n_words", "sha", "anchors"])

    return rows.mapInArrow(run, "doc_id bigint, oid bigint, rid bigint, n_words bigint, sha string, anchors array<bigint>")


WINDOWS = "oid bigint, sub bigint, w array<struct<start: int, h: bigint>>"


def windows_of(starts: np.ndarray, hashes: np.ndarray, counts: list[int]) -> pa.ListArray:
    """w: the windows of each text."""
    own = pa.StructArray.from_arrays([pa.array(starts, pa.int32()), pa.array(hashes.view(np.int64), pa.int64())], names=["start", "h"])
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(counts, dtype=np.int64)]).astype(np.int32)), own)


def candidates(rows: DataFrame, window: int) -> DataFrame:
    """The windows of each text whose anchor stands in another text too."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            starts, hashes = [], []
            for raw, wanted in zip(batch.column("text").to_pylist(), batch.column("anchors"), strict=True):
                words = word_hashes(raw)
                at = np.flatnonzero(np.isin(anchors(words, window), wanted.values.to_numpy().view(U)))
                starts.append(at)
                hashes.append(grown(words, 1, window)[at])
            counts = [len(s) for s in starts]
            yield pa.RecordBatch.from_arrays([batch.column("oid"), batch.column("sub"), windows_of(together(starts, np.int32), together(hashes, U), counts)], names=["oid", "sub", "w"])

    return rows.mapInArrow(run, WINDOWS)


LEVEL = "oid bigint, sub bigint, removed array<int>, w array<struct<start: int, h: bigint>>"


def doubled(hits: DataFrame, length: int) -> DataFrame:
    """One row for each document with hits: the starts of those to remove, and its windows of twice the length, made of two hits end to end.

    hits are sorted by id, one number; a task holds the documents of one id and one batch at a time, and orders them itself.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = [np.empty(0, np.int64)] * 4 + [np.empty(0, bool)]
        for batch in batches:
            new = [batch.column(c).to_numpy(zero_copy_only=False) for c in ("oid", "sub", "start", "h", "removed")]
            oid, *_ = rows = [np.concatenate([a, b]) for a, b in zip(held, new, strict=True)]
            if not len(oid):
                continue
            last = np.flatnonzero(oid != oid[-1])
            upto = int(last[-1]) + 1 if len(last) else 0
            held = [c[upto:] for c in rows]
            if upto:
                yield level(*(c[:upto] for c in rows))
        if len(held[0]):
            yield level(*held)

    def level(oid: np.ndarray, sub: np.ndarray, start: np.ndarray, h: np.ndarray, removed: np.ndarray) -> pa.RecordBatch:
        if sub.any():
            order = np.lexsort((sub, oid))
            oid, sub, start, h, removed = (c[order] for c in (oid, sub, start, h, removed))
        new = np.concatenate([[True], (oid[1:] != oid[:-1]) | (sub[1:] != sub[:-1])])
        heads, row = np.flatnonzero(new), np.cumsum(new) - 1
        key, once = np.unique((row << 32) + start, return_index=True)
        second = np.searchsorted(key, key + length)
        good = (second < len(key)) & (key[np.minimum(second, len(key) - 1)] == key + length)
        a, b, gone = once[good], once[second[good]], once[removed[once]]
        counts = [np.bincount(row[x], minlength=len(heads)) for x in (gone, a)]
        long = joined(h[a].view(U), h[b].view(U))
        columns = [pa.array(oid[heads]), pa.array(sub[heads]), lists(start[gone].astype(np.int32), counts[0], pa.int32()), windows_of(start[a].astype(np.int32), long, counts[1])]
        return pa.RecordBatch.from_arrays(columns, names=["oid", "sub", "removed", "w"])

    return hits.repartition("oid").sortWithinPartitions("oid").mapInArrow(run, LEVEL)


def next_level(windows: DataFrame, space: Workspace, length: int) -> DataFrame:
    """The documents with windows of this length that stand in documents with other ids too; removed: where one has a lesser id. w: their windows of twice the length."""
    flat = windows.select("oid", "sub", F.explode("w").alias("w")).select("oid", "sub", "w.start", "w.h")
    found = space.save(flat.groupBy("h").agg(F.min("oid").alias("first"), F.max("oid").alias("last"), F.count(F.lit(1)).alias("n")).where("first < last").select("h", "first", "n"), f"found-{length}")
    hits = salted_join(flat, found, ["h"], F.xxhash64("oid", "start")).select("oid", "sub", F.col("start").cast("bigint").alias("start"), "h", (F.col("oid") > F.col("first")).alias("removed"))
    out = space.save(doubled(hits, length), f"level-{length}")
    space.drop(found)
    space.tidy()
    return out


def cut(rows: DataFrame, window: int) -> DataFrame:
    """n_removed and kept_sha256 of texts with the starts of the windows to remove."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            removed, sha = [], []
            for raw, starts in zip(batch.column("text").to_pylist(), batch.column("starts"), strict=True):
                words, at = raw.split(), starts.values.to_numpy()
                turns = np.zeros(len(words) + 1, np.int64)
                np.add.at(turns, at, 1)
                np.add.at(turns, at + window, -1)
                gone = np.cumsum(turns[:-1]) > 0
                removed.append(int(gone.sum()))
                sha.append(hashlib.sha256(b" ".join(words[k] for k in np.flatnonzero(~gone))).hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column("oid"), batch.column("rid"), pa.array(removed, pa.int64()), pa.array(sha, pa.string())], names=["oid", "rid", "n_removed", "kept_sha256"])

    return rows.mapInArrow(run, "oid bigint, rid bigint, n_removed bigint, kept_sha256 string")


def with_texts(rows: DataFrame, own: DataFrame) -> DataFrame:
    """The texts of those documents that own has a row for, with its other columns."""
    return likely_among(rows, "rid", own).join(own, ["oid", "rid"])


def deduplicated(frame: DataFrame, window: int = WINDOW) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 and longest of every row.

    A word goes if a window that covers it also starts in a document with a lesser doc_id. longest: words of the
    longest level (window, twice that, and so on) with a window of this document that stands in a document with
    another id too; 0 if there is none.
    A null text has no words; a null id comes before all others; rows of one id remove nothing from one
    another, and equal rows get equal results; no documents give no rows. Exact copies of a text with a lesser id
    go whole, if they have a window, and take no part in the levels, where the first of them stands for all.
    Windows are compared by hashes of 64 bits.
    """
    space, rows = Workspace(frame.sparkSession, "doubling"), texts(frame)
    read = space.save(read_once(rows, window), "read")
    groups = space.save(read.groupBy("sha").agg(F.min("oid").alias("first"), F.max("oid").alias("last"), F.count(F.lit(1)).alias("n")).where("first < last"), "copies")
    whole = space.save(salted_join(read.drop("anchors"), groups, ["sha"], F.col("rid"), "left").withColumn("copy", F.coalesce(F.col("oid") > F.col("first"), F.lit(False)) & (F.col("n_words") >= window)), "whole")

    # copies of one text are no reason to look at it again
    flat = read.select("rid", F.xxhash64("sha").alias("text_id"), F.explode("anchors").alias("anchor"))
    found = space.save(flat.groupBy("anchor").agg(F.min("text_id").alias("low"), F.max("text_id").alias("high"), F.count(F.lit(1)).alias("n")).where("low < high").select("anchor", "n"), "anchors")
    met = salted_join(likely_among(flat.select("rid", "anchor"), "anchor", found), found, ["anchor"], F.col("rid")).groupBy("rid").agg(F.collect_set("anchor").alias("anchors"))
    # texts of one id are told apart by rid, and all others need no second key
    several = whole.groupBy("oid").agg(F.min("rid").alias("low"), F.max("rid").alias("high")).where("low < high").select("oid", F.lit(True).alias("several"))
    own = whole.where(~F.col("copy")).select("oid", "rid").distinct().join(several, "oid", "left").select("oid", "rid", F.when(F.col("several"), F.col("rid")).otherwise(0).cast("bigint").alias("sub"))
    anchored = space.save(own.join(met, "rid"), "anchored")
    space.drop(read)
    space.tidy()
    windows = space.save(candidates(with_texts(rows, anchored), window), "windows")
    known = space.save(anchored.select("oid", "rid", "sub"), "known")
    space.drop(anchored)
    space.tidy()

    length, top, starts, held = window, None, None, windows
    while not windows.isEmpty():
        level = next_level(windows, space, length)
        space.drop(held)
        if length == window:
            starts = space.save(level.where(F.size("removed") > 0).select("oid", "sub", F.col("removed").alias("starts")).join(known, ["oid", "sub"]).select("oid", "rid", "starts"), "starts")
        tall = space.save(level.select("oid", "sub", F.lit(length).cast("bigint").alias("longest")), f"tall-{length}")
        top = tall if top is None else top.unionByName(tall)
        windows, held = level.where(F.size("w") > 0).select("oid", "sub", "w"), level
        length *= 2
    space.drop(held)
    out = whole.withColumns({"n_removed": F.lit(0), "kept_sha256": F.col("sha"), "longest": F.lit(0)}) if top is None else joined_results(whole, top, known, cut(with_texts(rows, starts), window))
    long = (F.col("n_words") >= window) & F.col("first").isNotNull()
    as_copy = F.when(long, F.expr(f"shiftleft({window}L, length(bin(n_words div {window})) - 1)"))
    return out.select(
        "doc_id",
        "n_words",
        F.when(F.col("copy"), F.col("n_words")).otherwise(F.col("n_removed")).cast("bigint").alias("n_removed"),
        F.when(F.col("copy"), F.lit(EMPTY)).otherwise(F.col("kept_sha256")).alias("kept_sha256"),
        F.greatest(F.coalesce(as_copy, F.lit(0)), F.col("longest")).cast("bigint").alias("longest"),
    )


def joined_results(whole: DataFrame, top: DataFrame, known: DataFrame, less: DataFrame) -> DataFrame:
    """whole with n_removed, kept_sha256 and longest."""
    tall = top.groupBy("oid", "sub").agg(F.max("longest").alias("longest")).join(known, ["oid", "sub"]).drop("sub")
    changed = tall.join(less.dropDuplicates(["oid", "rid"]), ["oid", "rid"], "left")
    return whole.join(changed, ["oid", "rid"], "left").withColumns({"n_removed": F.coalesce("n_removed", F.lit(0)), "kept_sha256": F.coalesce("kept_sha256", "sha"), "longest": F.coalesce("longest", F.lit(0))})
