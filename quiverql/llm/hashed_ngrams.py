"""Hashed n-gram multinomials of a target and a raw corpus, counted over all documents.

The n-grams are those of 1 to ORDER neighbouring bytes of a text's UTF-8, or on request of 1 and 2 neighbouring
words, hashed into one table of CELLS cells; they need no word list and hold for every language. A model is one
whole number for each cell: the log of the target's over the raw corpus' probability, in UNITs, so that sums
agree however texts are batched.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .base import documents, slices, with_key_among

ORDER, CELLS, UNIT = 3, 1 << 16, 1 << 20
#: Ids of trusted documents that are broadcast at most, so that no texts move; if there are more, or with None, the trusted texts move. The target model is counted on all of them either way.
TRUSTED = 1_000_000
#: Orders of the n-grams of words.
WORD_ORDERS = 2
#: Words whose hash a worker remembers; a full table is emptied.
MEMO = 200_000


def spread(joined: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """For each n the cells of the n-grams that start at each byte (those that reach over the end are left out)."""
    code = np.zeros(len(joined), np.uint64)
    for n in range(1, ORDER + 1):
        code = (code[: max(0, len(joined) - n + 1)] << np.uint64(8)) | joined[n - 1 :]
        yield n, (((code + np.uint64(n << 40)) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(48)).astype(np.int32)


def chunks(texts: list[str | None], size: int = 1 << 20) -> Iterator[tuple[list[int], np.ndarray, np.ndarray]]:
    """Texts side by side, about size bytes at a time: their places in the list, their sizes and the bytes."""
    raw, own, held = [], [], 0
    for at, text in enumerate(texts):
        raw.append((text or "").encode("utf-8", "surrogatepass"))
        own.append(at)
        held += len(raw[-1])
        if held >= size or at == len(texts) - 1:
            yield own, np.array([len(b) for b in raw], np.int64), np.frombuffer(b"".join(raw), np.uint8)
            raw, own, held = [], [], 0


def totals(texts: list[str | None], model: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The sum of the model over a text's n-grams and their number, for each text."""
    total, count = np.zeros(len(texts), np.int64), np.zeros(len(texts), np.int64)
    for own, sizes, joined in chunks(texts):
        ends = np.cumsum(sizes)
        for n, at in spread(joined):
            sums = np.concatenate([[0], np.cumsum(model[at])])
            first = np.minimum(ends - sizes, len(sums) - 1)
            last = np.maximum(first, np.minimum(ends - n + 1, len(sums) - 1))
            total[own] += sums[last] - sums[first]
            count[own] += np.maximum(0, sizes - n + 1)
    return total, count


def means(texts: list[str | None], model: np.ndarray) -> np.ndarray:
    """The mean log ratio of an n-gram, 0 for empty texts."""
    total, count = totals(texts, model)
    return total / np.maximum(count, 1) / UNIT


class Words(dict):
    """Hashes of words; a full table is emptied, which costs time and changes nothing."""

    def __missing__(self, word: bytes) -> int:
        out = self[word] = xxhash.xxh3_64_intdigest(word)
        return out

    def cells(self, text: str | None) -> np.ndarray:
        """The cells of a text's words and of its pairs of neighbouring words."""
        if len(self) > MEMO:
            self.clear()
        words = (text or "").encode("utf-8", "surrogatepass").split()
        one = np.fromiter(map(self.__getitem__, words), np.uint64, len(words))
        two = one[:-1] * np.uint64(0x100000001B3) ^ (one[1:] + np.uint64(WORD_ORDERS))
        return ((np.concatenate([one, two]) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(48)).astype(np.int32)

    def totals(self, texts: list[str | None], model: np.ndarray) -> np.ndarray:
        """The sum of the model over a text's n-grams of words, for each text."""
        return np.array([model[self.cells(t)].sum() for t in texts], np.int64)


def word_counts(texts: list[str | None], known: Words, size: int = 1 << 18) -> np.ndarray:
    """How often the n-grams of words of these texts fall into each cell; short texts are counted together, about size n-grams at a time."""
    found, held, n = np.zeros(CELLS, np.int64), [], 0
    for at, text in enumerate(texts):
        held.append(known.cells(text))
        n += len(held[-1])
        if n >= size or at == len(texts) - 1:
            found += np.bincount(np.concatenate(held), minlength=CELLS)
            held, n = [], 0
    return found


def byte_counts(texts: list[str | None]) -> np.ndarray:
    """How often the n-grams of bytes of these texts fall into each cell."""
    found = np.zeros(CELLS, np.int64)
    for _, sizes, joined in chunks(texts):
        ends, alive = np.cumsum(sizes), np.ones(len(joined) + 1, bool)
        for n, at in spread(joined):
            if n > 1:
                alive[(ends - n + 1)[sizes >= n - 1]] = False
            found += np.bincount(at[alive[: len(at)]], minlength=CELLS)
    return found


def counted(frame: DataFrame, words: bool = False) -> DataFrame:
    """cell, raw and target: n-grams in all texts and in those with trusted = true. A task sends each cell once at most.

    With words, the n-grams are those of words.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        raw, target, known = np.zeros(CELLS, np.int64), np.zeros(CELLS, np.int64), Words()
        for batch in slices(batches):
            texts, trusted = batch.column("text").to_pylist(), batch.column("trusted").to_pylist()
            for flag in (True, False):
                mine = [t for t, own in zip(texts, trusted, strict=True) if own is flag]
                found = word_counts(mine, known) if words else byte_counts(mine)
                raw += found
                if flag:
                    target += found
        at = np.flatnonzero(raw)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(raw[at]), pa.array(target[at])], names=["cell", "raw", "target"])

    parts = frame.select("text", "trusted").mapInArrow(run, "cell int, raw bigint, target bigint")
    return parts.groupBy("cell").agg(F.sum("raw").alias("raw"), F.sum("target").alias("target"))


def good_ids(labels: DataFrame) -> DataFrame:
    return labels.where("quality = 1").select(F.col("doc_id").cast("bigint").alias("good_id")).where("good_id is not null").distinct()


def with_trust(frame: DataFrame, labels: DataFrame, bound: int | None = None) -> DataFrame:
    """text and trusted: whether a label of the document has quality 1; the ids that have, or bound of those that are there, with the lowest hash, are broadcast, and the texts stay where they are."""
    good = good_ids(labels)
    if bound is not None:
        there = documents(frame).select(F.col("doc_id").alias("good_id"))
        good = good.join(there, "good_id", "left_semi").orderBy(F.xxhash64("good_id"), "good_id").limit(bound)
    good = F.broadcast(good)
    return documents(frame).join(good, F.col("doc_id") == F.col("good_id"), "left").select("text", F.col("good_id").isNotNull().alias("trusted"))


def trusted(frame: DataFrame, labels: DataFrame) -> DataFrame:
    """text of all documents with a label of quality 1. Hardly any other texts move."""
    return with_key_among(documents(frame), "doc_id", good_ids(labels).withColumnRenamed("good_id", "doc_id")).select("text")


def log_ratio(target: np.ndarray, raw: np.ndarray, smooth: float) -> np.ndarray:
    """The log ratio of two multinomials in UNITs.

    Both counts of a cell are joined by smooth target counts and the raw counts they stand for, so cells that
    are rare in both say nothing.
    """
    if not target.sum():
        return np.zeros(len(target), np.int64)
    share = target.sum() / raw.sum()
    ratio = np.log((target + smooth) / (raw * share + smooth))
    return np.round((ratio - np.log((target.sum() + smooth * len(target)) / (raw.sum() * share + smooth * len(target)))) * UNIT).astype(np.int64)


def fitted(frame: DataFrame, labels: DataFrame, bound: int | None = TRUSTED, words: bool = False, smooth: float = 50.0) -> np.ndarray:
    """The model, counted on all documents and on all trusted ones; with words that of n-grams of words. More trusted ids than bound (None: any) aren't broadcast.

    To the driver come as many rows as there are cells; without trusted texts the model is zero.
    """
    raw, target = np.zeros(CELLS), np.zeros(CELLS)
    if bound is None or good_ids(labels).limit(bound + 1).count() > bound:
        flagged = lambda texts, flag: counted(texts.select("text", F.lit(flag).alias("trusted")), words)
        for cell, n, _ in flagged(documents(frame), False).collect():
            raw[cell] = n
        for cell, n, _ in flagged(trusted(frame, labels), True).collect():
            target[cell] = n
    else:
        for cell, n, m in counted(with_trust(frame, labels), words).collect():
            raw[cell], target[cell] = n, m
    return log_ratio(target, raw, smooth)
