"""Quality classifier by importance resampling: the ratio of hashed n-gram models of target and raw text, sampled by Gumbel top-k.

A document's importance weight is the ratio of two generative models of it, target over raw: hashed n-grams of
one and two words, whose overlapping orders count as one reading of the text. The k documents with the highest log weight plus standard Gumbel noise are a sample of k
without replacement by weight. k is a share of the corpus: a parameter, or else the share of quality 1 among
the labelled documents.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import hashed_ngrams
from .base import Workspace, documents, slices
from .hashed_ngrams import UNIT, WORD_ORDERS, Words

#: Keys are compared as whole numbers of this part.
PART = 10**6


def noise(doc_id: int | None, text: str, seed: str) -> float:
    """Standard Gumbel noise that depends on the row's id and text alone."""
    raw = hashlib.blake2b(text.encode("utf-8", "surrogatepass"), digest_size=7, key=f"{seed}:{doc_id}".encode()[:64]).digest()
    u = (int.from_bytes(raw, "little") + 0.5) / 2**56
    return -np.log(-np.log(u))


def log_weights(texts: list[str | None], model: np.ndarray, known: Words) -> np.ndarray:
    """Log of the importance weights; 0 for null and empty texts."""
    return known.totals(texts, model) / WORD_ORDERS / UNIT


def keys(doc_ids: list, texts: list, model: np.ndarray, known: Words, seed: str) -> tuple[np.ndarray, list[int | None]]:
    """Log weights and sampling keys; null and empty texts have no key."""
    weight = log_weights(texts, model, known)
    return weight, [int(round((w + noise(d, t, seed)) * PART)) if t else None for d, t, w in zip(doc_ids, texts, weight.tolist(), strict=True)]


@dataclass
class Resampler:
    model: np.ndarray
    lowest: int | None
    seed: str


def scored(frame: DataFrame, model: np.ndarray, seed: str) -> DataFrame:
    """doc_id, log_weight and sample_key of every row."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Words()
        for batch in slices(batches):
            weight, key = keys(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), model, known, seed)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(weight), pa.array(key, pa.int64())], names=["doc_id", "log_weight", "sample_key"])

    return documents(frame).mapInArrow(run, "doc_id bigint, log_weight double, sample_key bigint")


def highest(frame: DataFrame, column: str, k: int, cells: int = 4096) -> int | None:
    """The k-th highest value of a column of whole numbers, the least if there are fewer, by counting ever narrower ranges; at most cells rows come to the driver at a time."""
    low, high = frame.agg(F.min(column), F.max(column)).first()
    if low is None or k < 1:
        return None
    while low < high:
        width = (high - low) // cells + 1
        rows = frame.where(F.col(column).between(low, high)).groupBy(F.expr(f"({column} - ({low})) div {width}").alias("cell")).count().collect()
        for cell, n in sorted(rows, reverse=True):
            if n >= k:
                low, high = low + cell * width, min(high, low + cell * width + width - 1)
                break
            k -= n
        else:
            return low
    return low


def good_share(frame: DataFrame, labels: DataFrame) -> float:
    """The share of quality 1 among the documents with a label of quality 0 or 1; 1 if there are none. Of contradictory labels the better counts."""
    known = labels.where("quality in (0, 1)").groupBy(F.col("doc_id").cast("bigint").alias("doc_id")).agg(F.max("quality").alias("quality"))
    share = frame.select(F.col("doc_id").cast("bigint").alias("doc_id")).distinct().join(known, "doc_id").agg(F.avg("quality")).first()[0]
    return 1.0 if share is None else share


def fit(frame: DataFrame, labels: DataFrame, share: float | None = None, seed: str = "resample") -> tuple[Resampler, DataFrame]:
    """The resampler of these documents and their scores (a written table)."""
    model = hashed_ngrams.fitted(frame, labels, words=True)
    saved = Workspace(frame.sparkSession, "resampling").save(scored(frame, model, seed), "scores")
    k = round((good_share(frame, labels) if share is None else share) * saved.count())
    return Resampler(model, highest(saved, "sample_key", k), seed), saved


def resample(frame: DataFrame, labels: DataFrame, share: float | None = None, seed: str = "resample") -> DataFrame:
    """doc_id, log_weight, sample_key and kept of every row.

    k is share (by default that of quality 1 among labelled documents) of all rows. Null and empty texts say
    nothing of themselves: their log weight is 0, they have no key and are not kept. Rows with equal id and
    text have equal keys; equal keys at the edge all stay. Without trusted documents the ratio is 1 for all,
    and with no labels at all every text stays. No documents give no rows.
    """
    found, saved = fit(frame, labels, share, seed)
    stays = F.lit(False) if found.lowest is None else F.coalesce(F.col("sample_key") >= F.lit(found.lowest), F.lit(False))
    return saved.withColumn("kept", stays)


def kept(frame: DataFrame, labels: DataFrame, share: float | None = None, seed: str = "resample") -> DataFrame:
    """The rows that resample keeps, with all their columns; rows are judged again where they are, so texts aren't moved."""
    found, _ = fit(frame, labels, share, seed)
    model, lowest = found.model, found.lowest

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Words()
        for batch in slices(batches):
            _, key = keys(batch.column("doc_id").cast(pa.int64()).to_pylist(), batch.column("text").to_pylist(), model, known, seed)
            yield batch.filter(pa.array([k is not None and lowest is not None and k >= lowest for k in key], pa.bool_()))

    return frame.mapInArrow(run, frame.schema)
