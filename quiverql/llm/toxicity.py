"""Toxicity: a linear-chain conditional random field tags toxic tokens; forward-backward marginals give document scores and spans.

Labels are of documents, so training tokens are labelled first: a token of a toxic training document is toxic
if one of its features (the word, or a prefix) is found in toxic training documents almost alone; of its other
tokens nothing is known, and the field is fitted with those left open. The field has two states, emissions
that are sums of hashed feature weights, and learned transitions; a document is one chain from its first token
to its last, with a clean token before and after. A document's score is a logistic function of the largest and
the summed marginal of its tokens.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field
from math import lgamma, log

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .base import Workspace, documents, slices

FEATURES, PREFIXES = 1 << 18, (3, 4, 5, 6, 7, 8)
#: Tokens that are gone through one after the other; the parts of a chain are computed side by side and then joined, exactly.
STEPS = 64
#: Labelled documents that the model is fitted on at most, of either label, and their characters in all; the last of these is taken whole.
TOXIC, CLEAN, CHARACTERS = 1000, 2000, 24_000_000
#: Words whose emission a worker remembers; a full table is emptied.
MEMO = 200_000
EDGE = re.compile(r"^[\W_]+|[\W_]+$")
TOKEN = re.compile(r"\S+")


def features(token: str) -> list[int]:
    """Cells of the word and its prefixes (in bytes); the same number for every token."""
    word = (token if token.isalpha() else EDGE.sub("", token)).lower().encode("utf-8", "surrogatepass")
    return [zlib.crc32(word[:k], k) % FEATURES for k in PREFIXES] + [zlib.crc32(word, 1) % FEATURES]


@dataclass
class Field:
    weights: np.ndarray = field(default_factory=lambda: np.zeros(FEATURES))
    bias: float = -6.0
    moves: np.ndarray = field(default_factory=lambda: np.zeros((2, 2)))  # log scores of state to state
    logistic: np.ndarray = field(default_factory=lambda: np.array([-3.0, 0.0, 0.0]))


def dealt(flat: np.ndarray, sizes: np.ndarray, fill: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Chains as columns of STEPS tokens, no column of two chains, the place of each token, and each chain's columns."""
    columns = -(-sizes // STEPS)
    start = (np.cumsum(columns) - columns) * STEPS
    place = np.repeat(start - (np.cumsum(sizes) - sizes), sizes) + np.arange(len(flat))
    grid = np.full(int(columns.sum()) * STEPS, fill)
    grid[place] = flat
    return np.ascontiguousarray(grid.reshape(-1, STEPS).T), place, columns


def edges(grid: np.ndarray, columns: np.ndarray, t: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Toxic over clean before each column (forward) and after it (backward), given all of its chain to that side."""
    into, onto = np.zeros(grid.shape[1]), np.full(grid.shape[1], t[1, 0] / t[0, 0])
    if not len(columns) or columns.max() < 2:
        return into, onto
    # how each column takes either state before it to either state at its end
    clean, toxic = np.repeat([[1.0], [0.0]], grid.shape[1], axis=1), np.repeat([[0.0], [1.0]], grid.shape[1], axis=1)
    for k, x in enumerate(grid):
        clean, toxic = clean * t[0, 0] + toxic * t[1, 0], x * (clean * t[0, 1] + toxic * t[1, 1])
        if k % 4 == 3:
            scale = np.maximum(clean, toxic).max(axis=0)
            clean, toxic = clean / scale, toxic / scale
    first = np.cumsum(columns) - columns
    for k in range(1, columns.max()):
        at = first[columns > k] + k
        before = into[at - 1]
        into[at] = (toxic[0, at - 1] + before * toxic[1, at - 1]) / (clean[0, at - 1] + before * clean[1, at - 1])
        at = (first + columns)[columns > k] - 1 - k
        after = onto[at + 1]
        onto[at] = (clean[1, at + 1] + toxic[1, at + 1] * after) / (clean[0, at + 1] + toxic[0, at + 1] * after)
    return into, onto


def ratios(emissions: np.ndarray, sizes: np.ndarray, moves: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each token of chains side by side its emission factor, and forward and backward messages as toxic over clean."""
    t, x = np.exp(moves), np.exp(np.clip(emissions, -30, 30))
    grid, place, columns = dealt(x, sizes, 0.0)
    forward, backward = np.empty_like(grid), np.empty_like(grid)
    last, after = edges(grid, columns, t)
    for k in range(STEPS):
        last = grid[k] * (t[0, 1] + last * t[1, 1]) / (t[0, 0] + last * t[1, 0])
        forward[k] = last
    for k in range(STEPS - 1, -1, -1):
        backward[k] = after
        y = grid[k] * after
        after = (t[1, 0] + t[1, 1] * y) / (t[0, 0] + t[0, 1] * y)
    return x, forward.T.reshape(-1)[place], backward.T.reshape(-1)[place]


def marginals(emissions: np.ndarray, sizes: np.ndarray, moves: np.ndarray) -> np.ndarray:
    """The probability that each token is toxic."""
    _, forward, backward = ratios(emissions, sizes, moves)
    odds = forward * backward
    return odds / (1 + odds)


def expected(emissions: np.ndarray, sizes: np.ndarray, moves: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The marginals, and how often each state is expected to follow each, with the clean ones around every chain."""
    x, forward, backward = ratios(emissions, sizes, moves)
    odds, t, ends = forward * backward, np.exp(moves), np.cumsum(sizes)[sizes > 0] - 1
    left = np.concatenate([[0.0], forward[:-1]])
    left[ends[:-1] + 1] = 0.0
    # every token after its predecessor, and the clean one after the last
    left, right = np.concatenate([left, forward[ends]]), np.concatenate([x * backward, np.zeros(len(ends))])
    total = t[0, 0] + t[0, 1] * right + t[1, 0] * left + t[1, 1] * left * right
    counts = np.array([[(t[0, 0] / total).sum(), (t[0, 1] * right / total).sum()], [(t[1, 0] * left / total).sum(), (t[1, 1] * left * right / total).sum()]])
    return odds / (1 + odds), counts


def pooled(chance: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Largest and log of one plus the summed marginal of each document."""
    out, full = np.zeros((len(sizes), 2)), sizes > 0
    if full.any():
        first = (np.cumsum(sizes) - sizes)[full]
        out[full, 0], out[full, 1] = np.maximum.reduceat(chance, first), np.log1p(np.add.reduceat(chance, first))
    return out


def apart(texts: list[str]) -> list[int]:
    """Places of texts that aren't copies of earlier ones, nearly: no least five-word shingle by one of three hashes was seen before."""
    seen, keep = set(), []
    for at, text in enumerate(texts):
        words = text.encode("utf-8", "surrogatepass").split()
        shingles = [b" ".join(words[k : k + 5]) for k in range(max(1, len(words) - 4))]
        least = {(salt, min(zlib.crc32(s, salt) for s in shingles)) for salt in (1, 2, 3)}
        if not least & seen:
            keep.append(at)
        seen |= least
    return keep


def telling(docs: list[np.ndarray], toxic: np.ndarray, table: np.ndarray) -> np.ndarray:
    """Whether each feature stands in toxic documents so nearly alone that chance would hardly give one such feature among all."""
    found, share = np.zeros((2, FEATURES), np.int64), float(toxic.mean())
    for own, flag in zip(docs, toxic, strict=True):
        found[int(flag), np.unique(table[np.unique(own)])] += 1
    good, bad = found
    out, all_of = np.zeros(FEATURES, bool), log(int((found.sum(axis=0) > 0).sum()) / 0.005)
    for c in np.flatnonzero((bad > 0) & (bad >= 9 * good)).tolist():
        k, g = int(bad[c]), int(good[c])
        out[c] = k * log(1 / share) - (lgamma(k + g + 1) - lgamma(k + 1) - lgamma(g + 1)) > all_of
    return out


def logistic(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Weights of a ridge logistic regression, by Newton steps that are halved while they don't help."""
    ridge = np.diag([0.01] + [0.5] * (x.shape[1] - 1))

    def loss(beta: np.ndarray) -> float:
        z = x @ beta
        return float(np.logaddexp(0, z).sum() - y @ z + beta @ ridge @ beta / 2)

    beta = np.zeros(x.shape[1])
    for _ in range(50):
        p = chances(x, beta)
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + ridge, x.T @ (y - p) - ridge @ beta)
        while loss(beta + step) > loss(beta) and np.abs(step).max() > 1e-9:
            step = step / 2
        beta = beta + step
        if np.abs(step).max() < 1e-6:
            break
    return beta


def chances(x: np.ndarray, beta: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))


def fit(texts: list[str], toxic: np.ndarray, share: float, rounds: int = 30) -> Field:
    """The field of labelled documents; share: of toxic ones among all, of which the texts may be a sample by label.

    The slope of the log likelihood is what is expected with known tokens held to their label, less what is
    expected without. Known are the tokens of clean documents and the telling ones of toxic documents.
    """
    out, keep = Field(), apart(texts)
    texts, toxic = [texts[k] for k in keep], np.asarray(toxic, np.int64)[keep]
    if not len(texts) or not toxic.any() or toxic.all():
        return out
    # words become numbers at once; the driver holds no list of tokens
    nth: dict[str, int] = {}
    docs = [np.array([nth.setdefault(w, len(nth)) for w in t.split()], np.int32) for t in texts]
    if not nth:
        return out
    table = np.array([features(w) for w in nth], np.int32)
    words = len(nth)
    del nth
    tells = telling(docs, toxic, table)[table].any(axis=1)
    sizes, word = np.array([len(own) for own in docs], np.int64), np.concatenate(docs)
    open_ = np.repeat(toxic > 0, sizes) & ~tells[word]
    held = np.where(np.repeat(toxic > 0, sizes), 30.0, -30.0)
    steps = {"weights": np.full(FEATURES, 1e-8), "bias": 1e-8, "moves": np.full((2, 2), 1e-8)}

    def climb(name: str, value, slope):
        steps[name] = steps[name] + slope * slope
        return value + 0.5 * slope / np.sqrt(steps[name])

    for _ in range(rounds):
        emission = (out.weights[table].sum(axis=1) + out.bias)[word]
        free, moved = expected(emission, sizes, out.moves)
        known, truly = expected(np.where(open_, emission, held), sizes, out.moves)
        flat = known - free
        by_word = np.bincount(word, flat, words)
        slope = np.bincount(table.ravel(), np.repeat(by_word, table.shape[1]), FEATURES) - 0.05 * out.weights
        out.weights, out.bias = climb("weights", out.weights, slope), climb("bias", out.bias, flat.sum())
        out.moves = np.clip(climb("moves", out.moves, truly - moved - out.moves), -8, 8)
    emission = out.weights[table].sum(axis=1) + out.bias
    out.logistic = logistic(np.column_stack([np.ones(len(texts)), pooled(marginals(emission[word], sizes, out.moves), sizes)]), toxic)
    own = toxic.mean()
    out.logistic[0] += log(share / (1 - share)) - log(own / (1 - own)) if 0 < share < 1 else 0
    return out


def training(frame: DataFrame, labels: DataFrame, fold: int = 5) -> tuple[list[str], np.ndarray, float]:
    """Labelled texts outside the held-out fold, their labels, and the share of toxic ones there.

    At most TOXIC and CLEAN documents, those with the lowest hash of doc_id, as long as the ones before have
    fewer than CHARACTERS in all; each is taken whole. Of contradictory labels of one doc_id toxic counts, of
    several texts the one with the least MD5; a null text is an empty one.
    """
    usable = labels.where(F.col("toxic").isin(0, 1) & (F.crc32(F.col("doc_id").cast("string").cast("binary")) % fold != 0)).groupBy(F.col("doc_id").cast("bigint").alias("doc_id")).agg(F.max("toxic").alias("toxic"))
    n = {row[0]: row[1] for row in usable.groupBy("toxic").count().collect()}
    order = ["hashed", "doc_id"]
    usable = usable.withColumn("hashed", F.xxhash64("doc_id"))
    chosen = [usable.where(F.col("toxic") == k).orderBy(*order).limit(bound) for k, bound in ((1, TOXIC), (0, CLEAN))]
    texts = documents(frame).withColumn("text", F.coalesce("text", F.lit(""))).join(F.broadcast(chosen[0].union(chosen[1])), "doc_id")
    texts = texts.groupBy("doc_id", "toxic", "hashed").agg(F.min_by("text", F.md5("text")).alias("text")).withColumn("n", F.length("text"))
    space = Workspace(frame.sparkSession, "toxicity")
    texts = space.save(texts, "training")
    before = F.sum("n").over(Window.orderBy(*order).rowsBetween(Window.unboundedPreceding, -1))
    sizes = texts.select("doc_id", "hashed", "n").withColumn("before", F.coalesce(before, F.lit(0))).where(F.col("before") < CHARACTERS).select("doc_id")
    rows = texts.join(F.broadcast(sizes), "doc_id").select("doc_id", "text", "toxic").collect()
    space.drop()
    rows.sort()
    return [r.text for r in rows], np.array([r.toxic for r in rows]), n.get(1, 0) / max(1, sum(n.values()))


class Tagger:
    def __init__(self, model: Field):
        self.model, self.known = model, {}

    def emissions(self, words: list[str]) -> np.ndarray:
        known = self.known
        if len(known) > MEMO:
            known.clear()
        if new := list(set(words).difference(known)):
            known.update(zip(new, (self.model.weights[np.array([features(w) for w in new])].sum(axis=1) + self.model.bias).tolist(), strict=True))
        return np.fromiter(map(known.__getitem__, words), float, len(words))

    def tag(self, texts: list[str | None], at_least: float = 0.5) -> tuple[np.ndarray, list[list[dict]]]:
        """Scores, and of each text the spans of code points (end excluded) whose tokens are toxic with at least that probability."""
        split = [(t or "").split() for t in texts]
        sizes = np.array([len(w) for w in split], np.int64)
        chance = marginals(self.emissions([w for own in split for w in own]), sizes, self.model.moves)
        x = np.column_stack([np.ones(len(texts)), pooled(chance, sizes)])
        spans: list[list[dict]] = [[] for _ in texts]
        first = np.cumsum(sizes) - sizes
        for k in np.flatnonzero(x[:, 1] >= at_least):
            own = chance[first[k] : first[k] + sizes[k]]
            # the tokens of split() are the runs without white space
            for token, p in zip(TOKEN.finditer(texts[k]), own, strict=False):
                if p >= at_least:
                    spans[k].append({"start": token.start(), "end": token.end(), "chance": float(p)})
        return chances(x, self.model.logistic), spans


def scored(frame: DataFrame, labels: DataFrame, fold: int = 5) -> DataFrame:
    """doc_id, held_out, score, predicted and spans of every whole text.

    The model is small (FEATURES weights) and goes with the tasks; texts aren't moved, and each is one chain,
    however long. Null and empty texts get the score of no toxic token; without labels of both kinds every text
    does. Repeated rows get equal scores; a null doc_id is not held out; no documents give no rows.
    """
    texts, toxic, share = training(frame, labels, fold)
    model = fit(texts, toxic, share)
    model.weights = model.weights.astype(np.float32)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tagger = Tagger(model)
        for batch in slices(batches):
            score, spans = tagger.tag(batch.column("text").to_pylist())
            columns = [batch.column("doc_id"), batch.column("held_out"), pa.array(score), pa.array((score >= 0.5).astype(np.int32)), pa.array(spans, SPANS)]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "held_out", "score", "predicted", "spans"])

    held = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % fold == 0, F.lit(False))
    return documents(frame).withColumn("held_out", held).mapInArrow(run, "doc_id bigint, held_out boolean, score double, predicted int, spans array<struct<start: int, end: int, chance: double>>")


SPANS = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("chance", pa.float64())]))
