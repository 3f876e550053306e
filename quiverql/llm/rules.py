"""Quality rules: simple counts of each text, and the length-normalised log-likelihood ratio of hashed n-grams between trusted texts and the raw corpus, held against one threshold."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from . import hashed_ngrams
from .base import documents, slices

BLANKS, SYMBOLS = b" \t\n\r\v\f", b"#*$%&|<>"
#: Words of a window, the least words of a text, the most of its words (in hundredths) that repeated windows may cover, the least mean log ratio.
WINDOW, FEW, REPEATED, THRESHOLD = 5, 10, 20, -0.25


def counts(text: str | None) -> tuple[int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines and n_repeat_words of a whole text."""
    if not text:
        return 0, 0, 0, 0, 0
    raw = text.encode("utf-8", "surrogatepass")
    words = raw.split()
    lines = [line for line in raw.split(b"\n") if line and not line.isspace()]
    return len(words), len(text) - len(raw) + len(raw.translate(None, BLANKS)), len(raw) - len(raw.translate(None, SYMBOLS)), len(lines) - len(set(lines)), repeated(words)


def repeated(words: list[bytes]) -> int:
    """Words that lie in a window found twice or more."""
    windows = list(zip(*(words[k:] for k in range(WINDOW)), strict=False))
    if len(set(windows)) == len(windows):
        return 0
    seen, covered, end = Counter(windows), 0, 0
    for at, window in enumerate(windows):
        if seen[window] > 1:
            covered += at + WINDOW - max(at, end)
            end = at + WINDOW
    return covered


COLUMNS = "doc_id bigint, n_words bigint, word_chars bigint, n_symbols bigint, n_dup_lines bigint, n_repeat_words bigint, base_failed boolean, mean_log_ratio double, kept boolean"


def judged(texts: list[str | None], model: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    found = np.array([counts(t) for t in texts], np.int64).reshape(-1, 5)
    failed = (found[:, 0] < FEW) | (100 * found[:, 4] > REPEATED * found[:, 0])
    mean = hashed_ngrams.means(texts, model)
    return found, failed, mean, ~failed & (mean >= THRESHOLD)


def rules(frame: DataFrame, labels: DataFrame, bound: int | None = hashed_ngrams.TRUSTED) -> DataFrame:
    """The counts, base_failed, mean_log_ratio and kept of every document; two passes, in neither are texts moved (but trusted ones, if their ids are more than bound).

    The raw model is counted on all documents, the target model on all trusted ones.
    Null and empty texts have no words and fail. Repeated rows are judged alike. Without labels of quality 1
    the ratio is 0 and the base alone decides; no documents give no rows.
    """
    model = hashed_ngrams.fitted(frame, labels, bound)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            found, failed, mean, good = judged(batch.column("text").to_pylist(), model)
            columns = [batch.column("doc_id"), *(pa.array(c) for c in found.T), pa.array(failed), pa.array(mean), pa.array(good)]
            yield pa.RecordBatch.from_arrays(columns, names=[c.split()[0] for c in COLUMNS.split(", ")])

    return documents(frame).mapInArrow(run, COLUMNS)


def kept(frame: DataFrame, labels: DataFrame, bound: int | None = hashed_ngrams.TRUSTED) -> DataFrame:
    """The rows that rules keeps, with all their columns."""
    model = hashed_ngrams.fitted(frame, labels, bound)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            yield batch.filter(pa.array(judged(batch.column("text").to_pylist(), model)[3]))

    return frame.mapInArrow(run, frame.schema)
