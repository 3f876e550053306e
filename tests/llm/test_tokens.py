"""Token counts, token files and packing against the library itself."""

import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from quiverql.llm import bpe, packing, patched_frames, prefix_counts

PATH = public_tokenizers.path("byte_bpe_50k.json")
TEXTS = ["", "Hello world", "  two  spaces \n\n", "it's we'll 'x", "<|endoftext|>a <|endof", "日本語 ñandú 🙂 ß", "a" * 300, "word " * 40, "\0x\t\r\n y", "1234567 12", "THE!! END###"]


@pytest.fixture(scope="module")
def library():
    return bpe.load(PATH)


def ids(library, text):
    return library.encode(text or "", add_special_tokens=False).ids


def words():
    rng, parts = random.Random(4), ["a", "b", " ", "  ", "\n", "\n\n", "'s", "'", "'ll", "!!", "<|endoftext|>", "é", "ß", "日本", "1", "23", "\t", "hello", "THE", " the", "<|endof", "\r\n", " ", "🙂", "\0", " x"]
    return ["".join(rng.choice(parts) for _ in range(rng.randint(0, 14))) for _ in range(250)]


def test_counts_and_prefixes_are_the_librarys(library):
    made = prefix_counts.counter(PATH)
    texts = TEXTS + words()
    assert made.exact and made.counts(texts) == [len(ids(library, t)) for t in texts]
    for text in words()[:60] + TEXTS:
        assert made.prefixes(text).tolist() == [len(ids(library, text[:k])) for k in range(len(text) + 1)]


def test_cuts_are_the_longest_prefixes_that_fit(library):
    made, rng = prefix_counts.counter(PATH), random.Random(6)
    blanks = ["".join(rng.choice(["a", "foo", "!", "'s", " ", "  ", "   ", "\n", "\n\n", "\t", " it's"]) for _ in range(rng.randint(5, 30))) for _ in range(250)]
    texts = [t for t in [*TEXTS, *words(), *blanks, " " * 40 + "x" + " " * 90, "one line of some words\nand another, it's short\n" * 4]]
    tables = [[len(ids(library, t[:k])) for k in range(len(t) + 1)] for t in texts]
    for limit in (1, 2, 3, 7):
        counts, found = made.measured(texts, limit)
        assert counts == [t[-1] for t in tables]
        assert found == [[max(k for k, n in enumerate(t) if n <= budget) for budget in range(limit, t[-1], limit)] for t in tables]


def test_encoder_is_the_library(library):
    made = bpe.encoder(PATH)
    assert made.core is not None
    for text in TEXTS + words():
        assert made.encode(text).tolist() == ids(library, text)
    assert made.encode(None).tolist() == []


def frame(spark, texts):
    rows = [(k, t, "en", "x", 7) for k, t in enumerate(texts)] + [(0, texts[0], "en", "x", 7), (None, "no id", None, None, None)]
    return spark.createDataFrame(rows, "doc_id bigint, text string, n_tokens string, part string, start int").repartition(3)


def test_op8_on_a_table(spark, library):
    texts = [*TEXTS, None]
    found = prefix_counts.token_counts(frame(spark, texts), PATH, limit=10, index=True).collect()
    assert len(found) == len(texts) + 2
    for r in found:
        text = "no id" if r.doc_id is None else texts[r.doc_id] or ""
        assert (r.n_bytes, r.n_tokens, r.over_limit) == (len(text.encode()), len(ids(library, text)), len(ids(library, text)) > 10)
        assert len(r.prefix_tokens) == len(text) + 1 and r.prefix_tokens[-1] == r.n_tokens
        assert r.fit_chars == max(k for k, n in enumerate(r.prefix_tokens) if n <= 10) and r.cuts[:1] == [r.fit_chars] * r.over_limit
    key = lambda r: (r.doc_id is None, r.doc_id, r.n_tokens, r.fit_chars, r.cuts)
    assert sorted(map(key, prefix_counts.token_counts(frame(spark, texts), PATH, limit=10).collect()), key=str) == sorted(map(key, found), key=str)
    one = prefix_counts.token_counts(frame(spark, ["one two three four five"]), PATH, index=True).where("doc_id = 0")
    assert one.select(prefix_counts.longest_prefix("prefix_tokens", 2)).first()[0] == len("one two")
    assert prefix_counts.token_counts(frame(spark, texts).limit(0), PATH).count() == 0


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 2**32 - 1) | st.integers(0, 50_000), max_size=900), st.sampled_from([0.5, 0.9, 1.0]))
def test_pack_and_unpack(values, percentile):
    given_ids = np.array(values, np.uint32)
    payload = patched_frames.pack(given_ids, percentile)
    assert patched_frames.unpack(payload).tolist() == values
    if len(values) > 300:
        assert patched_frames.unpack(payload, slice(1, 2)).tolist() == values[256:512]


def test_outliers_are_exceptions():
    values = np.tile(np.arange(256, dtype=np.uint32) % 16, 4)
    values[[3, 700]] = 49_000
    assert len(patched_frames.pack(values)) < 1024 * 4 / 6 and patched_frames.unpack(patched_frames.pack(values)).tolist() == values.tolist()


def test_op5_on_a_table(spark, library, monkeypatch):
    monkeypatch.setattr(patched_frames, "SEGMENT", 64)
    texts = [*TEXTS, None]
    found = patched_frames.written_and_read(frame(spark, texts), PATH, 2).collect()
    want, start = [], 0
    for doc_id, text in [(None, "no id"), (0, texts[0]), (0, texts[0]), *list(enumerate(texts))[1:]]:
        own = [*ids(library, text), 2]
        want.append((doc_id, start, len(own), zlib.crc32(np.array(own, "<u4").tobytes())))
        start += len(own)
    assert sorted(map(tuple, found), key=lambda r: r[1]) == want
    assert patched_frames.written_and_read(frame(spark, texts).limit(0), PATH, 2).count() == 0


def test_op10_on_a_table(spark, library):
    texts = [*TEXTS, None, "long text " * 30]
    found = packing.pack(frame(spark, texts), PATH, cap=50, end_id=0).collect()
    by_sequence, by_doc = {}, {}
    for r in found:
        by_sequence.setdefault(r.sequence_id, []).append(r)
        by_doc.setdefault(r.doc_id, []).append(r)
    for rows in by_sequence.values():
        rows.sort(key=lambda r: r.offset)
        assert [r.offset for r in rows] == [sum(x.length for x in rows[:k]) for k in range(len(rows))] and sum(r.length for r in rows) <= 50
    for doc_id, rows in by_doc.items():
        own = [*ids(library, "no id" if doc_id is None else texts[doc_id]), 0]
        assert sum(r.length for r in rows) == len(own) * (2 if doc_id == 0 else 1)
        for r in rows:
            assert r.ids_crc32 == zlib.crc32(np.array(own[r.start : r.start + r.length], "<u4").tobytes())
            assert r.length == 50 or r.piece == 0
    total = sum(r.length for r in found)
    assert len(by_sequence) <= -(-total // 50) + 1
    assert packing.pack(frame(spark, texts).limit(0), PATH).count() == 0


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 40), max_size=120))
def test_plans_use_every_piece_once(lengths):
    counts = np.bincount(lengths, minlength=41) if lengths else np.zeros(41, np.int64)
    used = np.zeros(41, np.int64)
    for combination, times in packing.exact_complements(counts, 40):
        assert times > 0 and sum(combination) <= 40
        for x in combination:
            used[x] += times
    assert used.tolist() == counts.tolist()


def test_exact_complements_of_one_two_and_three():
    plan = packing.exact_complements(np.bincount([30, 10, 25, 9, 6, 28, 5, 4, 3, 40], minlength=41), 40)
    assert sorted(map(sum, (c for c, _ in plan))) == [40, 40, 40, 40] and {len(c) for c, _ in plan} == {1, 2, 3, 4}
    rng = np.random.default_rng(1)
    counts = np.bincount(np.minimum(2048, rng.lognormal(6, 1, 20_000).astype(int) + 1), minlength=2049)
    sequences = sum(t for _, t in packing.exact_complements(counts, 2048))
    assert sequences <= 1.002 * -(-int((counts * np.arange(2049)).sum()) // 2048) + 1
