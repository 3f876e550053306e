"""Nearest neighbours and the whole pipeline."""

import numpy as np
import pytest

from quiverql.llm import posting_lists as p


def brute(ids, space, query, k):
    far = np.sqrt(((space - space[ids == query][0]) ** 2).sum(axis=1))
    far[ids == query] = np.inf
    order = np.lexsort((ids, far))[: min(k, len(ids) - 1)]
    return ids[order].tolist(), far[order].tolist()


@pytest.fixture(scope="module")
def vectors():
    rng = np.random.default_rng(4)
    centres = rng.normal(size=(20, 16)) * 3
    space = centres[rng.integers(0, 20, 3000)] + rng.normal(size=(3000, 16))
    space[500:900] = space[500]  # one very common vector
    return space.astype(np.float32)


def test_recall_and_exact_scores(spark, vectors):
    rows = [(k, v.tolist(), 1) for k, v in enumerate(vectors)]
    rows += [(5000, None, 1), (5100, [0.0] * 16, 1), (5200, [float("nan")] * 16, 1), (5300, [1.0, 2.0], 1), (5400, [None] * 16, 1), (5500, [float("inf")] + [0.0] * 15, 1), rows[100]]
    found = p.neighbours(spark.createDataFrame(rows, "vec_id bigint, embedding array<float>, list int")).collect()
    by: dict[int, list] = {}
    for r in found:
        by.setdefault(r.query_id, []).append(r)
    assert sorted(by) == list(range(0, 3000, 100))
    hits, ids, space = 0, np.arange(3000), vectors.astype(float)
    for query, own in by.items():
        own.sort(key=lambda r: r.rank)
        want, far = brute(ids, space, query, 10)
        assert [r.rank for r in own] == list(range(1, 11)) and query not in [r.vec_id for r in own]
        assert [r.score for r in own] == pytest.approx([np.sqrt(((space[r.vec_id] - space[query]) ** 2).sum()) for r in own], rel=1e-12)
        hits += len(set(want) & {r.vec_id for r in own})
        if 500 <= query < 900:
            assert [r.vec_id for r in own] == want and far == [0.0] * 10
    assert hits >= 0.95 * 10 * len(by)


@pytest.mark.parametrize("n", [0, 1, 4, 101])
def test_few_vectors(spark, vectors, n):
    rows = [(k, v.tolist()) for k, v in enumerate(vectors[:n])]
    found = p.neighbours(spark.createDataFrame(rows, "vec_id bigint, embedding array<float>")).orderBy("query_id", "rank").collect()
    ids = np.arange(n)
    want = [v for q in range(0, n, 100) for v in brute(ids, vectors[:n].astype(float), q, 10)[0]]
    assert [r.vec_id for r in found] == want


def test_graph_search_finds_near_centroids(vectors):
    made = p.made(vectors.astype(float), 200)
    points = made.points
    assert 150 < len(points) < 600
    everything = p.made(vectors[:300].astype(float), 60).reach(vectors[:5].astype(float), 100.0)
    assert all(len(ids) == len(set(ids.tolist())) == len(everything[0][0]) for ids, _ in everything)
    near, far = made.search(vectors[:100].astype(float), 32)
    exact = np.argsort(((vectors[:100, None].astype(float) - points) ** 2).sum(axis=2), axis=1)[:, :8]
    assert np.mean([len(set(a) & set(b)) / 8 for a, b in zip(near.tolist(), exact.tolist(), strict=True)]) > 0.95
    assert (np.diff(far, axis=1) >= 0).all()


def test_long_lists_are_split(spark, vectors, monkeypatch):
    rows = [(k, v.tolist()) for k, v in enumerate(vectors[:600])]
    frame = spark.createDataFrame(rows, "vec_id bigint, embedding array<float>")
    whole = sorted(p.neighbours(frame, every=10).collect())
    monkeypatch.setattr(p, "GROUP_VECTORS", 50)
    monkeypatch.setattr(p, "GROUP_QUERIES", 3)
    assert sorted(p.neighbours(frame, every=10).collect()) == whole


def test_few_of_many_lists_are_read(spark):
    from pyspark.sql import functions as F

    from quiverql.llm.base import Workspace

    rng = np.random.default_rng(3)
    centres = rng.normal(size=(150, 24))
    space = (centres[rng.integers(0, 150, 12_000)] + 0.4 * rng.normal(size=(12_000, 24))).astype(np.float32)
    frame = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(space)], "vec_id bigint, embedding array<float>").repartition(4)
    found = p.neighbours(frame).toPandas()
    hits = sum(len(set(brute(np.arange(12_000), space.astype(float), q, 10)[0]) & set(own.vec_id)) for q, own in found.groupby("query_id"))
    assert found.query_id.nunique() == 120 and hits > 0.95 * 1200
    index = p.build(p.usable(frame), Workspace(spark, "t"))
    assert {r.vec_id for r in index.stored.select("vec_id").distinct().collect()} == set(range(12_000))
    asked = p.usable(frame).where("vec_id % 100 = 0").withColumnRenamed("vec_id", "query_id")
    read = p.reading(index, asked).select(F.explode("lists").alias("list")).join(index.stored.groupBy("list").count(), "list").agg(F.sum("count")).first()[0]
    assert read < 0.1 * 120 * index.stored.count()


def test_one_id_with_several_vectors(spark):
    rows = [(0, [1.0, 0.0]), (0, [0.0, 3.0]), (1, [1.0, 0.5]), (2, [0.0, 3.25]), (2, [9.0, 9.0]), (3, [5.0, 5.0]), (3, [5.0, 5.0]), (None, [1.0, 0.0])]
    found = p.neighbours(spark.createDataFrame(rows, "vec_id bigint, embedding array<double>"), k=3).orderBy("rank").collect()
    assert [(r.query_id, r.rank, r.vec_id) for r in found] == [(0, 1, 2), (0, 2, 1), (0, 3, 3)]
    assert [r.score for r in found] == pytest.approx([0.25, 0.5, np.sqrt(29)])


def test_pipeline_on_a_table(spark, data):
    import re

    import corpus_pipeline
    import public_tokenizers
    from quiverql.llm import bpe, mixing, order_minhash, resampling, rules

    docs, known = spark.read.parquet(f"{data}/documents.parquet"), spark.read.parquet(f"{data}/labels.parquet")
    good = {r.doc_id for r in resampling.resample(docs, known).collect() if r.kept}
    left = docs.where(docs.doc_id.isin(*good))
    good = {r.doc_id for r in rules.rules(left, known).collect() if r.kept}
    rows = sorted((r.doc_id, r.text) for r in left.where(left.doc_id.isin(*good)).collect())
    first = {}
    for i, t in rows:  # all pairs, links joined to the least id
        first[i] = min((first[j] for j, u in rows if j < i and order_minhash.alike(t.encode(), u.encode())), default=i)
    stay = {i for i, _ in rows if first[i] == i}
    kept = docs.where(docs.doc_id.isin(*stay))
    taken = {r.doc_id: r.taken for r in mixing.mix(kept).collect() if r.taken}
    # the pipeline's own stages give the same rows, and its pieces have the mix's tokens
    stages = dict(corpus_pipeline.STAGES)
    assert list(stages) == ["quality classifier", "quality rules", "near dedup", "mix sources", "best-fit packing"]
    texts = stages["mix sources"](spark, kept, data)
    assert texts.columns == docs.columns
    words: dict[int, int] = {}
    tokens = 0
    for r in texts.collect():
        words[r.doc_id] = words.get(r.doc_id, 0) + len(re.findall(r"[^\x20\x09-\x0D]+", r.text))
        tokens += len(bpe.encoder(public_tokenizers.path("byte_bpe_50k.json")).encode(r.text)) + 1
    assert words == taken
    found = corpus_pipeline.run(spark, data).collect()
    assert {r.doc_id for r in found} == set(taken) and sum(r.length for r in found) == tokens
    sequences: dict[int, int] = {}
    for r in found:
        sequences[r.sequence_id] = sequences.get(r.sequence_id, 0) + r.length
    assert max(sequences.values()) <= 2048 and len(sequences) <= -(-tokens // 2048) + 2


@pytest.mark.parametrize("empty", [False, True])
def test_pipeline_on_odd_rows(spark, tmp_path, empty):
    import random

    import corpus_pipeline

    rng = random.Random(4)
    text = lambda n: " ".join(rng.choice(["ab", "cde", "fg", "hijk", "lm"]) + rng.choice(["an", "er", "on", "it"]) + str(rng.randint(0, 99)) for _ in range(n))
    whole = text(60)
    rows = [(k, text(30 + k), "en", f"s{k % 2}", 5, "x", 1) for k in range(20)]
    rows += [(30, whole, "en", "s0", 5, None, 2), (31, whole + " more", None, None, None, "y", 3), (30, whole, "en", "s0", 5, None, 2), (None, whole, "en", "s1", 5, "z", 4)]
    rows += [(40, None, "en", "s0", 0, "x", 5), (41, "", "en", "s1", 0, "x", 6), (42, "few words", "en", "s1", 9, "x", 7), (43, "again and again " * 50, "en", "s0", 9, "x", 8), (44, text(8000), None, None, None, None, None)]
    frame = spark.createDataFrame(rows[:0] if empty else rows, "doc_id bigint, text string, lang string, source string, n_chars bigint, `row` string, print int")
    frame.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(k, 1, 0) for k in range(0, 20, 2)], "doc_id bigint, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    stages = dict(corpus_pipeline.STAGES)
    for name in list(stages)[:-1]:
        assert stages[name](spark, frame, str(tmp_path)).columns == frame.columns
    found = corpus_pipeline.run(spark, str(tmp_path)).collect()
    got = {r.doc_id for r in found}
    assert got == (set() if empty else {*range(20), 30, 44}) and all(r.length <= 2048 for r in found)
