"""Substring dedup against brute force."""

import hashlib
import random

import duckdb
import pytest

from pyspark.sql import functions as F

from quiverql.llm import doubling, queries

DOCS = "doc_id bigint, text string, anchors string, n string"


def brute(rows, window):
    """doc_id, n_words, n_removed, kept_sha256 and longest of every row."""
    split = [(-(2**63) if i is None else i, (t or "").encode().split()) for i, t in rows]
    starts: dict[tuple, set] = {}
    length, lengths = window, []
    while length <= max((len(w) for _, w in split), default=0):
        lengths.append(length)
        for i, words in split:
            for k in range(len(words) - length + 1):
                starts.setdefault(tuple(words[k : k + length]), set()).add(i)
        length *= 2
    out = []
    for (i, words), (own, _) in zip(split, rows, strict=True):
        gone, longest = set(), 0
        for length in lengths:
            for k in range(len(words) - length + 1):
                ids = starts[tuple(words[k : k + length])]
                if length == window and min(ids) < i:
                    gone |= set(range(k, k + window))
                if len(ids) > 1:
                    longest = max(longest, length)
        kept = b" ".join(w for k, w in enumerate(words) if k not in gone)
        out.append((own, len(words), len(gone), hashlib.sha256(kept).hexdigest(), longest))
    return sorted(out, key=repr)


def made(rng, n):
    """Random texts with passages, near copies, exact copies, blanks of all kinds and texts that repeat themselves."""
    words = [f"w{k}" for k in range(60)] + ["ß", "Über", "né né", " x", "a.b,c"]
    say = lambda k: [rng.choice(words) for _ in range(k)]
    passages, out = [say(rng.choice((4, 13, 14, 30, 60))) for _ in range(6)], []
    for k in range(n):
        kind = rng.randrange(6)
        if kind == 0 and out:
            text = rng.choice(out)[1]
        elif kind == 1 and out and out[-1][1]:
            own = out[-1][1].split(" ")
            own[rng.randrange(len(own))] = "other"
            text = " ".join(own)
        elif kind == 2:
            part = say(7)
            text = " ".join(say(rng.randrange(9)) + part * rng.randrange(1, 5))
        else:
            text = rng.choice((" ", "\n", "\t ", "  ")).join(say(rng.randrange(25)) + rng.choice(passages) + say(rng.randrange(12)) + rng.choice(passages)[: rng.randrange(1, 60)])
        out.append((rng.choice((k, k, k, rng.randrange(n), None)), text))
    return out


ODD = [(1, None), (2, ""), (None, None), (3, " \n "), (4, "a b c d"), (4, "a b c d"), (None, "a b c d"), (5, "x " * 3000), (6, "y" * 5000 + " " + "x " * 900), (7, "b c d e")]


@pytest.mark.parametrize(("rows", "window"), [(ODD, 13), (ODD, 3), (ODD[:0], 13), ([(k, "the same few words in all of them " * 4) for k in range(40)] + [(50, None)] * 9, 5), (made(random.Random(3), 160), 13), (made(random.Random(4), 120), 4), (made(random.Random(5), 60), 2)])
def test_against_brute_force(spark, rows, window):
    frame = spark.createDataFrame([(i, t, "mine", "mine") for i, t in rows], DOCS).repartition(3)
    found = doubling.deduplicated(frame, window)
    assert found.columns == ["doc_id", "n_words", "n_removed", "kept_sha256", "longest"]
    assert sorted(map(tuple, found.collect()), key=repr) == brute(rows, window)


def test_words_of_long_texts_are_hashed_in_parts(monkeypatch):
    text = " ".join(str(k * k) for k in range(4000)).encode() + b"  " + b"z" * 3000 + b"\n\n" + b"q" * 700
    whole = doubling.word_hashes(text)
    monkeypatch.setattr(doubling, "CHUNK", 500)
    assert (doubling.word_hashes(text) == whole).all() and len(whole) == 4002 and len(set(whole.tolist())) == 4002
    assert len(doubling.word_hashes(b"")) == 0 and len(doubling.word_hashes(b" " * 2000)) == 0


def test_heavy_windows_are_dealt_out(spark, monkeypatch):
    from quiverql.llm import base

    monkeypatch.setattr(base, "HEAVY_ROWS", 3)
    rows = made(random.Random(8), 90) + [(1000 + k, f"own{k} " + "one passage that stands in a third of all these documents here and is long enough") for k in range(60)]
    frame = spark.createDataFrame([(i, t, "", "") for i, t in rows], DOCS)
    assert sorted(map(tuple, doubling.deduplicated(frame).collect()), key=repr) == brute(rows, 13)


def test_sql(spark, data):
    found = sorted(map(tuple, queries.queries()["op13_substring_dedup"](spark, data).collect()), key=repr)
    db = duckdb.connect()
    db.execute(f"create view documents as select * from '{data}/documents.parquet'")
    asked = db.execute(queries.oracle_sql()["op13_substring_dedup"])
    names = [d[0] for d in asked.description]
    want = [tuple(dict(zip(names, r, strict=True))[c] for c in ("doc_id", "n_words", "n_removed", "kept_sha256", "longest")) for r in asked.fetchall()]
    assert found == sorted(want, key=repr) and sum(r[2] for r in found) > 0


def test_a_join_without_frequent_keys_is_not_salted(spark):
    from quiverql.llm.base import HEAVY_ROWS, salted_join

    rows = spark.range(3 * HEAVY_ROWS).selectExpr("id", "if(id < 2000, 7, id) k")
    for frame, salted in ((rows, True), (rows.where("id >= 1999"), False)):
        joined = salted_join(frame, frame.groupBy("k").agg(F.count(F.lit(1)).alias("n")), ["k"], F.col("id"))
        assert ("__salt" in joined._jdf.queryExecution().optimizedPlan().toString()) == salted
        assert joined.exceptAll(frame.select("k", "id")).isEmpty() and joined.count() == frame.count()


def test_a_filter_of_keys_loses_none_and_reads_no_strings(spark):
    from quiverql.llm.base import likely_among

    rows, keys = spark.range(-3000, 3000).selectExpr("id k"), spark.range(-6000, 90_000, 7).selectExpr("id k")
    found = likely_among(rows, "k", keys)
    want = rows.join(keys, "k", "left_semi")
    assert want.exceptAll(found).isEmpty() and 0 <= found.count() - want.count() < 60 and likely_among(rows, "k", keys.limit(0)).isEmpty()
    # a row's bit is looked up in numbers: what makes numbers of bytes stands below the join, once for each part of the filter
    join = next(line for line in found._jdf.queryExecution().optimizedPlan().toString().splitlines() if "Join Inner" in line)
    assert "getbit" in join and "hex(" not in join


def test_a_join_with_one_row_a_key_sorts_neither_side(spark):
    from quiverql.llm.base import salted_join

    rows = spark.range(5000).selectExpr("id", "id % 900 k")
    joined = salted_join(rows, rows.groupBy("k").agg(F.count(F.lit(1)).alias("n")), ["k"], F.col("id"))
    assert "ShuffledHashJoin" in joined._jdf.queryExecution().sparkPlan().toString() and joined.exceptAll(rows.select("k", "id")).isEmpty()
