"""The prefix trie and the repair of conversations against brute force."""

import hashlib
import heapq
import random
import re
import zlib

import duckdb
import pytest

from quiverql.llm import prefix_trie, queries, repair

TURNS = "conv_id bigint, turn bigint, role string, text string, depth string, words string"


def frame(spark, rows):
    return spark.createDataFrame([(*r, "mine", "mine") for r in rows], TURNS).repartition(3)


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def brute_trie(rows):
    own: dict[int, list] = {}
    for c, turn, role, text in rows:
        if c is not None:
            own.setdefault(c, []).append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: [t[2:] for t in sorted(ts)] for c, ts in own.items()}
    rebuilt = {}
    for c, ts in own.items():
        h = zlib.crc32(str(c).encode()) % 4
        rebuilt[c] = own.get(c - c % 20, [])[:h] + ts[h:]
    members: dict[tuple, list] = {}
    for c, ts in sorted(rebuilt.items()):
        for d in range(len(ts) + 1):
            members.setdefault(tuple(ts[:d]), []).append(c)
    out = []
    for path, own_members in members.items():
        under = [p for p in members if p[: len(path)] == path]
        kids = [p for p in under if len(p) == len(path) + 1]
        leaves = [p for p in under if not any(len(q) == len(p) + 1 and q[: len(p)] == p for q in under)]
        saved = sum((len(members[p]) - 1) * len(p[-1][1].encode().split()) for p in under if p)
        ends = ",".join(str(c) for c in own_members if len(rebuilt[c]) == len(path))
        out.append((own_members[0], len(path), members[path[:-1]][0] if path else None, len(own_members), len(kids), len(leaves), saved, sha(ends)))
    return sorted(out, key=repr)


def conversations(rng, n):
    """Conversations with few texts, so that beginnings and whole conversations repeat; gaps, nulls, blanks and rows of one id."""
    texts = ["one two three", "a  b\n c", "", "long " * 30 + ".", None, "q?"]
    roles = ["user", "assistant", "system", None, "tool"]
    out = []
    for c in rng.sample(range(3 * n), n):
        turns = rng.sample(range(12), rng.randrange(1, 7))
        out += [(c, t, roles[t % 2] if rng.random() < 0.8 else rng.choice(roles), rng.choice(texts[: 1 + c % 6])) for t in sorted(turns)]
    return out


ODD = [(None, 1, "user", "x"), (1, None, None, None), (1, None, "a", "b"), (1, 0, "user", "hello there"), (2, 5, "user", "hi"), (20, 0, "user", "hi"), (20, 1, "assistant", "ho ho"), (20, 2, "user", "hi"), (20, 3, "user", "hi"), (21, 0, "x", "y"), (25, 0, "x", "y"), (25, 1, "x", "y"), (39, 0, "", "")]
MANY = [(c, t, "user", f"turn {t}") for c in range(0, 60) for t in range(4)]
DEEP = [(c, t, "user", f"turn {t}" if t != 40 else f"{c}") for c in (40, 60) for t in range(70)] + [(80, t, "user", f"turn {t}") for t in range(25)]


@pytest.mark.parametrize("rows", [ODD, MANY, DEEP, [], [(3, 0, "user", "x y")], conversations(random.Random(1), 90), conversations(random.Random(2), 40) + MANY])
def test_trie_against_brute_force(spark, rows):
    found = prefix_trie.trie(frame(spark, rows))
    assert found.columns == ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    assert sorted(map(tuple, found.collect()), key=repr) == brute_trie(rows)


def test_messages_of_wide_and_deep_trees(spark, monkeypatch):
    from quiverql.llm import base

    monkeypatch.setattr(base, "HEAVY_ROWS", 2)
    rows = conversations(random.Random(7), 60) + [(1000 + c, t, "user", f"same {t}" if t < 2 else f"{c}") for c in range(50) for t in range(4)]
    assert sorted(map(tuple, prefix_trie.trie(frame(spark, rows)).collect()), key=repr) == brute_trie(rows)


def test_trie_sql(spark, data):
    names = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    found = sorted((tuple(r[c] for c in names) for r in queries.queries()["op11_prefix_trie"](spark, data).collect()), key=repr)
    db = duckdb.connect()
    db.execute(f"create view conversations as select * from '{data}/conversations.parquet'")
    asked = db.execute(queries.oracle_sql()["op11_prefix_trie"])
    own = [d[0] for d in asked.description]
    assert found == sorted((tuple(dict(zip(own, r, strict=True))[c] for c in names) for r in asked.fetchall()), key=repr)


def brute_repair(rows):
    """By a search over whole audits, cheapest and then least first."""
    convs: dict = {}
    for c, turn, role, text in rows:
        own = convs.setdefault(c, [])
        role, text = " " if role is None else role, " " if text is None else text
        way = zlib.crc32(f"{' ' if c is None else c}:{' ' if turn is None else turn}".encode()) % 20
        text = "" if way == 1 else re.sub("[.!?]", "", text) if way == 2 else text
        role = "user" if way == 4 else role
        own += [(turn is not None, turn or 0, role, text)] * (way != 0) * (2 if way == 3 else 1)
    out = []
    for c, own in convs.items():
        own.sort()
        turns = [t for known, t, _, _ in own if known]
        faults, seen, initials = [], set(), [r[:1] for _, _, r, _ in own]
        for _, _, role, text in own:
            bare = text.strip(" \t\n\r\v\f")
            faults.append("blank" if not bare else "duplicate" if (role, text) in seen else "truncated" if bare[-1] not in ".!?" else "")
            seen.add((role, text))
        illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:]))
        audit, cost, kept = searched([(r, t, f) for (_, _, r, t), f in zip(own, faults)])
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        out.append((c, gaps, *(faults.count(f) for f in ("blank", "duplicate", "truncated")), illegal, cost, audit, sha("\n".join(kept))))
    return sorted(out, key=repr)


def searched(rows):
    heap, done = [(0, "", 0, "", ())], set()
    while heap:
        cost, audit, at, roles, kept = heapq.heappop(heap)
        if at == len(rows) and re.fullmatch("(s?(ua)+)?", roles):
            return audit, cost, kept
        state = (at, roles[-1:] if len(roles) > 0 else "", len(roles) > 0)
        if state in done:
            continue
        done.add(state)
        ways = [("I", at, n, f"{n}:", 3) for n in ("user", "assistant")]
        if at < len(rows):
            role, text, fault = rows[at]
            more = 3 if fault == "truncated" else 0
            ways.append(("D", at + 1, None, None, 4))
            if fault not in ("blank", "duplicate"):
                ways.append(("K", at + 1, role, f"{role}:{text}", more))
                ways += [("R", at + 1, n, f"{n}:{text}", 3 + more) for n in ("user", "assistant")]
        for edit, to, role, turn, price in ways:
            now = roles + role[:1] if role is not None else roles
            if role is None or role and re.fullmatch("s?(ua)*u?", now):
                heapq.heappush(heap, (cost + price, audit + edit, to, {"a": "ua"}.get(now[-1:], now[-1:]), kept + ((turn,) if turn is not None else ())))
    raise AssertionError("no repair")


def talks(rng, n):
    texts = ["Well.", "So what?", "no end", " \n", "", "trails off. \n ", "!", "a.b", None, "Ü ü."]
    roles = ["system", "user", "assistant", "user", "assistant", "tool", "Assistant", "", None]
    out = []
    for c in range(n):
        turns = sorted(rng.sample(range(14), rng.randrange(1, 9)))
        for k, t in enumerate(turns):
            role = ("user", "assistant")[k % 2] if rng.random() < 0.6 else rng.choice(roles)
            out.append((c if c % 17 else None, None if rng.random() < 0.05 else t, role, rng.choice(texts)))
        if rng.random() < 0.2:
            out.append(out[-1])
    return out


@pytest.mark.parametrize("rows", [ODD, [], DEEP, talks(random.Random(1), 150), talks(random.Random(2), 150), [(5, t, ("user", "assistant")[t % 2], f"Turn {t}.") for t in range(3000)], [(k, 0, None, None) for k in range(60)]])
def test_repair_against_brute_force(spark, rows):
    found = repair.repair(frame(spark, rows))
    assert found.columns == ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]
    assert sorted(map(tuple, found.collect()), key=repr) == brute_repair(rows)


def test_repair_on_a_table(spark, data):
    rows = [tuple(r) for r in spark.read.parquet(f"{data}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    found = queries.queries()["op12_conversation_repair"](spark, data)
    assert sorted(map(tuple, found.collect()), key=repr) == brute_repair(rows)


def test_repair_in_one_shuffle(spark, data):
    plan = repair.repaired(repair.damaged(spark.read.parquet(f"{data}/conversations.parquet")))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1
