"""Conversations damaged on purpose, and the cheapest repair of each.

A repaired conversation's roles are nothing, or an optional system turn and then user and assistant in turns. The
cheapest edits are found by two passes over a conversation's sorted rows: backward, the cost to go from each row in
each state of that grammar; forward, the walk that takes the ASCII-least of the edits that cost no more than that.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .base import slices

#: States: nothing yet, after system, after user, after assistant. The state after a role, where it may follow.
AFTER = ({"s": 1, "u": 2}, {"u": 2}, {"a": 3}, {"u": 2})
#: The role that a turn made or renamed gets in each state.
NEXT = ("u", "u", "a", "u")
NAMES = {"u": "user", "a": "assistant"}
#: What is left to pay after the last row: a conversation may end at once, or after an assistant.
AT_END = (0, 6, 3, 0)
RENAME, DELETE, INSERT, CUT_OFF = 3, 4, 3, 3
BLANK, COPY, TRUNCATED = 1, 2, 3
WORD = r"[^\x20\x09-\x0D]"


def damaged(frame: DataFrame) -> DataFrame:
    """conv_id, turn, role, text and again (1 for the second of a repeated row) of the rows that are left; a null is one space in the key and for role and text."""
    space = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    rows = frame.select(F.col("conv_id").cast("bigint").alias("conv_id"), F.col("turn").cast("bigint").alias("turn"), space("role").alias("role"), space("text").alias("text"), (F.crc32(F.concat(space("conv_id"), F.lit(":"), space("turn")).cast("binary")) % 20).alias("way"))
    role = F.when(F.col("way") == 4, "user").otherwise(F.col("role"))
    text = F.when(F.col("way") == 1, "").when(F.col("way") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    times = F.when(F.col("way") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    return rows.where("way <> 0").select("conv_id", "turn", role.alias("role"), text.alias("text"), F.explode(times).alias("again"))


def faulty(rows: DataFrame) -> DataFrame:
    """Each row with its place in its conversation, its first fault, and what the conversation's figures need of it.

    Rows of one turn are ordered by role and text. All windows are of one conversation and share one shuffle.
    """
    order = Window.partitionBy("conv_id").orderBy(F.asc_nulls_first("turn"), "role", "text", "again")
    placed = rows.select("*", F.row_number().over(order).alias("place"), F.lag("role").over(order).alias("role_before"), F.md5(F.col("text").cast("binary")).alias("digest"))
    seen = F.row_number().over(Window.partitionBy("conv_id", "role", "digest").orderBy("place")) > 1
    last = F.regexp_extract("text", r"([^\x20\x09-\x0D])[\x20\x09-\x0D]*\z", 1)
    fault = F.when(~F.col("text").rlike(WORD), BLANK).when(seen, COPY).when(~last.isin(".", "!", "?"), TRUNCATED).otherwise(0)
    pair = F.concat(F.substring("role_before", 1, 1), F.substring("role", 1, 1))
    return placed.select("conv_id", "turn", "place", "role", "text", fault.alias("fault"), (F.col("role_before").isNotNull() & ~pair.isin("su", "ua", "au")).alias("illegal"))


def before_row(role: str, fault: int, after: tuple[int, ...]) -> tuple[int, ...]:
    """The cost to go in each state before a row from that after it."""
    extra = CUT_OFF if fault == TRUNCATED else 0
    out = []
    for state in range(4):
        cost = after[state] + DELETE
        if fault not in (BLANK, COPY):
            kept = AFTER[state].get(role[:1])
            if kept is not None:
                cost = min(cost, after[kept] + extra)
            cost = min(cost, after[AFTER[state][NEXT[state]]] + RENAME + extra)
        out.append(cost)
    # one or two turns may be put in before the row; a third would lead back
    once = [min(out[s], INSERT + out[AFTER[s][NEXT[s]]]) for s in range(4)]
    return tuple(min(once[s], INSERT + once[AFTER[s][NEXT[s]]]) for s in range(4))


Found = tuple[str, list[str], int]


def walk(state: int, here: tuple[int, ...], after: tuple[int, ...], role: str, text: str, fault: int) -> tuple[Found, int]:
    """The edits up to and with a row, the turns that they leave, their cost, and the state then."""
    edits, turns, cost = "", [], 0
    extra = CUT_OFF if fault == TRUNCATED else 0
    while True:
        need = NEXT[state]
        onward = AFTER[state][need]
        if here[state] == DELETE + after[state]:
            return (edits + "D", turns, cost + DELETE), state
        if here[state] == INSERT + here[onward]:
            edits, cost, state = edits + "I", cost + INSERT, onward
            turns.append(f"{NAMES[need]}:")
            continue
        kept = AFTER[state].get(role[:1])
        if fault not in (BLANK, COPY) and kept is not None and here[state] == after[kept] + extra:
            return (edits + "K", [*turns, f"{role}:{text}"], cost + extra), kept
        return (edits + "R", [*turns, f"{NAMES[need]}:{text}"], cost + RENAME + extra), onward


def ending(state: int) -> Found:
    """The turns put in after the last row."""
    edits, turns, cost = "", [], 0
    while AT_END[state]:
        need = NEXT[state]
        edits, cost, state = edits + "I", cost + INSERT, AFTER[state][need]
        turns.append(f"{NAMES[need]}:")
    return edits, turns, cost


COSTS = ["before", "after"]
ROW = "conv_id bigint, turn bigint, place int, role string, text string, fault int, illegal boolean, before array<bigint>, after array<bigint>"


def costs_to_go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The rows, which come from a conversation's last to its first, with the cost to go before and after each."""
    now, costs = (), AT_END
    for batch in batches:
        if not batch.num_rows:
            continue
        before, after = [], []
        for conv, role, fault in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "role", "fault")), strict=True):
            if now != (conv,):
                now, costs = (conv,), AT_END
            after.append(costs)
            costs = before_row(role, fault, costs)
            before.append(costs)
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(before, pa.list_(pa.int64())), pa.array(after, pa.list_(pa.int64()))], names=[*batch.schema.names, *COSTS])


class Walk:
    """One conversation on the way forward: figures and a running hash, no texts."""

    def __init__(self, conv: int | None):
        self.conv, self.state, self.faults, self.illegal, self.cost, self.audit = conv, 0, [0] * 4, 0, 0, []
        self.low = self.high = self.turn = None
        self.turns, self.sha, self.empty = 0, hashlib.sha256(), True

    def add(self, found: Found) -> None:
        edits, turns, cost = found
        self.audit.append(edits)
        self.cost += cost
        for turn in turns:
            self.sha.update((turn if self.empty else "\n" + turn).encode("utf-8", "surrogatepass"))
            self.empty = False

    def row(self, turn: int | None, role: str, text: str, fault: int, illegal: bool, here: list[int], after: list[int]) -> None:
        self.faults[fault] += 1
        self.illegal += illegal
        if turn is not None:
            self.low = turn if self.low is None else self.low
            self.turns += turn != self.turn
            self.high = self.turn = turn
        found, self.state = walk(self.state, here, after, role, text, fault)
        self.add(found)

    def result(self) -> tuple:
        self.add(ending(self.state))
        gaps = 0 if self.low is None else self.high - self.low + 1 - self.turns
        return self.conv, gaps, self.faults[BLANK], self.faults[COPY], self.faults[TRUNCATED], self.illegal, self.cost, "".join(self.audit), self.sha.hexdigest()


RESULT = "conv_id bigint, gaps bigint, blank bigint, duplicate bigint, truncated bigint, illegal bigint, cost bigint, audit string, repaired_sha256 string"
NAMES_OF_RESULT = [c.split()[0] for c in RESULT.split(", ")]


def walked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row a conversation from its rows in order."""
    types = [pa.int64()] * 7 + [pa.string()] * 2
    now = None
    for batch in slices(batches):
        out = []
        for conv, *row in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "turn", "role", "text", "fault", "illegal", *COSTS)), strict=True):
            if now is None or now.conv != conv:
                if now is not None:
                    out.append(now.result())
                now = Walk(conv)
            now.row(*row)
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True) if out else [[]] * 9, types, strict=True)], names=NAMES_OF_RESULT)
    if now is not None:
        yield pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(now.result(), types, strict=True)], names=NAMES_OF_RESULT)


def repaired(rows: DataFrame) -> DataFrame:
    """The figures, the audit and the hash of the repaired turns of every conversation in rows (conv_id, turn, role, text, again).

    One shuffle by conversation; each pass goes over rows sorted within the tasks and holds a batch of them, and
    the audit, which is a cell of the result. A conversation is hashed in order, so by one task.
    """
    ready = faulty(rows).sortWithinPartitions("conv_id", F.desc("place")).mapInArrow(costs_to_go, ROW)
    return ready.sortWithinPartitions("conv_id", "place").mapInArrow(walked, RESULT)


def repair(frame: DataFrame) -> DataFrame:
    """One row for every conv_id: its figures after the damage and its cheapest repair.

    A null conv_id is a conversation too; a null turn comes first; a null role or text is one space. Repeated rows
    are rows, the later of them duplicates. A conversation of which no row is left has zeros, an empty audit and
    the hash of nothing; no rows give no rows.
    """
    ids = frame.select(F.col("conv_id").cast("bigint").alias("id")).distinct()
    found = repaired(damaged(frame))
    zero = [F.coalesce(c, F.lit(0).cast("bigint")).alias(c) for c in NAMES_OF_RESULT[1:7]]
    nothing = F.lit(hashlib.sha256(b"").hexdigest())
    return ids.join(found, F.col("id").eqNullSafe(F.col("conv_id")), "left").select(F.col("id").alias("conv_id"), *zero, F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", nothing).alias("repaired_sha256"))
