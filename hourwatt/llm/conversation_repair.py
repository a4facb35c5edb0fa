"""Cheapest edits that give every conversation a legal order of roles, least in the order of their initials.

A legal conversation is empty, or an optional system turn followed by pairs of user and assistant turns. What has been
read of it is one of four states; a row changes a vector of four costs in a way that depends on nothing but its role
and its fault. Rows are kept (K), given the role that may come next (R), deleted (D), or a turn is put in before them (I).

Conversations of any length are spread out: rows are sorted over the whole table into blocks, one per task, and for
every block the least audit and its cost are found for each state it may be entered and left in. Within a block that is
divide and conquer: a forward and a backward cost vector meet in the middle; if one state alone is optimal there, both
halves go on by themselves, otherwise the audit-least way through the first half, under the costs of all tied states,
says where it crosses. Only vectors are kept, so the space is linear. From any state, at most one edit has a given
initial, so the least initial that stays optimal is the start of the least audit; and of two cheapest ways between
the same states none is the beginning of another, so blocks can be chained by comparing their audits.
Repaired texts are made block by block and a conversation's blocks are chained in order.

Defined results: a null role or text counts as one space, as ``damaged`` has made them already; null turns come first
and do not count towards gaps; rows of one turn are taken by role and text in byte order; a null id is a conversation of
its own; repeated rows are rows of their own, of which all but the first are duplicates; texts of any length are whole;
a role's initial is its first character; an empty table has no conversations; other columns are not read.
"""

from __future__ import annotations

import functools
import hashlib
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hourwatt.llm.scratch import stored

# Costs of the edits, and what an undeleted truncated row adds.
KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 2, 3, 2, 1
FAR = 1 << 60
LEAF = 32
# States: nothing yet, system, user, assistant. The next user or assistant turn is fixed by the state.
NEXT = (2, 2, 3, 2)
KEPT = {"s": (1, None, None, None), "u": (2, 2, None, 2), "a": (None, None, 3, None)}
NAMES = {2: "user", 3: "assistant"}
OPEN_END = (0, FAR, FAR, 0)
SOUND, CUT, LOST = 0, 1, 2  # faults as far as they change costs: none, truncated, blank or duplicate
Costs = tuple[int, int, int, int]


class Row(NamedTuple):
    initial: str
    fault: int


def _edits(row: Row, state: int) -> list[tuple[str, int, int]]:
    """What may be done with a row in a state, in the order of initials: (initial, cost, next state)."""
    out = [("D", DELETE, state)]
    if row.fault != LOST:
        more = TRUNCATED if row.fault == CUT else 0
        to = KEPT.get(row.initial, (None,) * 4)[state]
        if to is not None:
            out.append(("K", KEEP + more, to))
        out.append(("R", REROLE + more, NEXT[state]))
    return out


def _with_inserts(costs: Costs) -> Costs:
    """Costs to go when turns may be put in first; three in a row lead back to where one led."""
    once = [min(costs[s], INSERT + costs[NEXT[s]]) for s in range(4)]
    return tuple(min(once[s], INSERT + once[NEXT[s]]) for s in range(4))


@functools.lru_cache(maxsize=100_000)
def _back(row: Row, costs: Costs) -> Costs:
    """Costs to go before a row from those behind it."""
    return _with_inserts(tuple(min(c + costs[t] for _, c, t in _edits(row, s)) for s in range(4)))


@functools.lru_cache(maxsize=100_000)
def _forth(row: Row, costs: Costs) -> Costs:
    """Costs so far behind a row from those before it."""
    entered = list(costs)
    for _ in range(2):
        for s in range(4):
            entered[NEXT[s]] = min(entered[NEXT[s]], entered[s] + INSERT)
    out = [FAR] * 4
    for s in range(4):
        for _, c, t in _edits(row, s):
            out[t] = min(out[t], entered[s] + c)
    return tuple(out)


def _lowered(costs: Costs) -> tuple[Costs, int]:
    """The vector less its least cost, so that few different vectors are met."""
    least = min(costs)
    return tuple(c - least if c < FAR else FAR for c in costs), least


def _backward(rows: list[Row], lo: int, hi: int, costs: Costs) -> Costs:
    total = 0
    for i in range(hi - 1, lo - 1, -1):
        costs, least = _lowered(_back(rows[i], costs))
        total += least
    return tuple(c + total if c < FAR else FAR for c in costs)


def _forward(rows: list[Row], lo: int, hi: int, state: int) -> Costs:
    costs, total = tuple(0 if s == state else FAR for s in range(4)), 0
    for i in range(lo, hi):
        costs, least = _lowered(_forth(rows[i], costs))
        total += least
    return tuple(c + total if c < FAR else FAR for c in costs)


def _walk(rows: list[Row], lo: int, hi: int, state: int, end: Costs) -> tuple[str, int]:
    """The least audit of a few rows and the state it ends in, by keeping every vector."""
    togo = [end]
    for i in range(hi - 1, lo - 1, -1):
        togo.append(_back(rows[i], togo[-1]))
    togo.reverse()
    audit = []
    for i in range(lo, hi):
        here, behind = togo[i - lo], togo[i - lo + 1]
        while True:
            left = here[state]
            if DELETE + behind[state] == left:
                audit.append("D")
                break
            if INSERT + here[NEXT[state]] == left:
                audit.append("I")
                state = NEXT[state]
                continue
            initial, _, state = next(e for e in _edits(rows[i], state)[1:] if e[1] + behind[e[2]] == left)
            audit.append(initial)
            break
    return "".join(audit), state


def _least(rows: list[Row], lo: int, hi: int, state: int, end: Costs) -> tuple[str, int]:
    end, _ = _lowered(end)
    if hi - lo <= LEAF:
        return _walk(rows, lo, hi, state, end)
    mid = (lo + hi) // 2
    behind = _backward(rows, mid, hi, end)
    before = _forward(rows, lo, mid, state)
    best = min(a + b for a, b in zip(before, behind))
    crossing = tuple(b if a + b == best else FAR for a, b in zip(before, behind))
    first, at = _least(rows, lo, mid, state, crossing)
    second, last = _least(rows, mid, hi, at, end)
    return first + second, last


def least_audit(rows: list[Row], state: int = 0, end: Costs | None = None) -> tuple[int, str, int]:
    """(cost, audit, last state) of a whole conversation from ``state``, or of a block up to the costs ``end``."""
    last = _with_inserts(OPEN_END) if end is None else end
    cost = _backward(rows, 0, len(rows), last)[state]
    if cost >= FAR:
        return FAR, "", state
    audit, at = _least(rows, 0, len(rows), state, last)
    if end is None:
        # What is missing at the end is put in; nothing is, where the rows may end.
        while not OPEN_END[at] == 0:
            audit, at = audit + "I", NEXT[at]
        return cost, audit, at
    return cost - end[at], audit, at


def repaired_rows(audit: str, state: int, rows: list[tuple[str, str]]) -> list[tuple[str, str]]:
    """The turns (role, text) that the edits leave of these rows."""
    out, left = [], iter(rows)
    for edit in audit:
        if edit == "I":
            state = NEXT[state]
            out.append((NAMES[state], ""))
            continue
        role, text = next(left)
        if edit == "K":
            state = KEPT[role[:1]][state]
            out.append((role, text))
        elif edit == "R":
            state = NEXT[state]
            out.append((NAMES[state], text))
    return out


def _last_sign(text: Column) -> Column:
    """The last character that is not a blank; an empty string where there is none."""
    return F.substring(F.rtrim(text, F.lit(" \t\n\x0b\f\r")), -1, 1)


def blocks(rows: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """All rows in order: conv, turn, role, text, ``place`` (their order) and ``block`` (the task that sorted them).

    The table is cut by range, so a long conversation lies in many blocks; rows that are alike in everything are cut
    by a number that tells them apart.
    """
    one_space = F.lit(" ")
    named = rows.select(
        F.col(f"`{conv}`").alias("conv"), F.col(f"`{turn}`").alias("turn"),
        F.coalesce(F.col(f"`{role}`"), one_space).alias("role"), F.coalesce(F.col(f"`{text}`"), one_space).alias("text"),
    )
    order = ["conv", "turn", "role", "text", "__copy"]
    numbered = named.withColumn("__copy", F.monotonically_increasing_id())
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ordered = numbered.repartitionByRange(parts, *order).sortWithinPartitions(*order)
    placed = ordered.select("conv", "turn", "role", "text", F.monotonically_increasing_id().alias("place"))
    return stored(placed.withColumn("block", F.shiftright("place", 33)), "conversation-blocks")


def faults(placed: DataFrame) -> DataFrame:
    """Per row, without texts: conv, turn, place, block, initial, and its first fault as a flag of each kind."""
    key = F.xxhash64("role", "text"), F.hash("text", "role")
    facts = placed.select(
        "conv", "turn", "place", "block", F.substring("role", 1, 1).alias("initial"), (_last_sign(F.col("text")) == "").alias("blank"),
        (~_last_sign(F.col("text")).isin("", ".", "!", "?")).alias("cut"), key[0].alias("h"), key[1].alias("g"),
    )
    # A role and text met once need no partner, so only repeated ones are joined.
    firsts = facts.groupBy("conv", "h", "g").agg(F.min("place").alias("first"), F.count(F.lit(1)).alias("times")).where("times > 1")
    same = [F.col("f.conv").eqNullSafe(F.col("o.conv")), F.col("f.h") == F.col("o.h"), F.col("f.g") == F.col("o.g")]
    joined = facts.alias("f").join(firsts.alias("o"), same, "left")
    again = F.col("o.first").isNotNull() & (F.col("o.first") < F.col("f.place"))
    flagged = joined.select("f.conv", "f.turn", "f.place", "f.block", "f.initial", "f.blank", (again & ~F.col("f.blank")).alias("duplicate"), "f.cut")
    return flagged.withColumn("truncated", F.col("cut") & ~F.col("blank") & ~F.col("duplicate")).drop("cut")


_ROUTES = "array<struct<entry: int, leave: int, cost: long, audit: string>>"
_SOLVED = f"conv long, block long, whole boolean, n long, illegal long, head string, tail string, routes {_ROUTES}"
LEGAL = ("su", "ua", "au")


def _grouped(batches: Iterator[pa.RecordBatch], columns: int) -> Iterator[tuple[tuple, list[tuple]]]:
    """Neighbouring rows that agree in the first ``columns`` columns."""
    key, held = None, []
    for batch in batches:
        for row in zip(*(c.to_pylist() for c in batch.columns)):
            if held and row[:columns] != key:
                yield key, held
                held = []
            key = row[:columns]
            held.append(row)
    if held:
        yield key, held


def _solved_block(rows: list[Row], whole: bool, first: bool, last: bool) -> list[dict]:
    out = []
    for entry in (0,) if first else range(4):
        if last:
            cost, audit, leave = least_audit(rows, entry)
            out.append(dict(entry=entry, leave=leave, cost=cost, audit=audit))
            continue
        for leave in range(4):
            cost, audit, _ = least_audit(rows, entry, tuple(0 if s == leave else FAR for s in range(4)))
            if cost < FAR:
                out.append(dict(entry=entry, leave=leave, cost=cost, audit=audit))
    return out


def _solve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([
        ("conv", pa.int64()), ("block", pa.int64()), ("whole", pa.bool_()), ("n", pa.int64()), ("illegal", pa.int64()), ("head", pa.string()), ("tail", pa.string()),
        ("routes", pa.list_(pa.struct([("entry", pa.int32()), ("leave", pa.int32()), ("cost", pa.int64()), ("audit", pa.string())]))),
    ])
    out: list[dict] = []
    size = 0
    for (conv, block, begin, end), held in _grouped(batches, 4):
        rows = [Row(r[5], LOST if r[6] else CUT if r[7] else SOUND) for r in held]
        initials = [r[5] for r in held]
        illegal = sum(a + b not in LEGAL for a, b in zip(initials, initials[1:]))
        routes = _solved_block(rows, begin == end, block == begin, block == end)
        out.append(dict(conv=conv, block=block, whole=begin == end, n=len(rows), illegal=illegal, head=initials[0], tail=initials[-1], routes=routes))
        size += len(rows)
        if size > 20_000:
            yield pa.RecordBatch.from_pylist(out, schema)
            out, size = [], 0
    if out:
        yield pa.RecordBatch.from_pylist(out, schema)


def chain(blocks: list[dict]) -> tuple[int, str, list[tuple[int, str]]]:
    """(cost, audit, [(entry state, audit) of each block]) of the least way through a conversation's blocks in order."""
    best: dict[int, tuple[int, str, list]] = {}
    for b in reversed(blocks):
        ways: dict[int, tuple[int, str, list]] = {}
        for r in b["routes"]:
            rest = best.get(r["leave"]) if best else (0, "", [])
            if rest is None:
                continue
            way = (r["cost"] + rest[0], r["audit"] + rest[1], [(r["entry"], r["audit"]), *rest[2]])
            if r["entry"] not in ways or way[:2] < ways[r["entry"]][:2]:
                ways[r["entry"]] = way
        best = ways
    return best[0]


def _chained(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([
        ("conv", pa.int64()), ("illegal", pa.int64()), ("cost", pa.int64()), ("audit", pa.string()),
        ("edits", pa.list_(pa.struct([("block", pa.int64()), ("entry", pa.int32()), ("audit", pa.string())]))),
    ])
    for batch in batches:
        out = []
        for conv, held in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            cost, audit, steps = chain(held)
            illegal = sum(b["illegal"] for b in held) + sum(a["tail"] + b["head"] not in LEGAL for a, b in zip(held, held[1:]))
            edits = [dict(block=b["block"], entry=entry, audit=part) for b, (entry, part) in zip(held, steps)]
            out.append(dict(conv=conv, illegal=illegal, cost=cost, audit=audit, edits=edits))
        yield pa.RecordBatch.from_pylist(out, schema)


_REPAIRED = "conv long, block long, pos long, role string, text string"


def _rewritten(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([("conv", pa.int64()), ("block", pa.int64()), ("pos", pa.int64()), ("role", pa.string()), ("text", pa.string())])
    out: list[tuple] = []
    size = 0
    for (conv, block, entry, audit), held in _grouped(batches, 4):
        for pos, (role, text) in enumerate(repaired_rows(audit, entry, [(r[5], r[6]) for r in held])):
            out.append((conv, block, pos, role, text))
            size += len(text) + 64
            if size > 1 << 22:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), schema)], schema=schema)
                out, size = [], 0
    if out:
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), schema)], schema=schema)


def _digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One hash over each conversation's turns; they stream past, a turn at a time."""
    key, sha, done = None, None, []
    for batch in batches:
        for conv, role, text in zip(*(batch.column(i).to_pylist() for i in (0, 3, 4))):
            if sha is None or conv != key:
                if sha is not None:
                    done.append((key, sha.hexdigest()))
                key, sha = conv, hashlib.sha256()
            else:
                sha.update(b"\n")
            sha.update(f"{role}:{text}".encode())
        if len(done) > 10_000:
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in (pa.array([d[0] for d in done], pa.int64()), pa.array([d[1] for d in done]))], ["conv", "sha256"])
            done = []
    if sha is not None:
        done.append((key, sha.hexdigest()))
        yield pa.RecordBatch.from_arrays([pa.array([d[0] for d in done], pa.int64()), pa.array([d[1] for d in done], pa.string())], ["conv", "sha256"])


class Repair(NamedTuple):
    """``conversations``: conv, gaps, blank, duplicate, truncated, illegal, cost, audit. ``turns``: the repaired turns in
    the order of (conv, block, pos)."""

    conversations: DataFrame
    turns: DataFrame


def repair(rows: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> Repair:
    """Repair all conversations; ids are whole numbers."""
    placed = blocks(rows, conv, turn, role, text)
    flagged = stored(faults(placed), "conversation-faults")
    turns = flagged.groupBy("conv", "turn").agg(F.min("block").alias("begin"), F.max("block").alias("end"), *[F.count_if(k).alias(k) for k in ("blank", "duplicate", "truncated")])
    gaps = F.coalesce(F.max("turn") - F.min("turn") + 1 - F.count("turn"), F.lit(0))
    facts = turns.groupBy("conv").agg(gaps.alias("gaps"), F.min("begin").alias("begin"), F.max("end").alias("end"), *[F.sum(k).alias(k) for k in ("blank", "duplicate", "truncated")])
    facts = stored(facts, "conversation-facts")
    spans = facts.select("conv", "begin", "end")
    lost = (F.col("blank") | F.col("duplicate")).alias("lost")
    known = flagged.alias("f").join(spans.alias("s"), F.col("f.conv").eqNullSafe(F.col("s.conv")))
    sorted_facts = (
        known.select("f.conv", "f.block", "s.begin", "s.end", "f.place", "f.initial", lost, "f.truncated")
        .repartition(F.col("conv"), F.col("block")).sortWithinPartitions("conv", "block", "place")
    )
    solved = sorted_facts.mapInArrow(_solve, _SOLVED)
    by_conversation = solved.groupBy("conv").agg(F.sort_array(F.collect_list(F.struct("block", "illegal", "head", "tail", "routes"))).alias("blocks"))
    chained = stored(by_conversation.mapInArrow(_chained, "conv long, illegal long, cost long, audit string, edits array<struct<block: long, entry: int, audit: string>>"), "conversation-audits")
    out = facts.alias("f").join(chained.alias("c"), F.col("f.conv").eqNullSafe(F.col("c.conv")))
    conversations = out.select("f.conv", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit")
    edits = chained.select("conv", F.explode("edits").alias("e")).select("conv", "e.block", "e.entry", "e.audit")
    edited = placed.alias("p").join(edits.alias("e"), F.col("p.conv").eqNullSafe(F.col("e.conv")) & (F.col("p.block") == F.col("e.block")))
    ordered = edited.select("p.conv", "p.block", "e.entry", "e.audit", "p.place", "p.role", "p.text").repartition(F.col("conv"), F.col("block")).sortWithinPartitions("conv", "block", "place")
    return Repair(conversations, ordered.mapInArrow(_rewritten, _REPAIRED))


def digests(turns: DataFrame) -> DataFrame:
    """conv, sha256 of the newline-joined ``role:text`` of the repaired turns.

    One hash has to see a conversation's bytes in order, so they pass through one task, sorted on disk, never held.
    """
    return turns.repartition(F.col("conv")).sortWithinPartitions("conv", "block", "pos").mapInArrow(_digest, "conv long, sha256 string")
