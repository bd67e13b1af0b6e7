"""Repair of conversation structure: the cheapest edits that make turns alternate.

A conversation should read (system)? (user assistant)+, or be empty. Rows may be kept, given another role, deleted, and
empty turns inserted, at the costs below; blank and repeated rows must go. Of all cheapest edits the audit (one letter a
step: D, I, K, R) that is least in ASCII order is taken.

* Rows are dealt out by conversation and sorted by turn, last turn first, and streamed: the dynamic program runs from
  the end, carrying the cost to go of its four states from one Arrow batch to the next. A row leaves one byte, the best
  edit of each state. Read from the first row on, these bytes give the least audit letter by letter.
* A conversation of up to ``hold_bytes`` is finished when its first row has come. A larger one gives its bytes away in
  blocks, as rows of a table in the shared folder, and a second stream, first turn first, walks rows and blocks together
  and hashes as it goes. So a task's memory is bounded by a batch, the held texts and a block, whatever a
  conversation's length; only the audit itself is a value of the conversation's length.
* Repeated rows are found by a count per (conversation, role, text) that combines before its shuffle.

Defined results: null roles and texts are one space; a null turn comes first; rows of equal turn are ordered by role and
text; a null conversation id is one conversation; equal rows repeat each other; a role's first letter counts, and roles
without one fit nowhere; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
from collections import deque
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voltide.llm.decontam import small
from voltide.session import cut_lineage

EDITS = "DIKR"
START, SYSTEM, USER, ASSISTANT = range(4)            # what was read last
KEEP = {(START, "s"): SYSTEM, (START, "u"): USER, (SYSTEM, "u"): USER, (USER, "a"): ASSISTANT, (ASSISTANT, "u"): USER}
NEXT = (USER, USER, ASSISTANT, USER)                 # state after an inserted turn or a new role
ROLE = {USER: "user", ASSISTANT: "assistant"}
RENAME, DELETE, INSERT, CUT_SHORT = 2, 3, 2, 1
AT_END = (0, 2 * INSERT, INSERT, 0)
NEVER = 1 << 60
SOLID = re.compile(r"[^\x20\x09-\x0D]")
HOLD_BYTES, BLOCK_ROWS = 1 << 22, 1 << 16
COUNTS = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")
OUT = ("ck string, kind string, " + ", ".join(f"{c} bigint" for c in COUNTS) +
       ", audit string, repaired_sha256 string, block int, pointers binary, position bigint, edit string, turn bigint, role string, text string")
OUT_NAMES = [x.split()[0] for x in OUT.split(", ")]


def fault(text: str, repeated: bool) -> str:
    if not SOLID.search(text):
        return "blank"
    if repeated:
        return "duplicate"
    last = next((c for c in reversed(text) if SOLID.match(c)), "")
    return "" if last in ".!?" else "truncated"


@lru_cache(maxsize=1 << 16)
def step(togo: tuple[int, ...], initial: str, flaw: str) -> tuple[int, tuple[int, ...]]:
    """(pointer byte, costs to go before the row) from the costs to go after it."""
    stays = flaw not in ("blank", "duplicate")
    extra = CUT_SHORT if flaw == "truncated" else 0
    options = []
    for s in range(4):
        to = KEEP.get((s, initial))
        options.append({"D": DELETE + togo[s], "K": extra + togo[to] if stays and to is not None else NEVER,
                        "R": RENAME + extra + togo[NEXT[s]] if stays else NEVER})
    plain = [min(o.values()) for o in options]
    two, three = min(plain[USER], INSERT + plain[ASSISTANT]), min(plain[ASSISTANT], INSERT + plain[USER])
    best = (min(plain[START], INSERT + two), min(plain[SYSTEM], INSERT + two), two, three)
    byte = 0
    for s in range(4):
        options[s]["I"] = INSERT + best[NEXT[s]]
        byte |= next(i for i, e in enumerate(EDITS) if options[s][e] == best[s]) << 2 * s
    return byte, best


class Backward:
    """The dynamic program over one conversation, last row first."""

    def __init__(self) -> None:
        self.base, self.togo = 0, AT_END
        self.pointers = bytearray()
        self.counts = dict.fromkeys(COUNTS, 0)
        self.later: str | None = None
        self.turns: list[int] = []                   # distinct turns: greatest, least
        self.distinct = 0

    def row(self, turn: int | None, role: str, text: str, repeated: bool) -> None:
        flaw, initial = fault(text, repeated), role[:1]
        if flaw:
            self.counts[flaw] += 1
        if self.later is not None and initial + self.later not in ("su", "ua", "au"):
            self.counts["illegal"] += 1
        self.later = initial
        if turn is not None and (not self.turns or turn != self.turns[1]):
            self.turns = [self.turns[0] if self.turns else turn, turn]
            self.distinct += 1
        byte, best = step(self.togo, initial if initial in ("s", "u", "a") else "", flaw)
        low = min(best)                              # kept apart, so that few cost patterns arise
        self.base, self.togo = self.base + low, tuple(c - low for c in best)
        self.pointers.append(byte)

    def finish(self) -> dict[str, int]:
        self.counts["gaps"] = self.turns[0] - self.turns[1] + 1 - self.distinct if self.turns else 0
        self.counts["cost"] = self.base + self.togo[START]
        return self.counts


class Forward:
    """Walks the pointer bytes from the first row on."""

    def __init__(self, keep_turns: bool) -> None:
        self.state, self.audit, self.sha, self.any = START, bytearray(), hashlib.sha256(), False
        self.turns: list[tuple[str, str, str]] | None = [] if keep_turns else None
        self.position = 0

    def say(self, edit: str, role: str, text: str) -> None:
        self.sha.update(("\n" if self.any else "").encode() + f"{role}:{text}".encode("utf-8", "surrogatepass"))
        self.any = True
        if self.turns is not None:
            self.turns.append((edit, role, text))

    def insert(self) -> None:
        self.state = NEXT[self.state]
        self.audit += b"I"
        self.say("I", ROLE[self.state], "")

    def row(self, byte: int, role: str, text: str) -> None:
        while (edit := EDITS[byte >> 2 * self.state & 3]) == "I":
            self.insert()
        self.audit += edit.encode()
        if edit == "K":
            self.state = KEEP[self.state, role[:1]]
            self.say("K", role, text)
        elif edit == "R":
            self.state = NEXT[self.state]
            self.say("R", ROLE[self.state], text)

    def finish(self) -> None:
        while self.state in (SYSTEM, USER):
            self.insert()


def out_row(**values) -> dict:
    return dict.fromkeys(OUT_NAMES) | values


def spoken(ck: str, walk: Forward) -> Iterator[dict]:
    for edit, role, text in walk.turns or ():
        yield out_row(ck=ck, kind="turn", position=walk.position, edit=edit, role=role, text=text)
        walk.position += 1
    if walk.turns:
        walk.turns.clear()


def packed(rows: Iterator[dict], size: int = 4096, most: int = 1 << 22) -> Iterator[pd.DataFrame]:
    held, weight = [], 0
    for r in rows:
        held.append(r)
        weight += len(r["text"] or "") + len(r["audit"] or "") + len(r["pointers"] or b"")
        if len(held) >= size or weight > most:
            yield pd.DataFrame(held, columns=OUT_NAMES).astype(object)
            held, weight = [], 0
    if held:
        yield pd.DataFrame(held, columns=OUT_NAMES).astype(object)


def backward_stream(hold_bytes: int, block_rows: int, keep_turns: bool):
    """Rows sorted by ck and descending turn -> a report a conversation, and blocks of pointers of the large ones."""
    def conversation_rows(batches: Iterator[pd.DataFrame]) -> Iterator[dict]:
        ck, work, held, weight, block, waiting = None, None, [], 0, 0, None

        def take(row: tuple, follower: tuple | None) -> Iterator[dict]:
            nonlocal held, weight, block
            _, turn, role, text, is_first = row
            again = not is_first or (follower is not None and follower[1:4] == row[1:4])
            number = None if turn is None else int(turn)
            work.row(number, role, text, again)
            if held is not None:
                held.append((role, text))
                weight += len(role) + len(text) + 100
                if weight > hold_bytes:
                    held = None
            if held is None and len(work.pointers) >= block_rows:
                yield flush(number, role, text)

        def flush(turn: int | None, role: str, text: str) -> dict:
            nonlocal block
            block += 1
            bytes_, work.pointers = bytes(work.pointers[::-1]), bytearray()
            return out_row(ck=ck, kind="block", block=block, pointers=bytes_, turn=turn, role=role, text=text)

        def close(last: tuple) -> Iterator[dict]:
            counts = work.finish()
            if held is None:
                if work.pointers:
                    yield flush(None if last[1] is None else int(last[1]), last[2], last[3])
                yield out_row(ck=ck, kind="large", **counts)
                return
            walk = Forward(keep_turns)
            for byte, (role, text) in zip(reversed(work.pointers), reversed(held)):
                walk.row(byte, role, text)
            walk.finish()
            yield from spoken(ck, walk)
            yield out_row(ck=ck, kind="report", audit=walk.audit.decode(), repaired_sha256=walk.sha.hexdigest(), **counts)

        for b in batches:
            for row in b.itertuples(index=False, name=None):
                if waiting is not None:
                    same = row[0] == ck
                    yield from take(waiting, row if same else None)
                    if not same:
                        yield from close(waiting)
                if waiting is None or row[0] != ck:
                    ck, work, held, weight, block = row[0], Backward(), [], 0, 0
                waiting = row
        if waiting is not None:
            yield from take(waiting, None)
            yield from close(waiting)

    return lambda batches: packed(conversation_rows(batches))


def forward_stream(keep_turns: bool):
    """Rows and blocks sorted by ck, ascending turn, blocks before the rows they begin with -> audits and digests."""
    def walked(batches: Iterator[pd.DataFrame]) -> Iterator[dict]:
        ck, walk, queue, at = None, None, deque(), 0

        def close() -> Iterator[dict]:
            walk.finish()
            yield from spoken(ck, walk)
            yield out_row(ck=ck, kind="report", audit=walk.audit.decode(), repaired_sha256=walk.sha.hexdigest())

        for b in batches:
            for name, role, text, pointers in b.itertuples(index=False, name=None):
                if name != ck:
                    if walk is not None:
                        yield from close()
                    ck, walk, queue, at = name, Forward(keep_turns), deque(), 0
                if pointers is not None:
                    queue.append(pointers)
                    continue
                walk.row(queue[0][at], role, text)
                at += 1
                if at == len(queue[0]):
                    queue.popleft()
                    at = 0
                yield from spoken(ck, walk)
        if walk is not None:
            yield from close()

    return lambda batches: packed(walked(batches))


def _repaired(turns: DataFrame, hold_bytes: int, block_rows: int, keep_turns: bool) -> DataFrame:
    space = F.lit(" ")
    rows = turns.select(
        F.coalesce(F.concat(F.lit("c"), F.col("conv_id").cast("string")), F.lit("n")).alias("ck"), F.col("turn").cast("bigint").alias("turn"),
        F.coalesce("role", space).alias("role"), F.coalesce("text", space).alias("text"))
    said = F.sha2(F.concat("role", F.lit("\n"), "text"), 256)
    order = F.struct(F.col("turn").isNotNull().alias("given"), F.col("turn").alias("turn"))
    repeated = cut_lineage(rows.groupBy("ck", said.alias("said")).agg(F.min(order).alias("first"), F.count("*").alias("n")).where("n > 1").drop("n"))
    marked = rows.withColumn("said", said).join(small(repeated), ["ck", "said"], "left").withColumn(
        "is_first", F.expr("first IS NULL OR first.turn <=> turn")).select("ck", "turn", "role", "text", "is_first")
    down = [F.col("ck"), F.col("turn").desc_nulls_last(), F.col("role").desc(), F.col("text").desc()]
    first = cut_lineage(marked.repartition("ck").sortWithinPartitions(*down)
                        .select("ck", F.col("turn").cast("string").alias("turn"), "role", "text", "is_first")
                        .mapInPandas(backward_stream(hold_bytes, block_rows, keep_turns), OUT))
    large = first.where("kind = 'large'").select("ck", *COUNTS)
    if large.isEmpty():
        return first
    blocks = first.where("kind = 'block'").select("ck", "turn", "role", "text", "pointers", "block")
    again = rows.join(small(large.select("ck")), "ck", "left_semi").selectExpr(
        "ck", "turn", "role", "text", "CAST(NULL AS BINARY) AS pointers", "CAST(NULL AS INT) AS block")
    up = [F.col("ck"), F.col("turn").asc_nulls_first(), F.col("role"), F.col("text"), F.col("block").desc_nulls_last()]
    second = cut_lineage(blocks.unionByName(again).repartition("ck").sortWithinPartitions(*up)
                         .select("ck", "role", "text", "pointers").mapInPandas(forward_stream(keep_turns), OUT))
    counted = second.where("kind = 'report'").drop(*COUNTS).join(large, "ck").select(*OUT_NAMES)
    return first.where("kind IN ('report', 'turn')").unionByName(second.where("kind = 'turn'")).unionByName(counted)


def _conv_id(turns: DataFrame):
    return F.expr(f"CASE WHEN ck <> 'n' THEN CAST(substring(ck, 2) AS {dict(turns.dtypes)['conv_id']}) END").alias("conv_id")


def repair_report(turns: DataFrame, hold_bytes: int = HOLD_BYTES, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """One row per conversation of ``turns`` (conv_id, turn, role, text): counts, cost, audit and repaired_sha256."""
    found = _repaired(turns, hold_bytes, block_rows, False).where("kind = 'report'")
    return found.select(_conv_id(turns), *COUNTS, "audit", "repaired_sha256")


def repaired_turns(turns: DataFrame, hold_bytes: int = HOLD_BYTES, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """The turns left and inserted: conv_id, position, edit (K, R or I), role and text."""
    found = _repaired(turns, hold_bytes, block_rows, True).where("kind = 'turn'")
    return found.select(_conv_id(turns), "position", "edit", "role", "text")
