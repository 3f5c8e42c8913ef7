"""Repair of conversations at least cost, as one sorted stream per conversation.

A repaired conversation's role initials read ``(s?(ua)+)?``.  Keeping a row costs 0, giving it
the role user or assistant 2, deleting it 3, inserting an empty user or assistant row
anywhere 2; a truncated row that isn't deleted adds 1.  Blank rows (no character but white
space) and repeats (role and text seen earlier in the conversation) have to be deleted.
Of the cheapest repairs the one is taken whose edits' initials (D, I, K, R, in order)
are the least string; role letters follow from the edits, so it is one repair.

Rows are dealt by conversation and sorted by turn, last turn first.  The dynamic program's
state, the cost still to come from each of four places in the pattern, is carried across
the batches; a row adds one byte, its best edit from each place.  These bytes, with roles and texts, are
a stack that spills to a file beyond ``SPILL`` bytes.  At the conversation's first turn
the stack is read back, which is the order of the turns, and following the edits gives the
least repair.  So a conversation with a third of all rows streams through one task with bounded
memory.  The file has no name and belongs to the task, like Spark's own spills: a task that is run
again makes its own.  What needs all rows of a conversation at once, repeats, is found by a
window over the same partitioning.

Cases: rows (conversation, turn, role, text) are taken by turn, null turns first, equal turns by
role, then text; a null role or text counts as empty, and a row with neither stands
for its conversation only: a conversation of such rows has zeros, an empty audit and the
digest of nothing.  Rows with a null conversation are a conversation.  No rows give no rows; other
columns are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
import pickle
import tempfile
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Bytes of roles and texts that a stack holds in memory.
SPILL = 16 << 20
_WHITE = " \t\n\x0b\f\r"
BLANK, REPEAT, TRUNCATED, NO_TURN = 1, 2, 3, 4

# Places in the pattern: before all, after s, after u, after a.  _NEXT and _ROLE: of an inserted or renamed row.
_STEP = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (2, "a"): 3, (3, "u"): 2}
_NEXT = (2, 2, 3, 2)
_ROLE = ("user", "user", "assistant", "user")
_END = (0, 4, 2, 0)
_EDITS = "DIKR"
_LEGAL = {"su", "ua", "au"}

REPORT = "key string, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"
TURNS = "key string, at long, edit string, role string, text string"


class Stack:
    """Rows put on and taken off again, last first."""

    def __init__(self):
        self.held, self.bytes, self.file, self.parts = [], 0, None, []

    def push(self, row: tuple[int, str, str]) -> None:
        self.held.append(row)
        self.bytes += 64 + len(row[1]) + 4 * len(row[2])
        if self.bytes > SPILL:
            if self.file is None:
                self.file = tempfile.TemporaryFile()
            self.parts.append(self.file.tell())
            pickle.dump(self.held, self.file, pickle.HIGHEST_PROTOCOL)
            self.held, self.bytes = [], 0

    def drain(self) -> Iterator[tuple[int, str, str]]:
        yield from reversed(self.held)
        for at in reversed(self.parts):
            self.file.seek(at)
            yield from reversed(pickle.load(self.file))
        if self.file is not None:
            self.file.close()


def step(cost: tuple, letter: str, fault: int) -> tuple[tuple, int]:
    """Costs before a row from the costs after it, and its best edit from each place, two bits each."""
    after = 1 if fault == TRUNCATED else 0
    options = []
    for q in range(4):
        delete = 3 + cost[q]
        if fault in (BLANK, REPEAT):
            options.append((delete, None, None))
            continue
        to = _STEP.get((q, letter))
        options.append((delete, None if to is None else after + cost[to], 2 + after + cost[_NEXT[q]]))
    own = [min(x for x in o if x is not None) for o in options]
    best = [0, 0, min(own[2], 2 + own[3]), min(own[3], 2 + own[2])]
    best[0], best[1] = min(own[0], 2 + best[2]), min(own[1], 2 + best[2])
    code = 0
    for q, (delete, keep, _) in enumerate(options):
        edit = 0 if best[q] == delete else 1 if best[q] == 2 + best[_NEXT[q]] else 2 if best[q] == keep else 3
        code |= edit << (2 * q)
    return tuple(best), code


def walk(stack: Stack) -> Iterator[tuple[str, str | None, str | None]]:
    """(edit, role, text) in the order of the turns; a deleted row has the role and text that it had."""
    q = 0
    for code, role, text in stack.drain():
        while (edit := code >> (2 * q) & 3) == 1:
            yield "I", _ROLE[q], ""
            q = _NEXT[q]
        if edit == 3:
            yield "R", _ROLE[q], text
            q = _NEXT[q]
        else:
            yield _EDITS[edit], role, text
            q = _STEP[q, role[:1]] if edit == 2 else q
    while _END[q]:
        yield "I", _ROLE[q], ""
        q = _NEXT[q]


class Conversation:
    """What is carried from batch to batch of one conversation, from its last row to its first."""

    def __init__(self):
        self.cost, self.stack, self.later = _END, Stack(), None
        self.faults, self.illegal, self.turns, self.last, self.first = [0] * 4, 0, 0, None, None

    def row(self, turn: str | None, role: str, text: str, fault: int) -> None:
        letter = role[:1]
        self.faults[fault] += 1
        if self.later is not None and letter + self.later not in _LEGAL:
            self.illegal += 1
        self.later = letter
        if turn is not None and turn != self.first:
            self.last, self.first, self.turns = turn if self.last is None else self.last, turn, self.turns + 1
        self.cost, code = step(self.cost, letter, fault)
        self.stack.push((code, role, text))

    def gaps(self) -> int:
        return int(self.last) - int(self.first) + 1 - self.turns if self.turns else 0


def _report(key: str | None, c: Conversation) -> Iterator[tuple]:
    audit, digest, some = bytearray(), hashlib.sha256(), False
    for edit, role, text in walk(c.stack):
        audit += edit.encode()
        if edit != "D":
            digest.update(f"{chr(10) if some else ''}{role}:{text}".encode())
            some = True
    yield key, c.gaps(), *c.faults[1:], c.illegal, c.cost[0], audit.decode(), digest.hexdigest()


def _turns(key: str | None, c: Conversation) -> Iterator[tuple]:
    at = 0
    for edit, role, text in walk(c.stack):
        yield key, at, edit, role, text
        at += 1


def _streamed(told: Callable, schema: str):
    names = [x.split()[0] for x in schema.split(", ")]
    text_at = names.index("text") if "text" in names else None

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, now, out, size = None, None, [], 0
        for b in batches:
            if not len(b):
                continue
            columns = [[None if x is None or x != x else x for x in b[c].tolist()] for c in ("key", "turn", "role", "text")]
            for k, turn, role, text, fault in zip(*columns, b["fault"].tolist()):
                if now is None or k != key:
                    for row in told(key, now) if now is not None else ():
                        out.append(row)
                        size += 64 + (len(row[text_at] or "") if text_at is not None else 0)
                        if size > SPILL:
                            yield pd.DataFrame(out, columns=names)
                            out, size = [], 0
                    key, now = k, Conversation()
                if fault != NO_TURN:
                    now.row(turn, role or "", text or "", fault)
        for row in told(key, now) if now is not None else ():
            out.append(row)
            size += 64 + (len(row[text_at] or "") if text_at is not None else 0)
            if size > SPILL:
                yield pd.DataFrame(out, columns=names)
                out, size = [], 0
        if out:
            yield pd.DataFrame(out, columns=names)
    return run


def _sorted(rows: DataFrame) -> DataFrame:
    """(key, turn, role, text, fault) with each conversation in one partition, last row first."""
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    said = rows.select("conversation", F.col("turn").cast("long").alias("turn"), role.alias("role"), text.alias("text"),
                       (F.col("role").isNull() & F.col("text").isNull()).alias("none")).repartition("conversation")
    same = Window.partitionBy("conversation", "none", F.sha2(F.concat("role", F.lit("\0"), "text"), 256)).orderBy(F.asc_nulls_first("turn"))
    end = F.rtrim("text", F.lit(_WHITE))
    fault = (F.when(F.col("none"), NO_TURN).when(end == "", BLANK).when(F.col("nth") > 1, REPEAT)
             .when(~F.right(end, F.lit(1)).isin(".", "!", "?"), TRUNCATED).otherwise(0))
    order = ["conversation", F.desc_nulls_last("turn"), F.desc("role"), F.desc("text"), F.desc("nth")]
    return said.withColumn("nth", F.row_number().over(same)).sortWithinPartitions(*order).select(
        F.col("conversation").cast("string").alias("key"), F.col("turn").cast("string").alias("turn"), "role", "text", fault.cast("int").alias("fault"))


def _done(rows: DataFrame, told: Callable, schema: str) -> DataFrame:
    kind = rows.schema["conversation"].dataType
    out = _sorted(rows).mapInPandas(_streamed(told, schema), schema)
    return out.select(F.col("key").cast(kind).alias("conversation"), *out.columns[1:])


def audits(rows: DataFrame) -> DataFrame:
    """One row per conversation: gaps between its turns, rows by first fault, illegal neighbours, cost,
    audit (edits in order) and the digest of the repaired ``role:text`` lines, taken as they stream by."""
    return _done(rows, _report, REPORT)


def repaired(rows: DataFrame) -> DataFrame:
    """(conversation, at, edit, role, text): all edits in order; those but D are the repaired conversation."""
    return _done(rows, _turns, TURNS)
