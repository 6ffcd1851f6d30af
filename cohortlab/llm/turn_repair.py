"""Conversation structure repair by Wagner-Fischer target alignment (operator 13).

The turns of a conversation are aligned with each feasible length of the
grammar string ``(s?(ua)+)?``: an optional kept system turn, then user and
assistant in turn; nothing at all is legal too.  Keep costs 0, Rerole (to user
or assistant) 3, Delete 4, Insert (a user or assistant turn without text) 3; a
blank or duplicate turn must be deleted, a truncated one that stays costs 3
more.  A greedy repair gives the incumbent cost, and its slack over what every
repair pays bounds the band of cells that can matter (Ukkonen).  All targets
end alike, so one banded table, filled from the last turn backwards, holds the
cost of every length; each cheapest length is backtraced, taking the
ASCII-least edit at each cell, and the least audit of all lengths wins.  The
table keeps every b-th row and recomputes the rows between while backtracing,
so memory grows with the band and the square root of the turns.

Spark finds the faults, orders the turns and carries the texts: the alignment
reads a few bytes a turn (role initial, fault), streamed per conversation, and
gives back one row an edit; texts join those rows and are hashed in order, one
at a time.  No text of a whole conversation is held in memory.

Defined results: null roles and texts are one space, a null conversation id is
a conversation; turns order by (turn, nulls first; role; digest of the text),
so repeated rows stand side by side; an empty table gives no rows; other
columns are not read, whatever their names.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cohortlab.llm.common import written

KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 3, 4, 3, 3
FINE, CUT, GONE = 0, 1, 2                  # a turn may stay; may stay at a price; must go
BLANK_FREE = r"[^\x20\x09-\x0D]"
EDITS = ("conv string, seq long, source long, edit string, role string, blank long, duplicate long, truncated long, "
         "illegal long, cost long")
FAR = np.int64(1) << 40
KEPT_CELLS = 1 << 20                        # tables up to this size are kept whole


# ------------------------------------------------------------- the alignment

def _wanted(r):
    """Initial of the target turn with ``r`` turns left to the end, itself included."""
    return "u" if r % 2 == 0 else "a"


def incumbent(initials: str, faults) -> int:
    """Cost of a greedy repair: keep what fits, insert a missing turn before one that does not."""
    cost, want, system_ok = 0, "u", True
    for c, f in zip(initials, faults):
        if f == GONE:
            cost += DELETE
            continue
        cost += TRUNCATED * (f == CUT)
        if c == "s" and system_ok:
            system_ok = None                 # a system turn alone needs two turns after it
            continue
        if c not in "ua" or not c:
            cost += REROLE
        elif c != want:
            cost += INSERT
            want = "a" if want == "u" else "u"
        want, system_ok = ("a" if want == "u" else "u"), False
    if want == "a":
        cost += INSERT
    elif system_ok is None:
        cost += 2 * INSERT
    return min(cost, DELETE * len(initials))


class BandedTable:
    """Least cost of aligning turns i.. with the last r target turns, in the band the incumbent leaves."""

    def __init__(self, initials: list[str], faults):
        n = self.n = len(initials)
        self.initials, self.faults = initials, np.asarray(faults, dtype=np.int64)
        gone, cut = self.faults == GONE, self.faults == CUT
        self.cost_bound = incumbent(initials, self.faults)
        slack = max(0, self.cost_bound - DELETE * int(gone.sum()) - TRUNCATED * int(cut.sum()))
        dear = slack - int(cut.sum())        # deleting a truncated turn costs one more than leaving it
        self.less = slack if dear <= 0 else int(cut.sum()) + dear // DELETE
        self.more = slack // INSERT
        left = np.concatenate([np.cumsum((~gone)[::-1])[::-1], [0]])      # turns from i on that may stay
        self.base = left - self.less         # r of the band's first cell in row i
        self.width = self.less + self.more + 1
        self.step = 1 if n * self.width <= KEPT_CELLS else max(1, int(np.sqrt(n)))
        self.rows = {}
        self.block = {}
        row = self.last_row()
        self.rows[n] = row
        for i in range(n - 1, -1, -1):
            row = self.row_before(i, row)
            if i % self.step == 0:
                self.rows[i] = row

    def last_row(self):
        r = self.base[self.n] + np.arange(self.width)
        return np.where(r >= 0, INSERT * r, FAR)

    def row_before(self, i: int, below):
        """Row i from row i+1."""
        r = self.base[i] + np.arange(self.width)
        shift = int(self.base[i] - self.base[i + 1])                      # 0 or 1
        same_r = np.full(self.width, FAR)                                 # below[r]
        same_r[:self.width - shift] = below[shift:]
        row = same_r + DELETE
        if self.faults[i] != GONE:
            prev_r = same_r.copy()                                        # below[r - 1]
            if shift == 0:
                prev_r[1:], prev_r[0] = below[:-1], FAR
            else:
                prev_r = below.copy()
            c = self.initials[i]
            fits = (r % 2 == 0) if c == "u" else (r % 2 == 1) if c == "a" else np.zeros(self.width, bool)
            row = np.minimum(row, np.where(r >= 1, prev_r + np.where(fits, KEEP, REROLE) + TRUNCATED * int(self.faults[i] == CUT), FAR))
        row = np.where(r >= 0, row, FAR)
        run = np.minimum.accumulate(row - INSERT * r)                     # insert before turn i
        return np.minimum(np.where(r >= 0, run + INSERT * r, FAR), FAR)

    def row(self, i: int):
        if i in self.rows:
            return self.rows[i]
        if i not in self.block:              # recompute the rows of this block
            self.block = {}
            end = min(self.n, (i // self.step + 1) * self.step)
            row = self.rows[end]
            for j in range(end - 1, i // self.step * self.step, -1):
                row = self.block[j] = self.row_before(j, row)
        return self.block[i]

    def at(self, i: int, r: int) -> int:
        x = r - int(self.base[i])
        return int(self.row(i)[x]) if 0 <= x < self.width else int(FAR)

    def lengths(self, i: int):
        """Every even target length reachable from turn i with its cost."""
        row, base = self.row(i), int(self.base[i])
        return [(base + x, int(row[x])) for x in range(self.width) if base + x >= 0 and (base + x) % 2 == 0 and row[x] < FAR]

    def trace(self, i: int, r: int) -> str:
        """The ASCII-least audit among the cheapest alignments of turns i.. with r target turns."""
        out = []
        while i < self.n or r > 0:
            here = self.at(i, r)
            if i < self.n and self.at(i + 1, r) + DELETE == here:
                out.append("D")
                i += 1
            elif r >= 1 and self.at(i, r - 1) + INSERT == here:
                out.append("I")
                r -= 1
            else:
                out.append("K" if self.initials[i] == _wanted(r) else "R")
                i, r = i + 1, r - 1
        return "".join(out)


def repair(initials: list[str], faults) -> tuple[int, str, bool]:
    """(cost, audit, whether the first edit that is no deletion keeps a system turn)."""
    if not initials:
        return 0, "", False
    table = BandedTable(initials, faults)
    starts = [(cost, 0, r, -1) for r, cost in table.lengths(0)]
    for k, c in enumerate(initials):         # a kept system turn; what stands before it is deleted
        if DELETE * k > table.cost_bound:
            break
        if c == "s" and faults[k] != GONE:
            head = DELETE * k + TRUNCATED * (faults[k] == CUT)
            starts += [(head + cost, k + 1, r, k) for r, cost in table.lengths(k + 1) if r >= 2]
    least = min(s[0] for s in starts)
    audit, system = min((("D" * k + "K" if k >= 0 else "") + table.trace(i, r), k >= 0) for cost, i, r, k in starts if cost == least)
    return least, audit, system


def edit_rows(conv, audit: str, system: bool):
    """One row an edit: the turn it reads (none for an insertion) and, unless kept, the role it writes."""
    at, out = 0, 0
    for seq, e in enumerate(audit):
        role = None
        if e != "D":
            place = out - system             # place after an optional system turn
            if e in "RI":
                role = "user" if place % 2 == 0 else "assistant"
            out += 1
        yield conv, seq, (None if e == "I" else at), e, role
        at += e != "I"


# ------------------------------------------------------------- Spark stages

def damage(df: DataFrame) -> DataFrame:
    """The contract's damage by crc32 of ``conv_id:turn``: 0 drops a row, 1 empties its text, 2 removes its end marks,
    3 repeats it, 4 makes it the user's.  Nulls are one space."""
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(text("conv_id"), F.lit(":"), text("turn")).cast("binary")) % 20
    rows = df.select("conv_id", "turn", text("role").alias("role"), text("text").alias("text"), kind.alias("kind")).where("kind <> 0")
    changed = F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    return rows.select("conv_id", "turn", F.when(F.col("kind") == 4, "user").otherwise(F.col("role")).alias("role"), changed.alias("text"),
                       F.explode(F.array_repeat(F.lit(0), F.when(F.col("kind") == 3, 2).otherwise(1))).alias("copy")).drop("copy")


def conv_key(c: Column) -> Column:
    """A text that tells a null id from every id."""
    return F.coalesce(F.concat(F.lit("="), c.cast("string")), F.lit(""))


def ordered_turns(df: DataFrame) -> DataFrame:
    """Turns of (conv_id, turn, role, text) numbered from 0 in each conversation, written once in the shared folder."""
    last = F.regexp_extract("text", r"(?s)([^\x20\x09-\x0D])[\x20\x09-\x0D]*\z", 1)
    base = df.select(conv_key(F.col("conv_id")).alias("conv"), "turn", F.coalesce(F.col("role"), F.lit(" ")).alias("role"),
                     F.coalesce(F.col("text"), F.lit(" ")).alias("text"))
    keyed = base.withColumn("print", F.unhex(F.md5(F.concat(F.length("role").cast("string"), F.lit(":"), "role", "text").cast("binary"))))
    order = Window.partitionBy("conv").orderBy(F.asc_nulls_first("turn"), "role", "print")
    return written(keyed.withColumn("at", F.row_number().over(order).cast("long") - 1)
                   .withColumn("blank", ~F.col("text").rlike(BLANK_FREE)).withColumn("open", ~last.rlike("[.!?]")), "turns")


def _conversations(batches, columns):
    """Group a stream sorted by conversation: (conv, per-column lists), narrow columns only."""
    conv, held = None, None
    for b in batches:
        names = b.column("conv").to_pylist()
        rest = [b.column(c).to_pylist() for c in columns]
        start = 0
        for i in range(1, len(names) + 1):
            if i == len(names) or names[i] != names[start]:
                if conv is not None and conv != names[start]:
                    yield conv, held
                    held = None
                conv = names[start]
                held = held or [[] for _ in columns]
                for h, r in zip(held, rest):
                    h.extend(r[start:i])
                start = i
    if conv is not None:
        yield conv, held


def _pack(rows, schema):
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)


def _align(batches):
    """Arrow task: for each conversation one row an edit and, with seq -1, its summary."""
    schema = pa.schema([("conv", pa.string()), ("seq", pa.int64()), ("source", pa.int64()), ("edit", pa.string()), ("role", pa.string()),
                        ("blank", pa.int64()), ("duplicate", pa.int64()), ("truncated", pa.int64()), ("illegal", pa.int64()),
                        ("cost", pa.int64())])
    rows: list = []
    for conv, (initials, blanks, opens, prints) in _conversations(batches, ["initial", "blank", "open", "print"]):
        seen: set = set()
        faults, counts = [], [0, 0, 0]
        for b, o, p in zip(blanks, opens, prints):
            kind = 0 if b else 1 if p in seen else 2 if o else None
            seen.add(p)
            if kind is not None:
                counts[kind] += 1
            faults.append(FINE if kind is None else CUT if kind == 2 else GONE)
        cost, audit, system = repair(initials, faults)
        illegal = sum(x + y not in ("su", "ua", "au") for x, y in zip(initials, initials[1:]))
        rows.append((conv, -1, None, audit, None, *counts, illegal, cost))
        for r in edit_rows(conv, audit, system):
            rows.append((*r, None, None, None, None, None))
            if len(rows) >= 50_000:
                yield _pack(rows, schema)
                rows = []
    if rows:
        yield _pack(rows, schema)


def align_turns(turns: DataFrame) -> DataFrame:
    """Edits and summaries of ``ordered_turns``, written once; only role initials and faults reach the alignment."""
    narrow = turns.select("conv", "at", F.substring("role", 1, 1).alias("initial"), "blank", "open", "print")
    return written(narrow.repartition("conv").sortWithinPartitions("conv", "at").drop("at").mapInArrow(_align, EDITS), "turn-edits")


def repaired_turns(turns: DataFrame, edits: DataFrame) -> DataFrame:
    """The repaired conversations: (conv, seq, edit, role, text), one row a turn that stands."""
    source = turns.select("conv", F.col("at").alias("source"), F.col("role").alias("own"), "text")
    return (edits.where("seq >= 0 and edit <> 'D'").select("conv", "seq", "source", "edit", "role").join(source, ["conv", "source"], "left")
            .select("conv", "seq", "edit", F.coalesce("role", "own").alias("role"), F.coalesce("text", F.lit("")).alias("text")))


def _hash_turns(batches):
    """Digest of the newline-joined ``role:text`` of each conversation, turn by turn."""
    schema = pa.schema([("conv", pa.string()), ("repaired_sha256", pa.string())])
    conv, digest, rows = None, None, []
    for b in batches:
        for c, role, text in zip(b.column("conv").to_pylist(), b.column("role").to_pylist(), b.column("text").to_pylist()):
            if c != conv:
                if conv is not None:
                    rows.append((conv, digest.hexdigest()))
                conv, digest = c, hashlib.sha256()
            else:
                digest.update(b"\n")
            digest.update(f"{role}:{text}".encode("utf-8", "surrogatepass"))
        if len(rows) >= 50_000:
            yield _pack(rows, schema)
            rows = []
    if conv is not None:
        rows.append((conv, digest.hexdigest()))
    if rows:
        yield _pack(rows, schema)


def repair_report(df: DataFrame, ids: DataFrame) -> DataFrame:
    """Per conversation of ``ids`` (conv_id): faults, repair cost, audit and the digest of the repaired turns of ``df``
    (conv_id, turn, role, text).  A conversation without turns has zeros, an empty audit and the empty text's digest."""
    turns = ordered_turns(df)
    gaps = turns.groupBy("conv").agg((F.max("turn") - F.min("turn") + 1 - F.count_distinct("turn")).alias("gaps"))
    edits = align_turns(turns)
    sums = edits.where("seq = -1").select("conv", "blank", "duplicate", "truncated", "illegal", "cost", F.col("edit").alias("audit"))
    hashes = (repaired_turns(turns, edits).select("conv", "seq", "role", "text").repartition("conv").sortWithinPartitions("conv", "seq")
              .drop("seq").mapInArrow(_hash_turns, "conv string, repaired_sha256 string"))
    known = ids.select("conv_id").distinct().withColumn("conv", conv_key(F.col("conv_id")))
    out = known.join(sums, "conv", "left").join(gaps, "conv", "left").join(hashes, "conv", "left")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("long").alias(c)
    return out.select("conv_id", zero("gaps"), zero("blank"), zero("duplicate"), zero("truncated"), zero("illegal"), zero("cost"),
                      F.coalesce("audit", F.lit("")).alias("audit"),
                      F.coalesce("repaired_sha256", F.lit(hashlib.sha256().hexdigest())).alias("repaired_sha256"))
