"""Turn repair against a search over all edits, and the whole query against plain Python."""

import hashlib
import heapq
import random
import re
import zlib

import pytest

from cohortlab.llm import turn_repair as tr

SCHEMA = "conv_id long, turn long, role string, text string, conv string, `at` int, `a.b` string"
BLANK = re.compile(r"[^\x20\x09-\x0D]")


def search(initials, faults):
    """Cheapest audit by uniform-cost search over (row, state); state: 0 start, 1 after s, 2 after u, 3 after a."""
    heap, done = [(0, "", 0, 0)], set()
    while heap:
        cost, audit, i, st = heapq.heappop(heap)
        if (i, st) in done:
            continue
        done.add((i, st))
        if i == len(initials) and st in (0, 3):
            return cost, audit
        nxt = {0: "u", 1: "u", 2: "a", 3: "u"}[st]
        heapq.heappush(heap, (cost + 3, audit + "I", i, 2 if nxt == "u" else 3))
        if i < len(initials):
            heapq.heappush(heap, (cost + 4, audit + "D", i + 1, st))
            if faults[i] != tr.GONE:
                more = 3 if faults[i] == tr.CUT else 0
                if initials[i] == nxt:
                    heapq.heappush(heap, (cost + more, audit + "K", i + 1, 2 if nxt == "u" else 3))
                else:
                    heapq.heappush(heap, (cost + more + 3, audit + "R", i + 1, 2 if nxt == "u" else 3))
                if initials[i] == "s" and st == 0:
                    heapq.heappush(heap, (cost + more, audit + "K", i + 1, 1))


@pytest.mark.parametrize("kept", [tr.KEPT_CELLS, 0])
def test_alignment_against_search(monkeypatch, kept):
    monkeypatch.setattr(tr, "KEPT_CELLS", kept)           # 0: rows are recomputed from every b-th one
    rng = random.Random(8)
    for _ in range(1500):
        n = rng.choice([0, 1, 2, 3, 4, 5, 6, 8, 12])
        initials = [rng.choice("uuaas x") if rng.random() < .5 else "ua"[i % 2] for i in range(n)]
        faults = [rng.choice([0, 0, 0, 1, 2]) for _ in range(n)]
        cost, audit, _ = tr.repair(initials, faults)
        assert (cost, audit) == search(initials, faults), (initials, faults)


def test_long_conversation():
    rng = random.Random(2)
    initials = ["ua"[i % 2] for i in range(3000)]
    for i in range(0, 3000, 41):
        initials[i] = "u"
    faults = [rng.choice([0] * 18 + [1, 2]) for _ in initials]
    assert tr.repair(initials, faults)[:2] == search(initials, faults)


def plain(rows):
    """The contract, row by row."""
    convs = {}
    for conv, turn, role, text in rows:
        convs.setdefault(conv, [])
        key = f"{' ' if conv is None else conv}:{' ' if turn is None else turn}"
        kind = zlib.crc32(key.encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        if kind == 0:
            continue
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        convs[conv] += [(turn, "user" if kind == 4 else role, text)] * (2 if kind == 3 else 1)
    out = {}
    for conv, turns in convs.items():
        turns.sort(key=lambda t: (t[0] is not None, t[0] or 0, t[1], hashlib.md5(f"{len(t[1])}:{t[1]}{t[2]}".encode()).digest()))
        seen, faults, counts = set(), [], [0, 0, 0]
        for _, role, text in turns:
            marks = BLANK.findall(text)
            kind = 0 if not marks else 1 if (role, text) in seen else 2 if marks[-1] not in ".!?" else None
            seen.add((role, text))
            faults.append(0 if kind is None else 1 if kind == 2 else 2)
            if kind is not None:
                counts[kind] += 1
        initials = [r[:1] for _, r, _ in turns]
        cost, audit = search(initials, faults)
        lines, at, want = [], 0, "u"
        for e in audit:
            if e == "D":
                at += 1
                continue
            full = "user" if want == "u" else "assistant"
            if e == "K" and not lines and initials[at] == "s":
                lines.append(f"{turns[at][1]}:{turns[at][2]}")
                at += 1
                continue
            lines.append(f"{full}:" if e == "I" else f"{turns[at][1] if e == 'K' else full}:{turns[at][2]}")
            at += e != "I"
            want = "a" if want == "u" else "u"
        known = [t for t, _, _ in turns if t is not None]
        gaps = max(known) - min(known) + 1 - len(set(known)) if known else 0
        illegal = sum(x + y not in ("su", "ua", "au") for x, y in zip(initials, initials[1:]))
        out[conv] = (gaps, *counts, illegal, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest())
    return out


def report(spark, rows):
    df = spark.createDataFrame([(*r, "clash", 1, "x") for r in rows], SCHEMA)
    return {r[0]: tuple(r)[1:] for r in tr.repair_report(tr.damage(df), df).collect()}


def test_report_against_plain_python(spark):
    rng = random.Random(4)
    rows = []
    for conv in range(160):
        for turn in range(rng.randint(1, 9)):
            role = rng.choice(["user", "assistant"]) if rng.random() < .2 else ["user", "assistant"][turn % 2]
            if turn == 0 and rng.random() < .4:
                role = "system"
            rows.append((conv, turn * rng.choice([1, 1, 2]), role, rng.choice(["Yes.", "No?\n", "open end", " \t", "Wait! no.", "é…", "Fine!"])))
    rows += [(900, None, "user", "Hello."), (900, None, "assistant", None), (900, 3, None, "Odd."), (900, 5, "", "Role."), (None, 1, "user", "Who?"),
             (None, None, None, None), (901, 1, "tool", "Tool."), (902, 7, "user", "long " * 60_000 + "."), (902, 8, "assistant", "end."),
             (903, 2, "user", "Same."), (903, 2, "user", "Same."), (903, -4, "assistant", "Same.")]
    rows += [(950, i, "user" if i % 2 == 0 else "assistant", "Same answer." if i % 3 else f"Text {i}.") for i in range(700)]   # one long conversation
    assert report(spark, rows) == plain(rows)


def test_dropped_and_empty(spark):
    lone = next(c for c in range(1000) if zlib.crc32(f"{c}:1".encode()) % 20 == 0)
    empty = hashlib.sha256().hexdigest()
    assert report(spark, [(lone, 1, "user", "Gone.")]) == {lone: (0, 0, 0, 0, 0, 0, "", empty)}
    assert report(spark, []) == {}


def test_all_of_a_small_table(spark):
    from cohortlab.llm import queries
    path = "/root/testdata/sf0.001"
    rows = [tuple(r) for r in spark.read.parquet(f"{path}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    assert {r[0]: tuple(r)[1:] for r in queries.op13_turn_repair(spark, path).collect()} == plain(rows)
