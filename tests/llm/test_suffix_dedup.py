"""Repeated byte strings against a dictionary of all windows."""

import collections
import hashlib
import random

import numpy as np
import pytest

from cohortlab.llm import suffix_dedup as sd

SCHEMA = "doc_id long, text string, `key` string, body int, `a.b` int"


def brute(rows, length):
    bodies = [(i, (t or "").encode()) for i, t in rows]
    seen = collections.Counter(b[i:i + length] for _, b in bodies for i in range(len(b) - length + 1))
    out = []
    for doc, b in bodies:
        gone = bytearray(len(b))
        for i in range(len(b) - length + 1):
            if seen[b[i:i + length]] > 1:
                gone[i:i + length] = b"\1" * length
        runs = sum(g and not p for g, p in zip(gone, b"\0" + gone))
        kept = bytes(x for x, g in zip(b, gone) if not g)
        out.append((doc, len(b), sum(gone), runs, hashlib.sha256(kept).hexdigest()))
    return collections.Counter(out)


def removed(spark, rows, length, **kw):
    df = spark.createDataFrame([(i, t, "x", 1, 2) for i, t in rows], SCHEMA)
    return collections.Counter(tuple(r) for r in sd.remove_repeats(df, length, **kw).collect())


def words(rng, n):
    return " ".join("".join(rng.choice("abcdeéß") for _ in range(rng.randint(1, 9))) for _ in range(n))


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(9)
    passages = [words(rng, rng.randint(10, 60)) for _ in range(6)]
    out = []
    for i in range(120):
        parts = [words(rng, rng.randint(1, 40)) for _ in range(3)]
        for _ in range(rng.randint(0, 3)):
            parts.insert(rng.randrange(4), rng.choice(passages))
        out.append((i, " ".join(parts)))
    near = words(rng, 120)
    for i in range(200, 230):                                    # a group of near copies
        w = near.split()
        w[rng.randrange(len(w))] = "changed" + str(i)
        out.append((i, " ".join(w)))
    out += [(300 + i, passages[0] + " the same text in many rows") for i in range(25)]     # exact copies
    out += [(None, passages[1]), (None, passages[1]), (1, passages[2]), (400, None), (401, ""), (402, "short"),
            (403, "ab" * 900), (404, "x" * 700), (405, "xyz" * 5), (406, passages[3][:70] + "#" + passages[3][70:])]
    return out


@pytest.mark.parametrize("length", [200, 64])
def test_against_all_windows(spark, rows, length):
    assert removed(spark, rows, length) == brute(rows, length)


def test_crowded_anchors_and_known_marks(spark, rows):
    want = brute(rows, 100)
    assert removed(spark, rows, 100, task_pieces=4) == want       # most anchors are settled by Spark
    assert removed(spark, rows, 100, sample=1.0, known=50) == want
    assert removed(spark, rows, 100, sample=0.0) == want


@pytest.mark.parametrize("rows", [[], [(1, None)], [(1, "a" * 199)], [(1, "é" * 100), (2, "é" * 100)]])
def test_small_tables(spark, rows):
    assert removed(spark, rows, 200) == brute(rows, 200)


def test_very_long_text_in_slices(spark, monkeypatch):
    rng = random.Random(1)
    text = words(rng, 6000)
    assert sum(len(a[0]) for a in [sd.anchors(np.frombuffer(text.encode(), np.uint8), 200)]) > 100
    monkeypatch.setattr(sd, "SLICE", 1000)                        # anchors near a cut are found from both sides
    got = []
    data = np.frombuffer(text.encode(), np.uint8)
    for _, at, first, count, _ in sd._pieces_of(data, np.array([0, len(data)]), 200):
        got += [(f + i, a) for f, c, a in zip(first, count, at) for i in range(c)]
    assert sorted(s for s, _ in got) == list(range(len(data) - 199))
    whole = sd.anchors(data, 200)
    want = {f + i: a for a, f, c in zip(*whole[:3]) for i in range(c)}
    assert all(want[s] == a for s, a in got)


def test_family_levels_grow_geometrically(monkeypatch):
    rng = random.Random(2)
    family = sd.IndexFamily(40)
    pieces = [words(rng, 30).encode()[:120].ljust(120, b"-") for _ in range(60)]
    pieces[50] = pieces[3]
    pieces[59] = pieces[3][10:] + b"0123456789"
    for i in range(0, 60, 4):
        family.add(pieces[i:i + 4])
        sizes = [len(x) for x in family.levels]
        assert all(a > 2 * b for a, b in zip(sizes, sizes[1:]))
    count = collections.Counter(p[i:i + 40] for p in pieces for i in range(81))
    assert [count[p[i:i + 40]] > 1 for p in pieces for i in range(81)] == list(family.repeated[:family.windows])
    for level in family.levels:
        assert all((level.word[1:] > level.word[:-1]) | ((level.word[1:] == level.word[:-1]) & (level.print[1:] > level.print[:-1])))


def test_all_of_a_small_table(spark):
    from cohortlab.llm import queries
    path = "/root/testdata/sf0.001"
    docs = [tuple(r) for r in spark.read.parquet(f"{path}/documents.parquet").select("doc_id", "text").collect()]
    assert collections.Counter(tuple(r) for r in queries.op12_suffix_dedup(spark, path).collect()) == brute(docs, 200)
