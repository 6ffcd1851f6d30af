"""Hard-negative mining against brute force; the packed tree against a scan."""

import collections
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from cohortlab.llm import hard_negatives as hn

SCHEMA = "vec_id long, embedding array<float>, label int, shard string, `key` int, `a.b` int"


def brute(rows, anchor, n_pos=5, n_neg=5, low=80, high=100, scale=256):
    """``rows``: (id, vector, label) as the operator sees them."""
    live = [(i, v, l) for i, v, l in rows if l is not None and v is not None
            and all(x is not None and math.isfinite(x) for x in v)]
    q = [[math.floor(scale * float(np.float32(x))) for x in v] for _, v, _ in live]
    last = lambda i: (i is None, i or 0)
    out = []
    for a, (aid, _, al) in enumerate(live):
        if aid is None or not anchor(aid):
            continue
        score = [sum(x * y for x, y in zip(q[a], w)) for w in q]
        order = sorted(range(len(live)), key=lambda j: (-score[j], last(live[j][0])))
        for p in [j for j in order if j != a and live[j][2] == al][:n_pos]:
            neg = [j for j in order if live[j][2] != al and low * score[p] <= 100 * score[j] <= high * score[p]][:n_neg]
            out += [(aid, live[p][0], r + 1, live[j][0], score[p], score[j]) for r, j in enumerate(neg)]
    return collections.Counter(out)


def mined(spark, rows, **kw):
    df = spark.createDataFrame([(i, v, l, "x", 1, 2) for i, v, l in rows], SCHEMA)
    return collections.Counter(tuple(r) for r in hn.mine_hard_negatives(df, F.col("vec_id") % 10 == 0, **kw).collect())


def test_against_brute_force_with_nulls_ties_and_repeats(spark):
    rng = random.Random(5)
    rows = [(i, [rng.gauss(0, .4) + (i % 3) for _ in range(6)], i % 3) for i in range(240)]
    rows += [(i, [0.5] * 6, i % 2) for i in range(300, 340)]               # ties
    rows += [(400, [0.5] * 6, 1), (400, [0.5] * 6, 1)]                     # one id twice, both anchors
    rows += [(None, [1.0] * 6, 0), (None, [0.5] * 6, 1)]
    rows += [(500, None, 1), (510, [0.1] * 6, None), (520, [None] + [.1] * 5, 1), (530, [float("nan")] * 6, 1),
             (540, [float("inf")] + [0.] * 5, 2), (550, [], 1), (560, [1.0, 1.0], 0)]
    assert mined(spark, rows) == brute(rows, lambda i: i % 10 == 0)
    assert mined(spark, rows, shard_rows=16, n_positives=2, n_negatives=3, low=50, high=120) == \
        brute(rows, lambda i: i % 10 == 0, 2, 3, 50, 120)


def test_scores_beyond_doubles_are_exact(spark):
    rows = [(i, [float(2 ** 20 + i), 2.0 ** 20 - i], i % 2) for i in range(40)]
    assert mined(spark, rows) == brute(rows, lambda i: i % 10 == 0)


@pytest.mark.parametrize("rows", [[], [(0, None, None)], [(0, [1.0], 1)], [(None, [1.0], 1), (1, [2.0], 1)]])
def test_empty_results(spark, rows):
    assert not mined(spark, rows)


def test_tree_prunes_and_keeps_ties():
    rng = np.random.default_rng(1)
    q = np.concatenate([rng.integers(0, 40, (3000, 4)) + 400 * c for c in range(4)]).astype(float)
    ids, labels = np.arange(len(q))[::-1].copy(), [str(i % 5) for i in range(len(q))]
    tree = hn.PackedTree(np.arange(len(q)), ids, labels, q, leaf=32)
    a = q[7:8]
    bounds = tree.bounds(a)
    scores = q @ a[0]
    for level, (lo, hi) in enumerate(bounds[:1]):
        for x in range(lo.shape[1]):
            own = tree.q[tree.start[x]:tree.end[x]] @ a[0]
            assert lo[0, x] <= own.min() and own.max() <= hi[0, x]
    visited = []
    real = tree.start
    class Spy(np.ndarray):
        def __getitem__(self, i):
            if np.isscalar(i):
                visited.append(i)
            return super().__getitem__(i)
    tree.start = real.view(Spy)
    code = tree.names["2"]
    got = tree.search(a[0], [b[0][0] for b in bounds], [b[1][0] for b in bounds], code, False, -1, 5, [(0, scores.max())])[0]
    want = sorted((-int(scores[i]), int(ids[i])) for i in range(len(q)) if labels[i] != "2")[:5]
    assert got == want
    assert len(visited) < len(real) / 4                                    # far boxes are never opened
