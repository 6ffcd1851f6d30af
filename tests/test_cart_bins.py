"""The split search by bins finds the best of all splits, however few bins there are."""

import random

import pytest

from cohortlab.operators import cart


def _gini(counts):
    n = sum(counts)
    return 1 - sum((c / n) ** 2 for c in counts)


def _best(rows, k, classes, min_leaf):
    """(rounded gain, feature, threshold) of the best split, by trying all."""
    total = [sum(y == c for *_, y in rows) for c in classes]
    best = None
    for f in range(k):
        values = sorted({r[f] for r in rows})
        for v, w in zip(values, values[1:]):
            left = [sum(r[f] <= v and r[-1] == c for r in rows) for c in classes]
            right = [a - b for a, b in zip(total, left)]
            if min(sum(left), sum(right)) >= min_leaf:
                gain = _gini(total) - (sum(left) * _gini(left) + sum(right) * _gini(right)) / len(rows)
                key = (round(gain, 11), -f, -v)
                if best is None or key > best[0]:
                    best = (key, f, v + (w - v) / 2)
    return best


@pytest.mark.parametrize("n_classes, bins", [(3, 1), (3, 5), (8, 5)])
def test_best_split_with_few_bins(spark, monkeypatch, n_classes, bins):
    monkeypatch.setattr(cart, "BINS", bins)
    monkeypatch.setattr(cart, "BIN_SAMPLE", 50)
    rng = random.Random(n_classes * 10 + bins)
    rows = []
    for _ in range(300):
        a, b, c = round(rng.gauss(0, 3), 2), float(rng.randint(0, 4)), -0.0 if rng.random() < 0.3 else float(rng.randint(0, 1))
        rows.append((a, b, c, min(n_classes - 1, int(abs(a) + b * rng.random()))))
    df = spark.createDataFrame(rows, "a double, b double, c double, y int").repartition(3)
    root = cart.grow_tree(df, ["a", "b", "c"], "y", min_samples_leaf=7, max_depth=1).nodes[0]
    key, f, threshold = _best(rows, 3, sorted({r[-1] for r in rows}), 7)
    assert (root.feature, root.threshold) == (f, threshold)
    assert root.gain == pytest.approx(key[0], abs=1e-9)


def test_large_trees_place_rows_like_small_ones(spark, monkeypatch):
    rng = random.Random(3)
    rows = [(rng.random(), rng.random(), rng.randint(0, 3)) for _ in range(400)]
    df = spark.createDataFrame(rows, "a double, b double, y int")
    tree = cart.grow_tree(df, ["a", "b"], "y", min_samples_leaf=5, max_depth=3)
    nested = [r[0] for r in df.select(tree.leaf_column()).collect()]
    monkeypatch.setattr(cart, "NESTED_NODES", 0)
    assert nested == [r[0] for r in df.select(tree.leaf_column()).collect()]
    assert len(set(nested)) > 2
