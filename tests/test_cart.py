"""Exact trees against a plain search over all splits."""

import random

import pytest

from cohortlab.operators import cart


def plain(rows, min_leaf, max_depth, depth=0):
    """(prediction, n) or (feature, threshold, left, right) of rows (x..., y)."""
    ys = sorted({r[-1] for r in rows})
    count = lambda rs: [sum(r[-1] == y for r in rs) for y in ys]
    total, best = count(rows), None
    if depth < max_depth and len(ys) > 1 and len(rows) >= 2 * min_leaf:
        for f in range(len(rows[0]) - 1):
            vals = sorted({r[f] for r in rows})
            for a, b in zip(vals, vals[1:]):
                left = [r for r in rows if r[f] <= a]
                if min_leaf <= len(left) <= len(rows) - min_leaf:
                    cl = count(left)
                    cr = [t - c for t, c in zip(total, cl)]
                    gain = (sum(c * c for c in cl) / len(left) + sum(c * c for c in cr) / (len(rows) - len(left)) - sum(c * c for c in total) / len(rows)) / len(rows)
                    if gain > 1e-12 and (best is None or round(gain, 12) > round(best[0], 12)):
                        best = (gain, f, (a + b) / 2)
    if best is None:
        return (max(ys, key=lambda y: (sum(r[-1] == y for r in rows), -y)), len(rows))
    _, f, t = best
    return (f, t, plain([r for r in rows if r[f] <= t], min_leaf, max_depth, depth + 1), plain([r for r in rows if r[f] > t], min_leaf, max_depth, depth + 1))


def shape(tree, i=0):
    n = tree.nodes[i]
    return (tree.classes[n.prediction], n.n) if n.feature < 0 else (n.feature, n.threshold, shape(tree, n.left), shape(tree, n.left + 1))


@pytest.mark.parametrize("seed", [1, 2])
def test_against_plain_search(spark, seed):
    rng = random.Random(seed)
    rows = []
    for _ in range(260):
        a, b, c = rng.randint(0, 9), round(rng.gauss(0, 1), 2), rng.choice([0.0, 1.0])
        y = 5 if a > 6 and rng.random() < .9 else 2 if b > 0.3 else 7
        rows.append((float(a), b, c, y))
    df = spark.createDataFrame(rows, "`a.x` double, b double, c double, cl int")
    tree = cart.grow_tree(df, ["a.x", "b", "c"], "cl", min_samples_leaf=8, max_depth=4)
    assert shape(tree) == plain(rows, 8, 4)
    report = cart.tree_rules_report(df, tree, "cl").orderBy("rule_no").collect()
    assert sum(r["support"] for r in report) == 260
    right = sum(r["support"] * r["confidence"] for r in report)
    assert tree.accuracy == pytest.approx(right / 260)
    for r in report:
        assert df.where(r["rule"]).count() == r["support"]


def test_a_clean_split_among_many_values(spark):
    df = spark.range(24_000).selectExpr("(id * 7919) % 24000 as x", "case when (id * 7919) % 24000 <= 12347 then 0 else 1 end as y")
    tree = cart.grow_tree(df, ["x"], "y", max_depth=1)
    assert tree.rules() == [(0, 0, "`x` <= 12347.5"), (1, 1, "`x` > 12347.5")] and tree.accuracy == 1.0


def test_nothing_to_split(spark):
    df = spark.createDataFrame([(1.0, 0), (1.0, 1), (1.0, None)] * 20, "x double, y int")
    tree = cart.grow_tree(df, ["x"], "y")
    assert tree.rules() == [(0, 0, "TRUE")] and tree.accuracy == 0.5
    assert cart.tree_rules_report(df, tree, "y").first()["support"] == 40
    assert cart.grow_tree(df.where("y > 5"), ["x"], "y").nodes[0].n == 0
    with pytest.raises(ValueError, match="x"):
        cart.grow_tree(spark.createDataFrame([(None, 1)], "x double, y int"), ["x"], "y")
