"""All restarts of k-means in one scan a pass."""

import random

import numpy as np
import pytest

from cohortlab.operators import cluster as K


def _blobs(spark, n=600):
    rng = random.Random(3)
    spots = [(0, 0), (8, 0), (0, 9), (9, 9)]
    rows = [(i, "x" * (i % 3), *(c + rng.gauss(0, .6) for c in spots[i % 4])) for i in range(n)]
    return spark.createDataFrame(rows, "id long, tag string, a double, b double").repartition(5, "id"), rows


def test_against_plain_lloyd_and_least_cost(spark):
    df, rows = _blobs(spark)
    out, fit = K.kmeans(df, ["a", "b"], k=4, n_init=6, keep=["id", "tag"])
    x = np.array([r[2:] for r in rows])
    label = {r["id"]: r["cluster_id"] for r in out.collect()}
    assert len(label) == 600 and out.columns == ["id", "tag", "cluster_id"] and dict(out.dtypes)["cluster_id"] == "int"
    got = np.array([label[i] for i in range(600)])
    gaps = ((x[:, None] - fit.centers[None]) ** 2).sum(axis=2)
    assert (got == gaps.argmin(axis=1)).all()
    assert fit.trainingCost == pytest.approx(gaps.min(axis=1).sum()) == pytest.approx(min(fit.costs))
    means = np.array([x[got == c].mean(axis=0) for c in range(4)])
    assert np.allclose(means, fit.centers, atol=0.05)
    assert len({(i % 4, got[i]) for i in range(600)}) == 4         # the blobs are found
    for s in range(6):
        assert fit.trainingCost <= K.kmeans(df, ["a", "b"], k=4, n_init=1, seed=s)[1].trainingCost + 1e-6


def test_one_scan_a_pass_for_all_runs(spark, monkeypatch):
    df, _ = _blobs(spark)
    calls = []
    real = K._lloyd_pass
    monkeypatch.setattr(K, "_lloyd_pass", lambda x, centers, sums: calls.append(len(centers)) or real(x, centers, sums))
    _, fit = K.kmeans(df, ["a", "b"], k=4, n_init=10)
    assert len(calls) == fit.passes + 1 and calls[0] == 10


def test_odd_inputs(spark):
    same = spark.createDataFrame([(1.0, 1.0)] * 5, "a double, b double")
    out, fit = K.kmeans(same, ["a", "b"], k=3, n_init=2)
    assert fit.trainingCost == 0.0 and out.count() == 5
    arrays = spark.createDataFrame([(i, [float(i % 2) * 5, 1.0]) for i in range(20)], "id int, v array<float>")
    out, fit = K.kmeans(arrays, "v", k=2, n_init=3, keep=["id", "v"])
    assert fit.trainingCost == pytest.approx(0.0, abs=1e-9) and len({r["cluster_id"] for r in out.collect()}) == 2
    with pytest.raises(ValueError):
        K.kmeans(same.where("a > 2"), ["a", "b"])
