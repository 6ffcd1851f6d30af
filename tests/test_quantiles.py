"""Exact quantiles by bracketing against sorting."""

import random

import pytest
from pyspark.sql import functions as F

from cohortlab.functions import running
from cohortlab.operators import profile as P
from cohortlab.operators import select as SEL


def _check(spark, values, interpolation, **kw):
    df = spark.createDataFrame([(v,) for v in values], "`x.y` double").repartition(4)
    live = sorted(v for v in values if v is not None)
    probs = [0.0, 0.1, 0.25, 0.5, 0.77, 1.0]
    got = {r["q_idx"]: r["value"] for r in running.exact_quantiles(df, ["x.y"], probs, {"x.y": len(live)}, interpolation, **kw).collect()}
    for j, p in enumerate(probs):
        lo, hi, w = running.rank_index(len(live), p, interpolation)
        assert got[j] == pytest.approx(live[lo] + w * (live[hi] - live[lo]), rel=1e-12, abs=0), (p, len(live))


@pytest.mark.parametrize("interpolation", ["linear", "lower"])
@pytest.mark.parametrize("kw", [{}, {"accuracy": 20}, {"accuracy": 20, "bracket_rows": 50}])
def test_against_sorting(spark, interpolation, kw):
    rng = random.Random(3)
    for values in ([1.5], [2.0, 1.0], [rng.gauss(0, 1) for _ in range(3000)] + [None] * 7,
                   [float(rng.choice([0, 0, 0, 1, 5])) for _ in range(3000)],
                   [rng.expovariate(1) ** 9 for _ in range(3000)] + [-1e300, 1e300]):
        _check(spark, values, interpolation, **kw)


def test_a_missed_rank_is_still_found(spark, monkeypatch):
    real = running._values_at
    monkeypatch.setattr(running, "_values_at", lambda *a: dict(list(real(*a).items())[:1]))
    _check(spark, [float(i % 97) for i in range(500)], "linear")


def test_nothing_of_the_datas_size_is_shuffled_or_written(spark, monkeypatch):
    monkeypatch.setattr(running, "running_sum", lambda *a, **k: pytest.fail("ranked all values"))
    df = spark.range(50_000).select((F.col("id") * 7 % 50_000).cast("double").alias("v"))
    box = P.box_summary(df).first()
    assert (box["q1"], box["median"], box["q3"]) == (12499.75, 24999.5, 37499.25)
    table = []
    real = running._pick
    monkeypatch.setattr(running, "_pick", lambda cum, ranks: table.append(cum.count()) or real(cum, ranks))
    P.box_summary(df).count()
    assert table[0] < 1000                                       # of 50,000 distinct values


def test_a_null_is_no_text_for_information_gain(spark):
    rows = [(None, 1)] * 50 + [("\\N", 0)] * 50
    ig = SEL.information_gain(spark.createDataFrame(rows, "f string, y int"), "y").first()
    assert ig["feature_scores"] == pytest.approx(0.6931471805599453)
