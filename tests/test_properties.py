"""Property tests for the distributed primitives against plain definitions."""

import math

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import Window
from pyspark.sql import functions as F

from cohortlab.functions.running import exact_quantiles, running_sum
from cohortlab.operators import profile as P
from cohortlab.operators import risk as R
from cohortlab.sources import datasets as S

SETTINGS = settings(max_examples=8, deadline=None, suppress_health_check=list(HealthCheck))


@SETTINGS
@given(st.lists(st.tuples(st.sampled_from(["a", "b", "c"]), st.integers(-50, 50), st.integers(0, 9)),
                min_size=1, max_size=120),
       st.integers(1, 6), st.booleans())
def test_running_sum_is_prefix_sum(spark, rows, parts, desc):
    # unique (group, order) pairs, as after a groupBy
    uniq = {(g, o): x for g, o, x in rows}
    df = spark.createDataFrame([(g, float(o), x) for (g, o), x in uniq.items()], "g string, o double, x int")
    got = {(r["g"], r["o"]): r["cum_x"] for r in running_sum(df, ["g"], "o", ["x"], descending=desc,
                                                             n_parts=parts).collect()}
    for (g, o), _ in uniq.items():
        want = sum(x for (g2, o2), x in uniq.items() if g2 == g and ((o2 >= o) if desc else (o2 <= o)))
        assert got[(g, float(o))] == want


@SETTINGS
@given(st.lists(st.integers(-1000, 1000), min_size=1, max_size=200),
       st.lists(st.floats(0.0, 1.0), min_size=1, max_size=4))
def test_exact_quantiles_match_sorted_definition(spark, vals, probs):
    df = spark.createDataFrame([(float(v),) for v in vals], "v double")
    s = sorted(vals)
    n = len(s)
    lin = {r["q_idx"]: r["value"] for r in exact_quantiles(df, ["v"], probs, {"v": n}, "linear").collect()}
    low = {r["q_idx"]: r["value"] for r in exact_quantiles(df, ["v"], probs, {"v": n}, "lower").collect()}
    for j, p in enumerate(probs):
        h = (n - 1) * p
        lo = math.floor(h)
        want = s[lo] + (h - lo) * (s[min(lo + 1, n - 1)] - s[lo])
        assert math.isclose(lin[j], want, rel_tol=1e-9, abs_tol=1e-9)
        assert low[j] == s[max(math.ceil(n * p) - 1, 0)]


@SETTINGS
@given(st.lists(st.sampled_from(["x", "y", "z", None]), min_size=0, max_size=60))
def test_profile_counts(spark, vals):
    df = spark.createDataFrame([(v,) for v in vals], "c string")
    r = P.profile(df).first()
    present = [v for v in vals if v is not None]
    assert r["n_rows"] == len(vals) and r["n_non_null"] == len(present)
    assert r["col_factornum"] == len(set(present))
    assert r["distinct_ratio"] == round(len(set(present)) / (len(vals) + 1), 2)
    if not present:
        assert r["col_datatype"] == "empty"


@SETTINGS
@given(st.integers(1, 300), st.floats(0.0, 1.0), st.integers(0, 5))
def test_stratified_split_counts(spark, n, ratio, seed):
    df = spark.range(n).select(F.col("id"), (F.col("id") % 3 == 0).cast("int").alias("y"))
    out = R.stratified_split(df, "y", "id", ratio, seed=seed, bucket_hex=2)
    got = {(r["y"], r["split"]): r["count"] for r in out.groupBy("y", "split").count().collect()}
    sizes = {r["y"]: r["count"] for r in df.groupBy("y").count().collect()}
    for y, m in sizes.items():
        k = int(math.floor(m * ratio + 0.5))
        assert got.get((y, "test"), 0) == k and got.get((y, "train"), 0) == m - k


@SETTINGS
@given(st.integers(1, 400), st.integers(1, 9))
def test_row_ids_dense(spark, n, parts):
    ids = sorted(r[0] for r in S.stamp_row_ids(spark.range(0, n, numPartitions=parts)).select("_row_id").collect())
    assert ids == list(range(n))


def test_running_sum_matches_window_on_table(spark):
    li = spark.read.parquet("/root/testdata/sf0.001/lineitem.parquet")
    vc = li.groupBy("l_returnflag", "l_extendedprice").agg(F.count(F.lit(1)).alias("n"))
    got = {(r[0], r[1]): r[2] for r in running_sum(vc, ["l_returnflag"], "l_extendedprice", ["n"], n_parts=4)
           .select("l_returnflag", "l_extendedprice", "cum_n").collect()}
    w = Window.partitionBy("l_returnflag").orderBy("l_extendedprice")
    want = {(r[0], r[1]): r[2] for r in vc.select("l_returnflag", "l_extendedprice", F.sum("n").over(w)).collect()}
    assert got == want
