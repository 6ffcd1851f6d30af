"""Joins with hot keys and clashing names, expressions with literals, missing feature values, upper tails."""

import math
import random

import pytest
from pyspark.sql import functions as F

from cohortlab.operators import cleanse as C
from cohortlab.operators import cluster as K
from cohortlab.operators import combine as J
from cohortlab.operators import features as FE
from cohortlab.operators import risk as R


def _sides(spark):
    rng = random.Random(6)
    left = spark.createDataFrame([(rng.choice([0] * 6 + [1, 2, 3, None, 9]), i) for i in range(400)], "k int, a int")
    right = spark.createDataFrame([(rng.choice([1] * 6 + [0, 2, 4, None, 8]), i) for i in range(300)], "k int, b int")
    return left, right


@pytest.mark.parametrize("how", ["inner", "left", "right", "outer"])
def test_split_hot_keys_equals_the_plain_join(spark, how):
    left, right = _sides(spark)
    plain = left.join(right, "k", J.JOIN_TYPES[how])
    split = J.join_key(left, right, "k", how, split_hot=True, support=0.05, salts=4)
    assert split.columns == plain.columns
    key = lambda r: tuple((x is None, x or 0) for x in r)
    assert sorted(map(tuple, split.collect()), key=key) == sorted(map(tuple, plain.collect()), key=key)


@pytest.mark.parametrize("side", ["left", "right"])
def test_a_hot_key_is_dealt_over_tasks(spark, side):
    many = spark.range(40_000).select(F.lit(7).alias("k"), F.col("id").alias("m"))
    few = spark.range(3).select(F.lit(7).alias("k"), F.col("id").alias("f"))
    conf = {"spark.sql.adaptive.enabled": "false", "spark.sql.autoBroadcastJoinThreshold": "-1"}
    old = {c: spark.conf.get(c) for c in conf}
    for c, v in conf.items():
        spark.conf.set(c, v)
    try:
        a, b = (many, few) if side == "left" else (few, many)
        out = J.join_key(a, b, "k", "right" if side == "left" else "left", split_hot=True)     # the hot side is the inner one
        sizes = sorted(r["count"] for r in out.groupBy(F.spark_partition_id()).count().collect())
        assert sum(sizes) == 120_000 and max(sizes) < 3 * sizes[len(sizes) // 2]
    finally:
        for c, v in old.items():
            spark.conf.set(c, v)


def test_clashing_names(spark, tmpdir_path):
    left = spark.createDataFrame([(1, 2, 3, 4)], "k int, x int, x_l int, Y int")
    right = spark.createDataFrame([(1, 5, 6, 7)], "K int, X int, y int, x_r int")
    out = J.join_key(left, right, "k")
    assert out.columns == ["k", "x_l_2", "x_l", "Y_l", "X_r_2", "y_r", "x_r"]
    assert tuple(out.first()) == (1, 2, 3, 4, 5, 6, 7)
    out.write.parquet(f"{tmpdir_path}/j")
    hot = FE.explode_factors(spark.createDataFrame([("A",), ("a",), (None,)], "g string"), ["g"])
    assert hot.columns == ["drv_f_g_A", "drv_f_g_a_2"]
    hot.write.parquet(f"{tmpdir_path}/h")


def test_expressions_leave_literals_alone(spark):
    assert C.rewrite_expr("$a b$ = 'US$' AND $c$ <> \"$x$\"") == "`a b` = 'US$' AND `c` <> \"$x$\""
    assert C.rewrite_expr("$c$ = 'it''s $5$' OR `d$` > $e$") == "`c` = 'it''s $5$' OR `d$` > `e`"
    df = spark.createDataFrame([("US$", 1), ("EU", 2)], "cur string, n int")
    assert [r["n"] for r in C.filter_expr(df, "$cur$ = 'US$' AND $n$ < 5").collect()] == [1]


def test_suffix_patterns_are_grouped(spark):
    from cohortlab.operators import profile as P
    df = spark.createDataFrame([(1, 2, 3)], "a_id int, a_id_x int, b_key int")
    got = {r["col_name"] for r in C.matching_columns(P.profile(df), name_suffix="_id|_key").collect()}
    assert got == {"a_id", "b_key"}


def test_missing_values_are_named_or_imputed(spark):
    rows = [(i, float(i % 10), float(i) if i != 3 else None, i % 2) for i in range(100)]
    df = spark.createDataFrame(rows, "id int, a double, `b.c` double, y int")
    feats = ["a", "b.c"]
    for fit in (lambda: K.reduce_pca(df, feats, k=1), lambda: K.kmeans(df, feats), lambda: K.silhouette(df, feats, "y"),
                lambda: K.mine_rules(df, feats, "y"), lambda: R.fit_logistic(df, feats, "y"), lambda: R.fit_forest(df, feats, "y")):
        with pytest.raises(ValueError, match="b.c"):
            fit()
    fill = K.fit_imputer(df, feats)
    assert fill["b.c"] == pytest.approx((sum(range(100)) - 3) / 99) and K.fit_imputer(df, feats, "median")["b.c"] == 50.0
    whole = K.impute(df, fill)
    assert whole.where("`b.c` is null").count() == 0 and whole.columns == df.columns
    pc = [r["pc_1"] for r in K.reduce_pca(whole, feats, k=1).collect()]
    assert not any(math.isnan(x) for x in pc) and abs(sum(pc)) < 1e-6
    with pytest.raises(ValueError, match="lengths"):
        K.require_complete(spark.createDataFrame([([1.0],), ([1.0, 2.0],)], "v array<double>"), "v")


def test_upper_tails_keep_their_digits(spark):
    schema = "feature_name string, feature_type string, test string, statistic double, dof1 bigint, dof2 bigint"
    rows = [("a", "binary", "chi2", 400.0, 2, None), ("b", "binary", "chi2", 1.0, 1, None), ("c", "numeric", "anova", 900.0, 2, 500),
            ("d", "numeric", "anova", None, 2, 5), ("e", "binary", "chi2", 0.0, 2, None)]
    p = {r["feature_name"]: r["p_value"] for r in K.p_values(spark.createDataFrame(rows, schema)).collect()}
    assert p["a"] == pytest.approx(math.exp(-200), rel=1e-9)
    assert p["b"] == pytest.approx(math.erfc(math.sqrt(0.5)), rel=1e-9)
    assert p["c"] == pytest.approx((1 + 2 * 900 / 500) ** -250, rel=1e-9)
    assert p["d"] is None and p["e"] == 1.0
