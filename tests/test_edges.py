"""Edge cases on small literal frames (invented values) and invariants."""

import math
import random

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from cohortlab.functions.running import exact_quantiles, running_sum
from cohortlab.operators import cleanse as C
from cohortlab.operators import combine as J
from cohortlab.operators import features as FE
from cohortlab.operators import profile as P
from cohortlab.operators import risk as R
from cohortlab.operators import select as SEL
from cohortlab.sources import datasets as S

EDGES_SCHEMA = "k int, empty_col string, const_col double, flag boolean, txt string, `a.b` double"
EDGES = [(1, None, 3.0, True, "x", 0.5), (2, None, 3.0, False, "y", 1.5),
         (3, None, 3.0, True, None, 2.5), (None, None, 3.0, None, "x", None)]


@pytest.fixture()
def edges(spark):
    return spark.createDataFrame(EDGES, EDGES_SCHEMA)


def _prof(df):
    return {r["col_name"]: r for r in P.profile(df).collect()}


def test_profile_types_and_counts(edges):
    p = _prof(edges)
    assert p["k"]["col_datatype"] == "numeric" and p["k"]["col_factornum"] == 3
    assert p["empty_col"]["col_datatype"] == "empty" and p["empty_col"]["value_range"] == "empty"
    assert p["const_col"]["col_datatype"] == "factor_s"          # 1 value <= 2
    assert p["flag"]["col_datatype"] == "binary"
    assert p["txt"]["col_datatype"] == "factor_s" and p["txt"]["value_range"] == "[x, y]"
    assert p["a.b"]["col_datatype"] == "numeric" and p["a.b"]["value_range"] == "(0.5, 2.5)"
    assert p["k"]["missing_pct"] == 25.0
    assert p["k"]["distinct_ratio"] == round(3 / 5, 2)            # note the +1


def test_profile_zero_rows(spark):
    df = spark.createDataFrame([], "a int, b string")
    p = _prof(df)
    assert p["a"]["n_rows"] == 0 and p["a"]["missing_pct"] is None
    assert p["a"]["col_datatype"] == "empty"


def test_profile_overrides_and_stored(edges):
    stored = P.profile(edges).select("col_name", F.when(F.col("col_name") == "k", "factor_s")
                                     .otherwise(F.col("col_datatype")).alias("col_datatype"))
    p = {r["col_name"]: r for r in P.profile(edges, stored=stored, overrides={"txt": "character"}).collect()}
    assert p["k"]["col_datatype"] == "factor_s" and p["k"]["value_range"] == "[1, 2, 3]"
    assert p["txt"]["col_datatype"] == "character"
    with pytest.raises(ValueError):
        P.profile(edges, overrides={"k": "nonsense"})


def test_profile_approx_matches_exact_small(spark):
    df = spark.range(0, 3000).select((F.col("id") % 7).alias("low"), F.col("id").alias("high"))
    exact = {r["col_name"]: r["col_factornum"] for r in P.profile(df).collect()}
    approx = {r["col_name"]: r["col_factornum"] for r in P.profile(df, approx=True).collect()}
    assert exact["low"] == approx["low"] == 7
    assert abs(approx["high"] - 3000) / 3000 < 0.1


def test_histogram_constant_column(spark):
    df = spark.createDataFrame([(4.0,), (4.0,), (None,)], "v double")
    h = {r["bin"]: r["cnt"] for r in P.histogram(df).collect()}
    assert len(h) == 10 and h[5] == 2 and sum(h.values()) == 2


def test_box_summary_matches_numpy(spark):
    rnd = random.Random(3)
    vals = [rnd.gauss(0, 1) for _ in range(501)] + [8.0, -9.0]
    df = spark.createDataFrame([(v,) for v in vals], "v double")
    r = P.box_summary(df).first()
    s = sorted(vals)

    def q(p):
        h = (len(s) - 1) * p
        lo = math.floor(h)
        return s[lo] + (h - lo) * (s[min(lo + 1, len(s) - 1)] - s[lo])
    assert r["q1"] == pytest.approx(q(0.25)) and r["median"] == pytest.approx(q(0.5))
    iqr = q(0.75) - q(0.25)
    assert r["n_outliers"] == sum(1 for v in vals if v < q(0.25) - 1.5 * iqr or v > q(0.75) + 1.5 * iqr)
    approx = P.box_summary(df, exact=False).first()
    assert approx["median"] == pytest.approx(q(0.5), abs=0.05)


def test_running_sum_matches_window(spark):
    rnd = random.Random(1)
    rows = [(rnd.choice("ab"), float(i), rnd.randint(0, 5)) for i in range(400)]
    df = spark.createDataFrame(rows, "g string, o double, x int")
    got = {(r["g"], r["o"]): r["cum_x"] for r in running_sum(df, ["g"], "o", ["x"], n_parts=5).collect()}
    w = Window.partitionBy("g").orderBy("o").rowsBetween(Window.unboundedPreceding, 0)
    want = {(r["g"], r["o"]): r["c"] for r in df.select("g", "o", F.sum("x").over(w).alias("c")).collect()}
    assert got == want


def test_exact_quantiles_discrete(spark):
    vals = [1, 1, 2, 3, 5, 8, 13, 21, 34, 55, 89]
    df = spark.createDataFrame([(float(v),) for v in vals], "v double")
    q = {r["q_idx"]: r["value"] for r in exact_quantiles(df, ["v"], [0.1, 0.5, 0.9], {"v": len(vals)}, "lower").collect()}
    assert q == {0: vals[math.ceil(0.1 * 11) - 1], 1: vals[math.ceil(0.5 * 11) - 1], 2: vals[math.ceil(0.9 * 11) - 1]}


def test_dense_row_ids_many_partitions(spark):
    df = spark.range(0, 1000, numPartitions=7)
    ids = [r[0] for r in S.stamp_row_ids(df).select("_row_id").collect()]
    assert sorted(ids) == list(range(1000))
    same = S.stamp_row_ids(df).filter(F.col("id") != F.col("_row_id")).count()
    assert same == 0


def test_semi_join_null_keys_never_match(spark):
    a = spark.createDataFrame([(1,), (None,), (2,)], "k int")
    b = spark.createDataFrame([(1,), (None,), (1,)], "DESYNPUF_ID int")
    assert [r[0] for r in C.filter_by_ids(a, b).collect()] == [1]


def test_filter_expr_dotted_names_and_affected(edges):
    out = C.filter_expr(edges, "$a.b$ > 1 AND $txt$ = 'y'")
    assert out.count() == 1
    r = C.affected(edges, "$a.b$ > 1").first()
    assert (r["n_kept"], r["n_rows"]) == (2, 4)


def test_matching_columns_conditions(edges):
    prof = P.profile(edges)
    names = {r[0] for r in C.matching_columns(prof, min_non_missing="0.7").select("col_name").collect()}
    assert names == {"k", "const_col", "flag", "txt", "a.b"}
    with pytest.raises(ValueError):
        C.matching_columns(prof, min_distinct_ratio="lots")
    names = {r[0] for r in C.matching_columns(prof, data_type="numeric, binary").select("col_name").collect()}
    assert names == {"k", "flag", "a.b"}


def test_join_suffixes(spark):
    left = spark.createDataFrame([(1, "a", 1.0)], "key int, name string, `a.b` double")
    right = spark.createDataFrame([(1, "b"), (2, "c")], "key int, name string")
    out = J.join_key(left, right, "key", "outer")
    assert set(out.columns) == {"key", "name_l", "name_r", "a.b"}
    assert out.count() == 2
    with pytest.raises(ValueError):
        J.join_key(left, right, "key", "sideways")


def test_explode_factors_nulls_and_cap(spark):
    df = S.stamp_row_ids(spark.createDataFrame([("u",), (None,), ("v",)], "c string"))
    out = {r["_row_id"]: r for r in FE.explode_factors(df, ["c"]).collect()}
    assert out[1]["drv_f_c_u"] == 0 and out[1]["drv_f_c_v"] == 0 and out[0]["drv_f_c_u"] == 1
    with pytest.raises(ValueError):
        FE.explode_factors(df, ["c"], cap=1)


def test_min_max_constant_column(spark):
    df = spark.createDataFrame([(1.0, 5.0), (3.0, 5.0)], "a double, b double")
    rows = FE.min_max(df).collect()
    assert [r["a"] for r in rows] == [0.0, 1.0] and [r["b"] for r in rows] == [0.0, 0.0]


def test_derive_one_unknown_function(edges):
    with pytest.raises(ValueError):
        FE.derive_one(edges, "k", "nosuch", "out")


def test_stratified_split_sizes_and_skew(spark):
    # one label holds most rows: class sizes are still exact
    rows = [(i, 0 if i % 10 else 1) for i in range(5000)]
    df = spark.createDataFrame(rows, "id long, y int")
    out = R.stratified_split(df, "y", "id", 0.2, seed=3, bucket_hex=2)
    got = {(r["y"], r["split"]): r["count"] for r in out.groupBy("y", "split").count().collect()}
    assert got[(0, "test")] == round(4500 * 0.2) and got[(1, "test")] == round(500 * 0.2)
    assert out.count() == 5000
    # same as the plain window definition
    w = Window.partitionBy("y").orderBy(R.split_hash("id", 3), "id")
    plain = df.withColumn("_r", F.row_number().over(w)).withColumn(
        "_k", F.round(F.count(F.lit(1)).over(Window.partitionBy("y")) * 0.2, 0))
    want = {r["id"] for r in plain.filter(F.col("_r") <= F.col("_k")).collect()}
    assert {r["id"] for r in out.filter(F.col("split") == "test").collect()} == want


def test_roc_auc_ties_and_single_class(spark):
    rows = [(1, 0.9), (0, 0.9), (1, 0.7), (0, 0.3), (1, 0.3), (0, 0.1)]
    df = spark.createDataFrame([(y, p, "all") for y, p in rows], "y int, p double, split string")
    a = R.auc(R.roc_points(df, "y", "p")).first()["auc"]
    pos = [p for y, p in rows if y]
    neg = [p for y, p in rows if not y]
    brute = sum(1.0 if x > z else 0.5 if x == z else 0.0 for x in pos for z in neg) / (len(pos) * len(neg))
    assert a == pytest.approx(brute)
    one = spark.createDataFrame([(1, 0.2, "s"), (1, 0.4, "s")], "y int, p double, split string")
    assert R.auc(R.roc_points(one, "y", "p")).first()["auc"] is None
    m = R.threshold_metrics(one, "y", "p", threshold=0.5).first()
    assert m["precision"] is None and m["specificity"] is None


def test_information_gain_perfect_and_useless(spark):
    rows = [(i % 2, (i % 2) * 10 + 0.0, float(i % 3)) for i in range(60)]
    df = spark.createDataFrame(rows, "y int, perfect double, noise double")
    s = {r[0]: r[1] for r in SEL.information_gain(df, "y").collect()}
    assert s["perfect"] == pytest.approx(math.log(2))
    assert s["noise"] == pytest.approx(0.0, abs=1e-12)
    top = SEL.select_top(SEL.information_gain(df, "y"), k=1).collect()
    assert top[0][0] == "perfect"


def test_hot_key_holds_a_third_of_rows(spark):
    # key 7 holds 40% of the rows: results stay whole and exact
    n = 3000
    df = spark.range(n).select(F.col("id"), F.when(F.col("id") % 5 < 2, 7).otherwise(F.col("id")).alias("k"),
                               (F.col("id") % 2).cast("int").alias("y"))
    ids = spark.range(0, 50).select(F.col("id").alias("DESYNPUF_ID")).union(
        spark.range(0, 2000).select(F.lit(7).cast("long").alias("DESYNPUF_ID")))
    kept = C.filter_by_ids(df, ids, key="k")
    assert kept.count() == df.filter((F.col("k") < 50)).count()
    other = spark.range(0, 100).select(F.col("id").alias("k"), (F.col("id") * 2).alias("v"))
    joined = J.join_key(df, other, "k", "left")
    assert joined.count() == n and joined.filter(F.col("k") == 7).select("v").distinct().first()[0] == 14
    hot_label = df.select("k", (F.col("k") == 7).cast("int").alias("is_hot"))
    s = {r[0]: r[1] for r in SEL.information_gain(hot_label, "is_hot").collect()}
    p = 0.4
    h = -(p * math.log(p) + (1 - p) * math.log(1 - p))
    assert 0.9 * h < s["k"] <= h + 1e-12          # the hot value's decile bin nearly decides the label
    hot = P.value_counts(df, ["k"]).filter(F.col("val") == "7").first()["cnt"]
    assert hot == df.filter(F.col("k") == 7).count()


def test_fingerprint_methods(spark):
    df = spark.createDataFrame([(1, "a"), (2, None), (3, "c")], "k int, v string")
    for method in ("md5", "xxhash64"):
        a = S.fingerprint(df, name="d", method=method).first()["fingerprint"]
        b = S.fingerprint(df.orderBy(F.col("k").desc()), name="d", method=method).first()["fingerprint"]
        c = S.fingerprint(df.filter("k < 3"), name="d", method=method).first()["fingerprint"]
        assert a == b and a != c                      # order-insensitive, content-sensitive
    with pytest.raises(ValueError):
        S.fingerprint(df, name="d", method="crc")


def test_outer_join_equals_native_full_outer(spark):
    rnd = random.Random(11)
    left = spark.createDataFrame([(rnd.choice([None, 1, 2, 3, 7, 7, 7]), i) for i in range(60)], "k int, a int")
    right = spark.createDataFrame([(rnd.choice([None, 2, 3, 4, 7]), i) for i in range(25)], "k int, b int")
    got = sorted((tuple(r) for r in J.join_key(left, right, "k", "outer").select("k", "a", "b").collect()), key=repr)
    want = sorted((tuple(r) for r in left.join(right, "k", "full_outer").select("k", "a", "b").collect()), key=repr)
    assert got == want


def test_no_eligible_columns(spark):
    only_id = S.stamp_row_ids(spark.createDataFrame([("a",), ("b",)], "s string")).select("_row_id")
    strs = spark.createDataFrame([("a", 1), ("b", 0)], "s string, y int")
    assert P.profile(only_id).count() == 0 and P.profile(only_id).columns == P.PROFILE_FIELDS
    assert P.histogram(strs.select("s")).count() == 0
    assert P.box_summary(strs.select("s")).count() == 0
    assert SEL.information_gain(strs.select("y"), "y").count() == 0
    with pytest.raises(ValueError):
        C.filter_non_null(only_id, 0.5)


def test_read_csv_keeps_quotes_and_line_breaks(spark, tmpdir_path):
    from cohortlab.sources.datasets import read_csv
    path = f"{tmpdir_path}/q.csv"
    with open(path, "w") as f:
        f.write('a,b\n1,"he said ""hi"", ok"\n2,"two\nlines"\n')
    got = [(r.a, r.b) for r in read_csv(spark, path).orderBy("a").collect()]
    assert got == [(1, 'he said "hi", ok'), (2, "two\nlines")]


def test_rule_depth_beyond_the_library_is_an_error(spark):
    import pytest
    from cohortlab.operators.cluster import mine_rules
    with pytest.raises(ValueError):
        mine_rules(spark.range(3).selectExpr("id as x", "0 as cluster"), ["x"], "cluster", max_depth=31)


def test_whole_inputs(spark):
    from cohortlab.plans.catalog import QUERIES
    d = "/root/testdata/sf0.001"
    status = {r["dataset"]: r["status"] for r in QUERIES["change_detection_whole"](spark, d).collect()}
    # only balances of this segment differ
    assert status["BUILDING"] == "changed" and status["MACHINERY"] == "same"
    rows = QUERIES["kmeans_embeddings"](spark, d)
    n = spark.read.parquet(f"{d}/embeddings.parquet").count()
    assert rows.columns == ["vec_id", "cluster_id"] and rows.select("vec_id").distinct().count() == n == rows.count()


def test_stored_factor_beyond_the_cap(spark):
    df = spark.range(1500).selectExpr("concat('v', id) AS a", "id AS b")
    small = P.profile(df.limit(10)).select("col_name", "col_datatype")
    assert {r["col_name"]: r["col_datatype"] for r in small.collect()}["a"] == "factor_s"
    by_override = P.profile(df, ["a"], overrides={"a": "factor_s"}).collect()
    assert len(by_override[0]["categories"]) == 1500
    for approx in (False, True):
        got = P.profile(df, ["a"], stored=small, approx=approx).collect()
        assert got[0]["categories"] == by_override[0]["categories"] and got[0]["value_range"] == by_override[0]["value_range"]


def test_trees_split_between_any_two_of_many_values(spark):
    from cohortlab.operators import cluster as K
    from cohortlab.operators import risk as R
    df = spark.range(20_000).selectExpr("id % 500 AS x", "CAST(id % 500 > 347 AS INT) AS y")
    model, acc = K.mine_rules(df, ["x"], "y", max_depth=1)
    assert acc == 1.0 and K.tree_rules(model, ["x"])[0][2] == "`x` <= 347.5"
    coarse = K.mine_rules(df, ["x"], "y", max_depth=1, max_bins=32)[1]
    assert coarse < 1.0
    forest = R.fit_forest(df, ["x"], "y", n_trees=1)
    assert "347.5" in forest.toDebugString
