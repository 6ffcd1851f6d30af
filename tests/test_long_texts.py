"""Long texts are counted by digest and fetched only where they are listed."""

from pyspark.sql import functions as F

from cohortlab.operators import profile as P


def _texts(spark, n):
    return spark.range(n * 3).select((F.col("id") % n).alias("k"), F.concat(F.repeat(F.lit("long text "), 50), (F.col("id") % n).cast("string")).alias("t"),
                                     F.when(F.col("id") % 2 == 0, F.lit("s")).alias("s"), F.array(F.repeat(F.lit("y"), 80)).alias("a"))


def test_profile_and_counts_of_long_texts(spark):
    df = _texts(spark, 20)
    prof = {r["col_name"]: r for r in P.profile(df).collect()}
    assert prof["t"]["col_factornum"] == 20 and prof["t"]["col_datatype"] == "factor_s"
    assert sorted(prof["t"]["categories"]) == sorted("long text " * 50 + str(i) for i in range(20))
    assert prof["s"]["categories"] == ["s"] and prof["a"]["col_factornum"] == 1
    counts = {(r["col_name"], r["val"]): r["cnt"] for r in P.value_counts(df).collect()}
    assert counts["t", "long text " * 50 + "7"] == 3 and counts["s", "s"] == 30 and counts["k", "3"] == 3


def test_text_over_the_cap_is_neither_key_nor_listed(spark):
    df = _texts(spark, 40)
    prof = P.profile(df, cap=30)
    row = {r["col_name"]: r for r in prof.collect()}["t"]
    assert (row["col_datatype"], row["col_factornum"], row["categories"]) == ("character", 40, None)
    plan = P.value_counts(df, texts=False)._jdf.queryExecution().optimizedPlan().toString()
    agg = next(line for line in plan.splitlines() if "Aggregate [" in line)
    assert "_g#" in agg and "_t#" not in plan
    forced = P.profile(df, cap=30, overrides={"t": "factor_s"})
    assert len({r["col_name"]: r for r in forced.collect()}["t"]["categories"]) == 40
    assert P.factor_values(df, forced).where("col_name = 't'").count() == 40


def test_approximate_profile_scans_the_column_statistics_once(spark):
    df = _texts(spark, 20)
    exact = {r["col_name"]: r.asDict() for r in P.profile(df).collect()}
    rough = {r["col_name"]: r.asDict() for r in P.profile(df, approx=True).collect()}
    assert rough == exact                                        # all columns are under the cap: counted exactly
