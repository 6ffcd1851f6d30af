"""The flows in cohortlab.plans.flows."""

import os
import random

from pyspark.sql import functions as F

from cohortlab.plans import flows as FL
from cohortlab.sources import datasets as S


def _ws(spark, tmpdir_path):
    ws = S.Workspace(spark, os.path.join(tmpdir_path, "ws"))
    rnd = random.Random(4)
    rows = [(i, rnd.choice(["a", "b", "c"]), rnd.random(), rnd.randint(1, 2)) for i in range(200)]
    df = S.stamp_row_ids(spark.createDataFrame(rows, "pid long, grp string, x double, label int"))
    ws.save(df, "cohort")
    return ws


def test_profile_flow_is_incremental(spark, tmpdir_path):
    ws = _ws(spark, tmpdir_path)
    first = FL.profile_datasets(ws)
    assert first.count() == 4 and set(first.columns) >= {"dataset", "col_name", "col_datatype"}
    path = ws.profile_path("cohort")
    stamp = os.path.getmtime(path)
    FL.profile_datasets(ws)                                  # fresh: not recomputed
    assert os.path.getmtime(path) == stamp
    counts = FL.filter_to_dataset(ws, "cohort", "$x$ > 0.5", "cohort").first()
    assert counts["n_rows"] == 200 and 0 < counts["n_kept"] < 200
    assert ws.load_profile("cohort") is None                 # derived data drops its profile
    again = FL.profile_datasets(ws)
    assert again.filter(F.col("col_name") == "x").first()["n_rows"] == counts["n_kept"]


def test_join_flow(spark, tmpdir_path):
    ws = _ws(spark, tmpdir_path)
    ws.save(ws.load("cohort").select("_row_id", F.col("x").alias("x2")), "extra")
    shape = FL.join_to_dataset(ws, "cohort", "extra", "both", by_rows=True, how="left").first()
    assert (shape["n_rows"], shape["n_cols"]) == (200, 6)


def test_risk_and_cluster_flows(spark):
    rnd = random.Random(8)
    rows = [(i, rnd.random(), rnd.random(), rnd.randint(0, 1)) for i in range(300)]
    df = spark.createDataFrame(rows, "pid long, a double, b double, flag int").withColumn(
        "label", F.when(F.col("a") > 0.5, 2).otherwise(1))
    out = FL.risk_flow(df, ["a", "b", "flag"], "label", "pid", 0.2, 0.5, "LR", seed=2)
    auc = {r["split"]: r["auc"] for r in out["auc"].collect()}
    assert auc["test"] > 0.9
    assert out["weights"].first()["feature_name"] == "a"
    c = FL.cluster_flow(df, ["a", "b", "flag"], "label", id_col="pid", n_components=2, n_clusters=2, n_init=2)
    assert c["clusters"].count() == 300
    assert c["rules"].agg(F.sum("support")).first()[0] == 300
    assert c["table"].agg(F.sum("TOTAL")).first()[0] == 300


def test_column_actions(spark, tmpdir_path):
    ws = _ws(spark, tmpdir_path)
    FL.profile_datasets(ws)
    prof = FL.column_action(ws, "cohort", ["grp"], "DEL")
    assert set(ws.load("cohort").columns) == {"_row_id", "pid", "x", "label"}
    assert {r["col_name"] for r in prof.collect()} == {"pid", "x", "label"}
    # profile still fresh after the action: the registry was renewed
    reasons = S.stale_profiles(S.fingerprint(ws.load("cohort"), name="cohort"), ws.registry(),
                               ws.load_profile("cohort").withColumn("dataset", F.lit("cohort"))).first()
    assert reasons["reason"] == "fresh"
    rows = FL.column_action(ws, "cohort", ["x"], "CREATE", "only_x")
    assert ws.load("only_x").columns == ["_row_id", "x"] and rows.count() == 1
    FL.column_action(ws, "cohort", ["pid"], "REMAIN")
    assert ws.load("cohort").columns == ["_row_id", "pid"]
    import pytest
    with pytest.raises(ValueError):
        FL.column_action(ws, "cohort", ["pid"], "SHRED")


def test_register_flow_and_parquet(spark, tmpdir_path):
    for stem, n in (("2009", 30), ("2010", 40)):
        with open(os.path.join(tmpdir_path, f"{stem}.csv"), "w") as f:
            f.write("DESYNPUF_ID,amt\n" + "\n".join(f"P{i:03d},{i * 1.5}" for i in range(n)) + "\n")
    ws = S.Workspace(spark, os.path.join(tmpdir_path, "ws"))
    reg = {r["dataset"]: r["n_rows"] for r in FL.register_datasets(ws, "2009.csv;2010.csv", "10;1000",
                                                                   base_dir=tmpdir_path).collect()}
    assert reg == {"df_2009": 10, "df_2010": 40}
    first = [r["DESYNPUF_ID"] for r in ws.load("df_2009").orderBy("_row_id").collect()]
    assert first == [f"P{i:03d}" for i in range(10)]
    pq = S.read_parquet(spark, "/root/testdata/sf0.001/orders.parquet", nrows=5)
    assert [r["o_orderkey"] for r in pq.orderBy("_row_id").collect()] == [0, 1, 2, 3, 4]


def test_feature_handlers(spark, tmpdir_path):
    ws = S.Workspace(spark, os.path.join(tmpdir_path, "ws"))
    rows = [(1, "20100105", "a"), (2, "bad", "b"), (3, None, "a")]
    ws.save(S.stamp_row_ids(spark.createDataFrame(rows, "pid int, d string, g string")), "visits")
    FL.profile_datasets(ws)
    days = {r["_row_id"]: r["drv_d"] for r in
            FL.derive_dates(ws, "visits", ["d"], "2010-01-10", prefix="drv_", new_name="visit_days").collect()}
    assert days == {0: 5, 1: None, 2: None}
    assert dict(ws.load("visits").dtypes)["d"] == "date" and ws.load_profile("visits") is None
    hot = FL.explode_to_dataset(ws, "visits", ["g"], new_name="visit_g")
    assert sorted(c for c in hot.columns if c != "_row_id") == ["drv_f_g_a", "drv_f_g_b"]
    present = FL.derive_to_dataset(ws, "visits", "d", "isnull", "d_present", "visit_flags")
    assert [r["d_present"] for r in present.orderBy("_row_id").collect()] == [True, False, False]
