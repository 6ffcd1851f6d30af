"""Distributions stored with the profile, refreshed column by column."""

import os

import pytest
from pyspark.sql import functions as F

from cohortlab.operators import profile as P
from cohortlab.plans import flows as FL
from cohortlab.sources import datasets as S


def _files(root):
    return {os.path.join(d, f): os.stat(os.path.join(d, f)).st_mtime_ns for d, _, fs in os.walk(root) for f in fs if f.endswith(".parquet")}


def test_retagging_rewrites_only_its_columns(spark, tmpdir_path):
    ws = S.Workspace(spark, f"{tmpdir_path}/ws")
    df = spark.range(300).select("id", (F.col("id") % 5).alias("code"), (F.col("id") % 7).alias("other"), (F.col("id") * 0.5).alias("x.y"),
                                 F.concat(F.lit("g"), (F.col("id") % 3).cast("string")).alias("grp"))
    ws.save(df, "t")
    FL.profile_datasets(ws)
    hist = {r["col_name"] for r in ws.load_distribution("histogram", "t").select("col_name").distinct().collect()}
    assert hist == {"id", "code", "other", "x.y"}
    assert {r["col_name"] for r in ws.load_distribution("box", "t").collect()} == hist
    assert {r["val"]: r["cnt"] for r in ws.load_distribution("counts", "t").collect()} == {"g0": 100, "g1": 100, "g2": 100}
    before = _files(f"{tmpdir_path}/ws/_distributions")
    prof = FL.retag_dataset(ws, "t", {"code": "factor_s", "other": "factor_s"})
    types = {r["col_name"]: r["col_datatype"] for r in prof.collect()}
    assert types["code"] == types["other"] == "factor_s" and types["x.y"] == "numeric"
    after = _files(f"{tmpdir_path}/ws/_distributions")
    assert {r["col_name"] for r in ws.load_distribution("histogram", "t").select("col_name").distinct().collect()} == {"id", "x.y"}
    assert ws.load_distribution("counts", "t").where("col_name = 'code'").agg(F.sum("cnt")).first()[0] == 300
    touched = {f for f in set(before) | set(after) if before.get(f) != after.get(f)}
    assert touched and all("col_name=code" in f or "col_name=other" in f for f in touched)
    back = FL.retag_dataset(ws, "t", {"code": "numeric"})
    assert back.where("col_name = 'code'").first()["col_datatype"] == "numeric"
    assert ws.load_distribution("counts", "t").where("col_name = 'code'").count() == 0
    assert ws.load_distribution("histogram", "t").where("col_name = 'code'").count() == 10


def test_stored_equals_computed_and_fresh_is_kept(spark, tmpdir_path):
    ws = S.Workspace(spark, f"{tmpdir_path}/ws")
    df = spark.range(100).select("id", (F.col("id") * F.col("id")).cast("double").alias("sq"))
    ws.save(df, "a")
    ws.save(df.where("id < 50"), "b")
    FL.profile_datasets(ws)
    for kind, made in (("histogram", P.histogram(df)), ("box", P.box_summary(df))):
        cols = [c for c in ws.load_distribution(kind).columns if c != "dataset"]
        assert sorted(map(tuple, ws.load_distribution(kind, "a").select(*cols).collect())) == sorted(map(tuple, made.select(*cols).collect()))
    stamp = _files(f"{tmpdir_path}/ws/_distributions")
    FL.profile_datasets(ws)
    assert _files(f"{tmpdir_path}/ws/_distributions") == stamp
    with pytest.raises(KeyError):
        FL.retag_dataset(ws, "a", {"nope": "numeric"})
    with pytest.raises(ValueError):
        ws.load_distribution("pie")
