"""Files, versions and change tracking: order over parts, bounded reads, CSV both ways, half-written saves, digests by column."""

import os

import pytest
from pyspark.sql import functions as F

from cohortlab.operators import profile as P
from cohortlab.sources import datasets as S

ODD = ['he said "hi", ok', 'x "hi"', "", None, " lead", "trail ", "a\nb", "a\r\nb", '"', '""', ",", "#c", "é", "\\", "a\\b", '\\"', "\t",
       "null", "\n", 'a"b', "\\N", " ", "NaN"]


def _parts(spark, path, kind):
    """Three parts whose name order is not their size order."""
    start = 0
    for name, n in (("part-0", 5), ("part-1", 60), ("part-2", 20)):
        df = spark.range(start, start + n).select((F.col("id") * 2).alias("k"), F.concat(F.lit("t"), "id").alias("t")).coalesce(1)
        one = f"{path}/w-{name}"
        (df.write.option("header", True).csv(one) if kind == "csv" else df.write.parquet(one))
        os.makedirs(f"{path}/all", exist_ok=True)
        src = next(f for f in os.listdir(one) if f.endswith(kind))
        with open(f"{one}/{src}", "rb") as a, open(f"{path}/all/{name}.{kind}", "wb") as b:
            b.write(a.read())
        start += n
    return f"{path}/all"


@pytest.mark.parametrize("kind", ["csv", "parquet"])
def test_ids_follow_file_order(spark, tmpdir_path, kind):
    path = _parts(spark, tmpdir_path, kind)
    read = S.read_csv if kind == "csv" else S.read_parquet
    rows = [(r["_row_id"], r["k"], r["t"]) for r in read(spark, path).orderBy("_row_id").collect()]
    assert rows == [(i, 2 * i, f"t{i}") for i in range(85)]
    for n in (1, 5, 6, 70, 200):
        assert sorted(r["k"] for r in read(spark, path, nrows=n).collect()) == [2 * i for i in range(min(n, 85))]


def test_ids_over_many_blocks(spark, tmpdir_path):
    path = f"{tmpdir_path}/big.csv"
    with open(path, "w") as f:
        f.write("k,pad\n" + "".join(f"{i},{'p' * (i % 90)}\n" for i in range(40_000)))
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "64k")
    try:
        df = S.read_csv(spark, path)
        assert df.rdd.getNumPartitions() > 1
        assert df.where("_row_id <> k").count() == 0 and df.count() == 40_000
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)


def test_first_rows_read_few_bytes(spark, tmpdir_path):
    path = f"{tmpdir_path}/lineitem"
    spark.read.parquet("/root/testdata/sf0.1/lineitem.parquet").coalesce(4).write.option("header", True).csv(path)
    size = sum(os.path.getsize(f"{path}/{f}") for f in os.listdir(path) if f.endswith(".csv"))
    jvm = spark._jvm.org.apache.hadoop.fs.FileSystem

    def read_so_far():
        return sum(s.getBytesRead() for s in jvm.getAllStatistics() if s.getScheme() == "file")
    before = read_so_far()
    df = S.read_csv(spark, path, nrows=1000)
    assert df.count() == 1000 and dict(df.dtypes)["l_quantity"] == "double"
    assert read_so_far() - before < 0.05 * size


def test_export_and_read_give_equal_rows(spark, tmpdir_path):
    rows = [(i, v, (v or "")[::-1], float(i) if i % 3 else None) for i, v in enumerate(ODD)]
    df = S.stamp_row_ids(spark.createDataFrame(rows, "n int, v string, w string, x double").repartition(3, "n").sortWithinPartitions("n"))
    want = [(r["_row_id"], r["n"], r["v"], r["w"], r["x"]) for r in df.orderBy("_row_id").collect()]
    S.export_csv(df, f"{tmpdir_path}/out", ordered=True)
    assert len([f for f in os.listdir(f"{tmpdir_path}/out") if f.endswith(".csv")]) >= 1
    for kw in ({}, {"multi_line": True}, {"nrows": len(rows)}):
        back = S.read_csv(spark, f"{tmpdir_path}/out", schema="n int, v string, w string, x double", **kw)
        got = [(r["_row_id"], r["n"], r["v"], r["w"], r["x"]) for r in back.orderBy("_row_id").collect()]
        fixed = [(a, b, c.replace("\r\n", "\n") if c else c, d.replace("\r\n", "\n"), e) for a, b, c, d, e in want]
        assert [(a, b, c.replace("\r\n", "\n") if c else c, d.replace("\r\n", "\n"), e) for a, b, c, d, e in got] == fixed
    plain = S.read_csv(spark, f"{tmpdir_path}/out", schema="n int, v string, w string, x double", empty_as_null=True)
    assert plain.where("v is null").count() == 2


def test_line_breaks_are_found(spark, tmpdir_path):
    for text, want in (('a,b\n1,"x ""y"" z"\n', False), ('a,b\n1,"x\ny"\n', True)):
        path = f"{tmpdir_path}/f{want}.csv"
        with open(path, "w") as f:
            f.write(text)
        assert S.read_csv(spark, path).count() == 1
        from cohortlab.sources.files import has_line_breaks_in_fields
        assert has_line_breaks_in_fields(spark, path) is want


def test_a_save_that_dies_leaves_the_old_version(spark, tmpdir_path):
    ws = S.Workspace(spark, f"{tmpdir_path}/ws")
    ws.save(spark.range(10), "d")
    ws.save_profile(P.profile(ws.load("d")), "d")
    dies = spark.range(0, 1000, 1, 4).select(F.when(F.col("id") == 900, F.raise_error(F.lit("gone")).cast("long")).otherwise(F.col("id")).alias("id"))
    with pytest.raises(Exception, match="gone"):
        ws.save(dies, "d")
    assert ws.load("d").count() == 10 and ws.load_profile("d") is not None and ws.names() == ["d"]
    held = ws.load("d")
    ws.save(ws.load("d").where("id < 5"), "d")                    # reads what it replaces
    assert ws.load("d").count() == 5 and held.count() == 10       # the version before stays for open readers
    assert ws.load_profile("d") is None
    for n in (4, 3, 2):
        ws.save(ws.load("d").where(f"id < {n}"), "d")
    assert len([f for f in os.listdir(f"{tmpdir_path}/ws/d") if f.startswith("data-")]) == 2
    ws.drop("d")
    assert ws.names() == []


def test_a_null_is_no_text(spark):
    a = spark.createDataFrame([(1, None), (2, "x")], "k int, v string")
    b = spark.createDataFrame([(1, "\\N"), (2, "x")], "k int, v string")
    c = spark.createDataFrame([(1, "\\\\N"), (2, "x")], "k int, v string")
    prints = {S.fingerprint(d, name="d").first()["fingerprint"] for d in (a, b, c)}
    assert len(prints) == 3
    for method in ("md5", "xxhash64"):
        st = {r["col_name"]: r["status"] for r in S.detect_column_changes(S.column_digests(a, "d", method=method),
                                                                         S.column_digests(b, "d", method=method)).collect()}
        assert st == {"k": "same", "v": "changed"}


def test_renames_additions_and_removals(spark):
    a = spark.createDataFrame([(1, "x", 2.0, 7), (2, "y", 3.0, 7)], "k int, v string, d double, old int")
    b = a.select("k", F.col("v").alias("v2"), (F.col("d") + 1).alias("d"), F.col("v").alias("v3"))
    got = {r["col_name"]: (r["status"], r["old_name"]) for r in S.detect_column_changes(S.column_digests(a, "t"), S.column_digests(b, "t")).collect()}
    assert got == {"k": ("same", "k"), "v2": ("renamed", "v"), "d": ("changed", "d"), "v3": ("added", None), "old": ("removed", "old")}


def test_stale_reasons_by_dataset(spark):
    a = spark.createDataFrame([(1, "x"), (2, "y")], "k int, v string")
    cur = S.fingerprint(a.withColumnRenamed("v", "w"), name="t").unionByName(S.fingerprint(a, name="u")).unionByName(S.fingerprint(a, name="n"))
    reg = S.fingerprint(a, name="t").unionByName(S.fingerprint(a, name="u")).unionByName(S.fingerprint(a, name="n"))
    full = P.profile(a)
    got = {r["dataset"]: r["reason"] for r in S.stale_profiles(cur, reg, {"t": full, "u": full, "n": full.drop("categories")}).collect()}
    assert got == {"t": "changed", "u": "fresh", "n": "profile_width"}
