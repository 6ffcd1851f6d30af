"""The reference's end-to-end demo flow on a heart-like CSV, plus storage,
change tracking and the ML invariants."""

import os
import random

import pytest
from pyspark.sql import functions as F

from cohortlab.operators import cleanse as C
from cohortlab.operators import cluster as K
from cohortlab.operators import combine as J
from cohortlab.operators import features as FE
from cohortlab.operators import profile as P
from cohortlab.operators import risk as R
from cohortlab.operators import select as SEL
from cohortlab.sources import datasets as S

TWO = ["c02", "c06", "c09"]
FEW = ["c03", "c07", "c11", "c12", "c13"]


def write_heart_like(path, n=300, seed=5):
    """c01..c13 doubles and a 1/2 label; c02, c06, c09 two-valued; c03, c07,
    c11, c12, c13 with 3-4 values; the rest continuous (invented values)."""
    rnd = random.Random(seed)
    lines = [",".join([f"c{i:02d}" for i in range(1, 14)] + ["label"])]
    for _ in range(n):
        row = []
        for i in range(1, 14):
            name = f"c{i:02d}"
            if name in TWO:
                row.append(str(float(rnd.randint(0, 1))))
            elif name in FEW:
                row.append(str(float(rnd.randint(0, 2 + i % 2))))
            else:
                row.append(f"{rnd.gauss(50, 10):.3f}")
        y = 2 if float(row[1]) + rnd.random() > 1.0 else 1
        row.append(str(y))
        lines.append(",".join(row))
    lines.append(",".join(["NaN"] + ["1.0"] * 12 + ["1"]))
    with open(path, "w") as f:
        f.write("\n".join(lines) + "\n")


def test_heart_flow(spark, tmpdir_path):
    csv = os.path.join(tmpdir_path, "heart.csv")
    write_heart_like(csv)
    ws = S.Workspace(spark, os.path.join(tmpdir_path, "ws"))
    # register 250 rows in file order
    heart = S.read_csvs(spark, "heart.csv", "250", base_dir=tmpdir_path)["df_heart"]
    heart = ws.save(heart, "df_heart")
    assert heart.count() == 250
    assert [r[0] for r in heart.orderBy("_row_id").select("_row_id").limit(3).collect()] == [0, 1, 2]
    ws.update_registry(S.fingerprint(heart, name="df_heart"))
    # profile; the two-valued columns come out factor_s
    prof = ws.save_profile(P.profile(heart), "df_heart")
    types = {r["col_name"]: r["col_datatype"] for r in prof.collect()}
    assert all(types[c] == "factor_s" for c in TWO) and types["c01"] == "numeric"
    # user sets five columns to factor_s; only those are re-profiled
    prof = P.retag(heart, prof, {c: "factor_s" for c in FEW})
    assert {r["col_name"] for r in prof.filter(F.col("col_datatype") == "factor_s").collect()} == set(TWO + FEW + ["label"])
    # explode the 8 factors into a new dataset, drop the originals, re-profile
    derived = ws.save(FE.explode_factors(heart, TWO + FEW), "df_heart_derived_factor")
    assert all(c.startswith("drv_f_") for c in derived.columns if c != "_row_id")
    kept = C.drop_columns(heart, TWO + FEW)
    assert P.profile(kept).count() == 13 - 8 + 1
    # side-by-side concat on row identity, export, read back as the analytics input
    out = ws.save(J.concat_columns(kept, derived), "df_heart_output")
    assert out.count() == 250
    export = os.path.join(tmpdir_path, "df_heart_output_DATA")
    S.export_csv(out, export, ordered=True)
    back = S.read_csv(spark, export)
    assert back.count() == 250 and "_row_id" in back.columns
    # label split, information gain, top 25 (fewer exist), PCA 5 + 2 clusters, rules
    x, y, shapes = FE.split_label(back, "label")
    assert shapes["x"][1] == len(back.columns) - 2
    yb = FE.recode_label(back, "label", 1)
    scores = SEL.information_gain(yb.drop("_row_id"), "label")
    chosen = SEL.select_top(scores, k=25)
    xs = SEL.select_features(back, chosen)
    feats = [c for c in xs.columns if c != "_row_id"]
    pcs = K.reduce_pca(xs, feats, k=5, keep=["_row_id"])
    clusters, model = K.kmeans(pcs, [f"pc_{i}" for i in range(1, 6)], k=2, n_init=3, keep=["_row_id"])
    data = xs.join(clusters, "_row_id")
    sil = K.silhouette(data, feats).first()["value"]
    assert -1.0 <= sil <= 1.0
    tree, acc = K.mine_rules(data, feats, min_samples_leaf=10, max_depth=10)
    rules = K.apply_tree_rules(data, tree, feats)
    assert rules.agg(F.sum("support")).first()[0] == 250          # leaves partition the rows
    assert 0.0 <= acc <= 1.0
    # data changed -> stale profile, reason 'changed'
    cur = S.fingerprint(out, name="df_heart")
    stale = S.stale_profiles(cur, ws.registry(), P.query_profiles({"df_heart": prof})).first()
    assert stale["reason"] == "changed"


def test_workspace_overwrite_in_place_and_registry(spark, tmpdir_path):
    ws = S.Workspace(spark, os.path.join(tmpdir_path, "ws"))
    df = ws.save(S.stamp_row_ids(spark.range(0, 100)), "nums")
    ws.save_profile(P.profile(df), "nums")
    assert ws.load_profile("nums") is not None
    # overwrite from itself: lineage is cut by a reliable checkpoint first
    again = ws.save(C.filter_expr(ws.load("nums"), "$id$ < 10"), "nums")
    assert again.count() == 10
    assert ws.load_profile("nums") is None                       # stale profile removed
    assert ws.update_registry(S.fingerprint(again, name="nums")).count() == 1
    status = S.detect_changes(ws.registry(), S.fingerprint(again, name="nums")).first()["status"]
    assert status == "same"
    assert ws.update_registry(S.fingerprint(again.filter("id < 5"), name="nums")).count() == 1
    status = S.detect_changes(ws.registry(), S.fingerprint(again, name="nums")).first()["status"]
    assert status == "changed"
    assert ws.names() == ["nums"]
    with pytest.raises(KeyError):
        ws.load("missing")


def test_read_csvs_lengths_must_match(spark):
    with pytest.raises(ValueError):
        S.read_csvs(spark, "a.csv;b.csv", "10")


def test_pca_centred_and_kmeans_best_cost(spark):
    rnd = random.Random(2)
    rows = [(i, rnd.gauss(5, 1), rnd.gauss(-3, 2), rnd.gauss(100, 5)) for i in range(300)]
    df = spark.createDataFrame(rows, "id long, a double, b double, c double")
    pcs = K.reduce_pca(df, ["a", "b", "c"], k=2, keep=["id"])
    means = pcs.agg(F.avg("pc_1"), F.avg("pc_2")).first()
    assert abs(means[0]) < 1e-9 and abs(means[1]) < 1e-9
    out, best = K.kmeans(pcs, ["pc_1", "pc_2"], k=3, n_init=3, keep=["id"])
    single, one = K.kmeans(pcs, ["pc_1", "pc_2"], k=3, n_init=1, keep=["id"])
    assert best.summary.trainingCost <= one.summary.trainingCost + 1e-9
    assert out.count() == 300


def test_significance_p_values(spark):
    rows = [(i % 2, float(i % 2) * 5 + (i % 7), i % 3) for i in range(200)]
    df = spark.createDataFrame(rows, "cluster_id int, num double, cat int")
    types = K.type_features(df, ["num", "cat"])
    stats = K.p_values(K.cluster_significance(df, ["num", "cat"], types))
    got = {r["feature_name"]: r for r in stats.collect()}
    assert got["num"]["test"] == "anova" and got["num"]["p_value"] < 1e-6
    assert got["cat"]["test"] == "chi2" and 0.0 <= got["cat"]["p_value"] <= 1.0


def test_risk_model_end_to_end(spark):
    rnd = random.Random(9)
    rows = [(i, rnd.random(), rnd.random()) for i in range(400)]
    df = spark.createDataFrame(rows, "id long, a double, b double").withColumn(
        "y", (F.col("a") + 0.2 * F.col("b") > 0.6).cast("int"))
    data = R.stratified_split(FE.min_max(df, ["a", "b"]), "y", "id", 0.25, seed=4)
    model = R.fit_logistic(data.filter("split = 'train'"), ["a", "b"], "y")
    coef = R.coefficients(model, ["a", "b"]).collect()
    assert coef[0]["feature_name"] == "a"
    scored = R.score(model, data, ["a", "b"])
    auc = {r["split"]: r["auc"] for r in R.auc(R.roc_points(scored, "y", "p")).collect()}
    assert auc["test"] > 0.8
    forest = R.fit_forest(data.filter("split = 'train'"), ["a", "b"], "y", n_trees=10)
    assert R.coefficients(forest, ["a", "b"]).count() == 2
