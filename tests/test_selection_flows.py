"""Selection pages as flows over stored datasets."""

import pytest

from cohortlab.plans import flows as FL
from cohortlab.sources import datasets as S


def test_selection_flows(spark, tmpdir_path):
    ws = S.Workspace(spark, f"{tmpdir_path}/ws")
    df = S.stamp_row_ids(spark.createDataFrame([(i, i % 2, f"g{i % 3}", float(i), 1 + (i % 2)) for i in range(60)],
                                               "pid int, flag int, grp string, x double, label int"))
    ws.save(df, "a")
    FL.profile_datasets(ws, ["a"], distributions=False)
    FL.retag_dataset(ws, "a", {"x": "character"})
    assert FL.select_columns_to_dataset(ws, "a", "CREATE", "nums", data_type="numeric") == ["pid"]      # the stored type counts
    assert ws.load("nums").columns == ["_row_id", "pid"]
    with pytest.raises(ValueError):
        FL.select_columns_to_dataset(ws, "a", "REMAIN", data_type="datetime")
    assert len(ws.load("a").columns) == 6
    ws.save(spark.createDataFrame([(3,), (4,), (4,), (None,), (99,)], "DESYNPUF_ID int"), "ids")
    counts = FL.filter_by_ids_to_dataset(ws, "a", "ids", "a")
    assert tuple(counts.first()) == (2, 60)
    assert ws.load("a").count() == counts.first()["n_kept"] and ws.load_profile("a") is None
    ws.save(df, "b")
    chosen = FL.select_features_to_dataset(ws, "b", "label", "b_best", k=1)
    assert [r["feature_name"] for r in chosen.collect()] == ["flag"]
    assert ws.load("b_best").columns == ["_row_id", "flag", "label"] and ws.load("b_best").agg({"label": "max"}).first()[0] == 2
