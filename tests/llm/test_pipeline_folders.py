"""Tables of ended stages go when the next stage starts on a written input, not before."""

import os

from cohortlab.llm.common import written
from cohortlab.session import ensure_checkpoint_dir


def _folders(spark):
    root = ensure_checkpoint_dir(spark).replace("file:", "")
    return {f for f in os.listdir(root) if f.startswith(("line-", "ngram-"))}


def test_stage_tables_are_removed_after_the_commit(spark):
    import corpus_pipeline as P
    stages = dict(P.STAGES)
    d = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{d}/documents.parquet")
    before = _folders(spark)
    out = stages["line_dedup"](spark, docs, d)
    kept = _folders(spark) - before
    assert kept
    lazy = stages["decontaminate"](spark, out, d)                 # its input is still a plan over those tables
    assert kept <= _folders(spark) and lazy.count() > 0
    done = written(out, "pipeline-line_dedup")
    nxt = stages["near_duplicates"](spark, done, d)
    assert not kept & _folders(spark) and nxt.count() > 0


def test_odd_column_names_pass_every_stage(spark):
    from pyspark.sql import functions as F
    import corpus_pipeline as P
    d = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{d}/documents.parquet").select("*", F.lit(1).alias("a b"), F.lit(2).alias("gone"))
    for name in ("quality_rules", "near_duplicates"):
        out = dict(P.STAGES)[name](spark, docs, d)
        assert out.columns == docs.columns and out.where("`a b` = 1 and gone = 2").count() == out.count() > 0
