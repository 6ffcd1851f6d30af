"""Training-data pipeline over ``documents``: quality rules, line dedup, one
document of each near-duplicate group, benchmark decontamination, encoding.

Every stage reads the whole result of the stage before, written as Parquet in
the shared folder.  All but the last return the columns of ``documents``.
When a stage starts on a written input, the tables that earlier stages kept
in the shared folder for their own use are removed.
"""

from __future__ import annotations

from functools import wraps

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortlab.llm import bpe_prefix, decontaminate, line_dedup, ngram_join, quality_rules
from cohortlab.llm.common import remove_folders, small_batches, table, tracked_folders, written

NEAR_PERCENT = 80
NEAR_SHINGLE = 5


_LEFT: list[str] = []             # tables of stages that have ended


def _stage(fn):
    """Remove what earlier stages left, then run the stage and note the tables it makes for itself.  Nothing is removed
    while the input is still a plan over those tables (or one whose files are not known, such as a cached one)."""
    @wraps(fn)
    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        files = docs.inputFiles() if _LEFT else []
        own = {path.rstrip("/").rsplit("/", 1)[-1] for path in _LEFT}
        if files and not any(own & set(f.split("/")) for f in files):
            remove_folders(spark, _LEFT)
            _LEFT.clear()
        small_batches(spark)
        with tracked_folders() as made:
            out = fn(spark, docs, sf_dir)
        _LEFT.extend(made)
        return out
    return run_stage


@_stage
def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep the documents that the base rules and the trained trees accept."""
    model = quality_rules.fit_quality_model(docs, table(spark, sf_dir, "labels"))
    columns = docs.columns
    rest = [c for c in columns if c != "doc_id"]
    # plain field names inside, whatever the columns are called
    packed = docs.select("doc_id", "text", F.struct(*[docs[_quoted(c)].alias(f"c{i}") for i, c in enumerate(rest)]).alias("row__"))
    scored = quality_rules.document_statistics(packed, model=model, extra=["row__"],
                                               schema_extra=f", row__ {packed.schema['row__'].dataType.simpleString()}")
    back = {c: F.col(f"row__.c{i}").alias(c) for i, c in enumerate(rest)}
    return scored.where("kept").select(*[back.get(c, F.col("doc_id")) for c in columns])


def _quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


@_stage
def line_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return line_dedup.dedup_lines(docs)


@_stage
def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return ngram_join.one_per_group(docs, percent=NEAR_PERCENT, size=NEAR_SHINGLE)


@_stage
def decontaminate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.decontaminate(docs, table(spark, sf_dir, "benchmark"))


@_stage
def encode_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return bpe_prefix.encode_documents(docs, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)


STAGES = [("quality_rules", quality_stage), ("line_dedup", line_dedup_stage), ("near_duplicates", near_duplicate_stage),
          ("decontaminate", decontaminate_stage), ("encode", encode_stage)]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs = written(docs, f"pipeline-{name}")
    return docs
