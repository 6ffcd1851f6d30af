"""Datasets: change tracking (S6-S10); reading and writing files
and the dataset store (S3, S4) come from ``files`` and ``workspace``.

A dataset is a DataFrame with a dense ``_row_id`` stamped once at
registration.  Change tracking works on commutative digests: one of the rows
of a dataset and, to name what changed, one of every column.
"""

from __future__ import annotations

from collections.abc import Iterable, Mapping

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cohortlab.functions.columns import ROW_ID, data_columns, qcol, tagged_text
from cohortlab.sources.files import (  # noqa: F401
    dataset_name, export_csv, nan_to_null, read_csv, read_csvs, read_parquet, stamp_row_ids,
)

SEP = "\u001f"                     # unit separator between values in a row text
REGISTRY_SCHEMA = "dataset string, n_rows bigint, n_cols int, col_list string, fingerprint decimal(38,0)"


# ---------------------------------------------------------------- S6

def preview(df: DataFrame, n: int = 20) -> DataFrame:
    """First ``n`` rows by ``_row_id`` (a top-k, not a full sort)."""
    if ROW_ID in df.columns:
        return df.orderBy(ROW_ID).limit(n)
    return df.limit(n)


def shape(df: DataFrame) -> DataFrame:
    """``(n_rows, n_cols)`` as a one-row DataFrame."""
    return df.agg(F.count(F.lit(1)).alias("n_rows"),
                  F.lit(len(data_columns(df))).alias("n_cols"))


# ---------------------------------------------------------------- S7-S10

def row_text(cols: list[str]):
    return F.concat_ws(SEP, *[tagged_text(qcol(c)) for c in cols])


def row_hash(cols: list[str]):
    """First 15 hex digits of the row text's md5, as a number."""
    return F.conv(F.substring(F.md5(row_text(cols)), 1, 15), 16, 10).cast(T.DecimalType(38, 0))


def fingerprint(df: DataFrame, name: str | None = None, cols: Iterable[str] | None = None,
                by: str | None = None, method: str = "md5") -> DataFrame:
    """Order-insensitive content fingerprint.

    Sum of per-row hashes as ``decimal(38,0)`` plus row count and column
    list; one aggregate, no sort.  ``by`` fingerprints every group of a
    column as its own dataset in the same job.  ``method="md5"`` hashes the
    row text (portable: other engines reproduce it); ``"xxhash64"`` hashes
    the typed values directly, far cheaper per row, for use within Spark.
    Compare fingerprints made with the same method only.
    """
    cols = data_columns(df, cols)
    col_list = ",".join(cols)
    if method == "md5":
        h = row_hash(cols).alias("_h")
    elif method == "xxhash64":
        h = F.xxhash64(*[qcol(c) for c in cols]).cast(T.DecimalType(38, 0)).alias("_h")
    else:
        raise ValueError(f"unknown fingerprint method {method!r}")
    aggs = [F.count(F.lit(1)).alias("n_rows"),
            F.lit(len(cols)).alias("n_cols"),
            F.lit(col_list).alias("col_list"),
            F.coalesce(F.sum("_h"), F.lit(0).cast(T.DecimalType(38, 0))).cast(T.DecimalType(38, 0)).alias("fingerprint")]
    if by is not None:
        return (df.select(qcol(by).cast("string").alias("dataset"), h)
                .groupBy("dataset").agg(*aggs))
    if name is None:
        raise ValueError("name is required without 'by'")
    return df.select(h).agg(*aggs).select(F.lit(name).alias("dataset"), "*")


def upsert_fingerprints(old: DataFrame, new: DataFrame) -> DataFrame:
    """New (dataset, fingerprint) rows replace old ones, others stay."""
    return (old.join(new.select("dataset"), "dataset", "left_anti")
            .unionByName(new.select(*old.columns)))


def detect_changes(old: DataFrame, new: DataFrame) -> DataFrame:
    """Status ``new`` / ``changed`` / ``same`` for every new dataset."""
    o = old.select("dataset", F.col("n_rows").alias("_o_rows"), F.col("col_list").alias("_o_cols"),
                   F.col("fingerprint").alias("_o_fp"))
    j = new.join(o, "dataset", "left")
    status = (F.when(F.col("_o_fp").isNull(), F.lit("new"))
              .when((F.col("_o_fp") != F.col("fingerprint")) | (F.col("_o_rows") != F.col("n_rows"))
                    | (F.col("_o_cols") != F.col("col_list")), F.lit("changed"))
              .otherwise(F.lit("same")))
    return j.select("dataset", "n_rows", "fingerprint", status.alias("status"))


COLUMN_DIGESTS = ("dataset string, col_pos int, col_name string, n_rows bigint, n_null bigint, digest decimal(38,0)")


def column_digests(df: DataFrame, name: str, cols: Iterable[str] | None = None, method: str = "xxhash64") -> DataFrame:
    """S7 by column: ``(dataset, col_pos, col_name, n_rows, n_null, digest)``.

    A digest is the sum of the hashes of a column's values; nulls add nothing and are counted apart, so a null equals
    no text.  All columns in one aggregate without a shuffle of rows.  ``method`` as for ``fingerprint``."""
    cols = data_columns(df, cols)
    if not cols:
        return df.sparkSession.createDataFrame([], COLUMN_DIGESTS)
    if method == "md5":
        one = lambda c: F.conv(F.substring(F.md5(c.cast("string")), 1, 15), 16, 10).cast(T.DecimalType(38, 0))
    elif method == "xxhash64":
        one = lambda c: F.xxhash64(c).cast(T.DecimalType(38, 0))
    else:
        raise ValueError(f"unknown fingerprint method {method!r}")
    zero = F.lit(0).cast(T.DecimalType(38, 0))
    aggs = [F.count(F.lit(1)).alias("n")]
    for i, c in enumerate(cols):
        aggs += [F.count(qcol(c)).alias(f"k{i}"), F.sum(F.when(qcol(c).isNotNull(), one(qcol(c)))).alias(f"d{i}")]
    rows = [F.struct(F.lit(name).alias("dataset"), F.lit(i).alias("col_pos"), F.lit(c).alias("col_name"), F.col("n").alias("n_rows"),
                     (F.col("n") - F.col(f"k{i}")).alias("n_null"),
                     F.coalesce(F.col(f"d{i}"), zero).cast(T.DecimalType(38, 0)).alias("digest")) for i, c in enumerate(cols)]
    return df.agg(*aggs).select(F.inline(F.array(*rows)))


def detect_column_changes(old: DataFrame, new: DataFrame) -> DataFrame:
    """S9 by column: ``(dataset, col_name, status, old_name)`` of every column that either side knows.

    ``same`` / ``changed`` for a name on both sides; a name on one side only is ``renamed`` if the other side has an unpaired
    column of the same content (the k-th of equal ones pairs with the k-th), else ``added`` / ``removed``.  Both tables
    have one row a column."""
    content = ["n_rows", "n_null", "digest"]
    both = new.alias("n").join(old.alias("o"), ["dataset", "col_name"], "inner")
    equal = (F.col("n.digest") == F.col("o.digest")) & (F.col("n.n_null") == F.col("o.n_null")) & (F.col("n.n_rows") == F.col("o.n_rows"))
    known = both.select("dataset", "col_name", F.when(equal, "same").otherwise("changed").alias("status"), F.col("col_name").alias("old_name"))
    order = Window.partitionBy("dataset", *content).orderBy("col_pos", "col_name")
    only_new = new.join(old.select("dataset", "col_name"), ["dataset", "col_name"], "left_anti").withColumn("turn", F.row_number().over(order))
    only_old = old.join(new.select("dataset", "col_name"), ["dataset", "col_name"], "left_anti").withColumn("turn", F.row_number().over(order))
    paired = only_new.join(only_old.select("dataset", *content, "turn", F.col("col_name").alias("old_name")), ["dataset", *content, "turn"], "full")
    other = paired.select("dataset", F.coalesce("col_name", "old_name").alias("col_name"),
                          F.when(F.col("old_name").isNull(), "added").when(F.col("col_name").isNull(), "removed").otherwise("renamed").alias("status"),
                          "old_name")
    return known.unionByName(other)


def stale_profiles(current: DataFrame, registry: DataFrame, profiles: DataFrame | Mapping[str, DataFrame] | None,
                   profile_fields: Iterable[str] | None = None) -> DataFrame:
    """Which datasets need a new profile, and why.

    ``current`` are fresh fingerprints (S7), ``registry`` the stored ones, ``profiles`` the stored profiles: one
    table a dataset, or one table of all with a ``dataset`` column (whose width then counts for each).  Reasons, first
    match wins: ``changed`` (unknown, or another fingerprint, row count or column list, as S9 judges), ``no_profile``,
    ``column_count`` (profile rows != columns), ``profile_width`` (profile fields differ from the expected set), else ``fresh``.
    """
    from cohortlab.operators.profile import PROFILE_FIELDS
    expected = set(profile_fields or PROFILE_FIELDS)
    spark = current.sparkSession
    reg = registry.select("dataset", F.col("fingerprint").alias("_reg_fp"), F.col("n_rows").alias("_reg_rows"), F.col("col_list").alias("_reg_cols"))
    j = current.join(reg, "dataset", "left")
    if profiles is None:
        profiles = {}
    if isinstance(profiles, DataFrame):
        ok = set(profiles.columns) - {"dataset"} == expected
        held = profiles.groupBy("dataset").agg(F.count(F.lit(1)).alias("_prof_rows")).withColumn("_width_ok", F.lit(ok))
    else:
        held = spark.createDataFrame([], "dataset string, _prof_rows bigint, _width_ok boolean")
        for name, p in profiles.items():
            if p is not None:
                held = held.unionByName(p.agg(F.count(F.lit(1)).alias("_prof_rows")).select(
                    F.lit(name).alias("dataset"), "_prof_rows", F.lit(set(p.columns) - {"dataset"} == expected).alias("_width_ok")))
    j = j.join(held, "dataset", "left")
    differs = (F.col("_reg_fp").isNull() | (F.col("_reg_fp") != F.col("fingerprint")) | (F.col("_reg_rows") != F.col("n_rows"))
               | (F.col("_reg_cols") != F.col("col_list")))
    reason = (F.when(differs, F.lit("changed"))
              .when(F.col("_prof_rows").isNull(), F.lit("no_profile"))
              .when(F.col("_prof_rows") != F.col("n_cols"), F.lit("column_count"))
              .when(~F.col("_width_ok"), F.lit("profile_width"))
              .otherwise(F.lit("fresh")))
    return j.select("dataset", reason.alias("reason"), (reason != "fresh").alias("stale"))


from cohortlab.sources.workspace import Workspace  # noqa: E402, F401  (uses the registry above)
