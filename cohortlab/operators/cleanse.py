"""Cleansing (C1-C9): column projections chosen by profile conditions,
row filters by expression, non-null share, another table's IDs or a
user function.  All filters are plain ``Filter`` / semi-join plan nodes, so
Catalyst pushes them into the scan."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortlab.functions.columns import ROW_ID, data_columns, qcol, quoted, unpivot_text
from cohortlab.operators.profile import value_counts


def _with_row_id(df: DataFrame, cols: list[str]) -> list[str]:
    return ([ROW_ID] if ROW_ID in df.columns and ROW_ID not in cols else []) + cols


# ---------------------------------------------------------------- C1-C3

def drop_columns(df: DataFrame, cols: Iterable[str]) -> DataFrame:
    """Drop columns (the row identity always stays)."""
    cols = data_columns(df, cols)
    return df.select(*[qcol(c) for c in df.columns if c not in set(cols)])


def keep_columns(df: DataFrame, cols: Iterable[str]) -> DataFrame:
    """Keep only ``cols`` (plus ``_row_id``), in the given order."""
    cols = data_columns(df, cols)
    return df.select(*[qcol(c) for c in _with_row_id(df, cols)])


def profile_rows(prof: DataFrame, cols: Iterable[str], keep: bool = True) -> DataFrame:
    """Profile kept in step with C1/C2: rows of kept (or not dropped) columns."""
    cond = F.col("col_name").isin(list(cols))
    return prof.filter(cond if keep else ~cond)


# ---------------------------------------------------------------- C4

def _number(value, name: str) -> float | None:
    """Blank or None means 'not given'; other text must be a number."""
    if value is None or (isinstance(value, str) and value.strip() == ""):
        return None
    try:
        return float(value)
    except (TypeError, ValueError):
        raise ValueError(f"condition {name!r} must be a number, got {value!r}") from None


def balance(vc: DataFrame) -> DataFrame:
    """C4e: normalised entropy ``-sum p ln p / ln k`` per column from the
    value-count table (one value -> 0).  Partial sums per column only."""
    c = F.col("cnt").cast("double")
    g = vc.groupBy("col_name").agg(F.sum(c).alias("_n"), F.sum(c * F.log(c)).alias("_clogc"),
                                   F.count(F.lit(1)).alias("n_values"))
    h = F.log(F.col("_n")) - F.col("_clogc") / F.col("_n")
    return g.select("col_name", "n_values",
                    F.when(F.col("n_values") > 1, h / F.log(F.col("n_values").cast("double")))
                    .otherwise(F.lit(0.0)).alias("balance"))


def regex_match(df: DataFrame, regex: str, cols: Iterable[str] | None = None) -> DataFrame:
    """C4f: ``(col_name, all_match)``: every non-null value matches ``regex``
    (a search, as ``rlike``).  One partial aggregate over the unpivot."""
    cols = data_columns(df, cols)
    return (unpivot_text(df, cols).groupBy("col_name")
            .agg(F.bool_and(F.col("val").rlike(regex)).alias("all_match")))


def matching_columns(prof: DataFrame, data_type: str | list[str] | None = None,
                     name_suffix: str | None = None, min_distinct_ratio=None,
                     min_non_missing=None, min_balance=None, value_regex: str | None = None,
                     df: DataFrame | None = None, vc: DataFrame | None = None) -> DataFrame:
    """C4: profile rows of the columns meeting every given condition (AND).

    C4a semantic type (one, a list, or a ``, ``-joined list); C4b name ends
    with a pattern; C4c distinct ratio >= t (unrounded); C4d non-missing
    ratio >= t; C4e balance >= t (needs ``df`` or ``vc``); C4f all values
    match a regex (needs ``df``).  Blank conditions are skipped.
    """
    out = prof
    if isinstance(data_type, str) and data_type.strip():
        data_type = [t.strip() for t in data_type.split(",") if t.strip()]
    if data_type:
        out = out.filter(F.col("col_datatype").isin(list(data_type)))
    if name_suffix is not None and str(name_suffix).strip():
        out = out.filter(F.col("col_name").rlike(f"(?:{name_suffix})$"))
    t = _number(min_distinct_ratio, "min_distinct_ratio")
    if t is not None:
        out = out.filter(F.col("col_factornum").cast("double") / (F.col("n_rows").cast("double") + 1.0) >= t)
    t = _number(min_non_missing, "min_non_missing")
    if t is not None:
        out = out.filter(F.col("n_non_null").cast("double") / F.col("n_rows").cast("double") >= t)
    t = _number(min_balance, "min_balance")
    if t is not None:
        if vc is None:
            if df is None:
                raise ValueError("min_balance needs the dataset or its value counts")
            vc = value_counts(df)
        b = balance(vc).select("col_name", "balance")
        out = out.join(F.broadcast(b), "col_name").filter(F.col("balance") >= t).drop("balance")
    if value_regex is not None and str(value_regex).strip():
        if df is None:
            raise ValueError("value_regex needs the dataset")
        m = regex_match(df, value_regex).filter("all_match").select("col_name")
        out = out.join(F.broadcast(m), "col_name", "left_semi")
    return out


def select_columns(df: DataFrame, prof: DataFrame, **conditions) -> DataFrame:
    """C4 applied: keep the matching columns of ``df`` in their original
    order.  Only the column names (one per column) reach the driver."""
    conditions.setdefault("df", df)
    names = {r["col_name"] for r in matching_columns(prof, **conditions).select("col_name").collect()}
    return keep_columns(df, [c for c in data_columns(df) if c in names])


# ---------------------------------------------------------------- C5-C9

def rewrite_expr(expr: str, symbol: str = "$") -> str:
    """``$name$`` marks a column; it becomes a quoted identifier.  Text literals (in single or double quotes, with
    backslash escapes or doubled quotes) and identifiers already in backticks stay as they are."""
    s = re.escape(symbol)
    token = re.compile(rf"""('(?:[^'\\]|\\.|'')*'|"(?:[^"\\]|\\.|"")*"|`(?:[^`]|``)*`)|{s}(.+?){s}""", re.S)
    return token.sub(lambda m: m.group(1) if m.group(1) is not None else quoted(m.group(2)), expr)


def filter_expr(df: DataFrame, expr: str, symbol: str = "$") -> DataFrame:
    """Keep rows where the SQL predicate is true (null -> dropped)."""
    return df.filter(F.expr(rewrite_expr(expr, symbol)))


def non_null_share(df: DataFrame, cols: Iterable[str] | None = None) -> Column:
    cols = data_columns(df, cols)
    if not cols:
        raise ValueError("no columns to measure the non-null share over")
    present = sum((qcol(c).isNotNull().cast("int") for c in cols), F.lit(0))
    return present.cast("double") / F.lit(float(len(cols)))


def filter_non_null(df: DataFrame, min_share: float, cols: Iterable[str] | None = None) -> DataFrame:
    """Keep rows whose share of non-null values is at least ``min_share``."""
    return df.filter(non_null_share(df, cols) >= float(min_share))


def filter_by_ids(df: DataFrame, ids: DataFrame, key: str | None = None,
                  ids_key: str = "DESYNPUF_ID") -> DataFrame:
    """Rows of ``df`` whose key is among ``ids[ids_key]`` (semi-join).

    The ID side is de-duplicated with a map-side combine first, so a hot ID
    repeated a billion times ships once per partition; AQE broadcasts it
    when small and splits skewed partitions otherwise.  Null never matches.
    """
    key = key or data_columns(df)[0]
    if key not in df.columns:
        raise KeyError(f"{key!r} not in dataset")
    if ids_key not in ids.columns:
        raise KeyError(f"{ids_key!r} not in id table")
    right = ids.select(qcol(ids_key).alias("_id")).distinct()
    return df.join(right, qcol(key) == F.col("_id"), "left_semi")


def affected(df: DataFrame, predicate: Column | str) -> DataFrame:
    """Rows the predicate keeps next to all rows, one aggregate."""
    if isinstance(predicate, str):
        predicate = F.expr(rewrite_expr(predicate))
    return df.agg(F.count_if(F.coalesce(predicate, F.lit(False))).alias("n_kept"),
                  F.count(F.lit(1)).alias("n_rows"))


def filter_by_function(df: DataFrame, fn: Callable, cols: Iterable[str] | None = None) -> DataFrame:
    """Filter by a user function.

    ``fn`` is either ``DataFrame -> Column`` (built-in expressions, stays in
    codegen) or, with ``cols``, a column function such as a boolean
    ``pandas_udf`` applied to those columns (Arrow batches).
    """
    if cols is None:
        return df.filter(fn(df))
    return df.filter(fn(*[qcol(c) for c in cols]))
