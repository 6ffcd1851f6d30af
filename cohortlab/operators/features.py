"""Feature derivation (F1-F5) and label handling (L1-L2)."""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortlab.functions.columns import FACTOR_CAP, ROW_ID, data_columns, qcol, unused
from cohortlab.operators.profile import value_counts


def _ids(df: DataFrame) -> list[Column]:
    return [F.col(ROW_ID)] if ROW_ID in df.columns else []


# ---------------------------------------------------------------- F1

def factor_levels(df: DataFrame, features: list[str], cap: int = FACTOR_CAP,
                  vc: DataFrame | None = None) -> dict[str, list[str]]:
    """Sorted levels of each feature, all features in one job.

    Only ``columns x cap`` values reach the driver; a feature over the cap
    is rejected (thousands of derived columns break code generation).
    """
    vc = (vc if vc is not None else value_counts(df, features)).filter(F.col("col_name").isin(features))
    # count first, so that no group is collected before its size is known
    counts = {r["col_name"]: r["k"] for r in
              vc.groupBy("col_name").agg(F.count(F.lit(1)).alias("k")).collect()}
    over = {c: k for c, k in counts.items() if k > cap}
    if over:
        raise ValueError(f"features over the factor cap {cap}: {over}")
    rows = vc.groupBy("col_name").agg(F.array_sort(F.collect_list("val")).alias("levels")).collect()
    levels = {r["col_name"]: list(r["levels"]) for r in rows}
    return {f: levels.get(f, []) for f in features}


def explode_factors(df: DataFrame, features: Iterable[str], prefix: str = "drv_f_",
                    cap: int = FACTOR_CAP, levels: dict[str, list[str]] | None = None,
                    keep: Iterable[str] = ()) -> DataFrame:
    """one 0/1 column ``{prefix}{feature}_{value}`` per level; only the
    derived columns (plus ``_row_id`` and any ``keep`` columns) are
    returned; null -> all 0.  Built as one projection, never a
    ``withColumn`` loop.  A name that differs from an earlier one only in
    case (levels ``A`` and ``a``) is numbered ``_2``, ``_3`` ... in level order."""
    features = data_columns(df, features)
    levels = levels or factor_levels(df, features, cap)
    out = _ids(df) + [qcol(k) for k in keep]
    taken = {ROW_ID, *(k.lower() for k in keep)}
    for f in features:
        txt = qcol(f).cast("string")
        for v in levels[f]:
            out.append(F.when(txt == F.lit(v), F.lit(1)).otherwise(F.lit(0)).alias(unused(f"{prefix}{f}_{v}", taken)))
    return df.select(*out)


# ---------------------------------------------------------------- F2-F4

def spark_pattern(fmt: str) -> str:
    """strftime-style format to a Spark datetime pattern."""
    if "%" not in fmt:
        return fmt
    table = {"%Y": "yyyy", "%m": "MM", "%d": "dd", "%H": "HH", "%M": "mm", "%S": "ss", "%y": "yy"}
    for k, v in table.items():
        fmt = fmt.replace(k, v)
    return fmt


def parse_dates(df: DataFrame, cols: Iterable[str], fmt: str = "%Y%m%d") -> DataFrame:
    """parse date text in place; unparsable -> null."""
    cols = set(data_columns(df, cols))
    pat = spark_pattern(fmt)
    return df.select(*[
        F.to_date(F.try_to_timestamp(qcol(c).cast("string"), F.lit(pat))).alias(c) if c in cols else qcol(c)
        for c in df.columns])


def days_from_base(df: DataFrame, cols: Iterable[str], base: str, inverse: bool = True,
                   prefix: str = "") -> DataFrame:
    """days between a date column and ``base``; ``inverse`` gives
    ``base - date``.  Returns ``_row_id`` and the derived columns."""
    cols = data_columns(df, cols)
    b = F.to_date(F.lit(base))
    out = [(F.datediff(b, qcol(c)) if inverse else F.datediff(qcol(c), b)).alias(f"{prefix}{c}") for c in cols]
    return df.select(*_ids(df), *out)


# Fixed value: the one named function of the derivation form; it yields
# True where a value is present.
NAMED_FUNCTIONS: dict[str, Callable[[Column], Column]] = {
    "isnull": lambda c: c.isNotNull(),
}


def derive_one(df: DataFrame, in_col: str, fn: str | Callable[[Column], Column], out_col: str) -> DataFrame:
    """add ``out_col = fn(in_col)``; ``fn`` is a named function or any
    ``Column -> Column``."""
    data_columns(df, [in_col])
    if isinstance(fn, str):
        if fn not in NAMED_FUNCTIONS:
            raise ValueError(f"unknown function {fn!r}; known: {sorted(NAMED_FUNCTIONS)}")
        fn = NAMED_FUNCTIONS[fn]
    return df.withColumn(out_col, fn(qcol(in_col)))


# ---------------------------------------------------------------- F5

def min_max(df: DataFrame, cols: Iterable[str] | None = None) -> DataFrame:
    """``(x - min) / (max - min)``, a zero range divides by 1.

    One aggregate for all columns (one number pair per column reaches the
    driver) and one projection with the bounds as literals."""
    cols = data_columns(df, cols)
    if not cols:
        return df
    row = df.agg(*[F.min(qcol(c)).cast("double").alias(f"mn{i}") for i, c in enumerate(cols)],
                 *[F.max(qcol(c)).cast("double").alias(f"mx{i}") for i, c in enumerate(cols)]).first()
    scaled = {}
    for i, c in enumerate(cols):
        lo, hi = row[f"mn{i}"], row[f"mx{i}"]
        if lo is None:
            scaled[c] = F.lit(None).cast("double")
            continue
        rng = hi - lo
        scaled[c] = (qcol(c).cast("double") - F.lit(lo)) / F.lit(rng if rng != 0 else 1.0)
    return df.select(*[scaled[c].alias(c) if c in scaled else qcol(c) for c in df.columns])


# ---------------------------------------------------------------- L1 / L2

def split_label(df: DataFrame, label: str) -> tuple[DataFrame, DataFrame, dict]:
    """L1: features sorted by name and the label, both with ``_row_id``;
    plus the three shapes (rows are counted once)."""
    data_columns(df, [label])
    feats = sorted(c for c in data_columns(df) if c != label)
    x = df.select(*_ids(df), *[qcol(c) for c in feats])
    y = df.select(*_ids(df), qcol(label))
    n = df.count()
    shapes = {"data": (n, len(data_columns(df))), "x": (n, len(feats)), "y": (n,)}
    return x, y, shapes


def recode_label(df: DataFrame, label: str, threshold: float = 1, out: str | None = None) -> DataFrame:
    """L2: ``label > threshold`` as 0/1."""
    return df.withColumn(out or label, (qcol(label) > F.lit(threshold)).cast("int"))


def shift_label(df: DataFrame, label: str, shift: float = 1.0, out: str | None = None) -> DataFrame:
    """L2: ``label - shift`` (1/2 -> 0.0/1.0)."""
    return df.withColumn(out or label, qcol(label).cast("double") - F.lit(float(shift)))
