"""Column-expression helpers shared by the operators.

Everything here returns ``pyspark.sql.Column`` objects built from built-in
functions, so it stays inside whole-stage codegen.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Fixed values (must equal the reference for the same results):
# the semantic types a column can carry, in the reference's order,
# the factor cardinality cap and the auto-tagger's numeric threshold.
SEMANTIC_TYPES = ["character", "numeric", "factor_s", "empty", "binary", "datetime", "factor_m"]
FACTOR_CAP = 1000
NUM2FACTOR_THRESHOLD = 2
UNCERTAIN = "uncertain data type"

ROW_ID = "_row_id"


def qcol(name: str) -> Column:
    """Column by literal name; dots and spaces stay part of the name."""
    return F.col("`" + name.replace("`", "``") + "`")


def quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def unused(name: str, taken: set[str]) -> str:
    """``name``, or the first of ``name_2``, ``name_3`` ... that ``taken`` (lower-case names) does not hold; it is added there."""
    out, n = name, 2
    while out.lower() in taken:
        out, n = f"{name}_{n}", n + 1
    taken.add(out.lower())
    return out


def storage_kind(dt: T.DataType) -> str:
    """Coarse storage class used by the semantic type rules."""
    if isinstance(dt, T.BooleanType):
        return "boolean"
    if isinstance(dt, T.NumericType):
        return "numeric"
    if isinstance(dt, (T.DateType, T.TimestampType, T.TimestampNTZType)):
        return "datetime"
    if isinstance(dt, T.StringType):
        return "string"
    if isinstance(dt, T.ArrayType):
        return "array"
    return "other"


def data_columns(df: DataFrame, cols: Iterable[str] | None = None) -> list[str]:
    """Columns to describe: the given ones, or all but the row identity."""
    if cols is None:
        return [c for c in df.columns if c != ROW_ID]
    cols = list(cols)
    missing = [c for c in cols if c not in df.columns]
    if missing:
        raise KeyError(f"columns not in dataset: {missing}")
    return cols


def kinds(df: DataFrame, cols: Iterable[str]) -> dict[str, str]:
    types = {f.name: f.dataType for f in df.schema.fields}
    return {c: storage_kind(types[c]) for c in cols}


def as_text(c: Column, kind: str) -> Column:
    """Text form of a value, used for distinct counting and categories."""
    if kind == "array":
        return F.array_join(F.array_sort(c.cast("array<string>")), "|")
    return c.cast("string")


NULL_TEXT = "\\N"


def tagged_text(c: Column) -> Column:
    """Text of a value; a null is ``\\N`` and a text that begins with a backslash gets another, so no value equals a null."""
    t = c.cast("string")
    return F.coalesce(F.when(t.startswith("\\"), F.concat(F.lit("\\"), t)).otherwise(t), F.lit(NULL_TEXT))


def unpivot_text(df: DataFrame, cols: list[str], keep_nulls: bool = False,
                 extra: Iterable[str] = ()) -> DataFrame:
    """Long form ``(col_name, val)`` with every value as text.

    One generator over the scan (no shuffle); the caller aggregates right
    after, so Spark combines map-side before any exchange.
    """
    kind = kinds(df, cols)
    pairs = F.array(*[
        F.struct(F.lit(c).alias("col_name"), as_text(qcol(c), kind[c]).alias("val"))
        for c in cols
    ])
    out = df.select(*[qcol(e) for e in extra], F.inline(pairs))
    return out if keep_nulls else out.filter(F.col("val").isNotNull())


def unpivot_double(df: DataFrame, cols: list[str], extra: Iterable[str] = ()) -> DataFrame:
    """Long form ``(col_name, v double)`` of numeric columns, nulls dropped."""
    pairs = F.array(*[
        F.struct(F.lit(c).alias("col_name"), qcol(c).cast("double").alias("v")) for c in cols
    ])
    return df.select(*[qcol(e) for e in extra], F.inline(pairs)).filter(F.col("v").isNotNull())


def dec(c: Column, scale: int = 6) -> Column:
    """Round a floating result and fix it as decimal, so that engines that
    differ in the last floating bit still give the same value."""
    return F.round(c, scale).cast(T.DecimalType(38, scale))


def safe_div(num: Column, den: Column) -> Column:
    """Division that is null on a zero or null denominator."""
    return F.when(den != 0, num.cast("double") / den.cast("double"))


def stack_one_row(row_df: DataFrame, cols: list[str], fields: dict[str, str]) -> DataFrame:
    """Turn a one-row aggregate with columns ``{field}__{col}`` into one row
    per ``col`` with the given fields.  No shuffle: it explodes one row."""
    structs = []
    for i, c in enumerate(cols):
        members = [F.lit(c).alias("col_name"), F.lit(i).alias("col_pos")]
        for f, typ in fields.items():
            members.append(F.col(f"`{f}__{i}`").cast(typ).alias(f))
        structs.append(F.struct(*members))
    return row_df.select(F.inline(F.array(*structs)))
