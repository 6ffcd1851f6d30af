"""Column profiling (P1-P12): semantic types, distinct ratio, missing share,
value range and distribution tables.

The profile never runs a job per column.  Two scans serve every column:

* a one-row aggregate (``count``, ``count(c)``, ``min``, ``max``) that needs
  no real shuffle, only a one-row final merge;
* the long ``(col_name, val, cnt)`` table: every value cast to text, nulls
  dropped, then ``groupBy(col_name, val)``.  Spark combines map-side, so a
  hot value costs one row per input partition, not one row per occurrence.

Distinct counts, categories, value counts, balance and one-hot category lists
all read that same long table.  ``approx=True`` swaps the exact distinct
count for a HyperLogLog sketch and builds the long table only for columns
under the factor cap, which bounds the shuffle by ``columns x cap`` rows.
"""

from __future__ import annotations

from collections.abc import Iterable, Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cohortlab.session import ensure_checkpoint_dir
from cohortlab.functions.columns import (
    FACTOR_CAP, NUM2FACTOR_THRESHOLD, SEMANTIC_TYPES, UNCERTAIN,
    as_text, data_columns, kinds, qcol, unpivot_double,
)

PROFILE_SCHEMA = ("col_name string, col_pos int, col_datatype string, n_rows bigint, n_non_null bigint, "
                  "col_factornum bigint, distinct_ratio double, missing_pct double, min_value double, "
                  "max_value double, categories array<string>, value_range string")
PROFILE_FIELDS = [
    "col_name", "col_pos", "col_datatype", "n_rows", "n_non_null", "col_factornum",
    "distinct_ratio", "missing_pct", "min_value", "max_value", "categories", "value_range",
]


# ---------------------------------------------------------------- base tables

def column_stats(df: DataFrame, cols: Iterable[str] | None = None,
                 approx_distinct: bool = False, rsd: float = 0.05) -> DataFrame:
    """One row per column: ``col_name, col_pos, storage, n_rows, n_non_null,
    min_value, max_value (double, numeric only), min_text, max_text`` and,
    with ``approx_distinct``, an HLL estimate ``approx_distinct``.

    Computed by a single aggregate over the scan.
    """
    cols = data_columns(df, cols)
    if not cols:
        return df.sparkSession.createDataFrame(
            [], "col_name string, col_pos int, storage string, n_rows bigint, n_non_null bigint, "
                "min_value double, max_value double, min_text string, max_text string, approx_distinct bigint")
    kind = kinds(df, cols)
    aggs = [F.count(F.lit(1)).alias("n_rows")]
    for i, c in enumerate(cols):
        aggs.append(F.count(qcol(c)).alias(f"nn__{i}"))
        if kind[c] in ("numeric", "string", "datetime", "boolean"):
            aggs.append(F.min(qcol(c)).alias(f"mn__{i}"))
            aggs.append(F.max(qcol(c)).alias(f"mx__{i}"))
        if approx_distinct:
            aggs.append(F.approx_count_distinct(qcol(c), rsd).alias(f"ad__{i}"))
    row = df.agg(*aggs)
    structs = []
    for i, c in enumerate(cols):
        has_range = kind[c] in ("numeric", "string", "datetime", "boolean")
        mn = F.col(f"mn__{i}") if has_range else F.lit(None)
        mx = F.col(f"mx__{i}") if has_range else F.lit(None)
        num = kind[c] == "numeric"
        structs.append(F.struct(
            F.lit(c).alias("col_name"),
            F.lit(i).alias("col_pos"),
            F.lit(kind[c]).alias("storage"),
            F.col("n_rows").alias("n_rows"),
            F.col(f"nn__{i}").alias("n_non_null"),
            (mn.cast("double") if num else F.lit(None).cast("double")).alias("min_value"),
            (mx.cast("double") if num else F.lit(None).cast("double")).alias("max_value"),
            mn.cast("string").alias("min_text"),
            mx.cast("string").alias("max_text"),
            (F.col(f"ad__{i}") if approx_distinct else F.lit(None).cast("bigint")).alias("approx_distinct"),
        ))
    return row.select(F.inline(F.array(*structs)))


LONG_TEXT = 64               # texts of more bytes are counted by digest


def _native(df: DataFrame, cols: list[str]):
    """Per column its value as (whole number, double, short text, digest of a long text, the long text itself)."""
    kind = kinds(df, cols)
    types = {f.name: f.dataType for f in df.schema.fields}
    integral = (T.ByteType, T.ShortType, T.IntegerType, T.LongType)
    for c in cols:
        dt = types[c]
        text = None if isinstance(dt, integral + (T.DoubleType,)) else as_text(qcol(c), kind[c])
        may_be_long = text is not None and kind[c] in ("string", "array", "other")
        is_long = F.octet_length(text) > LONG_TEXT if may_be_long else None
        none = F.lit(None)
        yield (c, qcol(c).cast("long") if isinstance(dt, integral) else none.cast("long"),
               qcol(c) if isinstance(dt, T.DoubleType) else none.cast("double"),
               none.cast("string") if text is None else F.when(~is_long, text) if may_be_long else text,
               F.when(is_long, F.unhex(F.md5(text.cast("binary")))) if may_be_long else none.cast("binary"),
               F.when(is_long, text) if may_be_long else none.cast("string"))


def value_counts(df: DataFrame, cols: Iterable[str] | None = None, texts: bool = True) -> DataFrame:
    """P2/P9 base table ``(col_name, val, cnt)``: non-null value counts of
    every column.  One shuffle, combined map-side.

    Integer and double columns are grouped in their native form and turned
    into text only after aggregation; a text of more than ``LONG_TEXT`` bytes is grouped by its 128-bit
    digest.  With ``texts`` the long text rides along, once a value and partition; without, ``val`` is null there,
    which is enough to count values."""
    cols = data_columns(df, cols)
    if not cols:
        return df.sparkSession.createDataFrame([], "col_name string, val string, cnt bigint")
    structs = []
    for c, whole, number, text, digest, long_text in _native(df, cols):
        rest = [long_text.alias("_t")] if texts else []
        structs.append(F.struct(F.lit(c).alias("col_name"), whole.alias("_l"), number.alias("_d"), text.alias("_s"), digest.alias("_g"), *rest))
    long = (df.select(F.inline(F.array(*structs)))
            .filter(F.col("_l").isNotNull() | F.col("_d").isNotNull() | F.col("_s").isNotNull() | F.col("_g").isNotNull()))
    val = [F.col("_s"), F.col("_l").cast("string"), F.col("_d").cast("string")]
    if not texts:
        counted = long.groupBy("col_name", "_l", "_d", "_s", "_g").agg(F.count(F.lit(1)).alias("cnt"))
        return counted.select("col_name", F.coalesce(*val).alias("val"), "cnt")
    may_be_long = any(kinds(df, [c])[c] in ("string", "array", "other") for c in cols)
    if not may_be_long:
        counted = long.groupBy("col_name", "_l", "_d", "_s").agg(F.count(F.lit(1)).alias("cnt"))
        return counted.select("col_name", F.coalesce(*val).alias("val"), "cnt")
    # short values keep the hash aggregate; only long ones are sorted by digest
    short = (long.where("_g is null").groupBy("col_name", "_l", "_d", "_s").agg(F.count(F.lit(1)).alias("cnt"))
             .select("col_name", F.coalesce(*val).alias("val"), "cnt"))
    wide = (long.where("_g is not null").groupBy("col_name", "_g").agg(F.any_value("_t").alias("val"), F.count(F.lit(1)).alias("cnt"))
            .select("col_name", "val", "cnt"))
    return short.unionByName(wide)


def distinct_counts(vc: DataFrame) -> DataFrame:
    """``(col_name, col_factornum)`` from the value-count table."""
    return vc.groupBy("col_name").agg(F.count(F.lit(1)).alias("col_factornum"))


def category_lists(vc: DataFrame, dist: DataFrame, cap: int = FACTOR_CAP,
                   force: Iterable[str] = ()) -> DataFrame:
    """Sorted categories of the columns with at most ``cap`` values and of
    those in ``force``, whatever their number of values.

    ``dist`` has one row per column, so the broadcast is bounded by the
    column count.  A collected group is bounded by ``cap`` unless forced.
    """
    force = list(force)
    keep = dist.filter((F.col("col_factornum") <= cap) | F.col("col_name").isin(force)) \
        .select("col_name")
    return (vc.join(F.broadcast(keep), "col_name")
            .groupBy("col_name")
            .agg(F.array_sort(F.collect_list("val")).alias("categories")))


# ---------------------------------------------------------------- P1 rules

def semantic_type(storage, n_non_null, factornum, cap: int = FACTOR_CAP,
                  num2factor: int = NUM2FACTOR_THRESHOLD):
    """Automatic semantic type from storage class and counts."""
    return (F.when(n_non_null == 0, F.lit("empty"))
            .when(storage == "numeric",
                  F.when(factornum > num2factor, F.lit("numeric")).otherwise(F.lit("factor_s")))
            .when(storage == "string",
                  F.when(factornum <= cap, F.lit("factor_s")).otherwise(F.lit("character")))
            .when(storage == "datetime", F.lit("datetime"))
            .when(storage == "boolean", F.lit("binary"))
            .when(storage == "array", F.lit("factor_m"))
            .otherwise(F.lit(UNCERTAIN)))


def value_range(dtype, min_text, max_text, categories):
    """P5: range text by semantic type."""
    return (F.when(dtype == "numeric", F.format_string("(%s, %s)", min_text, max_text))
            .when(dtype == "factor_s",
                  F.concat(F.lit("["), F.array_join(categories, ", "), F.lit("]")))
            .when(dtype == "character", F.lit("character"))
            .when(dtype == "empty", F.lit("empty"))
            .otherwise(F.lit(UNCERTAIN)))


def _check_types(overrides: Mapping[str, str]) -> None:
    bad = {c: t for c, t in overrides.items() if t not in SEMANTIC_TYPES}
    if bad:
        raise ValueError(f"unknown semantic type(s): {bad}; known: {SEMANTIC_TYPES}")


# ---------------------------------------------------------------- P1-P6

def profile(df: DataFrame, cols: Iterable[str] | None = None,
            overrides: Mapping[str, str] | None = None,
            stored: DataFrame | None = None,
            cap: int = FACTOR_CAP, num2factor: int = NUM2FACTOR_THRESHOLD,
            approx: bool = False, rsd: float = 0.05) -> DataFrame:
    """One profile row per column (schema ``PROFILE_FIELDS``).

    Type precedence: ``overrides`` (column -> type) > ``stored`` profile's
    ``col_datatype`` > automatic rule.  A column that is ``factor_s`` by
    override or stored type lists all its values, also beyond ``cap``.
    """
    cols = data_columns(df, cols)
    overrides = dict(overrides or {})
    _check_types(overrides)
    if not cols:
        return df.sparkSession.createDataFrame([], PROFILE_SCHEMA)
    missing = [c for c in overrides if c not in cols]
    if missing:
        raise KeyError(f"override for unknown column(s): {missing}")
    stats = column_stats(df, cols, approx_distinct=approx, rsd=rsd)
    forced = [c for c, t in overrides.items() if t == "factor_s"]
    if stored is not None:
        # one row per column
        prior_factors = {r["col_name"] for r in stored.filter(F.col("col_datatype") == "factor_s").select("col_name").collect()}
        forced += [c for c in cols if c in prior_factors and c not in overrides]

    textual = [c for c, k in kinds(df, cols).items() if k in ("string", "array", "other")]
    if approx:
        # Decide on the driver, from one row per column, which columns are
        # small enough for exact counts; the rest keep the HLL estimate.
        rows = stats.collect()
        stats = df.sparkSession.createDataFrame(rows, stats.schema)          # one row a column; not computed again
        est = {r["col_name"]: r["approx_distinct"] for r in rows}
        slack = 1.0 + 4 * rsd
        small = [c for c in cols if est[c] <= cap * slack or c in forced]
        vc = value_counts(df, small)
        exact = distinct_counts(vc)
        dist = (stats.select("col_name", "approx_distinct")
                .join(exact, "col_name", "left")
                .select("col_name", F.coalesce("col_factornum", "approx_distinct").alias("col_factornum")))
    else:
        # values are counted without their long texts; those are fetched only for columns that list them
        vc = value_counts(df, cols, texts=False)
        dist = distinct_counts(vc)
        if textual:
            ensure_checkpoint_dir(df.sparkSession)
            dist = dist.checkpoint(eager=True)                               # one row a column
            known = {r["col_name"]: r["col_factornum"] for r in dist.collect()}
            # only a factor lists its values: text under the cap, numbers under theirs, and what is forced
            vc = value_counts(df, [c for c in cols if c in forced or known.get(c, 0) <= (cap if c in textual else num2factor)])
    cats = category_lists(vc, dist, cap, force=forced)

    out = (stats.join(F.broadcast(dist), "col_name", "left")
           .join(cats if forced else F.broadcast(cats), "col_name", "left")
           .withColumn("col_factornum", F.coalesce("col_factornum", F.lit(0).cast("bigint"))))
    auto = semantic_type(F.col("storage"), F.col("n_non_null"), F.col("col_factornum"), cap, num2factor)
    dtype = auto
    if stored is not None:
        prior = stored.select("col_name", F.col("col_datatype").alias("_stored_type"))
        out = out.join(F.broadcast(prior), "col_name", "left")
        dtype = F.coalesce(F.col("_stored_type"), dtype)
    if overrides:
        m = F.create_map(*[x for c, t in overrides.items() for x in (F.lit(c), F.lit(t))])
        dtype = F.coalesce(m[F.col("col_name")], dtype)
    out = out.withColumn("col_datatype", dtype)
    return _finish(out)


def _finish(out: DataFrame) -> DataFrame:
    n = F.col("n_rows")
    return out.select(
        "col_name",
        F.col("col_pos").cast("int").alias("col_pos"),
        "col_datatype",
        F.col("n_rows").cast("bigint").alias("n_rows"),
        F.col("n_non_null").cast("bigint").alias("n_non_null"),
        F.col("col_factornum").cast("bigint").alias("col_factornum"),
        # Note the +1 in the denominator
        F.round(F.col("col_factornum").cast("double") / (n.cast("double") + F.lit(1.0)), 2).alias("distinct_ratio"),
        # Null on an empty table
        F.when(n > 0, (n - F.col("n_non_null")).cast("double") * F.lit(100.0) / n.cast("double"))
         .alias("missing_pct"),
        "min_value", "max_value",
        F.when(F.col("col_datatype") == "factor_s", F.col("categories")).alias("categories"),
        value_range(F.col("col_datatype"), F.col("min_text"), F.col("max_text"), F.col("categories"))
        .alias("value_range"),
    )


# ---------------------------------------------------------------- P7-P9

def histogram(df: DataFrame, cols: Iterable[str] | None = None, bins: int = 10,
              stats: DataFrame | None = None) -> DataFrame:
    """Equal-width histogram of numeric columns, nulls out.

    ``(col_name, bin, bin_lo, bin_hi, cnt)`` with every bin present (zero
    counts included).  A constant column gets the range ``lo-0.5 .. hi+0.5``.
    All columns in one aggregate over the unpivoted values; the range table
    is one row per column and broadcast.
    """
    cols = [c for c in data_columns(df, cols) if kinds(df, [c])[c] == "numeric"]
    if not cols:
        return df.sparkSession.createDataFrame(
            [], "col_name string, bin int, bin_lo double, bin_hi double, cnt bigint")
    if stats is None:
        stats = column_stats(df, cols)
    rng = (stats.filter(F.col("n_non_null") > 0)
           .select("col_name",
                   F.when(F.col("min_value") == F.col("max_value"), F.col("min_value") - 0.5)
                   .otherwise(F.col("min_value")).alias("lo"),
                   F.when(F.col("min_value") == F.col("max_value"), F.col("max_value") + 0.5)
                   .otherwise(F.col("max_value")).alias("hi")))
    b = F.lit(float(bins))
    counts = (unpivot_double(df, cols)
              .join(F.broadcast(rng), "col_name")
              .select("col_name",
                      F.least(F.floor((F.col("v") - F.col("lo")) * b / (F.col("hi") - F.col("lo"))),
                              F.lit(bins - 1)).cast("int").alias("bin"))
              .groupBy("col_name", "bin").agg(F.count(F.lit(1)).alias("cnt")))
    grid = rng.select("col_name", "lo", "hi", F.explode(F.sequence(F.lit(0), F.lit(bins - 1))).alias("bin"))
    width = (F.col("hi") - F.col("lo")) / b
    return (grid.join(counts, ["col_name", "bin"], "left")
            .select("col_name", "bin",
                    (F.col("lo") + F.col("bin") * width).alias("bin_lo"),
                    F.when(F.col("bin") == bins - 1, F.col("hi"))
                    .otherwise(F.col("lo") + (F.col("bin") + 1) * width).alias("bin_hi"),
                    F.coalesce("cnt", F.lit(0).cast("bigint")).alias("cnt")))


def box_summary(df: DataFrame, cols: Iterable[str] | None = None, whisker: float = 1.5,
                exact: bool = True, accuracy: int = 10_000) -> DataFrame:
    """Quartiles (linear interpolation, as a box plot draws them),
    whiskers at ``whisker * IQR`` and the outlier count, per numeric column.

    ``exact`` (default) ranks distinct values with distributed running
    totals (no group is ever held in one task); ``exact=False`` uses
    ``percentile_approx`` at the two ranks around each interpolation point,
    a bounded sketch per column that is within ``n / accuracy`` ranks.
    """
    cols = [c for c in data_columns(df, cols) if kinds(df, [c])[c] == "numeric"]
    n_by_col = {r["col_name"]: r["n_non_null"]
                for r in column_stats(df, cols).select("col_name", "n_non_null").collect()} if cols else {}
    cols = [c for c in cols if n_by_col[c] > 0]
    if not cols:
        return df.sparkSession.createDataFrame(
            [], "col_name string, n bigint, q1 double, median double, q3 double, "
                "whisker_lo double, whisker_hi double, n_outliers bigint")
    probs = [0.25, 0.5, 0.75]
    if exact:
        from cohortlab.functions.running import exact_quantiles
        qs = exact_quantiles(df, cols, probs, n_by_col, "linear")
        quart = (qs.groupBy("col_name")
                 .agg(*[F.max(F.when(F.col("q_idx") == j, F.col("value"))).alias(k)
                        for j, k in enumerate(["q1", "median", "q3"])]))
        n_map = F.create_map(*[x for c in cols for x in (F.lit(c), F.lit(n_by_col[c]))])
        quart = quart.select("col_name", n_map[F.col("col_name")].cast("bigint").alias("n"), "q1", "median", "q3")
    else:
        from cohortlab.functions.running import rank_index
        aggs, plan = [], {}
        for i, c in enumerate(cols):
            n = n_by_col[c]
            pcts, spec = [], []
            for q in probs:
                lo, hi, fr = rank_index(n, q, "linear")
                spec.append((len(pcts), len(pcts) + 1, fr))
                pcts += [(lo + 0.5) / n, (hi + 0.5) / n]
            plan[c] = spec
            aggs.append(F.percentile_approx(qcol(c).cast("double"), pcts, accuracy).alias(f"p__{i}"))
        row = df.agg(*aggs)
        structs = []
        for i, c in enumerate(cols):
            arr = F.col(f"p__{i}")
            q = [arr[a] + F.lit(fr) * (arr[b] - arr[a]) for a, b, fr in plan[c]]
            structs.append(F.struct(F.lit(c).alias("col_name"), F.lit(n_by_col[c]).cast("bigint").alias("n"),
                                    q[0].alias("q1"), q[1].alias("median"), q[2].alias("q3")))
        quart = row.select(F.inline(F.array(*structs)))
    fences = quart.select("col_name",
                          (F.col("q1") - whisker * (F.col("q3") - F.col("q1"))).alias("f_lo"),
                          (F.col("q3") + whisker * (F.col("q3") - F.col("q1"))).alias("f_hi"))
    v = F.col("v")
    tails = (unpivot_double(df, cols).join(F.broadcast(fences), "col_name")
             .groupBy("col_name")
             .agg(F.min(F.when(v >= F.col("f_lo"), v)).alias("whisker_lo"),
                  F.max(F.when(v <= F.col("f_hi"), v)).alias("whisker_hi"),
                  F.count_if((v < F.col("f_lo")) | (v > F.col("f_hi"))).alias("n_outliers")))
    return quart.join(tails, "col_name")


def factor_value_counts(vc: DataFrame, prof: DataFrame | None = None,
                        cap: int = FACTOR_CAP) -> DataFrame:
    """Value counts with share, for ``factor_s`` columns (or, without a
    profile, for columns with at most ``cap`` values).  Totals per column
    are a small broadcast table; no window holds a whole column."""
    if prof is not None:
        keep = prof.filter(F.col("col_datatype") == "factor_s").select("col_name")
    else:
        keep = distinct_counts(vc).filter(F.col("col_factornum") <= cap).select("col_name")
    sel = vc.join(F.broadcast(keep), "col_name")
    totals = sel.groupBy("col_name").agg(F.sum("cnt").alias("total"))
    return (sel.join(F.broadcast(totals), "col_name")
            .select("col_name", "val", "cnt",
                    (F.col("cnt").cast("double") / F.col("total").cast("double")).alias("share")))


def factor_values(df: DataFrame, prof: DataFrame) -> DataFrame:
    """P5 as rows: ``(col_name, val)`` of every ``factor_s`` column of the profile, however many values it has.  Unlike
    the profile's ``categories`` no column is gathered into one row."""
    cols = [r["col_name"] for r in prof.filter(F.col("col_datatype") == "factor_s").select("col_name").collect()]
    return value_counts(df, [c for c in data_columns(df) if c in cols]).select("col_name", "val")


# ---------------------------------------------------------------- P10-P12

def retag(df: DataFrame, prof: DataFrame, overrides: Mapping[str, str],
          cap: int = FACTOR_CAP) -> DataFrame:
    """P10: set types for some columns and recompute range and categories
    for those columns only; other profile rows are kept as they are."""
    _check_types(overrides)
    cols = list(overrides)
    sub = profile(df, cols, overrides=overrides, cap=cap)
    # keep the original column positions
    pos = prof.select("col_name", F.col("col_pos").alias("_pos"))
    sub = sub.join(F.broadcast(pos), "col_name", "left") \
        .withColumn("col_pos", F.coalesce("_pos", "col_pos")).drop("_pos")
    return prof.filter(~F.col("col_name").isin(cols)).unionByName(sub.select(*prof.columns))


def tag(prof: DataFrame, cols: Iterable[str], dtype: str) -> DataFrame:
    """Set ``col_datatype`` of ``cols`` to ``dtype`` (no recompute)."""
    _check_types({"_": dtype})
    cols = list(cols)
    return prof.withColumn("col_datatype",
                           F.when(F.col("col_name").isin(cols), F.lit(dtype)).otherwise(F.col("col_datatype")))


def query_profiles(profiles: Mapping[str, DataFrame] | DataFrame, dtype: str | None = None,
                   fields: Iterable[str] | None = None) -> DataFrame:
    """Profiles of many datasets as one table with a ``dataset``
    column, optionally only columns of one semantic type and some fields."""
    if isinstance(profiles, DataFrame):
        allp = profiles
    else:
        parts = [p.select(F.lit(name).alias("dataset"), *p.columns) for name, p in profiles.items()]
        if not parts:
            raise ValueError("no profiles given")
        allp = parts[0]
        for p in parts[1:]:
            allp = allp.unionByName(p)
    if dtype is not None:
        _check_types({"_": dtype})
        allp = allp.filter(F.col("col_datatype") == dtype)
    if fields is not None:
        fields = list(fields)
        allp = allp.select("dataset", *[f for f in fields if f != "dataset"])
    return allp


def numeric_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields
            if isinstance(f.dataType, T.NumericType) and f.name != "_row_id"]
