"""Feature selection (L3-L5): information gain, top-k / percentile /
threshold selection, importance ranking."""

from __future__ import annotations

import math
from collections.abc import Iterable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cohortlab.functions.columns import NULL_TEXT, ROW_ID, data_columns, kinds, qcol, tagged_text
from cohortlab.functions.running import exact_quantiles
from cohortlab.functions.sizing import small_side
from cohortlab.session import ensure_checkpoint_dir
from cohortlab.operators.profile import value_counts

MISSING = NULL_TEXT       # null is a value of its own
DECILES = [i / 10 for i in range(1, 10)]


def _numeric_to_bin(df: DataFrame, feats: list[str], max_levels: int) -> tuple[list[str], dict[str, int]]:
    """Numeric features with more than ``max_levels`` distinct values, and
    the non-null count of each numeric feature.

    One pass gives a HyperLogLog estimate and the count per column; clear
    cases are settled by the estimate, only columns near the limit get an
    exact count (they have few values, so that shuffle is small).
    """
    num = [c for c in feats if kinds(df, [c])[c] == "numeric"]
    if not num:
        return [], {}
    row = df.agg(*[F.approx_count_distinct(qcol(c), 0.05).alias(f"e{i}") for i, c in enumerate(num)],
                 *[F.count(qcol(c)).alias(f"n{i}") for i, c in enumerate(num)]).first()
    counts = {c: row[f"n{i}"] for i, c in enumerate(num)}
    clear = {c for i, c in enumerate(num) if row[f"e{i}"] >= 3 * max_levels}
    unsure = [c for i, c in enumerate(num) if max_levels // 3 <= row[f"e{i}"] < 3 * max_levels]
    if unsure:
        exact = {r["col_name"]: r["k"] for r in
                 value_counts(df, unsure).groupBy("col_name").agg(F.count(F.lit(1)).alias("k")).collect()}
        clear |= {c for c in unsure if exact.get(c, 0) > max_levels}
    return [c for c in num if c in clear], counts


def discretize(df: DataFrame, feats: list[str], max_levels: int = 10) -> tuple[list, dict]:
    """Numeric features with many values become decile bins ``b0..b9``
    (exact discrete deciles); others keep their value as text; null is
    ``\\N``.  Returns the projection and the cut points used."""
    to_bin, counts = _numeric_to_bin(df, feats, max_levels)
    cuts: dict[str, list[float]] = {}
    if to_bin:
        q = exact_quantiles(df, to_bin, DECILES, counts, "lower").collect()
        for r in q:
            cuts.setdefault(r["col_name"], [None] * len(DECILES))[r["q_idx"]] = r["value"]
    out = []
    for c in feats:
        if c in cuts:
            v = qcol(c).cast("double")
            b = sum(((v > F.lit(x)).cast("int") for x in cuts[c] if x is not None), F.lit(0))
            out.append(F.when(v.isNull(), F.lit(MISSING)).otherwise(F.concat(F.lit("b"), b.cast("string"))).alias(c))
        else:
            out.append(tagged_text(qcol(c)).alias(c))
    return out, cuts


def information_gain(df: DataFrame, label: str, features: Iterable[str] | None = None,
                     max_levels: int = 10) -> DataFrame:
    """L3: mutual information (nats) between each feature and the label:
    ``(feature_name, feature_scores)``.

    One unpivot and one ``groupBy(feature, value, label)``; the marginals
    come from a window over (feature, value) - at most one row per label per
    window - and a feature x label table that is broadcast.
    """
    feats = [c for c in data_columns(df, features) if c != label]
    if not feats:
        return df.sparkSession.createDataFrame([], "feature_name string, feature_scores double")
    df = df.filter(qcol(label).isNotNull())
    cols, _ = discretize(df, feats, max_levels)
    text = df.select(qcol(label).cast("string").alias("_y"), *cols)
    pairs = F.array(*[F.struct(F.lit(c).alias("feature_name"), F.col(f"`{c}`").alias("val")) for c in feats])
    joint = (text.select("_y", F.inline(pairs))
             .groupBy("feature_name", "val", "_y").agg(F.count(F.lit(1)).cast("double").alias("n_vy")))
    # the joint counts feed the marginals and the terms: computed once
    ensure_checkpoint_dir(df.sparkSession)
    joint = joint.checkpoint(eager=True)
    by_y = small_side(joint.groupBy("feature_name", "_y").agg(F.sum("n_vy").alias("n_y")))  # features x labels
    tot = by_y.groupBy("feature_name").agg(F.sum("n_y").alias("n"))                          # one row per feature
    w = Window.partitionBy("feature_name", "val")
    terms = (joint.withColumn("n_v", F.sum("n_vy").over(w))
             .join(by_y, ["feature_name", "_y"])
             .join(F.broadcast(tot), "feature_name")
             .select("feature_name",
                     (F.col("n_vy") / F.col("n") *
                      F.log(F.col("n_vy") * F.col("n") / (F.col("n_v") * F.col("n_y")))).alias("t")))
    return terms.groupBy("feature_name").agg(F.sum("t").alias("feature_scores"))


def select_top(scores: DataFrame, k: int | None = None, percentile: float | None = None,
               threshold: float | None = None, score_col: str = "feature_scores",
               name_col: str = "feature_name") -> DataFrame:
    """L4: keep the best ``k``, the best ``percentile`` percent
    (``ceil(p * m / 100)``), or those scoring at least ``threshold``.
    Exactly one of the three is used; the default is ``k = 20``."""
    given = [x is not None for x in (k, percentile, threshold)]
    if sum(given) > 1:
        raise ValueError("give one of k, percentile, threshold")
    if threshold is not None:
        return scores.filter(F.col(score_col) >= float(threshold))
    if percentile is not None:
        m = scores.count()
        k = int(math.ceil(float(percentile) * m / 100.0))
    k = 20 if k is None else int(k)
    return scores.orderBy(F.col(score_col).desc(), F.col(name_col)).limit(k)


def select_features(df: DataFrame, chosen: DataFrame, name_col: str = "feature_name") -> DataFrame:
    """Apply L4: keep the chosen features (one name per row reaches the driver)."""
    names = {r[name_col] for r in chosen.select(name_col).collect()}
    keep = [c for c in data_columns(df) if c in names]
    return df.select(*([qcol(ROW_ID)] if ROW_ID in df.columns else []), *[qcol(c) for c in keep])


def rank_importance(scores: DataFrame, score_col: str = "feature_scores",
                    name_col: str = "feature_name") -> DataFrame:
    """Order by |score| (desc, then name), with the sign class
    (``pos`` for > 0, ``neg`` otherwise) and the rank.  The table has one
    row per feature, so the global ordering window is small."""
    w = Window.orderBy(F.abs(F.col(score_col)).desc(), F.col(name_col))
    return scores.select(name_col, score_col,
                         F.abs(F.col(score_col)).alias("abs_score"),
                         F.when(F.col(score_col) > 0, F.lit("pos")).otherwise(F.lit("neg")).alias("sign"),
                         F.row_number().over(w).alias("rank"))
