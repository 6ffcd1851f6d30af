"""Risk model and its evaluation."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cohortlab.functions.columns import qcol, safe_div
from cohortlab.functions.running import running_sum
from cohortlab.functions.sizing import small_side

# ---------------------------------------------------------------- R1

def _materialise(df: DataFrame) -> DataFrame:
    """Small intermediate used by several branches: compute it once and cut
    its lineage with a reliable checkpoint (shared checkpoint folder)."""
    from cohortlab.session import ensure_checkpoint_dir
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)



def split_hash(id_col: str, seed: int):
    return F.md5(F.concat(F.lit(f"{seed}:"), qcol(id_col).cast("string")))


def stratified_split(df: DataFrame, label: str, id_col: str, ratio: float = 0.2, seed: int = 0,
                     bucket_hex: int = 4, split_col: str = "split") -> DataFrame:
    """Per label, the ``round(n * ratio)`` rows with the smallest
    ``md5(seed:id)`` are ``test``, the rest ``train``; repeatable for a seed.

    No task holds a whole class: rows are counted per (label, hash bucket)
    (``16**bucket_hex`` buckets), the boundary bucket of each label is found
    on that small table, rows in buckets below or above it are decided by a
    comparison, and only rows in the boundary bucket are ranked.
    """
    h = split_hash(id_col, seed)
    base = df.select("*", h.alias("_h"))
    base = base.withColumn("_b", F.conv(F.substring("_h", 1, bucket_hex), 16, 10).cast("long"))
    counts = base.groupBy(qcol(label).alias("_y"), "_b").agg(F.count(F.lit(1)).alias("_c"))
    w = Window.partitionBy("_y").orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    wall = Window.partitionBy("_y")
    per = counts.select("_y", "_b", "_c",
                        F.coalesce(F.sum("_c").over(w), F.lit(0)).alias("_before"),
                        F.round(F.sum("_c").over(wall) * F.lit(float(ratio)), 0).cast("long").alias("_k"))
    # boundary bucket: the one holding rank k (before < k <= before + c)
    bounds = (per.filter((F.col("_before") < F.col("_k")) & (F.col("_k") <= F.col("_before") + F.col("_c")))
              .select("_y", F.col("_b").alias("_bb"), F.col("_before").alias("_bbefore"), "_k"))
    ks = per.select("_y", "_k").distinct()
    # one row per label: materialised once and broadcast after a size
    # check, so both branches below reuse it and no class meets in one task
    b = small_side(ks.join(bounds.drop("_k"), "_y", "left"))
    tagged = base.join(b, qcol(label).eqNullSafe(F.col("_y")), "left")
    out_cols = [qcol(c) for c in df.columns]
    plain = tagged.filter(F.col("_bb").isNull() | (F.col("_b") != F.col("_bb"))).select(
        *out_cols, F.when(F.col("_bb").isNotNull() & (F.col("_b") < F.col("_bb")), F.lit("test"))
        .otherwise(F.lit("train")).alias(split_col))
    wb = Window.partitionBy("_y").orderBy("_h", qcol(id_col))
    edge = (tagged.filter(F.col("_b") == F.col("_bb"))
            .withColumn("_r", F.row_number().over(wb))
            .select(*out_cols, F.when(F.col("_bbefore") + F.col("_r") <= F.col("_k"), F.lit("test"))
                    .otherwise(F.lit("train")).alias(split_col)))
    return plain.unionByName(edge)


# ---------------------------------------------------------------- R2-R5

def _assemble(df: DataFrame, features: list[str], out: str = "features"):
    from cohortlab.operators.cluster import assemble, require_complete
    require_complete(df, features)
    return assemble(df, features, out)


def fit_logistic(train: DataFrame, features: list[str], label: str, reg: float | None = None):
    """R2: L2-penalised logistic regression with the penalty of the usual
    ``C = 1`` setting (``regParam = 1 / n_train``), unstandardised."""
    from pyspark.ml.classification import LogisticRegression
    data = _assemble(train, features).select("features", qcol(label).cast("double").alias("label"))
    data = data.persist()
    n = data.count()
    model = LogisticRegression(featuresCol="features", labelCol="label", elasticNetParam=0.0,
                               regParam=(1.0 / max(n, 1)) if reg is None else reg,
                               standardization=False, maxIter=100).fit(data)
    data.unpersist()
    return model


def fit_forest(train: DataFrame, features: list[str], label: str, n_trees: int = 10, seed: int = 0,
               max_bins: int = 1024):
    """Random forest option of the risk form (10 trees, the default of
    the library generation the reference was written against).  A feature has
    at most ``max_bins`` - 1 split candidates, see ``cluster.mine_rules``."""
    from pyspark.ml.classification import RandomForestClassifier
    data = _assemble(train, features).select("features", qcol(label).cast("double").alias("label"))
    return RandomForestClassifier(featuresCol="features", labelCol="label", numTrees=n_trees, maxBins=int(max_bins),
                                  seed=seed).fit(data)


def coefficients(model, features: list[str]) -> DataFrame:
    """Feature -> weight (coefficients, or importances for a forest),
    by |weight| descending.  One number per feature."""
    from pyspark.sql import SparkSession
    spark = SparkSession.getActiveSession()
    if hasattr(model, "coefficients"):
        w = model.coefficients.toArray().tolist()
    else:
        w = model.featureImportances.toArray().tolist()
    rows = [(f, float(x)) for f, x in zip(features, w)]
    df = spark.createDataFrame(rows, "feature_name string, weight double")
    return df.orderBy(F.abs("weight").desc(), "feature_name")


def score(model, df: DataFrame, features: list[str], out: str = "p") -> DataFrame:
    """Probability of the positive class, one ``transform`` for all rows."""
    from pyspark.ml.functions import vector_to_array
    scored = model.transform(_assemble(df, features, "features"))
    return scored.withColumn(out, vector_to_array("probability")[1]).drop(
        "features", "rawPrediction", "probability", "prediction")


# ---------------------------------------------------------------- R6-R8

def threshold_metrics(scored: DataFrame, label: str, prob: str, split_col: str = "split",
                      threshold: float = 0.5) -> DataFrame:
    """Confusion counts and rates per split; positive if ``p >= t``;
    zero denominators give null."""
    y = qcol(label) > 0
    pos = qcol(prob) >= F.lit(float(threshold))
    g = scored.groupBy(qcol(split_col).alias(split_col)).agg(
        F.count_if(y & pos).alias("tp"), F.count_if(~y & pos).alias("fp"),
        F.count_if(~y & ~pos).alias("tn"), F.count_if(y & ~pos).alias("fn"))
    tp, fp, tn, fn = (F.col(c) for c in ("tp", "fp", "tn", "fn"))
    precision = safe_div(tp, tp + fp)
    recall = safe_div(tp, tp + fn)
    return g.select(split_col, "tp", "fp", "tn", "fn",
                    safe_div(tp + tn, tp + fp + tn + fn).alias("accuracy"),
                    precision.alias("precision"), recall.alias("recall"),
                    safe_div(tn, tn + fp).alias("specificity"),
                    F.when(precision + recall > 0, 2 * precision * recall / (precision + recall)).alias("f1"))


def _score_counts(scored: DataFrame, label: str, prob: str, split_col: str) -> DataFrame:
    y = qcol(label) > 0
    return (scored.filter(qcol(prob).isNotNull())
            .groupBy(qcol(split_col).alias("split"), qcol(prob).cast("double").alias("threshold"))
            .agg(F.count_if(y).alias("pos"), F.count_if(~y).alias("neg")))


def roc_points(scored: DataFrame, label: str, prob: str, split_col: str = "split") -> DataFrame:
    """Every ROC point per split (descending score), plus (0, 0).

    Scores are grouped first (ties share a point); the running totals are
    distributed (range partitions + offsets), never one task per split."""
    # distinct scores per split: materialised once, read by the running
    # totals (twice) and the class totals
    counts = _materialise(_score_counts(scored, label, prob, split_col))
    cum = running_sum(counts, ["split"], "threshold", ["pos", "neg"], descending=True)
    totals = small_side(counts.groupBy("split").agg(F.sum("pos").alias("P"), F.sum("neg").alias("N")))
    pts = cum.join(totals, "split").select(
        "split", "threshold", "pos", "neg", "cum_pos", "cum_neg",
        safe_div(F.col("cum_neg"), F.col("N")).alias("fpr"), safe_div(F.col("cum_pos"), F.col("P")).alias("tpr"))
    origin = totals.select("split", F.lit(None).cast("double").alias("threshold"), F.lit(0).cast("bigint").alias("pos"),
                           F.lit(0).cast("bigint").alias("neg"), F.lit(0).cast("bigint").alias("cum_pos"),
                           F.lit(0).cast("bigint").alias("cum_neg"),
                           F.when(F.col("N") > 0, F.lit(0.0)).alias("fpr"),
                           F.when(F.col("P") > 0, F.lit(0.0)).alias("tpr"))
    return pts.unionByName(origin)


def auc(roc: DataFrame) -> DataFrame:
    """Trapezoid area under each split's ROC points (tie-exact):
    ``sum neg * (cum_pos_prev + cum_pos) / 2 / (P * N)``."""
    g = roc.groupBy("split").agg(
        F.sum(F.col("neg").cast("double") * (2 * F.col("cum_pos") - F.col("pos")).cast("double") / 2.0).alias("_a"),
        F.sum("pos").alias("P"), F.sum("neg").alias("N"))
    return g.select("split", safe_div(F.col("_a"), F.col("P") * F.col("N")).alias("auc"))

