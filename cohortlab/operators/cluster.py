"""Clustering and cluster description (K1-K8), on MLlib and SQL aggregates.

Model fitting is MLlib (distributed); every descriptive table is a
``groupBy`` over the rows with partial aggregation, so no cluster is ever
gathered into one task.
"""

from __future__ import annotations

from collections.abc import Iterable, Sequence

import numpy as np
from pyspark import StorageLevel
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cohortlab.functions.columns import qcol
from cohortlab.operators.profile import value_counts

CLUSTER = "cluster_id"


def _vectors(df: DataFrame, features: Sequence[str] | str, out: str = "_x") -> DataFrame:
    """Feature columns (or one array column) as an ML vector column; a missing value in them is an error."""
    from pyspark.ml.functions import array_to_vector
    require_complete(df, features)
    if isinstance(features, str):
        return df.withColumn(out, array_to_vector(qcol(features).cast("array<double>")))
    return assemble(df, features, out)


def _missing(c):
    v = c.cast("double")
    return v.isNull() | F.isnan(v)


def require_complete(df: DataFrame, features: Sequence[str] | str) -> None:
    """One aggregate: raise if a feature holds a null or NaN (for an array column: is one, or holds one, or has another
    length than the rest), naming the columns.  A model would turn one such value into NaN for every row."""
    if isinstance(features, str):
        a = qcol(features).cast("array<double>")
        row = df.agg(F.count_if(a.isNull() | F.exists(a, lambda x: x.isNull() | F.isnan(x))).alias("n"),
                     F.min(F.size(a)).alias("lo"), F.max(F.size(a)).alias("hi")).first()
        if row["n"] or row["lo"] != row["hi"]:
            raise ValueError(f"{features!r} has missing values in {row['n']} rows, lengths {row['lo']} to {row['hi']}")
        return
    if not features:
        raise ValueError("no features given")
    row = df.agg(*[F.count_if(_missing(qcol(c))).alias(f"m{i}") for i, c in enumerate(features)]).first()
    bad = {c: row[f"m{i}"] for i, c in enumerate(features) if row[f"m{i}"]}
    if bad:
        raise ValueError(f"missing values in features (rows): {bad}; impute them first (fit_imputer)")


def fit_imputer(df: DataFrame, features: Sequence[str], strategy: str = "mean") -> dict[str, float]:
    """The value that stands for a missing one in each feature: its ``mean`` or exact ``median`` over the present values
    (0 without any).  One number a feature reaches the driver; the same fill serves later rows."""
    present = {c: F.when(~_missing(qcol(c)), qcol(c).cast("double")) for c in features}
    if strategy == "mean":
        row = df.agg(*[F.avg(present[c]).alias(f"v{i}") for i, c in enumerate(features)]).first()
        fill = {c: row[f"v{i}"] for i, c in enumerate(features)}
    elif strategy == "median":
        from cohortlab.functions.running import exact_quantiles
        named = df.select(*[v.alias(c) for c, v in present.items()])
        row = named.agg(*[F.count(qcol(c)).alias(f"n{i}") for i, c in enumerate(features)]).first()
        counts = {c: row[f"n{i}"] for i, c in enumerate(features)}
        fill = {r["col_name"]: r["value"] for r in exact_quantiles(named, list(features), [0.5], counts).collect()}
    else:
        raise ValueError(f"unknown strategy {strategy!r}; use mean or median")
    return {c: 0.0 if fill.get(c) is None else float(fill[c]) for c in features}


def impute(df: DataFrame, fill: dict[str, float]) -> DataFrame:
    """Replace missing values of the fitted features (which become doubles); one projection."""
    return df.select(*[F.when(_missing(qcol(c)), F.lit(fill[c])).otherwise(qcol(c).cast("double")).alias(c) if c in fill else qcol(c)
                       for c in df.columns])


def assemble(df: DataFrame, features: Sequence[str], out: str) -> DataFrame:
    """VectorAssembler over any column names: names with dots or spaces are
    aliased to plain ones first (the assembler reads dots as struct fields)."""
    from pyspark.ml.feature import VectorAssembler
    tmp = [f"_feat{i}" for i in range(len(features))]
    staged = df.select("*", *[qcol(c).cast("double").alias(t) for c, t in zip(features, tmp)])
    return VectorAssembler(inputCols=tmp, outputCol=out, handleInvalid="error").transform(staged).drop(*tmp)


# ---------------------------------------------------------------- K1-K3

def reduce_pca(df: DataFrame, features: Sequence[str] | str, k: int = 5, keep: Iterable[str] = (),
               prefix: str = "pc_") -> DataFrame:
    """K1: centre the features, then project on the first ``k`` principal
    components (MLlib's PCA does not centre by itself)."""
    from pyspark.ml import Pipeline
    from pyspark.ml.feature import PCA, StandardScaler
    from pyspark.ml.functions import vector_to_array
    x = _vectors(df, features)
    pipe = Pipeline(stages=[StandardScaler(inputCol="_x", outputCol="_xc", withMean=True, withStd=False),
                            PCA(k=k, inputCol="_xc", outputCol="_pc")])
    out = pipe.fit(x).transform(x)
    arr = vector_to_array("_pc")
    return out.select(*[qcol(c) for c in keep], *[arr[i].alias(f"{prefix}{i + 1}") for i in range(k)])


class KMeansFit:
    """Centres (k x dims) of the best run; ``summary.trainingCost`` as MLlib names it."""

    def __init__(self, centers, cost: float, costs: list[float], passes: int):
        self.centers, self.trainingCost, self.costs, self.passes = centers, cost, costs, passes

    @property
    def summary(self) -> "KMeansFit":
        return self


def _seed_centers(sample, k: int, seed: int):
    """k-means++ over the sample: each next centre drawn with probability in proportion to its squared distance."""
    rng = np.random.default_rng(seed)
    centers = [sample[rng.integers(len(sample))]]
    gap = ((sample - centers[0]) ** 2).sum(axis=1)
    for _ in range(1, k):
        total = gap.sum()
        pick = rng.choice(len(sample), p=gap / total) if total > 0 else rng.integers(len(sample))
        centers.append(sample[pick])
        gap = np.minimum(gap, ((sample - centers[-1]) ** 2).sum(axis=1))
    return np.array(centers)


def _rows_matrix(column) -> np.ndarray:
    """A batch's vectors; all have one length (checked before the fit)."""
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1)


def _gaps(x, centers):
    """Squared distances of rows to the centres of every run: (runs, rows, k)."""
    flat = centers.reshape(-1, centers.shape[-1])
    d = (x * x).sum(axis=1)[:, None] - 2.0 * (x @ flat.T) + (flat * flat).sum(axis=1)[None, :]
    return np.maximum(d, 0.0).reshape(len(x), centers.shape[0], centers.shape[1]).transpose(1, 0, 2)


def _lloyd_pass(x: DataFrame, centers, want_sums: bool):
    """One scan for all runs: per (run, cluster) the number of rows, their summed vectors and the cost at ``centers``."""
    runs, k, dims = centers.shape

    def step(batches):
        import pyarrow as pa
        n, cost, sums = np.zeros((runs, k)), np.zeros((runs, k)), np.zeros((runs, k, dims))
        for b in batches:
            if not b.num_rows:
                continue
            rows = _rows_matrix(b.column(0))
            for s in range(0, len(rows), 8192):
                part = rows[s:s + 8192]
                gaps = _gaps(part, centers)
                near = gaps.argmin(axis=2)
                least = gaps.min(axis=2)
                for r in range(runs):
                    n[r] += np.bincount(near[r], minlength=k)
                    cost[r] += np.bincount(near[r], weights=least[r], minlength=k)
                    if want_sums:
                        hot = np.zeros((k, len(part)))
                        hot[near[r], np.arange(len(part))] = 1.0
                        sums[r] += hot @ part
        at = [(r, c, -2, n[r, c]) for r in range(runs) for c in range(k)] + [(r, c, -1, cost[r, c]) for r in range(runs) for c in range(k)]
        if want_sums:
            at += [(r, c, d, sums[r, c, d]) for r in range(runs) for c in range(k) for d in range(dims)]
        cols = list(zip(*at))
        yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int32()), pa.array(cols[1], pa.int32()), pa.array(cols[2], pa.int32()),
                                          pa.array(cols[3], pa.float64())], names=["run", "cluster", "dim", "v"])

    out = x.select("_x").mapInArrow(step, "run int, cluster int, dim int, v double").groupBy("run", "cluster", "dim").agg(F.sum("v").alias("v"))
    n, cost, sums = np.zeros((runs, k)), np.zeros((runs, k)), np.zeros((runs, k, dims))
    for r in out.collect():                                # runs x clusters x (dims + 2) numbers
        target = n if r["dim"] == -2 else cost if r["dim"] == -1 else None
        if target is None:
            sums[r["run"], r["cluster"], r["dim"]] = r["v"]
        else:
            target[r["run"], r["cluster"]] = r["v"]
    return n, cost.sum(axis=1), sums


def kmeans(df: DataFrame, features: Sequence[str] | str, k: int = 2, n_init: int = 10, seed: int = 0,
           keep: Iterable[str] = (), max_iter: int = 300, tol: float = 1e-4, init_rows: int = 10_000):
    """K2: k-means, ``n_init`` runs, the one with the least within-cluster cost wins (ties: the first).  Returns
    ``(rows with cluster_id, KMeansFit)``.

    All runs advance together: a pass of Lloyd's algorithm reads the rows once and assigns each to the centres of every
    run that has not settled.  Centres start by k-means++ on ``init_rows`` rows, those of least hash; only the start
    depends on that sample.  ``tol`` is relative to the mean feature variance (the usual k-means convention).  The vectors
    are persisted (memory and disk) over the passes; blocks of a lost executor are computed again."""
    from pyspark.ml.functions import vector_to_array
    keep = list(keep)
    base = _vectors(df, features)
    x = base.select(vector_to_array("_x").alias("_x")).persist(StorageLevel.MEMORY_AND_DISK)
    try:
        first = x.select("_x", F.xxhash64("_x", F.lit(seed)).alias("_h")).orderBy("_h", "_x").limit(int(init_rows)).collect()
        if not first:
            raise ValueError("k-means needs at least one row")
        sample = np.array([r["_x"] for r in first], dtype=np.float64)
        centers = np.array([_seed_centers(sample, k, seed + i) for i in range(n_init)])
        spread = x.agg(*[F.var_pop(F.get("_x", F.lit(i))).alias(f"v{i}") for i in range(sample.shape[1])]).first()
        stop = tol * float(np.mean([v or 0.0 for v in spread]))
        open_, passes = np.arange(n_init), 0
        while len(open_) and passes < max_iter:
            n, _, sums = _lloyd_pass(x, centers[open_], True)
            passes += 1
            moved = np.where(n[:, :, None] > 0, sums / np.maximum(n, 1.0)[:, :, None], centers[open_])     # an empty cluster stays
            shift = ((moved - centers[open_]) ** 2).sum(axis=(1, 2))
            centers[open_] = moved
            open_ = open_[shift > stop]
        _, costs, _ = _lloyd_pass(x, centers, False)
    finally:
        x.unpersist()
    best = int(np.argmin(costs))
    final = centers[best:best + 1]

    def nearest(batches):
        import pyarrow as pa
        for b in batches:
            if not b.num_rows:
                continue
            rows = _rows_matrix(b.column(b.num_columns - 1))
            got = np.concatenate([_gaps(rows[s:s + 8192], final)[0].argmin(axis=1) for s in range(0, len(rows), 8192)])
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(got.astype(np.int32))], names=[*b.schema.names[:-1], CLUSTER])

    kept = base.select(*[qcol(c) for c in keep], vector_to_array("_x").alias("_x"))
    schema = T.StructType([*kept.schema.fields[:-1], T.StructField(CLUSTER, T.IntegerType())])
    return kept.mapInArrow(nearest, schema), KMeansFit(final[0], float(costs[best]), [float(c) for c in costs], passes)


def silhouette(df: DataFrame, features: Sequence[str] | str, cluster_col: str = CLUSTER) -> DataFrame:
    """K3: silhouette of the clustering on the unreduced features
    (squared Euclidean, which MLlib evaluates in one pass)."""
    from pyspark.ml.evaluation import ClusteringEvaluator
    x = _vectors(df, features).withColumn("_cid", qcol(cluster_col).cast("double"))
    value = ClusteringEvaluator(featuresCol="_x", predictionCol="_cid", metricName="silhouette",
                                distanceMeasure="squaredEuclidean").evaluate(x)
    return df.sparkSession.createDataFrame([("silhouette", float(value))], "metric string, value double")


# ---------------------------------------------------------------- K4-K6

def type_features(df: DataFrame, features: Sequence[str], max_cat: int = 10) -> DataFrame:
    """K4: ``(feature_name, n_distinct, feature_type)`` on integer-cast values:
    2 distinct -> binary, up to ``max_cat`` -> categorical, else numeric."""
    ints = df.select(*[qcol(c).cast("long").alias(c) for c in features])
    k = value_counts(ints, features).groupBy("col_name").agg(F.count(F.lit(1)).alias("n_distinct"))
    names = df.sparkSession.createDataFrame([(c,) for c in features], "col_name string")
    k = names.join(k, "col_name", "left").fillna(0, ["n_distinct"])
    return k.select(F.col("col_name").alias("feature_name"), F.col("n_distinct").cast("bigint").alias("n_distinct"),
                    F.when(F.col("n_distinct") == 2, F.lit("binary"))
                    .when(F.col("n_distinct") <= max_cat, F.lit("categorical"))
                    .otherwise(F.lit("numeric")).alias("feature_type"))


def _long_ints(df: DataFrame, features: Sequence[str], cluster_col: str) -> DataFrame:
    pairs = F.array(*[F.struct(F.lit(c).alias("feature_name"), qcol(c).cast("long").alias("v")) for c in features])
    return df.select(qcol(cluster_col).cast("int").alias(CLUSTER), F.inline(pairs)).filter(F.col("v").isNotNull())


def cluster_summary(df: DataFrame, features: Sequence[str], types: DataFrame,
                    cluster_col: str = CLUSTER) -> DataFrame:
    """K4 per-cluster description: mean of the integer-cast values for
    binary/numeric features, mode (smallest on ties) for categorical ones."""
    long = _long_ints(df, features, cluster_col)
    t = F.broadcast(types.select("feature_name", "feature_type"))
    means = (long.groupBy(CLUSTER, "feature_name").agg(F.avg(F.col("v").cast("double")).alias("value"))
             .join(t, "feature_name").filter(F.col("feature_type") != "categorical"))
    counts = (long.join(t.filter(F.col("feature_type") == "categorical"), "feature_name")
              .groupBy(CLUSTER, "feature_name", "feature_type", "v").agg(F.count(F.lit(1)).alias("n")))
    w = Window.partitionBy(CLUSTER, "feature_name").orderBy(F.col("n").desc(), F.col("v"))   # <= max_cat rows each
    modes = (counts.withColumn("_r", F.row_number().over(w)).filter(F.col("_r") == 1)
             .select(CLUSTER, "feature_name", "feature_type", F.col("v").cast("double").alias("value")))
    return means.select(CLUSTER, "feature_name", "feature_type", "value").unionByName(modes)


def cluster_table(df: DataFrame, label: str, binary_features: Sequence[str],
                  cluster_col: str = CLUSTER) -> DataFrame:
    """K5: cluster size (``TOTAL``), rows with a non-zero label
    (``POS_OUTCOME``) and non-zero counts of each binary feature.  Nulls are
    not counted."""
    return (df.groupBy(qcol(cluster_col).cast("int").alias(CLUSTER))
            .agg(F.count(F.lit(1)).alias("TOTAL"),
                 F.count_if(F.coalesce(qcol(label) != 0, F.lit(False))).alias("POS_OUTCOME"),
                 *[F.count_if(F.coalesce(qcol(c) != 0, F.lit(False))).alias(c) for c in binary_features]))


def cluster_significance(df: DataFrame, features: Sequence[str], types: DataFrame,
                         cluster_col: str = CLUSTER) -> DataFrame:
    """K6: per feature, chi-square of the cluster x value table for binary
    and categorical features, one-way ANOVA F for numeric ones:
    ``(feature_name, feature_type, test, statistic, dof1, dof2)``.

    chi2 = sum over observed cells of O^2/E - N (absent cells add nothing);
    F = (SSB / (k-1)) / (SSW / (N-k)) from per-cluster count, mean, var_pop.
    """
    t = F.broadcast(types.select("feature_name", "feature_type"))
    # chi-square from contingency counts
    cat = (_long_ints(df, features, cluster_col).join(t.filter(F.col("feature_type") != "numeric"), "feature_name")
           .groupBy("feature_name", CLUSTER, "v").agg(F.count(F.lit(1)).cast("double").alias("o")))
    rows_t = cat.groupBy("feature_name", CLUSTER).agg(F.sum("o").alias("r"))
    cols_t = cat.groupBy("feature_name", "v").agg(F.sum("o").alias("c"))
    tot = rows_t.groupBy("feature_name").agg(F.sum("r").alias("n"), F.count(F.lit(1)).alias("n_r"))
    n_c = cols_t.groupBy("feature_name").agg(F.count(F.lit(1)).alias("n_c"))
    chi = (cat.join(rows_t, ["feature_name", CLUSTER]).join(cols_t, ["feature_name", "v"])
           .join(F.broadcast(tot), "feature_name")
           .groupBy("feature_name", "n", "n_r")
           .agg(F.sum(F.col("o") * F.col("o") * F.col("n") / (F.col("r") * F.col("c"))).alias("s"))
           .join(F.broadcast(n_c), "feature_name")
           .select("feature_name", F.lit("chi2").alias("test"), (F.col("s") - F.col("n")).alias("statistic"),
                   ((F.col("n_r") - 1) * (F.col("n_c") - 1)).cast("bigint").alias("dof1"),
                   F.lit(None).cast("bigint").alias("dof2")))
    # one-way ANOVA
    num_feats = features
    pairs = F.array(*[F.struct(F.lit(c).alias("feature_name"), qcol(c).cast("double").alias("v")) for c in num_feats])
    longd = (df.select(qcol(cluster_col).cast("int").alias(CLUSTER), F.inline(pairs)).filter(F.col("v").isNotNull())
             .join(t.filter(F.col("feature_type") == "numeric"), "feature_name"))
    g = longd.groupBy("feature_name", CLUSTER).agg(F.count(F.lit(1)).cast("double").alias("ng"),
                                                   F.avg("v").alias("mg"), F.var_pop("v").alias("vg"))
    grand = g.groupBy("feature_name").agg((F.sum(F.col("ng") * F.col("mg")) / F.sum("ng")).alias("gm"),
                                          F.sum("ng").alias("n"), F.count(F.lit(1)).alias("k"))
    an = (g.join(F.broadcast(grand), "feature_name")
          .groupBy("feature_name", "n", "k")
          .agg(F.sum(F.col("ng") * (F.col("mg") - F.col("gm")) * (F.col("mg") - F.col("gm"))).alias("ssb"),
               F.sum(F.col("ng") * F.col("vg")).alias("ssw"))
          .select("feature_name", F.lit("anova").alias("test"),
                  F.when((F.col("k") > 1) & (F.col("n") > F.col("k")) & (F.col("ssw") > 0),
                         (F.col("ssb") / (F.col("k") - 1)) / (F.col("ssw") / (F.col("n") - F.col("k"))))
                  .alias("statistic"),
                  (F.col("k") - 1).cast("bigint").alias("dof1"), (F.col("n") - F.col("k")).cast("bigint").alias("dof2")))
    return chi.unionByName(an).join(t, "feature_name").select(
        "feature_name", "feature_type", "test", "statistic", "dof1", "dof2")


def p_values(stats: DataFrame) -> DataFrame:
    """Upper-tail p-values for K6 statistics (one row per feature reaches the driver).  The tails are computed as such
    (regularised incomplete gamma and beta functions of commons-math), never as one minus a distribution function, so
    they keep their digits down to the smallest double."""
    spark = stats.sparkSession
    special = spark._jvm.org.apache.commons.math3.special
    rows = []
    for r in stats.collect():
        p = None
        if r["statistic"] is not None and r["dof1"]:
            x = max(float(r["statistic"]), 0.0)
            if r["test"] == "chi2":
                p = special.Gamma.regularizedGammaQ(r["dof1"] / 2.0, x / 2.0)
            elif r["dof2"]:
                d1, d2 = float(r["dof1"]), float(r["dof2"])
                p = special.Beta.regularizedBeta(d2 / (d2 + d1 * x), d2 / 2.0, d1 / 2.0)
        rows.append((*[r[c] for c in stats.columns], p))
    schema = T.StructType([*stats.schema.fields, T.StructField("p_value", T.DoubleType())])
    return spark.createDataFrame(rows, schema)


# ---------------------------------------------------------------- K7-K8

def mine_rules(df: DataFrame, features: Sequence[str], cluster_col: str = CLUSTER,
               min_samples_leaf: int = 10, max_depth: int = 10, seed: int = 0, max_bins: int = 1024):
    """K7: CART tree (gini) predicting the cluster from the features;
    returns ``(model, training accuracy)``.  MLlib takes depths up to 30;
    a larger ``max_depth`` is an error.  MLlib takes split candidates from a
    sample of max(``max_bins`` ** 2, 10000) rows: with at most ``max_bins``
    sampled values all gaps between them, beyond that ``max_bins`` quantiles."""
    if int(max_depth) > 30:
        raise ValueError("max_depth must be at most 30")
    from pyspark.ml.classification import DecisionTreeClassifier
    from pyspark.ml.evaluation import MulticlassClassificationEvaluator
    x = _vectors(df, features).withColumn("_y", qcol(cluster_col).cast("double")) \
        .persist(StorageLevel.MEMORY_AND_DISK)
    model = DecisionTreeClassifier(featuresCol="_x", labelCol="_y", impurity="gini",
                                   minInstancesPerNode=int(min_samples_leaf), maxDepth=int(max_depth),
                                   maxBins=int(max_bins), seed=seed).fit(x)
    acc = MulticlassClassificationEvaluator(labelCol="_y", predictionCol="prediction", metricName="accuracy") \
        .evaluate(model.transform(x))
    x.unpersist()
    return model, acc


def tree_rules(model, features: Sequence[str]) -> list[tuple[int, int, str]]:
    """K8: one ``(leaf_no, predicted cluster, SQL predicate)`` per leaf, by
    walking the fitted tree (at most 2**depth nodes, on the driver)."""
    rules: list[tuple[int, int, str]] = []

    def name(i):
        return "`" + features[i].replace("`", "``") + "`"

    def walk(node, conds):
        if node.getClass().getSimpleName() == "LeafNode":
            rules.append((len(rules), int(node.prediction()), " AND ".join(conds) or "TRUE"))
            return
        split = node.split()
        f = name(split.featureIndex())
        if split.getClass().getSimpleName() == "ContinuousSplit":
            t = repr(float(split.threshold()))
            walk(node.leftChild(), conds + [f"{f} <= {t}"])
            walk(node.rightChild(), conds + [f"{f} > {t}"])
        else:
            left = ", ".join(repr(float(v)) for v in split.leftCategories())
            walk(node.leftChild(), conds + [f"{f} IN ({left})"])
            walk(node.rightChild(), conds + [f"NOT ({f} IN ({left}))"])

    walk(model._java_obj.rootNode(), [])
    return rules


def tree_leaf_expr(model, features: Sequence[str]):
    """The fitted tree as one nested ``CASE`` returning the leaf number (same
    numbering as ``tree_rules``), for routing rows with plain SQL where the
    model is not at hand; a row passes through at most ``depth`` tests."""
    counter = [0]

    def build(node):
        if node.getClass().getSimpleName() == "LeafNode":
            no = counter[0]
            counter[0] += 1
            return F.lit(no)
        split = node.split()
        c = qcol(features[split.featureIndex()])
        if split.getClass().getSimpleName() == "ContinuousSplit":
            cond = c <= F.lit(float(split.threshold()))
        else:
            cond = c.isin([float(v) for v in split.leftCategories()])
        left = build(node.leftChild())
        right = build(node.rightChild())
        return F.when(cond, left).otherwise(right)

    return build(model._java_obj.rootNode())


def apply_tree_rules(df: DataFrame, model, features: Sequence[str], cluster_col: str = CLUSTER) -> DataFrame:
    """K8 for a mined tree: support and confidence of every leaf rule in one
    pass.  The tree itself routes each row (MLlib's leaf index, leaves in
    preorder - the numbering of ``tree_rules``), so no per-rule test runs."""
    rules = tree_rules(model, features)
    pred = F.create_map(*[x for no, c, _ in rules for x in (F.lit(no), F.lit(c))])
    routed = model.copy().setLeafCol("_leaf").setPredictionCol("_p").setProbabilityCol("_pr") \
        .setRawPredictionCol("_raw").transform(_vectors(df, features))
    hits = routed.select(F.col("_leaf").cast("int").alias("rule_no"),
                         qcol(cluster_col).cast("int").alias("_actual"))
    agg = hits.groupBy("rule_no").agg(F.count(F.lit(1)).alias("support"),
                                      F.count_if(F.col("_actual") == pred[F.col("rule_no")]).alias("_hit"))
    return _rules_report(df.sparkSession, rules, agg)


def _rules_report(spark, rules, agg: DataFrame) -> DataFrame:
    rdf = spark.createDataFrame([(int(n), int(c), str(p)) for n, c, p in rules],
                                "rule_no int, cluster_id int, rule string")
    return (rdf.join(agg, "rule_no", "left")
            .select("rule_no", CLUSTER, "rule", F.coalesce("support", F.lit(0).cast("bigint")).alias("support"),
                    F.when(F.col("support") > 0, F.col("_hit").cast("double") / F.col("support").cast("double"))
                    .alias("confidence")))


def apply_rules(df: DataFrame, rules: Sequence[tuple], cluster_col: str = CLUSTER) -> DataFrame:
    """K8: evaluate given rules ``(rule_no, cluster, SQL predicate)`` in one
    pass (first matching rule wins) and report ``(rule_no, cluster_id,
    rule, support, confidence)``."""
    case = None
    for no, c, pred in rules:
        hit = F.struct(F.lit(int(no)).alias("rule_no"), F.lit(int(c)).alias("_pred"))
        case = F.when(F.expr(pred), hit) if case is None else case.when(F.expr(pred), hit)
    hits = (df.select(case.alias("_m"), qcol(cluster_col).cast("int").alias("_actual"))
            .filter(F.col("_m").isNotNull())
            .select("_m.rule_no", "_m._pred", "_actual"))
    agg = hits.groupBy("rule_no").agg(F.count(F.lit(1)).alias("support"),
                                      F.count_if(F.col("_actual") == F.col("_pred")).alias("_hit"))
    return _rules_report(df.sparkSession, rules, agg)
