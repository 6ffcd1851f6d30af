"""End-to-end flows: the reference's request handlers, re-expressed as Spark
jobs over the operators.

* ``profile_datasets``  - profile request: re-profile only stale datasets
* ``filter_to_dataset`` / ``join_to_dataset`` - derive a dataset, drop its
  stale profile, answer with the affected row count
* ``risk_flow``         - normalise, split, fit, score, evaluate
* ``cluster_flow``      - reduce, cluster, describe, mine rules
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortlab.operators import cleanse as C
from cohortlab.operators import cluster as K
from cohortlab.operators import combine as J
from cohortlab.operators import features as FE
from cohortlab.operators import profile as P
from cohortlab.operators import risk as R
from cohortlab.operators import select as SEL
from cohortlab.session import ensure_checkpoint_dir
from cohortlab.sources.datasets import Workspace, fingerprint, read_csvs, stale_profiles


def register_datasets(ws: Workspace, files: str | Sequence[str], nrows: str | Sequence[int] | None = None,
                      base_dir: str = "", schema=None) -> DataFrame:
    """Registration page: read the ``;``-separated CSV list, the first
    ``nrows`` rows of each (S1, equal-length lists), save each as
    ``df_<stem>`` (S3) and upsert their fingerprints (S7, S8).  Returns the
    registry rows of the new datasets."""
    frames = read_csvs(ws.spark, files, nrows, base_dir=base_dir, schema=schema)
    fps = None
    for name, df in frames.items():
        saved = ws.save(df, name)
        fp = fingerprint(saved, name=name)
        fps = fp if fps is None else fps.unionByName(fp)
    ws.update_registry(fps)
    return ws.registry().filter(F.col("dataset").isin(list(frames)))


def profile_datasets(ws: Workspace, names: Sequence[str] | None = None,
                     overrides: Mapping[str, Mapping[str, str]] | None = None, approx: bool = False,
                     distributions: bool = True) -> DataFrame:
    """Flow A: fingerprint every dataset (one aggregate each), decide which
    profiles are stale (S10), re-profile only those (P1-P6) with their
    distributions (P7-P9, unless switched off), update the registry (S8) and
    return all profiles as one table (P12)."""
    names = list(names or ws.names())
    if not names:
        raise ValueError("no datasets")
    overrides = overrides or {}
    data = {n: ws.load(n) for n in names}
    current = None
    for n in names:
        fp = fingerprint(data[n], name=n)
        current = fp if current is None else current.unionByName(fp)
    ensure_checkpoint_dir(ws.spark)
    current = current.checkpoint(eager=True)          # read by S10 and by the registry update
    stored = {n: ws.load_profile(n) for n in names}
    reasons = {r["dataset"]: r["reason"] for r in stale_profiles(current, ws.registry(), stored).collect()}
    for n in names:
        if reasons.get(n, "changed") != "fresh":
            ws.save_profile(P.profile(data[n], overrides=overrides.get(n), stored=stored[n] if reasons[n] != "changed"
                                      else None, approx=approx), n)
            if distributions:
                store_distributions(ws, n)
    ws.update_registry(current)
    return P.query_profiles({n: ws.load_profile(n) for n in names})


def store_distributions(ws: Workspace, name: str, cols: Sequence[str] | None = None, exact: bool = True) -> None:
    """P7-P9 of a stored dataset by the types of its stored profile: histogram and box of numeric columns, value counts
    of factors.  With ``cols`` only those columns' partitions are written."""
    df, prof = ws.load(name), ws.load_profile(name)
    if prof is None:
        raise KeyError(f"dataset {name!r} has no profile")
    types = {r["col_name"]: r["col_datatype"] for r in prof.select("col_name", "col_datatype").collect()}
    cols = [c for c in types if cols is None or c in cols]
    numeric = [c for c in cols if types[c] == "numeric" and c in P.numeric_columns(df)]
    factors = [c for c in cols if types[c] == "factor_s"]
    ws.save_distribution("histogram", name, P.histogram(df, numeric), cols)
    ws.save_distribution("box", name, P.box_summary(df, numeric, exact=exact), cols)
    ws.save_distribution("counts", name, P.factor_value_counts(P.value_counts(df, factors), prof), cols)


def retag_dataset(ws: Workspace, name: str, overrides: Mapping[str, str]) -> DataFrame:
    """P10 stored: set types of some columns, recompute their range, categories and distributions only, keep the rest.
    Returns the new profile."""
    prof = ws.load_profile(name)
    if prof is None:
        raise KeyError(f"dataset {name!r} has no profile")
    missing = sorted(set(overrides) - {r["col_name"] for r in prof.select("col_name").collect()})
    if missing:
        raise KeyError(f"columns not in the profile: {missing}")
    ws.save_profile(P.retag(ws.load(name), prof, overrides), name)
    store_distributions(ws, name, list(overrides))
    return ws.load_profile(name)


COLUMN_ACTIONS = ("DEL", "REMAIN", "CREATE")


def column_action(ws: Workspace, name: str, cols: Sequence[str], action: str,
                  new_name: str | None = None) -> DataFrame | None:
    """Column actions of the cleansing page (C1-C3), data and profile kept
    in step and the fingerprint renewed (S8):

    * ``DEL``    drop the columns in place;
    * ``REMAIN`` keep only the columns in place;
    * ``CREATE`` write the columns as a new dataset ``new_name`` (data only)
      and return the profile rows that belong to it.
    """
    if action not in COLUMN_ACTIONS:
        raise ValueError(f"unknown column action {action!r}; use one of {COLUMN_ACTIONS}")
    df = ws.load(name)
    prof = ws.load_profile(name)
    if action == "CREATE":
        if not new_name:
            raise ValueError("CREATE needs a new dataset name")
        out = ws.save(C.keep_columns(df, cols), new_name)
        ws.update_registry(fingerprint(out, name=new_name))
        return C.profile_rows(prof, cols, keep=True) if prof is not None else None
    new_prof = None
    if prof is not None:
        new_prof = C.profile_rows(prof, cols, keep=(action == "REMAIN"))
        ensure_checkpoint_dir(ws.spark)
        new_prof = new_prof.checkpoint(eager=True)     # the profile path is rewritten below
    out = ws.save(C.drop_columns(df, cols) if action == "DEL" else C.keep_columns(df, cols), name)
    if new_prof is not None:
        ws.save_profile(new_prof, name)
    ws.update_registry(fingerprint(out, name=name))
    return ws.load_profile(name)


def select_columns_to_dataset(ws: Workspace, name: str, action: str = "REMAIN", new_name: str | None = None,
                              **conditions) -> list[str]:
    """Column selection page (C4 with C2 / C3): the columns whose stored profile (types as corrected by the user; a
    missing profile is made first) meets every condition stay, in place (``REMAIN``) or as a new dataset (``CREATE``).
    Returns their names, one per column; none selected is an error and changes nothing."""
    prof = ws.load_profile(name)
    if prof is None:
        prof = ws.save_profile(P.profile(ws.load(name)), name)
    df = ws.load(name)
    chosen = {r["col_name"] for r in C.matching_columns(prof, df=df, **conditions).select("col_name").collect()}
    names = [c for c in df.columns if c in chosen]
    if not names:
        raise ValueError("no column meets the conditions")
    if action not in ("REMAIN", "CREATE"):
        raise ValueError(f"unknown action {action!r}; use REMAIN or CREATE")
    column_action(ws, name, names, action, new_name)
    return names


def filter_by_ids_to_dataset(ws: Workspace, source: str, ids: str, target: str, key: str | None = None,
                             ids_key: str = "DESYNPUF_ID") -> DataFrame:
    """ID filter (C7): keep the rows of ``source`` whose key stands in dataset ``ids``, save as ``target`` (S4) and return
    ``(n_kept, n_rows)`` (C8)."""
    df = ws.load(source)
    n_rows = df.count()
    kept = ws.save(C.filter_by_ids(df, ws.load(ids), key, ids_key), target)
    return ws.spark.createDataFrame([(kept.count(), n_rows)], "n_kept bigint, n_rows bigint")


def select_features_to_dataset(ws: Workspace, source: str, label: str, target: str, label_threshold: float = 1,
                               k: int | None = None, percentile: float | None = None,
                               threshold: float | None = None) -> DataFrame:
    """Feature selection page: split the label off (L1), recode it as ``label > label_threshold`` (L2), score every feature
    by information gain (L3), keep the best (L4) and save them with the original label as ``target``.  Returns the chosen
    ``(feature_name, feature_scores)``."""
    df = ws.load(source)
    x, _, _ = FE.split_label(df, label)
    features = [c for c in x.columns if c != "_row_id"]
    scored = SEL.information_gain(FE.recode_label(df, label, label_threshold), label, features)
    ensure_checkpoint_dir(ws.spark)
    chosen = SEL.select_top(scored, k=k, percentile=percentile, threshold=threshold).checkpoint(eager=True)   # a row a feature
    names = {r["feature_name"] for r in chosen.select("feature_name").collect()}
    ws.save(C.keep_columns(df, [c for c in features if c in names] + [label]), target)
    return chosen


def derive_dates(ws: Workspace, name: str, cols: Sequence[str], base: str, prefix: str = "",
                 new_name: str | None = None, fmt: str = "%Y%m%d") -> DataFrame:
    """Date handler: parse the columns in place (F2, written back to the
    source, whose profile becomes stale), then days against ``base``
    (F3, inverse) into ``new_name`` when given.  Returns the derived rows."""
    parsed = ws.save(FE.parse_dates(ws.load(name), cols, fmt), name)
    derived = FE.days_from_base(parsed, cols, base, inverse=True, prefix=prefix)
    return ws.save(derived, new_name) if new_name else derived


def explode_to_dataset(ws: Workspace, name: str, features: Sequence[str], prefix: str = "drv_f_",
                       new_name: str | None = None) -> DataFrame:
    """Factor handler: one-hot columns of the features (F1), all features in
    one projection, saved as ``new_name`` when given."""
    derived = FE.explode_factors(ws.load(name), features, prefix)
    return ws.save(derived, new_name) if new_name else derived


def derive_to_dataset(ws: Workspace, name: str, in_col: str, fn, out_col: str, new_name: str) -> DataFrame:
    """One-to-one handler (F4): add ``out_col = fn(in_col)`` and save as
    ``new_name`` (through the workspace, so a stale profile is dropped)."""
    return ws.save(FE.derive_one(ws.load(name), in_col, fn, out_col), new_name)


def filter_to_dataset(ws: Workspace, source: str, expr: str, target: str,
                      min_non_null: float | None = None) -> DataFrame:
    """Flow B (rows): filter by expression (C5) and optional non-null share
    (C6), save as ``target`` (S4) and return ``(n_kept, n_rows)`` (C8)."""
    df = ws.load(source)
    pred = F.expr(C.rewrite_expr(expr))
    if min_non_null:
        pred = pred & (C.non_null_share(df) >= float(min_non_null))
    # counted before the save: the target may be the source itself
    counts = C.affected(df, pred).first()
    ws.save(df.filter(pred), target)
    return ws.spark.createDataFrame([counts.asDict()], "n_kept bigint, n_rows bigint")


def join_to_dataset(ws: Workspace, left: str, right: str, target: str, key: str | None = None,
                    how: str | None = "inner", by_rows: bool = False) -> DataFrame:
    """Flow B (join): key join (J1), row-identity join (J2) or concat (J3,
    when ``by_rows`` and ``how='left'``); saves ``target`` and returns its shape."""
    lt, rt = ws.load(left), ws.load(right)
    if key:
        out = J.join_key(lt, rt, key, how, split_hot=True)
    elif by_rows and (how or "inner") == "left":
        out = J.concat_columns(lt, rt)
    else:
        out = J.join_rows(lt, rt)
    saved = ws.save(out, target)
    return saved.agg(F.count(F.lit(1)).alias("n_rows"), F.lit(len(saved.columns)).alias("n_cols"))


def risk_flow(df: DataFrame, features: Sequence[str], label: str, id_col: str, ratio: float = 0.2,
              threshold: float = 0.5, algorithm: str = "LR", seed: int = 0, label_shift: float | None = 1.0,
              missing: str = "error") -> dict[str, DataFrame]:
    """Flow C: shift the label (L2), min-max the features (F5), stratified
    split (R1), fit LR or RF (R2/R3), weights (R4), score both splits in one
    transform (R5), threshold metrics, ROC points and AUC (R6-R8).  ``missing``:
    ``error`` on a missing feature value, or ``mean`` / ``median`` of the
    training rows in its place.

    The prepared table is written once to the checkpoint folder, so fitting
    and every evaluation read it instead of re-deriving it."""
    features = list(features)
    data = df.select(qcols(id_col, label, *features))
    if label_shift is not None:
        data = FE.shift_label(data, label, label_shift)
    data = R.stratified_split(FE.min_max(data, features), label, id_col, ratio, seed=seed)
    ensure_checkpoint_dir(df.sparkSession)
    data = data.checkpoint(eager=True)
    train = data.filter(F.col("split") == "train")
    if missing != "error":
        data = K.impute(data, K.fit_imputer(train, features, missing))
        train = data.filter(F.col("split") == "train")
    if algorithm.upper() == "RF":
        model = R.fit_forest(train, features, label, seed=seed)
    elif algorithm.upper() == "LR":
        model = R.fit_logistic(train, features, label)
    else:
        raise ValueError(f"unknown algorithm {algorithm!r}; use LR or RF")
    scored = R.score(model, data, features)
    roc = R.roc_points(scored, label, "p", "split")
    return {"weights": R.coefficients(model, features),
            "metrics": R.threshold_metrics(scored, label, "p", "split", threshold),
            "roc": roc, "auc": R.auc(roc), "scored": scored}


def cluster_flow(df: DataFrame, features: Sequence[str], label: str | None = None, id_col: str = "_row_id",
                 n_components: int = 5, n_clusters: int = 2, n_init: int = 10,
                 min_samples_leaf: int = 10, max_depth: int = 10, seed: int = 0, missing: str = "error") -> dict:
    """Patient clustering and rule mining: PCA (K1) -> k-means (K2) ->
    silhouette on the unreduced features (K3) -> feature types and
    per-cluster description (K4) -> cluster table (K5) -> significance (K6)
    -> CART rules with support and confidence (K7, K8).  ``missing`` as for
    ``risk_flow``, over all rows."""
    features = list(features)
    if missing != "error":
        df = K.impute(df, K.fit_imputer(df, features, missing))
    k = min(n_components, len(features))
    pcs = K.reduce_pca(df, features, k=k, keep=[id_col])
    labels, _ = K.kmeans(pcs, [f"pc_{i}" for i in range(1, k + 1)], k=n_clusters, n_init=n_init,
                         seed=seed, keep=[id_col])
    ensure_checkpoint_dir(df.sparkSession)
    data = df.join(labels, id_col).checkpoint(eager=True)
    types = K.type_features(data, features)
    binary = [r["feature_name"] for r in types.filter(F.col("feature_type") == "binary").collect()]
    tree, accuracy = K.mine_rules(data, features, min_samples_leaf=min_samples_leaf, max_depth=max_depth, seed=seed)
    return {"clusters": data.select(id_col, K.CLUSTER),
            "silhouette": K.silhouette(data, features),
            "types": types,
            "summary": K.cluster_summary(data, features, types),
            "table": K.cluster_table(data, label, binary) if label else None,
            "significance": K.cluster_significance(data, features, types),
            "rules": K.apply_tree_rules(data, tree, features),
            "rule_accuracy": accuracy}


def qcols(*names: str):
    from cohortlab.functions.columns import qcol
    seen, out = set(), []
    for n in names:
        if n not in seen:
            seen.add(n)
            out.append(qcol(n))
    return out
