"""Exact CART classification trees (K7, K8) grown level by level on Spark.

Each feature's values lie in bins, whose bounds come from a sample and decide
cost only.  At each level all rows of the open nodes are counted by (node,
feature, bin, class), which combines map-side.  The running class totals give
the Gini gain at the end of every bin, and a bound on the gain of any split
inside it: the gain is convex in the class totals to the left, so it is largest
at a corner of the box that they can take.  Only bins whose bound reaches the
best gain of the node are counted by value.  So every split is weighed or
bounded, and the best is exact, however many values a feature has, while no
shuffle has the size of the data (unless nearly all bins stay open).  Splits
stand halfway between neighbouring values.  The driver holds the tree: a number
of nodes bounded by the depth and by rows / ``min_samples_leaf``.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field
from itertools import product

from pyspark import StorageLevel
from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cohortlab.functions.columns import qcol, quoted
from cohortlab.functions.sizing import small_side
from cohortlab.operators.cluster import CLUSTER, _rules_report, require_complete

MAX_CLASSES = 100
BINS = 1000                           # bins a feature
BIN_SAMPLE = 200_000                  # rows whose quantiles bound the bins
CORNER_CLASSES = 6                    # classes up to which all corners of a bin's box are tried
NESTED_NODES = 127                    # nodes up to which a row's node is found by nested conditions


@dataclass
class Node:
    counts: list[int]
    depth: int
    feature: int = -1                 # -1: a leaf
    threshold: float = 0.0
    left: int = -1                    # the right child is left + 1
    gain: float = 0.0

    @property
    def n(self) -> int:
        return sum(self.counts)

    @property
    def prediction(self) -> int:
        """Index of the most frequent class, the first among equals."""
        return max(range(len(self.counts)), key=lambda c: (self.counts[c], -c))


@dataclass
class CartTree:
    features: list[str]
    classes: list[int]
    nodes: list[Node] = field(default_factory=list)

    def _walk(self, i: int = 0, conds: tuple = ()):
        node = self.nodes[i]
        if node.feature < 0:
            yield i, conds
            return
        f, t = quoted(self.features[node.feature]), repr(float(node.threshold))
        yield from self._walk(node.left, (*conds, f"{f} <= {t}"))
        yield from self._walk(node.left + 1, (*conds, f"{f} > {t}"))

    def rules(self) -> list[tuple[int, int, str]]:
        """K8: one ``(leaf_no, predicted cluster, SQL predicate)`` per leaf, leaves from left to right."""
        return [(no, self.classes[self.nodes[i].prediction], " AND ".join(conds) or "TRUE") for no, (i, conds) in enumerate(self._walk())]

    @property
    def accuracy(self) -> float:
        """Share of training rows whose leaf predicts their class."""
        leaves = [n for n in self.nodes if n.feature < 0]
        total = sum(n.n for n in leaves)
        return sum(n.counts[n.prediction] for n in leaves) / total if total else 0.0

    def node_column(self, x: Column) -> Column:
        """The node (a leaf, in a grown tree) that an array of feature values falls to: nested conditions, in a large tree the
        nodes as constant arrays, walked from the root once a level."""
        if len(self.nodes) <= NESTED_NODES:
            def below(i: int) -> Column:
                node = self.nodes[i]
                if node.feature < 0:
                    return F.lit(i)
                return F.when(F.get(x, F.lit(node.feature)) <= F.lit(float(node.threshold)), below(node.left)).otherwise(below(node.left + 1))
            return below(0)
        feature, threshold, left = (F.array(*[F.lit(v) for v in col]) for col in zip(*[(n.feature, float(n.threshold), n.left) for n in self.nodes]))
        depth = max(n.depth for n in self.nodes)

        def down(node, _):
            f = F.get(feature, node)
            return F.when(f < 0, node).when(F.get(x, f) <= F.get(threshold, node), F.get(left, node)).otherwise(F.get(left, node) + 1)
        if depth == 0:
            return F.lit(0)
        return F.aggregate(F.sequence(F.lit(1), F.lit(depth)), F.lit(0), down)

    def leaf_column(self, df_features: Sequence[str] | None = None) -> Column:
        """Leaf number (as ``rules`` counts them) of a row."""
        x = F.array(*[qcol(c).cast("double") for c in (df_features or self.features)])
        number = {i: no for no, (i, _) in enumerate(self._walk())}
        return F.get(F.array(*[F.lit(number.get(i, -1)) for i in range(len(self.nodes))]), self.node_column(x))


def _binned(df: DataFrame, k: int, n: int) -> DataFrame:
    """``df`` (x0, x1, ..., y) with the bin b0, b1, ... of each of the ``k`` features' values."""
    xs = [f"x{i}" for i in range(k)]
    cuts = df.sample(min(1.0, BIN_SAMPLE / n), 7).approxQuantile(xs, [i / BINS for i in range(BINS)], 0.25 / BINS)
    inf = float("inf")
    splits = [[-inf, *(sorted({c for c in cut if -inf < c < inf}) or [0.0]), inf] for cut in cuts or [[]] * k]
    out = Bucketizer(splitsArray=splits, inputCols=xs, outputCols=[f"b{i}" for i in range(k)]).transform(df)
    return out.select(*xs, "y", *[F.col(f"b{i}").cast("int").alias(f"b{i}") for i in range(k)])


def _long(rows: DataFrame, tree: CartTree, open_: list[int]) -> DataFrame:
    """``(node, y, f, v, bin)``: a row per feature of each row of the open nodes."""
    k = range(len(tree.features))
    node = tree.node_column(F.array(*[F.col(f"x{i}") for i in k]))
    here = rows.select(node.alias("node"), "y", F.array(*[F.struct(F.col(f"x{i}").alias("v"), F.col(f"b{i}").alias("bin")) for i in k]).alias("s"))
    is_open = F.get(F.array(*[F.lit(i in set(open_)) for i in range(len(tree.nodes))]), F.col("node"))
    return here.where(is_open).select("node", "y", F.posexplode("s").alias("f", "s")).select("node", "y", "f", "s.v", "s.bin")


def _best_splits(rows: DataFrame, tree: CartTree, open_: list[int], min_leaf: int) -> dict:
    """Per open node ``(gain, feature, threshold, class counts to the left)`` of its best split, if it has one."""
    k = len(tree.classes)
    cs = range(k)
    long = _long(rows, tree, open_)
    counted = [F.count_if(F.col("y") == c).alias(f"c{c}") for c in cs]
    totals = [F.get(F.array(*[F.lit(n.counts[c]) for n in tree.nodes]), F.col("node")).cast("double") for c in cs]
    add = lambda xs: sum(xs[1:], xs[0])
    square = lambda xs: add([x * x for x in xs])
    n = add(totals)

    def gain_of(left):
        n_left, right = add(left), [t - x for t, x in zip(totals, left)]
        return (F.try_divide(square(left), n_left) + F.try_divide(square(right), n - n_left) - square(totals) / n) / n
    left = [F.col(f"cum_c{c}").cast("double") for c in cs]
    before = [F.col(f"pre_c{c}").cast("double") for c in cs]
    fits = (add(left) >= min_leaf) & (n - add(left) >= min_leaf)
    if k <= CORNER_CLASSES:
        bound = F.greatest(*[gain_of(list(corner)) for corner in product(*zip(before, left))])
    else:
        bound = (F.try_divide(square(left), add(before)) + F.try_divide(square([t - x for t, x in zip(totals, before)]), n - add(left))
                 - square(totals) / n) / n
    over = Window.partitionBy("node", "f").orderBy("bin")
    # at most nodes x features x bins rows
    bins = long.groupBy("node", "f", "bin").agg(F.min("v").alias("lo"), F.max("v").alias("hi"), *counted)
    bins = bins.select("node", "f", "bin", "lo", "hi", F.lead("lo").over(over).alias("following"), *[F.sum(f"c{c}").over(over).alias(f"cum_c{c}") for c in cs],
                       *[(F.sum(f"c{c}").over(over) - F.col(f"c{c}")).alias(f"pre_c{c}") for c in cs])
    bins = bins.withColumn("best", F.max(F.when(fits, gain_of(left))).over(Window.partitionBy("node"))).checkpoint(eager=True)
    # the margin is far above the rounding of doubles and of equal gains
    look = small_side(bins.where((F.col("lo") < F.col("hi")) & (add(left) >= min_leaf) & (n - add(before) >= min_leaf)
                                 & (F.coalesce(bound, F.lit(1.0)) >= F.coalesce("best", F.lit(0.0)) - 1e-9)))
    keys = ["node", "f", "bin"]
    values = (long.join(look.select(*keys), keys, "left_semi").groupBy(*keys, "v").agg(*counted)
              .join(look.select(*keys, "following", *[f"pre_c{c}" for c in cs]), keys))
    # a bin holds about one row in BINS, at most; equal values are one row
    inside = Window.partitionBy(*keys).orderBy("v")
    values = values.select("node", "f", "v", F.coalesce(F.lead("v").over(inside), "following").alias("following"),
                           *[(F.col(f"pre_c{c}") + F.sum(f"c{c}").over(inside)).alias(f"cum_c{c}") for c in cs])
    ends = bins.select("node", "f", F.col("hi").alias("v"), "following", *[f"cum_c{c}" for c in cs])
    gain = gain_of(left)
    # rounding keeps splits of equal gain equal; the first feature, then the lowest value wins
    order = F.struct(F.round(gain, 12).alias("gain"), (-F.col("f")).alias("nf"), (-F.col("v")).alias("nv"))
    picked = (ends.union(values).where(fits & F.col("following").isNotNull()).groupBy("node")
              .agg(F.max_by(F.struct("f", "v", "following", gain.alias("gain"), *[f"cum_c{c}" for c in cs]), order).alias("s")).collect())
    out = {}
    for r in picked:
        s = r["s"]
        if s["gain"] > 1e-12:
            mid = s["v"] + (s["following"] - s["v"]) / 2
            out[r["node"]] = (s["gain"], s["f"], mid if mid < s["following"] else s["v"], [s[f"cum_c{c}"] for c in cs])
    return out


def grow_tree(df: DataFrame, features: Sequence[str], cluster_col: str = CLUSTER, min_samples_leaf: int = 10,
              max_depth: int = 10) -> CartTree:
    """K7: exact CART (Gini) predicting the cluster.  A node splits while it is impure, has a split that lowers the
    impurity with ``min_samples_leaf`` rows on both sides, and is above ``max_depth``.  Rows without a cluster take no
    part; a missing feature value is an error.  Two passes over the rows a level; only counts are shuffled."""
    from cohortlab.session import ensure_checkpoint_dir
    ensure_checkpoint_dir(df.sparkSession)
    features = list(features)
    require_complete(df, features)
    labelled = df.where(qcol(cluster_col).isNotNull())
    groups = labelled.groupBy(qcol(cluster_col).cast("long").alias("y")).count().limit(MAX_CLASSES + 1).collect()
    if len(groups) > MAX_CLASSES:
        raise ValueError(f"more than {MAX_CLASSES} clusters in {cluster_col!r}")
    classes = sorted(r["y"] for r in groups)
    size = {r["y"]: r["count"] for r in groups}
    tree = CartTree(features, classes, [Node([size[c] for c in classes], 0)])
    if not classes:
        return tree
    index = F.create_map(*[x for i, c in enumerate(classes) for x in (F.lit(c), F.lit(i))])
    xs = [qcol(c).cast("double") for c in features]
    # 0.0 and -0.0 are one value
    plain = labelled.select(*[F.when(x == 0.0, F.lit(0.0)).otherwise(x).alias(f"x{i}") for i, x in enumerate(xs)],
                            index[qcol(cluster_col).cast("long")].alias("y"))
    rows = _binned(plain, len(features), tree.nodes[0].n).persist(StorageLevel.MEMORY_AND_DISK)
    try:
        open_ = [0]
        while True:
            open_ = [i for i in open_ if tree.nodes[i].depth < max_depth and tree.nodes[i].n >= 2 * min_samples_leaf
                     and sum(c > 0 for c in tree.nodes[i].counts) > 1]
            splits = _best_splits(rows, tree, open_, int(min_samples_leaf)) if open_ else {}
            if not splits:
                return tree
            open_ = []
            for i, (gain, f, threshold, left) in sorted(splits.items()):
                node = tree.nodes[i]
                node.feature, node.threshold, node.gain, node.left = f, threshold, gain, len(tree.nodes)
                tree.nodes += [Node(list(left), node.depth + 1), Node([a - b for a, b in zip(node.counts, left)], node.depth + 1)]
                open_ += [node.left, node.left + 1]
    finally:
        rows.unpersist()


def tree_rules_report(df: DataFrame, tree: CartTree, cluster_col: str = CLUSTER) -> DataFrame:
    """K8: support and confidence of every leaf rule in one pass: ``(rule_no, cluster_id, rule, support, confidence)``."""
    rules = tree.rules()
    predicted = F.get(F.array(*[F.lit(c) for _, c, _ in rules]), F.col("rule_no"))
    hits = df.where(qcol(cluster_col).isNotNull()).select(tree.leaf_column().alias("rule_no"), qcol(cluster_col).cast("long").alias("_actual"))
    agg = hits.groupBy("rule_no").agg(F.count(F.lit(1)).alias("support"), F.count_if(F.col("_actual") == predicted).alias("_hit"))
    return _rules_report(df.sparkSession, rules, agg)
