"""Hard-negative mining with an STR-packed R-tree (operator 11).

Rows are tiled sort-tile-recursive over their coordinates of largest spread:
Spark cuts slabs by the first, range-partitions each slab by the second and
writes the tiles as shards of bounded size; inside a task a shard becomes a
packed tree, leaves tiled further (label first) and packed upwards.  A node's
minimum bounding box gives an interval of its rows' inner products with an
anchor: per coordinate the product lies between anchor*low and anchor*high.
A best-first queue, ordered by the upper end, leaves out boxes outside every
score window of the anchor and boxes strictly below the k-th score found.

Anchors are routed to every shard as rows that follow the shard's own rows in
one sorted partition, so a task holds one shard and streams any number of
anchors.  Nothing is broadcast and nothing goes through the driver but counts.

Defined results: rows with a null label or vector, or a null or non-finite
component, take no part; an empty table gives an empty result; shorter vectors
are padded by zeros; repeated rows (also under one id) are rows of their own;
rows without an id come last among ties; other columns of the input are not
read, whatever their names.  Scores are exact integers; one beyond 64 bits is
an error.
"""

from __future__ import annotations

import heapq
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cohortlab.llm.common import written

NO_ID = np.iinfo(np.int64).max
FOUND = "a_key long, a_id long, slot int, id long, score long"


# ------------------------------------------------------------------ the tree

def _tile(order: np.ndarray, q: np.ndarray, coords: list[int], leaf: int, out: list) -> None:
    """Sort-tile-recursive: cut ``order`` into slabs along the first coordinate, each slab along the rest."""
    if len(order) <= leaf:
        out.append(order)
        return
    order = order[np.argsort(q[order, coords[0]], kind="stable")]
    leaves = math.ceil(len(order) / leaf)
    if len(coords) == 1:
        out.extend(order[i * leaf:(i + 1) * leaf] for i in range(leaves))
        return
    slabs = math.ceil(leaves ** (1 / len(coords)))
    step = math.ceil(leaves / slabs) * leaf
    for i in range(0, len(order), step):
        _tile(order[i:i + step], q, coords[1:], leaf, out)


class PackedTree:
    """R-tree over one shard.  ``q``: integer vectors (rows x dims), exact in its dtype."""

    def __init__(self, keys, ids, labels, q, leaf: int = 128, fanout: int = 8, tile_dims: int = 3):
        spread = q.astype(np.float64).var(axis=0) if len(q) else np.zeros(q.shape[1])
        coords = [int(c) for c in np.argsort(-spread, kind="stable")[:tile_dims]]
        self.names = {v: i for i, v in enumerate(sorted(set(labels)))}
        codes = np.array([self.names[v] for v in labels], dtype=np.int64)
        parts: list[np.ndarray] = []
        for code in range(len(self.names)):                       # a leaf holds one label
            mine = np.flatnonzero(codes == code)
            _tile(mine, q, coords, leaf, parts) if coords else parts.append(mine)
        order = np.concatenate(parts) if parts else np.zeros(0, np.int64)
        self.keys, self.ids, self.codes, self.q = keys[order], ids[order], codes[order], q[order]
        ends = np.cumsum([len(p) for p in parts]) if parts else np.zeros(0, np.int64)
        self.start, self.end = np.concatenate([[0], ends[:-1]]).astype(np.int64), ends.astype(np.int64)
        low = np.array([self.q[s:e].min(axis=0) for s, e in zip(self.start, self.end)])
        high = np.array([self.q[s:e].max(axis=0) for s, e in zip(self.start, self.end)])
        first, last = self.codes[self.start], self.codes[self.end - 1]
        self.levels = [(low, high, first, last)]                   # leaves first, roots last
        self.fanout = fanout
        while len(low) > fanout:
            cut = np.arange(0, len(low), fanout)
            low, high = np.minimum.reduceat(low, cut), np.maximum.reduceat(high, cut)
            first, last = np.minimum.reduceat(first, cut), np.maximum.reduceat(last, cut)
            self.levels.append((low, high, first, last))

    def bounds(self, a: np.ndarray):
        """Per level the least and largest inner product a node allows with each row of ``a``."""
        up, down = np.maximum(a, 0), np.minimum(a, 0)
        return [(up @ low.T + down @ high.T, up @ high.T + down @ low.T) for low, high, _, _ in self.levels]

    def search(self, a: np.ndarray, least, most, code: int, same: bool, not_key: int, k: int, windows):
        """The first ``k`` rows of every score window [lo, hi]: same label as ``code`` (and not the anchor's
        own row) or another label.  ``least``/``most``: this anchor's bounds per level."""
        lows = [w[0] for w in windows]                             # rises to the k-th score once k rows are found
        top = max(w[1] for w in windows)
        best: list[list] = [[] for _ in windows]
        heap: list = []

        def push(level, nodes):
            _, _, first, last = self.levels[level]
            lo, hi, floor = least[level], most[level], min(lows)
            for x in nodes:
                if hi[x] < floor or lo[x] > top:
                    continue
                if (not first[x] <= code <= last[x]) if same else (first[x] == last[x] == code):
                    continue
                heapq.heappush(heap, (-hi[x], level, x))

        push(len(self.levels) - 1, range(len(self.levels[-1][0])))
        while heap:
            upper, level, x = heapq.heappop(heap)
            if -upper < min(lows):                                 # strictly below every k-th score or window
                break
            if level:
                push(level - 1, range(x * self.fanout, min((x + 1) * self.fanout, len(self.levels[level - 1][0]))))
                continue
            s, e = self.start[x], self.end[x]
            scores = self.q[s:e] @ a
            for w, (_, hi) in enumerate(windows):
                ok = (scores >= lows[w]) & (scores <= hi)
                if same:
                    ok &= self.keys[s:e] != not_key
                at = np.flatnonzero(ok)
                if not len(at):
                    continue
                if len(at) > k:                                    # only rows not beaten by k others of this leaf
                    kth = np.partition(scores[at], len(at) - k)[len(at) - k]
                    at = at[scores[at] >= kth]
                best[w] = sorted(best[w] + [(-int(scores[i]), int(self.ids[s + i])) for i in at])[:k]
                if len(best[w]) == k:
                    lows[w] = max(lows[w], -best[w][-1][0])
        return best


# ------------------------------------------------------------ rows and shards

def _matrix(column: pa.Array, dims: int) -> np.ndarray:
    """Lists of integers as rows; double where every inner product stays exact there, else Python integers."""
    flat = column.flatten().to_numpy(zero_copy_only=False)
    sizes = np.diff(column.offsets.to_numpy(zero_copy_only=False))
    biggest = max((abs(int(flat.min())), abs(int(flat.max())))) if len(flat) else 0
    exact = biggest * biggest * max(dims, 1) < 2 ** 53
    out = np.zeros((len(sizes), dims), dtype=np.float64 if exact else object)
    if len(sizes) and (sizes == dims).all():
        out[:] = flat.reshape(len(sizes), dims) if exact else flat.astype(object).reshape(len(sizes), dims)
    else:
        at = 0
        for i, n in enumerate(sizes):
            out[i, :n] = flat[at:at + n] if exact else flat[at:at + n].astype(object)
            at += n
    return out


def _runs(batches):
    """Cut Arrow batches where (shard, kind) changes."""
    for b in batches:
        shard, kind = b.column("shard").to_numpy(zero_copy_only=False), b.column("kind").to_numpy(zero_copy_only=False)
        cut = np.flatnonzero((np.diff(shard) != 0) | (np.diff(kind) != 0)) + 1
        for s, e in zip([0, *cut], [*cut, b.num_rows]):
            if e > s:
                yield int(shard[s]), int(kind[s]), b.slice(s, e - s)


def _searcher(dims: int, k: int, low: int, high: int, negatives: bool):
    names = [x.split()[0] for x in FOUND.split(", ")]
    types = [pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64()]

    def run(batches):
        own, tree, at = [], None, None
        for shard, kind, part in _runs(batches):
            if shard != at:
                own, tree, at = [], None, shard
            if kind == 0:
                own.append(part)
                continue
            if not own:
                continue
            if tree is None:
                t = pa.Table.from_batches(own).combine_chunks()
                ids = t.column("id").fill_null(NO_ID).to_numpy()
                tree = PackedTree(t.column("key").to_numpy(), ids, t.column("label").to_pylist(),
                                  _matrix(t.column("q").combine_chunks() if t.num_rows else pa.array([], pa.list_(pa.int64())), dims))
            rows: list = []
            a = _matrix(part.column("q"), dims)
            if a.dtype != tree.q.dtype:
                a = np.array([[int(x) for x in r] for r in a], dtype=object)
                if tree.q.dtype != object:
                    tree.q = np.array([[int(x) for x in r] for r in tree.q], dtype=object)
                    tree.levels = [(np.array([[int(x) for x in r] for r in lo], dtype=object),
                                    np.array([[int(x) for x in r] for r in hi], dtype=object), f, t) for lo, hi, f, t in tree.levels]
            bounds = tree.bounds(a)
            for i, (key, aid, label, goals) in enumerate(zip(part.column("key").to_pylist(), part.column("id").to_pylist(),
                                                            part.column("label").to_pylist(), part.column("goals").to_pylist())):
                if negatives:
                    windows = [(-((-low * g) // 100), (high * g) // 100) for g in goals]
                else:
                    windows = [(-math.inf, math.inf)]
                least, most = [b[0][i] for b in bounds], [b[1][i] for b in bounds]
                for slot, best in enumerate(tree.search(a[i], least, most, tree.names.get(label, -1), not negatives, key, k, windows)):
                    rows += [(key, aid, slot, None if v == NO_ID else v, -s) for s, v in best]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names=names)
    return run


def _tiled(rows: DataFrame, n: int, shard_rows: int) -> DataFrame:
    """Two-coordinate STR over the table: slabs by the widest coordinate, ranges of the second inside a slab.
    The row key ends the sort key, so equal vectors still spread over shards."""
    spark = rows.sparkSession
    p = max(math.ceil(n / shard_rows), min(spark.sparkContext.defaultParallelism, math.ceil(n / 2048)), 1)
    spread = rows.agg(*[F.var_pop(F.get("q", F.lit(i)).cast("double")).alias(str(i)) for i in range(64)]).first()
    wide = sorted(range(64), key=lambda i: (-(spread[i] or 0.0), i))[:2]
    slabs = math.ceil(math.sqrt(p))
    x = F.coalesce(F.get("q", F.lit(wide[0])), F.lit(0))
    cuts = rows.agg(F.percentile_approx(x, [i / slabs for i in range(1, slabs)]).alias("c")).first()["c"] if slabs > 1 else []
    slab = F.lit(0)
    for c in cuts:
        slab = slab + (x >= F.lit(c)).cast("int")
    tiles = (rows.repartitionByRange(p, slab, F.coalesce(F.get("q", F.lit(wide[1])), F.lit(0)), F.col("key"))
             .withColumn("shard", F.spark_partition_id()))
    return written(tiles, "negative-shards")


def _search(shards: DataFrame, anchors: DataFrame, n_shards: int, dims: int, k: int, low: int, high: int,
            negatives: bool) -> DataFrame:
    """Each shard's best ``k`` rows per anchor (and window), then the best of all shards."""
    own = shards.select("shard", F.lit(0).alias("kind"), "key", "id", "label", "q", F.lit(None).cast("array<long>").alias("goals"))
    routed = anchors.select(F.explode(F.sequence(F.lit(0), F.lit(n_shards - 1))).alias("shard"), F.lit(1).alias("kind"),
                            "key", "id", "label", "q", "goals")
    mixed = own.unionByName(routed).repartition(n_shards, "shard").sortWithinPartitions("shard", "kind", "key")
    found = mixed.mapInArrow(_searcher(dims, k, low, high, negatives), FOUND)
    order = Window.partitionBy("a_key", "slot").orderBy(F.desc("score"), F.asc_nulls_last("id"))
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def mine_hard_negatives(df: DataFrame, is_anchor: Column, id_col: str = "vec_id", label_col: str = "label",
                        vector_col: str = "embedding", label: Column | None = None, scale: int = 256, n_positives: int = 5,
                        n_negatives: int = 5, low: int = 80, high: int = 100, shard_rows: int = 131_072) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score).

    Components become floor(scale * x); the score is the integer inner product with the anchor.  An anchor's
    positives are its best ``n_positives`` other rows of the same label; for each, the best ``n_negatives`` rows of
    another label with low*positive <= 100*score <= high*positive.  ``is_anchor`` and ``label`` are expressions over
    the input.  A shard holds about ``shard_rows`` rows; work is anchors x the boxes that survive."""
    quoted = lambda c: F.col("`" + c.replace("`", "``") + "`")
    vector = quoted(vector_col).cast("array<double>")
    usable = vector.isNotNull() & F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    rows = written(df.where(F.coalesce(usable, F.lit(False)) & quoted(label_col).isNotNull())
                   .select(quoted(id_col).cast("long").alias("id"), (quoted(label_col) if label is None else label).cast("string").alias("label"),
                           F.transform(vector, lambda x: F.floor(F.lit(float(scale)) * x)).alias("q"),
                           F.coalesce(is_anchor, F.lit(False)).alias("is_anchor"), F.monotonically_increasing_id().alias("key"))
                   .where("label is not null"), "negative-rows")
    n, dims = rows.agg(F.count(F.lit(1)), F.max(F.size("q"))).first()
    shards = _tiled(rows, n, shard_rows)
    n_shards = (shards.agg(F.max("shard")).first()[0] or 0) + 1
    anchors = shards.where("is_anchor").select("key", "id", "label", "q", F.lit(None).cast("array<long>").alias("goals"))
    near = _search(shards, anchors, n_shards, dims or 0, n_positives, low, high, negatives=False)
    positives = written(near.groupBy("a_key").agg(F.sort_array(F.collect_list(F.struct("rank", "id", "score"))).alias("p")), "negative-positives")
    goals = anchors.drop("goals").join(positives, F.col("key") == F.col("a_key")).withColumn("goals", F.col("p.score"))
    far = _search(shards, goals, n_shards, dims or 0, n_negatives, low, high, negatives=True)
    return (far.join(positives, "a_key").withColumn("pos", F.get("p", F.col("slot")))
            .select(F.col("a_id").alias("anchor_id"), F.col("pos.id").alias("positive_id"), F.col("rank").cast("int").alias("rank"),
                    F.col("id").alias("negative_id"), F.col("pos.score").alias("positive_score"), F.col("score").alias("negative_score")))


ORACLE = """
WITH v AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
         list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS q
  FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT a.vec_id AS anchor_id, a.label AS anchor_label, b.vec_id, b.label,
         CAST(list_dot_product(a.q, b.q) AS BIGINT) AS score
  FROM v a JOIN v b ON a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id),
p AS (
  SELECT anchor_id, anchor_label, vec_id AS positive_id, score AS positive_score
  FROM s WHERE label = anchor_label
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5),
n AS (
  SELECT p.anchor_id, positive_id, s.vec_id AS negative_id, positive_score, s.score AS negative_score,
         row_number() OVER (PARTITION BY p.anchor_id, positive_id ORDER BY s.score DESC, s.vec_id) AS rank
  FROM p JOIN s ON s.anchor_id = p.anchor_id AND s.label <> p.anchor_label
   AND 80 * positive_score <= 100 * s.score AND 100 * s.score <= 100 * positive_score)
SELECT anchor_id, positive_id, CAST(rank AS INTEGER) AS rank, negative_id, positive_score, negative_score
FROM n WHERE rank <= 5
"""
