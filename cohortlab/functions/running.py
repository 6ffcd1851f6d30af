"""Distributed running totals and exact quantiles.

A running total over an ordered column is a prefix sum, which a plain
window without ``partitionBy`` computes in one task.  Here the rows are
range-partitioned on ``(group, order)`` instead; per-partition sums (one row
per partition and group) become offsets through a tiny window, and each
partition adds its offset to its own local running total.  Every task holds
one range partition, whose size the range sampler balances.

Exact quantiles bracket each wanted rank by a sketch and then count, in one
pass, the rows between the brackets and the values inside them.
"""

from __future__ import annotations

import math
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cohortlab.functions.columns import unpivot_double
from cohortlab.functions.sizing import small_side


def running_sum(df: DataFrame, group_cols: Iterable[str], order_col: str, value_cols: Iterable[str],
                descending: bool = False, n_parts: int | None = None, prefix: str = "cum_") -> DataFrame:
    """Add ``{prefix}{v}``: sum of ``v`` over the rows of the same group whose
    order value comes before or equals this row's (rows should be unique per
    group and order value, e.g. after a ``groupBy``).
    """
    group_cols, value_cols = list(group_cols), list(value_cols)
    spark = df.sparkSession
    if n_parts is None:
        n_parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    order: Column = F.col(order_col).desc() if descending else F.col(order_col).asc()
    # Range bounds come from sampling, so two evaluations of the exchange
    # need not agree; the range-partitioned rows are written once (reliable
    # checkpoint in the shared checkpoint folder) and both the partition sums
    # and the local running totals read that same copy.
    from cohortlab.session import ensure_checkpoint_dir
    ensure_checkpoint_dir(spark)
    ranged = (df.repartitionByRange(n_parts, *[F.col(g) for g in group_cols], order)
              .checkpoint(eager=True)
              .withColumn("_pid", F.spark_partition_id()))
    part = ranged.groupBy("_pid", *group_cols).agg(*[F.sum(v).alias(f"_ps_{v}") for v in value_cols])
    before = Window.partitionBy(*group_cols).orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    offsets = part.select("_pid", *group_cols, *[
        F.coalesce(F.sum(f"_ps_{v}").over(before), F.lit(0)).alias(f"_off_{v}") for v in value_cols])
    local = Window.partitionBy("_pid", *group_cols).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    inside = ranged.select("*", *[F.sum(v).over(local).alias(f"_in_{v}") for v in value_cols])
    # offsets hold one row per (partition, group)
    joined = inside.join(small_side(offsets), ["_pid", *group_cols])
    return joined.select(*[F.col(c) for c in df.columns],
                         *[(F.col(f"_off_{v}") + F.col(f"_in_{v}")).alias(f"{prefix}{v}") for v in value_cols])


def rank_index(n: int, p: float, interpolation: str) -> tuple[int, int, float]:
    """0-based indices (lo, hi) and weight of ``hi`` for quantile ``p`` of ``n`` values."""
    if interpolation == "linear":
        h = (n - 1) * p
        lo = int(math.floor(h))
        return lo, min(lo + 1, n - 1), h - lo
    if interpolation == "lower":          # discrete: smallest value with rank >= p * n
        k = max(int(math.ceil(n * p)) - 1, 0)
        return k, k, 0.0
    raise ValueError(f"unknown interpolation {interpolation!r}")


SKETCH = 1_000                     # accuracy of the sketch that brackets a rank
BRACKET_ROWS = 2_000_000           # rows of a column that may lie in its brackets at the last pass


def exact_quantiles(df: DataFrame, cols: list[str], probs: list[float], counts: dict[str, int],
                    interpolation: str = "linear", accuracy: int = SKETCH, bracket_rows: int = BRACKET_ROWS) -> DataFrame:
    """Exact quantiles ``(col_name, q_idx, value)`` of numeric columns, by bracketing.

    ``counts`` holds the non-null count of every column (known from a profile or one aggregate).  A quantile sketch
    gives each wanted rank a bracket of values that holds it (its error is at most ``n / accuracy`` ranks); brackets
    with more rows than ``bracket_rows`` are sketched again inside.  Rows below each bracket are counted and the values
    inside it grouped, so nothing of the data's size is shuffled or written.  A rank that its bracket should miss
    is found by ranking all distinct values."""
    cols = [c for c in cols if counts.get(c, 0) > 0]
    spark = df.sparkSession
    schema = "col_name string, q_idx int, value double"
    if not cols:
        return spark.createDataFrame([], schema)
    ranks = {c: sorted({k for p in probs for k in rank_index(counts[c], p, interpolation)[:2]}) for c in cols}
    brackets = _measure(df, _sketch(df, {c: [(None, None, 0, counts[c], ranks[c])] for c in cols}, accuracy))
    while True:
        wide = {c: [b for b in bs if b[3] > bracket_rows and (b[0] is None or b[1] is None or b[0] < b[1])] for c, bs in brackets.items()}
        wide = {c: bs for c, bs in wide.items() if bs}
        if not wide:
            break
        finer = _measure(df, _sketch(df, wide, accuracy))
        for c, bs in wide.items():
            brackets[c] = [b for b in brackets[c] if b not in bs] + finer[c]
        if all(sum(b[3] for b in finer[c]) >= sum(b[3] for b in bs) / 2 for c, bs in wide.items()):   # heavy values: no narrower
            break
    # a bracket of one value needs no look inside
    found = {(c, k): lo for c, bs in brackets.items() for lo, hi, under, n, ks in bs for k in ks if lo is not None and lo == hi and under <= k < under + n}
    rest = {c: [b for b in bs if any((c, k) not in found for k in b[4])] for c, bs in brackets.items()}
    found.update(_values_at(df, ranks, {c: bs for c, bs in rest.items() if bs}))
    lost = [c for c in cols if any((c, k) not in found for k in ranks[c])]
    if lost:
        found.update(_ranked(df, lost, ranks))
    out = []
    for c in cols:
        for j, p in enumerate(probs):
            lo, hi, w = rank_index(counts[c], p, interpolation)
            a, b = found[c, lo], found[c, hi]
            out.append((c, j, a + w * (b - a) if w else a))
    return spark.createDataFrame(out, schema)


def _inside(v: Column, lo, hi) -> Column:
    cond = F.lit(True)
    if lo is not None:
        cond = cond & (v >= F.lit(lo))
    return cond if hi is None else cond & (v <= F.lit(hi))


def _sketch(df: DataFrame, brackets: dict, accuracy: int) -> dict:
    """Narrower brackets ``(lo, hi, None, None, ranks)`` for the ranks of each bracket, one aggregate.  An open end is None."""
    aggs, plan = [], []
    for c, bs in brackets.items():
        v = F.col("`" + c.replace("`", "``") + "`").cast("double")
        for lo, hi, below, n, ks in bs:
            slack = 2 * math.ceil(n / accuracy) + 2
            ends = [(k, k - below - slack, k - below + 1 + slack) for k in ks]
            shares = sorted({min(max(x / n, 0.0), 1.0) for _, a, b in ends for x in (a, b)})
            plan.append((c, lo, hi, n, ends, shares))
            aggs.append(F.percentile_approx(F.when(_inside(v, lo, hi), v), shares, accuracy).alias(f"s{len(aggs)}"))
    row = df.agg(*aggs).first()
    out: dict = {c: [] for c in brackets}
    for i, (c, lo, hi, n, ends, shares) in enumerate(plan):
        at = dict(zip(shares, row[i])) if row[i] is not None else {}
        fresh = []
        for k, a, b in ends:
            fresh.append([lo if a <= 0 else at.get(min(max(a / n, 0.0), 1.0), lo), hi if b >= n else at.get(min(max(b / n, 0.0), 1.0), hi), [k]])
        merged: list = []
        for x in sorted(fresh, key=lambda x: (x[0] is not None, x[0] or 0.0)):
            if merged and (merged[-1][1] is None or x[0] is None or x[0] <= merged[-1][1]):
                merged[-1][1] = None if merged[-1][1] is None or x[1] is None else max(merged[-1][1], x[1])
                merged[-1][2] += x[2]
            else:
                merged.append(x)
        out[c] += [(x[0], x[1], None, None, sorted(x[2])) for x in merged]
    return out


def _measure(df: DataFrame, brackets: dict) -> dict:
    """Brackets with the numbers of rows below and inside, one aggregate."""
    aggs = []
    for c, bs in brackets.items():
        v = F.col("`" + c.replace("`", "``") + "`").cast("double")
        for lo, hi, *_ in bs:
            aggs += [(F.count_if(v < F.lit(lo)) if lo is not None else F.lit(0)).alias(f"b{len(aggs)}"),
                     F.count_if(v.isNotNull() & _inside(v, lo, hi)).alias(f"i{len(aggs)}")]
    row, i, out = df.agg(*aggs).first(), 0, {}
    for c, bs in brackets.items():
        out[c] = []
        for lo, hi, _, _, ks in bs:
            out[c].append((lo, hi, row[i], max(row[i + 1], 1), ks))
            i += 2
    return out


def _values_at(df: DataFrame, ranks: dict, brackets: dict) -> dict:
    """{(column, rank): value} from the rows below each bracket and the grouped values inside; rows in no bracket of any
    column go no further than the scan."""
    if not brackets:
        return {}
    pairs, near, below = [], F.lit(False), []
    for c, bs in brackets.items():
        v = F.col("`" + c.replace("`", "``") + "`").cast("double")
        no = F.lit(None).cast("int")
        for i, (lo, hi, under, *_) in reversed(list(enumerate(bs))):
            no = F.when(_inside(v, lo, hi), i).otherwise(no)
            below.append((c, i, under))
        here = v.isNotNull() & no.isNotNull()
        near = near | here
        pairs.append(F.struct(F.lit(c).alias("col_name"), F.when(here, no).alias("no"), v.alias("v")))
    table = (df.where(near).select(F.inline(F.array(*pairs))).where("no is not null").groupBy("col_name", "no", "v")
             .agg(F.count(F.lit(1)).alias("cnt")))
    under = df.sparkSession.createDataFrame(below, "col_name string, no int, under long")
    upto = Window.partitionBy("col_name", "no").orderBy("v").rowsBetween(Window.unboundedPreceding, 0)       # one bracket
    cum = table.join(F.broadcast(under), ["col_name", "no"]).withColumn("cum_cnt", F.col("under") + F.sum("cnt").over(upto))
    return _pick(cum, ranks)


def _pick(cum: DataFrame, ranks: dict) -> dict:
    """The value whose cumulative range holds each rank; as many rows reach the driver as ranks are asked for."""
    spark = cum.sparkSession
    targets = spark.createDataFrame([(c, k) for c, ks in ranks.items() for k in ks], "t_col string, k long")
    hit = cum.join(F.broadcast(targets), (F.col("col_name") == F.col("t_col"))
                   & (F.col("cum_cnt") - F.col("cnt") <= F.col("k")) & (F.col("k") < F.col("cum_cnt")))
    return {(r["t_col"], r["k"]): r["v"] for r in hit.select("t_col", "k", "v").collect()}


def _ranked(df: DataFrame, cols: list[str], ranks: dict) -> dict:
    """The same by running totals over all distinct values (a shuffle of those)."""
    vc = unpivot_double(df, cols).groupBy("col_name", "v").agg(F.count(F.lit(1)).alias("cnt"))
    return _pick(running_sum(vc, ["col_name"], "v", ["cnt"]), {c: ranks[c] for c in cols})
