"""Joins (J1-J3): key equi-join, row-identity join and side-by-side concat.

Spark picks the physical join: AQE turns a sort-merge join into a broadcast
join when one side turns out small at runtime and splits skewed partitions
(``spark.sql.adaptive.skewJoin.enabled``).  No side is broadcast by hint,
since none has a size bound known up front.  A full outer join is written
as a left outer join plus the unmatched right rows, so that a hot key is
split on either side.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortlab.functions.columns import ROW_ID, qcol, unused

JOIN_TYPES = {"inner": "inner", "left": "left", "right": "right", "outer": "full_outer"}


def _suffix(left: DataFrame, right: DataFrame, keys: list[str], suffixes=("_l", "_r")):
    """Both sides with names that differ, compared as Spark compares them (without case).  A name on both sides gets the
    side's suffix; one that is then still taken is numbered ``_2``, ``_3`` ..., left side first, in column order.  The right
    side's keys take the left side's spelling."""
    low_keys = {k.lower(): k for k in keys}
    clash = ({c.lower() for c in left.columns} & {c.lower() for c in right.columns}) - set(low_keys)
    plain = [c for d in (left, right) for c in d.columns if c.lower() not in clash and c.lower() not in low_keys]
    taken = set(low_keys) | {c.lower() for c in plain}
    sides = []
    for d, suffix in zip((left, right), suffixes):
        out = []
        for c in d.columns:
            if c.lower() in low_keys:
                out.append(qcol(c).alias(low_keys[c.lower()]))
            elif c.lower() in clash:
                out.append(qcol(c).alias(unused(c + suffix, taken)))
            else:
                out.append(qcol(c))
        sides.append(d.select(*out))
    return sides


def hot_keys(df: DataFrame, keys: list[str], support: float = 0.01) -> list:
    """Keys that may hold ``support`` of the rows or more, found in one pass without a shuffle (frequent-item counters:
    none is missed, some may be rarer).  At most 1 / ``support`` keys."""
    key = F.struct(*[qcol(k) for k in keys])
    full = df.where(F.coalesce(*[F.when(qcol(k).isNull(), F.lit(False)) for k in keys], F.lit(True)))
    found = full.select(key.alias("key")).freqItems(["key"], support).first()
    return [tuple(r) for r in (found[0] or [])]


def _is_hot(keys: list[str], hot: list) -> Column:
    any_of = F.lit(False)
    for values in hot:
        one = F.lit(True)
        for k, v in zip(keys, values):
            one = one & (qcol(k) == F.lit(v))
        any_of = any_of | F.coalesce(one, F.lit(False))
    return any_of


def _salted(left: DataFrame, right: DataFrame, keys: list[str], salts: int) -> DataFrame:
    """Inner join whose keys are dealt over a ``salts`` x ``salts`` grid: a left row takes one line of the grid (by a hash of
    the row) and stands in all its columns, a right row the other way round, so each pair meets once."""
    line, column = F.lit(salts), F.lit(salts)
    names = unused("_line", {c.lower() for c in left.columns + right.columns}), unused("_column", {c.lower() for c in left.columns + right.columns})
    every = F.explode(F.sequence(F.lit(0), F.lit(salts - 1)))
    own = lambda d, n: F.pmod(F.xxhash64(*[qcol(c) for c in d.columns]), n).cast("int")
    ls = left.select("*", own(left, line).alias(names[0]), every.alias(names[1]))
    rs = right.select("*", every.alias(names[0]), own(right, column).alias(names[1]))
    return ls.join(rs, [*keys, *names], "inner").drop(*names)


def join_key(left: DataFrame, right: DataFrame, key: str | list[str], how: str | None = "inner",
             suffixes=("_l", "_r"), split_hot: bool = False, support: float = 0.01, salts: int = 16) -> DataFrame:
    """Equi-join on ``key``; ``how`` in left/right/inner/outer (blank ->
    inner).  Other clashing names get ``_l`` / ``_r``; null keys never match.

    ``split_hot``: keys that hold ``support`` of either side's rows (one pass over the keys of each side finds them) are
    joined apart, dealt over ``salts`` x ``salts`` parts, whichever side they crowd; rows that are equal
    in every column stay together.  Without it AQE alone splits skewed partitions: both sides of an inner
    join, the outer side of an outer one."""
    how = (how or "inner").strip() or "inner"
    if how not in JOIN_TYPES:
        raise ValueError(f"unknown join type {how!r}; use one of {sorted(JOIN_TYPES)}")
    keys = [key] if isinstance(key, str) else list(key)
    for k in keys:
        if k.lower() not in {c.lower() for c in left.columns} or k.lower() not in {c.lower() for c in right.columns}:
            raise KeyError(f"join key {k!r} missing on one side")
    ls, rs = _suffix(left, right, keys, suffixes)
    hot = list(dict.fromkeys(hot_keys(ls, keys, support) + hot_keys(rs, keys, support))) if split_hot else []
    if not hot and how != "outer":
        return ls.join(rs, keys, JOIN_TYPES[how])
    if not hot:
        matched = ls.join(rs, keys, "left")
    else:
        cold = ls.where(~_is_hot(keys, hot)).join(rs.where(~_is_hot(keys, hot)), keys, "inner")
        matched = cold.unionByName(_salted(ls.where(_is_hot(keys, hot)), rs.where(_is_hot(keys, hot)), keys, salts))
        if how in ("left", "outer"):
            lone = ls.join(rs.select(*[qcol(k) for k in keys]).distinct(), keys, "left_anti")
            matched = matched.unionByName(lone, allowMissingColumns=True)
    if how in ("right", "outer"):
        # The rows of the right side without a match; AQE splits skewed partitions of an
        # anti join, which it cannot do for a full outer join.
        lone = rs.join(ls.select(*[qcol(k) for k in keys]).distinct(), keys, "left_anti")
        matched = matched.unionByName(lone, allowMissingColumns=True)
    return matched


def join_rows(left: DataFrame, right: DataFrame, suffixes=("_l", "_r")) -> DataFrame:
    """Inner join on row identity."""
    return join_key(left, right, ROW_ID, "inner", suffixes)


def concat_columns(left: DataFrame, right: DataFrame, suffixes=("_l", "_r")) -> DataFrame:
    """All rows of ``left`` with ``right``'s columns beside them (null
    where ``right`` has no such row)."""
    return join_key(left, right, ROW_ID, "left", suffixes)
