"""Chat formatting with cumulative-snapshot collapse (operator 8), DataFrame functions only.

Chat logs often store a conversation again after every turn.  Each turn has
three 64-bit hashes tagged with its position; the running XOR over the turns
is the rolling hash of the prefix.  A conversation whose whole hash is a
proper prefix of another is dropped by an anti-join; of equal conversations
the smallest conv_id stays.  The turns of those that remain are rendered.

Repeated rows (same conv_id, turn, role and text) count once; turns that tie
are ordered by role and text.  Null roles render as ``user``, null texts as
empty, and both are told apart from the literal values when hashing.  Rows
with a null conv_id belong to no conversation and are left out; null turns
sort first.  An empty table gives no rows; extra columns are ignored.

Turns are summed in blocks of ``BLOCK`` turn numbers first and block totals
after, so that one very long conversation is spread over tasks; grouped
hashes are pre-aggregated and both sides of the anti-join have unique keys.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BLOCK = 1024
HASHES = ("h1", "h2", "h3")


def _ranked(turns: DataFrame) -> DataFrame:
    """Add ``pos`` (from 1) and the rolling hashes ``h1..h3`` of the prefix ending here."""
    t = turns.withColumn("block", F.floor(F.coalesce(F.col("turn"), F.lit(-1)) / BLOCK))
    order = (F.col("turn").asc_nulls_first(), F.col("role").asc_nulls_first(), F.col("text").asc_nulls_first())
    inside = Window.partitionBy("conv_id", "block").orderBy(*order)
    upto = inside.rowsBetween(Window.unboundedPreceding, 0)
    before = Window.partitionBy("conv_id").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    starts = (t.groupBy("conv_id", "block").agg(F.count(F.lit(1)).alias("n"))
              .select("conv_id", "block", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("pos0")))
    t = (t.withColumn("in_block", F.row_number().over(inside)).join(starts, ["conv_id", "block"])
         .withColumn("pos", F.col("pos0") + F.col("in_block")))
    body = [F.col("pos"), F.col("role"), F.col("role").isNull(), F.col("text"), F.col("text").isNull()]
    t = t.select("conv_id", "turn", "role", "text", "block", "pos",
                 *[F.xxhash64(F.lit(i), *body).alias(f"x{h}") for i, h in enumerate(HASHES)])
    totals = t.groupBy("conv_id", "block").agg(*[F.bit_xor(f"x{h}").alias(h) for h in HASHES])
    carried = totals.select("conv_id", "block", *[
        F.coalesce(F.bit_xor(h).over(before), F.lit(0).cast("long")).alias(f"b{h}") for h in HASHES])
    t = t.select("*", *[F.bit_xor(f"x{h}").over(upto).alias(f"r{h}") for h in HASHES])
    return t.join(carried, ["conv_id", "block"]).select(
        "conv_id", "turn", "role", "text", "pos",
        *[F.col(f"r{h}").bitwiseXOR(F.col(f"b{h}")).alias(h) for h in HASHES])


def render_turn(role: Column, text: Column) -> Column:
    return F.concat(F.lit("<|im_start|>"), F.coalesce(role, F.lit("user")), F.lit("\n"),
                    F.coalesce(text, F.lit("")), F.lit("<|im_end|>\n"))


def collapse_snapshots(turns: DataFrame) -> DataFrame:
    """Maximal conversations: conv_id, n_turns, n_equal (logged copies of it, itself included)."""
    clean = _distinct_turns(turns)
    return _maximal(_ranked(clean))


def _distinct_turns(turns: DataFrame) -> DataFrame:
    return turns.where("conv_id is not null").select("conv_id", "turn", "role", "text").distinct()


def _maximal(ranked: DataFrame) -> DataFrame:
    per = ranked.groupBy("conv_id").agg(F.max("pos").alias("n_turns"), F.max_by(F.struct(*HASHES), "pos").alias("h"))
    whole = per.groupBy("n_turns", "h").agg(F.min("conv_id").alias("conv_id"), F.count(F.lit(1)).alias("n_equal"))
    ends = per.select("conv_id", F.col("n_turns").alias("pos"))
    # prefixes that some conversation continues: one row per distinct hash
    proper = (ranked.join(ends, ["conv_id", "pos"], "left_anti")
              .select(F.col("pos").alias("n_turns"), F.struct(*HASHES).alias("h")).distinct())
    return whole.join(proper, ["n_turns", "h"], "left_anti").select("conv_id", "n_turns", "n_equal")


def format_chats(turns: DataFrame) -> DataFrame:
    """Rendered turns of the maximal conversations: conv_id, pos (from 1), n_turns, n_equal, rendered."""
    ranked = _ranked(_distinct_turns(turns))
    kept = _maximal(ranked)
    return (ranked.select("conv_id", "pos", "role", "text").join(kept, "conv_id")
            .select("conv_id", "pos", "n_turns", "n_equal", render_turn(F.col("role"), F.col("text")).alias("rendered")))


ORACLE = """
WITH t AS (SELECT DISTINCT conv_id, turn, role, text FROM conversations WHERE conv_id IS NOT NULL),
p AS (SELECT conv_id, role, text,
        ROW_NUMBER() OVER w AS pos,
        STRING_AGG(md5(COALESCE('r' || role, 'n') || chr(1) || COALESCE('t' || text, 'n')), '/') OVER w AS prefix
      FROM t WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role NULLS FIRST, text NULLS FIRST
                          ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
n AS (SELECT conv_id, CAST(MAX(pos) AS BIGINT) AS n_turns, ARG_MAX(prefix, pos) AS whole FROM p GROUP BY conv_id),
u AS (SELECT MIN(conv_id) AS conv_id, n_turns, whole, COUNT(*) AS n_equal FROM n GROUP BY n_turns, whole),
k AS (SELECT * FROM u WHERE whole NOT IN (SELECT prefix FROM p JOIN n USING (conv_id) WHERE pos < n_turns))
SELECT p.conv_id, CAST(p.pos AS BIGINT) AS pos, k.n_turns, k.n_equal,
       '<|im_start|>' || COALESCE(role, 'user') || chr(10) || COALESCE(text, '') || '<|im_end|>' || chr(10) AS rendered
FROM p JOIN k ON p.conv_id = k.conv_id
"""
