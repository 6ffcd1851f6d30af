"""Benchmark decontamination (operator 10), DataFrame functions only.

A test item is found in a document if the document contains at least
``threshold`` of the item's distinct five-word shingles.  Items are put into
partitions by their number of shingles m (powers of two).  Each partition has
its own MinHash sketch size: the k smallest shingle hashes of an item, with
k = m_max - ceil(threshold * m_max) + 1 for the largest m of the partition.
A document with enough of the item must hold one of these k (at most k - 1
can be missing), so the sketch search loses no pair.  Documents are not
sketched: all their shingle hashes are looked up, whatever their length.
Candidates are then verified on the shingles themselves, by exact containment.

Words are runs of letters and digits after lower-casing.  Items with fewer
than five words, null texts and null ids match nothing.  Rows that repeat an
id give one pair for it (the largest containment).  Empty tables give no
pairs; extra columns are ignored by the search and kept by ``decontaminate``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortlab.functions.sizing import small_side

SHINGLE = 5


def words(text: Column) -> Column:
    return F.array_remove(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+"), "")


def _shingle_hashes(w: Column, n: int) -> Column:
    """Distinct 64-bit hashes of all n-word shingles."""
    last = F.size(w) - n
    return F.when(last >= 0, F.array_distinct(F.transform(
        F.sequence(F.lit(0), last), lambda i: F.xxhash64(*[F.get(w, i + k) for k in range(n)])))).otherwise(
        F.array().cast("array<bigint>"))


def _shingle_texts(w: Column, n: int) -> Column:
    last = F.size(w) - n
    return F.when(last >= 0, F.array_distinct(F.transform(
        F.sequence(F.lit(0), last), lambda i: F.concat_ws(" ", F.slice(w, i + 1, n))))).otherwise(
        F.array().cast("array<string>"))


def item_sketches(items: DataFrame, threshold: float, id_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """(item, n, m, texts, sketch): n-word shingles, size-partitioned bottom-k sketches."""
    t = items.where(F.col(id_col).isNotNull()).select(F.col(id_col).alias("item"), words(F.col(text_col)).alias("w"))
    t = t.where(F.size("w") >= SHINGLE).select("item", _shingle_texts(F.col("w"), SHINGLE).alias("texts"),
                                               F.sort_array(_shingle_hashes(F.col("w"), SHINGLE)).alias("hashes"))
    m = F.size("hashes")
    top = F.pow(F.lit(2.0), F.ceil(F.log2(m.cast("double"))))            # partition (top/2, top]
    k = (top - F.ceil(top * F.lit(threshold)) + 1).cast("int")
    return t.select("item", m.alias("m"), "texts", F.slice("hashes", F.lit(1), F.least(k, m)).alias("sketch")).distinct()


def contained_items(docs: DataFrame, items: DataFrame, threshold: float = 0.8, id_col: str = "doc_id",
                    text_col: str = "text", item_id_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """(doc_id, item_id, n_item, n_shared, containment) of every document and item it holds."""
    sk = item_sketches(items, threshold, item_id_col, item_text_col)
    keys = small_side(sk.select(F.explode("sketch").alias("h"), "item").distinct())
    src = docs.where(F.col(id_col).isNotNull() & F.col(text_col).isNotNull()).select(
        F.col(id_col).alias("doc"), F.col(text_col).alias("body"))
    hashed = src.select("doc", words(F.col("body")).alias("w")).select("doc", F.explode(_shingle_hashes(F.col("w"), SHINGLE)).alias("h"))
    cand = small_side(hashed.join(keys, "h").select("doc", "item").distinct())
    # words stand in a projection of their own: inside the shingle function they would be split anew for every shingle
    split = src.join(small_side(cand.select("doc").distinct()), "doc").select("doc", words(F.col("body")).alias("w"))
    have = split.select("doc", _shingle_texts(F.col("w"), SHINGLE).alias("have"))
    shared = F.size(F.array_intersect("texts", "have"))
    pairs = (have.join(cand, "doc").join(small_side(sk.select("item", "m", "texts")), "item")
             .select("doc", "item", F.col("m").cast("long").alias("m"), shared.cast("long").alias("s")))
    return (pairs.groupBy("doc", "item", "m").agg(F.max("s").alias("s")).where(F.col("s") >= F.lit(threshold) * F.col("m"))
            .select(F.col("doc").alias("doc_id"), F.col("item").alias("item_id"), F.col("m").alias("n_item"),
                    F.col("s").alias("n_shared"), (F.col("s") / F.col("m")).alias("containment")))


def decontaminate(docs: DataFrame, items: DataFrame, threshold: float = 0.8, id_col: str = "doc_id") -> DataFrame:
    """``docs`` without the documents that hold a test item."""
    bad = contained_items(docs, items, threshold, id_col).select(F.col("doc_id").alias("__bad")).distinct()
    return docs.join(bad, F.col(id_col) == F.col("__bad"), "left_anti")


ORACLE = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') AS w
           FROM documents WHERE doc_id IS NOT NULL AND text IS NOT NULL),
b AS (SELECT item_id, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') AS w
      FROM benchmark WHERE item_id IS NOT NULL AND text IS NOT NULL),
ds AS (SELECT DISTINCT doc_id, array_to_string(w[i:i+4], ' ') AS s
       FROM (SELECT doc_id, w, UNNEST(range(1, len(w) - 3)) AS i FROM d)),
bs AS (SELECT DISTINCT item_id, array_to_string(w[i:i+4], ' ') AS s
       FROM (SELECT item_id, w, UNNEST(range(1, len(w) - 3)) AS i FROM b)),
n AS (SELECT item_id, COUNT(*) AS n_item FROM bs GROUP BY item_id)
SELECT ds.doc_id, bs.item_id, n.n_item, COUNT(*) AS n_shared, COUNT(*) / n.n_item AS containment
FROM bs JOIN ds USING (s) JOIN n USING (item_id)
GROUP BY ds.doc_id, bs.item_id, n.n_item HAVING COUNT(*) >= 0.8 * n.n_item
"""
