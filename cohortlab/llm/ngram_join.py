"""N-gram Jaccard self-join with several global orders (operator 9).

A document is the set of its distinct 4-word shingles (64-bit hashes; with
fewer words one shingle of the whole sequence).  Two documents link when
100 * shared >= ``percent`` * union.  Equal sets form one class first, by a
128-bit digest, so exact copies are compared once.

Prefix filter: under any fixed order of all shingles, linked sets meet in
their first n - ceil(percent * n / 100) + 1 shingles, and not only in one:
they share o = ceil(percent * (n + m) / (100 + percent)) or more in all, at
most n - o of a set lie outside the other, and of the prefix that ends first
in the order whatever is shared lies in the other prefix too.  So the prefixes
share o + 1 - ceil(percent * max(n, m) / 100) or more (``needed``).  The filter is
applied under ``ORDERS`` different orders.  All put frequent shingles last
(those seen twice in a sample of documents, ``COMMON`` at most, by their
count there; an order may be any, so the sample decides cost only) and break
ties by different mixes of the hash.  The first order drives the shuffle
join, which counts what a pair shares; candidates must also share enough
under the others before the exact check of the two whole sets.

Large groups: the orders put what an edit made of a shingle first, so near
copies are gathered without them.  Documents that share the smallest mix of
all their shingles, under one of several mixes, are compared with one of them:
by turns that with the smallest id and that with the fewest shingles unseen in
the sample (the least edited one).  Then only documents that are in
*different* components, whose sizes allow a link (bands of sizes are joined,
not all of them) and that each have as many shared prefix shingles as a link
of their sizes needs meet in a shingle, so every link that joins two
components is found, while a group of near copies costs about its size, not
its square.

Null or empty texts have an empty set and link with nothing.  Rows that share
a doc_id are one node.  Rows without doc_id keep a null component.  An empty
table gives an empty table.  Other columns are not read, whatever their names.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cohortlab.functions.columns import unused
from cohortlab.functions.sizing import small_side
from cohortlab.llm.common import flat_map_rows, lower_ascii_bytes, min_label_components, slices, word_bounds, word_hashes, written

SHINGLE = 4
PERCENT = 85
ORDERS = 3
SAMPLE = 0.02                 # share of documents that supplies the order
COMMON = 200_000              # frequent shingles told apart
MIX = (0xBF58476D1CE4E5B9, 0x94D049BB133111EB, 0xD6E8FEB86659FD93)   # odd multipliers, one an order
GATHER = (0x9FB21C651E98DF25, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3)   # and one a smallest mix
class Shingler:
    """Sorted distinct shingle hashes of a text."""

    def __init__(self, size: int = SHINGLE):
        self.size = size

    def __call__(self, text: str | None) -> np.ndarray:
        raw = lower_ascii_bytes(text)
        starts, ends = word_bounds(raw)
        if not len(starts):
            return np.empty(0, np.uint64)
        h = word_hashes(raw, starts, ends)
        n = min(self.size, len(h))
        total = np.full(len(h) - n + 1, n, np.uint64)
        for k in range(n):
            total = (total ^ h[k:len(h) - n + 1 + k]) * np.uint64(0x9E3779B97F4A7C15)
            total ^= total >> np.uint64(31)
        return np.unique(total)


def prefix_size(n: int, percent: int) -> int:
    return n - -(-percent * n // 100) + 1 if n else 0


def needed(n: str, m: str, percent: int) -> str:
    """SQL: shingles that the prefixes of two linked sets of ``n`` and ``m`` shingles share at least."""
    whole = 100 + percent
    return (f"greatest(1L, ({percent}L * ({n} + {m}) + {whole - 1}L) div {whole}L + 1L"
            f" - ({percent}L * greatest({n}, {m}) + 99L) div 100L)")


def often_seen(s: np.ndarray, common: tuple) -> np.ndarray:
    """How often a set's shingles stand in the sample; ``common``: sorted frequent shingles, their counts."""
    names, counts = common
    if not len(names):
        return np.zeros(len(s), np.int64)
    at = np.minimum(np.searchsorted(names, s), len(names) - 1)
    return np.where(names[at] == s, counts[at], 0)


def prefix(s: np.ndarray, often: np.ndarray, order: int, percent: int) -> np.ndarray:
    """First shingles of a set under global order number ``order``."""
    mixed = (s ^ (s >> np.uint64(33))) * np.uint64(MIX[order])
    size = prefix_size(len(s), percent)
    rare = np.flatnonzero(often == 0)
    if len(rare) >= size > 0:
        return s[rare[np.argsort(mixed[rare])[:size]]]
    return s[np.lexsort((mixed, often))[:size]]


def smallest_mixes(s: np.ndarray) -> list[int]:
    """The smallest mix of a set's shingles for each multiplier of ``GATHER``."""
    folded = s ^ (s >> np.uint64(31))
    return [int((folded * np.uint64(m)).min().astype(np.int64)) for m in GATHER] if len(s) else []


def common_shingles(docs: DataFrame, text_col: str, size: int = SHINGLE, sample: float = SAMPLE, most: int = COMMON) -> tuple:
    """Shingles that stand in several documents of a sample, sorted, and their numbers of documents there."""
    def run(batches):
        shingles = Shingler(size)
        for b in slices(batches):
            sets = [shingles(t) for t in b.column(0).to_pylist()]
            if sets:
                names, n = np.unique(np.concatenate(sets), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(names.view(np.int64)), pa.array(n)], names=["shingle", "n"])
    # at most ``most`` rows of two numbers reach the driver, whatever the corpus
    got = (docs.select(F.col(text_col).alias("text")).sample(sample, 11).mapInArrow(run, "shingle long, n long")
           .groupBy("shingle").agg(F.sum("n").alias("n")).where("n > 1").orderBy(F.desc("n"), "shingle").limit(most).toArrow())
    names, counts = got.column("shingle").to_numpy().view(np.uint64), got.column("n").to_numpy()
    order = np.argsort(names)
    return names[order], counts[order]


def document_sets(docs: DataFrame, common: tuple, percent: int, id_col: str = "doc_id", text_col: str = "text",
                  size: int = SHINGLE) -> DataFrame:
    """doc_id, n_shingles, a 128-bit digest of the set (null if empty), the first order's prefix as 64-bit shingles and
    for each other order its prefix cut to 32 bits (null, which passes, where a cut makes two of them equal);
    n_rare: shingles unseen in the sample, mixes: the smallest mixes."""
    names = [f"order{o}" for o in range(1, ORDERS)]

    def run(batches):
        shingles = Shingler(size)
        for batch in slices(batches):
            rows = []
            for text in batch.column(1).to_pylist():
                s = shingles(text)
                often = often_seen(s, common)
                row = [int((often == 0).sum()), smallest_mixes(s), len(s), hashlib.sha256(s.tobytes()).digest()[:16] if len(s) else None, prefix(s, often, 0, percent).view(np.int64)]
                for order in range(1, ORDERS):
                    cut = prefix(s, often, order, percent).astype(np.uint32)
                    row.append(cut.view(np.int32) if len(np.unique(cut)) == len(cut) else None)
                rows.append(row)
            if rows:
                rare, mixes, n, digest, first, *others = zip(*rows)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).cast(pa.int64()), pa.array(rare, pa.int64()), pa.array(mixes, pa.list_(pa.int64())), pa.array(n, pa.int64()), pa.array(digest, pa.binary()),
                     pa.array(first, pa.list_(pa.int64())), *[pa.array(o, pa.list_(pa.int32())) for o in others]],
                    names=["doc_id", "n_rare", "mixes", "n_shingles", "digest", "first", *names])
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(
        run, "doc_id long, n_rare long, mixes array<long>, n_shingles long, digest binary, first array<long>" + "".join(f", {c} array<int>" for c in names))


def _verify(pairs: DataFrame, texts: DataFrame, marks: DataFrame, percent: int, size: int) -> DataFrame:
    """Candidates (a, b) whose prefixes share enough under every order and that link by their exact sets."""
    names = ["n", "first", *[f"order{o}" for o in range(1, ORDERS)]]
    ends = lambda p: small_side(p.select(F.explode(F.array("a", "b")).alias("rep")).distinct())
    near = marks.join(ends(pairs), "rep", "left_semi")
    side = lambda end: near.select(F.col("rep").alias(end), *[F.col(c).alias(f"{end}_{c}") for c in names])
    out = pairs.join(side("a"), "a").join(side("b"), "b").where(_near_size("a_n", "b_n", percent))
    for c in names[1:]:
        enough = F.expr(f"size(array_intersect(a_{c}, b_{c})) >= {needed('a_n', 'b_n', percent)}")
        out = out.where(enough | F.col(f"a_{c}").isNull() | F.col(f"b_{c}").isNull())
    pairs = written(out.select("a", "b").distinct(), "ngram-candidates")
    texts = texts.join(ends(pairs), "rep", "left_semi")

    def make():
        shingles, last = Shingler(size), [None, None]

        def rows(a, b, text_a, text_b):
            if last[0] != text_a:           # rows of one a often come together
                last[:] = [text_a, shingles(text_a)]
            x, y = last[1], shingles(text_b)
            both = len(np.intersect1d(x, y, True))
            if 100 * both >= percent * (len(x) + len(y) - both):
                yield a, b
        return rows
    left = texts.select(F.col("rep").alias("a"), F.col("text").alias("text_a"))
    right = texts.select(F.col("rep").alias("b"), F.col("text").alias("text_b"))
    return flat_map_rows(pairs.join(right, "b").join(left, "a"), ["a", "b", "text_a", "text_b"], "a long, b long", make)


def _near_size(a: str, b: str, percent: int):
    return F.expr(f"100L * least({a}, {b}) >= {percent}L * greatest({a}, {b})")


def _band(n: str, percent: int):
    """Sizes on a logarithmic scale whose unit is a little more than the ratio that still allows a link."""
    if percent >= 100:
        return F.col(n).cast("int")
    return F.floor(F.log(F.col(n).cast("double")) / F.lit(math.log(100.0 / percent) * (1 + 1e-6))).cast("int")


def _open_pairs(marks: DataFrame, comp: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) of different components that share enough of the first order's prefix."""
    placed = (marks.select("rep", "n", "first").join(comp.select(F.col("node").alias("rep"), "component"), "rep", "left")
              .select(F.explode("first").alias("token"), "rep", F.col("n").cast("int").alias("n"), F.coalesce("component", "rep").alias("component")))
    mixed = placed.groupBy("token").agg(F.min("component").alias("x"), F.max("component").alias("y")).where("x <> y").select("token")
    # a document with fewer such shingles than a link needs cannot link, however many documents have them
    rows = written(placed.join(mixed, "token").withColumn("band", _band("n", percent))
                   .withColumn("most", F.count(F.lit(1)).over(Window.partitionBy("rep", "n"))), "ngram-shared")
    # sizes of a link lie less than one band apart: equal bands meet once, a band and the next one once
    other = rows.select("token", F.col("rep").alias("rep2"), F.col("n").alias("n2"), F.col("component").alias("component2"),
                        F.col("band").alias("band2"), F.col("most").alias("most2"), F.explode(F.array("band", F.col("band") + 1)).alias("band"))
    met = (rows.join(other, ["token", "band"]).where("component <> component2 and (band2 < band or rep < rep2)")
           .where(_near_size("n", "n2", percent)).where(f"least(most, most2) >= {needed('n', 'n2', percent)}"))
    return (met.select(F.least("rep", "rep2").alias("a"), F.greatest("rep", "rep2").alias("b"),
                       F.least("n", "n2").alias("n"), F.greatest("n", "n2").alias("m"))
            .groupBy("a", "b", "n", "m").count().where(f"count >= {needed('n', 'm', percent)}").select("a", "b").distinct())


def link_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = PERCENT,
                    size: int = SHINGLE) -> DataFrame:
    """doc_id, n_shingles, component_id of every row."""
    sets = written(document_sets(docs, common_shingles(docs, text_col, size), percent, id_col, text_col, size), "ngram-sets")
    texts = docs.select(F.col(id_col).cast("long").alias("rep"), F.col(text_col).alias("text"))
    classes = sets.where("digest is not null and doc_id is not null").groupBy("digest").agg(F.min("doc_id").alias("rep"))
    marks = (sets.where("digest is not null").select(F.col("doc_id").alias("rep"), F.col("n_shingles").alias("n"), "n_rare", "mixes", "first",
                                                     *[f"order{o}" for o in range(1, ORDERS)])
             .join(small_side(classes.select("rep").distinct()), "rep", "left_semi"))
    # documents with the same smallest mix meet one of them
    tops = marks.select("rep", "n_rare", F.posexplode("mixes").alias("order", "token"))
    heads = (tops.groupBy("order", "token").agg(F.min("rep").alias("lo"), F.max("rep").alias("hi"),
                                                F.min(F.struct("n_rare", "rep")).alias("plain")).where("lo <> hi")
             .select("order", "token", F.when(F.col("order") % 2 == 0, F.col("lo")).otherwise(F.col("plain.rep")).alias("head")))
    met = (tops.join(heads, ["order", "token"]).where("rep <> head")
           .select(F.least("rep", "head").alias("a"), F.greatest("rep", "head").alias("b")).distinct())
    links = written(_verify(met, texts, marks, percent, size), "ngram-top-links")
    comp = written(min_label_components(links), "ngram-top-components")
    more = _verify(written(_open_pairs(marks, comp, percent), "ngram-open-pairs"), texts, marks, percent, size)
    # copies hang on their class representative
    copies = (sets.where("doc_id is not null").join(classes, "digest").where("doc_id <> rep")
              .select(F.col("doc_id").alias("a"), F.col("rep").alias("b")))
    tree = comp.where("node <> component").select(F.col("node").alias("a"), F.col("component").alias("b"))
    final = min_label_components(tree.union(more).union(copies))
    return (sets.select("doc_id", "n_shingles").join(final.withColumnRenamed("node", "doc_id"), "doc_id", "left")
            .select("doc_id", "n_shingles", F.coalesce("component", "doc_id").alias("component_id")))


def one_per_group(docs: DataFrame, percent: int, size: int, id_col: str = "doc_id") -> DataFrame:
    """``docs`` with only the document of smallest id of every group; rows without id stay."""
    mark = unused("gone", {c.lower() for c in docs.columns})
    gone = link_components(docs, id_col, "text", percent, size).where("component_id <> doc_id").select(F.col("doc_id").alias(mark)).distinct()
    return docs.join(gone, docs[id_col] == gone[mark], "left_anti")
