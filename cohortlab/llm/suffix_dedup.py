"""Exact removal of repeated byte strings with a logarithmic family of suffix arrays (operator 12).

A byte goes if a ``length``-byte string covering it also starts elsewhere, in
the same document or another.  Sorting every suffix of the corpus would move
many times its bytes, so suffixes are thinned twice, without loss:

1. Anchors.  Among the starts that a window of ``length`` bytes leaves for a
   ``GRAM``-byte string, the leftmost one of least hash is the window's anchor.  Equal
   windows have equal anchors at equal offsets, so a window whose anchor string
   stands nowhere else cannot repeat.  Anchor strings are counted by Spark (in
   one shuffle, by 64-bit hash; a clash only adds work).  Those seen twice in
   a small sample of documents are known to repeat and skip the shuffle, so
   no common passage fills one task.
2. Pieces.  For each repeated anchor the text of its windows (at most
   2*length - GRAM bytes) goes to the task of its anchor string.  There the
   index family lives: a batch of pieces gets its suffix array (windows ordered by
   their first eight bytes, then by a 64-bit fingerprint), the array is
   merge-scanned against each existing level for windows equal in both keys, which
   are then compared byte by byte, and levels of equal size merge, so that sizes
   grow geometrically.  A level keeps one window of each text, and a piece that
   equals an earlier one is settled on arrival.
   An anchor string with more pieces than one task should hold is settled by Spark
   instead: equal pieces are collapsed, and 128-bit digests of the windows of the distinct
   pieces are counted.

Texts that occur twice as a whole need no search.  What is removed per text
joins the texts again (compressed while shuffled).

Defined results: a null text is empty; documents shorter than ``length`` stay
whole; repeated rows count as different places, so both lose all bytes; null or
repeated ids are fine; an empty table gives no rows; other columns are not
read, whatever their names; very long texts are cut into overlapping slices for
the search, never truncated.
"""

from __future__ import annotations

import hashlib
import math
from collections import Counter

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cohortlab.llm.common import written

GRAM = 32
SLICE = 1 << 20                   # bytes searched at once
BATCH_WINDOWS = 1 << 18           # windows of a batch of the family
MIX1, MIX2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9)


# ------------------------------------------------------------- string hashes

def _join(a, b):
    x = a * MIX1 + (b ^ (b >> np.uint64(29))) * MIX2
    return x ^ (x >> np.uint64(32))


def gram_hashes(buf: np.ndarray, n: int) -> np.ndarray:
    """A 64-bit hash of the ``n`` bytes at every place, by doubling."""
    h, k = (buf.astype(np.uint64) + np.uint64(1)) * MIX1, 1
    while k * 2 <= n:
        h, k = _join(h[:-k], h[k:]), k * 2
    return h if k == n else _join(h[:len(h) - (n - k)], h[n - k:])


def _slide(v: np.ndarray, w: int, op) -> np.ndarray:
    """op over every run of ``w`` values."""
    k = 1
    while k * 2 <= w:
        v, k = op(v[:-k], v[k:]), k * 2
    return v if k == w else op(v[:len(v) - (w - k)], v[w - k:])


def anchors(buf: np.ndarray, length: int):
    """(anchor, first, count, hash): the windows starting at first.. (count of them) have this anchor."""
    none = np.zeros(0, np.int64)
    if len(buf) < length:
        return none, none, none, none.astype(np.uint64)
    h = gram_hashes(buf, GRAM)
    w = length - GRAM + 1
    low = _slide(h, w, np.minimum)                              # least hash of each window
    pad = np.full(w - 1, 0, np.uint64)
    marks = np.flatnonzero(_slide(np.concatenate([pad, low, pad]), w, np.maximum) == h)
    starts = np.arange(len(low))
    rank = np.searchsorted(marks, starts)                       # first mark not before the start
    open_ = starts
    while len(open_):
        open_ = open_[h[marks[rank[open_]]] != low[open_]]
        rank[open_] += 1
    at = marks[rank]
    cut = np.flatnonzero(np.diff(at, prepend=-1))
    count = np.diff(np.append(cut, len(at)))
    return at[cut], cut, count, h[at[cut]]


# --------------------------------------------------------- Arrow task helpers

def _binary(column: pa.Array):
    """(bytes of all rows, bounds) of a binary column without copying."""
    column = column.cast(pa.large_binary()) if not pa.types.is_large_binary(column.type) else column
    buffers = column.buffers()
    bounds = np.frombuffer(buffers[1], dtype=np.int64)[column.offset:column.offset + len(column) + 1]
    data = np.frombuffer(buffers[2], dtype=np.uint8) if buffers[2] else np.zeros(0, np.uint8)
    return data, bounds


def _pieces_of(data, bounds, length):
    """Anchors of every row, slice by slice: (row, anchor, first, count, hash), places relative to the row."""
    for row in range(len(bounds) - 1):
        s, e = int(bounds[row]), int(bounds[row + 1])
        for cut in range(s, max(e - length + 1, s), SLICE):
            at, first, count, h = anchors(data[cut:min(e, cut + SLICE + length - 1)], length)
            if len(at):
                yield row, at + (cut - s), first + (cut - s), count, h


def _marks(length: int):
    """Arrow task: (mark, key, span) of each anchor; span packs first start and number of windows."""
    def run(batches):
        for b in batches:
            keys = b.column("key")
            data, bounds = _binary(b.column("body"))
            out: list = []
            size = 0
            for row, _, first, count, h in _pieces_of(data, bounds, length):
                out.append((np.full(len(first), row), h.view(np.int64), first * 256 + count))
                size += len(first)
                if size >= 100_000:
                    yield _mark_batch(out, keys)
                    out, size = [], 0
            if out:
                yield _mark_batch(out, keys)
    return run


def _mark_batch(parts, keys):
    rows, mark, span = (np.concatenate(x) for x in zip(*parts))
    return pa.RecordBatch.from_arrays([pa.array(mark), keys.take(pa.array(rows)), pa.array(span)], names=["mark", "key", "span"])


def _compress(batches):
    press = zstandard.ZstdCompressor(level=1)
    for b in batches:
        yield pa.RecordBatch.from_arrays([b.column("key"), pa.array([press.compress(v.as_buffer()) for v in b.column("body")], pa.binary())],
                                         names=["key", "packed"])


def _cut_pieces(length: int):
    """Arrow task: the text of every wanted anchor's windows.  The third and later equal pieces of one text
    (periodic text has many) repeat for certain: their spans go out joined, with ``end`` in place of a text."""
    def run(batches):
        press = zstandard.ZstdDecompressor()
        names = ["mark", "key", "first", "piece", "end"]
        types = [pa.int64(), pa.binary(), pa.int64(), pa.binary(), pa.int64()]
        for b in batches:
            rows: list = []
            for key, packed, wanted in zip(b.column("key").to_pylist(), b.column("packed").to_pylist(), b.column("wanted").to_pylist()):
                body, times, settled = press.decompress(packed), Counter(), []
                for w in sorted(wanted, key=lambda w: w["span"]):
                    first, count = w["span"] >> 8, w["span"] & 255
                    piece = body[first:first + count - 1 + length]
                    times[piece] += 1
                    if times[piece] > 2:
                        settled.append((first, first + len(piece)))
                    else:
                        rows.append((w["mark"], key, first, piece, None))
                    if len(rows) >= 20_000:
                        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names=names)
                        rows = []
                rows += [(None, key, s, None, e) for s, e in merged(settled)]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names=names)
    return run


# --------------------------------------------------------- the index family

class SuffixArray:
    """Windows of a batch in suffix order: first eight bytes, then fingerprint; one window of each text."""

    def __init__(self, word, print_, place):
        self.word, self.print, self.place = word, print_, place

    def __len__(self):
        return len(self.place)


class IndexFamily:
    """Levels of suffix arrays whose sizes grow geometrically, over texts added batch by batch.

    ``repeated[i]`` tells whether window i (in order of arrival) equals another one."""

    def __init__(self, length: int):
        self.length = length
        self.words = np.zeros(0, np.uint64)        # the eight bytes at every place of the texts
        self.starts = np.zeros(0, np.int64)        # place of each window
        self.levels: list[SuffixArray] = []
        self.windows = 0
        self.repeated = np.zeros(1 << 16, bool)

    def _equal(self, a, b):
        """Compare windows given by number byte by byte, eight bytes at a time."""
        a, b = self.starts[a], self.starts[b]
        same = np.ones(len(a), bool)
        for i in [*range(0, self.length - 8, 8), self.length - 8]:
            same &= self.words[a + i] == self.words[b + i]
        return same

    def add(self, pieces: list[bytes]) -> None:
        """Insert a batch: suffix array, merge-scan against every level, geometric merge."""
        text = np.frombuffer(b"".join(pieces), dtype=np.uint8)
        sizes = np.array([len(p) for p in pieces])
        ends = np.cumsum(sizes)
        counts = sizes - self.length + 1
        run = np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)
        local = np.repeat(ends - sizes, counts) + run
        all_words = gram_words(text)
        prints, words = gram_hashes(text, self.length)[local], all_words[local]
        number = self.windows + np.arange(len(local))
        self.windows += len(local)
        while len(self.repeated) < self.windows:
            self.repeated = np.concatenate([self.repeated, np.zeros(len(self.repeated), bool)])
        self.starts = np.concatenate([self.starts, local + len(self.words)])
        self.words = np.concatenate([self.words, all_words])
        new = self._unique(words, prints, number)
        for level in self.levels:
            new = self._scan(new, level)
        self.levels.append(new)
        while len(self.levels) > 1 and len(self.levels[-2]) <= 2 * len(self.levels[-1]):
            b, a = self.levels.pop(), self.levels.pop()
            self.levels.append(_merge(a, b))

    def _unique(self, words, prints, number) -> SuffixArray:
        """Sort; equal neighbours, after a byte comparison with the first of them, are repeated; one stays."""
        order = np.lexsort((prints, words))
        words, prints, number = words[order], prints[order], number[order]
        same = np.zeros(len(order), bool)
        same[1:] = (words[1:] == words[:-1]) & (prints[1:] == prints[:-1])
        head = np.maximum.accumulate(np.where(same, 0, np.arange(len(order))))
        self._settle(number[same], number[head[same]])
        return SuffixArray(words[~same], prints[~same], number[~same])

    def _scan(self, new: SuffixArray, level: SuffixArray) -> SuffixArray:
        """Merge-scan: windows of ``new`` that a level holds are repeated on both sides and leave ``new``."""
        if not len(level) or not len(new):
            return new
        first = np.searchsorted(level.word, new.word, "left")
        last = np.searchsorted(level.word, new.word, "right")
        at, found = first.copy(), np.zeros(len(new), bool)
        open_ = np.flatnonzero(first < last)
        while len(open_):                          # binary search by fingerprint among equal words
            mid = (first[open_] + last[open_]) // 2
            less = level.print[mid] < new.print[open_]
            first[open_[less]] = mid[less] + 1
            last[open_[~less]] = mid[~less]
            done = first[open_] >= last[open_]
            at[open_] = first[open_]
            open_ = open_[~done]
        inside = at < len(level)
        found[inside] = (level.word[at[inside]] == new.word[inside]) & (level.print[at[inside]] == new.print[inside])
        self._settle(new.place[found], level.place[at[found]])
        return SuffixArray(new.word[~found], new.print[~found], new.place[~found])

    def _settle(self, mine, theirs) -> None:
        """Mark pairs of windows that are equal byte by byte."""
        if not self._equal(mine, theirs).all():
            raise RuntimeError("two different windows share their first eight bytes and a 64-bit fingerprint")
        self.repeated[mine] = True
        self.repeated[theirs] = True


def gram_words(text: np.ndarray) -> np.ndarray:
    """The eight bytes at every place as one big-endian number."""
    padded = np.concatenate([text, np.zeros(8, np.uint8)])
    out = np.zeros(len(text), np.uint64)
    for i in range(8):
        out = (out << np.uint64(8)) | padded[i:i + len(text)]
    return out


def _merge(a: SuffixArray, b: SuffixArray) -> SuffixArray:
    word, print_, place = (np.concatenate([getattr(a, x), getattr(b, x)]) for x in ("word", "print", "place"))
    order = np.lexsort((print_, word))
    return SuffixArray(word[order], print_[order], place[order])


SPANS = "key binary, first long, end long"


def _span_rows(owners, counts, repeated, length):
    """Byte spans of runs of repeated windows of each piece."""
    edge = np.zeros(len(repeated), bool)
    starts = np.cumsum(counts) - counts
    edge[starts] = True
    begin = np.flatnonzero(repeated & (edge | ~np.concatenate([[False], repeated[:-1]])))
    stop = np.flatnonzero(repeated & np.concatenate([edge[1:] | ~repeated[1:], [True]]))
    piece = np.searchsorted(starts, begin, "right") - 1
    for p, s, e in zip(piece, begin, stop):
        key, first = owners[p]
        yield key, int(first + s - starts[p]), int(first + e - starts[p] + length)


def _index_task(length: int):
    """Arrow task over the pieces of its anchor strings: the family marks what repeats."""
    def run(batches):
        family, owners, counts = IndexFamily(length), [], []
        first_of: dict = {}                        # piece -> its number; an equal one repeats as a whole
        whole, rows = set(), []
        held: list = []
        held_windows = 0
        for b in batches:
            for key, first, piece in zip(b.column("key").to_pylist(), b.column("first").to_pylist(), b.column("piece").to_pylist()):
                number = first_of.setdefault(piece, len(owners))
                if number < len(owners):
                    rows.append((key, first, first + len(piece)))
                    whole.add(number)
                    if len(rows) >= 50_000:
                        yield _span_batch(rows)
                        rows = []
                    continue
                owners.append((key, first))
                counts.append(len(piece) - length + 1)
                held.append(piece)
                held_windows += counts[-1]
                if held_windows >= BATCH_WINDOWS:
                    family.add(held)
                    held, held_windows = [], 0
        if held:
            family.add(held)
        if not owners:
            return
        rows += [(owners[i][0], owners[i][1], owners[i][1] + counts[i] - 1 + length) for i in whole]
        for r in _span_rows(owners, np.array(counts), family.repeated[:family.windows], length):
            rows.append(r)
            if len(rows) >= 50_000:
                yield _span_batch(rows)
                rows = []
        if rows:
            yield _span_batch(rows)
    return run


def _span_batch(rows):
    key, first, end = zip(*rows)
    return pa.RecordBatch.from_arrays([pa.array(key, pa.binary()), pa.array(first, pa.int64()), pa.array(end, pa.int64())],
                                      names=["key", "first", "end"])


def _window_digests(length: int):
    """Arrow task: 128-bit digest of every window of a distinct piece."""
    def run(batches):
        for b in batches:
            rows: list = []
            for body, piece in zip(b.column("body").to_pylist(), b.column("piece").to_pylist()):
                for i in range(len(piece) - length + 1):
                    rows.append((hashlib.blake2b(piece[i:i + length], digest_size=16).digest(), body, i))
                if len(rows) >= 50_000:
                    yield _digest_batch(rows)
                    rows = []
            if rows:
                yield _digest_batch(rows)
    return run


def _digest_batch(rows):
    d, body, at = zip(*rows)
    return pa.RecordBatch.from_arrays([pa.array(d, pa.binary()), pa.array(body, pa.binary()), pa.array(at, pa.int64())],
                                      names=["digest", "body", "at"])


def _crowded_spans(pieces: DataFrame, length: int) -> DataFrame:
    """Spans of pieces whose anchor string is too common for one task: equal pieces collapse map-side, then the
    windows of the distinct ones are counted by digest."""
    keyed = pieces.withColumn("body", F.unhex(F.md5(F.concat(F.col("mark").cast("string").cast("binary"), F.lit(b":"), "piece"))))
    kinds = written(keyed.groupBy("body").agg(F.first("piece").alias("piece"), F.count(F.lit(1)).alias("n")), "suffix-kinds")
    alone = kinds.where("n = 1")
    windows = kinds.select("body", "piece").mapInArrow(_window_digests(length), "digest binary, body binary, at long")
    twice = windows.groupBy("digest").agg(F.count(F.lit(1)).alias("places")).where("places > 1").select("digest")
    hits = (windows.join(twice, "digest", "left_semi").join(alone.select("body"), "body", "left_semi")
            .select("body", F.col("at").alias("from"), (F.col("at") + length).alias("to")))
    whole = kinds.where("n > 1").select("body", F.lit(0).cast("long").alias("from"), F.length("piece").cast("long").alias("to"))
    members = keyed.select("body", "key", F.col("first").alias("base"))
    return (members.join(hits.unionByName(whole), "body")
            .select("key", (F.col("base") + F.col("from")).alias("first"), (F.col("base") + F.col("to")).alias("end")))


def _cut_text(batches):
    """Arrow task: what stays of each text without its (overlapping) spans."""
    press = zstandard.ZstdDecompressor()
    schema = pa.schema([("key", pa.binary()), ("removed", pa.int64()), ("runs", pa.int64()), ("kept_sha256", pa.string())])
    for b in batches:
        rows = []
        for key, packed, spans in zip(b.column("key").to_pylist(), b.column("packed").to_pylist(), b.column("spans").to_pylist()):
            body, digest, at, removed, runs = press.decompress(packed), hashlib.sha256(), 0, 0, 0
            for s, e in merged((x["first"], x["end"]) for x in spans):
                digest.update(body[at:s])
                removed, runs, at = removed + e - s, runs + 1, e
            digest.update(body[at:])
            rows.append((key, removed, runs, digest.hexdigest()))
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)


def merged(spans):
    """Maximal runs of spans sorted by start; touching ones join."""
    out: list = []
    for s, e in spans:
        if out and s <= out[-1][1]:
            out[-1][1] = max(out[-1][1], e)
        else:
            out.append([s, e])
    return out


# ----------------------------------------------------------------- on Spark

def repeated_spans(texts: DataFrame, length: int = 200, task_pieces: int = 20_000, sample: float = 0.02, known: int = 50_000) -> DataFrame:
    """(key, spans) of texts (key binary, body binary; equal keys mean equal texts): every byte span covered by
    ``length`` bytes that also stand elsewhere in the table.

    ``sample``: share of rows in which at most ``known`` of the most frequent anchor strings are looked up
    beforehand; it decides only which anchors skip the shuffle.  ``task_pieces``: pieces a task should hold."""
    spark = texts.sparkSession
    if length <= GRAM or length > GRAM + 223:
        raise ValueError(f"length must lie between {GRAM + 1} and {GRAM + 223}")
    schema = "mark long, key binary, span long"
    seen = texts.sample(sample, 7).mapInArrow(_marks(length), schema).groupBy("mark").agg(F.count(F.lit(1)).alias("n"))
    common = written(seen.where("n > 1").orderBy(F.desc("n"), "mark").limit(known).select("mark", F.lit(True).alias("common")), "suffix-known")
    marks = texts.mapInArrow(_marks(length), schema).join(F.broadcast(common), "mark", "left")        # at most `known` rows
    marks = written(marks, "suffix-marks")
    rest = marks.where("common is null").withColumn("n", F.count(F.lit(1)).over(Window.partitionBy("mark"))).where("n > 1")
    wanted = (rest.select("key", "mark", "span").unionByName(marks.where("common").select("key", "mark", "span"))
              .groupBy("key").agg(F.collect_set(F.struct("span", "mark")).alias("wanted")))
    packed = texts.mapInArrow(_compress, "key binary, packed binary").groupBy("key").agg(F.first("packed").alias("packed"))
    cut = written(packed.join(wanted, "key").mapInArrow(_cut_pieces(length), "mark long, key binary, first long, piece binary, end long"),
                  "suffix-pieces")
    pieces = cut.where("piece is not null").drop("end")
    total = pieces.count()
    crowds = pieces.groupBy("mark").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > task_pieces).select("mark")
    crowds = written(crowds, "suffix-crowds")
    tasks = max(1, math.ceil(total / task_pieces), min(spark.sparkContext.defaultParallelism, math.ceil(total / 1000)))
    spans = (pieces.join(crowds, "mark", "left_anti").repartition(tasks, "mark").select("key", "first", "piece")
             .mapInArrow(_index_task(length), SPANS)).unionByName(cut.where("piece is null").select("key", "first", "end"))
    if not crowds.isEmpty():
        spans = spans.unionByName(_crowded_spans(pieces.join(crowds, "mark", "left_semi"), length))
    return spans.groupBy("key").agg(F.sort_array(F.collect_set(F.struct("first", "end"))).alias("spans"))


def remove_repeats(docs: DataFrame, length: int = 200, id_col: str = "doc_id", text_col: str = "text", **kw) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256) per row of ``docs``."""
    quoted = lambda c: F.col("`" + c.replace("`", "``") + "`")
    body = F.coalesce(quoted(text_col).cast("string"), F.lit("")).cast("binary")
    rows = docs.select(quoted(id_col).alias("doc_id"), F.unhex(F.md5(body)).alias("key"), body.alias("body"))
    texts = rows.where(F.length("body") >= length).select("key", "body")
    copies = texts.groupBy("key").agg(F.count(F.lit(1)).alias("copies")).where("copies > 1")
    spans = written(repeated_spans(texts, length, **kw), "suffix-spans")
    single = spans.join(copies, "key", "left_anti")
    cut = texts.mapInArrow(_compress, "key binary, packed binary").join(single, "key").mapInArrow(
        _cut_text, "key binary, removed long, runs long, kept_sha256 string")
    narrow = rows.select("doc_id", "key", F.length("body").cast("long").alias("n_bytes"), F.sha2("body", 256).alias("whole"))
    all_gone = F.col("copies").isNotNull()
    return (narrow.join(cut, "key", "left").join(copies, "key", "left")
            .select("doc_id", "n_bytes", F.when(all_gone, F.col("n_bytes")).otherwise(F.coalesce("removed", F.lit(0))).cast("long").alias("n_removed"),
                    F.when(all_gone, 1).otherwise(F.coalesce("runs", F.lit(0))).cast("long").alias("n_spans"),
                    F.when(all_gone, hashlib.sha256().hexdigest()).otherwise(F.coalesce("kept_sha256", "whole")).alias("kept_sha256")))
