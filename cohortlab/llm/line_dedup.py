"""Line dedup with content-defined chunks over pieces of lines (operator 1).

Pieces: a line's words are hashed, and a piece starts before a word whose hash
is the smallest within ``RADIUS`` words on both sides in that line, and at each
line start; a piece that stays long is cut every ``STEP`` words.  So the cuts inside a repeated passage follow its words, wherever
in a line it begins or ends.

Passages: from every piece on, the fewest consecutive pieces that have
``RUN_WORDS`` words together are one unit, named by a rolling hash over its
words.  A unit that stands earlier in the table (smaller doc_id, then text
hash, then position) is cut.  Units overlap, so of a repeated passage only the
words before its first and after its last cut stay, and nothing goes but what
one earlier place of the input holds as a whole (which may overlap it, as in
words repeated with a period).

Chunks: a chunk of lines ends after a line where the rolling hash of the last
``ROLL`` line hashes is 0 modulo ``DIVISOR`` if the chunk has two lines, and on
both sides of a line with at least ``long_words`` words.  A chunk with at least
two lines, or ``long_words`` words, stays only at its first place.  Only chunks
with fewer than ``RUN_WORDS`` words are units of their own: longer ones are
covered by the passages.

Places are found by 64-bit keys alone.  The bytes of repeated units (words
joined by one blank; chunks as they stand) are then
compared by grouping (key, bytes), which combines copies map-side; a key with
more than one body is resolved by its bytes.  Texts cross the shuffle
compressed.

Blank lines go with the line before.  Null texts stay null, an emptied text
becomes ''.  Rows without doc_id stay unchanged.  Rows equal in doc_id and text
are one place and are cut alike; other rows that share a doc_id are places of their own.
An empty table gives an empty table.  Other columns pass through, whatever their names.
"""

from __future__ import annotations

import hashlib
import re
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortlab.llm.common import EIGHT_MASKS, mix64, slices, word_bounds, word_hashes, written

ROLL = 2
DIVISOR = 2
KEY_BYTES = 8
LONG_WORDS = 40
RADIUS = 4
RUN_WORDS = 16
#: A piece of more than two steps is cut on every STEP words; words repeated with a period up to RADIUS fall into phase.
STEP = 12
#: Texts are cut into units together, about this many bytes at a time, so that short texts cost their bytes.
GROUP_BYTES = 1 << 18
#: Bodies longer than this cross shuffles compressed.
PACK_BYTES = 256
_BLANK = b" \t\n\x0b\f\r"
_ODD, _BACK = 0x9E3779B97F4A7C15, pow(0x9E3779B97F4A7C15, -1, 2 ** 64)
KEPT_POWERS = 1 << 17
_KEPT: dict[int, np.ndarray] = {}
_LINES = re.compile(r"[^\n]*\n|[^\n]+")


def chunks_of(text: str, long_words: int = LONG_WORDS) -> list[str]:
    """Cut a text into chunks of whole lines; joined they give the text again."""
    out, cur, lines, hashes, before_long = [], [], 0, [], False
    for line in _LINES.findall(text):
        if not line.strip():
            cur.append(line)
            continue
        is_long = len(line.split()) >= long_words
        if cur and (before_long or is_long or lines >= 2 and _cut(hashes)):
            out.append("".join(cur))
            cur, lines = [], 0
        cur.append(line)
        lines += 1
        hashes.append(zlib.crc32(line.strip().encode("utf-8", "surrogatepass")))
        before_long = is_long
    if cur:
        out.append("".join(cur))
    return out


def _cut(hashes: list[int]) -> bool:
    h = 0
    for x in hashes[-ROLL:]:
        h = (h * 0x01000193 + x) & 0xFFFFFFFF
    return (h ^ (h >> 15)) % DIVISOR == 0


def _body(chunk: str) -> str:
    return chunk.strip("\r\n \t")


def _counts(chunk: str, long_words: int) -> bool:
    body = _body(chunk)
    return sum(bool(x.strip()) for x in body.split("\n")) >= 2 or len(body.split()) >= long_words


def _key(body: bytes, key_bytes: int) -> int:
    return int.from_bytes(hashlib.sha256(body).digest()[:key_bytes], "big", signed=True)


def _powers(base: int, n: int) -> np.ndarray:
    """base ** 0 ... base ** (n - 1) modulo 2 ** 64; those of usual texts are kept."""
    kept = _KEPT.get(base)
    if kept is not None and n <= len(kept):
        return kept[:n]
    out = np.full(max(n, KEPT_POWERS), base, dtype=np.uint64)
    out[0] = 1
    out = np.cumprod(out, dtype=np.uint64)
    _KEPT.setdefault(base, out[:KEPT_POWERS].copy())
    return out[:n]


def pieces_of(raw: bytes):
    """(starts, ends, first, line, hashes) of a text's words and pieces: byte bounds of
    each word, the first word of each piece, the line and the hash of each word."""
    b = np.frombuffer(raw, dtype=np.uint8)
    starts, ends = word_bounds(raw)
    line = np.searchsorted(np.flatnonzero(b == 10), starts)
    n = len(starts)
    if not n:
        return starts, ends, starts, line, starts.astype(np.uint64)
    hashes = word_hashes(raw, starts, ends)
    new_line = np.concatenate(([True], line[1:] != line[:-1]))
    # a word's hash, from its last eight bytes
    h = np.ndarray((len(raw) + 1,), dtype=">u8", buffer=bytes(8) + raw, strides=(1,))[ends].astype(np.uint64)
    h &= EIGHT_MASKS[np.minimum(ends - starts, 8)]
    h *= np.uint64(0x9E3779B97F4A7C15)
    h ^= h >> np.uint64(29)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h = (h >> np.uint64(32)) + np.uint64(1)
    # zeros between the lines: no cut within RADIUS words of a line's ends
    at = np.arange(n) + RADIUS * np.cumsum(new_line)
    wide = np.zeros(at[-1] + RADIUS + 1, dtype=np.uint64)
    wide[at] = h
    cut = np.ones(n, dtype=bool)
    for k in range(1, RADIUS + 1):
        cut &= (h < wide[at - k]) & (h <= wide[at + k])
    first = np.flatnonzero(cut | new_line)
    after = np.append(first[1:], n)
    long = np.flatnonzero(after - first > 2 * STEP)
    if len(long):
        more = [np.arange(first[i] + STEP, after[i] - STEP + 1, STEP) for i in long]
        first = np.sort(np.concatenate([first, *more]))
    return starts, ends, first, line, hashes


def units_of(raw: bytes, long_words: int = LONG_WORDS, key_bytes: int = KEY_BYTES):
    """(start, end, key) arrays of every unit of a text: byte bounds and 64-bit names."""
    return units_of_texts(raw + b"\n", np.array([0, len(raw) + 1]), long_words, key_bytes)[1:]


def units_of_texts(raw: bytes, bounds: np.ndarray, long_words: int = LONG_WORDS, key_bytes: int = KEY_BYTES):
    """(text, start, end, key) arrays of the units of several texts; text i is ``raw[bounds[i]:bounds[i + 1] - 1]`` and
    a line end follows it.  No unit crosses texts, start and end count from the text's first byte."""
    starts, ends, first, line, hashes = pieces_of(raw)
    n = len(starts)
    words = np.searchsorted(starts, bounds)
    of = np.repeat(np.arange(len(bounds) - 1), np.diff(words))
    stops = np.append(first, n)
    stop = np.searchsorted(stops, first + RUN_WORDS)
    z = stops[np.minimum(stop, len(first))]
    whole = (stop < len(stops)) & (z <= words[of[first] + 1])
    a, z = first[whole], z[whole]
    sums = np.zeros(n + 1, dtype=np.uint64)
    np.cumsum(hashes * _powers(_ODD, n), out=sums[1:])
    keys = mix64((sums[z] - sums[a]) * _powers(_BACK, n)[a]) if len(a) else np.zeros(0, dtype=np.uint64)
    keys = (keys >> np.uint64(64 - 8 * key_bytes) if key_bytes else keys * np.uint64(0)).view(np.int64)
    text = of[a]
    s, e = (starts[a] - bounds[text], ends[z - 1] - bounds[text]) if len(a) else (a, z)
    size = np.bincount(line)
    size = size[size > 0]
    at = of[np.cumsum(size) - size]           # the text of each line with words
    low = (size[1:] + size[:-1] < RUN_WORDS) & (at[1:] == at[:-1])
    short = range(len(bounds) - 1) if long_words < RUN_WORDS else np.unique(at[1:][low]).tolist()
    more = [(i, *u) for i in short for u in _short_chunks(raw[bounds[i]:bounds[i + 1] - 1], long_words, key_bytes)]
    if more:
        text, s, e, keys = (np.concatenate([c, np.array(m, dtype=np.int64)]) for c, m in zip((text, s, e, keys), zip(*more)))
    return text, s, e, keys


def _short_chunks(raw: bytes, long_words: int, key_bytes: int):
    pos = 0
    for c in chunks_of(raw.decode("utf-8", "surrogatepass"), long_words):
        z = c.encode("utf-8", "surrogatepass")
        if len(z.split()) < RUN_WORDS and _counts(c, long_words):
            body = _body(c).encode("utf-8", "surrogatepass")
            lead = len(z) - len(z.lstrip(b"\r\n \t"))
            yield pos + lead, pos + lead + len(body), _key(body, key_bytes)
        pos += len(z)


def _unit_body(piece: bytes) -> bytes:
    words = piece.split()
    return b" ".join(words) if len(words) >= RUN_WORDS else piece


def unit_table(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", long_words: int = LONG_WORDS,
               key_bytes: int = KEY_BYTES) -> DataFrame:
    """(doc, row, at, end, key) of every unit; ``row`` is a hash of the whole text."""
    src = (docs.where(F.col(id_col).isNotNull() & F.col(text_col).isNotNull())
           .select(F.col(id_col).cast("long").alias("doc"), F.xxhash64(text_col).alias("row"), F.col(text_col).alias("text")))
    names = ["doc", "row", "at", "end", "key"]

    def run(batches):
        for b in batches:
            doc, row = b.column(0).to_numpy(), b.column(1).to_numpy()
            size = pc.binary_length(b.column(2)).to_numpy().astype(np.int64) + 1
            # texts that have GROUP_BYTES together are one step
            group = (np.cumsum(size) - size) // GROUP_BYTES
            cuts = np.concatenate(([0], np.flatnonzero(np.diff(group)) + 1, [len(size)])) if len(size) else [0]
            for i, j in zip(cuts[:-1], cuts[1:]):
                raw = b"\n".join([*b.column(2).slice(i, j - i).cast(pa.binary()).to_pylist(), b""])
                text, s, e, k = units_of_texts(raw, np.concatenate(([0], np.cumsum(size[i:j]))), long_words, key_bytes)
                if len(k):
                    yield pa.RecordBatch.from_arrays([pa.array(doc[i:j][text]), pa.array(row[i:j][text]), pa.array(s.astype(np.int32)),
                                                      pa.array(e.astype(np.int32)), pa.array(k)], names=names)
    return src.mapInArrow(run, "doc long, row long, at int, end int, key long")


def repeated_places(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", long_words: int = LONG_WORDS,
                    key_bytes: int = KEY_BYTES) -> DataFrame:
    """(doc, row, at, end, key, later) of every unit whose key occurs several times;
    ``later`` is null in the first document, which tells by its own places."""
    slim = written(unit_table(docs, id_col, text_col, long_words, key_bytes), "line-units")
    again = (slim.groupBy("key").agg(F.min("doc").alias("first"), F.count("*").alias("n"))
             .where("n > 1").select("key", "first"))
    later = F.when(F.col("doc") > F.col("first"), F.lit(True))
    return written(slim.join(again, "key").select("doc", "row", "at", "end", "key", later.alias("later")), "line-places")


def _places(batch, at: int):
    """Per row of a batch its places, of the list column ``at``, as tuples (row, at, end, key, later)."""
    lists = batch.column(at)
    bounds = lists.offsets.to_numpy()
    flat = lists.flatten()
    rows = list(zip(*[flat.field(c).to_numpy().tolist() for c in ("row", "at", "end", "key")], flat.field("later").to_pylist()))
    bounds = (bounds - bounds[0]).tolist()
    return [rows[i:j] for i, j in zip(bounds[:-1], bounds[1:])]


def _gone(places, of_row: int) -> list[tuple[int, int]]:
    """Byte bounds that go from the text of hash ``of_row``."""
    first: dict = {}
    for row, at, _, key, later in places:
        if later is None:
            first[key] = min(first.get(key, (row, at)), (row, at))
    return sorted((at, end) for row, at, end, key, later in places
                  if row == of_row and (later or later is None and (row, at) > first[key]))


def _cut_text(raw: bytes, gone: list[tuple[int, int]]) -> str:
    """The text ``raw`` without the bytes of ``gone`` (sorted) and the blanks they leave."""
    n, runs = len(raw), []
    for s, e in gone:
        while s < e and raw[s] in _BLANK:
            s += 1
        if s >= e:
            continue
        after = e
        while after < n and raw[after] in _BLANK:
            after += 1
        if runs and s <= runs[-1][2]:
            if e > runs[-1][1]:
                runs[-1][1:] = [e, after]
        else:
            runs.append([s, e, after])
    out, pos = [], 0
    for s, e, after in runs:
        before = s
        while before and raw[before - 1] in _BLANK:
            before -= 1
        if before and b"\n" not in raw[before:s] and (after == n or b"\n" in raw[e:after]):
            # the line keeps its beginning, so also its end
            s, after = before, e
        out.append(raw[pos:s])
        pos = after
    out.append(raw[pos:])
    left = b"".join(out).decode("utf-8", "surrogatepass")
    return left.rstrip("\r\n") if left.strip() else ""


def _mark(docs: DataFrame, places: DataFrame, id_col: str) -> DataFrame:
    """``docs`` with the list of its places as ``places``."""
    lists = places.groupBy(F.col("doc").alias("of")).agg(F.collect_list(F.struct("row", "at", "end", "key", "later")).alias("places"))
    return docs.join(lists, F.col(id_col).cast("long") == F.col("of"), "left").drop("of")


def marked_bodies(marked: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(doc, row, at, end, key, body) of the marked units; long bodies compressed."""
    def run(batches):
        small, large = zstandard.ZstdCompressor(level=3), zstandard.ZstdDecompressor()
        for b in slices(batches):
            docs, packed, of = b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist()
            out = []
            for doc, z, of_row, places in zip(docs, packed, of, _places(b, 3)):
                raw = large.decompress(z)
                for row, at, end, key, _ in places:
                    if row == of_row:
                        body = _unit_body(raw[at:end])
                        out.append((doc, row, at, end, key, b"z" + small.compress(body) if len(body) > PACK_BYTES else b"r" + body))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), types)], names=["doc", "row", "at", "end", "key", "body"])
    types = [pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.binary()]
    src = marked.where(F.col("places").isNotNull() & F.col(text_col).isNotNull())
    return src.select(F.col(id_col).cast("long"), text_col, "row", "places").mapInArrow(run, "doc long, row long, at int, end int, key long, body binary")


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                long_words: int = LONG_WORDS, key_bytes: int = KEY_BYTES) -> DataFrame:
    """``docs`` with repeated passages cut from the text, same columns, same rows."""
    names = docs.columns
    at_text = names.index(text_col)
    # plain names inside, whatever the columns are called
    inner = [f"c{i}" for i in range(len(names))]
    plain = docs.toDF(*inner)
    the_id, the_text = inner[names.index(id_col)], inner[at_text]
    schema = ", ".join(f"{c} {f.dataType.simpleString()}" for c, f in zip(inner, docs.schema.fields))
    packed_schema = ", ".join(f"{c} {'binary' if c == the_text else f.dataType.simpleString()}"
                              for c, f in zip(inner, docs.schema.fields)) + ", row long"

    # only the text is touched: the other columns pass as they are
    def pack(batches):
        small = zstandard.ZstdCompressor(level=3)
        for b in slices(batches):
            texts = [None if t is None else small.compress(t) for t in b.column(at_text).cast(pa.binary()).to_pylist()]
            columns = [pa.array(texts, pa.binary()) if i == at_text else c for i, c in enumerate(b.columns)]
            yield pa.RecordBatch.from_arrays(columns, names=[*inner, "row"])

    def cut(batches):
        large = zstandard.ZstdDecompressor()
        for b in slices(batches):
            texts = []
            for z, of_row, places in zip(b.column(at_text).to_pylist(), b.column(len(inner)).to_pylist(), _places(b, len(inner) + 1)):
                raw = None if z is None else large.decompress(z)
                gone = _gone(places, of_row) if places and raw is not None else None
                texts.append(_cut_text(raw, gone) if gone else raw)
            columns = [pa.array(texts, pa.string()) if i == at_text else c for i, c in enumerate(b.columns[:len(inner)])]
            yield pa.RecordBatch.from_arrays(columns, names=inner)
    places = repeated_places(plain, the_id, the_text, long_words, key_bytes)
    # the texts cross one shuffle, to meet their places; both later passes read the table written here
    packed = plain.select(*inner, F.xxhash64(the_text).alias("row")).mapInArrow(pack, packed_schema)
    marked = written(_mark(packed, places, the_id), "line-marked")
    bodies = marked_bodies(marked, the_id, the_text)
    # the byte comparison: one row per distinct body, then keys that name more than one
    mixed = written(bodies.select("key", "body").distinct().groupBy("key").count().where("count > 1").select("key"), "line-mixed")
    if not mixed.isEmpty():
        told = written(bodies.join(mixed, "key", "left_semi"), "line-told")
        place = F.struct("doc", "row", "at")
        first = told.groupBy("key", "body").agg(F.min(place).alias("first"))
        apart = (told.join(first, ["key", "body"])
                 .select("doc", "row", "at", "end", "key", (place > F.col("first")).alias("later")).distinct())
        marked = _mark(marked.drop("places"), places.join(mixed, "key", "left_anti").select(*apart.columns).union(apart), the_id)
    return marked.select(*inner, "row", "places").mapInArrow(cut, schema).toDF(*names)
