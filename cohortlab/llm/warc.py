"""Deterministic sharded WARC writer and its reader (operator 4).

Records are dealt to shards by ranges of (page_id, digest) whose bounds come
from exact running byte totals over the sorted records, so that shards hold
about equal bytes however the ids lie, and the archive follows from the table
alone, not from the cluster.  Payloads cross one shuffle, by shard; what is a
revisit is decided on a table without payloads, whose marks sort before their
records.  Only records equal in id and payload must share a shard.  One task
sorts a shard and writes it as gzip members, one a record.  A file rolls
when its compressed size passes ``roll_bytes``.  Headers (lengths, digests,
record ids) are made anew from the payload; there is no clock or random
value, so a rerun writes the same bytes.

Commit: a task writes under a temporary name and renames when a file is
whole; a lost task's rerun replaces its files with equal ones.  Only files in
the manifest (a Parquet table that Spark commits last) belong to the archive.
The reader compares each file's bytes, digest and number of records with the
manifest and raises an error where a file is damaged, cut or missing.

Equal payloads of at least ``min_revisit`` bytes: the smallest page_id is the
response, later ones revisit it.  Rows that repeat this smallest id are
responses too.  Null html is an empty payload.  Null ids sort first, are
written as records without id, and come back as null.  An empty table gives
an empty manifest and no records; extra columns are ignored.
"""

from __future__ import annotations

import bisect
import gzip
import hashlib
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortlab.functions.running import running_sum
from cohortlab.functions.sizing import small_side
from cohortlab.llm.common import shared_folder, written

SHARD_BYTES = 16 << 20
#: Beyond this number of shards they grow instead.
MAX_SHARDS = 20_000
#: Counted for the header of a record.
HEAD_BYTES = 400
ROLL_BYTES = 64 << 20
MIN_REVISIT = 100
READ_BLOCK = 1 << 20
MANIFEST = "file string, records long, bytes long, sha256 string"
RECORD = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, url string, payload binary"


def open_store(folder: str):
    """(filesystem, path) of a folder named by URI or plain path."""
    folder = re.sub(r"^file:/+", "/", folder)
    return pafs.FileSystem.from_uri(folder) if "://" in folder else (pafs.LocalFileSystem(), folder)


def make_record(page_id, url, kind: str, refers, digest: str, size: int, payload: bytes) -> bytes:
    """One record; the block of a revisit is empty."""
    body = payload if kind == "response" else b""
    clean = re.sub(r"[\r\n]+", " ", url or "")
    head = [("WARC-Type", kind), ("WARC-Record-ID", f"<urn:page:{'' if page_id is None else page_id}>"),
            ("WARC-Target-URI", clean), ("WARC-Payload-Digest", f"sha256:{digest}"),
            ("WARC-Block-Digest", f"sha256:{hashlib.sha256(body).hexdigest()}")]
    if kind == "revisit":
        head += [("WARC-Refers-To", f"<urn:page:{refers}>"), ("X-Payload-Length", str(size))]
    head += [("Content-Type", "text/html; charset=utf-8"), ("Content-Length", str(len(body)))]
    return b"WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in head).encode() + b"\r\n" + body + b"\r\n\r\n"


def _keyed(pages: DataFrame) -> DataFrame:
    """(page_id, url, payload, payload_bytes, payload_digest) of every page."""
    p = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", F.coalesce(F.col("html"), F.lit("")).cast("binary").alias("payload"))
    return p.select("*", F.octet_length("payload").cast("long").alias("payload_bytes"), F.sha2("payload", 256).alias("payload_digest"))


def revisit_marks(slim: DataFrame, min_revisit: int = MIN_REVISIT) -> DataFrame:
    """(page_id, payload_digest, refers_to) of the records that revisit another.  The first ids of repeated
    payloads are broadcast up to a checked number of rows."""
    big = slim.where(F.col("payload_bytes") >= min_revisit)
    first = (big.groupBy("payload_digest").agg(F.min("page_id").alias("refers_to"), F.count(F.lit(1)).alias("n"))
             .where("n > 1").select("payload_digest", "refers_to"))
    return (big.join(small_side(first, 100_000), "payload_digest").where(F.col("page_id") > F.col("refers_to"))
            .select("page_id", "payload_digest", "refers_to").distinct())


def shard_bounds(slim: DataFrame, shard_bytes: int) -> list[tuple]:
    """First (page_id, digest) of every shard, in order; at most ``MAX_SHARDS`` + 1, whatever the table's size."""
    groups = (slim.groupBy(F.struct("page_id", "payload_digest").alias("at"))
              .agg(F.sum(F.col("payload_bytes") + HEAD_BYTES).alias("size")))
    total = groups.agg(F.coalesce(F.sum("size"), F.lit(0))).first()[0]
    target = max(shard_bytes, -(-total // MAX_SHARDS))
    if total <= target:
        return [(None, "")]
    shard = F.floor((F.col("cum_size") - F.col("size")) / F.lit(target))
    firsts = running_sum(groups, [], "at", ["size"]).groupBy(shard.alias("shard")).agg(F.min("at").alias("at"))
    return [(r["at"]["page_id"], r["at"]["payload_digest"]) for r in firsts.orderBy("shard").collect()]


def shard_number(bounds: list[tuple]):
    """Column function (page_id, digest) -> number of the shard whose range holds them; null ids come first."""
    low = -2 ** 63
    keys = [(low if i is None else i, i is not None, d) for i, d in bounds]
    ids = np.array([k[0] for k in keys], dtype=np.int64)

    @F.arrow_udf("int")
    def number(page_id: pa.Array, digest: pa.Array) -> pa.Array:
        at = page_id.fill_null(low).to_numpy(zero_copy_only=False).astype(np.int64)
        out = np.maximum(np.searchsorted(ids, at, side="right") - 1, 0)
        # ids that a bound names: the digest decides
        for i in np.flatnonzero(ids[out] == at).tolist():
            out[i] = max(0, bisect.bisect_right(keys, (int(at[i]), page_id[i].is_valid, digest[i].as_py())) - 1)
        return pa.array(out.astype(np.int32))
    return number


def write_archive(pages: DataFrame, folder: str, shard_bytes: int = SHARD_BYTES, roll_bytes: int = ROLL_BYTES,
                  min_revisit: int = MIN_REVISIT) -> DataFrame:
    """Write all pages; returns the committed manifest (one row a file)."""
    spark = pages.sparkSession
    keyed = _keyed(pages)
    slim = written(keyed.select("page_id", "payload_bytes", "payload_digest"), "warc-slim")
    bounds = shard_bounds(slim, shard_bytes)
    shard = shard_number(bounds)("page_id", "payload_digest").alias("shard")
    none = F.lit(None)
    records = keyed.select(shard, "page_id", "payload_digest", F.lit(1).alias("tag"), "url", "payload", none.cast("long").alias("refers_to"))
    marks = revisit_marks(slim, min_revisit).select(shard, "page_id", "payload_digest", F.lit(0).alias("tag"), none.cast("string").alias("url"),
                                                    none.cast("binary").alias("payload"), "refers_to")
    records = (records.union(marks).repartitionById(len(bounds), F.col("shard"))
               .sortWithinPartitions("shard", F.col("page_id").asc_nulls_first(), "payload_digest", "tag", "url"))

    def run(batches: Iterator[pa.RecordBatch]):
        store, root = open_store(folder)
        store.create_dir(root, recursive=True)
        sink = name = marked = None
        shard_now, roll, n, size, digest, done = None, 0, 0, 0, None, []

        def close():
            sink.close()
            store.move(f"{root}/{name}.tmp-{mark}", f"{root}/{name}")
            done.append((name, n, size, digest.hexdigest()))
        from pyspark import TaskContext
        mark = TaskContext.get().taskAttemptId()
        for b in batches:
            for r in zip(*[b.column(i).to_pylist() for i in range(b.num_columns)]):
                sh, page_id, sha, tag, url, payload, first_id = r
                if not tag:
                    marked = page_id, sha, first_id
                    continue
                refers = marked[2] if marked and marked[:2] == (page_id, sha) else None
                kind = "response" if refers is None else "revisit"
                if sink and (sh != shard_now or size >= roll_bytes):
                    close()
                    sink, roll = None, roll + 1 if sh == shard_now else 0
                if sink is None:
                    roll = roll if sh == shard_now else 0
                    shard_now, n, size, digest = sh, 0, 0, hashlib.sha256()
                    name = f"shard-{sh:06d}-{roll:05d}.warc.gz"
                    sink = store.open_output_stream(f"{root}/{name}.tmp-{mark}", compression=None)
                member = gzip.compress(make_record(page_id, url, kind, refers, sha, len(payload), payload), 6, mtime=0)
                sink.write(member)
                digest.update(member)
                n, size = n + 1, size + len(member)
        if sink:
            close()
        if done:
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*done)], names=["file", "records", "bytes", "sha256"])

    records.mapInArrow(run, MANIFEST).write.parquet(f"{folder}/_manifest")
    return spark.read.schema(MANIFEST).parquet(f"{folder}/_manifest")


class _Measured:
    """A stream that keeps the length and digest of what was read."""

    def __init__(self, stream):
        self.stream, self.size, self.digest = stream, 0, hashlib.sha256()

    def read(self, n: int) -> bytes:
        raw = self.stream.read(n)
        self.size += len(raw)
        self.digest.update(raw)
        return raw


def read_records(stream) -> Iterator[tuple]:
    """Records of one archive stream, read in blocks; digests are checked, and a stream that ends inside a record is an error."""
    parts, gz = [], zlib.decompressobj(31)
    raw, open_member = stream.read(READ_BLOCK), False
    while raw:
        parts.append(gz.decompress(raw))
        open_member = not gz.eof
        if open_member:
            raw = stream.read(READ_BLOCK)
            continue
        raw = gz.unused_data or stream.read(READ_BLOCK)
        gz = zlib.decompressobj(31)
        buf, parts = b"".join(parts), []
        head, _, rest = buf.partition(b"\r\n\r\n")
        h = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
        body = rest[:int(h["Content-Length"])]
        if h["WARC-Block-Digest"] != f"sha256:{hashlib.sha256(body).hexdigest()}":
            raise ValueError(f"damaged record {h['WARC-Record-ID']}")
        ident = lambda s: int(v) if (v := s[len("<urn:page:"):-1]) else None
        revisit = h["WARC-Type"] == "revisit"
        yield (ident(h["WARC-Record-ID"]), int(h["X-Payload-Length"]) if revisit else len(body),
               h["WARC-Payload-Digest"].removeprefix("sha256:"), h["WARC-Type"],
               ident(h["WARC-Refers-To"]) if revisit else None, h["WARC-Target-URI"], body)
    if open_member:
        raise ValueError("the archive ends inside a record")


def read_archive(spark: SparkSession, folder: str, with_payload: bool = True) -> DataFrame:
    """Records of the committed files, one task a few files; every file must be as the manifest says."""
    files = spark.read.schema(MANIFEST).parquet(f"{folder}/_manifest")
    n = max(1, spark.sparkContext.defaultParallelism)
    schema = RECORD if with_payload else RECORD.removesuffix(", payload binary")
    fields = [f.split(" ")[0] for f in schema.split(", ")]

    def run(batches):
        store, root = open_store(folder)
        for b in batches:
            for name, *listed in zip(*[b.column(i).to_pylist() for i in range(b.num_columns)]):
                rows, held, n = [], 0, 0
                with store.open_input_stream(f"{root}/{name}", compression=None) as s:
                    measured = _Measured(s)
                    for r in read_records(measured):
                        rows.append(r[:len(fields)])
                        held, n = held + len(r[-1]), n + 1
                        if held > 16 << 20 or len(rows) >= 10_000:
                            yield _batch(rows, fields)
                            rows, held = [], 0
                if [n, measured.size, measured.digest.hexdigest()] != listed:
                    raise ValueError(f"{name} is not the file of the manifest")
                if rows:
                    yield _batch(rows, fields)
    return files.repartition(n, "file").mapInArrow(run, schema)


def _batch(rows, fields):
    kinds = {"page_id": pa.int64(), "payload_bytes": pa.int64(), "refers_to": pa.int64(), "payload": pa.binary()}
    return pa.RecordBatch.from_arrays([pa.array(c, type=kinds.get(f, pa.string())) for f, c in zip(fields, zip(*rows))], names=fields)


def round_trip(pages: DataFrame) -> DataFrame:
    """Write the pages to a new archive in the shared folder and read it back."""
    folder = shared_folder(pages.sparkSession, "warc")
    write_archive(pages, folder)
    return read_archive(pages.sparkSession, folder, with_payload=False).drop("url")
