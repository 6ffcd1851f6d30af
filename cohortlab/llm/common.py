"""Small helpers shared by the operators of this subpackage."""

from __future__ import annotations

from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def lower_ascii_bytes(text: str | None) -> bytes:
    """UTF-8 bytes with only A-Z lower-cased (other letters keep their case)."""
    return (text or "").encode("utf-8", "surrogatepass").lower()


#: The lowest 0 to 8 bytes of eight.
EIGHT_MASKS = np.array([2 ** (8 * k) - 1 for k in range(9)], dtype=np.uint64)
_ODD = np.uint64(0x9E3779B97F4A7C15)


def mix64(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(29))


def word_bounds(raw: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Byte bounds (starts, ends) of the words ``[^\\x20\\x09-\\x0D]+``."""
    b = np.frombuffer(raw, dtype=np.uint8)
    inside = np.zeros(len(b) + 2, dtype=np.int8)
    inside[1:-1] = (b != 32) & ((b < 9) | (b > 13))
    step = np.diff(inside)
    return np.flatnonzero(step == 1), np.flatnonzero(step == -1)


def word_hashes(raw: bytes, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of every word's bytes, eight at a time; words that have ended drop out."""
    eights = np.ndarray((len(raw) + 1,), dtype="<u8", buffer=raw + bytes(8), strides=(1,))
    size = ends - starts
    h = mix64((size.astype(np.uint64) * _ODD) ^ (eights[starts] & EIGHT_MASKS[np.minimum(size, 8)]) * _ODD)
    rest, done = np.flatnonzero(size > 8), 8
    while len(rest):
        at, left = starts[rest] + done, size[rest] - done
        h[rest] = mix64((h[rest] ^ eights[at] & EIGHT_MASKS[np.minimum(left, 8)]) * _ODD)
        rest, done = rest[left > 8], done + 8
    return h


#: Most rows and bytes of an Arrow batch between Spark and Python.
ARROW_ROWS, ARROW_BYTES = 1000, 4 << 20


def small_batches(spark: SparkSession) -> None:
    """Let the session hand rows to Python in batches of at most ``ARROW_ROWS`` rows and ``ARROW_BYTES`` bytes: what an
    executor and its Python workers hold outside the heap grows with the batch.  Lower settings stay as they are."""
    for name, most in (("maxRecordsPerBatch", ARROW_ROWS), ("maxBytesPerBatch", ARROW_BYTES)):
        key = f"spark.sql.execution.arrow.{name}"
        now = str(spark.conf.get(key)).rstrip("bB")
        if not now.isdigit() or not 0 < int(now) <= most:
            spark.conf.set(key, str(most))


def slices(batches, rows: int = 1000):
    """Arrow batches in pieces of at most ``rows`` rows, so that a worker's Python objects are those of one piece."""
    for b in batches:
        for at in range(0, b.num_rows, rows):
            yield b.slice(at, rows)


def map_rows(df: DataFrame, cols: list[str], schema: str, make_row_fn) -> DataFrame:
    """Row-wise map in Arrow batches.  ``make_row_fn()`` runs once per task (it
    loads models or vocabularies) and returns ``f(*values) -> tuple`` in the
    order of ``schema``.  Only ``cols`` reach Python; memory is one batch."""
    from pyspark.sql.types import StructType
    from pyspark.sql.pandas.types import to_arrow_schema
    out = to_arrow_schema(StructType.fromDDL(schema))
    names = list(out.names)

    def run(batches):
        fn = make_row_fn()
        for b in slices(batches):
            columns = [b.column(i).to_pylist() for i in range(b.num_columns)]
            rows = [fn(*v) for v in zip(*columns)]
            if rows:
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, type=out.field(i).type) for i, c in enumerate(zip(*rows))], names=names)

    return df.select(*cols).mapInArrow(run, schema)


def flat_map_rows(df: DataFrame, cols: list[str], schema: str, make_rows_fn, chunk: int = 50_000) -> DataFrame:
    """As ``map_rows`` but each row gives any number of rows; output is cut
    into batches of about ``chunk`` rows, so a very long text stays bounded."""
    from pyspark.sql.types import StructType
    from pyspark.sql.pandas.types import to_arrow_schema
    out = to_arrow_schema(StructType.fromDDL(schema))

    def pack(rows):
        return pa.RecordBatch.from_arrays(
            [pa.array(c, type=out.field(i).type) for i, c in enumerate(zip(*rows))], names=list(out.names))

    def run(batches):
        fn, rows = make_rows_fn(), []
        for b in slices(batches):
            columns = [b.column(i).to_pylist() for i in range(b.num_columns)]
            for v in zip(*columns):
                for r in fn(*v):
                    rows.append(r)
                    if len(rows) >= chunk:
                        yield pack(rows)
                        rows = []
        if rows:
            yield pack(rows)

    return df.select(*cols).mapInArrow(run, schema)


def materialise(df: DataFrame) -> DataFrame:
    """Reliable checkpoint in the shared folder (cuts lineage, survives lost executors)."""
    from cohortlab.session import ensure_checkpoint_dir
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder below the cluster's shared checkpoint folder."""
    import uuid
    from cohortlab.session import ensure_checkpoint_dir
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


_TRACKED: list[list[str]] = []                # folders of each open ``tracked_folders``


@contextmanager
def tracked_folders():
    """Collects the folders that ``written`` makes inside the block."""
    _TRACKED.append([])
    try:
        yield _TRACKED[-1]
    finally:
        _TRACKED.pop()


def remove_folders(spark: SparkSession, paths: list[str]) -> None:
    """Delete folders through Hadoop, on whatever file system they lie."""
    for path in paths:
        p = spark._jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def written(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as a compressed Parquet table in the shared folder and read it back."""
    path = shared_folder(df.sparkSession, name)
    for folders in _TRACKED:
        folders.append(path)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def min_label_components(edges: DataFrame, max_rounds: int = 50) -> DataFrame:
    """Connected components by alternating large-star and small-star steps.

    ``edges``: (a, b).  Returns (node, component) for nodes that have an edge;
    ``component`` is the smallest node reachable.  Stars shrink the edge list
    to one edge a node, in about log(n) rounds, without collecting a group.
    """
    e = materialise(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
                    .where("u <> v").distinct())
    for _ in range(max_rounds):
        both = e.union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        # every larger neighbour of u links to the smallest node around u
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        small_min = large.groupBy("u").agg(F.min("v").alias("m"))
        small = (large.join(small_min, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
                 .union(small_min.select("u", F.col("m").alias("v"))).where("u <> v")
                 .select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
        nxt = materialise(small)
        same = nxt.count() == e.count() and nxt.join(e, ["u", "v"], "left_anti").isEmpty()
        e = nxt
        if same:
            break
    else:
        raise RuntimeError("components did not settle")
    roots = e.select(F.col("v").alias("node")).distinct().select("node", F.col("node").alias("component"))
    return e.select(F.col("u").alias("node"), F.col("v").alias("component")).union(roots).distinct()
