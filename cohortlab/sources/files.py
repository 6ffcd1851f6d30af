"""Files: registration with row identity (S1, S2) and CSV export.

Row identity follows file order: files by name, blocks of a file by place, rows
as they stand.  Spark deals blocks to tasks by size, so ids come from the
files' own metadata (path, block start, for parquet the row's index), never
from the order of tasks.
"""

from __future__ import annotations

import os

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cohortlab.functions.columns import ROW_ID, qcol
from cohortlab.functions.sizing import small_side
from cohortlab.session import ensure_checkpoint_dir

ROW_BITS = (1 << 33) - 1          # row-in-partition part of monotonically_increasing_id
# What an unquoted empty field means to the reader: no value.  It differs from a quoted empty
# text, and no text of a file equals it.
MISSING = "\u0000missing\u0000"
BOUNDED_ROWS = 100_000            # up to this many leading rows are cut out by the driver


def stamp_row_ids(df: DataFrame) -> DataFrame:
    """Dense ``_row_id`` (0..n-1) of any DataFrame in partition order, without a single-task window.

    Rows are counted per input partition, the counts (one row per partition) are turned into offsets, and each row gets
    ``offset + row-in-partition``.  An input that went through a shuffle is checkpointed first.  For files use
    ``read_csv`` / ``read_parquet``, which number in file order.
    """
    try:
        shuffled = "Exchange" in df._jdf.queryExecution().executedPlan().toString()
    except Exception:            # plan not inspectable here: fix the rows anyway
        shuffled = True
    if shuffled:
        # rows after a shuffle arrive in no fixed order: fix them first, so
        # that the count pass and the numbering pass see the same partitions
        ensure_checkpoint_dir(df.sparkSession)
        df = df.checkpoint(eager=True)
    base = df.select("*", F.spark_partition_id().alias("_pid"),
                     F.monotonically_increasing_id().alias("_mid"))
    counts = base.groupBy("_pid").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    offsets = small_side(counts.select("_pid", F.coalesce(F.sum("_n").over(before), F.lit(0))
                                       .cast("bigint").alias("_off")))        # one row per input partition
    return (base.join(offsets, "_pid")
            .select(*[qcol(c) for c in df.columns],
                    (F.col("_off") + F.col("_mid").bitwiseAND(F.lit(ROW_BITS))).alias(ROW_ID)))


def _free(name: str, taken: list[str]) -> str:
    low = {c.lower() for c in taken}
    while name.lower() in low:
        name += "_"
    return name


def _clean(f: T.StructField) -> Column:
    c = qcol(f.name)
    return F.when(~F.isnan(c), c).alias(f.name) if isinstance(f.dataType, (T.DoubleType, T.FloatType)) else c


def nan_to_null(df: DataFrame) -> DataFrame:
    """Spark keeps NaN apart from null; the reference treats NaN as missing."""
    return df.select(*[_clean(f) for f in df.schema.fields])


def stamp_file_order(scan: DataFrame, by_index: bool, nrows: int | None = None) -> DataFrame:
    """``scan`` (a file source, unchanged) with NaN as null and a dense ``_row_id`` in file order.

    One pass counts rows per (file, block), cumulated in name and block order; a row's id is its block's offset plus its
    place in the block.  ``by_index``: parquet, where the place in the file is known and only files are
    counted (from footers).  The count table has one row a block.  Should the second pass see other blocks (the
    cluster's size sets Spark's split length), the read fails instead of losing rows.  With ``nrows`` only
    files that hold one of the first rows are read again."""
    meta = scan.metadataColumn("_metadata")
    file, block, place, off = (_free(x, scan.columns) for x in ("_file", "_block", "_place", "_offset"))
    start = F.lit(0).cast("bigint") if by_index else meta.getField("file_block_start")
    at = meta.getField("row_index") if by_index else F.monotonically_increasing_id()
    rows = scan.select(*[_clean(f) for f in scan.schema.fields], meta.getField("file_path").alias(file), start.alias(block), at.alias(place))
    first = F.lit(0).cast("bigint") if by_index else F.min(place)
    counts = rows.groupBy(file, block).agg(F.count(F.lit(1)).alias("n"), first.alias("first"))
    before = Window.orderBy(file, block).rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(file, block, "first", F.coalesce(F.sum("n").over(before), F.lit(0)).cast("bigint").alias(off))
    if nrows is not None:
        offsets = offsets.where(F.col(off) < int(nrows))
        ensure_checkpoint_dir(scan.sparkSession)
        offsets = offsets.checkpoint(eager=True)
        leading = [r[0] for r in offsets.select(file).distinct().limit(1001).collect()]
        if len(leading) <= 1000:
            rows = rows.where(F.col(file).isin(leading))           # prunes the other files
    offsets = small_side(offsets)
    lost = F.raise_error(F.lit("the files were split anew between two passes; read them again")).cast("bigint")
    known = F.col(off) if nrows is not None else F.coalesce(F.col(off), lost)
    out = (rows.join(offsets, [file, block], "left")
           .select(*[qcol(c) for c in scan.columns], (known + F.col(place) - F.col("first")).alias(ROW_ID)))
    return out if nrows is None else out.where(F.col(ROW_ID) < int(nrows))


def dataset_name(path: str) -> str:
    """``df_`` + file stem, as the registration form names datasets."""
    return "df_" + os.path.basename(path).split(".")[0]


# ---------------------------------------------------------------- S1 / S2

def _csv_reader(spark: SparkSession, sep: str, multi_line: bool, schema, empty_as_null: bool):
    reader = (spark.read.option("header", True).option("sep", sep).option("quote", '"').option("escape", '"')
              .option("nullValue", "" if empty_as_null else MISSING).option("emptyValue", "")
              .option("multiLine", multi_line).option("lineSep", "\n").option("mode", "FAILFAST"))
    return reader.schema(schema) if schema is not None else reader.option("inferSchema", True)


def has_line_breaks_in_fields(spark: SparkSession, path: str) -> bool:
    """Is there a line with an odd number of quotes, that is a quoted field that goes on in the next line?  Reads
    the files as lines in parallel and stops at the first."""
    quotes = F.length("value") - F.length(F.replace(F.col("value"), F.lit('"'), F.lit("")))
    return not spark.read.option("lineSep", "\n").text(path).where(quotes % 2 == 1).isEmpty()


def _leading_records(spark: SparkSession, path: str, n: int) -> list[str]:
    """Header and first ``n`` records in file order, from growing numbers of leading lines of one file after
    another; a record ends at a line break outside quotes.  Spark's ``limit`` reads leading blocks only."""
    out: list[str] = []
    header = None
    for f in sorted(spark.read.text(path).inputFiles()):
        want, k = n - max(len(out) - 1, 0) + 1, 0
        while True:
            k = max(2 * k, want + 16)
            lines = [r[0] for r in spark.read.option("lineSep", "\n").text(f).limit(k).collect()]
            records, part, quotes = [], [], 0
            for line in lines:
                part.append(line)
                quotes += line.count('"')
                if quotes % 2 == 0:
                    if len(part) > 1 or line.rstrip("\r"):        # blank lines are no records
                        records.append("\n".join(part))
                    part = []
            if len(records) >= want or len(lines) < k:
                break
        if part and len(lines) < k:
            records.append("\n".join(part))                        # an open quote at the end: the reader reports it
        if records:
            if header is None:
                header = records[0]
                out.append(header)
            out += records[1:want]
        if len(out) > n:
            break
    return out


def read_csv(spark: SparkSession, path: str, nrows: int | None = None,
             schema: T.StructType | str | None = None, sep: str = ",", multi_line: bool | None = None,
             empty_as_null: bool = False) -> DataFrame:
    """Read CSV with header (a file, or a folder of parts), stamp ``_row_id`` in file order (parts by name), keep
    the first ``nrows`` rows when given.

    Quotes inside a quoted field are doubled, and such a field may hold line breaks; a malformed row fails the read.  An
    unquoted empty field is null and a quoted one the empty text, unless ``empty_as_null``.  ``multi_line``:
    whether fields hold line breaks; such a file is read by one task.  Left open, the lines are searched for
    one in parallel first.  Without ``schema`` the reader infers it from all rows read; the first
    ``nrows`` (up to 100,000) are cut from the leading blocks, and types are inferred on those.
    """
    if nrows is not None and 0 < int(nrows) <= BOUNDED_ROWS:
        records = _leading_records(spark, path, int(nrows))
        if records:
            import uuid
            path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/leading-{uuid.uuid4().hex}"
            spark.createDataFrame([(r,) for r in records], "value string").coalesce(1).write.option("lineSep", "\n").text(path)
            multi_line = any("\n" in r for r in records)
    elif multi_line is None:
        multi_line = has_line_breaks_in_fields(spark, path)
    scan = _csv_reader(spark, sep, bool(multi_line), schema, empty_as_null).csv(path)
    out = stamp_file_order(scan, by_index=False)
    return out if nrows is None else out.where(F.col(ROW_ID) < int(nrows))


def read_parquet(spark: SparkSession, path: str, nrows: int | None = None) -> DataFrame:
    """Register a parquet dataset the same way: NaN -> null, ``_row_id`` in file order (parts by name), optional
    first ``nrows`` (only the files that hold them are read)."""
    return stamp_file_order(spark.read.parquet(path), by_index=True, nrows=nrows)


def read_csvs(spark: SparkSession, files: str | list[str], nrows: str | list[int] | None = None,
              base_dir: str = "", schema=None) -> dict[str, DataFrame]:
    """S1 form: ``;``-separated file list and an equal-length row-count list."""
    if isinstance(files, str):
        files = [f for f in files.strip().split(";") if f]
    if nrows is None:
        counts = [None] * len(files)
    else:
        counts = [int(n) for n in (nrows.strip().split(";") if isinstance(nrows, str) else nrows) if str(n)]
    if len(files) != len(counts):
        raise ValueError("file list and row-count list differ in length")
    return {dataset_name(f): read_csv(spark, os.path.join(base_dir, f) if base_dir else f, n, schema)
            for f, n in zip(files, counts)}


# ---------------------------------------------------------------- S5

def export_csv(df: DataFrame, path: str, ordered: bool = False) -> None:
    """CSV with header, ``_row_id`` dropped; ``read_csv`` gives the same rows back: quotes are doubled, blanks
    at the ends of texts stay, the empty text is quoted and null is not.  Written as a directory of parts (never
    funnelled through one task); ``ordered`` range-partitions on ``_row_id`` so parts concatenate in row order."""
    if ordered and ROW_ID in df.columns:
        df = df.repartitionByRange(ROW_ID).sortWithinPartitions(ROW_ID)
    cols = [c for c in df.columns if c != ROW_ID]
    (df.select(*[qcol(c) for c in cols]).write.mode("overwrite").option("header", True).option("quote", '"').option("escape", '"')
     .option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).option("lineSep", "\n").csv(path))
