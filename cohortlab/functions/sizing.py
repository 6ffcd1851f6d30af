"""Size-checked broadcasts for small tables derived from the data."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortlab.session import ensure_checkpoint_dir

# Broadcast bound for derived tables (rows); a few tens of bytes per row.
MAX_BROADCAST_ROWS = 1_000_000


def small_side(df: DataFrame, max_rows: int = MAX_BROADCAST_ROWS) -> DataFrame:
    """Materialise a small derived table (one row per label, split or input
    partition) with a reliable checkpoint, count it, and broadcast it only
    when it has at most ``max_rows`` rows.  Beyond that it is returned
    without a hint, so the join shuffles and AQE splits skewed partitions.
    """
    ensure_checkpoint_dir(df.sparkSession)
    m = df.checkpoint(eager=True)
    return F.broadcast(m) if m.count() <= max_rows else m
