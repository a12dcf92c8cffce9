"""Size checks in front of every broadcast."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BROADCAST_ROWS = 200_000
BROADCAST_ITEMS = 1_000_000


def at_most(df: DataFrame, rows: int) -> bool:
    """Whether the frame has at most ``rows`` rows; stops reading one row past that."""
    return df.limit(rows + 1).count() <= rows


def broadcast_if_small(
    df: DataFrame, rows: int = BROADCAST_ROWS, weight: Column | None = None, total: int = BROADCAST_ITEMS
) -> DataFrame:
    """Mark a frame for broadcast when counts prove it small, else leave it to a shuffle
    join (adaptive execution splits skewed partitions there).

    For frames with arrays, ``weight`` is a row's number of array items; their sum must
    stay within ``total`` as well.
    """
    if not at_most(df, rows):
        return df
    if weight is not None and (df.agg(F.sum(weight)).first()[0] or 0) > total:
        return df
    return F.broadcast(df)


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """Give a small scan at least as many partitions as there are cores.

    One small file arrives as one partition, which would leave all later work to one
    core. A scan that already has enough partitions is returned as it is, with no shuffle.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores, *keys) if df.rdd.getNumPartitions() < cores else df
