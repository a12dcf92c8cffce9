"""Scans, grid aggregation and ordered queries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plotgrid.functions import geometry as g
from plotgrid.operators.filters import Frame, bbox_intersects
from plotgrid.operators.ranking import with_row_number


def row_count(df: DataFrame) -> DataFrame:
    """COUNT(*) without reading any column."""
    return df.agg(F.count("*").alias("row_count"))


def grid_aggregate(df: DataFrame, cell: float = 0.01) -> DataFrame:
    """Valid buildings per centroid cell, most populated first.

    Map-side partial counts leave one row per cell and task to shuffle, so a crowded cell
    costs nothing extra.
    """
    center = df.select(g.checked_measures(F.col("geometry")).alias("m")).filter("m.valid")
    return (
        center.select(
            F.floor(F.col("m.cy") / cell).cast("double").alias("lat_cell"),
            F.floor(F.col("m.cx") / cell).cast("double").alias("lng_cell"),
        )
        .groupBy("lat_cell", "lng_cell")
        .agg(F.count("*").alias("building_count"))
        .orderBy(F.desc("building_count"))
    )


def ordered_range_query(df: DataFrame, frame: Frame, limit: int = 1000) -> DataFrame:
    """First rows of a frame by building id, NULLs last, ties by external id."""
    return (
        bbox_intersects(df, frame)
        .orderBy(F.asc_nulls_last("building_id"), F.asc("external_id"))
        .limit(limit)
    )


def count_by(df: DataFrame, key: str, name: str = "building_count") -> DataFrame:
    return df.groupBy(key).agg(F.count("*").alias(name)).orderBy(F.desc(name), F.asc(key))


def cycle_rows(df: DataFrame, lead: list[str], rest: list[str], n: int) -> DataFrame:
    """Repeat an ordered list of rows until there are exactly ``n`` (a request list).

    Copies are generated next to each row, so the list itself may be distributed.
    """
    numbered = with_row_number(df, lead, rest, "_at")
    total = df.agg(F.count("*").alias("_total"))
    spread = numbered.crossJoin(F.broadcast(total)).filter(F.col("_at") < n)
    copies = F.floor((F.lit(n - 1) - F.col("_at")) / F.col("_total"))
    return (
        spread.withColumn("_copy", F.explode(F.sequence(F.lit(0).cast("bigint"), copies)))
        .withColumn("request_id", F.col("_at") + F.col("_copy") * F.col("_total"))
        .drop("_at", "_copy", "_total")
    )
