"""Bounding-box, attribute, area and validity filters.

A frame filter always states the comparison on ``bbox`` fields first: those reach the
parquet scan and skip row groups, and only areas over the frame's border are tested
exactly.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.observation import Observation

from plotgrid.functions import geometry as g

# Named frames as (min_lon, min_lat, max_lon, max_lat).
NEIGHBORHOOD = (10.38, 63.42, 10.41, 63.44)
TRONDHEIM = (10.10, 63.27, 10.73, 63.52)
TRONDELAG = (9.00, 62.30, 15.50, 65.20)
NORWAY = (4.0, 57.9, 31.3, 71.2)
OSLO = (10.40, 59.70, 10.95, 60.10)

Frame = tuple[float, float, float, float]


def bbox_intersects(df: DataFrame, frame: Frame) -> DataFrame:
    """Rows whose geometry shares a point with the frame (touching counts)."""
    minx, miny, maxx, maxy = (float(v) for v in frame)
    near = df.filter(
        (F.col("bbox.xmin") <= maxx) & (F.col("bbox.xmax") >= minx)
        & (F.col("bbox.ymin") <= maxy) & (F.col("bbox.ymax") >= miny)
    )
    return near.filter(g.intersects_box(F.col("geometry"), F.col("bbox"), g.box(*frame)))


def bbox_filter(df: DataFrame, frame: Frame, min_area: float = 10.0, epsg: int = 25832) -> DataFrame:
    """Frame filter plus a least projected area; appends ``area`` in square meters."""
    return (
        bbox_intersects(df, frame)
        .withColumn("area", g.area(F.col("geometry"), 4326, epsg))
        .filter(F.col("area") > min_area)
    )


def bbox_filter_advanced(
    df: DataFrame, frame: Frame, low: float = 50.0, high: float = 5000.0, epsg: int = 25833
) -> DataFrame:
    """Count, mean area and perimeter range of valid buildings of medium size in a frame."""
    measured = (
        bbox_intersects(df, frame)
        .withColumn("m", g.checked_measures(F.col("geometry"), 4326, epsg))
        .filter(F.col("m.valid") & F.col("m.area").between(low, high))
    )
    return area_stats(measured, F.col("m.area"), F.col("m.perimeter"))


def area_stats(df: DataFrame, area: Column, perimeter: Column) -> DataFrame:
    return df.agg(
        F.count("*").alias("building_count"),
        F.avg(area).alias("avg_area"),
        F.min(perimeter).alias("min_perimeter"),
        F.max(perimeter).alias("max_perimeter"),
    )


def compound_filter(df: DataFrame, frame: Frame, source: str = "osm") -> DataFrame:
    return bbox_intersects(df.filter(F.col("source") == source), frame)


def keep_valid(df: DataFrame, dropped: Observation | None = None) -> DataFrame:
    """Drop invalid geometry. With an ``Observation``, its ``dropped`` metric holds the
    number of removed rows once the frame has run, at no extra pass."""
    flagged = df.withColumn("_valid", g.is_valid(F.col("geometry")))
    if dropped is not None:
        flagged = flagged.observe(dropped, F.count_if(~F.col("_valid")).alias("dropped"))
    return flagged.filter(F.col("_valid")).drop("_valid")


def keep_ids(df: DataFrame, ids: DataFrame, column: str, id_column: str) -> DataFrame:
    """Rows whose key is in the id table; an empty id table keeps nothing."""
    keys = ids.select(F.col(id_column).alias(column)).filter(F.col(column).isNotNull())
    return df.join(keys, column, "left_semi")


# Names of the linework and point layers.
LINE_LAYERS = ("Takkant", "FiktivBygningsavgrensning", "Bygningsdelelinje")
POINT_LAYERS = ("Bygning", "AnnenBygning")


def keep_layers(df: DataFrame, layers: tuple[str, ...], geometry: str = "geometry") -> DataFrame:
    return df.filter(F.col("layer").isin(*layers) & F.col(geometry).isNotNull())


def null_split(pairs: DataFrame) -> DataFrame:
    """How many id pairs lack the second, the first, or neither id."""
    return pairs.agg(
        F.count_if(F.col("fkb_id").isNull()).alias("osm_only"),
        F.count_if(F.col("osm_id").isNull()).alias("fkb_only"),
        F.count_if(F.col("fkb_id").isNotNull() & F.col("osm_id").isNotNull()).alias("overlapping"),
    )


def first_regions(df: DataFrame, regions: DataFrame, limit: int | None) -> DataFrame:
    """Keep the rows of the first ``limit`` regions by id; None keeps all."""
    if limit is None:
        return df
    wanted = regions.select("region").distinct().orderBy("region").limit(limit)
    return df.join(F.broadcast(wanted) if limit <= 100_000 else wanted, "region", "left_semi")
