"""Joins between buildings and points.

Buildings are listed under the grid cells their box covers, on the level that fits their
size, so one to four rows each; a point has one cell per level. A point and a building
meet in exactly one cell, so no pair appears twice.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plotgrid.functions import geometry as g
from plotgrid.functions.hashing import uniform
from plotgrid.operators.filters import Frame, bbox_intersects
from plotgrid.operators.sizes import at_most
from plotgrid.operators.zones import LEVEL_FACTOR, LEVELS, level_of
from plotgrid.session import cut_lineage

CELL = 1 / 1024
POINT_ROWS = 100_000


def _size(level: Column, cell: float) -> Column:
    return F.lit(cell) * F.pow(F.lit(float(LEVEL_FACTOR)), level)


def covered_cells(df: DataFrame, cell: float = CELL) -> DataFrame:
    """One row per grid cell under the row's box, on the level of its size."""
    size = _size(F.col("level"), cell)
    return (
        df.withColumn("level", level_of(F.col("bbox"), cell))
        .withColumn("cx", F.explode(F.sequence(F.floor(F.col("bbox.xmin") / size), F.floor(F.col("bbox.xmax") / size))))
        .withColumn("cy", F.explode(F.sequence(F.floor(F.col("bbox.ymin") / size), F.floor(F.col("bbox.ymax") / size))))
    )


def point_cells(points: DataFrame, cell: float = CELL) -> DataFrame:
    size = _size(F.col("level"), cell)
    return (
        points.withColumn("level", F.explode(F.array(*[F.lit(v) for v in range(LEVELS)])))
        .withColumn("cx", F.floor(F.col("lon") / size)).withColumn("cy", F.floor(F.col("lat") / size))
    )


def _containing(buildings: DataFrame, positions: DataFrame, levels: DataFrame | None = None) -> DataFrame:
    """Rows of ``buildings`` (geometry, bbox and others) beside every position inside.

    ``levels`` lists the levels that occur among the buildings; on the others no position is shuffled.
    """
    keys = ["level", "cx", "cy"]
    placed = point_cells(positions)
    if levels is not None:
        placed = placed.join(F.broadcast(levels), "level", "left_semi")
    # what lies strictly inside a shape lies strictly inside its box
    near = covered_cells(buildings).join(placed, keys).filter(
        (F.col("lon") > F.col("bbox.xmin")) & (F.col("lon") < F.col("bbox.xmax"))
        & (F.col("lat") > F.col("bbox.ymin")) & (F.col("lat") < F.col("bbox.ymax"))
    )
    return near.filter(g.contains(F.col("geometry"), F.col("lon"), F.col("lat"))).drop(*keys)


def occurring_levels(buildings: DataFrame) -> DataFrame:
    """Grid levels of the buildings' boxes, ``LEVELS`` rows at most; reads the boxes alone."""
    return buildings.select(level_of(F.col("bbox"), CELL).alias("level")).filter("level IS NOT NULL").distinct()


def point_in_polygon_counts(points: DataFrame, buildings: DataFrame) -> DataFrame:
    """For every point the number of buildings that strictly contain it, 0 included.

    Equal positions are looked up once. A point list proven small is broadcast and the
    buildings stay where they are; otherwise both sides shuffle by cell (points only on levels that occur), and equal
    buildings are counted together first so that copies cannot multiply.
    """
    positions = points.select("lon", "lat").distinct()
    shapes = buildings.select("geometry", "bbox")
    if at_most(positions, POINT_ROWS):
        found = _containing(shapes.withColumn("n", F.lit(1).cast("bigint")), F.broadcast(positions))
    else:
        found = _containing(shapes.groupBy("geometry", "bbox").agg(F.count("*").alias("n")), positions, occurring_levels(buildings))
    counts = found.groupBy("lon", "lat").agg(F.sum("n").alias("n_buildings"))
    return points.join(counts, ["lon", "lat"], "left").withColumn(
        "n_buildings", F.coalesce("n_buildings", F.lit(0).cast("bigint"))
    )


def containing_pairs(polygons: DataFrame, points: DataFrame) -> DataFrame:
    """Every polygon row beside every point row strictly inside it (columns of both)."""
    return _containing(polygons, points, occurring_levels(polygons))


def containing_polygons(polygons: DataFrame, points: DataFrame) -> DataFrame:
    """Distinct polygons that strictly contain at least one point."""
    positions, levels = points.select("lon", "lat").distinct(), None
    if at_most(positions, POINT_ROWS):
        positions = F.broadcast(positions)
    else:
        levels = occurring_levels(polygons)
    columns = polygons.columns
    return _containing(polygons, positions, levels).select(*columns).distinct()  # copies meet only where a point hits


def first_inner_points(buildings: DataFrame, frame: Frame, n: int) -> DataFrame:
    """Point on surface of valid buildings in a frame, the first ``n`` by lon, lat."""
    inner = bbox_intersects(buildings, frame).filter(g.is_valid(F.col("geometry")))
    return (
        inner.select(g.point_on_surface(F.col("geometry")).alias("p"))
        .select(F.col("p.x").alias("lon"), F.col("p.y").alias("lat"))
        .orderBy("lon", "lat").limit(n)
    )


def points_workload(buildings: DataFrame, frame: Frame, total: int = 10, inside_share: float = 0.3, seed: int = 42) -> DataFrame:
    """Lookup points: some known to be inside buildings, the rest uniform in the frame,
    in a seeded order."""
    spark = buildings.sparkSession
    n_inside = int(total * inside_share)
    minx, miny, maxx, maxy = (float(v) for v in frame)
    inside = first_inner_points(buildings, frame, n_inside)
    key = F.concat(F.lit(f"{seed}:"), F.col("id").cast("string"))
    outside = spark.range(total - n_inside).select(
        (F.lit(minx) + uniform(key, 0) * (maxx - minx)).alias("lon"),
        (F.lit(miny) + uniform(key, 1) * (maxy - miny)).alias("lat"),
    )
    order = F.sha2(F.concat_ws(":", F.lit(seed), "lon", "lat"), 256)
    # One window over the workload itself, whose size is the ``total`` parameter. The rows are written once,
    # since lookups read them several times.
    return cut_lineage(inside.unionByName(outside).select(
        F.row_number().over(Window.orderBy(order)).alias("point_id"), "lon", "lat"
    ), "points-workload")
