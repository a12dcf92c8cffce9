"""Building, zone, point and sample tables derived from the order and event tables.

Coordinates are fractions of powers of two, so additions and products on them are exact
and can be compared bit by bit with another engine.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from plotgrid.functions import geometry as g
from plotgrid.functions import wkb
from plotgrid.operators.sizes import spread


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def rectangles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One rectangle per order: key, attributes, lower-left corner, width and height."""
    k = F.col("k")
    return (
        table(spark, sf_dir, "orders").select(F.col("o_orderkey").cast("bigint").alias("k"))
        .select(
            "k",
            F.concat(F.lit("o"), k.cast("string")).alias("external_id"),
            F.expr("CASE WHEN k % 3 = 0 THEN NULL ELSE CAST(k div 2 AS INT) END").alias("building_id"),
            F.expr("CASE WHEN (k div 16) % 2 = 0 THEN 'osm' ELSE 'fkb' END").alias("source"),
            F.expr("lpad(CAST(1 + k % 15 AS STRING), 2, '0')").alias("region"),
            F.expr("CASE WHEN k % 5 = 0 THEN 'yes' WHEN k % 5 = 1 THEN 'garage' ELSE 'house' END").alias("building_type"),
            F.expr(
                "CASE WHEN k % 16 = 1 THEN 10.375D + ((k * 7919) % 4093) / 65536D "
                "ELSE 10D + ((k * 7919) % 4093) / 4096D END"
            ).alias("minx"),
            F.expr(
                "CASE WHEN k % 16 = 1 THEN 63.40625D + ((k * 104729) % 4091) / 65536D "
                "WHEN k % 4 = 0 THEN 59.5D + ((k * 104729) % 4091) / 4096D "
                "ELSE 63D + ((k * 104729) % 4091) / 4096D END"
            ).alias("miny"),
            F.expr("(1 + k % 7) / 16384D").alias("w"),
            F.expr("(1 + k % 5) / 16384D").alias("h"),
        )
    )


def _shape(df: DataFrame, geometry: Column) -> DataFrame:
    x, y, w, h = (F.col(c) for c in ("minx", "miny", "w", "h"))
    return spread(df, "k").withColumns({"geometry": geometry, "bbox": g.box(x, y, x + w, y + h)})  # shapes are made after any shuffle


def buildings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rectangular buildings with geometry and covering box."""
    x, y, w, h = (F.col(c) for c in ("minx", "miny", "w", "h"))
    return _shape(rectangles(spark, sf_dir), g.rectangle(x, y, x + w, y + h)).drop("minx", "miny", "w", "h")


def shapes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Triangles, L shapes and rectangles with a hole, by key modulo 3."""
    x, y, w, h = (F.col(c) for c in ("minx", "miny", "w", "h"))
    k = F.col("k")
    triangle = g.polygon([(x, y), (x + w, y), (x, y + h), (x, y)])
    ell = g.polygon([
        (x, y), (x + w, y), (x + w, y + h / 2), (x + w / 2, y + h / 2), (x + w / 2, y + h), (x, y + h), (x, y),
    ])
    holed = g.polygon(
        [(x, y), (x + w, y), (x + w, y + h), (x, y + h), (x, y)],
        [
            (x + w / 4, y + h / 4), (x + w / 4, y + 3 * h / 4), (x + 3 * w / 4, y + 3 * h / 4),
            (x + 3 * w / 4, y + h / 4), (x + w / 4, y + h / 4),
        ],
    )
    return _shape(
        rectangles(spark, sf_dir), F.when(k % 3 == 0, triangle).when(k % 3 == 1, ell).otherwise(holed)
    )


def flawed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shapes where every fifth class is broken: bow tie, open ring, flat ring, stray hole."""
    x, y, w, h = (F.col(c) for c in ("minx", "miny", "w", "h"))
    bow_tie = g.polygon([(x, y), (x + w, y + h), (x + w, y), (x, y + h), (x, y)])
    opened = g.polygon([(x, y), (x + w, y), (x + w, y + h), (x, y + h)])
    flat = g.polygon([(x, y), (x + w, y), (x, y)])
    stray = g.polygon(
        [(x, y), (x + w, y), (x + w, y + h), (x, y + h), (x, y)],
        [(x + 2 * w, y), (x + 2 * w, y + h), (x + 3 * w, y + h), (x + 3 * w, y), (x + 2 * w, y)],
    )
    k = F.col("k")
    return shapes(spark, sf_dir).withColumn(
        "geometry",
        F.when(k % 11 == 1, bow_tie).when(k % 11 == 4, opened).when(k % 11 == 6, flat)
        .when(k % 11 == 9, stray).otherwise(F.col("geometry")),
    )


def fkb(spark: SparkSession, sf_dir: str) -> DataFrame:
    return buildings(spark, sf_dir).filter("k % 8 <> 7")


def osm(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Second source: same buildings moved east by 0 to 3 eighths of their width."""
    shifted = rectangles(spark, sf_dir).filter("k % 8 <> 6").withColumn(
        "minx", F.col("minx") + (F.col("k") % 4) * F.col("w") / 8
    ).withColumn("external_id", F.concat(F.lit("s"), F.col("k").cast("string")))
    x, y, w, h = (F.col(c) for c in ("minx", "miny", "w", "h"))
    return _shape(shifted, g.rectangle(x, y, x + w, y + h)).drop("minx", "miny", "w", "h")


# The zones of the join fixture, as lists of rings per region.
ZONE_SHAPES: dict[str, list[list[tuple[float, float]]]] = {
    "01": [[(10.0, 63.0), (10.5, 63.0), (10.5, 63.25), (10.25, 63.25), (10.25, 63.5), (10.0, 63.5), (10.0, 63.0)]],
    "02": [[(10.25, 63.25), (10.5, 63.25), (10.5, 63.5), (10.25, 63.5), (10.25, 63.25)]],
    "03": [[(10.0, 63.5), (10.5, 63.5), (10.0, 64.0), (10.0, 63.5)]],
    "04": [[(10.5, 63.5), (10.5, 64.0), (10.0, 64.0), (10.5, 63.5)]],
    "05": [[(10.5, 63.0), (11.0, 63.0), (11.0, 63.75), (10.75, 63.75), (10.75, 63.25), (10.5, 63.25), (10.5, 63.0)]],
    "06": [[(10.5, 63.25), (10.75, 63.25), (10.75, 64.0), (10.5, 64.0), (10.5, 63.25)]],
    "07": [[(10.75, 63.75), (11.0, 63.75), (11.0, 64.0), (10.75, 64.0), (10.75, 63.75)]],
    "08": [[(10.0, 59.5), (10.625, 59.5), (10.0, 60.125), (10.0, 59.5)]],
    "09": [[(10.625, 59.5), (11.0, 59.5), (11.0, 60.5), (10.625, 60.5), (10.625, 59.5)]],
    "10": [[(10.625, 59.5), (10.625, 60.125), (10.0, 60.125), (10.625, 59.5)]],
    "11": [[(10.0, 60.125), (10.625, 60.125), (10.625, 60.5), (10.0, 60.5), (10.0, 60.125)]],
    "12": [[(10.375, 63.40625), (10.4375, 63.40625), (10.40625, 63.46875), (10.375, 63.40625)]],
    "13": [[(10.001953125, 63.001953125), (10.0029296875, 63.001953125), (10.001953125, 63.0029296875), (10.001953125, 63.001953125)]],
    "14": [[(10.75, 59.75), (10.875, 59.75), (10.875, 59.875), (10.75, 59.875), (10.75, 59.75)]],
    "15": [[(20.0, 70.0), (21.0, 70.0), (20.0, 71.0), (20.0, 70.0)]],
}

# The same zones as convex pieces, for checks by separating axes.
ZONE_PIECES: list[tuple[str, list[tuple[float, float]]]] = [
    (region, piece)
    for region, rings in ZONE_SHAPES.items()
    for piece in {
        "01": [
            [(10.0, 63.0), (10.5, 63.0), (10.5, 63.25), (10.0, 63.25)],
            [(10.0, 63.25), (10.25, 63.25), (10.25, 63.5), (10.0, 63.5)],
        ],
        "05": [
            [(10.5, 63.0), (11.0, 63.0), (11.0, 63.25), (10.5, 63.25)],
            [(10.75, 63.25), (11.0, 63.25), (11.0, 63.75), (10.75, 63.75)],
        ],
    }.get(region, [rings[0][:-1]])
]


def zones(spark: SparkSession) -> DataFrame:
    """Regions as polygons (a fixed small table, like county borders)."""
    shapes_of = wkb.from_lists([[[np.array(ring, float) for ring in rings]] for rings in ZONE_SHAPES.values()])
    local = pa.table({"region": list(ZONE_SHAPES), "geometry": shapes_of})
    return spark.createDataFrame(local, f"region string, geometry {g.GEOMETRY}").withColumn(
        "bbox", g.bounds(F.col("geometry"))
    )


def query_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A point of every building: center, corner or outside, by key modulo 3."""
    k = F.col("k")
    return rectangles(spark, sf_dir).select(
        k.alias("point_id"),
        F.when(k % 3 == 0, F.col("minx") + F.col("w") / 2).when(k % 3 == 1, F.col("minx"))
        .otherwise(F.col("minx") + 5.0).alias("lon"),
        F.when(k % 3 == 0, F.col("miny") + F.col("h") / 2).otherwise(F.col("miny")).alias("lat"),
    )


def metric_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as a metric time series."""
    return table(spark, sf_dir, "events").select(
        F.col("event_id").cast("bigint").alias("event_id"),
        F.col("user_id").cast("bigint").alias("resource"),
        F.col("event_type").alias("metric"), F.col("ts"),
        F.col("value").alias("average"),
        F.expr("CASE WHEN event_id % 3 = 0 THEN NULL ELSE value * 2 END").alias("total"),
        F.expr("CASE WHEN event_id % 7 = 0 THEN NULL ELSE value / 2 END").alias("minimum"),
        (F.col("value") * 4).alias("maximum"),
    )


def linework(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Building drawings, one block per order on a lattice, lines not cut where they meet.

    Modulo 3: a square with two middle lines and a dead end; a square with a diagonal; a
    square with a separate square inside joined by nothing. Even keys also have a building
    point in the lower left (inside the inner square for the last kind).
    """
    k = F.col("k")
    s = 1 / 2048
    blocks = table(spark, sf_dir, "orders").select(F.col("o_orderkey").cast("bigint").alias("k")).withColumns({
        "x": (k % 4096) / 1024, "y": F.floor(k / 4096) / 1024,
    })
    x, y = F.col("x"), F.col("y")

    def line(*points):
        return F.array(*[g.point(x + dx * s, y + dy * s) for dx, dy in points])

    square = line((0, 0), (1, 0), (1, 1), (0, 1), (0, 0))
    middle = F.array(square, line((0.5, 0), (0.5, 1.25)), line((0, 0.5), (1, 0.5)))
    diagonal = F.array(square, line((0, 0), (1, 1)), line((0, 0), (0, 1)))
    nested = F.array(square, line((0.25, 0.25), (0.75, 0.25), (0.75, 0.75), (0.25, 0.75), (0.25, 0.25)))
    lines = blocks.select(
        "k", F.posexplode(F.when(k % 3 == 0, middle).when(k % 3 == 1, diagonal).otherwise(nested)).alias("i", "geometry")
    ).select(
        "k", F.when(F.col("i") == 0, "Takkant").when(F.col("i") == 1, "Bygningsdelelinje")
        .otherwise("FiktivBygningsavgrensning").alias("layer"), "geometry",
    )
    marks = blocks.filter(k % 2 == 0).select(
        "k", F.when(k % 4 == 0, "Bygning").otherwise("AnnenBygning").alias("layer"),
        F.when(k % 3 == 2, line((0.5, 0.5))).otherwise(line((0.375, 0.25))).alias("geometry"),
    )
    other = blocks.filter(k % 5 == 0).select("k", F.lit("Veg").alias("layer"), line((-0.5, 0.3), (1.5, 0.3)).alias("geometry"))
    return lines.unionByName(marks).unionByName(other)


def touching_areas(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Areas of buildings that meet, one block per order on the lattice of ``linework``, in eighths of a block.

    Modulo 4: two squares that overlap; two with a common edge; a frame of four bars with a square in its
    middle; two squares with a common corner, one of them listed twice.
    """
    k = F.col("k")
    blocks = table(spark, sf_dir, "orders").select(F.col("o_orderkey").cast("bigint").alias("k"))
    x, y, s = (k % 4096) / 1024, F.floor(k / 4096) / 1024, 1 / 16384

    def boxes(*corners):
        return F.array(*[g.rectangle(x + a * s, y + b * s, x + c * s, y + d * s) for a, b, c, d in corners])

    kinds = [
        boxes((0, 0, 4, 4), (2, 2, 6, 6)), boxes((0, 0, 4, 4), (4, 0, 8, 4)),
        boxes((0, 0, 8, 2), (0, 6, 8, 8), (0, 2, 2, 6), (6, 2, 8, 6), (3, 3, 5, 5)), boxes((0, 0, 4, 4), (4, 4, 8, 8), (4, 4, 8, 8)),
    ]
    chosen = F.when(k % 4 == 0, kinds[0]).when(k % 4 == 1, kinds[1]).when(k % 4 == 2, kinds[2]).otherwise(kinds[3])
    return blocks.select("k", F.explode(chosen).alias("geometry"))
