"""Linework queries of the catalog."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plotgrid.functions import geometry as g
from plotgrid.operators import coverage
from plotgrid.operators import filters as f
from plotgrid.operators import polygonize as pz
from plotgrid.plans import fixtures as fx
from plotgrid.plans.registry import query

BLOCKS = "WITH b AS (SELECT o_orderkey AS k, 1.0::DOUBLE / 4194304 AS s2 FROM orders)"


def _named(polygons: DataFrame) -> DataFrame:
    """Block number and area of each polygon."""
    k = F.floor(F.col("bbox.xmin") * 1024) + 4096 * F.floor(F.col("bbox.ymin") * 1024)
    return polygons.select(k.alias("k"), g.area(F.col("geometry")).alias("area"))


@query("g22_polygonize", f"""{BLOCKS}
SELECT k, s2 / 4 AS area FROM b, range(4) t(i) WHERE k % 3 = 0
UNION ALL SELECT k, s2 / 2 FROM b, range(2) t(i) WHERE k % 3 = 1
UNION ALL SELECT k, s2 / 4 FROM b WHERE k % 3 = 2
UNION ALL SELECT k, 3 * s2 / 4 FROM b WHERE k % 3 = 2""")
def polygonize(spark, sf_dir):
    return _named(pz.polygonize(f.keep_layers(fx.linework(spark, sf_dir), f.LINE_LAYERS)))


@query("t5_building_polygons", f"""{BLOCKS}
SELECT k, CASE WHEN k % 3 = 1 THEN s2 / 2 ELSE s2 / 4 END AS area FROM b WHERE k % 2 = 0""")
def building_polygons(spark, sf_dir):
    return _named(pz.building_polygons(fx.linework(spark, sf_dir)))


@query("a11_union_lines", f"""{BLOCKS} SELECT k, CAST(CASE k % 3 WHEN 0 THEN 13 WHEN 1 THEN 5 ELSE 8 END AS BIGINT) AS pieces FROM b""")
def union_lines(spark, sf_dir):
    lines = f.keep_layers(fx.linework(spark, sf_dir), f.LINE_LAYERS)
    pieces = pz.split_segments(pz.line_segments(lines))
    k = F.floor(F.col("x0") * 1024) + 4096 * F.floor(F.least("y0", "y1") * 1024)
    return pieces.groupBy(k.alias("k")).agg(F.count("*").alias("pieces"))


@query("a11_union_areas", f"""{BLOCKS}, u AS (SELECT k, s2 / 64 AS unit FROM b)
SELECT k, unit * CASE k % 4 WHEN 0 THEN 28 WHEN 1 THEN 32 WHEN 2 THEN 48 ELSE 16 END AS area,
  CAST(CASE k % 4 WHEN 2 THEN 2 ELSE 1 END AS INT) AS rings FROM u
UNION ALL SELECT k, unit * CASE k % 4 WHEN 2 THEN 4 ELSE 16 END, CAST(1 AS INT) FROM u WHERE k % 4 > 1""")
def union_areas(spark, sf_dir):
    united = coverage.union_areas(fx.touching_areas(spark, sf_dir))
    k = F.floor(F.col("bbox.xmin") * 1024) + 4096 * F.floor(F.col("bbox.ymin") * 1024)
    return united.select(k.alias("k"), g.area(F.col("geometry")).alias("area"), F.size(F.col("geometry")[0]).alias("rings"))
