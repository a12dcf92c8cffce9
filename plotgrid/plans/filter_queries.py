"""Scans, filters, aggregates and ordered queries of the catalog."""

from __future__ import annotations

from pyspark.sql import functions as F

from plotgrid.functions import geometry as g
from plotgrid.operators import aggregates as agg
from plotgrid.operators import dataset as ds
from plotgrid.operators import filters as f
from plotgrid.plans import fixtures as fx
from plotgrid.plans import reference_sql as ref
from plotgrid.plans.registry import query
from plotgrid.session import scratch_folder
from plotgrid.sources import layout

RECT = f"WITH {ref.RECT}"


@query("s3_db_scan_count", "SELECT count(*) AS row_count FROM lineitem")
def db_scan_count(spark, sf_dir):
    return agg.row_count(fx.table(spark, sf_dir, "lineitem"))


@query("a1_count_buildings", f"{RECT} SELECT count(*) AS row_count FROM rect")
def count_buildings(spark, sf_dir):
    return agg.row_count(fx.buildings(spark, sf_dir))


@query("f1_bbox_intersects", f"{RECT} SELECT external_id FROM rect WHERE {ref.overlaps(f.TRONDHEIM)}")
def bbox_intersects(spark, sf_dir):
    return f.bbox_intersects(fx.buildings(spark, sf_dir), f.TRONDHEIM).select("external_id")


@query("f1_written_layout", f"{RECT} SELECT external_id, region FROM rect WHERE {ref.overlaps(f.TRONDHEIM)}")
def written_layout(spark, sf_dir):
    """The box filter over a written release, where it reaches the parquet scan."""
    root = scratch_folder(spark, "boxes")
    layout.write_buildings(ds.with_partition_key(fx.buildings(spark, sf_dir)), root, "2026-04-02.0", "small")
    rows = layout.decoded(layout.scan_buildings(spark, root, "2026-04-02.0", "small"))
    return f.bbox_intersects(rows, f.TRONDHEIM).select("external_id", "region")


SHAPE_FRAME = (10.25, 63.125, 10.625, 63.625)
# A shape meets the frame when an edge clipped to the frame is not empty or when it holds
# the frame; the frame is far larger than any shape, so only the first case can occur.
SHAPE_IN_FRAME = f"""WITH {ref.RECT}, {ref.SHAPE_POINTS}, {ref.SHAPE_EDGES},
clipped AS (
  SELECT k,
    greatest(0, CASE WHEN x1 = x0 THEN CASE WHEN x0 BETWEEN 10.25 AND 10.625 THEN 0 ELSE 2 END
      ELSE least((10.25 - x0) / (x1 - x0), (10.625 - x0) / (x1 - x0)) END,
      CASE WHEN y1 = y0 THEN CASE WHEN y0 BETWEEN 63.125 AND 63.625 THEN 0 ELSE 2 END
      ELSE least((63.125 - y0) / (y1 - y0), (63.625 - y0) / (y1 - y0)) END) AS enter_at,
    least(1, CASE WHEN x1 = x0 THEN 1 ELSE greatest((10.25 - x0) / (x1 - x0), (10.625 - x0) / (x1 - x0)) END,
      CASE WHEN y1 = y0 THEN 1 ELSE greatest((63.125 - y0) / (y1 - y0), (63.625 - y0) / (y1 - y0)) END) AS leave_at
  FROM edges)
SELECT DISTINCT k FROM clipped WHERE enter_at <= leave_at"""


@query("f1_shapes_intersect_frame", SHAPE_IN_FRAME)
def shapes_in_frame(spark, sf_dir):
    return f.bbox_intersects(fx.shapes(spark, sf_dir), SHAPE_FRAME).select("k")


def _bbox_check(frame) -> str:
    return f"""WITH {ref.RECT}, {ref.rect_measures(25832)}
SELECT r.external_id, r.source, round(m.area, 2) AS area FROM rect r JOIN m ON m.k = r.k
WHERE {ref.overlaps(frame, 'r.')} AND m.area > 10"""


def _bbox_query(name, frame):
    @query(name, _bbox_check(frame))
    def run(spark, sf_dir):
        found = f.bbox_filter(fx.buildings(spark, sf_dir), frame)
        return found.select("external_id", "source", F.round("area", 2).alias("area"))

    return run


_bbox_query("f2_bbox_filter_simple", f.OSLO)
_bbox_query("f3_bbox_filter_neighborhood", f.NEIGHBORHOOD)
_bbox_query("f3_bbox_filter_municipality", f.TRONDHEIM)
_bbox_query("f3_bbox_filter_county", f.TRONDELAG)


@query("f4_bbox_filter_advanced", f"""WITH {ref.RECT}, {ref.rect_measures(25833)}
SELECT count(*) AS building_count, round(avg(area), 4) AS avg_area,
  round(min(perimeter), 4) AS min_perimeter, round(max(perimeter), 4) AS max_perimeter
FROM rect r JOIN m ON m.k = r.k WHERE {ref.overlaps(f.OSLO, 'r.')} AND m.area BETWEEN 50 AND 5000""")
def bbox_filter_advanced(spark, sf_dir):
    stats = f.bbox_filter_advanced(fx.buildings(spark, sf_dir), f.OSLO)
    return stats.select("building_count", *[
        F.round(c, 4).alias(c) for c in ("avg_area", "min_perimeter", "max_perimeter")
    ])


@query("f5_compound_filter", f"""{RECT} SELECT external_id, building_id, region FROM rect
WHERE source = 'osm' AND {ref.overlaps(f.NEIGHBORHOOD)}""")
def compound_filter(spark, sf_dir):
    found = f.compound_filter(fx.buildings(spark, sf_dir), f.NEIGHBORHOOD)
    return found.select("external_id", "building_id", "region")


@query("f6_keep_valid", f"{RECT} SELECT k FROM rect WHERE k % 11 NOT IN (1, 4, 6, 9)")
def keep_valid(spark, sf_dir):
    return f.keep_valid(fx.flawed(spark, sf_dir)).select("k")


@query("f7_keep_ids", f"""{RECT} SELECT external_id, source FROM rect
WHERE external_id IN (SELECT 'o' || o_orderkey FROM orders WHERE o_orderpriority = '5-LOW')""")
def keep_ids(spark, sf_dir):
    ids = fx.table(spark, sf_dir, "orders").filter("o_orderpriority = '5-LOW'").select(
        F.concat(F.lit("o"), F.col("o_orderkey").cast("string")).alias("id")
    )
    return f.keep_ids(fx.buildings(spark, sf_dir), ids, "external_id", "id").select("external_id", "source")


@query("f8_keep_layers", f"""{RECT}
SELECT k, CASE k % 5 WHEN 0 THEN 'Takkant' ELSE 'Bygningsdelelinje' END AS layer
FROM rect WHERE k % 5 IN (0, 3) AND k % 7 <> 0""")
def keep_layers(spark, sf_dir):
    k = F.col("k")
    lines = fx.buildings(spark, sf_dir).select(
        "k",
        F.when(k % 5 == 0, "Takkant").when(k % 5 == 1, "Bygning").when(k % 5 == 2, "Annet")
        .when(k % 5 == 3, "Bygningsdelelinje").otherwise("Veg").alias("layer"),
        F.when(k % 7 != 0, F.col("geometry")).alias("geometry"),
    )
    return f.keep_layers(lines, f.LINE_LAYERS).select("k", "layer")


@query("f11_first_regions", f"""{RECT} SELECT region, count(*) AS n FROM rect
WHERE region IN (SELECT DISTINCT region FROM rect ORDER BY region LIMIT 4) GROUP BY region""")
def first_regions(spark, sf_dir):
    b = fx.buildings(spark, sf_dir)
    return f.first_regions(b, b, 4).groupBy("region").agg(F.count("*").alias("n"))


@query("a2_area_stats", f"""{RECT} SELECT count(*) AS building_count, round(avg(w * h * 1e9), 6) AS avg_area,
min(2 * (w + h)) AS min_perimeter, max(2 * (w + h)) AS max_perimeter FROM rect""")
def area_stats(spark, sf_dir):
    m = fx.buildings(spark, sf_dir).select(g.measures(F.col("geometry")).alias("m"))
    stats = f.area_stats(m, F.col("m.area") * 1e9, F.col("m.perimeter"))
    return stats.withColumn("avg_area", F.round("avg_area", 6))


@query("a3_grid_aggregate", f"""{RECT} SELECT floor((miny + h / 2) / 0.01::DOUBLE) AS lat_cell,
floor((minx + w / 2) / 0.01::DOUBLE) AS lng_cell, count(*) AS building_count FROM rect
GROUP BY 1, 2 ORDER BY building_count DESC""")
def grid_aggregate(spark, sf_dir):
    return agg.grid_aggregate(fx.buildings(spark, sf_dir))


@query("a3_grid_aggregate_drops_invalid", f"""WITH {ref.RECT}
SELECT floor(cy / 0.01::DOUBLE) AS lat_cell, floor(cx / 0.01::DOUBLE) AS lng_cell, count(*) AS building_count
FROM (SELECT minx + w * CASE k % 3 WHEN 0 THEN 1.0 / 3 WHEN 1 THEN 5.0 / 12 ELSE 0.5 END AS cx,
        miny + h * CASE k % 3 WHEN 0 THEN 1.0 / 3 WHEN 1 THEN 5.0 / 12 ELSE 0.5 END AS cy
      FROM rect WHERE k % 11 NOT IN (1, 4, 6, 9)) GROUP BY 1, 2 ORDER BY 3 DESC""")
def grid_aggregate_flawed(spark, sf_dir):
    return agg.grid_aggregate(fx.flawed(spark, sf_dir))


@query("l1_ordered_range_query", f"""{RECT} SELECT external_id, building_id FROM rect
WHERE {ref.overlaps(f.TRONDELAG)} ORDER BY building_id ASC NULLS LAST, external_id LIMIT 1000""")
def ordered_range_query(spark, sf_dir):
    found = agg.ordered_range_query(fx.buildings(spark, sf_dir), f.TRONDELAG)
    return found.select("external_id", "building_id")


@query("a4_count_by_region", f"{RECT} SELECT region, count(*) AS building_count FROM rect GROUP BY region")
def count_by_region(spark, sf_dir):
    return agg.count_by(fx.buildings(spark, sf_dir), "region")


@query("a6_distinct_rows", f"{RECT} SELECT DISTINCT source, region, building_type FROM rect")
def distinct_rows(spark, sf_dir):
    b = fx.buildings(spark, sf_dir)
    return b.dropDuplicates(["source", "region", "building_type"]).select("source", "region", "building_type")
