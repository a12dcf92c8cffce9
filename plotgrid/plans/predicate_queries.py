"""Predicate, constructor and set-operation queries of the catalog."""

from __future__ import annotations

from pyspark.sql import functions as F

from plotgrid.functions import geometry as g
from plotgrid.operators.conflation import Conflation
from plotgrid.operators import aggregates as agg
from plotgrid.operators import tiling
from plotgrid.operators.points import containing_pairs
from plotgrid.plans import fixtures as fx
from plotgrid.plans import reference_sql as ref
from plotgrid.plans.join_queries import CONFLATION, RECT
from plotgrid.plans.registry import query
from plotgrid.plans.tile_queries import placed


@query("g4_envelope", f"""{RECT} SELECT k, minx AS xmin, miny AS ymin, minx + w AS xmax, miny + h AS ymax, w * h AS area FROM rect""")
def envelope(spark, sf_dir):
    x, y, w, h = (F.col(c) for c in ("minx", "miny", "w", "h"))
    r = fx.rectangles(spark, sf_dir)
    framed = r.select("k", g.box(x, y, x + w, y + h).alias("b"), g.rectangle(x, y, x + w, y + h).alias("geometry"))
    return framed.select("k", "b.*", g.area(F.col("geometry")).alias("area"))


def _neighbours(spark, sf_dir):
    """Every shape beside the rectangle of the same order moved right by 0 to 1.5 widths."""
    x, y, w, h, k = (F.col(c) for c in ("minx", "miny", "w", "h", "k"))
    shift = w * (k % 4) / 2
    moved = fx.rectangles(spark, sf_dir).select(
        "k", g.rectangle(x + shift, y, x + shift + w, y + h).alias("other")
    )
    return fx.shapes(spark, sf_dir).select("k", "geometry").join(moved, "k")


# The moved rectangle meets the shape when some part of the shape lies right of its left
# side: always up to one width (touching counts), never beyond it.
@query("g10_intersects", f"{RECT} SELECT k, k % 4 < 3 AS meets FROM rect")
def intersects(spark, sf_dir):
    return _neighbours(spark, sf_dir).select("k", g.intersects(F.col("geometry"), F.col("other")).alias("meets"))


@query("g14_iou", f"""{RECT}, parts AS (
  SELECT k, w * h AS other, CASE k % 3 WHEN 0 THEN 0.5 ELSE 0.75 END * w * h AS area,
    w * h * CASE k % 4 WHEN 0 THEN CASE k % 3 WHEN 0 THEN 0.5 ELSE 0.75 END
      WHEN 1 THEN CASE k % 3 WHEN 0 THEN 0.125 WHEN 1 THEN 0.25 ELSE 0.375 END ELSE 0 END AS common FROM rect)
SELECT k, round(common / (area + other - common), 9) AS iou FROM parts""")
def iou(spark, sf_dir):
    pairs = _neighbours(spark, sf_dir).select("k", g.pair_relation(F.col("geometry"), F.col("other")).alias("r"))
    return pairs.select("k", F.round(g.iou(F.col("r")), 9).alias("iou"))


@query("g11_contains", f"""{RECT} SELECT k, k % 3 = 1 AND k % 2 = 0 OR k % 3 = 0 AND k % 2 = 0 OR k % 3 = 2 AND k % 2 = 1 AS inside FROM rect""")
def contains(spark, sf_dir):
    """Even keys ask for the point at three eighths of both sides (in the hole of holed
    shapes), odd keys for one at an eighth of the height on the left side plus, for
    triangles and L shapes, exactly on the border."""
    x, y, w, h, k = (F.col(c) for c in ("minx", "miny", "w", "h", "k"))
    asked = fx.rectangles(spark, sf_dir).select(
        "k",
        F.when(k % 2 == 0, x + w * 3 / 8).when(k % 3 == 2, x + w / 8).otherwise(x).alias("lon"),
        F.when(k % 2 == 0, y + h * 3 / 8).otherwise(y + h / 8).alias("lat"),
    )
    both = fx.shapes(spark, sf_dir).select("k", "geometry").join(asked, "k")
    return both.select("k", g.contains(F.col("geometry"), F.col("lon"), F.col("lat")).alias("inside"))


@query("g12_point", f"{RECT} SELECT k, minx + w AS x, miny AS y FROM rect")
def point(spark, sf_dir):
    r = fx.rectangles(spark, sf_dir).select("k", g.point(F.col("minx") + F.col("w"), F.col("miny")).alias("p"))
    return r.select("k", "p.x", "p.y")


@query("g16_force_2d", f"""{RECT} SELECT k, minx AS xmin, miny + h AS ymax, w * h AS area FROM rect""")
def force_2d(spark, sf_dir):
    """WKB with heights (type 1003) is read as plain x and y."""
    stored = fx.buildings(spark, sf_dir).select("k", F.hex(g.to_wkb(F.col("geometry"))).alias("h"))
    height = F.lit("0000000000001C40")
    points = F.concat(*[F.concat(F.substring("h", 27 + 32 * i, 32), height) for i in range(5)])
    with_z = F.unhex(F.concat(F.lit("01EB030000"), F.substring("h", 11, 16), points))
    read = stored.select("k", g.from_wkb(with_z).alias("geometry"))
    return read.select("k", g.bounds(F.col("geometry")).alias("b"), g.area(F.col("geometry")).alias("area")).select(
        "k", "b.xmin", "b.ymax", "area"
    )


@query("a8_newest_row", """SELECT o_custkey, arg_max(o_orderkey, (o_orderdate, o_orderkey)) AS newest FROM orders GROUP BY o_custkey""")
def newest_row(spark, sf_dir):
    o = fx.table(spark, sf_dir, "orders")
    return o.groupBy("o_custkey").agg(F.max_by("o_orderkey", F.struct("o_orderdate", "o_orderkey")).alias("newest"))


@query("a12_tile_aggregate", f"""{RECT}, {placed([11])}
SELECT z, CAST(x AS INTEGER) AS x, CAST(y AS INTEGER) AS y, count(*) AS n, min(k) AS first, max(k) AS last
FROM placed WHERE px0 < px1 AND py0 < py1 GROUP BY z, x, y""")
def tile_aggregate(spark, sf_dir):
    tiles = tiling.build_tiles(fx.buildings(spark, sf_dir), [11], "k")
    ids = F.col("features.feature_id")
    return tiles.groupBy("z", "x", "y").agg(
        F.sum("n").alias("n"), F.min(F.array_min(ids)).alias("first"), F.max(F.array_max(ids)).alias("last")
    )


@query("l3_order_by_count", f"{RECT} SELECT building_type, count(*) AS building_count FROM rect GROUP BY building_type ORDER BY 2 DESC")
def order_by_count(spark, sf_dir):
    return agg.count_by(fx.buildings(spark, sf_dir), "building_type")


@query("u1_union_relations", f"""{CONFLATION} SELECT external_id AS fkb_id, NULL AS osm_id FROM f WHERE external_id NOT IN (SELECT fkb_id FROM pairs)
UNION ALL SELECT NULL, external_id FROM o WHERE external_id NOT IN (SELECT osm_id FROM pairs)""")
def union_relations(spark, sf_dir):
    c = Conflation(fx.fkb(spark, sf_dir), fx.osm(spark, sf_dir))
    return c.alone("fkb").unionByName(c.alone("osm"))


@query("u2_union_sources", f"""{RECT} SELECT external_id, 'fkb' AS source FROM rect WHERE k % 8 <> 7
UNION ALL SELECT 's' || k, 'osm' FROM rect WHERE k % 8 <> 6""")
def union_sources(spark, sf_dir):
    fkb = fx.fkb(spark, sf_dir).select("external_id", F.lit("fkb").alias("source"))
    return fkb.unionByName(fx.osm(spark, sf_dir).select("external_id", F.lit("osm").alias("source")))


@query("j6_pairs_with_points", f"""{RECT}, p AS (SELECT k AS point_id, minx + w / 2 AS lon, miny + h / 2 AS lat FROM rect)
SELECT r.k, p.point_id FROM rect r JOIN p ON p.lon > r.minx AND p.lon < r.minx + r.w AND p.lat > r.miny AND p.lat < r.miny + r.h""")
def pairs_with_points(spark, sf_dir):
    points = fx.rectangles(spark, sf_dir).select(
        F.col("k").alias("point_id"), (F.col("minx") + F.col("w") / 2).alias("lon"), (F.col("miny") + F.col("h") / 2).alias("lat")
    )
    polygons = fx.buildings(spark, sf_dir).select("k", "geometry", "bbox")
    return containing_pairs(polygons, points).select("k", "point_id")
