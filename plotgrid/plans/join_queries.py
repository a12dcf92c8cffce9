"""Spatial joins, conflation and dataset jobs of the catalog."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from plotgrid.functions import geometry as g
from plotgrid.operators import dataset as ds
from plotgrid.operators import filters as f
from plotgrid.operators import points as pt
from plotgrid.operators import shaping
from plotgrid.operators import zones as zn
from plotgrid.operators.conflation import Conflation, table_pairs, with_cell
from plotgrid.plans import fixtures as fx
from plotgrid.plans import reference_sql as ref
from plotgrid.plans.registry import query
from plotgrid.session import scratch_folder
from plotgrid.sources import layout

RECT = f"WITH {ref.RECT}"
ZONES = f"WITH {ref.RECT}, {ref.zone_tables()}, {ref.ZONE_PAIRS}"


@query("j1_spatial_join_counties", f"""{ZONES}
SELECT zone AS region, count(*) AS building_count FROM zone_pairs GROUP BY zone ORDER BY 2 DESC, 1""")
def spatial_join_counties(spark, sf_dir):
    return zn.spatial_join_counts(fx.buildings(spark, sf_dir), fx.zones(spark))


@query("j1_zone_pairs", f"{ZONES} SELECT k, zone FROM zone_pairs")
def zone_pairs(spark, sf_dir):
    return zn.zone_pairs(fx.buildings(spark, sf_dir), fx.zones(spark), keep=["k"])


@query("j5_clip_to_regions", f"""{ZONES}, clipped AS (
  SELECT r.external_id, p.zone AS region, 'fkb' AS side, CAST(NULL AS TIMESTAMP) AS feature_update_time
  FROM rect r JOIN zone_pairs p ON p.k = r.k WHERE r.k % 2 = 0
  UNION ALL
  SELECT r.external_id, p.zone, 'osm', TIMESTAMP '2024-01-01 00:00:00'
  FROM rect r JOIN zone_pairs p ON p.k = r.k WHERE r.k % 2 = 1)
SELECT * FROM clipped""")
def clip_to_regions(spark, sf_dir):
    b = fx.buildings(spark, sf_dir)
    one = b.filter("k % 2 = 0").withColumn("side", F.lit("fkb"))
    two = b.filter("k % 2 = 1").withColumn("side", F.lit("osm")).withColumn(
        "feature_update_time", F.lit("2024-01-01 00:00:00").cast("timestamp")
    )
    clipped = ds.clip_to_regions([one, two], fx.zones(spark))
    return clipped.select("external_id", "region", "side", "feature_update_time")


POINTS = """points AS (
  SELECT k AS point_id, CASE WHEN k % 3 = 0 THEN minx + w / 2 WHEN k % 3 = 1 THEN minx ELSE minx + 5.0 END AS lon,
    CASE WHEN k % 3 = 0 THEN miny + h / 2 ELSE miny END AS lat FROM rect)"""
# The bucket join below only narrows the search; the four comparisons decide.
POINT_COUNTS = f"""{RECT}, {POINTS},
cells AS (
  SELECT k, minx, miny, w, h, unnest(range(CAST(floor(minx * 512) AS BIGINT), CAST(floor((minx + w) * 512) AS BIGINT) + 1)) AS c FROM rect)
SELECT p.point_id, count(b.k) AS n_buildings
FROM points p LEFT JOIN cells b ON b.c = CAST(floor(p.lon * 512) AS BIGINT)
  AND p.lon > b.minx AND p.lon < b.minx + b.w AND p.lat > b.miny AND p.lat < b.miny + b.h
GROUP BY p.point_id"""


@query("j3_point_in_polygon_counts", POINT_COUNTS)
def point_counts(spark, sf_dir):
    counts = pt.point_in_polygon_counts(fx.query_points(spark, sf_dir), fx.buildings(spark, sf_dir))
    return counts.select("point_id", "n_buildings")


@query("j3_point_in_shapes", f"""WITH {ref.RECT}, {ref.SHAPE_POINTS}, {ref.SHAPE_EDGES}, {POINTS},
near AS (
  SELECT p.point_id, p.lon, p.lat, r.k FROM points p JOIN rect r
    ON p.lon > r.minx AND p.lon < r.minx + r.w AND p.lat > r.miny AND p.lat < r.miny + r.h
  WHERE p.lat < 64),
hits AS (
  SELECT n.point_id, n.k FROM near n JOIN edges e ON e.k = n.k GROUP BY n.point_id, n.k
  HAVING sum(CASE WHEN (e.y0 > n.lat) <> (e.y1 > n.lat)
      AND n.lon < e.x0 + (e.x1 - e.x0) * (n.lat - e.y0) / (e.y1 - e.y0) THEN 1 ELSE 0 END) % 2 = 1
    AND sum(CASE WHEN (e.x1 - e.x0) * (n.lat - e.y0) = (e.y1 - e.y0) * (n.lon - e.x0)
      AND n.lon BETWEEN least(e.x0, e.x1) AND greatest(e.x0, e.x1)
      AND n.lat BETWEEN least(e.y0, e.y1) AND greatest(e.y0, e.y1) THEN 1 ELSE 0 END) = 0)
SELECT p.point_id, count(h.k) AS n_buildings FROM points p LEFT JOIN hits h ON h.point_id = p.point_id GROUP BY 1""")
def point_counts_in_shapes(spark, sf_dir):
    counts = pt.point_in_polygon_counts(fx.query_points(spark, sf_dir), fx.shapes(spark, sf_dir))
    return counts.select("point_id", "n_buildings")


@query("f10_point_containment", f"""{RECT}, one AS (SELECT minx + w / 2 AS lon, miny + h / 2 AS lat FROM rect WHERE k = 17)
SELECT r.external_id FROM rect r, one WHERE lon > minx AND lon < minx + w AND lat > miny AND lat < miny + h""")
def point_containment(spark, sf_dir):
    one = fx.rectangles(spark, sf_dir).filter("k = 17").select(
        (F.col("minx") + F.col("w") / 2).alias("lon"), (F.col("miny") + F.col("h") / 2).alias("lat")
    )
    return pt.containing_polygons(fx.buildings(spark, sf_dir).drop("building_id"), one).select("external_id")


@query("l2_first_inner_points", f"""{RECT} SELECT minx + w / 2 AS lon, miny + h / 2 AS lat FROM rect
WHERE {ref.overlaps(f.TRONDHEIM)} ORDER BY lon, lat LIMIT 25""")
def first_inner_points(spark, sf_dir):
    return pt.first_inner_points(fx.buildings(spark, sf_dir), f.TRONDHEIM, 25)


def _uniform(key: str, stream: int) -> str:
    return f"(('0x' || substr(sha256({key}), {12 * stream + 1}, 12))::BIGINT / 281474976710656.0::DOUBLE)"


@query("j4_points_workload", f"""{RECT},
inside AS (SELECT minx + w / 2 AS lon, miny + h / 2 AS lat FROM rect WHERE {ref.overlaps(f.TRONDHEIM)} ORDER BY lon, lat LIMIT 3),
outside AS (
  SELECT 10.10::DOUBLE + {_uniform("'42:' || i", 0)} * (10.73::DOUBLE - 10.10::DOUBLE) AS lon,
    63.27::DOUBLE + {_uniform("'42:' || i", 1)} * (63.52::DOUBLE - 63.27::DOUBLE) AS lat FROM range(7) t(i)),
workload AS (SELECT * FROM inside UNION ALL SELECT * FROM outside)
SELECT round(p.lon, 9) AS lon, round(p.lat, 9) AS lat, count(b.k) AS n_buildings
FROM workload p LEFT JOIN rect b
  ON p.lon > b.minx AND p.lon < b.minx + b.w AND p.lat > b.miny AND p.lat < b.miny + b.h GROUP BY p.lon, p.lat""")
def points_workload(spark, sf_dir):
    b = fx.buildings(spark, sf_dir)
    counts = pt.point_in_polygon_counts(pt.points_workload(b, f.TRONDHEIM), b)
    return counts.select(F.round("lon", 9).alias("lon"), F.round("lat", 9).alias("lat"), "n_buildings")


@query("j6_polygons_with_points", f"""{RECT}, {POINTS}
SELECT DISTINCT r.k FROM rect r JOIN points p
  ON p.lon > r.minx AND p.lon < r.minx + r.w AND p.lat > r.miny AND p.lat < r.miny + r.h""")
def polygons_with_points(spark, sf_dir):
    polygons = fx.buildings(spark, sf_dir).select("k", "geometry", "bbox")
    return pt.containing_polygons(polygons, fx.query_points(spark, sf_dir)).select("k")


@query("j7_cross_join_one_row", f"""{RECT}, extent AS (SELECT max(minx) - 0.25 AS east FROM rect)
SELECT external_id FROM rect, extent WHERE minx > east""")
def cross_join_one_row(spark, sf_dir):
    r = fx.rectangles(spark, sf_dir)
    extent = r.agg((F.max("minx") - 0.25).alias("east"))
    return r.crossJoin(F.broadcast(extent)).filter("minx > east").select("external_id")


CONFLATION = f"""{RECT},
fkb AS (SELECT * FROM rect WHERE k % 8 <> 7),
osm AS (SELECT * REPLACE (minx + (k % 4) * w / 8 AS minx, 's' || k AS external_id) FROM rect WHERE k % 8 <> 6),
f AS (SELECT *, CAST(floor((minx + w / 2) * 100) AS INTEGER) AS gx, CAST(floor((miny + h / 2) * 100) AS INTEGER) AS gy FROM fkb),
o AS (SELECT *, CAST(floor((minx + w / 2) * 100) AS INTEGER) AS gx, CAST(floor((miny + h / 2) * 100) AS INTEGER) AS gy FROM osm),
common AS (
  SELECT f.external_id AS fkb_id, o.external_id AS osm_id, f.w * f.h AS fa, o.w * o.h AS oa,
    (least(f.minx + f.w, o.minx + o.w) - greatest(f.minx, o.minx))
      * (least(f.miny + f.h, o.miny + o.h) - greatest(f.miny, o.miny)) AS shared
  FROM f JOIN o ON f.gx = o.gx AND f.gy = o.gy
    AND f.minx <= o.minx + o.w AND f.minx + f.w >= o.minx AND f.miny <= o.miny + o.h AND f.miny + f.h >= o.miny),
pairs AS (SELECT fkb_id, osm_id, shared / nullif(fa + oa - shared, 0) AS iou FROM common),
relations AS (
  SELECT fkb_id, osm_id FROM pairs WHERE iou > 0.70
  UNION ALL SELECT external_id, NULL FROM f WHERE external_id NOT IN (SELECT fkb_id FROM pairs)
  UNION ALL SELECT NULL, external_id FROM o WHERE external_id NOT IN (SELECT osm_id FROM pairs))"""


def _conflation(spark, sf_dir) -> Conflation:
    return Conflation(fx.fkb(spark, sf_dir), fx.osm(spark, sf_dir))


@query("j2_grid_bucket_join", f"{CONFLATION} SELECT fkb_id, osm_id, round(iou, 9) AS iou FROM pairs")
def grid_bucket_join(spark, sf_dir):
    c = _conflation(spark, sf_dir)
    return c._with_ids(c.shapes).withColumn("iou", F.round("iou", 9))


# The same pairs without the rule that both middles lie in one cell; lattice cells only narrow the search.
BORDERS = CONFLATION.replace("FROM f JOIN o ON f.gx = o.gx AND f.gy = o.gy\n", """FROM (SELECT *, unnest(range(gx - 1, gx + 2)) AS nx FROM f) f JOIN o ON f.nx = o.gx AND o.gy BETWEEN f.gy - 1 AND f.gy + 1
""")


@query("j2_over_borders", f"{BORDERS} SELECT fkb_id, osm_id, round(iou, 9) AS iou FROM pairs")
def over_borders(spark, sf_dir):
    """Candidate pairs on both sides of cell borders too."""
    c = Conflation(fx.fkb(spark, sf_dir), fx.osm(spark, sf_dir), neighbors=True)
    return c._with_ids(c.shapes).withColumn("iou", F.round("iou", 9))


@query("j2_missed_at_borders", f"{BORDERS}, here AS (SELECT f.external_id AS fkb_id, o.external_id AS osm_id FROM f JOIN o ON f.gx = o.gx AND f.gy = o.gy)"
    " SELECT fkb_id, osm_id, iou > 0.70 AS one_building FROM pairs ANTI JOIN here USING (fkb_id, osm_id)")
def missed_at_borders(spark, sf_dir):
    """The pairs that the one-cell rule misses, and whether they are the same building."""
    wide = Conflation(fx.fkb(spark, sf_dir), fx.osm(spark, sf_dir), neighbors=True)
    narrow = Conflation(wide.fkb, wide.osm, keyed=True, wider=wide)
    return wide.missing(narrow).select("fkb_id", "osm_id", (F.col("iou") > wide.threshold).alias("one_building"))


@query("j2_bucketed_tables", f"{CONFLATION} SELECT fkb_id, osm_id, round(iou, 9) AS iou FROM pairs")
def bucketed_tables(spark, sf_dir):
    """The candidate join over two catalog tables that are stored by cell."""
    names = [f"{side}_{uuid.uuid4().hex}" for side in ("fkb", "osm")]
    for name, df in zip(names, (fx.fkb(spark, sf_dir), fx.osm(spark, sf_dir))):
        layout.seed_by_cell(with_cell(df).select("external_id", "geometry", "bbox", "grid_x", "grid_y"), name, buckets=8)
    return table_pairs(*map(spark.table, names)).withColumn("iou", F.round("iou", 9))


@query("a5_max_iou_per_pair", f"""{CONFLATION} SELECT fkb_id, osm_id, max(iou)::DECIMAL(18,3) AS max_iou FROM pairs GROUP BY 1, 2
UNION ALL SELECT external_id, NULL, NULL FROM f WHERE external_id NOT IN (SELECT fkb_id FROM pairs)""")
def max_iou(spark, sf_dir):
    return _conflation(spark, sf_dir).candidates_left("fkb")


@query("j2_grid_bucket_join_osm_side", f"""{CONFLATION} SELECT fkb_id, osm_id, max(iou)::DECIMAL(18,3) AS max_iou FROM pairs GROUP BY 1, 2
UNION ALL SELECT NULL, external_id, NULL FROM o WHERE external_id NOT IN (SELECT osm_id FROM pairs)""")
def max_iou_osm(spark, sf_dir):
    return _conflation(spark, sf_dir).candidates_left("osm")


@query("j9_fkb_without_candidate", f"{CONFLATION} SELECT external_id AS fkb_id FROM f WHERE external_id NOT IN (SELECT fkb_id FROM pairs)")
def fkb_alone(spark, sf_dir):
    return _conflation(spark, sf_dir).alone("fkb").select("fkb_id")


@query("t2a_conflate_relations", f"{CONFLATION} SELECT fkb_id, osm_id FROM relations")
def conflate_relations(spark, sf_dir):
    return _conflation(spark, sf_dir).relations()


@query("t2b_conflate_merge", f"""{CONFLATION}
SELECT external_id, region, building_type, building_id, 'fkb' AS source FROM f WHERE external_id IN (SELECT fkb_id FROM relations)
UNION ALL
SELECT external_id, region, building_type, building_id, 'osm' FROM o WHERE external_id IN (SELECT osm_id FROM relations WHERE fkb_id IS NULL)""")
def conflate_merge(spark, sf_dir):
    merged = _conflation(spark, sf_dir).merged()
    return merged.select("external_id", "region", "building_type", "building_id", "source")


SUMMARY = """SELECT count(*) FILTER (fkb_id IS NULL) AS osm_only, count(*) FILTER (osm_id IS NULL) AS fkb_only,
count(*) FILTER (fkb_id IS NOT NULL AND osm_id IS NOT NULL) AS overlapping FROM relations"""


@query("t2c_conflation_summary", f"{CONFLATION} {SUMMARY}")
def conflation_summary(spark, sf_dir):
    return _conflation(spark, sf_dir).summary()


@query("f9_null_split", f"{CONFLATION} {SUMMARY}")
def null_split(spark, sf_dir):
    return f.null_split(_conflation(spark, sf_dir).relations())


@query("t1_partition_key", f"""{RECT}
SELECT k, {ref.geohash3('(minx + w / 2)', '(miny + h / 2)')} AS partition_key FROM rect""")
def partition_key(spark, sf_dir):
    return ds.with_partition_key(fx.buildings(spark, sf_dir)).select("k", "partition_key")


@query("a7_rows_per_partition_key", f"""{RECT}
SELECT {ref.geohash3('(minx + w / 2)', '(miny + h / 2)')} AS partition_key, count(*) AS n FROM rect GROUP BY 1""")
def rows_per_partition(spark, sf_dir):
    return ds.partitioned(fx.buildings(spark, sf_dir)).groupBy("partition_key").agg(F.count("*").alias("n"))



PREPARE = f"""{RECT}, {ref.zone_tables()},
frect AS (SELECT * FROM rect WHERE k % 8 <> 7),
orect AS (SELECT * REPLACE (minx + (k % 4) * w / 8 AS minx, 's' || k AS external_id) FROM rect WHERE k % 8 <> 6),
{ref.ZONE_PAIRS.replace('zone_pairs AS', 'fzones AS').replace('FROM rect r', 'FROM frect r')},
{ref.ZONE_PAIRS.replace('zone_pairs AS', 'ozones AS').replace('FROM rect r', 'FROM orect r')},
f AS (SELECT r.* REPLACE (z.zone AS region), CAST(floor((minx + w / 2) * 100) AS INTEGER) AS gx,
  CAST(floor((miny + h / 2) * 100) AS INTEGER) AS gy FROM frect r JOIN fzones z ON z.k = r.k),
o AS (SELECT r.* REPLACE (z.zone AS region), CAST(floor((minx + w / 2) * 100) AS INTEGER) AS gx,
  CAST(floor((miny + h / 2) * 100) AS INTEGER) AS gy FROM orect r JOIN ozones z ON z.k = r.k),
common AS (
  SELECT f.region, f.external_id AS fkb_id, o.external_id AS osm_id, f.w * f.h AS fa, o.w * o.h AS oa,
    (least(f.minx + f.w, o.minx + o.w) - greatest(f.minx, o.minx))
      * (least(f.miny + f.h, o.miny + o.h) - greatest(f.miny, o.miny)) AS shared
  FROM f JOIN o ON f.region = o.region AND f.gx = o.gx AND f.gy = o.gy
    AND f.minx <= o.minx + o.w AND f.minx + f.w >= o.minx AND f.miny <= o.miny + o.h AND f.miny + f.h >= o.miny),
pairs AS (SELECT region, fkb_id, osm_id, shared / nullif(fa + oa - shared, 0) AS iou FROM common)
SELECT external_id, region, 'fkb' AS source, {ref.geohash3('(minx + w / 2)', '(miny + h / 2)')} AS partition_key FROM f
WHERE (region, external_id) IN (SELECT (region, fkb_id) FROM pairs WHERE iou > 0.70)
  OR (region, external_id) NOT IN (SELECT (region, fkb_id) FROM pairs)
UNION ALL
SELECT external_id, region, 'osm', {ref.geohash3('(minx + w / 2)', '(miny + h / 2)')} FROM o
WHERE (region, external_id) NOT IN (SELECT (region, osm_id) FROM pairs)"""


@query("t6_prepare_dataset", PREPARE)
def prepare_dataset(spark, sf_dir):
    prepared = ds.prepare_dataset(fx.fkb(spark, sf_dir), fx.osm(spark, sf_dir), fx.zones(spark))
    return prepared.select("external_id", "region", "source", "partition_key")


@query("t6_publish_twice", PREPARE)
def publish_twice(spark, sf_dir):
    """The dataset job, run twice over the same release, read back from its files."""
    root, release = scratch_folder(spark, "published"), "2026-04-02.0"
    for _ in range(2):
        manifest = ds.publish_dataset(fx.fkb(spark, sf_dir), fx.osm(spark, sf_dir), fx.zones(spark), root, release)
    known = manifest.filter("problem IS NULL").select("region").distinct()
    back = layout.scan_buildings(spark, root, release, "small")
    return back.join(known, "region", "left_semi").select("external_id", "region", "source", "partition_key")


def _clone_check(clones: int) -> str:
    key = "region || ':' || external_id || ':' || clone"
    return f"""{RECT}, {ref.zone_tables()},
zone_box AS (SELECT region, min(x0) AS zx0, min(y0) AS zy0, max(x0) AS zx1, max(y0) AS zy1 FROM zone_edges GROUP BY region),
copies AS (SELECT r.*, z.*, unnest(range(1, {clones} + 1)) AS clone FROM rect r JOIN zone_box z USING (region)),
drawn AS (SELECT region,
  zx0 + {_uniform(key, 0)} * (zx1 - zx0) + ({_uniform(key, 3)} * 2 - 1) * 0.00001::DOUBLE AS x,
  zy0 + {_uniform(key, 1)} * (zy1 - zy0) + ({_uniform(key, 4)} * 2 - 1) * 0.00001::DOUBLE AS y,
  {_uniform(key, 2)} * (2 * pi()) AS turn, w, h FROM copies)
SELECT region, 'clone' AS kind, count(*) AS n, round(avg(x), 6) AS mean_x, round(avg(y), 6) AS mean_y,
  round(sum(abs(cos(turn)) * w + abs(sin(turn)) * h), 6) AS widths FROM drawn GROUP BY region
UNION ALL
SELECT region, 'original', count(*), round(avg(minx + w / 2), 6), round(avg(miny + h / 2), 6), round(sum(w), 6) FROM rect GROUP BY region"""


def _clones(spark, sf_dir, size):
    table = ds.synthesize(fx.buildings(spark, sf_dir), fx.zones(spark), size)
    measured = g.with_measures(table.select("region", "external_id", "geometry", "bbox"), "m")
    kind = F.when(F.col("external_id").isNull(), "clone").otherwise("original").alias("kind")
    return measured.groupBy("region", kind).agg(
        F.count("*").alias("n"), F.round(F.avg("m.cx"), 6).alias("mean_x"), F.round(F.avg("m.cy"), 6).alias("mean_y"),
        F.round(F.sum(F.col("bbox.xmax") - F.col("bbox.xmin")), 6).alias("widths"),
    )


@query("t3a_synthesize_medium", _clone_check(7))
def synthesize_medium(spark, sf_dir):
    return _clones(spark, sf_dir, "medium")


@query("t3a_synthesize_large", _clone_check(19))
def synthesize_large(spark, sf_dir):
    return _clones(spark, sf_dir, "large")


@query("t3b_affine_matrix", f"""{RECT}, m AS (SELECT k, k / 1000.0::DOUBLE AS turn, minx + w / 2 AS cx, miny + h / 2 AS cy FROM rect)
SELECT k, round(cos(turn), 9) AS a, round(-sin(turn), 9) AS b, round(sin(turn), 9) AS d, round(cos(turn), 9) AS e,
  round(10.5 - (cos(turn) * cx - sin(turn) * cy), 6) AS tx, round(63.5 - (sin(turn) * cx + cos(turn) * cy), 6) AS ty FROM m""")
def affine_matrix(spark, sf_dir):
    r = fx.rectangles(spark, sf_dir)
    terms = ds.rotation_matrix(
        F.col("k") / 1000.0, F.col("minx") + F.col("w") / 2, F.col("miny") + F.col("h") / 2, F.lit(10.5), F.lit(63.5)
    )
    return r.select("k", *[F.round(v, 6 if c in ("tx", "ty") else 9).alias(c) for c, v in terms.items()])


@query("u3_union_missing_columns", f"""{RECT} SELECT external_id, building_type, region FROM rect WHERE source = 'osm'
UNION ALL SELECT external_id, NULL, region FROM rect WHERE source = 'fkb'""")
def union_missing(spark, sf_dir):
    b = fx.buildings(spark, sf_dir).select("external_id", "building_type", "region", "source")
    one = b.filter("source = 'osm'").drop("source")
    two = b.filter("source = 'fkb'").drop("source", "building_type")
    return shaping.union_by_name([one, two])
