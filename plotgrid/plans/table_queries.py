"""Sources, column shaping, geometry functions and measurement jobs of the catalog."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from plotgrid.functions import geometry as g
from plotgrid.operators import dataset as ds
from plotgrid.operators import filters as f
from plotgrid.operators import samples as sm
from plotgrid.operators import shaping, stages, zones
from plotgrid.plans import fixtures as fx
from plotgrid.plans import reference_sql as ref
from plotgrid.plans.registry import query
from plotgrid.session import scratch_folder
from plotgrid.sources import layout, registry

RECT = f"WITH {ref.RECT}"
RELEASE = "2026-04-02.0"
KEY = ref.geohash3("(minx + w / 2)", "(miny + h / 2)")


def _written(spark, sf_dir):
    root = scratch_folder(spark, "dataset")
    rows = ds.with_partition_key(fx.buildings(spark, sf_dir))
    return root, layout.write_buildings(rows, root, RELEASE, "small")


@query("s1_scan_buildings", f"{RECT} SELECT external_id, region, source, minx AS xmin, minx + w AS xmax FROM rect WHERE region = '07'")
def scan_buildings(spark, sf_dir):
    root, _ = _written(spark, sf_dir)
    found = layout.scan_buildings(spark, root, RELEASE, "small", region="07")
    return found.select("external_id", "region", "source", "bbox.xmin", "bbox.xmax")


@query("s2_scan_union_by_name", f"""{RECT} SELECT external_id, region, CASE WHEN source = 'osm' THEN building_type END AS building_type,
CASE WHEN source = 'fkb' THEN building_id END AS building_id FROM rect""")
def scan_union(spark, sf_dir):
    b = fx.buildings(spark, sf_dir)
    one, two = scratch_folder(spark, "osm"), scratch_folder(spark, "fkb")
    b.filter("source = 'osm'").select("external_id", "region", "building_type").write.parquet(one)
    b.filter("source = 'fkb'").select("external_id", "region", "building_id").write.parquet(two)
    return layout.scan_union(spark, one, two).select("external_id", "region", "building_type", "building_id")


@query("s4_scan_or_empty", f"{RECT} SELECT external_id, region FROM rect")
def scan_or_empty(spark, sf_dir):
    schema = "external_id string, region string"
    path = scratch_folder(spark, "some")
    fx.buildings(spark, sf_dir).select("external_id", "region").write.parquet(path)
    missing = layout.scan_or_empty(spark, scratch_folder(spark, "none"), schema)
    return layout.scan_or_empty(spark, path, schema).unionByName(missing)


@query("s5_read_contribution", f"""{RECT} SELECT external_id, minx AS xmin, miny AS ymin, minx + w AS xmax, miny + h AS ymax,
CASE k % 3 WHEN 0 THEN 0.5 ELSE 0.75 END * w * h AS area FROM rect""")
def read_contribution(spark, sf_dir):
    path = scratch_folder(spark, "contribution")
    layout.encoded(fx.shapes(spark, sf_dir)).select("external_id", "geometry").write.parquet(path)
    read = layout.read_contribution(spark, path)
    return read.select("external_id", "bbox.*", g.area(F.col("geometry")).alias("area"))


@query("s6_write_geoparquet", f"""{RECT} SELECT region, {KEY} AS partition_key, count(*) AS n, min(minx) AS xmin, max(miny + h) AS ymax
FROM rect GROUP BY 1, 2""")
def write_geoparquet(spark, sf_dir):
    root, _ = _written(spark, sf_dir)
    return layout.scan_buildings(spark, root, RELEASE, "small").groupBy("region", "partition_key").agg(
        F.count("*").alias("n"), F.min("bbox.xmin").alias("xmin"), F.max("bbox.ymax").alias("ymax")
    )


@query("s7_seed_table", f"{RECT} SELECT region, count(*) AS n, count(building_id) AS numbered FROM rect GROUP BY region")
def seed_table(spark, sf_dir):
    name = f"seed_{uuid.uuid4().hex}"
    layout.seed_table(fx.buildings(spark, sf_dir), name)
    return spark.table(name).groupBy("region").agg(
        F.count("*").alias("n"), F.count("building_id").alias("numbered")
    )


def _counties(spark, sf_dir):
    """One county per customer: a square at the customer's place in a grid."""
    c = fx.table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"))
    x, y = F.col("id") % 64 / 64, F.floor(F.col("id") / 64) / 64
    square = g.rectangle(x, y, x + 1 / 64, y + 1 / 64)
    return c.select(F.col("name").alias("region"), square.alias("geometry"), "id").select(
        "region", g.to_wkb(F.col("geometry")).alias("wkb"), F.to_json(layout.geojson(F.col("geometry"))).alias("json"), "id"
    )


@query("s8_seed_counties", "SELECT c_name AS county_name, 1.0::DOUBLE / 4096 AS area FROM customer")
def seed_counties(spark, sf_dir):
    table = layout.county_table(_counties(spark, sf_dir))
    return table.select("county_name", g.from_wkb(F.col("geometry")).alias("geometry")).select(
        "county_name", g.area(F.col("geometry")).alias("area")
    )


@query("s9_upsert_county", """SELECT c_name AS region, CASE WHEN c_custkey % 10 = 0 THEN 'changed' ELSE 'kept' END AS state
FROM customer WHERE c_custkey % 3 <> 1 OR c_custkey % 10 = 0""")
def upsert_county(spark, sf_dir):
    c = _counties(spark, sf_dir)
    old = c.filter("id % 3 <> 1").select("region", "wkb", F.lit("kept").alias("json"))
    new = c.filter("id % 10 = 0").select("region", "wkb", F.lit("changed").alias("json"))
    return registry.upsert_counties(old, new).select("region", F.col("json").alias("state"))


@query("s9_get_county", "SELECT c_name AS region, 5 AS n_points FROM customer WHERE c_custkey = 7")
def get_county(spark, sf_dir):
    found = registry.get_county(_counties(spark, sf_dir).drop("id"), "Customer#000000007")
    points = F.size(F.from_json("json", "coordinates array<array<array<array<double>>>>")["coordinates"][0][0])
    return found.select("region", points.alias("n_points"))


@query("s9_stored_counties", """SELECT c_name AS region, CASE WHEN c_custkey % 15 = 0 THEN 'again' WHEN c_custkey % 10 = 0 THEN 'changed' ELSE 'kept' END AS state, 3 AS versions
FROM customer UNION ALL SELECT 'new ' || c_custkey, 'again', 3 FROM customer WHERE c_custkey % 15 = 0""")
def stored_counties(spark, sf_dir):
    """A stored registry after two upserts of its first version, read back from its last snapshot."""
    path = scratch_folder(spark, "counties")
    customers = fx.table(spark, sf_dir, "customer").select(F.col("c_name").alias("region"), "c_custkey")

    def rows(df, state):
        return df.select("region", F.encode(F.lit(state), "UTF-8").alias("wkb"), F.lit(state).alias("json"))

    registry.store_counties(spark, path, rows(customers, "kept"))
    registry.store_counties(spark, path, rows(customers.filter("c_custkey % 10 = 0"), "changed"))
    third = customers.filter("c_custkey % 15 = 0")
    added = third.withColumn("region", F.concat(F.lit("new "), "c_custkey"))
    registry.store_counties(spark, path, rows(third.unionByName(added), "again"))
    store = registry.stored_counties(spark, path)
    return store.read().select("region", F.col("json").alias("state"), F.lit(len(store.versions())).alias("versions"))


def _releases(spark, sf_dir):
    """A release per order: its day and a version; some lack a creation time."""
    o = fx.table(spark, sf_dir, "orders")
    return o.select(
        F.concat_ws(".", F.date_format("o_orderdate", "yyyy-MM-dd"), (F.col("o_orderkey") % 4).cast("string")).alias("release"),
        F.expr("CASE WHEN o_orderkey % 5 = 0 THEN NULL ELSE o_orderdate + make_dt_interval(0, 0, 0, o_orderkey) END").alias("date_created"),
    )


LATEST = """WITH r AS (
  SELECT strftime(o_orderdate, '%Y-%m-%d') AS day, o_orderkey % 4 AS version,
    CASE WHEN o_orderkey % 5 = 0 THEN NULL ELSE o_orderdate + to_seconds(o_orderkey) END AS created FROM orders),
latest AS (SELECT day, version FROM r WHERE created IS NOT NULL ORDER BY created DESC, day DESC, version DESC LIMIT 1)"""


@query("s10_latest_release", f"{LATEST} SELECT day || '.' || version AS release, CAST(version AS INTEGER) AS version FROM latest")
def latest_release(spark, sf_dir):
    return registry.latest_release(_releases(spark, sf_dir)).select("release", "version")


@query("s10_next_release", f"""{LATEST} SELECT day || '.' || (version + 1) AS same_day, '2030-05-06.0' AS new_day FROM latest""")
def next_release(spark, sf_dir):
    releases = _releases(spark, sf_dir)
    same = registry.next_release(releases, F.lit("1990-01-01"))
    version = F.regexp_extract("release", r"(\d+)$", 1)
    day = registry.latest_release(releases).select(F.col("day").cast("string"))
    one = day.crossJoin(same.select(version.alias("v"))).select(F.concat_ws(".", "day", "v").alias("same_day"))
    return one.crossJoin(registry.next_release(releases, F.lit("2030-05-06")).withColumnRenamed("release", "new_day"))


@query("s10_append_release", "SELECT (SELECT count(*) FROM orders) + 1 AS n, '2030-05-06.0' AS newest")
def append_release(spark, sf_dir):
    grown = registry.with_next_release(_releases(spark, sf_dir), F.lit("2030-05-06"), F.lit("2030-05-06 10:00:00"))
    return grown.agg(F.count("*").alias("n"), F.max_by("release", "date_created").alias("newest"))


@query("s10_stored_releases", """SELECT day || '.' || v AS release FROM (SELECT DISTINCT strftime(o_orderdate, '%Y-%m-%d') AS day FROM orders
  WHERE o_orderdate IN (SELECT DISTINCT o_orderdate FROM orders ORDER BY 1 LIMIT 3)) d, (VALUES (0), (1)) n(v)""")
def stored_releases(spark, sf_dir):
    """Two releases on each of the first three order dates, appended to a stored registry one after the other."""
    path = scratch_folder(spark, "releases")
    dates = fx.table(spark, sf_dir, "orders").select(F.col("o_orderdate").cast("date").alias("day")).distinct().orderBy("day").limit(3)
    for row in sorted(dates.collect()):
        for _ in range(2):
            registry.store_release(spark, path, F.lit(row["day"]), F.lit(row["day"]).cast("timestamp"))
    return registry.stored_releases(spark, path).read().select("release")


def _samples(spark, sf_dir):
    """Events as sample rows: one run per user, iterations by event number."""
    e = fx.table(spark, sf_dir, "events")
    return e.select(
        F.col("event_type").alias("query_id"), F.col("user_id").cast("bigint").alias("run_id"),
        (F.col("event_id") % 2 + 1).cast("bigint").alias("benchmark_run"), (F.col("event_id") % 5).cast("bigint").alias("iteration"),
        F.col("value").alias("elapsed_time"), (F.col("event_id") % 1000).cast("bigint").alias("network_bytes_sent"),
        (F.col("event_id") % 333).cast("bigint").alias("network_bytes_received"),
        F.col("ts").alias("started_at"), F.expr("ts + INTERVAL 5 SECONDS").alias("ended_at"),
        (F.col("value") / 4).alias("cpu_time_user_seconds"), (F.col("value") / 8).alias("cpu_time_system_seconds"),
        F.expr("CASE WHEN event_id % 9 = 0 THEN NULL ELSE event_id % 50 END").alias("result_cardinality"), "event_id",
    )


@query("s11_append_samples", """SELECT event_type AS query_id, CAST(event_id % 2 + 1 AS INTEGER) AS benchmark_run,
CAST(event_id % 5 + 5 * (event_id % 2) AS INTEGER) AS iteration, count(*) AS n FROM events GROUP BY 1, 2, 3""")
def append_samples(spark, sf_dir):
    path = scratch_folder(spark, "samples")
    registry.append_samples(_samples(spark, sf_dir), path, iterations_per_run=5)
    return spark.read.parquet(path).groupBy("query_id", "benchmark_run", "iteration").agg(F.count("*").alias("n"))


@query("s11_append_run", "SELECT user_id AS id, min(ts) AS timestamp, event_type AS query_id FROM events GROUP BY user_id, event_type")
def append_run(spark, sf_dir):
    path = scratch_folder(spark, "runs")
    runs = _samples(spark, sf_dir).groupBy("run_id", "query_id").agg(F.min("started_at").alias("timestamp"))
    registry.append_run(runs.withColumn("id", F.col("run_id")), path)
    return spark.read.parquet(path).select("id", "timestamp", "query_id")


@query("s12_append_cost", """SELECT event_type AS query_id, count(DISTINCT user_id) AS runs,
round(sum(value * 2 * 0.0000143 + value * 4 * 0.0000016), 9) AS total FROM events GROUP BY event_type""")
def append_cost(spark, sf_dir):
    path = scratch_folder(spark, "costs")
    usage = _samples(spark, sf_dir).groupBy("query_id", "run_id").agg(F.sum("elapsed_time").alias("duration_seconds")).withColumns({
        "vcpu_count": F.lit(2.0), "memory_gb": F.lit(4.0), "bytes_egress": F.lit(0.0),
    })
    costs = sm.container_cost(usage).withColumn("benchmark_run", F.lit(1))
    registry.append_costs(costs.select("query_id", "run_id", "benchmark_run", "provider", "total_cost"), path)
    return spark.read.parquet(path).groupBy("query_id").agg(
        F.countDistinct("run_id").alias("runs"), F.round(F.sum("total_cost"), 9).alias("total")
    )


@query("s13_asset_manifest", f"""{RECT} SELECT DISTINCT '{RELEASE}' AS release, 'buildings' AS theme, region, 'small' AS source,
'region-' || region || '-small' AS item_id, 'data' AS role, 'application/vnd.apache.parquet' AS media_type FROM rect""")
def asset_manifest(spark, sf_dir):
    _, path = _written(spark, sf_dir)
    manifest = layout.asset_manifest(spark, path, source="small")
    return manifest.select("release", "theme", "region", "source", "item_id", "role", "media_type").distinct()


TIMED = f"{RECT}, timed AS (SELECT *, TIMESTAMP '2024-01-01 00:00:00' + to_hours(CAST(k AS BIGINT)) AS t FROM rect)"


def _timed_release(spark, sf_dir):
    root = scratch_folder(spark, "timed")
    hours = F.expr("timestamp_ntz'2024-01-01 00:00:00' + make_interval(0, 0, 0, 0, CAST(k AS INT))").cast("timestamp")
    rows = ds.with_partition_key(fx.buildings(spark, sf_dir)).withColumn("feature_update_time", hours)
    path = layout.write_buildings(rows, root, RELEASE, "small")
    return path, layout.manifest_with_extents(spark, f"{path}/size=small", "small", "feature_update_time")


@query("s13_item_extents", f"""{TIMED} SELECT 'region-' || region || '-small' AS item_id, count(*) AS rows, min(minx) AS xmin, min(miny) AS ymin,
  max(minx + w) AS xmax, max(miny + h) AS ymax, min(t) AS first_time, max(t) AS last_time FROM timed GROUP BY region""")
def item_extents(spark, sf_dir):
    """Catalog items with their rows, box and times, brought together from their files."""
    _, manifest = _timed_release(spark, sf_dir)
    return layout.item_extents(manifest).select("item_id", "rows", "bbox.*", "first_time", "last_time")


@query("s13_scan_by_extent", f"""{TIMED} SELECT external_id, region FROM timed
WHERE {ref.overlaps(f.TRONDHEIM)} AND t >= TIMESTAMP '2024-01-03 00:00:00'""")
def scan_by_extent(spark, sf_dir):
    """A frame and a time over the files that the manifest says may hold them."""
    path, manifest = _timed_release(spark, sf_dir)
    since = F.lit("2024-01-03 00:00:00").cast("timestamp")
    schema = "external_id string, geometry binary, bbox struct<xmin:double,ymin:double,xmax:double,ymax:double>, feature_update_time timestamp"
    read = layout.scan_by_extent(spark, manifest, path, schema, f.TRONDHEIM, since)
    found = f.bbox_intersects(layout.decoded(read.filter(F.col("feature_update_time") >= since)), f.TRONDHEIM)
    return found.select("external_id", "region")


@query("s14_blob_summary", f"{RECT} SELECT count(DISTINCT region) AS folders, TRUE AS sized FROM rect")
def blob_summary(spark, sf_dir):
    _, path = _written(spark, sf_dir)
    folders = layout.file_listing(spark, path).agg(F.countDistinct(F.regexp_extract("path", "region=(\\d+)", 1)).alias("folders"))
    # the same files and sizes as their readers see them
    read = spark.read.option("recursiveFileLookup", "true").parquet(f"{path}/size=small").select("_metadata.file_path", "_metadata.file_size").distinct()
    seen = read.agg(F.count("*").alias("files"), F.sum("file_size").alias("bytes"))
    sized = (F.col("file_count") == F.col("files")) & (F.col("total_bytes") == F.col("bytes"))
    return folders.crossJoin(layout.blob_summary(spark, path)).crossJoin(seen).select("folders", sized.alias("sized"))


@query("s15_export_geojsonl", f"""{RECT} SELECT external_id, minx AS west, miny AS south, minx + w AS east, miny + h AS north, 5 AS points FROM rect""")
def export_geojsonl(spark, sf_dir):
    path = scratch_folder(spark, "geojson")
    layout.export_geojsonl(fx.buildings(spark, sf_dir), path)
    schema = """type string, properties struct<external_id:string,bbox_minx:double,bbox_miny:double,bbox_maxx:double,bbox_maxy:double>,
      geometry struct<type:string,coordinates:array<array<array<array<double>>>>>"""
    p = F.col("properties")
    return spark.read.schema(schema).json(path).select(
        p["external_id"].alias("external_id"), p["bbox_minx"].alias("west"), p["bbox_miny"].alias("south"),
        p["bbox_maxx"].alias("east"), p["bbox_maxy"].alias("north"), F.size(F.col("geometry.coordinates")[0][0]).alias("points"),
    )


@query("s16_concat_layers", f"""{RECT}, {ref.laea('(SELECT k, minx AS lon, miny AS lat FROM rect WHERE k % 2 = 0)', 'moved')}
SELECT k, round(east, 2) AS x, round(north, 2) AS y FROM moved
UNION ALL SELECT k, round(minx * 1000, 2), round(miny * 1000, 2) FROM rect WHERE k % 2 = 1""")
def concat_layers(spark, sf_dir):
    b = fx.buildings(spark, sf_dir).select("k", "geometry")
    metric = b.filter("k % 2 = 1").withColumn("geometry", g.map_points(F.col("geometry"), lambda x, y: (x * 1000, y * 1000)))
    first = F.col("geometry")[0][0][0]
    stacked = shaping.concat_layers([(b.filter("k % 2 = 0"), 4326), (metric, 3035)], 3035)
    return stacked.select("k", F.round(first["x"], 2).alias("x"), F.round(first["y"], 2).alias("y"))


@query("s17_validate_paths", """SELECT o_orderkey AS k, CASE o_orderkey % 6 WHEN 1 THEN 'release form' WHEN 2 THEN 'release date'
WHEN 3 THEN 'release version' WHEN 4 THEN 'region' WHEN 5 THEN 'file name' END AS problem FROM orders""")
def validate_paths(spark, sf_dir):
    k = F.col("k")
    day = F.date_format("o_orderdate", "yyyy-MM-dd")
    manifest = fx.table(spark, sf_dir, "orders").withColumn("k", F.col("o_orderkey")).select(
        "k",
        F.when(k % 6 == 1, "20240101").when(k % 6 == 2, "2024-13-01.0").when(k % 6 == 3, F.concat(day, F.lit(".x")))
        .otherwise(F.concat(day, F.lit(".2"))).alias("release"),
        F.when(k % 6 == 4, "7").otherwise("07").alias("region"),
        F.when(k % 6 == 5, "part_12.parquet").otherwise("part_00012.parquet").alias("file_name"),
    )
    return layout.validate_paths(manifest).select("k", "problem")


@query("p1_drop_columns", f"{RECT} SELECT k, external_id, building_id, source FROM rect")
def drop_columns(spark, sf_dir):
    b = fx.buildings(spark, sf_dir)
    return shaping.drop_columns(b, "bbox", "size", "theme", "geometry", "region", "building_type")


@query("p2_with_area", f"""WITH {ref.RECT}, {ref.rect_measures(25832)} SELECT k, round(area, 2) AS area FROM m""")
def with_area(spark, sf_dir):
    return shaping.with_area(fx.buildings(spark, sf_dir)).select("k", F.round("area", 2).alias("area"))


@query("p3_missing_columns", f"{RECT} SELECT k, source, CAST(NULL AS TIMESTAMP) AS feature_update_time FROM rect")
def missing_columns(spark, sf_dir):
    b = fx.buildings(spark, sf_dir).select("k", "source")
    return shaping.with_missing_columns(b, {"source": "string", "feature_update_time": "timestamp"})


@query("p4_with_source", f"{RECT} SELECT k, 'fkb' AS source FROM rect")
def with_source(spark, sf_dir):
    return shaping.with_source(fx.buildings(spark, sf_dir).select("k", "source"), "fkb")


@query("p5_flatten_bounds", f"""{RECT} SELECT k, minx AS bbox_minx, miny AS bbox_miny, minx + w AS bbox_maxx, miny + h AS bbox_maxy FROM rect""")
def flatten_bounds(spark, sf_dir):
    return shaping.flatten_bounds(fx.shapes(spark, sf_dir).select("k", "geometry", "bbox")).drop("geometry")


@query("p6_text_columns", f"{RECT} SELECT k, '{{' || k || ', ' || source || '}}' AS tag FROM rect")
def text_columns(spark, sf_dir):
    b = fx.buildings(spark, sf_dir).select("k", F.struct("k", "source").alias("tag"))
    return shaping.text_columns(b)


@query("p7_normalize_tags", """SELECT p_partkey AS id, CASE WHEN p_partkey % 7 = 2 THEN NULL ELSE p_name END AS name,
CASE WHEN p_partkey % 7 IN (1, 2) THEN 'unspecified' ELSE p_type END AS type, CASE WHEN p_partkey % 3 = 0 THEN 2 ELSE 1 END AS parts,
p_partkey % 50 + CASE WHEN p_partkey % 3 = 0 THEN 1 ELSE 0 END AS area FROM part WHERE p_partkey % 7 <> 3 AND p_partkey % 50 > 0""")
def normalize_tags(spark, sf_dir):
    k = F.col("p_partkey")
    building = F.when(k % 7 == 1, "yes").when(k % 7 == 2, "YES").when(k % 7 == 3, None).otherwise(F.col("p_type"))
    tags = F.create_map(F.lit("building"), building, F.lit("name"), F.when(k % 7 != 2, F.col("p_name")), F.lit("other"), F.lit("x"))
    # WKB as hex text of either case: one or two parts; rows of no width are bad text
    one = g.rectangle(F.lit(0.0), F.lit(0.0), (k % 50).cast("double"), F.lit(1.0))
    two = F.concat(one, g.rectangle(F.lit(60.0), F.lit(0.0), F.lit(61.0), F.lit(1.0)))
    shape = fx.table(spark, sf_dir, "part").withColumn("wkb", F.hex(g.to_wkb(F.when(k % 3 == 0, two).otherwise(one))))
    text = F.when(k % 50 == 0, "0103zz").when(k % 2 == 0, F.lower("wkb")).otherwise(F.col("wkb"))
    parts = shape.select(k.alias("id"), tags.alias("tags"), text.alias("wkb"))
    read = layout.decoded(shaping.normalize_tags(parts, ["building", "name"]).withColumnRenamed("wkb", "geometry"))
    return read.select("id", "name", "type", F.size("geometry").alias("parts"), g.area(F.col("geometry")).alias("area"))


@query("p8_point_columns", f"{RECT} SELECT k, minx + w / 2 AS lon, miny + h / 2 AS lat FROM rect")
def point_columns(spark, sf_dir):
    b = fx.buildings(spark, sf_dir)
    return b.select("k", g.point_on_surface(F.col("geometry")).alias("p")).select(
        "k", F.col("p.x").alias("lon"), F.col("p.y").alias("lat")
    )


EDGE_MEASURES = f"""WITH {ref.RECT}, {ref.SHAPE_POINTS}, {ref.SHAPE_EDGES},
sums AS (
  SELECT e.k, r.minx, r.miny,
    sum((x0 - r.minx) * (y1 - r.miny) - (x1 - r.minx) * (y0 - r.miny)) AS twice,
    sum(sqrt((x1 - x0) * (x1 - x0) + (y1 - y0) * (y1 - y0))) AS perimeter,
    sum((x0 + x1 - 2 * r.minx) * ((x0 - r.minx) * (y1 - r.miny) - (x1 - r.minx) * (y0 - r.miny))) AS mx,
    sum((y0 + y1 - 2 * r.miny) * ((x0 - r.minx) * (y1 - r.miny) - (x1 - r.minx) * (y0 - r.miny))) AS my
  FROM edges e JOIN rect r ON r.k = e.k GROUP BY e.k, r.minx, r.miny)"""


@query("g5_area", f"{EDGE_MEASURES} SELECT k, abs(twice) / 2 AS area FROM sums")
def area(spark, sf_dir):
    return fx.shapes(spark, sf_dir).select("k", g.area(F.col("geometry")).alias("area"))


@query("g6_perimeter", f"{EDGE_MEASURES} SELECT k, round(perimeter, 12) AS perimeter FROM sums")
def perimeter(spark, sf_dir):
    return fx.shapes(spark, sf_dir).select("k", F.round(g.perimeter(F.col("geometry")), 12).alias("perimeter"))


@query("g7_centroid", f"""{EDGE_MEASURES} SELECT k, round(minx + mx / (3 * twice), 10) AS x, round(miny + my / (3 * twice), 10) AS y FROM sums""")
def centroid(spark, sf_dir):
    c = fx.shapes(spark, sf_dir).select("k", g.centroid(F.col("geometry")).alias("c"))
    return c.select("k", F.round("c.x", 10).alias("x"), F.round("c.y", 10).alias("y"))


@query("g1_decode_wkb", f"{EDGE_MEASURES} SELECT k, abs(twice) / 2 AS area FROM sums")
def decode_wkb(spark, sf_dir):
    stored = fx.shapes(spark, sf_dir).select("k", g.to_wkb(F.col("geometry")).alias("wkb"))
    nested = stored.select("k", g.from_wkb(F.col("wkb")).alias("geometry"))
    return nested.select("k", g.area(F.col("geometry")).alias("area"))


@query("g2_encode_wkb", f"""{RECT} SELECT k, CASE k % 3 WHEN 0 THEN 77 WHEN 1 THEN 125 ELSE 177 END AS bytes, '010300000001' AS head
FROM rect WHERE k % 3 < 2 UNION ALL SELECT k, 177, '010300000002' FROM rect WHERE k % 3 = 2""")
def encode_wkb(spark, sf_dir):
    stored = fx.shapes(spark, sf_dir).select("k", g.to_wkb(F.col("geometry")).alias("wkb"))
    return stored.select("k", F.length("wkb").alias("bytes"), F.lower(F.substring(F.hex("wkb"), 1, 12)).alias("head"))


@query("g3_bounds", f"{RECT} SELECT k, minx AS xmin, miny AS ymin, minx + w AS xmax, miny + h AS ymax FROM rect")
def bounds(spark, sf_dir):
    return fx.shapes(spark, sf_dir).select("k", g.bounds(F.col("geometry")).alias("b")).select("k", "b.*")


def _reprojected(spark, sf_dir, epsg, digits):
    p = fx.buildings(spark, sf_dir).select("k", g.reproject(F.col("geometry"), 4326, epsg)[0][0][2].alias("p"))
    return p.select("k", F.round("p.x", digits).alias("x"), F.round("p.y", digits).alias("y"))


CORNER = "(SELECT k, minx + w AS lon, miny + h AS lat FROM rect)"


@query("g8_reproject_25832", f"{RECT}, {ref.transverse_mercator(CORNER, 25832, 'moved')} SELECT k, round(east, 2) AS x, round(north, 2) AS y FROM moved")
def reproject_25832(spark, sf_dir):
    return _reprojected(spark, sf_dir, 25832, 2)


@query("g8_reproject_25833", f"{RECT}, {ref.transverse_mercator(CORNER, 25833, 'moved')} SELECT k, round(east, 2) AS x, round(north, 2) AS y FROM moved")
def reproject_25833(spark, sf_dir):
    return _reprojected(spark, sf_dir, 25833, 2)


@query("g8_reproject_3035", f"{RECT}, {ref.laea(CORNER, 'moved')} SELECT k, round(east, 2) AS x, round(north, 2) AS y FROM moved")
def reproject_3035(spark, sf_dir):
    return _reprojected(spark, sf_dir, 3035, 2)


@query("g8_reproject_3857", f"""{RECT} SELECT k, round(6378137.0 * radians(minx + w), 2) AS x,
round(6378137.0 * ln(tan(pi() / 4 + radians(miny + h) / 2)), 2) AS y FROM rect""")
def reproject_3857(spark, sf_dir):
    return _reprojected(spark, sf_dir, 3857, 2)


@query("g8_reproject_round_trip", f"{RECT} SELECT k, code, TRUE AS near FROM rect, (VALUES (3035), (3857)) c(code)")
def round_trip(spark, sf_dir):
    b = fx.buildings(spark, sf_dir)

    def there_and_back(code):
        moved = b.select("k", "bbox", g.reproject(F.col("geometry"), 4326, code).alias("geometry"))
        p = moved.select("k", "bbox", g.reproject(F.col("geometry"), code, 4326)[0][0][2].alias("p"))
        off = F.abs(F.col("p.x") - F.col("bbox.xmax")) + F.abs(F.col("p.y") - F.col("bbox.ymax"))
        return p.select("k", F.lit(code).alias("code"), (off < 1e-9).alias("near"))

    return there_and_back(3035).unionByName(there_and_back(3857))


@query("g9_validate", f"{RECT} SELECT k, k % 11 NOT IN (1, 4, 6, 9) AS valid FROM rect")
def validate(spark, sf_dir):
    return fx.flawed(spark, sf_dir).select("k", g.is_valid(F.col("geometry")).alias("valid"))


@query("g13_point_on_surface", f"""{RECT} SELECT k,
CASE k % 3 WHEN 0 THEN minx + w / 4 WHEN 1 THEN minx + w / 4 ELSE minx + w / 8 END AS x,
CASE k % 3 WHEN 0 THEN miny + h / 2 WHEN 1 THEN miny + 3 * h / 4 ELSE miny + h / 2 END AS y FROM rect""")
def point_on_surface(spark, sf_dir):
    p = fx.shapes(spark, sf_dir).select("k", g.point_on_surface(F.col("geometry")).alias("p"))
    return p.select("k", "p.x", "p.y")


@query("g15_affine", f"""{EDGE_MEASURES} SELECT k, abs(twice) AS area, round(2 * (minx + mx / (3 * twice)) + 3, 9) AS x,
round(-(miny + my / (3 * twice)) - 1, 9) AS y FROM sums""")
def affine(spark, sf_dir):
    moved = fx.shapes(spark, sf_dir).select("k", g.affine(F.col("geometry"), 2.0, 0.0, 0.0, -1.0, 3.0, -1.0).alias("geometry"))
    m = moved.select("k", g.measures(F.col("geometry")).alias("m"))
    return m.select("k", F.col("m.area").alias("area"), F.round("m.cx", 9).alias("x"), F.round("m.cy", 9).alias("y"))


@query("g17_geohash", f"{RECT} SELECT k, {ref.geohash3('minx', 'miny')} AS hash FROM rect")
def geohash(spark, sf_dir):
    from plotgrid.functions.geohash import geohash as encode

    return fx.rectangles(spark, sf_dir).select("k", encode(F.col("minx"), F.col("miny")).alias("hash"))


@query("g23_explode_parts", f"""{RECT} SELECT k, n, (n + 1) * (n + 1) * w * h AS area FROM rect, range(3) t(n) WHERE n <= k % 3""")
def explode_parts(spark, sf_dir):
    x, y, w, h, k = (F.col(c) for c in ("minx", "miny", "w", "h", "k"))
    parts = F.concat(*[
        F.when(k % 3 >= n, g.rectangle(x + n, y, x + n + (n + 1) * w, y + (n + 1) * h)).otherwise(
            F.array().cast(g.GEOMETRY)) for n in range(3)
    ])
    single = shaping.explode_parts(fx.rectangles(spark, sf_dir).select("k", "minx", parts.alias("geometry")))
    n = F.round(F.col("geometry")[0][0][0]["x"] - F.col("minx")).cast("bigint")
    return single.select("k", n.alias("n"), g.area(F.col("geometry")).alias("area"))


@query("a10_metric_rollup", """SELECT user_id AS resource, event_type AS metric,
round(sum(CASE WHEN event_id % 3 = 0 THEN value ELSE value * 2 END), 6) AS total, round(avg(value), 6) AS mean,
max({'ts': ts, 'value': value}).value AS last, max(value * 4) AS greatest, coalesce(min(CASE WHEN event_id % 7 = 0 THEN NULL ELSE value / 2 END), 0) AS least,
round(sum(value * 60), 6) AS rate_total FROM events GROUP BY user_id, event_type""")
def metric_rollup(spark, sf_dir):
    rolled = sm.metric_rollup(fx.metric_points(spark, sf_dir))
    return rolled.withColumns({c: F.round(c, 6) for c in ("total", "mean", "rate_total")})


@query("m1_sample_rollup", """SELECT event_type AS query_id, user_id AS run_id, count(*) AS samples, round(avg(value), 6) AS mean_elapsed,
min(value) AS min_elapsed, max(value) AS max_elapsed, round(sum(value / 4 + value / 8), 6) AS cpu_seconds,
min(CASE WHEN event_id % 9 = 0 THEN -1 ELSE event_id % 50 END) AS min_cardinality,
max(CASE WHEN event_id % 9 = 0 THEN -1 ELSE event_id % 50 END) AS max_cardinality FROM events GROUP BY 1, 2""")
def sample_rollup(spark, sf_dir):
    rolled = sm.sample_rollup(_samples(spark, sf_dir))
    return rolled.withColumns({c: F.round(c, 6) for c in ("mean_elapsed", "cpu_seconds")})


WINDOWS = """windows AS (SELECT event_type AS query_id, user_id AS run_id, CAST(sum(event_id % 1000) AS BIGINT) AS bytes_egress,
  CAST(sum(event_id % 333) AS BIGINT) AS bytes_ingress, min(ts) AS window_start, max(ts) + INTERVAL 5 SECONDS AS window_end,
  (epoch_us(max(ts)) - epoch_us(min(ts)) + 5000000) / 1000000.0::DOUBLE AS duration_seconds FROM events GROUP BY 1, 2)"""


@query("m2_window_totals", f"WITH {WINDOWS} SELECT * FROM windows")
def window_totals(spark, sf_dir):
    return sm.window_totals(_samples(spark, sf_dir))


def _rounded_cost(costs):
    return costs.select("query_id", "run_id", "provider", *[
        F.round(c, 9).alias(c) for c in (*sm.COST_COLUMNS, "total_cost")
    ])


def _cost_sql(provider: str, compute: str = "0", storage: str = "0", operations: str = "0") -> str:
    return f"""WITH {WINDOWS}, parts AS (SELECT *, CAST({compute} AS DOUBLE) AS c, CAST({storage} AS DOUBLE) AS s, CAST({operations} AS DOUBLE) AS o FROM windows)
SELECT query_id, run_id, '{provider}' AS provider, round(c, 9) AS compute_cost, round(s, 9) AS storage_cost, 0.0::DOUBLE AS network_cost,
  round(o, 9) AS operations_cost, round(c + s + o, 9) AS total_cost FROM parts"""


@query("m3_container_cost", _cost_sql("container", "duration_seconds * 3 * 0.0000143::DOUBLE + duration_seconds * 8 * 0.0000016::DOUBLE"))
def container_cost(spark, sf_dir):
    usage = sm.window_totals(_samples(spark, sf_dir)).withColumns({"vcpu_count": F.lit(3.0), "memory_gb": F.lit(8.0)})
    return _rounded_cost(sm.container_cost(usage))


@query("m4_object_store_cost", _cost_sql(
    "object_store", "0", "(run_id * 1000000000.0::DOUBLE / 1073741824) * 0.022::DOUBLE * (duration_seconds / (30.44::DOUBLE * 24 * 3600))",
    "CASE WHEN query_id = 'view' THEN 40 * (0.006::DOUBLE / 10000) ELSE 40 * (0.065::DOUBLE / 10000) END + 0.065::DOUBLE / 10000"))
def object_store_cost(spark, sf_dir):
    windows = sm.window_totals(_samples(spark, sf_dir)).withColumn(
        "operation", F.when(F.col("query_id") == "view", "READ").otherwise("WRITE")
    )
    files = spark.range(1).select(F.lit(40).alias("file_count"), F.lit(0).alias("total_bytes"))
    usage = sm.object_store_usage(windows, files).withColumn("storage_bytes", F.col("run_id") * 1000000000.0)
    return _rounded_cost(sm.object_store_cost(usage))


@query("m5_cluster_cost", _cost_sql(
    "cluster", "(1 + run_id % 8) * 0.75::DOUBLE * 0.15::DOUBLE * (duration_seconds / 3600) + (1 + run_id % 8) * 0.204::DOUBLE * (duration_seconds / 3600)"))
def cluster_cost(spark, sf_dir):
    usage = sm.window_totals(_samples(spark, sf_dir)).withColumn("num_workers", 1 + F.col("run_id") % 8)
    return _rounded_cost(sm.cluster_cost(usage))


@query("m6_database_cost", _cost_sql(
    "database", "duration_seconds * (0.476::DOUBLE / 3600)",
    "(run_id * 1000000000.0::DOUBLE / 1073741824) * 0.15::DOUBLE * (duration_seconds / (30.44::DOUBLE * 24 * 3600))"))
def database_cost(spark, sf_dir):
    usage = sm.window_totals(_samples(spark, sf_dir)).withColumns({
        "storage_used_bytes": F.col("run_id") * 1000000000.0, "network_egress_bytes": F.col("bytes_egress"),
    })
    return _rounded_cost(sm.database_cost(usage))


@query("m7_price_join", """WITH prices(provider, item, price) AS (VALUES ('container', 'vcpu_second', 0.0000143::DOUBLE), ('cluster', 'dbu_price', 0.15::DOUBLE),
  ('database', 'storage_gb_month', 0.15::DOUBLE), ('object_store', 'storage_gb_month', 0.022::DOUBLE))
SELECT event_id, item, price FROM events JOIN prices ON provider = CASE event_id % 4 WHEN 0 THEN 'container' WHEN 1 THEN 'cluster'
  WHEN 2 THEN 'database' ELSE 'object_store' END""")
def price_join(spark, sf_dir):
    e = fx.table(spark, sf_dir, "events").select("event_id", F.expr(
        "CASE event_id % 4 WHEN 0 THEN 'container' WHEN 1 THEN 'cluster' WHEN 2 THEN 'database' ELSE 'object_store' END").alias("provider"))
    wanted = sm.price_table(spark).filter(F.col("item").isin("vcpu_second", "dbu_price", "storage_gb_month"))
    return e.join(F.broadcast(wanted), "provider").select("event_id", "item", "price")


@query("m8_container_usage", """WITH w AS (SELECT event_type AS script_id, count(*) AS duration_seconds FROM events GROUP BY 1)
SELECT script_id, duration_seconds, CASE WHEN script_id IN ('view', 'signup') THEN 3.0 ELSE 1.0 END::DOUBLE AS vcpu_count,
  CASE WHEN script_id IN ('view', 'signup') THEN 8.0 ELSE 2.0 END::DOUBLE AS memory_gb,
  (SELECT round(coalesce(sum(value * 60), 0), 5) FROM events e WHERE e.event_type = script_id AND e.event_id % 2 = 0) AS bytes_ingress,
  (SELECT round(coalesce(sum(value * 60), 0), 5) FROM events e WHERE e.event_type = script_id AND e.event_id % 2 = 1) AS bytes_egress FROM w""")
def container_usage(spark, sf_dir):
    e = fx.table(spark, sf_dir, "events")
    windows = e.groupBy(F.col("event_type").alias("script_id")).agg(F.count("*").alias("duration_seconds"))
    experiments = spark.createDataFrame(
        [("view", 3.0, 8.0, ["signup"]), ("click", 1.0, 2.0, ["purchase", "error"])],
        "id string, cpu double, memory_gb double, related_script_ids array<string>",
    )
    points = fx.metric_points(spark, sf_dir).withColumns({
        "resource": F.col("metric"),
        "metric": F.expr("CASE WHEN event_id % 2 = 0 THEN 'NetworkBytesReceivedPerSecond' ELSE 'NetworkBytesTransmittedPerSecond' END"),
    })
    usage = sm.container_usage(windows, experiments, sm.metric_rollup(points))
    return usage.withColumns({c: F.round(c, 5) for c in ("bytes_ingress", "bytes_egress")})


@query("m8_database_usage", """WITH p AS (SELECT user_id AS resource, event_id, ts, value, event_type AS metric FROM events),
w AS (SELECT user_id AS resource, count(*) AS duration_seconds FROM events GROUP BY user_id)
SELECT w.resource, duration_seconds,
  round(coalesce(avg(value) FILTER (metric = 'view'), 0), 6) AS avg_cpu_percent,
  coalesce(max(value * 4) FILTER (metric = 'view'), 0) AS max_cpu_percent,
  coalesce(min(value / 2) FILTER (metric = 'view' AND event_id % 7 <> 0), 0) AS min_cpu_percent,
  round(coalesce(avg(value) FILTER (metric = 'click'), 0), 6) AS avg_memory_percent,
  coalesce(max(value * 4) FILTER (metric = 'click'), 0) AS max_memory_percent,
  coalesce(min(value / 2) FILTER (metric = 'click' AND event_id % 7 <> 0), 0) AS min_memory_percent,
  round(coalesce(sum(CASE WHEN event_id % 3 = 0 THEN value ELSE value * 2 END) FILTER (metric = 'signup'), 0), 6) AS network_ingress_bytes,
  round(coalesce(sum(CASE WHEN event_id % 3 = 0 THEN value ELSE value * 2 END) FILTER (metric = 'purchase'), 0), 6) AS network_egress_bytes,
  coalesce(max({'ts': ts, 'value': value}) FILTER (metric = 'error').value, 0) AS storage_used_bytes
FROM w LEFT JOIN p USING (resource) GROUP BY w.resource, duration_seconds""")
def database_usage(spark, sf_dir):
    """Events as the metrics of one database per user."""
    names = {"view": "cpu_percent", "click": "memory_percent", "signup": "network_bytes_ingress", "purchase": "network_bytes_egress", "error": "storage_used"}
    points = fx.metric_points(spark, sf_dir)
    renamed = points.replace(names, subset=["metric"])
    windows = points.groupBy("resource").agg(F.count("*").alias("duration_seconds"))
    usage = sm.database_usage(windows, sm.metric_rollup(renamed))
    return usage.withColumns({c: F.round(c, 6) for c in ("avg_cpu_percent", "avg_memory_percent", "network_ingress_bytes", "network_egress_bytes")})


@query("m8_cluster_usage", """SELECT event_type AS query_id, user_id AS run_id, count(*) AS bytes_egress, CAST(2 + user_id % 3 AS BIGINT) AS num_workers
FROM events GROUP BY event_type, user_id""")
def cluster_usage(spark, sf_dir):
    windows = _samples(spark, sf_dir).groupBy("query_id", "run_id").agg(F.count("*").alias("bytes_egress"))
    return sm.cluster_usage(windows, F.col("run_id") % 3 + 2)


def _stages(spark, sf_dir):
    e = fx.table(spark, sf_dir, "events")
    return e.select(
        F.col("user_id").cast("bigint").alias("run_id"), F.col("event_id").cast("bigint").alias("stage_id"),
        F.expr("CASE WHEN event_id % 6 = 0 THEN NULL ELSE event_id * 3 END").cast("bigint").alias("input_bytes_read"),
        F.floor(F.col("value") * 2).cast("bigint").alias("executor_run_time_ms"),
        (F.col("event_id") % 100).cast("bigint").alias("shuffle_read_bytes"),
        (F.col("event_id") % 77).cast("bigint").alias("shuffle_write_bytes"), F.floor("value").cast("bigint").alias("stage_duration_ms"),
    )


@query("a9_stage_rollup", """SELECT user_id AS run_id, CAST(coalesce(sum(CASE WHEN event_id % 6 = 0 THEN NULL ELSE event_id * 3 END), 0) AS BIGINT) AS executor_input_bytes_read,
CAST(sum(floor(value * 2)) AS BIGINT) AS executor_run_time_ms, CAST(sum(event_id % 100) AS BIGINT) AS shuffle_read_bytes,
CAST(sum(event_id % 77) AS BIGINT) AS shuffle_write_bytes, CAST(sum(floor(value)) AS BIGINT) AS sum_stage_duration_ms FROM events GROUP BY user_id""")
def stage_rollup(spark, sf_dir):
    return sm.stage_rollup(_stages(spark, sf_dir))


@query("m9_phase_split", """WITH r AS (SELECT user_id, event_id, CAST(floor(value) AS BIGINT) AS d, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS n FROM events),
t AS (SELECT user_id, CAST(sum(d) AS BIGINT) AS total, '[' || string_agg(d, ',' ORDER BY event_id) || ']' AS stages FROM r GROUP BY user_id)
SELECT user_id AS run_id, greatest(0, user_id * 100 - total) AS driver_collection_time_ms, stages AS stage_durations_ms FROM t""")
def phase_split(spark, sf_dir):
    stages = _stages(spark, sf_dir)
    walls = stages.select("run_id").distinct().withColumn("wall_ms", F.col("run_id") * 100.0)
    return sm.phase_split(stages, walls).select("run_id", "driver_collection_time_ms", "stage_durations_ms")


@query("l5_first_stages", """SELECT user_id AS run_id, event_id AS stage_id FROM events
QUALIFY row_number() OVER (ORDER BY event_id) <= 100""")
def first_stages(spark, sf_dir):
    return _stages(spark, sf_dir).orderBy("stage_id").limit(100).select("run_id", "stage_id")


@query("m10_resource_deltas", """WITH c AS (SELECT user_id AS run_id, event_id % 2 AS iteration, event_id AS seq, epoch_us(ts) / 1000000.0::DOUBLE AS t, value * 3 AS cpu,
    event_id % 50 AS percent, event_id % 4096 AS rss, value * 2 AS u FROM events),
d AS (SELECT *, first_value(t) OVER w AS t0, lag(t) OVER w AS tb, lag(cpu) OVER w AS cb, first_value(u) OVER w AS u0
  FROM c WINDOW w AS (PARTITION BY run_id, iteration ORDER BY t, seq))
SELECT run_id, iteration, seq, round(t - t0, 5) AS elapsed_time, round(t - tb, 5) AS delta_time, round(cpu - cb, 6) AS delta_process_cpu_time,
  percent AS process_cpu_percentage, rss, round(u - u0, 6) AS core_1_user, percent AS core_1_percent FROM d WHERE tb IS NOT NULL""")
def resource_deltas(spark, sf_dir):
    e = fx.table(spark, sf_dir, "events")
    core = F.struct(
        (F.col("value") * 2).alias("user"), F.col("value").alias("system"), F.lit(0.0).alias("idle"), F.lit(0.0).alias("iowait"),
        (F.col("event_id") % 50).alias("percent"),
    )
    counters = e.select(
        F.col("user_id").cast("bigint").alias("run_id"), (F.col("event_id") % 2).alias("iteration"), F.col("event_id").alias("seq"),
        (F.unix_micros(F.col("ts").cast("timestamp")) / 1_000_000).alias("ts"), (F.col("value") * 3).alias("process_cpu_time"),
        (F.col("event_id") % 50).alias("process_cpu_percentage"), (F.col("event_id") % 4096).alias("rss"),
        F.create_map(F.lit("core_1"), core).alias("cores"),
    )
    d = sm.resource_deltas(counters)
    return d.select(
        "run_id", "iteration", "seq", F.round("elapsed_time", 5).alias("elapsed_time"), F.round("delta_time", 5).alias("delta_time"),
        F.round("delta_process_cpu_time", 6).alias("delta_process_cpu_time"), "process_cpu_percentage", "rss",
        F.round(F.col("cores")["core_1"]["user"], 6).alias("core_1_user"), F.col("cores")["core_1"]["percent"].alias("core_1_percent"),
    )


@query("j8_semi_join_ids", f"{RECT} SELECT external_id, region FROM rect WHERE k IN (SELECT p_partkey FROM part WHERE p_size > 25)")
def semi_join_ids(spark, sf_dir):
    ids = fx.table(spark, sf_dir, "part").filter("p_size > 25").select(F.col("p_partkey").alias("id"))
    return f.keep_ids(fx.buildings(spark, sf_dir), ids, "k", "id").select("external_id", "region")


@query("l4_cluster_by_partition_key", f"{RECT} SELECT {KEY} AS partition_key, count(*) AS n, min(k) AS first FROM rect GROUP BY 1")
def cluster_by_key(spark, sf_dir):
    return ds.partitioned(fx.buildings(spark, sf_dir)).groupBy("partition_key").agg(F.count("*").alias("n"), F.min("k").alias("first"))


@query("a9_recorded_run")
def recorded_run(spark, sf_dir):
    """Rollup and phases of a zone join that has just run: read off the application, so no SQL can know the figures."""
    run_id = f"zone-join-{uuid.uuid4().hex}"
    with stages.recorded(spark, run_id) as run:
        zones.spatial_join_counts(fx.buildings(spark, sf_dir), fx.zones(spark)).write.format("noop").mode("overwrite").save()
    return sm.phase_split(run.stages(), run.walls())
