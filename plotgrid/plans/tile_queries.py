"""Tile functions and tile tables of the catalog."""

from __future__ import annotations

from pyspark.sql import functions as F

from plotgrid.functions import geometry as g
from plotgrid.functions import projections as p
from plotgrid.functions import tiles as tl
from plotgrid.operators import aggregates as agg
from plotgrid.operators import dataset as ds
from plotgrid.operators import thinning, tiling
from plotgrid.plans import fixtures as fx
from plotgrid.plans import reference_sql as ref
from plotgrid.plans.registry import query
from plotgrid.session import scratch_folder
from plotgrid.sources import layout

RECT = f"WITH {ref.RECT}"
# Extents as (min_lat, min_lon, max_lat, max_lon).
TRONDHEIM_EXTENT = (63.27, 10.10, 63.52, 10.73)
BUILDINGS_EXTENT = (57.9676151, 4.509825, 71.17004, 31.1565841)
WORLD = tl.WORLD


def _row(lat: str, n: str) -> str:
    return f"((1 - ln(tan(radians({lat})) + 1 / cos(radians({lat}))) / pi()) / 2 * {n})"


@query("g21_lat_lon_to_tile", f"""{RECT}, c AS (
  SELECT k, 5 + k % 12 AS z, least(greatest(minx, 10.10::DOUBLE), 10.73::DOUBLE) AS lon,
    least(greatest(miny, 63.27::DOUBLE), 63.52::DOUBLE) AS lat FROM rect)
SELECT k, CAST(z AS INTEGER) AS z, CAST(floor((lon + 180) / 360 * (2 ** z)) AS INTEGER) AS x,
  CAST(floor({_row('lat', '(2 ** z)')}) AS INTEGER) AS y FROM c""")
def lat_lon_to_tile(spark, sf_dir):
    r = fx.rectangles(spark, sf_dir).withColumn("zoom", F.expr("CAST(5 + k % 12 AS INT)"))
    tile = tl.lat_lon_to_tile(F.col("miny"), F.col("minx"), F.col("zoom"), TRONDHEIM_EXTENT)
    return r.select("k", tile.alias("t")).select("k", "t.*")


ENVELOPE_TILE = "SELECT k, 13 AS z, CAST(k % 8192 AS INTEGER) AS x, CAST((k * 7) % 8192 AS INTEGER) AS y FROM rect"


@query("g18_tile_envelope", f"""{RECT}, t AS ({ENVELOPE_TILE}), s AS (SELECT *, {WORLD!r} / 8192 AS size FROM t)
SELECT k, round(x * size - {WORLD / 2!r}, 5) AS xmin, round({WORLD / 2!r} - (y + 1) * size, 5) AS ymin,
  round((x + 1) * size - {WORLD / 2!r}, 5) AS xmax, round({WORLD / 2!r} - y * size, 5) AS ymax FROM s""")
def tile_envelope(spark, sf_dir):
    r = fx.rectangles(spark, sf_dir)
    x, y = (F.col("k") % 8192).cast("int"), ((F.col("k") * 7) % 8192).cast("int")
    e = r.select("k", tl.tile_envelope(F.lit(13), x, y).alias("e"))
    return e.select("k", *[F.round(f"e.{c}", 5).alias(c) for c in ("xmin", "ymin", "xmax", "ymax")])


def placed(zooms: list[int], slim: bool = False) -> str:
    """CTE ``placed``: rectangles beside the tiles they touch, with bounds in tile units."""
    radius = repr(p.MERCATOR_RADIUS)

    def mercator_y(lat):
        return f"({radius} * atanh(sin(radians({lat}))))"

    return f"""spans AS (
  SELECT k, minx, miny, w, h, z, 2.0::DOUBLE ** z AS n, unnest(range(
      CAST(floor((minx + 180) / 360 * 2.0::DOUBLE ** z - 1e-6) AS BIGINT),
      CAST(floor((minx + w + 180) / 360 * 2.0::DOUBLE ** z + 1e-6) AS BIGINT) + 1)) AS x
  FROM rect, (VALUES {','.join(f'({z})' for z in zooms)}) v(z)),
spread AS (
  SELECT *, unnest(range(CAST(floor({_row('(miny + h)', 'n')} - 1e-6) AS BIGINT), CAST(floor({_row('miny', 'n')} + 1e-6) AS BIGINT) + 1)) AS y
  FROM spans),
touching AS (
  SELECT * FROM spread WHERE minx <= (x + 1) / n * 360 - 180 AND minx + w >= x / n * 360 - 180
    AND miny <= degrees(atan(sinh(pi() * (1 - 2 * y / n)))) AND miny + h >= degrees(atan(sinh(pi() * (1 - 2 * (y + 1) / n))))),
placed AS (
  SELECT k, z, x, y,
    least(4352, greatest(-256, floor(({radius} * radians(minx) - (x * ({WORLD!r} / n) - {WORLD / 2!r})) / ({WORLD!r} / n) * 4096 + 0.5))) AS px0,
    least(4352, greatest(-256, floor(({radius} * radians(minx + w) - (x * ({WORLD!r} / n) - {WORLD / 2!r})) / ({WORLD!r} / n) * 4096 + 0.5))) AS px1,
    least(4352, greatest(-256, floor((({WORLD / 2!r} - y * ({WORLD!r} / n)) - {mercator_y('(miny + h)')}) / ({WORLD!r} / n) * 4096 + 0.5))) AS py0,
    least(4352, greatest(-256, floor((({WORLD / 2!r} - y * ({WORLD!r} / n)) - {mercator_y('miny')}) / ({WORLD!r} / n) * 4096 + 0.5))) AS py1
  FROM touching)"""


@query("g19_to_tile_space", f"""{RECT}, {placed([13, 18])}
SELECT k, z, CAST(x AS INTEGER) AS x, CAST(y AS INTEGER) AS y, px0 AS xmin, py0 AS ymin, px1 AS xmax, py1 AS ymax
FROM placed WHERE px0 < px1 AND py0 < py1""")
def to_tile_space(spark, sf_dir):
    long = tiling.tile_geometries(fx.buildings(spark, sf_dir), [13, 18], "k")
    box = g.bounds(F.col("geometry"))
    return long.select(F.col("feature_id").alias("k"), "z", "x", "y", *[
        box[c].alias(c) for c in ("xmin", "ymin", "xmax", "ymax")
    ])


@query("t4a_candidate_tiles", f"""WITH c AS (
  SELECT CAST(floor((10.10::DOUBLE + 180) / 360 * 8192) AS BIGINT) AS x0, CAST(floor((10.73::DOUBLE + 180) / 360 * 8192) AS BIGINT) AS x1,
    CAST(floor({_row('63.52::DOUBLE', '8192')}) AS BIGINT) AS y0, CAST(floor({_row('63.27::DOUBLE', '8192')}) AS BIGINT) AS y1),
tiles AS (SELECT x, unnest(range(y0, y1 + 1)) AS y FROM (SELECT *, unnest(range(x0, x1 + 1)) AS x FROM c)),
{ref.RECT}, {placed([13])}
SELECT 13 AS z, CAST(t.x AS INTEGER) AS x, CAST(t.y AS INTEGER) AS y, count(p.k) AS n
FROM tiles t LEFT JOIN placed p ON p.x = t.x AND p.y = t.y GROUP BY t.x, t.y""")
def candidate_tiles(spark, sf_dir):
    """Candidates of the Trondheim box with the number of buildings on each."""
    candidates = tiling.candidate_tiles(spark, TRONDHEIM_EXTENT, 13)
    counts = tiling.tile_counts(tiling.feature_tiles(fx.buildings(spark, sf_dir), [13], "k"))
    return candidates.join(counts, tiling.TILE, "left").withColumn("n", F.coalesce("n", F.lit(0)))


def _candidates_sql() -> str:
    south, west, north, east = (f"{v}::DOUBLE" for v in BUILDINGS_EXTENT)
    return f"""x BETWEEN floor(({west} + 180) / 360 * 8192) AND floor(({east} + 180) / 360 * 8192)
  AND y BETWEEN floor({_row(north, '8192')}) AND floor({_row(south, '8192')})"""


@query("t4b_tiles_with_data", f"""{RECT}, {placed([13])}
SELECT DISTINCT z, CAST(x AS INTEGER) AS x, CAST(y AS INTEGER) AS y FROM placed WHERE {_candidates_sql()}""")
def tiles_with_data(spark, sf_dir):
    candidates = tiling.candidate_tiles(spark, BUILDINGS_EXTENT, 13)
    return tiling.tiles_with_data(candidates, fx.buildings(spark, sf_dir), 13, "k")


@query("t4c_build_tiles", f"""{RECT}, {placed([9, 13])}
SELECT z, CAST(x AS INTEGER) AS x, CAST(y AS INTEGER) AS y, count(*) AS n, CAST(sum(k) AS BIGINT) AS ids,
  sum((px1 - px0) * (py1 - py0)) AS area
FROM placed WHERE px0 < px1 AND py0 < py1 GROUP BY z, x, y""")
def build_tiles(spark, sf_dir):
    tiles = tiling.build_tiles(fx.buildings(spark, sf_dir), [9, 13], "k", chunk_features=40)
    features = tiles.select("z", "x", "y", F.explode("features").alias("f")).select("z", "x", "y", "f.*")
    return features.withColumn("area", g.area(F.col("geometry"))).groupBy("z", "x", "y").agg(
        F.count("*").alias("n"), F.sum("feature_id").alias("ids"), F.sum("area").alias("area")
    )


@query("g20_tile_features", f"""{RECT}, {placed([12])}
SELECT z, CAST(x AS INTEGER) AS x, CAST(y AS INTEGER) AS y, count(*) AS n FROM placed WHERE px0 < px1 AND py0 < py1 GROUP BY z, x, y""")
def tile_features(spark, sf_dir):
    tiles = tiling.build_tiles(fx.buildings(spark, sf_dir), [12], "k")
    return tiles.groupBy("z", "x", "y").agg(F.sum("n").alias("n"))


@query("t4d_tile_pyramid", f"""{RECT}, {placed([8, 10, 12])},
ranked AS (SELECT *, (px1 - px0) * (py1 - py0) AS tile_area, row_number() OVER (
    PARTITION BY z, x, y ORDER BY (px1 - px0) * (py1 - py0) DESC, k) AS rank FROM placed WHERE px0 < px1 AND py0 < py1)
SELECT z, CAST(x AS INTEGER) AS x, CAST(y AS INTEGER) AS y, k AS feature_id, tile_area FROM ranked WHERE rank <= 20""")
def tile_pyramid(spark, sf_dir):
    kept = tiling.tile_pyramid(fx.buildings(spark, sf_dir), [8, 10, 12], "k", max_features=20)
    return kept.drop("geometry", "dropped")


@query("j10_tile_lookup", f"""{RECT}, {placed([13])},
store AS (SELECT x, y, count(*) AS n FROM placed WHERE px0 < px1 AND py0 < py1 GROUP BY x, y),
bounds AS (
  SELECT CAST(floor((10.10::DOUBLE + 180) / 360 * 8192) AS BIGINT) AS x0, CAST(floor((10.73::DOUBLE + 180) / 360 * 8192) AS BIGINT) AS x1,
    CAST(floor({_row('63.52::DOUBLE', '8192')}) AS BIGINT) AS y0, CAST(floor({_row('63.27::DOUBLE', '8192')}) AS BIGINT) AS y1),
candidates AS (SELECT x, unnest(range(y0, y1 + 1)) AS y FROM (SELECT *, unnest(range(x0, x1 + 1)) AS x FROM bounds)),
numbered AS (SELECT x, y, row_number() OVER (ORDER BY x, y) - 1 AS at, count(*) OVER () AS total FROM candidates)
SELECT r.i AS request_id, 13 AS z, CAST(c.x AS INTEGER) AS x, CAST(c.y AS INTEGER) AS y, s.n
FROM range(100000) r(i) JOIN numbered c ON c.at = r.i % c.total LEFT JOIN store s ON s.x = c.x AND s.y = c.y""")
def tile_lookup(spark, sf_dir):
    """100,000 requests that cycle through the candidate tiles of a box."""
    candidates = tiling.candidate_tiles(spark, TRONDHEIM_EXTENT, 13)
    requests = agg.cycle_rows(candidates, ["z", "x"], ["y"], 100_000)
    store = tiling.build_tiles(fx.buildings(spark, sf_dir), [13], "k")
    return tiling.tile_lookup(requests, store).select("request_id", "z", "x", "y", "n")


@query("j10_single_tile", f"""{RECT}, {placed([13])},
store AS (SELECT x, y, count(*) AS n FROM placed WHERE px0 < px1 AND py0 < py1 GROUP BY x, y),
one AS (SELECT CAST(floor((minx + 180) / 360 * 8192) AS BIGINT) AS x, CAST(floor({_row('miny', '8192')}) AS BIGINT) AS y FROM rect WHERE k = 17)
SELECT 13 AS z, CAST(o.x AS INTEGER) AS x, CAST(o.y AS INTEGER) AS y, s.n FROM one o LEFT JOIN store s ON s.x = o.x AND s.y = o.y""")
def single_tile(spark, sf_dir):
    one = fx.rectangles(spark, sf_dir).filter("k = 17").select(
        tl.lat_lon_to_tile(F.col("miny"), F.col("minx"), 13).alias("t")
    ).select("t.*")
    return tiling.tile_lookup(one, tiling.build_tiles(fx.buildings(spark, sf_dir), [13], "k")).select("z", "x", "y", "n")


@query("j10_lookup_of_chunks", f"""{RECT}, {placed([9])}
SELECT z, CAST(x AS INTEGER) AS x, CAST(y AS INTEGER) AS y, count(*) AS n FROM placed WHERE px0 < px1 AND py0 < py1 GROUP BY z, x, y""")
def lookup_of_chunks(spark, sf_dir):
    """Every tile asked for once, from a store whose tiles are cut into many chunks."""
    store = tiling.build_tiles(fx.buildings(spark, sf_dir), [9], "k", chunk_features=40)
    return tiling.tile_lookup(store.select("z", "x", "y").distinct(), store).select("z", "x", "y", "n")


@query("t4d_dropped_features", f"""{RECT}, {placed([8, 10])}
SELECT z, CAST(x AS INTEGER) AS x, CAST(y AS INTEGER) AS y, least(count(*), 20) AS kept, greatest(count(*) - 20, 0) AS dropped
FROM placed WHERE px0 < px1 AND py0 < py1 GROUP BY z, x, y""")
def dropped_features(spark, sf_dir):
    kept = tiling.tile_pyramid(fx.buildings(spark, sf_dir), [8, 10], "k", max_features=20)
    return kept.groupBy("z", "x", "y").agg(F.count("*").alias("kept"), F.max("dropped").alias("dropped"))


@query("l6_tile_list", """SELECT k, CAST(CASE k % 5 WHEN 3 THEN 1 ELSE 0 END AS INTEGER) AS place,
  CASE WHEN k % 5 IN (0, 3) THEN 13 END AS z, CASE WHEN k % 5 IN (0, 3) THEN CAST(k % 8192 AS INTEGER) END AS x, CASE WHEN k % 5 IN (0, 3) THEN 7 END AS y,
  CASE k % 5 WHEN 1 THEN '["a",1,2]' WHEN 2 THEN '[1,2]' END AS item FROM (SELECT o_orderkey AS k FROM orders) WHERE k % 5 <> 4
UNION ALL SELECT o_orderkey, 0, NULL, NULL, NULL, '17' FROM orders WHERE o_orderkey % 5 = 3
UNION ALL SELECT o_orderkey, NULL, NULL, NULL, NULL, 'no list' FROM orders WHERE o_orderkey % 5 = 4""")
def tile_list(spark, sf_dir):
    """Request lists as JSON, one in five good, the others bad in different ways."""
    k = F.col("o_orderkey")
    tile = F.concat(F.lit("[13,"), (k % 8192).cast("string"), F.lit(",7]"))
    text = (
        F.when(k % 5 == 0, F.concat(F.lit("["), tile, F.lit("]"))).when(k % 5 == 1, F.lit('[["a", 1, 2]]')).when(k % 5 == 2, F.lit("[[1,2]]"))
        .when(k % 5 == 3, F.concat(F.lit("[17, "), tile, F.lit("]"))).otherwise(F.lit("no list"))
    )
    lists = fx.table(spark, sf_dir, "orders").select(k.alias("k"), text.alias("value"))
    requests, rejected = tiling.parse_tile_list(lists)
    return requests.unionByName(rejected, allowMissingColumns=True)


@query("l6_cycle_rows", """WITH n AS (SELECT p_partkey, row_number() OVER (ORDER BY p_brand, p_partkey) - 1 AS at, count(*) OVER () AS total FROM part)
SELECT i AS request_id, p_partkey FROM range(50000) r(i) JOIN n ON n.at = r.i % n.total""")
def cycle_rows(spark, sf_dir):
    parts = fx.table(spark, sf_dir, "part").select("p_brand", "p_partkey")
    return agg.cycle_rows(parts, ["p_brand"], ["p_partkey"], 50_000).select("request_id", "p_partkey")


RELEASE = "2026-04-02.0"
FILE_SCHEMA = "k bigint, geometry binary, bbox struct<xmin:double,ymin:double,xmax:double,ymax:double>"


def _release(spark, sf_dir):
    """A written release, as the tile server of a dataset would find it."""
    root = scratch_folder(spark, "release")
    layout.write_buildings(ds.with_partition_key(fx.buildings(spark, sf_dir)), root, RELEASE, "small")
    return layout.scan_buildings(spark, root, RELEASE, "small", schema=FILE_SCHEMA)


@query("j10_on_demand", f"""{RECT}, {placed([13])},
bounds AS (
  SELECT CAST(floor((10.10::DOUBLE + 180) / 360 * 8192) AS BIGINT) AS x0, CAST(floor((10.73::DOUBLE + 180) / 360 * 8192) AS BIGINT) AS x1,
    CAST(floor({_row('63.52::DOUBLE', '8192')}) AS BIGINT) AS y0, CAST(floor({_row('63.27::DOUBLE', '8192')}) AS BIGINT) AS y1),
candidates AS (SELECT x, unnest(range(y0, y1 + 1)) AS y FROM (SELECT *, unnest(range(x0, x1 + 1)) AS x FROM bounds)),
made AS (SELECT x, y, count(*) AS n, CAST(sum(k) AS BIGINT) AS ids, sum((px1 - px0) * (py1 - py0)) AS area
  FROM placed WHERE px0 < px1 AND py0 < py1 GROUP BY x, y)
SELECT 13 AS z, CAST(c.x AS INTEGER) AS x, CAST(c.y AS INTEGER) AS y, n, ids, area FROM candidates c LEFT JOIN made m ON m.x = c.x AND m.y = c.y""")
def on_demand(spark, sf_dir):
    """All tiles of the Trondheim box, made on request from a written release."""
    requests = tiling.candidate_tiles(spark, TRONDHEIM_EXTENT, 13)
    tiles = tiling.tiles_on_request(requests, _release(spark, sf_dir), "k", chunk_features=40)
    made = tiles.select("z", "x", "y", F.explode("features").alias("f")).select("z", "x", "y", "f.*")
    totals = made.withColumn("area", g.area(F.col("geometry"))).groupBy("z", "x", "y").agg(
        F.count("*").alias("n"), F.sum("feature_id").alias("ids"), F.sum("area").alias("area")
    )
    return requests.join(totals, tiling.TILE, "left")


@query("j10_on_demand_zooms", f"""{RECT}, {placed([6, 9, 12, 15, 18])},
ends AS (SELECT minx, miny FROM rect WHERE k = (SELECT min(k) FROM rect) OR k = (SELECT max(k) FROM rect)),
wanted AS (SELECT DISTINCT z, CAST(floor((minx + 180) / 360 * (2 ** z)) AS BIGINT) AS x, CAST(floor({_row('miny', '(2 ** z)')}) AS BIGINT) AS y
  FROM ends, (VALUES (6), (9), (12), (15), (18)) v(z))
SELECT z, CAST(x AS INTEGER) AS x, CAST(y AS INTEGER) AS y, count(*) AS n, CAST(sum(k) AS BIGINT) AS ids
FROM placed JOIN wanted USING (z, x, y) WHERE px0 < px1 AND py0 < py1 GROUP BY z, x, y""")
def on_demand_zooms(spark, sf_dir):
    """The tiles above the first and the last building at several zooms, which lie far apart."""
    r = fx.rectangles(spark, sf_dir)
    ends = r.agg(*[f(F.struct("k", "minx", "miny")).alias(f.__name__) for f in (F.min, F.max)])
    spots = ends.select(F.explode(F.array("min", "max")).alias("e")).withColumn("zoom", F.explode(F.array(*map(F.lit, (6, 9, 12, 15, 18)))))
    requests = spots.select(tl.lat_lon_to_tile(F.col("e.miny"), F.col("e.minx"), F.col("zoom")).alias("t")).select("t.*")
    made = tiling.requested_geometries(requests, _release(spark, sf_dir), "k")
    return made.groupBy("z", "x", "y").agg(F.count("*").alias("n"), F.sum("feature_id").alias("ids"))


def _curve(source: str, key: str, x: str, y: str, bits: int) -> str:
    """CTE ``curve``: (key, place) of cells along the Hilbert curve, one level of the square after the other."""
    top = 1 << bits - 1
    return f"""steps AS (
  SELECT {key} AS key, CAST({top} AS BIGINT) AS s, {x} AS cx, {y} AS cy, CAST(0 AS BIGINT) AS place FROM {source}
  UNION ALL
  SELECT key, s // 2,
    CASE WHEN cy & s <> 0 THEN cx WHEN cx & s <> 0 THEN s - 1 - (cy & (s - 1)) ELSE cy END,
    CASE WHEN cy & s <> 0 THEN cy WHEN cx & s <> 0 THEN s - 1 - (cx & (s - 1)) ELSE cx END,
    place + s * s * CASE WHEN cx & s <> 0 THEN CASE WHEN cy & s <> 0 THEN 2 ELSE 3 END ELSE CASE WHEN cy & s <> 0 THEN 1 ELSE 0 END END
  FROM steps WHERE s > 0),
curve AS (SELECT key, place FROM steps WHERE s = 0)"""


GAPS = f"""WITH RECURSIVE {ref.RECT}, {placed([8, 10, 12])},
drawn AS (SELECT *, CAST(floor((px0 + px1) / 2) AS BIGINT) + 256 AS mx, CAST(floor((py0 + py1) / 2) AS BIGINT) + 256 AS my
  FROM placed WHERE px0 < px1 AND py0 < py1),
numbered AS (SELECT row_number() OVER (ORDER BY z, x, y, k) AS id, * FROM drawn),
{_curve('numbered', 'id', 'mx', 'my', 16)},
gaps AS (SELECT z, x, y, k, place, place - lag(place) OVER (PARTITION BY z, x, y ORDER BY place, k) AS gap FROM numbered JOIN curve ON key = id),
reached AS (SELECT *, count(*) OVER (PARTITION BY z, x, y) AS n,
  count(*) OVER (PARTITION BY z, x, y ORDER BY coalesce(gap, 1000000000) DESC) AS reach FROM gaps),
kept AS (SELECT * FROM reached WHERE n <= 20 OR gap IS NULL OR reach <= 20)"""


def _densest(spark, sf_dir):
    return thinning.drop_densest(tiling.tile_geometries(fx.buildings(spark, sf_dir), [8, 10, 12], "k"), 20)


@query("t4d_drop_densest", f"{GAPS} SELECT z, CAST(x AS INTEGER) AS x, CAST(y AS INTEGER) AS y, k AS feature_id, place, gap FROM kept")
def drop_densest(spark, sf_dir):
    """What stays of every tile when it drops the features that stand densest."""
    return _densest(spark, sf_dir).select("z", "x", "y", "feature_id", "place", "gap")


@query("t4d_densest_dropped", f"""{GAPS}
SELECT z, CAST(x AS INTEGER) AS x, CAST(y AS INTEGER) AS y, count(*) AS kept, any_value(n) - count(*) AS dropped FROM kept GROUP BY z, x, y""")
def densest_dropped(spark, sf_dir):
    return _densest(spark, sf_dir).groupBy("z", "x", "y").agg(F.count("*").alias("kept"), F.max("dropped").alias("dropped"))


@query("t4d_zoom_choice", f"""WITH RECURSIVE {ref.RECT},
world AS (SELECT k, ((minx + (minx + w)) / 2 + 180) / 360 AS wx, {_row('((miny + (miny + h)) / 2)', '1')} AS wy FROM rect),
cells AS (SELECT k, CAST(floor(wx * 1048576) AS BIGINT) AS mx, CAST(floor(wy * 1048576) AS BIGINT) AS my FROM world),
{_curve('cells', 'k', 'mx', 'my', 20)},
follow AS (SELECT sqrt((wx - lag(wx) OVER along) ** 2 + (wy - lag(wy) OVER along) ** 2) AS apart
  FROM world JOIN curve ON key = k WINDOW along AS (ORDER BY place, k)),
parted AS (SELECT apart, row_number() OVER (ORDER BY apart) AS nth, count(*) OVER () AS n FROM follow WHERE apart > 0)
SELECT n AS neighbours, round(apart, 12) AS distance, CAST(greatest(0, least(22, ceil(log2(8.0::DOUBLE / 4096 / apart)))) AS INTEGER) AS zoom
FROM parted WHERE nth = ceil(n * 0.5)""")
def zoom_choice(spark, sf_dir):
    found = thinning.choose_zoom(fx.buildings(spark, sf_dir), "k")
    return found.withColumn("distance", F.round("distance", 12))
