"""Vector tiles as tables: one row per tile and feature, grouped into tile rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from plotgrid.functions import geometry as g
from plotgrid.functions import tiles as tl
from plotgrid.operators.sizes import at_most, broadcast_if_small
from plotgrid.session import cut_lineage
from plotgrid.sources import layout

TILE = ["z", "x", "y"]
SLACK = 1e-6
CHUNK_FEATURES = 50_000
# Boxes that a request list is brought down to, and the deepest zoom of a tile.
REQUEST_BOXES = 16
MAX_ZOOM = 22
# Parts of a tile that are ranked apart, then together in fewer parts.
RANK_PARTS = (64, 8, 1)


def candidate_tiles(spark: SparkSession, bbox: tuple[float, float, float, float], z: int) -> DataFrame:
    """All tiles at one zoom that cover (min_lat, min_lon, max_lat, max_lon)."""
    south, west, north, east = (F.lit(float(v)) for v in bbox)
    corners = spark.range(1).select(
        tl.lat_lon_to_tile(north, west, z, bbox).alias("nw"), tl.lat_lon_to_tile(south, east, z, bbox).alias("se")
    )
    columns = corners.select("nw", "se", F.explode(F.sequence("nw.x", "se.x")).alias("x"))
    # One task per group of tile columns; the rows of a column are generated there.
    return columns.repartition("x").select(
        F.lit(z).alias("z"), "x", F.explode(F.sequence("nw.y", "se.y")).alias("y")
    )


def feature_tiles(df: DataFrame, zooms: list[int], id_column: str, wanted: DataFrame | None = None) -> DataFrame:
    """One row per feature and tile it shares a point with: id, geometry, bbox, z, x, y.

    Tiles under the feature's box come from arithmetic (no join); the exact test runs only
    for features that reach over a tile border. With ``wanted`` (distinct z, x, y) other tiles fall away before it.
    """
    placed = _under_boxes(df, zooms, id_column, wanted)
    frame = tl.tile_bounds(*[F.col(c) for c in TILE])
    return placed.filter(g.intersects_box(F.col("geometry"), F.col("bbox"), frame))


def _under_boxes(df: DataFrame, zooms: list[int], id_column: str, wanted: DataFrame | None) -> DataFrame:
    """One row per feature and tile below its box."""
    n = F.pow(F.lit(2.0), F.col("z"))

    def column(lon):
        return (lon + 180.0) / 360.0 * n

    def row(lat):
        r = F.radians(F.greatest(F.lit(-tl.MAX_LATITUDE), F.least(lat, F.lit(tl.MAX_LATITUDE))))
        return (F.lit(1.0) - F.ln(F.tan(r) + F.lit(1.0) / F.cos(r)) / F.pi()) / 2.0 * n

    def span(low, high):
        first = F.greatest(F.lit(0), F.floor(low - SLACK).cast("int"))
        last = F.least((n - 1).cast("int"), F.floor(high + SLACK).cast("int"))
        return F.explode(F.when(first <= last, F.sequence(first, last)))

    placed = (
        df.select(F.col(id_column).alias("feature_id"), "geometry", "bbox")
        .withColumn("z", F.explode(F.array(*[F.lit(v) for v in zooms])))
        .withColumn("x", span(column(F.col("bbox.xmin")), column(F.col("bbox.xmax"))))
        .withColumn("y", span(row(F.col("bbox.ymax")), row(F.col("bbox.ymin"))))
    )
    if wanted is not None:
        placed = placed.join(broadcast_if_small(wanted), TILE, "left_semi")
    return placed


def tile_geometries(df: DataFrame, zooms: list[int], id_column: str, wanted: DataFrame | None = None) -> DataFrame:
    """Long form of a tile set: z, x, y, feature_id, geometry in tile units."""
    return measured_geometries(df, zooms, id_column, wanted).drop("tile_area")


def measured_geometries(df: DataFrame, zooms: list[int], id_column: str, wanted: DataFrame | None = None) -> DataFrame:
    """The same with ``tile_area``. Test, cut and area are one Arrow function, so a task keeps one Python worker."""
    tile = [F.col(c) for c in TILE]
    placed = _under_boxes(df, zooms, id_column, wanted)
    near = placed.filter(g.boxes_overlap(F.col("bbox"), tl.tile_bounds(*tile)))
    cut = near.withColumn("_cut", tl.tile_shape(F.col("geometry"), F.col("bbox"), *tile)).filter(F.col("_cut.geometry").isNotNull())
    return cut.select(*TILE, "feature_id", "_cut.geometry", F.col("_cut.area").alias("tile_area"))


def parse_tile_list(lists: DataFrame, column: str = "value") -> tuple[DataFrame, DataFrame]:
    """Tile requests from rows of JSON text ``[[z, x, y], ..]``: (requests, rejected).

    Requests carry the other columns and ``place``, the item's place in its list. Numbers with a fraction are
    cut, whole numbers may be given as text. A text that is no list is rejected as it is, a bad item by itself.
    """
    others = [c for c in lists.columns if c != column]
    text = F.when(F.trim(column).startswith("["), F.col(column))
    parsed = lists.withColumn("_items", F.from_json(text, "array<string>"))
    listed = parsed.filter(F.col("_items").isNotNull()).select(*others, F.posexplode("_items").alias("place", "item"))
    split = listed.withColumn("_t", F.from_json(F.when(F.col("item").startswith("["), F.col("item")), "array<string>"))
    cells = split.withColumn("_n", F.transform(
        "_t", lambda v: F.when(v.rlike(r"^\s*[-+]?\d+(\.\d*)?\s*$"), F.regexp_extract(v, r"([-+]?\d+)", 1).try_cast("int"))
    ))
    good = (F.size("_n") == 3) & ~F.exists("_n", lambda v: v.isNull())
    good = F.coalesce(good, F.lit(False))
    requests = cells.filter(good).select(*others, "place", *[F.col("_n")[i].alias(c) for i, c in enumerate(TILE)])
    bad_items = cells.filter(~good).select(*others, "place", "item")
    bad_texts = parsed.filter(F.col("_items").isNull()).select(*others, F.lit(None).cast("int").alias("place"), F.col(column).alias("item"))
    return requests, bad_items.unionByName(bad_texts)


def tile_counts(long: DataFrame) -> DataFrame:
    return long.groupBy(*TILE).agg(F.count("*").alias("n"))


def tile_features(long: DataFrame, chunk_features: int = CHUNK_FEATURES) -> DataFrame:
    """Tile rows ``z, x, y, chunk, features, n``.

    A tile with many features is split into several chunks of about ``chunk_features``, so
    that no task collects an unbounded tile; together the chunks hold every feature. Id and
    shape choose the chunk, so rows without an id spread as well.
    """
    crowded = tile_counts(long).filter(F.col("n") > chunk_features).select(
        *TILE, F.ceil(F.col("n") / chunk_features).alias("chunks")
    )
    if at_most(crowded, 100_000):
        crowded = F.broadcast(crowded)
    chunk = F.coalesce(F.pmod(F.xxhash64("feature_id", "geometry"), F.col("chunks")), F.lit(0)).cast("int")
    return (
        long.join(crowded, TILE, "left").withColumn("chunk", chunk)
        .groupBy(*TILE, "chunk")
        .agg(F.collect_list(F.struct("feature_id", "geometry")).alias("features"), F.count("*").alias("n"))
    )


def build_tiles(df: DataFrame, zooms: list[int], id_column: str, chunk_features: int = CHUNK_FEATURES) -> DataFrame:
    long = cut_lineage(tile_geometries(df, zooms, id_column), "tiles")
    return tile_features(long, chunk_features)


def tile_pyramid(df: DataFrame, zooms: list[int], id_column: str, max_features: int | None) -> DataFrame:
    """Long form of all zooms with ``dropped``, the number of features a tile lost.

    With ``max_features`` only that many of the largest features of a tile stay (equal areas by id,
    then by shape); None keeps all. The limit is taken in steps: inside hash parts of a tile, then
    among the survivors of eight parts each time, so a low-zoom tile that holds everything is
    not ranked by one task.
    """
    long = measured_geometries(df, zooms, id_column)
    if max_features is None:
        return long.withColumn("dropped", F.lit(0).cast("bigint"))
    shape = F.xxhash64("feature_id", "geometry")
    order = [F.desc("tile_area"), F.asc_nulls_last("feature_id"), F.asc("shape")]
    kept = long.withColumn("shape", shape)
    for parts in RANK_PARTS:
        within = Window.partitionBy(*TILE, F.pmod("shape", F.lit(parts))).orderBy(*order)
        kept = kept.withColumn("rank", F.row_number().over(within)).filter(F.col("rank") <= max_features)
    lost = tile_counts(long).select(*TILE, F.greatest(F.col("n") - max_features, F.lit(0)).alias("dropped"))
    return kept.drop("shape", "rank").join(lost, TILE)


def tiles_with_data(candidates: DataFrame, df: DataFrame, z: int, id_column: str) -> DataFrame:
    """Candidate tiles that hold at least one feature."""
    used = feature_tiles(df, [z], id_column).select(*TILE).distinct()
    return candidates.join(used, TILE, "left_semi")


def _wanted(requests: DataFrame, tiles: DataFrame) -> DataFrame:
    """Tile rows that are asked for. The wanted keys filter the store (broadcast when proven
    small), so the store itself is never shuffled for a request list."""
    keys = requests.select(*TILE).distinct()
    if at_most(keys, 200_000):
        keys = F.broadcast(keys)
    return tiles.join(keys, TILE, "left_semi")


def tile_lookup(requests: DataFrame, tiles: DataFrame) -> DataFrame:
    """One row per request with ``n``, the tile's number of features over all its chunks;
    NULL for a missing tile."""
    counts = _wanted(requests, tiles).groupBy(*TILE).agg(F.sum("n").alias("n"))
    return requests.join(counts, TILE, "left")


def tile_chunks(requests: DataFrame, tiles: DataFrame) -> DataFrame:
    """The stored chunks of every requested tile once, keyed by z, x, y, chunk."""
    return _wanted(requests, tiles)


def request_boxes(requests: DataFrame, most: int = REQUEST_BOXES) -> tuple[list[int], list[tuple[float, float, float, float]]]:
    """(zooms, boxes): at most ``most`` boxes in degrees that together cover all requested tiles.

    Tiles are joined under their common ancestors, at the deepest zoom that has few enough of these, so near requests share
    a box and far ones do not. Counting and joining run in Spark; only the boxes come to the driver. Tiles off the map have none.
    """
    tiles = _on_map(requests).distinct()

    def ancestor(level) -> list:
        up = F.greatest(F.col("z") - level, F.lit(0))
        return [F.least(F.col("z"), level), *[F.call_function("shiftright", F.col(c), up) for c in ("x", "y")]]

    levels = tiles.withColumn("level", F.explode(F.sequence(F.lit(0), F.lit(MAX_ZOOM))))
    counts = dict(
        levels.groupBy("level").agg(F.approx_count_distinct(F.struct(*ancestor(F.col("level"))), 0.02)).collect()
    )
    b = tl.tile_bounds(*[F.col(c) for c in TILE])
    for level in sorted(counts, reverse=True):
        if counts[level] > most and level:
            continue
        found = (
            tiles.select("z", F.struct(*ancestor(F.lit(level))).alias("under"), b.alias("b"))
            .groupBy("under").agg(
                F.min("b.xmin"), F.min("b.ymin"), F.max("b.xmax"), F.max("b.ymax"), F.collect_set("z").alias("zooms")
            ).limit(most + 1).collect()
        )
        if len(found) <= most:
            return sorted({z for r in found for z in r["zooms"]}), [tuple(r[1:5]) for r in found]
    return [], []


def _on_map(requests: DataFrame) -> DataFrame:
    """The tiles (z, x, y) of a request list that exist."""
    side = F.pow(F.lit(2), F.col("z"))
    real = F.col("z").between(0, MAX_ZOOM) & (F.col("x") >= 0) & (F.col("x") < side) & (F.col("y") >= 0) & (F.col("y") < side)
    return requests.filter(real).select(*TILE)


def in_boxes(df: DataFrame, boxes: list[tuple[float, float, float, float]]) -> DataFrame:
    """Rows whose ``bbox`` shares a point with one of a few boxes; the comparisons reach the scan."""
    near = F.lit(False)
    for xmin, ymin, xmax, ymax in boxes:
        near = near | (
            (F.col("bbox.xmin") <= xmax) & (F.col("bbox.xmax") >= xmin) & (F.col("bbox.ymin") <= ymax) & (F.col("bbox.ymax") >= ymin)
        )
    return df.filter(near)


def requested_geometries(requests: DataFrame, buildings: DataFrame, id_column: str, most_boxes: int = REQUEST_BOXES) -> DataFrame:
    """Long form (z, x, y, feature_id, geometry in tile units) of the requested tiles only.

    ``buildings`` is a stored table with ``bbox`` and a nested or WKB ``geometry``. The boxes of the request list filter its scan,
    what is left is dealt to tiles by arithmetic, and tiles nobody asked for fall away before any exact test or cut.
    A repeated request counts once; one off the map or without features has no rows. Counts the requests when called.
    """
    zooms, boxes = request_boxes(requests, most_boxes)
    near = in_boxes(buildings, boxes)
    if dict(near.dtypes)["geometry"] == "binary":
        near = layout.decoded(near)
    return tile_geometries(near, zooms or [0], id_column, _on_map(requests).distinct())


def tiles_on_request(
    requests: DataFrame, buildings: DataFrame, id_column: str, chunk_features: int = CHUNK_FEATURES, most_boxes: int = REQUEST_BOXES
) -> DataFrame:
    """Tile rows (z, x, y, chunk, features, n) as ``build_tiles`` stores them, made from the building table for these requests.

    No tile store is read or written: only the requested tiles' features are kept, in one scan of the parts of the
    table that the requests meet. Runs that scan when called.
    """
    return tile_features(cut_lineage(requested_geometries(requests, buildings, id_column, most_boxes), "requested"), chunk_features)
