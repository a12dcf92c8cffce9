"""Thinning crowded tiles where features stand densest, and the zoom at which features part."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plotgrid.functions import geometry as g
from plotgrid.functions import tiles as tl
from plotgrid.functions.curves import hilbert_key
from plotgrid.operators.ranking import previous_row
from plotgrid.operators.sizes import broadcast_if_small
from plotgrid.operators.tiling import MAX_ZOOM, TILE, tile_counts
from plotgrid.session import cut_lineage

# Bits of the curve inside a tile, of a gap's upper and lower half, and of a stretch that is ordered by one task.
TILE_BITS = 16
HALF = 13
STRETCH = 1 << 14
WORLD_BITS = 20
WORLD_STRETCH = 1 << 24

# Tile units between typical neighbours from which on features count as parted, and which neighbours are typical.
PARTED_UNITS = 8.0
TYPICAL = 0.5


def with_places(long: DataFrame) -> DataFrame:
    """Append ``place``, a feature's position along the tile's Hilbert curve, and ``_shape``, which orders equal ids."""
    b = g.bounds(F.col("geometry"))
    middle = [(F.floor((b[low] + b[high]) / 2) + tl.BUFFER).cast("bigint") for low, high in (("xmin", "xmax"), ("ymin", "ymax"))]
    return long.withColumn("place", hilbert_key(*middle, TILE_BITS)).withColumn("_shape", F.xxhash64("feature_id", "geometry"))


def with_gaps(placed: DataFrame) -> DataFrame:
    """Append ``gap`` to the feature before along the curve to rows of :func:`with_places`, and leave out ``_shape``.

    The first feature of a tile has no gap (NULL). Equal places are ordered by id, then by shape. Stretches of the curve are
    ordered apart and hand their last place on, so a tile that holds everything is not ordered by one task.
    """
    order = ["place", "feature_id", "_shape"]
    lagged = previous_row(placed, TILE, "place", order, ["place"], STRETCH)
    return lagged.withColumn("gap", F.col("place") - F.col("prev_place")).drop("prev_place", "_shape")


def gap_thresholds(gaps: DataFrame, max_features: int) -> DataFrame:
    """(z, x, y, least_gap) of every tile with more than ``max_features`` features: the least gap that, with the tile's
    first feature, at most ``max_features`` features reach.

    The gap's upper half is settled first and then its lower half inside the one value that is in question, by counts per
    tile and half; features are neither ranked nor gathered.
    """
    crowded = tile_counts(gaps).filter(F.col("n") > max_features).select(*TILE)
    asked = gaps.join(crowded, TILE, "left_semi").filter(F.col("gap").isNotNull()).select(
        *TILE, F.shiftright("gap", HALF).alias("high"), F.col("gap").bitwiseAND((1 << HALF) - 1).alias("low")
    )
    room = F.lit(max_features - 1)  # the first feature of a tile stays

    def reached(counts: DataFrame, digit: str) -> DataFrame:
        down = Window.partitionBy(*TILE).orderBy(F.desc(digit))
        return counts.withColumn("reach", F.sum("n").over(down))

    highs = reached(asked.groupBy(*TILE, "high").agg(F.count("*").alias("n")), "high")
    # the greatest upper half that overflows, and what lies above it
    over = highs.filter(F.col("reach") > room).groupBy(*TILE).agg(
        F.max("high").alias("at"), F.max_by(F.col("reach") - F.col("n"), "high").alias("above")
    )
    inside = asked.join(over, TILE).filter(F.col("high") == F.col("at"))
    lows = reached(inside.groupBy(*TILE, "at", "above", "low").agg(F.count("*").alias("n")), "low")
    fits = F.when(F.col("above") + F.col("reach") <= room, F.col("low"))
    return lows.groupBy(*TILE, "at").agg(F.min(fits).alias("low")).select(
        *TILE, (F.shiftleft("at", HALF) + F.coalesce("low", F.lit(1 << HALF))).alias("least_gap")
    )


def drop_densest(long: DataFrame, max_features: int) -> DataFrame:
    """The tile features that stay when every tile drops its densest ones until ``max_features`` are left at most.

    ``long`` is z, x, y, feature_id, geometry in tile units. A feature's gap along the tile's Hilbert curve tells how dense
    its place is; a tile over the limit keeps the features whose gap reaches its least gap, and its first one. Features of equal
    gap stay or go together, so a tile may keep fewer than it might. Appends ``place``, ``gap`` and ``dropped``, how
    many the tile lost. Shapes are written once where they are and fetched for the features that stay; only places and row
    numbers are shuffled for the gaps. Runs jobs when called.
    """
    if max_features < 1:
        raise ValueError("a tile keeps at least one feature")
    placed = cut_lineage(with_places(long).withColumn("_row", F.monotonically_increasing_id()), "places")
    gaps = cut_lineage(with_gaps(placed.select(*TILE, "feature_id", "place", "_shape", "_row")), "gaps")
    least = gap_thresholds(gaps, max_features)
    flagged = gaps.join(least, TILE, "left").withColumn(
        "stays", F.col("least_gap").isNull() | F.col("gap").isNull() | (F.col("gap") >= F.col("least_gap"))
    )
    lost = flagged.groupBy(*TILE).agg(F.count_if(~F.col("stays")).alias("dropped"))
    stay = flagged.filter("stays").select(*TILE, "_row", "gap").join(lost, TILE).drop(*TILE)
    return placed.drop("_shape").join(broadcast_if_small(stay), "_row").select(*long.columns, "place", "gap", "dropped")


def world_position(bbox: Column) -> tuple[Column, Column]:
    """The middle of a box on the square web map, whose side is 1."""
    lon, lat = (bbox["xmin"] + bbox["xmax"]) / 2, (bbox["ymin"] + bbox["ymax"]) / 2
    r = F.radians(F.greatest(F.lit(-tl.MAX_LATITUDE), F.least(lat, F.lit(tl.MAX_LATITUDE))))
    return (lon + 180.0) / 360.0, (F.lit(1.0) - F.ln(F.tan(r) + F.lit(1.0) / F.cos(r)) / math.pi) / 2


def choose_zoom(
    df: DataFrame, id_column: str, parted_units: float = PARTED_UNITS, typical: float = TYPICAL, accuracy: int = 100_000
) -> DataFrame:
    """One row: the number of neighbours that stand apart, their ``typical`` distance in parts of the map's side, and the least
    zoom that draws this distance ``parted_units`` tile units wide.

    Neighbours follow each other along a Hilbert curve over the map; features on one spot never part and do not count. Without two
    spots the zoom is NULL. Distances come from one ordered pass, the quantile from a sketch of ``accuracy``
    entries (exact for fewer values).
    """
    x, y = world_position(F.col("bbox"))
    cells = [F.greatest(F.lit(0), F.least(F.floor(v * (1 << WORLD_BITS)), F.lit((1 << WORLD_BITS) - 1))).cast("bigint") for v in (F.col("wx"), F.col("wy"))]
    placed = (
        df.filter(F.col("bbox.xmin").isNotNull()).select(F.col(id_column).alias("id"), x.alias("wx"), y.alias("wy"))
        .withColumn("place", hilbert_key(*cells, WORLD_BITS))
    )
    lagged = previous_row(placed, [], "place", ["place", "id", "wx", "wy"], ["wx", "wy"], WORLD_STRETCH)
    apart = F.hypot(F.col("wx") - F.col("prev_wx"), F.col("wy") - F.col("prev_wy"))
    found = lagged.select(apart.alias("apart")).filter(F.col("apart") > 0).agg(
        F.count("*").alias("neighbours"), F.percentile_approx("apart", typical, accuracy).alias("distance")
    )
    zoom = F.ceil(F.log2(F.lit(parted_units / tl.EXTENT) / F.col("distance")))
    bounded = F.greatest(F.lit(0), F.least(zoom, F.lit(MAX_ZOOM))).cast("int")
    return found.withColumn("zoom", F.when(F.col("distance").isNotNull(), bounded))
