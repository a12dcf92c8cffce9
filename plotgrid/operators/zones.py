"""Spatial join of many buildings with large zones (counties, municipalities).

Zones are turned into a lookup of grid windows. A window is two cells wide and two cells
high, anchored at its lower-left cell, and every building fits into the one window
anchored at the lower-left corner of its box (coarser levels take larger buildings). So
each building has exactly one key, the join is a plain equi-join and no pair can appear
twice. A window without zone edges is wholly inside or outside the zone; only buildings
in windows that a border crosses need an exact test, against the few edges of that
window.
"""

from __future__ import annotations

import math
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plotgrid.functions import geometry as g
from plotgrid.operators.sizes import at_most, broadcast_if_small
from plotgrid.session import cut_lineage

LEVEL_FACTOR = 16
LEVELS = 5
FINE_LEVEL = -1
SLIM_WINDOWS = 2_000_000
CROWDED_EDGES = 128
# The anchor sits at this share of a window's first cell, away from round coordinates.
ANCHOR_X, ANCHOR_Y = 0.381966, 0.618034
EDGE = "struct<x0:double,y0:double,x1:double,y1:double>"


def level_of(bbox: Column, cell: float) -> Column:
    """Finest level whose cells are at least as large as the box."""
    extent = F.greatest(bbox["xmax"] - bbox["xmin"], bbox["ymax"] - bbox["ymin"])
    level = F.lit(LEVELS - 1)
    for step in reversed(range(LEVELS - 1)):
        level = F.when(extent <= cell * LEVEL_FACTOR**step, F.lit(step)).otherwise(level)
    return level


def _cell_size(level: Column, cell: float) -> Column:
    return F.lit(cell) * F.pow(F.lit(float(LEVEL_FACTOR)), level)


def with_window_key(df: DataFrame, cell: float) -> DataFrame:
    """Append ``level, wx, wy``: the one window that holds the row's box."""
    keyed = df.withColumn("level", level_of(F.col("bbox"), cell))
    size = _cell_size(F.col("level"), cell)
    return keyed.withColumns({
        "wx": F.floor(F.col("bbox.xmin") / size), "wy": F.floor(F.col("bbox.ymin") / size),
    })


def zone_edges(zones: DataFrame, key: str) -> DataFrame:
    """One row per border segment of a zone."""
    rings = zones.select(key, F.explode(F.flatten("geometry")).alias("ring"))
    edges = rings.select(key, F.explode(F.transform(
        F.sequence(F.lit(1), F.size("ring") - 1),
        lambda i: F.struct(
            F.element_at("ring", i)["x"].alias("x0"), F.element_at("ring", i)["y"].alias("y0"),
            F.element_at("ring", i + 1)["x"].alias("x1"), F.element_at("ring", i + 1)["y"].alias("y1"),
        ),
    )).alias("edge"))
    return edges.select(key, "edge", "edge.*")


def edge_cells(edges: DataFrame, size: Column, reach: float = 0.0) -> DataFrame:
    """Append ``row, column`` of every grid cell a segment (x0, y0, x1, y1) touches, or comes as near as ``reach`` along both axes.

    The walk goes row by row and takes only the columns passed inside each row, so a long
    slanted segment lists the cells along it and not those of its whole box.
    """
    low_y, high_y = F.least("y0", "y1"), F.greatest("y0", "y1")
    low_x, high_x = F.least("x0", "x1"), F.greatest("x0", "x1")
    rows = edges.withColumn("row", F.explode(F.sequence(F.ceil((low_y - reach) / size) - 1, F.floor((high_y + reach) / size))))
    slack = size * 1e-9
    slope = (F.col("x1") - F.col("x0")) / (F.col("y1") - F.col("y0"))
    floor_y = F.least(F.greatest(F.col("row") * size - reach, low_y), high_y)
    roof_y = F.greatest(F.least((F.col("row") + 1) * size + reach, high_y), low_y)
    at_floor, at_roof = (F.col("x0") + slope * (y - F.col("y0")) for y in (floor_y, roof_y))
    flat = F.col("y0") == F.col("y1")
    left = F.when(flat, low_x).otherwise(F.greatest(low_x, F.least(at_floor, at_roof) - slack)) - reach
    right = F.when(flat, high_x).otherwise(F.least(high_x, F.greatest(at_floor, at_roof) + slack)) + reach
    return rows.withColumns({"_left": left, "_right": right}).withColumn("column", F.explode(
        F.sequence(F.ceil(F.col("_left") / size) - 1, F.floor(F.col("_right") / size))
    )).drop("_left", "_right")


def zone_windows(
    zones: DataFrame, key: str, cell: float, levels: list[int] | None = None, within: DataFrame | None = None
) -> DataFrame:
    """Lookup ``key, level, wx, wy, edges, inside``: windows that meet each zone.

    ``edges`` holds the zone's segments in the window (NULL when there are none) and
    ``inside`` tells whether the window's anchor point is in the zone. ``within`` (columns
    ``wx, wy`` of level 0) limits the finer level -1 to those windows' lower-left cells.
    """
    grid = F.explode(F.array(*[F.lit(v) for v in (levels or range(LEVELS))]))
    edges = zone_edges(zones, key).withColumn("level", grid).withColumn("size", _cell_size(F.col("level"), cell))
    size = F.col("size")
    low_y, high_y = F.least("y0", "y1"), F.greatest("y0", "y1")
    cells = edge_cells(edges, size).select(key, "level", "edge", "row", "column")
    # A window covers the cells (wx, wy) to (wx + 1, wy + 1).
    border = cells.select(
        key, "level", "edge",
        F.explode(F.expr("array(column - 1, column)")).alias("wx"), "row",
    ).select(key, "level", "edge", "wx", F.explode(F.expr("array(row - 1, row)")).alias("wy"))
    if within is not None:
        border = _with_parent(border).join(_parents(within), ["px", "py"], "left_semi").drop("px", "py")

    # Anchors inside the zone: between odd and even crossings of a horizontal line.
    lines = edges.filter(F.col("y0") != F.col("y1")).withColumn("wy", F.explode(F.sequence(
        F.floor(low_y / size) - 1, F.floor(high_y / size)
    ))).withColumn("line", (F.col("wy") + ANCHOR_Y) * size)
    if within is not None:
        lines = lines.withColumn("py", F.floor(F.col("wy") / LEVEL_FACTOR)).join(
            _parents(within).select("py").distinct(), "py", "left_semi"
        ).drop("py")
    crossings = lines.filter(
        (F.col("y0") > F.col("line")) != (F.col("y1") > F.col("line"))
    ).withColumn("at", F.col("x0") + (F.col("x1") - F.col("x0")) * (F.col("line") - F.col("y0")) / (F.col("y1") - F.col("y0")))
    order = Window.partitionBy(key, "level", "wy").orderBy("at")
    spans = crossings.withColumns({
        "nth": F.row_number().over(order), "until": F.lead("at").over(order),
    }).filter(F.col("nth") % 2 == 1)
    first = F.ceil(F.col("at") / size - ANCHOR_X)
    last = F.floor(F.col("until") / size - ANCHOR_X)
    spans = spans.withColumns({"first": first, "last": last})
    if within is not None:
        spans = spans.withColumn("py", F.floor(F.col("wy") / LEVEL_FACTOR)).join(_parents(within), "py").withColumns({
            "first": F.greatest("first", F.col("px") * LEVEL_FACTOR),
            "last": F.least("last", F.col("px") * LEVEL_FACTOR + LEVEL_FACTOR - 1),
        })
    inside = spans.filter("first <= last").select(
        key, "level", F.explode(F.sequence("first", "last")).alias("wx"), "wy", F.lit(True).alias("inside"),
    )
    # A window's edges are at most its zone's own edges, so a list never outgrows the
    # geometry value it comes from.
    gathered = border.unionByName(inside, allowMissingColumns=True).groupBy(key, "level", "wx", "wy").agg(
        F.collect_set("edge").alias("edges"), F.bool_or(F.coalesce("inside", F.lit(False))).alias("inside"),
    )
    return gathered.withColumn("edges", F.when(F.size("edges") > 0, F.col("edges")))


def _with_parent(df: DataFrame) -> DataFrame:
    return df.withColumns({"px": F.floor(F.col("wx") / LEVEL_FACTOR), "py": F.floor(F.col("wy") / LEVEL_FACTOR)})


def _parents(within: DataFrame) -> DataFrame:
    return within.select(F.col("wx").alias("px"), F.col("wy").alias("py"))


class ZoneLookup(NamedTuple):
    """Windows of all zones (zone key in ``zone``) and the level 0 windows, if any, whose
    many edges made a finer level necessary. ``slim`` holds the windows without their edges
    where these are too many to broadcast and the windows alone are not."""

    windows: DataFrame
    crowded: DataFrame | None
    cell: float
    slim: DataFrame | None = None


def zone_lookup(zones: DataFrame, key: str = "region", cell: float = 1 / 64) -> ZoneLookup:
    """The window lookup kept as a table, ready for many joins.

    Where a detailed border (a coastline) puts many edges into one window, that window is
    also listed on a level sixteen times finer, so that a row never drags a long edge list
    along. The lookup is marked for broadcast when its rows and edges are proven few. Up to
    ``SLIM_WINDOWS`` windows are broadcast without their edges: that settles all rows in
    inner windows where they are, and only rows in border windows are shuffled. Beyond that,
    joins shuffle both sides by window and adaptive execution splits crowded windows of the
    building side. ``cell`` must be a power of two, which keeps cell numbers of both
    levels exact. This runs jobs when called.
    """
    if math.frexp(cell)[0] != 0.5:
        raise ValueError("the cell size must be a power of two")
    windows = cut_lineage(zone_windows(zones, key, cell).withColumnRenamed(key, "zone"), "windows")
    crowded = windows.filter((F.col("level") == 0) & (F.size("edges") > CROWDED_EDGES)).select("wx", "wy").distinct()
    if crowded.isEmpty():
        crowded = None
    else:
        crowded = broadcast_if_small(crowded)
        fine = zone_windows(zones, key, cell, [FINE_LEVEL], crowded).withColumnRenamed(key, "zone")
        windows = cut_lineage(windows.unionByName(fine), "windows")
    marked = broadcast_if_small(windows, weight=F.coalesce(F.size("edges"), F.lit(0)))
    slim = None
    if marked is windows and at_most(windows, SLIM_WINDOWS):
        slim = F.broadcast(windows.select("zone", "level", "wx", "wy", F.col("edges").isNotNull().alias("_border")))
    return ZoneLookup(marked, crowded, cell, slim)


def _keyed(df: DataFrame, lookup: ZoneLookup) -> DataFrame:
    """Window key of each row; small rows in crowded windows take the finer level."""
    keyed = with_window_key(df, lookup.cell)
    if lookup.crowded is None:
        return keyed
    marks = lookup.crowded.select("wx", "wy", F.lit(0).alias("level"), F.lit(True).alias("_crowded"))
    size = lookup.cell / LEVEL_FACTOR
    extent = F.greatest(F.col("bbox.xmax") - F.col("bbox.xmin"), F.col("bbox.ymax") - F.col("bbox.ymin"))
    fine = F.col("_crowded").isNotNull() & (extent <= size)
    return keyed.join(marks, ["level", "wx", "wy"], "left").withColumns({
        "level": F.when(fine, FINE_LEVEL).otherwise(F.col("level")),
        "wx": F.when(fine, F.floor(F.col("bbox.xmin") / size)).otherwise(F.col("wx")),
        "wy": F.when(fine, F.floor(F.col("bbox.ymin") / size)).otherwise(F.col("wy")),
    }).drop("_crowded")


def zone_pairs(
    df: DataFrame, zones: DataFrame, key: str = "region", cell: float = 1 / 64,
    geometry: str = "geometry", keep: list[str] | None = None, lookup: ZoneLookup | None = None,
) -> DataFrame:
    """Inner join: every row of ``df`` with every zone it shares a point with.

    The zone key arrives as ``zone``. ``keep`` names the columns of ``df`` wanted in the
    result. ``lookup`` is a :func:`zone_lookup` of the same zones, where one exists
    already.
    """
    columns = keep if keep is not None else [c for c in df.columns if c != "zone"]
    if lookup is None:
        lookup = zone_lookup(zones, key, cell)
    window = ["level", "wx", "wy"]
    keyed = _keyed(df, lookup)
    if lookup.slim is None:
        return _tested(keyed.join(lookup.windows, window), lookup, geometry, columns)
    placed = keyed.join(lookup.slim, window)
    inner = placed.filter(~F.col("_border")).select(*columns, "zone")
    edged = lookup.windows.filter(F.col("edges").isNotNull())
    border = placed.filter("_border").drop("_border").join(edged, ["zone", *window])
    return inner.unionByName(_tested(border, lookup, geometry, columns))


def _tested(joined: DataFrame, lookup: ZoneLookup, geometry: str, columns: list[str]) -> DataFrame:
    """Rows beside their windows that pass: at once in inner windows, by the edges in others."""
    size = _cell_size(F.col("level"), lookup.cell)
    settled = F.col("edges").isNull()
    exact = g.meets_zone(
        F.when(~settled, F.col(geometry)), F.col("edges"),
        (F.col("wx") + ANCHOR_X) * size, (F.col("wy") + ANCHOR_Y) * size, F.col("inside"),
    )
    return joined.filter(F.coalesce(exact, settled)).select(*columns, "zone")


def spatial_join_counts(df: DataFrame, zones: DataFrame, key: str = "region", cell: float = 1 / 64) -> DataFrame:
    """Buildings per zone, largest first; zones without buildings do not appear."""
    pairs = zone_pairs(df, zones, key, cell, keep=[])
    return (
        pairs.groupBy(F.col("zone").alias(key)).agg(F.count("*").alias("building_count"))
        .orderBy(F.desc("building_count"), F.asc(key))
    )
