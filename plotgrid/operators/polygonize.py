"""Polygons from linework, by joins over half-edges.

Lines are cut where they meet, and every segment becomes two half-edges. A half-edge's
successor around the face on its left comes from the order of directions at its end point.
Half-edges are dealt by tile, and rings inside a tile are traced there. What is left are chains
that reach over borders; their rings are found by pointer doubling: each round joins the chains
with themselves and doubles the reach, so a ring of n chains takes log2(n) rounds, however many
rings there are and without gathering any connected part of the drawing in one task. Dead
ends and bridges show as segments with the same ring on both sides and go all at once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plotgrid.functions import geometry as g
from plotgrid.functions.linework import PIECES, RINGS, TILE, cut_tiles, trace_ways
from plotgrid.operators.filters import LINE_LAYERS, POINT_LAYERS, keep_layers
from plotgrid.operators.points import containing_pairs, containing_polygons
from plotgrid.operators.zones import edge_cells
from plotgrid.session import cut_lineage, drop_folder, scratch_folder, scratch_scope

CELL = 1 / 1024
SEGMENT = ["x0", "y0", "x1", "y1"]
# Ids of pieces that are put together after the others; ids of rows stay below it in the first 2^26 tasks.
LATER_ID = 1 << 59


def line_segments(lines: DataFrame, column: str = "geometry", distinct: bool = True) -> DataFrame:
    """Segments of lines (arrays of points), the lesser end point first; with ``distinct`` each one once."""
    points = F.col(column)
    pairs = F.explode(F.transform(
        F.sequence(F.lit(1), F.size(column) - 1),
        lambda i: F.array_sort(F.array(F.element_at(points, i), F.element_at(points, i + 1))),
    ))
    ends = lines.filter(F.size(column) > 1).select(pairs.alias("ends"))
    a, b = F.col("ends")[0], F.col("ends")[1]
    found = ends.select(
        a["x"].alias("x0"), a["y"].alias("y0"), b["x"].alias("x1"), b["y"].alias("y1")
    ).filter("x0 <> x1 OR y0 <> y1")
    return found.distinct() if distinct else found


def _tile(row: Column, column: Column) -> Column:
    return (row * (1 << 32) + column).alias("tile")


def cut_pieces(segments: DataFrame, cell: float = CELL, snap: float = 0.0) -> DataFrame:
    """``id, x0, y0, x1, y1``: the distinct pieces of all segments, cut where they meet (see :func:`split_segments`).

    A ``tag`` (bigint) beside the segments makes ``tags``: those of all segments that a piece lies on. Segments are dealt
    by tiles of 32 x 32 cells and compared there; only segments of several tiles are moved once more, to bring their cuts
    together. The pieces are kept as tables, so ids do not change; this runs jobs when called.
    """
    spark = segments.sparkSession
    tagged = "tag" in segments.columns
    tag = ["tag"] if tagged else []
    placed = edge_cells(segments.select(*SEGMENT, *tag), F.lit(cell * TILE), snap).select(_tile(F.col("row"), F.col("column")), *SEGMENT, *tag)
    dealt = placed.repartition("tile").sortWithinPartitions("tile")
    made = dealt.mapInArrow(cut_tiles(cell, snap, tagged), PIECES).withColumn("id", F.monotonically_increasing_id())
    found = cut_lineage(made, "pieces")

    open_ones = found.filter("open")
    cuts = F.array_sort(F.array_distinct(F.flatten(F.collect_list("cuts")))).alias("points")
    several = open_ones.filter("cuts IS NOT NULL").groupBy(*SEGMENT).agg(cuts, F.first("tags").alias("tags"))
    # the same point is found at the same place in every tile
    spots = F.transform("points", lambda p: F.struct(p["x"].alias("x"), p["y"].alias("y")))
    steps = F.explode(F.transform(F.sequence(F.lit(1), F.size("spots") - 1), lambda i: F.array_sort(F.array(
        F.get("spots", i - 1), F.get("spots", i)
    )))).alias("ends")
    pieces = several.select("tags", spots.alias("spots")).select("tags", steps).select(
        *[F.col("ends")[i][c].alias(f"{c}{i}") for i in (0, 1) for c in ("x", "y")], "tags"
    )
    if tagged:
        beside = open_ones.filter("cuts IS NULL").select(*SEGMENT, "tags")
        joined = pieces.unionByName(beside).groupBy(*SEGMENT).agg(F.flatten(F.collect_list("tags")).alias("tags"))
    else:
        joined = pieces.select(*SEGMENT).distinct()
    columns = ["id", *SEGMENT, *(["tags"] if tagged else [])]
    later = cut_lineage(joined.withColumn("id", F.monotonically_increasing_id() + LATER_ID), "more-pieces")
    return found.filter("NOT open").select(*columns).unionByName(later.select(*columns))


def split_segments(segments: DataFrame, cell: float = CELL, snap: float = 0.0) -> DataFrame:
    """Cut every segment where another one crosses, touches or overlaps it; equal segments and pieces count once.

    An end point as near as ``snap`` to a segment counts as lying on it and cuts it there, so
    that lines drawn up to another one meet it although their coordinates are rounded. 0
    asks for exact contact. Segments without all four coordinates are left out. This runs jobs when called.
    """
    return cut_pieces(segments, cell, snap).select(*SEGMENT)


def half_edge_ways(pieces: DataFrame, cell: float = CELL) -> DataFrame:
    """Both directions of ``id, x0, y0, x1, y1`` at both their ends, as :func:`trace_rings` takes them; ids of a pair differ in the last bit only."""
    there, back = F.col("id") * 2, F.col("id") * 2 + 1
    ends = [way_at("x0", "y0", "x1", "y1", back, there), way_at("x1", "y1", "x0", "y0", there, back)]
    return dealt_ways(pieces.select(F.explode(F.array(*ends)).alias("way")), cell)


def way_at(x, y, ox, oy, into: Column, out: Column) -> Column:
    """Edges that come to (x, y) and leave it; (ox, oy) is their other end."""
    numbers = [F.col(c).alias(n) for c, n in zip((x, y, ox, oy), ("x", "y", "ox", "oy"))]
    return F.struct(*numbers, into.cast("bigint").alias("into"), out.cast("bigint").alias("out"))


def dealt_ways(ways: DataFrame, cell: float) -> DataFrame:
    """The column ``way`` of :func:`way_at` dealt by tile and sorted by the cell of the end point inside it."""
    flat = ways.select("way.*")
    row, column = F.floor(F.col("y") / cell), F.floor(F.col("x") / cell)

    def bits(value: Column, below: int, at: int) -> Column:
        return F.shiftleft(value.bitwiseAND((1 << below) - 1), at)

    # one number sorts faster than several; cells that are 2^32 apart share one, which is no harm
    inner = bits(row, 5, 5).bitwiseOR(bits(column, 5, 0))
    place = bits(F.shiftright(row, 5), 27, 37).bitwiseOR(bits(F.shiftright(column, 5), 27, 10)).bitwiseOR(inner)
    placed = flat.select(place.alias("cell"), *flat.columns)
    return placed.repartition(F.shiftright("cell", 10)).sortWithinPartitions("cell")


def trace_rings(ways: DataFrame, folder: str, twins: bool) -> DataFrame:
    """Rings ``label, ring, twice, bbox`` of directed edges, each edge going on with the first one clockwise of the way back.

    ``label`` is the ring's least edge and ``twice`` twice the signed area. Rings inside a chunk of a tile are traced where they are.
    Of the others only the stretches inside chunks take part in the doubling rounds, and they are put together at the end. With
    ``twins``, a segment with the same ring on both sides bounds no face: it is part of a dead end,
    of a free line or of a bridge between parts. All such segments go at once, however
    long their chains are, and the rings that lost one are traced anew. The rings are kept in ``folder``; this runs jobs when called.
    """
    traced = cut_lineage(ways.mapInArrow(trace_ways(twins), RINGS), "rings", folder)
    chains = traced.filter("next IS NOT NULL")
    if not chains.isEmpty():
        _join_chains(chains, folder, twins)
    return ways.sparkSession.read.schema(traced.schema).parquet(folder).filter("next IS NULL").select("label", "ring", "twice", "bbox")


def _join_chains(chains: DataFrame, folder: str, twins: bool) -> None:
    """Add the rings that chains make to the kept ones."""
    labels = chain_labels(chains)
    if twins:
        # the edges of these rings with both ends; an edge's twin is in one of them too, or in a whole ring of another label
        steps = F.explode(F.transform(F.sequence(F.lit(0), F.size("ids") - 1), lambda i: F.struct(
            F.get("ids", i).alias("id"), F.get("ring", i).alias("a"), F.get("ring", i + 1).alias("b"),
        ))).alias("e")
        edges = cut_lineage(
            chains.join(labels.select(F.col("id").alias("head"), F.col("label").alias("of")), F.col("label") == F.col("head"))
            .select("of", steps).select("of", "e.*"), "chain-edges",
        )
        twin = edges.select(F.col("id").bitwiseXOR(F.lit(1)).alias("id"), F.col("of").alias("twin_of"))
        loose = cut_lineage(edges.join(twin, "id").filter("of = twin_of").select("id", "of"), "loose")
        if not loose.isEmpty():
            broken = loose.select("of").distinct()
            stay = edges.join(broken, "of", "left_semi").join(loose, "id", "left_anti").select(
                "id", *[F.col(c).alias(n) for c, n in (("a.x", "x0"), ("a.y", "y0"), ("b.x", "x1"), ("b.y", "y1"))]
            )
            # around a corner only edges of the broken ring follow each other, once the loose ones are out
            none = F.lit(-1)
            ends = [way_at("x0", "y0", "x1", "y1", none, F.col("id")), way_at("x1", "y1", "x0", "y0", F.col("id"), none)]
            again = dealt_ways(stay.select(F.explode(F.array(*ends)).alias("way")), CELL)
            trace_rings(again, scratch_folder(again.sparkSession, "again"), False).write.mode("append").parquet(folder)
            labels = labels.join(broken.withColumnRenamed("of", "label"), "label", "left_anti")
    _joined_rings(chains, labels).write.mode("append").parquet(folder)


def chain_labels(chains: DataFrame) -> DataFrame:
    """``id, label, steps``: for every chain the least edge of its ring, and the steps to it from the chain's first edge.

    After k rounds a row knows the least id of its chain and the 2^k - 1 following ones and how far ahead it
    stands; ties keep the nearer one. One more round than the longest ring needs finds nothing new and ends it.
    """
    spark = chains.sparkSession
    folder = scratch_folder(spark, "chains")
    state = cut_lineage(chains.select(
        F.col("label").alias("id"), F.col("next").alias("jump"), F.col("least").alias("label"), F.col("at").alias("steps"),
        F.size("ids").cast("bigint").alias("reach"),
    ), "chains", folder)
    while True:
        ahead = state.select(
            F.col("id").alias("jump"), F.col("jump").alias("far"), F.col("label").alias("seen"), F.col("steps").alias("more"),
            F.col("reach").alias("further"),
        )
        less = F.col("seen") < F.col("label")
        before, folder = folder, scratch_folder(spark, "chains")
        moved = cut_lineage(state.join(ahead, "jump").select(
            "id", F.col("far").alias("jump"), F.least("label", "seen").alias("label"),
            F.when(less, F.col("reach") + F.col("more")).otherwise(F.col("steps")).alias("steps"),
            (F.col("reach") + F.col("further")).alias("reach"), less.alias("changed"),
        ), "chains", folder)
        drop_folder(spark, before)  # a round reads the one before it only
        state = moved.drop("changed")
        if moved.filter("changed").isEmpty():
            return state.select("id", "label", "steps")


def _joined_rings(chains: DataFrame, labels: DataFrame) -> DataFrame:
    """Rings from chains: the leader's chain from the leader on, then the others by their way still to go, then what lies before the leader."""
    mine = chains.select(F.col("label").alias("id"), "least", "at", F.slice("ring", F.lit(1), F.size("ids")).alias("points"))
    at = F.col("at").cast("int")
    leading = F.array(
        F.struct(F.lit(-(1 << 62)).alias("place"), F.slice("points", at + 1, F.size("points")).alias("points")),
        F.struct(F.lit(0).cast("bigint").alias("place"), F.slice("points", F.lit(1), at).alias("points")),
    )
    other = F.array(F.struct((-F.col("steps")).alias("place"), "points"))
    parts = mine.join(labels, "id").select("label", F.explode(F.when(F.col("least") == F.col("label"), leading).otherwise(other)).alias("part"))
    rings = parts.groupBy("label").agg(
        F.flatten(F.transform(F.array_sort(F.collect_list("part")), lambda p: p["points"])).alias("ring")
    ).withColumn("ring", F.concat("ring", F.slice("ring", 1, 1)))
    boxed = g.bounds(F.array(F.array("ring")))
    return rings.select("label", "ring", signed_twice_area(F.col("ring")).alias("twice"), boxed.alias("bbox"))


def signed_twice_area(ring: Column) -> Column:
    """Twice the signed area, measured from the first point."""
    first = ring[0]
    return F.aggregate(
        F.sequence(F.lit(0), F.size(ring) - 2), F.lit(0.0),
        lambda total, i: total + (F.get(ring, i)["x"] - first["x"]) * (F.get(ring, i + 1)["y"] - first["y"])
        - (F.get(ring, i + 1)["x"] - first["x"]) * (F.get(ring, i)["y"] - first["y"]),
    )


def polygonize(lines: DataFrame, column: str = "geometry", snap: float = 0.0) -> DataFrame:
    """All faces of the linework as polygons (geometry, bbox), holes included.

    ``snap`` is the distance at which a line's end meets another line (see
    :func:`split_segments`). This runs jobs when called.
    """
    folder = scratch_folder(lines.sparkSession, "faces")
    with scratch_scope(lines.sparkSession):  # the tables on the way are not read again
        pieces = cut_pieces(line_segments(lines, column, distinct=False), snap=snap)  # equal ones count once there
        rings = trace_rings(half_edge_ways(pieces), folder, twins=True)
    return with_holes(rings)


def with_holes(rings: DataFrame) -> DataFrame:
    """Polygons (geometry, bbox) of rings ``label, ring, twice, bbox``: those that turn left, with the others as holes
    of the smallest one around them."""
    shells = rings.filter("twice > 0").select("label", F.array(F.array("ring")).alias("geometry"), "bbox", "twice")
    # The outer ring of a connected part runs clockwise; it is a hole of the smallest
    # face of another part around it. No face of its own part lies around its least point.
    outer = rings.filter("twice < 0").select(F.col("label").alias("hole"), "ring", F.array_min("ring").alias("least"))
    marks = outer.select("hole", F.col("least.x").alias("lon"), F.col("least.y").alias("lat"))
    around = containing_pairs(shells, marks)
    owner = around.groupBy("hole").agg(F.min_by("label", F.struct("twice", "label")).alias("label"))
    holes = outer.select("hole", "ring").join(owner, "hole").groupBy("label").agg(F.collect_list("ring").alias("holes"))
    filled = F.coalesce("holes", F.array().cast("array<array<struct<x:double,y:double>>>"))
    return shells.join(holes, "label", "left").select(
        F.array(F.concat(F.col("geometry")[0], filled)).alias("geometry"), "bbox"
    )


def building_polygons(fkb: DataFrame, snap: float = 0.0) -> DataFrame:
    """Faces of the building linework that contain a building point.

    ``fkb`` has ``layer``, ``geometry`` (line as an array of points) and, for point
    layers, a one-point array.
    """
    areas = polygonize(keep_layers(fkb, LINE_LAYERS), snap=snap)
    marks = keep_layers(fkb, POINT_LAYERS).select(
        F.col("geometry")[0]["x"].alias("lon"), F.col("geometry")[0]["y"].alias("lat")
    )
    return containing_polygons(areas, marks)
