"""Union of areas by the coverage on both sides of every piece of their outlines.

All outlines are cut where they meet. A piece belongs to the outline of the union where one
side of it is covered and the other is not: areas with this piece in their own outline lie on
one side only, and no other area holds the piece inside. These pieces, directed with the
covered side on the left, are traced to rings like any linework; no group of touching
areas is gathered in one task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plotgrid.functions import geometry as g
from plotgrid.operators.points import containing_pairs
from plotgrid.operators.polygonize import SEGMENT, cut_pieces, dealt_ways, signed_twice_area, trace_rings, way_at, with_holes
from plotgrid.session import cut_lineage, scratch_folder, scratch_scope


def directed_segments(shapes: DataFrame) -> DataFrame:
    """``shape, x0, y0, x1, y1, forward``: every segment with its lesser end first; ``forward`` tells
    whether the inside is on the left of the way from there to the other end."""
    rings = shapes.select("shape", F.explode("geometry").alias("part")).select("shape", F.posexplode("part").alias("i", "ring"))
    # shells turn left around the inside, holes turn right
    turned = rings.filter(F.size("ring") > 3).withColumn("twice", signed_twice_area(F.col("ring"))).filter("twice <> 0").withColumn(
        "left", (F.col("twice") > 0) == (F.col("i") == 0)
    )
    steps = F.explode(F.transform(F.sequence(F.lit(0), F.size("ring") - 2), lambda i: F.struct(
        F.get("ring", i).alias("a"), F.get("ring", i + 1).alias("b")
    )))
    ends = turned.select("shape", "left", steps.alias("e")).filter("e.a <> e.b")
    low, high = F.least("e.a", "e.b"), F.greatest("e.a", "e.b")
    return ends.select(
        "shape", low["x"].alias("x0"), low["y"].alias("y0"), high["x"].alias("x1"), high["y"].alias("y1"),
        (F.col("left") == (F.col("e.a") < F.col("e.b"))).alias("forward"),
    )


def outline_pieces(shapes: DataFrame, cell: float) -> DataFrame:
    """``id, ux, uy, vx, vy``: pieces with the union on their left only. ``shapes`` has shape, geometry, bbox."""
    side = F.col("forward").cast("bigint")
    pieces = cut_pieces(directed_segments(shapes).select(*SEGMENT, (F.col("shape") * 2 + side).alias("tag")), cell)
    first = F.col("tags")[0].bitwiseAND(1)
    one_sided = pieces.withColumn("side", first).filter(
        (F.size("tags") == 1) | ~F.exists("tags", lambda tag: tag.bitwiseAND(1) != F.col("side"))
    )
    middles = one_sided.select(
        "id", "side", "tags", ((F.col("x0") + F.col("x1")) / 2).alias("lon"), ((F.col("y0") + F.col("y1")) / 2).alias("lat")
    )
    # a cut point may be rounded to the inner side of an area that it lies on, so owners do not count
    inside = containing_pairs(shapes, middles).filter(~F.array_contains("tags", F.col("shape") * 2 + F.col("side")))
    kept = one_sided.join(inside.select("id"), "id", "left_anti")
    there, back = ("x0", "y0", "x1", "y1"), ("x1", "y1", "x0", "y0")
    return kept.select("id", *[
        F.when(F.col("side") == 1, F.col(a)).otherwise(F.col(b)).alias(n) for a, b, n in zip(there, back, ("ux", "uy", "vx", "vy"))
    ])


def outline_ways(edges: DataFrame, cell: float) -> DataFrame:
    """The outline goes on with the first edge clockwise of the way back, so areas
    that touch in a corner stay apart."""
    none = F.lit(-1)
    ends = [way_at("ux", "uy", "vx", "vy", none, F.col("id")), way_at("vx", "vy", "ux", "uy", F.col("id"), none)]
    return dealt_ways(edges.select(F.explode(F.array(*ends)).alias("way")), cell)


def union_areas(areas: DataFrame, cell: float = 1 / 1024) -> DataFrame:
    """The union of all areas (``geometry``) as separate polygons ``geometry, bbox``, holes included.

    Areas that share a stretch of an edge or overlap become one, areas that touch in a corner stay
    two. Copies count once; null geometries and rings without area are left out; no areas give no rows. ``cell`` is the grid on
    which edges meet and should be about the size of an area. Crossing points are computed in doubles, so edges
    must cross clearly or share their points. This runs jobs when called.
    """
    spark = areas.sparkSession
    folder = scratch_folder(spark, "outline-rings")
    with scratch_scope(spark):  # the tables on the way are not read again
        distinct = areas.filter(F.col("geometry").isNotNull()).select("geometry").distinct()
        # the numbers must not change when a task runs again, so they are written once
        shapes = cut_lineage(distinct.select(
            F.monotonically_increasing_id().alias("shape"), "geometry", g.bounds(F.col("geometry")).alias("bbox")
        ), "areas")
        rings = trace_rings(outline_ways(outline_pieces(shapes, cell), cell), folder, twins=False)
    return with_holes(rings)
