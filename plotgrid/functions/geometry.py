"""Geometry columns: constructors and bounds as built-in expressions, measures and
exact predicates as Arrow functions.

Geometry type: ``array<array<array<struct<x:double,y:double>>>>`` (parts, rings,
points). Anything a bounding box can settle is settled in built-in expressions; the
Arrow functions get a NULL geometry for such rows, so only open cases cross to Python.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plotgrid.functions import kernels, projections, wkb
from plotgrid.functions.sessions import per_application
from plotgrid.functions.streams import with_streamed

GEOMETRY = "array<array<array<struct<x:double,y:double>>>>"
BOX = "struct<xmin:double,ymin:double,xmax:double,ymax:double>"


def point(x, y) -> Column:
    return F.struct(F.lit(x).cast("double").alias("x"), F.lit(y).cast("double").alias("y"))


def polygon(*rings: list[tuple]) -> Column:
    """One-part geometry from rings given as lists of (x, y) columns or numbers."""
    return F.array(F.array(*[F.array(*[point(x, y) for x, y in ring]) for ring in rings]))


def rectangle(minx, miny, maxx, maxy) -> Column:
    return polygon([(minx, miny), (maxx, miny), (maxx, maxy), (minx, maxy), (minx, miny)])


def box(minx, miny, maxx, maxy) -> Column:
    """Envelope as a bbox struct."""
    names = ("xmin", "ymin", "xmax", "ymax")
    return F.struct(*[F.lit(v).cast("double").alias(n) for v, n in zip((minx, miny, maxx, maxy), names)])


def bounds(geometry: Column) -> Column:
    """Covering box of a geometry: least and greatest coordinates of its shells."""
    shells = F.flatten(F.transform(geometry, lambda part: part[0]))
    xs, ys = F.transform(shells, lambda p: p["x"]), F.transform(shells, lambda p: p["y"])
    return box(F.array_min(xs), F.array_min(ys), F.array_max(xs), F.array_max(ys))


def boxes_overlap(a: Column, b: Column) -> Column:
    return (
        (a["xmin"] <= b["xmax"]) & (a["xmax"] >= b["xmin"])
        & (a["ymin"] <= b["ymax"]) & (a["ymax"] >= b["ymin"])
    )


def box_within(inner: Column, outer: Column) -> Column:
    return (
        (inner["xmin"] >= outer["xmin"]) & (inner["xmax"] <= outer["xmax"])
        & (inner["ymin"] >= outer["ymin"]) & (inner["ymax"] <= outer["ymax"])
    )


def map_points(geometry: Column, change) -> Column:
    """Apply ``change(x, y) -> (x, y)`` to every point with built-in expressions."""
    def moved(p):
        x, y = change(p["x"], p["y"])
        return F.struct(x.alias("x"), y.alias("y"))

    return F.transform(geometry, lambda part: F.transform(part, lambda ring: F.transform(ring, moved)))


def affine(geometry: Column, a, b, d, e, tx, ty) -> Column:
    """x' = a x + b y + tx, y' = d x + e y + ty."""
    return map_points(geometry, lambda x, y: (a * x + b * y + tx, d * x + e * y + ty))


def _doubles(*arrays: pa.Array) -> list[np.ndarray]:
    return [a.to_numpy(zero_copy_only=False).astype(np.float64) for a in arrays]


def _once(function):
    # Deterministic Python functions may be evaluated again in a pushed-down filter.
    return function.asNondeterministic()


MEASURES = ["area", "perimeter", "cx", "cy"]


def _measure_columns(shapes: kernels.Shapes) -> list[pa.Array]:
    values = kernels.measures(shapes)
    return [pa.array(values[n], pa.float64(), mask=shapes.null) for n in MEASURES]


@per_application
def _measure_function(src: int, dst: int):
    @F.arrow_udf("struct<area:double,perimeter:double,cx:double,cy:double>")
    def measured(geometry: pa.Array) -> pa.Array:
        shapes = kernels.Shapes(geometry, projections.projector(src, dst))
        return pa.StructArray.from_arrays(_measure_columns(shapes), names=MEASURES)

    return _once(measured)


@per_application
def _checked_measure_function(src: int, dst: int):
    @F.arrow_udf("struct<valid:boolean,area:double,perimeter:double,cx:double,cy:double>")
    def checked(geometry: pa.Array) -> pa.Array:
        valid = pa.array(kernels.valid(kernels.Shapes(geometry)))
        shapes = kernels.Shapes(geometry, projections.projector(src, dst))
        return pa.StructArray.from_arrays([valid, *_measure_columns(shapes)], names=["valid", *MEASURES])

    return _once(checked)


def checked_measures(geometry: Column, src: int = 4326, dst: int = 4326) -> Column:
    """struct(valid, area, perimeter, cx, cy): validity and measures in one pass."""
    return _checked_measure_function(src, dst)(geometry)


def measures(geometry: Column, src: int = 4326, dst: int = 4326) -> Column:
    """struct(area, perimeter, cx, cy), measured in the target projection."""
    return _measure_function(src, dst)(geometry)


def _measured_batch(batch: pa.RecordBatch) -> pa.Array:
    return pa.StructArray.from_arrays(_measure_columns(kernels.Shapes(batch.column("geometry"))), names=MEASURES)


def with_measures(df: DataFrame, name: str) -> DataFrame:
    """``measures`` of the column ``geometry`` in its place, for tables that are too large to wait in a task's queue."""
    kind = "struct<area:double,perimeter:double,cx:double,cy:double>"
    return with_streamed(df, {name: (kind, _measured_batch)}, drop=("geometry",))


def area(geometry: Column, src: int = 4326, dst: int = 4326) -> Column:
    return measures(geometry, src, dst)["area"]


def perimeter(geometry: Column, src: int = 4326, dst: int = 4326) -> Column:
    return measures(geometry, src, dst)["perimeter"]


def centroid(geometry: Column) -> Column:
    m = measures(geometry)
    return F.struct(m["cx"].alias("x"), m["cy"].alias("y"))


@per_application
def _reproject_function(src: int, dst: int):
    @F.arrow_udf(GEOMETRY)
    def reprojected(geometry: pa.Array) -> pa.Array:
        shapes = kernels.Shapes(geometry, projections.projector(src, dst))
        return kernels.renest(geometry, shapes.x, shapes.y)

    return reprojected


def reproject(geometry: Column, src: int, dst: int) -> Column:
    return geometry if src == dst else _reproject_function(src, dst)(geometry)


@per_application
def _equal_area_centroid():
    @F.arrow_udf("struct<x:double,y:double>")
    def center(geometry: pa.Array) -> pa.Array:
        shapes = kernels.Shapes(geometry, projections.laea_forward)
        lon, lat = kernels.equal_area_centers(shapes, projections.laea_inverse)
        return pa.StructArray.from_arrays(
            [pa.array(lon, mask=shapes.null), pa.array(lat, mask=shapes.null)], names=["x", "y"]
        )

    return _once(center)


def equal_area_centroid(geometry: Column) -> Column:
    """Centroid taken in EPSG:3035 and returned in degrees."""
    return _equal_area_centroid()(geometry)


@per_application
def _valid_function():
    @F.arrow_udf("boolean")
    def valid(geometry: pa.Array) -> pa.Array:
        return pa.array(kernels.valid(kernels.Shapes(geometry)))

    return _once(valid)


def is_valid(geometry: Column) -> Column:
    return _valid_function()(geometry)


@per_application
def _box_test():
    @F.arrow_udf("boolean")
    def meets_box(geometry: pa.Array, x0: pa.Array, y0: pa.Array, x1: pa.Array, y1: pa.Array) -> pa.Array:
        shapes = kernels.Shapes(geometry)
        frames = kernels.Shapes(kernels.boxes(*_doubles(x0, y0, x1, y1)))
        return pa.array(kernels.intersects(shapes, frames), pa.bool_(), mask=shapes.null)

    return _once(meets_box)


def intersects_box(geometry: Column, bbox: Column, frame: Column) -> Column:
    """Geometry shares a point with an axis-aligned frame; touching counts.

    A covering box inside the frame proves it, disjoint boxes disprove it; only areas
    that reach over the frame's border go to the exact test.
    """
    settled = box_within(bbox, frame)
    exact = _box_test()(
        F.when(~settled, geometry), frame["xmin"], frame["ymin"], frame["xmax"], frame["ymax"]
    )
    return boxes_overlap(bbox, frame) & (settled | F.coalesce(exact, F.lit(False)))


@per_application
def _pair_function():
    @F.arrow_udf("struct<meets:boolean,common:double,area_a:double,area_b:double>")
    def related(a: pa.Array, b: pa.Array) -> pa.Array:
        one, other = kernels.Shapes(a), kernels.Shapes(b)
        null = one.null | other.null
        columns = [
            pa.array(kernels.intersects(one, other), pa.bool_(), mask=null),
            pa.array(kernels.overlap_area(one, other), pa.float64(), mask=null),
            pa.array(kernels.measures(one)["area"], pa.float64(), mask=null),
            pa.array(kernels.measures(other)["area"], pa.float64(), mask=null),
        ]
        return pa.StructArray.from_arrays(columns, names=["meets", "common", "area_a", "area_b"])

    return _once(related)


def pair_relation(a: Column, b: Column) -> Column:
    """struct(meets, common, area_a, area_b) of two areas in one pass."""
    return _pair_function()(a, b)


@per_application
def _intersects_function():
    @F.arrow_udf("boolean")
    def meets(a: pa.Array, b: pa.Array) -> pa.Array:
        one, other = kernels.Shapes(a), kernels.Shapes(b)
        return pa.array(kernels.intersects(one, other), pa.bool_(), mask=one.null | other.null)

    return _once(meets)


def intersects(a: Column, b: Column) -> Column:
    return _intersects_function()(a, b)


def iou(relation: Column) -> Column:
    """Overlap ratio of a ``pair_relation``; NULL when the union has no area."""
    union = relation["area_a"] + relation["area_b"] - relation["common"]
    return relation["common"] / F.nullif(union, F.lit(0.0))


@per_application
def _contains_function():
    @F.arrow_udf("boolean")
    def holds(geometry: pa.Array, x: pa.Array, y: pa.Array) -> pa.Array:
        shapes = kernels.Shapes(geometry)
        px, py = _doubles(x, y)
        inside, _ = kernels.locate(px, py, np.arange(shapes.n), shapes)
        return pa.array(inside, pa.bool_(), mask=shapes.null)

    return _once(holds)


def contains(geometry: Column, x: Column, y: Column) -> Column:
    """Point strictly inside the area; the boundary does not count."""
    return _contains_function()(geometry, x, y)


@per_application
def _inner_point_function():
    @F.arrow_udf("struct<x:double,y:double>")
    def inner(geometry: pa.Array) -> pa.Array:
        shapes = kernels.Shapes(geometry)
        x, y = kernels.inner_point(shapes)
        empty = np.isnan(x)
        return pa.StructArray.from_arrays([pa.array(x, mask=empty), pa.array(y, mask=empty)], names=["x", "y"])

    return _once(inner)


def point_on_surface(geometry: Column) -> Column:
    return _inner_point_function()(geometry)


@per_application
def _zone_test():
    @F.arrow_udf("boolean")
    def meets_zone(geometry: pa.Array, edges: pa.Array, ax: pa.Array, ay: pa.Array, inside: pa.Array) -> pa.Array:
        shapes = kernels.Shapes(geometry)
        x, y = _doubles(ax, ay)
        flag = inside.to_numpy(zero_copy_only=False).astype(bool)
        return pa.array(kernels.meets_zone(shapes, edges, x, y, flag), pa.bool_(), mask=shapes.null)

    return _once(meets_zone)


def meets_zone(geometry: Column, edges: Column, ax: Column, ay: Column, inside: Column) -> Column:
    return _zone_test()(geometry, edges, ax, ay, inside)


@per_application
def _decode_function():
    @F.arrow_udf(GEOMETRY)
    def decoded(value: pa.Array) -> pa.Array:
        return wkb.decode(value)

    return _once(decoded)


def from_wkb(value: Column) -> Column:
    """WKB to nested rings (2D); NULL for values that hold no area."""
    return _decode_function()(value)


@per_application
def _encode_function():
    @F.arrow_udf("binary")
    def encoded(geometry: pa.Array) -> pa.Array:
        return wkb.encode(geometry)

    return _once(encoded)


def to_wkb(geometry: Column) -> Column:
    return _encode_function()(geometry)
