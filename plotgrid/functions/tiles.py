"""Web-map tiles as built-in expressions, and tile-space geometry."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from plotgrid.functions import geometry as g
from plotgrid.functions import kernels, projections
from plotgrid.functions.sessions import per_application

# The latitude limit of the square web map, and the tile grid.
MAX_LATITUDE = 85.05112878
EXTENT = 4096
BUFFER = 256
WORLD = 2 * math.pi * projections.MERCATOR_RADIUS


def _clamp(value: Column, low, high) -> Column:
    return F.greatest(F.lit(low), F.least(value, F.lit(high)))


def tile_x(lon: Column, z) -> Column:
    n = F.pow(F.lit(2.0), F.lit(z))
    return ((lon + 180.0) / 360.0 * n).cast("int")


def tile_y(lat: Column, z) -> Column:
    n = F.pow(F.lit(2.0), F.lit(z))
    r = F.radians(_clamp(lat, -MAX_LATITUDE, MAX_LATITUDE))
    turn = F.ln(F.tan(r) + F.lit(1.0) / F.cos(r))
    return ((F.lit(1.0) - turn / F.lit(math.pi)) / 2.0 * n).cast("int")


def lat_lon_to_tile(lat: Column, lon: Column, z, bbox: tuple[float, float, float, float] | None = None) -> Column:
    """struct(z, x, y) of the tile holding a position, clamped to ``bbox``
    (min_lat, min_lon, max_lat, max_lon) and to the map."""
    if bbox is not None:
        lat = _clamp(lat, float(bbox[0]), float(bbox[2]))
        lon = _clamp(lon, float(bbox[1]), float(bbox[3]))
    last = (F.pow(F.lit(2.0), F.lit(z)) - 1).cast("int")
    x = F.greatest(F.lit(0), F.least(tile_x(lon, z), last))
    y = F.greatest(F.lit(0), F.least(tile_y(lat, z), last))
    return F.struct(F.lit(z).cast("int").alias("z"), x.alias("x"), y.alias("y"))


def tile_envelope(z: Column, x: Column, y: Column) -> Column:
    """Tile bounds in EPSG:3857."""
    size = F.lit(WORLD) / F.pow(F.lit(2.0), z)
    half = F.lit(WORLD / 2)
    return g.box(x * size - half, half - (y + 1) * size, (x + 1) * size - half, half - y * size)


def tile_bounds(z: Column, x: Column, y: Column) -> Column:
    """Tile bounds in degrees."""
    n = F.pow(F.lit(2.0), z)

    def lat(row):
        return F.degrees(F.atan(F.sinh(F.lit(math.pi) * (F.lit(1.0) - F.lit(2.0) * row / n))))

    return g.box(x / n * 360.0 - 180.0, lat(y + 1), (x + 1) / n * 360.0 - 180.0, lat(y))


def _to_tile(geometry: pa.Array, z: pa.Array, x: pa.Array, y: pa.Array, extent: int, buffer: int) -> pa.ListArray:
    shapes = kernels.Shapes(geometry, projections.mercator_forward)
    zoom, col, row = (a.to_numpy(zero_copy_only=False).astype(np.float64) for a in (z, x, y))
    size = WORLD / 2.0**zoom
    owner = shapes.point_geom
    px = (shapes.x - (col * size - WORLD / 2)[owner]) / size[owner] * extent
    py = ((WORLD / 2 - row * size)[owner] - shapes.y) / size[owner] * extent
    # Halves go up (as floor(v + 1/2)), which both engines of the checks can repeat.
    xy = np.floor(np.stack([px, py], axis=1) + 0.5)
    return _cut_rings(shapes, xy, -float(buffer), float(extent + buffer))


@per_application
def _tile_space(extent: int, buffer: int):
    @F.arrow_udf(g.GEOMETRY)
    def to_tile(geometry: pa.Array, z: pa.Array, x: pa.Array, y: pa.Array) -> pa.Array:
        return _to_tile(geometry, z, x, y, extent, buffer)

    return g._once(to_tile)


@per_application
def _tile_shape(extent: int, buffer: int):
    @F.arrow_udf(f"struct<geometry:{g.GEOMETRY},area:double>")
    def shape(
        geometry: pa.Array, settled: pa.Array, x0: pa.Array, y0: pa.Array, x1: pa.Array, y1: pa.Array,
        z: pa.Array, x: pa.Array, y: pa.Array,
    ) -> pa.Array:
        met = settled.to_numpy(zero_copy_only=False).astype(bool)
        asked = np.flatnonzero(~met)
        if len(asked):
            rows = pa.array(asked)
            frames = kernels.boxes(*[v.take(rows).to_numpy(zero_copy_only=False) for v in (x0, y0, x1, y1)])
            met[asked] = kernels.intersects(kernels.Shapes(geometry.take(rows)), kernels.Shapes(frames))
        cut = _to_tile(geometry, z, x, y, extent, buffer)
        if not met.all():
            cut = cut.take(pa.array(np.arange(len(cut)), mask=~met))
        shapes = kernels.Shapes(cut)
        area = pa.array(kernels.measures(shapes)["area"], pa.float64(), mask=shapes.null)
        return pa.StructArray.from_arrays([cut, area], names=["geometry", "area"])

    return g._once(shape)


def tile_shape(geometry: Column, bbox: Column, z: Column, x: Column, y: Column, extent: int = EXTENT, buffer: int = BUFFER) -> Column:
    """struct(geometry, area): ``to_tile_space`` of a geometry that shares a point with the tile, and its area, in one pass.

    Both are NULL for a geometry that does not meet the tile or leaves no area there. Its box must meet the tile's;
    only those that reach over the tile's border are tested.
    """
    frame = tile_bounds(z, x, y)
    sides = [frame[c] for c in ("xmin", "ymin", "xmax", "ymax")]
    return _tile_shape(extent, buffer)(geometry, g.box_within(bbox, frame), *sides, z, x, y)


def _cut_rings(shapes: kernels.Shapes, xy: np.ndarray, low: float, high: float) -> pa.ListArray:
    """Cut closed rings to the square [low, high] and drop those left without area."""
    outside = ((xy < low) | (xy > high)).any(axis=1)
    cut = np.zeros(len(shapes.ring_len), bool)
    cut[shapes.point_ring[outside]] = True
    cut = cut[shapes.point_ring]
    clipped, clipped_ring = _clip_rings(xy[cut], shapes.point_ring[cut], low, high)
    owner = np.concatenate([shapes.point_ring[~cut], clipped_ring])
    order = np.argsort(owner, kind="stable")
    xy, owner = np.concatenate([xy[~cut], clipped])[order], owner[order]
    count = np.bincount(owner, minlength=len(shapes.ring_len))

    moved = np.ones(len(xy), bool)
    moved[1:] = (owner[1:] != owner[:-1]) | (xy[1:] != xy[:-1]).any(axis=1)
    xy, owner = xy[moved], owner[moved]
    count = np.bincount(owner, minlength=len(count))
    same = np.flatnonzero(owner[1:] == owner[:-1])
    a, b = xy[same], xy[same + 1]
    twice = np.bincount(owner[same], a[:, 0] * b[:, 1] - b[:, 0] * a[:, 1], minlength=len(count))
    keep = (count >= 4) & (twice != 0)
    # A hole goes with its shell.
    shell_kept = np.zeros(len(shapes.part_geom), bool)
    shell_kept[shapes.ring_part[keep & ~shapes.ring_hole]] = True
    keep &= shell_kept[shapes.ring_part]
    rings = np.bincount(shapes.ring_part[keep], minlength=len(shell_kept))[shell_kept]
    parts = np.bincount(shapes.part_geom[shell_kept], minlength=shapes.n)
    points = keep[owner]
    return kernels.nest(xy[points, 0], xy[points, 1], count[keep], rings, parts, parts == 0)


def _clip_rings(xy: np.ndarray, ring: np.ndarray, low: float, high: float) -> tuple[np.ndarray, np.ndarray]:
    """Closed rings cut to the square by one half-plane after the other, all rings at once."""
    for axis, limit, keep_above in ((0, low, True), (0, high, False), (1, low, True), (1, high, False)):
        xy, ring = _half_plane(xy, ring, axis, limit, keep_above)
    return np.floor(xy + 0.5), ring


def _half_plane(xy: np.ndarray, ring: np.ndarray, axis: int, limit: float, keep_above: bool):
    value, bound = (xy[:, axis], limit) if keep_above else (-xy[:, axis], -limit)
    edge = np.flatnonzero(ring[1:] == ring[:-1])
    here, there = value[edge] >= bound, value[edge + 1] >= bound
    crosses = here != there
    step = np.where(crosses, value[edge + 1] - value[edge], 1.0)
    t = (bound - value[edge]) / step
    # every edge may keep its first point and add the point where it crosses
    both = np.stack([xy[edge], xy[edge] + t[:, None] * (xy[edge + 1] - xy[edge])], axis=1).reshape(-1, 2)
    kept = np.stack([here, crosses], axis=1).ravel()
    points, owner = both[kept], np.repeat(ring[edge], 2)[kept]
    if not len(points):
        return points, owner
    enough = np.bincount(owner)[owner] >= 3
    points, owner = points[enough], owner[enough]
    first = np.flatnonzero(np.concatenate(([True], owner[1:] != owner[:-1]))) if len(owner) else np.zeros(0, np.int64)
    after = np.append(first[1:], len(owner)) if len(owner) else first
    return np.insert(points, after, points[first], axis=0), np.insert(owner, after, owner[first])


def to_tile_space(geometry: Column, z: Column, x: Column, y: Column, extent: int = EXTENT, buffer: int = BUFFER) -> Column:
    """Degrees to whole tile units, y pointing down, cut to the buffered tile; NULL when
    nothing with area remains."""
    return _tile_space(extent, buffer)(geometry, z, x, y)
