"""Planar geometry over Arrow batches of nested rings.

A geometry is ``array<array<array<struct<x,y>>>>``: parts, rings, points. The first
ring of a part is its shell, the others are holes; every ring repeats its first
point at the end. Functions here see one Arrow batch inside a Spark task and work on
flat numpy arrays; the DataFrame side is in ``geometry.py``.
"""

from __future__ import annotations

from collections.abc import Iterator
from types import SimpleNamespace

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

EDGE_PAIRS_PER_STEP = 1 << 20


def _lengths(array: pa.ListArray) -> np.ndarray:
    return pc.fill_null(pc.list_value_length(array), 0).to_numpy(zero_copy_only=False).astype(np.int64)


def _starts(lengths: np.ndarray) -> np.ndarray:
    return np.concatenate(([0], np.cumsum(lengths)))


class Shapes:
    """Flat arrays of one batch: points, rings, parts and edges with their owners."""

    def __init__(self, array: pa.ListArray, project=None):
        part_len = _lengths(array)
        parts = array.flatten()
        ring_len = _lengths(parts)
        rings = parts.flatten()
        point_len = _lengths(rings)
        points = rings.flatten()
        self.n = len(array)
        self.null = array.is_null().to_numpy(zero_copy_only=False)
        self.x = points.field(0).to_numpy(zero_copy_only=False).astype(np.float64)
        self.y = points.field(1).to_numpy(zero_copy_only=False).astype(np.float64)
        if project is not None:
            self.x, self.y = project(self.x, self.y)
        self.part_geom = np.repeat(np.arange(self.n), part_len)
        self.ring_part = np.repeat(np.arange(len(ring_len)), ring_len)
        self.ring_geom = self.part_geom[self.ring_part]
        first_ring = _starts(ring_len)[:-1]
        self.ring_hole = np.arange(len(point_len)) != first_ring[self.ring_part]
        self.ring_len = point_len
        self.ring_start = _starts(point_len)[:-1]
        self.point_ring = np.repeat(np.arange(len(point_len)), point_len)
        self.point_geom = self.ring_geom[self.point_ring]
        is_edge = np.ones(len(self.x), dtype=bool)
        filled = point_len > 0
        is_edge[(self.ring_start + point_len - 1)[filled]] = False
        start = np.flatnonzero(is_edge)
        self.edge_ring = self.point_ring[start]
        self.edge_geom = self.ring_geom[self.edge_ring]
        self.x0, self.y0 = self.x[start], self.y[start]
        self.x1, self.y1 = self.x[start + 1], self.y[start + 1]
        self.edge_count = np.bincount(self.edge_geom, minlength=self.n)
        self.edge_start = _starts(self.edge_count)[:-1]

    def origin(self) -> tuple[np.ndarray, np.ndarray]:
        """First point of each geometry; subtracting it keeps large coordinates exact."""
        ox, oy = np.zeros(self.n), np.zeros(self.n)
        geom, first = np.unique(self.point_geom, return_index=True)
        ox[geom], oy[geom] = self.x[first], self.y[first]
        return ox, oy

    def ring_weight(self) -> np.ndarray:
        """+1 or -1 per ring so that shells count positive and holes negative."""
        ox, oy = self.origin()
        ax, ay = self.x0 - ox[self.edge_geom], self.y0 - oy[self.edge_geom]
        bx, by = self.x1 - ox[self.edge_geom], self.y1 - oy[self.edge_geom]
        twice = np.bincount(self.edge_ring, ax * by - bx * ay, minlength=len(self.ring_len))
        return np.sign(twice) * np.where(self.ring_hole, -1.0, 1.0)


def measures(shapes: Shapes) -> dict[str, np.ndarray]:
    """Area, perimeter and area-weighted centroid of every geometry."""
    ox, oy = shapes.origin()
    geom = shapes.edge_geom
    ax, ay = shapes.x0 - ox[geom], shapes.y0 - oy[geom]
    bx, by = shapes.x1 - ox[geom], shapes.y1 - oy[geom]
    weight = shapes.ring_weight()[shapes.edge_ring]
    cross = (ax * by - bx * ay) * weight
    length = np.hypot(bx - ax, by - ay)
    twice = np.bincount(geom, cross, minlength=shapes.n)
    perimeter = np.bincount(geom, length, minlength=shapes.n)
    mx = np.bincount(geom, (ax + bx) * cross, minlength=shapes.n)
    my = np.bincount(geom, (ay + by) * cross, minlength=shapes.n)
    lx = np.bincount(geom, (ax + bx) * length, minlength=shapes.n)
    ly = np.bincount(geom, (ay + by) * length, minlength=shapes.n)
    with np.errstate(divide="ignore", invalid="ignore"):
        flat = np.where(perimeter > 0, 2 * perimeter, np.nan)
        cx = np.where(twice != 0, mx / (3 * twice), np.where(perimeter > 0, lx / flat, 0.0)) + ox
        cy = np.where(twice != 0, my / (3 * twice), np.where(perimeter > 0, ly / flat, 0.0)) + oy
    return {"area": twice / 2, "perimeter": perimeter, "cx": cx, "cy": cy}


def equal_area_centers(projected: Shapes, back) -> tuple[np.ndarray, np.ndarray]:
    """Centroids of projected shapes, turned back to degrees."""
    values = measures(projected)
    return back(values["cx"], values["cy"])


def shell_bounds(shapes: Shapes) -> list[pa.Array]:
    """Least x and y, greatest x and y of every geometry's shells; NaN for one without points."""
    shell = ~shapes.ring_hole[shapes.point_ring]
    geom, first = np.unique(shapes.point_geom[shell], return_index=True)
    found = [np.full(shapes.n, np.nan) for _ in range(4)]
    if len(geom):
        for out, values, step in zip(found, (shapes.x, shapes.y) * 2, (np.minimum, np.minimum, np.maximum, np.maximum)):
            out[geom] = step.reduceat(values[shell], first)
    return [pa.array(v) for v in found]


def _pair_steps(owner: np.ndarray, start: np.ndarray, count: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """All (left item, right item) index pairs with the same owner, in bounded steps.

    ``owner[i]`` is the group of left item i; group g owns right items
    ``start[g] .. start[g] + count[g] - 1``.
    """
    fan_out = count[owner]
    done = np.cumsum(fan_out)
    low = 0
    while low < len(owner):
        base = done[low - 1] if low else 0
        high = max(low + 1, int(np.searchsorted(done, base + EDGE_PAIRS_PER_STEP, side="right")))
        fan = fan_out[low:high]
        left = np.repeat(np.arange(low, high), fan)
        inner = np.arange(len(left)) - np.repeat(np.cumsum(fan) - fan, fan)
        yield left, start[owner[left]] + inner
        low = high


def _turn(ax, ay, bx, by, px, py):
    return np.sign((bx - ax) * (py - ay) - (by - ay) * (px - ax))


def segments_meet(ax, ay, bx, by, cx, cy, dx, dy) -> np.ndarray:
    """Closed segments ab and cd share at least one point."""
    apart = (
        (np.maximum(ax, bx) < np.minimum(cx, dx)) | (np.maximum(cx, dx) < np.minimum(ax, bx))
        | (np.maximum(ay, by) < np.minimum(cy, dy)) | (np.maximum(cy, dy) < np.minimum(ay, by))
    )
    crossing = (
        (_turn(ax, ay, bx, by, cx, cy) * _turn(ax, ay, bx, by, dx, dy) <= 0)
        & (_turn(cx, cy, dx, dy, ax, ay) * _turn(cx, cy, dx, dy, bx, by) <= 0)
    )
    return crossing & ~apart


def locate(px, py, owner, shapes: Shapes) -> tuple[np.ndarray, np.ndarray]:
    """For point i against geometry ``owner[i]``: (strictly inside, on the boundary)."""
    odd = np.zeros(len(px), dtype=np.int64)
    touch = np.zeros(len(px), dtype=bool)
    for point, edge in _pair_steps(owner, shapes.edge_start, shapes.edge_count):
        qx, qy = px[point], py[point]
        x0, y0, x1, y1 = shapes.x0[edge], shapes.y0[edge], shapes.x1[edge], shapes.y1[edge]
        straddles = (y0 > qy) != (y1 > qy)
        side = (x1 - x0) * (qy - y0) - (y1 - y0) * (qx - x0)
        right_of_point = straddles & (np.where(y1 > y0, side, -side) > 0)
        odd += np.bincount(point[right_of_point], minlength=len(px))
        on_edge = (
            (side == 0) & (np.minimum(x0, x1) <= qx) & (qx <= np.maximum(x0, x1))
            & (np.minimum(y0, y1) <= qy) & (qy <= np.maximum(y0, y1))
        )
        touch[point[on_edge]] = True
    return (odd % 2 == 1) & ~touch, touch


def intersects(a: Shapes, b: Shapes) -> np.ndarray:
    """Row-wise: the closed areas a[i] and b[i] share at least one point."""
    hit = np.zeros(a.n, dtype=bool)
    for ea, eb in _pair_steps(a.edge_geom, b.edge_start, b.edge_count):
        meet = segments_meet(
            a.x0[ea], a.y0[ea], a.x1[ea], a.y1[ea], b.x0[eb], b.y0[eb], b.x1[eb], b.y1[eb]
        )
        hit[a.edge_geom[ea[meet]]] = True
    for one, other in ((a, b), (b, a)):
        rings = np.flatnonzero((one.ring_len > 0) & ~hit[one.ring_geom])
        first, owner = one.ring_start[rings], one.ring_geom[rings]
        inside, touch = locate(one.x[first], one.y[first], owner, other)
        hit[owner[inside | touch]] = True
    return hit


def overlap_area(a: Shapes, b: Shapes) -> np.ndarray:
    """Row-wise area of the intersection of a[i] and b[i].

    Each polygon is the signed sum of the strips below its edges, so the common area is
    the signed sum, over edge pairs, of the integral of the lower edge over their common
    x range. No clipped geometry is built; holes and concave shapes need no special case.
    """
    base = np.full(a.n, np.inf)
    np.minimum.at(base, a.point_geom, a.y)
    np.minimum.at(base, b.point_geom, b.y)
    sign_a = -np.sign(a.x1 - a.x0) * a.ring_weight()[a.edge_ring]
    sign_b = -np.sign(b.x1 - b.x0) * b.ring_weight()[b.edge_ring]
    total = np.zeros(a.n)

    def height(shape, edge, at, floor):
        x0, y0 = shape.x0[edge], shape.y0[edge]
        slope = (shape.y1[edge] - y0) / (shape.x1[edge] - x0)
        return (y0 - floor) + slope * (at - x0)

    for ea, eb in _pair_steps(a.edge_geom, b.edge_start, b.edge_count):
        low = np.maximum(np.minimum(a.x0[ea], a.x1[ea]), np.minimum(b.x0[eb], b.x1[eb]))
        high = np.minimum(np.maximum(a.x0[ea], a.x1[ea]), np.maximum(b.x0[eb], b.x1[eb]))
        keep = (high > low) & (sign_a[ea] * sign_b[eb] != 0)
        ea, eb, low, high = ea[keep], eb[keep], low[keep], high[keep]
        floor = base[a.edge_geom[ea]]
        f_low, f_high = height(a, ea, low, floor), height(a, ea, high, floor)
        g_low, g_high = height(b, eb, low, floor), height(b, eb, high, floor)
        d_low, d_high = f_low - g_low, f_high - g_high
        m_low, m_high = np.minimum(f_low, g_low), np.minimum(f_high, g_high)
        cross = d_low * d_high < 0
        t = np.where(cross, d_low / np.where(cross, d_low - d_high, 1.0), 0.0)
        middle = f_low + t * (f_high - f_low)
        plain = (m_low + m_high) / 2
        split = (t * (m_low + middle) + (1 - t) * (middle + m_high)) / 2
        strip = (high - low) * np.where(cross, split, plain)
        total += np.bincount(a.edge_geom[ea], sign_a[ea] * sign_b[eb] * strip, minlength=a.n)
    return np.maximum(total, 0.0)


def boxes(minx, miny, maxx, maxy) -> pa.ListArray:
    """Arrow array of axis-aligned rectangles."""
    n = len(minx)
    x = np.stack([minx, maxx, maxx, minx, minx], axis=1).ravel()
    y = np.stack([miny, miny, maxy, maxy, miny], axis=1).ravel()
    return nest(x, y, np.full(n, 5), np.ones(n, dtype=np.int64), np.ones(n, dtype=np.int64))


def nest(x, y, ring_len, rings_per_part, parts_per_geom, null=None) -> pa.ListArray:
    """Build the nested Arrow array from flat coordinates and counts per level."""
    points = pa.StructArray.from_arrays(
        [pa.array(x, pa.float64()), pa.array(y, pa.float64())], names=["x", "y"]
    )
    rings = pa.ListArray.from_arrays(pa.array(_starts(ring_len), pa.int32()), points)
    parts = pa.ListArray.from_arrays(pa.array(_starts(rings_per_part), pa.int32()), rings)
    mask = None if null is None else pa.array(null, pa.bool_())
    return pa.ListArray.from_arrays(pa.array(_starts(parts_per_geom), pa.int32()), parts, mask=mask)


def renest(array: pa.ListArray, x, y) -> pa.ListArray:
    """Same nesting as ``array`` with other coordinates."""
    parts = array.flatten()
    rings = parts.flatten()
    return nest(
        x, y, _lengths(rings), _lengths(parts), _lengths(array),
        array.is_null().to_numpy(zero_copy_only=False),
    )


def meets_zone(shapes: Shapes, edges: pa.ListArray, ax, ay, anchor_inside) -> np.ndarray:
    """Row-wise: the shape shares a point with a zone known by its edges in one window.

    The window holds the shape and the anchor (ax, ay), and ``edges`` are all zone edges
    that meet the window, so walking from a shape vertex to the anchor and counting the
    zone edges crossed tells whether that vertex is inside the zone.
    """
    count = _lengths(edges)
    flat = edges.flatten()
    zx0, zy0, zx1, zy1 = (flat.field(i).to_numpy(zero_copy_only=False) for i in range(4))
    start = _starts(count)[:-1]
    hit = np.zeros(shapes.n, dtype=bool)
    for e, z in _pair_steps(shapes.edge_geom, start, count):
        meet = segments_meet(
            shapes.x0[e], shapes.y0[e], shapes.x1[e], shapes.y1[e], zx0[z], zy0[z], zx1[z], zy1[z]
        )
        hit[shapes.edge_geom[e[meet]]] = True
    rings = np.flatnonzero((shapes.ring_len > 0) & ~hit[shapes.ring_geom])
    first, owner = shapes.ring_start[rings], shapes.ring_geom[rings]
    px, py = shapes.x[first], shapes.y[first]
    crossed = np.zeros(len(rings), dtype=np.int64)
    for p, z in _pair_steps(owner, start, count):
        qx, qy, bx, by = px[p], py[p], ax[owner[p]], ay[owner[p]]
        x0, y0, x1, y1 = zx0[z], zy0[z], zx1[z], zy1[z]
        with np.errstate(divide="ignore", invalid="ignore"):
            up = ((x0 > qx) != (x1 > qx)) & _between(y0 + (y1 - y0) * (qx - x0) / (x1 - x0), qy, by)
            along = ((y0 > by) != (y1 > by)) & _between(x0 + (x1 - x0) * (by - y0) / (y1 - y0), qx, bx)
        crossed += np.bincount(p, up.astype(np.int64) + along, minlength=len(rings)).astype(np.int64)
    inside = anchor_inside[owner] ^ (crossed % 2 == 1)
    hit[owner[inside]] = True
    zone_owner = np.repeat(np.arange(shapes.n), count)
    rest = np.flatnonzero(~hit[zone_owner])
    zone_inside, zone_touch = locate(zx0[rest], zy0[rest], zone_owner[rest], shapes)
    hit[zone_owner[rest[zone_inside | zone_touch]]] = True
    return hit


def _between(value, a, b):
    return (value > np.minimum(a, b)) & (value < np.maximum(a, b))


def valid(shapes: Shapes) -> np.ndarray:
    """Simple closed rings, holes inside their shell, no overlapping parts."""
    ok = ~shapes.null
    ok &= np.bincount(shapes.ring_geom, minlength=shapes.n) > 0
    finite = np.isfinite(shapes.x) & np.isfinite(shapes.y)
    ok[shapes.point_geom[~finite]] = False
    short = shapes.ring_len < 4
    ok[shapes.ring_geom[short]] = False
    full = np.flatnonzero(~short)
    first, last = shapes.ring_start[full], shapes.ring_start[full] + shapes.ring_len[full] - 1
    is_open = (shapes.x[first] != shapes.x[last]) | (shapes.y[first] != shapes.y[last])
    ok[shapes.ring_geom[full[is_open]]] = False
    flat = shapes.ring_weight() == 0
    ok[shapes.ring_geom[flat]] = False
    _mark_crossings(shapes, ok)
    _mark_misplaced_rings(shapes, ok)
    return ok


def _mark_crossings(s: Shapes, ok: np.ndarray) -> None:
    """Clear ``ok`` where two edges of one geometry meet in a way a valid area forbids."""
    live = np.flatnonzero(ok[s.edge_geom] & ((s.x0 != s.x1) | (s.y0 != s.y1)))
    if not len(live):
        return
    ring, geom = s.edge_ring[live], s.edge_geom[live]
    begin = np.flatnonzero(np.concatenate(([True], ring[1:] != ring[:-1])))
    size = np.diff(np.append(begin, len(live)))
    order_in_ring = np.arange(len(live)) - np.repeat(begin, size)
    ring_size = np.repeat(size, size)
    x0, y0, x1, y1 = s.x0[live], s.y0[live], s.x1[live], s.y1[live]
    low, high = np.minimum(x0, x1), np.maximum(x0, x1)
    sweep = np.lexsort((low, geom))
    key = geom[sweep] + 1j * low[sweep]
    reach = np.searchsorted(key, geom[sweep] + 1j * high[sweep], side="right")
    position = np.arange(len(live))
    for i, j in _pair_steps(position, position + 1, np.maximum(reach - position - 1, 0)):
        a, b = sweep[i], sweep[j]
        meet = segments_meet(x0[a], y0[a], x1[a], y1[a], x0[b], y0[b], x1[b], y1[b])
        a, b = a[meet], b[meet]
        same = ring[a] == ring[b]
        gap = np.abs(order_in_ring[a] - order_in_ring[b])
        neighbours = same & ((gap == 1) | (gap == ring_size[a] - 1))
        t1 = _turn(x0[a], y0[a], x1[a], y1[a], x0[b], y0[b])
        t2 = _turn(x0[a], y0[a], x1[a], y1[a], x1[b], y1[b])
        t3 = _turn(x0[b], y0[b], x1[b], y1[b], x0[a], y0[a])
        t4 = _turn(x0[b], y0[b], x1[b], y1[b], x1[a], y1[a])
        proper = (t1 * t2 < 0) & (t3 * t4 < 0)
        dx, dy = x1[a] - x0[a], y1[a] - y0[a]
        along0 = (x0[b] - x0[a]) * dx + (y0[b] - y0[a]) * dy
        along1 = (x1[b] - x0[a]) * dx + (y1[b] - y0[a]) * dy
        shared = np.minimum(np.maximum(along0, along1), dx * dx + dy * dy) - np.maximum(np.minimum(along0, along1), 0)
        overlap = (t1 == 0) & (t2 == 0) & (shared > 0)
        bad = np.where(neighbours, overlap, same | proper | overlap)
        ok[geom[a[bad]]] = False


def _mark_misplaced_rings(s: Shapes, ok: np.ndarray) -> None:
    """Clear ``ok`` for holes outside their shell and for areas nested in each other."""
    rings = np.bincount(s.ring_geom, minlength=s.n)
    many = np.flatnonzero(ok[s.ring_geom] & (rings[s.ring_geom] > 1))
    if not len(many):
        return
    edges = np.bincount(s.edge_ring, minlength=len(s.ring_len))
    by_ring = SimpleNamespace(
        x0=s.x0, y0=s.y0, x1=s.x1, y1=s.y1, edge_start=_starts(edges)[:-1], edge_count=edges
    )
    first_ring = _starts(rings)[:-1]
    for left, q in _pair_steps(s.ring_geom[many], first_ring, rings):
        r = many[left]
        r, q = r[r != q], q[r != q]
        size = s.ring_len[r]
        pair = np.repeat(np.arange(len(r)), size)
        at = np.repeat(s.ring_start[r], size) + np.arange(len(pair)) - np.repeat(np.cumsum(size) - size, size)
        inside, touch = locate(s.x[at], s.y[at], q[pair], by_ring)
        some_inside = np.bincount(pair, inside, minlength=len(r)) > 0
        some_outside = np.bincount(pair, ~inside & ~touch, minlength=len(r)) > 0
        same_part = s.ring_part[r] == s.ring_part[q]
        r_hole, q_hole = s.ring_hole[r], s.ring_hole[q]
        # A part may lie in a hole of another part: note (ring, part) pairs of that kind.
        place = r * (len(s.part_geom) + 1) + s.ring_part[q]
        in_a_hole = np.isin(place, place[~same_part & q_hole & ~some_outside])
        bad = (r_hole & same_part & ~q_hole & some_outside) | (r_hole & same_part & q_hole & some_inside)
        bad |= ~r_hole & ~same_part & ~q_hole & some_inside & ~in_a_hole
        ok[s.ring_geom[r[bad]]] = False


def inner_point(s: Shapes) -> tuple[np.ndarray, np.ndarray]:
    """A point inside each area: middle of the widest span on a scanline at mid height.

    The scanline lies halfway between the two vertex heights next to the middle of the
    bounding box, so it never runs through a vertex.
    """
    low = np.full(s.n, np.inf)
    high = np.full(s.n, -np.inf)
    np.minimum.at(low, s.point_geom, s.y)
    np.maximum.at(high, s.point_geom, s.y)
    middle = (low + high) / 2
    below, above = low.copy(), high.copy()
    lower = s.y <= middle[s.point_geom]
    np.maximum.at(below, s.point_geom[lower], s.y[lower])
    np.minimum.at(above, s.point_geom[~lower], s.y[~lower])
    scan = (below + above) / 2
    at = scan[s.edge_geom]
    cut = np.flatnonzero((s.y0 > at) != (s.y1 > at))
    geom = s.edge_geom[cut]
    x = s.x0[cut] + (s.x1[cut] - s.x0[cut]) * (at[cut] - s.y0[cut]) / (s.y1[cut] - s.y0[cut])
    order = np.lexsort((x, geom))
    geom, x = geom[order], x[order]
    px, py = np.full(s.n, np.nan), np.full(s.n, np.nan)
    if len(x) > 1:
        left, right, owner = x[0::2], x[1::2], geom[0::2]
        best = np.lexsort((left, left - right, owner))
        pick = best[np.concatenate(([True], owner[best][1:] != owner[best][:-1]))]
        px[owner[pick]] = (left[pick] + right[pick]) / 2
        py[owner[pick]] = scan[owner[pick]]
    return px, py
