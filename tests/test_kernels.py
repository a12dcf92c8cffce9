"""Geometry kernels against independent arithmetic."""

import math
import struct

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from plotgrid.functions import kernels as k
from plotgrid.functions import projections as p
from plotgrid.functions import tiles, wkb


def shape(*parts):
    """Shapes of one geometry; parts are lists of rings, rings lists of points."""
    return k.Shapes(wkb.from_lists([[[np.array(r, float) for r in part] for part in parts]]))


def ring(points):
    return [*points, points[0]]


def rect(x0, y0, x1, y1):
    return [ring([(x0, y0), (x1, y0), (x1, y1), (x0, y1)])]


SQUARE = rect(0, 0, 4, 4)
HOLED = [SQUARE[0], ring([(1, 1), (1, 3), (3, 3), (3, 1)])]
coordinate = st.integers(-20, 20)


@st.composite
def star(draw):
    """A simple polygon around a center: sorted angles, free radii, often concave."""
    n = draw(st.integers(3, 9))
    cx, cy = draw(st.floats(-5, 5)), draw(st.floats(-5, 5))
    radii = draw(st.lists(st.floats(0.5, 6), min_size=n, max_size=n))
    turn = draw(st.floats(0, 6.28))
    points = [
        (cx + r * math.cos(turn + 2 * math.pi * i / n), cy + r * math.sin(turn + 2 * math.pi * i / n))
        for i, r in enumerate(radii)
    ]
    if draw(st.booleans()):
        points.reverse()
    return ring(points)


def clip_area(subject, clipper):
    """Area of subject within a convex clipper by cutting along each of its edges."""
    points = subject[:-1]
    twice = sum(a[0] * b[1] - b[0] * a[1] for a, b in zip(clipper, clipper[1:]))
    edges = list(zip(clipper, clipper[1:]))
    for (ax, ay), (bx, by) in edges:
        side = [((bx - ax) * (y - ay) - (by - ay) * (x - ax)) * (1 if twice > 0 else -1) for x, y in points]
        kept = []
        for i, here in enumerate(side):
            j = (i + 1) % len(points)
            if here >= 0:
                kept.append(points[i])
            if (here >= 0) != (side[j] >= 0):
                t = here / (here - side[j])
                kept.append((points[i][0] + t * (points[j][0] - points[i][0]), points[i][1] + t * (points[j][1] - points[i][1])))
        points = kept
        if len(points) < 3:
            return 0.0
    return abs(sum(points[i - 1][0] * points[i][1] - points[i][0] * points[i - 1][1] for i in range(len(points)))) / 2


@settings(max_examples=150, deadline=None)
@given(star(), st.floats(-6, 6), st.floats(-6, 6), st.floats(0.5, 5), st.floats(0, 6.28))
def test_overlap_area_matches_clipping(subject, cx, cy, size, turn):
    clipper = ring([(cx + size * math.cos(turn + i * 2.1), cy + size * math.sin(turn + i * 2.1)) for i in range(3)])
    a, b = shape([subject]), shape([clipper])
    common = k.overlap_area(a, b)[0]
    assert common == pytest.approx(clip_area(subject, clipper), abs=1e-8)
    assert k.overlap_area(b, a)[0] == pytest.approx(common, abs=1e-8)
    assert common <= min(k.measures(a)["area"][0], k.measures(b)["area"][0]) + 1e-8
    if common > 1e-7:
        assert k.intersects(a, b)[0] and k.intersects(b, a)[0]
    assert k.intersects(a, b)[0] == k.intersects(b, a)[0]


@settings(max_examples=100, deadline=None)
@given(star(), st.floats(0, 6.28), st.floats(-50, 50))
def test_area_and_perimeter_survive_turning(points, turn, shift):
    c, s = math.cos(turn), math.sin(turn)
    moved = [(c * x - s * y + shift, s * x + c * y - shift) for x, y in points]
    before, after = k.measures(shape([points])), k.measures(shape([moved]))
    assert after["area"][0] == pytest.approx(before["area"][0], rel=1e-9, abs=1e-9)
    assert after["perimeter"][0] == pytest.approx(before["perimeter"][0], rel=1e-9)
    cx, cy = before["cx"][0], before["cy"][0]
    assert after["cx"][0] == pytest.approx(c * cx - s * cy + shift, abs=1e-6)


def test_measures_with_hole_and_parts():
    holed = k.measures(shape(HOLED))
    assert (holed["area"][0], holed["perimeter"][0], holed["cx"][0], holed["cy"][0]) == (12, 24, 2, 2)
    two = k.measures(shape(rect(0, 0, 1, 1), rect(10, 0, 11, 1)))
    assert (two["area"][0], two["cx"][0]) == (2, 5.5)


def test_overlap_of_holed_shape_and_its_hole():
    assert k.overlap_area(shape(HOLED), shape(rect(1, 1, 3, 3)))[0] == 0
    assert k.overlap_area(shape(HOLED), shape(rect(0, 0, 2, 2)))[0] == 3
    assert k.overlap_area(shape(rect(0, 0, 1, 1), rect(2, 0, 3, 1)), shape(rect(0.5, 0, 2.5, 1)))[0] == 1


@pytest.mark.parametrize("other, expected", [
    (rect(4, 4, 5, 5), True),          # corner touch
    (rect(4, 0, 5, 1), True),          # edge touch
    (rect(5, 5, 6, 6), False),
    (rect(1, 1, 2, 2), True),          # inside
    (rect(-1, -1, 9, 9), True),        # around
])
def test_intersects_is_closed(other, expected):
    assert k.intersects(shape(SQUARE), shape(other))[0] == expected
    assert k.intersects(shape(other), shape(SQUARE))[0] == expected


def test_shape_inside_a_hole_does_not_intersect():
    assert not k.intersects(shape(HOLED), shape(rect(1.5, 1.5, 2.5, 2.5)))[0]
    assert k.intersects(shape(HOLED), shape(rect(1, 1, 2.5, 2.5)))[0]
    # A second part far away must be looked at as well.
    assert k.intersects(shape(rect(90, 90, 91, 91), rect(1, 1, 2, 2)), shape(SQUARE))[0]


@pytest.mark.parametrize("x, y, inside, touch", [
    (2, 2, False, False), (0.5, 0.5, True, False), (0, 2, False, True), (4, 4, False, True),
    (1, 2, False, True), (5, 2, False, False), (0.5, 1, True, False), (0.5, 3, True, False),
])
def test_point_location_excludes_boundary_and_hole(x, y, inside, touch):
    got = k.locate(np.array([float(x)]), np.array([float(y)]), np.array([0]), shape(HOLED))
    assert (bool(got[0][0]), bool(got[1][0])) == (inside, touch)


@pytest.mark.parametrize("parts, expected", [
    ([SQUARE], True),
    ([HOLED], True),
    ([[ring([(0, 0), (4, 4), (4, 0), (0, 4)])]], False),                       # bow tie
    ([[[(0, 0), (4, 0), (4, 4), (0, 4)]]], False),                             # open
    ([[[(0, 0), (4, 0), (0, 0)]]], False),                                     # three points
    ([[ring([(0, 0), (4, 0), (2, 0)])]], False),                               # no area
    ([[SQUARE[0], ring([(9, 9), (9, 10), (10, 10), (10, 9)])]], False),        # hole outside
    ([[SQUARE[0], ring([(1, 1), (5, 1), (5, 2), (1, 2)])]], False),            # hole crosses
    ([[ring([(0, 0), (4, 0), (4, 4), (2, 0), (0, 4)])]], False),               # touches itself
    ([[ring([(0, 0), (4, 0), (6, 0), (4, 0), (4, 4), (0, 4)])]], False),       # spike
    ([[ring([(0, 0), (2, 0), (2, 0), (4, 0), (4, 4), (0, 4)])]], True),        # repeated point
    ([SQUARE, rect(1, 1, 2, 2)], False),                                       # nested parts
    ([SQUARE, rect(5, 0, 6, 1)], True),
    ([SQUARE, rect(4, 4, 5, 5)], True),                                        # parts touch
    ([HOLED, rect(1.5, 1.5, 2.5, 2.5)], True),                                 # part in a hole
    ([[ring([(0, 0), (math.nan, 0), (4, 4), (0, 4)])]], False),
])
def test_validity(parts, expected):
    assert k.valid(shape(*parts))[0] == expected


def test_validity_of_null_and_batches():
    array = wkb.from_lists([None, [[np.array(SQUARE[0], float)]], [[np.array(ring([(0, 0), (4, 4), (4, 0), (0, 4)]), float)]]])
    assert k.valid(k.Shapes(array)).tolist() == [False, True, False]


@settings(max_examples=100, deadline=None)
@given(star())
def test_inner_point_is_inside(points):
    s = shape([points])
    x, y = k.inner_point(s)
    inside, touch = k.locate(x, y, np.array([0]), s)
    assert inside[0] or touch[0]


def test_inner_point_takes_widest_span():
    u_shape = ring([(0, 0), (10, 0), (10, 4), (7, 4), (7, 1), (1, 1), (1, 4), (0, 4)])
    x, y = k.inner_point(shape([u_shape]))
    assert (x[0], y[0]) == (8.5, 2.5)


def test_many_edge_pairs_go_in_steps(monkeypatch):
    monkeypatch.setattr(k, "EDGE_PAIRS_PER_STEP", 7)
    array = wkb.from_lists([[[np.array(SQUARE[0], float) + i]] for i in range(6)])
    other = wkb.from_lists([[[np.array(SQUARE[0], float) + i + 1]] for i in range(6)])
    assert k.intersects(k.Shapes(array), k.Shapes(other)).all()
    assert k.overlap_area(k.Shapes(array), k.Shapes(other)).tolist() == [9.0] * 6


def test_wkb_round_trip_and_odd_values():
    shapes = [
        [[np.array(SQUARE[0], float)]], None, [[np.array(r, float) for r in HOLED]],
        [[np.array(SQUARE[0], float)], [np.array(rect(9, 9, 10, 10)[0], float)]],
    ]
    array = wkb.from_lists(shapes)
    assert wkb.decode(wkb.encode(array)).equals(array)
    plain = wkb.from_lists(shapes[:1] * 3)
    assert wkb.decode(wkb.encode(plain)).equals(plain)


def test_wkb_z_big_endian_and_garbage():
    xyz = [(0, 0, 7), (4, 0, 7), (4, 4, 7), (0, 0, 7)]
    with_z = struct.pack("<BII", 1, 1003, 1) + struct.pack("<I", 4) + b"".join(struct.pack("<3d", *c) for c in xyz)
    ewkb_z = struct.pack("<BII", 1, 0x80000003, 1) + struct.pack("<I", 4) + b"".join(struct.pack("<3d", *c) for c in xyz)
    big = struct.pack(">BII", 0, 3, 1) + struct.pack(">I", 4) + b"".join(struct.pack(">2d", *c[:2]) for c in xyz)
    point = struct.pack("<BI2d", 1, 1, 1.0, 2.0)
    decoded = wkb.decode(pa.array([with_z, ewkb_z, big, point, b"xyz", b"", None], pa.binary())).to_pylist()
    wanted = [[[{"x": float(x), "y": float(y)} for x, y, _ in xyz]]]
    assert decoded == [wanted, wanted, wanted, None, None, None, None]


@pytest.mark.parametrize("code", [3035, 3857])
def test_projection_round_trip(code):
    lon, lat = (a.ravel() for a in np.meshgrid(np.linspace(4, 31, 40), np.linspace(57, 71, 40)))
    x, y = p.projector(code, 4326)(*p.projector(4326, code)(lon, lat))
    assert np.abs(x - lon).max() < 1e-9 and np.abs(y - lat).max() < 1e-9


def test_projection_fixed_points():
    east, north = p.transverse_mercator(np.array([9.0]), np.array([0.0]), 25832)
    assert (east[0], north[0]) == pytest.approx((500000, 0), abs=1e-6)
    # Meridian arc from the equator to the pole on GRS80 is 10,001,965.729 m.
    _, pole = p.transverse_mercator(np.array([9.0]), np.array([90.0 - 1e-12]), 25832)
    assert pole[0] / p.TM_SCALE == pytest.approx(10001965.729, abs=0.01)
    east, north = p.laea_forward(np.array([10.0]), np.array([52.0]))
    assert (east[0], north[0]) == pytest.approx((4321000, 3210000), abs=1e-6)
    # EPSG guidance note 7-2 worked example for this projection.
    east, north = p.laea_forward(np.array([5.0]), np.array([50.0]))
    assert (east[0], north[0]) == pytest.approx((3962799.45, 2999718.85), abs=0.01)


def test_unknown_projection_is_refused():
    with pytest.raises(ValueError):
        p.projector(25832, 3857)


def _random_shape(rng, kind):
    def ring():
        points = rng.normal(size=(rng.integers(3, 9), 2)) * 3000 + 2000
        return np.vstack([points, points[:1]])

    return [[[ring()]], [[ring(), ring(), ring()]], [[ring()], [ring(), ring()]], None, []][kind]


@pytest.mark.parametrize("weights", [(1, 0, 0, 0, 0), (5, 2, 1, 1, 0.5), (0, 0, 0, 1, 0)])
def test_wkb_batches_equal_single_values(weights):
    rng = np.random.default_rng(3)
    shapes = [_random_shape(rng, k) for k in rng.choice(5, 300, p=np.array(weights) / sum(weights))]
    array = wkb.from_lists(shapes)
    values = wkb.encode(array).to_pylist()
    assert [v is None for v in values] == [s is None for s in shapes]
    assert wkb.decode(pa.array(values, pa.binary())).equals(array)
    good = next((v for v in values if v), b"")
    values += [b"junk", b"", None, good[:20], good[:-3], good + b"\0" * 8]
    want = [None if v is None else wkb._read(v) for v in values]
    assert wkb.decode(pa.array(values, pa.binary())).equals(wkb.from_lists(want))


def _clip_by_vertex(ring, low, high):
    for axis, sign, bound in ((0, 1, low), (0, -1, -high), (1, 1, low), (1, -1, -high)):
        kept = []
        for a, b in zip(ring, ring[1:]):
            va, vb = sign * a[axis], sign * b[axis]
            if va >= bound:
                kept.append(a)
            if (va >= bound) != (vb >= bound):
                kept.append(a + (bound - va) / (vb - va) * (b - a))
        ring = kept + kept[:1] if len(kept) >= 3 else []
    return np.floor(np.array(ring).reshape(-1, 2) + 0.5)


def test_clipping_all_rings_at_once_equals_each_by_itself():
    rng = np.random.default_rng(4)
    rings = [np.floor(_random_shape(rng, 0)[0][0]) for _ in range(400)]
    owner = np.repeat(np.arange(400), [len(r) for r in rings])
    got, ring = tiles._clip_rings(np.concatenate(rings), owner, -256.0, 4352.0)
    for i, r in enumerate(rings):
        assert np.array_equal(got[ring == i], _clip_by_vertex(list(r), -256.0, 4352.0))
