"""Cutting and tracing against plain Python, over many tiles and inside one."""

import math
import random
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from plotgrid.functions import geometry as g
from plotgrid.functions import linework as lw
from plotgrid.operators import polygonize as pz
from plotgrid.operators.coverage import union_areas

LINE = "geometry array<struct<x:double,y:double>>"


def drawing(seed, n, extent, length):
    """Slanted, upright and level lines, squares with triangles inside, on a lattice that doubles hold exactly."""
    rng = random.Random(seed)
    lines = []

    def at(x, y):
        return (round(x * 32768) / 32768, round(y * 32768) / 32768)

    for i in range(n):
        x, y, s = rng.random() * extent, rng.random() * extent, rng.random() * length
        if i % 4 == 0:
            lines.append([at(x, y), at(x + s, y), at(x + s, y + s), at(x, y + s), at(x, y)])
            lines.append([at(x + s / 4, y + s / 4), at(x + s / 2, y + s / 4), at(x + s / 3, y + s / 2), at(x + s / 4, y + s / 4)])
        elif i % 4 == 1:
            lines.append([at(x, y), at(x, y + length)])
        elif i % 4 == 2:
            lines.append([at(x, y), at(x + rng.random() * length, y + rng.random() * length), at(x + s, y - s)])
        else:
            lines.append([at(x, y), at(x + length, y)])
    return lines


def rings_of(pieces):
    """Closed walks with the next piece clockwise of the way back, until no piece has one walk on both sides."""
    pieces = set(pieces)
    while True:
        around = defaultdict(list)
        for p, q in pieces:
            around[p].append(q)
            around[q].append(p)
        turn = {}
        for p, ends in around.items():
            ends.sort(key=lambda q: math.atan2(q[1] - p[1], q[0] - p[0]))
            for i, q in enumerate(ends):
                turn[q, p] = (p, ends[i - 1])
        walk_of, walks = {}, []
        for start in turn:
            if start not in walk_of:
                walk, edge = [], start
                while edge not in walk_of:
                    walk_of[edge] = len(walks)
                    walk.append(edge[0])
                    edge = turn[edge]
                walks.append(walk)
        both = {(p, q) for p, q in pieces if walk_of[p, q] == walk_of[q, p]}
        if not both:
            return walks
        pieces -= both


def area_of(ring):
    x, y = ring[0]
    moved = [(a - x, b - y) for a, b in ring]
    return sum(a[0] * b[1] - b[0] * a[1] for a, b in zip(moved, [*moved[1:], moved[0]])) / 2


def turned(ring):
    at = ring.index(min(ring))
    return tuple(ring[at:] + ring[:at])


def faces_of(pieces):
    rings = rings_of(pieces)
    return sorted(turned(r) for r in rings if area_of(r) > 0)


def found_rings(frame):
    shells, holes = [], Counter()
    for row in frame.collect():
        rings = [turned([(p["x"], p["y"]) for p in ring][:-1]) for ring in row["geometry"][0]]
        shells.append(rings[0])
        holes[rings[0]] += len(rings) - 1
    return sorted(shells), holes


@pytest.mark.parametrize("n, extent, length, rows", [(160, 0.4, 0.05, None), (100, 0.02, 0.006, 40), (60, 0.15, 0.15, 7)])
def test_faces_of_random_drawings(spark, monkeypatch, n, extent, length, rows):
    if rows:  # small chunks, so that stretches of rings meet inside a tile too
        monkeypatch.setattr(lw.in_chunks, "__defaults__", (rows,))
    lines = spark.createDataFrame([(line,) for line in drawing(n, n, extent, length)], LINE).repartition(5)
    pieces = [((r.x0, r.y0), (r.x1, r.y1)) for r in pz.split_segments(pz.line_segments(lines)).collect()]
    assert len(pieces) == len(set(pieces)) and all(p < q for p, q in pieces)
    shells, holes = found_rings(pz.polygonize(lines))
    assert shells == faces_of(pieces)
    assert sum(holes.values()) > 0 or n < 100


def test_pieces_of_upright_lines_stay_in_order(spark):
    """Crossing points of a slanted line are rounded beside the upright line; they still cut it from end to end."""
    rng = random.Random(5)
    x = -0.0046936035156250056
    lines = [[(x, 0.0), (x, 0.01)]]
    lines += [[(x - rng.random() * 0.01, 0.002 + rng.random() * 0.006), (x + rng.random() * 0.01, 0.002 + rng.random() * 0.006)] for _ in range(40)]
    got = pz.split_segments(pz.line_segments(spark.createDataFrame([(line,) for line in lines], LINE))).collect()
    upright = [r for r in got if abs(r.x0 - x) < 1e-12 and abs(r.x1 - x) < 1e-12]
    assert len(upright) == 41
    assert sum(abs(r.y1 - r.y0) for r in upright) == pytest.approx(0.01, abs=1e-12)


def test_overlapping_lines_over_many_tiles_make_each_piece_once(spark):
    ends = [(-0.1, 0.4), (0.1, 0.2), (0.1, 0.15), (0.1, 0.11), (0.15, 0.5)]
    lines = [([(a, y), (b, y)],) for a, b in ends for y in (-0.05, 1 / 32)] + [([(a, b), (b, a)],) for a, b in ends[:2]]
    got = pz.split_segments(pz.line_segments(spark.createDataFrame(lines, LINE))).collect()
    level = [(r.x0, r.x1) for r in sorted(got) if r.y0 == r.y1 == -0.05]
    places = sorted({x for r in got if r.y0 == r.y1 == -0.05 for x in (r.x0, r.x1)})
    assert level == list(zip(places, places[1:])) and {-0.1, 0.1, 0.11, 0.15, 0.2, 0.4, 0.5} <= set(places)
    assert len({(r.x0, r.y0, r.x1, r.y1) for r in got}) == len(got)


@pytest.mark.parametrize("job", ["faces", "union"])
def test_rings_inside_a_tile_take_no_rounds(spark, job):
    """A ring of 3,000 edges is traced where it lies: hardly more jobs than a triangle takes."""
    def jobs(points):
        ring = [(0.01 + 0.005 * math.cos(t), 0.01 + 0.005 * math.sin(t)) for t in (2 * math.pi * i / points for i in range(points))]
        ring.append(ring[0])
        lines = spark.createDataFrame([(ring,)], LINE)
        spark.sparkContext.setJobGroup(f"{job} of {points}", "")
        try:
            found = pz.polygonize(lines) if job == "faces" else union_areas(lines.select(F.array(F.array("geometry")).alias("geometry")))
            rows = found.select(F.size(F.col("geometry")[0][0]).alias("n")).collect()
        finally:
            spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
        assert [r.n for r in rows] == [points + 1]
        return len(spark.sparkContext.statusTracker().getJobIdsForGroup(f"{job} of {points}"))

    assert jobs(3000) <= jobs(3) + 8  # a round takes two or more


def test_only_segments_over_tile_borders_move_again():
    """Of a lattice of squares only the sides that come near two tiles are left open, and no piece is lost or doubled."""
    tile, size = 32 / 1024, 1 / 1024
    sides = [(x, y, x + dx, y + dy) for i in range(60) for j in range(3) for x, y in [(i * size + size / 4, j * size + size / 4)]
             for dx, dy in ((size / 2, 0.0), (0.0, size / 2))]
    sides.append((0.0002, 0.0004, 0.05, 0.0004))  # a long one over the border, across the upright sides
    rows = [(col, s) for s in sides for col in range(math.floor(s[0] / tile), math.floor(s[2] / tile) + 1)]
    rows.sort()
    table = pa.table({"tile": [t for t, _ in rows], **{c: [s[i] for _, s in rows] for i, c in enumerate(pz.SEGMENT)}})
    made = pa.Table.from_batches(lw.cut_tiles(1 / 1024, 0.0, False)(iter(table.to_batches()))).to_pylist()
    still_open = [r for r in made if r["open"]]
    assert {tuple(r[c] for c in pz.SEGMENT) for r in still_open} == {sides[-1]} and len(still_open) == 2
    closed = [tuple(r[c] for c in pz.SEGMENT) for r in made if not r["open"]]
    crossed = sum(s[0] == s[2] and s[1] < 0.0004 < s[3] and s[0] < 0.05 for s in sides)
    assert len(closed) == len(set(closed)) == len(sides) - 1 + crossed


def test_chunks_hold_whole_groups():
    key = np.repeat(np.arange(50), np.arange(50) % 7 + 1)
    table = pa.table({"tile": key, "v": np.arange(len(key))})
    seen = []

    def work(columns):
        seen.append(columns["tile"])
        yield pa.RecordBatch.from_arrays([pa.array(columns["v"])], names=["v"])

    out = list(lw.in_chunks("tile", work, 10)(iter(table.to_batches(max_chunksize=4))))
    assert np.concatenate([b.column(0).to_numpy() for b in out]).tolist() == list(range(len(key)))
    assert len(seen) > 5 and all(a[-1] != b[0] for a, b in zip(seen, seen[1:]))


def test_union_of_slanted_areas_over_many_tiles(spark):
    """The covered area against the covered lengths of many level lines."""
    rng = random.Random(3)
    outlines = []
    for i in range(120):
        x, y, s = rng.random() * 0.3, rng.random() * 0.3, 0.01 + rng.random() * 0.05
        if i % 2:
            ring = [(x, y), (x + s, y), (x + s, y + s), (x, y + s), (x, y)]
        else:
            ring = [(x, y), (x + s, y + s / 3), (x + s / 4, y + s), (x, y)]
        outlines.append(ring)
    frame = spark.createDataFrame([([[ring]],) for ring in outlines], f"geometry {g.GEOMETRY}").repartition(4)
    got = sum(r.a for r in union_areas(frame).select(g.area(F.col("geometry")).alias("a")).collect())
    rows, step = 0.0, 1e-4
    for i in range(3700):
        y, spans = (i + 0.5) * step, []
        for ring in outlines:
            at = sorted(a[0] + (b[0] - a[0]) * (y - a[1]) / (b[1] - a[1]) for a, b in zip(ring, ring[1:]) if (a[1] > y) != (b[1] > y))
            spans += zip(at[::2], at[1::2])
        end = -1.0
        for a, b in sorted(spans):
            rows += max(0.0, b - max(a, end)) * step
            end = max(end, b)
    assert got == pytest.approx(rows, rel=2e-4)
