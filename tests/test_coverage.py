import random

from checker import compare
from pyspark.sql import functions as F

from plotgrid.functions import geometry as g
from plotgrid.operators.coverage import union_areas
from plotgrid.plans.catalog import CHECKS, QUERIES

UNIT = 1 / 4096


def rows_of(spark, boxes):
    """Areas of boxes (x0, y0, x1, y1) in units."""
    flat = spark.createDataFrame([tuple(float(v * UNIT) for v in b) for b in boxes], "a double, b double, c double, d double")
    return flat.select(g.rectangle(*[F.col(c) for c in "abcd"]).alias("geometry"))


def parts_by_flood(boxes, size):
    """(cells, holes) of every part of the union, by flooding a raster; corners do not connect covered cells but do connect holes."""
    full = {(x, y) for a, b, c, d in boxes for x in range(a, c) for y in range(b, d)}
    sides = [(1, 0), (-1, 0), (0, 1), (0, -1)]

    def flood(cells, steps):
        left, groups = set(cells), []
        while left:
            todo, group = [left.pop()], set()
            while todo:
                x, y = todo.pop()
                group.add((x, y))
                for dx, dy in steps:
                    if (x + dx, y + dy) in left:
                        left.remove((x + dx, y + dy))
                        todo.append((x + dx, y + dy))
            groups.append(group)
        return groups

    around = [(x, y) for x in range(-1, size + 1) for y in range(-1, size + 1)]
    corners = [*sides, (1, 1), (1, -1), (-1, 1), (-1, -1)]
    out = []
    for part in flood(full, sides):
        holes = sum((-1, -1) not in group for group in flood([c for c in around if c not in part], corners))
        out.append((len(part), holes))
    return sorted(out)


def summary(frame):
    picked = frame.select(g.area(F.col("geometry")).alias("area"), F.size(F.col("geometry")[0]).alias("rings"))
    return sorted((round(r.area / UNIT**2), r.rings - 1) for r in picked.collect())


def test_query_matches_sql(spark, duck, sf_dir):
    assert compare(QUERIES["a11_union_areas"](spark, sf_dir), duck, CHECKS["a11_union_areas"]) is None


def test_random_boxes_against_a_raster(spark):
    rng = random.Random(9)
    for n in (12, 40):
        boxes = []
        for _ in range(n):
            x, y = rng.randrange(0, 20), rng.randrange(0, 20)
            boxes.append((x, y, x + rng.randint(1, 6), y + rng.randint(1, 6)))
        boxes += boxes[:3]
        assert summary(union_areas(rows_of(spark, boxes))) == parts_by_flood(boxes, 27)


def test_slanted_areas_and_odd_rows(spark):
    def ring(*points):
        return [[[{"x": x * UNIT, "y": y * UNIT} for x, y in points]]]

    shapes = [
        (ring((0, 0), (4, 0), (4, 4), (0, 4), (0, 0)),), (ring((2, 1), (6, 3), (2, 5), (2, 1)),),  # a corner over an edge
        (ring((0, 0), (0, 4), (4, 4), (4, 0), (0, 0)),),  # the first one the other way round
        (ring((10, 10), (12, 10), (11, 10), (10, 10)),), (None,), ([],),
    ]
    # a frame given as one area with a hole, and a box inside its hole
    outer, inner = [(20, 0), (28, 0), (28, 8), (20, 8), (20, 0)], [(22, 2), (26, 2), (26, 6), (22, 6), (22, 2)]
    shapes.append(([[[{"x": x * UNIT, "y": y * UNIT} for x, y in r] for r in (outer, inner)]],))
    shapes.append((ring((23, 3), (24, 3), (24, 4), (23, 4), (23, 3)),))
    frame = spark.createDataFrame(shapes, f"geometry {g.GEOMETRY}")
    # the triangle has area 8; above the square lies 0.5 * 2 * 1, right of it 0.5 * 2 * 2, of which 4 <= x keeps 2 and y > 4 one half
    got = union_areas(frame).select(g.area(F.col("geometry")).alias("a"), F.size(F.col("geometry")[0]).alias("n")).collect()
    found = sorted((round(r.a / UNIT**2, 6), r.n) for r in got)
    # 8 less the part of x in 2..4 and y in 1..4: the triangle there spans y from 1 + (x - 2) / 2 to 5 - (x - 2) / 2
    above = 1.0  # y over 4 for x in 2..4: (5 - t / 2 - 4) for t in 0..2
    right = 2.0  # x over 4: half of width 2 and height 2
    assert found == [(1.0, 1), (16 + above + right, 1), (48.0, 2)]
    assert union_areas(frame.filter("false")).count() == 0
