"""Point lookups over every key, against plain comparisons of all pairs."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from plotgrid.functions import geometry as g
from plotgrid.operators import points as pt
from plotgrid.plans import fixtures as fx
from plotgrid.plans.catalog import QUERIES


@pytest.fixture(scope="module")
def rect(spark, sf_dir):
    rows = fx.rectangles(spark, sf_dir).select("k", "minx", "miny", "w", "h").orderBy("k").collect()
    return np.array([r.k for r in rows]), np.array([tuple(r)[1:] for r in rows])


def inside(points, boxes):
    """Matrix: point i lies strictly inside box j."""
    x, y = points[:, :1], points[:, 1:]
    return (x > boxes[:, 0]) & (x < boxes[:, 0] + boxes[:, 2]) & (y > boxes[:, 1]) & (y < boxes[:, 1] + boxes[:, 3])


def test_every_key_is_looked_up(spark, sf_dir, rect):
    k, b = rect
    center, corner = b[:, :2] + b[:, 2:] / 2, b[:, :2]
    points = np.where((k % 3 == 0)[:, None], center, np.where((k % 3 == 1)[:, None], corner, corner + [5.0, 0.0]))
    hit = inside(points, b)
    got = {r.point_id: r.n_buildings for r in QUERIES["j3_point_in_polygon_counts"](spark, sf_dir).collect()}
    assert got == dict(zip(k.tolist(), hit.sum(axis=1).tolist()))
    found = [r.k for r in QUERIES["j6_polygons_with_points"](spark, sf_dir).collect()]
    assert sorted(found) == k[hit.any(axis=0)].tolist()
    shaped = QUERIES["j3_point_in_shapes"](spark, sf_dir)
    assert sorted(r.point_id for r in shaped.select("point_id").collect()) == k.tolist()


def test_every_center_finds_its_pairs(spark, sf_dir, rect):
    k, b = rect
    at, of = np.nonzero(inside(b[:, :2] + b[:, 2:] / 2, b))
    got = [tuple(r) for r in QUERIES["j6_pairs_with_points"](spark, sf_dir).collect()]
    assert sorted(got) == sorted(zip(k[of].tolist(), k[at].tolist()))
    assert {p for _, p in got} == set(k.tolist())


def test_points_move_only_on_levels_that_occur(spark, monkeypatch):
    small = [(float(i) / 64, 60.0, float(i) / 64 + 1e-4, 60.0001) for i in range(40)]
    boxes = [*small, (0.0, 59.0, 2.0, 61.0)]
    frame = spark.createDataFrame(boxes, "x double, y double, u double, v double").select(
        g.rectangle(F.col("x"), F.col("y"), F.col("u"), F.col("v")).alias("geometry")
    ).withColumn("bbox", g.bounds(F.col("geometry")))
    spots = [((x + u) / 2, (y + v) / 2) for x, y, u, v in boxes] + [(5.0, 5.0)]
    points = spark.createDataFrame(spots, "lon double, lat double")
    assert pt.occurring_levels(frame).count() == 2
    assert pt.occurring_levels(frame.filter("false")).count() == 0
    want = {p: int(n) for p, n in zip(spots, inside(np.array(spots), np.array([(x, y, u - x, v - y) for x, y, u, v in boxes])).sum(axis=1))}
    for rows in (pt.POINT_ROWS, 0):
        monkeypatch.setattr(pt, "POINT_ROWS", rows)
        assert {(r.lon, r.lat): r.n_buildings for r in pt.point_in_polygon_counts(points, frame).collect()} == want
        assert pt.containing_polygons(frame, points).count() == len(boxes)
    empty = pt.point_in_polygon_counts(points, frame.filter("false"))
    assert {r.n_buildings for r in empty.collect()} == {0}
