"""Tiles made on request against the tile store."""

import re

import pytest
from pyspark.sql import functions as F

from plotgrid.operators import dataset as ds
from plotgrid.operators import tiling
from plotgrid.plans import fixtures as fx
from plotgrid.sources import layout

RELEASE = "2026-04-02.0"
TRONDHEIM = (63.27, 10.10, 63.52, 10.73)


@pytest.fixture(scope="module")
def release(spark, tmp_path_factory):
    root = str(tmp_path_factory.mktemp("release"))
    layout.write_buildings(ds.with_partition_key(fx.shapes(spark, "/root/testdata/sf0.001")), root, RELEASE, "small")
    return layout.scan_buildings(spark, root, RELEASE, "small")


def rows(long):
    return sorted((r.z, r.x, r.y, r.feature_id, str(r.geometry)) for r in long.collect())


@pytest.fixture(scope="module")
def store(spark, release):
    return rows(tiling.tile_geometries(layout.decoded(release), [7, 11, 14], "k"))


def test_same_features_as_the_store(spark, release, store):
    wanted = sorted({r[:3] for r in store})[::3] + [(11, 5, 5), (14, 9000, 4000)]
    requests = spark.createDataFrame(wanted * 2, "z int, x int, y int")
    got = rows(tiling.requested_geometries(requests, release, "k"))
    assert got and got == [r for r in store if r[:3] in set(wanted)]
    for most in (1, 3):
        assert rows(tiling.requested_geometries(requests, release, "k", most)) == got
    tiles = tiling.tiles_on_request(requests, release, "k", chunk_features=3).collect()
    assert sum(t.n for t in tiles) == len(got) and max(len(t.features) for t in tiles) < 20
    answered = tiling.tile_lookup(requests, tiling.tiles_on_request(requests, release, "k")).collect()
    assert len(answered) == len(wanted) * 2 and sum(r.n or 0 for r in answered) == 2 * len(got)
    assert [r.n for r in answered if (r.z, r.x, r.y) == (11, 5, 5)] == [None, None]


def test_requests_off_the_map_or_none(spark, release):
    off = [(3, 8, 0), (3, -1, 2), (23, 1, 1), (None, 1, 1), (3, None, 1)]
    for wanted in (off, []):
        requests = spark.createDataFrame(wanted, "z int, x int, y int")
        assert tiling.request_boxes(requests) == ([], [])
        assert tiling.requested_geometries(requests, release, "k").count() == 0


def test_boxes_cover_all_requests(spark):
    near = [(13, 4300 + i, 2200 + j) for i in range(9) for j in range(9)]
    requests = spark.createDataFrame(near + [(15, 100, 100), (2, 3, 3)], "z int, x int, y int")
    for most in (1, 4, 16, 100):
        zooms, boxes = tiling.request_boxes(requests, most)
        assert zooms == [2, 13, 15] and 1 <= len(boxes) <= most
        b = requests.select(tiling.tl.tile_bounds(F.col("z"), F.col("x"), F.col("y")).alias("b")).select("b.*").collect()
        assert all(any(x0 <= r.xmin and y0 <= r.ymin and x1 >= r.xmax and y1 >= r.ymax for x0, y0, x1, y1 in boxes) for r in b)
    # far requests do not share a box
    _, boxes = tiling.request_boxes(requests.filter("z > 2"), 4)
    assert len(boxes) > 1 and max((x1 - x0) * (y1 - y0) for x0, y0, x1, y1 in boxes) < 1000


def test_the_boxes_reach_the_scan(spark, release):
    requests = tiling.candidate_tiles(spark, TRONDHEIM, 13)
    made = tiling.requested_geometries(requests, release, "k", most_boxes=1)
    spark.conf.set("spark.sql.maxMetadataStringLength", "10000")
    plan = made._jdf.queryExecution().executedPlan().toString()
    spark.conf.unset("spark.sql.maxMetadataStringLength")
    scan = next(line for line in plan.split("\n") if "FileScan parquet" in line and "geometry" in line)
    pushed = re.search(r"PushedFilters: \[(.*)", scan).group(1)
    assert "LessThanOrEqual(bbox.xmin" in pushed and "GreaterThanOrEqual(bbox.xmax" in pushed
    # buildings are neither shuffled nor written: the only exchanges are those of the request list
    assert "geometry" not in " ".join(line for line in plan.split("\n") if "Exchange" in line and "Broadcast" not in line)
    assert plan.count("FileScan parquet") == 1
