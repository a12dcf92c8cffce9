"""Thinning by density and the choice of a zoom, against plain steps."""

import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from plotgrid.functions import geometry as g
from plotgrid.operators import thinning


def squares(spark, rows):
    """(z, x, y, feature_id, geometry) of squares of side 2 around (px, py)."""
    df = spark.createDataFrame(rows, "z int, x int, y int, feature_id bigint, px int, py int")
    return df.select("z", "x", "y", "feature_id", g.rectangle(F.col("px") - 1.0, F.col("py") - 1.0, F.col("px") + 1.0, F.col("py") + 1.0).alias("geometry"))


def place_of(x, y, bits):
    key = 0
    for level in reversed(range(bits)):
        s = 1 << level
        right, up = int(x & s > 0), int(y & s > 0)
        key += s * s * (3 * right ^ up)
        if not up:
            if right:
                x, y = s - 1 - (x & s - 1), s - 1 - (y & s - 1)
            x, y = y, x
    return key


def plain(rows, limit):
    """Kept (tile, feature, gap), and the dropped features of each tile."""
    tiles = defaultdict(list)
    for z, x, y, feature, px, py in rows:
        tiles[z, x, y].append((place_of(px + 256, py + 256, 16), feature))
    kept, dropped = [], {}
    for tile, found in tiles.items():
        found.sort()
        gaps = [(None if not i else place - found[i - 1][0], f) for i, (place, f) in enumerate(found)]
        least = 0
        if len(found) > limit:
            values = sorted({gap for gap, _ in gaps if gap is not None}) + [1 << 60]
            least = next(v for v in values if 1 + sum(gap is not None and gap >= v for gap, _ in gaps) <= limit)
        mine = [(tile, f, gap) for gap, f in gaps if gap is None or gap >= least]
        kept += mine
        dropped[tile] = len(found) - len(mine)
    return sorted(kept, key=str), dropped


@pytest.mark.parametrize("limit", [1, 2, 7, 40, 1000])
def test_against_plain_steps(spark, limit):
    rng = random.Random(limit)
    rows = []
    for t in range(8):
        for i in range(rng.choice([1, 5, 60, 200])):
            spot = (rng.randrange(-255, 4351), rng.randrange(-255, 4351)) if rng.random() < 0.4 else (2000 + rng.randrange(9), 900 + rng.randrange(9))
            rows.append((5, t, 1, 1000 * t + i, *spot))
    got = thinning.drop_densest(squares(spark, rows), limit).collect()
    kept, dropped = plain(rows, limit)
    assert sorted((((r.z, r.x, r.y), r.feature_id, r.gap) for r in got), key=str) == kept
    assert all(r.dropped == dropped[r.z, r.x, r.y] for r in got)


def test_dense_places_go_first(spark):
    far = [(3, 1, 1, i, 500 * i, 500 * i) for i in range(8)]
    crowd = [(3, 1, 1, 100 + i, 3000 + i % 10, 700 + i // 10) for i in range(90)]
    kept = {r.feature_id for r in thinning.drop_densest(squares(spark, far + crowd), 12).collect()}
    assert set(range(8)) <= kept and len(kept) <= 12


def test_one_spot_keeps_its_first_feature(spark):
    rows = [(3, 1, 1, i, 50, 50) for i in range(300)]
    got = thinning.drop_densest(squares(spark, rows), 10).collect()
    assert [(r.feature_id, r.gap, r.dropped) for r in got] == [(0, None, 299)]
    with pytest.raises(ValueError):
        thinning.drop_densest(squares(spark, rows), 0)


def test_odd_features(spark):
    rows = [(3, 1, 1, None, 50, 50), (3, 1, 1, None, 50, 50), (3, 1, 1, 7, 90, 90)]
    assert thinning.drop_densest(squares(spark, rows), 5).count() == 3
    assert thinning.drop_densest(squares(spark, rows).limit(0), 5).count() == 0


def lattice(spark, zoom, n):
    """Boxes in the middle of every second tile of a zoom."""
    df = spark.range(n * n).select(F.col("id"), (F.col("id") % n * 2).alias("i"), (F.floor(F.col("id") / n) * 2).alias("j"))
    b = thinning.tl.tile_bounds(F.lit(zoom), F.col("i") + (1 << zoom - 1), F.col("j") + (1 << zoom - 1))
    return df.select("id", b.alias("bbox"))


@pytest.mark.parametrize("zoom", [10, 12])
def test_zoom_of_a_lattice(spark, zoom):
    row = thinning.choose_zoom(lattice(spark, zoom, 16), "id", parted_units=6.0).first()
    assert row.neighbours == 255 and abs(row.distance * 2**zoom - 2) < 0.01
    # two tiles of this zoom lie between neighbours, eight units of the map ten zooms above
    assert row.zoom == zoom - 10


def test_zoom_without_two_spots(spark):
    one = lattice(spark, 9, 16).filter("id = 0")
    for df in (one, one.union(one), one.limit(0), one.union(spark.sql("SELECT 5L AS id, NULL AS bbox"))):
        row = thinning.choose_zoom(df, "id").first()
        assert (row.neighbours, row.distance, row.zoom) == (0, None, None)


def test_copies_of_one_spot_do_not_count(spark):
    many = lattice(spark, 9, 16)
    row = thinning.choose_zoom(many.union(many).union(many), "id").first()
    assert row.neighbours == 255


def test_gaps_shuffle_no_shapes(spark):
    rows = [(5, 1, 1, i, 37 * i % 4000, 91 * i % 4000) for i in range(300)]
    written = []
    keep = thinning.cut_lineage

    def watched(df, name):
        written.append((name, df._jdf.queryExecution().optimizedPlan().toString(), df.columns))
        return keep(df, name)

    thinning.cut_lineage = watched
    try:
        got = thinning.drop_densest(squares(spark, rows), 20)
    finally:
        thinning.cut_lineage = keep
    assert got.columns == ["z", "x", "y", "feature_id", "geometry", "place", "gap", "dropped"]
    assert [name for name, _, _ in written] == ["places", "gaps"]
    assert "geometry" not in written[1][2] and "Aggregate" not in written[0][1] and "max_by" not in written[1][1]
    # a row that stays has its own shape
    for r in got.collect():
        px, py = 37 * r.feature_id % 4000, 91 * r.feature_id % 4000
        assert tuple(r.geometry[0][0][0]) == (px - 1.0, py - 1.0)


def test_copies_of_a_row_stay_single(spark):
    rows = [(5, 1, 1, 70, 100, 100)] * 3 + [(5, 1, 1, i, 1000 + 300 * i, 900) for i in range(8)]
    got = thinning.drop_densest(squares(spark, rows), 40).collect()
    assert len(got) == 11 and sorted(r.feature_id for r in got).count(70) == 3
    assert sorted(r.gap for r in got if r.feature_id == 70 and r.gap is not None)[:2] == [0, 0]
