"""Operators against brute force, and the semantic corner cases, on small frames."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from plotgrid.functions import geometry as g
from plotgrid.functions import kernels
from plotgrid.functions import tiles as tl
from plotgrid.functions import wkb
from plotgrid.functions.geohash import geohash
from plotgrid.functions.hashing import uniform
from plotgrid.operators import aggregates as agg
from plotgrid.operators import conflation as cf
from plotgrid.operators import dataset as ds
from plotgrid.operators import filters as f
from plotgrid.operators import points as pt
from plotgrid.operators import polygonize as pz
from plotgrid.operators import ranking, samples, tiling
from plotgrid.operators import zones as zn
from plotgrid.plans import fixtures as fx
from plotgrid.sources import layout


def frame(spark, rows, extra="external_id string"):
    """Rows of (id, parts) with parts a list of lists of rings."""
    data = [(i, [[[(float(x), float(y)) for x, y in r] for r in part] for part in parts]) for i, parts in rows]
    return spark.createDataFrame(data, f"{extra}, geometry {g.GEOMETRY}").withColumn("bbox", g.bounds(F.col("geometry")))


def closed(points):
    return [*points, points[0]]


def rect(x0, y0, x1, y1):
    return [[closed([(x0, y0), (x1, y0), (x1, y1), (x0, y1)])]]


def blob(rng, x, y, size, n):
    return [[closed([
        (x + size * rng.uniform(0.3, 1) * math.cos(2 * math.pi * i / n), y + size * rng.uniform(0.3, 1) * math.sin(2 * math.pi * i / n))
        for i in range(n)
    ])]]


def kernel_shape(parts):
    return kernels.Shapes(wkb.from_lists([[[np.array(r, float) for r in part] for part in parts]]))


@pytest.mark.parametrize("seed, cell, crowded", [(1, 1 / 64, 128), (2, 1 / 4, 2), (3, 1.0, 0)])
def test_zone_join_equals_brute_force(spark, monkeypatch, seed, cell, crowded):
    """Also with the finer level for windows of many edges, down to every border window."""
    monkeypatch.setattr(zn, "CROWDED_EDGES", crowded)
    rng = random.Random(seed)
    zones = [(f"z{i}", blob(rng, rng.uniform(0, 4), rng.uniform(0, 4), rng.uniform(0.1, 2), rng.randint(3, 24))) for i in range(8)]
    zones.append(("holed", [[closed([(0, 0), (4, 0), (4, 4), (0, 4)]), closed([(1, 1), (1, 3), (3, 3), (3, 1)])]]))
    zones.append(("islands", rect(0.5, 0.5, 0.6, 0.6) + rect(3.5, 3.5, 3.6, 3.6)))
    zones.append(("dot", rect(2.0, 2.0, 2.001, 2.001)))
    rows = [(f"b{i}", blob(rng, rng.uniform(-0.5, 4.5), rng.uniform(-0.5, 4.5), 10 ** rng.uniform(-3, 0.6), rng.randint(3, 8))) for i in range(120)]
    rows += [("grid", rect(1, 1, 1.25, 1.25)), ("all", rect(-9, -9, 9, 9)), ("line", rect(4, 0, 5, 1))]
    expected = {
        (b, z) for b, bs in rows for z, zs in zones
        if kernels.intersects(kernel_shape(bs), kernel_shape(zs))[0]
    }
    pairs = zn.zone_pairs(frame(spark, rows), frame(spark, zones, "region string"), cell=cell, keep=["external_id"])
    got = [tuple(r) for r in pairs.collect()]
    assert len(got) == len(set(got))
    assert set(got) == expected


def test_zone_join_without_broadcast(spark, sf_dir, monkeypatch):
    wide = zn.spatial_join_counts(fx.buildings(spark, sf_dir), fx.zones(spark)).collect()
    monkeypatch.setattr(zn, "broadcast_if_small", lambda df, **_: df.hint("merge"))  # the large-lookup path
    monkeypatch.setattr(zn, "CROWDED_EDGES", 1)
    assert zn.spatial_join_counts(fx.buildings(spark, sf_dir), fx.zones(spark)).collect() == wide


def test_zone_join_with_many_windows(spark, sf_dir, monkeypatch):
    b, zones = fx.buildings(spark, sf_dir), fx.zones(spark)
    want = sorted(map(tuple, zn.zone_pairs(b, zones, keep=["k"]).collect()))
    monkeypatch.setattr(zn, "broadcast_if_small", lambda df, **_: df)
    lookup = zn.zone_lookup(zones)
    assert lookup.slim is not None
    assert sorted(map(tuple, zn.zone_pairs(b, zones, keep=["k"], lookup=lookup).collect())) == want
    monkeypatch.setattr(zn, "SLIM_WINDOWS", 1)
    assert zn.zone_lookup(zones).slim is None


def test_inner_windows_of_a_large_zone_need_no_shuffle(spark, sf_dir, tmp_path):
    zones = spark.range(1).select(F.lit("01").alias("region"), g.rectangle(10.0, 59.0, 20.0, 68.0).alias("geometry"))
    lookup = zn.zone_lookup(zones, cell=1 / 64)
    assert lookup.windows.count() >= 300_000 and lookup.slim is not None
    fx.buildings(spark, sf_dir).write.parquet(str(tmp_path / "b"))
    b = spark.read.parquet(str(tmp_path / "b"))
    pairs = zn.zone_pairs(b, zones, keep=["k"], lookup=lookup)
    plan = pairs._jdf.queryExecution().sparkPlan().toString()
    inner = plan.split("Union")[1].split("SortMergeJoin")[0]
    assert "BroadcastHashJoin" in inner and "Exchange hashpartitioning" not in inner
    assert pairs.count() == b.filter("bbox.xmax >= 10 AND bbox.xmin <= 20 AND bbox.ymax >= 59 AND bbox.ymin <= 68").count()


def test_zone_cell_must_be_a_power_of_two(spark, sf_dir):
    with pytest.raises(ValueError):
        zn.zone_lookup(fx.zones(spark), cell=0.01)


def test_zones_without_buildings_are_absent_and_borders_count_twice(spark):
    zones = frame(spark, [("a", rect(0, 0, 1, 1)), ("b", rect(1, 0, 2, 1)), ("c", rect(8, 8, 9, 9))], "region string")
    b = frame(spark, [("x", rect(0.9, 0.2, 1.1, 0.3)), ("y", rect(1.0, 0.5, 1.2, 0.6)), ("z", rect(0.1, 0.1, 0.2, 0.2))])
    got = {r["region"]: r["building_count"] for r in zn.spatial_join_counts(b, zones).collect()}
    assert got == {"a": 3, "b": 2}


def test_point_lookup_equals_brute_force_on_both_paths(spark, monkeypatch):
    rng = random.Random(5)
    rows = [(f"b{i}", blob(rng, rng.uniform(0, 1), rng.uniform(0, 1), 10 ** rng.uniform(-4, -0.5), rng.randint(3, 9))) for i in range(80)]
    rows += [("copy", rows[0][1])] * 40
    points = [(i, rng.uniform(0, 1), rng.uniform(0, 1)) for i in range(60)]
    points += [(100 + i, rows[0][1][0][0][0][0], rows[0][1][0][0][0][1]) for i in range(5)]  # a vertex, many times
    expected = {}
    for i, x, y in points:
        expected[i] = sum(
            bool(kernels.locate(np.array([x]), np.array([y]), np.array([0]), kernel_shape(s))[0][0]) for _, s in rows
        )
    b, p = frame(spark, rows), spark.createDataFrame(points, "point_id int, lon double, lat double")
    small = {r["point_id"]: r["n_buildings"] for r in pt.point_in_polygon_counts(p, b).collect()}
    monkeypatch.setattr(pt, "POINT_ROWS", 0)
    large = {r["point_id"]: r["n_buildings"] for r in pt.point_in_polygon_counts(p, b).collect()}
    assert small == large == expected


def test_polygons_with_points_lists_each_once(spark):
    polygons = frame(spark, [("a", rect(0, 0, 1, 1)), ("a", rect(0, 0, 1, 1)), ("b", rect(5, 5, 6, 6))])
    points = spark.createDataFrame([(0.5, 0.5), (0.6, 0.6), (5.0, 5.5)], "lon double, lat double")
    assert [r["external_id"] for r in pt.containing_polygons(polygons, points).collect()] == ["a"]


def brute_relations(fkb, osm):
    """The relation rules by direct comparison of all pairs."""
    def cell(s):
        m = kernels.measures(kernel_shape(s))
        return math.floor(m["cx"][0] * 100), math.floor(m["cy"][0] * 100)

    best, matches = {}, []
    for fi, fs in fkb:
        for oi, os_ in osm:
            a, b = kernel_shape(fs), kernel_shape(os_)
            if cell(fs) == cell(os_) and kernels.intersects(a, b)[0]:
                common = kernels.overlap_area(a, b)[0]
                union = kernels.measures(a)["area"][0] + kernels.measures(b)["area"][0] - common
                iou = common / union if union else None
                best.setdefault((fi, oi), []).append(iou)
                if iou is not None and iou > 0.70:
                    matches.append((fi, oi))
    flat = [pair for pair, values in best.items() if all(v is None for v in values)]
    alone_f = {fi for fi, _ in fkb} - set()
    seen_f, seen_o = {p[0] for p in best}, {p[1] for p in best}
    rows = [(fi, None) for fi in sorted(alone_f - seen_f)] + [(None, oi) for oi in sorted({o for o, _ in osm} - seen_o)]
    return rows + flat * 2 + matches


def conflation_rows():
    rng = random.Random(7)
    fkb, osm = [], []
    for i in range(60):
        x, y = rng.uniform(10, 10.03), rng.uniform(60, 60.03)
        w, h = rng.uniform(1e-4, 2e-3), rng.uniform(1e-4, 2e-3)
        fkb.append((f"f{i}", rect(x, y, x + w, y + h)))
        dx = rng.choice([0, 0, w / 10, w / 2, w, 5 * w])
        osm.append((f"o{i}", rect(x + dx, y, x + dx + w, y + h)))
    # Equal copies, a touching pair, large ones, and flat shapes without area.
    fkb += [(f"copy{i}", rect(10.011, 60.011, 10.012, 60.012)) for i in range(25)]
    osm += [(f"ocopy{i}", rect(10.011, 60.011, 10.012, 60.012)) for i in range(4)]
    fkb += [("touch", rect(10.0411, 60.0411, 10.0412, 60.0412)), ("big", rect(10.0501, 60.0501, 10.0599, 60.0599))]
    osm += [("otouch", rect(10.0412, 60.0411, 10.0413, 60.0412)), ("obig", rect(10.0502, 60.0501, 10.0599, 60.0599))]
    osm += [("insidebig", rect(10.0545, 60.0545, 10.0556, 60.0556))]
    fkb += [("flat", [[closed([(10.0711, 60.0711), (10.0715, 60.0711), (10.0713, 60.0711)])]])]
    osm += [("oflat", [[closed([(10.0711, 60.0711), (10.0715, 60.0711), (10.0713, 60.0711)])]])]
    return fkb, osm


def test_conflation_equals_brute_force(spark):
    fkb, osm = conflation_rows()
    expected = brute_relations(fkb, osm)
    c = cf.Conflation(frame(spark, fkb), frame(spark, osm))
    key = lambda r: (r[0] or "", r[1] or "")
    got = sorted([tuple(r) for r in c.relations().select("fkb_id", "osm_id").collect()], key=key)
    assert got == sorted(expected, key=key)
    assert ("flat", "oflat") in got and got.count(("flat", "oflat")) == 2

    kept = {(r["source"], r["external_id"]) for r in c.merged().collect()}
    in_relations = {("fkb", a) for a, _ in expected if a} | {("osm", b) for a, b in expected if a is None}
    assert kept == in_relations
    assert ("fkb", "touch") not in kept and ("osm", "otouch") not in kept and ("osm", "oflat") not in kept
    split = f.null_split(c.relations()).first()
    assert c.summary().first().asDict() == split.asDict()


def copies(spark, n, prefix, square):
    ids = spark.range(n).select(F.concat(F.lit(prefix), F.col("id").cast("string")).alias("external_id"))
    x0, y0, x1, y1 = square
    return ids.withColumns({"geometry": g.rectangle(x0, y0, x1, y1), "bbox": g.box(x0, y0, x1, y1)})


def test_many_equal_buildings_do_not_multiply(spark, monkeypatch):
    """Half of all rows are one building: its pairs (4 * 10^8) are counted, never listed."""
    n, square = 20_000, (10.011, 60.011, 10.012, 60.012)
    rest = [(f"r{i}", rect(10.1 + i / 50, 60.1, 10.1001 + i / 50, 60.1001)) for i in range(20)]
    fkb = copies(spark, n, "f", square).unionByName(frame(spark, rest))
    osm = copies(spark, n, "o", square).unionByName(frame(spark, rest))
    c = cf.Conflation(fkb, osm)
    assert c.shapes.count() == 21
    assert c.summary().first().asDict() == {"osm_only": 0, "fkb_only": 0, "overlapping": n * n + 20}
    assert c.merged().count() == n + 20

    monkeypatch.setattr(pt, "POINT_ROWS", 0)
    points = spark.range(n).select(F.col("id").alias("point_id"), F.lit(10.0115).alias("lon"), F.lit(60.0115).alias("lat"))
    counts = pt.point_in_polygon_counts(points, fkb.drop("external_id"))
    assert counts.groupBy("n_buildings").count().collect()[0].asDict() == {"n_buildings": n, "count": n}


def test_conflation_misses_across_cell_borders(spark):
    """Equal cells are the rule: a pair on both sides of a border is reported twice."""
    fkb = frame(spark, [("f", rect(10.0098, 60.001, 10.01005, 60.002))])
    osm = frame(spark, [("o", rect(10.00995, 60.001, 10.0102, 60.002))])
    got = {tuple(r) for r in cf.Conflation(fkb, osm).relations().select("fkb_id", "osm_id").collect()}
    assert got == {("f", None), (None, "o")}


def test_conflation_over_cell_borders(spark):
    fkb = frame(spark, [("f", rect(10.0098, 60.001, 10.01005, 60.002)), ("big", rect(10.02, 60.02, 10.08, 60.08)), ("far", rect(1, 1, 1.0001, 1.0001))])
    osm = frame(spark, [("o", rect(10.0098, 60.001, 10.0101, 60.002)), ("in", rect(10.07, 60.07, 10.0701, 60.0701)), ("huge", rect(10.021, 60.02, 10.081, 60.08))])
    c = cf.Conflation(fkb, osm, neighbors=True)
    assert sorted((r.fkb_id, r.osm_id) for r in c._with_ids(c.shapes).collect()) == [("big", "huge"), ("big", "in"), ("f", "o")]
    got = {tuple(r) for r in c.relations().select("fkb_id", "osm_id").collect()}
    assert got == {("f", "o"), ("big", "huge"), ("far", None)}
    assert {(r.source, r.external_id) for r in c.merged().collect()} == {("fkb", "f"), ("fkb", "big"), ("fkb", "far")}


@pytest.mark.parametrize("seed", [1, 2])
def test_neighbor_pairs_against_all_pairs(spark, seed):
    rng = random.Random(seed)

    def boxes(prefix):
        out = []
        for i in range(120):
            x, y, size = 10 + rng.random() / 10, 60 + rng.random() / 10, rng.choice([0.0004, 0.003, 0.02])
            out.append((f"{prefix}{i}", (x, y, x + size * rng.random(), y + size * rng.random())))
        return out

    f, o = boxes("f"), boxes("o")
    expected = sorted(
        (a, b) for a, p in f for b, q in o if p[0] <= q[2] and q[0] <= p[2] and p[1] <= q[3] and q[1] <= p[3]
    )
    c = cf.Conflation(frame(spark, [(n, rect(*b)) for n, b in f]), frame(spark, [(n, rect(*b)) for n, b in o]), neighbors=True)
    assert sorted((r.fkb_id, r.osm_id) for r in c._with_ids(c.shapes).collect()) == expected


def test_tables_by_cell_join_without_an_exchange(spark, sf_dir):
    names = ["cells_fkb", "cells_osm"]
    for name, df in zip(names, (fx.fkb(spark, sf_dir), fx.osm(spark, sf_dir))):
        assert layout.seed_by_cell(cf.with_cell(df).select("external_id", "geometry", "bbox", "grid_x", "grid_y"), name, 4)
        assert not layout.seed_by_cell(cf.with_cell(df).limit(0), name, 4)
    pairs = cf.table_pairs(*map(spark.table, names))
    plan = pairs._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Exchange" not in plan and "Bucketed: true" in plan
    c = cf.Conflation(fx.fkb(spark, sf_dir), fx.osm(spark, sf_dir))
    assert sorted(map(tuple, pairs.select("fkb_id", "osm_id").collect())) == sorted(map(tuple, c._with_ids(c.shapes).select("fkb_id", "osm_id").collect()))
    for name in names:
        spark.sql(f"DROP TABLE {name}")


def test_conflation_with_an_empty_source(spark):
    some, none = frame(spark, [("a", rect(0, 0, 1, 1))]), frame(spark, [("b", rect(0, 0, 1, 1))]).limit(0)
    assert [r["source"] for r in cf.Conflation(some, none).merged().collect()] == ["fkb"]
    assert [r["source"] for r in cf.Conflation(none, some).merged().collect()] == ["osm"]


def test_prepare_keeps_regions_apart(spark):
    """A building on a region border is conflated in each region on its own."""
    zones = frame(spark, [("01", rect(10, 60, 10.001, 61)), ("02", rect(10.001, 60, 11, 61))], "region string")
    fkb = frame(spark, [("f", rect(10.0009, 60.001, 10.0011, 60.002))])
    osm = frame(spark, [("o", rect(10.0009, 60.001, 10.0011, 60.002)), ("p", rect(10.5, 60.5, 10.51, 60.51))])
    got = sorted((r["region"], r["external_id"]) for r in ds.prepare_dataset(fkb, osm, zones).collect())
    assert got == [("01", "f"), ("02", "f"), ("02", "p")]


def test_frame_filter_counts_touching_and_uses_exact_shape(spark):
    ell = [[closed([(0, 0), (3, 0), (3, 1), (1, 1), (1, 3), (0, 3)])]]
    b = frame(spark, [("touch", rect(4, 0, 5, 1)), ("ell", ell), ("away", rect(9, 9, 10, 10))])
    names = lambda box: {r["external_id"] for r in f.bbox_intersects(b, box).collect()}
    assert names((2.0, 2.0, 4.0, 4.0)) == set()          # box overlap only
    assert names((2.0, 0.5, 4.0, 4.0)) == {"ell", "touch"}


def test_bbox_comparison_reaches_the_scan(spark, tmp_path):
    frame(spark, [("a", rect(0, 0, 1, 1))]).write.parquet(str(tmp_path / "b"))
    spark.conf.set("spark.sql.maxMetadataStringLength", 2000)
    plan = f.bbox_intersects(spark.read.parquet(str(tmp_path / "b")), f.OSLO)._jdf.queryExecution().toString()
    spark.conf.unset("spark.sql.maxMetadataStringLength")
    assert "LessThanOrEqual(bbox.xmin" in plan and "GreaterThanOrEqual(bbox.ymax" in plan


def test_area_is_measured_once_per_row(spark):
    plan = f.bbox_filter(frame(spark, [("a", rect(0, 0, 1, 1))]), f.OSLO)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("measured(") <= 2 and plan.count("ArrowEvalPython [measured(") == 1


def test_range_query_puts_missing_ids_last(spark):
    rows = frame(spark, [("b", rect(10, 63, 10.1, 63.1)), ("a", rect(10, 63, 10.1, 63.1)), ("c", rect(10, 63, 10.1, 63.1))])
    rows = rows.withColumn("building_id", F.when(F.col("external_id") == "c", 5).cast("int"))
    got = [r["external_id"] for r in agg.ordered_range_query(rows, f.TRONDELAG, 2).collect()]
    assert got == ["c", "a"]


def test_grid_keeps_double_cells_and_order(spark):
    got = agg.grid_aggregate(frame(spark, [("a", rect(-0.002, 1, -0.001, 1.001))] * 2 + [("b", rect(5, 5, 5.001, 5.001))]))
    assert dict(got.dtypes)["lat_cell"] == "double"
    assert [tuple(r) for r in got.collect()] == [(100.0, -1.0, 2), (500.0, 500.0, 1)]


def test_dropped_count_is_observed(spark):
    from pyspark.sql import Observation

    seen = Observation("validity")
    bow = [[closed([(0, 0), (1, 1), (1, 0), (0, 1)])]]
    kept = f.keep_valid(frame(spark, [("a", rect(0, 0, 1, 1)), ("b", bow)]), seen)
    assert kept.count() == 1 and seen.get["dropped"] == 1


def test_synthesis_is_repeatable_and_inside_bounds(spark, sf_dir):
    b = fx.buildings(spark, sf_dir).filter("k < 40").repartition(3)
    zones = fx.zones(spark)
    one = {r["partition_key"]: r["n"] for r in ds.synthesize(b, zones, "medium").groupBy("partition_key").agg(F.count("*").alias("n")).collect()}
    two = {r["partition_key"]: r["n"] for r in ds.synthesize(b.repartition(5), zones, "medium").groupBy("partition_key").agg(F.count("*").alias("n")).collect()}
    assert one == two
    clones = ds.synthesize(b, zones, "medium").filter("external_id IS NULL")
    assert clones.count() == 40 * 7
    areas = clones.select(F.round(g.area(F.col("geometry")) * 1e12).alias("a")).distinct()
    originals = b.select(F.round(g.area(F.col("geometry")) * 1e12).alias("a")).distinct()
    assert areas.exceptAll(originals).count() <= areas.count() * 0.1  # turning keeps areas (up to rounding)
    with pytest.raises(ValueError):
        ds.synthesize(b, zones, "small")


def test_synthesis_reads_its_source_once(spark, sf_dir):
    b = ds.with_partition_key(fx.buildings(spark, sf_dir))
    table = ds.synthesize(b, fx.zones(spark), "medium")
    plan = table._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan") == 1 and "Union" not in plan
    own = table.filter("external_id IS NOT NULL")
    assert own.select(*b.columns).exceptAll(b).count() == 0 and own.count() == b.count()
    outside = ds.synthesize(b.withColumn("region", F.lit("no region")), fx.zones(spark), "medium")
    assert outside.count() == b.count()
    broken = ds.synthesize(fx.flawed(spark, sf_dir), fx.zones(spark), "medium")
    assert broken.filter(~g.is_valid(F.col("geometry"))).count() == 0 and "partition_key" in broken.columns


def test_synthesis_keeps_no_row_waiting_for_python(spark, sf_dir):
    # an Arrow function in a select queues its rows, in a file without bound once memory is short
    table = ds.synthesize(ds.with_partition_key(fx.buildings(spark, sf_dir).filter("k < 40")).localCheckpoint(), fx.zones(spark), "large")
    assert "ArrowEvalPython" not in table._jdf.queryExecution().executedPlan().toString()
    assert table.filter("external_id IS NULL").count() == 40 * 19
    # boxes, keys and draws are those of the column functions
    again = table.select("bbox", g.bounds(F.col("geometry")).alias("b"), "partition_key", g.equal_area_centroid(F.col("geometry")).alias("c"))
    assert again.filter("bbox <> b").count() == 0
    assert again.filter(F.col("partition_key") != geohash(F.col("c.x"), F.col("c.y"), ds.PARTITION_PRECISION)).count() == 0
    column = spark.range(1).select(*[uniform(F.lit("07:o1:3"), i) for i in range(5)]).first()
    assert list(column) == ds._draws(["07:o1"], 3)[0].tolist()


def test_tile_chunks_hold_every_feature(spark, sf_dir):
    b = fx.buildings(spark, sf_dir)
    long = tiling.tile_geometries(b, [5], "k")
    whole = sorted(r["feature_id"] for r in long.collect())
    chunks = tiling.build_tiles(b, [5], "k", chunk_features=100)
    assert chunks.count() > 1
    parts = sorted(r["id"] for r in chunks.select(F.explode("features.feature_id").alias("id")).collect())
    assert parts == whole


def test_tile_cut_keeps_only_the_buffered_part(spark):
    from plotgrid.functions import tiles as tl

    world = frame(spark, [("w", rect(-170, -80, 170, 80))])
    t = world.select(tl.to_tile_space(F.col("geometry"), F.lit(2), F.lit(1), F.lit(1)).alias("g")).select(g.bounds(F.col("g")).alias("b"))
    assert tuple(t.first()["b"]) == (-256.0, -256.0, 4352.0, 4352.0)
    gone = world.select(tl.to_tile_space(F.col("geometry"), F.lit(10), F.lit(0), F.lit(0)).alias("g"))
    assert gone.first()["g"] is None


def test_polygonize_bridges_dead_ends_and_holes(spark):
    def line(*points):
        return ([(float(x), float(y)) for x, y in points],)

    lines = spark.createDataFrame([
        line((0, 0), (10, 0), (10, 10), (0, 10), (0, 0)),           # outer square
        line((2, 2), (4, 2), (4, 4), (2, 4), (2, 2)),               # island: a hole and a face
        line((6, 6), (8, 6), (8, 8), (6, 8), (6, 6)),               # joined to the square by a bridge
        line((8, 7), (10, 7)),
        line((3, 2), (3, 1), (2.5, 0.5)),                           # dead end
        line((2, 2), (4, 2)), line((3, 2), (4, 2)),                 # repeated and overlapping
        line((20, 20), (30, 30)), line((20, 30), (30, 20)),         # a free cross
    ], "geometry array<struct<x:double,y:double>>")
    got = pz.polygonize(lines, "geometry").select(
        g.measures(F.col("geometry")).alias("m"), F.size(F.col("geometry")[0]).alias("rings")
    ).collect()
    assert sorted((round(r["m"]["area"], 9), r["rings"]) for r in got) == [(4, 1), (4, 1), (92, 3)]


def test_polygonize_turned_drawing(spark):
    """Squares split by a line that ends on two sides: every half is found once coordinates are rounded."""
    turn = 0.3
    rows = []
    for i in range(12):
        x, y = 5.0 + 0.01 * i, 60.0 + 0.007 * (i % 5)
        square = [(x, y), (x + 1e-4, y), (x + 1e-4, y + 1e-4), (x, y + 1e-4), (x, y)]
        middle = [(x + 4e-5, y), (x + 6e-5, y + 1e-4)]
        for line in (square, middle):
            rows.append(([(a * math.cos(turn) - b * math.sin(turn), a * math.sin(turn) + b * math.cos(turn)) for a, b in line],))
    lines = spark.createDataFrame(rows, "geometry array<struct<x:double,y:double>>")
    assert pz.polygonize(lines, snap=1e-10).count() == 24
    assert pz.polygonize(lines).count() < 24


def test_previous_row_over_buckets_equals_plain_lag(spark):
    rng = random.Random(3)
    rows = [("a" if i % 3 else "b", float(rng.randint(0, 50)), i, rng.random()) for i in range(200)]
    df = spark.createDataFrame(rows, "run string, ts double, seq int, v double")
    got = ranking.previous_row(df, ["run"], "ts", ["ts", "seq"], ["ts", "v"], 4.0)
    before = {}
    for run in "ab":
        last = None
        for r in sorted((r for r in rows if r[0] == run), key=lambda r: (r[1], r[2])):
            before[r[2]] = last
            last = r[3]
    assert {r["seq"]: r["prev_v"] for r in got.collect()} == before


def test_cycle_rows_gives_exact_number(spark):
    df = spark.createDataFrame([(i % 4, i) for i in range(10)], "lead int, rest int")
    for n in (3, 10, 27):
        rows = agg.cycle_rows(df, ["lead"], ["rest"], n).orderBy("request_id").collect()
        order = sorted((i % 4, i) for i in range(10))
        assert [(r["lead"], r["rest"]) for r in rows] == [order[i % 10] for i in range(n)]


def test_phase_split_clamps_and_caps(spark):
    stages = spark.createDataFrame(
        [(1, i, None, 5, 1, 1, 10) for i in range(150)] + [(2, 1, 7, 1, 1, 1, 500)],
        "run_id int, stage_id int, input_bytes_read bigint, executor_run_time_ms bigint, shuffle_read_bytes bigint,"
        "shuffle_write_bytes bigint, stage_duration_ms bigint",
    )
    walls = spark.createDataFrame([(1, 2000.4), (2, 100.0), (3, 50.0)], "run_id int, wall_ms double")
    got = {r["run_id"]: r for r in samples.phase_split(stages, walls, cap=100).collect()}
    assert samples.phase_split(stages, walls).filter("run_id = 1").first()["stage_durations_ms"].count("10") == 150
    assert got[1]["driver_collection_time_ms"] == 500 and got[1]["stage_durations_ms"].count("10") == 100
    assert got[1]["executor_input_bytes_read"] == 0
    assert got[2]["driver_collection_time_ms"] == 0
    assert got[3]["driver_collection_time_ms"] == 50 and got[3]["stage_durations_ms"] == "[]"


def test_metric_rollup_without_values(spark):
    points = spark.createDataFrame(
        [("r", "m", 1, None, None, None, None), ("r", "n", 1, -2.0, None, -3.0, -1.0)],
        "resource string, metric string, ts int, average double, total double, minimum double, maximum double",
    )
    got = {r["metric"]: r for r in samples.metric_rollup(points).collect()}
    assert (got["m"]["total"], got["m"]["mean"], got["m"]["last"], got["m"]["greatest"], got["m"]["least"]) == (0, 0, 0, 0, 0)
    assert (got["n"]["total"], got["n"]["greatest"], got["n"]["least"], got["n"]["rate_total"]) == (-2, 0, -3, -120)


def test_merged_table_reads_no_source_again(spark, tmp_path):
    fkb, osm = conflation_rows()
    sources = []
    for name, rows in (("fkb", fkb), ("osm", osm)):
        frame(spark, rows).write.parquet(f"{tmp_path}/{name}")
        sources.append(spark.read.parquet(f"{tmp_path}/{name}"))
    merged = cf.Conflation(*sources).merged()
    assert merged.inputFiles() and not any(str(tmp_path) in f for f in merged.inputFiles())
    keyed = [cf.with_cell(s) for s in sources]
    assert sorted(map(str, cf.Conflation(*keyed, keyed=True).merged().collect())) == sorted(map(str, merged.collect()))


def test_tile_geometries_take_one_python_worker(spark):
    b = spark.range(200).select(
        F.col("id").alias("k"), g.rectangle(F.col("id") / 16.0, F.lit(10.0), F.col("id") / 16.0 + 0.3, F.lit(10.0) + F.col("id") / 50.0 + 0.1).alias("geometry")
    ).withColumn("bbox", g.bounds(F.col("geometry")))
    long = tiling.measured_geometries(b, [4, 9], "k")
    assert long._jdf.queryExecution().executedPlan().toString().count("ArrowEvalPython") == 1
    # the same rows, shapes and areas as test, cut and area one after the other
    tile = [F.col(c) for c in tiling.TILE]
    steps = tiling.feature_tiles(b, [4, 9], "k").withColumn("geometry", tl.to_tile_space(F.col("geometry"), *tile))
    steps = steps.filter(F.col("geometry").isNotNull()).select(*tiling.TILE, "feature_id", "geometry", g.area(F.col("geometry")).alias("tile_area"))
    assert sorted(map(str, long.collect())) == sorted(map(str, steps.collect()))


def test_keys_and_cells_go_to_python_once(spark):
    b = spark.range(50).select(
        g.rectangle(F.col("id") / 16.0, F.lit(60.0), F.col("id") / 16.0 + 0.01, F.lit(60.0) + F.col("id") / 999.0 + 0.01).alias("geometry")
    )
    both = ds.with_key_and_cell(b)
    assert both._jdf.queryExecution().executedPlan().toString().count("ArrowEvalPython") == 1
    apart = cf.with_cell(ds.with_partition_key(b))
    assert both.columns == apart.columns and sorted(map(str, both.collect())) == sorted(map(str, apart.collect()))


def test_large_shapes_move_only_cells_that_hold_one(spark):
    def source(rows):
        df = spark.createDataFrame(rows, "external_id string, x double, y double, w double")
        x, y, w = F.col("x"), F.col("y"), F.col("w")
        boxed = df.withColumns({"geometry": g.rectangle(x, y, x + w, y + w), "bbox": g.box(x, y, x + w, y + w)})
        return cf.with_cell(boxed.drop("x", "y", "w"))

    small = [("a", 10.0041, 60.0041, 0.0002), ("b", 10.0141, 60.0041, 0.0002)]
    assert cf._large_pairs(source(small), source(small), cf.CELL) is None
    big = ("c", 10.0001, 60.0001, 0.0098)
    for one, other, expected in (
        ([*small, big], small, {("c", "a")}), (small, [*small, big], {("a", "c")}),
        ([*small, big], [*small, big], {("c", "a"), ("a", "c"), ("c", "c")}),
    ):
        f, o = source(one), source(other)
        key = {tuple(r) for r in cf._large_pairs(f, o, cf.CELL).select("f_h1", "o_h1").collect()}
        name = {r.h1: r.external_id for r in [*f.collect(), *o.collect()]}
        assert {(name[a], name[b]) for a, b in key} == expected
        found = cf.candidate_shapes(f, o, cf.CELL).select("f_h1", "o_h1").collect()
        assert sorted((name[a], name[b]) for a, b in found) == sorted(expected | {("a", "a"), ("b", "b")})
