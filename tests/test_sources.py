"""Readers, writers and registries."""

from pathlib import Path

import pytest
from pyspark.sql import functions as F

from plotgrid import session
from plotgrid.functions import geometry as g
from plotgrid.operators import shaping
from plotgrid.plans import fixtures as fx
from plotgrid.sources import layout, registry

RELEASES = "release string, date_created timestamp"


def releases(spark, rows):
    import datetime

    return spark.createDataFrame(
        [(r, None if d is None else datetime.datetime.fromisoformat(d)) for r, d in rows], RELEASES
    )


@pytest.mark.parametrize("rows, today, expected", [
    ([], "2026-04-02", "2026-04-02.0"),
    ([("2026-04-01.3", None)], "2026-04-02", "2026-04-02.0"),
    ([("2026-04-01.3", "2026-04-01T10:00:00")], "2026-04-02", "2026-04-02.0"),
    ([("2026-04-02.3", "2026-04-02T10:00:00"), ("2026-04-02.4", "2026-04-02T09:00:00")], "2026-04-02", "2026-04-02.4"),
    ([("2026-04-09.1", "2026-04-02T10:00:00")], "2026-04-02", "2026-04-02.2"),
    ([("broken", "2026-04-02T10:00:00")], "2026-04-02", "2026-04-02.0"),
    ([("2026-04-02.x", "2026-04-02T10:00:00")], "2026-04-02", "2026-04-02.0"),
])
def test_next_release(spark, rows, today, expected):
    assert registry.next_release(releases(spark, rows), F.lit(today)).first()["release"] == expected


def test_upsert_replaces_and_appends(spark):
    old = spark.createDataFrame([("01", b"a", "x"), ("02", b"b", "y")], "region string, wkb binary, json string")
    new = spark.createDataFrame([("02", b"c", "z"), ("03", b"d", "w")], "region string, wkb binary, json string")
    got = {r["region"]: r["json"] for r in registry.upsert_counties(old, new).collect()}
    assert got == {"01": "x", "02": "z", "03": "w"}


def test_path_rules(spark):
    rows = [
        ("2026-04-02.0", "03", "part_00000.parquet", None), ("2026-04-02.0", "*", "*.parquet", None),
        ("2026-04-02", "03", "*.parquet", "release form"), ("2026-04-31.0", "03", "*.parquet", "release date"),
        ("2026-04-02.-1", "03", "*.parquet", "release version"), ("2026-04-02.1", "3", "*.parquet", "region"),
        ("2026-04-02.1", "03", "part_1.parquet", "file name"), ("2026-04-02.1", "003", "*.parquet", "region"),
    ]
    df = spark.createDataFrame(rows, "release string, region string, file_name string, wanted string")
    assert layout.validate_paths(df).filter("NOT (problem <=> wanted)").count() == 0


def test_layout_prunes_regions_and_sorts(spark, sf_dir, tmp_path):
    rows = fx.buildings(spark, sf_dir).withColumn("partition_key", F.lit("u4x"))
    layout.write_buildings(rows, str(tmp_path), "2026-04-02.0", "small")
    layout.write_buildings(rows.limit(0), str(tmp_path), "2026-04-02.0", "medium")
    read = layout.scan_buildings(spark, str(tmp_path), "2026-04-02.0", "small", region="03")
    assert {r["region"] for r in read.select("region").distinct().collect()} == {"03"}
    assert read.filter("size = 'small'").count() == 100
    assert dict(read.dtypes)["geometry"] == "binary"
    assert "region" not in spark.read.parquet(f"{tmp_path}/release/2026-04-02.0/size=small/theme=buildings/region=03").columns
    summary = layout.blob_summary(spark, str(tmp_path)).first()
    assert summary["file_count"] == layout.file_listing(spark, str(tmp_path)).count() > 0
    back = layout.decoded(read.select("external_id", "geometry"))
    assert back.join(rows.select("external_id", F.col("geometry").alias("was")), "external_id").filter("geometry <> was").count() == 0


def test_undecodable_rows_are_set_apart(spark):
    df = spark.createDataFrame([("a", b"junk"), ("b", None)], "id string, geometry binary")
    good = spark.range(1).select(F.lit("c").alias("id"), g.to_wkb(g.rectangle(0, 0, 1, 1)).alias("geometry"))
    both = df.unionByName(good)
    assert [r["id"] for r in layout.decoded(both).collect()] == ["c"]
    assert {r["id"] for r in layout.undecodable(both).collect()} == {"a", "b"}


def test_seed_skips_empty_frames(spark, sf_dir, tmp_path):
    b = fx.buildings(spark, sf_dir)
    assert not layout.seed_table(b.limit(0), "seed_none")


def test_scan_or_empty_passes_other_errors(spark, tmp_path):
    assert layout.scan_or_empty(spark, str(tmp_path / "none"), "a int").count() == 0
    with pytest.raises(Exception):
        layout.scan_or_empty(spark, str(tmp_path / "none"), "a nonsense")


def test_global_iteration(spark):
    df = spark.createDataFrame([(1, 1), (3, 2)], "benchmark_run int, iteration int")
    assert [r["iteration"] for r in registry.global_iteration(df, 100).collect()] == [1, 202]


def test_hex_wkb_tags(spark):
    raw = spark.range(1).select(g.to_wkb(F.concat(g.rectangle(0, 0, 1, 1), g.rectangle(2, 0, 3, 1))).alias("w")).first()["w"]
    rows = [(1, {"building": "Yes"}, "01" + bytes(raw).hex().upper()[2:]), (2, {"name": "x"}, "00"), (3, {"building": "hut"}, "0106zz")]
    df = spark.createDataFrame(rows, "id int, tags map<string,string>, wkb string")
    got = shaping.normalize_tags(df, ["name", "building"])
    assert [(r["id"], r["type"]) for r in got.collect()] == [(1, "unspecified")]
    assert layout.decoded(got.withColumnRenamed("wkb", "geometry")).select(F.size("geometry").alias("n")).first()["n"] == 2


class FakeSession:
    """Just the settings that the scratch folder looks at."""

    def __init__(self, folder, master):
        self.conf = {"spark.checkpoint.dir": folder} if folder else {}
        self.sparkContext = type("Context", (), {"applicationId": f"{folder}{master}", "master": master})


def test_scratch_folder_follows_the_session(tmp_path):
    assert session.scratch_folder(FakeSession(str(tmp_path), "yarn"), "x").startswith(f"{tmp_path}/x-")
    local = FakeSession(None, "local[2]")
    first, second = session.scratch_folder(local, "x"), session.scratch_folder(local, "x")
    assert first != second and first.rsplit("/", 1)[0] == second.rsplit("/", 1)[0]
    with pytest.raises(ValueError):
        session.scratch_folder(FakeSession(None, "yarn"), "x")


def test_scope_leaves_no_folder(spark, sf_dir):
    b = fx.buildings(spark, sf_dir).select("k")

    def folders(df):
        return {Path(f.removeprefix("file:")).parent for f in df.inputFiles()}

    with session.scratch_scope(spark):
        kept = session.cut_lineage(b, "scope")
        inside = folders(kept)
        assert kept.count() == b.count() and all(f.exists() for f in inside)
    assert inside and not any(f.exists() for f in inside)
    free = session.cut_lineage(b, "free")
    assert all(f.exists() for f in folders(free))
