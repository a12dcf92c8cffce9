"""Stored registries, file extents and the metrics of real runs."""

import datetime

import pytest
from pyspark.sql import functions as F

from plotgrid.operators import dataset as ds
from plotgrid.operators import filters, stages, zones
from plotgrid.operators import samples as sm
from plotgrid.plans import fixtures as fx
from plotgrid.plans.catalog import QUERIES
from plotgrid.sources import layout, registry
from plotgrid.sources.snapshots import Snapshots

RELEASE = "2026-04-02.0"


def county(spark, *regions, state="x"):
    return spark.createDataFrame([(r, b"", state) for r in regions], registry.COUNTIES)


def test_versions_are_kept_and_expire(spark, tmp_path):
    path = str(tmp_path / "counties")
    store = registry.stored_counties(spark, path)
    assert store.versions() == [] and store.read().count() == 0
    assert [registry.store_counties(spark, path, county(spark, f"{i:02d}", "01", state=str(i))) for i in (1, 2, 3)] == [1, 2, 3]
    assert {(r.region, r.json) for r in store.read().collect()} == {("01", "3"), ("02", "2"), ("03", "3")}
    assert {r.region for r in store.read(1).collect()} == {"01"}
    store.expire(1)
    assert store.versions() == [3] and store.read().count() == 3
    assert registry.store_counties(spark, path, county(spark, "09")) == 4


def test_interleaved_writers_lose_no_row(spark, tmp_path):
    path = str(tmp_path / "counties")
    store = registry.stored_counties(spark, path)
    tries = []

    def slow(old):
        tries.append(old.count())
        if len(tries) < 3:  # another writer gets in between reading and committing, twice
            registry.store_counties(spark, path, county(spark, f"other {len(tries)}"))
        return registry.upsert_counties(old, county(spark, "slow"))

    assert store.update(slow) == 3 and tries == [0, 1, 2]
    assert {r.region for r in store.read().collect()} == {"slow", "other 1", "other 2"}
    assert len(list((tmp_path / "counties" / "data").iterdir())) == 3

    def always_late(old):
        registry.store_counties(spark, path, county(spark, "fast"))
        return old

    with pytest.raises(RuntimeError):
        store.update(always_late, retries=2)


def test_two_writers_of_one_day_get_two_releases(spark, tmp_path):
    path = str(tmp_path / "releases")
    day, at = F.lit("2026-04-02"), F.lit("2026-04-02 10:00:00")
    inner = []

    def late(old):
        if not inner:
            inner.append(registry.store_release(spark, path, day, at))
        return registry.with_next_release(old, day, at)

    registry.stored_releases(spark, path).update(late)
    assert inner == ["2026-04-02.0"]
    assert {r.release for r in registry.stored_releases(spark, path).read().collect()} == {"2026-04-02.0", "2026-04-02.1"}


def test_a_broken_write_is_not_seen(spark, tmp_path):
    path = str(tmp_path / "counties")
    store = Snapshots(spark, path, registry.COUNTIES)
    registry.store_counties(spark, path, county(spark, "01"))
    with pytest.raises(Exception, match="broken"):
        store.update(lambda old: old.withColumn("region", F.raise_error(F.lit("broken")).cast("string")))
    county(spark, "99").write.parquet(f"{path}/data/never-committed")
    (tmp_path / "counties" / "log" / ".half").write_bytes(b"")
    assert store.versions() == [1] and [r.region for r in store.read().collect()] == ["01"]
    assert registry.store_counties(spark, path, county(spark, "02")) == 2


@pytest.fixture(scope="module")
def release(spark, tmp_path_factory):
    root = str(tmp_path_factory.mktemp("extents"))
    hours = F.expr("timestamp'2024-01-01 00:00:00' + make_interval(0, 0, 0, 0, CAST(k AS INT))")
    rows = ds.with_partition_key(fx.buildings(spark, "/root/testdata/sf0.001")).withColumn("feature_update_time", hours)
    path = layout.write_buildings(rows.repartition(3), root, RELEASE, "small", max_file_rows=10)
    return path, layout.manifest_with_extents(spark, f"{path}/size=small", "small", "feature_update_time")


def test_file_extents_are_those_of_their_rows(spark, release):
    path, manifest = release
    rows = spark.read.parquet(f"{path}/size=small").select("*", F.col("_metadata.file_name").alias("file_name"))
    plain = {}
    for r in rows.select(F.lpad("region", 2, "0").alias("region"), "file_name", "bbox", "feature_update_time").collect():
        plain.setdefault((r.region, r.file_name), []).append((r.bbox, r.feature_update_time))
    got = manifest.collect()
    assert len(got) == len({r.href for r in got}) == len(plain) > 100
    for r in got:
        mine = plain[r.region, r.file_name]
        assert r.rows == len(mine) and r.bytes > 0
        assert tuple(r.bbox) == (min(b.xmin for b, _ in mine), min(b.ymin for b, _ in mine), max(b.xmax for b, _ in mine), max(b.ymax for b, _ in mine))
        assert (r.first_time, r.last_time) == (min(t for _, t in mine), max(t for _, t in mine))
    items = layout.item_extents(manifest).collect()
    assert len(items) == 15 and sum(i.files for i in items) == len(got) and sum(i.rows for i in items) == rows.count()


def test_a_frame_opens_fewer_files(spark, release):
    path, manifest = release
    schema = "k bigint, bbox struct<xmin:double,ymin:double,xmax:double,ymax:double>, feature_update_time timestamp"
    all_files = manifest.count()
    near = layout.scan_by_extent(spark, manifest, path, schema, filters.NEIGHBORHOOD)
    assert 0 < len(near.inputFiles()) < all_files / 3
    whole = spark.read.schema(schema).parquet(f"{path}/size=small")

    def hits(df):
        return {r.k for r in df.filter("bbox.xmin <= 10.41 AND bbox.xmax >= 10.38 AND bbox.ymin <= 63.44 AND bbox.ymax >= 63.42").collect()}

    assert hits(near) == hits(whole) != set()
    late = F.lit(datetime.datetime(2024, 2, 20))
    some = layout.scan_by_extent(spark, manifest, path, schema, until=late)
    assert len(some.inputFiles()) < all_files
    before = F.col("feature_update_time") <= late
    assert some.filter(before).count() == whole.filter(before).count()
    none = layout.scan_by_extent(spark, manifest, path, schema, (100.0, 0.0, 101.0, 1.0))
    assert none.count() == 0 and none.columns == near.columns
    assert {"size", "theme", "region"} <= set(near.columns)


def test_metrics_of_a_real_run(spark):
    sf_dir = "/root/testdata/sf0.01"
    with stages.recorded(spark, "run one") as run:
        zones.spatial_join_counts(fx.buildings(spark, sf_dir), fx.zones(spark)).write.format("noop").mode("overwrite").save()
    spark.range(10).repartition(2).count()  # not part of the run
    rows = run.stages().collect()
    assert rows and len({(r.stage_id, r.attempt) for r in rows}) == len(rows)
    total = {c: sum(getattr(r, c) for r in rows) for c in ("input_bytes_read", "shuffle_read_bytes", "shuffle_write_bytes", "stage_duration_ms", "tasks")}
    assert all(v > 0 for v in total.values()), total
    rolled = sm.stage_rollup(run.stages()).first()
    assert rolled.executor_input_bytes_read == total["input_bytes_read"] and rolled.shuffle_write_bytes == total["shuffle_write_bytes"]
    split = sm.phase_split(run.stages(), run.walls()).first()
    assert split.wall_ms == run.wall_ms > 0 and split.driver_collection_time_ms == max(0, round(run.wall_ms) - total["stage_duration_ms"])
    assert spark.sparkContext.getLocalProperty("spark.jobGroup.id") is None
    with stages.recorded(spark, "run two") as other:
        pass
    assert other.stages().count() == 0
    assert sm.phase_split(other.stages(), other.walls()).first().stage_durations_ms == "[]"


def test_recorded_query(spark, sf_dir):
    row = QUERIES["a9_recorded_run"](spark, sf_dir).first()
    assert row.executor_input_bytes_read > 0 and row.shuffle_write_bytes > 0 and row.stage_durations_ms != "[]"
