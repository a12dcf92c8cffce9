"""Hilbert keys and the layout that is sorted by them."""

import glob
import random

import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from plotgrid.functions import curves
from plotgrid.operators import dataset as ds
from plotgrid.operators import filters
from plotgrid.plans import fixtures as fx
from plotgrid.sources import layout


def cell_of(key, bits):
    """The cell at a place of the curve: quarter by quarter from the smallest square up."""
    x = y = 0
    for level in range(bits):
        quarter, side = key >> 2 * level & 3, 1 << level
        right, up = quarter >> 1, (quarter ^ quarter >> 1) & 1
        if not up:
            if right:
                x, y = side - 1 - x, side - 1 - y
            x, y = y, x
        x, y = x + side * right, y + side * up
    return x, y


def keys_of(spark, cells, bits):
    df = spark.createDataFrame(cells, "x bigint, y bigint")
    return {(r.x, r.y): r.key for r in df.withColumn("key", curves.hilbert_key(F.col("x"), F.col("y"), bits)).collect()}


def test_every_cell_of_a_square(spark):
    keys = keys_of(spark, [(x, y) for x in range(16) for y in range(16)], 4)
    assert sorted(keys.values()) == list(range(256))
    assert all(cell_of(key, 4) == cell for cell, key in keys.items())
    along = sorted(keys, key=keys.get)
    assert all(abs(a[0] - b[0]) + abs(a[1] - b[1]) == 1 for a, b in zip(along, along[1:]))


@pytest.mark.parametrize("bits", [8, 20, 28])
def test_random_cells(spark, bits):
    rng = random.Random(bits)
    cells = [(rng.getrandbits(bits), rng.getrandbits(bits)) for _ in range(300)] + [(0, 0), ((1 << bits) - 1,) * 2]
    assert all(cell_of(key, bits) == cell for cell, key in keys_of(spark, cells, bits).items())


def test_missing_and_outer_positions(spark):
    df = spark.sql("""SELECT * FROM VALUES (NULL, 1D, 2D, 3D), (-500D, -200D, -500D, -200D), (500D, 200D, 500D, 200D)
        AS t(xmin, ymin, xmax, ymax)""").select(F.struct("*").alias("bbox"))
    low, high = (keys_of(spark, [c], 20)[c] for c in ((0, 0), ((1 << 20) - 1,) * 2))
    assert [r.key for r in df.select(curves.position_key(F.col("bbox")).alias("key")).collect()] == [None, low, high]
    with pytest.raises(ValueError):
        curves.hilbert_key(F.lit(1), F.lit(1), 10)


def groups_met(path, frame):
    """Row groups whose box statistics meet a frame, and all row groups."""
    met = total = 0
    for file in glob.glob(f"{path}/**/*.parquet", recursive=True):
        for i in range((meta := pq.ParquetFile(file).metadata).num_row_groups):
            group = meta.row_group(i)
            stats = {c.path_in_schema: c.statistics for c in (group.column(j) for j in range(group.num_columns)) if c.path_in_schema.startswith("bbox")}
            total += 1
            met += (
                stats["bbox.xmin"].min <= frame[2] and stats["bbox.xmax"].max >= frame[0]
                and stats["bbox.ymin"].min <= frame[3] and stats["bbox.ymax"].max >= frame[1]
            )
    return met, total


def test_a_frame_meets_few_row_groups(spark, tmp_path):
    rows = ds.with_partition_key(fx.buildings(spark, "/root/testdata/sf0.01")).withColumn("region", F.lit("01"))
    by_hash = layout.encoded(rows).hint("rebalance", "region", "partition_key").sortWithinPartitions("region", "partition_key")
    by_hash.write.option("parquet.block.row.count.limit", 100).parquet(str(tmp_path / "hash"))
    layout.write_buildings(rows, str(tmp_path / "curve"), "2026-04-02.0", "small", row_group_rows=100)
    before, after = groups_met(tmp_path / "hash", filters.NEIGHBORHOOD), groups_met(tmp_path / "curve", filters.NEIGHBORHOOD)
    assert after[1] > 100 and after[0] * 4 < before[0], (before, after)
    back = layout.scan_buildings(spark, str(tmp_path / "curve"), "2026-04-02.0", "small")
    assert "_place" not in back.columns and back.count() == rows.count()
    assert layout.decoded(back).join(rows.select("k", F.col("geometry").alias("was")), "k").filter("geometry = was").count() == rows.count()


def test_a_hot_region_is_cut_into_ranges(spark, tmp_path):
    rows = ds.with_partition_key(fx.buildings(spark, "/root/testdata/sf0.01")).withColumn("region", F.lit("01"))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    layout.write_buildings(rows, str(tmp_path), "2026-04-02.0", "small")
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    read = layout.scan_buildings(spark, str(tmp_path), "2026-04-02.0", "small").withColumn("key", curves.position_key(F.col("bbox")))
    spans = sorted(
        (r.low, r.high) for r in read.groupBy(F.input_file_name()).agg(F.min("key").alias("low"), F.max("key").alias("high")).collect()
    )
    assert len(spans) > 4 and all(a[1] <= b[0] for a, b in zip(spans, spans[1:]))


def test_declared_schema_opens_no_footer(spark, sf_dir, tmp_path):
    rows = ds.with_partition_key(fx.buildings(spark, sf_dir))
    layout.write_buildings(rows, str(tmp_path), "2026-04-02.0", "small")
    schema = "k bigint, external_id string, bbox struct<xmin:double,ymin:double,xmax:double,ymax:double>, later string"
    read = layout.scan_buildings(spark, str(tmp_path), "2026-04-02.0", "small", region="03", schema=schema)
    assert read.columns == ["k", "external_id", "bbox", "later", "size", "theme", "region"]
    whole = layout.scan_buildings(spark, str(tmp_path), "2026-04-02.0", "small", region="03")
    assert {r.k for r in read.filter("later IS NULL").collect()} == {r.k for r in whole.collect()}
