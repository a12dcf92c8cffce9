"""What the jobs leave behind in the shared folder and ask of one task."""

from pathlib import Path

import pytest

from plotgrid import session
from plotgrid.operators import filters as f
from plotgrid.operators import polygonize as pz
from plotgrid.plans import fixtures as fx
from plotgrid.plans.catalog import QUERIES
from plotgrid.sources import registry


@pytest.fixture
def shared(spark):
    """Gives the kinds of tables that came into the shared folder since the start of the test."""
    folder = Path(session.scratch_folder(spark, "none").removeprefix("file:")).parent
    folder.mkdir(parents=True, exist_ok=True)
    before = set(folder.iterdir())
    return lambda: sorted(p.name.rsplit("-", 1)[0] for p in set(folder.iterdir()) - before)


def test_polygonizing_leaves_only_its_faces(spark, sf_dir, shared):
    drawn = pz.polygonize(f.keep_layers(fx.linework(spark, sf_dir).filter("k < 60"), f.LINE_LAYERS))
    assert shared() == ["faces"]
    assert drawn.count() == 20 * 4 + 20 * 2 + 20 * 2


def test_union_of_areas_leaves_only_its_rings(spark, sf_dir, shared):
    QUERIES["a11_union_areas"](spark, sf_dir)
    assert shared() == ["outline-rings"]


def test_a_written_step_takes_its_shuffle_setting_back(spark, shared):
    session.cut_lineage(spark.range(10).repartition(3), "step")
    assert spark.conf.get(session.SHUFFLE_CLEANUP, "false") == "false"


def test_both_border_rules_read_one_keyed_table(spark, sf_dir, shared):
    QUERIES["j2_missed_at_borders"](spark, sf_dir)
    assert shared() == ["candidates", "candidates", "fkb-keys", "osm-keys"]


def test_a_large_registry_is_not_worked_out_by_one_task(spark, tmp_path):
    rows = spark.range(200_000).selectExpr("sha2(string(id), 256) region", "cast('x' AS binary) wkb", "'x' json")
    size = "spark.sql.adaptive.advisoryPartitionSizeInBytes"
    before = spark.conf.get(size, None)
    spark.conf.set(size, "1m")
    try:
        store = registry.stored_counties(spark, str(tmp_path / "large"))
        registry.store_counties(spark, store.path, rows)
    finally:
        spark.conf.unset(size) if before is None else spark.conf.set(size, before)
    registry.store_counties(spark, f"{tmp_path}/small", rows.limit(50))
    assert len(list(Path(store.path).glob("data/*/part-*.parquet"))) > 1 and store.read().count() == 200_000
    assert len(list(tmp_path.glob("small/data/*/part-*.parquet"))) == 1
