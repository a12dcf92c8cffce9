"""Session settings and the shared scratch folder."""

from __future__ import annotations

import shutil
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from pathlib import Path

from pyspark.sql import SparkSession


def local_session(cores: str = "8", memory: str = "8g") -> SparkSession:
    """Session for tests and benchmarks; a cluster brings its own."""
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("plotgrid")
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.shuffle.partitions", cores)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.parquet.aggregatePushdown", "true")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return attach(spark)


_attached: set[str] = set()


def attach(spark: SparkSession) -> SparkSession:
    """Send this package to the Python workers, as ``--py-files`` does at submit time."""
    application = spark.sparkContext.applicationId
    if application not in _attached:
        root = Path(__file__).resolve().parent
        archive = shutil.make_archive(
            str(Path(tempfile.mkdtemp(prefix="plotgrid-")) / "plotgrid"), "zip", root.parent, root.name
        )
        spark.sparkContext.addPyFile(archive)
        _attached.add(application)
    return spark


_own_folder: dict[str, str] = {}


_open_scopes: list[list[str]] = []


@contextmanager
def scratch_scope(spark: SparkSession) -> Iterator[None]:
    """Delete, at the end, all scratch folders made inside.

    Results are lazy: write or collect them inside the scope. Without a scope the folders
    stay for whoever reads the results.
    """
    made: list[str] = []
    _open_scopes.append(made)
    try:
        yield
    finally:
        _open_scopes.remove(made)
        for folder in made:
            drop_folder(spark, folder)


def scratch_folder(spark: SparkSession, name: str) -> str:
    """A new folder path below the shared folder named by ``spark.checkpoint.dir``.

    Where the setting is missing, a local session gets a temporary folder; a cluster
    session must name one, since executors cannot share a machine-local folder.
    """
    base = spark.conf.get("spark.checkpoint.dir", None) or _own_folder.get(spark.sparkContext.applicationId)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder every executor can reach")
        base = _own_folder.setdefault(spark.sparkContext.applicationId, tempfile.mkdtemp(prefix="plotgrid-"))
    folder = f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"
    if _open_scopes:
        _open_scopes[-1].append(folder)
    return folder


def drop_folder(spark: SparkSession, folder: str) -> None:
    """Delete a scratch folder that nothing reads any more."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


SHUFFLE_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def cut_lineage(df, name: str, folder: str | None = None):
    """Write a frame to the shared folder and read it back, so that a lost executor
    costs a re-read and not a re-run of every earlier step.

    The shuffle files of the write go with it; without that the files of a chain of such steps would lie on the executors' disks
    until the driver happens to collect garbage. A ``folder`` made outside a ``scratch_scope`` outlives it.
    """
    spark = df.sparkSession
    path = folder or scratch_folder(spark, name)
    before = spark.conf.get(SHUFFLE_CLEANUP, None)
    spark.conf.set(SHUFFLE_CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.unset(SHUFFLE_CLEANUP) if before is None else spark.conf.set(SHUFFLE_CLEANUP, before)
    return spark.read.schema(df.schema).parquet(path)
