"""Small tables stored as numbered snapshots: writers never lose each other's rows, readers see whole versions only."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession

RETRIES = 20


class Snapshots:
    """A table below ``path``: data folders, and a log that names the folder of each version.

    A version counts once its log entry stands under its number. The entry is written aside and renamed there, which
    fails where an entry already stands; so of two writers that start from one version a single one gets through, and an
    entry is never seen half-written. Works on file systems whose rename refuses to replace a file and is one step.
    """

    def __init__(self, spark: SparkSession, path: str, schema: str):
        self.spark, self.path, self.schema = spark, path.rstrip("/"), schema
        jvm = spark._jvm
        self._hadoop = jvm.org.apache.hadoop.fs
        settings = spark.sparkContext._jsc.hadoopConfiguration()
        log = self._hadoop.Path(f"{self.path}/log")
        self._files = log.getFileSystem(settings)
        self._context = self._hadoop.FileContext.getFileContext(self._files.makeQualified(log).toUri(), settings)

    def _at(self, name: str):
        return self._files.makeQualified(self._hadoop.Path(f"{self.path}/{name}"))

    def versions(self) -> list[int]:
        """The numbers of all complete versions, rising."""
        log = self._at("log")
        if not self._files.exists(log):
            return []
        names = [status.getPath().getName() for status in self._files.listStatus(log)]
        return sorted(int(name) for name in names if name.isdigit())

    def _folder(self, version: int) -> str:
        stream = self._files.open(self._at(f"log/{version:012d}"))
        try:
            return stream.readUTF()
        finally:
            stream.close()

    def read(self, version: int | None = None) -> DataFrame:
        """The rows of a version, the last complete one by default; no rows before the first."""
        known = self.versions()
        if version is None:
            if not known:
                return self.spark.createDataFrame([], self.schema)
            version = known[-1]
        return self.spark.read.schema(self.schema).parquet(f"{self.path}/data/{self._folder(version)}")

    def _commit(self, version: int, folder: str) -> bool:
        """Whether the log entry of this version was free and is ours now."""
        aside = self._at(f"log/.{folder}")
        stream = self._files.create(aside, True)
        stream.writeUTF(folder)
        stream.close()
        none = self.spark.sparkContext._gateway.new_array(self._hadoop.Options.Rename, 0)
        try:
            self._context.rename(aside, self._at(f"log/{version:012d}"), none)
            return True
        except Py4JJavaError as error:
            if "FileAlreadyExists" not in error.java_exception.getClass().getName():
                raise
            self._files.delete(aside, False)
            return False

    def update(self, change: Callable[[DataFrame], DataFrame], retries: int = RETRIES) -> int:
        """Store ``change(rows of the last version)`` as the next version and return its number.

        Where another writer was faster, the change is worked out anew on what that one stored. A write that breaks
        off leaves a data folder that no version names.
        """
        for _ in range(retries):
            known = self.versions()
            base = known[-1] if known else 0
            folder = uuid.uuid4().hex
            new = change(self.read(base) if known else self.read())
            # one file while the table is small; a change is worked out by many tasks however large it gets
            new.hint("rebalance").write.parquet(f"{self.path}/data/{folder}")
            if self._commit(base + 1, folder):
                return base + 1
            self._files.delete(self._at(f"data/{folder}"), True)
        raise RuntimeError(f"{self.path}: other writers were faster {retries} times")

    def expire(self, keep: int) -> None:
        """Delete all but the last ``keep`` versions."""
        for version in self.versions()[: -keep or None]:
            self._files.delete(self._at(f"data/{self._folder(version)}"), True)
            self._files.delete(self._at(f"log/{version:012d}"), False)
