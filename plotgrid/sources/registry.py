"""Small registry tables: counties, releases, runs. Updates are joins that return the new
table; nothing passes through the driver."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from plotgrid.sources.snapshots import Snapshots

COUNTIES = "region string, wkb binary, json string"
RELEASES = "release string, date_created timestamp"


def get_county(counties: DataFrame, region: str) -> DataFrame:
    return counties.filter(F.col("region") == region).select("region", "wkb", "json")


def upsert_counties(counties: DataFrame, changes: DataFrame) -> DataFrame:
    """Replace rows with an equal region, append the others."""
    return counties.join(changes, "region", "left_anti").unionByName(changes)


def stored_counties(spark: SparkSession, path: str) -> Snapshots:
    """The county registry below a folder."""
    return Snapshots(spark, path, COUNTIES)


def store_counties(spark: SparkSession, path: str, changes: DataFrame) -> int:
    """Upsert counties into the stored registry and return its new version."""
    return stored_counties(spark, path).update(lambda old: upsert_counties(old, changes.select(*old.columns)))


def stored_releases(spark: SparkSession, path: str) -> Snapshots:
    """The release registry below a folder."""
    return Snapshots(spark, path, RELEASES)


def store_release(spark: SparkSession, path: str, today: Column, created: Column) -> str:
    """Append the next release to the stored registry and return its name; of two writers on one day each gets its own."""
    store = stored_releases(spark, path)
    version = store.update(lambda old: with_next_release(old, today, created))
    return latest_release(store.read(version)).first()["release"]


def latest_release(releases: DataFrame) -> DataFrame:
    """The newest row by creation time, its name split into ``day`` and ``version``; no
    row when there is none or its name cannot be read."""
    newest = releases.filter(F.col("date_created").isNotNull()).agg(
        F.max_by("release", F.struct("date_created", "release")).alias("release")
    )
    day = F.regexp_extract("release", r"^(.*)\.([^.]*)$", 1)
    version = F.regexp_extract("release", r"^(.*)\.([^.]*)$", 2)
    return newest.select("release", day.try_cast("date").alias("day"), version.try_cast("int").alias("version")).filter(
        F.col("day").isNotNull() & F.col("version").isNotNull()
    )


def next_release(releases: DataFrame, today: Column) -> DataFrame:
    """Name of the release to create: version 0 on a new day, else the next version."""
    one = releases.sparkSession.range(1).select(today.cast("date").alias("today"))
    named = one.join(F.broadcast(latest_release(releases)), F.lit(True), "left").select(
        "today",
        F.when(F.col("day").isNull() | (F.col("today") > F.col("day")), F.lit(0))
        .otherwise(F.col("version") + 1).alias("version"),
    )
    return named.select(F.concat_ws(".", F.date_format("today", "yyyy-MM-dd"), "version").alias("release"))


def with_next_release(releases: DataFrame, today: Column, created: Column) -> DataFrame:
    """The registry with the new release appended. An unreadable registry starts afresh."""
    known = releases.join(F.broadcast(latest_release(releases).select(F.lit(True).alias("_ok"))), F.lit(True), "left_semi")
    row = next_release(releases, today).withColumn("date_created", created.cast("timestamp"))
    return known.unionByName(row)


def append_samples(samples: DataFrame, path: str, iterations_per_run: int) -> None:
    """Append sample rows under one folder per query; iterations of later runs continue the count.

    Run and iteration stay columns and rows are brought together by query, so a long history
    makes neither a folder nor a file per run.
    """
    rows = global_iteration(samples, iterations_per_run).hint("rebalance", "query_id")
    rows.write.mode("append").partitionBy("query_id").parquet(path)


def global_iteration(samples: DataFrame, iterations_per_run: int) -> DataFrame:
    return samples.withColumn("iteration", F.col("iteration") + iterations_per_run * (F.col("benchmark_run") - 1))


def append_costs(costs: DataFrame, path: str) -> None:
    """Append cost rows under one folder per query; run and provider stay columns."""
    costs.hint("rebalance", "query_id").write.mode("append").partitionBy("query_id").parquet(path)


def append_run(runs: DataFrame, path: str) -> None:
    """One metadata row per run: id, timestamp, query_id, run_id."""
    runs.select("id", "timestamp", "query_id", "run_id").write.mode("append").parquet(path)
