"""Measurement tables: sample rollups, resource deltas, metric series, usage and cost."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from plotgrid.operators.ranking import previous_row
from plotgrid.operators.sizes import broadcast_if_small

GIB = float(1024**3)
# Seconds per billing month, and prices in USD.
MONTH_SECONDS = 30.44 * 24 * 3600
PRICES: dict[str, dict[str, float]] = {
    "container": {"vcpu_second": 0.0000143, "memory_gb_second": 0.0000016, "egress_gb": 0.0},
    "object_store": {
        "read_operation": 0.006 / 10_000, "write_operation": 0.065 / 10_000, "list_operation": 0.065 / 10_000,
        "storage_gb_month": 0.022, "ingress_gb": 0.0, "egress_gb": 0.0,
    },
    "cluster": {"dbu_node_hour": 0.75, "dbu_price": 0.15, "vm_node_hour": 0.204, "egress_gb": 0.0},
    "database": {"compute_second": 0.476 / 3600, "storage_gb_month": 0.15, "egress_gb": 0.0},
}
COST_COLUMNS = ("compute_cost", "storage_cost", "network_cost", "operations_cost")


def price_table(spark: SparkSession) -> DataFrame:
    """Prices as rows ``provider, item, price``."""
    rows = [(p, item, price) for p, items in PRICES.items() for item, price in items.items()]
    return spark.createDataFrame(rows, "provider string, item string, price double")


def _price_row(spark: SparkSession, provider: str) -> DataFrame:
    """One row with a column per price item of a provider."""
    items = list(PRICES[provider])
    rows = price_table(spark).filter(F.col("provider") == provider)
    return F.broadcast(rows.groupBy().pivot("item", items).agg(F.first("price")).select(
        F.struct(*[F.col(i) for i in items]).alias("price")
    ))


def _costed(usage: DataFrame, provider: str, parts: dict[str, Column]) -> DataFrame:
    priced = usage.crossJoin(_price_row(usage.sparkSession, provider))
    costs = {c: parts.get(c, F.lit(0.0)) for c in COST_COLUMNS}
    priced = priced.withColumns(costs)
    total = sum((F.col(c) for c in COST_COLUMNS[1:]), F.col(COST_COLUMNS[0]))
    return priced.withColumn("total_cost", total).withColumn("provider", F.lit(provider)).drop("price")


def container_cost(usage: DataFrame) -> DataFrame:
    """Usage: duration_seconds, vcpu_count, memory_gb, bytes_egress."""
    p, d = F.col("price"), F.col("duration_seconds")
    return _costed(usage, "container", {
        "compute_cost": d * F.col("vcpu_count") * p["vcpu_second"] + d * F.col("memory_gb") * p["memory_gb_second"],
        "network_cost": F.col("bytes_egress") / GIB * p["egress_gb"],
    })


def object_store_cost(usage: DataFrame) -> DataFrame:
    """Usage: duration_seconds, storage_bytes, read/write/list_transactions, bytes_*."""
    p = F.col("price")
    return _costed(usage, "object_store", {
        "storage_cost": F.col("storage_bytes") / GIB * p["storage_gb_month"] * (F.col("duration_seconds") / MONTH_SECONDS),
        "operations_cost": F.col("read_transactions") * p["read_operation"]
        + F.col("write_transactions") * p["write_operation"] + F.col("list_transactions") * p["list_operation"],
        "network_cost": F.col("bytes_ingress") / GIB * p["ingress_gb"] + F.col("bytes_egress") / GIB * p["egress_gb"],
    })


def cluster_cost(usage: DataFrame) -> DataFrame:
    """Usage: duration_seconds, num_workers, bytes_egress."""
    p, hours, workers = F.col("price"), F.col("duration_seconds") / 3600, F.col("num_workers")
    return _costed(usage, "cluster", {
        "compute_cost": workers * p["dbu_node_hour"] * p["dbu_price"] * hours + workers * p["vm_node_hour"] * hours,
        "network_cost": F.col("bytes_egress") / GIB * p["egress_gb"],
    })


def database_cost(usage: DataFrame) -> DataFrame:
    """Usage: duration_seconds, storage_used_bytes, network_egress_bytes."""
    p, d = F.col("price"), F.col("duration_seconds")
    return _costed(usage, "database", {
        "compute_cost": d * p["compute_second"],
        "storage_cost": F.col("storage_used_bytes") / GIB * p["storage_gb_month"] * (d / MONTH_SECONDS),
        "network_cost": F.col("network_egress_bytes") / GIB * p["egress_gb"],
    })


def object_store_usage(windows: DataFrame, files: DataFrame) -> DataFrame:
    """Windows (operation, duration and bytes) beside the file count and size: every file
    is one transaction of the operation's kind, and the listing is one more."""
    reads = F.col("operation") == "READ"
    return windows.crossJoin(F.broadcast(files)).select(
        *windows.columns,
        F.when(reads, F.col("file_count")).otherwise(F.lit(0)).alias("read_transactions"),
        F.when(reads, F.lit(0)).otherwise(F.col("file_count")).alias("write_transactions"),
        F.lit(1).alias("list_transactions"), F.col("total_bytes").alias("storage_bytes"),
    )


def container_usage(windows: DataFrame, experiments: DataFrame, series: DataFrame) -> DataFrame:
    """Windows (script_id, duration) with the configured size and the summed traffic rates.

    ``experiments`` lists id, cpu, memory_gb and related_script_ids; ``series`` is the
    rollup of :func:`metric_rollup` keyed by script.
    """
    listed = experiments.select(
        F.explode(F.array_distinct(F.concat(F.array("id"), "related_script_ids"))).alias("script_id"),
        F.col("cpu").alias("vcpu_count"), "memory_gb",
    )
    traffic = series.groupBy("resource").agg(
        F.sum(F.when(F.col("metric") == "NetworkBytesReceivedPerSecond", F.col("rate_total"))).alias("bytes_ingress"),
        F.sum(F.when(F.col("metric") == "NetworkBytesTransmittedPerSecond", F.col("rate_total"))).alias("bytes_egress"),
    ).withColumnRenamed("resource", "script_id")
    return windows.join(broadcast_if_small(listed), "script_id").join(traffic, "script_id", "left").na.fill(
        0.0, ["bytes_ingress", "bytes_egress"]
    )


def database_usage(windows: DataFrame, series: DataFrame) -> DataFrame:
    """Windows (resource, duration_seconds) with cpu and memory load, traffic and the storage
    used last, from the rollup of :func:`metric_rollup`; 0 for a metric without points."""
    # Metric names, and which of a metric's values each column takes.
    columns = {
        "avg_cpu_percent": ("cpu_percent", "mean"), "max_cpu_percent": ("cpu_percent", "greatest"),
        "min_cpu_percent": ("cpu_percent", "least"), "avg_memory_percent": ("memory_percent", "mean"),
        "max_memory_percent": ("memory_percent", "greatest"), "min_memory_percent": ("memory_percent", "least"),
        "network_ingress_bytes": ("network_bytes_ingress", "total"),
        "network_egress_bytes": ("network_bytes_egress", "total"), "storage_used_bytes": ("storage_used", "last"),
    }
    wide = series.groupBy("resource").agg(*[
        F.max(F.when(F.col("metric") == metric, F.col(value))).alias(name) for name, (metric, value) in columns.items()
    ])
    return windows.join(wide, "resource", "left").na.fill(0.0, list(columns))


def cluster_usage(windows: DataFrame, num_workers: Column) -> DataFrame:
    """Windows (duration_seconds, bytes_egress) with the number of workers that ran them."""
    return windows.withColumn("num_workers", num_workers)


def metric_rollup(points: DataFrame, granularity_seconds: int = 60) -> DataFrame:
    """Per resource and metric: total (mean where the total is missing), mean, last, greatest
    and least value, and rate times granularity. All partial aggregates. Of several
    values at the last time the greatest counts."""
    a = F.col("average")
    return points.groupBy("resource", "metric").agg(
        F.coalesce(F.sum(F.coalesce("total", a)), F.lit(0.0)).alias("total"),
        F.coalesce(F.avg(a), F.lit(0.0)).alias("mean"),
        F.coalesce(F.max_by(a, F.when(a.isNotNull(), F.struct("ts", "average"))), F.lit(0.0)).alias("last"),
        F.coalesce(F.greatest(F.max("maximum"), F.lit(0.0)), F.lit(0.0)).alias("greatest"),
        F.coalesce(F.min("minimum"), F.lit(0.0)).alias("least"),
        F.coalesce(F.sum(a * granularity_seconds), F.lit(0.0)).alias("rate_total"),
    )


def sample_rollup(samples: DataFrame) -> DataFrame:
    """Per query and run: number of samples, elapsed time, cpu time, cardinality range."""
    return samples.groupBy("query_id", "run_id").agg(
        F.count("*").alias("samples"),
        F.avg("elapsed_time").alias("mean_elapsed"), F.min("elapsed_time").alias("min_elapsed"),
        F.max("elapsed_time").alias("max_elapsed"),
        F.sum(F.col("cpu_time_user_seconds") + F.col("cpu_time_system_seconds")).alias("cpu_seconds"),
        F.min(F.coalesce("result_cardinality", F.lit(-1))).alias("min_cardinality"),
        F.max(F.coalesce("result_cardinality", F.lit(-1))).alias("max_cardinality"),
    )


def window_totals(samples: DataFrame) -> DataFrame:
    """Traffic and time window of each query's timed iterations."""
    return samples.groupBy("query_id", "run_id").agg(
        F.sum("network_bytes_sent").alias("bytes_egress"), F.sum("network_bytes_received").alias("bytes_ingress"),
        F.min("started_at").alias("window_start"), F.max("ended_at").alias("window_end"),
    ).withColumn(
        "duration_seconds",
        (F.unix_micros(F.col("window_end").cast("timestamp")) - F.unix_micros(F.col("window_start").cast("timestamp"))) / 1_000_000,
    )


def stage_rollup(stages: DataFrame) -> DataFrame:
    """Per run: summed stage metrics, 0 where nothing was recorded."""
    names = {
        "executor_input_bytes_read": "input_bytes_read", "executor_run_time_ms": "executor_run_time_ms",
        "shuffle_read_bytes": "shuffle_read_bytes", "shuffle_write_bytes": "shuffle_write_bytes",
        "sum_stage_duration_ms": "stage_duration_ms",
    }
    return stages.groupBy("run_id").agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(n) for n, c in names.items()])


def phase_split(stages: DataFrame, walls: DataFrame, cap: int | None = None) -> DataFrame:
    """Per run: time outside stages (never negative) and the stage durations by stage id,
    all of them or the first ``cap``. Stages past a cap are ranked away before the list is built."""
    first = stages
    if cap is not None:
        order = Window.partitionBy("run_id").orderBy("stage_id")
        first = stages.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= cap)
    lists = first.groupBy("run_id").agg(
        F.transform(F.sort_array(F.collect_list(F.struct("stage_id", "stage_duration_ms"))), lambda s: s["stage_duration_ms"])
        .alias("stage_durations")
    )
    return (
        walls.join(stage_rollup(stages), "run_id", "left").join(lists, "run_id", "left")
        .withColumn("driver_collection_time_ms", F.greatest(
            F.lit(0), F.round("wall_ms").cast("bigint") - F.coalesce("sum_stage_duration_ms", F.lit(0))
        ))
        .withColumn("stage_durations_ms", F.coalesce(F.to_json("stage_durations"), F.lit("[]")))
        .drop("stage_durations")
    )


def resource_deltas(counters: DataFrame, bucket_seconds: float = 3600.0) -> DataFrame:
    """Sampler rows as differences: time since the start, step, process cpu step, and the
    core counters since the start (map ``cores`` of user, system, idle, iowait, percent).
    The first row of a run is its baseline and is not returned."""
    run = ["run_id", "iteration"]
    starts = counters.groupBy(*run).agg(F.min_by(F.struct("ts", "cores"), F.struct("ts", "seq")).alias("start"))
    placed = (
        previous_row(counters, run, "ts", ["ts", "seq"], ["ts", "process_cpu_time"], bucket_seconds)
        .filter(F.col("prev_ts").isNotNull())
        .join(starts, run)
    )

    def since_start(core, now):
        then = F.col("start.cores")[core]
        return F.struct(*[
            (now[c] - then[c]).alias(c) for c in ("user", "system", "idle", "iowait")
        ], now["percent"].alias("percent"))

    return placed.select(
        *run, "seq", (F.col("ts") - F.col("start.ts")).alias("elapsed_time"), (F.col("ts") - F.col("prev_ts")).alias("delta_time"),
        (F.col("process_cpu_time") - F.col("prev_process_cpu_time")).alias("delta_process_cpu_time"),
        "process_cpu_percentage", "rss", F.transform_values("cores", since_start).alias("cores"),
    )
