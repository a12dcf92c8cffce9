"""Exact k-means with a queue of bound gaps for each cluster; only vectors whose gap expires are looked at again."""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plotgrid.llm.common import table
from plotgrid.llm.registry import query
from plotgrid.session import cut_lineage, scratch_folder

COMPONENTS = 64
CLUSTERS = 16
ROUNDS = 3
SCALE = 64
LIMIT = 1 << 27
SLACK = 1e-9
ROW_GROUP_BYTES = 1 << 23

HEAP = "cluster int, expires double, vec_id bigint, v array<int>"


def kept_vectors(vectors: DataFrame, components: int = COMPONENTS, scale: int = SCALE) -> DataFrame:
    """(vec_id, v): vectors of exactly ``components`` finite components, each as the whole number floor(scale * x).

    A component of ``LIMIT`` or more after scaling would make squared distances leave 64 bits: such a vector stops the job.
    """
    x = F.col("embedding").cast("array<double>")
    good = (F.size(x) == components) & F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) != math.inf))
    whole = F.transform(x, lambda c: F.when(F.abs(c) < LIMIT / scale, F.floor(c * scale).cast("int")).otherwise(
        F.raise_error(F.lit("a component is too large for 64-bit distances")).cast("int")
    ))
    return vectors.where(F.coalesce(good, F.lit(False))).select(F.col("vec_id").cast("bigint"), whole.alias("v"))


def first_centroids(kept: DataFrame, clusters: int = CLUSTERS) -> np.ndarray:
    """The vectors with the smallest hashes of their ids, in this order; of equal ids the smaller vector first."""
    mark = F.sha2(F.concat(F.lit("1:"), F.coalesce(F.col("vec_id").cast("string"), F.lit(""))).cast("binary"), 256)
    rows = kept.select(mark.alias("mark"), "v").orderBy("mark", "v").limit(clusters).collect()
    return np.array([r["v"] for r in rows], dtype=np.int64)


@dataclass
class Heaps:
    """Centroids, what each cluster holds, and the paths of its queue.

    ``drift[c]`` sums, over the rounds, how far centroid c moved and how far any other moved at most: what the gap of a
    vector of c (second distance less first) can have shrunk by. An entry's ``expires`` is its gap plus the drift when it was
    measured, so it holds as long as it lies above the drift. ``popped`` is the drift up to which older tables are used up.
    """

    centroids: np.ndarray
    sums: np.ndarray
    counts: np.ndarray
    drift: np.ndarray
    popped: np.ndarray
    runs: list[str] = field(default_factory=list)


def squared_distances(v: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """Exact squared distances (rows by centroids) of whole numbers."""
    out = np.empty((len(v), len(centroids)), dtype=np.int64)
    for c, centroid in enumerate(centroids):
        apart = v - centroid
        out[:, c] = np.einsum("ij,ij->i", apart, apart)
    return out


def nearest(v: np.ndarray, centroids: np.ndarray, drift: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(cluster, expires) of every row: the nearest centroid, of equals the smaller number, and when to look again."""
    d = squared_distances(v, centroids)
    cluster = d.argmin(axis=1)
    at = np.arange(len(v))
    first = np.sqrt(d[at, cluster].astype(float))
    d[at, cluster] = np.iinfo(np.int64).max
    second = np.sqrt(d.min(axis=1).astype(float)) if d.shape[1] > 1 else np.full(len(v), np.inf)
    gap = second - first - SLACK * (second + first) if d.shape[1] > 1 else second
    # a tie expires at the next move, not before it: what lies at the drift counts as popped
    return cluster, np.maximum(gap + drift[cluster], np.nextafter(drift[cluster], np.inf))


def _matrix(column: pa.Array, components: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(-1, components)


def _as_heap(rows: DataFrame, centroids: np.ndarray, drift: np.ndarray) -> DataFrame:
    """Rows (cluster or -1, vec_id, v) measured against all centroids: (cluster, expires, vec_id, v, came_from)."""
    components = centroids.shape[1]

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            v = batch.column(2)
            cluster, expires = nearest(_matrix(v, components), centroids, drift)
            yield pa.RecordBatch.from_arrays(
                [pa.array(cluster, pa.int32()), pa.array(expires), batch.column(1), v, batch.column(0)],
                names=["cluster", "expires", "vec_id", "v", "came_from"],
            )

    return rows.select("cluster", "vec_id", "v").mapInArrow(measure, f"{HEAP}, came_from int")


def _push(rows: DataFrame, heaps: Heaps) -> None:
    """Write measured rows as a run sorted by cluster and expiry, and take the moved ones over in sums and counts."""
    path = scratch_folder(rows.sparkSession, "heap")
    (
        rows.sortWithinPartitions("cluster", "expires").write.option("parquet.block.size", ROW_GROUP_BYTES).parquet(path)
    )
    heaps.runs.append(path)
    clusters, components = heaps.centroids.shape
    moved = rows.sparkSession.read.schema(f"{HEAP}, came_from int").parquet(path).where(F.col("cluster") != F.col("came_from"))

    def changes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            v = np.concatenate([_matrix(batch.column(2), components), np.ones((batch.num_rows, 1), dtype=np.int64)], axis=1)
            total = np.zeros((clusters, components + 1), dtype=np.int64)
            for column, sign in ((0, 1), (1, -1)):
                of = batch.column(column).to_numpy(zero_copy_only=False)
                for c in range(clusters):
                    total[c] += sign * v[of == c].sum(axis=0)
            used = np.flatnonzero(total.any(axis=1))
            yield pa.RecordBatch.from_arrays(
                [pa.array(used, pa.int32()), pa.array(total[used].tolist(), pa.list_(pa.int64()))], names=["cluster", "change"]
            )

    parts = moved.select("cluster", "came_from", "v").mapInArrow(changes, "cluster int, change array<bigint>")
    for row in (
        parts.select("cluster", F.posexplode("change").alias("at", "value"))
        .groupBy("cluster", "at").agg(F.sum(F.col("value").cast("decimal(38,0)")).alias("value")).collect()
    ):
        if row["at"] < components:
            heaps.sums[row["cluster"], row["at"]] += int(row["value"])
        else:
            heaps.counts[row["cluster"]] += int(row["value"])


def _above(level: np.ndarray) -> Column:
    """Entries that lie above their cluster's level. Compared cluster by cluster, so the scan can skip sorted pages."""
    tests = [(F.col("cluster") == c) & (F.col("expires") > float(x)) for c, x in enumerate(level)]
    return _any(tests)


def _between(low: np.ndarray, high: np.ndarray) -> Column:
    tests = [
        (F.col("cluster") == c) & (F.col("expires") > float(a)) & (F.col("expires") <= float(b))
        for c, (a, b) in enumerate(zip(low, high)) if b > a
    ]
    return _any(tests)


def _any(tests: list[Column]) -> Column:
    out = F.lit(False)
    for test in tests:
        out = out | test
    return out


def _entries(spark, heaps: Heaps) -> DataFrame:
    return spark.read.schema(HEAP).parquet(*heaps.runs)


def _move(heaps: Heaps) -> None:
    """New centroids from sums and counts, exactly; the drift takes up how far they moved."""
    before = heaps.centroids.copy()
    for c, n in enumerate(heaps.counts):
        if n:
            heaps.centroids[c] = [int(s) // int(n) for s in heaps.sums[c]]
    apart = heaps.centroids - before
    step = np.sqrt((apart * apart).sum(axis=1).astype(float))
    for c in range(len(step)):
        others = np.delete(step, c).max(initial=0.0)
        heaps.drift[c] += (step[c] + others) * (1 + SLACK)


def cluster_vectors(vectors: DataFrame, clusters: int = CLUSTERS, rounds: int = ROUNDS, components: int = COMPONENTS) -> tuple[DataFrame, np.ndarray]:
    """(rows of vec_id, cluster, distance; final centroids) after ``rounds`` rounds and one more assignment.

    Whole-number k-means as in ``kept_vectors`` and ``first_centroids``: every round gives each vector its nearest centroid (squared
    distance, of equals the smaller number) and moves every centroid that has vectors to the floor of their mean.

    Each cluster's heap is a table sorted by cluster and expiry, written by the tasks that measured the vectors; a task's
    own part of it is a sorted run. A round pops the entries that its drift has reached since the round before: a range of every
    run, which the parquet scan finds by its statistics, so what has not expired is neither read nor measured. Popped vectors are
    measured against all centroids and pushed as new runs; entries above the drift are the ones that hold, so none needs
    to be deleted. Only centroids, sums and counts (clusters times components) come to the driver. Sums change by the
    vectors that moved. A lost executor costs a re-read of written runs.

    Vectors of another length, or with a null or non-finite component, are left out; other columns are not read. Repeated
    rows and null ids are vectors of their own; fewer vectors than ``clusters`` give fewer centroids, none gives no rows.
    Runs jobs when called and leaves its runs in the scratch folder.
    """
    kept = kept_vectors(vectors, components)
    spark = kept.sparkSession
    centroids = first_centroids(kept, clusters)
    if not len(centroids):
        return spark.createDataFrame([], "vec_id bigint, cluster int, distance bigint"), centroids
    k = len(centroids)
    heaps = Heaps(centroids, np.zeros(centroids.shape, dtype=object), np.zeros(k, dtype=object), np.zeros(k), np.full(k, -np.inf))
    _push(_as_heap(kept.select(F.lit(-1).alias("cluster"), "vec_id", "v"), centroids, heaps.drift), heaps)
    for _ in range(rounds):
        _move(heaps)
        expired = _entries(spark, heaps).where(_between(heaps.popped, heaps.drift))
        heaps.popped = heaps.drift.copy()
        _push(_as_heap(expired, heaps.centroids, heaps.drift), heaps)
    last = heaps.centroids

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            of = batch.column(1).to_numpy(zero_copy_only=False)
            apart = _matrix(batch.column(2), components) - last[of]
            distance = np.einsum("ij,ij->i", apart, apart)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(distance)], names=["vec_id", "cluster", "distance"])

    live = _entries(spark, heaps).where(_above(heaps.popped)).select("vec_id", "cluster", "v")
    return live.mapInArrow(measure, "vec_id bigint, cluster int, distance bigint"), last


def with_totals(assigned: DataFrame, centroids: np.ndarray) -> DataFrame:
    """The rows with the distance sums of their cluster and of all clusters, and a digest of their cluster's centroid."""
    spark = assigned.sparkSession
    sums = assigned.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("total"))
    inertia = {r["cluster"]: int(r["total"]) for r in sums.collect()}
    of_cluster = spark.createDataFrame([
        (c, inertia.get(c, 0), sum(inertia.values()), hashlib.sha256(",".join(map(str, centroid.tolist())).encode()).hexdigest())
        for c, centroid in enumerate(centroids)
    ], "cluster int, cluster_inertia bigint, inertia bigint, centroid_sha256 string")
    return assigned.join(F.broadcast(of_cluster), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


@query("op13_centroid_clustering")
def op13_centroid_clustering(spark, sf_dir):
    assigned, centroids = cluster_vectors(table(spark, sf_dir, "embeddings"))
    return with_totals(cut_lineage(assigned, "assigned"), centroids)
