"""Dataset jobs: partition keys, clipping to regions, preparing and enlarging the table."""

from __future__ import annotations

import hashlib
import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plotgrid.functions import geometry as g
from plotgrid.functions import kernels, projections
from plotgrid.functions.geohash import geohash
from plotgrid.operators.conflation import Conflation, cell_of
from plotgrid.operators.shaping import union_by_name, with_missing_columns
from plotgrid.operators.sizes import broadcast_if_small
from plotgrid.operators.zones import ZoneLookup, zone_lookup, zone_pairs
from plotgrid.session import cut_lineage
from plotgrid.sources import layout

PARTITION_PRECISION = 3
OPTIONAL_TIMES = {"feature_update_time": "timestamp", "feature_capture_time": "timestamp"}

# Clones per building for each dataset size, and the jitter in degrees.
CLONES = {"small": 0, "medium": 7, "large": 19}
JITTER = 1e-5


def with_partition_key(df: DataFrame, precision: int = PARTITION_PRECISION) -> DataFrame:
    """Append the geohash of the equal-area centroid."""
    return (
        df.withColumn("_c", g.equal_area_centroid(F.col("geometry")))
        .withColumn("partition_key", geohash(F.col("_c.x"), F.col("_c.y"), precision))
        .drop("_c")
    )


def with_key_and_cell(df: DataFrame) -> DataFrame:
    """``with_partition_key`` and the conflation's ``with_cell``; shapes go to Python once for both."""
    both = df.withColumns({"_e": g.equal_area_centroid(F.col("geometry")), "_c": g.measures(F.col("geometry"))})
    keyed = both.withColumn("partition_key", geohash(F.col("_e.x"), F.col("_e.y"), PARTITION_PRECISION))
    return cell_of(keyed).drop("_e", "_c")


def partitioned(df: DataFrame) -> DataFrame:
    """Rows grouped by partition key. Large keys are spread over several tasks by
    adaptive execution (the exchange has no fixed partition number)."""
    return with_partition_key(df).hint("rebalance", "partition_key").sortWithinPartitions("partition_key")


def clip_to_regions(
    frames: list[DataFrame], zones: DataFrame, key: str = "region", lookup: ZoneLookup | None = None
) -> DataFrame:
    """Union of all rows that share a point with a zone, one copy per zone; optional time
    columns are NULL where a source lacks them."""
    filled = [with_missing_columns(df, OPTIONAL_TIMES) for df in frames]
    rows = union_by_name(filled).drop(key)
    return zone_pairs(rows, zones, key, lookup=lookup).withColumnRenamed("zone", key)


def prepare_dataset(
    fkb: DataFrame, osm: DataFrame, zones: DataFrame, key: str = "region",
    keep: Callable[[DataFrame, str], DataFrame] = cut_lineage,
) -> DataFrame:
    """Clip both sources to all regions at once, key them, and conflate within regions.

    The clipped sources are kept as tables (the raw layer of the dataset) with the cells and shape keys of the
    conflation, which reads them more than once; ``keep`` writes one under a name and reads it again.
    This runs jobs when called.
    """
    lookup = zone_lookup(zones, key)

    def raw(df, name):
        return keep(with_key_and_cell(clip_to_regions([df], zones, key, lookup)), name)

    return Conflation(raw(fkb, "raw-fkb"), raw(osm, "raw-osm"), by=(key,), keyed=True).merged()


def publish_dataset(
    fkb: DataFrame, osm: DataFrame, zones: DataFrame, root: str, release: str, key: str = "region"
) -> DataFrame:
    """The whole dataset job for one release; returns its checked manifest.

    Writes the clipped sources below ``raw``, conflates them, writes the small dataset and lists its
    files. Every step replaces what it wrote before, so a run that is repeated or broken off
    leaves the same files as one run.
    """
    spark = fkb.sparkSession

    def keep(df: DataFrame, name: str) -> DataFrame:
        path = f"{layout.dataset_path(root, release)}/raw/{name}"
        df.write.mode("overwrite").parquet(path)
        return spark.read.schema(df.schema).parquet(path)

    path = layout.write_buildings(prepare_dataset(fkb, osm, zones, key, keep), root, release, "small")
    return layout.validate_paths(layout.asset_manifest(spark, f"{path}/size=small", source="small"))


def rotation_matrix(angle: Column, cx: Column, cy: Column, target_x: Column, target_y: Column) -> dict[str, Column]:
    """Affine terms that turn a shape about (cx, cy) and move that point to the target."""
    cos, sin = F.cos(angle), F.sin(angle)
    return {
        "a": cos, "b": -sin, "d": sin, "e": cos,
        "tx": target_x - (cos * cx - sin * cy), "ty": target_y - (sin * cx + cos * cy),
    }


def _draws(seeds: list[str], copy: int) -> np.ndarray:
    """Five numbers in [0, 1) for each seed and copy, as ``hashing.uniform`` takes them from the text ``seed:copy``."""
    end = f":{copy}"
    digests = b"".join([hashlib.sha256((seed + end).encode()).digest()[:30] for seed in seeds])
    digits = np.frombuffer(digests, np.uint8).reshape(len(seeds), 5, 6).astype(float)
    return digits @ (256.0 ** np.arange(5, -1, -1)) / (1 << 48)


def _moved(base: pa.RecordBatch, spans: list[np.ndarray], copy: int, jitter: float) -> tuple[pa.Array, kernels.Shapes]:
    """The copy of every row's shape, moved into its frame and turned."""
    u0, u1, turn, u3, u4 = _draws(base.column("_seed").to_pylist(), copy).T
    xmin, ymin, xmax, ymax, cx, cy = spans
    to_x = xmin + u0 * (xmax - xmin) + (u3 * 2 - 1) * jitter
    to_y = ymin + u1 * (ymax - ymin) + (u4 * 2 - 1) * jitter
    cos, sin = np.cos(turn * (2 * math.pi)), np.sin(turn * (2 * math.pi))
    tx, ty = to_x - (cos * cx - sin * cy), to_y - (sin * cx + cos * cy)
    shapes = kernels.Shapes(base.column("geometry"))
    g_of, x, y = shapes.point_geom, shapes.x, shapes.y
    moved = kernels.renest(
        base.column("geometry"), cos[g_of] * x - sin[g_of] * y + tx[g_of], sin[g_of] * x + cos[g_of] * y + ty[g_of]
    )
    return moved, kernels.Shapes(moved)


def _with_copies(names: list[str], key: str, clones: int, jitter: float):
    """Batches of valid rows, then of their valid copies one number after the other; so a batch never holds more rows than came."""
    frame = ("xmin", "ymin", "xmax", "ymax")

    def stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            shapes = kernels.Shapes(batch.column("geometry"))
            ok = kernels.valid(shapes)
            center = kernels.measures(shapes)
            keep = pa.array(ok)
            own = batch.filter(keep)
            types = {n: own.schema.field(n).type for n in names}
            point = pa.struct([("x", pa.float64()), ("y", pa.float64())])
            out = pa.schema([*[(n, types[n]) for n in names], ("_c", point), ("_own", pa.bool_())])
            yield pa.RecordBatch.from_arrays(
                [*[own.column(n) for n in names], pa.nulls(len(own), point), pa.array(np.ones(len(own), bool))], schema=out
            )
            known = ok & batch.column("_box").is_valid().to_numpy(zero_copy_only=False)
            if not known.any():
                continue
            base = batch.filter(pa.array(known))
            spans = [pc.struct_field(base.column("_box"), c).to_numpy(zero_copy_only=False) for c in frame]
            spans += [center["cx"][known], center["cy"][known]]
            for copy in range(1, clones + 1):
                moved, placed = _moved(base, spans, copy, jitter)
                good = kernels.valid(placed)
                middle = kernels.equal_area_centers(kernels.Shapes(moved, projections.laea_forward), projections.laea_inverse)
                made = {
                    key: base.column(key), "geometry": moved,
                    "bbox": pa.StructArray.from_arrays(kernels.shell_bounds(placed), names=list(frame)),
                }
                columns = [made[n].cast(types[n]) if n in made else pa.nulls(len(base), types[n]) for n in names]
                columns += [pa.StructArray.from_arrays([pa.array(v) for v in middle], names=["x", "y"]), pa.array(np.zeros(len(base), bool))]
                yield pa.RecordBatch.from_arrays(columns, schema=out).filter(pa.array(good))

    return stream


def synthesize(df: DataFrame, zones: DataFrame, size: str, key: str = "region", jitter: float = JITTER) -> DataFrame:
    """Enlarge a building table with moved and turned copies of its valid rows.

    Every copy lands uniformly inside its region's bounds with a random turn. The numbers
    come from a digest of (region, id or else shape, copy), so a retried task builds the same copy,
    and rows without an id or listed in two regions draw apart. Copies keep
    only region, geometry and partition key. A row goes to Python once and its copies come back in streamed
    batches, so neither waits in a task, however many copies there are.
    """
    clones = CLONES[size]
    if clones == 0:
        raise ValueError("the small size is the source itself and has no clones")
    b = g.bounds(F.col("geometry"))
    box = F.struct(*[f(b[c]).alias(c) for c, f in (("xmin", F.min), ("ymin", F.min), ("xmax", F.max), ("ymax", F.max))])
    frames = zones.groupBy(key).agg(box.alias("_box"))
    made = ("geometry", "bbox", "partition_key")
    rows = df if "partition_key" in df.columns else df.withColumn("partition_key", F.lit(None).cast("string"))
    rows = rows.select(*[c for c in df.columns if c not in made], *made)
    # rows of no known region have no copies
    seed = F.concat_ws(":", key, F.coalesce("external_id", F.xxhash64("geometry").cast("string")))
    seeded = rows.join(broadcast_if_small(frames), key, "left").withColumn("_seed", seed).select(*rows.columns, "_box", "_seed")
    schema = T.StructType([
        *[T.StructField(f.name, f.dataType) for f in rows.schema.fields],
        *T.StructType.fromDDL("_c struct<x:double,y:double>, _own boolean").fields,
    ])
    stacked = seeded.mapInArrow(_with_copies(rows.columns, key, clones, jitter), schema)
    drawn = geohash(F.col("_c.x"), F.col("_c.y"), PARTITION_PRECISION)
    return stacked.withColumn("partition_key", F.when(F.col("_own"), F.col("partition_key")).otherwise(drawn)).drop("_c", "_own")
