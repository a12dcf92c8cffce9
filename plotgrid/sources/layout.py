"""Reading and writing the building dataset: hive layout, WKB columns, file listings.

Layout: ``{root}/release/{release}/size={size}/theme={theme}/region={region}/*.parquet``
with a WKB ``geometry`` column and a covering ``bbox`` struct.
"""

from __future__ import annotations

import json

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plotgrid.functions import geometry as g
from plotgrid.functions.curves import position_key

# Row group and batch sizes of the published layout.
ROW_GROUP_ROWS = 100_000
BATCH_ROWS = 250_000
MEDIA_TYPE = "application/vnd.apache.parquet"
# Name of the sort column, which is not written.
PLACE = "_place"


def dataset_path(root: str, release: str, size: str | None = None, **parts: str) -> str:
    segments = [f"{root.rstrip('/')}/release/{release}"]
    if size is not None:
        segments.append(f"size={size}")
    return "/".join(segments + [f"{k}={v}" for k, v in parts.items()])


def scan_buildings(
    spark: SparkSession, root: str, release: str, size: str, region: str = "*", theme: str = "buildings",
    schema: str | T.StructType | None = None,
) -> DataFrame:
    """Buildings of one release and size; ``size``, ``theme`` and ``region`` come from the
    path, so a region filter prunes folders and files are merged by column name.

    With a ``schema`` (of the file columns, absent ones are NULL) no file is opened before the scan; without one all footers
    are read to merge them.
    """
    base = dataset_path(root, release)
    reader = spark.read.option("basePath", base)
    if schema is None:
        reader = reader.option("mergeSchema", "true")
    else:
        declared = T.StructType.fromDDL(schema) if isinstance(schema, str) else schema
        known = {f.name for f in declared}
        parts = [T.StructField(c, T.StringType()) for c in ("size", "theme", "region") if c not in known]
        reader = reader.schema(T.StructType([*declared.fields, *parts]))
    df = (
        reader.parquet(f"{base}/size={size}/theme={theme}")
        .withColumn("region", F.lpad(F.col("region").cast("string"), 2, "0"))
    )
    return df if region == "*" else df.filter(F.col("region") == region)


def scan_union(spark: SparkSession, *paths: str) -> DataFrame:
    """Read files whose columns differ; absent columns are NULL."""
    return spark.read.option("mergeSchema", "true").parquet(*paths)


def scan_or_empty(spark: SparkSession, path: str, schema: str | T.StructType) -> DataFrame:
    """Read a folder with a declared schema; a missing folder gives no rows."""
    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)


def read_contribution(spark: SparkSession, path: str) -> DataFrame:
    """A contributed table with WKB geometry, decoded and boxed."""
    return decoded(spark.read.parquet(path))


def decoded(df: DataFrame, column: str = "geometry") -> DataFrame:
    """WKB column to nested rings plus box; rows without a readable area are dropped
    (see ``undecodable`` for them)."""
    nested = df.withColumn(column, g.from_wkb(F.col(column))).filter(F.col(column).isNotNull())
    return nested if "bbox" in df.columns else nested.withColumn("bbox", g.bounds(F.col(column)))


def undecodable(df: DataFrame, column: str = "geometry") -> DataFrame:
    """Rows whose WKB holds no readable area, as they came."""
    return df.withColumn("_g", g.from_wkb(F.col(column))).filter(F.col("_g").isNull()).drop("_g")


def encoded(df: DataFrame, column: str = "geometry") -> DataFrame:
    """Nested rings to WKB, with the covering box kept or added."""
    boxed = df if "bbox" in df.columns else df.withColumn("bbox", g.bounds(F.col(column)))
    return boxed.withColumn(column, g.to_wkb(F.col(column)))


def write_buildings(
    df: DataFrame, root: str, release: str, size: str, theme: str = "buildings", max_file_rows: int = 2_000_000,
    row_group_rows: int = ROW_GROUP_ROWS,
) -> str:
    """Write one release: rows clustered by region and place, WKB and box columns,
    snappy, row groups of 100,000 rows; regions without rows write nothing. A region that is
    written again replaces its files, other regions and sizes stay.

    Rows are dealt by ranges of region and Hilbert key and sorted by them, so a file holds one stretch of the
    curve, its row groups have tight boxes, and a frame meets few of both. A hot region is cut
    into several ranges. Dealing samples the rows once more before they are written.
    """
    path = dataset_path(root, release)
    rows = encoded(df.drop("size", "theme")).withColumn(PLACE, position_key(F.col("bbox")))
    (
        rows.repartitionByRange("region", PLACE)
        # the writer keeps this order, since it begins with the one folder column
        .sortWithinPartitions("region", PLACE).drop(PLACE)
        .write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("region")
        .option("compression", "snappy")
        .option("maxRecordsPerFile", max_file_rows)
        .option("parquet.block.row.count.limit", row_group_rows)
        .parquet(dataset_path(root, release, size, theme=theme))
    )
    note = {
        "version": "1.1.0", "primary_column": "geometry",
        "columns": {"geometry": {
            "encoding": "WKB", "geometry_types": ["Polygon", "MultiPolygon"], "crs": "EPSG:4326",
            "covering": {"bbox": {c: ["bbox", c] for c in ("xmin", "ymin", "xmax", "ymax")}},
        }},
    }
    # The writer cannot set the parquet footer key, so the note lies beside the files.
    df.sparkSession.range(1).select(F.lit(json.dumps(note))).coalesce(1).write.mode("overwrite").text(f"{path}/_geo")
    return path


def seed_table(df: DataFrame, name: str) -> bool:
    """Replace a catalog table by the rows of ``df``; an empty frame leaves it alone."""
    if df.isEmpty():
        return False
    flat = encoded(df.drop("size", "theme"))
    flat.hint("rebalance").write.mode("overwrite").saveAsTable(name)
    return True


def seed_by_cell(df: DataFrame, name: str, buckets: int, cell: tuple[str, ...] = ("grid_x", "grid_y")) -> bool:
    """As ``seed_table``, stored in buckets of the ``cell`` columns and sorted by them, which is what a spatial index does for
    joins on the cell: two tables of equal buckets join without moving a row. Geometry stays nested."""
    if df.isEmpty():
        return False
    rows = df.drop("size", "theme").repartition(buckets, *cell)  # one file for each bucket
    rows.write.mode("overwrite").bucketBy(buckets, *cell).sortBy(*cell).saveAsTable(name)
    return True


def county_table(counties: DataFrame) -> DataFrame:
    """County registry rows as the join table: name and geometry."""
    return counties.select(F.col("region").alias("county_name"), F.col("wkb").alias("geometry"))


def geojson(geometry: Column) -> Column:
    """Geometry as a GeoJSON struct (always MultiPolygon coordinates)."""
    pairs = F.transform(geometry, lambda part: F.transform(part, lambda ring: F.transform(
        ring, lambda p: F.array(p["x"], p["y"])
    )))
    return F.struct(F.lit("MultiPolygon").alias("type"), pairs.alias("coordinates"))


def geojson_lines(df: DataFrame) -> DataFrame:
    """One GeoJSON feature per row, bounds flattened into the properties."""
    from plotgrid.operators.shaping import flatten_bounds

    flat = flatten_bounds(df)
    properties = F.struct(*[F.col(c) for c in flat.columns if c != "geometry"])
    feature = F.struct(
        F.lit("Feature").alias("type"), properties.alias("properties"), geojson(F.col("geometry")).alias("geometry")
    )
    return flat.select(F.to_json(feature).alias("value"))


def export_geojsonl(df: DataFrame, path: str) -> None:
    geojson_lines(df).write.mode("overwrite").text(path)


def file_listing(spark: SparkSession, path: str) -> DataFrame:
    """Parquet files below a folder with their size; file contents are never read."""
    return (
        spark.read.format("binaryFile").option("recursiveFileLookup", "true")
        .option("pathGlobFilter", "*.parquet").load(path).select("path", "length")
    )


def blob_summary(spark: SparkSession, path: str) -> DataFrame:
    return file_listing(spark, path).agg(
        F.count("*").alias("file_count"), F.coalesce(F.sum("length"), F.lit(0)).alias("total_bytes")
    )


def asset_manifest(spark: SparkSession, path: str, source: str = "") -> DataFrame:
    """One row per data file: release, theme, region, source, file, role, media type."""
    files = file_listing(spark, path)

    def part(pattern):
        return F.regexp_extract("path", pattern, 1)

    named = files.select(
        part(r"release/([^/]+)/").alias("release"), part(r"theme=([^/]+)/").alias("theme"),
        F.lpad(part(r"region=([^/]+)/"), 2, "0").alias("region"),
        F.coalesce(F.nullif(part(r"(?:source|dataset)=([^/]+)/"), F.lit("")), F.lit(source)).alias("source"),
        F.element_at(F.split("path", "/"), -1).alias("file_name"), F.col("path").alias("href"),
        F.lit("data").alias("role"), F.lit(MEDIA_TYPE).alias("media_type"), F.col("length").alias("bytes"),
    )
    return named.withColumn("item_id", F.concat(F.lit("region-"), "region", F.lit("-"), "source"))


def path_problem(release: Column, region: Column, file_name: Column) -> Column:
    """Why a dataset path is not acceptable, or NULL when it is. Files are named by number,
    as plain ``part_00000.parquet`` or as Spark's writer names them."""
    # The layout's name patterns.
    day = F.regexp_extract(release, r"^(.*)\.([^.]*)$", 1)
    version = F.regexp_extract(release, r"^(.*)\.([^.]*)$", 2)
    return (
        F.when(~release.contains("."), "release form")
        .when(~day.rlike(r"^\d{4}-\d{1,2}-\d{1,2}$") | day.try_cast("date").isNull(), "release date")
        .when(~version.rlike(r"^\d+$"), "release version")
        .when(~((region == "*") | region.rlike(r"^\d{2}$")), "region")
        .when(~((file_name == "*.parquet") | file_name.rlike(r"^part_\d{5,}\.parquet$|^part-\d{5,}-[0-9a-z.-]+\.parquet$")), "file name")
    )


def validate_paths(manifest: DataFrame) -> DataFrame:
    """Append ``problem``: NULL for rows with an acceptable release, region and file."""
    return manifest.withColumn("problem", path_problem(F.col("release"), F.col("region"), F.col("file_name")))


def _same_form(href: Column) -> Column:
    """A file address with one slash after its scheme, as not all sources write it alike."""
    return F.regexp_replace(href, "^([A-Za-z0-9]+):/+", "$1:/")


def file_extents(spark: SparkSession, path: str, time_column: str | None = None) -> DataFrame:
    """(href, rows, bbox, first_time, last_time) of every data file with rows, from one pass over box and time columns."""
    columns = "bbox struct<xmin:double,ymin:double,xmax:double,ymax:double>"
    if time_column is not None:
        columns += f", `{time_column}` timestamp"
    files = spark.read.schema(columns).parquet(path)
    time = F.col(time_column) if time_column is not None else F.lit(None).cast("timestamp")
    box = F.struct(*[f(f"bbox.{c}").alias(c) for c, f in (("xmin", F.min), ("ymin", F.min), ("xmax", F.max), ("ymax", F.max))])
    return files.groupBy(_same_form(F.col("_metadata.file_path")).alias("href")).agg(
        F.count("*").alias("rows"), box.alias("bbox"), F.min(time).alias("first_time"), F.max(time).alias("last_time")
    )


def manifest_with_extents(spark: SparkSession, path: str, source: str = "", time_column: str | None = None) -> DataFrame:
    """``asset_manifest`` with the rows, box and times of every file; 0 rows and NULLs for an empty one."""
    files = asset_manifest(spark, path, source).withColumn("href", _same_form(F.col("href")))
    return files.join(file_extents(spark, path, time_column), "href", "left").na.fill(0, ["rows"])


def item_extents(manifest: DataFrame) -> DataFrame:
    """One row per catalog item: its files, rows, bytes, box and times."""
    box = F.struct(*[f(f"bbox.{c}").alias(c) for c, f in (("xmin", F.min), ("ymin", F.min), ("xmax", F.max), ("ymax", F.max))])
    return manifest.groupBy("item_id", "release", "theme", "region", "source").agg(
        F.count("*").alias("files"), F.sum("rows").alias("rows"), F.sum("bytes").alias("bytes"), box.alias("bbox"),
        F.min("first_time").alias("first_time"), F.max("last_time").alias("last_time"),
    )


def scan_by_extent(
    spark: SparkSession, manifest: DataFrame, base: str, schema: str,
    frame: tuple[float, float, float, float] | None = None, since: Column | None = None, until: Column | None = None,
) -> DataFrame:
    """The files of a manifest whose box meets a frame and whose times meet a span, as one scan.

    Other files are neither listed nor opened; rows are not filtered. Only the addresses of the chosen files come to the driver, as
    the reader takes them. ``base`` is the release folder, so size, theme and region come from the path.
    """
    wanted = manifest.filter(F.col("rows") > 0)
    if frame is not None:
        xmin, ymin, xmax, ymax = (float(v) for v in frame)
        wanted = wanted.filter(
            (F.col("bbox.xmin") <= xmax) & (F.col("bbox.xmax") >= xmin) & (F.col("bbox.ymin") <= ymax) & (F.col("bbox.ymax") >= ymin)
        )
    if since is not None:
        wanted = wanted.filter(F.col("last_time") >= since)
    if until is not None:
        wanted = wanted.filter(F.col("first_time") <= until)
    chosen = sorted(r["href"] for r in wanted.select("href").collect())
    parts = "size string, theme string, region string"
    if not chosen:
        return spark.createDataFrame([], f"{schema}, {parts}")
    return spark.read.schema(f"{schema}, {parts}").option("basePath", base).parquet(*chosen)
