"""Readers and writers of the lake: typed ingestion, provenance, geometry, catalog, inventory."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kerbline.functions import planar as P

POSITION_SCHEMA = T.StructType([
    T.StructField("feed", T.StringType()), T.StructField("poll_ts", T.LongType()), T.StructField("header_ts", T.LongType()),
    T.StructField("vehicle_id", T.StringType()), T.StructField("trip_id", T.StringType()), T.StructField("route_id", T.StringType()),
    T.StructField("direction_id", T.LongType()), T.StructField("lat", T.DoubleType()), T.StructField("lon", T.DoubleType()),
    T.StructField("bearing", T.DoubleType()), T.StructField("speed", T.DoubleType()), T.StructField("timestamp", T.LongType()),
    T.StructField("stop_id", T.StringType()), T.StructField("current_stop_seq", T.LongType()), T.StructField("current_status", T.LongType()),
    T.StructField("occupancy_status", T.LongType()), T.StructField("date", T.DateType()), T.StructField("hour", T.StringType()),
])

ALERT_SCHEMA = T.StructType([
    T.StructField("feed", T.StringType()), T.StructField("poll_ts", T.LongType()), T.StructField("header_ts", T.LongType()),
    T.StructField("alert_id", T.StringType()), T.StructField("cause", T.IntegerType()), T.StructField("effect", T.IntegerType()),
    T.StructField("header_text", T.ArrayType(T.StringType())), T.StructField("description_text", T.ArrayType(T.StringType())),
    T.StructField("active_period", T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType())]))),
    T.StructField("informed_entity", T.ArrayType(T.StructType([
        T.StructField("agency_id", T.StringType()), T.StructField("route_id", T.StringType()), T.StructField("route_type", T.IntegerType()),
        T.StructField("stop_id", T.StringType()), T.StructField("trip_id", T.StringType())]))),
])


# ------------------------------------------------------------------ names and provenance
def with_provenance(df: DataFrame, meta: Mapping[str, str]) -> DataFrame:
    """Source id, retrieval time and vintage on every row; the id ends before ' / '."""
    source = meta.get("data_id") or meta.get("dataset_id") or meta.get("dataset_id_or_url") or ""
    vintage = meta.get("vintage") or meta.get("time_coverage") or ""
    return df.withColumns({
        "source_dataset_id": F.lit(source.split(" / ")[0].strip()), "retrieved_at": F.lit(str(meta.get("retrieved_at", ""))), "vintage": F.lit(str(vintage))})


def with_geoid(df: DataFrame) -> DataFrame:
    """Block key (state, county, tract, block) and its block-group prefix."""
    return df.withColumns({"geoid15": F.concat("state", "county", "tract", "block"), "geoid12": F.concat("state", "county", "tract", F.substring("block", 1, 1))})


# ------------------------------------------------------------------ ingestion
def read_csv(spark: SparkSession, path: str | list[str], schema: T.StructType | str) -> DataFrame:
    """CSV with a header and a fixed schema, from one source or several; nothing is inferred."""
    return spark.read.schema(schema).option("header", "true").option("timestampFormat", "yyyy-MM-dd HH:mm:ss").csv(path)


def ingest_csv(spark: SparkSession, path: str | list[str], schema, extra: Mapping[str, Column], meta: Mapping[str, str]) -> DataFrame:
    return with_provenance(read_csv(spark, path, schema).withColumns(dict(extra)), meta)


def ingest_partitioned(spark: SparkSession, sources: Sequence[tuple[str, Mapping[str, str]]], schema, year: Column, out: str, only_year: int | None = None) -> DataFrame:
    """Write several CSV sources into one table partitioned by year; a source's own ``year`` column is replaced.

    Rows are rebalanced by year before writing: a year becomes files of the advisory size, however its rows are spread
    over the sources, and a large year is split over as many tasks as it needs.  The years written replace what the
    table had of them, so a rerun changes nothing; other years stay.
    """
    parts = []
    for path, meta in sources:
        df = read_csv(spark, path, schema)
        df = df.withColumn("__y", year.cast("int")).drop("year").withColumnRenamed("__y", "year")
        parts.append(with_provenance(df if only_year is None else df.where(F.col("year") == only_year), meta))
    both = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)
    written = both.hint("rebalance", "year").write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
    written.partitionBy("year").option("compression", "zstd").parquet(out)
    return spark.read.parquet(out)


def ingest_parts(parts: Sequence[tuple[str, DataFrame]], label: str = "part") -> DataFrame:
    """Files of one dataset united by column name, with the part's label."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), [df.withColumn(label, F.lit(name)) for name, df in parts])


def gtfs_union(feeds: Mapping[str, DataFrame | None]) -> DataFrame:
    """One schedule file across feeds as text columns; feeds without the file are skipped."""
    present = [(name, df.select(*[F.col(c).cast("string").alias(c) for c in df.columns])) for name, df in feeds.items() if df is not None]
    return ingest_parts(present, "feed")


#: Coordinate systems that are planar feet already; all others are taken as degrees and projected.
FEET = ("EPSG:2263",)


def project_ring(ring: Column) -> Column:
    return F.transform(ring, lambda p: P.to_feet(p.x, p.y))


def with_geometry(df: DataFrame, parts: Column, crs: str) -> DataFrame:
    """Source and planar geometry of each row.

    ``parts_source`` and ``parts`` hold every part of a geometry as its own array of rings (a polygon's outline and holes, one
    line, or one point); ``rings_source`` and ``rings`` are those of geometries of one part, NULL for several.
    """
    rings = lambda c: F.when(F.size(c) == 1, F.get(F.col(c), 0))
    df = df.withColumn("parts_source", parts)
    plane = F.col("parts_source") if crs in FEET else F.transform("parts_source", lambda part: F.transform(part, project_ring))
    df = df.withColumns({"parts": plane, "geometry_crs": F.lit(crs)})
    return df.withColumns({"rings_source": rings("parts_source"), "rings": rings("parts")})


def ingest_geojson(spark: SparkSession, path: str, props: T.StructType, crs: str = "EPSG:4326", multiline: bool = False) -> DataFrame:
    """GeoJSON features of any geometry type but collections: properties, geometry_type and the columns of :func:`with_geometry`.

    A file holds a collection per line, or one printed over several lines (``multiline``).  Features without geometry are dropped.
    """
    schema = T.StructType([T.StructField("features", T.ArrayType(T.StructType([
        T.StructField("properties", props), T.StructField("geometry", T.StructType([T.StructField("type", T.StringType()), T.StructField("coordinates", T.StringType())]))])))])
    f = spark.read.schema(schema).option("multiLine", multiline).json(path).select(F.explode("features").alias("f"))
    f = f.select("f.properties.*", F.col("f.geometry.type").alias("geometry_type"), F.col("f.geometry.coordinates").alias("__c"))

    def read(depth: int) -> Column:
        return F.from_json("__c", T.ArrayType(T.DoubleType()) if depth == 1 else "array<" * depth + "double" + ">" * depth)

    point = lambda p: P.point(F.get(p, 0), F.get(p, 1))
    line = lambda r: F.transform(r, point)
    shapes = {
        "Point": F.array(F.array(F.array(point(read(1))))),
        "MultiPoint": F.transform(read(2), lambda p: F.array(F.array(point(p)))),
        "LineString": F.array(F.array(line(read(2)))),
        "MultiLineString": F.transform(read(3), lambda r: F.array(line(r))),
        "Polygon": F.array(F.transform(read(3), line)),
        "MultiPolygon": F.transform(read(4), lambda part: F.transform(part, line)),
    }
    parts = F.coalesce(*[F.when(F.col("geometry_type") == kind, shape) for kind, shape in shapes.items()])
    f = f.where(F.col("__c").isNotNull() & ~F.regexp_replace("__c", r"\s", "").isin("[]", "null"))
    return with_geometry(f, parts, crs).drop("__c")


def ingest_wkt(df: DataFrame, col: str, crs: str = "EPSG:4326") -> DataFrame:
    """Geometry text to the columns of :func:`with_geometry`; rows without geometry are dropped."""
    text = F.trim(col)
    ok = F.col(col).isNotNull() & (text != "") & ~F.upper(text).contains("EMPTY")
    return with_geometry(df.where(ok), P.parse_wkt_parts(F.trim(col)), crs).drop(col)


def ingest_points(df: DataFrame, lat: str, lon: str, crs: str = "EPSG:4326") -> DataFrame:
    """Planar point of each row; missing or unreadable coordinates give none.  In a system of feet ``lon`` is x and ``lat`` is y."""
    la, lo = F.col(lat).try_cast("double"), F.col(lon).try_cast("double")
    both = la.isNotNull() & lo.isNotNull()
    return df.withColumns({"point": F.when(both, P.point(lo, la) if crs in FEET else P.to_feet(lo, la)), "geometry_crs": F.when(both, crs)})


def ingest_gbfs(df: DataFrame, array: str) -> DataFrame:
    """Station feed: one row per station, nested columns as JSON text."""
    s = df.select(F.explode(array).alias("s")).select("s.*")
    nested = (T.ArrayType, T.StructType, T.MapType)
    return s.select(*[F.to_json(f.name).alias(f.name) if isinstance(f.dataType, nested) else F.col(f.name) for f in s.schema.fields])


def canonical_positions(feeds: Sequence[DataFrame]) -> DataFrame:
    """Positions of all feed families under one fixed schema; unknown columns are dropped, missing ones NULL."""
    def cast(df: DataFrame) -> DataFrame:
        return df.select(*[(F.col(f.name) if f.name in df.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in POSITION_SCHEMA.fields])

    return reduce(lambda a, b: a.unionByName(b), [cast(df) for df in feeds])


def read_alerts(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(ALERT_SCHEMA).json(path)


def category_view(df: DataFrame, col: str, values: Sequence[str]) -> DataFrame:
    return df.where(F.col(col).isin(*values))


def archive_sink(df: DataFrame, path: str, ts: str = "poll_ts") -> None:
    """Append snapshots under date= and hour=."""
    at = F.timestamp_seconds(ts)
    df.withColumns({"date": F.date_format(at, "yyyy-MM-dd"), "hour": F.date_format(at, "HH")}).write.mode("append").partitionBy("date", "hour").parquet(path)


# ------------------------------------------------------------------ catalog, inventory, increments
def register_catalog(spark: SparkSession, tables: Mapping[str, tuple[str, str]]) -> DataFrame:
    """Register name -> (kind, path) as views; one row per table with its row count."""
    metas = []
    for name, (kind, path) in tables.items():
        df = spark.read.parquet(path)
        df.createOrReplaceTempView(name)
        metas.append(df.agg(F.count(F.lit(1)).alias("rows")).select(F.lit(name).alias("name"), F.lit(kind).alias("kind"), F.lit(path).alias("source"), "rows"))
    return reduce(lambda a, b: a.unionByName(b), metas)


def file_listing(spark: SparkSession, path: str) -> DataFrame:
    """Size and modification time of each data file, from scan metadata; no file content is read."""
    m = spark.read.parquet(path).select("_metadata.file_path", "_metadata.file_size", "_metadata.file_modification_time")
    return m.groupBy("file_path", "file_size", "file_modification_time").agg(F.count(F.lit(1)).alias("rows"))


def lake_inventory(spark: SparkSession, tables: Mapping[str, str]) -> DataFrame:
    """Rows, files and bytes per table."""
    parts = [file_listing(spark, path).agg(F.sum("rows").alias("rows"), F.count(F.lit(1)).alias("files"), F.sum("file_size").alias("bytes")).withColumn("name", F.lit(name)) for name, path in tables.items()]
    return reduce(lambda a, b: a.unionByName(b), parts)


def day_files(spark: SparkSession, path: str, day: str = "date") -> DataFrame:
    """Day and time of change of each data file of an archive partitioned by ``day``; files are listed, not opened."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.parquet").load(path)
    return files.select(F.col(day).alias("day"), F.col("modificationTime").alias("mtime"))


def day_signatures(files: DataFrame) -> DataFrame:
    """File count and newest change of each day: what a run records of the days it has seen."""
    return files.groupBy("day").agg(F.count(F.lit(1)).alias("n_files"), F.max("mtime").alias("max_mtime"))


def changed_days(files: DataFrame, state: DataFrame) -> DataFrame:
    """Days whose signature (file count, newest change) differs from the recorded one.

    ``files``: day, mtime.  ``state``: day, n_files, max_mtime.
    """
    sig = day_signatures(files)
    return sig.join(state, ["day", "n_files", "max_mtime"], "left_anti")


def content_hash(df: DataFrame, keys: Sequence[str], cols: Sequence[str]) -> DataFrame:
    """Order-free hash of the rows of each snapshot: sums of the four parts of a row's SHA-256.

    Sums merge in any order, so no snapshot is sorted or gathered.
    """
    fields = [F.coalesce(F.concat(F.lit("="), F.col(c).cast("string")), F.lit("")) for c in cols]
    row = F.sha2(F.concat_ws("\u001f", *fields), 256)
    part = [F.conv(F.substring(row, 1 + 12 * i, 12), 16, 10).cast("decimal(38,0)") for i in range(4)]
    g = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("rows"), *[F.sum(p).alias(f"p{i}") for i, p in enumerate(part)])
    return g.select(*keys, "rows", F.sha2(F.concat_ws("-", "rows", "p0", "p1", "p2", "p3"), 256).alias("content_hash"))


def dedupe_snapshots(hashes: DataFrame, feed: str = "feed", ts: str = "ts") -> DataFrame:
    """Snapshots whose content differs from the one before it; one row per snapshot."""
    from pyspark.sql import Window as W

    before = F.lag("content_hash").over(W.partitionBy(feed).orderBy(ts))
    return hashes.withColumn("__b", before).where(F.col("__b").isNull() | (F.col("__b") != F.col("content_hash"))).drop("__b")


# ------------------------------------------------------------------ health report and export
def write_counted(df: DataFrame, path: str) -> int:
    """Write a table and return its row count, observed while it was written: no second pass."""
    seen = Observation()
    df.observe(seen, F.count(F.lit(1)).alias("rows")).write.mode("overwrite").parquet(path)
    return seen.get.get("rows", 0)


def row_counts(spark: SparkSession, tables: Mapping[str, str], recorded: Mapping[str, tuple[bool, int]]) -> DataFrame:
    """Rows that tables (name -> path) hold now beside those recorded at writing (name -> exact, rows); NULL where nothing was."""
    notes = spark.createDataFrame([(n, *recorded.get(n, (False, None))) for n in tables], "name string, exact boolean, expected long")
    held = [spark.read.parquet(path).agg(F.lit(n).alias("name"), F.count(F.lit(1)).alias("actual")) for n, path in tables.items()]
    return notes.join(reduce(lambda a, b: a.unionByName(b), held), "name")


def crs_counts(layers: Mapping[str, DataFrame], crs: str = "geometry_crs") -> DataFrame:
    """Number of coordinate systems found in each geometry table."""
    return reduce(lambda a, b: a.unionByName(b), [df.agg(F.lit(n).alias("name"), F.count_distinct(crs).alias("n_crs")) for n, df in layers.items()])


def doctor(counts: DataFrame, crs: DataFrame, coverage: DataFrame, validity: DataFrame) -> DataFrame:
    """One row per check with PASS, FAIL or INFO.

    ``counts``: name, exact, expected, actual.  ``crs``: name, n_crs.  ``coverage``: name, rows, matched.
    ``validity``: name, sampled, invalid.
    """
    delta = F.col("expected") - F.col("actual")
    tol = F.greatest(F.lit(10), F.floor(F.col("expected") * 0.0005))
    near = delta.between(0, tol) | (F.abs(delta) <= 2)
    ok = F.when(F.col("exact"), delta == 0).otherwise(near)
    verdict = lambda c: F.when(c, "PASS").otherwise("FAIL")
    a = counts.select(F.lit("ROWCOUNTS").alias("check"), "name", F.when(F.col("expected").isNull(), "INFO").otherwise(verdict(ok)).alias("status"), F.col("actual").cast("double").alias("value"))
    v = counts.select(F.lit("VIEWS").alias("check"), "name", verdict(F.col("actual") > 0).alias("status"), F.col("actual").cast("double").alias("value"))
    b = crs.select(F.lit("CRS").alias("check"), "name", verdict(F.col("n_crs") == 1).alias("status"), F.col("n_crs").cast("double").alias("value"))
    pct = 100.0 * F.col("matched") / F.nullif(F.col("rows"), F.lit(0))
    c = coverage.select(F.lit("GEOID_JOIN").alias("check"), "name", verdict(F.coalesce(pct, F.lit(0.0)) >= 99.0).alias("status"), F.round(pct, 2).alias("value"))
    bad = F.coalesce(F.col("invalid") / F.nullif(F.col("sampled"), F.lit(0)), F.lit(0.0))
    d = validity.select(F.lit("GEOMVALID").alias("check"), "name", verdict(bad <= 0.05).alias("status"), F.round(bad, 4).alias("value"))
    return a.unionByName(v).unionByName(b).unionByName(c).unionByName(d)


def export_layer(df: DataFrame, props: Sequence[str], digits: int = 5) -> DataFrame:
    """One GeoJSON feature per row (polygon rings in degrees), coordinates shortened."""
    coords = F.transform("rings", lambda r: F.transform(r, lambda p: F.array(F.round(p.x, digits), F.round(p.y, digits))))
    geometry = F.struct(F.lit("Polygon").alias("type"), coords.alias("coordinates"))
    return df.select(F.to_json(F.struct(F.lit("Feature").alias("type"), F.struct(*props).alias("properties"), geometry.alias("geometry"))).alias("feature"))
