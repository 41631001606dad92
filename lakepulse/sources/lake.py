"""Typed readers over the lake, and ways to address its partitions."""

from __future__ import annotations

from datetime import date, timedelta

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lakepulse.sources import schemas


def read_json(spark: SparkSession, path: str | list[str], schema: str, base_path: str | None = None) -> DataFrame:
    """JSON lines under a declared schema; a line that does not parse keeps its text in ``_corrupt_record``."""
    reader = (
        spark.read.schema(f"{schema}, {schemas.CORRUPT} string")
        .option("mode", "PERMISSIVE")
        .option("columnNameOfCorruptRecord", schemas.CORRUPT)
    )
    if base_path:
        reader = reader.option("basePath", base_path)
    return reader.json(path)


def read_batches(spark: SparkSession, path, base_path: str | None = None) -> DataFrame:
    return read_json(spark, path, schemas.BATCHES, base_path)


def read_user_behavior(spark: SparkSession, path, base_path: str | None = None) -> DataFrame:
    return read_json(spark, path, schemas.BEHAVIOR, base_path)


def read_feedback(spark: SparkSession, path, base_path: str | None = None) -> DataFrame:
    return read_json(spark, path, schemas.FEEDBACK, base_path)


def read_transactions(spark: SparkSession, path, base_path: str | None = None) -> DataFrame:
    return read_json(spark, path, schemas.TRANSACTIONS, base_path)


def read_raw_events(spark: SparkSession, path, base_path: str | None = None) -> DataFrame:
    return read_json(spark, path, schemas.RAW_EVENTS, base_path)


def read_metrics_csv(spark: SparkSession, path) -> DataFrame:
    """CSV metrics; ``tags`` holds ``k=v`` pairs separated by commas."""
    rows = spark.read.schema(schemas.METRICS).option("header", True).csv(path)
    return rows.withColumn("tags", F.str_to_map("tags", F.lit(","), F.lit("=")))


def count_by_type(raw: DataFrame, where: Column) -> DataFrame:
    return raw.where(where).groupBy("event_type").agg(F.count(F.lit(1)).alias("event_count"))


def list_objects(spark: SparkSession, path: str) -> DataFrame:
    """One row per file with its partition columns; contents are never opened."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "false").load(path)
    return files.drop("content").withColumnsRenamed({"length": "size", "modificationTime": "modified"})


def discover_partitions(spark: SparkSession, path: str, where: Column | None = None) -> DataFrame:
    """The partitions that hold files, with file count and bytes, from the listing alone."""
    listing = list_objects(spark, path)
    keys = [c for c in listing.columns if c not in ("path", "size", "modified")]
    if where is not None:
        listing = listing.where(where)
    return listing.groupBy(*keys).agg(F.count(F.lit(1)).alias("files"), F.sum("size").alias("bytes"))


def partition_paths(base: str, start: date, end: date, hours: bool = False) -> list[str]:
    """Directories of a known date range, computed instead of listed; pass with ``basePath``."""
    days = [start + timedelta(days=i) for i in range((end - start).days + 1)]
    daily = [f"{base.rstrip('/')}/year={d:%Y}/month={d:%m}/day={d:%d}" for d in days]
    return [f"{d}/hour={h:02d}" for d in daily for h in range(24)] if hours else daily


def scan_cost(listing: DataFrame, where: Column, limit_bytes: int = 10 * 1024**3) -> DataFrame:
    """Files and bytes of a listing (``size`` and partition columns) that a filter would read, against the per-query limit."""
    total = listing.where(where).agg(
        F.count(F.lit(1)).alias("files"), F.coalesce(F.sum("size"), F.lit(0)).alias("bytes")
    )
    return total.select("files", "bytes", (F.col("bytes") > limit_bytes).cast("int").alias("over_limit"))
