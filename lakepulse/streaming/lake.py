"""Streams over landed batches and metrics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lakepulse.functions.exprs import ratio
from lakepulse.operators.flatten import flatten_events, to_flat
from lakepulse.sources import schemas


def read_batch_stream(spark: SparkSession, path: str, files_per_batch: int | None = None) -> DataFrame:
    reader = spark.readStream.schema(schemas.BATCHES)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.json(path)


def flat_stream(batches: DataFrame, min_year: str | None = None) -> DataFrame:
    """Landed batches to events; stateless, so each batch file is flattened exactly once."""
    return to_flat(flatten_events(batches, min_year))


def windowed(
    stream: DataFrame, ms: str, period_s: int, watermark: str, by: list[str] | None = None, **aggregates: Column
) -> DataFrame:
    """Closed windows of a stream, for each key of ``by``; rows later than the watermark no longer count."""
    by = by or []
    at = stream.withColumn("at", F.timestamp_millis(F.col(ms))).withWatermark("at", watermark)
    grouped = at.groupBy(*by, F.window("at", f"{period_s} seconds").alias("w")).agg(
        *[c.alias(name) for name, c in aggregates.items()]
    )
    return grouped.select(*by, F.unix_millis(F.col("w.start")).alias("window_start"), *aggregates)


def error_rate_stream(
    http: DataFrame, period_s: int = 300, watermark: str = "10 minutes", by: list[str] | None = None
) -> DataFrame:
    failed, requests = F.sum(F.col("is_4xx") + F.col("is_5xx")), F.count(F.lit(1))
    sums = windowed(http, "ms", period_s, watermark, by, failed=failed, requests=requests)
    return sums.select(*(by or []), "window_start", (ratio("failed", "requests", digits=None) * 100.0).alias("value"))
