"""Writers for the lake and the plans that look after it.

``rebalance`` leaves file sizes to adaptive execution: it splits the partitions of a hot hour over
several tasks and joins small ones, so no task writes a whole hot partition.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager
from datetime import date

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lakepulse.functions.exprs import ms_date, ms_hour

HOURLY = ["year", "month", "day", "hour"]

# Storage tiers by age in days, and prefixes whose objects expire.
TIERS = [(30, "STANDARD_IA"), (90, "GLACIER"), (365, "DEEP_ARCHIVE")]
EXPIRY = {"temp/": 7, "query-results/": 30}


def with_partitions(df: DataFrame, ms: str, padded: bool = True) -> DataFrame:
    """Add year, month, day, hour from event time: zero-padded text, or plain integers."""
    d, hour = ms_date(ms), ms_hour(ms)
    if padded:
        parts = [F.date_format(d, "yyyy"), F.date_format(d, "MM"), F.date_format(d, "dd"), F.lpad(hour.cast("string"), 2, "0")]
    else:
        parts = [F.year(d), F.month(d), F.dayofmonth(d), hour]
    return df.withColumns(dict(zip(HOURLY, parts, strict=True)))


def _balanced(df: DataFrame, keys: list[str]) -> DataFrame:
    return df.hint("rebalance", *[F.col(k) for k in keys])


@contextmanager
def _setting(spark: SparkSession, name: str, value: str) -> Iterator[None]:
    before = spark.conf.get(name)
    spark.conf.set(name, value)
    try:
        yield
    finally:
        spark.conf.set(name, before)


def target_size(spark: SparkSession, size: str):
    """Let adaptive execution aim at ``size`` of shuffled rows per written partition while the block runs."""
    return _setting(spark, "spark.sql.adaptive.advisoryPartitionSizeInBytes", size)


def _open_files(spark: SparkSession, n: int):
    """Let a task have ``n`` files open while the block runs: only one that meets more directories sorts its rows."""
    return _setting(spark, "spark.sql.maxConcurrentOutputFileWriters", str(n))


def write_json(
    df: DataFrame, path: str, keys: list[str] | None = None, mode: str = "error", balanced: bool = False
) -> None:
    """Land gzip JSON lines under partition directories; ``balanced`` rows are dealt by their keys already."""
    keys = keys or HOURLY
    rows = df if balanced else _balanced(df, keys)
    writer = rows.write.mode(mode).partitionBy(*keys).option("compression", "gzip")
    with _open_files(df.sparkSession, 100):
        writer.option("zlib.compress.level", "BEST_SPEED").json(path)


def append(df: DataFrame, path: str, keys: list[str]) -> None:
    """Add Parquet files under partition directories; a hot directory is written by several tasks."""
    with _open_files(df.sparkSession, 8):
        _balanced(df, keys).write.mode("append").partitionBy(*keys).parquet(path)


def write_tenants(df: DataFrame, path: str, tenant: Column, keys: list[str]) -> None:
    """One prefix per tenant, partitioned by date below it."""
    write_json(df.withColumn("tenant", tenant), path, ["tenant", *keys])


def compact(
    df: DataFrame, path: str, keys: list[str], target_size: str = "512MB", rows_per_file: int = 5_000_000
) -> None:
    """Rewrite landed partitions as Parquet files of about ``target_size``, with a row cap per file.

    Rows go to the files of a few directories side by side, so a task holds Parquet's buffers and not its rows.
    """
    with _setting(df.sparkSession, "spark.sql.adaptive.advisoryPartitionSizeInBytes", target_size), _open_files(df.sparkSession, 8):
        (
            _balanced(df, keys)
            .write.mode("overwrite")
            .option("partitionOverwriteMode", "dynamic")
            .option("maxRecordsPerFile", rows_per_file)
            .partitionBy(*keys)
            .parquet(path)
        )


def processed_summary(raw: DataFrame, processed_at: str) -> DataFrame:
    """Per hour: events, users and events per type. The map holds event types, not events.

    One pass over the raw rows: each (hour, type, user) count goes once to its type and once to its user.
    """
    kind = F.coalesce("event_type", F.lit("unknown")).alias("event_type")
    compact_rows = raw.groupBy(*HOURLY, kind, "user_id").agg(F.count(F.lit(1)).alias("events"))
    ids = F.array(
        F.struct(F.lit("type").alias("of"), F.col("event_type").alias("id"), F.col("events").alias("n")),
        F.struct(F.lit("user").alias("of"), F.col("user_id").alias("id"), F.lit(0).cast("bigint").alias("n")),
    )
    per_id = compact_rows.select(*HOURLY, F.inline(ids)).groupBy(*HOURLY, "of", "id").agg(F.sum("n").alias("n"))
    is_type = F.col("of") == "type"
    entries = F.collect_list(F.when(is_type, F.struct("id", "n")))
    hours = per_id.groupBy(*HOURLY).agg(
        F.sum("n").alias("total_events"),
        F.map_from_entries(F.sort_array(entries)).alias("event_types"),
        F.count_if(~is_type & F.col("id").isNotNull()).alias("unique_users"),
    )
    return hours.select(
        F.lit(processed_at).alias("processing_timestamp"),
        "total_events",
        "event_types",
        "unique_users",
        F.struct(*HOURLY).alias("partition_info"),
        *HOURLY,
    )


def retention_plan(listing: DataFrame, as_of: date) -> DataFrame:
    """What each object's age calls for: a storage tier, expiry, or nothing. Deletes nothing."""
    age = F.datediff(F.lit(as_of), F.to_date("modified"))
    tier = F.lit("STANDARD")
    for days, name in TIERS:
        tier = F.when(F.col("age_days") >= days, name).otherwise(tier)
    limit = None
    for prefix, days in EXPIRY.items():
        hit = F.col("path").startswith(prefix)
        limit = F.when(hit, days) if limit is None else limit.when(hit, days)
    aged = listing.withColumn("age_days", age).withColumn("expires_after", limit)
    expired = F.coalesce(F.col("age_days") >= F.col("expires_after"), F.lit(False))
    action = (
        F.when(expired, "EXPIRE").when(F.col("age_days") >= TIERS[0][0], "TRANSITION").otherwise("KEEP")
    )
    return aged.select("path", "size", "age_days", tier.alias("storage_class"), action.alias("action"))


def land_once(spark: SparkSession, landed: dict, key: tuple, write) -> str:
    """Path of a table that ``write`` lands the first time it is asked for in this application, and when it is gone."""
    from lakepulse.session import exists, scratch

    key = (spark.sparkContext.applicationId, *key)
    if key not in landed or not exists(spark, landed[key]):
        path = scratch(spark, "-".join(str(k).strip("/").replace("/", "_") for k in key[1:]))
        write(path)
        landed[key] = path
    return landed[key]
