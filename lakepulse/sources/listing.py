"""Listings made by tasks, and what changed between two of them."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lakepulse.session import written

DAY = ["year", "month", "day"]
_LISTED = "path string, size bigint, modified bigint"


def _uri(root: str) -> str:
    plain = root.rstrip("/")
    return "file://" + plain.removeprefix("file:") if plain.startswith("file:/") and not plain.startswith("file://") else plain


def _list(root: str):
    def listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        store, base = fs.FileSystem.from_uri(root)
        for batch in batches:
            for directory in batch.column("directory").to_pylist():
                found = store.get_file_info(fs.FileSelector(f"{base}/{directory}".rstrip("/"), allow_not_found=True))
                found = [x for x in found if not x.base_name.startswith(("_", "."))]
                sizes = [x.size if x.type == fs.FileType.File else None for x in found]
                columns = [pa.array([x.path[len(base) + 1 :] for x in found], pa.string()), pa.array(sizes, pa.int64())]
                columns.append(pa.array([(x.mtime_ns or 0) // 1_000_000 for x in found], pa.int64()))
                yield pa.RecordBatch.from_arrays(columns, ["path", "size", "modified"])

    return listed


def list_files(spark: SparkSession, root: str) -> DataFrame:
    """``path`` (below ``root``), ``size, modified`` (ms) of all files; names that begin with ``_`` or ``.`` are left out.

    Level by level, tasks list the directories that the level before found, so no file's status passes the driver. A
    missing folder is an empty listing. Folders are reached through pyarrow's file systems.
    """
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    level = spark.createDataFrame([("",)], "directory string")
    files = None
    while files is None or not level.isEmpty():
        found = written(level.repartition(parts, "directory").mapInArrow(_list(_uri(root)), _LISTED), "listing")
        own = found.where("size IS NOT NULL")
        files = own if files is None else files.unionByName(own)
        level = found.where("size IS NULL").select(F.col("path").alias("directory"))
    return files


def _value(key: str) -> Column:
    found = F.regexp_extract("directory", f"(?:^|/){key}=([^/]*)", 1)
    return F.when(found != "", found)


def partition_changes(before: DataFrame, after: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Directories that two listings don't share alike: ``directory``, its keys, ``change``, files and bytes before and after.

    ``change`` is ``added`` (to register), ``dropped`` (all files gone) or ``changed`` (a file is new, gone, or of another
    size or time). A catalog that follows these rows needs no scan of its own.
    """

    def by_directory(listing: DataFrame, name: str) -> DataFrame:
        return listing.groupBy(F.regexp_extract("path", "^(.*)/[^/]*$", 1).alias("directory")).agg(
            F.count(F.lit(1)).alias(f"files_{name}"),
            F.sum("size").alias(f"bytes_{name}"),
            F.bit_xor(F.xxhash64("path", "size", "modified")).alias(f"mark_{name}"),
        )

    both = by_directory(before, "before").join(by_directory(after, "after"), "directory", "full")
    change = F.when(F.col("files_before").isNull(), "added").when(F.col("files_after").isNull(), "dropped")
    same = (F.col("mark_before") == F.col("mark_after")) & (F.col("files_before") == F.col("files_after"))
    change = change.when(~same, "changed")
    counts = ["files_before", "files_after", "bytes_before", "bytes_after"]
    found = both.withColumn("change", change).where(F.col("change").isNotNull())
    return found.select("directory", *[_value(k).alias(k) for k in keys or DAY], "change", *[F.coalesce(c, F.lit(0)).alias(c) for c in counts])
