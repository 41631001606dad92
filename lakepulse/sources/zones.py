"""Zone maps: what a filter on any column makes a scan of Parquet files read, from the files' footers alone."""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lakepulse.session import written
from lakepulse.sources.listing import _uri, list_files

_OWN = [
    T.StructField("path", T.StringType()),
    T.StructField("row_group", T.LongType()),
    T.StructField("rows", T.LongType()),
    T.StructField("column_bytes", T.MapType(T.StringType(), T.LongType())),
]


def _footers(root: str, columns: T.StructType, schema: T.StructType):
    names = columns.names
    texts = {f.name for f in columns if isinstance(f.dataType, T.StringType)}

    def bounds(group: Any, found: dict[str, int], name: str) -> tuple[Any, Any, int | None]:
        """Smallest and largest value, and the number of NULLs; all None if the footer doesn't say."""
        statistics = group.column(found[name]).statistics if name in found else None
        if statistics is None:
            return None, None, None
        nulls = statistics.null_count if statistics.has_null_count else None
        if not statistics.has_min_max:
            return None, None, nulls
        low, high = statistics.min, statistics.max
        if low != low or high != high:  # NaN bounds nothing
            return None, None, None
        if name in texts and not (isinstance(low, str) and isinstance(high, str)):
            return None, None, None
        return low, high, nulls

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import pyarrow.parquet as pq
        from pyarrow import fs
        from pyspark.sql.pandas.types import to_arrow_schema

        store, base = fs.FileSystem.from_uri(root)
        wanted = to_arrow_schema(schema)
        for batch in batches:
            for path in batch.column("path").to_pylist():
                with store.open_input_file(f"{base}/{path}") as file:
                    footer = pq.ParquetFile(file).metadata
                    rows = []
                    for k in range(footer.num_row_groups):
                        group = footer.row_group(k)
                        leaves = [group.column(i) for i in range(group.num_columns)]
                        sizes: dict[str, int] = {}
                        for leaf in leaves:
                            top = leaf.path_in_schema.split(".")[0]
                            sizes[top] = sizes.get(top, 0) + leaf.total_compressed_size
                        found = {leaf.path_in_schema: i for i, leaf in enumerate(leaves)}
                        row = {"path": path, "row_group": k, "rows": group.num_rows, "column_bytes": list(sizes.items())}
                        for name in names:
                            row[f"low_{name}"], row[f"high_{name}"], row[f"nulls_{name}"] = bounds(group, found, name)
                        rows.append(row)
                yield pa.RecordBatch.from_pylist(rows, schema=wanted)

    return read


def zone_map(spark: SparkSession, root: str, columns: str) -> DataFrame:
    """A row per row group below ``root``: ``path, row_group, rows, column_bytes`` and, for each of ``columns`` (as DDL),
    its ``low_``, ``high_`` and ``nulls_``. Tasks list the folders and read the footers; data pages aren't touched.
    """
    fields = spark.createDataFrame([], columns).schema
    own = [
        g
        for f in fields
        for g in (
            T.StructField(f"low_{f.name}", f.dataType),
            T.StructField(f"high_{f.name}", f.dataType),
            T.StructField(f"nulls_{f.name}", T.LongType()),
        )
    ]
    schema = T.StructType([*_OWN, *own])
    files = list_files(spark, root).where("size > 0").select("path").repartition("path")
    return written(files.mapInArrow(_footers(_uri(root), fields, schema), schema), "zones")


def between(column: str, low: Any = None, high: Any = None) -> Column:
    """Whether a row group may hold a value from ``low`` to ``high``, both included; an open end is None.

    A group whose footer doesn't say may hold any; one that has only NULLs holds none.
    """
    empty = F.coalesce(F.col(f"nulls_{column}") == F.col("rows"), F.lit(False))
    may = F.lit(True)
    if low is not None:
        may &= F.coalesce(F.col(f"high_{column}") >= F.lit(low), F.lit(True))
    if high is not None:
        may &= F.coalesce(F.col(f"low_{column}") <= F.lit(high), F.lit(True))
    return ~empty & may


def is_null(column: str) -> Column:
    return F.coalesce(F.col(f"nulls_{column}") > 0, F.lit(True))


def scan_cost(zones: DataFrame, where: Column, limit_bytes: int, columns: list[str] | None = None) -> DataFrame:
    """Files, row groups, rows and bytes that a scan reads, and whether the bytes pass the limit.

    ``where`` combines ``between`` and ``is_null`` with ``&`` and ``|``, and filters on ``path``. ``columns`` are those that
    the query reads, all by default. The figure is an upper bound: page filters can only read less.
    """
    sizes = F.map_values("column_bytes")
    if columns is not None:
        sizes = F.map_values(F.map_filter("column_bytes", lambda name, _: name.isin(columns)))
    size = F.aggregate(sizes, F.lit(0).cast("bigint"), lambda total, x: total + x)
    return (
        zones.where(where)
        .agg(
            F.countDistinct("path").alias("files"),
            F.count(F.lit(1)).alias("row_groups"),
            F.coalesce(F.sum("rows"), F.lit(0)).alias("rows"),
            F.coalesce(F.sum(size), F.lit(0)).alias("bytes"),
        )
        .withColumn("over_limit", (F.col("bytes") > limit_bytes).cast("int"))
    )
