"""Shared conventions on texts.

White space is ``[\\x20\\x09-\\x0D]``, which is what ``bytes.split`` and ``bytes.strip`` take it to be, and
lower-casing is of A-Z alone, which is what ``bytes.lower`` does. Texts are therefore handled as UTF-8
bytes; a null text is an empty one.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

WHITE = b" \t\n\x0b\x0c\r"
#: The same class for Spark's regular expressions.
WHITE_PATTERN = r"[\x20\x09-\x0D]"


def raw_texts(column: pa.Array) -> list[bytes]:
    """A string column as bytes, nulls as empty."""
    return [b"" if x is None else x for x in column.cast(pa.large_binary()).to_pylist()]


def code_points(raw: bytes) -> int:
    return len(raw) if raw.isascii() else len(raw.decode("utf-8", "replace"))


def hex_digest(text: Column) -> Column:
    """Lower-case hex SHA-256 of a string's UTF-8 bytes or of binary."""
    return F.sha2(text, 256)


def documents(spark, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def without(schema: T.StructType, *names: str) -> T.StructType:
    return T.StructType([f for f in schema if f.name not in names])


def arrow_schema(schema: T.StructType) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema

    return to_arrow_schema(schema)
