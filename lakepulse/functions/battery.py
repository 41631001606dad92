"""Checks of the scalar functions: one row per function group, over every row of the table.

Each group is reduced to counts and integer sums, so two engines can be compared exactly.
"""

from __future__ import annotations

from datetime import date

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lakepulse.functions.exprs import (
    epoch_ms,
    iso_weekday,
    label,
    ms_date,
    ms_hour,
    number,
    percent,
    round_half_up,
)


def scalar_battery(flat: DataFrame, as_of: date) -> DataFrame:
    ms, d = epoch_ms(), ms_date(epoch_ms())
    level, today = number("danger_level"), F.lit(as_of)
    hundredths = lambda c: F.floor(c * 100 + 0.5).cast("bigint")
    bucket = label([(ms_hour(ms).between(6, 11), "morning"), (ms_hour(ms).between(12, 17), "afternoon")], "other")
    nested = F.struct(F.struct(F.col("duration").alias("y")).alias("x"))
    groups = {
        "cast": F.sum(level.cast("bigint")),
        "cast_failed": F.count_if(F.col("danger_level").isNotNull() & level.isNull()),
        "epoch": F.sum(F.datediff(d, F.lit(date(1970, 1, 1)))),
        "date_parts": F.sum(ms_hour(ms) * 1_000_000 + iso_weekday(d) * 10_000 + F.year(d) + F.month(d)),
        "date_arithmetic": F.count_if(d >= F.date_sub(today, 7)) * 1000 + F.sum(F.datediff(today, d)),
        "date_format": F.sum(F.date_format(d, "yyyyMM").cast("bigint")),
        "date_parse": F.sum(
            F.datediff(today, F.make_date(F.col("year").cast("int"), F.col("month").cast("int"), F.col("day").cast("int")))
        ),
        "math": F.sum(hundredths(round_half_up(F.greatest(F.lit(10.0), F.col("duration") * 3 - 1) / 7, 2))),
        "conditional": F.count_if(bucket == "morning") * 1_000_000 + F.count_if(bucket == "other"),
        "nullif": F.count(percent(F.lit(1), (ms_hour(ms) % 3))),
        "string": F.sum(F.length(F.concat("device_id", F.lit("|"), "focus"))),
        "like": F.count_if(F.col("focus").like("%Work%") | F.col("focus").like("%crisis%")),
        "between": F.count_if(ms_hour(ms).between(22, 23) | ms_hour(ms).between(0, 5)),
        "struct": F.sum(hundredths(nested["x"]["y"])),
        "array": F.sum(F.size(F.split("session_id", "_"))),
    }
    row = flat.agg(*[c.cast("bigint").alias(name) for name, c in groups.items()])
    pairs = ", ".join(f"'{name}', `{name}`" for name in groups)
    return row.selectExpr(f"stack({len(groups)}, {pairs}) as (function_group, checksum)")
