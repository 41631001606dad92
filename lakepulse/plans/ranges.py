"""Users and percentiles over any range of days, from daily tables that can be merged; events are read once.

Users are exact: each has a number, and a day holds a bitmap of 32,768 numbers a row. Percentiles are estimates from
KLL sketches, with a rank error that ``k`` sets and that doesn't grow when days are merged. Both tables follow the
directories (year, month, day), so the days that ``refresh.changed_days`` names can be made anew alone.
"""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lakepulse.functions.exprs import flag, is_event
from lakepulse.plans.mart import DAY, HORIZONS
from lakepulse.session import exists, written

NUMBERS = "user_id string, user_no bigint"
#: Parts that new users are numbered in; the offsets that are broadcast have a row each.
PARTS = 1024


def _day() -> Column:
    return F.make_date(*[F.col(c).cast("int") for c in DAY])


def mart_segments() -> dict[str, Column]:
    """What the bitmaps of a day say about its users."""
    return {
        "active": F.lit(True),
        "opened": is_event("first_open"),
        "premium": F.col("subscription_status") == "premium",
    }


def mart_measures() -> dict[str, Column]:
    """What the sketches of a day hold."""
    return {"session_duration": F.col("duration"), "load_time": F.when(is_event("performance"), F.col("duration"))}


def new_numbers(events: DataFrame, known: DataFrame | None = None, user: str = "user_id") -> DataFrame:
    """``user_id, user_no`` of the users that ``known`` lacks. Numbers begin at 1, follow the highest known and have no gaps.

    Users are dealt by hash and ranked within their part; only the size of each part is summed in one place.
    """
    ids = events.select(F.col(user).cast("string").alias("user_id")).where("user_id IS NOT NULL").distinct()
    highest = 0
    if known is not None:
        ids = ids.join(known.select("user_id"), "user_id", "left_anti")
        highest = known.agg(F.coalesce(F.max("user_no"), F.lit(0))).first()[0]
    dealt = written(ids.withColumn("part", F.pmod(F.xxhash64("user_id"), F.lit(PARTS))), "users")
    sizes = dealt.groupBy("part").agg(F.count(F.lit(1)).alias("n"))
    earlier = F.sum("n").over(Window.orderBy("part")) - F.col("n")  # over as many rows as there are parts
    offsets = sizes.select("part", (earlier + highest).alias("offset"))
    rank = F.row_number().over(Window.partitionBy("part").orderBy("user_id"))
    ranked = dealt.withColumn("rank", rank).join(F.broadcast(offsets), "part")
    return ranked.select("user_id", (F.col("offset") + F.col("rank")).cast("bigint").alias("user_no"))


def number_users(spark: SparkSession, events: DataFrame, path: str, user: str = "user_id") -> DataFrame:
    """The table of user numbers at ``path``, extended by the users of ``events``. Numbers never change; one writer at a time."""
    known = spark.read.schema(NUMBERS).parquet(path) if exists(spark, path) else None
    new_numbers(events, known, user).write.mode("append").parquet(path)
    return spark.read.schema(NUMBERS).parquet(path)


def user_bitmaps(
    events: DataFrame, numbers: DataFrame, segments: dict[str, Column] | None = None, user: str = "user_id"
) -> DataFrame:
    """``segment, bucket, bits`` per directory: the users with an event that fulfils the segment's condition.

    Events collapse to one row a user and day. These are dealt by day and bucket before bits are set: a bitmap for each
    bucket in each task before the shuffle would be larger than the rows. Events without a user set no bit.
    """
    segments = mart_segments() if segments is None else segments
    user_days = (
        events.where(F.col(user).isNotNull())
        .groupBy(F.col(user).cast("string").alias("user_id"), *DAY)
        .agg(*[F.max(flag(c)).alias(f"in_{n}") for n, c in segments.items()])
    )
    names = F.array_compact(F.array(*[F.when(F.col(f"in_{n}") == 1, F.lit(n)) for n in segments]))
    marks = user_days.join(numbers, "user_id").select(
        *DAY, F.bitmap_bucket_number("user_no").alias("bucket"), F.bitmap_bit_position("user_no").alias("bit"), names.alias("names")
    )
    dealt = marks.repartition(*DAY, "bucket").select(*DAY, "bucket", "bit", F.explode("names").alias("segment"))
    return dealt.groupBy(*DAY, "bucket", "segment").agg(F.bitmap_construct_agg("bit").alias("bits"))


def distinct_users(bitmaps: DataFrame, start: date, end: date) -> DataFrame:
    """Per segment: the different users of all directories from ``start`` to ``end``, both included."""
    within = bitmaps.where(_day().between(F.lit(start), F.lit(end)))
    merged = within.groupBy("segment", "bucket").agg(F.bitmap_count(F.bitmap_or_agg("bits")).alias("n"))
    return merged.groupBy("segment").agg(F.sum("n").alias("users"))


def rolling_users(bitmaps: DataFrame, as_of: date, lengths: tuple[int, ...] = (1, 7, 30)) -> DataFrame:
    """Per day up to ``as_of`` and segment: the different users of the last 1, 7 and 30 days, the day included.

    A day has a row while any of the windows that end on it has a user. The bitmaps are shuffled once, by bucket; a
    window there has one row a day.
    """
    bucket = Window.partitionBy("segment", "bucket").orderBy("d")
    own = bitmaps.select("segment", "bucket", F.unix_date(_day()).alias("d"), "bits").where(
        F.col("d") <= F.unix_date(F.lit(as_of))
    )
    # A bucket's users also count on the days without a row of their own, until the longest window has passed.
    gap = F.least(
        F.coalesce(F.lead("d").over(bucket) - 1, F.unix_date(F.lit(as_of))) - F.col("d"), F.lit(max(lengths) - 1)
    )
    ahead = own.withColumn("gap", gap).select("*", F.explode(F.sequence(F.lit(0), "gap")).alias("ahead"))
    filled = ahead.select(
        "segment", "bucket", (F.col("d") + F.col("ahead")).alias("d"), F.when(F.col("ahead") == 0, F.col("bits")).alias("bits")
    )
    seen = lambda n: F.bitmap_count(F.bitmap_or_agg("bits").over(bucket.rangeBetween(1 - n, 0)))
    counted = filled.select("segment", "d", *[seen(n).alias(f"users_{n}") for n in lengths])
    return (
        counted.groupBy("segment", "d")
        .agg(*[F.sum(f"users_{n}").alias(f"users_{n}") for n in lengths])
        .withColumn("d", F.date_from_unix_date("d"))
    )


def _by_day(bitmaps: DataFrame, *segments: str) -> DataFrame:
    """One row a bucket and day, dealt by bucket alone; a column of bits for each segment."""
    dealt = bitmaps.where(F.col("segment").isin(*segments)).repartition("bucket")
    return dealt.groupBy("bucket", F.unix_date(_day()).alias("d")).agg(
        *[F.any_value(F.when(F.col("segment") == s, F.col("bits")), ignoreNulls=True).alias(s) for s in segments]
    )


def _both(rows: DataFrame, keys: list[str], a: Column, b: Column, *kept: str) -> DataFrame:
    """The bits that two columns share, one row per ``keys``; these hold the bucket that rows are dealt by already."""
    pairs = rows.where(a.isNotNull() & b.isNotNull()).select(*keys, *kept, F.explode(F.array(a, b)).alias("bits"))
    return pairs.groupBy(*keys).agg(
        F.bitmap_and_agg("bits").alias("bits"), *[F.any_value(c, ignoreNulls=True).alias(c) for c in kept]
    )


def cohort_returns(
    bitmaps: DataFrame, cohort: str = "opened", back: str = "active", horizons: tuple[int, ...] = HORIZONS
) -> DataFrame:
    """Per day: the users of ``cohort``, and how many of them are in ``back`` 1, 7 and 30 calendar days later.

    Unlike ``mart.daily_retention``, which counts hours since the first open, this goes by dates: days hold no times.
    """
    days = _by_day(bitmaps, *dict.fromkeys([cohort, back]))
    w = Window.partitionBy("bucket").orderBy("d")  # one row a day
    later = [F.first(back).over(w.rangeBetween(h, h)).alias(f"after_{h}") for h in horizons]
    members = days.select("*", *later).where(F.col(cohort).isNotNull())
    # The cohort itself is horizon 0.
    cells = F.array(
        F.struct(F.lit(0).alias("h"), F.col(cohort).alias("later")),
        *[F.struct(F.lit(h).alias("h"), F.col(f"after_{h}").alias("later")) for h in horizons],
    )
    long = members.select("bucket", "d", F.col(cohort).alias("own"), F.inline(cells))
    counted = _both(long, ["bucket", "d", "h"], F.col("own"), F.col("later"))
    of = lambda h: F.coalesce(F.sum(F.when(F.col("h") == h, F.bitmap_count("bits"))), F.lit(0))
    return (
        counted.groupBy("d")
        .agg(of(0).alias("cohort_users"), *[of(h).alias(f"back_{h}") for h in horizons])
        .withColumn("d", F.date_from_unix_date("d"))
    )


def returning_users(bitmaps: DataFrame, start: date, end: date, days: int = 7) -> DataFrame:
    """Users whose first day from ``start`` to ``end`` is followed by another within ``days`` days, and all users."""
    w = Window.partitionBy("bucket").orderBy("d")
    before = F.bitmap_or_agg("active").over(w.rangeBetween(Window.unboundedPreceding, -1))
    after = F.bitmap_or_agg("active").over(w.rangeBetween(1, days))
    rows = _by_day(bitmaps.where(_day().between(F.lit(start), F.lit(end))), "active")
    rows = rows.select("bucket", "d", "active", before.alias("before"), after.alias("after"))
    # Those who came before must not count: of "again or before", take off "before".
    again = _both(rows, ["bucket", "d"], F.col("active"), F.col("after"), "before")
    either = again.select("bucket", "d", F.bitmap_count("before").alias("known"), F.explode(F.array("bits", "before")).alias("bits"))
    counted = either.groupBy("bucket", "d").agg(
        F.bitmap_count(F.bitmap_or_agg("bits")).alias("n"), F.coalesce(F.max("known"), F.lit(0)).alias("known")
    )
    returned = counted.agg(F.coalesce(F.sum(F.col("n") - F.col("known")), F.lit(0)).alias("returning_users"))
    total = distinct_users(bitmaps.where("segment = 'active'"), start, end)
    # Both sides are one row.
    return returned.join(total.agg(F.coalesce(F.sum("users"), F.lit(0)).alias("total_users")), F.lit(True))


def daily_sketches(
    events: DataFrame, measures: dict[str, Column] | None = None, by: tuple[str, ...] = (), k: int = 800
) -> DataFrame:
    """``measure, sketch`` per directory (and ``by``): a KLL sketch of the measure's values; none where there is no value.

    A larger ``k`` gives a lower rank error: about 0.4 percent of the rows at 800, in about 20 kB.
    """
    measures = mart_measures() if measures is None else measures
    sketches = events.groupBy(*DAY, *by).agg(
        *[F.kll_sketch_agg_double(c.cast("double"), k).alias(n) for n, c in measures.items()]
    )
    cells = F.array(*[F.struct(F.lit(n).alias("measure"), F.col(n).alias("sketch")) for n in measures])
    long = sketches.select(*DAY, *by, F.inline(cells)).where(F.col("sketch").isNotNull())
    return long.where(F.kll_sketch_get_n_double("sketch") > 0)


def _quantiles(sketch: str, ranks: tuple[float, ...]) -> list[Column]:
    return [
        F.kll_sketch_get_n_double(sketch).alias("n"),
        *[F.kll_sketch_get_quantile_double(sketch, F.lit(r)).alias(f"p{round(r * 1000):03d}") for r in ranks],
    ]


def percentiles(
    sketches: DataFrame, start: date, end: date, ranks: tuple[float, ...] = (0.5, 0.95), by: tuple[str, ...] = ()
) -> DataFrame:
    """Per measure (and ``by``): the number of values of these days, exact, and their percentiles (``p500`` is the median)."""
    within = sketches.where(_day().between(F.lit(start), F.lit(end)))
    merged = within.groupBy("measure", *by).agg(F.kll_merge_agg_double("sketch").alias("sketch"))
    return merged.select("measure", *by, *_quantiles("sketch", ranks))


def rolling_percentiles(
    sketches: DataFrame, length: int = 7, ranks: tuple[float, ...] = (0.5, 0.95), by: tuple[str, ...] = ()
) -> DataFrame:
    """The same per day that has values, over the last ``length`` days."""
    w = Window.partitionBy("measure", *by).orderBy("day_no").rangeBetween(1 - length, 0)  # one row a day
    days = sketches.withColumn("day_no", F.unix_date(_day()))
    merged = days.withColumn("sketch", F.kll_merge_agg_double("sketch").over(w))
    return merged.select("measure", *by, F.date_from_unix_date("day_no").alias("d"), *_quantiles("sketch", ranks))


def sketched_percentiles(sketches: DataFrame) -> DataFrame:
    """``mart.daily_percentiles`` from the sketches, for a mart that reads its events once."""
    of = lambda name, rank: F.max(
        F.when(F.col("measure") == name, F.kll_sketch_get_quantile_double("sketch", F.lit(rank)))
    )
    return sketches.groupBy(*DAY).agg(
        of("session_duration", 0.5).alias("median_session_duration"),
        of("load_time", 0.95).alias("p95_performance_load_time"),
    )
