"""Splitting hot runs must give what a plain window gives."""

import random

import pytest
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lakepulse.operators.runs import latest, ordered_runs


def skewed(spark, burst="no", n=300):
    """Hot and NULL keys, times that are NULL, and bursts of rows at one time."""
    rng = random.Random(7)
    rows = []
    for i in range(n):
        key = "hot" if i % 3 == 0 else (None if i % 3 == 1 and i % 2 else f"k{rng.randrange(30)}")
        ms = {"no": rng.randrange(5_000), "some": rng.randrange(5_000) if i % 2 else rng.randrange(4), "all": 60_000}[burst]
        rows.append((key, None if i % 11 == 0 else ms, i, rng.randrange(10)))
    return spark.createDataFrame(rows, "k string, ms bigint, id int, v int")


def frames(w):
    return {
        "avg3": F.avg("v").over(w.rowsBetween(-2, 0)),
        "max7": F.max("v").over(w.rowsBetween(-6, 0)),
        "nxt": F.lead("v", 1).over(w),
        "nxt2": F.lead("v", 2).over(w),
        "prv": F.lag("v", 3).over(w),
    }


@pytest.mark.parametrize("burst", ["no", "some", "all"])
@pytest.mark.parametrize("hot_rows", [3, 20, 100, 10_000])
def test_split_equals_plain_window(spark, burst, hot_rows):
    df = skewed(spark, burst)
    got = ordered_runs(df, ["k"], "ms", ["id"], frames, before=6, after=2, hot_rows=hot_rows)
    w = Window.partitionBy("k").orderBy("ms", "id")
    want = df.select(
        "*",
        *[c.alias(n) for n, c in frames(w).items()],
        F.row_number().over(w).cast("bigint").alias("run_index"),
        F.count(F.lit(1)).over(Window.partitionBy("k")).alias("run_length"),
    )
    key = lambda r: r["id"]
    assert sorted(got.collect(), key=key) == sorted(want.collect(), key=key)


def test_latest_limits_before_the_shuffle(spark):
    df = skewed(spark)
    got = latest(df, ["k"], "ms", ["id"], 5)
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert plan.count("WindowGroupLimit") == 2
    w = Window.partitionBy("k").orderBy(F.desc("ms"), F.desc("id"))
    want = df.withColumn("recency", F.row_number().over(w)).where("recency <= 5")
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))


def test_a_burst_of_one_key_is_cut(spark, monkeypatch):
    """Rows at one time are cut by their ties, and no part is much larger than it should be."""
    from lakepulse.operators import runs

    tables = {}
    plain = runs.written
    monkeypatch.setattr(runs, "written", lambda df, name: tables.setdefault(name, plain(df, name)))
    df = spark.range(5000).selectExpr("'bot' AS k", "60000 AS ms", "id", "1 AS v")
    got = ordered_runs(df, ["k"], "ms", ["id"], lambda w: {}, hot_rows=500)
    assert got.agg(F.max("run_index"), F.count_distinct("run_index"), F.min("run_length")).first()[:] == (5000, 5000, 5000)
    sizes = [r["count"] for r in tables["run-parts"].groupBy("_part").count().collect()]
    assert len(sizes) == 10 and max(sizes) < 1500
    assert tables["run-pieces"].count() <= 2 * 10
