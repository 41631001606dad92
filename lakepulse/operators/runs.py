"""Window frames over long per-key runs, without putting a whole run into one task.

A window partitioned by device sorts all rows of that device in one task, and one device may hold a
third of the lake. ``ordered_runs`` gives the same answers whatever the length of a run:

1. Rows are counted per key (map-side combined); this reads the keys alone. If the longest run has at
   most ``hot_rows`` rows, the plan is a plain window. The number comes from the argument, the setting
   ``lakepulse.hotRows`` of the session, or the default of two million.
2. Otherwise the rows are written once, dealt by ranges of (key, time, ties) into parts of about
   ``hot_rows`` rows. Ranges cut a run wherever it is long, inside one millisecond if need be.
3. Runs that lie in several parts are found from counts per key and part; a border between parts cuts
   one run at most, so there are fewer than two such pieces for each part. A piece knows how many rows
   of its run come before it.
4. The window is applied by (key, part). Each piece of a cut run also receives copies of the few rows
   before (and after) it that its frames reach into; the copies are dropped again after the window.

Rows without a time come first, as in a plain window; NULL keys form one run.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, WindowSpec
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lakepulse.session import written

HOT_ROWS = 2_000_000
#: Pieces of cut runs that may be broadcast; a piece is a key and four numbers.
BROADCAST_PIECES = 100_000

Build = Callable[[WindowSpec], dict[str, Column]]


def _order(ms: str, ties: list[str], descending: bool = False) -> list[Column]:
    columns = [F.col(c) for c in (ms, *ties)]
    return [c.desc() for c in columns] if descending else columns


def _pieces(dealt: DataFrame) -> DataFrame:
    """Runs that lie in several parts: place among the run's parts, rows before, own rows, rows in all."""
    run = Window.partitionBy("_run")
    ordered = run.orderBy("_part")
    counted = dealt.groupBy("_run", "_part").agg(F.count(F.lit(1)).alias("_n"))
    return counted.select(
        "*",
        F.row_number().over(ordered).alias("_place"),
        (F.sum("_n").over(ordered) - F.col("_n")).alias("_start"),
        F.sum("_n").over(run).alias("_total"),
        F.count(F.lit(1)).over(run).alias("_parts"),
    ).where("_parts > 1")


def _copies(pieces_rows: DataFrame, pieces: DataFrame, ms: str, ties: list[str], before: int, after: int) -> DataFrame:
    """The last ``before`` and first ``after`` rows of each piece, for the pieces whose frames reach them.

    A piece has a row at least, so frames reach no further than that many pieces; the distance in rows decides.
    """
    piece = Window.partitionBy("_run", "_part")
    to = pieces.select("_run", F.col("_place").alias("_to"), *[F.col(c).alias(f"_to{c}") for c in ("_part", "_start", "_n")])
    found = []
    for reach, descending, sign in ((before, True, 1), (after, False, -1)):
        if not reach:
            continue
        edge = F.row_number().over(piece.orderBy(*_order(ms, ties, descending)))
        near = pieces_rows.withColumn("_edge", edge).where(F.col("_edge") <= reach)
        places = F.sequence(F.col("_place") + sign, F.col("_place") + sign * reach, F.lit(sign))
        sent = near.withColumn("_to", F.explode(places)).join(to, ["_run", "_to"])
        ahead = F.col("_to_start") - F.col("_start") - F.col("_n")
        behind = F.col("_start") - F.col("_to_start") - F.col("_to_n")
        found.append(sent.where((ahead if descending else behind) + F.col("_edge") <= reach))
    both = found[0] if len(found) == 1 else found[0].unionByName(found[1])
    return both.withColumns({"_part": F.col("_to_part"), "_start": F.col("_to_start")})


def ordered_runs(
    df: DataFrame,
    keys: list[str],
    ms: str,
    ties: list[str],
    build: Build,
    before: int = 0,
    after: int = 0,
    hot_rows: int | None = None,
    sizes: DataFrame | None = None,
) -> DataFrame:
    """Add window columns over ``keys`` ordered by ``ms, ties``.

    ``build`` receives the ordered window and returns expressions whose frames reach at most
    ``before`` rows back and ``after`` rows ahead. ``run_index`` (position from 1) and ``run_length``
    (rows in the run) are added as well. ``sizes`` may name a cheaper DataFrame with the same keys,
    row for row, to count the runs from.
    """
    columns = df.columns
    if hot_rows is None:
        hot_rows = int(df.sparkSession.conf.get("lakepulse.hotRows", str(HOT_ROWS)))
    # A struct compares NULL fields as equal, so grouping and joins on it keep NULL keys.
    counted = (df if sizes is None else sizes).groupBy(F.struct(*keys).alias("_run")).agg(F.count(F.lit(1)).alias("n"))
    found = counted.agg(F.max("n").alias("longest"), F.sum("n").alias("rows")).first()
    if (found["longest"] or 0) <= hot_rows:
        run = Window.partitionBy(*keys)
        w = run.orderBy(*_order(ms, ties))
        return df.select(
            "*",
            *[c.alias(name) for name, c in build(w).items()],
            F.row_number().over(w).cast("bigint").alias("run_index"),
            F.count(F.lit(1)).over(run).alias("run_length"),
        )

    rows = written(df.withColumn("_run", F.struct(*keys)), "runs")
    parts = math.ceil(found["rows"] / hot_rows)
    ranged = rows.repartitionByRange(parts, "_run", ms, *ties).withColumn("_part", F.spark_partition_id())
    dealt = written(ranged, "run-parts")
    pieces = written(_pieces(dealt), "run-pieces")
    small = F.broadcast(pieces) if 2 * parts <= BROADCAST_PIECES else pieces
    own = [*columns, "_run", "_part", "_start"]
    body = dealt.join(small.select("_run", "_part", "_start"), ["_run", "_part"], "left")
    body = body.select(*own, F.lit(0).alias("_copy"))
    if before or after:
        copies = _copies(dealt.join(small, ["_run", "_part"]), small, ms, ties, before, after)
        body = body.unionByName(copies.select(*own, F.lit(1).alias("_copy")))
    part = Window.partitionBy("_run", "_part")
    w = part.orderBy(*_order(ms, ties))
    mine = 1 - F.col("_copy")
    windowed = body.select(
        *columns,
        "_run",
        "_part",
        "_copy",
        *[c.alias(name) for name, c in build(w).items()],
        (
            F.coalesce("_start", F.lit(0))
            + F.sum(mine).over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow))
        ).alias("run_index"),
        F.sum(mine).over(part).alias("_length"),
    )
    whole = windowed.where(F.col("_copy") == 0).join(small.select("_run", "_part", "_total"), ["_run", "_part"], "left")
    return whole.withColumn("run_length", F.coalesce("_total", "_length")).drop("_run", "_part", "_copy", "_length", "_total")


def latest(df: DataFrame, keys: list[str], ms: str, ties: list[str], n: int) -> DataFrame:
    """The last ``n`` rows of each key with their ``recency`` (1 = newest).

    Spark applies the limit on each map task before the shuffle, so a hot key sends ``n`` rows per task.
    """
    w = Window.partitionBy(*keys).orderBy(*_order(ms, ties, descending=True))
    return df.withColumn("recency", F.row_number().over(w)).where(F.col("recency") <= n)
