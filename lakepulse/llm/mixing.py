"""Sampling documents so that their tokens meet target weights by source, language and topic.

Iterative proportional fitting (raking) starts from the tokens that each cell (source, language, topic) has, and scales
the cells to the target share of each source, then of each language, then of each topic, again and again until nothing
changes. A cell can't give more than its documents allow (``max_rate`` times its tokens); what it lacks is raked onto the
others. The rate of a cell is its raked tokens over those it has. A document is taken as often as the rate says: the
whole part of the rate for certain, once more with the probability of the rest, decided by a hash of its id.

Documents are read twice, once for the cells and once for the sample; the rounds work on the table of cells, which
has a row for each combination there is.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lakepulse.llm.text import documents
from lakepulse.session import written

DIMENSIONS = ("source", "lang", "topic")
#: Largest relative change of a cell's weight in a round that ends the raking, and rounds at most.
TOLERANCE = 1e-4
MAX_ROUNDS = 30
#: Share of all tokens that is sampled in all, if the cells can give it.
BUDGET = 0.5
#: Without given targets, the shares there are, flattened by this power: under 1, rare values gain.
POWER = 0.7
#: How often a document may be taken.
MAX_RATE = 1.0
SEED = 42
#: Cells of a partition in the rounds.
PARTITION_CELLS = 200_000
NONE = "(none)"


def tokens() -> Column:
    """Words of the text, as its tokens."""
    return F.coalesce(F.regexp_count("text", F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def topic() -> Column:
    """A coarse topic by what a text holds; the first that fits."""
    text = F.coalesce("text", F.lit(""))
    return (
        F.when(text.rlike(r"(?i)\b(licen[sc]e|licensed|copyright)\b"), "legal")
        .when(text.contains(" | ") | text.contains("\t"), "tabular")
        .when(text.rlike(r"\w@\w+\.\w|https?://"), "contact")
        .otherwise("prose")
    )


def flattened(cells: DataFrame, dimension: str, power: float = POWER) -> DataFrame:
    """``value, share``: the shares of a dimension's values, to the given power, not yet summing to 1."""
    sums = cells.groupBy(F.col(dimension).alias("value")).agg(F.sum("tokens").alias("n"))
    return sums.select("value", F.pow(F.col("n").cast("double"), F.lit(power)).alias("share"))


def rake(
    cells: DataFrame,
    targets: dict[str, DataFrame],
    budget: float = BUDGET,
    max_rate: float = MAX_RATE,
    tolerance: float = TOLERANCE,
    max_rounds: int = MAX_ROUNDS,
) -> DataFrame:
    """``cells`` (the targets' dimensions and ``tokens``) with the ``rate`` at which each is sampled.

    ``targets`` has for each dimension a table ``value, share``; shares count in proportion to their sum, and a value
    that isn't in the table isn't sampled. Cells without tokens get the rate 0.
    """
    parts = math.ceil(cells.count() / PARTITION_CELLS) or 1
    total = cells.agg(F.sum("tokens")).first()[0] or 0
    most = F.col("tokens") * float(max_rate)
    now = cells.withColumn("__goal", F.col("tokens") * float(budget))
    wanted = {}
    for name, shares in targets.items():
        # Only values that there are can take a share.
        there = cells.where("tokens > 0").select(F.col(name).alias("value")).distinct()
        found = written(shares.join(there, "value", "left_semi").coalesce(1) if parts == 1 else shares.join(there, "value", "left_semi"), "shares")
        whole = found.agg(F.sum("share")).first()[0] or 1.0
        wanted[name] = found.select(F.col("value").alias(name), (F.col("share") * (budget * total / whole)).alias("__want"))
    for _ in range(max_rounds):
        now = now.withColumn("__was", F.col("__goal"))
        for name in targets:
            sums = now.groupBy(name).agg(F.sum("__goal").alias("__sum")).join(wanted[name], name, "left")
            scale = F.when(F.col("__sum") > 0, F.coalesce("__want", F.lit(0.0)) / F.col("__sum")).otherwise(0.0)
            factor = sums.select(name, scale.alias("__factor"))
            now = now.join(factor, name).withColumn("__goal", F.least(F.col("__goal") * F.col("__factor"), most)).drop("__factor")
        now = now.coalesce(1) if parts == 1 else now.repartition(parts)
        now = written(now, "raked")
        if parts == 1:
            now = now.coalesce(1)  # one partition needs no exchange in the next round
        change = F.abs(F.col("__goal") - F.col("__was")) / F.greatest(F.col("__was"), F.lit(1e-9))
        moved = now.where("tokens > 0").agg(F.max(change)).first()[0] or 0.0
        now = now.drop("__was")
        if moved <= tolerance:
            break
    rate = F.when(F.col("tokens") > 0, F.col("__goal") / F.col("tokens")).otherwise(0.0)
    return now.select(*cells.columns, rate.alias("rate"))


def mix(
    docs: DataFrame,
    targets: dict[str, DataFrame] | None = None,
    budget: float = BUDGET,
    max_rate: float = MAX_RATE,
    seed: int = SEED,
) -> DataFrame:
    """``docs`` with ``topic``, ``n_tokens``, ``rate`` and ``copies`` (how often it is taken, 0 or more) behind its columns.

    Nulls in ``source`` or ``lang`` count as the value ``(none)``; null texts have no tokens and the topic ``prose``.
    Texts without tokens weigh nothing and have the rate of their cell. Rows with the same id are taken alike; a row
    without id is decided by its text. Columns of ``docs`` with the added names are replaced. An empty table gives an
    empty table. Without ``targets`` the shares there are, flattened by ``POWER``, are the targets.
    """
    own = docs.drop("topic", "n_tokens", "rate", "copies")
    place = [F.coalesce(F.col(c).cast("string"), F.lit(NONE)).alias(f"__{c}") for c in ("source", "lang")]
    labelled = own.select("*", *place, topic().alias("topic"), tokens().alias("n_tokens")).withColumn("__topic", F.col("topic"))
    dims = [f"__{d}" for d in DIMENSIONS]
    cells = written(labelled.groupBy(*dims).agg(F.sum("n_tokens").alias("tokens")), "cells")
    if targets is None:
        goals = {d: flattened(cells, d) for d in dims}
    else:
        goals = {f"__{d}": shares for d, shares in targets.items()}
    rates = rake(cells, goals, budget, max_rate).select(*dims, "rate")
    spread = F.xxhash64(F.lit(seed), F.coalesce(F.col("doc_id").cast("string"), F.col("text")))
    chance = F.pmod(spread, F.lit(2**53)) / F.lit(float(2**53))
    copies = F.floor("rate") + (chance < F.col("rate") - F.floor("rate")).cast("long")
    return labelled.join(rates, dims).drop(*dims).withColumn("copies", copies)


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mix(documents(spark, sf_dir).select("doc_id", "text", "source", "lang"))
    return mixed.select("doc_id", "source", "lang", "topic", "n_tokens", "rate", "copies")
