"""From documents to tokens in five stages: each is written as Parquet, and read again as the next one's documents.

A stage is a function of the session, the documents and the tables' folder. All but the last return the columns of
documents; texts that a stage changes have their ``n_chars`` counted anew.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lakepulse.llm.byte_bpe import VOCABULARY, Tokenizer, digests
from lakepulse.llm.line_dedup import dedup_lines
from lakepulse.llm.mixing import mix
from lakepulse.llm.near_texts import near_texts
from lakepulse.llm.quality_rules import quality_rules
from lakepulse.llm.text import documents
from lakepulse.session import small_batches, written


def _packed(docs: DataFrame, *plain: str) -> DataFrame:
    """The plain columns, and all others in one, so that their names can't meet those that an operator adds."""
    return docs.select(*plain, F.struct(F.lit(1).alias("_"), *[c for c in docs.columns if c not in plain]).alias("others"))


def _unpacked(df: DataFrame, docs: DataFrame, *plain: str) -> DataFrame:
    return df.select([F.col(c) if c in plain else F.col("others")[c].alias(c) for c in docs.columns])


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the rules on length and repetition."""
    small_batches(spark)
    return _unpacked(quality_rules(_packed(docs, "text")).where("kept"), docs, "text")


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that many documents share stay in one of them."""
    small_batches(spark)
    deduped = dedup_lines(_packed(docs, "doc_id", "text", "n_chars"))
    changed = F.when(F.col("n_dropped") > 0, F.char_length("text")).otherwise(F.col("n_chars"))
    return _unpacked(deduped.withColumn("n_chars", changed.cast("long")), docs, "doc_id", "text", "n_chars")


def near_duplicate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates the one with the smallest id; without id all stay.

    Candidates are texts with linked SimHash fingerprints, and those that share a min-hash band; a link is confirmed by
    the exact sets (five-word shingles, Jaccard 0.8).
    """
    small_batches(spark)
    groups = near_texts(docs).where("doc_id <> component_id").select("doc_id").distinct()
    return docs.join(groups, "doc_id", "left_anti").select(docs.columns)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A sample whose tokens meet the target shares of sources, languages and topics."""
    plain = ("doc_id", "text", "source", "lang")
    return _unpacked(mix(_packed(docs, *plain)).where("copies > 0"), docs, *plain)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """``doc_id, source, lang, ids``, and the digests of the ids and of what they decode to."""
    small_batches(spark)
    both = Tokenizer(spark, public_tokenizers.path(VOCABULARY)).round_trip(docs.select("doc_id", "source", "lang", "text"))
    return digests(both, "source", "lang", "ids")


STAGES = [
    ("quality rules", quality),
    ("line dedup", lines),
    ("near-duplicates", near_duplicate),
    ("mixture", mixture),
    ("tokens", tokens),
]

#: Near-duplicates, sampling by a hash and BPE are beyond SQL; the tests compare with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return stage_of("tokens")(spark, docs, sf_dir)


def stage_of(name: str):
    return dict(STAGES)[name]
