"""Language identification by compression.

For each language a dictionary of raw content is filled with text of that language. A text is compressed once with each
dictionary, and the language with the smallest result is the answer; the relative distance to the second smallest is its
score, and an answer with a narrow margin is marked as rejected. Texts are reduced to lower-case letters and single spaces
before, so that numbers, markup and capitals don't count. Long texts are compressed in blocks, each with the dictionary
in reach, and the sizes are added up.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from lakepulse.llm.text import arrow_schema, documents

#: What a dictionary is made of: so many bytes, from the beginnings of so many texts of a language. The texts
#: are those with the smallest hashes of their ids, so the sample is the same however the rows lie.
DICTIONARY_BYTES = 65_536
SAMPLE_TEXTS = 96
SAMPLE_CHARS = 4_000
LEVEL = 6
BLOCK_BYTES = 16_384
#: A smaller relative margin between the best two languages is narrow.
MIN_MARGIN = 0.01
UNKNOWN = "und"

_WORDS = r"[^\W\d_]+"


def reduced(text: str) -> bytes:
    """Words of letters in lower case, with a space around each; empty without a letter."""
    if not any(c.isalpha() for c in text):
        return b""
    return f" {' '.join(re.findall(_WORDS, text.lower()))} ".encode()


def held_out(doc_id: str = "doc_id") -> Column:
    """Whether a document is left out of learning; one without an id isn't, but isn't learned from either."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 3 == 1, F.lit(False))


@dataclass
class Languages:
    """Dictionaries by language, the most frequent language first; ties go to the earlier one."""

    dictionaries: dict[str, bytes]


def learn(rows: DataFrame, dictionary_bytes: int = DICTIONARY_BYTES) -> Languages:
    """From ``doc_id, text, lang``: rows without id, text or language are left out.

    The driver gets ``SAMPLE_TEXTS`` beginnings of ``SAMPLE_CHARS`` characters for each language, whatever the table's size.
    """
    usable = rows.where("doc_id IS NOT NULL AND lang IS NOT NULL AND text RLIKE '\\\\p{L}'")
    counts = {r["lang"]: r["n"] for r in usable.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}
    begins = usable.select("lang", "doc_id", F.xxhash64("doc_id").alias("place"), F.substring("text", 1, SAMPLE_CHARS).alias("begin"))
    first = Window.partitionBy("lang").orderBy("place", "doc_id", "begin")
    sample = begins.withColumn("n", F.row_number().over(first)).where(F.col("n") <= SAMPLE_TEXTS)
    found: dict[str, list[bytes]] = {lang: [] for lang in sorted(counts, key=lambda x: (-counts[x], x))}
    for row in sample.orderBy("lang", "n").collect():
        found[row["lang"]].append(reduced(row["begin"]))
    return Languages({lang: b"".join(parts)[:dictionary_bytes] for lang, parts in found.items()})


class Judge:
    def __init__(self, languages: Languages) -> None:
        self.compressors = {}
        for lang, content in languages.dictionaries.items():
            known = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT) if len(content) >= 8 else None
            if known:
                known.precompute_compress(level=LEVEL)
            self.compressors[lang] = zstandard.ZstdCompressor(
                level=LEVEL, dict_data=known, write_content_size=False, write_checksum=False, write_dict_id=False
            )

    def sizes(self, body: bytes) -> dict[str, int]:
        blocks = [body[i : i + BLOCK_BYTES] for i in range(0, len(body), BLOCK_BYTES)]
        return {lang: sum(len(c.compress(b)) for b in blocks) for lang, c in self.compressors.items()}

    def best(self, text: str | None) -> tuple[str, float]:
        """The language and the relative margin, from 0 to 1."""
        body = reduced(text) if text else b""
        if not body or not self.compressors:
            return UNKNOWN, 0.0
        sizes = self.sizes(body)
        lang = min(sizes, key=sizes.get)  # the first of the smallest
        second = min((n for other, n in sizes.items() if other != lang), default=None)
        return lang, 1.0 if second is None else (second - sizes[lang]) / second


def identify(docs: DataFrame, languages: Languages, min_margin: float = MIN_MARGIN) -> DataFrame:
    """``docs`` with ``lang_pred``, ``score`` (0 to 1) and ``rejected`` behind its columns.

    Only ``text`` decides. ``lang_pred`` is the best learned language even where the margin is narrow, which ``rejected``
    tells; it is ``und``, with the score 0 and rejected, for a null text, one without a letter, or if nothing was learned.
    Repeated rows are judged alike. Columns of ``docs`` with the added names are replaced. An empty table stays empty.
    """
    spark = docs.sparkSession
    own = docs.drop("lang_pred", "score", "rejected")
    names = own.columns
    schema = T.StructType([*own.schema, T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])
    shared = spark.sparkContext.broadcast(languages.dictionaries)  # DICTIONARY_BYTES a language

    def judged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        judge, wanted = Judge(Languages(shared.value)), arrow_schema(schema)
        for batch in batches:
            found = [judge.best(text) for text in batch.column("text").to_pylist()]
            columns = [pa.array([f[0] for f in found], pa.string()), pa.array([f[1] for f in found], pa.float64())]
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in names], *columns], schema=wanted)

    return own.mapInArrow(judged, schema).withColumn("rejected", F.col("score") < min_margin)


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    languages = learn(docs.where(~held_out()).select("doc_id", "text", "lang"))
    judged = identify(docs.select("doc_id", "text"), languages)
    return judged.select("doc_id", held_out().alias("held_out"), "lang_pred", "score", "rejected")
