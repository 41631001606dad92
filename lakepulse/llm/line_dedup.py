"""Lines that many documents share are removed from all but one of them.

1. Each document gives a 128-bit hash of every distinct long line (its *key*); the hashes are written once.
2. Documents are counted per hash. The distinct hashes are split into shards, and each shard becomes a
   minimal perfect hash: bit arrays by level, in which a key's rank among the set bits is its slot. The
   slots index three arrays: a 32-bit fingerprint, the number of documents, the document that keeps the line.
3. The hashes of documents are sent to the shards as numbers and probe the arrays there; nothing is joined
   by line text. A shard that would be probed far more often than others, because it holds a very common
   line, is sent to several tasks with a part of the probes each.
4. What a document loses comes back to it by ``doc_id``, and its text is written anew.

All distinct hashes are in the index, so every probe finds its own key; a fingerprint that differs means that
a shard doesn't belong to the probes, and is an error.
"""

from __future__ import annotations

import io
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lakepulse.llm.text import WHITE, arrow_schema, code_points, documents, hex_digest, raw_texts
from lakepulse.session import written

MIN_CHARS = 40
MIN_DOCS = 5
#: Distinct hashes in a shard, at most about; a shard takes 17 bytes a key.
SHARD_KEYS = 250_000
#: Shards whose table of probe counts (two numbers a shard) is broadcast; with more of them it is joined.
BROADCAST_SHARDS = 1_000_000
#: Bits per key in a level of the perfect hash.
GAMMA = 2

_LINES = "doc_id long, hi long, lo long"


def keys_of(raw: bytes, min_chars: int) -> list[bytes | None]:
    """For each line the hash of its key, or None if the key is too short to count."""
    out: list[bytes | None] = []
    for line in raw.split(b"\n"):
        key = line.strip(WHITE).lower()
        long = len(key) >= min_chars and code_points(key) >= min_chars
        out.append(xxhash.xxh3_128_digest(key) if long else None)
    return out


def line_hashes(docs: DataFrame, min_chars: int = MIN_CHARS) -> DataFrame:
    """``doc_id, hi, lo``: the distinct keys of each document that has an id."""

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, digests = [], []
            for doc_id, raw in zip(batch.column("doc_id").to_pylist(), raw_texts(batch.column("text")), strict=True):
                own = dict.fromkeys(keys_of(raw, min_chars))
                own.pop(None, None)
                ids.extend([doc_id] * len(own))
                digests.extend(own)
            pairs = np.frombuffer(b"".join(digests), dtype="<i8").reshape(-1, 2)
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids, pa.int64()), pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], ["doc_id", "hi", "lo"]
            )

    texts = docs.where(F.col("doc_id").isNotNull()).select(F.col("doc_id").cast("long"), "text")
    return texts.mapInArrow(hashed, _LINES)


def _positions(hi: np.ndarray, lo: np.ndarray, level: int, size: int) -> np.ndarray:
    """Where the keys fall in a level of so many bits."""
    x = hi.astype(np.uint64) + lo.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    x += np.uint64((level + 1) * 0xD1B54A32D192ED03 % 2**64)
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        x = (x ^ (x >> np.uint64(shift))) * np.uint64(factor)
    return (x ^ (x >> np.uint64(31))) % np.uint64(size)


def build_hash(hi: np.ndarray, lo: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bit arrays of all levels as 64-bit words, and the first word of each level.

    In each level the keys that fall alone on a bit are settled there; the others go on to the next.
    """
    words, starts = [], [0]
    while len(hi):
        size = 64 * math.ceil(GAMMA * len(hi) / 64)
        at = _positions(hi, lo, len(starts) - 1, size)
        alone = np.bincount(at.astype(np.int64), minlength=size) == 1
        words.append(np.packbits(alone, bitorder="little").view(np.uint64))
        starts.append(starts[-1] + size // 64)
        rest = ~alone[at]
        hi, lo = hi[rest], lo[rest]
    return np.concatenate(words) if words else np.zeros(0, np.uint64), np.array(starts)


def slots(hi: np.ndarray, lo: np.ndarray, words: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """The slot of each key that the hash was built from; -1 for most others."""
    before = np.concatenate([[0], np.cumsum(np.bitwise_count(words), dtype=np.int64)])
    out = np.full(len(hi), -1, np.int64)
    left = np.arange(len(hi))
    for level in range(len(starts) - 1):
        first, size = starts[level], 64 * (starts[level + 1] - starts[level])
        at = _positions(hi[left], lo[left], level, size)
        word, bit = (first + (at >> np.uint64(6)).astype(np.int64)), at & np.uint64(63)
        hit = (words[word] >> bit) & np.uint64(1) == 1
        below = words[word[hit]] & ((np.uint64(1) << bit[hit]) - np.uint64(1))
        out[left[hit]] = before[word[hit]] + np.bitwise_count(below)
        left = left[~hit]
    return out


def _fingerprints(hi: np.ndarray, lo: np.ndarray) -> np.ndarray:
    return ((hi ^ (lo >> 32)) & 0xFFFFFFFF).astype(np.uint32)


def _pack(rows: pd.DataFrame) -> bytes:
    hi, lo = rows["hi"].to_numpy(), rows["lo"].to_numpy()
    words, starts = build_hash(hi, lo)
    order = np.empty(len(hi), np.int64)
    order[slots(hi, lo, words, starts)] = np.arange(len(hi))
    out = io.BytesIO()
    np.savez(
        out,
        words=words,
        starts=starts,
        prints=_fingerprints(hi, lo)[order],
        counts=np.minimum(rows["n_docs"].to_numpy(), 2**32 - 1).astype(np.uint32)[order],
        owners=rows["owner"].to_numpy()[order],
    )
    return out.getvalue()


def build_index(counted: DataFrame, shards: int) -> DataFrame:
    """``shard, arrays``: one row for each shard of ``hi, lo, n_docs, owner``."""

    def build(rows: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"shard": [rows["shard"].iloc[0]], "arrays": [_pack(rows)]})

    return counted.withColumn("shard", F.pmod("hi", F.lit(shards))).groupBy("shard").applyInPandas(
        build, "shard long, arrays binary"
    )


def _probe(min_docs: int):
    def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come by shard, its arrays first."""
        held, arrays = None, None
        for batch in batches:
            place = list(zip(batch.column("shard").to_pylist(), batch.column("part").to_pylist(), strict=True))
            is_probe = np.array(batch.column("kind").to_pylist()) == 1
            doc, hi, lo = (batch.column(c).fill_null(0).to_numpy(zero_copy_only=False) for c in ("doc_id", "hi", "lo"))
            n, i = len(place), 0
            out: list[np.ndarray] = []
            while i < n:
                if not is_probe[i]:
                    with np.load(io.BytesIO(batch.column("arrays")[i].as_py())) as file:
                        held, arrays = place[i], dict(file)
                    i += 1
                    continue
                j = i
                while j < n and is_probe[j] and place[j] == place[i]:
                    j += 1
                if held != place[i]:
                    raise ValueError(f"no index for shard {place[i]}")
                at = slots(hi[i:j], lo[i:j], arrays["words"], arrays["starts"])
                if (at < 0).any() or (arrays["prints"][at] != _fingerprints(hi[i:j], lo[i:j])).any():
                    raise ValueError(f"the index of shard {place[i]} isn't of these lines")
                lost = (arrays["counts"][at] >= min_docs) & (arrays["owners"][at] != doc[i:j])
                out.append(i + np.flatnonzero(lost))
                i = j
            lost = np.concatenate(out) if out else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(x[lost]) for x in (doc, hi, lo)], ["doc_id", "hi", "lo"])

    return probe


def lost_lines(lines: DataFrame, min_docs: int = MIN_DOCS) -> DataFrame:
    """``doc_id, hi, lo``: the lines that a document loses. ``lines`` is a written table."""
    spark = lines.sparkSession
    partitions = int(spark.conf.get("spark.sql.shuffle.partitions"))
    counted = written(
        lines.groupBy("hi", "lo").agg(F.count_distinct("doc_id").alias("n_docs"), F.max("doc_id").alias("owner")),
        "line-counts",
    )
    shards = max(math.ceil(counted.count() / SHARD_KEYS), 4 * partitions)
    fair = max(1, math.ceil(lines.count() / shards))  # probes of a shard, on average
    shard = F.pmod("hi", F.lit(shards)).alias("shard")
    parts = (
        counted.groupBy(shard)
        .agg(F.sum("n_docs").alias("probes"))
        .select("shard", F.ceil(F.col("probes") / fair).alias("parts"))
    )
    if shards <= BROADCAST_SHARDS:
        parts = F.broadcast(parts)
    index = (
        build_index(counted, shards)
        .join(parts, "shard")
        .select("shard", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), F.lit(0).alias("kind"), "arrays")
    )
    probes = lines.select(shard, "doc_id", "hi", "lo").join(parts, "shard")
    probes = probes.select(
        "shard", F.pmod(F.xxhash64("doc_id"), F.col("parts")).alias("part"), F.lit(1).alias("kind"), "doc_id", "hi", "lo"
    )
    both = index.unionByName(probes, allowMissingColumns=True)
    placed = both.repartition(partitions, "shard", "part").sortWithinPartitions("shard", "part", "kind")
    return placed.mapInArrow(_probe(min_docs), _LINES)


def dedup_lines(docs: DataFrame, min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS) -> DataFrame:
    """``docs`` with ``text`` as it stays, and ``n_lines`` (before) and ``n_dropped`` behind its columns.

    A line's key is the line without white space at both ends, A-Z lower-cased. Keys of at least ``min_chars``
    code points in at least ``min_docs`` documents lose all their lines but those in the largest ``doc_id``.
    A null or empty text has one empty line; a null text stays null. Rows with the same ``doc_id`` are one
    document. A row without ``doc_id`` counts for no line and loses none. Columns named ``n_lines`` or
    ``n_dropped`` are replaced. An empty table gives an empty table.
    """
    lines = written(line_hashes(docs, min_chars), "line-hashes")
    lost = lost_lines(lines, min_docs).groupBy(F.col("doc_id").alias("__of"))
    lost = lost.agg(F.collect_list(F.struct("hi", "lo")).alias("__lost"))
    kept = docs.drop("n_lines", "n_dropped")
    names = kept.columns
    joined = kept.join(lost, F.col("doc_id") == F.col("__of"), "left").drop("__of")
    schema = T.StructType([*kept.schema, T.StructField("n_lines", T.LongType()), T.StructField("n_dropped", T.LongType())])

    def rewrite(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wanted = arrow_schema(schema)
        for batch in batches:
            texts, n_lines, n_dropped = [], [], []
            raw = batch.column("text").cast(pa.large_binary()).to_pylist()
            for text, gone in zip(raw, batch.column("__lost").to_pylist(), strict=True):
                body = text or b""
                n_lines.append(body.count(b"\n") + 1)
                n = 0
                if gone:
                    drop = {np.array([x["hi"], x["lo"]], "<i8").tobytes() for x in gone}
                    all_lines = body.split(b"\n")
                    keep = [x for x, key in zip(all_lines, keys_of(body, min_chars), strict=True) if key not in drop]
                    n, text = len(all_lines) - len(keep), b"\n".join(keep)
                texts.append(text)
                n_dropped.append(n)
            columns = [
                pa.array(texts, pa.large_binary()).cast(wanted.field("text").type) if name == "text" else batch.column(name)
                for name in names
            ]
            yield pa.RecordBatch.from_arrays(
                [*columns, pa.array(n_lines, pa.int64()), pa.array(n_dropped, pa.int64())], schema=wanted
            )

    return joined.mapInArrow(rewrite, schema)


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "text")
    kept = hex_digest(F.coalesce("text", F.lit("")))
    return dedup_lines(docs).select("doc_id", "n_lines", "n_dropped", kept.alias("kept_sha256"))


OP1_SQL = """
WITH lines AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
    generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS i
  FROM documents
),
keyed AS (
  SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
  FROM lines
),
shared AS (
  SELECT key, max(doc_id) AS owner FROM keyed WHERE length(key) >= 40
  GROUP BY key HAVING count(DISTINCT doc_id) >= 5
),
judged AS (
  SELECT k.doc_id, i, line, owner IS NOT NULL AND owner <> k.doc_id AS dropped FROM keyed k LEFT JOIN shared USING (key)
)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (dropped) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (NOT dropped), '')) AS kept_sha256
FROM judged GROUP BY doc_id
"""
