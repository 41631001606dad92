"""Byte-level BPE by a rank file, as recursive DuckDB queries inside each partition.

Texts are cut into words by the tokenizer's pattern (``pretokens.py``), and every distinct word is encoded once per
partition (for bounded memory, once per filling of a cache). A batch of words becomes a table of token-position
rows, one row for each byte. The recursive query joins neighbouring rows to the merge table, finds each word's leftmost
pair of minimum rank, contracts it, and goes on with the words that had such a pair. A word that is itself in the
vocabulary is that token.

Words of over ``LONG_WORD`` bytes would need as many steps as bytes. For these, a step contracts every pair that no
other contraction can reach first (see ``_LONG``), with the same result.

Decoding joins id-position rows to the vocabulary and concatenates by an ordered aggregate.
"""

from __future__ import annotations

import base64
import os
import tempfile
import uuid
from collections.abc import Iterator
from functools import cached_property, partial

import duckdb
import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lakepulse.llm.pretokens import Cache, WordEncoder, class_table, slices
from lakepulse.llm.text import arrow_schema, documents, hex_digest, raw_texts

VOCABULARY = "byte_bpe_50k.tiktoken"
#: Bytes of words in a query, and entries and bytes of a cache. They bound memory; results don't depend on them.
QUERY_BYTES = 200_000
CACHE_ENTRIES = 300_000
CACHE_BYTES = 14_000_000
#: Bytes of texts that are taken out of Arrow and handed on at a time.
SLICE_BYTES = 750_000
DUCKDB_MEMORY = "120MB"
LONG_WORD = 300

# k is the word's number and the position in the word; code is a pair's rank and its position.
_WORDS = """
WITH RECURSIVE step(k, tok, live) AS (
  SELECT k, tok, true FROM start
  UNION ALL (
    WITH paired AS (
      SELECT k, tok, lead(tok) OVER w AS right_tok, lead(k) OVER w AS right_k FROM step WHERE live WINDOW w AS (ORDER BY k)
    ),
    ranked AS MATERIALIZED (
      SELECT k, tok, right_k, (merges.rank << 32) | (k & 4294967295) AS code
      FROM paired LEFT JOIN merges ON merges.pair =
        CASE WHEN right_k >> 32 = k >> 32 THEN (tok::BIGINT << 32) | right_tok END
    ),
    best AS (SELECT k >> 32 AS word, min(code) AS best, arg_min(right_k, code) AS taken FROM ranked GROUP BY ALL)
    SELECT k, CASE WHEN code = best THEN (best >> 32)::INTEGER ELSE tok END, best IS NOT NULL
    FROM ranked JOIN best ON word = k >> 32 WHERE taken IS NULL OR k <> taken
  )
)
SELECT k >> 32 AS word, list(tok ORDER BY k) AS ids FROM step WHERE NOT live GROUP BY word
"""

# A contraction depends on what stands within twice the longest token's bytes: a token that grows from further away
# can't become a neighbour before it is full. So a pair may go first if no pair in that reach has a lower rank, nor
# the same rank further left. Equal pairs may go together, from the left and not overlapping, if no token that the
# new one begins or ends has a lower rank (``calm``) and nothing lower is in reach of the run's earlier pairs either.
# The longest token is the longest that the word holds anywhere; ``reach`` is three times its bytes.
_LONG = """
WITH RECURSIVE step(word, pos, tok, live) AS (
  SELECT k >> 32, k & 4294967295, tok, true FROM start
  UNION ALL (
    WITH paired AS (
      SELECT word, pos, tok, lead(tok) OVER w AS right_tok FROM step WHERE live WINDOW w AS (PARTITION BY word ORDER BY pos)
    ),
    ranked AS (
      SELECT p.*, m.rank, m.calm, (m.rank << 32) | pos AS code
      FROM paired p LEFT JOIN merges m ON m.pair = (tok::BIGINT << 32) | right_tok
    ),
    seen AS (
      SELECT *, min(code) OVER reach AS low, lag(rank) OVER w IS DISTINCT FROM rank AS starts
      FROM ranked
      WINDOW w AS (PARTITION BY word ORDER BY pos),
        reach AS (PARTITION BY word ORDER BY pos RANGE BETWEEN {reach} PRECEDING AND {reach} FOLLOWING)
    ),
    runs AS (
      SELECT *, sum(starts::INTEGER) OVER (PARTITION BY word ORDER BY pos ROWS UNBOUNDED PRECEDING) AS run FROM seen
    ),
    judged AS (
      SELECT *, row_number() OVER r % 2 = 1 AND bool_and(coalesce(low >> 32 = rank, false)) OVER r AS together,
        count(rank) OVER (PARTITION BY word) > 0 AS goes_on
      FROM runs WINDOW r AS (PARTITION BY word, run ORDER BY pos ROWS UNBOUNDED PRECEDING)
    ),
    chosen AS (SELECT *, coalesce(code = low OR calm AND together, false) AS first FROM judged),
    marked AS (SELECT *, lag(first) OVER (PARTITION BY word ORDER BY pos) AS taken FROM chosen)
    SELECT word, pos, CASE WHEN first THEN rank ELSE tok END, goes_on FROM marked WHERE taken IS NULL OR NOT taken
  )
)
SELECT word, list(tok ORDER BY pos) AS ids FROM step WHERE NOT live GROUP BY word
"""

_DECODE = """
SELECT k >> 32 AS sequence, string_agg(bytes, '' ORDER BY k) AS decoded
FROM start JOIN vocabulary USING (tok) GROUP BY ALL
"""


class Vocabulary:
    """A rank file: one line for each token, its bytes in base64 and its rank, which is its id."""

    def __init__(self, content: bytes) -> None:
        pairs = (line.split() for line in content.splitlines() if line)
        self.ranks = {base64.b64decode(token): int(rank) for token, rank in pairs}

    @cached_property
    def starts(self) -> set[bytes]:
        """What longer tokens begin with; only needed for long words."""
        return {token[:n] for token in self.ranks for n in range(1, len(token))}

    def longest_in(self, word: bytes) -> int:
        """The most bytes of a token that the word holds somewhere."""
        most = 1
        for i in range(len(word)):
            n = most
            while word[i : i + n] in self.starts and i + n < len(word):
                n += 1
                if word[i : i + n] in self.ranks:
                    most = max(most, n)
        return most

    def merges(self) -> pa.Table:
        """Each pair of tokens that together are a token, with its rank; ``calm``: see ``_LONG``."""
        ranks = self.ranks
        uneasy = set()
        pairs, found = [], []
        for token, rank in ranks.items():
            for cut in range(1, len(token)):
                left, right = ranks.get(token[:cut]), ranks.get(token[cut:])
                uneasy.update(x for x in (left, right) if x is not None and x > rank)
                if left is not None and right is not None:
                    pairs.append((left << 32) | right)
                    found.append(rank)
        calm = [rank not in uneasy for rank in found]
        return pa.table({"pair": pa.array(pairs, pa.int64()), "rank": pa.array(found, pa.int64()), "calm": calm})

    def tokens(self) -> pa.Table:
        """Ids and bytes; a byte is the character of the same number."""
        ids = pa.array(self.ranks.values(), pa.int32())
        return pa.table({"tok": ids, "bytes": [token.decode("latin-1") for token in self.ranks]})


def _database(**tables: pa.Table) -> duckdb.DuckDBPyConnection:
    # DuckDB makes this folder if it must spill, and deletes it when the connection closes.
    spill = os.path.join(tempfile.gettempdir(), f"words-{uuid.uuid4().hex}")
    config = {"threads": 1, "memory_limit": DUCKDB_MEMORY, "preserve_insertion_order": True, "temp_directory": spill}
    con = duckdb.connect(":memory:", config=config)
    for name, table in tables.items():
        con.register("given", table)
        con.execute(f"CREATE TABLE {name} AS SELECT * FROM given")
        con.unregister("given")
    return con


def _start(sizes: np.ndarray, tokens: np.ndarray) -> pa.Table:
    """Token-position rows of words with so many tokens each."""
    first = np.cumsum(sizes) - sizes
    position = np.arange(len(tokens), dtype=np.int64) - np.repeat(first, sizes)
    return pa.table({"k": (np.repeat(np.arange(len(sizes), dtype=np.int64), sizes) << 32) | position, "tok": tokens})


def _result(con: duckdb.DuckDBPyConnection, query: str, start: pa.Table) -> pa.Table:
    con.register("start", start)
    try:
        return con.sql(query).to_arrow_table()
    finally:
        con.unregister("start")


class Merger:
    """Encodes words; their ids are the bytes of little-endian 32-bit integers."""

    def __init__(self, vocabulary: Vocabulary, merges: pa.Table) -> None:
        self.vocabulary, self.ranks = vocabulary, vocabulary.ranks
        self.byte_ids = np.array([self.ranks[bytes([i])] for i in range(256)], np.int32)
        self.con = _database(merges=merges)

    def _merge(self, words: list[bytes], query: str, cache: Cache) -> None:
        for i, j in slices([len(w) for w in words], QUERY_BYTES):
            part = words[i:j]
            tokens = self.byte_ids[np.frombuffer(b"".join(part), np.uint8)]
            found = _result(self.con, query, _start(np.array([len(w) for w in part]), tokens))
            ids = found["ids"].combine_chunks()
            ends = (4 * ids.offsets.to_numpy().astype(np.int64)).tolist()
            flat = ids.values.to_numpy(zero_copy_only=False).astype("<i4").tobytes()
            for n, word in enumerate(found["word"].to_pylist()):
                cache.keep(part[word], flat[ends[n] : ends[n + 1]])

    def learn(self, words: list[bytes], cache: Cache) -> None:
        rest = []
        for word in words:
            rank = self.ranks.get(word)
            if rank is None:
                rest.append(word)
            else:
                cache.keep(word, rank.to_bytes(4, "little"))
        self._merge([w for w in rest if len(w) <= LONG_WORD], _WORDS, cache)
        by_reach: dict[int, list[bytes]] = {}
        for word in rest:
            if len(word) > LONG_WORD:
                by_reach.setdefault(3 * self.vocabulary.longest_in(word), []).append(word)
        for reach, long in by_reach.items():
            self._merge(long, _LONG.format(reach=reach), cache)


class Decoder:
    """Ids to the bytes they stand for."""

    def __init__(self, tokens: pa.Table) -> None:
        self.con = _database(vocabulary=tokens)
        self.known = np.zeros(max(tokens["tok"].to_pylist(), default=-1) + 1, bool)
        self.known[tokens["tok"].to_numpy()] = True

    def decode(self, ids: np.ndarray, sizes: np.ndarray) -> list[bytes]:
        """The bytes of sequences that lie one after the other in ``ids``, with so many ids each."""
        if len(ids) and (ids.min() < 0 or ids.max() >= len(self.known) or not self.known[ids].all()):
            raise ValueError("an id isn't in the vocabulary")
        out = [b""] * len(sizes)
        found = _result(self.con, _DECODE, _start(sizes, ids))
        for sequence, text in zip(found["sequence"].to_pylist(), found["decoded"].to_pylist(), strict=True):
            out[sequence] = text.encode("latin-1")
        return out


class Tokenizer:
    """``encode``, ``decode`` or both over a DataFrame, by the rank file at ``path`` (read on the driver)."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        with open(path, "rb") as file:
            content = file.read()
        vocabulary = Vocabulary(content)
        # One vocabulary and one table of characters: their sizes don't depend on the data.
        self.shared = spark.sparkContext.broadcast((content, vocabulary.merges(), vocabulary.tokens(), class_table()))

    def _add(self, df: DataFrame, source: str, ids: bool, decoded: bool) -> DataFrame:
        added = [T.StructField("ids", T.ArrayType(T.IntegerType()))] * ids + [T.StructField("decoded", T.BinaryType())] * decoded
        kept = df.drop(*[f.name for f in added])
        schema = T.StructType([*kept.schema, *added])
        return kept.mapInArrow(partial(_add_columns, self.shared, source, schema, kept.columns, ids, decoded), schema)

    def encode(self, docs: DataFrame) -> DataFrame:
        """``docs`` with ``ids`` of the whole ``text``; a null text has no ids."""
        return self._add(docs, "text", True, False)

    def decode(self, tokens: DataFrame) -> DataFrame:
        """``tokens`` with the bytes that ``ids`` stand for; null ids give no bytes, an unknown id is an error."""
        return self._add(tokens, "ids", False, True)

    def round_trip(self, docs: DataFrame) -> DataFrame:
        """``docs`` with ``ids``, and with ``decoded`` made from these ids alone, in one pass."""
        return self._add(docs, "text", True, True)


def _add_columns(shared, source, schema, names, ids, decoded, batches) -> Iterator[pa.RecordBatch]:
    content, merges, tokens, classes = shared.value
    encoder = WordEncoder(classes, Merger(Vocabulary(content), merges).learn, CACHE_ENTRIES, CACHE_BYTES) if ids else None
    decoder = Decoder(tokens) if decoded else None
    wanted = arrow_schema(schema)
    for whole in batches:
        column = whole.column(source)
        sizes = pc.binary_length(column) if ids else pc.list_value_length(column)
        for i, j in slices((sizes.fill_null(0).to_numpy() + 1).tolist(), SLICE_BYTES):
            batch, part = whole.slice(i, j - i), column.slice(i, j - i)
            columns = [batch.column(c) for c in names]
            if ids:
                flat, sizes = encoder.encode([x.decode("utf-8", "replace") for x in raw_texts(part)])
                columns.append(pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]), pa.int32()), pa.array(flat)))
            else:
                given = [np.array(x or [], "<i4") for x in part.to_pylist()]
                flat, sizes = np.concatenate(given), np.array([len(x) for x in given])
            if decoded:
                columns.append(pa.array(decoder.decode(flat, sizes), pa.binary()))
            yield pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip(columns, wanted, strict=True)], schema=wanted)


def digests(tokens: DataFrame, *others: str) -> DataFrame:
    """``doc_id`` and other columns, the number of ids, and the digests of the ids and of what they decode to."""
    return tokens.select(
        "doc_id",
        *others,
        F.size("ids").cast("long").alias("n_tokens"),
        hex_digest(F.concat_ws(" ", F.col("ids").cast("array<string>"))).alias("ids_sha256"),
        hex_digest("decoded").alias("decoded_sha256"),
    )


def op5_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A null text is empty; rows are independent, so repeated rows and ids give repeated results."""
    docs = documents(spark, sf_dir).select("doc_id", "text")
    return digests(Tokenizer(spark, public_tokenizers.path(VOCABULARY)).round_trip(docs))
