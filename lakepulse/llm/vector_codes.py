"""Vectors as short codes: each part of a vector is the number of its nearest codebook entry, found in whole numbers.

Components are whole 1/1024 (rounded down). Parts and entries are filled up with zeros to a power of two and transformed by
Walsh and Hadamard, with additions alone. The transform keeps squared distances but for that power of two as a factor, and
gathers a smooth part's energy in its first coefficients by sequency. So squared differences are added up in that order; an
entry whose sum so far is above a distance already reached goes. No floating point is used, so ties are ties.

A round deals the codebooks to all tasks, and adds up the parts of each entry: in the task first, then by a shuffle of as many
rows as entries and tasks. Codebooks (256 entries a part) and their sums alone come to the driver.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lakepulse.session import written

PARTS = 4
ENTRIES = 256
ROUNDS = 4
SCALE = 1024
#: Larger whole numbers are cut to this, so that sums of squares stay within 64 bits.
MOST = 2**26 - 1
#: Rows handled at a time, coefficients between two looks at who is left, and the share left below which pairs are listed.
ROWS = 256
STEP = 4
FEW = 0.25


def sequency_order(size: int) -> np.ndarray:
    """Of the rows of the Hadamard matrix of a power of two, those with fewest changes of sign first."""
    width = size.bit_length() - 1
    codes = [s ^ (s >> 1) for s in range(size)]
    return np.array([int(f"{c:0{width}b}"[::-1], 2) if width else 0 for c in codes])


def transformed(rows: np.ndarray) -> np.ndarray:
    """The Walsh-Hadamard transform of each row (filled up with zeros), by sequency."""
    size = 1 << max(0, rows.shape[1] - 1).bit_length()
    out = np.zeros((len(rows), size), np.int64)
    out[:, : rows.shape[1]] = rows
    half = 1
    while half < size:
        pairs = out.reshape(len(rows), size // (2 * half), 2, half)
        out = np.stack([pairs[:, :, 0] + pairs[:, :, 1], pairs[:, :, 0] - pairs[:, :, 1]], axis=2).reshape(len(rows), size)
        half *= 2
    return out[:, sequency_order(size)]


def _narrow(parts: np.ndarray, entries: np.ndarray) -> type:
    """32 bits where no scaled distance can go beyond: (|x| + |c|)^2 <= 2 (|x|^2 + |c|^2)."""
    most = sum(int((x * x).sum(axis=1).max(initial=0)) for x in (parts, entries))
    return np.int32 if 2 * most < 2**31 else np.int64


def nearest(parts: np.ndarray, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each row of ``parts`` the nearest of ``entries`` (the first of the nearest) and the squared distance."""
    x, c = transformed(parts), transformed(entries)
    size = x.shape[1]
    kind = _narrow(x, c)
    x, c = x.astype(kind), c.astype(kind)
    found = [_nearest(x[i : i + ROWS], c) for i in range(0, len(x), ROWS)]
    numbers, sums = (np.concatenate([f[k] for f in found]) if found else np.zeros(0, np.int64) for k in (0, 1))
    return numbers.astype(np.int64), sums.astype(np.int64) // size


def _nearest(x: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    rows, columns = np.arange(len(x)), np.ascontiguousarray(c.T)
    sums = np.zeros((len(x), len(c)), x.dtype)
    bound = np.full(len(x), np.iinfo(x.dtype).max, x.dtype)
    for k in range(x.shape[1]):
        if k and k % STEP == 0:
            first = sums.argmin(axis=1)
            rest = x[:, k:] - c[first, k:]
            bound = np.minimum(bound, sums[rows, first] + (rest * rest).sum(axis=1, dtype=x.dtype))
            left = sums <= bound[:, None]
            if left.mean() < FEW:
                return _listed(x, c, sums, left, k, bound)
        gap = x[:, k, None] - columns[k]
        gap *= gap
        sums += gap
    numbers = sums.argmin(axis=1)
    return numbers, sums[rows, numbers]


def _listed(x: np.ndarray, c: np.ndarray, sums: np.ndarray, left: np.ndarray, k: int, bound: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The same from coefficient ``k`` on, for the entries that are left, as pairs of a row and an entry."""
    row, entry = np.nonzero(left)
    now = sums[row, entry]
    while k < x.shape[1]:
        gap = x[row, k : k + STEP] - c[entry, k : k + STEP]
        now = now + (gap * gap).sum(axis=1, dtype=x.dtype)
        k += STEP
        stay = now <= bound[row]
        row, entry, now = row[stay], entry[stay], now[stay]
    first = np.flatnonzero(np.diff(row, prepend=-1))  # each row keeps the entry that gave its bound
    least = np.minimum.reduceat(now, first)
    at = np.flatnonzero(now == least[row])
    at = at[np.unique(row[at], return_index=True)[1]]
    return entry[at], now[at]


@dataclass
class Codebooks:
    """For each part an array of entries; ``width`` components a part."""

    entries: list[np.ndarray]
    width: int

    def sha256(self) -> str:
        text = ",".join(str(v) for part in self.entries for v in part.ravel().tolist())
        return hashlib.sha256(text.encode()).hexdigest()

    def decode(self, code: str) -> list[float]:
        """The vector that a code stands for."""
        numbers = [int(code[2 * p : 2 * p + 2], 16) for p in range(len(self.entries))]
        return [v / SCALE for p, n in zip(self.entries, numbers, strict=True) for v in p[n].tolist()]


def _whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Vectors without null or non-finite components, as whole numbers."""
    for batch in batches:
        vectors = batch.column("vector")
        values = vectors.flatten()
        x = values.cast(pa.float64()).to_numpy(zero_copy_only=False)  # null gives NaN
        sizes = np.diff(vectors.offsets.to_numpy()) if vectors.null_count == 0 else np.array([len(v) if v is not None else 0 for v in vectors.to_pylist()])
        ends = np.concatenate([[0], np.cumsum(sizes)])
        wrong = np.concatenate([[0], np.cumsum(~np.isfinite(x))])
        keep = (wrong[ends[1:]] == wrong[ends[:-1]]) & ~np.asarray(vectors.is_null())
        numbers = np.floor(np.clip(np.nan_to_num(x) * SCALE, -MOST, MOST)).astype(np.int32)
        lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(numbers))
        whole = pa.RecordBatch.from_arrays([batch.column("vec_id"), batch.column("label"), lists], ["vec_id", "label", "v"])
        yield whole.filter(pa.array(keep))


def _matrix(lists: pa.Array, width: int) -> np.ndarray:
    """Vectors as rows of ``PARTS * width`` components, filled up with zeros."""
    values, sizes = lists.flatten().to_numpy(zero_copy_only=False), np.diff(lists.offsets.to_numpy())
    out = np.zeros((len(lists), PARTS * width), np.int64)
    out[np.arange(PARTS * width) < sizes[:, None]] = values
    return out


def _sums(shared):
    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        books, width = shared.value
        totals = [np.zeros((len(b), width), np.int64) for b in books]
        counts = [np.zeros(len(b), np.int64) for b in books]
        for batch in batches:
            rows = _matrix(batch.column("v"), width)
            for p, book in enumerate(books):
                part = rows[:, p * width : (p + 1) * width]
                numbers, _ = nearest(part, book)
                np.add.at(totals[p], numbers, part)
                counts[p] += np.bincount(numbers, minlength=len(book))
        for p, (total, count) in enumerate(zip(totals, counts, strict=True)):
            used = np.flatnonzero(count)
            columns = [np.full(len(used), p), used, count[used], *total[used].T]
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], ["p", "e", "n", *[f"s{i}" for i in range(width)]])

    return sums


def _codes(shared):
    def codes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        books, width = shared.value
        hexes = np.array([f"{i:02x}" for i in range(ENTRIES)])
        for batch in batches:
            rows = _matrix(batch.column("v"), width)
            error = np.zeros(len(rows), np.int64)
            code = np.full(len(rows), "", "U8")
            for p, book in enumerate(books):
                numbers, distances = nearest(rows[:, p * width : (p + 1) * width], book)
                error += distances
                code = np.char.add(code, hexes[numbers])
            columns = [batch.column("vec_id"), batch.column("label"), pa.array(code.tolist(), pa.string()), pa.array(error)]
            yield pa.RecordBatch.from_arrays(columns, ["vec_id", "label", "code", "error"])

    return codes


def whole_vectors(vectors: DataFrame) -> DataFrame:
    """``vec_id, label, v`` of the vectors (``vec_id, label, embedding``) that have no null or non-finite component."""
    label = dict(vectors.dtypes)["label"]
    given = vectors.select(F.col("vec_id").cast("long"), "label", F.col("embedding").cast("array<double>").alias("vector"))
    return given.mapInArrow(_whole, f"vec_id long, label {label}, v array<int>")


def train(whole: DataFrame, rounds: int = ROUNDS) -> Codebooks:
    """Codebooks of ``whole_vectors``, from the first ``ENTRIES`` rows by ``vec_id`` (nulls last) and ``rounds`` rounds.

    Each round puts every part to its nearest entry, and then each entry to its parts' mean, rounded down; an entry
    without parts stays. Rows with the same id are ordered by their vectors. Fewer rows give fewer entries.
    """
    spark = whole.sparkSession
    longest = whole.agg(F.max(F.size("v")).alias("n")).first()["n"] or 0
    width = -(-longest // PARTS)
    start = whole.orderBy(F.col("vec_id").asc_nulls_last(), "v").limit(ENTRIES).select("v").collect()
    first = np.zeros((len(start), PARTS * width), np.int64)
    for row, r in zip(first, start, strict=True):
        row[: len(r["v"])] = r["v"]
    books = [first[:, p * width : (p + 1) * width] for p in range(PARTS)]
    names = [f"s{i}" for i in range(width)]
    for _ in range(rounds if len(first) else 0):
        shared = spark.sparkContext.broadcast((books, width))
        partial = whole.select("v").mapInArrow(_sums(shared), ", ".join(f"{c} long" for c in ("p", "e", "n", *names)))
        # At most PARTS * ENTRIES rows; decimals, as sums over all vectors may go beyond 64 bits.
        found = partial.groupBy("p", "e").agg(F.sum("n").alias("n"), *[F.sum(F.col(c).cast("decimal(38,0)")).alias(c) for c in names]).collect()
        books = [b.copy() for b in books]
        for r in found:
            books[r["p"]][r["e"]] = [int(r[c]) // r["n"] for c in names]
    return Codebooks(books, width)


def encode(whole: DataFrame, books: Codebooks) -> DataFrame:
    """``vec_id, label, code, error``: two hex digits a part, and the squared distances to the entries added up."""
    label = dict(whole.dtypes)["label"]
    schema = f"vec_id long, label {label}, code string, error long"
    shared = whole.sparkSession.sparkContext.broadcast((books.entries, books.width))
    return whole.mapInArrow(_codes(shared), schema)


def vector_codes(vectors: DataFrame, rounds: int = ROUNDS) -> DataFrame:
    """``vec_id, label, code, error, label_error, codebooks_sha256``: a row for each vector that is kept.

    A vector that is null, or has a null or non-finite component, is left out. Vectors are filled up with zeros to the
    longest one's length, and that to a multiple of ``PARTS``; components of 65,536 and more in size are cut to that.
    ``label_error`` adds up the errors of equal labels; rows without label count together. Repeated rows give repeated
    rows; other columns are left out. An empty table gives an empty table.
    """
    whole = written(whole_vectors(vectors), "whole-vectors")
    books = train(whole, rounds)
    coded = written(encode(whole, books), "codes")
    of_label = coded.groupBy(F.col("label").alias("l")).agg(F.sum("error").alias("label_error"))
    rows = coded.join(of_label, F.col("label").eqNullSafe(F.col("l"))).drop("l")
    return rows.withColumn("codebooks_sha256", F.lit(books.sha256()))


def op12_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = vector_codes(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
    return found.select("vec_id", "code", "error", "label_error", "codebooks_sha256")


def _assigned(n: int) -> str:
    distance = "list_sum([(x[i] - c[i]) * (x[i] - c[i]) FOR i IN range(1, len(x) + 1)])"
    return f"""a{n} AS MATERIALIZED (
  SELECT vec_id, p, any_value(x) AS x, min(CAST({distance} AS BIGINT) * {ENTRIES} + e) AS best
  FROM parts JOIN c{n} USING (p) GROUP BY vec_id, p
)"""


def _updated(n: int) -> str:
    return f"""m{n} AS (
  SELECT p, e, list((total - ((total % n) + n) % n) // n ORDER BY i) AS c FROM (
    SELECT p, best % {ENTRIES} AS e, i, CAST(sum(v) AS BIGINT) AS total, count(*) AS n
    FROM (SELECT p, best, unnest(x) AS v, unnest(range(len(x))) AS i FROM a{n}) GROUP BY ALL
  ) GROUP BY p, e
), c{n + 1} AS MATERIALIZED (SELECT p, e, coalesce(m{n}.c, c{n}.c) AS c FROM c{n} LEFT JOIN m{n} USING (p, e))"""


_STEPS = ",\n".join(f"{_assigned(n)}, {_updated(n)}" for n in range(ROUNDS))
OP12_SQL = f"""WITH kept AS (
  SELECT vec_id, label, [CAST(floor({SCALE} * CAST(x AS DOUBLE)) AS BIGINT) FOR x IN embedding] AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0
), parts AS MATERIALIZED (
  SELECT vec_id, p, v[p * (len(v) // {PARTS}) + 1 : (p + 1) * (len(v) // {PARTS})] AS x FROM kept, range({PARTS}) t(p)
), c0 AS MATERIALIZED (
  SELECT p, row_number() OVER w - 1 AS e, x AS c FROM parts
  WINDOW w AS (PARTITION BY p ORDER BY vec_id) QUALIFY row_number() OVER w <= {ENTRIES}
),
{_STEPS},
{_assigned(ROUNDS)}, coded AS (
  SELECT vec_id, string_agg(printf('%02x', best % {ENTRIES}), '' ORDER BY p) AS code, CAST(sum(best // {ENTRIES}) AS BIGINT) AS error
  FROM a{ROUNDS} GROUP BY vec_id
), books AS (
  SELECT sha256(string_agg(array_to_string(c, ','), ',' ORDER BY p, e)) AS codebooks_sha256 FROM c{ROUNDS}
)
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, codebooks_sha256
  FROM coded JOIN (SELECT vec_id, label FROM kept) USING (vec_id), books"""
