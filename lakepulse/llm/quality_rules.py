"""Quality rules on repetition: the share of a text's characters inside repeated n-grams and lines.

Words become integers, and a rolling hash gives each window of n words a 64-bit number, for several n at a
time: the hash of n + 1 words is that of n words, times a base, plus the next word. Windows with equal hashes
are compared word by word with the first of them, so a chance hit never counts. A window of n + 1 words that
repeats begins with a repeated one of n, so each length looks only at what the shorter one has found.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lakepulse.llm.text import WHITE, arrow_schema, code_points, documents, raw_texts

SYMBOLS = b"#*$%&|<>"
MIN_WORDS = 50
#: At most so many percent of the words may be in repeated windows of three.
MAX_REPEAT_PERCENT = 50
#: Characters that repeated windows may cover in any text, their first occurrence included: a short passage twice.
ALLOWED_CHARS = 600
#: What they cover beyond that, by their number of words, as a share of the words' characters.
MAX_COVERED = {5: 0.15, 7: 0.13, 10: 0.10}
#: Share of the characters of lines that may be in copies of earlier lines.
MAX_LINE_COPIES = 0.30

_BASE = np.uint64(0x9E3779B97F4A7C15)
_MIX = np.uint64(0xBF58476D1CE4E5B9)


def _repeated(ids: np.ndarray, hashes: np.ndarray, at: np.ndarray, n: int) -> np.ndarray:
    """Those of the windows ``at`` whose n words are found in another of them as well, in order."""
    order = np.argsort(hashes, kind="stable")
    sorted_hashes = hashes[order]
    new = np.ones(len(order), bool)
    new[1:] = sorted_hashes[1:] != sorted_hashes[:-1]
    group = np.cumsum(new) - 1
    size = np.bincount(group)
    many = size[group] > 1
    members = at[order][many]
    firsts = at[order][np.flatnonzero(new)][group[many]]
    same = np.ones(len(members), bool)
    for j in range(n):
        same &= ids[members + j] == ids[firsts + j]
    if same.all():
        return np.sort(members)
    windows = np.lib.stride_tricks.sliding_window_view(ids, n)[np.sort(members)]
    _, inverse, counts = np.unique(windows, axis=0, return_inverse=True, return_counts=True)
    return np.sort(members)[counts[inverse.ravel()] > 1]


def _covered(at: np.ndarray, n: int, n_words: int) -> np.ndarray:
    """Which words the windows ``at`` of n words cover."""
    edges = np.zeros(n_words + 1, np.int64)
    edges[at] += 1
    edges[at + n] -= 1
    return np.cumsum(edges)[:-1] > 0


def coverage(words: list[bytes], lengths: list[int]) -> dict[int, np.ndarray]:
    """For each length the words (as a mask) inside windows of that length that the text has twice or more."""
    numbers: dict[bytes, int] = {}
    ids = np.fromiter((numbers.setdefault(w, len(numbers)) for w in words), np.int64, len(words))
    value = (ids.astype(np.uint64) + np.uint64(1)) * _MIX
    value ^= value >> np.uint64(29)
    out = {}
    hashes, at = value, np.arange(len(ids))
    for n in range(1, max(lengths) + 1):
        if n > 1:
            fits = at + n <= len(ids)
            at, hashes = at[fits], hashes[fits]
            hashes = hashes * _BASE + value[at + n - 1]
        at_repeated = _repeated(ids, hashes, at, n)
        hashes = hashes[np.searchsorted(at, at_repeated)]
        at = at_repeated
        if n in lengths:
            out[n] = _covered(at, n, len(ids))
    return out


def measure(raw: bytes, lengths: list[int]) -> dict[str, float]:
    words = raw.split()
    sizes = np.fromiter(map(code_points, words), np.int64, len(words))
    word_chars = int(sizes.sum())
    masks = coverage(words, sorted({3, *lengths}))
    lines = [line for line in raw.split(b"\n") if line.strip(WHITE)]
    seen: set[bytes] = set()
    copied, line_chars = 0, 0
    for line in lines:
        chars = code_points(line)
        line_chars += chars
        if line in seen:
            copied += chars
        seen.add(line)
    return {
        "n_words": len(words),
        "word_chars": word_chars,
        "n_symbols": sum(raw.count(SYMBOLS[i : i + 1]) for i in range(len(SYMBOLS))),
        "n_dup_lines": len(lines) - len(seen),
        "n_repeat_words": int(masks[3].sum()),
        **{f"covered_{n}": float(sizes[masks[n]].sum()) / max(1, word_chars) for n in lengths},
        "line_copies": copied / max(1, line_chars),
    }


def quality_rules(
    docs: DataFrame,
    min_words: int = MIN_WORDS,
    max_repeat_percent: int = MAX_REPEAT_PERCENT,
    max_covered: dict[int, float] | None = None,
    max_line_copies: float = MAX_LINE_COPIES,
    allowed_chars: int = ALLOWED_CHARS,
) -> DataFrame:
    """``docs`` with its measures, ``base_failed`` and ``kept`` behind its columns; no row is dropped.

    Measures are ``n_words``, ``word_chars``, ``n_symbols``, ``n_dup_lines``, ``n_repeat_words`` (long), ``covered_<n>``
    and ``line_copies`` (shares from 0 to 1). ``allowed_chars`` of what is covered never count against a text. A null or empty text has no words, so it fails; each row is judged by
    its own text, whatever its other columns hold. Columns of ``docs`` with these names are replaced. An empty
    table gives an empty table.
    """
    limits = MAX_COVERED if max_covered is None else max_covered
    lengths = sorted(limits)
    counts = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    shares = [*[f"covered_{n}" for n in lengths], "line_copies"]
    own = docs.drop(*counts, *shares, "base_failed", "kept")
    names = own.columns
    schema = T.StructType(
        [
            *own.schema,
            *[T.StructField(c, T.LongType()) for c in counts],
            *[T.StructField(c, T.DoubleType()) for c in shares],
        ]
    )

    def measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wanted = arrow_schema(schema)
        for batch in batches:
            rows = [measure(raw, lengths) for raw in raw_texts(batch.column("text"))]
            columns = [pa.array([r[c] for r in rows], wanted.field(c).type) for c in [*counts, *shares]]
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in names], *columns], schema=wanted)

    base = (F.col("n_words") < min_words) | (100 * F.col("n_repeat_words") > max_repeat_percent * F.col("n_words"))
    fine = F.col("line_copies") <= max_line_copies
    for n in lengths:
        fine &= F.col(f"covered_{n}") * F.col("word_chars") - allowed_chars <= limits[n] * F.col("word_chars")
    return (
        own.mapInArrow(measured, schema)
        .withColumn("base_failed", base)
        .withColumn("kept", ~F.col("base_failed") & fine)
    )


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "text")
    return quality_rules(docs).drop("text")
