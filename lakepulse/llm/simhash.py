"""Near-duplicates by SimHash, with fingerprints compared bit plane by bit plane.

Texts with equal fingerprints form one class, so that copies cost nothing below. Classes are linked if their
fingerprints differ in few bits:

1. The 64 bits are cut into blocks. Two fingerprints within the radius agree in ``blocks - radius`` of them at
   least, so each choice of that many blocks deals the fingerprints into groups, and every link is inside
   some group. A group that is still large is dealt again, by the bits that its members need not share.
2. Inside a group the fingerprints are stored vertically: a plane holds one bit of 64 fingerprints in a
   word. Planes are added to the distances of many pairs at a time by carry-save adders whose counters are
   bit planes too; a block of pairs is given up as soon as all its distances exceed the radius.
3. Groups larger than a tile are compared tile by tile, each pair of tiles in its own place.
4. Each comparison hands on the edges of a spanning forest. Connected components are then found by rounds of
   joins, each round written to the shared folder.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lakepulse.llm.components import components
from lakepulse.llm.text import documents, raw_texts
from lakepulse.session import written

WORDS = 4
SEED = 42
RADIUS = 4
#: Fingerprints in a group that are compared at one place.
TILE = 4096
#: Distinct fingerprints that a group may have on average, if bits were even; sets the number of blocks.
GROUP = 16
MAX_REDEALS = 2

_ONES = np.uint64(2**64 - 1)
_SLICE = 1 << 16


def fingerprint(raw: bytes, n_words: int = WORDS, seed: int = SEED) -> int:
    """64 bits, each set if over half of the shingles' hashes have it set; 0 without words."""
    words = raw.lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    if len(words) <= n_words:
        return xxhash.xxh64_intdigest(joined, seed)
    ends = list(itertools.accumulate(len(w) + 1 for w in words))
    starts = [0, *ends[: len(words) - n_words]]
    digest = xxhash.xxh64_intdigest
    set_bits = np.zeros(64, np.int64)
    for i in range(0, len(starts), _SLICE):
        spans = zip(starts[i : i + _SLICE], ends[i + n_words - 1 : i + n_words - 1 + _SLICE], strict=True)
        hashes = np.array([digest(joined[a : b - 1], seed) for a, b in spans], "<u8")
        set_bits += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * set_bits > len(starts), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, n_words: int = WORDS, seed: int = SEED) -> DataFrame:
    """``doc_id, fp`` for each row; ``fp`` is the fingerprint as a signed long."""

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = np.array([fingerprint(x, n_words, seed) for x in raw_texts(batch.column("text"))], np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(found.view(np.int64))], ["doc_id", "fp"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(hashed, "doc_id long, fp long")


def planes(values: np.ndarray) -> np.ndarray:
    """64 rows, bit planes of the values; the values lie along the bits of 64-bit words."""
    padded = np.zeros(64 * math.ceil(len(values) / 64), "<u8")
    padded[: len(values)] = values
    bits = np.unpackbits(padded.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    return np.ascontiguousarray(np.packbits(bits.T, axis=1, bitorder="little")).view("<u8")


def near(differences: Iterator[tuple[np.ndarray, np.ndarray]], shape: tuple[int, int], radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows still in question, and for these the lanes with at most ``radius`` differing bits.

    ``differences(rows)`` yields pairs of planes with a 1 where a lane differs. The counters ones, twos and fours
    are planes; what carries out of them, or stands above the radius, marks a lane as over for good. Rows whose
    lanes are all over are abandoned.
    """
    rows = np.arange(shape[0])
    ones, twos, fours, over = (np.zeros(shape, np.uint64) for _ in range(4))
    for step, (a, b) in enumerate(differences):
        a, b = (x if len(x) == 1 or len(x) == len(rows) else x[rows] for x in (a, b))
        half = a ^ b
        carry = (a & b) | (ones & half)
        ones = ones ^ half
        more = twos & carry
        twos = twos ^ carry
        over |= fours & more
        fours ^= more
        if step % 4 == 3:
            over |= _above(ones, twos, fours, radius)
            open_rows = (over != _ONES).any(axis=1)
            if not open_rows.any():
                return rows[:0], over[:0]
            if open_rows.sum() < 0.7 * len(rows):
                rows = rows[open_rows]
                ones, twos, fours, over = (x[open_rows] for x in (ones, twos, fours, over))
    return rows, ~(over | _above(ones, twos, fours, radius))


def _above(ones: np.ndarray, twos: np.ndarray, fours: np.ndarray, radius: int) -> np.ndarray:
    """Lanes whose three-bit counter is over the radius, compared from the highest bit down."""
    above, equal = np.zeros_like(ones), np.full_like(ones, _ONES)
    for counter, bit in ((fours, 4), (twos, 2), (ones, 1)):
        if radius & bit:
            equal = equal & counter
        else:
            above |= equal & counter
            equal = equal & ~counter
    return above


def _lanes(found: np.ndarray, n: int) -> np.ndarray:
    return np.unpackbits(np.ascontiguousarray(found).view(np.uint8), axis=1, bitorder="little", count=n)


def links_between(left: np.ndarray, right: np.ndarray, radius: int, block: int = 256) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Index pairs of near values, block by block of the left ones."""
    down = planes(right)
    for i in range(0, len(left), block):
        mine = left[i : i + block]

        def differences(mine: np.ndarray = mine) -> Iterator[tuple[np.ndarray, np.ndarray]]:
            masks = (((mine[:, None] >> np.arange(64, dtype=np.uint64)) & np.uint64(1)) * _ONES).astype(np.uint64)
            for bit in range(0, 64, 2):
                yield down[bit] ^ masks[:, bit : bit + 1], down[bit + 1] ^ masks[:, bit + 1 : bit + 2]

        rows, found = near(differences(), (len(mine), down.shape[1]), radius)
        if len(rows):
            a, b = np.nonzero(_lanes(found, len(right)))
            yield i + rows[a], b


def near_pairs(left: np.ndarray, right: np.ndarray, radius: int) -> np.ndarray:
    """Which of the pairs (left[i], right[i]) are near; 64 pairs lie in a word."""
    lanes = planes(left ^ right)
    words = 64  # a row of the comparison has 4,096 pairs
    n_rows = math.ceil(lanes.shape[1] / words)
    padded = np.full((64, n_rows * words), _ONES)
    padded[:, : lanes.shape[1]] = lanes
    padded = padded.reshape(64, n_rows, words)
    rows, found = near(((padded[bit], padded[bit + 1]) for bit in range(0, 64, 2)), (n_rows, words), radius)
    out = np.zeros((n_rows, words * 64), bool)
    if len(rows):
        out[rows] = _lanes(found, words * 64).astype(bool)
    return out.ravel()[: len(left)]


class Forest:
    """Union of value indices; ``edges`` joins each member of a tree to the tree's first member."""

    def __init__(self, n: int) -> None:
        self.root = np.arange(n)

    def unite(self, a: np.ndarray, b: np.ndarray) -> None:
        while len(a):
            x, y = self.root[a], self.root[b]
            apart = x != y
            a, b, x, y = a[apart], b[apart], x[apart], y[apart]
            if not len(a):
                return
            np.minimum.at(self.root, np.maximum(x, y), np.minimum(x, y))
            while (self.root[self.root] != self.root).any():
                self.root = self.root[self.root]

    def edges(self) -> tuple[np.ndarray, np.ndarray]:
        member = np.flatnonzero(self.root != np.arange(len(self.root)))
        return member, self.root[member]


def _grouped(values: np.ndarray, first: np.ndarray, sizes: np.ndarray, radius: int, most: int = 1 << 18) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Near pairs inside small groups that lie one after the other."""
    group_end = np.repeat(first + sizes, sizes)
    at = np.arange(len(values))
    step = 1
    while True:
        a = at[at + step < group_end]
        if not len(a):
            return
        for i in range(0, len(a), most):
            part = a[i : i + most]
            hit = part[near_pairs(values[part], values[part + step], radius)]
            yield hit, hit + step
        step += 1


def _compare(radius: int, small: int = 64):
    keys = ["mask", "value", "low", "high"]

    def edges_of(groups: list[np.ndarray], sides: list[np.ndarray], tiles: list[tuple]) -> Iterator[pa.RecordBatch]:
        """``groups`` are values of one (group, pair of tiles) each."""
        few = [i for i, g in enumerate(groups) if len(g) < small and tiles[i][2] == tiles[i][3]]
        found: list[tuple[np.ndarray, np.ndarray]] = []
        if few:
            values = np.concatenate([groups[i] for i in few])
            sizes = np.array([len(groups[i]) for i in few])
            forest = Forest(len(values))
            for a, b in _grouped(values, np.cumsum(sizes) - sizes, sizes, radius):
                forest.unite(a, b)
            a, b = forest.edges()
            found.append((values[a], values[b]))
        for i in sorted({*range(len(groups))} - {*few}):
            values, (_, _, low, high) = groups[i], tiles[i]
            forest = Forest(len(values))
            if low == high:
                for a, b in links_between(values, values, radius):
                    forest.unite(a, b)
            else:
                left, right = np.flatnonzero(sides[i] == low), np.flatnonzero(sides[i] == high)
                for a, b in links_between(values[left], values[right], radius):
                    forest.unite(left[a], right[b])
            a, b = forest.edges()
            found.append((values[a], values[b]))
        a, b = (np.concatenate([f[k] for f in found]).view(np.int64) for k in (0, 1))
        yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come by group and pair of tiles; the last group of a batch may go on in the next."""
        rest: list[np.ndarray] | None = None
        for batch in batches:
            columns = [batch.column(c).to_numpy(zero_copy_only=False) for c in [*keys, "side", "fp"]]
            if rest is not None:
                columns = [np.concatenate([x, y]) for x, y in zip(rest, columns, strict=True)]
            if not len(columns[0]):
                continue
            cut = np.flatnonzero(np.any([c[1:] != c[:-1] for c in columns[:4]], axis=0)) + 1
            if len(cut):
                yield from whole([c[: cut[-1]] for c in columns], cut[:-1])
            rest = [c[cut[-1] if len(cut) else 0 :] for c in columns]
        if rest is not None and len(rest[0]):
            yield from whole(rest, np.zeros(0, np.int64))

    def whole(columns: list[np.ndarray], cut: np.ndarray) -> Iterator[pa.RecordBatch]:
        starts = np.concatenate([[0], cut]).astype(np.int64)
        tiles = list(zip(*[c[starts].tolist() for c in columns[:4]], strict=True))
        groups = np.split(np.ascontiguousarray(columns[5]).view(np.uint64), cut)
        yield from edges_of(groups, np.split(columns[4], cut), tiles)

    return compare


def _signed(mask: int) -> int:
    return mask - 2**64 if mask >= 2**63 else mask


def _sum_bits(part: np.ndarray) -> int:
    return sum(1 << int(b) for b in part)


def block_masks(bits: list[int], blocks: int, radius: int) -> list[int]:
    cuts = [_sum_bits(part) for part in np.array_split(np.array(bits), blocks)]
    return [_signed(sum(choice)) for choice in itertools.combinations(cuts, blocks - radius)]


def _dealt(fps: DataFrame, masks: Column) -> DataFrame:
    dealt = fps.select("fp", F.explode(masks).alias("mask"))
    return dealt.select("mask", F.col("fp").bitwiseAND(F.col("mask")).alias("value"), "fp")


def _sized(rows: DataFrame) -> DataFrame:
    """Rows of groups of two or more, with the group's size."""
    sizes = rows.groupBy("mask", "value").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    return rows.join(sizes, ["mask", "value"])


def links(fps: DataFrame, n: int, radius: int = RADIUS, tile: int = TILE, group: int = GROUP, blocks: int | None = None) -> DataFrame:
    """``a, b``: edges between distinct fingerprints (column ``fp``, ``n`` rows) that connect all within the radius.

    ``a`` and ``b`` are within the radius through other fingerprints of a group at least. More blocks give more
    and smaller groups; the number follows ``n`` unless given.
    """
    if not 0 <= radius <= 6:
        raise ValueError("three counter planes hold a radius of 0 to 6")
    if blocks is None:
        fits = (b for b in range(radius + 1, radius + 5) if n >> (64 * (b - radius) // b) <= group)
        blocks = next(fits, radius + 4)
    masks = block_masks(list(range(64)), blocks, radius)
    rows = _sized(_dealt(fps, F.array(*map(F.lit, masks))))
    ready = []
    for _ in range(MAX_REDEALS):
        rows = written(rows, "groups")
        large = rows.where(F.col("n") > tile)
        if large.isEmpty():
            break
        ready.append(rows.where(F.col("n") <= tile))
        found = sorted(r["mask"] for r in large.select("mask").distinct().collect())  # no more than there are masks
        finer = {m: [_signed((m | x) % 2**64) for x in block_masks([b for b in range(64) if not m >> b & 1], radius + 2, radius)] for m in found}
        choice = F.create_map(*[x for m, ms in finer.items() for x in (F.lit(m), F.array(*map(F.lit, ms)))])
        rows = _sized(_dealt(large, choice[F.col("mask")]).distinct())
        masks = sorted({m for ms in finer.values() for m in ms})
    for part in ready:
        rows = rows.unionByName(part)
    tiles = F.ceil(F.col("n") / tile)
    side = F.pmod(F.xxhash64("fp"), tiles)
    placed = rows.select("mask", "value", "fp", side.alias("side"), F.explode(F.sequence(F.lit(0), tiles - 1)).alias("other"))
    placed = placed.select(
        "mask", "value", F.least("side", "other").alias("low"), F.greatest("side", "other").alias("high"), "side", "fp"
    )
    keys = ["mask", "value", "low", "high"]
    parts = int(fps.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return placed.repartition(parts, *keys).sortWithinPartitions(*keys).mapInArrow(_compare(radius), "a long, b long")


def near_duplicates(docs: DataFrame, n_words: int = WORDS, seed: int = SEED, radius: int = RADIUS) -> DataFrame:
    """``doc_id, fp, component_id``: one row for each row of ``docs``.

    ``component_id`` is the smallest ``doc_id`` that links of at most ``radius`` bits reach, the row's own included.
    Texts without words (null, empty, white space) have fingerprint 0 and are linked like any other. Shorter texts
    than a shingle are one shingle. A row without ``doc_id`` links others, and gets the smallest id reached, null if
    there is none. Repeated rows give repeated rows. An empty table gives an empty table.
    """
    of_docs = written(fingerprints(docs, n_words, seed), "fingerprints")
    classes = written(of_docs.groupBy("fp").agg(F.min("doc_id").alias("first")), "classes")
    edges = written(links(classes.select("fp"), classes.count(), radius).distinct(), "links")
    labels = components(edges)
    whole = classes.join(labels.withColumnRenamed("node", "fp"), "fp", "left")
    whole = whole.withColumn("label", F.coalesce("label", "fp"))
    smallest = whole.groupBy("label").agg(F.min("first").alias("component_id"))
    of_class = whole.join(smallest, "label").select("fp", "component_id")
    return of_docs.join(of_class, "fp").select("doc_id", "fp", "component_id")


def op10_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(documents(spark, sf_dir))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
