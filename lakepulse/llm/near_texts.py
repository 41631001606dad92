"""Near-duplicates by SimHash and min-hash over word shingles: both find candidates, exact sets confirm them.

Texts with equal sets of shingles form one class, so that copies cost nothing below.

1. A class has bands of a few min-hashes each. Two classes of similarity s share a band of r hashes with the
   probability s^r, and so one of b bands with 1 - (1 - s^r)^b: 0.999997 at 0.8 with the values below.
   Classes whose SimHash fingerprints are linked (``simhash.links``, at most its radius of bits) have a bucket in common too.
2. Classes that share a band lie in one bucket. First each is compared with one class, the head that most of its buckets
   have; a bucket of copies of one text is then one component. While buckets that are too large for one task hold several
   components, further rounds try other heads.
3. What is left are buckets of several components. Classes that such buckets connect meet in one task with their sets, or,
   where they are too many, tile by tile of a bucket. There a set is compared with those only that hold one of its rarest
   shingles (two sets of that similarity share one of these), and with no class of its own component. Only links that
   bring components together leave the task, so no table grows with the square of a group.
4. A pair is linked if its sets, of which only candidates' are made, have the similarity asked for. Connected components
   are found by rounds of joins.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lakepulse.llm.components import components
from lakepulse.llm.pretokens import slices
from lakepulse.llm.simhash import RADIUS, fingerprint
from lakepulse.llm.simhash import links as fingerprint_links
from lakepulse.llm.spans import inside
from lakepulse.llm.text import raw_texts
from lakepulse.session import written

WORDS = 5
SIMILARITY = 0.8
SEED = 42
BANDS, ROWS = 24, 4
#: Shingles of the sets that meet in one task; it bounds memory, results don't depend on it.
TILE = 1 << 20

_SLICE = 1 << 10
_SET_WORDS = 1_000_000


def shingles(raw: bytes, n_words: int = WORDS, seed: int = SEED) -> np.ndarray:
    """The distinct hashes, in order, of a text's runs of ``n_words`` words; a shorter text is one run."""
    words = raw.lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    joined = b" ".join(words)
    if len(words) <= n_words:
        return np.array([xxhash.xxh64_intdigest(joined, seed)], np.uint64)
    ends = list(itertools.accumulate(len(w) + 1 for w in words))
    starts = [0, *ends[: len(words) - n_words]]
    digest = xxhash.xxh64_intdigest
    spans = zip(starts, ends[n_words - 1 :], strict=True)
    return np.unique(np.array([digest(joined[a : b - 1], seed) for a, b in spans], np.uint64))


def bands(hashes: np.ndarray, seed: int = SEED) -> list[int]:
    """For each band a signed hash of its min-hashes; no bands without shingles."""
    if not len(hashes):
        return []
    rng = np.random.default_rng(seed)
    add, times = (rng.integers(0, 2**64, BANDS * ROWS, np.uint64, endpoint=False) for _ in range(2))
    least = np.full(BANDS * ROWS, 2**64 - 1, np.uint64)
    for i in range(0, len(hashes), _SLICE):
        mixed = (hashes[i : i + _SLICE, None] ^ add) * (times | np.uint64(1))
        least = np.minimum(least, mixed.min(axis=0))
    digests = [xxhash.xxh64_intdigest(part.tobytes(), band) for band, part in enumerate(least.reshape(BANDS, ROWS))]
    return np.array(digests, np.uint64).view(np.int64).tolist()


def _hashed(n_words: int, seed: int):
    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, sizes, found, marks = [], [], [], []
            for raw in raw_texts(batch.column("text")):
                hashes = shingles(raw, n_words, seed)
                keys.append(xxhash.xxh3_128_digest(hashes.tobytes()))
                sizes.append(len(hashes))
                found.append(bands(hashes, seed))
                marks.append(fingerprint(raw, n_words, seed))
            columns = [batch.column("doc_id"), pa.array(keys, pa.binary()), pa.array(sizes, pa.int64()), pa.array(found, pa.list_(pa.int64()))]
            columns.append(pa.array(np.array(marks, np.uint64).view(np.int64)))
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "key", "n", "bands", "fp"])

    return hashed


def _sets(n_words: int, seed: int):
    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = raw_texts(batch.column("text"))
            for i, j in slices([len(x) // 6 + 1 for x in texts], _SET_WORDS):
                found = [shingles(x, n_words, seed) for x in texts[i:j]]
                keys = pa.array([xxhash.xxh3_128_digest(x.tobytes()) for x in found], pa.binary())
                yield pa.RecordBatch.from_arrays([keys, pa.array([x.view(np.int64) for x in found], pa.list_(pa.int64()))], ["key", "set"])

    return sets


def _groups(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Rows that follow each other with the same ``group`` and ``part``; a group may go on in the next batch."""
    rest: pa.Table | None = None
    for batch in batches:
        table = pa.Table.from_batches([batch])
        if rest is not None:
            table = pa.concat_tables([rest, table])
        if not table.num_rows:
            continue
        keys = [table.column(c).to_numpy() for c in ("group", "low", "high")]
        cuts = (np.flatnonzero(np.any([k[1:] != k[:-1] for k in keys], axis=0)) + 1).tolist()
        for a, b in itertools.pairwise([0, *cuts]):
            yield table.slice(a, b - a)
        rest = table.slice(cuts[-1] if cuts else 0)
    if rest is not None and rest.num_rows:
        yield rest


def _flat(group: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """The sets of a group one after the other, and their sizes."""
    sets = group.column("set").combine_chunks()
    return sets.flatten().to_numpy().view(np.uint64), np.diff(sets.offsets.to_numpy()).astype(np.int64)


def star_links(flat: np.ndarray, sizes: np.ndarray, similarity: float) -> np.ndarray:
    """Which sets are similar enough to the first one; sets are sorted hashes, each with one at least."""
    head = flat[: sizes[0]]
    at = np.minimum(np.searchsorted(head, flat), len(head) - 1)
    common = np.add.reduceat((head[at] == flat).astype(np.int64), np.cumsum(sizes) - sizes)
    return common / (sizes + sizes[0] - common) >= similarity


def forest_links(flat: np.ndarray, sizes: np.ndarray, labels: np.ndarray, sides: np.ndarray | None, similarity: float) -> list[tuple[int, int]]:
    """Links between sets of different components (``labels``) that bring all of these together that any link would.

    With ``sides``, only sets of different sides are compared. Shingles are numbered by how many of the sets hold them.
    Two sets of the similarity share at least that part of the larger, so their rarest ``1 - similarity`` (and one)
    hold a common one; shingles that only one component holds need no look.
    """
    n = len(sizes)
    owner, starts = np.repeat(np.arange(n), sizes), np.cumsum(sizes) - sizes
    _, kind, holders = np.unique(flat, return_inverse=True, return_counts=True)
    rank = np.empty(len(holders), np.int64)
    rank[np.argsort(holders, kind="stable")] = np.arange(len(holders))
    holders = np.sort(holders, kind="stable")
    words = rank[kind]
    words = words[np.lexsort((words, owner))]
    place = np.arange(len(words)) - np.repeat(starts, sizes)
    reach = sizes - np.ceil(similarity * sizes - 1e-9).astype(np.int64) + 1
    held = np.flatnonzero((place < np.repeat(reach, sizes)) & (holders[words] > 1))
    root = np.unique(labels, return_inverse=True)[1].astype(np.int64)
    word, of = words[held], owner[held]
    if not len(word):
        return []
    by_word = np.argsort(word, kind="stable")
    first = np.flatnonzero(np.diff(word[by_word], prepend=-1))
    several = np.minimum.reduceat(root[of[by_word]], first) != np.maximum.reduceat(root[of[by_word]], first)
    asked = np.zeros(len(word), bool)
    asked[by_word] = np.repeat(several, np.diff(first, append=len(word)))
    word, of = word[asked], of[asked]
    by_word = np.argsort(word, kind="stable")
    posted, owners = word[by_word], of[by_word]
    low, high = np.searchsorted(posted, word, "left"), np.searchsorted(posted, word, "right")
    begin = np.searchsorted(of, np.arange(n + 1))
    mark = np.zeros(len(holders), bool)
    links = []
    for i in np.unique(of).tolist():
        a, b = begin[i], begin[i + 1]
        others = np.unique(owners[inside(low[a:b], high[a:b] - low[a:b])])
        others = others[(others < i) & (root[others] != root[i])]
        if sides is not None:
            others = others[sides[others] != sides[i]]
        others = others[np.minimum(sizes[others], sizes[i]) >= similarity * np.maximum(sizes[others], sizes[i])]
        own, most = words[starts[i] : starts[i] + sizes[i]], 1
        mark[own] = True
        while len(others):  # of each component one first, then ever more
            others = others[np.argsort(root[others], kind="stable")]
            runs = np.flatnonzero(np.diff(root[others], prepend=-1))
            now = np.arange(len(others)) - np.repeat(runs, np.diff(runs, append=len(others))) < most
            tried = others[now]
            offsets = np.cumsum(sizes[tried]) - sizes[tried]
            common = np.add.reduceat(mark[words[inside(starts[tried], sizes[tried])]].astype(np.int64), offsets)
            for j in tried[common / (sizes[tried] + sizes[i] - common) >= similarity].tolist():
                if root[j] != root[i]:
                    links.append((j, i))
                    root[root == root[j]] = root[i]
            others = others[~now]
            others = others[root[others] != root[i]]
            most *= 4
        mark[own] = False
    return links


def _edges(similarity: float, star: bool):
    def edges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in _groups(batches):
            ids = group.column("id").to_numpy()
            flat, sizes = _flat(group)
            if star:
                hit = star_links(flat, sizes, similarity)
                hit[0] = False
                a, b = np.full(int(hit.sum()), ids[0]), ids[hit]
            else:
                tiled = group.column("low")[0].as_py() != group.column("high")[0].as_py()
                sides = group.column("side").to_numpy() if tiled else None
                found = np.array(forest_links(flat, sizes, group.column("label").to_numpy(), sides, similarity), np.int64).reshape(-1, 2)
                a, b = ids[found[:, 0]], ids[found[:, 1]]
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

    return edges


_KEYS = ["group", "low", "high"]


def _compared(placed: DataFrame, sets: DataFrame, similarity: float, star: bool) -> DataFrame:
    """Links ``a, b`` inside the groups of ``placed`` (``group, low, high, side, label, id``)."""
    parts = int(sets.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = placed.join(sets, "id").select(*_KEYS, "side", "label", "id", "set")
    dealt = rows.repartition(parts, *_KEYS).sortWithinPartitions(*_KEYS, "side", "id")
    return dealt.mapInArrow(_edges(similarity, star), "a long, b long")


def _to_heads(rows: DataFrame, sets: DataFrame, similarity: float, tile: int, seed: int | None = None) -> DataFrame:
    """Links of classes (``bucket, id, n, label``) to the head that most of their buckets have, of another component.

    The head is the smallest id of a bucket, or with ``seed`` one by a hash.
    """
    order = F.col("id") if seed is None else F.xxhash64("id", F.lit(seed))
    heads = rows.groupBy("bucket").agg(F.min_by(F.struct("id", "n", "label"), order).alias("head"))
    fits = F.least("n", "head.n") >= similarity * F.greatest("n", "head.n")
    tried = rows.join(heads, "bucket").where(F.col("label") != F.col("head.label")).where(fits)
    tried = tried.groupBy("id", "n", F.col("head.id").alias("group")).agg(F.count(F.lit(1)).alias("times"))
    chosen = tried.groupBy("id", "n").agg(F.max_by("group", F.struct("times", -F.col("group"))).alias("group"))
    chosen = written(chosen, "chosen-heads")
    sizes = chosen.groupBy("group").agg(F.ceil(F.sum("n") / tile).alias("parts"))
    members = chosen.join(sizes, "group").select("group", F.pmod(F.xxhash64("id"), F.col("parts")).alias("low"), F.lit(1).alias("side"), "id")
    again = sizes.select("group", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)).alias("low"), F.lit(0).alias("side"), F.col("group").alias("id"))
    placed = again.unionByName(members).withColumns({"high": F.col("low"), "label": F.lit(0).cast("long")})
    return _compared(placed, sets, similarity, star=True)


def _mixed(rows: DataFrame, links: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Components so far, and the rows of buckets that hold several."""
    labels = components(links).select(F.col("node").alias("id"), "label")
    now = rows.drop("label").join(labels, "id", "left").withColumn("label", F.coalesce("label", "id"))
    several = now.groupBy("bucket").agg(F.min("label").alias("low"), F.max("label").alias("high"), F.sum("n").alias("weight"))
    return labels, written(now.join(several.where("low < high").select("bucket", "weight"), "bucket"), "mixed")


def _rest(mixed: DataFrame, sets: DataFrame, similarity: float, tile: int) -> DataFrame:
    """Links between the components that buckets hold: all at one place where what buckets connect fits there."""
    first = mixed.groupBy("bucket").agg(F.min("id").alias("a"))
    through = components(mixed.join(first, "bucket").select("a", F.col("id").alias("b")))
    classes = mixed.select("id", "n", "label").distinct().join(through.select(F.col("node").alias("id"), F.col("label").alias("group")), "id")
    classes = written(classes, "connected")
    weights = classes.groupBy("group").agg(F.sum("n").alias("all"))
    sized = classes.join(weights, "group")
    whole = sized.where(F.col("all") <= tile).select(
        "group", *[F.lit(0).cast("long").alias(c) for c in ("low", "high")], F.lit(0).cast("long").alias("side"), "label", "id"
    )
    large = mixed.join(sized.where(F.col("all") > tile).select("id"), "id")
    tiles = F.ceil(F.col("weight") / tile)
    side = F.pmod(F.xxhash64("id"), tiles)
    dealt = large.select("bucket", "label", "id", side.alias("side"), F.explode(F.sequence(F.lit(0).cast("long"), tiles - 1)).alias("other"))
    tiled = dealt.select(F.col("bucket").alias("group"), F.least("side", "other").alias("low"), F.greatest("side", "other").alias("high"), "side", "label", "id")
    # Groups are named by a class or by a bucket's hash; the low bit keeps them apart.
    whole = whole.withColumn("group", F.col("group") * 2)
    tiled = tiled.withColumn("group", F.col("group").bitwiseOR(F.lit(1)))
    return _compared(whole.unionByName(tiled), sets, similarity, star=False)


def _by_fingerprint(of_docs: DataFrame, classes: DataFrame, radius: int) -> DataFrame:
    """``id, n, bucket``: a bucket holds the classes that links between fingerprints connect."""
    marks = written(of_docs.where("n > 0").select("key", "fp").distinct(), "marks")
    fps = written(marks.select("fp").distinct(), "fingerprints")
    labels = components(written(fingerprint_links(fps, fps.count(), radius).distinct(), "fingerprint-links"))
    linked = marks.join(labels.withColumnRenamed("node", "fp"), "fp", "left")
    return linked.join(classes, "key").select("id", classes["n"], F.coalesce("label", "fp").alias("bucket")).distinct()


def near_texts(docs: DataFrame, n_words: int = WORDS, similarity: float = SIMILARITY, seed: int = SEED, tile: int = TILE) -> DataFrame:
    """``doc_id, component_id``: one row for each row of ``docs``.

    ``component_id`` is the smallest ``doc_id`` that links reach, the row's own included; a link is between texts whose
    sets of shingles have a Jaccard similarity of at least ``similarity``. Texts without words (null, empty, white
    space) are alike. Shorter texts than a shingle are one shingle. A row without ``doc_id`` links others, and gets the
    smallest id reached, null if there is none. Repeated rows give repeated rows. An empty table gives an empty table.
    """
    texts = docs.select(F.col("doc_id").cast("long"), "text")
    of_docs = written(texts.mapInArrow(_hashed(n_words, seed), "doc_id long, key binary, n long, bands array<long>, fp long"), "shingled")
    classes = of_docs.groupBy("key").agg(F.min("doc_id").alias("first"), F.max("n").alias("n"), F.first("bands").alias("bands"))
    classes = written(classes.withColumn("id", F.monotonically_increasing_id()), "classes")
    rows = classes.select("id", "n", F.explode("bands").alias("bucket")).unionByName(_by_fingerprint(of_docs, classes, RADIUS))
    shared = rows.groupBy("bucket").agg(F.count(F.lit(1)).alias("size")).where("size > 1").select("bucket")
    rows = written(rows.join(shared, "bucket").withColumn("label", F.col("id")), "buckets")
    needed = written(classes.join(rows.select("id").distinct(), "id", "left_semi").select("id", "key", "first"), "candidates")
    chosen = texts.join(needed.select(F.col("first").alias("doc_id")).distinct(), "doc_id", "left_semi")
    chosen = chosen.unionByName(texts.where("doc_id IS NULL")).select("text")
    made = chosen.mapInArrow(_sets(n_words, seed), "key binary, set array<long>").dropDuplicates(["key"])
    sets = written(made.join(needed.select("id", "key"), "key").select("id", "set"), "sets")
    links = written(_to_heads(rows, sets, similarity, tile), "head-links")
    labels, mixed = _mixed(rows, links)
    before, n_round = None, 0
    while (now := mixed.where(F.col("weight") > tile).count()) and (before is None or now < 0.9 * before):
        before, n_round = now, n_round + 1
        more = _to_heads(mixed.where(F.col("weight") > tile), sets, similarity, tile, seed + n_round)
        links = written(links.unionByName(more), "head-links")
        labels, mixed = _mixed(rows, links)
    if not mixed.isEmpty():
        links = written(links.unionByName(_rest(mixed, sets, similarity, tile)), "links")
        labels = components(links).select(F.col("node").alias("id"), "label")
    whole = classes.select("id", "key", "first").join(labels, "id", "left").withColumn("label", F.coalesce("label", "id"))
    smallest = whole.groupBy("label").agg(F.min("first").alias("component_id"))
    return of_docs.select("doc_id", "key").join(whole.join(smallest, "label").select("key", "component_id"), "key").select("doc_id", "component_id")
