"""Tokens of two tokenizers aligned by the bytes they end at, scored over the whole corpus by inverted pair bitmaps.

1. A task encodes texts with both vocabularies and finds the byte offsets at which tokens of both end. These cut a text
   into groups; the two tokens that end at a cut are linked.
2. Documents are dealt to blocks, within a task. For each pair of ids a block has a bitmap of its documents, and planes for
   the multiplicity: plane k + 1 holds the documents with bit k set in the number of links less one. Bitmaps are compressed
   to their bytes that aren't zero; those of a task's slices are merged by OR.
3. Popcounts give each block's documents and links of a pair (a document counts once, plane k + 1 counts 2**k); Spark adds
   them up. The blocks are the pair's postings: by them its score goes back to each block that holds it, and by the bitmaps
   to the documents. Only pairs and scores are shuffled on the way, so a pair that all documents hold is a short row a block.
"""

from __future__ import annotations

import hashlib
import itertools
import os
import re
from array import array
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lakepulse.llm.pretokens import Cache, WordEncoder, class_table, slices
from lakepulse.llm.text import documents, raw_texts
from lakepulse.session import written

VOCABULARY_A = "byte_bpe_50k.json"
VOCABULARY_B = "piece_bpe_32k.model"
#: A block is closed behind the document that brings it to so many bytes of text, or so many documents (2**12).
BLOCK_BYTES = 8_000_000
BLOCK_DOCS = 4096
#: Bounds of memory in a task: bytes handled at a time, words remembered, characters given to the second library at a time.
SLICE_BYTES = 1_500_000
CACHE_ENTRIES = 400_000
CACHE_BYTES = 24_000_000
PART_CHARS = 400_000

_DOC_BITS, _PLACE_BITS, _PLANE_BITS = 12, 9, 5
_PAIR_SHIFT = _PLACE_BITS + _PLANE_BITS
_SEPARATORS = b",|;"
_CUT = re.compile("(?<=[^ ▁]) (?=.)", re.DOTALL)
_DOCS = "array<struct<doc_id:bigint,n_a:bigint,n_b:bigint,n_groups:bigint,n_links:bigint,groups_sha256:string>>"
_BLOCK = f"block bigint, docs {_DOCS}, pairs array<bigint>, n_docs array<bigint>, n_links array<bigint>, keys binary, bits binary"
_DOC_TYPE = pa.struct([("doc_id", pa.int64()), *[(c, pa.int64()) for c in ("n_a", "n_b", "n_groups", "n_links")], ("groups_sha256", pa.string())])


def or_merged(keys: np.ndarray, bits: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of bitmaps with their keys: those of equal keys merged by OR, in order of the keys."""
    order = np.argsort(keys, kind="stable")
    keys = keys[order]
    first = np.flatnonzero(np.diff(keys, prepend=-1))
    return keys[first], np.bitwise_or.reduceat(bits[order], first) if len(first) else bits[:0]


def planes(docs: np.ndarray, pairs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The compressed bitmaps of links, each of a document (below ``BLOCK_DOCS``) and a pair.

    A key is the pair, the plane (0: documents) and the place of the byte.
    """
    both, times = np.unique((pairs << _DOC_BITS) | docs, return_counts=True)
    pair, doc = both >> _DOC_BITS, both & (BLOCK_DOCS - 1)
    keys, bits = (pair << _PAIR_SHIFT) | (doc >> 3), (1 << (doc & 7)).astype(np.uint8)
    parts = [(keys, bits)]
    times -= 1
    for k in range(int(times.max(initial=0)).bit_length()):
        held = (times >> k) & 1 == 1
        parts.append((keys[held] | ((k + 1) << _PLACE_BITS), bits[held]))
    return or_merged(*(np.concatenate(x) for x in zip(*parts, strict=True)))


def _weights(keys: np.ndarray) -> np.ndarray:
    """Links that a bit stands for."""
    plane = (keys >> _PLACE_BITS) & ((1 << _PLANE_BITS) - 1)
    return np.where(plane == 0, 1, np.int64(1) << np.maximum(plane - 1, 0))


def popcounts(keys: np.ndarray, bits: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The pairs of bitmaps, and the documents and links of each."""
    pair = keys >> _PAIR_SHIFT
    first = np.flatnonzero(np.diff(pair, prepend=-1))
    if not len(first):
        return pair, pair, pair
    ones = np.bitwise_count(bits).astype(np.int64)
    in_docs = np.where((keys >> _PLACE_BITS) & ((1 << _PLANE_BITS) - 1) == 0, ones, 0)
    return pair[first], np.add.reduceat(in_docs, first), np.add.reduceat(ones * _weights(keys), first)


def sums_by_doc(keys: np.ndarray, bits: np.ndarray, scores: np.ndarray, n: int) -> np.ndarray:
    """For ``n`` documents and each column of ``scores`` (a row for each pair, in order) the sum over the document's links."""
    out = np.zeros((n, scores.shape[1]), np.int64)
    pair = keys >> _PAIR_SHIFT
    place = np.cumsum(np.diff(pair, prepend=pair[:1]) != 0)
    gains = scores[place] * _weights(keys)[:, None]
    first_doc = (keys & ((1 << _PLACE_BITS) - 1)) << 3
    for bit in range(8):
        held = (bits >> bit) & 1 == 1
        np.add.at(out, first_doc[held] + bit, gains[held])
    return out


def byte_values() -> dict[str, int]:
    """The byte that each character of a byte-level vocabulary stands for: itself if printable, else 256 and up in order."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


def _texts_of(tokens: list[bytes]) -> np.ndarray:
    return np.array([len(t) for t in tokens], np.int64)


class First:
    """A space and a text by the byte-level vocabulary; strings of special tokens are plain text."""

    def __init__(self, content: str, classes: np.ndarray) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_str(content)
        self.tokenizer.encode_special_tokens = True
        names = {i: t for t, i in self.tokenizer.get_vocab(with_added_tokens=False).items()}
        values = byte_values()
        self.tokens = [bytes(values[c] for c in names.get(i, "")) for i in range(max(names) + 1)]
        self.sizes = _texts_of(self.tokens)
        self.words = WordEncoder(classes, self._learn, CACHE_ENTRIES, CACHE_BYTES)

    def _learn(self, words: list[bytes], cache: Cache) -> None:
        for i in range(0, len(words), 50_000):
            part = words[i : i + 50_000]
            for word, found in zip(part, self.tokenizer.encode_batch_fast([w.decode() for w in part], add_special_tokens=False), strict=True):
                cache.keep(word, array("i", found.ids).tobytes())

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        return self.words.encode([f" {t}" for t in texts])


class Second:
    """Texts by the piece vocabulary, which puts a space before them.

    Where no piece holds a space behind another character, a long text is cut at such a space, which the library puts
    before the next part again; the pieces are the same.
    """

    def __init__(self, model: bytes) -> None:
        import sentencepiece

        self.library = sentencepiece.SentencePieceProcessor(model_proto=model)
        names = [self.library.id_to_piece(i) for i in range(self.library.get_piece_size())]
        self.tokens = [
            bytes([int(n[3:5], 16)]) if self.library.is_byte(i) else n.replace("▁", " ").encode() for i, n in enumerate(names)
        ]
        self.sizes = _texts_of(self.tokens)
        self.cuts = not any("▁" in n.lstrip("▁") for n in names)

    def parts(self, text: str) -> list[str]:
        out, at = [], 0
        while self.cuts and len(text) - at > PART_CHARS:
            cut = _CUT.search(text, at + PART_CHARS)
            if cut is None:
                break
            out.append(text[at : cut.start()])
            at = cut.end()
        return [*out, text[at:]]

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        parts = [self.parts(t) for t in texts]
        found = self.library.encode(list(itertools.chain.from_iterable(parts)), num_threads=1)
        sizes = np.array([len(x) for x in found], np.int64)
        ids = np.fromiter(itertools.chain.from_iterable(found), np.int64, int(sizes.sum()))
        ends = np.cumsum([0, *map(len, parts)])
        return ids, np.diff(np.concatenate([[0], np.cumsum(sizes)])[ends])


def _images(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Decimal ids with each separator behind them, filled up with zeros, and the sizes."""
    width = len(str(n - 1)) + 1
    rows = [b"".join((str(i).encode() + bytes([s])).ljust(width, b"\0") for i in range(n)) for s in _SEPARATORS]
    sizes = np.array([len(str(i)) + 1 for i in range(n)], np.int64)
    return np.frombuffer(b"".join(rows), np.uint8).reshape(len(_SEPARATORS), n, width), sizes


class Aligner:
    """Aligns slices of texts; what they give is one after the other."""

    def __init__(self, first: First, second: Second) -> None:
        self.first, self.second = first, second
        self.image, self.image_sizes = _images(max(len(first.sizes), len(second.sizes)))

    @staticmethod
    def _bytes(tokens: list[bytes], ids: np.ndarray) -> bytes:
        return b"".join([tokens[i] for i in ids.tolist()])

    def _sound(self, raws: list[bytes], encoded: list[tuple]) -> np.ndarray:
        """Which texts both sequences of tokens spell out."""
        out = np.array([len(r) > 0 for r in raws], bool)
        whole = b"".join([b" " + r if ok else b"" for r, ok in zip(raws, out.tolist(), strict=True)])
        for ids, sizes, tokens in encoded:
            spelt = self._bytes(tokens, ids[np.repeat(out, sizes)])
            if spelt == whole:
                continue
            ends = np.cumsum(sizes)
            for i in np.flatnonzero(out).tolist():
                out[i] = self._bytes(tokens, ids[ends[i] - sizes[i] : ends[i]]) == b" " + raws[i]
            whole = b"".join([b" " + r if ok else b"" for r, ok in zip(raws, out.tolist(), strict=True)])
        return out

    def align(self, raws: list[bytes]) -> tuple[list[np.ndarray], list[str], list[bytes], np.ndarray, np.ndarray]:
        """Of each text the tokens of both, groups and links, the digest and the groups' text; documents and pairs of all links."""
        texts = [r.decode("utf-8", "replace") for r in raws]
        a, n_a = self.first.encode(texts)
        b, n_b = self.second.encode(texts)
        sound = self._sound([t.encode() for t in texts], [(a, n_a, self.first.tokens), (b, n_b, self.second.tokens)])
        a, b = a[np.repeat(sound, n_a)].astype(np.int64), b[np.repeat(sound, n_b)]
        n_a, n_b = np.where(sound, n_a, 0), np.where(sound, n_b, 0)
        ends_a, ends_b = np.cumsum(self.first.sizes[a]), np.cumsum(self.second.sizes[b])
        marked = np.zeros(int(ends_a[-1]) + 1 if len(a) else 1, bool)
        marked[ends_a] = True
        cut_b = marked[ends_b]
        marked[:] = False
        marked[ends_b] = True
        cut_a = marked[ends_a]
        docs = np.repeat(np.arange(len(raws)), n_a)[cut_a]
        n_groups = np.bincount(docs, minlength=len(raws))
        listed = self._groups(a, b, cut_a, cut_b)
        ends = np.cumsum(self._listed_sizes(a, n_a) + self._listed_sizes(b, n_b)).tolist()
        strings = [listed[s : e - 1] if e > s else b"" for s, e in zip([0, *ends[:-1]], ends, strict=True)]
        digests = [hashlib.sha256(x).hexdigest() if x else "" for x in strings]
        pairs = a[cut_a] * len(self.second.sizes) + b[cut_b]
        return [n_a, n_b, n_groups, n_groups], digests, strings, docs, pairs

    def _listed_sizes(self, ids: np.ndarray, counts: np.ndarray) -> np.ndarray:
        before = np.concatenate([[0], np.cumsum(self.image_sizes[ids])])
        ends = np.cumsum(counts)
        return before[ends] - before[ends - counts]

    def _groups(self, a: np.ndarray, b: np.ndarray, cut_a: np.ndarray, cut_b: np.ndarray) -> bytes:
        """``a1,a2|b1;`` for each group."""
        group_a, group_b = np.cumsum(cut_a) - cut_a, np.cumsum(cut_b) - cut_b
        n = int(cut_a.sum())
        in_a, in_b = np.bincount(group_a, minlength=n), np.bincount(group_b, minlength=n)
        out = np.empty((len(a) + len(b), self.image.shape[2]), np.uint8)
        if not n:
            return b""
        out[np.arange(len(a)) + (np.cumsum(in_b) - in_b)[group_a]] = self.image[cut_a.astype(np.int64), a]
        out[np.arange(len(b)) + np.cumsum(in_a)[group_b]] = self.image[2 * cut_b.astype(np.int64), b]
        return out[out != 0].tobytes()


class _Block:
    def __init__(self, number: int) -> None:
        self.number, self.size = number, 0
        self.docs: list[dict] = []
        self.keys, self.bits = np.zeros(0, np.int64), np.zeros(0, np.uint8)

    def add(self, docs: list[dict], size: int, places: np.ndarray, pairs: np.ndarray) -> None:
        keys, bits = planes(places + len(self.docs), pairs)
        self.keys, self.bits = or_merged(np.concatenate([self.keys, keys]), np.concatenate([self.bits, bits]))
        self.docs += docs
        self.size += size

    def row(self) -> pa.RecordBatch:
        pairs, n_docs, n_links = popcounts(self.keys, self.bits)
        lists = [pa.array([x], pa.list_(pa.int64())) for x in (pairs, n_docs, n_links)]
        blobs = [pa.array([x.tobytes()], pa.binary()) for x in (self.keys.astype("<i8"), self.bits)]
        columns = [pa.array([self.number], pa.int64()), pa.array([self.docs], pa.list_(_DOC_TYPE)), *lists, *blobs]
        return pa.RecordBatch.from_arrays(columns, ["block", "docs", "pairs", "n_docs", "n_links", "keys", "bits"])


def _blocks(shared, block_docs: int, block_bytes: int):
    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        content, model, classes = shared.value
        aligner = Aligner(First(content, classes), Second(model))
        number = TaskContext.get().partitionId() << 32
        block = _Block(number)
        for batch in batches:
            doc_ids, raws = batch.column("doc_id").to_pylist(), raw_texts(batch.column("text"))
            for i, j in slices([len(r) + 1 for r in raws], SLICE_BYTES):
                while i < j:
                    end = min(j, i + block_docs - len(block.docs))
                    counts, digests, _, places, pairs = aligner.align(raws[i:end])
                    values = zip(doc_ids[i:end], *[c.tolist() for c in counts], digests, strict=True)
                    docs = [dict(zip(_DOC_TYPE.names, v, strict=True)) for v in values]
                    block.add(docs, sum(map(len, raws[i:end])), places, pairs)
                    if len(block.docs) >= block_docs or block.size >= block_bytes:
                        yield block.row()
                        number += 1
                        block = _Block(number)
                    i = end
        if block.docs:
            yield block.row()

    return blocks


def _scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for i in range(batch.num_rows):
            docs = batch.column("docs").slice(i, 1).flatten()
            keys = np.frombuffer(batch.column("keys")[i].as_buffer(), "<i8")
            bits = np.frombuffer(batch.column("bits")[i].as_buffer(), np.uint8)
            sums = np.zeros((len(docs), 2), np.int64)
            if len(keys):
                back = batch.column("scores").slice(i, 1).flatten()
                pair, links, best = (back.field(c).to_numpy(zero_copy_only=False) for c in range(3))
                order = np.argsort(pair, kind="stable")
                sums = sums_by_doc(keys, bits, np.stack([best[order].astype(np.int64), links[order]], axis=1), len(docs))
            columns = [docs.field(c) for c in _DOC_TYPE.names]
            columns[5:5] = [pa.array(sums[:, 0]), pa.array(np.ascontiguousarray(sums[:, 1]))]
            yield pa.RecordBatch.from_arrays(columns, [*_DOC_TYPE.names[:5], "n_best", "count_sum", "groups_sha256"])


_RESULT = "doc_id bigint, n_a bigint, n_b bigint, n_groups bigint, n_links bigint, n_best bigint, count_sum bigint, groups_sha256 string"


class Alignment:
    """The alignment of all texts: ``documents`` (a row for each row of ``docs``) and ``scores`` (a row for each pair).

    ``scores`` has the ids ``a, b``, the documents and links that hold the pair, and whether no pair of this ``b`` has
    more links. In ``documents`` a null or empty text, and one that a vocabulary doesn't spell out byte for byte, has no
    tokens: zeros, and an empty ``groups_sha256``. Rows are independent but for the counts, which repeated rows and rows
    without ``doc_id`` add to like any other. Other columns are left out. An empty table gives empty tables.
    """

    def __init__(self, docs: DataFrame, path_a: str, path_b: str, block_docs: int = BLOCK_DOCS, block_bytes: int = BLOCK_BYTES) -> None:
        if not 1 <= block_docs <= BLOCK_DOCS:
            raise ValueError(f"a block holds 1 to {BLOCK_DOCS} documents")
        spark = docs.sparkSession
        with open(path_a, encoding="utf-8") as file:
            content = file.read()
        with open(path_b, "rb") as file:
            model = file.read()
        # Two vocabularies and one table of characters: their sizes don't depend on the data.
        shared = spark.sparkContext.broadcast((content, model, class_table()))
        n_b = len(Second(model).sizes)
        texts = docs.select(F.col("doc_id").cast("long"), "text")
        self.blocks = written(texts.mapInArrow(_blocks(shared, block_docs, block_bytes), _BLOCK), "aligned")
        counted = self.blocks.select(F.inline(F.arrays_zip("pairs", "n_docs", "n_links")))
        totals = counted.groupBy(F.col("pairs").alias("pair")).agg(F.sum("n_docs").alias("n_docs"), F.sum("n_links").alias("n_links"))
        named = totals.select("pair", F.expr(f"pair div {n_b}").alias("a"), (F.col("pair") % n_b).alias("b"), "n_docs", "n_links")
        totals = written(named, "pair-counts")
        most = totals.groupBy("b").agg(F.max("n_links").alias("most"))
        self.scores = totals.join(most, "b").select("pair", "a", "b", "n_docs", "n_links", (F.col("n_links") == F.col("most")).alias("best"))

    @property
    def documents(self) -> DataFrame:
        asked = self.blocks.select("block", F.explode("pairs").alias("pair"))
        found = asked.join(self.scores.select("pair", "n_links", "best"), "pair")
        back = found.groupBy("block").agg(F.collect_list(F.struct("pair", "n_links", "best")).alias("scores"))
        # A row is a block, a few megabytes; so few of them lie in a partition.
        parts = max(int(self.blocks.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-self.blocks.count() // 4))
        bitmaps = self.blocks.select("block", "docs", "keys", "bits").repartition(parts, "block")
        return bitmaps.join(back.repartition(parts, "block"), "block", "left").mapInArrow(_scored, _RESULT)


def op11_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    paths = public_tokenizers.path(VOCABULARY_A), public_tokenizers.path(VOCABULARY_B)
    return Alignment(documents(spark, sf_dir), *paths).documents
