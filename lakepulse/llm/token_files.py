"""Token ids in binary files, each id in the fewest bits that hold the vocabulary.

A file holds whole documents in order: a header, the documents' ids and ends, the byte offset of each block, then the
blocks. A block has a fixed number of ids, packed little end first, and begins on a byte; so a range of ids is read by the
offsets of its blocks alone and unpacked by numpy.

Documents are dealt to tasks by ranges of ``doc_id``. A task writes files under new names into the shared folder and
returns a row for each; the table of these rows is what counts, so a task that runs twice or dies leaves no trace in it.
The ids before a file are a running sum over that table, which has a row for each file of millions of ids.
"""

from __future__ import annotations

import itertools
import os
import struct
import uuid
from array import array
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lakepulse.llm.pretokens import Cache, WordEncoder, class_table, slices, word_starts
from lakepulse.llm.text import documents, raw_texts
from lakepulse.session import scratch, written

VOCABULARY = "byte_bpe_50k.json"
END = 0
BLOCK_IDS = 1 << 16
#: A file is closed behind the document that brings it to so many ids.
FILE_IDS = 1 << 23
#: Bounds of memory in a task: bytes of texts handled at a time, words that are remembered, ids handed on at a time.
SLICE_BYTES = 3_000_000
CACHE_ENTRIES = 700_000
CACHE_BYTES = 32_000_000
READ_IDS = 1 << 21
#: Words that tasks know from the start: the most frequent ones in the beginnings of some documents, whichever come first. They
#: save time; all other words are encoded where they occur, so ids don't depend on the choice.
KNOWN_WORDS = 150_000
SAMPLE_DOCS = 3_000
SAMPLE_CHARS = 3_000

_HEADER = "<4sHHIQQ"
_PLAIN = frozenset(bytes([b]) for b in b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789")
_MAGIC, _VERSION = b"TIDS", 1
_MANIFEST = "part int, file int, path string, n_docs long, n_ids long"


def width_of(vocabulary: int) -> int:
    """Bits that hold the ids 0 to ``vocabulary`` - 1."""
    return max(1, (vocabulary - 1).bit_length())


def pack(ids: np.ndarray, width: int) -> bytes:
    bits = np.unpackbits(np.ascontiguousarray(ids, "<u4").view(np.uint8).reshape(-1, 4), axis=1, bitorder="little")
    return np.packbits(bits[:, :width].ravel(), bitorder="little").tobytes()


def unpack(raw: bytes, n: int, width: int) -> np.ndarray:
    bits = np.zeros((n, 32), np.uint8)
    bits[:, :width] = np.unpackbits(np.frombuffer(raw, np.uint8), count=n * width, bitorder="little").reshape(n, width)
    return np.packbits(bits, axis=1, bitorder="little").view("<u4").ravel()


@dataclass
class Writer:
    """Collects documents; ``finish`` writes the file. What it holds is packed but for a part of a block."""

    width: int
    doc_ids: list[int | None] = field(default_factory=list)
    sizes: list[int] = field(default_factory=list)
    blocks: list[bytes] = field(default_factory=list)
    rest: list[np.ndarray] = field(default_factory=list)
    waiting: int = 0
    n_ids: int = 0

    def add(self, doc_id: int | None, ids: np.ndarray) -> None:
        if len(ids) and int(ids.max()) >> self.width:
            raise ValueError(f"an id takes more than {self.width} bits")
        self.doc_ids.append(doc_id)
        self.sizes.append(len(ids))
        self.n_ids += len(ids)
        self.rest.append(ids)
        self.waiting += len(ids)
        if self.waiting >= BLOCK_IDS:
            whole = np.concatenate(self.rest)
            cut = len(whole) - len(whole) % BLOCK_IDS
            self.blocks.extend(pack(whole[i : i + BLOCK_IDS], self.width) for i in range(0, cut, BLOCK_IDS))
            self.rest, self.waiting = [whole[cut:].copy()], len(whole) - cut

    def finish(self, store: fs.FileSystem, path: str) -> None:
        if self.waiting:
            self.blocks.append(pack(np.concatenate(self.rest), self.width))
        n = len(self.doc_ids)
        known = np.array([x is not None for x in self.doc_ids], np.uint8)
        names = np.array([x or 0 for x in self.doc_ids], "<i8")
        first = struct.calcsize(_HEADER) + 17 * n + 8 * (len(self.blocks) + 1)
        offsets = first + np.concatenate([[0], np.cumsum([len(b) for b in self.blocks])]).astype("<i8")
        with store.open_output_stream(path) as out:
            out.write(struct.pack(_HEADER, _MAGIC, _VERSION, self.width, BLOCK_IDS, n, self.n_ids))
            for part in (known, names, np.cumsum(self.sizes).astype("<i8"), offsets):
                out.write(part.tobytes())
            for block in self.blocks:
                out.write(block)


class Reader:
    """Random access to a file: any range of ids, or its documents in order."""

    def __init__(self, file: pa.NativeFile) -> None:
        self.file = file
        magic, version, self.width, self.block_ids, n, self.n_ids = struct.unpack(_HEADER, file.read(struct.calcsize(_HEADER)))
        if (magic, version) != (_MAGIC, _VERSION):
            raise ValueError("not a file of token ids")
        known = np.frombuffer(file.read(n), np.uint8)
        names = np.frombuffer(file.read(8 * n), "<i8")
        self.doc_ids = [name if k else None for name, k in zip(names.tolist(), known.tolist(), strict=True)]
        self.ends = np.frombuffer(file.read(8 * n), "<i8")
        n_blocks = -(-self.n_ids // self.block_ids)
        self.offsets = np.frombuffer(file.read(8 * (n_blocks + 1)), "<i8")

    def ids(self, start: int, end: int) -> np.ndarray:
        if start >= end:
            return np.zeros(0, "<u4")
        first, last = start // self.block_ids, (end - 1) // self.block_ids
        self.file.seek(int(self.offsets[first]))
        raw = self.file.read(int(self.offsets[last + 1] - self.offsets[first]))
        out = []
        for block in range(first, last + 1):
            n = min(self.block_ids, self.n_ids - block * self.block_ids)
            at = int(self.offsets[block] - self.offsets[first])
            out.append(unpack(raw[at : at + int(self.offsets[block + 1] - self.offsets[block])], n, self.width))
        return np.concatenate(out)[start - first * self.block_ids : end - first * self.block_ids]


class KnownWords(Cache):
    """A cache that begins with given words, and does so again when it is emptied."""

    def __init__(self, known: dict[bytes, bytes], entries: int, size: int) -> None:
        super().__init__(entries, size)
        self.known = known
        self.update(known)

    def trim(self) -> None:
        super().trim()
        if not self:
            self.update(self.known)


class LibraryEncoder:
    """What the tokenizers library gives for whole texts, by way of their distinct words.

    Its pre-tokenizer has the same pattern, so a text is its words. A text that holds the string of an added token is cut
    there first; such texts are given to the library whole.
    """

    def __init__(self, content: str, classes: np.ndarray, known: dict[bytes, bytes] | None = None) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_str(content)
        self.added = [x.content for x in self.tokenizer.get_added_tokens_decoder().values() if x.content]
        vocabulary = self.tokenizer.get_vocab(with_added_tokens=False)
        self.sizes = np.zeros(max(vocabulary.values()) + 1, np.int64)
        self.sizes[list(vocabulary.values())] = [len(token) for token in vocabulary]  # a character stands for a byte
        self.words = WordEncoder(classes, self._learn, CACHE_ENTRIES, CACHE_BYTES)
        self.words.words = KnownWords(known or {}, CACHE_ENTRIES, CACHE_BYTES)

    def _learn(self, words: list[bytes], cache: Cache) -> None:
        """A space and a plain letter or digit begin a word wherever they stand, so such words are encoded as one text."""
        plain, others = [], []
        for word in words:
            (plain if word[:1] == b" " and word[1:2] in _PLAIN else others).append(word)
        for i in range(0, len(plain), 20_000):
            part = plain[i : i + 20_000]
            ids = np.array(self.tokenizer.encode_batch_fast([b"".join(part).decode()], add_special_tokens=False)[0].ids, "<i4")
            ends, word_ends = np.cumsum(self.sizes[ids]), np.cumsum([len(w) for w in part])
            last = np.searchsorted(ends, word_ends) + 1
            if not np.array_equal(ends[last - 1], word_ends):
                raise AssertionError("a token spans two words")
            raw, cuts = ids.tobytes(), (4 * np.concatenate([[0], last])).tolist()
            for word, a, b in zip(part, cuts, cuts[1:], strict=False):
                cache.keep(word, raw[a:b])
        for i in range(0, len(others), 50_000):
            part = others[i : i + 50_000]
            for word, found in zip(part, self.tokenizer.encode_batch_fast([w.decode() for w in part], add_special_tokens=False), strict=True):
                cache.keep(word, array("i", found.ids).tobytes())

    def frequent(self, texts: list[str], most: int) -> dict[bytes, bytes]:
        """The ids of the texts' most frequent words."""
        starts, _ = word_starts(texts, self.words.classes)
        raw = "".join(texts).encode()
        counts = Counter(raw[a:b] for a, b in itertools.pairwise([*starts.tolist(), len(raw)]))
        found = Cache(0, 0)
        self._learn([w for w, _ in counts.most_common(most)], found)
        return dict(found)

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts one after the other, and how many each text has."""
        whole = {i for i, text in enumerate(texts) if any(x in text for x in self.added)}
        if not whole:
            return self.words.encode(texts)
        flat, sizes = self.words.encode(["" if i in whole else text for i, text in enumerate(texts)])
        ends = np.cumsum(sizes)
        parts, sizes, before = [], sizes.copy(), 0
        for i in sorted(whole):
            ids = np.array(self.tokenizer.encode(texts[i], add_special_tokens=False).ids, flat.dtype)
            parts += [flat[before : ends[i]], ids]
            sizes[i], before = len(ids), ends[i]
        return np.concatenate([*parts, flat[before:]]), sizes


def _write(shared, folder: str, end: int, file_ids: int):
    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        content, width, classes, known, kept = shared.value
        # A worker keeps its copy of the broadcast, so its next tasks find the encoder with the words it has met.
        if not kept:
            kept.append(LibraryEncoder(content, classes, known))
        encoder = kept[0]
        store, root = fs.FileSystem.from_uri(folder)
        part, written_files = TaskContext.get().partitionId(), 0

        def closed(writer: Writer) -> pa.RecordBatch:
            path = f"part-{part:05d}-{written_files:04d}-{uuid.uuid4().hex}.tids"
            writer.finish(store, f"{root}/{path}")
            row = {"part": part, "file": written_files, "path": path, "n_docs": len(writer.doc_ids), "n_ids": writer.n_ids}
            schema = pa.schema([("part", pa.int32()), ("file", pa.int32()), ("path", pa.string()), ("n_docs", pa.int64()), ("n_ids", pa.int64())])
            return pa.RecordBatch.from_pylist([row], schema)

        writer = Writer(width)
        for batch in batches:
            doc_ids, column = batch.column("doc_id").to_pylist(), batch.column("text")
            for i, j in slices((pc.binary_length(column).fill_null(0).to_numpy() + 1).tolist(), SLICE_BYTES):
                flat, sizes = encoder.encode([x.decode("utf-8", "replace") for x in raw_texts(column.slice(i, j - i))])
                last = np.cumsum(sizes)
                for doc_id, a, b in zip(doc_ids[i:j], (last - sizes).tolist(), last.tolist(), strict=True):
                    writer.add(doc_id, np.append(flat[a:b], end).astype("<u4"))
                    if writer.n_ids >= file_ids:
                        yield closed(writer)
                        writer, written_files = Writer(width), written_files + 1
        if writer.doc_ids:
            yield closed(writer)

    return write


def _sample(docs: DataFrame) -> list[str]:
    part = docs.where("text IS NOT NULL").limit(SAMPLE_DOCS).select(F.substring("text", 1, SAMPLE_CHARS).alias("t"))
    return [r["t"] for r in part.collect()]


def write_tokens(docs: DataFrame, tokenizer: str, folder: str, end: int = END, file_ids: int = FILE_IDS) -> DataFrame:
    """Write the ids of all texts, each closed by ``end``, in ascending order of ``doc_id``; nulls come first.

    ``tokenizer`` is the path of a byte-level BPE's JSON file (read on the driver), ``folder`` one that all executors
    reach. The ids of a text are the library's for the whole text without special tokens added; the string of an added
    token in a text is that token. Returns a table of the files: ``part, file, path, n_docs, n_ids, start`` (ids of all files before). A null or
    empty text has the closing id alone. Rows with the same id stand next to each other, ordered by a hash of their text;
    other columns are left out. An empty table gives no file.
    """
    import json

    spark = docs.sparkSession
    with open(tokenizer, encoding="utf-8") as file:
        content = file.read()
    settings = json.loads(content)
    expected = {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": True}
    if settings["normalizer"] or settings["post_processor"] or settings["pre_tokenizer"] != expected:
        raise ValueError("only plain byte-level tokenizers are cut into words here")
    added = [t["id"] for t in settings["added_tokens"]]
    size = max([*settings["model"]["vocab"].values(), *added, end]) + 1
    classes = class_table()
    known = LibraryEncoder(content, classes).frequent(_sample(docs), KNOWN_WORDS)
    shared = spark.sparkContext.broadcast((content, width_of(size), classes, known, []))
    store, root = fs.FileSystem.from_uri(folder)
    store.create_dir(root, recursive=True)
    partitions = int(spark.conf.get("spark.sql.shuffle.partitions"))
    texts = docs.select(F.col("doc_id").cast("long"), "text", F.xxhash64("text").alias("tie"))
    ordered = texts.repartitionByRange(partitions, "doc_id", "tie").sortWithinPartitions("doc_id", "tie")
    files = written(ordered.mapInArrow(_write(shared, folder, end, file_ids), _MANIFEST), "token-manifest")
    before = Window.orderBy("part", "file").rowsBetween(Window.unboundedPreceding, -1)
    return files.withColumn("start", F.coalesce(F.sum("n_ids").over(before), F.lit(0)))


def _read(folder: str, most: int):
    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = fs.FileSystem.from_uri(folder)
        for batch in batches:
            for path, start in zip(batch.column("path").to_pylist(), batch.column("start").to_pylist(), strict=True):
                with store.open_input_file(f"{root}/{path}") as file:
                    reader = Reader(file)
                    sizes = np.diff(reader.ends, prepend=0)
                    for i, j in slices(sizes.tolist(), most):
                        first = int(reader.ends[i] - sizes[i])
                        ids = reader.ids(first, int(reader.ends[j - 1])).tobytes()
                        at = (4 * (reader.ends[i:j] - first)).tolist()
                        columns = [
                            pa.array(reader.doc_ids[i:j], pa.int64()),
                            pa.array(start + reader.ends[i:j] - sizes[i:j], pa.int64()),
                            pa.array(sizes[i:j], pa.int64()),
                            pa.array([ids[a:b] for a, b in zip([0, *at], at, strict=False)], pa.binary()),
                        ]
                        yield pa.RecordBatch.from_arrays(columns, ["doc_id", "start", "n_tokens", "ids"])

    return read


def read_tokens(files: DataFrame, folder: str, most: int = READ_IDS) -> DataFrame:
    """``doc_id, start, n_tokens, ids`` of all documents in the files; ``ids`` are little-endian 32-bit integers."""
    partitions = int(files.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = files.select("path", "start").repartition(partitions)
    return dealt.mapInArrow(_read(folder, most), "doc_id long, start long, n_tokens long, ids binary")


def op6_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = scratch(spark, "token-files")
    files = write_tokens(documents(spark, sf_dir), public_tokenizers.path(VOCABULARY), folder)
    return read_tokens(files, folder).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))
