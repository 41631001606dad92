"""Exact duplicates: equal texts have one owner, the row with the smallest ``doc_id``.

1. Each map task inserts its normalised texts, whole, into a Patricia trie (a radix trie whose edges hold byte strings).
   A terminal node keeps the smallest id and the number of rows. When the trie holds enough bytes, its terminals are
   handed on and it starts anew; so a text that fills a third of the rows leaves a task a few times at most.
2. What is handed on is dealt by length and content hash, so equal texts meet, and a task's share is even.
3. There the byte strings, with their hash in front, go into tries again, one for each first byte. If these hold too
   much, the largest is spilled to a file of the task, as are later strings with its byte; spilled subtrees are
   worked off one after the other, by their next byte. A task run anew starts with nothing.
4. Owners come back to all rows by the SHA-256 of the text. Adaptive execution splits the join of a frequent text.
"""

from __future__ import annotations

import hashlib
import re
import struct
import tempfile
from collections.abc import Iterable, Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lakepulse.llm.text import WHITE_PATTERN, documents, hex_digest, raw_texts

#: Bytes that a task's tries may hold: their strings, and about as many bytes a node as Python needs for it.
HELD_BYTES = 64_000_000
NODE_BYTES = 300

_RUNS = re.compile(rb"[\x20\x09-\x0D]+")
_RECORD = "<qq?q"
_GROUPS = "size long, hash long, text binary, owner long, n long"

Row = tuple[bytes, int | None, int]


def smaller(a: int | None, b: int | None) -> int | None:
    return b if a is None else a if b is None else min(a, b)


def common(key: bytes, at: int, label: bytes) -> int:
    """How many bytes of the label the key has at a place."""
    low, high = 0, min(len(label), len(key) - at)
    while low < high:
        middle = (low + high + 1) // 2
        if key.startswith(label[low:middle], at + low):
            low = middle
        else:
            high = middle - 1
    return low


class Node:
    __slots__ = ("children", "label", "n", "owner")

    def __init__(self, label: bytes, owner: int | None = None, n: int = 0) -> None:
        self.label, self.owner, self.n = label, owner, n
        self.children: dict[int, Node] = {}


class Trie:
    """Byte strings with the smallest id and the number of rows; ``held`` counts the bytes on edges, ``nodes`` the edges."""

    def __init__(self) -> None:
        self.root, self.held, self.nodes, self.terminals = Node(b""), 0, 0, 0

    @property
    def memory(self) -> int:
        return self.held + NODE_BYTES * self.nodes

    def insert(self, key: bytes, owner: int | None, n: int = 1) -> None:
        node, at = self.root, 0
        while at < len(key):
            child = node.children.get(key[at])
            if child is None:
                child = node.children[key[at]] = Node(key[at:])
                self.held += len(key) - at
                self.nodes += 1
                node, at = child, len(key)
            elif key.startswith(child.label, at):
                node, at = child, at + len(child.label)
            else:
                cut = common(key, at, child.label)
                above = Node(child.label[:cut])
                above.children[child.label[cut]] = child
                node.children[key[at]] = above
                child.label = child.label[cut:]
                self.nodes += 1
                node, at = above, at + cut
        if node.n:
            node.owner = smaller(node.owner, owner)
        else:
            node.owner = owner
            self.terminals += 1
        node.n += n

    def items(self) -> Iterator[Row]:
        stack = [(self.root, b"")]
        while stack:
            node, before = stack.pop()
            key = before + node.label
            if node.n:
                yield key, node.owner, node.n
            stack.extend((child, key) for child in node.children.values())


class Spill:
    """A subtree's strings in a file that goes with the task."""

    def __init__(self) -> None:
        self.file = tempfile.TemporaryFile()

    def write(self, key: bytes, owner: int | None, n: int) -> None:
        self.file.write(struct.pack(_RECORD, len(key), owner or 0, owner is not None, n))
        self.file.write(key)

    def read(self) -> Iterator[Row]:
        with self.file as file:
            file.seek(0)
            while head := file.read(struct.calcsize(_RECORD)):
                size, owner, has_owner, n = struct.unpack(_RECORD, head)
                yield file.read(size), owner if has_owner else None, n


def merged(rows: Iterable[Row], limit: int = HELD_BYTES, depth: int = 0) -> Iterator[Row]:
    """One row for each string, with about ``limit`` bytes of tries in memory; strings agree up to ``depth``."""
    tries: dict[bytes, Trie] = {}
    spilled: dict[bytes, Spill] = {}
    held = 0
    for key, owner, n in rows:
        branch = key[depth : depth + 1]
        if branch in spilled:
            spilled[branch].write(key, owner, n)
            continue
        trie = tries.setdefault(branch, Trie())
        held -= trie.memory
        trie.insert(key, owner, n)
        held += trie.memory
        while held > limit and (large := [b for b, t in tries.items() if t.terminals > 1]):
            branch = max(large, key=lambda b: tries[b].memory)
            trie = tries.pop(branch)
            held -= trie.memory
            spilled[branch] = Spill()
            for row in trie.items():
                spilled[branch].write(*row)
    for branch in list(tries):
        yield from tries.pop(branch).items()
    for branch in list(spilled):
        yield from merged(spilled.pop(branch).read(), limit, depth + 1)


def _before(limit: int):
    def before(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Texts of a map task, each about once."""

        def handed(trie: Trie) -> Iterator[pa.RecordBatch]:
            rows: list[Row] = []
            size = 0
            for row in trie.items():
                rows.append(row)
                size += len(row[0])
                if size > limit // 8:
                    yield batch_of(rows)
                    rows, size = [], 0
            yield batch_of(rows)

        def batch_of(rows: list[Row]) -> pa.RecordBatch:
            keys = [key for key, _, _ in rows]
            hashes = [int.from_bytes(xxhash.xxh3_64_digest(k), "little", signed=True) for k in keys]
            columns = [
                pa.array([len(k) for k in keys], pa.int64()),
                pa.array(hashes, pa.int64()),
                pa.array(keys, pa.binary()),
                pa.array([owner for _, owner, _ in rows], pa.int64()),
                pa.array([n for _, _, n in rows], pa.int64()),
            ]
            return pa.RecordBatch.from_arrays(columns, ["size", "hash", "text", "owner", "n"])

        trie = Trie()
        for batch in batches:
            for doc_id, raw in zip(batch.column("doc_id").to_pylist(), raw_texts(batch.column("text")), strict=True):
                trie.insert(_RUNS.sub(b" ", raw), doc_id)
                if trie.memory > limit:
                    yield from handed(trie)
                    trie = Trie()
        yield from handed(trie)

    return before


def _after(limit: int):
    def after(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows() -> Iterator[Row]:
            for batch in batches:
                hashes = batch.column("hash").to_pylist()
                texts = batch.column("text")
                owners, counts = batch.column("owner").to_pylist(), batch.column("n").to_pylist()
                for i, hashed in enumerate(hashes):
                    yield hashed.to_bytes(8, "little", signed=True) + texts[i].as_py(), owners[i], counts[i]

        digests, owners, counts = [], [], []
        for key, owner, n in merged(rows(), limit):
            digests.append(hashlib.sha256(memoryview(key)[8:]).hexdigest())
            owners.append(owner)
            counts.append(n)
        columns = [pa.array(digests, pa.string()), pa.array(owners, pa.int64()), pa.array(counts, pa.int64())]
        yield pa.RecordBatch.from_arrays(columns, ["text_sha256", "keep_id", "group_size"])

    return after


def owners(docs: DataFrame, limit: int = HELD_BYTES) -> DataFrame:
    """``text_sha256, keep_id, group_size``: one row for each normalised text."""
    texts = docs.select(F.col("doc_id").cast("long"), "text")
    partitions = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = texts.mapInArrow(_before(limit // 2), _GROUPS).repartition(partitions, "size", "hash")
    return dealt.mapInArrow(_after(limit), "text_sha256 string, keep_id long, group_size long")


def exact_dedup(docs: DataFrame, limit: int = HELD_BYTES) -> DataFrame:
    """``doc_id, keep_id, group_size, kept, text_sha256``: one row for each row of ``docs``, in any order.

    Texts are equal if they are identical after each run of white space has become one space; a null text is empty.
    The smallest ``doc_id`` of equal texts stays. Rows that are repeated with that id are all marked as kept. A null id
    is larger than any other; a text that has only null ids has the ``keep_id`` null and keeps its rows. Other columns of
    ``docs`` are left out, so their names don't matter. An empty table gives an empty table.
    """
    plain = F.regexp_replace(F.coalesce("text", F.lit("")), f"{WHITE_PATTERN}+", " ")
    rows = docs.select(F.col("doc_id").cast("long"), hex_digest(plain).alias("text_sha256"))
    joined = rows.join(owners(docs, limit), "text_sha256")
    return joined.select("doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), "text_sha256")


def op9_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(documents(spark, sf_dir))


OP9_SQL = r"""
WITH plain AS (
  SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS t FROM documents
),
owned AS (SELECT *, min(doc_id) OVER (PARTITION BY t) AS keep_id, count(*) OVER (PARTITION BY t) AS group_size FROM plain)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(t) AS text_sha256 FROM owned
"""
