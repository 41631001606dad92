r"""Where words begin by the pattern of the byte-level tokenizers, for many texts at once.

The pattern is ``'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+``. So characters fall into
runs of letters, numbers, white space and others, and

* a run takes the space before it along;
* white space before another character is a word of its own up to its last character, which is the next word, or
  that space; white space at the end of a text is one word;
* an apostrophe that begins a run of others and has no space before it takes ``s t m d re ve ll`` along.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import public_tokenizers
import pyarrow as pa
import regex

from lakepulse.llm.spans import concatenated

PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
_OTHER, _LETTER, _NUMBER, _WHITE = range(4)


def class_table() -> np.ndarray:
    """The class of each code point."""
    if public_tokenizers.PATTERN != PATTERN:
        raise ValueError("the tokenizers' pattern isn't the one that word_starts follows")
    out = np.zeros(0x110000, np.uint8)
    for low, high in ((0, 0xD800), (0xE000, 0x110000)):
        points = "".join(map(chr, range(low, high)))
        for kind, name in ((_LETTER, r"\p{L}+"), (_NUMBER, r"\p{N}+"), (_WHITE, r"\s+")):
            for run in regex.finditer(name, points):
                out[low + run.start() : low + run.end()] = kind
    return out


def word_starts(texts: list[str], classes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Byte offsets of all words in the texts' joined UTF-8, and for each text (and the end) its first word's number."""
    points = np.frombuffer("".join(texts).encode("utf-32-le"), "<u4")
    n = len(points)
    text_ends = np.cumsum([0, *map(len, texts)])
    begins_text = np.zeros(n + 3, bool)
    begins_text[text_ends] = True
    kind = classes[points]
    run = begins_text[:n].copy()
    run[1:] |= kind[1:] != kind[:-1]
    start = run.copy()
    after_white = np.flatnonzero(run & (kind != _WHITE) & ~begins_text[:n])
    after_white = after_white[kind[after_white - 1] == _WHITE]
    start[after_white - 1] = True
    start[after_white[points[after_white - 1] == 32]] = False
    quotes = np.flatnonzero((points == 39) & run & start)
    if len(quotes):
        padded = np.concatenate([points, np.zeros(3, "<u4")])
        one, two = padded[quotes + 1], padded[quotes + 2]
        alone = ~begins_text[quotes + 1]
        short = alone & np.isin(one, [ord(c) for c in "stmd"])
        pair = np.isin(one * 65536 + two, [ord(a) * 65536 + ord(b) for a, b in ("re", "ve", "ll")]) & (two < 65536)
        long = alone & ~begins_text[quotes + 2] & pair
        start[quotes[short | long] + 1] = False
        following = np.concatenate([quotes[short] + 2, quotes[long] + 3])
        start[following[following < n]] = True
    at = np.flatnonzero(start)
    first = np.searchsorted(at, text_ends)
    if n and points.max() < 128:
        return at, first
    width = 1 + (points >= 0x80).astype(np.int64) + (points >= 0x800) + (points >= 0x10000)
    offset = np.cumsum(width) - width
    return offset[at], first


class Cache(dict):
    """Words and their ids, the bytes of little-endian 32-bit integers; emptied by ``trim`` when over its bounds."""

    def __init__(self, entries: int, size: int) -> None:
        self.entries, self.size, self.held = entries, size, 0

    def keep(self, word: bytes, ids: bytes) -> None:
        self[word] = ids
        self.held += len(word) + len(ids)

    def trim(self) -> None:
        if len(self) > self.entries or self.held > self.size:
            self.clear()
            self.held = 0


class WordEncoder:
    """Texts to ids by way of their distinct words; ``learn(words, cache)`` adds those that the cache hasn't yet."""

    def __init__(self, classes: np.ndarray, learn: Callable[[list[bytes], Cache], None], entries: int, size: int) -> None:
        self.classes, self.learn, self.words = classes, learn, Cache(entries, size)

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts one after the other, and how many each text has."""
        self.words.trim()
        raw = "".join(texts).encode()
        starts, first = word_starts(texts, self.classes)
        offsets = np.append(starts, len(raw)).astype("<i8")
        spans = pa.Array.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(offsets), pa.py_buffer(raw)])
        coded = spans.dictionary_encode()
        words, kind = coded.dictionary.to_pylist(), coded.indices.to_numpy(zero_copy_only=False)
        found = list(map(self.words.get, words))
        unknown = [i for i, ids in enumerate(found) if ids is None]
        if unknown:
            self.learn([words[i] for i in unknown], self.words)
            for i in unknown:
                found[i] = self.words[words[i]]
        ids, per_word = concatenated(found, kind, 4)
        before = np.concatenate([[0], np.cumsum(per_word)])
        return ids, np.diff(before[first])


def slices(sizes: list[int], most: int) -> list[tuple[int, int]]:
    """Ranges of items with about ``most`` together, each at least one item."""
    out, i, n = [], 0, 0
    for j, size in enumerate(sizes):
        n += size
        if n >= most:
            out.append((i, j + 1))
            i, n = j + 1, 0
    return [*out, (i, len(sizes))] if i < len(sizes) else out
