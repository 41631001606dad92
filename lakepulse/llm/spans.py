"""Vectorised work on many spans of one array."""

from __future__ import annotations

import numpy as np


def inside(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The indices of all items of the spans, one span after the other."""
    total = int(sizes.sum())
    first = np.cumsum(sizes) - sizes
    return np.repeat(starts - first, sizes) + np.arange(total)


def concatenated(images: list[bytes], kind: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """The images of the spans one after the other (as items of ``width`` bytes), and the size of each."""
    pool = np.frombuffer(b"".join(images), {1: np.uint8, 4: "<i4"}[width])
    sizes = np.fromiter(map(len, images), np.int64, len(images)) // width
    first = np.cumsum(sizes) - sizes
    own = sizes[kind]
    return pool[inside(first[kind], own)], own
