import random

import numpy as np
import pytest
from brute import component_of, components, simhash
from cases import awkward, frame

from lakepulse.llm import simhash as s
from lakepulse.llm.components import components as connected


def _near(a, b, radius):
    return {(i, j) for i, x in enumerate(a) for j, y in enumerate(b) if int(x ^ y).bit_count() <= radius}


def _prints(seed, n, bits=6):
    """Values around a few centres, so that many are near."""
    rng = random.Random(seed)
    centres = [rng.getrandbits(64) for _ in range(4)]
    out = set()
    while len(out) < n:
        x = rng.choice(centres)
        for _ in range(rng.randint(0, bits)):
            x ^= 1 << rng.randrange(64)
        out.add(x)
    return np.array(sorted(out), np.uint64)


@pytest.mark.parametrize("radius", range(7))
def test_bit_planes_find_what_counting_bits_finds(radius):
    left, right = _prints(1, 300), _prints(1, 170, 9)
    got = set()
    for a, b in s.links_between(left, right, radius, block=70):
        got |= set(zip(a.tolist(), b.tolist(), strict=True))
    assert got == _near(left, right, radius)
    n = min(len(left), len(right))
    pairs = s.near_pairs(left[:n], right[:n], radius)
    assert pairs.tolist() == [int(x ^ y).bit_count() <= radius for x, y in zip(left[:n], right[:n], strict=True)]


def test_every_near_pair_shares_a_mask():
    rng = random.Random(2)
    for blocks in (5, 6, 7, 8):
        masks = s.block_masks(list(range(64)), blocks, 4)
        for _ in range(300):
            d = sum(1 << b for b in rng.sample(range(64), 4))
            assert any(d & m % 2**64 == 0 for m in masks)


@pytest.mark.parametrize("tile, blocks", [(4096, None), (16, 5), (8, 6), (30, 7)])
def test_links_connect_as_all_pairs_do(spark, tile, blocks):
    values = _prints(3, 260, 7)
    df = spark.createDataFrame([(int(v),) for v in values.view(np.int64)], "fp long")
    edges = [(r["a"], r["b"]) for r in s.links(df, len(values), tile=tile, blocks=blocks).collect()]
    index = {int(v): i for i, v in enumerate(values.view(np.int64))}
    root = list(range(len(values)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a, b in edges:
        x, y = find(index[a]), find(index[b])
        root[max(x, y)] = min(x, y)
    assert [find(i) for i in range(len(values))] == component_of([int(v) for v in values])


def test_components_of_paths_and_stars(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, x) for x in range(101, 130)] + [(-5, 7), (200, 201), (202, 201), (300, 300)]
    got = dict(map(tuple, connected(spark.createDataFrame(edges, "a long, b long")).collect()))
    assert {got[i] for i in range(41)} == {-5} and got[-5] == -5
    assert {got[i] for i in range(100, 130)} == {100} and got[202] == 200 and 300 not in got


def test_fingerprints_equal_brute_force():
    for _, text, *_ in awkward():
        assert s.fingerprint((text or "").encode()) == simhash(text)


def test_equals_brute_force(spark):
    docs = [(r[0], r[1]) for r in awkward()]
    got = [(r["doc_id"], r["fp"] % 2**64, r["component_id"]) for r in s.near_duplicates(frame(spark)).collect()]
    assert sorted(got, key=repr) == sorted(components(docs), key=repr)


def test_empty_table(spark):
    assert s.near_duplicates(frame(spark, [])).count() == 0
