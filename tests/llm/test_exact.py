import random
import tracemalloc

import pytest
from brute import exact
from cases import awkward, frame

from lakepulse.llm.exact_dedup import Trie, common, exact_dedup, merged


def _rows(seed, n=2000):
    rng = random.Random(seed)
    keys = ["".join(rng.choices("ab", k=rng.randint(0, 9))).encode() * rng.choice([1, 1, 40]) for _ in range(n)]
    return [(k, rng.choice([None, rng.randint(0, 500)]), rng.randint(1, 3)) for k in keys]


def _expected(rows):
    out = {}
    for key, owner, n in rows:
        before, total = out.get(key, (None, 0))
        least = min([x for x in (before, owner) if x is not None], default=None)
        out[key] = (least, total + n)
    return sorted((k, o, n) for k, (o, n) in out.items())


@pytest.mark.parametrize("limit", [0, 50, 1000, 10**9])
def test_tries_with_spills_lose_nothing(limit):
    rows = _rows(limit)
    got = list(merged(iter(rows), limit))
    assert sorted(got, key=lambda r: r[0]) == _expected(rows)


def test_edges_are_shared():
    trie = Trie()
    for key in (b"abcdef", b"abcxyz", b"abc", b"", b"abcdef"):
        trie.insert(key, 1)
    assert trie.held == 9 and trie.terminals == 4
    assert common(b"..abcd", 2, b"abxx") == 2 and common(b"ab", 0, b"abc") == 2


@pytest.mark.parametrize("limit", [10, 64_000_000])
def test_equals_brute_force(spark, limit):
    docs = [(r[0], r[1]) for r in awkward()]
    got = [tuple(r) for r in exact_dedup(frame(spark), limit).collect()]
    assert sorted(got, key=repr) == sorted(exact(docs), key=repr)


def test_empty_table(spark):
    assert exact_dedup(frame(spark, [])).count() == 0


@pytest.mark.parametrize("size", [3, 16, 200, 5000])
def test_a_full_trie_takes_about_the_memory_it_counts(size):
    """Short texts cost nodes, long ones bytes; both count."""
    rng, limit = random.Random(size), 4_000_000
    tracemalloc.start()
    trie = Trie()
    for i in range(10**6):
        if trie.memory > limit:
            break
        trie.insert(rng.randbytes(size), i)
    taken, _ = tracemalloc.get_traced_memory()
    tracemalloc.stop()
    assert trie.memory > limit and taken < 2.5 * limit
