import hashlib
import random

import duckdb
import numpy as np
import pytest

from lakepulse.llm import vector_codes as v
from lakepulse.llm.queries import QUERIES

DDL = "vec_id long, label int, embedding array<float>, code string, v int"


def brute(rows, rounds=v.ROUNDS, entries=v.ENTRIES):
    """The contract in Python's whole numbers: (vec_id, code, error, label_error, digest) for each kept row."""
    kept = [r for r in rows if r[2] is not None and all(x is not None and np.isfinite(x) for x in r[2])]
    if not kept:
        return []
    length = -(-max(len(r[2]) for r in kept) // 4)
    whole = [[int(np.floor(1024 * np.float64(np.float32(x)))) for x in r[2]] + [0] * (4 * length - len(r[2])) for r in kept]
    order = sorted(range(len(kept)), key=lambda i: (kept[i][0] is None, kept[i][0] or 0, whole[i]))[:entries]
    part = lambda x, p: x[p * length : (p + 1) * length]
    books = [[part(whole[i], p) for i in order] for p in range(4)]

    def best(x, book):
        return min((sum((a - b) ** 2 for a, b in zip(x, c, strict=True)), e) for e, c in enumerate(book))

    for _ in range(rounds):
        for p, book in enumerate(books):
            members = {}
            for x in whole:
                members.setdefault(best(part(x, p), book)[1], []).append(part(x, p))
            books[p] = [[sum(c) // len(members[e]) for c in zip(*members[e], strict=True)] if e in members else c for e, c in enumerate(book)]
    digest = hashlib.sha256(",".join(str(n) for b in books for c in b for n in c).encode()).hexdigest()
    found = [[best(part(x, p), books[p]) for p in range(4)] for x in whole]
    errors = [sum(d for d, _ in f) for f in found]
    of_label = {}
    for r, e in zip(kept, errors, strict=True):
        of_label[r[1]] = of_label.get(r[1], 0) + e
    return [(r[0], "".join(f"{e:02x}" for _, e in f), err, of_label[r[1]], digest) for r, f, err in zip(kept, found, errors, strict=True)]


def _got(spark, rows, rounds=v.ROUNDS):
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], DDL).repartition(3)
    found = v.vector_codes(df, rounds).select("vec_id", "code", "error", "label_error", "codebooks_sha256")
    return sorted(map(tuple, found.collect()), key=repr)


def _rows(seed, count, length, smooth=False):
    rng = np.random.default_rng(seed)
    x = rng.normal(0, 0.3, (count, length))
    if smooth:
        x = np.cumsum(x, axis=1)
    return [(i, int(rng.integers(3)) if i % 5 else None, [float(np.float32(f)) for f in row]) for i, row in enumerate(x)]


@pytest.mark.parametrize(("length", "smooth"), [(16, False), (12, True), (4, False), (30, True)])
def test_equals_brute_force(spark, length, smooth):
    rows = _rows(length, 320, length, smooth)
    assert _got(spark, rows, 2) == sorted(brute(rows, 2), key=repr)


def test_awkward_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [
        (1, 1, [0.5, -0.5, 0.25, 1.0]), (1, 1, [0.5, -0.5, 0.25, 1.0]), (2, None, [0.5, -0.5, 0.25]), (None, 2, [1.0, 2.0, 3.0, 4.0]),
        (3, 1, None), (4, 1, [0.1, None, 0.2, 0.3]), (5, 1, [nan, 0.0, 0.0, 0.0]), (6, None, [inf, 0.0, 0.0, 0.0]), (7, 1, []),
        (8, None, [-1e-9, 0.0, -0.001, 1.5]), (9, 2, [0.5] * 9), (10, None, [1e4, -1e4, 65_000.0, 0.0]),
    ]
    assert _got(spark, rows) == sorted(brute(rows), key=repr)
    assert _got(spark, []) == [] and _got(spark, [(1, None, None)]) == []
    assert [r[1:4] for r in _got(spark, [(1, None, []), (2, None, [])])] == [("00000000", 0, 0)] * 2


def test_beyond_the_range_numbers_are_cut(spark):
    got = {r[0]: r[2] for r in _got(spark, [(1, 0, [1e30, 0.0, 0.0, -1e30]), (2, 0, [0.0, 0.0, 0.0, 0.0])])}
    assert got == {1: 0, 2: 0}


@pytest.mark.parametrize("size", [1, 2, 8, 64])
def test_transform_keeps_distances_by_sequency(size):
    h = np.array([[1]])
    while len(h) < size:
        h = np.block([[h, h], [h, -h]])
    rows = h[v.sequency_order(size)]
    assert [(np.diff(r) != 0).sum() for r in rows] == list(range(size))
    x = np.random.default_rng(1).integers(-1000, 1000, (50, size))
    assert (v.transformed(x) == x @ rows.T).all()
    assert ((v.transformed(x) ** 2).sum(axis=1) == size * (x * x).sum(axis=1)).all()


@pytest.mark.parametrize(("spread", "length", "few"), [(50, 16, 0.25), (50, 16, 1.1), (3, 5, 1.1), (2**25, 16, 0.25), (400, 33, 0.9), (1, 4, 1.1)])
def test_nearest_is_exact_with_ties(monkeypatch, spread, length, few):
    monkeypatch.setattr(v, "FEW", few)
    rng = np.random.default_rng(length)
    x, c = (rng.integers(-spread, spread + 1, (n, length)) for n in (300, 200))
    c[50:80] = c[:30]
    numbers, distances = v.nearest(x, c)
    every = ((x[:, None].astype(object) - c[None].astype(object)) ** 2).sum(axis=2)
    assert numbers.tolist() == [min(range(200), key=lambda e: (row[e], e)) for row in every]
    assert distances.tolist() == [min(row) for row in every]


def test_decoding_gives_the_entries(spark):
    rng = random.Random(1)
    rows = [(i, 0, [rng.random() for _ in range(8)]) for i in range(40)]
    whole = v.whole_vectors(spark.createDataFrame([(*r, "", 0) for r in rows], DDL))
    books = v.train(whole)
    for r in v.encode(whole, books).collect():
        back = books.decode(r["code"])
        assert sum((round(1024 * y) - int(np.floor(1024 * np.float32(x)))) ** 2 for x, y in zip(rows[r["vec_id"]][2], back, strict=True)) == r["error"]


def test_sql(spark, tiny):
    duckdb.sql(f"CREATE OR REPLACE VIEW embeddings AS SELECT * FROM '{tiny}/embeddings.parquet'")
    found = duckdb.sql(v.OP12_SQL)
    got = QUERIES["op12_vector_codes"](spark, tiny).select(*found.columns)
    assert sorted(found.fetchall()) == sorted(map(tuple, got.collect()))
