import random

import duckdb
import numpy as np
import pytest
from brute import line_dedup
from cases import awkward, frame, lower, split_words

import corpus_pipeline
from lakepulse.llm import near_texts as n
from lakepulse.llm import quality_rules as q
from lakepulse.llm.text import documents
from lakepulse.session import written


def _set(text, k=5):
    words = split_words(lower(text or ""))
    return frozenset(" ".join(words[i : i + k]) for i in range(max(1, len(words) - k + 1))) if words else frozenset()


def _alike(a, b):
    return a == b or (a and b and 5 * len(a & b) >= 4 * len(a | b))


def groups(docs):
    """For each row the smallest id that links of Jaccard 0.8 or more reach; all pairs are compared."""
    sets = [_set(t) for _, t in docs]
    root = list(range(len(docs)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            if 5 * min(len(a), len(sets[j])) >= 4 * max(len(a), len(sets[j])) and _alike(a, sets[j]):
                x, y = find(i), find(j)
                root[max(x, y)] = min(x, y)
    least = {}
    for i, (d, _) in enumerate(docs):
        if d is not None:
            least[find(i)] = min(d, least.get(find(i), d))
    return [(d, least.get(find(i))) for i, (d, _) in enumerate(docs)]


def _copies(seed, count):
    """Texts of 60 to 160 words and copies of them with up to three words changed."""
    rng = random.Random(seed)
    bases = [[f"w{rng.randrange(5_000)}" for _ in range(rng.randint(60, 160))] for _ in range(12)]
    out = []
    for i in range(count):
        words = list(rng.choice(bases))
        for _ in range(rng.randint(0, 3)):
            words[rng.randrange(len(words))] = f"x{rng.randrange(10**6)}"
        out.append((i, " ".join(words)))
    return out


@pytest.mark.parametrize("tile", [n.TILE, 2_000, 500])
def test_equals_comparing_all_pairs(spark, tile):
    docs = _copies(1, 150)
    got = n.near_texts(spark.createDataFrame(docs, "doc_id long, text string").repartition(3), tile=tile).collect()
    assert sorted(map(tuple, got)) == sorted(groups(docs))


def _far_copies(count, seed=2):
    """Copies of one text with so many words changed that few pairs are alike."""
    rng = random.Random(seed)
    base = [f"w{k}" for k in range(150)]
    pool = [f"x{k}" for k in range(40)]
    out = []
    for i in range(count):
        words = list(base)
        for _ in range(rng.randint(3, 9)):
            words[rng.randrange(150)] = rng.choice(pool)
        out.append((i, " ".join(words)))
    return out


def test_rows_between_steps_do_not_grow_with_the_square_of_a_group(spark, monkeypatch):
    def rows_written(count):
        most = []

        def counted(df, name):
            back = written(df, name)
            most.append((back.count(), name))
            return back

        monkeypatch.setattr(n, "written", counted)
        docs = _far_copies(count)
        got = n.near_texts(spark.createDataFrame(docs, "doc_id long, text string").repartition(3)).collect()
        if count == 200:
            assert sorted(map(tuple, got)) == sorted(groups(docs))
        return max(most)[0], sum(k for k, _ in most)

    small, large = rows_written(200), rows_written(800)
    # four times the copies; a square would be sixteen times (shared bands grow towards all bands)
    assert large[0] <= 6 * small[0] and large[1] <= 6 * small[1]
    assert large[0] <= 800 * n.BANDS


@pytest.mark.parametrize("seed", range(6))
def test_forest_links_connect_what_any_link_would(seed):
    rng = np.random.default_rng(seed)
    base = [rng.integers(0, 2**64, int(rng.integers(5, 80)), np.uint64) for _ in range(5)]
    sets = []
    for _ in range(60):
        chosen = base[rng.integers(5)]
        some = chosen[rng.random(len(chosen)) < rng.choice([0.8, 0.9, 0.97, 1.0])]
        sets.append(np.unique(np.concatenate([some, chosen[:1], rng.integers(0, 50, int(rng.integers(0, 6)), np.uint64)])))
    labels = rng.integers(0, 50, 60) if seed % 2 else np.arange(60)
    sides = rng.integers(0, 2, 60) if seed % 3 == 2 else None
    found = n.forest_links(np.concatenate(sets), np.array([len(x) for x in sets]), labels, sides, 0.8)

    def alike(i, j):
        both = len(np.intersect1d(sets[i], sets[j]))
        return 5 * both >= 4 * (len(sets[i]) + len(sets[j]) - both)

    def partition(links):
        root = np.unique(labels, return_inverse=True)[1]
        for a, b in links:
            root[root == root[a]] = root[b]
        return {frozenset(np.flatnonzero(root == r).tolist()) for r in set(root.tolist())}

    every = [(i, j) for i in range(60) for j in range(i) if (sides is None or sides[i] != sides[j]) and alike(i, j)]
    assert all(alike(i, j) for i, j in found) and len(found) < 60
    assert partition(found) == partition(every)


def test_awkward_rows(spark):
    got = [tuple(r) for r in n.near_texts(frame(spark)).collect()]
    assert sorted(got, key=repr) == sorted(groups([(r[0], r[1]) for r in awkward()]), key=repr)
    assert n.near_texts(frame(spark, [])).count() == 0


def test_bands_find_the_similarity():
    rng = np.random.default_rng(4)
    hits = 0
    for _ in range(300):
        both = rng.integers(0, 2**64, 100, np.uint64)
        a, b = np.unique(both[:90]), np.unique(both[10:])  # 80 of 100
        hits += bool({*n.bands(a)} & {*n.bands(b)})
    assert hits == 300


def test_linked_fingerprints_are_candidates(spark, monkeypatch):
    monkeypatch.setattr(n, "bands", lambda hashes, seed=0: [])
    words = [f"w{i}" for i in range(3_000)]
    docs = [(1, " ".join(words)), (2, " ".join([*words[:1_500], "changed", *words[1_501:]])), (3, " ".join(reversed(words)))]
    got = n.near_texts(spark.createDataFrame(docs, "doc_id long, text string")).collect()
    assert sorted(tuple(r) for r in got) == [(1, 1), (2, 1), (3, 3)]


def test_one_changed_word_is_a_copy_in_the_stage(spark, tiny):
    words = [f"w{i}" for i in range(120)]
    rows = [(k, " ".join([*words[: 10 * k], f"changed{k}", *words[10 * k + 1 :]])) for k in range(1, 9)]
    docs = spark.createDataFrame([*rows, (9, " ".join(reversed(words)))], "doc_id long, text string")
    assert sorted(r["doc_id"] for r in corpus_pipeline.near_duplicate(spark, docs, tiny).collect()) == [1, 9]


def test_stage_keeps_one_of_each_group(spark):
    sf = "/root/testdata/sf0.01"
    rows = duckdb.sql(f"SELECT doc_id, text FROM '{sf}/documents.parquet' ORDER BY doc_id").fetchall()
    kept = {r["doc_id"] for r in q.quality_rules(documents(spark, sf).select("doc_id", "text")).where("kept").collect()}
    now = [(d, t) for d, _, _, t in line_dedup([(d, t) for d, t in rows if d in kept])]
    got = corpus_pipeline.near_duplicate(spark, spark.createDataFrame(now, "doc_id long, text string"), sf).collect()
    assert sorted(r["doc_id"] for r in got) == sorted(d for d, least in groups(now) if d == least)
