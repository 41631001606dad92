import hashlib
import itertools
import random
import re

import duckdb
import numpy as np
import pytest
from cases import awkward, frame

from lakepulse.llm import personal_data as p
from lakepulse.llm.queries import QUERIES
from lakepulse.llm.text import documents

PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def _luhn(digits):
    total = 0
    for i, d in enumerate(map(int, reversed(digits))):
        total += d if i % 2 == 0 else (2 * d if d < 5 else 2 * d - 9)
    return total % 10 == 0


def brute(text):
    """The contract's patterns as they stand."""
    out = []
    for kind, (name, pattern) in enumerate(PATTERNS.items()):
        for m in re.finditer(pattern, text or ""):
            digits = re.sub("[^0-9]", "", m[0])
            fine = {
                "email": lambda m=m: True,
                "ip": lambda m=m: all(int(x) <= 255 for x in m[0].split(".")),
                "card": lambda digits=digits: 16 <= len(digits) <= 19 and _luhn(digits),
                "phone": lambda digits=digits: 8 <= len(digits) <= 15,
            }
            if fine[name]():
                out.append((kind, m.start(), m.end()))
    return out


@pytest.mark.parametrize("seed", range(5))
def test_base_rules_equal_the_patterns(seed):
    rng = random.Random(seed)
    bits = ["a", "x.y", "@", "@b.c", ".", "..", "1", "255", "256", "007", "+", "+1", " ", "-", "(", ")", "é", "٣", "\n", "4539148803436467", "4539 1488", "_%"]
    for _ in range(3_000):
        text = "".join(rng.choices(bits, k=rng.randint(0, 25)))
        assert p.base_spans(text) == brute(text), text
    number = "4539148803436467"
    for text in (number, " ".join(number), f"{number}0", "1.2.3.4.5.6.7.8.9", "1.2.3.999.5.6.7.8", "a@b@c.d", "a@b.c@d.e", "+1 2" * 9, f"+{number[:15]}", f"+{number}"):
        assert p.base_spans(text) == brute(text), text


def test_base_rules_take_linear_time_on_long_runs():
    for run in ("a" * 1_000_000, "1" * 1_000_000, "1." * 500_000, "a@" * 500_000, "+1" * 500_000, "1 " * 500_000, "@" * 1_000_000):
        p.base_spans(run)


def test_gradient():
    model = p.Model.new(1)
    model.weights = {k: w.astype(float) for k, w in model.weights.items()}
    examples = p.made(["some words here now", "ein Text mit Wort"], 6, seed=3)
    chars, sizes = p.encoded([t for t, _ in examples])
    tags = np.zeros(chars.shape, np.int64)
    for row, (text, spans) in zip(tags, examples, strict=True):
        row[: len(text)] = p.tags_of(len(text), spans)
    mask = (np.arange(chars.shape[1]) < sizes[:, None]).T.astype(float)
    _, gradient = model.loss(chars.T, mask, tags.T)
    rng = np.random.default_rng(0)
    for name, g in gradient.items():
        w = model.weights[name]
        at = (0, 0) if name == "moves" else (int(chars[0, 2]), 5) if name.endswith("table") else tuple(int(rng.integers(n)) for n in w.shape)
        old, found = w[at], []
        for step in (1e-3, -1e-3):
            w[at] = old + step
            found.append(model.loss(chars.T, mask, tags.T)[0])
        w[at] = old
        assert g[at] == pytest.approx((found[0] - found[1]) / 2e-3, rel=1e-3, abs=1e-5)


def test_decoding_finds_the_best_sequence_and_its_posterior():
    model = p.Model.new(5)
    model.weights["out"] *= 8
    texts = ["a1@", "(0)x", "9"]
    for text, found in zip(texts, model.decode(texts), strict=True):
        chars, _ = p.encoded([text])
        emission = model.emission(model.states(chars.T, np.ones((len(text), 1), np.float32)))[:, 0]
        scores = {}
        for tags in itertools.product(range(p.N_TAGS), repeat=len(text)):
            scores[tags] = p._START[tags[0]] + emission[0, tags[0]] + sum(model.moves[a, b] + emission[t + 1, b] for t, (a, b) in enumerate(itertools.pairwise(tags)))
        best = max(scores, key=scores.get)
        assert np.array_equal(p.tags_of(len(text), [s for s, _ in found]), best)
        total = sum(np.exp(s - scores[best]) for s in scores.values())
        for (k, a, b), sure in found:
            posterior = [sum(np.exp(s - scores[best]) for tags, s in scores.items() if tags[t] == best[t]) / total for t in range(a, b)]
            assert sure == pytest.approx(min(posterior), rel=1e-3)


def test_windows_overlap_and_cover_what_tells():
    text = "x" * 300 + "1" * 150 + "y" * 100 + " me (at) home " + "z" * 100 + "7"
    found = p.windows(text, [(0, 300, 310)])
    stretches = sorted({(a, b) for *_, a, b in found})
    assert stretches == [(290, 470), (534, 578), (644, 665)]
    for first, last in stretches:
        own = [(a, b) for a, b, x, y in found if (x, y) == (first, last)]
        assert own[0][0] == first and own[-1][1] == last and all(b - a <= p.WINDOW for a, b in own)
        assert all(n[0] - m[0] == p.STEP and n[0] < m[1] for m, n in itertools.pairwise(own))
    assert p.windows("no sign of it", []) == [] and p.windows("12", [(1, 0, 2)]) == []


def test_spans_of_overlapping_windows_are_reconciled():
    text = "call (020) 555-0199 or 020-555-0188 now, a@b.cc"
    base = p.base_spans(text)
    cut = [((3, 5, 14), 0.9, False, True), ((3, 12, 19), 0.8, True, False), ((3, 23, 35), 0.9, False, False), ((3, 23, 35), 0.7, False, False)]
    assert p.reconciled(text, base, cut, 0.5) == [*base, (3, 23, 35), (3, 5, 19)]
    assert p.reconciled(text, base, cut, 0.85) == [*base, (3, 23, 35)]
    assert p.reconciled(text, base, [((0, 41, 47), 0.99, False, False), ((2, 23, 35), 0.99, False, False)], 0.5) == base
    rng = random.Random(2)
    for _ in range(200):
        best = {(rng.randrange(4), a, a + rng.randint(1, 9)): rng.random() for a in (rng.randrange(30) for _ in range(8))}
        worth = lambda spans: sum(best[s] * (s[2] - s[1]) for s in spans)
        free = [c for n in range(len(best) + 1) for c in itertools.combinations(best, n) if all(x[2] <= y[1] or y[2] <= x[1] for x, y in itertools.combinations(c, 2))]
        found = p.chosen(best)
        assert worth(found) == pytest.approx(max(map(worth, free)))
        assert all(x[2] <= y[1] or y[2] <= x[1] for x, y in itertools.combinations(found, 2))


@pytest.fixture(scope="module")
def trained(spark):
    return p.train(p.sample(documents(spark, "/root/testdata/sf0.01").select("doc_id", "text")))


def test_held_out_variants_and_clean_texts(trained):
    texts = [t or "" for (t,) in duckdb.sql("SELECT text FROM '/root/testdata/sf0.1/documents.parquet' ORDER BY doc_id DESC LIMIT 1500").fetchall()]
    contexts = [t for t, _ in p.labelled(texts)]
    examples = p.made(contexts, 600, seed=99)
    found = p.scan([t for t, _ in examples], trained)
    hits = [s[0] in every for (_, s), (_, every) in zip(examples, found, strict=True) if s]
    false = [bool(every) for (_, s), (_, every) in zip(examples, found, strict=True) if not s]
    assert np.mean(hits) >= 0.85 and np.mean(false) <= 0.02
    clean = p.scan(texts, trained)
    assert [b for b, _ in clean] == [brute(t) for t in texts]
    assert sum(len(every) > len(base) for base, every in clean) <= 3


def test_awkward_rows(spark, trained):
    special = [(200, "mail me: jo.doe (at) example (dot) org"), (201, "a@b.cc\n+1 (743) 555-3824"), (202, "1" * 3_000), (203, "🙂 x@y.zz é"), (203, "🙂 x@y.zz é")]
    docs = [(r[0], r[1]) for r in awkward()] + special
    rows = spark.createDataFrame([(*r, "x") for r in docs], "doc_id long, text string, spans string").repartition(3)
    got = sorted(map(tuple, p.personal_data(rows, trained).collect()), key=repr)
    expected = []
    for (doc_id, text), (base, every) in zip(docs, p.scan([t or "" for _, t in docs], trained), strict=True):
        assert base == brute(text) and set(base) <= set(every)
        expected.append((doc_id, *[sum(k == s[0] for s in base) for k in range(4)], p.listed(base), p.listed(every)))
    assert got == sorted(expected, key=repr)
    assert p.personal_data(frame(spark, [])).count() == 0


def test_query_equals_brute_force(spark, tiny):
    docs = dict(duckdb.sql(f"SELECT doc_id, text FROM '{tiny}/documents.parquet'").fetchall())
    got = QUERIES["op13_personal_data"](spark, tiny).collect()
    assert sorted(r["doc_id"] for r in got) == sorted(docs)
    for r in got:
        base = brute(docs[r["doc_id"]])
        assert [r[f"n_{k}"] for k in p.KINDS] == [sum(i == s[0] for s in base) for i in range(4)]
        assert r["base_sha256"] == hashlib.sha256(p.listed(base).encode()).hexdigest()
        assert set(filter(None, p.listed(base).split(","))) <= set(r["spans"].split(","))
