from collections import defaultdict

import pytest
from cases import awkward, frame, split_words

from lakepulse.llm import mixing as m


def raked(cells, shares, budget, max_rate, tolerance=m.TOLERANCE, max_rounds=m.MAX_ROUNDS):
    """The rates by plain loops; ``cells`` maps keys to tokens."""
    total = sum(cells.values())
    goal = {c: n * budget for c, n in cells.items()}
    for _ in range(max_rounds):
        before = dict(goal)
        for d, share in enumerate(shares):
            there = {c[d] for c, n in cells.items() if n > 0}
            whole = sum(s for v, s in share.items() if v in there)
            sums = defaultdict(float)
            for c, g in goal.items():
                sums[c[d]] += g
            for c in goal:
                want = share.get(c[d], 0) * budget * total / whole if c[d] in there else 0
                goal[c] = min(goal[c] * (want / sums[c[d]] if sums[c[d]] else 0), cells[c] * max_rate)
        if max((abs(goal[c] - before[c]) / max(before[c], 1e-9) for c in cells if cells[c]), default=0) <= tolerance:
            break
    return {c: goal[c] / n if n else 0.0 for c, n in cells.items()}


CELLS = {("a", "x", "p"): 900, ("a", "y", "p"): 50, ("b", "x", "p"): 30, ("b", "y", "q"): 200, ("c", "x", "q"): 0, ("c", "y", "q"): 400}
SHARES = [{"a": 1, "b": 1, "c": 2}, {"x": 0.4, "y": 0.6, "z": 5}, {"p": 0.5, "q": 0.5}]


def _tables(spark, cells=CELLS, shares=SHARES):
    df = spark.createDataFrame([(*k, n) for k, n in cells.items()], "source string, lang string, topic string, tokens long")
    names = ["source", "lang", "topic"]
    targets = {d: spark.createDataFrame([(k, float(v)) for k, v in s.items()], "value string, share double") for d, s in zip(names, shares, strict=True)}
    return df, targets


@pytest.mark.parametrize("budget, max_rate", [(0.2, 1.0), (0.5, 1.0), (0.9, 2.5)])
def test_rates_equal_brute_force(spark, budget, max_rate):
    got = {tuple(r)[:3]: r["rate"] for r in m.rake(*_tables(spark), budget, max_rate).collect()}
    assert got == pytest.approx(raked(CELLS, SHARES, budget, max_rate), rel=1e-9)


def test_marginals_hold_where_nothing_is_capped(spark):
    shares = [{"a": 2, "b": 1, "c": 1}, {"x": 0.4, "y": 0.6, "z": 5}, {"p": 0.6, "q": 0.4}]
    rows = m.rake(*_tables(spark, shares=shares), 0.05, 1.0).collect()
    total = sum(r["rate"] * r["tokens"] for r in rows)
    for d, share in zip(("source", "lang", "topic"), shares, strict=True):
        there = {r[d] for r in rows if r["tokens"]}
        for value in there:
            part = sum(r["rate"] * r["tokens"] for r in rows if r[d] == value)
            assert part / total == pytest.approx(share[value] / sum(s for v, s in share.items() if v in there), rel=1e-3)


def test_unknown_value_gets_nothing_and_no_cells(spark):
    df, targets = _tables(spark, shares=[{"a": 1}, *SHARES[1:]])
    assert {r["rate"] for r in m.rake(df, targets).where("source <> 'a'").collect()} == {0.0}
    assert m.rake(df.where("false"), targets).count() == 0


def test_rows_and_copies(spark):
    docs = frame(spark)
    got = m.mix(docs, max_rate=3.0, budget=1.5)
    assert got.columns == [*docs.columns, "topic", "n_tokens", "rate", "copies"]
    rows = got.collect()
    assert len(rows) == len(awkward())
    cells = defaultdict(int)
    for r in rows:
        assert r["n_tokens"] == len(split_words(r["text"]))
        cells[r["source"] or m.NONE, r["lang"] or m.NONE, r["topic"]] += r["n_tokens"]
        assert int(r["rate"]) <= r["copies"] <= int(r["rate"]) + 1
    shares = []
    for d in range(3):
        sums = defaultdict(float)
        for c, n in cells.items():
            sums[c[d]] += n
        shares.append({k: v**m.POWER for k, v in sums.items()})
    rates = raked(cells, shares, 1.5, 3.0)
    for r in rows:
        assert r["rate"] == pytest.approx(rates[r["source"] or m.NONE, r["lang"] or m.NONE, r["topic"]], rel=1e-6)
    again = m.mix(docs.repartition(1), max_rate=3.0, budget=1.5).collect()
    key = lambda r: repr((r["doc_id"], r["text"], r["copies"]))
    assert sorted(map(key, rows)) == sorted(map(key, again))


def test_sample_follows_the_rates(spark):
    rows = [(i, "some words " * (1 + i % 5), "en" if i % 3 else "de", f"src{i % 4}", 1, None, None, None) for i in range(4000)]
    got = m.mix(frame(spark, rows), budget=0.5)
    r = got.selectExpr("sum(copies * n_tokens) AS taken", "sum(rate * n_tokens) AS expected").first()
    assert abs(r["taken"] / r["expected"] - 1) < 0.05


def test_topics(spark):
    texts = {"x MIT License y": "legal", "unlicensedx": "prose", "a | b": "tabular", "me@host.org": "contact", "Copyright 2020": "legal", None: "prose", "": "prose"}
    df = spark.createDataFrame([(t,) for t in texts], "text string").select("text", m.topic().alias("t"))
    assert {r["text"]: r["t"] for r in df.collect()} == texts


def test_empty_table(spark):
    assert m.mix(frame(spark, [])).count() == 0
