import numpy as np
import pytest
from brute import line_dedup
from cases import awkward, frame

from lakepulse.llm.line_dedup import build_hash, dedup_lines, slots


@pytest.mark.parametrize("n", [0, 1, 5, 1000, 50_000])
def test_hash_is_minimal_and_perfect(n):
    rng = np.random.default_rng(n)
    hi, lo = rng.integers(-(2**63), 2**63 - 1, (2, n))
    found = slots(hi, lo, *build_hash(hi, lo))
    assert sorted(found) == list(range(n))


def test_keys_that_share_half_their_hash():
    hi = np.zeros(500, np.int64)
    lo = np.arange(500)
    assert sorted(slots(hi, lo, *build_hash(hi, lo))) == list(range(500))


def test_equals_brute_force(spark):
    docs = [(r[0], r[1]) for r in awkward()]
    got = dedup_lines(frame(spark))
    assert got.columns == ["doc_id", "text", "lang", "source", "n_chars", "kept", "n_words", "shard", "n_lines", "n_dropped"]
    rows = [(r["doc_id"], r["n_lines"], r["n_dropped"], r["text"] or "") for r in got.collect()]
    assert sorted(rows, key=repr) == sorted(line_dedup(docs), key=repr)
    assert sum(r[2] for r in rows) > 0


def test_null_text_stays_null_and_empty_table(spark):
    got = dedup_lines(frame(spark))
    assert got.where("doc_id = 30 AND text IS NULL AND n_lines = 1 AND n_dropped = 0").count() == 1
    assert dedup_lines(frame(spark, [])).count() == 0


def test_few_documents_or_short_lines_lose_nothing(spark):
    line = "x" * 39
    rows = [(i, f"{line}\n{'y' * 40}" if i < 4 else line, None, None, None, None, None, None) for i in range(8)]
    assert dedup_lines(frame(spark, rows)).where("n_dropped > 0").count() == 0
