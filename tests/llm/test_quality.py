import random

import numpy as np
import pytest
from brute import quality, repeat_mask
from cases import awkward, frame

from lakepulse.llm import quality_rules as q


def test_coverage_equals_brute_force():
    rng = random.Random(3)
    for _ in range(200):
        words = [rng.choice("ab c d e f g h".split()).encode() for _ in range(rng.randint(0, 60))]
        for n, mask in q.coverage(words, [1, 2, 3, 5, 7, 10]).items():
            assert set(np.flatnonzero(mask)) == repeat_mask(words, n), (n, words)


def test_equal_hashes_of_other_words_do_not_count():
    ids = np.array([0, 1, 2, 3, 0, 1])
    assert q._repeated(ids, np.zeros(5, np.uint64), np.arange(5), 2).tolist() == [0, 4]


def test_equals_brute_force(spark):
    got = {}
    df = q.quality_rules(frame(spark))
    for r in df.collect():
        measures = (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"])
        got.setdefault((r["doc_id"], r["text"]), []).append((*measures, r["base_failed"], r["kept"]))
    for doc_id, text, *_ in awkward():
        if text is not None and len(text) > 50_000:
            continue
        for row in got[doc_id, text]:
            assert row == quality(text, q.MAX_COVERED, q.MAX_LINE_COPIES), doc_id
    assert sum(len(x) for x in got.values()) == len(awkward())


def test_long_repetitive_text_fails_and_table_may_be_empty(spark):
    df = q.quality_rules(frame(spark))
    assert df.where("doc_id IN (51, 52, 53) AND kept").count() == 0
    assert df.where("doc_id = 11 AND kept").count() == 1 or df.where("doc_id = 11 AND base_failed").count() == 1
    assert q.quality_rules(frame(spark, [])).count() == 0


@pytest.mark.parametrize("lines, kept", [(1, True), (30, False)])
def test_copied_lines(lines, kept):
    body = " ".join(f"w{i}" for i in range(100)) + "\n" + "\n".join(["two words"] * lines)
    got = q.measure(body.encode(), [5])
    assert (got["line_copies"] <= q.MAX_LINE_COPIES) == kept


def text_of(n, seed):
    rng = random.Random(seed)
    return " ".join("".join(rng.choices("abcdefghij", k=rng.randint(3, 9))) for _ in range(n))


@pytest.mark.parametrize(
    "name, text, kept",
    [
        ("a short clean text with one line twice", f"{text_of(50, 1)}\n{text_of(12, 2)}\n{text_of(40, 3)}\n{text_of(12, 2)}", True),
        ("a long text with one passage of 40 words twice", f"{text_of(2000, 4)} {text_of(40, 5)} {text_of(500, 6)} {text_of(40, 5)}", True),
        ("a long text without repetition", text_of(5000, 7), True),
        ("40 percent of a long text in passages that it has twice", " ".join([text_of(600, 8), *[text_of(100, s) for s in (9, 10)] * 2]), False),
        ("many passages of six words", " ".join([text_of(1500, 11), *[f"{text_of(6, s % 40)} {text_of(2, 100 + s)}" for s in range(120)]]), False),
    ],
)
def test_verdicts_beyond_the_base_rules(spark, name, text, kept):
    row = q.quality_rules(spark.createDataFrame([(1, text)], "doc_id long, text string")).first()
    assert not row["base_failed"] and row["kept"] == kept, name
    assert quality(text, q.MAX_COVERED, q.MAX_LINE_COPIES)[-1] == kept
