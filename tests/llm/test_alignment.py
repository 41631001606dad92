import hashlib
import random
from collections import Counter

import duckdb
import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from cases import awkward, frame
from tokenizers import Tokenizer

from lakepulse.llm import token_alignment as t
from lakepulse.llm.queries import QUERIES

A, B = public_tokenizers.path(t.VOCABULARY_A), public_tokenizers.path(t.VOCABULARY_B)


@pytest.fixture(scope="module")
def libraries():
    first = Tokenizer.from_file(A)
    first.encode_special_tokens = True
    return first, sentencepiece.SentencePieceProcessor(model_file=B)


def _tokens(text, libraries):
    """Ids and bytes by both libraries, of the whole text."""
    first, second = libraries
    values = t.byte_values()
    a = first.encode(" " + text, add_special_tokens=False)
    b = second.encode(text)
    pieces = [second.id_to_piece(i) for i in b]
    spelt = [bytes([int(p[3:5], 16)]) if second.is_byte(i) else p.replace("▁", " ").encode() for i, p in zip(b, pieces, strict=True)]
    return list(zip(a.ids, [bytes(values[c] for c in x) for x in a.tokens], strict=True)), list(zip(b, spelt, strict=True))


def brute(docs, libraries):
    """The contract, token by token."""
    rows, links = [], []
    for doc_id, text in docs:
        a, b = _tokens(text, libraries) if text else ([], [])
        whole = (" " + (text or "")).encode()
        if not text or b"".join(x for _, x in a) != whole or b"".join(x for _, x in b) != whole:
            a, b = [], []
        ends = [dict(zip(np.cumsum([len(x) for _, x in side]).tolist(), [i for i, _ in side], strict=True)) for side in (a, b)]
        cuts = sorted({*ends[0]} & {*ends[1]})
        groups, low = [], 0
        for cut in cuts:
            groups.append("|".join(",".join(str(i) for e, i in side.items() if low < e <= cut) for side in ends))
            low = cut
        own = [(ends[0][c], ends[1][c]) for c in cuts]
        links.append(own)
        rows.append((doc_id, len(a), len(b), len(cuts), len(own), hashlib.sha256(";".join(groups).encode()).hexdigest() if a else ""))
    count = Counter(p for own in links for p in own)
    best = {}
    for (_, b), n in count.items():
        best[b] = max(n, best.get(b, 0))
    out = [(*r[:5], sum(count[p] == best[p[1]] for p in own), sum(count[p] for p in own), r[5]) for r, own in zip(rows, links, strict=True)]
    docs_of = Counter(p for own in links for p in {*own})
    return sorted(out, key=repr), {(a, b): (docs_of[a, b], n, n == best[b]) for (a, b), n in count.items()}


AWKWARD = [
    "a<|endoftext|>b <s> </s> <unk> <0x0A>", "a▁b", "  two  spaces  ", "\n\n\tx\r\n", "naïve ﬁ ① 漢字 🙂 é", "nul\x00byte", "　wide",
    "aaaa" * 50, "the the the the", " ", "don't we'll",
]


def test_whole_result_equals_brute_force(spark, libraries):
    docs = [(r[0], r[1]) for r in awkward()] + [(100 + i, x) for i, x in enumerate(AWKWARD)] + [(100, AWKWARD[0])]
    rows = spark.createDataFrame([(*r, "x") for r in docs], "doc_id long, text string, n_a string").repartition(3)
    expected, scores = brute(docs, libraries)
    for limits in ({}, {"block_docs": 5}, {"block_bytes": 2_000}):
        found = t.Alignment(rows, A, B, **limits)
        assert sorted(map(tuple, found.documents.collect()), key=repr) == expected
        assert {(r["a"], r["b"]): (r["n_docs"], r["n_links"], r["best"]) for r in found.scores.collect()} == scores


def test_query_equals_brute_force(spark, tiny, libraries):
    docs = duckdb.sql(f"SELECT doc_id, text FROM '{tiny}/documents.parquet'").fetchall()
    assert sorted(map(tuple, QUERIES["op11_token_alignment"](spark, tiny).collect()), key=repr) == brute(docs, libraries)[0]


def test_empty_table(spark):
    found = t.Alignment(frame(spark, []), A, B)
    assert found.documents.count() == 0 and found.scores.count() == 0


def test_long_texts_are_cut_without_a_trace(libraries, monkeypatch):
    with open(B, "rb") as file:
        second = t.Second(file.read())
    rng = random.Random(3)
    texts = ["".join(rng.choices(["a", "the", " ", "  ", "▁", "\n", "\r", "é", ".", " in"], k=4_000)) for _ in range(5)]
    whole = [second.library.encode(x) for x in texts]
    monkeypatch.setattr(t, "PART_CHARS", 50)
    ids, sizes = second.encode([*texts, "", "x"])
    assert second.cuts and max(len(second.parts(x)) for x in texts) > 20
    assert [x.tolist() for x in np.split(ids, np.cumsum(sizes)[:-1])] == [*whole, [], second.library.encode("x")]


@pytest.mark.parametrize("seed", range(4))
def test_bitmaps_hold_documents_and_links(seed):
    rng = np.random.default_rng(seed)
    docs, pairs = rng.integers(0, t.BLOCK_DOCS, 20_000), rng.zipf(1.3, 20_000) % 3_000
    docs[: 3_000 * (seed % 2)] = 77
    # Planes are merged where documents differ, as those of a block's slices do.
    low = docs < 2_000
    parts = [t.planes(docs[m], pairs[m]) for m in (low, ~low)]
    keys, bits = t.or_merged(*(np.concatenate(x) for x in zip(*parts, strict=True)))
    links = Counter(zip(docs.tolist(), pairs.tolist(), strict=True))
    found, n_docs, n_links = t.popcounts(keys, bits)
    assert found.tolist() == sorted({*pairs.tolist()})
    held = Counter(p for _, p in links)
    assert n_docs.tolist() == [held[p] for p in found.tolist()]
    assert dict(zip(found.tolist(), n_links.tolist(), strict=True)) == Counter(pairs.tolist())
    scores = rng.integers(0, 1_000, (len(found), 2))
    sums = t.sums_by_doc(keys, bits, scores, t.BLOCK_DOCS)
    at = {p: i for i, p in enumerate(found.tolist())}
    expected = np.zeros_like(sums)
    for (d, p), n in links.items():
        expected[d] += n * scores[at[p]]
    assert (sums == expected).all()
