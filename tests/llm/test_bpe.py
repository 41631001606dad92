import random
from types import SimpleNamespace

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import regex
import tiktoken
from brute import sha
from cases import awkward, frame
from pyspark.sql import types as T

from lakepulse.llm import byte_bpe
from lakepulse.llm.byte_bpe import VOCABULARY, Decoder, Merger, Tokenizer, Vocabulary, digests
from lakepulse.llm.pretokens import Cache, WordEncoder, class_table, word_starts
from lakepulse.llm.text import raw_texts

CHARS = "ab1 \n\t\x1c\x85\xa0​ 　\x0b''svetrlmd.!é日٣½Ⅷʼ́ः😀\r\x00"


@pytest.fixture(scope="module")
def vocabulary():
    with open(public_tokenizers.path(VOCABULARY), "rb") as file:
        return Vocabulary(file.read())


@pytest.fixture(scope="module")
def merger(vocabulary):
    return Merger(vocabulary, vocabulary.merges())


@pytest.fixture(scope="module")
def library(vocabulary):
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=vocabulary.ranks, special_tokens={})


def _texts(seed, n, most):
    rng = random.Random(seed)
    return ["".join(rng.choice(CHARS) for _ in range(rng.randint(0, most))) for _ in range(n)]


def test_words_are_those_of_the_pattern():
    table = class_table()
    texts = ["", " ", "\n", "a ", "\n a", "'s", "'", "'r", "'re're", "x'll", " 's", *_texts(1, 20_000, 14)]
    starts, first = word_starts(texts, table)
    raw = "".join(texts).encode()
    words = [raw[a:b].decode() for a, b in zip(starts, [*starts[1:], len(raw)], strict=True)]
    split = regex.compile(public_tokenizers.PATTERN)
    for i, text in enumerate(texts):
        assert words[first[i] : first[i + 1]] == split.findall(text), repr(text)


def test_encodes_as_the_library(merger, library):
    encoder = WordEncoder(class_table(), merger.learn, 1000, 10_000)  # so small that it is emptied again and again
    for seed in range(5):
        texts = _texts(seed, 2000, 20) + ["Quite ordinary words, isn't it? 12345 naïveté"]
        ids, sizes = encoder.encode(texts)
        got = [x.tolist() for x in np.split(ids, np.cumsum(sizes)[:-1])]
        assert got == [library.encode_ordinary(t) for t in texts]


def test_many_words_in_a_query(merger, library):
    """So many that rows fill many of DuckDB's vectors; their order in between doesn't matter."""
    rng = random.Random(5)
    parts = "th er in tion on re st le ing ed an the ou sh wh ha".split()
    words = sorted({" " + "".join(rng.choices(parts, k=rng.randint(1, 7))) for _ in range(40_000)})
    cache = Cache(10**6, 10**9)
    merger.learn([w.encode() for w in words], cache)
    assert all(np.frombuffer(cache[w.encode()], "<i4").tolist() == library.encode_ordinary(w) for w in words)


@pytest.mark.parametrize("letters", ["a", "ab", "the", "=-", "aehinorst", "abcdef0123456789", "é", "日本", " ", "ÃÂ"])
def test_long_words(merger, library, letters):
    rng = random.Random(letters)
    texts = ["".join(rng.choice(letters) for _ in range(n)) for n in (301, 900)]
    ids, sizes = WordEncoder(class_table(), merger.learn, 1000, 10**6).encode(texts)
    assert [x.tolist() for x in np.split(ids, np.cumsum(sizes)[:-1])] == [library.encode_ordinary(t) for t in texts]


def test_one_word_of_many_thousands(merger, library):
    cache = Cache(10, 10**7)
    word = b"a" * 50_000
    merger.learn([word], cache)
    assert np.frombuffer(cache[word], "<i4").tolist() == library.encode_ordinary(word.decode())


def test_decoding(vocabulary):
    decoder = Decoder(vocabulary.tokens())
    ids = np.arange(50_000, dtype=np.int32)
    by_id = {i: t for t, i in vocabulary.ranks.items()}
    whole = b"".join(by_id[i] for i in range(50_000))
    assert b"".join(decoder.decode(ids, np.array([10_000, 0, 40_000]))) == whole
    for bad in (-1, 50_256):
        with pytest.raises(ValueError):
            decoder.decode(np.array([bad], np.int32), np.array([1]))


def test_round_trip_of_awkward_rows(spark, library):
    tokenizer = Tokenizer(spark, public_tokenizers.path(VOCABULARY))
    docs = frame(spark)
    got = tokenizer.round_trip(docs)
    assert got.columns == [*docs.columns, "ids", "decoded"]
    rows = sorted([tuple(r) for r in digests(got).collect()], key=repr)
    expected = []
    for doc_id, text, *_ in awkward():
        ids = library.encode_ordinary(text or "")
        expected.append((doc_id, len(ids), sha(" ".join(map(str, ids))), sha(text or "")))
    assert rows == sorted(expected, key=repr)
    assert tokenizer.round_trip(frame(spark, [])).count() == 0


def test_decode_alone_takes_null_ids(spark):
    tokenizer = Tokenizer(spark, public_tokenizers.path(VOCABULARY))
    tokens = spark.createDataFrame([(1, [31373]), (2, None), (3, [])], "doc_id long, ids array<int>")
    both = {r["doc_id"]: bytes(r["decoded"]) for r in tokenizer.decode(tokens).collect()}
    assert both[2] == both[3] == b"" and len(both[1]) > 0


def test_arrow_lists_of_ids(spark):
    ids = Tokenizer(spark, public_tokenizers.path(VOCABULARY)).encode(frame(spark)).toArrow().column("ids")
    assert ids.type == pa.list_(pa.int32()) and ids.null_count == 0


def test_texts_leave_arrow_slice_by_slice(monkeypatch, vocabulary):
    """A batch may hold many more texts than a task has room for as Python objects."""
    taken = []

    def noted(column):
        taken.append(column.nbytes)
        return raw_texts(column)

    monkeypatch.setattr(byte_bpe, "raw_texts", noted)
    monkeypatch.setattr(byte_bpe, "SLICE_BYTES", 5_000)
    texts = [None, "", *(f"word {i} " * 50 for i in range(200)), None]
    batch = pa.RecordBatch.from_arrays([pa.array(texts)], ["text"])
    with open(public_tokenizers.path(VOCABULARY), "rb") as file:
        shared = SimpleNamespace(value=(file.read(), vocabulary.merges(), vocabulary.tokens(), class_table()))
    schema = T.StructType([T.StructField("text", T.StringType()), T.StructField("ids", T.ArrayType(T.IntegerType())), T.StructField("decoded", T.BinaryType())])
    got = pa.Table.from_batches(byte_bpe._add_columns(shared, "text", schema, ["text"], True, True, iter([batch])))
    assert got["decoded"].to_pylist() == [(t or "").encode() for t in texts]
    assert got["text"].to_pylist() == texts
    assert max(taken) < 10_000 < batch.nbytes


def test_ids_are_decoded_slice_by_slice(spark, monkeypatch, library):
    monkeypatch.setattr(byte_bpe, "SLICE_BYTES", 40)
    texts = [None, "", *(f"word {i} " * (i % 30) for i in range(100)), None]
    tokens = [(i, None if t is None else library.encode_ordinary(t)) for i, t in enumerate(texts)]
    got = Tokenizer(spark, public_tokenizers.path(VOCABULARY)).decode(spark.createDataFrame(tokens, "doc_id long, ids array<int>").coalesce(2))
    assert {r["doc_id"]: bytes(r["decoded"]).decode() for r in got.collect()} == {i: t or "" for i, t in enumerate(texts)}
