import zlib

import numpy as np
import public_tokenizers
import pytest
from cases import awkward, frame
from pyarrow import fs
from tokenizers import Tokenizer

from lakepulse.llm import token_files as t
from lakepulse.llm.pretokens import class_table


@pytest.mark.parametrize("width", [1, 3, 7, 8, 13, 16, 17, 31, 32])
@pytest.mark.parametrize("n", [0, 1, 7, 1001])
def test_packing(width, n):
    ids = np.random.default_rng(width).integers(0, 2**width, n, dtype=np.uint64).astype(np.uint32)
    raw = t.pack(ids, width)
    assert len(raw) == -(-n * width // 8)
    assert (t.unpack(raw, n, width) == ids).all()


def test_width_of_vocabularies():
    assert [t.width_of(n) for n in (1, 2, 3, 256, 257, 50_257, 65_536, 65_537)] == [1, 1, 2, 8, 9, 16, 16, 17]


def test_random_access(tmp_path):
    rng = np.random.default_rng(1)
    ids = rng.integers(0, 50_257, 3 * t.BLOCK_IDS + 17).astype("<u4")
    writer = t.Writer(16)
    for i, part in enumerate(np.split(ids, [5, 5, 70_000, 150_000])):
        writer.add(i if i else None, part)
    writer.finish(fs.LocalFileSystem(), str(tmp_path / "x"))
    with fs.LocalFileSystem().open_input_file(str(tmp_path / "x")) as file:
        reader = t.Reader(file)
        assert reader.doc_ids == [None, 1, 2, 3, 4] and reader.ends.tolist() == [5, 5, 70_000, 150_000, len(ids)]
        for a, b in [(0, len(ids)), (0, 0), (65_535, 65_537), (70_000, 70_001), (len(ids) - 1, len(ids))]:
            assert (reader.ids(a, b) == ids[a:b]).all()
    with pytest.raises(ValueError):
        t.Writer(4).add(1, np.array([16], "<u4"))


def test_files_hold_what_the_library_gives(spark, tmp_path):
    path = public_tokenizers.path(t.VOCABULARY)
    files = t.write_tokens(frame(spark), path, str(tmp_path / "tokens"), file_ids=3_000)
    assert files.count() > 3
    got = {}
    for r in t.read_tokens(files, str(tmp_path / "tokens"), most=1_000).collect():
        got.setdefault(r["doc_id"], []).append((r["start"], r["n_tokens"], zlib.crc32(r["ids"])))
    library = Tokenizer.from_file(path)
    expected, total = {}, 0
    for doc_id, text, *_ in awkward():
        ids = [*library.encode(text or "", add_special_tokens=False).ids, 0]
        expected.setdefault(doc_id, []).append((len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        total += len(ids)
    assert {k: sorted(x[1:] for x in v) for k, v in got.items()} == {k: sorted(v) for k, v in expected.items()}
    starts = sorted((start, n, doc_id) for doc_id, rows in got.items() for start, n, _ in rows)
    ids = [doc_id for _, _, doc_id in starts]
    assert ids == sorted(ids, key=lambda x: (x is not None, x))
    assert [s for s, _, _ in starts] == np.cumsum([0, *[n for _, n, _ in starts][:-1]]).tolist()
    assert starts[-1][0] + starts[-1][1] == total


def test_strings_of_added_tokens_are_those_tokens(spark, tmp_path):
    path = public_tokenizers.path(t.VOCABULARY)
    end = "<|endoftext|>"
    texts = ["plain text", f"a{end}b", end, f"{end}{end} two", "none", "", f"It's {end[:-1]} and {end}\n\n über", f"last {end} one", "after it"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    files = t.write_tokens(docs, path, str(tmp_path / "tokens"))
    got = sorted(t.read_tokens(files, str(tmp_path / "tokens")).collect())
    library = Tokenizer.from_file(path)
    expected = [[*library.encode(x, add_special_tokens=False).ids, 0] for x in texts]
    assert expected[1] == [64, 50256, 65, 0]
    assert [np.frombuffer(r["ids"], "<u4").tolist() for r in got] == expected
    assert [r["start"] for r in got] == np.cumsum([0, *map(len, expected[:-1])]).tolist()


def test_empty_table(spark, tmp_path):
    files = t.write_tokens(frame(spark, []), public_tokenizers.path(t.VOCABULARY), str(tmp_path / "none"))
    assert files.count() == 0 and t.read_tokens(files, str(tmp_path / "none")).count() == 0


def test_known_words_stay_when_the_cache_is_emptied(monkeypatch):
    with open(public_tokenizers.path(t.VOCABULARY), encoding="utf-8") as file:
        content = file.read()
    monkeypatch.setattr(t, "CACHE_ENTRIES", 20)
    classes = class_table()
    texts = ["It's the same the same the end", " of it", "unheard-of words: " + " ".join(f"w{i}" for i in range(60))]
    known = t.LibraryEncoder(content, classes).frequent(texts[:2], 4)
    assert set(known) <= {b" the", b" same", b"It", b"'s", b" end", b" of", b" it"} and b" the" in known
    encoder = t.LibraryEncoder(content, classes, known)
    library = Tokenizer.from_str(content)
    for text in [*texts, *texts]:
        ids, sizes = encoder.encode([text, ""])
        assert ids.tolist() == library.encode(text, add_special_tokens=False).ids and sizes.tolist() == [len(ids), 0]
        encoder.words.words.trim()
        assert known.items() <= encoder.words.words.items()
