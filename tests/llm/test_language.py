from cases import awkward, frame

from lakepulse.llm import language_id as li
from lakepulse.llm.queries import QUERIES


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.01"
    docs = li.documents(spark, sf).select("doc_id", "lang")
    got = QUERIES["op2_language_id"](spark, sf).join(docs, "doc_id")
    for held, least in ((True, 0.98), (False, 0.98)):
        part = got.where(f"held_out = {held}")
        assert part.where("lang_pred = lang").count() >= least * part.count()
    assert got.where("score < 0 OR score > 1").count() == 0


def test_learning_leaves_out_what_is_held_out(spark):
    rows = [(i, "alpha beta gamma " * 5 if i % 2 else "uno dos tres " * 5, None if i == 4 else ("aa" if i % 2 else "bb"), None, None, None, None, None) for i in range(30)]
    docs = frame(spark, rows)
    learned = li.learn(docs.where(~li.held_out()))
    held = {r["doc_id"] for r in docs.where(li.held_out()).collect()}
    import zlib

    assert held == {i for i in range(30) if zlib.crc32(str(i).encode()) % 3 == 1}
    assert set(learned.dictionaries) == {"aa", "bb"}
    assert b"uno" not in learned.dictionaries["aa"] and b"alpha" not in learned.dictionaries["bb"]


def test_awkward_rows(spark):
    languages = li.Languages({"en": b" the and of to in was that river stone " * 20, "fr": b" un gar\xc3\xa7on na\xc3\xaff au bord de la rivi\xc3\xa8re " * 20})
    docs = frame(spark)
    got = li.identify(docs, languages)
    assert got.columns == [*docs.columns, "lang_pred", "score", "rejected"]
    rows = got.collect()
    assert len(rows) == len(awkward())
    for r in rows:
        letters = any(c.isalpha() for c in r["text"] or "")
        assert (r["lang_pred"] in ("en", "fr")) == letters
        if not letters:
            assert (r["lang_pred"], r["score"], r["rejected"]) == ("und", 0.0, True)
    assert li.identify(frame(spark, []), languages).count() == 0


def test_nothing_learned_and_one_language(spark):
    assert li.learn(frame(spark, [])).dictionaries == {}
    assert li.Judge(li.Languages({})).best("words") == ("und", 0.0)
    assert li.Judge(li.Languages({"en": b"words in a row"})).best("words") == ("en", 1.0)


def test_narrow_margins_are_rejected(spark):
    same = b" equal words in both of them " * 30
    got = li.identify(frame(spark), li.Languages({"a": same, "b": same}))
    assert got.where("rejected").count() == got.count() and got.where("lang_pred = 'b'").count() == 0


def test_long_texts_use_every_block():
    judge = li.Judge(li.Languages({"a": b" alpha beta gamma delta " * 100, "b": b" un deux trois quatre cinq " * 100}))
    assert judge.best("un deux trois " * 3 + "alpha beta gamma delta " * 4000)[0] == "a"


def test_equals_plain_version(spark, tiny):
    """Whole texts, one compressor made anew for each text and language."""
    import re
    import zlib

    import zstandard

    docs = li.documents(spark, tiny).select("doc_id", "text", "lang").collect()
    learned = li.learn(li.documents(spark, tiny).where(~li.held_out())).dictionaries
    assert set(learned) == {r["lang"] for r in docs if r["lang"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 3 != 1}
    got = {r["doc_id"]: r for r in QUERIES["op2_language_id"](spark, tiny).collect()}
    assert len(got) == len(docs)
    for r in docs:
        body = f" {' '.join(re.findall(r'[^\W\d_]+', (r['text'] or '').lower()))} ".encode()
        have = got[r["doc_id"]]
        assert have["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1)
        if not body.strip():
            assert (have["lang_pred"], have["score"]) == ("und", 0.0)
            continue
        sizes = []
        for lang, content in learned.items():
            known = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            n = 0
            for i in range(0, len(body), li.BLOCK_BYTES):
                one = zstandard.ZstdCompressor(level=li.LEVEL, dict_data=known, write_content_size=False, write_checksum=False, write_dict_id=False)
                n += len(one.compress(body[i : i + li.BLOCK_BYTES]))
            sizes.append((n, lang))
        least, second = sorted(n for n, _ in sizes)[:2]
        assert have["lang_pred"] == next(lang for n, lang in sizes if n == least)
        assert abs(have["score"] - (second - least) / second) < 1e-12
