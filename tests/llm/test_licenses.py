import pytest
from cases import awkward, frame

from lakepulse.llm import license_scan as ls
from lakepulse.llm.queries import QUERIES

PLAIN = [f"The river ran under the old bridge {i} times in the year, free of all charge to the town." for i in range(60)]


@pytest.fixture(scope="module")
def model():
    return ls.train(PLAIN + ["Released under the MIT License.", "This work is licensed under the GNU General Public License, version 3."])


def test_templates_are_found_in_other_words(model):
    scanner = ls.Scanner(model)
    for family, texts in ls.TEMPLATES.items():
        for text in texts:
            for framed in (text, text.upper(), f"Note: {text}", f"{text} See the file for more."):
                ((n, found),) = scanner.scan([f"Some first line.\n\n{framed}"])
                assert n == 2 and [(k, f) for k, f, _, _ in found] == [(2, family)], framed
                assert found[0][3] >= ls.CONFIRMED and found[0][2] >= model.threshold


def test_other_text_is_none(model):
    others = ["The license of the captain.", "All rights of way.", "under the", "", "permission to leave was hereby refused by the person", *PLAIN]
    found = ls.Scanner(model).scan(others)
    assert not [f for _, fs in found for f in fs if f[3] >= ls.CONFIRMED]


def test_scores_equal_the_plain_sums(model):
    lines = [*PLAIN[:5], *[t for ts in ls.TEMPLATES.values() for t in ts]]
    p = model.probabilities(model.scores([ls.ngrams(ls.words(x)) for x in lines]))[:, :-1]
    scanned = ls.Scanner(model).scan(lines)
    for i, (_, found) in enumerate(scanned):
        assert bool(found) == (p[i].max() >= model.threshold)
        if found:
            assert found[0][2] == pytest.approx(p[i].max(), abs=1e-5)


def test_awkward_rows(spark, model):
    got = ls.scan_licenses(frame(spark), model).collect()
    assert len(got) == len(awkward())
    by_id = {r["doc_id"]: r["n_paragraphs"] for r in got}
    assert by_id[31] == by_id[32] == by_id[33] == by_id[30] == 0 and by_id[52] == 400
    assert ls.scan_licenses(frame(spark, []), model).count() == 0
    assert ls.train(ls.sample(frame(spark, []))).threshold >= 0.5


@pytest.mark.parametrize(
    "text, line, family",
    [
        ("All rights reserved.", 0, "proprietary"),
        ("Copyright (c) 2020 Example Ltd. All rights reserved.", 0, "proprietary"),
        ("Redistribution and use in source and binary forms, with or without\nmodification, are permitted provided that", 0, "BSD"),
        ("First.\n\n# This program is free software: you can redistribute it\n# under the terms of the GNU General Public License.\n", 2, "GPL"),
        ("A line of its own.\nThis program is free software:\nyou can redistribute it under\nthe terms of the GNU\nGeneral Public License.", 1, "GPL"),
        ("Released under\nthe MIT License.", 0, "MIT"),
    ],
)
def test_wrapped_headers_and_reserved_rights(model, text, line, family):
    ((_, found),) = ls.Scanner(model).scan([text])
    assert [(k, f) for k, f, _, s in found if s >= ls.CONFIRMED] == [(line, family)]
    assert all(f == ls.UNKNOWN or s >= ls.CONFIRMED for _, f, _, s in found)


def test_blank_lines_and_texts_part_notices(model):
    for texts in (["Released under\n\nthe MIT License."], ["Released under", "the MIT License."]):
        assert not [f for _, found in ls.Scanner(model).scan(texts) for f in found if f[1] == "MIT"]


@pytest.mark.parametrize(
    "text, family",
    [
        ("This work, like the rest, is licensed under the GNU General Public License, either version 2 or 3 as you like.", "GPL"),
        ("This Source Code Form is made subject to terms of the Mozilla Public License.", "MPL-2.0"),
        ("Permission is granted, free of charge, to anyone obtaining a copy of this software.", "MIT"),
        ("Redistribution and use in source or binary form, with or without changes, are permitted.", "BSD"),
    ],
)
def test_sure_families_are_confirmed_by_alignment(model, text, family):
    ((_, found),) = ls.Scanner(model).scan([text])
    ((line, got, p, near),) = found
    assert (line, got) == (0, family) and near < ls.CONFIRMED and p >= model.sure


def test_alignment():
    t = "a b c d e f".split()
    assert ls.aligned(t, t) == 6
    assert ls.aligned("x a b c x d e f x".split(), t) == 6 - ls.GAP
    assert ls.aligned("a b c e f".split(), t) == 5 - ls.GAP
    assert ls.aligned("f e d c b a".split(), t) == 1
    assert ls.aligned([], t) == ls.aligned(["x"], t) == 0
    assert ls.aligned(["a", "b", *["x"] * 100, "c", "d"], t) == 2


def plainly(model, text):
    """The notices of single lines, one line and template at a time."""
    n, out = 0, []
    for k, line in enumerate((text or "").split("\n")):
        tokens = ls.words(line)
        if not tokens:
            continue
        n += 1
        grams = ls.ngrams(tokens)
        p = model.probabilities(model.scores([grams]).astype(float))[0]
        best = int(p[:-2].argmax())
        family, texts = model.classes[best], ls.TEMPLATES[model.classes[best]]
        near = max(len(grams & ls.ngrams(ls.words(t))) / len(ls.ngrams(ls.words(t))) for t in texts)
        fits = [ls.aligned(tokens, ls.words(t)) >= max(ls.ALIGNED * len(ls.words(t)), ls.ALIGNED_WORDS) for t in texts]
        if (p[best] >= model.threshold and near >= ls.CONFIRMED) or (p[best] >= model.sure and any(fits)):
            out.append((k, family, float(p[best])))
        elif p[best] >= model.threshold or 1 - p[-1] >= model.doubt:
            out.append((k, ls.UNKNOWN, float(1 - p[-1])))
    return n, out


def test_query_equals_brute_force(spark, tiny):
    """The notices of the given tables stand in one line each."""
    docs = ls.documents(spark, tiny).select("doc_id", "text")
    model = ls.train(ls.sample(docs))
    got = {r["doc_id"]: r for r in QUERIES["op3_license_scan"](spark, tiny).collect()}
    rows = docs.collect()
    assert len(got) == len(rows)
    for r in rows:
        n, found = plainly(model, r["text"])
        sure = [x for x in found if x[1] != ls.UNKNOWN]
        have = got[r["doc_id"]]
        assert (have["n_paragraphs"], have["n_notices"], have["n_confirmed"]) == (n, len(found), len(sure)), r["text"]
        assert have["n_unknown"] == len(found) - len(sure)
        assert have["families"] == ",".join(sorted({f for _, f, _ in sure}))
        assert have["probability"] == pytest.approx(max((p for *_, p in sure), default=0.0), abs=1e-5)


@pytest.mark.parametrize(
    "text",
    [
        "Licensed under the Eclipse Public License, Version 2.0.",
        "This work is licensed under the European Union Public License, version 1.2.",
        "Released under the Boost Software License.",
        "This work is licensed under the\nArtistic License.",
    ],
)
def test_notices_of_other_families_are_unknown(spark, model, text):
    ((_, found),) = ls.Scanner(model).scan([text])
    assert found and {f for _, f, _, _ in found} == {ls.UNKNOWN}
    ((row),) = ls.scan_licenses(spark.createDataFrame([(1, text)], "doc_id long, text string"), model).collect()
    assert row["notices"] and not any(x["confirmed"] for x in row["notices"])


def test_query_counts_unknown_notices(spark):
    assert "n_unknown" in QUERIES["op3_license_scan"](spark, "/root/testdata/sf0.001").columns


def test_query_finds_every_notice(spark):
    sf = "/root/testdata/sf0.01"
    got = QUERIES["op3_license_scan"](spark, sf).join(ls.documents(spark, sf).select("doc_id", "text"), "doc_id").collect()
    for r in got:
        expected = {f for f, texts in ls.TEMPLATES.items() for t in texts if t in r["text"]}
        assert set(filter(None, r["families"].split(","))) == expected
