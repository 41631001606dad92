"""Documents with awkward rows, and small helpers."""

import random
import re

DDL = "doc_id long, text string, lang string, source string, n_chars long, kept string, n_words string, shard string"
WORDS = "the and of to in that was river stone Licence über naïve garçon 42 x1".split()
LONG_LINE = "This very line stands in a great many documents, word for word."


def awkward() -> list[tuple]:
    """Nulls in every column, empty and long texts, ties, repeated rows; extra columns whose names operators use."""
    rng = random.Random(7)
    texts: list[tuple[int | None, str | None]] = [(i, " ".join(rng.choices(WORDS, k=60 + i))) for i in range(12)]
    texts += [(i, f"{LONG_LINE}\nown line {i} of some length, so that it counts as one\n  {LONG_LINE.upper()} ") for i in range(20, 28)]
    texts += [(30, None), (31, ""), (32, " \n\t "), (33, "\n\n"), (None, "no id here"), (None, LONG_LINE), (None, None)]
    texts += [(40, "same  text\there"), (41, "same text here"), (41, "same text here"), (42, "same\ntext here"), (43, " same text here")]
    texts += [(50, "a" * 5_000), (51, "word " * 20_000), (52, "\n".join(["repeated line of words"] * 400)), (53, "déjà vu " * 100)]
    texts += [(60, "one"), (61, "One"), (62, "two words"), (63, "It's we'll they'RE 'tis ''s  x y　z\x1c1 ½")]
    rows = []
    for n, (doc_id, text) in enumerate(texts):
        lang = [None, "en", "de"][n % 3]
        source = [None, "src0", "src0", "src1"][n % 4]
        rows.append((doc_id, text, lang, source, None if n % 5 == 0 else len(text or ""), "x", None, "y"))
    return rows


def frame(spark, rows=None):
    return spark.createDataFrame(awkward() if rows is None else rows, DDL).repartition(3)


def split_words(text: str) -> list[str]:
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def lower(text: str) -> str:
    return re.sub("[A-Z]", lambda m: m[0].lower(), text)
