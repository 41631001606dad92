"""Licence notices in documents: a trained classifier of paragraphs, confirmed by templates.

1. Paragraphs are the lines of a text that hold a word; a notice may be wrapped over lines, so where a template's three words
   are found, lines that follow each other are also scored together. Features are word n-grams (one to three words, lower-cased,
   punctuation dropped): those of the templates, and those that several of the sample's notices have.
2. The classifier is a multinomial logistic regression with a class for each licence family, one for notices of unknown
   families and one for other text. It is trained on templates, whole, shortened, with changed words and framed in other words;
   on templates in which another name stands in place of the family's, which are of class unknown; and on a sample of
   paragraphs: those that hold a template's phrase are of its family, those that hold no n-gram of three words of any are of none.
3. A held-out part calibrates it: a temperature makes its probabilities match what is found there, and the smallest
   probability that keeps families apart from the rest becomes the threshold; another is set likewise on the probability of
   any notice. Families that are left out of training in turn, as licences nobody listed, tell how sure is sure.
4. A predicted family is confirmed if a large part of one of its templates' n-grams is in the paragraph; or, where the classifier
   is sure, if a smaller part of a template's words is there in their order, near each other (a local alignment). A paragraph
   that is a notice by its probability, but of no family that is confirmed, is of family unknown.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import astuple, dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lakepulse.llm.pretokens import slices
from lakepulse.llm.text import documents

#: How notices of licence families read.
TEMPLATES = {
    "Apache-2.0": [
        "Licensed under the Apache License, Version 2.0.",
        "You may not use this file except in compliance with the License.",
        "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "
        "AS IS BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.",
    ],
    "BSD": [
        "Redistribution and use in source and binary forms, with or without modification, are permitted.",
        "Released under the BSD License.",
        "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.",
    ],
    "CC-BY": ["Licensed under CC BY 4.0.", "This work is licensed under a Creative Commons Attribution License."],
    "CC-BY-NC": [
        "Licensed under CC BY-NC 4.0.",
        "This work is licensed under a Creative Commons Attribution-NonCommercial License.",
    ],
    "CC0": ["This work is dedicated to the public domain under CC0 1.0."],
    "GPL": [
        "This work is licensed under the GNU General Public License, version 3.",
        "This program is free software: you can redistribute it under the terms of the GNU General Public License.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License "
        "as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    ],
    "LGPL": ["This library is licensed under the GNU Lesser General Public License."],
    "MIT": [
        "Released under the MIT License.",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software.",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation "
        "files, to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, "
        "publish, distribute, sublicense, and/or sell copies of the Software.",
    ],
    "MPL-2.0": ["This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."],
    "proprietary": ["Copyright. All rights reserved.", "All rights reserved.", "Proprietary and confidential. Unauthorized copying is prohibited."],
}
#: The words of templates that name a family. With other names in their place, a notice is of an unknown one.
NAMES = {
    "Apache-2.0": ["apache"],
    "BSD": ["bsd"],
    "CC-BY": ["by", "attribution"],
    "CC-BY-NC": ["nc", "noncommercial"],
    "CC0": ["cc0"],
    "GPL": ["gnu", "general"],
    "LGPL": ["lesser"],
    "MIT": ["mit"],
    "MPL-2.0": ["mozilla"],
}
#: A word that no feature holds.
OTHER_NAME = "\0"
NONE = "none"
UNKNOWN = "unknown"
#: The sample: so many documents, and as many with a telling word; of each so many paragraphs of up to so many characters.
#: The driver trains on no more than these, whatever the table's size.
SAMPLE_DOCS = 1_000
SAMPLE_PARAGRAPHS = 4_000
SAMPLE_CHARS = 1_000
TELLING = r"(?i)licen[sc]e|copyright|permission|rights reserved|redistribut|public domain"
#: Part of a template's n-grams that a paragraph must have to confirm it.
CONFIRMED = 0.8
#: Of a template's words, the part that must be aligned to confirm a family of which the classifier is sure; what a
#: word costs that stands between or is missing; the least score, as two or three words are no notice; and the least
#: probability that is sure.
ALIGNED = 0.6
ALIGNED_WORDS = 5
GAP = 0.25
SURE = 0.9
SLICE_CHARS = 4_000_000

_WORD = r"[^\W_]+(?:\.\d+)*"


def words(paragraph: str) -> list[str]:
    return re.findall(_WORD, paragraph.lower())


def ngrams(tokens: list[str], most: int = 3) -> set[str]:
    return {" ".join(tokens[i : i + n]) for n in range(1, most + 1) for i in range(len(tokens) - n + 1)}


def similarity(found: set[str], template: set[str]) -> float:
    return len(found & template) / max(1, len(template))


def template_ngrams() -> dict[str, list[set[str]]]:
    return {family: [ngrams(words(t)) for t in texts] for family, texts in TEMPLATES.items()}


def aligned(tokens: list[str], template: list[str]) -> float:
    """The score of the best local alignment of a paragraph's words with the template's.

    A common word counts 1, and each word that is left out on either side takes ``GAP`` away, so words far apart don't add up.
    """
    places: dict[str, list[int]] = {}
    for j, w in enumerate(template):
        places.setdefault(w, []).append(j)
    row, best = [0.0] * len(template), 0.0
    for w in tokens:
        at = places.get(w, ())
        if not at and not any(row):
            continue
        now = [max(0.0, x - GAP) for x in row]
        for j in at:
            now[j] = max(now[j], 1.0 + (row[j - 1] if j else 0.0))
        for j in range(1, len(now)):
            now[j] = max(now[j], now[j - 1] - GAP)
        best, row = max(best, *now), now
    return best


@dataclass
class Model:
    classes: list[str]
    features: dict[str, int]
    weights: np.ndarray  # a row for each feature, the last one for the bias
    temperature: float
    threshold: float
    doubt: float = 0.5  # probability of any notice from which a paragraph without a sure family is unknown
    sure: float = 1.0  # probability from which an alignment confirms a family

    def probabilities(self, scores: np.ndarray) -> np.ndarray:
        z = scores / self.temperature
        e = np.exp(z - z.max(axis=1, keepdims=True))
        return e / e.sum(axis=1, keepdims=True)

    def scores(self, paragraphs: list[set[str]]) -> np.ndarray:
        """Sums of the weights of each paragraph's features."""
        out = np.tile(self.weights[-1], (len(paragraphs), 1))
        for i, found in enumerate(paragraphs):
            rows = [self.features[x] for x in found if x in self.features]
            if rows:
                out[i] += self.weights[rows].sum(axis=0)
        return out


def _matrix(rows: list[set[str]], features: dict[str, int]) -> np.ndarray:
    x = np.zeros((len(rows), len(features) + 1), np.float32)
    for i, found in enumerate(rows):
        x[i, [features[f] for f in found if f in features]] = 1
    x[:, -1] = 1
    return x


def _fit(x: np.ndarray, y: np.ndarray, n_classes: int, rounds: int = 300, rate: float = 0.5, ridge: float = 1e-4) -> np.ndarray:
    """Logistic regression by gradient descent; classes weigh the same in all."""
    share = 1.0 / np.bincount(y, minlength=n_classes)[y]
    share = (share / share.sum()).astype(np.float32)[:, None]
    target = np.eye(n_classes, dtype=np.float32)[y]
    weights = np.zeros((x.shape[1], n_classes), np.float32)
    speed = np.zeros_like(weights)
    for _ in range(rounds):
        z = x @ weights
        e = np.exp(z - z.max(axis=1, keepdims=True))
        gradient = x.T @ ((e / e.sum(axis=1, keepdims=True) - target) * share) + ridge * weights
        speed = 0.9 * speed - rate * gradient
        weights += speed
    return weights


def label(found: set[str], templates: dict[str, list[set[str]]]) -> str | None:
    """The family whose template the paragraph holds; none if it has no three words of any; None if in doubt."""
    near = {f: max(similarity(found, t) for t in ts) for f, ts in templates.items()}
    best = max(near, key=lambda f: (near[f], max(len(t) for t in templates[f])))
    if near[best] >= 0.95:
        return best
    three = {g for g in found if g.count(" ") == 2}
    return NONE if not any(three & t for ts in templates.values() for t in ts) else None


def variants(tokens: list[str]) -> list[list[str]]:
    """A notice as it is also written: whole, shortened at either end, and with single words missing or changed."""
    out = [tokens, tokens[:-1], tokens[1:]]
    if len(tokens) >= 8:
        third = len(tokens) // 4
        out += [tokens[third:], tokens[:-third]]
        for k in range(1, 4):
            i = k * len(tokens) // 4
            out += [[*tokens[:i], *tokens[i + 1 :]], [*tokens[:i], OTHER_NAME, *tokens[i + 1 :]]]
    return out


def made_rows(others: list[str]) -> list[tuple[set[str], str, str]]:
    """N-grams, class and the family they come from, of the templates' variants; ``others`` lend words to frame them.

    A variant that has lost a name of its family is of class unknown.
    """
    rows = []
    for family, texts in TEMPLATES.items():
        names = set(NAMES.get(family, ()))
        for k, text in enumerate(texts):
            tokens = words(text)
            named = names & set(tokens)
            frames = [words(others[(7 * k + 13 * i) % len(others)])[:6] if others else [] for i in range(4)]
            shapes = [*variants(tokens), [*frames[0], *tokens], [*tokens, *frames[1]], [*frames[2], *tokens, *frames[3]]]
            rows += [(ngrams(t), family if named <= set(t) else UNKNOWN, family) for t in shapes]
            for name in sorted(named):
                other = [OTHER_NAME if w == name else w for w in tokens]
                twice = [x for w in tokens for x in ([OTHER_NAME, OTHER_NAME] if w == name else [w])]
                rows += [(ngrams(t), UNKNOWN, family) for t in (other, twice, other[:-1], [*frames[0], *other], [*other, *frames[1]])]
    return rows


def _probabilities(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def _sure(made: list[tuple[set[str], str, str]], others: list[set[str]], features: dict[str, int], classes: list[str], temperature: float) -> float:
    """The probability that nine tenths of the notices of left-out families don't reach for any other family."""
    foreign = []
    plain = [(found, NONE, NONE) for found in others]
    for family in classes[:-2]:
        rows = [r for r in made if r[2] != family] + plain
        y = np.array([classes.index(c) for _, c, _ in rows])
        weights = _fit(_matrix([x for x, _, _ in rows], features), y, len(classes), rounds=150)
        left = _matrix([x for x, c, f in made if f == family and c == family], features)
        foreign += _probabilities(left @ weights / temperature)[:, :-2].max(axis=1).tolist()
    return float(np.quantile(foreign, 0.9)) if foreign else 1.0


def train(paragraphs: list[str]) -> Model:
    """From a sample of paragraphs and the templates; the order of the sample doesn't matter."""
    templates = template_ngrams()
    classes = [*sorted(TEMPLATES), UNKNOWN, NONE]
    plain = sorted(set(paragraphs))
    labelled = [(p, found, label(found, templates)) for p in plain for found in [ngrams(words(p))]]
    others = [p for p, _, family in labelled if family == NONE][: SAMPLE_PARAGRAPHS // 2]
    made = made_rows(others)
    rows = [*((found, c) for found, c, _ in made), (set(), NONE)]
    n_made = len(rows)
    rows += [(found, family) for _, found, family in labelled if family is not None]
    known = {f for ts in templates.values() for t in ts for f in t}
    repeated = Counter(f for found, family in rows[n_made:] if family != NONE for f in found)
    features = {f: i for i, f in enumerate(sorted(known | {f for f, n in repeated.items() if n >= 3}))}
    y = np.array([classes.index(family) for _, family in rows])
    keep = np.arange(len(rows)) % 4 != 3
    x = _matrix([found for found, _ in rows], features)
    weights = _fit(x[keep], y[keep], len(classes))
    held, truth = x[~keep] @ weights, y[~keep]

    def loss(t: float) -> float:
        z = held / t
        z = z - z.max(axis=1, keepdims=True)
        return float(-(z[np.arange(len(z)), truth] - np.log(np.exp(z).sum(axis=1))).mean()) if len(z) else 0.0

    temperature = float(min(np.geomspace(0.1, 10, 41), key=loss))
    model = Model(classes, features, weights, temperature, 0.5)
    p = model.probabilities(held)
    other = p[truth >= len(classes) - 2]
    model.threshold = float(min(0.95, max(0.5, 1.01 * other[:, :-2].max(initial=0.0))))
    plainly = 1 - p[truth == len(classes) - 1, -1]
    model.doubt = float(min(0.95, max(0.5, 1.01 * plainly.max(initial=0.0))))
    sure = _sure(made, [found for _, found, family in labelled if family == NONE][:300], features, classes, temperature)
    model.sure = min(0.999, max(SURE, model.threshold, sure))
    return model


def sample(docs: DataFrame, n_docs: int = SAMPLE_DOCS, n: int = SAMPLE_PARAGRAPHS) -> list[str]:
    """Paragraphs of ``n_docs`` documents and of as many with a telling word: those with the smallest hashes of their ids.

    Of each of the two, ``n`` distinct paragraphs with the smallest hashes come to the driver.
    """
    named = docs.where("doc_id IS NOT NULL")
    out: list[str] = []
    for part in (named, named.where(F.col("text").rlike(TELLING))):
        chosen = part.select("doc_id", F.xxhash64("doc_id").alias("place")).orderBy("place", "doc_id").limit(n_docs)
        texts = part.where(F.col("doc_id").isin([r["doc_id"] for r in chosen.collect()]))
        lines = texts.select(F.explode(F.split("text", "\n")).alias("p")).where("p RLIKE '\\\\w'")
        short = lines.select(F.substring("p", 1, SAMPLE_CHARS).alias("p")).distinct()
        out += [r["p"] for r in short.orderBy(F.xxhash64("p"), "p").limit(n).collect()]
    return out


class Scanner:
    """All paragraphs of many texts at once: words become numbers, and n-grams of known words are looked up sorted."""

    def __init__(self, model: Model, confirmed: float = CONFIRMED) -> None:
        self.model, self.templates, self.confirmed = model, template_ngrams(), confirmed
        self.plain = {family: [words(t) for t in texts] for family, texts in TEMPLATES.items()}
        self.longest = max(len(words(t)) for ts in TEMPLATES.values() for t in ts)
        three = {g for ts in self.templates.values() for t in ts for g in t if g.count(" ") == 2}
        self.three = np.array([f in three for f in sorted(model.features, key=model.features.get)], bool)
        known = sorted({w for f in model.features for w in f.split(" ")})
        self.numbers = {w: i + 1 for i, w in enumerate(known)}
        base = len(known) + 1
        if base**3 >= 2**63:
            raise ValueError("too many words in the features")
        self.base = base
        codes = []
        for f, row in model.features.items():
            code = 0
            for w in f.split(" "):
                code = code * base + self.numbers[w]
            codes.append((code, row))
        codes.sort()
        self.codes = np.array([c for c, _ in codes], np.int64)
        self.rows = np.array([r for _, r in codes], np.int64)

    def _hits(self, numbers: np.ndarray, paragraph: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Distinct pairs of paragraph and feature row."""
        pairs = []
        for n in (1, 2, 3):
            if len(numbers) < n:
                break
            m = len(numbers) - n + 1
            code, ok = np.zeros(m, np.int64), np.ones(m, bool)
            for j in range(n):
                part = numbers[j : j + m]
                code = code * self.base + part
                ok &= (part > 0) & (paragraph[j : j + m] == paragraph[:m])
            at, code = np.flatnonzero(ok), code[ok]
            place = np.minimum(np.searchsorted(self.codes, code), len(self.codes) - 1)
            hit = self.codes[place] == code
            pairs.append(np.unique(paragraph[at[hit]] * (len(self.rows) + 1) + self.rows[place[hit]]))
        both = np.concatenate(pairs) if pairs else np.zeros(0, np.int64)
        return both // (len(self.rows) + 1), both % (len(self.rows) + 1)

    def _judged(self, tokens: list[str], p: np.ndarray) -> tuple[str, float, float] | None:
        """Family, probability and similarity; ``p`` has the classes' probabilities. None if it is no notice."""
        best = int(p[:-2].argmax())
        family, grams = self.model.classes[best], ngrams(tokens)
        near = max(similarity(grams, t) for t in self.templates[family])
        if p[best] >= self.model.threshold and near >= self.confirmed:
            return family, float(p[best]), near
        if p[best] >= self.model.sure and any(aligned(tokens, t) >= max(ALIGNED * len(t), ALIGNED_WORDS) for t in self.plain[family]):
            return family, float(p[best]), near
        if p[best] >= self.model.threshold or 1 - p[-1] >= self.model.doubt:
            return UNKNOWN, float(1 - p[-1]), near
        return None

    @staticmethod
    def _stands(notice: tuple[str, float, float] | None, family: str, near: float) -> bool:
        """Whether a line's own notice is kept before one over several lines: if it has another family or is nearer."""
        return notice is not None and notice[0] != UNKNOWN and (notice[0] != family or notice[2] >= near)

    def _nearest(self, tokens: list[list[str]]) -> float:
        grams = ngrams([w for t in tokens for w in t])
        return max(similarity(grams, t) for ts in self.templates.values() for t in ts)

    def _wrapped(self, tokens: list[list[str]], block: np.ndarray, paragraph: np.ndarray, numbers: np.ndarray) -> Iterator[tuple[int, int, str, float, float]]:
        """Notices over several lines: first and last line, family, probability, similarity.

        Around each break that a template's three words cross or stand next to, lines are taken together as far as the
        longest template reaches, and cut to those that the nearest template needs.
        """
        if not len(numbers) or not len(self.codes):
            return
        # Three words of a template, in one line or over breaks within a block.
        m = len(numbers) - 2
        if m < 1:
            return
        code = (numbers[:m] * self.base + numbers[1 : m + 1]) * self.base + numbers[2:]
        ok = (numbers[:m] > 0) & (numbers[1 : m + 1] > 0) & (numbers[2:] > 0) & (block[paragraph[:m]] == block[paragraph[2:]])
        at = np.flatnonzero(ok)
        place = np.minimum(np.searchsorted(self.codes, code[at]), len(self.codes) - 1)
        at = at[(self.codes[place] == code[at]) & self.three[self.rows[place]]]
        seen, windows = set(), []
        for s, e in sorted(set(zip(paragraph[at].tolist(), paragraph[at + 2].tolist(), strict=True))):
            first, left = s, self.longest
            while left > 0:
                if first not in seen:
                    seen.add(first)
                    last, room = first, self.longest - 1
                    while room > 0 and last + 1 < len(tokens) and block[last + 1] == block[first]:
                        last += 1
                        room -= len(tokens[last])
                    if last > first:
                        windows.append((first, last, e))
                if first == 0 or block[first - 1] != block[s]:
                    break
                first -= 1
                left -= len(tokens[first + 1]) if first + 1 < s else 0
                if s - first >= self.longest:
                    break
        for first, last, _ in sorted(windows):
            near = self._nearest(tokens[first : last + 1])
            if near >= self.confirmed:
                while last > first and self._nearest(tokens[first:last]) >= near:
                    last -= 1
                while last > first and self._nearest(tokens[first + 1 : last + 1]) >= near:
                    first += 1
            elif last > first:
                last = first + 1
            if last == first:
                continue
            joined = [w for t in tokens[first : last + 1] for w in t]
            judged = self._judged(joined, self.model.probabilities(self.model.scores([ngrams(joined)]).astype(np.float64))[0])
            if judged:
                yield first, last, *judged

    def scan(self, texts: list[str]) -> list[tuple[int, list[tuple[int, str, float, float]]]]:
        """For each text the number of paragraphs, and for each notice its line, family, probability, similarity."""
        lines = [(i, k, line) for i, text in enumerate(texts) for k, line in enumerate(text.split("\n")) if line.strip()]
        tokens = [words(line) for _, _, line in lines]
        lines, tokens = [x for x, t in zip(lines, tokens, strict=True) if t], [t for t in tokens if t]
        counts = [0] * len(texts)
        for i, _, _ in lines:
            counts[i] += 1
        get = self.numbers.get
        numbers = np.array([get(w, 0) for t in tokens for w in t], np.int64)
        paragraph = np.repeat(np.arange(len(tokens)), [len(t) for t in tokens])
        which, rows = self._hits(numbers, paragraph) if len(numbers) and len(self.codes) else (np.zeros(0, np.int64),) * 2
        touched, place = np.unique(which, return_inverse=True)
        scores = np.tile(self.model.weights[-1].astype(np.float64), (len(touched), 1))
        np.add.at(scores, place, self.model.weights[rows])
        notices: dict[int, tuple[str, float, float]] = {}
        if len(touched):
            p = self.model.probabilities(scores)
            for j in np.flatnonzero((p[:, :-2].max(axis=1) >= self.model.threshold) | (1 - p[:, -1] >= self.model.doubt)):
                judged = self._judged(tokens[touched[j]], p[j])
                if judged:
                    notices[int(touched[j])] = judged
        # Lines with a word that follow each other are a block.
        new = [j == 0 or lines[j - 1][0] != i or lines[j - 1][1] != k - 1 for j, (i, k, _) in enumerate(lines)]
        joined = sorted(self._wrapped(tokens, np.cumsum(new), paragraph, numbers), key=lambda x: (x[2] == UNKNOWN, -x[4], x[0]))
        taken: set[int] = set()
        for first, last, family, probability, near in joined:
            inside = range(first, last + 1)
            if family == UNKNOWN:
                if any(j in notices or j in taken for j in inside):
                    continue
            elif any(j in taken or self._stands(notices.get(j), family, near) for j in inside):
                continue
            for j in inside:
                notices.pop(j, None)
            taken.update(inside)
            notices[first] = (family, probability, near)
        found: list[list[tuple[int, str, float, float]]] = [[] for _ in texts]
        for j in sorted(notices):
            found[lines[j][0]].append((lines[j][1], *notices[j]))
        return list(zip(counts, found, strict=True))


def scan_licenses(docs: DataFrame, model: Model, confirmed: float = CONFIRMED) -> DataFrame:
    """``doc_id, n_paragraphs, notices``: a row for each row of ``docs``, whole texts.

    ``notices`` are structs of ``line`` (from 0), ``family``, ``probability``, ``similarity`` (to the family's nearest
    template) and ``confirmed``; a notice over several lines has its first. Family ``unknown`` (never confirmed; its probability
    is that of any notice) is for notices whose family is under the threshold or not confirmed. Paragraphs of class none
    aren't listed. Null and empty texts have
    no paragraphs. Repeated rows give repeated rows; other columns are left out. An empty table gives an empty table.
    """
    shared = docs.sparkSession.sparkContext.broadcast(astuple(model))  # sized by the templates and the sample
    notice = "struct<line: int, family: string, probability: double, similarity: double, confirmed: boolean>"
    arrow = pa.list_(
        pa.struct([("line", pa.int32()), ("family", pa.string()), ("probability", pa.float64()), ("similarity", pa.float64()), ("confirmed", pa.bool_())])
    )

    def scanned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(Model(*shared.value), confirmed)
        for whole in batches:
            given = [x or "" for x in whole.column("text").to_pylist()]
            for i, j in slices([len(x) + 1 for x in given], SLICE_CHARS):
                found = scanner.scan(given[i:j])
                notices = [
                    [
                        {"line": k, "family": f, "probability": p, "similarity": s, "confirmed": f != UNKNOWN}
                        for k, f, p, s in rows
                    ]
                    for _, rows in found
                ]
                columns = [whole.column("doc_id").slice(i, j - i), pa.array([n for n, _ in found], pa.int64()), pa.array(notices, arrow)]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_paragraphs", "notices"])

    texts = docs.select(F.col("doc_id").cast("long"), "text")
    return texts.mapInArrow(scanned, f"doc_id long, n_paragraphs long, notices array<{notice}>")


def op3_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "text")
    found = scan_licenses(docs, train(sample(docs)))
    sure = F.filter("notices", lambda x: x["confirmed"])
    return found.select(
        "doc_id",
        "n_paragraphs",
        F.size("notices").cast("long").alias("n_notices"),
        F.size(sure).cast("long").alias("n_confirmed"),
        F.size(F.filter("notices", lambda x: x["family"] == UNKNOWN)).cast("long").alias("n_unknown"),
        F.array_join(F.array_sort(F.array_distinct(F.transform(sure, lambda x: x["family"]))), ",").alias("families"),
        F.coalesce(F.array_max(F.transform(sure, lambda x: x["probability"])), F.lit(0.0)).alias("probability"),
    )
