r"""Personal data: e-mail addresses, IP addresses, card and phone numbers, by patterns and by a trained character model.

The base rules find plain forms. A bidirectional LSTM over characters with a CRF on top adds written variants of the same four
kinds (``name (at) host [dot] org``, ``(020) 555-0199``, ``10[.]0[.]0[.]1``). It is trained in numpy from labelled spans: the
base rules' spans in a bounded sample of texts, and variants and look-alikes (dates, versions, digests) written into the
sample's windows, whose spans are known.

Every kind holds a digit, an at sign or such a word in brackets. So the model reads the stretches of text around each of these
that no base span covers, in overlapping windows of ``WINDOW`` characters. Each window is decoded by itself; then a text's
spans are reconciled: pieces of one span that windows cut are united, and of spans that overlap the set with the
greatest sum of confidence and length stays. Base spans always stay, and no added span overlaps one.
"""

from __future__ import annotations

import random
import re
from bisect import bisect_right
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lakepulse.llm.pretokens import slices
from lakepulse.llm.text import documents, hex_digest, raw_texts

KINDS = ("email", "ip", "card", "phone")
#: Characters of a window, its step, and those read before and behind a telling character.
WINDOW, STEP, CONTEXT = 64, 32, 20
#: The bounded sample that the model is fitted on: documents (those with the smallest hashes of their ids), and windows of them.
SAMPLE_DOCS = 1500
SAMPLE_WINDOWS = 1200
#: Windows with a variant or look-alike for each sampled one, at least ``LEAST_MADE``.
MADE_PER_WINDOW = 1
LEAST_MADE = 1200
HIDDEN = 16
EPOCHS = 30
BATCH = 96
SEED = 42
#: Windows decoded at a time, and bytes of texts handled at a time; they bound memory.
DECODED = 4096
SLICE_BYTES = 4_000_000

Span = tuple[int, int, int]  # number of the kind, start, end

_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
_NUMBERS = re.compile(r"[0-9]++(?:\.[0-9]++)*+")
_DIGITS = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_TELLING = re.compile(r"[0-9@]|[\[({<] ?(?i:at|dot) ?[\])}>]")
_AT = re.compile(r"@|[\[({<] ?(?i:at) ?[\])}>]")
_DOT = re.compile(r"\.|[\[({<] ?(?i:dot) ?[\])}>]")
_LOCAL_SET = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")


def luhn(digits: str) -> bool:
    doubled = [int(d) * (1 + i % 2) for i, d in enumerate(reversed(digits))]
    return sum(d - 9 * (d > 9) for d in doubled) % 10 == 0


def _small(number: str) -> bool:
    return len(number.lstrip("0")) <= 3 and int(number[-4:]) <= 255


def base_spans(text: str) -> list[Span]:
    """The base rules' spans, by kind and start; each rule takes time in proportion to the text."""
    found: list[Span] = []
    low = 0
    at = text.find("@")
    while at >= 0:  # each address has one at sign, and as much before it as may stand there
        start = at
        while start > low and text[start - 1] in _LOCAL_SET:
            start -= 1
        host = _DOMAIN.match(text, at + 1) if start < at else None
        low = host.end() if host else at + 1
        if host:
            found.append((0, start, low))
        at = text.find("@", low)
    for m in _NUMBERS.finditer(text):
        if m[0].count(".") >= 3:
            numbers = [(n.start() + m.start(), n.end() + m.start(), n[0]) for n in re.finditer("[0-9]+", m[0])]
            for four in (numbers[i : i + 4] for i in range(0, len(numbers) - 3, 4)):
                if all(_small(n) for *_, n in four):
                    found.append((1, four[0][0], four[3][1]))
    for m in _DIGITS.finditer(text):
        if m.end() - m.start() >= 16:
            digits = re.sub("[^0-9]", "", m[0])
            if 16 <= len(digits) <= 19 and luhn(digits):
                found.append((2, m.start(), m.end()))
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 8 <= len(re.sub("[^0-9]", "", m[0])) <= 15:
                found.append((3, m.start(), m.end()))
    return found


def listed(spans: list[Span]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for k, a, b in sorted(spans))


def merged(spans: list[Span]) -> list[list[int]]:
    """The stretches that spans cover, in order."""
    out: list[list[int]] = []
    for _, a, b in sorted(spans, key=lambda s: s[1]):
        if out and a <= out[-1][1]:
            out[-1][1] = max(b, out[-1][1])
        else:
            out.append([a, b])
    return out


def windows(text: str, covered: list[Span]) -> list[tuple[int, int, int, int]]:
    """Overlapping windows over the stretches around telling characters outside of the spans: start, end, and the stretch's."""
    fixed = merged(covered)
    starts = [a for a, _ in fixed]
    stretches: list[list[int]] = []
    for m in _TELLING.finditer(text):
        i = bisect_right(starts, m.start()) - 1
        if i >= 0 and m.start() < fixed[i][1]:
            continue
        a, b = max(0, m.start() - CONTEXT), min(len(text), m.end() + CONTEXT)
        if stretches and a <= stretches[-1][1]:
            stretches[-1][1] = b
        else:
            stretches.append([a, b])
    out = []
    for a, b in stretches:
        start = a
        while True:
            out.append((start, min(start + WINDOW, b), a, b))
            if start + WINDOW >= b:
                break
            start += STEP
    return out


# Characters: printable ASCII (all digits as one), everything else below 128, everything above, and padding.
_OTHER, _FOREIGN, PAD = 95, 96, 97
_CLASS = np.full(129, _OTHER, np.uint8)
_CLASS[32:127] = np.arange(95)
_CLASS[48:58] = 16
_CLASS[128] = _FOREIGN
N_TAGS = 1 + 2 * len(KINDS)  # none; first character and others of each kind


def encoded(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Windows as rows of character numbers, and their lengths."""
    sizes = np.array([len(t) for t in texts], np.int64)
    points = np.frombuffer("".join(texts).encode("utf-32-le", "replace"), "<u4")
    out = np.full((len(texts), int(sizes.max(initial=0))), PAD, np.uint8)
    out[np.arange(out.shape[1]) < sizes[:, None]] = _CLASS[np.minimum(points, 128)]
    return out, sizes


def tags_of(size: int, spans: list[Span]) -> np.ndarray:
    out = np.zeros(size, np.int64)
    for kind, a, b in spans:
        out[a] = 1 + 2 * kind
        out[a + 1 : b] = 2 + 2 * kind
    return out


def _allowed() -> np.ndarray:
    """Whether a tag may follow another: the inside of a kind only its first character or its inside."""
    out = np.ones((N_TAGS, N_TAGS), bool)
    for kind in range(len(KINDS)):
        inside = 2 + 2 * kind
        out[:, inside] = False
        out[[inside - 1, inside], inside] = True
    return out


_FORBIDDEN = np.where(_allowed(), 0.0, -1e4).astype(np.float32)
_START = np.array([-1e4 if t and t % 2 == 0 else 0.0 for t in range(N_TAGS)], np.float32)


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * (1 + np.tanh(0.5 * x))


def _lstm(pre: np.ndarray, recurrent: np.ndarray, mask: np.ndarray, kept: list | None = None) -> np.ndarray:
    """States of one direction, (time, rows, hidden); ``kept`` takes what the gradient needs."""
    steps, rows, width = pre.shape
    n = width // 4
    h = c = np.zeros((rows, n), np.float32)
    out = np.empty((steps, rows, n), np.float32)
    for t in range(steps):
        z = pre[t] + h @ recurrent
        gates, g = _sigmoid(z[:, : 3 * n]), np.tanh(z[:, 3 * n :])
        i, f, o = gates[:, :n], gates[:, n : 2 * n], gates[:, 2 * n :]
        m = mask[t][:, None]
        before = c
        c = (f * c + i * g) * m
        tc = np.tanh(c)
        if kept is not None:
            kept.append((i, f, o, g, before, tc, h, m))
        h = o * tc * m
        out[t] = h
    return out


def _lstm_gradient(d_out: np.ndarray, recurrent: np.ndarray, kept: list) -> tuple[np.ndarray, np.ndarray]:
    steps, rows, n = d_out.shape
    d_pre = np.empty((steps, rows, 4 * n), np.float32)
    d_recurrent = np.zeros_like(recurrent)
    dh = dc = np.zeros((rows, n), np.float32)
    for t in range(steps - 1, -1, -1):
        i, f, o, g, before, tc, h, m = kept[t]
        dh = (dh + d_out[t]) * m
        dc = (dc + dh * o * (1 - tc * tc)) * m
        dz = np.concatenate([dc * g * i * (1 - i), dc * before * f * (1 - f), dh * tc * o * (1 - o), dc * i * (1 - g * g)], axis=1)
        d_pre[t] = dz
        d_recurrent += h.T @ dz
        dh, dc = dz @ recurrent.T, dc * f
    return d_pre, d_recurrent


def _log_sum(x: np.ndarray, axis: int) -> np.ndarray:
    most = x.max(axis=axis, keepdims=True)
    return np.log(np.exp(x - most).sum(axis=axis)) + most.squeeze(axis)


def _forward(emission: np.ndarray, moves: np.ndarray, mask: np.ndarray) -> np.ndarray:
    out = np.empty_like(emission)
    out[0] = emission[0] + _START
    for t in range(1, len(emission)):
        now = _log_sum(out[t - 1][:, :, None] + moves, 1) + emission[t]
        out[t] = np.where(mask[t][:, None] > 0, now, out[t - 1])
    return out


def _backward(emission: np.ndarray, moves: np.ndarray, mask: np.ndarray) -> np.ndarray:
    out = np.zeros_like(emission)
    for t in range(len(emission) - 2, -1, -1):
        now = _log_sum(moves + (emission[t + 1] + out[t + 1])[:, None, :], 2)
        out[t] = np.where(mask[t + 1][:, None] > 0, now, 0.0)
    return out


@dataclass
class Model:
    """``weights``: of each direction a table of characters and the recurrence; the tags' weights, and the CRF's moves."""

    weights: dict[str, np.ndarray]
    threshold: float = 0.5

    @classmethod
    def new(cls, seed: int) -> Model:
        rng = np.random.default_rng(seed)
        some = lambda scale, *shape: (scale * rng.standard_normal(shape)).astype(np.float32)
        weights = {"out": some(0.2, 2 * HIDDEN, N_TAGS), "bias": np.zeros(N_TAGS, np.float32), "moves": some(0.01, N_TAGS, N_TAGS)}
        for way in ("on", "back"):
            weights[f"{way}_table"] = some(0.3, PAD + 1, 4 * HIDDEN)
            weights[f"{way}_table"][:, HIDDEN : 2 * HIDDEN] += 1  # remember at first
            weights[f"{way}_state"] = some(0.2, HIDDEN, 4 * HIDDEN)
        return cls(weights)

    def states(self, chars: np.ndarray, mask: np.ndarray, kept: dict | None = None) -> np.ndarray:
        """Both directions' states, (time, rows, 2 hidden), of ``chars`` (time, rows)."""
        w, out = self.weights, []
        for way, turn in (("on", slice(None)), ("back", slice(None, None, -1))):
            own = None if kept is None else kept.setdefault(way, [])
            out.append(_lstm(w[f"{way}_table"][chars[turn]], w[f"{way}_state"], mask[turn], own)[turn])
        return np.concatenate(out, axis=2)

    def emission(self, states: np.ndarray) -> np.ndarray:
        return states @ self.weights["out"] + self.weights["bias"]

    @property
    def moves(self) -> np.ndarray:
        return self.weights["moves"] + _FORBIDDEN

    def loss(self, chars: np.ndarray, mask: np.ndarray, tags: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
        """The mean negative log-likelihood of the tags (time, rows), and its gradient."""
        w, kept = self.weights, {}
        states = self.states(chars, mask, kept)
        emission, moves = self.emission(states), self.moves
        ahead, behind = _forward(emission, moves, mask), _backward(emission, moves, mask)
        whole = _log_sum(ahead[-1], 1)
        steps, rows = chars.shape
        right = np.eye(N_TAGS, dtype=np.float32)[tags] * mask[:, :, None]
        score = (emission * right).sum() + (_START * right[0]).sum()
        d_emission = np.exp(ahead + behind - whole[:, None]) * mask[:, :, None] - right
        d_moves = np.zeros_like(moves)
        for t in range(1, steps):
            m = mask[t][:, None, None]
            pair = ahead[t - 1][:, :, None] + moves + (emission[t] + behind[t])[:, None, :] - whole[:, None, None]
            d_moves += (np.exp(np.minimum(pair, 0)) * m).sum(axis=0)
            seen = right[t - 1].T @ right[t]
            d_moves -= seen
            score += (seen * moves).sum()
        d_emission /= rows
        d_states = d_emission @ w["out"].T
        out = {"out": np.einsum("trh,trk->hk", states, d_emission), "bias": d_emission.sum(axis=(0, 1)), "moves": d_moves / rows}
        for way, turn, part in (("on", slice(None), slice(0, HIDDEN)), ("back", slice(None, None, -1), slice(HIDDEN, None))):
            d_pre, out[f"{way}_state"] = _lstm_gradient(d_states[turn][:, :, part], w[f"{way}_state"], kept[way])
            table = np.zeros_like(w[f"{way}_table"])
            np.add.at(table, chars[turn].ravel(), d_pre.reshape(-1, 4 * HIDDEN))
            out[f"{way}_table"] = table
        return float((whole.sum() - score) / rows), out

    def decode(self, texts: list[str]) -> list[list[tuple[Span, float]]]:
        """For each window its spans with their confidence, the least posterior of their characters' tags."""
        out: list[list[tuple[Span, float]]] = [[] for _ in texts]
        order = sorted(range(len(texts)), key=lambda i: len(texts[i]))
        for i in range(0, len(order), DECODED):
            part = order[i : i + DECODED]
            for k, spans in zip(part, self._decode([texts[k] for k in part]), strict=True):
                out[k] = spans
        return out

    def _decode(self, texts: list[str]) -> list[list[tuple[Span, float]]]:
        chars, sizes = encoded(texts)
        mask = (np.arange(chars.shape[1]) < sizes[:, None]).T.astype(np.float32)
        emission = self.emission(self.states(np.ascontiguousarray(chars.T), mask))
        tags = self._best(emission, mask)
        out: list[list[tuple[Span, float]]] = [[] for _ in texts]
        rows = np.flatnonzero(((tags > 0) & (mask > 0)).any(axis=0))
        if not len(rows):
            return out
        emission, mask = emission[:, rows], mask[:, rows]
        ahead, behind = _forward(emission, self.moves, mask), _backward(emission, self.moves, mask)
        posterior = np.exp(ahead + behind - _log_sum(ahead[-1], 1)[:, None])
        for n, row in enumerate(rows.tolist()):
            own = tags[: sizes[row], row]
            sure = posterior[np.arange(len(own)), n, own]
            for a in np.flatnonzero(own % 2 == 1).tolist():
                b = a + 1
                while b < len(own) and own[b] == own[a] + 1:
                    b += 1
                out[row].append((((int(own[a]) - 1) // 2, a, b), float(sure[a:b].min())))
        return out

    def _best(self, emission: np.ndarray, mask: np.ndarray) -> np.ndarray:
        """The most likely tags (time, rows)."""
        steps, rows, _ = emission.shape
        score, came = emission[0] + _START, np.zeros(emission.shape, np.uint8)
        still = np.arange(N_TAGS)
        for t in range(1, steps):
            through = score[:, :, None] + self.moves
            came[t] = through.argmax(axis=1)
            now = np.take_along_axis(through, came[t][:, None, :].astype(np.int64), 1)[:, 0] + emission[t]
            on = mask[t][:, None] > 0
            score = np.where(on, now, score)
            came[t] = np.where(on, came[t], still)
        out = np.empty((steps, rows), np.int64)
        out[-1] = score.argmax(axis=1)
        for t in range(steps - 1, 0, -1):
            out[t - 1] = came[t][np.arange(rows), out[t]]
        return out


def fit(examples: list[tuple[str, list[Span]]], epochs: int = EPOCHS, seed: int = SEED) -> Model:
    """By Adam over windows with their labelled spans; the order of the examples counts."""
    model, rng = Model.new(seed), np.random.default_rng(seed)
    chars, sizes = encoded([t for t, _ in examples])
    tags = np.zeros(chars.shape, np.int64)
    for row, (text, spans) in zip(tags, examples, strict=True):
        row[: len(text)] = tags_of(len(text), spans)
    mean, spread = ({k: np.zeros_like(v) for k, v in model.weights.items()} for _ in range(2))
    step, steps = 0, epochs * -(-len(examples) // BATCH)
    for _ in range(epochs):
        order = rng.permutation(len(examples))
        for i in range(0, len(order), BATCH):
            part = order[i : i + BATCH]
            longest = int(sizes[part].max())
            mask = (np.arange(longest) < sizes[part][:, None]).T.astype(np.float32)
            _, gradient = model.loss(chars[part, :longest].T, mask, tags[part, :longest].T)
            norm = np.sqrt(sum(float((g * g).sum()) for g in gradient.values()))
            step += 1
            rate = 0.02 * (1 - 0.9 * step / steps)
            for name, g in gradient.items():
                g = g * min(1.0, 5.0 / max(norm, 1e-9))
                mean[name] = 0.9 * mean[name] + 0.1 * g
                spread[name] = 0.99 * spread[name] + 0.01 * g * g
                model.weights[name] -= rate * (mean[name] / (1 - 0.9**step)) / (np.sqrt(spread[name] / (1 - 0.99**step)) + 1e-8)
    return model


def _variant(kind: int, rng: random.Random) -> str:
    """A written form of a kind that the base rules don't find, or don't always."""
    word = lambda: "".join(rng.choices("abcdefghijklmnoprstuvw", k=rng.randint(2, 9)))
    digits = lambda n: "".join(rng.choices("0123456789", k=n))
    if kind == 0:
        name = word() + rng.choice(["", f".{word()}", f"_{word()}", digits(2), f".{digits(2)}"])
        end = rng.choice(["com", "org", "net", "de", "fr"])
        left, right = rng.choice(["()", "[]", "{}", "<>"])
        at, dot = (f"{left}{w}{right}" for w in rng.choice([("at", "dot"), ("AT", "DOT")]))
        return rng.choice([f"{name} {at} {word()} {dot} {end}", f"{name}{at}{word()}{dot}{end}", f"{name} {at} {word()}.{end}", f"{name} @ {word()}.{end}"])
    if kind == 1:
        parts = [str(rng.randint(0, 255)) for _ in range(4)]
        return rng.choice(["[.]", "(.)", " . ", "[dot]"]).join(parts)
    if kind == 2:
        number = rng.choice("3456") + digits(14)
        number += next(d for d in "0123456789" if luhn(number + d))
        return rng.choice([".", "/", " - ", "_", "  "]).join(number[i : i + 4] for i in range(0, 16, 4))
    a, b, c = digits(3), digits(3), digits(4)
    return rng.choice([f"({a}) {b}-{c}", f"({a}) {b} {c}", f"{a}-{b}-{c}", f"{a}.{b}.{c}", f"00 {rng.randint(1, 99)} {a} {b} {c}", f"+{rng.randint(1, 9)}/{a}/{b}/{c}"])


def _look_alike(rng: random.Random) -> str:
    """Numbers and signs that are none of the kinds."""
    n = rng.randint
    hexes = "".join(rng.choices("0123456789abcdef", k=rng.choice([8, 16, 32, 40])))
    return rng.choice(
        [f"{n(1900, 2099)}-{n(1, 12):02}-{n(1, 28):02}", f"{n(1, 28)}.{n(1, 12)}.{n(1900, 2099)}", f"{n(0, 23)}:{n(0, 59):02}:{n(0, 59):02}",
         f"v{n(0, 9)}.{n(0, 20)}.{n(0, 50)}", f"{n(1, 999)},{n(0, 999):03}.{n(0, 99):02}", hexes, str(n(0, 10**n(1, 12))), f"{n(1, 99)}%",
         f"{n(100, 999)}-{n(10, 99)}", f"@{rng.choice(['home', 'note', 'user'])}", f"[{n(1, 99)}]", f"({n(1900, 2099)})", f"{n(1, 99)} x {n(1, 99)}",
         "[at]", "(dot)", f"{n(1, 99)}/{n(1, 99)}", f"#{n(1, 99999)}"]
    )


def made(contexts: list[str], count: int, seed: int = SEED) -> list[tuple[str, list[Span]]]:
    """Windows with a variant, or (two in five) a look-alike, between the words of a context."""
    rng = random.Random(seed)
    out = []
    for i in range(count):
        around = re.sub(r"[0-9@]", "", rng.choice(contexts) if contexts else "")
        words = around.split(" ")
        cut = rng.randint(0, len(words))
        kind = None if i % 5 in (1, 3) else rng.randrange(4)
        text = _look_alike(rng) if kind is None else _variant(kind, rng)
        before, after = " ".join(words[:cut])[-CONTEXT:], " ".join(words[cut:])[:CONTEXT]
        before = before + rng.choice([" ", " ", ": ", "\n"]) if before else ""
        after = rng.choice([" ", " ", ", ", ". ", "\n"]) + after if after else ""
        start = len(before)
        whole = (before + text + after)[: WINDOW + CONTEXT]
        out.append((whole, [] if kind is None or start + len(text) > len(whole) else [(kind, start, start + len(text))]))
    return out


def labelled(texts: list[str]) -> list[tuple[str, list[Span]]]:
    """Windows of texts around all telling characters, with the base rules' spans that lie in them whole."""
    out = []
    for text in texts:
        spans = base_spans(text)
        for a, b, *_ in windows(text, []):
            cut = [s for s in spans if s[1] < b and s[2] > a and (s[1] < a or s[2] > b)]
            inside = [(k, s - a, e - a) for k, s, e in spans if a <= s and e <= b]
            if not cut and all(x[2] <= y[1] or y[2] <= x[1] for i, x in enumerate(inside) for y in inside[:i]):
                out.append((text[a:b], inside))
    return out


def train(texts: list[str], epochs: int = EPOCHS) -> Model | None:
    """From a sample of texts; None without any. The threshold lies above what a fourth held out gives false spans."""
    if not texts:
        return None
    rng = random.Random(SEED)
    own = sorted({(t, tuple(s)) for t, s in labelled(sorted(texts))})
    rng.shuffle(own)
    own = [(t, list(s)) for t, s in own[:SAMPLE_WINDOWS]]
    examples = own + made([t for t, _ in own], max(LEAST_MADE, MADE_PER_WINDOW * len(own)))
    rng.shuffle(examples)
    held, rest = examples[::4], [x for i, x in enumerate(examples) if i % 4]
    model = fit(rest, epochs)
    wrong = [
        sure
        for (text, spans), found in zip(held, model.decode([t for t, _ in held]), strict=True)
        for span, sure in found
        if span not in spans and plausible(span[0], text[span[1] : span[2]]) and not any(span[1] < e and s < span[2] for _, s, e in spans)
    ]
    # The worst few in a thousand windows may be above, lest one odd example rule out all.
    wrong = sorted(wrong)[: max(0, len(wrong) - len(held) // 500)]
    model.threshold = float(min(0.95, max(0.6, 1.02 * max(wrong, default=0.0))))
    return model


def plausible(kind: int, text: str) -> bool:
    """Whether a text can be of the kind at all: what the reconciliation asks of an added span."""
    if text != text.strip():
        return False
    digits = re.sub("[^0-9]", "", text)
    if kind == 0:
        at = list(_AT.finditer(text))
        return len(at) == 1 and at[0].start() > 0 and bool(_DOT.search(text, at[0].end())) and len(text) <= 254
    if kind == 1:
        numbers = re.findall("[0-9]+", text)
        return len(numbers) == 4 and all(_small(n) for n in numbers) and not re.search("[A-Za-z]{4}", text)
    if kind == 2:
        return 16 <= len(digits) <= 19 and luhn(digits) and not re.search("[A-Za-z]", text)
    groups = re.findall("[0-9]+", text)
    return 8 <= len(digits) <= 15 and len(groups) >= 3 and max(map(len, groups)) <= 5 and not re.search("[A-Za-z]", text)


def reconciled(text: str, base: list[Span], found: list[tuple[Span, float, bool, bool]], threshold: float) -> list[Span]:
    """All spans of a text, from its windows' spans: each with its confidence, and whether its window cuts it left or right."""
    whole: list[tuple[Span, float]] = []
    for kind in range(len(KINDS)):
        now: list | None = None
        for (_, a, b), sure, left, right in sorted(x for x in found if x[0][0] == kind):
            if now is not None and a < now[1] and (left or now[4]):
                if b >= now[1]:
                    now[1], now[4] = b, right
                now[2] = max(now[2], sure) if not left else min(now[2], sure)
                continue
            if now is not None:
                whole.append(((kind, now[0], now[1]), now[2]))
            now = [a, b, sure, left, right]
        if now is not None:
            whole.append(((kind, now[0], now[1]), now[2]))
    best: dict[Span, float] = {}
    fixed = merged(base)
    starts = [a for a, _ in fixed]
    for span, sure in whole:
        k, a, b = span
        last = bisect_right(starts, b - 1) - 1
        if sure >= threshold and plausible(k, text[a:b]) and (last < 0 or fixed[last][1] <= a):
            best[span] = max(sure, best.get(span, 0.0))
    return base + chosen(best)


def chosen(best: dict[Span, float]) -> list[Span]:
    """Spans that don't overlap, with the greatest sum of confidence times length; of equal sums those that end first."""
    spans = sorted(best, key=lambda s: (s[2], s[1], s[0]))
    ends = [s[2] for s in spans]
    sums, before = [0.0], [0]
    for i, (k, a, b) in enumerate(spans):
        before.append(bisect_right(ends, a, 0, i))
        sums.append(max(sums[-1], sums[before[-1]] + best[k, a, b] * (b - a)))
    out, i = [], len(spans)
    while i:
        if sums[i] > sums[i - 1]:
            out.append(spans[i - 1])
            i = before[i]
        else:
            i -= 1
    return out


def scan(texts: list[str], model: Model | None) -> list[tuple[list[Span], list[Span]]]:
    """Base spans and all spans of each text."""
    base = [base_spans(t) for t in texts]
    if model is None:
        return [(b, b) for b in base]
    at = [(i, w) for i, t in enumerate(texts) for w in windows(t, base[i])]
    found: dict[int, list] = {}
    decoded = model.decode([texts[i][a:b] for i, (a, b, *_) in at])
    for (i, (a, b, first, last)), spans in zip(at, decoded, strict=True):
        for (k, s, e), sure in spans:
            found.setdefault(i, []).append(((k, a + s, a + e), sure, s == 0 and a > first, a + e == b and b < last))
    return [(b, reconciled(t, b, found[i], model.threshold) if i in found else b) for i, (t, b) in enumerate(zip(texts, base, strict=True))]


def sample(docs: DataFrame, n: int = SAMPLE_DOCS) -> list[str]:
    """The texts of ``n`` documents, those with the smallest hashes of their ids; of long texts a part around a place by the hash."""
    ids = docs.where("doc_id IS NOT NULL AND text IS NOT NULL").select("doc_id", F.xxhash64("doc_id").alias("place"))
    chosen = ids.distinct().orderBy("place", "doc_id").limit(n)
    part = F.substring("text", F.pmod("place", F.greatest(F.lit(1), F.char_length("text") - 4000)).cast("int") + 1, F.lit(4000))
    rows = docs.join(F.broadcast(chosen), "doc_id").select(part.alias("t")).distinct().orderBy(F.xxhash64("t"), "t").limit(n).collect()
    return [r["t"] for r in rows]


_ADDED = "n_email long, n_ip long, n_card long, n_phone long, base string, spans string"


def _find(shared, names: list[str]):
    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for whole in batches:
            raws = raw_texts(whole.column("text"))
            for i, j in slices([len(r) + 1 for r in raws], SLICE_BYTES):
                found = scan([r.decode("utf-8", "replace") for r in raws[i:j]], model)
                counts = [pa.array([sum(s[0] == k for s in base) for base, _ in found], pa.int64()) for k in range(len(KINDS))]
                strings = [pa.array([listed(x[k]) for x in found], pa.string()) for k in (0, 1)]
                batch = whole.slice(i, j - i)
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *counts, *strings], names)

    return find


def personal_data(docs: DataFrame, model: Model | None = None) -> DataFrame:
    """``doc_id, n_email, n_ip, n_card, n_phone, base, spans``: one row for each row of ``docs``.

    Counts and ``base`` are the base rules'; ``spans`` lists all, as kind:start:end in code points by kind and start. A null
    or empty text has none (empty strings). Rows are independent, so repeated rows and ids give repeated results; other
    columns are left out. Without ``model`` one is trained on a sample of ``docs``. An empty table gives an empty table.
    """
    spark = docs.sparkSession
    texts = docs.select(F.col("doc_id").cast("long"), "text")
    shared = spark.sparkContext.broadcast(train(sample(texts)) if model is None else model)  # a few thousand numbers
    names = ["doc_id", *[f"n_{k}" for k in KINDS], "base", "spans"]
    return texts.mapInArrow(_find(shared, names), f"doc_id long, {_ADDED}")


def op13_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = personal_data(documents(spark, sf_dir))
    return found.select("doc_id", *[f"n_{k}" for k in KINDS], hex_digest("base").alias("base_sha256"), "spans")
