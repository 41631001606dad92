"""The operators' contracts in plain Python, on lists of (doc_id, text)."""

import hashlib
import re
from collections import Counter, defaultdict

import xxhash
from cases import lower, split_words

WHITE = " \t\n\x0b\x0c\r"


def sha(text: str | bytes) -> str:
    return hashlib.sha256(text.encode() if isinstance(text, str) else text).hexdigest()


def line_dedup(docs):
    """(doc_id, n_lines, n_dropped, text that stays) for each row."""
    holders = defaultdict(set)
    for doc_id, text in docs:
        for line in (text or "").split("\n"):
            key = lower(line.strip(WHITE))
            if len(key) >= 40 and doc_id is not None:
                holders[key].add(doc_id)
    out = []
    for doc_id, text in docs:
        lines = (text or "").split("\n")
        keys = [lower(x.strip(WHITE)) for x in lines]
        lost = [
            doc_id is not None and len(holders.get(k, ())) >= 5 and max(holders[k]) != doc_id
            for k in keys
        ]
        stay = [x for x, gone in zip(lines, lost, strict=True) if not gone]
        out.append((doc_id, len(lines), sum(lost), "\n".join(stay)))
    return out


def repeat_mask(words, n):
    windows = [tuple(words[i : i + n]) for i in range(len(words) - n + 1)]
    counts = Counter(windows)
    return {i + j for i, w in enumerate(windows) if counts[w] > 1 for j in range(n)}


def quality(text, limits, max_line_copies, allowed=600):
    """The base measures, base_failed and kept."""
    words = split_words(text)
    chars = sum(map(len, words))
    lines = [x for x in (text or "").split("\n") if split_words(x)]
    copies = [x for i, x in enumerate(lines) if x in lines[:i]] if len(lines) < 2000 else [*(Counter(lines) - Counter(set(lines))).elements()]
    repeat = len(repeat_mask(words, 3))
    failed = len(words) < 50 or 100 * repeat > 50 * len(words)
    fine = sum(map(len, copies)) / max(1, sum(map(len, lines))) <= max_line_copies
    for n, limit in limits.items():
        fine = fine and sum(len(words[i]) for i in repeat_mask(words, n)) - allowed <= limit * chars
    base = (len(words), chars, len(re.findall(r"[#*$%&|<>]", text or "")), len(copies), repeat)
    return (*base, failed, not failed and fine)


def simhash(text):
    words = split_words(lower(text or ""))
    shingles = [" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))] if words else []
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def component_of(prints, radius=4):
    """For each index the indices that links reach."""
    root = list(range(len(prints)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, a in enumerate(prints):
        for j in range(i):
            if (a ^ prints[j]).bit_count() <= radius:
                root[max(find(i), find(j))] = min(find(i), find(j))
    return [find(i) for i in range(len(prints))]


def components(docs, radius=4):
    """(doc_id, fingerprint, smallest doc_id reached) for each row."""
    prints = [simhash(t) for _, t in docs]
    roots = component_of(prints, radius)
    least = {}
    for (doc_id, _), r in zip(docs, roots, strict=True):
        if doc_id is not None:
            least[r] = min(doc_id, least.get(r, doc_id))
    return [(d, p, least.get(r)) for (d, _), p, r in zip(docs, prints, roots, strict=True)]


def exact(docs):
    plain = [re.sub(r"[\x20\x09-\x0D]+", " ", t or "") for _, t in docs]
    rows = defaultdict(list)
    for (doc_id, _), t in zip(docs, plain, strict=True):
        rows[t].append(doc_id)
    keep = {t: min((i for i in ids if i is not None), default=None) for t, ids in rows.items()}
    return [(d, keep[t], len(rows[t]), d == keep[t], sha(t)) for (d, _), t in zip(docs, plain, strict=True)]
