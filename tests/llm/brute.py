"""The operators by brute force, on plain lists of (doc_id, text, lang, source)."""

from __future__ import annotations

import hashlib
import math
import re
import zlib
from collections import Counter

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = {i: i + 32 for i in range(65, 91)}
LAST = 2**63 - 1


def sha(text: str | bytes) -> str:
    return hashlib.sha256(text if isinstance(text, bytes) else text.encode()).hexdigest()


def words(text, lower=True):
    text = text or ""
    return WORD.findall(text.translate(LOWER) if lower else text)


def is_held_out(doc_id, remainder):
    return doc_id is not None and zlib.crc32(str(doc_id).encode()) % 5 == remainder


def near_groups(docs, width, percent):
    sets = []
    for _, text, *_ in docs:
        w = words(text)
        sets.append(frozenset(tuple(w[k : k + width]) for k in range(max(1, len(w) - width + 1))) if w else frozenset())
    group = list(range(len(docs)))

    def root(i):
        while group[i] != i:
            i = group[i]
        return i

    for i in range(len(docs)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if sets[i] and sets[j] and 100 * both >= percent * (len(sets[i]) + len(sets[j]) - both):
                group[max(root(i), root(j))] = min(root(i), root(j))
    least = {}
    for i, d in enumerate(docs):
        if d[0] is not None:
            least[root(i)] = min(d[0], least.get(root(i), LAST))
    return [(d[0], len(s), least.get(root(i)) if s else d[0]) for i, (d, s) in enumerate(zip(docs, sets))]


def exact_groups(docs):
    groups = {}
    for d in docs:
        groups.setdefault((d[1] or "").translate(LOWER), []).append(d[0])
    out = []
    for text, ids in groups.items():
        ids = sorted(ids, key=lambda i: (i is not None, i or 0), reverse=True)
        out += [(i, ids[0], len(ids), k == 0, sha(text)) for k, i in enumerate(ids)]
    return out


def without_passages(docs, window=13):
    order = sorted(docs, key=lambda d: LAST if d[0] is None else d[0])
    first, out = {}, []
    for doc_id, text, *_ in order:
        w = words(text, False)
        for k in range(len(w) - window + 1):
            first.setdefault(tuple(w[k : k + window]), LAST if doc_id is None else doc_id)
    for doc_id, text, *_ in order:
        w = words(text, False)
        gone = [False] * len(w)
        for k in range(len(w) - window + 1):
            if first[tuple(w[k : k + window])] < (LAST if doc_id is None else doc_id):
                gone[k : k + window] = [True] * window
        out.append((doc_id, len(w), sum(gone), sha(" ".join(x for x, g in zip(w, gone) if not g))))
    return out


def base_scores(docs):
    tokens = [(d[0], [*words(d[1]), None]) for d in docs]
    counts = Counter()
    for doc_id, t in tokens:
        if not is_held_out(doc_id, 1):
            counts.update(t)
    n, v = sum(counts.values()), len(counts)
    return {
        (doc_id, len(t), sum(counts[x] > 0 for x in t), n): sum(math.log10((counts[x] + 0.5) / (n + 0.5 * (v + 1))) for x in t)
        for doc_id, t in tokens
    }


def pair_scores(docs, steps, prior):
    """Scores from the quantised counts of all pairs, with the base probabilities as prior."""
    tokens = {d[0]: [None, *words(d[1]), None] for d in docs}
    one, two = Counter(), Counter()
    for doc_id, t in tokens.items():
        if not is_held_out(doc_id, 1):
            one.update(t[1:])
            two.update(zip(t, t[1:]))
    total = sum(one.values())
    alone = lambda x: (one[x] + 0.5) / (total + 0.5 * (len(one) + 1))
    seen = lambda n: 2 ** (math.floor(math.log2(n) * steps + 1e-9) / steps) if n else 0.0
    return {
        doc_id: sum(math.log10((seen(two[b, x]) + prior * alone(x)) / (one[b] + prior)) for b, x in zip(t, t[1:]))
        for doc_id, t in tokens.items()
    }


def edited_texts(docs):
    order = sorted(docs, key=lambda d: (d[0] is not None, d[0] or 0, d[1] is not None, d[1] or ""))
    out = []
    for k, d in enumerate(order):
        text, after = d[1] or "", order[(k + 1) % len(order)][1] or ""
        half = len(text) // 2
        out.append((d[0], len(text), sha(text[: len(text) - half] + after[:half])))
    return out
