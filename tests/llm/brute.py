"""Plain versions of the operators' contracts, for comparison on small tables."""

from __future__ import annotations

import hashlib
import re

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def _covered(sequences: dict, length: int) -> dict:
    """For each key in ascending order, flags of the items covered by a window that starts earlier too."""
    seen, out = set(), {}
    for key in sorted(sequences):
        items = sequences[key]
        flags = [False] * len(items)
        last = -1
        for p in range(len(items) - length + 1):
            window = items[p : p + length]
            if window in seen:
                for q in range(max(last, p), p + length):
                    flags[q] = True
                last = p + length
            else:
                seen.add(window)
        out[key] = flags
    return out


def suffix_dedup(texts: dict, length: int = 100) -> dict:
    data = {k: (t or "").encode() for k, t in texts.items()}
    out = {}
    for k, flags in _covered(data, length).items():
        kept = bytes(b for b, f in zip(data[k], flags, strict=True) if not f)
        spans = sum(f and (i == 0 or not flags[i - 1]) for i, f in enumerate(flags))
        out[k] = (len(flags), sum(flags), spans, hashlib.sha256(kept).hexdigest())
    return out


def substring_dedup(texts: dict, length: int = 20) -> dict:
    words = {k: tuple(WORD.findall(t or "")) for k, t in texts.items()}
    out = {}
    for k, flags in _covered(words, length).items():
        kept = " ".join(w for w, f in zip(words[k], flags, strict=True) if not f)
        out[k] = (len(flags), sum(flags), hashlib.sha256(kept.encode()).hexdigest())
    return out


def shingles(text: str | None, size: int = 5) -> frozenset:
    words = WORD.findall((text or "").translate({c: c + 32 for c in range(65, 91)}))
    if not words:
        return frozenset()
    return frozenset(tuple(words[i : i + size]) for i in range(max(1, len(words) - size + 1)))


def components(texts: dict) -> dict:
    """(n_shingles, component_id) of each document, over all pairs."""
    sets = {k: shingles(t) for k, t in texts.items()}
    root = {k: k for k in sets}

    def find(k):  # noqa: ANN001, ANN202
        while root[k] != k:
            k = root[k]
        return k

    where: dict = {}
    for k, s in sets.items():
        for x in s:
            where.setdefault(x, []).append(k)
    for k in sorted(sets):
        shared: dict = {}
        for x in sets[k]:
            for other in where[x]:
                if other < k:
                    shared[other] = shared.get(other, 0) + 1
        for other, n in shared.items():
            if 100 * n >= 75 * (len(sets[k]) + len(sets[other]) - n):
                a, b = find(k), find(other)
                root[max(a, b)] = min(a, b)
    return {k: (len(sets[k]), find(k)) for k in sets}
