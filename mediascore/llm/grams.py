"""Hashed byte n-grams of whole texts, many texts at a time."""

from __future__ import annotations

import numpy as np

#: Odd multipliers that spread an n-gram's bytes (fixed values).
_SPREAD = np.uint64(0x9E3779B97F4A7C15)


def gram_ids(text: str | None, sizes: tuple[int, ...], bits: int) -> np.ndarray:
    """Ids below 2**bits of every n-gram of the lower-cased text, in which a
    run of white space counts as one space and which a space begins and ends."""
    raw = np.frombuffer(b" " + " ".join((text or "").lower().split()).encode("utf-8", "replace") + b" ", np.uint8).astype(np.uint64)
    out = []
    for n in sizes:
        if len(raw) < n:
            continue
        code = np.full(len(raw) - n + 1, n, np.uint64)
        for k in range(n):
            code = (code << np.uint64(8)) | raw[k : len(raw) - n + 1 + k]
        out.append(((code * _SPREAD) >> np.uint64(64 - bits)).astype(np.int64))
    return np.concatenate(out) if out else np.zeros(0, np.int64)


def counts(text: str | None, sizes: tuple[int, ...], bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Ids that occur, and how often."""
    all_ = np.bincount(gram_ids(text, sizes, bits), minlength=1 << bits)
    ids = np.flatnonzero(all_)
    return ids, all_[ids]


#: How many word patterns there are.
PATTERNS = 64


def pattern_ids(text: str | None) -> np.ndarray:
    """For each four consecutive words which of them are equal, as a number
    below PATTERNS: n-grams of words up to renaming, which tell repetition in
    any vocabulary."""
    number: dict[str, int] = {}
    w = np.array([number.setdefault(x, len(number)) for x in (text or "").split()], np.int64)
    if len(w) < 4:
        return np.zeros(0, np.int64)
    one, two, three = w[:-1] == w[1:], w[:-2] == w[2:], w[:-3] == w[3:]
    n = len(three)
    bits = (one[:n], one[1 : n + 1], one[2 : n + 2], two[:n], two[1 : n + 1], three)
    return sum(b.astype(np.int64) << k for k, b in enumerate(bits))
