"""Distinct word shingles of many texts as sorted 64-bit hashes, made with whole-array operations."""

from __future__ import annotations

import numpy as np

_A, _B, _C = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0x165667B19E3779F9)


def mix(x: np.ndarray) -> np.ndarray:
    """Finalising steps of a 64-bit hash."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingle_sets(texts: list[str], width: int = 3) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the distinct shingles of each text, ascending, in one array, and the offsets of the texts.

    Words are runs of anything but ASCII white space, A to Z in lower case. A text with fewer words than ``width`` has its whole
    sequence as only shingle, one without words none.
    """
    raw = [x.encode("utf-8", "surrogatepass") + b" " for x in texts]
    flat = np.frombuffer(b"".join(raw), np.uint8)
    flat = np.where((flat >= 65) & (flat <= 90), flat + 32, flat)
    solid = ~((flat == 32) | ((flat >= 9) & (flat <= 13)))
    at = np.flatnonzero(solid)
    if not len(at):
        return np.zeros(0, np.uint64), np.zeros(len(texts) + 1, np.int64)
    head = np.r_[True, np.diff(at) > 1]
    begin = np.flatnonzero(head)
    word = np.cumsum(head) - 1
    inside = np.arange(len(at)) - begin[word]
    keys = mix(np.arange(int(inside.max()) + 1, dtype=np.uint64) * _A + _B)
    hashed = mix(np.add.reduceat((flat[at].astype(np.uint64) + np.uint64(1)) * keys[inside], begin))
    ends = np.cumsum(np.fromiter(map(len, raw), np.int64, len(raw)))
    doc = np.searchsorted(ends, at[begin], "right")
    n = np.bincount(doc, minlength=len(texts))
    first = np.r_[0, np.cumsum(n)][:-1]
    place = np.arange(len(doc)) - first[doc]
    factor = [_A, _B, _C]
    # a shingle begins at every word that enough words follow, and at the first word of a short text
    starts = np.flatnonzero((place + width <= n[doc]) | ((place == 0) & (n[doc] < width)))
    total = np.minimum(n[doc[starts]], width).astype(np.uint64)
    for i in range(width):
        here = starts + i
        inner = i < total
        step = hashed[np.minimum(here, len(hashed) - 1)] * (factor[i % 3] + np.uint64(2 * (i // 3)))
        total_hash = np.where(inner, step, 0) if i == 0 else total_hash + np.where(inner, step, 0)
    out, of = mix(total_hash + total), doc[starts]
    order = np.lexsort((out, of))
    out, of = out[order], of[order]
    once = np.r_[True, (out[1:] != out[:-1]) | (of[1:] != of[:-1])]
    return out[once], np.r_[0, np.cumsum(np.bincount(of[once], minlength=len(texts)))]
