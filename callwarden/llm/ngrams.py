"""Hashed n-grams and skip-grams of whole texts, as (document, feature) pairs."""

from __future__ import annotations

import numpy as np

from callwarden.llm.arrays import LOWER, Hasher, mix, tokens

DITTO = np.uint64(0x5851F42D4C957F2D)


def features(data: np.ndarray, offsets: np.ndarray, orders: tuple[int, ...], skips: tuple[int, ...], bits: int, lower: bool, ditto: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """Words and runs of symbols are tokens; `orders` of 2 take neighbours, `skips` of 2 leave one out.

    With `ditto`, a token equal to the one before it is written as a ditto mark.
    """
    starts, ends, doc = tokens(data, offsets)
    if not len(starts):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    single = Hasher(LOWER[data] if lower else data).ranges(starts, ends)
    if ditto:
        again = (single[1:] == single[:-1]) & (doc[1:] == doc[:-1])
        single[1:][again] = DITTO
    docs, found = [], []
    shift = np.uint64(64 - bits)
    for n in orders:
        h = single[: len(single) - n + 1].copy()
        for i in range(1, n):
            h = mix(h * np.uint64(3) + single[i : len(single) - n + 1 + i])
        inside = doc[: len(h)] == doc[n - 1 :]
        docs.append(doc[: len(h)][inside])
        found.append((mix(h + np.uint64(n)) >> shift)[inside])
    for n in skips:
        h = mix(single[:-n] * np.uint64(5) + single[n:] + np.uint64(100 + n))
        inside = doc[:-n] == doc[n:]
        docs.append(doc[:-n][inside])
        found.append((h >> shift)[inside])
    return np.concatenate(docs), np.concatenate(found).astype(np.int64)
