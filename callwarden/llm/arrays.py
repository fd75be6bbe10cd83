"""Texts of an Arrow batch as flat byte arrays, so that per-word work is numpy over a whole block.

A block is a run of documents of at most `BLOCK_BYTES` (one longer document is a block of its own),
which bounds memory whatever the batch size.  Nulls count as empty texts.
"""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

BLOCK_BYTES = 1 << 19
_P = np.uint64(0x9E3779B97F4A7C15 | 1)
_INV = np.uint64(pow(int(_P), -1, 1 << 64))
_powers: dict[str, np.ndarray] = {}

#: Words are runs of bytes other than space, tab, line feed, vertical tab, form feed, return.
SPACE = np.zeros(256, dtype=bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes of all texts, offsets with one more entry than texts)."""
    if column.null_count:
        column = pc.fill_null(column, "")
    if pa.types.is_large_string(column.type):
        kind = np.int64
    else:
        column, kind = column.cast(pa.string()), np.int32
    if len(column) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, kind)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[at[0] : at[-1]], at - at[0]


def release() -> None:
    """Give memory that is free back to the system, where the C library can."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


#: What tasks keep in a worker for later ones of their kind, by kind.
kept: dict[str, dict] = {}


def tidy(run: Callable, kind: str | None = None) -> Callable:
    """`run`, a function of a task's batches, that drops what tasks of another `kind` have kept, and leaves no free
    memory behind: Spark keeps the worker for later tasks."""

    def tidied(batches):
        for other in kept.keys() - {kind}:
            kept[other].clear()
        try:
            yield from run(batches)
        finally:
            release()

    return tidied


def blocks(offsets: np.ndarray, most: int = BLOCK_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges [first, last) of documents of at most `most` bytes together."""
    n, first = len(offsets) - 1, 0
    while first < n:
        last = int(np.searchsorted(offsets, offsets[first] + most, side="right")) - 1
        last = min(max(last, first + 1), n)
        yield first, last
        first = last


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd number and of its inverse modulo 2^64, grown on demand."""
    if len(_powers.get("p", ())) < n:
        size = max(n, BLOCK_BYTES + 1)
        for name, base in (("p", _P), ("i", _INV)):
            out = np.full(size, base, np.uint64)
            out[0] = 1
            _powers[name] = np.cumprod(out)
    return _powers["p"][:n], _powers["i"][:n]


def mix(h: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit values."""
    h = h ^ (h >> np.uint64(31))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(29)
    h = h * np.uint64(0x94D049BB133111EB)
    h ^= h >> np.uint64(32)
    return h


class Hasher:
    """Polynomial hashes of any byte ranges of one block, from prefix sums."""

    def __init__(self, data: np.ndarray):
        p, self.inverse = powers(len(data) + 1)
        self.sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum((data.astype(np.uint64) + np.uint64(1)) * p[:-1], out=self.sums[1:])

    def ranges(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix((self.sums[end] - self.sums[start]) * self.inverse[start] + (end - start).astype(np.uint64))


def runs(flags: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs of True."""
    edges = np.flatnonzero(np.diff(np.concatenate(([0], flags.view(np.int8), [0]))))
    return edges[::2], edges[1::2]


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, document) of every word; words never cross documents."""
    spaced = SPACE[data]
    starts, ends = runs(~spaced)
    inner = offsets[1:-1]
    if len(inner) and len(starts):  # cut words that touch across a document's end
        at = np.searchsorted(starts, inner, side="left") - 1
        cut = (at >= 0) & (inner < ends[np.maximum(at, 0)]) & (inner > starts[np.maximum(at, 0)])
        cuts = np.unique(inner[cut])
        starts, ends = np.sort(np.concatenate((starts, cuts))), np.sort(np.concatenate((ends, cuts)))
    doc = np.searchsorted(offsets, starts, side="right") - 1
    return starts, ends, doc


def tokens(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """As `words`, but a word is further split where letters or digits meet symbols."""
    kind = KIND[data].copy()
    edge = np.empty(len(data) + 1, dtype=bool)
    edge[0] = edge[-1] = True
    edge[1:-1] = kind[1:] != kind[:-1]
    edge[offsets] = True
    at = np.flatnonzero(edge)
    starts, ends = at[:-1], at[1:]
    keep = kind[starts] != 0 if len(data) else np.zeros(0, bool)
    starts, ends = starts[keep], ends[keep]
    return starts, ends, np.searchsorted(offsets, starts, side="right") - 1


#: 0 space, 1 letters, digits and everything beyond ASCII, 2 symbols and control characters.
KIND = np.full(256, 2, np.uint8)
KIND[SPACE] = 0
KIND[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = 1
