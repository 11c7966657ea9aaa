"""Words of whole texts as 64-bit hashes, a bounded slice of bytes at a time.

A word is a run of bytes other than space, tab, line feed, vertical tab, form feed and carriage
return.  Its hash is a polynomial over random byte values modulo 2**64 (prefix sums give every word
of a slice at once), finished by a bijective mix.  A word longer than a slice is hashed slice by slice.
Nulls count as empty texts.
"""

from __future__ import annotations

import sys
from collections.abc import Callable, Iterator
from typing import Any

import numpy as np
import pyarrow as pa

SLICE_BYTES = 1 << 20


def kept(name: str, make: Callable[[], Any]) -> Any:
    """``make()``, called once per worker process.

    Tasks bring their own copy of this package, so what lives longer than a task cannot be its attribute.
    """
    store = sys.__dict__.setdefault("_assayer_kept", {})
    if name not in store:
        store[name] = make()
    return store[name]


_BASE = 0x9E3779B97F4A7C15 | 1
_WHITE = np.zeros(256, bool)
_WHITE[[32, *range(9, 14)]] = True


def mix(x: np.ndarray) -> np.ndarray:
    """Bijective finaliser on unsigned 64-bit integers."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def stream(seed: int, n: int) -> np.ndarray:
    """``n`` fixed pseudo-random 64-bit integers."""
    start = np.uint64((seed * 0xD1342543DE82EF95 + 1) & (2**64 - 1))
    return mix(start + np.arange(1, n + 1, dtype=np.uint64) * np.uint64(_BASE))


def _byte_values(lower: bool) -> np.ndarray:
    values = stream(1, 256)
    if lower:
        values[65:91] = values[97:123]
    return values


def _both_powers(size: int) -> tuple[np.ndarray, np.ndarray]:
    both = []
    for base in (_BASE, pow(_BASE, -1, 2**64)):
        p = np.full(size, base, np.uint64)
        p[0] = 1
        both.append(np.cumprod(p, dtype=np.uint64))
    return both[0], both[1]


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """At least ``n`` powers of the base and of its inverse modulo 2**64."""
    if n <= SLICE_BYTES:
        return kept("powers", lambda: _both_powers(SLICE_BYTES))
    return _both_powers(n)


def word_bounds(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and end offset of each word in a byte array."""
    gap = np.ones(len(data) + 2, np.int8)
    gap[1:-1] = _WHITE[data]
    turn = np.diff(gap)
    return np.flatnonzero(turn == -1), np.flatnonzero(turn == 1)


def _sums(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, lower: bool) -> np.ndarray:
    up, down = powers(max(1, len(data)))
    total = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_byte_values(lower)[data] * up[:len(data)], out=total[1:])
    return (total[ends] - total[starts]) * down[starts]


def hash_words(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, lower: bool) -> np.ndarray:
    return mix(_sums(data, starts, ends, lower))


def locate(text: bytes, lower: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash, start and end of each word of one text, a slice of bytes at a time.

    A word that reaches into the next slice carries its sum along, so a word of any length costs
    no more memory than a slice.
    """
    found, open_, last = [], False, 0
    for at in range(0, len(text), SLICE_BYTES):
        data = np.frombuffer(text, np.uint8, min(SLICE_BYTES, len(text) - at), at)
        starts, ends = word_bounds(data)
        sums = _sums(data, starts, ends, lower)
        starts, ends = starts + at, ends + at
        if open_ and len(starts) and starts[0] == at:
            before = found[-1]
            before[0][-1:] += sums[:1] * np.uint64(pow(_BASE, at - last, 2**64))
            before[2][-1] = ends[0]
            starts, ends, sums = starts[1:], ends[1:], sums[1:]
        if len(starts):
            found.append((sums, starts, ends))
            last = int(starts[-1])
        open_ = bool(found) and int(found[-1][2][-1]) == at + len(data)
    if not found:
        none = np.zeros(0, np.int64)
        return np.zeros(0, np.uint64), none, none
    sums, starts, ends = (np.concatenate(x) for x in zip(*found))
    return mix(sums), starts, ends


def slices(texts: list[bytes | None]) -> Iterator[tuple[int, int]]:
    """Row ranges whose texts fill about one slice; a longer text stands alone."""
    first, size = 0, 0
    for i, t in enumerate(texts):
        n = len(t) if t else 0
        if i > first and size + n > SLICE_BYTES:
            yield first, i
            first, size = i, 0
        size += n + 1
    if first < len(texts):
        yield first, len(texts)


def hashed(texts: list[bytes | None], lower: bool) -> tuple[np.ndarray, np.ndarray]:
    """Word hashes of one slice of texts, and where each text's words begin (one more at the end)."""
    if len(texts) == 1 and texts[0] and len(texts[0]) > SLICE_BYTES:
        found, _, _ = locate(texts[0], lower)
        return found, np.array([0, len(found)])
    data = np.frombuffer(b" ".join(t or b"" for t in texts), np.uint8)
    starts, ends = word_bounds(data)
    sizes = np.fromiter((len(t) + 1 if t else 1 for t in texts), np.int64, len(texts))
    splits = np.searchsorted(starts, np.concatenate([[0], np.cumsum(sizes)]))
    return hash_words(data, starts, ends, lower), splits


def grams(words: np.ndarray, splits: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash of every ``k`` consecutive words at its first word; False where it would leave the text."""
    n = len(words) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64), np.zeros(0, bool)
    total = np.zeros(n, np.uint64)
    for j in range(k):
        total = total * np.uint64(_BASE) + words[j:j + n]
    inside = np.ones(n, bool)
    for end in splits[1:-1]:
        inside[max(0, end - k + 1):end] = False
    return mix(total + np.uint64(k)), inside


def as_bytes(column: pa.Array | pa.ChunkedArray) -> list[bytes | None]:
    return column.cast(pa.large_binary()).to_pylist()


def row_blocks(batch: pa.RecordBatch, column: str, limit: int = 16 << 20) -> Iterator[pa.RecordBatch]:
    """An Arrow batch in row ranges of about ``limit`` text bytes."""
    sizes = np.asarray(pa.compute.fill_null(pa.compute.binary_length(batch.column(column)), 0))
    at = 0
    total = np.cumsum(sizes)
    while at < len(sizes):
        done = total[at - 1] if at else 0
        end = max(at + 1, int(np.searchsorted(total, done + limit, "right")))
        yield batch.slice(at, end - at)
        at = end
