"""Vectorised work on the UTF-8 bytes of an Arrow text column.

Texts are taken in chunks of about ``CHUNK`` bytes (a longer text is a
chunk of its own), so a task's memory does not depend on the batch size.
A word's hash is a polynomial of its bytes modulo 2**64, read off prefix
sums and finalised by the splitmix64 mixer; equal bytes have equal hashes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

CHUNK = 1 << 20
BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
SPACES = np.zeros(256, bool)
SPACES[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 0x20
_powers: dict[str, np.ndarray] = {}


def chunks(column: pa.Array, limit: int = CHUNK) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, bytes, offsets) of successive runs of rows; a null is an empty text."""
    if column.null_count:
        column = pc.fill_null(column, "")
    column = column.cast(pa.large_string())
    if not len(column):
        return
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset:column.offset + len(column) + 1]
    data = column.buffers()[2]
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    at = 0
    while at < len(column):
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + limit, "right")) - 1)
        yield at, data[offsets[at]:offsets[to]], offsets[at:to + 1] - offsets[at]
        at = to


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE**i and its inverse for i < n (at least; kept between chunks)."""
    if len(_powers.get("up", ())) < n:
        inverse = np.uint64(pow(int(BASE), -1, 1 << 64))
        for name, b in (("up", BASE), ("down", inverse)):
            p = np.full(max(n, CHUNK + 1), b, np.uint64)
            p[0] = 1
            _powers[name] = np.multiply.accumulate(p)
    return _powers["up"], _powers["down"]


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def word_spans(data: np.ndarray, offsets: np.ndarray, breaks: np.ndarray = SPACES) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and text number of every word; words never cross texts."""
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    inside = ~breaks[data]
    starts, ends = inside.copy(), inside.copy()
    starts[1:] &= ~inside[:-1]
    ends[:-1] &= ~inside[1:]
    first = offsets[:-1][offsets[:-1] < offsets[1:]]
    starts[first] = inside[first]
    last = offsets[1:][offsets[:-1] < offsets[1:]] - 1
    ends[last] = inside[last]
    s, e = np.flatnonzero(starts), np.flatnonzero(ends) + 1
    return s, e, np.searchsorted(offsets, s, "right") - 1


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of the bytes of each span."""
    if not len(starts):
        return np.zeros(0, np.uint64)
    up, down = powers(len(data) + 1)
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[:len(data)], out=sums[1:])
    return mixed((sums[ends] - sums[starts]) * down[starts])


def shingle_sets(data: np.ndarray, offsets: np.ndarray, n: int) -> list[np.ndarray]:
    """Per text the sorted distinct 64-bit hashes of its runs of ``n`` words (A-Z lower-cased);
    fewer words make one shingle, none an empty set."""
    data = LOWER[data]
    s, e, text = word_spans(data, offsets)
    words = span_hashes(data, s, e)
    ends = np.searchsorted(text, np.arange(len(offsets)), "left")
    run = words.copy()
    whole = max(0, len(words) - n + 1)
    run = run[:whole]
    for j in range(1, n):
        run = mixed(run * BASE + words[j:j + whole])
    out = []
    for a, b in zip(ends[:-1], ends[1:]):
        if b - a >= n:
            out.append(np.unique(run[a:b - n + 1]))
        elif b > a:
            h = words[a:a + 1]
            for j in range(a + 1, b):
                h = mixed(h * BASE + words[j:j + 1])
            out.append(mixed(h + np.uint64(b - a)))
        else:
            out.append(words[:0])
    return out
