"""Vectorised words and word shingles over Arrow string columns.

A word is a run of bytes other than space and 0x09-0x0D, with A-Z lower-cased. Hashes are 64-bit: a
polynomial over the bytes of a word, mixed, then combined over the words of a shingle. All functions
work on whole texts; a null text counts as empty.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

CHUNK_BYTES = 1 << 20
_BASE = np.uint64(0x9E3779B97F4A7C15 | 5)
_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_ONE = np.uint64(1)

_SEPARATOR = np.zeros(256, dtype=bool)
_SEPARATOR[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[ord("A") : ord("Z") + 1] += 32
_powers: dict[str, np.ndarray] = {}


def mix(h: np.ndarray) -> np.ndarray:
    """Spread all 64 bits; a bijection."""
    h = (h ^ (h >> np.uint64(30))) * _M1
    h = (h ^ (h >> np.uint64(27))) * _M2
    return h ^ (h >> np.uint64(31))


def distinct(h: np.ndarray) -> np.ndarray:
    """Sorted distinct values; sorts and compares neighbours, which beats a hash table here."""
    h = np.sort(h)
    keep = np.ones(len(h), dtype=bool)
    np.not_equal(h[1:], h[:-1], out=keep[1:])
    return h[keep]


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2**64, at least ``n`` of each."""
    have = _powers.get("up")
    if have is not None and len(have) >= n:
        return have, _powers["down"]
    n = max(n, CHUNK_BYTES) + 1
    up = np.full(n, _BASE, dtype=np.uint64)
    down = np.full(n, np.uint64(pow(int(_BASE), -1, 1 << 64)), dtype=np.uint64)
    up[0] = down[0] = _ONE
    pair = (np.multiply.accumulate(up), np.multiply.accumulate(down))
    if n <= 16 * CHUNK_BYTES:  # one huge text does not stay in memory
        _powers["up"], _powers["down"] = pair
    return pair


def string_buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Offsets (n + 1) and UTF-8 bytes of a string column, nulls as empty."""
    column = column.cast(pa.large_string()).fill_null("")
    _, off, data = column.buffers()
    offsets = np.frombuffer(off, dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
    return offsets, raw


def chunks(offsets: np.ndarray, limit: int = CHUNK_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of rows whose texts together stay near ``limit`` bytes, at least one row each."""
    at, n = 0, len(offsets) - 1
    while at < n:
        end = int(np.searchsorted(offsets, offsets[at] + limit, "right")) - 1
        end = min(n, max(end, at + 1))
        yield at, end
        at = end


def word_bounds(offsets: np.ndarray, raw: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end byte of every word and the number of words per row; rows lie in ``raw`` back to back."""
    n = len(raw)
    if n == 0:
        none = np.zeros(0, np.int64)
        return none, none, np.zeros(len(offsets) - 1, np.int64)
    inside = ~_SEPARATOR[raw]
    first = np.zeros(n + 1, dtype=bool)  # a row begins here
    first[offsets] = True
    start = inside.copy()
    start[1:] &= ~inside[:-1] | first[1:n]
    end = inside.copy()
    end[:-1] &= ~inside[1:] | first[1:n]
    starts, ends = np.flatnonzero(start), np.flatnonzero(end) + 1
    counts = np.diff(np.searchsorted(starts, offsets))
    return starts, ends, counts


def span_hashes(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray, lower: bool = True) -> np.ndarray:
    """64-bit hash of every span of bytes, with A-Z lower-cased unless ``lower`` is off."""
    up, down = _power_tables(len(raw) + 1)
    total = np.zeros(len(raw) + 1, dtype=np.uint64)
    data = _LOWER[raw] if lower else raw
    np.cumsum(data.astype(np.uint64) * up[: len(raw)], out=total[1:])
    h = (total[ends] - total[starts]) * down[starts]
    return mix(h + (ends - starts).astype(np.uint64) * _M2)


def shingle_sets(column: pa.Array, width: int) -> Iterator[np.ndarray]:
    """Per row the sorted distinct hashes of its ``width``-word shingles.

    A row with fewer words has one shingle, its whole sequence; a row without words has none.
    """
    offsets, raw = string_buffers(column)
    for lo, hi in chunks(offsets):
        part = raw[offsets[lo] : offsets[hi]]
        starts, ends, counts = word_bounds(offsets[lo : hi + 1] - offsets[lo], part)
        words = span_hashes(part, starts, ends)
        grams = np.zeros(0, np.uint64)
        if len(words) >= width:
            n = len(words) - width + 1
            grams = words[:n].copy()
            for k in range(1, width):
                grams = mix(grams * _BASE + words[k : k + n])
        at = 0
        for count in counts.tolist():
            if count >= width:
                yield distinct(grams[at : at + count - width + 1])
            elif count:
                h = words[at : at + 1] + np.uint64(count)  # tagged: never equal to a full shingle by construction
                for k in range(1, count):
                    h = mix(h * _M1 + words[at + k : at + k + 1])
                yield h
            else:
                yield np.zeros(0, np.uint64)
            at += count


def word_counts(column: pa.Array) -> np.ndarray:
    offsets, raw = string_buffers(column)
    parts = [
        word_bounds(offsets[lo : hi + 1] - offsets[lo], raw[offsets[lo] : offsets[hi]])[2] for lo, hi in chunks(offsets)
    ]
    return np.concatenate(parts) if parts else np.zeros(0, np.int64)
