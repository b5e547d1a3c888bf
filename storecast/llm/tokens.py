"""Words of Arrow text columns as 64-bit hashes, by whole-array numpy steps over their UTF-8 bytes."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Odd multiplier of the polynomial word hash and its inverse modulo 2**64.
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)
#: Texts are handled in slices of about so many bytes (one text at least).
SLICE_BYTES = 1 << 20

_powers = [np.ones(1, np.uint64), np.ones(1, np.uint64)]

SPACES = np.zeros(256, bool)
SPACES[[0x20, 9, 10, 11, 12, 13]] = True
#: Everything but ASCII letters and digits and non-ASCII bytes.
PUNCTUATION = np.ones(256, bool)
PUNCTUATION[np.r_[48:58, 65:91, 97:123, 128:256]] = False

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of the base and of its inverse."""
    if len(_powers[0]) < n:
        for i, factor in enumerate((_BASE, _INVERSE)):
            steps = np.full(n, factor, np.uint64)
            steps[0] = 1
            _powers[i] = np.cumprod(steps)
    return _powers[0][:n], _powers[1][:n]


def mix(h: np.ndarray) -> np.ndarray:
    """A 64-bit finalizer (splitmix): spreads every input bit over all output bits."""
    h = h ^ (h >> np.uint64(30))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h = h ^ (h >> np.uint64(27))
    h = h * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of a string column and its n + 1 offsets into them; nulls are empty."""
    column = (column.cast(pa.string()) if pa.types.is_null(column.type) else column).fill_null("")
    large = pa.types.is_large_string(column.type)
    offsets = np.frombuffer(column.buffers()[1], np.int64 if large else np.int32)[column.offset:column.offset + len(column) + 1].astype(np.int64)
    body = column.buffers()[2]
    if body is None or not len(column):
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    data = np.frombuffer(body, np.uint8)[offsets[0]:offsets[-1]]
    return data, offsets - offsets[0]


def slices(column: pa.Array, most: int = SLICE_BYTES) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, bytes, offsets) of runs of rows of about ``most`` bytes."""
    data, offsets = text_bytes(column)
    row, n = 0, len(offsets) - 1
    while row < n:
        end = max(row + 1, int(np.searchsorted(offsets, offsets[row] + most, side="right")) - 1)
        yield row, data[offsets[row]:offsets[end]], offsets[row:end + 1] - offsets[row]
        row = end


def lower(data: np.ndarray, latin: bool = False) -> np.ndarray:
    """ASCII letters in lower case; with ``latin`` also the accented capitals of U+00C0 to U+00DE."""
    out = _LOWER[data]
    if latin and len(out) > 1:
        after = out[1:]
        after[(out[:-1] == 0xC3) & (after >= 0x80) & (after <= 0x9E) & (after != 0x97)] += 32
    return out


def word_bounds(data: np.ndarray, offsets: np.ndarray, separators: np.ndarray = SPACES) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and row of every run of bytes that aren't separators; rows don't join."""
    n = len(data)
    if not n:
        return (np.zeros(0, np.int64),) * 3
    inside = ~separators[data]
    cut = np.zeros(n + 1, bool)
    cut[offsets] = True
    starts = inside.copy()
    starts[1:] &= ~inside[:-1] | cut[1:n]
    ends = inside.copy()
    ends[:-1] &= ~inside[1:] | cut[1:n]
    s, e = np.flatnonzero(starts), np.flatnonzero(ends) + 1
    return s, e, np.searchsorted(offsets, s, side="right") - 1


class Hasher:
    """Hashes of byte ranges of one slice."""

    def __init__(self, data: np.ndarray):
        power, self.inverse = powers(len(data) + 1)
        self.sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum((data.astype(np.uint64) + np.uint64(1)) * power[:len(data)], out=self.sums[1:])

    def __call__(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        return mix((self.sums[ends] - self.sums[starts]) * self.inverse[starts])


def shingles(words: np.ndarray, rows: np.ndarray, n_rows: int, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash and row of every run of ``size`` words in a row; a row of fewer words has one shingle of all of them (none if empty)."""
    if not len(words):
        return words, rows
    counts = np.bincount(rows, minlength=n_rows)
    h = words.copy()
    last = len(words) - size + 1
    multiplier = np.uint64(_BASE)
    if last > 0:
        h = words[:last].copy()
        for i in range(1, size):
            h = h * multiplier + words[i:last + i]
        whole = rows[:last] == rows[size - 1:]
        full, full_rows = mix(h[whole]), rows[:last][whole]
    else:
        full, full_rows = words[:0], rows[:0]
    short = np.flatnonzero((counts > 0) & (counts < size))
    if len(short):
        firsts = np.cumsum(counts) - counts
        extra = np.array([_fold(words[firsts[r]:firsts[r] + counts[r]]) for r in short], np.uint64)
        full, full_rows = np.concatenate([full, extra]), np.concatenate([full_rows, short])
        order = np.argsort(full_rows, kind="stable")
        full, full_rows = full[order], full_rows[order]
    return full, full_rows


def _fold(words: np.ndarray) -> int:
    h = 0
    for w in words:
        h = (h * _BASE + int(w)) % (1 << 64)
    return int(mix(np.array([h ^ 0x5bd1e995], np.uint64))[0])
