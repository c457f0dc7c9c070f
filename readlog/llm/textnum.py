"""Vectorised helpers over batches of texts, shared by the corpus operators.

A batch of texts is handled as one byte array with document offsets, taken from Arrow's own buffers, so that
hashing and windowing cost a few numpy passes a byte and no Python call a word. All functions are pure: tasks that
are run again after a lost executor return the same values.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Word separators of all word based contracts: space and \t \n \v \f \r.
SPACES = b" \t\n\x0b\x0c\r"

_GAMMA = 0x9E3779B97F4A7C15


def mix64(x: np.ndarray) -> np.ndarray:
    """Finalise 64-bit values (splitmix64); a bijection."""
    x = x.astype(np.uint64, copy=True)
    with np.errstate(over="ignore"):
        x ^= x >> np.uint64(30)
        x *= np.uint64(0xBF58476D1CE4E5B9)
        x ^= x >> np.uint64(27)
        x *= np.uint64(0x94D049BB133111EB)
        x ^= x >> np.uint64(31)
    return x


def seeded(n: int, seed: int) -> np.ndarray:
    """n pseudo-random 64-bit values that depend on the seed alone."""
    with np.errstate(over="ignore"):
        return mix64((np.arange(1, n + 1, dtype=np.uint64) + np.uint64(seed * 1_000_003 + 1)) * np.uint64(_GAMMA))


def odd(seed: int) -> int:
    return int(seeded(1, seed)[0]) | 1


class Powers:
    """Powers of an odd base modulo 2**64 and of its inverse, grown on demand."""

    def __init__(self, base: int):
        self.base, self.inverse = base, pow(base, -1, 1 << 64)
        self._up = self._down = np.ones(1, np.uint64)

    @staticmethod
    def _grow(have: np.ndarray, base: int, n: int) -> np.ndarray:
        with np.errstate(over="ignore"):
            while len(have) < n:
                step = np.uint64(pow(base, len(have), 1 << 64))
                have = np.concatenate([have, have * step])
        return have

    def up(self, n: int) -> np.ndarray:
        self._up = self._grow(self._up, self.base, n)
        return self._up[:n]

    def down(self, n: int) -> np.ndarray:
        self._down = self._grow(self._down, self.inverse, n)
        return self._down[:n]


_BYTES: dict[int, tuple[np.ndarray, Powers]] = {}
_ITEMS: dict[int, Powers] = {}


def byte_prefix(data: np.ndarray, seed: int) -> tuple[np.ndarray, Powers]:
    """Prefix sums from which the hash of any byte range follows; see ``range_hash``."""
    if seed not in _BYTES:
        _BYTES[seed] = (seeded(256, seed), Powers(odd(seed + 77)))
    values, powers = _BYTES[seed]
    prefix = np.zeros(len(data) + 1, np.uint64)
    with np.errstate(over="ignore"):
        np.cumsum(values[data] * powers.up(len(data)), out=prefix[1:])
    return prefix, powers


def item_prefix(items: np.ndarray, seed: int) -> tuple[np.ndarray, Powers]:
    """The same over a sequence of 64-bit items, such as word hashes."""
    if seed not in _ITEMS:
        _ITEMS[seed] = Powers(odd(seed + 555))
    powers = _ITEMS[seed]
    prefix = np.zeros(len(items) + 1, np.uint64)
    with np.errstate(over="ignore"):
        np.cumsum(items * powers.up(len(items)), out=prefix[1:])
    return prefix, powers


def range_hash(prefix: np.ndarray, powers: Powers, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        return mix64((prefix[end] - prefix[start]) * powers.down(len(prefix))[start])


def window_hash(prefix: np.ndarray, powers: Powers, width: int) -> np.ndarray:
    """Hashes of all windows of this width, by start."""
    n = len(prefix) - width
    if n <= 0:
        return np.zeros(0, np.uint64)
    with np.errstate(over="ignore"):
        return mix64((prefix[width:] - prefix[:n]) * powers.down(n))


def text_bytes(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a text column and the offsets of its rows; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_binary())
    if column.null_count:
        column = column.fill_null(b"")
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64, len(column) + 1, column.offset * 8)
    data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def pieces(batch: pa.RecordBatch, column: str = "text", limit: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """Slices of a batch with about ``limit`` bytes of text each, and one row at least."""
    if not batch.num_rows:
        return
    _, offsets = text_bytes(batch.column(column))
    at = 0
    while at < batch.num_rows:
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + limit, "right")) - 1)
        yield batch.slice(at, to - at)
        at = to


_IS_SPACE = np.zeros(256, bool)
_IS_SPACE[list(SPACES)] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def lower_ascii(data: np.ndarray) -> np.ndarray:
    """A-Z in lower case, all other bytes as they are."""
    return _LOWER[data]


def word_spans(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end of each word (a run without the six separators), and the number of its first word by row."""
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
    inside = ~_IS_SPACE[data]
    begins = inside.copy()
    begins[1:] &= ~inside[:-1]
    ends = inside.copy()
    ends[:-1] &= ~inside[1:]
    edge = offsets[(offsets > 0) & (offsets < len(data))]
    begins[edge] = inside[edge]
    ends[edge - 1] = inside[edge - 1]
    start, end = np.flatnonzero(begins), np.flatnonzero(ends) + 1
    return start, end, np.searchsorted(start, offsets)


def word_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray, seed: int) -> np.ndarray:
    if not len(start):
        return np.zeros(0, np.uint64)
    prefix, powers = byte_prefix(data, seed)
    return range_hash(prefix, powers, start, end)


def rows_of(first: np.ndarray, n: int) -> np.ndarray:
    """The row of each of n items, from the number of each row's first item."""
    return np.repeat(np.arange(len(first) - 1), np.diff(first))[:n]


def runs(flags: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and end of each run of true values."""
    padded = np.zeros(len(flags) + 2, np.int8)
    padded[1:-1] = flags
    change = np.diff(padded)
    return np.flatnonzero(change == 1), np.flatnonzero(change == -1)


def covered(starts: np.ndarray, width: int, n: int) -> np.ndarray:
    """Flags of the n positions that lie in one of the windows of this width."""
    change = np.zeros(n + 1, np.int64)
    np.add.at(change, starts, 1)
    np.add.at(change, np.minimum(starts + width, n), -1)
    return np.cumsum(change[:n]) > 0
