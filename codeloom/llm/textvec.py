"""Numpy helpers over whole Arrow batches of text: words, hashes, sliding minima.

Everything works on one flat array per batch, never on one Python object per word.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

U64 = np.uint64
_MULT = U64(0x9E3779B97F4A7C15)
_MIX_A, _MIX_B = U64(0xBF58476D1CE4E5B9), U64(0x94D049BB133111EB)
_BASE = 0x5851F42D4C957F2D  # odd, so it has an inverse modulo 2**64
_BASE_INV = pow(_BASE, -1, 1 << 64)
#: Characters that are worked on at once; bounds the memory of a task, never the result.
CHUNK = 1 << 20


def mixed(x: np.ndarray) -> np.ndarray:
    """Finalise 64-bit values so that every output bit depends on every input bit."""
    x = (x ^ (x >> U64(30))) * _MIX_A
    x = (x ^ (x >> U64(27))) * _MIX_B
    return x ^ (x >> U64(31))


def seeds(n: int, salt: int) -> np.ndarray:
    return mixed((np.arange(1, n + 1, dtype=U64) + U64(salt << 20)) * _MULT)


_POWERS: dict[str, np.ndarray] = {"up": np.ones(1, U64), "down": np.ones(1, U64)}


def _powers(kind: str, n: int) -> np.ndarray:
    if len(_POWERS[kind]) < n:
        size = max(n, CHUNK + (CHUNK >> 2))
        steps = np.full(size, _BASE if kind == "up" else _BASE_INV, U64)
        steps[0] = 1
        _POWERS[kind] = np.cumprod(steps, dtype=U64)
    return _POWERS[kind][:n]


def prefix_hashes(values: np.ndarray) -> np.ndarray:
    """P with P[j] - P[i] = sum of values[k] * base**k for i <= k < j; len(P) = len(values) + 1."""
    out = np.zeros(len(values) + 1, U64)
    np.cumsum(values * _powers("up", len(values)), out=out[1:])
    return out


def span_hashes(prefix: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A hash of values[start:end] for each span, equal for equal content at any place."""
    return mixed((prefix[ends] - prefix[starts]) * _powers("down", len(prefix))[starts] + (ends - starts).astype(U64))


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column; nulls are empty texts."""
    if column.null_count:
        column = column.fill_null("")
    wide = pa.types.is_large_string(column.type)
    _, at, data = column.buffers()
    offsets = np.frombuffer(at, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data is not None and len(column) else np.zeros(0, np.uint8)
    return raw, offsets - offsets[0]


def chunks(offsets: np.ndarray) -> Iterator[tuple[int, int]]:
    """Row ranges of about CHUNK characters; a longer text is a range of its own."""
    low, n = 0, len(offsets) - 1
    while low < n:
        high = int(np.searchsorted(offsets, offsets[low] + CHUNK, side="right")) - 1
        high = min(max(high, low + 1), n)
        yield low, high
        low = high


_WORD_BYTE = np.zeros(256, bool)
_WORD_BYTE[[*range(48, 58), *range(65, 91), 95, *range(97, 123)]] = True
_BYTE_VALUE = mixed(np.arange(1, 257, dtype=U64) * _MULT)


def ascii_words(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hash, row) of every maximal run of ASCII letters, digits and `_`, in order."""
    if not len(raw):
        return np.zeros(0, U64), np.zeros(0, np.int64)
    inside = _WORD_BYTE[raw]
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    last = inside.copy()
    last[:-1] &= ~inside[1:]
    edge = offsets[1:-1][(offsets[1:-1] > 0) & (offsets[1:-1] < len(raw))]
    first[edge] = inside[edge]
    last[edge - 1] = inside[edge - 1]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    hashes = span_hashes(prefix_hashes(_BYTE_VALUE[raw]), starts, ends)
    return hashes, np.searchsorted(offsets, starts, side="right") - 1


def shingles(words: np.ndarray, rows: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(hash, row) of every run of k consecutive words of one row, repeats included."""
    n = len(words) - k + 1
    if n <= 0:
        return np.zeros(0, U64), np.zeros(0, np.int64)
    total = np.zeros(n, U64)
    for i, c in enumerate(seeds(k, 7)):
        total += words[i : i + n] * (c | U64(1))
    whole = rows[:n] == rows[k - 1 :]
    return mixed(total[whole]), rows[:n][whole]


def row_starts(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row number, first index) of every run of equal values in sorted `rows`."""
    if not len(rows):
        return rows, np.zeros(0, np.int64)
    at = np.flatnonzero(np.concatenate(([True], rows[1:] != rows[:-1])))
    return rows[at], at


def sliding_minimum(values: np.ndarray, width: int) -> np.ndarray:
    """Minimum of every `width` neighbours, by doubling."""
    have, low = 1, values
    while have * 2 <= width:
        low = np.minimum(low[: len(low) - have], low[have:])
        have *= 2
    rest = width - have
    return np.minimum(low[: len(low) - rest], low[rest:]) if rest else low
