"""Vectorised hashing of words and character n-grams in Arrow string columns, used inside tasks."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

BASE = 0x9E3779B97F4A7C15 | 1
INVERSE = pow(BASE, -1, 1 << 64)
_pow = {"up": np.ones(1, np.uint64), "down": np.ones(1, np.uint64)}

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: Letters, digits and every byte of a character outside ASCII.
WORD = np.zeros(256, bool)
WORD[48:58] = WORD[65:91] = WORD[97:123] = WORD[128:] = True
#: All but the space and the bytes 9 to 13.
SPACED = np.ones(256, bool)
SPACED[32] = SPACED[9:14] = False


def mix(x: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit words (the finaliser of splitmix64)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_pow["up"]) < n:
        size = max(n, 1 << 20)
        for k, base in (("up", BASE), ("down", INVERSE)):
            a = np.full(size, base, np.uint64)
            a[0] = 1
            _pow[k] = np.cumprod(a, dtype=np.uint64)
    return _pow["up"][:n], _pow["down"][:n]


def bytes_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column and the offsets of its rows in them (one more than rows); null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string())
    if column.null_count:
        column = column.fill_null("")
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int64)
    raw = np.frombuffer(data, np.uint8)[at[0] : at[-1]] if data is not None and at[-1] > at[0] else np.zeros(0, np.uint8)
    return raw, at - at[0]


def slices(column: pa.Array, most: int = 2_000_000, rows: int = 1 << 30) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Runs of at most ``rows`` whole rows and about ``most`` bytes: first row, end row, bytes, offsets. A longer row comes alone."""
    raw, at = bytes_of(column)
    i, n = 0, len(at) - 1
    while i < n:
        j = max(i + 1, min(i + rows, int(np.searchsorted(at, at[i] + most, "right")) - 1))
        yield i, j, raw[at[i] : at[j]], at[i : j + 1] - at[i]
        i = j


def word_spans(raw: np.ndarray, at: np.ndarray, inside: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the longest runs of bytes of the class ``inside``; a run ends with its row."""
    w = inside[raw]
    first = w.copy()
    first[1:] &= ~w[:-1]
    edge = at[:-1][at[:-1] < len(raw)]
    first[edge] = w[edge]
    last = w.copy()
    last[:-1] &= first[1:] | ~w[1:]
    return np.flatnonzero(first), np.flatnonzero(last) + 1


def prefix_hash(raw: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    up, down = powers(len(raw) + 1)
    total = np.zeros(len(raw) + 1, np.uint64)
    np.cumsum((raw.astype(np.uint64) + np.uint64(1)) * up[: len(raw)], out=total[1:])
    return total, down


def span_hashes(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of the bytes of each span, wherever the span stands."""
    total, down = prefix_hash(raw)
    return mix((total[ends] - total[starts]) * down[starts])


def gram_hashes(raw: np.ndarray, at: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all n-byte windows and the row of each; windows do not cross rows."""
    if len(raw) < n:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    total, down = prefix_hash(raw)
    row = np.repeat(np.arange(len(at) - 1), np.diff(at))
    ok = row[: len(raw) - n + 1] == row[n - 1 :]
    h = (total[n:] - total[:-n]) * down[: len(raw) - n + 1]
    return mix(h[ok] + np.uint64(n)), row[: len(raw) - n + 1][ok]
