"""Whole-batch byte arithmetic shared by the text operators.

Texts arrive as Arrow string columns. Words, word hashes and window hashes are found for all texts of a
block at once with numpy over the column's own byte buffer, so no Python object is made for a word.
"""

from __future__ import annotations

import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

U = np.uint64
BLOCK = 1 << 20  # bytes of text handled at once; a longer text is a block of its own


def splitmix(x: np.ndarray) -> np.ndarray:
    """The 64-bit finaliser of SplitMix64, elementwise."""
    x = x.astype(U, copy=True)
    x ^= x >> U(30)
    x *= U(0xBF58476D1CE4E5B9)
    x ^= x >> U(27)
    x *= U(0x94D049BB133111EB)
    x ^= x >> U(31)
    return x


BYTE_VALUE = splitmix(np.arange(1, 257, dtype=U) * U(0x9E3779B97F4A7C15))
BASE = 0xD6E8FEB86659FD93
_MASK = (1 << 64) - 1
_powers: dict[str, np.ndarray] = {}


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    if "up" not in _powers or len(_powers["up"]) < n:
        size = 1 << max(16, (n - 1).bit_length())
        up = np.full(size, U(BASE))
        up[0] = 1
        down = np.full(size, U(pow(BASE, -1, 1 << 64)))
        down[0] = 1
        with np.errstate(over="ignore"):
            _powers["up"], _powers["down"] = np.cumprod(up, dtype=U), np.cumprod(down, dtype=U)
    return _powers["up"], _powers["down"]


def lower_table() -> np.ndarray:
    t = np.arange(256, dtype=np.uint8)
    t[65:91] += 32
    return t


LOWER = lower_table()


def table_of(*ranges: tuple[int, int]) -> np.ndarray:
    t = np.zeros(256, dtype=bool)
    for a, b in ranges:
        t[a : b + 1] = True
    return t


#: bytes of words: everything but white space; and digits, a-z and all non-ASCII.
SPACED = ~table_of((0x20, 0x20), (0x09, 0x0D))
ALNUM = table_of((0x30, 0x39), (0x61, 0x7A), (0x80, 0xFF))


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets (int64, from 0) of a string column; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    if len(column) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offs, data = column.buffers()
    o = np.frombuffer(offs, dtype=np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    d = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
    return d[o[0] : o[-1]], o - o[0]


def blocks(offs: np.ndarray, limit: int = BLOCK) -> Iterator[tuple[int, int]]:
    """Ranges of rows whose texts together take about ``limit`` bytes; every row is in one."""
    a, n = 0, len(offs) - 1
    while a < n:
        b = max(a + 1, int(np.searchsorted(offs, offs[a] + limit, "right")) - 1)
        b = min(b, n)
        yield a, b
        a = b


def words(data: np.ndarray, offs: np.ndarray, inside: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and row of every maximal run of ``inside`` bytes; runs end where rows end."""
    m = inside[data]
    n = len(m)
    if n == 0 or not m.any():
        z = np.zeros(0, np.int64)
        return z, z, z
    first = m.copy()
    first[1:] &= ~m[:-1]
    cut = offs[1:-1]
    cut = cut[(cut > 0) & (cut < n)]
    first[cut] = m[cut]
    last = m.copy()
    last[:-1] &= ~m[1:]
    last[cut - 1] = m[cut - 1]
    starts = np.flatnonzero(first)
    ends = np.flatnonzero(last) + 1
    return starts, ends, np.searchsorted(offs, starts, "right") - 1


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of the bytes of each word, made from running sums of BYTE_VALUE[b] * BASE**position."""
    out = np.empty(len(starts), dtype=U)
    i = 0
    with np.errstate(over="ignore"):
        while i < len(starts):
            j = max(i + 1, int(np.searchsorted(starts, starts[i] + BLOCK)))
            at, to = int(starts[i]), int(ends[j - 1])
            up, down = _power_tables(to - at + 1)
            run = np.zeros(to - at + 1, dtype=U)
            np.cumsum(BYTE_VALUE[data[at:to]] * up[: to - at], out=run[1:])
            s, e = starts[i:j] - at, ends[i:j] - at
            out[i:j] = splitmix((run[e] - run[s]) * down[s] + (e - s).astype(U))
            i = j
    return out


def window_hashes(h: np.ndarray, size: int) -> np.ndarray:
    """Hash of every ``size`` consecutive values of ``h``; the caller drops windows that cross rows."""
    n = len(h) - size + 1
    if n <= 0:
        return np.zeros(0, dtype=U)
    acc = np.full(n, U(size))
    with np.errstate(over="ignore"):
        for k in range(size):
            acc = acc * U(BASE) + h[k : k + n]
    return splitmix(acc)


def char_index(data: np.ndarray) -> np.ndarray:
    """For each byte position (and the end), how many code points start before it."""
    out = np.zeros(len(data) + 1, dtype=np.int64)
    np.cumsum((data & 0xC0) != 0x80, out=out[1:])
    return out


def release() -> None:
    """Give freed memory back to the system: a Python worker lives on for other tasks and other operators."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):
        pass  # another C library


def tidied(run):
    """A batch function whose worker gives its freed memory back after each task."""

    def outer(batches):
        yield from run(batches)
        release()

    return outer
