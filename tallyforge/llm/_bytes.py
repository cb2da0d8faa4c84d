"""Words and their hashes over whole Arrow batches, in numpy.

A word is ``[^\\x20\\x09-\\x0D]+`` of the UTF-8 bytes. Everything here works on
chunks of a few megabytes, so memory follows the longest text and not the batch.
"""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

CHUNK = 1 << 21
SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

U = np.uint64
_rng = np.random.Generator(np.random.PCG64(20240229))
BYTE = _rng.integers(1, 1 << 63, 256, dtype=np.uint64) * U(2) + U(1)
STEP = {"byte": 0x9E3779B97F4A7C15, "a": 0xD1342543DE82EF95, "b": 0xAF251AF3B0F025B5}
_powers: dict[str, tuple[np.ndarray, np.ndarray]] = {}


def powers(kind: str, n: int) -> tuple[np.ndarray, np.ndarray]:
    """``p**i`` and ``p**-i`` modulo 2**64 for i < n."""
    got = _powers.get(kind)
    if got is None or len(got[0]) < n:
        size = -(-n // 65536) * 65536
        out = []
        for base in (STEP[kind], pow(STEP[kind], -1, 1 << 64)):
            a = np.full(size, base, U)
            a[0] = 1
            out.append(np.cumprod(a, dtype=U))
        got = (out[0], out[1])
        if size <= 4 * CHUNK:
            _powers[kind] = got
    return got


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection that spreads the bits of each value."""
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def spans_hash(values: np.ndarray, starts: np.ndarray, ends: np.ndarray, kind: str) -> np.ndarray:
    """A 64-bit hash of ``values[start:end]`` for each pair, by prefix sums."""
    up, down = powers(kind, len(values) + 1)
    total = np.zeros(len(values) + 1, U)
    np.cumsum(values * up[: len(values)], out=total[1:])
    return mix((total[ends] - total[starts]) * down[starts] + (ends - starts).astype(U))


_caches: dict[str, Callable[[], None]] = {"": _powers.clear}
_owner = ""
try:
    _trim = ctypes.CDLL(None).malloc_trim
except (AttributeError, OSError):  # not every C library has it
    _trim = None


def cached_by(owner: str, forget: Callable[[], None]) -> None:
    """Workers are used again: what an operator remembers goes once another one runs."""
    _caches[owner] = forget


def release() -> None:
    """Give freed memory back, which a waiting worker would keep."""
    pa.default_memory_pool().release_unused()
    if _trim:
        _trim(0)


def taken_over(owner: str) -> None:
    global _owner
    if owner != _owner:
        for name, forget in _caches.items():
            if name != owner:
                forget()
        _owner = owner


def text_chunks(batch: pa.RecordBatch, column: str, limit: int = CHUNK, owner: str = "") -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, row after the last, bytes, offsets) of runs of rows; null is empty."""
    taken_over(owner)
    yield from _chunks(batch, column, limit)
    release()


def _chunks(batch: pa.RecordBatch, column: str, limit: int) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    texts = pc.fill_null(batch.column(column).cast(pa.large_string()), "")
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    n = len(texts)
    if not n:
        return
    offsets = np.frombuffer(texts.buffers()[1], np.int64, n + 1, texts.offset * 8)
    data = texts.buffers()[2]
    whole = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    lo = 0
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + limit, "right")) - 1)
        hi = min(hi, n)
        yield lo, hi, whole[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo]
        lo = hi


def words(buf: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Byte starts and ends of all words, and each row's first word (rows + 1 entries)."""
    n = len(buf)
    if not n:
        empty = np.zeros(0, np.int64)
        return empty, empty, np.zeros(len(offsets), np.int64)
    inside = ~SPACE[buf]
    edge = np.empty(n, bool)
    edge[0] = True
    np.logical_not(inside[:-1], out=edge[1:])
    edge[offsets[:-1][offsets[:-1] < n]] = True
    starts = np.flatnonzero(inside & edge)
    edge[-1] = True
    np.logical_not(inside[1:], out=edge[:-1])
    edge[offsets[1:][offsets[1:] > 0] - 1] = True
    ends = np.flatnonzero(inside & edge) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def word_hashes(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    return spans_hash(BYTE[buf], starts, ends, "byte")


def gram_rows(first: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Start word of every run of k words inside a row, and each row's first such run."""
    count = np.maximum(np.diff(first) - k + 1, 0)
    begin = np.zeros(len(first), np.int64)
    np.cumsum(count, out=begin[1:])
    starts = np.arange(begin[-1]) + np.repeat(first[:-1] - begin[:-1], count)
    return starts, begin
