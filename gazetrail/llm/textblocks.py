"""Arrow text columns as blocks of UTF-8 bytes, for numpy."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa


def lean(run: Callable) -> Callable:
    """`run` for mapInArrow, which gives memory back to the system at its end: Python workers live on, and those of
    other plans need it."""

    def wrapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            pa.default_memory_pool().release_unused()
            if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):
                trim(0)

    return wrapped


def blocks(texts: pa.Array, most: int = 1 << 19) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, row after the last, bytes of these rows, their offsets from 0), about `most` bytes
    at a time and one row at least; a null is an empty text."""
    n = len(texts)
    if not n:
        return
    large = pa.types.is_large_string(texts.type)
    if texts.null_count:
        texts = texts.fill_null("")
    _, off, data = texts.buffers()
    off = np.frombuffer(off, np.int64 if large else np.int32)[texts.offset : texts.offset + n + 1].astype(np.int64)
    data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    a = 0
    while a < n:
        b = max(a + 1, int(np.searchsorted(off, off[a] + most, "right")) - 1)
        b = min(b, n)
        yield a, b, data[off[a] : off[b]], off[a : b + 1] - off[a]
        a = b


_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def lower(data: np.ndarray) -> np.ndarray:
    """UTF-8 bytes in lower case: A-Z, and the Latin-1 capitals (À to Þ but for the multiplication sign)."""
    out = _LOWER[data]
    if len(data) > 1:
        two = np.flatnonzero(data[:-1] == 0xC3) + 1
        two = two[(data[two] >= 0x80) & (data[two] <= 0x9E) & (data[two] != 0x97)]
        out[two] += 32
    return out


_WORD = np.zeros(256, bool)
_WORD[48:58] = _WORD[97:123] = _WORD[128:] = True


def words(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, row) of each run of 0-9, a-z and bytes of other scripts in lower-cased texts."""
    inside = _WORD[data]
    before = np.zeros(len(data), bool)
    before[1:] = inside[:-1]
    before[off[:-1][off[:-1] < len(data)]] = False
    start = np.flatnonzero(inside & ~before)
    after = np.zeros(len(data), bool)
    after[:-1] = inside[1:]
    last = off[1:] - 1
    after[last[last >= 0]] = False
    end = np.flatnonzero(inside & ~after) + 1
    return start, end, np.searchsorted(off, start, "right") - 1


LONG = 1 << 20  # bytes of a text that is worked on as a whole


def cut_words(data: np.ndarray, most: int = LONG) -> Iterator[np.ndarray]:
    """A text of lower-cased bytes in parts of about `most` bytes, cut where no word is."""
    a, n = 0, len(data)
    while a < n:
        b = a + most
        while b < n and _WORD[data[b]]:  # a word goes on: look further, block by block
            gap = np.flatnonzero(~_WORD[data[b : b + most]])
            b += int(gap[0]) if len(gap) else most
        b = min(b, n)
        yield data[a:b]
        a = b


_P = 0x9E3779B97F4A7C15 | 1
_PINV = pow(_P, -1, 1 << 64)
_MIX = np.uint64(0xBF58476D1CE4E5B9)


def _powers(base: int, n: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        return np.multiply.accumulate(np.concatenate([np.ones(1, np.uint64), np.full(n, base, np.uint64)]))


_TABLES: dict[int, np.ndarray] = {}


def _sums(data: np.ndarray, at: np.ndarray, base: int) -> np.ndarray:
    """The sum of (byte + 1) * P ** place over the bytes before each place of `at`, `base` bytes further on."""
    out, total, n = np.zeros(len(at), np.uint64), np.uint64(0), len(data)
    for a in range(0, n, base):
        b = min(a + base, n)
        step = np.uint64(pow(_P, a, 1 << 64))
        run = np.cumsum((data[a:b].astype(np.uint64) + np.uint64(1)) * _TABLES[_P][: b - a]) * step + total
        here = np.flatnonzero((at > a) & (at <= b)) if n > base else slice(None)
        out[here] = np.concatenate([[total], run])[at[here] - a]
        total = run[-1]
    return out


def hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A 64-bit polynomial hash of each range of bytes, its length mixed in; long data are summed by parts."""
    base = min(LONG, 1 << max(1, len(data)).bit_length())
    for p in (_P, _PINV):
        if p not in _TABLES or len(_TABLES[p]) <= base:
            _TABLES[p] = _powers(p, base)
    with np.errstate(over="ignore"):
        back = _TABLES[_PINV][start % base]
        if len(data) > base:
            far = start // base
            back = back * _powers(pow(_PINV, base, 1 << 64), int(far.max(initial=0)))[far]
        h = (_sums(data, end, base) - _sums(data, start, base)) * back + (end - start).astype(np.uint64) * _MIX
        h ^= h >> np.uint64(29)
        h *= _MIX
        return h ^ (h >> np.uint64(32))
