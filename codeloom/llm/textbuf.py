"""Vectorised text primitives over Arrow string buffers.

Everything works on the UTF-8 bytes of many rows at once; no Python string is made per row or word.
A null text is an empty one.
"""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import wraps

import numpy as np
import pyarrow as pa

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32

#: Bytes of ``[^\x20\x09-\x0D]``.
NOT_SPACE = np.ones(256, dtype=bool)
NOT_SPACE[[9, 10, 11, 12, 13, 32]] = False

#: Bytes of ``[^\x00-\x2F\x3A-\x60\x7B-\x7F]`` in UTF-8: digits, a-z and all of non-ASCII.
WORDLIKE = np.zeros(256, dtype=bool)
WORDLIKE[48:58] = True
WORDLIKE[97:123] = True
WORDLIKE[128:] = True


def give_back() -> None:
    """Returns freed memory to the system: a Python worker outlives its task, and must not keep what each task needed at most."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # no such call in this C library
        pass


def returning(run: Callable) -> Callable:
    """``run`` over Arrow batches or tables, giving memory back when its task ends."""

    @wraps(run)
    def wrapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            give_back()

    return wrapped


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, row offsets) of a string column; the offsets start at 0."""
    column = column.cast(pa.large_string()).fill_null("")
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    _, offsets, data = column.buffers()
    n = len(column)
    at = np.frombuffer(offsets, np.int64, n + 1, column.offset * 8) if n else np.zeros(1, np.int64)
    raw = np.frombuffer(data, np.uint8)[at[0] : at[-1]] if data is not None and len(data) else np.zeros(0, np.uint8)
    return raw, at - at[0]


def pieces(batch: pa.RecordBatch, text: str, max_bytes: int = 1 << 20) -> Iterator[pa.RecordBatch]:
    """Runs of whole rows of at most ``max_bytes`` of text, or of one longer row."""
    n = batch.num_rows
    if not n:
        return
    _, at = buffers(batch.column(text))
    start = 0
    while start < n:
        end = int(np.searchsorted(at, at[start] + max_bytes, "right")) - 1
        end = min(n, max(start + 1, end))
        yield batch.slice(start, end - start)
        start = end


def lower(raw: np.ndarray) -> np.ndarray:
    """A-Z to a-z, nothing else."""
    return _LOWER[raw]


@dataclass
class Words:
    """Word ``i`` is ``raw[start[i]:end[i]]``; row ``r`` has the words ``row_at[r]`` to ``row_at[r + 1]``."""

    start: np.ndarray
    end: np.ndarray
    row_at: np.ndarray


def words(raw: np.ndarray, at: np.ndarray, wordlike: np.ndarray) -> Words:
    """Maximal runs of ``wordlike`` bytes that do not cross rows."""
    inside = wordlike[raw]
    n = len(raw)
    if not n:
        zero = np.zeros(0, np.int64)
        return Words(zero, zero, np.zeros(len(at), np.int64))
    opens, closes = inside.copy(), inside.copy()
    opens[1:] &= ~inside[:-1]
    closes[:-1] &= ~inside[1:]
    first, last = at[:-1][at[:-1] < at[1:]], at[1:][at[:-1] < at[1:]] - 1
    opens[first] = inside[first]
    closes[last] = inside[last]
    start, end = np.flatnonzero(opens), np.flatnonzero(closes) + 1
    return Words(start, end, np.searchsorted(start, at))


_RNG = np.random.Generator(np.random.PCG64(20240607))
_BYTE = _RNG.integers(1, 2**64, 256, dtype=np.uint64) | np.uint64(1)
_R = np.uint64(0x9E3779B97F4A7C15)


def _inverse(odd: int) -> int:
    return pow(odd, -1, 1 << 64)


_R_INV = np.uint64(_inverse(int(_R)))


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


#: Bytes hashed at once; no table grows beyond twice this.
_SPAN = 1 << 19


def _powers(base: np.uint64) -> np.ndarray:
    x = np.full(2 * _SPAN + 1, base, np.uint64)
    x[0] = 1
    return np.multiply.accumulate(x)


_UP, _DOWN = _powers(_R), _powers(_R_INV)


def _near(raw: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Polynomials of spans of a buffer of at most twice ``_SPAN`` bytes."""
    total = np.zeros(len(raw) + 1, np.uint64)
    np.cumsum(_BYTE[raw] * _UP[: len(raw)], out=total[1:])
    return (total[end] - total[start]) * _DOWN[start]


def _far(raw: np.ndarray) -> int:
    """Polynomial of one long span, block by block."""
    out, power, step = 0, 1, pow(int(_R), _SPAN, 1 << 64)
    for s in range(0, len(raw), _SPAN):
        part = raw[s : s + _SPAN]
        out += power * int((_BYTE[part] * _UP[: len(part)]).sum(dtype=np.uint64))
        power = power * step % (1 << 64)
    return out % (1 << 64)


def hashes(raw: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each span, equal for equal bytes wherever they stand.

    A polynomial over random byte values modulo 2**64, taken from prefix sums and brought to position zero with the
    inverse of the base, then mixed with the length.
    """
    out = np.zeros(len(start), np.uint64)
    if len(raw) <= 2 * _SPAN:
        if len(start):
            out = _near(raw, start, end)
    else:
        long = end - start > _SPAN
        for i in np.flatnonzero(long):
            out[i] = _far(raw[start[i] : end[i]])
        rest = np.flatnonzero(~long)
        rest = rest[np.argsort(start[rest], kind="stable")]
        cuts = np.searchsorted(start[rest], np.arange(0, len(raw) + _SPAN, _SPAN))
        for a, b, base in zip(cuts, cuts[1:], range(0, len(raw), _SPAN), strict=False):
            if a < b:
                own = rest[a:b]
                out[own] = _near(raw[base : base + 2 * _SPAN], start[own] - base, end[own] - base)
    return mix(out + (end - start).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))


class Hasher:
    """``hashes`` of many sets of spans of one buffer; what they share is worked out once."""

    def __init__(self, raw: np.ndarray) -> None:
        self.raw, self.total = raw, None
        if len(raw) <= 2 * _SPAN:
            self.total = np.zeros(len(raw) + 1, np.uint64)
            np.cumsum(_BYTE[raw] * _UP[: len(raw)], out=self.total[1:])

    def __call__(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        if self.total is None:
            return hashes(self.raw, start, end)
        return mix((self.total[end] - self.total[start]) * _DOWN[start] + (end - start).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))


def _equal(raw: np.ndarray, a: np.ndarray, b: np.ndarray, size: np.ndarray, block: int = 1 << 19) -> np.ndarray:
    """Whether the ``size`` bytes from each ``a`` are those from ``b``."""
    out = np.ones(len(a), bool)
    done = np.r_[0, np.cumsum(size)]
    i = 0
    while i < len(a):
        j = max(i + 1, int(np.searchsorted(done, done[i] + block, "right")) - 1)
        if j == i + 1:
            out[i] = np.array_equal(raw[a[i] : a[i] + size[i]], raw[b[i] : b[i] + size[i]])
        else:
            n = size[i:j]
            inner = np.arange(done[j] - done[i]) - np.repeat(done[i:j] - done[i], n)
            differs = raw[np.repeat(a[i:j], n) + inner] != raw[np.repeat(b[i:j], n) + inner]
            wrong = np.r_[0, np.cumsum(differs)]
            out[i:j] = wrong[done[i + 1 : j + 1] - done[i]] == wrong[done[i:j] - done[i]]
        i = j
    return out


def distinct(raw: np.ndarray, start: np.ndarray, end: np.ndarray, h: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(a place of each distinct span, each span's place among these); spans are compared byte by byte, not by hash alone."""
    _, first, which = np.unique(hashes(raw, start, end) if h is None else h, return_index=True, return_inverse=True)
    size = end - start
    other = np.flatnonzero(first[which] != np.arange(len(start)))
    one = first[which[other]]
    same = size[one] == size[other]
    same[same] = _equal(raw, start[other[same]], start[one[same]], size[other[same]])
    if same.all():
        return first, which
    more: dict[bytes, int] = {}
    extra = []
    for i in other[~same]:
        key = raw[start[i] : end[i]].tobytes()
        if key not in more:
            more[key] = len(first) + len(extra)
            extra.append(i)
        which[i] = more[key]
    return np.r_[first, np.array(extra, first.dtype)], which


def hash_word(word: bytes) -> int:
    raw = np.frombuffer(word, np.uint8)
    return int(hashes(raw, np.array([0]), np.array([len(raw)]))[0])


_P1, _P2, _P3, _P4, _P5 = (np.uint64(int(p)) for p in (11400714785074694791, 14029467366897019727, 1609587929392839161, 9650029242287828579, 2870177450012600261))


def _rot(x: np.ndarray, k: int) -> np.ndarray:
    return (x << np.uint64(k)) | (x >> np.uint64(64 - k))


def _round(acc, lane):
    return _rot(acc + lane * _P2, 31) * _P1


def xxh64(raw: np.ndarray, start: np.ndarray, end: np.ndarray, seed: int = 42) -> np.ndarray:
    """XXH64 of each span, vectorised over spans. Same numbers as the published algorithm."""
    out = np.zeros(len(start), np.uint64)
    if not len(start):
        return out
    padded = np.concatenate([raw, np.zeros(8, np.uint8)])
    # one unaligned little-endian load at any position
    load8 = np.ndarray((len(padded) - 7,), np.dtype("<u8"), buffer=padded.data, strides=(1,))
    load4 = np.ndarray((len(padded) - 7,), np.dtype("<u4"), buffer=padded.data, strides=(1,))
    length = end - start
    seed64 = np.uint64(seed)
    with np.errstate(over="ignore"):
        stripes = length >> 5
        h = np.full(len(start), seed64 + _P5, np.uint64)
        at = start.copy()
        if (long := np.flatnonzero(stripes)).size:
            n, p = stripes[long], start[long].copy()
            acc = [np.full(len(long), v, np.uint64) for v in (seed64 + _P1 + _P2, seed64 + _P2, seed64, seed64 - _P1)]
            for k in range(int(n.max())):
                live = slice(None) if k < n.min() else np.flatnonzero(n > k)
                q = p[live] + 32 * k
                for j in range(4):
                    acc[j][live] = _round(acc[j][live], load8[q + 8 * j])
            g = _rot(acc[0], 1) + _rot(acc[1], 7) + _rot(acc[2], 12) + _rot(acc[3], 18)
            for j in range(4):
                g = (g ^ _round(np.uint64(0), acc[j])) * _P1 + _P4
            h[long] = g
            at[long] = p + 32 * n
        h += length.astype(np.uint64)
        rest = end - at
        for k in range(3):
            some = rest >= 8 * (k + 1)
            if not some.any():
                break
            live = np.flatnonzero(some)
            h[live] = _rot(h[live] ^ _round(np.uint64(0), load8[at[live] + 8 * k]), 27) * _P1 + _P4
        at = at + (rest & ~7)
        rest = rest & 7
        live = np.flatnonzero(rest >= 4)
        h[live] = _rot(h[live] ^ (load4[at[live]].astype(np.uint64) * _P1), 23) * _P2 + _P3
        at[live] += 4
        rest = rest & 3
        for k in range(3):
            live = np.flatnonzero(rest > k)
            h[live] = _rot(h[live] ^ (padded[at[live] + k].astype(np.uint64) * _P5), 11) * _P1
        h ^= h >> np.uint64(33)
        h *= _P2
        h ^= h >> np.uint64(29)
        h *= _P3
        h ^= h >> np.uint64(32)
    return h


def squeezed(raw: np.ndarray, at: np.ndarray, wordlike: np.ndarray, w: Words | None = None) -> tuple[np.ndarray, Words]:
    """The words of each row (``w``, where they are known) joined by single spaces, each row closed by one, and their places in that buffer."""
    w = w or words(raw, at, wordlike)
    size = w.end - w.start
    out_end = np.cumsum(size + 1)
    out_start = out_end - size - 1
    out = np.full(int(out_end[-1]) if len(size) else 0, 32, np.uint8)
    inside = wordlike[raw]
    where = np.ones(len(out), bool)
    where[out_end - 1] = False
    out[where] = raw[inside]
    return out, Words(out_start, out_end - 1, w.row_at)


def spans(raw: np.ndarray, start: np.ndarray, end: np.ndarray) -> pa.Array:
    """The bytes of each span as a string."""
    size = end - start
    at = np.r_[0, np.cumsum(size)].astype(np.int64)
    data = raw[np.repeat(start - at[:-1], size) + np.arange(at[-1])]
    return pa.Array.from_buffers(pa.large_string(), len(size), [None, pa.py_buffer(at.tobytes()), pa.py_buffer(data.tobytes())]).cast(pa.string())


def row_sums(values: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Sums of ``values`` over the rows that ``at`` delimits, empty rows too."""
    total = np.zeros(len(values) + 1, np.float64 if values.dtype.kind == "f" else np.int64)
    np.cumsum(values, out=total[1:])
    return total[at[1:]] - total[at[:-1]]
