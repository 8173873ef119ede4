"""Periodic runs of words: maximal stretches that repeat with a period at least four times over.

Blocks of 2**k words that start at multiples of 2**k are put into an Aho-Corasick automaton over sequences of numbers and
searched across the text, each as the numbers that its halves got in the round before, so that no key is long. A run whose period is at least 2**k and less than 2**(k + 1) holds such a block together with its
copy one period later; so an occurrence at a distance in that range, the only ones looked at in round k, seeds the run. The
seed is extended in both directions as far as words one period apart agree. Extents come from prefix sums modulo a prime
by bisection, which can only be too long, and those that are long enough are then compared word by word.

Only stretches of words that occur often enough in a row to stand in a run are searched at all.
"""

from __future__ import annotations

from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from . import textbuf as tb
from .scratch import carried, narrow_batches, spread

#: A run has this many periods and this many words at least.
PERIODS, LEAST = 4, 6

#: Base of the digits in which words are given to the automaton; each place of a word has digits of its own.
DIGIT = 64

#: Rows of numbers searched at once.
ROWS = 1 << 16

_P = (1 << 31) - 1
_B = 1_000_003_321 % _P

_RUN = "struct<start:bigint,length:bigint,period:bigint>"


class _Sums:
    """Prefix sums modulo a prime: equal stretches have equal sums, unequal ones hardly ever."""

    def __init__(self, ids: np.ndarray) -> None:
        n = len(ids)
        self.power = np.ones(n + 1, np.int64)
        done = 1
        while done <= n:  # powers by doubling
            more = min(done, n + 1 - done)
            self.power[done : done + more] = self.power[:more] * (pow(_B, done, _P)) % _P
            done += more
        self.total = np.zeros(n + 1, np.int64)
        np.cumsum((ids + 1) * self.power[:n] % _P, out=self.total[1:])
        self.total %= _P
        self.n = n

    def same(self, i: np.ndarray, j: np.ndarray, size: np.ndarray) -> np.ndarray:
        """Whether the ``size`` words from i (before j) seem to be those from j."""
        a = (self.total[i + size] - self.total[i]) % _P
        b = (self.total[j + size] - self.total[j]) % _P
        return a * self.power[j - i] % _P == b

    def right(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Words from i and j on that agree."""
        low, high = np.zeros(len(i), np.int64), self.n - j
        while (low < high).any():
            middle = (low + high + 1) >> 1
            good = self.same(i, j, middle)
            low, high = np.where(good, middle, low), np.where(good, high, middle - 1)
        return low

    def left(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Words before i and j that agree."""
        low, high = np.zeros(len(i), np.int64), i.copy()
        while (low < high).any():
            middle = (low + high + 1) >> 1
            good = self.same(i - middle, j - middle, middle)
            low, high = np.where(good, middle, low), np.where(good, high, middle - 1)
        return low


def _digits(rows: np.ndarray, top: int) -> np.ndarray:
    """Each number of each row as digits; the values of one place are those of no other, so that matches start where rows do."""
    places = 1
    while DIGIT**places <= top:
        places += 1
    columns = [rows[:, c] // DIGIT**p % DIGIT + (c * places + p) * DIGIT for c in range(rows.shape[1]) for p in range(places)]
    return np.stack(columns, axis=1)


def _search(keys: np.ndarray, text: np.ndarray, top: int) -> tuple[np.ndarray, np.ndarray]:
    """(number of each key: the first one of its contents, number of the key that each row of ``text`` is, or -1)."""
    found = ahocorasick.Automaton(ahocorasick.STORE_INTS, ahocorasick.KEY_SEQUENCE)
    number = np.zeros(len(keys), np.int64)
    for k, key in enumerate(map(tuple, _digits(keys, top).tolist())):
        number[k] = known = found.get(key, k)
        if known == k:
            found.add_word(key, k)
    found.make_automaton()
    out = np.full(len(text), -1, np.int64)
    for s in range(0, len(text), ROWS):
        digits = _digits(text[s : s + ROWS], top)
        width = digits.shape[1]
        hits = np.array(list(found.iter(tuple(digits.ravel().tolist()))), np.int64).reshape(-1, 2)
        out[s + hits[:, 0] // width] = hits[:, 1]
    return number, out


def _occurrences(ids: np.ndarray, size: int, before: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(number of each aligned block of ``size`` words, number of the block that stands at each place, or -1).

    A block is sought as the pair of its halves, which are blocks of the round before and have their numbers in ``before``.
    """
    n = len(ids)
    if size == 1:
        return _search(ids[:, None], ids[:, None], int(ids.max()))
    half = size // 2
    own = np.arange(n // size) * size
    at = np.flatnonzero((before[: n - size + 1] >= 0) & (before[half : n - half + 1] >= 0))
    number, match = _search(np.stack([before[own], before[own + half]], axis=1), np.stack([before[at], before[at + half]], axis=1), n // half)
    out = np.full(n, -1, np.int64)
    out[at] = match
    return number, out


def _exact(ids: np.ndarray, seed: int, q: int) -> tuple[int, int]:
    """First and last place (excluded) around ``seed`` where words q apart agree, compared one by one."""
    end, step = seed + q, 64
    while end < len(ids):
        a = ids[end - q : min(len(ids) - q, end - q + step)]
        wrong = np.flatnonzero(a != ids[end : end + len(a)])
        if len(wrong):
            end += int(wrong[0])
            break
        end, step = end + len(a), step * 2
    start, step = seed, 64
    while start > 0:
        low = max(0, start - step)
        wrong = np.flatnonzero(ids[low:start] != ids[low + q : start + q])
        if len(wrong):
            start = low + int(wrong[-1]) + 1
            break
        start, step = low, step * 2
    return start, end


def runs_of(ids: np.ndarray, periods: int = PERIODS, least: int = LEAST) -> list[tuple[int, int, int]]:
    """(start, length, period) of every run of a sequence of numbers, by start, then period; work in proportion to n log n and the seeds."""
    if periods < 4:
        raise ValueError("blocks find runs of four periods or more")
    n = len(ids)
    if n < max(least, periods):
        return []
    _, ids = np.unique(ids, return_inverse=True)
    sums, before = _Sums(ids), np.zeros(0, np.int64)
    found: list[tuple[int, int, int]] = []
    size = 1
    while size * periods <= n:
        number, before = _occurrences(ids, size, before)
        copy = np.flatnonzero(before >= 0)
        block = copy // size - 1  # the only aligned place in reach
        seeds = block >= 0
        seeds[seeds] = number[block[seeds]] == before[copy[seeds]]
        block, copy = block[seeds] * size, copy[seeds]
        if found and len(block):  # inside a run of a smaller period, a seed's stretch repeats with that one
            known = np.array(sorted(found))
            last = np.maximum.accumulate(known[:, 0] + known[:, 1])
            nearest = np.searchsorted(known[:, 0], block, "right") - 1
            free = (nearest < 0) | (last[np.maximum(nearest, 0)] < copy + size)
            block, copy = block[free], copy[free]
        if len(block):
            left, right = sums.left(block, copy), sums.right(block, copy)
            q = copy - block
            start, length = block - left, left + right + q
            long = length >= np.maximum(least, periods * q)
            spans = np.unique(np.stack([q, start, length, block], axis=1)[long], axis=0)
            first = np.r_[True, (spans[1:, :3] != spans[:-1, :3]).any(axis=1)] if len(spans) else np.zeros(0, bool)
            made = set()
            at = np.flatnonzero(first)
            for i, j in zip(at.tolist(), [*at[1:].tolist(), len(spans)], strict=False):
                p, s, e, _ = spans[i].tolist()
                if np.array_equal(ids[s : s + e - p], ids[s + p : s + e]):
                    made.add((s, e, p))
                else:  # sums agreed by chance: these seeds need not be of one stretch
                    for seed in spans[i:j, 3].tolist():
                        s, z = _exact(ids, seed, p)
                        if z - s >= max(least, periods * p):
                            made.add((s, z - s, p))
            found += sorted(made)
        size *= 2
    return sorted(found, key=lambda r: (r[0], r[2]))


def _frequent(ids: np.ndarray, row_at: np.ndarray, periods: int, least: int) -> tuple[np.ndarray, np.ndarray]:
    """(starts, ends) of stretches within rows in which every word occurs often enough for a run; others cannot hold one.

    A word of a run stands in each of its periods, so it occurs ``periods`` times in any stretch that holds the run.
    """
    n = len(ids)
    group = np.repeat(np.arange(len(row_at) - 1), np.diff(row_at))
    live = np.arange(n)
    while len(live):
        _, which, count = np.unique(group[live] * np.int64(n + 1) + ids[live], return_inverse=True, return_counts=True)
        keep = count[which] >= periods
        rest = live[keep]
        if not len(rest):
            break
        cut = np.r_[True, (np.diff(rest) > 1) | (np.diff(group[rest]) != 0)]
        stretch = np.cumsum(cut) - 1
        long = np.bincount(stretch)[stretch] >= max(least, periods)
        if keep.all() and long.all():
            at = np.flatnonzero(cut)
            return rest[at], rest[np.r_[at[1:], len(rest)] - 1] + 1
        live, group[rest] = rest[long], stretch
    zero = np.zeros(0, np.int64)
    return zero, zero


def periodic_runs(docs: DataFrame, columns: list[str], text: str = "text", periods: int = PERIODS, least: int = LEAST) -> DataFrame:
    """``columns`` with runs (array of start, length, period, in words, by start, then period), n_words, and collapsed, the text with each run cut to its first period.

    Words are ``[^\\x20\\x09-\\x0D]+`` as they are written. A run is a stretch whose smallest period q fits ``periods`` times, of ``least`` words or
    more, that no neighbouring word extends. Null, empty and wordless texts have no runs and collapse to an empty text; repeated rows give a row
    each; columns of the three names are replaced.
    """
    narrow_batches(docs.sparkSession)
    made = ["runs", "n_words", "collapsed"]
    kept = [c for c in columns if c not in made]
    held, schema = carried(docs, kept, text)
    schema = schema(f"runs array<{_RUN}>, n_words long, collapsed string")
    fields = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b in tb.pieces(batch, "value"):
                raw, at = tb.buffers(b.column(1))
                buf, w = tb.squeezed(raw, at, tb.NOT_SPACE)
                _, ids = tb.distinct(buf, w.start, w.end)
                each: list[list[dict]] = [[] for _ in range(b.num_rows)]
                change = np.zeros(len(ids) + 1, np.int64)
                start, end = _frequent(ids, w.row_at, periods, least)
                row = np.searchsorted(w.row_at, start, "right") - 1
                for s, e, r in zip(start.tolist(), end.tolist(), row.tolist(), strict=True):
                    first = s - int(w.row_at[r])
                    for a, size, q in runs_of(ids[s:e], periods, least):
                        each[r].append({"start": first + a, "length": size, "period": q})
                        change[s + a + q] += 1
                        change[s + a + size] -= 1
                stays = np.cumsum(change[:-1]) == 0
                size = np.where(stays, w.end - w.start, 0)
                kept_at = np.r_[0, np.cumsum(stays)][w.row_at]
                words = tb.spans(buf, w.start[stays], w.end[stays])
                lists = pa.ListArray.from_arrays(pa.array(kept_at.astype(np.int32)), words)
                yield pa.record_batch([b.column(0), pa.array(each, pa.list_(fields)), pa.array(np.diff(w.row_at).astype(np.int64)), pc.binary_join(lists, " ")], names=["kept", *made])

    return spread(held.mapInArrow(tb.returning(run), schema), kept, {n: n for n in made})
