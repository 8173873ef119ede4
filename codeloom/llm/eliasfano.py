"""Elias-Fano sequences and a two-level n-gram trie in memory-mapped files."""

from __future__ import annotations

import os

import numpy as np


class EliasFano:
    """A non-decreasing sequence: low bits packed, high bits in unary, with a count of ones before each word of them.

    All arrays are memory-mapped from ``path``.
    """

    def __init__(self, path: str) -> None:
        head = np.fromfile(path + ".head", np.int64)
        self.n, self.low_bits = int(head[0]), int(head[1])
        self.low, self.high, self.ones = (np.load(f"{path}.{x}.npy", mmap_mode="r") for x in ("low", "high", "ones"))

    @staticmethod
    def write(path: str, values: np.ndarray) -> None:
        values = values.astype(np.uint64)
        n = len(values)
        top = int(values[-1]) if n else 0
        bits = max(0, int(np.floor(np.log2(top / n)))) if n and top > n else 0
        low = np.zeros(n * bits // 64 + 2, np.uint64)
        if bits and n:
            part = values & np.uint64((1 << bits) - 1)
            at = np.arange(n, dtype=np.uint64) * np.uint64(bits)
            word, shift = (at >> np.uint64(6)).astype(np.int64), at & np.uint64(63)
            np.bitwise_or.at(low, word, part << shift)
            over = np.flatnonzero(shift.astype(np.int64) + bits > 64)
            np.bitwise_or.at(low, word[over] + 1, part[over] >> (np.uint64(64) - shift[over]))
        place = (values >> np.uint64(bits)).astype(np.int64) + np.arange(n)
        size = (int(place[-1]) if n else 0) + 1
        flags = np.zeros(-(-size // 64) * 64 + 64, np.uint8)
        flags[place] = 1
        high = np.packbits(flags, bitorder="little").view(np.uint64)
        ones = np.r_[0, np.cumsum(np.bitwise_count(high), dtype=np.int64)].astype(np.int64)
        np.array([n, bits], np.int64).tofile(path + ".head")
        for name, x in (("low", low), ("high", high), ("ones", ones)):
            np.save(f"{path}.{name}.npy", x)

    def _low(self, i: np.ndarray) -> np.ndarray:
        if not self.low_bits:
            return np.zeros(len(i), np.uint64)
        at = i.astype(np.uint64) * np.uint64(self.low_bits)
        word, shift = (at >> np.uint64(6)).astype(np.int64), at & np.uint64(63)
        out = self.low[word] >> shift
        over = np.flatnonzero(shift.astype(np.int64) + self.low_bits > 64)
        out[over] |= self.low[word[over] + 1] << (np.uint64(64) - shift[over])
        return out & np.uint64((1 << self.low_bits) - 1)

    @staticmethod
    def _nth_one(word: np.ndarray, k: np.ndarray) -> np.ndarray:
        """Bit of the k-th one (from 0) of each word, by halving."""
        at, left, w = np.zeros(len(word), np.int64), k.astype(np.int64), word.copy()
        for half in (32, 16, 8, 4, 2, 1):
            count = np.bitwise_count(w & np.uint64((1 << half) - 1)).astype(np.int64)
            up = left >= count
            left = np.where(up, left - count, left)
            at += np.where(up, half, 0)
            w = np.where(up, w >> np.uint64(half), w)
        return at

    def __getitem__(self, i: np.ndarray) -> np.ndarray:
        """Values at places ``i``."""
        word = np.searchsorted(self.ones, i, "right") - 1
        bit = self._nth_one(self.high[word], i - self.ones[word])
        high = (word * 64 + bit - i).astype(np.uint64)
        return (high << np.uint64(self.low_bits)) | self._low(i)

    def successor(self, v: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Place of the first value >= v in [begin, end) of each query, ``end`` if there is none."""
        v = v.astype(np.uint64)
        lo, hi = begin.astype(np.int64).copy(), end.astype(np.int64).copy()
        live = np.flatnonzero(lo < hi)
        while len(live):
            mid = (lo[live] + hi[live]) >> 1
            less = self[mid] < v[live]
            lo[live] = np.where(less, mid + 1, lo[live])
            hi[live] = np.where(less, hi[live], mid)
            live = live[lo[live] < hi[live]]
        return lo


class Trie:
    """Words over their successors. Level one: context keys and the pointers to their successors; level two: successor ids.

    The ids of a context's successors are stored relative to the context: rank of the context times the number of ids, plus
    the id, which makes the whole level one non-decreasing sequence. Levels are files that queries read through the page cache.
    """

    def __init__(self, folder: str) -> None:
        self.contexts = np.load(f"{folder}/contexts.npy", mmap_mode="r")
        self.words = np.load(f"{folder}/words.npy", mmap_mode="r")
        self.values = np.load(f"{folder}/values.npy", mmap_mode="r")
        self.pointers = EliasFano(f"{folder}/pointers")
        self.successors = EliasFano(f"{folder}/successors")

    @staticmethod
    def write(folder: str, contexts: np.ndarray, counts: np.ndarray, words: np.ndarray, values: np.ndarray) -> Trie:
        """``contexts``: sorted keys; ``counts``: successors of each; ``words``: their keys, sorted within a context."""
        os.makedirs(folder, exist_ok=True)
        known, ids = np.unique(words, return_inverse=True)
        rank = np.repeat(np.arange(len(contexts), dtype=np.uint64), counts)
        np.save(f"{folder}/contexts.npy", contexts)
        np.save(f"{folder}/words.npy", known)
        np.save(f"{folder}/values.npy", values)
        EliasFano.write(f"{folder}/pointers", np.r_[0, np.cumsum(counts)])
        EliasFano.write(f"{folder}/successors", rank * np.uint64(max(len(known), 1)) + ids.astype(np.uint64))
        return Trie(folder)

    def context_ranks(self, keys: np.ndarray) -> np.ndarray:
        """Rank of each context, -1 if unknown."""
        at = np.minimum(np.searchsorted(self.contexts, keys), max(len(self.contexts) - 1, 0))
        return np.where(self.contexts[at] == keys, at, -1) if len(self.contexts) else np.full(len(keys), -1)

    def find(self, ranks: np.ndarray, words: np.ndarray, block: int = 1 << 18) -> np.ndarray:
        """Values of (context rank, word key) pairs, 0 where there is no such successor."""
        out = np.zeros(len(ranks), self.values.dtype)
        if not len(self.words) or not len(self.contexts):
            return out
        for s in range(0, len(ranks), block):
            r, w = ranks[s : s + block], words[s : s + block]
            id_ = np.minimum(np.searchsorted(self.words, w), len(self.words) - 1)
            ok = np.flatnonzero((r >= 0) & (self.words[id_] == w))
            begin, end = self.pointers[r[ok]].astype(np.int64), self.pointers[r[ok] + 1].astype(np.int64)
            want = r[ok].astype(np.uint64) * np.uint64(len(self.words)) + id_[ok].astype(np.uint64)
            at = self.successors.successor(want, begin, end)
            hit = np.flatnonzero(at < end)
            hit = hit[self.successors[at[hit]] == want[hit]]
            out[s + ok[hit]] = self.values[at[hit]]
        return out
