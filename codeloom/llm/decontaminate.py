"""Benchmark decontamination over a positional inverted index of the training text.

The index is partitioned by documents: a segment is a run of whole documents with, for each of its words, the sorted places
where it stands. Segments are stored as a table. A phrase is looked up in a segment by intersecting the offset-adjusted lists
of its words, rarest first; no posting leaves its segment, so a word of any frequency costs no shuffle. Words are found by
hash and compared letter by letter. Phrases come from a written table, in parts of bounded size, each of which is looked up
in all segments.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textbuf as tb
from .scratch import narrow_batches, written

INDEX_SCHEMA = "segment string, doc_ids array<long>, row_at binary, words binary, word_at binary, term_at binary, gaps binary"
FOUND_SCHEMA = "segment string, doc_no int, doc_id long, n_words long, hits array<int>, items array<string>, near_items array<string>"


def windows_of(items: DataFrame, item_id: str, text: str, size: int) -> DataFrame:
    """Distinct (win, item): each ``size`` consecutive words of an item, joined by blanks; an item of fewer words, but not none, is one window."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b in tb.pieces(batch, "t"):
                out, w = tb.squeezed(tb.lower(tb.buffers(b.column("t"))[0]), tb.buffers(b.column("t"))[1], tb.WORDLIKE)
                data = out.tobytes()
                for i, name in enumerate(b.column("item").to_pylist()):
                    first, end = int(w.row_at[i]), int(w.row_at[i + 1])
                    n = min(size, end - first)
                    starts = range(first, end - n + 1) if n else ()
                    for s in range(0, len(starts), 8192):
                        own = [data[w.start[k] : w.end[k + n - 1]].decode("utf-8", "replace") for k in starts[s : s + 8192]]
                        yield pa.record_batch([pa.array(own, pa.string()), pa.array([name] * len(own), pa.string())], names=["win", "item"])

    known = items.select(F.col(item_id).cast("string").alias("item"), F.col(text).alias("t")).where("item is not null and t is not null")
    return known.mapInArrow(tb.returning(run), "win string, item string").distinct()


@dataclass
class Part:
    """Some windows as flat arrays: their words, for each window the places of its words among these, and the items that have it."""

    words: np.ndarray
    word_at: np.ndarray
    padded: np.ndarray
    size: np.ndarray
    owners: np.ndarray
    owner_at: np.ndarray
    items: list[str]

    @staticmethod
    def of(rows: list[tuple[str, str]]) -> Part:
        rows = sorted(rows)
        wins = pa.array([r[0] for r in rows], pa.string())
        new = np.array([i for i, r in enumerate(rows) if not i or r[0] != rows[i - 1][0]], np.int64)
        raw, at = tb.buffers(wins.take(pa.array(new)))
        w = tb.words(raw, at, tb.WORDLIKE)
        first, which = tb.distinct(raw, w.start, w.end)
        size = np.diff(w.row_at)
        padded = np.full((len(new), max(int(size.max(initial=0)), 1)), -1, np.int32)
        padded[np.repeat(np.arange(len(new)), size), np.arange(len(which)) - np.repeat(w.row_at[:-1], size)] = which
        length = w.end[first] - w.start[first]
        word_at = np.r_[0, np.cumsum(length)].astype(np.int64)
        words = raw[np.repeat(w.start[first] - word_at[:-1], length) + np.arange(word_at[-1])]
        items = sorted({r[1] for r in rows})
        place = {x: i for i, x in enumerate(items)}
        return Part(words, word_at, padded, size.astype(np.int32), np.array([place[r[1]] for r in rows], np.int32), np.r_[new, len(rows)].astype(np.int64), items)


def parts_of(windows: DataFrame, most: int) -> Iterator[Part]:
    """The windows in parts of at most ``most`` rows, read one after another; one part at least."""
    held: list[tuple[str, str]] = []
    any_ = False
    for r in windows.toLocalIterator():
        held.append((r.win, r.item))
        if len(held) == most:
            yield Part.of(held)
            held, any_ = [], True
    if held or not any_:
        yield Part.of(held)


def build_index(docs: DataFrame, text: str = "text", segment_bytes: int = 2 << 20) -> DataFrame:
    """Segments of postings of ``docs``: every word of every whole document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        task, serial = TaskContext.get().partitionId(), 0
        for batch in batches:
            for b in tb.pieces(batch, "t", segment_bytes):
                raw, at = tb.buffers(b.column("t"))
                raw = tb.lower(raw)
                w = tb.words(raw, at, tb.WORDLIKE)
                first, rank = tb.distinct(raw, w.start, w.end)
                place = np.argsort(rank, kind="stable")
                term_at = np.r_[0, np.cumsum(np.bincount(rank, minlength=len(first)))].astype(np.int32)
                gaps = np.diff(place, prepend=0).astype(np.int32)
                size = w.end[first] - w.start[first]
                word_at = np.r_[0, np.cumsum(size)].astype(np.int32)
                words = raw[np.repeat(w.start[first] - word_at[:-1], size) + np.arange(word_at[-1])]
                arrays = (w.row_at.astype(np.int64), words, word_at, term_at, gaps)
                doc_ids = pa.ListArray.from_arrays(pa.array([0, b.num_rows], pa.int32()), b.column("doc_id").cast(pa.int64()))
                yield pa.record_batch([pa.array([f"{task}-{serial}"]), doc_ids, *(pa.array([x.tobytes()], pa.binary()) for x in arrays)], names=["segment", "doc_ids", "row_at", "words", "word_at", "term_at", "gaps"])
                serial += 1

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(text).alias("t")).mapInArrow(tb.returning(run), INDEX_SCHEMA)


class Postings:
    """A segment's lists: ``keys`` holds term * n + place, in order, so that one search finds a place in any list."""

    def __init__(self, row: dict, part: Part) -> None:
        self.row_at, self.term_at = np.frombuffer(row["row_at"], np.int64), np.frombuffer(row["term_at"], np.int32).astype(np.int64)
        self.place = np.cumsum(np.frombuffer(row["gaps"], np.int32), dtype=np.int64)
        self.n = int(self.row_at[-1]) + 1
        self.keys = np.repeat(np.arange(len(self.term_at) - 1), np.diff(self.term_at)) * self.n + self.place
        self.rank = self._ranks(part, np.frombuffer(row["words"], np.uint8), np.frombuffer(row["word_at"], np.int32).astype(np.int64))
        self.count = np.where(self.rank >= 0, np.diff(np.r_[self.term_at, self.term_at[-1]])[self.rank], 0)

    @staticmethod
    def _ranks(part: Part, words: np.ndarray, word_at: np.ndarray) -> np.ndarray:
        """The list of each word of ``part``, -1 for none."""
        if len(word_at) < 2 or len(part.word_at) < 2:
            return np.full(len(part.word_at) - 1, -1)
        both = np.concatenate([part.words, words])
        own_at = word_at + len(part.words)
        h, want = tb.hashes(both, own_at[:-1], own_at[1:]), tb.hashes(both, part.word_at[:-1], part.word_at[1:])
        order = np.argsort(h, kind="stable")
        at = order[np.minimum(np.searchsorted(h[order], want), len(h) - 1)]
        met = np.flatnonzero(h[at] == want)
        size = np.diff(part.word_at)
        same = np.diff(own_at)[at[met]] == size[met]
        same[same] = tb._equal(both, part.word_at[met[same]], own_at[at[met[same]]], size[met[same]])
        out = np.full(len(want), -1)
        out[met[same]] = at[met[same]]
        if not same.all():  # two words of one hash: by the letters
            names = {words[a:b].tobytes(): i for i, (a, b) in enumerate(zip(word_at, word_at[1:], strict=False))}
            for i in met[~same]:
                out[i] = names.get(part.words[part.word_at[i] : part.word_at[i + 1]].tobytes(), -1)
        return out

    def holds(self, term: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        """Whether each term stands somewhere in [low, high]."""
        i = np.minimum(np.searchsorted(self.keys, term * self.n + low), len(self.keys) - 1)
        return (low <= high) & (self.keys[i] >= term * self.n + low) & (self.keys[i] <= term * self.n + high)


def matches(p: Postings, part: Part, slop: int, block: int = 1 << 17) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(window, place of its first word, whether exact) of the windows found within single documents.

    Near: every word stands at most ``slop`` words from its place after the first one. The lists are intersected from the
    window's rarest word in the segment on.
    """
    count = np.where(part.padded >= 0, p.count[part.padded] if len(p.count) else 0, np.iinfo(np.int64).max)
    live = np.flatnonzero((count.min(axis=1) > 0) & (part.size > 0)) if len(count) else np.zeros(0, np.int64)
    if not len(live):
        return
    order = np.argsort(count[live], axis=1, kind="stable")
    most = count[live, order[:, 0]]
    done = np.r_[0, np.cumsum(most)]
    i = 0
    while i < len(live):
        j = max(i + 1, int(np.searchsorted(done, done[i] + block, "right")) - 1)
        which = np.repeat(np.arange(i, j), most[i:j])
        win, lead = live[which], order[which, 0]
        term = p.rank[part.padded[win, lead]]
        place = p.place[p.term_at[term] + np.arange(len(which)) - np.repeat(done[i:j] - done[i], most[i:j])]
        doc = np.searchsorted(p.row_at, place, "right") - 1
        low, high = p.row_at[doc], p.row_at[doc + 1] - 1
        first = p.rank[part.padded[win, 0]]
        starts = []
        for shift in range(-slop, slop + 1):  # where the first word can stand
            at = place - lead + shift
            ok = p.holds(first, np.maximum(at, low), np.minimum(at, high))
            starts.append((which[ok], at[ok], low[ok], high[ok]))
        which, at, low, high = (np.concatenate(x) for x in zip(*starts, strict=True))
        _, one = np.unique(which * p.n + at, return_index=True)
        which, at, low, high = which[one], at[one], low[one], high[one]
        exact = np.ones(len(which), bool)
        for k in range(part.padded.shape[1]):
            j_th = order[which, k]
            win = live[which]
            word = part.padded[win, j_th]
            term = p.rank[word]
            target = at + j_th
            ok = (word < 0) | p.holds(term, np.maximum(target - slop, low), np.minimum(target + slop, high))
            exact &= (word < 0) | p.holds(term, np.maximum(target, low), np.minimum(target, high)) if slop else ok
            which, at, low, high, exact = which[ok], at[ok], low[ok], high[ok], exact[ok]
        yield live[which], at, exact
        i = j


def _owned(win: np.ndarray, doc: np.ndarray, part: Part, n_docs: int) -> pa.Array:
    """The ids of the items of each document's windows, sorted."""
    n = part.owner_at[win + 1] - part.owner_at[win]
    owner = part.owners[np.repeat(part.owner_at[win] - (np.cumsum(n) - n), n) + np.arange(n.sum())]
    pair = np.unique(np.repeat(doc, n) * max(len(part.items), 1) + owner)
    doc, owner = np.divmod(pair, max(len(part.items), 1))
    return pa.ListArray.from_arrays(pa.array(np.searchsorted(doc, np.arange(n_docs + 1)).astype(np.int32)), pa.array(part.items, pa.string()).take(pa.array(owner)))


def search(index: DataFrame, part: Part, slop: int = 2) -> DataFrame:
    """A row for each document of ``index``: places of words in exact matches, items matched exactly, items matched nearly."""
    sent = index.sparkSession.sparkContext.broadcast(part)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = sent.value
        for batch in batches:
            for k in range(batch.num_rows):
                s = {n: batch.column(n)[k].as_buffer() for n in ("row_at", "words", "word_at", "term_at", "gaps")}
                doc_ids = batch.column("doc_ids")[k].values
                n_docs, row_at = len(doc_ids), np.frombuffer(s["row_at"], np.int64)
                mark = np.zeros(int(row_at[-1]) + 1, np.int32)
                found = list(matches(Postings(s, own), own, slop))
                win, at, exact = (np.concatenate(x) if found else np.zeros(0, np.int64) for x in (zip(*found, strict=True) if found else ([], [], [])))
                exact = exact.astype(bool)
                doc = np.searchsorted(row_at, at, "right") - 1
                np.add.at(mark, at[exact], 1)
                np.add.at(mark, at[exact] + own.size[win[exact]], -1)
                hit = np.flatnonzero(np.cumsum(mark[:-1]) > 0)
                hit_doc = np.searchsorted(row_at, hit, "right") - 1
                hits = pa.ListArray.from_arrays(pa.array(np.searchsorted(hit, row_at).astype(np.int32)), pa.array((hit - row_at[hit_doc]).astype(np.int32)))
                yield pa.record_batch(
                    [
                        pa.array([batch.column("segment")[k].as_py()] * n_docs, pa.string()), pa.array(np.arange(n_docs, dtype=np.int32)), doc_ids, pa.array(np.diff(row_at)),
                        hits, _owned(win[exact], doc[exact], own, n_docs), _owned(win, doc, own, n_docs),
                    ],
                    names=["segment", "doc_no", "doc_id", "n_words", "hits", "items", "near_items"],
                )

    return index.mapInArrow(tb.returning(run), FOUND_SCHEMA)


def contamination(docs: DataFrame, items: DataFrame, text: str = "text", item_id: str = "item_id", item_text: str = "text", size: int = 10, slop: int = 2, part_rows: int = 1 << 19) -> DataFrame:
    """(doc_id, n_words, hits, items, near_items) for every row of ``docs``.

    ``hits``: places of the words inside an exact occurrence of an item's window; ``items``: ids of items with one;
    ``near_items``: ids of items with an occurrence each of whose words is displaced by ``slop`` at most. Null or empty texts
    have no words; items without id, text or words have no window. Repeated rows of either table stay rows of their own;
    empty tables give no rows, or rows without hits. Other columns are not read. The windows are written as a table and
    looked up ``part_rows`` at a time, so what a task holds of them is bounded (some 50 bytes a row) however many there are.
    """
    narrow_batches(docs.sparkSession)
    index = written(build_index(docs, text), "postings")
    found = [search(index, part, slop) for part in parts_of(written(windows_of(items, item_id, item_text, size), "windows"), part_rows)]
    if len(found) == 1:
        return found[0].drop("segment", "doc_no")
    every = written(found[0], "matches")
    for more in found[1:]:
        every = every.unionByName(written(more, "matches"))
    lists = [F.array_sort(F.array_distinct(F.flatten(F.collect_list(c)))).alias(c) for c in ("hits", "items", "near_items")]
    every = every.groupBy("segment", "doc_no").agg(F.first("doc_id").alias("doc_id"), F.first("n_words").alias("n_words"), *lists)
    return every.drop("segment", "doc_no")
