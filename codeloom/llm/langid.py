"""Language identification by bit-sliced Bloom filters of n-grams.

One filter serves all languages: each slot holds a mask with a bit for each language and level. An n-gram's mask is the AND of
the masks at its hash positions: the languages that contain it, at the first level at all, at the second as a usual one. A
text's bits are counted over its n-grams and corrected for each bit's false-positive rate; the mean of a language's levels
decides. Every n-gram of the training rows is in the filter.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textbuf as tb
from .scratch import carried, narrow_batches, spread, written

UNKNOWN = "und"

_LETTER = np.zeros(256, dtype=bool)
_LETTER[97:123] = True
_LETTER[128:] = True


def folded(raw: np.ndarray) -> np.ndarray:
    """A-Z and the upper-case letters of the two-byte Latin block (C3 80 to C3 9E) lowered."""
    out = tb.lower(raw)
    if len(out) > 1:
        after = out[1:]
        upper = (out[:-1] == 0xC3) & (after >= 0x80) & (after <= 0x9E) & (after != 0x97)
        after[upper] += 0x20
    return out


def grams(raw: np.ndarray, at: np.ndarray, size: int = 3) -> tuple[np.ndarray, np.ndarray]:
    """(hashes of ``size`` characters in a row of the words of each row, a space before and after each word included; row offsets)."""
    out, w = tb.squeezed(folded(raw), at, _LETTER)
    if not len(out):
        return np.zeros(0, np.uint64), np.zeros(len(at), np.int64)
    out = np.concatenate([np.full(1, 32, np.uint8), out])
    begins = np.append(np.flatnonzero((out & 0xC0) != 0x80), len(out))
    first, last = begins[:-size], begins[size:]
    # a gram with a space inside spans two words
    keep = np.ones(len(first), bool)
    for k in range(1, size - 1):
        keep &= out[begins[k : len(first) + k]] != 32
    first, last = first[keep], last[keep]
    row_start = np.append(w.start, len(out))[w.row_at]
    row_start[-1] = len(out)
    return tb.hashes(out, first, last), np.searchsorted(first, row_start)


def has_letter(raw: np.ndarray, at: np.ndarray, texts: pa.Array) -> np.ndarray:
    low = tb.lower(raw)
    sure = tb.row_sums((low >= 97) & (low <= 122), at) > 0
    for i in np.flatnonzero(~sure & (tb.row_sums(raw >= 128, at) > 0)):
        sure[i] = any(c.isalpha() for c in texts[int(i)].as_py())
    return sure


#: An n-gram with this share of a language's n-grams at least is a usual one.
USUAL_SHARE = 2e-5
LEVELS = 2

#: Slots packed to one row of the written filter.
CHUNK = 1 << 14


def _positions(g: np.ndarray, n: int, hashes: int) -> Iterator[np.ndarray]:
    """Slots of n-grams in a filter of ``n`` slots, a power of two."""
    h = tb.mix(g + np.uint64(0x9E3779B97F4A7C15))
    for k in range(hashes):
        yield (tb.mix(h + np.uint64(k)) & np.uint64(n - 1)).astype(np.int64)


@dataclass
class LanguageFilter:
    """``slots``: masks of languages, LEVELS bits each. ``rates``: each bit's chance of being set for an n-gram that was not added."""

    languages: list[str]
    slots: np.ndarray
    rates: np.ndarray
    most_common: int
    hashes: int = 3

    def masks(self, g: np.ndarray) -> np.ndarray:
        out = None
        for p in _positions(g, len(self.slots), self.hashes):
            out = self.slots[p] if out is None else out & self.slots[p]
        return out

    def decide(self, raw: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(index of the language, score) of each row."""
        g, row_at = grams(raw, at)
        n = np.diff(row_at)
        share = np.zeros((len(n), len(self.languages)))
        if len(g) and self.languages:
            m = self.masks(g)
            for i in range(len(self.rates)):
                held = (m[:, i // 8] >> np.uint8(i % 8)) & np.uint8(1)
                seen = tb.row_sums(held, row_at) / np.maximum(n, 1)
                share[:, i // LEVELS] += np.clip((seen - self.rates[i]) / max(1e-9, 1 - self.rates[i]), 0, 1) / LEVELS
        best = share.argmax(axis=1) if self.languages else np.zeros(len(n), int)
        top = share[np.arange(len(n)), best] if self.languages else np.zeros(len(n))
        best = np.where(top > 0, best, self.most_common)
        return best, top


def gram_counts(docs: DataFrame, text: str, lang: str) -> DataFrame:
    """(lang, gram, n) of all rows with a language."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, tuple[np.ndarray, np.ndarray]] = {}

        def flush() -> Iterator[pa.RecordBatch]:
            for name, (k, n) in held.items():
                for s in range(0, len(k), 65536):
                    part = k[s : s + 65536].view(np.int64)
                    yield pa.record_batch([pa.array([name] * len(part), pa.string()), pa.array(part), pa.array(n[s : s + 65536])], names=["lang", "gram", "n"])
            held.clear()

        for batch in batches:
            for b in tb.pieces(batch, "t"):
                g, row_at = grams(*tb.buffers(b.column("t")))
                names = b.column("lang").dictionary_encode()
                code = np.repeat(names.indices.to_numpy(zero_copy_only=False).astype(np.int64), np.diff(row_at))
                for i, name in enumerate(names.dictionary.to_pylist()):
                    k, n = np.unique(g[code == i], return_counts=True)
                    if name in held:
                        k0, n0 = held[name]
                        k, back = np.unique(np.concatenate([k0, k]), return_inverse=True)
                        n = np.bincount(back, np.concatenate([n0, n]), len(k)).astype(np.int64)
                    held[name] = k, n
                if sum(len(k) for k, _ in held.values()) > 1_000_000:
                    yield from flush()
        yield from flush()

    known = docs.select(F.col(text).alias("t"), F.col(lang).alias("lang")).where("t is not null and lang is not null")
    return known.mapInArrow(tb.returning(run), "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))


def _chunks(counts: DataFrame, languages: list[str], totals: list[int], n: int, hashes: int) -> DataFrame:
    """(chunk, bits): the filter's masks, OR-ed over all n-grams; a mask is so many 63-bit numbers as it takes."""
    place = {x: i for i, x in enumerate(languages)}
    words = -(-len(languages) * LEVELS // 56)

    def added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            own = np.array([place[x] for x in b.column("lang").to_pylist()], np.int64)
            usual = b.column("n").to_numpy() >= USUAL_SHARE * np.array(totals, np.float64)[own] if len(own) else np.zeros(0, bool)
            bit = own * LEVELS
            mask = (np.int64(1) << (bit % 56)) | np.where(usual, np.int64(1) << (bit % 56 + 1), 0)
            for p in _positions(b.column("gram").to_numpy().view(np.uint64), n, hashes):
                yield pa.record_batch([pa.array(p * words + bit // 56), pa.array(mask)], names=["at", "mask"])

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Of rows in order of place: those of one chunk to one row, whichever batches they come in."""
        held = None

        def row(x: tuple) -> pa.RecordBatch:
            out = np.zeros(CHUNK * words, np.int64)
            out[np.concatenate(x[1])] = np.concatenate(x[2])
            return pa.record_batch([pa.array([x[0]], pa.int64()), pa.array([out.tobytes()], pa.binary())], names=["chunk", "bits"])

        for b in batches:
            at, mask = b.column("at").to_numpy(), b.column("mask").to_numpy()
            chunk = at // (CHUNK * words)
            cuts = np.r_[0, np.flatnonzero(np.diff(chunk)) + 1, len(at)] if len(at) else np.zeros(1, np.int64)
            for s, e in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
                if held is not None and held[0] != chunk[s]:
                    yield row(held)
                    held = None
                held = held or (int(chunk[s]), [], [])
                held[1].append(at[s:e] - held[0] * CHUNK * words)
                held[2].append(mask[s:e])
        if held is not None:
            yield row(held)

    slots = counts.mapInArrow(added, "at long, mask long").groupBy("at").agg(F.bit_or("mask").alias("mask"))
    chunk = F.floor(F.col("at") / (CHUNK * words))
    return slots.repartition(chunk).sortWithinPartitions("at").mapInArrow(tb.returning(packed), "chunk long, bits binary")


def fit(docs: DataFrame, text: str = "text", lang: str = "lang", hashes: int = 3, load: int = 8, most_slots: int = 1 << 24) -> LanguageFilter:
    """The filter of all n-grams of all rows with a language. Null languages and null texts teach nothing.

    Slots: a power of two, ``load`` times the n-grams of the language with most of them at least, so that a third of a bit's
    places is set at most; beyond ``most_slots`` the places fill up and the correction for false positives grows, but no n-gram
    is left out. The filter is added up by Spark, slot by slot; the driver and every task hold its slots, a byte for each four
    languages, and nothing else.
    """
    narrow_batches(docs.sparkSession)
    counts = written(gram_counts(docs, text, lang), "grams")
    rows = sorted(counts.groupBy("lang").agg(F.sum("n").alias("total"), F.count("*").alias("grams")).collect(), key=lambda r: r.lang)
    languages, totals = [r.lang for r in rows], [r.total for r in rows]
    need = max((r.grams for r in rows), default=1) * load
    n = min(most_slots, 1 << max(CHUNK.bit_length() - 1, int(np.ceil(np.log2(max(1, need))))))
    bits, width = len(languages) * LEVELS, max(1, -(-len(languages) * LEVELS // 8))
    slots = np.zeros((n, width), np.uint8)
    for r in _chunks(counts, languages, totals, n, hashes).toLocalIterator() if rows else ():
        words = np.frombuffer(r.bits, np.int64).reshape(CHUNK, -1)
        own = np.ascontiguousarray(words).view(np.uint8).reshape(CHUNK, -1, 8)[:, :, :7].reshape(CHUNK, -1)
        slots[r.chunk * CHUNK : (r.chunk + 1) * CHUNK] = own[:, :width]
    rates = np.array([((slots[:, i // 8] >> np.uint8(i % 8)) & 1).mean() ** hashes for i in range(bits)])
    common = max(range(len(languages)), key=lambda i: (totals[i], languages[i]), default=-1)
    return LanguageFilter(languages, slots, rates, common, hashes)


def predict(docs: DataFrame, model: LanguageFilter, columns: list[str], text: str = "text", names: tuple[str, str] = ("lang_pred", "score")) -> DataFrame:
    """``columns`` of every row with its language and score (0 to 1), under ``names``: the corrected share of its n-grams that the language holds.

    Null texts and texts without a letter are ``und`` with score 0. A text with letters but no known n-gram gets the
    language with most n-grams, with score 0. Repeated rows are judged each; columns called as the results are replaced.
    """
    columns = [c for c in columns if c not in names]
    source, schema = carried(docs, columns, text)
    model = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = model.value
        for batch in batches:
            for b in tb.pieces(batch, "value"):
                texts = b.column(1)
                raw, at = tb.buffers(texts)
                best, score = own.decide(raw, at)
                known = has_letter(raw, at, texts) if own.languages else np.zeros(len(best), bool)
                named = [own.languages[i] if k else UNKNOWN for i, k in zip(best, known, strict=True)]
                score = np.where(known, score, 0.0)
                yield pa.record_batch([b.column(0), pa.array(named, pa.string()), pa.array(score)], names=["kept", "named", "share"])

    return spread(source.mapInArrow(tb.returning(run), schema("named string, share double")), columns, dict(zip(("named", "share"), names, strict=True)))
