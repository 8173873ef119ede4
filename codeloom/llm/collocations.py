"""Phrase collocations, counted by passes with hashed buckets (PCY, DHP) and Apriori pruning.

Pass k counts the phrases of k words that may be frequent, and adds up hashed buckets of the phrases of k + 1 words. The
buckets that reach the support become a bitmap, the frequent phrases of k words another; both are broadcast. In the next
pass a phrase is counted only if its own bucket is set and both phrases that it has without its first or last word are in
the bitmap of frequent ones. Bitmaps only ever let too much pass, so the counts, which go by the letters, are exact.

A bitmap has ``2**bits`` bits, which follow the size of the texts between 2**16 and 2**28 (32 MB). Where buckets are
fewer than the phrases need, they rule out less and more is counted exactly; nothing is lost.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import textbuf as tb
from .scratch import narrow_batches, written

#: A phrase is frequent from so many occurrences on.
LEAST = 30

#: Most words of a phrase.
LONGEST = 4

#: Texts of no language.
NO_LANG = "und"

#: Bytes of text worked on at once.
PIECE = 3 << 18

#: Up to 2**DENSE buckets a task counts in an array; of more, it gathers so many pairs before it gives them out.
DENSE, GATHERED = 24, 1 << 21

#: One-word parts are joined under so many salts: a common word begins or ends a great share of all phrases.
SALTS = 16

_BREAK = np.zeros(256, bool)
_BREAK[[ord(c) for c in ".,;:!?\n\v\f\r"]] = True
_WORD = ~_BREAK
_WORD[[9, 32]] = False

_ROWS = "lang string, gram string, bucket long, n long"


class _Text:
    """The words of some rows, one space between any two, and which neighbours stand in one piece."""

    def __init__(self, batch: pa.RecordBatch) -> None:
        raw, at = tb.buffers(batch.column(1))
        raw = tb.lower(raw)
        own = tb.words(raw, at, _WORD)
        broken = np.r_[0, np.cumsum(_BREAK[raw])]
        self.buf, w = tb.squeezed(raw, at, _WORD, own)
        self.hash = tb.Hasher(self.buf)
        self.start, self.end = w.start, w.end
        n = len(self.start)
        row = np.repeat(np.arange(len(at) - 1), np.diff(w.row_at))
        piece = broken[own.start]
        #: run[i]: words from i to the end of its piece, up to one more than LONGEST
        same = np.zeros(n, bool)
        same[:-1] = (row[1:] == row[:-1]) & (piece[1:] == piece[:-1])
        self.run = np.ones(n, np.int8)
        for _ in range(LONGEST):
            self.run[:-1] = np.where(same[:-1], np.minimum(self.run[1:] + 1, LONGEST + 1), 1)
        langs = batch.column(0).dictionary_encode()
        self.names = langs.dictionary
        names, name_at = tb.buffers(self.names)
        self.seed = tb.hashes(names, name_at[:-1], name_at[1:])
        self.lang = langs.indices.to_numpy(zero_copy_only=False).astype(np.int64)[row]

    def of(self, k: int) -> np.ndarray:
        """Where phrases of k words begin."""
        return np.flatnonzero(self.run >= k)

    def keys(self, at: np.ndarray, k: int) -> np.ndarray:
        return tb.mix(self.hash(self.start[at], self.end[at + k - 1]) ^ self.seed[self.lang[at]])

    def counted(self, at: np.ndarray, k: int) -> tuple[pa.Array, pa.Array, np.ndarray]:
        """(language, phrase, count) of the distinct phrases of k words at the places ``at``, compared letter by letter."""
        start, end = self.start[at], self.end[at + k - 1]
        first, which = tb.distinct(self.buf, start, end, self.hash(start, end))
        both, n = np.unique(which * len(self.names) + self.lang[at], return_counts=True)
        one = at[first[both // len(self.names)]]
        return self.names.take(pa.array(both % len(self.names))), tb.spans(self.buf, self.start[one], self.end[one + k - 1]), n


class _Buckets:
    """Counts of buckets in a task: an array where they are few, else sorted pairs, given out whenever many have gathered.

    The array ends each count at ``most``, the support: sums of such counts reach it when and only when the true ones do.
    """

    def __init__(self, bits: int, most: int) -> None:
        self.dense = np.zeros(1 << bits, np.uint8 if most < 256 else np.int32) if bits <= DENSE else None
        self.most = most
        self.held: list[tuple[np.ndarray, np.ndarray]] = []
        self.size = 0

    def add(self, buckets: np.ndarray) -> Iterator[pa.RecordBatch]:
        if self.dense is not None:
            keys, n = np.unique(buckets.astype(np.int32), return_counts=True)
            self.dense[keys] = np.minimum(self.dense[keys] + n, self.most)
            return
        self.held.append(np.unique(buckets, return_counts=True))
        self.size += len(self.held[-1][0])
        if self.size > GATHERED:
            self._merge()
            if self.size > GATHERED // 2:
                yield from self.given()

    def _merge(self) -> None:
        if len(self.held) > 1:
            keys, which = np.unique(np.concatenate([k for k, _ in self.held]), return_inverse=True)
            total = np.bincount(which, np.concatenate([n for _, n in self.held]), len(keys)).astype(np.int64)
            self.held = [(keys, total)]
        self.size = sum(len(k) for k, _ in self.held)

    def given(self) -> Iterator[pa.RecordBatch]:
        self._merge()
        held, self.held, self.size = self.held, [], 0
        if self.dense is not None:
            step = 1 << 20
            parts = ((s, self.dense[s : s + step]) for s in range(0, len(self.dense), step))
            held = ((np.flatnonzero(own) + s, own[own > 0]) for s, own in parts)
        for keys, n in held:
            for s in range(0, len(keys), 1 << 16):
                own = keys[s : s + (1 << 16)]
                none = pa.nulls(len(own), pa.string())
                yield _rows(none, none, pa.array(own), n[s : s + (1 << 16)])


def _rows(lang: pa.Array, gram: pa.Array, bucket: pa.Array, n: np.ndarray) -> pa.RecordBatch:
    return pa.record_batch([lang, gram, bucket.cast(pa.int64()), pa.array(n.astype(np.int64))], names=["lang", "gram", "bucket", "n"])


def _set(bitmap: np.ndarray, keys: np.ndarray, bits: int) -> np.ndarray:
    """Whether the bit of each key is set."""
    place = keys >> np.uint64(64 - bits)
    return (bitmap[(place >> np.uint64(3)).astype(np.int64)] >> (place & np.uint64(7)).astype(np.uint8)) & 1 != 0


def _bitmap(places: DataFrame, bits: int) -> np.ndarray:
    """The bits at ``places`` (one column: place), put together by Spark in blocks of 4 KB; the driver gets 2**bits bits at most."""
    one = F.col("place") + 1
    blocks = places.groupBy(F.bitmap_bucket_number(one).alias("block")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(one)).alias("bits"))
    out = np.zeros(max(1, (1 << bits) >> 3), np.uint8)
    for block, made in blocks.collect():
        at = (block - 1) * 4096
        out[at : at + 4096] = np.frombuffer(made, np.uint8)[: len(out) - at]
    return out


def _places(grams: DataFrame, bits: int) -> DataFrame:
    """The places of frequent phrases in a bitmap, under the same key as in the texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            names, name_at = tb.buffers(b.column(0))
            raw, at = tb.buffers(b.column(1))
            keys = tb.mix(tb.hashes(raw, at[:-1], at[1:]) ^ tb.hashes(names, name_at[:-1], name_at[1:]))
            yield pa.record_batch([pa.array((keys >> np.uint64(64 - bits)).astype(np.int64))], names=["place"])

    return grams.select("lang", "gram").mapInArrow(tb.returning(run), "place long")


def _pass(docs: DataFrame, k: int, bits: int, least: int, longest: int, frequent: np.ndarray | None, buckets: np.ndarray | None) -> DataFrame:
    """Frequent phrases of k words and full buckets of k + 1 words (lang, gram, bucket, n); of words also the number of all, under bucket -1."""
    spark = docs.sparkSession
    known = None if k == 1 else (spark.sparkContext.broadcast(frequent), spark.sparkContext.broadcast(buckets))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gathered = _Buckets(bits, least)
        for batch in batches:
            for b in tb.pieces(batch, "text", PIECE):
                t = _Text(b)
                if not len(t.start):
                    continue
                at = t.of(k)
                if k == 1:
                    total = np.bincount(t.lang, minlength=len(t.names))
                    yield _rows(t.names, pa.nulls(len(total), pa.string()), pa.array(np.full(len(total), -1)), total)
                else:
                    part = t.of(k - 1)
                    ok = np.zeros(len(t.start) + 1, bool)
                    ok[part] = _set(known[0].value, t.keys(part, k - 1), bits)
                    at = at[ok[at] & ok[at + 1]]
                    at = at[_set(known[1].value, t.keys(at, k), bits)]
                if len(at):
                    lang, gram, n = t.counted(at, k)
                    for s in range(0, len(n), 1 << 16):
                        own = slice(s, s + (1 << 16))
                        yield _rows(lang[own], gram[own], pa.nulls(len(n[own]), pa.int64()), n[own])
                if k < longest:
                    ok = np.zeros(len(t.start) + 1, bool)
                    ok[at] = True
                    longer = t.of(k + 1)
                    longer = longer[ok[longer] & ok[longer + 1]]
                    yield from gathered.add((t.keys(longer, k + 1) >> np.uint64(64 - bits)).astype(np.int64))
        yield from gathered.given()

    counted = docs.mapInArrow(tb.returning(run), _ROWS).groupBy("lang", "gram", "bucket").agg(F.sum("n").alias("n"))
    return written(counted.where((F.col("n") >= least) | (F.col("bucket") == -1)), f"phrases-{k}")


def _bits(docs: DataFrame) -> int:
    size = docs.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    return min(28, max(16, (int(size) // 64).bit_length()))


def frequent_phrases(docs: DataFrame, least: int = LEAST, longest: int = LONGEST, bits: int | None = None, lang: str = "lang", text: str = "text") -> tuple[DataFrame, DataFrame]:
    """((lang, k, gram, f): every phrase of 1 to ``longest`` words, ``longest`` up to 4, that occurs ``least`` times in a language; (lang, n): all words of each).

    Words are lower-cased (A-Z) runs of anything but blanks, tabs and line ends; a phrase lies within a piece between
    ``.,;:!?`` and line ends, and is its words joined by spaces. Null texts are empty, a null language is ``und``; overlapping
    occurrences and repeated rows all count. Without words both tables are empty.
    """
    if not 1 <= longest <= LONGEST:
        raise ValueError(f"longest must be 1 to {LONGEST}")
    spark = docs.sparkSession
    narrow_batches(spark)
    own = docs.select(F.coalesce(F.col(f"`{lang}`").cast("string"), F.lit(NO_LANG)).alias("lang"), F.col(f"`{text}`").alias("text"))
    bits = bits or _bits(own)
    frequent = buckets = totals = None
    found: list[DataFrame] = []
    for k in range(1, longest + 1):
        made = _pass(own, k, bits, least, longest, frequent, buckets)
        if k == 1:
            totals = made.where("bucket = -1").select("lang", "n")
        found.append(made.where("gram is not null").select("lang", F.lit(k).alias("k"), "gram", F.col("n").alias("f")))
        if k < longest:
            frequent = _bitmap(_places(found[-1], bits), bits)
            buckets = _bitmap(made.where("bucket >= 0").select(F.col("bucket").alias("place")), bits)
    grams = found[0]
    for more in found[1:]:
        grams = grams.unionByName(more)
    return grams, totals


def _wide(x: Column) -> Column:
    return x.cast("decimal(20,0)")


def scored(grams: DataFrame) -> DataFrame:
    """(lang, gram, words, a, l, r, score) of every phrase of two words or more, by its weakest cut: floor(2,000,000 a / (l + r)), ties to the first cut."""
    words = F.split("gram", " ")
    phrases = grams.where("k > 1").select("lang", "gram", F.col("f").alias("a"), words.alias("words"))
    cut = F.explode(F.sequence(F.lit(1), F.size("words") - 1))
    cuts = phrases.select("*", cut.alias("cut")).select(
        "lang", "gram", "a", "cut", F.array_join(F.slice("words", F.lit(1), F.col("cut")), " ").alias("first"), F.array_join(F.slice("words", F.col("cut") + 1, F.size("words")), " ").alias("rest"), (F.size("words") - F.col("cut")).alias("left_over")
    )
    salt = F.pmod(F.xxhash64("gram"), F.lit(SALTS)).cast("int")
    parts = grams.where(F.col("k") < LONGEST).select("lang", F.col("gram").alias("part"), "f", F.explode(F.when(F.col("k") == 1, F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0)))).alias("salt"))
    for size, part, name in ((F.col("cut"), "first", "l"), (F.col("left_over"), "rest", "r")):
        cuts = cuts.withColumn("salt", F.when(size == 1, salt).otherwise(0)).withColumnRenamed(part, "part").join(parts.withColumnRenamed("f", name), ["lang", "part", "salt"]).drop("part", "salt")
    score = F.expr("cast(2000000 as decimal(7,0)) * cast(a as decimal(20,0)) div (cast(l as decimal(20,0)) + cast(r as decimal(20,0)))")
    weakest = cuts.withColumn("score", score).groupBy("lang", "gram", "a").agg(F.min(F.struct("score", "cut", "l", "r")).alias("m"))
    return weakest.select("lang", "gram", "a", "m.l", "m.r", "m.score")


def collocations(docs: DataFrame, least: int = LEAST, longest: int = LONGEST, absorbed: int = 80, most: int = 2000, bits: int | None = None, lang: str = "lang", text: str = "text") -> DataFrame:
    """The ``most`` best phrases of each language: lang, rank, phrase, a, l, r, n, score.

    A phrase whose words stand in a longer frequent phrase that has ``absorbed`` per cent of its occurrences is dropped, whether
    or not that one is dropped too. Best: by score, then by a, then by the phrase's bytes. A language without a frequent
    phrase has no row; an empty table gives none.
    """
    grams, totals = frequent_phrases(docs, least, longest, bits, lang, text)
    words = F.split("gram", " ")
    inner = F.array(*[F.when(F.size(words) >= s + k, F.array_join(F.slice(words, s + 1, k), " ")) for k in range(2, longest) for s in range(longest - k + 1)]) if longest > 2 else None
    ranked = scored(grams)
    if inner is not None:
        inside = grams.where("k > 2").select("lang", F.explode(F.array_compact(inner)).alias("gram"), F.col("gram").alias("whole"), "f").where("gram != whole")
        holder = inside.groupBy("lang", "gram").agg(F.max("f").alias("holder"))
        ranked = ranked.join(holder, ["lang", "gram"], "left").where(F.col("holder").isNull() | (100 * _wide(F.col("holder")) < absorbed * _wide(F.col("a")))).drop("holder")
    order = [F.desc("score"), F.desc("a"), F.asc("gram")]
    ranked = ranked.withColumn("salt", F.pmod(F.xxhash64("gram"), F.lit(SALTS)))
    for keys in (["lang", "salt"], ["lang"]):  # no task orders more than SALTS * most rows of a language at the end
        ranked = ranked.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col("rank") <= most)
    return ranked.join(totals, "lang").select("lang", F.col("rank").cast("long").alias("rank"), F.col("gram").alias("phrase"), "a", "l", "r", "n", "score")
