"""Near duplicates by the Jaccard similarity of word shingles: SimHash and banded minima propose pairs, the whole sets decide.

SimHash fingerprints link by the generalised pigeonhole principle first. At similarity 0.8 two fingerprints of 64 bits differ
in some ten bits, which no partition of them can probe for; so every row's set of shingle hashes gives BANDS x ROWS minima; sets that agree on all minima of a band share a bucket. At
similarity 0.8 a pair shares none of 24 buckets of 4 minima with a chance of 3e-6. In each round every member of a bucket meets
the bucket's centre, which puts most of a bucket in one group. What then still shares a bucket with another group is joined by
prefixes: with the shingles of each set in one order, rare ones first, two sets that reach the bound have a shingle in common
among the first of each, so copies that each differ in too many places of their own never meet, however many they are.
Candidates are compared on their whole sets, so no pair below the bound is ever linked.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import textbuf as tb
from .components import connected_components
from .scratch import gathered, narrow_batches, spare, written
from .simhash import fitted_links, majorities

BANDS, ROWS = 24, 4
#: Rounds that compare the members of a bucket with one of them, each time another; then different groups are joined by prefixes, in a round of centres and one of all pairs.
STARS = 3
#: Bits in which fingerprints of linked sets may differ.
RADIUS = 4
_RNG = np.random.Generator(np.random.PCG64(20250811))
_XOR = _RNG.integers(0, 2**64, BANDS * ROWS, dtype=np.uint64)
_ODD = _RNG.integers(0, 2**64, BANDS * ROWS, dtype=np.uint64) | np.uint64(1)
_SIG = "s long, n long, fp long, sig binary, keys array<long>"


def shingles(raw: np.ndarray, at: np.ndarray, shingle: int = 5, seed: int = 42) -> tuple[np.ndarray, np.ndarray]:
    """(hashes of the shingles of each row, repeats included; how many each has). A row of fewer words has one; of none, none."""
    out, w = tb.squeezed(tb.lower(raw), at, tb.NOT_SPACE)
    n = np.diff(w.row_at)
    per = np.where(n >= shingle, n - shingle + 1, np.minimum(n, 1))
    first = np.arange(per.sum()) - np.repeat(np.cumsum(per) - per - w.row_at[:-1], per)
    last = np.minimum(first + shingle, np.repeat(w.row_at[1:], per)) - 1
    return tb.xxh64(out, w.start[first], w.end[last], seed), per


def shingle_sets(h: np.ndarray, per: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, hash) of the distinct shingles of each row, by row, then hash."""
    row = np.repeat(np.arange(len(per)), per)
    order = np.lexsort((h, row))
    row, h = row[order], h[order]
    new = np.ones(len(h), bool)
    new[1:] = (row[1:] != row[:-1]) | (h[1:] != h[:-1])
    return row[new], h[new]


def signatures(raw: np.ndarray, at: np.ndarray, shingle: int = 5) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of each row: a hash of its set, the set's size, the fingerprint, the low bytes of its minima, and the keys of its buckets."""
    h, per = shingles(raw, at, shingle)
    fp = majorities(h, per)
    row, h = shingle_sets(h, per)
    n = np.bincount(row, minlength=len(at) - 1)
    some = np.flatnonzero(n)
    begin = (np.cumsum(n) - n)[some]
    least = np.full((len(n), BANDS * ROWS), np.uint64(2**64 - 1))
    whole = np.zeros(len(n), np.uint64)
    if len(some):
        whole[some] = np.add.reduceat(tb.mix(h), begin)
        for i in range(BANDS * ROWS):
            least[some, i] = np.minimum.reduceat((h ^ _XOR[i]) * _ODD[i], begin)
    whole = tb.mix(whole ^ tb.mix(n.astype(np.uint64)))
    keys = np.empty((len(n), BANDS), np.uint64)
    for b in range(BANDS):
        k = np.full(len(n), b + 1, np.uint64)
        for i in range(b * ROWS, (b + 1) * ROWS):
            k = tb.mix(k ^ least[:, i]) * _ODD[b]
        keys[:, b] = k
    return whole.view(np.int64), n, fp, least.astype(np.uint8), keys.view(np.int64)


def similarities(a: pa.Array, b: pa.Array, shingle: int = 5) -> np.ndarray:
    """Jaccard similarity of the shingle sets, row by row; 1 for two empty sets."""
    (ra, ha), (rb, hb) = (shingle_sets(*shingles(*tb.buffers(x), shingle)) for x in (a, b))
    row, h = np.r_[ra, rb], np.r_[ha, hb]
    order = np.lexsort((h, row))
    row, h = row[order], h[order]
    twice = (row[1:] == row[:-1]) & (h[1:] == h[:-1])
    both = np.bincount(row[1:][twice], minlength=len(a))
    union = np.bincount(row, minlength=len(a)) - both
    return np.where(union > 0, both / np.maximum(union, 1), 1.0)


def _signed(rows: DataFrame, text: str, shingle: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b in tb.pieces(batch, "t", 1 << 19):
                s, n, fp, sig, keys = signatures(*tb.buffers(b.column("t")), shingle)
                lists = pa.ListArray.from_arrays(np.arange(0, keys.size + 1, BANDS, dtype=np.int32), pa.array(keys.ravel()))
                yield pa.record_batch([b.column("row"), b.column("doc_id"), pa.array(s), pa.array(n.astype(np.int64)), pa.array(fp), pa.array([x.tobytes() for x in sig], pa.binary()), lists], names=["row", "doc_id", "s", "n", "fp", "sig", "keys"])

    return rows.select("row", "doc_id", F.col(text).alias("t")).mapInArrow(tb.returning(run), f"row long, doc_id long, {_SIG}")


def _likely(pairs: DataFrame, sigs: DataFrame, rows: int, least: float) -> DataFrame:
    """Distinct (a, b), a < b, of the ``rows`` pairs(a, an, b, bn) at most that can reach ``least``: by the sets' sizes, and by the minima of sigs(s, sig) in common, of which a quarter less than expected is six deviations off at 0.8.

    Minima are looked up once a pair, not carried in every bucket that the pair shares.
    """
    need = int((least - 0.25) * BANDS * ROWS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                x, y = (np.frombuffer(b"".join(b.column(c).to_pylist()), np.uint8).reshape(-1, BANDS * ROWS) for c in ("asig", "bsig"))
                yield b.select(["a", "b"]).filter(pa.array((x == y).sum(axis=1) >= need))

    sized = pairs.where(F.least("an", "bn") >= F.lit(least) * F.greatest("an", "bn")).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    sized = written(gathered(gathered(sized, rows).distinct(), rows), "met")
    n = sized.count()
    for c in "ab":
        sized = gathered(sized, n).join(sigs.select(F.col("s").alias(c), F.col("sig").alias(f"{c}sig")).hint("merge"), c)
    return gathered(sized.select("a", "asig", "b", "bsig"), n).mapInArrow(tb.returning(run), "a long, b long")


def _linked(pairs: DataFrame, texts: DataFrame, least: float, shingle: int) -> DataFrame:
    """The pairs whose whole sets reach ``least``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b in tb.pieces(batch, "at", 1 << 19):
                yield b.select(["a", "b"]).filter(pa.array(similarities(b.column("at"), b.column("bt"), shingle) >= least))

    a, b = (texts.select(F.col("s").alias(c), F.col("t").alias(f"{c}t")) for c in "ab")
    return pairs.join(a.hint("merge"), "a").join(b.hint("merge"), "b").select("a", "b", "at", "bt").mapInArrow(tb.returning(run), "a long, b long")


def _shingled(texts: DataFrame, shingle: int) -> DataFrame:
    """(s, h) of the distinct shingles of texts(s, t)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b in tb.pieces(batch, "t", 1 << 19):
                row, h = shingle_sets(*shingles(*tb.buffers(b.column("t")), shingle))
                yield pa.record_batch([b.column("s").take(pa.array(row)), pa.array(h.view(np.int64))], names=["s", "h"])

    return texts.select("s", "t").mapInArrow(tb.returning(run), "s long, h long")


def _apart(crowd: DataFrame, roots: DataFrame) -> DataFrame:
    """(s, n) of the members of buckets that hold more than one root."""
    named = crowd.select("k", "s", "n").join(roots.hint("merge"), "s", "left").withColumn("root", F.coalesce("root", "s"))
    named = written(named.select("k", "s", "n", "root"), "named")
    several = named.groupBy("k").agg(F.min("root").alias("x"), F.max("root").alias("y")).where("x <> y").select("k")
    return named.join(several.hint("merge"), "k", "left_semi").select("s", "n").distinct()


def _prefixes(members: DataFrame, texts: DataFrame, least: float, shingle: int) -> DataFrame:
    """(h, s, n, rest): of members(s, n) the shingles by which a partner that reaches ``least``, which is above 0, must be met.

    Shingles are ordered by the number of sets that have them, then by hash; ``rest`` is how many a set has from this one on.
    Two sets of na and nb shingles reach ``least`` only if they share ``o = least / (1 + least) * (na + nb)``, so each has o or
    more from the first shared one on. Shingles of one set alone count for the places of the others and go no further.
    """
    held = written(_shingled(texts.join(members.select("s").hint("merge"), "s", "left_semi"), shingle), "shingles")
    common = held.groupBy("h").agg(F.count("*").alias("c")).where("c > 1")
    of_set = Window.partitionBy("s")
    placed = held.join(common.hint("merge"), "h").withColumn("rest", F.count("*").over(of_set) + 1 - F.row_number().over(of_set.orderBy("c", "h")))
    placed = placed.join(members.hint("merge"), "s").where(F.col("rest") >= F.lit(least) * F.col("n") - 1e-6)
    return written(placed.select("h", "s", "n", "rest"), "prefixes")


def _by_prefix(placed: DataFrame, roots: DataFrame, least: float, star: bool) -> DataFrame:
    """Distinct (a, b) of placed(h, s, n, rest) that share an h, are of different roots and can reach ``least``.

    ``star``: only pairs with the set of each h that has fewest rare shingles, which is similar to most others.
    """
    named = placed.join(roots.hint("merge"), "s", "left").withColumn("root", F.coalesce("root", "s"))
    named = written(named.select("h", "s", "n", "rest", "root"), "named")
    several = named.groupBy("h").agg(F.min("root").alias("x"), F.max("root").alias("y")).where("x <> y").select("h")
    named = named.join(several.hint("merge"), "h", "left_semi")
    a, b = (named.select("h", *[F.col(c).alias(x + c) for c in ("s", "n", "root", "rest")]) for x in "ab")
    if star:
        c = b.groupBy("h").agg(F.min(F.struct((-F.col("brest") / F.col("bn")).alias("o"), "bs", "bn", "broot", "brest")).alias("c"))
        b = c.select("h", "c.bs", "c.bn", "c.broot", "c.brest")
    apart = F.col("aroot") != F.col("broot") if star else F.col("aroot") < F.col("broot")
    enough = F.lit(1 + least) * F.least("arest", "brest") >= F.lit(least) * (F.col("an") + F.col("bn")) - 1e-6
    pairs = a.join(b.hint("merge"), "h").where(apart & enough)
    return pairs.select(F.least("as", "bs").alias("a"), F.greatest("as", "bs").alias("b")).distinct()


def similar_groups(rows: DataFrame, text: str, least: float = 0.8, shingle: int = 5, exact: bool = False) -> tuple[DataFrame, DataFrame]:
    """(sets, roots): sets(s, first, n) of the distinct shingle sets with the first (no_id, doc_id, row) that has each, and
    roots(s, root) of the sets that some other is linked to. ``rows(row, doc_id, text)`` is read more than once.

    At the end the members of every bucket that holds more than one group are joined by prefixes, whatever its size; members of
    one group are not paired. ``exact``: so are all other sets, whether they share a bucket or not.
    """
    signed = written(_signed(rows, text, shingle), "signatures")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "row")).alias("first")
    sets = written(signed.groupBy("s").agg(first), "sets")
    one = signed.join(sets.select(F.col("first.row").alias("row")).hint("merge"), "row", "left_semi")
    one = written(one, "one-of-each-set")
    by_fp = one.groupBy("fp").agg(F.min("s").alias("centre"))
    centre = written(by_fp, "centres")
    fingers = fitted_links(centre, RADIUS)
    near = fingers.join(centre.select(F.col("fp").alias("a"), F.col("centre").alias("x")), "a").join(centre.select(F.col("fp").alias("b"), F.col("centre").alias("y")), "b").select("x", "y")
    near = near.unionByName(one.join(centre, "fp").select(F.col("s").alias("x"), F.col("centre").alias("y"))).where("x <> y")
    near = written(near.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct(), "fingerprint-links")
    buckets = written(one.select("s", "n", F.explode("keys").alias("k")), "buckets")
    shared = buckets.groupBy("k").agg(F.count("*").alias("m")).where("m > 1").select("k")
    crowd = written(buckets.join(shared.hint("merge"), "k", "left_semi"), "crowd")
    met = one.select("s") if exact else crowd.select("s").unionByName(near.select(F.explode(F.array("a", "b")).alias("s"))).distinct()
    texts = rows.join(one.join(met.hint("merge"), "s", "left_semi").select("row", "s").hint("merge"), "row").select("s", F.col(text).alias("t"))
    texts = written(texts, "candidates")
    links = written(_linked(near, texts, least, shingle), "linked")
    roots = written(connected_components(links).select(F.col("node").alias("s"), "root"), "roots")
    placed, members = None, crowd.count()
    sigs = written(one.select("s", "sig").join(crowd.select("s").distinct().hint("merge"), "s", "left_semi"), "minima")
    for turn in range(STARS + 2):
        if turn < STARS:
            named = gathered(crowd.select("k", "s", "n"), members)
            named = named.join(roots.hint("merge"), "s", "left").withColumn("root", F.coalesce("root", "s"))
            named = written(gathered(named, members), "named")
            side = gathered(named.select("k", F.col("s").alias("a"), F.col("n").alias("an"), F.col("root").alias("aroot")), members)
            # one order of components and members for all buckets, so that they share their centres
            order = F.struct(F.xxhash64("root", F.lit(turn)).alias("o"), F.xxhash64("s", F.lit(turn)).alias("p"), "s", "n", "root")
            centre = gathered(named, members).groupBy("k").agg(F.min(order).alias("c"))
            centre = centre.select("k", F.col("c.n").alias("bn"), F.col("c.s").alias("b"), F.col("c.root").alias("broot"))
            pairs = side.join(centre.hint("merge"), "k").where("aroot <> broot")
            found = _likely(pairs, sigs, members, least)
        else:
            if placed is None:
                placed = _prefixes(written(one.select("s", "n") if exact else _apart(crowd, roots), "apart"), texts, least, shingle)
            found = _by_prefix(placed, roots, least, star=turn == STARS)
        found = written(_linked(found, texts, least, shingle), "linked")
        links = links.unionByName(found)
        if not found.isEmpty():
            roots = written(connected_components(links).select(F.col("node").alias("s"), "root"), "roots")
    return sets, roots


def one_of_similar(docs: DataFrame, text: str = "text", least: float = 0.8, shingle: int = 5, exact: bool = False) -> DataFrame:
    """One row of each group that links of similarity ``least`` or more hold together: that of least doc_id, one without an id last.

    Every row is decided by its own text, whether its doc_id is null, repeated or neither. Null and wordless texts are alike.
    An empty table gives none; other columns are carried along, whatever their names.
    """
    narrow_batches(docs.sparkSession)
    row = spare(docs.columns, "__row")
    rows = written(docs.withColumn(row, F.monotonically_increasing_id()), "rows")
    sets, roots = similar_groups(rows.select(F.col(row).alias("row"), F.col("doc_id").cast("long").alias("doc_id"), F.col(text).alias("text")), "text", least, shingle, exact)
    rooted = sets.join(roots.hint("merge"), "s", "left").withColumn("root", F.coalesce("root", "s"))
    kept = written(rooted.groupBy("root").agg(F.min("first").alias("first")).select(F.col("first.row").alias(row)), "kept")
    # the kept rows are most of all rows: they are never sent to every task, at any size
    return rows.join(kept.hint("merge"), row, "left_semi").select(*[F.col(f"`{c}`") for c in docs.columns])
