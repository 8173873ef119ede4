"""SimHash near-duplicates by the generalised pigeonhole principle.

Fingerprints of 64 bits link at ``radius`` or fewer differing bits. Correlated bits are grouped into partitions; dynamic
programming on estimated candidate counts gives each partition its own threshold t_i >= -1 with
sum(t_i + 1) = radius + 1, so two linked fingerprints agree within t_i bits in at least one partition. A partition of
threshold t is probed by masking every choice of t of its bits: fingerprints that agree on the others share a key.
The members of a key are verified on all 64 bits. Estimates decide costs only; any allocation finds every link.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textbuf as tb
from .components import connected_components
from .scratch import narrow_batches, written

#: Byte value -> its bits, least significant first, each in a byte of its own.
_SPREAD = np.packbits(np.zeros((256, 64), np.uint8), axis=1).view(np.uint64).ravel().copy()
for _v in range(256):
    _SPREAD[_v] = sum(((_v >> _b) & 1) << (8 * _b) for _b in range(8))


def fingerprints(raw: np.ndarray, at: np.ndarray, shingle: int = 4, seed: int = 42) -> np.ndarray:
    """A bit of a row's fingerprint is set if it is set in over half of the row's shingle hashes; no word: zero."""
    out, w = tb.squeezed(tb.lower(raw), at, tb.NOT_SPACE)
    n = np.diff(w.row_at)
    per = np.where(n >= shingle, n - shingle + 1, np.minimum(n, 1))
    first = np.arange(per.sum()) - np.repeat(np.cumsum(per) - per - w.row_at[:-1], per)
    last = np.minimum(first + shingle, np.repeat(w.row_at[1:], per)) - 1
    return majorities(tb.xxh64(out, w.start[first], w.end[last], seed), per)


def majorities(h: np.ndarray, per: np.ndarray) -> np.ndarray:
    """Fingerprints of rows of ``per`` hashes each: the bits that over half of a row's hashes set."""
    base = np.cumsum(per) - per
    # sums of up to 255 hashes fit the byte lanes
    cuts = -(-per // 255)
    cut_base = np.cumsum(cuts) - cuts
    begin = np.arange(cuts.sum()) - np.repeat(cut_base, cuts)
    begin = np.repeat(base, cuts) + 255 * begin
    counts = np.zeros((len(per), 64), np.int64)
    if len(begin):
        rows = np.flatnonzero(cuts)
        for lane in range(8):
            part = np.add.reduceat(_SPREAD[(h >> np.uint64(8 * lane)).astype(np.uint8)], begin)
            eight = np.ascontiguousarray(part).view(np.uint8).reshape(-1, 8).astype(np.int64)
            counts[rows, 8 * lane : 8 * lane + 8] = np.add.reduceat(eight, cut_base[rows], axis=0)
    bits = (2 * counts > per[:, None]).astype(np.uint8)
    return np.packbits(bits, axis=1, bitorder="little").view(np.uint64).ravel().view(np.int64)


def with_fingerprint(docs: DataFrame, text: str = "text", shingle: int = 4, seed: int = 42) -> DataFrame:
    """(doc_id, fp) of whole texts; a null or empty text has fingerprint 0."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b in tb.pieces(batch, "t"):
                fp = fingerprints(*tb.buffers(b.column("t")), shingle, seed)
                yield pa.record_batch([b.column("doc_id"), pa.array(fp, pa.int64())], names=["doc_id", "fp"])

    return docs.select("doc_id", F.col(text).alias("t")).mapInArrow(tb.returning(run), "doc_id long, fp long")


def bit_moments(fps: DataFrame) -> tuple[int, np.ndarray]:
    """Number of fingerprints and the 64 x 64 counts of bits set together, summed over all of them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, n = np.zeros((64, 64)), 0
        for b in batches:
            x = np.unpackbits(b.column(0).to_numpy(zero_copy_only=False).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").astype(np.float32)
            total += (x.T @ x).astype(np.float64)
            n += len(x)
        k = np.arange(4096)
        yield pa.record_batch([pa.array(np.r_[k, 4096].astype(np.int32)), pa.array(np.r_[total.ravel(), n])], names=["k", "v"])

    # one row for each pair of bits, however many tasks there are
    sums = {r.k: r.v for r in fps.select("fp").mapInArrow(tb.returning(run), "k int, v double").groupBy("k").agg(F.sum("v").alias("v")).collect()}
    both = np.array([sums.get(i, 0.0) for i in range(4096)]).reshape(64, 64)
    return int(sums.get(4096, 0)), both


def grouped_bits(n: int, both: np.ndarray, parts: int) -> list[list[int]]:
    """Bits dealt to ``parts`` groups of near-equal size, each grown by the bit most correlated with what it holds."""
    mean = np.diag(both) / max(n, 1)
    cov = both / max(n, 1) - np.outer(mean, mean)
    sd = np.sqrt(np.maximum(np.diag(cov), 1e-12))
    rho = np.abs(cov / np.outer(sd, sd))
    left, groups = set(range(64)), []
    for p in range(parts):
        size = len(left) // (parts - p)
        grown = [min(left)]
        left.discard(grown[0])
        while len(grown) < size:
            best = max(sorted(left), key=lambda b: rho[b, grown].sum())
            grown.append(best)
            left.discard(best)
        groups.append(sorted(grown))
    return groups


#: What a key row costs (shuffle, sort, a share of its group's handling) in comparisons of two fingerprints; measured, about 8 microseconds against some 10 nanoseconds.
KEY_COST = 500.0


def _agreeing(v: np.ndarray, radius: int, block: int = 512) -> np.ndarray:
    """Ordered pairs of different members of ``v`` that differ in 0, 1, ... ``radius`` bits."""
    out = np.zeros(radius + 1, np.int64)
    for s in range(0, len(v), block):
        d = np.bitwise_count(v[s : s + block, None] ^ v[None, :])
        out += np.bincount(np.minimum(d, radius + 1).ravel(), minlength=radius + 2)[: radius + 1]
    out[0] -= len(v)
    return out


def allocated(groups: list[list[int]], sample: np.ndarray, n: int, radius: int) -> tuple[list[int], float]:
    """Thresholds by dynamic programming over the partitions, and their estimated cost.

    Cost of threshold t in a partition: its keys a fingerprint, and the candidates expected a fingerprint. The latter come
    from the pairs of the whole random ``sample`` that agree within t bits there, scaled to ``n`` fingerprints.
    """
    cost = np.full((len(groups), radius + 2), np.inf)
    a = np.unique(sample)
    for i, g in enumerate(groups):
        mask = np.uint64(sum(1 << b for b in g))
        agree = np.cumsum(_agreeing(a.view(np.uint64) & mask, radius))
        pairs = max(len(a) * (len(a) - 1), 1)
        cost[i, 0] = 0.0
        for t in range(radius + 1):
            keys = comb(len(g), t)
            near = int(agree[t]) / pairs
            chance = sum(comb(len(g), k) for k in range(t + 1)) / 2.0 ** len(g)
            cost[i, t + 1] = KEY_COST * keys + n * max(near, chance)
    best = np.full((len(groups) + 1, radius + 2), np.inf)
    best[0, 0] = 0.0
    took = np.zeros((len(groups) + 1, radius + 2), int)
    for i in range(len(groups)):
        for s in range(radius + 2):
            for t in range(s + 1):
                c = best[i, s - t] + cost[i, t]
                if c < best[i + 1, s]:
                    best[i + 1, s], took[i + 1, s] = c, t
    s, out = radius + 1, []
    for i in range(len(groups), 0, -1):
        out.append(int(took[i, s]) - 1)
        s -= took[i, s]
    return out[::-1], float(best[-1, -1])


def planned(n: int, both: np.ndarray, sample: np.ndarray, radius: int = 4) -> list[tuple[list[int], int]]:
    """[(bits, threshold)] of least estimated cost over the numbers of partitions."""
    options = []
    for parts in range(2, 6):
        groups = grouped_bits(n, both, parts)
        thresholds, cost = allocated(groups, sample, n, radius)
        options.append((cost, list(zip(groups, thresholds, strict=True))))
    return min(options, key=lambda x: x[0])[1]


def masks(plan: list[tuple[list[int], int]]) -> list[int]:
    """The bits that a key keeps, for every key of a fingerprint."""
    return [sum(1 << b for b in g if b not in out) for g, t in plan if t >= 0 for out in combinations(g, t)]


def _find(parent: np.ndarray, i: int) -> int:
    while parent[i] != i:
        parent[i] = parent[parent[i]]
        i = parent[i]
    return i


def _join(parent: np.ndarray, i: int, j: int) -> None:
    i, j = _find(parent, i), _find(parent, j)
    if i != j:
        parent[max(i, j)] = min(i, j)


def _roots(parent: np.ndarray) -> np.ndarray:
    r = parent[parent]
    while (r != parent).any():
        parent, r = r, r[r]
    return r


def linked(fp: np.ndarray, radius: int = 4, block: int = 256, tile: int = 4096) -> np.ndarray:
    """For sorted distinct fingerprints, the index of the first member of each one's component within this set.

    Neighbours in several bit rotations are linked first; then only members of different components are compared, in
    blocks, until every pair between components has been seen. Memory: a block by a tile, some 16 MB.
    """
    n = len(fp)
    u = fp.view(np.uint64)
    parent = np.arange(n)
    if n == 2:
        if int(np.bitwise_count(u[0] ^ u[1])) <= radius:
            parent[1] = 0
        return parent
    if n > 64:
        for k in range(0, 64, 8):
            order = np.argsort((u << np.uint64(k)) | (u >> np.uint64((64 - k) % 64)) if k else u, kind="stable")
            near = np.flatnonzero(np.bitwise_count(u[order[1:]] ^ u[order[:-1]]) <= radius)
            for i in near:
                _join(parent, int(order[i]), int(order[i + 1]))
    root = _roots(parent)
    ids, size = np.unique(root, return_counts=True)
    if len(ids) == 1:
        return root
    # every component but the largest is compared with all others
    big = ids[size.argmax()]
    left = np.flatnonzero(root != big)
    for s in range(0, len(left), block):
        rows = left[s : s + block]
        for c in range(0, n, tile):
            d = np.bitwise_count(u[rows][:, None] ^ u[None, c : c + tile]) <= radius
            d &= root[rows][:, None] != root[None, c : c + tile]
            for i, j in zip(*np.nonzero(d), strict=True):
                _join(parent, int(rows[i]), int(j) + c)
        root = _roots(parent)
    return root


def near_links(fps: DataFrame, plan: list[tuple[list[int], int]], radius: int = 4, cap: int = 65536) -> DataFrame:
    """Edges (a, b) of a spanning forest of the links found within each key; ``fps(fp)`` holds distinct fingerprints.

    A key of over ``cap`` members is dealt to pairs of chunks of half that size, so that every two of its members meet in
    some task and no task holds more than ``cap`` of them.
    """
    ms = masks(plan)
    key = F.posexplode(F.array(*[F.lit(m - (1 << 64) if m >> 63 else m).bitwiseAND(F.col("fp")) for m in ms])).alias("m", "k")
    keyed = fps.select("fp", key)
    counts = keyed.groupBy("m", "k").agg(F.count("*").alias("n"))
    hot = counts.where(F.col("n") > cap).withColumn("chunks", F.ceil(F.col("n") / (cap // 4)).cast("int"))
    # a member of chunk c belongs to every pair of chunks that has c in it
    met = keyed.join(hot, ["m", "k"], "left").withColumn("c", F.when(F.col("chunks").isNotNull(), F.pmod(F.xxhash64("fp"), F.col("chunks")).cast("int")))
    pair = F.when(F.col("chunks").isNull(), F.array(F.lit(0))).otherwise(
        F.transform(F.sequence(F.lit(0), F.col("chunks") - 1), lambda o: F.least(F.col("c"), o) * F.col("chunks") + F.greatest(F.col("c"), o) + 1)
    )
    keyed = met.select("m", "k", F.explode(pair).alias("p"), "fp")
    keyed = keyed.repartition("m", "k", "p").sortWithinPartitions("m", "k", "p", "fp")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: tuple[np.ndarray, np.ndarray] | None = None

        def edges(key: np.ndarray, fp: np.ndarray) -> pa.RecordBatch:
            new = np.flatnonzero((key[1:] != key[:-1]).any(axis=1)) + 1
            begin, end = np.r_[0, new], np.r_[new, len(fp)]
            a, b = [], []
            two = np.flatnonzero(end - begin == 2)
            i = begin[two]
            hit = i[np.bitwise_count(fp.view(np.uint64)[i] ^ fp.view(np.uint64)[i + 1]) <= radius] if len(i) else i
            a.append(fp[hit + 1])
            b.append(fp[hit])
            for g in np.flatnonzero(end - begin > 2):
                x = fp[begin[g] : end[g]]
                r = linked(x, radius)
                moved = np.flatnonzero(r != np.arange(len(x)))
                a.append(x[moved])
                b.append(x[r[moved]])
            return pa.record_batch([pa.array(np.concatenate(a)), pa.array(np.concatenate(b))], names=["a", "b"])

        for batch in batches:
            if not batch.num_rows:
                continue
            key = np.stack([batch.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in (0, 1, 2)], axis=1)
            fp = batch.column(3).to_numpy(zero_copy_only=False)
            if held is not None:
                key, fp = np.concatenate([held[0], key]), np.concatenate([held[1], fp])
            new = np.flatnonzero((key[1:] != key[:-1]).any(axis=1))
            if not len(new):
                held = key, fp
                continue
            cut = new[-1] + 1
            held = key[cut:], fp[cut:]
            yield edges(key[:cut], fp[:cut])
        if held is not None:
            yield edges(*held)

    return keyed.mapInArrow(tb.returning(run), "a long, b long").distinct()


def fitted_links(distinct: DataFrame, radius: int = 4, fit_rows: int = 4096, cap: int = 65536) -> DataFrame:
    """``near_links`` of distinct fingerprints(fp), under the plan of least estimated cost for them."""
    n, both = bit_moments(distinct)
    sample = np.array([r.fp for r in distinct.select("fp").orderBy(F.xxhash64("fp"), "fp").limit(fit_rows).collect()], np.int64)
    return near_links(distinct.select("fp"), planned(n, both, sample, radius), radius, cap)


def near_duplicates(docs: DataFrame, text: str = "text", radius: int = 4, shingle: int = 4, seed: int = 42, fit_rows: int = 4096, cap: int = 65536) -> DataFrame:
    """(doc_id, fp, component_id) for every row of ``docs``.

    component_id is the least doc_id reachable over links. Copies count once: work is on distinct fingerprints. A null or
    empty text has fingerprint zero and links like any other; null doc_ids are kept and take part with the least doc_id
    of their component, null only if it has none. Repeated doc_ids give repeated rows; an empty table gives none. Bit
    correlations count all fingerprints; candidate estimates use the ``fit_rows`` fingerprints of least hash, a random sample.
    """
    narrow_batches(docs.sparkSession)
    fp = written(with_fingerprint(docs, text, shingle, seed), "fingerprints")
    distinct = written(fp.groupBy("fp").agg(F.min("doc_id").alias("first_id")), "distinct-fingerprints")
    links = fitted_links(distinct, radius, fit_rows, cap)
    roots = connected_components(links)
    rooted = distinct.join(roots.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    least = rooted.groupBy("root").agg(F.min("first_id").alias("component_id"))
    named = written(rooted.join(least, "root").select("fp", "component_id"), "components")
    return fp.join(named, "fp").select("doc_id", "fp", "component_id")
