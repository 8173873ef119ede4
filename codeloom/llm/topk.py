"""Exact top-k by inner product: branch and bound over blocks of dimensions in vertical layout.

Vectors are packed into blocks that keep each dimension together. For a block of queries and one of candidates, scores grow
by one block of dimensions after another; a candidate's partial score plus the product of the remaining norms bounds what it
can reach, and candidates below a query's k-th best are compacted away. Bounds begin with the k-th best of the block of largest
vectors, which every query meets first. Scores are integers, so results are exact.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import textbuf as tb
from .scratch import narrow_batches, written

_PACKED = "kind string, block string, n int, dims int, norm double, wide boolean, ids binary, rows binary, cells binary"
_EXACT = float(1 << 52)

#: A component of more than this counts as this much.
LARGEST = 1 << 53


def _cells(x: np.ndarray) -> tuple[bool, bytes]:
    wide = bool(len(x) and x.size and np.abs(x).max() >= 1 << 15)
    return wide, np.ascontiguousarray(x.T).astype(np.int64 if wide else np.int16).tobytes()


def _unpacked(n: int, dims: int, wide: bool, cells: bytes) -> np.ndarray:
    """dims x n."""
    return np.frombuffer(cells, np.int64 if wide else np.int16).reshape(dims, n).astype(np.int64)


def _record(kind: str, block: str, ids: np.ndarray, rows: np.ndarray, x: np.ndarray) -> dict:
    wide, cells = _cells(x)
    return {"kind": kind, "block": block, "n": len(ids), "dims": x.shape[1], "norm": float(np.sqrt((x.astype(np.float64) ** 2).sum(axis=1)).max(initial=0)), "wide": wide, "ids": ids.tobytes(), "rows": rows.tobytes(), "cells": cells}


def _batch(records: list[dict]) -> pa.RecordBatch:
    schema = pa.schema([("kind", pa.string()), ("block", pa.string()), ("n", pa.int32()), ("dims", pa.int32()), ("norm", pa.float64()), ("wide", pa.bool_()), ("ids", pa.binary()), ("rows", pa.binary()), ("cells", pa.binary())])
    return pa.RecordBatch.from_pylist(records, schema=schema)


def _vectors(column: pa.Array, scale: float) -> tuple[np.ndarray, np.ndarray]:
    """(places of usable rows, their floor(scale * x) padded with zeros to one length)."""
    lists = column.cast(pa.list_(pa.float64()))
    n = len(lists)
    at = np.asarray(lists.offsets, np.int64)
    flat = lists.values.to_numpy(zero_copy_only=False)
    bad = np.r_[0, np.cumsum(~np.isfinite(flat))]
    known = ~np.asarray(lists.is_null()) & (bad[at[1:]] == bad[at[:-1]])
    size = np.diff(at)
    keep = np.flatnonzero(known)
    out = np.zeros((len(keep), int(size[keep].max()) if len(keep) else 0), np.int64)
    row = np.repeat(np.arange(len(keep)), size[keep])
    if len(row):
        inner = np.arange(len(row)) - np.repeat(np.cumsum(size[keep]) - size[keep], size[keep])
        out[row, inner] = np.clip(np.floor(scale * flat[at[keep][row] + inner]), -LARGEST, LARGEST).astype(np.int64)
    return keep, out


def packed(vectors: DataFrame, vec_id: str, embedding: str, is_query, scale: float, k: int, size: int) -> DataFrame:
    """Blocks of candidates and of queries. Of equal vectors in a block, the k + 1 of least vec_id stay: no more can be among a query's k best."""
    source = vectors.select(F.col(vec_id).alias("id"), F.col(embedding).alias("x"), is_query.alias("q")).where("id is not null")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        task, serial, held = TaskContext.get().partitionId(), 0, []

        def blocks(parts: list) -> pa.RecordBatch:
            dims = max(p[2].shape[1] for p in parts)
            ids, q = np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])
            x = np.concatenate([np.pad(p[2], ((0, 0), (0, dims - p[2].shape[1]))) for p in parts])
            rows = (np.int64(task) << 40) + (np.int64(serial) << 20) + np.arange(len(ids))
            order = np.lexsort((rows, ids))
            if dims:
                _, which = np.unique(x[order], axis=0, return_inverse=True)
                which = which.ravel()
            else:
                which = np.zeros(len(order), np.int64)
            by = np.argsort(which, kind="stable")
            first = np.r_[0, np.flatnonzero(np.diff(which[by])) + 1]
            nth = np.arange(len(by)) - np.repeat(first, np.diff(np.r_[first, len(by)]))
            own = order[np.sort(by[nth <= k])]
            own = own[np.argsort(-(x[own].astype(np.float64) ** 2).sum(axis=1), kind="stable")]
            records = [_record("candidates", f"{task}-{serial}", ids[own], rows[own], x[own])]
            if q.any():
                records.append(_record("queries", f"{task}-{serial}", ids[q], rows[q], x[q]))
            return _batch(records)

        for b in batches:
            for s in range(0, b.num_rows, size):
                part = b.slice(s, size)
                keep, x = _vectors(part.column("x"), scale)
                if len(keep):
                    held.append((part.column("id").to_numpy(zero_copy_only=False)[keep].astype(np.int64), part.column("q").to_numpy(zero_copy_only=False)[keep].astype(bool), x))
                if sum(len(p[0]) for p in held) >= size:
                    yield blocks(held)
                    held, serial = [], serial + 1
        if held:
            yield blocks(held)

    return source.mapInArrow(tb.returning(run), _PACKED)


def _merged(blocks: DataFrame) -> DataFrame:
    """The blocks of each partition as one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        parts = [r for b in batches for r in b.to_pylist()]
        if parts:
            dims = max(r["dims"] for r in parts)
            x = np.concatenate([np.pad(_unpacked(r["n"], r["dims"], r["wide"], r["cells"]).T, ((0, 0), (0, dims - r["dims"]))) for r in parts])
            ids, rows = (np.concatenate([np.frombuffer(r[c], np.int64) for r in parts]) for c in ("ids", "rows"))
            yield _batch([_record("queries", str(TaskContext.get().partitionId()), ids, rows, x)])

    return blocks.mapInArrow(tb.returning(run), _PACKED)


def _padded(a: np.ndarray, dims: int, axis: int) -> np.ndarray:
    return np.pad(a, [(0, dims - a.shape[i]) if i == axis else (0, 0) for i in range(2)])


class Best:
    """The k best (score, vec_id, row) of each query of a block so far, and the score a candidate must reach.

    ``seed``: a score that k other rows are known to reach, for each query. ``pairs`` counts the pairs met, ``cut`` those
    given up before all their dimensions were read.
    """

    def __init__(self, q: np.ndarray, ids: np.ndarray, rows: np.ndarray, k: int, seed: np.ndarray | None = None, step: int = 8) -> None:
        self.q, self.ids, self.rows, self.k, self.step = q, ids, rows, k, step
        self.at = np.zeros(0, np.int64)
        self.score, self.vec, self.row = (np.zeros(0, np.int64) for _ in range(3))
        self.seed = np.full(len(ids), -np.inf) if seed is None else seed
        self.least = self.seed.copy()
        self.pairs = self.cut = 0

    def add(self, x: np.ndarray, ids: np.ndarray, rows: np.ndarray, tile: int = 64) -> None:
        dims = max(self.q.shape[1], x.shape[0])
        q, x = _padded(self.q, dims, 1), _padded(x, dims, 0)
        big = float(np.abs(q).max(initial=0)) * float(np.abs(x).max(initial=0)) * max(dims, 1)
        how = self._bounded if big < _EXACT else self._large
        order = np.argsort(-(x.astype(np.float64) ** 2).sum(axis=1), kind="stable")
        q, x = q[:, order].astype(np.float64), x[order].astype(np.float64)
        x_rest = np.sqrt(np.cumsum((x**2)[::-1], axis=0)[::-1])
        found = []
        for s in range(0, len(q), tile):
            own = slice(s, s + tile)
            at, col, score = how(q[own], x, x_rest, self.least[own])
            keep = rows[col] != self.rows[s + at]
            found.append((at[keep] + s, score[keep], ids[col[keep]], rows[col[keep]]))
        self._take(*(np.concatenate(c) for c in zip(*found, strict=True)))

    def _best_of(self, acc: np.ndarray, least: np.ndarray) -> np.ndarray:
        """What a score must reach: the bound so far, or the k-th best of these without the query's own row."""
        n = acc.shape[1]
        return np.maximum(least, np.partition(acc, n - self.k - 1, axis=1)[:, n - self.k - 1]) if n > self.k else least

    def _large(self, q: np.ndarray, x: np.ndarray, x_rest: np.ndarray, least: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of components too large for exact floats: float scores with their error rule out, whole numbers decide. Scores end at 64 bits."""
        at, col, score = [], [], []
        for c in range(0, x.shape[1], 1024):
            part = x[:, c : c + 1024]
            near = q @ part
            error = 1e-12 * np.sqrt((q**2).sum(axis=1))[:, None] * np.sqrt((part**2).sum(axis=0))[None] + 1
            a, b = np.nonzero(near + error >= self._best_of(near - error, least)[:, None])
            exact = [sum(int(u) * int(v) for u, v in zip(q[i], part[:, j], strict=True)) for i, j in zip(a, b, strict=True)]
            at.append(a)
            col.append(b + c)
            score.append(np.array([min(max(v, -(1 << 63)), (1 << 63) - 1) for v in exact], np.int64))
            self.pairs += near.size
        return np.concatenate(at), np.concatenate(col), np.concatenate(score)

    def _bounded(self, q: np.ndarray, x: np.ndarray, x_rest: np.ndarray, least: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        dims, n = x.shape
        self.pairs += len(q) * n
        cols = np.arange(n)
        acc = np.zeros((len(q), n))
        q_rest = np.sqrt(np.cumsum((q**2)[:, ::-1], axis=1)[:, ::-1])
        for seen in range(self.step, dims, self.step):
            acc += q[:, seen - self.step : seen] @ x[seen - self.step : seen]
            alive = acc + q_rest[:, seen, None] * x_rest[None, seen] + 0.5 >= least[:, None]
            some = alive.any(axis=0)
            if alive.mean() < 0.05:
                return self._survivors(q, x, acc, alive, seen, least, q_rest, x_rest, cols)
            if some.mean() < 0.9:  # columns that no query of the tile can use go
                self.cut += len(q) * int((~some).sum())
                cols, x, x_rest, acc = cols[some], x[:, some], x_rest[:, some], acc[:, some]
        done = (dims - 1) // self.step * self.step if dims else 0
        acc += q[:, done:] @ x[done:]
        at, col = np.nonzero(acc >= self._best_of(acc, least)[:, None])
        return at, cols[col], np.rint(acc[at, col]).astype(np.int64)

    def _survivors(self, q, x, acc, alive, seen, least, q_rest, x_rest, cols) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        at, col = np.nonzero(alive)
        self.cut += acc.size - len(at)
        part, dims = acc[at, col], len(x)
        while seen < dims and len(at):
            end = min(dims, seen + self.step)
            part = part + np.einsum("ij,ji->i", q[at, seen:end], x[seen:end, col])
            seen = end
            rest = q_rest[at, seen] * x_rest[seen, col] if seen < dims else 0.0
            keep = part + rest + 0.5 >= least[at]
            self.cut += int((~keep).sum()) if seen < dims else 0
            at, col, part = at[keep], col[keep], part[keep]
        return at, cols[col], np.rint(part).astype(np.int64)

    def _take(self, at: np.ndarray, score: np.ndarray, vec: np.ndarray, row: np.ndarray) -> None:
        at, score = np.r_[self.at, at], np.r_[self.score, score]
        vec, row = np.r_[self.vec, vec], np.r_[self.row, row]
        order = np.lexsort((row, vec, -score, at))
        at = at[order]
        first = np.searchsorted(at, np.arange(len(self.ids)))
        nth = np.arange(len(at)) - first[at]
        own = order[nth < self.k]
        self.at, self.score, self.vec, self.row = at[nth < self.k], score[own], vec[own], row[own]
        full = np.bincount(self.at, minlength=len(self.ids)) == self.k
        worst = np.full(len(self.ids), -np.inf)
        last = np.searchsorted(self.at, np.arange(len(self.ids)), "right") - 1
        worst[full] = self.score[last[full]]
        self.least = np.maximum(worst, self.seed)

    def rows_out(self, block: str) -> pa.RecordBatch:
        return pa.record_batch([pa.array([block] * len(self.at), pa.string()), pa.array(self.at.astype(np.int32)), pa.array(self.ids[self.at]), pa.array(self.vec), pa.array(self.row), pa.array(self.score)], names=["block", "at", "query_id", "vec_id", "row", "score"])


def _seeded(queries: DataFrame, first: dict, k: int) -> DataFrame:
    """``queries`` with the k-th best score of each in the block ``first``, none where it has fewer others."""
    x, ids, rows = _unpacked(first["n"], first["dims"], first["wide"], first["cells"]), np.frombuffer(first["ids"], np.int64), np.frombuffer(first["rows"], np.int64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            made = []
            for r in b.to_pylist():
                best = Best(_unpacked(r["n"], r["dims"], r["wide"], r["cells"]).T, np.frombuffer(r["ids"], np.int64), np.frombuffer(r["rows"], np.int64), k)
                best.add(x, ids, rows)
                made.append(best.least.tobytes())
            yield pa.record_batch([*b.columns, pa.array(made, pa.binary())], names=[*b.schema.names, "seed"])

    return queries.mapInArrow(tb.returning(run), _PACKED + ", seed binary")


def top_k(vectors: DataFrame, is_query, k: int = 20, vec_id: str = "vec_id", embedding: str = "embedding", scale: float = 64.0, size: int = 8192, query_size: int = 8192, group: int = 8) -> DataFrame:
    """(query_id, rank, vec_id, score): for each row that ``is_query`` keeps, its ``k`` best other rows by inner product of floor(scale * x).

    Ties go to the smaller vec_id. Vectors that are null or hold a null or non-finite component, and rows with a null
    vec_id, take no part; a shorter vector counts as ended by zeros. Repeated vec_ids are rows of their own: each such
    query row has its own ranks, and only a query's own row is left out. Every block of queries meets every block of
    candidates; ``group`` blocks of candidates go through one task with the same queries, sharing their bounds, and what a
    block sends is small beside the work it brings: some 100 bytes a vector for each 8,192 queries. Components of more than
    2**53 after scaling count as that much, and scores end at 64 bits; an empty table gives no rows, other columns are not read.
    """
    narrow_batches(vectors.sparkSession)
    blocks = written(packed(vectors, vec_id, embedding, is_query, scale, k, size), "vectors")
    sums = {r.kind: (r.blocks, r.n) for r in blocks.groupBy("kind").agg(F.count("*").alias("blocks"), F.sum("n").alias("n")).collect()}
    n_blocks, n_queries = sums.get("candidates", (0, 0))[0], sums.get("queries", (0, 0))[1]
    parts = max(1, -(-n_queries // query_size))
    first = blocks.where("kind = 'candidates'").orderBy(F.desc("norm"), "block").limit(1).collect()
    queries = _merged(blocks.where("kind = 'queries'").repartition(parts))
    queries = written(_seeded(queries, first[0].asDict(), k) if first else queries.withColumn("seed", F.lit(b"")), "queries")
    groups = max(1, -(-n_blocks // group))
    left = blocks.where("kind = 'candidates'").select("n", "dims", "wide", "ids", "rows", "cells", F.pmod(F.xxhash64("block"), F.lit(groups)).alias("g"))
    right = queries.select(*[F.col(c).alias(f"q_{c}") for c in ("block", "n", "dims", "wide", "ids", "rows", "cells", "seed")])
    wide = left.withColumn("q_block", F.explode(F.transform(F.sequence(F.lit(0), F.lit(parts - 1)), lambda i: i.cast("string"))))
    right = right.withColumn("g", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(groups - 1).cast("long"))))
    met = wide.join(right, ["q_block", "g"]).repartition("q_block", "g").sortWithinPartitions("q_block", "g")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, best = None, None
        for b in batches:
            for r in b.to_pylist():
                if (r["q_block"], r["g"]) != now:
                    if best is not None:
                        yield best.rows_out(now[0])
                    now = r["q_block"], r["g"]
                    best = Best(_unpacked(r["q_n"], r["q_dims"], r["q_wide"], r["q_cells"]).T, np.frombuffer(r["q_ids"], np.int64), np.frombuffer(r["q_rows"], np.int64), k, np.frombuffer(r["q_seed"], np.float64))
                best.add(_unpacked(r["n"], r["dims"], r["wide"], r["cells"]), np.frombuffer(r["ids"], np.int64), np.frombuffer(r["rows"], np.int64))
        if best is not None:
            yield best.rows_out(now[0])

    found = met.mapInArrow(tb.returning(run), "block string, at int, query_id long, vec_id long, row long, score long")
    order = Window.partitionBy("block", "at").orderBy(F.desc("score"), "vec_id", "row")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
