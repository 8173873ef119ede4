"""Quality classifier: a regularised quadratic discriminant over transformed document statistics.

Each class has a mean and a covariance shrunk towards the pooled one and towards its own mean variance; how far is chosen on
folds of the training rows. A document's score is the logistic of the difference of the classes' log densities, each from a
Mahalanobis distance by the inverse of a Cholesky factor that is computed once.
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

_UPPER = np.zeros(256, bool)
_UPPER[65:91] = True
_ALPHA = np.zeros(256, bool)
_ALPHA[65:91] = _ALPHA[97:123] = _ALPHA[128:] = True
_DIGIT = np.zeros(256, bool)
_DIGIT[48:58] = True
_STOP = np.zeros(256, bool)
_STOP[[33, 44, 46, 58, 59, 63]] = True
_MARK = np.zeros(256, bool)
_MARK[33:127] = True
_MARK &= ~(_ALPHA | _DIGIT | _STOP)

FEATURES = (
    "word_length", "word_length_spread", "upper", "digits", "stops", "exclamations", "marks",
    "bars", "lines", "long_words", "short_words", "capital_words", "repeated_words", "non_ascii",
)


#: Bytes and words that each row is taken to hold besides its own, in the shares that are usual, so that the shares of a short text stay near those.
PRIOR_BYTES, PRIOR_WORDS = 100, 16

#: Shrinkage towards the pooled covariance and towards the sphere, of which the folds choose, and the number of folds.
TO_POOLED, TO_SPHERE, FOLDS = (0.02, 0.1, 0.3), (0.005, 0.02, 0.1), 4

#: Counted in each row: bytes, words, then sums over words or bytes.
N_COUNTS = 16


def counted(raw: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Counts of each row, N_COUNTS wide; zeros for an empty one."""
    w = tb.words(raw, at, tb.NOT_SPACE)
    count, size = np.diff(w.row_at), w.end - w.start
    h = tb.hashes(tb.lower(raw), w.start, w.end)
    row = np.repeat(np.arange(len(count)), count)
    order = np.lexsort((h, row))
    again = np.zeros(len(h), bool)
    if len(h):
        again[1:] = (h[order][1:] == h[order][:-1]) & (row[order][1:] == row[order][:-1])
    capital = _UPPER[raw[w.start]] & ((size < 2) | _UPPER[raw[np.minimum(w.start + 1, max(len(raw) - 1, 0))]]) if len(size) else np.zeros(0, bool)
    of_bytes = [_UPPER[raw], _DIGIT[raw], _STOP[raw], raw == 33, _MARK[raw], raw == 124, raw == 10, raw >= 128]
    of_words = [size, size * size, size > 20, size <= 3, capital, again]
    return np.stack([np.diff(at), count, *(tb.row_sums(x, at) for x in of_bytes), *(tb.row_sums(x, w.row_at) for x in of_words)], axis=1).astype(np.float64)


def transformed(c: np.ndarray, usual: np.ndarray) -> np.ndarray:
    """Statistics from counts: logs of sizes, square roots of shares, each with its share of the prior. All are finite.

    ``usual``: counts of the text whose shares the prior has.
    """
    per_byte, per_word = usual[2:10] / max(usual[0], 1.0), usual[10:] / max(usual[1], 1.0)
    of_bytes = (c[:, 2:10] + per_byte * PRIOR_BYTES) / (c[:, :1] + PRIOR_BYTES)
    of_words = (c[:, 10:] + per_word * PRIOR_WORDS) / (c[:, 1:2] + PRIOR_WORDS)
    mean = of_words[:, 0]
    spread = np.sqrt(np.maximum(of_words[:, 1] - mean**2, 0))
    upper, digits, stops, exclamations, marks, bars, lines, non_ascii = np.sqrt(of_bytes).T
    long, short, capital, again = np.sqrt(of_words[:, 2:]).T
    return np.stack([np.log1p(mean), np.log1p(spread), upper, digits, stops, exclamations, marks, bars, lines, long, short, capital, again, non_ascii], axis=1)


def with_counts(docs: DataFrame, text: str = "text") -> DataFrame:
    """(doc_id, c) for every row; whole texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b in tb.pieces(batch, "t"):
                c = counted(*tb.buffers(b.column("t")))
                values = pa.ListArray.from_arrays(pa.array(np.arange(0, c.size + 1, c.shape[1], dtype=np.int32)), pa.array(c.ravel()))
                yield pa.record_batch([b.column("doc_id"), values], names=["doc_id", "c"])

    return docs.select("doc_id", F.col(text).alias("t")).mapInArrow(tb.returning(run), "doc_id long, c array<double>")


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, width)


@dataclass
class Discriminant:
    """Per class: prior, mean, inverse Cholesky factor, log determinant; statistics are scaled first."""

    centre: np.ndarray
    scale: np.ndarray
    means: np.ndarray
    factors: np.ndarray
    log_dets: np.ndarray
    log_priors: np.ndarray

    @staticmethod
    def of(n: np.ndarray, first: np.ndarray, second: np.ndarray, to_pooled: float, to_sphere: float) -> Discriminant:
        """From each class's count, sums and sums of products. A class without rows takes the pooled moments, and the prior of one row."""
        d = first.shape[1]
        total = max(n.sum(), 1.0)
        centre = first.sum(axis=0) / total
        scale = np.sqrt(np.maximum(np.diag(second.sum(axis=0)) / total - centre**2, 1e-6))
        means = np.stack([f / k if k else centre for f, k in zip(first, n, strict=True)])
        raw = [s / k - np.outer(m, m) if k else np.zeros((d, d)) for s, k, m in zip(second, n, means, strict=True)]
        covs = [c / np.outer(scale, scale) for c in raw]
        pooled = sum(k * c for k, c in zip(n, covs, strict=True)) / total
        factors, dets = [], []
        for c, k in zip(covs, n, strict=True):
            c = (1 - to_pooled) * c + to_pooled * pooled if k else pooled
            c = (1 - to_sphere) * c + to_sphere * max(np.trace(c) / d, 1e-3) * np.eye(d)
            lower = np.linalg.cholesky(c)
            factors.append(np.linalg.inv(lower))
            dets.append(2 * np.log(np.diag(lower)).sum())
        prior = np.maximum(n, 1.0)
        return Discriminant(centre, scale, (means - centre) / scale, np.stack(factors), np.array(dets), np.log(prior / prior.sum()))

    def score(self, x: np.ndarray, temper: float = 1.0) -> np.ndarray:
        """Probability of class 1; ``temper`` divides the difference of log densities."""
        z = (x - self.centre) / self.scale
        density = []
        for m, f, det in zip(self.means, self.factors, self.log_dets, strict=True):
            y = (z - m) @ f.T
            density.append(-0.5 * ((y * y).sum(axis=1) + det))
        gap = np.clip((density[1] - density[0]) / temper + self.log_priors[1] - self.log_priors[0], -700, 700)
        return 1 / (1 + np.exp(-gap))


def _moments(labelled: DataFrame, usual: np.ndarray) -> np.ndarray:
    """Count, sums and sums of products of the statistics of ``labelled(fold, label, c)``, FOLDS x 2 of them."""
    d = len(FEATURES)
    width = 1 + d + d * d

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros((2 * FOLDS, width))
        for b in batches:
            x = transformed(_matrix(b.column("c"), N_COUNTS), usual)
            part = 2 * b.column("fold").to_numpy() + b.column("label").to_numpy()
            for k in np.unique(part):
                own = x[part == k]
                sums[k] += np.r_[len(own), own.sum(axis=0), (own.T @ own).ravel()]
        yield pa.record_batch([pa.array(np.arange(sums.size, dtype=np.int32)), pa.array(sums.ravel())], names=["k", "v"])

    out = np.zeros(2 * FOLDS * width)
    for r in labelled.select("fold", "label", "c").mapInArrow(tb.returning(run), "k int, v double").groupBy("k").agg(F.sum("v").alias("v")).collect():
        out[r.k] = r.v
    return out.reshape(FOLDS, 2, width)


def _model(sums: np.ndarray, to_pooled: float, to_sphere: float) -> Discriminant:
    d = len(FEATURES)
    return Discriminant.of(sums[:, 0], sums[:, 1 : 1 + d], sums[:, 1 + d :].reshape(2, d, d), to_pooled, to_sphere)


def fit(labelled: DataFrame) -> tuple[Discriminant, np.ndarray]:
    """(model, usual counts) from ``labelled(doc_id, label, c)``, whose labels are 0 or 1: from all its rows.

    The usual shares are those of all rows of label 1. Of each pair of shrinkages, models of all folds but one are asked for
    the labels of that one; the pair of least mean log loss is taken, and the model made of all folds.
    """
    usual = np.zeros(N_COUNTS)
    for r in labelled.where("label = 1").select(F.posexplode("c").alias("k", "v")).groupBy("k").agg(F.sum("v").alias("v")).collect():
        usual[r.k] = r.v
    sums = _moments(labelled, usual)
    grid = [(p, s) for p in TO_POOLED for s in TO_SPHERE]
    models = [[_model(sums.sum(axis=0) - sums[f], *g) for f in range(FOLDS)] for g in grid]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        loss = np.zeros(len(grid))
        for b in batches:
            x, y, fold = transformed(_matrix(b.column("c"), N_COUNTS), usual), b.column("label").to_numpy(), b.column("fold").to_numpy()
            for f in np.unique(fold):
                own = fold == f
                for k, m in enumerate(models):
                    p = np.clip(m[f].score(x[own]), 1e-6, 1 - 1e-6)
                    loss[k] -= np.log(np.where(y[own] == 1, p, 1 - p)).sum()
        yield pa.record_batch([pa.array(np.arange(len(grid), dtype=np.int32)), pa.array(loss)], names=["k", "v"])

    losses = {r.k: r.v for r in labelled.select("fold", "label", "c").mapInArrow(tb.returning(run), "k int, v double").groupBy("k").agg(F.sum("v").alias("v")).collect()}
    best = min(range(len(grid)), key=lambda k: (losses.get(k, 0.0), k))
    return _model(sums.sum(axis=0), *grid[best]), usual


def score(counts: DataFrame, model: Discriminant, usual: np.ndarray, temper: float = 1.0) -> DataFrame:
    """(doc_id, score) from ``counts(doc_id, c)``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.record_batch([b.column("doc_id"), pa.array(model.score(transformed(_matrix(b.column("c"), N_COUNTS), usual), temper))], names=["doc_id", "score"])

    return counts.mapInArrow(tb.returning(run), "doc_id long, score double")


def quality_scores(docs: DataFrame, labels: DataFrame, teaches, text: str = "text", label: str = "quality") -> DataFrame:
    """(doc_id, score) for every row of ``docs``, learned from the labels of the doc_ids that the condition ``teaches`` keeps.

    Null and empty texts have the counts of an empty text. Every label row of a document counts, once for each row that has
    its doc_id; null labels and labels other than 0 and 1 do not. Without labels all scores are 0.5.
    """
    narrow_batches(docs.sparkSession)
    counts = written(with_counts(docs, text), "counts")
    rows = labels.where(teaches).select("doc_id", F.col(label).cast("int").alias("label")).where("label in (0, 1)")
    fold = F.pmod(F.xxhash64("doc_id"), F.lit(FOLDS)).cast("int").alias("fold")
    return score(counts, *fit(written(rows.join(counts, "doc_id").select(fold, "label", "c"), "labelled")))
