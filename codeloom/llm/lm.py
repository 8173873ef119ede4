"""LM scoring with an n-gram model held in Elias-Fano tries.

Documents are read in blocks of tokens. For each length of context a block sends each shard, by context, its distinct (context,
successor) pairs with their training counts; the shard adds the blocks up, builds its trie of quantised smoothed probabilities,
and answers every block's pairs from it; the block's documents are then scored. Pairs are aggregated before they travel.

A context that follows more than a shard's share of all tokens is split over parts by the successor's key, each part a context
of its own in the tries. Which contexts those are, and their totals over all parts, are two short lists: at most two contexts a
shard can be that frequent.

P(w | c) = max(n(c, w) - d, 0) / n(c) + d * t(c) / n(c) * P(w | c'), with t(c) the successors of c and c' the context without
its first word; P(w) = (n(w) + 0.1) / (N + 0.1 (V + 1)) after none; P(w | c') alone after an unknown context. The first term and
the weight of the shorter context are what is quantised.
"""

from __future__ import annotations

import shutil
import tempfile
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textbuf as tb
from .eliasfano import Trie
from .scratch import narrow_batches, written

DISCOUNT = 0.75
ADDED = 0.1

#: Keys of the document's start, which is a context only, and of its end, which is a token and never a context.
START, END = (np.uint64(tb.hash_word(w)) for w in (b"\n<start>\n", b"\n<end>\n"))

#: log10 values from 0 down, in steps; 0 is kept for none.
STEP = 1.0 / 2048

_SENT = "block string, shard int, doc_ids array<long>, held array<boolean>, row_at binary, tokens binary, contexts binary, n_next binary, words binary, counts binary"
_BACK = "block string, shard int, n_tokens long, n_words long, split array<struct<context: long, n: long, n_next: long>>, totals binary, weights binary, values binary"

_ODD = np.uint64(0x9E3779B97F4A7C15)


def _pack(x: np.ndarray) -> bytes:
    """Bytes of one significance together, then compressed."""
    planes = np.ascontiguousarray(x.view(np.uint8).reshape(len(x), x.itemsize).T) if len(x) else np.zeros(0, np.uint8)
    return zstandard.ZstdCompressor(level=1).compress(planes.tobytes())


def _unpack(b: bytes, kind) -> np.ndarray:
    kind = np.dtype(kind)
    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(b), np.uint8)
    return np.ascontiguousarray(raw.reshape(kind.itemsize, -1).T).view(kind).ravel() if len(raw) else np.zeros(0, kind)


def quantised(log_p: np.ndarray) -> np.ndarray:
    return np.clip(np.rint(-log_p / STEP) + 1, 1, 65535).astype(np.uint16)


def restored(code: np.ndarray) -> np.ndarray:
    """Probabilities; 0 for code 0."""
    return np.where(code > 0, 10.0 ** (-(code.astype(np.float64) - 1) * STEP), 0.0)


def _block_texts(name: str, doc_ids: list, held: list, tokens: np.ndarray, row_at: np.ndarray) -> Iterator[dict]:
    """``tokens``: keys of all tokens, each row closed by END; ``row_at``: row offsets in them."""
    keys, which = np.unique(tokens, return_inverse=True)
    yield {"block": name, "shard": -1, "doc_ids": doc_ids, "held": held, "row_at": _pack(row_at), "tokens": _pack(which.astype(np.uint32)), "contexts": _pack(keys)}


def contexts_of(tokens: np.ndarray, row_at: np.ndarray, length: int) -> np.ndarray:
    """The key of the ``length`` tokens before each token, those before the first one being START; a single one's is its own."""
    context = np.empty_like(tokens)
    context[1:] = tokens[:-1]
    context[row_at[:-1]] = START
    last, first = context, START
    with np.errstate(over="ignore"):
        for _ in range(length - 1):
            longer = np.empty_like(context)
            longer[1:] = tb.mix(context[:-1] * _ODD + last[1:])
            first = tb.mix(np.array([first]) * _ODD + START)[0]
            longer[row_at[:-1]] = first
            context = longer
    return context


def _found(sorted_keys: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Place of each key, -1 if it is none of them."""
    if not len(sorted_keys):
        return np.full(len(keys), -1)
    at = np.minimum(np.searchsorted(sorted_keys, keys), len(sorted_keys) - 1)
    return np.where(sorted_keys[at] == keys, at, -1)


@dataclass
class Split:
    """The contexts of one length that are split, by key, and the number of their parts; after training their totals and successors."""

    keys: np.ndarray
    parts: np.ndarray
    totals: np.ndarray | None = None
    n_next: np.ndarray | None = None

    @staticmethod
    def part_keys(context: np.ndarray, part: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            return tb.mix(context + (part.astype(np.uint64) + np.uint64(1)) * _ODD)

    def divided(self, context: np.ndarray, tokens: np.ndarray) -> np.ndarray:
        """``context`` with the key of the token's part in place of each split one."""
        at = _found(self.keys, context)
        mine = np.flatnonzero(at >= 0)
        if not len(mine):
            return context
        out = context.copy()
        out[mine] = self.part_keys(context[mine], tokens[mine] % self.parts[at[mine]].astype(np.uint64))
        return out

    def whole(self, keys: np.ndarray) -> np.ndarray:
        """Place of the split context of which each key is a part, -1 for all other keys."""
        if not len(self.keys):
            return np.full(len(keys), -1)
        of = np.repeat(np.arange(len(self.keys)), self.parts)
        part = np.arange(len(of)) - np.repeat(np.cumsum(self.parts) - self.parts, self.parts)
        own = self.part_keys(self.keys[of], part)
        order = np.argsort(own)
        at = _found(own[order], keys)
        return np.where(at >= 0, of[order][at], -1)


def _pairs(tokens: np.ndarray, row_at: np.ndarray, length: int, split: Split) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(sorted word keys, sorted context keys, each token's place in the contexts times the number of words plus its place in the words)."""
    keys, pair = np.unique(tokens, return_inverse=True)
    context = split.divided(contexts_of(tokens, row_at, length), tokens)
    own, place = np.unique(context, return_inverse=True)
    return keys, own, pair + place * len(keys)


def _block_pairs(name: str, shards: int, held: list, tokens: np.ndarray, row_at: np.ndarray, length: int, split: Split) -> Iterator[dict]:
    """A row for each shard of the contexts of one length; those of length k are numbered from (k - 1) * shards."""
    keys, own, pair = _pairs(tokens, row_at, length, split)
    teaches = np.repeat(~np.array(held, bool), np.diff(row_at))
    order = np.argsort(pair, kind="stable")
    pair = pair[order]
    first = np.r_[0, np.flatnonzero(np.diff(pair)) + 1] if len(pair) else np.zeros(0, np.int64)
    counts = np.add.reduceat(teaches[order].astype(np.int64), first) if len(first) else first
    c, w = np.divmod(pair[first], max(len(keys), 1))
    del order, pair, teaches
    shard = (own % np.uint64(shards)).astype(np.int64)[c]
    by = np.argsort(shard, kind="stable")
    at = np.searchsorted(shard[by], np.arange(shards + 1))
    for s in range(shards):
        mine = by[at[s] : at[s + 1]]
        if len(mine):  # by context, then by the successor's key, as the pairs are
            ctx, n_next = np.unique(c[mine], return_counts=True)
            yield {
                "block": name, "shard": (length - 1) * shards + s, "contexts": _pack(own[ctx]), "n_next": _pack(n_next.astype(np.uint32)),
                "words": _pack(keys[w[mine]]), "counts": _pack(np.minimum(counts[mine], (1 << 32) - 1).astype(np.uint32)),
            }


_ARROW = pa.schema([
    ("block", pa.string()), ("shard", pa.int32()), ("doc_ids", pa.list_(pa.int64())), ("held", pa.list_(pa.bool_())),
    *((c, pa.binary()) for c in ("row_at", "tokens", "contexts", "n_next", "words", "counts")),
])


def _blocks(batches: Iterator[pa.RecordBatch], block_tokens: int) -> Iterator[tuple[str, list, list, np.ndarray, np.ndarray]]:
    """(name, ids, held out, keys of tokens, row offsets) of runs of rows of an input partition, the same whenever it is read."""
    from pyspark import TaskContext

    task, serial = TaskContext.get().partitionId(), 0
    parts: list[tuple] = []

    def block() -> tuple[str, list, list, np.ndarray, np.ndarray]:
        ids, flags = [i for p in parts for i in p[0]], [h for p in parts for h in p[1]]
        tokens = np.concatenate([p[2] for p in parts])
        row_at = np.r_[0, np.cumsum(np.concatenate([p[3] for p in parts]))].astype(np.int64)
        parts.clear()
        return f"{task}-{serial}", ids, flags, tokens, row_at

    for batch in batches:
        for b in tb.pieces(batch, "t", 2 << 20):
            raw, at = tb.buffers(b.column("t"))
            raw = tb.lower(raw)
            w = tb.words(raw, at, tb.NOT_SPACE)
            n = np.diff(w.row_at) + 1
            tokens = np.full(int(n.sum()), END, np.uint64)
            inner = np.ones(len(tokens), bool)
            inner[np.cumsum(n) - 1] = False
            tokens[inner] = tb.hashes(raw, w.start, w.end)
            parts.append((b.column("doc_id").to_pylist(), [bool(h) for h in b.column("held").to_pylist()], tokens, n))
            if sum(len(p[2]) for p in parts) >= block_tokens:
                yield block()
                serial += 1
    if parts:
        yield block()


def splits(source: DataFrame, shards: int, order: int, block_tokens: int) -> list[Split]:
    """For each length of context the contexts to split: all that come before 1 of ``shards`` of the tokens, none before less than half of that.

    A block tells of the contexts before half of that share of its own tokens, so what a block leaves out of a context is less than
    half of that share of all. At most 2 * ``shards`` contexts of a length are read by the driver.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, _, _, tokens, row_at in _blocks(batches, block_tokens):
            told = [(0, np.zeros(1, np.uint64), np.array([len(tokens)]))]
            for length in range(1, order):
                context, n = np.unique(contexts_of(tokens, row_at, length), return_counts=True)
                often = n * 2 * shards >= len(tokens)
                told.append((length, context[often], n[often]))
            for length, context, n in told:
                yield pa.record_batch([pa.array(np.full(len(n), length, np.int32)), pa.array(context.view(np.int64)), pa.array(n.astype(np.int64))], names=["length", "context", "n"])

    told = written(source.mapInArrow(tb.returning(run), "length int, context long, n long"), "frequent")
    n_all = told.where("length = 0").agg(F.sum("n")).first()[0] or 0
    often = told.where("length > 0").groupBy("length", "context").agg(F.sum("n").alias("n")).where(F.col("n") * (2 * shards) >= n_all).collect()
    out = []
    for length in range(1, order):
        mine = sorted((int(np.int64(r.context).astype(np.uint64)), r.n) for r in often if r.length == length)
        parts = np.array([min(shards, -(-n * 2 * shards // n_all)) for _, n in mine], np.int64)
        out.append(Split(np.array([k for k, _ in mine], np.uint64), parts))
    return out


def sent(source: DataFrame, shards: int, block_tokens: int, split: list[Split] | None) -> DataFrame:
    """The rows of each block: with ``split`` one for each shard with the pairs it asks for and their counts, else one with its documents.

    Both forms are made from the texts, which costs less than to keep the one while the other travels.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for name, ids, held, tokens, row_at in _blocks(batches, block_tokens):
            if split is None:
                rows = _block_texts(name, ids, held, tokens, row_at)
            else:
                rows = (r for i, one in enumerate(split) for r in _block_pairs(name, shards, held, tokens, row_at, i + 1, one))
            for r in rows:
                yield pa.RecordBatch.from_pylist([r], schema=_ARROW)

    return source.mapInArrow(tb.returning(run), _SENT)


def answered(asked: DataFrame, shards: int, split: list[Split]) -> DataFrame:
    """For each block and shard, each context's count and weight and each pair's value, in the order they were asked for."""
    parts = pa.list_(pa.struct([("context", pa.int64()), ("n", pa.int64()), ("n_next", pa.int64())]))
    schema = pa.schema([("block", pa.string()), ("shard", pa.int32()), ("n_tokens", pa.int64()), ("n_words", pa.int64()), ("split", parts), *((c, pa.binary()) for c in ("totals", "weights", "values"))])

    def answer(table: pa.Table) -> pa.Table:
        folder = tempfile.mkdtemp(prefix="trie-")
        try:
            asks = table.sort_by("block").to_pylist()
            trie, totals, weights, n_next_of = _trained(asks, folder)
            length = asks[0]["shard"] // shards
            of = split[length].whole(trie.contexts)
            told = [{"context": int(split[length].keys[of[i]].view(np.int64)), "n": int(totals[i]), "n_next": int(n_next_of[i])} for i in np.flatnonzero(of >= 0)]
            whole = of < 0
            n_tokens, n_words = (int(totals[whole].sum()), int((whole & (trie.contexts != START)).sum())) if length == 0 else (0, 0)
            out = []
            for i, r in enumerate(asks):
                ctx, n_next = _unpack(r["contexts"], np.uint64), _unpack(r["n_next"], np.uint32)
                rank = trie.context_ranks(ctx)
                known = rank >= 0
                value = trie.find(np.repeat(rank, n_next), _unpack(r["words"], np.uint64))
                total, weight = np.zeros(len(ctx), np.int64), np.zeros(len(ctx), np.uint16)
                total[known], weight[known] = totals[rank[known]], weights[rank[known]]
                # what the shard knows of all tokens and of its parts of split contexts goes with its first answer
                out.append({
                    "block": r["block"], "shard": r["shard"], "n_tokens": n_tokens if i == 0 else 0, "n_words": n_words if i == 0 else 0, "split": told if i == 0 else [],
                    "totals": _pack(total), "weights": _pack(weight), "values": _pack(value),
                })
            return pa.Table.from_pylist(out, schema=schema)
        finally:
            shutil.rmtree(folder, ignore_errors=True)

    return asked.select("block", "shard", "contexts", "n_next", "words", "counts").groupBy("shard").applyInArrow(answer, _BACK)


def _trained(asks: list[dict], folder: str) -> tuple[Trie, np.ndarray, np.ndarray, np.ndarray]:
    """(trie, training count of each context, its weight's code, its number of successors) of a shard's asks."""
    contexts, words, counts = [], [], []
    for r in asks:
        n = _unpack(r["counts"], np.uint32)
        some = n > 0
        contexts.append(np.repeat(_unpack(r["contexts"], np.uint64), _unpack(r["n_next"], np.uint32))[some])
        words.append(_unpack(r["words"], np.uint64)[some])
        counts.append(n[some].astype(np.int64))
    ctx, word, n = (np.concatenate(x) for x in (contexts, words, counts))
    own, rank = np.unique(ctx, return_inverse=True)
    known, word = np.unique(word, return_inverse=True)
    pair = (rank.astype(np.uint64) << np.uint64(32)) | word.astype(np.uint64)
    order = np.argsort(pair, kind="stable")
    pair = pair[order]
    first = np.r_[0, np.flatnonzero(np.diff(pair)) + 1] if len(pair) else np.zeros(0, np.int64)
    n = np.add.reduceat(n[order], first) if len(first) else n
    pair = pair[first]
    rank = (pair >> np.uint64(32)).astype(np.int64)
    next_ = np.bincount(rank, minlength=len(own))
    total = np.bincount(rank, n, len(own)).astype(np.int64)
    value = quantised(np.log10((n - DISCOUNT) / np.maximum(total[rank], 1)))
    weight = quantised(np.log10(DISCOUNT * next_ / np.maximum(total, 1)))
    trie = Trie.write(folder, own, next_, known[(pair & np.uint64(0xFFFFFFFF)).astype(np.int64)], value)
    return trie, total, weight, next_


def scored(rows: DataFrame, shards: int, split: list[Split], n_tokens: int, n_words: int) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score) from blocks and their answers."""
    names = ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"]
    schema = pa.schema(list(zip(names, [pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.float64()], strict=True)))

    def told(answers: list[dict], own: np.ndarray, pair: np.ndarray, n_keys: int, block: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(count of each context, its weight, value of each pair) in the order of ``own`` and ``pair``; a block asks by shard, then context, then word."""
        shard = (own % np.uint64(shards)).astype(np.int64)
        pc, pw = np.divmod(pair, max(n_keys, 1))
        value = np.zeros(len(pair), np.float64)
        total, weight = np.zeros(len(own), np.int64), np.zeros(len(own), np.float64)
        if answers:
            values = np.concatenate([_unpack(a["values"], np.uint16) for a in answers])
            if len(values) != len(pair):
                raise ValueError(f"block {block} was read with other texts before")
            value[np.lexsort((pw, pc, shard[pc]))] = restored(values)
            at = np.argsort(shard, kind="stable")
            total[at] = np.concatenate([_unpack(a["totals"], np.int64) for a in answers])
            weight[at] = restored(np.concatenate([_unpack(a["weights"], np.uint16) for a in answers]))
        return total, weight, value

    def score(table: pa.Table) -> pa.Table:
        parts = sorted(table.to_pylist(), key=lambda r: r["shard"])
        block = parts[0]
        keys, which = _unpack(block["contexts"], np.uint64), _unpack(block["tokens"], np.uint32).astype(np.int64)
        row_at = _unpack(block["row_at"], np.int64)
        tokens = keys[which]
        p, base, known = None, None, None
        for i, one in enumerate(split):
            _, own, pair = _pairs(tokens, row_at, i + 1, one)
            pair, back = np.unique(pair, return_inverse=True)
            pc, pw = np.divmod(pair, max(len(keys), 1))
            answers = [r for r in parts[1:] if r["shard"] // shards == i]
            total, weight, value = told(answers, own, pair, len(keys), block["block"])
            if p is None:
                # each word but the end is a context of the block; the end is as frequent as the start
                asked = np.where(keys == END, START, keys)
                whole, place = _found(one.keys, asked), _found(own, asked)
                count = np.where(place >= 0, total[place], 0)
                count[whole >= 0] = one.totals[whole[whole >= 0]]
                p_word = (count + ADDED) / (n_tokens + ADDED * (n_words + 1))
                p, base, known = p_word[which], np.add.reduceat(np.log10(p_word)[which], row_at[:-1]), tb.row_sums(count[which] > 0, row_at)
            # a part of a split context knows shares of its own total only
            whole = one.whole(own)
            mine = np.flatnonzero(whole >= 0)
            share = np.ones(len(own))
            n_whole = np.maximum(one.totals[whole[mine]], 1)
            share[mine] = total[mine] / n_whole
            total[mine], weight[mine] = one.totals[whole[mine]], DISCOUNT * one.n_next[whole[mine]] / n_whole
            c = pc[back]
            p = np.where(total[c] == 0, p, (value * share[pc])[back] + weight[c] * p)
        logs = np.log10(np.minimum(p, 1.0))
        # every row has a token; each row is summed on its own
        n = len(row_at) - 1
        columns = [block["doc_ids"], block["held"], np.diff(row_at), known, np.full(n, n_tokens), base, np.add.reduceat(logs, row_at[:-1])]
        return pa.Table.from_arrays([pa.array(x, f.type) for x, f in zip(columns, schema, strict=True)], schema=schema)

    return rows.groupBy("block").applyInArrow(score, "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")


def text_scores(docs: DataFrame, held, text: str = "text", order: int = 2, shards: int | None = None, block_tokens: int = 3 << 19) -> DataFrame:
    """Scores of every row of ``docs`` under a model of the rows that the condition ``held`` does not keep.

    Null texts are empty: their one token is the end. Repeated rows count and are scored each. With no training row, every
    probability is that of an unseen word. ``order``: tokens of the longest n-gram, 2 at least. ``shards`` defaults to twice the
    number of input partitions, so that what a shard holds stays as large as what a block sends; a block sends a row to each
    shard, so ``block_tokens`` should grow with their number. Other columns are not read; an empty table gives none. ``docs`` must
    be read from files or a written table, so that its blocks are the same each time: a block whose answers are those of other
    pairs is an error.
    """
    if order < 2:
        raise ValueError("order must be 2 at least")
    narrow_batches(docs.sparkSession)
    shards = shards or max(8, 2 * docs.select("doc_id").rdd.getNumPartitions())
    source = docs.select("doc_id", F.col(text).alias("t"), held.alias("held"))
    split = splits(source, shards, order, block_tokens)
    answers = written(answered(sent(source, shards, block_tokens, split), shards, split), "answers")
    sums = answers.agg(F.sum("n_tokens"), F.sum("n_words")).first()
    # contexts count every word once and each document once by its start, which stands for its end
    n_tokens, n_words = int(sums[0] or 0), int(sums[1] or 0)
    parts = answers.select(F.floor(F.col("shard") / shards).cast("int").alias("i"), F.explode("split").alias("s")).groupBy("i", "s.context").agg(F.sum("s.n").alias("n"), F.sum("s.n_next").alias("n_next")).collect()
    for i, one in enumerate(split):
        found = {int(np.int64(r.context).astype(np.uint64)): r for r in parts if r.i == i}
        one.totals = np.array([found[int(k)].n if int(k) in found else 0 for k in one.keys], np.int64)
        one.n_next = np.array([found[int(k)].n_next if int(k) in found else 0 for k in one.keys], np.int64)
    n_tokens += int(split[0].totals.sum())
    n_words += int(((split[0].totals > 0) & (split[0].keys != START)).sum())
    empty = [F.lit(None).cast("binary").alias(c) for c in ("totals", "weights", "values")]
    own = sent(source, shards, block_tokens, None).select("block", "shard", "doc_ids", "held", "row_at", "tokens", "contexts", *empty)
    none = [F.lit(None).cast(t).alias(c) for c, t in (("doc_ids", "array<long>"), ("held", "array<boolean>"), ("row_at", "binary"), ("tokens", "binary"))]
    back = answers.select("block", "shard", *none, F.lit(None).cast("binary").alias("contexts"), "totals", "weights", "values")
    words = n_words + (1 if n_tokens else 0)
    return scored(own.unionByName(back), shards, split, n_tokens, words)
