"""BPE encoding and decoding, with tree concatenation for long texts.

A text is cut where no pre-token can reach across. A stretch that is still long there - one pre-token, such as a megabyte of
letters without a space - is halved again and again; the leaves are encoded in parallel and joined upwards. At a join, a
window of tokens on both sides is encoded afresh and grown until it ends with a token of the left side and of the right
side that stand at the same places as before. Then every two neighbouring tokens of the result are neighbours in some
encoding, which for rank-ordered merges makes it the encoding of the whole.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from . import textbuf as tb
from .scratch import carried, narrow_batches, spread

#: Texts of more characters are cut; stretches of more are halved down to leaves of at most half of this.
LONG = 1 << 14

#: Bytes of the texts that short stretches are joined to.
JOINED = 1 << 13

#: Ids decoded at once.
DECODED = 1 << 16

_OPENED: dict[str, Codec] = {}

_BLANK = " \t\n\r\f\v"


def _cuts(raw: np.ndarray) -> np.ndarray:
    """Where a blank follows a character that is certainly no white space."""
    blank = ~tb.NOT_SPACE[raw]
    out = np.zeros(len(raw), bool)
    out[1:] = blank[1:] & ~blank[:-1]
    # white space beyond ASCII starts with the byte C2, E1, E2 or E3
    wide = np.zeros(len(raw), bool)
    wide[2:] = (raw[1:-1] >= 0x80) & ((raw[:-2] == 0xC2) | (raw[:-2] >= 0x80))
    three = np.zeros(len(raw), bool)
    three[3:] = (raw[:-3] >= 0xE1) & (raw[:-3] <= 0xE3)
    two = np.zeros(len(raw), bool)
    two[2:] = raw[:-2] == 0xC2
    return out & ~(wide & (two | three))


class Codec:
    """A byte-level BPE tokenizer read from the file of the tokenizers library at ``path``."""

    def __init__(self, path: str, long: int = LONG, threads: int = 2) -> None:
        # short texts are encoded by their task's one thread; the leaves of a long one by a pool of ``threads``
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        self.tok.no_truncation()
        self.tok.no_padding()
        self.long, self.threads = long, threads
        added = [t.content for t in self.tok.get_added_tokens_decoder().values()]
        self.added = re.compile("(" + "|".join(map(re.escape, sorted(added, key=len, reverse=True))) + ")") if added else None
        spec = json.loads(self.tok.to_str())
        pre = spec.get("pre_tokenizer") or {}
        #: Whether white space ends a pre-token for certain, so that what stands between is encoded alike everywhere.
        #: Bytes of each token; a byte is one character of a token's name.
        self.bytes = np.array([len(self.tok.id_to_token(i) or "") for i in range(self.tok.get_vocab_size())], np.int32)
        self.local = not spec.get("normalizer") and pre.get("type") == "ByteLevel" and pre.get("use_regex", True) and not pre.get("add_prefix_space") and not any(re.search(r"\s", c) for c in added)

    @staticmethod
    def at(path: str) -> Codec:
        """One codec for a path in each process."""
        if path not in _OPENED:
            _OPENED[path] = Codec(path)
        return _OPENED[path]

    def _batch(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.tok.encode_batch_fast(texts, add_special_tokens=False)]

    def encode(self, texts: list[str]) -> list[list[int]]:
        """Ids of each text."""
        short = [i for i, t in enumerate(texts) if len(t) <= self.long]
        out: list[list[int]] = [[]] * len(texts)
        for i, ids in zip(short, self._batch([texts[i] for i in short]), strict=True):
            out[i] = ids
        for i, t in enumerate(texts):
            if len(t) > self.long:
                out[i] = self.encode_long(t)
        return out

    def _one_by_one(self, data: bytes, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids, number of ids of each) of stretches of ``data``."""
        known = self.encode([data[a:b].decode("utf-8", "surrogatepass") for a, b in zip(start.tolist(), end.tolist(), strict=True)])
        return np.array([i for x in known for i in x], np.int32), np.array([len(x) for x in known], np.int64)

    def _joined(self, data: bytes, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """As ``_one_by_one``, of stretches from a blank to a character that is no white space: in a row they are cut as they are alone."""
        size = end - start
        done = np.r_[0, np.cumsum(size)]
        group = done[:-1] // JOINED
        cuts = np.r_[0, np.flatnonzero(np.diff(group)) + 1, len(start)] if len(start) else np.zeros(1, np.int64)
        a, b = start.tolist(), end.tolist()
        texts = [b"".join([data[a[i] : b[i]] for i in range(x, y)]).decode("utf-8", "surrogatepass") for x, y in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True)]
        each = self._batch(texts)
        ids = np.concatenate([np.array(x, np.int32) for x in each]) if each else np.zeros(0, np.int32)
        ends = np.cumsum(self.bytes[ids])
        return ids, np.diff(np.searchsorted(ends, done, "right"))

    def encode_column(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(ids of all rows, row offsets, offsets of stretches) of a string column; each distinct stretch from white space to white space is encoded once."""
        raw, at = tb.buffers(column)
        if not self.local:
            each = self.encode([t.as_py() or "" for t in column])
            row_at = np.r_[0, np.cumsum([len(x) for x in each])].astype(np.int64)
            return np.array([i for x in each for i in x], np.int32), row_at, row_at
        start = np.unique(np.concatenate([np.flatnonzero(_cuts(raw)), at[:-1][at[:-1] < at[1:]]])).astype(np.int64)
        end = np.r_[start[1:], len(raw)].astype(np.int64)[: len(start)]
        first, which = tb.distinct(raw, start, end)
        a, b = start[first], end[first]
        row_end = np.zeros(len(raw) + 1, bool)
        row_end[at] = True
        plain = ~tb.NOT_SPACE[raw[a]] & ~row_end[b] & (b - a <= self.long)
        data = raw.tobytes()
        parts = [(np.flatnonzero(own), *how(data, a[own], b[own])) for own, how in ((plain, self._joined), (~plain, self._one_by_one))]
        flat = np.concatenate([p[1] for p in parts])
        base, size = np.zeros(len(first), np.int64), np.zeros(len(first), np.int64)
        before = 0
        for own, ids, n in parts:
            base[own], size[own] = before + np.cumsum(n) - n, n
            before += len(ids)
        done = np.r_[0, np.cumsum(size[which])].astype(np.int64)
        ids = np.empty(int(done[-1]), np.int32)
        for s in range(0, len(which), 1 << 17):
            own = which[s : s + (1 << 17)]
            lo, hi = done[s], done[s + len(own)]
            ids[lo:hi] = flat[np.repeat(base[own] - done[s : s + len(own)], size[own]) + np.arange(lo, hi)]
        return ids, done[np.searchsorted(start, at)], done

    def encode_long(self, text: str) -> list[int]:
        parts = self._cut(text)
        units = [p for p in parts if len(p) <= self.long or self._added_in(p)]
        done = iter(self._batch(units))
        out: list[int] = []
        for p in parts:
            out += next(done) if len(p) <= self.long or self._added_in(p) else self._unsplit(p)
        return out

    def _added_in(self, text: str) -> bool:
        return bool(self.added and self.added.search(text))

    def _cut(self, text: str) -> list[str]:
        """Parts of about ``long`` characters at most where possible; joined, they are the text.

        A cut stands after an added token, before one, or between a character that is no white space and one that is: no
        pre-token holds white space after another character, and none looks behind.
        """
        pieces = [p for p in self.added.split(text) if p] if self.added else [text]
        out = []
        for p in pieces:
            start = 0
            while len(p) - start > self.long:
                cut = start + self.long
                while cut > start and not (p[cut] in _BLANK and not p[cut - 1].isspace()):
                    cut -= 1
                if cut == start:  # none before: the next one after
                    m = re.compile(r"(?<=\S)[ \t\n\r\f\v]").search(p, start + self.long)
                    cut = m.start() if m else len(p)
                    if cut == len(p):
                        break
                out.append(p[start:cut])
                start = cut
            out.append(p[start:])
        return [p for p in out if p]

    def _unsplit(self, text: str) -> list[int]:
        """Ids of a long stretch: its pre-tokens, the long ones by tree concatenation."""
        spans = [s for _, s in self.tok.pre_tokenizer.pre_tokenize_str(text)] if self.tok.pre_tokenizer else [(0, len(text))]
        out: list[int] = []
        held, begin = [], 0
        for s, e in spans:
            if e - s > self.long:
                if begin < s:
                    held.append((begin, s, False))
                held.append((s, e, True))
                begin = e
        if begin < len(text):
            held.append((begin, len(text), False))
        for s, e, long in held:
            # a run of whole pre-tokens can be read differently alone only where white space meets its end
            if long:
                out += self.tree(text[s:e])
            else:
                for a, b in spans:
                    if s <= a and b <= e and b > a:
                        out += self.tree(text[a:b]) if b - a > self.long else self._batch([text[a:b]])[0]
        return out

    def tree(self, text: str, leaf: int | None = None) -> list[int]:
        """Ids of one pre-token from the ids of its halves."""
        leaf = leaf or max(2, self.long // 2)
        count = 1
        while len(text) > count * leaf:
            count *= 2
        edges = [len(text) * i // count for i in range(count + 1)]
        with ThreadPoolExecutor(self.threads) as pool:  # the library encodes without holding the interpreter
            sides = list(pool.map(lambda t: self._batch([t])[0], [text[a:b] for a, b in zip(edges, edges[1:], strict=False)]))
            while len(sides) > 1:
                pairs = range(0, len(sides), 2)
                sides = list(pool.map(lambda i, own=tuple(sides), cut=tuple(edges): self._join(text[cut[i] : cut[i + 2]], cut[i + 1] - cut[i], own[i], own[i + 1]), pairs))
                edges = edges[::2]
        return sides[0]

    def _sizes(self, ids: list[int]) -> np.ndarray:
        """Bytes of each token."""
        return self.bytes[ids].astype(np.int64)

    def _join(self, text: str, middle: int, left: list[int], right: list[int]) -> list[int]:
        raw = text.encode("utf-8", "surrogatepass")
        at = len(text[:middle].encode("utf-8", "surrogatepass"))
        left_end = np.cumsum(self._sizes(left))
        right_end = at + np.cumsum(self._sizes(right))
        k = 4
        while True:
            i, j = max(0, len(left) - k), min(len(right), k)
            s = int(left_end[i - 1]) if i else 0
            e = int(right_end[j - 1]) if j else at
            # whole characters only: a token can end inside one
            while s > 0 and raw[s] & 0xC0 == 0x80:
                i -= 1
                s = int(left_end[i - 1]) if i else 0
            while e < len(raw) and raw[e] & 0xC0 == 0x80:
                j += 1
                e = int(right_end[j - 1])
            window = self._batch([raw[s:e].decode("utf-8", "surrogatepass")])[0]
            ends = s + np.cumsum(self._sizes(window))
            starts = np.r_[s, ends[:-1]]
            known_left = {(int(a), int(b)) for a, b in zip(np.r_[s, left_end[i:-1]] if len(left) > i else [], left_end[i:], strict=False)}
            known_right = {(int(a), int(b)) for a, b in zip(np.r_[at, right_end[: j - 1]] if j else [], right_end[:j], strict=False)}
            first = i == 0 or (int(starts[0]), int(ends[0])) in known_left and ends[0] <= at
            last = j == len(right) or (int(starts[-1]), int(ends[-1])) in known_right and starts[-1] >= at
            if first and last:
                return left[:i] + window + right[j:]
            k *= 2

    def decode(self, batch: list[list[int]]) -> list[str]:
        return self.tok.decode_batch(batch, skip_special_tokens=False)

    def decode_rows(self, ids: np.ndarray, row_at: np.ndarray, done: np.ndarray) -> list[str]:
        """Texts of the rows; a row of many ids is decoded in runs of whole stretches, which begin with a whole character."""
        out = []
        for a, z in zip(row_at[:-1].tolist(), row_at[1:].tolist(), strict=True):
            parts = []
            while a < z:
                b = z
                if z - a > DECODED:
                    i = int(np.searchsorted(done, a + DECODED, "right")) - 1
                    b = int(done[i]) if done[i] > a else int(done[min(i + 1, len(done) - 1)])
                    b = min(z, b) if b > a else z
                parts.append(self.tok.decode(ids[a:b].tolist(), skip_special_tokens=False))
                a = b
            out.append("".join(parts))
        return out


def encoded(docs: DataFrame, path: str, columns: list[str], text: str = "text") -> DataFrame:
    """``columns`` and ids (array<int>) of every row; null and empty texts have none. ``path``: the tokenizer's file, on every executor.

    Repeated rows stay; a column of ``docs`` named ids is replaced.
    """
    return _run(docs, path, columns, text, False)


def encoded_digests(docs: DataFrame, path: str, columns: list[str], text: str = "text") -> DataFrame:
    """``columns`` of every row with n_tokens, the SHA-256 of its ids and that of the text decoded from them; columns of these names are replaced."""
    return _run(docs, path, columns, text, True)


def _run(docs: DataFrame, path: str, columns: list[str], text: str, digests: bool) -> DataFrame:
    narrow_batches(docs.sparkSession)
    names = ["n_tokens", "ids_sha256", "decoded_sha256"] if digests else ["ids"]
    columns = [c for c in columns if c not in names]
    source, schema = carried(docs, columns, text)
    schema = schema("n_tokens long, ids_sha256 string, decoded_sha256 string" if digests else "ids array<int>")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = Codec.at(path)
        for batch in batches:
            for b in tb.pieces(batch, "value"):
                flat, row_at, done = codec.encode_column(b.column(1))
                if digests:
                    ids = flat.astype("<u4", copy=False).view(np.uint8)
                    made = [
                        pa.array(np.diff(row_at)),
                        pa.array([hashlib.sha256(ids[4 * a : 4 * z]).hexdigest() for a, z in zip(row_at[:-1].tolist(), row_at[1:].tolist(), strict=True)]),
                        pa.array([hashlib.sha256(t.encode()).hexdigest() for t in codec.decode_rows(flat, row_at, done)]),
                    ]
                else:
                    made = [pa.ListArray.from_arrays(pa.array(row_at.astype(np.int32)), pa.array(flat))]
                yield pa.record_batch([b.column(0), *made], names=["kept", *names])

    return spread(source.mapInArrow(tb.returning(run), schema), columns, {n: n for n in names})


def decoded(rows: DataFrame, path: str, columns: list[str], ids: str = "ids") -> DataFrame:
    """``columns`` and the text of every row's ``ids``; a null list is an empty one. A column named text is replaced."""
    columns = [c for c in columns if c != "text"]
    source, schema = carried(rows, columns, ids)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = Codec.at(path)
        for batch in batches:
            for s in range(0, batch.num_rows, 256):
                b = batch.slice(s, 256)
                made = codec.decode([x.as_py() or [] for x in b.column(1)])
                yield pa.record_batch([b.column(0), pa.array(made, pa.string())], names=["kept", "text"])

    return spread(source.mapInArrow(tb.returning(run), schema("text string")), columns, {"text": "text"})
