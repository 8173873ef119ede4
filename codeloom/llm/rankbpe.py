"""Byte-level BPE by a file of ranks, encoded and decoded by the tiktoken library.

The pattern of the ranks splits a text into pre-tokens, each merged alone. A long text is first cut where no pre-token can
reach across and none looks across, so that its parts encode as they do inside it. Such a place stands

* before an ASCII blank that follows a character that is no white space,
* between a letter or number and what is neither of them nor white space, or between a letter and a number.

Long runs of white space, which overflow the stack of the library's pattern, are taken out whole: all but the last character
(all of it at the end of the text) is one pre-token, and the last begins the next part. Decoding joins the bytes of the
tokens; a text cut inside a character is still its bytes.
"""

from __future__ import annotations

import base64
import hashlib
import os
import re
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from . import textbuf as tb
from .scratch import carried, narrow_batches, spread

#: Texts of more characters are cut into parts of about so many.
LONG = 1 << 16

#: Runs of white space of so many characters are pre-tokens of their own.
RUN = 1 << 12

# The characters of White_Space, which are what the pattern's \s means.
_WHITE = "\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
_AT_BLANK = re.compile(r"(?<=\S)(?=[ \t\n\r\f\v])")
_AT_KIND = regex.compile(r"(?<=[\p{L}\p{N}])(?=[^\s\p{L}\p{N}])|(?<=\p{L})(?=\p{N})|(?<=\p{N})(?=\p{L})")


def _settled(c: str) -> bool:
    """Whether the character was assigned long ago, so that every library knows its kind."""
    return unicodedata.ucd_3_2_0.category(c) != "Cn"


def _cut(text: str, at: int) -> int:
    """The first safe place from ``at`` on, a blank before all others within a part's length; the end if there is none."""
    m = _AT_BLANK.search(text, at, min(len(text), at + LONG))
    if m and m.start() > 0:
        return m.start()
    for m in _AT_KIND.finditer(text, at):
        if m.start() > 0 and _settled(text[m.start()]) and _settled(text[m.start() - 1]):
            return m.start()
    m = _AT_BLANK.search(text, at)
    return m.start() if m and m.start() > 0 else len(text)


def parts(text: str, long: int = LONG, run: int = RUN) -> Iterator[tuple[str, bool]]:
    """(part, whether it is one pre-token) of a text, in order; joined, the parts are the text."""
    start = 0

    def plain(end: int) -> Iterator[tuple[str, bool]]:
        nonlocal start
        own = text[start:end]
        at = 0
        while len(own) - at > long:
            cut = _cut(own, at + long)
            yield own[at:cut], False
            at = cut
        if at < len(own):
            yield own[at:], False

    for m in re.compile(f"[{_WHITE}]{{{run},}}").finditer(text):
        yield from plain(m.start())
        start = m.end() if m.end() == len(text) else m.end() - 1
        yield text[m.start() : start], True
    yield from plain(len(text))


def resolved(ranks: str) -> str:
    """The path of a rank file: a path as it is, a bare name where the tokenizer files of this machine lie."""
    if os.sep in ranks:
        return ranks
    import public_tokenizers

    return str(public_tokenizers.path(ranks))


class RankCodec:
    """The encoding of the rank file ``ranks``: a path, or a name that each executor resolves for itself."""

    def __init__(self, ranks: str, long: int = LONG, run: int = RUN) -> None:
        import public_tokenizers
        import tiktoken

        with open(resolved(ranks), "rb") as lines:
            known = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        self.lib = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=known, special_tokens={})
        self.long, self.run = long, run

    @staticmethod
    @lru_cache(maxsize=4)
    def at(ranks: str) -> RankCodec:
        """One codec for a file in each process."""
        return RankCodec(ranks)

    def encode(self, text: str) -> np.ndarray:
        """Ids of a whole text."""
        if len(text) <= min(self.long, self.run):
            return np.array(self.lib.encode_ordinary(text), np.uint32)
        made = [np.array(self.lib._encode_single_piece(p) if single else self.lib.encode_ordinary(p), np.uint32) for p, single in parts(text, self.long, self.run)]
        return np.concatenate(made) if made else np.zeros(0, np.uint32)

    def decode(self, ids: np.ndarray) -> bytes:
        """The bytes of the tokens, in order."""
        step = 1 << 16
        return b"".join(self.lib.decode_bytes(ids[s : s + step].tolist()) for s in range(0, len(ids), step))


def encoded(docs: DataFrame, ranks: str, columns: list[str], text: str = "text") -> DataFrame:
    """``columns`` and ids (array<int>) of every row; null and empty texts have none. Repeated rows stay; a column named ids is replaced."""
    narrow_batches(docs.sparkSession)
    kept = [c for c in columns if c != "ids"]
    held, schema = carried(docs, kept, text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = RankCodec.at(ranks)
        for batch in batches:
            for b in tb.pieces(batch, "value"):
                each = [codec.encode(t.as_py() or "") for t in b.column(1)]
                at = np.r_[0, np.cumsum([len(x) for x in each])].astype(np.int32)
                yield pa.record_batch([b.column(0), pa.ListArray.from_arrays(pa.array(at), pa.array(np.concatenate(each).astype(np.int32)))], names=["kept", "ids"])

    return spread(held.mapInArrow(tb.returning(run), schema("ids array<int>")), kept, {"ids": "ids"})


def decoded(rows: DataFrame, ranks: str, columns: list[str], ids: str = "ids") -> DataFrame:
    """``columns`` and the bytes (binary) of every row's ids; a null list is an empty one. A column named bytes is replaced."""
    kept = [c for c in columns if c != "bytes"]
    held, schema = carried(rows, kept, ids)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = RankCodec.at(ranks)
        for batch in batches:
            for s in range(0, batch.num_rows, 256):
                b = batch.slice(s, 256)
                made = [codec.decode(np.array(x.as_py() or [], np.uint32)) for x in b.column(1)]
                yield pa.record_batch([b.column(0), pa.array(made, pa.binary())], names=["kept", "bytes"])

    return spread(held.mapInArrow(tb.returning(run), schema("bytes binary")), kept, {"bytes": "bytes"})


def round_trip(docs: DataFrame, ranks: str, columns: list[str], text: str = "text") -> DataFrame:
    """``columns`` with n_tokens, the SHA-256 of the ids (little-endian, 32 bits) and that of the bytes decoded from them; no ids leave the task."""
    narrow_batches(docs.sparkSession)
    made = ["n_tokens", "ids_sha256", "decoded_sha256"]
    kept = [c for c in columns if c not in made]
    held, schema = carried(docs, kept, text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = RankCodec.at(ranks)
        for batch in batches:
            for b in tb.pieces(batch, "value"):
                rows = []
                for t in b.column(1):
                    ids = codec.encode(t.as_py() or "")
                    rows.append((len(ids), hashlib.sha256(ids.astype("<u4").tobytes()).hexdigest(), hashlib.sha256(codec.decode(ids)).hexdigest()))
                yield pa.record_batch([b.column(0), *map(pa.array, zip(*rows, strict=True))], names=["kept", *made])

    return spread(held.mapInArrow(tb.returning(run), schema("n_tokens long, ids_sha256 string, decoded_sha256 string")), kept, {n: n for n in made})
