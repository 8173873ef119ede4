"""op11: the rank file's encoding against a plain merge loop over the pattern's matches."""

import hashlib
import random

import public_tokenizers
import pytest
import regex

from codeloom.llm import rankbpe
from codeloom.llm.queries_rankbpe import RANKS, op11_rankbpe

ALPHABET = ["a", "b", "s", "'", "1", "9", " ", "  ", "\n", "!", ".", "é", "中", "。", "́", "　", "\x85", "\x1c", "re", "'ll", "\xa0", "𝐀", "👍", "the", " of"]


def merged(codec, piece):
    ranks = codec.lib._mergeable_ranks
    parts = [bytes([b]) for b in piece.encode()]
    while len(parts) > 1:
        rank, i = min((ranks.get(parts[i] + parts[i + 1], 1 << 30), i) for i in range(len(parts) - 1))
        if rank == 1 << 30:
            break
        parts[i : i + 2] = [parts[i] + parts[i + 1]]
    return [ranks[p] for p in parts]


def brute(codec, text):
    return [i for m in regex.findall(public_tokenizers.PATTERN, text) for i in merged(codec, m)]


def texts(n=400):
    rng = random.Random(3)
    return ["".join(rng.choices(ALPHABET, k=rng.randint(0, 60))) for _ in range(n)]


@pytest.mark.parametrize("long,run", [(rankbpe.LONG, rankbpe.RUN), (7, 3), (1, 2)])
def test_any_cut_gives_the_same_ids(long, run):
    codec = rankbpe.RankCodec(RANKS, long, run)
    for t in texts():
        assert "".join(p for p, _ in rankbpe.parts(t, long, run)) == t
        ids = codec.encode(t)
        assert ids.tolist() == brute(codec, t), t
        assert codec.decode(ids) == t.encode()


def test_very_long_texts():
    codec = rankbpe.RankCodec(RANKS)
    blank = codec.encode(" " * 600_000 + "x")  # beyond what the library's pattern can hold on its stack
    assert blank.tolist() == codec.lib._encode_single_piece(" " * 599_999) + codec.lib.encode_ordinary(" x")
    for t in ("ab1" * 100_000, "一二。" * 60_000, "word " * 60_000, "q" * 300_000):
        ids = codec.encode(t)
        assert codec.decode(ids) == t.encode()
        assert ids.tolist() == codec.lib.encode_ordinary(t)


def test_query_and_operators(spark, tmp_path):
    rows = [(i, t, i) for i, t in enumerate(texts(60))] + [(100, None, 1), (101, "", 2), (None, "no id", 3), (102, "w " * 60_000, 4), (102, "w " * 60_000, 4)]
    df = spark.createDataFrame(rows, "doc_id long, text string, value long")
    df.write.parquet(f"{tmp_path}/documents.parquet")
    codec = rankbpe.RankCodec(RANKS)
    digest = lambda b: hashlib.sha256(b).hexdigest()
    want = sorted((str(i), len(ids := codec.encode(t or "")), digest(ids.astype("<u4").tobytes()), digest((t or "").encode())) for i, t, _ in rows)
    got = sorted((str(r.doc_id), r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in op11_rankbpe(spark, str(tmp_path)).collect())
    assert got == want
    named = df.selectExpr("doc_id", "text", "value", "1 kept", "2 ids")
    ids = rankbpe.encoded(named, RANKS, ["doc_id", "value", "kept", "text"])
    assert ids.columns == ["doc_id", "value", "kept", "text", "ids"]
    back = rankbpe.decoded(ids, RANKS, ["doc_id", "text", "kept"]).collect()
    assert len(back) == len(rows) and all(bytes(r.bytes) == (r.text or "").encode() for r in back)
    assert rankbpe.encoded(df.limit(0), RANKS, ["doc_id"]).count() == 0
