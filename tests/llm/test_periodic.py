"""op12: runs and collapsed texts against the definition, period by period."""

import hashlib
import random
import re
import zlib

import numpy as np
from fractions import Fraction

from codeloom.llm import periodic
from codeloom.llm.queries_periodic import op12_periodic


def brute(x):
    n, out = len(x), set()
    for q in range(1, n // 4 + 1):
        i = 0
        while i + q < n:
            if x[i] != x[i + q]:
                i += 1
                continue
            j = i
            while j + q < n and x[j] == x[j + q]:
                j += 1
            size = j + q - i
            own = x[i : i + size]
            if size >= max(6, 4 * q) and not any(own[d:] == own[: size - d] for d in range(1, q)):
                out.add((i, size, q))
            i = j
    return sorted(out, key=lambda r: (r[0], r[2]))


def sequence(rng):
    x = []
    for _ in range(rng.randint(1, 6)):
        x += rng.choices(range(rng.choice([2, 3, 6])), k=rng.randint(1, 7)) * rng.randint(1, 7)
        if rng.random() < 0.3:
            x += x[-rng.randint(1, len(x)) :] * rng.randint(1, 4)
    return x[:150]


def test_runs_of_random_sequences(monkeypatch):
    rng = random.Random(2)
    for i in range(800):
        monkeypatch.setattr(periodic, "DIGIT", 64 if i % 2 else 2)
        monkeypatch.setattr(periodic, "ROWS", 1 << 16 if i % 3 else 5)
        x = sequence(rng)
        want = brute(x)
        assert periodic.runs_of(np.array(x)) == want, x
        s, e = periodic._frequent(np.array(x), np.array([0, len(x)]), 4, 6)
        found = [(int(a) + r[0], r[1], r[2]) for a, z in zip(s, e, strict=True) for r in periodic.runs_of(np.array(x[a:z]))]
        assert sorted(found, key=lambda r: (r[0], r[2])) == want, x


def test_sums_that_agree_by_chance_do_no_harm(monkeypatch):
    rng = random.Random(4)
    monkeypatch.setattr(periodic, "_P", 3)  # nearly everything seems equal
    monkeypatch.setattr(periodic, "_B", 2)
    for _ in range(150):
        x = sequence(rng)
        assert periodic.runs_of(np.array(x)) == brute(x), x


def test_long_sequences_end_soon():
    for x, want in (([1] * 60_000, [(0, 60_000, 1)]), (list(range(9_000)) * 5, [(0, 45_000, 9_000)]), ([bin(i).count("1") & 1 for i in range(1 << 15)], [])):
        assert periodic.runs_of(np.array(x)) == want


def digests(doc_id, text):
    w = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    n = len(w)
    h = zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
    g = h // 10
    if h % 10 == 0 and n:
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        w = w[:a] + [w[a + (i - a) % p] for i in range(a, n)]
    runs = brute(w)
    dropped = {i for s, size, q in runs for i in range(s + q, s + size)}
    best = min(runs, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2])) if runs else (None, None, None)
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    lines = "".join(f"{s},{size},{q}\n" for s, size, q in runs)
    return (doc_id, len(runs), *best, 1000 * best[1] // best[2] if runs else None, sha(lines), sha(" ".join(x for i, x in enumerate(w) if i not in dropped)))


def test_query(spark, tmp_path):
    rng = random.Random(9)
    rows = [(i, " ".join(map(str, sequence(rng))) if i % 2 else "  ".join(rng.choices(["a", "b", "c d", "é\n"], k=rng.randint(0, 90))), 0) for i in range(300)]
    rows += [(400, None, 0), (401, "", 0), (402, " \n\t", 0), (None, "x " * 40, 0), (404, "y y " * 50, 1), (404, "y y " * 50, 1), (19, "one", 0)]
    spark.createDataFrame(rows, "doc_id long, text string, runs long").repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    got = op12_periodic(spark, str(tmp_path))
    assert got.columns == ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]
    key = lambda r: tuple(map(str, r))
    assert sorted(map(tuple, got.collect()), key=key) == sorted((digests(i, t) for i, t, _ in rows), key=key)
    assert sum(zlib.crc32(str(i).encode()) % 10 == 0 for i, *_ in rows) > 10


def test_operator_keeps_columns(spark):
    df = spark.createDataFrame([(1, "a b a b a b a b c", 5, 6, 7)], "doc_id long, text string, kept long, value long, runs long")
    row = periodic.periodic_runs(df, ["doc_id", "kept", "value", "runs", "text"]).first()
    assert (row.doc_id, row.kept, row.value, row.text) == (1, 5, 6, "a b a b a b a b c")
    assert [tuple(r) for r in row.runs] == [(0, 8, 2)] and row.collapsed == "a b c" and row.n_words == 9
    assert periodic.periodic_runs(df.limit(0), ["doc_id"]).count() == 0
