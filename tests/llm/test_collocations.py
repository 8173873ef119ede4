"""op13 against counting every phrase of every piece."""

import random
import re
from collections import Counter

import pytest

from codeloom.llm import collocations as c

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute(rows, least, most, longest=4, absorbed=80):
    f, n = Counter(), Counter()
    for lang, text in rows:
        lang = lang or "und"
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(LOWER)):
            w = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(w)
            for k in range(1, longest + 1):
                for i in range(len(w) - k + 1):
                    f[lang, tuple(w[i : i + k])] += 1
    found = {k: a for k, a in f.items() if len(k[1]) > 1 and a >= least}
    out = []
    for (lang, g), a in found.items():
        holders = [b for (other, h), b in found.items() if other == lang and len(h) > len(g) and any(h[i : i + len(g)] == g for i in range(len(h) - len(g) + 1))]
        if any(100 * b >= absorbed * a for b in holders):
            continue
        score, _, left, right = min((2000000 * a // (f[lang, g[:k]] + f[lang, g[k:]]), k, f[lang, g[:k]], f[lang, g[k:]]) for k in range(1, len(g)))
        out.append((lang, " ".join(g), a, left, right, n[lang], score))
    ranked = []
    for lang in {x[0] for x in out}:
        own = sorted((x for x in out if x[0] == lang), key=lambda x: (-x[6], -x[2], x[1].encode()))[:most]
        ranked += [(lang, i + 1, *x[1:]) for i, x in enumerate(own)]
    return sorted(ranked)


def table():
    rng = random.Random(11)
    words = ["the", "Of", "new", "york", "city", "hall", "é", "x"] + ["w%d" % i for i in range(12)]
    rows = []
    for _ in range(250):
        t = ""
        for _ in range(rng.randint(0, 30)):
            t += rng.choice(words) if rng.random() < 0.8 else "New York City Hall"
            t += rng.choice([" ", " ", " ", "  ", "\t", ", ", "\n", ". ", " "])
        rows.append((rng.choice(["en", "en", "fr", None, "und"]), t))
    return [*rows, ("en", None), ("en", ""), (None, " .,; "), ("fr", "a " * 20_000), rows[3], rows[3]]


@pytest.mark.parametrize("bits,most,dense,piece", [(None, 2000, 24, c.PIECE), (4, 7, 24, 300), (16, 3, 0, 300)])
def test_phrases(spark, monkeypatch, bits, most, dense, piece):
    rows = table()
    monkeypatch.setattr(c, "DENSE", dense)
    df = spark.createDataFrame([(i, t, lang, i) for i, (lang, t) in enumerate(rows)], "doc_id long, text string, lang string, gram long").repartition(3)
    got = c.collocations(df, least=12, most=most, bits=bits)
    assert got.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    assert sorted(map(tuple, got.collect())) == brute(rows, 12, most)


def test_many_buckets_are_given_out_in_parts(monkeypatch):
    monkeypatch.setattr(c, "GATHERED", 50)
    rng, want = random.Random(1), Counter()
    b = c._Buckets(c.DENSE + 1, 30)
    got = Counter()
    import numpy as np

    def take(batches):
        for r in batches:
            got.update(dict(zip(r.column(2).to_pylist(), r.column(3).to_pylist(), strict=True)))

    for _ in range(20):
        own = np.array([rng.randint(0, 90) for _ in range(40)])
        want.update(own.tolist())
        take(b.add(own))
    take(b.given())
    assert got == want


def test_exact_beyond_64_bits(spark):
    grams = spark.createDataFrame([("en", 1, "a", 9 * 10**18), ("en", 1, "b", 9 * 10**18 - 1), ("en", 2, "a b", 8 * 10**18 + 7)], "lang string, k int, gram string, f long")
    row = c.scored(grams).first()
    assert row.score == 2000000 * (8 * 10**18 + 7) // (18 * 10**18 - 1)


def test_nothing(spark):
    empty = spark.createDataFrame([], "text string, lang string")
    assert c.collocations(empty).count() == 0
    with pytest.raises(ValueError):
        c.frequent_phrases(empty, longest=5)
