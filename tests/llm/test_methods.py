"""Kernels of the operators on inputs that whole queries rarely meet."""

import random
import re
import time

import numpy as np
import pyarrow as pa
import pytest

from codeloom.llm import langid, pii
from codeloom.llm import textbuf as tb


def test_pii_base_is_the_patterns():
    rng = random.Random(6)
    for k in range(4000):
        t = "".join(rng.choices("a.@-+1 9()b025" if k % 2 else "0123456789 -.+", k=60))
        want = [("email", m.start(), m.end()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t)]
        for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", t):
            if all(int(x) <= 255 for x in m.group().split(".")):
                want.append(("ip", m.start(), m.end()))
        for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", t):
            d = re.sub(r"[ -]", "", m.group())
            if 12 <= len(d) <= 19 and pii.luhn(d):
                want.append(("card", m.start(), m.end()))
        for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", t):
            if 9 <= len(re.sub(r"\D", "", m.group())) <= 15:
                want.append(("phone", m.start(), m.end()))
        assert pii.plain_spans(t) == want


@pytest.mark.parametrize("unit", ["a(dot)", "1.", "7", " at x", "one ", "12345 (dot) ", "a @", "+1", " ", "(at)"])
def test_pii_long_texts_take_time_in_proportion(unit):
    text = unit * (500_000 // len(unit)) + " (dot) "
    begun = time.perf_counter()
    pii.spans_of(text, pii.signs_of(*tb.buffers(pa.array([text])))[0])
    assert time.perf_counter() - begun < 8


def grams_of(t):
    return {w[i : i + 3] for x in re.findall(r"[a-z\u0080-\U0010ffff]+", t) for w in (f" {x} ",) for i in range(len(w) - 2)}


def test_language_filter_holds_every_gram(spark):
    rng = random.Random(4)
    letters = {"aa": "abcdefgh", "bb": "efghijkl", "cc": "日本語の文字列", "dd": "éèêabc", "ee": "mnopqrst"}
    rows = [(i, "".join(rng.choices(letters[k] + " ", k=400)), k) for i, k in enumerate(sorted(letters) * 12)]
    model = langid.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(3))
    texts = [t for _, t, _ in rows]
    g, row_at = langid.grams(*tb.buffers(pa.array(texts)))
    assert [len(np.unique(g[a:b])) for a, b in zip(row_at, row_at[1:], strict=False)] == [len(grams_of(t)) for t in texts]
    assert model.languages == sorted(letters)
    held = lambda grams, i: (model.masks(grams)[:, langid.LEVELS * i // 8] >> (langid.LEVELS * i % 8)) & 1
    every = sorted(set().union(*map(grams_of, texts)))
    for i, lang in enumerate(model.languages):
        known = set().union(*(grams_of(t) for _, t, k in rows if k == lang))
        raw, at = tb.buffers(pa.array(every))
        got = held(tb.hashes(raw, at[:-1], at[1:]), i)
        assert got[[x in known for x in every]].all()
        # absent n-grams are held about as often as the model states
        assert got[[x not in known for x in every]].mean() <= 3 * model.rates[langid.LEVELS * i] + 0.02
    best, score = model.decide(*tb.buffers(pa.array(texts)))
    assert [model.languages[i] for i in best] == [k for _, _, k in rows] and score.min() > 0.9


def test_spans_of_one_hash_are_told_apart():
    raw, at = tb.buffers(pa.array(["ab", "cd", "ab", "xyz", "cd", "qqq", "ab", ""]))
    first, which = tb.distinct(raw, at[:-1], at[1:], np.array([1, 1, 1, 2, 1, 2, 1, 3], np.uint64))
    words = [raw[at[i] : at[i + 1]].tobytes() for i in range(8)]
    assert [words[first[w]] for w in which] == words and len(first) == 5


def test_hashes_of_long_buffers():
    rng = np.random.default_rng(1)
    raw = rng.integers(0, 256, 3 << 20).astype(np.uint8)
    start = np.sort(rng.integers(0, len(raw) - 10, 500))
    end = np.minimum(start + rng.choice([3, 40, 5000, 1 << 20], 500), len(raw))
    h = tb.hashes(raw, start, end)
    assert h[7] == tb.hashes(raw[start[7] : end[7]].copy(), np.array([0]), end[7:8] - start[7:8])[0]
    moved = tb.hashes(np.r_[np.zeros(77777, np.uint8), raw], start + 77777, end + 77777)
    assert (h == moved).all()
