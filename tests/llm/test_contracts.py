"""op4 and op9: the columns of the queries, and decisions against exact sets of n-grams."""

import random
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa

from codeloom.llm import langid, sharding
from codeloom.llm import textbuf as tb
from codeloom.llm.queries_langid import held_out, learned, op9_langid
from codeloom.llm.queries_sharding import op4_sharding


def documents(seed=4, n=240):
    rng = random.Random(seed)
    words = {"en": ["the", "house", "water", "with", "thing", "shall", "what"], "de": ["das", "haus", "wasser", "mit", "straße", "schon", "würde"], "fr": ["la", "maison", "eau", "avec", "chose", "été", "leçon"]}
    rows = []
    for i in range(n):
        lang = rng.choice(list(words))
        rows.append((i, " ".join(rng.choices(words[lang], k=rng.randint(3, 40))), lang if rng.random() < 0.9 else None))
    return [*rows, (900, None, "en"), (901, "", "en"), (902, "12 34 !?", "de"), (None, "das haus", "de"), (5, "the house", "en"), (5, "the house", "en")]


def test_language_decisions_and_columns(spark, tmp_path):
    rows = documents()
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    df.repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    out = lambda i: i is not None and zlib.crc32(str(i).encode()) % 4 == 2
    assert sum(map(out, (r[0] for r in rows))) > 30
    grams = lambda t: langid.grams(*tb.buffers(pa.array([t or ""])))[0].tolist()
    count = {}
    for i, t, lang in rows:
        if lang and not out(i):
            count.setdefault(lang, Counter()).update(grams(t))
    usual = {x: {g for g, n in c.items() if n >= langid.USUAL_SHARE * sum(c.values())} for x, c in count.items()}
    got = op9_langid(spark, str(tmp_path)).collect()
    assert len(got) == len(rows)
    by_id = {r.doc_id: r for r in got}
    for i, t, _ in rows:
        r = by_id[i]
        assert r.held_out == out(i)
        g = grams(t)
        if not any(c.isalpha() for c in t or ""):
            assert (r.lang_pred, r.score) == ("und", 0.0)
            continue
        share = {x: (np.mean([v in count[x] for v in g]) + np.mean([v in usual[x] for v in g])) / 2 for x in count}
        best = max(share, key=share.get)
        assert abs(r.score - share[best]) < 0.03
        if sorted(share.values())[-2] < share[best] - 0.06:
            assert r.lang_pred == best, t
    right = [r.lang_pred == lang for (i, t, lang) in rows for r in [by_id[i]] if lang and out(i) and len(t or "") > 20]
    assert np.mean(right) > 0.97
    assert learned(df).languages == ["de", "en", "fr"] and df.where(held_out(4, 2)).count() == sum(map(out, (r[0] for r in rows)))


def test_sharding_columns(spark, tmp_path):
    rows = [(i, t) for i, t, _ in documents()] + [(7, "é" * 50), (None, None), (None, None)]
    spark.createDataFrame(rows, "doc_id long, text string").repartition(4).write.parquet(f"{tmp_path}/documents.parquet")
    got = op4_sharding(spark, str(tmp_path)).collect()
    assert got[0].__fields__ == ["doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard"]
    raw = lambda t: (t or "").encode()
    want = Counter((i, len(raw(t)) + 1, zlib.crc32(raw(t))) for i, t in rows)
    assert Counter((r.doc_id, r.size, r.text_crc32) for r in got) == want
    assert {r.law for r in got} == {sharding.LAW} == {"rows"} and all(r.grown_shard is None for r in got)
    per = Counter(r.shard for r in got)
    assert set(per) == set(range(8)) and max(per.values()) - min(per.values()) <= 1
    assert all(sorted(r.slot for r in got if r.shard == s) == list(range(n)) for s, n in per.items())
