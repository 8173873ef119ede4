"""Each operator against a brute-force version on a small, awkward table, and on an empty one."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from codeloom.llm import bpe, decontaminate, langid, lm, pii, quality, sharding, simhash, topk, urlfilter
from codeloom.llm.queries_bpe import tokenizer_path

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
ITEMS = [(1, "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu"), (2, "Short Phrase here"), (3, ""), (4, None), (None, "alpha beta"), (2, "short phrase here"), (10, "short phrase here")]


def words_of(t):
    return re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(LOWER))


def table(seed=5, n=60):
    rng = random.Random(seed)
    vocabulary = ["".join(rng.choices("abcdeé", k=rng.randint(2, 6))) for _ in range(80)] + ["The", "of", "and"]
    texts = [" ".join(rng.choices(vocabulary, k=rng.randint(1, 120))) for _ in range(n)]
    texts[3] = texts[2]
    texts[4] = texts[2] + " tail"
    texts[5], texts[6], texts[7] = None, "", "  \n\t "
    texts[8] = "x ALPHA beta gamma-delta epsilon zeta eta theta iota kappa, lambda mu nu"
    texts[9] = "a short phrase here, and short phrase there"
    texts[10] = " ".join(rng.choices(vocabulary, k=30000))
    texts[11] = "q" * 70000
    texts[12] = "12345 67890 !!! ???"
    texts[13] = "mail john (at) example (dot) com or +1 (136) 555-7479 and 4111 1111 1111 1111 at 10.0.0.1"
    rows = [(i, t, rng.choice(["en", "fr", None]), "src", 1.5) for i, t in enumerate(texts)]
    return rows + [rows[2], rows[20], (None, "an id is missing here", None, None, None)]


SCHEMA = "doc_id long, text string, lang string, source string, score double"


@pytest.fixture(scope="module")
def rows():
    return table()


@pytest.fixture(scope="module")
def docs(spark, rows, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("d") / "docs.parquet")
    spark.createDataFrame(rows, SCHEMA).repartition(3).write.parquet(path)
    return spark.read.parquet(path)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def found(text, items):
    w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(LOWER))
    hit, ids = set(), set()
    for i, t in items:
        own = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate(LOWER))
        n = min(10, len(own))
        if i is None or not n:
            continue
        windows = {tuple(own[k : k + n]) for k in range(len(own) - n + 1)}
        for k in range(len(w) - n + 1):
            if tuple(w[k : k + n]) in windows:
                hit |= set(range(k, k + n))
                ids.add(str(i))
    return len(w), sorted(hit), sorted(ids)


@pytest.mark.parametrize("part_rows", [1 << 19, 2])
def test_decontamination(spark, docs, rows, part_rows):
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    got = sorted(((r.doc_id or -1, r.n_words, sorted(r.hits), sorted(r["items"])) for r in decontaminate.contamination(docs, items, part_rows=part_rows).collect()), key=repr)
    want = sorted(((i or -1, *found(t, ITEMS)) for i, t, *_ in rows), key=repr)
    assert got == want
    assert any(x[2] for x in got)


def test_near_phrases(spark):
    docs = spark.createDataFrame([(1, "short odd phrase here"), (2, "phrase short here"), (3, "short a b c d phrase here"), (4, "short phrase here")], "doc_id long, text string")
    items = spark.createDataFrame([(7, "short phrase here")], "item_id long, text string")
    got = {r.doc_id: (r["items"], r.near_items) for r in decontaminate.contamination(docs, items, slop=2).collect()}
    assert got == {1: ([], ["7"]), 2: ([], ["7"]), 3: ([], []), 4: (["7"], ["7"])}


def test_decontamination_empty(spark, none, docs):
    items = spark.createDataFrame([], "item_id long, text string")
    assert decontaminate.contamination(none, spark.createDataFrame(ITEMS, "item_id long, text string")).count() == 0
    assert decontaminate.contamination(docs, items).where("size(hits) > 0").count() == 0


def fingerprint(t):
    w = words_of(t)
    sh = [" ".join(w[j : j + 4]) for j in range(len(w) - 3)] or ([" ".join(w)] if w else [])
    h = [xxhash.xxh64_intdigest(s, 42) for s in sh]
    return sum((1 << b) for b in range(64) if 2 * sum((x >> b) & 1 for x in h) > len(h))


@pytest.mark.parametrize("cap", [65536, 8])
def test_simhash(docs, rows, cap):
    got = simhash.near_duplicates(docs, cap=cap).collect()
    fps = [fingerprint(t) for _, t, *_ in rows]
    parent = list(range(len(rows)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= 4:
                parent[root(i)] = root(j)
    least = {}
    for i, r in enumerate(rows):
        if r[0] is not None:
            least[root(i)] = min(least.get(root(i), r[0]), r[0])
    want = Counter((r[0], fps[i], least.get(root(i))) for i, r in enumerate(rows))
    assert Counter((r.doc_id, r.fp % (1 << 64), r.component_id) for r in got) == want


def test_simhash_dense_group(spark):
    """A chain and a ball of near fingerprints: every link counts, in a bucket dealt to chunks too."""
    rng = np.random.default_rng(3)
    centre = rng.integers(0, 2**63)
    fps = {int(centre)}
    for _ in range(300):
        x = int(centre)
        for b in rng.choice(63, rng.integers(1, 5), replace=False):
            x ^= 1 << int(b)
        fps.add(x)
    chain = int(rng.integers(0, 2**63))
    for k in range(15):
        fps.add(chain)
        chain ^= 0b1111 << (4 * k)
    fps = np.array(sorted(fps), np.int64)
    df = spark.createDataFrame([(int(x),) for x in fps], "fp long")
    n, both = simhash.bit_moments(df)
    plan = simhash.planned(n, both, fps)
    assert sum(t + 1 for _, t in plan) == 5 and sorted(b for g, _ in plan for b in g) == list(range(64))
    from codeloom.llm.components import connected_components

    d = np.bitwise_count(fps.view(np.uint64)[:, None] ^ fps.view(np.uint64)[None]) <= 4
    label = np.arange(len(fps))
    while True:
        new = np.array([label[d[i]].min() for i in range(len(fps))])
        if (new == label).all():
            break
        label = new
    for cap in (65536, 32):
        roots = {r.node: r.root for r in connected_components(simhash.near_links(df, plan, cap=cap)).collect()}
        got = [roots.get(int(x), int(x)) for x in fps]
        assert [int(fps[k]) for k in label] == got


def test_near_dedup_similarity(spark):
    import corpus_pipeline

    rng = random.Random(8)
    texts = []
    for k in range(60):
        words = [f"w{rng.randrange(5000)}" for _ in range(rng.choice([3, 40, 150, 400]))]
        texts.append(words)
        for _ in range(k % 5):
            words = list(words)
            for _ in range(rng.randint(0, max(1, len(words) // 60))):
                words[rng.randrange(len(words))] = f"w{rng.randrange(5000)}"
            texts.append(words)
    texts += [["and", "on"] * 30, [], []]
    sets = [{tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} for w in texts]
    root = list(range(len(texts)))
    for i in range(len(texts)):
        for j in range(i):
            if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]):
                a, b = root[i], root[j]
                root = [min(a, b) if r in (a, b) else r for r in root]
    df = spark.createDataFrame([(i, " ".join(w)) for i, w in enumerate(texts)], "doc_id long, text string")
    got = sorted(r.doc_id for r in corpus_pipeline.near_dedup(spark, df.repartition(3), "").collect())
    assert got == sorted(set(root)) and len(got) < 0.6 * len(texts)
    assert corpus_pipeline.near_dedup(spark, df.limit(0), "").count() == 0


def test_near_dedup_without_ids(spark):
    import corpus_pipeline

    text = "one text of some words that stands here more than once"
    other = "quite another text that has nothing in common with the first"
    df = spark.createDataFrame([(None, text), (5, text), (None, text), (7, text), (7, other), (None, "alone")], "doc_id long, text string")
    got = corpus_pipeline.near_dedup(spark, df, "").collect()
    assert {(r.doc_id, r.text) for r in got} == {(5, text), (7, other), (None, "alone")} and len(got) == 3


def test_quality(spark, docs, none, rows):
    labels = spark.createDataFrame([(i, int(i % 3 > 0), 0) for i in range(50)] + [(1, None, 0), (None, 1, 0), (7, 5, 0)], "doc_id long, quality int, toxic int")
    got = quality.quality_scores(docs, labels, F.col("doc_id") % 5 != 0).collect()
    assert Counter(r.doc_id for r in got) == Counter(r[0] for r in rows)
    assert all(0 <= r.score <= 1 for r in got)
    assert quality.quality_scores(none, labels, F.lit(True)).count() == 0
    assert {r.score for r in quality.quality_scores(docs, labels.limit(0), F.lit(True)).collect()} == {0.5}


def test_quality_held_out():
    """At sf0.01, on labels that were not learned from; skipped where the tables are not."""
    import os

    folder = "/root/testdata/sf0.01"
    if not os.path.isdir(folder):
        pytest.skip("no tables")
    from pyspark.sql import SparkSession

    from codeloom.llm.queries_quality import op2_quality

    spark = SparkSession.getActiveSession()
    labels = spark.read.parquet(f"{folder}/labels.parquet").where("quality is not null").select("doc_id", "quality")
    rows = op2_quality(spark, folder).where("held_out").join(labels, "doc_id").collect()
    good, bad = [r.score for r in rows if r.quality == 1], [r.score for r in rows if r.quality == 0]
    auc = sum((g > b) + 0.5 * (g == b) for g in good for b in bad) / (len(good) * len(bad))
    assert auc > 0.99 and sum(r.predicted == r.quality for r in rows) / len(rows) > 0.95


def test_quality_by_brute_force(spark, docs, rows):
    labels = spark.createDataFrame([(i, int(i % 3 > 0), 0) for i in range(50) if i != 30], "doc_id long, quality int, toxic int")
    counts = quality.with_counts(docs).collect()
    label = {i: int(i % 3 > 0) for i in range(50) if i != 30 and i % 5}
    own = [(label[r.doc_id], np.array(r.c)) for r in counts if r.doc_id in label]
    usual = sum(c for y, c in own if y)
    x = [np.stack([quality.transformed(c[None], usual)[0] for y, c in own if y == k]) for k in (0, 1)]
    every = np.concatenate(x)
    scale = np.sqrt(np.maximum(every.var(axis=0), 1e-6))
    got = {r.doc_id: r.score for r in quality.quality_scores(docs, labels, F.col("doc_id") % 5 != 0).collect()}
    fits = []
    for p in quality.TO_POOLED:
        for s in quality.TO_SPHERE:
            cov = [np.cov(a.T, bias=True) / np.outer(scale, scale) for a in x]
            pooled = sum(len(a) * c for a, c in zip(x, cov, strict=True)) / len(every)
            cov = [(1 - p) * c + p * pooled for c in cov]
            cov = [(1 - s) * c + s * max(np.trace(c) / len(c), 1e-3) * np.eye(len(c)) for c in cov]
            want = {}
            for r in counts:
                z = quality.transformed(np.array(r.c)[None], usual)[0] / scale
                log = [np.log(len(a) / len(every)) - 0.5 * ((z - a.mean(0) / scale) @ np.linalg.inv(c) @ (z - a.mean(0) / scale) + np.linalg.slogdet(c)[1]) for a, c in zip(x, cov, strict=True)]
                want[r.doc_id] = 1 / (1 + np.exp(np.clip(log[0] - log[1], -700, 700)))
            fits.append(max(abs(want[i] - got[i]) for i in want))
    assert min(fits) < 1e-6


def test_sharding_does_not_depend_on_files(docs):
    key = lambda df: sorted((repr(r.doc_id), repr(r.text), r.shard, r.slot) for r in sharding.shuffled(df, shards=3, bucket_bytes=9000).collect())
    assert key(docs) == key(docs.repartition(7)) == key(docs.coalesce(1).orderBy(F.desc("doc_id")))


def test_quality_density():
    rng = np.random.default_rng(1)
    x = [rng.normal(m, s, (4000, 3)) for m, s in ((0, 1), (1, 0.4))]
    n = np.array([4000.0, 4000.0])
    model = quality.Discriminant.of(n, np.stack([a.sum(0) for a in x]), np.stack([a.T @ a for a in x]), 0.0, 0.0)
    q = rng.normal(0.5, 1, (50, 3))
    log = [-0.5 * np.einsum("ij,jk,ik->i", q - a.mean(0), np.linalg.inv(np.cov(a.T, bias=True)), q - a.mean(0)) - 0.5 * np.linalg.slogdet(np.cov(a.T, bias=True))[1] for a in x]
    assert np.allclose(model.score(q), 1 / (1 + np.exp(log[0] - log[1])), atol=1e-6)


@pytest.mark.parametrize("size", [8192, 7])
def test_topk(spark, size):
    rng = np.random.default_rng(2)
    vecs = rng.normal(0, 1, (120, 6)).tolist()
    vecs[5] = vecs[0]
    for k in range(40, 70):
        vecs[k] = vecs[40]
    vecs[7], vecs[8], vecs[9], vecs[10] = None, [1.0, None, 2.0], [float("nan")] * 6, []
    vecs[11] = [3.0, 4.0]
    vecs[12] = [1e7] * 6
    df = spark.createDataFrame([(i, v, 1) for i, v in enumerate(vecs)], "vec_id long, embedding array<float>, score int").repartition(3)
    got = topk.top_k(df, F.col("vec_id") % 20 == 0, k=20, size=size, query_size=3, group=2).collect()
    good = {i: [math.floor(64 * float(np.float32(x))) for x in v] for i, v in enumerate(vecs) if v is not None and all(x is not None and math.isfinite(x) for x in v)}
    want = []
    for q in (i for i in good if i % 20 == 0):
        s = sorted((-sum(a * b for a, b in zip(good[q], good[c], strict=False)), c) for c in good if c != q)[:20]
        want += [(q, k + 1, c, -v) for k, (v, c) in enumerate(s)]
    assert sorted((r.query_id, r["rank"], r.vec_id, r.score) for r in got) == sorted(want)
    assert topk.top_k(df.limit(0), F.col("vec_id") % 20 == 0).count() == 0


@pytest.mark.parametrize("spread", ["plain", "decaying", "clustered"])
def test_topk_prunes(spark, spread):
    """64 dimensions and more: candidates are cut before all their dimensions are read, and the result is that of all pairs."""
    rng = np.random.default_rng(5)
    n, d, k = 1500, 72, 20
    x = rng.normal(0, 1, (n, d))
    if spread == "decaying":
        x *= 0.93 ** np.arange(d)
    elif spread == "clustered":
        x = 4 * rng.normal(0, 1, (12, d))[rng.integers(0, 12, n)] + x
    v = np.floor(64 * x.astype(np.float32).astype(np.float64)).astype(np.int64)
    ids = np.arange(n)
    best = topk.Best(v[::20], ids[::20], ids[::20], k)
    best.add(v[:200].T, ids[:200], ids[:200])
    survived = []
    pruning = best._survivors
    best._survivors = lambda *a: survived.append(1) or pruning(*a)
    for s in range(200, n, 100):
        best.add(v[s : s + 100].T, ids[s : s + 100], ids[s : s + 100])
    assert (survived or spread == "plain") and best.cut > (0 if spread == "plain" else 0.3) * best.pairs
    df = spark.createDataFrame([(int(i), [float(c) for c in r]) for i, r in zip(ids, x, strict=True)], "vec_id long, embedding array<float>").repartition(4)
    got = sorted((r.query_id, r["rank"], r.vec_id, r.score) for r in topk.top_k(df, F.col("vec_id") % 20 == 0, k=k, size=200, query_size=40, group=3).collect())
    want = []
    for q in range(0, n, 20):
        s = v @ v[q]
        own = [i for i in np.lexsort((ids, -s)) if i != q][:k]
        want += [(q, j + 1, int(i), int(s[i])) for j, i in enumerate(own)]
    assert got == want
    kernel = [(int(best.ids[a]), int(i), int(s)) for a, i, s in zip(best.at, best.vec, best.score, strict=True)]
    assert kernel == [(q, i, s) for q, _, i, s in want]


def test_topk_huge_components(spark):
    """Components count as 2**53 at most and scores end at 64 bits, by exact integers."""
    vectors = {0: [1.0, 2.0], 1: [1e30, 0.0], 2: [-1e30, 1.0], 3: [3e13, 3e13], 20: [1e30, 1e30]}
    df = spark.createDataFrame(list(vectors.items()), "vec_id long, embedding array<double>")
    got = {(r.query_id, r["rank"]): (r.vec_id, r.score) for r in topk.top_k(df, F.col("vec_id") % 20 == 0, k=2).collect()}
    scaled = {i: [max(-(1 << 53), min(1 << 53, math.floor(64 * x))) for x in v] for i, v in vectors.items()}
    want = {}
    for q in (0, 20):
        scores = sorted((-min((1 << 63) - 1, sum(x * y for x, y in zip(scaled[q], scaled[i], strict=True))), i) for i in vectors if i != q)
        want |= {(q, k + 1): (i, -s) for k, (s, i) in enumerate(scores[:2])}
    assert got == want


def test_sharding(docs, none, rows, tmp_path):
    a, b = (sharding.shuffled(docs, shards=8, bucket_bytes=20000) for _ in range(2))
    key = lambda r: (str(r.doc_id), r.shard, r.slot)
    got = sorted(a.collect(), key=key)
    assert got == sorted(b.collect(), key=key)
    assert Counter((r.doc_id, r.text) for r in got) == Counter((r[0], r[1]) for r in rows)
    per = Counter(r.shard for r in got)
    assert max(per.values()) - min(per.get(s, 0) for s in range(8)) <= 1
    assert all(sorted(r.slot for r in got if r.shard == s) == list(range(per[s])) for s in per)
    assert sharding.shuffled(none).count() == 0
    clashing = sharding.shuffled(docs.withColumn("slot", F.lit("x")))
    assert clashing.columns.count("slot") == 1
    sharding.write_shards(docs, str(tmp_path / "out"))
    assert docs.sparkSession.read.parquet(str(tmp_path / "out")).count() == len(rows)


@pytest.mark.parametrize(("order", "shards"), [(2, None), (3, 12), (4, 3)])
def test_lm(docs, none, rows, order, shards):
    """Scores by brute force; few shards split no context but the most frequent, more split many."""
    held = lambda i: i is not None and zlib.crc32(str(i).encode()) % 10 == 0
    unigrams, grams, contexts = Counter(), Counter(), Counter()

    def steps(t):
        w = [*words_of(t), None]
        padded = ["<s>"] * (order - 1) + w
        for k, x in enumerate(w):
            yield x, [tuple(padded[k + order - 1 - n : k + order - 1]) for n in range(1, order)]

    for i, t, *_ in rows:
        if not held(i):
            for x, before in steps(t):
                unigrams[x] += 1
                grams.update((c, x) for c in before)
                contexts.update(before)
    n, v, after = sum(unigrams.values()), len(unigrams), Counter(c for c, _ in grams)
    p_word = lambda w: (unigrams[w] + 0.1) / (n + 0.1 * (v + 1))

    def want(t):
        base = score = size = known = 0
        for x, before in steps(t):
            p = p_word(x)
            base, size, known = base + math.log10(p), size + 1, known + (unigrams[x] > 0)
            for c in before:
                if contexts[c]:
                    p = max(grams[c, x] - 0.75, 0) / contexts[c] + 0.75 * after[c] / contexts[c] * p
            score += math.log10(min(p, 1))
        return size, known, base, score

    condition = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 10 == 0, F.lit(False))
    got = lm.text_scores(docs, condition, order=order, shards=shards, block_tokens=500).collect()
    assert Counter(r.doc_id for r in got) == Counter(r[0] for r in rows)
    texts = {r[0]: r[1] for r in rows}
    for r in got:
        tokens, known, base, score = want(texts[r.doc_id])
        assert (r.n_tokens, r.n_known, r.train_tokens, r.held_out) == (tokens, known, n, held(r.doc_id))
        assert abs(r.base_score - base) < 1e-6 and abs(r.score - score) < 1e-3 * tokens and r.score <= 0
    assert lm.text_scores(none, F.lit(False), order=order).count() == 0
    assert lm.text_scores(docs, F.lit(True), order=order).where("train_tokens = 0").count() == len(rows)


def test_lm_splits_frequent_contexts():
    """A context as frequent as a third of all tokens has parts; each successor has one, and each part is found again."""
    rng = np.random.default_rng(5)
    tokens = rng.integers(0, 2**63, 9000).astype(np.uint64)
    tokens[rng.permutation(9000)[:3000]] = 77
    row_at = np.array([0, 4000, 9000])
    one = lm.Split(np.array([77], np.uint64), np.array([8]))
    own = np.unique(one.divided(lm.contexts_of(tokens, row_at, 1), tokens))
    assert 77 not in own and (one.whole(own) == 0).sum() == 8
    keys, own, pair = lm._pairs(tokens, row_at, 1, one)
    c = np.unique(pair) // len(keys)
    assert np.bincount(c[one.whole(own)[c] == 0]).max() < 600


def test_lm_tells_words_of_one_prefix_apart(tmp_path):
    """Keys that agree in their upper 32 bits, or in their lower ones, keep counts of their own."""
    from codeloom.llm.lm import _pack, _trained, quantised

    ctx = np.array([7, 9], np.uint64)
    words = np.array([(5 << 32) + 1, (5 << 32) + 2, (6 << 32) + 1, (5 << 32) + 1], np.uint64)
    ask = {"contexts": _pack(ctx), "n_next": _pack(np.array([3, 1], np.uint32)), "words": _pack(words), "counts": _pack(np.array([8, 4, 2, 1], np.uint32))}
    trie, total, _, n_next = _trained([ask, ask], str(tmp_path))
    got = trie.find(np.array([0, 0, 0, 1, 1]), np.r_[words, words[1:2]])
    want = [quantised(np.log10((np.array([2.0 * n]) - lm.DISCOUNT) / t))[0] for n, t in ((8, 28), (4, 28), (2, 28), (1, 2))]
    assert got.tolist() == [*want, 0] and total.tolist() == [28, 2] and n_next.tolist() == [3, 1]


def test_elias_fano(tmp_path):
    from codeloom.llm.eliasfano import EliasFano, Trie

    rng = np.random.default_rng(4)
    for values in (np.sort(rng.integers(0, 10**9, 5000)), np.zeros(10, np.int64), np.arange(3), np.array([0, 0, 2**45]), np.zeros(0, np.int64)):
        EliasFano.write(str(tmp_path / "x"), values)
        ef = EliasFano(str(tmp_path / "x"))
        assert (ef[np.arange(len(values))] == values.astype(np.uint64)).all()
        if len(values) > 5:
            q = rng.integers(0, int(values.max()) + 2, 200)
            got = ef.successor(q, np.zeros(200, np.int64), np.full(200, len(values)))
            assert (got == np.searchsorted(values, q)).all()
    contexts = np.array([3, 9, 20], np.uint64)
    counts = np.array([2, 1, 3])
    words = np.array([5, 7, 7, 1, 5, 8], np.uint32)
    trie = Trie.write(str(tmp_path / "t"), contexts, counts, words, np.arange(1, 7, dtype=np.uint16))
    ranks = trie.context_ranks(np.array([3, 3, 9, 9, 20, 20, 4], np.uint64))
    assert trie.find(ranks, np.array([5, 8, 7, 5, 1, 8, 5], np.uint32)).tolist() == [1, 0, 3, 0, 4, 6, 0]


def test_pii(docs, none, rows):
    got = {r.doc_id: r for r in pii.personal_data(docs).collect()}
    text = next(t for i, t, *_ in rows if i == 13)
    spans = [x.split(":") for x in got[13].spans.split(",")]
    assert [(k, text[int(s) : int(e)]) for k, s, e in spans] == [("email", "john (at) example (dot) com"), ("phone", "+1 (136) 555-7479"), ("card", "4111 1111 1111 1111"), ("ip", "10.0.0.1")]
    assert got[5].spans == got[6].spans == "" and "email" not in got[13].base
    assert pii.personal_data(none).count() == 0
    clean = pii.without_personal_data(docs)
    assert clean.columns == docs.columns
    assert next(r.text for r in clean.collect() if r.doc_id == 13) == "mail <EMAIL> or <PHONE> and <CARD> at <IP>"


@pytest.mark.parametrize(
    ("text", "spans"),
    [
        ("write to jоhn@exаmple.com", "email:9:25"),
        ("john dot doe at example dot org", "email:0:31"),
        ("plus one two three four five six seven eight nine zero", "phone:0:54"),
        ("1.2.3.4.5 and 300.1.1.1", "ip:0:7"),
        ("a@b c@d.e", "email:4:9"),
        ("the man at the door dotted it", ""),
        ("one two three", ""),
        ("from 192[.]168[.]0[.]1 and 10 dot 0 dot 0 dot 7 on", "ip:5:22,ip:27:47"),
        ("①⑨②.168.0.1", "ip:0:11"),
        ("version 1.2.3.4 (.) x", "ip:8:15"),
        ("4111​1111​1111​1111", "card:0:19"),
        ("+1 2 3", ""),
        (None, ""),
    ],
)
def test_pii_spans(text, spans):
    assert pii.written_spans(pii.spans_of(text)[1]) == spans


MIXED = [
    ("ring +49 151 five five 1234 567 now", "ring <PHONE> now"),
    ("plus 4 9 one 5 1 two 3 four 5 six 7 8", "<PHONE>"),
    ("card 4111 1111 one111 1111 ok", "card <CARD> ok"),
    ("card 4111 1111 oneone 11 1111 ok", "card <CARD> ok"),
    ("card four 111 1111 1111 111 one", "card <CARD>"),
    ("jane [dot] doe@example.com", "<EMAIL>"),
    ("10 dot 0 dot 0 dot one", "<IP>"),
    ("at 10.0.0.1 one of 5 and 10 dot 0 dot 0 dot 27 one host", "at <IP> one of 5 and <IP> one host"),
    ("card ４111 1111 1111 1111 two", "card <CARD> two"),
    ("10.0.0.1\u200b2 up", "<IP> up"),
    ("one of 5 or 2 of three", "one of 5 or 2 of three"),
    ("the one. the ones of September 2020", "the one. the ones of September 2020"),
]


def test_pii_mixed_numbers(spark):
    df = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(MIXED)], "doc_id long, text string")
    got = {r.doc_id: r.text for r in pii.without_personal_data(df.coalesce(1)).collect()}
    assert [got[i] for i in range(len(MIXED))] == [want for _, want in MIXED] == [pii.redacted(t) for t, _ in MIXED]
    assert pii.spans_of(MIXED[5][0]) == ([("email", 11, 26)], [("email", 0, 26), ("email", 11, 26)])


def test_bpe(docs, none, rows):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(tokenizer_path())
    got = bpe.encoded_digests(docs, tokenizer_path(), ["doc_id"]).collect()
    want = Counter()
    for i, t, *_ in rows:
        ids = tok.encode(t or "", add_special_tokens=False).ids
        want[i, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(tok.decode(ids, skip_special_tokens=False).encode()).hexdigest()] += 1
    assert Counter((r.doc_id, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in got) == want
    ids = bpe.encoded(docs, tokenizer_path(), ["doc_id", "score"])
    back = {r.doc_id: r.text for r in bpe.decoded(ids, tokenizer_path(), ["doc_id"]).collect()}
    assert all(back[i] == (t or "") for i, t, *_ in rows)
    assert bpe.encoded(none, tokenizer_path(), ["doc_id"]).count() == 0


def test_bpe_tree():
    small, whole = bpe.Codec(tokenizer_path(), 64), bpe.Codec(tokenizer_path(), 1 << 60)
    rng = random.Random(8)
    parts = ["ab", " the", "é", "\n", "  ", "!!", "123", "'s", "日本", "🙂", "<|endoftext|>", "\t", "x" * 50, "\x1c", " ", "　", "ing"]
    for _ in range(400):
        t = "".join(rng.choices(parts, weights=[rng.random() ** 3 for _ in parts], k=rng.randint(1, 150)))
        assert small.encode([t]) == whole.encode([t])
    for letters in ("ab", "é", "abcdefghijklmnop", "!", "1", "日"):
        t = "".join(rng.choices(letters, k=3000))
        assert small.encode([t]) == whole.encode([t])


def test_langid(docs, none, spark):
    words = {"en": ["the", "house", "with", "which", "through"], "de": ["und", "nicht", "schön", "straße", "über"]}
    rng = random.Random(9)
    rows = [(i, " ".join(rng.choices(words[k], k=30)), k, "s", 0.0) for i, k in enumerate(["en", "de"] * 40)]
    model = langid.fit(spark.createDataFrame(rows + [(99, None, "en", "s", 0.0), (98, "zzz", None, "s", 0.0)], SCHEMA))
    probe = spark.createDataFrame([(1, "THE HOUSE THROUGH", None, None, 1.0), (2, "Über Straße nicht", None, None, 1.0), (3, None, None, None, 1.0), (4, "12 ?!", None, None, 1.0), (5, "", None, None, 1.0), (6, "qqqqxxxx", None, None, 1.0)], SCHEMA)
    got = {r.doc_id: (r.lang_pred, r.score) for r in langid.predict(probe, model, ["doc_id"]).collect()}
    assert got[1][0] == "en" and got[2][0] == "de" and got[1][1] > 0.9
    assert [got[k] for k in (3, 4, 5)] == [("und", 0.0)] * 3 and got[6][0] in ("en", "de") and got[6][1] == 0.0
    empty = langid.fit(none)
    assert {r.lang_pred for r in langid.predict(docs, empty, ["doc_id"]).collect()} == {"und"}


def test_urlfilter(spark):
    urls = ["https://A.Example.org/es/1?x", "http://example.org/en/12", "http://example.org", "http://x.org/", "b.com/de/", None, "http://com/de/q", "http://www.m.com/fr/", "http://notexample.org/es/", "http://a.com/de/fr/", "x://://y", "http:///p"]
    rows = spark.createDataFrame([(i, u, "x", 3) for i, u in enumerate(urls)] + [(1, urls[1], "x", 3)], "page_id long, url string, verdict string, size int")
    rules = spark.createDataFrame([("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"), ("com", "/fr/", "allow"), ("com", "/de/", "block"), (None, "/", "block")], "host string, path string, verdict string")
    got = sorted((r.page_id, r.host, r.path, r.rule, r.verdict) for r in urlfilter.judged(rows, rules).collect())
    assert got == sorted([
        (0, "a.example.org", "/es/1", "example.org/es/", "block"), (1, "example.org", "/en/12", "example.org/en/1", "block"), (1, "example.org", "/en/12", "example.org/en/1", "block"), (2, "example.org", "", None, "allow"), (3, "x.org", "/", "org/", "allow"),
        (4, "", "", None, "allow"), (5, "", "", None, "allow"), (6, "com", "/de/q", "com/de/", "block"), (7, "www.m.com", "/fr/", "com/fr/", "allow"), (8, "notexample.org", "/es/", "org/", "allow"), (9, "a.com", "/de/fr/", "com/de/", "block"), (10, ":", "//y", None, "allow"), (11, "", "/p", None, "allow"),
    ], key=lambda r: (r[0], r[1]))
    assert urlfilter.judged(rows, rules.limit(0)).where("rule is not null").count() == 0
    assert urlfilter.judged(rows.limit(0), rules).count() == 0


def test_pipeline(spark, docs, tmp_path):
    import corpus_pipeline

    folder = tmp_path / "sf"
    docs.write.parquet(str(folder / "documents.parquet"))
    spark.createDataFrame(ITEMS, "item_id long, text string").write.parquet(str(folder / "benchmark.parquet"))
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language", "near_dedup", "decontaminate", "personal_data", "tokens"]
    got = {r.doc_id: r for r in corpus_pipeline.run(spark, str(folder)).collect()}
    assert not {3, 5, 6, 7, 8, 9, 12} & set(got) and {2, 13, 20} <= set(got)
    text = bpe.Codec.at(tokenizer_path()).decode([got[13].ids])[0]
    assert text == "mail <EMAIL> or <PHONE> and <CARD> at <IP>"


def test_pipeline_stages_on_awkward_tables(spark, none, tmp_path):
    import corpus_pipeline

    folder = str(tmp_path / "sf")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    extra = [F.lit(1).alias("row"), F.lit("k").alias("__lang2"), F.lit(2).alias("s"), F.lit(0).alias("n_chars")]
    docs = spark.createDataFrame([(1, "one text of a house"), (1, "one text of a house"), (None, "another text here"), (3, None), (4, ""), (5, "...")], "doc_id long, text string")
    docs = docs.select("*", F.lit("en").alias("lang"), F.lit("x").alias("source"), *extra)
    for name, stage in corpus_pipeline.STAGES:
        empty = stage(spark, docs.limit(0), folder)
        assert empty.count() == 0
        got = stage(spark, docs.repartition(2), folder)
        if name != "tokens":
            assert got.columns == docs.columns == empty.columns and got.where("row <> 1 or s <> 2").count() == 0
        assert got.count() == {"language": 3, "near_dedup": 4, "decontaminate": 6, "personal_data": 6, "tokens": 6}[name]


def test_pipeline_decontaminates_each_row(spark, tmp_path):
    import corpus_pipeline

    spark.createDataFrame(ITEMS, "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    bad = "we saw a short phrase here today"
    df = spark.createDataFrame([(None, bad), (None, "clean text without an id"), (4, bad), (4, "clean text of a shared id"), (6, "clean too")], "doc_id long, text string")
    got = corpus_pipeline.decontaminate(spark, df.repartition(2), str(tmp_path)).collect()
    assert sorted(r.text for r in got) == ["clean text of a shared id", "clean text without an id", "clean too"]


def test_pipeline_keeps_columns_of_any_name(spark, tmp_path):
    """Names that stages use for themselves, as columns of the caller: nothing crashes, nothing is overwritten."""
    import corpus_pipeline

    folder = str(tmp_path / "sf")
    spark.createDataFrame(ITEMS, "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    names = ["__row", "__text", "__lang", "__score", "__ids", "row", "s", "t", "k", "root", "hits", "kept", "value", "a.b", "__ROW_"]
    docs = spark.createDataFrame([(1, "one text of a house"), (2, "one text of a garden"), (None, "another text here"), (3, "a short phrase here")], "doc_id long, text string")
    docs = docs.select("*", F.lit("en").alias("lang"), F.lit("x").alias("source"), F.lit(0).alias("n_chars"), *[F.lit(n).alias(n) for n in names])
    for name, stage in corpus_pipeline.STAGES[:-1]:
        got = stage(spark, docs, folder)
        assert got.columns == docs.columns, name
        assert all(r[n] == n for r in got.collect() for n in names), name
        assert got.count() == {"language": 4, "near_dedup": 4, "decontaminate": 3, "personal_data": 4}[name]


def test_near_duplicates_exactly(spark):
    """With ``exact`` the groups are those of comparing all pairs, chains and large groups of near copies too."""
    from codeloom.llm import neardup

    rng = random.Random(8)
    base = [f"w{rng.randint(0, 400)}" for _ in range(60)]
    texts = []
    for g in range(6):
        own = base[:10] + [f"g{g}x{rng.randint(0, 99)}" for _ in range(70)]
        for _ in range(12):
            t = list(own)
            for _ in range(rng.randint(0, 3)):
                t[rng.randrange(len(t))] = f"n{rng.randint(0, 10**6)}"
            texts.append(" ".join(t))
    sets = [set(tuple(w[i : i + 5]) for i in range(len(w) - 4)) for w in (t.split() for t in texts)]
    root = list(range(len(texts)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(texts)):
        for j in range(i):
            if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]):
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    want = sorted({find(i) for i in range(len(texts))})
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    assert sorted(r.doc_id for r in neardup.one_of_similar(df, exact=True).collect()) == want


def test_large_buckets_meet_whole(spark):
    """Copies that are similar to one text only, not to each other: that text meets all of them, whoever is the centre of their large buckets."""
    from codeloom.llm import neardup

    rng = random.Random(3)
    texts = []
    for g in range(3):
        own = [f"g{g}x{k}" for k in range(80)]
        for k in range(40):
            at = 10 + rng.randrange(60)
            texts.append(" ".join(own[:at] + [f"n{g}y{k}"] + own[at + 1 :]))
        texts.append(" ".join(own))
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    assert sorted(r.doc_id for r in neardup.one_of_similar(df).collect()) == [0, 41, 82]


def test_near_copies_below_the_bound_do_not_meet(spark):
    """Copies that share most shingles but each differ in two places of their own, 10 of 56 shingles, give no pairs by their prefixes, of 7,140."""
    from codeloom.llm import neardup

    texts = []
    for k in range(120):
        t = [f"x{i}" for i in range(60)]
        t[10 + k % 10], t[40 + k % 9] = f"n{k}", f"m{k}"
        texts.append(" ".join(t))
    t = spark.createDataFrame(list(enumerate(texts)), "s long, t string")
    placed = neardup._prefixes(t.select("s", F.lit(56).cast("long").alias("n")), t, 0.8, 5)
    roots = spark.createDataFrame([], "s long, root long")
    assert neardup._by_prefix(placed, roots, 0.8, star=False).count() == 0
    # one more place in common with the first text, and both meet
    near = spark.createDataFrame([(120, texts[0].replace("n0", "other"))], "s long, t string").unionByName(t)
    placed = neardup._prefixes(near.select("s", F.lit(56).cast("long").alias("n")), near, 0.8, 5)
    assert [tuple(r) for r in neardup._by_prefix(placed, roots, 0.8, star=False).collect()] == [(0, 120)]
