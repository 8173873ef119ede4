"""Rounds of components leave files by the rows they hold, not by the shuffle partitions."""

import random

import pytest

from codeloom.llm import components, neardup, scratch


@pytest.fixture
def many_partitions(spark):
    keys = {"spark.sql.shuffle.partitions": "24", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {k: spark.conf.get(k) for k in keys}
    for k, v in keys.items():
        spark.conf.set(k, v)
    yield spark
    for k, v in before.items():
        spark.conf.set(k, v)


@pytest.mark.parametrize("part,most", [(1 << 17, 1), (100, 5)])
def test_files_of_rounds(many_partitions, monkeypatch, part, most):
    rng = random.Random(5)
    links = [(rng.randrange(200), rng.randrange(200)) for _ in range(150)]
    files, real = [], scratch.written

    def counted(df, name):
        out = real(df, name)
        files.extend([len(out.inputFiles())] * (name in ("large", "small")))
        return out

    monkeypatch.setattr(components, "written", counted)
    monkeypatch.setattr(scratch, "PART_ROWS", part)
    got = {r.node: r.root for r in components.connected_components(many_partitions.createDataFrame(links, "a long, b long")).collect()}
    root = {x: x for e in links for x in e}
    for _ in root:
        for a, b in links:
            root[a] = root[b] = min(root[a], root[b])
    assert got == {x: root[x] for a, b in links if a != b for x in (a, b)}
    assert files and max(files) <= most


def test_minima_are_not_carried_in_buckets(spark, monkeypatch):
    rng = random.Random(6)
    words = [" ".join(rng.choice("abcdefgh") * 3 + str(rng.randrange(50)) for _ in range(60)) for _ in range(8)]
    rows = [(k, f"{words[k % 8]} end{k}") for k in range(40)]
    seen, real = {}, scratch.written
    monkeypatch.setattr(neardup, "written", lambda df, name: seen.setdefault(name, df.columns) and real(df, name))
    kept = neardup.one_of_similar(spark.createDataFrame(rows, "doc_id long, text string"))
    assert sorted(r.doc_id for r in kept.collect()) == list(range(8))
    assert "sig" not in seen["buckets"] + seen["crowd"] + seen["named"] and "sig" in seen["minima"]
