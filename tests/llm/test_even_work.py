"""Work that has to be dealt evenly, or not done at all."""

from __future__ import annotations

import random

import pytest

from quayside.llm import jaccard_join, suffix_dedup


def test_anchors_fill_all_buckets_alike():
    import numpy as np

    data = np.random.default_rng(1).integers(0, 256, 200_000, dtype=np.uint8)
    _, n, h, _ = suffix_dedup.Hasher(50).runs(data, np.array([len(data)]))
    assert n.sum() == len(data) - 49
    rows = np.bincount(suffix_dedup.bucket_of(h, 64), minlength=64)
    assert rows.max() < 2 * rows.mean()


def brute(docs: dict[int, str]) -> dict[int, int]:
    sets = {i: {tuple(t.split()[j:j + 3]) for j in range(len(t.split()) - 2)} for i, t in docs.items()}
    root = {i: i for i in docs}
    for _ in docs:
        for x in docs:
            for y in docs:
                if 100 * len(sets[x] & sets[y]) >= 80 * len(sets[x] | sets[y]):
                    root[x] = root[y] = min(root[x], root[y])
    return root


@pytest.mark.parametrize("round_list, calls", [(jaccard_join.ROUND_LIST, 2), (0, 3)])
def test_short_lists_take_no_rounds(spark, monkeypatch, round_list, calls):
    rng, word = random.Random(3), "w{}".format
    shared = [word(i) for i in range(30)]
    docs = {}
    for group in range(4):  # all share some shingles, a group's documents nearly all
        own = [f"g{group}x{i}" for i in range(200)]
        for copy in range(8):
            some = [*own]
            some[rng.randrange(100)] = f"c{group}x{copy}"
            docs[len(docs)] = " ".join(some[:100] + shared + some[100:])
    monkeypatch.setattr(jaccard_join, "ROUND_LIST", round_list)
    met, real = [], jaccard_join.verified
    monkeypatch.setattr(jaccard_join, "verified", lambda *a: met.append(1) or real(*a))
    df = spark.createDataFrame(list(docs.items()), "doc_id long, text string")
    out = jaccard_join.groups(df, words=3, num=80, den=100)
    assert {r["doc_id"]: r["component_id"] for r in out.collect()} == brute(docs)
    assert len(met) == calls


def test_few_wanted_keys_shuffle_nothing(spark, monkeypatch):
    rows = spark.range(1000).withColumnRenamed("id", "key")
    wanted = jaccard_join.written(spark.range(0, 2000, 10).withColumnRenamed("id", "key"), "wanted")
    for most in (jaccard_join.MOST_WANTED, 0):
        monkeypatch.setattr(jaccard_join, "MOST_WANTED", most)
        assert sorted(r["key"] for r in jaccard_join.picked(rows, "key", wanted).collect()) == list(range(0, 1000, 10))
