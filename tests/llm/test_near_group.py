"""A group of documents that differ a little more from each other than they may is not paired with itself."""

from __future__ import annotations

import random

from quayside.llm import jaccard_join


def linked(docs: dict[int, str]) -> dict[int, int]:
    sets = {i: {tuple(t.split()[j:j + 3]) for j in range(len(t.split()) - 2)} for i, t in docs.items()}
    near = {x: [y for y in docs if 100 * len(sets[x] & sets[y]) >= 80 * len(sets[x] | sets[y])] for x in docs}
    root: dict[int, int] = {}
    for first in sorted(docs):
        todo = [first] if first not in root else []
        while todo:
            x = todo.pop()
            if x not in root:
                root[x] = first
                todo += near[x]
    return root


def test_group_near_the_limit_is_not_paired(spark, monkeypatch):
    rng = random.Random(11)
    base, docs = [f"w{i}" for i in range(300)], {}
    for doc in range(240):
        text = [*base]
        for at in rng.sample(range(0, 300, 4), 7 if doc else 2):
            text[at] = f"d{doc}x{at}"
        docs[doc] = " ".join(text)
    asked, real = [], jaccard_join.verified
    monkeypatch.setattr(jaccard_join, "verified", lambda s, d, c, pairs, *a: asked.append(pairs.count()) or real(s, d, c, pairs, *a))
    df = spark.createDataFrame([*docs.items(), (None, None)], "doc_id long, text string")
    found = {r["doc_id"]: r["component_id"] for r in jaccard_join.groups(df, words=3, num=80, den=100).collect()}
    expected = linked(docs)
    assert found == expected | {None: None}
    assert set(expected.values()) == {0}
    assert sum(asked) < 10 * len(docs), asked
