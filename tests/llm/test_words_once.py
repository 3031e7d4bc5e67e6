"""Words that come again cost little: each is hashed once for the shingles of some texts, and looked up once when texts are graded."""

import random

import numpy as np
import xxhash

from quayside.llm import jaccard_join, toxicity

TEXTS = [b"A rose is a rose is a rose", b"", b" \n\t", b"a  ROSE\x0bis\ra\x0crose \xc3\x84 \xc3\xa4 \xc2\xa0x", b"one two", b"is a rose is a"]


def shingles(text: bytes, k: int) -> list[int]:
    words, whole = text.lower().split(), (1 << 64) - 1
    width, out = min(k, len(words)), set()
    for i in range(len(words) - width + 1 if words else 0):
        h = width
        for w in words[i:i + width]:
            h = h * jaccard_join.MULTIPLIER + xxhash.xxh3_64_intdigest(w) & whole
            h ^= h >> 32
        h = h * jaccard_join.MIX & whole
        out.add(h ^ h >> 31)
    return sorted(out)


def test_words_are_hashed_once(monkeypatch):
    rng = random.Random(2)
    texts = TEXTS + [bytes(rng.choices(b"abAB \t\n\x0b\x0c\r\x1c\x85\x00", k=rng.randrange(40))) for _ in range(300)]
    for k in (1, 3, 5):
        for some in (texts, texts[1:3], []):
            assert [s.tolist() for s in jaccard_join.shingle_sets(some, k)] == [shingles(t, k) for t in some]
    hashed, real = [], xxhash.xxh3_64_intdigest
    monkeypatch.setattr(xxhash, "xxh3_64_intdigest", lambda data: hashed.append(data) or real(data))
    jaccard_join.shingle_sets(TEXTS, 3)
    assert sorted(hashed) == sorted({w for t in TEXTS for w in t.lower().split()})


def test_entries_are_told_apart_by_token_and_node():
    rng = np.random.default_rng(4)
    rows = np.zeros(5000, jaccard_join.ENTRY)
    rows["token"], rows["node"] = rng.integers(0, 60, 5000) << 58, rng.integers(0, 60, 5000)
    rows["n"], rows["rank"] = rows["node"] + 7, (rows["token"] >> 58) % 5
    assert (jaccard_join.distinct_entries(rows) == np.unique(rows)).all()
    assert len(jaccard_join.distinct_entries(rows[:0])) == 0


def test_words_are_looked_up_once(monkeypatch):
    texts = ["Stupid stupidity, stupidly. Stupid!", None, "", "stup\nfine Äh_1", "fine stupid"]
    weights = {"stupid": 0.5, "stup*": 0.25, "fine": -1.0, "äh_1": 0.125, "other": 3.0}
    model = toxicity.Model((0.0, 1.0, 2.0), (0.1, 0.7), weights)
    sums = [sum(weights[f] for f in toxicity.features_of(t) if f in weights) for t in texts]
    assert sums == [0.75, 0, 0, 0.25 - 1 + 0.125, -0.25]
    looked_up, real = [], toxicity.forms
    monkeypatch.setattr(toxicity, "forms", lambda word: looked_up.append(word) or real(word))
    expected = 1 / (1 + np.exp(np.array([[0.1, 0.7]]) - np.array(sums)[:, None]))
    assert np.allclose(model.chances(texts), expected, rtol=1e-14)
    assert sorted(looked_up) == ["fine", "stup", "stupid", "stupidity", "stupidly", "äh_1"]
