"""Spelling variants, Hamming search and phrases on small tables against brute force."""

import collections
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from quayside.llm import hamming_search, phrases, spelling

UP = {c: c + 32 for c in range(65, 91)}
SCHEMA = "doc_id long, text string, lang string, word string, n long, phrase string, id long"


def texts(seed=5, n=80):
    rng = random.Random(seed)
    vocabulary = ["".join(rng.choice("abcé") for _ in range(rng.randint(3, 8))) for _ in range(150)] + ["Straße", "ÀÉÎõÿ", "x÷y×zab"]
    line = " ".join(rng.choice(vocabulary) for _ in range(30))
    rows = []
    for i in range(n):
        words = [rng.choice(vocabulary[:40] if rng.random() < 0.6 else vocabulary) for _ in range(rng.choice((1, 20, 90)))]
        text = "".join(w + rng.choice((" ", " ", " ", "  ", "\t", ". ", ",", "\n", "\x0b", "\x0c", "; ")) for w in words)
        rows.append((i, text.upper() if i % 9 == 0 else text + line * (i % 3), rng.choice(("de", "en", "en", None))))
    rows += [(100, None, "de"), (101, "", None), (102, " .;\t", "xx"), (None, rows[2][1], "en"), (None, "only null id here", "en"),
             (103, (" ".join(vocabulary) + " ") * 60, "en"), rows[5], rows[5], (104, "日本語 日本語 日本語。", "ja"), (105, "aaaa " * 400, "en"),
             (106, "a" * 4000, "en")]
    return rows


ROWS = texts()


def frame(spark, rows, parts=3):
    return spark.createDataFrame([(a, b, c, "w", 1, "p", 2) for a, b, c in rows], SCHEMA).repartition(parts)


def brute_variants(rows, delete_every, min_length=5, min_count=3, ratio=2):
    seen = collections.Counter()
    for doc, text, _ in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = run.translate(UP)
            h = zlib.crc32(f"{'' if doc is None else doc}:{run}".encode())
            if delete_every and h % delete_every == 0:
                run = run[:h % len(run)] + run[h % len(run) + 1:]
            seen[run] += 1
    words = {w: n for w, n in seen.items() if len(w) >= min_length and n >= min_count}

    def near(a, b):
        if len(a) == len(b):
            return sum(x != y for x, y in zip(a, b)) == 1
        a, b = sorted((a, b), key=len)
        return len(b) == len(a) + 1 and any(b[:i] + b[i + 1:] == a for i in range(len(b)))

    partners = {w: [x for x in words if near(w, x)] for w in words}
    form = {}
    for w, others in partners.items():
        best = min(others, key=lambda x: (-words[x], x), default=None)
        form[w] = best if best is not None and words[best] >= ratio * words[w] else None

    def root(w):
        return w if form[w] is None else root(form[w])

    return {(w, form[w], root(w), n, len(partners[w]), words.get(form[w])) for w, n in words.items()}


@pytest.mark.parametrize("every", [None, 3, 97])
def test_variants(spark, every):
    got = spelling.variants(frame(spark, ROWS), delete_every=every).collect()
    expected = brute_variants(ROWS, every)
    assert len(got) == len(expected) and {tuple(r) for r in got} == expected
    assert every != 3 or sum(r["form"] is not None for r in got) > 20


def test_variants_of_short_and_dense_words(spark):
    """All words of three letters over a small alphabet: every chunk is shared by many."""
    rng = random.Random(1)
    words = [a + b + c for a in "abcde" for b in "abcde" for c in "abcde"]
    rows = [(i, " ".join(rng.choices(words, k=300)), None) for i in range(20)]
    got = spelling.variants(frame(spark, rows), min_length=2, min_count=1).collect()
    near = {r["word"]: r["n_near"] for r in got}
    assert near == {w: sum(sum(x != y for x, y in zip(w, v)) == 1 for v in near) for w in near} and len(near) == 125


def test_variants_of_nothing(spark):
    assert spelling.variants(frame(spark, ROWS[:0] or [(1, None, None)]).limit(0)).collect() == []
    assert spelling.variants(frame(spark, [(1, None, None), (2, "", None)])).collect() == []


def vectors(n=3000, size=64, seed=2):
    rng = np.random.default_rng(seed)
    x = rng.standard_normal((n, size))
    x[n // 2:] = x[rng.integers(0, 20, n - n // 2)] + 0.2 * rng.standard_normal((n - n // 2, size))
    return x * rng.uniform(0.5, 1.5, (n, 1))


def brute_search(rows, k):
    out = {}
    asked = {}
    for i, v in rows:
        if i % 20 == 0 and (i not in asked or v < asked[i]):
            asked[i] = v
    for i, v in asked.items():
        scores = sorted((-float(np.dot(v, w)), j) for j, w in rows if j != i and len(w) == len(v))
        out[i] = scores[:k]
    return out


def test_search_recall(spark):
    x = vectors()
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    df = spark.createDataFrame([(i, v, "v", 0.0, 1) for i, v in rows], "vec_id long, embedding array<float>, v string, score double, part int")
    got = hamming_search.search(df.repartition(5), F.col("vec_id") % 20 == 0, 20, sample_rows=1000).collect()
    expected = brute_search([(i, np.float32(v).astype(float).tolist()) for i, v in rows], 20)
    by = collections.defaultdict(list)
    for r in sorted(got, key=lambda r: (r["query_id"], r["rank"])):
        by[r["query_id"]].append((-r["score"], r["vec_id"]))
    assert set(by) == set(expected) and all(len(v) == 20 and v == sorted(v) for v in by.values())
    hits = sum(len({j for _, j in by[q]} & {j for _, j in e}) for q, e in expected.items())
    assert hits >= 0.9 * 20 * len(expected)
    exact = {(q, j): s for q, e in expected.items() for s, j in e}
    assert all(abs(s - exact[q, j]) < 1e-9 for q, some in by.items() for s, j in some if (q, j) in exact)


def test_search_edges(spark):
    rows = [(0, [1.0, 0.0]), (0, [2.0, 0.0]), (20, [0.0, 1.0]), (1, [1.0, 1.0]), (2, [1.0, 1.0]), (2, [1.0, 1.0]), (3, [-5.0, 0.0]),
            (40, [1.0, 2.0, 3.0]), (5, [1.0, 0.0, 0.0]), (60, [7.0])]
    odd = [(None, [1.0, 1.0]), (4, None), (6, [0.0, 0.0]), (80, [float("nan"), 1.0]), (7, [float("inf"), 1.0]), (8, [None, 1.0]), (9, [])]
    df = spark.createDataFrame(rows + odd, "vec_id long, embedding array<double>")
    got = hamming_search.search(df, F.col("vec_id") % 20 == 0, 3).collect()
    by = collections.defaultdict(list)
    for r in sorted(got, key=lambda r: (r["query_id"], r["rank"])):
        by[r["query_id"]].append((-r["score"], r["vec_id"]))
    assert dict(by) == {q: e for q, e in brute_search(rows, 3).items() if e}
    assert hamming_search.search(df.limit(0), F.col("vec_id") % 20 == 0).collect() == []
    assert hamming_search.search(df, F.lit(False)).collect() == []


def test_index_finds_every_code_within_the_radius():
    rng = np.random.default_rng(0)
    codes = rng.integers(0, 1 << 16, (2000, 16)).astype(np.uint16)
    codes[1000:] = codes[:1000] ^ np.where(rng.random((1000, 16)) < 0.2, 1 << rng.integers(0, 16, (1000, 16)), 0).astype(np.uint16)
    index = hamming_search.Index(codes)
    for radius in (0, 1, 3, 7, 16, 40, 100, 128, 256):
        for i in range(0, 2000, 371):
            expected = np.flatnonzero(hamming_search.distances(codes[i:i + 1], codes)[0] <= radius)
            assert index.within(codes[i], radius).tolist() == expected.tolist()


def brute_phrases(rows, least, top):
    count, total = collections.Counter(), collections.Counter()
    for _, text, lang in rows:
        for piece in re.split("[.,;:!?\x0a-\x0d]", (text or "").translate(UP)):
            words = re.findall("[^ \t]+", piece)
            total[lang or "und"] += len(words)
            for k in range(1, 5):
                count.update((lang or "und", *words[i:i + k]) for i in range(len(words) - k + 1))
    found = {p: a for p, a in count.items() if len(p) > 2 and a >= least}
    dropped = set()
    for p, f in found.items():
        for k in range(2, len(p) - 1):
            for i in range(1, len(p) - k + 1):
                inner = (p[0], *p[i:i + k])
                if 100 * f >= 80 * found[inner]:
                    dropped.add(inner)
    out = collections.defaultdict(list)
    for p, a in found.items():
        if p not in dropped:
            cuts = [(2000000 * a // (count[p[:k]] + count[(p[0], *p[k:])]), k) for k in range(2, len(p))]
            score, k = min(cuts)
            out[p[0]].append((-score, -a, " ".join(p[1:]).encode(), count[p[:k]], count[(p[0], *p[k:])]))
    return {(lang, i + 1, p.decode(), -a, l, r, total[lang], -s) for lang, some in out.items()
            for i, (s, a, p, l, r) in enumerate(sorted(some)[:top])}


@pytest.mark.parametrize("small", [False, True])
def test_phrases(spark, monkeypatch, small):
    """With ``small`` every block is one text, tasks sort a few suffixes at a time and the filter is nearly full."""
    if small:
        for name, value in (("BLOCK", 1), ("SORTED", 50), ("SMALL", 3), ("FILTER", 64), ("HOT", 40), ("ROUTES", 5)):
            monkeypatch.setattr(phrases, name, value)
    for least, top in ((5, 2000), (30, 7)):
        got = phrases.collocations(frame(spark, ROWS), least, top).collect()
        expected = brute_phrases(ROWS, least, top)
        assert len(got) == len(expected) > 0 and {tuple(r) for r in got} == expected


def test_phrases_of_nothing(spark):
    assert phrases.collocations(frame(spark, ROWS).limit(0)).collect() == []
    assert phrases.collocations(frame(spark, [(1, None, None), (2, "", "de"), (3, "one", "de")]), 1).collect() == []


def test_quicksort_counts_every_prefix():
    rng = np.random.default_rng(3)
    columns = [rng.integers(1, 5, 3000).astype(np.uint64) for _ in range(4)]
    columns[2][rng.random(3000) < 0.2] = 0
    columns[3][(rng.random(3000) < 0.2) | (columns[2] == 0)] = 0
    weights = rng.integers(1, 4, 3000)
    expected = collections.Counter()
    for *row, w in zip(*[c.tolist() for c in columns], weights.tolist()):
        for k in (2, 3, 4):
            if row[k - 1]:
                expected[tuple(row[:k])] += w
    for least, small in ((1, 8), (40, 4), (40, 5000)):
        was, phrases.SMALL = phrases.SMALL, small
        at, size, n = phrases.partition(columns, np.arange(3000), weights, least)
        phrases.SMALL = was
        got = {tuple(int(columns[d][p]) for d in range(k)): c for p, k, c in zip(at.tolist(), size.tolist(), n.tolist())}
        assert len(got) == len(at) and got == {p: c for p, c in expected.items() if c >= least}
