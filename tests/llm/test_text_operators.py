"""Small tables with nulls, empty and long texts, ties, repeated rows and clashing names, against brute force."""

import base64
import collections
import hashlib
import itertools
import math
import random
import re
import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from quayside.llm import (
    exact_dedup,
    jaccard_join,
    packing,
    preference,
    sentencepiece,
    suffix_dedup,
    token_output,
    topk,
    toxicity,
    warc,
)
from quayside.session import scratch

TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")
PIECES = public_tokenizers.path("piece_bpe_32k.model")
SCHEMA = "doc_id long, text string, tag string, n long, node string, block int"


def make(seed=3, n=60):
    rng = random.Random(seed)
    words = [a + b for a in ("ba", "ké", "lo", "mü", "x") for b in ("", "ra", "ti", "n")]
    line = " ".join(rng.choice(words) for _ in range(40))
    rows = []
    for i in range(n):
        text = " ".join(rng.choice(words) for _ in range(rng.choice((1, 5, 60, 120))))
        if i % 3 == 0:
            text += " " + line + " " + rng.choice(words)
        if i % 7 == 0 and rows:
            text = rows[-1][1]
        if i % 11 == 0 and rows:
            some = (rows[-2][1] or "").split(" ")
            some[len(some) // 2] = "zz"
            text = " ".join(some)
        rows.append((i, text))
    rows += [(100, None), (101, ""), (102, ""), (None, "only null id"), (None, rows[2][1]), (103, "a" * 5000), (104, "a" * 300),
             (105, "A b\tC\x0bd"), (106, "  two  spaces \n and\t tabs  "), (107, " ".join(words * 400)), rows[5], rows[5]]
    return rows


ROWS = make()


def frame(spark, rows):
    """Other columns carry names that operators use inside."""
    return spark.createDataFrame([(d, t, "x", 7, "y", 1) for d, t in rows], SCHEMA)


@pytest.fixture(scope="module")
def docs(spark):
    return frame(spark, ROWS)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def key(row):
    return tuple((v is None, v) for v in row)


def same(got, want):
    got, want = sorted(map(tuple, got), key=key), sorted(want, key=key)
    assert got == want, [p for p in zip(got, want) if p[0] != p[1]][:3]


@pytest.mark.parametrize("all_rows", [False, True])
def test_exact_dedup(docs, none, all_rows):
    groups = collections.defaultdict(list)
    for d, t in ROWS:
        groups[t or ""].append(d)
    want = []
    for d, t in ROWS:
        ids = [x for x in groups[t or ""] if x is not None]
        keep = max(ids) if ids else None
        want.append((d, keep, len(groups[t or ""]), d == keep))
    out = exact_dedup.exact_dedup(docs, hash_all=all_rows)
    same(out.drop("text_sha256").collect(), want)
    hashes = {hashlib.sha256((t or "").encode()).hexdigest() for _, t in ROWS}
    assert {r[0] for r in out.select("text_sha256").collect()} - {None} <= hashes
    assert not exact_dedup.exact_dedup(none).collect()


def spans_by_hand(rows, size):
    owner = {}
    order = [(math.inf if d is None else d, (t or "").encode()) for d, t in rows]
    for d, x in order:
        for i in range(len(x) - size + 1):
            owner[x[i:i + size]] = min(d, owner.get(x[i:i + size], math.inf))
    out = []
    for (d, _), (o, x) in zip(rows, order):
        gone = bytearray(len(x))
        for i in range(len(x) - size + 1):
            if owner[x[i:i + size]] < o:
                gone[i:i + size] = b"\1" * size
        kept = bytes(c for c, g in zip(x, gone) if not g)
        out.append((d, len(x), sum(gone), len(re.findall(b"\1+", bytes(gone))), hashlib.sha256(kept).hexdigest()))
    return out


@pytest.mark.parametrize("size", [50, 20, 9])
def test_suffix_dedup(docs, size):
    same(suffix_dedup.repeats(docs, size, with_text=False).collect(), spans_by_hand(ROWS, size))


def test_suffix_dedup_spread_and_empty(docs, none, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "MANY", 1)
    out = suffix_dedup.repeats(docs, 30)
    same(out.drop("spans", "kept").collect(), spans_by_hand(ROWS, 30))
    for r in out.collect():
        assert sum(s["end"] - s["start"] for s in r["spans"]) == r["n_removed"]
        assert hashlib.sha256(bytes(r["kept"])).hexdigest() == r["kept_sha256"]
    assert not suffix_dedup.repeats(none).collect()


def test_windows_over_pieces():
    hasher, rng = suffix_dedup.Hasher(50), np.random.default_rng(1)
    text = rng.integers(97, 100, suffix_dedup.PIECE + 5000, np.uint8).tobytes()
    seen = 0
    for names, parts in suffix_dedup.chunks([b"short", text, b"x" * 60], 50):
        lo, n, h, c = hasher.runs(np.frombuffer(b"".join(parts), np.uint8), np.cumsum([len(p) for p in parts]))
        seen += n.sum()
    assert seen == len(text) - 49 + 11


def components_by_hand(rows, k, num):
    sets = []
    for d, t in rows:
        low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")
        w = re.findall(r"[^\x20\x09-\x0D]+", low)
        sets.append({tuple(w[i:i + k]) for i in range(max(1, len(w) - k + 1))} if w else set())
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in itertools.combinations(range(len(rows)), 2):
        if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= num * len(sets[a] | sets[b]):
            parent[find(a)] = find(b)
    least = {}
    for i, (d, _) in enumerate(rows):
        least[find(i)] = min(least.get(find(i), math.inf), math.inf if d is None else d)
    return [(d, len(sets[i]), None if least[find(i)] == math.inf else least[find(i)]) for i, (d, _) in enumerate(rows)]


@pytest.mark.parametrize("k,num,limit,often", [(3, 90, 256, 16), (5, 80, 256, 16), (3, 60, 2, 16), (2, 70, 256, 2)])
def test_jaccard_join(docs, monkeypatch, k, num, limit, often):
    monkeypatch.setattr(jaccard_join, "FREQUENT", often)
    out = jaccard_join.groups(docs, words=k, num=num, den=100, long_list=limit)
    same(out.collect(), components_by_hand(ROWS, k, num))


def test_jaccard_join_empty(none):
    assert not jaccard_join.groups(none).collect()


def test_divide_skip():
    rng = random.Random(5)
    for _ in range(200):
        query = sorted(rng.sample(range(40), 12))
        sets = [sorted(rng.sample(range(40), rng.randint(1, 20))) for _ in range(6)]
        need = [rng.randint(1, 10) for _ in sets]
        want = [i for i, s in enumerate(sets) if len(set(s) & set(query)) >= need[i]]
        assert jaccard_join.divide_skip(query, sets, need) == want


@pytest.fixture(scope="module")
def ids():
    t = Tokenizer.from_file(TOKENIZER)
    t.encode_special_tokens = True
    return lambda text: t.encode(text or "", add_special_tokens=False).ids


def crc(x):
    return zlib.crc32(np.array(x, "<u4").tobytes())


def test_token_output(spark, docs, none, ids):
    folder = scratch(spark, "tokens")
    shards = token_output.write(docs, folder, TOKENIZER, shard_bytes=2000)
    assert shards.count() > 2
    rows = token_output.read(shards, folder).collect()
    same([(r["doc_id"], r["n_tokens"], r["ids_crc32"]) for r in rows],
         [(d, len(ids(t)) + 1, crc(ids(t) + [0])) for d, t in ROWS])
    rows.sort(key=lambda r: r["start"])
    assert [r["start"] for r in rows] == [0, *itertools.accumulate(r["n_tokens"] for r in rows)][:-1]
    known = [r["doc_id"] for r in rows if r["doc_id"] is not None]
    assert known == sorted(known) and all(crc(r["ids"]) == r["ids_crc32"] for r in rows)
    one = token_output.Shard(shards.orderBy("shard").first()["path"], token_output.read_dictionary(folder))
    number = len(one.index) - 1
    assert len(one.ids(number)) == one.index["ids"][number]
    with pytest.raises(ValueError):
        token_output.Shard(shards.first()["path"], b"another dictionary")
    folder = scratch(spark, "tokens")
    assert not token_output.read(token_output.write(none, folder, TOKENIZER), folder).collect()


def test_packing(docs, none, ids):
    rows = packing.pack(docs, TOKENIZER, capacity=256).collect()
    whole = collections.Counter((d, crc(ids(t) + [1])) for d, t in ROWS)
    sequences, pieces = collections.defaultdict(list), collections.defaultdict(list)
    for r in rows:
        sequences[r["sequence_id"]].append((r["offset"], r["length"]))
        assert r["length"] > 0 and zlib.crc32(r["tokens"]) == r["ids_crc32"]
        pieces[r["doc_id"], r["doc_tokens"]].append((r["start"], bytes(r["tokens"])))
    for places in sequences.values():
        places.sort()
        assert [p[0] for p in places] == [0, *itertools.accumulate(p[1] for p in places)][:-1]
        assert sum(p[1] for p in places) <= 256
    once = [k for k, n in collections.Counter(d for d, _ in ROWS).items() if n == 1]
    for (doc, n), some in pieces.items():
        if doc in once:
            data = b"".join(x for _, x in sorted(some))
            assert len(data) == 4 * n and whole[doc, zlib.crc32(data)] == 1
    assert sum(r["length"] for r in rows) == sum(len(ids(t)) + 1 for _, t in ROWS)
    assert not packing.pack(none, TOKENIZER).collect()


def test_cuts():
    for n in range(1, 5000, 7):
        parts = packing.cuts(n, 2048, 0.02)
        assert sum(parts) == n and max(parts) <= 2048 and min(parts) > 0


def every_path(pieces, word):
    into = pieces.edges(word)

    def back(at):
        if at == 0:
            yield 0.0, ()
        for i, s, own in into[at]:
            for score, some in back(i):
                yield score + s, some + own

    return sorted(back(len(word)), reverse=True)


def test_sentencepiece_search():
    pieces = sentencepiece.Pieces(PIECES, 5)
    for word in ("▁the", "▁onion", "▁é漢x", "▁aaaa", "ing", "▁▁▁a"):
        want = every_path(pieces, word)
        got = list(itertools.islice(pieces.paths(word), 8))
        assert [s for s, _ in got] == [s for s, _ in want[:8]]
        assert len({p for _, p in got}) == len(got) and set(got) <= set(want)
    for text in ("the onion is", "a b", "on on on on", ""):
        words = pieces.word.findall(pieces.model.normalize(text))
        whole = [0.0]
        for w in words:
            whole = sorted((a + s for a in whole for s, _ in every_path(pieces, w)), reverse=True)[:5]
        found = pieces.encode([text])[0]
        assert [s for s, _ in found] == whole and len({i for _, i in found}) == len(found)


def test_sentencepiece(docs, none):
    rows = sentencepiece.encode(docs, PIECES, n=3).collect()
    assert all(r["round_trip"] for r in rows) and {r["doc_id"] for r in rows} == {d for d, _ in ROWS}
    assert [(r["score"], r["n_pieces"]) for r in rows if r["doc_id"] == 100] == [(0.0, 0)]
    assert not sentencepiece.encode(none, PIECES).collect()


def test_warc(spark, none):
    pages = [(1, "http://a/x y", "<p>é</p>"), (2, None, "<p>é</p>"), (3, "u", None), (4, "u", ""), (5, "u", "x" * 100_000),
             (None, "u", "<p>é</p>"), (6, "u\r\nWARC-Type: x", "one\r\n\r\ntwo"), (7, "u", "z"), (7, "u", "z")]
    df = spark.createDataFrame([(*p, "q") for p in pages], "page_id long, url string, html string, size string")
    for least in (0, 9):
        last = {}
        for p, _, h in pages:
            h = (h or "").encode()
            last[h] = max(last.get(h, -1), -1 if p is None else p)
        want = []
        for p, _, h in pages:
            h = (h or "").encode()
            refers = last[h] if p != last[h] and len(h) >= least else None
            want.append((p, len(h), base64.b32encode(hashlib.sha1(h).digest()).decode(), "revisit" if refers is not None else "response", refers))
        archives = warc.write(df, scratch(spark, "warc"), least=least, file_bytes=1000)
        got = warc.read(archives).collect()
        same([r[:5] for r in got], want)
        assert {bytes(r["payload"]) for r in got if r["payload"] is not None} == {(h or "").encode() for _, _, h in pages}
    empty = spark.createDataFrame([], df.schema)
    assert not warc.read(warc.write(empty, scratch(spark, "warc"))).collect()


def test_warc_dictionary(tmp_path):
    records = [warc.record(i, "http://a/", b"<html><body>%d same words again</body></html>" % i * 20, 1, "D") for i in range(400)]
    path = str(tmp_path / "a.warc.zst")
    size = warc.write_file(path, records)
    data = open(path, "rb").read()
    assert list(warc.read_file(path)) == records and size == len(data) and data[:4] == b"\x5d\x2a\x4d\x18"


def test_topk(spark):
    rng = np.random.default_rng(2)
    rows = [(i, [float(x) for x in rng.normal(size=4).round(1)]) for i in range(90)]
    rows += [(90, None), (91, [1.0, float("nan"), 0.0, 0.0]), (92, [1.0, None, 0.0, 0.0]), (None, [1.0] * 4), (93, [float("inf")] * 4),
             (94, [2.0, 1.0]), (95, []), (60, [1.0, 1.0]), (7, rows[7][1]), (1000, [1e17] * 4), (1020, [-1e17, 1.0, 1.0, 1.0])]
    df = spark.createDataFrame([(*r, "x") for r in rows], "vec_id long, embedding array<double>, id string")
    usable = [(i, [math.floor(64 * x) for x in v]) for i, v in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    want = []
    for q in sorted({i for i, _ in usable if i % 20 == 0}):
        v = min(x for i, x in usable if i == q)
        lim = (1 << 63) - 1
        some = sorted((-max(-lim, min(lim, sum(min(a, lim) * min(b, lim) for a, b in zip(v, x)))), i) for i, x in usable if i != q and len(x) == len(v))
        want += [(q, r, i, -s) for r, (s, i) in enumerate(some[:5], 1)]
    got = topk.search(df, F.col("vec_id") % 20 == 0, k=5).collect()
    small = lambda rows: [r for r in rows if r[0] < 1000 and r[2] < 1000]  # noqa: E731  sums near the limits of 64 bits may round
    same(small(map(tuple, got)), small(want))
    assert len(got) == len(want)
    assert not topk.search(df.limit(0), F.col("vec_id") % 20 == 0).collect()


def test_toxicity(spark, none):
    rng = random.Random(1)
    words = ["".join(rng.choice("abcdefg") for _ in range(5)) for _ in range(200)]
    rows, grades = [], []
    for i in range(900):
        grade = rng.choice((0, 0, 1, 2))
        rows.append((i, " ".join([*(rng.choice(words) for _ in range(40)), *["grim"] * (grade > 0), *["vile"] * (grade > 1)])))
        grades.append((i, grade, "x"))
    rows += [(2000, None), (2001, ""), (None, "grim vile")]
    labels = spark.createDataFrame([*grades[:500], (None, 1, "x"), (2000, None, "x")], "doc_id long, grade int, text string")
    df = frame(spark, rows)
    model = toxicity.fit_on(df, labels, F.col("grade"))
    assert model.grades == (0.0, 1.0, 2.0) and list(model.thresholds) == sorted(model.thresholds)
    got = {r["doc_id"]: r for r in toxicity.grade_documents(df, model).collect()}
    assert len(got) == len(rows)
    wrong = sum(round(got[i]["expected_severity"]) != g for i, g, _ in grades[500:])
    assert wrong < 20 and not got[2001]["toxic"] and got[None]["toxic"]
    alone = toxicity.fit(["a b"], [1.0])
    assert [tuple(r) for r in toxicity.grade_documents(df.limit(1), alone).select("expected_severity", "toxic").collect()] == [(1.0, False)]
    assert not toxicity.grade_documents(none, model).collect()
    assert toxicity.fit([], []).grades == (0.0,)


def test_preference(spark):
    turns = [(1, 0, "user", "hi"), (1, 1, "assistant", "yes"), (1, 2, "user", "so"), (1, 3, "assistant", "end"),
             (2, 0, "user", "hi"), (2, 1, "assistant", "no"), (3, None, None, None), (3, 0, "assistant", "x"), (None, 0, "user", "?"),
             (5, 0, "system", "s"), (6, 0, "user", "b"), (6, 0, "user", "a"), (6, 0, "user", "a")]
    df = spark.createDataFrame([(*t, 1) for t in turns], "conv_id long, turn long, role string, text string, id int")
    arrays = preference.as_arrays(df)
    assert {r["id"]: [t["text"] for t in r["turns"]] for r in arrays.collect()}[6] == ["a", "a", "b"]
    got = {r["id"]: r for r in preference.pairs(preference.with_other_reply(arrays)).collect()}
    show = lambda role, text: f"<|{role}|>\n{text}<|end|>\n"
    first = got[1]
    assert first["prompt_turns"] == 3
    assert first["prompt"] == show("user", "hi") + show("assistant", "yes") + show("user", "so")
    assert first["chosen"] == show("assistant", "end") and first["rejected"] == show("assistant", "no")
    span = first["chosen_spans"][0]
    assert first["chosen"][span["start"]:span["end"]] == "end<|end|>"
    assert got[2]["rejected"] == show("assistant", "x") and got[2]["prompt_turns"] == 1
    assert got[3]["rejected"] == "" and got[3]["chosen"] == show("assistant", "x")
    assert got[5]["prompt_turns"] == 1 and got[5]["chosen"] == got[5]["rejected"] == "" and not got[5]["chosen_spans"]
    assert set(got) == {1, 2, 3, 5, 6}
    assert not preference.pairs(preference.with_other_reply(preference.as_arrays(df.limit(0)))).collect()
    nulls = spark.createDataFrame([(1, None, None)], f"id long, chosen {preference.TURN}, rejected {preference.TURN}")
    assert tuple(preference.pairs(nulls).first())[:5] == (1, 0, "", "", "")
