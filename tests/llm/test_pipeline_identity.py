"""Decisions of the pipeline's stages among rows with null or repeated ids."""

import random
import zlib

import corpus_pipeline
import pytest

from quayside.llm import suffix_dedup

SCHEMA = "doc_id long, text string, n_chars int"


def frame(spark, rows):
    return spark.createDataFrame([(d, t, len(t)) for d, t in rows], SCHEMA)


def texts(df):
    return sorted((r["doc_id"] is None, r["doc_id"] or 0, r["text"]) for r in df.select("doc_id", "text").collect())


def plain(rows):
    return sorted((d is None, d or 0, t) for d, t in rows)


@pytest.mark.parametrize("doc", [None, 7])
def test_cut_spans_stay_with_their_text(spark, doc):
    rng = random.Random(4)
    word = lambda n: "".join(rng.choice("abcdefghijklmnop") for _ in range(n))
    one, two = word(80), word(80)
    heads = [word(40) for _ in range(5)]
    rows = [(1, one + heads[0]), (2, two + heads[1]),
            (doc, heads[2] + one), (doc, two + heads[3]), (doc, heads[4] + word(80))]  # of 120 bytes each
    got = corpus_pipeline.cut_repeats(spark, frame(spark, rows), "")
    assert texts(got) == plain([*rows[:2], (doc, heads[2]), (doc, heads[3]), rows[4]])
    assert all(r["n_chars"] == len(r["text"]) for r in got.collect())


def test_copies_with_null_ids_go(spark):
    rows = [(1, "one two three four five six"), (None, "one two three four five six"), (None, "a lonely text of some words"), (3, "")]
    assert texts(corpus_pipeline.drop_copies(spark, frame(spark, rows), "")) == plain([rows[0], *rows[2:]])
    long = " ".join(f"w{i}" for i in range(60))
    rows = [(1, long), (None, long + " end"), (None, "a lonely text of some more words"), (2, None)]
    df = spark.createDataFrame([(*r, 0) for r in rows], SCHEMA)
    got = corpus_pipeline.drop_near_copies(spark, df, "").collect()
    assert {(r["doc_id"], r["text"]) for r in got} == {rows[0], rows[2], rows[3]}


def collide():
    """Two texts of 120 bytes with one CRC-32 and different last bytes, found by trying; one begins with a shared passage."""
    rng = random.Random(3)
    base = b"abcdefghij" * 8
    cut, clean = base + b"k" * 30, bytes(97 + (i * 7) % 26 for i in range(110))
    tails = [bytes(rng.choices(range(97, 123), k=10)) for _ in range(300_000)]
    want = {zlib.crc32(clean + t): t for t in tails}
    for t in tails:
        if zlib.crc32(cut + t) in want:
            return (cut + t).decode(), (clean + want[zlib.crc32(cut + t)]).decode(), base.decode()
    raise AssertionError("no such pair")


def test_null_ids_with_one_crc(spark):
    """Rows without an id are told apart by their texts, whatever their CRC-32."""
    cut, clean, base = collide()
    rows = [(None, cut), (None, clean), (0, base), (None, cut)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    out = sorted((r["n_bytes"], r["n_removed"]) for r in suffix_dedup.repeats(df, 50, with_text=False).collect())
    assert out == [(80, 0), (120, 0), (120, 80), (120, 80)]
