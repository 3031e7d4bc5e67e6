"""Names, paths, patterns and scalars against fixed rows."""

import pytest
from pyspark.sql import functions as F

from quayside.config import SIZE_BYTES, RetryConfig
from quayside.functions import paths, patterns, scalars

MATCHES = [
    ("test.txt", "*", True), ("test.xml", "*.xml", True), ("test.txt", "*.xml", False), ("test.txt", "test.txt", True),
    ("test.txt", "other.txt", False), ("test123.txt", "test*.txt", True), ("a.XML", "*.xml", True),
    ("a.tar.gz", "*.tar.gz", False), ("a.tar.gz", "*.gz", True), ("a.xml", "*.x*", False), (".env", ".*", True),
    ("testA.XML", "test*.xml", False), ("a", "[", False), ("f:Zone.Identifier", "*Zone.Identifier", True),
    ("a1", "a[0-9]", True), ("ab", "a[^0-9]", True), ("a1", "a[^0-9]", False), ("a", "[]a]", False), ("-", "[-]", False),
    ("a*", "a\\*", True), ("ab", "a\\*", False), ("a", "a\\", False), ("abc", "a?c", True), ("ac", "a?c", False),
    ("a\nb", "a?b", True), ("a.b", "a[.]b", True), ("axb", "a.b", False), ("a", "[b-a]", False), ("x]", "x\\]", True),
    ("é", "?", True), ("a", "", False), ("", "", True), ("abc", "a*c*", True), ("[", "[", True),
]


def test_patterns(spark):
    wanted = {}
    row = spark.range(1)
    for i, (name, pattern, want) in enumerate(MATCHES):
        row = row.withColumn(f"m{i}", patterns.match(F.lit(name), pattern))
        wanted[f"m{i}"] = want
    got = row.drop("id").first().asDict()
    assert {MATCHES[int(k[1:])][:2]: v for k, v in got.items()} == {MATCHES[int(k[1:])][:2]: v for k, v in wanted.items()}


def test_exclude_wins_and_empty_include_takes_all(spark):
    names = spark.createDataFrame([("a.xml",), (".a.xml",), ("b.tmp",), ("c.txt",)], "n string")
    pick = lambda inc, exc: [r[0] for r in names.filter(patterns.accepts("n", inc, exc)).collect()]
    assert pick(["*.xml"], [".*"]) == ["a.xml"]
    assert pick([], [".*", "*.tmp"]) == ["a.xml", "c.txt"]
    assert pick([], []) == ["a.xml", ".a.xml", "b.tmp", "c.txt"]


@pytest.mark.parametrize("fn,rows", [
    (paths.basename, [("/a/b.xml", "b.xml"), ("/a/b/", "b"), ("/", "/"), ("", "."), ("x", "x"), ("//", "/")]),
    (paths.dirname, [("/a/b.xml", "/a"), ("/a", "/"), ("a", "."), ("/a/b/", "/a/b"), ("a/b", "a"), ("", ".")]),
    (paths.parent, [("/a/b.xml", "/a"), ("/a", "/")]),
    (lambda p: paths.under("/work//processing/", p), [("a.xml", "/work/processing/a.xml")]),
    (paths.clean, [("/a/../b//c/.", "/b/c"), ("/../x", "/x"), ("a/../..", ".."), ("../../a", "../../a"), ("", "."),
                   ("a/./b/", "a/b"), ("/", "/"), ("a/..", "."), ("a/../../b", "../b")]),
    (paths.ext, [("a.tar.gz", ".gz"), (".env", ".env"), ("noext", ""), ("dot.", "."), ("/a.b/c", "")]),
    (paths.kind, [("a.XML", "xml"), (".env", "env"), ("noext", "unknown"), ("dot.", "")]),
    (paths.is_archive, [("test.zip", True), ("TEST.ZIP", True), ("test.xml", False), ("test.zip.tmp", False)]),
    (paths.ancestors, [("/a/b/c", ["/a", "/a/b"]), ("/a", []), ("/x/y", ["/x"])]),
])
def test_paths(spark, fn, rows):
    df = spark.createDataFrame([(r[0],) for r in rows], "p string")
    assert [r[0] for r in df.select(fn("p")).collect()] == [r[1] for r in rows]


def test_join_and_inside(spark):
    row = spark.range(1).select(
        paths.join("/work/", "processing", "a.xml").alias("a"), paths.join("", "x", "../y").alias("b"),
        paths.join("", "").alias("c"),
        paths.is_inside(F.lit("/in/../x"), F.lit("/in")).alias("d"), paths.is_inside(F.lit("/in/a/../b"), F.lit("/in/")).alias("e"),
        paths.is_inside(F.lit("/inner/b"), F.lit("/in")).alias("f")).first()
    assert tuple(row) == ("/work/processing/a.xml", "y", "", False, True, False)


def test_scalars(spark):
    row = spark.range(1).select(
        scalars.unpack_failure(F.lit("12:queue_error: a:b"))[1].alias("reason"),
        scalars.content_hash(F.lit("a"), F.lit("bc").cast("binary")).alias("h1"),
        scalars.content_hash(F.lit("ab"), F.lit("c").cast("binary")).alias("h2"),
        scalars.percent(F.lit(1), F.lit(3)).alias("p"), scalars.percent(F.lit(1), F.lit(0)).alias("zero"),
        scalars.age_days(F.lit(0), F.lit(3 * 86_400_000_000 - 1)).alias("age"),
        scalars.bucket_bounds(SIZE_BYTES).alias("bounds"),
        scalars.next_midnight(F.lit("2024-02-29 23:59:59")).cast("string").alias("next"),
    ).first()
    assert row["reason"] == "queue_error: a:b"
    assert row["h1"] == row["h2"] and len(row["h1"]) == 64
    assert (row["p"], row["zero"], row["age"], row["next"]) == (33.3, 0.0, 2, "2024-03-01 00:00:00")
    assert row["bounds"] == SIZE_BYTES.bounds() and row["bounds"][-1] == 16 * 1024 * 1024
    cfg = RetryConfig(4, 50, 100, 3.0)
    assert [r[0] for r in spark.range(4).select(scalars.backoff_ms("id", cfg)).collect()] == [50, 100, 100, 100]


def test_bucket_edges(spark):
    values = spark.createDataFrame([(0.0,), (1024.0,), (1024.5,), (2.0**24,), (2.0**24 + 1,)], "v double")
    assert [r[0] for r in values.select(scalars.bucket_index("v", SIZE_BYTES)).collect()] == [0, 0, 1, 14, 15]
