"""Exact duplicates by progressive refinement: length, then a hash of the prefix, then a hash of the whole text.

Each step looks only at groups that the step before left with two rows or more. Only ids, lengths and hashes are
ever shuffled, never texts. Groups are aggregates that combine before the shuffle and are joined back by plain
equality, so a group may hold any share of the rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quayside.session import written

PREFIX = 256
FEW_GROUPS = 100_000


def content(text_col: str) -> Column:
    """The text's bytes; null counts as empty."""
    return F.coalesce(F.col(text_col).cast("binary"), F.lit("").cast("binary"))


def full_hash(text_col: str) -> Column:
    """Lowercase hex SHA-256 of the text in UTF-8."""
    return F.sha2(content(text_col), 256)


def exact_dedup(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", hash_all: bool = False) -> DataFrame:
    """One row per row of ``df``: doc_id, keep_id, group_size, kept, text_sha256.

    Texts are equal when their bytes are; a null text equals an empty one. Of equal texts the largest id stays;
    keep_id is that id, and kept says whether the row carries it. Rows that repeat both the id that stays and
    its text all stay. A null id stays only where its group has no other. text_sha256 is null for rows that
    length or prefix already show to be unique, whose content is not read in full, unless ``hash_all`` asks
    for it. Other columns are left out. An empty table gives no rows.
    """
    source = df.select(F.col(id_col).alias("doc_id"), content(text_col).alias("t"))
    keyed = source.select("doc_id", "t", F.octet_length("t").alias("n"), F.xxhash64(F.substring("t", 1, PREFIX)).alias("p"))

    # First reading: which lengths, and which prefixes among rows of such a length, occur more than once?
    prefixes = written(keyed.groupBy("n", "p").agg(F.count("*").alias("rows")), "prefixes")
    lengths = prefixes.groupBy("n").agg(F.sum("rows").alias("rows")).filter("rows > 1").select("n")
    shared = written(prefixes.join(lengths, "n", "left_semi").filter("rows > 1").select("n", "p"), "shared")

    # Second reading: full hashes for what is left. With few groups they go to the rows, so that no other text is
    # hashed. With more, hashing costs less than moving texts to the groups.
    groups = shared.withColumn("again", F.lit(True))
    if not hash_all and shared.count() <= FEW_GROUPS:  # two numbers a group: some megabytes
        rows = keyed.join(F.broadcast(groups), ["n", "p"], "left").select(
            "doc_id", "n", F.when(F.col("again"), F.sha2("t", 256)).alias("h"), "again")
    else:
        rows = keyed.select("doc_id", "n", "p", F.sha2("t", 256).alias("h")).join(groups, ["n", "p"], "left").select(
            "doc_id", "n", (F.col("h") if hash_all else F.when(F.col("again"), F.col("h"))).alias("h"), "again")
    left = rows.filter("again").groupBy("n", "h").agg(F.max("doc_id").alias("last"), F.count("*").alias("size"))
    again = left.filter("size > 1").selectExpr("h as hash", "n as length", "last", "size")
    # A null hash matches nothing: rows that an earlier step settled stay as they are.
    out = rows.join(again, F.expr("h = hash AND n = length"), "left").select(
        "doc_id", F.when(F.col("size").isNull(), F.col("doc_id")).otherwise(F.col("last")).alias("keep_id"),
        F.coalesce("size", F.lit(1)).cast("long").alias("group_size"), F.col("h").alias("text_sha256"))
    return out.select("doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), "text_sha256")
