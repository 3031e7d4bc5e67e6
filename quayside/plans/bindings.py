"""The landing-zone model read from the given tables, one view per function.

Every view is a projection (or one aggregate) of whole tables, so its size grows with them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quayside.config import HOUR_US, MINUTE_US
from quayside.functions import scalars
from quayside.schemas import TABLES
from quayside.session import prepare, written

# Fixed values shared with the SQL oracle.
EPOCH_US = 1_704_067_200_000_000  # 2024-01-01T00:00:00Z
EXTENSIONS = (".xml", ".XML", ".json", ".tmp", ".txt")
OPS = {"click": "CREATE", "view": "WRITE", "purchase": "CHMOD", "signup": "RENAME", "error": "REMOVE"}
LANES_BY_REMAINDER = ("processed", "failed", "ignored", "tmp")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    prepare(spark)
    return spark.read.schema(TABLES[name]).parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, filename, path, length, content, arrived_us, source from documents."""
    return as_files(table(spark, sf_dir, "documents"))


def as_files(documents: DataFrame) -> DataFrame:
    """The same columns of any rows of documents, a stream of them too."""
    ext = F.get(F.array(*[F.lit(e) for e in EXTENSIONS]), (F.col("n_chars") % len(EXTENSIONS)).cast("int"))
    name = F.concat("lang", F.lit("_"), F.col("n_chars").cast("string"), ext)
    return (
        documents
        .select(
            "doc_id", "lang", "source", "n_chars",
            name.alias("filename"),
            F.concat(F.lit("/landing/"), "source", F.lit("/"), name).alias("path"),
            F.octet_length("text").cast("long").alias("length"),
            F.encode("text", "UTF-8").alias("content"),
            (F.lit(EPOCH_US) + F.col("doc_id") * MINUTE_US).alias("arrived_us"),
        )
    )


def hashed_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """files with their content hash instead of their content."""
    return files(spark, sf_dir).withColumn("hash", scalars.content_hash("filename", "content")).drop("content")


def hashed_table(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    """doc_id, hash and the named columns of hashed_files, written once to the checkpoint folder.

    For plans that need them more than once: contents are read and hashed one single time, and only
    narrow rows travel afterwards.
    """
    return written(hashed_files(spark, sf_dir).select("doc_id", "hash", *columns), "hashed")


def labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "labels").select("doc_id", "toxic")


def ledger_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every file enqueued on arrival; labelled ones completed later: failed when toxic, else processed."""
    joined = hashed_files(spark, sf_dir).join(labels(spark, sf_dir), "doc_id", "left")
    done_at = F.col("arrived_us") + (F.col("n_chars") % 600) * MINUTE_US
    completion = F.when(
        F.col("toxic").isNotNull(),
        F.struct(F.when(F.col("toxic") == 1, "failed").otherwise("processed").alias("state"),
                 F.when(F.col("toxic") == 1, F.concat(F.lit("toxic:"), F.col("doc_id").cast("string"))).alias("reason"),
                 done_at.alias("at_us")))
    enqueued = F.struct(F.lit("enqueued").alias("state"), F.lit(None).cast("string").alias("reason"),
                        F.col("arrived_us").alias("at_us"))
    return joined.select(
        "doc_id", "hash", "path", F.explode(F.array_compact(F.array(enqueued, completion))).alias("e")
    ).select("doc_id", "hash", "e.state", "path", "e.reason", "e.at_us")


def as_arrivals(documents: DataFrame) -> DataFrame:
    """doc_id, hash, arrival and the time a completion would take, of any rows of documents, a stream of them too."""
    return as_files(documents).select(
        "doc_id", scalars.content_hash("filename", "content").alias("hash"), "arrived_us",
        ((F.col("n_chars") % 600) * MINUTE_US).alias("takes_us"))


def processed(hashed: DataFrame, labels: DataFrame) -> DataFrame:
    """Rows of labelled documents, whose hashes count as processed."""
    return hashed.join(labels, "doc_id", "left_semi")


def unprocessed(hashed: DataFrame, labels: DataFrame) -> DataFrame:
    return hashed.join(labels, "doc_id", "left_anti")


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events with the instant as epoch microseconds."""
    return table(spark, sf_dir, "events").withColumn("us", scalars.micros("ts"))


def file_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    op = F.create_map(*[F.lit(x) for pair in OPS.items() for x in pair])
    return events(spark, sf_dir).select(
        "event_id", "us", F.concat(F.lit("/landing/u"), F.col("user_id").cast("string")).alias("path"),
        F.element_at(op, F.col("event_type")).alias("op"))


def outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Call outcomes of ten sinks."""
    return events(spark, sf_dir).select(
        "event_id", "us", (F.col("user_id") % 10).alias("sink"), (F.col("event_type") != "error").alias("ok"))


def attempts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Publish attempts: one message per user and day, one attempt per event."""
    return events(spark, sf_dir).select(
        F.col("event_id").alias("attempt_id"), F.col("us").alias("attempt_us"), "user_id",
        F.floor(F.col("us") / (24 * HOUR_US)).alias("day"),
        (F.col("event_type") != "error").alias("ok"),
        F.when(F.col("event_type") == "error", F.concat(F.lit("publish:"), F.col("event_id").cast("string")))
        .alias("error"))


def file_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Size and change-day samples per user; every 97th sample finds the file gone."""
    return events(spark, sf_dir).select(
        F.col("event_id").alias("sample_id"), F.concat(F.lit("/landing/u"), F.col("user_id").cast("string")).alias("path"),
        F.col("us").alias("sample_us"),
        F.when(F.col("event_id") % 97 != 0, F.floor(F.col("value") / 50)).alias("size"),
        F.floor(F.col("us") / (24 * HOUR_US)).alias("mtime"))


def as_samples(events: DataFrame) -> DataFrame:
    """file_events and file_samples in one row, of any rows of events, a stream of them too."""
    op = F.create_map(*[F.lit(x) for pair in OPS.items() for x in pair])
    us = scalars.micros("ts")
    return events.select(
        "event_id", us.alias("us"), F.concat(F.lit("/landing/u"), F.col("user_id").cast("string")).alias("watched"),
        F.element_at(op, F.col("event_type")).alias("op"),
        F.when(F.col("event_id") % 97 != 0, F.floor(F.col("value") / 50)).alias("sample_size"),
        F.floor(us / (24 * HOUR_US)).alias("sample_mtime"))


def intervals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """orders as work items: submitted, started (first ship date), finished (last ship date)."""
    shipped = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(
        F.min("l_shipdate").alias("first"), F.max("l_shipdate").alias("last"))
    return table(spark, sf_dir, "orders").select("o_orderkey", "o_orderdate").join(shipped, "o_orderkey").select(
        "o_orderkey", scalars.micros("o_orderdate").alias("submit_us"),
        scalars.micros("first").alias("start_us"), scalars.micros("last").alias("finish_us"))


def page_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """pages as files: host and URL path, without scheme, query, fragment and trailing slash."""
    path = F.regexp_replace(F.regexp_replace(F.col("url"), r"^https?:/", ""), r"/?([?#].*)?$", "")
    return table(spark, sf_dir, "pages").select(
        "page_id", path.alias("path"), (~F.col("url").rlike("[?#]")).alias("on_disk"))


def kept_page_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """page_files that lie on disk: an address with a query or a fragment leaves only its directories,
    some of which stay empty."""
    return page_files(spark, sf_dir).filter("on_disk")


def lane_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """files spread over four lanes, last changed doc_id hours into the year."""
    lane = F.get(F.array(*[F.lit(x) for x in LANES_BY_REMAINDER]), (F.col("doc_id") % 4).cast("int"))
    return files(spark, sf_dir).select(
        "doc_id", "path", "filename", "length", lane.alias("lane"),
        (F.lit(EPOCH_US) + F.col("doc_id") * HOUR_US).alias("mtime_us"))
