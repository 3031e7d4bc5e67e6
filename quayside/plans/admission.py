"""Which landed files are accepted, and why was every other one turned away?"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quayside.config import AdmissionConfig
from quayside.functions import paths, patterns, scalars
from quayside.operators import filters, ledger, ordered
from quayside.session import written
from quayside.sinks.publish import Topic
from quayside.sources import archives, inventory, landing

# Lane a reason leads to. Files that lose the race for a hash, or that can not be read or
# moved, stay where they are.
LANES = {
    None: "processing",
    "pattern_mismatch": "ignored",
    "pattern_mismatch_scan": "ignored",
    "file_not_stable": "ignored",
    "rate_limit_exceeded": "ignored",
    "file_too_small": "ignored",
    "file_too_large": "ignored",
    "duplicate": "ignored",
    "lock_held": "incoming",
    "pool_full": "incoming",
    "stat_error": "incoming",
    "hash_error": "incoming",
    "move_error": "incoming",
    "zip_extraction_failed": "failed",
    "queue_error": "failed",
}


def lane_of(reason: Column) -> Column:
    what = F.substring_index(reason, ":", 1)
    lane = F.when(reason.isNull(), LANES[None])
    for name, target in LANES.items():
        if name is not None:
            lane = lane.when(what == name, target)
    return lane


def cheap_reason(cfg: AdmissionConfig, mode: str = "scan", filename: str = "filename", length: str = "length") -> Column:
    """What name and size alone decide; NULL when the content has to be looked at."""
    mismatch = "pattern_mismatch" if mode == "event" else "pattern_mismatch_scan"
    return F.coalesce(
        F.when(~patterns.accepts(filename, cfg.include, cfg.exclude), mismatch),
        filters.size_reason(length, cfg.min_bytes, cfg.max_bytes),
    )


def decide(files: DataFrame, cfg: AdmissionConfig, mode: str = "scan") -> DataFrame:
    """Drops sidecars; adds filename, kind and what name and size decide."""
    rows = files.filter(~filters.is_sidecar("path", mode)).withColumn("filename", paths.basename("path"))
    return rows.withColumn("kind", paths.kind("filename")).withColumn("reason", cheap_reason(cfg, mode))


def settle(turned_away: DataFrame, candidates: DataFrame, processed: DataFrame | None,
           order: Sequence[str]) -> DataFrame:
    """Candidates against the ledger and against each other, plus the rows already turned away.

    Candidates whose hash the ledger holds as processed are duplicates; of equal hashes among the rest
    the first in ``order`` wins and the others find it locked. ``candidates`` is used several times and
    should be materialised.
    """
    keep = ["path", "filename", "kind", "length", *[c for c in order if c != "path"]]
    parts = []
    if processed is not None:
        processed = ledger.key_set(processed)
        parts.append(ledger.duplicates(candidates, processed).withColumn("reason", F.lit("duplicate")))
        candidates = ledger.new_only(candidates, processed)
    raced = ordered.first_of_group(candidates, ["hash"], list(order))
    parts.append(raced.withColumn("reason", F.when(~F.col("is_first"), "lock_held")))
    out = turned_away.select(*keep, F.lit(None).cast("string").alias("hash"), "reason")
    for part in parts:
        out = out.unionByName(part.select(*out.columns))
    return out.withColumn("lane", lane_of(F.col("reason")))


def classify(files: DataFrame, cfg: AdmissionConfig, processed: DataFrame | None = None, mode: str = "scan",
             order: Sequence[str] = ("arrived_us", "path")) -> DataFrame:
    """Every file with its reason (NULL for accepted) and lane.

    ``files`` has path, length, content and the ``order`` columns. Content is read and hashed once, only
    for what name and size leave over; the hashed rows without content are written once. Rejected rows
    come from a branch that never selects content, so a columnar or file source does not read it there.
    """
    turned_away = decide(files.drop("content"), cfg, mode).filter("reason is not null")
    left = decide(files, cfg, mode).filter("reason is null")
    hashed = left.withColumn("hash", scalars.content_hash("filename", "content")).drop("content")
    return settle(turned_away, written(hashed, "candidates"), processed, order)


def summary(classified: DataFrame) -> DataFrame:
    return classified.groupBy("lane", F.coalesce("reason", F.lit("accepted")).alias("reason"), "kind").agg(
        F.count("*").alias("files"), F.sum("length").alias("bytes"))


def published(classified: DataFrame, messages: DataFrame, topic: Topic, batch: str) -> DataFrame:
    """The outcomes once ``messages`` (key, value), one per accepted hash, have been published.

    Accepted files whose message became a dead letter fail as ``queue_error: <why>``; the reason keeps the detail.
    """
    dead = topic.publish(messages, batch).dead.select(F.col("key").alias("_key"), F.col("error").alias("_error")).dropDuplicates(["_key"])
    failed = F.col("reason").isNull() & F.col("_key").isNotNull()
    return classified.join(dead, F.col("reason").isNull() & (F.col("hash") == F.col("_key")), "left").withColumns({
        "reason": F.when(failed, F.concat(F.lit("queue_error: "), "_error")).otherwise(F.col("reason")),
        "lane": F.when(failed, LANES["queue_error"]).otherwise(F.col("lane"))}).drop("_key", "_error")


def admit(found: DataFrame, cfg: AdmissionConfig, processed: DataFrame | None = None, max_depth: int = archives.DEEPEST) -> DataFrame:
    """Verdicts for listed files (path, modificationTime, length), archives opened.

    Only files that name and size leave over are opened, by path and in chunks: the built-in file source
    would read the content of every file it lists and keep it in one cell.
    """
    keep = ["path", "filename", "kind", "length", "modificationTime"]
    tasks = int(found.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    decided = decide(found, cfg, "scan")
    turned_away = decided.filter("reason is not null")
    left = decided.filter("reason is null").select(*keep)
    zipped = paths.is_archive("filename")
    plain = landing.hash_by_path(left.filter(~zipped), tasks)
    # Members are unpacked, judged and hashed in one pass; their contents go no further.
    unpacked = archives.expand(landing.with_content(left.filter(zipped)), cfg.max_bytes, max_depth)
    judged = decide(unpacked.withColumnRenamed("error", "_error"), cfg, "scan").withColumn(
        "reason", F.coalesce("_error", "reason")).withColumn("modificationTime", F.lit(None).cast("timestamp"))
    hashed = F.when(F.col("reason").isNull(), scalars.content_hash("filename", "content"))
    members = written(judged.withColumn("hash", hashed).select(*keep, "hash", "reason"), "members")
    hashed_plain = written(plain.select(*keep, "hash"), "candidates")
    candidates = hashed_plain.filter("hash is not null").unionByName(members.filter("reason is null").drop("reason"))
    unread = hashed_plain.filter("hash is null").drop("hash").withColumn("reason", F.lit("hash_error"))
    rejects = turned_away.select(*keep, "reason").unionByName(unread).unionByName(
        members.filter("reason is not null").drop("hash"))
    # Members have no time of their own: in the race a plain file of equal name and bytes goes first.
    last = F.lit("9999-12-31 00:00:00").cast("timestamp")
    timed = candidates.withColumn("modificationTime", F.coalesce("modificationTime", last))
    out = settle(rejects, timed, processed, ("modificationTime", "path"))
    return out.withColumn("modificationTime", F.nullif("modificationTime", last)) if "modificationTime" in out.columns else out


def admit_landing(spark: SparkSession, cfg: AdmissionConfig, processed: DataFrame | None = None,
                  complete: bool = False, max_depth: int = archives.DEEPEST) -> DataFrame:
    """Batch run over the files below the configured roots.

    The built-in file source does not list hidden files, empty files and names that start with an
    underscore. With ``complete`` an inventory of mounted roots takes its place.
    """
    if complete:
        found = inventory.scan(spark, cfg.roots).filter("not is_dir").select(
            "path", F.col("mtime").alias("modificationTime"), F.col("size").alias("length"))
    else:
        found = landing.scan(spark, cfg.roots).drop("content")
    return admit(found, cfg, processed, max_depth)
