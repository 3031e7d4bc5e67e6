"""The event path as one stream: three keyed stages, one behind the other, on one mark."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quayside.config import AdmissionConfig
from quayside.functions import paths, patterns
from quayside.operators import filters, ordered
from quayside.operators.ledger_store import TieredLedger
from quayside.operators.machines import GreedyGap, TokenBucket
from quayside.plans import admission
from quayside.session import written
from quayside.streaming import timed


def judged(spark: SparkSession, base: str, events: DataFrame, batch: int, cfg: AdmissionConfig, delay_us: int, watched: str,
           limit_by: Sequence[str], rate: int, period_us: int, burst: int | None = None, tie: str = "event_id",
           forget_us: int | None = None) -> tuple[DataFrame, list[int]]:
    """What debounce, name, stability, rate and size say of the files noticed, as far as one more micro-batch tells:
    ``plans.event_path`` on a stream.

    ``events`` has path, op, us, length, the tie, the watched path, the columns of ``limit_by``, and ``sample_size`` and
    ``sample_mtime``, what a look at the watched path found at that moment. Marks of seen paths, verdicts and buckets are
    tables below ``base``: what has run out is dropped, what waits leaves when the mark has passed it. Rows reach the
    limiter in the order of their time: a verdict that falls after the last mark makes nothing ready before itself.
    Returns the rows with filename, kind, ready_us and reason (null: goes on to the ledger), and how many rows each stage keeps.
    """
    keep = list(dict.fromkeys([tie, "path", "us", "length", watched, *limit_by, "sample_size", "sample_mtime"]))
    arrives = F.coalesce(filters.is_arrival("op") & ~filters.is_sidecar("path", "event"), F.lit(False))
    marks = timed.Marks(spark, base, "us", delay_us)
    came, mark = marks.take(events.withColumn("passed_by", ~arrives).select(*keep, "passed_by"), batch)
    debounce = timed.Stage(spark, f"{base}/debounce", came.schema, ["path"], "us", [tie], GreedyGap(cfg.debounce_us), "passed_by")
    seen = debounce.step(came, mark, batch)
    sampled = seen.withColumn("noticed", F.coalesce("accepted", F.lit(False))).drop("passed_by", "accepted")
    gate = timed.Gate(spark, f"{base}/gate", sampled.schema, watched, "us", tie, "noticed", "sample_size", "sample_mtime",
                      cfg.stable_attempts, cfg.stable_deadline_us, forget_us)
    steady = gate.step(sampled, mark, batch).drop("noticed", "sample_size", "sample_mtime")
    named = steady.withColumn("filename", paths.basename("path")).withColumn("kind", paths.kind("filename"))
    wanted = patterns.accepts("filename", cfg.include, cfg.exclude)
    early = named.withColumn("early", F.when(~wanted, "pattern_mismatch").when(~F.col("stable"), "file_not_stable"))
    early = early.withColumn("turned_away", F.col("early").isNotNull()).drop("stable")
    limiter = timed.Stage(spark, f"{base}/limiter", early.schema, limit_by, "ready_us", [tie], TokenBucket(rate, period_us, burst), "turned_away")
    limited = limiter.step(early, mark, batch)
    over = F.when(~F.col("admitted"), "rate_limit_exceeded")
    reason = F.coalesce("early", over, filters.size_reason("length", cfg.min_bytes, cfg.max_bytes))
    return (limited.withColumn("reason", reason).drop("early", "turned_away", "admitted"),
            [stage.size(batch) for stage in (debounce, gate, limiter)])


def raced(judged: DataFrame, book: TieredLedger, order: Sequence[str]) -> DataFrame:
    """One micro-batch of ``judged`` rows with a hash where nothing turned them away, against the ledger and each other.

    Equal content that is processed makes a duplicate; of what is left the first in ``order`` wins unless earlier
    content is enqueued, and the others find it locked. Rows leave the chain in the order of ready_us, so a winner
    of an earlier micro-batch comes before those of later ones. ``judged`` is read several times.
    """
    open_ = judged.filter("reason IS NULL")
    known = written(book.lookup(open_.select("hash")).groupBy("hash").agg(F.bool_or(F.col("state") == "processed").alias("processed")), "known")
    met = written(open_.join(known.withColumnRenamed("hash", "_hash"), F.col("hash") == F.col("_hash"), "left").drop("_hash"), "met")
    fresh = ordered.first_of_group(met.filter("processed IS NULL"), ["hash"], list(order)).withColumn(
        "reason", F.when(~F.col("is_first"), "lock_held")).drop("is_first", "processed")
    old = met.filter("processed IS NOT NULL").withColumn(
        "reason", F.when(F.col("processed"), "duplicate").otherwise("lock_held")).drop("processed")
    out = judged.filter("reason IS NOT NULL").unionByName(old).unionByName(fresh)
    return out.withColumn("lane", admission.lane_of(F.col("reason")))
