"""What became of every enqueued file, as a join of two streams."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quayside.functions import scalars
from quayside.streaming import live


def completions(enqueued: DataFrame, completed: DataFrame, within_us: int, delay_us: int) -> DataFrame:
    """Each row of the stream ``enqueued`` (id, hash, enqueued_us) with its completion from the stream ``completed`` (id,
    state, completed_us) at most ``within_us`` later, or with nulls.

    Both streams carry a watermark. A row without a completion comes out once both have passed the time it had, and is then
    stuck; until that it is state, and so is a completion until no row to come can ask for it. Rows without a time are left out, a
    null id has no completion.
    """
    live.use_disk_state(enqueued.sparkSession)
    late = f"{delay_us} microseconds"
    begun = enqueued.filter("enqueued_us IS NOT NULL").withColumn("begun_at", scalars.from_micros("enqueued_us")).withWatermark("begun_at", late)
    done = completed.filter("completed_us IS NOT NULL").select(
        F.col("id").alias("done_id"), "state", "completed_us", scalars.from_micros("completed_us").alias("done_at")).withWatermark("done_at", late)
    meet = F.expr(f"id = done_id AND done_at >= begun_at AND done_at <= begun_at + INTERVAL '{within_us // 1_000_000}' SECOND")
    return begun.join(done, meet, "leftOuter").select("id", "hash", "enqueued_us", "completed_us", "state")


def outcomes(met: DataFrame, as_of_us: int, within_us: int) -> DataFrame:
    """``operators.ledger.lifecycle`` from the rows of ``completions``: per hash the first time enqueued, the last completion,
    outcome and latency."""
    per_hash = met.groupBy("hash").agg(
        F.min("enqueued_us").alias("enqueued_us"),
        F.max(F.when(F.col("state").isNotNull(), F.struct("completed_us", "state"))).alias("done"))
    stuck = F.col("done").isNull() & (F.lit(as_of_us) - F.col("enqueued_us") > within_us)
    return per_hash.select(
        "hash", "enqueued_us", F.col("done.completed_us").alias("completed_us"),
        F.when(F.col("done").isNotNull(), F.col("done.state")).when(stuck, "stuck").otherwise("enqueued").alias("outcome"),
        (F.col("done.completed_us") - F.col("enqueued_us")).alias("latency_us"))
