"""Publish attempts: what came of them and when the next ones are due."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quayside.config import RetryConfig
from quayside.operators import ordered


def rollup(attempts: DataFrame, keys: Sequence[str], cfg: RetryConfig = RetryConfig(),
           order: Sequence[str] = ("attempt_us", "attempt_id")) -> DataFrame:
    """Final status, attempts used and last error per key.

    Attempts after the first success or after ``max_attempts`` do not count. With no attempts allowed
    every key has failed without a call. A key that may still try again is 'pending'.
    """
    keys = list(keys)
    if cfg.max_attempts <= 0:
        return attempts.select(*keys).distinct().select(
            *keys, F.lit("failed").alias("status"), F.lit(0).cast("long").alias("attempts"),
            F.lit(None).cast("string").alias("last_error"))
    head = ordered.first_rows(attempts, keys, order, cfg.max_attempts)
    per_key = head.groupBy(*keys).agg(
        F.min(F.when(F.col("ok"), F.col("rank"))).alias("_ok"),
        F.count("*").alias("_n"),
        F.max(F.when(~F.col("ok"), F.struct("rank", "error"))).alias("_bad"),
    )
    failed = F.col("_ok").isNull() & (F.col("_n") >= cfg.max_attempts)
    return per_key.select(
        *keys,
        F.when(F.col("_ok").isNotNull(), "sent").when(failed, "failed").otherwise("pending").alias("status"),
        F.coalesce(F.col("_ok"), F.col("_n")).cast("long").alias("attempts"),
        F.when(failed, F.col("_bad.error")).alias("last_error"),
    )


def delays_ms(cfg: RetryConfig) -> list[int]:
    """Waits between attempts; none after the last one."""
    out, delay = [], float(cfg.initial_delay_ms)
    for _ in range(max(cfg.max_attempts - 1, 0)):
        out.append(int(delay))
        delay = min(delay * cfg.multiplier, cfg.max_delay_ms)
    return out


def schedule(first_tries: DataFrame, first_us: str, cfg: RetryConfig = RetryConfig()) -> DataFrame:
    """Planned instant of every attempt 1..n of every row."""
    offsets, total = [0], 0
    for d in delays_ms(cfg):
        total += d
        offsets.append(total)
    plan = F.array(*[F.struct(F.lit(i + 1).alias("attempt"), F.lit(ms).cast("long").alias("offset_ms"))
                     for i, ms in enumerate(offsets[: cfg.max_attempts])])
    return first_tries.withColumn("_p", F.explode(plan)).select(
        *first_tries.columns, F.col("_p.attempt").alias("attempt"),
        (F.col(first_us) + F.col("_p.offset_ms") * 1000).alias("planned_us"))
