"""Debounce, lease, rate, breaker and TTL decisions over logs, one machine each."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quayside.operators.folds import HOT_ROWS, fold
from quayside.operators.machines import Breaker, GreedyGap, TokenBucket


def debounce(events: DataFrame, keys: Sequence[str], us: str, tie: str, gap_us: int,
             hot_rows: int = HOT_ROWS) -> DataFrame:
    """Adds ``accepted``: false when the key's last accepted event is less than ``gap_us`` old."""
    return fold(events, keys, us, [tie], GreedyGap(gap_us), hot_rows)


def lease_grants(requests: DataFrame, keys: Sequence[str], us: str, tie: str, ttl_us: int, release: str,
                 hot_rows: int = HOT_ROWS) -> DataFrame:
    """Adds ``accepted``: a request is granted when no lease is held, that is released or run out."""
    return fold(requests, keys, us, [tie], GreedyGap(ttl_us, release), hot_rows)


def ttl_dedup(arrivals: DataFrame, key: str, us: str, tie: str, ttl_us: int, hot_rows: int = HOT_ROWS) -> DataFrame:
    """Adds ``accepted``: the key was not accepted within the last ``ttl_us``."""
    return fold(arrivals, [key], us, [tie], GreedyGap(ttl_us), hot_rows)


def rate_admission(events: DataFrame, keys: Sequence[str], us: str, tie: str, rate: int, period_us: int,
                   burst: int | None = None, hot_rows: int = HOT_ROWS) -> DataFrame:
    """Adds ``admitted`` from a token bucket per key that starts full."""
    return fold(events, keys, us, [tie], TokenBucket(rate, period_us, burst), hot_rows)


def breaker_verdicts(outcomes: DataFrame, keys: Sequence[str], us: str, tie: str, max_failures: int, reset_us: int,
                     ok: str = "ok", hot_rows: int = HOT_ROWS) -> DataFrame:
    return fold(outcomes, keys, us, [tie], Breaker(max_failures, reset_us, ok), hot_rows)


def breaker_episodes(verdicts: DataFrame, keys: Sequence[str], us: str) -> DataFrame:
    """One row per time the breaker was open: when it opened, what it refused, when it was probed."""
    starts = F.when(F.col("opens"), F.col(us))
    touched = F.array_compact(F.array("episode_us", starts))
    rows = verdicts.withColumn("opened_us", F.explode(touched))
    met = F.col("opened_us") == F.col("episode_us")
    return rows.groupBy(*keys, "opened_us").agg(
        F.count_if(met & (F.col("verdict") == "short_circuited")).alias("refused"),
        F.max(F.when(met & F.col("probes"), F.col(us))).alias("probed_us"))
