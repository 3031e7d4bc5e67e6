"""The event path: from raw file events to a verdict for every file that was noticed."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quayside.config import AdmissionConfig
from quayside.functions import paths, patterns
from quayside.operators import filters, sequential
from quayside.operators.skew import HOT_ROWS
from quayside.plans import admission
from quayside.session import written


def admit_events(events: DataFrame, stability: DataFrame, cfg: AdmissionConfig,
                 add_hash: Callable[[DataFrame], DataFrame], processed: DataFrame | None = None,
                 watched: str = "path", limit_by: Sequence[str] = (), rate: int | None = None,
                 period_us: int = 1_000_000, burst: int | None = None, tie: str = "event_id",
                 hot_rows: int = HOT_ROWS) -> DataFrame:
    """Verdict per noticed file event (path, op, us, length, tie and the ``watched`` / ``limit_by`` columns).

    In order: creates and writes that are no sidecars; debounced per path, which marks a path as seen
    before its name is judged; name patterns; ``stability`` (``watched``, stable, duration_us: one row per
    watched file, no row means never stable); one token per file from its limiter at the moment it is
    stable; size; then ``add_hash`` for what is left, the ledger, and the race for equal hashes.

    Each sequential step is written once, narrow, because the steps after it read its rows twice.
    """
    keep = list(dict.fromkeys(["path", "us", "length", tie, watched, *limit_by]))
    noticed = filters.arrivals(events).select(*keep)
    seen = sequential.debounce(noticed, ["path"], "us", tie, cfg.debounce_us, hot_rows).filter("accepted")
    named = seen.drop("accepted").withColumn("filename", paths.basename("path")).withColumn(
        "kind", paths.kind("filename"))
    wanted = patterns.accepts("filename", cfg.include, cfg.exclude)
    steady = F.coalesce("stable", F.lit(False))
    judged = written(named.join(stability.select(watched, "stable", "duration_us"), watched, "left").withColumn(
        "reason", F.when(~wanted, "pattern_mismatch").when(~steady, "file_not_stable")).withColumn(
        "ready_us", F.col("us") + F.coalesce("duration_us", F.lit(0))).drop("stable", "duration_us"), "judged")
    limited = sequential.rate_admission(
        judged.filter("reason is null"), limit_by, "ready_us", tie, rate or cfg.max_files_per_second, period_us, burst,
        hot_rows)
    over = F.when(~F.col("admitted"), "rate_limit_exceeded")
    checked = written(limited.withColumn("reason", F.coalesce(
        over, filters.size_reason("length", cfg.min_bytes, cfg.max_bytes))).drop("admitted"), "checked")
    turned_away = judged.filter("reason is not null").unionByName(checked.filter("reason is not null"))
    candidates = written(add_hash(checked.filter("reason is null")), "candidates")
    return admission.settle(turned_away, candidates, processed, ("ready_us", "path", tie))
