"""Operational numbers: counters, histograms, quantiles, rates and gauges."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quayside.config import DAY_US, Buckets
from quayside.functions import scalars
from quayside.operators import ordered, skew
from quayside.session import written

#: Instants of a gauge that one task puts in order.
GAUGE_ROWS = 200_000
#: Rows with all bucket counters that one task puts in order; each takes about half a kilobyte there.
BUCKET_ROWS = 100_000

# Which counters one outcome raises. 'detected' only counts what arrived through the
# event path and is no archive; see COUNTS_DETECTED.
OUTCOME_COUNTERS: dict[str, tuple[str, ...]] = {
    "accepted": ("sent", "processed"),
    "pattern_mismatch": ("ignored",),
    "pattern_mismatch_scan": ("ignored",),
    "file_not_stable": ("ignored",),
    "rate_limit_exceeded": ("rate_limit_dropped", "ignored"),
    "pool_full": ("rate_limit_dropped",),
    "file_too_small": ("ignored", "rejected"),
    "file_too_large": ("ignored", "rejected"),
    "duplicate": ("ignored", "duplicated"),
    "lock_held": ("duplicated",),
    "zip_extraction_failed": ("watcher_errors",),
    "queue_error": ("queue_errors",),
    "stat_error": (),
    "hash_error": (),
    "move_error": (),
}
# Outcomes reached only after the file has been counted as detected.
COUNTS_DETECTED = ("accepted", "rate_limit_exceeded", "pool_full", "file_too_small", "file_too_large", "duplicate",
                   "lock_held", "queue_error", "stat_error", "hash_error", "move_error")
COUNTERS = ("detected", "sent", "processed", "duplicated", "rejected", "ignored", "watcher_errors", "queue_errors",
            "storage_errors", "rate_limit_waits", "rate_limit_dropped", "empty_directories_removed")


def _raises(counter: str, reason: Column, mode: str, archive: Column) -> Column:
    if counter == "detected":
        return reason.isin(*COUNTS_DETECTED) & ~archive if mode == "event" else F.lit(False)
    reasons = [r for r, counters in OUTCOME_COUNTERS.items() if counter in counters]
    return reason.isin(*reasons) if reasons else F.lit(False)


def outcome_counters(outcomes: DataFrame, by: Sequence[str], mode: str = "event", reason: str = "reason",
                     is_archive: Column | None = None, storage_errors: Column | None = None) -> DataFrame:
    """All counters per group in one partial + final aggregate.

    ``reason`` may carry a detail after a colon (``queue_error: ...``). ``storage_errors`` marks rows
    whose ledger call failed; processing went on, so it is counted beside the outcome.
    """
    what = F.substring_index(F.col(reason), ":", 1)
    archive = is_archive if is_archive is not None else F.lit(False)
    aggs = [F.count_if(_raises(c, what, mode, archive)).alias(c) for c in COUNTERS if c != "storage_errors"]
    failed = storage_errors if storage_errors is not None else F.lit(False)
    return outcomes.groupBy(*by).agg(*aggs, F.count_if(failed).alias("storage_errors")).select(*by, *COUNTERS)


def total_counters(*parts: DataFrame) -> DataFrame:
    """One row with all counters, from any number of frames that each have some of them."""
    every = [p.select(*[F.col(c).cast("long").alias(c) if c in p.columns else F.lit(0).cast("long").alias(c) for c in COUNTERS])
             for p in parts]
    both = every[0]
    for part in every[1:]:
        both = both.unionByName(part)
    return both.agg(*[F.coalesce(F.sum(c), F.lit(0).cast("long")).alias(c) for c in COUNTERS])


def histogram(df: DataFrame, value: Column | str, buckets: Buckets, by: Sequence[str] = ()) -> DataFrame:
    """One row per group: cumulative counts per bound (the last one is +Inf), sum and count.

    The bucket of a value is an expression over literal bounds; nothing is joined or multiplied.
    """
    v = F.col(value) if isinstance(value, str) else value
    rows = df.select(*by, v.alias("_v"), scalars.bucket_index(v, buckets).alias("_b"))
    cumulative = F.array(*[F.count_if(F.col("_b") <= i) for i in range(buckets.count + 1)])
    return rows.groupBy(*by).agg(
        cumulative.alias("cumulative"), F.sum("_v").alias("total"), F.count("*").alias("observations"))


def histogram_rows(hist: DataFrame, buckets: Buckets, by: Sequence[str] = ()) -> DataFrame:
    """(group, bucket, le, cumulative_count); ``le`` is NULL on the unbounded last bucket."""
    bounds = F.array(*[F.lit(float(b)) for b in buckets.bounds()])
    return hist.select(*by, F.posexplode("cumulative").alias("bucket", "cumulative_count")).withColumn(
        "le", F.get(bounds, F.col("bucket")))


def quantile(q: float, buckets: Buckets, cumulative: str = "cumulative") -> Column:
    """Linear interpolation inside the bucket that holds rank q * count.

    The first bucket starts at 0, the unbounded one answers with the highest finite bound, and no
    observations give NULL.
    """
    cum = F.col(cumulative)
    bounds = F.array(*[F.lit(float(b)) for b in buckets.bounds()])
    rank = F.lit(q) * F.element_at(cum, -1)
    at = (F.array_position(F.transform(cum, lambda c: c >= rank), F.lit(True)) - 1).cast("int")
    before = F.when(at > 0, F.get(cum, at - 1)).otherwise(F.lit(0))
    start = F.when(at > 0, F.get(bounds, at - 1)).otherwise(F.lit(0.0))
    inside = F.get(cum, at) - before
    value = start + (F.get(bounds, at) - start) * (rank - before) / F.when(inside > 0, inside)
    return F.when(F.element_at(cum, -1) > 0,
                  F.when(at >= buckets.count, F.lit(float(buckets.bounds()[-1]))).otherwise(value))


def success_rate(counters: DataFrame) -> DataFrame:
    """Adds the success percentage and the total of everything decided."""
    return counters.withColumn("success_rate", scalars.percent("sent", "detected")).withColumn(
        "total", F.col("sent") + F.col("duplicated") + F.col("rejected"))


def counter_rate(samples: DataFrame, range_us: int, tie: str = "sample_id", hot_rows: int = skew.HOT_ROWS,
                 sizes_from: DataFrame | None = None) -> DataFrame:
    """Per-second increase over the trailing range, aware of counter resets.

    Input (name, us, value, tie). The increase is summed from the first sample inside [us - range, us]
    and divided by the seconds really covered (no extrapolation to the range's edges); a lone
    sample has no rate.

    With S the running sum of increases, the answer is a difference of two values of S. The one at the
    range's start is looked up in a second ordered pass, backwards in time: every sample also asks, at
    us - range, for the earliest sample from there on, which is the last one passed. Both passes are
    running aggregates, so the cost does not grow with the range. ``sizes_from`` may name a cheaper table
    with the same ``name`` per row to measure key sizes on.
    """
    order = ["us", tie]

    def summed(rows: DataFrame, segment: Column | None) -> DataFrame:
        before = ordered.previous(rows, ["name"], order, "value", "_before", segment)
        return ordered.running(before, ["name"], order, _increase(F.col("value"), F.col("_before")), "_sum", segment).drop(
            "_before", skew.SEG)

    out = _over_range(samples, range_us, tie, hot_rows, sizes_from, summed)
    covered = (F.col("us") - F.col("_first.us")) / F.lit(1_000_000.0)
    return out.select(
        *samples.columns,
        F.when(covered > 0, (F.col("_sum") - F.col("_first.sum")) / covered).alias("rate"))


def _increase(value: Column, before: Column) -> Column:
    """What a counter gained since the sample before; one that fell has started over."""
    return F.when(before.isNull(), 0.0).when(value < before, value).otherwise(value - before)


def bucket_increase(samples: DataFrame, range_us: int, width: int, tie: str = "sample_id", hot_rows: int = BUCKET_ROWS,
                    sizes_from: DataFrame | None = None) -> DataFrame:
    """Adds ``increase``: what each of the ``width`` cumulative bucket counters in ``value`` gained over the trailing range.

    The same as the increase behind ``counter_rate``, bucket by bucket, in the same two passes: running sums of all
    buckets, then the difference to the sums at the range's start. ``quantile`` over it is a quantile of what happened within
    the range; dividing by its seconds would change nothing.
    """
    order = ["us", tie]

    def summed(rows: DataFrame, segment: Column | None) -> DataFrame:
        before = ordered.previous(rows, ["name"], order, "value", "_before", segment)
        gains = {f"_gain{i}": _increase(F.get("value", F.lit(i)), F.get("_before", F.lit(i))) for i in range(width)}
        return ordered.running_sums(before, ["name"], order, gains, segment).withColumn("_sum", F.array(*gains)).drop(
            "_before", skew.SEG, *gains)

    out = _over_range(samples, range_us, tie, hot_rows, sizes_from, summed)
    return out.select(*samples.columns, F.zip_with("_sum", "_first.sum", lambda a, b: a - b).alias("increase"))


def _over_range(samples: DataFrame, range_us: int, tie: str, hot_rows: int, sizes_from: DataFrame | None,
                summed: Callable[[DataFrame, Column | None], DataFrame]) -> DataFrame:
    """Every sample with its running ``_sum``, as ``summed(rows, segment)`` makes it, and ``_first``: time, tie and sum of the
    earliest sample of its name within the trailing range."""
    order = ["us", tie]
    hot = skew.measure(samples if sizes_from is None else sizes_from, ["name"], hot_rows)
    ordinary, large = skew.divide(samples, ["name"], hot)
    parts = [] if ordinary is None else [(ordinary, None, None)]
    if hot is not None:
        parts.append((skew.pin(large, ["name"], order, hot.segments()), F.col(skew.SEG), hot))

    def looked_up(rows: DataFrame, segment: Column | None) -> DataFrame:
        passed = F.when(~F.col("_asks"), F.struct("us", F.col(tie).alias("tie"), F.col("_sum").alias("sum")))
        seen = ordered.running(rows, ["name"], backward, passed, "_first", segment, "min")
        return seen.filter("_asks")

    # At equal times the samples are passed (false sorts first) before the question is asked.
    backward = ["_back", "_asks", "_back_tie"]
    out = None
    for rows, segment, size in parts:
        points = summed(rows, segment).withColumn("_asks", F.explode(F.array(F.lit(False), F.lit(True)))).withColumn(
            "_back", F.when(F.col("_asks"), F.lit(range_us) - F.col("us")).otherwise(-F.col("us"))).withColumn(
            "_back_tie", -F.col(tie))
        if size is None:
            answered = looked_up(points, None)
        else:
            cut = skew.pin(points, ["name"], backward, size.segments(2))
            answered = looked_up(cut, F.col(skew.SEG)).drop(skew.SEG)
        out = answered if out is None else out.unionByName(answered)
    return out


def daily_running(events: DataFrame, keys: Sequence[str], us: str = "us", tie: str = "event_id",
                  hot_rows: int = skew.HOT_ROWS) -> DataFrame:
    """Counter value after each event; counters start over at midnight."""
    per_day = [*keys, "day"]
    rows = events.withColumn("day", ordered.time_segment(us, DAY_US))
    return skew.by_size(
        rows, per_day, [us, tie],
        lambda part, segment: ordered.running(part, per_day, [us, tie], F.lit(1), "running_count", segment), hot_rows)


def reset_epochs(events: DataFrame, keys: Sequence[str], is_reset: Column, counted_by: Sequence[str],
                 us: str = "us", tie: str = "event_id", hot_rows: int = skew.HOT_ROWS) -> DataFrame:
    """Counter value after each event when reset rows set all counters of their key to zero.

    A reset row opens the next epoch and is not counted itself.
    """
    def count(rows: DataFrame, segment: Column | None) -> DataFrame:
        opened = F.when(is_reset, 1).otherwise(0)
        numbered = ordered.running(rows, keys, [us, tie], opened, "epoch", segment)
        return ordered.running(numbered.filter(~is_reset), [*keys, "epoch", *counted_by], [us, tie], F.lit(1),
                               "running_count", segment)

    return skew.by_size(events, keys, [us, tie], count, hot_rows)


def gauge(intervals: DataFrame, start: str, stop: str, hot_rows: int = GAUGE_ROWS) -> DataFrame:
    """How many intervals are open after each instant at which one starts or ends.

    Changes at the same instant are combined first, on the map side. All instants form one history; a long one is cut
    into evenly filled segments, however dense some of its hours are.
    """
    edges = F.array(F.struct(F.col(start).alias("us"), F.lit(1).alias("d")),
                    F.struct(F.col(stop).alias("us"), F.lit(-1).alias("d")))
    changes = (
        intervals.select(F.explode(edges).alias("e")).groupBy(F.col("e.us").alias("us"))
        .agg(F.sum("e.d").alias("change"))
    )
    return skew.by_size(
        written(changes, "changes"), [], ["us"],
        lambda rows, segment: ordered.running(rows, [], ["us"], F.col("change"), "open", segment), hot_rows).select("us", "change", "open")


def backlog(intervals: DataFrame, submitted: str, started: str) -> DataFrame:
    """Peak number of submitted but not yet started items for every day from the first change to the last.

    The level that a day begins with counts, unless it changes at once; a day without a change keeps the level
    of the one before. The days themselves, one narrow row each, are put in order by a single task.
    """
    day = ordered.time_segment("us", DAY_US)
    changed = gauge(intervals, submitted, started).groupBy(day.alias("day")).agg(
        F.max("open").alias("top"), F.min("us").alias("first"), F.min_by(F.col("open") - F.col("change"), "us").alias("before"),
        F.max_by("open", "us").alias("after"))
    begun = F.when(F.col("first") > F.col("day") * DAY_US, F.greatest("top", "before")).otherwise(F.col("top"))
    until = F.lead("day", 1).over(Window.orderBy("day"))
    days = changed.select("day", begun.alias("top"), "after", F.coalesce(until, F.col("day") + 1).alias("until"))
    each = days.withColumn("at", F.explode(F.sequence("day", F.col("until") - 1)))
    return each.select(F.col("at").alias("day"), F.when(F.col("at") == F.col("day"), F.col("top")).otherwise(F.col("after")).alias("peak"))


def windowed_outcomes(events: DataFrame, ts: str, width: str, classes: dict[str, Column]) -> DataFrame:
    """Counts per tumbling window; the same on a stream that carries a watermark."""
    return events.groupBy(F.window(ts, width).alias("w")).agg(
        *[F.count_if(cond).alias(name) for name, cond in classes.items()]
    ).select(F.col("w.start").alias("window_start"), *classes)


def distinct_content(files: DataFrame, approximate: bool = False) -> DataFrame:
    """Files and distinct contents per kind."""
    distinct = F.approx_count_distinct("hash") if approximate else F.count_distinct("hash")
    return files.groupBy("kind").agg(F.count("*").alias("files"), distinct.alias("contents"))


def content_sketches(files: DataFrame, by: Sequence[str], lg: int = 14) -> DataFrame:
    """Files and a mergeable sketch of their distinct contents per group: rows of bounded size that can be kept and merged
    over any range later. The error of an estimate is about 1.04 / sqrt(2 ** lg), 0.8 % by default."""
    return files.groupBy(*by).agg(F.count("*").alias("files"), F.hll_sketch_agg("hash", F.lit(lg)).alias("sketch"))


def merged_contents(sketches: DataFrame, by: Sequence[str]) -> DataFrame:
    """Files and estimated distinct contents of groups of kept sketches."""
    return sketches.groupBy(*by).agg(
        F.sum("files").alias("files"), F.hll_sketch_estimate(F.hll_union_agg("sketch")).alias("contents_about"))


def trailing(at: Column | str, width: int) -> Column:
    """The numbers of the ``width`` periods whose trailing range holds period ``at``."""
    first = F.col(at) if isinstance(at, str) else at
    return F.sequence(first, first + F.lit(width - 1).cast("long"))
