"""Scalar functions on hashes, times, buckets and encoded values."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from quayside.config import DAY_US, Buckets, RetryConfig


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def micros(ts: Column | str) -> Column:
    """Epoch microseconds; accepts zoned and zone-free timestamps (session zone is UTC)."""
    return F.unix_micros(_col(ts).cast("timestamp"))


def from_micros(us: Column | str) -> Column:
    return F.timestamp_micros(_col(us))


def content_hash(filename: Column | str, content: Column | str) -> Column:
    """Hex SHA-256 of the base name's bytes followed by the content, with no separator."""
    return F.sha2(F.concat(F.encode(_col(filename), "UTF-8"), _col(content)), 256)


def pack_failure(epoch: Column | str, reason: Column | str) -> Column:
    return F.concat_ws(":", _col(epoch).cast("string"), _col(reason))


def unpack_failure(packed: Column | str) -> tuple[Column, Column]:
    """(epoch, reason); the reason may itself contain colons."""
    parts = F.split(_col(packed), ":", 2)
    return F.element_at(parts, 1).cast("long"), F.element_at(parts, 2)


def backoff_ms(k: Column | str, cfg: RetryConfig) -> Column:
    """Delay after failed attempt k (from 0), capped.

    The cap applies from the second delay on: the first one is taken as configured.
    """
    grown = F.lit(float(cfg.initial_delay_ms)) * F.pow(F.lit(cfg.multiplier), _col(k))
    capped = F.least(F.lit(float(cfg.max_delay_ms)), grown)
    return F.when(_col(k) == 0, F.lit(float(cfg.initial_delay_ms))).otherwise(capped)


def age_days(mtime_us: Column | str, now_us: Column | str) -> Column:
    """Whole 24-hour blocks between the two instants, toward zero."""
    return ((_col(now_us) - _col(mtime_us)) / F.lit(DAY_US)).cast("long")


def next_midnight(ts: Column | str) -> Column:
    return F.date_trunc("day", _col(ts).cast("timestamp")) + F.expr("interval 1 day")


def split_list(value: Column | str) -> Column:
    return F.split(_col(value), ",")


def bucket_bounds(b: Buckets) -> Column:
    return F.transform(
        F.sequence(F.lit(0), F.lit(b.count - 1)),
        lambda i: F.lit(float(b.start)) * F.pow(F.lit(float(b.factor)), i),
    )


def bucket_index(value: Column | str, b: Buckets) -> Column:
    """0-based index of the first bound >= value; ``b.count`` is +Inf. NULL and NaN land in +Inf.

    The bounds are literals, so this stays one generated expression without a bucket join.
    """
    v = _col(value).cast("double")
    out = None
    for i, bound in enumerate(b.bounds()):
        out = F.when(v <= bound, i) if out is None else out.when(v <= bound, i)
    return out.otherwise(b.count)


def percent(numerator: Column | str, denominator: Column | str) -> Column:
    """Percentage with one decimal, 0 when there is nothing to divide by."""
    n, d = _col(numerator), _col(denominator)
    return F.when(d > 0, F.round(F.lit(100.0) * n / d, 1)).otherwise(F.lit(0.0))
