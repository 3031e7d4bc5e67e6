"""Measure key sizes, and cut the history of keys that are too large for one task.

Ordinary keys, up to ``hot_rows`` rows each, are handled whole by one task. Larger ones are cut into
segments by range partitioning on (key, order): Spark samples the sort order and fills partitions
evenly, so a single key covers as many as it needs, however its rows are spread over time.

A table is read once to measure it, once more when all keys are ordinary, and three more times when some
are hot; hand in a written table (``session.written``) where computing it is expensive.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quayside.session import checkpoint_root, written

HOT_ROWS = 2_000_000
BROADCAST_KEYS = 200_000
STEPS = 6
SEG = "_segment"


@dataclass(frozen=True)
class Hot:
    """Keys above the limit: a written table of at most ``BROADCAST_KEYS`` keys, how many there are, and
    how many rows they have together."""

    keys: DataFrame
    count: int
    rows: int
    hot_rows: int

    def segments(self, factor: int = 1) -> int:
        return math.ceil(factor * self.rows / self.hot_rows) + 1


def measure(df: DataFrame, keys: Sequence[str], hot_rows: int = HOT_ROWS) -> Hot | None:
    """Counts rows per key with map-side combining; a few numbers reach the driver.

    Should more keys lie above the limit than may be broadcast, the limit is raised, so what counts as
    hot stays a small set at any data size.
    """
    sizes = df.groupBy(*keys).agg(F.count("*").alias("_n"))
    limits = [hot_rows * 16**i for i in range(STEPS)]
    asked = [x for limit in limits for x in (f"count_if(_n > {limit})", f"sum(if(_n > {limit}, _n, 0))")]
    answer = sizes.filter(f"_n > {hot_rows}").selectExpr(*asked).first()
    for i, limit in enumerate(limits):
        count, rows = answer[2 * i], answer[2 * i + 1]
        if count <= BROADCAST_KEYS:
            if not count:
                return None
            found = sizes.filter(f"_n > {limit}").select(*keys)
            return Hot(written(found, "hot") if keys else found, count, rows, limit)
    return None


def divide(df: DataFrame, keys: Sequence[str], hot: Hot | None) -> tuple[DataFrame | None, DataFrame | None]:
    """(rows of ordinary keys, rows of hot keys)."""
    if hot is None:
        return df, None
    if not keys:
        return None, df
    few = F.broadcast(renamed(hot.keys, keys))  # counted just now
    return df.join(few, same(keys), "left_anti"), df.join(few, same(keys), "left_semi")


def renamed(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """``df`` with its keys under names of their own, to be joined by ``same``."""
    return df.withColumnsRenamed({k: f"_key{i}" for i, k in enumerate(keys)})


def same(keys: Sequence[str]) -> list[Column]:
    """Equal keys; a null key is a key like any other."""
    return [F.col(k).eqNullSafe(F.col(f"_key{i}")) for i, k in enumerate(keys)]


def pin(df: DataFrame, keys: Sequence[str], order: Sequence[str], segments: int) -> DataFrame:
    """Rows sorted by (keys, order) over evenly filled partitions, with the partition number as segment.

    Range bounds come from a sample, so another run could cut elsewhere. The checkpoint pins them for
    everything that follows, and it survives the loss of executors.
    """
    checkpoint_root(df.sparkSession)
    cut = df.repartitionByRange(segments, *keys, *order).sortWithinPartitions(*keys, *order)
    return cut.checkpoint().withColumn(SEG, F.spark_partition_id())


def by_size(df: DataFrame, keys: Sequence[str], order: Sequence[str],
            fn: Callable[[DataFrame, Column | None], DataFrame], hot_rows: int = HOT_ROWS) -> DataFrame:
    """Applies ``fn(rows, segment)`` to ordinary keys (segment None) and to pinned hot ones."""
    hot = measure(df, keys, hot_rows)
    ordinary, large = divide(df, keys, hot)
    if hot is None:
        return fn(ordinary, None)
    out = fn(pin(large, keys, order, hot.segments()), F.col(SEG)).drop(SEG)
    return out if ordinary is None else fn(ordinary, None).unionByName(out)
