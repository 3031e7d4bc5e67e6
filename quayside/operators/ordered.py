"""Ordered per-key computations that do not put one large key's rows into one task.

A plain window partitioned by a key sorts that key's whole history in a single task, which is right
for keys of ordinary size. The history of a larger one is cut into segments (``operators.skew``). Every
segment is worked on alone, and what a later segment must know about the earlier ones arrives as one
*carry row* per (key, segment), computed from a partial aggregate. The carry row sorts before the
segment's own rows, so it costs no join.

``segment`` must not decrease along the order; None means the keys are small enough to stay whole.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from quayside.operators import skew
from quayside.session import written

ROW = "_is_row"
_AGGS = {"sum": F.sum, "max": F.max, "min": F.min}


def time_segment(us: Column | str, width_us: int) -> Column:
    """Number of the fixed-width time slice a microsecond instant falls in."""
    col = F.col(us) if isinstance(us, str) else us
    width = F.lit(width_us)
    return ((col - F.pmod(col, width)) / width).cast("long")


def _window(keys: Sequence[str], order: Sequence[str | Column]) -> WindowSpec:
    return Window.partitionBy(*(keys or [F.lit(0)])).orderBy(*order)


def running(df: DataFrame, keys: Sequence[str], order: Sequence[str], value: Column, out: str,
            segment: Column | None = None, how: str = "sum") -> DataFrame:
    """Running ``sum``, ``max`` or ``min`` of ``value`` from the key's first row through the current one.

    With segments: one shuffle of the rows by (keys, segment); the totals per segment are combined on
    the map side, one row per (keys, segment).
    """
    agg = _AGGS[how]
    if segment is None:
        return df.withColumn(out, agg(value).over(
            _window(keys, order).rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    rows = df.withColumn("_cut", segment).withColumn("_value", value)
    totals = rows.groupBy(*keys, "_cut").agg(agg("_value").alias("_value"))
    earlier = _window(keys, ["_cut"]).rowsBetween(Window.unboundedPreceding, -1)
    carry = (
        totals.withColumn("_value", agg("_value").over(earlier))
        .filter("_value is not null").withColumn(ROW, F.lit(0))
    )
    so_far = _window([*keys, "_cut"], [ROW, *order]).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return (
        rows.withColumn(ROW, F.lit(1)).unionByName(carry, allowMissingColumns=True)
        .withColumn(out, agg("_value").over(so_far))
        .filter(F.col(ROW) == 1).drop(ROW, "_cut", "_value")
    )


def running_sums(df: DataFrame, keys: Sequence[str], order: Sequence[str], values: dict[str, Column],
                 segment: Column | None = None) -> DataFrame:
    """Running sums of several values in one pass, each under its name; like ``running``."""
    if segment is None:
        so_far = _window(keys, order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
        return df.withColumns({name: F.sum(value).over(so_far) for name, value in values.items()})
    parts = {name: f"_part{i}" for i, name in enumerate(values)}
    rows = df.withColumn("_cut", segment).withColumns({parts[n]: v for n, v in values.items()})
    totals = rows.groupBy(*keys, "_cut").agg(*[F.sum(p).alias(p) for p in parts.values()])
    earlier = _window(keys, ["_cut"]).rowsBetween(Window.unboundedPreceding, -1)
    carry = totals.withColumns({p: F.sum(p).over(earlier) for p in parts.values()}).filter(
        F.coalesce(*parts.values()).isNotNull()).withColumn(ROW, F.lit(0))
    so_far = _window([*keys, "_cut"], [ROW, *order]).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    both = rows.withColumn(ROW, F.lit(1)).unionByName(carry, allowMissingColumns=True)
    return both.withColumns({n: F.sum(p).over(so_far) for n, p in parts.items()}).filter(F.col(ROW) == 1).drop(
        ROW, "_cut", *parts.values())


def previous(df: DataFrame, keys: Sequence[str], order: Sequence[str], field: str, out: str,
             segment: Column | None = None) -> DataFrame:
    """``field`` of the key's previous row, NULL on the first one."""
    if segment is None:
        return df.withColumn(out, F.lag(field).over(_window(keys, order)))
    rows = df.withColumn("_cut", segment)
    last = rows.groupBy(*keys, "_cut").agg(F.max(F.struct(*order, F.col(field).alias("_field"))).alias("_last"))
    carry = (
        last.withColumn("_last", F.lag("_last").over(_window(keys, ["_cut"]))).filter("_last is not null")
        .select(*keys, "_cut", F.lit(0).alias(ROW), F.col("_last._field").alias(field))
    )
    both = rows.withColumn(ROW, F.lit(1)).unionByName(carry, allowMissingColumns=True)
    return both.withColumn(out, F.lag(field).over(_window([*keys, "_cut"], [ROW, *order]))).filter(
        F.col(ROW) == 1).drop(ROW, "_cut")


def first_of_group(df: DataFrame, keys: Sequence[str], order: Sequence[str], out: str = "is_first") -> DataFrame:
    """Marks the first row per key in ``order`` (a total order) and keeps every row. Null keys are a key of their own.

    The firsts are combined on the map side, one row per key and task, and are a table of their own, so the
    adaptive join may split a hot key's rows. ``df`` is read twice; hand in a written table where it is expensive.
    """
    first = written(df.groupBy(*keys).agg(F.min(F.struct(*order)).alias("_first")), "first")
    met = df.join(skew.renamed(first, keys), skew.same(keys), "left")
    return met.withColumn(out, F.struct(*order).eqNullSafe(F.col("_first"))).select(*df.columns, out)


def first_rows(df: DataFrame, keys: Sequence[str], order: Sequence[str], limit: int, rank: str = "rank") -> DataFrame:
    """The first ``limit`` rows per key with their rank.

    Spark keeps at most ``limit`` rows per key and map task before the shuffle, so a hot key
    never travels whole.
    """
    return df.withColumn(rank, F.row_number().over(_window(keys, order))).filter(F.col(rank) <= limit)
