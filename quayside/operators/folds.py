"""Runs a machine over every key of a table, in order, at any key size.

Ordinary keys: one hash shuffle by key, a sort inside the partition, and a streaming pass that holds
one Arrow batch and one state at a time.

Hot keys (``operators.skew``) are cut into evenly filled segments. Each segment is summarised without
knowing its entry state. Summaries are composed, ``FAN`` at a time, up a tree over the segments; entry states then come
down the tree, so no task ever holds more than ``FAN`` summaries of a key. Each segment is run once more
from its now known entry state. The result is the same, row for row.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quayside.operators import skew
from quayside.operators.skew import HOT_ROWS, SEG
from quayside.session import written

ENTRY, SUMMARY, EXIT, AT, READY = "_entry", "_summary", "_exit", "_at", "_ready"
#: Summaries of one key that meet in one task; a power of two.
FAN = 8


def _runs(batch: pa.RecordBatch | pa.Table, keys: Sequence[str]) -> list[tuple[int, int]]:
    """[start, stop) of each stretch of equal keys."""
    n = batch.num_rows
    change = np.zeros(max(n - 1, 0), dtype=bool)
    for key in keys:
        col = batch.column(key)
        col = col.combine_chunks() if isinstance(col, pa.ChunkedArray) else col
        a, b = col.slice(1), col.slice(0, n - 1)
        differs = pc.fill_null(pc.not_equal(a, b), False).to_numpy(zero_copy_only=False)
        change |= differs | (pc.is_null(a).to_numpy(zero_copy_only=False) != pc.is_null(b).to_numpy(zero_copy_only=False))
    cuts = [0, *(np.flatnonzero(change) + 1).tolist(), n]
    return list(zip(cuts[:-1], cuts[1:]))


def _inputs(batch: pa.RecordBatch | pa.Table, machine, order_us: str) -> tuple[np.ndarray, dict[str, np.ndarray]]:
    us = batch.column(order_us).to_numpy() if isinstance(batch, pa.Table) else \
        batch.column(order_us).to_numpy(zero_copy_only=False)
    cols = {}
    for name in machine.inputs:
        col = pc.fill_null(batch.column(name), False)
        cols[name] = col.to_numpy() if isinstance(batch, pa.Table) else col.to_numpy(zero_copy_only=False)
    return us, cols


def _runner(machine, keys: Sequence[str], order_us: str, out: pa.Schema, names: list[str]) -> Callable:
    added = [f for f in out if f.name not in names]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, state, passed = None, None, 0
        for batch in batches:
            if batch.num_rows == 0:
                continue
            us, cols = _inputs(batch, machine, order_us)
            results: dict[str, list] = {f.name: [] for f in added}
            entries = batch.column(ENTRY) if ENTRY in batch.schema.names else None
            key_at = lambda i: tuple(batch.column(k)[i].as_py() for k in keys)
            carries_on = key_at(0) == current  # the batch before ended inside this key
            for start, stop in _runs(batch, keys):
                if not carries_on:
                    state = entries[start].as_py() if entries is not None else None
                carries_on = False
                got, state = machine.run(state, us[start:stop], {k: v[start:stop] for k, v in cols.items()})
                for name, values in got.items():
                    results[name].extend(values.tolist() if isinstance(values, np.ndarray) else values)
                if EXIT in results:
                    results[EXIT].extend([None] * (stop - start - 1) + [state or []])
            if AT in results:
                results[AT].extend(range(passed, passed + batch.num_rows))
                passed += batch.num_rows
            current = key_at(batch.num_rows - 1)
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(n) for n in names), *(pa.array(results[f.name], f.type) for f in added)], schema=out)

    return run


def _summariser(machine, keys: Sequence[str], order_us: str) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # One range partition of narrow rows; its size is set by the number of partitions.
        held = [b for b in batches if b.num_rows]
        if not held:
            return
        table = pa.Table.from_batches(held)
        us, cols = _inputs(table, machine, order_us)
        rows = []
        for start, stop in _runs(table, [*keys, SEG]):
            known = [table.column(READY)[start].as_py()] if READY in table.schema.names else []
            summary = machine.summarise(us[start:stop], {k: v[start:stop] for k, v in cols.items()}, *known)
            rows.append((start, summary))
        starts = pa.array([r[0] for r in rows])
        head = table.select([*keys, SEG]).take(starts).combine_chunks().to_batches()[0]
        yield pa.RecordBatch.from_arrays(
            [*head.columns, pa.array([r[1] for r in rows], pa.list_(pa.list_(pa.int64())))],
            names=[*head.schema.names, SUMMARY])

    return run


def _whole(value) -> list[list[int]]:
    return [[int(v) for v in row] for row in value]


def _chainer(machine, keys: Sequence[str]) -> Callable:
    """Entry states of some neighbouring nodes, from the one of the first (``ENTRY`` where it is known)."""
    def chain(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(SEG)
        state = None
        if ENTRY in pdf and pdf[ENTRY].iloc[0] is not None:
            state = [int(v) for v in pdf[ENTRY].iloc[0]]
        entries = []
        for summary in pdf[SUMMARY]:
            entries.append(state)
            state = machine.advance(_whole(summary), state)
        return pdf[[*keys, SEG]].assign(**{ENTRY: entries})

    return chain


def _composer(machine, keys: Sequence[str]) -> Callable:
    """One summary for some neighbouring nodes."""
    def compose(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(SEG)
        whole = None
        for summary in pdf[SUMMARY]:
            whole = _whole(summary) if whole is None else machine.compose(whole, _whole(summary))
        return pdf[[*keys, SEG]].head(1).assign(**{SEG: pdf[SEG].iloc[0] // FAN, SUMMARY: [whole]})

    return compose


def _entries(summaries: DataFrame, keys: list[str], machine, segments: int, entry: T.StructType) -> DataFrame:
    """The entry state of every (keys, segment)."""
    parent = F.shiftright(SEG, FAN.bit_length() - 1).alias("_parent")
    levels = [written(summaries, "summaries")]
    while segments > FAN and hasattr(machine, "compose"):
        up = levels[-1].groupBy(*keys, parent).applyInPandas(_composer(machine, keys), levels[0].schema)
        levels.append(written(up, "summaries"))
        segments = segments // FAN + 1
    known = levels.pop().groupBy(*keys).applyInPandas(_chainer(machine, keys), entry)
    for level in reversed(levels):
        above = skew.renamed(known.withColumnRenamed(SEG, "_parent_seg"), keys)
        nodes = level.withColumn("_parent", parent).join(
            above, [*skew.same(keys), F.col("_parent") == F.col("_parent_seg")], "left").select(*level.columns, "_parent", ENTRY)
        known = nodes.groupBy(*keys, "_parent").applyInPandas(_chainer(machine, keys), entry)
    return known


def fold(df: DataFrame, keys: Sequence[str], order_us: str, ties: Sequence[str], machine,
         hot_rows: int = HOT_ROWS) -> DataFrame:
    """Adds the machine's output columns to every row of ``df``.

    ``order_us`` is the column of epoch microseconds a key's rows are ordered by; ``ties`` make the
    order total. Without keys the whole table is one history, which is cut like a hot key's. Keep ``df``
    narrow: all its columns pass through Python.
    """
    keys, order = list(keys), [order_us, *ties]
    hot = skew.measure(df, keys, hot_rows)
    ordinary, large = skew.divide(df, keys, hot)
    if hot is None:
        return _fold_ordinary(ordinary, keys, order, machine)
    pinned = skew.pin(large, keys, order, hot.segments())
    split = _fold_pinned(pinned, keys, order, machine, hot.segments() + hot.count)
    return split if ordinary is None else _fold_ordinary(ordinary, keys, order, machine).unionByName(split)


def _out_schema(df: DataFrame, machine) -> tuple[T.StructType, pa.Schema]:
    from pyspark.sql.pandas.types import to_arrow_schema

    out = T.StructType(df.schema.fields + T.StructType.fromDDL(machine.outputs).fields)
    return out, to_arrow_schema(out)


def _fold_ordinary(df: DataFrame, keys: list[str], order: list[str], machine) -> DataFrame:
    out, arrow = _out_schema(df, machine)
    # A table without keys gets here when it is small enough for one task.
    ready = (df.repartition(*keys) if keys else df.repartition(1)).sortWithinPartitions(*keys, *order)
    return ready.mapInArrow(_runner(machine, keys, order[0], arrow, df.columns), out)


def fold_from(df: DataFrame, states: DataFrame, keys: Sequence[str], order_us: str, ties: Sequence[str], machine) -> DataFrame:
    """``fold`` of rows that follow others: each key starts from its state in ``states`` (the keys and ``EXIT``).

    Besides the machine's columns, ``EXIT`` has the key's state after the row where a stretch of its rows ends, and
    ``AT`` grows along a key's rows.
    """
    keys = list(keys)
    entry = states.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], F.col(EXIT).alias(ENTRY))
    same = [F.col(k).eqNullSafe(F.col(f"_k{i}")) for i, k in enumerate(keys)]
    placed = df.join(entry, same, "left").select(*df.columns, ENTRY)
    out = T.StructType(df.schema.fields + T.StructType.fromDDL(machine.outputs).fields + [
        T.StructField(EXIT, T.ArrayType(T.LongType())), T.StructField(AT, T.LongType())])
    ready = placed.repartition(*keys).sortWithinPartitions(*keys, order_us, *ties)
    from pyspark.sql.pandas.types import to_arrow_schema

    return ready.mapInArrow(_runner(machine, keys, order_us, to_arrow_schema(out), df.columns), out)


def _fold_pinned(pinned: DataFrame, keys: list[str], order: list[str], machine, entry_rows: int) -> DataFrame:
    rows = pinned.drop(SEG)
    out, arrow = _out_schema(rows, machine)
    place = T.StructType([pinned.schema[k] for k in keys] + [T.StructField(SEG, T.IntegerType())])
    narrow = pinned.select(*keys, SEG, order[0], *machine.inputs)
    if getattr(machine, "reach_us", None) is not None:
        narrow = _placed(narrow, _readiness(narrow, keys, order[0], machine.reach_us), keys, [order[0]], entry_rows)
    summaries = narrow.mapInArrow(
        _summariser(machine, keys, order[0]),
        T.StructType(place.fields + [T.StructField(SUMMARY, T.ArrayType(T.ArrayType(T.LongType())))]))
    entries = _entries(summaries, keys, machine, entry_rows, T.StructType(place.fields + [T.StructField(ENTRY, T.ArrayType(T.LongType()))]))
    placed = _placed(pinned, entries, keys, order, entry_rows)
    return placed.select(*rows.columns, SEG, ENTRY).mapInArrow(
        _runner(machine, [*keys, SEG], order[0], arrow, rows.columns), out)


def _placed(pinned: DataFrame, facts: DataFrame, keys: list[str], order: list[str], entry_rows: int) -> DataFrame:
    """Pinned rows with the one column that ``facts`` has for their (keys, segment), in their pinned order."""
    value = facts.columns[-1]
    facts = skew.renamed(facts, keys).withColumnRenamed(SEG, "_seg")
    on = [*skew.same(keys), F.col(SEG) == F.col("_seg")]
    # One short row per (segment, key): at most ``entry_rows``. A broadcast keeps the pinned order; beyond
    # the limit the rows meet their entry in a shuffle by (key, segment) and are sorted again.
    if entry_rows <= skew.BROADCAST_KEYS:
        return pinned.join(F.broadcast(facts), on, "left").select(*pinned.columns, value)
    return pinned.join(facts.hint("merge"), on, "left").select(*pinned.columns, value).sortWithinPartitions(*keys, SEG, *order)


def _readiness(narrow: DataFrame, keys: list[str], us: str, reach_us: int) -> DataFrame:
    """(keys, segment, the earliest time from which a past can let rows through).

    A row that far behind the last accepted one would have been accepted itself, so the past is younger than that at the
    last row before the segment. A key's first segment has no past: the end of time.
    """
    spans = narrow.groupBy(*keys, SEG).agg(F.min(us).alias("_from"), F.max(us).alias("_to"))
    by_key = Window.partitionBy(*(keys or [F.lit(0)])).orderBy(SEG)
    before = spans.select(*keys, SEG, F.first("_from").over(by_key).alias("_first"), F.lag("_to").over(by_key).alias("_before"))
    ready = F.greatest(F.col("_first"), F.col("_before") - reach_us + 1) + reach_us
    return before.select(*keys, SEG, F.when(F.col("_before").isNull(), F.lit(1 << 62)).otherwise(ready).alias(READY))
