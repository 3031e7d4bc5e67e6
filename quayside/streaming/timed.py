"""Keyed state with event-time timers: rows are held until the watermark has passed them and folded in event order.

Spark drops what comes at or before the watermark. What is held is therefore complete up to the watermark, and a
timer per key wakes it as soon as there is something to fold. State that no longer matters is dropped by a timer
too, so it stays level however long a stream runs. All times are epoch microseconds; a watermark is in milliseconds.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator, Sequence
from datetime import datetime, timedelta, timezone
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor

from quayside.functions import scalars
from quayside.operators import folds, ordered, skew, stability
from quayside.operators.folds import EXIT
from quayside.session import written
from quayside.streaming import live

ORIGIN = datetime(1970, 1, 1, tzinfo=timezone.utc)
AT = "at"


def instant(us: int) -> datetime:
    return ORIGIN + timedelta(microseconds=us)


def due(us: int) -> int:
    """The timer that fires with the first watermark that has passed ``us``."""
    return -(-us // 1000) - 1


class Held:
    """Rows of one key that the watermark has not passed, as one chunk per micro-batch that brought some."""

    def __init__(self, handle, name: str) -> None:
        self.state = handle.getListState(name, "chunk binary")

    def add(self, rows: list[tuple]) -> None:
        self.state.appendValue((pickle.dumps(rows),))

    def take(self, passed_us: int, us: int) -> tuple[list[tuple], int | None]:
        """(the rows up to ``passed_us``, the earliest time among those that stay); ``us`` is the place of the time."""
        ready, rest = [], []
        for (chunk,) in self.state.get():
            for row in pickle.loads(chunk):
                (ready if row[us] <= passed_us else rest).append(row)
        if ready:
            if rest:
                self.state.put([(pickle.dumps(rest),)])
            else:
                self.state.clear()
        return ready, min((r[us] for r in rest), default=None)


class MachineFold(StatefulProcessor):
    """Runs one of ``operators.machines`` over every key's rows in event order.

    Output: all columns, ``at`` (the event time for the next stage) and the machine's columns. Rows for which column
    ``skip`` is true go through at once, with nulls from the machine.
    """

    def __init__(self, schema: T.StructType, us: str, ties: Sequence[str], machine, skip: str | None = None) -> None:
        self.names = schema.names
        self.us, self.order = schema.names.index(us), [schema.names.index(c) for c in (us, *ties)]
        self.machine = machine
        self.skip = None if skip is None else schema.names.index(skip)
        self.added = T.StructType.fromDDL(machine.outputs).names
        self.out = Row(*self.names, AT, *self.added)

    def init(self, handle) -> None:
        self.handle = handle
        self.held = Held(handle, "held")
        self.state = handle.getValueState("machine", "state array<long>")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        waiting = []
        for got in rows:
            row = tuple(got[c] for c in self.names)
            if self.skip is not None and row[self.skip]:
                yield self.out(*row, got[AT], *[None] * len(self.added))
            else:
                waiting.append(row)
        if waiting:
            self.held.add(waiting)
            self.handle.registerTimer(due(min(r[self.us] for r in waiting)))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        passed = timerValues.getCurrentWatermarkInMs() * 1000
        ready, following = self.held.take(passed, self.us)
        before = self.state.get()
        state = list(before[0]) if before else None
        if ready:
            ready.sort(key=lambda r: tuple((r[i] is None, r[i]) for i in self.order))
            us = np.array([r[self.us] for r in ready], np.int64)
            inputs = {c: np.array([bool(r[self.names.index(c)]) for r in ready]) for c in self.machine.inputs}
            got, state = self.machine.run(state, us, inputs)
            values = [v.tolist() if isinstance(v, np.ndarray) else v for v in (got[c] for c in self.added)]
            for row, *more in zip(ready, *values):
                yield self.out(*row, instant(row[self.us]), *more)
        if following is not None:
            self.handle.registerTimer(due(following))
        spent = None if state is None else self.machine.spent_us(state)
        if state is None or (spent is not None and spent <= passed):
            if before:
                self.state.clear()
        else:
            if ready:
                self.state.update((state,))
            if spent is not None:
                self.handle.registerTimer(due(spent))

    def close(self) -> None:
        pass


def _typed(schema: T.StructType, more: str) -> T.StructType:
    return T.StructType([*schema.fields, T.StructField(AT, T.TimestampType()), *T.StructType.fromDDL(more).fields])


def fold(rows: DataFrame, keys: Sequence[str], us: str, ties: Sequence[str], machine, skip: str | None = None) -> DataFrame:
    """``rows``, a stream with a watermark on ``at``, with the machine's columns, in event order per key.

    Rows without a time are never passed by a watermark; leave them out. Null keys are a key of their own.
    """
    live.use_disk_state(rows.sparkSession)
    kept = T.StructType([f for f in rows.schema.fields if f.name != AT])
    done = rows.groupBy(*keys).transformWithState(
        MachineFold(kept, us, ties, machine, skip), _typed(kept, machine.outputs), "append", "eventTime", eventTimeColumnName=AT)
    return done


def watermarked(rows: DataFrame, us: str, delay_us: int) -> DataFrame:
    """The rows that have a time, with column ``at`` and a watermark that trails it."""
    timely = rows.filter(F.col(us).isNotNull()).withColumn(AT, scalars.from_micros(us))
    return timely.withWatermark(AT, f"{delay_us} microseconds")


class Marks:
    """Takes the rows of a stream in and tells which times have passed.

    The mark is the newest time so far less ``delay_us``, in whole milliseconds like a watermark. Rows at or before the
    mark of the earlier micro-batches, and those without a time, are late: they are kept in a side table and go no further.
    """

    MARK = T.StructType([T.StructField("mark", T.LongType())])

    def __init__(self, spark: SparkSession, base: str, us: str, delay_us: int) -> None:
        self.kept = live.Kept(spark, f"{base}/came")
        self.us, self.delay = us, delay_us

    def take(self, rows: DataFrame, batch: int) -> tuple[DataFrame, int | None]:
        """(the rows that are in time, the mark that has passed now)."""
        us = F.col(self.us)
        first = self.kept.at("mark", batch - 1, self.MARK).first()
        mark = None if first is None else first["mark"]
        late = us.isNull() if mark is None else us.isNull() | (us <= mark)
        came = self.kept.put(rows.withColumn("_late", late), "rows", batch)
        self.kept.put(came.filter("_late").drop("_late"), "late", batch)
        newest = came.agg(F.max(us)).first()[0]
        if newest is not None:
            now = (newest - self.delay) // 1000 * 1000
            mark = now if mark is None else max(mark, now)
        self.kept.put(self.kept.spark.createDataFrame([(mark,)], self.MARK).coalesce(1), "mark", batch)
        self.kept.drop("rows", batch - 1)
        self.kept.drop("mark", batch - 2)
        return came.filter("NOT _late").drop("_late"), mark

    def late(self, schema: T.StructType) -> DataFrame:
        return self.kept.every("late", schema)


class Stage:
    """One of ``operators.machines`` over every key's rows in event order, a micro-batch at a time.

    Rows that the mark has not passed stay in a table. What it has passed is sorted and streamed through the machine from
    the state of its key (``folds.fold_from``); states that have not run out are the other table. Each micro-batch reads
    those of the one before and writes folders of its own. Rows for which column ``skip`` is true get nulls from the machine.
    """

    def __init__(self, spark: SparkSession, base: str, schema: T.StructType, keys: Sequence[str], us: str, ties: Sequence[str],
                 machine, skip: str | None = None) -> None:
        self.kept = live.Kept(spark, base)
        self.schema, self.keys, self.us, self.ties, self.machine, self.skip = schema, list(keys), us, list(ties), machine, skip
        self.out = T.StructType([*schema.fields, *T.StructType.fromDDL(machine.outputs).fields])
        self.states = T.StructType([*[schema[k] for k in keys], T.StructField(EXIT, T.ArrayType(T.LongType()))])

    def step(self, rows: DataFrame, mark: int | None, batch: int) -> DataFrame:
        """``rows``, a table, join those that wait; returns what the mark has passed, with the machine's columns."""
        waiting = rows.select(*self.schema.names).unionByName(self.kept.at("held", batch - 1, self.schema))
        over = F.lit(False) if mark is None else F.col(self.us) <= mark
        self.kept.put(waiting.filter(~over), "held", batch)
        passed = waiting.filter(over)
        states = self.kept.at("state", batch - 1, self.states)
        mine = passed if self.skip is None else passed.filter(~F.col(self.skip))
        done = folds.fold_from(mine, states, self.keys, self.us, self.ties, self.machine)
        if self.skip is not None:
            done = done.unionByName(passed.filter(self.skip), allowMissingColumns=True)
        done = self.kept.put(done, "out", batch)
        self.kept.put(self._states(states, done, mark), "state", batch)
        for kind in ("held", "state"):
            self.kept.drop(kind, batch - 2)
        return done.select(*self.out.names)

    def _states(self, states: DataFrame, done: DataFrame, mark: int | None) -> DataFrame:
        """The state that each key is left with, unless it is as good as none."""
        machine = self.machine
        ended = done.filter(F.col(EXIT).isNotNull()).groupBy(*self.keys).agg(F.max_by(EXIT, folds.AT).alias(EXIT))
        met = skew.renamed(ended.select(*self.keys), self.keys)
        now = states.join(met, skew.same(self.keys), "left_anti").unionByName(ended)

        def lasting(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                spent = [machine.spent_us(s) if s else 0 for s in batch.column(EXIT).to_pylist()]
                yield batch.filter(pa.array([us is None or us > mark for us in spent], pa.bool_()))

        return now if mark is None else now.mapInArrow(lasting, self.states)

    def size(self, batch: int) -> int:
        """Rows held and states kept after a micro-batch."""
        return self.kept.at("held", batch, self.schema).count() + self.kept.at("state", batch, self.states).count()

    def rows(self) -> DataFrame:
        """What has passed so far."""
        return self.kept.every("out", self.out)


class Gate:
    """Holds the files noticed on a watched path until its samples tell whether it is stable, a micro-batch at a time.

    Every row is a sample (``size`` and ``mtime``; a null size means the file was gone); those with ``noticed`` are also files
    that wait for the verdict of ``operators.stability``. They leave as soon as it is known, at the latest when the deadline
    has passed, with ``stable`` and ``ready_us``, the time plus what the path took to settle. A verdict stays until its
    path has been quiet for ``forget_us``; None keeps it. Tables: the first samples of paths without a verdict, the
    files that wait, and the verdicts.
    """

    def __init__(self, spark: SparkSession, base: str, schema: T.StructType, watched: str, us: str, tie: str, noticed: str,
                 size: str, mtime: str, attempts: int, deadline_us: int, forget_us: int | None = None) -> None:
        self.kept = live.Kept(spark, base)
        self.schema, self.watched, self.us, self.noticed = schema, watched, us, noticed
        self.attempts, self.deadline, self.forget = max(attempts, 1), deadline_us, forget_us
        self.sample = {"path": watched, "sample_us": us, "sample_id": tie, "size": size, "mtime": mtime}
        self.samples = T.StructType([T.StructField(n, schema[c].dataType) for n, c in self.sample.items()])
        # took_us is -1 when the path never settled.
        self.verdicts = T.StructType([self.samples["path"], T.StructField("took_us", T.LongType()), T.StructField("last_us", T.LongType())])

    def step(self, rows: DataFrame, mark: int | None, batch: int) -> DataFrame:
        """``rows``, a table, are all that the mark has passed since the last micro-batch; returns the files that have an answer."""
        known = self.kept.at("verdict", batch - 1, self.verdicts)
        fresh = rows.join(skew.renamed(known.select("path"), ["path"]), skew.same([self.watched]), "left_anti").select(
            *[F.col(c).alias(n) for n, c in self.sample.items()])
        samples = fresh.unionByName(self.kept.at("head", batch - 1, self.samples))
        first = self.kept.put(ordered.first_rows(
            samples, ["path"], ["sample_us", "sample_id"], self.attempts).drop("rank"), "first", batch)
        decided = self.kept.put(self._decided(first, mark), "decided", batch)
        self.kept.put(first.join(skew.renamed(decided.select("path"), ["path"]), skew.same(["path"]), "left_anti"), "head", batch)
        now = known.unionByName(decided)
        asking = rows.filter(self.noticed).unionByName(self.kept.at("waiting", batch - 1, self.schema))
        took = skew.renamed(now.select("path", F.col("took_us").alias("_took")), ["path"])
        met = asking.join(took, skew.same([self.watched]), "left").select(*self.schema.names, "_took")
        answered = met.filter("_took IS NOT NULL").withColumn("stable", F.col("_took") >= 0).withColumn(
            "ready_us", F.col(self.us) + F.greatest("_took", F.lit(0))).drop("_took")
        out = self.kept.put(answered, "out", batch)
        self.kept.put(met.filter("_took IS NULL").drop("_took"), "waiting", batch)
        self.kept.put(now if self.forget is None or mark is None else self._lasting(now, rows, mark), "verdict", batch)
        self.kept.drop("first", batch)
        self.kept.drop("decided", batch)
        self.kept.drop("out", batch - 1)
        for kind in ("head", "waiting", "verdict"):
            self.kept.drop(kind, batch - 2)
        return out

    def _decided(self, first: DataFrame, mark: int | None) -> DataFrame:
        """Paths whose first samples, or whose deadline, leave nothing open."""
        facts = skew.renamed(first.groupBy("path").agg(
            F.min("sample_us").alias("_from"), F.max("sample_us").alias("last_us"), F.bool_or(F.col("size").isNull()).alias("_gone")), ["path"])
        said = stability.verdict(first, self.attempts, self.deadline, "sample_id").join(facts, skew.same(["path"]))
        over = F.lit(False) if mark is None else F.col("_from") + self.deadline <= mark
        final = said.filter(F.col("stable") | F.col("_gone") | (F.col("samples") >= self.attempts) | over)
        return final.select("path", F.when(F.col("stable"), F.col("duration_us")).otherwise(-1).cast("long").alias("took_us"), "last_us")

    def _lasting(self, verdicts: DataFrame, rows: DataFrame, mark: int) -> DataFrame:
        newest = skew.renamed(rows.groupBy(F.col(self.watched).alias("path")).agg(F.max(self.us).alias("_newest")), ["path"])
        seen = verdicts.join(newest, skew.same(["path"]), "left").select(
            "path", "took_us", F.greatest("last_us", "_newest").alias("last_us"))
        return seen.filter(F.col("last_us") + self.forget > mark)

    def size(self, batch: int) -> int:
        """Samples, files and verdicts kept after a micro-batch."""
        kinds = (("head", self.samples), ("waiting", self.schema), ("verdict", self.verdicts))
        return sum(self.kept.at(kind, batch, schema).count() for kind, schema in kinds)


class Settled(NamedTuple):
    """All rows with the machine's outputs, and those that came too late or have no time."""

    rows: DataFrame
    late: DataFrame
    progress: list


def settled(stream: DataFrame, table: DataFrame, keys: Sequence[str], us: str, ties: Sequence[str], machine, delay_us: int,
            base: str) -> Settled:
    """Folds a stream to its end. ``table`` has the rows that the stream brings; those without a time are taken from there.

    What the mark had passed is missing from the stream's output. Only if there is something are the keys of
    those rows folded once more from their whole history, so the rows equal the batch fold whatever order
    files come in. A row without a time is among the late ones only.
    """
    spark = stream.sparkSession
    marks = Marks(spark, base, us, delay_us)
    stage = Stage(spark, f"{base}/fold", T.StructType([T.StructField(f.name, f.dataType) for f in stream.schema.fields]), keys, us, ties, machine)

    def put(rows: DataFrame, batch: int) -> None:
        came, mark = marks.take(rows, batch)
        stage.step(came, mark, batch)

    progress = live.to_the_end(stream, us, lambda rows: rows, put, base)
    rows = stage.rows()
    late = table.filter(F.col(us).isNull())
    missed = marks.late(stage.schema).filter(F.col(us).isNotNull())
    if missed.isEmpty():
        return Settled(rows, late, progress)
    touched = written(missed.select(*[F.col(k).alias(f"_n{i}") for i, k in enumerate(keys)]).distinct(), "touched")
    of_key = [F.col(k).eqNullSafe(F.col(f"_n{i}")) for i, k in enumerate(keys)]
    history = written(rows.join(touched, of_key, "left_semi").select(*stream.columns).unionByName(missed), "history")
    anew = folds.fold(history, keys, us, ties, machine).select(*stage.out.names)
    return Settled(rows.join(touched, of_key, "left_anti").unionByName(anew), late.unionByName(missed), progress)
