"""Built-in stateful operators, live counters, and running a stream over what is there."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery, StreamingQueryListener
from pyspark.sql.types import BooleanType, LongType, StructField, StructType

from quayside.session import hadoop_path, scratch

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def use_disk_state(spark: SparkSession) -> None:
    """Keep keyed state off the heap, with changelogs in the checkpoint."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
    spark.conf.set("spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled", "true")


class Kept:
    """Tables of a stream below ``base``, a folder per micro-batch, so one that runs again replaces what it wrote.

    They are read in the session of the caller: the one a micro-batch runs in plans without the adaptive settings.
    """

    def __init__(self, spark: SparkSession, base: str) -> None:
        self.spark, self.base = spark, base

    def put(self, df: DataFrame, kind: str, batch: int) -> DataFrame:
        df.write.mode("overwrite").parquet(f"{self.base}/{kind}/batch={batch}")
        return self.at(kind, batch, df.schema)

    def at(self, kind: str, batch: int, schema: StructType) -> DataFrame:
        if batch < 0:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(f"{self.base}/{kind}/batch={batch}")

    def drop(self, kind: str, batch: int) -> None:
        fs, old = hadoop_path(self.spark, f"{self.base}/{kind}/batch={batch}")
        fs.delete(old, True)

    def every(self, kind: str, schema: StructType) -> DataFrame:
        """What all micro-batches wrote."""
        fs, place = hadoop_path(self.spark, f"{self.base}/{kind}")
        if not fs.exists(place):
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(f"{self.base}/{kind}").select(*schema.names)


class Windows:
    """Counts per tumbling window of a stream, with a bound on what stays open.

    The mark is the newest time of earlier micro-batches less ``delay_us``. A window closes when the mark reaches its end:
    its counts go to a table of closed windows and leave the open ones, which are all the state there is. A row of a
    closed window is late; it is kept in a side table, and its window's counts are corrected when they are read.
    Each micro-batch writes folders of its own, so one that runs again replaces them.
    """

    def __init__(self, stream: DataFrame, us: str, width_us: int, classes: dict[str, Column], delay_us: int, base: str) -> None:
        self.stream, self.us, self.width, self.classes, self.delay, self.base = stream, us, width_us, classes, delay_us, base
        counts = [StructField(c, LongType()) for c in classes]
        self.counts = StructType([StructField("window_us", LongType()), *counts])
        self.parts = StructType([*self.counts.fields, StructField("late", BooleanType()), StructField("newest", LongType())])
        self.marks = StructType([StructField("mark", LongType())])

    def _table(self, spark: SparkSession, kind: str, batch: int, schema: StructType) -> DataFrame:
        if batch < 0:
            return spark.createDataFrame([], schema)
        return spark.read.schema(schema).parquet(f"{self.base}/{kind}/batch={batch}")

    def _put(self, df: DataFrame, kind: str, batch: int) -> None:
        df.write.mode("overwrite").parquet(f"{self.base}/{kind}/batch={batch}")

    def _sums(self, parts: DataFrame) -> DataFrame:
        return parts.groupBy("window_us").agg(*[F.sum(c).alias(c) for c in self.classes])

    def step(self, rows: DataFrame, batch: int) -> None:
        spark, us = rows.sparkSession, F.col(self.us)
        first = self._table(spark, "mark", batch - 1, self.marks).first()
        mark = None if first is None else first["mark"]
        window = us - F.pmod(us, F.lit(self.width))
        late = F.lit(False) if mark is None else window + self.width <= mark
        counts = rows.filter(us.isNotNull()).groupBy(window.alias("window_us"), late.alias("late")).agg(
            *[F.count_if(c).alias(n) for n, c in self.classes.items()], F.max(us).alias("newest"))
        self._put(counts, "part", batch)
        self._put(rows.filter(us.isNull() | late), "late", batch)
        part = self._table(spark, "part", batch, self.parts)
        newest = part.agg(F.max("newest")).first()[0]
        if newest is not None:
            mark = max(newest - self.delay, newest - self.delay if mark is None else mark)
        self._put(spark.createDataFrame([(mark,)], self.marks).coalesce(1), "mark", batch)
        now = self._sums(self._table(spark, "open", batch - 1, self.counts).unionByName(part.filter("NOT late").select(*self.counts.names)))
        over = F.lit(False) if mark is None else F.col("window_us") + self.width <= mark
        self._put(now.filter(~over), "open", batch)
        self._put(now.filter(over), "closed", batch)
        for kind in ("open", "mark"):
            fs, old = hadoop_path(spark, f"{self.base}/{kind}/batch={batch - 2}")
            fs.delete(old, True)

    def run(self) -> StreamingQuery:
        """Everything that is there now, in as many micro-batches as the source's caps ask for."""
        running = (
            self.stream.writeStream.foreachBatch(self.step).option("checkpointLocation", f"{self.base}/checkpoint")
            .trigger(availableNow=True).start()
        )
        running.awaitTermination()
        if running.exception() is not None:
            raise running.exception()
        return running

    def _newest(self, spark: SparkSession, kind: str) -> int:
        fs, place = hadoop_path(spark, f"{self.base}/{kind}")
        if not fs.exists(place):
            return -1
        return max(int(f.getPath().getName().partition("=")[2]) for f in fs.listStatus(place))

    def rows(self, spark: SparkSession) -> DataFrame:
        """window_us and counts of every window as it stands: closed, open, and what came too late for it."""
        last = self._newest(spark, "open")
        if last < 0:
            return spark.createDataFrame([], self.counts)
        closed = spark.read.schema(self.counts).parquet(f"{self.base}/closed").select(*self.counts.names)
        late = spark.read.schema(self.parts).parquet(f"{self.base}/part").filter("late").select(*self.counts.names)
        return self._sums(closed.unionByName(self._table(spark, "open", last, self.counts)).unionByName(late))

    def late(self, spark: SparkSession) -> DataFrame:
        """Rows that came after their window had closed, or without a time, and the micro-batch that brought them."""
        if self._newest(spark, "late") < 0:
            return spark.createDataFrame([], StructType([*self.stream.schema.fields, StructField("batch", LongType())]))
        return spark.read.schema(StructType([*self.stream.schema.fields, StructField("batch", LongType())])).parquet(f"{self.base}/late")


def observed(df: DataFrame, name: str, counters: dict[str, Column]) -> DataFrame:
    """Counts taken while the rows pass; see ``CounterLog``."""
    aggs = [F.count_if(cond).alias(c) for c, cond in counters.items()]
    return df.observe(name, *aggs)


class CounterLog(StreamingQueryListener):
    """Adds up the observed counters of every finished micro-batch."""

    def __init__(self, name: str) -> None:
        self.name = name
        self.totals: dict[str, int] = {}
        self.batches = 0

    def onQueryStarted(self, event) -> None:
        pass

    def onQueryProgress(self, event) -> None:
        row = event.progress.observedMetrics.get(self.name)
        if row is not None:
            self.batches += 1
            for counter, value in row.asDict().items():
                self.totals[counter] = self.totals.get(counter, 0) + value

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        pass


def run_available(stream: DataFrame, out: str, checkpoint: str, mode: str = "append") -> StreamingQuery:
    """Process everything that is there now, in as many micro-batches as the source's caps ask for."""
    use_disk_state(stream.sparkSession)
    running = (
        stream.writeStream.format("parquet").outputMode(mode).option("checkpointLocation", checkpoint)
        .trigger(availableNow=True).start(out)
    )
    running.awaitTermination()
    if running.exception() is not None:
        raise running.exception()
    return running


#: Event time of the row that ends a stream, in epoch microseconds: 2200-01-01. Watermarks can not pass beyond it.
END_US = 7_258_118_400_000_000


def to_the_end(rows: DataFrame, us: str, plan: Callable[[DataFrame], DataFrame], put: Callable[[DataFrame, int], None],
               base: str) -> list[dict]:
    """Runs ``plan`` over the stream ``rows`` as if the input ended where it ends now.

    A second, empty source is part of the plan. When all rows are in, it gets one row that has nothing but a time far
    ahead, and the stream goes on from its checkpoint: the watermark passes everything that was held. Each
    micro-batch is handed to ``put``. Returns the progress of all micro-batches.
    """
    spark = rows.sparkSession
    use_disk_state(spark)
    last = StructType([StructField(f.name, f.dataType) for f in rows.schema.fields])
    end = spark.createDataFrame([tuple(END_US if f.name == us else None for f in last.fields)], last)
    end.limit(0).write.parquet(f"{base}/end")
    both = rows.unionByName(spark.readStream.schema(last).parquet(f"{base}/end"))
    progress = []
    for ended in (False, True):
        if ended:
            end.coalesce(1).write.mode("append").parquet(f"{base}/end")
        running = (
            plan(both).writeStream.foreachBatch(put).outputMode("append").option("checkpointLocation", f"{base}/checkpoint")
            .trigger(availableNow=True).start()
        )
        running.awaitTermination()
        if running.exception() is not None:
            raise running.exception()
        progress += [dict(p) if isinstance(p, dict) else p for p in running.recentProgress]
    return progress


def by_batch(base: str) -> Callable[[DataFrame, int], None]:
    """Writes every micro-batch into a folder of its own, so one that runs again replaces it."""
    def put(rows: DataFrame, batch: int) -> None:
        rows.write.mode("overwrite").parquet(f"{base}/out/batch={batch}")

    return put


def batches(spark: SparkSession, schema: StructType, base: str) -> DataFrame:
    """What ``by_batch`` wrote, with the number of the micro-batch."""
    return spark.read.schema(StructType([*schema.fields, StructField("batch", LongType())])).parquet(f"{base}/out")


def materialise(spark: SparkSession, stream: DataFrame, name: str) -> DataFrame:
    """Run a stream to its end into a table below the shared scratch folder and read that."""
    base = scratch(spark, name)
    run_available(stream, f"{base}/out", f"{base}/checkpoint")
    return spark.read.schema(stream.schema).parquet(f"{base}/out")
