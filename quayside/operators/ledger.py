"""The ledger: which content is enqueued, processed or failed, and for how long that counts.

A log row is ``(hash, state, path, reason, at_us)``. Views over the log are aggregates by hash, so a
hash that fills a third of the log is combined on the map side.
"""

from __future__ import annotations

from typing import Protocol

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quayside.config import LedgerTtl
from quayside.functions import paths
from quayside.operators import ordered, skew
from quayside.session import hadoop_path, written

STATES = ("enqueued", "processed", "failed")


def ttl_of(state: Column, ttl: LedgerTtl) -> Column:
    return (
        F.when(state == "enqueued", F.lit(ttl.enqueued_us))
        .when(state == "processed", F.lit(ttl.processed_us))
        .when(state == "failed", F.lit(ttl.failed_us))
    )


def current(log: DataFrame) -> DataFrame:
    """Last write per (hash, state); a later or equal completion removes the enqueued entry."""
    entry = F.struct("at_us", "path", "reason")
    latest = log.groupBy("hash").agg(
        *[F.max(F.when(F.col("state") == s, entry)).alias(s) for s in STATES])
    completed = F.greatest(F.col("processed.at_us"), F.col("failed.at_us"))
    kept = F.when(completed.isNull() | (completed < F.col("enqueued.at_us")), F.col("enqueued"))
    tagged = F.array(*[
        F.when(value.isNotNull(), F.struct(F.lit(s).alias("state"), value.alias("entry")))
        for s, value in (("enqueued", kept), ("processed", F.col("processed")), ("failed", F.col("failed")))])
    return latest.select("hash", F.explode(F.array_compact(tagged)).alias("row")).select(
        "hash", "row.state", "row.entry.path", "row.entry.reason", "row.entry.at_us")


def live(entries: DataFrame, as_of_us: int | Column, ttl: LedgerTtl | None = LedgerTtl()) -> DataFrame:
    """Entries that still count at ``as_of_us``; with ``ttl=None`` nothing ever expires."""
    if ttl is None:
        return entries
    as_of = F.lit(as_of_us) if isinstance(as_of_us, int) else as_of_us
    expires = F.col("at_us") + ttl_of(F.col("state"), ttl)
    return entries.withColumn("expires_us", expires).filter((F.col("at_us") <= as_of) & (F.col("expires_us") > as_of))


def key_set(entries: DataFrame) -> DataFrame:
    """The distinct hashes as a table below the checkpoint folder.

    As a table of its own it reaches a join through a plain shuffle with one row per hash: a hash with
    many entries is combined before that, and the adaptive skew join may split a hot hash of the other
    side, which it does not do next to an aggregate.
    """
    return written(entries.select("hash").distinct(), "keys")


def new_only(files: DataFrame, processed: DataFrame) -> DataFrame:
    """Files whose hash is not among the processed ones (see ``key_set``)."""
    return files.join(processed.select("hash"), "hash", "left_anti")


def duplicates(files: DataFrame, processed: DataFrame) -> DataFrame:
    return files.join(processed.select("hash"), "hash", "left_semi")


def seen_within_ttl(arrivals: DataFrame, entries: DataFrame, ttl_us: int, tie: str,
                    hot_rows: int = skew.HOT_ROWS) -> DataFrame:
    """Adds ``last_at_us`` and ``is_duplicate``: is the newest entry of the same hash, at or before the
    arrival, younger than ``ttl_us``?

    The newest earlier entry decides, so no arrival is paired with all entries of its hash: entries and
    arrivals run through one ordered pass per hash, a hot hash in segments.
    """
    e = entries.select("hash", F.col("at_us").alias("_us"), F.lit(0).alias("_kind"))
    a = arrivals.withColumn("_us", F.col("arrived_us")).withColumn("_kind", F.lit(1))
    both = a.unionByName(e, allowMissingColumns=True)
    newest = F.when(F.col("_kind") == 0, F.col("_us"))
    order = ["_us", "_kind", tie]
    seen = skew.by_size(
        both, ["hash"], order,
        lambda rows, segment: ordered.running(rows, ["hash"], order, newest, "last_at_us", segment, "max"), hot_rows)
    return seen.filter("_kind = 1").drop("_us", "_kind").withColumn(
        "is_duplicate", F.coalesce(F.col("arrived_us") < F.col("last_at_us") + ttl_us, F.lit(False)))


def orphans(processing: DataFrame, completed: DataFrame | None, first_root: str) -> DataFrame:
    """Files left in the processing lane, with the path they are replayed to.

    With ``completed=None`` every one is replayed (at-least-once); otherwise only unfinished hashes.
    Sub-directories stay where they are.
    """
    rows = processing.filter(~F.col("is_dir"))
    if completed is not None:
        rows = new_only(rows, completed)
    return rows.withColumn("replay_path", paths.under(first_root, paths.basename("path")))


def lifecycle(log: DataFrame, as_of_us: int, ttl: LedgerTtl = LedgerTtl()) -> DataFrame:
    """Per hash: first enqueued, last completion, outcome, latency, and whether it is stuck."""
    at = F.col("at_us")
    done = F.col("state") != "enqueued"
    per_hash = log.groupBy("hash").agg(
        F.min(F.when(~done, at)).alias("enqueued_us"),
        F.max(F.when(done, F.struct(at, "state"))).alias("_done"),
    )
    stuck = F.col("_done").isNull() & (F.lit(as_of_us) - F.col("enqueued_us") > ttl.enqueued_us)
    return per_hash.select(
        "hash", "enqueued_us", F.col("_done.at_us").alias("completed_us"),
        F.when(F.col("_done").isNotNull(), F.col("_done.state")).when(stuck, "stuck")
        .otherwise("enqueued").alias("outcome"),
        (F.col("_done.at_us") - F.col("enqueued_us")).alias("latency_us"),
    )


class Ledger(Protocol):
    def live(self, as_of_us: int) -> DataFrame: ...

    def append(self, rows: DataFrame, batch: str) -> None: ...


class ParquetLedger:
    """Append-only log with one folder per batch, plus compacted snapshots.

    Writing a batch replaces that batch's folder, so replaying it changes nothing. A snapshot names the
    batches it holds in a manifest written before it, and counts once its ``_SUCCESS`` marker is there;
    readers take the newest one and the batches outside it.
    """

    COLUMNS = "hash string, state string, path string, reason string, at_us long"

    def __init__(self, spark: SparkSession, root: str, ttl: LedgerTtl | None = LedgerTtl()) -> None:
        self.spark, self.root, self.ttl = spark, root.rstrip("/"), ttl

    def _committed(self, kind: str) -> list[str]:
        """Names of the committed folders of one kind; no rows."""
        fs, base = hadoop_path(self.spark, f"{self.root}/{kind}")
        if not fs.exists(base):
            return []
        names = [status.getPath().getName() for status in fs.listStatus(base)]
        return sorted(n for n in names if fs.exists(hadoop_path(self.spark, f"{self.root}/{kind}/{n}/_SUCCESS")[1]))

    def append(self, rows: DataFrame, batch: str) -> None:
        cols = [c.split()[0] for c in self.COLUMNS.split(", ")]
        rows.select(*cols).write.mode("overwrite").parquet(f"{self.root}/log/{batch}")

    def _state(self) -> tuple[str | None, list[str]]:
        """(newest snapshot, batches outside it)."""
        snapshots, batches = self._committed("snapshot"), self._committed("log")
        if not snapshots:
            return None, batches
        held = {r[0] for r in self.spark.read.text(f"{self.root}/manifest/{snapshots[-1]}").collect()}
        return snapshots[-1], [b for b in batches if b not in held]

    def log(self) -> DataFrame:
        snapshot, batches = self._state()
        parts = [f"{self.root}/log/{b}" for b in batches]
        if snapshot is not None:
            parts.append(f"{self.root}/snapshot/{snapshot}")
        reader = self.spark.read.schema(self.COLUMNS)
        return reader.parquet(*parts) if parts else self.spark.createDataFrame([], self.COLUMNS)

    def live(self, as_of_us: int) -> DataFrame:
        return live(current(self.log()), as_of_us, self.ttl)

    def compact(self) -> None:
        """Writes the current view of everything logged so far as one snapshot."""
        name = f"{len(self._committed('snapshot')):012d}"
        batches = self._committed("log")
        self.spark.createDataFrame([(b,) for b in batches], "value string").coalesce(1).write.mode(
            "overwrite").text(f"{self.root}/manifest/{name}")
        parts = self.log()
        current(parts).write.mode("overwrite").parquet(f"{self.root}/snapshot/{name}")
