"""Publishing with a commit: a message counts once its task's result is in the batch's commit, and what could not be
published is a dead letter.

``Topic`` is a Python data source. Every task hands its messages to a ``Publisher`` and writes what it took, and what it refused
to the end, to files of its own; their names travel to the driver in commit messages. The commit of a batch is one
file that lists them. Files of a task that ran twice, or of a batch that failed, are in no list, so nobody reads them;
``abort`` removes them. A batch that is published again is answered from its commit.
"""

from __future__ import annotations

import json
import time
import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from typing import NamedTuple, Protocol

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage

from quayside.config import RetryConfig
from quayside.operators import retry
from quayside.session import hadoop_path

SENT = "key string, value string, attempts int"
DEAD = "key string, value string, attempts int, error string"


class Refused(Exception):
    """The message will not be taken, however often it is tried."""


class Publisher(Protocol):
    """What takes messages; one per task. ``send`` raises ``Refused`` for good, anything else to be tried again."""

    def send(self, key: str | None, value: str | None) -> None: ...


class SizeLimit:
    """Takes every message up to a size, as brokers do."""

    def __init__(self, max_bytes: int) -> None:
        self.max_bytes = max_bytes

    def send(self, key: str | None, value: str | None) -> None:
        if value is not None and len(value.encode()) > self.max_bytes:
            raise Refused("message_too_large")


class Published(NamedTuple):
    sent: DataFrame
    dead: DataFrame


@dataclass
class Written(WriterCommitMessage):
    sent: tuple[str, int] | None
    dead: tuple[str, int] | None


def _file_system(uri: str):
    from pyarrow import fs

    if uri.startswith("file:"):
        return fs.LocalFileSystem(), "/" + uri.partition(":")[2].lstrip("/")
    return fs.FileSystem.from_uri(uri)


class _File:
    """A table of one task that is there when it is closed, and only if it has rows."""

    TYPES = {"string": pa.string(), "int": pa.int32()}

    def __init__(self, uri: str, columns: str) -> None:
        fields = [c.split() for c in columns.split(", ")]
        self.uri, self.schema, self.rows, self.writer = uri, pa.schema([(n, self.TYPES[t]) for n, t in fields]), 0, None

    def add(self, rows: list[tuple]) -> None:
        import pyarrow.parquet as pq

        if not rows:
            return
        if self.writer is None:
            fs, place = _file_system(self.uri)
            fs.create_dir(place.rpartition("/")[0], recursive=True)
            self.out = fs.open_output_stream(place)
            self.writer = pq.ParquetWriter(self.out, self.schema)
        columns = [pa.array(c, f.type) for c, f in zip(zip(*rows), self.schema)]
        self.writer.write_batch(pa.RecordBatch.from_arrays(columns, schema=self.schema))
        self.rows += len(rows)

    def close(self) -> tuple[str, int] | None:
        if self.writer is None:
            return None
        self.writer.close()
        self.out.close()
        return self.uri, self.rows


def _attempts(publisher: Publisher, key, value, waits: list[float]) -> tuple[int, str | None]:
    """(tries, the last error or None)."""
    for n, wait in enumerate([*waits, None], start=1):
        try:
            publisher.send(key, value)
            return n, None
        except Refused as e:
            return n, str(e)
        except Exception as e:  # noqa: BLE001  (whatever the client raises is worth another try)
            error = str(e)
        if wait is not None:
            time.sleep(wait)
    return len(waits) + 1, error


def _source(publisher: Publisher, root: str, waits: list[float], name: str) -> type[DataSource]:
    class Writer(DataSourceArrowWriter):
        def __init__(self, batch: str) -> None:
            self.batch = batch

        def write(self, iterator: Iterator[pa.RecordBatch]) -> WriterCommitMessage:
            task = uuid.uuid4().hex
            sent = _File(f"{root}/sent/{self.batch}/{task}.parquet", SENT)
            dead = _File(f"{root}/dead/{self.batch}/{task}.parquet", DEAD)
            for rows in iterator:
                tried = [(k, v, *_attempts(publisher, k, v, waits))
                         for k, v in zip(rows.column("key").to_pylist(), rows.column("value").to_pylist())]
                sent.add([t[:3] for t in tried if t[3] is None])
                dead.add([t for t in tried if t[3] is not None])
            return Written(sent.close(), dead.close())

        def commit(self, messages: list) -> None:
            listed = {kind: [m for m in (getattr(x, kind) for x in messages if x is not None) if m is not None] for kind in ("sent", "dead")}
            fs, place = _file_system(f"{root}/commits/{self.batch}.json")
            fs.create_dir(place.rpartition("/")[0], recursive=True)
            part = f"{place}.{uuid.uuid4().hex}"
            with fs.open_output_stream(part) as out:
                out.write(json.dumps(listed).encode())
            fs.move(part, place)

        def abort(self, messages: list) -> None:
            for file in (f for x in messages if x is not None for f in (x.sent, x.dead) if f is not None):
                fs, place = _file_system(file[0])
                fs.delete_file(place)

    class Source(DataSource):
        @classmethod
        def name(cls) -> str:
            return name

        def writer(self, schema: T.StructType, overwrite: bool) -> DataSourceArrowWriter:
            return Writer(self.options["batch"])

    return Source


class Topic:
    """Messages below ``root``, published batch by batch."""

    def __init__(self, spark: SparkSession, root: str, publisher: Publisher, cfg: RetryConfig = RetryConfig()) -> None:
        self.spark = spark
        fs, place = hadoop_path(spark, root.rstrip("/"))
        self.root = fs.makeQualified(place).toString()
        self.name = f"topic_{uuid.uuid4().hex}"
        # Registered here: the sessions of streams that start later know what this one knows.
        spark.dataSource.register(_source(publisher, self.root, [ms / 1000 for ms in retry.delays_ms(cfg)], self.name))

    def publish(self, messages: DataFrame, batch: str) -> Published:
        """Publishes (key, value) rows once per batch name and returns the batch's sent rows and dead letters."""
        if not self._committed(batch):
            messages.select("key", "value").write.format(self.name).option("batch", batch).mode("append").save()
        return self._read([batch])

    def write(self, messages: DataFrame) -> None:
        """The ``MessageSink`` protocol: a batch of its own."""
        self.publish(messages, uuid.uuid4().hex)

    def _committed(self, batch: str) -> bool:
        fs, place = hadoop_path(self.spark, f"{self.root}/commits/{batch}.json")
        return fs.exists(place)

    def batches(self) -> list[str]:
        fs, place = hadoop_path(self.spark, f"{self.root}/commits")
        names = [s.getPath().getName() for s in fs.listStatus(place)] if fs.exists(place) else []
        return sorted(n.removesuffix(".json") for n in names if n.endswith(".json"))

    def read(self) -> Published:
        """All that has been committed."""
        return self._read(self.batches())

    def _read(self, batches: list[str]) -> Published:
        listed = {"sent": [], "dead": []}
        for batch in batches:
            body = json.loads(self.spark.read.text(f"{self.root}/commits/{batch}.json", wholetext=True).first()[0])
            for kind, files in body.items():
                listed[kind] += [file for file, _ in files]
        made = [self.spark.read.schema(schema).parquet(*listed[kind]) if listed[kind] else self.spark.createDataFrame([], schema)
                for kind, schema in (("sent", SENT), ("dead", DEAD))]
        return Published(*made)
