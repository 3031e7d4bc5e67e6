"""A log of messages with offsets of its own, read as a stream.

The log is a folder of numbered files of (key, value) rows; an offset is a number of files. Appending writes one numbered
folder, so a batch that is appended again replaces itself. The reader is a Python data source: Spark keeps its offsets in
the checkpoint and asks for a range of files again after a restart, so every message comes once whatever a run got to.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

from quayside.session import hadoop_path

MESSAGE = "key string, value string"


class _Files(InputPartition):
    def __init__(self, uri: str) -> None:
        self.uri = uri


def _file_system(uri: str):
    from pyarrow import fs

    if uri.startswith("file:"):
        return fs.LocalFileSystem(), "/" + uri.partition(":")[2].lstrip("/")
    return fs.FileSystem.from_uri(uri)


def _source(root: str, name: str) -> type[DataSource]:
    def listed(number: int) -> list[str]:
        """The files of one committed append."""
        fs, place = _file_system(f"{root}/commits/{number:012d}.json")
        with fs.open_input_stream(place) as f:
            return json.loads(f.read())

    class Reader(DataSourceStreamReader):
        def initialOffset(self) -> dict:
            return {"appends": 0}

        def latestOffset(self) -> dict:
            from pyarrow import fs as pafs

            fs, place = _file_system(f"{root}/commits")
            found = fs.get_file_info(pafs.FileSelector(place, allow_not_found=True))
            return {"appends": sum(f.base_name.endswith(".json") for f in found)}

        def partitions(self, start: dict, end: dict) -> list[InputPartition]:
            return [_Files(uri) for number in range(start["appends"], end["appends"]) for uri in listed(number)]

        def read(self, partition: InputPartition) -> Iterator[pa.RecordBatch]:
            import pyarrow.parquet as pq

            fs, place = _file_system(partition.uri)
            with fs.open_input_file(place) as f:
                for batch in pq.ParquetFile(f).iter_batches(4096, columns=["key", "value"]):
                    yield batch

        def commit(self, end: dict) -> None:
            pass

    class Source(DataSource):
        @classmethod
        def name(cls) -> str:
            return name

        def schema(self) -> str:
            return MESSAGE

        def streamReader(self, schema: T.StructType) -> DataSourceStreamReader:
            return Reader()

    return Source


class MessageLog:
    """One writer at a time, any number of readers."""

    def __init__(self, spark: SparkSession, root: str) -> None:
        self.spark = spark
        fs, place = hadoop_path(spark, root.rstrip("/"))
        self.root = fs.makeQualified(place).toString()
        self.name = f"log_{uuid.uuid4().hex}"
        spark.dataSource.register(_source(self.root, self.name))

    def appends(self) -> int:
        fs, place = hadoop_path(self.spark, f"{self.root}/commits")
        return sum(s.getPath().getName().endswith(".json") for s in fs.listStatus(place)) if fs.exists(place) else 0

    def append(self, messages: DataFrame) -> None:
        """Adds (key, value) rows; they are there once their number is, as a whole."""
        number = self.appends()
        place = f"{self.root}/messages/{number:012d}-{uuid.uuid4().hex}"
        messages.select("key", "value").write.parquet(place)
        fs, folder = hadoop_path(self.spark, place)
        files = [s.getPath().toString() for s in fs.listStatus(folder) if s.getPath().getName().endswith(".parquet")]
        fs, part = hadoop_path(self.spark, f"{self.root}/commits/part-{uuid.uuid4().hex}")
        out = fs.create(part)
        out.write(bytearray(json.dumps(files).encode()))
        out.close()
        if not fs.rename(part, hadoop_path(self.spark, f"{self.root}/commits/{number:012d}.json")[1]):
            raise RuntimeError(f"another writer has appended number {number} to {self.root}")

    def stream(self) -> DataFrame:
        """(key, value) of all messages, from the first one on; a checkpoint says where to go on."""
        return self.spark.readStream.format(self.name).load()
