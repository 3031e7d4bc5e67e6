"""Files under landing roots, as a batch scan or as a stream."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quayside.functions import paths
from quayside.schemas import BINARY_FILE


def _local_path(df: DataFrame) -> DataFrame:
    """Drop the ``file:`` scheme so that paths compare equal to inventory paths."""
    return df.withColumn("path", F.regexp_replace("path", r"^file:/+", "/"))


def scan(spark: SparkSession, roots: Sequence[str]) -> DataFrame:
    """Every visible, non-empty file below the roots: path, modificationTime, length, content.

    Content is only read when a later step selects it; filters on ``length`` and
    ``modificationTime`` are pushed into the listing.
    """
    df = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(list(roots))
    return _local_path(df)


def stream(spark: SparkSession, root: str, max_files: int | None = None, max_bytes: int | None = None) -> DataFrame:
    """New files as they arrive, new sub-directories included.

    ``max_files`` / ``max_bytes`` cap one micro-batch; the rest waits for the next one, nothing is shed.
    """
    reader = (
        spark.readStream.format("binaryFile").schema(BINARY_FILE).option("recursiveFileLookup", "true")
    )
    if max_files is not None:
        reader = reader.option("maxFilesPerTrigger", max_files)
    if max_bytes is not None:
        reader = reader.option("maxBytesPerTrigger", max_bytes)
    return _local_path(reader.load(root))


def event_log(spark: SparkSession, path: str, fmt: str = "parquet", streaming: bool = False,
              schema=None, max_files: int | None = None) -> DataFrame:
    """Rows (path, op, ts) recorded by whatever watches the roots."""
    from quayside.schemas import FILE_EVENT

    reader = (spark.readStream if streaming else spark.read).format(fmt).schema(schema or FILE_EVENT)
    if streaming and max_files is not None:
        reader = reader.option("maxFilesPerTrigger", max_files)
    return reader.load(path)


def _hash_chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    import hashlib

    from pyarrow import fs

    for batch in batches:
        digests = []
        for uri in batch.column("path").to_pylist():
            try:
                filesystem, inner = fs.FileSystem.from_uri(uri)
                digest = hashlib.sha256(inner.rstrip("/").rsplit("/", 1)[-1].encode())
                with filesystem.open_input_stream(inner) as handle:
                    while chunk := handle.read(4 << 20):
                        digest.update(chunk)
                digests.append(digest.hexdigest())
            except OSError:
                digests.append(None)
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(digests, pa.string())],
                                         names=[*batch.schema.names, "hash"])


def hash_by_path(files: DataFrame, tasks: int | None = None) -> DataFrame:
    """Content hash for files too large for one cell: opened by path and read in 4 MiB chunks.

    Same digest as ``functions.scalars.content_hash``. The input needs no ``content`` column. A file that
    can not be read, e.g. because it is gone by now, gets NULL.
    """
    narrow = files.drop("content")
    if tasks:
        narrow = narrow.repartition(tasks)
    out = T.StructType(narrow.schema.fields + [T.StructField("hash", T.StringType())])
    return narrow.mapInArrow(_hash_chunks, out)


def _read_whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    from pyarrow import fs

    for batch in batches:
        for uri in batch.column("path").to_pylist():
            try:
                filesystem, inner = fs.FileSystem.from_uri(uri)
                with filesystem.open_input_stream(inner) as handle:
                    body = handle.read()
            except OSError:
                body = None
            yield pa.RecordBatch.from_arrays(
                [pa.array([uri]), pa.array([body], pa.binary())], names=["path", "content"])


def with_content(files: DataFrame) -> DataFrame:
    """(path, content) of files opened by path, one file in memory at a time; NULL when unreadable."""
    return files.select("path").repartition(F.xxhash64("path")).mapInArrow(_read_whole, "path string, content binary")


def facts(files: DataFrame) -> DataFrame:
    """filename, directory, extension and kind of every file row."""
    return (
        files.withColumn("filename", paths.basename("path"))
        .withColumn("directory", paths.parent("path"))
        .withColumn("extension", paths.ext("filename"))
        .withColumn("kind", paths.kind("filename"))
    )
