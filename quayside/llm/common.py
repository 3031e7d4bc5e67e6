"""What several operators here share: files in the shared folder, batches of texts, connected components."""

from __future__ import annotations

import gc
import os
import re
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quayside import session
from quayside.session import hadoop_path, written


def prepare(spark: SparkSession) -> None:
    """What all plans rely on, and batches of some megabytes for Python workers, whose texts may be long."""
    session.prepare(spark)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "4000")
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", "8m")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def text_bytes(column: str) -> Column:
    """The text in UTF-8; null counts as empty."""
    return F.coalesce(F.col(column).cast("binary"), F.lit(b""))


def total_bytes(df: DataFrame, column: str) -> int:
    return df.agg(F.sum(F.octet_length(column))).first()[0] or 0


def free_shuffles(spark: SparkSession) -> None:
    """Spark drops the shuffle files of finished steps once the driver has collected their handles."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def drop(spark: SparkSession, *tables: DataFrame) -> None:
    """Removes tables made by ``written`` that no later step reads."""
    for df in tables:
        for path in {os.path.dirname(f) for f in df.inputFiles()}:
            fs, target = hadoop_path(spark, path)
            fs.delete(target, True)


@contextmanager
def replaced(path: str) -> Iterator:
    """A binary stream whose content appears under ``path`` at once, so a task that runs again does no harm."""
    fs, place = open_path(path)
    fs.create_dir(os.path.dirname(place), recursive=True)
    part = f"{place}.{os.getpid()}-{os.urandom(4).hex()}.tmp"
    with fs.open_output_stream(part, compression=None) as out:
        yield out
    fs.move(part, place)


def open_path(path: str) -> tuple:
    """(file system, path in it) of a path or URI in the shared folder."""
    from pyarrow import fs

    if "://" in path or path.startswith("file:"):
        return fs.FileSystem.from_uri(re.sub(r"^file:/(?!/)", "file:///", path))
    return fs.LocalFileSystem(), os.path.abspath(path)


def slices(batch, limit: int, column: str = "text") -> Iterator:
    """Row ranges of an Arrow batch, each of about ``limit`` bytes of ``column`` or of one longer row."""
    import numpy as np
    import pyarrow.compute as pc

    if not batch.num_rows:
        return
    ends = np.cumsum(pc.binary_length(batch.column(column)).to_numpy(zero_copy_only=False))
    part, first = (ends - 1) // limit, 0
    for last in [*(np.flatnonzero(part[1:] != part[:-1]) + 1).tolist(), batch.num_rows]:
        yield batch.slice(first, last - first)
        first = last
    tidy()


def tidy() -> None:
    """Gives memory that a worker no longer uses back to the machine it shares."""
    import pyarrow as pa

    pa.default_memory_pool().release_unused()


def components(links: DataFrame, a: str = "a", b: str = "b", name: str = "links") -> DataFrame:
    """(id, component): the smallest id that links reach, for every id with a link to another one.

    Alternates two star operations on the written links until they no longer change: every id hands its
    larger neighbours, then its smaller ones, to its smallest neighbour. Aggregations combine before the
    shuffle and the joins are plain equality joins, so an id with very many links is no single task's work.
    """
    spark = links.sparkSession
    now = written(links.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).filter("u != v").distinct(), name)
    before = None
    while True:
        state = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first()
        if state == before:
            break
        before = state
        both = now.union(now.select("v", "u"))
        least = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
        large = both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").selectExpr("v as u", "m as v").filter("u != v").union(least.selectExpr("u", "m"))
        following = written(small.distinct(), name)
        drop(spark, now)
        now = following
    roots = now.select(F.col("v").alias("id"), F.col("v").alias("component")).distinct()
    return now.select(F.col("u").alias("id"), F.col("v").alias("component")).union(roots)

