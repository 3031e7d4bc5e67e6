"""Session settings and the shared scratch folder."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession

_area: ContextVar[str | None] = ContextVar("scratch_area", default=None)


def build(master: str | None = None, app: str = "quayside", **conf: str) -> SparkSession:
    builder = (
        SparkSession.builder.appName(app)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
    )
    if master:
        builder = builder.master(master)
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    return builder.getOrCreate()


def prepare(spark: SparkSession) -> None:
    """Settings every plan here relies on: UTC days, adaptive, skew-splitting joins, and batches of some megabytes for
    Python workers, however long a row is."""
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    spark.conf.set("spark.sql.adaptive.enabled", "true")
    spark.conf.set("spark.sql.adaptive.skewJoin.enabled", "true")
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", "8m")


def checkpoint_root(spark: SparkSession) -> str:
    """The shared folder the cluster names in spark.checkpoint.dir.

    Only where it is unset, as in local tests, a folder of our own is used.
    """
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if root is None:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir has to name a folder all executors share")
        root = os.path.join(tempfile.gettempdir(), "quayside-checkpoints")
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(root)
    return root


def scratch(spark: SparkSession, name: str) -> str:
    """A fresh folder name below the shared checkpoint root, or inside the current ``scratch_area``."""
    base = _area.get() or checkpoint_root(spark).rstrip("/")
    return f"{base}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """The rows as a columnar table below the shared checkpoint root, free of the plan that made them.

    Later steps read only the columns they need, know the true size, and survive lost executors.
    """
    path = scratch(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def hadoop_path(spark: SparkSession, path: str) -> tuple:
    """(file system, path) for listing and removing folders on whatever store the path names."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark._jsc.hadoopConfiguration()), target


@contextmanager
def scratch_area(spark: SparkSession, name: str) -> Iterator[str]:
    """Intermediate tables written inside live in one folder of their own, which goes away at the end.

    For long-running jobs; only use it around work that is finished before the end.
    """
    path = scratch(spark, name)
    token = _area.set(path)
    try:
        yield path
    finally:
        _area.reset(token)
        fs, target = hadoop_path(spark, path)
        fs.delete(target, True)
