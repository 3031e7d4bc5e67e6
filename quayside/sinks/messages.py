"""Work messages, dead letters and lanes on the producing side."""

from __future__ import annotations

from typing import Protocol

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quayside.config import Lanes
from quayside.functions import paths

TIMESTAMP_FORMAT = "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX"


def work_messages(accepted: DataFrame, lanes: Lanes = Lanes(), working_dir: str = "/landing") -> DataFrame:
    """Accepted files (filename, kind, length, hash, timestamp) to (key, value) rows."""
    body = F.struct(
        F.col("hash").alias("id"),
        paths.under(f"{working_dir}/{lanes.processing}", "filename").alias("path"),
        F.col("filename"),
        F.col("kind"),
        F.col("length").alias("size"),
        F.col("hash"),
        F.col("timestamp"),
    )
    return accepted.select(
        F.col("hash").alias("key"),
        F.to_json(body, {"timestampFormat": TIMESTAMP_FORMAT}).alias("value"),
    )


class MessageSink(Protocol):
    def write(self, messages: DataFrame) -> None: ...


class FileSink:
    """Parquet, JSON or any other file format Spark can append to."""

    def __init__(self, path: str, fmt: str = "parquet") -> None:
        self.path, self.fmt = path, fmt

    def write(self, messages: DataFrame) -> None:
        messages.write.format(self.fmt).mode("append").save(self.path)


class NoopSink:
    """Dry run: computes every message and keeps none."""

    def write(self, messages: DataFrame) -> None:
        messages.write.format("noop").mode("overwrite").save()


class OptionsSink:
    """Any data source by name and options, e.g. a message broker whose connector is on the class path."""

    def __init__(self, fmt: str, **options: str) -> None:
        self.fmt, self.options = fmt, options

    def write(self, messages: DataFrame) -> None:
        messages.write.format(self.fmt).options(**self.options).mode("append").save()


def write_lanes(classified: DataFrame, path: str, mode: str = "append") -> None:
    """One folder per lane, reasons kept; readers of one lane touch only its folder."""
    classified.write.partitionBy("lane").mode(mode).parquet(path)


def dead_letters(rollup: DataFrame, failed: Column | None = None) -> DataFrame:
    """Keys whose publishing finally failed, with attempts and last error."""
    return rollup.filter(failed if failed is not None else F.col("status") == "failed")
