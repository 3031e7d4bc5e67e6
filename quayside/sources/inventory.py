"""Metadata listing that also sees hidden files, empty files and directories."""

from __future__ import annotations

import os
from collections.abc import Iterator, Sequence
from functools import reduce

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quayside.schemas import INVENTORY
from quayside.session import checkpoint_root

LIST_CHUNK = 10_000


def _list_one_level(batches: Iterator[pd.DataFrame], roots: frozenset[str]) -> Iterator[pd.DataFrame]:
    def frame(rows: list[tuple]) -> pd.DataFrame:
        out = pd.DataFrame(rows, columns=["path", "is_dir", "size", "mtime"])
        out["mtime"] = pd.to_datetime(out["mtime"], unit="us", utc=True)
        return out

    for batch in batches:
        for directory in batch["path"]:
            rows: list[tuple] = []
            try:
                entries = os.scandir(directory)
            except FileNotFoundError:
                if directory in roots:
                    raise
                continue  # it went away during the walk; anything else that can not be listed fails the job
            with entries:
                for entry in entries:
                    try:
                        st = entry.stat(follow_symlinks=False)
                    except FileNotFoundError:
                        continue
                    is_dir = entry.is_dir(follow_symlinks=False)
                    rows.append((entry.path, is_dir, 0 if is_dir else st.st_size, st.st_mtime_ns // 1000))
                    if len(rows) >= LIST_CHUNK:
                        yield frame(rows)
                        rows = []
            if rows:
                yield frame(rows)


def scan(spark: SparkSession, roots: Sequence[str], tasks: int | None = None) -> DataFrame:
    """Everything below the roots (mounted paths): path, is_dir, size, mtime. A root that is not there, or a folder that
    can not be listed, fails.

    Directories are listed breadth-first. Each level is one distributed job over the directories
    the level before has found, spread evenly whatever subtree they come from, so one large subtree
    does not end up in one task. The driver only loops over the depth.
    """
    checkpoint_root(spark)
    tasks = tasks or spark.sparkContext.defaultParallelism
    starts = frozenset(r.rstrip("/") or "/" for r in roots)
    frontier = spark.createDataFrame([(r.rstrip("/") or "/",) for r in roots], "path string")
    levels: list[DataFrame] = []
    while True:
        level = (
            frontier.select("path").repartition(tasks, F.xxhash64("path"))
            .mapInPandas(lambda batches: _list_one_level(batches, starts), INVENTORY).checkpoint()
        )
        levels.append(level)
        frontier = level.filter("is_dir")
        if frontier.isEmpty():
            return reduce(DataFrame.unionByName, levels)
