"""One archive row in, one row per member out."""

from __future__ import annotations

import io
import posixpath
import zipfile
import zlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quayside.functions import paths
from quayside.schemas import ARCHIVE_MEMBER

FAILED = "zip_extraction_failed"
BATCH_ROWS = 10_000
DEEPEST = 64
COLUMNS = ["archive", "member", "path", "length", "content", "error"]


ERRORS = (zipfile.BadZipFile, zipfile.LargeZipFile, zlib.error, ValueError, OSError, EOFError, NotImplementedError,
          RuntimeError)


def _targets(archive: str, bundle: zipfile.ZipFile) -> dict[str, zipfile.ZipInfo]:
    """Member per target path; a later one replaces an earlier one with the same target."""
    base = posixpath.dirname(archive) or "."
    prefix = base.rstrip("/") + "/"
    last: dict[str, zipfile.ZipInfo] = {}
    for info in bundle.infolist():
        target = posixpath.normpath(posixpath.join(base, info.filename.lstrip("/")))
        if not target.startswith(prefix):
            raise ValueError(f"member outside the target directory: {info.filename}")
        if not info.is_dir():
            last[target] = info
    return last


def _rows(archive: str, content: bytes | None, content_limit: int | None, depth: int) -> Iterator[tuple]:
    """All members, or one row with the error; archives among them are opened as well."""
    try:
        if depth < 1:
            raise ValueError("archives nested too deeply")
        if content is None:
            raise ValueError("the archive can not be read")
        with zipfile.ZipFile(io.BytesIO(content)) as bundle:
            members = _targets(archive, bundle)
            for info in members.values():  # every member is readable, or the archive as a whole fails
                with bundle.open(info) as handle:
                    while handle.read(1 << 20):
                        pass
            for target, info in members.items():
                # A member above the limit is turned away by its size alone, so its bytes never travel.
                body = bundle.read(info) if content_limit is None or info.file_size <= content_limit else None
                if body is not None and target.lower().endswith(".zip"):
                    yield from _rows(target, body, content_limit, depth - 1)
                else:
                    yield archive, info.filename, target, info.file_size, body, None
    except ERRORS as exc:
        yield archive, None, archive, None, None, f"{FAILED}: {exc}"


def expand(archives: DataFrame, content_limit: int | None = None, max_depth: int = DEEPEST,
           batch_bytes: int = 8 << 20) -> DataFrame:
    """(path, content) of archives to ``ARCHIVE_MEMBER`` rows, in one pass.

    An unreadable archive, or one with a member that would land outside its directory, gives exactly
    one row with ``error`` set and no members. Archives inside archives are opened until nothing is left; one below
    ``max_depth`` levels, which only a hostile file reaches, gives an error row. With a ``content_limit`` larger members have
    their size and no content. Rows leave the task as soon as ``batch_bytes`` are full.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rows: list[tuple] = []
        held = 0
        for batch in batches:
            for archive, content in zip(batch["path"], batch["content"]):
                for row in _rows(archive, content, content_limit, max_depth):
                    rows.append(row)
                    held += len(row[4] or b"")
                    if held >= batch_bytes or len(rows) >= BATCH_ROWS:
                        yield pd.DataFrame(rows, columns=COLUMNS)
                        rows, held = [], 0
        if rows:
            yield pd.DataFrame(rows, columns=COLUMNS)

    return archives.select("path", "content").mapInPandas(run, ARCHIVE_MEMBER)


def with_members(files: DataFrame, max_depth: int = DEEPEST, content_limit: int | None = None) -> DataFrame:
    """Plain files and archive members as one table; archives themselves are consumed.

    A failed archive stays as one row with ``error`` set and nothing else known.
    """
    zipped = paths.is_archive("path")
    return plain_and_members(files.filter(~zipped), files.filter(zipped), max_depth, content_limit)


def plain_and_members(plain: DataFrame, zipped: DataFrame, max_depth: int = DEEPEST, content_limit: int | None = None) -> DataFrame:
    """``with_members`` where plain files and archives come from different places: neither is read for the other."""
    members = expand(zipped, content_limit, max_depth).select(
        "path", F.lit(None).cast("timestamp").alias("modificationTime"), "length", "content", "error")
    return plain.select("path", "modificationTime", "length", "content", F.lit(None).cast("string").alias("error")).unionByName(members)


def audit(members: DataFrame, archive: str = "archive", member: str = "member", dest: str = "dest") -> DataFrame:
    """Per archive: does every member stay below the destination, and how many do not."""
    inside = paths.is_inside(F.concat_ws("/", F.col(dest), F.col(member)), F.col(dest))
    return members.groupBy(archive).agg(
        F.count("*").alias("members"),
        F.count_if(~inside).alias("escaping"),
        F.bool_and(inside).alias("contained"),
    )
