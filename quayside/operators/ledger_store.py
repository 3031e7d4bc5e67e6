"""A ledger store whose batches cost the same however many came before.

Every batch becomes a *run*: its entries, dealt by hash into files of about ``FILE_ROWS``, and a Bloom filter per file. When
``fan`` runs of one level are there they are merged into one of the next, as the current view of their entries and
without those that no longer count, so there are few runs and each entry is rewritten once per level. A lookup tests its
hashes against the filters and opens only files that may hold one of them.

A manifest names the runs and the last batch of every source; writing its next version is the commit. A batch that runs
again after that changes nothing, one that died before it left only folders nobody names.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator
from dataclasses import asdict, dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quayside.config import LedgerTtl
from quayside.operators import ledger
from quayside.session import hadoop_path, written

FILE_ROWS = 1 << 20
FAN = 8
#: Bits per entry and tests per hash: about one file in 700 is opened for nothing.
BITS, TESTS = 16, 8
#: Groups in which a lookup's hashes meet the filters; a power of two.
GROUPS = 64


@dataclass
class Run:
    """``files`` is a power of two: an entry lies in the file that the low bits of its hash's hash name."""

    name: str
    level: int
    files: int
    rows: int


@dataclass
class Manifest:
    version: int = 0
    runs: list[Run] = field(default_factory=list)
    done: dict[str, int] = field(default_factory=dict)


def filter_bits(h: np.ndarray, bits: int) -> np.ndarray:
    """The places of each 64-bit hash in a filter of ``bits`` (a power of two), one row per hash."""
    h = h.view(np.uint64)
    step = ((h >> np.uint64(32)) * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)
    mixed = h * np.uint64(0xBF58476D1CE4E5B9)
    mixed ^= mixed >> np.uint64(31)
    return (mixed[:, None] + np.arange(TESTS, dtype=np.uint64) * step[:, None]) & np.uint64(bits - 1)


def _filters(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A filter for one file's hashes (file, h)."""
    held = [b for b in batches if b.num_rows]
    if not held:
        return
    h = np.concatenate([b.column("h").to_numpy() for b in held])
    bits = 1 << max(9, int(BITS * len(h) - 1).bit_length())
    marks = np.zeros(bits, bool)
    marks[filter_bits(h, bits).ravel()] = True
    yield pa.RecordBatch.from_pydict({"file": pa.array([held[0].column("file")[0].as_py()], pa.int64()),
                                      "bits": pa.array([np.packbits(marks, bitorder="little").tobytes()], pa.binary())})


def _may_hold(asked: pa.Table, filters: pa.Table) -> pa.Table:
    """The files (run, file) whose filter has all places of some hash that lies in that file if anywhere."""
    h = asked.column("h").to_numpy()
    found = []
    for run, files, file, packed in zip(*(filters.column(c).to_pylist() for c in ("run", "files", "file", "bits"))):
        mine = h[(h & (files - 1)) == file]
        marks = np.frombuffer(packed, np.uint8)
        places = filter_bits(mine, 8 * len(marks))
        if ((marks[places >> np.uint64(3)] >> (places & np.uint64(7)).astype(np.uint8)) & 1).all(axis=1).any():
            found.append((run, file))
    return pa.table({"run": pa.array([r for r, _ in found], pa.int32()), "file": pa.array([f for _, f in found], pa.int64())})


class TieredLedger:
    """The ``Ledger`` protocol over tiers of runs below ``root``; one writer at a time.

    A batch's name is ``<source>-<number>``, numbers rise per source. With ``ttl`` expired entries go when their run is
    merged; the latest entry seen so far is the present. Enqueued entries must not outlive completed ones, or
    a completion could be forgotten before what it completes.
    """

    COLUMNS = ledger.ParquetLedger.COLUMNS

    def __init__(self, spark: SparkSession, root: str, ttl: LedgerTtl | None = LedgerTtl(), fan: int = FAN,
                 file_rows: int = FILE_ROWS) -> None:
        if ttl is not None and ttl.enqueued_us > min(ttl.processed_us, ttl.failed_us):
            raise ValueError("enqueued entries must not outlive completed ones")
        self.spark, self.root, self.ttl, self.fan, self.file_rows = spark, root.rstrip("/"), ttl, fan, file_rows

    # --- manifest ---

    def _versions(self) -> list[int]:
        fs, place = hadoop_path(self.spark, f"{self.root}/manifest")
        return sorted(int(s.getPath().getName()) for s in fs.listStatus(place) if s.getPath().getName().isdigit()) \
            if fs.exists(place) else []

    def manifest(self, version: int | None = None) -> Manifest:
        versions = self._versions()
        if version is None and not versions:
            return Manifest()
        path = f"{self.root}/manifest/{versions[-1] if version is None else version:012d}"
        read = json.loads(self.spark.read.text(path, wholetext=True).first()[0])
        return Manifest(read["version"], [Run(**r) for r in read["runs"]], read["done"])

    def _commit(self, manifest: Manifest) -> None:
        """Under a name of its own first, so that the version is there as a whole or not at all."""
        body = json.dumps(asdict(manifest)).encode()
        fs, part = hadoop_path(self.spark, f"{self.root}/manifest/part-{uuid.uuid4().hex}")
        out = fs.create(part)
        out.write(bytearray(body))
        out.close()
        if not fs.rename(part, hadoop_path(self.spark, f"{self.root}/manifest/{manifest.version:012d}")[1]):
            raise RuntimeError(f"another writer has committed version {manifest.version} of {self.root}")
        self._clean(manifest)

    def _clean(self, manifest: Manifest) -> None:
        """Removes older versions, and runs that neither this version nor the one before it names."""
        versions = self._versions()
        named = {r.name for r in manifest.runs}
        if manifest.version - 1 in versions:
            named |= {r.name for r in self.manifest(manifest.version - 1).runs}
        for old in versions:
            if old < manifest.version - 1:
                fs, place = hadoop_path(self.spark, f"{self.root}/manifest/{old:012d}")
                fs.delete(place, True)
        for kind in ("runs", "filters"):
            fs, place = hadoop_path(self.spark, f"{self.root}/{kind}")
            for status in fs.listStatus(place) if fs.exists(place) else []:
                if status.getPath().getName() not in named:
                    fs.delete(status.getPath(), True)

    # --- writing ---

    def append(self, rows: DataFrame, batch: str) -> None:
        """Commits a batch of (hash, state, path, reason, at_us)."""
        source, _, number = batch.rpartition("-")
        now = self.manifest()
        if int(number) <= now.done.get(source, -1):
            return
        entries = written(ledger.current(rows.select(*[c.split()[0] for c in self.COLUMNS.split(", ")])), "entries")
        runs = [*now.runs, self._run(entries, 0)]
        level = 0
        while len(full := [r for r in runs if r.level == level]) >= self.fan:
            merged = ledger.current(self._rows(full))
            if self.ttl is not None:
                newest = self._rows(runs).agg(F.max("at_us")).first()[0]  # of a few runs, one column
                merged = ledger.live(merged, newest, self.ttl).drop("expires_us") if newest is not None else merged
            level += 1
            runs = [r for r in runs if r not in full] + [self._run(written(merged, "merged"), level)]
        self._commit(Manifest(now.version + 1, runs, now.done | {source: int(number)}))

    def applied(self, batch: str) -> bool:
        source, _, number = batch.rpartition("-")
        return int(number) <= self.manifest().done.get(source, -1)

    def _run(self, entries: DataFrame, level: int) -> Run:
        n = entries.count()
        files = 1 << max(0, -(-n // self.file_rows) - 1).bit_length()
        run = Run(f"{level}-{uuid.uuid4().hex}", level, files, n)
        h = F.xxhash64("hash")
        entries.withColumn("file", h.bitwiseAND(files - 1)).repartition(files, "file").write.partitionBy("file").parquet(
            f"{self.root}/runs/{run.name}")
        hashes = self._read([run]).select("file", F.xxhash64("hash").alias("h"))
        hashes.groupBy("file").applyInArrow(_filters, "file long, bits binary").write.parquet(f"{self.root}/filters/{run.name}")
        return run

    # --- reading ---

    def _read(self, runs: list[Run]) -> DataFrame:
        parts = [self.spark.read.schema(f"{self.COLUMNS}, file long").parquet(f"{self.root}/runs/{r.name}") for r in runs if r.rows]
        if not parts:
            return self.spark.createDataFrame([], f"{self.COLUMNS}, file long")
        out = parts[0]
        for part in parts[1:]:
            out = out.unionByName(part)
        return out

    def _rows(self, runs: list[Run]) -> DataFrame:
        return self._read(runs).drop("file")

    def live(self, as_of_us: int) -> DataFrame:
        return ledger.live(ledger.current(self._rows(self.manifest().runs)), as_of_us, self.ttl)

    def newest_us(self) -> int | None:
        return self._rows(self.manifest().runs).agg(F.max("at_us")).first()[0]

    def files_for(self, hashes: DataFrame) -> list[tuple[Run, int]]:
        """The files that may hold one of the hashes. Filters and hashes meet in ``GROUPS`` groups by the low bits of the hash."""
        runs = [r for r in self.manifest().runs if r.rows]
        if not runs:
            return []
        asked = hashes.select(F.xxhash64("hash").alias("h")).distinct().withColumn("group", F.col("h").bitwiseAND(GROUPS - 1))
        index = None
        for i, run in enumerate(runs):
            filters = self.spark.read.schema("file long, bits binary").parquet(f"{self.root}/filters/{run.name}")
            # A file of a run with fewer files than groups is asked by several of them.
            step = min(run.files, GROUPS)
            groups = F.sequence(F.col("file").bitwiseAND(step - 1), F.lit(GROUPS - 1).cast("long"), F.lit(step).cast("long"))
            part = filters.select(F.lit(i).alias("run"), F.lit(run.files).cast("long").alias("files"), "file", "bits", F.explode(groups).alias("group"))
            index = part if index is None else index.unionByName(part)
        found = asked.groupBy("group").cogroup(index.groupBy("group")).applyInArrow(_may_hold, "run int, file long").distinct()
        return [(runs[r["run"]], r["file"]) for r in found.collect()]  # at most one row per file

    def lookup(self, hashes: DataFrame, as_of_us: int | None = None) -> DataFrame:
        """The entries of the given hashes that still count; all current ones without ``as_of_us``."""
        places = [f"{self.root}/runs/{run.name}/file={file}" for run, file in self.files_for(hashes)]
        if not places:
            return self.spark.createDataFrame([], self.COLUMNS)
        rows = self.spark.read.schema(self.COLUMNS).parquet(*places)
        kept = ledger.current(rows.join(hashes.select("hash").distinct(), "hash", "left_semi"))
        if as_of_us is None:
            return kept
        kept = ledger.live(kept, as_of_us, self.ttl)
        return kept.drop("expires_us") if self.ttl is not None else kept
