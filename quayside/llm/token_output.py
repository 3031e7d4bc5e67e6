"""Token ids of documents as files of separately compressed arrays that share one Zstandard dictionary.

A folder holds ``dictionary.zdict`` and shard files in ascending order of document id. A shard is::

    magic "QSTOKEN1" | SHA-256 of the dictionary | one Zstandard frame per document | index | trailer

The frames hold ids as little-endian unsigned 32-bit integers. The index has a row per document: id (signed 64 bits,
the smallest value for null), offset of its frame, compressed bytes, number of ids. The trailer says where the
index starts and how many rows it has, so one document is read with two short reads and no scan.
"""

from __future__ import annotations

import hashlib
import struct
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quayside.llm.common import open_path, replaced, slices, text_bytes
from quayside.llm.tokens import Encoder
from quayside.session import written

MAGIC, TRAILER, NULL_ID = b"QSTOKEN1", "<QQ", -(1 << 63)
INDEX = [("doc_id", "<i8"), ("offset", "<u8"), ("size", "<u8"), ("ids", "<u8")]
DICTIONARY_BYTES, DICTIONARY_DOCS, DICTIONARY_DOC_BYTES = 64 << 10, 1024, 64 << 10


def sampled() -> Column:
    """Whether a document is short enough to train the dictionary from."""
    return F.octet_length("text").between(1, DICTIONARY_DOC_BYTES)


def train_dictionary(docs: DataFrame, candidates: int, tokenizer: str) -> bytes:
    """A dictionary from the id arrays of about ``DICTIONARY_DOCS`` of the ``candidates`` that ``sampled`` admits, picked
    by a hash of id and text. Tasks hand over only picked texts, twice that number at most, so what the driver gets
    does not grow with the table. The dictionary only affects sizes, never contents. Too few or too uniform
    documents give a raw dictionary of their own bytes, perhaps an empty one."""
    import pyarrow as pa
    import zstandard

    share = -(-(DICTIONARY_DOCS << 30) // max(candidates, 1))
    few = docs.filter(sampled() & (F.pmod(F.xxhash64("doc_id", "text"), F.lit(1 << 30)) < share)).limit(2 * DICTIONARY_DOCS)
    texts = pa.array(sorted(r["text"] for r in few.select("text").collect()), pa.binary())  # at most 128 MB, usually 4
    samples = Encoder(tokenizer).encode(texts)
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, samples, d=8, k=256).as_bytes()
    except zstandard.ZstdError:
        return b"".join(samples)[:DICTIONARY_BYTES]


def read_dictionary(folder: str) -> bytes:
    fs, place = open_path(f"{folder}/dictionary.zdict")
    with fs.open_input_stream(place, compression=None) as f:
        return f.read()


def write(df: DataFrame, folder: str, tokenizer: str, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text",
          shard_bytes: int = 64 << 20) -> DataFrame:
    """Writes the shards and returns the written list of them: shard, path, docs, ids.

    Rows are dealt into ranges of ids of about ``shard_bytes`` of text each and sorted there; null ids come first.
    Rows of one id, or of none, follow each other in the order of a hash of their texts and are dealt over several ranges if
    they are many. A null or empty text is its end id alone.
    Other columns are left out. An empty table gives a dictionary and no shard.
    """
    docs = df.select(F.col(id_col).cast("long").alias("doc_id"), text_bytes(text_col).alias("text"))
    size, candidates = docs.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0)), F.count_if(sampled())).first()
    dictionary = train_dictionary(docs, candidates, tokenizer)
    digest = hashlib.sha256(dictionary).digest()
    with replaced(f"{folder}/dictionary.zdict") as out:
        out.write(dictionary)

    def run(batches):
        import numpy as np
        import pyarrow as pa
        import zstandard
        from pyspark import TaskContext


        first = next(batches, None)
        while first is not None and not first.num_rows:
            first = next(batches, None)
        if first is None:
            return
        encoder, end = Encoder(tokenizer), np.array([end_id], "<u4").tobytes()
        pack = compressor(read_dictionary(folder)).compress
        shard, index, at = TaskContext.get().partitionId(), [], len(MAGIC) + len(digest)
        path = f"{folder}/shard-{shard:06d}.tok"
        with replaced(path) as out:
            out.write(MAGIC + digest)
            while first is not None:
                for batch in slices(first, 8 << 20):
                    for doc, ids in zip(batch.column("doc_id").to_pylist(), encoder.encode(batch.column("text"))):
                        frame = pack(ids + end)
                        index.append((NULL_ID if doc is None else doc, at, len(frame), len(ids) // 4 + 1))
                        out.write(frame)
                        at += len(frame)
                first = next(batches, None)
            rows = np.array(index, INDEX)
            out.write(rows.tobytes())
            out.write(struct.pack(TRAILER, at, len(rows)))
        yield pa.RecordBatch.from_pydict({"shard": pa.array([shard], pa.int32()), "path": [path],
                                          "docs": [len(rows)], "ids": [int(rows["ids"].sum())]})

    ordered = docs.repartitionByRange(size // shard_bytes + 1, "doc_id", F.xxhash64("text"), "text").sortWithinPartitions(
        "doc_id", F.xxhash64("text"), "text")
    return written(ordered.mapInArrow(run, "shard int, path string, docs long, ids long"), "shards")


def compressor(dictionary: bytes):
    import zstandard

    if not dictionary:
        return zstandard.ZstdCompressor(level=3)
    return zstandard.ZstdCompressor(level=3, dict_data=zstandard.ZstdCompressionDict(dictionary))


def decompressor(dictionary: bytes):
    import zstandard

    if not dictionary:
        return zstandard.ZstdDecompressor()
    return zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(dictionary))


class Shard:
    """One shard file, read by document number."""

    def __init__(self, path: str, dictionary: bytes):
        import numpy as np

        fs, place = open_path(path)
        self.file = fs.open_input_file(place)
        if self.file.read(len(MAGIC)) != MAGIC:
            raise ValueError(f"{path} is no shard")
        if self.file.read(32) != hashlib.sha256(dictionary).digest():
            raise ValueError(f"{path} was written with another dictionary")
        self.unpack = decompressor(dictionary).decompress
        size = self.file.size()
        self.file.seek(size - 16)
        at, n = struct.unpack(TRAILER, self.file.read(16))
        self.file.seek(at)
        self.index = np.frombuffer(self.file.read(size - 16 - at), INDEX)
        if len(self.index) != n:
            raise ValueError(f"{path} is cut short")

    def ids(self, number: int):
        import numpy as np

        row = self.index[number]
        self.file.seek(int(row["offset"]))
        return np.frombuffer(self.unpack(self.file.read(int(row["size"]))), "<u4")

    def __iter__(self) -> Iterator[tuple]:
        """(doc_id, ids) in the order of the file, read in pieces of some megabytes."""
        import numpy as np

        at = 0
        while at < len(self.index):
            begin = int(self.index["offset"][at])
            until = at + max(1, int(np.searchsorted(self.index["offset"][at:] - begin, 4 << 20)))
            rows = self.index[at:until]
            self.file.seek(begin)
            data = self.file.read(int(rows["offset"][-1] + rows["size"][-1]) - begin)
            for doc, offset, size, _ in rows.tolist():
                ids = np.frombuffer(self.unpack(data[offset - begin:offset - begin + size]), "<u4")
                yield (None if doc == NULL_ID else doc), ids
            at = until

    def close(self) -> None:
        self.file.close()


def read(shards: DataFrame, folder: str, with_ids: bool = True) -> DataFrame:
    """One row per document in the files: shard, doc_id, start (ids of all documents before it), n_tokens, ids_crc32,
    and the ids themselves unless ``with_ids`` is off. ``shards`` is what ``write`` returned."""
    def run(batches):
        import zlib

        import pyarrow as pa

        dictionary = read_dictionary(folder)
        for batch in batches:
            for number, path in zip(batch.column("shard").to_pylist(), batch.column("path").to_pylist()):
                shard, start, rows = Shard(path, dictionary), 0, []
                for doc, ids in shard:
                    rows.append((number, doc, start, len(ids), zlib.crc32(ids.tobytes()), ids if with_ids else None))
                    start += len(ids)
                    if len(rows) == 1000:
                        yield out(rows, pa)
                        rows = []
                if rows:
                    yield out(rows, pa)
                shard.close()

    def out(rows, pa):
        c = list(zip(*rows))
        columns = {"shard": pa.array(c[0], pa.int32()), "doc_id": pa.array(c[1], pa.int64()),
                   "start": pa.array(c[2], pa.int64()), "n_tokens": pa.array(c[3], pa.int64()),
                   "ids_crc32": pa.array(c[4], pa.int64())}
        if with_ids:
            columns["ids"] = pa.array([x.astype("int64") for x in c[5]], pa.list_(pa.int64()))
        return pa.RecordBatch.from_pydict(columns)

    from pyspark.sql import Window

    schema = "shard int, doc_id long, start long, n_tokens long, ids_crc32 long" + (", ids array<long>" if with_ids else "")
    count = shards.count()
    if not count:
        return shards.sparkSession.createDataFrame([], schema)
    # One row per shard, not per document: a running sum over the list of files.
    before = shards.select("shard", (F.sum("ids").over(Window.orderBy("shard")) - F.col("ids")).alias("before"))
    rows = shards.select("shard", "path").repartition(count, "shard").mapInArrow(run, schema)
    return rows.join(before, "shard").withColumn("start", F.col("start") + F.col("before")).drop("before")

