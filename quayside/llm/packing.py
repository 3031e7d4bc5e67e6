"""Harmonic packing of documents into token sequences of a fixed length.

Lengths fall into classes by the reciprocal of the capacity C: class j holds lengths in (C/(j+1), C/j], and
every bin of class j takes exactly j pieces, whatever they are. No bin ever looks at another class, so each
worker packs its own rows without a shuffle.

A document longer than C gives full sequences first. What is left is laid whole into its class if j such
pieces would fill a bin but for ``slack``; otherwise the largest exact reciprocal C/2^i is cut off and the rest is
classed anew; rests below C/32 are never cut, since their classes waste at most 1/33 of a bin.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quayside.llm.common import slices, text_bytes
from quayside.llm.tokens import Encoder

SCHEMA = ("doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, "
          "tokens binary")


def cuts(n: int, capacity: int, slack: float) -> list[int]:
    """The lengths of the pieces of a document of n tokens, in order."""
    out = [capacity] * (n // capacity)
    rest = n % capacity
    while rest:
        j = capacity // rest
        if j >= 32 or j * rest >= (1 - slack) * capacity:
            out.append(rest)
            break
        step = capacity
        while step > rest:
            step //= 2
        out.append(step)
        rest -= step
    return out


class Bins:
    """The open bin of each class of one worker."""

    def __init__(self, capacity: int, slack: float, first_id: int):
        self.capacity, self.slack, self.next_id = capacity, slack, first_id
        self.open: dict[int, list[tuple]] = {}

    def add(self, doc: int, ids) -> Iterator[list]:
        """Rows of the bins that ``doc`` fills."""
        import zlib

        start = 0
        for n in cuts(len(ids), self.capacity, self.slack):
            data = ids[start:start + n].tobytes()
            j = self.capacity // n
            held = self.open.setdefault(j, [])
            held.append((doc, start, n, zlib.crc32(data), len(ids), data))
            start += n
            if len(held) == j:
                yield from self.close(self.open.pop(j))

    def close(self, pieces: list[tuple]) -> Iterator[list]:
        offset = 0
        for doc, start, n, crc, total, data in pieces:
            yield [doc, start, n, crc, total, self.next_id, offset, data]
            offset += n
        self.next_id += 1

    def rest(self) -> Iterator[list]:
        """The bins left open share sequences, largest pieces first, so that a worker leaves few unfilled."""
        pieces = sorted((p for held in self.open.values() for p in held), key=lambda p: (-p[2], p[0] is None, p[0], p[1]))
        self.open = {}
        while pieces:
            room, taken, left = self.capacity, [], []
            for p in pieces:
                if p[2] <= room:
                    taken.append(p)
                    room -= p[2]
                else:
                    left.append(p)
            yield from self.close(taken)
            pieces = left


def pack(df: DataFrame, tokenizer: str, capacity: int = 2048, end_id: int = 1, slack: float = 0.02,
         id_col: str = "doc_id", text_col: str = "text", with_tokens: bool = True) -> DataFrame:
    """One row per piece: where it starts in its document, how long it is, its sequence and its place there.

    Every row is packed, repeated ids and null ids too (start and length then still count within the
    row); a null or empty text is its end id alone. Other columns are left out. Sequences are to be padded at
    their end up to ``capacity``. sequence_id is the task's number and a count within it: tasks read
    fixed ranges of the input, so a task that runs again gives the same rows. An empty table gives no rows.
    """
    def run(batches):
        import numpy as np
        import pyarrow as pa
        from pyspark import TaskContext


        encoder, end = Encoder(tokenizer), np.array([end_id], "<u4").tobytes()
        bins = Bins(capacity, slack, TaskContext.get().partitionId() << 32)

        def out(rows):
            columns = list(zip(*rows))
            if not with_tokens:
                columns = columns[:-1]
            return pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(columns, [pa.int64()] * 7 + [pa.binary()])], names[:len(columns)])

        for whole in batches:
            for batch in slices(whole, 8 << 20):
                rows = []
                for doc, ids in zip(batch.column("doc_id").to_pylist(), encoder.encode(batch.column("text"))):
                    rows += bins.add(doc, np.frombuffer(ids + end, "<u4"))
                if rows:
                    yield out(rows)
        rows = list(bins.rest())
        if rows:
            yield out(rows)

    schema = SCHEMA if with_tokens else SCHEMA.rpartition(",")[0]
    names = [c.split()[0] for c in SCHEMA.split(", ")]
    source = df.select(F.col(id_col).cast("long").alias("doc_id"), text_bytes(text_col).alias("text"))
    return source.mapInArrow(run, schema)
