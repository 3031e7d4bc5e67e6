"""WARC archives whose records are compressed one by one with a Zstandard dictionary kept in the file.

A file starts with a skippable frame that holds the dictionary; every record after it is a Zstandard frame of its own, so
one record can be read by its offset. Payloads that occur again are written once, as a response; the other records
revisit it and carry headers only.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quayside.llm.common import open_path, replaced, slices
from quayside.session import written

# Fixed values of the file format: the magic number of the dictionary's skippable frame, and the frames' own.
DICTIONARY_MAGIC, FRAME_MAGIC = 0x184D2A5D, b"\x28\xb5\x2f\xfd"
DICTIONARY_BYTES, TRAINING_BYTES = 64 << 10, 4 << 20
EMPTY_DATE = "1970-01-01T00:00:00Z"
URI = "urn:page:"
PARTS = [("page_id", "long"), ("payload_bytes", "long"), ("payload_digest", "string"), ("record_type", "string"), ("refers_to", "long")]


def record(page_id, url, payload: bytes, size: int, digest: str, refers_to=None) -> bytes:
    """One WARC/1.1 record. A revisit has no block; the payload's length is kept in an extension field."""
    kind = "response" if refers_to is None else "revisit"
    block = payload if refers_to is None else b""
    lines = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: <{URI}{'' if page_id is None else page_id}>",
             f"WARC-Date: {EMPTY_DATE}", f"WARC-Payload-Digest: sha1:{digest}", f"Payload-Length: {size}"]
    if url:
        lines.append("WARC-Target-URI: " + "".join(c if c > " " else f"%{ord(c):02X}" for c in url))
    if refers_to is not None:
        lines += [f"WARC-Refers-To: <{URI}{refers_to}>",
                  "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"]
    lines += ["Content-Type: text/html; charset=utf-8", f"Content-Length: {len(block)}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse(data: bytes) -> tuple[dict[str, str], bytes]:
    """(headers, block) of one record."""
    head, found, rest = data.partition(b"\r\n\r\n")
    version, *lines = head.decode().split("\r\n")
    if not found or not version.startswith("WARC/"):
        raise ValueError("no WARC record")
    headers = dict(line.split(": ", 1) for line in lines)
    n = int(headers["Content-Length"])
    if rest[n:] != b"\r\n\r\n":
        raise ValueError("the record's block does not end where it says")
    return headers, rest[:n]


def dictionary_from(records: list[bytes]) -> bytes:
    """Trained on at most ``TRAINING_BYTES`` of the file's own records, taken at even distances; it affects sizes, not
    contents. Records too few or too alike to train on give none."""
    import zstandard

    step = max(1, sum(map(len, records)) // TRAINING_BYTES)
    samples = [r[:TRAINING_BYTES // 16] for r in records[::step] if r]
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, samples, d=8, k=512).as_bytes()
    except (zstandard.ZstdError, ValueError):
        return b""


def write_file(path: str, records: list[bytes]) -> int:
    """Writes one archive and returns its size."""
    import zstandard

    dictionary = dictionary_from(records)
    use = {"dict_data": zstandard.ZstdCompressionDict(dictionary)} if dictionary else {}
    pack, size = zstandard.ZstdCompressor(level=3, write_checksum=True, **use).compress, 8
    with replaced(path) as out:
        # The dictionary itself is stored compressed, as the format allows.
        frame = zstandard.ZstdCompressor(level=9).compress(dictionary)
        out.write(struct.pack("<II", DICTIONARY_MAGIC, len(frame)) + frame)
        size += len(frame)
        for r in records:
            frame = pack(r)
            out.write(frame)
            size += len(frame)
    return size


def read_file(path: str) -> Iterator[bytes]:
    """The records of an archive in order; memory holds one piece of the file and one record."""
    import zstandard

    fs, place = open_path(path)
    with fs.open_input_stream(place, compression=None) as f:
        magic, size = struct.unpack("<II", f.read(8))
        if magic != DICTIONARY_MAGIC:
            raise ValueError(f"{path} does not start with a dictionary")
        raw = f.read(size)
        dictionary = zstandard.ZstdDecompressor().decompress(raw) if raw[:4] == FRAME_MAGIC else raw
        use = {"dict_data": zstandard.ZstdCompressionDict(dictionary)} if dictionary else {}
        reader = zstandard.ZstdDecompressor(**use)
        data = f.read(1 << 20)
        while data:
            one, parts = reader.decompressobj(), []
            while not one.eof:
                if not data:
                    raise ValueError(f"{path} is cut short")
                parts.append(one.decompress(data))
                data = one.unused_data or (b"" if one.eof else f.read(1 << 20))
            data = data or f.read(1 << 20)
            yield b"".join(parts)


def base32(digest_hex: Column) -> Column:
    """Upper-case base32 of a SHA-1 in hex, in eight groups of 20 bits."""
    alphabet = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
    letters = []
    for group in range(8):
        bits = F.conv(F.substring(digest_hex, group * 5 + 1, 5), 16, 10).cast("int")
        for shift in (15, 10, 5, 0):
            letters.append(F.substring(F.lit(alphabet), F.shiftright(bits, shift).bitwiseAND(31) + 1, F.lit(1)))
    return F.concat(*letters)


def with_types(df: DataFrame, id_col: str, url_col: str | None, payload_col: str, least: int) -> DataFrame:
    """page_id, url, payload, size, digest, refers_to: null for responses, else the page that holds the payload.

    Pages are grouped by digest and size in narrow rows. The join takes payloads to their groups' answer, which has one
    row per group, so the adaptive join splits a payload that is very frequent.
    """
    payload = F.coalesce(F.col(payload_col).cast("binary"), F.lit("").cast("binary"))
    url = F.col(url_col).cast("string") if url_col else F.lit(None).cast("string")
    pages = df.select(F.col(id_col).cast("long").alias("page_id"), url.alias("url"), payload.alias("payload"))
    pages = pages.withColumn("size", F.octet_length("payload").cast("long")).withColumn("sha", F.sha1("payload"))
    groups = pages.filter(F.col("size") >= least).groupBy("sha", "size").agg(
        F.max("page_id").alias("last"), F.count("*").alias("rows")).filter("rows > 1").drop("rows")
    groups = written(groups, "payloads")
    return pages.join(groups, ["sha", "size"], "left").select(
        "page_id", "url", F.when(F.col("last") != F.col("page_id"), F.lit(b"").cast("binary")).otherwise(F.col("payload")).alias("payload"),
        "size", base32(F.col("sha")).alias("digest"),
        F.when(~F.col("page_id").eqNullSafe(F.col("last")), F.col("last")).alias("refers_to"))


def write(df: DataFrame, folder: str, id_col: str = "page_id", url_col: str | None = "url", payload_col: str = "html",
          least: int = 0, file_bytes: int = 32 << 20) -> DataFrame:
    """Writes the archives and returns the written list of them: path, records, bytes.

    Of records with equal payloads of at least ``least`` bytes the one with the largest id is the response. A null payload
    is empty. Null ids never answer for others where an id is there; if a group has only null ids, and where rows
    repeat the id that answers, all of those are responses. Other columns are left out. A file holds up to
    ``file_bytes`` of records, or one longer record. An empty table gives no file.
    """
    def run(batches):
        import pyarrow as pa
        from pyspark import TaskContext

        # Rows may come in another order when a task runs again, so each attempt has files of its own; those of the
        # attempt that counts are listed.
        task = f"{TaskContext.get().partitionId():06d}-{TaskContext.get().taskAttemptId()}"
        held, held_bytes, done = [], 0, []

        def close():
            path = f"{folder}/part-{task}-{len(done):05d}.warc.zst"
            done.append((path, len(held), write_file(path, held)))

        for whole in batches:
            for batch in slices(whole, 4 << 20, "payload"):
                for row in zip(*(batch.column(c).to_pylist() for c in ("page_id", "url", "payload", "size", "digest", "refers_to"))):
                    held.append(record(*row))
                    held_bytes += len(held[-1])
                    if held_bytes >= file_bytes:
                        close()
                        held, held_bytes = [], 0
        if held:
            close()
        if done:
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*done)], ["path", "records", "bytes"])

    typed = with_types(df, id_col, url_col, payload_col, least)
    return written(typed.mapInArrow(run, "path string, records long, bytes long"), "archives")


def read(archives: DataFrame, with_payload: bool = True) -> DataFrame:
    """The records of the archives that ``write`` returned: page_id, payload_bytes, payload_digest, record_type,
    refers_to, and the payload (null for revisits). A response whose payload is not what its digest says fails."""
    def run(batches):
        import base64
        import hashlib

        import pyarrow as pa

        def number(uri):
            return int(uri[len(URI) + 1:-1]) if uri[len(URI) + 1:-1] else None

        def out(rows):
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names)

        types = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.binary()][:len(names)]
        for batch in batches:
            for path in batch.column("path").to_pylist():
                rows, size = [], 0
                for data in read_file(path):
                    headers, block = parse(data)
                    digest, kind = headers["WARC-Payload-Digest"].removeprefix("sha1:"), headers["WARC-Type"]
                    if kind == "response" and base64.b32encode(hashlib.sha1(block).digest()).decode() != digest:
                        raise ValueError(f"{path} has a damaged payload")
                    refers = number(headers["WARC-Refers-To"]) if kind == "revisit" else None
                    row = [number(headers["WARC-Record-ID"]), int(headers["Payload-Length"]), digest, kind, refers]
                    rows.append(row + [block if kind == "response" else None] * with_payload)
                    size += len(block) if with_payload else 0
                    if len(rows) == 2000 or size > 8 << 20:
                        yield out(rows)
                        rows, size = [], 0
                if rows:
                    yield out(rows)

    names = [n for n, _ in PARTS] + ["payload"] * with_payload
    schema = ", ".join(f"{n} {t}" for n, t in PARTS) + ", payload binary" * with_payload
    count = archives.count()
    if not count:
        return archives.sparkSession.createDataFrame([], schema)
    return archives.select("path").repartition(count, "path").mapInArrow(run, schema)
