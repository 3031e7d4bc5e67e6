"""Repeated byte strings of a threshold length, by a depth-limited radix sort of suffixes.

A suffix matters only through its first ``threshold`` bytes. It is ordered most significant digit first, and a group
that holds suffixes of one document only is left as it is; groups equal through the last digit are exactly the
repeated windows. The digits:

1. The *anchor* of a window: the 16-byte string in it with the smallest hash. Equal windows have equal anchors at
   equal places, and the windows that share an anchor occurrence follow each other, so they travel as one
   row, a *run* (some 18 windows). This pass deals runs to buckets by their anchor. Of equal whole runs
   in one slice of the input only those of the smallest document are sent; the others are settled there.
2. The whole run: of equal runs the smallest document owns all windows. A run whose anchor no other
   document has is settled too.
3. The bytes: what is left are runs with equal anchors and different surroundings. Their windows are ordered by
   eight bytes at a time. Where very many runs share an anchor, each window is dealt on its own.

Documents are dealt to blocks by a hash; answers for them return to their block.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quayside.llm.common import drop, free_shuffles, slices, text_bytes, tidy, total_bytes
from quayside.session import written

ANCHOR, SLICE, CHUNK, PIECE = 16, 4 << 20, 256 << 10, 1 << 20
BUCKET_BYTES, BLOCK_BYTES, MANY = 4 << 20, 2 << 20, 4096
NULL_LAST = (1 << 63) - 1
SETTLED, OPEN, SPREAD = 1, 2, 3
#: Repeated ids that are broadcast.
MOST_REPEATED = 100_000
MULTIPLIER, POWER, MIX = 0x9E3779B97F4A7C15, 0xD1342543DE82EF95, 0xBF58476D1CE4E5B9
RUN = [("h", "<u4"), ("h2", "<u2"), ("c", "<u4"), ("c2", "<u2"), ("doc", "<i8"), ("tag", "<i8"), ("lo", "<u4"), ("n", "<u2")]
NARROW = [(n, "<u4" if n == "doc" else t) for n, t in RUN]
MARK = [("doc", "<i8"), ("tag", "<i8"), ("lo", "<u4"), ("n", "<u4"), ("h", "<u4")]


class Hasher:
    """Anchors and hashes of the windows of a piece of text."""

    def __init__(self, threshold: int):
        import numpy as np

        self.t = threshold
        self.k = min(ANCHOR, (threshold + 1) // 2)
        rng = np.random.default_rng(50)
        self.byte = rng.integers(1, 1 << 64, 256, dtype=np.uint64) | np.uint64(1)
        self.other = rng.integers(1, 1 << 64, 256, dtype=np.uint64)
        inverse = pow(POWER, -1, 1 << 64)
        n = PIECE + 1
        self.up, self.down = np.full(n, POWER, np.uint64), np.full(n, inverse, np.uint64)
        self.up[0] = self.down[0] = 1
        self.up, self.down = np.cumprod(self.up), np.cumprod(self.down)

    def anchors(self, a):
        """Mixed hashes of all k-byte strings."""
        import numpy as np

        h, have = self.byte[a], 1
        while have < self.k:
            step = min(have, self.k - have)
            # h[i] covers ``have`` bytes; the last ``step`` of what is added are new, the others count twice.
            h = h[:-step] * np.uint64(pow(MULTIPLIER, step, 1 << 64)) + h[step:]
            have += step
        h ^= h >> np.uint64(29)
        h *= np.uint64(MIX)
        h ^= h >> np.uint64(32)
        return h

    def runs(self, a, ends):
        """(first window, number of windows, 48-bit hash of the anchor, of the run) of the pieces that end at ``ends``."""
        import numpy as np

        t, w = self.t, self.t - self.k + 1
        none = np.empty(0, np.int64)
        if len(a) < t:
            return none, none, none.astype(np.uint64), none.astype(np.uint64)
        h = self.anchors(a)
        place = np.uint64((1 << 20) - 1)
        low = (h & ~place) | np.arange(len(h), dtype=np.uint64)
        have = 1
        while have < w:
            step = min(have, w - have)
            low = np.minimum(low[:-step], low[step:])
            have += step
        end_of = np.repeat(ends, np.diff(ends, prepend=0))[:len(low)]
        at = np.flatnonzero(np.arange(t, len(low) + t) <= end_of)
        if not len(at):
            return none, none, none.astype(np.uint64), none.astype(np.uint64)
        q = (low[at] & place).astype(np.int64)
        new = np.flatnonzero((q[1:] != q[:-1]) | (at[1:] != at[:-1] + 1)) + 1
        first = np.concatenate([[0], new])
        n = np.diff(np.concatenate([first, [len(at)]]))
        lo = at[first]
        sums = np.zeros(len(a) + 1, np.uint64)
        np.cumsum(self.other[a] * self.down[:len(a)], out=sums[1:])
        c = (sums[lo + n + t - 1] - sums[lo]) * self.up[lo] + n.astype(np.uint64) * np.uint64(MULTIPLIER)
        c = (c ^ (c >> np.uint64(31))) * np.uint64(MIX)
        c += ((q[first] - lo).astype(np.uint64) + np.uint64(1)) * np.uint64(POWER)
        # An anchor's hash is the smallest of many, so most lie close to 0; mixed once more they fill all buckets alike.
        key = (h[q[first]] ^ (h[q[first]] >> np.uint64(29))) * np.uint64(MULTIPLIER)
        return lo, n, (key ^ (key >> np.uint64(32))) >> np.uint64(16), (c ^ (c >> np.uint64(29))) >> np.uint64(16)


def chunks(texts: list[bytes], threshold: int) -> Iterator[tuple[list[tuple[int, int]], list[bytes]]]:
    """Groups of pieces of some CHUNK bytes: ((document, where the piece starts) ..., the pieces).

    Pieces of a very long text overlap by threshold - 1 bytes, so each window is in one piece.
    """
    names, parts, size = [], [], 0
    step = PIECE - threshold
    for i, text in enumerate(texts):
        for at in range(0, max(1, len(text) - threshold + 1), step):
            part = text if len(text) <= PIECE else text[at:at + step + threshold - 1]
            if names and size + len(part) > CHUNK:
                yield names, parts
                names, parts, size = [], [], 0
            names.append((i, at))
            parts.append(part)
            size += len(part)
            if len(text) <= PIECE:
                break
    if names:
        yield names, parts


def group_starts(*keys):
    """Where a new group starts in sorted arrays."""
    import numpy as np

    new = np.ones(len(keys[0]), bool)
    if len(new) > 1:
        new[1:] = np.logical_or.reduce([k[1:] != k[:-1] for k in keys])
    return np.flatnonzero(new), np.cumsum(new) - 1


def marks_by_block(doc, tag, lo, n, h, kind, blocks: int):
    """Rows (route, kind, rows) with the marks of one block and kind each."""
    import numpy as np
    import pyarrow as pa

    block = block_of(doc, tag, blocks)
    order = np.lexsort((lo, tag, doc, kind, block))
    rows = np.empty(len(order), MARK)
    for name, values in (("doc", doc), ("tag", tag), ("lo", lo), ("n", n), ("h", h)):
        rows[name] = values[order]
    block, kind = block[order], kind[order]
    starts, _ = group_starts(block, kind)
    ends = np.append(starts[1:], len(order))
    return pa.RecordBatch.from_arrays([
        pa.array(block[starts].astype(np.int32)), pa.array(kind[starts].astype(np.int32)),
        pa.array([rows[s:e].tobytes() for s, e in zip(starts.tolist(), ends.tolist())], pa.binary())], ["block", "kind", "rows"])


def packed(rows) -> bytes:
    """Rows byte plane by byte plane, compressed: what neighbours have in common takes no room."""
    import numpy as np
    import zstandard

    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(rows).view(np.uint8).reshape(len(rows), -1).T.tobytes())


def unpacked(data: bytes, kind: list):
    import numpy as np
    import zstandard

    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint8).reshape(np.dtype(kind).itemsize, -1)
    return np.ascontiguousarray(planes.T).view(kind).reshape(-1)


def block_of(doc, tag, blocks: int):
    """The block of a document; ``block_column`` is the same for Spark."""
    return (doc.astype("int64") % blocks + tag.astype("int64") % blocks) % blocks


def block_column(blocks: int):
    return ((F.pmod("doc", F.lit(blocks)) + F.pmod("tag", F.lit(blocks))) % blocks).cast("int")


def by_group(fn, names: list[str], types: list[str], pairs: bool = False):
    """Makes a function of one group's record batches (or of two that belong together) one of its tables."""
    def made(key, *tables):
        import pyarrow as pa

        schema = pa.schema(zip(names, map(pa.type_for_alias, types)))
        tidy()
        return pa.Table.from_batches([b.cast(schema) for b in fn(key, *(t.to_batches() for t in tables))], schema)

    def one(key, table):
        return made(key, table)

    def two(key, left, right):
        return made(key, left, right)

    return two if pairs else one


MARK_SCHEMA = "block int, kind int, rows binary"
MARK_TYPES = ["block", "kind", "rows"], ["int32", "int32", "binary"]


def repeats(df: DataFrame, threshold: int = 50, id_col: str = "doc_id", text_col: str = "text",
            with_text: bool = True, with_hash: bool = False) -> DataFrame:
    """One row per row of ``df``: doc_id, n_bytes, n_removed, n_spans, kept_sha256, and unless ``with_text`` is
    off spans (start, end of each removed run of bytes) and kept (the other bytes, concatenated). ``with_hash`` adds
    text_sha256, of the text as it came in.

    Removed is every byte of a ``threshold``-byte string that also starts in a document with a smaller id, judged on the
    texts as they come in. A null text is empty; texts shorter than the threshold lose nothing. Null ids come
    last and are no smaller than each other; rows that repeat an id do not mark each other, and each of them is
    returned. Other columns are left out. An empty table gives no rows.
    """
    spark = df.sparkSession
    total = total_bytes(df, text_col)
    buckets, blocks = total // BUCKET_BYTES + 1, total // BLOCK_BYTES + 1
    docs = df.select(F.col(id_col).cast("long").alias("doc_id"), text_bytes(text_col).alias("text"))
    docs = tagged(docs.select(F.coalesce("doc_id", F.lit(NULL_LAST)).alias("doc"), F.col("doc_id").isNull().alias("no_id"), "text"))

    # Pass 1: runs to the buckets of their anchors; what a slice settles alone goes along to its block.
    def send(batches):
        import numpy as np
        import pyarrow as pa

        hasher = Hasher(threshold)
        for whole in batches:
            for batch in slices(whole, SLICE):
                doc, tag = batch.column("doc").to_numpy(), batch.column("tag").to_numpy()
                found = []
                for names, parts in chunks(batch.column("text").to_pylist(), threshold):
                    ends = np.cumsum([len(p) for p in parts])
                    lo, n, h, c = hasher.runs(np.frombuffer(b"".join(parts), np.uint8), ends)
                    piece = np.searchsorted(ends, lo, "right")
                    which, shift = np.array(names, np.int64).T
                    found.append((which[piece], lo - (ends - [len(p) for p in parts])[piece] + shift[piece], n, h, c))
                i, lo, n, h, c = (np.concatenate(x) for x in zip(*found))
                d, g = doc[i], tag[i]
                order = np.lexsort((d, c, h))
                i, lo, n, h, c, d, g = (x[order] for x in (i, lo, n, h, c, d, g))
                if not len(h):
                    continue
                starts, group = group_starts(h, c)
                mine = d == d[starts][group]
                out = []
                if not mine.all():
                    o = ~mine
                    zero = np.zeros(o.sum(), np.int64)
                    local = marks_by_block(d[o], g[o], lo[o], n[o], zero, zero + SETTLED, blocks)
                    out = [(buckets + b, -1, r) for b, r in zip(local.column("block").to_pylist(), local.column("rows").to_pylist())]
                lo, n, h, c, d, g = (x[mine] for x in (lo, n, h, c, d, g))
                wide = int(d.max() >= 1 << 32 or d.min() < 0)
                rows = np.empty(len(h), RUN if wide else NARROW)
                rows["h"], rows["h2"] = h >> np.uint64(16), h & np.uint64(0xFFFF)
                rows["c"], rows["c2"] = c >> np.uint64(16), c & np.uint64(0xFFFF)
                for name, values in (("doc", d), ("tag", g), ("lo", lo), ("n", n)):
                    rows[name] = values
                bucket = bucket_of(h, buckets)
                starts, _ = group_starts(bucket)
                for s, e in zip(starts.tolist(), [*starts[1:].tolist(), len(rows)]):
                    out.append((int(bucket[s]), wide, packed(rows[s:e])))
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(
                    zip(*out), (pa.int32(), pa.int32(), pa.binary()))], ["route", "wide", "rows"])

    # Pass 2, by bucket: settle equal runs and lonely anchors.
    def settle(key, batches):
        import numpy as np
        import pyarrow as pa

        route = key[0].as_py()
        got = [(w, r) for b in batches for w, r in zip(b.column("wide").to_pylist(), b.column("rows").to_pylist())]
        if route >= buckets:
            yield pa.RecordBatch.from_pydict({"block": pa.array([route - buckets] * len(got), pa.int32()), "kind": pa.array([SETTLED] * len(got), pa.int32()),
                                              "rows": pa.array([r for _, r in got], pa.binary())})
            return
        rows = np.concatenate([unpacked(r, RUN if w else NARROW).astype(RUN) for w, r in got])
        del got
        h = rows["h"].astype(np.uint64) << np.uint64(16) | rows["h2"]
        c = rows["c"].astype(np.uint64) << np.uint64(16) | rows["c2"]
        order = np.lexsort((rows["doc"], c, h))
        h, c, rows = h[order], c[order], rows[order]
        doc = rows["doc"].astype(np.int64)
        starts, anchor = group_starts(h)
        several = (np.minimum.reduceat(doc, starts) < np.maximum.reduceat(doc, starts))[anchor]
        run_starts, run = group_starts(h, c)
        owner = doc == doc[run_starts][run]
        distinct = np.bincount(anchor[run_starts])[anchor]
        kind = np.zeros(len(rows), np.int64)
        kind[~owner] = SETTLED
        kind[owner & several & (distinct > 1)] = OPEN
        kind[owner & several & (distinct > MANY)] = SPREAD
        pick = kind > 0
        if pick.any():
            some = rows[pick]
            yield marks_by_block(some["doc"].astype(np.int64), some["tag"], some["lo"], some["n"], some["h"], kind[pick], blocks)

    # Pass 3, by block: the bytes of runs that are still open, to the buckets of their anchors.
    def fetch(key, docs, marks):
        import numpy as np
        import pyarrow as pa

        rows = {}
        for m in marks:
            for kind, data in zip(m.column("kind").to_pylist(), m.column("rows").to_pylist()):
                for doc, tag, lo, n, h in np.frombuffer(data, MARK).tolist():
                    rows.setdefault((doc, tag), []).append((kind, lo, n, h))
        out: dict[int, list] = {}
        spread: dict[bytes, list] = {}
        for d in docs:
            for doc, tag, text in zip(d.column("doc").to_pylist(), d.column("tag").to_pylist(), d.column("text").to_pylist()):
                for kind, lo, n, h in rows.pop((doc, tag), ()):
                    if kind == OPEN:
                        out.setdefault(h * buckets >> 32, []).append(((doc, tag, lo, n, h), text[lo:lo + n + threshold - 1]))
                    else:
                        for at in range(lo, lo + n):
                            spread.setdefault(text[at:at + threshold], []).append((doc, tag, at, 1, h))
        # Of equal windows in a block only those of its smallest document are sent; the others are settled here.
        late = []
        for window, places in spread.items():
            least = min(p[0] for p in places)
            late += [p for p in places if p[0] > least]
            b = int.from_bytes(hashlib.blake2b(window, digest_size=4).digest(), "little") * buckets >> 32
            out.setdefault(b, []).extend((p, window) for p in places if p[0] == least)
        if late:
            out[buckets + key[0].as_py()] = [(p, b"") for p in late]
        if out:
            yield pa.RecordBatch.from_arrays([
                pa.array(list(out), pa.int32()), pa.array([np.array([x for x, _ in some], MARK).tobytes() for some in out.values()], pa.binary()),
                pa.array([b"".join(x for _, x in some) for some in out.values()], pa.binary())], ["route", "rows", "bytes"])

    # Pass 4, by bucket: order the windows by their bytes.
    def radix(key, batches):
        import numpy as np
        import pyarrow as pa

        if key[0].as_py() >= buckets:
            for batch in batches:
                rows = batch.column("rows")
                yield pa.RecordBatch.from_arrays([pa.array([key[0].as_py() - buckets] * len(rows), pa.int32()),
                                                  pa.array([SETTLED] * len(rows), pa.int32()), rows], ["block", "kind", "rows"])
            return
        parts = [(r, b) for batch in batches for r, b in zip(batch.column("rows").to_pylist(), batch.column("bytes").to_pylist())]
        rows = np.concatenate([np.frombuffer(r, MARK) for r, _ in parts])
        data = np.frombuffer(b"".join(b for _, b in parts), np.uint8)
        n = rows["n"].astype(np.int64)
        begin = np.concatenate([[0], np.cumsum(n + threshold - 1)[:-1]])
        of = np.repeat(np.arange(len(rows), dtype=np.int32), n)
        within = (np.arange(len(of)) - np.repeat(np.concatenate([[0], np.cumsum(n)[:-1]]), n)).astype(np.int32)
        _, rank = np.unique(rows["doc"], return_inverse=True)
        at, first = repeated_windows(data, begin, of, within, rank.astype(np.int32), threshold)
        late = rank[of[at]] > first
        at = np.sort(at[late])
        if not len(at):
            return
        # Neighbouring windows of one run become one mark.
        starts = np.flatnonzero(np.concatenate([[True], (at[1:] != at[:-1] + 1) | (of[at[1:]] != of[at[:-1]])]))
        length = np.diff(np.append(starts, len(at)))
        some, zero = rows[of[at[starts]]], np.zeros(len(starts), np.int64)
        yield marks_by_block(some["doc"].astype(np.int64), some["tag"], some["lo"] + within[at[starts]], length, zero, zero + SETTLED, blocks)

    # Last, by block: what stays of each document.
    def cut(key, docs, marks):
        import numpy as np
        import pyarrow as pa

        marks = marks.to_batches()
        rows = [np.frombuffer(data, MARK) for m in marks for data in m.column("rows").to_pylist()]
        rows = np.concatenate(rows) if rows else np.empty(0, MARK)
        order = np.lexsort((rows["lo"], rows["tag"], rows["doc"]))
        rows = rows[order]
        starts, _ = group_starts(rows["doc"], rows["tag"])
        by = {(int(rows["doc"][s]), int(rows["tag"][s])): (s, e) for s, e in zip(starts.tolist(), [*starts[1:].tolist(), len(rows)])}
        types = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(),
                 pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])), pa.binary()][:7 if with_text else 5] + [pa.string()] * with_hash
        made = []
        for d in docs.to_batches():
            out = []
            for doc, no_id, tag, text in zip(*(d.column(c).to_pylist() for c in ("doc", "no_id", "tag", "text"))):
                s, e = by.get((doc, tag), (0, 0))
                spans = merged(rows["lo"][s:e].astype(np.int64), rows["n"][s:e].astype(np.int64) + threshold - 1)
                kept, last = [], 0
                for a, b in spans:
                    kept.append(text[last:a])
                    last = b
                kept = b"".join([*kept, text[last:]])
                row = (None if no_id else doc, len(text), len(text) - len(kept), len(spans), hashlib.sha256(kept).hexdigest(),
                       [{"start": a, "end": b} for a, b in spans], kept)[:7 if with_text else 5]
                out.append((*row, hashlib.sha256(text).hexdigest()) if with_hash else row)
            if out:
                made.append(pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), types)], names))
        return pa.Table.from_batches(made, pa.schema(zip(names, types)))

    names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "spans", "kept"][:7 if with_text else 5] + ["text_sha256"] * with_hash
    schema = ("doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"
              + ", spans array<struct<start: long, end: long>>, kept binary" * with_text + ", text_sha256 string" * with_hash)
    sent = docs.select("doc", "tag", "text").mapInArrow(send, "route int, wide int, rows binary")
    marks = written(sent.groupBy("route").applyInArrow(
        by_group(settle, *MARK_TYPES), MARK_SCHEMA), "marks")
    free_shuffles(spark)
    blocked = docs.withColumn("block", block_column(blocks))
    opened = marks.filter(F.col("kind") != SETTLED)
    asked = blocked.select("block", "doc", "tag", "text").groupBy("block").cogroup(opened.groupBy("block")).applyInArrow(
        by_group(fetch, ["route", "rows", "bytes"], ["int32", "binary", "binary"], pairs=True), "route int, rows binary, bytes binary")
    more = written(asked.groupBy("route").applyInArrow(by_group(radix, *MARK_TYPES), MARK_SCHEMA), "marks")
    free_shuffles(spark)
    settled = marks.filter(F.col("kind") == SETTLED).union(more)
    done = written(blocked.groupBy("block").cogroup(settled.groupBy("block")).applyInArrow(cut, schema), "cut")
    drop(spark, marks, more)
    free_shuffles(spark)
    return done


def tagged(docs: DataFrame) -> DataFrame:
    """``docs`` (doc, text) with ``tag``, which tells apart different texts of one doc.

    It is 0 where a doc has one row. Where rows repeat it, it is a 64-bit hash of the text, with a seed under which no two
    texts of a doc share one; that is looked up with their MD5. With very many repeated docs all rows are hashed, so that
    what is broadcast stays small.
    """
    repeated = written(docs.groupBy("doc").agg(F.count("*").alias("rows")).filter("rows > 1").select("doc"), "repeated")
    many = repeated.count()
    if not many:
        return docs.withColumn("tag", F.lit(0).cast("long"))
    several = F.lit(True)
    if many <= MOST_REPEATED:
        docs = docs.join(F.broadcast(repeated.withColumn("several", F.lit(True))), "doc", "left")
        several = F.coalesce("several", F.lit(False))
    for seed in range(16):
        rows = docs.withColumn("tag", F.when(several, F.xxhash64(F.lit(seed), "text")).otherwise(F.lit(0).cast("long"))).drop("several")
        text = F.md5("text")
        shared = rows.filter("tag != 0").groupBy("doc", "tag").agg(F.min(text).alias("a"), F.max(text).alias("b")).filter("a != b")
        if shared.isEmpty():
            return rows
    raise RuntimeError("every seed gives two texts of one document id one 64-bit hash")


def bucket_of(h, buckets: int):
    """Buckets by the first 32 bits of a 48-bit hash, in its order."""
    import numpy as np

    return ((h >> np.uint64(16)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int64)


def merged(lo, n) -> list[tuple[int, int]]:
    """Maximal runs of the bytes that sorted intervals cover; intervals that touch make one run."""
    import numpy as np

    if not len(lo):
        return []
    reach = np.maximum.accumulate(lo + n)
    new = np.flatnonzero(lo[1:] > reach[:-1]) + 1
    return list(zip(lo[np.concatenate([[0], new])].tolist(), reach[np.append(new - 1, len(lo) - 1)].tolist()))


def repeated_windows(data, begin, of, within, doc, threshold: int):
    """Most-significant-digit passes over windows: number i starts at ``begin[of[i]] + within[i]`` in document ``doc[of[i]]``.

    Returns the numbers of the windows that another document has too, and the smallest document that has each. Digits
    are gathered for windows that are still open only.
    """
    import numpy as np

    width = min(8, threshold)
    depths = [*range(0, threshold - width, width), threshold - width]
    left = np.arange(len(of), dtype=np.int32)
    group = np.zeros(len(of), np.int32)
    smallest = np.empty(0, np.int64)
    for depth in depths:
        place = begin[of[left]] + within[left] + depth
        d = np.zeros(len(left), np.uint64)
        for i in range(width):
            d = (d << np.uint64(8)) | data[place + i]
        del place
        order = np.lexsort((d, group))
        left, d, group = left[order], d[order], group[order]
        starts, group = group_starts(group, d)
        if not len(starts):
            break
        mine = doc[of[left]]
        low, high = np.minimum.reduceat(mine, starts), np.maximum.reduceat(mine, starts)
        again = (low < high)[group]
        left, group, smallest = left[again], group[again].astype(np.int32), low[group][again]
    return left, smallest
