"""Approximate nearest neighbours by inner product: multi-index hashing of learned binary codes.

Vectors get one more component that brings them all to the length of the longest, so the largest inner product is the
smallest angle. On a bounded sample, principal axes and several rotations are learned that lose least when only signs
are kept; the signs are a code, cut into substrings of 16 bits, each indexed. If two codes of m substrings differ in at
most r = m * a + b bits, one of the first b + 1 substrings differs in at most a, or one of the others in at most a - 1.
So probing every substring that close finds every code within r, and of those the exact inner products are taken.

A query's radius is fixed before the search: a line fitted on the sample tells how far codes of vectors at some angle
lie apart, and the angle is that of the query's k-th best partner within the sample. So it does not depend on how
the table is cut. Tables without close neighbours have large radii, where probing costs as much as a scan.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quayside.llm.common import open_path
from quayside.session import written

#: Rows that rotations and radii are fitted on, those with the smallest hash of id and vector.
FIT_ROWS = 8192
BITS, PIECE = 256, 16
SPREAD = 2.0
ROUNDS = 30
TILE, BLOCK, HELD, FAN_IN = 512, 32768, 1 << 20, 32


@dataclass
class Model:
    """What is learned: length of the longest vector, axes and rotations as one matrix, and how radii follow from angles."""

    length: float
    mean: object
    axes: object
    line: tuple
    sample_ids: object
    sample: object
    sample_codes: object

    def lifted(self, x, query: bool):
        """One more component: what is missing to the greatest length; queries are brought to that length instead."""
        import numpy as np

        norms = np.sqrt((x * x).sum(1))
        if query:
            return np.hstack([x * (self.length / norms)[:, None], np.zeros((len(x), 1))])
        return np.hstack([x, np.sqrt(np.maximum(self.length ** 2 - norms ** 2, 0))[:, None]])

    def codes(self, lifted):
        """Codes as rows of 16-bit substrings."""
        import numpy as np

        return np.packbits((lifted - self.mean) @ self.axes > 0, axis=1, bitorder="little").view(np.uint16)


def distances(a, b):
    """Hamming distances of all rows of ``a`` to all rows of ``b``."""
    import numpy as np

    a, b = a.view(np.uint64), b.view(np.uint64)
    total = np.zeros((len(a), len(b)), np.uint16)
    for j in range(a.shape[1]):
        total += np.bitwise_count(a[:, j, None] ^ b[None, :, j])
    return total


def usable(df: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """id and vector v as doubles, without rows that take no part."""
    vector = F.col(vector_col).cast("array<double>")
    odd = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    rows = df.filter(F.col(id_col).isNotNull() & F.col(vector_col).isNotNull() & ~odd & F.exists(vector, lambda x: x != 0))
    return rows.select(F.col(id_col).cast("long").alias("id"), vector.alias("v"))


def fit(rows: DataFrame, size: int, k: int, bits: int = BITS, sample_rows: int = FIT_ROWS) -> Model:
    """The model for vectors of ``size`` components; their greatest length is taken over all rows."""
    import numpy as np

    rows = rows.filter(F.size("v") == size)
    longest = rows.agg(F.max(F.aggregate("v", F.lit(0.0), lambda s, x: s + x * x))).first()[0]
    picked = rows.orderBy(F.xxhash64("id", "v"), "id").limit(sample_rows).toArrow()
    ids = picked.column("id").to_numpy()
    x = picked.column("v").combine_chunks().flatten().to_numpy().reshape(len(ids), size)
    model = Model(float(np.sqrt(longest)), None, None, None, ids, x, None)
    lifted = model.lifted(x, False)
    model.mean = lifted.mean(0)
    centred = lifted - model.mean
    model.axes = rotations(centred, bits)
    model.sample_codes = model.codes(lifted)
    model.line = radius_line(model, lifted, k)
    return model


def rotations(centred, bits: int):
    """Principal axes times as many learned rotations as ``bits`` ask for, each from a start of its own."""
    import numpy as np

    rng = np.random.default_rng(7)
    _, vectors = np.linalg.eigh(centred.T @ centred)
    axes = vectors[:, ::-1][:, :bits]
    parts = []
    while sum(p.shape[1] for p in parts) < bits:
        flat = centred @ axes
        turn, _ = np.linalg.qr(rng.standard_normal((axes.shape[1], axes.shape[1])))
        for _ in range(ROUNDS):
            u, _, v = np.linalg.svd(np.where(flat @ turn > 0, 1.0, -1.0).T @ flat)
            turn = (u @ v).T
        parts.append(axes @ turn)
    return np.hstack(parts)[:, :bits]


def radius_line(model: Model, lifted, k: int) -> tuple:
    """(a, b, s): codes at angle t lie about a + b t apart, s being the usual error; from near pairs of the sample."""
    import numpy as np

    angles, apart = [], []
    asked = model.lifted(model.sample[:1024], True)
    codes = model.codes(asked)
    for at in range(0, len(asked), TILE):
        cos = np.clip(asked[at:at + TILE] @ lifted.T / model.length ** 2, -1, 1)
        cos[np.arange(len(cos)), np.arange(at, at + len(cos))] = -1
        near = np.argsort(-cos, axis=1)[:, :4 * k]
        rows = np.arange(len(cos))[:, None]
        angles.append(np.arccos(cos[rows, near]).ravel())
        apart.append(distances(codes[at:at + TILE], model.sample_codes)[rows, near].ravel())
    t, d = np.concatenate(angles), np.concatenate(apart).astype(float)
    b, a = np.polyfit(t, d, 1) if np.ptp(t) > 1e-6 else (0.0, d.mean() if len(d) else 0.0)
    return float(a), float(b), float(np.std(d - a - b * t)) if len(d) else 0.0


def radii(model: Model, ids, x, k: int):
    """Each query's code and radius: at least so large that k codes of the sample lie within."""
    import numpy as np

    asked = model.lifted(x, True)
    codes = model.codes(asked)
    cos = np.clip(asked @ model.lifted(model.sample, False).T / model.length ** 2, -1, 1)
    apart = distances(codes, model.sample_codes).astype(np.int32)
    own = ids[:, None] == model.sample_ids[None, :]
    cos[own], apart[own] = -1, apart.max(initial=0) + 1
    at = min(k, cos.shape[1]) - 1
    angle = np.arccos(-np.partition(-cos, at, axis=1)[:, at])
    a, b, s = model.line
    most = 16 * codes.shape[1]
    return codes, np.clip(np.maximum(np.ceil(a + b * angle + SPREAD * s), np.partition(apart, at, axis=1)[:, at]), 0, most).astype(np.int32)


class Index:
    """The codes of one block of rows, findable by each of their substrings."""

    def __init__(self, codes):
        import numpy as np

        self.codes, self.tables = codes, []
        for j in range(codes.shape[1]):
            order = np.argsort(codes[:, j], kind="stable").astype(np.int32)
            values, starts = np.unique(codes[order, j], return_index=True)
            self.tables.append((values, np.append(starts, len(order)), order))

    def within(self, code, radius: int):
        """Rows whose codes differ from ``code`` in at most ``radius`` bits, by rising row."""
        import numpy as np

        m = len(self.tables)
        each, more = divmod(radius, m)
        seen = np.zeros(len(self.codes), bool)
        for j, (values, starts, order) in enumerate(self.tables):
            near = each if j <= more else each - 1
            if near < 0:
                continue
            if ball(near) < len(values):
                at = np.searchsorted(values, probes(near) ^ code[j])
                at[at == len(values)] = 0
                hit = at[values[at] == probes(near) ^ code[j]]
            else:
                hit = np.flatnonzero(np.bitwise_count(values ^ code[j]) <= near)
            if 2 * len(hit) > len(values):
                # So many buckets that the rows are marked by their own substring.
                mark = np.zeros(1 << PIECE, bool)
                mark[values[hit]] = True
                seen |= mark[self.codes[:, j]]
            else:
                first, count = starts[hit], starts[hit + 1] - starts[hit]
                seen[order[np.repeat(first - np.cumsum(count) + count, count) + np.arange(count.sum())]] = True
        rows = np.flatnonzero(seen)
        return rows[distances(code[None, :], self.codes[rows])[0] <= radius]


_PROBES: dict[int, object] = {}


def probes(near: int):
    """All 16-bit numbers with at most ``near`` bits, the fewest bits first."""
    import numpy as np

    if near not in _PROBES:
        every = np.arange(1 << PIECE, dtype=np.uint16)
        _PROBES[near] = every[np.bitwise_count(every) <= near]
    return _PROBES[near]


def ball(near: int) -> int:
    return len(probes(near))


def search(df: DataFrame, is_query, k: int = 20, id_col: str = "vec_id", vector_col: str = "embedding",
           bits: int = BITS, sample_rows: int = FIT_ROWS) -> DataFrame:
    """For each query row: query_id, rank from 1, vec_id, score; the k best of what lies within the query's radius.

    ``is_query`` is a condition on the id column. Candidates are all rows with another id, scores are inner products of
    the original vectors in double precision, ties go to the smaller id. Null ids, null or empty vectors, zero vectors
    and vectors with null or non-finite components take no part; vectors of different lengths are never compared. A
    candidate that is there twice counts twice; a query id that is there several times is answered once, for its
    smallest vector. ``bits`` is a multiple of 64. An empty table, or one without queries, gives no rows. Other columns
    are left out.
    """
    spark = df.sparkSession
    rows = usable(df, id_col, vector_col)
    sizes = [r[0] for r in rows.select(F.size("v").alias("d")).distinct().collect()]
    queries = usable(df.filter(is_query), id_col, vector_col).groupBy("id").agg(F.min("v").alias("v"))
    found = [answers(rows, queries, fit(rows, size, k, bits, sample_rows), size, k) for size in sorted(sizes)]
    if not found:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    best = found[0]
    for more in found[1:]:
        best = best.union(more)
    for by in (["query_id", "part"], ["query_id"]):
        order = Window.partitionBy(*by).orderBy(F.desc("score"), F.asc("vec_id"))
        best = best.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
    return best.select("query_id", "rank", "vec_id", "score")


def answers(rows: DataFrame, queries: DataFrame, model: Model, size: int, k: int) -> DataFrame:
    """Each task's best k per query: it indexes its rows block by block and reads the queries tile by tile from the
    shared folder, so neither the driver nor a task holds more than a tile of them."""
    spark = rows.sparkSession
    sent = spark.sparkContext.broadcast(model)

    def prepared(batches):
        import numpy as np
        import pyarrow as pa

        for batch in batches:
            for at in range(0, batch.num_rows, TILE):
                part = batch.slice(at, TILE)
                ids = part.column("id").to_numpy()
                x = part.column("v").flatten().to_numpy().reshape(len(ids), size)
                codes, radius = radii(sent.value, ids, x, k)
                yield pa.RecordBatch.from_pydict({
                    "id": part.column("id"), "v": part.column("v"), "radius": pa.array(radius),
                    "code": pa.array([c.tobytes() for c in codes], pa.binary())})

    asked = queries.filter(F.size("v") == size).mapInArrow(prepared, "id long, v array<double>, radius int, code binary")
    files = sorted(written(asked, "queries").inputFiles())

    def run(batches):
        import numpy as np
        import pyarrow as pa
        from pyspark import TaskContext

        part = TaskContext.get().partitionId() // FAN_IN
        best, held = {}, 0
        for ids, x in blocks(batches, size):
            index = Index(sent.value.codes(sent.value.lifted(x, False)))
            for name, q, v, codes, radius in tiles(files, size):
                mine = best.get(name)
                now = merged(mine, matches(index, ids, x, q, v, codes, radius, k), k)
                held += len(now[0]) - (len(mine[0]) if mine else 0)
                best[name] = now
                if held > HELD:
                    yield from lists(best, part)
                    best, held = {}, 0
        yield from lists(best, part)

    return rows.filter(F.size("v") == size).mapInArrow(run, "query_id long, vec_id long, score double, part int")


def blocks(batches, size: int):
    """(ids, vectors) of at most about ``BLOCK`` rows, ids rising."""
    import numpy as np

    def block():
        ids = np.concatenate([b.column("id").to_numpy() for b in some])
        x = np.concatenate([b.column("v").flatten().to_numpy() for b in some]).reshape(len(ids), size)
        order = np.argsort(ids, kind="stable")
        return ids[order], x[order]

    some, n = [], 0
    for batch in batches:
        some.append(batch)
        n += batch.num_rows
        if n >= BLOCK:
            yield block()
            some, n = [], 0
    if n:
        yield block()


def tiles(files: list, size: int):
    """(name, ids, vectors, codes, radii) of the written queries, a tile at a time."""
    import numpy as np
    import pyarrow.parquet as pq

    for file in files:
        fs, place = open_path(file)
        with fs.open_input_file(place) as source:
            for t, batch in enumerate(pq.ParquetFile(source).iter_batches(TILE)):
                n = batch.num_rows
                yield ((file, t), batch.column("id").to_numpy(), batch.column("v").flatten().to_numpy().reshape(n, size),
                       np.frombuffer(b"".join(batch.column("code").to_pylist()), np.uint16).reshape(n, -1),
                       batch.column("radius").to_numpy())


def matches(index: Index, ids, x, q, v, codes, radius, k: int):
    """(query ids, row ids, scores): the best k per query of what lies within its radius; row ids must rise."""
    import numpy as np

    out = [], [], []
    for i in range(len(q)):
        near = index.within(codes[i], int(radius[i]))
        near = near[ids[near] != q[i]]
        scores = (x[near] * v[i]).sum(1)
        if len(near) > k:
            limit = np.partition(scores, len(near) - k)[len(near) - k]
            some = np.flatnonzero(scores >= limit)
            some = some[np.lexsort((ids[near[some]], -scores[some]))[:k]]
            near, scores = near[some], scores[some]
        out[0].append(np.full(len(near), q[i]))
        out[1].append(ids[near])
        out[2].append(scores)
    return tuple(np.concatenate(c) for c in out)


def merged(a, b, k: int):
    """The best k per query of two lists of matches."""
    import numpy as np

    if a is not None:
        b = tuple(np.concatenate(c) for c in zip(a, b))
    order = np.lexsort((b[1], -b[2], b[0]))
    b = tuple(c[order] for c in b)
    top = np.arange(len(order)) - np.searchsorted(b[0], b[0]) < k
    return tuple(c[top] for c in b)


def lists(best: dict, part: int):
    import numpy as np
    import pyarrow as pa

    for q, ids, scores in best.values():
        yield pa.RecordBatch.from_pydict({"query_id": q, "vec_id": ids, "score": scores, "part": np.full(len(q), part, np.int32)})
