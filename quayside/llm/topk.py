"""Exact top-k search by inner product, as tiled matrix products.

Queries are cut into tiles that travel to every shard of candidates, a bounded number of tiles at a time.
A task multiplies each tile with blocks of its shard, keeps the best k of each block, and merges them into
its own best k per query. The lists of the tasks are merged as a tree: first groups of tasks, then all.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quayside.session import written

TILE, BLOCK, WAVE_BYTES, FAN_IN = 1024, 4096, 32 << 20, 32
EXACT = 1 << 52


def usable(df: DataFrame, id_col: str, vector_col: str, scale: float) -> DataFrame:
    """id and vector of floor(scale * x) as doubles, without rows that take no part."""
    vector = F.col(vector_col).cast("array<double>")
    odd = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    rows = df.filter(F.col(id_col).isNotNull() & F.col(vector_col).isNotNull() & ~odd)
    scaled = F.transform(vector, lambda x: F.floor(F.lit(float(scale)) * x).cast("double"))
    return rows.select(F.col(id_col).cast("long").alias("id"), scaled.alias("v"))


def tile_best(scores, ids, own, k: int):
    """For each row of a score matrix the columns of its k best (score falling, id rising); ids must rise.

    Returns (rows, columns). ``own`` is the id that each row may not choose.
    """
    import numpy as np

    n = scores.shape[1]
    banned = own[:, None] == ids[None, :]
    if n > k + 1:
        # The limit is the k-th best score; what ties with it is taken by rising id.
        masked = np.where(banned, scores.min() - 1, scores)
        limit = np.partition(masked, n - k, axis=1)[:, n - k]
        keep = (masked >= limit[:, None]) & ~banned
        ties = keep & (masked == limit[:, None])
        need = k - (keep & ~ties).sum(axis=1)
        keep &= ~ties | (np.cumsum(ties, axis=1) <= need[:, None])
    else:
        keep = ~banned
    return np.nonzero(keep)


def search(df: DataFrame, is_query, k: int = 20, scale: float = 64.0, id_col: str = "vec_id",
           vector_col: str = "embedding") -> DataFrame:
    """For each query row: query_id, rank from 1, vec_id, score; score is the integer inner product.

    ``is_query`` is a condition on the id column. Candidates are all rows with another id, ties go to the smaller id.
    Null ids, null vectors and vectors with null or non-finite components take no part; vectors of different
    lengths are never compared, and empty vectors score 0. A candidate that is there twice counts twice; a query id that
    is there several times is answered once, for its smallest vector. Scores outside 64 bits end at the limits.
    An empty table, or one without queries, gives no rows. Other columns are left out.
    """
    spark = df.sparkSession
    rows = usable(df, id_col, vector_col, scale)
    queries = df.filter(is_query)
    queries = usable(queries, id_col, vector_col, scale).groupBy("id").agg(F.min("v").alias("v"))
    asked = written(queries, "queries")
    sizes = asked.agg(F.count("*").alias("n"), F.sum(8 * F.size("v") + 16).alias("b")).first()
    waves = (sizes["b"] or 0) // WAVE_BYTES + 1
    found = [partial(rows, asked.filter(F.pmod(F.xxhash64("id"), F.lit(waves)) == w), k) for w in range(waves)]
    best = reduce(DataFrame.union, found)
    order = [F.desc("score"), F.asc("vec_id")]
    for keys in (["query_id", "part"], ["query_id"]):
        best = best.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter(F.col("rank") <= k)
    return best.select("query_id", "rank", "vec_id", "score")


def partial(rows: DataFrame, asked: DataFrame, k: int) -> DataFrame:
    """Each task's best k per query. ``asked`` is at most about ``WAVE_BYTES`` of queries, measured before."""
    import numpy as np

    wave = asked.collect()
    by_length: dict[int, list] = {}
    for r in wave:
        by_length.setdefault(len(r["v"]), []).append((r["id"], r["v"]))
    tiles = []
    for length, some in by_length.items():
        some.sort()
        for at in range(0, len(some), TILE):
            part = some[at:at + TILE]
            tiles.append((length, np.array([x[0] for x in part], np.int64), np.array([x[1] for x in part], float).reshape(len(part), length)))
    sent = rows.sparkSession.sparkContext.broadcast(tiles)

    def run(batches):
        import numpy as np
        import pyarrow as pa
        from pyspark import TaskContext

        part = TaskContext.get().partitionId() // FAN_IN
        state: dict = {}

        def blocks():
            for batch in batches:
                lengths = np.diff(batch.column("v").offsets.to_numpy())
                flat = batch.column("v").flatten().to_numpy(zero_copy_only=False)
                starts = np.concatenate([[0], np.cumsum(lengths)]).astype(np.int64)
                ids = batch.column("id").to_numpy()
                for length in np.unique(lengths).tolist():
                    at = np.flatnonzero(lengths == length)
                    for some in np.array_split(at, len(at) // BLOCK + 1):
                        if len(some):
                            yield length, ids[some], flat[starts[some][:, None] + np.arange(length)]

        for length, ids, m in blocks():
            order = np.argsort(ids, kind="stable")
            ids, m = ids[order], m[order]
            for t, (size, asked_ids, q) in enumerate(sent.value):
                if size != length:
                    continue
                scores = product(q, m)
                r, c = tile_best(scores, ids, asked_ids, k)
                mine = state.get(t)
                rr, ii, ss = r, ids[c], scores[r, c]
                if mine is not None:
                    rr, ii, ss = (np.concatenate(x) for x in zip(mine, (rr, ii, ss)))
                by = np.lexsort((ii, -ss, rr))
                rr, ii, ss = rr[by], ii[by], ss[by]
                begin = np.searchsorted(rr, rr)
                top = np.arange(len(rr)) - begin < k
                state[t] = rr[top], ii[top], ss[top]
        for t, (rr, ii, ss) in state.items():
            yield pa.RecordBatch.from_pydict({
                "query_id": sent.value[t][1][rr], "vec_id": ii, "score": ss.astype(np.int64),
                "part": np.full(len(rr), part, np.int32)})

    return rows.mapInArrow(run, "query_id long, vec_id long, score long, part int")


def product(q, m):
    """Inner products without rounding: in doubles if no sum can leave 52 bits, else in whole numbers."""
    import numpy as np

    bound = (np.abs(q).max(initial=0) * np.abs(m).max(initial=0)) * max(1, q.shape[1])
    if bound < EXACT:
        return q @ m.T
    rows = [[int(x) for x in row] for row in m.tolist()]
    limit = (1 << 63) - 1
    return np.array([[max(-limit, min(limit, sum(a * b for a, b in zip(row, other)))) for other in rows]
                     for row in ([int(x) for x in r] for r in q.tolist())], np.int64).reshape(len(q), len(m))
