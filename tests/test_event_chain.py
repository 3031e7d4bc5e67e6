"""Keyed streams over files in and out of time order, in several micro-batches, against their SQL."""

import os
import time

import duckdb
import pyarrow.parquet as pq
import pytest
from compare import connect, rows_of

import __spark_entry__ as entry_points
from quayside.config import HOUR_US
from quayside.operators.machines import GreedyGap
from quayside.plans import live_catalog
from quayside.streaming import timed

DATA = "/root/testdata/sf0.001"
QUERIES, ORACLE = entry_points.queries(), entry_points.oracle_sql()


def dealt(root, parts, mixed):
    """The tables as four files each, in this order of time; with ``mixed`` some rows are in the file after theirs."""
    for name, key, order in (("events", "event_id", "ts"), ("documents", "doc_id", "doc_id")):
        os.makedirs(root / f"{name}.parquet")
        duckdb.sql(f"CREATE OR REPLACE TEMP TABLE t AS SELECT *, ntile(4) OVER (ORDER BY {order}) AS part FROM '{DATA}/{name}.parquet'")
        for n, part in enumerate(parts):
            path = f"{root}/{name}.parquet/{n}.parquet"
            moved = f"({key} % 5 = 0)::INT" if mixed else "0"
            duckdb.sql(f"SELECT * EXCLUDE (part) FROM t WHERE (part + {moved} - 1) % 4 + 1 = {part}").write_parquet(path)
            os.utime(path, (time.time() - 1000 + n * 10,) * 2)
    for name in ("labels",):
        duckdb.sql(f"SELECT * FROM '{DATA}/{name}.parquet'").write_parquet(f"{root}/{name}.parquet")
    return str(root)


@pytest.mark.parametrize("name", ["debounce", "rate_admission", "breaker_verdicts", "lease_grants", "ttl_dedup"])
def test_files_out_of_order(spark, tmp_path, monkeypatch, name):
    folder = dealt(tmp_path / "late", (3, 1, 4, 2), True)
    seen, settled = [], timed.settled
    monkeypatch.setattr(live_catalog, "MICRO_BATCH", 1)  # a file each
    monkeypatch.setattr(timed, "settled", lambda *a: (seen.append(settled(*a)), seen[-1])[1])
    out = QUERIES[f"{name}_stream"](spark, folder)
    want = connect(DATA).sql(ORACLE[f"{name}_stream"])
    assert rows_of(out.columns, [tuple(r) for r in out.collect()]) == rows_of(want.columns, want.fetchall())
    assert len([p for p in seen[0].progress if p["numInputRows"]]) >= 4
    assert name == "ttl_dedup" or seen[0].late.count() > 0  # the documents arrive within one day


def test_chain_equals_batch_with_level_state(spark, tmp_path, monkeypatch):
    folder = dealt(tmp_path / "chain", (1, 2, 3, 4), False)
    monkeypatch.setattr(live_catalog, "MICRO_BATCH", 1)
    kept = []
    admitted = live_catalog.admitted_events
    monkeypatch.setattr(live_catalog, "admitted_events", lambda *a: (kept.append(admitted(*a)), kept[-1])[1])
    out = QUERIES["event_admission_stream"](spark, folder)
    want = connect(folder).sql(ORACLE["event_admission_stream"])
    assert rows_of(out.columns, [tuple(r) for r in out.collect()]) == rows_of(want.columns, want.fetchall())
    progress = [p for p in kept[0][1] if p["stateOperators"]]
    assert len([p for p in progress if p["numInputRows"]]) >= 4
    # Four files went through; what is held at the end of each does not add up, and in the end only verdicts are left.
    debounce, gate, limiter = ([p["stateOperators"][i]["numRowsTotal"] for p in progress] for i in range(3))
    assert max(debounce) < 60 and debounce[-1] <= 1 and limiter[-1] <= 1
    paths = duckdb.sql(f"SELECT count(DISTINCT user_id) FROM '{DATA}/events.parquet'").fetchall()[0][0]
    assert gate[-1] <= paths + 1 and max(gate) <= 4 * paths


def test_late_rows_are_told_apart(spark, tmp_path):
    """Held rows are folded in order; a late row is named, and its key is folded once more."""
    schema, src = "key string, us long, id long", str(tmp_path / "in")
    os.makedirs(src)

    def feed(n, *rows):
        pq.write_table(spark.createDataFrame(rows, schema).toArrow(), f"{src}/{n}.parquet")
        os.utime(f"{src}/{n}.parquet", (time.time() - 1000 + n * 10,) * 2)

    h = HOUR_US
    feed(0, ("a", 20 * h, 1), (None, 20 * h, 2))
    feed(1, ("a", 17 * h, 3), (None, 24 * h, 4))  # out of order, in time
    feed(2, ("a", 40 * h, 5), ("b", 40 * h, 6))
    feed(3, ("b", 39 * h, 8), ("c", 41 * h, 9))
    feed(4, ("a", 15 * h, 7), ("b", None, 10))  # 7 is late, 10 has no time
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(src)
    out = timed.settled(stream, spark.read.schema(schema).parquet(src), ["key"], "us", ["id"], GreedyGap(4 * h), 10 * h,
                        str(tmp_path / "base"))
    assert sorted(r["id"] for r in out.rows.filter("accepted").collect()) == [1, 2, 4, 5, 7, 8, 9]
    assert out.rows.count() == 9 and sorted(r["id"] for r in out.late.collect()) == [7, 10]


def test_a_long_history_is_streamed(spark, tmp_path):
    """One key's rows never meet in a worker as a whole, however many one micro-batch releases."""
    class Bounded(GreedyGap):
        def run(self, state, us, cols):
            if len(us) > 10_000:
                raise ValueError(f"{len(us)} rows at once")
            return super().run(state, us, cols)

    src = str(tmp_path / "in")
    spark.range(25_000).selectExpr("'a' AS key", "(id * 7 % 25000) * 1000000 AS us", "id").write.parquet(src)
    stream = spark.readStream.schema("key string, us long, id long").parquet(src)
    out = timed.settled(stream, spark.read.parquet(src), ["key"], "us", ["id"], Bounded(10_000_000), HOUR_US, str(tmp_path / "base"))
    assert (out.rows.count(), out.rows.filter("accepted").count()) == (25_000, 2_500)


@pytest.mark.parametrize("forget_us,kept", [(None, 4), (10 * HOUR_US, 1)])  # then b starts over
def test_gate_waits_for_samples(spark, tmp_path, forget_us, kept):
    h, schema = HOUR_US, "path string, us long, id long, noticed boolean, size long, mtime long"
    batches = [
        (10, [("a", 1 * h, 1, True, 1, 1), ("a", 2 * h, 2, False, 1, 1), ("b", 3 * h, 3, True, None, 1), ("c", 5 * h, 4, True, 1, 1),
              (None, 6 * h, 5, True, 4, 1)]),
        (20, [("c", 12 * h, 6, True, 2, 1), ("a", 15 * h, 7, True, 9, 9), (None, 11 * h, 8, False, 4, 1)]),
        (40, [("b", 39 * h, 9, False, 1, 1)]),
    ]
    got = []
    for n, (mark, rows) in enumerate(batches):
        df = spark.createDataFrame(rows, schema)
        gate = timed.Gate(spark, str(tmp_path / "gate"), df.schema, "path", "us", "id", "noticed", "size", "mtime", 5, 30 * h, forget_us)
        got.append(sorted((r["id"], r["stable"], r["ready_us"] // h) for r in gate.step(df, mark * h, n).collect()))
    # 3 finds its file gone, 4 and 6 change until the deadline; a verdict holds for files noticed later.
    assert got == [[(1, True, 2), (3, False, 3)], [(5, True, 11), (7, True, 16)], [(4, False, 5), (6, False, 12)]]
    assert gate.size(2) == kept
