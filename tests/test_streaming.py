"""Streams in several micro-batches against the batch result, restarts, and the landing job."""

import hashlib
import os
import random
import time

import numpy as np
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from quayside.config import AdmissionConfig
from quayside.operators import ledger
from quayside.operators.machines import Breaker, GreedyGap, TokenBucket
from quayside.sinks import messages
from quayside.sources import landing
from quayside.streaming import live, pipeline, timed

SCHEMA = "key string, us long, id long, flag boolean"


def feed(spark, folder, slices):
    """One file per slice with rising modification times, so that slices arrive in order."""
    os.makedirs(folder, exist_ok=True)
    first = len(os.listdir(folder))
    for n, rows in enumerate(slices, start=first):
        pq.write_table(spark.createDataFrame(rows, SCHEMA).toArrow(), f"{folder}/part{n}.parquet")
        at = time.time() - 1000 + n * 10
        os.utime(f"{folder}/part{n}.parquet", (at, at))


@pytest.fixture(scope="module")
def rows():
    rnd, out, us = random.Random(11), [], 1_704_067_200_000_000
    for i in range(400):
        us += rnd.choice([1, 2, 5, 30])
        out.append((rnd.choice(["hot", "hot", "a", "b", f"k{rnd.randrange(9)}"]), us, i, rnd.random() < 0.4))
    return out


@pytest.mark.parametrize("machine", [GreedyGap(25), GreedyGap(25, "flag"), TokenBucket(1, 12, 2), Breaker(2, 20, "flag")],
                         ids=["debounce", "lease", "rate", "breaker"])
def test_stream_equals_batch_over_restarts(spark, tmp_path, rows, machine):
    """Stopped after two files and started again; rows come out of order within the delay."""
    src, out, check = (str(tmp_path / x) for x in ("in", "out", "check"))

    def run():
        stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(src)
        folded = timed.fold(timed.watermarked(stream, "us", 60_000_000), ["key"], "us", ["id"], machine)
        return live.run_available(folded, out, check)

    # Milliseconds between rows, so that the watermark moves.
    slow = type(machine)(*[x * 1_000_000 if isinstance(x, int) and i == (1 if isinstance(machine, (TokenBucket, Breaker)) else 0) else x
                           for i, x in enumerate(_arguments(machine))])
    timed_rows = [(k, us0 + (us - us0) * 1_000_000, i, f) for us0 in [rows[0][1]] for k, us, i, f in rows]
    machine = slow
    mixed = [timed_rows[n ^ 1] for n in range(len(timed_rows))]
    feed(spark, src, [mixed[:100], mixed[100:180]])
    run()
    feed(spark, src, [mixed[180:300], mixed[300:], [("end", timed_rows[-1][1] + 10**12, -1, False)], [("end", timed_rows[-1][1] + 2 * 10**12, -2, False)]])
    run()
    got = {r["id"]: r.asDict() for r in spark.read.parquet(out).collect()}
    assert len([i for i in got if i >= 0]) == len(rows)
    for key in {r[0] for r in rows}:
        mine = [r for r in timed_rows if r[0] == key]
        want, _ = machine.run(None, np.array([r[1] for r in mine]), {"flag": np.array([r[3] for r in mine])})
        for name, values in want.items():
            assert [got[r[2]][name] for r in mine] == list(values), (key, name)


def _arguments(machine):
    if isinstance(machine, GreedyGap):
        return machine.gap, machine.release
    if isinstance(machine, TokenBucket):
        return machine.rate, machine.cost, machine.cap // machine.cost
    return machine.max, machine.reset, machine.ok


def test_state_is_forgotten_when_it_has_run_out(spark, tmp_path):
    second = 1_000_000
    base = 1_704_067_200 * second
    src = str(tmp_path / "in")
    feed(spark, src, [[("a", base, 1, True)], [("b", base + 60 * second, 2, True)], [("b", base + 120 * second, 3, True)],
                      [("a", base + 121 * second, 4, True)], [("c", base + 900 * second, 5, True)]])
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(src)
    folded = timed.fold(timed.watermarked(stream, "us", 0), ["key"], "us", ["id"], GreedyGap(10 * second))
    q = live.run_available(folded.filter("accepted"), str(tmp_path / "out"), str(tmp_path / "check"))
    assert {r["id"] for r in spark.read.parquet(str(tmp_path / "out")).collect()} == {1, 2, 3, 4, 5}
    # Nothing but the last key's state is left of five rows.
    assert q.recentProgress[-1]["stateOperators"][0]["numRowsTotal"] <= 2


def test_windows_with_late_rows(spark, tmp_path, rows):
    src = str(tmp_path / "in")
    hour = 3_600_000_000
    spread = [(k, 1_704_067_200_000_000 + n * 600_000_000, i, f) for n, (k, _, i, f) in enumerate(rows)]
    feed(spark, src, [spread[:75], spread[150:300] + [("none", None, 900, True)], spread[75:150] + spread[300:]])
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(src)
    w = live.Windows(stream, "us", hour, {"yes": F.col("flag"), "no": ~F.col("flag")}, 2 * hour, str(tmp_path / "base"))
    w.run()
    got = {r["window_us"]: (r["yes"], r["no"]) for r in w.rows(spark).collect()}
    want = {}
    for _, us, _, flag in spread:
        at = want.setdefault(us // hour * hour, [0, 0])
        at[not flag] += 1
    assert got == {k: tuple(v) for k, v in want.items()}
    newest = max(r[1] for r in spread[150:300]) - 2 * hour
    late = {(r["id"], r["batch"]) for r in w.late(spark).collect()}
    assert late == {(900, 1)} | {(r[2], 2) for r in spread[75:150] if r[1] // hour * hour + hour <= newest} and len(late) > 50
    assert spark.read.parquet(str(tmp_path / "base/open")).groupBy("batch").count().agg(F.max("count")).first()[0] <= 15
    feed(spark, src, [[("x", 1_704_067_200_000_000, 901, True)]])
    w.run()
    assert w.late(spark).filter("id = 901").count() == 1


def test_observed_counters(spark, tmp_path, rows):
    src = str(tmp_path / "in")
    feed(spark, src, [rows[:100], rows[100:250], rows[250:]])
    log = live.CounterLog("landing")
    spark.streams.addListener(log)
    try:
        stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(src)
        counted = live.observed(stream, "landing", {"good": F.col("flag"), "bad": ~F.col("flag")})
        live.run_available(counted, str(tmp_path / "out"), str(tmp_path / "check"))
        deadline = time.time() + 20
        while log.batches < 3 and time.time() < deadline:
            time.sleep(0.2)
    finally:
        spark.streams.removeListener(log)
    good = sum(r[3] for r in rows)
    assert log.batches == 3 and log.totals == {"good": good, "bad": len(rows) - good}


XML = b"<cargo><crate no='%d'/></cargo>"


def put(root, name, body, at):
    path = os.path.join(root, name)
    os.makedirs(os.path.dirname(path), exist_ok=True)
    with open(path, "wb") as f:
        f.write(body)
    os.utime(path, (at, at))


def test_landing_job_replays_without_doubling(spark, tmp_path):
    root, out, check = (str(tmp_path / x) for x in ("incoming", "out", "check"))
    start = time.time() - 1000
    book = ledger.ParquetLedger(spark, str(tmp_path / "ledger"))
    book.append(spark.createDataFrame(
        [(hashlib.sha256(b"done.xml" + XML % 3).hexdigest(), "processed", None, None, int(start * 1e6))],
        book.COLUMNS), "done-0")
    put(root, "one.xml", XML % 1, start)
    put(root, "sub/two.xml", XML % 2, start + 10)
    put(root, "sub/done.xml", XML % 3, start + 20)
    put(root, "note.txt", b"some text", start + 30)
    cfg = AdmissionConfig(roots=(root,), min_bytes=5)
    crash = {"left": 1}

    def hook(outcomes, batch_id):
        if batch_id == 1 and crash["left"]:
            crash["left"] -= 1
            raise RuntimeError("lost on the way")

    job = pipeline.LandingPipeline(spark, cfg, out, book, messages.FileSink(str(tmp_path / "queue"), "json"), hook)
    def run():
        q = job.start(landing.stream(spark, root, max_files=2).drop("content"), check)
        q.awaitTermination()
    with pytest.raises(Exception, match="lost on the way"):
        run()
    run()  # the crashed batch runs again, under the same number
    put(root, "late/three.xml", XML % 4, start + 900)
    run()
    verdicts = sorted((os.path.basename(r["path"]), r["lane"], r["reason"]) for r in job.outcomes().collect())
    assert verdicts == [("done.xml", "ignored", "duplicate"), ("note.txt", "ignored", "pattern_mismatch_scan"),
                        ("one.xml", "processing", None), ("three.xml", "processing", None), ("two.xml", "processing", None)]
    keys = [r["key"] for r in job.messages().collect()]
    assert len(keys) == len(set(keys)) == 3
    published = [r["key"] for r in spark.read.json(str(tmp_path / "queue")).collect()]
    assert set(published) == set(keys)  # at least once
    states = sorted((r["state"]) for r in book.live(int(time.time() * 1e6)).collect())
    assert states == ["enqueued"] * 3 + ["processed"]
