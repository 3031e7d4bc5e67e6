"""Segmented and salted paths give what the plain ones give, with one key holding a third of all rows."""

import random

import pytest
from pyspark.sql import functions as F

from quayside.operators import ledger, metrics, ordered, skew
from quayside.plans import catalog

BASE = 1_704_067_200_000_000


@pytest.fixture(scope="module")
def rows():
    rnd = random.Random(3)
    out, us = [], BASE
    for i in range(2400):
        us += rnd.choice([0, 0, 1_000_000, 40_000_000])
        key = "hot" if rnd.random() < 0.4 else f"k{rnd.randrange(60)}"
        out.append((key, us, i, rnd.choice(["x", "y", "reset"]), float(rnd.randrange(100))))
    return out


@pytest.fixture(scope="module")
def table(spark, rows):
    return spark.createDataFrame(rows, "key string, us long, id long, kind string, value double").repartition(5)


def test_pin_cuts_a_single_key_evenly(spark, table):
    hot = skew.measure(table, ["key"], 100)
    assert hot.count == 1
    _, large = skew.divide(table, ["key"], hot)
    sizes = [r["count"] for r in skew.pin(large, ["key"], ["us", "id"], hot.segments()).groupBy(skew.SEG).count().collect()]
    assert len(sizes) > 4 and max(sizes) < 300


@pytest.mark.parametrize("hot_rows", [60, 10**6])
@pytest.mark.parametrize("how", ["sum", "max", "min"])
def test_running(spark, table, rows, hot_rows, how):
    fn = lambda part, seg: ordered.running(part, ["key"], ["us", "id"], F.col("value"), "out", seg, how)
    got = {r["id"]: r["out"] for r in skew.by_size(table, ["key"], ["us", "id"], fn, hot_rows).collect()}
    state, fold = {}, {"sum": lambda a, b: a + b, "max": max, "min": min}[how]
    for key, _, i, _, v in rows:
        state[key] = v if key not in state else fold(state[key], v)
        assert got[i] == state[key]
    assert len(got) == len(rows)


@pytest.mark.parametrize("hot_rows", [60, 10**6])
def test_previous(spark, table, rows, hot_rows):
    fn = lambda part, seg: ordered.previous(part, ["key"], ["us", "id"], "value", "out", seg)
    got = {r["id"]: r["out"] for r in skew.by_size(table, ["key"], ["us", "id"], fn, hot_rows).collect()}
    last = {}
    for key, _, i, _, v in rows:
        assert got[i] == last.get(key)
        last[key] = v


def test_global_running_by_time(spark, table, rows):
    out = ordered.running(table, [], ["us", "id"], F.lit(1), "n", ordered.time_segment("us", 3_600_000_000))
    assert {r["id"]: r["n"] for r in out.collect()} == {i: n + 1 for n, (_, _, i, _, _) in enumerate(rows)}


def test_first_of_group(spark, table, rows):
    out = ordered.first_of_group(table, ["key"], ["us", "id"], "wins").collect()
    seen, want = set(), {}
    for key, _, i, _, _ in rows:
        want[i] = key not in seen
        seen.add(key)
    assert {r["id"]: r["wins"] for r in out} == want


def test_first_rows_limits_before_the_shuffle(spark, table):
    df = ordered.first_rows(table, ["key"], ["us", "id"], 3)
    assert "WindowGroupLimit" in df._jdf.queryExecution().executedPlan().toString()
    assert df.filter("key = 'hot'").count() == 3


@pytest.mark.parametrize("hot_rows", [60, 10**6])
def test_counter_rate(spark, rows, table, hot_rows):
    span = 900_000_000
    samples = table.select(F.col("key").alias("name"), "us", F.col("id").alias("sample_id"), "value")
    got = {r["sample_id"]: r["rate"] for r in metrics.counter_rate(samples, span, hot_rows=hot_rows).collect()}
    assert len(got) == len(rows)
    history = {}
    for key, us, i, _, v in rows:
        history.setdefault(key, []).append((us, v))
        frame = [(t, x) for t, x in history[key] if t >= us - span]
        increase = sum(b if b < a else b - a for (_, a), (_, b) in zip(frame, frame[1:]))
        covered = (us - frame[0][0]) / 1e6
        if covered > 0:
            assert got[i] == pytest.approx(increase / covered, abs=1e-9), (key, i)
        else:
            assert got[i] is None


def test_first_of_null_keys(spark):
    df = spark.createDataFrame([(None, 2, "a"), (None, 1, None), ("x", None, "b"), ("x", 3, "c")], "key string, us long, id string")
    out = {(r["us"], r["id"]): r["wins"] for r in ordered.first_of_group(df, ["key"], ["us", "id"], "wins").collect()}
    assert out == {(2, "a"): False, (1, None): True, (None, "b"): True, (3, "c"): False}


@pytest.mark.parametrize("hot_rows", [60, 10**6])
def test_bucket_increase(spark, rows, table, hot_rows):
    """Bucket by bucket the same as for one counter, whose buckets are its value, half of it, and none."""
    span = 900_000_000
    value = F.array(F.col("value"), F.floor(F.col("value") / 2).cast("double"), F.lit(0.0))
    samples = table.select(F.col("key").alias("name"), "us", F.col("id").alias("sample_id"), value.alias("value"))
    got = {r["sample_id"]: r["increase"] for r in metrics.bucket_increase(samples, span, 3, hot_rows=hot_rows).collect()}
    history = {}
    for key, us, i, _, v in rows:
        history.setdefault(key, []).append((us, (v, float(v // 2), 0.0)))
        frame = [x for t, x in history[key] if t >= us - span]
        want = [sum(b[n] if b[n] < a[n] else b[n] - a[n] for a, b in zip(frame, frame[1:])) for n in range(3)]
        assert got[i] == pytest.approx(want, abs=1e-6), (key, i)


def test_sliding_quantiles_cut_wide_rows_early(spark, monkeypatch):
    """Rows with all buckets are half a kilobyte each, so a task sorts far fewer of them than of narrow ones."""
    limits, measure = [], skew.measure
    monkeypatch.setattr(skew, "measure", lambda df, keys, hot_rows=skew.HOT_ROWS: (limits.append(hot_rows), measure(df, keys, hot_rows))[1])
    catalog.QUERIES["sliding_quantiles"](spark, "/root/testdata/sf0.001")
    assert len(limits) == 2 and max(limits) * 500 <= 100_000_000


@pytest.mark.parametrize("hot_rows", [60, 10**6])
def test_gauge(spark, rows, hot_rows):
    df = spark.createDataFrame([(us, us + (i % 9) * 500_000_000) for _, us, i, _, _ in rows], "a long, b long")
    got = {r["us"]: r["open"] for r in metrics.gauge(df, "a", "b", hot_rows).collect()}
    spans = [(r["a"], r["b"]) for r in df.collect()]
    assert got == {t: sum(a <= t for a, _ in spans) - sum(b <= t for _, b in spans) for t in {x for s in spans for x in s}}


@pytest.mark.parametrize("hot_rows", [60, 10**6])
def test_daily_and_reset_counters(spark, rows, table, hot_rows):
    daily = metrics.daily_running(table, ["key"], tie="id", hot_rows=hot_rows)
    reset = metrics.reset_epochs(table, ["key"], F.col("kind") == "reset", ["kind"], tie="id", hot_rows=hot_rows)
    by_day, epochs, counts, want_daily, want_reset = {}, {}, {}, {}, {}
    for key, us, i, kind, _ in rows:
        day = us // 86_400_000_000
        by_day[key, day] = want_daily[i] = by_day.get((key, day), 0) + 1
        if kind == "reset":
            epochs[key] = epochs.get(key, 0) + 1
        else:
            at = (key, epochs.get(key, 0), kind)
            counts[at] = counts.get(at, 0) + 1
            want_reset[i] = (at[1], counts[at])
    assert {r["id"]: r["running_count"] for r in daily.collect()} == want_daily
    assert {r["id"]: (r["epoch"], r["running_count"]) for r in reset.collect()} == want_reset


@pytest.mark.parametrize("hot_rows", [60, 10**6])
def test_seen_within_ttl(spark, rows, table, hot_rows):
    ttl = 300_000_000
    entries = table.filter("kind = 'x'").select(F.col("key").alias("hash"), F.col("us").alias("at_us"))
    arrivals = table.filter("kind <> 'x'").select(F.col("key").alias("hash"), F.col("us").alias("arrived_us"), "id")
    got = {r["id"]: (r["last_at_us"], r["is_duplicate"]) for r in
           ledger.seen_within_ttl(arrivals, entries, ttl, "id", hot_rows).collect()}
    for key, us, i, kind, _ in rows:
        if kind != "x":
            at = max((u for k, u, _, e, _ in rows if k == key and e == "x" and u <= us), default=None)
            assert got[i] == (at, at is not None and us < at + ttl)
