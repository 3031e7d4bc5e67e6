"""Fixed cases of the batch operators."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from quayside.config import DAY_US, AdmissionConfig, Buckets, Lanes, LedgerTtl, RetryConfig
from quayside.operators import filters, housekeeping, ledger, metrics, retry, rules, stability
from quayside.plans import admission

S = 1_000_000


def test_stability_cases(spark):
    samples = {
        "unchanged": [(5, 1), (5, 1)],
        "growing": [(1, 1), (2, 2), (3, 3)],
        "late": [(1, 1), (2, 2), (2, 2)],
        "gone": [(None, None)],
        "gone_first": [(1, 1), (None, None), (1, 1), (1, 1)],
        "gone_after": [(1, 1), (1, 1), (None, None)],
        "touched": [(1, 1), (1, 2), (1, 3)],
        "too_late": [(1, 1), (2, 1), (3, 1), (3, 1)],
        "single": [(1, 1)],
    }
    rows = [(p, i * S, i, a, b) for p, xs in samples.items() for i, (a, b) in enumerate(xs)]
    df = spark.createDataFrame(rows, "path string, sample_us long, sample_id long, size long, mtime long")
    got = {r["path"]: (r["stable"], r["stable_at_sample"], r["duration_us"]) for r in
           stability.verdict(df, 3, 300 * S).collect()}
    no = (False, None, None)
    assert got == {"unchanged": (True, 2, S), "growing": no, "late": (True, 3, 2 * S), "gone": no, "gone_first": no,
                   "gone_after": (True, 2, S), "touched": no, "too_late": no, "single": no}
    late = stability.verdict(df, 3, 2 * S).filter("path = 'late'").first()
    assert (late["stable"], late["reason"]) == (False, "file_not_stable")


@pytest.mark.parametrize("limit,log,want", [
    (3, [True], ("sent", 1, None)),
    (3, [False, False, True], ("sent", 3, None)),
    (3, [False, False, False], ("failed", 3, "e2")),
    (3, [False, False, False, True], ("failed", 3, "e2")),
    (3, [False], ("pending", 1, None)),
    (0, [True], ("failed", 0, None)),
])
def test_retry_rollup(spark, limit, log, want):
    df = spark.createDataFrame([("k", i * S, i, ok, f"e{i}") for i, ok in enumerate(log)],
                               "key string, attempt_us long, attempt_id long, ok boolean, error string")
    row = retry.rollup(df, ["key"], RetryConfig(max_attempts=limit)).first()
    assert (row["status"], row["attempts"], row["last_error"]) == want


def test_retry_schedule(spark):
    assert retry.delays_ms(RetryConfig(5, 50, 100, 3.0)) == [50, 100, 100, 100]
    assert retry.delays_ms(RetryConfig()) == [1000, 2000]
    df = spark.createDataFrame([(1, 10 * S)], "id long, us long")
    got = [(r["attempt"], r["planned_us"]) for r in retry.schedule(df, "us").orderBy("attempt").collect()]
    assert got == [(1, 10 * S), (2, 11 * S), (3, 13 * S)]


def test_violations(spark):
    df = spark.createDataFrame([("fine", 3, "a"), ("low", -1, "a"), ("both", -2, None)], "name string, n int, tag string")
    broken = [(F.col("n") < 0, "n is negative"), (F.col("tag").isNull(), "no tag")]
    got = {r["name"]: (list(r["violations"]), r["first_violation"]) for r in rules.violations(df, broken).collect()}
    assert got == {"fine": ([], None), "low": (["n is negative"], "n is negative"),
                   "both": (["n is negative", "no tag"], "n is negative")}


def test_backlog_carries_levels_over_days(spark):
    day = 86_400_000_000
    df = spark.createDataFrame([(1, day + 5), (2, 3 * day), (4 * day, 4 * day + 9)], "a long, b long")
    got = sorted((r["day"], r["peak"]) for r in metrics.backlog(df, "a", "b").collect())
    # Day 1 begins with both, day 2 has no change, and what ends as day 3 begins does not count for it.
    assert got == [(0, 2), (1, 2), (2, 1), (3, 0), (4, 1)]


def test_health(spark):
    df = spark.createDataFrame([("a", 1), ("a", 3), ("b", 9)], "g string, v int")
    checks = rules.HealthChecks()
    none = checks.report(df, ["g"]).collect()
    assert {r["status"] for r in none} == {"healthy"} and none[0]["checks"] == {}
    checks.register("max", F.max("v") < 5, "too high")
    checks.register("some", F.count("*") > 0, "empty")
    got = {r["g"]: (r["status"], r["checks"]) for r in checks.report(df, ["g"]).collect()}
    assert got == {"a": ("healthy", {"max": "ok", "some": "ok"}), "b": ("degraded", {"max": "too high", "some": "ok"})}


def test_ledger_states(spark):
    log = spark.createDataFrame([
        ("h1", "enqueued", "/p/a", None, 1), ("h1", "processed", None, None, 5),
        ("h2", "enqueued", "/p/b", None, 1), ("h2", "failed", None, "x:y", 3), ("h2", "enqueued", "/p/b2", None, 9),
        ("h3", "enqueued", "/p/c", None, 2), ("h3", "enqueued", "/p/c2", None, 4),
        ("h4", "processed", None, None, 2), ("h4", "failed", None, "z", 3)],
        "hash string, state string, path string, reason string, at_us long")
    got = {(r["hash"], r["state"], r["path"], r["at_us"]) for r in ledger.current(log).collect()}
    assert got == {("h1", "processed", None, 5), ("h2", "failed", None, 3), ("h2", "enqueued", "/p/b2", 9),
                   ("h3", "enqueued", "/p/c2", 4), ("h4", "processed", None, 2), ("h4", "failed", None, 3)}
    ttl = LedgerTtl(enqueued_us=3, processed_us=10, failed_us=10)
    alive = {(r["hash"], r["state"]) for r in ledger.live(ledger.current(log), 12, ttl).collect()}
    assert alive == {("h1", "processed"), ("h2", "failed"), ("h4", "failed")}
    assert ledger.live(log, 12, None).count() == log.count()


def test_parquet_ledger_is_idempotent_and_compacts(spark, tmp_path):
    book = ledger.ParquetLedger(spark, str(tmp_path / "ledger"), ttl=None)
    schema = "hash string, state string, path string, reason string, at_us long"
    one = spark.createDataFrame([("h1", "enqueued", "/a", None, 1), ("h2", "enqueued", "/b", None, 1)], schema)
    two = spark.createDataFrame([("h1", "processed", None, None, 2)], schema)
    assert book.live(0).count() == 0
    book.append(one, "landing-0")
    book.append(one, "landing-0")
    book.append(two, "done-0")
    want = {("h1", "processed"), ("h2", "enqueued")}
    view = lambda: {(r["hash"], r["state"]) for r in book.live(10).collect()}
    assert view() == want and book.log().count() == 3
    book.compact()
    assert view() == want and book.log().count() == 2
    book.append(one, "landing-0")  # a replayed batch is already in the snapshot
    book.append(spark.createDataFrame([("h2", "failed", None, "r", 3)], schema), "done-1")
    assert view() == {("h1", "processed"), ("h2", "failed")}
    book.compact()
    assert view() == {("h1", "processed"), ("h2", "failed")} and book.log().count() == 2


def test_orphans(spark):
    df = spark.createDataFrame([("/w/processing/orphan.txt", "h1", False), ("/w/processing/done.txt", "h2", False),
                                ("/w/processing/sub", "h3", True)], "path string, hash string, is_dir boolean")
    done = spark.createDataFrame([("h2",)], "hash string")
    assert {r["replay_path"] for r in ledger.orphans(df, None, "/w/incoming").collect()} == {
        "/w/incoming/orphan.txt", "/w/incoming/done.txt"}
    assert [r["replay_path"] for r in ledger.orphans(df, done, "/w/incoming").collect()] == ["/w/incoming/orphan.txt"]


def test_lifecycle(spark):
    log = spark.createDataFrame([("a", "enqueued", 0), ("a", "processed", 5), ("b", "enqueued", 0),
                                 ("c", "enqueued", 2 * DAY_US), ("d", "failed", 4)], "hash string, state string, at_us long")
    got = {r["hash"]: (r["outcome"], r["latency_us"]) for r in ledger.lifecycle(log, 2 * DAY_US + 1).collect()}
    assert got == {"a": ("processed", 5), "b": ("stuck", None), "c": ("enqueued", None), "d": ("failed", None)}


def test_empty_directories(spark):
    dirs = spark.createDataFrame([(p,) for p in ["/w/level1", "/w/level1/level2", "/w/level1/level2/level3", "/w/keep",
                                                 "/w/keep/empty", "/w/safe", "/w"]], "path string")
    files = spark.createDataFrame([("/w/keep/file.txt",)], "path string")
    guard = spark.createDataFrame([("/w/safe",), ("/w",)], "path string")
    one_pass = housekeeping.empty_directories(dirs, dirs.unionByName(files), guard)
    assert {r["path"] for r in one_pass.collect()} == {"/w/level1/level2/level3", "/w/keep/empty"}
    passes = {r["path"]: r["removed_in_pass"] for r in housekeeping.empty_closure(dirs, files, guard).collect()}
    assert passes == {"/w/level1/level2/level3": 1, "/w/level1/level2": 2, "/w/level1": 3, "/w/keep/empty": 1}
    assert housekeeping.empty_closure(dirs, files, guard, passes=1).count() == 2


def test_retention(spark):
    now = 100 * DAY_US
    rows = [("tmp", now), ("processed", now - 2 * DAY_US), ("processed", now - DAY_US), ("failed", now - 9 * DAY_US),
            ("ignored", now - DAY_US - 1), ("processing", 0)]
    df = spark.createDataFrame([(x, t, 10) for x, t in rows], "lane string, mtime_us long, length long")
    due = housekeeping.retention_candidates(df, {"tmp": 5, "processed": 1, "failed": 0, "ignored": 1, "processing": 1}, now)
    assert sorted((r["lane"], r["age_days"]) for r in due.collect()) == [("ignored", 1), ("processed", 2), ("tmp", 0)]
    assert {r["lane"]: (r["files"], r["bytes"]) for r in housekeeping.cleanup_summary(due).collect()}["tmp"] == (1, 10)


def test_lanes(spark):
    inv = spark.createDataFrame([("/in", "processing"), ("/in", "failed")], "root string, lane string")
    assert {r["lane"] for r in housekeeping.missing_lanes(inv, Lanes().all()).collect()} == {"processed", "ignored", "tmp"}
    moves = spark.createDataFrame([("ignored", "a", "/x/a", 1, 1), ("ignored", "a", "/y/a", 2, 2), ("failed", "a", "/z/a", 1, 3)],
                                  "lane string, filename string, path string, moved_us long, file_id long")
    assert {(r["lane"], r["survivor"], r["overwritten"]) for r in housekeeping.lane_survivors(moves).collect()} == {
        ("ignored", "/y/a", 1), ("failed", "/z/a", 0)}


def test_quantiles(spark):
    b = Buckets(1.0, 2.0, 3)  # 1, 2, 4
    df = spark.createDataFrame([(0.5,), (1.5,), (1.5,), (3.0,), (9.0,)], "v double")
    h = metrics.histogram(df, "v", b)
    assert h.first()["cumulative"] == [1, 3, 4, 5]
    q = [metrics.quantile(x, b).alias(f"q{i}") for i, x in enumerate((0.1, 0.5, 0.75, 0.99))]
    assert [round(x, 6) for x in h.select(*q).first()] == [0.5, 1.75, 3.5, 4.0]
    assert metrics.histogram(df.limit(0), "v", b).select(metrics.quantile(0.5, b)).first()[0] is None


def test_counters_follow_the_outcome_table(spark):
    rows = [("accepted", False), ("accepted", True), ("pattern_mismatch", False), ("file_not_stable", False),
            ("rate_limit_exceeded", False), ("file_too_small", False), ("duplicate", False), ("lock_held", False),
            ("zip_extraction_failed: x", True), ("queue_error: no broker", False), ("pool_full", False), ("stat_error", False)]
    df = spark.createDataFrame(rows, "reason string, zipped boolean")
    r = metrics.outcome_counters(df, [], "event", is_archive=F.col("zipped")).first().asDict()
    assert {k: v for k, v in r.items() if v} == {
        "detected": 8, "sent": 2, "processed": 2, "ignored": 5, "duplicated": 2, "rejected": 1, "watcher_errors": 1,
        "queue_errors": 1, "rate_limit_dropped": 2}
    assert metrics.outcome_counters(df, [], "scan").first()["detected"] == 0


def test_gauges(spark):
    df = spark.createDataFrame([(0, 10), (5, 10), (10, 20)], "a long, b long")
    got = [(r["us"], r["change"], r["open"]) for r in metrics.gauge(df, "a", "b", 2).orderBy("us").collect()]
    assert got == [(0, 1, 1), (5, 1, 2), (10, -1, 1), (20, -1, 0)]
    assert metrics.backlog(df, "a", "b").first()["peak"] == 2


def test_op_filters(spark):
    df = spark.createDataFrame([("CREATE", 1), ("WRITE", 2), ("CHMOD", 16), ("RENAME", 8), ("REMOVE", 4), (None, 3)],
                               "op string, mask int")
    assert df.filter(filters.is_arrival("op")).count() == 2
    assert df.filter(filters.is_arrival_mask("mask")).count() == 3


def test_classify_modes(spark):
    body = bytearray(b"x" * 50)
    at = dt.datetime(2024, 1, 1)
    df = spark.createDataFrame([("/in/a.xml:Zone.Identifier", 50, body, at), ("/in/b.Zone.Identifier", 50, body, at),
                                ("/in/c.xml", 50, body, at)],
                               "path string, length long, content binary, arrived_us timestamp")
    cfg = AdmissionConfig(min_bytes=50, max_bytes=50)
    scan = {r["filename"]: r["reason"] for r in admission.classify(df, cfg, mode="scan").collect()}
    assert scan == {"b.Zone.Identifier": "pattern_mismatch_scan", "c.xml": None}
    event = {r["filename"]: r["reason"] for r in admission.classify(df, cfg, mode="event").collect()}
    assert event == {"c.xml": None}
