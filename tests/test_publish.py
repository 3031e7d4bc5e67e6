"""Publishing with commits: dead letters, retries, batches that fail or run twice, and the landing job on top."""

import os
import sys
import time

import pytest
from pyspark import cloudpickle

from quayside.config import AdmissionConfig, RetryConfig
from quayside.operators.ledger_store import TieredLedger
from quayside.sinks.publish import Refused, SizeLimit, Topic
from quayside.sources import landing
from quayside.streaming import pipeline

cloudpickle.register_pickle_by_value(sys.modules[__name__])
FAST = RetryConfig(max_attempts=3, initial_delay_ms=1, max_delay_ms=2)


class Moody:
    """Takes a message at the n-th try, n being its key's last digit; never those that end in 9."""

    def __init__(self):
        self.tries = {}

    def send(self, key, value):
        if key is None or key.endswith("9"):
            raise Refused("no route")
        self.tries[key] = self.tries.get(key, 0) + 1
        if self.tries[key] < int(key[-1]):
            raise OSError("busy")


class Breaks:
    """Loses its connection for good where a file says so."""

    def __init__(self, flag):
        self.flag = flag

    def send(self, key, value):
        if os.path.exists(self.flag) and key == "k7":
            raise SystemExit("worker gone")


def messages(spark, n=12):
    return spark.createDataFrame([(f"k{i}", "v" * i) for i in range(n)] + [(None, None)], "key string, value string").repartition(4)


def test_retries_and_dead_letters(spark, tmp_path):
    topic = Topic(spark, str(tmp_path / "topic"), Moody(), FAST)
    sent, dead = topic.publish(messages(spark), "b-0")
    assert {r["key"]: r["attempts"] for r in sent.collect()} == {"k0": 1, "k1": 1, "k2": 2, "k3": 3, "k10": 1, "k11": 1}
    assert {(r["key"], r["attempts"], r["error"]) for r in dead.collect()} == {
        (None, 1, "no route"), ("k9", 1, "no route"), *((f"k{i}", 3, "busy") for i in range(4, 9))}


def test_batches_count_once(spark, tmp_path):
    flag = tmp_path / "down"
    flag.write_text("")
    topic = Topic(spark, str(tmp_path / "topic"), Breaks(str(flag)), FAST)
    with pytest.raises(Exception):
        topic.publish(messages(spark), "b-0")
    assert topic.batches() == [] and topic.read().sent.isEmpty()
    flag.unlink()
    assert topic.publish(messages(spark), "b-0").sent.count() == 13
    assert topic.publish(messages(spark, 3), "b-0").sent.count() == 13  # answered from the commit
    topic.publish(messages(spark, 2), "b-1")
    topic.publish(messages(spark).limit(0), "b-2")
    assert topic.batches() == ["b-0", "b-1", "b-2"] and topic.read().sent.count() == 16 and topic.read().dead.isEmpty()
    topic.write(messages(spark, 1))
    assert topic.read().sent.count() == 18


def test_dead_letters_fail_their_files(spark, tmp_path):
    root = tmp_path / "incoming"
    root.mkdir()
    for name, body in (("a.xml", b"<a>1</a>"), ("b.xml", b"<a>2</a>"), ("much-too-long-a-name-for-this-broker.xml", b"<a>3</a>")):
        (root / name).write_bytes(body)
        os.utime(root / name, (time.time() - 1000,) * 2)
    book = TieredLedger(spark, str(tmp_path / "ledger"))
    topic = Topic(spark, str(tmp_path / "topic"), SizeLimit(290), FAST)
    job = pipeline.LandingPipeline(spark, AdmissionConfig(roots=(str(root),), min_bytes=5), str(tmp_path / "out"), book, topic)
    job.start(landing.stream(spark, str(root)).drop("content"), str(tmp_path / "check")).awaitTermination()
    got = {os.path.basename(r["path"]): (r["lane"], r["reason"]) for r in job.outcomes().collect()}
    bad = "much-too-long-a-name-for-this-broker.xml"
    assert got == {"a.xml": ("processing", None), "b.xml": ("processing", None), bad: ("failed", "queue_error: message_too_large")}
    states = sorted((r["state"], r["reason"]) for r in book.live(int(time.time() * 1e6)).collect())
    assert states == [("enqueued", None), ("enqueued", None), ("failed", "queue_error: message_too_large")]
    sent, dead = topic.read()
    assert sent.count() == 2 and dead.count() == 1
