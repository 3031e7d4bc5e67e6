"""Folds over tables: hot keys split over partitions give the same rows as a plain loop."""

import random

import numpy as np
import pytest

from quayside.operators import skew
from quayside.operators.folds import fold
from quayside.operators.machines import Breaker, GreedyGap, TokenBucket


def table(seed):
    rnd = random.Random(seed)
    rows, us = [], 1_700_000_000_000_000
    for i in range(3000):
        us += rnd.choice([0, 1, 2, 5, 40])
        key = "hot" if rnd.random() < 0.4 else ("warm" if rnd.random() < 0.3 else f"k{rnd.randrange(40)}")
        rows.append((key, us, i, rnd.random() < 0.5))
    return rows


MACHINES = [GreedyGap(17), GreedyGap(17, "flag"), TokenBucket(1, 9, 2), TokenBucket(1, 30, 4),
            Breaker(2, 25, "flag")]


@pytest.mark.parametrize("machine", MACHINES, ids=lambda m: type(m).__name__)
@pytest.mark.parametrize("hot_rows,broadcast", [(100, 10_000), (100, 2), (10_000, 10_000)])
def test_fold(spark, monkeypatch, machine, hot_rows, broadcast):
    """Hot keys with broadcast entries, with entries beyond the broadcast limit, and no hot keys."""
    monkeypatch.setattr(skew, "BROADCAST_KEYS", broadcast)
    rows = table(5)
    df = spark.createDataFrame(rows, "key string, us long, id long, flag boolean").repartition(7)
    got = {r["id"]: r.asDict() for r in fold(df, ["key"], "us", ["id"], machine, hot_rows).collect()}
    assert len(got) == len(rows)
    for key in {r[0] for r in rows}:
        mine = [r for r in rows if r[0] == key]
        want, _ = machine.run(None, np.array([r[1] for r in mine]), {"flag": np.array([r[3] for r in mine])})
        for name, values in want.items():
            assert [got[r[2]][name] for r in mine] == list(values), (key, name)


def test_limit_rises_until_few_keys_are_hot(spark, monkeypatch):
    df = spark.range(0, 1000).selectExpr("case when id < 400 then 0 else id % 10 end as key")
    assert skew.measure(df, ["key"], 20).count == 10
    monkeypatch.setattr(skew, "BROADCAST_KEYS", 3)
    raised = skew.measure(df, ["key"], 20)
    assert (raised.count, raised.rows, raised.hot_rows) == (1, 460, 320)
    assert [r[0] for r in raised.keys.collect()] == [0]
    assert skew.measure(df, ["key"], 1000) is None


def test_null_keys_are_split_too(spark):
    rows = [(None if key == "hot" else key, us, i, flag) for key, us, i, flag in table(6)]
    df = spark.createDataFrame(rows, "key string, us long, id long, flag boolean").repartition(7)
    got = {r["id"]: r["accepted"] for r in fold(df, ["key"], "us", ["id"], GreedyGap(17), 100).collect()}
    for key in {r[0] for r in rows}:
        mine = [r for r in rows if r[0] == key]
        want, _ = GreedyGap(17).run(None, np.array([r[1] for r in mine]), {})
        assert [got[r[2]] for r in mine] == list(want["accepted"]), key
    assert skew.divide(df, ["key"], skew.measure(df, ["key"], 100))[1].filter("key IS NULL").count() > 500


@pytest.mark.parametrize("machine", [GreedyGap(17), GreedyGap(300), GreedyGap(17, "flag"), TokenBucket(1, 9, 2), TokenBucket(2, 7, 3),
                                     TokenBucket(1, 30, 4)], ids=lambda m: type(m).__name__)
def test_composed_summaries(machine):
    """The summary of two stretches is that of one behind the other, from every state that the past can be in."""
    rnd = random.Random(4)
    for _ in range(60):
        us, at = [], 1000
        for _ in range(rnd.randrange(3, 60)):
            at += rnd.choice([0, 1, 3, 9, 25])
            us.append(at)
        us, flag = np.array(us), np.array([rnd.random() < 0.2 for _ in us])
        cut = sorted(rnd.sample(range(1, len(us)), 2))
        parts = [slice(0, cut[0]), slice(cut[0], cut[1]), slice(cut[1], len(us))]
        _, before = machine.run(None, us[parts[0]], {"flag": flag[parts[0]]})
        known = []
        if getattr(machine, "reach_us", None) is not None:
            known = [[max(us[0], us[p.start - 1] - machine.gap + 1) + machine.gap] for p in parts[1:]]
        summaries = [machine.summarise(us[p], {"flag": flag[p]}, *(known[i] if known else []))
                     for i, p in enumerate(parts[1:])]
        whole = machine.compose(*summaries)
        _, want = machine.run(before, us[cut[0]:], {"flag": flag[cut[0]:]})
        assert machine.advance(whole, before) == machine.advance(summaries[1], machine.advance(summaries[0], before)) == want
        fresh = [machine.summarise(us[p], {"flag": flag[p]}) for p in parts[1:]]
        _, want = machine.run(None, us[cut[0]:], {"flag": flag[cut[0]:]})
        assert machine.advance(machine.compose(*fresh), None) == want


def test_rows_inside_one_gap_take_few_steps():
    us = np.arange(200_000) + 10
    machine = GreedyGap(10**9)
    assert len(machine.summarise(us, {}, int(us[0]) - 5 + 10**9)) == 1
    assert len(machine.summarise(us, {}, 1 << 62)) == 1


@pytest.mark.parametrize("hot_rows", [200, 10_000])
def test_one_limiter_for_everything(spark, hot_rows):
    """Without keys the whole table is one history, and still runs in segments."""
    rows = table(8)
    df = spark.createDataFrame(rows, "key string, us long, id long, flag boolean").repartition(7)
    machine = TokenBucket(1, 20, 5)
    got = {r["id"]: r["admitted"] for r in fold(df, [], "us", ["id"], machine, hot_rows).collect()}
    want, _ = machine.run(None, np.array([r[1] for r in rows]), {})
    assert [got[r[2]] for r in rows] == list(want["admitted"])
