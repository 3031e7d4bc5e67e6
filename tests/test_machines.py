"""Every machine against a plain loop, and split runs against whole ones."""

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from quayside.operators.machines import Breaker, GreedyGap, TokenBucket

times = st.lists(st.integers(0, 12), min_size=1, max_size=60).map(lambda d: np.cumsum(d).astype(np.int64))


def chunks(us, cols, cut):
    return [(us[i:i + cut], {k: v[i:i + cut] for k, v in cols.items()}) for i in range(0, len(us), cut)]


def check_split(machine, us, cols, cut):
    whole, end = machine.run(None, us, cols)
    state, by_summary, parts = None, None, []
    for u, c in chunks(us, cols, cut):
        assert state == by_summary
        by_summary = machine.advance(machine.summarise(u, c), by_summary)
        out, state = machine.run(state, u, c)
        parts.append(out)
    assert state == by_summary
    for name in whole:
        assert [x for p in parts for x in list(p[name])] == list(whole[name])
    return whole


@settings(max_examples=300, deadline=None)
@given(times, st.integers(1, 30), st.integers(1, 9))
def test_greedy_gap(us, gap, cut):
    got = check_split(GreedyGap(gap), us, {}, cut)["accepted"]
    last, want = None, []
    for t in us:
        want.append(last is None or t - last >= gap)
        if want[-1]:
            last = t
    assert list(got) == want


@settings(max_examples=300, deadline=None)
@given(times, st.integers(1, 30), st.integers(1, 9), st.randoms())
def test_lease(us, gap, cut, rnd):
    release = np.array([rnd.random() < 0.2 for _ in us])
    got = check_split(GreedyGap(gap, "release"), us, {"release": release}, cut)["accepted"]
    last, want = None, []
    for t, r in zip(us, release):
        if r:
            last = None
            want.append(False)
        else:
            want.append(last is None or t - last >= gap)
            if want[-1]:
                last = t
    assert list(got) == want


@settings(max_examples=500, deadline=None)
@given(times, st.integers(1, 4), st.integers(1, 25), st.integers(1, 5), st.integers(1, 20))
def test_token_bucket(us, rate, period, burst, cut):
    got = check_split(TokenBucket(rate, period, burst), us, {}, cut)["admitted"]
    units, last, want = burst * period, us[0], []
    for t in us:
        units = min(burst * period, units + (t - last) * rate)
        last = t
        want.append(units >= period)
        units -= period * want[-1]
    assert list(got) == want


@settings(max_examples=500, deadline=None)
@given(times, st.integers(1, 4), st.integers(0, 25), st.integers(1, 9), st.randoms())
def test_breaker_splits(us, max_failures, reset, cut, rnd):
    ok = np.array([rnd.random() < 0.4 for _ in us])
    check_split(Breaker(max_failures, reset), us, {"ok": ok}, cut)


# (max failures, reset ms, [(ms, ok)], expected state after each call)
@pytest.mark.parametrize("max_failures,reset,calls,states", [
    (3, 1000, [(0, True)], ["closed"]),
    (3, 1000, [(0, False), (1, False)], ["closed", "closed"]),
    (3, 1000, [(0, False), (1, False), (2, False), (3, True)], ["closed", "closed", "open", "open"]),
    (2, 100, [(0, False), (1, False), (151, True)], ["closed", "open", "closed"]),
    (2, 100, [(0, False), (1, False), (151, False)], ["closed", "open", "half-open"]),
    (2, 100, [(0, False), (1, False), (151, False), (152, False)], ["closed", "open", "half-open", "open"]),
    (2, 100, [(0, False), (1, False), (101, True)], ["closed", "open", "open"]),
])
def test_breaker_cases(max_failures, reset, calls, states):
    us = np.array([ms * 1000 for ms, _ in calls])
    out, _ = Breaker(max_failures, reset * 1000).run(None, us, {"ok": np.array([ok for _, ok in calls])})
    assert out["state_after"] == states
    if states[-1] == "open" and states[-2] == "open":
        assert out["verdict"][-1] == "short_circuited"


def test_late_rows_refill_nothing():
    bucket = TokenBucket(1, 10, 2)
    got, state = bucket.run([20, 100], np.array([40, 110]), {})
    assert list(got["admitted"]) == [True, True] and state == [10, 110]
