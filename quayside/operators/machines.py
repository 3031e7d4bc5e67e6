"""Sequential per-key rules as small resumable machines.

A machine folds one key's rows in order: ``run(state, us, columns) -> (outputs, state)``. ``state`` is
a list of integers, or None before the first row. Running two halves one after the other gives the
same as running the whole, which is all a micro-batch or a batch fold needs.

To split one key over many tasks, a machine can also describe a stretch of rows without knowing the
state it starts from: ``summarise(us, columns)`` returns rows of integers, and
``advance(summary, state)`` gives the state after the stretch. Everything is integer arithmetic, so
results are exact and independent of where a history is cut.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right

import numpy as np

State = list | None
Columns = dict[str, np.ndarray]


def _last_reached(jump: list[int]) -> list[int]:
    """For each index the last one reached by following ``jump`` (always forward) inside the list."""
    n = len(jump)
    end = list(range(n))
    for i in range(n - 1, -1, -1):
        if jump[i] < n:
            end[i] = end[jump[i]]
    return end


def _steps(entry_us: list[int], values: list[list[int]]) -> list[list[int]]:
    """[upper bound, *value] per run of equal values; the first bound >= x holds the value for x."""
    out: list[list[int]] = []
    for bound, value in zip(entry_us, values):
        if out and out[-1][1:] == value:
            out[-1][0] = bound
        else:
            out.append([bound, *value])
    return out


class GreedyGap:
    """Accepts a row when at least ``gap_us`` passed since the last *accepted* one.

    A rejected row does not extend the gap. With a ``release`` column, a release row clears the memory
    and is itself never accepted (a lease given back before it ran out).

    State: [us of the last accepted row], or None.
    """

    outputs = "accepted boolean"

    def __init__(self, gap_us: int, release: str | None = None) -> None:
        self.gap = gap_us
        self.release = release
        self.inputs = (release,) if release else ()

    def spent_us(self, state: list) -> int | None:
        """From this time on the state is as good as none."""
        return state[0] + self.gap

    def run(self, state: State, us: np.ndarray, cols: Columns) -> tuple[dict[str, np.ndarray], State]:
        n = len(us)
        accepted = np.zeros(n, dtype=bool)
        times = us.tolist()
        last = state[0] if state else None
        begin = 0
        for stop in [*(np.flatnonzero(cols[self.release]).tolist() if self.release else []), n]:
            i = begin if last is None else bisect_left(times, last + self.gap, begin, stop)
            while i < stop:
                accepted[i] = True
                last = times[i]
                i = bisect_left(times, last + self.gap, i + 1, stop)
            begin = stop + 1
            if stop < n:
                last = None
        return {"accepted": accepted}, None if last is None else [last]

    @property
    def reach_us(self) -> int | None:
        """How long a past keeps anything from being accepted; None where it can be cut short."""
        return None if self.release else self.gap

    def summarise(self, us: np.ndarray, cols: Columns, ready_from: int | None = None) -> list[list[int]]:
        """[[kind, bound, end], ...]: kind 1 forgets the past, kind 0 is a step over 'ready' times.

        With ``ready_from`` only steps for a past that is ready from then on are there; the first one also stands
        for no past, which is all there is before a key's first row. Rows inside one gap thus take one step.
        """
        if self.release and cols[self.release].any():
            cut = int(np.flatnonzero(cols[self.release])[-1]) + 1
            _, end = GreedyGap(self.gap).run(None, us[cut:], {})
            return [[1, 0, *(end or [])]]
        jump = np.maximum(np.searchsorted(us, us + self.gap, side="left"), np.arange(len(us)) + 1)
        end = _last_reached(jump.tolist())
        # The past is at most the first row's time, so it is ready again by us[0] + gap.
        candidates = int(np.searchsorted(us, us[0] + self.gap, side="left")) + 1
        times = us.tolist()
        begin = 0 if ready_from is None else int(np.searchsorted(us, ready_from, side="left"))
        none = [[0, times[0], times[end[0]]]] if begin else []
        steps = _steps(times[begin:candidates], [[times[e]] for e in end[begin:candidates]])
        return none + [[0, *s] for s in steps]

    def compose(self, first: list[list[int]], second: list[list[int]]) -> list[list[int]]:
        """The summary of one stretch and the one behind it. A past that the first leaves alone meets the second's steps."""
        if second[0][0] == 1:
            return second
        if first[0][0] == 1:
            return [[1, 0, *(self.advance(second, first[0][2:] or None) or [])]]
        bounds = [b for _, b, _ in first]
        ends = [self.advance(second, [e]) for _, _, e in first]
        behind = [(b, [e]) for _, b, e in second if b > bounds[-1]]
        return [[0, *s] for s in _steps([*bounds, *(b for b, _ in behind)], [*ends, *(e for _, e in behind)])]

    def advance(self, summary: list[list[int]], state: State) -> State:
        if summary[0][0] == 1:
            return summary[0][2:] or None
        if state is None:
            return [summary[0][2]]
        ready = state[0] + self.gap
        return next(([end] for _, bound, end in summary if bound >= ready), state)


class TokenBucket:
    """Admits ``rate`` rows per ``period_us`` with a burst; a refused row costs nothing.

    One token is ``period_us`` units and each microsecond refills ``rate`` units, so nothing is ever
    rounded. The bucket starts full.

    State: [units left, us of the last row], or None.
    """

    outputs = "admitted boolean"
    inputs: tuple[str, ...] = ()

    def __init__(self, rate: int, period_us: int, burst: int | None = None) -> None:
        self.rate = rate
        self.cost = period_us
        self.cap = (rate if burst is None else burst) * period_us

    def spent_us(self, state: list) -> int | None:
        """From this time on the bucket is full again."""
        return state[1] - (state[0] - self.cap) // self.rate if self.rate else None

    def run(self, state: State, us: np.ndarray, cols: Columns) -> tuple[dict[str, np.ndarray], State]:
        rate, cost, cap = self.rate, self.cost, self.cap
        units, last = state if state else (cap, int(us[0]))
        admitted = []
        for t in us.tolist():
            # A row that comes late refills nothing.
            units = min(cap, units + max(0, t - last) * rate)
            last = max(t, last)
            take = units >= cost
            if take:
                units -= cost
            admitted.append(take)
        return {"admitted": np.array(admitted, dtype=bool)}, [units, last]

    def summarise(self, us: np.ndarray, cols: Columns) -> list[list[int]]:
        """Units after the stretch as a piecewise function of the units y before its first row.

        First row: [first us, last us]. Then [upper bound of y, slope 0 or 1, offset] per piece.
        """
        head = [int(us[0]), int(us[-1]), 0]
        return [head, *(self._overloaded(us) or self._pieces(us))]

    def _overloaded(self, us: np.ndarray) -> list[list[int]] | None:
        """Closed form while the bucket never overflows, whatever it held before.

        Admissions through row j are j + min(0, floor((y + m_j) / cost)) with m_j the running minimum
        of refill - (row number) * cost: the rows whose token was still missing are the refused ones.
        """
        n = len(us)
        if self.rate * int(us[-1] - us[0]) + n * self.cost > 2**62:
            return None
        refill = (us - us[0]) * self.rate
        number = np.arange(1, n + 1)
        low = np.minimum.accumulate(refill - number * self.cost)
        spare = refill[1:] - number[:-1] * self.cost
        if n > 1 and (spare.max() > 0 or (spare - low[:-1]).max() + self.cost - 1 > self.cap):
            return None
        total, m = int(refill[-1]), int(low[-1])
        every = total - n * self.cost  # all admitted: y + every
        out: list[list[int]] = []
        # Below -m the admissions drop by one per token, and only y's remainder matters.
        edge = 0
        while edge <= self.cap:
            short = (edge + m) // self.cost
            if short >= 0:
                out.append([self.cap, 1, every])
                break
            upper = min(self.cap, (short + 1) * self.cost - m - 1)
            out.append([upper, 1, every - short * self.cost])
            edge = upper + 1
        return out

    def _pieces(self, us: np.ndarray) -> list[list[int]]:
        """Pushes the whole range of possible levels through every row, piece by piece."""
        rate, cost, cap = self.rate, self.cost, self.cap
        low, high = np.array([0]), np.array([cap])  # levels before the stretch, per piece
        slope, offset = np.array([1]), np.array([0])
        steps = np.diff(us, prepend=us[0]) * rate

        def split(at: int, part: np.ndarray) -> None:
            """Cut pieces marked in ``part`` so that levels >= ``at`` stand alone."""
            nonlocal low, high, slope, offset
            where = np.flatnonzero(part)
            edge = at - offset[where]
            low, slope, offset = (np.insert(low, where + 1, edge), np.insert(slope, where + 1, slope[where]),
                                  np.insert(offset, where + 1, offset[where]))
            high = np.append(low[1:] - 1, cap)

        for step in steps.tolist():
            offset = offset + step
            top, bottom = slope * high + offset, slope * low + offset
            if (top > cap).any():
                over = (bottom < cap) & (top > cap)
                if over.any():
                    split(cap, over)
                    bottom = slope * low + offset
                full = bottom >= cap
                slope, offset = np.where(full, 0, slope), np.where(full, cap, offset)
                top, bottom = slope * high + offset, slope * low + offset
            across = (bottom < cost) & (top >= cost)
            if across.any():
                split(cost, across)
                bottom = slope * low + offset
            offset = np.where(bottom >= cost, offset - cost, offset)
            same = (slope[1:] == slope[:-1]) & (offset[1:] == offset[:-1])
            if same.any():
                keep = np.append(True, ~same)
                low, slope, offset = low[keep], slope[keep], offset[keep]
                high = np.append(low[1:] - 1, cap)
        return [list(p) for p in zip(high.tolist(), slope.tolist(), offset.tolist())]

    def compose(self, first: list[list[int]], second: list[list[int]]) -> list[list[int]]:
        """The summary of one stretch and the one behind it: each piece is cut where the second's pieces are."""
        begin, end, _ = first[0]
        idle = (second[0][0] - end) * self.rate
        out: list[list[int]] = []
        low = 0
        for high, slope, offset in first[1:]:
            while low <= high:
                level = min(self.cap, slope * low + offset + idle)
                bound, more, added = next(p for p in second[1:] if p[0] >= level)
                if not slope or level == self.cap:
                    piece = [high, 0, more * level + added]
                else:
                    # Up to where this piece ends, the second's ends, or the bucket is full.
                    upto = min(high, min(bound, self.cap - 1) - offset - idle)
                    piece = [upto, 1, offset + idle + added] if more else [upto, 0, added]
                if out and out[-1][1:] == piece[1:]:
                    out[-1][0] = piece[0]
                else:
                    out.append(piece)
                low = piece[0] + 1
        return [[begin, second[0][1], 0], *out]

    def advance(self, summary: list[list[int]], state: State) -> State:
        first, last, _ = summary[0]
        y = self.cap if state is None else min(self.cap, state[0] + (first - state[1]) * self.rate)
        return next([slope * y + offset, last] for bound, slope, offset in summary[1:] if bound >= y)


CLOSED, OPEN, HALF_OPEN = 0, 1, 2
BREAKER_STATES = ("closed", "open", "half-open")


class Breaker:
    """Circuit breaker over an ordered log of call outcomes (``ok``).

    Opens at ``max_failures`` failures without a success between them. While open, calls are
    short-circuited until strictly more than ``reset_us`` passed since the opening failure; the next
    call then runs half-open. Going half-open sets the failure count back to zero, so a single failure
    there does not open it again. Any success sets the count to zero; in half-open it also closes.

    State: [state, failures, us of the opening failure], or None.
    Output ``opens`` marks a call that opens the breaker, which starts an episode named by its time.
    ``episode_us`` names the episode a call met: a short-circuited one, or the one that probes after it
    (``probes``).
    """

    outputs = ("verdict string, state_after string, failures_after int, episode_us long, opens boolean, "
               "probes boolean")

    def __init__(self, max_failures: int, reset_us: int, ok: str = "ok") -> None:
        self.max = max_failures
        self.reset = reset_us
        self.ok = ok
        self.inputs = (ok,)

    def spent_us(self, state: list) -> int | None:
        """A closed breaker without failures is as good as a new one; others do not get there by time alone."""
        return 0 if state[:2] == [CLOSED, 0] else None

    def run(self, state: State, us: np.ndarray, cols: Columns) -> tuple[dict[str, list], State]:
        now, failures, opened = state if state else (CLOSED, 0, 0)
        verdict, after, count, episode, opens, probes = [], [], [], [], [], []
        for t, ok in zip(us.tolist(), cols[self.ok].tolist()):
            met, opening, probing = None, False, False
            if now == OPEN:
                met = opened
                if t - opened > self.reset:
                    now, failures, probing = HALF_OPEN, 0, True
            if now == OPEN:
                verdict.append("short_circuited")
            else:
                verdict.append("executed")
                if ok:
                    now, failures = CLOSED, 0
                else:
                    failures += 1
                    if failures >= self.max:
                        now, opened, opening = OPEN, t, True
            after.append(BREAKER_STATES[now])
            count.append(failures)
            episode.append(met)
            opens.append(opening)
            probes.append(probing)
        return {"verdict": verdict, "state_after": after, "failures_after": count,
                "episode_us": episode, "opens": opens, "probes": probes}, [now, failures, opened if now == OPEN else 0]

    def summarise(self, us: np.ndarray, cols: Columns) -> list[list[int]]:
        """End states by entry state.

        First row: [n, failures at the start, failures at the end, end of the run started at row 0...];
        then one step row [bound, *end] per range of resume times of an open entry.
        """
        n = len(us)
        times = us.tolist()
        good = np.flatnonzero(cols[self.ok].astype(bool)).tolist()
        # Rows at which the breaker opens when counting starts from zero at row i.
        opens = self._openings(n, good)
        resume = [bisect_right(times, times[o] + self.reset) if o < n else n for o in opens]
        last = _last_reached(resume)
        ends = [self._end(i, opens, times, good, HALF_OPEN) for i in range(n)]
        after = [ends[i] for i in last]
        # An open entry is at most as old as the first row, so it resumes by us[0] + reset.
        candidates = min(n, bisect_right(times, times[0] + self.reset) + 1)
        open_steps = _steps(times[:candidates], after[:candidates])
        table = []
        for label in (CLOSED, HALF_OPEN):
            for f in range(self.max):
                table.append([label, f, *self._from_counting(label, f, n, times, good, after, opens)])
        return [[len(table), 0], *table, *open_steps]

    def _openings(self, n: int, good: list[int]) -> list[int]:
        opens = [n] * n
        stop = n  # next success
        later = n  # opening row of the next long enough run after that success
        remaining = list(good)
        for i in range(n - 1, -1, -1):
            if remaining and remaining[-1] == i:
                remaining.pop()
                # Starting on a success equals starting right after it.
                opens[i] = opens[i + 1] if i + 1 < n else n
                stop, later = i, opens[i]
            else:
                opens[i] = i + self.max - 1 if stop - i >= self.max else later
        return opens

    def _end(self, i: int, opens: list[int], times: list[int], good: list[int], label: int) -> list[int]:
        """End state of a stretch counted from zero at row i when it is not resumed any more."""
        n = len(times)
        if opens[i] < n:
            return [OPEN, self.max, times[opens[i]]]
        if good and good[-1] >= i:
            return [CLOSED, n - 1 - good[-1], 0]
        return [label, n - i, 0]

    def _from_counting(self, label: int, f: int, n: int, times: list[int], good: list[int],
                       after: list[list[int]], opens: list[int]) -> list[int]:
        first_good = good[0] if good else n
        if f + first_good >= self.max:  # opens within the leading run of failures
            opening = self.max - f - 1
            back = bisect_right(times, times[opening] + self.reset)
            return after[back] if back < n else [OPEN, self.max, times[opening]]
        if first_good == n:
            return [label, f + n, 0]
        end = after[first_good]
        # A stretch counted from a success on is closed, whatever label it was computed with.
        return end

    def advance(self, summary: list[list[int]], state: State) -> State:
        size = summary[0][0]
        now, failures, opened = state if state else (CLOSED, 0, 0)
        if now != OPEN:
            return next(row[2:] for row in summary[1:1 + size] if row[0] == now and row[1] == failures)
        ready = opened + self.reset
        return next((row[1:] for row in summary[1 + size:] if row[0] > ready), state)
