"""The state of settled events without Spark: calls that it takes, and both of its forms against the batch assignment."""

import random
from datetime import date, timedelta

import pytest
from pyspark.sql import Row

from ledgerloom.streaming import settling

from .test_settling import DAY, batch, drawn, found, run


class Kept:
    """A map or value in memory that counts the calls."""

    def __init__(self, calls):
        self.calls, self.rows, self.value = calls, {}, None

    def _called(self):
        self.calls.append(1)

    def get(self):
        self._called()
        return self.value

    def update(self, value):
        self._called()
        self.value = value

    def getValue(self, key):
        self._called()
        return self.rows.get(key)

    def updateValue(self, key, value):
        self._called()
        self.rows[key] = value

    def keys(self):
        self._called()
        return iter(list(self.rows))

    def iterator(self):
        self._called()
        return iter(list(self.rows.items()))


class Handle:
    def __init__(self):
        self.calls = []

    def getValueState(self, *given):
        return Kept(self.calls)

    getMapState = getValueState


def processor(keep_ms=None):
    handle, made = Handle(), settling._Settle(keep_ms)
    made.init(handle)
    return made, handle.calls


def event(i, day, revision=0):
    return Row(kind="event", id=i, revision=revision, low_or_day=day, high=None)


def period(i, low, high, revision=0):
    return Row(kind="period", id=i, revision=revision, low_or_day=low, high=high)


def test_calls_of_the_state_do_not_follow_the_days_of_a_period():
    made, calls = processor()
    first = [period("p", 0, 90), period("q", 90, 180), *[event(f"e{i}", 20 * i) for i in range(1, 6)]]
    told = list(made.handleInputRows(("a", 0), iter(first), None))
    assert {(r.id, r.period) for r in told} == {("e1", "p"), ("e2", "p"), ("e3", "p"), ("e4", "p"), ("e5", "q")}
    assert len(calls) <= 3
    calls.clear()
    moved = list(made.handleInputRows(("a", 0), iter([period("p", 0, 70, revision=1)]), None))
    assert [(r.id, r.period) for r in moved] == [("e4", None)]
    assert len(calls) <= 3


@pytest.mark.parametrize("few", (0, 3, 100))
@pytest.mark.parametrize("chunk", (1, 7, 10_000))
@pytest.mark.parametrize("keys", (1, 100))
def test_few_and_many_events_equal_batch(monkeypatch, few, chunk, keys):
    monkeypatch.setattr(settling, "FEW", few)
    monkeypatch.setattr(settling, "CHUNK", chunk)
    monkeypatch.setattr(settling, "KEYS_A_CALL", keys)
    number = lambda d: None if d is None else (d - date(1970, 1, 1)).days
    for seed in range(5):
        rng = random.Random(seed)
        events, periods = drawn(rng)
        rows = [(f, event(i, number(d), r)) for f, i, r, d in events] + [(f, period(i, number(s), number(e), r)) for f, i, r, s, e in periods]
        rng.shuffle(rows)
        cut, got = rng.randint(0, len(rows)), {}
        for firm in {f for f, _ in rows}:
            made, _ = processor(keep_ms=1 if seed == 4 else None)
            told = []
            for part in (rows[:cut], rows[cut:]):
                told += made.handleInputRows((firm, 0), iter([r for f, r in part if f == firm]), None)
            assert [r.change for r in told] == list(range(len(told)))
            got |= {(firm, r.id): (r.day, r.period) for r in told}
        assert got == {k: (number(day), p) for k, (day, p, _) in batch(events, periods).items()}


def test_a_part_outgrows_its_row(spark, tmp_path):
    """One part with more events than stay in a row; a second run moves and corrects events that are in the maps by then."""
    rng = random.Random(3)
    events = [("hot", f"e{i}", 0, DAY + timedelta(i % 90)) for i in range(3 * settling.FEW)]
    periods = [("hot", "p", 0, DAY - timedelta(1), DAY + timedelta(60))]
    assert found(run(spark, events, periods, 2, tmp_path, rng, parts=1)) == batch(events, periods)
    more = [("hot", "e1", 1, DAY + timedelta(89)), ("hot", "e2", 1, None)]
    revised = [("hot", "p", 1, DAY - timedelta(1), DAY + timedelta(30)), ("hot", "q", 0, DAY + timedelta(30), DAY + timedelta(95))]
    assert found(run(spark, more, revised, 1, tmp_path, rng, parts=1)) == batch(events + more, periods + revised)
