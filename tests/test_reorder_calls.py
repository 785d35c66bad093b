"""Every call of a state is a round trip to the JVM; a key makes few of them."""

from __future__ import annotations

import pandas as pd

from timelane.streaming.reorder import AT, InOrder


class _Handle:
    def __init__(self):
        self.calls, self.timers = 0, set()

    def getListState(self, name, schema):
        return _State(self)

    getValueState = getListState

    def listTimers(self):
        self.calls += 1
        return list(self.timers)

    def deleteTimer(self, at):
        self.calls += 1
        self.timers.discard(at)

    def registerTimer(self, at):
        self.calls += 1
        self.timers.add(at)


class _State:
    def __init__(self, handle):
        self.handle, self.value = handle, None

    def _count(self, value=None):
        self.handle.calls += 1
        return value

    def exists(self):
        return self._count(self.value is not None)

    def get(self):
        return self._count(self.value)

    def put(self, value):
        self.value = self._count(value)

    update = put

    def appendList(self, rows):
        self.value = self._count([*(self.value or []), *rows])

    def clear(self):
        self.value = self._count()


class _Times:
    def __init__(self, ms):
        self.ms = ms

    getCurrentWatermarkInMs = getExpiryTimeInMs = lambda self: self.ms


class _All(InOrder):
    def take(self, key, memory, rows):
        return (memory or 0) + len(rows), rows


def test_a_key_makes_few_calls_and_its_rows_come_in_order():
    fold, handle = _All(["ord"], None), _Handle()
    fold.init(handle)
    first = pd.DataFrame({AT: [3000, 1000, 9000], "ord": [2, 1, 3]})
    assert list(fold.handleInputRows((1,), iter([first]), _Times(0))) == []
    assert handle.calls <= 4 and handle.timers == {1}
    second = pd.DataFrame({AT: [2000], "ord": [4]})
    handle.calls = 0
    out = pd.concat(list(fold.handleInputRows((1,), iter([second]), _Times(5))))
    assert out["ord"].tolist() == [1, 4, 2] and handle.calls <= 6 and handle.timers == {9}
    handle.timers = set()
    handle.calls = 0
    out = pd.concat(list(fold.handleExpiredTimer((1,), _Times(9), _Times(9))))
    assert out["ord"].tolist() == [3] and handle.calls <= 4 and handle.timers == set()
