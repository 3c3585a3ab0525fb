"""How often a key of a stream calls its state."""

import pandas as pd

from tidemill.streaming import keyed


class Value:
    def __init__(self, calls):
        self.v, self.calls = None, calls

    def exists(self):
        self.calls.append("exists")
        return self.v is not None

    def get(self):
        return self.v

    def update(self, v):
        self.calls.append("update")
        self.v = v

    def clear(self):
        self.v = None


class Handle:
    def __init__(self):
        self.calls, self.timers = [], []

    def getValueState(self, name, fields):
        return Value(self.calls)

    def listTimers(self):
        self.calls.append("list")
        return iter(list(self.timers))

    def deleteTimer(self, t):
        self.timers.remove(t)

    def registerTimer(self, t):
        self.timers.append(t)


def test_a_key_of_many_changes_calls_its_state_once():
    at = pd.to_datetime([0, 1, 2, 3, 4, 5, 6], unit="D")
    retries, handle = keyed.Retries("k", "at", "ok", 3, 400), Handle()
    retries.init(handle)
    rows = pd.DataFrame({"at": at, "ok": [False, True, False, True, False, True, False]})
    (out,) = retries.handleInputRows((7,), iter([rows[:4], rows[4:]]), None)
    assert out.values.tolist() == [[7, 1, "done", 1], [7, 1, "done", 2], [7, 1, "done", 3], [7, 1, "pending", 4]]
    assert handle.calls == ["exists", "exists", "update", "update"] and len(handle.timers) == 1
    (out,) = retries.handleInputRows((7,), iter([rows[:1]]), None)
    assert out.values.tolist() == [[7, 2, "pending", 5]] and len(handle.timers) == 1

    seen, handle = keyed.FirstSeen("k", "at", 2), Handle()
    seen.init(handle)
    (out,) = seen.handleInputRows((7,), iter([pd.DataFrame({"at": at[[0, 4, 1]]})]), None)
    assert out[["state", "version"]].values.tolist() == [["expired", 1], ["new", 2]] and "list" not in handle.calls
