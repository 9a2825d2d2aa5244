"""Lives of many keys share the state of a bucket: few calls of the store for all of them."""

from pyspark.sql import types as T

from jobsift.streaming import lifespans

GAP = 1_000_000


class Handle:
    """A store of one value and its timers that counts what is asked."""

    def __init__(self):
        self.calls, self.value, self.timers = 0, None, set()

    def getValueState(self, name, schema):
        return self

    def getCurrentWatermarkInMs(self):
        return self.now

    def get(self):
        self.calls += 1
        return self.value

    def update(self, value):
        self.calls, self.value = self.calls + 1, value

    def clear(self):
        self.calls, self.value = self.calls + 1, None

    def registerTimer(self, at):
        self.calls += 1
        self.timers.add(at)

    def deleteTimer(self, at):
        self.calls += 1
        self.timers.remove(at)


def test_a_bucket_of_keys_is_one_record():
    handle, lives = Handle(), lifespans.Lives(["k"], GAP)
    lives.init(handle)
    row = T.Row("k", "low", "high", "n")
    keys = [None, float("nan"), *map(float, range(500))]
    got = [*lives.handleInputRows((7,), iter([row(k, i, i + 5, 2) for i, k in enumerate(keys)]), None)]
    assert sorted(r.event for r in got) == ["opened"] * 502 and handle.calls == 3
    assert handle.timers == {-(-(5 + 2 * GAP) // 1000)}
    # one NaN is the other; a key that comes again within the gap stays in its life, beyond it opens the next
    got = [*lives.handleInputRows((7,), iter([row(float("nan"), 100, 100, 1), row(3.0, 3 * GAP, 3 * GAP, 1)]), None)]
    assert [(r.k, r.event, r.sightings) for r in got] == [(3.0, "closed", 2), (3.0, "opened", 0)]
    handle.now, handle.calls = 2 * GAP // 1000 + 2, 0
    expired = handle.timers.pop()
    got = [*lives.handleExpiredTimer((7,), handle, None)]
    assert expired < handle.now and len(got) == 501 and {r.event for r in got} == {"closed"} and handle.calls == 3
    assert sorted(r.sightings for r in got)[-2:] == [2, 3]
    assert handle.timers == {5 * GAP // 1000}
    handle.now = min(handle.timers) + 1
    handle.timers.clear()
    assert [r.k for r in lives.handleExpiredTimer((7,), handle, None)] == [3.0]
    assert handle.value is None and not handle.timers
