"""names wait in buckets, so that state is read once a batch and bucket and not once a name."""

import pyarrow as pa

from cytolake.streaming import mates


def _part(*rows):
    blank = {f: None for f in mates._HELD.names}
    return pa.Table.from_pylist([{**blank, "name": n, "rname": r, "at": at, "due": due} for n, r, at, due in rows], mates._HELD)


def test_a_name_is_due_after_the_first_part_that_it_is_in():
    parts = [_part(("x", "a", 50, None), ("x", "a", 40, None), ("y", "a", 7, 30)), _part(("x", "a", 10, None), ("x", "b", 60, None), (None, "a", 5, None))]
    rows, group, due = mates.due_of(parts, 100)
    told = {(n, r): int(due[g]) for n, r, g in zip(rows["name"].to_pylist(), rows["rname"].to_pylist(), group)}
    assert told == {("x", "a"): 140, ("y", "a"): 30, ("x", "b"): 160, (None, "a"): 105}


def test_a_bucket_holds_many_names_with_one_timer():
    class Value:
        def __init__(self):
            self.v = None

        exists = lambda self: self.v is not None
        get = lambda self: self.v

        def update(self, v):
            self.v = v

        def clear(self):
            self.v = None

    class List(Value):
        appendValue = lambda self, v: self.update([*(self.v or []), v])
        get = lambda self: iter(self.v or [])

    class Handle:
        def __init__(self):
            self.timers, self.values = set(), {}

        def getListState(self, name, schema):
            return self.values.setdefault(name, List())

        def getValueState(self, name, schema):
            return self.values.setdefault(name, Value())

        def registerTimer(self, at):
            self.timers.add(at)

        def deleteTimer(self, at):
            self.timers.remove(at)

    class Times:
        def __init__(self, at):
            self.at = at

        getCurrentWatermarkInMs = getExpiryTimeInMs = lambda self: self.at

    handle, held = Handle(), mates.HeldMates(100)
    held.init(handle)
    assert not list(held.handleInputRows((1,), iter([_part(*((f"n{k}", "a", k, None) for k in range(50, 90))).to_pandas()]), None))
    assert not list(held.handleInputRows((1,), iter([_part(*((f"n{k}", "a", 10 + k, None) for k in range(60))).to_pandas()]), None))
    assert handle.timers == {110} and len(handle.values["held"].v) == 2
    gone = [x for t in held.handleExpiredTimer((1,), Times(161), Times(110)) for x in zip(t["name"], t["r"])]
    # those first seen in the first part are due by their times there
    assert {n for n, _ in gone} == {f"n{k}" for k in [*range(50), *range(50, 61)]}
    assert {n: len(r) for n, r in gone}["n55"] == 2 and {n: len(r) for n, r in gone}["n60"] == 1
    assert len(handle.values["held"].v) == 1 and handle.values["next"].v == (161,)
