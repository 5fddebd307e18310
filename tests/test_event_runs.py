from datetime import timedelta

import pandas as pd

from quillstone.streaming import windows

from .test_windows import SCHEMA, START, run


class State:
    """Stands for the state store of one key, and counts what is asked of it."""

    def __init__(self):
        self.rows, self.timers, self.calls = {}, set(), 0

    def __getattr__(self, name):
        if name.startswith(("get", "list", "put", "append", "update", "clear", "exists", "register", "delete")):
            self.calls += 1
        return {
            "getListState": lambda name, _: Part(self, name), "getValueState": lambda name, _: Part(self, name), "listTimers": lambda: iter(sorted(self.timers)),
            "registerTimer": self.timers.add, "deleteTimer": self.timers.discard,
        }[name]


class Part:
    def __init__(self, state, name):
        self.state, self.name = state, name

    def _rows(self):
        self.state.calls += 1
        return self.state.rows.setdefault(self.name, [])

    def get(self):
        rows = self._rows()
        return iter(list(rows)) if self.name == "waiting" else rows[-1]

    def exists(self):
        return bool(self._rows())

    def appendList(self, rows):
        self._rows().extend(rows)

    def put(self, rows):
        self._rows()[:] = rows

    def update(self, row):
        self._rows()[:] = [row]

    def clear(self):
        self._rows().clear()


class Now:
    def __init__(self, ms):
        self.ms = ms

    def getCurrentWatermarkInMs(self):
        return self.ms


def test_a_bucket_of_users_takes_few_messages():
    n = 5000
    events = pd.DataFrame({"anonymous": False, "user_id": [i % 100 for i in range(n)], "us": [i * 1000 for i in range(n)], "event_id": range(n), "event_type": ["a" if i // 200 % 2 else "b" for i in range(n)], "value": 0.5})
    state, runs = State(), windows.Runs()
    runs.init(state)
    blob = windows._packed(windows._from_pandas(events))
    list(runs.handleInputRows((7,), iter([pd.DataFrame({"bucket": [7], "us": [0], "events": [blob]})]), Now(0)))
    assert state.timers == {0}
    first = pd.concat(list(runs.handleExpiredTimer((7,), Now(2499), None)))
    second = pd.concat(list(runs.handleExpiredTimer((7,), Now(n), None)))
    found = pd.concat([first, second])
    # 25 runs of two events a user, the last of which is open
    assert len(found) == 100 * 24 and set(found["n"]) == {2} and set(found["total"]) == {1.0} and state.calls < 40
    assert len(found.drop_duplicates(["user_id", "first_us"])) == len(found) and len(first) == 100 * 12


def test_null_types_are_runs_of_their_own_as_in_the_sql():
    events = pd.DataFrame({"anonymous": False, "user_id": 1, "us": range(5), "event_id": range(5), "event_type": ["a", None, None, "a", "a"], "value": 1.0})
    ended, still = windows.runs_of(None, events)
    assert list(ended["n"]) == [1, 1, 1] and list(still["n"]) == [2]


def test_an_event_at_the_watermark_ends_a_run(spark, tmp_path):
    hour = timedelta(hours=1)
    batches = [
        [(1, START, 1, "a", 1.0), (2, START + 7 * hour, 2, "a", 1.0)],
        [(3, START + 8 * hour, 2, "a", 1.0)],
        [(4, START + 9 * hour, 1, "b", 1.0), (5, START + 15 * hour, 2, "a", 1.0)],
    ]
    for i, rows in enumerate(batches):
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.parquet(str(tmp_path / "in" / str(i)))
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(str(tmp_path / "in"))
    with windows.rocksdb(spark):
        found = run(spark, windows.event_runs(stream, "6 hours"), tmp_path)
    assert [tuple(r) for r in found] == [(1, "a", START, START, 1, 1.0)]
