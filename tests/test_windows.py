import random
from collections import defaultdict
from datetime import datetime, timedelta

import pytest

from quillstone.streaming.windows import append, event_runs, rocksdb, window_statistics

SCHEMA = "event_id long, ts timestamp, user_id long, event_type string, value double"
START = datetime(2024, 3, 1)


@pytest.fixture(scope="module")
def rows():
    """Events in order of time, but for those within two hours of each other, with repeated ones and nulls."""
    rng = random.Random(9)
    out = [(i, START + timedelta(minutes=17 * i, milliseconds=i), rng.choice((1, 2, None)), rng.choice("aab"), None if i % 13 == 0 else float(i % 7)) for i in range(150)]
    out += [r for r in out if r[0] % 10 == 3]
    return sorted(out, key=lambda r: r[1] + timedelta(minutes=rng.randint(0, 120)))


def streamed(spark, rows, tmp_path):
    for i in range(5):
        spark.createDataFrame(rows[i * len(rows) // 5 : (i + 1) * len(rows) // 5], SCHEMA).coalesce(1).write.parquet(str(tmp_path / "in" / str(i)))
    return spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(str(tmp_path / "in"))


def run(spark, df, tmp_path):
    append(df, str(tmp_path / "out"), str(tmp_path / "state")).awaitTermination()
    return spark.read.schema(df.schema).parquet(str(tmp_path / "out")).collect()


def test_runs_in_order_of_time(spark, rows, tmp_path):
    with rocksdb(spark):
        found = run(spark, event_runs(streamed(spark, rows, tmp_path), "6 hours"), tmp_path)
    passed = max(r[1] for r in rows) - timedelta(hours=6)
    users, want = defaultdict(list), []
    for r in sorted(set(rows), key=lambda r: r[1]):
        if r[1] <= passed:
            users[r[2]].append(r)
    for user, events in users.items():
        runs = []
        for r in events:
            if runs and runs[-1][1] == r[3]:
                runs[-1] = (*runs[-1][:3], r[1], runs[-1][4] + 1, runs[-1][5] + (r[4] or 0))
            else:
                runs.append((user, r[3], r[1], r[1], 1, r[4] or 0))
        want += runs[:-1]
    assert sorted(map(str, (tuple(r) for r in found))) == sorted(map(str, ((*w[:4], w[4], float(w[5])) for w in want))) and len(want) > 20


def test_windows_count_each_event_once(spark, rows, tmp_path):
    found = run(spark, window_statistics(streamed(spark, rows, tmp_path), "4 hours", "2 hours", "6 hours"), tmp_path)
    passed, want = max(r[1] for r in rows) - timedelta(hours=6), defaultdict(list)
    for r in set(rows):
        first = START + timedelta(hours=2 * int((r[1] - START) / timedelta(hours=2)))
        for begin in (first, first - timedelta(hours=2)):
            if begin + timedelta(hours=4) <= passed:
                want[(r[3], begin)].append(r)
    got = {(r["event_type"], r["start"]): (r["n"], r["total"], r["users"]) for r in found}
    assert got == {k: (len(v), sum(r[4] or 0 for r in v), len({r[2] for r in v} - {None})) for k, v in want.items()} and len(got) > 20
