"""Event streams with time: deduplicated window statistics, and runs of like events in order of time.

Both keep state for as long as the watermark asks for and append a row when it can't change any more: a window when the watermark has
passed its end, a run when a later event of another kind has come and the watermark has passed that. Rows that come later than the
watermark are dropped, as the delay says.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from ..runtime import ship

STORE = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
    "spark.sql.streaming.stateStore.rocksdb.trackTotalNumberOfRows": "false",
}
RUNS = "anonymous boolean, user_id long, event_type string, first_us long, last_us long, n long, total double"
EVENT, RUN = ["anonymous", "user_id", "us", "event_id", "event_type", "value"], [c.split()[0] for c in RUNS.split(", ")]
#: Events that are dealt into buckets at once, and of the waiting ones that are one entry of the state.
PIECE = 262_144


def deduplicated(events: DataFrame, delay: str) -> DataFrame:
    """events with a watermark, each event_id once within it."""
    return events.withWatermark("ts", delay).dropDuplicatesWithinWatermark(["event_id"])


def window_statistics(events: DataFrame, size: str, slide: str, delay: str) -> DataFrame:
    """(event_type, start, end, n, total, users): events(event_id, ts, user_id, event_type, value) by window and type.

    users is a HyperLogLog estimate with 2 % standard deviation, as exact sets of users would be state without a bound.
    """
    grouped = deduplicated(events, delay).groupBy(F.window("ts", size, slide).alias("w"), "event_type")
    counted = grouped.agg(F.count("*").alias("n"), F.sum("value").alias("total"), F.approx_count_distinct("user_id", 0.02).alias("users"))
    return counted.select("event_type", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n", "total", "users")


class Runs(StatefulProcessor):
    """The events of a bucket of users in order of (user, ts, event_id); neighbours of one user and one type are a run, a null type is like no other.

    Events wait until the watermark has passed them, so the order in which they come within the delay doesn't matter. One timer stands
    at the earliest event that waits, and only it settles. State is that of the delay: waiting events and one open run a user. Both are kept as Arrow tables, since a message to the
    state store for each event or user takes far longer than the event itself.
    """

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", "events binary")
        self.open = handle.getValueState("open", "runs binary")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        earliest = []
        for frame in rows:
            self.waiting.appendList([(events,) for events in frame["events"]])
            earliest.append(int(frame["us"].min()))
        if earliest:
            self._wait(min(earliest))
        yield from ()

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        """Ends the runs that events before the watermark end, and waits for the next event."""
        pieces = [_table(events) for (events,) in self.waiting.get()]
        if not pieces:
            return
        waiting = pa.concat_tables(pieces).to_pandas()
        passed = (waiting["us"] <= timerValues.getCurrentWatermarkInMs() * 1000).to_numpy()
        rest = waiting[~passed]
        if passed.any():
            before = _table(self.open.get()[0]).to_pandas() if self.open.exists() else None
            ended, still = runs_of(before, waiting[passed])
            self.open.update((_packed(_from_pandas(still)),))
            if len(rest):
                left = _from_pandas(rest)
                self.waiting.put([(_packed(left.slice(i, PIECE)),) for i in range(0, len(rest), PIECE)])
            else:
                self.waiting.clear()
            if len(ended):
                yield ended
        if len(rest):
            self.handle.registerTimer(_milliseconds(int(rest["us"].min())))

    def _wait(self, us: int) -> None:
        """Has the one timer stand at an event at us, if it doesn't stand earlier."""
        at, timers = _milliseconds(us), list(self.handle.listTimers())
        if at < min(timers, default=at + 1):
            self.handle.registerTimer(at)
            for t in timers:
                self.handle.deleteTimer(t)

    def close(self) -> None:
        pass


def _milliseconds(us: int) -> int:
    """The first millisecond at us or later: the watermark has passed an event at us when it is there, and a timer there expires then."""
    return -(-us // 1000)


def _from_pandas(frame: pd.DataFrame) -> pa.Table:
    types = {"anonymous": pa.bool_(), "event_type": pa.string(), "value": pa.float64(), "total": pa.float64()}
    return pa.Table.from_pandas(frame, pa.schema([(c, types.get(c, pa.int64())) for c in frame.columns]), preserve_index=False).replace_schema_metadata()


def _packed(table: pa.Table) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, table.schema) as out:
        out.write_table(table)
    return sink.getvalue().to_pybytes()


def _table(data: bytes) -> pa.Table:
    return pa.ipc.open_stream(data).read_all()


def packed_events(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(bucket, us, events): rows of (bucket, *EVENT) as Arrow tables, one a bucket and PIECE rows, with the earliest time; a processor gets rows one by one."""
    held, n = [], 0
    for batch in batches:
        held.append(batch)
        n += batch.num_rows
        if n >= PIECE:
            yield _dealt(held)
            held, n = [], 0
    if n:
        yield _dealt(held)


def _dealt(batches: list[pa.RecordBatch]) -> pa.RecordBatch:
    rows = pa.Table.from_batches(batches).sort_by("bucket").combine_chunks()
    bucket, us, events = rows["bucket"].to_numpy(), rows["us"].to_numpy(), rows.select(EVENT).cast(pa.schema([rows.schema.field(c).with_nullable(True) for c in EVENT]))
    starts = np.flatnonzero(np.append(True, bucket[1:] != bucket[:-1]))
    packed = [_packed(events.slice(a, b - a)) for a, b in zip(starts, np.append(starts[1:], len(bucket)), strict=True)]
    return pa.record_batch({"bucket": pa.array(bucket[starts]), "us": pa.array(np.minimum.reduceat(us, starts)), "events": pa.array(packed, pa.binary())})


def runs_of(before: pd.DataFrame | None, events: pd.DataFrame) -> tuple[pd.DataFrame, pd.DataFrame]:
    """Runs that have ended and each user's last one, of open runs and of later events."""
    later = pd.DataFrame({"anonymous": events["anonymous"], "user_id": events["user_id"], "event_type": events["event_type"], "first_us": events["us"], "last_us": events["us"], "n": 1, "total": events["value"]})
    rows = later if before is None else pd.concat([before[RUN], later], ignore_index=True)
    old = len(rows) - len(later)
    event_id = np.concatenate([np.zeros(old, "int64"), events["event_id"].to_numpy("int64")])
    rows = rows.iloc[np.lexsort((event_id, rows["first_us"], np.arange(len(rows)) >= old, rows["user_id"], rows["anonymous"]))]
    kind, user, anonymous = pd.factorize(rows["event_type"])[0], rows["user_id"].to_numpy(), rows["anonymous"].to_numpy()
    other = np.concatenate([[True], (user[1:] != user[:-1]) | (anonymous[1:] != anonymous[:-1])])
    new = other | (kind < 0) | np.concatenate([[True], kind[1:] != kind[:-1]])
    starts = np.flatnonzero(new)
    found = rows.iloc[starts].reset_index(drop=True)
    found["last_us"] = rows["last_us"].to_numpy()[np.append(starts[1:], len(rows)) - 1]
    for c in ("n", "total"):
        found[c] = np.add.reduceat(rows[c].to_numpy(), starts)
    last = np.append(other[starts][1:], True)
    return found[~last], found[last]


def event_runs(events: DataFrame, delay: str, buckets: int = 1024) -> DataFrame:
    """(user_id, event_type, first_ts, last_ts, n, total): runs of events(event_id, ts, user_id, event_type, value) of one type, each event once.

    Rows without a user are a user's of their own; a null value counts as 0. Users are dealt into buckets, whose state is read and
    written as a whole: a bucket's waiting events and open runs have to fit in a task. Needs the RocksDB state store, see rocksdb().
    """
    ship(events.sparkSession)
    kept = deduplicated(events, delay).where("event_id IS NOT NULL")
    bucket, anonymous = F.pmod(F.xxhash64("user_id"), F.lit(buckets)).cast("int"), F.col("user_id").isNull()
    rows = kept.select(bucket.alias("bucket"), anonymous.alias("anonymous"), F.coalesce("user_id", F.lit(0)).cast("long").alias("user_id"), F.unix_micros("ts").alias("us"), F.col("event_id").cast("long").alias("event_id"), "event_type", F.coalesce("value", F.lit(0.0)).alias("value"))
    found = rows.mapInArrow(packed_events, "bucket int, us long, events binary").groupBy("bucket").transformWithStateInPandas(Runs(), RUNS, "Append", "EventTime")
    return found.select(F.when(~F.col("anonymous"), F.col("user_id")).alias("user_id"), "event_type", F.timestamp_micros("first_us").alias("first_ts"), F.timestamp_micros("last_us").alias("last_ts"), "n", "total")


@contextmanager
def rocksdb(spark: SparkSession):
    """Queries that are started inside keep their state in RocksDB, in two partitions a core at most.

    A batch commits its changes, not a snapshot of each partition's files. Opening and committing a partition takes half a second and
    more in each batch and operator however little it holds, so more partitions than that are slower; a large one lies on disk.
    """
    partitions = min(int(spark.conf.get("spark.sql.shuffle.partitions")), 2 * spark.sparkContext.defaultParallelism)
    now = STORE | {"spark.sql.shuffle.partitions": str(partitions)}
    before = {k: spark.conf.get(k, None) for k in now}
    for k, v in now.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def append(rows: DataFrame, path: str, checkpoint: str, trigger: dict | None = None) -> StreamingQuery:
    """Start appending rows to Parquet files under path; by default the query ends when what is there has been read."""
    return rows.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(**(trigger or {"availableNow": True})).start()
