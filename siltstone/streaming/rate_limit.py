"""Fixed windows that open at a key's first event: batch and streaming.

A window opens with the first event, lasts ``window_s`` seconds, and the next
event at or after its end opens another. Denied events count as well. This is
neither an aligned window nor a session, so it is a fold over a key's events.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import ExpiredTimerInfo, StatefulProcessor, StatefulProcessorHandle, TimerValues


def request_key(scope: Column, address: Column, agent: Column) -> Column:
    who = F.concat_ws("|", F.coalesce(address, F.lit("unknown")), F.coalesce(agent, F.lit("")))
    return F.concat_ws(":", scope, F.substring(F.sha2(who, 256), 1, 24))


def limited(events: DataFrame, key: str, ts: str, limit: int, window_s: int, order: str) -> DataFrame:
    """Every event with allowed, remaining and reset_at.

    Rows are dealt out by key and sorted, and each task walks through its sorted
    rows with the state of one key at a time: no key's events are ever gathered,
    however many it has, though all of them pass one task, as a window's begin
    depends on all that came before. Keys keep their values; null is a key like any
    other. An event without a time stamp belongs to no window: it is not allowed,
    has nothing remaining, no reset_at, and counts for no other event.
    """
    names = [c for c in events.columns if c not in ("allowed", "remaining", "reset_at")]
    seconds = "__us"
    timed = events.select(*names).withColumn(seconds, F.unix_micros(F.col(ts).cast("timestamp")))
    rows = timed.filter(F.col(seconds).isNotNull())
    dealt = rows.repartition(key).sortWithinPartitions(key, seconds, order)
    span = window_s * 1_000_000

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, count, reset = object(), 0, 0
        for batch in batches:
            if not batch.num_rows:
                continue
            keys = batch.column(names.index(key))
            codes = keys.dictionary_encode().indices.fill_null(-1).to_numpy(zero_copy_only=False)
            times = batch.column(len(names)).to_numpy(zero_copy_only=False)
            heads = np.r_[0, np.flatnonzero(np.diff(codes)) + 1, len(codes)]
            nth, ends = np.empty(len(codes), dtype=np.int64), np.empty(len(codes), dtype=np.int64)
            for first, end in zip(heads[:-1].tolist(), heads[1:].tolist(), strict=True):
                own = keys[first].as_py()
                if own != last:
                    last, count, reset = own, 0, times[first]
                at = first
                while at < end:  # a step for each window, not for each event
                    if reset <= times[at]:
                        count, reset = 0, int(times[at]) + span
                    to = at + int(np.searchsorted(times[at:end], reset))
                    nth[at:to] = np.arange(count + 1, count + 1 + to - at)
                    ends[at:to] = reset
                    count, at = count + to - at, to
            told = [pa.array(nth <= limit), pa.array(np.maximum(0, limit - nth).astype(np.int32)), pa.array(ends)]
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(names)], *told], names=[*names, "allowed", "remaining", "reset_us"])

    schema = ", ".join(f"`{c}` {events.schema[c].dataType.simpleString()}" for c in names) + ", allowed boolean, remaining int, reset_us long"
    told = dealt.mapInArrow(run, schema).withColumn("reset_at", F.timestamp_micros("reset_us")).drop("reset_us")
    outside = timed.filter(F.col(seconds).isNull()).select(*names, F.lit(False).alias("allowed"), F.lit(0).alias("remaining"), F.lit(None).cast("timestamp").alias("reset_at"))
    return told.unionByName(outside)


class _Windows(StatefulProcessor):
    """The windows of one key. Events wait until the watermark has passed them, so they
    are counted in the order of their times, in whatever order they arrive; a timer
    wakes the key then, and again when its window is over and it can be forgotten."""

    def __init__(self, limit: int, window_s: int) -> None:
        self.limit, self.span = limit, window_s * 1_000_000

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.window = handle.getValueState("window", "count long, reset long")
        self.waiting = handle.getListState("waiting", "us long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues: TimerValues) -> Iterator[pd.DataFrame]:
        new = [int(us) for frame in rows for us in frame["us"]]
        if new:
            if self.waiting.exists():
                self.waiting.appendList([(us,) for us in new])
            else:
                self.waiting.put([(us,) for us in new])
            self._wake(min(new))
        return iter(())

    def handleExpiredTimer(self, key, timerValues: TimerValues, expiredTimerInfo: ExpiredTimerInfo) -> Iterator[pd.DataFrame]:
        due = timerValues.getCurrentWatermarkInMs() * 1000
        waiting = sorted(r[0] for r in self.waiting.get()) if self.waiting.exists() else []
        ready, later = [us for us in waiting if us <= due], [us for us in waiting if us > due]
        count, reset = self.window.get() if self.window.exists() else (0, None)
        out = []
        for us in ready:
            if reset is None or reset <= us:
                count, reset = 0, us + self.span
            count += 1
            out.append((key[0], pd.Timestamp(us, unit="us"), count <= self.limit, max(0, self.limit - count), pd.Timestamp(reset, unit="us")))
        if later:
            self.waiting.put([(us,) for us in later])
            self._wake(later[0])
        elif self.waiting.exists():
            self.waiting.clear()
        if reset is not None and reset > due:
            self.window.update((count, reset))
            self._wake(reset)
        elif self.window.exists():
            self.window.clear()
        if out:
            yield pd.DataFrame(out, columns=["key", "ts", "allowed", "remaining", "reset_at"])

    def _wake(self, us: int) -> None:
        self.handle.registerTimer(us // 1000 + 1)

    def close(self) -> None:
        pass


def limited_stream(events: DataFrame, key: str, ts: str, limit: int, window_s: int, late: str = "1 minute") -> DataFrame:
    """The same over a stream, as (key, ts, allowed, remaining, reset_at): an event is
    told once the watermark has passed it. Events that come later than ``late`` and
    events without a time stamp are left out; a key without an open window and
    without waiting events has no state. Needs the RocksDB state store."""
    kind = events.schema[key].dataType.simpleString()
    timed = events.select(F.col(key).alias("key"), F.col(ts).cast("timestamp").alias("ts")).filter("ts is not null").withColumn("us", F.unix_micros("ts"))
    return timed.withWatermark("ts", late).groupBy("key").transformWithStateInPandas(_Windows(limit, window_s), f"key {kind}, ts timestamp, allowed boolean, remaining int, reset_at timestamp", "append", "eventTime")
