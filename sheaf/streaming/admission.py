"""Rolling admission on an unbounded event stream, in order of event time.

An event's turn comes when the watermark has passed it: nothing older can arrive then,
so decisions are those of the batch form whatever the order of arrival.  Events wait in
map state by slices of time.  Its keys have a fixed width, slice first, so the store
hands entries out in order of time; a decision reads the slices that are over and stops
at the first that is not.  One timer a key stands at the end of its earliest slice.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator
from heapq import merge
from itertools import groupby

import numpy as np
from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import BinaryType, BooleanType, LongType, StringType, StructField, StructType

from ..operators.admission import admit_stamps
from .runs import use_rocksdb

STAMP = StructType([StructField("t", LongType())])
ENTRY_KEY = StructType([StructField("at", StringType())])
ENTRY = StructType([StructField("events", BinaryType())])
CLOCK = StructType([StructField("entries", LongType()), StructField("due", LongType())])
BIAS = 1 << 62  # slices before 1970 sort in front
HELD = 10_000  # events of a micro-batch in memory at once


def entry_key(part: int, number: int) -> str:
    return f"{part + BIAS:019d}{number:019d}"


def part_of(key: str) -> int:
    return int(key[:19]) - BIAS


class RollingAdmission(StatefulProcessor):
    """State per key: waiting events by slice, the admitted stamps inside the window (at
    most ``limit``), and when the timer is due (0: there is none).

    Events at or before the watermark are dropped by the engine, which counts them.  A
    slice is decided at once, so it is what has to fit in memory.
    """

    def __init__(self, limit: int, width: int, slice_width: int):
        self.limit = limit
        self.width = width
        self.slice_width = slice_width

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getMapState("waiting", ENTRY_KEY, ENTRY)
        self.stamps = handle.getListState("stamps", STAMP)
        self.clock = handle.getValueState("clock", CLOCK)

    def _due(self, part: int) -> int:
        """Milliseconds at which a slice is over."""
        return -(-(part + 1) * self.slice_width // 1000)

    def _set_timer(self, entries: int, old: int, due: int) -> None:
        if old and old != due:
            self.handle.deleteTimer(old)
        if due and old != due:
            self.handle.registerTimer(due)
        self.clock.update((entries, due))

    def _hold(self, held: list[tuple[int, int]], entries: int) -> int:
        held.sort()
        for part, events in groupby(held, key=lambda e: e[0] // self.slice_width):
            self.waiting.updateValue((entry_key(part, entries),), (np.array(list(events), "<i8").tobytes(),))
            entries += 1
        return entries

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        entries, due = self.clock.get() if self.clock.exists() else (0, 0)
        before, held, first = entries, [], None
        for row in rows:
            if row["event_id"] is None:  # only moves the watermark
                continue
            held.append((row["t"], row["event_id"]))
            first = row["t"] if first is None else min(first, row["t"])
            if len(held) == HELD:
                entries = self._hold(held, entries)
                held = []
        entries = self._hold(held, entries)
        if entries > before:
            mine = self._due(first // self.slice_width)
            # A timer that only clears old stamps gives way to one that decides.
            self._set_timer(entries, due, mine if not due or mine < due else due)
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        now = timerValues.getCurrentWatermarkInMs()
        stamps = deque(row[0] for row in self.stamps.get())
        entries, due = self.clock.get()
        out: list[Row] = []
        done: list[str] = []
        later = 0
        part, chunks, last = None, [], ""

        def decide() -> None:
            for t, event_id in merge(*(np.frombuffer(c, "<i8").reshape(-1, 2).tolist() for c in chunks)):
                out.append(Row(key=key[0], event_id=event_id, admitted=admit_stamps(stamps, t, self.limit, self.width)))

        for (at,), (events,) in self.waiting.iterator():
            if at <= last:
                raise RuntimeError("the state store gave entries out of order")
            last = at
            if self._due(part_of(at)) > now:
                later = self._due(part_of(at))
                break
            if part_of(at) != part:
                decide()
                part, chunks = part_of(at), []
            chunks.append(events)
            done.append(at)
        decide()
        for at in done:
            self.waiting.removeKey((at,))
        # What comes is newer than the watermark; what waits may not be.
        while not later and stamps and now * 1000 - stamps[0] >= self.width:
            stamps.popleft()
        if stamps:
            self.stamps.put([(t,) for t in stamps])
        else:
            self.stamps.clear()
        if not later and stamps:
            later = (stamps[-1] + self.width) // 1000 + 1  # clears a key that went quiet
        # The timer that has just expired is gone.
        self._set_timer(entries, 0 if due <= now else due, later)
        if not later and not stamps:
            self.clock.clear()
        return iter(out)

    def close(self) -> None:
        pass


def stream_admission(events: DataFrame, limit: int = 20, window_seconds: float = 60.0, delay: str = "10 minutes", slice_seconds: float | None = None) -> DataFrame:
    """``events``: key LONG, event_id LONG, ts TIMESTAMP → key, event_id, admitted.

    Order is (ts, event_id); events may arrive in any order within ``delay``.  Rows with
    a null event_id only move the watermark.  ``slice_seconds`` (a window, if unset) is
    what a decision may wait beyond the watermark.
    """
    use_rocksdb(events.sparkSession)
    width = int(window_seconds * 1_000_000)
    slices = width if slice_seconds is None else int(slice_seconds * 1_000_000)
    out = StructType(
        [StructField("key", LongType()), StructField("event_id", LongType()), StructField("admitted", BooleanType())]
    )
    return (
        events.select("key", "event_id", "ts", F.unix_micros("ts").alias("t"))
        .withWatermark("ts", delay)
        .groupBy("key")
        .transformWithState(
            statefulProcessor=RollingAdmission(limit, width, slices), outputStructType=out, outputMode="Append", timeMode="EventTime"
        )
    )
