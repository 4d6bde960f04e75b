"""Tracked events and gated alerts as streams, with state per channel."""

from __future__ import annotations

import json
from collections.abc import Iterator
from contextlib import contextmanager

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from tidewatch.operators import consolidation as M
from tidewatch.operators.lifecycle import COOLDOWN
from tidewatch.schema import TRACKED_EVENT

#: State of transformWithStateInPandas lives in RocksDB.
PROVIDER = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


@contextmanager
def rocksdb(spark: SparkSession) -> Iterator[None]:
    """Streams of this session that start inside keep their state in RocksDB."""
    name, value = PROVIDER
    before = spark.conf.get(name, None)
    spark.conf.set(name, value)
    try:
        yield
    finally:
        spark.conf.unset(name) if before is None else spark.conf.set(name, before)


class Kept:
    """A MapState of JSON as a mapping."""

    def __init__(self, state) -> None:
        self.state = state

    def get(self, key):
        found = self.state.getValue((key,))
        return None if found is None else json.loads(found[0])

    def __setitem__(self, key, value) -> None:
        self.state.updateValue((key,), (json.dumps(value),))

    def pop(self, key, default=None):
        found = self.get(key)
        if found is not None:
            self.state.removeKey((key,))
        return default if found is None else found


class TrackEvents(StatefulProcessor):
    """Open events of a (source, channel), an inverted index to them, and when each falls stale.

    A candidate reads the events that its keywords and top conversation name, no
    others. An event's timer goes off STALE_SECONDS after it was last seen.
    """

    names = tuple(x.split()[0] for x in TRACKED_EVENT.split(", "))

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.events = Kept(handle.getMapState("events", "number long", "event string"))
        self.index = Kept(handle.getMapState("index", "mark string", "numbers string"))
        self.due = Kept(handle.getMapState("due", "at long", "numbers string"))
        self.number = handle.getValueState("number", "number long")

    def _told(self, events: list[dict]) -> Iterator[pd.DataFrame]:
        if events:
            yield pd.DataFrame(events, columns=self.names)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        frame = pd.concat(list(rows), ignore_index=True)
        frame = frame[frame["candidate_id"].notna()]  # others only move the watermark
        live = M.OpenEvents(self.events, self.index, (self.number.get() or (0,))[0])
        for c in M.in_order(frame):
            number = live.take(c)
            at = self.events.get(number)["last_seen"] + M.STALE_SECONDS
            self.due[at] = [*(self.due.get(at) or []), number]
            self.handle.registerTimer(1000 * at + 1)
        self.number.update((live.number,))
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        at = (expiredTimerInfo.getExpiryTimeInMs() - 1) // 1000
        live = M.OpenEvents(self.events, self.index)
        waiting = dict.fromkeys(self.due.pop(at) or [])
        stale = [n for n in waiting if (event := self.events.get(n)) and event["last_seen"] + M.STALE_SECONDS == at]
        yield from self._told([live.close(n) for n in stale])


def track_events(candidates: DataFrame, late: str = "1 hour") -> DataFrame:
    """Tracked events (schema.TRACKED_EVENT) of a stream of candidates, each written when it falls stale.

    The rows are those of consolidation.consolidate() if no candidate comes later
    than `late` after a newer one, and if of those in one micro-batch none starts
    before one of an earlier batch. Candidates without an id only move the
    watermark: one far in the future closes what is open. It must be started
    with its state in RocksDB (inside rocksdb()).
    """
    rows = M.event_candidates(candidates).withColumn("_at", F.timestamp_seconds("window_start")).withWatermark("_at", late)
    return rows.groupBy("source", "channel").transformWithStateInPandas(TrackEvents(), TRACKED_EVENT, "Append", "EventTime")


class Gate(StatefulProcessor):
    """The tick of the last event of a channel that passed."""

    def __init__(self, cooldown: int, kinds: tuple[str, ...] | None) -> None:
        self.cooldown, self.kinds = cooldown, kinds

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.last = handle.getValueState("last", "tick long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        frame = pd.concat(list(rows), ignore_index=True).sort_values("tick", kind="stable")
        held = self.last.get()
        last, keep = held[0] if held else None, []
        for tick, kind in zip(frame["tick"].tolist(), frame["event_type"].tolist(), strict=True):
            judged = not self.kinds or kind in self.kinds
            keep.append(not judged or last is None or tick - last > self.cooldown)
            if judged and keep[-1]:
                last = tick
        if last is not None:
            self.last.update((int(last),))
        yield frame[keep]


def gate(events: DataFrame, cooldown: int = COOLDOWN, kinds: tuple[str, ...] | None = None) -> DataFrame:
    """lifecycle.gate() of a stream: detector events that pass, in order of their micro-batches; a restart does not forget the cooldown. It must be started inside rocksdb()."""
    return events.groupBy("channel").transformWithStateInPandas(Gate(cooldown, kinds), events.schema, "Append", "None")
