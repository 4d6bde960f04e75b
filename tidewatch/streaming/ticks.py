"""The detector by the wall clock: ticks that begin with a channel's first item and are caught up when they are overdue."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from tidewatch.operators.lifecycle import EVENTS, Settings, State, evaluate, sample

EVAL, BASE = "evaluation", "baseline"


def due(next_eval: int, next_base: int, now: int, s: Settings) -> Iterator[tuple[str, int]]:
    """Overdue ticks in their order, of two at one time the evaluation first."""
    while min(next_eval, next_base) <= now:
        if next_eval <= next_base:
            yield EVAL, next_eval
            next_eval += s.eval_step
        else:
            yield BASE, next_base
            next_base += s.base_step


class Clocked:
    """What a channel knows between ticks: counts per second of the last window, and the detector's state."""

    def __init__(self, kept: dict | None = None) -> None:
        kept = kept or {}
        self.seconds = {int(k): n for k, n in kept.get("seconds", {}).items()}
        self.state = State(elevated=kept.get("elevated", False), since=kept.get("since", 0))
        self.state.history.extend(kept.get("history", []))
        self.next = kept.get("next")

    def kept(self) -> dict:
        return {"seconds": self.seconds, "elevated": self.state.elevated, "since": self.state.since, "history": list(self.state.history), "next": self.next}

    def take(self, seconds: Iterator[int]) -> None:
        for sec in seconds:
            self.seconds[int(sec)] = self.seconds.get(int(sec), 0) + 1

    def run(self, channel: str, now: int, s: Settings) -> list[dict]:
        """The events of all ticks that are due at a moment; the first call only sets the clock."""
        if self.next is None:
            self.next = [now + s.eval_step, now + s.base_step]
        out = []
        for kind, at in due(*self.next, now, s):
            count = sum(n for sec, n in self.seconds.items() if at - s.ttl < sec <= at)
            if kind == EVAL:
                if event := evaluate(self.state, channel, at, count, s):
                    out.append(event)
                self.next[0] = at + s.eval_step
            else:
                sample(self.state, count, s)
                self.next[1] = at + s.base_step
            self.seconds = {sec: n for sec, n in self.seconds.items() if sec > min(self.next) - s.ttl}
        return out


class WallClock(StatefulProcessor):
    """Clocked, kept per channel; a timer at the next tick."""

    def __init__(self, settings: Settings) -> None:
        self.settings = settings

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.kept = handle.getValueState("kept", "kept string")

    def _step(self, key: tuple, seconds: list, now_ms: int) -> Iterator[pd.DataFrame]:
        found = self.kept.get()
        own = Clocked(json.loads(found[0]) if found else None)
        own.take(seconds)
        events = own.run(key[0], now_ms // 1000, self.settings)
        self.kept.update((json.dumps(own.kept()),))
        self.handle.registerTimer(1000 * min(own.next))
        if events:
            yield pd.DataFrame(events, columns=[x.split()[0] for x in EVENTS.split(", ")])

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        yield from self._step(key, [sec for frame in rows for sec in frame["sec"].tolist()], timerValues.getCurrentProcessingTimeInMs())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        yield from self._step(key, [], timerValues.getCurrentProcessingTimeInMs())


def detect_by_clock(items: DataFrame, settings: Settings | None = None) -> DataFrame:
    """Detector events of a stream of items (channel, ts) at ticks of the wall clock, every eval_step and base_step seconds from a channel's first item.

    After a pause all overdue ticks are made up for in their order, each over the
    window that ends at it. A silent channel is evaluated too. It must be started
    inside tracking.rocksdb(), with a trigger by time: one that ends when all is read
    never ends here, since a tick is always due.
    """
    rows = items.select("channel", F.unix_timestamp("ts").alias("sec"))
    return rows.groupBy("channel").transformWithStateInPandas(WallClock(settings or Settings()), EVENTS, "Append", "ProcessingTime")
