"""The detector with a frozen baseline, as one step function for batch and streams.

While a channel is elevated its baseline repeats the last sample, so history and
state depend on each other and no window frame expresses them. The fold runs per
channel over ticks: its input follows the clock, not the item count.
"""

from __future__ import annotations

import math
from collections import deque
from dataclasses import dataclass, field
from statistics import median

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidewatch.operators.detection import BASE_STEP, COOLDOWN, EVAL_STEP, HISTORY, MAD_CHANNELS, MAD_EPSILON, MIN_COUNT, MIN_HISTORY, TTL, Z_ENTER, Z_LEAVE, sliding_counts


@dataclass
class Settings:
    ttl: int = TTL
    eval_step: int = EVAL_STEP
    base_step: int = BASE_STEP
    keep: int = HISTORY
    min_history: int = MIN_HISTORY
    min_count: int = MIN_COUNT
    enter: float = Z_ENTER
    leave: float = Z_LEAVE
    robust: tuple[str, ...] = MAD_CHANNELS
    detect_from: int = 0


@dataclass
class State:
    """What a channel remembers between ticks."""

    history: deque = field(default_factory=deque)
    elevated: bool = False
    since: int = 0


def score(history, count: int, robust: bool, min_history: int) -> tuple[float | None, float, float]:
    """(z or None, centre, spread)."""
    if len(history) < min_history:
        return None, 0.0, 0.0
    if robust:
        centre = median(history)
        spread = median(abs(x - centre) for x in history)
        return ((count - centre) / (spread + MAD_EPSILON) if spread else None), float(centre), float(spread)
    n, total, squares = len(history), sum(history), sum(x * x for x in history)
    spread = math.sqrt(max(0, n * squares - total * total)) / n
    return ((count - total / n) / spread if spread else None), total / n, spread


def evaluate(state: State, channel: str, now: int, count: int, s: Settings) -> dict | None:
    """An evaluation tick: the event it raises, if any."""
    if now < s.detect_from or count < s.min_count and not state.elevated:
        return None
    z, mean, std = score(state.history, count, channel in s.robust, s.min_history)
    if z is None:
        return None
    was = state.elevated
    if not was and z >= s.enter:
        state.elevated, state.since, kind = True, now, "start"
    elif was and z <= s.leave:
        state.elevated, kind = False, "release"
    elif was:
        kind = "update"
    else:
        return None
    return {"channel": channel, "tick": now, "event_type": kind, "event_start": state.since, "count": count, "z_score": round(z, 4), "mean": round(mean, 3), "std": round(std, 3)}


def sample(state: State, count: int, s: Settings) -> None:
    """A baseline tick: the window's count enters history, or the last sample again while elevated."""
    state.history.append(state.history[-1] if state.elevated and state.history else count)
    while len(state.history) > s.keep:
        state.history.popleft()


EVENTS = "channel string, tick long, event_type string, event_start long, count long, z_score double, mean double, std double"


def detect(items: DataFrame, settings: Settings | None = None) -> DataFrame:
    """Start, update and release events of all channels; at one moment evaluation precedes the baseline."""
    s = settings or Settings()
    counts = sliding_counts(items, s.ttl, s.eval_step)

    def fold(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("tick")
        channel, state, out = pdf.channel.iloc[0], State(), []
        for now, count in zip(pdf.tick.tolist(), pdf.n.tolist(), strict=True):
            if event := evaluate(state, channel, now, count, s):
                out.append(event)
            if now % s.base_step == 0:
                sample(state, count, s)
        return pd.DataFrame(out, columns=[x.split()[0] for x in EVENTS.split(", ")])

    return counts.groupBy("channel").applyInPandas(fold, EVENTS)


def gate(events: DataFrame, cooldown: int = COOLDOWN, kinds: tuple[str, ...] | None = None) -> DataFrame:
    """Events that pass: per channel the first, then each more than `cooldown` after the last that passed.

    With kinds, others pass untouched.
    """
    schema = events.schema

    def greedy(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("tick")
        last, keep = None, []
        for tick, kind in zip(pdf.tick.tolist(), pdf.event_type.tolist(), strict=True):
            if kinds and kind not in kinds:
                keep.append(True)
                continue
            keep.append(last is None or tick - last > cooldown)
            if keep[-1]:
                last = tick
        return pdf[keep]

    return events.groupBy("channel").applyInPandas(greedy, schema)


def roll_up(events: DataFrame) -> DataFrame:
    """One lifecycle record per surge; a release without its start gives a minimal record."""
    of = lambda kind, c: F.max(F.when(F.col("event_type") == kind, F.col(c)))
    began, ended = of("start", "tick"), of("release", "tick")
    return events.groupBy("channel", "event_start").agg(
        began.alias("first_seen"), F.max("tick").alias("last_seen"), ended.alias("released_at"), of("start", "z_score").alias("opening_z"), of("release", "z_score").alias("closing_z"),
        F.max("z_score").alias("peak_z"), F.max("count").alias("peak_count"), F.count_if(F.col("event_type") == "update").alias("update_count"), (ended - F.col("event_start")).alias("duration_s"),
        F.max_by("mean", "tick").alias("mean"), F.max_by("std", "tick").alias("std"),
    )


def snapshot_ticks(events: DataFrame) -> DataFrame:
    """channel, event_start, phase, tick: of each surge the tick that opened it, and the last update that raised its peak z or count.

    events: channel, tick, event_type, event_start, count, z_score. A surge
    whose updates never pass its opening has no peak row.
    """
    so_far = Window.partitionBy("channel", "event_start").orderBy("tick").rowsBetween(Window.unboundedPreceding, -1)
    rises = (F.col("z_score") > F.max("z_score").over(so_far)) | (F.col("count") > F.max("count").over(so_far))
    seen = events.where("event_type IN ('start', 'update')").withColumn("rises", rises)
    opening = seen.where("event_type = 'start'").select("channel", "event_start", F.lit("opening").alias("phase"), "tick")
    peak = seen.where("event_type = 'update' AND rises").groupBy("channel", "event_start").agg(F.lit("peak").alias("phase"), F.max("tick").alias("tick"))
    return opening.unionByName(peak.select("channel", "event_start", "phase", "tick"))
