"""Structured Streaming forms of the detectors.

Streams carry items (channel, ts timestamp, ...). Late items count in every
window still open; a tick that fired is never computed again.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from tidewatch.checkpoints import checkpointed
from tidewatch.operators.lifecycle import EVENTS, Settings, State, evaluate, roll_up, sample

STATE = "bins map<bigint,bigint>, history array<bigint>, elevated boolean, since bigint, next_tick bigint"


def event_stream(spark: SparkSession, path: str, files_per_trigger: int = 64) -> DataFrame:
    """The events table as a stream of items; path is a file, a folder or a pattern."""
    schema = spark.read.parquet(path).schema
    pattern = path if any(c in path for c in "*?[{") else f"{path[:-1]}[{path[-1]}]"  # a lone file is read as a pattern only
    raw = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(pattern)
    return raw.select(F.col("event_id").alias("id"), F.col("event_type").alias("channel"), F.col("ts").cast("timestamp").alias("ts"), F.col("user_id").alias("author"))


def sliding_counts(items: DataFrame, ttl: str = "2 hours", step: str = "5 minutes", late: str = "10 minutes") -> DataFrame:
    """channel, tick, n over windows that end at a tick, the tick's second included (whole seconds, so a start offset of one).

    Items are counted once per step; those counts, not the items, enter every
    window that holds their step.
    """
    whole = items.withColumn("ts", F.date_trunc("second", "ts")).withWatermark("ts", late)
    steps = whole.groupBy("channel", F.window("ts", step, step, "1 second").alias("s")).agg(F.count("*").alias("own"))
    w = F.window(F.window_time("s"), ttl, step, "1 second")
    return steps.groupBy("channel", w.alias("w")).agg(F.sum("own").alias("n")).select("channel", (F.unix_timestamp("w.end") - 1).alias("tick"), "n")


def distinct_items(items: DataFrame, late: str = "10 minutes") -> DataFrame:
    """Items less repeats of an id that arrive within the watermark."""
    return items.withWatermark("ts", late).dropDuplicatesWithinWatermark(["id"])


def sessions(items: DataFrame, gap: str = "10 minutes", late: str = "10 minutes") -> DataFrame:
    """channel, start, end, n: runs of a channel's items with no gap that long."""
    grouped = items.withWatermark("ts", late).groupBy("channel", F.session_window("ts", gap).alias("w")).agg(F.count("*").alias("n"))
    return grouped.select("channel", F.unix_timestamp("w.start").alias("start"), F.unix_timestamp("w.end").alias("end"), "n")


def detect(items: DataFrame, settings: Settings | None = None, late: str = "10 minutes") -> DataFrame:
    """Start, update and release events by the batch detector's steps, state per channel.

    Counts are held per evaluation step. Ticks before a channel's newest item
    fire; while it is elevated or its window holds items, those before the
    watermark do too, so a channel that falls silent is released.
    """
    s = settings or Settings()
    names = [x.split()[0] for x in EVENTS.split(", ")]

    def step(key: tuple, frames: Iterator[pd.DataFrame], group: GroupState) -> Iterator[pd.DataFrame]:
        bins, history, elevated, since, nxt = ({}, [], False, 0, 0)
        if group.exists:
            held, history, elevated, since, nxt = group.get
            bins = dict(held)
        state = State(elevated=bool(elevated), since=int(since))
        state.history.extend(int(x) for x in history)
        newest = group.getCurrentWatermarkMs() // 1000 if group.hasTimedOut else 0
        for pdf in frames:
            if pdf.empty:  # a timeout brings no rows
                continue
            sec = (pdf["ts"].astype("int64") // _unit(pdf["ts"])).astype("int64")
            newest = max(newest, int(sec.max()))
            for tick, n in (-(-sec // s.eval_step) * s.eval_step).value_counts().items():
                bins[int(tick)] = bins.get(int(tick), 0) + int(n)
        out = []
        if newest and (nxt or bins):
            nxt = int(nxt) or min(bins)
            while nxt < newest:
                count = sum(n for tick, n in bins.items() if nxt - s.ttl < tick <= nxt)
                if event := evaluate(state, key[0], nxt, count, s):
                    out.append(event)
                if nxt % s.base_step == 0:
                    sample(state, count, s)
                nxt += s.eval_step
                bins = {t: n for t, n in bins.items() if t > nxt - s.ttl}
        group.update((bins, list(state.history), state.elevated, state.since, nxt))
        if state.elevated or bins:
            group.setTimeoutTimestamp(max(1000 * (nxt + 1), group.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame(out, columns=names)

    timed = items.withWatermark("ts", late)
    return timed.groupBy("channel").applyInPandasWithState(step, EVENTS, STATE, "append", GroupStateTimeout.EventTimeTimeout)


def _unit(ts: pd.Series) -> int:
    """Units of a timestamp column in a second."""
    return {"s": 1, "ms": 10**3, "us": 10**6, "ns": 10**9}[ts.dt.unit]


def run_available(stream: DataFrame, path: str, checkpoint: str, mode: str = "append") -> None:
    """Process what is there, into Parquet."""
    query = stream.writeStream.outputMode(mode).format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()


#: How a surge's record merges with what a later batch says of it.
_FIRST, _MOST, _LATEST = ("first_seen", "opening_z"), ("last_seen", "released_at", "closing_z", "peak_z", "peak_count"), ("mean", "std")


def merge_surges(parts: DataFrame) -> DataFrame:
    """One lifecycle record (as roll_up gives) per surge of records that cover different batches of its events."""
    merged = [F.min(c).alias(c) for c in _FIRST] + [F.max(c).alias(c) for c in _MOST] + [F.sum("update_count").alias("update_count")] + [F.max_by(c, "last_seen").alias(c) for c in _LATEST]
    out = parts.groupBy("channel", "event_start").agg(*merged)
    return out.withColumn("duration_s", F.col("released_at") - F.col("event_start")).select(parts.columns)


class LifecycleSink:
    """foreachBatch body that keeps lifecycle records and a summary of detector events, whatever is replayed.

    Everything is written under the batch's number, from the state before that
    batch and its own events alone, so a batch that comes again after a failure
    replaces what it had written. Work follows the batch and the open surges:
    released ones leave the state for `lifecycles`, and the summary's totals carry
    over. keep: so many batches of state stay for replays.
    """

    def __init__(self, folder: str, keep: int = 4) -> None:
        self.folder, self.keep = folder, keep

    def _before(self, spark: SparkSession, table: str, batch: int, schema) -> DataFrame:
        at = f"{self.folder}/{table}/batch={batch - 1}"
        return spark.read.schema(schema).parquet(at) if batch > 0 and _exists(spark, at) else spark.createDataFrame([], schema)

    def __call__(self, events: DataFrame, batch: int) -> None:
        spark = events.sparkSession
        own = roll_up(events)
        merged = checkpointed(merge_surges(self._before(spark, "open", batch, own.schema).unionByName(own)))
        over, still = merged.where("released_at IS NOT NULL"), merged.where("released_at IS NULL")
        over.write.mode("overwrite").parquet(f"{self.folder}/lifecycles/batch={batch}")
        still.write.mode("overwrite").parquet(f"{self.folder}/open/batch={batch}")
        counts = lambda rows: rows.groupBy("channel").agg(F.count("*").alias("fires"), F.max("peak_z").alias("max_z"), F.max("last_seen").alias("last_seen"), F.count_if(F.col("released_at").isNull()).alias("active"), F.sum("update_count").alias("updates"))
        told = counts(over)
        add = lambda rows: rows.groupBy("channel").agg(F.sum("fires").alias("fires"), F.max("max_z").alias("max_z"), F.max("last_seen").alias("last_seen"), F.sum("active").alias("active"), F.sum("updates").alias("updates"))
        totals = checkpointed(add(self._before(spark, "totals", batch, told.schema).unionByName(told)))
        totals.write.mode("overwrite").parquet(f"{self.folder}/totals/batch={batch}")
        add(totals.unionByName(counts(still))).coalesce(1).write.mode("overwrite").json(f"{self.folder}/summary")
        for table in ("open", "totals"):
            _gone(spark, f"{self.folder}/{table}/batch={batch - self.keep}")

    def lifecycles(self, spark: SparkSession) -> DataFrame:
        """Records of all surges: released ones, and those open after the last batch."""
        over = spark.read.parquet(f"{self.folder}/lifecycles")
        files, at = _folder(spark, f"{self.folder}/open")
        last = max(int(x.getPath().getName().split("=")[1]) for x in files.listStatus(at))
        still = spark.read.schema(over.drop("batch").schema).parquet(f"{self.folder}/open/batch={last}")
        return over.drop("batch").unionByName(still)


def _folder(spark: SparkSession, path: str):
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()), at


def _exists(spark: SparkSession, path: str) -> bool:
    files, at = _folder(spark, path)
    return bool(files.exists(at))


def _gone(spark: SparkSession, path: str) -> None:
    files, at = _folder(spark, path)
    files.delete(at, True)
