"""Deduplication of clicks in windows that expire, as a stateful stream.

A click_id's first row opens a window; rows of it whose hour is at most 72 after
the window's start repeat it, and one that lies later closes it and opens
another. Windows that no row can reach any more close by event-time timers.

State is a ValueState in RocksDB under transformWithStateInPandas: the opener
(its hour and hash), the counters and the checksums of every open window of a
bucket of click_ids, as packed columns. With one click_id per bucket
(buckets=None) that is a state per click_id; then each key costs several round
trips between Python and the JVM, in every batch and at every timer, so buckets
by hash hold some thousand click_ids each and are folded at once. Their number
follows the input. Rows alike in click_id, hour and hash are one row with a
count before the stream reads them.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from tidewatch.llm.common import shared_folder

#: Hours after its start at which a window still takes repeats, and hours that a row may lag behind the largest.
REACH, LATENESS = 72, 48
BATCHES = 12
#: Rows of a bucket, and of a partition of the state, in one batch, about.
BUCKET_ROWS, PARTITION_ROWS = 15_000, 60_000

_HOUR = 3_600_000
#: Timers and watermark stand between whole hours, so that neither depends on how Spark treats equal times.
_TIMER_SHIFT, _WATERMARK_SHIFT = _HOUR // 4, "30 minutes"

_OUT = "click_id long, start_hour long, closed_batch long, n_repeats long, n_conflicts long, conflict_crc long, hash string"
_COUNTS = ("click_id", "start_hour", "n_repeats", "n_conflicts", "conflict_crc")
_PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def window_starts(segment: np.ndarray, hour: np.ndarray, start: np.ndarray, reach: int) -> np.ndarray:
    """Which rows begin a window, or go on with the open one at their segment's head.

    Rows are sorted by hour within segments (numbered from 0); start has the open
    window's start hour for each segment, or the first row's hour where none is.
    All segments step from window to window at once.
    """
    low = min(hour.min(), start.min())
    span = int(max(hour.max(), start.max()) - low) + reach + 2
    key = segment * span + (hour - low)
    ends = np.searchsorted(segment, np.arange(len(start)), "right")
    begins = np.zeros(len(hour), bool)
    begins[np.searchsorted(segment, np.arange(len(start)))] = True
    own, current = np.arange(len(start)), start.astype(np.int64)
    while len(own):
        after = np.searchsorted(key, own * span + (current - low) + reach, "right")
        more = after < ends[own]
        own, after = own[more], after[more]
        begins[after] = True
        current = hour[after]
    return begins


def fold(held: dict[str, np.ndarray], rows: dict[str, np.ndarray], reach: int) -> tuple[dict[str, np.ndarray], dict[str, np.ndarray]]:
    """(open, closed) windows after rows (click_id, hour, hash, crc, n) meet the open ones (sorted by click_id, hashes as S32)."""
    order = np.lexsort((rows["hash"], rows["hour"], rows["click_id"]))
    rows = {k: v[order] for k, v in rows.items()}
    ids, segment = np.unique(rows["click_id"], return_inverse=True)
    first = np.searchsorted(segment, np.arange(len(ids)))
    place = np.minimum(np.searchsorted(held["click_id"], ids), max(len(held["click_id"]) - 1, 0))
    known = held["click_id"][place] == ids if len(held["click_id"]) else np.zeros(len(ids), bool)
    goes_on, start = known.copy(), rows["hour"][first].copy()
    goes_on[known] = rows["hour"][first[known]] <= held["start_hour"][place[known]] + reach
    start[goes_on] = held["start_hour"][place[goes_on]]
    begins = window_starts(segment, rows["hour"], start, reach)

    # a window per run of rows; those that go on take what the state has of them
    at, window = np.flatnonzero(begins), np.cumsum(begins) - 1
    made = {"click_id": rows["click_id"][at], "start_hour": rows["hour"][at].copy(), "hash": rows["hash"][at].copy()}
    made |= {k: np.zeros(len(at), np.int64) for k in ("n_repeats", "n_conflicts", "conflict_crc")}
    on = np.flatnonzero(goes_on[segment[at]] & (at == first[segment[at]]))
    for name in made:
        made[name][on] = held[name][place[segment[at[on]]]]
    other = rows["hash"] != made["hash"][window]
    fresh = np.ones(len(at), np.int64)
    fresh[on] = 0
    made["n_repeats"] += np.add.reduceat(rows["n"], at) - fresh
    made["n_conflicts"] += np.add.reduceat(np.where(other, rows["n"], 0), at)
    made["conflict_crc"] += np.add.reduceat(np.where(other, rows["n"] * rows["crc"], 0), at)

    last = np.append(segment[at][1:] != segment[at][:-1], True)
    replaced = np.zeros(len(held["click_id"]), bool)
    replaced[place[known]] = True
    over = np.zeros(len(held["click_id"]), bool)
    over[place[known & ~goes_on]] = True
    closed = {k: np.concatenate([held[k][over], made[k][~last]]) for k in made}
    still = {k: np.concatenate([held[k][~replaced], made[k][last]]) for k in made}
    order = np.argsort(still["click_id"], kind="stable")
    return {k: v[order] for k, v in still.items()}, closed


class ExpiringWindows(StatefulProcessor):
    """The open windows of a bucket. What the last batch left out of reach closes first, under that batch's number, then the rows of this one are folded."""

    def __init__(self, batch: int, reach: int) -> None:
        self.batch, self.reach = batch, reach

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.windows = handle.getValueState("windows", ", ".join(f"{k} binary" for k in (*_COUNTS, "hash")))

    def _held(self) -> dict[str, np.ndarray]:
        kept = self.windows.get() or [b""] * 6
        return {k: np.frombuffer(bytes(v), "<i8") for k, v in zip(_COUNTS, kept, strict=False)} | {"hash": np.frombuffer(bytes(kept[5]), "S32")}

    def _keep(self, held: dict[str, np.ndarray]) -> None:
        if not len(held["click_id"]):
            self.windows.clear()
            return
        self.windows.update(tuple(held[k].tobytes() for k in (*_COUNTS, "hash")))
        self.handle.registerTimer((int(held["start_hour"].min()) + self.reach) * _HOUR + _TIMER_SHIFT)

    def _rows(self, closed: dict[str, np.ndarray], batch: int) -> Iterator[pd.DataFrame]:
        n = len(closed["click_id"])
        if n:
            yield pd.DataFrame({"click_id": closed["click_id"], "start_hour": closed["start_hour"], "closed_batch": np.full(n, batch), **{k: closed[k] for k in _COUNTS[2:]}, "hash": [h.ljust(32, b"\0").hex() for h in closed["hash"].tolist()]})

    def _parted(self, held: dict[str, np.ndarray], watermark: int) -> tuple[dict[str, np.ndarray], dict[str, np.ndarray]]:
        """(windows still open, windows that no row can reach)."""
        over = (held["start_hour"] + self.reach) * _HOUR + _TIMER_SHIFT < watermark
        return {k: v[~over] for k, v in held.items()}, {k: v[over] for k, v in held.items()}

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        watermark = timerValues.getCurrentWatermarkInMs()
        frame = pd.concat(list(rows), ignore_index=True)
        # the sentinel only moves the watermark; rows behind it are late
        frame = frame[frame["hash"].notna() & (frame["hour"] * _HOUR >= watermark)]
        if not len(frame):
            return
        held, over = self._parted(self._held(), watermark)
        yield from self._rows(over, self.batch - 1)
        given = {k: frame[k].to_numpy(np.int64) for k in ("click_id", "hour", "crc", "n")} | {"hash": np.array(frame["hash"].tolist(), "S32")}
        held, closed = fold(held, given, self.reach)
        self._keep(held)
        yield from self._rows(closed, self.batch)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        held, over = self._parted(self._held(), timerValues.getCurrentWatermarkInMs())
        if len(over["click_id"]):
            self._keep(held)
            yield from self._rows(over, self.batch - 1)


def _since_1970(stamp: str) -> Column:
    """UTC microseconds since 1970 of a timestamp, with or without a zone."""
    return F.expr(f"timestampdiff(MICROSECOND, timestamp_ntz'1970-01-01 00:00:00', CAST({stamp} AS TIMESTAMP_NTZ))")


def replayed_copies(clicks: DataFrame, batches: int = BATCHES) -> DataFrame:
    """(batch, click_id, hour, hash, n): copies 0 to click_id % 3 of every row, each shifted and sent to a batch by its checksum.

    Equal rows are one row with their number n; hash has the 32 bytes of the
    digest. Rows without a click_id or an arrival have neither key nor time and
    give no copies; other nulls are empty text. Values that are not numbers count
    as Spark's floor has them.
    """
    cents = F.floor(100 * F.col("value") + 0.5).cast("string")
    parts = [F.col("client_id").cast("string"), F.col("kind"), cents, _since_1970("ts").cast("string"), F.col("props")]
    content = F.concat_ws("|", *[F.coalesce(p, F.lit("")) for p in parts])
    hour = F.floor(_since_1970("arrived_at") / F.lit(3_600_000_000)).cast("long")
    rows = clicks.where("click_id IS NOT NULL AND arrived_at IS NOT NULL AND click_id % 3 >= 0")
    rows = rows.select(F.col("click_id").cast("long"), hour.alias("hour"), content.alias("content")).groupBy("click_id", "hour", "content").agg(F.count("*").alias("n"))
    bounds = _dealt(clicks.where("click_id IS NOT NULL AND arrived_at IS NOT NULL AND click_id % 3 >= 0").select(F.col("click_id").cast("long"), hour.alias("hour")))
    low, high = bounds.agg(F.min("L"), F.max("L")).first()
    if low is None:
        low = high = 0
    batch = F.floor((F.col("L") - F.lit(low)) * batches / F.lit(high - low + 1)).cast("int")
    digest = F.unhex(F.sha2(F.concat_ws("|", "content", (F.col("c") % 3).cast("string")), 256))
    return _dealt(rows).select(batch.alias("batch"), "click_id", "hour", digest.alias("hash"), "n")


def _dealt(rows: DataFrame) -> DataFrame:
    """A row for every copy, with its checksum c, its shifted hour and the time L of its delivery."""
    copies = rows.withColumn("j", F.explode(F.sequence(F.lit(0), (F.col("click_id") % 3).cast("int"))))
    copies = copies.withColumn("c", F.crc32(F.concat_ws(":", F.col("click_id").cast("string"), F.col("j").cast("string")).cast("binary")))
    copies = copies.withColumn("hour", F.col("hour") + 6 * F.col("j") * (F.col("c") % 10))
    return copies.withColumn("L", F.col("hour") + F.floor(F.col("c") / 10) % 200)


def _renamed(spark: SparkSession, old: str, new: str) -> bool:
    """Move a folder that exists; one rename shows a batch to the stream whole."""
    path = spark._jvm.org.apache.hadoop.fs.Path
    files = path(old).getFileSystem(spark._jsc.hadoopConfiguration())
    return bool(files.exists(path(old))) and bool(files.rename(path(old), path(new)))


def expiring_windows(rows: DataFrame, batches: int, buckets: int | None = 0, reach: int = REACH, lateness: int = LATENESS) -> DataFrame:
    """One row per window of rows (batch, click_id, hour, hash, n), which a stream reads batch by batch.

    Returned: click_id, start_hour, closed_batch, n_repeats, n_conflicts, conflict_crc, hash (hex).
    The stream is started anew for each batch on one checkpoint, in a new folder
    under spark.checkpoint.dir, and each start is one micro-batch, the last one two. Rows more than
    `lateness` hours behind the largest hour of earlier batches, which is what the
    watermark has seen, are dropped. What a batch leaves out of reach is closed
    when the next one comes, by a timer if the bucket has no rows then, and told
    the number of the batch that left it; after the last one a sentinel row beyond
    all hours comes. Within a batch rows go by hour, then hash. An empty
    table gives no rows. Hours are counted from 1970 and positive. buckets: how many buckets of click_ids, 0 for a number
    that follows the rows, None for a state per click_id. Other columns are not read.
    """
    spark = rows.sparkSession
    folder = f"{shared_folder(spark)}/windows-{uuid.uuid4().hex}"
    staged, source = f"{folder}/staged", f"{folder}/in"
    kept = ["click_id", "hour", "hash", "n"]
    rows.select("batch", *kept).write.partitionBy("batch").parquet(staged)
    known = spark.read.schema("click_id long, hour long, hash binary, n long, batch int").parquet(staged)
    total, highest = known.agg(F.count("*"), F.max("hour")).first()
    if not total:
        return spark.createDataFrame([], _OUT)
    parts = max(2, total // (batches * PARTITION_ROWS))
    if buckets == 0:
        buckets = max(4 * parts, total // (batches * BUCKET_ROWS))
    bucket = F.col("click_id") if buckets is None else F.pmod(F.xxhash64("click_id"), F.lit(buckets))

    # state partitions last as long as the query, so they follow the rows; each start's stores are closed when their task ends, since the next start opens its own; the checkpoint lives for this call, so its files need no checksums beside them
    settings = {"spark.sql.streaming.stateStore.providerClass": _PROVIDER, "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true", "spark.sql.streaming.stateStore.unloadOnCommit": "true", "spark.sql.streaming.minBatchesToRetain": "2", "spark.sql.streaming.noDataMicroBatches.enabled": "false", "spark.sql.streaming.checkpoint.fileChecksum.enabled": "false", "spark.sql.shuffle.partitions": str(parts)}
    before = {k: spark.conf.get(k, None) for k in settings}
    for k, v in settings.items():
        spark.conf.set(k, v)
    try:
        spark.createDataFrame([], "click_id long, hour long, hash binary, n long").write.parquet(f"{source}/none")
        for batch in range(batches + 1):
            if batch == batches or not _renamed(spark, f"{staged}/batch={batch}", f"{source}/b{batch}"):
                # a batch without rows still closes what the one before it left out of reach; the last row moves the watermark beyond all
                hour = highest + 2 * reach + 2 * lateness if batch == batches else 0
                spark.createDataFrame([(-1, hour, None, 0)], "click_id long, hour long, hash binary, n long").coalesce(1).write.parquet(f"{source}/b{batch}")
            # only the last start goes on without data, to where its row has moved the watermark
            spark.conf.set("spark.sql.streaming.noDataMicroBatches.enabled", str(batch == batches).lower())
            given = spark.readStream.schema("click_id long, hour long, hash binary, n long").parquet(f"{source}/*")
            given = given.select(bucket.alias("bucket"), *kept, F.crc32(F.lower(F.hex("hash")).cast("binary")).alias("crc"), F.timestamp_seconds(F.col("hour") * 3600).alias("event"))
            folded = given.withWatermark("event", f"{lateness} hours {_WATERMARK_SHIFT}").groupBy("bucket").transformWithStateInPandas(ExpiringWindows(batch, reach), _OUT, "Append", "EventTime")
            query = folded.writeStream.format("parquet").option("checkpointLocation", f"{folder}/checkpoint").option("path", f"{folder}/out").outputMode("append").trigger(availableNow=True).start()
            query.awaitTermination()
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    return spark.read.schema(_OUT).parquet(f"{folder}/out")
