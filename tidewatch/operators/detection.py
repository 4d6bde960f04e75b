"""Window counts, baselines, scores and the hysteresis trigger, per channel.

Items are counted once into step-wide bins; every later window is a frame over
bins, so work after the first aggregation follows the clock, not the item count.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Defaults of the live detector.
TTL, EVAL_STEP, BASE_STEP = 7200, 300, 3600
HISTORY, MIN_HISTORY, MIN_COUNT = 168, 24, 10
Z_ENTER, Z_LEAVE, COOLDOWN = 3.0, 2.0, 1800
MAD_CHANNELS, MAD_EPSILON = ("news", "worldnews"), 1e-6


def span(items: DataFrame) -> tuple[int, int]:
    """First and last second of items."""
    row = items.agg(F.min("sec"), F.max("sec")).first()
    return (int(row[0]), int(row[1])) if row[0] is not None else (0, -1)


def _up(sec, step: int) -> Column:
    return -F.floor(-sec / F.lit(step)) * step


def sliding_counts(items: DataFrame, ttl: int = TTL, step: int = EVAL_STEP) -> DataFrame:
    """channel, tick, n: items with tick - ttl < sec <= tick, for every tick from the first item to the last; ttl is a multiple of step."""
    first, last = span(items)
    bins = items.groupBy("channel", _up(F.col("sec"), step).cast("long").alias("tick")).agg(F.count("*").alias("own"))
    lo, hi = -(-first // step) * step, -(-last // step) * step
    if hi < lo:
        return bins.select("channel", "tick", F.col("own").alias("n")).where("false")
    ticks = bins.select("channel").distinct().select("channel", F.explode(F.sequence(F.lit(lo).cast("long"), F.lit(hi).cast("long"), F.lit(step).cast("long"))).alias("tick"))
    frame = Window.partitionBy("channel").orderBy("tick").rangeBetween(step - ttl, 0)
    return ticks.join(bins, ["channel", "tick"], "left").select("channel", "tick", F.coalesce(F.sum("own").over(frame), F.lit(0)).alias("n"))


def baseline(counts: DataFrame, base_step: int = BASE_STEP, keep: int = HISTORY) -> DataFrame:
    """channel, base, n, h, total, squares: of each baseline tick its count, and size, sum and squares of the history up to it."""
    frame = Window.partitionBy("channel").orderBy("base").rowsBetween(1 - keep, 0)
    own = counts.where(F.col("tick") % base_step == 0).select("channel", F.col("tick").alias("base"), "n")
    return own.select("channel", "base", "n", F.count("*").over(frame).alias("h"), F.sum("n").over(frame).alias("total"), F.sum(F.col("n") * F.col("n")).over(frame).alias("squares"))


def z_scores(counts: DataFrame, base_step: int = BASE_STEP, keep: int = HISTORY, min_history: int = MIN_HISTORY) -> DataFrame:
    """channel, tick, n, mean, std, z: against the history strictly before the tick.

    Evaluation precedes the baseline's own tick, so a tick at a baseline moment
    does not see it. z is null while history is short or its deviation is 0.
    """
    base = baseline(counts, base_step, keep).select("channel", "base", "h", "total", "squares")
    before = (F.floor((F.col("tick") - 1) / base_step) * base_step).cast("long")
    both = counts.withColumn("base", before).join(base, ["channel", "base"], "left")
    ready = F.col("h") >= min_history
    mean = F.when(ready, F.col("total") / F.col("h"))
    std = F.when(ready, F.sqrt((F.col("h") * F.col("squares") - F.col("total") * F.col("total")).cast("double")) / F.col("h"))
    scored = both.select("channel", "tick", "n", mean.alias("mean"), std.alias("std"))
    return scored.withColumn("z", F.when(F.col("std") > 0, (F.col("n") - F.col("mean")) / F.col("std")))


def _median(values: Column) -> Column:
    n = F.size(values)
    ordered = F.array_sort(values)
    half = (n / 2).cast("int")
    return F.when(n % 2 == 1, F.get(ordered, half)).otherwise((F.get(ordered, half - 1) + F.get(ordered, half)) / 2)


def robust_z(counts: DataFrame, base_step: int = BASE_STEP, keep: int = HISTORY, min_history: int = MIN_HISTORY) -> DataFrame:
    """channel, tick, n, median, mad, z: distance from the median over the unscaled median absolute deviation; null where that is 0."""
    frame = Window.partitionBy("channel").orderBy("base").rowsBetween(1 - keep, 0)
    own = counts.where(F.col("tick") % base_step == 0).select("channel", F.col("tick").alias("base"), "n")
    history = own.select("channel", "base", F.collect_list(F.col("n").cast("double")).over(frame).alias("history")).where(F.size("history") >= min_history)
    stats = history.withColumn("median", _median(F.col("history"))).withColumn("mad", _median(F.transform("history", lambda x: F.abs(x - F.col("median"))))).drop("history")
    before = (F.floor((F.col("tick") - 1) / base_step) * base_step).cast("long")
    both = counts.withColumn("base", before).join(stats, ["channel", "base"], "left").drop("base")
    return both.withColumn("z", F.when(F.col("mad") > 0, (F.col("n") - F.col("median")) / (F.col("mad") + MAD_EPSILON)))


def trigger(scored: DataFrame, min_count: int = MIN_COUNT, enter: float = Z_ENTER, leave: float = Z_LEAVE) -> DataFrame:
    """scored with elevated and event_type (start, update, release or null), history running on while elevated.

    The state follows the last decisive tick: z >= enter with enough items, or z <= leave.
    """
    time = Window.partitionBy("channel").orderBy("tick")
    decides = F.when((F.col("z") >= enter) & (F.col("n") >= min_count), 1).when(F.col("z") <= leave, 0)
    state = scored.withColumn("elevated", F.coalesce(F.last(decides, ignorenulls=True).over(time.rowsBetween(Window.unboundedPreceding, 0)), F.lit(0)))
    state = state.withColumn("was", F.lag("elevated", 1, 0).over(time))
    kind = F.when((F.col("elevated") == 1) & (F.col("was") == 0), "start").when((F.col("elevated") == 0) & (F.col("was") == 1), "release").when((F.col("elevated") == 1) & F.col("z").isNotNull(), "update")
    return state.withColumn("event_type", kind).drop("was")


def surges(triggered: DataFrame) -> DataFrame:
    """One row per surge of triggered ticks: channel, event_start, last_seen, released_at, peak_z, peak_count, updates, opening_z, closing_z."""
    time = Window.partitionBy("channel").orderBy("tick")
    acts = triggered.where("event_type IS NOT NULL").withColumn("event_start", F.last(F.when(F.col("event_type") == "start", F.col("tick")), ignorenulls=True).over(time.rowsBetween(Window.unboundedPreceding, 0)))
    of = lambda kind, c: F.max(F.when(F.col("event_type") == kind, F.col(c)))
    return acts.groupBy("channel", "event_start").agg(
        F.max("tick").alias("last_seen"), of("release", "tick").alias("released_at"), F.max("z").alias("peak_z"), F.max("n").alias("peak_count"),
        F.count_if(F.col("event_type") == "update").alias("updates"), of("start", "z").alias("opening_z"), of("release", "z").alias("closing_z"),
    )


def in_order(rows: DataFrame, by: str, *ties: str, width: int = 86400) -> DataFrame:
    """rows with nth, from 1, in the order of a column of seconds; sorted span by span, so that the spans' numbers alone meet in one task."""
    spans = rows.withColumn("_span", F.floor(F.col(by) / width))
    counts = spans.groupBy("_span").agg(F.count("*").alias("_n"))
    before = counts.select("_span", (F.sum("_n").over(Window.orderBy("_span")) - F.col("_n")).alias("_before"))
    own = F.row_number().over(Window.partitionBy("_span").orderBy(by, *ties))
    return spans.withColumn("_own", own).join(before, "_span").withColumn("nth", F.col("_before") + F.col("_own")).drop("_span", "_own", "_before")


def recurring(events: DataFrame, tolerance: int = 2700, recent: int = 50) -> DataFrame:
    """events (event_id, channel, event_start, released_at) with the newest earlier event of the channel at about the same time of day.

    Only the `recent` last closed of all channels before it count; the day does
    not wrap. Events meet on (channel, bucket of `recent` closures).
    """
    closed = in_order(events.where("released_at IS NOT NULL"), "released_at", "event_id")
    bucket = F.floor(F.col("nth") / recent)
    seen = closed.select("event_id", "channel", "event_start", "nth", (F.col("event_start") % 86400).alias("day_time"), bucket.alias("bucket"))
    prior = seen.select("channel", F.explode(F.array("bucket", F.col("bucket") + 1)).alias("bucket"), F.col("event_id").alias("prior_id"), F.col("nth").alias("prior_no"), F.col("day_time").alias("prior_time"))
    met = seen.join(prior, ["channel", "bucket"]).where((F.col("prior_no") < F.col("nth")) & (F.col("prior_no") >= F.col("nth") - recent) & (F.abs(F.col("day_time") - F.col("prior_time")) <= tolerance))
    newest = met.groupBy("event_id").agg(F.max_by("prior_id", "prior_no").alias("recurs"))
    return seen.select("event_id", "channel", "event_start").join(newest, "event_id", "left")


def tumbling_scores(items: DataFrame, width: int = 3600, keep: int = 24, min_history: int = 2, enter: float = Z_ENTER) -> DataFrame:
    """channel, window_start, n, mean, std, z, fires over floor-aligned windows; a channel's history holds only windows in which it was seen."""
    start = (F.floor(F.col("sec") / width) * width).cast("long")
    own = items.groupBy("channel", start.alias("window_start")).agg(F.count("*").alias("n"))
    frame = Window.partitionBy("channel").orderBy("window_start").rowsBetween(-keep, -1)
    h, total, squares = F.count("*").over(frame), F.sum("n").over(frame), F.sum(F.col("n") * F.col("n")).over(frame)
    own = own.select("*", h.alias("h"), total.alias("total"), squares.alias("squares"))
    ready = F.col("h") >= min_history
    own = own.withColumn("mean", F.when(ready, F.col("total") / F.col("h"))).withColumn("std", F.when(ready, F.sqrt((F.col("h") * F.col("squares") - F.col("total") * F.col("total")).cast("double")) / F.col("h")))
    own = own.withColumn("z", F.when(F.col("std") > 0, (F.col("n") - F.col("mean")) / F.col("std")))
    return own.select("channel", "window_start", "n", "mean", "std", "z", (F.coalesce(F.col("z"), F.lit(0.0)) >= enter).alias("fires"))


def tumbling_robust(items: DataFrame, width: int = 3600, keep: int = 24, min_history: int = 2, enter: float = Z_ENTER) -> DataFrame:
    """channel, window_start, n, median, mad, z, fires: tumbling_scores for volatile channels, by median and unscaled median absolute deviation.

    A deviation of 0 is no exception here: any rise above the median fires then.
    """
    start = (F.floor(F.col("sec") / width) * width).cast("long")
    own = items.groupBy("channel", start.alias("window_start")).agg(F.count("*").alias("n"))
    frame = Window.partitionBy("channel").orderBy("window_start").rowsBetween(-keep, -1)
    own = own.withColumn("history", F.collect_list(F.col("n").cast("double")).over(frame))
    own = own.withColumn("median", F.when(F.size("history") >= min_history, _median(F.col("history"))))
    own = own.withColumn("mad", F.when(F.col("median").isNotNull(), _median(F.transform("history", lambda x: F.abs(x - F.col("median"))))))
    own = own.withColumn("z", (F.col("n") - F.col("median")) / (F.col("mad") + MAD_EPSILON))
    return own.select("channel", "window_start", "n", "median", "mad", "z", (F.coalesce(F.col("z"), F.lit(0.0)) >= enter).alias("fires"))


def arrival_clock(items: DataFrame, nth: str = "nth", width: int = 100_000) -> DataFrame:
    """items with clock, the largest sec that had arrived by then, in an order of arrival numbered by a column: a late item takes the time that the feed had reached.

    A running maximum found span by span: each span of arrivals has its own, and
    the spans' maxima alone meet in one task.
    """
    placed = items.withColumn("_span", F.floor(F.col(nth) / width))
    most = placed.groupBy("_span").agg(F.max("sec").alias("_most"))
    before = most.select("_span", F.max("_most").over(Window.orderBy("_span").rowsBetween(Window.unboundedPreceding, -1)).alias("_before"))
    own = F.max("sec").over(Window.partitionBy("_span").orderBy(nth).rowsBetween(Window.unboundedPreceding, 0))
    return placed.withColumn("_own", own).join(before, "_span").withColumn("clock", F.greatest("_own", "_before")).drop("_span", "_own", "_before")


def tumbling_arrivals(items: DataFrame, nth: str = "nth", width: int = 3600, keep: int = 24, min_history: int = 2, enter: float = Z_ENTER, robust: bool = False) -> DataFrame:
    """tumbling_scores (or tumbling_robust) of items in the order they arrive: one late item counts in the window then open, none is lost."""
    clocked = arrival_clock(items, nth).select("channel", F.col("clock").alias("sec"))
    return (tumbling_robust if robust else tumbling_scores)(clocked, width, keep, min_history, enter)


def sample_rank(by: list[str], key: list[str], seed: int = 0) -> Column:
    """Rank of a row in a reproducible random order within groups; keep ranks up to a cap for a uniform sample."""
    order = F.md5(F.encode(F.concat_ws(":", F.lit(str(seed)), *[F.col(k).cast("string") for k in key]), "UTF-8"))
    return F.row_number().over(Window.partitionBy(*by).orderBy(order, *key))
