"""What a surge's window held when it opened and at its peak, and what that says of the surge."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewatch.functions.vocabulary import FEED_DOMAINS

#: Lengths of lists and texts, and thresholds of the flags.
TOP_WORDS, TOP_NAMES, POSTS, HEAD, POST_WIDTH, MOST_ITEMS = 10, 5, 5, 80, 200, 500
FEED_ITEMS, FEED_SHARE, SOURCE_ITEMS, AUTHOR_SHARE, DOMAIN_SHARE, ALIKE_SHARE = 100, 0.60, 50, 0.40, 0.35, 0.25


def window_items(items: DataFrame, ticks: DataFrame, ttl: int, most: int | None = MOST_ITEMS) -> DataFrame:
    """Items of each tick's window (tick - ttl < sec <= tick, the channel's own) with the columns of ticks, at most `most`, a reproducible sample; pos counts them by time.

    With most None all items stay, and pos is (sec, id), so that no task orders a window.

    items: id, channel, sec, ...; ticks: channel, tick, .... A window meets the
    items of the two buckets of ttl seconds that it touches, so ticks and items
    join on (channel, bucket).
    """
    own = [c for c in ticks.columns if c != "channel"]
    reach = F.explode(F.array(F.floor((F.col("tick") - ttl + 1) / ttl), F.floor(F.col("tick") / ttl))).alias("_bucket")
    wide = ticks.select("*", reach).distinct()
    met = items.withColumn("_bucket", F.floor(F.col("sec") / ttl)).join(wide, ["channel", "_bucket"]).where((F.col("sec") <= F.col("tick")) & (F.col("sec") > F.col("tick") - ttl))
    if most is None:
        return met.withColumn("pos", F.struct("sec", "id")).drop("_bucket")
    drawn = F.row_number().over(Window.partitionBy("channel", *own).orderBy(F.xxhash64("id"), "id"))
    met = met.withColumn("_drawn", drawn).where(F.col("_drawn") <= most)
    return met.withColumn("pos", F.row_number().over(Window.partitionBy("channel", *own).orderBy("sec", "id"))).drop("_bucket", "_drawn")


def top_values(rows: DataFrame, by: list[str], most: int, name: str) -> DataFrame:
    """by, name: the most frequent values of rows (by, value, pos), an array of (value, n), ties by first position and then by spelling."""
    counts = rows.groupBy(*by, "value").agg(F.count("*").alias("n"), F.min("pos").alias("pos"))
    place = F.row_number().over(Window.partitionBy(*by).orderBy(F.desc("n"), "pos", "value"))
    listed = F.transform(F.array_sort(F.collect_list(F.struct("place", "value", "n"))), lambda x: F.struct(x["value"].alias("value"), x["n"].alias("n")))
    return counts.withColumn("place", place).where(F.col("place") <= most).groupBy(*by).agg(listed.alias(name))


def snapshots(items: DataFrame, by: list[str]) -> DataFrame:
    """by, total, keywords, hashtags (10), domains, authors (5), posts (the first 5), top_text_pct, text_unique_ratio.

    items: by, pos, text, author, domain, hashtags, keywords. Lists are arrays of
    (value, n). top_text_pct is the largest share of all items whose texts begin
    with the same 80 characters, text_unique_ratio that of different beginnings.
    """
    in_list = lambda c: items.select(*by, "pos", F.explode(c).alias("value"))
    named = lambda c: items.where(F.coalesce(F.col(c), F.lit("")) != "").select(*by, "pos", F.col(c).alias("value"))
    heads = items.where(F.coalesce("text", F.lit("")) != "").groupBy(*by, F.substring("text", 1, HEAD).alias("head")).agg(F.count("*").alias("n")).groupBy(*by).agg(F.max("n").alias("most"), F.count("*").alias("heads"))
    post = F.struct("pos", F.substring("text", 1, POST_WIDTH).alias("text"), "author", "domain", "hashtags", "keywords")
    first = items.withColumn("_place", F.row_number().over(Window.partitionBy(*by).orderBy("pos")))
    posts = first.where(F.col("_place") <= POSTS).groupBy(*by).agg(F.array_sort(F.collect_list(post)).alias("posts"))
    out = items.groupBy(*by).agg(F.count("*").alias("total")).join(heads, by, "left")
    parts = [top_values(in_list("keywords"), by, TOP_WORDS, "keywords"), top_values(in_list("hashtags"), by, TOP_WORDS, "hashtags"), top_values(named("domain"), by, TOP_NAMES, "domains"), top_values(named("author"), by, TOP_NAMES, "authors"), posts]
    for part in parts:
        out = out.join(part, by, "left")
    share = lambda c: F.round(F.coalesce(F.col(c), F.lit(0)) / F.col("total"), 3)
    none = F.array().cast("array<struct<value:string,n:bigint>>")
    lists = [F.coalesce(c, none).alias(c) for c in ("keywords", "hashtags", "domains", "authors")]
    return out.select(*by, "total", *lists, "posts", share("most").alias("top_text_pct"), share("heads").alias("text_unique_ratio"))


def concentration(channel: Column, total: Column, domains: Column, authors: Column) -> Column:
    """Why a window looks like a feed, null if it does not: a known feed's domain, or one author and one domain."""
    first = lambda c: F.get(c, F.lit(0))
    domain, author = first(domains), first(authors)
    share = lambda x: F.coalesce(x["n"], F.lit(0)) / total
    feeds = F.create_map(*[x for c, own in FEED_DOMAINS.items() for x in (F.lit(c), F.array(*map(F.lit, own)))])
    known = F.coalesce(F.array_contains(F.element_at(feeds, channel), domain["value"]), F.lit(False))
    return F.when((total >= FEED_ITEMS) & known & (share(domain) >= FEED_SHARE), F.concat(F.lit("known_feed_domain:"), domain["value"])).when(
        (total >= SOURCE_ITEMS) & (share(author) > AUTHOR_SHARE) & (share(domain) > DOMAIN_SHARE), F.concat_ws(":", F.lit("author_domain_concentration"), author["value"], domain["value"])
    )


def flagged(shots: DataFrame) -> DataFrame:
    """channel, event_start, opening_reason, peak_reason, opening_text_pct, peak_text_pct, feed_burst, coordinated of snapshots by channel, event_start and phase.

    A burst is a feed's if both windows are concentrated; else it is coordinated
    if more than a quarter of either window begins alike.
    """
    told = shots.withColumn("reason", concentration(F.col("channel"), F.col("total"), F.col("domains"), F.col("authors")))
    of = lambda phase, c: F.max(F.when(F.col("phase") == phase, F.col(c)))
    both = told.groupBy("channel", "event_start").agg(*[of(p, c).alias(f"{p}_{n}") for p in ("opening", "peak") for c, n in (("reason", "reason"), ("top_text_pct", "text_pct"))])
    feed = F.col("opening_reason").isNotNull() & F.col("peak_reason").isNotNull()
    alike = F.greatest(F.coalesce("opening_text_pct", F.lit(0.0)), F.coalesce("peak_text_pct", F.lit(0.0))) > ALIKE_SHARE
    return both.withColumn("feed_burst", feed).withColumn("coordinated", alike & ~feed)
