"""Hashtag statistics with promotion of tags that recur."""

from __future__ import annotations

import heapq
from collections import Counter

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewatch.checkpoints import checkpointed
from tidewatch.functions.text import confidence, suggested_action

#: Promotion and bounds of a tag's details.
PROMOTE_AT, MOST_PROMOTED, MOST_TAGS = 5, 500, 50_000
MOST_PARTNERS, MOST_DOMAINS, MOST_SAMPLES, MOST_AUTHORS, SAMPLE_WIDTH = 50, 50, 3, 100, 150
TOP_CHANNELS, TOP_PARTNERS, TOP_DOMAINS = 10, 20, 20


def occurrences(posts: DataFrame) -> DataFrame:
    """id, sec, pos, tag, channel, author, domain, body: one row per hashtag of posts (id, sec, hashtags, channel, author, domain, body); a tag twice in a post counts twice."""
    return posts.select("id", "sec", F.posexplode("hashtags").alias("pos", "raw"), "channel", "author", "domain", "body").withColumn("tag", F.lower("raw")).drop("raw")


def totals(found: DataFrame) -> DataFrame:
    """tag, total, matched, unmatched; the general channel is no match."""
    match = F.col("channel") != "general"
    return found.groupBy("tag").agg(F.count("*").alias("total"), F.count_if(match).alias("matched"), F.count_if(~match).alias("unmatched"))


def bounded(found: DataFrame, most: int = MOST_TAGS) -> tuple[DataFrame, DataFrame]:
    """(occurrences of the first `most` tags seen, one row with the number of others): what a bounded counter would hold."""
    first = found.groupBy("tag").agg(F.min(F.struct("sec", "id", "pos")).alias("first"))
    kept = first.orderBy("first", "tag").limit(most).select("tag")
    return found.join(kept, "tag", "left_semi"), found.join(kept, "tag", "left_anti").agg(F.count("*").alias("overflow_count"))


def heavy_tags(found: DataFrame, capacity: int = MOST_TAGS) -> DataFrame:
    """tag, at_least, at_most: the tags that may be frequent, from counters of bounded size; what `bounded` refuses is not lost here.

    Each task keeps at most twice `capacity` counters and, when they are full, takes
    the (capacity + 1)-th largest count from all. Counts of different tasks add up,
    and so do their shortfalls: a tag's true number lies between the two bounds,
    which differ by no more than total / (capacity + 1), and every tag more
    frequent than that is there.
    """

    def count(batches):
        held: Counter = Counter()
        short = 0
        for pdf in batches:
            held.update(pdf["tag"].tolist())
            if len(held) > 2 * capacity:
                cut = heapq.nlargest(capacity + 1, held.values())[-1]
                short += cut
                held = Counter({t: n - cut for t, n in held.items() if n > cut})
        if held or short:
            yield pd.DataFrame({"tag": [*held, None], "n": [*held.values(), short]})

    parts = found.select("tag").where("tag IS NOT NULL").mapInPandas(count, "tag string, n long")
    sums = checkpointed(parts.groupBy("tag").agg(F.sum("n").alias("n")))
    short = sums.where("tag IS NULL").agg(F.coalesce(F.sum("n"), F.lit(0)).alias("short"))
    return sums.where("tag IS NOT NULL").crossJoin(F.broadcast(short)).select("tag", F.col("n").alias("at_least"), (F.col("n") + F.col("short")).alias("at_most"))  # one row


def promoted(found: DataFrame, at: int = PROMOTE_AT, most: int = MOST_PROMOTED) -> DataFrame:
    """tag, since (its at-th occurrence) of the first `most` tags to get there."""
    order = Window.partitionBy("tag").orderBy("sec", "id", "pos")
    reached = found.withColumn("nth", F.row_number().over(order)).where(F.col("nth") == at).select("tag", F.struct("sec", "id", "pos").alias("since"))
    return reached.orderBy("since", "tag").limit(most)


def details(found: DataFrame, tags: DataFrame) -> DataFrame:
    """Occurrences of promoted tags from their promotion on."""
    return found.join(tags, "tag").where(F.struct("sec", "id", "pos") >= F.col("since"))


def partners(found: DataFrame, tags: DataFrame, most: int = MOST_PARTNERS) -> DataFrame:
    """tag, partner, n: other tags of the same posts, for each tag the first `most` to appear."""
    own = details(found, tags).select("id", "tag", "sec", "pos")
    other = found.select("id", F.col("tag").alias("partner"), F.col("pos").alias("other"))
    counts = own.join(other, "id").where("tag <> partner").groupBy("tag", "partner").agg(F.count("*").alias("n"), F.min(F.struct("sec", "id", "pos", "other")).alias("first"))
    return counts.withColumn("place", F.row_number().over(Window.partitionBy("tag").orderBy("first"))).where(F.col("place") <= most).select("tag", "partner", "n")


def domains(found: DataFrame, tags: DataFrame, most: int = MOST_DOMAINS) -> DataFrame:
    """tag, domain, n: domains of the posts that have a promoted tag, for each tag the first `most` to appear."""
    counts = details(found, tags).where("domain <> ''").groupBy("tag", "domain").agg(F.count("*").alias("n"), F.min(F.struct("sec", "id", "pos")).alias("first"))
    return counts.withColumn("place", F.row_number().over(Window.partitionBy("tag").orderBy("first", "domain"))).where(F.col("place") <= most).select("tag", "domain", "n")


def _ranked(counts: DataFrame, value: str, most: int, name: str) -> DataFrame:
    """tag and an array of (value, n), the most frequent first, ties by spelling."""
    place = F.row_number().over(Window.partitionBy("tag").orderBy(F.desc("n"), value))
    best = counts.withColumn("place", place).where(F.col("place") <= most)
    listed = F.transform(F.array_sort(F.collect_list(F.struct("place", F.col(value).alias("value"), "n"))), lambda x: F.struct(x["value"].alias("value"), x["n"].alias("n")))
    return best.groupBy("tag").agg(listed.alias(name))


def snapshot(found: DataFrame) -> DataFrame:
    """One row per tag: tag, total, matched, unmatched; of promoted tags also channels (10), cohashtags (20), domains (20) as arrays of (value, n), samples, unique_authors_capped."""
    tags = promoted(found)
    own = details(found, tags)
    authors = own.groupBy("tag").agg(F.least(F.countDistinct("author"), F.lit(MOST_AUTHORS)).alias("unique_authors_capped"))
    channels = _ranked(own.where("channel <> 'general'").groupBy("tag", "channel").agg(F.count("*").alias("n")), "channel", TOP_CHANNELS, "channels")
    place = F.row_number().over(Window.partitionBy("tag").orderBy("sec", "id", "pos"))
    texts = own.withColumn("place", place).where(F.col("place") <= MOST_SAMPLES).groupBy("tag").agg(F.transform(F.array_sort(F.collect_list(F.struct("place", F.substring("body", 1, SAMPLE_WIDTH).alias("text")))), lambda x: x["text"]).alias("samples"))
    out = totals(found)
    for part in (authors, channels, _ranked(partners(found, tags), "partner", TOP_PARTNERS, "cohashtags"), _ranked(domains(found, tags), "domain", TOP_DOMAINS, "domains"), texts):
        out = out.join(part, "tag", "left")
    return out.withColumn("unique_authors_capped", F.coalesce("unique_authors_capped", F.lit(0)))


def _listed(column: str, most: int = 5) -> Column:
    """The first values of an array of (value, n) as text."""
    return F.coalesce(F.array_join(F.transform(F.slice(column, 1, most), lambda x: F.concat_ws(":", x["value"], x["n"].cast("string"))), "  "), F.lit(""))


def _top_channel() -> Column:
    return F.get("channels", F.lit(0))["value"]


def suggestions(counts: DataFrame) -> DataFrame:
    """counts (tag, total, matched, unmatched, unique_authors_capped) with rate, action and confidence."""
    rate = F.when(F.col("total") > 0, F.round(F.col("unmatched") / F.col("total"), 4)).otherwise(0.0)
    return counts.withColumns({"unmatched_rate": rate, "action": suggested_action(F.col("unmatched"), F.col("total")), "confidence": confidence(F.col("total"), F.col("unique_authors_capped"))})


def unmatched_report(snap: DataFrame, most: int = 100) -> DataFrame:
    """The tags most often without a channel, a bounded report; what stands beside them, and where they may belong."""
    rows = suggestions(snap.where("unmatched > 0")).orderBy(F.desc("unmatched"), "tag").limit(most)
    sample = lambda i: F.coalesce(F.get("samples", F.lit(i)), F.lit("")).alias(f"sample_text_{i + 1}")
    return rows.select(
        F.col("tag").alias("hashtag"), F.col("unmatched").alias("unmatched_count"), F.col("total").alias("total_count"), "unmatched_rate", "unique_authors_capped", _listed("cohashtags").alias("top_cohashtags"), _listed("domains").alias("top_domains"),
        sample(0), sample(1), sample(2), F.coalesce(_top_channel(), F.lit("unknown")).alias("suggested_channel"), F.col("action").alias("suggested_action"), "confidence",
    )


def routed_report(snap: DataFrame, most: int = 100) -> DataFrame:
    """The tags most often with a channel, a bounded report, and how they spread over channels."""
    rate = F.round(F.col("matched") / F.col("total"), 4)
    rows = snap.where("matched > 0").orderBy(F.desc("matched"), "tag").limit(most)
    return rows.select(F.col("tag").alias("hashtag"), F.col("total").alias("total_count"), F.col("matched").alias("matched_count"), rate.alias("matched_rate"), F.coalesce(_top_channel(), F.lit("")).alias("top_channel"), _listed("channels").alias("channel_distribution"), "unique_authors_capped", _listed("domains").alias("top_domains"))
