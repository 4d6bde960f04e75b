"""Filters that drop items before they are counted, as columns."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Observation, Window
from pyspark.sql import functions as F

from tidewatch.functions.text import let
from tidewatch.functions.vocabulary import ADULT_HASHTAGS, BOILERPLATE, BOT_AUTHORS, NOT_PROSE, ROUTINE_GRID, ROUTINE_HASHTAGS, ROUTINE_WORDS


def allowed(channel: Column, channels: list[str]) -> Column:
    return F.lower(channel).isin(*[c.lower() for c in channels])


def by_bot(author: Column) -> Column:
    return F.coalesce(author.isin(*BOT_AUTHORS), F.lit(False))


def boilerplate(body: Column) -> Column:
    low = F.lower(F.coalesce(body, F.lit("")))
    return reduce(lambda a, b: a | b, [low.contains(p) for p in BOILERPLATE])


def keep_people(items: DataFrame, channels: list[str] | None = None) -> DataFrame:
    """Items of the channels that no bot wrote."""
    if channels is not None:
        items = items.where(allowed(F.col("channel"), channels))
    return items.where(~by_bot(F.col("author")) & ~boilerplate(F.col("body")))


def live_items(items: DataFrame) -> DataFrame:
    """Stories and comments that are neither deleted nor dead and have an id; comments need a parent."""
    kind = F.col("item_type").isin("story", "comment")
    gone = F.coalesce(F.col("deleted"), F.lit(False)) | F.coalesce(F.col("dead"), F.lit(False))
    return items.where(kind & ~gone & F.col("item_id").isNotNull() & ((F.col("item_type") == "story") | F.col("parent").isNotNull()))


def countable_text(body: Column) -> Column:
    """False for texts that a sample leaves out (the item still counts)."""
    return ~F.coalesce(F.trim(body), F.lit("")).isin("", "[deleted]", "[removed]")


def language_mismatch(body: Column) -> Column:
    """True for prose of over 40 characters whose letters are mostly beyond the Latin blocks."""
    text, beyond = F.coalesce(body, F.lit("")), r"[^\x{0000}-\x{024F}]"
    mostly = lambda letters: 2 * F.length(F.regexp_replace(letters, f"{beyond}+", "")) < F.length(letters)
    foreign = lambda prose: (F.length(prose) > 40) & let(F.regexp_replace(prose, r"[^\p{L}]+", ""), mostly)
    # a text without any such character is none
    return F.when(text.rlike(beyond), let(F.trim(F.regexp_replace(text, NOT_PROSE, "")), foreign)).otherwise(False)


def routine(body: Column, hashtags: Column) -> Column:
    """True for shared results of daily games."""
    tags = F.transform(hashtags, F.lower)
    text = F.coalesce(body, F.lit(""))
    return F.arrays_overlap(tags, F.array(*map(F.lit, ROUTINE_HASHTAGS))) | (text.rlike(ROUTINE_GRID) & text.rlike(ROUTINE_WORDS))


def text_reason(body: Column, langs: Column, hashtags: Column) -> Column:
    """Why a post goes whatever its channel, the first that holds; null where nothing does."""
    tags = F.transform(hashtags, F.lower)
    return (
        F.when(F.trim(F.coalesce(body, F.lit(""))) == "", "empty")
        .when(~F.coalesce(F.array_contains(langs, "en"), F.lit(False)), "non_english")
        .when(language_mismatch(body), "language_mismatch")
        .when(F.arrays_overlap(tags, F.array(*map(F.lit, ADULT_HASHTAGS))), "adult_spam")
        .when(routine(body, hashtags), "routine_template")
    )


def channel_reason(channel: Column) -> Column:
    """Why a post goes that text_reason leaves."""
    return F.when(F.coalesce(channel, F.lit("general")) == "general", "unmatched_topic")


def drop_reason(body: Column, langs: Column, hashtags: Column, channel: Column) -> Column:
    """Why a post goes, the first that holds; null for posts that stay."""
    return F.coalesce(text_reason(body, langs, hashtags), channel_reason(channel))


def capped(rows: DataFrame, by: list[str], order: list[str], most: int = 200) -> DataFrame:
    """The first `most` rows of every group: a report's bounded samples."""
    return rows.withColumn("_rank", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col("_rank") <= most).drop("_rank")


def run_summary(posts: DataFrame, keywords: int = 20, hashtags: int = 30, domains: int = 20) -> DataFrame:
    """One row on a run over posts (drop_reason, langs, channel, matched_keywords, hashtags, domain): totals, rates, and counts by reason, channel, keyword, hashtag, domain.

    Counts are arrays of (value, n), the most frequent first, ties by spelling;
    keywords are of kept posts, hashtags and domains of posts no channel claims.
    One pass: a post is read once and gives a (kind, value) for all that counts it.
    """
    kept, lost = F.col("drop_reason").isNull(), F.col("drop_reason") == "unmatched_topic"
    mark = lambda kind, value: F.struct(F.lit(kind).alias("kind"), value.alias("value"))
    one = lambda kind, those, value=F.lit(""): mark(kind, F.when(those, value))
    many = lambda kind, those, values: F.transform(F.when(those, F.col(values)), lambda v: mark(kind, v))
    named = lambda c: F.nullif(F.coalesce(c, F.lit("")), F.lit(""))
    single = F.array(
        one("total_seen", F.lit(True)), one("english_seen", F.array_contains("langs", "en")), one("kept_count", kept), one("dropped_count", ~kept),
        one("dropped_by_reason", ~kept, named(F.col("drop_reason"))), one("kept_by_channel", kept, named(F.col("channel"))), one("top_unmatched_domains", lost, named(F.col("domain"))),
    )
    none = F.array().cast("array<struct<kind:string,value:string>>")
    listed = [F.filter(F.coalesce(many(kind, those, values), none), lambda x: x["value"] != "") for kind, those, values in (("top_matched_keywords", kept, "matched_keywords"), ("top_unmatched_hashtags", lost, "hashtags"))]
    marks = posts.select(F.concat(F.filter(single, lambda x: x["value"].isNotNull()), *listed).alias("_marks")).select(F.explode("_marks").alias("m"))
    counts = marks.groupBy("m.kind", "m.value").agg(F.count("*").alias("n"))
    most = {"top_matched_keywords": keywords, "top_unmatched_hashtags": hashtags, "top_unmatched_domains": domains}
    place = F.row_number().over(Window.partitionBy("kind").orderBy(F.desc("n"), "value"))
    top = counts.withColumn("_place", place).where(F.col("_place") <= 1000)
    # reasons and channels are few; of the rest no more than asked for
    bounded = F.lit(True)
    for kind, k in most.items():
        bounded = bounded & ((F.col("kind") != kind) | (F.col("_place") <= k))
    total = lambda kind: F.coalesce(F.sum(F.when(F.col("kind") == kind, F.col("n"))), F.lit(0)).alias(kind)

    def table(kind: str) -> Column:
        rows = F.array_sort(F.collect_list(F.when(F.col("kind") == kind, F.struct("_place", "value", "n"))))
        return F.transform(rows, lambda x: F.struct(x["value"].alias("value"), x["n"].alias("n"))).alias(kind)

    names = ["dropped_by_reason", "kept_by_channel", "top_matched_keywords", "top_unmatched_hashtags", "top_unmatched_domains"]
    out = top.where(bounded).agg(*[total(k) for k in ("total_seen", "english_seen", "kept_count", "dropped_count")], *[table(k) for k in names])
    rate = lambda c: F.round(F.col(c) / F.greatest(F.col("total_seen"), F.lit(1)), 4)
    return out.withColumns({"kept_rate": rate("kept_count"), "dropped_rate": rate("dropped_count")})


#: What drop_reason says.
REASONS = ("empty", "non_english", "language_mismatch", "adult_spam", "routine_template", "unmatched_topic")


def observed(posts: DataFrame, name: str | Observation) -> DataFrame:
    """posts (drop_reason, langs), whose counts Spark gathers while something else reads them.

    Batch: pass an Observation, and read its .get after the action. Streams: pass a
    name; every progress report has the micro-batch's counts under it (see
    streaming.health). Counts: total_seen, english_seen, kept_count, dropped_count
    and one for each reason.
    """
    kept = F.col("drop_reason").isNull()
    counts = [F.count(F.lit(1)).alias("total_seen"), F.count_if(F.array_contains("langs", "en")).alias("english_seen"), F.count_if(kept).alias("kept_count"), F.count_if(~kept).alias("dropped_count")]
    return posts.observe(name, *counts, *[F.count_if(F.col("drop_reason") == r).alias(r) for r in REASONS])


def kept_sample(posts: DataFrame, most: int = 100, width: int = 200) -> DataFrame:
    """The newest kept posts, a bounded report."""
    newest = posts.orderBy(F.desc("sec"), F.desc("id")).limit(most)
    return newest.withColumn("body", F.substring("body", 1, width))


def kept_health(posts: DataFrame) -> DataFrame:
    """Per channel of kept posts: their number, and how many a minute over the time that all of them span."""
    whole = posts.agg((F.max("sec") - F.min("sec")).alias("span"))
    counts = posts.groupBy("channel").agg(F.count("*").alias("n"))
    minutes = F.greatest(F.col("span"), F.lit(1)) / 60
    return counts.crossJoin(F.broadcast(whole)).select("channel", "n", F.round(F.col("n") / minutes, 1).alias("kept_per_min"))  # one row


def between(items: DataFrame, first: int | None = None, end: int | None = None) -> DataFrame:
    """Items with first <= sec < end, either side open."""
    if first is not None:
        items = items.where(F.col("sec") >= first)
    return items if end is None else items.where(F.col("sec") < end)
