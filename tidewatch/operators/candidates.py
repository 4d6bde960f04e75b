"""Event candidates from clusters: kind, score and identity."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewatch.functions.vocabulary import HIRING_WORDS, RECURRING_TITLES



def recurring_title(title: Column) -> Column:
    low = F.lower(F.coalesce(title, F.lit("")))
    out = F.lit(False)
    for part in RECURRING_TITLES:
        out = out | low.contains(part)
    return out


def kind(unique: Column, top_pct: Column, size: Column, domains: Column, keywords: Column) -> Column:
    """What a cluster is; domains and keywords are arrays."""
    hiring = F.size(F.filter(F.slice(keywords, 1, 4), lambda k: k.isin(*HIRING_WORDS))) >= 3
    return (
        F.when(unique == 0, "unknown")
        .when(hiring, "topic_surge")
        .when((top_pct >= 0.80) | (unique <= 1), "viral_post")
        .when(F.size(keywords) < 2, "topic_surge")
        .when((unique >= 3) & (F.size(domains) >= 2) & (size >= 10), "event_candidate")
        .otherwise("topic_surge")
    )


def event_score(unique: Column, top_pct: Column, size: Column, domains: Column, keywords: Column, z: Column, channel: Column) -> Column:
    part = lambda x, most: F.least(x / most, F.lit(1.0))
    words = part(F.size(keywords), 5)
    spread = 0.25 * part(unique, 5) * F.when(channel == "general", words).otherwise(1.0)
    return F.round(spread + 0.20 * (1 - top_pct) + 0.20 * part(F.size(domains), 3) + 0.15 * part(size, 100) + 0.10 * part(z, 10) + 0.10 * words, 4)


def build_candidates(anomalies: DataFrame, source: str = "hacker_news") -> DataFrame:
    """One candidate per cluster of every anomaly (schema.ANOMALY), unknown ones dropped."""
    c = "c."
    rows = anomalies.select("channel", "window_start", "window_end", "z_score", F.col("count").alias("window_count"), F.explode("clusters").alias("c"))
    unique, pct, size = F.col(c + "unique_story_count"), F.col(c + "top_story_pct"), F.col(c + "size")
    domains, keywords, title = F.col(c + "top_domains"), F.col(c + "keywords"), F.col(c + "top_story_title")
    again = recurring_title(title)
    kinds = F.when(again, "recurring_thread").otherwise(kind(unique, pct, size, domains, keywords))
    score = F.when(again, 0.0).otherwise(event_score(unique, pct, size, domains, keywords, F.col("z_score"), F.col("channel")))
    return rows.select(
        F.concat_ws(":", F.lit(source), "channel", "window_end", F.col(c + "cluster_id")).alias("candidate_id"), F.lit(source).alias("source"), "channel", "window_start", "window_end", F.col(c + "cluster_id").alias("cluster_id"),
        kinds.alias("kind"), score.alias("event_score"), size.alias("size"), unique.alias("unique_conversation_count"), pct.alias("top_conversation_pct"), F.col(c + "top_story_id").alias("top_story_id"), title.alias("top_story_title"),
        F.col(c + "story_ids").alias("conversation_ids"), domains.alias("top_domains"), keywords.alias("keywords"), "z_score", "window_count",
    ).where("kind <> 'unknown'")
