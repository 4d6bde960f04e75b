"""Record layouts: items, raw anomalies, candidates, tracked events."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

ITEM = (
    "id string, channel string, body string, sec long, author string, score double, story_id long, story_title string, domain string, item_type string, item_id long, created_at long, hashtags array<string>"
)
SAMPLE = "item_id long, text string, story_id long, story_title string, domain string, item_type string, created_at long"
CLUSTER = (
    "cluster_id long, size long, noise_count long, keywords array<string>, top_story_id long, top_story_title string, top_story_pct double, unique_story_count long, story_ids array<long>, top_domains array<string>"
)
ANOMALY = f"channel string, window_start long, window_end long, window_end_dt string, count long, z_score double, mean double, std double, texts array<string>, items array<struct<{SAMPLE.replace(' ', ':').replace(',:', ',')}>>, clusters array<struct<{CLUSTER.replace(' ', ':').replace(',:', ',')}>>"
CANDIDATE = (
    "candidate_id string, source string, channel string, window_start long, window_end long, cluster_id long, kind string, event_score double, size long, unique_conversation_count long, top_conversation_pct double, top_story_id long, top_story_title string, "
    "conversation_ids array<long>, top_domains array<string>, keywords array<string>, z_score double, window_count long, dbscan_eps double, dbscan_min_samples long"
)
TRACE = "candidate_id:string,candidate_time:long,merge_score:double,merge_reason:string,top_conversation_match:boolean,conversation_overlap:double,keyword_overlap:double,domain_overlap:double,was_seed_candidate:boolean"
TRACKED_EVENT = (
    "event_id string, status string, first_seen long, last_seen long, sources array<string>, channels array<string>, primary_channel string, source_counts map<string,int>, representative_title string, top_titles array<string>, top_conversation_id long, conversation_ids array<long>, anchor_conversation_ids array<long>, "
    "keywords array<string>, display_keywords array<string>, domains array<string>, candidate_ids array<string>, candidate_count int, total_item_count long, peak_score double, avg_score double, peak_z_score double, duration_minutes double, duration_kind string, "
    f"merge_trace array<struct<{TRACE}>>"
)

#: Sentinels for what is unknown: time and ids 0, text and lists empty.
DEFAULTS = {"string": "''", "long": "0L", "bigint": "0L", "double": "0.0D", "int": "0"}


def conform(df: DataFrame, layout: str) -> DataFrame:
    """df in a layout: columns that are missing or null get sentinels, others go."""
    from pyspark.sql.types import _parse_datatype_string

    have = {c.lower() for c in df.columns}
    out = []
    for field in _parse_datatype_string(layout).fields:
        kind = field.dataType.simpleString()
        empty = F.array().cast(kind) if kind.startswith("array") else F.expr(DEFAULTS.get(kind, "NULL")).cast(kind)
        own = F.col(f"`{field.name}`").cast(field.dataType) if field.name.lower() in have else F.lit(None).cast(field.dataType)
        out.append(F.coalesce(own, empty).alias(field.name))
    return df.select(*out)


def event_items(events: DataFrame) -> DataFrame:
    """The driver's events as items: channel = event_type, story = the props' number."""
    sec = F.unix_timestamp(F.col("ts").cast("timestamp"))
    story = F.get_json_object("props", "$.k").cast("long")
    return events.select(F.col("event_id").alias("id"), F.col("event_type").alias("channel"), sec.alias("sec"), F.col("user_id").alias("author"), F.col("value").alias("score"), F.coalesce(story, F.lit(0)).alias("story_id"))
