"""Reporting tables over tracked events and candidates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewatch.functions.text import duration_bucket, title_tokens, utc
from tidewatch.functions.vocabulary import REPORT_NOISE
from tidewatch.operators.consolidation import LEAST_SCORE

KINDS = ["event_candidate", "topic_surge", "viral_post", "recurring_thread"]
DURATIONS = ["isolated", "flash", "developing", "sustained"]


def _rate(part: Column, whole: Column, places: int = 4) -> Column:
    return F.round(part / F.greatest(whole, F.lit(1)), places)


def events_table(events: DataFrame) -> DataFrame:
    """One row per tracked event, lists joined, times as ISO."""
    joined = lambda c: F.array_join(c, ", ")
    return events.select(
        "event_id", "status", "primary_channel", joined("channels").alias("channels"), joined("sources").alias("sources"), utc(F.col("first_seen")).alias("first_seen"), utc(F.col("last_seen")).alias("last_seen"), utc(F.col("last_seen"), "yyyy-MM-dd").alias("date"),
        F.round("duration_minutes", 2).alias("duration_minutes"), "duration_kind", "candidate_count", "total_item_count", F.round("peak_score", 4).alias("peak_score"), F.round("avg_score", 4).alias("avg_score"), F.round("peak_z_score", 4).alias("peak_z_score"), "representative_title",
        "top_conversation_id", F.size("conversation_ids").alias("conversation_count"), joined(report_keywords(F.col("keywords"), F.col("representative_title"))).alias("display_keywords_text"), joined("domains").alias("domains_text"), F.size("merge_trace").alias("merge_count"),
    )


def report_keywords(keywords: Column, title: Column) -> Column:
    """Keywords less report noise; of none, the title's tokens."""
    left = F.filter(keywords, lambda k: ~k.isin(*REPORT_NOISE))
    return F.when(F.size(left) > 0, left).otherwise(title_tokens(title))


def event_keywords(events: DataFrame) -> DataFrame:
    rows = events.select("event_id", F.posexplode(report_keywords(F.col("keywords"), F.col("representative_title"))).alias("i", "keyword"))
    return rows.select("event_id", "keyword", (F.col("i") + 1).alias("rank"))


def event_domains(events: DataFrame) -> DataFrame:
    return events.select("event_id", F.posexplode("domains").alias("i", "domain")).select("event_id", "domain", (F.col("i") + 1).alias("rank"))


def latest_candidates(candidates: DataFrame) -> DataFrame:
    """One row per candidate_id: that of the last file, if rows were read from files twice."""
    name = F.col("_file") if "_file" in candidates.columns else F.lit("")
    return candidates.groupBy("candidate_id").agg(F.max_by(F.struct(*[c for c in candidates.columns if c != "candidate_id"]), name).alias("r")).select("candidate_id", "r.*")


def event_candidates(events: DataFrame, candidates: DataFrame) -> DataFrame:
    """The merge trace of every event with what is known of its candidates; unresolved ones stay with nulls."""
    trace = events.select("event_id", F.posexplode("merge_trace").alias("i", "m")).select("event_id", (F.col("i") + 1).alias("position"), "m.*")
    known = latest_candidates(candidates).select("candidate_id", "channel", "kind", "event_score", "size", "z_score", "top_story_title")
    return trace.join(known, "candidate_id", "left").withColumn("resolved", F.col("kind").isNotNull())


def channel_daily_summary(events: DataFrame) -> DataFrame:
    """Per day of last_seen and primary channel: counts by duration and merging, mean and peak scores."""
    kinds = [F.count_if(F.col("duration_kind") == k).alias(k) for k in DURATIONS]
    merged = F.count_if(F.col("candidate_count") > 1)
    return events.groupBy(utc(F.col("last_seen"), "yyyy-MM-dd").alias("date"), "primary_channel").agg(
        F.count("*").alias("events"), merged.alias("merged_events"), *kinds, F.sum("candidate_count").alias("candidates"), F.sum("total_item_count").alias("items"), F.round(F.avg("peak_score"), 4).alias("avg_peak_score"), F.round(F.max("peak_score"), 4).alias("max_peak_score"), F.round(F.max("peak_z_score"), 4).alias("max_z"),
    )


def evaluation_summary(events: DataFrame, candidates: DataFrame, channels: list[str]) -> DataFrame:
    """One row on a run: totals, rates, and counts per channel and duration."""
    total = F.count("*")
    per_channel = [F.count_if(F.col("primary_channel") == c).alias(f"events_{c}") for c in channels]
    per_kind = [F.count_if(F.col("duration_kind") == k).alias(k) for k in DURATIONS]
    own = events.agg(total.alias("events"), F.count_if(F.col("candidate_count") > 1).alias("multi"), F.coalesce(F.sum("candidate_count"), F.lit(0)).alias("merged_candidates"), *per_channel, *per_kind)
    seen = candidates.agg(F.count("*").alias("candidates"), F.count_if(F.col("kind") == "event_candidate").alias("event_candidates"), F.count_if(F.col("kind") == "recurring_thread").alias("recurring"))
    both = own.join(F.broadcast(seen), F.lit(True))  # one row each
    return both.withColumn("multi_rate", _rate(F.col("multi"), F.col("events"))).withColumn("event_rate", _rate(F.col("event_candidates"), F.col("candidates")))


#: Titles of hiring threads, and a weak score.
HIRING_TITLES = ["who is hiring", "who wants to be hired", "who's hiring"]
WEAK_Z = 3.0


def candidate_summary(candidates: DataFrame) -> DataFrame:
    """Per kind: number, share, mean score, and red flags (one story dominates, few words, weak score, general channel, hiring threads)."""
    title = F.lower(F.coalesce("top_story_title", F.lit("")))
    hiring = F.lit(False)
    for part in HIRING_TITLES:
        hiring = hiring | title.contains(part)
    counts = candidates.groupBy("kind").agg(
        F.count("*").alias("n"), F.round(F.avg("event_score"), 4).alias("avg_score"), F.count_if(F.col("top_conversation_pct") >= 0.8).alias("dominated"), F.count_if(F.size("keywords") < 2).alias("few_words"),
        F.count_if(F.coalesce("z_score", F.lit(0.0)) < WEAK_Z).alias("weak"), F.count_if(F.col("channel") == "general").alias("from_general"), F.count_if(hiring).alias("hiring"),
    )
    total = candidates.agg(F.count("*").alias("total"))
    return counts.join(F.broadcast(total), F.lit(True)).withColumn("share", _rate(F.col("n"), F.col("total"))).drop("total")


def repeated_stories(candidates: DataFrame, most: int = 8) -> DataFrame:
    """Titles that several windows were attributed to, the most frequent first, a bounded report."""
    title = F.trim(F.coalesce("top_story_title", F.lit("")))
    return candidates.where("kind = 'event_candidate'").groupBy(title.alias("title")).agg(F.count("*").alias("n")).where("title <> ''").orderBy(F.desc("n"), "title").limit(most)


def lowest_candidates(candidates: DataFrame, most: int = 5) -> DataFrame:
    """The event candidates of least score, a bounded report."""
    return candidates.where("kind = 'event_candidate'").select("candidate_id", "channel", "event_score", "z_score", "top_story_title").orderBy("event_score", "candidate_id").limit(most)


def event_summary(events: DataFrame) -> DataFrame:
    """Per bucket of duration: events, those of several candidates, and the longest."""
    return events.groupBy(duration_bucket(F.col("duration_minutes")).alias("bucket")).agg(F.count("*").alias("events"), F.count_if(F.col("candidate_count") > 1).alias("multi"), F.round(F.max("duration_minutes"), 2).alias("longest"))


def event_shares(events: DataFrame) -> DataFrame:
    """section, name, n, share: events by status, by whether they merged, and by channel."""
    section = lambda s, c: F.struct(F.lit(s).alias("section"), c.cast("string").alias("name"))
    merged = F.when(F.col("candidate_count") > 1, "multi-candidate").otherwise("single-candidate")
    rows = events.select(F.explode(F.array(section("status", F.col("status")), section("merge", merged), section("channel", F.col("primary_channel")))).alias("r"))
    counts = rows.groupBy("r.section", "r.name").agg(F.count("*").alias("n"))
    total = events.agg(F.count("*").alias("total"))
    return counts.join(F.broadcast(total), F.lit(True)).withColumn("share", _rate(F.col("n"), F.col("total"))).drop("total")


def most_merged(events: DataFrame, most: int = 8) -> DataFrame:
    """The events of most candidates, a bounded report."""
    return events.select("event_id", "primary_channel", "candidate_count", "duration_minutes", "representative_title").orderBy(F.desc("candidate_count"), "event_id").limit(most)


def audit_timeline(events: DataFrame, candidates: DataFrame) -> DataFrame:
    """event_candidates in the order of events and of their merges."""
    return event_candidates(events, candidates).orderBy("event_id", "position")


def recurring_between(candidates: DataFrame, first: int, last: int) -> DataFrame:
    """One row: recurring threads whose window ends in a range of seconds, ends included."""
    return candidates.where(F.col("window_end").between(first, last)).agg(F.count_if(F.col("kind") == "recurring_thread").alias("recurring_thread_count"))


BASELINE = "meta struct<date_range:string>, pairwise array<struct<case_id:string,`group`:string,expected:string,candidate_a:string,candidate_b:string,notes:string>>"


def baseline_results(document: DataFrame, scored: DataFrame | None = None) -> DataFrame:
    """One row per pairwise case of a golden file (one JSON document, BASELINE), with what scoring said of the pair.

    scored: candidate_a, candidate_b, merge_score, merge_reason and overlaps, as
    score_pairs gives them. A pair that should merge passes at the least merge
    score, one that should not below it; pairs without a score stay blank.
    """
    cases = document.select(F.explode("pairwise").alias("c")).select("c.*")
    names = ["merge_score", "merge_reason", "keyword_overlap", "conversation_overlap", "domain_overlap"]
    if scored is None:
        kinds = {"merge_reason": "string"}
        met = cases.select("*", *[F.lit(None).cast(kinds.get(n, "double")).alias(n) for n in names])
    else:
        met = cases.join(scored.select("candidate_a", "candidate_b", *names), ["candidate_a", "candidate_b"], "left")
    merges = F.col("merge_score") >= LEAST_SCORE
    passed = F.when(F.col("merge_score").isNotNull(), merges == (F.col("expected") == "should_merge"))
    return met.select("case_id", "group", "expected", "candidate_a", "candidate_b", F.coalesce("notes", F.lit("")).alias("notes"), F.col("merge_score").alias("actual_score"), passed.alias("passed"), *names[1:])


def top_keywords(rows: DataFrame, most: int = 12) -> DataFrame:
    """The most frequent keywords, a bounded report."""
    return rows.select(F.explode("keywords").alias("keyword")).groupBy("keyword").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "keyword").limit(most)


def select_events(events: DataFrame, channels: list[str] | None = None, sources: list[str] | None = None, least_score: float | None = None, duration: str | None = None, active: bool = False) -> DataFrame:
    """Events that meet every condition given."""
    for name, wanted in (("channels", channels), ("sources", sources)):
        if wanted:
            events = events.where(F.arrays_overlap(name, F.array(*map(F.lit, wanted))))
    if least_score is not None:
        events = events.where(F.col("peak_score") >= least_score)
    if duration:
        events = events.where(F.col("duration_kind") == duration)
    return events.where(F.col("status") == "active") if active else events


def select_candidates(candidates: DataFrame, channels: list[str] | None = None, least_score: float | None = None, kind: str | None = None, recurring: bool = False) -> DataFrame:
    """Candidates that meet every condition given; recurring threads are hidden unless asked for, by name or by kind."""
    if channels:
        candidates = candidates.where(F.col("channel").isin(*channels))
    if least_score is not None:
        candidates = candidates.where(F.col("event_score") >= least_score)
    if kind:
        return candidates.where(F.col("kind") == kind)
    return candidates if recurring else candidates.where("kind <> 'recurring_thread'")


def order_candidates(candidates: DataFrame) -> DataFrame:
    """By kind, then the highest score; recurring threads last."""
    rank = F.array_position(F.array(*map(F.lit, KINDS)), F.col("kind"))
    return candidates.orderBy(F.when(rank == 0, len(KINDS) + 1).otherwise(rank), F.desc("event_score"), "candidate_id")


def dashboard_series(events: DataFrame, history: DataFrame) -> DataFrame:
    """History points (channel, x, y) with a mark where an event of the channel began within the hour."""
    marks = events.select(F.col("primary_channel").alias("channel"), (F.floor(F.col("first_seen") / 3600) * 3600).cast("long").alias("x")).distinct().withColumn("mark", F.lit(True))
    return history.join(marks, ["channel", "x"], "left").withColumn("mark", F.coalesce("mark", F.lit(False)))
