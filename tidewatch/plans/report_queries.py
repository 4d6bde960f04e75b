"""Relational, reporting, storage and streaming queries."""

from __future__ import annotations

import uuid
from datetime import date

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DateType, StringType, StructField, StructType

from tidewatch.checkpoints import shared_folder
from tidewatch.plans import reports as P
from tidewatch.plans.detection_queries import FROZEN, ITEMS
from tidewatch.operators import consolidation as M
from tidewatch.operators import enrichment as E
from tidewatch.plans.event_queries import _anomalies, _candidates, _enriched, _tracked
from tidewatch.sources import readers, sinks
from tidewatch.streaming import jobs


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _folder(spark: SparkSession) -> str:
    return f"{shared_folder(spark)}/{uuid.uuid4().hex}"


def _synthetic_events(spark, sf_dir):
    """Orders as tracked events: what the reports need, in both engines."""
    o = _table(spark, sf_dir, "orders")
    kind = F.element_at(F.array(*map(F.lit, P.DURATIONS)), (F.col("o_orderkey") % 4 + 1).cast("int"))
    return o.select(
        F.col("o_orderkey").alias("event_id"), F.when(F.col("o_orderstatus") == "O", "active").otherwise("closed").alias("status"), F.unix_timestamp(F.col("o_orderdate").cast("timestamp")).alias("last_seen"), F.col("o_orderpriority").alias("primary_channel"), kind.alias("duration_kind"), (F.col("o_orderkey") % 3 + 1).alias("candidate_count"), (F.col("o_custkey") % 50).alias("total_item_count"),
        F.floor("o_totalprice").cast("double").alias("peak_score"), (F.col("o_custkey") % 11).cast("double").alias("peak_z_score"), (F.col("o_orderkey") % 600).cast("double").alias("duration_minutes"),
    )


def channel_daily_summary(spark, sf_dir):
    return P.channel_daily_summary(_synthetic_events(spark, sf_dir))


def evaluation_summary_pivot(spark, sf_dir):
    line = _table(spark, sf_dir, "lineitem").select(F.when(F.col("l_returnflag") == "R", "event_candidate").when(F.col("l_linestatus") == "O", "recurring_thread").otherwise("topic_surge").alias("kind"))
    return P.evaluation_summary(_synthetic_events(spark, sf_dir), line, ["1-URGENT", "2-HIGH"]).withColumnsRenamed({"events_1-URGENT": "events_urgent", "events_2-HIGH": "events_high"})


def event_summary_buckets(spark, sf_dir):
    return P.event_summary(_synthetic_events(spark, sf_dir))


def candidate_summary(spark, sf_dir):
    return P.candidate_summary(_candidates(spark, sf_dir)).select("kind", "n", "dominated", "few_words", "share")


def candidate_flags(spark, sf_dir):
    """Weak scores, general channel and hiring threads among the kinds."""
    own = _candidates(spark, sf_dir).withColumn("top_story_title", F.when(F.col("size") % 7 == 0, F.lit("Ask: Who's hiring?")).otherwise(F.col("top_story_title")))
    return P.candidate_summary(own.withColumn("channel", F.when(F.col("channel") == "view", "general").otherwise(F.col("channel")))).select("kind", "weak", "from_general", "hiring")


def repeated_stories(spark, sf_dir):
    return P.repeated_stories(_candidates(spark, sf_dir))


def lowest_candidates(spark, sf_dir):
    return P.lowest_candidates(_candidates(spark, sf_dir)).select("candidate_id", "event_score", "top_story_title")


def event_shares(spark, sf_dir):
    return P.event_shares(_synthetic_events(spark, sf_dir))


def most_merged(spark, sf_dir):
    """Customers as events: those of most orders."""
    o = _table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("event_id")).agg(F.count("*").alias("candidate_count"), F.max("o_orderpriority").alias("primary_channel"), (F.max("o_orderkey") - F.min("o_orderkey")).alias("duration_minutes"))
    return P.most_merged(o.withColumn("representative_title", F.concat(F.lit("customer "), F.col("event_id").cast("string"))))


def baseline_results(spark, sf_dir):
    """Golden pairs, scored: each channel's candidates of one cluster and the next window's, two in three expected to merge."""
    own = _candidates(spark, sf_dir)
    a = own.select(F.struct(*own.columns).alias("a"), "channel", "cluster_id", F.col("window_end").alias("meets"))
    b = own.select(F.struct(*own.columns).alias("b"), "channel", "cluster_id", F.col("window_start").alias("meets"))
    pairs = a.join(b, ["channel", "cluster_id", "meets"]).select("a", "b")
    key = F.col("a.window_start") / 43200
    case = F.struct(F.concat_ws("/", "a.channel", "a.cluster_id", key.cast("long").cast("string")).alias("case_id"), F.col("a.channel").alias("group"), F.when(key.cast("long") % 3 > 0, "should_merge").otherwise("should_not_merge").alias("expected"), F.col("a.candidate_id").alias("candidate_a"), F.col("b.candidate_id").alias("candidate_b"), F.lit(None).cast("string").alias("notes"))
    path = _folder(spark)
    pairs.select(case.alias("c")).groupBy("c.group").agg(F.collect_list("c").alias("pairwise")).withColumn("meta", F.struct(F.lit("all").alias("date_range"))).write.json(path)
    scored = M.score_pairs(pairs, 9).withColumns({"candidate_a": F.col("a.candidate_id"), "candidate_b": F.col("b.candidate_id")})
    out = P.baseline_results(spark.read.schema(P.BASELINE).json(path), scored)
    return out.select("case_id", "expected", "candidate_a", "candidate_b", F.round("actual_score", 6).alias("actual_score"), "passed", "merge_reason", "notes")


def anomaly_tables(spark, sf_dir):
    """Anomalies, clusters and texts written as tables and joined again by id."""
    anomalies, rows, labelled = _enriched(spark, sf_dir)
    path = _folder(spark)
    full = anomalies.withColumns({"mean": F.lit(1.0), "std": F.lit(0.5)})
    sinks.write_tables(E.anomaly_tables(full, rows, labelled.select("id", "text")), path)
    read = lambda t: spark.read.parquet(f"{path}/{t}")
    clusters = read("clusters").groupBy("anomaly_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("cluster_id", "keywords"))), lambda c: c["keywords"]), "|").alias("keywords"))
    texts = read("anomaly_texts").groupBy("anomaly_id").agg(F.countDistinct("text").alias("texts"))
    return read("anomalies").join(clusters, F.col("id") == clusters["anomaly_id"], "left").drop("anomaly_id").join(texts, F.col("id") == texts["anomaly_id"], "left").select("id", "channel", "window_date", "count", "texts_sampled", F.coalesce("keywords", F.lit("")).alias("keywords"), "texts")


def candidate_left_join_unresolved(spark, sf_dir):
    """Order lines against the orders of one priority: unresolved lines stay."""
    orders = _table(spark, sf_dir, "orders").where("o_orderpriority = '1-URGENT'").select(F.col("o_orderkey").alias("l_orderkey"), "o_orderstatus")
    met = _table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber").join(orders, "l_orderkey", "left")
    return met.groupBy(F.coalesce("o_orderstatus", F.lit("")).alias("status")).agg(F.count("*").alias("lines"), F.count_if(F.col("o_orderstatus").isNull()).alias("unresolved"))


def topk_by_score(spark, sf_dir):
    o = _table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_totalprice")
    return o.orderBy(F.desc("o_totalprice"), "o_orderkey").limit(20)


def correlated_groupconcat(spark, sf_dir):
    """Customers' priorities, distinct and joined, the wealthiest first in each nation."""
    p = _table(spark, sf_dir, "orders").select("o_custkey", "o_orderpriority").distinct().groupBy("o_custkey").agg(F.array_join(F.array_sort(F.collect_list("o_orderpriority")), "|").alias("priorities"))
    return _table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey").join(p, F.col("c_custkey") == F.col("o_custkey"), "left").select("c_custkey", "c_nationkey", F.coalesce("priorities", F.lit("")).alias("priorities"))


def full_outer_phase_compare(spark, sf_dir):
    o = _table(spark, sf_dir, "orders")
    side = lambda status, name: o.where(F.col("o_orderstatus") == status).groupBy("o_custkey").agg(F.count("*").alias(name))
    met = side("F", "phase_1").join(side("P", "phase_2"), "o_custkey", "full_outer")
    return met.select("o_custkey", F.coalesce("phase_1", F.lit(0)).alias("phase_1"), F.coalesce("phase_2", F.lit(0)).alias("phase_2"))


def global_aggregates(spark, sf_dir):
    line = _table(spark, sf_dir, "lineitem")
    return line.agg(F.max("l_quantity").alias("max_quantity"), F.round(F.avg("l_quantity"), 6).alias("avg_quantity"), F.count("*").alias("n"))


def range_filter_scan(spark, sf_dir):
    line = _table(spark, sf_dir, "lineitem").where("l_quantity >= 49 AND l_returnflag = 'R' AND l_discount = 0.05")
    return line.select("l_orderkey", "l_linenumber", "l_quantity")


def top_keywords_report(spark, sf_dir):
    return P.top_keywords(_candidates(spark, sf_dir))


def bi_events_table(spark, sf_dir):
    return P.events_table(_tracked(spark, sf_dir))


def bi_event_keywords(spark, sf_dir):
    return P.event_keywords(_tracked(spark, sf_dir))


def bi_event_domains(spark, sf_dir):
    return P.event_domains(_tracked(spark, sf_dir))


def bi_event_candidates(spark, sf_dir):
    return P.event_candidates(_tracked(spark, sf_dir), _candidates(spark, sf_dir)).select("event_id", "position", "candidate_id", "merge_score", "merge_reason", "was_seed_candidate", "kind", "resolved")


def parquet_partition_prune(spark, sf_dir):
    """Anomalies written by day and channel, two days read back: only their folders are opened."""
    path = _folder(spark)
    hot = _anomalies(spark, sf_dir)[0]
    sinks.write_archive(hot, path)
    # without an anomaly there is no file to take columns from
    layout = StructType([*hot.drop("channel").schema, StructField("date", DateType()), StructField("channel", StringType())])
    back = spark.read.schema(layout).parquet(path).where(F.col("date").between(date(2024, 1, 2), date(2024, 1, 3)))
    return back.select("id", "channel", "z_score")


def candidates_between_days(spark, sf_dir):
    """Candidates archived by day and channel, three days read back in their layout."""
    path = _folder(spark)
    sinks.write_archive(_candidates(spark, sf_dir), path)
    back = readers.candidates_between(spark, path, date(2024, 1, 5), date(2024, 1, 7))
    return back.select("candidate_id", "kind", "event_score", "size", F.array_join("keywords", ",").alias("keywords"), "dbscan_eps")


def stories_csv_roundtrip(spark, sf_dir):
    """Documents as a story dump in CSV, with all their quotes and line ends, read back as items."""
    path = _folder(spark)
    kind = F.when(F.col("doc_id") % 3 == 0, "story").otherwise("comment")
    rows = _table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), kind.alias("type"), F.col("source").alias("author"), (F.col("doc_id") * 60).alias("timestamp"), F.col("text").alias("body"), F.lit("").alias("title"), F.when(F.col("doc_id") % 3 > 0, (F.col("doc_id") / 3).cast("long") * 3).alias("parent"))
    rows.write.csv(path, header=True, escape='"', ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False)
    return readers.stories_csv(spark, path).select("item_id", "item_type", "author", "sec", F.md5(F.encode("body", "UTF-8")).alias("body_md5"), F.coalesce("parent", F.lit(-1)).alias("parent"), "url", "deleted")


def _messages(spark, sf_dir):
    """Documents as firehose messages (JSON), with tags, links, replies and embeds by number."""
    d = _table(spark, sf_dir, "documents")
    by = lambda n, k: F.col("doc_id") % n == k
    no = F.col("doc_id").cast("string")
    feature = lambda kind, **f: F.struct(F.lit(f"app.bsky.richtext.facet#{kind}").alias("$type"), *[v.alias(k) for k, v in f.items()])
    tag, link = feature("tag", tag=F.concat(F.lit("Tag"), no), uri=F.lit(None).cast("string")), feature("link", tag=F.lit(None).cast("string"), uri=F.concat(F.lit("https://l.example/"), no))
    facets = F.array(F.struct(F.when(by(3, 0), F.array(tag)).when(by(3, 1), F.array(tag, link)).otherwise(F.array(link)).alias("features")))
    outer = F.struct(F.concat(F.lit("https://e.example/"), no).alias("uri"), F.concat(F.lit("Title "), no).alias("title"), F.when(by(2, 0), " ").otherwise("words").alias("description"))
    images = F.when(by(5, 1), F.array(F.struct(F.lit("alt a").alias("alt")), F.struct(F.lit("alt b").alias("alt"))))
    kind = F.when(by(5, 0), "app.bsky.embed.external").when(by(5, 1), "app.bsky.embed.images").when(by(5, 2), "app.bsky.embed.video").when(by(5, 3), "app.bsky.embed.record")
    embed = F.when(kind.isNotNull(), F.struct(kind.alias("$type"), images.alias("images"), F.when(by(5, 0), outer).alias("external")))
    reply = F.when(by(4, 0), F.struct(F.struct(F.concat(F.lit("at://root/"), no).alias("uri")).alias("root"), F.struct(F.concat(F.lit("at://parent/"), no).alias("uri")).alias("parent")))
    record = F.struct(F.col("text"), F.array("lang").alias("langs"), reply.alias("reply"), facets.alias("facets"), embed.alias("embed"))
    commit = F.struct(F.lit("app.bsky.feed.post").alias("collection"), F.when(by(7, 0), "delete").otherwise("create").alias("operation"), no.alias("rkey"), record.alias("record"))
    message = F.to_json(F.struct(F.when(by(11, 0), "identity").otherwise("commit").alias("kind"), F.col("source").alias("did"), (F.col("doc_id") * 1_000_000 + 999_999).alias("time_us"), commit.alias("commit")))
    return d.select(message.alias("value"))


def _post_columns(posts):
    joined = lambda c: F.array_join(c, ",").alias(c)
    return posts.select("platform_uri", "root_uri", F.coalesce("parent_uri", F.lit("")).alias("parent_uri"), "is_reply", "sec", "author", F.md5(F.encode("body", "UTF-8")).alias("body_md5"), "story_title", joined("langs"), joined("hashtags"), joined("links"), "embed_type", "has_image", "image_count", "has_video", "has_external_link", F.coalesce("external_uri", F.lit("")).alias("external_uri"), "has_quote_post", joined("alt_texts"), "embed_text")


def firehose_posts(spark, sf_dir):
    """Firehose messages read as posts."""
    return _post_columns(readers.posts_from_messages(_messages(spark, sf_dir)))


def jsonl_roundtrip(spark, sf_dir):
    """Tracked events written as JSON lines and read back with a cut-off."""
    path = _folder(spark)
    sinks.write_events(_tracked(spark, sf_dir), path)
    return readers.stored_events(spark, path, 1704500000).select("event_id", "first_seen", "last_seen", "candidate_count")


def csv_export_roundtrip(spark, sf_dir):
    path = _folder(spark)
    sinks.export_csv({"orders": topk_by_score(spark, sf_dir)}, path)
    return spark.read.csv(f"{path}/orders", header=True, schema="o_orderkey long, o_custkey long, o_totalprice double")


def manifest_antijoin(spark, sf_dir):
    """Orders that a manifest of shipped lines does not name."""
    done = _table(spark, sf_dir, "lineitem").where("l_shipdate < '1998-01-01'").select(F.col("l_orderkey").alias("o_orderkey")).distinct()
    return readers.unseen(_table(spark, sf_dir, "orders").select("o_orderkey"), done, "o_orderkey")


def webhook_payloads(spark, sf_dir):
    """Alerts of all three styles."""
    rows = _anomalies(spark, sf_dir)[0].withColumns({"count": F.lit(5), "keywords": F.when(F.col("id") % 2 == 0, F.array(F.lit("alpha"), F.lit("beta"))).otherwise(F.array().cast("array<string>"))})
    return rows.select("id", *[sinks.payload(s).alias(s) for s in ("discord", "slack", "plain")])


def stream_sliding_counts(spark, sf_dir):
    path = _folder(spark)
    jobs.run_available(jobs.sliding_counts(jobs.event_stream(spark, f"{sf_dir}/events.parquet")), f"{path}/out", f"{path}/state")
    return spark.read.parquet(f"{path}/out").select("channel", "tick", "n")


def stream_schmitt(spark, sf_dir):
    path = _folder(spark)
    jobs.run_available(jobs.detect(jobs.event_stream(spark, f"{sf_dir}/events.parquet")), f"{path}/out", f"{path}/state")
    return spark.read.parquet(f"{path}/out")


def stream_dedup(spark, sf_dir):
    path = _folder(spark)
    jobs.run_available(jobs.distinct_items(jobs.event_stream(spark, f"{sf_dir}/events.parquet")), f"{path}/out", f"{path}/state")
    return spark.read.parquet(f"{path}/out").groupBy("channel").agg(F.count("*").alias("n"))


def stream_session_lifecycle(spark, sf_dir):
    path = _folder(spark)
    jobs.run_available(jobs.sessions(jobs.event_stream(spark, f"{sf_dir}/events.parquet")), f"{path}/out", f"{path}/state")
    return spark.read.parquet(f"{path}/out")


QUERIES = {f.__name__: f for f in (channel_daily_summary, evaluation_summary_pivot, event_summary_buckets, event_shares, most_merged, candidate_summary, candidate_flags, repeated_stories, lowest_candidates, baseline_results, anomaly_tables, candidate_left_join_unresolved, topk_by_score, correlated_groupconcat, full_outer_phase_compare, global_aggregates, range_filter_scan, top_keywords_report, bi_events_table, bi_event_keywords, bi_event_domains, bi_event_candidates, parquet_partition_prune, candidates_between_days, stories_csv_roundtrip, firehose_posts, jsonl_roundtrip, csv_export_roundtrip, manifest_antijoin, webhook_payloads, stream_sliding_counts, stream_schmitt, stream_dedup, stream_session_lifecycle)}

from tidewatch.plans.event_queries import _CONV, ANOMALIES, CANDIDATES, CLUSTERS, TRACKED, _simp  # noqa: E402

_EVENTS = "ev AS (SELECT o_orderkey AS event_id, CASE WHEN o_orderstatus = 'O' THEN 'active' ELSE 'closed' END AS status, o_orderdate AS last, o_orderpriority AS primary_channel, ['isolated', 'flash', 'developing', 'sustained'][o_orderkey % 4 + 1] AS duration_kind, o_orderkey % 3 + 1 AS candidate_count, o_custkey % 50 AS items, floor(o_totalprice) AS peak, CAST(o_custkey % 11 AS DOUBLE) AS z, CAST(o_orderkey % 600 AS DOUBLE) AS minutes FROM orders)"
_KINDS = ", ".join(f"count(*) FILTER (duration_kind = '{k}') AS {k}" for k in P.DURATIONS)
_TOPK = "SELECT o_orderkey, o_custkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 20"

_KIND = "CASE WHEN uniq = 0 THEN 'unknown' WHEN pct >= 0.8 OR uniq <= 1 THEN 'viral_post' WHEN len(kws) < 2 THEN 'topic_surge' WHEN uniq >= 3 AND len(doms) >= 2 AND size >= 10 THEN 'event_candidate' ELSE 'topic_surge' END"
_EVENT_SCORE = "round(0.25 * least(uniq / 5, 1) + 0.2 * (1 - pct) + 0.2 * least(len(doms) / 3, 1) + 0.15 * least(size / 100, 1) + 0.1 * least(size / 4 / 10, 1) + 0.1 * least(len(kws) / 5, 1), 4)"
_field = lambda k, v, inline, name, flag: f"""'{{"{name}":"{k}","value":"' || {v} || '","{flag}":{inline}}}'"""
_WHEN, _Z, _KW = "strftime(make_timestamp(window_end * 1000000), '%b %d %H:%M UTC')", "printf('%.2f', z_score)", "CASE WHEN id % 2 = 0 THEN 'alpha, beta' ELSE '—' END"
_fields = lambda name, flag: " || ',' || ".join(_field(k, v, i, name, flag) for k, v, i in (("Channel", "channel", "true"), ("Time", _WHEN, "true"), ("Count", "'5'", "true"), ("Z-Score", _Z, "true"), ("Keywords", _KW, "false")))

_ISO = "%Y-%m-%dT%H:%M:%SZ"

ORACLE_SQL = {
    "bi_events_table": f"""WITH RECURSIVE {TRACKED} SELECT id AS event_id, 'closed' AS status, channel AS primary_channel, channel AS channels, 'hn' AS sources, strftime(make_timestamp(first * 1000000), '{_ISO}') AS first_seen, strftime(make_timestamp(last * 1000000), '{_ISO}') AS last_seen, strftime(make_timestamp(last * 1000000), '%Y-%m-%d') AS date, round(minutes, 2) AS duration_minutes, duration_kind,
        CAST(n AS INT) AS candidate_count, items AS total_item_count, round(peak, 4) AS peak_score, round(avg, 4) AS avg_score, round(z, 4) AS peak_z_score, title AS representative_title, top AS top_conversation_id, CAST(len(convs) AS INT) AS conversation_count, array_to_string(kws, ', ') AS display_keywords_text, array_to_string(doms, ', ') AS domains_text, CAST(len(trace) AS INT) AS merge_count FROM tracked""",
    "bi_event_keywords": f"WITH RECURSIVE {TRACKED} SELECT id AS event_id, unnest(kws) AS keyword, CAST(generate_subscripts(kws, 1) AS INT) AS rank FROM tracked",
    "bi_event_domains": f"WITH RECURSIVE {TRACKED} SELECT id AS event_id, unnest(doms) AS domain, CAST(generate_subscripts(doms, 1) AS INT) AS rank FROM tracked",
    "bi_event_candidates": f"WITH RECURSIVE {TRACKED}, tr AS (SELECT id AS event_id, unnest(trace) AS t, CAST(generate_subscripts(trace, 1) AS INT) AS position FROM tracked) SELECT event_id, position, t.id AS candidate_id, t.score AS merge_score, t.reason AS merge_reason, t.seed AS was_seed_candidate, {_KIND} AS kind, TRUE AS resolved FROM tr JOIN cand ON candidate_id = t.id",
    "jsonl_roundtrip": f"WITH RECURSIVE {TRACKED} SELECT id AS event_id, first AS first_seen, last AS last_seen, CAST(n AS INT) AS candidate_count FROM tracked WHERE last >= 1704500000",
    "event_shares": f"WITH {_EVENTS}, r AS (SELECT 'status' AS section, status AS name FROM ev UNION ALL SELECT 'merge', CASE WHEN candidate_count > 1 THEN 'multi-candidate' ELSE 'single-candidate' END FROM ev UNION ALL SELECT 'channel', primary_channel FROM ev) SELECT section, name, count(*) AS n, round(count(*) / (SELECT count(*) FROM ev), 4) AS share FROM r GROUP BY ALL",
    "most_merged": "SELECT o_custkey AS event_id, max(o_orderpriority) AS primary_channel, count(*) AS candidate_count, max(o_orderkey) - min(o_orderkey) AS duration_minutes, 'customer ' || o_custkey AS representative_title FROM orders GROUP BY o_custkey ORDER BY candidate_count DESC, event_id LIMIT 8",
    "candidate_flags": f"WITH {CANDIDATES} SELECT {_KIND} AS kind, count(*) FILTER (size / 4 < 3.0) AS weak, count(*) FILTER (channel = 'view') AS from_general, count(*) FILTER (size % 7 = 0) AS hiring FROM cand GROUP BY 1",
    "repeated_stories": f"WITH {CANDIDATES} SELECT 'story ' || top AS title, count(*) AS n FROM cand WHERE {_KIND} = 'event_candidate' GROUP BY 1 ORDER BY n DESC, title LIMIT 8",
    "lowest_candidates": f"WITH {CANDIDATES} SELECT candidate_id, {_EVENT_SCORE} AS event_score, 'story ' || top AS top_story_title FROM cand WHERE {_KIND} = 'event_candidate' ORDER BY event_score, candidate_id LIMIT 5",
    "baseline_results": f"""WITH {CANDIDATES}, p AS (SELECT a.channel || '/' || a.cluster_id || '/' || (a.window_start // 43200) AS case_id, CASE WHEN a.window_start // 43200 % 3 > 0 THEN 'should_merge' ELSE 'should_not_merge' END AS expected, a.candidate_id AS candidate_a, b.candidate_id AS candidate_b, {_CONV} AS c, {_simp('kws')} AS k, {_simp('doms')} AS d, a.top <> 0 AND a.top = b.top AS t, a.top <> 0 AND list_contains(b.convs, a.top) AS r
            FROM cand a JOIN cand b ON a.channel = b.channel AND a.cluster_id = b.cluster_id AND b.window_start = a.window_start + 43200),
        s AS (SELECT *, round(CASE WHEN k = 0 AND NOT t THEN 0.0 ELSE CASE WHEN t THEN 0.25 ELSE 0.0 END + (0.3::DOUBLE * c + 0.15::DOUBLE * k + 0.05::DOUBLE * d) + CASE WHEN r AND NOT t THEN 0.1 ELSE 0.0 END END, 9) AS score FROM p)
        SELECT case_id, expected, candidate_a, candidate_b, round(score, 6) AS actual_score, (score >= 0.25) = (expected = 'should_merge') AS passed, CASE WHEN t THEN 'top_conv_match' WHEN r THEN 'reverse_anchor_match' WHEN c >= 0.3 THEN 'conv_overlap' WHEN k > 0 AND d > 0 THEN 'kw+domain' ELSE 'keyword' END AS merge_reason, '' AS notes FROM s""",
    "anomaly_tables": f"""WITH {CLUSTERS} SELECT hot.id, channel, strftime(make_timestamp(window_start * 1000000), '%Y-%m-%d %H:%M UTC') AS window_date, n AS "count", n AS texts_sampled, coalesce(keywords, '') AS keywords, texts FROM hot JOIN (SELECT id, count(*) AS n, count(DISTINCT text) AS texts FROM lab GROUP BY id) USING (id) LEFT JOIN (SELECT id, string_agg(array_to_string(keywords, ', '), '|' ORDER BY cluster_id) AS keywords FROM clus GROUP BY id) USING (id)""",
    "webhook_payloads": f"""WITH {ANOMALIES} SELECT id, '{{"embeds":[{{"title":"Surge Detected — ' || channel || '","color":15022389,"fields":[' || {_fields('name', 'inline')} || '],"footer":{{"text":"Surge Detection Engine"}}}}]}}' AS discord,
        '{{"text":"*Surge Detected — ' || channel || '*","attachments":[{{"color":"#E53935","fields":[' || {_fields('title', 'short')} || '],"footer":"Surge Detection Engine"}}]}}' AS slack,
        '{{"text":"SURGE | ' || channel || ' | ' || {_WHEN} || ' | count=5 z=' || {_Z} || ' | ' || {_KW} || '"}}' AS plain FROM hot""",
    "channel_daily_summary": f"WITH {_EVENTS} SELECT strftime(last, '%Y-%m-%d') AS date, primary_channel, count(*) AS events, count(*) FILTER (candidate_count > 1) AS merged_events, {_KINDS}, CAST(sum(candidate_count) AS BIGINT) AS candidates, CAST(sum(items) AS BIGINT) AS items, round(avg(peak), 4) AS avg_peak_score, round(max(peak), 4) AS max_peak_score, round(max(z), 4) AS max_z FROM ev GROUP BY ALL",
    "evaluation_summary_pivot": f"""WITH {_EVENTS}, a AS (SELECT count(*) AS events, count(*) FILTER (candidate_count > 1) AS multi, CAST(sum(candidate_count) AS BIGINT) AS merged_candidates, count(*) FILTER (primary_channel = '1-URGENT') AS events_urgent, count(*) FILTER (primary_channel = '2-HIGH') AS events_high, {_KINDS} FROM ev),
        b AS (SELECT count(*) AS candidates, count(*) FILTER (l_returnflag = 'R') AS event_candidates, count(*) FILTER (l_returnflag <> 'R' AND l_linestatus = 'O') AS recurring FROM lineitem) SELECT *, round(multi / greatest(events, 1), 4) AS multi_rate, round(event_candidates / greatest(candidates, 1), 4) AS event_rate FROM a, b""",
    "event_summary_buckets": f"WITH {_EVENTS} SELECT CASE WHEN minutes < 30 THEN '<30m' WHEN minutes < 120 THEN '30m-2h' WHEN minutes <= 360 THEN '2h-6h' ELSE '>6h' END AS bucket, count(*) AS events, count(*) FILTER (candidate_count > 1) AS multi, round(max(minutes), 2) AS longest FROM ev GROUP BY 1",
    "candidate_summary": f"""WITH {CANDIDATES}, k AS (SELECT *, CASE WHEN uniq = 0 THEN 'unknown' WHEN pct >= 0.8 OR uniq <= 1 THEN 'viral_post' WHEN len(kws) < 2 THEN 'topic_surge' WHEN uniq >= 3 AND len(doms) >= 2 AND size >= 10 THEN 'event_candidate' ELSE 'topic_surge' END AS kind FROM cand)
        SELECT kind, count(*) AS n, count(*) FILTER (pct >= 0.8) AS dominated, count(*) FILTER (len(kws) < 2) AS few_words, round(count(*) / (SELECT count(*) FROM k), 4) AS share FROM k GROUP BY kind""",
    "candidate_left_join_unresolved": "SELECT coalesce(o_orderstatus, '') AS status, count(*) AS lines, count(*) FILTER (o_orderstatus IS NULL) AS unresolved FROM lineitem LEFT JOIN (SELECT o_orderkey, o_orderstatus FROM orders WHERE o_orderpriority = '1-URGENT') ON l_orderkey = o_orderkey GROUP BY 1",
    "topk_by_score": _TOPK,
    "csv_export_roundtrip": _TOPK,
    "correlated_groupconcat": "SELECT c_custkey, c_nationkey, coalesce((SELECT string_agg(DISTINCT o_orderpriority, '|' ORDER BY o_orderpriority) FROM orders WHERE o_custkey = c_custkey), '') AS priorities FROM customer",
    "full_outer_phase_compare": "WITH f AS (SELECT o_custkey, count(*) AS n FROM orders WHERE o_orderstatus = 'F' GROUP BY 1), p AS (SELECT o_custkey, count(*) AS n FROM orders WHERE o_orderstatus = 'P' GROUP BY 1) SELECT o_custkey, coalesce(f.n, 0) AS phase_1, coalesce(p.n, 0) AS phase_2 FROM f FULL JOIN p USING (o_custkey)",
    "global_aggregates": "SELECT max(l_quantity) AS max_quantity, round(avg(l_quantity), 6) AS avg_quantity, count(*) AS n FROM lineitem",
    "range_filter_scan": "SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem WHERE l_quantity >= 49 AND l_returnflag = 'R' AND l_discount = 0.05",
    "top_keywords_report": f"WITH {CANDIDATES} SELECT keyword, count(*) AS n FROM (SELECT unnest(kws) AS keyword FROM cand) GROUP BY 1 ORDER BY n DESC, keyword LIMIT 12",
    "parquet_partition_prune": f"WITH {ANOMALIES} SELECT id, channel, z_score FROM hot WHERE window_end >= epoch(TIMESTAMP '2024-01-02') AND window_end < epoch(TIMESTAMP '2024-01-04')",
    "candidates_between_days": f"WITH {CANDIDATES} SELECT candidate_id, {_KIND} AS kind, {_EVENT_SCORE} AS event_score, size, array_to_string(kws, ',') AS keywords, 0.0::DOUBLE AS dbscan_eps FROM cand WHERE window_start + 43200 >= epoch(TIMESTAMP '2024-01-05') AND window_start + 43200 < epoch(TIMESTAMP '2024-01-08')",
    "stories_csv_roundtrip": "SELECT doc_id AS item_id, CASE WHEN doc_id % 3 = 0 THEN 'story' ELSE 'comment' END AS item_type, source AS author, doc_id * 60 AS sec, md5(text) AS body_md5, CASE WHEN doc_id % 3 > 0 THEN doc_id // 3 * 3 ELSE -1 END AS parent, '' AS url, FALSE AS deleted FROM documents",
    "firehose_posts": """SELECT 'at://' || source || '/app.bsky.feed.post/' || doc_id AS platform_uri, CASE WHEN doc_id % 4 = 0 THEN 'at://root/' || doc_id ELSE 'at://' || source || '/app.bsky.feed.post/' || doc_id END AS root_uri, CASE WHEN doc_id % 4 = 0 THEN 'at://parent/' || doc_id ELSE '' END AS parent_uri, doc_id % 4 = 0 AS is_reply, doc_id AS sec, source AS author, md5(text) AS body_md5, substring(text, 1, 100) AS story_title, lang AS langs,
        CASE WHEN doc_id % 3 < 2 THEN 'Tag' || doc_id ELSE '' END AS hashtags, CASE WHEN doc_id % 3 > 0 THEN 'https://l.example/' || doc_id ELSE '' END AS links, ['app.bsky.embed.external', 'app.bsky.embed.images', 'app.bsky.embed.video', 'app.bsky.embed.record', ''][doc_id % 5 + 1] AS embed_type, doc_id % 5 = 1 AS has_image, CASE WHEN doc_id % 5 = 1 THEN 2 ELSE 0 END AS image_count, doc_id % 5 = 2 AS has_video, doc_id % 5 = 0 AS has_external_link,
        CASE WHEN doc_id % 5 = 0 THEN 'https://e.example/' || doc_id ELSE '' END AS external_uri, doc_id % 5 = 3 AS has_quote_post, CASE WHEN doc_id % 5 = 1 THEN 'alt a,alt b' ELSE '' END AS alt_texts, CASE WHEN doc_id % 5 = 0 THEN 'Title ' || doc_id || CASE WHEN doc_id % 2 = 0 THEN '' ELSE ' words' END ELSE '' END AS embed_text FROM documents WHERE doc_id % 7 > 0 AND doc_id % 11 > 0""",
    "manifest_antijoin": "SELECT o_orderkey FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_shipdate < '1998-01-01')",
    "stream_sliding_counts": f"""WITH {ITEMS}, t AS (SELECT unnest(generate_series((SELECT CAST(ceil(min(sec) / 300.0) * 300 AS BIGINT) FROM items), (SELECT CAST(floor(max(sec) / 300.0) * 300 + 7200 AS BIGINT) FROM items), 300)) AS tick)
        SELECT channel, tick, count(*) AS n FROM items JOIN t ON sec <= tick AND sec > tick - 7200 WHERE tick + 1 <= (SELECT max(sec) - 600 FROM items) GROUP BY ALL""",
    "stream_schmitt": f"WITH RECURSIVE {FROZEN} SELECT f.* FROM fired f JOIN (SELECT channel, max(sec) AS newest FROM items GROUP BY channel) USING (channel) WHERE tick < greatest(newest, (SELECT max(sec) - 600 FROM items))",
    "stream_dedup": "SELECT event_type AS channel, count(DISTINCT event_id) AS n FROM events GROUP BY 1",
    "stream_session_lifecycle": f"""WITH {ITEMS}, t AS (SELECT event_type AS channel, epoch_us(ts) AS us FROM events), g AS (SELECT *, us - lag(us) OVER (PARTITION BY channel ORDER BY us) >= 600000000 AS brk FROM t),
        s AS (SELECT *, sum(CASE WHEN brk THEN 1 ELSE 0 END) OVER (PARTITION BY channel ORDER BY us ROWS UNBOUNDED PRECEDING) AS no FROM g) SELECT channel, CAST(floor(min(us) / 1000000) AS BIGINT) AS start, CAST(floor((max(us) + 600000000) / 1000000) AS BIGINT) AS "end", count(*) AS n FROM s GROUP BY channel, no HAVING max(us) + 600000000 <= (SELECT max(us) FROM t) // 1000 * 1000 - 600000000""",
}
