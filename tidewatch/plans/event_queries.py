"""Candidates, merging, cross-channel events and hashtags, on anomalies made from the events table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidewatch.functions import text as T
from tidewatch.operators import candidates as A
from tidewatch.operators import clustering as K
from tidewatch.operators import consolidation as M
from tidewatch.operators import crosschannel as X
from tidewatch.operators import enrichment as E
from tidewatch.operators import hashtags as H
from tidewatch.plans.detection_queries import ITEMS, SURGES, surge_records
from tidewatch.schema import event_items


def _items(spark: SparkSession, sf_dir: str) -> DataFrame:
    return event_items(spark.read.parquet(f"{sf_dir}/events.parquet"))


def _candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clusters of 12 hours by author: every channel's window with its stories, hosts and words."""
    items = _items(spark, sf_dir).withColumn("window_start", (F.floor(F.col("sec") / 43200) * 43200).cast("long")).withColumn("cluster_id", F.col("author") % 2)
    stories = items.groupBy("channel", "window_start", "cluster_id", "story_id").agg(F.count("*").alias("n"))
    text = lambda p, m: F.array_sort(F.collect_set(F.concat(F.lit(p), (F.col("story_id") % m).cast("string"))))
    rows = stories.groupBy("channel", "window_start", "cluster_id").agg(
        F.sum("n").alias("size"), F.count("*").alias("unique"), F.max("n").alias("most"), F.max_by("story_id", F.struct("n", -F.col("story_id"))).alias("top_story_id"), F.array_sort(F.collect_list("story_id")).alias("conversation_ids"), text("h", 3).alias("top_domains"), text("w", 9).alias("keywords"),
    )
    pct = F.round(F.col("most") / F.col("size"), 3)
    kind = A.kind(F.col("unique"), pct, F.col("size"), F.col("top_domains"), F.col("keywords"))
    score = A.event_score(F.col("unique"), pct, F.col("size"), F.col("top_domains"), F.col("keywords"), F.col("size") / 4, F.col("channel"))
    return rows.select(
        F.concat_ws(":", F.lit("ev"), "channel", (F.col("window_start") + 43200).cast("string"), F.col("cluster_id").cast("string")).alias("candidate_id"), F.lit("hn").alias("source"), "channel", "window_start", (F.col("window_start") + 43200).alias("window_end"), "cluster_id",
        kind.alias("kind"), score.alias("event_score"), "size", F.col("unique").alias("unique_conversation_count"), pct.alias("top_conversation_pct"), "top_story_id", F.concat(F.lit("story "), F.col("top_story_id").cast("string")).alias("top_story_title"), "conversation_ids", "top_domains", "keywords", (F.col("size") / 4).alias("z_score"), F.col("size").alias("window_count"),
    )


def candidate_classify_score(spark, sf_dir):
    return _candidates(spark, sf_dir).select("candidate_id", "kind", "event_score", "size", "unique_conversation_count", "top_conversation_pct", "top_story_id")


def pairwise_merge_score(spark, sf_dir):
    """Each candidate against those of its channel's next window."""
    own = _candidates(spark, sf_dir)
    names = own.columns
    a = own.select(F.struct(*names).alias("a"), "channel", F.col("window_end").alias("meets"))
    b = own.select(F.struct(*names).alias("b"), "channel", F.col("window_start").alias("meets"))
    scored = M.score_pairs(a.join(b, ["channel", "meets"]).select("a", "b"), 9)
    return scored.select(F.col("a.candidate_id").alias("a_id"), F.col("b.candidate_id").alias("b_id"), *[F.round(c, 6).alias(c) for c in ("conversation_overlap", "keyword_overlap", "domain_overlap")], "merge_score", "merge_reason")


def _tracked(spark, sf_dir):
    return M.consolidate(_candidates(spark, sf_dir).withColumn("kind", F.when(F.col("size") >= 10, "event_candidate").otherwise(F.col("kind"))))


def consolidate_events(spark, sf_dir):
    return _tracked(spark, sf_dir).select("event_id", "primary_channel", "first_seen", "last_seen", "candidate_count", "total_item_count", "peak_score", F.round("avg_score", 4).alias("avg_score"), "duration_kind", F.size("merge_trace").alias("merges"))


def duration_label_buckets(spark, sf_dir):
    minutes = (F.col("released_at") - F.col("event_start")) / 60
    kinds = surge_records(spark, sf_dir).where("released_at IS NOT NULL").select(T.duration_kind(F.col("updates") + 1, minutes).alias("duration_kind"), T.duration_bucket(minutes).alias("bucket"))
    return kinds.groupBy("duration_kind", "bucket").agg(F.count("*").alias("n"))


def _anomalies(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    """Hours with twice a channel's usual items or more, and the words of their clusters."""
    items = _items(spark, sf_dir).withColumn("window_start", (F.floor(F.col("sec") / 3600) * 3600).cast("long"))
    counts = items.groupBy("channel", "window_start").agg(F.count("*").alias("n"))
    usual = counts.groupBy("channel").agg((F.sum("n") / F.count("*")).alias("mean"))
    hot = counts.join(usual, "channel").where("n >= 1.5 * mean")
    number = F.array_position(F.array(*map(F.lit, ["click", "error", "purchase", "signup", "view"])), F.col("channel")).cast("long")
    hot = hot.select((F.col("window_start") / 3600 * 10).cast("long").alias("hour"), "channel", "window_start", (F.col("window_start") + 3600).alias("window_end"), F.round(F.col("n") / F.col("mean"), 6).alias("z_score")).withColumn("id", F.col("hour") + number).drop("hour")
    words = items.drop("id").join(hot.select("id", "channel", "window_start"), ["channel", "window_start"]).select("id", (F.col("author") % 2).alias("cluster_id"), F.concat(F.lit("w"), (F.col("story_id") % 8).cast("string")).alias("word")).distinct()
    return hot, words


def flash_edges(spark, sf_dir):
    return X.flash_edges(*_anomalies(spark, sf_dir)).select("a", "b", F.round("overlap", 6).alias("overlap"))


def flash_components(spark, sf_dir):
    """Components of close pairs only, so that there are many."""
    anomalies, words = _anomalies(spark, sf_dir)
    return X.components(X.flash_edges(anomalies, words, 3600, 0.9))


def hourly_representatives(spark, sf_dir):
    """Half-hour windows, of which an hour keeps the one that passes its channel's mean most."""
    items = _items(spark, sf_dir).withColumn("window_start", (F.floor(F.col("sec") / 1800) * 1800).cast("long"))
    counts = items.groupBy("channel", "window_start").agg(F.count("*").alias("n"), F.min("id").alias("id"))
    usual = counts.groupBy("channel").agg((F.sum("n") / F.count("*")).alias("mean"))
    windows = counts.join(usual, "channel").select("id", "channel", "window_start", (F.col("window_start") + 1800).alias("window_end"), F.round(F.col("n") / F.col("mean"), 6).alias("z_score"))
    return X.hourly_best(windows).select("id", "channel", "window_end", "z_score")


#: Made-up words of stories, by number: whole sentences stand for texts.
STORY_WORDS = ["running engines", "communication networks", "national questions", "hopping rabbits", "generously funded", "people running", "relational databases", "the audio message", "agreed questions"]
#: Their stems less stopped ones, as text: what the words of a cluster become.
STEMS = {"running": "run", "engines": "engin", "communication": "communic", "networks": "network", "national": "nation", "questions": "question", "hopping": "hop", "rabbits": "rabbit", "generously": "generous", "funded": "fund", "people": "peopl", "relational": "relat", "databases": "databas", "audio": "audio", "message": "messag", "agreed": "agre"}


def _enriched(spark, sf_dir):
    """Anomalous hours (as _anomalies has them) with clusters of their items: by author, every fifth one noise, texts by story."""
    anomalies, _ = _anomalies(spark, sf_dir)
    hours = _items(spark, sf_dir).withColumn("window_start", (F.floor(F.col("sec") / 3600) * 3600).cast("long")).withColumnRenamed("id", "item_id")
    own = hours.join(anomalies.select("id", "channel", "window_start"), ["channel", "window_start"])
    text = F.element_at(F.array(*map(F.lit, STORY_WORDS)), (F.col("story_id") % len(STORY_WORDS) + 1).cast("int"))
    label = F.when(F.col("author") % 5 == 4, F.lit(-1)).otherwise(F.col("author") % 2).cast("long")
    labelled = own.select("id", F.col("item_id").alias("pos"), label.alias("cluster_id"), text.alias("text"), F.col("story_id"), F.concat(F.lit("story "), F.col("story_id").cast("string")).alias("story_title"), F.concat(F.lit("h"), (F.col("story_id") % 3).cast("string")).alias("domain"))
    rows = E.cluster_rows(labelled, ["id"])
    counts = own.groupBy("id").agg(F.count("*").alias("count"))
    return anomalies.join(counts, "id"), rows, labelled


def cluster_table(spark, sf_dir):
    """Clusters with keywords, noise and stories."""
    _, rows, _ = _enriched(spark, sf_dir)
    text = lambda c: F.array_join(F.transform(c, lambda x: x.cast("string")), ",").alias(c)
    return rows.select("id", "cluster_id", "size", "noise_count", text("keywords"), "top_story_id", "top_story_title", "top_story_pct", "unique_story_count", text("story_ids"), text("top_domains"))


def enriched_candidates(spark, sf_dir):
    """Candidates of the anomalies with their clusters."""
    anomalies, rows, _ = _enriched(spark, sf_dir)
    return A.build_candidates(E.with_clusters(anomalies, rows, ["id"])).select("candidate_id", "kind", "event_score", "size", "unique_conversation_count", "top_conversation_pct", "top_story_id", F.array_join("keywords", ",").alias("keywords"), "window_count")


def stemmed_cluster_words(spark, sf_dir):
    """Stems of the clusters' keywords less stop words, as channels are compared by."""
    _, rows, _ = _enriched(spark, sf_dir)
    return X.cluster_words(rows.select("id", "cluster_id", F.array_join("keywords", ", ").alias("keywords")))


def flash_on_stems(spark, sf_dir):
    """Close pairs of anomalies of different channels, on the stems of their clusters' keywords."""
    anomalies, rows, _ = _enriched(spark, sf_dir)
    return X.flash_edges(anomalies, X.cluster_words(rows.select("id", "cluster_id", "keywords")), 3600, 0.9).select("a", "b", F.round("overlap", 6).alias("overlap"))


def sustained_chains(spark, sf_dir):
    return X.sustained_events(*_anomalies(spark, sf_dir)).drop("anomaly_ids")


def isolated_antijoin(spark, sf_dir):
    """Anomalies that no close pair claims."""
    anomalies, words = _anomalies(spark, sf_dir)
    edges = X.flash_edges(anomalies, words, 3600, 0.9)
    claimed = edges.select(F.col("a").alias("id")).union(edges.select("b")).distinct()
    return anomalies.join(claimed, "id", "left_anti").select("id", "channel", "z_score")


def shared_keywords(spark, sf_dir):
    anomalies, words = _anomalies(spark, sf_dir)
    sets = words.join(anomalies.select("id", "channel", F.floor(F.col("window_start") / 86400).alias("day")), "id").select("channel", "day", F.col("id").alias("member"), "word")
    return X.shared_keywords(sets, ["channel", "day"])


def claim_union_sort(spark, sf_dir):
    return X.aggregate_events(*_anomalies(spark, sf_dir)).drop("anomaly_ids")


def interval_join_collect(spark, sf_dir):
    """Items inside each surge, both ends included: their number and stories."""
    items = _items(spark, sf_dir).withColumn("body", F.concat(F.lit("story "), F.col("story_id").cast("string")))
    windows = surge_records(spark, sf_dir).select(F.col("event_id").alias("window_id"), "channel", F.col("event_start").alias("window_start"), F.col("last_seen").alias("window_end"))
    found = K.collect_texts(items, windows, 10**9)
    return found.groupBy("window_id").agg(F.count("*").alias("n"), F.countDistinct("text").alias("texts"))


def _posts(spark, sf_dir):
    tags = F.array(F.concat(F.lit("T"), (F.col("story_id") % 40).cast("string")), F.concat(F.lit("u"), (F.col("author") % 25).cast("string")))
    return _items(spark, sf_dir).select("id", "sec", tags.alias("hashtags"), F.when(F.col("channel").isin("view", "error"), "general").otherwise(F.col("channel")).alias("channel"), "author", F.when(F.col("story_id") % 6 == 0, "").otherwise(F.concat(F.lit("d"), (F.col("story_id") % 6).cast("string"))).alias("domain"), F.concat(F.lit("post "), F.col("id").cast("string")).alias("body"))


def tag_counts(spark, sf_dir):
    return H.totals(H.occurrences(_posts(spark, sf_dir)))


def tag_promotion(spark, sf_dir):
    return H.promoted(H.occurrences(_posts(spark, sf_dir))).select("tag", F.col("since.id").alias("since_id"), F.col("since.sec").alias("since_sec"))


def tag_cooccurrence(spark, sf_dir):
    found = H.occurrences(_posts(spark, sf_dir))
    return H.partners(found, H.promoted(found), 20)


def tag_suggestions(spark, sf_dir):
    found = H.occurrences(_posts(spark, sf_dir))
    return H.suggestions(H.snapshot(found)).select("tag", "total", "unmatched", "unmatched_rate", "unique_authors_capped", "action", "confidence")


def tag_snapshot(spark, sf_dir):
    """Every tag's totals and what stands beside it."""
    snap = H.snapshot(H.occurrences(_posts(spark, sf_dir)))
    listed = lambda c: F.coalesce(F.array_join(F.transform(c, lambda x: F.concat_ws(":", x["value"], x["n"].cast("string"))), ","), F.lit("")).alias(c)
    return snap.select("tag", "total", "matched", "unmatched", listed("channels"), listed("cohashtags"), listed("domains"), F.coalesce(F.array_join("samples", "|"), F.lit("")).alias("samples"), "unique_authors_capped")


def tag_unmatched_report(spark, sf_dir):
    return H.unmatched_report(H.snapshot(H.occurrences(_posts(spark, sf_dir))), 20)


def tag_routed_report(spark, sf_dir):
    return H.routed_report(H.snapshot(H.occurrences(_posts(spark, sf_dir))), 20)


def set_measures(spark, sf_dir):
    """Jaccard and overlap coefficients of consecutive candidates' words."""
    own = _candidates(spark, sf_dir)
    order = Window.partitionBy("channel", "cluster_id").orderBy("window_start")
    both = own.withColumn("before", F.lag("conversation_ids").over(order)).where("before IS NOT NULL")
    return both.select("candidate_id", F.round(T.jaccard(F.col("conversation_ids"), F.col("before")), 6).alias("jaccard"), F.round(T.simpson(F.col("conversation_ids"), F.col("before")), 6).alias("simpson"))


QUERIES = {f.__name__: f for f in (candidate_classify_score, pairwise_merge_score, consolidate_events, duration_label_buckets, flash_edges, flash_components, cluster_table, enriched_candidates, stemmed_cluster_words, flash_on_stems, hourly_representatives, sustained_chains, isolated_antijoin, shared_keywords, claim_union_sort, interval_join_collect, tag_counts, tag_promotion, tag_cooccurrence, tag_suggestions, tag_snapshot, tag_unmatched_report, tag_routed_report, set_measures)}

CANDIDATES = f"""{ITEMS}, st AS (SELECT channel, CAST(floor(sec / 43200.0) * 43200 AS BIGINT) AS window_start, author % 2 AS cluster_id, story_id, count(*) AS n FROM items GROUP BY ALL),
    cl AS (SELECT channel, window_start, cluster_id, CAST(sum(n) AS BIGINT) AS size, count(*) AS uniq, max(n) AS most, arg_max(story_id, n * 1000000 - story_id) AS top, list(story_id ORDER BY story_id) AS convs, list_sort(list_distinct(list('h' || (story_id % 3)))) AS doms, list_sort(list_distinct(list('w' || (story_id % 9)))) AS kws FROM st GROUP BY ALL),
    cand AS (SELECT *, 'ev:' || channel || ':' || (window_start + 43200) || ':' || cluster_id AS candidate_id, round(most / size, 3) AS pct FROM cl)"""
ANOMALIES = f"""{ITEMS}, it AS (SELECT *, CAST(floor(sec / 3600.0) * 3600 AS BIGINT) AS window_start FROM items), cn AS (SELECT channel, window_start, count(*) AS n FROM it GROUP BY ALL), us AS (SELECT channel, sum(n) / count(*) AS mean FROM cn GROUP BY channel),
    hot AS (SELECT CAST(window_start / 3600 * 10 AS BIGINT) + list_position(['click', 'error', 'purchase', 'signup', 'view'], channel) AS id, channel, window_start, window_start + 3600 AS window_end, round(n / mean, 6) AS z_score FROM cn JOIN us USING (channel) WHERE n >= 1.5 * mean),
    words AS (SELECT DISTINCT hot.id, author % 2 AS cluster_id, 'w' || (story_id % 8) AS word FROM it JOIN hot USING (channel, window_start)), sz AS (SELECT id, cluster_id, count(*) AS size FROM words GROUP BY ALL)"""


def _edges(seconds: int, overlap: float) -> str:
    return f"""{ANOMALIES}, pr AS (SELECT x.id AS a, y.id AS b, u.cluster_id AS ca, v.cluster_id AS cb, count(*) AS common FROM hot x JOIN hot y ON x.id < y.id AND x.channel <> y.channel AND abs(x.window_start - y.window_start) <= {seconds} JOIN words u ON u.id = x.id JOIN words v ON v.id = y.id AND v.word = u.word GROUP BY ALL HAVING count(*) >= 2),
        edges AS (SELECT a, b, max(common / least(s.size, t.size)) AS overlap FROM pr JOIN sz s ON s.id = a AND s.cluster_id = ca JOIN sz t ON t.id = b AND t.cluster_id = cb GROUP BY a, b HAVING max(common / least(s.size, t.size)) >= {overlap})"""


POSTS = f"""{ITEMS}, dom AS (SELECT *, CASE WHEN story_id % 6 = 0 THEN '' ELSE 'd' || (story_id % 6) END AS domain FROM items), oc AS (SELECT id, sec, 0 AS pos, 't' || (story_id % 40) AS tag, channel, author, domain FROM dom UNION ALL SELECT id, sec, 1, 'u' || (author % 25), channel, author, domain FROM dom),
    nth AS (SELECT *, row_number() OVER (PARTITION BY tag ORDER BY sec, id, pos) AS k FROM oc)"""
_CONV = "CASE WHEN len(list_distinct(list_concat(a.convs, b.convs))) > 0 THEN len(list_intersect(a.convs, b.convs)) / len(list_distinct(list_concat(a.convs, b.convs))) ELSE 0.0 END"
_simp = lambda f: f"len(list_intersect(a.{f}, b.{f})) / least(len(a.{f}), len(b.{f}))"

_rank = lambda rows, most: f"(SELECT tag, string_agg(v || ':' || n, ',' ORDER BY place) AS list, string_agg(v || ':' || n, '  ' ORDER BY place) FILTER (place <= 5) AS short, max(v) FILTER (place = 1) AS first FROM (SELECT *, row_number() OVER (PARTITION BY tag ORDER BY n DESC, v) AS place FROM ({rows})) WHERE place <= {most} GROUP BY tag)"
SNAPSHOT = f"""{POSTS}, own AS (SELECT * FROM nth WHERE k >= 5), tot AS (SELECT tag, count(*) AS total, count(*) FILTER (channel NOT IN ('view', 'error')) AS matched, count(*) FILTER (channel IN ('view', 'error')) AS unmatched FROM oc GROUP BY tag),
    ca AS (SELECT a.tag, b.tag AS v, count(*) AS n, min((a.sec, a.id, a.pos, b.pos)) AS first FROM own a JOIN oc b ON a.id = b.id AND a.tag <> b.tag GROUP BY a.tag, b.tag), co AS (SELECT * FROM ca QUALIFY row_number() OVER (PARTITION BY tag ORDER BY first) <= 50),
    snap AS (SELECT tag, total, matched, unmatched, ch.list AS channels, ch.short AS ch5, ch.first AS ch1, pa.list AS cohashtags, pa.short AS pa5, dm.list AS domains, dm.short AS dm5, sa.texts AS samples, coalesce(au.n, 0) AS authors FROM tot
        LEFT JOIN {_rank("SELECT tag, channel AS v, count(*) AS n FROM own WHERE channel NOT IN ('view', 'error') GROUP BY ALL", 10)} ch USING (tag) LEFT JOIN {_rank("SELECT tag, v, n FROM co", 20)} pa USING (tag) LEFT JOIN {_rank("SELECT tag, domain AS v, count(*) AS n FROM own WHERE domain <> '' GROUP BY ALL", 20)} dm USING (tag)
        LEFT JOIN (SELECT tag, list('post ' || id ORDER BY sec, id, pos)[1:3] AS texts FROM own GROUP BY tag) sa USING (tag) LEFT JOIN (SELECT tag, least(count(DISTINCT author), 100) AS n FROM own GROUP BY tag) au USING (tag)),
    rated AS (SELECT *, round(unmatched / total, 4) AS rate FROM snap)"""
#: Clusters of anomalous hours: labels, texts, keywords by c-TF-IDF, stories.
CLUSTERS = f"""{ANOMALIES}, lab AS (SELECT hot.id, it.id AS pos, CASE WHEN author % 5 = 4 THEN -1 ELSE author % 2 END AS cluster_id, {STORY_WORDS}[story_id % {len(STORY_WORDS)} + 1] AS text, story_id, 'h' || (story_id % 3) AS domain FROM it JOIN hot USING (channel, window_start)),
    tok AS (SELECT id, cluster_id, pos, unnest(l) AS token, generate_subscripts(l, 1) AS nr FROM (SELECT *, list_filter(string_split(text, ' '), lambda w: w NOT IN ('the', 'people')) AS l FROM lab WHERE cluster_id >= 0)),
    cn2 AS (SELECT id, cluster_id, token, count(*) AS n, min((pos, nr)) AS first FROM tok GROUP BY ALL), tt AS (SELECT id, cluster_id, sum(n) AS total FROM cn2 GROUP BY ALL), cs AS (SELECT id, count(*) AS clusters FROM tt GROUP BY id), fd AS (SELECT id, token, count(*) AS df FROM cn2 GROUP BY ALL),
    rk AS (SELECT *, row_number() OVER (PARTITION BY id, cluster_id ORDER BY round(n / total * (ln((clusters + 1) / (df + 1)) + 1), 12) DESC, first, token) AS place FROM cn2 JOIN tt USING (id, cluster_id) JOIN cs USING (id) JOIN fd USING (id, token)),
    kws AS (SELECT id, cluster_id, list(token ORDER BY place) AS keywords FROM rk WHERE place <= 8 GROUP BY ALL),
    sto AS (SELECT id, cluster_id, story_id, count(*) AS n, min(pos) AS pos FROM lab WHERE cluster_id >= 0 AND story_id <> 0 GROUP BY ALL), known AS (SELECT id, cluster_id, sum(n) AS known, count(*) AS stories, list(story_id ORDER BY story_id) AS ids FROM sto GROUP BY ALL),
    tops AS (SELECT id, cluster_id, story_id AS top, n AS most FROM sto QUALIFY row_number() OVER (PARTITION BY id, cluster_id ORDER BY n DESC, pos) = 1),
    hst AS (SELECT id, cluster_id, list(domain ORDER BY n DESC, pos, domain) AS hosts FROM (SELECT id, cluster_id, domain, count(*) AS n, min(pos) AS pos FROM lab WHERE cluster_id >= 0 GROUP BY ALL) GROUP BY ALL),
    clus AS (SELECT z.id, z.cluster_id, z.size, no.noise AS noise_count, coalesce(keywords, []) AS keywords, coalesce(top, 0) AS top_story_id, CASE WHEN top IS NULL THEN '' ELSE 'story ' || top END AS title, round(coalesce(most / known, 0.0), 3) AS pct, coalesce(stories, 0) AS uniq, coalesce(ids, []) AS ids, CASE WHEN known > 0 THEN hosts ELSE [] END AS hosts
        FROM (SELECT id, cluster_id, count(*) AS size FROM lab WHERE cluster_id >= 0 GROUP BY ALL) z JOIN (SELECT id, count(*) FILTER (cluster_id < 0) AS noise FROM lab GROUP BY id) no USING (id) LEFT JOIN kws USING (id, cluster_id) LEFT JOIN known USING (id, cluster_id) LEFT JOIN tops USING (id, cluster_id) LEFT JOIN hst USING (id, cluster_id)),
    stems(word, stem) AS (VALUES {', '.join(f"('{w}', '{x}')" for w, x in STEMS.items())}), cw AS (SELECT DISTINCT id, cluster_id, stem AS word FROM (SELECT id, cluster_id, unnest(keywords) AS word FROM clus) JOIN stems USING (word) WHERE stem NOT IN ('peopl', 'audio', 'messag', 'question'))"""


_EVENT = "STRUCT(id VARCHAR, first BIGINT, last BIGINT, title VARCHAR, top BIGINT, convs BIGINT[], anchors BIGINT[], kws VARCHAR[], doms VARCHAR[], n BIGINT, items BIGINT, peak DOUBLE, avg DOUBLE, z DOUBLE, trace STRUCT(id VARCHAR, score DOUBLE, reason VARCHAR, seed BOOLEAN)[])"
_share = lambda own, new: f"CASE WHEN len({own}) > 0 AND len({new}) > 0 THEN len(list_intersect({own}, {new})) / least(len({own}), len({new})) ELSE 0.0 END"
_more = lambda own, new, most: f"list_concat({own}, list_slice(list_filter({new}, lambda x: NOT list_contains({own}, x)), 1, greatest(1, {most} - len({own}))))"
#: Tracked events: candidates of a channel one by one, against the list of its open events.
TRACKED = f"""{CANDIDATES}, seq AS (SELECT *, row_number() OVER (PARTITION BY channel ORDER BY window_start, candidate_id) AS k, window_start + 43200 AS we, size / 4 AS z, 'story ' || top AS title,
        round(0.25 * least(uniq / 5, 1) + 0.2 * (1 - pct) + 0.2 * least(len(doms) / 3, 1) + 0.15 * least(size / 100, 1) + 0.1 * least(size / 4 / 10, 1) + 0.1 * least(len(kws) / 5, 1), 4) AS score FROM cand WHERE size >= 10),
    walk AS (SELECT DISTINCT channel, 0::BIGINT AS k, []::{_EVENT}[] AS live, []::{_EVENT}[] AS shut FROM seq
        UNION ALL SELECT channel, k, CASE WHEN best >= 0.25 THEN list_transform(live, lambda e, i: CASE WHEN i = list_position(scores, best) THEN {{'id': e.id, 'first': e.first, 'last': greatest(e.last, we),
                'title': CASE WHEN score >= e.peak THEN title ELSE e.title END, 'top': CASE WHEN score >= e.peak THEN top ELSE e.top END, 'convs': {_more("e.convs", "convs", 50)},
                'anchors': CASE WHEN top <> 0 AND NOT list_contains(e.anchors, top) AND len(e.anchors) < 10 AND (round(ov[i].k, 4) >= 0.15 OR round(ov[i].d, 4) >= 0.3) THEN list_append(e.anchors, top) ELSE e.anchors END,
                'kws': {_more("e.kws", "kws", 15)}, 'doms': {_more("e.doms", "doms", 10)}, 'n': e.n + 1, 'items': e.items + uniq, 'peak': greatest(e.peak, score), 'avg': round((e.n * e.avg + score) / (e.n + 1), 6), 'z': greatest(e.z, z),
                'trace': list_append(e.trace, {{'id': candidate_id, 'score': best, 'reason': CASE WHEN ov[i].t THEN 'top_conv_match' WHEN ov[i].r THEN 'reverse_anchor_match' WHEN ov[i].c >= 0.3 THEN 'conv_overlap' WHEN ov[i].k > 0 AND ov[i].d > 0 THEN 'kw+domain' ELSE 'keyword' END, 'seed': FALSE}})}}::{_EVENT} ELSE e END)
            ELSE list_append(live, {{'id': 'ev:' || candidate_id, 'first': window_start, 'last': we, 'title': title, 'top': top, 'convs': convs, 'anchors': CASE WHEN top <> 0 THEN [top] ELSE [] END, 'kws': kws, 'doms': doms, 'n': 1, 'items': uniq, 'peak': score, 'avg': score, 'z': z, 'trace': [{{'id': candidate_id, 'score': NULL, 'reason': NULL, 'seed': TRUE}}]}}::{_EVENT}) END, shut
        FROM (SELECT *, coalesce(list_max(scores), 0.0) AS best FROM (SELECT *, list_transform(ov, lambda o: CASE WHEN NOT o.near OR (o.k = 0 AND NOT o.t) THEN 0.0::DOUBLE ELSE round(CASE WHEN o.t THEN 0.25::DOUBLE ELSE 0.0::DOUBLE END + (0.3::DOUBLE * o.c + 0.15::DOUBLE * o.k + 0.05::DOUBLE * o.d) + CASE WHEN o.r AND NOT o.t THEN 0.1::DOUBLE ELSE 0.0::DOUBLE END, 4) END) AS scores
            FROM (SELECT *, list_transform(live, lambda e: {{'near': window_start - e.last <= 5400, 't': top <> 0 AND list_contains(e.anchors, top), 'r': len(list_intersect(e.anchors, convs)) > 0, 'c': len(list_intersect(e.convs, convs)) / len(list_distinct(list_concat(e.convs, convs))), 'k': {_share("e.kws", "kws")}, 'd': {_share("e.doms", "doms")}}}) AS ov
                FROM (SELECT s.*, list_filter(w.live, lambda e: s.window_start - e.last <= 21600) AS live, list_filter(w.live, lambda e: s.window_start - e.last > 21600) AS shut FROM walk w JOIN seq s ON s.channel = w.channel AND s.k = w.k + 1)))) ),
    evs AS (SELECT channel, e.*, (e.last - e.first) / 60 AS minutes FROM (SELECT channel, unnest(shut) AS e FROM walk UNION ALL SELECT channel, unnest(live) FROM walk w WHERE k = (SELECT max(k) FROM seq s WHERE s.channel = w.channel))),
    tracked AS (SELECT *, CASE WHEN n = 1 THEN 'isolated' WHEN minutes < 120 THEN 'flash' WHEN minutes < 240 THEN 'developing' ELSE 'sustained' END AS duration_kind FROM evs)"""

def _long(source: str) -> str:
    """sustained: SUSTAINED events of the anomalies in a table. Every row extends its own topics as far as they are carried on; a greedy walk then takes runs of four."""
    return f"""best AS (SELECT * FROM {source} QUALIFY row_number() OVER (PARTITION BY channel, window_end // 3600 ORDER BY z_score DESC, window_start, id) = 1),
        sets AS (SELECT id, list(l ORDER BY cluster_id) AS clusters FROM (SELECT id, cluster_id, list(word ORDER BY word) AS l FROM words GROUP BY ALL) GROUP BY id),
        r AS MATERIALIZED (SELECT b.channel, b.window_start, b.window_end, coalesce(clusters, []) AS clusters, row_number() OVER (PARTITION BY channel ORDER BY window_start, id) AS k FROM best b LEFT JOIN sets USING (id)),
        ext AS (SELECT channel, k AS head, k, window_start AS ws, clusters AS topics FROM r UNION ALL SELECT channel, head, k, ws, [found.un] FROM (SELECT e.channel, e.head, r.k, r.window_start AS ws, list_reverse_sort(flatten(list_transform(e.topics, lambda t, x: list_transform(list_filter(r.clusters, lambda c: len(list_intersect(t, c)) >= 2), lambda c: {{'share': len(list_intersect(t, c)) / least(len(t), len(c)), 'x': -x, 'y': -list_position(r.clusters, c), 'un': list_distinct(list_concat(t, c))}}))))[1] AS found
            FROM ext e JOIN r ON r.channel = e.channel AND r.k = e.k + 1 WHERE r.window_start - e.ws <= 7200) WHERE found.share >= 0.5),
        runs AS MATERIALIZED (SELECT channel, head, max(k) AS last, arg_max(topics, k) AS topics FROM ext GROUP BY ALL),
        walk AS (SELECT channel, 1::BIGINT AS at FROM (SELECT DISTINCT channel FROM r) UNION ALL SELECT w.channel, CASE WHEN last - head >= 3 THEN last + 1 ELSE head + 1 END FROM walk w JOIN runs ON runs.channel = w.channel AND head = w.at),
        ev AS (SELECT a.channel, a.window_start AS event_start, b.window_end AS event_end, array_to_string(list_sort(list_distinct(flatten(topics)))[1:8], ', ') AS keywords FROM walk w JOIN runs ON runs.channel = w.channel AND head = w.at AND last - head >= 3 JOIN r a ON a.channel = w.channel AND a.k = head JOIN r b ON b.channel = w.channel AND b.k = last),
        sustained AS (SELECT 'SUSTAINED' AS event_type, event_start, event_end, ev.channel AS channels, keywords, max(z_score) AS peak_z, count(*) AS anomaly_count FROM ev JOIN {source} h ON h.channel = ev.channel AND h.window_start >= event_start AND h.window_end <= event_end GROUP BY ALL)"""


def _shared(name: str, by: str, source: str) -> str:
    """name: by and the six words that most members share, or of any if none is shared."""
    return f"""{name} AS (SELECT {by}, string_agg(word, ', ' ORDER BY place) AS keywords FROM (SELECT *, row_number() OVER (PARTITION BY {by} ORDER BY members DESC, word) AS place FROM (SELECT *, max(members) OVER (PARTITION BY {by}) AS most FROM (SELECT {by}, word, count(DISTINCT id) AS members FROM {source} JOIN words USING (id) GROUP BY ALL)) WHERE most = 1 OR members > 1) WHERE place <= 6 GROUP BY ALL)"""


ORACLE_SQL = {
    "candidate_classify_score": f"""WITH {CANDIDATES} SELECT candidate_id, CASE WHEN uniq = 0 THEN 'unknown' WHEN pct >= 0.8 OR uniq <= 1 THEN 'viral_post' WHEN len(kws) < 2 THEN 'topic_surge' WHEN uniq >= 3 AND len(doms) >= 2 AND size >= 10 THEN 'event_candidate' ELSE 'topic_surge' END AS kind,
        round(0.25 * least(uniq / 5, 1) + 0.2 * (1 - pct) + 0.2 * least(len(doms) / 3, 1) + 0.15 * least(size / 100, 1) + 0.1 * least(size / 4 / 10, 1) + 0.1 * least(len(kws) / 5, 1), 4) AS event_score, size, uniq AS unique_conversation_count, pct AS top_conversation_pct, top AS top_story_id FROM cand""",
    "pairwise_merge_score": f"""WITH {CANDIDATES}, p AS (SELECT a.candidate_id AS a_id, b.candidate_id AS b_id, {_CONV} AS c, {_simp('kws')} AS k, {_simp('doms')} AS d, a.top <> 0 AND a.top = b.top AS t, a.top <> 0 AND list_contains(b.convs, a.top) AS r FROM cand a JOIN cand b ON a.channel = b.channel AND b.window_start = a.window_start + 43200)
        SELECT a_id, b_id, round(c, 6) AS conversation_overlap, round(k, 6) AS keyword_overlap, round(d, 6) AS domain_overlap, round(CASE WHEN k = 0 AND NOT t THEN 0.0 ELSE CASE WHEN t THEN 0.25 ELSE 0.0 END + (0.3::DOUBLE * c + 0.15::DOUBLE * k + 0.05::DOUBLE * d) + CASE WHEN r AND NOT t THEN 0.1 ELSE 0.0 END END, 9) AS merge_score,
               CASE WHEN t THEN 'top_conv_match' WHEN r THEN 'reverse_anchor_match' WHEN c >= 0.3 THEN 'conv_overlap' WHEN k > 0 AND d > 0 THEN 'kw+domain' ELSE 'keyword' END AS merge_reason FROM p""",
    "consolidate_events": f"WITH RECURSIVE {TRACKED} SELECT id AS event_id, channel AS primary_channel, first AS first_seen, last AS last_seen, CAST(n AS INT) AS candidate_count, items AS total_item_count, peak AS peak_score, round(avg, 4) AS avg_score, duration_kind, CAST(len(trace) AS INT) AS merges FROM tracked",
    "sustained_chains": f"WITH RECURSIVE {ANOMALIES}, {_long('hot')} SELECT * FROM sustained",
    "claim_union_sort": f"""WITH RECURSIVE {_edges(7200, 0.3)}, sym AS MATERIALIZED (SELECT a, b FROM edges UNION SELECT b, a FROM edges), reach AS (SELECT a AS id, a AS seen FROM sym UNION SELECT r.id, e.b FROM reach r JOIN sym e ON e.a = r.seen), comp AS MATERIALIZED (SELECT id, min(seen) AS component FROM reach GROUP BY id),
        o AS MATERIALIZED (SELECT component, hot.*, row_number() OVER (PARTITION BY component ORDER BY window_start, hot.id) AS k FROM comp JOIN hot USING (id)),
        span AS (SELECT component, k, id, window_start AS head, 0 AS part FROM o WHERE k = 1 UNION ALL SELECT o.component, o.k, o.id, CASE WHEN o.window_start - s.head > 14400 THEN o.window_start ELSE s.head END, CASE WHEN o.window_start - s.head > 14400 THEN s.part + 1 ELSE s.part END FROM span s JOIN o ON o.component = s.component AND o.k = s.k + 1),
        pt AS MATERIALIZED (SELECT component, part, o.* EXCLUDE (component, k) FROM span JOIN o USING (component, k, id)), fe AS (SELECT component, part, min(window_start) AS event_start, max(window_end) AS event_end, string_agg(DISTINCT channel, ',' ORDER BY channel) AS channels, max(z_score) AS peak_z, count(*) AS anomaly_count FROM pt GROUP BY ALL HAVING count(DISTINCT channel) > 1),
        {_shared('fk', 'component, part', 'pt')}, rest AS (SELECT * FROM hot WHERE id NOT IN (SELECT id FROM pt JOIN fe USING (component, part))), {_long('rest')},
        lone AS (SELECT * FROM rest WHERE NOT EXISTS (SELECT 1 FROM sustained s WHERE s.channels = rest.channel AND rest.window_start >= s.event_start AND rest.window_end <= s.event_end)), {_shared('ik', 'id', 'lone')}
        SELECT 'FLASH' AS event_type, event_start, event_end, channels, coalesce(keywords, '') AS keywords, peak_z, anomaly_count FROM fe LEFT JOIN fk USING (component, part) UNION ALL SELECT * FROM sustained UNION ALL SELECT 'ISOLATED', window_start, window_end, channel, coalesce(keywords, ''), z_score, 1 FROM lone LEFT JOIN ik USING (id)""",
    "duration_label_buckets": f"""WITH {SURGES}, m AS (SELECT updates + 1 AS c, (released_at - event_start) / 60 AS m FROM surges WHERE released_at IS NOT NULL)
        SELECT CASE WHEN c = 1 THEN 'isolated' WHEN m < 120 THEN 'flash' WHEN m < 240 THEN 'developing' ELSE 'sustained' END AS duration_kind, CASE WHEN m < 30 THEN '<30m' WHEN m < 120 THEN '30m-2h' WHEN m <= 360 THEN '2h-6h' ELSE '>6h' END AS bucket, count(*) AS n FROM m GROUP BY ALL""",
    "flash_edges": f"WITH {_edges(7200, 0.3)} SELECT a, b, round(overlap, 6) AS overlap FROM edges",
    "flash_components": f"WITH RECURSIVE {_edges(3600, 0.9)}, sym AS MATERIALIZED (SELECT a, b FROM edges UNION SELECT b, a FROM edges), reach AS (SELECT a AS id, a AS seen FROM sym UNION SELECT r.id, e.b FROM reach r JOIN sym e ON e.a = r.seen) SELECT id, min(seen) AS component FROM reach GROUP BY id",
    "hourly_representatives": f"""WITH {ITEMS}, c AS (SELECT channel, CAST(floor(sec / 1800.0) * 1800 AS BIGINT) AS window_start, count(*) AS n, min(id) AS id FROM items GROUP BY ALL), u AS (SELECT channel, sum(n) / count(*) AS mean FROM c GROUP BY channel),
        w AS (SELECT id, channel, window_start, window_start + 1800 AS window_end, round(n / mean, 6) AS z_score FROM c JOIN u USING (channel)) SELECT id, channel, window_end, z_score FROM w QUALIFY row_number() OVER (PARTITION BY channel, window_end // 3600 ORDER BY z_score DESC, window_start, id) = 1""",
    "cluster_table": f"WITH {CLUSTERS} SELECT id, cluster_id, size, noise_count, array_to_string(keywords, ',') AS keywords, top_story_id, title AS top_story_title, pct AS top_story_pct, uniq AS unique_story_count, array_to_string(ids, ',') AS story_ids, array_to_string(hosts, ',') AS top_domains FROM clus",
    "enriched_candidates": f"""WITH {CLUSTERS}, k AS (SELECT 'hacker_news:' || channel || ':' || window_end || ':' || cluster_id AS candidate_id, CASE WHEN uniq = 0 THEN 'unknown' WHEN pct >= 0.8 OR uniq <= 1 THEN 'viral_post' WHEN len(keywords) < 2 THEN 'topic_surge' WHEN uniq >= 3 AND len(hosts) >= 2 AND size >= 10 THEN 'event_candidate' ELSE 'topic_surge' END AS kind,
        round(0.25 * least(uniq / 5, 1) + 0.2 * (1 - pct) + 0.2 * least(len(hosts) / 3, 1) + 0.15 * least(size / 100, 1) + 0.1 * least(z_score / 10, 1) + 0.1 * least(len(keywords) / 5, 1), 4) AS event_score, size, uniq AS unique_conversation_count, pct AS top_conversation_pct, top_story_id, array_to_string(keywords, ',') AS keywords, w.n AS window_count
        FROM clus JOIN hot USING (id) JOIN (SELECT id, count(*) AS n FROM lab GROUP BY id) w USING (id)) SELECT * FROM k WHERE kind <> 'unknown'""",
    "stemmed_cluster_words": f"WITH {CLUSTERS} SELECT * FROM cw",
    "flash_on_stems": f"""WITH {CLUSTERS}, cz AS (SELECT id, cluster_id, count(*) AS size FROM cw GROUP BY ALL), pr AS (SELECT x.id AS a, y.id AS b, u.cluster_id AS ca, v.cluster_id AS cb, count(*) AS common FROM hot x JOIN hot y ON x.id < y.id AND x.channel <> y.channel AND abs(x.window_start - y.window_start) <= 3600 JOIN cw u ON u.id = x.id JOIN cw v ON v.id = y.id AND v.word = u.word GROUP BY ALL HAVING count(*) >= 2)
        SELECT a, b, round(max(common / least(s.size, t.size)), 6) AS overlap FROM pr JOIN cz s ON s.id = a AND s.cluster_id = ca JOIN cz t ON t.id = b AND t.cluster_id = cb GROUP BY a, b HAVING max(common / least(s.size, t.size)) >= 0.9""",
    "tag_snapshot": f"WITH {SNAPSHOT} SELECT tag, total, matched, unmatched, coalesce(channels, '') AS channels, coalesce(cohashtags, '') AS cohashtags, coalesce(domains, '') AS domains, coalesce(array_to_string(samples, '|'), '') AS samples, authors AS unique_authors_capped FROM snap",
    "tag_unmatched_report": f"""WITH {SNAPSHOT} SELECT tag AS hashtag, unmatched AS unmatched_count, total AS total_count, rate AS unmatched_rate, authors AS unique_authors_capped, coalesce(pa5, '') AS top_cohashtags, coalesce(dm5, '') AS top_domains, coalesce(samples[1], '') AS sample_text_1, coalesce(samples[2], '') AS sample_text_2, coalesce(samples[3], '') AS sample_text_3, coalesce(ch1, 'unknown') AS suggested_channel,
        CASE WHEN rate >= 0.8 AND total >= 50 THEN 'review_for_addition' WHEN rate >= 0.5 THEN 'monitor' ELSE 'ok' END AS suggested_action, CASE WHEN total >= 1000 AND authors >= 50 THEN 'high' WHEN total >= 100 THEN 'medium' ELSE 'low' END AS confidence FROM rated WHERE unmatched > 0 ORDER BY unmatched DESC, tag LIMIT 20""",
    "tag_routed_report": f"WITH {SNAPSHOT} SELECT tag AS hashtag, total AS total_count, matched AS matched_count, round(matched / total, 4) AS matched_rate, coalesce(ch1, '') AS top_channel, coalesce(ch5, '') AS channel_distribution, authors AS unique_authors_capped, coalesce(dm5, '') AS top_domains FROM snap WHERE matched > 0 ORDER BY matched DESC, tag LIMIT 20",
    "isolated_antijoin": f"WITH {_edges(3600, 0.9)} SELECT id, channel, z_score FROM hot WHERE id NOT IN (SELECT a FROM edges UNION SELECT b FROM edges)",
    "shared_keywords": f"""WITH {ANOMALIES}, s AS (SELECT channel, window_start // 86400 AS day, word, count(DISTINCT id) AS members FROM words JOIN hot USING (id) GROUP BY ALL), f AS (SELECT *, max(members) OVER (PARTITION BY channel, day) AS most FROM s),
        r AS (SELECT *, row_number() OVER (PARTITION BY channel, day ORDER BY members DESC, word) AS place FROM f WHERE most = 1 OR members > 1 QUALIFY place <= 6) SELECT channel, day, string_agg(word, ', ' ORDER BY place) AS keywords FROM r GROUP BY channel, day""",
    "interval_join_collect": f"WITH {SURGES} SELECT event_id AS window_id, count(*) AS n, count(DISTINCT story_id) AS texts FROM surges s JOIN items i ON i.channel = s.channel AND i.sec BETWEEN s.event_start AND s.last_seen GROUP BY 1",
    "tag_counts": f"WITH {POSTS} SELECT tag, count(*) AS total, count(*) FILTER (channel NOT IN ('view', 'error')) AS matched, count(*) FILTER (channel IN ('view', 'error')) AS unmatched FROM oc GROUP BY tag",
    "tag_promotion": f"WITH {POSTS} SELECT tag, id AS since_id, sec AS since_sec FROM nth WHERE k = 5 ORDER BY sec, id, pos, tag LIMIT 500",
    "tag_cooccurrence": f"""WITH {POSTS}, own AS (SELECT * FROM nth WHERE k >= 5), c AS (SELECT a.tag, b.tag AS partner, count(*) AS n, min((a.sec, a.id, a.pos, b.pos)) AS first FROM own a JOIN oc b ON a.id = b.id AND a.tag <> b.tag GROUP BY ALL)
        SELECT tag, partner, n FROM c QUALIFY row_number() OVER (PARTITION BY tag ORDER BY first) <= 20""",
    "tag_suggestions": f"""WITH {POSTS}, t AS (SELECT tag, count(*) AS total, count(*) FILTER (channel IN ('view', 'error')) AS unmatched, CAST(least(count(DISTINCT author) FILTER (k >= 5), 100) AS BIGINT) AS authors FROM nth GROUP BY tag), r AS (SELECT *, round(unmatched / total, 4) AS rate FROM t)
        SELECT tag, total, unmatched, rate AS unmatched_rate, authors AS unique_authors_capped, CASE WHEN rate >= 0.8 AND total >= 50 THEN 'review_for_addition' WHEN rate >= 0.5 THEN 'monitor' ELSE 'ok' END AS action, CASE WHEN total >= 1000 AND authors >= 50 THEN 'high' WHEN total >= 100 THEN 'medium' ELSE 'low' END AS confidence FROM r""",
    "set_measures": f"""WITH {CANDIDATES}, l AS (SELECT candidate_id, convs, lag(convs) OVER (PARTITION BY channel, cluster_id ORDER BY window_start) AS before FROM cand)
        SELECT candidate_id, round(len(list_intersect(convs, before)) / len(list_distinct(list_concat(convs, before))), 6) AS jaccard, round(len(list_intersect(convs, before)) / least(len(convs), len(before)), 6) AS simpson FROM l WHERE before IS NOT NULL""",
}
