"""Queries of the stateful streams, the scan with quarantine, and what was without one."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewatch.checkpoints import checkpointed
from tidewatch.operators import clustering as K
from tidewatch.operators import crosschannel as X
from tidewatch.operators import detection as D
from tidewatch.operators import embedding as V
from tidewatch.operators import enrichment as E
from tidewatch.operators import hashtags as H
from tidewatch.operators import lifecycle as L
from tidewatch.operators import projection as R
from tidewatch.plans import detection_queries, event_queries, report_queries
from tidewatch.plans import reports as P
from tidewatch.plans.detection_queries import _items, _scored
from tidewatch.plans.event_queries import _anomalies, _candidates, _posts, _tracked
from tidewatch.plans.report_queries import _folder, _messages, _post_columns, _table
from tidewatch.sources import manifest, readers, tables
from tidewatch.streaming import jobs, tracking


def _stream(rows: DataFrame, parts: list, folder: str) -> DataFrame:
    """rows as a stream of Parquet files that hold one part each, in order: parts are conditions."""
    spark = rows.sparkSession
    for i, part in enumerate(parts):
        rows.where(part).coalesce(1).write.parquet(f"{folder}/p{i}")
    return spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(f"{folder}/*")


def _thirds(rows: DataFrame, column: str) -> list:
    low, high = rows.agg(F.coalesce(F.min(column), F.lit(0)), F.coalesce(F.max(column), F.lit(0))).first()
    a, b = low + (high - low) // 3, low + 2 * (high - low) // 3
    return [F.col(column) <= a, (F.col(column) > a) & (F.col(column) <= b), F.col(column) > b]


def stream_lifecycle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lifecycle records of detector events that come in three micro-batches, each of them replayed."""
    path = _folder(spark)
    events = checkpointed(L.detect(_items(spark, sf_dir)))
    sink = jobs.LifecycleSink(f"{path}/out")

    def twice(rows: DataFrame, batch: int) -> None:
        sink(rows, batch)
        sink(rows, batch)

    stream = _stream(events, _thirds(events, "tick"), f"{path}/in")
    stream.writeStream.foreachBatch(twice).option("checkpointLocation", f"{path}/state").trigger(availableNow=True).start().awaitTermination()
    return sink.lifecycles(spark)


def stream_consolidate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tracked events of a stream of candidates; a candidate without an id, far in the future, closes those that are open."""
    path = _folder(spark)
    found = _candidates(spark, sf_dir).withColumn("kind", F.when(F.col("size") >= 10, "event_candidate").otherwise(F.col("kind")))
    found = checkpointed(found.withColumn("window_start", F.col("window_start").cast("long")))
    end = found.limit(1).withColumns({"candidate_id": F.lit(None).cast("string"), "kind": F.lit("event_candidate"), "window_start": F.lit(4_000_000_000).cast("long")})
    parts = [part & F.col("candidate_id").isNotNull() for part in _thirds(found, "window_start")]
    events = tracking.track_events(_stream(found.unionByName(end), [*parts, F.col("candidate_id").isNull()], f"{path}/in"))
    with tracking.rocksdb(spark):
        jobs.run_available(events, f"{path}/out", f"{path}/state")
    done = spark.read.schema(events.schema).parquet(f"{path}/out")
    return done.select("event_id", "primary_channel", "first_seen", "last_seen", "candidate_count", "total_item_count", "peak_score", F.round("avg_score", 4).alias("avg_score"), "duration_kind", F.size("merge_trace").alias("merges"))


def stream_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Starts of the plain trigger, in three micro-batches, that pass the gate."""
    path = _folder(spark)
    starts = checkpointed(D.trigger(_scored(spark, sf_dir)).where("event_type = 'start'").select("channel", "tick", "event_type"))
    passed = tracking.gate(_stream(starts, _thirds(starts, "tick"), f"{path}/in"), cooldown=6 * 3600)
    with tracking.rocksdb(spark):
        jobs.run_available(passed, f"{path}/out", f"{path}/state")
    return spark.read.schema(starts.schema).parquet(f"{path}/out").select("channel", "tick")


def stream_posts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Firehose messages that arrive as files, parsed by a stream."""
    path = _folder(spark)
    _messages(spark, sf_dir).write.text(f"{path}/in")
    jobs.run_available(readers.message_stream(spark, f"{path}/in"), f"{path}/out", f"{path}/state")
    return _post_columns(spark.read.parquet(f"{path}/out"))


def quarantine_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders in files by status, one of them with a broken file beside: two scans of the folder, and what each read."""
    path = _folder(spark)
    orders = _table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus", "o_totalprice")
    orders.withColumn("of", F.col("o_orderstatus")).repartition("of").write.partitionBy("of").parquet(f"{path}/in")
    orders.select(F.lit("no Parquet").alias("value")).limit(1).write.text(f"{path}/in/of=X")
    runs = []
    for run in ("first", "second"):
        read = []

        def use(rows: DataFrame, name: str, read: list = read) -> None:
            rows.groupBy("o_orderstatus").agg(F.count("*").alias("n"), F.round(F.sum("o_totalprice"), 2).alias("price")).write.parquet(f"{path}/out/{name}")
            read.append(spark.read.parquet(f"{path}/out/{name}"))

        files = manifest.scan_new(spark, f"{path}/in", f"{path}/manifest", use, run=run)
        runs += [rows.select(F.lit(run).alias("run"), F.lit("rows").alias("what"), F.col("o_orderstatus").alias("name"), "n", "price") for rows in read]
        runs.append(files.groupBy("status").agg(F.count("*").alias("n")).select(F.lit(run).alias("run"), F.lit("files").alias("what"), F.col("status").alias("name"), "n", F.lit(None).cast("double").alias("price")))
    known = manifest.manifest(spark, f"{path}/manifest").groupBy("status").agg(F.count("*").alias("n"))
    runs.append(known.select(F.lit("after").alias("run"), F.lit("files").alias("what"), F.col("status").alias("name"), "n", F.lit(None).cast("double").alias("price")))
    out = runs[0]
    for rows in runs[1:]:
        out = out.unionByName(rows)
    return out


def sustained_hourly(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Long topics whose anomalies are exactly an hour apart."""
    return X.sustained_events(*_anomalies(spark, sf_dir), hourly=True).drop("anomaly_ids")


def selected_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tracked events of two channels, of a least score and a kind of duration."""
    found = P.select_events(_tracked(spark, sf_dir), channels=["click", "view"], sources=["hn"], least_score=0.5, duration="sustained")
    return found.select("event_id", "primary_channel", "peak_score", "duration_kind")


def audit_timeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Merges of every event in their order, candidates of small clusters unresolved."""
    known = _candidates(spark, sf_dir).where(F.col("size") >= 12)
    return P.audit_timeline(_tracked(spark, sf_dir), known).select("event_id", "position", "candidate_id", "merge_score", "merge_reason", F.coalesce("kind", F.lit("")).alias("kind"), "resolved")


def bounded_tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tags of a counter that holds the first thirty, and one row for all that it refused."""
    kept, over = H.bounded(H.occurrences(_posts(spark, sf_dir)), 30)
    counts = kept.groupBy("tag").agg(F.count("*").alias("n"))
    return counts.unionByName(over.select(F.lit("(overflow)").alias("tag"), F.col("overflow_count").alias("n")))


def clusterable_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Windows of half a day that hold enough items to be clustered."""
    items = _items(spark, sf_dir).withColumn("window_start", (F.floor(F.col("sec") / 43200) * 43200).cast("long"))
    return E.clusterable(items, ["channel", "window_start"], 12).groupBy("channel", "window_start").agg(F.count("*").alias("n"))


def recurring_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Recurring threads of a range of time: candidates whose words hold one, by number."""
    found = _candidates(spark, sf_dir).withColumn("kind", F.when(F.col("size") % 3 == 0, "recurring_thread").otherwise(F.col("kind")))
    return P.recurring_between(found, 1704300000, 1704700000)


def heavy_tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tags by counters that hold them all, so that both bounds are the count."""
    return H.heavy_tags(H.occurrences(_posts(spark, sf_dir)), 1000)


def table_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as a table that is updated, gets changed and new rows, a new column, and loses some."""
    path = _folder(spark)
    orders = _table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus", F.col("o_totalprice").cast("double").alias("o_totalprice"))
    tables.create(orders, path)
    tables.change(spark, path, lambda rows: tables.updated(rows, F.col("o_orderkey") % 5 == 0, o_orderstatus=F.lit("U"), o_totalprice=F.lit(0.0)))
    more = orders.where(F.col("o_orderkey") % 7 == 0)
    news = more.withColumn("o_orderstatus", F.lit("N")).unionByName(more.select((-F.col("o_orderkey")).alias("o_orderkey"), F.lit("A").alias("o_orderstatus"), "o_totalprice")).where("o_orderkey <> 0")
    tables.change(spark, path, lambda rows: tables.upserted(rows, news.withColumn("note", F.lit("new")), "o_orderkey"))
    return tables.change(spark, path, lambda rows: tables.deleted(rows, F.col("o_orderkey") % 3 == 0)).withColumn("note", F.coalesce("note", F.lit("")))


def tumbling_late(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tumbling scores of items that arrive up to two hours late and out of order: each counts in the window open at its arrival."""
    arrived = _items(spark, sf_dir).withColumn("arrived", F.col("sec") + F.col("id") * 7919 % 7200)
    found = D.tumbling_arrivals(D.in_order(arrived, "arrived", "id"))
    return found.where("z IS NOT NULL").select("channel", "window_start", "n", F.round("mean", 6).alias("mean"), F.round("std", 6).alias("std"), F.round("z", 6).alias("z"), "fires")


def projected_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Density clusters of each label's vectors in the layout of their neighbour graph."""
    points = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    return K.cluster(checkpointed(R.projected(points, ["label"], "vec_id", "embedding")), "label", "vec_id", "projected", 0.5, 5)


def learned_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Density clusters of documents per language, by vectors learned from the documents' own words."""
    docs = _table(spark, sf_dir, "documents").select("doc_id", "lang", "text")
    vectors = V.word_vectors(docs, "doc_id", F.col("text"), 32)
    placed = checkpointed(V.text_vectors(docs, "doc_id", F.col("text"), vectors, 32, keep=["lang"]))
    return K.cluster(placed, "lang", "doc_id", "embedding", 0.35, 5)


QUERIES = {f.__name__: f for f in (stream_lifecycle, stream_consolidate, stream_gate, stream_posts, quarantine_scan, sustained_hourly, selected_events, audit_timeline, bounded_tags, clusterable_windows, recurring_range, heavy_tags, table_changes, tumbling_late, projected_clusters, learned_clusters)}

_OLD = detection_queries.ORACLE_SQL | event_queries.ORACLE_SQL | report_queries.ORACLE_SQL
_TRACKED, _ITEMS, _CANDIDATES = event_queries.TRACKED, detection_queries.ITEMS, event_queries.CANDIDATES

_HOURLY = event_queries._long("hot").replace("QUALIFY row_number() OVER (PARTITION BY channel, window_end // 3600 ORDER BY z_score DESC, window_start, id) = 1", "").replace("<= 7200", "= 3600")

ORACLE_SQL = {
    # streams give the rows of the batch operators
    "stream_lifecycle": _OLD["schmitt_freeze_lifecycle"],
    "stream_consolidate": _OLD["consolidate_events"],
    "stream_gate": _OLD["alert_gate_cooldown"],
    "stream_posts": _OLD["firehose_posts"],
    "quarantine_scan": """WITH o AS (SELECT o_orderstatus AS name, count(*) AS n, round(sum(o_totalprice), 2) AS price FROM orders GROUP BY 1)
        SELECT 'first' AS run, 'rows' AS what, name, n, price FROM o UNION ALL SELECT 'first', 'files', 'read', (SELECT count(*) FROM o), NULL UNION ALL SELECT 'first', 'files', 'corrupt', 1, NULL
        UNION ALL SELECT 'after', 'files', 'read', (SELECT count(*) FROM o), NULL UNION ALL SELECT 'after', 'files', 'corrupt', 1, NULL""",
    # windows are hours, so a run's rows are all that lie within it
    "sustained_hourly": f"WITH RECURSIVE {event_queries.ANOMALIES}, {_HOURLY} SELECT * FROM sustained",
    "selected_events": f"WITH RECURSIVE {_TRACKED} SELECT id AS event_id, channel AS primary_channel, peak AS peak_score, duration_kind FROM tracked WHERE channel IN ('click', 'view') AND peak >= 0.5 AND duration_kind = 'sustained'",
    "audit_timeline": f"WITH RECURSIVE {_TRACKED}, tr AS (SELECT id AS event_id, unnest(trace) AS t, CAST(generate_subscripts(trace, 1) AS INT) AS position FROM tracked) SELECT event_id, position, t.id AS candidate_id, t.score AS merge_score, t.reason AS merge_reason, CASE WHEN size >= 12 THEN {report_queries._KIND} ELSE '' END AS kind, size >= 12 AS resolved FROM tr JOIN cand ON candidate_id = t.id",
    "bounded_tags": f"WITH {event_queries.POSTS}, f AS (SELECT tag, min((sec, id, pos)) AS first, count(*) AS n FROM oc GROUP BY tag), r AS (SELECT *, row_number() OVER (ORDER BY first, tag) AS k FROM f) SELECT tag, n FROM r WHERE k <= 30 UNION ALL SELECT '(overflow)', CAST(coalesce(sum(n), 0) AS BIGINT) FROM r WHERE k > 30",
    "clusterable_windows": f"WITH {_ITEMS} SELECT channel, CAST(floor(sec / 43200.0) * 43200 AS BIGINT) AS window_start, count(*) AS n FROM items GROUP BY ALL HAVING count(*) >= 12",
    "recurring_range": f"WITH {_CANDIDATES} SELECT count(*) AS recurring_thread_count FROM cand WHERE size % 3 = 0 AND window_start + 43200 BETWEEN 1704300000 AND 1704700000",
    "heavy_tags": f"WITH {event_queries.POSTS} SELECT tag, count(*) AS at_least, count(*) AS at_most FROM oc GROUP BY tag",
    "table_changes": """WITH a AS (SELECT o_orderkey, CASE WHEN o_orderkey % 5 = 0 THEN 'U' ELSE o_orderstatus END AS o_orderstatus, CASE WHEN o_orderkey % 5 = 0 THEN 0.0 ELSE o_totalprice END::DOUBLE AS o_totalprice FROM orders),
        b AS (SELECT *, '' AS note FROM a WHERE o_orderkey % 7 <> 0 OR o_orderkey = 0 UNION ALL SELECT o_orderkey, 'N', o_totalprice::DOUBLE, 'new' FROM orders WHERE o_orderkey % 7 = 0 AND o_orderkey <> 0 UNION ALL SELECT -o_orderkey, 'A', o_totalprice::DOUBLE, 'new' FROM orders WHERE o_orderkey % 7 = 0 AND o_orderkey <> 0)
        SELECT * FROM b WHERE o_orderkey % 3 <> 0""",
    "tumbling_late": f"""WITH {_ITEMS}, a AS (SELECT channel, max(sec) OVER (ORDER BY sec + id * 7919 % 7200, id ROWS UNBOUNDED PRECEDING) AS clock FROM items),
        own AS (SELECT channel, CAST(floor(clock / 3600.0) * 3600 AS BIGINT) AS window_start, count(*) AS n FROM a GROUP BY ALL),
        h AS (SELECT *, count(*) OVER w AS h, sum(n) OVER w AS total, sum(n * n) OVER w AS squares FROM own WINDOW w AS (PARTITION BY channel ORDER BY window_start ROWS BETWEEN 24 PRECEDING AND 1 PRECEDING)),
        s AS (SELECT *, total / h AS mean, sqrt(CAST(h * squares - total * total AS DOUBLE)) / h AS std FROM h WHERE h >= 2)
        SELECT channel, window_start, n, round(mean, 6) AS mean, round(std, 6) AS std, round((n - mean) / std, 6) AS z, (n - mean) / std >= 3.0 AS fires FROM s WHERE std > 0""",
}
