"""Queries on tables unlike the driver's: evenly filled hours, full windows, cut references."""

from datetime import date, datetime, timedelta, timezone

import duckdb
import numpy as np
from test_queries import rows

from tidewatch.operators import clustering, projection
from tidewatch.plans import detection_queries, report_queries, text_queries
from tidewatch.sources import readers, sinks

EVENTS = "event_id long, ts timestamp, user_id long, event_type string, value double, props string"
START = datetime(2024, 1, 1, tzinfo=timezone.utc)


def stored(spark, tmp_path, **tables):
    """The tables as files of a folder, and DuckDB with a view of each."""
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for name, (given, schema) in tables.items():
        spark.createDataFrame(given, schema).coalesce(1).write.parquet(f"{tmp_path}/{name}.parquet")
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{tmp_path}/{name}.parquet/*.parquet'")
    return str(tmp_path), con


def hourly(counts):
    """So many clicks in every hour, of which the stories lean to the first."""
    at = [(h, k) for h, n in enumerate(counts) for k in range(n)]
    return [(i, START + timedelta(hours=h, seconds=3599 * k // max(counts)), i % 7, "click", 1.0, f'{{"k": {i * i % 11}}}') for i, (h, k) in enumerate(at)]


def test_an_archive_without_anomalies(spark, tmp_path):
    folder, con = stored(spark, tmp_path, events=(hourly([3] * 72), EVENTS))
    found = report_queries.parquet_partition_prune(spark, folder).toPandas()
    wanted = con.sql(report_queries.ORACLE_SQL["parquet_partition_prune"]).df()
    assert list(found.columns) == list(wanted.columns) and len(found) == len(wanted) == 0
    empty = spark.createDataFrame([], "candidate_id string, channel string, window_end long")
    sinks.write_archive(empty, f"{folder}/archive")
    assert readers.candidates_between(spark, f"{folder}/archive", date(2024, 1, 1), date(2024, 1, 2)).count() == 0


def test_flags_of_a_window_with_many_items(spark, tmp_path):
    folder, con = stored(spark, tmp_path, events=(hourly([2 + h % 3 for h in range(60)] + [1500, 2, 2, 2]), EVENTS))
    found = detection_queries.lifecycle_flags(spark, folder).toPandas()
    wanted = con.sql(detection_queries.ORACLE_SQL["lifecycle_flags"]).df()
    assert len(wanted) and rows(found) == rows(wanted)


def test_markup_with_cut_and_quoted_references(spark, tmp_path):
    pages = ["a &amp b", "<p>x&amp;y &amp", "&lt;i&gt; &lt", "&amp;lt;", "&copy 2024 &copy;", "&#39 &#39; &#x27;&#x27", "q?a=1&copy=2", "&nbsp;c&nbsp", "<!-- c -->&middot;<br>&mdash;", "", "&&amp;&", "AT&amp;amp;T"]
    folder, con = stored(spark, tmp_path, pages=([(i, "u", h) for i, h in enumerate(pages)], "page_id long, url string, html string"))
    found = text_queries.html_to_text(spark, folder).toPandas()
    assert rows(found) == rows(con.sql(text_queries.ORACLE_SQL["html_to_text"]).df())


def test_wide_eps_in_many_dimensions_makes_few_copies(spark):
    rng = np.random.default_rng(3)
    points = rng.normal(size=(600, 32))
    points /= np.linalg.norm(points, axis=1)[:, None]
    given = spark.createDataFrame([(0, i, v.tolist()) for i, v in enumerate(points)], "g int, k long, v array<double>")
    assert clustering.metric_cells(given, 1.2, 50).count() <= 600 * clustering.MOST_COPIES
    wanted = clustering.density_labels(points, 1.2, 4)
    got = {r["k"]: r["cluster_id"] for r in clustering.block_clusters(given, "g", "k", "v", 1.2, 4, 50).collect()}
    assert [got[i] for i in range(600)] == wanted.tolist()


def test_layout_of_a_large_group(spark):
    rng = np.random.default_rng(4)
    points = np.concatenate([rng.normal(c, 0.05, size=(200, 8)) for c in (0.0, 1.0, 2.0)])
    given = spark.createDataFrame([(0, i, v.tolist()) for i, v in enumerate(points)], "g int, k long, v array<double>")
    laid = {r["k"]: r["projected"] for r in projection.projected(given, ["g"], "k", "v", most=200).collect()}
    assert len(laid) == 600
    assert projection.trustworthiness(points, np.array([laid[i] for i in range(600)])) > 0.9
