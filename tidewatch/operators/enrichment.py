"""Anomalies with their clusters: labelled samples become clusters with keywords and stories, and those become candidates."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewatch.functions.text import tokens, utc
from tidewatch.operators.clustering import TOP_KEYWORDS, attribute, class_tfidf

#: Fixed value: texts that a window needs to be clustered.
LEAST_TEXTS = 50


def cluster_rows(labelled: DataFrame, by: list[str], top: int = TOP_KEYWORDS, usual: DataFrame | None = None) -> DataFrame:
    """by, cluster_id, size, noise_count, keywords, and the stories and domains that attribute finds; a row per cluster.

    labelled: by, pos, cluster_id (-1 for noise), text, story_id, story_title, domain.
    """
    group = [*by, "cluster_id"]
    words = labelled.where("cluster_id >= 0").select(*group, "pos", F.posexplode(tokens(F.col("text"))).alias("at", "token"))
    scored = class_tfidf(words.withColumn("first", F.struct("pos", "at")).drop("pos", "at"), by, top, usual)
    keywords = scored.groupBy(*group).agg(F.transform(F.array_sort(F.collect_list(F.struct("place", "token"))), lambda x: x["token"]).alias("keywords"))
    noise = labelled.groupBy(*by).agg(F.count_if(F.col("cluster_id") < 0).alias("noise_count"))
    stories = attribute(labelled.where("cluster_id >= 0"), group)
    met = stories.join(keywords, group, "left").join(noise, by)
    return met.withColumn("keywords", F.coalesce("keywords", F.array().cast("array<string>")))


def with_clusters(anomalies: DataFrame, rows: DataFrame, by: list[str]) -> DataFrame:
    """anomalies with clusters, the largest first; anomalies without any have an empty list. rows: as cluster_rows gives them."""
    names = ["cluster_id", "size", "noise_count", "keywords", "top_story_id", "top_story_title", "top_story_pct", "unique_story_count", "story_ids", "top_domains"]
    packed = F.array_sort(F.collect_list(F.struct((-F.col("size")).alias("less"), F.col("cluster_id").alias("id"), F.struct(*names).alias("c"))))
    listed = rows.groupBy(*by).agg(F.transform(packed, lambda x: x["c"]).alias("clusters"))
    kind = dict(listed.dtypes)["clusters"]
    return anomalies.drop("clusters").join(listed, by, "left").withColumn("clusters", F.coalesce("clusters", F.array().cast(kind)))


def clusterable(samples: DataFrame, by: list[str], least: int = LEAST_TEXTS) -> DataFrame:
    """Samples of the windows that have enough of them."""
    enough = samples.groupBy(*by).agg(F.count("*").alias("_n")).where(F.col("_n") >= least).drop("_n")
    return samples.join(enough, by, "left_semi")


def anomaly_tables(anomalies: DataFrame, rows: DataFrame, texts: DataFrame) -> dict[str, DataFrame]:
    """The tables that an archive keeps: anomalies, clusters and texts.

    anomalies: id, channel, window_start, window_end, count, mean, std, z_score;
    rows: id and cluster_rows' columns; texts: id, text.
    """
    sampled = texts.groupBy("id").agg(F.count("*").alias("texts_sampled"))
    kept = anomalies.join(sampled, "id", "left").select(
        "id", "channel", "window_start", "window_end", utc(F.col("window_start"), "yyyy-MM-dd HH:mm 'UTC'").alias("window_date"), "count", "mean", "std", "z_score", F.coalesce("texts_sampled", F.lit(0)).alias("texts_sampled"),
    )
    clusters = rows.select(F.col("id").alias("anomaly_id"), "cluster_id", "size", "noise_count", F.array_join("keywords", ", ").alias("keywords"))
    return {"anomalies": kept, "clusters": clusters, "anomaly_texts": texts.select(F.col("id").alias("anomaly_id"), "text")}
