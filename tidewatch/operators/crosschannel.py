"""Events across channels: short bursts shared by several, long runs in one, and the rest."""

from __future__ import annotations

from itertools import product

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidewatch.checkpoints import checkpointed
from tidewatch.functions.stem import stem, stemmed
from tidewatch.functions.vocabulary import CROSS_CHANNEL_STOPWORDS

#: Windows, overlaps and lengths.
FLASH_SECONDS, FLASH_OVERLAP, MOST_SPAN = 7200, 0.3, 14400
SUSTAINED_OVERLAP, SUSTAINED_HOURS, LEAST_COMMON = 0.5, 4, 2
EVENTS = "event_type string, event_start long, event_end long, channels string, keywords string, peak_z double, anomaly_count long, anomaly_ids array<long>"


def cluster_words(clusters: DataFrame) -> DataFrame:
    """id, cluster_id, word, distinct: stems of the keywords of clusters (id, cluster_id, keywords: an array, or text joined by commas), less stemmed stop words.

    Words are stemmed before stop words go; a cluster without any is left out.
    """
    kinds = dict(clusters.dtypes)
    words = F.col("keywords") if kinds["keywords"].startswith("array") else F.split("keywords", ", ")
    words = F.filter(F.transform(words, F.trim), lambda w: w != "")
    stop = F.array(*map(F.lit, sorted({stem(w) for w in CROSS_CHANNEL_STOPWORDS})))
    return clusters.select("id", "cluster_id", F.explode(F.array_except(stemmed(words), stop)).alias("word")).distinct()


def flash_edges(anomalies: DataFrame, words: DataFrame, seconds: int = FLASH_SECONDS, overlap: float = FLASH_OVERLAP) -> DataFrame:
    """a, b, overlap: anomalies of different channels within `seconds` whose closest clusters share enough words.

    anomalies: id, channel, window_start; words: id, cluster_id, word, distinct.
    Overlap is the common share of the smaller set, of pairs with two words or
    more in common. Pairs meet on (word, bucket of time), never on time alone.
    """
    placed = words.join(anomalies.select("id", "channel", "window_start"), "id").withColumn("bucket", F.floor(F.col("window_start") / seconds))
    sizes = words.groupBy("id", "cluster_id").agg(F.count("*").alias("size"))
    right = placed.select(F.col("id").alias("b"), F.col("cluster_id").alias("cb"), "word", F.col("channel").alias("channel_b"), F.col("window_start").alias("start_b"), F.explode(F.array(F.col("bucket") - 1, F.col("bucket"), F.col("bucket") + 1)).alias("bucket"))
    met = placed.withColumnsRenamed({"id": "a", "cluster_id": "ca"}).join(right, ["word", "bucket"])
    met = met.where((F.col("a") < F.col("b")) & (F.col("channel") != F.col("channel_b")) & (F.abs(F.col("window_start") - F.col("start_b")) <= seconds))
    common = met.groupBy("a", "b", "ca", "cb").agg(F.count("*").alias("common")).where(F.col("common") >= LEAST_COMMON)
    common = common.join(sizes.withColumnsRenamed({"id": "a", "cluster_id": "ca", "size": "size_a"}), ["a", "ca"]).join(sizes.withColumnsRenamed({"id": "b", "cluster_id": "cb", "size": "size_b"}), ["b", "cb"])
    best = common.groupBy("a", "b").agg(F.max(F.col("common") / F.least("size_a", "size_b")).alias("overlap"))
    return best.where(F.col("overlap") >= overlap)


def components(edges: DataFrame) -> DataFrame:
    """id, component (its least id) of all ids that edges (a, b) name: least labels spread, and follow the label's own label, until none changes."""
    both = checkpointed(edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    labels = checkpointed(both.select(F.col("a").alias("id")).distinct().withColumn("component", F.col("id")))
    while True:
        near = both.join(labels, both["b"] == labels["id"]).groupBy("a").agg(F.min("component").alias("least"))
        step = labels.join(near, labels["id"] == near["a"], "left").select("id", F.col("component").alias("was"), F.least("component", F.coalesce("least", "component")).alias("to"))
        ahead = step.select(F.col("id").alias("to"), F.col("to").alias("jump"))
        step = checkpointed(step.join(ahead, "to").select("id", F.least("to", "jump").alias("component"), (F.least("to", "jump") != F.col("was")).alias("moved")))
        labels = step.select("id", "component")
        if step.where("moved").isEmpty():
            return labels


def shared_keywords(sets: DataFrame, by: list[str], most: int = 6) -> DataFrame:
    """by, keywords: words of several members, by how many hold them, or if there are none of any; ties by spelling.

    sets: by, member, word.
    """
    counts = sets.groupBy(*by, "word").agg(F.countDistinct("member").alias("members"))
    any_shared = F.max("members").over(Window.partitionBy(*by)) > 1
    fit = counts.withColumn("fit", ~any_shared | (F.col("members") > 1)).where("fit")
    place = F.row_number().over(Window.partitionBy(*by).orderBy(F.desc("members"), "word"))
    top = fit.withColumn("place", place).where(F.col("place") <= most)
    return top.groupBy(*by).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("place", "word"))), lambda x: x["word"]), ", ").alias("keywords"))


def split_spans(members: DataFrame, most: int = MOST_SPAN) -> DataFrame:
    """members (id, component, window_start) with part: within a component a new part begins where the span from the part's first would pass `most`."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["window_start", "id"])
        part, head, parts = -1, None, []
        for at in pdf.window_start.tolist():
            if head is None or at - head > most:
                part, head = part + 1, at
            parts.append(part)
        return pdf.assign(part=parts)

    return members.select("id", "component", "window_start").groupBy("component").applyInPandas(run, "id long, component long, window_start long, part long")


def flash_events(anomalies: DataFrame, words: DataFrame) -> DataFrame:
    """FLASH events: parts of components of flash_edges with two channels or more. anomalies also has window_end and z_score."""
    labels = components(flash_edges(anomalies, words))
    parts = split_spans(labels.join(anomalies.select("id", "window_start"), "id"))
    met = parts.drop("window_start").join(anomalies, "id")
    events = met.groupBy("component", "part").agg(
        F.min("window_start").alias("event_start"), F.max("window_end").alias("event_end"), F.array_join(F.array_sort(F.collect_set("channel")), ",").alias("channels"), F.countDistinct("channel").alias("n"), F.max("z_score").alias("peak_z"), F.count("*").alias("anomaly_count"), F.array_sort(F.collect_list("id")).alias("anomaly_ids"),
    ).where("n > 1")
    sets = parts.join(words.select("id", "word").distinct(), "id").select("component", "part", F.col("id").alias("member"), "word")
    met = events.join(shared_keywords(sets, ["component", "part"]), ["component", "part"], "left")
    return met.select(F.lit("FLASH").alias("event_type"), "event_start", "event_end", "channels", F.coalesce("keywords", F.lit("")).alias("keywords"), "peak_z", "anomaly_count", "anomaly_ids")


def closest(tracks: list[set], clusters: list[set]) -> tuple[float, int, int] | None:
    """(overlap, track, cluster) of the pair that shares most of its smaller set, with LEAST_COMMON words or more; the first of equals."""
    pairs = [(len(a & b) / min(len(a), len(b)), -i, -j) for (i, a), (j, b) in product(enumerate(tracks), enumerate(clusters)) if len(a & b) >= LEAST_COMMON]
    return (lambda s, i, j: (s, -i, -j))(*max(pairs)) if pairs else None


def carried(run: list[list[set]], overlap: float) -> tuple[int, set]:
    """How many rows of a run carry a topic of its first row on, and the topic's words.

    The second row's closest cluster settles which of the first's is the topic;
    what matches it later adds its words.
    """
    topics = run[0]
    for n, clusters in enumerate(run[1:], 1):
        found = closest(topics, clusters)
        if found is None or found[0] < overlap:
            return n, set().union(*topics)
        topics = [topics[found[1]] | clusters[found[2]]]
    return len(run), set().union(*topics)


def long_topics(rows: list[tuple[int, list[set]]], joined, overlap: float = SUSTAINED_OVERLAP, hours: int = SUSTAINED_HOURS) -> list[tuple[int, int, set]]:
    """(first, last, words) of topics that `hours` or more consecutive rows (second, clusters) carry on.

    Rows part into runs where joined(seconds between neighbours) fails; in a run,
    a topic is sought from each row that none before has taken.
    """
    breaks = [i for i in range(1, len(rows)) if not joined(rows[i][0] - rows[i - 1][0])]
    out = []
    for at, end in zip([0, *breaks], [*breaks, len(rows)], strict=True):
        while at < end:
            n, words = carried([c for _, c in rows[at:end]], overlap)
            if n >= hours:
                out.append((at, at + n - 1, words))
            at += n if n >= hours else 1
    return out


def hourly_best(anomalies: DataFrame) -> DataFrame:
    """The anomaly of highest z per channel and clock hour of window_end, the first of equals."""
    order = Window.partitionBy("channel", F.floor(F.col("window_end") / 3600)).orderBy(F.desc("z_score"), "window_start", "id")
    return anomalies.withColumn("_place", F.row_number().over(order)).where("_place = 1").drop("_place")


def sustained_events(anomalies: DataFrame, words: DataFrame, hourly: bool = False, fine: DataFrame | None = None) -> DataFrame:
    """SUSTAINED events of single channels.

    With hourly, rows are exactly an hour apart. Otherwise the hour's best rows
    stand at most two hours apart, and an event claims every row of `fine` (by
    default all anomalies) inside it.
    """
    rows = anomalies if hourly else hourly_best(anomalies)
    sets = words.groupBy("id", "cluster_id").agg(F.collect_set("word").alias("set")).groupBy("id").agg(F.array_sort(F.collect_list(F.struct("cluster_id", "set"))).alias("sets"))
    met = rows.join(sets, "id", "left").select("id", "channel", "window_start", "window_end", "z_score", "sets")

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["window_start", "id"])
        own = [(r.window_start, [set(c["set"]) for c in (r.sets if r.sets is not None else [])]) for r in pdf.itertuples()]
        out = []
        for a, b, topic in long_topics(own, (lambda gap: gap == 3600) if hourly else (lambda gap: gap <= 7200)):
            part = pdf.iloc[a : b + 1]
            out.append((pdf.channel.iloc[0], part.window_start.iloc[0], part.window_end.iloc[-1], ", ".join(sorted(topic)[:8]), part.z_score.max(), part.id.tolist()))
        return pd.DataFrame(out, columns=["channel", "event_start", "event_end", "keywords", "peak_z", "anomaly_ids"])

    found = met.groupBy("channel").applyInPandas(run, "channel string, event_start long, event_end long, keywords string, peak_z double, anomaly_ids array<long>")
    if not hourly:
        inner = (fine if fine is not None else anomalies).select("id", F.col("channel").alias("c"), F.col("window_start").alias("s"), F.col("window_end").alias("e"), F.col("z_score").alias("z"))
        met = found.drop("peak_z", "anomaly_ids").join(inner, (F.col("channel") == F.col("c")) & (F.col("s") >= F.col("event_start")) & (F.col("e") <= F.col("event_end")))
        found = met.groupBy("channel", "event_start", "event_end", "keywords").agg(F.max("z").alias("peak_z"), F.array_sort(F.collect_list("id")).alias("anomaly_ids"))
    return found.select(F.lit("SUSTAINED").alias("event_type"), "event_start", "event_end", F.col("channel").alias("channels"), "keywords", "peak_z", F.size("anomaly_ids").cast("long").alias("anomaly_count"), "anomaly_ids")


def claimed(events: DataFrame) -> DataFrame:
    return events.select(F.explode("anomaly_ids").alias("id")).distinct()


def aggregate_events(anomalies: DataFrame, words: DataFrame, hourly: bool = False) -> DataFrame:
    """All events: FLASH first, then SUSTAINED among what those leave, ISOLATED for the rest; in order of their start."""
    flash = checkpointed(flash_events(anomalies, words))
    left = anomalies.join(claimed(flash), "id", "left_anti")
    long = checkpointed(sustained_events(left, words, hourly))
    rest = left.join(claimed(long), "id", "left_anti")
    sets = rest.join(words.select("id", "word").distinct(), "id").select("id", F.col("id").alias("member"), "word")
    alone = rest.join(shared_keywords(sets, ["id"]), "id", "left").select(F.lit("ISOLATED").alias("event_type"), F.col("window_start").alias("event_start"), F.col("window_end").alias("event_end"), F.col("channel").alias("channels"), F.coalesce("keywords", F.lit("")).alias("keywords"), F.col("z_score").alias("peak_z"), F.lit(1).cast("long").alias("anomaly_count"), F.array("id").alias("anomaly_ids"))
    return flash.unionByName(long).unionByName(alone).orderBy("event_start", "event_type", "channels")
