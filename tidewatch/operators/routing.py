"""Topic routing: weighted keywords, layers, domain boosts, gates and a winner.

An item's text is walked once by an automaton of all keywords, however many
phrases and prefix roots the table has. What matched is looked up in the keyword table, and
(item, channel, score) rows sum to scores. Tables are broadcast up to a checked
size.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewatch.checkpoints import checkpointed
from tidewatch.functions.automaton import keywords_in
from tidewatch.functions.text import camel_split
from tidewatch.functions.vocabulary import CONTEXT_GATES, GATED_WEIGHT, HASHTAG_ALIASES, HASHTAG_WEIGHT, LEAST_SCORES, POST_BOOSTS, POST_PRIORITY, POST_ROOTS, STORY_BOOSTS, STORY_KEYWORDS, STORY_PRIORITY, STORY_ROOTS

BROADCAST_ROWS = 100_000
KEYWORDS = "channel string, keyword string, weight double"
BOOSTS = "domain string, channel string, boost double"


@dataclass
class Table:
    """What a router knows: (channel, keyword, weight), (domain, channel, boost), ties, floors, gates and prefix roots.

    gates: per channel its weak keywords and strong terms. runners: channels in
    the order that decides ties for the second place, by default the priority;
    a channel that a boost alone brought comes last there.
    """

    keywords: list[tuple[str, str, float]]
    boosts: list[tuple[str, str, float]]
    priority: list[str]
    floors: dict[str, float] = field(default_factory=dict)
    gates: dict[str, tuple[list[str], list[str]]] = field(default_factory=dict)
    prefixes: set[str] = field(default_factory=set)
    runners: list[str] | None = None


def story_table() -> Table:
    """The table for story titles."""
    return Table(STORY_KEYWORDS, STORY_BOOSTS, STORY_PRIORITY, prefixes=STORY_ROOTS, runners=list(dict.fromkeys(c for c, _, _ in STORY_KEYWORDS)))


def post_table(keywords: list[tuple[str, str, float]], boosts: list[tuple[str, str, float]] | None = None) -> Table:
    """The table for posts; its large keyword list comes from the caller, e.g. by stored_keywords."""
    return Table(keywords, POST_BOOSTS if boosts is None else boosts, POST_PRIORITY, LEAST_SCORES, CONTEXT_GATES, POST_ROOTS)


def stored_keywords(spark: SparkSession, path: str, most: int = BROADCAST_ROWS) -> list[tuple[str, str, float]]:
    """(channel, keyword, weight) rows of a CSV file with that header, in the file's order; more than `most` are an error."""
    rows = spark.read.csv(path, schema=KEYWORDS, header=True).coalesce(1).limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"more than {most} keywords in {path}")
    return [(r["channel"], r["keyword"].lower(), r["weight"]) for r in rows]


def _known(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    df = spark.createDataFrame(rows, schema)
    return F.broadcast(df) if len(rows) <= BROADCAST_ROWS else df


def matches(items: DataFrame, key: str, layers: dict[str, tuple[Column, float]], table: Table) -> DataFrame:
    """key, layer, channel, keyword, at, score: one row for every keyword that a layer's text holds.

    layers: name to (text, multiplier). key is unique. at orders rows by layer
    and then by the table.
    """
    rows = items.select(key, F.explode(F.array(*[F.struct(F.lit(i).alias("no"), F.lit(n).alias("layer"), F.coalesce(t, F.lit("")).alias("text"), F.lit(m).alias("times")) for i, (n, (t, m)) in enumerate(layers.items())])).alias("l")).select(key, "l.*").where("text <> ''")
    hits = rows.select(key, "no", "layer", "times", F.explode(keywords_in(F.col("text"), [k for _, k, _ in table.keywords], table.prefixes)).alias("keyword"))
    placed = [(*row, at) for at, row in enumerate(table.keywords)]
    known = _known(items.sparkSession, placed, f"{KEYWORDS}, place long")
    return hits.join(known, "keyword").select(key, "layer", "channel", "keyword", (F.col("no") * len(placed) + F.col("place")).alias("at"), (F.col("weight") * F.col("times")).alias("score"))


def boosts(items: DataFrame, key: str, host: Column, table: Table) -> DataFrame:
    """key, layer, channel, keyword, at, score for items whose domain has a boost."""
    known = _known(items.sparkSession, table.boosts, "_host string, channel string, score double")
    return items.select(key, host.alias("_host")).join(known, "_host").select(key, F.lit("domain").alias("layer"), "channel", F.lit(None).cast("string").alias("keyword"), F.lit(None).cast("long").alias("at"), "score")


def hashtag_text(tags: Column) -> Column:
    """Tags as words: an alias's where there is one, else split at capitals."""
    alias = F.create_map(*[F.lit(x) for pair in HASHTAG_ALIASES.items() for x in pair])
    return F.array_join(F.transform(tags, lambda t: F.coalesce(F.element_at(alias, F.lower(t)), camel_split(t))), " ")


def scores(found: DataFrame, key: str) -> DataFrame:
    """key, channel, score, keywords, body_score, embed_score of rows as matches and boosts give them.

    keywords are distinct, in the order of layers and table. body_score is of all
    layers but embed and domain.
    """
    of = lambda those: F.sum(F.when(those, F.col("score")).otherwise(0.0))
    seen = F.transform(F.array_sort(F.collect_set(F.when(F.col("keyword").isNotNull(), F.struct("at", "keyword")))), lambda x: x["keyword"])
    return found.groupBy(key, "channel").agg(F.sum("score").alias("score"), F.array_distinct(seen).alias("keywords"), of(~F.col("layer").isin("embed", "domain")).alias("body_score"), of(F.col("layer") == "embed").alias("embed_score"))


def gated(scored: DataFrame, texts: DataFrame, key: str, text: Column, table: Table) -> DataFrame:
    """Scores a quarter as high where only weak keywords matched and the text has no strong term."""
    strong_there = F.array_compact(F.array(*[F.when(F.exists(F.array(*map(F.lit, strong)), lambda s: F.contains(F.col("_text"), s)), F.lit(channel)) for channel, (_, strong) in table.gates.items()]))
    told = texts.select(key, F.lower(text).alias("_text")).select(key, strong_there.alias("_strong"))  # names of channels travel, not texts
    only_weak = F.lit(False)
    for channel, (weak, _) in table.gates.items():
        only_weak = only_weak | ((F.col("channel") == channel) & (F.size("keywords") > 0) & (F.size(F.array_except("keywords", F.array(*map(F.lit, weak)))) == 0))
    score = F.when(only_weak & ~F.array_contains("_strong", F.col("channel")), F.col("score") * GATED_WEIGHT).otherwise(F.col("score"))
    return scored.join(told, key).withColumn("score", score).drop("_strong")


def winners(scored: DataFrame, items: DataFrame, key: str, table: Table) -> DataFrame:
    """One row per item: key, channel, top_score, second_channel, second_score, score_margin, matched_keywords, body_score, embed_score, raw_channel_scores, eligible_channel_scores, failed_min_score_channels, min_score_applied, drop_reason.

    The highest score wins, ties by priority. Channels under their floor cannot
    win; items of which all are under it go to the last channel for that reason.
    An item has at most as many scores as there are channels.
    """
    lookup = lambda pairs: F.create_map(*[F.lit(x) for p in pairs for x in p])
    place = lambda order: F.coalesce(F.element_at(lookup([(c, i) for i, c in enumerate(order)]), F.col("channel")), F.lit(len(order)))
    floor = F.coalesce(F.element_at(lookup(table.floors.items()), F.col("channel")), F.lit(0.0)) if table.floors else F.lit(0.0)
    runner = F.when(F.size("keywords") > 0, place(table.runners)).otherwise(len(table.runners)) if table.runners else place(table.priority)
    row = F.struct((-F.col("score")).alias("less"), place(table.priority).alias("first"), runner.alias("next"), "channel", "score", "keywords", "body_score", "embed_score", floor.alias("floor"))
    held = scored.where("score > 0").groupBy(key).agg(F.collect_list(row).alias("all"))
    held = held.withColumn("fit", F.array_sort(F.filter("all", lambda r: r["score"] >= r["floor"])))
    held = held.withColumn("top", F.get("fit", F.lit(0)))
    second = F.array_min(F.transform(F.slice("fit", 2, F.size("fit")), lambda r: F.struct(r["less"], r["next"], r["channel"])))
    scores_of = lambda c: F.map_from_entries(F.transform(F.array_sort(F.transform(c, lambda r: F.struct(r["channel"], F.round(r["score"], 3)))), lambda r: r))
    failed = F.transform(F.filter("all", lambda r: r["score"] < r["floor"]), lambda r: F.struct(r["channel"].alias("channel"), F.round(r["score"], 3).alias("score"), r["floor"].alias("min_required")))
    held = held.select(key, "top", second.alias("second"), scores_of(F.col("all")).alias("raw"), scores_of(F.col("fit")).alias("eligible"), failed.alias("failed"))
    zero, none = F.lit(0.0), F.create_map().cast("map<string,double>")
    lost = F.coalesce(-F.col("second")["less"], zero)
    return items.select(key).join(held, key, "left").select(
        key,
        F.coalesce("top.channel", F.lit(table.priority[-1])).alias("channel"),
        F.coalesce("top.score", zero).alias("top_score"),
        F.coalesce("second.channel", F.lit("")).alias("second_channel"),
        lost.alias("second_score"),
        F.round(F.coalesce("top.score", zero) - lost, 3).alias("score_margin"),
        F.coalesce("top.keywords", F.array().cast("array<string>")).alias("matched_keywords"),
        F.round(F.coalesce("top.body_score", zero), 3).alias("body_score"),
        F.round(F.coalesce("top.embed_score", zero), 3).alias("embed_score"),
        F.coalesce("raw", none).alias("raw_channel_scores"),
        F.coalesce("eligible", none).alias("eligible_channel_scores"),
        F.coalesce("failed", F.array().cast("array<struct<channel:string,score:double,min_required:double>>")).alias("failed_min_score_channels"),
        F.coalesce(F.size("failed") > 0, F.lit(False)).alias("min_score_applied"),
        F.when(F.col("raw").isNotNull() & F.col("top").isNull(), "below_channel_floor").otherwise("").alias("drop_reason"),
    )


def route(items: DataFrame, key: str, layers: dict[str, tuple[Column, float]], host: Column | None = None, gate_text: Column | None = None, table: Table | None = None) -> DataFrame:
    """Route items whose key is unique: the columns of winners and domain_boost_used, e.g. "arxiv.org → science+3", empty without one."""
    table = table or story_table()
    found = matches(items, key, layers, table)
    used = items.select(key, F.lit("").alias("domain_boost_used"))
    if host is not None:
        found = found.unionByName(boosts(items, key, host, table))
        known = _known(items.sparkSession, table.boosts, "_host string, _to string, _boost double")
        text = F.concat(F.col("_host"), F.lit(" → "), F.col("_to"), F.lit("+"), F.col("_boost").cast("int").cast("string"))
        used = items.select(key, host.alias("_host")).join(known, "_host", "left").select(key, F.coalesce(text, F.lit("")).alias("domain_boost_used"))
    scored = scores(found, key)
    if table.gates and gate_text is not None:
        scored = gated(scored, items, key, gate_text, table)
    return winners(scored, items, key, table).join(used, key)


def route_posts(posts: DataFrame, key: str, table: Table) -> DataFrame:
    """Route posts (body, embed_text, hashtags, domain): body and embed count once, hashtags half as much again."""
    layers = {"body": (F.col("body"), 1.0), "embed": (F.col("embed_text"), 1.0), "hashtag": (hashtag_text(F.col("hashtags")), HASHTAG_WEIGHT)}
    text = F.concat_ws(" ", F.coalesce("body", F.lit("")), F.coalesce("embed_text", F.lit("")))
    return route(posts, key, layers, F.col("domain"), text, table)


AUDIT = ("sec", "story_id", "story_title", "domain", "assigned_channel", "top_score", "second_channel", "second_score", "score_margin", "matched_keywords", "domain_boost_used")


def routing_audit(stories: DataFrame, key: str, routed: DataFrame) -> DataFrame:
    """One audit row per story (sec, story_id, story_title, domain) of what route said of it, keywords joined."""
    met = stories.select(key, "sec", "story_id", "story_title", "domain").join(routed, key)
    met = met.withColumn("matched_keywords", F.array_join("matched_keywords", ", ")).withColumnRenamed("channel", "assigned_channel")
    return met.select(*AUDIT)


def inherit(items: DataFrame, rounds: int = 64) -> DataFrame:
    """item_id, root_id, channel of items (item_id, parent_id, channel): a comment takes its parent's channel and root.

    Stories have no parent. Each round doubles the reach of the pointers to
    parents. Items whose chain ends at an unknown parent are dropped.
    """
    at = items.select("item_id", F.coalesce("parent_id", "item_id").alias("up"))
    for _ in range(rounds):
        higher = at.select(F.col("item_id").alias("up"), F.col("up").alias("top"))
        step = at.join(higher, "up").select("item_id", F.col("top").alias("up"), (F.col("top") != F.col("up")).alias("moved"))
        step = checkpointed(step)
        moved = not step.where("moved").isEmpty()
        at = step.select("item_id", "up")
        if not moved:
            break
    stories = items.where("parent_id IS NULL").select(F.col("item_id").alias("up"), "channel")
    return at.join(stories, "up").select("item_id", F.col("up").alias("root_id"), "channel")
