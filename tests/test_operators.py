"""Small cases with known results for operators that SQL does not cover."""

import json
import random
from statistics import median

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidewatch.functions import text as T
from tidewatch.functions.stem import stem
from tidewatch.operators import candidates, cleaning, clustering, consolidation, crosschannel, detection, hashtags, lifecycle, routing, snapshots
from tidewatch.plans import reports
from tidewatch.schema import ANOMALY
from tidewatch.sources import readers, sinks


def channels_of(spark, rows, table=None):
    df = spark.createDataFrame([(i, t, u) for i, (t, u) in enumerate(rows)], "id long, title string, url string")
    out = routing.route(df, "id", {"title": (F.col("title"), 1.0)}, T.domain(F.coalesce("url", F.lit(""))), None, table)
    return {r["id"]: r for r in out.collect()}


#: Titles, pages and the channels they belong to: whole words, phrases, prefix roots, boosts, ties, and near misses.
STORIES = [
    ("Running a small llm on a phone", "", "ai"), ("LLMs write my unit tests now", "", "ai"), ("Which ChatGPT prompts waste money?", "", "ai"), ("A neural network in a spreadsheet", "", "ai"),
    ("Foundation models for weather", "", "ai"), ("The foundation model of our house", "", "ai"), ("Foundations and models", "", "general"), ("Fine-tuning without a cluster", "", "ai"), ("Fine tuning a piano", "", "general"),
    ("Malware hides in a printer driver", "", "security"), ("Hackers sold a bank's backups", "", "security"), ("Exploits for old routers", "", "security"), ("Shacks by the sea", "", "general"),
    ("A zero-day nobody patched", "", "security"), ("Zero day left until the deadline", "", "general"), ("Breaches of a dam", "", "security"),
    ("Bakery chain announces its IPO", "", "startup"), ("Series B of old stamps", "", "startup"), ("Series  C, in two blanks", None, "general"),
    ("Solana outage, hour by hour", "", "crypto"), ("Starship lands upright", "", "science"), ("The science of queues", "", "general"), ("Home assistant in a barn", "", "tech"), ("Assistant at home", "", "general"),
    ("Postgres as a queue", "", "tech"), ("Court strikes down the toll", "", "policy"), ("Lawn care for beginners", "", "general"), ("A chipped mug collection", "", "general"), ("Spaces in file names", "", "general"), ("Bans and banners", "", "general"),
    ("Claude and Apple in one title", "", "ai"), ("Bitcoin before congress", "", "crypto"), ("Ransomware asks for bitcoin", "", "security"),
    ("A quiet result", "https://arxiv.org/abs/2501.00001", "science"), ("A quiet afternoon", "https://www.arxiv.org/abs/1", "science"), ("My dotfiles", "https://github.com/x/y", "tech"), ("A climate study", "https://github.com/x/y", "science"),
    ("Leaked notes of a strike", None, "general"), ("éai ai_x", None, "general"), ("Gardening in the shade", None, "general"),
]


def test_story_routes(spark):
    found = channels_of(spark, [(t, u) for t, u, _ in STORIES])
    assert [(c[0], found[i]["channel"]) for i, c in enumerate(STORIES)] == [(c[0], c[2]) for c in STORIES]


def test_route_audit(spark):
    rows = channels_of(spark, [("Letters of an LLM hobbyist", None), ("Notes on a paper about tides", "https://arxiv.org/abs/2406.9999"), ("Gemini arrives at Microsoft", None), ("The science of queues", None), ("Bitcoin law", "https://sec.gov/x"), ("ipo and seed of a bitcoin wallet", None)])
    assert (rows[0]["channel"], rows[0]["matched_keywords"]) == ("ai", ["llm"])
    assert (rows[1]["channel"], rows[1]["domain_boost_used"], rows[1]["matched_keywords"]) == ("science", "arxiv.org → science+3", ["paper"])
    assert (rows[2]["channel"], rows[2]["second_channel"], rows[2]["score_margin"]) == ("ai", "tech", 0.0)
    assert (rows[3]["channel"], rows[3]["top_score"], rows[3]["domain_boost_used"]) == ("general", 0.0, "")
    assert (rows[4]["channel"], rows[4]["top_score"], rows[4]["second_channel"], rows[4]["raw_channel_scores"]) == ("policy", 4.0, "crypto", {"crypto": 3.0, "policy": 4.0})
    assert (rows[5]["channel"], rows[5]["matched_keywords"], rows[5]["second_channel"]) == ("startup", ["ipo", "seed"], "crypto")


def test_second_place_ties_go_by_the_table(spark):
    table = routing.Table([("a", "x", 1.0), ("b", "y", 1.0), ("c", "z", 3.0)], [("h.org", "a", 1.0)], ["c", "b", "a", "general"], runners=["a", "b", "c"])
    rows = channels_of(spark, [("x y z", None), ("y z", "http://h.org")], table)
    assert [rows[i]["second_channel"] for i in (0, 1)] == ["a", "b"]  # a channel that a boost alone brought comes last


def test_stored_keywords(spark, tmp_path):
    (tmp_path / "k.csv").write_text("channel,keyword,weight\nai_tech,GPT,3\nsports,world cup,2\n")
    words = routing.stored_keywords(spark, f"{tmp_path}/k.csv")
    assert words == [("ai_tech", "gpt", 3.0), ("sports", "world cup", 2.0)]
    with pytest.raises(ValueError):
        routing.stored_keywords(spark, f"{tmp_path}/k.csv", 1)
    posts = spark.createDataFrame([(1, "the World Cup", [], "", "transfermarkt.com")], "id long, body string, hashtags array<string>, embed_text string, domain string")
    (row,) = routing.route_posts(posts, "id", routing.post_table(words)).collect()
    assert (row["channel"], row["top_score"], row["body_score"], row["domain_boost_used"]) == ("sports", 5.0, 2.0, "transfermarkt.com → sports+3")


def test_post_gate_floor_and_hashtags(spark):
    words = [("cybersecurity", "exploit", 2.0), ("cybersecurity", "cve", 3.0), ("social_platforms", "bluesky", 1.0), ("entertainment_fandom", "music", 1.0), ("sports", "soccer", 2.0)]
    table = routing.post_table(words, [])
    rows = [(1, "this exploit in the game", [], ""), (2, "exploit CVE found", [], ""), (3, "bluesky", [], ""), (4, "hello", ["NowPlaying"], ""), (5, "hello", ["SoccerNight"], "")]
    posts = spark.createDataFrame(rows, "id long, body string, hashtags array<string>, embed_text string").withColumn("domain", F.lit(""))
    got = {r["id"]: r for r in routing.route_posts(posts, "id", table).collect()}
    assert got[1]["top_score"] == 0.5
    assert got[2]["top_score"] == 5.0
    assert (got[3]["channel"], got[3]["drop_reason"], got[3]["min_score_applied"]) == ("general", "below_channel_floor", True)
    assert [tuple(x) for x in got[3]["failed_min_score_channels"]] == [("social_platforms", 1.0, 2.0)] and got[3]["eligible_channel_scores"] == {}
    assert (got[4]["channel"], got[4]["top_score"]) == ("entertainment_fandom", 1.5)
    assert (got[5]["channel"], got[5]["top_score"]) == ("sports", 3.0)


def test_inherit_drops_unknown_parents(spark):
    items = spark.createDataFrame([(1, None, "ai"), (2, 1, None), (3, 2, None), (4, 3, None), (9, 8, None)], "item_id long, parent_id long, channel string")
    got = {(r["item_id"], r["root_id"], r["channel"]) for r in routing.inherit(items).collect()}
    assert got == {(1, 1, "ai"), (2, 1, "ai"), (3, 1, "ai"), (4, 1, "ai")}


def test_cleaning(spark):
    rows = [("AutoModerator", "hello"), ("ann", "I am a bot, and this action was performed automatically."), ("bob", "fine"), (None, None)]
    df = spark.createDataFrame(rows, "author string, body string").withColumn("channel", F.lit("Tech"))
    assert [r["author"] for r in cleaning.keep_people(df, ["tech"]).collect()] == ["bob", None]
    posts = [("", ["en"], []), ("hola amigos", ["es"], []), ("Это длинное сообщение на русском языке, которое помечено иначе", ["en"], []), ("look", ["en"], ["NSFW"]), ("Wordle 12 🟩🟩🟩🟩🟩", ["en"], []), ("plain", ["en"], []), ("kept", ["en"], [])]
    df = spark.createDataFrame([(i, *p, "tech" if p[0] == "kept" else "general") for i, p in enumerate(posts)], "i int, body string, langs array<string>, tags array<string>, channel string")
    got = [r[0] for r in df.orderBy("i").select(cleaning.drop_reason(F.col("body"), F.col("langs"), F.col("tags"), F.col("channel"))).collect()]
    assert got == ["empty", "non_english", "language_mismatch", "adult_spam", "routine_template", "unmatched_topic", None]


def test_html_and_domains(spark):
    df = spark.createDataFrame([("<p>AT&amp;T &lt;b&gt;</p><!-- x --> done", "HTTPS://www.Example.com:80/a")], "h string, u string")
    row = df.select(T.html_text(F.col("h")).alias("h"), T.domain(F.col("u")).alias("d"), T.camel_split(F.lit("AINewsToday")).alias("c")).first()
    assert tuple(row) == ("AT&T <b> done", "example.com:80", "AI News Today")


@pytest.mark.parametrize(
    ("word", "root"),
    [("running", "run"), ("flies", "fli"), ("happily", "happili"), ("generously", "generous"), ("knightly", "knight"), ("consolidate", "consolid"), ("questions", "question"), ("hopping", "hop"), ("hoping", "hope"), ("agreed", "agre"), ("skies", "sky"), ("communication", "communic"), ("national", "nation"), ("relational", "relat"), ("being", "be"), ("bus", "bus"), ("ties", "tie"), ("cries", "cri")],
)
def test_stem(word, root):
    assert stem(word) == root


def simulate(items, s):
    """The detector item by item, as a check on bins and the fold."""
    out = []
    first, last = min(x[1] for x in items), max(x[1] for x in items)
    lo, hi = -(-first // s.eval_step) * s.eval_step, -(-last // s.eval_step) * s.eval_step
    for channel in sorted({c for c, _ in items}):
        times = [t for c, t in items if c == channel]
        history, up, since = [], False, 0
        for now in range(lo, hi + 1, s.eval_step):
            n = sum(1 for t in times if now - s.ttl < t <= now)
            if n >= s.min_count or up:
                z = None
                if len(history) >= s.min_history:
                    if channel in s.robust:
                        m = median(history)
                        mad = median(abs(x - m) for x in history)
                        z = (n - m) / (mad + 1e-6) if mad else None
                    else:
                        sd = np.std(history)
                        z = (n - np.mean(history)) / sd if sd > 1e-12 else None
                if z is not None and not up and z >= s.enter:
                    up, since = True, now
                    out.append((channel, now, "start", since))
                elif z is not None and up:
                    up = z > s.leave
                    out.append((channel, now, "update" if up else "release", since))
            if now % s.base_step == 0:
                history = (history + [history[-1] if up and history else n])[-s.keep :]
    return sorted(out)


def test_detector_matches_simulation(spark):
    rng = random.Random(3)
    items = [("a", 1000 + rng.randrange(200_000)) for _ in range(900)] + [("a", 150_000 + rng.randrange(3000)) for _ in range(160)] + [("news", rng.randrange(1000, 200_000)) for _ in range(700)] + [("news", 120_000 + rng.randrange(2000)) for _ in range(90)]
    s = lifecycle.Settings(ttl=3600, eval_step=300, base_step=1800, keep=40, min_history=6, min_count=5)
    df = spark.createDataFrame(items, "channel string, sec long")
    got = sorted((r["channel"], r["tick"], r["event_type"], r["event_start"]) for r in lifecycle.detect(df, s).collect())
    assert got == simulate(items, s)
    kinds = {k for _, _, k, _ in got}
    assert kinds == {"start", "update", "release"}
    rolled = lifecycle.roll_up(lifecycle.detect(df, s)).collect()
    assert len(rolled) == len({(c, e) for c, _, _, e in got})


def test_gate_is_greedy(spark):
    rows = [("a", t, "start", t) for t in (0, 1000, 1900, 3000, 3701)] + [("b", 10, "start", 10)]
    df = spark.createDataFrame(rows, "channel string, tick long, event_type string, event_start long")
    assert sorted((r["channel"], r["tick"]) for r in lifecycle.gate(df).collect()) == [("a", 0), ("a", 1900), ("a", 3701), ("b", 10)]


def test_sliding_counts_of_no_items(spark):
    none = spark.createDataFrame([], "channel string, sec long")
    assert detection.sliding_counts(none).count() == 0


def test_density_labels():
    rng = np.random.default_rng(0)
    points = np.concatenate([rng.normal(0, 0.05, (10, 2)), rng.normal(3, 0.05, (8, 2)), [[10, 10]]])
    labels = clustering.density_labels(points, 0.5, 5)
    assert labels.tolist() == [0] * 10 + [1] * 8 + [-1]


def candidate(i, start, conversations, keywords, domains, top, channel="ai", score=0.5):
    return {"candidate_id": f"c{i}", "source": "hn", "channel": channel, "window_start": start, "window_end": start + 3600, "event_score": score, "z_score": 4.0, "unique_conversation_count": len(conversations), "top_story_id": top, "top_story_title": f"t{i}", "conversation_ids": conversations, "keywords": keywords, "top_domains": domains}


def test_overlaps_give_the_known_score():
    # keywords .375, conversations .60, domains 1.0, shared top story
    event = consolidation.open_event(candidate(0, 0, [1, 2, 3, 4], [f"k{i}" for i in range(8)], ["a.com"], 1))
    score, found = consolidation.compare(event, candidate(1, 3600, [1, 2, 3, 5], ["k0", "k1", "k2", *[f"x{i}" for i in range(5)]], ["a.com"], 1))
    assert (found["keyword_overlap"], found["conversation_overlap"], found["domain_overlap"]) == (0.375, 0.6, 1.0)
    assert score == round(0.25 + 0.3 * 0.6 + 0.15 * 0.375 + 0.05, 4)
    assert found["merge_reason"] == "top_conv_match"


def test_follow_merges_splits_and_closes():
    a = [candidate(0, 0, [1, 2, 3], ["x", "y"], ["d"], 1), candidate(1, 3600, [1, 2, 4], ["x", "z"], ["d"], 1), candidate(2, 7200, [9], ["q"], ["e"], 9), candidate(3, 40_000, [1, 2, 3], ["x", "y"], ["d"], 1)]
    events = consolidation.follow(a)
    assert sorted(e["candidate_ids"] for e in events) == [["c0", "c1"], ["c2"], ["c3"]]
    merged = next(e for e in events if e["candidate_count"] == 2)
    assert (merged["duration_kind"], merged["conversation_ids"], merged["total_item_count"]) == ("developing", [1, 2, 3, 4], 6)
    assert [t["was_seed_candidate"] for t in merged["merge_trace"]] == [True, False]


def test_full_lists_grow_by_one():
    assert consolidation.grow(list(range(15)), [20, 21], 15) == [*range(15), 20]
    assert consolidation.grow(list(range(18)), [3, 20, 21], 15) == [*range(18), 20]
    assert consolidation.grow([1, 2], [2, 3, 3, 4, 5], 4) == [1, 2, 3, 4] and consolidation.grow([], [], 4) == []


def test_general_channel_is_stricter():
    seed = candidate(0, 0, [1, 2, 3, 4], ["x", "y", "z", "w"], ["d"], 1, "general")
    assert consolidation.compare(consolidation.open_event(seed), candidate(1, 3600, [1, 9], ["x", "q", "r", "s"], ["e"], 7, "general"))[0] == 0.0
    assert consolidation.compare(consolidation.open_event(seed), candidate(1, 3600, [1, 9], ["q", "r"], ["d"], 1, "general"))[0] == 0.0


def test_consolidate_frame(spark):
    rows = [candidate(0, 0, [1, 2, 3], ["x", "y"], ["d"], 1), candidate(1, 3600, [1, 2, 4], ["x"], ["d"], 1), candidate(2, 0, [1], ["x"], [], 0, "tech")]
    df = spark.createDataFrame([{**r, "kind": "event_candidate"} for r in rows], "candidate_id string, source string, channel string, window_start long, window_end long, event_score double, z_score double, unique_conversation_count long, top_story_id long, top_story_title string, conversation_ids array<long>, keywords array<string>, top_domains array<string>, kind string")
    got = {r["event_id"]: r for r in consolidation.consolidate(df).collect()}
    assert got["ev:c0"]["candidate_count"] == 2 and got["ev:c2"]["duration_kind"] == "isolated"


def test_candidates_and_recurring_threads(spark):
    cluster = lambda cid, size, unique, pct, title, kws, doms: {"cluster_id": cid, "size": size, "noise_count": 0, "keywords": kws, "top_story_id": 1, "top_story_title": title, "top_story_pct": pct, "unique_story_count": unique, "story_ids": [1], "top_domains": doms}
    rows = [cluster(0, 20, 5, 0.2, "Ask: Who is hiring? (May)", ["a", "b", "c"], ["x", "y"]), cluster(1, 20, 5, 0.2, "News", ["a", "b", "c"], ["x", "y"]), cluster(2, 20, 0, 0.0, "?", [], []), cluster(3, 20, 1, 1.0, "one", ["a"], []), cluster(4, 20, 5, 0.2, "jobs", ["remote", "visa", "salary", "x"], ["x", "y"])]
    df = spark.createDataFrame([("ai", 0, 1, "", 100, 5.0, 1.0, 1.0, [], [], rows)], ANOMALY)
    got = {r["cluster_id"]: (r["kind"], r["event_score"]) for r in candidates.build_candidates(df).collect()}
    assert got == {0: ("recurring_thread", 0.0), 1: ("event_candidate", round(0.25 + 0.16 + 0.2 * 2 / 3 + 0.03 + 0.05 + 0.06, 4)), 3: ("viral_post", round(0.05 + 0 + 0 + 0.03 + 0.05 + 0.02, 4)), 4: ("topic_surge", round(0.25 + 0.16 + 0.2 * 2 / 3 + 0.03 + 0.05 + 0.08, 4))}


def test_sustained_chain_needs_four_hours(spark):
    rows = [(i, "ai", 3600 * i, 3600 * (i + 1), 3.0 + i) for i in range(5)] + [(9, "ai", 3600 * 20, 3600 * 21, 9.0)]
    anomalies = spark.createDataFrame(rows, "id long, channel string, window_start long, window_end long, z_score double")
    words = spark.createDataFrame([(i, 0, w) for i in (*range(5), 9) for w in ("alpha", "beta", f"w{i}")], "id long, cluster_id long, word string")
    for hourly in (True, False):
        (event,) = crosschannel.sustained_events(anomalies, words, hourly).collect()
        assert (event["anomaly_count"], event["event_start"], event["event_end"], event["peak_z"]) == (5, 0, 18000, 7.0)


def test_flash_components_split_by_span(spark):
    rows = [(i, f"ch{i % 2}", 7000 * i, 7000 * i + 3600, 3.0) for i in range(5)]
    anomalies = spark.createDataFrame(rows, "id long, channel string, window_start long, window_end long, z_score double")
    words = spark.createDataFrame([(i, 0, w) for i in range(5) for w in ("alpha", "beta")], "id long, cluster_id long, word string")
    got = sorted(tuple(r["anomaly_ids"]) for r in crosschannel.flash_events(anomalies, words).collect())
    assert got == [(0, 1, 2), (3, 4)]
    kinds = {r["event_type"] for r in crosschannel.aggregate_events(anomalies, words).collect()}
    assert kinds == {"FLASH"}


def test_hashtag_promotion(spark):
    posts = spark.createDataFrame([(i, i, ["Tag", "other"] if i == 6 else ["tag"], "ai", f"u{i}", "", "b") for i in range(7)], "id long, sec long, hashtags array<string>, channel string, author string, domain string, body string")
    found = hashtags.occurrences(posts)
    (top,) = hashtags.promoted(found).collect()
    assert (top["tag"], top["since"]["id"]) == ("tag", 4)
    assert [tuple(r) for r in hashtags.partners(found, hashtags.promoted(found)).collect()] == [("tag", "other", 1)]
    snap = {r["tag"]: r for r in hashtags.snapshot(found).collect()}
    assert (snap["tag"]["total"], snap["tag"]["unique_authors_capped"]) == (7, 3)


def test_zst_reader(spark, tmp_path):
    import zstandard

    good = [{"id": str(i), "created_utc": i, "subreddit": "s", "body": "é" * i, "score": 1, "author": "a", "parent_id": "p", "link_id": "l", "permalink": "/"} for i in range(5)]
    raw = "\n".join([json.dumps(g) for g in good[:3]] + ["{broken"] + [json.dumps(good[3])]) + "\n" + json.dumps(good[4])
    (tmp_path / "a.zst").write_bytes(zstandard.ZstdCompressor().compress(raw.encode()))
    for through_spark in (False, True):
        rows = readers.comments_zst(spark, str(tmp_path), through_spark).collect()
        assert sorted(r["id"] for r in rows) == ["0", "1", "2", "3"]


def test_story_csv(spark, tmp_path):
    (tmp_path / "x.csv").write_text('id,type,author,timestamp,body,title,parent\n2,comment,a,20,"two\nlines",,1\n1,story,b,10,,T,\n')
    rows = readers.stories_csv(spark, str(tmp_path / "x.csv")).collect()
    assert [(r["item_id"], r["sec"], r["parent"], r["body"]) for r in rows] == [(1, 10, None, ""), (2, 20, 1, "two\nlines")]


def test_firehose_posts(spark):
    post = {"kind": "commit", "did": "did:x", "time_us": 5_900_000, "commit": {"operation": "create", "collection": "app.bsky.feed.post", "rkey": "r", "cid": "c", "record": {"text": "hi #Tag", "langs": ["en"], "facets": [{"features": [{"$type": "app.bsky.richtext.facet#tag", "tag": "Tag"}]}, {"features": [{"$type": "app.bsky.richtext.facet#link", "uri": "https://a.b"}]}], "embed": {"$type": "app.bsky.embed.external", "external": {"uri": "https://c.d/x", "title": "Title", "description": " "}}}}}
    drop = {**post, "commit": {**post["commit"], "operation": "delete"}}
    df = spark.createDataFrame([(json.dumps(post),), (json.dumps(drop),)], "value string")
    (row,) = readers.posts_from_messages(df).collect()
    assert (row["sec"], row["hashtags"], row["links"], row["external_uri"], row["embed_text"], row["is_reply"]) == (5, ["Tag"], ["https://a.b"], "https://c.d/x", "Title", False)


def test_alert_sink(spark):
    rows = [("ai", "start", 3.456, 10, 1_700_000_000, [f"k{i}" for i in range(10)]), ("ai", "update", 3.0, 9, 1_700_000_000, [])] + [(f"c{i}", "start", 3.0, 9, 1_700_000_000, []) for i in range(150)]
    df = spark.createDataFrame(rows, "channel string, event_type string, z_score double, count long, window_end long, keywords array<string>")
    sent = []
    assert sinks.send_alerts(df, "https://discord.com/x", lambda u, b: sent.append(b)) == 151  # every start, however many
    embed = next(json.loads(b)["embeds"][0] for b in sent if '"Surge Detected — ai"' in b)
    assert [f["value"] for f in embed["fields"]] == ["ai", "Nov 14 22:13 UTC", "10", "3.46", "k0, k1, k2, k3, k4, k5, k6, k7"] and embed["color"] == 0xE53935
    sent.clear()
    sinks.send_alerts(df.where("channel = 'c1'"), "https://example.org", lambda u, b: sent.append(b))
    assert json.loads(sent[0])["text"] == "SURGE | c1 | Nov 14 22:13 UTC | count=9 z=3.00 | —"
    assert sinks.send_alerts(df, None) == 0

    def broken(url, body):
        raise OSError

    assert sinks.send_alerts(df, "https://x", broken) == 0
    good = sinks.health("ok", "2024-01-01T00:00:00Z", "c")
    bad = sinks.health("warning", "2024-01-01T00:05:00Z", "c", good, ValueError("x"))
    assert (bad["last_successful_fetch_utc"], bad["last_error_type"], bad["last_error_message"]) == ("2024-01-01T00:00:00Z", "ValueError", "x")


def test_references_are_read_as_markup_has_them(spark):
    import html
    import html.entities

    texts = ["&lt;b&gt;", "&#65;&#x42;&#X43;", "&copy2024 &amp", "&notit; &notin;", "&nothing; & &; &#; &#x;", "&#0;&#128;&#x99;&#xD800;&#x110000;&#99999999999;", "&#x1F600;&hearts;&CounterClockwiseContourIntegral;", "a&ampb&&amp;&", "&#7;|&#xFDD0;|&#13;", "&#10&#010", "plain", "AT&T", None]
    texts += ["".join(f"&{n}" for n in html.entities.html5)]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    got = {r["i"]: r["u"] for r in df.select("i", T.unescape(F.col("t")).alias("u")).collect()}
    assert got == {i: None if t is None else html.unescape(t) for i, t in enumerate(texts)}
    assert df.limit(1).select(T.html_text(F.lit("<p>&amp;lt;i&amp;gt; AT&amp;amp;T</p>"))).first()[0] == "<i> AT&T"


def test_second_unescape_and_live_items(spark):
    rows = [(1, "story", "ann", 10, None, "Why I left AT&amp;T", None, None, 5, None, None), (2, "comment", "bob", 11, "<p>fine</p>", None, None, 1, None, False, None), (3, "comment", None, 12, "<br>", None, None, 1, None, None, None), (4, "comment", "c", 13, "x", None, None, None, None, None, None), (5, "comment", "c", 13, "x", None, None, 1, None, True, None), (6, "job", "c", 13, "x", None, None, 1, None, None, True)]
    raw = spark.createDataFrame(rows, readers.STORY_JSON)
    items = readers.story_items(raw)
    assert [(r["item_id"], r["body"], r["score"], r["author"]) for r in items.orderBy("item_id").limit(2).collect()] == [(1, "Why I left AT&T", 5, "ann"), (2, "fine", 0, "bob")]
    assert sorted(r["item_id"] for r in items.collect()) == [1, 2, 4, 5, 6]
    assert sorted(r["item_id"] for r in cleaning.live_items(items).collect()) == [1, 2]


def test_numbered_items_stream(spark, tmp_path):
    newest = tmp_path / "newest"
    newest.write_text("100")

    def fetch(i):
        if i == 103:
            raise OSError("gone")
        return None if i == 104 else {"id": i, "type": "story", "title": f"t{i}", "time": i}

    path = str(newest)
    spark.dataSource.register(readers.numbered_items(lambda: int(open(path).read()), fetch, "numbered_test", 2))
    stream = spark.readStream.format("numbered_test").load()
    out, state = str(tmp_path / "out"), str(tmp_path / "state")
    query = lambda: stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", state)
    q = query().start()
    q.processAllAvailable()
    newest.write_text("106")
    q.processAllAvailable()
    q.stop()
    assert sorted(r["id"] for r in spark.read.parquet(out).collect()) == [101, 102, 105, 106]
    pauses = []
    calls = iter([1, 1, 0])

    def flaky():
        if next(calls):
            raise OSError
        return 7

    assert readers.retried(flaky, sleep=pauses.append) == 7 and pauses == [5.0, 10.0]


def test_member_codec(spark):
    df = spark.createDataFrame([("x" * 200, 5, ["a"]), (None, None, None)], "t string, s long, h array<string>")
    members = df.select(T.encode_member(text=F.col("t"), story_id=F.col("s"), hashtags=F.col("h")).alias("m"))
    got = members.union(spark.createDataFrame([("old entry",)], "m string")).select(T.decode_member(F.col("m")).alias("d")).collect()
    assert (got[0]["d"]["text"], got[0]["d"]["story_id"], got[0]["d"]["hashtags"], got[0]["d"]["domain"], got[0]["d"]["route_score"]) == ("x" * 120, 5, ["a"], "", 0.0)
    assert (got[1]["d"]["text"], got[1]["d"]["story_id"]) == ("", 0)
    assert (got[2]["d"]["text"], got[2]["d"]["author"], got[2]["d"]["hashtags"]) == ("old entry", "", [])


def brute_chains(rows, ok, overlap=0.5, hours=4):
    """Row by row, as long topics are defined: the second row picks the track, which grows."""
    out, i = [], 0
    while i < len(rows):
        topic, n = None, 1
        while i + n < len(rows) and ok(rows[i + n][0] - rows[i + n - 1][0]):
            tracks = rows[i][1] if topic is None else [topic]
            best = max(((len(a & b) / min(len(a), len(b)), -x, -y) for x, a in enumerate(tracks) for y, b in enumerate(rows[i + n][1]) if len(a & b) >= 2), default=None)
            if best is None or best[0] < overlap:
                break
            topic = tracks[-best[1]] | rows[i + n][1][-best[2]]
            n += 1
        if n >= hours:
            out.append((i, i + n - 1))
        i += n if n >= hours else 1
    return out


def test_long_topics():
    rng = random.Random(8)
    for _ in range(60):
        at, rows = 0, []
        for _ in range(30):
            at += rng.choice([3600, 3600, 3600, 3600, 7200, 10_800])
            rows.append((at, [set(rng.sample("abcdef", rng.randrange(2, 5))) for _ in range(rng.randrange(0, 3))]))
        for ok in (lambda g: g == 3600, lambda g: g <= 7200):
            assert [(a, b) for a, b, _ in crosschannel.long_topics(rows, ok)] == brute_chains(rows, ok)


def test_cluster_words_stem_before_they_stop(spark):
    df = spark.createDataFrame([(1, 0, "running, runs, people, posted, messages, audio"), (1, 1, "peoples"), (2, 0, ""), (3, 0, None)], "id long, cluster_id long, keywords string")
    assert {tuple(r) for r in crosschannel.cluster_words(df).collect()} == {(1, 0, "run")}


def test_clusters_over_blocks_match_one_block(spark, monkeypatch):
    rng = np.random.default_rng(2)
    centres = rng.normal(0, 4, (6, 3))
    points = [(g, i * 2 + g, (centres[rng.integers(0, 6)] + rng.normal(0, 0.25, 3)).tolist()) for g in (0, 1) for i in range(90)] + [(2, 9001, [0.0, 0.0, 0.0])]
    df = spark.createDataFrame(points, "g int, k long, v array<double>")
    wanted = {}
    for g in (0, 1, 2):
        own = sorted((k, v) for gg, k, v in points if gg == g)
        labels = clustering.density_labels(np.array([v for _, v in own]), 0.4, 4)
        wanted |= {(g, k): int(x) for (k, _), x in zip(own, labels, strict=True)}
    for most in (4000, 20):
        monkeypatch.setattr(clustering, "BLOCK_POINTS", most)
        for made in (clustering.cluster, clustering.block_clusters):
            got = {(r["g"], r["k"]): r["cluster_id"] for r in made(df, "g", "k", "v", 0.4, 4).collect()}
            assert got == wanted and set(wanted.values()) > {-1, 0, 1}


def test_reduced_axes(spark):
    rng = np.random.default_rng(5)
    x = rng.normal(0, 1, (80, 5)) * np.array([5, 3, 0.1, 0.1, 0.1])
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "i int, v array<double>")
    got = np.array([r["reduced"] for r in clustering.reduced(df, "v").orderBy("i").collect()])
    assert got.shape == (80, 2) and np.allclose(got.var(axis=0), np.sort(np.linalg.eigvalsh(np.cov(x.T, bias=True)))[::-1][:2])


def test_lone_cluster_keywords_lose_stop_words_after_ranking(spark):
    text = ["really"] * 5 + ["pretty"] * 4 + ["alpha"] * 3 + ["quite"] * 2
    words = spark.createDataFrame([(1, 0, w, i) for i, w in enumerate(text)] + [(2, 0, "really", 0)], "id long, cluster_id long, token string, first long")
    got = clustering.class_tfidf(words, ["id"], 3).orderBy("id", "place").collect()
    assert [(r["id"], r["token"]) for r in got] == [(1, "alpha"), (2, "really")]


def test_snapshot_and_flags(spark):
    rows = [("science_space", "s", "opening", i, f"text {i % 3}", "ann" if i < 70 else "bob", "arxiv.org" if i < 65 else "", ["t"], ["k"] if i % 2 else ["k", "j"]) for i in range(100)]
    rows += [("science_space", "s", "peak", i, "same", "ann", "arxiv.org", [], []) for i in range(120)] + [("ai", "s", "opening", i, "same" if i < 20 else f"own {i}", f"u{i}", "", [], []) for i in range(60)]
    df = spark.createDataFrame(rows, "channel string, event_start string, phase string, pos int, text string, author string, domain string, hashtags array<string>, keywords array<string>")
    shots = snapshots.snapshots(df, ["channel", "event_start", "phase"])
    first = shots.where("channel = 'science_space' AND phase = 'opening'").first()
    assert (first["total"], [tuple(x) for x in first["keywords"]], [tuple(x) for x in first["authors"]], first["top_text_pct"], len(first["posts"])) == (100, [("k", 100), ("j", 50)], [("ann", 70), ("bob", 30)], 0.34, 5)
    got = {r["channel"]: (r["opening_reason"], r["peak_reason"], r["feed_burst"], r["coordinated"]) for r in snapshots.flagged(shots).collect()}
    assert got == {"science_space": ("known_feed_domain:arxiv.org", "known_feed_domain:arxiv.org", True, False), "ai": (None, None, False, True)}


def test_recurrence_counts_closures(spark):
    rows = [(f"e{i}", "ai" if i in (0, 70) else "other", 86400 * i + (100 if i in (0, 70) else 40_000), 86400 * i + 50_000) for i in range(75)]
    near = [("e71b", "ai", 86400 * 71 + 200, 86400 * 71 + 60_000)]
    df = spark.createDataFrame(rows + near, "event_id string, channel string, event_start long, released_at long")
    got = {r["event_id"]: r["recurs"] for r in detection.recurring(df).collect()}
    assert got["e70"] is None and got["e71b"] == "e70" and got["e5"] == "e4"


def test_silent_channel_is_released(spark, tmp_path):
    from datetime import datetime, timezone

    from tidewatch.streaming import jobs

    s = lifecycle.Settings(ttl=3600, eval_step=300, base_step=1800, keep=40, min_history=6, min_count=5)
    rng = random.Random(3)
    loud = [("a", rng.randrange(1000, 100_000)) for _ in range(400)] + [("a", 100_000 + rng.randrange(600)) for _ in range(200)]
    parts = [loud, [("b", 100_600 + 600 * i) for i in range(40)], [("b", 130_000)], [("b", 131_000)]]
    schema = "id long, channel string, ts timestamp"
    src = tmp_path / "in"
    for n, part in enumerate(parts):
        rows = [(i, c, datetime.fromtimestamp(t, timezone.utc)) for i, (c, t) in enumerate(part)]
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(src / f"{n}"))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(str(src))
    jobs.run_available(jobs.detect(stream, s), str(tmp_path / "out"), str(tmp_path / "state"))
    got = spark.read.parquet(str(tmp_path / "out")).where("channel = 'a'").orderBy("tick").collect()
    assert got[-1]["event_type"] == "release" and {"start", "update"} <= {r["event_type"] for r in got}


def test_health_listener_and_metrics(spark, tmp_path):
    from tidewatch.streaming import health, jobs

    told = []
    listener = health.HealthListener(told.append, "test")
    spark.streams.addListener(listener)
    try:
        df = spark.createDataFrame([(i,) for i in range(10)], "v int")
        df.write.parquet(str(tmp_path / "in"))
        jobs.run_available(spark.readStream.schema("v int").parquet(str(tmp_path / "in")), str(tmp_path / "out"), str(tmp_path / "state"))
        import time

        for _ in range(100):
            if listener.reports:
                break
            time.sleep(0.1)
    finally:
        spark.streams.removeListener(listener)
    assert told and told[-1]["status"] == "ok" and told[-1]["component"] == "test"
    assert health.run_metrics(spark, listener).agg(F.sum("items")).first()[0] == 10
    last = {"status": "ok", "last_heartbeat_utc": "2024-01-01T00:00:00.000Z"}
    assert health.banner(last, 1704067200 + 60) == "ok" and health.banner(last, 1704067200 + 901) == "stale"


def test_lifecycle_sink_survives_replays(spark, tmp_path):
    from tidewatch.streaming import jobs

    batches = [
        [("ai", 300, "start", 300, 20, 4.0, 1.0, 1.0), ("ai", 600, "update", 300, 30, 5.0, 1.5, 1.0)],
        [("ai", 900, "release", 300, 5, 1.0, 2.0, 1.0), ("x", 900, "start", 900, 9, 3.0, 1.0, 1.0)],
        [],
        [("x", 1200, "update", 900, 12, 6.0, 1.0, 2.0), ("ai", 1500, "start", 1500, 7, 3.5, 1.0, 1.0)],
    ]
    sink = jobs.LifecycleSink(str(tmp_path), keep=2)
    for batch, rows in enumerate(batches):
        for _ in range(2 if batch != 1 else 3):  # the same batch again replaces what it wrote
            sink(spark.createDataFrame(rows, lifecycle.EVENTS), batch)
    every = lifecycle.roll_up(spark.createDataFrame([r for b in batches for r in b], lifecycle.EVENTS))
    assert sorted(map(tuple, sink.lifecycles(spark).select(every.columns).collect())) == sorted(map(tuple, every.collect()))
    told = {r["channel"]: (r["fires"], r["max_z"], r["active"], r["last_seen"], r["updates"]) for r in spark.read.json(f"{tmp_path}/summary").collect()}
    assert told == {"ai": (2, 5.0, 1, 1500, 1), "x": (1, 6.0, 1, 1200, 1)}
    assert len(list((tmp_path / "open").glob("batch=*"))) == 2


def test_archives_and_readers(spark, tmp_path):
    from datetime import date

    rows = [("c1", "hn", "ai", 86400, 90000, "event_candidate"), ("c2", "hn", "ai", 2 * 86400, 2 * 86400 + 60, "recurring_thread"), ("c3", "hn", "x", 5 * 86400, 5 * 86400 + 9, "topic_surge")]
    df = spark.createDataFrame(rows, "candidate_id string, source string, channel string, window_start long, window_end long, kind string")
    sinks.write_archive(df, str(tmp_path / "c"))
    got = readers.candidates_between(spark, str(tmp_path / "c"), date(1970, 1, 2), date(1970, 1, 3))
    assert sorted(r["candidate_id"] for r in got.collect()) == ["c1", "c2"] and got.first()["keywords"] == []
    assert reports.recurring_between(df, 0, 3 * 86400).first()[0] == 1
    assert [r["candidate_id"] for r in reports.select_candidates(df).orderBy("candidate_id").collect()] == ["c1", "c3"]
    assert reports.select_candidates(df, kind="recurring_thread").count() == reports.select_candidates(df, recurring=True).count() - 2 == 1
    sinks.append_records(df, str(tmp_path / "log"))
    sinks.append_records(df, str(tmp_path / "log"))
    assert spark.read.json(str(tmp_path / "log")).count() == 6
    import os

    for n, t in (("a", 100), ("b", 200)):
        (tmp_path / "snap").mkdir(exist_ok=True)
        (tmp_path / "snap" / f"{n}.json").write_text(json.dumps({"name": n}))
        os.utime(tmp_path / "snap" / f"{n}.json", (t, t))
    assert readers.latest_snapshot(spark, str(tmp_path / "snap"), "name string").first()["name"] == "b"
    items = spark.createDataFrame([(5,), (10,), (15,)], "sec long")
    assert cleaning.between(items, 10, 15).count() == 1 and cleaning.between(items, end=15).count() == 2


def test_cluster_folder_must_be_named(spark):
    from types import SimpleNamespace

    from tidewatch import checkpoints

    empty = SimpleNamespace(sc=lambda: SimpleNamespace(getCheckpointDir=lambda: SimpleNamespace(isEmpty=lambda: True)))
    cluster = SimpleNamespace(sparkContext=SimpleNamespace(_jsc=empty, master="spark://x:7077"), conf=SimpleNamespace(get=lambda *_: ""))
    with pytest.raises(ValueError):
        checkpoints.shared_folder(cluster)


def test_layout_evolves_by_default_fill(spark):
    from tidewatch.schema import CANDIDATE, conform

    old = spark.createDataFrame([("c1", "ai", None, 7)], "candidate_id string, channel string, keywords array<string>, legacy int")
    (row,) = conform(old, CANDIDATE).collect()
    assert (row["candidate_id"], row["keywords"], row["window_end"], row["event_score"], row["source"]) == ("c1", [], 0, 0.0, "") and "legacy" not in row.asDict()


def test_report_orders_and_marks(spark):
    rows = [("a", "viral_post", 0.9), ("b", "recurring_thread", 0.0), ("c", "event_candidate", 0.1), ("d", "event_candidate", 0.7), ("e", "topic_surge", 0.2)]
    df = spark.createDataFrame(rows, "candidate_id string, kind string, event_score double")
    assert [r["candidate_id"] for r in reports.order_candidates(df).collect()] == ["d", "c", "e", "a", "b"]
    events = spark.createDataFrame([("ai", 3700)], "primary_channel string, first_seen long")
    history = spark.createDataFrame([("ai", 3600, 5), ("ai", 7200, 6), ("x", 3600, 1)], "channel string, x long, y long")
    got = {(r["channel"], r["x"]): r["mark"] for r in reports.dashboard_series(events, history).collect()}
    assert got == {("ai", 3600): True, ("ai", 7200): False, ("x", 3600): False}


def test_texts_that_count_and_stand_in_vectors(spark):
    df = spark.createDataFrame([("fine",), ("",), (" [deleted]",), ("[removed]",), (None,)], "b string")
    assert [r[0] for r in df.select(cleaning.countable_text(F.col("b"))).collect()] == [True, False, False, False, False]
    (v, w, none) = [r[0] for r in spark.createDataFrame([("alpha beta alpha",), ("beta alpha alpha",), ("",)], "t string").select(clustering.hashed_embedding(F.col("t"), 16)).collect()]
    assert v == w and abs(sum(x * x for x in v) - 1) < 1e-9 and none == [0.0] * 16
