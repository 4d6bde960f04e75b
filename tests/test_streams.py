import json
import random
import re

import numpy as np
import pytest
from pyspark.sql import Observation
from pyspark.sql import functions as F

from tidewatch.functions.automaton import Automaton
from tidewatch.functions.text import keyword_pattern
from tidewatch.operators import cleaning, clustering, consolidation, detection, lifecycle
from tidewatch.schema import CANDIDATE
from tidewatch.sources import manifest
from tidewatch.streaming import health, jobs, ticks, tracking


def candidates(n=160, seed=4):
    """Candidates of three channels, one of them general, with ties, gaps beyond the stale time, and shared words."""
    rng, rows, at = random.Random(seed), [], 0
    for i in range(n):
        at += rng.choice([0, 600, 1800, 3600, 5400, 9000, 30_000])
        some = lambda p, m, k: sorted({f"{p}{rng.randrange(m)}" for _ in range(rng.randrange(k + 1))})
        rows.append({
            "candidate_id": f"c{i:03d}", "source": rng.choice(["hacker_news", "bsky"]), "channel": rng.choice(["ai", "general", "x"]), "window_start": at, "window_end": at + 3600, "cluster_id": 0, "kind": rng.choice(["event_candidate"] * 5 + ["topic_surge"]),
            "event_score": round(rng.random(), 3), "size": 10, "unique_conversation_count": rng.randrange(1, 9), "top_conversation_pct": 0.5, "top_story_id": rng.randrange(6), "top_story_title": rng.choice(["", "a", "b"]), "conversation_ids": sorted({rng.randrange(9) for _ in range(4)}),
            "top_domains": some("d", 4, 3), "keywords": some("w", 9, 5) + rng.choice([[], ["people"]]), "z_score": rng.random(), "window_count": 5, "dbscan_eps": 0.5, "dbscan_min_samples": 5,
        })
    return rows


def plain_follow(rows):
    """Every open event is tried for every candidate."""
    live, done = [], []
    for c in rows:
        done += [e for e in live if c["window_start"] - e["last_seen"] > consolidation.STALE_SECONDS]
        live = [e for e in live if c["window_start"] - e["last_seen"] <= consolidation.STALE_SECONDS]
        scored = [consolidation.compare(e, c) for e in live]
        best = max((s for s, _ in scored), default=0.0)
        if best >= consolidation.LEAST_SCORE:
            k = [s for s, _ in scored].index(best)
            live[k] = consolidation.merged(live[k], c, *scored[k])
        else:
            live.append(consolidation.open_event(c))
    return done + live


def key(e):
    return e["event_id"], e["last_seen"], e["candidate_ids"], e["keywords"], e["avg_score"], [t["merge_score"] for t in e["merge_trace"]]


def test_index_finds_what_a_scan_of_all_events_finds():
    for seed in range(12):
        rows = [r for r in candidates(120, seed) if r["channel"] == ("general" if seed % 3 == 0 else "ai")]
        rows = sorted(rows, key=lambda r: (r["window_start"], r["candidate_id"]))
        assert sorted(map(key, consolidation.follow(rows))) == sorted(map(key, plain_follow(rows)))


def test_stream_of_candidates_gives_the_batch_events(spark, tmp_path):
    rows = sorted(candidates(), key=lambda r: (r["window_start"], r["candidate_id"]))
    df = spark.createDataFrame([tuple(r[x.split()[0]] for x in CANDIDATE.split(", ")) for r in rows], CANDIDATE)
    wanted = sorted((r["event_id"], r["last_seen"], tuple(r["candidate_ids"]), r["avg_score"], r["duration_kind"]) for r in consolidation.consolidate(df).collect())
    half = rows[80]["window_start"]
    stream = lambda: tracking.track_events(spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in" / "*")))
    end = df.limit(1).withColumns({"candidate_id": F.lit(None).cast("string"), "kind": F.lit("event_candidate"), "window_start": F.lit(10**9).cast("long")})
    # a restart between the parts goes on from the state
    for name, part in (("a", df.where(F.col("window_start") < half)), ("b", df.where(F.col("window_start") >= half)), ("c", end)):
        part.coalesce(1).write.parquet(str(tmp_path / "in" / name))
        with tracking.rocksdb(spark):
            jobs.run_available(stream(), str(tmp_path / "out"), str(tmp_path / "state"))
    got = spark.read.schema(stream().schema).parquet(str(tmp_path / "out")).collect()
    assert sorted((r["event_id"], r["last_seen"], tuple(r["candidate_ids"]), r["avg_score"], r["duration_kind"]) for r in got) == wanted
    assert len(wanted) > 20 and max(len(w[2]) for w in wanted) > 2


def test_gate_remembers_over_restarts(spark, tmp_path):
    rng, at, rows = random.Random(1), 0, []
    for _ in range(60):
        at += rng.randrange(0, 900)
        rows.append((rng.choice("ab"), at, rng.choice(["start", "start", "update"])))
    df = spark.createDataFrame(rows, "channel string, tick long, event_type string")
    wanted = sorted(map(tuple, lifecycle.gate(df, 1200, ("start",)).collect()))
    for name, part in (("a", df.where(F.col("tick") <= at // 2)), ("b", df.where(F.col("tick") > at // 2))):
        part.coalesce(1).write.parquet(str(tmp_path / "in" / name))
        with tracking.rocksdb(spark):
            jobs.run_available(tracking.gate(spark.readStream.schema(df.schema).parquet(str(tmp_path / "in" / "*")), 1200, ("start",)), str(tmp_path / "out"), str(tmp_path / "state"))
    assert sorted(map(tuple, spark.read.schema(df.schema).parquet(str(tmp_path / "out")).collect())) == wanted


def test_scan_sets_broken_files_aside(spark, tmp_path):
    folder, where = tmp_path / "in", str(tmp_path / "manifest")
    spark.range(40).repartition(4).write.parquet(str(folder))
    whole = sorted(folder.glob("*.parquet"))
    (folder / "cut.parquet").write_bytes(whole[0].read_bytes()[:-20])
    body = bytearray(whole[1].read_bytes())
    body[8:40] = bytes(32)
    (folder / "page.parquet").write_bytes(bytes(body))
    (folder / "empty.parquet").write_bytes(b"")
    seen = []

    def fails(rows, run):
        raise RuntimeError("later work failed")

    with pytest.raises(RuntimeError):
        manifest.scan_new(spark, str(folder), where, fails)
    assert {r["status"] for r in manifest.manifest(spark, where).collect()} == {manifest.PENDING}
    first = manifest.scan_new(spark, str(folder), where, lambda rows, run: seen.append(sorted(r["id"] for r in rows.collect())))
    assert {r["path"].rsplit("/", 1)[1] for r in first.where("status = 'corrupt'").collect()} == {"cut.parquet", "page.parquet"}
    assert seen == [list(range(40))]
    assert manifest.scan_new(spark, str(folder), where, fails).count() == 0
    spark.range(40, 44).coalesce(1).write.mode("append").parquet(str(folder))
    manifest.scan_new(spark, str(folder), where, lambda rows, run: seen.append(sorted(r["id"] for r in rows.collect())))
    assert seen[1:] == [[40, 41, 42, 43]]
    assert {r["status"]: r["n"] for r in manifest.manifest(spark, where).groupBy("status").agg(F.count("*").alias("n")).collect()} == {"read": 5, "corrupt": 2}


def test_automaton_finds_what_patterns_find():
    rng = random.Random(6)
    keywords = ["ai", "gpt", "series a", "series b", "fine-tuning", "hack", "union", "foundation model", "new york", "new york city", "state-of-the-art", "é", "c++", "18+", "naïve bayes", "e\u0301t", "a", "of the", "the art"]
    roots = {"hack", "union", "foundation model", "18+"}
    parts = ["AI", "ai", "gpt", "GPTs", "series", "a", "B", "b", "fine", "tuning", "-", " ", "  ", "\n", "hackers", "Unions", "foundation", "models", "New", "York", "City", "state", "of", "the", "art", "é", "É", "c++", "18+", "18", "+", "naïve", "bayes", "_", "e\u0301t", ".", "'"]
    auto = Automaton(keywords, roots)
    word = auto.word.pattern
    for _ in range(3000):
        text = "".join(rng.choice(parts) + rng.choice(["", " ", "-"]) for _ in range(rng.randrange(0, 9)))
        wanted = set()
        for k in keywords:
            edge = lambda c: rf"(?:(?<!{word[:-1]}))" if re.fullmatch(word, c) else rf"(?<={word[:-1]})"
            after = lambda c: rf"(?!{word[:-1]})" if re.fullmatch(word, c) else rf"(?={word[:-1]})"
            if re.search(edge(k[0]) + re.escape(k) + ("" if k in roots else after(k[-1])), text.lower()):
                wanted.add(k)
        assert set(auto.find(text)) - {"c++", "18+"} == wanted - {"c++", "18+"}, text
    assert auto.find("see 18+ only") == ["18+"] or auto.find("x18+") == [] and keyword_pattern("18+", roots)
    assert auto.find(None) == auto.find("") == []


def test_run_summary_and_observation(spark):
    rows = [(None, ["en"], "ai", ["gpt", "llm"], ["A"], "h"), (None, ["en", "de"], "ai", ["gpt"], [], ""), ("unmatched_topic", ["en"], "general", [], ["b", "c", "b"], "x.org"), ("unmatched_topic", [], "general", None, None, None), ("empty", None, "x", ["gpt"], ["z"], "x.org")]
    df = spark.createDataFrame(rows, "drop_reason string, langs array<string>, channel string, matched_keywords array<string>, hashtags array<string>, domain string")
    seen = Observation("run")
    got = cleaning.run_summary(cleaning.observed(df, seen)).first()
    pairs = lambda name: [tuple(x) for x in got[name]]
    assert (got["total_seen"], got["english_seen"], got["kept_count"], got["dropped_count"], got["kept_rate"]) == (5, 3, 2, 3, 0.4)
    assert pairs("dropped_by_reason") == [("unmatched_topic", 2), ("empty", 1)] and pairs("kept_by_channel") == [("ai", 2)]
    assert pairs("top_matched_keywords") == [("gpt", 2), ("llm", 1)] and pairs("top_unmatched_hashtags") == [("b", 2), ("c", 1)] and pairs("top_unmatched_domains") == [("x.org", 1)]
    assert {k: seen.get[k] for k in ("total_seen", "kept_count", "unmatched_topic", "empty", "adult_spam")} == {"total_seen": 5, "kept_count": 2, "unmatched_topic": 2, "empty": 1, "adult_spam": 0}
    none = cleaning.run_summary(df.limit(0)).first()
    assert none["total_seen"] == 0 and none["kept_rate"] == 0.0 and none["dropped_by_reason"] == []
    plan = cleaning.run_summary(df)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Scan ExistingRDD") == 1


def test_observed_counts_of_a_stream(spark, tmp_path):
    import time

    listener = health.HealthListener(lambda doc: None)
    spark.streams.addListener(listener)
    try:
        df = spark.createDataFrame([(None, ["en"]), ("empty", ["de"])], "drop_reason string, langs array<string>")
        for i in range(2):
            df.coalesce(1).write.parquet(str(tmp_path / "in" / str(i)))
            jobs.run_available(cleaning.observed(spark.readStream.schema(df.schema).parquet(str(tmp_path / "in" / "*")), "kept"), str(tmp_path / "out"), str(tmp_path / "state"))
        for _ in range(100):
            if len(listener.reports) >= 2:
                break
            time.sleep(0.1)
    finally:
        spark.streams.removeListener(listener)
    got = {r["metric"]: r["n"] for r in health.observed_counts(spark, listener).collect()}
    assert (got["total_seen"], got["kept_count"], got["empty"], got["adult_spam"]) == (4, 2, 2, 0)


@pytest.mark.parametrize(("dims", "eps", "cell"), [(2, 0.3, 40), (6, 1.2, 60)])
def test_metric_cells_hold_every_neighbour(spark, dims, eps, cell):
    rng = np.random.default_rng(dims)
    points = np.concatenate([rng.uniform(0, 12, (500, dims)), rng.normal(5, 0.4, (200, dims))])
    rows = spark.createDataFrame([(0, i, v.tolist()) for i, v in enumerate(points)], "g int, k long, v array<double>")
    cells = clustering.metric_cells(rows, eps, cell, pivots=8).collect()
    own = {r["k"]: r["cell"] for r in cells if r["own"]}
    assert len(own) == 700 == sum(r["own"] for r in cells)
    held = {(r["cell"], r["k"]) for r in cells}
    assert len(held) == len(cells)
    near = clustering.close_to(points, points, eps)
    assert all((own[i], j) in held for i, j in zip(*np.nonzero(near), strict=True))
    if dims == 2:
        assert len(set(own.values())) > 12


def test_copies_do_not_grow_with_cells(spark):
    rng = np.random.default_rng(3)
    shares = []
    for n in (1000, 4000):  # as dense, four times the room
        side = (n / 1000) ** 0.5 * 10
        rows = spark.createDataFrame([(0, i, v.tolist()) for i, v in enumerate(rng.uniform(0, side, (n, 2)))], "g int, k long, v array<double>")
        shares.append(clustering.metric_cells(rows, 0.2, 100, pivots=8).count() / n)
    assert max(shares) < 2 and shares[1] < 1.4 * shares[0]


def test_density_clusters_of_hot_points(spark):
    rng = np.random.default_rng(8)
    points = np.round(np.concatenate([np.zeros((300, 2)), rng.normal(0, 3, (300, 2)), rng.uniform(-9, 9, (150, 2))]), 1)
    df = spark.createDataFrame([(7, int(i), v.tolist()) for i, v in enumerate(points)], "g int, k long, v array<double>")
    wanted = clustering.density_labels(points, 0.35, 4)
    for cell in (25, 4000):
        got = {r["k"]: r["cluster_id"] for r in clustering.block_clusters(df, "g", "k", "v", 0.35, 4, cell).collect()}
        assert [got[i] for i in range(len(points))] == wanted.tolist()
    assert len(set(wanted.tolist())) > 4


def test_overdue_ticks_come_in_order_evaluation_first():
    s = lifecycle.Settings(eval_step=300, base_step=3600)
    got = list(ticks.due(1300, 4600, 4900, s))
    assert got == [(ticks.EVAL, at) for at in range(1300, 4601, 300)] + [(ticks.BASE, 4600), (ticks.EVAL, 4900)]
    assert list(ticks.due(10, 5, 9, s)) == [(ticks.BASE, 5)] and list(ticks.due(10, 11, 9, s)) == []


def test_clock_of_a_channel_makes_up_for_a_pause():
    s = lifecycle.Settings(ttl=600, eval_step=100, base_step=200, min_history=2, min_count=5, leave=2.5)
    own, now = ticks.Clocked(), 1007
    assert own.run("ai", now, s) == [] and own.next == [1107, 1207]
    rng, told = random.Random(3), []
    while now < 9000:
        step = rng.choice([10, 50, 90, 700])
        burst = 5000 < now < 5600
        own.take([now + k for k in range(step) for _ in range(rng.randrange(0, 2) + 6 * burst)])
        now += step
        # what is kept between calls is JSON
        own = ticks.Clocked(json.loads(json.dumps(own.kept())))
        told += own.run("ai", now, s)
        assert min(own.next) > now and all(sec > min(own.next) - 600 for sec in own.seconds)
    kinds = [e["event_type"] for e in told]
    assert kinds[0] == "start" and "update" in kinds and all(e["tick"] % 100 == 7 for e in told)
    assert [e["tick"] for e in told] == sorted(e["tick"] for e in told)


def test_stream_by_the_wall_clock(spark, tmp_path):
    import time

    s = lifecycle.Settings(ttl=7200, eval_step=1, base_step=2, min_history=2, min_count=1, enter=1.0)
    schema = "channel string, ts timestamp"

    def add(name, n):
        now = time.time() - 1
        spark.createDataFrame([("ai", now)] * n, "channel string, at double").selectExpr("channel", "timestamp_seconds(at) AS ts").coalesce(1).write.parquet(str(tmp_path / "in" / name))

    add("a", 3)
    events = ticks.detect_by_clock(spark.readStream.schema(schema).parquet(str(tmp_path / "in" / "*")), s)
    with tracking.rocksdb(spark):
        query = events.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "state")).trigger(processingTime="1 second").start()
    try:
        began, added, rows = time.time(), 0, []
        while time.time() - began < 60 and not rows:
            time.sleep(4)
            added += 1
            add(f"b{added}", 50 * added)
            if (tmp_path / "out" / "_spark_metadata").exists():
                rows = spark.read.schema(events.schema).parquet(str(tmp_path / "out")).collect()
        assert query.exception() is None
    finally:
        query.stop()
    # a count that only grows passes its baseline
    assert rows and rows[0]["event_type"] == "start" and rows[0]["channel"] == "ai"


def test_arrival_clock_is_a_running_maximum(spark):
    rng = random.Random(5)
    secs = [i * 10 + rng.randrange(-300, 300) for i in range(1000)]
    df = spark.createDataFrame([(i, "a", sec) for i, sec in enumerate(secs)], "nth long, channel string, sec long").repartition(7)
    for width in (37, 100_000):
        got = {r["nth"]: r["clock"] for r in detection.arrival_clock(df, "nth", width).collect()}
        assert got == {i: max(secs[: i + 1]) for i in range(1000)}
    assert detection.arrival_clock(df.limit(0), "nth").count() == 0
