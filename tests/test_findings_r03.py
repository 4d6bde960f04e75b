"""What round 3's findings asked for."""

from __future__ import annotations

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tidewatch.functions.automaton import Automaton
from tidewatch.functions.vocabulary import NOT_PROSE
from tidewatch.llm import components
from tidewatch.operators import cleaning, embedding
from tidewatch.plans import text_queries
from tidewatch.sources import manifest


def test_a_task_joins_its_own_edges(spark, monkeypatch):
    plans = []
    plain = components.checkpointed
    monkeypatch.setattr(components, "checkpointed", lambda df: plans.append(1) or plain(df))
    chain = spark.range(0, 3000, 1, 1).select((F.col("id") * 7919 % 3001).alias("a"), ((F.col("id") + 1) * 7919 % 3001).alias("b"))
    got = {r["node"]: r["root"] for r in components.connected(chain).collect()}
    assert got == dict.fromkeys(range(3001), 0)
    # a chain in one task is a star at once, so no round leaves its plans with the driver
    assert len(plans) == 1
    # held in pieces, and dealt over tasks, the components are the same
    monkeypatch.setattr(components, "HELD_EDGES", 10)
    assert {r["node"]: r["root"] for r in components.connected(chain.repartition(3)).collect()} == got


def test_a_word_is_stemmed_once(spark, tmp_path):
    docs = [(1, "Running runs and runners"), (2, "runs runs running"), (None, "running"), (None, "running runs"), (3, None)]
    spark.createDataFrame([(i, t, "en", "src1") for i, t in docs], "doc_id long, text string, lang string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    found = text_queries.stem_keywords(spark, str(tmp_path))
    assert {r["stem"]: r["n"] for r in found.collect()} == {"run": 6, "runner": 1}
    # no document's words are gathered for Python
    assert "collect_set" not in found._jdf.queryExecution().optimizedPlan().toString()


def test_pairs_are_counted_in_the_task(monkeypatch):
    lines = [[3, 1, 3, 3], [], [2], [1, 3]]
    wanted: dict = {}
    for line in lines:
        for at, a in enumerate(line):
            for b in line[at + 1 : at + 3]:
                wanted[min(a, b), max(a, b)] = wanted.get((min(a, b), max(a, b)), 0) + 1
    for held in (1, 3, 100):
        monkeypatch.setattr(embedding, "PAIRS_HELD", held)
        got: dict = {}
        for batch in embedding.near_pairs(2)(iter([pa.RecordBatch.from_arrays([pa.array(lines, pa.list_(pa.int64()))], names=["line"])])):
            for r in batch.to_pylist():
                pair = (r["code"] >> 32, r["code"] & 0xFFFFFFFF)
                got[pair] = got.get(pair, 0) + r["n"]
        assert got == wanted


def test_no_task_holds_a_probed_file(spark, tmp_path):
    spark.range(6).repartition(3).write.parquet(f"{tmp_path}/in")
    names = [str(p) for p in sorted((tmp_path / "in").glob("*.parquet"))]
    (tmp_path / "in" / "cut.parquet").write_bytes(open(names[0], "rb").read()[:-20])
    assert {p: s for p, s, _ in manifest.probed(spark, [*names, f"{tmp_path}/in/cut.parquet"])} == dict.fromkeys(names, "read") | {f"{tmp_path}/in/cut.parquet": "corrupt"}
    kept = []
    found = manifest.scan_new(spark, f"{tmp_path}/in", f"{tmp_path}/manifest", lambda rows, run: kept.append(rows.count()))
    assert kept == [6] and not hasattr(manifest, "probe")
    assert {r["status"]: r["n"] for r in found.groupBy("status").agg(F.count("*").alias("n")).collect()} == {"read": 3, "corrupt": 1}
    # what is no file's fault is no corrupt file
    with pytest.raises(Exception, match="(?i)path_not_found|does not exist"):
        manifest.probed(spark, [f"{tmp_path}/in/gone.parquet"])


def _nodes(plan):
    yield plan
    below = plan.children()
    for i in range(below.size()):
        yield from _nodes(below.apply(i))


def _names(plan) -> set[str]:
    out = plan.output()
    return {out.apply(i).name() for i in range(out.size())}


def test_no_text_travels_for_the_run_report(spark, tmp_path):
    docs = [(i, t, "en", "src1") for i, t in enumerate(["the und und license", "Ω" * 41, "", None, "los los"])]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    found = text_queries.run_report(spark, str(tmp_path))
    plan = found._jdf.queryExecution().optimizedPlan()
    joins = [n for n in _nodes(plan) if n.nodeName() == "Join"]
    assert joins and not any({"text", "body"} & _names(side) for n in joins for side in list(_nodes(n))[1:2] + [n.children().apply(1)])
    # what is no prose is cut out once a text
    assert plan.toString().count(NOT_PROSE) == 1
    got = found.first()
    assert (got["total_seen"], got["kept_count"], got["dropped_by_reason"]) == (5, 2, "empty:2,language_mismatch:1")


def test_letters_beyond_latin_are_weighed_once(spark):
    latin, greek = "aé", "Ωж"
    texts = {latin * 30: False, greek * 21: True, greek * 20: False, latin * 15 + greek * 15: False, latin * 15 + greek * 15 + "ж": True, "“" + latin * 30 + "”": False, f"#{greek * 30} {latin * 30}": False, None: False, "": False, "1 2 ☃" * 30: False}
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, body string").select("i", cleaning.language_mismatch(F.col("body")).alias("m"))
    assert [r["m"] for r in rows.orderBy("i").collect()] == list(texts.values())
    assert rows._jdf.queryExecution().optimizedPlan().toString().count(NOT_PROSE) == 1


def test_the_large_class_of_marks_is_for_texts_with_marks():
    auto = Automaton(["caf", "le caf", "resume", "of the", "ok"])
    assert auto.find("Le caf\u0301 ok") == ["ok"] and set(auto.find("LE CAF ok")) == {"caf", "ok", "le caf"}
    assert auto.find("Of the résume") == ["of the"] and auto.find("of  the") == []
    calls = []

    class Watched:
        findall = split = search = staticmethod(lambda text: calls.append(text) or [])

    auto.word = auto.cut = Watched
    auto.find("le caf, été")
    assert calls == []


def test_words_are_counted_once(spark, tmp_path):
    docs = [(1, "apple apple pear", "en", "src1"), (2, "pear plum", "en", "src2"), (3, "apple 9 fig", None, "src1"), (4, None, "fr", "src1"), (5, "poire", "fr", "src3")]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    found = text_queries.ctfidf_keywords(spark, str(tmp_path))
    assert {(r["lang"], r["cluster_id"], r["token"]): (r["n"], r["df"], r["place"]) for r in found.collect()} == {("en", 1, "apple"): (2, 1, 1), ("en", 1, "pear"): (1, 2, 2), ("en", 2, "plum"): (1, 1, 1), ("en", 2, "pear"): (1, 2, 2), ("fr", 0, "poire"): (1, 1, 1)}
    usual = text_queries.ctfidf_baseline_penalty(spark, str(tmp_path))
    assert {(r["call_id"], r["token"]): (r["n"], r["base"]) for r in usual.where("call_id = 2").collect()} == {(2, "pear"): (1, 2), (2, "plum"): (1, 1)}
    for df in (found, usual):
        plan = df._jdf.queryExecution().optimizedPlan()
        assert not any(n.nodeName() == "Generate" for n in _nodes(plan))
