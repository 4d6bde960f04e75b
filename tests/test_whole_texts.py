"""Queries over hand-made tables whose rows a narrower reading would lose."""

import os
import re
from collections import Counter

import pytest

from tidewatch.functions.stem import stem
from tidewatch.functions.vocabulary import STOPWORDS
from tidewatch.plans import event_queries, text_queries

DOCUMENTS = [
    (1, "Les élèves regardent maison maison, forêt; été_bleu bleu2 GARÇON", "fr", "src1.example"),
    (2, "maison blanche à côté", "fr", "src2.example"),
    (3, "Der Fuß läuft schnell schnell über Straßen", "de", "src1.example"),
    (4, "plain running letters only running", "en", "src3.example"),
    (5, None, "en", "src4.example"),
]


def brute_tokens(text):
    return [w for w in re.findall(r"\b[a-z]{3,}\b", (text or "").lower()) if w not in STOPWORDS]


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("tables"))
    spark.createDataFrame(DOCUMENTS, "doc_id long, text string, lang string, source string").write.parquet(f"{folder}/documents.parquet")
    return folder


def test_tokens_of_texts_beyond_ascii(spark, tables):
    own = [(d, lang, source, w) for d, text, lang, source in DOCUMENTS for w in brute_tokens(text)]
    by_language = Counter((lang, w) for _, lang, _, w in own)
    assert by_language["fr", "maison"] == 3 and by_language["de", "schnell"] == 2
    assert {(r["lang"], r["token"]): r["n"] for r in text_queries.token_counts_topk(spark, tables).collect()} == by_language
    keywords = {(r["lang"], r["token"]) for r in text_queries.ctfidf_keywords(spark, tables).collect()}
    assert {("fr", "maison"), ("fr", "blanche"), ("de", "schnell")} <= keywords
    calls = Counter((int(source[3]), w) for _, _, source, w in own)
    assert {(r["call_id"], r["token"]): r["n"] for r in text_queries.ctfidf_baseline_penalty(spark, tables).collect()} == calls
    stems = Counter(stem(w) for _, w in sorted({(d, w) for d, _, _, w in own}))
    assert {r["stem"]: r["n"] for r in text_queries.stem_keywords(spark, tables).collect()} == stems


def test_recurring_threads_anywhere_in_a_title(spark, tmp_path):
    titles = ["Ask HN: Who Is Hiring? (May 2024)", "Ask HN: Who wants to be hired? (May 2024)", "who wants to be hired", "Ask: what are you working on", "The long prelude of a title, then: WHO IS HIRING", "who was hiring", "", None]
    rows = [(i, t, "en", "src1") for i, t in enumerate(titles)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r["doc_id"]: (r["recurs"], r["plain"]) for r in text_queries.recurring_thread_flag(spark, str(tmp_path)).collect()}
    assert got == {i: (True, i < 5) for i in range(len(titles))}


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.001"), reason="needs the driver's tables")
def test_every_recurring_tag_is_promoted(spark):
    totals = {r["tag"]: r["total"] for r in event_queries.tag_counts(spark, "/root/testdata/sf0.001").collect()}
    got = [r["tag"] for r in event_queries.tag_promotion(spark, "/root/testdata/sf0.001").collect()]
    assert len(got) > 20 and sorted(got) == sorted(t for t, n in totals.items() if n >= 5)


def test_stories_of_every_role(spark, tmp_path):
    talk = [(c, t, role, f"{role} text {c}") for c in (1, 2, 3) for t, role in enumerate(("system", "user", "assistant", "user"))]
    spark.createDataFrame(talk, "conv_id long, turn long, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    got = {r["cluster"]: (r["size"], r["top_story_id"], r["story_ids"]) for r in text_queries.story_attribution(spark, str(tmp_path)).collect()}
    assert got == {"system": (3, 1, "1,2,3"), "assistant": (3, 1, "1,2,3"), "user": (6, 1, "1,2,3")}
