"""Cases that an operator loses if it looks at a part of its input only."""

import random

import numpy as np
import pytest

from test_corpus import brute_runs, rows_of, words
from tidewatch.llm import licenses, line_dedup, toxicity


def test_license_text_with_every_template(spark):
    wordings = [wording for _, _, wording in licenses.TEMPLATES]
    long = "\n\nsome other words here\n\n".join(wordings)
    frequent = [f"{w} {k}" for k in range(20) for w in wordings[:2]] + [f"{w} {k}" for k in range(8) for w in wordings[4:7]]
    df = spark.createDataFrame(list(enumerate([long, " ".join(reversed(wordings)), *frequent])), "doc_id long, text string")
    got = {r["doc_id"]: (set(r["labels"].split(",")), r["score"]) for r in licenses.scan_licenses(df).collect()}
    every = {label for label, _, _ in licenses.TEMPLATES}
    for k in (0, 1):
        assert every <= got[k][0] and got[k][1] == 1.0


def test_runs_that_stand_at_any_earlier_place(spark):
    boilerplate, tail = " ".join(f"b{k}" for k in range(60)), "\n".join(f"last words {k}" for k in range(5))
    texts = [f"{boilerplate}\nrest", f"{boilerplate}\n{tail}", f"{boilerplate}\n{tail}", f"own start\n{boilerplate}\n{tail}\nown end"]
    df = spark.createDataFrame(list(enumerate(texts, 1)), "doc_id long, text string")
    got = {r["doc_id"]: (r["n_removed"], r["text"]) for r in line_dedup.drop_repeated_lines(df).collect()}
    assert got == {1: (0, texts[0]), 2: (1, tail), 3: (6, ""), 4: (6, "own start\nown end")}


def test_runs_of_random_lines(spark):
    rng = random.Random(3)
    lines = ["a", "b", "c d", "e f g", "h i j k l m", "n o"]
    rows = [(i, "\n".join(rng.choices(lines, weights=[4, 4, 3, 2, 1, 1], k=rng.randrange(1, 14)))) for i in range(150)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    gone = brute_runs(rows_of(df), 6)
    got = {r["doc_id"]: (r["n_removed"], (r["text"] or "").split("\n")) for r in line_dedup.drop_repeated_lines(df, 6).collect()}
    for i, t in rows:
        kept = [x for k, x in enumerate(t.split("\n")) if k not in gone[i, t]]
        assert got[i] == (len(gone[i, t]), kept or [""])
    assert all(words(t) for _, t in rows)


LONG_WORDS = ["x" * 46, "ab" * 23 + "c", "...(" + "_".join(f"part{k}" for k in range(40)) + ").", "漢字かな交じり文" * 30, "-" * 200, "a" * 45 + "____" + "b" * 60, "é\u00a0" * 50, "q." * 21 + ".." * 40 + "end"]


@pytest.mark.parametrize("text", LONG_WORDS)
def test_every_ngram_of_long_words_is_seen(text):
    own = toxicity.words_of(text.encode())
    assert all(len(w.decode()) <= toxicity.LONGEST_WORD for w in own)
    whole = text.encode().strip(toxicity._EDGE) or text.encode()
    for k in (3, 5):
        wanted = {whole.decode()[i : i + k] for i in range(len(whole.decode()) - k + 1)}
        pieces = [toxicity.bare_word(w).decode() for w in own]
        assert wanted == {p[i : i + k] for p in pieces for i in range(len(p) - k + 1)}
    seen = set(toxicity.grams_of(list(map(toxicity.bare_word, own)))[0].tolist())
    inner = toxicity.grams_of([whole])[0].tolist()
    assert set(inner) <= seen


def test_toxicity_behind_the_start_of_a_long_word():
    rng = random.Random(1)
    clean = [f"w{rng.randrange(10**4)}" for _ in range(80)]
    vile = ["grobvile", "vilethum", "snarkvil"]
    text = lambda toxic, by, n=60: by.join([rng.choice(clean) for _ in range(n)] + (rng.choices(vile, k=4) if toxic else []))
    rows = [(text(i % 2, " "), i % 2) for i in range(200)]
    model = toxicity.train([toxicity.words_of(t.encode()) for t, _ in rows], [y for _, y in rows], budget=1500)
    score = toxicity.Scorer(model)
    for by in ("_", "\u200b", "."):
        got = score.logits([toxicity.words_of(text(toxic, by).encode()) for toxic in (0, 1) for _ in range(30)])
        assert np.median(got[30:]) > np.max(got[:30])
    assert toxicity.words_of(b"Some, short words") == [b"some,", b"short", b"words"] and toxicity.words_of(None) == []


def test_words_of_few_documents_are_known_in_large_samples():
    documents = [[b"usual", b"words", b"rare%d" % (k // 4)] for k in range(1200)]
    known, grams = toxicity.vocabularies(documents)
    assert {b"usual", b"words", *(b"rare%d" % k for k in range(300))} == set(known)
    assert set(toxicity.grams_of([b"rare7"])[0].tolist()) <= set(grams.tolist())
