import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidewatch.llm import divergence as dv

COLUMNS = ["lang", "source", "part", "item", "value", "rank"]


def brute(rows, top=200):
    """Every group, every kept term, every pair, with Python's whole numbers."""
    words = defaultdict(Counter)
    held, groups = Counter(), set()
    for text, lang, source in rows:
        text, lang, source = text or "", lang or "", source or ""
        groups.add((lang, source))
        own = Counter(re.sub("[A-Z]+", lambda m: m[0].lower(), w) for w in re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", text))
        words[lang, source].update(own)
        held.update((lang, w) for w in own)
    out = []
    for lang in {g[0] for g in groups}:
        kept = [w for (x, w), n in held.items() if x == lang and n >= 3]
        sources = [s for x, s in groups if x == lang]
        share = {}
        for s in sources:
            total = sum(words[lang, s][w] for w in kept)
            share[s] = {w: 1 + 10**9 * (words[lang, s][w] + 1) // (total + len(kept)) for w in kept}
        both = Counter({w: sum(words[lang, s][w] for s in sources) for w in kept})
        q = {w: 1 + 10**9 * (both[w] + 1) // (sum(both.values()) + len(kept)) for w in kept}
        f = lambda a, b: (a - b) ** 2 // b
        for s in sources:
            pairs = [(sum(f(share[s][w], share[o][w]) for w in kept), o) for o in sources if o != s]
            terms = [(f(share[s][w], q[w]), w) for w in kept if words[lang, s][w] and share[s][w] > q[w]]
            for part, items in (("pair", pairs), ("term", terms)):
                ranked = sorted(items, key=lambda x: (-x[0], x[1].encode()))[: top if part == "term" else None]
                out += [(lang, s, part, item, value, i + 1) for i, (value, item) in enumerate(ranked)]
    return sorted(out)


def found(df):
    return sorted(tuple(r) for r in df.select(COLUMNS).collect())


def texts(docs):
    return [tuple(r) for r in docs.select("text", "lang", "source").collect()]


@pytest.mark.parametrize("more", [{}, {"heavy_share": 0.0, "tile_postings": 97, "block_groups": 2}, {"heavy_share": 9.0, "tile_postings": 200, "block_groups": 1}])
def test_awkward_corpus(corpus, more):
    # all heavy, all light, many tiles and blocks of one group give the same
    assert found(dv.source_divergence(corpus, **more)) == brute(texts(corpus))


def test_clashing_columns_and_empty_table(corpus, clashing, none):
    named = clashing.select("*", *[F.lit(1).alias(n) for n in ("term", "n", "p", "q", "value", "rank", "item", "tiles", "total")])
    assert found(dv.source_divergence(named, top_terms=5)) == brute(texts(corpus), 5)
    assert dv.source_divergence(none).collect() == []


def test_groups_without_terms_and_languages_without_kept_ones(spark):
    rows = [("x y", "a", "s"), ("x 12 _", "a", "t"), ("X", "a", None), (None, "a", "u"), ("one", "b", "s"), ("two", "b", "t"), ("", "c", "s"), ("É é É", "a", "s"), ("é", "a", "t"), ("é" * 40_000, "a", "v")]
    docs = spark.createDataFrame(rows, "text string, lang string, source string")
    got = found(dv.source_divergence(docs))
    assert got == brute(rows)
    assert [r for r in got if r[0] == "b"] == [("b", "s", "pair", "t", 0, 1), ("b", "t", "pair", "s", 0, 1)]


def test_sums_agree_in_either_way():
    rng = np.random.default_rng(3)
    p0, q0 = rng.integers(1, 10**9, 7), rng.integers(1, 10**9, 5)
    postings = lambda groups: map(np.array, zip(*sorted(((int(t), int(g)) for t in range(60) for g in range(groups) if rng.random() < 0.4)), strict=True))
    (t, g), (u, h) = postings(7), postings(5)
    p, x = rng.integers(1, 10**9, len(t)), rng.integers(1, 10**9, len(u))
    assert (dv.dense_sums(g, t, p, h, u, x, p0, q0) == dv.sparse_sums(g, t, p, h, u, x, p0, q0)).all()
