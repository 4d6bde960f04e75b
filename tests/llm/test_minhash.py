import random

import numpy as np
import pytest

from test_corpus import rows_of
from tidewatch.llm import minhash
from tidewatch.llm.shingles import WordHashes, shingle_set


def brute(rows, k=2):
    """(doc_id, size, component) of all pairs of sets of k words."""
    sets = []
    for _, text in rows:
        w = (text or "").encode().lower().split()
        sets.append({tuple(w[i : i + k]) for i in range(max(len(w) - k + 1, 1))} if w else set())
    root = list(range(len(rows)))
    top = lambda i: i if root[i] == i else top(root[i])
    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and 100 * both >= 80 * (len(sets[i]) + len(sets[j]) - both):
                root[top(i)] = top(j)
    least = {}
    for i, (doc, _) in enumerate(rows):
        least.setdefault(top(i), []).append(doc)
    smallest = {r: min((x for x in ids if x is not None), default=None) for r, ids in least.items()}
    return [(doc, len(sets[i]), smallest[top(i)] if sets[i] else doc) for i, (doc, _) in enumerate(rows)]


def found(df, **more):
    return sorted((tuple(r)[:3] for r in minhash.minhash_groups(df, **more).collect()), key=repr)


@pytest.mark.parametrize("more", [{}, {"cluster_texts": 8, "band_sets": 3}])
def test_awkward_corpus(corpus, more):
    assert found(corpus, **more) == sorted(brute(rows_of(corpus)), key=repr)


def test_edges(spark, clashing, none):
    got = minhash.minhash_groups(clashing).collect()
    assert len(got) == clashing.count() and all(r["kept"] == (r["doc_id"] == r["component_id"]) for r in got)
    assert minhash.minhash_groups(none).count() == 0
    rows = [(3, "One"), (1, "one"), (None, "ONE"), (7, "two  words"), (8, "Two\nwords"), (8, "Two\nwords"), (9, None), (10, None), (11, " \t"), (None, "lonely words here"), (12, "É é"), (13, "é é"), (14, "x" * 300_000), (15, "x " * 50_000)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted(((r["doc_id"], r["n_shingles"], r["component_id"], r["kept"]) for r in minhash.minhash_groups(df).collect()), key=repr)
    wanted = [(3, 1, 1, False), (1, 1, 1, True), (None, 1, 1, False), (7, 1, 7, True), (8, 1, 7, False), (8, 1, 7, False), (9, 0, 9, True), (10, 0, 10, True), (11, 0, 11, True), (None, 2, None, True), (12, 1, 12, True), (13, 1, 13, True), (14, 1, 14, True), (15, 1, 15, True)]
    assert got == sorted(wanted, key=repr)


@pytest.mark.parametrize("more", [{"cluster_texts": 60}, {"cluster_texts": 6, "band_sets": 20}])
def test_large_clusters(spark, more):
    rng = random.Random(9)
    family, passage = [f"w{rng.randrange(3000)}" for _ in range(160)], [f"p{k}" for k in range(40)]
    rows = []
    for i in range(120):  # copies that drift away from the first, so that links chain
        own = list(family)
        for k in range(i // 6):
            own[(k * 37) % 160] = f"edit{k}.{i // 30}"
        rows.append((i, " ".join(own)))
    for i in range(120, 200):  # texts that share a passage and little else
        rows.append((i, " ".join(passage + [f"x{rng.randrange(60)}" for _ in range(rng.randrange(2, 60))])))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert found(df, **more) == sorted(brute(rows_of(df)), key=repr)


def test_a_third_of_the_rows_is_one_text_and_a_third_near_copies(spark):
    rng = random.Random(2)
    own = [f"w{k}" for k in range(100)]
    rows = [(i, "hot text of five words") for i in range(400)]
    for i in range(400, 800):
        words = list(own)
        words[rng.randrange(100)] = f"e{rng.randrange(50)}"
        rows.append((i, " ".join(words)))
    rows += [(i, " ".join(f"v{rng.randrange(10**5)}" for _ in range(30))) for i in range(800, 1200)]
    got = minhash.minhash_groups(spark.createDataFrame(rows, "doc_id long, text string").repartition(9)).collect()
    assert {(r["component_id"] if r["doc_id"] < 800 else "own") for r in got} == {0, 400, "own"}
    assert all(r["component_id"] == r["doc_id"] for r in got if r["doc_id"] >= 800)


def test_minima_estimate_similarity():
    rng = np.random.default_rng(4)
    base = rng.integers(0, 1 << 63, 70_000, np.uint64)
    for size, shared in ((500, 444), (70_000, 62_222), (9, 8)):  # similarity 0.8
        a = np.unique(base[:size])
        b = np.unique(np.concatenate([base[:shared], rng.integers(0, 1 << 63, size - shared, np.uint64)]))
        low = minhash.minima([a, b, a])
        assert (low[0] == low[2]).all() and abs((low[0] == low[1]).mean() - 0.8) < 0.12
        assert (low == np.array([minhash.minima([s])[0] for s in (a, b, a)])).all()
        assert set(minhash.bands(low)[0]) & set(minhash.bands(low)[1])


def test_signatures_part_what_only_meets_by_chance():
    rng = np.random.default_rng(5)
    sketch = rng.integers(0, 256, (40, 160)).astype(np.uint8)
    sketch[7] = sketch[3]
    sketch[9] = sketch[3]
    sketch[9][:50] += 1
    assert minhash.agreeing(sketch, np.full(40, 10)) == [(3, 7), (3, 9)]
    assert minhash.agreeing(sketch, np.arange(1, 41) ** 3) == []


def test_shingles_of_two_words():
    assert len(shingle_set(b"a b a b a", WordHashes(), 2)) == 2 and len(shingle_set(b"A", WordHashes(), 2)) == 1
