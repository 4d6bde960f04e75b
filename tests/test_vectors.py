import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidewatch.operators import clustering, embedding, projection


def topics(n=240, seed=2):
    """Texts on six topics: words of their own, and common ones."""
    rng = random.Random(seed)
    own = [[f"t{chr(97 + k)}{chr(97 + i)}word" for i in range(20)] for k in range(6)]
    common = [f"common{chr(97 + i)}" for i in range(20)]
    return [(i, i % 6, " ".join(rng.choice(own[i % 6] if rng.random() < 0.35 else common) for _ in range(25))) for i in range(n)]


def agreement(vectors, labels):
    places, _ = projection.nearest(vectors, 5)
    return float(np.mean(labels[places] == labels[:, None]))


def test_main_axes_are_those_of_the_whole_matrix(spark):
    rng = np.random.default_rng(1)
    n = 90
    base = rng.normal(size=(n, 5)) * np.array([9, 7, 5, 3, 2])
    dense = base @ base.T * (rng.random((n, n)) < 0.5)
    dense = np.triu(dense) + np.triu(dense, 1).T
    i, j = np.nonzero(dense)
    df = spark.createDataFrame([(int(a), int(b), float(dense[a, b])) for a, b in zip(i, j, strict=True)], "i long, j long, x double")
    vectors, weights = embedding.main_axes(df, 3, 8, 6, block=25)
    values = np.linalg.eigvalsh(dense)
    wanted = np.sort(np.abs(values))[::-1][:3]
    assert np.allclose(weights, wanted, rtol=2e-3)
    got = np.stack([r["v"] for r in vectors.orderBy("i").collect()])
    u, s, v = np.linalg.svd(dense)
    # the same space
    assert np.allclose(np.abs(np.linalg.svd(u[:, :3].T @ (got / np.sqrt(weights)))[1]), 1, atol=5e-2)


def test_product_by_blocks(spark):
    rng = np.random.default_rng(4)
    dense, right = rng.normal(size=(23, 23)) * (rng.random((23, 23)) < 0.3), rng.normal(size=(23, 4))
    i, j = np.nonzero(dense)
    df = spark.createDataFrame([(int(a), int(b), float(dense[a, b])) for a, b in zip(i, j, strict=True)], "i long, j long, x double")
    factor = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(right)], "i long, v array<double>")
    for block in (5, 100):
        got = {r["i"]: r["v"] for r in embedding.times(df, factor, 4, block).collect()}
        assert np.allclose(np.stack([got.get(k, np.zeros(4)) for k in range(23)]), dense @ right)


def test_word_pairs(spark):
    df = spark.createDataFrame([(1, "alpha beta gamma alpha"), (2, "beta alpha the delta"), (3, "alpha beta"), (4, None), (5, "")], "id long, text string")
    words, pairs = embedding.word_pairs(df, "id", F.col("text"), 2, 2)
    token = {r["i"]: r["token"] for r in words.collect()}
    assert sorted(token.values()) == ["alpha", "beta"] and sorted(token) == [0, 1]
    assert {(token[r["i"]], token[r["j"]]): r["n"] for r in pairs.collect()} == {("alpha", "beta"): 4, ("beta", "alpha"): 4, ("alpha", "alpha"): 2}


def test_learned_vectors_know_topics_better_than_hashed_ones(spark):
    rows = topics()
    df = spark.createDataFrame(rows, "id long, topic long, text string")
    labels = np.array([t for _, t, _ in rows])
    vectors = embedding.word_vectors(df, "id", F.col("text"), 16)
    learned = np.stack([r["embedding"] for r in embedding.text_vectors(df, "id", F.col("text"), vectors, 16).orderBy("id").collect()])
    hashed = np.stack([r["v"] for r in df.select("id", clustering.hashed_embedding(F.col("text"), 16).alias("v")).orderBy("id").collect()])
    assert np.allclose(np.linalg.norm(learned, axis=1), 1)
    assert agreement(learned, labels) > 0.95 > agreement(hashed, labels)
    unknown = embedding.text_vectors(spark.createDataFrame([(1, None), (2, "zzz")], "id long, text string"), "id", F.col("text"), vectors, 16).collect()
    assert len(unknown) == 2 and all(r["embedding"] == [0.0] * 16 for r in unknown)


def test_projection_keeps_neighbourhoods(spark):
    rng = np.random.default_rng(0)
    centres, labels = rng.normal(0, 1, (9, 30)), rng.integers(0, 9, 300)
    points = centres[labels] + rng.normal(0, 0.6, (300, 30))
    laid = projection.project(points)
    plain = points - points.mean(axis=0)
    axes = plain @ np.linalg.svd(plain, full_matrices=False)[2][:2].T
    assert projection.trustworthiness(points, laid) > projection.trustworthiness(points, axes) + 0.03
    assert np.array_equal(laid, projection.project(points))
    found = clustering.density_labels(laid, 0.5, 5)
    assert max(np.mean([np.bincount(labels[found == k]).max() / (found == k).sum() for k in set(found.tolist()) - {-1}]), 0) > 0.9
    df = spark.createDataFrame([(g, int(i), p.tolist()) for g in (0, 1) for i, p in enumerate(points[: 300 if g == 0 else 3])], "g long, k long, v array<double>")
    got = [sorted(map(str, projection.projected(df.repartition(n, "k"), ["g"], "k", "v").collect())) for n in (2, 5)]
    assert got[0] == got[1] and len(got[0]) == 303


def test_projection_edges():
    same = projection.project(np.ones((30, 4)))
    assert same.shape == (30, 2) and np.isfinite(same).all()
    assert projection.project(np.ones((1, 4))).shape == (1, 2) and projection.project(np.ones((2, 1))).shape == (2, 2)
    assert projection.trustworthiness(np.arange(40.0)[:, None], np.arange(40.0)[:, None], 5) == pytest.approx(1.0)
