"""Round 4: learned vectors without large shuffles, layouts of whole groups."""

import numpy as np
from pyspark.sql import functions as F
from test_vectors import topics

from tidewatch.functions.text import STOPWORDS
from tidewatch.operators import clustering, embedding, projection


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_vectors_are_those_of_the_dense_matrix(spark, monkeypatch):
    monkeypatch.setattr(embedding, "LEAST_WORDS", 16)  # several strips and blocks
    monkeypatch.setattr(embedding, "STRIPS", 4)
    monkeypatch.setattr(embedding, "PAIRS_HELD", 500)
    rows = topics(60)
    lines = [[w for w in text.split() if w not in STOPWORDS] for _, _, text in rows]
    vocabulary = sorted({w for line in lines for w in line if sum(w in x for x in lines) >= 3})
    n = np.zeros((len(vocabulary), len(vocabulary)))
    for line in lines:
        line = [vocabulary.index(w) for w in line if w in vocabulary]
        for at, a in enumerate(line):
            for b in line[at + 1 : at + 6]:
                n[a, b] += 1
                n[b, a] += 1
    own = n.sum(axis=1)
    with np.errstate(divide="ignore"):
        x = np.maximum(np.log(n * n.sum() / np.outer(own, own)), 0)
    values, axes = np.linalg.eigh(x)
    best = np.argsort(-np.abs(values))[:4]
    wanted = (axes[:, best] * np.abs(values[best])) @ axes[:, best].T
    df = spark.createDataFrame(rows, "id long, topic long, text string").repartition(3)
    where, total = embedding.known_words(df, F.col("text"))
    block, strips = embedding.block_words(total)
    assert total == len(vocabulary) and strips > 2
    cells = embedding.pair_cells(df, F.col("text"), where, block, strips)
    sums = embedding._stored(embedding._sums(cells, block, "<i8"))
    weigh = embedding._information(sums, float(n.sum()), block)
    vectors, _ = embedding.axes_of(cells, sums, block, 4, len(vocabulary) - 4, 3, weigh=weigh)
    found = {r["i"]: r["v"] for r in vectors.collect()}
    got = np.array([found[i] for i in range(len(vocabulary))])
    assert np.allclose(got @ got.T, wanted, atol=1e-6)
    # the matrix stays where it lies
    assert "Exchange" not in plan(embedding.product(cells, sums, block, 1))


def test_no_words_of_texts_are_shuffled(spark):
    df = spark.createDataFrame([(1, "alpha beta beta the"), (2, None), (3, "gamma")], "id long, text string")
    vectors = spark.createDataFrame([("alpha", 5, [1.0, 0.0]), ("beta", 95, [0.0, 1.0])], "token string, n long, v array<double>")
    found = embedding.text_vectors(df, "id", F.col("text"), vectors, 2)
    assert "Exchange" not in plan(found)
    weight = np.array([1e-3 / (1e-3 + 0.05), 2e-3 / (1e-3 + 0.95)])
    got = {r["id"]: r["embedding"] for r in found.collect()}
    assert np.allclose(got[1], weight / np.linalg.norm(weight)) and got[2] == got[3] == [0.0, 0.0]


def test_blocks_of_a_whole_cell_meet_once(spark):
    rng = np.random.default_rng(5)
    points = np.repeat(rng.normal(size=(300, 6)), 2, axis=0)[:590]
    points[:250] *= 0.2
    given = spark.createDataFrame([(0, i, v.tolist()) for i, v in enumerate(points)], "g int, k long, v array<double>")
    wanted = clustering.density_labels(points, 0.7, 4)
    assert 1 < len(set(wanted.tolist())) and -1 in wanted
    got = {r["k"]: r["cluster_id"] for r in clustering.block_clusters(given, "g", "k", "v", 0.7, 4, 20).collect()}
    assert [got[i] for i in range(len(points))] == wanted.tolist()


def test_a_large_group_is_laid_out_whole(spark, monkeypatch):
    rng = np.random.default_rng(6)
    points = rng.normal(size=(330, 6)) + 4 * rng.normal(size=(5, 6))[rng.integers(0, 5, 330)]
    points[40] = points[7]  # a tie
    halves = [points[::2], points[1::2]]
    part, place, apart = projection.nearest_of_parts(halves[1], 1, enumerate(halves), 9)
    wanted, distances = projection.nearest(points, 9)
    assert (2 * place + part == wanted[1::2]).mean() > 0.99 and np.allclose(apart, distances[1::2], atol=1e-6)
    # every point takes part in the graph and is moved itself
    monkeypatch.setattr(projection, "start", None)
    seen = []
    stored = projection.checkpointed
    monkeypatch.setattr(projection, "checkpointed", lambda df: seen.append(stored(df)) or seen[-1])
    given = spark.createDataFrame([(None, f"k{i:03}", v.tolist()) for i, v in enumerate(points)], "g string, k string, v array<double>")
    laid = {r["k"]: r["projected"] for r in projection.projected(given, ["g"], "k", "v", most=120).collect()}
    graph = next(df for df in seen if "w" in df.columns).collect()
    assert len(graph) == 3 and sum(len(np.unique(np.frombuffer(r["i"], "<i4"))) for r in graph) == 330
    head, tail, weight = projection.edge_weights(*projection.nearest(points, 15))
    assert sum(len(r["w"]) // 8 for r in graph) == 2 * (weight >= 1 / 200).sum()
    assert np.isclose(sum(np.frombuffer(r["w"]).sum() for r in graph), 2 * weight[weight >= 1 / 200].sum(), rtol=1e-3)
    whole = np.array([laid[f"k{i:03}"] for i in range(330)])
    assert projection.trustworthiness(points, whole) > 0.9
