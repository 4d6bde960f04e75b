"""Cases that only show at size: hubs, large clusters, colliding hashes, many partitions."""

import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from test_corpus import brute_near, rows_of
from tidewatch.llm import components, line_dedup, near_dedup
from tidewatch.llm.common import told_back


def test_hub_components(spark):
    pairs = [(500, i) for i in range(300)] + [(1000 + i, 2000) for i in range(200)] + [(299, 1000)] + [(3000, 3001), (None, 1), (5, None)]
    got = {r["node"]: r["root"] for r in components.connected(spark.createDataFrame(pairs, "a long, b long")).collect()}
    assert got == {n: 3000 if n >= 3000 else 0 for p in pairs for n in p if None not in p}


def test_totals_are_told_to_every_part(spark):
    df = spark.range(1000).select((F.col("id") % 3).alias("k"), F.col("id").alias("v")).unionByName(spark.createDataFrame([(None, 1), (9, 1), (9, None)], "k long, v long"))
    got = told_back(df, "k", ["v"], [F.count("*").alias("n"), F.min("v").alias("least")], "n > 1", 4).collect()
    assert len(got) == 1002 and {(r["k"], r["n"], r["least"]) for r in got} == {(0, 334, 0), (1, 333, 1), (2, 333, 2), (9, 2, 1)}


@pytest.mark.parametrize("cluster_texts", [60, 6])
def test_near_groups_of_large_clusters(spark, cluster_texts):
    rng = random.Random(9)
    family = [f"w{rng.randrange(3000)}" for _ in range(160)]
    passage = [f"p{k}" for k in range(40)]
    rows = []
    for i in range(120):  # copies that drift away from the first, so that links chain
        own = list(family)
        for k in range(i // 6):
            own[(k * 37) % 160] = f"edit{k}.{i // 30}"
        rows.append((i, " ".join(own)))
    for i in range(120, 200):  # texts that share a passage and little else
        rows.append((i, " ".join(passage + [f"x{rng.randrange(60)}" for _ in range(rng.randrange(2, 60))])))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = near_dedup.near_groups(df, cluster_texts).collect()
    assert {tuple(r)[:3] for r in got} == set(brute_near(rows_of(df)))


def test_windows_of_colliding_line_hashes_differ():
    half, other = b"a" * 8, b"z" * 8
    lines = [(half + b"1" * 8) * 3, (half + b"2" * 8) * 3, other * 6]
    batch = pa.RecordBatch.from_pydict({"doc_id": [1, 2, 3], "th": [1, 2, 3], "lines": lines, "words": [np.full(3, 20, "<i4").tobytes()] * 3})
    (out,) = line_dedup._winnow(50)(iter([batch]))
    rows = out.to_pylist()
    assert rows[0]["fingerprint"] == rows[1]["fingerprint"] != rows[2]["fingerprint"]
    assert len({w["content"] for r in rows for w in r["windows"]}) == 3
