import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from tidewatch.operators import hashtags
from tidewatch.sources import tables


def test_changes_are_versions(spark, tmp_path):
    path = str(tmp_path / "t")
    rows = lambda df: sorted(map(tuple, df.collect()), key=repr)
    tables.create(spark.createDataFrame([(1, "a"), (2, "b"), (3, None)], "id long, v string"), path)
    got = tables.change(spark, path, lambda t: tables.updated(t, F.col("v") == "a", v=F.lit("z")))
    assert rows(got) == [(1, "z"), (2, "b"), (3, None)]
    got = tables.change(spark, path, lambda t: tables.deleted(t, F.col("v") == "b"))
    assert rows(got) == [(1, "z"), (3, None)] and tables.versions(spark, path) == [2, 3]
    got = tables.change(spark, path, lambda t: tables.upserted(t, spark.createDataFrame([(3, "c", 9), (4, "d", 8)], "id long, v string, w long"), "id"))
    assert rows(got.select("id", "v", "w")) == [(1, "z", None), (3, "c", 9), (4, "d", 8)]
    got = tables.change(spark, path, lambda t: tables.with_column(tables.with_column(t, "w", "long"), "x", "string", F.upper("v")), by=("v",))
    assert rows(got.select("id", "w", "x")) == [(1, None, "Z"), (3, 9, "C"), (4, 8, "D")]

    def fails(t):
        return t.select(F.raise_error(F.lit("no")).alias("id"))

    before = rows(tables.table(spark, path).select("id"))
    with pytest.raises(Exception, match="no"):
        tables.change(spark, path, fails)
    assert rows(tables.table(spark, path).select("id")) == before
    assert rows(tables.change(spark, path, lambda t: t.select("id"))) == [(i,) for (i,) in before]


def test_bounds_hold_beyond_the_counters(spark):
    rng = random.Random(2)
    tags = [f"t{int(rng.paretovariate(0.6)) % 3000}" for _ in range(8000)]
    true = Counter(tags)
    df = spark.createDataFrame([(t,) for t in tags], "tag string").repartition(4)
    for capacity in (5, 40, 5000):
        got = {r["tag"]: (r["at_least"], r["at_most"]) for r in hashtags.heavy_tags(df, capacity).collect()}
        assert all(low <= true[t] <= high and high - low <= len(tags) / (capacity + 1) for t, (low, high) in got.items())
        assert {t for t, n in true.items() if n > len(tags) / (capacity + 1)} <= set(got)
        assert len(got) <= 4 * 2 * capacity
    assert got == {t: (n, n) for t, n in true.items()}
    assert hashtags.heavy_tags(df.limit(0)).count() == 0
