"""Edge cases of operators whose own tests look elsewhere."""

from collections import Counter

from pyspark.sql import functions as F

from tidewatch.llm import sharding, token_counts, toxicity


def test_shards_are_written_one_folder_each(spark, corpus, tmp_path):
    path, limit = str(tmp_path / "shards"), 4000
    sharding.write_shards(corpus, path, limit)
    dealt = sharding.shard_documents(corpus, limit)
    folders = {p.name for p in (tmp_path / "shards").iterdir() if p.name.startswith("shard=")}
    assert folders == {f"shard={r['shard']}" for r in dealt.select("shard").distinct().collect()} and len(folders) > 3
    back = spark.read.schema("doc_id long, text string, shard string").parquet(path)
    count = lambda df: Counter(map(tuple, df.select("doc_id", "text").collect()))
    assert count(back) == count(corpus)
    sizes = back.groupBy("shard").agg(F.sum(F.coalesce(F.octet_length("text"), F.lit(0))).alias("n"), F.count_distinct("doc_id", "text").alias("rows")).collect()
    assert all(r["n"] <= limit or r["rows"] <= 1 for r in sizes)


def test_one_very_long_pre_token(spark):
    texts = ["x" * 200_000, "é" * 50_000, "ab " * 3]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: r for r in token_counts.count_tokens(df).collect()}
    assert len(got) == 3 and all(v is not None for r in got.values() for v in r)


def test_toxicity_of_rows_with_clashing_columns(clashing, labels):
    named = clashing.select("*", *[F.lit(1).alias(n) for n in ("score", "predicted", "held_out", "toxic")])
    model = toxicity.fit_toxicity(named, labels, budget=10)
    got = toxicity.score_toxicity(named, model)
    assert got.count() == clashing.count() and all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.5) for r in got.select("score", "predicted").collect())
