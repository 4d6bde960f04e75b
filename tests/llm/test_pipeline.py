"""The pipeline's stages and what each must leave."""

from collections import Counter, defaultdict

import pytest

import corpus_pipeline
from tidewatch.llm import quality
from tidewatch.llm.queries import ORACLE_SQL, QUERIES

DATA = "/root/testdata/sf0.001"


def test_stages_in_order(spark, tmp_path):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    columns, before = docs.columns, docs.count()
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, DATA)
        out.write.parquet(str(tmp_path / name))
        out = spark.read.parquet(str(tmp_path / name))
        own = Counter(r["doc_id"] for r in out.select("doc_id").collect())
        was = Counter(r["doc_id"] for r in docs.select("doc_id").collect())
        assert set(own) <= set(was)
        if name == "quality_rules":
            judged = quality.judge_quality(docs, spark.read.parquet(f"{DATA}/labels.parquet"))
            assert own == Counter(r["doc_id"] for r in judged.where("kept").collect())
        if name in ("exact_dedup", "ngram_jaccard_join"):
            assert max(own.values()) == 1
        if name == "source_mixing":
            assert max(own.values()) <= 3
        if name == "best_fit_packing":
            assert set(own) == set(was)
        else:
            assert out.columns == columns
        docs = out
    assert 0 < docs.select("sequence_id").distinct().count() <= before


def test_run_packs_what_the_stages_left(spark):
    rows = corpus_pipeline.run(spark, DATA).collect()
    by = defaultdict(list)
    for r in rows:
        by[r["sequence_id"]].append((r["offset"], r["length"]))
    assert all(sum(n for _, n in own) <= 2048 for own in by.values()) and rows


@pytest.mark.parametrize("name", [n for n in QUERIES if n in ORACLE_SQL])
def test_queries_against_sql(spark, name):
    import duckdb

    con = duckdb.connect()
    for t in ("documents", "labels"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    wanted = con.sql(ORACLE_SQL[name])
    found = QUERIES[name](spark, DATA)
    assert sorted(found.columns) == sorted(wanted.columns)
    cells = lambda rows, names: sorted(tuple(str(r[names.index(c)]) for c in sorted(names)) for r in rows)
    assert cells([tuple(r) for r in found.collect()], found.columns) == cells(wanted.fetchall(), wanted.columns)
