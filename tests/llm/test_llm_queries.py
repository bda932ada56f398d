"""Registered queries of the subpackage against their SQL, and the whole pipeline on a small table."""

import pytest

import corpus_pipeline
from compare import connect, differences
from fieldglass.llm import queries

DATA = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_matches_sql(spark, name):
    assert differences(queries.QUERIES[name](spark, DATA), connect(DATA), queries.SQL[name]) == []


def test_every_operator_has_a_query():
    assert sorted(int(n[2:].split("_")[0]) for n in queries.QUERIES) == list(range(1, 14))


def test_pipeline_keeps_columns_and_order(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    columns, before = docs.columns, docs.count()
    extra = docs.withColumn("kept", docs.doc_id).withColumn("n_words", docs.lang).withColumn("hit_spans", docs.lang)
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs, extra = stage(spark, docs, DATA).cache(), stage(spark, extra, DATA).cache()
        assert docs.columns == columns and docs.count() <= before and extra.count() == docs.count()
        before = docs.count()
    assert 0 < before < spark.read.parquet(f"{DATA}/documents.parquet").count()
    last = corpus_pipeline.STAGES[-1][1](spark, docs, DATA)
    assert last.count() == before
    result = corpus_pipeline.run(spark, DATA)
    assert sorted(map(tuple, result.collect())) == sorted(map(tuple, last.collect()))
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, extra.limit(0), DATA).count() == 0
