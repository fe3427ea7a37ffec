"""The registered training-data queries and the pipeline."""

import pytest
from oracle_check import compare, duck
from pyspark.sql import functions as F

import corpus_pipeline
from __spark_entry__ import oracle_sql, queries
from metrospect.llm import queries as llm


@pytest.mark.parametrize("name", list(llm.REGISTRY))
def test_queries_match_their_sql(spark, sf_dir, name):
    verdict = compare(spark, duck(sf_dir), sf_dir, name, llm.ORACLE.get(name))
    assert verdict.startswith(("ok", "rows only")), verdict


def test_all_are_registered():
    assert {*llm.REGISTRY, "pipeline"} <= set(queries()) and set(llm.ORACLE) <= set(oracle_sql())
    assert sorted(int(n[2:].split("_")[0]) for n in llm.REGISTRY) == list(range(1, 14))


def test_pipeline_stages(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    odd = docs.limit(1).select(
        F.lit(None).cast("long").alias("doc_id"), F.lit(None).cast("string").alias("text"), "lang", F.lit(None).cast("string").alias("source"), "n_chars")
    rows = docs.unionByName(docs.limit(3)).unionByName(odd)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        rows = stage(spark, rows, sf_dir)
        assert rows.columns == docs.columns, name
        rows = spark.createDataFrame(rows.collect(), docs.schema)
        assert rows.count() > 0
    last = corpus_pipeline.STAGES[-1][1](spark, rows, sf_dir)
    assert last.count() == rows.count()


def test_pipeline_of_no_rows(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, sf_dir).count() == 0
