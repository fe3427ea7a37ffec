"""Every registered query against its check SQL on the smallest tables, and plan checks."""

import pytest
from oracle_check import compare, duck

from __spark_entry__ import entry, oracle_sql, queries
from metrospect.plans.oracle import statements
from metrospect.plans.queries import REGISTRY

SQL = statements()


@pytest.fixture(scope="module")
def con(sf_dir):
    return duck(sf_dir)


@pytest.mark.parametrize("name", list(REGISTRY))
def test_query_matches_its_check(spark, con, sf_dir, name):
    verdict = compare(spark, con, sf_dir, name, SQL.get(name))
    assert verdict.startswith(("ok", "rows only")), verdict


def test_entry_and_keys(spark):
    assert entry(spark).count() == 3
    assert set(REGISTRY) <= set(queries()) and set(oracle_sql()) <= set(queries())
    assert set(REGISTRY) - set(SQL) == {"pca_scores", "probe_sweep"}


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize(
    "name", ["curate_flagship", "drop_reason_counts", "exact_dedup", "generation_id_rebuild",
             "verdict_join", "zero_vector_filter", "overflow_batches", "sweep_expand"]
)
def test_no_cross_joins(spark, sf_dir, name):
    text = plan(queries()[name](spark, sf_dir))
    assert "CartesianProduct" not in text and "BroadcastNestedLoopJoin" not in text


def test_scan_reads_only_needed_columns(spark, sf_dir):
    text = plan(queries()["hash_split_share"](spark, sf_dir))
    assert "ReadSchema: struct<doc_id:bigint,text:string>" in text
    assert "lang" not in plan(queries()["exact_dedup"](spark, sf_dir))


def test_dedup_shuffles_collapsed_keys(spark, sf_dir):
    text = plan(queries()["drop_reason_counts"](spark, sf_dir))
    assert "partial_count" in text
