import math

import pytest
from pyspark.sql import functions as F

from metrospect import constants as K
from metrospect.operators import evaluation, runs


def sample_rows(spark, rows):
    """(task, generation, scale) rows whose metrics are multiples of the scale."""
    data = [(t, g, *[float(s * (i + 1)) for i in range(7)]) if s is not None else (t, g, *[None] * 7)
            for t, g, s in rows]
    schema = "task_id string, generation_id long, " + ", ".join(f"{m} double" for m in K.METRICS)
    return spark.createDataFrame(data, schema)


def test_generation_ids_only_advance_on_missing_rows(spark):
    df = spark.createDataFrame(
        [("t", None, 0), ("t", 7, 1), ("t", None, 2), ("u", None, 3), ("t", None, 4)],
        "task_id string, generation_id int, seq long",
    )
    got = {r["seq"]: r["generation_id"] for r in evaluation.rebuild_generation_ids(df).collect()}
    assert got == {0: 0, 1: 7, 2: 1, 3: 0, 4: 2}
    assert evaluation.repeated_generations(evaluation.rebuild_generation_ids(df)).count() == 0
    twice = df.withColumn("generation_id", F.lit(1).cast("int"))
    assert evaluation.repeated_generations(twice).first()["n_rows"] == 4


def test_verdicts_join_by_task_and_generation(spark):
    samples = spark.createDataFrame([("a", 0), ("a", 1), ("b", 0)], "task_id string, generation_id long")
    verdicts = spark.createDataFrame(
        [("a", 0, False), ("a", 1, True)], "task_id string, generation_id long, passed boolean"
    )
    got = {(r[0], r[1]): r["passed"] for r in evaluation.with_verdicts(samples, verdicts).collect()}
    assert got == {("a", 0): False, ("a", 1): True, ("b", 0): None}


def test_quality_summary_keeps_the_group_without_verdict(spark):
    df = sample_rows(spark, [("a", 0, 1), ("a", 1, 3), ("b", 0, 5), ("b", 1, 8), ("c", 0, None)])
    passed = F.when(F.col("task_id") == "a", True).when(F.col("generation_id") == 1, False)
    rows = evaluation.quality_summary(df.withColumn("passed", passed)).collect()
    cc = {r["passed"]: r for r in rows if r["metric"] == "cc"}
    assert cc[True]["mean"] == 2 and cc[True]["std"] == pytest.approx(math.sqrt(2))
    assert cc[False]["count"] == 1 and cc[False]["std"] is None
    assert cc[None]["count"] == 1 and cc[None]["median"] == 5
    whole = {r["metric"]: r for r in evaluation.quality_summary_all(df).collect()}
    assert whole["mi"]["median"] == 8 and whole["mi"]["count"] == 4


@pytest.mark.parametrize("n,c,k", [(5, 0, 1), (5, 2, 1), (5, 2, 5), (10, 3, 5), (5, 5, 3), (3, 1, 5)])
def test_pass_at_k(spark, n, c, k):
    df = spark.createDataFrame([(n, c)], "total long, passed long")
    got = df.select(evaluation.pass_at(k, F.col("total"), F.col("passed")).alias("p")).first()["p"]
    if n < k:
        assert got is None
    else:
        assert got == pytest.approx(1 - math.comb(n - c, k) / math.comb(n, k))


def test_pass_at_k_needs_enough_samples_everywhere(spark):
    totals = spark.createDataFrame([("a", 5, 2), ("b", 3, 3)], "task_id string, total long, passed long")
    got = {r["k"]: r for r in evaluation.pass_at_k(totals, [1, 5]).collect()}
    assert got[1]["pass_at_k"] == pytest.approx((0.4 + 1) / 2)
    assert got[5]["pass_at_k"] is None and got[5]["n_short"] == 1


def test_deltas(spark):
    base = sample_rows(spark, [("a", 0, 1), ("a", 1, 3), ("b", 0, 0), ("c", 0, 4), ("d", 0, None)])
    steered = sample_rows(spark, [("a", 0, 3), ("b", 0, 2), ("c", 0, 3), ("d", 0, 1), ("e", 0, 1)])
    row = {r["metric"]: r for r in evaluation.metric_deltas(base, steered).collect()}["cc"]
    assert row["n"] == 3
    assert row["mean_pct_delta"] == pytest.approx((50 - 25) / 2)
    assert row["median_pct_delta"] == pytest.approx(12.5)
    assert row["mean_delta_over_base_mean_pct"] == pytest.approx(100 * (1 + 2 - 1) / 3 / 2)
    assert row["median_delta_over_base_mean_pct"] == pytest.approx(100 * 1 / 2)
    same = evaluation.metric_deltas(base, base).collect()
    assert all(r["mean_pct_delta"] == 0 and r["std_pct_delta"] == 0 for r in same)
    nothing = evaluation.metric_deltas(base.where("false"), steered)
    assert nothing.count() == 0


def test_rollup_and_totals(spark):
    df = spark.createDataFrame(
        [("a", i, s) for i, s in enumerate(["fail", "PASS", "Syntax Error"])] + [("b", 0, "timeout")],
        "task_id string, generation_id long, status string",
    )
    totals = {r["task_id"]: (r["passed"], r["total"]) for r in evaluation.task_totals(df).collect()}
    assert totals == {"a": (1, 3), "b": (0, 1)}
    row = evaluation.run_totals(df).first()
    assert (row["num_total"], row["num_correct"], row["num_invalid"]) == (2, 1, 1)
    chunks = {(r["task_id"], r["part"]): r["statuses"]
              for r in evaluation.task_statuses(df, chunk=2).collect()}
    assert chunks == {("a", 0): ["fail", "PASS"], ("a", 1): ["Syntax Error"], ("b", 0): ["timeout"]}


def test_summary_upsert_replaces_and_adds(spark):
    schema = "section string, key string, field string, value double"
    old = spark.createDataFrame([("s", "a", "f", 1.0), ("s", "b", "f", 2.0)], schema)
    new = spark.createDataFrame([("s", "b", "f", None), ("t", "a", "f", 9.0)], schema)
    got = {(r["section"], r["key"]): r["value"] for r in evaluation.upsert_summary(old, new).collect()}
    assert got == {("s", "a"): 1.0, ("s", "b"): None, ("t", "a"): 9.0}


def test_sweeps_and_replicas(spark):
    configs = spark.createDataFrame(
        [("base", "m", None, None, None), ("mi", "m", "mi", 30, [-0.75, 1.0]), ("none", "m", "mi", 3, [])],
        "name string, model string, metric string, layer int, alpha_sweep array<double>",
    )
    got = {r["name"]: r["steering"] for r in runs.expand_sweeps(configs).collect()}
    assert set(got) == {"base", "mi_a-0.75", "mi_a1"}
    assert got["base"] == [] and tuple(got["mi_a1"][0]) == ("mi", 30, 1.0)
    tasks = spark.createDataFrame([("x",), ("y",)], "task_id string")
    assert sorted(tuple(r) for r in runs.replicate(tasks, 2).collect()) == [
        ("x", 0), ("x", 1), ("y", 0), ("y", 1)]
    with pytest.raises(ValueError, match="no runs"):
        runs.runs_of_model(configs, "other")


def test_report(spark):
    found = spark.createDataFrame(
        [(1, "m", None, 0.0, 0.3, None, None), (1, "m", "mi", -1.0, 0.2, -5.0, 1.5),
         (1, "m", "cc", -1.0, 0.25, None, None), (1, "n", "mi", 2.0, 0.1, 1.0, 2.0)],
        "pass_k int, model string, metric string, alpha double, pass double, mean_delta double, "
        "std_delta double",
    )
    points = runs.fan_out_base(found, ["mi", "cc"])
    assert points.count() == 5
    checks = {r["model"]: (r["n_alphas"], r["agrees"])
              for r in runs.alpha_agreement(points, ["mi", "cc"]).collect()}
    assert checks == {"m": (2, True), "n": (1, False)}
    rows = {r["ordinal"]: r for r in runs.final_report(points, ["m", "n"], ["mi", "cc"]).collect()}
    assert rows[1]["m_mi"] == "  -5.0±  1.5 0.200"
    assert rows[1]["m_cc"] == K.MISSING_CELL and rows[2]["n_mi"] == K.MISSING_CELL
    assert rows[2]["m_cc"] == "  +0.0±  0.0 0.300"
    legend = {r["ordinal"]: (r["m"], r["n"]) for r in runs.alpha_legend(points, ["m", "n"]).collect()}
    assert legend == {1: ("-1", "2"), 2: ("0", None)}
