"""Evaluation of sample records: verdicts, quality summaries, pass@k, deltas, run summaries."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from metrospect import constants as K
from metrospect.functions.lexical import with_lexical_metrics
from metrospect.functions.text import status_invalid, status_passed
from metrospect.operators.ranking import quantiles, row_number_within
from metrospect.operators.selection import long_metrics
from metrospect.operators.stats import moments_long
from metrospect.session import staged
from metrospect.sources.records import DELTA_STRUCT

STATUS_CHUNK = 1000


def rebuild_generation_ids(
    samples: DataFrame, task: str = "task_id", generation: str = "generation_id", seq: str = "seq"
) -> DataFrame:
    """Number samples without a generation id 0, 1, .. per task in seq order; given ids stay."""
    missing = samples.where(F.col(generation).isNull()).drop(generation)
    numbered = row_number_within(missing, [task], seq, "_place")
    rebuilt = numbered.withColumn(generation, F.col("_place") - 1).drop("_place")
    given = samples.where(F.col(generation).isNotNull())
    return given.withColumn(generation, F.col(generation).cast("long")).unionByName(rebuilt)


def repeated_generations(samples: DataFrame) -> DataFrame:
    """(task_id, generation_id) pairs that occur more than once; empty for a sound sample table."""
    pairs = samples.groupBy("task_id", "generation_id").agg(F.count(F.lit(1)).alias("n_rows"))
    return pairs.where(F.col("n_rows") > 1)


def with_verdicts(samples: DataFrame, verdicts: DataFrame) -> DataFrame:
    """Left join of the verdict of each (task, generation); no verdict leaves passed NULL."""
    keys = ["task_id", "generation_id"]
    return samples.join(verdicts.select(*keys, "passed"), keys, "left")


def complete_metrics(samples: DataFrame, metrics: list[str] = K.METRICS) -> DataFrame:
    """Rows with every metric present; NaN counts as absent."""
    return samples.na.drop("any", subset=metrics)


def _quality(df: DataFrame, keys: list[str]) -> DataFrame:
    moments = moments_long(df, keys, K.METRICS).drop("min", "max")
    median = quantiles(long_metrics(df, keys), [*keys, "metric"], "value", {"median": 0.5})
    return moments.join(median, [*keys, "metric"], "left").withColumnRenamed("n", "count")


def quality_summary(samples: DataFrame) -> DataFrame:
    """count, mean, median and std of each metric per verdict; rows without a verdict form a group."""
    verdict = F.coalesce(F.col("passed").cast("string"), F.lit("none"))
    grouped = _quality(samples.withColumn("verdict", verdict), ["verdict"])
    passed = F.when(F.col("verdict") != "none", F.col("verdict").cast("boolean"))
    return grouped.withColumn("passed", passed).drop("verdict")


def quality_summary_all(samples: DataFrame) -> DataFrame:
    """The summary over all rows, for samples without any verdict."""
    return _quality(samples, [])


def summarize_quality(samples: DataFrame) -> DataFrame:
    """The summary per verdict if any row has one, else over all rows; `verdict` is true, false, none or all.

    The data choose the branch inside the one plan: whether there is a verdict is a scalar of it.
    """
    any_verdict = samples.agg(F.count("passed") > 0).scalar()
    own = F.coalesce(F.col("passed").cast("string"), F.lit("none"))
    return _quality(samples.withColumn("verdict", F.when(any_verdict, own).otherwise("all")), ["verdict"])


def samples_quality(samples: DataFrame, verdicts: DataFrame | None = None, seq: str = "seq") -> DataFrame:
    """Sample records to the quality table: (task_id, generation_id, passed, metrics, metrics_error).

    Missing generation ids are rebuilt in seq order, solutions are measured in the scan before narrow rows meet
    their verdicts; without verdicts passed is NULL.
    """
    lean = with_lexical_metrics(samples.select("task_id", "generation_id", seq, F.coalesce("solution", F.lit("")).alias("solution")), "solution")
    rows = rebuild_generation_ids(staged(lean.drop("solution"), "quality"), seq=seq)
    judged = rows.withColumn("passed", F.lit(None).cast("boolean")) if verdicts is None else with_verdicts(rows, verdicts)
    return judged.select("task_id", "generation_id", "passed", *K.METRICS, "metrics_error")


def status_counts(statuses: DataFrame) -> DataFrame:
    return statuses.groupBy("status").agg(F.count(F.lit(1)).alias("n_rows"))


def task_totals(statuses: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """Passed and total completions of each task, within the run columns named by `by`."""
    passed = F.count_if(status_passed("status"))
    return statuses.groupBy(*by, "task_id").agg(
        passed.alias("passed"), F.count(F.lit(1)).alias("total")
    )


def task_statuses(statuses: DataFrame, chunk: int = STATUS_CHUNK) -> DataFrame:
    """Statuses of each task in generation order, in chunks of `chunk` consecutive generations.

    A task of any size keeps all its statuses while no array grows beyond the chunk.
    """
    part = F.floor(F.col("generation_id") / chunk).alias("part")
    pairs = F.sort_array(F.collect_list(F.struct("generation_id", "status")))
    return statuses.groupBy("task_id", part).agg(
        F.transform(pairs, lambda p: p.getField("status")).alias("statuses")
    )


def run_totals(statuses: DataFrame) -> DataFrame:
    """Tasks, tasks with a pass and invalid completions of a run, from per-task counts."""
    tasks = statuses.groupBy("task_id").agg(
        F.count_if(status_passed("status")).alias("passed"),
        F.count_if(status_invalid("status")).alias("invalid"),
    )
    return tasks.agg(
        F.count(F.lit(1)).alias("num_total"),
        F.count_if(F.col("passed") > 0).alias("num_correct"),
        F.coalesce(F.sum("invalid"), F.lit(0)).alias("num_invalid"),
    )


def pass_at(k: int, total: Column, passed: Column) -> Column:
    """Unbiased pass@k of one task: 1 - C(n-c, k) / C(n, k), as a product of k factors.

    NULL for a task with fewer than k samples.
    """
    missed = F.aggregate(
        F.sequence(F.lit(0), F.lit(k - 1)),
        F.lit(1.0),
        lambda acc, j: acc * F.greatest(total - passed - j, F.lit(0)) / (total - j),
    )
    return F.when(total >= k, 1.0 - missed)


def pass_at_k(totals: DataFrame, ks: list[int], by: tuple[str, ...] = ()) -> DataFrame:
    """Mean pass@k over tasks per k; NULL when some task has fewer than k samples."""
    parts = [
        F.struct(
            F.lit(k).alias("k"), pass_at(k, F.col("total"), F.col("passed")).alias("score")
        )
        for k in ks
    ]
    scored = totals.select(*by, F.explode(F.array(*parts)).alias("p")).select(*by, "p.*")
    short = F.count_if(F.col("score").isNull())
    return scored.groupBy(*by, "k").agg(
        F.count(F.lit(1)).alias("n_tasks"),
        short.alias("n_short"),
        F.when(short == 0, F.avg("score")).alias("pass_at_k"),
    )


def task_means(samples: DataFrame, metrics: list[str] = K.METRICS) -> DataFrame:
    means = [F.avg(m).alias(m) for m in metrics]
    return complete_metrics(samples, metrics).groupBy("task_id").agg(*means)


def metric_deltas(
    base: DataFrame, steered: DataFrame, metrics: list[str] = K.METRICS,
    by: tuple[str, ...] = (), steered_by: tuple[str, ...] = (), medians: bool = True,
) -> DataFrame:
    """Change of each metric between two runs, over tasks that both have.

    by names run columns of both sides, steered_by more run columns of the steered side, so that one
    job compares many runs. A task whose base mean is 0 has no percent change.
    """
    run = [*by, *steered_by]

    def means(side: DataFrame, keys: list[str], suffix: str) -> DataFrame:
        return complete_metrics(side, metrics).groupBy(*keys, "task_id").agg(
            *[F.avg(m).alias(f"{m}_{suffix}") for m in metrics]
        )

    both = means(steered, run, "steered").join(means(base, [*by], "base"), [*by, "task_id"])
    cells = F.array(
        *[
            F.struct(
                F.lit(m).alias("metric"), F.col(f"{m}_base").alias("base"),
                (F.col(f"{m}_steered") - F.col(f"{m}_base")).alias("delta"),
            )
            for m in metrics
        ]
    )
    share = F.try_divide(F.col("delta"), F.abs(F.col("base"))) * 100
    tasks = both.select(*run, F.explode(cells).alias("c")).select(*run, "c.*")
    tasks = tasks.withColumn("pct", share)
    keys = [*run, "metric"]
    sums = tasks.groupBy(*keys).agg(
        F.avg("pct").alias("mean_pct_delta"),
        F.stddev_samp("pct").alias("std_pct_delta"),
        F.avg("base").alias("_base"),
        F.avg("delta").alias("_delta"),
        F.count("delta").alias("n"),
    )
    over = lambda c: F.try_divide(F.col(c), F.col("_base")) * 100
    if not medians:
        return sums.select(
            *keys, "mean_pct_delta", "std_pct_delta",
            over("_delta").alias("mean_delta_over_base_mean_pct"), "n",
        )
    either = tasks.unpivot(keys, ["pct", "delta"], "kind", "change")
    middle = quantiles(either, [*keys, "kind"], "change", {"median": 0.5})
    wide = middle.groupBy(*keys).agg(
        F.max(F.when(F.col("kind") == "pct", F.col("median"))).alias("median_pct_delta"),
        F.max(F.when(F.col("kind") == "delta", F.col("median"))).alias("_median_delta"),
    )
    return sums.join(wide, keys, "left").select(
        *keys, "mean_pct_delta", "median_pct_delta", "std_pct_delta",
        over("_delta").alias("mean_delta_over_base_mean_pct"),
        over("_median_delta").alias("median_delta_over_base_mean_pct"), "n",
    )


DELTA_FIELDS = [
    "mean_pct_delta", "median_pct_delta", "std_pct_delta", "mean_delta_over_base_mean_pct",
    "median_delta_over_base_mean_pct", "n",
]


def _section(df: DataFrame, section: str, key: Column, fields: list[str]) -> DataFrame:
    cells = F.array(
        *[F.struct(F.lit(f).alias("field"), F.col(f).cast("double").alias("value")) for f in fields]
    )
    return df.select(
        F.lit(section).alias("section"), key.cast("string").alias("key"), F.explode(cells).alias("c")
    ).select("section", "key", "c.field", "c.value")


def run_summary(statuses: DataFrame, ks: list[int], deltas: DataFrame | None = None) -> DataFrame:
    """Summary of a run as (section, key, field, value) rows.

    Long form, because a record with one entry per task would not fit one row of a large run.
    """
    totals = task_totals(statuses)
    parts = [
        _section(run_totals(statuses), "run", F.lit("run"),
                 ["num_total", "num_correct", "num_invalid"]),
        _section(pass_at_k(totals, ks), "pass_at_k", F.concat(F.lit("pass@"), F.col("k")),
                 ["pass_at_k"]),
        _section(status_counts(statuses), "status_counts", F.col("status"), ["n_rows"]),
        _section(totals, "per_task", F.col("task_id"), ["passed", "total"]),
    ]
    if deltas is not None:
        parts.append(_section(deltas, "metric_deltas", F.col("metric"), DELTA_FIELDS))
    return reduce(DataFrame.unionByName, parts)


def run_record(
    statuses: DataFrame, ks: list[int], samples: str, baseline: str | None = None,
    truth: DataFrame | None = None, deltas: DataFrame | None = None,
) -> DataFrame:
    """The record of a run as one row; truth has (task_id, passed) of each task's reference solution.

    Every part is a small aggregate of its own, read as a scalar: maps have an entry per k, status and metric, and
    failed_tasks names the tasks of the benchmark whose reference fails. task_records has the rest.
    """
    pairs = lambda df, key, value: df.agg(F.map_from_entries(F.collect_list(F.struct(key, value))).alias("m")).scalar()
    totals = run_totals(statuses).agg(F.first(F.struct("num_total", "num_correct", "num_invalid")).alias("t")).scalar()
    scores = pass_at_k(task_totals(statuses), ks).where(F.col("pass_at_k").isNotNull())
    none = F.lit(None)
    failed = none.cast("array<string>") if truth is None else truth.agg(
        F.sort_array(F.collect_set(F.when(~F.col("passed"), F.col("task_id")))).alias("f")).scalar()
    rate = none.cast("double") if truth is None else truth.agg(F.avg(F.col("passed").cast("int")).alias("r")).scalar()
    change = none if deltas is None else pairs(deltas, F.col("metric"), F.struct(*[F.col(f) for f in DELTA_FIELDS]))
    return statuses.sparkSession.range(1).select(
        F.lit(samples).alias("samples"), F.lit(baseline).cast("string").alias("baseline"),
        pairs(scores, F.concat(F.lit("pass@"), F.col("k")), F.col("pass_at_k")).alias("pass_at_k"),
        rate.alias("gt_pass_rate"), failed.alias("failed_tasks"),
        *[totals[name].alias(name) for name in ("num_total", "num_correct", "num_invalid")],
        pairs(status_counts(statuses), F.col("status"), F.col("n_rows")).alias("status_counts"),
        change.cast(f"map<string,{DELTA_STRUCT}>").alias("metric_deltas"),
    )


def task_records(statuses: DataFrame, chunk: int = STATUS_CHUNK) -> DataFrame:
    """passed and total of each task with its statuses in generation order, in chunks (part)."""
    return task_statuses(statuses, chunk).join(task_totals(statuses), "task_id").select(
        "task_id", "passed", "total", "part", "statuses")


def upsert_summary(old: DataFrame, new: DataFrame) -> DataFrame:
    """Old summary rows with every row of the new one put in its place or added."""
    keys = ["section", "key", "field"]
    fresh = new.select(*keys, F.col("value").alias("_new"), F.lit(True).alias("_is_new"))
    joined = old.join(fresh, keys, "full")
    value = F.when(F.col("_is_new"), F.col("_new")).otherwise(F.col("value"))
    return joined.select(*keys, value.alias("value"))
