import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from metrospect.operators import ranking, selection
from metrospect.operators.batching import length_batches, overflow_flags, padding_report


@pytest.fixture(params=["few_ranges", "many_ranges"])
def path(request, spark):
    """Counted values in one range, as small tables are, and in many."""
    if request.param == "few_ranges":
        yield request.param
        return
    kept = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    spark.conf.set("spark.sql.shuffle.partitions", "13")
    yield request.param
    spark.conf.set("spark.sql.shuffle.partitions", kept)
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def skewed(n=600, seed=1):
    """(id, metric, value) rows: a third of each metric's rows share one value, some are missing."""
    rng = random.Random(seed)
    rows = []
    for metric in ("a", "b"):
        for i in range(n):
            hot = rng.random() < 0.34
            value = 5.0 if hot else float(rng.randrange(-50, 50)) if metric == "a" else rng.gauss(0, 9)
            rows.append((i, metric, None if i % 97 == 0 else value))
    return rows


@pytest.fixture
def long(spark):
    return spark.createDataFrame(skewed(), "id long, metric string, value double").repartition(5)


def values(metric):
    return [(v, i) for i, m, v in skewed() if m == metric and v is not None]


def test_row_number_within_a_hot_key(spark):
    rng = random.Random(3)
    rows = [("hot" if rng.random() < 0.5 else f"k{rng.randrange(5)}", s)
            for s in rng.sample(range(10_000), 900)]
    df = spark.createDataFrame(rows, "k string, seq long").repartition(7)
    got = {(r["k"], r["seq"]): r["n"]
           for r in ranking.row_number_within(df, ["k"], "seq", "n", block_rows=64).collect()}
    for key in {k for k, _ in rows}:
        for place, seq in enumerate(sorted(s for k, s in rows if k == key), 1):
            assert got[key, seq] == place
    assert len(got) == len(rows)


def test_cumulative_counts(long, path):
    rows = ranking.cumulative_counts(long, ["metric"], "value").collect()
    for metric in ("a", "b"):
        have = [v for v, _ in values(metric)]
        mine = {r["value"]: r for r in rows if r["metric"] == metric}
        assert set(mine) == set(have)
        for value, row in mine.items():
            assert row["n"] == have.count(value)
            assert row["before"] == sum(v < value for v in have)
            assert row["total"] == len(have)


def test_cumulative_counts_without_keys(long, path):
    rows = ranking.cumulative_counts(long.where("metric = 'a'"), [], "value").collect()
    have = [v for v, _ in values("a")]
    assert {r["value"]: r["before"] for r in rows} == {v: sum(w < v for w in have) for v in have}


def test_quantiles_match_numpy(long, path):
    shares = {"lo": 0.05, "q1": 0.25, "mid": 0.5, "hi": 0.95, "max": 1.0}
    for row in ranking.quantiles(long, ["metric"], "value", shares).collect():
        have = [v for v, _ in values(row["metric"])]
        for name, share in shares.items():
            assert row[name] == pytest.approx(np.percentile(have, share * 100))


def test_average_ranks_join_keeps_hot_rows(long, path):
    ranks = ranking.average_ranks(long, ["metric"], "value")
    rows = ranking.join_counted(
        long.where(F.col("value").isNotNull()), ranks, ["metric", "value"], hot_share=0.1
    ).collect()
    for metric in ("a", "b"):
        have = values(metric)
        mine = {r["id"]: r["rank"] for r in rows if r["metric"] == metric}
        assert len(mine) == len(have)
        for v, i in have:
            less = sum(w < v for w, _ in have)
            same = sum(w == v for w, _ in have)
            assert mine[i] == less + (same + 1) / 2


def brute_top_bottom(rows, p, only_inside):
    if only_inside:
        low, high = min(rows)[0], max(rows)[0]
        rows = [r for r in rows if low < r[0] < high]
    k = max(1, int(len(rows) * p / 100))
    ordered = sorted(rows)
    return {i for _, i in ordered[-k:]}, {i for _, i in ordered[:k]}, k


@pytest.mark.parametrize("p", [0.1, 10, 45, 80])
@pytest.mark.parametrize("only_inside", [False, True])
def test_top_bottom_with_ties_at_the_cut(long, path, p, only_inside):
    rows = selection.top_bottom(long, "id", p, only_inside).collect()
    for metric in ("a", "b"):
        top, bottom, k = brute_top_bottom(values(metric), p, only_inside)
        mine = [r for r in rows if r["metric"] == metric]
        assert {r["id"] for r in mine if r["is_top"]} == top
        assert {r["id"] for r in mine if r["is_bottom"]} == bottom
        assert {r["k"] for r in mine} == {k}


def test_single_row_is_top_and_bottom(spark, path):
    df = spark.createDataFrame([(1, "a", 2.0)], "id long, metric string, value double")
    row = selection.top_bottom(df, "id", 10).first()
    assert row["is_top"] and row["is_bottom"] and row["k"] == 1
    assert selection.top_bottom(df, "id", 10, only_inside=True).count() == 0


def test_tail_bands_bottom_wins(spark, path):
    df = spark.createDataFrame([(i, "a", 1.0) for i in range(9)], "id long, metric string, value double")
    assert {r["band"] for r in selection.tail_bands(df).collect()} == {"bottom 5%"}


def test_boundary_ignores_nulls_and_constant_columns(spark):
    df = spark.createDataFrame(
        [(1, 1.0, 4.0), (2, 2.0, 4.0), (3, None, 4.0), (4, 3.0, 4.0)], "id long, x double, y double"
    )
    rows = selection.with_inside_flags(df, ["x", "y"]).orderBy("id").collect()
    assert [r["x_inside"] for r in rows] == [False, True, False, False]
    assert not any(r["y_inside"] for r in rows)
    chosen = selection.with_inside_flags(df, ["x"], F.col("id") > 1).orderBy("id").collect()
    assert not any(r["x_inside"] for r in chosen)


def test_length_batches(spark, path):
    rng = random.Random(5)
    rows = [(i, 7 if rng.random() < 0.4 else rng.randrange(1, 40)) for i in range(500)]
    df = spark.createDataFrame(rows, "id long, n int").repartition(6)
    placed = length_batches(df, "n", "id", 16)
    want = {i: at for at, (_, i) in enumerate(sorted((n, i) for i, n in rows))}
    got = {r["id"]: (r["position"], r["batch"]) for r in placed.collect()}
    assert got == {i: (at, at // 16) for i, at in want.items()}
    waste = {r["batch"]: (r["n_rows"], r["waste"]) for r in padding_report(placed, "n").collect()}
    ordered = sorted(n for _, n in rows)
    for b in range(32):
        part = ordered[b * 16:(b + 1) * 16]
        assert waste[b] == (len(part), max(part) * len(part) - sum(part))


def test_overflow_drops_the_whole_batch(spark):
    df = spark.createDataFrame([(i, 9 if i == 5 else 2) for i in range(8)], "pos long, tokens int")
    flags = {r["pos"]: r["overflow"] for r in overflow_flags(df, "pos", "tokens", 4, 8).collect()}
    assert [flags[i] for i in range(8)] == [False] * 4 + [True] * 4


def test_null_keys_are_numbered_and_null_lengths_come_last(spark):
    rows = spark.createDataFrame([(1, "a"), (2, None), (3, None), (4, "a")], "seq long, task string")
    got = {(r.task, r.seq): r.place for r in ranking.row_number_within(rows, ["task"], "seq", "place").collect()}
    assert got == {("a", 1): 1, ("a", 4): 2, (None, 2): 1, (None, 3): 2}
    lengths = spark.createDataFrame([(1, 5), (2, None), (3, 4), (4, None)], "id long, n int")
    placed = {r.id: r.position for r in length_batches(lengths, "n", "id", 2).collect()}
    assert placed == {3: 0, 1: 1, 2: 2, 4: 3}


@pytest.mark.parametrize("kind", ["string", "date", "decimal(20,3)", "boolean", "binary"])
def test_counts_of_any_orderable_type(spark, path, kind):
    df = spark.range(300).selectExpr(
        f"CAST(CASE '{kind}' WHEN 'date' THEN CAST(date_add(DATE'2020-01-01', CAST(id % 50 AS INT)) AS STRING)"
        f" WHEN 'boolean' THEN CAST(id % 3 = 0 AS STRING) ELSE CAST(id % 50 AS STRING) END AS {kind}) AS v", "id % 2 AS k")
    df = df.unionByName(spark.createDataFrame([(None, 0), (None, 1)], f"v {kind}, k long"))
    have = {}
    for r in df.where("v IS NOT NULL").collect():
        have.setdefault(r.k, []).append(bytes(r.v) if kind == "binary" else r.v)
    rows = ranking.cumulative_counts(df, ["k"], "v").collect()
    assert len(rows) == sum(len(set(h)) for h in have.values())
    for r in rows:
        v = bytes(r.v) if kind == "binary" else r.v
        assert (r.n, r.before, r.total) == (have[r.k].count(v), sum(x < v for x in have[r.k]), len(have[r.k]))


def test_selection_by_names(spark, path):
    """Records may be strings; ties at a cut are broken by them, and the report counts the dropped edges."""
    rng = random.Random(4)
    rows = [(f"file-{i}", "m", float(rng.choice([0, 1, 2, 2, 2, 3, 4, 9]))) for i in range(400)]
    long = spark.createDataFrame(rows, "id string, metric string, value double")
    got = {r.id: (r.is_top, r.is_bottom, r.k, r.n_dropped) for r in selection.top_bottom(long, "id", 30, only_inside=True).collect()}
    inner = sorted((v, i) for i, _, v in rows if 0 < v < 9)
    k = len(inner) * 30 // 100
    dropped = len(rows) - len(inner)
    bottom, top = {i for _, i in inner[:k]}, {i for _, i in inner[-k:]}
    assert got == {i: (i in top, i in bottom, k, dropped) for i in top | bottom}
    report = selection.selection_report(selection.top_bottom(long, "id", 30, only_inside=True)).collect()
    assert {(r.side, r.n_rows, r.n_dropped) for r in report} == {("top", k, dropped), ("bottom", k, dropped)}
    whole = selection.top_bottom(long, "id", 30)
    assert {r.n_dropped for r in whole.collect()} == {0}
