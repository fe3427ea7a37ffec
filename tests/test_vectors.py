import numpy as np
import pytest
from pyspark.sql import functions as F

from metrospect.functions import vectors as vx
from metrospect.operators import contrast, moments, pooling, probes, stats
from metrospect.operators.selection import with_inside_flags

SCHEMA = "id long, layer int, pool string, vec array<double>"


def table(spark, x, layer=1, pool="mean"):
    return spark.createDataFrame([(i, layer, pool, row.tolist()) for i, row in enumerate(x)], SCHEMA)


def test_pooling_uses_the_mask(spark):
    rng = np.random.default_rng(0)
    hidden = rng.normal(size=(2, 4, 3))
    mask = np.array([[0, 1, 1, 1], [0, 0, 1, 1]])
    rows = [(b, t, int(mask[b, t]), hidden[b, t].tolist()) for b in range(2) for t in range(4)]
    states = spark.createDataFrame(rows, "seq_id long, pos int, mask int, vec array<double>")
    mean = {r["seq_id"]: r["vec"] for r in pooling.pool_mean(states).collect()}
    last = {r["seq_id"]: r["vec"] for r in pooling.pool_last(states).collect()}
    for b in range(2):
        assert mean[b] == pytest.approx(hidden[b][mask[b] == 1].mean(0))
        assert last[b] == pytest.approx(hidden[b, -1])


def test_zero_and_nan_vectors(spark):
    df = table(spark, np.array([[0.0, 0.0], [0.0, np.nan], [3.0, 4.0]]))
    assert sorted(r["id"] for r in pooling.drop_zero_vectors(df).collect()) == [1, 2]
    row = pooling.norm_profile(df.where("id <> 1")).first()
    assert (row["mean_norm"], row["std_norm"], row["nan_count"]) == (2.5, 2.5, 0)
    assert pooling.norm_profile(df).first()["nan_count"] == 1


def test_scaling_keeps_constant_dimensions(spark):
    x = np.array([[1.0, 5.0], [3.0, 5.0], [8.0, 5.0]])
    df = table(spark, x)
    scaled = pooling.standardise(df, pooling.feature_scales(df)).orderBy("id").collect()
    want = (x - x.mean(0)) / np.where(x.std(0) > 0, x.std(0), 1)
    assert np.allclose([r["vec"] for r in scaled], want)


def ridge(x, y, alpha=1.0):
    """Brute force: standardise, solve the penalised normal equations, score on rows."""
    mean, std = x.mean(0), x.std(0)
    std[std == 0] = 1
    z = (x - mean) / std
    w = np.linalg.solve(z.T @ z + alpha * np.eye(x.shape[1]), z.T @ (y - y.mean()))

    def r2(x2, y2):
        guess = y.mean() + (x2 - mean) / std @ w
        return 1 - ((y2 - guess) ** 2).sum() / ((y2 - y2.mean()) ** 2).sum()

    return w, r2


@pytest.mark.parametrize("tile", [64, 4, 1])
def test_probe_sweep_matches_brute_force(spark, tile):
    rng = np.random.default_rng(1)
    n, d = 300, 6
    x = {1: rng.normal(3, 2, size=(n, d)), 2: rng.normal(size=(n, d)) * [1, 2, 3, 4, 5, 0]}
    for layer in x:
        x[layer][::40] = 0
    cc = np.clip(np.round(x[1] @ [1, 2, 0, 0, 1, 1] + rng.normal(size=n)), 0, 20)
    mi = x[2][:, 0] * 1e6 + rng.normal(size=n)
    split = np.array(["train", "test", "train", "val"])[np.arange(n) % 4]
    vectors = table(spark, x[1], 1).unionByName(table(spark, x[2], 2)).repartition(5)
    labelled = spark.createDataFrame(
        [(i, str(s), float(a), float(b)) for i, (s, a, b) in enumerate(zip(split, cc, mi))],
        "id long, split string, cc double, mi double",
    )
    flagged = with_inside_flags(labelled, ["cc", "mi"])
    results = probes.probe_sweep(vectors, flagged, metrics=["cc", "mi"], tile=tile).collect()
    assert len(results) == 4
    for row in results:
        xs, y = x[row["layer"]], cc if row["metric"] == "cc" else mi
        keep = (xs != 0).any(1) & (y > y.min()) & (y < y.max())
        train, test = keep & (split == "train"), keep & (split == "test")
        w, r2 = ridge(xs[train], y[train])
        assert (row["n_train"], row["n_test"]) == (train.sum(), test.sum())
        assert row["weights"] == pytest.approx(w.tolist(), rel=1e-5, abs=1e-6 * y.std())
        assert row["intercept"] == pytest.approx(y[train].mean())
        assert row["r2_train"] == pytest.approx(r2(xs[train], y[train]), abs=1e-8)
        assert row["r2_test"] == pytest.approx(r2(xs[test], y[test]), abs=1e-8)


@pytest.mark.parametrize("tile", [64, 4, 1])
def test_pca_matches_svd_up_to_sign(spark, tile):
    rng = np.random.default_rng(3)
    cells = {(1, "mean"): rng.normal(size=(80, 5)) * [5, 3, 1, 1, 1] + 7,
             (2, "last"): rng.normal(size=(60, 5)) * [1, 1, 9, 2, 1]}
    frames = [table(spark, x, *key) for key, x in cells.items()]
    vectors = frames[0].unionByName(frames[1]).repartition(4)
    scores = probes.pca_scores(vectors, probes.principal_axes(vectors, 2, tile)).collect()
    for (layer, pool), x in cells.items():
        rows = sorted((r["id"], r["pc_0"], r["pc_1"]) for r in scores
                      if (r["layer"], r["pool"]) == (layer, pool))
        got = np.array([r[1:] for r in rows])
        u, s, _ = np.linalg.svd(x - x.mean(0), full_matrices=False)
        assert np.allclose(np.abs(got), np.abs(u[:, :2] * s[:2]), atol=1e-8)


def test_contrast_gram_and_angles(spark):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(12, 3))
    vectors = table(spark, x).unionByName(table(spark, x * 2, 2))
    picks = [(i, "mi", i < 4, 2 <= i < 6) for i in range(6)]
    picks += [(i, "cc", i > 8, i < 3) for i in (0, 1, 2, 9, 10, 11)]
    chosen = spark.createDataFrame(picks, "id long, metric string, is_top boolean, is_bottom boolean")
    found = contrast.contrast_vectors(chosen, vectors)
    got = {(r["metric"], r["layer"]): np.array(r["vec"]) for r in found.collect()}
    mi, cc = x[:4].mean(0) - x[2:6].mean(0), x[9:].mean(0) - x[:3].mean(0)
    assert np.allclose(got["mi", 1], mi) and np.allclose(got["cc", 2], cc * 2)
    cells = {(r["layer"], r["metric_a"], r["metric_b"]): r["cosine"]
             for r in contrast.gram(found, ["cc", "mi"]).collect()}
    assert len(cells) == 6 and cells[1, "cc", "cc"] == pytest.approx(1)
    cosine = mi @ cc / np.linalg.norm(mi) / np.linalg.norm(cc)
    assert cells[2, "cc", "mi"] == pytest.approx(cosine)
    for row in contrast.principal_angles(found, ["cc", "mi"]).collect():
        assert 0 <= row["angle"] <= 90
        assert row["angle"] == pytest.approx(np.degrees(np.arccos(abs(cosine))))
    ranges = {r["metric"]: r for r in contrast.norm_range(found).collect()}
    assert ranges["mi"]["max_norm"] == pytest.approx(2 * np.linalg.norm(mi))


def test_zero_vectors_have_cosine_zero(spark):
    row = spark.range(1).select(
        vx.cosine(F.array(F.lit(0.0), F.lit(0.0)), F.array(F.lit(1.0), F.lit(2.0))).alias("c")
    ).first()
    assert row["c"] == 0


def test_spearman_with_ties_and_a_constant(spark):
    rng = np.random.default_rng(5)
    a = rng.integers(0, 6, 200).astype(float)
    b = a * 2 + rng.integers(0, 4, 200)
    rows = [(i, float(p), float(q), 1.0) for i, (p, q) in enumerate(zip(a, b))]
    df = spark.createDataFrame(rows, "id long, a double, b double, c double")
    got = {(r["metric_a"], r["metric_b"]): r["rho"]
           for r in stats.spearman(df, "id", ["a", "b", "c"]).collect()}
    import pandas as pd

    rank = lambda v: pd.Series(v).rank().to_numpy()
    want = np.corrcoef(rank(a), rank(b))[0, 1]
    assert got["a", "b"] == pytest.approx(want)
    assert got["a", "c"] is None


def test_score_reports_pick_the_lower_layer_on_ties(spark):
    rows = [(1, "mean", "mi", 0.5, "x"), (2, "mean", "mi", 0.7, "x"), (3, "mean", "mi", 0.7, "x"),
            (1, "mean", "mi", 0.9, "y")]
    scores = spark.createDataFrame(rows, "layer int, pool string, metric string, r2_test double, model string")
    best = probes.best_layers(scores.where("model = 'x'")).first()
    assert (best["layer"], best["r2_test"]) == (2, 0.7)
    top = {r["model"]: r["layer"] for r in
           probes.best_scores(scores, ["model", "pool", "metric"]).collect()}
    assert top == {"x": 2, "y": 1}
    assert probes.winner_models(scores).first()["model"] == "y"
    pivot = {r["layer"]: r["mi"] for r in
             probes.score_pivot(scores.where("model = 'x'"), "layer").collect()}
    assert pivot == {1: 0.5, 2: 0.7, 3: 0.7}


def test_moments_survive_flushes_and_refuse_unequal_widths(spark):
    rng = np.random.default_rng(6)
    x = rng.normal(size=(50, 7))
    y = [None if i % 3 == 0 else float(i) for i in range(50)]
    rows = [(1, "mean", "train", v.tolist(), 1.0, t) for v, t in zip(x, y)]
    df = spark.createDataFrame(
        rows, "layer int, pool string, part string, vec array<double>, a double, b double"
    ).repartition(9)
    sums = moments.second_moments(df, ["a", "b"], tile=3, held_bytes=0).toPandas()
    kept = np.array([t is not None for t in y])
    for metric, used in (("a", x), ("b", x[kept])):
        part = moments.parts_of(sums[sums["metric"] == metric], 3)["train"]
        assert part.n == len(used) and np.allclose(part.square(), used.T @ used)
        assert part.form(part.sx) == pytest.approx(part.sx @ used.T @ used @ part.sx)
    mixed = df.withColumn("vec", F.when(F.col("b") > 40, F.slice("vec", 1, 1)).otherwise(F.col("vec")))
    with pytest.raises(Exception, match="width"):
        moments.second_moments(mixed, ["a"]).collect()
    assert moments.second_moments(df.where("layer > 1"), ["a"]).count() == 0


def test_contrast_in_few_and_many_parts(spark):
    """Sums by membership matrices against plain means, also when a task passes its sums on after every batch."""
    rng = np.random.default_rng(12)
    rows = [(i, layer, pool, rng.normal(size=3).tolist()) for i in range(60) for layer in (1, 2) for pool in ("last", "mean")]
    vectors = spark.createDataFrame([*rows, (1, 1, "mean", None)], "id long, layer int, pool string, vec array<double>").repartition(5)
    chosen = [(i, m, i % k == 0, i % k == 1) for m, k in (("a", 3), ("b", 7)) for i in range(60) if i % k < 2]
    selected = spark.createDataFrame([*chosen, (99, "a", True, True)], "id long, metric string, is_top boolean, is_bottom boolean")
    joined = vectors.join(selected.groupBy("id").agg(F.collect_list(F.struct("metric", F.lit("top").alias("side"))).alias("sides")), "id")
    parts = contrast.side_means(joined, max_bytes=0).groupBy("metric", "layer", "pool").agg(F.sum("n").alias("n")).collect()
    assert {(r.metric, r.n) for r in parts} == {("a", 40), ("b", 18)}
    got = {(r.metric, r.layer, r.pool): r.vec for r in contrast.contrast_vectors(selected, vectors).collect()}
    assert len(got) == 8
    for (metric, layer, pool), vec in got.items():
        side = lambda place: {i for i, m, *on in chosen if m == metric and on[place]}
        mean = lambda ids: np.mean([v for i, l, p, v in rows if i in ids and (l, p) == (layer, pool)], axis=0)
        assert vec == pytest.approx(mean(side(0)) - mean(side(1)))
