"""Registered queries: each reads the given tables whole and returns a DataFrame."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from metrospect import constants as K
from metrospect.functions import names, vectors as vx
from metrospect.functions import text as tx
from metrospect.functions.lexical import lexically_valid, with_lexical_metrics
from metrospect.functions.pyast import with_python_metrics
from metrospect.operators import (
    batching, contrast, curation, dedup, evaluation, pooling, probes, runs, selection, stats,
)
from metrospect.plans import inputs as I
from metrospect.session import scratch_path, staged
from metrospect.sources import corpus as corpus_io
from metrospect.sources import records as records_io
from metrospect.sources import tables as tables_io
from metrospect.streaming import curation as stream

Query = Callable[[SparkSession, str], DataFrame]
REGISTRY: dict[str, Query] = {}

PULL_COUNT = 500
PULL_SEED = 42
BATCH_SIZE = 64
PERCENT = 10
N_SAMPLES = 5
TASK_LIMIT = 25
SHARD_MB = 0.25
DIGITS = {"cc": 6, "mi": 6, "comment_ratio": 9, "h_volume": 3, "h_difficulty": 6, "h_effort": 1,
          "sloc": 6}


def query(function: Query) -> Query:
    REGISTRY[function.__name__] = function
    return function


def rounded(df: DataFrame, **digits: int) -> DataFrame:
    return df.withColumns({c: F.round(F.col(c), d) for c, d in digits.items()})


def rounded_by_metric(df: DataFrame, *columns: str) -> DataFrame:
    """Round value columns of a long metric table to the digits that fit the metric's size."""
    out = {}
    for c in columns:
        chain = None
        for metric, digits in DIGITS.items():
            here = F.col("metric") == metric
            value = F.round(F.col(c), digits)
            chain = F.when(here, value) if chain is None else chain.when(here, value)
        out[c] = chain
    return df.withColumns(out)


# --- curation ---------------------------------------------------------------------------------


@query
def curate_flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Length filter, exact dedup, hash split; rows, share and mean comment ratio per split.

    Hash and ratio are computed in the scan; only 40-byte rows are shuffled, copies collapsed first.
    """
    docs = I.corpus(spark, sf_dir).where(lexically_valid("text") & tx.length_ok("text"))
    narrow = with_lexical_metrics(docs.withColumn("sha256", tx.sha256_hex("text")), "text")
    # Copies share their text, so any copy's ratio is the ratio of the first one.
    unique = narrow.groupBy("sha256").agg(F.max("comment_ratio").alias("comment_ratio"))
    splits = unique.withColumn("split", tx.hash_split("sha256")).groupBy("split").agg(
        F.count(F.lit(1)).alias("n_rows"), F.avg("comment_ratio").alias("mean_comment_ratio")
    )
    # Three rows: a total over them costs nothing, while a second plan would hash every text again.
    result = splits.withColumn("pct", 100.0 * F.col("n_rows") / F.sum("n_rows").over(W.partitionBy()))
    return rounded(result, mean_comment_ratio=9, pct=6)


@query
def drop_reason_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    ready = curation.prepare(I.corpus(spark, sf_dir), tx.first_text("text"), "seq")
    return dedup.drop_counts(ready)


@query
def drop_reason_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    ready = curation.prepare(I.corpus(spark, sf_dir), tx.first_text("text"), "seq")
    lean = ready.select("seq", "sha256", "early_reason", "metrics_error")
    return dedup.with_drop_reason(lean).select(
        "seq", F.coalesce("drop_reason", F.lit("kept")).alias("drop_reason")
    )


@query
def python_drop_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Drop counts of Python scripts, each distinct one parsed once."""
    return curation.judged_counts(*curation.judged(I.scripts(spark, sf_dir), F.col("source"), "seq", profile="python_ast"))


@query
def python_drop_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The drop reason of every script."""
    judged = curation.judged(I.scripts(spark, sf_dir), F.col("source"), "seq", profile="python_ast")
    return curation.judged_rows(*judged, "seq").withColumn("drop_reason", F.coalesce("drop_reason", F.lit("kept")))


@query
def exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    hashed = I.corpus(spark, sf_dir).withColumn("sha256", tx.sha256_hex("text"))
    return dedup.first_seen(hashed, "sha256", "seq").select("seq", "sha256", "n_chars", "text")


@query
def hash_split_share(spark: SparkSession, sf_dir: str) -> DataFrame:
    split = I.corpus(spark, sf_dir).select(tx.hash_split(tx.sha256_hex("text")).alias("split"))
    return rounded(stats.share(split, "split"), pct=6)


@query
def pull_order_limit(spark: SparkSession, sf_dir: str) -> DataFrame:
    pulled = curation.pull(I.corpus(spark, sf_dir), "seq", PULL_COUNT, PULL_SEED)
    return pulled.select("seq", "pull_key", "text")


@query
def id_fallback_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """English rows have a hexsha, French ones an id, the others only their text."""
    raw = I.corpus(spark, sf_dir).select(
        F.when(F.col("lang") != "de", F.col("text")).otherwise("").alias("content"),
        F.col("text").alias("source"),
        F.when(F.col("lang") == "en", F.sha1("text")).otherwise("").alias("hexsha"),
        F.when(F.col("lang") == "fr", F.col("seq").cast("string")).alias("id"),
        "seq",
    )
    named = raw.withColumn("text", tx.first_text("content", "source"))
    sha = tx.sha256_hex("text")
    return named.select(
        "seq", tx.record_id(sha, "hexsha", "id").alias("id"), F.length("text").alias("n_chars")
    )


@query
def lexical_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    measured = with_lexical_metrics(I.corpus(spark, sf_dir), "text")
    return rounded(measured.select("seq", *K.METRICS, "metrics_error"), **DIGITS)


@query
def python_ast_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    measured = with_python_metrics(I.programs(spark, sf_dir))
    shaped = measured.withColumn("failed", F.col("metrics_error").isNotNull())
    return rounded(shaped.select("id", "valid", "failed", *K.METRICS), **DIGITS)


@query
def curated_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = I.corpus(spark, sf_dir)
    kept = curation.curate(docs, tx.first_text("text"), "seq", "seq")
    shaped = kept.select(
        "id", "sha256", "cc", "sloc", "split",
        *[F.col(m).cast("double").alias(m) for m in ("mi", "comment_ratio", "h_difficulty")],
    )
    return rounded(shaped, mi=3, comment_ratio=5, h_difficulty=2)


@query
def code_block_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns as raw outputs: assistants answer in a fence, users start a function, systems neither."""
    turns = I.table(spark, sf_dir, "conversations")
    fenced = F.concat(F.lit("Here:\n```python\n\n"), F.col("text"), F.lit(" \n```\nDone.\n```\nx```"))
    started = F.concat(F.lit("So "), F.col("text"), F.lit("\ndef task_func(x):\n    return x \n"))
    raw = F.when(F.col("role") == "assistant", fenced).when(F.col("role") == "user", started)
    raw = raw.otherwise(F.concat(F.lit("\n  "), F.col("text"), F.lit("\t \n")))
    return turns.select("conv_id", "turn", tx.extract_code(raw).alias("code"))


# --- vector tables ----------------------------------------------------------------------------


@query
def vector_norm_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(pooling.norm_profile(I.vectors(spark, sf_dir)), mean_norm=9, std_norm=9)


@query
def zero_vector_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = pooling.drop_zero_vectors(I.vectors(spark, sf_dir))
    return rounded(kept.select("id", "layer", "pool", vx.norm("vec").alias("norm")), norm=9)


@query
def index_metrics_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Index of embeddings with the metrics of their documents; the row count may not change."""
    index = I.table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), "label")
    metrics = I.staged_metrics(spark, sf_dir).select("id", "split", "cc", "sloc", "comment_ratio")
    return rounded(tables_io.with_metrics(index, metrics), comment_ratio=9)


def _long_vectors(df: DataFrame, *keys: str, digits: int = 9) -> DataFrame:
    long = df.select(*keys, F.posexplode("vec").alias("dim", "value"))
    return rounded(long, value=digits)


@query
def masked_mean_pool(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _long_vectors(pooling.pool_mean(I.token_states(spark, sf_dir)), "seq_id")


@query
def last_position_pool(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _long_vectors(pooling.pool_last(I.token_states(spark, sf_dir)), "seq_id")


@query
def feature_scaling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors without zero rows, scaled by moments of the train split."""
    rows = pooling.drop_zero_vectors(I.vectors(spark, sf_dir))
    split = I.corpus(spark, sf_dir).select(
        F.col("seq").alias("id"), tx.hash_split(tx.sha256_hex("text")).alias("split")
    )
    labelled = staged(rows.join(split, "id"), "labelled-vectors", ("layer", "pool"))
    scales = pooling.feature_scales(labelled.where(F.col("split") == "train"))
    scaled = pooling.standardise(labelled, scales)
    return _long_vectors(scaled, "id", "layer", "pool", "split", digits=6)


@query
def overflow_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Batches of 16 documents in stored order; a batch with a text beyond the limit is dropped."""
    docs = I.corpus(spark, sf_dir).select("seq", "n_chars")
    kept = batching.without_overflow(docs, "seq", "n_chars", 16, K.MAX_CHARS)
    return kept.select("seq", "batch", "padded")


@query
def length_bucket_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = I.corpus(spark, sf_dir).select("seq", "n_chars")
    placed = batching.length_batches(docs, "n_chars", "seq", BATCH_SIZE)
    return batching.padding_report(placed, "n_chars")


# --- selection, statistics and geometry -------------------------------------------------------


@query
def boundary_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    metrics = I.staged_metrics(spark, sf_dir)
    flagged = selection.with_inside_flags(metrics)
    return flagged.select("id", *[f"{m}_inside" for m in K.METRICS])


@query
def tail_bands(spark: SparkSession, sf_dir: str) -> DataFrame:
    long = selection.long_metrics(I.staged_metrics(spark, sf_dir), ["id"])
    banded = selection.tail_bands(long.where(F.col("value").isNotNull()))
    return banded.select("id", "metric", "band")


@query
def shifted_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    logs = selection.shifted_log(I.staged_metrics(spark, sf_dir))
    return rounded(logs.select("id", *[f"{m}_log" for m in K.METRICS]),
                   **{f"{m}_log": 9 for m in K.METRICS})


def _selected(metrics: DataFrame) -> DataFrame:
    """Top and bottom rows of the interior of each metric among the training documents."""
    train = metrics.where(F.col("split") == "train")
    long = selection.long_metrics(train, ["id"]).where(F.col("value").isNotNull())
    return selection.top_bottom(long, "id", PERCENT, only_inside=True)


@query
def top_bottom_select(spark: SparkSession, sf_dir: str) -> DataFrame:
    chosen = _selected(I.staged_metrics(spark, sf_dir))
    return chosen.select("id", "metric", "k", "is_top", "is_bottom")


@query
def selection_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    report = selection.selection_report(_selected(I.staged_metrics(spark, sf_dir)))
    return rounded_by_metric(report, "low", "high")


def _contrast(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contrast vectors over the training documents that have a non-zero vector."""
    rows = staged(
        pooling.drop_zero_vectors(I.vectors(spark, sf_dir)), "vectors", ("layer", "pool")
    )
    present = rows.where((F.col("layer") == 1) & (F.col("pool") == "mean")).select("id")
    metrics = staged(I.document_metrics(spark, sf_dir, only=present), "vector-metrics")
    return contrast.contrast_vectors(_selected(metrics), rows)


@query
def contrast_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _long_vectors(_contrast(spark, sf_dir), "metric", "layer", "pool")


@query
def curated_contrast(spark: SparkSession, sf_dir: str) -> DataFrame:
    """From raw documents to contrast vectors by curated ids, which are strings: curate, write and read shards and
    vectors, select, subtract."""
    named = I.corpus(spark, sf_dir).withColumn("hexsha", F.concat(F.lit("doc-"), "seq"))
    shards, vectors = scratch_path(spark, "shards"), scratch_path(spark, "vectors")
    corpus_io.write_shards(curation.curate(named, tx.first_text("text"), "seq", "hexsha"), shards, SHARD_MB)
    tables_io.write_vectors(I.vectors(spark, sf_dir).withColumn("id", F.concat(F.lit("doc-"), "id")), vectors)
    rows = pooling.drop_zero_vectors(tables_io.read_vectors(spark, vectors))
    present = rows.where((F.col("layer") == 1) & (F.col("pool") == "mean")).select("id")
    metrics = corpus_io.read_shards(spark, shards, ["id", "split", *K.METRICS]).join(present, "id", "left_semi")
    return _long_vectors(contrast.contrast_vectors(_selected(metrics), rows), "metric", "layer", "pool")


@query
def contrast_norm_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(contrast.norm_range(_contrast(spark, sf_dir)), min_norm=9, max_norm=9)


@query
def cosine_gram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(contrast.gram(_contrast(spark, sf_dir)), cosine=9)


@query
def principal_angles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(contrast.principal_angles(_contrast(spark, sf_dir)), cosine=9, angle=6)


@query
def spearman_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    inside = staged(selection.all_inside(I.staged_metrics(spark, sf_dir)), "inside")
    return rounded(stats.spearman(inside, "id"), rho=9)


@query
def verdict_spearman(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = I.samples(spark, sf_dir).where(F.col("passed").isNotNull())
    rows = staged(
        judged.select("id", *K.METRICS, F.col("passed").cast("double").alias("passed")), "judged"
    )
    pairs = [(m, "passed") for m in K.METRICS]
    return rounded(stats.spearman(rows, "id", [*K.METRICS, "passed"], pairs), rho=9)


@query
def column_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    profile = stats.column_profile(I.staged_metrics(spark, sf_dir))
    values = ["mean", "std", "min", "q25", "q50", "q75", "max"]
    return rounded_by_metric(profile, *values)


@query
def pca_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = pooling.drop_zero_vectors(I.vectors(spark, sf_dir))
    cells = staged(rows, "vectors", ("layer", "pool"))
    scores = probes.pca_scores(cells, probes.principal_axes(cells))
    metrics = I.staged_metrics(spark, sf_dir).select("id", *K.METRICS)
    joined = scores.select("id", "layer", "pool", "pc_0", "pc_1").join(metrics, "id")
    return rounded(joined, pc_0=6, pc_1=6, **DIGITS)


# --- probes -----------------------------------------------------------------------------------


def _flagged_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return selection.with_inside_flags(I.staged_metrics(spark, sf_dir))


@query
def probe_sweep(spark: SparkSession, sf_dir: str) -> DataFrame:
    results = probes.probe_sweep(I.vectors(spark, sf_dir), _flagged_metrics(spark, sf_dir))
    return rounded(results.drop("weights"), r2_train=6, r2_test=6, intercept=3)


def _scalar_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Probe results of two one-feature models: the sum of a vector and the sum of its positive part."""
    metrics = _flagged_metrics(spark, sf_dir)
    rows = I.vectors(spark, sf_dir)
    features = {
        "signed": F.aggregate("vec", F.lit(0.0), lambda a, x: a + x),
        "positive": F.aggregate("vec", F.lit(0.0), lambda a, x: a + F.greatest(x, F.lit(0.0))),
    }
    scored = []
    for model, feature in features.items():
        one = pooling.drop_zero_vectors(rows).withColumn("vec", F.array(feature))
        scored.append(probes.probe_sweep(one, metrics).withColumn("model", F.lit(model)))
    return staged(scored[0].unionByName(scored[1]), "scores")


@query
def probe_sweep_scalar(spark: SparkSession, sf_dir: str) -> DataFrame:
    scores = _scalar_scores(spark, sf_dir).select(
        "model", "layer", "pool", "metric", "r2_train", "r2_test", "n_train", "n_test",
        F.col("weights")[0].alias("weight"), "intercept",
    )
    return rounded(rounded_by_metric(scores, "intercept"), r2_train=6, r2_test=6, weight=3)


def _pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors of two features: the sum of a vector and the sum of its positive part."""
    signed = F.aggregate("vec", F.lit(0.0), lambda a, x: a + x)
    positive = F.aggregate("vec", F.lit(0.0), lambda a, x: a + F.greatest(x, F.lit(0.0)))
    rows = pooling.drop_zero_vectors(I.vectors(spark, sf_dir))
    return rows.withColumn("vec", F.array(signed, positive))


@query
def probe_sweep_pair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """R² of every probe on two features, in tiles of one feature."""
    scores = probes.probe_sweep(_pairs(spark, sf_dir), _flagged_metrics(spark, sf_dir), tile=1)
    parts = F.array(*[
        F.struct(F.lit(p).alias("split"), F.col(f"n_{p}").alias("n"), F.col(f"r2_{p}").alias("r2"))
        for p in ("train", "test")
    ])
    long = scores.select("layer", "pool", "metric", F.explode(parts).alias("s"))
    return rounded(long.select("layer", "pool", "metric", "s.*").where("n > 0"), r2=6)


@query
def pca_scores_pair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of two-feature vectors on both axes, from tiles of one feature."""
    cells = staged(_pairs(spark, sf_dir), "pairs")
    scores = probes.pca_scores(cells, probes.principal_axes(cells, tile=1))
    return rounded(scores.select("id", "layer", "pool", "pc_0", "pc_1"), pc_0=6, pc_1=6)


@query
def probe_pivot(spark: SparkSession, sf_dir: str) -> DataFrame:
    pivot = probes.score_pivot(_scalar_scores(spark, sf_dir), ["model", "layer"])
    return rounded(pivot, **{m: 6 for m in K.METRICS})


@query
def model_pivot(spark: SparkSession, sf_dir: str) -> DataFrame:
    pivot = probes.score_pivot(_scalar_scores(spark, sf_dir), ["model"])
    return rounded(pivot, **{m: 6 for m in K.METRICS})


@query
def best_layer(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Best layer per model, pool and metric."""
    best = probes.best_scores(_scalar_scores(spark, sf_dir), ["model", "pool", "metric"])
    return rounded(best, r2_test=6)


@query
def winner_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(probes.winner_models(_scalar_scores(spark, sf_dir)), r2_test=6)


@query
def probe_curve(spark: SparkSession, sf_dir: str) -> DataFrame:
    signed = _scalar_scores(spark, sf_dir).where(F.col("model") == "signed")
    return rounded(probes.score_curve(signed), r2_test=6, weight_norm=3)


# --- evaluation -------------------------------------------------------------------------------


def _generations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as samples of their source; labelled ones carry a generation id, others lost it."""
    labels = I.table(spark, sf_dir, "labels").select("doc_id", "quality")
    return (
        I.table(spark, sf_dir, "documents")
        .select("doc_id", "source")
        .join(labels, "doc_id", "left")
        .select(
            F.col("doc_id").alias("seq"), F.col("source").alias("task_id"),
            F.col("quality").cast("long").alias("generation_id"),
        )
    )


@query
def generation_id_rebuild(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluation.rebuild_generation_ids(_generations(spark, sf_dir))


@query
def repeated_generations(spark: SparkSession, sf_dir: str) -> DataFrame:
    rebuilt = evaluation.rebuild_generation_ids(_generations(spark, sf_dir))
    return evaluation.repeated_generations(rebuilt)


@query
def verdict_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Samples numbered per source, joined to the verdicts of the labelled ones by (task, number)."""
    unnumbered = _generations(spark, sf_dir).withColumn("generation_id", F.lit(None).cast("long"))
    samples = evaluation.rebuild_generation_ids(unnumbered)
    judged = I.statuses(spark, sf_dir).select(F.col("id").alias("seq"), "status")
    verdicts = samples.join(judged, "seq").select(
        "task_id", "generation_id", tx.status_passed("status").alias("passed")
    )
    return evaluation.with_verdicts(samples, verdicts)


@query
def quality_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = I.samples(spark, sf_dir)
    return rounded_by_metric(evaluation.quality_summary(rows), "mean", "median", "std")


@query
def quality_summary_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    summary = evaluation.quality_summary_all(I.staged_metrics(spark, sf_dir))
    return rounded_by_metric(summary, "mean", "median", "std")


@query
def samples_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sample records and evaluation documents from files to the quality summary; every document is a sample of its
    own task without generation id, and labels are verdicts."""
    task = F.concat(F.lit("doc-"), F.col("doc_id"))
    samples, verdicts = scratch_path(spark, "samples"), scratch_path(spark, "verdicts")
    records_io.write_jsonl(I.documents(spark, sf_dir).select(task.alias("task_id"), F.col("text").alias("raw_solution")), samples)
    result = F.to_json(F.create_map(task, F.array(F.struct(F.when(F.col("quality") == 1, "pass").otherwise("fail").alias("status")))))
    I.table(spark, sf_dir, "labels").select(result.alias("value")).write.text(verdicts)
    table = evaluation.samples_quality(records_io.read_samples(spark, samples), records_io.read_verdicts(spark, verdicts))
    return rounded_by_metric(evaluation.summarize_quality(table), "mean", "median", "std")


@query
def status_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluation.status_counts(I.statuses(spark, sf_dir))


@query
def task_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluation.task_totals(I.statuses(spark, sf_dir))


@query
def task_status_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    chunks = evaluation.task_statuses(I.statuses(spark, sf_dir), chunk=256)
    return chunks.withColumn("statuses", F.array_join("statuses", ","))


@query
def run_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluation.run_totals(I.statuses(spark, sf_dir))


@query
def pass_at_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    totals = evaluation.task_totals(I.statuses(spark, sf_dir))
    return rounded(evaluation.pass_at_k(totals, [1, 5, 1000]), pass_at_k=9)


def _deltas(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labelled documents against all documents, per source."""
    rows = I.samples(spark, sf_dir)
    return evaluation.metric_deltas(rows, rows.where(F.col("passed").isNotNull()))


@query
def metric_deltas(spark: SparkSession, sf_dir: str) -> DataFrame:
    fields = [f for f in evaluation.DELTA_FIELDS if f != "n"]
    return rounded(_deltas(spark, sf_dir), **{f: 6 for f in fields})


@query
def run_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = I.statuses(spark, sf_dir)
    summary = evaluation.run_summary(judged, [1, 5], _deltas(spark, sf_dir))
    return rounded(summary, value=6)


@query
def summary_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A summary without the toxic completions, updated by the one of the whole run."""
    judged = I.statuses(spark, sf_dir)
    old = evaluation.run_summary(judged.where(F.col("status") != "SyntaxError"), [1])
    new = evaluation.run_summary(judged, [5]).where(F.col("section") != "per_task")
    return rounded(evaluation.upsert_summary(old, new), value=6)


@query
def run_record(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The record of a run without the toxic completions, updated by one of the whole run with baseline, reference
    solutions and deltas; written, read, merged, written again and read as (section, key, field, value, text)."""
    judged = staged(I.statuses(spark, sf_dir), "statuses")
    folder, name = scratch_path(spark, "records"), "pass1_full_all_base_p10"
    first = judged.where(F.col("status") != "SyntaxError")
    records_io.upsert_record(spark, folder, name, evaluation.run_record(first, [1], "all.jsonl"))
    truth = judged.groupBy("task_id").agg((F.min_by("status", "id") == "pass").alias("passed"))
    whole = evaluation.run_record(judged, [5], "all.jsonl", "base.jsonl", truth, staged(_deltas(spark, sf_dir), "deltas"))
    version = records_io.upsert_record(spark, folder, name, whole)
    records_io.write_task_records(evaluation.task_records(judged), folder, name, version)
    found = records_io.read_records(spark, folder)
    none = lambda kind: F.lit(None).cast(kind)
    cell = lambda section, key, field, value=none("double"), text=none("string"): F.struct(
        F.lit(section).alias("section"), key.alias("key"), F.lit(field).alias("field"), value.cast("double").alias("value"), text.alias("text"))
    entries = lambda column, section, field: F.transform(
        F.map_entries(column), lambda e: cell(section, e["key"], field, e["value"]))
    run = F.lit("run")
    cells = F.concat(
        F.array(*[cell("run", run, f, F.col(f)) for f in ("num_total", "num_correct", "num_invalid", "gt_pass_rate", "version")]),
        F.array(*[cell("run", run, f, text=F.col(f)) for f in ("samples", "baseline")]),
        entries("pass_at_k", "pass_at_k", "pass_at_k"), entries("status_counts", "status_counts", "n_rows"),
        F.transform("failed_tasks", lambda task: cell("failed_tasks", task, "task_id", text=task)),
        F.flatten(F.transform(F.map_entries("metric_deltas"), lambda e: F.array(
            *[cell("metric_deltas", e["key"], f, e["value"][f]) for f in evaluation.DELTA_FIELDS]))))
    tasks = records_io.read_task_records(spark, folder, name, version).select(
        F.lit("per_task").alias("section"), F.col("task_id").alias("key"), F.concat(F.lit("statuses_"), "part").alias("field"),
        F.col("passed").cast("double").alias("value"), F.array_join("statuses", ",").alias("text"))
    return rounded(found.select(F.explode(cells).alias("c")).select("c.*").unionByName(tasks), value=6)


# --- runs and reports -------------------------------------------------------------------------


def _run_configs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A run per document; labelled ones sweep alphas made of their length, others are base runs."""
    labels = I.table(spark, sf_dir, "labels").select("doc_id", "quality")
    docs = I.table(spark, sf_dir, "documents").select("doc_id", "source", "lang", "n_chars")
    size = F.col("n_chars") / 100.0
    sweep = F.array(F.col("quality") * -1.0, F.col("quality") * 0.25, size, size / 1e6)
    return docs.join(labels, "doc_id", "left").select(
        F.col("doc_id").alias("seq"),
        F.concat(F.lit("run"), F.col("doc_id")).alias("name"),
        F.col("lang").alias("model"),
        F.col("source").alias("metric"),
        F.col("quality").alias("layer"),
        F.when(F.col("quality").isNotNull(), sweep).alias("alpha_sweep"),
    )


@query
def sweep_expand(spark: SparkSession, sf_dir: str) -> DataFrame:
    expanded = runs.expand_sweeps(_run_configs(spark, sf_dir))
    spec = F.col("steering")
    return expanded.select(
        "seq", "model", "name", F.size(spec).alias("n_specs"),
        F.get(spec, 0)["metric"].alias("metric"), F.get(spec, 0)["alpha"].alias("alpha"),
    )


@query
def sample_replication(spark: SparkSession, sf_dir: str) -> DataFrame:
    tasks = I.table(spark, sf_dir, "benchmark").select("item_id")
    return runs.replicate(tasks, N_SAMPLES)


@query
def runs_by_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    queue = runs.runs_by_model(_run_configs(spark, sf_dir).select("seq", "name", "model"), "seq")
    return queue.select("model", "name", "place")


@query
def run_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    chosen = runs.runs_of_model(_run_configs(spark, sf_dir), "en")
    return chosen.select("seq", "name", "model")


@query
def steering_specs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Specs as command-line text, one per document, parsed back."""
    text = F.concat_ws(" , ", "source", F.col("doc_id").cast("string"),
                       names.compact_number(F.col("n_chars") / 100.0))
    docs = I.table(spark, sf_dir, "documents").select("doc_id", text.alias("spec"))
    return docs.select("doc_id", names.parse_steering("spec").alias("s")).select("doc_id", "s.*")


@query
def run_stems(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = I.table(spark, sf_dir, "documents")
    stem = names.run_stem(
        "lang", "source", F.lit("instruct"), F.col("n_chars") / 100.0, F.lit(N_SAMPLES),
        F.col("n_chars") > 1000, F.col("lang") == "en",
    )
    return docs.select("doc_id", stem.alias("stem"))


@query
def run_name_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A summary name per label, some of them of no known form, parsed."""
    docs = I.table(spark, sf_dir, "documents").select("doc_id", "lang", "n_chars")
    metric = F.when(F.col("toxic") == 1, F.lit("mi")).otherwise(F.lit("comment_ratio"))
    alpha = names.compact_number((F.col("n_chars") - 1000) / 100.0)
    steered = F.concat(F.lit("pass1_full_"), "lang", F.lit("_"), metric, F.lit("_a"), alpha,
                       F.lit("_p10_summary.json"))
    base = F.concat(F.lit("pass5_full_"), "lang", F.lit("_base_p10_summary.json"))
    name = F.when(F.col("quality") == 1, steered).when(F.col("toxic") == 1, base).otherwise(
        F.concat(F.lit("notes_"), "lang", F.lit(".json"))
    )
    named = I.table(spark, sf_dir, "labels").join(docs, "doc_id").withColumn("name", name)
    parsed = named.withColumn("run", names.parse_run_name("name", I.MODELS, K.REPORT_METRICS))
    return parsed.where(F.col("run").isNotNull()).select("doc_id", "name", "run.*")


def _summaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Run summaries per language: the base run and one run per alpha and reported metric."""
    judged = I.statuses(spark, sf_dir)
    base = judged.withColumn("alpha", F.lit(0.0))
    totals = evaluation.task_totals(judged.unionByName(base), ("model", "alpha"))
    rates = evaluation.pass_at_k(totals, [1], ("model", "alpha")).select(
        "model", "alpha", F.col("pass_at_k").alias("pass")
    )
    rows = I.samples(spark, sf_dir)
    deltas = evaluation.metric_deltas(
        rows, rows.where(F.col("alpha").isNotNull()), K.REPORT_METRICS, ("model",), ("alpha",),
        medians=False,
    )
    steered = deltas.join(rates, ["model", "alpha"]).select(
        "model", "metric", "alpha", "pass", "mean_pct_delta", "std_pct_delta"
    )
    plain = rates.where(F.col("alpha") == 0).select(
        "model", F.lit(None).cast("string").alias("metric"), "alpha", "pass",
        F.lit(None).cast("double").alias("mean_pct_delta"),
        F.lit(None).cast("double").alias("std_pct_delta"),
    )
    return steered.unionByName(plain)


def _written_summaries(spark: SparkSession, sf_dir: str) -> str:
    """Write each run summary as JSON under its file name and return the folder."""
    base = F.col("metric").isNull()
    name = F.when(base, F.concat(F.lit("pass1_full_"), "model", F.lit("_base_p10_summary.json")))
    name = name.otherwise(
        F.concat(F.lit("pass1_full_"), "model", F.lit("_"), "metric", F.lit("_a"),
                 names.compact_number("alpha"), F.lit("_p10_summary.json"))
    )
    change = F.struct(F.col("mean_pct_delta"), F.col("std_pct_delta"))
    deltas = F.when(~base, F.create_map(F.coalesce("metric", F.lit("")), change))
    path = scratch_path(spark, "summaries")
    shaped = _summaries(spark, sf_dir).select(
        name.alias("run"), F.create_map(F.lit("pass@1"), F.col("pass")).alias("pass_at_k"),
        deltas.alias("metric_deltas"),
    )
    shaped.write.partitionBy("run").json(path)
    return path


def _points(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = records_io.read_summaries(spark, _written_summaries(spark, sf_dir), I.MODELS)
    return staged(runs.fan_out_base(found), "points")


@query
def summary_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = records_io.read_summaries(spark, _written_summaries(spark, sf_dir), I.MODELS)
    return rounded(found.withColumnRenamed("pass", "pass_rate"), pass_rate=9, mean_delta=6,
                   std_delta=6)


@query
def alpha_ordinal(spark: SparkSession, sf_dir: str) -> DataFrame:
    return runs.alpha_ordinals(_points(spark, sf_dir))


@query
def alpha_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    return runs.alpha_agreement(_points(spark, sf_dir))


@query
def final_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return runs.final_report(_points(spark, sf_dir), I.MODELS, strict=True)


@query
def alpha_legend(spark: SparkSession, sf_dir: str) -> DataFrame:
    return runs.alpha_legend(_points(spark, sf_dir), I.MODELS)


# --- sources and sinks ------------------------------------------------------------------------


@query
def jsonl_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sample records with nested metrics written as JSON lines and scanned again; records without
    metrics drop out and a missing generation id becomes 0."""
    measured = with_lexical_metrics(I.documents(spark, sf_dir), "text")
    labels = I.table(spark, sf_dir, "labels").select("doc_id", "quality")
    shaped = measured.join(labels, "doc_id", "left").select(
        F.concat(F.lit("task-"), F.col("doc_id")).alias("task_id"),
        F.col("quality").cast("long").alias("generation_id"),
        F.col("text").alias("raw_output"),
        F.col("lang").alias("model"),
        F.array().cast(runs.SPEC).alias("steerings"),
        tx.extract_code("text").alias("code"),
        F.when(tx.length_ok("text"), F.struct(*K.METRICS)).alias("metrics"),
    )
    path = scratch_path(spark, "samples-jsonl")
    records_io.write_jsonl(records_io.sample_records(shaped), path)
    return rounded(records_io.read_metric_rows(spark, path), **DIGITS)


def _written_verdicts(spark: SparkSession, sf_dir: str, indented: bool) -> str:
    """Evaluation documents, one per label: with and without wrapper, lists and not."""
    item = F.concat(F.lit('"doc-'), F.col("doc_id"), F.lit('"'))
    first = F.when(F.col("quality") == 1, "PASS").otherwise("fail")
    second = F.when(F.col("toxic") == 1, "Syntax Error").otherwise("pass")
    results = F.concat(
        F.lit('[{"status":"'), first, F.lit('"},{"status":"'), second, F.lit('"},{"time":1}]')
    )
    tasks = F.concat(F.lit("{"), item, F.lit(":"), results, F.lit(',"note":"none"}'))
    document = F.when(F.col("toxic") == 0, F.concat(F.lit('{"eval":'), tasks, F.lit("}")))
    path = scratch_path(spark, "verdicts")
    value = F.coalesce(document, tasks)
    if indented:
        value = F.regexp_replace(value, r"([\[{,])", "$1\n  ")
    I.table(spark, sf_dir, "labels").select(value.alias("value")).write.text(path)
    return path


@query
def verdict_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Evaluation documents as JSON lines."""
    return records_io.read_verdicts(spark, _written_verdicts(spark, sf_dir, False), per_line=True)


@query
def verdict_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files of many indented evaluation documents."""
    return records_io.read_verdicts(spark, _written_verdicts(spark, sf_dir, True))


@query
def manifest_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Curated shards, their manifest, and the rows that the listed shards hold."""
    kept = curation.curate(I.corpus(spark, sf_dir), tx.first_text("text"), "seq", "seq")
    path, listing = scratch_path(spark, "shards"), scratch_path(spark, "manifest")
    corpus_io.write_shards(kept, path, SHARD_MB)
    corpus_io.write_manifest(corpus_io.manifest(spark, path), listing)
    listed = corpus_io.read_manifest(spark, listing)
    totals = corpus_io.manifest_totals(listed)
    rows = corpus_io.read_listed_shards(spark, path, listed, ["id"])
    found = rows.agg(F.count(F.lit(1))).scalar()
    return totals.withColumn("listed_rows", found)


@query
def shard_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Curated shards read back with a column projection."""
    kept = curation.curate(I.corpus(spark, sf_dir), tx.first_text("text"), "seq", "seq")
    path = scratch_path(spark, "shards")
    corpus_io.write_shards(kept, path, SHARD_MB)
    return corpus_io.read_shards(spark, path, ["id", "split", "cc", "sloc"])


@query
def partitioned_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vector table written by layer and pool; one cell read back by partition pruning."""
    path = scratch_path(spark, "vectors")
    tables_io.write_vectors(I.vectors(spark, sf_dir), path)
    cell = tables_io.read_vectors(spark, path, layer=2, pool="mean")
    return rounded(cell.select("id", "layer", "pool", vx.norm("vec").alias("norm")), norm=5)


@query
def index_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "index")
    tables_io.write_index(I.document_metrics(spark, sf_dir), path)
    return tables_io.read_index(spark, path)


@query
def probe_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    results = probes.probe_sweep(I.vectors(spark, sf_dir), _flagged_metrics(spark, sf_dir))
    path = scratch_path(spark, "probes")
    tables_io.write_probe_results(results, path, "tables", K.RIDGE_ALPHA)
    back = tables_io.read_probe_results(spark, path)
    return back.select("model", "pool", "layer", "metric", "n_train", "n_test",
                       F.size("weights").alias("width"), "ridge_alpha")


@query
def contrast_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "contrast")
    tables_io.write_contrast(_contrast(spark, sf_dir), path, "tables", PERCENT)
    back = tables_io.read_contrast(spark, path, "tables", PERCENT)
    return rounded(back.select("model", "p", "metric", "layer", "pool",
                               vx.norm("vec").alias("norm")), norm=9)


@query
def run_metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Metadata record of the vector table: its rows and width, found in the data."""
    shape = I.table(spark, sf_dir, "embeddings").agg(
        F.count(F.lit(1)).alias("n_rows"), F.max(F.size("embedding")).alias("d_model")
    ).first()
    path = scratch_path(spark, "metadata")
    records_io.write_run_metadata(
        spark, path, model_name="tables", n_rows=shape["n_rows"], d_model=shape["d_model"],
        pools=K.POOLS,
    )
    back = records_io.read_run_metadata(spark, path)
    return back.select("model_name", "n_rows", "d_model", F.array_join("pools", ",").alias("pools"))


@query
def task_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First tasks in key order with the prompt of the instruct split."""
    tasks = I.table(spark, sf_dir, "benchmark").select(
        F.concat(F.lit("task/"), F.col("item_id")).alias("task_id"),
        F.col("text").alias("instruct_prompt"),
        F.upper("text").alias("complete_prompt"),
    )
    subset = F.length("instruct_prompt") > 0
    first = records_io.task_scan(tasks, "task_id", subset, TASK_LIMIT)
    prompt = tx.task_prompt(F.lit("instruct"), "instruct_prompt", "complete_prompt")
    return first.select("task_id", prompt.alias("prompt"))


# --- streaming --------------------------------------------------------------------------------


def arriving_half(docs: DataFrame) -> int:
    """How many files make one of two batches: two, and more with the splits of the scan, so that files do not grow with the table."""
    return max(2, docs.rdd.getNumPartitions())


def _streamed(spark: SparkSession, sf_dir: str) -> tuple[str, DataFrame]:
    """documents arriving in files, dealt so that copies with smaller ids also come later, in two batches."""
    arrivals, out = scratch_path(spark, "arrivals"), scratch_path(spark, "stream-out")
    docs = I.table(spark, sf_dir, "documents").withColumnRenamed("doc_id", "seq")
    half = arriving_half(docs)
    docs.repartition(2 * half, "seq").write.parquet(arrivals)
    counts = stream.run_curation(
        spark, arrivals, docs.schema, tx.first_text("text"), "seq", ["seq"], out,
        scratch_path(spark, "stream-state"), files_per_batch=half,
    )
    return out, counts


@query
def stream_curation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The cascade over arriving files; equals the batch result, ids included."""
    out, _ = _streamed(spark, sf_dir)
    return stream.read_kept(spark, out).select("id", "sha256", "split", "cc", "sloc")


@query
def stream_drop_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stored drop counters of the stream, summed over its micro-batches."""
    _, counts = _streamed(spark, sf_dir)
    return counts.agg(*[F.sum(c).alias(c) for c in stream.COUNTERS])
