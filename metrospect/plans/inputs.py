"""Inputs of the registered queries, derived by Spark from the given tables.

documents are the corpus, labels the verdicts, embeddings the pooled vectors, conversations the raw
outputs, benchmark the tasks. Every row of a table takes part.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from metrospect import constants as K
from metrospect.functions import text as tx
from metrospect.functions.lexical import with_lexical_metrics
from metrospect.session import broadcast_if_small, spread, staged

MODELS = ["de", "en", "es", "fr"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents for text work, on all cores also when the table is one small file."""
    return spread(table(spark, sf_dir, "documents"), "doc_id")


def corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents as raw corpus rows: seq, text and the columns ids come from."""
    return documents(spark, sf_dir).withColumnRenamed("doc_id", "seq")


def document_metrics(
    spark: SparkSession, sf_dir: str, only: DataFrame | None = None
) -> DataFrame:
    """id, task, language, length, split and the seven metrics of every document; narrow.

    only may hold the ids that matter, so that other texts are not measured.
    """
    docs = documents(spark, sf_dir)
    if only is not None:
        wanted = broadcast_if_small(only.select(F.col("id").alias("doc_id")), "wanted")
        docs = docs.join(wanted, "doc_id", "left_semi")
    docs = docs.withColumn("sha256", tx.sha256_hex("text"))
    return with_lexical_metrics(docs, "text").select(
        F.col("doc_id").alias("id"),
        F.col("source").alias("task_id"),
        F.col("lang").alias("model"),
        "n_chars",
        tx.hash_split("sha256").alias("split"),
        *[F.col(m).cast("double").alias(m) for m in K.METRICS],
    )


def staged_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The metrics table written once, for plans that read it several times."""
    return staged(document_metrics(spark, sf_dir), "metrics")


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two layers and two pools per embedding; a document beyond the length limit has zero vectors,
    as a row skipped for its length leaves them."""
    lengths = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "n_chars")
    vec = F.col("embedding").cast("array<double>")
    base = (
        table(spark, sf_dir, "embeddings")
        .select(F.col("vec_id").alias("id"), vec.alias("x"))
        .join(lengths, "id")
        .withColumn("x", F.when(F.col("n_chars") > K.MAX_CHARS,
                                F.transform("x", lambda v: v * 0.0)).otherwise(F.col("x")))
    )
    bent = F.transform("x", lambda v: v * v + v * 0.5)
    cells = F.array(
        F.struct(F.lit(1).alias("layer"), F.lit("mean").alias("pool"), F.col("x").alias("vec")),
        F.struct(F.lit(1).alias("layer"), F.lit("last").alias("pool"), F.reverse("x").alias("vec")),
        F.struct(F.lit(2).alias("layer"), F.lit("mean").alias("pool"), bent.alias("vec")),
        F.struct(F.lit(2).alias("layer"), F.lit("last").alias("pool"),
                 F.reverse(bent).alias("vec")),
    )
    return base.select("id", F.explode(cells).alias("c")).select("id", "c.*")


def token_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Embeddings as positions of one sequence per label; positions that start below 0 are masked."""
    return table(spark, sf_dir, "embeddings").select(
        F.col("label").alias("seq_id"),
        F.col("vec_id").alias("pos"),
        (F.col("embedding")[0] >= 0).cast("int").alias("mask"),
        F.col("embedding").cast("array<double>").alias("vec"),
    )


def verdict_status() -> Column:
    return (
        F.when(F.col("toxic") == 1, "SyntaxError")
        .when(F.col("quality") == 1, "pass")
        .when(F.col("quality") == 0, "fail")
    )


def statuses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One evaluated completion per label: task, language, alpha of its run, status."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "lang")
    alpha = F.when(F.col("toxic") == 1, -1.0).when(F.col("quality") == 0, 0.5).otherwise(1.0)
    return (
        table(spark, sf_dir, "labels")
        .join(docs, "doc_id")
        .select(
            F.col("doc_id").alias("id"),
            F.col("source").alias("task_id"),
            F.col("lang").alias("model"),
            F.col("doc_id").alias("generation_id"),
            alpha.alias("alpha"),
            verdict_status().alias("status"),
        )
    )


def samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document as a sample of its task with metrics and the verdict of its label, if any.

    Metrics are staged before the join, so only narrow rows are shuffled for it.
    """
    verdicts = statuses(spark, sf_dir).select(
        "id", "alpha", tx.status_passed("status").alias("passed")
    )
    return staged_metrics(spark, sf_dir).join(verdicts, "id", "left")


def programs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A Python program per document: its lines as comments, one branch per line, and a syntax error
    where the text has a '|'. Non-English ones have no function."""
    lines = F.split("text", "\n")
    comments = F.array_join(F.transform(lines, lambda line: F.concat(F.lit("# "), line)), "\n")
    inner = F.array_join(F.transform(lines, lambda line: F.concat(F.lit("    # "), line)), "\n")
    body = F.when(F.col("text").contains("|"), "(").otherwise("x")
    program = F.when(
        F.col("lang") == "en",
        F.concat(
            F.lit("def task_func(x):\n"), inner, F.lit("\n"),
            F.expr("repeat('    if x > 0:\n        x = x - 1\n', size(split(text, '\n')))"),
            F.lit("    return "), body, F.lit("\n"),
        ),
    ).otherwise(
        F.concat(
            F.lit("x = 5\n"), comments, F.lit("\n"),
            F.expr("repeat('if x > 0:\n    x = x - 1\n', size(split(text, '\n')))"),
            F.lit("y = "), body, F.lit("\n"),
        )
    )
    return documents(spark, sf_dir).select(
        F.col("doc_id").alias("id"), "lang", program.alias("source")
    )


def scripts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """programs as raw rows (seq, source), of which the French ones that parse hold nothing but comments."""
    comments = F.regexp_replace("source", "(?m)^(?!#).*$\n?", "")
    idle = (F.col("lang") == "fr") & ~F.col("source").endswith("(\n")
    return programs(spark, sf_dir).select(F.col("id").alias("seq"), F.when(idle, comments).otherwise(F.col("source")).alias("source"))
