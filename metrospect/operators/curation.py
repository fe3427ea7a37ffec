"""Curation: pull, filter cascade, first-seen dedup, metrics, split, sink schema."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from metrospect import constants as K
from metrospect.functions import text as tx
from metrospect.functions.lexical import lexically_valid, with_lexical_metrics
from metrospect.functions.pyast import with_python_metrics
from metrospect.operators.dedup import early_reason, first_seen, later_copies, totals, without
from metrospect.session import staged

RAW_SCHEMA = T.StructType(
    [T.StructField(name, T.StringType()) for name in ("content", "source", "hexsha", "id")]
)
CURATED_TYPES = {
    "id": "string", "source": "string", "sha256": "string", "cc": "int", "mi": "float",
    "comment_ratio": "float", "h_volume": "float", "h_difficulty": "float", "h_effort": "float",
    "sloc": "int", "split": "string",
}
KEY_DIGITS = 15
COARSE_BITS = 16


def pull_key(record: Column | str, seed: int) -> Column:
    """Seeded position of a record: 60 bits of a hash, the same on every run and cluster."""
    salted = F.concat(F.lit(f"{seed}:"), tx.col(record).cast("string"))
    return tx.hex_prefix_number(F.sha2(salted, 256), KEY_DIGITS)


def pull(df: DataFrame, record: str, n: int, seed: int = 42) -> DataFrame:
    """The first n records in seeded order, before any filter, with pull_key for ordering.

    The cut is found on ids alone: counts over 2^16 hash ranges name the range that holds record n,
    and only that range (a 65536th of the table, as the hash is even) is ordered. Texts never move.
    """
    keyed = df.withColumn("pull_key", pull_key(record, seed))
    coarse = F.shiftright("pull_key", 4 * KEY_DIGITS - COARSE_BITS)
    narrow = keyed.select("pull_key", record, coarse.alias("_range"))
    earlier = W.orderBy("_range").rowsBetween(W.unboundedPreceding, -1)
    edge = (
        narrow.groupBy("_range").agg(F.count(F.lit(1)).alias("_rows"))
        .withColumn("_before", F.coalesce(F.sum("_rows").over(earlier), F.lit(0)))
        .where((F.col("_before") < n) & (F.col("_before") + F.col("_rows") >= n))
    )
    inside = W.partitionBy("_range").orderBy("pull_key", record)
    last = (
        narrow.join(edge, "_range")
        .withColumn("_place", F.col("_before") + F.row_number().over(inside))
        .where(F.col("_place") == n)
        .select(F.struct("pull_key", F.col(record).alias("record")).alias("last"))
    )
    cut = last.scalar()
    here = F.struct(F.col("pull_key"), F.col(record).alias("record"))
    return keyed.where(F.coalesce(here <= cut, F.lit(n > 0)))


def prepare(
    df: DataFrame, source: Column, seq: str, *, profile: str = "lexical",
    min_chars: int = K.MIN_CHARS, max_chars: int = K.MAX_CHARS,
) -> DataFrame:
    """Add source, sha256, metrics, metrics_error and early_reason to each pulled row."""
    base = df.withColumn("source", source).withColumn("sha256", tx.sha256_hex("source"))
    if profile == "lexical":
        measured = with_lexical_metrics(base).withColumn("valid", lexically_valid("source"))
    elif profile == "python_ast":
        measured = with_python_metrics(base)
    else:
        raise ValueError(f"unknown profile {profile!r}")
    return measured.withColumn(
        "early_reason",
        early_reason(F.col("valid"), tx.length_ok("source", min_chars, max_chars)),
    )


def judged(
    df: DataFrame, source: Column, seq: str, *, profile: str = "lexical",
    min_chars: int = K.MIN_CHARS, max_chars: int = K.MAX_CHARS,
) -> tuple[DataFrame, DataFrame]:
    """The cascade's verdicts by text: (seq, sha256) of every row, staged, and for each distinct sha256 its
    early_reason, metrics_error and metrics.

    A text is parsed and measured once, at its first row, however often it occurs; syntax comes before length and
    both before dedup, as in a cascade that looks at every row. Texts stay where they are. A missing text is a text
    with the sha256 "".
    """
    base = df.withColumn("source", source).select("source", seq)
    hashed = base.withColumn("sha256", F.coalesce(tx.sha256_hex("source"), F.lit("")))
    keyed = staged(hashed.select(seq, "sha256"), "keys")
    firsts = without(hashed, later_copies(keyed, "sha256", seq), seq)
    if profile == "lexical":
        measured = with_lexical_metrics(firsts).withColumn("valid", lexically_valid("source"))
    elif profile == "python_ast":
        measured = with_python_metrics(firsts)
    else:
        raise ValueError(f"unknown profile {profile!r}")
    reason = early_reason(F.col("valid"), tx.length_ok("source", min_chars, max_chars))
    verdicts = measured.select("sha256", reason.alias("early_reason"), "metrics_error", *K.METRICS)
    return keyed, staged(verdicts, "verdicts")


def judged_counts(keyed: DataFrame, verdicts: DataFrame) -> DataFrame:
    """Drop counts of judged() texts. Copies are counted before they meet their verdict, one row a text."""
    copies = keyed.groupBy("sha256").agg(F.count(F.lit(1)).alias("n"))
    failed = F.when(F.col("early_reason").isNull(), F.col("metrics_error").isNotNull())
    return totals(copies.join(verdicts, "sha256").select(
        F.col("early_reason").alias("reason"), failed.alias("failed"), "n"))


def judged_rows(keyed: DataFrame, verdicts: DataFrame, seq: str) -> DataFrame:
    """seq and drop_reason (NULL: kept) of every row of judged() texts."""
    first = keyed.groupBy("sha256").agg(F.min(seq).alias("_first"))
    per_text = verdicts.select("sha256", "early_reason", "metrics_error").join(first, "sha256")
    reason = (
        F.when(F.col("early_reason").isNotNull(), F.col("early_reason"))
        .when(F.col(seq) != F.col("_first"), "dedup")
        .when(F.col("metrics_error").isNotNull(), "metrics")
    )
    return keyed.join(per_text, "sha256").select(seq, reason.alias("drop_reason"))


def to_curated(df: DataFrame, *ids: Column | str, keep: tuple[str, ...] = ()) -> DataFrame:
    """Project kept rows to the 11 columns of the shard schema, and those of keep."""
    shaped = df.withColumn("split", tx.hash_split("sha256")).withColumn(
        "id", tx.record_id("sha256", *ids)
    )
    return shaped.select(*[F.col(c).cast(t).alias(c) for c, t in CURATED_TYPES.items()], *keep)


def curate(
    df: DataFrame, source: Column, seq: str, *ids: str, profile: str = "lexical",
    min_chars: int = K.MIN_CHARS, max_chars: int = K.MAX_CHARS,
) -> DataFrame:
    """The whole cascade in batch; ids are the columns of the id fallback chain.

    A text is measured once, and only after it has survived the cheap checks and dedup. Copies are valid
    or not together, so a Python text is parsed only after dedup, whose pass also tells if it is valid.
    """
    base = df.withColumn("source", source).select(*dict.fromkeys(["source", seq, *ids]))
    cheap = tx.length_ok("source", min_chars, max_chars)
    if profile == "lexical":
        cheap = lexically_valid("source") & cheap
    elif profile != "python_ast":
        raise ValueError(f"unknown profile {profile!r}")
    unique = first_seen(
        base.where(cheap).withColumn("sha256", tx.sha256_hex("source")), "sha256", seq
    )
    if profile == "lexical":
        measured = with_lexical_metrics(unique)
    else:
        measured = with_python_metrics(unique).where("valid")
    return to_curated(measured.where(F.col("metrics_error").isNull()), *ids)
