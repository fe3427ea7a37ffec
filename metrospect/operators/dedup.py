"""Exact deduplication and the drop accounting of the curation cascade."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from metrospect.session import BROADCAST_BYTES, staged, staged_counted

REASONS = ["syntax", "char_length", "dedup", "metrics"]


#: A bitmap holds as many seqs and takes as many bytes, with what a row of it needs besides.
BITMAP_BYTES = 4096 + 64
ROW_BYTES = 24


def first_rows(df: DataFrame, key: str, seq: str) -> DataFrame:
    """Key and seq of the first row of each key; copies collapse before the shuffle."""
    return df.groupBy(key).agg(F.min(seq).alias(seq))


def later_copies(keyed: DataFrame, key: str, seq: str) -> DataFrame:
    """seq of every row that is not the first of its key. Of a hot key one row travels per task to find the first;
    its copies are compared where AQE has split them, as the other side has one row a key."""
    first = keyed.groupBy(key).agg(F.min(seq).alias("_first"), F.count(F.lit(1)).alias("_n"))
    return keyed.join(first.where(F.col("_n") > 1), key).where(F.col(seq) != F.col("_first")).select(seq)


def in_bitmap(bitmap: Column, seq: Column) -> Column:
    """Whether the bit of seq is set in the bitmap of its bucket."""
    position = F.bitmap_bit_position(seq)
    byte = F.conv(F.hex(F.substring(bitmap, F.shiftright(position, 3).cast("int") + 1, F.lit(1))), 16, 10).cast("long")
    return F.getbit(byte, (position % 8).cast("int")) == 1


def without(df: DataFrame, gone: DataFrame, seq: str, max_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """Rows of df whose seq is not in gone (one column of whole numbers).

    Rows of df stay where they are while the smaller of two exact forms of gone fits a broadcast: the numbers, or
    one bit for each in bitmaps of 32,768 (a gigabyte of dense numbers takes 128 MB). Both are staged and
    measured. Beyond that the planner joins by shuffle.
    """
    listed, count = staged_counted(gone.select(seq), "gone")
    if count * ROW_BYTES <= max_bytes:
        return df.join(F.broadcast(listed), seq, "left_anti").select(df.columns)
    bucket = F.bitmap_bucket_number(F.col(seq).cast("long"))
    bits = listed.groupBy(bucket.alias("_bucket")).agg(
        F.bitmap_construct_agg(F.bitmap_bit_position(F.col(seq).cast("long"))).alias("_bits"))
    bits, buckets = staged_counted(bits, "gone-bits")
    if buckets * BITMAP_BYTES > max_bytes:
        return df.join(listed, seq, "left_anti").select(df.columns)
    marked = df.withColumn("_at", bucket).join(F.broadcast(bits), F.col("_at") == F.col("_bucket"), "left")
    kept = F.col("_bits").isNull() | ~in_bitmap(F.col("_bits"), F.col(seq).cast("long"))
    return marked.where(kept).select(df.columns)


def first_seen(df: DataFrame, key: str, seq: str, max_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """Whole rows of the first appearance of each key; seq must be a unique whole number.

    Keys are staged once as (key, seq) rows; everything but the last step works on them. A text with any number of
    copies never meets them in one task, and texts do not move (see without).
    """
    keyed = staged(df.select(key, seq), "keys")
    return without(df, later_copies(keyed, key, seq), seq, max_bytes)


def early_reason(syntax_ok: Column, length_ok: Column) -> Column:
    """First failing check before deduplication, NULL for survivors."""
    return F.when(~syntax_ok, "syntax").when(~length_ok, "char_length")


def drop_counts(
    df: DataFrame, reason: str = "early_reason", key: str = "sha256", error: str = "metrics_error"
) -> DataFrame:
    """Rows dropped per reason, rows kept and rows pulled, as one row; equal texts are judged alike."""
    survivor = F.col(reason).isNull()
    grouped = df.groupBy(
        F.col(reason).alias("reason"),
        F.when(survivor, F.col(key)).alias("content"),
        F.when(survivor, F.col(error).isNotNull()).alias("failed"),
    ).agg(F.count(F.lit(1)).alias("n"))
    return totals(grouped)


def totals(grouped: DataFrame) -> DataFrame:
    """The drop counts of (reason, failed, n) rows, of which those without a reason stand for one text each."""
    n, kept = F.col("n"), F.col("reason").isNull()

    def total(amount: Column, rows: Column, name: str) -> Column:
        return F.coalesce(F.sum(F.when(rows, amount)), F.lit(0)).cast("long").alias(name)

    return grouped.agg(
        total(n, F.col("reason") == "syntax", "syntax"),
        total(n, F.col("reason") == "char_length", "char_length"),
        total(n - 1, kept, "dedup"),
        total(F.lit(1), kept & F.col("failed"), "metrics"),
        total(F.lit(1), kept & ~F.col("failed"), "kept"),
        total(n, F.lit(True), "pulled"),
    )


def with_drop_reason(
    df: DataFrame, seq: str = "seq", key: str = "sha256",
    early: str = "early_reason", error: str = "metrics_error",
) -> DataFrame:
    """Label each row with its first failing reason; NULL marks a kept row."""
    winners = first_rows(df.where(F.col(early).isNull()), key, seq).select(
        seq, F.lit(True).alias("_first")
    )
    reason = (
        F.when(F.col(early).isNotNull(), F.col(early))
        .when(F.col("_first").isNull(), "dedup")
        .when(F.col(error).isNotNull(), "metrics")
    )
    return df.join(winners, seq, "left").withColumn("drop_reason", reason).drop("_first")
