"""Streaming curation: the batch cascade over arriving files, with exact first-seen dedup.

Each micro-batch works against a stored table of the texts seen before it and writes three folders of its own:

* keys: (sha256, seq) of every text that it saw first, or saw under a smaller seq than before,
* rows: those rows in the curated schema, with seq and metrics_error,
* counts: one row of drop counters.

A batch reads only the keys of earlier batches and overwrites its own folders, so a batch that is run again
after a lost driver gives the same tables, and counters need no progress that a driver remembers. Of a text the row
with the smallest seq stays, as in the batch cascade: where a later batch brings a smaller one, the earlier
row is left out when rows are read.

A batch compares narrow rows only: its own keys are broadcast to the stored ones if they are few, else both are
shuffled by hash. Every batch reads all stored keys (40 bytes a text), so batches should be large.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from metrospect import constants as K
from metrospect.functions import text as tx
from metrospect.functions.lexical import lexically_valid, with_lexical_metrics
from metrospect.operators.curation import CURATED_TYPES, to_curated
from metrospect.operators.dedup import early_reason, later_copies, without
from metrospect.session import broadcast_if_small, staged

KEYS_SCHEMA = "sha256 string, seq long"
ROWS_SCHEMA = ", ".join(f"{name} {kind}" for name, kind in CURATED_TYPES.items()) + ", seq long, metrics_error string"
COUNTERS = ("pulled", "syntax", "char_length", "dedup", "metrics", "kept")
COUNTS_SCHEMA = ", ".join(f"{name} long" for name in COUNTERS)


def read_stream(
    spark: SparkSession, path: str, schema: T.StructType, files_per_batch: int = 100
) -> DataFrame:
    return (
        spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(path)
    )


class Store:
    """The tables of a stream: a folder per table and batch."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        for name, schema in (("keys", KEYS_SCHEMA), ("rows", ROWS_SCHEMA), ("counts", COUNTS_SCHEMA)):
            # A batch before the first, without rows, so that the folder can be read from the start.
            spark.createDataFrame([], schema).coalesce(1).write.mode("overwrite").parquet(self.folder(name, -1))

    def folder(self, name: str, batch_id: int) -> str:
        return f"{self.path}/{name}/batch_id={batch_id}"

    def write(self, df: DataFrame, name: str, batch_id: int) -> DataFrame:
        """Replace a batch's folder and read it again."""
        df.write.mode("overwrite").parquet(self.folder(name, batch_id))
        return self.spark.read.schema(df.schema).parquet(self.folder(name, batch_id))


def read_keys(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(f"{KEYS_SCHEMA}, batch_id long").parquet(f"{path}/keys")


def read_counts(spark: SparkSession, path: str) -> DataFrame:
    """batch_id and the drop counters of every batch."""
    counts = spark.read.schema(f"{COUNTS_SCHEMA}, batch_id long").parquet(f"{path}/counts")
    return counts.where("batch_id >= 0").select("batch_id", *COUNTERS)


def read_kept(spark: SparkSession, path: str) -> DataFrame:
    """The curated rows, of each text that with the smallest seq."""
    rows = spark.read.schema(f"{ROWS_SCHEMA}, batch_id long").parquet(f"{path}/rows")
    keys = read_keys(spark, path).select("sha256", "seq")
    return without(rows.where(F.col("metrics_error").isNull()), later_copies(keys, "sha256", "seq"), "seq").select(*CURATED_TYPES)


def curate_batch(
    store: Store, batch: DataFrame, batch_id: int, source: Column, seq: str, ids: list[str],
    min_chars: int = K.MIN_CHARS, max_chars: int = K.MAX_CHARS,
) -> None:
    """Write keys, rows and counts of one micro-batch; running it again changes nothing."""
    reason = early_reason(lexically_valid("source"), tx.length_ok("source", min_chars, max_chars))
    named = batch.withColumn("source", source).withColumn("seq", F.col(seq).cast("long"))
    hashed = named.select(*dict.fromkeys(["source", "seq", *ids]), reason.alias("reason"), tx.sha256_hex("source").alias("sha256"))
    narrow = staged(hashed.select("seq", "reason", "sha256"), "stream-batch")
    fit = narrow.where(F.col("reason").isNull())
    own = broadcast_if_small(fit.groupBy("sha256").agg(F.min("seq").alias("seq")), "stream-own")
    earlier = read_keys(store.spark, store.path).where(F.col("batch_id") < batch_id)
    known = earlier.select("sha256", F.col("seq").alias("known")).join(own.select("sha256"), "sha256", "left_semi")
    known = known.groupBy("sha256").agg(F.min("known").alias("known"))
    compared = own.join(known, "sha256", "left").where(F.col("known").isNull() | (F.col("seq") < F.col("known")))
    winners = staged(compared, "stream-winners")
    store.write(winners.select("sha256", "seq"), "keys", batch_id)
    losers = fit.select("seq").join(winners.select("seq"), "seq", "left_anti")
    chosen = without(hashed.where(F.col("reason").isNull()), losers, "seq")
    measured = with_lexical_metrics(chosen)
    rows = to_curated(measured, *ids, keep=("seq", "metrics_error"))
    written = store.write(rows, "rows", batch_id)
    # A text that an earlier batch has counted is one more copy here, also where its row is the one to stay.
    again = winners.where(F.col("known").isNotNull()).select("sha256")
    new = written.select("sha256", "metrics_error").join(again, "sha256", "left_anti").agg(
        F.count("metrics_error").alias("metrics"), F.count_if(F.col("metrics_error").isNull()).alias("kept"))
    early = narrow.agg(
        F.count(F.lit(1)).alias("pulled"), F.count_if(F.col("reason") == "syntax").alias("syntax"),
        F.count_if(F.col("reason") == "char_length").alias("char_length"))
    rest = F.col("pulled") - F.col("syntax") - F.col("char_length") - F.col("metrics") - F.col("kept")
    store.write(early.crossJoin(new).withColumn("dedup", rest).select(*COUNTERS), "counts", batch_id)


def start(
    stream: DataFrame, source: Column, seq: str, ids: list[str], out: str, checkpoint: str, **limits: int,
) -> StreamingQuery:
    """Curate until all files present are read; the checkpoint is the resume marker."""
    store = Store(stream.sparkSession, out)
    return (
        stream.writeStream.foreachBatch(lambda batch, batch_id: curate_batch(store, batch, batch_id, source, seq, ids, **limits))
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def run_curation(
    spark: SparkSession, path: str, schema: T.StructType, source: Column, seq: str, ids: list[str],
    out: str, checkpoint: str, files_per_batch: int = 100,
) -> DataFrame:
    """Run the stream over the files present and return the stored drop counters of all batches so far."""
    stream = read_stream(spark, path, schema, files_per_batch)
    start(stream, source, seq, ids, out, checkpoint).awaitTermination()
    return read_counts(spark, out)


ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def configure(spark: SparkSession) -> None:
    """Keep the state of curate_within on disk rather than in memory; a provider that is set already stays."""
    provider = "spark.sql.streaming.stateStore.providerClass"
    if not spark.conf.get(provider, ""):
        spark.conf.set(provider, ROCKSDB)


def curate_within(
    raw: DataFrame, source: Column, *ids: Column | str, event_time: str, delay: str = "1 hour",
    min_chars: int = K.MIN_CHARS, max_chars: int = K.MAX_CHARS,
) -> DataFrame:
    """Streaming rows of the curated schema for endless streams: copies are recognised within the delay of event
    time only, and state stays bounded by it."""
    named = raw.withColumn("source", source)
    reason = early_reason(lexically_valid("source"), tx.length_ok("source", min_chars, max_chars))
    fit = named.where(reason.isNull()).withColumn("sha256", tx.sha256_hex("source"))
    keep = list(dict.fromkeys(["source", "sha256", event_time, *[c for c in ids if isinstance(c, str)]]))
    unique = fit.select(*keep).withWatermark(event_time, delay).dropDuplicatesWithinWatermark(["sha256"])
    return to_curated(with_lexical_metrics(unique).where(F.col("metrics_error").isNull()), *ids)
