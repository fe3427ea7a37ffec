"""Corpus shards: scan, size-bounded sink, manifest."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from metrospect import constants as K
from metrospect.operators.curation import CURATED_TYPES
from metrospect.session import broadcast_if_small, staged

CURATED_SCHEMA = ", ".join(f"{name} {kind}" for name, kind in CURATED_TYPES.items())
STORED_SCHEMA = f"{CURATED_SCHEMA}, shard long"
MANIFEST_SCHEMA = "shard long, path string, row_count long"
#: Leading digits of the content hash that name a range: 4096 of them.
RANGE_DIGITS = 3


def read_corpus(
    spark: SparkSession, path: str, columns: list[str] | None = None, form: str = "parquet",
    schema: T.StructType | str | None = None,
) -> DataFrame:
    """Raw corpus scan; only the wanted columns are read from Parquet."""
    reader = spark.read if schema is None else spark.read.schema(schema)
    df = reader.format(form).load(path)
    return df if columns is None else df.select(*columns)


def shard_starts(narrow: DataFrame, limit: int) -> DataFrame:
    """For each range of content hashes the (first sha256, shard) pairs of the shards in it, ascending.

    Rows stand in a line by hash; a shard takes those that begin within its `limit` bytes of the line. Totals of
    ranges give each range its offset, so only the rows of one range are ordered together.
    """
    keyed = narrow.withColumn("range", F.substring("sha256", 1, RANGE_DIGITS))
    ranges = W.orderBy("range").rowsBetween(W.unboundedPreceding, -1)
    offsets = keyed.groupBy("range").agg(F.sum("bytes").alias("_bytes")).select(
        "range", F.coalesce(F.sum("_bytes").over(ranges), F.lit(0)).alias("_offset"))
    inside = W.partitionBy("range").orderBy("sha256")
    before = F.coalesce(F.sum("bytes").over(inside.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    placed = keyed.join(F.broadcast(offsets), "range").select(
        "range", "sha256", F.floor((F.col("_offset") + before) / limit).cast("long").alias("shard"))
    first = F.coalesce(F.lag("shard").over(inside) != F.col("shard"), F.lit(True))
    return placed.withColumn("_first", first).where("_first").groupBy("range").agg(
        F.sort_array(F.collect_list(F.struct("sha256", "shard"))).alias("starts"))


def write_shards(
    curated: DataFrame, path: str, shard_size_mb: float = K.SHARD_SIZE_MB, source: str = "source"
) -> None:
    """Write shards of shard_size_mb of source text each, to within one row, one folder a shard.

    curated is computed once: its rows are staged with their sizes, the shards are found on (hash, size) alone, and
    texts move once, to their shard. The content hash is unique after dedup; a retried task writes the same rows.
    """
    rows = staged(curated.withColumn("bytes", F.octet_length(source).cast("long")), "to-shard")
    starts = shard_starts(rows.select("sha256", "bytes"), max(1, int(shard_size_mb * 1024 * 1024)))
    reached = F.filter("starts", lambda start: start["sha256"] <= F.col("sha256"))
    numbered = rows.withColumn("range", F.substring("sha256", 1, RANGE_DIGITS)).join(
        broadcast_if_small(starts, "shard-starts"), "range")
    sharded = numbered.select(*CURATED_TYPES, F.element_at(reached, -1)["shard"].alias("shard"))
    dealt = sharded.repartition("shard").sortWithinPartitions("shard")
    dealt.write.mode("overwrite").partitionBy("shard").parquet(path)


def read_shards(spark: SparkSession, path: str, columns: list[str] | None = None) -> DataFrame:
    """All shards of a folder with the declared schema, optionally some columns."""
    df = spark.read.schema(STORED_SCHEMA).parquet(path)
    return df.select(*(columns or CURATED_TYPES))


def manifest(spark: SparkSession, path: str) -> DataFrame:
    """(shard, path, row_count) of every shard."""
    shards = spark.read.schema(STORED_SCHEMA).parquet(path)
    return shards.groupBy("shard", F.col("_metadata.file_path").alias("path")).agg(F.count(F.lit(1)).alias("row_count"))


def manifest_totals(shards: DataFrame) -> DataFrame:
    return shards.agg(
        F.count(F.lit(1)).alias("n_shards"),
        F.coalesce(F.sum("row_count"), F.lit(0)).alias("total_rows"),
    ).withColumn("schema_version", F.lit(K.SCHEMA_VERSION))


def write_manifest(shards: DataFrame, path: str) -> None:
    shards.write.mode("overwrite").json(path)


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(MANIFEST_SCHEMA).json(path)


def read_listed_shards(
    spark: SparkSession, path: str, shards: DataFrame, columns: list[str] | None = None
) -> DataFrame:
    """Read exactly the shards that a manifest lists. The list stays a table: Spark prunes the folders of other
    shards while the query runs, and no path goes through the driver's code."""
    listed = broadcast_if_small(shards.where(F.col("row_count") > 0).select("shard").distinct(), "listed").where(F.col("shard") >= 0)
    return spark.read.schema(STORED_SCHEMA).parquet(path).join(listed, "shard", "left_semi").select(*(columns or CURATED_TYPES))
