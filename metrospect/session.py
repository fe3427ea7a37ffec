"""Session set-up and the shared folder for staged tables."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

# A table may be broadcast when its rows, written out as text, take no more than this.
BROADCAST_BYTES = 128 << 20


def local_session(cores: int | str = "*", app: str = "metrospect", **conf: str) -> SparkSession:
    """A session for tests and the bench; on a cluster use the session the cluster provides."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "8g")
        .config("spark.sql.adaptive.enabled", "true")
    )
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_folder(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir; only a local master may fall back to a temp folder."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder.rstrip("/")
    folder = spark.sparkContext.getCheckpointDir()
    if folder:
        return folder.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors can reach")
    folder = tempfile.mkdtemp(prefix="metrospect-")
    spark.sparkContext.setCheckpointDir(folder)
    return folder


def scratch_path(spark: SparkSession, label: str) -> str:
    """A path in the shared folder that nobody else uses."""
    return f"{shared_folder(spark)}/metrospect/{label}-{uuid.uuid4().hex}"


def staged(df: DataFrame, label: str, partition_by: tuple[str, ...] = ()) -> DataFrame:
    """Write df to the shared folder and read it back.

    Cuts the lineage before a result that several later steps read, so that lost executors never
    cause the text metrics to be computed again, and gives the planner real sizes and column pruning.
    """
    spark = df.sparkSession
    path = scratch_path(spark, label)
    writer = df.write.mode("overwrite")
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def _staged_observed(df: DataFrame, label: str, measure: Column) -> tuple[DataFrame, int]:
    seen = Observation()
    table = staged(df.observe(seen, F.coalesce(measure, F.lit(0)).alias("total")), label)
    return table, int(seen.get["total"])


def staged_counted(df: DataFrame, label: str) -> tuple[DataFrame, int]:
    """staged, and the number of rows, counted while they are written."""
    return _staged_observed(df, label, F.count(F.lit(1)))


def broadcast_if_small(df: DataFrame, label: str, max_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """Stage a table and mark it for broadcast only when the measured bytes of its rows allow it.

    Saves the shuffle of a wide table on the other side of a join; beyond max_bytes the planner joins
    by shuffle as usual.
    """
    written = F.octet_length(F.to_json(F.struct(*df.columns)))
    table, size = _staged_observed(df, label, F.sum(written))
    return F.broadcast(table) if size <= max_bytes else table


def spread(scan: DataFrame, key: str) -> DataFrame:
    """Spread a scan that would leave half of the cores idle, before heavy text work.

    A large table has splits enough and passes through untouched, so its texts are never shuffled here;
    a table of one small file would otherwise be measured by a single task.
    """
    cores = scan.sparkSession.sparkContext.defaultParallelism
    return scan if scan.rdd.getNumPartitions() * 2 > cores else scan.repartition(cores, key)
