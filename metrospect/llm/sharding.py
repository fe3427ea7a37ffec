"""Shards from fixed virtual slots and a versioned slot-to-shard map.

A record hashes to one of SLOTS virtual slots by its text, so equal texts share a slot. Bytes are summed
per slot and the slots are dealt to shards, heaviest first, each to the lightest shard so far. The map is
a small table with a version; growing the number of shards edits it by moving slots into the new shard
only. A slot heavier than a shard's fair share (a huge group of equal texts) is divided into pieces by
doc_id, as no map could balance it otherwise.

Only DataFrame functions run here. The map has at most SLOTS + PIECES * shards rows whatever the data, so
it may be folded in one row and broadcast.

Defined cases: a null text counts as empty (size 1); a null doc_id is a value like any other; repeated
rows are all kept, each with its own place; an empty table gives an empty result; other columns are
neither read nor returned.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from metrospect.session import staged

SLOTS = 4096
CELLS = 64
PIECES = 4


def records(docs: DataFrame, slots: int = SLOTS) -> DataFrame:
    """doc_id, size, text_crc32, vslot of each row: all that sharding needs of a text."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    return docs.select(
        "doc_id",
        (F.octet_length(text) + 1).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
        F.pmod(F.xxhash64(text), F.lit(slots)).cast("int").alias("vslot"),
    )


def with_pieces(rows: DataFrame, shards: int) -> DataFrame:
    """Add piece: 0, or a number by doc_id where a slot outweighs the fair share of a shard."""
    slot_bytes = rows.groupBy("vslot").agg(F.sum("size").alias("slot_bytes"))
    fair = F.sum("slot_bytes").over(Window.partitionBy()) / shards
    pieces = slot_bytes.select(
        F.col("vslot").alias("heavy"),
        F.ceil(PIECES * F.col("slot_bytes") / fair).cast("int").alias("pieces"),
        (F.col("slot_bytes") > fair).alias("is_heavy"),
    ).where("is_heavy")
    divided = F.pmod(F.xxhash64("doc_id"), F.col("pieces")).cast("int")
    return (
        rows.join(F.broadcast(pieces), F.col("vslot") == F.col("heavy"), "left")
        .withColumn("piece", F.when(F.col("pieces").isNull(), 0).otherwise(divided))
        .drop("heavy", "pieces", "is_heavy")
    )


def unit_sizes(rows: DataFrame) -> DataFrame:
    """Bytes and rows of each (vslot, piece)."""
    return rows.groupBy("vslot", "piece").agg(F.sum("size").alias("bytes"), F.count("*").alias("rows"))


def slot_map(units: DataFrame, shards: int, version: int = 0) -> DataFrame:
    """version, vslot, piece, bytes, rows, shard: the heaviest unit goes to the lightest shard so far."""
    heaviest_first = F.sort_array(
        F.collect_list(F.struct((-F.col("bytes")).alias("order"), "vslot", "piece", "bytes", "rows"))
    )
    empty = F.struct(
        F.array_repeat(F.lit(0).cast("long"), shards).alias("loads"),
        F.array().cast("array<int>").alias("chosen"),
    )

    def place(state, unit):
        lightest = (F.array_position(state["loads"], F.array_min(state["loads"])) - 1).cast("int")
        loads = F.transform(
            state["loads"], lambda load, i: F.when(i == lightest, load + unit["bytes"]).otherwise(load)
        )
        return F.struct(loads.alias("loads"), F.concat(state["chosen"], F.array(lightest)).alias("chosen"))

    return (
        units.agg(heaviest_first.alias("units"))
        .withColumn("chosen", F.aggregate("units", empty, place)["chosen"])
        .select(F.explode(F.arrays_zip("units", "chosen")).alias("pair"))
        .select(
            F.lit(version).alias("version"), "pair.units.vslot", "pair.units.piece",
            "pair.units.bytes", "pair.units.rows", F.col("pair.chosen").alias("shard"),
        )
    )


def grown(current: DataFrame, shards: int) -> DataFrame:
    """The next version of a map for one more shard: every shard gives up what it has above the new
    fair share, and slots move into the new shard (number `shards`) only."""
    per_shard = Window.partitionBy("shard")
    running = F.sum("bytes").over(per_shard.orderBy("bytes", "vslot", "piece").rowsBetween(Window.unboundedPreceding, 0))
    load = F.sum("bytes").over(per_shard)
    fair = F.sum("bytes").over(Window.partitionBy()) / (shards + 1)
    moves = running <= load - fair
    return current.select(
        (F.col("version") + 1).alias("version"), "vslot", "piece", "bytes", "rows",
        F.when(moves, shards).otherwise(F.col("shard")).cast("int").alias("shard"),
    )


def save_map(current: DataFrame, path: str) -> None:
    """Append a version of the map; earlier versions stay readable. A version that is written again
    replaces itself only."""
    (current.write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
     .partitionBy("version").parquet(path))


def load_map(spark, path: str, version: int | None = None) -> DataFrame:
    """A stored version of the map, the latest by default."""
    table = spark.read.parquet(path)
    if version is not None:
        return table.where(F.col("version") == version)
    latest = table.agg(F.max("version").alias("latest"))
    return table.join(F.broadcast(latest), F.col("version") == F.col("latest")).drop("latest")


def placed(rows: DataFrame, current: DataFrame) -> DataFrame:
    """Rows with their shard and their gapless place in it (slot).

    Places come from three levels, so no task sees a whole shard: units within a shard, CELLS cells
    within a unit, rows within a cell. Rows alike in every column are numbered as one run.
    """
    runs = (
        rows.withColumn("cell", F.pmod(F.xxhash64("doc_id", "size"), F.lit(CELLS)).cast("int"))
        .groupBy("vslot", "piece", "cell", "doc_id", "size", "text_crc32")
        .agg(F.count("*").alias("n"))
    )
    before = (Window.unboundedPreceding, -1)
    unit_start = F.coalesce(
        F.sum("rows").over(Window.partitionBy("shard").orderBy("vslot", "piece").rowsBetween(*before)), F.lit(0))
    units = F.broadcast(current.select("vslot", "piece", "shard", unit_start.alias("unit_start")))
    in_unit = Window.partitionBy("vslot", "piece").orderBy("cell").rowsBetween(*before)
    cells = (
        runs.groupBy("vslot", "piece", "cell").agg(F.sum("n").alias("cell_rows"))
        .withColumn("cell_start", F.coalesce(F.sum("cell_rows").over(in_unit), F.lit(0)))
        .drop("cell_rows")
    )
    in_cell = (Window.partitionBy("vslot", "piece", "cell")
               .orderBy("doc_id", "size", "text_crc32").rowsBetween(*before))
    run_start = F.coalesce(F.sum("n").over(in_cell), F.lit(0))
    first = F.col("unit_start") + F.col("cell_start") + F.col("run_start")
    return (
        runs.withColumn("run_start", run_start)
        .join(cells, ["vslot", "piece", "cell"])
        .join(units, ["vslot", "piece"])
        .withColumn("slot", F.explode(F.sequence(first, first + F.col("n") - 1)))
        .select("doc_id", "size", "text_crc32", "shard", "slot", "vslot", "piece")
    )


def shard(docs: DataFrame, shards: int = 8, slots: int = SLOTS, map_path: str | None = None) -> DataFrame:
    """doc_id, size, text_crc32, shard, slot, vslot, piece of every row; sizes of shards near equal.

    The texts are read once; what is needed of them is staged as a narrow table. The map goes to
    map_path, if given, as version 0.
    """
    rows = staged(with_pieces(staged(records(docs, slots), "shard-records"), shards), "shard-units")
    current = staged(slot_map(unit_sizes(rows), shards), "shard-map")
    if map_path:
        save_map(current, map_path)
    return placed(rows, current)
