"""Mixing sources to target weights along a time-varying curriculum.

Every source has a target in words and a weight schedule over training time (knots joined by straight
lines). The schedule is integrated; the integral, scaled to the target, is the source's cumulative demand.
Documents stand in a line per source, as often as its epochs ask; inverting the demand at the middle of a
document gives its training position in [0, 1], and the mix is range-sorted by position.

Only DataFrame functions run here. The line of a source is cut into 4096 cells by hash, cells get
their offsets first and rows afterwards within their cell, so a hot source never meets in one task. Tables
of sources (one narrow row each) are ordered in one task.

Defined cases: null text has size 0; a null source is a source, last in order; null ids stand together;
rows alike in doc_id, source and text are one run of equal rows and all kept; documents without words are
taken zero times; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from metrospect.session import staged

WORD = r"[^\x20\x09-\x0D]+"
MOST = 3
BEFORE = (Window.unboundedPreceding, -1)


def sized(docs: DataFrame) -> DataFrame:
    """doc_id, source, size, text_hash, order_key and cell of each row."""
    key = F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary"))
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    return docs.select(
        "doc_id", F.col("source").cast("string").alias("source"),
        F.regexp_count(text, F.lit(WORD)).cast("long").alias("size"),
        F.xxhash64(text).alias("text_hash"),
        key.alias("order_key"), F.conv(F.substring(key, 1, 3), 16, 10).cast("int").alias("cell"),
    )


def targets(rows: DataFrame, most: int = MOST) -> DataFrame:
    """source, weight, source_size, target: sources weigh 1, 2, 3, repeating, in code point order (null
    last) and share the sum of all sizes; no target exceeds `most` times its source's size.

    A source is full if the share left to it, once every source with a smaller cap per weight is full,
    reaches its cap; the others share the rest by weight.
    """
    everything = Window.partitionBy()
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    per = rows.groupBy("source").agg(F.sum("size").alias("source_size"))
    per = per.withColumn("weight", ((F.row_number().over(by_name) - 1) % 3 + 1).cast("long")).withColumn("cap", most * F.col("source_size"))
    fill_order = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last())
    per = per.select(
        "*",
        F.sum("source_size").over(everything).alias("total"), F.sum("weight").over(everything).alias("weights"),
        F.coalesce(F.sum("cap").over(fill_order.rowsBetween(*BEFORE)), F.lit(0)).alias("cap_before"),
        F.coalesce(F.sum("weight").over(fill_order.rowsBetween(*BEFORE)), F.lit(0)).alias("weight_before"),
    )
    full = F.col("cap") * (F.col("weights") - F.col("weight_before")) <= F.col("weight") * (F.col("total") - F.col("cap_before"))
    per = per.withColumn("full", full)
    per = per.select(
        "*",
        F.coalesce(F.sum(F.when(F.col("full"), F.col("cap"))).over(everything), F.lit(0)).alias("cap_full"),
        F.coalesce(F.sum(F.when(F.col("full"), F.col("weight"))).over(everything), F.lit(0)).alias("weight_full"),
    )
    shared = (F.col("weight").cast("double") * (F.col("total") - F.col("cap_full")).cast("double")
              / (F.col("weights") - F.col("weight_full")).cast("double"))
    target = F.when(F.col("full"), F.col("cap").cast("double")).otherwise(shared)
    return per.select("source", "weight", "source_size", target.alias("target"))


def default_knots(weight: Column) -> Column:
    """Sources of weight 1 fade out over training, those of weight 3 fade in, the others stay even."""
    start = F.when(weight == 1, 1.5).when(weight == 3, 0.5).otherwise(1.0)
    knot = lambda at, height: F.struct(F.lit(at).cast("double").alias("at"), height.cast("double").alias("height"))
    return F.array(knot(0.0, start), knot(1.0, F.lit(2.0) - start))


def integrated(knots: Column) -> Column:
    """Pieces of a schedule: where each begins, its height there, its slope and the area before and after."""
    empty = F.array().cast("array<struct<at:double,height:double,slope:double,before:double,after:double>>")

    def add(done, i):
        left, right = knots[i - 1], knots[i]
        width = right["at"] - left["at"]
        before = F.coalesce(F.try_element_at(done, F.lit(-1))["after"], F.lit(0.0))
        piece = F.struct(
            left["at"].alias("at"), left["height"].alias("height"),
            F.coalesce(F.try_divide(right["height"] - left["height"], width), F.lit(0.0)).alias("slope"),
            before.alias("before"), (before + width * (left["height"] + right["height"]) / 2).alias("after"),
        )
        return F.concat(done, F.array(piece))

    return F.aggregate(F.sequence(F.lit(1), F.size(knots) - 1), empty, add)


def inverted(pieces: Column, share: Column) -> Column:
    """The time at which the integral of a schedule has reached the given share of its whole."""
    area = share * F.element_at(pieces, -1)["after"]
    piece = F.coalesce(F.try_element_at(F.filter(pieces, lambda p: p["after"] >= area), F.lit(1)), F.element_at(pieces, -1))
    wanted = area - piece["before"]
    root = piece["height"] + F.sqrt(F.greatest(piece["height"] * piece["height"] + 2 * piece["slope"] * wanted, F.lit(0.0)))
    return piece["at"] + F.when(root > 0, 2 * wanted / root).otherwise(0.0)


def mix(docs: DataFrame, schedules: DataFrame | None = None, most: int = MOST) -> DataFrame:
    """A row per document: doc_id, source, size, text_hash, source_size, target, taken and uses, the
    array of (epoch, words, position) in which it is trained on.

    A source is passed through whole as often as its target allows; the last pass ends after the words
    that are still wanted, inside the last document if need be. schedules may give (source, knots:
    array<struct<at, height>>, ascending from 0 to 1).
    """
    rows = staged(sized(docs), "mix-sizes")
    runs = rows.groupBy("source", "cell", "order_key", "doc_id", "size", "text_hash").agg(F.count("*").alias("n"))
    per = targets(rows, most)
    if schedules is None:
        per = per.withColumn("knots", default_knots(F.col("weight")))
    else:
        own = schedules.select(F.col("source").alias("of"), F.col("knots").alias("own"))
        per = per.join(own, F.col("source").eqNullSafe(F.col("of")), "left").withColumn(
            "knots", F.coalesce("own", default_knots(F.col("weight"))))
    wanted = F.floor(F.col("target") + 0.5).cast("long")
    per = per.select(
        F.col("source").alias("of"), "source_size", "target", wanted.alias("wanted"), integrated(F.col("knots")).alias("pieces"))
    in_source = Window.partitionBy("source").orderBy("cell").rowsBetween(*BEFORE)
    cells = (
        rows.groupBy("source", "cell").agg(F.sum("size").alias("cell_size"))
        .withColumn("cell_start", F.coalesce(F.sum("cell_size").over(in_source), F.lit(0)))
        .join(per, F.col("source").eqNullSafe(F.col("of")))
        .select("of", F.col("cell").alias("of_cell"), "cell_start", "source_size", "target", "wanted", "pieces")
    )
    in_cell = Window.partitionBy("source", "cell").orderBy("order_key", "doc_id", "size", "text_hash").rowsBetween(*BEFORE)
    line = runs.withColumn("run_start", F.coalesce(F.sum(F.col("n") * F.col("size")).over(in_cell), F.lit(0)))
    line = line.join(cells, F.col("source").eqNullSafe(F.col("of")) & (F.col("cell") == F.col("of_cell")))
    line = line.withColumn("copy", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1)))
    line = line.withColumn("start", F.col("cell_start") + F.col("run_start") + F.col("copy") * F.col("size"))
    whole = F.coalesce(F.try_divide(F.col("wanted"), F.col("source_size")).cast("long"), F.lit(0))
    line = line.withColumn("whole", whole)
    last = F.greatest(F.lit(0), F.least(F.col("size"), F.col("wanted") - F.col("whole") * F.col("source_size") - F.col("start")))

    def use(epoch):
        words = F.when(epoch < F.col("whole"), F.col("size")).otherwise(last)
        middle = F.try_divide(epoch * F.col("source_size") + F.col("start") + words / 2, F.col("wanted"))
        return F.struct(
            epoch.cast("int").alias("epoch"), words.cast("long").alias("words"),
            inverted(F.col("pieces"), middle).alias("position"))

    uses = F.filter(F.transform(F.sequence(F.lit(0).cast("long"), F.col("whole")), use), lambda u: u["words"] > 0)
    return line.select(
        "doc_id", "source", "size", "text_hash", "source_size", "target",
        (F.col("size") * F.col("whole") + last).cast("long").alias("taken"), uses.alias("uses"))


def training_order(mixed: DataFrame, partitions: int | None = None) -> DataFrame:
    """One row per use of a document, range-sorted by training position."""
    uses = mixed.select("doc_id", "source", "text_hash", "size", F.explode("uses").alias("use")).select(
        "doc_id", "source", "text_hash", "size", "use.epoch", "use.words", "use.position")
    keys = ("position", "source", "doc_id", "epoch")
    spread = uses.repartitionByRange(partitions, *keys) if partitions else uses.repartitionByRange(*keys)
    return spread.sortWithinPartitions(*keys)


def by_first_use(mixed: DataFrame) -> DataFrame:
    """mix()'s rows with first_position, the training position of their first use (null: never used), range-sorted
    by it; those never used come last."""
    placed = mixed.withColumn("first_position", F.try_element_at("uses", F.lit(1))["position"])
    keys = (F.col("first_position").asc_nulls_last(), F.col("source"), F.col("doc_id"))
    return placed.repartitionByRange(*keys).sortWithinPartitions(*keys)


def mixed_rows(docs: DataFrame) -> DataFrame:
    """All columns of docs, one row per use, range-sorted by training position.

    Texts stay whole: a use of a part of a document is rounded, to the whole of it from half on, else to none.
    Of rows alike in doc_id, source and text one is read for all.
    """
    # One key column for both steps, in which null fields are equal: rows dealt by it once serve the join too.
    # coalesce gives both keys one type: a staged hash may be null for the planner, a computed one not.
    key = lambda text_hash, doc_id, source: F.struct(
        F.coalesce(text_hash, F.lit(0)).alias("text_hash"), doc_id.alias("doc_id"), source.alias("source"))
    whole = F.filter("uses", lambda use: use["words"] * 2 >= F.col("size"))
    uses = mix(docs).select(
        key(F.col("text_hash"), F.col("doc_id"), F.col("source")).alias("key"), F.explode(whole).alias("use"))
    text = F.coalesce(F.col("row.text").cast("string"), F.lit(""))
    rows = docs.select(F.struct("*").alias("row")).select(
        "row", key(F.xxhash64(text), F.col("row.doc_id"), F.col("row.source").cast("string")).alias("key")).dropDuplicates(["key"])
    order = (F.col("use.position"), F.col("key.source"), F.col("key.doc_id"), F.col("use.epoch"))
    used = rows.join(uses, "key").repartitionByRange(*order).sortWithinPartitions(*order)
    return used.select(*[F.col("row").getField(name).alias(name) for name in docs.columns])
