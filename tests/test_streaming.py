from pyspark.sql import functions as F

from metrospect.operators import curation, dedup
from metrospect.plans import inputs, queries
from metrospect.streaming import curation as stream

COLUMNS = ["id", "sha256", "cc", "sloc", "split"]


def rows(df):
    return sorted(tuple(r) for r in df.select(COLUMNS).collect())


def test_stream_equals_batch_over_two_restarts(spark, sf_dir, tmp_path):
    """Copies with smaller seqs arrive last, so rows that were kept must give way."""
    docs = inputs.table(spark, sf_dir, "documents").withColumnRenamed("doc_id", "seq")
    arrivals, out, state = (str(tmp_path / n) for n in ("in", "out", "state"))
    parts = [docs.where("seq >= 120"), docs.where("seq between 60 and 119"), docs.where("seq < 60")]
    for i, part in enumerate(parts):
        part.repartition(2).write.mode("append").parquet(arrivals)
        counts = stream.run_curation(spark, arrivals, docs.schema, F.col("text"), "seq", ["seq"], out, state, 1)
        assert [r.batch_id for r in counts.orderBy("batch_id").collect()] == list(range(2 * i + 2))
        seen = parts[0]
        for more in parts[1:i + 1]:
            seen = seen.unionAll(more)
        assert rows(stream.read_kept(spark, out)) == rows(curation.curate(seen, F.col("text"), "seq", "seq"))
        want = dedup.drop_counts(curation.prepare(seen, F.col("text"), "seq")).first().asDict()
        assert counts.agg(*[F.sum(c).alias(c) for c in want]).first().asDict() == want
    keys = stream.read_keys(spark, out)
    assert keys.count() > keys.select("sha256").distinct().count()


def test_a_replayed_batch_changes_nothing(spark, sf_dir, tmp_path):
    docs = inputs.table(spark, sf_dir, "documents").withColumnRenamed("doc_id", "seq")
    store = stream.Store(spark, str(tmp_path / "out"))
    batches = [docs.where("seq >= 100"), docs.where("seq < 100")]

    def tables():
        counts = sorted(map(tuple, stream.read_counts(spark, store.path).collect()))
        return rows(stream.read_kept(spark, store.path)), counts, sorted(map(tuple, stream.read_keys(spark, store.path).collect()))

    for i, batch in enumerate(batches):
        stream.curate_batch(store, batch, i, F.col("text"), "seq", ["seq"])
    once = tables()
    stream.curate_batch(store, batches[1], 1, F.col("text"), "seq", ["seq"])
    stream.Store(spark, store.path)
    assert tables() == once and len(once[1]) == 2


def test_empty_and_odd_batches(spark, tmp_path):
    text = "some text " * 9
    df = spark.createDataFrame([(5, text), (3, text), (9, None), (8, "x"), (7, "a\0b" * 30), (6, "# c " * 30)], "n long, text string")
    store = stream.Store(spark, str(tmp_path / "out"))
    stream.curate_batch(store, df.limit(0), 0, F.col("text"), "n", ["n"])
    stream.curate_batch(store, df, 1, F.col("text"), "n", ["n"])
    stream.curate_batch(store, spark.createDataFrame([(1, text), (4, text)], df.schema), 2, F.col("text"), "n", ["n"])
    counts = [tuple(r) for r in stream.read_counts(spark, store.path).orderBy("batch_id").collect()]
    assert counts == [(0, 0, 0, 0, 0, 0, 0), (1, 6, 2, 1, 1, 1, 1), (2, 2, 0, 0, 2, 0, 0)]
    assert [r.id for r in stream.read_kept(spark, store.path).collect()] == ["1"]


def test_event_time_bounds_the_state(spark, tmp_path):
    rows = [(f"2024-01-01 00:0{i % 6}:00", f"text {i % 3} " + "x" * 60) for i in range(24)]
    df = spark.createDataFrame(rows, "ts string, text string").withColumn("ts", F.to_timestamp("ts"))
    arrivals, out, state = (str(tmp_path / n) for n in ("in", "out", "state"))
    df.repartition(2).write.parquet(arrivals)
    stream.configure(spark)
    curated = stream.curate_within(stream.read_stream(spark, arrivals, df.schema), F.col("text"), event_time="ts", delay="1 hour")
    curated.writeStream.format("parquet").option("checkpointLocation", state).trigger(availableNow=True).start(out).awaitTermination()
    assert spark.read.parquet(out).count() == 3


def test_arriving_files_follow_the_table(spark, sf_dir, tmp_path, monkeypatch):
    """A table of many splits arrives in as many files a batch, so that none of them grows with it."""
    inputs.table(spark, sf_dir, "documents").repartition(9).write.parquet(str(tmp_path / "documents.parquet"))
    monkeypatch.setattr(queries, "scratch_path", lambda _, label: str(tmp_path / label))
    size = max(f.stat().st_size for f in (tmp_path / "documents.parquet").glob("part-*"))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", str(size))
    spark.conf.set("spark.sql.files.openCostInBytes", "0")
    try:
        counts = queries.REGISTRY["stream_drop_counts"](spark, str(tmp_path)).first()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
        spark.conf.unset("spark.sql.files.openCostInBytes")
    assert len(list((tmp_path / "arrivals").glob("part-*"))) > 4
    assert counts == queries.REGISTRY["drop_reason_counts"](spark, sf_dir).select(counts.__fields__).first()
