import pytest
from pyspark.sql import functions as F

from metrospect.operators import curation, dedup

CODE = "def f(x):\n    if x:\n        return x\n    return 1  # pad pad pad pad pad pad\n"


@pytest.fixture
def raw(spark):
    rows = [(i, CODE) for i in range(40)]
    rows += [(100 + i, f"value_{i} = {i}  # " + "x" * 60) for i in range(30)]
    rows += [(200, "short"), (201, ""), (202, "# " + "only a comment " * 6), (203, "def f(:" + " " * 60),
             (204, "nul \0 " * 20), (205, None)]
    return spark.createDataFrame(rows, "seq long, content string").repartition(6)


def prepared(raw, profile):
    return curation.prepare(raw, F.coalesce("content", F.lit("")), "seq", profile=profile)


@pytest.mark.parametrize(
    "profile,want",
    [
        # Only the NUL text fails the lexical check; the comment-only text has no metrics.
        ("lexical", dict(syntax=1, char_length=3, dedup=39, metrics=1, kept=32, pulled=76)),
        ("python_ast", dict(syntax=2, char_length=3, dedup=39, metrics=1, kept=31, pulled=76)),
    ],
)
def test_drop_counts_add_up(raw, profile, want):
    row = dedup.drop_counts(prepared(raw, profile)).first().asDict()
    assert row == want
    assert sum(v for k, v in row.items() if k != "pulled") == row["pulled"]
    labels = dedup.with_drop_reason(prepared(raw, profile)).groupBy("drop_reason").count().collect()
    got = {r["drop_reason"] or "kept": r["count"] for r in labels}
    assert got == {k: v for k, v in want.items() if k != "pulled" and v}


@pytest.mark.parametrize("profile", ["lexical", "python_ast"])
def test_curate_keeps_the_first_copy_once(raw, profile):
    kept = curation.curate(raw, F.coalesce("content", F.lit("")), "seq", "seq", profile=profile)
    assert dict(kept.dtypes) == curation.CURATED_TYPES
    rows = kept.collect()
    assert len(rows) == (32 if profile == "lexical" else 31)
    assert [r["id"] for r in rows if r["source"] == CODE] == ["0"]
    again = curation.curate(kept.withColumn("seq", F.col("id").cast("long")), F.col("source"), "seq",
                            "seq", profile=profile)
    assert sorted(r["id"] for r in again.collect()) == sorted(r["id"] for r in rows)


def test_ids_fall_back_to_the_hash(raw):
    kept = curation.curate(raw, F.coalesce("content", F.lit("")), "seq")
    assert all(r["id"] == r["sha256"][:16] for r in kept.collect())


@pytest.mark.parametrize("n", [0, 1, 37, 500, 1000, 5000])
def test_pull_takes_the_first_n_of_the_seeded_order(spark, n):
    df = spark.range(1000).withColumnRenamed("id", "doc").repartition(5)
    got = [r["doc"] for r in curation.pull(df, "doc", n).orderBy("pull_key", "doc").collect()]
    whole = df.orderBy(curation.pull_key("doc", 42), "doc").collect()
    assert got == [r["doc"] for r in whole][:n]
    if n == 500:
        other = [r["doc"] for r in curation.pull(df, "doc", n, seed=7).collect()]
        assert sorted(other) != sorted(got)


@pytest.mark.parametrize("profile", ["lexical", "python_ast"])
def test_judging_each_text_once(raw, profile):
    judged = curation.judged(raw, F.col("content"), "seq", profile=profile)
    texts = raw.select(F.coalesce("content", F.lit("?"))).distinct().count()
    assert judged[1].count() == texts and judged[0].count() == 76
    counts = curation.judged_counts(*judged).first().asDict()
    ready = curation.prepare(raw, F.col("content"), "seq", profile=profile)
    assert counts == dedup.drop_counts(ready).first().asDict()
    assert min(counts.values()) > 0
    rows = {r["seq"]: r["drop_reason"] for r in curation.judged_rows(*judged, "seq").collect()}
    assert rows == {r["seq"]: r["drop_reason"] for r in dedup.with_drop_reason(ready).collect()}


@pytest.mark.parametrize("limit", [1 << 20, 20_000, 10])
def test_without_in_all_three_forms(spark, limit):
    """As a list, as bitmaps, and by shuffle."""
    seqs = [-70_000, -32_768, -1, 0, 1, 32_768, 32_769, 65_536, 2**40, *range(2, 3_000)]
    df = spark.createDataFrame([(s, f"text {s}") for s in seqs], "seq long, text string").repartition(3)
    gone = [s for s in seqs if s % 3 == 0 or s < 0] + [77_777]
    left = dedup.without(df, spark.createDataFrame([(s,) for s in gone], "seq long"), "seq", limit)
    assert sorted(r.seq for r in left.collect()) == sorted(set(seqs) - set(gone)) and left.columns == df.columns


def test_dedup_moves_no_texts(spark, tmp_path):
    """One scan for the hashes, one for the rows, and no exchange between the second scan and the result, with a
    list of copies as with bitmaps."""
    spark.range(60_000).selectExpr("id AS seq", "concat('text ', id % 9000) AS text").write.parquet(str(tmp_path / "t"))
    df = spark.read.parquet(str(tmp_path / "t")).withColumn("sha256", F.sha2("text", 256))
    for limit in (128 << 20, 100_000):
        unique = dedup.first_seen(df, "sha256", "seq", limit)
        plan = unique._jdf.queryExecution().executedPlan().toString()
        assert plan.count("FileScan") == 2 and "hashpartitioning" not in plan.split("BroadcastExchange")[0]
        assert ("bitmap" in plan.lower() or "_bits" in plan) == (limit == 100_000)
        assert unique.count() == 9_000 and unique.agg(F.max("seq")).first()[0] == 8_999
