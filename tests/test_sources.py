import hashlib
import json

import pytest
from pyspark.sql import functions as F

from metrospect.operators import probes
from metrospect.sources import corpus, records, tables


def lines(path, *rows):
    path.mkdir()
    (path / "part.txt").write_text("\n".join(rows) + "\n")
    return str(path)


def test_jsonl_skips_blanks_and_null_metrics(spark, tmp_path):
    metrics = dict(cc=1, mi=2.0, comment_ratio=0.5, h_volume=1.0, h_difficulty=1.0, h_effort=1.0, sloc=3)
    path = lines(tmp_path / "in", json.dumps({"task_id": "a", "metrics": metrics}), "", "  ",
                 json.dumps({"task_id": "b", "generation_id": 4, "metrics": None}),
                 json.dumps({"task_id": "c", "generation_id": 4, "metrics": {"cc": 2}}))
    rows = {r["task_id"]: r for r in records.read_metric_rows(spark, path).collect()}
    assert set(rows) == {"a", "c"}
    assert rows["a"]["generation_id"] == 0 and rows["c"]["generation_id"] == 4
    assert rows["c"]["mi"] is None
    out = str(tmp_path / "out")
    records.write_jsonl(records.read_jsonl(spark, path).where("task_id is not null"), out)
    assert records.read_jsonl(spark, out).count() == 3


def test_verdict_documents(spark, tmp_path):
    path = lines(
        tmp_path / "in",
        json.dumps({"eval": {"a": [{"status": "PASS"}, {"status": "fail"}], "x": "note"}, "date": "d"}),
        json.dumps({"b": [{"time": 1}, {"status": "pass"}], "n": 3, "m": {"status": "pass"}}),
    )
    got = {(r["task_id"], r["generation_id"]): r["passed"]
           for r in records.read_verdicts(spark, path).collect()}
    assert got == {("a", 0): True, ("a", 1): False, ("b", 0): False, ("b", 1): True}


def test_verdict_documents_of_any_layout(spark, tmp_path):
    one = {"eval": {"t1": [{"status": "pass"}, {"status": "fail"}], "n": {"status": "pass"}}, "date": "d"}
    two = {"t2": [{"status": "PASS"}, {"time": 1}, 7, {"status": None}, {"status": 5}], "eval": [1]}
    want = {("t1", 0, "pass", True), ("t1", 1, "fail", False), ("t2", 0, "PASS", True), ("t2", 1, None, False), ("t2", 2, None, False),
            ("t2", 3, None, False), ("t2", 4, "5", False), ("eval", 0, None, False)}
    layouts = {
        "lines": json.dumps(one) + "\n\n" + json.dumps(two), "indented": json.dumps(one, indent=2) + "\n" + json.dumps(two, indent=4),
        "glued": json.dumps(one) + json.dumps(two)}
    for name, text in layouts.items():
        (tmp_path / f"{name}.json").write_text(text)
        got = [tuple(r) for r in records.read_verdicts(spark, str(tmp_path / f"{name}.json")).collect()]
        assert set(got) == want and len(got) == len(want), name
    assert {tuple(r) for r in records.read_verdicts(spark, str(tmp_path / "lines.json"), per_line=True).collect()} == want
    (tmp_path / "blank.json").write_text(" \n")
    assert records.read_verdicts(spark, str(tmp_path / "blank.json")).count() == 0
    for name, text in {"cut": '{"a": [{"status": "pa', "junk": "pass", "list": "[]", "tail": json.dumps(one) + "}"}.items():
        (tmp_path / f"{name}.json").write_text(text)
        with pytest.raises(Exception, match="JSONDecodeError|ValueError"):
            records.read_verdicts(spark, str(tmp_path / f"{name}.json")).collect()


def test_a_verdict_document_of_a_hundred_megabytes(spark, tmp_path):
    tasks, each = 2_500, 500
    results = json.dumps([{"status": "pass" if i % 3 else "fail", "time": "x" * 60} for i in range(each)], indent=1)
    with open(tmp_path / "big.json", "w") as out:
        out.write('{"eval": {' + ",".join(f'"task/{t}": {results}' for t in range(tasks)) + "}}")
    assert (tmp_path / "big.json").stat().st_size > 100 << 20
    row = records.read_verdicts(spark, str(tmp_path / "big.json")).groupBy().agg(
        F.count("*").alias("n"), F.countDistinct("task_id").alias("tasks"), F.count_if("passed").alias("passed")).first()
    assert tuple(row) == (tasks * each, tasks, tasks * sum(i % 3 > 0 for i in range(each)))


def test_summaries_take_keys_from_their_names(spark, tmp_path):
    body = {"pass_at_k": {"pass@1": 0.4}, "metric_deltas": {"mi": {"mean_pct_delta": 1.5,
                                                                    "std_pct_delta": 2.0}}}
    for name in ("pass1_full_aa_mi_a-0.5_p10_summary.json", "pass1_full_aa_base_p10_summary.json",
                 "other_summary.json"):
        (tmp_path / name).write_text(json.dumps(body))
    rows = {r["alpha"]: r for r in records.read_summaries(spark, str(tmp_path), ["aa"], ["mi"]).collect()}
    assert set(rows) == {-0.5, 0.0}
    assert tuple(rows[-0.5])[4:] == (0.4, 1.5, 2.0) and rows[0.0]["mean_delta"] is None


def test_shards_and_manifest(spark, tmp_path):
    """Shards are full to within one row, the input is computed once, and listed shards are read alone."""
    sizes = [(i * 37) % 1900 + 1 for i in range(500)]
    rows = [(str(i), "é" * (n // 2) + "x" * (n % 2), hashlib.sha256(str(i).encode()).hexdigest(), 1, 1.0, 0.0, 1.0, 1.0, 1.0, 1, "train")
            for i, n in enumerate(sizes)]
    computed = spark.sparkContext.accumulator(0)

    def counted(batches):
        for batch in batches:
            computed.add(batch.num_rows)
            yield batch

    frame = spark.createDataFrame(rows, corpus.CURATED_SCHEMA).repartition(4)
    path, listing, limit = str(tmp_path / "shards"), str(tmp_path / "manifest"), 10_000
    corpus.write_shards(frame.mapInArrow(counted, frame.schema), path, shard_size_mb=limit / 2**20)
    assert computed.value == 500
    shards = corpus.manifest(spark, path)
    row = corpus.manifest_totals(shards).first()
    assert (row["n_shards"], row["total_rows"], row["schema_version"]) == (-(-sum(sizes) // limit), 500, 1)
    loads = spark.read.parquet(path).groupBy("shard").agg(F.sum(F.octet_length("source")).alias("b")).orderBy("shard").collect()
    assert [r.shard for r in loads] == list(range(len(loads)))
    assert all(limit - max(sizes) < r.b < limit + max(sizes) for r in loads[:-1]) and sum(r.b for r in loads) == sum(sizes)
    corpus.write_manifest(shards, listing)
    back = corpus.read_listed_shards(spark, path, corpus.read_manifest(spark, listing), ["id"])
    assert back.count() == 500 and back.columns == ["id"]
    some = corpus.read_listed_shards(spark, path, shards.where("shard IN (1, 3)"), ["id", "source"])
    assert some.agg(F.sum(F.octet_length("source"))).first()[0] == loads[1].b + loads[3].b
    assert "dynamicpruning" in some._jdf.queryExecution().optimizedPlan().toString().lower()
    assert {r[0] for r in corpus.read_shards(spark, path, ["id"]).collect()} == {str(i) for i in range(500)}


def test_one_shard_and_none(spark, tmp_path):
    row = ("a", "x" * 5000, "ab" * 32, 1, 1.0, 0.0, 1.0, 1.0, 1.0, 1, "train")
    for rows in ([row], []):
        path = str(tmp_path / f"n{len(rows)}")
        corpus.write_shards(spark.createDataFrame(rows, corpus.CURATED_SCHEMA), path, shard_size_mb=0.001)
        assert corpus.read_shards(spark, path).count() == len(rows) and corpus.manifest(spark, path).count() == len(rows)


def test_vector_cells_are_pruned(spark, tmp_path):
    rows = [(i, layer, pool, [float(i), 1.0]) for i in range(4) for layer in (1, 2)
            for pool in ("last", "mean")]
    path = str(tmp_path / "vectors")
    tables.write_vectors(spark.createDataFrame(rows, "id long, layer int, pool string, vec array<double>"), path)
    cell = tables.read_vectors(spark, path, 2, "mean")
    assert cell.count() == 4
    plan = cell._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(layer" in plan


def test_index_join_refuses_repeated_keys(spark):
    index = spark.createDataFrame([(1, "train"), (2, "val")], "id long, split string")
    metrics = spark.createDataFrame([(1, 5.0)], "id long, cc double")
    rows = {r["id"]: r["cc"] for r in tables.with_metrics(index, metrics).collect()}
    assert rows == {1: 5.0, 2: None}
    with pytest.raises(Exception, match="a metrics key repeats"):
        tables.with_metrics(index, metrics.unionAll(metrics)).collect()


def test_probe_and_contrast_tables(spark, tmp_path):
    results = spark.createDataFrame(
        [(1, "mean", "mi", 0.5, 0.4, 9, 3, 0.1, [1.0, 2.0])], probes.RESULT_SCHEMA
    )
    tables.write_probe_results(results, str(tmp_path / "p"), "m", 1.0)
    back = tables.read_probe_results(spark, str(tmp_path / "p"))
    assert tables.probe_weights(back, 1, "mean", "mi").first()["weights"] == [1.0, 2.0]
    contrast = spark.createDataFrame(
        [("mi", 1, "mean", [1.0])], "metric string, layer int, pool string, vec array<double>"
    )
    tables.write_contrast(contrast, str(tmp_path / "c"), "m", 10)
    assert tables.read_contrast(spark, str(tmp_path / "c"), "m", 10).first()["vec"] == [1.0]
    assert tables.read_contrast(spark, str(tmp_path / "c"), "m", 25).count() == 0


def test_tasks_and_metadata(spark, tmp_path):
    tasks = spark.createDataFrame([(f"t/{i}",) for i in (10, 9, 1)], "task_id string")
    got = [r[0] for r in records.task_scan(tasks, limit=2).collect()]
    assert got == ["t/1", "t/10"]
    path = str(tmp_path / "meta")
    records.write_run_metadata(spark, path, model_name="m", p=10, temperature=0.2, pools=["last"])
    row = records.read_run_metadata(spark, path).first()
    assert (row["model_name"], row["p"], row["temperature"], row["pools"]) == ("m", 10, 0.2, ["last"])


def test_indented_documents_and_samples_in_file_order(spark, tmp_path):
    import json

    (tmp_path / "results.json").write_text(json.dumps({"eval": {"t1": [{"status": "pass"}, {"status": "fail"}]}}, indent=2))
    got = {(r.task_id, r.generation_id): r.passed for r in records.read_verdicts(spark, str(tmp_path / "results.json")).collect()}
    assert got == {("t1", 0): True, ("t1", 1): False}
    (tmp_path / "meta.json").write_text(json.dumps({"model_name": "m", "p": 10}, indent=2))
    assert records.read_run_metadata(spark, str(tmp_path / "meta.json")).first()["p"] == 10
    lines = [{"task_id": f"t{i % 3}", "raw_solution": str(i)} for i in range(50)] + [{"task_id": None, "solution": "s", "raw_solution": "r"}]
    (tmp_path / "samples.jsonl").write_text("\n".join(map(json.dumps, lines)) + "\n\n")
    samples = records.read_samples(spark, str(tmp_path / "samples.jsonl")).orderBy("seq").collect()
    assert [r.solution for r in samples] == [*map(str, range(50)), "s"]
    (tmp_path / "broken.jsonl").write_text('{"task_id": "a"}\n{"task_id": \n')
    with pytest.raises(Exception):
        records.read_jsonl(spark, str(tmp_path / "broken.jsonl")).collect()


def test_stores_hold_several_models_and_shares(spark, tmp_path):
    contrast = spark.createDataFrame([("mi", 1, [1.0])], "metric string, layer int, vec array<double>")
    path = str(tmp_path / "c")
    for p in (10, 25, 10):
        tables.write_contrast(contrast, path, "m", p)
    tables.write_contrast(contrast, path, "n", 10)
    assert tables.read_contrast(spark, path).count() == 3
    ids = spark.createDataFrame([("a", 1, "mean", [1.0]), ("b", 1, "last", [2.0])], "id string, layer int, pool string, vec array<double>")
    tables.write_vectors(ids, str(tmp_path / "v"))
    assert {r.id for r in tables.read_vectors(spark, str(tmp_path / "v")).collect()} == {"a", "b"}
    for layer, value in ((2, 3.0), (1, 5.0)):
        tables.write_vectors(spark.createDataFrame([("c", layer, "mean", [value])], ids.schema), str(tmp_path / "v"))
    assert {(r.id, r.layer, r.pool) for r in tables.read_vectors(spark, str(tmp_path / "v")).collect()} == {
        ("c", 1, "mean"), ("b", 1, "last"), ("c", 2, "mean")}


def test_unequal_alphas_stop_the_report(spark):
    from metrospect.operators import runs
    rows = [(1, "a", m, x, 0.5, 1.0, 2.0) for m in ("mi", "comment_ratio") for x in (-1.0, 0.0, 12345.678)]
    schema = "pass_k int, model string, metric string, alpha double, pass double, mean_delta double, std_delta double"
    points = spark.createDataFrame(rows, schema)
    assert runs.final_report(points, ["a"], strict=True).count() == 3
    assert [r.a for r in runs.alpha_legend(points, ["a"]).orderBy("ordinal").collect()] == ["-1", "0", "1.235e+04"]
    with pytest.raises(Exception, match="different alphas in a pass@1"):
        runs.final_report(spark.createDataFrame(rows[:-1], schema), ["a"], strict=True).collect()


def test_records_are_versioned_and_merged(spark, tmp_path):
    folder, name = str(tmp_path / "r"), "pass1_full_aa_mi_a0.5_p10"
    schema = records.SUMMARY_SCHEMA
    delta = dict(mean_pct_delta=1.0, median_pct_delta=1.0, std_pct_delta=1.0, mean_delta_over_base_mean_pct=1.0,
                 median_delta_over_base_mean_pct=1.0, n=3)
    one = spark.createDataFrame([("s.jsonl", None, {"pass@1": 0.25}, None, ["t9"], 4, 2, 0, {"pass": 2, "fail": 2}, None)], schema)
    two = spark.createDataFrame([(None, "b.jsonl", {"pass@5": 0.5}, 0.9, None, None, 3, None, {"pass": 3}, {"mi": delta})], schema)
    assert [records.upsert_record(spark, folder, name, r) for r in (one, two)] == [1, 2]
    row = records.read_records(spark, folder).first()
    assert (row.name, row.version, row.samples, row.baseline) == (f"{name}_summary.json", 2, "s.jsonl", "b.jsonl")
    assert row.pass_at_k == {"pass@1": 0.25, "pass@5": 0.5} and row.status_counts == {"pass": 3, "fail": 2}
    assert (row.gt_pass_rate, row.failed_tasks, row.num_total, row.num_correct, row.num_invalid) == (0.9, ["t9"], 4, 3, 0)
    assert row.metric_deltas["mi"]["n"] == 3
    report = records.read_summaries(spark, folder, ["aa"], ["mi"]).first()
    assert (report["pass_k"], report["alpha"], report["pass"], report["mean_delta"]) == (1, 0.5, 0.25, 1.0)
    assert records.read_records(spark, folder).count() == 1
