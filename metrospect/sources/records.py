"""Sample records, evaluation results, tasks, summaries and run metadata."""

from __future__ import annotations

import itertools
import json
from collections.abc import Iterator

import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from metrospect import constants as K
from metrospect.functions.names import parse_run_name
from metrospect.functions.text import status_passed

METRIC_STRUCT = (
    "struct<cc:int,mi:double,comment_ratio:double,h_volume:double,h_difficulty:double,"
    "h_effort:double,sloc:int>"
)
SAMPLE_SCHEMA = (
    "task_id string, generation_id long, solution string, model string, "
    "steerings array<struct<metric:string,layer:int,alpha:double>>, code string, "
    f"metrics {METRIC_STRUCT}"
)
ROWS_AT_ONCE = 10_000
VERDICT_ARROW = pa.schema([("task_id", pa.string()), ("generation_id", pa.int64()), ("status", pa.string())])
DELTA_STRUCT = (
    "struct<mean_pct_delta:double,median_pct_delta:double,std_pct_delta:double,"
    "mean_delta_over_base_mean_pct:double,median_delta_over_base_mean_pct:double,n:long>"
)
#: The record of a run. Its maps have an entry per k, status and metric; what a run has per task is a table of its own.
SUMMARY_SCHEMA = (
    "samples string, baseline string, pass_at_k map<string,double>, gt_pass_rate double, failed_tasks array<string>, "
    "num_total long, num_correct long, num_invalid long, status_counts map<string,long>, "
    f"metric_deltas map<string,{DELTA_STRUCT}>"
)
TASKS_SCHEMA = "task_id string, passed long, total long, part long, statuses array<string>"


def sample_records(df: DataFrame, raw_output: str = "raw_output") -> DataFrame:
    """Shape generated outputs to sample records; the raw output becomes the solution."""
    renamed = df.withColumn("solution", F.col(raw_output))
    return renamed.select(*[f.name for f in _fields(SAMPLE_SCHEMA)])


def _fields(schema: str) -> list[T.StructField]:
    return T._parse_datatype_string(schema).fields


def write_jsonl(df: DataFrame, path: str) -> None:
    """One JSON object per line; NULL fields are written, so every record has every key."""
    df.write.mode("overwrite").option("ignoreNullFields", "false").json(path)


def read_jsonl(spark: SparkSession, path: str, schema: str = SAMPLE_SCHEMA) -> DataFrame:
    """JSON lines with a declared schema; blank lines are skipped, a line that is no JSON raises."""
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)


def read_samples(spark: SparkSession, path: str) -> DataFrame:
    """Sample records with seq, a whole number that grows in file order (files by name), and solution, which
    falls back to raw_solution.

    A split knows its file and its first byte; lines within a split keep their order, so seq needs the
    number of the split and the line's place in it, and the lines are not sorted.
    """
    schema = f"{SAMPLE_SCHEMA}, raw_solution string"
    lines = spark.read.text(path).select(
        "value", F.col("_metadata.file_path").alias("_file"), F.col("_metadata.file_block_start").alias("_start"),
        F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)).alias("_line"),
    )
    by_place = W.orderBy("_file", "_start")
    splits = lines.select("_file", "_start").distinct().withColumn("_split", F.row_number().over(by_place))
    parsed = lines.where(F.trim("value") != "").join(splits, ["_file", "_start"]).select(
        F.from_json("value", schema, {"mode": "FAILFAST"}).alias("record"),
        (F.col("_split") * F.lit(1 << 33) + F.col("_line")).alias("seq"),
    )
    return parsed.select("seq", "record.*").withColumn("solution", F.coalesce("solution", "raw_solution"))


def read_metric_rows(spark: SparkSession, path: str) -> DataFrame:
    """(task_id, generation_id, metrics) of the records that have metrics; a missing id is 0."""
    records = read_jsonl(spark, path).where(F.col("metrics").isNotNull())
    return records.select(
        "task_id", F.coalesce("generation_id", F.lit(0)).alias("generation_id"), "metrics.*"
    )


BLANKS = " \t\r\n"


def documents_of(text: str) -> Iterator[object]:
    """The JSON values of a text, one after another, however they are laid out; anything else raises."""
    decoder, at = json.JSONDecoder(), 0
    while len(rest := text[at:at + 1]):
        if rest in BLANKS:
            at += 1
            continue
        value, at = decoder.raw_decode(text, at)
        yield value


def verdict_rows(text: str) -> Iterator[tuple[str, int, str | None]]:
    """(task_id, generation_id, status) of the results in a text of evaluation documents.

    The task map may be wrapped in "eval" or be the document; entries that are no list are skipped.
    """
    for document in documents_of(text):
        if not isinstance(document, dict):
            raise ValueError("an evaluation document must be a map of tasks")
        tasks = document["eval"] if isinstance(document.get("eval"), dict) else document
        for task, results in tasks.items():
            if isinstance(results, list):
                for place, result in enumerate(results):
                    status = result.get("status") if isinstance(result, dict) else None
                    yield task, place, status if status is None or isinstance(status, str) else json.dumps(status)


def read_verdicts(spark: SparkSession, path: str, per_line: bool = False) -> DataFrame:
    """(task_id, generation_id, status, passed) rows of evaluation documents; the position in a task's result list
    is the generation id.

    A file is read whole and may hold any number of documents, indented or not; a broken one raises, and a
    blank file has no rows. With per_line every line holds whole documents, so that a large file is split. Results leave
    a task in batches of ROWS_AT_ONCE.
    """

    def results(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = (row for text in batch.column(0).to_pylist() for row in verdict_rows(text))
            while rows := list(itertools.islice(found, ROWS_AT_ONCE)):
                yield pa.RecordBatch.from_arrays([pa.array(column, field.type) for column, field in zip(zip(*rows), VERDICT_ARROW)], schema=VERDICT_ARROW)

    documents = spark.read.text(path, wholetext=not per_line).where(F.trim("value") != "")
    rows = documents.mapInArrow(results, "task_id string, generation_id long, status string")
    return rows.withColumn("passed", status_passed("status"))


def task_scan(
    tasks: DataFrame, key: str = "task_id", subset: Column | None = None, limit: int | None = None
) -> DataFrame:
    """Benchmark tasks in key order; limit is the caller's smoke-run option."""
    chosen = tasks if subset is None else tasks.where(subset)
    ordered = chosen.orderBy(key)
    return ordered if limit is None else ordered.limit(limit)


def write_run_metadata(spark: SparkSession, path: str, **fields: object) -> None:
    """One JSON record that describes a run."""
    kinds = {bool: "boolean", int: "long", float: "double", str: "string"}
    schema = ", ".join(
        f"{name} {'array<string>' if isinstance(v, (list, tuple)) else kinds[type(v)]}"
        for name, v in fields.items()
    )
    row = spark.createDataFrame([tuple(fields.values())], schema)
    row.coalesce(1).write.mode("overwrite").json(path)


def read_run_metadata(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.option("multiLine", "true").json(path)


def summary_name(path: Column) -> Column:
    """File name of a summary: the last path part that ends in _summary.json.

    Spark writes folders, so the name may be a folder, also one of the form column=name.
    """
    parts = F.filter(F.split(path, "/"), lambda p: p.endswith("_summary.json"))
    return F.regexp_replace(F.try_element_at(parts, F.lit(-1)), r"^\w+=", "")


def version_of(path: Column) -> Column:
    """The number of the folder version=<number> in a path, 0 without one."""
    return F.coalesce(F.try_to_number(F.nullif(F.regexp_extract(path, r"/version=(\d+)/", 1), F.lit("")), F.lit("999999999999999999")).cast("long"), F.lit(0))


def record_path(folder: str, name: str, version: int) -> str:
    return f"{folder}/{name}_summary.json/version={version}"


def tasks_path(folder: str, name: str, version: int) -> str:
    """Beside the folder of records, whose readers look at all its files."""
    return f"{folder.rstrip('/')}_tasks/{name}/version={version}"


def write_record(record: DataFrame, folder: str, name: str, version: int) -> None:
    """One run's record as a version of its own; earlier versions stay, and readers take the latest."""
    record.select(*[f.name for f in _fields(SUMMARY_SCHEMA)]).coalesce(1).write.mode("overwrite").json(
        record_path(folder, name, version))


def write_task_records(tasks: DataFrame, folder: str, name: str, version: int) -> None:
    """What a run has per task, as JSON lines beside its record."""
    tasks.select(*[f.name for f in _fields(TASKS_SCHEMA)]).write.mode("overwrite").json(tasks_path(folder, name, version))


def read_task_records(spark: SparkSession, folder: str, name: str, version: int) -> DataFrame:
    return spark.read.schema(TASKS_SCHEMA).json(tasks_path(folder, name, version))


def read_records(spark: SparkSession, folder: str) -> DataFrame:
    """The latest version of every record of a folder: name (of the file or folder), version and its fields."""
    path = F.col("_metadata.file_path")
    reader = spark.read.schema(SUMMARY_SCHEMA).option("recursiveFileLookup", "true").option("multiLine", "true")
    named = reader.json(folder).select("*", summary_name(path).alias("name"), version_of(path).alias("version")).where("name IS NOT NULL")
    fields = F.struct(*[f.name for f in _fields(SUMMARY_SCHEMA)])
    latest = named.groupBy("name").agg(F.max("version").alias("last"), F.max_by(fields, "version").alias("record"))
    return latest.select("name", F.col("last").alias("version"), "record.*")


def merged_record(old: DataFrame, new: DataFrame) -> DataFrame:
    """One record over another: fields that the new one lacks stay, entries of its maps replace or join the old ones."""
    before = old.agg(F.first(F.struct(*[f.name for f in _fields(SUMMARY_SCHEMA)])).alias("record")).scalar()
    both = new.withColumn("_old", before)
    columns = []
    for field in _fields(SUMMARY_SCHEMA):
        was, now = F.col("_old")[field.name], F.col(field.name)
        value = F.coalesce(now, was)
        if isinstance(field.dataType, T.MapType):
            value = F.coalesce(F.map_zip_with(was, now, lambda key, before, after: F.coalesce(after, before)), value)
        columns.append(value.alias(field.name))
    return both.select(*columns)


def upsert_record(spark: SparkSession, folder: str, name: str, new: DataFrame) -> int:
    """Write a record merged over the latest one of its name, as the next version, and return that."""
    try:
        old = read_records(spark, folder).where(F.col("name") == f"{name}_summary.json")
    except AnalysisException as failure:
        if failure.getCondition() != "PATH_NOT_FOUND":
            raise
        old = None
    found = old and old.select("version").first()
    version = found["version"] + 1 if found else 1
    write_record(merged_record(old, new) if found else new, folder, name, version)
    return version


def read_summaries(
    spark: SparkSession, path: str, models: list[str], metrics: list[str] = K.REPORT_METRICS
) -> DataFrame:
    """Run summaries of a folder, one document per file, with (pass_k, model, metric, alpha) from their names.

    Of a summary with versions the latest counts; those whose name has no known form are left out.
    """
    named = read_records(spark, path).withColumn("run", parse_run_name(F.col("name"), models, metrics))
    runs = named.where(F.col("run").isNotNull()).select("run.*", "pass_at_k", "metric_deltas")
    delta = F.col("metric_deltas")[F.col("metric")]
    rate = F.col("pass_at_k")[F.concat(F.lit("pass@"), F.col("pass_k").cast("string"))]
    return runs.select(
        "pass_k", "model", "metric", "alpha", rate.alias("pass"),
        delta["mean_pct_delta"].alias("mean_delta"), delta["std_pct_delta"].alias("std_delta"),
    )
