import hashlib

import pytest
from pyspark.sql import functions as F

from metrospect.functions import names
from metrospect.functions import text as tx
from metrospect.functions.lexical import with_lexical_metrics


def one(spark, column):
    return spark.range(1).select(column.alias("v")).first()["v"]


def texts(spark, *values):
    return spark.createDataFrame([(v,) for v in values], "source string")


@pytest.mark.parametrize("n,ok", [(49, False), (50, True), (6500, True), (6501, False)])
def test_length_bounds_are_inclusive(spark, n, ok):
    assert one(spark, tx.length_ok(F.lit("é" * n))) is ok


def test_hash_is_of_utf8_and_split_follows_it(spark):
    words = [f"tëxt {i}" for i in range(300)]
    rows = texts(spark, *words).select(
        "source", tx.sha256_hex("source").alias("sha"), tx.hash_split(F.sha2("source", 256)).alias("s")
    ).collect()
    for row in rows:
        sha = hashlib.sha256(row["source"].encode()).hexdigest()
        bucket = int(sha[:8], 16) % 100
        assert row["sha"] == sha
        assert row["s"] == ("train" if bucket < 80 else "val" if bucket < 90 else "test")


def test_fallback_chains_treat_empty_as_missing(spark):
    df = spark.createDataFrame(
        [("", "b", "", None), (None, None, None, "7"), ("a", "b", "h", "7")],
        "content string, source string, hexsha string, id string",
    )
    out = df.select(
        tx.first_text("content", "source").alias("t"),
        tx.record_id(F.lit("0123456789abcdef99"), "hexsha", "id").alias("i"),
    ).collect()
    assert [r["t"] for r in out] == ["b", "", "a"]
    assert [r["i"] for r in out] == ["0123456789abcdef", "7", "h"]


@pytest.mark.parametrize(
    "raw,code",
    [
        ("Hi\n```python\n\nx = 1\n\n```\n```\ny\n```", "x = 1"),
        ("```\na\n```", "a"),
        ("Sure: def task_func(x):\n  return x \n", "def task_func(x):\n  return x"),
        ("\t plain \n", "plain"),
        ("```python\nno end", "```python\nno end"),
    ],
)
def test_code_extraction(spark, raw, code):
    assert one(spark, tx.extract_code(F.lit(raw))) == code


@pytest.mark.parametrize(
    "x", [0.0, -0.0, 1.0, -10.0, 0.75, 0.1, 2.5, 100.0, 123456.0, 1234567.0, 0.0001, 0.00001234,
          -7.5e-9, 1e20, 0.333333333333, 32500.25, 99999.94, 999999.4]
)
def test_compact_number_is_percent_g(spark, x):
    assert one(spark, names.compact_number(F.lit(x))) == f"{x:g}"


def test_run_stem(spark):
    def stem(hard, steered):
        return one(spark, names.run_stem(
            F.lit("m"), F.lit("bench"), F.lit("instruct"), F.lit(0.8), F.lit(10), F.lit(steered),
            F.lit(hard),
        ))

    assert stem(True, False) == "m--bench-hard-instruct--repo-base-0.8-10"
    assert stem(False, True) == "m--bench-instruct--repo-steered-0.8-10"


def test_run_names_and_specs(spark):
    df = spark.createDataFrame(
        [("pass1_full_aa_mi_a-0.75_p10_summary.json",), ("pass5_full_bb_base_p10_summary.json",),
         ("pass1_full_cc_mi_a1_p10_summary.json",), ("pass1_full_aa_mi_ax_p10_summary.json",)],
        "name string",
    )
    parsed = df.select(names.parse_run_name("name", ["aa", "bb"], ["mi"]).alias("r")).collect()
    found = [tuple(r["r"]) if r["r"] else None for r in parsed]
    assert found == [(1, "aa", "mi", -0.75), (5, "bb", None, 0.0), None, None]
    assert tuple(one(spark, names.parse_steering(F.lit("mi, 30,-0.5")))) == ("mi", 30, -0.5)
    with pytest.raises(Exception, match="expected metric,layer,alpha"):
        one(spark, names.parse_steering(F.lit("mi,30")))


def test_report_cell(spark):
    assert one(spark, names.report_cell(F.lit(-16.9), F.lit(30.8), F.lit(0.269))) == " -16.9± 30.8 0.269"
    assert one(spark, names.report_cell(F.lit(38.1), F.lit(144.0), F.lit(0.377))) == " +38.1±144.0 0.377"
    nothing = F.lit(None).cast("double")
    assert one(spark, names.report_cell(nothing, F.lit(1.0), F.lit(1.0))) == "   —       —   "


def test_prompt_must_exist(spark):
    assert one(spark, tx.task_prompt(F.lit("complete"), F.lit("i"), F.lit("c"))) == "c"
    with pytest.raises(Exception, match="without a prompt"):
        one(spark, tx.task_prompt(F.lit("instruct"), F.lit(""), F.lit("c")))


def test_lexical_metrics(spark):
    source = "# a comment\nif a > b:\n    a = b + b # more\n\nwhile b: pass\n"
    row = with_lexical_metrics(texts(spark, source)).first()
    assert (row["cc"], row["sloc"]) == (3, 3)
    assert row["comment_ratio"] == pytest.approx(2 / 7)
    words = ["a", "comment", "if", "a", "b", "a", "b", "b", "more", "while", "b", "pass"]
    marks = ["#", ">", ":", "=", "+", "#", ":"]
    import math

    volume = 19 * math.log2(len(set(words)) + len(set(marks)))
    difficulty = len(set(marks)) / 2 * len(words) / len(set(words))
    assert row["h_volume"] == pytest.approx(volume)
    assert row["h_difficulty"] == pytest.approx(difficulty)
    assert row["h_effort"] == pytest.approx(volume * difficulty)
    assert 0 <= row["mi"] <= 100 and row["metrics_error"] is None


def test_lexical_metrics_of_nothing(spark):
    rows = with_lexical_metrics(texts(spark, "", "# only\n# comments", "  \n\t", None)).collect()
    for row in rows:
        assert row["cc"] is None and row["mi"] is None
        assert row["metrics_error"] == "IndentationError"


def test_numbers_print_as_python_prints_them(spark):
    from metrospect.functions.names import compact_number, fixed_point

    values = [9999999.0, 999999.5, 9.999995e-05, 9.9999995e-05, 0.5, 100000.0, 123456.7, -1e-7, 0.0001, 12.5]
    frame = spark.createDataFrame([(v,) for v in values], "x double")
    assert [r.s for r in frame.select(compact_number("x").alias("s")).collect()] == [f"{v:g}" for v in values]
    ties = [0.25, 2.25, -0.75, 0.0, 12.0, -100.25]
    frame = spark.createDataFrame([(v,) for v in ties], "x double")
    got = [r.s for r in frame.select(fixed_point("x", 1, 6, signed=True).alias("s")).collect()]
    assert got == [f"{v:+6.1f}" for v in ties]


def test_strip_removes_all_blanks(spark):
    from metrospect.functions.text import strip

    text = "\u3000\xa0\x85 a b\u2009\n"
    assert spark.range(1).select(strip(F.lit(text)).alias("s")).first().s == text.strip()
