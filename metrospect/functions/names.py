"""Run names and report cells."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from metrospect import constants as K
from metrospect.functions.text import col


def _plain(text: Column) -> Column:
    """Drop trailing zeros after a decimal point, and the point itself if nothing follows."""
    return F.when(text.contains("."), F.regexp_replace(text, r"\.?0+$", "")).otherwise(text)


def compact_number(value: Column | str, digits: int = 6) -> Column:
    """So many significant digits without trailing zeros, as the C format %.<digits>g prints a number.

    Rounding looks at the shortest decimal form of the number, halves go to the even digit.
    """
    x = col(value).cast("double")
    size = F.abs(x)
    exact = x.cast("decimal(38,18)")
    fixed = F.lit(None).cast("string")
    most = digits - 1
    for exponent in range(most, -6, -1):
        text = F.bround(exact, most - exponent).cast("string")
        fixed = F.coalesce(fixed, F.when(size >= 10.0**exponent, _plain(text)))
    below = F.floor(F.log10(size)).cast("int")
    rounded = F.bround((x / F.pow(F.lit(10.0), below)).cast("decimal(38,18)"), most)
    carried = F.abs(rounded) >= 10
    exponent = F.when(carried, below + 1).otherwise(below)
    mantissa = F.when(carried, F.bround(rounded / 10, most)).otherwise(rounded)
    sign = F.when(exponent < 0, "-").otherwise("+")
    scientific = F.concat(
        _plain(mantissa.cast("string")), F.lit("e"), sign,
        F.lpad(F.abs(exponent).cast("string"), 2, "0"),
    )
    return (
        F.when(x == 0, F.when(x.cast("string").startswith("-"), "-0").otherwise("0"))
        .when(exponent.between(-4, most), fixed)
        .otherwise(scientific)
    )


def run_stem(
    model: Column | str,
    benchmark: Column | str,
    prompt_split: Column | str,
    temperature: Column | str,
    n_samples: Column | str,
    steered: Column | str,
    hard: Column | str,
) -> Column:
    """Name of a generation run, built from its parts."""
    suite = F.concat(col(benchmark), F.when(col(hard), "-hard").otherwise(""))
    mode = F.when(col(steered), "steered").otherwise("base")
    return F.concat(
        col(model), F.lit("--"), suite, F.lit("-"), col(prompt_split), F.lit("--repo-"), mode,
        F.lit("-"), compact_number(temperature), F.lit("-"), col(n_samples).cast("string"),
    )


def sweep_name(name: Column | str, alpha: Column | str) -> Column:
    return F.concat(col(name), F.lit("_a"), compact_number(alpha))


def parse_run_name(name: Column | str, models: list[str], metrics: list[str]) -> Column:
    """Struct (pass_k, model, metric, alpha) from a summary file name, NULL when it has neither form.

    Base runs have no metric and alpha 0.
    """
    name = col(name)
    model = "|".join(models)
    # The two forms of a summary file name.
    steered = rf"^pass(\d)_full_({model})_({'|'.join(metrics)})_a([+-]?\d+\.?\d*)_p10_summary\.json"
    base = rf"^pass(\d)_full_({model})_base_p10_summary\.json"

    def parts(pattern: str, metric: Column, alpha: Column) -> Column:
        return F.struct(
            F.regexp_extract(name, pattern, 1).cast("int").alias("pass_k"),
            F.regexp_extract(name, pattern, 2).alias("model"),
            metric.alias("metric"),
            alpha.alias("alpha"),
        )

    return F.when(
        name.rlike(steered),
        parts(
            steered,
            F.regexp_extract(name, steered, 3),
            F.regexp_extract(name, steered, 4).cast("double"),
        ),
    ).when(name.rlike(base), parts(base, F.lit(None).cast("string"), F.lit(0.0)))


def parse_steering(spec: Column | str) -> Column:
    """Struct (metric, layer, alpha) from 'metric,layer,alpha'; any other part count raises."""
    parts = F.split(col(spec), ",")
    return F.when(
        F.size(parts) == 3,
        F.struct(
            F.trim(parts[0]).alias("metric"),
            F.trim(parts[1]).cast("int").alias("layer"),
            F.trim(parts[2]).cast("double").alias("alpha"),
        ),
    ).otherwise(
        F.raise_error(F.concat(F.lit("expected metric,layer,alpha but got "), col(spec)))
    )


def fixed_point(value: Column | str, digits: int, width: int = 0, signed: bool = False) -> Column:
    """A number with so many decimals, halves to the even digit, padded on the left."""
    exact = F.bround(col(value).cast("double").cast("decimal(38,18)"), digits).cast(f"decimal(38,{digits})")
    negative = col(value).cast("double").cast("string").startswith("-")
    sign = F.when(negative, "-").otherwise("+" if signed else "")
    text = F.concat(sign, F.abs(exact).cast("string"))
    return F.when(F.length(text) < width, F.lpad(text, width, " ")).otherwise(text)


def report_cell(mean: Column | str, std: Column | str, passed: Column | str) -> Column:
    """One report cell 'mean±std pass', or dashes when the mean or the pass rate is missing."""
    missing = col(mean).isNull() | col(passed).isNull()
    text = F.concat(
        fixed_point(mean, 1, 6, signed=True),
        F.lit("±"),
        F.coalesce(F.when(col(std).isNotNull(), fixed_point(std, 1, 5)), F.lit("  nan")),
        F.lit(" "),
        fixed_point(passed, 3),
    )
    return F.when(missing, K.MISSING_CELL).otherwise(text)
