"""Lexical profile of the seven metrics: native expressions over whole texts, any language.

Words are operands and punctuation marks are operators; a line with a '#' counts as commented.
The python_ast profile (functions/pyast.py) measures real syntax; the two are never mixed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from metrospect import constants as K

# Tokens, decision words, coefficients of the maintainability index.
BETWEEN_WORDS = r"[^\p{L}\p{N}_]+"
MARK = r"[^\p{L}\p{N}_ \t\n\r\f\x0B]"
CODE_LINE = r"^[ \t\r\f\x0B]*[^# \t\r\f\x0B]"
DECISIONS = ["if", "elif", "for", "while", "except", "and", "or", "case", "assert"]
COMMENT_COEFFICIENT = 2.46


def maintainability(volume: Column, cc: Column, lines: Column, comment_pct: Column) -> Column:
    """Maintainability index scaled to 0..100; 100 where a logarithm would not exist.

    The comment share enters the sine as a percentage converted to radians.
    """
    raw = (
        171.0
        - 5.2 * F.log(volume)
        - 0.23 * cc
        - 16.2 * F.log(lines)
        + 50.0 * F.sin(F.sqrt(COMMENT_COEFFICIENT * F.radians(comment_pct)))
    )
    return F.when((volume <= 0) | (lines <= 0), 100.0).otherwise(
        F.least(F.greatest(raw * 100.0 / 171.0, F.lit(0.0)), F.lit(100.0))
    )


def with_lexical_metrics(df: DataFrame, source: str = "source") -> DataFrame:
    """Add the seven metric columns and metrics_error (NULL metrics when there is no code line)."""
    text = F.col(source)
    arrays = df.withColumns(
        {
            "_words": F.array_remove(F.split(text, BETWEEN_WORDS), ""),
            "_marks": F.regexp_extract_all(text, F.lit(MARK), F.lit(0)),
            "_lines": F.split(text, "\n"),
        }
    )
    open_end = text.endswith("\n") | (text == "")
    counts = arrays.withColumns(
        {
            "_big_n1": F.size("_marks"),
            "_big_n2": F.size("_words"),
            "_n1": F.size(F.array_distinct("_marks")),
            "_n2": F.size(F.array_distinct("_words")),
            "_decisions": F.size(F.filter("_words", lambda w: w.isin(DECISIONS))),
            "_loc": F.size("_lines") - open_end.cast("int"),
            "_sloc": F.size(F.filter("_lines", lambda line: line.rlike(CODE_LINE))),
            "_comments": F.size(F.filter("_lines", lambda line: line.contains("#"))),
        }
    ).drop("_words", "_marks", "_lines")
    vocabulary = F.col("_n1") + F.col("_n2")
    volume = F.when(
        vocabulary > 0, (F.col("_big_n1") + F.col("_big_n2")) * F.log2(vocabulary.cast("double"))
    ).otherwise(0.0)
    difficulty = F.when(
        F.col("_n2") > 0, F.col("_n1") / 2.0 * F.col("_big_n2") / F.col("_n2")
    ).otherwise(0.0)
    shaped = counts.withColumns({"_volume": volume, "_difficulty": difficulty})
    code = F.col("_sloc") > 0
    comment_pct = 100.0 * F.col("_comments") / F.greatest(F.col("_sloc"), F.lit(1))
    cc = 1 + F.col("_decisions")
    values = {
        "cc": cc,
        "mi": maintainability(
            F.col("_volume"), cc, F.col("_sloc").cast("double"), comment_pct
        ),
        "comment_ratio": F.col("_comments")
        / F.greatest(F.col("_loc") + F.col("_comments"), F.lit(1)),
        "h_volume": F.col("_volume"),
        "h_difficulty": F.col("_difficulty"),
        "h_effort": F.col("_volume") * F.col("_difficulty"),
        "sloc": F.col("_sloc"),
    }
    return shaped.withColumns(
        {name: F.when(code, values[name]) for name in K.METRICS}
        | {"metrics_error": F.when(~F.coalesce(code, F.lit(False)), "IndentationError")}
    ).drop(*[c for c in shaped.columns if c.startswith("_") and c not in df.columns])


def lexically_valid(source: str | Column) -> Column:
    """The lexical stand-in for a syntax check: a text with a NUL is never source code."""
    text = F.col(source) if isinstance(source, str) else source
    return text.isNotNull() & ~text.contains("\0")
