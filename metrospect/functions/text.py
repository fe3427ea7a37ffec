"""Text columns: fallback chains, hashes, length and split rules, code extraction."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from metrospect import constants as K

# White space that Python's str.strip removes.
BLANK = r"[ \t\n\r\x0B\f\x1C-\x1F\x85\xA0\u1680\u2000-\u200A\u2028\u2029\u202F\u205F\u3000]"

# What marks code in a raw output.
FENCE = r"(?s)```(?:python)?\n(.*?)```"
CODE_START = "def task_func"


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def first_text(*candidates: Column | str) -> Column:
    """First candidate that is neither NULL nor empty, else the empty string."""
    return F.coalesce(*[F.nullif(col(c), F.lit("")) for c in candidates], F.lit(""))


def sha256_hex(text: Column | str, chars: int | None = None) -> Column:
    digest = F.sha2(col(text), 256)
    return digest if chars is None else F.substring(digest, 1, chars)


def record_id(sha: Column | str, *candidates: Column | str) -> Column:
    """First usable id, else the first 16 digits of the content hash."""
    usable = [F.nullif(col(c).cast("string"), F.lit("")) for c in candidates]
    return F.coalesce(*usable, F.substring(col(sha), 1, 16))


def length_ok(text: Column | str, lo: int = K.MIN_CHARS, hi: int = K.MAX_CHARS) -> Column:
    return F.length(col(text)).between(lo, hi)


def hex_prefix_number(digest: Column | str, digits: int) -> Column:
    return F.conv(F.substring(col(digest), 1, digits), 16, 10).cast("long")


def hash_split(sha: Column | str) -> Column:
    bucket = hex_prefix_number(sha, 8) % K.SPLIT_BUCKETS
    return (
        F.when(bucket < K.TRAIN_BELOW, "train").when(bucket < K.VAL_BELOW, "val").otherwise("test")
    )


def strip(text: Column | str) -> Column:
    return F.regexp_replace(col(text), rf"\A{BLANK}+|{BLANK}+\z", "")


def extract_code(raw: Column | str) -> Column:
    """First fenced block, else the text from the task function on, else all of it; stripped."""
    raw = col(raw)
    start = F.locate(CODE_START, raw)
    return strip(
        F.when(raw.rlike(FENCE), F.regexp_extract(raw, FENCE, 1))
        .when(start > 0, F.substr(raw, start))
        .otherwise(raw)
    )


def task_prompt(split: Column | str, instruct: Column | str, complete: Column | str) -> Column:
    """Prompt of the split; an empty prompt counts as missing and raises when read."""
    chosen = F.when(col(split) == "instruct", col(instruct)).otherwise(col(complete))
    return F.when(F.coalesce(chosen, F.lit("")) != "", chosen).otherwise(
        F.raise_error(F.concat(F.lit("task without a prompt for split "), col(split)))
    )


def status_passed(status: Column | str) -> Column:
    return F.lower(F.coalesce(col(status), F.lit(""))) == "pass"


def status_invalid(status: Column | str) -> Column:
    return F.lower(col(status)).rlike("|".join(K.INVALID_STATUS_WORDS))
