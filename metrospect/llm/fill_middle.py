"""Fill-in-middle transformation: cut texts at unit ends and reorder prefix, middle and suffix.

A unit is a run of the letters A-Z and a-z or any other single code point. Texts are UTF-8; a task views a
batch's bytes as 64-bit words and marks, by arithmetic on eight bytes at once, every byte that ends a unit:
the byte after it continues no code point, and not both are letters. Popcounts per word, summed up, give the
word of the k-th unit end by binary search; products of bytes then select the end inside that word. Code
points are counted by the same ranks. No text is split into a list of units.

The draws of a row come from a hash of its doc_id alone, so a lost task gives the same rows again. Python gets
texts and two draws and returns three numbers; texts are put together by column expressions. Nothing is
shuffled, and words are viewed in slices of SLICE bytes (a longer text alone).

Defined cases: null text counts as empty and stays plain; a null doc_id draws as the empty number; repeated
rows and ids pass through row by row; a text that contains a mark stays plain, so every output can be taken
apart again; an empty table gives an empty result; columns but doc_id and text are not read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MARKS = ("<P>", "<S>", "<M>")
PLAIN, PSM, SPM = "plain", "psm", "spm"
SLICE = 4 << 20

ONES = np.uint64(0x0101010101010101)
HIGH = ONES << np.uint64(7)
BYTE, SEVEN, TOP = np.uint64(8), np.uint64(7), np.uint64(56)


def letter_bytes(words: np.ndarray) -> np.ndarray:
    """The high bit of every byte that is an ASCII letter. No sum leaves its byte, as both parts stay below 128."""
    lower = (words | ONES * np.uint64(0x20)) & ~HIGH
    from_a = lower + ONES * np.uint64(0x80 - ord("a"))
    beyond_z = lower + ONES * np.uint64(0x80 - ord("z") - 1)
    return from_a & ~beyond_z & ~words & HIGH


def continuing_bytes(words: np.ndarray) -> np.ndarray:
    """The high bit of every byte 10xxxxxx."""
    return words & ~(words << np.uint64(1)) & HIGH


def following(words: np.ndarray) -> np.ndarray:
    """At each byte the byte after it."""
    after = words >> BYTE
    after[:-1] |= words[1:] << TOP
    return after


class Marks:
    """High bits of bytes with rank and select."""

    def __init__(self, words: np.ndarray):
        self.words = words
        self.upto = np.cumsum(np.bitwise_count(words), dtype=np.int64)

    def rank(self, at: np.ndarray) -> np.ndarray:
        """Marks before each byte position."""
        word = at >> 3
        below = (np.uint64(1) << ((at & 7).astype(np.uint64) * BYTE)) - np.uint64(1)
        inside = np.bitwise_count(self.words[word] & below)
        return np.where(word > 0, self.upto[word - 1], 0) + inside

    def select(self, k: np.ndarray) -> np.ndarray:
        """The byte position of the k-th mark (from 1)."""
        word = np.searchsorted(self.upto, k, side="left")
        rest = (k - np.where(word > 0, self.upto[word - 1], 0)).astype(np.uint64)
        # Byte b of the product counts the marks of bytes 0 to b.
        counts = (self.words[word] >> SEVEN) * ONES
        reached = ((counts | HIGH) - rest * ONES) & HIGH
        return word * 8 + 8 - np.bitwise_count(reached)


class Units:
    """Units of texts that lie one after another in data, each ending at ends[i]."""

    def __init__(self, data: np.ndarray, ends: np.ndarray):
        padded = np.zeros((len(data) // 8 + 2) * 8, np.uint8)
        padded[:len(data)] = data
        words = padded.view("<u8")
        letters, continuing = letter_bytes(words), continuing_bytes(words)
        unit_ends = HIGH & ~following(continuing) & ~(letters & following(letters))
        # A text's last byte ends a unit, whatever the next text begins with.
        last = ends[np.diff(ends, prepend=0) > 0] - 1
        np.bitwise_or.at(unit_ends, last >> 3, np.uint64(0x80) << ((last & 7).astype(np.uint64) * BYTE))
        self.ends = Marks(unit_ends)
        self.points = Marks(HIGH & ~continuing)
        self.stops = ends
        self.starts = np.concatenate([[0], ends[:-1]]).astype(np.int64)

    def counts(self) -> np.ndarray:
        return self.ends.rank(self.stops) - self.ends.rank(self.starts)

    def code_points_of(self, units: np.ndarray) -> np.ndarray:
        """Code points in the first units[i] units of each text."""
        wanted = self.ends.rank(self.starts) + units
        byte = np.where(units > 0, self.ends.select(np.maximum(wanted, 1)) + 1, self.starts)
        return self.points.rank(byte) - self.points.rank(self.starts)


def slices(ends: np.ndarray, most: int) -> Iterator[tuple[int, int]]:
    """Ranges of texts with at most so many bytes together, or a single text."""
    begin = 0
    while begin < len(ends):
        before = ends[begin - 1] if begin else 0
        stop = max(begin + 1, int(np.searchsorted(ends, before + most, side="right")))
        yield begin, stop
        begin = stop


def cut_points(texts: pa.Array, one: np.ndarray, two: np.ndarray, most: int = SLICE) -> np.ndarray:
    """Per text the number n of units, and the code points before the ends of prefix and of middle: they end
    after the smaller and the larger of one % (n + 1) and two % (n + 1) units."""
    texts = texts.cast(pa.large_binary())
    out = np.zeros((3, len(texts)), np.int64)
    if not len(texts):
        return out
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset:texts.offset + len(texts) + 1]
    data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)
    ends = offsets[1:] - offsets[0]
    for begin, stop in slices(ends, most):
        first, last = offsets[begin], offsets[stop]
        units = Units(data[first:last], offsets[begin + 1:stop + 1] - first)
        n = units.counts()
        a, b = one[begin:stop] % (n + 1), two[begin:stop] % (n + 1)
        out[0, begin:stop] = n
        out[1, begin:stop] = units.code_points_of(np.minimum(a, b))
        out[2, begin:stop] = units.code_points_of(np.maximum(a, b))
    return out


def numbers(texts: pa.Array, one: pa.Array, two: pa.Array) -> pa.Array:
    found = cut_points(texts, one.to_numpy(zero_copy_only=False), two.to_numpy(zero_copy_only=False))
    return pa.StructArray.from_arrays([pa.array(row) for row in found], ["n", "first", "second"])


def draw(i: int, seed: str) -> Column:
    """The i-th group of eight digits of the hash of a row's seed and doc_id, as a number."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 256)
    return F.conv(F.substring(digest, 1 + 8 * i, 8), 16, 10).cast("long")


def check_marks(marks: tuple[str, str, str]) -> None:
    """Marks must be told apart wherever they meet text that holds none of them."""
    heads = {mark[:1] for mark in marks}
    if len(set(marks)) != 3 or "" in marks or any(head in mark[1:] for head in heads for mark in marks):
        raise ValueError("marks must differ, and their first characters must occur nowhere else in them")


def transform(
    docs: DataFrame, seed: str = "1", changed_percent: int = 90, spm_percent: int = 20,
    marks: tuple[str, str, str] = MARKS,
) -> DataFrame:
    """doc_id, n, form (plain, psm, spm), prefix_chars, middle_chars (null if plain) and output of every row."""
    check_marks(marks)
    prefix_mark, suffix_mark, middle_mark = map(F.lit, marks)
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    holds_mark = F.contains("text", prefix_mark) | F.contains("text", suffix_mark) | F.contains("text", middle_mark)
    form = (
        F.when((F.col("text") == "") | holds_mark | (F.pmod(draw(2, seed), F.lit(100)) >= changed_percent), PLAIN)
        .when(F.pmod(draw(3, seed), F.lit(100)) < spm_percent, SPM).otherwise(PSM))
    cuts = F.arrow_udf(numbers, "n long, first long, second long")
    rows = docs.select("doc_id", text.alias("text"))
    rows = rows.select("doc_id", "text", form.alias("form"), cuts("text", draw(0, seed), draw(1, seed)).alias("cut"))
    first, second = F.col("cut.first").cast("int"), F.col("cut.second").cast("int")
    prefix = F.substring("text", F.lit(1), first)
    middle = F.substring("text", first + 1, second - first)
    suffix = F.substring("text", second + 1, F.length("text"))
    output = (
        F.when(F.col("form") == PLAIN, F.col("text"))
        .when(F.col("form") == PSM, F.concat(prefix_mark, prefix, suffix_mark, suffix, middle_mark, middle))
        .otherwise(F.concat(suffix_mark, suffix, prefix_mark, prefix, middle_mark, middle)))
    changed = F.col("form") != PLAIN
    return rows.select(
        "doc_id", F.col("cut.n").alias("n"), "form",
        F.when(changed, F.col("cut.first")).alias("prefix_chars"),
        F.when(changed, F.col("cut.second") - F.col("cut.first")).alias("middle_chars"),
        output.alias("output"))


def restored(output: Column, form: Column, marks: tuple[str, str, str] = MARKS) -> Column:
    """The text that transform() made an output of."""
    parts = F.split(output, "|".join(map(re.escape, marks)))
    return F.when(form == PLAIN, output).when(form == PSM, F.concat(parts[1], parts[3], parts[2])).otherwise(
        F.concat(parts[2], parts[3], parts[1]))


def digests(docs: DataFrame, **options) -> DataFrame:
    """transform() with the hashes of the outputs and of the texts restored from them."""
    marks = options.get("marks", MARKS)
    return transform(docs, **options).select(
        "doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2(F.col("output").cast("binary"), 256).alias("output_sha256"),
        F.sha2(restored(F.col("output"), F.col("form"), marks).cast("binary"), 256).alias("restored_sha256"))
