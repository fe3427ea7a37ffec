"""Substring dedup: words inside passages of at least SPAN words that occur more than once are removed.

All documents are the reference, so its automata cannot be broadcast whole. Reference shards are cut so that
each automaton only meets the stretches that can match it, and shards and stretches travel to one another:

1. The least hash among the SHORT-word sequences of a window of SPAN words is its anchor. Equal windows have
   equal anchors. A stretch is the run of words under neighbouring windows with one anchor (at most
   2 * SPAN - SHORT words). Stretches of an anchor that occurs once hold no repeated window.
2. If all stretches of an anchor are alike, all of their windows are repeated. Copies of a whole text are
   counted once, and their windows are all repeated too.
3. The other anchors are the reference shards: the stretches of one anchor, counted by content, become a
   suffix automaton over words with occurrence counts; the same stretches stream through it, and a place
   whose matching statistics reach SPAN words seen at least twice marks its window.
   An anchor with more than HOT stretches (a common line in many contexts) is divided first: its
   stretches are cut into their single windows, which meet by their own hash.
4. Marked spans go back to their documents.

Counts use 64-bit anchors with 64-bit content hashes, as identity of stretches; texts use 128 bits.

Defined cases: null text counts as empty: no words, the hash of the empty string; documents below SPAN words
lose nothing; repeated rows and equal texts are each other's copies; null ids pass through; an empty table
gives an empty result; other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from metrospect.session import staged

SPAN = 35
SHORT = 8
HOT = 1_000
STRETCHES = "array<struct<anchor:long,content:long>>"
CUTS = "array<struct<start:int,anchor:long,content:long,words:string>>"


def words_of(text: str | None) -> list[bytes]:
    """Maximal runs of other bytes than ASCII white space."""
    return (text or "").encode().split()


def signed(value: int) -> int:
    return value - (1 << 64) if value >> 63 else value


def stretches(words: list[bytes], span: int = SPAN, short: int = SHORT) -> list[tuple[int, int, int, int]]:
    """(first window, last window, anchor, content hash) for each run of windows with one anchor, in order."""
    windows = len(words) - span + 1
    if windows < 1:
        return []
    joined, hashed = b" ".join(words), xxhash.xxh3_64_intdigest
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    first, last = starts.tolist(), ends.tolist()
    grams = np.array([hashed(joined[a:b]) for a, b in zip(first, last[short - 1:])], np.uint64)
    anchors = leftmost_least(grams, span - short + 1)
    bounds = [0, *(np.flatnonzero(anchors[1:] != anchors[:-1]) + 1).tolist(), windows]
    return [(lo, hi - 1, int(grams[anchors[lo]]), hashed(joined[first[lo]:last[hi + span - 2]])) for lo, hi in zip(bounds, bounds[1:])]


def leftmost_least(values: np.ndarray, width: int) -> np.ndarray:
    """The position of the leftmost least value in each run of `width` values."""
    at = np.arange(len(values))
    size = 1
    while size < width:
        step = min(size, width - size)
        left, right = at[:-step], at[step:]
        at = np.where(values[right] < values[left], right, left)
        size += step
    return at


class SuffixAutomaton:
    """All substrings of weighted sequences, with the number of places where each occurs."""

    def __init__(self, sequences: list[tuple[list, int]]):
        self.next: list[dict] = [{}]
        self.link, self.length, self.count = [-1], [0], [0]
        for sequence, weight in sequences:
            last = 0
            for symbol in sequence:
                last = self.extend(last, symbol)
                self.count[last] += weight
        for state in sorted(range(1, len(self.length)), key=self.length.__getitem__, reverse=True):
            self.count[self.link[state]] += self.count[state]

    def state(self, length: int, link: int, follow: dict) -> int:
        self.next.append(follow)
        self.link.append(link)
        self.length.append(length)
        self.count.append(0)
        return len(self.length) - 1

    def split(self, source: int, symbol, target: int) -> int:
        """A copy of target for the substrings that end here, as short as source allows."""
        clone = self.state(self.length[source] + 1, self.link[target], dict(self.next[target]))
        self.link[target] = clone
        while source != -1 and self.next[source].get(symbol) == target:
            self.next[source][symbol] = clone
            source = self.link[source]
        return clone

    def extend(self, last: int, symbol) -> int:
        target = self.next[last].get(symbol)
        if target is not None:
            return target if self.length[target] == self.length[last] + 1 else self.split(last, symbol, target)
        fresh = self.state(self.length[last] + 1, 0, {})
        while last != -1 and symbol not in self.next[last]:
            self.next[last][symbol] = fresh
            last = self.link[last]
        if last != -1:
            target = self.next[last][symbol]
            self.link[fresh] = target if self.length[target] == self.length[last] + 1 else self.split(last, symbol, target)
        return fresh

    def repeated(self, sequence: list, span: int, least: int = 2) -> list[int]:
        """Starts of the windows of `span` symbols whose matching state occurs at least `least` times."""
        state, matched, found = 0, 0, []
        for end, symbol in enumerate(sequence, 1):
            while state and symbol not in self.next[state]:
                state = self.link[state]
                matched = self.length[state]
            if symbol in self.next[state]:
                state, matched = self.next[state][symbol], matched + 1
            while self.length[self.link[state]] >= span:
                state = self.link[state]
                matched = self.length[state]
            if matched >= span and self.count[state] >= least:
                found.append(end - span)
        return found


def covered(n_words: int, starts: list[int], span: int = SPAN) -> np.ndarray:
    """Which words lie in a window that starts at one of the starts."""
    steps = np.zeros(n_words + 1, np.int64)
    np.add.at(steps, np.asarray(starts, np.int64), 1)
    np.add.at(steps, np.asarray(starts, np.int64) + span, -1)
    return np.cumsum(steps[:-1]) > 0


def digest(words: list[bytes], gone: np.ndarray) -> tuple[int, str]:
    kept = [word for word, out in zip(words, gone.tolist()) if not out]
    return len(words) - len(kept), hashlib.sha256(b" ".join(kept)).hexdigest()


def scan(docs: DataFrame) -> DataFrame:
    """doc_id, key of the text, number and hash of its words, its stretches; staged."""

    @F.pandas_udf(f"n_words long, whole string, stretches {STRETCHES}")
    def read(texts: pd.Series) -> pd.DataFrame:
        rows = []
        for text in texts:
            words = words_of(text)
            found = [{"anchor": signed(a), "content": signed(c)} for _, _, a, c in stretches(words)]
            rows.append((len(words), hashlib.sha256(b" ".join(words)).hexdigest(), found))
        return pd.DataFrame(rows, columns=["n_words", "whole", "stretches"])

    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select("doc_id", F.unhex(F.md5(text.cast("binary"))).alias("key"), read(text).alias("r"))
    return staged(rows.select("doc_id", "key", "r.*"), "substring-scan")


def marks_of(texts: DataFrame, hot: int) -> DataFrame:
    """key and marks, the numbers and states of its stretches whose anchor occurs more than once: `same` if
    all stretches of the anchor are alike, else `mixed`, or `hot` if they are many."""
    each = texts.select("key", F.posexplode("stretches").alias("at", "s")).select("key", "at", "s.anchor", "s.content")
    anchors = each.groupBy("anchor").agg(
        F.count("*").alias("n"), F.min("content").alias("low"), F.max("content").alias("high")).where("n > 1")
    state = F.when(F.col("low") == F.col("high"), "same").when(F.col("n") > hot, "hot").otherwise("mixed")
    # Staged, so that both sides of the join are dealt anew and a hot anchor's stretches can be split.
    states = staged(anchors.select("anchor", state.alias("state")), "substring-anchors")
    marked = each.join(states, "anchor")
    return marked.groupBy("key").agg(F.collect_list(F.struct("at", "state")).alias("marks"))


def cut_texts(docs: DataFrame, marks: DataFrame, hot: int) -> DataFrame:
    """Of each marked text: key, text, starts of windows known to be repeated, and cuts that an automaton
    must judge; staged."""

    @F.pandas_udf(f"sure array<int>, cuts {CUTS}")
    def cut(texts: pd.Series, marked: pd.Series) -> pd.DataFrame:
        rows = []
        for text, marks in zip(texts, marked):
            words, sure, cuts = words_of(text), [], []
            found = stretches(words)
            for mark in marks:
                lo, hi, anchor, content = found[mark["at"]]
                if mark["state"] == "same":
                    sure += range(lo, hi + 1)
                elif mark["state"] == "mixed":
                    cuts.append((lo, signed(anchor), signed(content), b" ".join(words[lo:hi + SPAN]).decode()))
                else:
                    for start in range(lo, hi + 1):
                        window = b" ".join(words[start:start + SPAN])
                        own = signed(xxhash.xxh3_64_intdigest(window, 1))
                        cuts.append((start, own, signed(xxhash.xxh3_64_intdigest(window)), window.decode()))
            rows.append((sure, [dict(zip(("start", "anchor", "content", "words"), c)) for c in cuts]))
        return pd.DataFrame(rows, columns=["sure", "cuts"])

    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    # Copies collapse within their tasks, before one of each travels to its marks.
    texts = docs.select(F.unhex(F.md5(text.cast("binary"))).alias("key"), text.alias("text")).dropDuplicates(["key"])
    wanted = texts.join(marks, "key")
    return staged(wanted.select("key", "text", cut("text", "marks").alias("r")).select("key", "text", "r.*"), "substring-cuts")


def judge(cuts: DataFrame) -> DataFrame:
    """anchor, content and starts (within the cut) of its repeated windows, by one automaton per anchor."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[tuple[int, int, int, str]] = []
        for batch in batches:
            out = []
            for row in zip(batch["anchor"], batch["content"], batch["n"], batch["words"]):
                if held and held[-1][0] != row[0]:
                    out += solve(held)
                    held = []
                held.append(row)
            yield pd.DataFrame(out, columns=["anchor", "content", "starts"])
        yield pd.DataFrame(solve(held), columns=["anchor", "content", "starts"])

    def solve(rows) -> list[tuple[int, int, list[int]]]:
        sequences = [(row[3].split(" "), int(row[2])) for row in rows]
        automaton = SuffixAutomaton(sequences) if len(rows) > 1 else None
        out = []
        for row, (words, n) in zip(rows, sequences):
            starts = list(range(len(words) - SPAN + 1)) if n > 1 else automaton.repeated(words, SPAN) if automaton else []
            if starts:
                out.append((row[0], row[1], starts))
        return out

    distinct = cuts.groupBy("anchor", "content").agg(F.count("*").alias("n"), F.first("words").alias("words"))
    sorted_cuts = distinct.repartition("anchor").sortWithinPartitions("anchor")
    return sorted_cuts.mapInPandas(run, "anchor long, content long, starts array<int>")


def removals(docs: DataFrame, hot: int = HOT) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 of every row."""

    @F.pandas_udf("n_removed long, kept string")
    def remove(texts: pd.Series, sure: pd.Series, judged: pd.Series) -> pd.DataFrame:
        rows = []
        for text, starts, more in zip(texts, sure, judged):
            words = words_of(text)
            every = [*starts, *(s for some in (more if more is not None else []) for s in some)]
            rows.append(digest(words, covered(len(words), every)))
        return pd.DataFrame(rows, columns=["n_removed", "kept"])

    scanned = scan(docs)
    texts = scanned.groupBy("key").agg(F.count("*").alias("copies"), F.first("stretches").alias("stretches"))
    texts = staged(texts, "substring-texts")
    marked = cut_texts(docs, marks_of(texts, hot), hot)
    each = marked.select("key", F.explode("cuts").alias("c")).select("key", "c.*")
    found = judge(each)
    shifted = F.transform("starts", lambda s: s + F.col("start")).alias("starts")
    judged = (each.select("key", "start", "anchor", "content").join(found, ["anchor", "content"])
              .select("key", shifted).groupBy("key").agg(F.collect_list("starts").alias("judged")))
    changed = marked.select("key", "text", "sure").join(judged, "key", "left").select("key", remove("text", "sure", "judged").alias("r"))
    copied = texts.where("copies > 1").select("key", F.lit(True).alias("copied"))
    empty = F.lit(hashlib.sha256(b"").hexdigest())
    every = F.col("copied").isNotNull() & (F.col("n_words") >= SPAN)
    return (
        scanned.select("doc_id", "key", "n_words", "whole")
        .join(changed.select("key", "r.*"), "key", "left").join(copied, "key", "left")
        .select(
            "doc_id", "n_words",
            F.when(every, F.col("n_words")).otherwise(F.coalesce("n_removed", F.lit(0))).cast("long").alias("n_removed"),
            F.when(every, empty).otherwise(F.coalesce("kept", "whole")).alias("kept_sha256"))
    )
