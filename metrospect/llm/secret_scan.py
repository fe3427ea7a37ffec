"""Secret scans: fixed patterns, and formats inferred from the credentials that they find.

The patterns give labelled credentials per kind. Character classes of a bounded sample of them form a
prefix tree with counts; states whose outgoing frequencies agree by Hoeffding's bound, recursively, are
merged (state merging of probabilistic automata, red-blue order). The background is a chain of character
classes, whose counts are summed by Spark over all candidates of all texts. Every candidate is then scored by the
better log-likelihood ratio of a credential automaton against that background, and becomes a span of kind
`format` above THRESHOLD.

Candidates are all runs of token characters, SHORTEST or longer, that a base span does not cover whole.
Samples: SAMPLE distinct values per kind of at most LONGEST characters, those of the smallest hash, whatever the
size of the table; longer credentials are not learned from, but scored over all their characters. The sample and the
class counts (at most 64) fit on the driver; automata have at most SAMPLE * LONGEST states and travel with the task.

Defined cases: null text counts as empty and has no spans; no labelled credentials: no format spans; repeated
rows and null ids pass through row by row; an empty table gives an empty result; other columns are not read
(redact keeps them).
"""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter, defaultdict
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from metrospect.session import staged

KINDS = ("assign", "access", "hex", "format")
ASSIGN = re.compile(
    r"""(?ia:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")
SHORTEST = 8
TOKEN = re.compile(rf"[A-Za-z0-9+/_=-]{{{SHORTEST},}}")
SAMPLE = 400
LONGEST = 256
ALPHA = 0.05
THRESHOLD = 12.0
SMOOTH = 0.5
PRIOR = 100
CLASSES = (("digit", "0123456789"), ("af", "abcdef"), ("gz", "ghijklmnopqrstuvwxyz"),
           ("AF", "ABCDEF"), ("GZ", "GHIJKLMNOPQRSTUVWXYZ"), ("mark", "+/_=-."))
CLASS_OF = {char: (name, len(chars)) for name, chars in CLASSES for char in chars}
#: A letter for each class, and the space for the ends of a token.
NAMES = {str(i): name for i, (name, _) in enumerate(CLASSES)} | {" ": None}
SHAPES = str.maketrans({char: str(i) for i, (_, chars) in enumerate(CLASSES) for char in chars})
Span = tuple[int, int, str]


def base_spans(text: str) -> list[tuple[str, int, int, str]]:
    """(kind, start, end, value) of the fixed patterns, in code points; the value is the credential."""
    found = []
    if ":" in text or "=" in text:
        found += [("assign", m.start(), m.end(), m[2]) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    if "AKIA" in text:
        found += [("access", m.start(), m.end(), m[0]) for m in ACCESS.finditer(text) if len(m[0]) >= 20]
    found += [("hex", m.start(), m.end(), m[0]) for m in HEX.finditer(text)]
    return found


def candidates(text: str, base: list) -> Iterator[tuple[int, int, str]]:
    """Tokens of which a character lies outside all base spans."""
    taken = sorted((start, end) for _, start, end, _ in base)
    at, reach = 0, 0
    for match in TOKEN.finditer(text):
        start, end = match.span()
        free = False
        reach = max(reach, start)
        while at < len(taken) and taken[at][0] < end:
            # A gap before the next span is free, if it lies in the token.
            free |= taken[at][0] > reach
            reach = max(reach, taken[at][1])
            at += 1
        if free or reach < end:
            yield start, end, match[0]


def letters(value: str) -> list[tuple[str, int]]:
    """Class and class size of each character."""
    return [CLASS_OF.get(char, ("rest", 64)) for char in value]


class Automaton:
    """A probabilistic automaton over character classes, inferred by merging states of a prefix tree."""

    def __init__(self, values: list[str], alpha: float = ALPHA):
        self.bound = math.sqrt(0.5 * math.log(2 / alpha))
        self.next: list[dict[str, int]] = [{}]
        self.count: list[dict[str, int]] = [defaultdict(int)]
        self.ends: list[int] = [0]
        for value in values:
            state = 0
            for name, _ in letters(value):
                self.count[state][name] += 1
                if name not in self.next[state]:
                    self.next[state][name] = len(self.next)
                    self.next.append({})
                    self.count.append(defaultdict(int))
                    self.ends.append(0)
                state = self.next[state][name]
            self.ends[state] += 1
        self.merge_states()

    def total(self, state: int) -> int:
        return self.ends[state] + sum(self.count[state].values())

    def compatible(self, a: int, b: int) -> bool:
        """Whether the frequencies of two states, and of all that follow them, agree."""
        waiting, seen = [(a, b)], set()
        while waiting:
            a, b = waiting.pop()
            if (a, b) in seen or a == b:
                continue
            seen.add((a, b))
            n, m = self.total(a), self.total(b)
            if n and m:
                margin = self.bound * (1 / math.sqrt(n) + 1 / math.sqrt(m))
                if abs(self.ends[a] / n - self.ends[b] / m) > margin:
                    return False
                for name in self.count[a].keys() | self.count[b].keys():
                    if abs(self.count[a].get(name, 0) / n - self.count[b].get(name, 0) / m) > margin:
                        return False
            waiting += [(self.next[a][name], self.next[b][name]) for name in self.next[a].keys() & self.next[b].keys()]
        return True

    def fold(self, into: int, state: int) -> None:
        """Add a subtree's counts to the automaton below `into`."""
        waiting = [(into, state)]
        while waiting:
            into, state = waiting.pop()
            self.ends[into] += self.ends[state]
            for name, n in self.count[state].items():
                self.count[into][name] += n
            for name, below in self.next[state].items():
                if name in self.next[into]:
                    waiting.append((self.next[into][name], below))
                else:
                    self.next[into][name] = below

    def merge_states(self) -> None:
        """Red states are final; a blue one, reached from a red one, merges into the first compatible red
        state or turns red."""
        red, at = [0], 0
        while at < len(red):
            source = red[at]
            again = False
            for name, blue in sorted(self.next[source].items()):
                if blue in red:
                    continue
                host = next((state for state in red if self.compatible(state, blue)), None)
                if host is None:
                    red.append(blue)
                else:
                    self.next[source][name] = host
                    self.fold(host, blue)
                    again = True
            at = 0 if again else at + 1

    def accepts(self, value: str) -> bool:
        """Whether every step of the string was seen in learning, and it may end where it does."""
        state = 0
        for name, _ in letters(value):
            if not self.count[state].get(name, 0):
                return False
            state = self.next[state][name]
        return self.ends[state] > 0

    def score(self, value: str) -> float:
        """Log likelihood of a string; unseen steps have a small share, and what follows one is anyone's."""
        total, state = 0.0, 0
        options = len(CLASSES) + 2
        for name, size in letters(value):
            if state is None:
                total -= math.log(options * size)
                continue
            n = self.total(state)
            total += math.log((self.count[state].get(name, 0) + SMOOTH) / (n + SMOOTH * options) / size)
            state = self.next[state].get(name)
        if state is None:
            return total - math.log(options)
        return total + math.log((self.ends[state] + SMOOTH) / (self.total(state) + SMOOTH * options))


class Background:
    """A chain of character classes with the counts of all candidates; None stands before and after a token.

    What follows a class is drawn PRIOR counts strong towards what follows any class, so that a few unlabelled
    credentials among the candidates do not make their own transitions look common.
    """

    def __init__(self, pairs: dict[tuple[str | None, str | None], int]):
        after, total, options = Counter(), Counter(), len(CLASSES) + 2
        for (before, name), n in pairs.items():
            after[name] += n
            total[before] += n
        everything = sum(after.values()) + SMOOTH * options
        names = [name for name, _ in CLASSES] + ["rest", None]
        self.step = {
            (before, name): math.log((pairs.get((before, name), 0) + PRIOR * (after[name] + SMOOTH) / everything) / (total[before] + PRIOR))
            for before in names for name in names}

    def score(self, value: str) -> float:
        """Log likelihood of a string."""
        total, before = 0.0, None
        for name, size in letters(value):
            total += self.step[before, name] - math.log(size)
            before = name
        return total + self.step[before, None]


class Formats:
    """Automata of credentials by kind, and the chain of all candidates."""

    def __init__(self, samples: dict[str, list[str]], pairs: dict[tuple[str | None, str | None], int] | None = None):
        self.background = Background(pairs or {})
        self.kinds = {kind: Automaton(sorted(values)) for kind, values in sorted(samples.items()) if values}

    def ratio(self, value: str) -> float:
        """Best log-likelihood ratio of a credential format that accepts the string against the background."""
        best = max((automaton.score(value) for automaton in self.kinds.values() if automaton.accepts(value)), default=-math.inf)
        return best - self.background.score(value)


def fit(docs: DataFrame, sample: int = SAMPLE) -> Formats:
    """Infer the formats from the table's own labelled credentials, and the background from all candidates."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        least: dict[str, dict[str, str]] = defaultdict(dict)
        pairs: Counter = Counter()

        def keep(kind: str, value: str) -> None:
            kept = least[kind]
            kept[hashlib.md5(value.encode()).hexdigest()] = value
            if len(kept) >= 4 * sample:
                for order in sorted(kept)[sample:]:
                    del kept[order]

        for batch in batches:
            tokens: Counter = Counter()
            for text in batch["text"]:
                base = base_spans(text or "")
                for kind, _, _, value in base:
                    if len(value) <= LONGEST:
                        keep(kind, value)
                tokens.update(value for _, _, value in candidates(text or "", base))
            for value, n in tokens.items():
                # Classes by one letter each; a space stands before and after.
                shape = f" {value.translate(SHAPES)} "
                for pair in map("".join, zip(shape, shape[1:])):
                    pairs[pair] += n
        rows = [(kind, order, kept[order], 0) for kind, kept in least.items() for order in sorted(kept)[:sample]]
        rows += [("pair", pair, "", n) for pair, n in pairs.items()]
        yield pd.DataFrame(rows, columns=["kind", "order_key", "value", "n"])

    seen = staged(docs.select(F.col("text").cast("string").alias("text")).mapInPandas(
        run, "kind string, order_key string, value string, n long"), "secret-samples")
    samples: dict[str, list[str]] = {}
    for kind in ("assign", "access", "hex"):
        rows = seen.where(F.col("kind") == kind).select("order_key", "value").distinct().orderBy("order_key").limit(sample).collect()
        samples[kind] = [row["value"] for row in rows]
    counts = seen.where(F.col("kind") == "pair").groupBy("order_key").agg(F.sum("n").alias("n")).collect()
    return Formats(samples, {(NAMES[row["order_key"][0]], NAMES[row["order_key"][1]]): row["n"] for row in counts})


def spans(text: str, formats: Formats, threshold: float = THRESHOLD, memo: dict[str, bool] | None = None) -> list[Span]:
    """(start, end, kind) of all spans, by start, then kind as listed."""
    base = base_spans(text)
    found = [(start, end, kind) for kind, start, end, _ in base]
    memo = {} if memo is None else memo
    for start, end, value in candidates(text, base):
        flagged = memo.get(value)
        if flagged is None:
            if len(memo) > 100_000:
                memo.clear()
            flagged = memo[value] = formats.ratio(value) > threshold
        if flagged:
            found.append((start, end, "format"))
    return sorted(found, key=lambda s: (s[0], KINDS.index(s[2]), s[1]))


def written(found: list[Span]) -> str:
    return ",".join(f"{kind}:{start}:{end}" for start, end, kind in found)


def scan(docs: DataFrame, formats: Formats, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id and spans (array of kind, start, end; code points, end exclusive) of every row."""

    @F.pandas_udf("array<struct<kind:string,start:long,end:long>>")
    def find(texts: pd.Series) -> pd.Series:
        memo: dict[str, bool] = {}
        return pd.Series([
            [{"kind": kind, "start": start, "end": end} for start, end, kind in spans(text or "", formats, threshold, memo)]
            for text in texts], dtype=object)

    return docs.select("doc_id", find(F.col("text").cast("string")).alias("spans"))


def digest(scanned: DataFrame) -> DataFrame:
    """doc_id, counts per kind, the hash of the base spans and all spans as text."""
    text = lambda array: F.array_join(F.transform(array, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    number = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    base = F.filter("spans", lambda s: s["kind"] != "format")
    return scanned.select("doc_id", *map(number, KINDS), F.sha2(text(base), 256).alias("base_sha256"), text(F.col("spans")).alias("spans"))


def redacted(text: str, found: list[Span]) -> str:
    """The text with every span, overlapping ones as one, replaced by [kind]."""
    out, at = [], 0
    for start, end, kind in found:
        if end <= at:
            continue
        if start >= at:
            out += [text[at:start], f"[{kind}]"]
        at = end
    return "".join([*out, text[at:]])


def redact(docs: DataFrame, formats: Formats, threshold: float = THRESHOLD) -> DataFrame:
    """All columns, with secrets in text replaced and n_chars, if there is one, counted anew where text changed."""

    @F.pandas_udf("string")
    def clean(texts: pd.Series) -> pd.Series:
        memo: dict[str, bool] = {}
        return texts.map(lambda text: text if text is None else redacted(text, spans(text, formats, threshold, memo)))

    row = docs.select(F.struct("*").alias("row")).withColumn("clean", clean(F.col("row.text").cast("string")))
    cleaned = []
    for name in docs.columns:
        column = F.col("row").getField(name)
        if name == "text":
            column = F.col("clean")
        elif name == "n_chars":
            changed = ~F.col("clean").eqNullSafe(F.col("row.text"))
            column = F.when(changed, F.length("clean").cast("long")).otherwise(column)
        cleaned.append(column.alias(name))
    return row.select(*cleaned)
