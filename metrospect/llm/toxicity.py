"""Toxicity: a weighted lexicon, matched by Aho-Corasick in folded text.

Folding lower-cases, maps homoglyphs to Latin letters and, in words that hold a letter, digits and signs
that stand for letters. Lexicon terms are words or beginnings of words, learned from labelled rows: each
gets the smoothed log odds of toxic against clean documents that hold it. A beginning is kept only if no
longer one does the same work; beginnings have SHORTEST to LONGEST letters, whole words any number. Phrases of two words that hold a term but mostly occur in clean documents
are exceptions and cancel the hit. The weights of a text's hits are summed and divided by its length in
words to the power LENGTH_POWER; a logistic curve, fitted on the labelled rows, maps that to 0..1.

Labels may be many; the model is fitted on the distinct texts of about FIT_ROWS of them, chosen by the hash of the text, and has
at most TERMS terms and EXCEPTIONS phrases. Only these travel to tasks. Every text is scored
whole, in the scan.

Defined cases: null and empty texts have no hits and get the score of a text without hits; labels that are
null or of unknown documents do not count, and a document labelled several times counts for each label;
without labels of both classes every score is the smoothed share of toxic labels, 0 at most 0.49 without
any; repeated rows and null ids pass through; other columns are never read by a score.
"""

from __future__ import annotations

import math
import re
import unicodedata
from collections import Counter
from collections.abc import Iterator
from itertools import islice

import ahocorasick
import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from metrospect.session import staged, staged_counted

FIT_ROWS = 24_000
TERMS = 5_000
EXCEPTIONS = 2_000
SHORTEST, LONGEST = 3, 12
LEAST_DOCS = 2
LEAST_WEIGHT = 2.0
LENGTH_POWER = 0.5
BINS = 400
# Letters that look like Latin ones (Cyrillic, Greek, Armenian, Latin variants), characters without
# width, and digits and signs used for letters. Full-width and mathematical letters fold by compatibility.
HOMOGLYPHS = str.maketrans(
    "аеорсухівкмнтѕјӏԁԛԝѵһ" "αβεικνορτυχγϲϳω" "օսոհ" "ıɑɡɩʋ",
    "aeopcyxibkmhtsjldqwvh" "abeikvoptuxycjw" "ounh" "iagiv")
WIDTHLESS = dict.fromkeys([0xAD, 0x200B, 0x200C, 0x200D, 0x2060, 0xFEFF])
STANDINS = str.maketrans("013457@$", "oieastas")
MIXED = re.compile(r"(?<![\w@$])[\w@$]*[013457@$][\w@$]*")
WORD = re.compile(r"[^\W_]+")


def folded(text: str) -> str:
    """Lower case, homoglyphs as Latin letters, stand-ins as letters in words that hold a letter."""
    if not text.isascii():
        text = unicodedata.normalize("NFKC", text.translate(WIDTHLESS)).lower().translate(HOMOGLYPHS)
    return MIXED.sub(with_letters, text.lower())


def with_letters(word: re.Match) -> str:
    return word[0].translate(STANDINS) if any(map(str.isalpha, word[0])) else word[0]


class Lexicon:
    """Terms with weights, exception phrases and the logistic curve."""

    def __init__(self, terms: dict[str, float], exceptions: list[str], slope: float, offset: float):
        """A term is a beginning of words, or a whole word if it ends with a space."""
        self.terms, self.exceptions, self.slope, self.offset = terms, exceptions, slope, offset
        self._ready = None

    def __getstate__(self):
        return {**self.__dict__, "_ready": None}

    def automata(self):
        if self._ready is None:
            hits, cancels = ahocorasick.Automaton(), ahocorasick.Automaton()
            for term, weight in self.terms.items():
                hits.add_word(term.rstrip(" "), (term.rstrip(" "), max(weight, self.terms.get(term.rstrip(" "), -9.0)), term.rstrip(" ") not in self.terms))
            for phrase in self.exceptions:
                cancels.add_word(f" {phrase} ", len(phrase))
            for automaton in (hits, cancels):
                if len(automaton):
                    automaton.make_automaton()
            self._ready = hits, cancels
        return self._ready

    def hits(self, text: str) -> list[tuple[int, int, float]]:
        """(start, end, weight) of the terms in folded text: the heaviest one per word start, less
        those under an exception."""
        automaton, _ = self.automata()
        if not len(automaton):
            return []
        best: dict[int, tuple[int, float]] = {}
        for last, (term, weight, whole) in automaton.iter(text):
            start = last - len(term) + 1
            if start and text[start - 1].isalnum():
                continue
            if whole and last + 1 < len(text) and text[last + 1].isalnum():
                continue
            if start not in best or best[start][1] < weight:
                best[start] = (last + 1, weight)
        found = [(start, end, weight) for start, (end, weight) in sorted(best.items())]
        return [hit for hit in found if not self.excepted(text, hit)] if self.exceptions else found

    def excepted(self, text: str, hit: tuple[int, int, float]) -> bool:
        around = f" {' '.join(phrase_words(text, hit[0]))} "
        return any(True for _ in self.automata()[1].iter(around))

    def strength(self, text: str | None) -> float:
        """Weights of the hits over a power of the number of words."""
        text = folded(text or "")
        found = self.hits(text)
        if not found:
            return 0.0
        return sum(weight for _, _, weight in found) / (1 + len(WORD.findall(text))) ** LENGTH_POWER

    def score(self, strength: float) -> float:
        return 1 / (1 + math.exp(-max(-60.0, min(60.0, self.slope * strength + self.offset))))


def phrase_words(text: str, start: int) -> list[str]:
    """The word before, at and after a place."""
    end = start
    while end and not WORD.match(text[end - 1]):
        end -= 1
    begin = end
    while begin and WORD.match(text[begin - 1]):
        begin -= 1
    after = [match[0] for match in islice(WORD.finditer(text, start), 2)]
    return [text[begin:end], *after] if end else after


def pick_terms(counted: list[tuple[str, int, float]]) -> dict[str, float]:
    """Weights of the terms kept from (term, toxic documents, weight)."""
    weight = {t: w for t, _, w in counted}
    of = {t: a for t, a, _ in counted}
    longer_same = {t[:-1] for t in of if of[t] >= 0.98 * of.get(t[:-1], math.inf)}
    kept: dict[str, float] = {}
    for term in sorted(of, key=lambda t: (len(t), t)):
        if term in longer_same:
            continue
        above = [term[:k] for k in range(SHORTEST, len(term))]
        if any(up in kept and kept[up] >= weight[term] - 1.0 for up in above):
            continue
        kept[term] = weight[term]
    return kept


def labelled(docs: DataFrame, labels: DataFrame, fit_rows: int = FIT_ROWS) -> DataFrame:
    """text and toxic of the labelled rows to learn from: all, or beyond fit_rows of them a share by the
    hash of the text that leaves about fit_rows."""
    known = labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull()).select("doc_id", "toxic")
    share = min(1.0, fit_rows / max(known.count(), 1))
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.where(~held_out(F.col("doc_id"))).select("doc_id", text.alias("text"))
    rows = rows.where(F.pmod(F.xxhash64("text"), F.lit(1 << 30)) < int(share * (1 << 30)))
    rows = rows.join(known, "doc_id").select("text", (F.col("toxic") >= 1).cast("int").alias("toxic"))
    # Copies are one text to learn from; they collapse within their tasks.
    return staged(rows.distinct().repartition(24), "toxicity-labels")


def held_out(doc_id):
    """Whether a document's labels are kept back: crc32 of its id as text divides by 5."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def fit(docs: DataFrame, labels: DataFrame, fit_rows: int = FIT_ROWS) -> Lexicon:
    """Learn terms, exceptions and the curve from the labelled rows of the table."""
    rows = labelled(docs, labels, fit_rows)
    classes = {r["toxic"]: r["n"] for r in rows.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    toxic, clean = classes.get(1, 0), classes.get(0, 0)
    if not toxic or not clean:
        share = min((toxic + 0.5) / (toxic + clean + 1), 0.49) if not toxic else (toxic + 0.5) / (toxic + clean + 1)
        return Lexicon({}, [], 0.0, math.log(share / (1 - share)))

    def count_terms(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for label, texts in batch.groupby("toxic")["text"]:
                counts: Counter[str] = Counter()
                for text in texts:
                    words = set(WORD.findall(folded(text)))
                    terms = {word[:k] for word in words for k in range(SHORTEST, min(len(word), LONGEST) + 1)}
                    counts.update(terms | {f"{word} " for word in words})
                yield pd.DataFrame({"term": list(counts), "toxic": label, "n": list(counts.values())})

    # Terms of toxic documents come first: a term without LEAST_DOCS of them cannot be kept.
    of_toxic = rows.where("toxic = 1").mapInPandas(count_terms, "term string, toxic int, n long")
    of_toxic = of_toxic.groupBy("term").agg(F.sum("n").alias("a")).where(F.col("a") >= LEAST_DOCS)
    of_toxic, tried = staged_counted(of_toxic, "toxicity-terms")
    of_clean = rows.where("toxic = 0").mapInPandas(count_terms, "term string, toxic int, n long")
    of_clean = of_clean.groupBy("term").agg(F.sum("n").alias("b"))
    odds = F.log((F.col("a") + 0.5) / (toxic + 1)) - F.log((F.coalesce("b", F.lit(0)) + 0.5) / (clean + 1))
    # Log likelihood ratio of the term's own share of toxic documents against the share of all. Terms that
    # stay below what the best of so many terms reaches by chance weigh less.
    share, seen = toxic / (toxic + clean), F.col("a") + F.col("b")
    evidence = F.col("a") * F.log(F.col("a") / (seen * share)) + F.when(
        F.col("b") > 0, F.col("b") * F.log(F.col("b") / (seen * (1 - share)))).otherwise(0.0)
    counted = (
        of_toxic.join(of_clean, "term", "left")
        .withColumn("b", F.coalesce("b", F.lit(0)))
        .select("term", "a", "b", (odds * F.least(F.lit(1.0), evidence / math.log(tried + 2)) ** 2).alias("weight"), odds.alias("odds"))
        .where((F.col("odds") >= LEAST_WEIGHT) & (F.col("weight") >= LEAST_WEIGHT / 4)).orderBy(F.desc(F.col("a") * F.col("weight")), "term").limit(TERMS).collect()
    )
    terms = pick_terms([(r["term"], r["a"], r["weight"]) for r in counted])
    lexicon = Lexicon(terms, learned_exceptions(rows, Lexicon(terms, [], 1.0, 0.0)), 1.0, 0.0)
    lexicon.slope, lexicon.offset = curve(rows, lexicon)
    return lexicon


def learned_exceptions(rows: DataFrame, lexicon: Lexicon) -> list[str]:
    """Two-word phrases with a hit, in at least three clean documents and four times as many as toxic ones."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = []
            for text, label in zip(batch["text"], batch["toxic"]):
                text, phrases = folded(text), set()
                for start, _, _ in lexicon.hits(text):
                    words = phrase_words(text, start)
                    phrases |= {f"{a} {b}" for a, b in zip(words, words[1:])}
                found += [(phrase, int(label)) for phrase in phrases]
            yield pd.DataFrame(found, columns=["phrase", "toxic"])

    per = rows.mapInPandas(run, "phrase string, toxic int").groupBy("phrase").agg(
        F.sum("toxic").alias("a"), F.sum(1 - F.col("toxic")).alias("b"))
    kept = per.where("b >= 3 and b >= 4 * a").orderBy(F.desc("b"), "phrase").limit(EXCEPTIONS).collect()
    return [r["phrase"] for r in kept]


def curve(rows: DataFrame, lexicon: Lexicon) -> tuple[float, float]:
    """Slope and offset of the logistic curve over strengths, from at most BINS counts per class."""
    strengths = rows.select(scored_strength(lexicon)("text").alias("x"), "toxic")
    step = F.least(F.floor(F.col("x") * 100 / F.lit(4)), F.lit(BINS - 1))
    bins = strengths.groupBy(F.when(F.col("x") > 0, step + 1).otherwise(0).alias("bin"), "toxic").agg(
        F.avg("x").alias("x"), F.count("*").alias("n")).collect()
    x = np.array([r["x"] for r in bins])
    y = np.array([r["toxic"] for r in bins], float)
    n = np.array([r["n"] for r in bins], float)
    design, theta = np.stack([x, np.ones_like(x)], axis=1), np.zeros(2)
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(design @ theta, -30, 30)))
        gradient = design.T @ (n * (y - p)) - 1e-3 * theta
        hessian = (design * (n * p * (1 - p))[:, None]).T @ design + 1e-3 * np.eye(2)
        move = np.linalg.solve(hessian, gradient)
        theta += np.clip(move, -5, 5)
        if np.abs(move).max() < 1e-9:
            break
    return float(theta[0]), float(theta[1])


def scored_strength(lexicon: Lexicon):
    @F.pandas_udf("double")
    def strength(texts: pd.Series) -> pd.Series:
        return pd.Series([lexicon.strength(text) for text in texts], dtype="float64")

    return strength


def scores(lexicon: Lexicon):
    """A column function: the score of a text, 0 to 1."""

    @F.pandas_udf("double")
    def score(texts: pd.Series) -> pd.Series:
        return pd.Series([lexicon.score(lexicon.strength(text)) for text in texts], dtype="float64")

    return score


def score_documents(docs: DataFrame, lexicon: Lexicon) -> DataFrame:
    """doc_id, held_out, score, predicted of every row."""
    rows = docs.select("doc_id", scores(lexicon)(F.col("text").cast("string")).alias("score"))
    return rows.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def without_toxic(docs: DataFrame, lexicon: Lexicon) -> DataFrame:
    """The rows whose score is below 0.5, with all their columns."""
    row = docs.select(F.struct("*").alias("row")).withColumn("score", scores(lexicon)(F.col("row.text").cast("string")))
    return row.where("score < 0.5").select("row.*")
