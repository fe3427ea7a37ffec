"""Byte-level BPE by dynamic programming over prefixes.

For each byte prefix of a piece the table holds the one token that the encoding of that prefix ends in.
Token t may end prefix i if the token that ends prefix i - len(t) and t stay apart when their bytes are
merged together; exactly one token passes. Reading the table backwards gives the ids. An append only adds
entries; an edit recomputes entries from the edit on and stops when the old table has been met again
for as long as the longest token.

The rank file is a parameter of bounded size (a vocabulary) and is broadcast. Tables and caches live inside
a task and are bounded. Texts are encoded where they are scanned; nothing is shuffled.

Defined cases: null text counts as empty and gives no ids; repeated rows and null ids pass through row by
row; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Callable

import ahocorasick
import pandas as pd
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from metrospect.llm.recent import Recent

CACHE_BYTES = 64 << 20
PAIRS = 400_000
LONGEST_REMEMBERED = 64


def parse_ranks(raw: bytes) -> dict[bytes, int]:
    """Token bytes to rank, from lines of `base64 rank`."""
    return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, raw.splitlines())}


class PrefixEncoder:
    """Encodes by prefix tables; one per task."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.ranks = ranks
        self.token = {rank: token for token, rank in ranks.items()}
        self.by_digits = {str(rank).encode(): token for token, rank in ranks.items()}
        self.split = regex.compile(pattern).findall
        self.pieces = regex.compile(pattern).finditer
        self.longest = max(map(len, ranks))
        self.ends = ahocorasick.Automaton()
        for token, rank in ranks.items():
            self.ends.add_word(token.decode("latin-1"), (rank, len(token)))
        self.ends.make_automaton()
        self.apart: dict[int, bool] = {}
        self.spines: tuple[dict, dict] = ({}, {})
        self.alone: dict[int, bool] = {}
        self.known = Recent(CACHE_BYTES)

    def merged(self, data: bytes, down_to: int = 1) -> list[bytes]:
        """Merges by rank as defined, for the short string of one token."""
        parts = [data[i:i + 1] for i in range(len(data))]
        while len(parts) > down_to:
            rank, at = min((self.ranks.get(a + b, 1 << 30), i) for i, (a, b) in enumerate(zip(parts, parts[1:])))
            if rank == 1 << 30:
                break
            parts[at:at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def spine(self, token: int, side: int) -> list[tuple[bytes, int, int]]:
        """The parts of a token at its left (0) or right (1) rim while it is merged, the whole first: bytes,
        the rank at which a part arises, the rank at which it is merged away."""
        found = self.spines[side].get(token)
        if found is None:
            data, gone, found = self.token[token], 1 << 30, []
            while True:
                born = self.ranks[data] if len(data) > 1 else -1
                found.append((data, born, gone))
                if len(data) == 1:
                    break
                data, gone = self.merged(data, 2)[side], born
            self.spines[side][token] = found
        return found

    def stays_apart(self, left: int, right: int) -> bool:
        """Whether the merges of both tokens' bytes end in just these two tokens: no part at the right rim
        of one merges with a part at the left rim of the other while both are there. Of equal ranks
        the leftmost merges first."""
        get = self.ranks.get
        for a, a_born, a_gone in self.spine(left, 1):
            for b, b_born, b_gone in self.spine(right, 0):
                if a_born < b_gone and b_born < a_gone:
                    rank = get(a + b)
                    if rank is not None and rank < a_gone and rank <= b_gone:
                        return False
        return True

    def stands_alone(self, token: int) -> bool:
        found = self.alone.get(token)
        if found is None:
            found = self.alone[token] = len(self.merged(self.token[token])) == 1
        return found

    def last_tokens(self, data: bytes, table: list[int], enough: Callable[[int], bool] | None = None) -> None:
        """Fill the entries that the table lacks, in order, until `enough` says so of a prefix length.

        The automaton names every token that ends at a byte; `longest` bytes before the gap are enough for it.
        """
        known, add = self.apart.get, table.append
        base = max(0, len(table) - self.longest)
        wanted, beyond = len(table) - base - 1, base + 1
        for at, (token, size) in self.ends.iter(data[base:].decode("latin-1")):
            if at != wanted:
                continue
            start = at - size + beyond
            if start:
                pair = table[start] << 32 | token
                fits = known(pair)
                if fits is None:
                    fits = self.compared(pair, table[start], token)
            else:
                fits = self.stands_alone(token)
            if fits:
                add(token)
                wanted += 1
                if enough and enough(at + beyond):
                    return

    def compared(self, pair: int, left: int, right: int) -> bool:
        if len(self.apart) >= PAIRS:
            self.apart.clear()
        fits = self.apart[pair] = self.stays_apart(left, right)
        return fits

    def table(self, data: bytes, known: list[int] | None = None) -> list[int]:
        """Entry i is the last token of data[:i] (entry 0 is unused); `known` entries are kept."""
        table = list(known) if known else [-1]
        self.last_tokens(data, table)
        if len(table) != len(data) + 1:
            raise ValueError("these ranks do not encode every byte")
        return table

    def edited(self, old: bytes, table: list[int], start: int, stop: int, new: bytes) -> tuple[bytes, list[int]]:
        """The data and table after old[start:stop] is replaced by new.

        Entries up to start stay. Once more entries than the longest token has bytes agree with the old
        table beyond the edit, all later ones are the old ones, as each depends on that many before it only.
        """
        data = old[:start] + new + old[stop:]
        shift = len(new) - (stop - start)
        fresh, same = table[:start + 1], 0

        def met(end: int) -> bool:
            nonlocal same
            beyond = end - shift > stop and end > start + len(new)
            same = same + 1 if beyond and table[end - shift] == fresh[end] else 0
            return same > self.longest

        self.last_tokens(data, fresh, met)
        return data, fresh + table[len(fresh) - shift:]

    def ids_of(self, data: bytes, table: list[int]) -> list[int]:
        """The ids that a table stands for. A piece that is a token as a whole is that token."""
        whole = self.ranks.get(data)
        if whole is not None:
            return [whole]
        ids, end = [], len(data)
        while end:
            ids.append(table[end])
            end -= len(self.token[table[end]])
        return ids[::-1]

    def piece(self, text: str) -> bytes:
        """The ids of one match of the pattern, in decimal, each after a space; remembered unless it is long."""
        data = text.encode()
        whole = self.ranks.get(data)
        ids = [whole] if whole is not None else self.ids_of(data, self.table(data))
        entry = b" " + " ".join(map(str, ids)).encode()
        if len(text) <= LONGEST_REMEMBERED:
            self.known.put(text, entry)
        return entry

    def digits(self, text: str) -> bytes:
        """The ids of a text in decimal, joined by one space."""
        known = self.known
        return b"".join([known[match] or self.piece(match) for match in self.split(text)])[1:]

    def encode(self, text: str) -> list[int]:
        return list(map(int, self.digits(text).split()))

    def decode(self, ids) -> bytes:
        return b"".join(map(self.token.__getitem__, ids))

    def appended(self, text: str, ids: list[int], more: str) -> list[int]:
        """ids of text + more from the ids of text: only the last two pieces of text are split again, as
        what follows can change no piece before them."""
        keep = [match.start() for match in self.pieces(text)][-2:]
        at = keep[0] if keep else 0
        return ids[:len(ids) - len(self.encode(text[at:]))] + self.encode(text[at:] + more)


ENCODERS: dict[tuple[str, str], PrefixEncoder] = {}


def shared(path: str, pattern: str, raw: bytes) -> PrefixEncoder:
    """One encoder per Python worker and vocabulary."""
    if (path, pattern) not in ENCODERS:
        ENCODERS[path, pattern] = PrefixEncoder(parse_ranks(raw), pattern)
    return ENCODERS[path, pattern]


def sent(docs: DataFrame, path: str, pattern: str):
    """A function that gives a task its encoder; the rank file (about a megabyte) travels as a broadcast."""
    with open(path, "rb") as lines:
        raw = docs.sparkSession.sparkContext.broadcast(lines.read())
    return lambda: shared(path, pattern, raw.value)


def encode(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """doc_id and ids (array of int) of every row."""
    get = sent(docs, path, pattern)

    @F.pandas_udf("array<int>")
    def ids(texts: pd.Series) -> pd.Series:
        own = get()
        return pd.Series([own.encode(text or "") for text in texts], dtype=object)

    return docs.select("doc_id", ids(F.col("text").cast("string")).alias("ids"))


def decode(encoded: DataFrame, path: str, pattern: str) -> DataFrame:
    """doc_id and text of encoded rows."""
    get = sent(encoded, path, pattern)

    @F.pandas_udf("string")
    def text(ids: pd.Series) -> pd.Series:
        own = get()
        return pd.Series([own.decode(some).decode("utf-8", "replace") for some in ids], dtype=object)

    return encoded.select("doc_id", text("ids").alias("text"))


def digests(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256: encodes every text and decodes its ids, all in the
    scan, without moving the ids themselves."""
    get = sent(docs, path, pattern)

    @F.pandas_udf("n_tokens long, ids_sha256 string, decoded_sha256 string")
    def digest(texts: pd.Series) -> pd.DataFrame:
        own, rows = get(), []
        for text in texts:
            digits = own.digits(text or "")
            ids = digits.split()
            decoded = b"".join(map(own.by_digits.__getitem__, ids))
            rows.append((len(ids), hashlib.sha256(digits).hexdigest(), hashlib.sha256(decoded).hexdigest()))
        return pd.DataFrame(rows, columns=["n_tokens", "ids_sha256", "decoded_sha256"])

    return docs.select("doc_id", digest(F.col("text").cast("string")).alias("d")).select("doc_id", "d.*")
