"""SentencePiece encoding and decoding that keeps the place of every piece in the original text.

A text is normalised from left to right: at each place the longest prefix that the model's compiled character
map (a double-array trie) knows is replaced, any other character stays. Every normalised character records
the source byte at which its chunk began, so a run of normalised characters projects to a span of original
bytes. Pieces are merged by score, best first and leftmost among equals; characters without a piece become
byte pieces, of which the last covers the character and the others are empty.

No piece of the usual models holds a space mark after another character (this is looked up in the
vocabulary), so words with the space marks before them are merged by themselves and are remembered, up to
CACHE_BYTES per Python worker. A vocabulary for which this does not hold is merged text by text. In the same way
words end after Latin letters, and are cut between any two neighbours that no piece has side by side.

The model file is a parameter of bounded size (a vocabulary) and is broadcast. Texts are encoded where they are
scanned; nothing is shuffled. Models must be byte-pair models with byte fallback and without user-defined or
unused pieces; others raise ValueError.

Defined cases: null text counts as empty; an empty text has no pieces but the begin and end ids; repeated rows
and null ids pass through row by row; an empty table gives an empty result; columns but doc_id and text are
not read.
"""

from __future__ import annotations

import codecs
import hashlib
import re
import struct
from collections.abc import Iterator
from heapq import heappop, heappush

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from metrospect.llm.recent import Recent

CACHE_BYTES = 128 << 20
LONGEST_REMEMBERED = LONGEST_SCANNED = 64
NO_PIECE = 1 << 30
SPACE_MARK = "▁"
LATIN = "A-Za-zÀ-ÖØ-öø-ɏḀ-ỿ"

# Field numbers, kinds of pieces and defaults of the public model format.
PIECES, TRAINER, NORMALIZER = 1, 2, 3
PIECE_TEXT, PIECE_SCORE, PIECE_KIND = 1, 2, 3
NORMAL, UNKNOWN, CONTROL, USER_DEFINED, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
MODEL_KIND, SPACE_AT_END, BYTE_FALLBACK, UNKNOWN_TEXT, BEGIN_PIECE, END_PIECE = 3, 24, 35, 44, 46, 47
PAIR_MERGES = 2
CHARACTER_MAP, DUMMY_PREFIX, TIDY_SPACES, MARK_SPACES = 2, 3, 4, 5
DEFAULT_UNKNOWN_TEXT = " ⁇ "


def each_byte_replaced(error: UnicodeDecodeError) -> tuple[str, int]:
    return "�" * (error.end - error.start), error.end


codecs.register_error("each_byte_replaced", each_byte_replaced)


def fields(message: bytes) -> Iterator[tuple[int, int | bytes]]:
    """Numbers and values of the fields of a protocol buffer message."""
    at = 0

    def number() -> int:
        nonlocal at
        value = shift = 0
        while True:
            part = message[at]
            at += 1
            value |= (part & 127) << shift
            shift += 7
            if part < 128:
                return value

    while at < len(message):
        tag = number()
        if tag & 7 == 0:
            yield tag >> 3, number()
            continue
        size = {1: 8, 5: 4}.get(tag & 7) or number()
        yield tag >> 3, message[at:at + size]
        at += size


class CharacterMap:
    """The compiled map: a double-array trie over source bytes, and the replacements it points into."""

    def __init__(self, blob: bytes):
        size = struct.unpack_from("<I", blob)[0] if blob else 0
        self.units = np.frombuffer(blob, "<u4", size // 4, 4).tolist() if blob else []
        self.replacements = blob[4 + size:]
        self.leads: dict[str, bool] = {}

    def longest_prefix(self, data: bytes, at: int) -> tuple[int, str] | None:
        """Length and replacement of the longest known prefix of data[at:]."""
        best, node = None, self.step(0)
        for end in range(at, len(data)):
            node ^= data[end]
            unit = self.units[node]
            if unit & 0x800000FF != data[end]:
                break
            node = node ^ self.step_of(unit)
            if unit >> 8 & 1:
                best = end + 1 - at, self.units[node] & 0x7FFFFFFF
        if best is None:
            return None
        begin = best[1]
        return best[0], self.replacements[begin:self.replacements.index(b"\0", begin)].decode()

    @staticmethod
    def step_of(unit: int) -> int:
        return unit >> 10 << ((unit & 0x200) >> 6)

    def step(self, node: int) -> int:
        return self.step_of(self.units[node])

    def may_begin(self, character: str) -> bool:
        """Whether any known prefix begins with the character."""
        found = self.leads.get(character)
        if found is None:
            found = self.leads[character] = bool(self.units) and self.reaches(character.encode())
        return found

    def reaches(self, data: bytes) -> bool:
        node = self.step(0)
        for byte in data:
            node ^= byte
            unit = self.units[node] if node < len(self.units) else 0
            if unit & 0x800000FF != byte:
                return False
            node ^= self.step_of(unit)
        return True


class Pieces:
    """Encodes and decodes with one model."""

    def __init__(self, model: bytes):
        self.ids: dict[str, int] = {}
        self.bytes_of: list[int] = [0] * 256
        self.surfaces: list[bytes] = []
        named: dict[str, int] = {}
        scores: dict[str, float] = {}
        kinds: list[int] = []
        trainer, normalizer = {}, {}
        for field, value in fields(model):
            if field == PIECES:
                piece = dict(fields(value))
                text, kind = piece[PIECE_TEXT].decode(), piece.get(PIECE_KIND, NORMAL)
                named[text] = len(kinds)
                if kind == NORMAL:
                    self.ids[text] = len(kinds)
                    scores[text] = struct.unpack("<f", piece.get(PIECE_SCORE, bytes(4)))[0]
                elif kind == BYTE:
                    self.bytes_of[int(text[1:-1], 16)] = len(kinds)
                kinds.append(kind)
            elif field == TRAINER:
                trainer = dict(fields(value))
            elif field == NORMALIZER:
                normalizer = dict(fields(value))
        if trainer.get(MODEL_KIND) != PAIR_MERGES or not trainer.get(BYTE_FALLBACK) or {USER_DEFINED, UNUSED} & set(kinds):
            raise ValueError("only byte-pair models with byte fallback and without user-defined or unused pieces")
        self.map = CharacterMap(normalizer.get(CHARACTER_MAP, b""))
        self.prefix = bool(normalizer.get(DUMMY_PREFIX, 1))
        self.tidy = bool(normalizer.get(TIDY_SPACES, 1))
        self.space = SPACE_MARK if normalizer.get(MARK_SPACES, 1) else " "
        self.space_at_end = bool(trainer.get(SPACE_AT_END, 0))
        self.begin = named[trainer.get(BEGIN_PIECE, b"<s>").decode()]
        self.end = named[trainer.get(END_PIECE, b"</s>").decode()]
        self.kinds = kinds
        unknown = trainer.get(UNKNOWN_TEXT, DEFAULT_UNKNOWN_TEXT.encode())
        for text, kind in zip(named, kinds, strict=True):
            self.surfaces.append(
                b"" if kind == CONTROL else unknown if kind == UNKNOWN else bytes([int(text[1:-1], 16)]) if kind == BYTE
                else text.replace(SPACE_MARK, " ").encode())
        self.texts = list(named)
        self.words = re.compile(self.word_pattern()).findall
        #: Merges by falling score; pieces of equal score share a place.
        falling = {score: i for i, score in enumerate(sorted(set(scores.values()), reverse=True))}
        self.places = {text: falling[score] for text, score in scores.items()}
        self.beside = {text[i:i + 2] for text in self.ids for i in range(len(text) - 1)}
        self.singles = {text: struct.pack("<Q", 1 << 32 | own) for text, own in self.ids.items() if len(text) == 1}
        self.known = Recent(CACHE_BYTES)

    def word_pattern(self) -> str:
        """Stretches between which no piece reaches across: before a space mark and, if the vocabulary allows, after
        a run of Latin letters."""
        space = re.escape(self.space)
        if any(re.search(f"[^{space}]{space}", text) for text in self.ids):
            return r"(?s:.+)"
        if any(re.search(f"[{LATIN}][^{LATIN}]", text) for text in self.ids):
            return f"{space}*[^{space}]+|{space}+"
        return f"{space}*[^{space}{LATIN}]*[{LATIN}]+|{space}*[^{space}{LATIN}]+|{space}+"

    def normalise(self, text: str) -> tuple[str, np.ndarray]:
        """The normalised text, and the source byte of each of its characters, with that of the end."""
        if self.tidy or self.map.units or self.space_at_end:
            return self.normalise_by_chunks(text)
        # Without a map every character is a chunk by itself.
        points = np.frombuffer(text.encode("utf-32-le"), "<u4")
        dummy = int(self.prefix and bool(text))
        starts = np.zeros(len(points) + 1 + dummy, np.int64)
        width = 1 + (points >= 0x80).astype(np.int64) + (points >= 0x800) + (points >= 0x10000)
        np.cumsum(width, out=starts[1 + dummy:])
        return self.space * dummy + text.replace(" ", self.space), starts

    def chunks(self, text: str) -> Iterator[tuple[str, int]]:
        """Replacement and source bytes of each chunk."""
        data, at, place = text.encode(), 0, 0
        while place < len(text):
            character = text[place]
            found = self.map.longest_prefix(data, at) if self.map.may_begin(character) else None
            size, out = found or (len(character.encode()), character)
            yield out, size
            place += 1 if found is None else len(data[at:at + size].decode())
            at += size

    def normalise_by_chunks(self, text: str) -> tuple[str, np.ndarray]:
        out: list[str] = []
        starts: list[int] = []
        done, begun, after_space = 0, False, self.tidy

        def put(characters: str, source: int) -> None:
            out.extend(self.space if c == " " else c for c in characters)
            starts.extend([source] * len(characters))

        for replacement, size in self.chunks(text):
            if begun or not self.tidy or replacement != " ":
                if not begun and self.prefix and not self.space_at_end:
                    put(" ", done)
                begun = True
                kept = replacement.lstrip(" ") if after_space else replacement
                put(kept, done)
                if kept:
                    after_space = self.tidy and kept.endswith(" ")
            done += size
        while self.tidy and out and out[-1] == self.space:
            done = starts.pop()
            out.pop()
        if self.space_at_end and self.prefix and begun:
            put(" ", done)
        return "".join(out), np.array([*starts, done], np.int64)

    def merged(self, chunk: str) -> list[str]:
        """The pieces of a chunk: the best neighbours that make a piece merge first, the leftmost of equals."""
        if len(chunk) > LONGEST_SCANNED:
            return self.merged_by_heap(chunk)
        parts, place = list(chunk), self.places.get
        pairs = [place(chunk[i:i + 2], NO_PIECE) for i in range(len(chunk) - 1)]
        while pairs and (best := min(pairs)) != NO_PIECE:
            at = pairs.index(best)
            parts[at] += parts.pop(at + 1)
            del pairs[at]
            if at:
                pairs[at - 1] = place(parts[at - 1] + parts[at], NO_PIECE)
            if at < len(pairs):
                pairs[at] = place(parts[at] + parts[at + 1], NO_PIECE)
        return parts

    def merged_by_heap(self, chunk: str) -> list[str]:
        """The same for long chunks, in time that grows little faster than their length."""
        parts: list[str | None] = list(chunk)
        count, place = len(parts), self.places.get
        after, before = list(range(1, count + 1)), list(range(-1, count - 1))
        waiting = []

        def offer(left: int, pair: str) -> None:
            if (own := place(pair)) is not None:
                heappush(waiting, (own, left, pair))

        for i in range(count - 1):
            offer(i, chunk[i:i + 2])
        while waiting:
            _, left, pair = heappop(waiting)
            right = after[left]
            # A part that has merged since is None or longer, or has a longer neighbour.
            if parts[left] is None or right >= count or len(parts[left]) + len(parts[right]) != len(pair):
                continue
            parts[left], parts[right] = pair, None
            after[left] = after[right]
            if after[left] < count:
                before[after[left]] = left
                offer(left, pair + parts[after[left]])
            if before[left] >= 0:
                offer(before[left], parts[before[left]] + pair)
        return [part for part in parts if part is not None]

    def chunks_of(self, word: str) -> list[str]:
        """A word cut between neighbours that no piece holds side by side, as no merge can cross there."""
        beside, begin, out = self.beside, 0, []
        for i in range(1, len(word)):
            if word[i - 1:i + 1] not in beside:
                out.append(word[begin:i])
                begin = i
        out.append(word[begin:])
        return out

    def chunk(self, chunk: str) -> bytes:
        """Per piece a 64-bit number: its id and, above 32 bits, the normalised characters that it takes."""
        numbers = []
        for part in self.merged(chunk):
            own = self.ids.get(part)
            if own is not None:
                numbers.append(len(part) << 32 | own)
            else:
                numbers += [self.bytes_of[byte] for byte in part.encode()]
                numbers[-1] |= 1 << 32
        return struct.pack(f"<{len(numbers)}Q", *numbers)

    def word(self, word: str) -> bytes:
        """The numbers of a word's chunks; words and chunks are remembered unless they are long."""
        chunks, known = self.chunks_of(word), self.known
        if len(chunks) == 1:
            entry = self.chunk(word)
        else:
            entry = b"".join([self.singles.get(chunk) or known[chunk] or self.word(chunk) for chunk in chunks])
        if len(word) <= LONGEST_REMEMBERED:
            known.put(word, entry)
        return entry

    def encode(self, text: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids (32-bit numbers, with begin and end) and the first and last original byte of each piece."""
        normal, starts = self.normalise(text)
        known = self.known
        entries = [known[word] or self.word(word) for word in self.words(normal)]
        numbers = np.frombuffer(b"".join(entries), "<u8")
        sizes = numbers >> np.uint64(32)
        upto = np.zeros(len(sizes) + 1, np.int64)
        np.cumsum(sizes, out=upto[1:])
        bounds = starts[upto]
        first = np.concatenate([starts[:1], bounds[:-1], starts[-1:]])
        last = np.concatenate([starts[:1], bounds[1:], starts[-1:]])
        ids = np.empty(len(numbers) + 2, "<u4")
        ids[0], ids[1:-1], ids[-1] = self.begin, numbers, self.end
        return ids, first, last

    def decode(self, ids: list[int]) -> str:
        """The text of ids: control pieces are silent, the space mark that encoding put first goes, bytes that are
        no UTF-8 become U+FFFD each, also if only a silent piece parts them."""
        parts = [self.surfaces[i] for i in ids]
        if self.prefix or self.tidy:
            for place, i in enumerate(ids):
                if self.kinds[i] == CONTROL:
                    continue
                if self.kinds[i] != NORMAL:
                    break
                marked = self.texts[i].startswith(SPACE_MARK)
                if marked:
                    parts[place] = parts[place][1:]
                if parts[place] or (marked and not self.tidy):
                    break
        runs, start = [], 0
        for _ in range(parts.count(b"")):
            place = parts.index(b"", start)
            runs.append(b"".join(parts[start:place]))
            start = place + 1
        runs.append(b"".join(parts[start:]))
        return "".join(run.decode("utf-8", "each_byte_replaced") for run in runs)


MODELS: dict[str, Pieces] = {}


def sent(docs: DataFrame, path: str):
    """A function that gives a task its model; the file (half a megabyte) travels as a broadcast."""
    with open(path, "rb") as model:
        raw = docs.sparkSession.sparkContext.broadcast(model.read())

    def get() -> Pieces:
        if path not in MODELS:
            MODELS[path] = Pieces(raw.value)
        return MODELS[path]

    return get


def encode(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, ids with begin and end ids, and per id its span of original UTF-8 bytes (firsts, lasts)."""
    get = sent(docs, path)

    @F.pandas_udf("ids array<int>, firsts array<long>, lasts array<long>")
    def pieces(texts: pd.Series) -> pd.DataFrame:
        own, rows = get(), []
        for text in texts:
            ids, first, last = own.encode(text or "")
            rows.append((ids.astype(np.int32), first, last))
        return pd.DataFrame(rows, columns=["ids", "firsts", "lasts"])

    return docs.select("doc_id", pieces(F.col("text").cast("string")).alias("p")).select("doc_id", "p.*")


def decode(encoded: DataFrame, path: str) -> DataFrame:
    """doc_id and text of rows with ids."""
    get = sent(encoded, path)

    @F.pandas_udf("string")
    def text(ids: pd.Series) -> pd.Series:
        own = get()
        return pd.Series([own.decode(list(some)) for some in ids], dtype=object)

    return encoded.select("doc_id", text("ids").alias("text"))


def digests(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 and spans_sha256 (first and last bytes as 64-bit numbers,
    all firsts before all lasts): encodes every text and decodes its ids in the scan."""
    get = sent(docs, path)

    @F.pandas_udf("n_tokens long, ids_sha256 string, decoded_sha256 string, spans_sha256 string")
    def digest(texts: pd.Series) -> pd.DataFrame:
        own, rows = get(), []
        for text in texts:
            ids, first, last = own.encode(text or "")
            decoded = own.decode(ids.tolist())
            rows.append((
                len(ids), hashlib.sha256(ids.tobytes()).hexdigest(), hashlib.sha256(decoded.encode()).hexdigest(),
                hashlib.sha256(first.astype("<i8").tobytes() + last.astype("<i8").tobytes()).hexdigest()))
        return pd.DataFrame(rows, columns=["n_tokens", "ids_sha256", "decoded_sha256", "spans_sha256"])

    return docs.select("doc_id", digest(F.col("text").cast("string")).alias("d")).select("doc_id", "d.*")
