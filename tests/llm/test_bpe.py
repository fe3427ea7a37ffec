"""Byte-level BPE against the tokenizer library, and appends and edits against encoding anew."""

import base64
import hashlib
import random

import public_tokenizers
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st

from metrospect.llm import byte_bpe

PATH, PATTERN = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN


def load(path):
    with open(path, "rb") as lines:
        raw = lines.read()
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, raw.splitlines())}
    library = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
    return byte_bpe.PrefixEncoder(byte_bpe.parse_ranks(raw), PATTERN), library


OWN, LIBRARY = load(PATH)
TEXTS = st.text(st.one_of(st.characters(exclude_categories=["Cs"]), st.sampled_from(" \n\t'aehlstr019.\x1c\x85")), max_size=60)


@settings(max_examples=300, deadline=None)
@given(TEXTS)
def test_same_ids_as_the_library(text):
    ids = OWN.encode(text)
    assert ids == LIBRARY.encode_ordinary(text)
    assert OWN.decode(ids) == text.encode()


@pytest.mark.parametrize("text", ["", " ", "  a", "a  b ", "\n\n x", "don't  we'll", "a" * 5000, " " * 3000 + "x", "é　 b"])
def test_edge_texts(text):
    assert OWN.encode(text) == LIBRARY.encode_ordinary(text)


def test_other_vocabulary():
    own, library = load(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))
    for text in ("Straße über Öl", "été où ça", "niño señor", "東京 と 大阪"):
        assert own.encode(text) == library.encode_ordinary(text)


@settings(max_examples=200, deadline=None)
@given(TEXTS, TEXTS)
def test_append(text, more):
    assert OWN.appended(text, OWN.encode(text), more) == OWN.encode(text + more)


def test_edits_of_one_piece():
    rng = random.Random(3)
    for _ in range(200):
        data = bytes(rng.choice(b"aeinorst") for _ in range(rng.randint(1, 300)))
        start = rng.randint(0, len(data))
        stop = rng.randint(start, min(len(data), start + 5))
        new = bytes(rng.choice(b"aeinorst") for _ in range(rng.randint(0, 5)))
        changed, table = OWN.edited(data, OWN.table(data), start, stop, new)
        assert changed == data[:start] + new + data[stop:]
        assert table == OWN.table(changed)


def test_memory_is_bounded_and_changes_nothing(monkeypatch):
    monkeypatch.setattr(byte_bpe, "CACHE_BYTES", 30_000)
    own, library = load(PATH)
    rng = random.Random(9)
    words = ["".join(rng.choice("abcdefgh'.9é") for _ in range(rng.randint(1, 9))) for _ in range(2_000)]
    for _ in range(20):
        text = " ".join(rng.choices(words, k=500))
        assert own.encode(text) == library.encode_ordinary(text)
        assert own.known.held <= 30_000 and len(own.known) + len(own.known.old) < 200


def test_columns_nulls_and_round_trip(spark):
    docs = spark.createDataFrame(
        [(1, "Hello there", "x"), (None, None, "y"), (1, "Hello there", "x"), (2**60, "", None)], "doc_id long, text string, ids string")
    digests = sorted(byte_bpe.digests(docs, PATH, PATTERN).collect(), key=str)
    empty = hashlib.sha256(b"").hexdigest()
    assert len(digests) == 4 and {r.doc_id for r in digests} == {1, None, 2**60}
    assert all(r.n_tokens == 0 and r.ids_sha256 == empty for r in digests if r.doc_id != 1)
    back = byte_bpe.decode(byte_bpe.encode(docs, PATH, PATTERN), PATH, PATTERN)
    assert sorted(r.text for r in back.collect()) == ["", "", "Hello there", "Hello there"]
    assert byte_bpe.digests(docs.limit(0), PATH, PATTERN).count() == 0
