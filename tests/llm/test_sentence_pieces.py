"""SentencePiece encoding, spans and decoding against the library; the character map of its own rules."""

import hashlib
import random
import struct

import public_tokenizers
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st

from metrospect.llm import sentence_pieces as sp
from metrospect.llm.recent import Recent

PATH = public_tokenizers.path("piece_bpe_32k.model")
with open(PATH, "rb") as model:
    RAW = model.read()


def with_normalizer(raw: bytes, spec: bytes) -> bytes:
    """The model with other rules of normalisation."""
    def number(n):
        out = b""
        while n > 127:
            out, n = out + bytes([n & 127 | 128]), n >> 7
        return out + bytes([n])

    out = b""
    for field, value in sp.fields(raw):
        value = spec if field == sp.NORMALIZER else value
        out += number(field << 3 | 2) + number(len(value)) + value
    return out


def rules(name: str) -> bytes:
    """The library's compiled character map and flags of a named rule, as a normalizer's message."""
    normalizer = sentencepiece.SentencePieceNormalizer(rule_name=name, add_dummy_prefix=True, escape_whitespaces=True, remove_extra_whitespaces=True)
    return dict(sp.fields(normalizer.serialized_model_proto()))[sp.NORMALIZER]


def pair(raw):
    return sp.Pieces(raw), sentencepiece.SentencePieceProcessor(model_proto=raw)


MODELS = {"plain": pair(RAW), "nfkc": pair(with_normalizer(RAW, rules("nmt_nfkc"))), "folded": pair(with_normalizer(RAW, rules("nmt_nfkc_cf")))}
TEXTS = st.text(st.one_of(st.characters(exclude_categories=["Cs"]), st.sampled_from("  aehlstnr019.\n\t▁é漢ﬁ①Ａ　́\xa0\xad…")), max_size=60)


def library_spans(library, text):
    return [(p.begin, p.end) for p in library.encode(text, return_type="proto").pieces]


def same(name, text):
    own, library = MODELS[name]
    ids, first, last = own.encode(text)
    ids = ids.tolist()
    assert ids == library.encode(text, add_bos=True, add_eos=True)
    assert own.decode(ids) == library.decode(ids)
    return list(zip(first.tolist(), last.tolist()))[1:-1]


@settings(max_examples=400, deadline=None)
@given(TEXTS)
def test_same_as_the_library(text):
    assert same("plain", text) == library_spans(MODELS["plain"][1], text)


@pytest.mark.parametrize("name", ["nfkc", "folded"])
@settings(max_examples=200, deadline=None)
@given(text=TEXTS)
def test_compiled_character_maps(name, text):
    spans = same(name, text)
    assert spans == library_spans(MODELS[name][1], text)


@pytest.mark.parametrize("text", [
    "", " ", "   ", "\n", " \n x", "▁", "a▁ b", "<s> </s> <0x41> <unk>", "\x00", "x  y   z    ", "a" * 30_000, "漢字" * 9_000,
    " " * 5_001 + "end", "don't  we'll", "😀👩‍👩‍👧", "﻿bom", "�"])
def test_edge_texts(text):
    for name in MODELS:
        spans = same(name, text)
    assert same("plain", text) == library_spans(MODELS["plain"][1], text)
    assert spans == sorted(spans)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.one_of(st.integers(0, 31_999), st.sampled_from([0, 1, 2, 3 + 0xE6, 3 + 0xBC, 3 + 0xA2, 3 + 0xFF, 3 + 0x20, 29871])), max_size=30))
def test_decoding_any_ids(ids):
    own, library = MODELS["plain"]
    assert own.decode(ids) == library.decode(ids)


@pytest.mark.parametrize("ids", [[197, 1, 131], [197, 131], [1, 197, 2, 2, 131, 2], [229, 1, 191, 165], [1, 29871, 197, 131, 2]])
def test_bytes_on_both_sides_of_a_control_piece(ids):
    own, library = MODELS["plain"]
    assert own.decode(ids) == library.decode(ids)


@settings(max_examples=200, deadline=None)
@given(st.text("aeinorst▁.,1é漢", max_size=80))
def test_both_ways_of_merging(text):
    own, _ = MODELS["plain"]
    assert own.merged_by_heap(text) == [p for c in own.chunks_of(text) for p in own.merged(c)]


def test_spans_hold_the_text_of_their_pieces():
    own, _ = MODELS["plain"]
    text = "Größe: 3 µm — naïve café 東京 x"
    ids, first, last = own.encode(text)
    data = text.encode()
    for i, a, b in zip(ids[1:-1], first[1:-1], last[1:-1]):
        if own.kinds[i] == sp.NORMAL:
            assert data[a:b].decode() == own.texts[i].replace("▁", " " if a else "")


def test_memory_is_bounded_by_bytes():
    some = Recent(40_000)
    for i in range(5_000):
        some.put(f"word{i}", (b"12345678", b"1234"))
    assert some.held <= 40_000 and len(some) + len(some.old) < 250
    assert some["word4999"] == (b"12345678", b"1234") and some["word1"] is None
    first = next(iter(some.old))
    assert some[first] == (b"12345678", b"1234") and first in some and first not in some.old


def test_other_models_are_refused():
    for kind in (1, 3):
        changed = RAW.replace(struct.pack("BB", sp.MODEL_KIND << 3, sp.PAIR_MERGES), struct.pack("BB", sp.MODEL_KIND << 3, kind), 1)
        trainer = dict(sp.fields(next(v for f, v in sp.fields(changed) if f == sp.TRAINER)))
        if trainer[sp.MODEL_KIND] == kind:
            with pytest.raises(ValueError):
                sp.Pieces(changed)


def test_rows(spark):
    rng = random.Random(2)
    texts = [None, "", "Hello  there", "Hello  there", *["".join(rng.choice("ab é漢\n") for _ in range(rng.randint(0, 300))) for _ in range(60)]]
    docs = spark.createDataFrame([(i or None, t, "x", 3) for i, t in enumerate(texts)], "doc_id long, text string, ids string, n_tokens int")
    library = MODELS["plain"][1]
    want = []
    for i, text in enumerate(texts):
        ids = library.encode(text or "", add_bos=True, add_eos=True)
        want.append((i or None, len(ids), hashlib.sha256(struct.pack(f"<{len(ids)}I", *ids)).hexdigest(), hashlib.sha256(library.decode(ids).encode()).hexdigest()))
    got = [(r.doc_id, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in sp.digests(docs, PATH).collect()]
    assert sorted(got, key=repr) == sorted(want, key=repr)
    back = sp.decode(sp.encode(docs, PATH), PATH).collect()
    assert sorted(r.text for r in back) == sorted(t or "" for t in texts)
    spans = {r.doc_id: (r.firsts, r.lasts) for r in sp.encode(docs, PATH).collect()}
    assert spans[2] == ([0, 0, 5, 6, 12], [0, 5, 6, 12, 12])
    assert sp.digests(docs.limit(0), PATH).count() == 0
