"""Fill-in-middle against regular expressions, and taking outputs apart again."""

import hashlib
import random
import re

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from metrospect.llm import fill_middle as fim

UNIT = re.compile(r"[A-Za-z]+|[^A-Za-z]")
TEXTS = st.lists(st.text(st.one_of(st.characters(exclude_categories=["Cs"]), st.sampled_from("aZ@[`{z \n\x00\x7f\x80é漢😀")), max_size=40), max_size=12)


def plain_cuts(text, one, two):
    units = UNIT.findall(text)
    a, b = sorted((one % (len(units) + 1), two % (len(units) + 1)))
    return len(units), len("".join(units[:a])), len("".join(units[:b]))


@settings(max_examples=300, deadline=None)
@given(TEXTS, st.integers(0, 2**32 - 1), st.integers(1, 50))
def test_cuts_like_regular_expressions(texts, draw, most):
    one = np.arange(draw, draw + len(texts), dtype=np.int64)
    two = one * 7919 % 2**32
    for array in (pa.array(texts, pa.string()), pa.array(["x", *texts], pa.large_string())[1:]):
        got = fim.cut_points(array, one, two, most)
        assert [tuple(c) for c in got.T] == [plain_cuts(t, int(a), int(b)) for t, a, b in zip(texts, one, two)]


def test_long_texts():
    rng = random.Random(5)
    text = "".join(rng.choice(["word", " ", "é", "漢字", "😀", "\n", "Zz9"]) for _ in range(300_000))
    texts = ["", "a" * 100_000, text, "漢" * 70_000, ""]
    draws = np.array([rng.randrange(2**32) for _ in texts], np.int64)
    got = fim.cut_points(pa.array(texts), draws, draws[::-1].copy())
    assert [tuple(c) for c in got.T] == [plain_cuts(t, int(a), int(b)) for t, a, b in zip(texts, draws, draws[::-1])]


def plain_row(doc_id, text):
    text = text or ""
    h = hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[i:i + 8], 16) for i in (0, 8, 16, 24))
    n, a, b = plain_cuts(text, h1, h2)
    if not text or any(m in text for m in fim.MARKS) or h3 % 100 >= 90:
        return doc_id, n, "plain", None, None, text
    p, m, s = text[:a], text[a:b], text[b:]
    if h4 % 100 < 20:
        return doc_id, n, "spm", a, b - a, f"<S>{s}<P>{p}<M>{m}"
    return doc_id, n, "psm", a, b - a, f"<P>{p}<S>{s}<M>{m}"


def test_rows(spark):
    odd = [(None, "some text"), (1, None), (2, ""), (3, "a <P> b"), (4, "x<S>"), (5, "<M>"), (6, "< P> <<P <"), (7, "\n\n\t"), (7, "\n\n\t"), (-8, "é漢😀 ab")]
    rows = odd + [(i, f"Text {i}: ünï {'ab ' * (i % 17)}<P <S< >") for i in range(20, 300)]
    docs = spark.createDataFrame([(i, t, "q", 1) for i, t in rows], "doc_id long, text string, output string, n int")
    got = fim.transform(docs).collect()
    assert sorted(map(tuple, got), key=repr) == sorted((plain_row(i, t) for i, t in rows), key=repr)
    assert {r.form for r in got} == {"plain", "psm", "spm"}
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    texts = {(i, sha(plain_row(i, t)[5])): sha(t or "") for i, t in rows}
    assert all(texts[r.doc_id, r.output_sha256] == r.restored_sha256 for r in fim.digests(docs).collect())
    assert fim.digests(docs.limit(0)).count() == 0


def test_other_marks_and_shares(spark):
    docs = spark.createDataFrame([(i, f"abc {i} def.") for i in range(50)], "doc_id long, text string")
    marks = ("\x01p", "\x02s", "\x03m.*")
    out = fim.transform(docs, seed="x", changed_percent=100, spm_percent=100, marks=marks)
    back = out.select("form", fim.restored(out["output"], out["form"], marks).alias("text")).collect()
    assert {r.form for r in back} == {"spm"} and sorted(r.text for r in back) == sorted(f"abc {i} def." for i in range(50))
    for bad in (("<P>", "<P>", "<M>"), ("", "a", "b"), ("ab", "ba", "c")):
        with pytest.raises(ValueError):
            fim.check_marks(bad)
