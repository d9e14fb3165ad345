"""Fill-in-middle against slices of Python strings, and back."""

import hashlib
import re

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from linkcast.llm import infill
from linkcast.llm.common import slices

LONG = "".join(f"zeile {i} é\n" for i in range(200_000))
TEXTS = [
    "a\nb\nc", "", None, "one line", "\n", "\n\n\n", "é\nüü\n\U0001f600x\n", "has <S> mark\nx", "open <\n<P\nP>\n", "<M", LONG,
    "a\nb\nc", "tail\n<", "<\nS>\n<S\n>",
]
ROWS = [(i * 7, t) for i, t in enumerate(TEXTS)] + [(None, "a\nb\nc\nd"), (None, None), (21, "x\ny"), (21, "x\ny")]


def expected(doc, text, rate=100, spm=50, salt=7):
    text = text or ""
    code = hashlib.sha256(f"{salt}:{'' if doc is None else doc}".encode()).hexdigest()
    h = [int(code[8 * k: 8 * k + 8], 16) for k in range(4)]
    lines = re.findall(r"[^\n]*\n|[^\n]+", text)
    n = len(lines)
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    p, m, s = "".join(lines[:a]), "".join(lines[a:b]), "".join(lines[b:])
    if not text or any(x in text for x in infill.MARKS) or h[2] % 100 >= rate:
        return doc, n, "plain", None, None, text
    if h[3] % 100 < spm:
        return doc, n, "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return doc, n, "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


@pytest.mark.parametrize("rate, spm", [(100, 50), (50, 0), (0, 50), (100, 100)])
def test_rows(spark, rate, spm):
    docs = spark.createDataFrame(ROWS, "doc_id long, text string")
    for name in ("n", "form", "output", "restored", "h1"):
        docs = docs.withColumn(name, F.lit("x"))
    both = infill.restore(infill.fill_in_middle(docs, rate, spm)).collect()
    assert sorted(map(tuple, both), key=str) == sorted(
        ((*expected(i, t, rate, spm), t or "") for i, t in ROWS), key=str
    )


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert infill.restore(infill.fill_in_middle(docs)).count() == 0


@given(
    st.lists(st.text(st.sampled_from("a\n<PSM>é\U0001f600"), max_size=30), min_size=1, max_size=8),
    st.integers(1, 9), st.integers(0, 2**32),
)
@settings(max_examples=200, deadline=None)
def test_round_trip_in_any_chunks(texts, chunk, seed):
    hashes = np.random.default_rng(seed).integers(0, 2**32, (len(texts), 4))
    whole, infill.CHUNK = infill.CHUNK, chunk
    try:
        found = infill.rearrange(pa.array(texts, pa.string()), hashes, 90, 50)
        back = infill.rebuild(found["output"], found["form"])
    finally:
        infill.CHUNK = whole
    assert back.to_pylist() == texts
    for text, form, out in zip(texts, found["form"].to_pylist(), found["output"].to_pylist()):
        assert (form == "plain") == (out == text)


def test_slices_keep_all_rows():
    batch = pa.RecordBatch.from_arrays([pa.array(["x" * k for k in (0, 3, 30, 1, 9, 11)] + [None])], names=["t"])
    parts = [p.column(0).to_pylist() for p in slices(batch, 0, 3, 10)]
    assert sum(parts, []) == batch.column(0).to_pylist()
    assert len(parts) > 3 and all(len(p) <= 3 and (len(p) == 1 or sum(len(t or "") for t in p) <= 10) for p in parts)


def test_a_damaged_output_is_an_error():
    with pytest.raises(ValueError, match="each mark once"):
        infill.rebuild(pa.array(["<P>a<S>b"]), pa.array(["psm"]))
