"""Token counts by section, from one encoding of the whole document.

A document is encoded once, so that its tokens are those a model sees; encoding sections by
themselves would cut tokens at their borders. The character span of every token comes from
the byte lengths of the tokens, and is joined with the spans of the sections:

* a token inside one section counts for it;
* a token that overlaps several counts for the one with the largest overlap, the earlier one
  on a tie (``rule="majority"``), or for the one that holds its first (``"start"``) or last
  (``"end"``) character;
* a token that overlaps none is a gap token.

Sections are an array of (start, end) in code points, end exclusive. They are taken in order
of their start, each from where the one before it ends; without a column of sections every
line is one, and line feeds are gaps. Counts come back in that order.

Null and empty texts have no tokens, one empty line, and sections with zero tokens each. A
null array has no sections; null members, and sections that end before they start, have zero
tokens. Spans may reach over the end of the text. Null ids and repeated rows are kept. Other
columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from linkcast.llm.common import documents, query
from linkcast.llm.tokens import encoder, vocabulary

SCHEMA = "doc_id long, n_tokens long, n_sections long, section_tokens array<long>, n_gap long, n_crossing long"
RULES = ("majority", "start", "end")


def token_bytes(path: str) -> np.ndarray:
    """Length in bytes of every token of a byte-level vocabulary (a character stands for a byte)."""
    vocab = encoder(path, True).tokenizer.get_vocab(with_added_tokens=True)
    sizes = np.zeros(max(vocab.values()) + 1, np.int64)
    for token, i in vocab.items():
        sizes[i] = len(token)
    return sizes


def char_spans(text: str, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Characters that each token touches, from its bytes: first, and last plus one."""
    raw = np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8)
    char = np.cumsum((raw & 0xC0) != 0x80) - 1  # of each byte
    ends = np.cumsum(sizes)
    return char[ends - sizes], char[ends - 1] + 1


def allocate(
    start: np.ndarray, end: np.ndarray, left: np.ndarray, right: np.ndarray, rule: str
) -> tuple[np.ndarray, int]:
    """(section of each token or -1, number of tokens that cross a border).

    ``left`` and ``right`` bound disjoint sections in order.
    """
    own = np.full(len(start), -1, np.int64)
    solid = np.flatnonzero(right > left)
    if not len(solid) or not len(start):
        return own, 0
    a, b = left[solid], right[solid]
    first = np.searchsorted(b, start, side="right")
    last = np.searchsorted(a, end, side="left") - 1
    met = first <= last
    inside = met & (start >= a[np.minimum(first, len(a) - 1)]) & (end <= b[np.minimum(first, len(a) - 1)])
    if rule == "majority":
        own[met] = first[met]
        for t in np.flatnonzero(met & (last > first)):
            some = np.arange(first[t], last[t] + 1)
            own[t] = some[np.argmax(np.minimum(b[some], end[t]) - np.maximum(a[some], start[t]))]
    else:
        at = start if rule == "start" else end - 1
        k = np.minimum(np.searchsorted(b, at, side="right"), len(a) - 1)
        holds = (a[k] <= at) & (at < b[k])
        own[holds] = k[holds]
    own[own >= 0] = solid[own[own >= 0]]
    return own, int((met & ~inside).sum())


def line_bounds(text: str) -> tuple[np.ndarray, np.ndarray]:
    lengths = np.array([len(x) for x in text.split("\n")], np.int64)
    right = np.cumsum(lengths + 1) - 1
    return right - lengths, right


def given_bounds(sections: list[dict | None]) -> tuple[np.ndarray, np.ndarray]:
    pairs = sorted(
        (max(0, s["start"]), s["end"]) if s and s["start"] is not None and s["end"] is not None else (0, 0)
        for s in sections
    )
    left = np.array([p[0] for p in pairs], np.int64)
    right = np.maximum.accumulate(np.array([p[1] for p in pairs], np.int64)) if pairs else left
    before = np.concatenate([[0], right[:-1]]) if pairs else left
    return np.maximum(left, before), right


def count_tokens(
    docs: DataFrame, path: str, sections_col: str | None = None, rule: str = "majority",
    id_col: str = "doc_id", text_col: str = "text",
) -> DataFrame:
    """(doc_id, n_tokens, n_sections, section_tokens, n_gap, n_crossing) per document."""
    if rule not in RULES:
        raise ValueError(f"rule must be one of {RULES}")
    names = [c.split()[0] for c in SCHEMA.split(", ")]

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, sizes = encoder(path, True), token_bytes(path)
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                some = batch.slice(at, 1024)
                texts = [t or "" for t in some.column(1).to_pylist()]
                given = some.column(2).to_pylist() if sections_col else None
                out: list[tuple] = []
                for k, (text, raw) in enumerate(zip(texts, enc.encode(texts))):
                    ids = np.frombuffer(raw, "<u4")
                    left, right = given_bounds(given[k] or []) if given is not None else line_bounds(text)
                    start, end = char_spans(text, sizes[ids]) if len(ids) else (ids, ids)
                    own, crossing = allocate(start, end, left, right, rule)
                    found = np.bincount(own + 1, minlength=len(left) + 1)
                    out.append((len(ids), len(left), found[1:], int(found[0]), crossing))
                columns = list(zip(*out))
                yield pa.RecordBatch.from_arrays(
                    [some.column(0)] + [
                        pa.array(c, pa.list_(pa.int64()) if name == "section_tokens" else pa.int64())
                        for name, c in zip(names[1:], columns)
                    ],
                    names=names,
                )

    rows = [F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")]
    if sections_col:
        rows.append(F.col(sections_col).cast("array<struct<start:long,end:long>>").alias("sections"))
    return docs.select(*rows).mapInArrow(count, SCHEMA)


@query("op10_token_counts")
def op10_token_counts(spark: SparkSession, sf: str) -> DataFrame:
    """Tokens of every line of every document, counted from whole documents."""
    return count_tokens(documents(spark, sf), vocabulary("byte_bpe_50k.json"))
