"""Fill-in-middle: move the middle of a text behind its suffix, by displacement of bytes.

A text is cut twice at line borders, at places that a hash of its id gives, into prefix, middle
and suffix. The output is, with the marks of ``MARKS``,

* ``psm``: ``<P>`` prefix ``<S>`` suffix ``<M>`` middle;
* ``spm``: ``<S>`` suffix ``<P>`` prefix ``<M>`` middle;
* ``plain``: the text itself.

Many texts are rearranged at once, as one array of bytes. Each segment moves as a whole, so its
distance to its new place is written at its first byte as the difference to the distance before
it; the running sum of the differences is the displacement of every byte, and one scatter builds
all outputs. Restoring finds the marks in the outputs, forms the differences the other way round
and gathers. Both go over the array in chunks with a carry, so that a text of any length costs
its own bytes twice and a chunk of indexes.

A null or empty text is ``plain`` and comes back as the empty text. So is a text that holds a
mark, and the share of texts that ``rate`` leaves out. A null id is hashed as no digits. Repeated rows
give repeated rows, an empty table an empty result. Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from linkcast.llm.common import documents, query, slices

# The marks of prefix, suffix and middle, of equal length.
MARKS = ("<P>", "<S>", "<M>")
WIDTH = len(MARKS[0])
# Segments (0 prefix, 1 suffix, 2 middle) in the order in which a form has them, each after its mark.
ORDERS = {"psm": (0, 1, 2), "spm": (1, 0, 2)}
CHUNK = 1 << 21

SCHEMA = "doc_id long, n long, form string, prefix_chars long, middle_chars long, output string"


def displace(source: np.ndarray, starts: np.ndarray, places: np.ndarray, out: np.ndarray, gather: bool = False) -> None:
    """Move the segments of one side to the other.

    ``starts`` cut the moved side into segments and ascend; ``places`` are their first bytes on
    the other side. The scatter writes ``source`` (the moved side) into ``out``; the gather reads
    the moved side's bytes, all of ``out``, from ``source``.
    """
    shifts = places - starts
    steps = np.diff(shifts, prepend=0)
    size = len(out) if gather else len(source)
    carry = 0
    for at in range(0, size, CHUNK):
        end = min(size, at + CHUNK)
        a, b = np.searchsorted(starts, (at, end))
        difference = np.zeros(end - at, np.int64)
        np.add.at(difference, starts[a:b] - at, steps[a:b])  # empty segments share a first byte
        difference[0] += carry
        shift = np.cumsum(difference)
        carry = shift[-1]
        there = shift + np.arange(at, end)
        if gather:
            out[at:end] = source[there]
        else:
            out[there] = source[at:end]


def _buffer(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of the texts, and where each begins (with the end of the last)."""
    texts = texts.cast(pa.large_string()).fill_null("")
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset: texts.offset + len(texts) + 1]
    raw = texts.buffers()[2]
    data = np.frombuffer(raw, np.uint8)[offsets[0]: offsets[-1]] if raw is not None else np.zeros(0, np.uint8)
    return data, offsets - offsets[0]


def _strings(data: np.ndarray, offsets: np.ndarray) -> pa.Array:
    buffers = [None, pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(data)]
    return pa.Array.from_buffers(pa.large_string(), len(offsets) - 1, buffers).cast(pa.string())


def _marks(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Positions of all marks and which of MARKS each is."""
    at = np.flatnonzero(data[: max(0, len(data) - WIDTH + 1)] == ord("<"))
    at = at[data[at + 2] == ord(">")] if len(at) else at
    kind = np.full(len(at), -1)
    for k, mark in enumerate(MARKS):
        kind[data[at + 1] == ord(mark[1])] = k
    return at[kind >= 0], kind[kind >= 0]


def _within(at: np.ndarray, offsets: np.ndarray, width: int = 1) -> tuple[np.ndarray, np.ndarray]:
    """Which text each position is in, and whether ``width`` bytes from it are in the same one."""
    owner = np.searchsorted(offsets, at, side="right") - 1
    return owner, at + width <= offsets[owner + 1]


def rearrange(texts: pa.Array, hashes: np.ndarray, rate: int, spm: int) -> dict[str, pa.Array]:
    """n, form, prefix_chars, middle_chars and output of the texts; ``hashes`` has four columns."""
    data, offsets = _buffer(texts)
    count, sizes = len(texts), np.diff(offsets)
    feeds = np.flatnonzero(data == 10)
    owner, _ = _within(feeds, offsets)
    ends_open = sizes > 0
    ends_open[ends_open] = data[offsets[1:][ends_open] - 1] != 10
    feeds_before = np.searchsorted(feeds, offsets)  # line feeds before each text
    n = np.diff(feeds_before) + ends_open
    marked = np.zeros(count, bool)
    at, _ = _marks(data)
    owner, inside = _within(at, offsets, WIDTH)
    marked[owner[inside]] = True
    plain = (sizes == 0) | marked | (hashes[:, 2] % 100 >= rate)
    form = np.where(plain, 0, np.where(hashes[:, 3] % 100 < spm, 2, 1))

    def cut(lines: np.ndarray) -> np.ndarray:
        """The byte after so many lines of each text."""
        last = feeds_before[:-1] + lines - 1
        place = feeds[np.minimum(np.maximum(last, 0), max(0, len(feeds) - 1))] + 1 if len(feeds) else np.zeros(count, np.int64)
        place = np.where(last < feeds_before[1:], place, offsets[1:])
        return np.where(lines == 0, offsets[:-1], place)

    first, second = hashes[:, 0] % (n + 1), hashes[:, 1] % (n + 1)
    a, b = cut(np.minimum(first, second)), cut(np.maximum(first, second))
    # Segment starts: prefix, middle, suffix in the order of the text; a plain text is all prefix.
    a, b = np.where(plain, offsets[1:], a), np.where(plain, offsets[1:], b)
    n_prefix, n_middle, n_suffix = a - offsets[:-1], b - a, offsets[1:] - b
    grown = sizes + np.where(plain, 0, 3 * WIDTH)
    out_offsets = np.concatenate([[0], np.cumsum(grown)])
    begin = out_offsets[:-1]
    mark = np.where(plain, 0, WIDTH)
    is_spm = form == 2
    to_prefix = begin + mark + np.where(is_spm, n_suffix + mark, 0)
    to_suffix = begin + mark + np.where(is_spm, 0, n_prefix + mark)
    to_middle = begin + 3 * mark + n_prefix + n_suffix
    out = np.empty(int(out_offsets[-1]), np.uint8)
    starts = np.stack([offsets[:-1], a, b], axis=1).reshape(-1)
    places = np.stack([to_prefix, to_middle, to_suffix], axis=1).reshape(-1)
    displace(data, starts, places, out)
    moved = np.flatnonzero(~plain)
    for place, text in zip((to_prefix, to_suffix, to_middle), MARKS):
        for k, byte in enumerate(text.encode()):
            out[place[moved] - WIDTH + k] = byte
    leads = np.flatnonzero((data & 0xC0) == 0x80)  # bytes that continue a character
    chars = lambda x, y: (y - x) - (np.searchsorted(leads, y) - np.searchsorted(leads, x))
    return {
        "n": pa.array(n, pa.int64()), "form": pa.array(np.array(["plain", "psm", "spm"])[form], pa.string()),
        "prefix_chars": pa.array(chars(offsets[:-1], a), pa.int64(), mask=plain),
        "middle_chars": pa.array(chars(a, b), pa.int64(), mask=plain),
        "output": _strings(out, out_offsets),
    }


def rebuild(outputs: pa.Array, forms: pa.Array) -> pa.Array:
    """The texts, from outputs and forms alone."""
    data, offsets = _buffer(outputs)
    moved = ~np.array(pc.equal(forms.fill_null("plain"), "plain"), bool)
    at, kind = _marks(data)
    owner, inside = _within(at, offsets, WIDTH)
    keep = inside & moved[owner]
    at, kind, owner = at[keep], kind[keep], owner[keep]
    rows = np.flatnonzero(moved)
    if not np.array_equal(owner, np.repeat(rows, 3)):
        raise ValueError("an output of a moved text must hold each mark once")
    where = np.full((len(moved), 3), -1, np.int64)
    where[owner, kind] = at
    order = np.sort(where, axis=1)
    ends = np.concatenate([order[:, 1:], offsets[1:, None]], axis=1)  # of the segment after each mark
    rank = (where[:, :, None] > where[:, None, :]).sum(axis=2)  # place of each mark in its output
    begin = np.where(moved[:, None], where + WIDTH, offsets[:-1, None])
    size = np.take_along_axis(ends, rank, axis=1) - begin
    size[~moved] = 0
    size[~moved, 0] = np.diff(offsets)[~moved]
    total = size.sum(axis=1)
    text_offsets = np.concatenate([[0], np.cumsum(total)])
    prefix, middle = text_offsets[:-1], text_offsets[:-1] + size[:, 0]
    starts = np.stack([prefix, middle, middle + size[:, 2]], axis=1).reshape(-1)
    places = begin[:, [0, 2, 1]].reshape(-1)
    out = np.empty(int(text_offsets[-1]), np.uint8)
    displace(data, starts, places, out, gather=True)
    return _strings(out, text_offsets)


def digits(id_col: str, salt: int) -> list[Column]:
    """The first four groups of eight digits of the hash of salt and id, as numbers."""
    plain = F.coalesce(F.col(id_col).cast("long").cast("string"), F.lit(""))
    code = F.sha2(F.concat(F.lit(f"{salt}:"), plain), 256)
    return [F.conv(F.substring(code, 8 * k + 1, 8), 16, 10).cast("long").alias(f"h{k + 1}") for k in range(4)]


def fill_in_middle(
    docs: DataFrame, rate: int = 100, spm: int = 50, salt: int = 7, id_col: str = "doc_id", text_col: str = "text",
) -> DataFrame:
    """SCHEMA per row; of 100 texts ``rate`` are moved, and of 100 moved ones ``spm`` are ``spm``."""

    def move(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for some in slices(batch, 1):
                hashes = np.stack([some.column(k).to_numpy() for k in range(2, 6)], axis=1)
                found = rearrange(some.column(1), hashes, rate, spm)
                yield pa.RecordBatch.from_arrays([some.column(0), *found.values()], names=["doc_id", *found])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"), *digits(id_col, salt))
    return rows.mapInArrow(move, SCHEMA)


def restore(moved: DataFrame, form_col: str = "form", output_col: str = "output", out_col: str = "restored") -> DataFrame:
    """The input's columns and the restored text; a column of that name is replaced."""
    kept = moved.drop(out_col)
    form, output = kept.columns.index(form_col), kept.columns.index(output_col)

    def back(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for some in slices(batch, output):
                text = rebuild(some.column(output), some.column(form))
                yield pa.RecordBatch.from_arrays([*some.columns, text], names=[*some.schema.names, out_col])

    schema = T.StructType([*kept.schema.fields, T.StructField(out_col, T.StringType())])
    return kept.mapInArrow(back, schema)


OP12_SQL = r"""
WITH t AS (
  SELECT doc_id, coalesce(text, '') AS text, sha256('7:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h FROM documents),
u AS (
  SELECT *, regexp_extract_all(text, '[^\n]*\n|[^\n]+') AS lines,
         CAST('0x' || h[1:8] AS BIGINT) AS h1, CAST('0x' || h[9:16] AS BIGINT) AS h2,
         CAST('0x' || h[17:24] AS BIGINT) AS h3, CAST('0x' || h[25:32] AS BIGINT) AS h4 FROM t),
v AS (
  SELECT *, len(lines) AS n, least(h1 % (len(lines) + 1), h2 % (len(lines) + 1)) AS a,
         greatest(h1 % (len(lines) + 1), h2 % (len(lines) + 1)) AS b FROM u),
w AS (
  SELECT doc_id, text, n, array_to_string(lines[1:a], '') AS p, array_to_string(lines[a + 1:b], '') AS m,
         array_to_string(lines[b + 1:], '') AS s,
         CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR h3 % 100 >= 100
              THEN 'plain' WHEN h4 % 100 < 50 THEN 'spm' ELSE 'psm' END AS form FROM v)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(p) END AS prefix_chars,
       CASE WHEN form <> 'plain' THEN length(m) END AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m
              ELSE '<S>' || s || '<P>' || p || '<M>' || m END) AS output_sha256,
       sha256(text) AS restored_sha256
FROM w
"""


@query("op12_infill", OP12_SQL)
def op12_infill(spark: SparkSession, sf: str) -> DataFrame:
    """Every document with its middle moved, and restored from the output."""
    both = restore(fill_in_middle(documents(spark, sf)))
    sha = lambda c: F.sha2(F.col(c), 256).alias(f"{c}_sha256")
    return both.select("doc_id", "n", "form", "prefix_chars", "middle_chars", sha("output"), sha("restored"))
