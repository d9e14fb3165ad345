"""What Python workers hold while they encode, and what they write per document."""

import uuid
import zlib
from pathlib import Path
from unittest.mock import MagicMock

import numpy as np
import pandas as pd
import pyarrow as pa
import pytest

from linkcast.llm import common, huffman, packing, tokens
from linkcast.llm.tokens import Encoder, encoder, vocabulary
from linkcast.session import stage_root

BYTES, WORDS = vocabulary("byte_bpe_50k.json"), vocabulary("word_bpe_49k.json")


def test_texts_encoded_together_are_few(monkeypatch):
    enc, seen, join = Encoder(WORDS, False), [], Encoder._join

    def watched(self, group):
        seen.append(sum(len(p) + 1 for pieces in group for p in pieces))
        return join(self, group)

    monkeypatch.setattr(Encoder, "_join", watched)
    assert len(enc.encode(["some words of a text " * 500] * 200)) == 200
    assert max(seen) <= (1 << 18) + 12_000


def test_islands_let_the_encoders_go(spark, monkeypatch):
    items = MagicMock()
    monkeypatch.setattr(packing, "stage", lambda df, name: df)
    packing._solve(items, 2048, 2, 1, 6, 4)
    run = items.select.return_value.withColumn.return_value.groupBy.return_value.cogroup.return_value.applyInPandas.call_args_list[0][0][0]
    encoder(WORDS, False).encode(["some words"])
    left = pd.DataFrame({"cell": [0, 0], "row": [1, 2], "length": [1000, 1048], "island": [0, 0]})
    found = run((0, 0), left, left.iloc[:0])
    assert found["bins"].tolist() == [1] and not tokens._ENCODERS


def test_ids_are_staged_by_block(spark):
    """One row per block and one of counts per shard, not one per document."""
    root = Path(stage_root(spark).removeprefix("file:"))
    known = set(root.glob("linkcast-ids-*"))
    rows = [(k, f"the text number {k}") for k in range(500)]
    folder = f"{stage_root(spark)}/by-block-{uuid.uuid4().hex}"
    huffman.write_tokens(spark.createDataFrame(rows, "doc_id long, text string"), folder, BYTES, True, 2, 50_257, block_ids=1_000)
    (staged,) = set(root.glob("linkcast-ids-*")) - known
    blocks = spark.read.parquet(str(staged)).where("block >= 0").collect()
    assert len(blocks) < 10 and sum(len(b.doc_ids) for b in blocks) == 500
    assert all(b.n_ids >= 1_000 for b in sorted(blocks, key=lambda b: b.before)[:-1])
    enc, found = Encoder(BYTES, True), huffman.read_tokens(spark, folder, digest_only=True).orderBy("start").collect()
    want = [zlib.crc32(np.array([*enc._ids(t), 2], "<u4").tobytes()) for _, t in rows]
    assert [(r.doc_id, r.ids_crc32) for r in found] == [(k, c) for k, (c, _) in enumerate(zip(want, rows))]


@pytest.mark.parametrize("path, keeps", [(BYTES, True), (WORDS, False)])
def test_words_of_odd_white_space_beside_usual_ones(path, keeps):
    enc = Encoder(path, keeps)
    texts = ["usual words, only.", "a tab\there  and there\x00mark", "\n", " ", "usual words, only.", "a\x00 b c.", "end. "]
    for _ in range(3):  # new, met once, kept
        assert enc.encode(texts) == [np.array(enc._ids(t), "<u4").tobytes() for t in texts]


def test_batches_of_blocks_are_bounded(spark):
    """Spark cuts Arrow batches of large binary rows by their size, too."""
    def sizes(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([batch.nbytes])], names=["n"])

    rows = spark.range(0, 1500, 1, 1).selectExpr("cast(repeat('x', 131072) as binary) AS b")
    assert max(r.n for r in rows.mapInArrow(sizes, "n long").collect()) < 160 << 20


def test_words_met_lately_are_not_encoded_again():
    enc = Encoder(BYTES, True, recent=4)
    counted, learn = [], enc._encode_new
    enc._encode_new = lambda words: counted.append(len(words)) or learn(words)
    for text in (" alpha beta, gamma", " alpha beta", " gamma", " one two three four five six", " seven eight nine ten", " alpha"):
        assert enc.encode([text]) == [np.array(enc._ids(text), "<u4").tobytes()]
    assert counted == [3, 0, 0, 6, 4, 0] and len(enc.recent) + len(enc.older) <= 14


def held() -> int:
    """Anonymous memory of this process in MB."""
    rows = dict(line.split(":", 1) for line in Path("/proc/self/smaps_rollup").read_text().splitlines()[1:])
    return int(rows["Pss_Anon"].split()[0]) // 1024


def test_freed_memory_is_given_back_at_the_end_of_a_task():
    def task(batches):
        for batch in batches:
            columns = [batch.column(0).cast(pa.large_string()) for _ in range(64)]
            yield pa.RecordBatch.from_arrays([pa.array([sum(c.nbytes for c in columns)])], names=["n"])

    def batches():
        yield pa.RecordBatch.from_arrays([pa.array(["x" * 1000] * 2000)], names=["text"])

    before = held()
    assert [b.column(0)[0].as_py() > 64_000_000 for b in common.tidy(task)(batches())] == [True]
    assert held() < before + 60
