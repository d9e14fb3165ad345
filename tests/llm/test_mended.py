"""Whole-text encodings, ids beyond doubles, bounded cells, hot ids, languages without letters."""

import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from linkcast.llm import components as components_module, huffman, language, neardup, packing
from linkcast.llm.tokens import Encoder, vocabulary
from linkcast.session import stage, stage_root

BYTES, WORDS = vocabulary("byte_bpe_50k.json"), vocabulary("word_bpe_49k.json")
FRESH = {path: Tokenizer.from_file(path) for path in (BYTES, WORDS)}
OURS = {BYTES: Encoder(BYTES, True), WORDS: Encoder(WORDS, False)}
PARTS = st.sampled_from([
    "a", "Word", "İ", "ﬁ", "²", "é", "é", "क़", "Å", ".", ",", " ", "  ", "\n", "\t", "'s", "7", "<|endoftext|>",
    "<|startoftext|>", "<|ENDOFTEXT|>", "<|end", "|>", " ", "日本", "\U0001f600", "\x00",
])


def whole(path, text):
    return FRESH[path].encode(text, add_special_tokens=False).ids


@pytest.mark.parametrize("path", [BYTES, WORDS])
@given(texts=st.lists(st.lists(PARTS, max_size=12).map("".join), min_size=1, max_size=6))
@settings(max_examples=300, deadline=None)
def test_encoder_equals_a_fresh_tokenizer(path, texts):
    got = [np.frombuffer(b, "<u4").tolist() for b in OURS[path].encode(texts)]
    assert got == [whole(path, t) for t in texts]


@pytest.mark.parametrize("path", [BYTES, WORDS])
def test_added_tokens_and_odd_letters(path):
    for text in ("hello <|endoftext|> world", "DENİZLİ, güzel", "Kİ.", "x" * 2_000_000 + " <|endoftext|> y. " * 3):
        assert np.frombuffer(OURS[path].encode([text])[0], "<u4").tolist() == whole(path, text)


def test_packing_keeps_large_and_missing_ids(spark):
    ids = [2**60 + 1, 2**60 + 3, None, -(2**62) - 1, None, 7]
    docs = spark.createDataFrame([(i, f"text {k} <|endoftext|>") for k, i in enumerate(ids)], "doc_id long, text string")
    placed = packing.pack(packing.cut_pieces(docs, WORDS, False, 0)).collect()
    assert sorted((r.doc_id for r in placed), key=str) == sorted(ids, key=str)
    want = np.array([*whole(WORDS, "text 0 <|endoftext|>"), 0], "<u4")
    assert [r.ids_crc32 for r in placed if r.doc_id == ids[0]] == [zlib.crc32(want.tobytes())]


def test_cells_are_bounded(spark):
    """Equal rows without an id, dealt in turn."""
    rows = spark.range(50_000).select(F.col("id").alias("row"), F.lit(3).cast("long").alias("length")).repartition(7)
    dealt, n = packing.dealt(rows, 1_000)
    sizes = [r["count"] for r in dealt.groupBy("cell").count().collect()]
    assert n == 50_000 and len(sizes) == 50 and max(sizes) <= 1_000
    assert dealt.select("row").distinct().count() == 50_000
    assert packing.dealt(rows.limit(0), 10)[1] == 0


def test_equal_rows_without_id_are_packed_in_bounded_groups(spark, monkeypatch):
    seen = []
    solve = packing._solve

    def watched(items, *args):
        seen.append(items.groupBy("cell").count().agg(F.max("count")).first()[0])
        return solve(items, *args)

    monkeypatch.setattr(packing, "_solve", watched)
    table = [(None, 0, 0, 300 + k % 2, 5) for k in range(400)]
    placed = packing.pack(spark.createDataFrame(table, packing.PIECE_SCHEMA), cell_items=20).toPandas()
    assert len(placed) == 400 and max(seen) <= 20
    for _, one in placed.groupby("sequence_id"):
        assert one["length"].sum() <= 2048


def test_token_files_of_hot_ids_are_spread_over_shards(spark, monkeypatch):
    """A third of the rows has no id, a third is one repeated row."""
    monkeypatch.setattr(huffman, "SHARD_BYTES", 2_000)
    rows = [(None, f"text {k} of no id") for k in range(200)] + [(5, "the same row")] * 200 + [(k, f"own {k}") for k in range(10, 210)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    folder = f"{stage_root(spark)}/hot-{np.random.default_rng().integers(1 << 60)}"
    huffman.write_tokens(docs, folder, BYTES, True, 2, 50_257)
    blocks = spark.read.parquet(f"{folder}/blocks")
    assert blocks.agg(F.max(F.size("doc_ids"))).first()[0] < 200
    found = huffman.read_tokens(spark, folder).orderBy("start").collect()
    ids = [r.doc_id for r in found]
    assert ids == [None] * 200 + sorted(i for i, _ in rows if i is not None)
    crc = lambda t: zlib.crc32(np.array([*whole(BYTES, t), 2], "<u4").tobytes())
    assert sorted(r.ids_crc32 for r in found) == sorted(crc(t) for _, t in rows)
    assert [r.start for r in found] == np.cumsum([0, *[r.n_tokens for r in found]])[:-1].tolist()


def test_languages_without_a_letter(spark):
    docs = spark.createDataFrame([(k, f"{k} + 1", "xx") for k in range(20)], "doc_id long, text string, lang string")
    model = language.train(docs)
    assert {tuple(r.language) for r in language.identify(docs, model).collect()} == {("und", 0.0, True)}


def test_samples_are_distinct_texts(spark):
    """Most rows of a language are copies of one text; the others still form its centroids."""
    own = [(k, " ".join(f"{c}{d}ung" for c in "bdfgk" for d in "aeiou"[k % 5:]) + f" heit{k}", "de") for k in range(40)]
    copies = [(100 + k, "the and of", "de") for k in range(400)]
    other = [(1000 + k, f"the and of to in that {k} it was for on are as with his they", "en") for k in range(40)]
    docs = spark.createDataFrame(own + copies + other, "doc_id long, text string, lang string")
    model = language.train(docs, sample=60)
    found = {r.doc_id: r.language.lang_pred for r in language.identify(docs, model).collect()}
    assert {found[k] for k in range(40)} == {"de"}


def family(rng, n, words, least, most, kinds=10**9):
    """Copies of one text with so many words changed, to new words or to one of a few."""
    base = [f"w{rng.integers(10**6)}" for _ in range(words)]
    out = []
    for _ in range(n):
        copy = list(base)
        for at in rng.choice(words, rng.integers(least, most + 1), replace=False):
            copy[at] = f"x{rng.integers(kinds)}" if kinds > 100 else f"x{at}-{rng.integers(kinds)}"
        out.append(" ".join(copy))
    return out


def brute(texts):
    grams = [{tuple(w[k: k + 5]) for k in range(max(1, len(w) - 4))} for w in (t.split() for t in texts)]
    ids = {}
    for k, g in enumerate(grams):
        for s in g:
            ids.setdefault(s, len(ids))
    table = np.zeros((len(grams), len(ids)), np.float32)
    for k, g in enumerate(grams):
        table[k, [ids[s] for s in g]] = 1
    both = table @ table.T
    n = table.sum(axis=1)
    linked = 100 * both >= 75 * (n[:, None] + n[None, :] - both)
    root = np.arange(len(texts))
    while True:
        least = np.where(linked, root[None, :], len(texts)).min(axis=1)
        if (least == root).all():
            return root.tolist()
        root = least


@pytest.mark.parametrize("n, words, least, most, kinds", [
    (600, 150, 0, 9, 10**9),  # similarities of 0.5 to 1
    (500, 200, 4, 6, 10**9),  # all of them around the threshold, no centre among the members
    (500, 150, 3, 8, 2),  # edits repeat: differences are shared
    (300, 60, 1, 4, 1),
])
def test_large_families_against_all_pairs(spark, monkeypatch, n, words, least, most, kinds):
    rng = np.random.default_rng(n + most)
    texts = family(rng, n, words, least, most, kinds) + family(rng, 30, 40, 0, 2)
    widest = []
    confirm = neardup.confirm

    def counted(pairs, *args):
        widest.append(pairs.count())
        return confirm(pairs, *args)

    monkeypatch.setattr(neardup, "confirm", counted)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    found = {r.doc_id: r.component_id for r in neardup.near_duplicates(docs).collect()}
    want = brute(texts)
    assert [found[k] for k in range(len(texts))] == want
    assert 2 < len(set(want)) < len(texts)
    assert sum(widest) < 60 * len(texts)  # of some hundred pairs per text


@pytest.mark.parametrize("path", [BYTES, WORDS])
def test_signs_after_a_word_are_not_merged_with_it_again(path):
    """Words that differ in their trailing signs only go to the tokenizer once, in short calls."""
    ours, met = Encoder(path, path == BYTES), []
    encode_new = ours._encode_new
    ours._encode_new = lambda words: met.extend(words) or encode_new(words)
    text = "one word word!! word&&&,, word.' word's word's!! word'!! don't, ²!! _!! word_!! 7%%% <|x|>!! " + "\n".join(f"w{k}!?" for k in range(700))
    for _ in range(3):
        assert np.frombuffer(ours.encode([text])[0], "<u4").tolist() == whole(path, text)
    assert not {"word!!", "word&&&,,", "7%%%", "w5!?"} & {w.strip() for w in met}
    calls, library = [], ours.tokenizer
    ours.tokenizer = type("Counted", (), {"encode_batch_fast": lambda self, texts, **k: calls.extend(map(len, texts)) or library.encode_batch_fast(texts, **k)})()
    encode_new([f" abcdefgh{'x' * (k % 7)}{k}" for k in range(4096)])
    assert max(calls) < 8192


def test_near_duplicates_in_many_partitions_take_few_tasks(spark, monkeypatch):
    """Tables of few rows are few files however many partitions a shuffle has, and members out of reach are left out."""
    rng = np.random.default_rng(503)
    texts = family(rng, 300, 120, 3, 8, 2) + family(rng, 30, 40, 0, 2)
    files, rows = {}, {}

    def counted(df, name="stage", by=()):
        out = stage(df, name, by)
        files[name] = max(files.get(name, 0), len(out.inputFiles()))
        rows[name] = rows.get(name, 0) + out.count()
        return out

    for module in (neardup, components_module):
        monkeypatch.setattr(module, "stage", counted)
    held = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled")}
    try:
        for k, v in zip(held, ("64", "false")):
            spark.conf.set(k, v)
        docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(2)
        found = {r.doc_id: r.component_id for r in neardup.near_duplicates(docs).collect()}
    finally:
        for k, v in held.items():
            spark.conf.set(k, v)
    assert [found[k] for k in range(len(texts))] == brute(texts)
    assert max(files.values()) <= 8, files
    assert rows["smaller-groups"] < rows["sharing"] / 2
