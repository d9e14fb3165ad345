"""Toxicity: features against plain Python, selection and fitting on planted words, odd tables."""

import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from linkcast.llm import toxicity

DOCS, LABELS = "doc_id long, text string", "doc_id long, toxic int"
BAD = ["idiotic", "scummer", "trashig"]


def plain(text):
    words = re.findall(r"[^\W\d_]+", text.lower())
    return {w for w in words} | {(n, w[:n]) for w in words for n in toxicity.PREFIXES if len(w) >= n}


@pytest.mark.parametrize("text", ["", "a", "12 -- 3", "Ünïté des été; word word wording", "x" * 50, "日本語 and ß_ß"])
def test_as_many_features_as_words_and_beginnings(text):
    found = [np.zeros(0, np.uint64)] + [h for _, h in toxicity.hashed([text])]
    assert len(np.unique(np.concatenate(found))) == len(plain(text))


def test_features_do_not_depend_on_parts_and_neighbours():
    texts = ["alpha beta\ngamma", None, "", "beta", "delta " * 50 + "alphabet"]
    of = lambda ts: [{int(h) for o, hs in toxicity.hashed(ts) for h in hs[o == k]} for k in range(len(ts))]
    one_by_one = [of([t])[0] for t in texts]
    assert of(texts) == one_by_one and one_by_one[1] == one_by_one[2] == set()
    whole, toxicity.PART = toxicity.PART, 7
    try:
        assert of(texts) == one_by_one
    finally:
        toxicity.PART = whole


def test_find():
    texts = ["alpha beta", "beta beta", "", "gamma"]
    wanted = np.concatenate([h for _, h in toxicity.hashed(["beta gamma"])])
    known = toxicity.Features(wanted)
    owner, place = known.find(texts)
    got = {k: {int(known.hashes[p]) for p in place[owner == k]} for k in range(4)}
    of = lambda t: {int(h) for _, hs in toxicity.hashed([t]) for h in hs}
    assert got == {0: of("beta"), 1: of("beta"), 2: set(), 3: of("gamma")}
    assert len(toxicity.Features(np.zeros(0, np.uint64)).find(texts)[0]) == 0


def test_risk_does_not_follow_noise():
    """Of the unlabelled, a fifth are positive; a feature of half of all texts stays without weight."""
    rng = np.random.default_rng(1)
    row = lambda toxic: np.array(([0] if toxic else []) + ([1] if rng.random() < 0.5 else []), np.int64)
    positive = [row(True) for _ in range(300)]
    unlabelled = [row(k % 5 == 0) for k in range(3000)]
    w, b = toxicity.nnpu(positive, unlabelled, 2, 0.2)
    chance = lambda g: 1 / (1 + np.exp(-g))
    assert chance(w[0] + b) > 0.9 and chance(w.sum() + b) > 0.9
    assert chance(b) < 0.1 and chance(w[1] + b) < 0.1


def corpus(n=2400):
    rng = np.random.default_rng(3)
    words = ["".join(rng.choice(list("abcdefghijkl"), 5)) for _ in range(300)]
    docs, truth = [], {}
    for i in range(n):
        text = rng.choice(words, rng.integers(3, 60)).tolist()
        truth[i] = int(i % 8 == 0)
        if truth[i]:
            text.insert(int(rng.integers(len(text))), str(rng.choice(BAD)))
        docs.append((i, " ".join(text)))
    return docs, truth


@pytest.fixture(scope="module")
def planted(spark):
    docs, truth = corpus()
    known = [(i, t) for i, t in truth.items() if i % 3]
    return docs, truth, known


def test_held_out_documents(spark, planted):
    docs, truth, known = planted
    # The labels of held-out documents are wrong: they must not be read.
    fold = lambda i: zlib.crc32(str(i).encode()) % 3 == 1
    labels = [(i, 1 - t if fold(i) else t) for i, t in known] + [(None, 1), (1, None)]
    df = spark.createDataFrame([*docs, (None, "word"), (None, None), (5000, None), (5001, ""), docs[0]], DOCS)
    for name in ("h", "toxic", "doc", "score", "f"):
        df = df.withColumn(name, F.lit("x"))
    model = toxicity.train(df, spark.createDataFrame(labels, LABELS).withColumn("text", F.lit("y")))
    found = toxicity.score(df, model).collect()
    assert len(found) == len(docs) + 5 and found[0]["f"] == "x"
    by_id = {r.doc_id: r.score for r in found}
    hits = {i: by_id[i] >= 0.7 for i in truth}
    assert np.mean([hits[i] for i, t in truth.items() if t and fold(i)]) > 0.95
    assert np.mean([hits[i] for i, t in truth.items() if not t]) < 0.01
    assert 0 <= by_id[5000] == by_id[5001] < 0.3


def test_long_text(spark, planted):
    docs, truth, known = planted
    model = toxicity.train(spark.createDataFrame(docs, DOCS), spark.createDataFrame(known, LABELS))
    clean = " ".join(t for i, t in docs if not truth[i])
    long = [(1, clean * 30), (2, clean * 30 + " idiotic")]
    low, high = (r.score for r in toxicity.score(spark.createDataFrame(long, DOCS), model).orderBy("doc_id").collect())
    assert low < 0.5 < 0.7 <= high


@pytest.mark.parametrize("docs, labels", [
    ([], []), ([(1, "a b")], []), ([], [(1, 1)]), ([(1, None), (2, "")], [(1, 1), (2, 1)]),
    ([(1, "some text"), (1, "some text")], [(1, 0), (1, None)]), ([(None, "x y")], [(None, 1)]),
])
def test_nothing_to_learn(spark, docs, labels):
    df = spark.createDataFrame(docs, DOCS)
    model = toxicity.train(df, spark.createDataFrame(labels, LABELS))
    assert [r.score for r in toxicity.score(df, model).collect()] == [0.0] * len(docs)


def test_samples_are_bounded(spark, planted):
    docs, _, known = planted
    df, labels = spark.createDataFrame(docs * 3, DOCS), spark.createDataFrame(known, LABELS)
    model = toxicity.train(df, labels, positives=20, unlabelled=50)
    assert model.sizes["positives"] == 20 and model.sizes["unlabelled"] == 50 and model.sizes["texts"] == len(docs)
