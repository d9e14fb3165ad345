"""Each stage of the pipeline on nulls, empty tables, long texts, repeated rows and odd columns."""

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from linkcast.session import stage

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
PROSE = "the report was written by the people of the town and it was read to them in the evening "
ROWS = [
    *[(k, PROSE * (1 + k % 4) + f"number {k} of them came later with {' '.join(f'w{k}x{j}' for j in range(30))}", "en", "a", k) for k in range(20)],
    (20, None, "en", None, None), (21, "", None, "a", 0), (22, "\n \n", "en", "a", 3), (None, PROSE + "without an id", "en", "a", 1),
    (None, None, None, None, None), (23, " ".join(f"word{j % 900} and the" for j in range(60_000)), "en", "a", 5),
    (24, PROSE + "this one is there twice", "en", "a", 5), (24, PROSE + "this one is there twice", "en", "a", 5),
]
ODD = ("_language", "_leaks", "_id", "_digest", "found", "found_", "row", "h", "id", "digest", "first", "n", "a_id", "leaks", "language")


@pytest.mark.parametrize("name, fn", corpus_pipeline.STAGES[:-1])
def test_stage(spark, name, fn):
    docs = spark.createDataFrame(ROWS, SCHEMA)
    odd = docs
    for column in ODD:
        odd = odd.withColumn(column, F.lit("x"))
    plain = stage(fn(spark, docs, SF), name)
    assert plain.columns == docs.columns
    kept = fn(spark, odd, SF)
    assert kept.columns == odd.columns
    assert sorted(map(str, kept.select(*docs.columns).collect())) == sorted(map(str, plain.collect()))
    ids = [r.doc_id for r in plain.collect()]
    assert {*range(20), 23, 24} <= set(ids)  # clean documents stay
    assert ids.count(24) == (1 if name == "near_dedup" else 2)
    assert fn(spark, docs.limit(0), SF).count() == 0


def test_packing_stage(spark):
    docs = spark.createDataFrame(ROWS, SCHEMA)
    packed = corpus_pipeline.packing(spark, docs, SF)
    first = packed.where("piece = 0").collect()
    assert sorted((r.doc_id for r in first), key=str) == sorted((r[0] for r in ROWS), key=str)
    assert corpus_pipeline.packing(spark, docs.limit(0), SF).count() == 0
