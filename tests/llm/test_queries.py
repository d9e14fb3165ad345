"""The registered text queries and the pipeline."""

import pytest
from conftest import SF
from oracle import compare, duck

import corpus_pipeline
from linkcast.llm.queries import QUERIES, SQL
from linkcast.session import stage

COLUMNS = {
    "op1_line_dedup": "doc_id n_lines n_dropped kept_sha256",
    "op2_near_dedup": "doc_id n_shingles component_id kept",
    "op3_quality_rules": "doc_id n_words word_chars n_symbols n_dup_lines n_repeat_words base_failed kept",
    "op4_decontamination": "doc_id item_id",
    "op5_packing": "doc_id piece start length ids_crc32 sequence_id offset",
    "op6_language": "doc_id held_out lang_pred score",
    "op7_pii": "doc_id n_email n_ip n_card n_phone base_sha256 spans",
    "op8_token_files": "doc_id start n_tokens ids_crc32",
    "op9_sharding": "doc_id size text_crc32 law shard slot grown_shard",
    "op10_token_counts": "doc_id n_tokens section_tokens",
    "op11_whitening": "vec_id component n deviation whitened explained identity_error",
    "op13_toxicity": "doc_id held_out score predicted",
    "op12_infill": "doc_id n form prefix_chars middle_chars output_sha256 restored_sha256",
}


def test_all_are_registered():
    assert set(QUERIES) == set(COLUMNS)


@pytest.mark.parametrize("name", sorted(SQL))
def test_matches_sql(spark, name):
    assert compare(spark, duck(SF), SF, name, QUERIES[name], SQL[name]) == ""


@pytest.mark.parametrize("name", sorted(set(COLUMNS) - set(SQL)))
def test_columns_and_rows(spark, name):
    df = QUERIES[name](spark, SF)
    assert set(COLUMNS[name].split()) <= set(df.columns)
    key, table = ("vec_id", "embeddings") if "vec_id" in df.columns else ("doc_id", "documents")
    assert df.select(key).distinct().count() == spark.read.parquet(f"{SF}/{table}.parquet").count()


def test_pipeline(spark):
    """Each stage returns the columns of documents; each decision is that of its operator."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, seen = docs.columns, [{r.doc_id for r in docs.select("doc_id").collect()}]
    for name, fn in corpus_pipeline.STAGES[:-1]:
        docs = stage(fn(spark, docs, SF), name)
        assert docs.columns == columns
        ids = [r.doc_id for r in docs.select("doc_id").collect()]
        assert len(ids) == len(set(ids)) and set(ids) <= seen[-1]
        seen.append(set(ids))
    assert len(seen[1]) == len(seen[0])  # all are in known languages
    left = {r.doc_id: r.text for r in docs.collect()}
    lines = [x.strip().lower() for t in left.values() for x in set(t.split("\n")) if len(x.strip()) >= 10]
    assert len(lines) == len(set(lines)) or len(lines) - len(set(lines)) < 3  # equal lines inside one document differ in case
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, SF)
    assert {r.doc_id for r in packed.select("doc_id").distinct().collect()} == set(left)
