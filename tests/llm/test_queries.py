"""Every text query against its SQL twin, or its contract, on the smallest tables; the pipeline stage by stage."""

import pytest
from tokenizers import Tokenizer

import __spark_entry__ as entry
import corpus_pipeline
from barline.llm import packing
from barline.llm.queries import ORACLES, QUERIES
from tests.llm import brute
from tests.oracle import compare

COLUMNS = {
    "op1_near_dup": {"doc_id", "n_shingles", "component_id", "kept"},
    "op4_language_id": {"doc_id", "page_id", "lang"},
    "op6_sharding": {"doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard"},
    "op7_substring_dedup": {"doc_id", "n_words", "n_removed", "kept_sha256"},
    "op8_fingerprints": {"doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"},
    "op9_quality_model": {"doc_id", "perplexity", "threshold", "kept"},
    "op12_token_alignment": {"doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"},
    "op10_packing": {"doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"},
}


def test_all_are_registered():
    assert sorted(int(n[2:].split("_")[0]) for n in QUERIES) == list(range(1, 14))
    assert {*QUERIES, "pipeline"} <= set(entry.queries())
    assert set(COLUMNS) | set(ORACLES) == set(QUERIES)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_matches_sql(spark, sf, name):
    assert compare(spark, name, QUERIES[name], ORACLES[name], sf)[1] is None


@pytest.mark.parametrize("name", sorted(COLUMNS))
def test_query_has_its_columns_and_all_rows(spark, sf, documents, name):
    df = QUERIES[name](spark, sf)
    assert COLUMNS[name] <= set(df.columns)
    assert {r["doc_id"] for r in df.select("doc_id").collect()} - {None} == set(documents)


def test_pipeline_stages(spark, sf, documents):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns = docs.columns
    ruled = corpus_pipeline.quality_rules(spark, docs, sf)
    kept = {r["doc_id"]: r["text"] for r in ruled.collect()}
    verdicts = {r["doc_id"] for r in QUERIES["op5_quality_rules"](spark, sf).filter("kept").collect()}
    assert set(kept) == verdicts and sorted(ruled.columns) == sorted(columns)
    assert all(set(t.split("\n")) <= set(documents[i].split("\n")) for i, t in kept.items())

    single = corpus_pipeline.near_duplicates(spark, ruled, sf)
    texts = {r["doc_id"]: r["text"] for r in single.collect()}
    assert set(texts) == {i for i, (_, least) in brute.near_groups(kept.items()).items() if i == least}

    cut = corpus_pipeline.repeated_passages(spark, single, sf)
    after = {r["doc_id"]: (r["text"], r["n_chars"]) for r in cut.collect()}
    for i, _, gone, words in brute.without_repeats(sorted(texts.items())):
        text = " ".join(words) if gone else texts[i]
        assert after[i] == (text, len(text))

    mixed = corpus_pipeline.source_mix(spark, cut, sf)
    rows = mixed.collect()
    assert sorted(mixed.columns) == sorted(columns)
    assert max(sum(r["doc_id"] == i for r in rows) for i in after) <= 3
    total = sum(len(brute.words(t)) for t, _ in after.values())
    assert 0 <= total - sum(len(brute.words(r["text"])) for r in rows) <= max(len(brute.words(t)) for t, _ in after.values())

    tokenizer = Tokenizer.from_file(packing.default_vocabulary())
    pieces = corpus_pipeline.pack_sequences(spark, mixed, sf).collect()
    wanted = sorted((r["doc_id"], *p) for r in rows for p in brute.token_pieces(r["text"], tokenizer, 2048))
    assert sorted((p["doc_id"], p["piece"], p["start"], p["length"], p["ids_crc32"]) for p in pieces) == wanted


def test_pipeline_takes_nulls_repeats_and_no_rows(spark, sf):
    text = "A sentence of words that stand here. " + " ".join(f"w{k}" for k in range(30)) + "."
    rows = [(None, text, "en", None, 1), (1, text, None, "a", 1), (1, text, None, "a", 1), (2, None, "en", "a", None), (3, "", "en", "", 0)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint")
    for _, stage in corpus_pipeline.STAGES:
        df = stage(spark, docs, sf)
        df.collect()
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs.filter("false"), sf).count() == 0, name
