"""Repeated passages against a plain scan over all windows."""

import numpy as np

from barline.llm import substring_dedup
from tests.llm import brute

EDGES = "edge_id bigint, rationale string, n_words string"


def check(spark, rows, **how):
    df = spark.createDataFrame([(i, t, "clash") for i, t in rows], EDGES).repartition(3)
    got = {r["edge_id"]: (r["n_words"], r["n_removed"], r["kept_text"]) for r in substring_dedup.remove_repeats(df, **how).collect()}
    assert got == {i: (n, gone, " ".join(kept)) for i, n, gone, kept in brute.without_repeats(sorted(rows))}


def test_given_documents_in_many_chunks(spark, documents, monkeypatch):
    monkeypatch.setattr(substring_dedup, "CHUNK_BYTES", 1 << 15)
    monkeypatch.setattr(substring_dedup, "BUCKET_HASHES", 1 << 12)
    check(spark, list(documents.items()))


def test_shifted_passages_of_all_lengths(spark, monkeypatch):
    monkeypatch.setattr(substring_dedup, "CHUNK_BYTES", 1 << 10)
    monkeypatch.setattr(substring_dedup, "BUCKET_HASHES", 1 << 8)
    rng = np.random.default_rng(1)
    passage = [f"p{k}" for k in range(60)]
    rows = []
    for i in range(120):
        start, n = int(rng.integers(30)), int(rng.integers(15, 31))
        before = [f"b{i}_{k}" for k in range(int(rng.integers(25)))]
        rows.append((i, " ".join(before + passage[start : start + n] + [f"a{i}"])))
    rows += [(200, "loop " * 100), (201, "loop " * 19), (202, "loop " * 20), (203, ""), (204, None), (205, " \n"), (206, "x\ty  z")]
    check(spark, rows)


def test_layout_carried_columns_repeated_rows_and_null_ids(spark):
    long = " ".join(f"w{k}" for k in range(25))
    df = spark.createDataFrame(
        [(1, f"{long}\n", "en"), (1, f"{long}\n", "en"), (None, long, None), (2, "a\n b", "de")],
        "edge_id bigint, rationale string, lang string",
    )
    got = substring_dedup.remove_repeats(df, carry=("lang",), keep_layout=True).collect()
    assert sorted((r["edge_id"] or 9, r["n_removed"], r["kept_text"], r["lang"]) for r in got if r["lang"]) == [
        (1, 0, f"{long}\n", "en"),
        (1, 25, "", "en"),
        (2, 0, "a\n b", "de"),
    ]
    assert [r["n_removed"] for r in got if r["edge_id"] is None] == [25]


def test_empty_table(spark):
    assert substring_dedup.remove_repeats(spark.createDataFrame([], EDGES)).count() == 0
