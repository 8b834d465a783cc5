"""Pieces against the tokenizer, sequences against their law and a lower bound."""

import numpy as np
import pytest
from tokenizers import Tokenizer

from barline.llm import packing
from tests.llm import brute

OUTPUTS = "output_id bigint, content string, piece string"
VOCABULARY = packing.default_vocabulary()


@pytest.fixture(scope="module")
def tokenizer():
    return Tokenizer.from_file(VOCABULARY)


def sequences(rows, capacity):
    by = {}
    for r in rows:
        by.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for places in by.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= capacity
    return len(by)


def test_given_documents(spark, documents, tokenizer):
    df = spark.createDataFrame([(i, t, "clash") for i, t in documents.items()], OUTPUTS)
    rows = packing.pack(packing.token_pieces(df, VOCABULARY)).collect()
    got = {}
    for r in rows:
        got.setdefault(r["output_id"], []).append((r["piece"], r["start"], r["length"], r["ids_crc32"]))
    assert {i: sorted(p) for i, p in got.items()} == {i: brute.token_pieces(t, tokenizer, 2048) for i, t in documents.items()}
    assert sequences(rows, 2048) <= 1.03 * sum(r["length"] for r in rows) / 2048 + 1


def test_texts_that_need_the_whole_tokenizer(spark, tokenizer):
    texts = [
        "<|endoftext|> x<|startoftext|>y <|", "ΣΑΣ Σ", "İstanbul ǅ", "é äb ̈", "日本語 текст", "it's I'M we'LL 12a3",
        "ß ẞ ÿ Ÿ ÀÉ×÷ª", " a b\u0085c", "🙂🙂 a🙂", "", None, "\x00 \x1f\x7f", "word " * 3000, "z" * 5000,
    ]
    df = spark.createDataFrame([(i, t, "") for i, t in enumerate(texts)], OUTPUTS)
    got = {}
    for r in packing.token_pieces(df, VOCABULARY, capacity=64).collect():
        got.setdefault(r["output_id"], []).append((r["piece"], r["start"], r["length"], r["ids_crc32"]))
    assert {i: sorted(p) for i, p in got.items()} == {i: brute.token_pieces(t, tokenizer, 64) for i, t in enumerate(texts)}


def test_many_groups_repeated_rows_and_null_ids(spark):
    rng = np.random.default_rng(2)
    rows = [(int(k) if k % 7 else None, 0, 0, int(n), 0) for k, n in enumerate(rng.integers(1, 101, 3000))] * 2
    df = spark.createDataFrame(rows, "output_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint")
    got = packing.pack(df, capacity=100, group_pieces=500).collect()
    assert len(got) == len(rows)
    assert sequences(got, 100) <= 1.03 * sum(r[3] for r in rows) / 100


def test_sum_of_squares_takes_the_least_sum():
    rng = np.random.default_rng(4)
    sizes = rng.integers(1, 21, 300)
    bins, offsets, left = packing.sum_of_squares(sizes, 20)
    gaps, count = {}, lambda gs: sum(c * c for g, c in zip(*np.unique(gs, return_counts=True)) if g) if len(gs) else 0
    for size, b, offset in zip(sizes, bins, offsets):
        options = []
        for other, gap in gaps.items():
            if gap >= size:
                options.append(count([*(g for o, g in gaps.items() if o != other), gap - size]))
        if b in gaps:
            assert gaps[b] == 20 - offset
            mine = count([*(g for o, g in gaps.items() if o != b), gaps[b] - size])
            assert mine == min(options)
            gaps[b] -= size
        else:
            assert not options and offset == 0
            gaps[b] = 20 - size
    assert left.tolist() == [gaps[b] for b in bins]


def test_empty_table(spark):
    assert packing.pack(packing.token_pieces(spark.createDataFrame([], OUTPUTS), VOCABULARY)).count() == 0


def test_plain_chunks_are_cut_at_once(tokenizer):
    chunks = ["it'", "s", "IT'S", "ÀÉ×12a", "'", "re,", "..!a'll", "a"]
    words = packing.WordTokenizer(VOCABULARY)
    ids, sizes = words._plain_ids(chunks)
    assert [x.tolist() for x in np.split(ids, np.cumsum(sizes)[:-1])] == [tokenizer.encode(c, add_special_tokens=False).ids for c in chunks]


def test_chunks_of_the_same_pre_tokens_are_not_kept_each(tokenizer):
    words = packing.WordTokenizer(VOCABULARY)
    texts = [" ".join(f"{a}{mark}{b.upper()}" for a in ("eins", "deux", "trés") for b in ("vier", "it's") for mark in marks) for marks in ("-_/", ".,;")]
    ids, begins = words.texts(texts)
    assert [x.tolist() for x in np.split(ids, begins[1:-1])] == [tokenizer.encode(t, add_special_tokens=False).ids for t in texts]
    # 36 chunks of 5 words, 's and 6 marks
    assert sum(len(x) for x in vars(words).values() if isinstance(x, dict) and x is not words.spell) == 12


def test_texts_cut_together(tokenizer):
    words, rng = packing.WordTokenizer(VOCABULARY), np.random.default_rng(7)
    signs = [*"astmdrevlSREVL''''09.,<| \n", "<|endoftext|>", "Ä", "ß", "ÿ", "×", "\xa0", "\x1c", "\x85", "̈", "İ", "日", "🙂", "　"]
    for few in (27, len(signs)):
        texts = ["".join(rng.choice(signs[:few], n)) for n in rng.integers(0, 30, 2000)]
        ids, begins = words.texts(texts)
        assert len(ids) == begins[-1]
        assert [x.tolist() for x in np.split(ids, begins[1:-1])] == [tokenizer.encode(t, add_special_tokens=False).ids for t in texts]
