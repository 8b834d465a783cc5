"""Token alignment against a plain one; the hash functions and the chunks on their own."""

import hashlib
import random
from collections import Counter

import numpy as np
import pytest
from sentencepiece import SentencePieceProcessor
from tokenizers import Tokenizer

from barline.llm import alignment
from barline.llm.alignment import Aligner, _byte_letters, align, default_vocabularies, perfect_hash, slots

FIRST, SECOND = default_vocabularies()


@pytest.fixture(scope="module")
def whole():
    a, b = Tokenizer.from_file(FIRST), SentencePieceProcessor(model_file=SECOND)
    a.encode_special_tokens = True
    letters = _byte_letters()

    def tokens(text):
        if not text:
            return [], []
        spelled = (" " + text).encode()
        left = [(k, bytes(letters[c] for c in a.id_to_token(k))) for k in a.encode(" " + text, add_special_tokens=False).ids]
        pieces = [(k, b.id_to_piece(k)) for k in b.encode(text)]
        right = [(k, bytes([int(p[3:-1], 16)]) if b.is_byte(k) else p.replace("▁", " ").encode()) for k, p in pieces]
        if b"".join(x for _, x in left) != spelled or b"".join(x for _, x in right) != spelled:
            return [], []
        return left, right

    return tokens


def plain(rows, tokens):
    """Facts of each row by walking over the bytes."""
    each, counts = [], Counter()
    for i, text in rows:
        left, right = tokens(text)
        owner = [[k for k, (_, x) in enumerate(side) for _ in x] for side in (left, right)]
        links = sorted(set(zip(*owner)))
        counts.update((left[p][0], right[q][0]) for p, q in links)
        groups, l, r, at = [], [], [], 0
        ends = [np.cumsum([len(x) for _, x in side]).tolist() for side in (left, right)]
        both = set(ends[0]) & set(ends[1])
        p = q = 0
        for end in sorted(both):
            l, r = [], []
            while p < len(left) and ends[0][p] <= end:
                l.append(str(left[p][0]))
                p += 1
            while q < len(right) and ends[1][q] <= end:
                r.append(str(right[q][0]))
                q += 1
            groups.append(",".join(l) + "|" + ",".join(r))
        each.append((i, left, right, links, groups))
    top = {}
    for (_, y), n in counts.items():
        top[y] = max(top.get(y, 0), n)
    out = []
    for i, left, right, links, groups in each:
        pairs = [(left[p][0], right[q][0]) for p, q in links]
        hashed = hashlib.sha256(";".join(groups).encode()).hexdigest() if groups else ""
        best = sum(counts[x] == top[x[1]] for x in pairs)
        out.append((i, len(left), len(right), len(groups), len(links), best, sum(counts[x] for x in pairs), hashed))
    return sorted(out, key=repr)


def aligned(spark, rows, kind="bigint", **how):
    df = spark.createDataFrame(rows, f"output_id {kind}, content string")
    return sorted((tuple(r) for r in align(df, FIRST, SECOND, **how).collect()), key=repr)


def test_all_given_documents(spark, documents, whole):
    rows = list(documents.items())
    # small shards, leaves and groups, so that there are many of each
    assert aligned(spark, rows, shard_pairs=2000, leaf_rows=1, group_bytes=50_000) == plain(rows, whole)


def test_odd_texts(spark, whole):
    odd = ["", " ", "  x", "a  b", "\t\na b\n", "x y z", "ﬁne ½ <0x41> <s> <|endoftext|> \x00 z", "日本語 の 文 です。", "a\u0085 b", "don't 12 345", "🙂 a 🙂🙂", "é é", "a 　 b", "\x1c a\x1d b"]
    rows = [(k, t) for k, t in enumerate(odd)] + [(None, "a b"), (3, "a  b"), (90, None), (91, "wort " * 100_000)]
    assert aligned(spark, rows) == plain(rows, whole)


def test_chunks_give_the_tokens_of_the_whole_text(whole):
    rng = random.Random(5)
    letters = " '\n\t  ​\x1f.,;#aAzZéß0129日Ж☃́ͅʼ"
    aligner = Aligner(FIRST, SECOND)
    texts = ["".join(rng.choices(letters, weights=[12] + [1] * (len(letters) - 1), k=rng.randint(1, 30))) for _ in range(3000)]
    numbers, starts = aligner.texts(texts)
    for text, lo, hi in zip(texts, starts, starts[1:]):
        left, right = whole(text)
        assert tuple(aligner.facts[numbers[lo:hi]].sum(0)[:2]) == (len(left), len(right)), repr(text)
        spelled = "".join(aligner.groups[k] for k in numbers[lo:hi])
        assert [int(x) for g in spelled.split(";")[:-1] for x in g.split("|")[0].split(",")] == [k for k, _ in left]
        assert [int(x) for g in spelled.split(";")[:-1] for x in g.split("|")[1].split(",")] == [k for k, _ in right]


@pytest.mark.parametrize("n", [0, 1, 2, 1000, 70_000])
def test_hash_function_is_minimal_and_perfect(n):
    keys = np.random.default_rng(n).choice(1 << 40, n, replace=False)
    sizes, bits = perfect_hash(keys)
    assert sorted(slots(keys, sizes, bits)) == list(range(n))


def test_unknown_pairs_are_noticed():
    keys = np.arange(100)
    sizes, bits = perfect_hash(keys)
    known = np.empty_like(keys)
    known[slots(keys, sizes, bits)] = keys
    with pytest.raises(RuntimeError):
        alignment._checked_slots(np.arange(50, 150), sizes, bits, known)


def test_no_rows_and_other_columns(spark):
    df = spark.createDataFrame([("x", "a b", 1, "y", 2.0)], "output_id string, content string, _row int, pair string, n_best double")
    row = align(df, FIRST, SECOND).collect()[0]
    assert (row["output_id"], row["n_first"], row["n_second"], row["n_links"], row["n_best"], row["count_sum"]) == ("x", 2, 2, 2, 2, 2)
    assert align(df.filter("false"), FIRST, SECOND).collect() == []


def test_vocabularies_are_read_once_in_a_worker():
    assert Aligner(FIRST, SECOND).first is Aligner(FIRST, SECOND, strings=False).first


def test_chunks_that_are_not_spelt_back_are_left_out():
    table, sizes = [b"a", b"bc", None, b"d"], np.array([1, 2, 0, 1])
    cases = [([0, 1], b"abc", True), ([1], b"ab", False), ([], b"", True), ([3, 2], b"d", False), ([0, 1], b"ab", False), ([3, 0], b"da", True)]
    ids, counts = np.array([k for x, _, _ in cases for k in x]), np.array([len(x) for x, _, _ in cases])
    assert alignment._spelt(ids, counts, table, sizes, [t for _, t, _ in cases]).tolist() == [good for _, _, good in cases]
