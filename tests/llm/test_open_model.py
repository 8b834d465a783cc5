"""The open-vocabulary model against plain Kneser-Ney over code points, and texts that folded symbols cannot tell apart."""

import math
import random
from collections import Counter, defaultdict

import numpy as np
import pandas as pd
import pytest

from barline.llm import open_model, quality_model

EDGES = "edge_id bigint, lang string, hypothesis string"


class Plain:
    """Interpolated modified Kneser-Ney over runs of four code points, by the definition."""

    def __init__(self, texts):
        self.levels = {}
        grams = Counter()
        for t in texts:
            s = "   " + t
            grams.update(s[k : k + 4] for k in range(len(s) - 3))
        for order in (4, 3, 2, 1):
            n = Counter(grams.values())
            y = n[1] / (n[1] + 2 * n[2]) if n[1] else 0.5
            d = [0] + [max(0.1, k - (k + 1) * y * n[k + 1] / n[k] if n[k] else y) for k in (1, 2, 3)]
            total, left = defaultdict(int), defaultdict(float)
            for g, c in grams.items():
                total[g[:-1]] += c
                left[g[:-1]] += d[min(c, 3)]
            self.levels[order] = (grams, d, total, left)
            shorter = Counter()
            for g in grams:
                shorter[g[1:]] += 1
            grams = shorter

    def p(self, gram):
        if not gram:
            return 1 / 0x110000
        grams, d, total, left = self.levels[len(gram)]
        shorter = self.p(gram[1:])
        if gram[:-1] not in total:
            return shorter
        c = grams.get(gram, 0)
        return (c - d[min(c, 3)] + left[gram[:-1]] * shorter) / total[gram[:-1]]

    def perplexity(self, text):
        s = "   " + text
        return math.exp(-sum(math.log(self.p(s[k : k + 4])) for k in range(len(s) - 3)) / len(text))


def judged(df, trusted):
    return quality_model.classify(df, trusted, folded=False).collect()


def folds(spark, rows):
    df = spark.createDataFrame(rows, EDGES).selectExpr("edge_id", "pmod(xxhash64(edge_id), 2) AS fold")
    return {r["edge_id"]: r["fold"] for r in df.collect()}


def test_perplexities_are_kneser_ney_over_code_points(spark):
    texts = ["the cat sat on the mat.", "the dog ate the cat!", "A DOG, a cat: 12 mats", "ça été", "чай 中文 😀 чайник 中文", "xyz " * 40]
    rows = [(i, "en", t) for i, t in enumerate(texts)] + [(9, "zz", "other cats 13?"), (10, "en", "тест"), (11, "zz", "😀")]
    df = spark.createDataFrame(rows, EDGES).repartition(3)
    got = {r["edge_id"]: r for r in judged(df, df.filter("edge_id < 6").select("edge_id"))}
    plain = Plain(texts)
    for i, _, t in rows:
        assert got[i]["perplexity"] == pytest.approx(plain.perplexity(t), rel=1e-9), t
    fold = folds(spark, rows)
    held = [Plain([t for j, t in enumerate(texts) if fold[j] != fold[i]]).perplexity(texts[i]) for i in range(6)]
    assert {r["threshold"] for r in got.values()} == {math.ceil(max(held) * 1000) / 1000}
    assert all(r["kept"] == (r["perplexity"] <= r["threshold"]) for r in got.values())


SCRIPTS = {"ru": "бвгдежзиклмнопрст", "el": "αβγδεζηθικλμνξοπ", "caps": "ABCDEFGHIJKLMNOPQ", "zh": "天地玄黄宇宙洪荒日月盈昃辰宿列"}


def test_scrambled_texts_are_told_from_their_originals(spark):
    rng = random.Random(5)

    def scrambled(text):
        return " ".join("".join(rng.sample(w, len(w))) for w in text.split())

    rows = []
    for n, (lang, letters) in enumerate(SCRIPTS.items()):
        words = ["".join(rng.choice(letters) for _ in range(rng.randint(4, 9))) for _ in range(40)]
        clean = [" ".join(rng.choice(words) for _ in range(60)) for _ in range(60)]
        rows += [(1000 * n + i, lang, t) for i, t in enumerate(clean)] + [(1000 * n + 100 + i, lang, scrambled(t)) for i, t in enumerate(clean)]
    df = spark.createDataFrame(rows, EDGES)
    got = {r["edge_id"]: r for r in judged(df, df.filter("edge_id % 1000 < 40").select("edge_id"))}
    for n in range(0, 4000, 1000):
        assert all(got[n + 100 + i]["perplexity"] > 2 * got[n + i]["perplexity"] for i in range(60))
        assert not any(got[n + 100 + i]["kept"] for i in range(60)) and sum(got[n + i]["kept"] for i in range(60)) > 50


def test_a_language_in_one_fold_borrows_from_all(spark):
    rows = [(i, "en", f"some words of number {i} and more") for i in range(20)]
    fold = folds(spark, [(i, "", "") for i in range(200)])
    alone = [i for i in range(100, 200) if fold[i] == 0][:3]
    rows += [(i, "fr", f"des mots {i} en plus") for i in alone]
    df = spark.createDataFrame(rows, EDGES)
    got = {r["edge_id"]: r for r in judged(df, df.select("edge_id"))}
    french = Plain([t for _, lang, t in rows if lang == "fr"])
    others = Plain([t for i, _, t in rows if fold[i] == 1])
    own = [(i, t) for i, lang, t in rows if lang == "fr"]
    assert all(got[i]["perplexity"] == pytest.approx(french.perplexity(t), rel=1e-9) for i, t in own)
    limit = math.ceil(max(others.perplexity(t) for _, t in own) * 1000) / 1000
    assert {got[i]["threshold"] for i in alone} == {limit}


def test_null_empty_repeated_and_nothing_trusted(spark):
    rows = [(1, "en", "words here"), (1, "en", "words here"), (None, "en", "words"), (2, None, "words"), (3, "en", None), (4, "en", "")]
    df = spark.createDataFrame(rows, EDGES)
    got = judged(df, df.filter("edge_id = 1 OR edge_id IS NULL").select("edge_id"))
    assert len(got) == 6
    assert {r["edge_id"]: r["perplexity"] is None for r in got} == {1: False, None: False, 2: False, 3: True, 4: True}
    assert not any(r["kept"] for r in got if r["edge_id"] in (3, 4))
    none = judged(df, df.filter("false").select("edge_id"))
    assert len(none) == 6 and not any(r["kept"] or r["perplexity"] is not None for r in none)


def test_runs_of_many_code_points(monkeypatch):
    texts = ["abcabc", "чай", "😀a😀a😀a"]
    seen = [open_model.runs(texts)]
    monkeypatch.setattr(open_model, "_NARROW", 2)
    seen.append(open_model.runs(texts))
    for context, symbol, run, of in seen:
        found = [chr(c >> 42) + chr(c >> 21 & 0x1FFFFF) + chr(c & 0x1FFFFF) + chr(s) for c, s in zip(context.tolist(), symbol.tolist())]
        plain = [(i, ("   " + t)[k : k + 4]) for i, t in enumerate(texts) for k in range(len(t))]
        assert [(i, found[r]) for i, r in zip(of.tolist(), run.tolist())] == plain
        assert len(set(found)) == len(found)


def test_groups_of_texts_give_the_same(spark, monkeypatch):
    rows = [(i, "en" if i % 3 else "fr", f"words of text {i % 7} and {i * 31}") for i in range(60)]
    df = spark.createDataFrame(rows, EDGES)
    trusted = df.filter("edge_id < 40").select("edge_id")
    whole = pd.DataFrame(judged(df, trusted)).sort_values(0).to_numpy()
    monkeypatch.setattr(open_model, "GROUP_CHARS", 200)
    parts = pd.DataFrame(judged(df, trusted)).sort_values(0).to_numpy()
    assert np.array_equal(whole, parts)
