"""The model against a plain Kneser-Ney implementation, its verdicts against held-out labels."""

import math
from collections import Counter, defaultdict

import numpy as np
import pytest

from barline.llm import quality_model

EDGES = "edge_id bigint, lang string, hypothesis string, threshold string"


def symbols(text):
    table = quality_model._symbol_table()
    return [quality_model.SPACE] * 3 + [int(table[ord(c)]) for c in text]


class Plain:
    """Interpolated modified Kneser-Ney over runs of four symbols, by the definition."""

    def __init__(self, texts):
        self.levels = {}
        grams = Counter()
        for t in texts:
            s = symbols(t)
            grams.update(tuple(s[k : k + 4]) for k in range(len(s) - 3))
        for order in (4, 3, 2, 1):
            n = Counter(grams.values())
            y = n[1] / (n[1] + 2 * n[2]) if n[1] else 0.5
            d = [0] + [max(0.1, k - (k + 1) * y * n[k + 1] / n[k] if n[k] else y) for k in (1, 2, 3)]
            total, left = defaultdict(int), defaultdict(float)
            for g, c in grams.items():
                total[g[:-1]] += c
                left[g[:-1]] += min(d[min(c, 3)], c)
            self.levels[order] = (grams, d, total, left)
            shorter = Counter()
            for g in grams:
                shorter[g[1:]] += 1
            grams = shorter

    def p(self, gram):
        if not gram:
            return 1 / 32
        grams, d, total, left = self.levels[len(gram)]
        shorter = self.p(gram[1:])
        if gram[:-1] not in total:
            return shorter
        c = grams.get(gram, 0)
        return (c - min(d[min(c, 3)], c) + left[gram[:-1]] * shorter) / total[gram[:-1]]

    def perplexity(self, text):
        s = symbols(text)
        return math.exp(-sum(math.log(self.p(tuple(s[k : k + 4]))) for k in range(len(s) - 3)) / len(text))


def test_perplexities_are_kneser_ney(spark):
    texts = ["the cat sat on the mat.", "the dog ate the cat!", "A dog, a cat: 12 mats", "ça été", "xyz " * 40]
    rows = [(i, "en", t, "clash") for i, t in enumerate(texts)] + [(9, "zz", "other cats?", ""), (10, "en", "#$%", "")]
    df = spark.createDataFrame(rows, EDGES).repartition(3)
    got = {r["edge_id"]: r for r in quality_model.classify(df, df.filter("edge_id < 5").select("edge_id")).collect()}
    plain = Plain(texts)
    for i, _, t, _ in rows:
        assert got[i]["perplexity"] == pytest.approx(plain.perplexity(t), rel=1e-5), t
    assert {r["threshold"] for r in got.values()} == {got[0]["threshold"]}
    assert all(r["kept"] == (r["perplexity"] <= r["threshold"]) for r in got.values()) and not got[10]["kept"]


def test_probabilities_add_up(spark):
    df = spark.createDataFrame([(0, "en", "some words of text, and more of it. " * 3)], "fold int, lang string, hypothesis string")
    models, others = quality_model.train_languages(df)
    assert [sorted(m) for m in (models, *others)] == [["", "en"], [], ["", "en"]]
    for packed in models.values():
        assert np.allclose(np.exp(quality_model.log_table(packed).astype("f8")).reshape(-1, 32).sum(axis=1), 1, atol=1e-4)


def test_held_out_labels(spark):
    sf = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{sf}/documents.parquet").selectExpr("doc_id AS edge_id", "lang", "text AS hypothesis")
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    trusted = [(i,) for i, q in labels.items() if q and i % 2]
    got = quality_model.classify(docs, spark.createDataFrame(trusted, "edge_id bigint")).collect()
    good = [r["kept"] for r in got if labels.get(r["edge_id"]) == 1 and r["edge_id"] % 2 == 0]
    bad = [r["kept"] for r in got if labels.get(r["edge_id"]) == 0]
    assert np.mean(good) > 0.9 and np.mean(bad) < 0.25


def test_null_empty_repeated_and_nothing_trusted(spark):
    rows = [(1, "en", "words here", ""), (1, "en", "words here", ""), (None, "en", "words", ""), (2, None, "words", ""), (3, "en", None, ""), (4, "en", "", "")]
    df = spark.createDataFrame(rows, EDGES)
    got = quality_model.classify(df, df.filter("edge_id = 1 OR edge_id IS NULL").select("edge_id")).collect()
    assert len(got) == 6
    assert {r["edge_id"]: r["perplexity"] is None for r in got} == {1: False, None: False, 2: False, 3: True, 4: True}
    assert not any(r["kept"] for r in got if r["edge_id"] in (3, 4))
    none = quality_model.classify(df, df.filter("false").select("edge_id")).collect()
    assert len(none) == 6 and not any(r["kept"] for r in none)
    assert quality_model.classify(df.filter("false"), df.select("edge_id")).count() == 0


def test_every_language_has_its_own_model_and_threshold(spark):
    words = ["alpha beta gamma delta", "quick brown foxes run", "over lazy dogs again"]
    rows = [(40 * k + i, f"l{k:02d}", chr(97 + k % 26) * (k // 26 + 2) + f" {words[i % 3]} {'xyz'[i % 3] * (i + 1)}", "") for k in range(40) for i in range(6)]
    df = spark.createDataFrame(rows, EDGES)
    got = quality_model.classify(df, df.select("edge_id")).collect()
    limits = {r["lang"]: r["threshold"] for r in got}
    assert len(got) == 240 and len(limits) == 40 and len(set(limits.values())) > 35
    for lang in ("l00", "l39"):
        own = [t for _, of, t, _ in rows if of == lang]
        plain = Plain(own)
        seen = {r["edge_id"]: r["perplexity"] for r in got}
        assert all(seen[i] == pytest.approx(plain.perplexity(t), rel=1e-5) for i, of, t, _ in rows if of == lang)
    models, _ = quality_model.train_languages(df.selectExpr("0 AS fold", "lang", "hypothesis"))
    assert len(models) == 41
