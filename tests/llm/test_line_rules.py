"""Line rules on given and hand-made texts; the SQL twin is compared by the catalogue test."""

from barline.llm import line_rules

EDGES = "edge_id bigint, rationale string, n_words string"
GOOD = "This line ends as lines of prose do, with a stop."
MORE = "Another one follows it here. It says nothing that was said before."


def judged(spark, texts, **how):
    df = spark.createDataFrame([(i, t, "clash") for i, t in enumerate(texts)], EDGES)
    return [r.asDict() for r in line_rules.clean_lines(df, **how).orderBy("edge_id").collect()]


def test_every_rule_takes_its_lines(spark):
    bad = {
        "punctuation": "home about contact news and other links here",
        "symbols": "Buy## now** at%% once## or** lose.",
        "navigation": "Home | About | Contact. » News.",
        "shouting": "READ THIS NOW AND DO NOT WAIT. Yes.",
        "boilerplate": "All rights reserved by the owner of this page.",
    }
    rows = judged(spark, [f"{GOOD}\n{line}\n{MORE}" for line in bad.values()])
    for (rule, line), row in zip(bad.items(), rows):
        assert row[f"lost_{rule}"] == len(line.split()), rule
        assert sum(row[f"lost_{r}"] for r in line_rules.RULES) == row[f"lost_{rule}"]
        assert row["cleaned"] == f"{GOOD}\n{MORE}" and row["kept"]


def test_texts_that_lose_too_much_go(spark):
    nav = "home about contact news other pages and more of it"
    kept, gone = judged(spark, [f"{GOOD}\n{MORE}\n{nav}", f"{GOOD}\n{nav}\nstill other words that end without any mark"])
    assert kept["kept"] and not gone["kept"] and not gone["base_failed"]


def test_base_counts(spark):
    repeat = "a b c d e " * 4
    row, dup, spaced = judged(spark, [repeat, f"{GOOD}\n{GOOD}\n\n\n{GOOD} ", "é#\t*ü\x0b&$ x"])
    assert (row["n_words"], row["n_repeat_words"], row["base_failed"]) == (20, 20, True)
    assert dup["n_dup_lines"] == 1
    assert (spaced["word_chars"], spaced["n_symbols"], spaced["n_words"]) == (7, 4, 4)


def test_null_empty_long_repeated_and_carried(spark):
    long = " ".join(f"w{k}." for k in range(200_000))
    df = spark.createDataFrame(
        [(None, None, None), (1, "", "x"), (1, "", "x"), (2, long, "y")], "edge_id bigint, rationale string, lang string"
    )
    rows = line_rules.clean_lines(df, carry=("lang",)).collect()
    assert [(r["edge_id"], r["n_words"], r["kept"], r["cleaned"], r["lang"]) for r in rows] == [
        (None, 0, False, None, None),
        (1, 0, False, "", "x"),
        (1, 0, False, "", "x"),
        (2, 200_000, True, long, "y"),
    ]


def test_empty_table(spark):
    assert line_rules.clean_lines(spark.createDataFrame([], EDGES)).count() == 0
