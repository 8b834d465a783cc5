"""Held-out accuracy of texts, and what each kind of evidence adds."""

import numpy as np

from barline.llm import language_id

CAPTURES = "event_id bigint, url string, payload string, lang string"


def halves(spark, sf="/root/testdata/sf0.01"):
    docs = spark.read.parquet(f"{sf}/documents.parquet").selectExpr("doc_id AS event_id", "lang", "text AS hypothesis")
    return docs.filter("event_id % 2 = 0"), docs.filter("event_id % 2 = 1")


def test_held_out_texts_and_pages(spark):
    train, test = halves(spark)
    models = language_id.train(train)
    assert sorted(models) == ["de", "en", "es", "fr"]
    got = language_id.identify(
        test.selectExpr("event_id", "CAST(NULL AS STRING) AS url", "hypothesis AS payload", "lang AS truth"), models, carry=("truth",)
    ).collect()
    assert np.mean([r["lang"] == r["truth"] for r in got]) > 0.98
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet").selectExpr("page_id AS event_id", "url", "html AS payload")
    rows = language_id.identify(pages, models).collect()
    assert len(rows) == 250 and np.mean([r["lang"] == r["declared"] for r in rows]) > 0.98


def test_evidence_beside_the_text(spark):
    train, test = halves(spark)
    models = language_id.train(train)
    german = [r["hypothesis"] for r in test.filter("lang = 'de'").limit(30).collect()]
    english = [r["hypothesis"] for r in test.filter("lang = 'en'").limit(30).collect()]
    page = '<html lang="{}"><body>{}</body></html>'
    rows = [(i, f"http://www.de{i % 3}.example.de/{i}", page.format("de-AT", t)) for i, t in enumerate(german)]
    rows += [(100 + i, f"http://www.en{i % 3}.example.uk/{i}", page.format("en", t)) for i, t in enumerate(english)]
    rows += [
        (200, "http://www.de1.example.de/x", page.format("de", "1234")),  # no letters: declared language, suffix, host
        (201, "http://www.new.example.uk/x", "1 2 3"),  # suffix and domain alone
        (202, None, page.format("en", "<script>der die das</script>...")),
        (203, "not an address", "<!-- only a comment"),
        (204, "http://www.en1.example.uk/y", page.format("en", german[0])),  # a long text wins
    ]
    got = {r["event_id"]: r for r in language_id.identify(spark.createDataFrame([(*r, "clash") for r in rows], CAPTURES), models).collect()}
    assert [got[k]["lang"] for k in (200, 201, 202, 204)] == ["de", "en", "en", "de"]
    assert [got[k]["text_lang"] for k in (200, 201, 202, 203)] == [None] * 4
    assert got[0]["declared"] == "de" and got[0]["suffix"] == "de" and got[203]["suffix"] is None
    assert all(0.25 <= r["confidence"] <= 1 for r in got.values())


def test_null_repeated_long_and_no_rows(spark):
    models = language_id.train(spark.createDataFrame([("en-GB", "the and of"), ("FR", "le la les"), (None, "x"), ("?", "y"), ("de", None)], "lang string, hypothesis string"))
    assert sorted(models) == ["en", "fr"]  # a language without letters gives no model
    rows = [(1, None, None, ""), (1, None, None, ""), (None, "http://h/", "the of " * 300_000, ""), (2, "", "", "")]
    df = spark.createDataFrame(rows, CAPTURES)
    got = language_id.identify(df, models).collect()
    assert len(got) == 4 and [r["lang"] for r in got if r["event_id"] is None] == ["en"]
    assert language_id.identify(df.filter("false"), models).count() == 0
    assert [r["lang"] for r in language_id.identify(df, {}).collect()] == [None] * 4
