"""The licence scan against a plain one that tries every template on every block."""

import random
import re

import pytest

from barline.llm.licenses import TEMPLATES, Template, scan


def plain(rows, templates=TEMPLATES, block=64, stride=32):
    out = []
    for i, text in rows:
        text = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", text)
        places, base, labels, score = [], set(), set(), 0.0
        for t in templates:
            if t.phrase:
                at = [k for k in range(len(words)) if words[k : k + len(t.words)] == t.words]
                places += at
                if at:
                    base.add(t.label)
                    score = 1.0
                continue
            wanted = set(t.words)
            for b in range(0, max(1, len(words) - block + stride), stride):
                got = len(wanted & set(words[b : b + block]))
                if 100 * got >= t.percent * len(wanted):
                    labels.add(t.label)
                    score = max(score, got / len(wanted))
        ends = (min(places), max(places)) if places else (None, None)
        out.append((i, len(words), len(places), *ends, ",".join(sorted(base)), ",".join(sorted(base | labels)), score))
    return sorted(out, key=repr)


def scanned(spark, rows, **how):
    df = spark.createDataFrame(rows, "output_id bigint, content string")
    return sorted((tuple(r) for r in scan(df, **how).collect()), key=repr)


def test_all_given_documents(spark, documents):
    rows = list(documents.items())
    got = scanned(spark, rows)
    assert got == plain(rows) and any(r[2] for r in got)


def test_random_texts_that_nearly_meet_their_templates(spark):
    rng = random.Random(3)
    templates = [Template("ab", "a b", phrase=True), Template("aa", "a a", phrase=True)] + [
        Template(f"t{k}", " ".join(rng.choices("abcdefgh", k=rng.randint(2, 5))), percent=rng.choice([50, 75, 100])) for k in range(6)
    ]
    rows = [(k, " ".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=rng.choice([0, 3, 9, 40, 90])))) for k in range(300)]
    got = scanned(spark, rows, templates=templates, block_words=8, stride=4)
    assert got == plain(rows, templates, 8, 4)
    assert len({r[6] for r in got}) > 20


def test_nulls_empty_repeated_and_very_long_texts(spark):
    notice = "Licensed under CC BY-NC 4.0."
    rows = [
        (None, notice),
        (1, None),
        (2, ""),
        (3, "MIT\nlicense"),
        (3, "MIT\nlicense"),
        (4, "İ LICENSE MIT"),
        (5, "filler " * 31 + "GNU General Public License" + " filler" * 200_000 + " apache license. CC, by"),
        (6, "ccby c-c by"),
    ]
    got = scanned(spark, rows)
    assert got == plain(rows)
    by = {r[0]: r for r in got}
    assert by[5][2:5] == (3, 31, 200_037) and by[5][6] == "apache,cc-by,gpl"
    assert by[None][5:] == ("cc-by", "cc-by,cc-by-nc", 1.0) and sum(r[0] == 3 for r in got) == 2


def test_no_rows_no_templates_and_other_columns(spark):
    df = spark.createDataFrame([("x", "the mit license", 1, [1], True)], "output_id string, content string, _row int, _ranks array<int>, labels boolean")
    assert tuple(scan(df).collect()[0]) == ("x", 3, 1, 1, 1, "mit", "mit", 1.0)
    assert scan(df.filter("false")).collect() == []
    assert tuple(scan(df, templates=[]).collect()[0])[1:] == (3, 0, None, None, "", "", 0.0)


def test_a_template_that_no_block_holds_whole_is_refused(spark):
    with pytest.raises(ValueError):
        scan(spark.createDataFrame([(1, "x")], "output_id bigint, content string"), [Template("x", "w " * 40)])
