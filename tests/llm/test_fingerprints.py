"""Fingerprints: peeled differences against set differences, edits against slices of strings."""

import re

import pytest

from barline.llm import fingerprints
from tests.llm import brute

VERSIONS = "version_id bigint, changelog string, edited string"


def edits(rows):
    """{id: (edited text, next text)} by descending id."""
    order = sorted(rows, reverse=True)
    out = {}
    for k, (i, text) in enumerate(order):
        after = order[(k + 1) % len(order)][1]
        cut = len(text) // 3
        out[i] = (text[: len(text) - cut] + after[:cut], after)
    return out


def parts(text):
    return {m.rstrip(" ") for m in re.findall(r"(?:[^\x20\x09-\x0D]+[\x20\x09\x0B-\x0D]*){1,16}", text)}


def alike(a, b):
    a, b = parts(a), parts(b)
    return 1 - len(a ^ b) / (len(a) + len(b)) if a or b else 1.0


def test_given_documents_and_odd_texts(spark, documents):
    rows = [*documents.items(), (10_000, ""), (10_001, "ab"), (10_002, "é\n\nü "), (10_003, "one line " * 3000), (10_004, "x\n" * 500)]
    df = spark.createDataFrame([(i, t or None, "clash") for i, t in rows], VERSIONS).repartition(3)
    got = {r["version_id"]: r for r in fingerprints.fingerprints(df).collect()}
    assert len(got) == len(rows)
    by_text, wanted = {}, edits(rows)
    for i, text in rows:
        edited, after = wanted[i]
        r = got[i]
        assert (r["n_chars"], r["edited_sha256"]) == (len(text), brute.sha256(edited))
        assert r["near_edited"] == pytest.approx(alike(text, edited))
        assert r["near_next"] == pytest.approx(alike(text, after))
        assert by_text.setdefault(text, r["fingerprint"]) == r["fingerprint"]
    assert len(set(by_text.values())) == len({frozenset(parts(t)) for t in by_text})


def test_peeling_counts_the_differing_digests(spark):
    pairs = [(1, list(range(0, 60)), list(range(5, 70))), (2, [7, 8], [7, 8]), (3, [1], [])]
    rows = [(i, 1, k) for i, a, _ in pairs for k in a] + [(i, -1, k) for i, _, b in pairs for k in b]
    df = spark.createDataFrame(rows, "i bigint, sign bigint, key bigint")
    large = {r["i"]: (r["differing"], r["left"]) for r in fingerprints.peel(df, ["i"], 96).collect()}
    assert large == {1: (15, 0), 3: (1, 0)}
    small = {r["i"]: r["left"] for r in fingerprints.peel(df, ["i"], 6).collect()}
    assert small[1] > 0 and small[3] == 0  # too small: entangled


def test_recovered_digests_are_the_set_differences(spark):
    own, other = set(range(0, 60)), set(range(5, 70))
    df = spark.createDataFrame([(1, 1, k) for k in own] + [(1, -1, k) for k in other], "i bigint, sign bigint, key bigint")
    got = {(r["sign"], r["digest"]) for r in fingerprints.recover(df, ["i"], 96).collect()}
    assert got == {(1, k) for k in own - other} | {(-1, k) for k in other - own}


def test_differences_of_versions(spark, documents):
    rows = [*list(documents.items())[:60], (20_000, "one line " * 3000), (20_001, ""), (20_002, None)]
    df = spark.createDataFrame([(i, t, "") for i, t in rows], VERSIONS)
    of = {}
    for r in fingerprints.differences(df).collect():
        of.setdefault((r["version_id"], r["pair"]), set()).add((r["sign"], r["digest"]))
    wanted = edits([(i, t or "") for i, t in rows])
    for i, text in rows:
        own = parts(text or "")
        for pair, other in zip(("edited", "next"), map(parts, wanted[i])):
            got = of.get((i, pair), set())
            assert (sum(s == 1 for s, _ in got), sum(s == -1 for s, _ in got)) == (len(own - other), len(other - own))


def test_texts_are_exchanged_once(spark, documents):
    df = spark.createDataFrame([(i, t, "") for i, t in documents.items()], VERSIONS)
    seen, write = [], fingerprints.materialize
    fingerprints.materialize = lambda rows, name: (seen.append((name, rows)), write(rows, name))[1]
    try:
        fingerprints.fingerprints(df)
    finally:
        fingerprints.materialize = write
    rows = dict(seen)["digests"]
    rows.collect()
    plan = rows._jdf.queryExecution().executedPlan().toString()
    final = plan[: plan.index("Initial Plan")] if "Initial Plan" in plan else plan
    assert "ReusedExchange" in final


def test_repeated_single_null_and_no_rows(spark):
    same = spark.createDataFrame([(1, "a b c", ""), (1, "a b c", ""), (None, "d e f", "")], VERSIONS)
    got = fingerprints.fingerprints(same).collect()
    assert sorted((r["version_id"] or 0, r["edited_sha256"]) for r in got) == [
        (0, brute.sha256("d e a")), (1, brute.sha256("a b d")), (1, brute.sha256("a b d"))
    ]
    alone = fingerprints.fingerprints(spark.createDataFrame([(3, "abcdef", "")], VERSIONS)).first()
    assert (alone["edited_sha256"], alone["near_next"]) == (brute.sha256("abcdab"), 1.0)
    assert fingerprints.fingerprints(spark.createDataFrame([], VERSIONS)).count() == 0
