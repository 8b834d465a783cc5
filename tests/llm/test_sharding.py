"""Shards against their law."""

import zlib

import numpy as np

from barline.llm import sharding

EVENTS = "event_id bigint, payload string, slot string"


def check(rows, got, shards, slack):
    assert len(got) == len(rows)
    by = {}
    for r in got:
        by.setdefault(r["shard"], []).append(r)
    assert set(by) <= set(range(shards))
    for part in by.values():
        assert sorted(r["slot"] for r in part) == list(range(len(part)))
    sizes = [sum(r["size"] for r in by.get(k, ())) for k in range(shards)]
    assert max(sizes) - min(sizes) <= slack, sizes
    assert sum(sizes) == sum(len((t or "").encode()) + 1 for _, t in rows)


def test_given_documents_and_equal_payloads(spark, documents):
    rows = list(documents.items()) + [(10_000 + k, "the same text in many events") for k in range(300)] + [(None, None)]
    df = spark.createDataFrame([(i, t, "clash") for i, t in rows], EVENTS)
    got = sharding.shard(df).collect()
    total = sum(r["size"] for r in got)
    check(rows, got, 8, 2 * max(r["size"] for r in got) + total / 8 / 50)
    assert {(r["event_id"], r["payload_crc32"]) for r in got} == {(i, zlib.crc32((t or "").encode())) for i, t in rows}
    # in key order: a payload's shards are neighbours
    places = {}
    for r in got:
        places.setdefault(r["payload_crc32"], set()).add(r["shard"])
    assert all(max(p) - min(p) == len(p) - 1 for p in places.values())


def test_one_group_that_fills_several_shards(spark):
    rows = [(k, "x" * 99) for k in range(4000)] + [(k, str(k)) for k in range(4000, 4100)]
    got = sharding.shard(spark.createDataFrame([(i, t, "") for i, t in rows], EVENTS).repartition(3)).collect()
    check(rows, got, 8, 600)


def test_few_repeated_and_no_rows(spark):
    rows = [(1, "a"), (1, "a"), (2, None), (3, "long " * 100_000)]
    got = sharding.shard(spark.createDataFrame([(i, t, "") for i, t in rows], EVENTS)).collect()
    check(rows, got, 8, 600_000)
    assert sharding.shard(spark.createDataFrame([], EVENTS)).count() == 0


def test_boundaries_reach_the_tolerance(spark):
    rng = np.random.default_rng(0)
    keys = rng.integers(0, 2**20, 20_000) << 31  # clustered in the lowest part of the key space
    df = spark.createDataFrame([(int(k), int(n)) for k, n in zip(keys, rng.integers(1, 100, 20_000))], "key bigint, size bigint")
    cuts = sharding.boundaries(df, 5)
    sizes = np.array([r["size"] for r in df.collect()])
    below = [sizes[keys < c].sum() for c in cuts]
    assert np.abs(np.diff([0, *below, sizes.sum()]) - sizes.sum() / 5).max() <= sizes.sum() / 5 / 200
