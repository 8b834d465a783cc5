"""Mixes against their law; the SQL twin is compared by the catalogue test."""

from collections import defaultdict

import numpy as np
import pytest

from barline.llm import mixing, order
from pyspark.sql import functions as F

EDGES = "edge_id bigint, category string, hypothesis string, size string"


def water_level(sizes):
    """Targets of (source -> words), weights 1, 2, 3 in order."""
    names = sorted(sizes, key=lambda s: (s is None, s.encode() if s is not None else b""))
    weight = {s: k % 3 + 1 for k, s in enumerate(names)}
    total, capped = sum(sizes.values()), set()
    while True:
        free = [s for s in names if s not in capped]
        rest = total - sum(3 * sizes[s] for s in capped)
        above = {s for s in free if rest * weight[s] / sum(weight[x] for x in free) > 3 * sizes[s]}
        if not above:
            return {s: 3 * sizes[s] if s in capped else rest * weight[s] / sum(weight[x] for x in free) for s in names}
        capped |= above


@pytest.mark.parametrize("seed", [0, 1])
def test_mix_meets_its_targets(spark, seed):
    rng = np.random.default_rng(seed)
    names = ["b", "a", "é", "Z", None, "", "aa"]
    rows = [(i, names[int(rng.integers(7)) if i % 3 else 0], "w " * int(rng.integers(0, 30)), "clash") for i in range(1500)]
    rows += [(5000, "one", "w " * 40, ""), (5001, "none", "", ""), (5002, "none", None, ""), (None, "b", "w w", ""), (7, "b", "w w", "")]
    df = spark.createDataFrame(rows, EDGES)
    got = mixing.mix(df).collect()
    assert sorted(map(str, got)) == sorted(map(str, mixing.mix(df.repartition(5)).collect()))
    sizes, taken = defaultdict(int), defaultdict(int)
    for r in got:
        sizes[r["category"]] += r["size"]
        taken[r["category"]] += r["taken"]
        assert r["taken"] == r["copies"] * r["size"] and 0 <= r["copies"] <= 3
    targets = water_level(sizes)
    for r in got:
        assert r["source_size"] == sizes[r["category"]]
        assert r["target"] == pytest.approx(targets[r["category"]])
    for s, target in targets.items():
        assert abs(taken[s] - target) <= 45, s
    assert 0 <= sum(sizes.values()) - sum(taken.values()) <= 40
    assert len(got) == len(rows)


def test_empty_tables_and_tables_without_words(spark):
    assert mixing.mix(spark.createDataFrame([], EDGES)).count() == 0
    rows = mixing.mix(spark.createDataFrame([(1, "a", "", ""), (2, None, None, "")], EDGES)).collect()
    assert [(r["target"], r["taken"]) for r in rows] == [(0.0, 0), (0.0, 0)]


def test_running_sums_and_numbers_over_many_buckets(spark):
    df = spark.range(5000).select((F.col("id") % 3).alias("k"), F.col("id").alias("v"))
    got = order.running_sum(df, ["k"], F.floor(F.col("v") / 2), [F.col("v")], "v", "total").collect()
    assert all(r["total"] == sum(range(r["k"], r["v"] + 1, 3)) for r in got[::97])
    numbered = order.global_index(df.withColumn("g", F.floor(F.col("v") / 1300)), [F.col("v")], "n", within=["g"])
    assert all(r["n"] == r["v"] - 1300 * r["g"] for r in numbered.collect())
