"""Scans, overlap and correlation against plain versions."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from barline.operators import research
from barline.operators.series import add_windowed


@pytest.mark.parametrize("stripe, cells", [(1 << 22, 1 << 24), (500, 2000)])
@pytest.mark.parametrize("least", [0.0, 0.2])
@pytest.mark.parametrize("pair_cost", [0, 1 << 40])
def test_overlap_of_many_rules(spark, monkeypatch, stripe, cells, least, pair_cost):
    monkeypatch.setattr(research, "_PAIR_COST", pair_cost)
    monkeypatch.setattr(research, "_STRIPE", stripe)
    monkeypatch.setattr(research, "_CELLS", cells)
    rng = np.random.default_rng(1)
    held = {r: set(rng.integers(0, 200, rng.integers(1, 60)).tolist()) for r in range(90)}
    held[90] = {999}
    rows = [(f"r{r:02d}", b) for r, bars in held.items() for b in bars]
    rows += rows[:20] + [(None, 1), ("r00", None)]
    got = research.rule_overlap(spark.createDataFrame(rows, "rule_id string, bar bigint"), min_jaccard=least).collect()
    want = {}
    for a in held:
        for b in held:
            both = len(held[a] & held[b])
            if a < b and both and both / len(held[a] | held[b]) >= least:
                want[(f"r{a:02d}", f"r{b:02d}")] = (both, both / len(held[a] | held[b]))
    assert {(r.rule_a, r.rule_b): (r.both, r.jaccard) for r in got} == want


def test_overlap_of_ten_thousand_rules(spark):
    fires = spark.range(60_000).select((F.col("id") % 10_000).alias("rule_id"), F.floor(F.col("id") / 12).alias("bar"))
    got = research.rule_overlap(fires)
    # every bar has 12 rules in a row, six times with the same neighbours or shifted ones
    bars = {}
    for k in range(60_000):
        bars.setdefault(k // 12, set()).add(k % 10_000)
    pairs = {(a, b) for held in bars.values() for a in held for b in held if a < b}
    assert got.count() == len(pairs)


def test_no_fires_no_pairs(spark):
    none = spark.createDataFrame([], "rule_id string, bar bigint, dt bigint, ret double")
    assert research.rule_overlap(none).collect() == [] and research.return_correlations(none).collect() == []


@pytest.mark.parametrize("cells", [1 << 24, 300])
@pytest.mark.parametrize("pair_cost", [0, 1 << 40])
def test_correlations_of_common_days(spark, monkeypatch, cells, pair_cost):
    monkeypatch.setattr(research, "_PAIR_COST", pair_cost)
    monkeypatch.setattr(research, "_CELLS", cells)
    rng = np.random.default_rng(2)
    base = rng.normal(size=120)
    series = {f"r{k}": {d: 1e6 + base[d] * k + rng.normal() for d in range(120) if rng.random() < 0.6} for k in range(8)}
    series["flat"] = {d: 2.0 for d in range(50)}
    rows = [(r, d, float(v)) for r, s in series.items() for d, v in s.items()] + [("r0", 500, None)]
    got = research.return_correlations(spark.createDataFrame(rows, "rule_id string, dt bigint, ret double")).collect()
    assert len(got) == 9 * 8 // 2
    for r in got:
        days = sorted(series[r.rule_a].keys() & series[r.rule_b].keys())
        x, y = ([series[k][d] for d in days] for k in (r.rule_a, r.rule_b))
        if "flat" in (r.rule_a, r.rule_b):
            assert r.return_corr is None
        else:
            assert r.return_corr == pytest.approx(np.corrcoef(x, y)[0, 1], abs=1e-9)


@pytest.mark.parametrize("size", [20, 50, 100_000])
@pytest.mark.parametrize("lags", [1, 13])
def test_newey_west_with_a_large_mean(spark, size, lags):
    rng = np.random.default_rng(3)
    series = {"a": 1e7 + rng.normal(size=150), None: np.cumsum(rng.normal(size=90)), "one": np.array([2.0])}
    rows = [(g, k, float(v) if (g, k) != ("a", 40) else None) for g, s in series.items() for k, v in enumerate(s)]
    df = spark.createDataFrame(rows, "g string, seq bigint, y double")
    got = {r.g: r for r in research.newey_west(df, ["g"], "y", lags, size=max(size, lags)).collect()}
    for g, s in series.items():
        d = np.array([v for v in s], float)
        known = np.ones(len(d), bool)
        if g == "a":
            known[40] = False
        n, mean = known.sum(), d[known].mean()
        d = np.where(known, d - mean, 0.0)
        var = (d @ d) / n + 2 * sum((1 - k / (lags + 1)) * (d[:-k] @ d[k:]) / n for k in range(1, min(lags, len(d) - 1) + 1))
        assert (got[g].n, got[g].mean) == (n, pytest.approx(mean))
        assert got[g].t_nw is None if var <= 0 else got[g].t_nw == pytest.approx(mean / np.sqrt(var / n), rel=1e-6)


@pytest.mark.parametrize("w", [5, 100])
@pytest.mark.parametrize("size", [130, 10_000])
def test_divergence_is_the_residual_of_a_rolling_regression(spark, w, size):
    rng = np.random.default_rng(4)
    a, b = rng.normal(size=400) + 1e5, rng.normal(size=400) * 3 + 50
    rows = [("k", p, float(a[p]), float(b[p]) if p != 250 else None) for p in range(400)]
    df = spark.createDataFrame(rows, "k string, pos bigint, a double, b double")
    got = add_windowed(df, ["k"], lambda f: {"x": research.divergence(f, "a", "b", w)}, before=w, size=size)
    for r in got.collect():
        part = slice(r.pos - w + 1, r.pos + 1)
        if r.pos < w - 1 or r.pos - w < 250 <= r.pos:
            assert r.x is None
        else:
            slope = np.cov(a[part], b[part], bias=True)[0, 1] / b[part].var()
            assert r.x == pytest.approx(a[r.pos] - a[part].mean() - slope * (b[r.pos] - b[part].mean()), abs=1e-6)


@pytest.mark.parametrize("piece_values", [3, 50, 1 << 18])
def test_quantiles_and_ranks_with_many_equal_values(spark, piece_values):
    rng = np.random.default_rng(4)
    x = np.where(rng.random(3000) < 0.9, 0.0, rng.integers(-40, 40, 3000) / 8.0)
    rows = [("a", float(v)) for v in x] + [("b", 2.0), ("b", None), ("c", None), (None, 1.0), (None, 4.0)]
    df = spark.createDataFrame(rows, "k string, v double")
    qs = [0.0, 0.03, 0.5, 0.97, 1.0]
    got = {(r.k, r.q): r.quantile for r in research.exact_quantiles(df, ["k"], "v", qs, piece_values).collect()}
    for q in qs:
        assert got.pop(("a", q)) == pytest.approx(np.quantile(x, q))
        assert got.pop(("b", q)) == 2.0
        assert got.pop((None, q)) == pytest.approx(1.0 + 3 * q)
    assert not got  # a key without values has no quantile
    places = research.value_places(df, ["k"], "v", piece_values).filter("k = 'a'").collect()
    assert sorted((r.v, r._cnt, r._upto) for r in places) == [(v, int((x == v).sum()), int((x <= v).sum())) for v in np.unique(x)]


def test_equal_values_are_one_row_of_a_piece(spark):
    """A column that is mostly zero has as many rows to sort as it has distinct values."""
    df = spark.range(20_000).select(F.lit("a").alias("k"), F.when(F.col("id") % 10 == 0, F.col("id")).otherwise(0).cast("double").alias("v"))
    counts = df.groupBy("k", "v").agg(F.count(F.lit(1)).alias("_cnt"))
    sizes = [r["count"] for r in research.with_value_piece(counts, ["k"], "v", 100).groupBy("_piece").count().collect()]
    assert sum(sizes) == 2000 and max(sizes) <= 200


@pytest.mark.parametrize("piece_values", [2, 1 << 18])
def test_benjamini_hochberg_with_ties_and_missing_p(spark, piece_values):
    rng = np.random.default_rng(5)
    rows = [(b, i, float(p)) for b in ("a", None) for i, p in enumerate(rng.integers(0, 30, 200) / 40.0)]
    rows += [("a", 900, None), ("z", 901, None)]
    df = spark.createDataFrame(rows, "batch string, id bigint, p_value double")
    got = {(r.batch, r.id): r.q_value for r in research.benjamini_hochberg(df, ["batch"], piece_values=piece_values).collect()}
    assert got.pop(("a", 900)) is None and got.pop(("z", 901)) is None
    for b in ("a", None):
        p = sorted((x, i) for k, i, x in rows if k == b and x is not None)
        least = 1.0
        for rank in range(len(p), 0, -1):
            least = min(least, p[rank - 1][0] * len(p) / rank)
            assert got.pop((b, p[rank - 1][1])) == pytest.approx(least)
    assert not got


def test_quantiles_of_nothing(spark):
    df = spark.createDataFrame([], "k string, v double")
    assert research.exact_quantiles(df, ["k"], "v", [0.5]).count() == 0
    assert research.benjamini_hochberg(df.withColumnRenamed("v", "p_value"), ["k"]).count() == 0


@pytest.mark.parametrize("fires, rules", [(25, 7), (40, 1 << 16), (1 << 21, 3)])
def test_pairs_of_blocks_of_rules(spark, monkeypatch, fires, rules):
    """Rules in blocks, and bars too where a rule has more rows than a block: every pair once, with all its bars."""
    monkeypatch.setattr(research, "BLOCK_FIRES", fires)
    monkeypatch.setattr(research, "BLOCK_RULES", rules)
    rng = np.random.default_rng(5)
    held = {f"r{r:02d}": {d: float(rng.normal()) for d in rng.integers(0, 150, rng.integers(2, 90))} for r in range(25)}
    df = spark.createDataFrame([(r, int(d), v) for r, s in held.items() for d, v in s.items()], "rule_id string, dt bigint, ret double")
    overlap = research.rule_overlap(df, "dt", 0.1)
    jaccard = {(a, b): len(held[a].keys() & held[b].keys()) / len(held[a].keys() | held[b].keys()) for a in held for b in held if a < b}
    assert {(r.rule_a, r.rule_b): r.jaccard for r in overlap.collect()} == {k: v for k, v in jaccard.items() if v >= 0.1}
    days = {(a, b): sorted(held[a].keys() & held[b].keys()) for a, b in jaccard}
    got = {(r.rule_a, r.rule_b): r.return_corr for r in research.return_correlations(df, min_days=5).collect()}
    assert got.keys() == {k for k, d in days.items() if len(d) >= 5}
    for (a, b), d in days.items():
        if len(d) >= 5:
            assert got[a, b] == pytest.approx(np.corrcoef([held[a][x] for x in d], [held[b][x] for x in d])[0, 1], abs=1e-9)
    # sums of pairs are shuffled only where bars are dealt
    plan = overlap._jdf.queryExecution().executedPlan().toString()
    assert plan.index("FlatMapGroupsInArrow") < plan.index("Exchange") or fires < 90


@pytest.mark.parametrize("table, added", [(1 << 22, 1 << 16), (1, 1), (900, 40)])
@pytest.mark.parametrize("least", [0.0, 0.15])
def test_bits_that_are_added_up(spark, monkeypatch, table, added, least):
    """Counts of shared bars digit by digit, of rules with one bar up to over 255, in several tables."""
    for name, value in (("_COUNT_BIT", 0), ("_COUNT_RULE", 0), ("_TABLE", table), ("_ADDED", added)):
        monkeypatch.setattr(research, name, value)
    monkeypatch.setattr(research, "_pair_sums", None)
    monkeypatch.setattr(research, "_pair_counts", None)
    rng = np.random.default_rng(6)
    held = {r: set(rng.integers(0, 700, n).tolist()) for r, n in enumerate([1, 1, 2, 3, *rng.integers(1, 90, 140), 400, 900, 900])}
    rows = [(r, b) for r, bars in held.items() for b in bars]
    got = research.rule_overlap(spark.createDataFrame(rows, "rule_id int, bar bigint").repartition(3), min_jaccard=least).collect()
    want = {(a, b): (len(held[a] & held[b]), len(held[a] & held[b]) / len(held[a] | held[b])) for a in held for b in held if a < b}
    assert {(r.rule_a, r.rule_b): (r.both, r.jaccard) for r in got} == {k: v for k, v in want.items() if v[0] and v[1] >= least}


@pytest.mark.parametrize("fires, rules", [(25, 7), (400, 4), (1 << 21, 3)])
def test_blocks_that_are_kept_and_read_where_they_meet(spark, monkeypatch, fires, rules):
    """Blocks of many rules are not shuffled once for every other block; every pair comes once all the same."""
    monkeypatch.setattr(research, "_DEALT_ROWS", 0)
    monkeypatch.setattr(research, "BLOCK_FIRES", fires)
    monkeypatch.setattr(research, "BLOCK_RULES", rules)
    rng = np.random.default_rng(7)
    held = {f"r{r:02d}": {d: float(rng.normal()) for d in rng.integers(0, 150, rng.integers(2, 90))} for r in range(25)}
    df = spark.createDataFrame([(r, int(d), v) for r, s in held.items() for d, v in s.items()], "rule_id string, dt bigint, ret double")
    days = {(a, b): sorted(held[a].keys() & held[b].keys()) for a in held for b in held if a < b}
    overlap = research.rule_overlap(df, "dt", 0.1)
    got, want = overlap.collect(), {(a, b): len(d) / len(held[a].keys() | held[b].keys()) for (a, b), d in days.items()}
    want = {k: v for k, v in want.items() if v >= 0.1}
    assert len(got) == len(want) and {(r.rule_a, r.rule_b): r.jaccard for r in got} == want
    plan = overlap._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" in plan and ("Exchange" not in plan or fires < 90)
    got = research.return_correlations(df, min_days=5).collect()
    assert len(got) == sum(len(d) >= 5 for d in days.values())
    for r in got:
        x, y = ([held[k][d] for d in days[r.rule_a, r.rule_b]] for k in (r.rule_a, r.rule_b))
        assert r.return_corr == pytest.approx(np.corrcoef(x, y)[0, 1], abs=1e-9)


def test_rounding_of_many_rows_is_the_same(spark):
    from barline.plans.catalog.base import rnd, rnd_many

    rng = np.random.default_rng(8)
    x = [*rng.normal(size=3000), *(rng.integers(-9999, 9999, 3000) / 2.0**10), *(rng.integers(-999, 999, 999) / 200000.0)]
    x += [*(rng.normal(size=300) * 1e12), *(rng.normal(size=300) * 1e-9), 0.0, -0.0, float("nan"), float("inf"), float("-inf"), None, 1e308]
    df = spark.createDataFrame([(None if v is None else float(v),) for v in x], "x double")
    for digits in (5, 6):
        assert df.filter(~rnd_many("x", digits).eqNullSafe(rnd("x", digits))).collect() == []


@pytest.mark.parametrize("size, sketch", [(13, 3), (40, 10_000), (1000, 5)])
def test_scan_of_blocks(spark, monkeypatch, size, sketch):
    """Tests summed up by blocks of bars against the hits one by one; cuts from values near their estimates."""
    rng = np.random.default_rng(11)
    x = {None: rng.normal(size=70), "b": np.round(rng.normal(size=400), 1)}
    y = {k: rng.normal(3, 1, len(v)).cumsum() / 9 for k, v in x.items()}
    rows = [(k, i, float(v) if i % 7 else None, float(y[k][i]) if i % 11 else None) for k in x for i, v in enumerate(x[k])]
    df = spark.createDataFrame(rows, "k string, pos bigint, f double, y double")
    cuts = {(r.k, r.q): r.quantile for r in research.column_quantiles(df, ["k"], ["f"], [0.1, 0.25, 0.75, 0.9], sketch).collect()}
    got = {(r.k, r.q): r for r in research.conditional_scan(df, ["k"], ["f"], {"y": 5}, 1, size).collect()}
    assert len(got) == len(cuts) == 8
    for (k, q), cut in cuts.items():
        assert cut == pytest.approx(np.quantile([f for g, _, f, _ in rows if g == k and f is not None], q))
        d = np.array([v for g, _, f, v in rows if g == k and f is not None and v is not None and (f < cut if q < 0.5 else f > cut)])
        e, n = d - d.mean(), len(d)
        var = (e @ e) / n + 2 * sum((1 - j / 6) * (e[:-j] @ e[j:]) / n for j in range(1, min(5, n - 1) + 1))
        assert (got[k, q].n, got[k, q].mean) == (n, pytest.approx(d.mean()))
        assert got[k, q].t_nw == pytest.approx(d.mean() / np.sqrt(var / n), rel=1e-6)


@pytest.mark.parametrize("pieces, deal, bits, side", [(1 << 18, 1 << 17, 16, 16), (37, 50, 4, 16), (100, 1 << 17, 16, 1), (20, 1 << 17, 3, 2)])
def test_rank_correlations_of_pieces_and_blocks(spark, monkeypatch, pieces, deal, bits, side):
    """Columns ranked once for all partners, with missing values, ties, a value of many rows and rows without a key."""
    for name, v in (("_DEAL_ROWS", deal), ("_BLOCK_BITS", bits), ("_SIDE_COLUMNS", side)):
        monkeypatch.setattr(research, name, v)
    rng = np.random.default_rng(12)
    n = 900
    f = rng.normal(size=n)
    data = {
        "k": rng.choice(["a", "b", "c", None], n, p=[0.7, 0.2, 0.05, 0.05]),
        "f1": f,
        "f2": np.where(rng.random(n) < 0.8, 0.0, np.round(f, 1)),
        "f3": np.where(rng.random(n) < 0.3, np.nan, np.round(f, 1)),
        "f4": np.full(n, 3.0),
        "y1": np.where(rng.random(n) < 0.1, np.nan, f + rng.normal(size=n)),
        "y2": np.where(np.arange(n) < 850, np.round(rng.normal(size=n), 2), np.nan),
        "y3": np.full(n, np.nan),
    }
    pdf = pd.DataFrame(data)
    df = spark.createDataFrame([tuple(None if x != x else x for x in r) for r in pdf.itertuples(index=False)], "k string, f1 double, f2 double, f3 double, f4 double, y1 double, y2 double, y3 double")
    df = df.withColumn("pos", F.monotonically_increasing_id()).repartition(3)
    features, labels = ["f1", "f2", "f3", "f4"], ["y1", "y2", "y3"]
    got = {(r.k, r.feature, r.horizon): r for r in research.feature_horizon_stats(df, ["k"], features, labels, 100, pieces).collect()}
    for k in "abc":
        for x in features:
            for y in labels:
                part = pdf[(pdf.k == k) & pdf[x].notna() & pdf[y].notna()]
                if not len(part):
                    assert (k, x, y) not in got
                    continue
                r, rx, ry = got.pop((k, x, y)), part[x].rank(), part[y].rank()
                assert (r.n, r.enough) == (len(part), len(part) >= 100)
                assert r.spearman_ic is None if x == "f4" else r.spearman_ic == pytest.approx(np.corrcoef(rx, ry)[0, 1], abs=1e-9)
                fifth = np.ceil(rx * 5 / len(part))
                spread = part[y][fifth == 5].mean() - part[y][fifth == 1].mean()
                assert r.q5_q1_spread_bps is None if spread != spread else r.q5_q1_spread_bps == pytest.approx(spread, abs=1e-9)
    assert not got


def test_values_are_ranked_once_for_all_partners(spark):
    """Rows that are shuffled for ranks are parts of pieces, not one for every row, feature and label."""
    df = spark.range(5000).selectExpr("'a' AS k", "id AS pos", "id * 7 % 997 AS f", "id % 11 AS g", "id * 13 % 101 AS y", "id % 7 AS z")
    values = research._dealt_values(df.selectExpr("1L AS _g", "pos AS _id", "f", "g", "y", "z").coalesce(1), ["f", "g", "y", "z"], [0, 0, 1, 1], {})
    assert sorted(r._col for r in values.collect()) == [0, 1, 2, 3]
    assert research.feature_horizon_stats(df, ["k"], ["f", "g"], ["y", "z"]).count() == 4
    assert research.feature_horizon_stats(df.limit(0), ["k"], ["f", "g"], ["y", "z"]).count() == 0


def test_feature_blocks_get_tasks_in_proportion(spark, monkeypatch):
    from barline.operators import features

    monkeypatch.setattr(features, "BLOCK_ROWS", 10)
    df = spark.range(1000).selectExpr("'a' AS k", "id AS pos", "id AS ts", "100.0 + id % 7 AS close")
    tasks = features.block_tasks(df)
    assert tasks == 404
    some = features.compute_features(df, ["k"], ["ret_24h"], size=200, tasks=tasks)
    assert f"{tasks})" in some._jdf.queryExecution().executedPlan().toString()
    assert some.count() == 1000
