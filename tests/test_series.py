"""Ordered-series toolkit: cutting keys into pieces changes no result."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from barline.operators import asof
from barline.operators import features as ft
from barline.operators.asof import asof_join
from barline.operators.series import (
    HOUR_MS,
    add_windowed,
    blocks,
    index_rows,
    latest,
    running,
    suggest_bucket_ms,
    time_bucket,
)


@pytest.fixture(scope="module")
def skewed(spark):
    """One key with most of the rows, irregular times, some nulls."""
    rng = np.random.default_rng(5)
    n = 3000
    key = np.where(rng.random(n) < 0.7, "hot", np.where(rng.random(n) < 0.5, "a", "b"))
    pdf = pd.DataFrame({"k": key, "ts": np.cumsum(rng.integers(1, 40, n)) * 60_000, "id": np.arange(n)})
    pdf["x"] = rng.normal(size=n).round(3)
    pdf["maybe"] = np.where(rng.random(n) < 0.8, pdf.x, np.nan)
    df = spark.createDataFrame(pdf).withColumn("maybe", F.when(~F.isnan("maybe"), F.col("maybe")))
    return df.cache()


def test_index_rows_equals_row_number(skewed):
    got = index_rows(skewed, ["k"], "ts", time_bucket("ts", 6 * HOUR_MS))
    want = skewed.withColumn("want", F.row_number().over(W.partitionBy("k").orderBy("ts")) - 1)
    assert got.join(want.select("id", "want"), "id").filter("pos <> want").count() == 0
    assert got.count() == skewed.count()


@pytest.mark.parametrize("size", [7, 50, 100_000])
def test_windows_do_not_depend_on_block_size(skewed, size):
    ix = index_rows(skewed, ["k"], "ts", time_bucket("ts", 6 * HOUR_MS))
    got = add_windowed(
        ix,
        ["k"],
        lambda f: {"lg": f.lag("x", 3), "ld": f.lead("x", 2), "mean": f.full(F.avg("maybe"), "maybe", 5)},
        before=5,
        after=2,
        size=size,
    )
    w = W.partitionBy("k").orderBy("ts")
    r = w.rowsBetween(-4, 0)
    want = skewed.select(
        "id",
        F.lag("x", 3).over(w).alias("wlg"),
        F.lead("x", 2).over(w).alias("wld"),
        F.when(F.count("maybe").over(r) == 5, F.avg("maybe").over(r)).alias("wmean"),
    )
    j = got.join(want, "id")
    bad = ~(
        F.col("lg").eqNullSafe(F.col("wlg"))
        & F.col("ld").eqNullSafe(F.col("wld"))
        & (F.abs(F.coalesce("mean", F.lit(9.0)) - F.coalesce("wmean", F.lit(9.0))) < 1e-9)
    )
    assert j.filter(bad).count() == 0 and j.count() == skewed.count()


@pytest.mark.parametrize("size", [300, 100_000])
@pytest.mark.parametrize("n", [65, 100])
def test_long_frames_equal_sliding_frames(skewed, size, n):
    ix = index_rows(skewed, ["k"], "ts", time_bucket("ts", 6 * HOUR_MS))
    kinds = {"sum": F.sum, "avg": F.avg, "std_pop": F.stddev_pop, "std_samp": F.stddev_samp, "max": F.max}
    # a few nulls only, so that full frames exist
    ix = ix.withColumn("y", F.when(F.col("id") % 700 != 3, F.col("x") + 1e6))
    got = add_windowed(
        ix, ["k"], lambda f: {f"{k}_{c}": f.roll(k, c, n) for k in kinds for c in ("x", "y")}, before=n - 1, size=size
    )
    r = W.partitionBy("k").orderBy("ts").rowsBetween(-(n - 1), 0)
    want = ix.select(
        "id", *[F.when(F.count(c).over(r) == n, a(c).over(r)).alias(f"w_{k}_{c}") for k, a in kinds.items() for c in ("x", "y")]
    )
    pdf = got.join(want, "id").toPandas()
    assert len(pdf) == skewed.count() and not any(c.startswith("_roll") for c in got.columns)
    for k in kinds:
        for c in ("x", "y"):
            np.testing.assert_allclose(pdf[f"{k}_{c}"], pdf[f"w_{k}_{c}"], rtol=1e-9, atol=1e-9)
            assert pdf[f"{k}_{c}"].notna().any()


def test_blocks_split_a_hot_key(skewed):
    ix = index_rows(skewed, ["k"], "ts", time_bucket("ts", 6 * HOUR_MS))
    sizes = blocks(ix, before=10, size=100).groupBy("k", "_blk").count()
    assert sizes.agg(F.max("count")).first()[0] <= 110


def test_running_equals_plain_windows(skewed):
    got = running(
        skewed,
        ["k"],
        "ts",
        time_bucket("ts", 6 * HOUR_MS),
        {"s": ("sum", F.col("x")), "m": ("max", F.col("x")), "l": ("last", F.col("maybe")), "p": ("product", 1 + F.col("x") / 100)},
    )
    w = W.partitionBy("k").orderBy("ts").rowsBetween(W.unboundedPreceding, 0)
    want = skewed.select(
        "id",
        F.sum("x").over(w).alias("ws"),
        F.max("x").over(w).alias("wm"),
        F.last("maybe", ignorenulls=True).over(w).alias("wl"),
        F.product(1 + F.col("x") / 100).over(w).alias("wp"),
    )
    j = got.join(want, "id")
    bad = (
        (F.abs(F.col("s") - F.col("ws")) > 1e-8)
        | (F.col("m") != F.col("wm"))
        | ~F.col("l").eqNullSafe(F.col("wl"))
        | (F.abs(F.col("p") - F.col("wp")) > 1e-9)
    )
    assert j.filter(bad).count() == 0 and j.count() == skewed.count()


def test_asof_matches_pandas_and_keeps_null_payload(spark, skewed):
    left = skewed.filter("id % 3 = 0").select("k", "ts", "id")
    right = skewed.filter("id % 3 <> 0").select("k", "ts", F.col("id").alias("rid"), "maybe")
    got = asof_join(left, right, ["k"], ["rid", "maybe"], tiebreak="rid", bucket_ms=6 * HOUR_MS).toPandas()
    a = left.toPandas().sort_values("ts")
    b = right.toPandas().sort_values("ts")
    want = pd.merge_asof(a, b, on="ts", by="k").set_index("id").sort_index()
    got = got.set_index("id").sort_index()
    pd.testing.assert_series_equal(got.rid.astype(float), want.rid.astype(float), check_names=False)
    pd.testing.assert_series_equal(got.maybe, want.maybe, check_names=False)


def test_exact_time_match_counts_and_future_is_not_seen(spark):
    left = spark.createDataFrame([("a", 10), ("a", 5)], "k string, ts bigint")
    right = spark.createDataFrame([("a", 10, 1.0), ("a", 11, 2.0)], "k string, ts bigint, v double")
    rows = {r.ts: r.v for r in asof_join(left, right, ["k"], ["v"]).collect()}
    assert rows == {10: 1.0, 5: None}


def test_ranks_and_recursive_means_do_not_depend_on_block_size(skewed):
    ix = index_rows(skewed, ["k"], "ts", time_bucket("ts", 6 * HOUR_MS)).select("k", "id", "ts", "pos", "x")
    for run in (
        lambda size: ft.add_ranks(ix, ["k"], {"o": ("x", 60)}, size=size),
        lambda size: ft.add_ranks(ix, ["k"], {"o": ("x", 60)}, size=size, strict_min_obs={"o": 30}),
        lambda size: ft.add_ewm(ix, ["k"], {"o": "x"}, 1 / 5, 5, size=size),
    ):
        a = run(200).toPandas().set_index("id").o.sort_index()
        b = run(100_000).toPandas().set_index("id").o.sort_index()
        np.testing.assert_allclose(a, b, rtol=1e-12, atol=1e-12)


def test_ewm_equals_pandas(skewed):
    ix = index_rows(skewed, ["k"], "ts", time_bucket("ts", 6 * HOUR_MS)).select("k", "id", "ts", "pos", "x")
    got = ft.add_ewm(ix, ["k"], {"o": "x"}, 1 / 14, 14, size=700).toPandas()
    for _, g in got.groupby("k"):
        g = g.sort_values("pos")
        want = g.x.ewm(alpha=1 / 14, adjust=False, min_periods=14).mean()
        np.testing.assert_allclose(g.o, want, rtol=1e-12)


def test_latest_and_bucket_suggestion(skewed):
    top = {r.k: r.id for r in latest(skewed, ["k"], F.col("ts"), ["id"]).collect()}
    want = skewed.toPandas().sort_values("ts").groupby("k").id.last().to_dict()
    assert top == want
    assert suggest_bucket_ms(skewed, ["k"], rows=10**9) == 86_400_000
    assert suggest_bucket_ms(skewed, ["k"], rows=4) <= HOUR_MS


def test_no_look_ahead_over_the_registry(spark):
    """A feature of a bar is the same when later bars are cut off."""
    rng = np.random.default_rng(1)
    n = 420
    close = 100 * np.exp(np.cumsum(rng.normal(0, 0.01, n)))
    pdf = pd.DataFrame({"k": "a", "ts": np.arange(n) * HOUR_MS, "open": close, "close": close})
    pdf["high"], pdf["low"] = close * 1.01, close * 0.99
    for c in ("volume", "taker_buy_volume", "funding_rate", "oi_base", "ls_all_account", "ls_top_trader_position", "liq_notional_1h"):
        pdf[c] = rng.random(n) + 1
    names = [f.name for f in ft.registered() if f.halo <= 400]

    def run(rows):
        df = spark.createDataFrame(pdf.head(rows))
        ix = index_rows(df, ["k"], "ts", time_bucket("ts", 365 * 24 * HOUR_MS))
        return ft.compute_features(ix, ["k"], names).toPandas().sort_values("pos").reset_index(drop=True)

    full, cut = run(n), run(380)
    assert full[names].notna().any().all()
    pd.testing.assert_frame_equal(full.head(380)[names], cut[names])


def test_null_keys_are_kept(spark):
    rows = [("a", 0, 1), (None, 0, 10), ("a", 5, 2), (None, 7, 20), (None, 3, 30)]
    df = spark.createDataFrame(rows, "k string, ts bigint, v bigint")
    got = {(r.k, r.ts): r.pos for r in index_rows(df, ["k"], "ts", time_bucket("ts", 4)).collect()}
    assert got == {("a", 0): 0, ("a", 5): 1, (None, 0): 0, (None, 3): 1, (None, 7): 2}
    sums = running(df, ["k"], "ts", time_bucket("ts", 4), {"s": ("sum", F.col("v"))})
    assert {(r.k, r.ts): r.s for r in sums.collect()} == {
        ("a", 0): 1, ("a", 5): 3, (None, 0): 10, (None, 3): 40, (None, 7): 60
    }


def test_events_go_by_the_start_of_the_series(spark):
    h = 3_600_000
    bars = spark.createDataFrame([(k, h // 2 + n * h) for k in ("a", None) for n in range(3)], "k string, ts bigint")
    bars = index_rows(bars, ["k"], "ts", time_bucket("ts", 24 * h))
    events = spark.createDataFrame([("mint", h + h // 4, 5.0), ("mint", h // 4, 9.0)], "event_type string, ts bigint, magnitude double")
    got = asof.place_events(bars, ["k"], events, h, ["mint"]).collect()
    # 01:15 belongs to the bar of 00:30; 00:15 is before the series
    assert {(r.k, r.pos): r.ev_mint for r in got} == {(k, n): 5.0 if n == 0 else None for k in ("a", None) for n in range(3)}


def plain_ewm(x, alpha, min_periods):
    out, y, weight, seen = [], None, 1.0, 0
    for v in x:
        if y is not None:
            weight *= 1 - alpha
        if v is not None:
            y = v if y is None else (weight * y + alpha * v) / (weight + alpha)
            weight, seen = 1.0, seen + 1
        out.append(y if seen >= min_periods else None)
    return out


@pytest.mark.parametrize("size", [1, 7, 64, 500, 5000])
def test_recursive_means_cross_long_runs_of_nulls(spark, size):
    rng = np.random.default_rng(2)
    series = {
        "ends": [float(v) if k < 50 or k >= 2901 else None for k, v in enumerate(rng.normal(size=3000))],
        "late": [None] * 700 + rng.normal(size=300).tolist(),
        "none": [None] * 40,
        "holes": [None if h else float(v) for v, h in zip(rng.normal(5, 1, 400), rng.random(400) < 0.4)],
        None: [1.0, None, 3.0, 4.0],
    }
    if size == 1:
        series = {k: v[:60] for k, v in series.items()}
    rows = [(k, p, v, None if v is None else -v) for k, s in series.items() for p, v in enumerate(s)]
    df = spark.createDataFrame(rows, "k string, pos bigint, x double, z double")
    got = ft.add_ewm(df, ["k"], {"o": "x", "q": "z", "o2": "x"}, 1 / 14, 14, size=size).collect()
    assert len(got) == len(rows)
    for k, s in series.items():
        mine = sorted((r for r in got if r["k"] == k), key=lambda r: r["pos"])
        want = plain_ewm(s, 1 / 14, 14)
        assert [r["o"] is None for r in mine] == [w is None for w in want], k
        assert [r["o"] for r in mine if r["o"] is not None] == pytest.approx([w for w in want if w is not None], rel=1e-12)
        assert all(r["o"] == r["o2"] and (r["o"] is None or r["q"] == pytest.approx(-r["o"])) for r in mine)


def test_ranks_count_ties_and_missing_values():
    rng = np.random.default_rng(1)
    for _ in range(200):
        n, w = rng.integers(1, 60), int(rng.integers(1, 20))
        v = rng.integers(0, 8, n).astype(float)
        v[rng.random(n) < rng.choice([0, 0.1, 0.5])] = np.nan
        least = int(rng.integers(1, w + 1))
        inclusive, strict = [], []
        for k in range(n):
            part = v[max(0, k - w + 1) : k + 1]
            seen = (~np.isnan(part)).sum()
            inclusive.append((part <= v[k]).sum() / w * 100 if seen == w else np.nan)
            strict.append((part < v[k]).sum() / len(part) if seen >= least else np.nan)
        np.testing.assert_array_equal(ft._inclusive_rank(v, w), inclusive)
        np.testing.assert_array_equal(ft._strict_rank(v, w, least), strict)
