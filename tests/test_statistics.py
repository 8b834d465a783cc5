"""Trade statistics, folds, resampling and verdict against plain numpy."""

from statistics import NormalDist

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from barline.functions import normal
from barline.functions.normal import norm_cdf, norm_ppf
from barline.functions.scalar import horizon_bars, parse_horizon_bars, wilson_high, wilson_low
from barline.operators import labels, resample, splits, stats, verdict

DAY = 86_400_000


def trades(spark, series: dict[str, list[float]], per_year=252.0):
    rows = [
        (g, i, i * DAY, i * DAY + DAY // 2, float(x), per_year) for g, xs in series.items() for i, x in enumerate(xs)
    ]
    return spark.createDataFrame(
        rows, "g string, seq bigint, entry_ts bigint, exit_ts bigint, ret_net_bps double, trades_per_year double"
    )


def reference_stats(x, tpy):
    x = np.asarray(x, float)
    n, m = len(x), x.mean()
    gain, loss = x[x > 0].sum(), -x[x < 0].sum()
    curve = np.cumprod(1 + x / 1e4)
    top = np.maximum.accumulate(curve)
    dd = ((curve - top) / top).min()
    out = {"trades": n, "ev_bps": m, "win_rate": (x > 0).mean(), "max_dd": dd}
    out["pf"] = gain / loss if loss else (np.inf if gain else 0.0)
    sd = x.std(ddof=1) if n > 1 else 0.0
    out["sharpe"] = m / sd * np.sqrt(tpy) if n > 1 and sd > 0 else 0.0
    neg = x[x < 0]
    if n < 2:
        out["sortino"] = 0.0
    else:
        out["sortino"] = m / np.sqrt((neg**2).mean()) * np.sqrt(tpy) if len(neg) else (np.inf if m > 0 else 0.0)
    out["calmar"] = 0.0 if dd == 0 else m / 1e4 * tpy / abs(dd)
    if n < 3 or ((x - m)[:-1] ** 2).sum() == 0:
        out["n_eff"] = float(n)
    else:
        c = x - m
        rho = np.clip((c[:-1] * c[1:]).sum() / (c[:-1] ** 2).sum(), -0.999, 0.999)
        out["n_eff"] = float(np.clip(n * (1 - rho) / (1 + rho), 1, n))
    pos = np.sort(x[x > 0])
    out["top5_concentration"] = pos[-5:].sum() / pos.sum() if len(pos) else 0.0
    return out


def test_bundle_equals_numpy_for_any_block_size(spark):
    rng = np.random.default_rng(3)
    series = {
        "mixed": rng.normal(5, 80, 137),
        "gains": np.abs(rng.normal(5, 10, 20)) + 1,
        "losses": -np.abs(rng.normal(5, 10, 20)) - 1,
        "one": [12.0],
        "two": [5.0, -3.0],
        "flat": [7.0] * 6,
        "trend": np.linspace(-50, 60, 44),
    }
    df = trades(spark, series)
    for size in (5, 1000):
        got = {r.g: r.asDict() for r in stats.trade_stats(df, ["g"], size=size).collect()}
        for g, xs in series.items():
            for name, want in reference_stats(xs, 252.0).items():
                assert got[g][name] == pytest.approx(want, rel=1e-9, abs=1e-9), (g, name, size)


def test_start_of_the_curve_is_no_top(spark):
    got = stats.max_drawdown(trades(spark, {"a": [-100.0, 50.0]}), ["g"], "ret_net_bps").first().max_dd
    assert got == pytest.approx(0.0)


def test_normal_functions(spark):
    nd = NormalDist()
    xs = [(float(x),) for x in np.linspace(-9, 9, 181)]
    for r in spark.createDataFrame(xs, "x double").select("x", norm_cdf(F.col("x")).alias("c")).collect():
        assert r.c == pytest.approx(nd.cdf(r.x), abs=1e-15)
    ps = [(float(p),) for p in np.linspace(0.001, 0.999, 200)]
    for r in spark.createDataFrame(ps, "p double").select("p", norm_ppf(F.col("p")).alias("z")).collect():
        assert r.z == pytest.approx(nd.inv_cdf(r.p), abs=1e-12)


def test_wilson_known_values(spark):
    df = spark.createDataFrame([(8, 10), (0, 0), (0, 5)], "w bigint, n bigint")
    got = df.select(wilson_low(F.col("w"), F.col("n")).alias("lo"), wilson_high(F.col("w"), F.col("n")).alias("hi")).collect()
    assert got[0].lo == pytest.approx(0.4901625, abs=1e-6) and got[0].hi == pytest.approx(0.9433178, abs=1e-6)
    assert (got[1].lo, got[1].hi) == (0.0, 0.0)
    assert got[2].lo == 0.0


@pytest.mark.parametrize("text,bars", [("30m", 1), ("4h", 4), ("90m", 2), ("7d", 168)])
def test_horizons(spark, text, bars):
    assert parse_horizon_bars(text, 3_600_000) == bars
    got = spark.createDataFrame([(text,)], "h string").select(horizon_bars("h", 3_600_000).alias("b")).first().b
    assert got == bars


def test_bad_horizon_is_an_error():
    with pytest.raises(ValueError):
        parse_horizon_bars("4w", 3_600_000)


def test_dsr_falls_with_trials_and_moments(spark):
    df = trades(spark, {"a": np.random.default_rng(0).normal(10, 60, 80)})
    m = stats.sample_moments(df, ["g"], "ret_net_bps")
    a = (F.col("sr_hat"), F.col("skew"), F.col("kurt"), F.col("n"))
    row = m.select("*", *[stats.deflated_sharpe(F.lit(t), *a).alias(f"d{t}") for t in (1, 5, 50)]).first()
    assert row.d1 > row.d5 > row.d50
    x = np.array([r.ret_net_bps for r in df.collect()])
    c = x - x.mean()
    assert row["skew"] == pytest.approx((c**3).mean() / x.std() ** 3, rel=1e-9)
    assert row.kurt == pytest.approx((c**4).mean() / x.std() ** 4, rel=1e-9)


def test_folds_do_not_leak(spark):
    rng = np.random.default_rng(2)
    t = np.sort(rng.integers(0, 400, 60)) * DAY
    rows = [("a", i, int(x), int(x) + 2 * DAY, 1.0) for i, x in enumerate(t)]
    df = spark.createDataFrame(rows, "g string, seq bigint, entry_ts bigint, exit_ts bigint, ret_net_bps double")
    roles = splits.fold_roles(df, ["g"], 4, embargo_ms=5 * DAY).toPandas()
    for fold, g in roles.groupby("fold"):
        train, test = g[g.role == "train"], g[g.role == "test"]
        assert not set(train.seq) & set(test.seq)
        if len(train) and len(test):
            assert train.exit_ts.max() + 5 * DAY <= test.entry_ts.min()
    tests = roles[roles.role == "test"]
    assert tests.seq.is_unique
    sizes = roles[roles.role == "train"].groupby("fold").size()
    assert sizes.is_monotonic_increasing
    one = splits.assign_test_fold(df, ["g"], 4).toPandas().set_index("seq").fold
    for _, r in tests.iterrows():
        assert one[r.seq] == r.fold


def test_fold_count_is_capped(spark):
    df = trades(spark, {"few": [1.0, 2.0, -1.0], "one": [1.0]})
    got = {r.g: r.folds for r in splits.assign_test_fold(df, ["g"], 5).collect()}
    assert got == {"few": 2, "one": 0}


def label_frame(spark, effect, n=1500, seed=0):
    rng = np.random.default_rng(seed)
    fire = rng.random(n) < 0.08
    y = rng.normal(0, 60, n) + np.where(fire, effect, 0.0)
    pdf = pd.DataFrame({"g": "a", "pos": np.arange(n), "fwd_bps": y, "fired": fire})
    df = spark.createDataFrame(pdf).withColumn("fwd_bps", F.when(F.col("pos") < n - 5, F.col("fwd_bps")))
    return df.filter("fired").select("g", "pos"), df.select("g", "pos", "fwd_bps")


def test_permutation_sees_an_effect_and_not_noise(spark):
    fires, lab = label_frame(spark, 60.0)
    strong = resample.permutation_test(fires, lab, ["g"], ["g"], 12, 200).first()
    assert strong.p_value < 0.02
    fires, lab = label_frame(spark, 0.0, seed=7)
    weak = resample.permutation_test(fires, lab, ["g"], ["g"], 12, 200).first()
    assert weak.p_value > 0.05
    assert strong.p_value >= 1 / 201


def test_permutation_does_not_depend_on_partitioning(spark):
    fires, lab = label_frame(spark, 10.0)
    a = resample.permutation_test(fires.repartition(1), lab.repartition(7), ["g"], ["g"], 6, 60).first()
    b = resample.permutation_test(fires.repartition(5), lab.coalesce(1), ["g"], ["g"], 6, 60).first()
    assert a.p_value == b.p_value and a.null_mean == pytest.approx(b.null_mean, rel=1e-12)


def test_no_fire_gives_p_one(spark):
    fires, lab = label_frame(spark, 0.0)
    none = resample.permutation_test(fires.filter("false"), lab, ["g"], ["g"], 6, 20)
    assert none.count() == 0
    full = resample.no_fire_result(lab.select("g").distinct(), none, ["g"]).first()
    assert (full.fires, full.p_value, full.observed_ev_bps) == (0, 1.0, 0.0)


def test_bootstrap_interval(spark):
    rng = np.random.default_rng(4)
    df = trades(spark, {"short": rng.normal(10, 50, 40), "long": rng.normal(10, 50, 640), "one": [3.0]})
    ci = {r.g: r for r in resample.bootstrap_ci(df, ["g"], "ret_net_bps", resample.mean_statistic, 6, 200).collect()}
    assert ci["short"].ci_lo < ci["short"].point < ci["short"].ci_hi
    assert ci["long"].ci_hi - ci["long"].ci_lo < ci["short"].ci_hi - ci["short"].ci_lo
    assert ci["one"].ci_lo == ci["one"].ci_hi == ci["one"].point == 3.0


def test_bootstrap_draws_walk_and_restart(spark):
    df = trades(spark, {"a": list(range(50))})
    d = resample.bootstrap_draws(df, ["g"], "ret_net_bps", 10, 40).toPandas().sort_values(["iter", "t"])
    assert (d.groupby("iter").size() == 50).all()
    step = d.groupby("iter").ret_net_bps.diff().dropna()
    share = ((step == 1) | (step == -49)).mean()
    assert 0.85 < share < 0.95


def test_moments_are_those_of_the_draws(spark):
    rng = np.random.default_rng(5)
    many = rng.normal(10, 50, 300).tolist()
    df = trades(spark, {"many": many, "two": [1.0, 2.0], "same": [0.1] * 30, "one": [3.0], "gaps": [1.0, 5.0, 1.0, 7.0, 6.5]})
    df = df.withColumn("ret_net_bps", F.expr("CASE WHEN g <> 'gaps' OR ret_net_bps > 1 THEN ret_net_bps END"))
    draws = resample.bootstrap_draws(df, ["g"], "ret_net_bps", 6, 80).toPandas()
    moments = {(r["g"], r["iter"]): r for r in resample.bootstrap_moments(df, ["g"], "ret_net_bps", 6, 80).collect()}
    assert len(moments) == 5 * 80
    for key, drawn in draws.groupby(["g", "iter"]).ret_net_bps:
        got, known = moments[key], drawn.dropna()
        assert (got["mean"] is None) == known.empty and (got["sd"] is None) == (len(known) < 2)
        assert known.empty or got["mean"] == pytest.approx(known.mean())
        assert len(known) < 2 or got["sd"] == pytest.approx(known.std(), abs=1e-12)


@pytest.mark.parametrize("n", [1, 2, 3, 10, 97, 1000])
def test_block_shuffle_is_a_bijection(n):
    for it in range(5):
        places = resample.shuffled_place(np.full(n, it), np.arange(n), np.full(n, n), 7)
        assert sorted(places.tolist()) == list(range(n))


def test_block_shuffle_reaches_every_place_alike():
    n, draws = 12, 6000
    it, block = np.divmod(np.arange(draws * n), n)
    places = resample.shuffled_place(it, block, np.full(draws * n, n), 0)
    counts = np.zeros((n, n))
    np.add.at(counts, (block, places), 1)
    assert np.abs(counts / draws - 1 / n).max() < 0.02
    together = np.zeros((n, n))  # where the first two land
    np.add.at(together, (places[block == 0], places[block == 1]), 1)
    off = together[~np.eye(n, dtype=bool)] / draws
    assert np.trace(together) == 0 and np.abs(off - 1 / (n * (n - 1))).max() < 0.006


def test_permutation_equals_a_plain_one(spark):
    rng = np.random.default_rng(3)
    n, length, iterations = 103, 6, 50
    y = [float(v) if k < 95 else None for k, v in enumerate(rng.normal(size=n))]
    fired = [k for k in range(n) if rng.random() < 0.3]
    rows = [(g, k, v) for g in ("a", None) for k, v in enumerate(y)]
    lab = spark.createDataFrame(rows, "g string, pos bigint, fwd_bps double")
    fires = spark.createDataFrame([(g, k) for g in ("a", None) for k in fired], "g string, pos bigint")
    got = {r.g: r for r in resample.permutation_test(fires, lab, ["g"], ["g"], length, iterations, 5).collect()}
    kept = [k for k in fired if y[k] is not None]
    k = -(-n // length)
    nulls = []
    for it in range(iterations):
        place = resample.shuffled_place(np.full(k, it), np.arange(k), np.full(k, k), 5)
        at = [place[p // length] * length + p % length for p in kept]
        seen = [y[p] for p in at if p < n and y[p] is not None]
        nulls.append(np.mean(seen) if seen else 0.0)
    observed = np.mean([y[p] for p in kept])
    assert set(got) == {"a", None}
    for r in got.values():
        assert r.fires == len(kept) and r.observed_ev_bps == pytest.approx(observed)
        assert r.null_mean == pytest.approx(np.mean(nulls)) and r.null_std == pytest.approx(np.std(nulls, ddof=1))
        assert r.p_value == (1 + sum(v >= observed for v in nulls)) / (iterations + 1)


@pytest.mark.parametrize("avg", [1, 3, 40])
def test_runs_cover_every_position_once(spark, monkeypatch, avg):
    sizes = spark.createDataFrame([("a", 500), ("b", 7), ("c", 1), (None, 64)], "g string, n bigint")

    def runs(segment):
        monkeypatch.setattr(resample, "SEGMENT", segment)
        rows = resample.bootstrap_runs(sizes, ["g"], avg, 60, 3).collect()
        out = {}
        for r in rows:
            out.setdefault((r.g, r.iter), []).append((r.t, r.len, r.start, r.n))
        return {k: sorted(v) for k, v in out.items()}

    for segment in (1 << 16, 64, 5):
        got = runs(segment)
        assert len(got) == 4 * 60
        lengths = []
        for (g, _), pieces in got.items():
            n = pieces[0][3]
            assert [t for t, *_ in pieces] == np.cumsum([0] + [x for _, x, *_ in pieces])[:-1].tolist()
            assert sum(x for _, x, *_ in pieces) == n and all(0 <= s < n for *_, s, _ in pieces)
            # a piece that goes on where the one before ended is no new run
            ends = [(s + x) % n for _, x, s, _ in pieces]
            if g == "a":
                lengths.append(n / (1 + sum(e != s for e, (*_, s, _) in zip(ends, pieces[1:]))))
        assert np.mean(lengths) == pytest.approx(avg, rel=0.15)


def test_pieces_of_runs_are_the_drawn_positions():
    rng = np.random.default_rng(0)
    n = rng.integers(1, 300, 400)
    length = (rng.random(400) * n).astype(int) + 1
    start = (rng.random(400) * n).astype(int)
    row, t, level, node = resample._nodes(np.arange(400), np.full(400, 10), length, start, n)
    for k in range(400):
        mine = sorted((int(a), int(b), int(c)) for r, a, b, c in zip(row, t, level, node) if r == k)
        drawn = [p for _, lv, b in mine for p in range(b << lv, (b + 1) << lv)]
        assert drawn == [(start[k] + j) % n[k] for j in range(length[k])]
        assert [a for a, *_ in mine] == (10 + np.cumsum([0] + [1 << lv for _, lv, _ in mine])[:-1]).tolist()


@pytest.mark.parametrize("levels", [16, 2])
def test_summaries_are_those_of_the_draws(spark, monkeypatch, levels):
    monkeypatch.setattr(resample, "_LEVELS", levels)
    rng = np.random.default_rng(6)
    df = trades(spark, {"many": rng.normal(10, 900, 300).tolist(), "two": [-100.0, 200.0], "one": [3.0], "gaps": [1.0, 5.0, -700.0, 1.0, 6.5]})
    df = df.withColumn("ret_net_bps", F.expr("CASE WHEN g <> 'gaps' OR ret_net_bps <> 1 THEN ret_net_bps END"))
    span = resample.extremes_statistic({"hi": "max", "lo": "min"}, lambda hi, lo: hi - lo)
    draws = resample.bootstrap_draws(df, ["g"], "ret_net_bps", 6, 40).cache()
    for statistic in (resample.drawdown_statistic, span):
        want = {(r.g, r.iter): r.stat for r in statistic(draws, ["g", "iter"], "ret_net_bps").collect()}
        got = {(r.g, r.iter): r.stat for r in resample.bootstrap_summaries(df, ["g"], "ret_net_bps", statistic.of_summary, 6, 40).collect()}
        assert got.keys() == want.keys() and len(got) == 160
        for k, v in want.items():
            assert (v is None) == (got[k] is None) and (v is None or got[k] == pytest.approx(v, abs=1e-12)), k


@pytest.mark.parametrize("segment, chunk", [(16, 64), (16, 1 << 24), (1 << 16, 1 << 16)])
def test_summaries_of_parts_of_a_series(spark, monkeypatch, segment, chunk):
    """A task that has some positions of a series only, and draws of many segments; pieces never go by draw through a shuffle."""
    for name, v in (("SEGMENT", segment), ("CHUNK", chunk), ("_TASK_DRAWS", 1000)):
        monkeypatch.setattr(resample, name, v)
    rng = np.random.default_rng(8)
    df = trades(spark, {"many": rng.normal(10, 900, 333).tolist(), "few": rng.normal(5, 400, 20).tolist()})
    draws = resample.bootstrap_draws(df, ["g"], "ret_net_bps", 7, 25).cache()
    for statistic in (resample.drawdown_statistic, resample.extremes_statistic({"hi": "max"}, lambda hi: hi)):
        want = {(r.g, r.iter): r.stat for r in statistic(draws, ["g", "iter"], "ret_net_bps").collect()}
        got = resample.bootstrap_summaries(df, ["g"], "ret_net_bps", statistic.of_summary, 7, 25)
        assert "MapInArrow" not in got._jdf.queryExecution().optimizedPlan().toString()
        got = {(r.g, r.iter): r.stat for r in got.collect()}
        assert got.keys() == want.keys() and len(got) == 50 and all(got[k] == pytest.approx(v, abs=1e-12) for k, v in want.items())
    moments = {(r.g, r.iter): (r.mean, r.sd) for r in resample.bootstrap_moments(df, ["g"], "ret_net_bps", 7, 25).collect()}
    for r in draws.groupBy("g", "iter").agg(F.avg("ret_net_bps").alias("m"), F.stddev_samp("ret_net_bps").alias("s")).collect():
        assert moments[r.g, r.iter] == (pytest.approx(r.m, abs=1e-9), pytest.approx(r.s, abs=1e-9))


@pytest.mark.parametrize("n, span, step", [(333, 1 << 16, 1 << 18), (333, 1 << 16, 700), (150_000, 1 << 16, 1 << 18), (40, 1 << 16, 1)])
def test_short_runs_are_folded_as_they_are_drawn(monkeypatch, n, span, step):
    """Summaries of drawn values are those of the runs' nodes in the tree, over segments and steps."""
    monkeypatch.setattr(resample, "_STEP_DRAWS", step)
    x, its, p = np.random.default_rng(9).normal(1, 300, n), np.arange(1, 14, 3), 1 / 7.0
    span_of = resample.extremes_statistic({"hi": "max", "lo": "min"}, lambda hi, lo: hi - lo).of_summary
    for summary in (resample._SUMS, resample.drawdown_statistic.of_summary, span_of):
        levels = resample._tree(x, summary, 16)
        got = [(i, t, *(v[k] for v in parts)) for it, t, parts in resample._drawn(x, its, p, 3, summary, span) for k, i in enumerate(it)]
        assert sorted((i, t) for i, t, *_ in got) == [(i, s) for i in its for s in range(0, n, span)]
        for i, t, *made in got:
            one = lambda v: np.array([v])
            runs = resample._segment_runs(one(i), one(t // span), one(n), one(p), 3)
            row, at, level, node = resample._nodes(*runs, one(n), 16)
            order = np.argsort(at, kind="stable")
            parts = resample._looked_up(x, levels, level[order], node[order], summary)
            want = resample._merged(np.zeros(len(at), int), parts, summary)
            assert made == pytest.approx([v[0] for v in want], rel=1e-9, abs=1e-9)


def test_hashes_without_division():
    rng = np.random.default_rng(10)
    for a, b in ((rng.integers(0, 5000, (30, 1)), rng.integers(0, 1 << 44, (30, 200))), (np.array([0, 2**31 - 1, 2**43]), np.array([2**31 - 1, 0, 2**44 - 1]))):
        for seed in (0, 3, 7919, 15_485_863 + 23, (1 << 40) - 1):
            want = [[normal._mixed(int(x), int(y), seed) for x, y in zip(*row)] for row in zip(*map(np.atleast_2d, np.broadcast_arrays(a, b)))]
            # the rule itself in whole numbers of any size, unless it would leave 64 bits
            assert np.array_equal(np.atleast_2d(normal.portable_hash(a, b, seed)), want)


def test_trades_per_year(spark):
    df = spark.createDataFrame([(5, 0, 365 * DAY), (1, 0, 0), (4, 7, 7)], "n bigint, a bigint, b bigint")
    got = [r.t for r in df.select(labels.trades_per_year(F.col("n"), F.col("a"), F.col("b")).alias("t")).collect()]
    assert got == pytest.approx([5.0, 252.0, 4 * 365.0])


GOOD = dict(
    ev_bps_ci_lo=1.0, ev_bps_ci_hi=9.0, sharpe=1.5, dsr=0.95, p_perm=0.01, n_eff=50.0, fold_consistency=0.8,
    regime_worst_ev_bps=-1.0, ev_bps=5.0, top5_concentration=0.3, corr_max_active=None, recent_ev_bps=4.0,
)


@pytest.mark.parametrize(
    "change,want,n",
    [
        ({}, "ADOPT", 12),
        ({"corr_max_active": 0.5}, "ADOPT", 13),
        ({"corr_max_active": 0.9}, "WATCH", 13),
        ({"recent_ev_bps": None}, "ADOPT", 11),
        ({"ev_bps_ci_hi": -0.1}, "REJECT", 4),
        ({"p_perm": 0.31}, "REJECT", 4),
        ({"p_perm": 0.30}, "WATCH", 12),
        ({"dsr": 0.49}, "REJECT", 4),
        ({"recent_ev_bps": -0.1}, "REJECT", 4),
        ({"n_eff": 29.9}, "WATCH", 12),
        ({"sharpe": 1.0}, "ADOPT", 12),
        ({"regime_worst_ev_bps": -10.0}, "WATCH", 12),
    ],
)
def test_verdict_boundaries(spark, change, want, n):
    schema = ", ".join(f"{k} double" for k in GOOD)
    df = spark.createDataFrame([tuple({**GOOD, **change}.values())], schema)
    got = verdict.decide(df).first()
    assert got.verdict == want and len(got.reasons) == n


def test_run_config():
    assert verdict.run_config("screen")["n_folds"] == 3
    assert verdict.run_config("decay_check") == verdict.run_config("full")
