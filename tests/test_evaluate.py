"""The whole protocol: a planted effect is adopted, noise is not."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from barline.operators.rules import MissingInput
from barline.plans.evaluate import Config, RuleSpec, evaluate, prepare_bars

H = 3_600_000
FLAG = {"cmp": [{"feature": "flag"}, ">", 0]}


def price_bars(spark, effect_bps, n=2500, seed=11):
    """Hourly bars; a flagged bar is followed by a move over the next bars."""
    rng = np.random.default_rng(seed)
    flag = (rng.random(n) < 0.08).astype(float)
    step = rng.normal(0, 25, n) / 1e4
    for i in np.flatnonzero(flag):
        if i + 2 < n:
            step[i + 2] += effect_bps / 1e4
    close = 100 * np.cumprod(1 + step)
    open_ = np.concatenate([[100.0], close[:-1]])
    pdf = pd.DataFrame({"k": "a", "ts": np.arange(n) * H, "open": open_, "close": close, "flag": flag})
    return spark.createDataFrame(pdf)


CFG = Config(n_folds=3, permutation_iterations=100, bootstrap_iterations=100)


def test_planted_effect_is_adopted_and_noise_is_not(spark):
    spec = RuleSpec("flagged", FLAG, "long", "2h", 1.0, 1.0)
    never = RuleSpec("never", {"cmp": [{"feature": "flag"}, ">", 5]}, "long", "2h")
    both = price_bars(spark, 60).unionByName(price_bars(spark, 0, seed=3).withColumn("k", F.lit("noise")))
    out = evaluate(prepare_bars(both, ["k"], [spec, never]), ["k"], [spec, never], CFG, size=400)
    verdicts = {(r.rule_id, r.k): r for r in out.verdicts.collect()}
    assert verdicts["flagged", "a"].verdict == "ADOPT"
    assert verdicts["flagged", "noise"].verdict != "ADOPT"
    assert verdicts["never", "a"].verdict == "REJECT"
    m = out.metrics.toPandas()
    idle = m[(m.rule_id == "never") & (m.k == "a")]
    assert idle[["segment", "metric", "value"]].values.tolist() == [["overall", "trades", 0.0]]
    mine = m[(m.rule_id == "flagged") & (m.k == "a")].set_index(["segment", "metric"]).value
    assert mine["overall", "ev_bps"] == pytest.approx(mine["cost:zero", "ev_bps"] - 4.0)
    assert mine["wf:oos", "trades"] == sum(mine[f"wf:fold{i}", "trades"] for i in (1, 2, 3))
    assert not m.duplicated(["rule_id", "k", "segment", "metric"]).any()
    # trades are the fired bars with enough bars behind them
    flags = both.filter("k = 'a' and flag > 0").count()
    assert flags - 3 <= mine["overall", "trades"] <= flags


def test_inputs_are_checked(spark):
    bars = price_bars(spark, 0, 60)
    with pytest.raises(MissingInput):
        prepare_bars(bars, ["k"], [RuleSpec("r", {"cmp": [{"feature": "nope"}, ">", 0]}, "long", "2h")])
    with pytest.raises(MissingInput):
        prepare_bars(bars, ["k"], [RuleSpec("r", {"event": {"type": "x"}}, "long", "2h")])
    empty = spark.createDataFrame([], "event_type string, ts bigint, magnitude double")
    with pytest.raises(MissingInput):
        prepare_bars(bars, ["k"], [RuleSpec("r", {"event": {"type": "x"}}, "long", "2h")], events=empty)
    with pytest.raises(MissingInput):
        prepare_bars(bars, ["k"], [RuleSpec("r", {"regime": {"vol": ["low"]}}, "long", "2h")])
    with pytest.raises(ValueError):
        RuleSpec("r", FLAG, "signal_sign", "2h")
    with pytest.raises(ValueError):
        RuleSpec("r", FLAG, "long", "2h", delay_bars=0)


def test_only_needed_features_are_planned(spark):
    bars = price_bars(spark, 0, 60)
    p = prepare_bars(bars, ["k"], [RuleSpec("r", {"cmp": [{"feature": "ret_24h"}, ">", 0]}, "long", "2h")])
    assert "ret_24h" in p.columns and "rv_24h" not in p.columns


def test_events_and_regimes_reach_the_bars(spark):
    bars = price_bars(spark, 0, 72)
    events = spark.createDataFrame(
        [("x", 5 * H + 10, 3.0), ("x", 5 * H + 20, None), ("y", 6 * H, 1.0), ("x", 10_000 * H, 9.0)],
        "event_type string, ts bigint, magnitude double",
    )
    regimes = spark.createDataFrame(
        [("1970-01-02", "up", "low", "normal")], "dt string, trend string, vol string, liquidity string"
    )
    specs = [
        RuleSpec("e", {"event": {"type": "x", "min_magnitude": 2}}, "long", "2h"),
        RuleSpec("g", {"regime": {"trend": ["up"]}}, "short", "2h"),
    ]
    p = prepare_bars(bars, ["k"], specs, events=events, regimes=regimes).orderBy("pos").collect()
    assert [r.pos for r in p if r.ev_x is not None] == [5]
    assert p[5].ev_x == 3.0
    assert [r.regime is not None for r in p] == [False] * 24 + [True] * 48
