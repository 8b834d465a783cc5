import math
import random
from datetime import UTC, datetime

import pytest
from pyspark.sql import functions as F

from barline.operators import rules
from barline.operators.rules import MissingInput, RuleError

H = 3_600_000
SCHEMA = (
    "k string, pos bigint, ts bigint, f1 double, f2 double, ev_mint double, "
    "regime struct<trend:string,vol:string,liquidity:string>"
)


def fired(spark, when, rows):
    df = spark.createDataFrame([("a", i, *r) for i, r in enumerate(rows)], SCHEMA)
    out = rules.fire_flags(df, ["k"], {"hit": when}, size=2)
    return [r.hit for r in out.orderBy("pos").collect()]


def row(ts=0, f1=None, f2=None, ev=None, regime=None):
    return (ts, f1, f2, ev, regime)


# ---------------------------------------------------------------- rules by plain evaluation


def holds(when, rows, i):
    """Whether a rule holds at row i, by the meaning of its nodes."""
    (kind, body), *_ = when.items()
    ts, f1, f2, ev, regime = rows[i]
    if kind in ("and", "or"):
        return (all if kind == "and" else any)(holds(w, rows, i) for w in body)
    if kind == "not":
        return not holds(body, rows, i)
    if kind == "cmp":

        def value(side):
            if not isinstance(side, dict):
                return float(side)
            at = i - side.get("lag", 0)
            x = rows[at][1 if side["feature"] == "f1" else 2] if at >= 0 else None
            return None if x is None or math.isnan(x) else x

        x, y = value(body[0]), value(body[2])
        if x is None or y is None:
            return False
        return {">": x > y, ">=": x >= y, "<": x < y, "<=": x <= y}[body[1]]
    if kind == "event":
        return ev is not None and ev >= body.get("min_magnitude", -math.inf)
    if kind == "regime":
        labels = dict(zip(("trend", "vol", "liquidity"), regime)) if regime else None
        return labels is not None and all(labels[k] in allowed for k, allowed in body.items())
    at = datetime.fromtimestamp(ts / 1000, UTC)
    sunday_first = (at.weekday() + 1) % 7
    return at.hour in body.get("utc_hour_in", range(24)) and sunday_first in body.get("dow_in", range(7))


def random_rule(rng, depth=3):
    if depth and rng.random() < 0.5:
        kind = rng.choice(["and", "or", "not"])
        if kind == "not":
            return {"not": random_rule(rng, depth - 1)}
        return {kind: [random_rule(rng, depth - 1) for _ in range(rng.randint(1, 3))]}
    kind = rng.choice(["cmp", "cmp", "cmp", "event", "regime", "time"])
    if kind == "cmp":
        left = {"feature": rng.choice(["f1", "f2"])} | ({"lag": rng.randint(0, 4)} if rng.random() < 0.4 else {})
        right = rng.choice([rng.randint(-3, 3), {"feature": "f2"}])
        return {"cmp": [left, rng.choice([">", ">=", "<", "<="]), right]}
    if kind == "event":
        return {"event": {"type": "mint"} | ({"min_magnitude": rng.randint(0, 6)} if rng.random() < 0.7 else {})}
    if kind == "regime":
        options = {"trend": ["up", "down", "range"], "vol": ["low", "high"], "liquidity": ["normal", "stressed"]}
        return {"regime": {k: rng.sample(v, rng.randint(1, len(v))) for k, v in options.items() if rng.random() < 0.5}}
    return {"time": {"utc_hour_in": rng.sample(range(24), 8)} | ({"dow_in": rng.sample(range(7), 3)} if rng.random() < 0.5 else {})}


def random_rows(rng, n):
    number = lambda: rng.choice([None, math.nan, *map(float, range(-4, 5))])
    regime = lambda: rng.choice([None, (rng.choice(["up", "down"]), rng.choice(["low", "high"]), "normal")])
    start = rng.randint(0, 10_000) * H
    return [row(start + k * H, number(), number(), rng.choice([None, 0.0, 2.5, 6.0]), regime()) for k in range(n)]


def test_random_rules_match_plain_evaluation(spark):
    rng = random.Random(11)
    rows = random_rows(rng, 60)
    book = {f"r{k}": random_rule(rng) for k in range(60)}
    df = spark.createDataFrame([("a", i, *r) for i, r in enumerate(rows)], SCHEMA)
    got = rules.fire_flags(df, ["k"], book, size=7).orderBy("pos").collect()
    for name, when in book.items():
        assert [r[name] for r in got] == [holds(when, rows, i) for i in range(len(rows))], when


DIP = {"cmp": [{"feature": "f1"}, "<=", -1.5]}
CROSS = {"and": [{"cmp": [{"feature": "f1"}, ">", {"feature": "f2"}]}, {"not": {"cmp": [{"feature": "f1", "lag": 2}, ">", 0.25]}}]}
QUIET = {"or": [{"event": {"type": "mint", "min_magnitude": 7}}, {"regime": {"vol": ["low"]}}]}


def test_hand_cases(spark):
    rows = [row(f1=-1.5, f2=-2.0), row(f1=math.nan, f2=0.0), row(f1=0.3, f2=0.1, ev=7.0), row(f1=-9.0, regime=("down", "low", "normal"))]
    assert fired(spark, DIP, rows) == [True, False, False, True]
    assert fired(spark, CROSS, rows) == [True, False, True, False]
    assert fired(spark, QUIET, rows) == [False, False, True, True]
    assert fired(spark, {"not": QUIET}, rows) == [True, True, False, False]


def test_many_rules_equal_single_rules(spark):
    df = spark.createDataFrame([("a", i, *row(ts=i * H, f1=float(i % 5), f2=float(-i % 3))) for i in range(40)], SCHEMA)
    book = {"r1": DIP, "r2": CROSS, "r3": {"cmp": [{"feature": "f2"}, ">", -2]}}
    long = rules.fires(df, ["k"], book, size=9)
    for rid, when in book.items():
        want = rules.fire_flags(df, ["k"], {"hit": when}).filter("hit").count()
        assert long.filter(F.col("rule_id") == rid).count() == want


def test_dependencies():
    rule = {
        "and": [
            {"cmp": [{"feature": "a", "lag": 3}, ">", {"feature": "b"}]},
            {"or": [{"event": {"type": "x"}}, {"not": {"regime": {"vol": ["low"]}}}]},
        ]
    }
    assert rules.features_of(rule) == {"a", "b"}
    assert rules.event_types_of(rule) == {"x"}
    assert rules.uses_regime(rule) and rules.max_lag(rule) == 3


@pytest.mark.parametrize(
    "bad",
    [
        {"and": []},
        {"or": []},
        {"cmp": [{"feature": "a"}, "==", 1]},
        {"cmp": [{"feature": ""}, ">", 1]},
        {"cmp": [{"feature": "a", "lag": -1}, ">", 1]},
        {"cmp": [1, ">", 1]},
        {"event": {"min_magnitude": 3}},
        {"regime": {"trend": ["sideways"]}},
        {"time": {"utc_hour_in": [24]}},
        {"time": {"dow_in": [7]}},
        {"xor": []},
        "text",
    ],
)
def test_invalid_rules_are_refused(bad):
    assert rules.problems_of(bad)


def test_spec_validation():
    good = {"when": DIP, "entry": {"delay_bars": 1, "price": "open"}, "exit": {"horizon": "4h"}, "direction": "long"}
    rules.validate(good)
    for change in ({"entry": {"delay_bars": 0}}, {"exit": {}}, {"direction": "up"}, {"when": {}}, {"entry": {"price": "close"}}):
        with pytest.raises(RuleError):
            rules.validate({**good, **change})
    rules.validate({**good, "exit": {"cond": DIP, "max_horizon": "2d"}})


def test_missing_inputs_fail_closed():
    with pytest.raises(MissingInput):
        rules.check_inputs({"cmp": [{"feature": "zz"}, ">", 1]}, ["a"])
    with pytest.raises(MissingInput):
        rules.check_inputs({"event": {"type": "x"}}, ["a"])
    with pytest.raises(MissingInput):
        rules.check_inputs({"regime": {"vol": ["low"]}}, ["a"], has_regimes=False)
    rules.check_inputs({"cmp": [{"feature": "a"}, ">", 1]}, ["a"])
