"""Readiness states and what is missing, against hand cases."""

from barline.operators import ledger

STATES = {
    # edge: (status, class, blockers, features, event types, regime, run kinds done) -> state, missing
    1: (("TESTING", "A", None, ["ret_24h"], [], False, []), ("READY", {})),
    2: (("TESTING", "A", None, ["nope", "also"], [], False, []), ("FEATURE_PENDING", {"feature": ["also", "nope"]})),
    3: (
        ("TESTING", "A", None, ["liq_notional_24h", "nope"], ["halving"], True, []),
        ("DATA_PENDING", {"data": ["liq_notional_24h", "regimes_daily"], "event": ["halving"]}),
    ),
    4: (("TESTING", "A", None, ["ret_24h"], [], True, []), ("DATA_PENDING", {"data": ["regimes_daily"]})),
    5: (("TESTING", "A", None, ["ret_24h"], ["halving"], False, []), ("DATA_PENDING", {"event": ["halving"]})),
    6: (("TESTING", "A", None, ["nope"], [], False, ["screen"]), ("SCREEN_DONE", {})),
    7: (("TESTING", "A", None, ["nope"], [], False, ["screen", "full"]), ("FULL_DONE", {})),
    8: (("PAPER", "D", ["x"], ["nope"], [], True, []), ("VALIDATED_PLUS", {})),
    9: (("IDEA", "C", ["order book", "fills"], None, None, None, []), ("BUILD_PENDING", {"build": ["order book", "fills"]})),
    10: (("IDEA", "D", None, None, None, None, []), ("BUILD_PENDING", {"build": []})),
    11: (("IDEA", None, ["ignored"], None, None, None, []), ("SIGNAL_SPEC_PENDING", {"signalSpec": True})),
}


def found(spark, blockers=True):
    rows = {i: row for i, (row, _) in STATES.items()}
    edges = spark.createDataFrame(
        [(i, r[0], r[1], r[2]) for i, r in rows.items()], "edge_id bigint, status string, readiness_class string, plan_blockers array<string>"
    )
    inputs = spark.createDataFrame(
        [(i, i * 10, r[3], r[4], r[5]) for i, r in rows.items() if r[3] is not None],
        "edge_id bigint, version_id bigint, features array<string>, event_types array<string>, uses_regime boolean",
    )
    runs = spark.createDataFrame(
        [(i * 10, kind, "done") for i, r in rows.items() for kind in r[6]] + [(10, "full", "failed")],
        "edge_version_id bigint, run_kind string, status string",
    )
    defs = spark.createDataFrame([("fx.ret_24h", "active"), ("fx.liq_notional_24h", "active"), ("fx.nope", "retired")], "feature_id string, status string")
    types = spark.createDataFrame([("cpi",)], "event_type string")
    edges = edges if blockers else edges.drop("plan_blockers")
    got = ledger.readiness(edges, inputs, runs, defs, types, ["funding_rates"], False)
    assert len(got.columns) == len(set(got.columns))
    return {
        r["edge_id"]: (r["state"], {k: v for k, v in r["missing"].asDict().items() if v is not None}) for r in got.collect()
    }


def test_states_and_missing(spark):
    assert found(spark) == {i: wanted for i, (_, wanted) in STATES.items()}


def test_without_blockers(spark):
    got = found(spark, blockers=False)
    assert got[9] == ("BUILD_PENDING", {"build": []})
    assert {i: s for i, (s, _) in got.items()} == {i: wanted[0] for i, (_, wanted) in STATES.items()}
