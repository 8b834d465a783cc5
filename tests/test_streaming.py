import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from barline.operators.positions import one_open_position
from barline.operators.rules import RuleError
from barline.streaming import pipelines as st

H = 3_600_000


def land(spark, path, pdf, files):
    """Write rows as several files in time order, one micro-batch each."""
    for i, rows in enumerate(np.array_split(np.arange(len(pdf)), files)):
        spark.createDataFrame(pdf.iloc[rows]).coalesce(1).write.mode("append").parquet(f"{path}/part={i:02d}")
    return spark.read.parquet(path).drop("part").schema


def ticks(n=600, seed=0):
    rng = np.random.default_rng(seed)
    pdf = pd.DataFrame({"k": rng.choice(["a", "b", "c"], n, p=[0.7, 0.2, 0.1]), "ts": np.sort(rng.choice(10**8, n, replace=False))})
    pdf["tick_id"] = np.arange(n)
    pdf["open"] = pdf["close"] = rng.random(n) + 1
    pdf["fired"] = rng.random(n) < 0.3
    return pdf


def greedy(pdf, hold):
    """Plain loop over the ticks of one key."""
    entry, out = None, []
    for r in pdf.sort_values(["ts", "tick_id"]).itertuples():
        if entry is not None and r.ts >= entry.ts + hold:
            out.append((entry.ts, r.ts, (r.close / entry.open - 1) * 1e4))
            entry = None
        if entry is None and r.fired:
            entry = r
    return out


@pytest.mark.parametrize("horizon", ["5m", "1h", "12h"])
def test_batch_positions_equal_a_plain_loop(spark, horizon):
    hold = {"5m": 300_000, "1h": H, "12h": 12 * H}[horizon]
    pdf = ticks()
    got = one_open_position(spark.createDataFrame(pdf), ["k"], horizon, bucket_ms=2 * H).toPandas()
    for k, g in pdf.groupby("k"):
        mine = got[got.k == k].sort_values("entry_ts")
        want = greedy(g, hold)
        assert list(zip(mine.entry_ts, mine.exit_ts)) == [(a, b) for a, b, _ in want]
        np.testing.assert_allclose(mine.ret_bps, [r for *_, r in want])


def test_stream_positions_over_several_batches(spark, tmp_path):
    pdf = ticks(seed=4)
    schema = land(spark, str(tmp_path / "in"), pdf, 5)
    s = st.landed(spark, str(tmp_path / "in"), schema, max_files=1)
    got = st.drain(st.positions(s, "k", "1h", cost_bps=2.0), "pos").toPandas()
    want = sorted((k, a, b) for k, g in pdf.groupby("k") for a, b, _ in greedy(g, H))
    assert sorted(zip(got.k, got.entry_ts, got.exit_ts)) == want
    np.testing.assert_allclose(got.ret_bps - got.ret_net_bps, 2.0)


def test_bars_are_reemitted_and_restart_adds_nothing(spark, tmp_path):
    pdf = ticks(seed=9)[["k", "ts", "tick_id", "open"]]
    schema = land(spark, str(tmp_path / "in"), pdf, 4)
    base = str(tmp_path / "out")

    def run():
        s = st.landed(spark, str(tmp_path / "in"), schema, max_files=1).withColumn("event_time", F.timestamp_millis("ts"))
        b = st.bars(s.drop("ts"), ["k"], "open", "tick_id")
        q = (
            b.writeStream.foreachBatch(st.change_log_writer(f"{base}/log"))
            .outputMode("update")
            .option("checkpointLocation", f"{base}/chk")
            .trigger(availableNow=True)
            .start()
        )
        q.awaitTermination()
        return st.current_rows(spark, f"{base}/log", b.schema, ["k", "ts"]).toPandas()

    first, again = run(), run()
    key = ["k", "ts"]
    pd.testing.assert_frame_equal(
        first.sort_values(key).reset_index(drop=True)[sorted(first.columns)],
        again.sort_values(key).reset_index(drop=True)[sorted(first.columns)],
    )
    pdf["slot"] = pdf.ts // H * H
    want = pdf.groupby(["k", "slot"]).open.agg(["first", "max", "min", "last", "count"])
    got = first.set_index(key).sort_index()
    np.testing.assert_allclose(got[["open", "high", "low", "close"]].values, want[["first", "max", "min", "last"]].values)
    assert (got.trades.values == want["count"].values).all()


def test_late_rows_are_dropped_behind_the_watermark(spark, tmp_path):
    """The fourth file is hours older than the watermark; its bucket stays as emitted."""
    rows = [(0, "SELL", 1.0), (10 * H, "SELL", 2.0), (20 * H, "BUY", 1.0), (1, "SELL", 50.0), (40 * H, "BUY", 3.0)]
    pdf = pd.DataFrame([("a", *r) for r in rows], columns=["k", "ts", "side", "notional"])
    schema = land(spark, str(tmp_path / "in"), pdf, 5)
    s = st.landed(spark, str(tmp_path / "in"), schema, max_files=1).withColumn("event_time", F.timestamp_millis("ts"))
    out = st.drain(st.tumbling_side_buckets(s, ["k"], "SELL", "BUY"), "late").toPandas().set_index("ts")
    assert out.loc[0].long_liq_usd == 1.0
    assert out.loc[10 * H].long_liq_usd == 2.0


def test_dedupe_across_batches(spark, tmp_path):
    pdf = pd.DataFrame({"key": ["a", "b", "a", "c", "b", "a"], "ts": np.arange(6) * 1000})
    schema = land(spark, str(tmp_path / "in"), pdf, 3)
    s = st.landed(spark, str(tmp_path / "in"), schema, max_files=1).withColumn("event_time", F.timestamp_millis("ts"))
    got = st.drain(st.dedupe(s.select("key", "event_time"), "key", "1 hour"), "dd").toPandas()
    assert sorted(got.key) == ["a", "b", "c"]


def test_live_rules_are_limited(spark):
    df = spark.range(1).withColumn("ts", F.lit(0))
    ok = {"when": {"time": {"utc_hour_in": [0]}}, "entry": {"delay_bars": 1}, "exit": {"horizon": "1h"}}
    assert st.live_rule(df, ok).first().fired is True
    for bad in (
        {**ok, "when": {"cmp": [{"feature": "x"}, ">", 1]}},
        {**ok, "exit": {"cond": {}, "max_horizon": "1h"}},
        {**ok, "entry": {"delay_bars": 2}},
        {**ok, "when": {"event": {"type": "zz"}}},
    ):
        with pytest.raises(RuleError):
            st.live_rule(df, bad)


def test_live_signals_look_back_over_batches_and_take_late_events(spark, tmp_path):
    minute = 60_000
    spec = {"when": {"event": {"type": "halt", "min_magnitude": 5}}, "entry": {"delay_bars": 1}, "exit": {"horizon": "1h"}}
    day = 86_400_000
    ticks = [(0, 1), (16, 2), (30, 3), (44, 4), (300, 5), (1000, 99)]
    events = [
        (1, "halt", 7.0),  # for tick 2, on the border of 15 minutes
        (29, "halt", 4.0),
        (30, "other", 9.0),
        (299, "halt", 9.0),
        (25, "halt", 6.0),  # late, but no tick behind it has been given yet
        (1000, "halt", 1.0),
        (26, "halt", 8.0),  # its ticks have been given
    ]
    ticks = [(day + t * minute, k) for t, k in ticks]
    events = [(day + t * minute, k, v) for t, k, v in events]
    tick_schema = land(spark, str(tmp_path / "t"), pd.DataFrame(ticks, columns=["ts", "tick_id"]), 6)
    event_schema = land(spark, str(tmp_path / "e"), pd.DataFrame(events, columns=["ts", "event_type", "magnitude"]), 7)

    def stream(name, schema):
        s = st.landed(spark, str(tmp_path / name), schema, max_files=1)
        return s.withColumn("event_time", F.timestamp_millis("ts"))

    out = st.drain(st.live_signals(stream("t", tick_schema), stream("e", event_schema), spec, delay="1 hour"), "live").collect()
    got = {r.tick_id: (r.ev_halt, r.fired) for r in out}
    assert len(out) == len(got)
    assert got == {1: (None, False), 2: (7.0, True), 3: (6.0, True), 4: (4.0, False), 5: (9.0, True)}
