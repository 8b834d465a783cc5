"""Catalogue: streaming operators, run to completion over the events table."""

from __future__ import annotations

from pyspark.sql import functions as F

from barline.functions.scalar import ms
from barline.operators.positions import one_open_position
from barline.plans.catalog.base import EV_CTE, HOURLY_CTE, R, query, rnd, rounded, table
from barline.plans.catalog.joins import LABELS_CTE, daily_labels
from barline.plans.catalog.scalars import FILLS_CTE
from barline.session import run_dir
from barline.streaming import pipelines as st


def stream(spark, sf):
    schema = table(spark, sf, "events").schema
    return st.landed(spark, sf, schema, "events.parquet").withColumns(
        {"event_time": st.event_time("ts"), "ts": ms("ts")}
    )


@query("str_01_landed_files", f"WITH {EV_CTE} SELECT event_id, instrument_id, ts, value FROM ev")
def str_01(spark, sf):
    s = stream(spark, sf).select("event_id", F.col("event_type").alias("instrument_id"), "ts", "value")
    return st.drain(s, "landed")


def stream_fills(spark, sf):
    s = stream(spark, sf).filter(F.col("event_type").isin("purchase", "error"))
    executed = F.when((F.col("event_id") % 4 != 0) & (F.col("value") * 2 > 0), F.col("value") * 2)
    return s.select(
        F.concat(F.lit("I"), (F.col("user_id") % 3).cast("string")).alias("instrument_id"),
        "event_time",
        F.when(F.col("event_type") == "purchase", "SELL").otherwise("BUY").alias("side"),
        F.coalesce(executed, F.col("value") * 3).alias("notional"),
    )


@query(
    "str_02_tumbling_buckets",
    f"""WITH {FILLS_CTE}, wm AS (SELECT max(epoch_us(ts)) // 1000 - 600000 AS w FROM events WHERE event_type IN ('purchase', 'error'))
        SELECT instrument_id, ts, {R("long_liq_usd")} AS long_liq_usd, {R("short_liq_usd")} AS short_liq_usd, events FROM buckets, wm
        WHERE ts + 300000 <= w""",
)
def str_02(spark, sf):
    # append mode: a window is out once the watermark (newest fill - 10 min) has passed its end
    b = st.drain(st.tumbling_side_buckets(stream_fills(spark, sf), ["instrument_id"], "SELL", "BUY"), "buckets")
    out = b.select("instrument_id", "ts", "long_liq_usd", "short_liq_usd", "events")
    return rounded(out, "long_liq_usd", "short_liq_usd")


@query(
    "str_03_reemitted_bars",
    f"WITH {HOURLY_CTE} SELECT instrument_id, ts, open, high, low, close, trades FROM hourly",
)
def str_03(spark, sf):
    s = stream(spark, sf).withColumnRenamed("event_type", "instrument_id")
    return st.drain_upserts(st.bars(s, ["instrument_id"], "value", "event_id"), ["instrument_id", "ts"], "bars")


@query(
    "str_04_dedupe",
    """SELECT DISTINCT event_type || ':' || user_id || ':' || strftime(ts, '%Y-%m-%d') AS dedupe_key FROM events""",
)
def str_04(spark, sf):
    key = F.concat_ws(":", "event_type", F.col("user_id").cast("string"), F.date_format("event_time", "yyyy-MM-dd"))
    s = stream(spark, sf).select(key.alias("dedupe_key"), "event_time")
    return st.drain(st.dedupe(s, "dedupe_key", "2 days"), "dedupe").select("dedupe_key")


@query(
    "str_05_event_lookback",
    """SELECT t.user_id, t.event_id AS tick_id, e.event_id, e.value AS magnitude FROM events t JOIN events e ON t.user_id = e.user_id
       AND e.ts <= t.ts AND e.ts >= t.ts - INTERVAL 15 MINUTE WHERE t.event_type = 'view' AND e.event_type = 'purchase'""",
)
def str_05(spark, sf):
    t = stream(spark, sf).filter("event_type = 'view'").select("user_id", "event_time", F.col("event_id").alias("tick_id"))
    e = stream(spark, sf).filter("event_type = 'purchase'").select(
        "user_id", "event_time", "event_id", F.col("value").alias("magnitude")
    )
    return st.drain(st.lookback_join(t, e, "user_id"), "lookback")


@query(
    "str_06_daily_label_join",
    f"""WITH {EV_CTE}, {LABELS_CTE} SELECT event_id, dl.trend, dl.vol FROM ev LEFT JOIN dl ON dl.dt = strftime(make_timestamp(ts * 1000), '%Y-%m-%d')""",
)
def str_06(spark, sf):
    s = stream(spark, sf).select("event_id", "ts")
    return st.drain(st.with_daily_label(s, daily_labels(spark, sf)).select("event_id", "trend", "vol"), "labels")


def ticks(df):
    """Ticks per user: a large purchase or sign-up fires."""
    return df.select(
        "user_id",
        "ts",
        F.col("event_id").alias("tick_id"),
        F.col("value").alias("open"),
        F.col("value").alias("close"),
        (F.col("event_type").isin("purchase", "signup") & (F.col("value") > 20)).alias("fired"),
    )


POSITIONS_SQL = f"""WITH RECURSIVE tk AS (SELECT user_id, event_id, epoch_us(ts) // 1000 AS ts, value, event_type IN ('purchase', 'signup') AND value > 20 AS fired FROM events),
  fx AS (SELECT f.user_id, f.event_id, f.ts, f.value AS px, min(t.ts) AS xts FROM tk f LEFT JOIN tk t ON t.user_id = f.user_id AND t.ts >= f.ts + 21600000
    WHERE f.fired GROUP BY 1, 2, 3, 4),
  ps AS (SELECT user_id, arg_min(px, ts) AS px, min(ts) AS ts, arg_min(coalesce(xts, -1), ts) AS xts FROM fx GROUP BY 1
    UNION ALL SELECT n.user_id, n.px, n.ts, coalesce(n.xts, -1) FROM (SELECT ps.user_id, arg_min(fx.px, fx.ts) AS px, min(fx.ts) AS ts, arg_min(coalesce(fx.xts, -1), fx.ts) AS xts
      FROM ps JOIN fx ON fx.user_id = ps.user_id AND fx.ts >= ps.xts WHERE ps.xts >= 0 GROUP BY ps.user_id, ps.ts) n)
  SELECT ps.user_id, ps.ts AS entry_ts, ps.xts AS exit_ts, {R("(t.value / ps.px - 1) * 10000", 4)} AS ret_bps FROM ps JOIN tk t ON t.user_id = ps.user_id AND t.ts = ps.xts
  WHERE ps.xts >= 0"""


@query("str_07_positions_stream", POSITIONS_SQL)
def str_07(spark, sf):
    p = st.drain(st.positions(ticks(stream(spark, sf)), "user_id", "6h"), "positions")
    return p.select("user_id", "entry_ts", "exit_ts", rnd("ret_bps", 4).alias("ret_bps"))


@query("str_07_positions_batch", POSITIONS_SQL)
def str_07_batch(spark, sf):
    t = ticks(table(spark, sf, "events").withColumn("ts", ms("ts")))
    p = one_open_position(t, ["user_id"], "6h")
    return p.select("user_id", "entry_ts", "exit_ts", rnd("ret_bps", 4).alias("ret_bps"))


LIVE = {
    "when": {"and": [{"time": {"utc_hour_in": [0, 1, 2, 3]}}, {"event": {"type": "purchase", "min_magnitude": 50}}]},
    "entry": {"delay_bars": 1, "price": "open"},
    "exit": {"horizon": "6h"},
    "direction": "long",
}


@query(
    "str_08_live_rule",
    """SELECT event_id, hour(ts) < 4 AND event_type = 'purchase' AND value >= 50 AS fired FROM events""",
)
def str_08(spark, sf):
    s = stream(spark, sf).withColumn("ev_purchase", F.when(F.col("event_type") == "purchase", F.col("value")))
    return st.drain(st.live_rule(s, LIVE).select("event_id", "fired"), "live")


LIVE_EVENTS = {
    "when": {
        "and": [
            {"time": {"utc_hour_in": list(range(18))}},
            {"or": [{"event": {"type": "purchase", "min_magnitude": 60}}, {"event": {"type": "error"}}]},
            {"not": {"regime": {"vol": ["extreme"]}}},
        ]
    },
    "entry": {"delay_bars": 1, "price": "open"},
    "exit": {"horizon": "6h"},
    "direction": "long",
}


def landed_to_the_end(spark, df, label):
    """The rows landed as files and, behind them, one of a far later time: it moves the watermark past all of them."""
    path = run_dir(spark, label)
    df.write.parquet(path)
    last = df.agg(F.max("event_time").alias("event_time"))
    flush = last.select(*[(F.col(c) + F.expr("INTERVAL 30 DAYS") if c == "event_time" else F.lit(None).cast(t)).alias(c) for c, t in df.dtypes])
    flush.write.mode("append").parquet(path)
    return st.landed(spark, path, df.schema)


@query(
    "str_08_live_lookback",
    f"""WITH {EV_CTE}, {LABELS_CTE}, t AS (SELECT event_id, ts FROM events WHERE event_type = 'view'),
        m AS (SELECT t.event_id, max(e.value) FILTER (e.event_type = 'purchase') AS p, max(e.value) FILTER (e.event_type = 'error') AS r
          FROM t JOIN events e ON e.ts <= t.ts AND e.ts >= t.ts - INTERVAL 15 MINUTE WHERE e.event_type IN ('purchase', 'error') GROUP BY 1)
        SELECT t.event_id AS tick_id, round(p, 6) + 0.0 AS ev_purchase, round(r, 6) + 0.0 AS ev_error,
          hour(t.ts) < 18 AND (coalesce(p >= 60, false) OR r IS NOT NULL) AND NOT coalesce(dl.vol IN ('extreme'), false) AS fired
        FROM t LEFT JOIN m USING (event_id) LEFT JOIN dl ON dl.dt = strftime(t.ts, '%Y-%m-%d')""",
)
def str_08_lookback(spark, sf):
    e = table(spark, sf, "events").withColumns({"event_time": st.event_time("ts"), "ts": ms("ts")})
    t = landed_to_the_end(spark, e.filter("event_type = 'view'").select("event_time", "ts", F.col("event_id").alias("tick_id")), "ticks")
    seen = e.filter("event_type <> 'view'").select("event_time", "event_type", F.col("value").alias("magnitude"))
    signals = st.live_signals(t, landed_to_the_end(spark, seen, "seen"), LIVE_EVENTS, regimes=daily_labels(spark, sf))
    out = st.drain(signals, "signals").filter("tick_id IS NOT NULL")
    return rounded(out.select("tick_id", "ev_purchase", "ev_error", "fired"), "ev_purchase", "ev_error")


@query(
    "str_09_running_moments",
    f"""SELECT event_type, CAST(count(*) AS BIGINT) AS n, {R("avg(value)")} AS mean, {R("var_samp(value)", 4)} AS variance FROM events GROUP BY 1""",
)
def str_09(spark, sf):
    m = st.drain_upserts(st.running_moments(stream(spark, sf), ["event_type"], "value"), ["event_type"], "moments")
    return rounded(rounded(m, "mean"), "variance", digits=4)


@query(
    "str_09_ewma",
    f"""WITH RECURSIVE o AS (SELECT user_id, event_id, value, row_number() OVER (PARTITION BY user_id ORDER BY ts) AS i FROM events),
        e AS (SELECT user_id, event_id, i, value AS y FROM o WHERE i = 1 UNION ALL SELECT o.user_id, o.event_id, o.i, 0.2 * o.value + 0.8 * e.y
          FROM e JOIN o ON o.user_id = e.user_id AND o.i = e.i + 1)
        SELECT user_id, event_id, {R("y")} AS ewma FROM e""",
)
def str_09_ewma(spark, sf):
    s = stream(spark, sf).select("user_id", "ts", "event_id", "value")
    return rounded(st.drain(st.ewma(s, "user_id", "value", 0.2, "event_id"), "ewma"), "ewma")
