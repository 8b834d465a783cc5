"""Catalogue: landed files and payloads, written from the given tables and read back."""

from __future__ import annotations

from pyspark.sql import functions as F

from barline.operators import bars, upserts
from barline.operators.series import DAY_MS, HOUR_MS, index_rows, add_windowed, time_bucket
from barline.plans.catalog.base import (
    DAILY_CTE,
    EV_CTE,
    HOURLY_CTE,
    R,
    daily,
    events_ms,
    hourly,
    query,
    rnd,
    rounded,
    table,
)
from barline.plans.catalog.scalars import FILLS_CTE
from barline.session import run_dir
from barline.sources import calendar, csv, lake, payloads

KEY = ["instrument_id"]


def landed_csv(spark, df, label, header=None, by=None):
    """Write text columns as headerless CSV, plus one inline header row when asked; ``by`` names the folders."""
    path = run_dir(spark, label)
    text = df.select(*[F.col(c).cast("string").alias(c) for c in df.columns])
    if header:
        text = text.unionByName(spark.createDataFrame([tuple(df.columns)], text.schema))
    writer = text.write if by is None else text.write.partitionBy(by)
    writer.csv(path)
    return path


# ------------------------------------------------------------------ Parquet tables


def candle_rows(spark, sf):
    b = hourly(spark, sf)
    return b.select(
        "instrument_id",
        F.lit("1h").alias("tf"),
        "ts",
        "open",
        "high",
        "low",
        "close",
        "volume",
        (F.col("volume") * 2).alias("quote_volume"),
        F.lit(None).cast("double").alias("taker_buy_volume"),
        "trades",
    )


@query(
    "src_01_read_candles",
    f"WITH {HOURLY_CTE} SELECT instrument_id, ts, open, close, trades FROM hourly WHERE instrument_id = 'click'",
)
def src_01(spark, sf):
    # some stored timestamps are microseconds; reading heals them
    path = run_dir(spark, "candles")
    bad = F.when(F.col("ts") % (5 * HOUR_MS) == 0, F.col("ts") * 1000).otherwise(F.col("ts"))
    lake.write_table(candle_rows(spark, sf).withColumn("ts", bad), path, ["tf", "instrument_id"])
    c = lake.read_candles(spark, path, "click", "1h")
    return c.select("instrument_id", "ts", "open", "close", "trades")


@query("src_02_read_table", "SELECT o_orderkey, o_custkey, o_totalprice FROM orders")
def src_02(spark, sf):
    schema = table(spark, sf, "orders").select("o_orderkey", "o_custkey", "o_totalprice").schema
    return lake.read_table(spark, f"{sf}/orders.parquet", schema)


@query(
    "src_03_write_partitions",
    "SELECT o_orderkey, o_orderpriority, CASE WHEN o_orderpriority = '5-LOW' THEN o_totalprice + 1 ELSE o_totalprice END AS o_totalprice FROM orders",
)
def src_03(spark, sf):
    # a rewrite of one partition leaves the others as they are
    path = run_dir(spark, "orders")
    o = table(spark, sf, "orders").select("o_orderkey", "o_orderpriority", "o_totalprice")
    lake.write_table(o, path, ["o_orderpriority"])
    low = o.filter(F.col("o_orderpriority") == "5-LOW").withColumn("o_totalprice", F.col("o_totalprice") + 1)
    lake.write_table(low, path, ["o_orderpriority"])
    return lake.read_table(spark, path, o.schema)


@query("src_04_file_details")
def src_04(spark, sf):
    return lake.file_details(spark, sf).select("key", "size")


@query("src_05_dataset_hash")
def src_05(spark, sf):
    return lake.dataset_hash(lake.file_details(spark, sf))


@query("src_05_folder_hashes")
def src_05_folders(spark, sf):
    return lake.folder_hashes(lake.file_details(spark, sf).select("key", "size"))


@query("src_05_content_hash")
def src_05_content(spark, sf):
    return lake.content_hash(table(spark, sf, "lineitem"))


@query(
    "src_06_mirror",
    "SELECT 'orders' AS name, CAST(count(*) AS BIGINT) AS n FROM orders UNION ALL SELECT 'events', CAST(count(*) AS BIGINT) FROM events",
)
def src_06(spark, sf):
    root = run_dir(spark, "curated")
    names = ["orders", "events"]
    lake.mirror({n: table(spark, sf, n).withColumn("_rowid", F.lit(1)) for n in names}, root)
    out = None
    for n in names:
        c = spark.read.parquet(f"{root}/{n}").agg(F.lit(n).alias("name"), F.count(F.lit(1)).alias("n"))
        out = c if out is None else out.unionByName(c)
    return out


@query(
    "src_07_backup_generations",
    """WITH d AS (SELECT DISTINCT strftime(ts, '%Y-%m-%d') AS backup_date FROM events) SELECT backup_date, CAST(rank AS BIGINT) AS rank, rank <= 7 AS kept FROM
       (SELECT *, row_number() OVER (ORDER BY backup_date DESC) AS rank FROM d WHERE backup_date <> '2024-01-10') UNION ALL SELECT '2024-01-10', 0, true""",
)
def src_07(spark, sf):
    d = table(spark, sf, "events").select(F.date_format("ts", "yyyy-MM-dd").alias("backup_date"))
    return lake.generations(d, "2024-01-10")


# -------------------------------------------------------------------- CSV archives


@query(
    "src_08_kline_csv",
    f"""WITH {DAILY_CTE} SELECT instrument_id, '1d' AS tf, ts, open, high, low, close, trades, {R("volume", 2)} AS volume FROM daily""",
)
def src_08(spark, sf):
    raw = daily(spark, sf).select(
        F.col("instrument_id").alias("symbol"),
        F.when(F.col("ts") % (2 * DAY_MS) == 0, F.col("ts") * 1000).otherwise(F.col("ts")).alias("open_time"),
        "open",
        "high",
        "low",
        "close",
        "volume",
        F.col("ts").alias("close_time"),
        F.col("volume").alias("quote_asset_volume"),
        F.col("trades").alias("number_of_trades"),
        F.lit(0).alias("taker_buy_base_asset_volume"),
        F.lit(0).alias("taker_buy_quote_asset_volume"),
        F.lit(0).alias("ignore"),
    )
    # one archive folder per symbol, as kline files do not name theirs
    folder = landed_csv(spark, raw, "klines", True, by="symbol")
    rows = csv.candles(csv.read_raw(spark, folder, csv.KLINE_COLUMNS), F.col("symbol"), "1d")
    out = rows.select("instrument_id", "tf", "ts", "open", "high", "low", "close", "trades", "volume")
    return rounded(out, "volume", digits=2)


@query("src_09_funding_csv", f"WITH {EV_CTE} SELECT 'X' AS instrument_id, ts, value AS rate FROM ev")
def src_09(spark, sf):
    raw = events_ms(spark, sf).select(
        F.col("ts").alias("calc_time"), F.lit(8).alias("funding_interval_hours"), F.col("value").alias("last_funding_rate")
    )
    return csv.funding(csv.read_raw(spark, landed_csv(spark, raw, "funding", True), csv.FUNDING_COLUMNS), "X")


def metric_rows(spark, sf):
    """Metrics CSV from hourly bars: every other row has a date string as its time."""
    b = hourly(spark, sf)
    shifted = F.col("ts") + F.when(F.col("trades") % 3 == 0, 300_000).otherwise(0)
    text = F.date_format(F.timestamp_millis(shifted), "yyyy-MM-dd HH:mm:ss")
    raw = b.select(
        F.when(F.col("trades") % 2 == 0, text).otherwise(shifted.cast("string")).alias("create_time"),
        F.col("instrument_id").alias("symbol"),
        F.col("open").alias("sum_open_interest"),
        F.col("close").alias("sum_open_interest_value"),
        F.lit(1.0).alias("count_toptrader_long_short_ratio"),
        F.when(F.col("trades") % 5 != 0, F.col("high")).alias("sum_toptrader_long_short_ratio"),
        (F.col("low") - 1.0).alias("count_long_short_ratio"),
        F.col("close").alias("sum_taker_long_short_vol_ratio"),
    )
    return csv.metrics(csv.read_raw(spark, landed_csv(spark, raw, "metrics", True), csv.METRICS_COLUMNS), F.col("symbol"))


METRIC_CTE = f"""{HOURLY_CTE}, mr AS (SELECT instrument_id, ts + CASE WHEN trades % 3 = 0 THEN 300000 ELSE 0 END AS ts, open, close, low, CASE WHEN trades % 5 <> 0 THEN high END AS high
  FROM hourly)"""


@query(
    "src_10_metrics_csv",
    f"WITH {METRIC_CTE} SELECT instrument_id, ts, open AS sum_open_interest, high AS sum_toptrader_long_short_ratio FROM mr",
)
def src_10(spark, sf):
    return metric_rows(spark, sf).select("instrument_id", "ts", "sum_open_interest", "sum_toptrader_long_short_ratio")


@query(
    "src_11_open_interest",
    f"WITH {METRIC_CTE} SELECT instrument_id, ts, open AS oi_base, close AS oi_usd FROM mr WHERE ts % 3600000 = 0",
)
def src_11(spark, sf):
    return csv.open_interest(metric_rows(spark, sf))


@query(
    "src_12_long_short_ratios",
    f"""WITH {METRIC_CTE}, u AS (SELECT instrument_id, ts, 'top_trader_position' AS ratio_type, high AS r FROM mr UNION ALL SELECT instrument_id, ts, 'all_account', low - 1 FROM mr
          UNION ALL SELECT instrument_id, ts, 'taker_volume', close FROM mr)
        SELECT instrument_id, ratio_type, ts, {R("r / (1 + r)")} AS long_ratio, {R("1 / (1 + r)")} AS short_ratio, {R("r")} AS ls_ratio FROM u
        WHERE r >= 0 AND ts % 3600000 = 0""",
)
def src_12(spark, sf):
    return rounded(csv.long_short_ratios(metric_rows(spark, sf)), "long_ratio", "short_ratio", "ls_ratio")


@query(
    "src_13_liquidation_csv",
    f"""WITH {FILLS_CTE} SELECT 'X' AS instrument_id, ts // 300000 * 300000 AS ts, {R("coalesce(sum(notional) FILTER (side = 'SELL'), 0)")} AS long_liq_usd,
        {R("coalesce(sum(notional) FILTER (side = 'BUY'), 0)")} AS short_liq_usd, CAST(count(*) AS BIGINT) AS events FROM fills GROUP BY 2""",
)
def src_13(spark, sf):
    from barline.plans.catalog.scalars import fills

    f = fills(spark, sf)
    empty = F.lit("")
    raw = f.select(
        F.col("ts").alias("time"),
        F.lit("X").alias("symbol"),
        "side",
        empty.alias("order_type"),
        empty.alias("time_in_force"),
        "original_quantity",
        "price",
        "average_price",
        empty.alias("order_status"),
        "last_fill_quantity",
        F.lit(0).alias("accumulated_fill_quantity"),
    )
    rows = csv.liquidation_fills(csv.read_raw(spark, landed_csv(spark, raw, "liq", True), csv.LIQUIDATION_COLUMNS), "X")
    b = bars.side_buckets(rows, KEY, F.col("side"), F.col("notional"), "SELL", "BUY")
    return rounded(b.drop("max_single_usd"), "long_liq_usd", "short_liq_usd")


# ------------------------------------------------------------------- JSON payloads


def documents(df, body, *keep):
    """One JSON document per row, landed as text lines and read back with its key."""
    spark = df.sparkSession
    path = run_dir(spark, "payloads")
    lines = df.select(F.to_json(F.struct(*keep, F.to_json(body).alias("payload"))).alias("value"))
    lines.write.text(path)
    fields = ", ".join(f"{k} {df.schema[k].dataType.simpleString()}" for k in keep)
    parsed = spark.read.text(path).select(F.from_json("value", f"{fields}, payload string").alias("_d"))
    return parsed.select("_d.*")


@query(
    "src_14_candle_arrays",
    f"""WITH {HOURLY_CTE} SELECT instrument_id, ts, open, high, low, close, CASE WHEN instrument_id = 'click' THEN close ELSE open END AS volume FROM hourly""",
)
def src_14(spark, sf):
    b = hourly(spark, sf)

    def bar(ts, confirm):
        cells = [ts, "open", "high", "low", "close", "open", "close", "high"]
        return F.array(*[(F.col(c) if isinstance(c, str) else c).cast("string") for c in cells], F.lit(confirm))

    body = F.struct(F.array(bar(F.col("ts") + HOUR_MS, "0"), bar(F.col("ts"), "1")).alias("data"))
    docs = documents(b, body, "instrument_id")
    c = payloads.candle_arrays(docs, KEY, F.col("instrument_id") == "click")
    return c.select("instrument_id", "ts", "open", "high", "low", "close", "volume")


@query(
    "src_15_funding_snapshot",
    f"""WITH {EV_CTE} SELECT event_id, ts, value AS rate, ts + 28800000 AS next_funding_time FROM ev WHERE value > 20""",
)
def src_15(spark, sf):
    e = events_ms(spark, sf).withColumn("observed", F.col("ts"))
    entry = F.struct(
        F.lit("X").alias("instId"),
        F.col("value").cast("string").alias("fundingRate"),
        (F.col("ts") + 28_800_000).cast("string").alias("fundingTime"),
    )
    # a small value stands for an empty response
    data = F.when(F.col("value") > 20, F.array(entry)).otherwise(F.array_except(F.array(entry), F.array(entry)))
    docs = documents(e, F.struct(data.alias("data")), "event_id", "observed")
    return payloads.funding_snapshot(docs, "observed", ["event_id"])


@query("src_16_open_interest_snapshot", f"WITH {EV_CTE} SELECT event_id, ts, value AS oi_base FROM ev")
def src_16(spark, sf):
    entry = F.struct(
        F.lit("X").alias("instId"),
        (F.col("value") * 100).cast("string").alias("oi"),
        F.col("value").cast("string").alias("oiCcy"),
        F.col("ts").cast("string").alias("ts"),
    )
    docs = documents(events_ms(spark, sf), F.struct(F.array(entry).alias("data")), "event_id")
    return payloads.open_interest_snapshot(docs, ["event_id"])


@query(
    "src_17_ratio_snapshot",
    f"""WITH {EV_CTE} SELECT event_id, 'all_account' AS ratio_type, ts, {R("value / (1 + value)")} AS long_ratio, {R("1 / (1 + value)")} AS short_ratio, value AS ls_ratio FROM ev""",
)
def src_17(spark, sf):
    pair = F.array(F.col("ts").cast("string"), F.col("value").cast("string"))
    docs = documents(events_ms(spark, sf), F.struct(F.array(pair, pair).alias("data")), "event_id")
    return rounded(payloads.ratio_snapshot(docs, ["event_id"]), "long_ratio", "short_ratio")


@query(
    "src_18_volatility_points",
    f"""WITH {EV_CTE} SELECT event_id, ts // 3600000 * 3600000 AS ts, value AS dvol FROM ev UNION ALL SELECT event_id, ts // 3600000 * 3600000 + 3600000, value + 1 FROM ev""",
)
def src_18(spark, sf):
    def point(ts, close):
        return F.array(ts.cast("double"), F.lit(0.0), F.lit(0.0), F.lit(0.0), close)

    pts = F.array(point(F.col("ts"), F.col("value")), point(F.col("ts") + HOUR_MS, F.col("value") + 1))
    body = F.struct(F.struct(pts.alias("data")).alias("result"))
    return payloads.volatility_points(documents(events_ms(spark, sf), body, "event_id"), ["event_id"])


@query(
    "src_18_points_and_rejects",
    f"""WITH {EV_CTE} SELECT event_id, CASE WHEN event_id % 7 < 4 THEN ts // 3600000 * 3600000 END AS ts, CASE WHEN event_id % 7 < 4 THEN value END AS dvol,
        CASE event_id % 7 WHEN 4 THEN 'no volatility points' WHEN 5 THEN 'not JSON' WHEN 6 THEN 'no document' END AS reason FROM ev""",
)
def src_18_rejects(spark, sf):
    # of seven documents one has no points, one is cut off and one is missing
    e = events_ms(spark, sf)
    point = F.array(F.col("ts").cast("double"), *[F.lit(0.0)] * 3, F.col("value"))
    whole = F.to_json(F.struct(F.struct(F.array(point).alias("data")).alias("result")))
    kind = F.col("event_id") % 7
    body = F.when(kind < 4, whole).when(kind == 4, '{"result":{"data":[]}}').when(kind == 5, F.expr("left('{\"result\":{', 9)"))
    parsed = payloads.volatility_points_or_rejects(e.select("event_id", body.alias("payload")), ["event_id"])
    return parsed.rows.unionByName(parsed.rejects.drop("payload"), allowMissingColumns=True)


@query(
    "src_19_sentiment_point",
    f"""WITH {EV_CTE} SELECT event_id, ts // 1000 * 1000 AS ts, value, CASE WHEN value > 50 THEN 'Greed' ELSE 'Fear' END AS classification FROM ev""",
)
def src_19(spark, sf):
    entry = F.struct(
        F.col("value").cast("string").alias("value"),
        F.when(F.col("value") > 50, "Greed").otherwise("Fear").alias("value_classification"),
        F.floor(F.col("ts") / 1000).cast("string").alias("timestamp"),
    )
    docs = documents(events_ms(spark, sf), F.struct(F.array(entry).alias("data")), "event_id")
    return payloads.sentiment_point(docs, ["event_id"])


@query(
    "src_20_daily_bar_arrays",
    f"""WITH {DAILY_CTE} SELECT instrument_id, ts, open, close FROM daily UNION ALL SELECT instrument_id, ts + 86400000, close, open FROM daily""",
)
def src_20(spark, sf):
    d = daily(spark, sf)
    sec = F.col("ts") / 1000
    null = F.lit(None).cast("double")
    quote = F.struct(F.array("open", null, "close").alias("open"), F.array("close", F.lit(1.0), "open").alias("close"))
    result = F.struct(
        F.array(*[(sec + 86_400 * i).cast("bigint") for i in (0, 7, 1)]).alias("timestamp"),
        F.struct(F.array(quote).alias("quote")).alias("indicators"),
    )
    body = F.struct(F.struct(F.array(result).alias("result")).alias("chart"))
    return payloads.daily_bar_arrays(documents(d, body, "instrument_id"), KEY)


@query(
    "src_21_token_mints",
    f"""WITH {EV_CTE} SELECT 'usdt_mint' AS event_type, ts // 1000 * 1000 AS ts, {R("event_id * 1000 / 1000000.0")} AS magnitude, 'usdt_mint:h' || event_id AS dedupe_key FROM ev
        WHERE instrument_id IN ('purchase', 'signup') AND value > 5""",
)
def src_21(spark, sf):
    e = events_ms(spark, sf)
    zero = F.lit(payloads.ZERO_ADDRESS)
    tx = F.struct(
        F.when(F.col("instrument_id").isin("purchase", "signup"), zero).otherwise("0xAB").alias("from"),
        (F.col("event_id") * 1000).cast("string").alias("value"),
        F.lit("6").alias("tokenDecimal"),
        F.floor(F.col("ts") / 1000).cast("string").alias("timeStamp"),
        F.concat(F.lit("h"), F.col("event_id").cast("string")).alias("hash"),
    )
    status = F.when(F.col("value") > 5, "1").otherwise("0")
    docs = documents(e, F.struct(status.alias("status"), F.array(tx).alias("result")), "event_id")
    return rounded(payloads.token_mints(docs).select("event_type", "ts", "magnitude", "dedupe_key"), "magnitude")


@query(
    "src_22_calendar_entries",
    """SELECT DISTINCT 'order_day' AS event_type, epoch_us(o_orderdate) // 1000 AS ts, 'order_day:' || strftime(o_orderdate, '%Y-%m-%d') AS dedupe_key FROM orders
       WHERE o_orderdate >= '2000-01-01'""",
)
def src_22(spark, sf):
    # a calendar of (type, date) entries inserted once per key, stored ones skipped
    o = table(spark, sf, "orders").select(
        F.lit("order_day").alias("event_type"), F.date_format("o_orderdate", "yyyy-MM-dd").alias("date")
    )
    entries = calendar.to_events(o)
    stored = entries.filter(F.col("ts") < 946_684_800_000)
    return upserts.insert_new(stored, entries, "dedupe_key", ["ts"]).select("event_type", "ts", "dedupe_key")


@query(
    "src_23_incremental_read",
    f"""WITH {DAILY_CTE}, wm AS (SELECT instrument_id, max(ts) + 86400000 AS f FROM daily WHERE ts < 946684800000 AND instrument_id <> '5-LOW' GROUP BY 1)
        SELECT d.instrument_id, d.ts FROM daily d LEFT JOIN wm USING (instrument_id) WHERE d.ts >= coalesce(f, 852076800000)""",
)
def src_23(spark, sf):
    # one key has no stored rows and starts at the default date (1997-01-01)
    d = daily(spark, sf).select("instrument_id", "ts")
    stored = d.filter((F.col("ts") < 946_684_800_000) & (F.col("instrument_id") != "5-LOW"))
    return lake.incremental(stored, d, KEY, "1997-01-01")


@query(
    "src_23_month_ranges",
    """SELECT o_orderkey, strftime(m, '%Y-%m') AS month FROM (SELECT o_orderkey, o_orderdate, unnest(generate_series(date_trunc('month', o_orderdate),
       date_trunc('month', TIMESTAMP '2001-09-15') - INTERVAL 1 MONTH, INTERVAL 1 MONTH)) AS m FROM orders)""",
)
def src_23_months(spark, sf):
    o = table(spark, sf, "orders").select(
        "o_orderkey", F.to_date("o_orderdate").alias("start"), F.to_date(F.lit("2001-09-15")).alias("end")
    )
    m = lake.month_range(o, "start", "end")
    return m.select("o_orderkey", F.date_format("month", "yyyy-MM").alias("month"))


@query("src_24_catalog")
def src_24(spark, sf):
    root = run_dir(spark, "lake")
    lake.write_table(table(spark, sf, "orders"), f"{root}/curated/orders")
    lake.write_table(hourly(spark, sf), f"{root}/features/hourly")
    return lake.catalog(spark, root).select("key", "size")


@query(
    "agg_03_payload_buckets",
    f"""WITH f AS (SELECT CASE event_type WHEN 'purchase' THEN 'BTC-USDT-SWAP' WHEN 'error' THEN 'ETH-USDT-SWAP' END AS inst, epoch_us(ts) // 1000 AS ts,
          value * CASE event_type WHEN 'purchase' THEN 0.01 ELSE 0.1 END * 50 AS n, user_id % 2 = 0 AS l FROM events WHERE event_type IN ('purchase', 'error') AND value > 5)
        SELECT inst, ts // 300000 * 300000 AS ts, {R("coalesce(sum(n) FILTER (l), 0)")} AS long_liq_usd, {R("coalesce(sum(n) FILTER (NOT l), 0)")} AS short_liq_usd,
          CAST(count(*) AS BIGINT) AS events, {R("max(n)")} AS max_single_usd FROM f GROUP BY 1, 2""",
)
def agg_03(spark, sf):
    # groups without details are skipped, unknown contracts give no rows
    e = events_ms(spark, sf)
    inst = F.when(F.col("instrument_id") == "purchase", "BTC-USDT-SWAP").when(
        F.col("instrument_id") == "error", "ETH-USDT-SWAP"
    )
    fill = F.struct(
        F.lit("50").alias("bkPx"),
        F.col("value").cast("string").alias("sz"),
        F.when(F.col("user_id") % 2 == 0, "long").otherwise("short").alias("posSide"),
        F.col("ts").cast("string").alias("ts"),
    )
    group = F.struct(F.when(F.col("value") > 5, F.array(fill)).alias("details"))
    named = e.withColumn("inst", F.coalesce(inst, F.lit("UNKNOWN")))
    docs = documents(named, F.struct(F.array(group).alias("data")), "inst")
    b = payloads.liquidation_buckets(docs, "inst", ["inst"])
    return rounded(b, "long_liq_usd", "short_liq_usd", "max_single_usd")


@query(
    "win_17_gap_events_from_payload",
    f"""WITH {DAILY_CTE}, l AS (SELECT instrument_id, ts, open, lag(ts) OVER w AS pt, lag(close) OVER w AS pc FROM daily WINDOW w AS (PARTITION BY instrument_id ORDER BY ts))
        SELECT instrument_id, ts, {R("abs((open - pc) / pc * 100)", 4)} AS magnitude, CAST(round((ts - pt) / 86400000.0) AS BIGINT) AS gap_days FROM l WHERE round((ts - pt) / 86400000.0) >= 2""",
)
def win_17_payload(spark, sf):
    d = daily(spark, sf).select("instrument_id", "ts", "open", "close")
    ix = index_rows(d, KEY, "ts", time_bucket("ts", 3650 * DAY_MS))
    prev = add_windowed(ix, KEY, lambda f: {"_pc": f.lag("close", 1), "_pt": f.lag("ts", 1)}, before=1)
    g = payloads.gap_events(prev, F.col("_pc"), F.col("_pt"), KEY)
    return g.select("instrument_id", "ts", rnd("magnitude", 4).alias("magnitude"), "gap_days")


