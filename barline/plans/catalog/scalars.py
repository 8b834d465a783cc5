"""Catalogue: scalar functions, filters and aggregates."""

from __future__ import annotations

from pyspark.sql import functions as F

from barline.functions import normal, scalar
from barline.operators import bars, explore
from barline.operators.series import DAY_MS, HOUR_MS, running, time_bucket
from barline.plans.catalog.base import (
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
    DAILY_CTE,
)

# ------------------------------------------------------------------ scalar functions


@query(
    "fn_01_date_keys",
    f"""WITH {EV_CTE} SELECT event_id, strftime(make_timestamp(ts * 1000), '%Y-%m-%d') AS dt,
        ts // 86400000 * 86400000 AS dt_ms FROM ev""",
)
def fn_01(spark, sf):
    e = events_ms(spark, sf).select("event_id", scalar.date_key("ts").alias("dt"))
    return e.withColumn("dt_ms", scalar.date_key_to_ms("dt"))


@query(
    "fn_02_hour_and_weekday",
    f"""WITH {EV_CTE} SELECT event_id, CAST(hour(make_timestamp(ts * 1000)) AS BIGINT) AS utc_hour,
        CAST(dayofweek(make_timestamp(ts * 1000)) AS BIGINT) AS utc_dow FROM ev""",
)
def fn_02(spark, sf):
    return events_ms(spark, sf).select(
        "event_id",
        scalar.utc_hour("ts").cast("bigint").alias("utc_hour"),
        scalar.utc_dow("ts").cast("bigint").alias("utc_dow"),
    )


@query(
    "fn_03_floor_and_add_days",
    f"""WITH {EV_CTE} SELECT event_id, ts // 900000 * 900000 AS slot, ts + 7 * 86400000::BIGINT AS next_week FROM ev""",
)
def fn_03(spark, sf):
    return events_ms(spark, sf).select(
        "event_id", scalar.floor_to("ts", 900_000).alias("slot"), scalar.add_days("ts", 7).alias("next_week")
    )


HORIZON_SQL = """p_partkey, CAST(p_size AS VARCHAR) || CASE p_partkey % 4 WHEN 0 THEN 'm' WHEN 1 THEN 'h'
  WHEN 2 THEN 'd' ELSE 'w' END AS horizon"""


@query(
    "fn_04_horizons",
    f"""WITH h AS (SELECT {HORIZON_SQL} FROM part), m AS (SELECT *, CASE right(horizon, 1)
          WHEN 'm' THEN 60000 WHEN 'h' THEN 3600000 WHEN 'd' THEN 86400000 END * CAST(rtrim(horizon, 'mhdw') AS BIGINT)
          AS horizon_ms FROM h)
        SELECT p_partkey, horizon, horizon_ms,
          CASE WHEN horizon_ms IS NULL THEN 1 ELSE greatest(1, (horizon_ms + 3599999) // 3600000) END AS horizon_bars
        FROM m""",
)
def fn_04(spark, sf):
    unit = F.element_at(F.array(*[F.lit(u) for u in "mhdw"]), (F.col("p_partkey") % 4 + 1).cast("int"))
    h = table(spark, sf, "part").select("p_partkey", F.concat(F.col("p_size").cast("string"), unit).alias("horizon"))
    return h.withColumns(
        {"horizon_ms": scalar.horizon_ms("horizon"), "horizon_bars": scalar.horizon_bars("horizon", HOUR_MS)}
    )


@query(
    "fn_05_return_bps",
    f"""WITH {HOURLY_CTE} SELECT instrument_id, ts, {R("(close / open - 1) * 10000", 4)} AS long_bps,
        {R("(open / close - 1) * 10000", 4)} AS short_bps FROM hourly""",
)
def fn_05(spark, sf):
    b = hourly(spark, sf)
    return b.select(
        "instrument_id",
        "ts",
        rnd(scalar.ret_bps("long", F.col("open"), F.col("close")), 4).alias("long_bps"),
        rnd(scalar.ret_bps("short", F.col("open"), F.col("close")), 4).alias("short_bps"),
    )


@query(
    "fn_06_round_trip_cost",
    f"""SELECT s_suppkey, {R("((s_suppkey % 10) + (s_nationkey / 4.0)) * 2")} AS cost_bps FROM supplier""",
)
def fn_06(spark, sf):
    model = F.to_json(
        F.struct(
            (F.col("s_suppkey") % 10).cast("double").alias("taker_bps"),
            (F.col("s_nationkey") / 4.0).alias("slippage_bps"),
            F.lit(True).alias("funding_included"),
        )
    )
    s = table(spark, sf, "supplier").select("s_suppkey", model.alias("cost_model"))
    return s.select("s_suppkey", rnd(scalar.round_trip_bps("cost_model")).alias("cost_bps"))


@query(
    "fn_07_normalize_ms",
    f"""WITH {EV_CTE} SELECT event_id, ts FROM ev""",
)
def fn_07(spark, sf):
    # every third row arrives in microseconds
    e = events_ms(spark, sf)
    mixed = e.withColumn("ts", F.when(F.col("event_id") % 3 == 0, F.col("ts") * 1000 + 7).otherwise(F.col("ts")))
    return mixed.select("event_id", scalar.normalize_ms("ts").alias("ts"))


@query(
    "fn_08_slug",
    """SELECT p_partkey, regexp_replace(regexp_replace(lower(' ' || p_name || ' / ' || p_brand || '!'), '[^a-z0-9]+', '-', 'g'),
       '(^-|-$)', '', 'g') AS slug FROM part""",
)
def fn_08(spark, sf):
    title = F.concat(F.lit(" "), "p_name", F.lit(" / "), "p_brand", F.lit("!"))
    return table(spark, sf, "part").select("p_partkey", scalar.slug(title).alias("slug"))


STREAM_ID_SQL = """CASE event_type WHEN 'click' THEN 'okx_rest:candles_1m:' WHEN 'view' THEN 'okx_rest:open_interest:'
  WHEN 'purchase' THEN 'deribit_rest:dvol:' WHEN 'signup' THEN 'alternative_me:fear_greed:' ELSE 'other:' END"""


def stream_id(event_type="event_type"):
    c = F.col(event_type)
    return (
        F.when(c == "click", "okx_rest:candles_1m:")
        .when(c == "view", "okx_rest:open_interest:")
        .when(c == "purchase", "deribit_rest:dvol:")
        .when(c == "signup", "alternative_me:fear_greed:")
        .otherwise("other:")
    )


@query(
    "fn_09_stream_cadence",
    f"""SELECT event_id, {STREAM_ID_SQL} || user_id AS stream_id, CASE event_type WHEN 'click' THEN 300000
        WHEN 'view' THEN 300000 WHEN 'purchase' THEN 3600000 ELSE 86400000 END::BIGINT AS cadence_ms FROM events""",
)
def fn_09(spark, sf):
    e = table(spark, sf, "events").select("event_id", F.concat(stream_id(), "user_id").alias("stream_id"))
    return e.withColumn("cadence_ms", scalar.cadence_ms("stream_id"))


@query(
    "fn_10_bare_feature_name",
    """SELECT p_partkey, 'ret_' || p_size || '.x' AS name FROM part""",
)
def fn_10(spark, sf):
    fid = F.concat(F.lit("v1.ret_"), F.col("p_size").cast("string"), F.lit(".x"))
    return table(spark, sf, "part").select("p_partkey", scalar.bare_feature_name(fid).alias("name"))


@query(
    "fn_11_numeric_columns",
    """SELECT unnest(['l_orderkey', 'l_partkey', 'l_suppkey', 'l_linenumber', 'l_quantity', 'l_extendedprice',
       'l_discount', 'l_tax']) AS column_name, (SELECT CAST(count(*) AS BIGINT) FROM lineitem) AS non_null""",
)
def fn_11(spark, sf):
    # the numeric columns of a table by its schema, with their non-null counts
    li = table(spark, sf, "lineitem")
    names = scalar.numeric_columns(li.schema)
    counts = li.agg(*[F.count(n).alias(n) for n in names])
    pairs = F.array(*[F.struct(F.lit(n).alias("column_name"), F.col(n).alias("non_null")) for n in names])
    return counts.select(F.explode(pairs).alias("_p")).select("_p.*")


WILSON_SQL = """(wins / n + 3.841458820694124 / (2 * n) {sign} 1.959963984540054 *
  sqrt((wins / n * (1 - wins / n) + 3.841458820694124 / (4 * n)) / n)) / (1 + 3.841458820694124 / n)"""


@query(
    "fn_12_wilson_interval",
    f"""WITH w AS (SELECT instrument, CAST(count(*) AS DOUBLE) AS n, CAST(count(*) FILTER (value > 50) AS DOUBLE) AS wins
          FROM (SELECT event_type || ':' || user_id AS instrument, value FROM events) GROUP BY 1)
        SELECT instrument, CAST(n AS BIGINT) AS n, {R("greatest(" + WILSON_SQL.format(sign="-") + ", 0)")} AS lo,
          {R("least(" + WILSON_SQL.format(sign="+") + ", 1)")} AS hi FROM w""",
)
def fn_12(spark, sf):
    e = events_ms(spark, sf).groupBy(F.concat_ws(":", "instrument_id", "user_id").alias("instrument"))
    w = e.agg(F.count(F.lit(1)).alias("n"), F.count(F.when(F.col("value") > 50, 1)).alias("wins"))
    return w.select(
        "instrument",
        "n",
        rnd(scalar.wilson_low(F.col("wins"), F.col("n"))).alias("lo"),
        rnd(scalar.wilson_high(F.col("wins"), F.col("n"))).alias("hi"),
    )


def cdf_sql(x: str) -> str:
    """The normal distribution in SQL by its own rational form."""
    num = "0.0352624965998911"
    for c in ("0.700383064443688", "6.37396220353165", "33.912866078383", "112.079291497871", "221.213596169931", "220.206867912376"):
        num = f"({num} * abs({x}) + {c})"
    den = "0.0883883476483184"
    for c in ("1.75566716318264", "16.064177579207", "86.7807322029461", "296.564248779674", "637.333633378831",
              "793.826512519948", "440.413735824752"):
        den = f"({den} * abs({x}) + {c})"
    tail = (
        f"CASE WHEN abs({x}) < 7.07106781186547 THEN exp(-pow(abs({x}), 2) / 2) * {num} / {den} ELSE "
        f"exp(-pow(abs({x}), 2) / 2) / (abs({x}) + 1 / (abs({x}) + 2 / (abs({x}) + 3 / (abs({x}) + 4 / (abs({x}) + 0.65))))) / 2.5066282746310002 END"
    )
    return f"(CASE WHEN {x} > 0 THEN 1 - ({tail}) ELSE {tail} END)"


@query(
    "fn_13_normal_cdf_and_quantile",
    f"""WITH z AS (SELECT c_custkey, (c_acctbal - 4500) / 1500.0 AS x FROM customer)
        SELECT c_custkey, {R(cdf_sql("x"))} AS cdf, {R("x", 4)} AS back FROM z""",
)
def fn_13(spark, sf):
    z = table(spark, sf, "customer").select("c_custkey", ((F.col("c_acctbal") - 4500) / 1500.0).alias("x"))
    p = z.withColumn("cdf", normal.norm_cdf(F.col("x")))
    return p.select("c_custkey", rnd("cdf").alias("cdf"), rnd(normal.norm_ppf(F.col("cdf")), 4).alias("back"))


@query(
    "fn_14_regime_label",
    """SELECT o_orderkey, CASE WHEN o_orderstatus = 'P' THEN 'unknown' ELSE
       CASE WHEN o_totalprice > 250000 THEN 'up' ELSE 'down' END || '_' || CASE WHEN o_orderstatus = 'F' THEN 'low'
       ELSE 'high' END || '_normal' END AS regime_label FROM orders""",
)
def fn_14(spark, sf):
    regime = F.when(
        F.col("o_orderstatus") != "P",
        F.struct(
            F.when(F.col("o_totalprice") > 250_000, "up").otherwise("down").alias("trend"),
            F.when(F.col("o_orderstatus") == "F", "low").otherwise("high").alias("vol"),
            F.lit("normal").alias("liquidity"),
        ),
    )
    o = table(spark, sf, "orders").select("o_orderkey", regime.alias("r"))
    return o.select("o_orderkey", scalar.regime_label("r").alias("regime_label"))


# -------------------------------------------------------------------------- filters


@query(
    "fil_01_where_text",
    """SELECT l_orderkey, l_partkey, l_suppkey, CAST(l_linenumber AS BIGINT) AS l_linenumber, l_extendedprice FROM lineitem
       WHERE l_discount > 0.05 AND l_returnflag = 'R'""",
)
def fil_01(spark, sf):
    picked = explore.where(table(spark, sf, "lineitem"), "l_discount > 0.05 AND l_returnflag = 'R'")
    return picked.select(
        "l_orderkey", "l_partkey", "l_suppkey", F.col("l_linenumber").cast("bigint").alias("l_linenumber"), "l_extendedprice"
    )


@query(
    "fil_02_ranges",
    f"""WITH {EV_CTE} SELECT event_id, ts, strftime(make_timestamp(ts * 1000), '%Y-%m-%d') AS dt FROM ev
        WHERE ts >= 1704700800000 AND ts < 1705900800000
        AND strftime(make_timestamp(ts * 1000), '%Y-%m-%d') BETWEEN '2024-01-10' AND '2024-01-15'""",
)
def fil_02(spark, sf):
    e = explore.ts_range(events_ms(spark, sf), 1_704_700_800_000, 1_705_900_800_000)
    dated = e.select("event_id", "ts", scalar.date_key("ts").alias("dt"))
    return explore.date_range(dated, "2024-01-10", "2024-01-15")


@query(
    "fil_03_optional_filters",
    """SELECT p_partkey, p_name, p_brand FROM part WHERE p_type = 'SMALL' AND lower(p_name) LIKE '%widget%'""",
)
def fil_03(spark, sf):
    p = explore.optional_filters(table(spark, sf, "part"), {"p_type": "SMALL", "p_brand": None}, ("p_name", "WIDGET"))
    return p.select("p_partkey", "p_name", "p_brand")


# ----------------------------------------------------------------------- aggregates


@query(
    "agg_01_ohlcv_bars",
    f"""WITH {HOURLY_CTE} SELECT instrument_id, ts, open, high, low, close, {R("volume", 4)} AS volume, trades FROM hourly""",
)
def agg_01(spark, sf):
    return rounded(hourly(spark, sf), "volume", digits=4)


def fills(spark, sf):
    """purchase = SELL, error = BUY; executed part missing on every fourth fill."""
    e = events_ms(spark, sf).filter(F.col("instrument_id").isin("purchase", "error"))
    return e.select(
        F.concat(F.lit("I"), (F.col("user_id") % 3).cast("string")).alias("instrument_id"),
        "ts",
        F.when(F.col("instrument_id") == "purchase", "SELL").otherwise("BUY").alias("side"),
        F.when(F.col("event_id") % 4 != 0, F.col("value")).alias("average_price"),
        F.lit(2.0).alias("last_fill_quantity"),
        F.col("value").alias("price"),
        F.lit(3.0).alias("original_quantity"),
    )


FILLS_CTE = """
fills AS (SELECT 'I' || (user_id % 3) AS instrument_id, epoch_us(ts) // 1000 AS ts,
  CASE event_type WHEN 'purchase' THEN 'SELL' ELSE 'BUY' END AS side,
  CASE WHEN event_id % 4 <> 0 AND value * 2 > 0 THEN value * 2 ELSE value * 3 END AS notional
  FROM events WHERE event_type IN ('purchase', 'error')),
buckets AS (SELECT instrument_id, ts // 300000 * 300000 AS ts,
  coalesce(sum(notional) FILTER (side = 'SELL'), 0) AS long_liq_usd,
  coalesce(sum(notional) FILTER (side = 'BUY'), 0) AS short_liq_usd,
  CAST(count(*) AS BIGINT) AS events, max(notional) AS max_single_usd FROM fills GROUP BY 1, 2)
"""


def fill_buckets(spark, sf):
    f = fills(spark, sf)
    notional = bars.fill_notional(
        F.col("average_price"), F.col("last_fill_quantity"), F.col("price"), F.col("original_quantity")
    )
    return bars.side_buckets(f, ["instrument_id"], F.col("side"), notional, "SELL", "BUY")


@query(
    "agg_02_side_buckets",
    f"""WITH {FILLS_CTE} SELECT instrument_id, ts, {R("long_liq_usd")} AS long_liq_usd,
        {R("short_liq_usd")} AS short_liq_usd, events, {R("max_single_usd")} AS max_single_usd FROM buckets""",
)
def agg_02(spark, sf):
    return rounded(fill_buckets(spark, sf), "long_liq_usd", "short_liq_usd", "max_single_usd")


@query(
    "agg_04_hourly_notional",
    f"""WITH {FILLS_CTE}, src AS (SELECT *, CASE WHEN ts % 600000 = 0 THEN 'a' ELSE 'b' END AS source_id FROM buckets)
        SELECT instrument_id, ts // 3600000 * 3600000 AS ts, {R("sum(long_liq_usd) + sum(short_liq_usd)")} AS liq_notional_1h
        FROM src WHERE source_id = 'a' GROUP BY 1, 2""",
)
def agg_04(spark, sf):
    b = fill_buckets(spark, sf).withColumn("source_id", F.when(F.col("ts") % 600_000 == 0, "a").otherwise("b"))
    return rounded(bars.hourly_notional(b, ["instrument_id"], "a"), "liq_notional_1h")


@query(
    "agg_05_pivot_mean",
    f"""SELECT epoch_us(l_shipdate) // 1000 AS ts, {R("avg(l_discount) FILTER (l_returnflag = 'A')")} AS ls_all_account,
        {R("avg(l_discount) FILTER (l_returnflag = 'R')")} AS ls_top_trader FROM lineitem
        WHERE l_returnflag IN ('A', 'R') GROUP BY 1""",
)
def agg_05(spark, sf):
    li = table(spark, sf, "lineitem").select(scalar.ms("l_shipdate").alias("ts"), "l_returnflag", "l_discount")
    wide = bars.pivot_mean(li, ["ts"], "l_returnflag", "l_discount", {"A": "ls_all_account", "R": "ls_top_trader"})
    return rounded(wide, "ls_all_account", "ls_top_trader")


@query(
    "agg_06_summary",
    f"""SELECT CAST(count(*) AS BIGINT) AS n, min(l_extendedprice) AS mn, max(l_extendedprice) AS mx,
        {R("avg(l_extendedprice)", 4)} AS avg, {R("stddev_samp(l_extendedprice)", 4)} AS sd
        FROM lineitem""",
)
def agg_06(spark, sf):
    s = explore.summary(table(spark, sf, "lineitem"), "l_extendedprice")
    return rounded(s, "avg", "sd", digits=4)


@query(
    "agg_07_histogram",
    """WITH b AS (SELECT min(value) AS mn, max(value) AS mx FROM events)
       SELECT CAST(CASE WHEN mx = mn THEN 0 ELSE least(19, floor((value - mn) / (mx - mn) * 20)) END AS BIGINT) AS bucket,
       CAST(count(*) AS BIGINT) AS c FROM events, b GROUP BY 1""",
)
def agg_07(spark, sf):
    return explore.histogram(table(spark, sf, "events"), "value")


@query("agg_08_filtered_count", "SELECT CAST(count(*) AS BIGINT) AS n FROM orders WHERE o_totalprice > 300000")
def agg_08(spark, sf):
    return explore.row_count(table(spark, sf, "orders"), "o_totalprice > 300000")


@query(
    "agg_10_distinct_types",
    """SELECT DISTINCT event_type, EXISTS (SELECT 1 FROM orders) AS has_orders,
       EXISTS (SELECT 1 FROM orders WHERE o_totalprice < 0) AS has_negative FROM events""",
)
def agg_10(spark, sf):
    o = table(spark, sf, "orders")
    some = o.agg((F.count(F.lit(1)) > 0).alias("x")).scalar()
    negative = o.agg((F.count(F.when(F.col("o_totalprice") < 0, 1)) > 0).alias("x")).scalar()
    types = table(spark, sf, "events").select("event_type").distinct()
    return types.select("event_type", some.alias("has_orders"), negative.alias("has_negative"))


@query(
    "agg_13_mergeable_moments",
    f"""SELECT event_type AS instrument_id, CAST(count(*) AS BIGINT) AS n, {R("avg(value)")} AS mean,
        {R("var_samp(value)", 4)} AS variance, {R("stddev_samp(value)")} AS stddev FROM events GROUP BY 1""",
)
def agg_13(spark, sf):
    # one (n, mean, m2) row per user and type, merged to one per type
    e = events_ms(spark, sf)
    parts = e.groupBy("instrument_id", "user_id").agg(
        F.count(F.lit(1)).alias("n"), F.avg("value").alias("mean"), (F.var_pop("value") * F.count(F.lit(1))).alias("m2")
    )
    merged = bars.merge_moments(parts, ["instrument_id"]).withColumns(bars.moment_stats())
    out = merged.select("instrument_id", "n", "mean", "variance", "stddev")
    return rounded(rounded(out, "mean", "stddev"), "variance", digits=4)


@query(
    "agg_13_expanding_z",
    f"""WITH {HOURLY_CTE}, m AS (SELECT instrument_id, ts, close, count(close) OVER w AS n, avg(close) OVER w AS mean,
          stddev_samp(close) OVER w AS sd FROM hx WINDOW w AS (PARTITION BY instrument_id ORDER BY pos
          ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))
        SELECT instrument_id, ts, CASE WHEN sd > 0 THEN {R("(close - mean) / sd", 5)} ELSE 0.0 END AS z FROM m""",
)
def agg_13_z(spark, sf):
    # running sums of x and x^2 around a fixed level, so no key is gathered
    b = hourly(spark, sf)
    x = F.col("close") - 50.0
    r = running(
        b,
        ["instrument_id"],
        "ts",
        time_bucket("ts", 7 * DAY_MS),
        {"_n": ("sum", F.lit(1)), "_s": ("sum", x), "_q": ("sum", x * x)},
    )
    mean = F.col("_s") / F.col("_n")
    var = F.when(F.col("_n") > 1, (F.col("_q") - F.col("_n") * mean * mean) / (F.col("_n") - 1)).otherwise(F.lit(0.0))
    z = F.when(var > 0, (x - mean) / F.sqrt(var)).otherwise(F.lit(0.0))
    return r.select("instrument_id", "ts", rnd(z, 5).alias("z"))


@query(
    "agg_01_daily_bars",
    f"""WITH {DAILY_CTE} SELECT instrument_id, ts, open, high, low, close, {R("volume", 2)} AS volume, trades FROM daily""",
)
def agg_01_daily(spark, sf):
    return rounded(daily(spark, sf), "volume", digits=2)
