"""Catalogue: rolling features."""

from __future__ import annotations

from pyspark.sql import functions as F

from barline.operators import features as ft
from barline.operators import regimes, stats
from barline.operators.asof import merge_slow_series
from barline.operators.series import add_windowed
from barline.plans.catalog.base import (
    DAILY_CTE,
    HOURLY_CTE,
    R,
    daily_ix,
    events_ms,
    hourly,
    hourly_ix,
    query,
    rnd,
    table,
)
from barline.functions.scalar import ms
from barline.session import materialize
from barline.sources.payloads import gap_events

KEY = ["instrument_id"]


def one(spark, sf, build, before, digits=6, indexed=hourly_ix):
    steps = build if isinstance(build, list) else [lambda f: {"x": build(f)}]
    out = add_windowed(indexed(spark, sf), KEY, steps, before=before)
    return out.select("instrument_id", "ts", rnd("x", digits).alias("x"))


def hourly_sql(expr: str, digits: int = 6, extra: str = "") -> str:
    """x per hourly bar; windows are named by width: w24 = last 24 rows."""
    return f"""WITH {HOURLY_CTE} {extra} SELECT instrument_id, ts, {R(expr, digits)} AS x FROM {'hx' if not extra else 'src'}
      WINDOW o AS (PARTITION BY instrument_id ORDER BY pos),
      w7 AS (PARTITION BY instrument_id ORDER BY pos ROWS BETWEEN 6 PRECEDING AND CURRENT ROW),
      w24 AS (PARTITION BY instrument_id ORDER BY pos ROWS BETWEEN 23 PRECEDING AND CURRENT ROW),
      w72 AS (PARTITION BY instrument_id ORDER BY pos ROWS BETWEEN 71 PRECEDING AND CURRENT ROW)"""


@query("win_01_chg", hourly_sql("close - lag(close, 24) OVER o"))
def win_01(spark, sf):
    return one(spark, sf, lambda f: ft.chg(f, "close", 24), 24)


@query("win_02_pctchg", hourly_sql("(close / lag(close, 24) OVER o - 1) * 100", 4))
def win_02(spark, sf):
    return one(spark, sf, lambda f: ft.pctchg(f, "close", 24), 24, 4)


@query(
    "win_03_z",
    hourly_sql("CASE WHEN pos >= 71 THEN (close - avg(close) OVER w72) / stddev_pop(close) OVER w72 END"),
)
def win_03(spark, sf):
    return one(spark, sf, lambda f: ft.z(f, "close", 72), 71)


PCTILE_SQL = f"""WITH {HOURLY_CTE}, l AS (SELECT instrument_id, ts, pos, close, list(close) OVER (PARTITION BY instrument_id
  ORDER BY pos ROWS BETWEEN {{w1}} PRECEDING AND CURRENT ROW) AS xs FROM hx)
  SELECT instrument_id, ts, CASE WHEN pos >= {{w1}} THEN {R("100.0 * len(list_filter(xs, lambda v: v <= close)) / {w}")} END AS x FROM l"""


@query("win_04_pctile_short", PCTILE_SQL.format(w=24, w1=23))
def win_04_short(spark, sf):
    return one(spark, sf, lambda f: ft.pctile_expr(f, "close", 24), 23)


@query("win_04_pctile_long", PCTILE_SQL.format(w=240, w1=239))
def win_04_long(spark, sf):
    ranked = ft.add_ranks(hourly_ix(spark, sf).select("instrument_id", "ts", "pos", "close"), KEY, {"x": ("close", 240)})
    return ranked.select("instrument_id", "ts", rnd("x").alias("x"))


@query(
    "win_05_ma_ratio",
    hourly_sql("CASE WHEN pos >= 71 THEN avg(close) OVER w24 / avg(close) OVER w72 END"),
)
def win_05(spark, sf):
    return one(spark, sf, lambda f: ft.ma_ratio(f, "close", 24, 72), 71)


@query(
    "win_06_realized_vol",
    hourly_sql(
        "CASE WHEN count(lr) OVER w24 = 24 THEN stddev_pop(lr) OVER w24 END",
        6,
        ", src AS (SELECT *, ln(close / lag(close) OVER (PARTITION BY instrument_id ORDER BY pos)) AS lr FROM hx)",
    ),
)
def win_06(spark, sf):
    return one(
        spark,
        sf,
        [lambda f: {"_lr": ft.log_return(f, "close")}, lambda f: {"x": ft.std_of_log_return(f, "_lr", 24)}],
        24,
    )


TR_SQL = """, src AS (SELECT *, greatest(high - low, coalesce(abs(high - pc), 0), coalesce(abs(low - pc), 0)) AS tr FROM
  (SELECT *, lag(close) OVER (PARTITION BY instrument_id ORDER BY pos) AS pc FROM hx))"""


@query("win_07_atr", hourly_sql("CASE WHEN pos >= 23 THEN avg(tr) OVER w24 END", 6, TR_SQL))
def win_07(spark, sf):
    return one(
        spark,
        sf,
        [lambda f: {"_tr": ft.true_range(f, "high", "low", "close")}, lambda f: {"x": ft.atr_of(f, "_tr", 24)}],
        24,
    )


@query(
    "win_08_sma_dist",
    hourly_sql("CASE WHEN pos >= 71 THEN (close - avg(close) OVER w72) / avg(close) OVER w72 * 100 END"),
)
def win_08(spark, sf):
    return one(spark, sf, lambda f: ft.sma_dist_pct(f, "close", 72), 71)


@query(
    "win_09_high_dist",
    hourly_sql("CASE WHEN pos >= 23 THEN (close - max(high) OVER w24) / max(high) OVER w24 * 100 END"),
)
def win_09(spark, sf):
    return one(spark, sf, lambda f: ft.rolling_high_dist(f, "high", "close", 24), 23)


@query(
    "win_10_rolling_ratio",
    hourly_sql("CASE WHEN pos >= 23 THEN sum(low) OVER w24 / sum(high) OVER w24 END"),
)
def win_10(spark, sf):
    return one(spark, sf, lambda f: ft.rolling_ratio(f, "low", "high", 24), 23)


@query("win_11_rolling_sum", hourly_sql("CASE WHEN pos >= 23 THEN sum(volume) OVER w24 END", 4))
def win_11(spark, sf):
    return one(spark, sf, lambda f: ft.rolling_sum(f, "volume", 24), 23, 4)


# feature frame: bars plus slow series taken from the other tables' events


def feature_bars(spark, sf):
    """Hourly bars with taker volume and the four slow series merged in."""
    e = events_ms(spark, sf)
    taker = (
        e.filter(F.col("user_id") % 2 == 0)
        .groupBy("instrument_id", (F.floor(F.col("ts") / 3_600_000) * 3_600_000).cast("bigint").alias("ts"))
        .agg(F.sum("value").alias("taker_buy_volume"))
    )
    b = hourly(spark, sf).join(taker, [*KEY, "ts"], "left")
    ratios = e.select(
        "instrument_id",
        "ts",
        F.when(F.col("user_id") % 2 == 0, "all_account").otherwise("top_trader_position").alias("ratio_type"),
        F.col("value").alias("ls_ratio"),
    )
    liq = e.filter(F.col("value") > 100).groupBy(
        "instrument_id", (F.floor(F.col("ts") / 3_600_000) * 3_600_000).cast("bigint").alias("ts")
    ).agg(F.sum("value").alias("liq_notional_1h"))
    return merge_slow_series(
        b.withColumn("taker_buy_volume", F.coalesce("taker_buy_volume", F.lit(0.0))),
        KEY,
        e.select("instrument_id", "ts", F.col("value").alias("rate")),
        e.select("instrument_id", "ts", (F.col("value") + 10).alias("oi_base")),
        ratios,
        liq,
    )


SLOW_CTE = HOURLY_CTE + """,
taker AS (SELECT instrument_id, ts // 3600000 * 3600000 AS ts, sum(value) AS taker_buy_volume FROM ev WHERE user_id % 2 = 0 GROUP BY 1, 2),
slow AS (SELECT * FROM ev),
ls AS (SELECT instrument_id, ts, avg(value) FILTER (user_id % 2 = 0) AS ls_all_account,
  avg(value) FILTER (user_id % 2 = 1) AS ls_top_trader_position FROM ev GROUP BY 1, 2),
liq AS (SELECT instrument_id, ts // 3600000 * 3600000 AS ts, sum(value) AS liq_notional_1h FROM ev WHERE value > 100 GROUP BY 1, 2),
fb AS (SELECT h.*, coalesce(t.taker_buy_volume, 0) AS taker_buy_volume, s.value AS funding_rate, s.value + 10 AS oi_base,
  l.ls_all_account, l.ls_top_trader_position, coalesce(q.liq_notional_1h, 0) AS liq_notional_1h
  FROM hx h LEFT JOIN taker t USING (instrument_id, ts)
  ASOF LEFT JOIN slow s ON h.instrument_id = s.instrument_id AND h.ts >= s.ts
  ASOF LEFT JOIN ls l ON h.instrument_id = l.instrument_id AND h.ts >= l.ts
  LEFT JOIN liq q ON h.instrument_id = q.instrument_id AND h.ts = q.ts)
"""


@query(
    "jn_01_merge_slow_series",
    f"""WITH {SLOW_CTE} SELECT instrument_id, ts, funding_rate, oi_base, {R("ls_all_account")} AS ls_all_account,
        {R("ls_top_trader_position")} AS ls_top_trader_position, {R("liq_notional_1h")} AS liq_notional_1h FROM fb""",
)
def jn_01_slow(spark, sf):
    b = feature_bars(spark, sf)
    return b.select(
        "instrument_id",
        "ts",
        "funding_rate",
        "oi_base",
        rnd("ls_all_account").alias("ls_all_account"),
        rnd("ls_top_trader_position").alias("ls_top_trader_position"),
        rnd("liq_notional_1h").alias("liq_notional_1h"),
    )


def rows(n):
    return f"(PARTITION BY instrument_id ORDER BY pos ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)"


def full(agg, col, n):
    return f"CASE WHEN count({col}) OVER {rows(n)} = {n} THEN {agg}({col}) OVER {rows(n)} END"


REGISTRY_SQL = f"""WITH {SLOW_CTE},
a AS (SELECT *, lag(close) OVER o AS pc, lag(close, 24) OVER o AS c24, lag(funding_rate, 24) OVER o AS f24,
  lag(oi_base, 24) OVER o AS o24 FROM fb WINDOW o AS (PARTITION BY instrument_id ORDER BY pos)),
b AS (SELECT *, ln(close / pc) AS lr, greatest(high - low, coalesce(abs(high - pc), 0), coalesce(abs(low - pc), 0)) AS tr FROM a)
SELECT instrument_id, ts, {R("(close / c24 - 1) * 100", 4)} AS ret_24h,
  {R(full("stddev_pop", "lr", 24))} AS rv_24h,
  CAST(NULL AS DOUBLE) AS rv_30d_pctile_1y,
  {R(full("avg", "tr", 336))} AS atr_14d,
  CAST(NULL AS DOUBLE) AS sma200_dist_pct,
  {R(f"(close - ({full('max', 'high', 24)})) / ({full('max', 'high', 24)}) * 100")} AS high_24h_dist,
  {R(f"(close - ({full('max', 'high', 168)})) / ({full('max', 'high', 168)}) * 100")} AS weekly_high_dist,
  {R(f"({full('sum', 'taker_buy_volume', 24)}) / ({full('sum', 'volume', 24)})")} AS taker_buy_ratio_24h,
  CAST(NULL AS DOUBLE) AS vol_ma_ratio_7_30, CAST(NULL AS DOUBLE) AS funding_z_30d,
  {R("funding_rate - f24")} AS funding_chg_24h, {R("(oi_base / o24 - 1) * 100", 4)} AS oi_chg_24h,
  CAST(NULL AS DOUBLE) AS oi_pctile_1y, CAST(NULL AS DOUBLE) AS ls_all_account_z_30d,
  CAST(NULL AS DOUBLE) AS ls_top_trader_z_30d, {R(full("sum", "liq_notional_1h", 24), 4)} AS liq_notional_24h FROM b"""


@query("win_12_feature_registry", REGISTRY_SQL)
def win_12(spark, sf):
    # the long windows (30 days of hours and more) are NULL on a 30-day sample on both sides
    from barline.operators.series import DAY_MS, index_rows, time_bucket

    bars = materialize(feature_bars(spark, sf), "feature_bars")
    ix = index_rows(bars, KEY, "ts", time_bucket("ts", 365 * DAY_MS))
    f = ft.compute_features(ix, KEY)
    four = {"ret_24h", "oi_chg_24h", "liq_notional_24h"}
    return f.select(
        "instrument_id", "ts", *[rnd(n.name, 4 if n.name in four else 6).alias(n.name) for n in ft.registered()]
    )


def long_bars(spark, sf):
    """Orders as hourly bars of a long and of a young instrument: more hours than the longest feature looks back.

    Roots keep sums off the decimal grid, where rounding for the comparison would meet ties.
    """
    o = table(spark, sf, "orders")
    key, cust, price = F.col("o_orderkey"), F.col("o_custkey"), F.col("o_totalprice")
    volume = 1.0 + F.sqrt(cust % 97)
    return o.select(
        F.when(cust % 8 == 0, "young").otherwise("old").alias("instrument_id"),
        (key * 3_600_000).alias("ts"),
        (price * (1 - F.sqrt(cust % 11) / 40.0)).alias("open"),
        (price * (1 + F.sqrt(key % 9) / 30.0)).alias("high"),
        (price * (1 - F.sqrt(cust % 11) / 40.0 - F.sqrt(key % 3) / 50.0)).alias("low"),
        price.alias("close"),
        volume.alias("volume"),
        (volume * (key % 5) / 4.0).alias("taker_buy_volume"),
        ((key % 13 - 6) / 10_000.0).alias("funding_rate"),
        (1000.0 + 10.0 * F.sqrt(cust % 1009)).alias("oi_base"),
        (1.0 + (key % 17) / 10.0).alias("ls_all_account"),
        (1.0 + (cust % 19) / 10.0).alias("ls_top_trader_position"),
        F.when(key % 10 == 0, price).otherwise(0.0).alias("liq_notional_1h"),
    )


LONG_CTE = """
lb AS (SELECT CASE WHEN o_custkey % 8 = 0 THEN 'young' ELSE 'old' END AS instrument_id, o_orderkey * 3600000 AS ts,
    o_totalprice * (1 - sqrt(o_custkey % 11) / 40.0::DOUBLE) AS open, o_totalprice * (1 + sqrt(o_orderkey % 9) / 30.0::DOUBLE) AS high,
    o_totalprice * (1 - sqrt(o_custkey % 11) / 40.0::DOUBLE - sqrt(o_orderkey % 3) / 50.0::DOUBLE) AS low, o_totalprice AS close,
    1.0::DOUBLE + sqrt(o_custkey % 97) AS volume, (o_orderkey % 13 - 6) / 10000.0::DOUBLE AS funding_rate, 1000.0::DOUBLE + 10.0::DOUBLE * sqrt(o_custkey % 1009) AS oi_base,
    1.0::DOUBLE + (o_orderkey % 17) / 10.0::DOUBLE AS ls_all, 1.0::DOUBLE + (o_custkey % 19) / 10.0::DOUBLE AS ls_top,
    CASE WHEN o_orderkey % 10 = 0 THEN o_totalprice ELSE 0 END AS liq, o_orderkey % 5 AS part FROM orders),
lx AS (SELECT *, volume * part / 4.0::DOUBLE AS taker, CAST(row_number() OVER (PARTITION BY instrument_id ORDER BY ts) - 1 AS BIGINT) AS pos FROM lb)
"""


def zscore(col, n):
    return f"({col} - ({full('avg', col, n)})) / ({full('stddev_pop', col, n)})"


def rank_100(col, n):
    return f"CASE WHEN count({col}) OVER {rows(n)} = {n} THEN 100 * cume_dist(ORDER BY {col}) OVER {rows(n)} END"


LONG_FEATURES_CTE = f"""{LONG_CTE},
la AS (SELECT *, lag(close) OVER o AS pc, lag(close, 24) OVER o AS c24, lag(funding_rate, 24) OVER o AS f24, lag(oi_base, 24) OVER o AS o24
  FROM lx WINDOW o AS (PARTITION BY instrument_id ORDER BY pos)),
lr AS (SELECT *, ln(close / pc) AS lr, greatest(high - low, coalesce(abs(high - pc), 0), coalesce(abs(low - pc), 0)) AS tr FROM la),
lv AS (SELECT *, {full("stddev_pop", "lr", 720)} AS rv30 FROM lr),
lf AS (SELECT instrument_id, ts, pos, {R("(close / c24 - 1) * 100", 4)} AS ret_24h,
  {R(full("stddev_pop", "lr", 24))} AS rv_24h,
  {R(rank_100("rv30", 8760))} AS rv_30d_pctile_1y,
  {R(full("avg", "tr", 336), 4)} AS atr_14d,
  {R(f"(close / ({full('avg', 'close', 4800)}) - 1) * 100", 4)} AS sma200_dist_pct,
  {R(f"(close / ({full('max', 'high', 24)}) - 1) * 100")} AS high_24h_dist,
  {R(f"(close / ({full('max', 'high', 168)}) - 1) * 100")} AS weekly_high_dist,
  {R(f"({full('sum', 'taker', 24)}) / ({full('sum', 'volume', 24)})")} AS taker_buy_ratio_24h,
  {R(f"({full('avg', 'volume', 168)}) / ({full('avg', 'volume', 720)})")} AS vol_ma_ratio_7_30,
  {R(zscore("funding_rate", 720))} AS funding_z_30d,
  {R("funding_rate - f24")} AS funding_chg_24h, {R("(oi_base / o24 - 1) * 100", 4)} AS oi_chg_24h,
  {R(rank_100("oi_base", 8760))} AS oi_pctile_1y,
  {R(zscore("ls_all", 720))} AS ls_all_account_z_30d,
  {R(zscore("ls_top", 720))} AS ls_top_trader_z_30d, {R(full("sum", "liq", 24), 4)} AS liq_notional_24h FROM lv)
"""


def long_features(spark, sf):
    """The indexed long bars and their rounded features."""
    from barline.operators.series import DAY_MS, index_rows, time_bucket

    bars = materialize(index_rows(long_bars(spark, sf), KEY, "ts", time_bucket("ts", 3650 * DAY_MS)), "long_bars")
    four = {"ret_24h", "atr_14d", "sma200_dist_pct", "oi_chg_24h", "liq_notional_24h"}
    names = [f.name for f in ft.registered()]
    f = ft.compute_features(bars, KEY, tasks=ft.block_tasks(bars))
    return bars, f.select(*KEY, "pos", "ts", *[rnd(n, 4 if n in four else 6).alias(n) for n in names])


@query("win_12_feature_registry_long", f"WITH {LONG_FEATURES_CTE} SELECT * EXCLUDE (pos) FROM lf")
def win_12_long(spark, sf):
    # every feature has values here
    return long_features(spark, sf)[1].drop("pos")


REGIME_SQL = f"""WITH {DAILY_CTE}, a AS (SELECT *, ln(close) - lag(ln(close)) OVER (PARTITION BY instrument_id ORDER BY pos) AS lr FROM dx)"""


@query(
    "win_13_sma_and_annual_vol",
    f"""{REGIME_SQL} SELECT instrument_id, ts, {R(full("avg", "close", 200), 5)} AS sma,
        {R(f"({full('stddev_samp', 'lr', 30)}) * sqrt(365.0)")} AS rv FROM a""",
)
def win_13(spark, sf):
    out = add_windowed(
        daily_ix(spark, sf),
        KEY,
        [
            lambda f: {
                "sma": f.roll("avg", "close", 200),
                "_lr": F.log("close") - f.lag(F.log("close"), 1),
            },
            lambda f: {"rv": regimes.realized_vol(f, "_lr")},
        ],
        before=200,
    )
    return out.select("instrument_id", "ts", rnd("sma", 5).alias("sma"), rnd("rv").alias("rv"))


@query(
    "win_14_strict_rank",
    f"""WITH {DAILY_CTE}, l AS (SELECT instrument_id, ts, pos, close, list(close) OVER {rows(365)} AS xs FROM dx)
        SELECT instrument_id, ts, CASE WHEN len(xs) >= 91 THEN {R("1.0 * len(list_filter(xs, lambda v: v < close)) / len(xs)")} END AS x FROM l""",
)
def win_14(spark, sf):
    src = daily_ix(spark, sf).select("instrument_id", "ts", "pos", "close")
    ranked = ft.add_ranks(src, KEY, {"x": ("close", 365)}, strict_min_obs={"x": 91})
    return ranked.select("instrument_id", "ts", rnd("x").alias("x"))


@query(
    "win_15_ewm",
    f"""WITH RECURSIVE {DAILY_CTE}, e AS (SELECT instrument_id, pos, ts, close AS y FROM dx WHERE pos = 0 UNION ALL
        SELECT d.instrument_id, d.pos, d.ts, e.y * (1 - 1.0 / 14) + d.close / 14 FROM e JOIN dx d
        ON d.instrument_id = e.instrument_id AND d.pos = e.pos + 1)
        SELECT instrument_id, ts, CASE WHEN pos >= 13 THEN {R("y", 3)} END AS x FROM e""",
)
def win_15(spark, sf):
    src = daily_ix(spark, sf).select("instrument_id", "ts", "pos", "close")
    out = ft.add_ewm(src, KEY, {"x": "close"}, 1.0 / 14, min_periods=14)
    return out.select("instrument_id", "ts", rnd("x", 3).alias("x"))


@query(
    "win_16_adx",
    f"""WITH RECURSIVE {DAILY_CTE},
        m AS (SELECT *, high - lag(high) OVER o AS up, lag(low) OVER o - low AS dn, lag(close) OVER o AS pc FROM dx
          WINDOW o AS (PARTITION BY instrument_id ORDER BY pos)),
        t AS (SELECT *, CASE WHEN up > dn AND up > 0 THEN up ELSE 0 END AS p, CASE WHEN dn > up AND dn > 0 THEN dn ELSE 0 END AS q,
          greatest(high - low, coalesce(abs(high - pc), 0), coalesce(abs(low - pc), 0)) AS tr FROM m),
        e AS (SELECT instrument_id, pos, ts, tr AS a, p::DOUBLE AS p, q::DOUBLE AS q, NULL::DOUBLE AS adx, 0 AS seen
          FROM t WHERE pos = 0 UNION ALL
          SELECT instrument_id, pos, ts, a, p, q, CASE WHEN dx IS NULL THEN adx WHEN adx IS NULL THEN dx
            ELSE adx * (1 - 1.0 / 14) + dx / 14 END, seen + CASE WHEN dx IS NULL THEN 0 ELSE 1 END
          FROM (SELECT *, CASE WHEN pos >= 13 AND p + q > 0 THEN 100 * abs(p - q) / (p + q) END AS dx FROM
            (SELECT t.instrument_id, t.pos, t.ts, e.a * (1 - 1.0 / 14) + t.tr / 14 AS a, e.p * (1 - 1.0 / 14) + t.p / 14 AS p,
             e.q * (1 - 1.0 / 14) + t.q / 14 AS q, e.adx, e.seen FROM e JOIN t
             ON t.instrument_id = e.instrument_id AND t.pos = e.pos + 1)))
        SELECT instrument_id, ts, CASE WHEN seen >= 14 THEN {R("adx", 5)} END AS adx FROM e""",
)
def win_16(spark, sf):
    out = regimes.add_adx(daily_ix(spark, sf), KEY)
    return out.select("instrument_id", "ts", rnd("adx", 5).alias("adx"))


@query(
    "win_17_gap_history",
    f"""WITH b AS (SELECT o_custkey, ts, open, close, lag(ts) OVER w AS pts, lag(close) OVER w AS pc FROM
          (SELECT o_custkey, epoch_us(o_orderdate) // 1000 AS ts, arg_min(o_totalprice, o_orderkey) AS open,
           arg_max(o_totalprice, o_orderkey) AS close FROM orders GROUP BY 1, 2) WINDOW w AS (PARTITION BY o_custkey ORDER BY ts))
        SELECT o_custkey, ts, {R("abs((open - pc) / pc * 100)", 4)} AS magnitude, CAST(round((ts - pts) / 86400000.0) AS BIGINT) AS gap_days,
        'cme_gap:' || strftime(make_timestamp(ts * 1000), '%Y-%m-%d') AS dedupe_key FROM b WHERE round((ts - pts) / 86400000.0) >= 2""",
)
def win_17(spark, sf):
    from barline.operators.bars import ohlcv
    from barline.operators.series import DAY_MS, index_rows, time_bucket

    o = table(spark, sf, "orders").select("o_custkey", "o_orderkey", ms("o_orderdate").alias("ts"), F.col("o_totalprice").alias("v"))
    b = ohlcv(o, ["o_custkey"], DAY_MS, price="v", size="v", tiebreak="o_orderkey")
    ix = index_rows(b, ["o_custkey"], "ts", time_bucket("ts", 3650 * DAY_MS))
    prev = add_windowed(ix, ["o_custkey"], lambda f: {"_pc": f.lag("close", 1), "_pt": f.lag("ts", 1)}, before=1)
    g = gap_events(prev, F.col("_pc"), F.col("_pt"), ["o_custkey"])
    return g.select("o_custkey", "ts", rnd("magnitude", 4).alias("magnitude"), "gap_days", "dedupe_key")


def order_trades(spark, sf):
    """Orders as a trade list per priority: small returns, entry by order date."""
    from barline.operators.series import DAY_MS, index_rows, time_bucket

    o = table(spark, sf, "orders").select(
        F.col("o_orderpriority").alias("rule_id"),
        "o_orderkey",
        ms("o_orderdate").alias("entry_ts"),
        (ms("o_orderdate") + 3 * 86_400_000).alias("exit_ts"),
        ((F.col("o_totalprice") - 245_000.0) / 5_000.0).alias("ret_bps"),
        (((F.col("o_totalprice") - 245_000.0) / 5_000.0) - 1.0).alias("ret_net_bps"),
        "o_orderstatus",
    )
    return index_rows(o, ["rule_id"], ["entry_ts", "o_orderkey"], time_bucket("entry_ts", 365 * DAY_MS), "seq")


TRADES_CTE = """
ot AS (SELECT o_orderpriority AS rule_id, o_orderkey, epoch_us(o_orderdate) // 1000 AS entry_ts,
  epoch_us(o_orderdate) // 1000 + 3 * 86400000 AS exit_ts, (o_totalprice - 245000.0) / 5000.0 AS ret_bps,
  (o_totalprice - 245000.0) / 5000.0 - 1.0 AS ret_net_bps, o_orderstatus,
  CAST(row_number() OVER (PARTITION BY o_orderpriority ORDER BY o_orderdate, o_orderkey) - 1 AS BIGINT) AS seq FROM orders)
"""


@query(
    "win_18_equity_curve",
    f"""WITH {TRADES_CTE} SELECT rule_id, seq, {R("product(1 + ret_net_bps / 10000) OVER (PARTITION BY rule_id ORDER BY seq)")}
        AS equity FROM ot""",
)
def win_18(spark, sf):
    e = stats.equity_curve(order_trades(spark, sf), ["rule_id"], "ret_net_bps", size=1000)
    return e.select("rule_id", "seq", rnd("equity").alias("equity"))


@query(
    "win_18_max_drawdown",
    f"""WITH {TRADES_CTE}, c AS (SELECT rule_id, seq, product(1 + ret_net_bps / 10000) OVER (PARTITION BY rule_id ORDER BY seq)
          AS eq FROM ot), m AS (SELECT *, max(eq) OVER (PARTITION BY rule_id ORDER BY seq) AS top FROM c)
        SELECT rule_id, {R("min((eq - top) / top)")} AS max_dd FROM m GROUP BY 1""",
)
def win_18_dd(spark, sf):
    d = stats.max_drawdown(order_trades(spark, sf), ["rule_id"], "ret_net_bps", size=1000)
    return d.select("rule_id", rnd("max_dd").alias("max_dd"))


DEFINITIONS_SQL = ", ".join(
    f"""('{f.name}', '{{"base":"{",".join(f.base)}","feature_set_version":"v1"}}', '{f.lookback}bars', '{f.family}')""" for f in ft.registered()
)


@query(
    "udf_03_feature_definitions",
    f"""WITH {LONG_FEATURES_CTE}, d AS (SELECT * FROM (VALUES {DEFINITIONS_SQL}) AS v(feature, spec, lookback_required, family)),
        n AS (SELECT feature, count(*) AS non_null FROM (SELECT * EXCLUDE (ts, pos, instrument_id) FROM lf) UNPIVOT (x FOR feature IN (*)) GROUP BY 1)
        SELECT 'v1.' || feature AS feature_id, CAST(1 AS INT) AS version, spec, '1h' AS cadence, lookback_required, family, CAST(non_null AS BIGINT) AS non_null
        FROM d JOIN n USING (feature)""",
)
def udf_03(spark, sf):
    # the definition table with the number of bars that have a value
    values = long_features(spark, sf)[1].agg(*[F.count(f.name).alias(f.name) for f in ft.registered()])
    pairs = F.array(
        *[F.struct(F.lit(f"v1.{f.name}").alias("feature_id"), F.col(f.name).alias("non_null")) for f in ft.registered()]
    )
    counts = values.select(F.explode(pairs).alias("_p")).select("_p.*").filter("non_null > 0")
    return ft.feature_definitions(spark).join(counts, "feature_id")
