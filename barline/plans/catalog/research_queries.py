"""Catalogue: research tables and the pluggable surfaces."""

from __future__ import annotations

from pyspark.sql import functions as F

from barline.functions.scalar import ms
from barline.operators import features as ft
from barline.operators import labels, research, rules, verdict
from barline.operators.series import DAY_MS, add_windowed
from barline.plans.catalog.base import DAILY_CTE, HOURLY_CTE, R, daily_ix, hourly_ix, query, rnd, rnd_many, rounded, table
from barline.plans.catalog.evaluation import MANY, RULE_INPUT_CTE, RULE_SQL, RULES, rule_input, verdict_inputs
from barline.plans.catalog.ops import REVISIONS_CTE, revisions
from barline.plans.catalog.scalars import cdf_sql
from barline.plans.catalog.windows import LONG_FEATURES_CTE, TRADES_CTE, long_features, order_trades
from barline.session import materialize, run_dir
from barline.sources import lake

KEY = ["instrument_id"]
AS_OF = 946_684_800_000


@query(
    "ext_01_as_of_view",
    f"""WITH {REVISIONS_CTE} SELECT metric_id, ts, ingested_at, value FROM rv WHERE ingested_at <= {AS_OF} AND ts + 86400000 <= {AS_OF}
        QUALIFY row_number() OVER (PARTITION BY metric_id, ts ORDER BY ingested_at DESC) = 1""",
)
def ext_01(spark, sf):
    return research.as_of_view(revisions(spark, sf), AS_OF, DAY_MS).select("metric_id", "ts", "ingested_at", "value")


def lead_bps(h):
    return f"(lead(close, {h + 1}) OVER o / lead(open, 1) OVER o - 1) * 10000"


@query(
    "ext_02_multi_horizon_labels",
    f"""WITH {HOURLY_CTE} SELECT instrument_id, ts, {", ".join(f"{R(lead_bps(h), 3)} AS fwd_ret_{h}" for h in (1, 4, 24, 72, 168))}
        FROM hx WINDOW o AS (PARTITION BY instrument_id ORDER BY pos)""",
)
def ext_02(spark, sf):
    out = labels.multi_horizon_labels(hourly_ix(spark, sf), KEY, [1, 4, 24, 72, 168])
    names = [f"fwd_ret_{h}" for h in (1, 4, 24, 72, 168)]
    return rounded(out.select("instrument_id", "ts", *names), *names, digits=3)


def scan_input(spark, sf):
    """Daily bars with two features and two labels."""
    def cols(f):
        return {
            "chg_5": ft.chg(f, "close", 5),
            "ratio": ft.ma_ratio(f, "volume", 3, 10),
            "fwd_1": labels.ret_bps("long", f.lead("open", 1), f.lead("close", 2)) / 100.0,
            "fwd_5": labels.ret_bps("long", f.lead("open", 1), f.lead("close", 6)) / 100.0,
        }

    return add_windowed(daily_ix(spark, sf), KEY, cols, before=10, after=6)


SCAN_CTE = f"""{DAILY_CTE},
sc AS (SELECT instrument_id, pos, ts, close - lag(close, 5) OVER o AS chg_5, CASE WHEN pos >= 9 THEN avg(volume) OVER w3 / avg(volume) OVER w10 END AS ratio,
  (lead(close, 2) OVER o / lead(open, 1) OVER o - 1) * 100 AS fwd_1, (lead(close, 6) OVER o / lead(open, 1) OVER o - 1) * 100 AS fwd_5 FROM dx
  WINDOW o AS (PARTITION BY instrument_id ORDER BY pos), w3 AS (PARTITION BY instrument_id ORDER BY pos ROWS 2 PRECEDING),
  w10 AS (PARTITION BY instrument_id ORDER BY pos ROWS 9 PRECEDING)),
sl AS (SELECT instrument_id, pos, feature, x, fwd_1, fwd_5 FROM sc UNPIVOT (x FOR feature IN (chg_5, ratio)))
"""


HORIZONS = [1, 4, 24, 72, 168]
LABELS = {f"fwd_ret_{h}": h for h in HORIZONS}


def registry_scan(spark, sf):
    """Long bars with every registered feature and the labels of all horizons."""
    bars, feats = long_features(spark, sf)
    labelled = labels.multi_horizon_labels(bars, KEY, HORIZONS).select(*KEY, "pos", *[rnd(c).alias(c) for c in LABELS])
    return materialize(feats.drop("ts").join(labelled, [*KEY, "pos"]), "scan")


REGISTRY_SCAN_CTE = f"""{LONG_FEATURES_CTE},
ly AS (SELECT instrument_id, pos, {", ".join(f"{R(lead_bps(h))} AS fwd_ret_{h}" for h in HORIZONS)} FROM lx WINDOW o AS (PARTITION BY instrument_id ORDER BY pos)),
sl AS (SELECT instrument_id, pos, feature, x FROM (SELECT * EXCLUDE (ts) FROM lf) UNPIVOT (x FOR feature IN (* EXCLUDE (instrument_id, pos)))),
sy AS (SELECT instrument_id, pos, horizon, y, CAST(substr(horizon, 9) AS INT) AS lags FROM ly UNPIVOT (y FOR horizon IN (* EXCLUDE (instrument_id, pos))))
"""


@query(
    "ext_03_feature_ic",
    f"""WITH {REGISTRY_SCAN_CTE}, l AS (SELECT instrument_id, feature, horizon, x, y FROM sl JOIN sy USING (instrument_id, pos)),
        r AS (SELECT *, rank() OVER (PARTITION BY instrument_id, feature, horizon ORDER BY x) + (count(*) OVER (PARTITION BY instrument_id, feature, horizon, x) - 1) / 2.0 AS rx,
          rank() OVER (PARTITION BY instrument_id, feature, horizon ORDER BY y) + (count(*) OVER (PARTITION BY instrument_id, feature, horizon, y) - 1) / 2.0 AS ry,
          count(*) OVER (PARTITION BY instrument_id, feature, horizon) AS n FROM l)
        SELECT instrument_id, feature, horizon, CAST(any_value(n) AS BIGINT) AS n, {R("corr(rx, ry)")} AS spearman_ic,
          {R("avg(y) FILTER (ceil(rx * 5 / n) = 5) - avg(y) FILTER (ceil(rx * 5 / n) = 1)", 4)} AS q5_q1_spread_bps, any_value(n) >= 500 AS enough FROM r GROUP BY 1, 2, 3""",
)
def ext_03(spark, sf):
    s = research.feature_horizon_stats(registry_scan(spark, sf), KEY, [f.name for f in ft.registered()], list(LABELS))
    return rounded(rounded(s, "spearman_ic"), "q5_q1_spread_bps", digits=4)


@query(
    "ext_04_condition_table",
    f"""WITH {SCAN_CTE}, b AS (SELECT instrument_id, CAST(year(make_timestamp(ts * 1000)) AS VARCHAR) AS period, fwd_1 AS y, coalesce(chg_5 < -50000, false) AS hit FROM sc WHERE fwd_1 IS NOT NULL),
        s AS (SELECT *, 'all' AS side FROM b UNION ALL SELECT *, 'condition' FROM b WHERE hit)
        SELECT instrument_id, period, side, CAST(count(*) AS BIGINT) AS n, {R("avg(y)", 4)} AS mean, {R("avg(CASE WHEN y > 0 THEN 1.0 ELSE 0 END)")} AS hit_rate,
          {R("quantile_cont(y, 0.5)", 5)} AS median FROM s GROUP BY 1, 2, 3""",
)
def ext_04(spark, sf):
    rule = rules.rule_column({"cmp": [{"feature": "chg_5"}, "<", -50_000]})
    year = F.year(F.timestamp_millis("ts"))
    t = research.condition_table(scan_input(spark, sf), KEY, rule, "fwd_1", year)
    return rounded(rounded(rounded(t, "mean", digits=4), "hit_rate"), "median", digits=5)


def nw_sql(lags: int) -> str:
    terms = " + ".join(
        f"2 * (1 - {k} / {lags + 1}.0) * coalesce(sum((y - m) * (y{k} - m)), 0) / count(*)" for k in range(1, lags + 1)
    )
    return f"avg(pow(y - m, 2)) + {terms}"


@query(
    "ext_05_conditional_scan",
    f"""WITH {REGISTRY_SCAN_CTE}, q AS (SELECT instrument_id, feature, unnest([0.1, 0.25, 0.75, 0.9]) AS q, unnest([quantile_cont(x, 0.1), quantile_cont(x, 0.25), quantile_cont(x, 0.75),
          quantile_cont(x, 0.9)]) AS cut FROM sl GROUP BY 1, 2),
        h AS (SELECT s.*, q.q FROM sl s JOIN q USING (instrument_id, feature) WHERE CASE WHEN q.q < 0.5 THEN x < cut ELSE x > cut END),
        l AS (SELECT instrument_id, feature, q, horizon, lags, pos, y, dense_rank() OVER (ORDER BY instrument_id, feature, q, horizon) AS g FROM h JOIN sy USING (instrument_id, pos)),
        d AS (SELECT *, avg(y) OVER (PARTITION BY g) AS m, y - avg(y) OVER (PARTITION BY g) AS d, row_number() OVER (PARTITION BY g ORDER BY pos) AS seq FROM l),
        k AS (SELECT g, seq, d, lags, unnest(range(1, lags + 1)) AS k FROM d),
        c AS (SELECT k.g, sum((1 - k / (k.lags + 1)::DOUBLE) * k.d * d.d) AS s FROM k JOIN d ON d.g = k.g AND d.seq = k.seq + k.k GROUP BY 1),
        b AS (SELECT g, instrument_id, feature, q, horizon, count(*) AS n, any_value(m) AS mean, var_pop(d) AS g0 FROM d GROUP BY ALL),
        v AS (SELECT b.*, g0 + 2 * coalesce(s, 0) / n AS var FROM b LEFT JOIN c USING (g)),
        t AS (SELECT *, CASE WHEN var > 0 THEN mean / sqrt(var / n) END AS t FROM v),
        p AS (SELECT *, 2 * (1 - {cdf_sql("abs(t)")}) AS p, n >= 100 AS enough FROM t), r AS (SELECT *, row_number() OVER (PARTITION BY instrument_id, enough ORDER BY p) AS rk, count(p) OVER
          (PARTITION BY instrument_id, enough) AS k FROM p)
        SELECT instrument_id, feature, CAST(q AS DOUBLE) AS q, horizon, CAST(n AS BIGINT) AS n, enough, {R("mean", 4)} AS mean, {R("t", 5)} AS t_nw, {R("p", 5)} AS p_value,
          CASE WHEN enough AND p IS NOT NULL THEN {R("least(1, min(p * k / rk) OVER (PARTITION BY instrument_id, enough ORDER BY rk DESC))", 5)} END AS q_value FROM r""",
)
def ext_05(spark, sf):
    s = research.conditional_scan(registry_scan(spark, sf), KEY, [f.name for f in ft.registered()], LABELS)
    out = s.select("instrument_id", "feature", "q", "horizon", "n", "enough", "mean", "t_nw", "p_value", "q_value")
    return rounded(rounded(out, "mean", digits=4), "t_nw", "p_value", "q_value", digits=5)


@query(
    "ext_06_newey_west",
    f"""WITH {TRADES_CTE}, g AS (SELECT rule_id, ret_bps AS y, avg(ret_bps) OVER (PARTITION BY rule_id) AS m, {", ".join(f"lead(ret_bps, {k}) OVER o AS y{k}" for k in range(1, 5))}
          FROM ot WINDOW o AS (PARTITION BY rule_id ORDER BY seq))
        SELECT rule_id, CAST(count(*) AS BIGINT) AS n, {R("any_value(m)")} AS mean, {R(f"any_value(m) / sqrt(({nw_sql(4)}) / count(*))", 5)} AS t_nw FROM g GROUP BY 1""",
)
def ext_06(spark, sf):
    t = research.newey_west(order_trades(spark, sf), ["rule_id"], "ret_bps", 4, size=500)
    return rounded(rounded(t.select("rule_id", "n", "mean", "t_nw"), "mean"), "t_nw", digits=5)


@query(
    "ext_06_newey_west_week",
    f"""WITH {TRADES_CTE}, g AS (SELECT rule_id, seq, ret_bps - avg(ret_bps) OVER (PARTITION BY rule_id) AS d, avg(ret_bps) OVER (PARTITION BY rule_id) AS m FROM ot),
        b AS (SELECT rule_id, CAST(count(*) AS BIGINT) AS n, any_value(m) AS m, var_pop(d) AS g0 FROM g GROUP BY 1),
        c AS (SELECT x.rule_id, sum((1 - (y.seq - x.seq) / 169.0::DOUBLE) * x.d * y.d) AS s FROM g x JOIN g y ON x.rule_id = y.rule_id AND y.seq BETWEEN x.seq + 1 AND x.seq + 168 GROUP BY 1)
        SELECT rule_id, n, {R("m")} AS mean, {R("m / sqrt((g0 + 2 * s / n) / n)", 5)} AS t_nw FROM b JOIN c USING (rule_id)""",
)
def ext_06_week(spark, sf):
    # as many lags as a week has hours
    t = research.newey_west(order_trades(spark, sf), ["rule_id"], "ret_bps", 168, size=500)
    return rounded(rounded(t.select("rule_id", "n", "mean", "t_nw"), "mean"), "t_nw", digits=5)


@query(
    "ext_07_benjamini_hochberg",
    f"""WITH t AS (SELECT o_orderpriority AS batch, o_orderkey, (o_orderkey * 7919 % 15013) / 15013.0 AS p FROM orders), r AS (SELECT *, row_number() OVER (PARTITION BY batch
          ORDER BY p) AS rk, count(*) OVER (PARTITION BY batch) AS k FROM t)
        SELECT batch, o_orderkey, {R("least(1, min(p * k / rk) OVER (PARTITION BY batch ORDER BY rk DESC))")} AS q_value FROM r""",
)
def ext_07(spark, sf):
    t = table(spark, sf, "orders").select(
        F.col("o_orderpriority").alias("batch"), "o_orderkey", (F.col("o_orderkey") * 7919 % 15013 / 15013.0).alias("p_value")
    )
    q = research.benjamini_hochberg(t, ["batch"])
    return q.select("batch", "o_orderkey", rnd("q_value").alias("q_value"))


@query(
    "ext_08_event_study",
    f"""WITH {HOURLY_CTE}, e AS (SELECT * FROM hx WHERE high > 200) SELECT e.instrument_id, x.pos - e.pos AS "offset", {R("avg((x.close / e.close - 1) * 10000)", 3)} AS mean_bps,
        CAST(count(*) AS BIGINT) AS n FROM e JOIN hx x ON x.instrument_id = e.instrument_id AND x.pos BETWEEN e.pos - 6 AND e.pos + 12 GROUP BY 1, 2""",
)
def ext_08(spark, sf):
    s = research.event_study(hourly_ix(spark, sf), KEY, F.col("high") > 200, 6, 12)
    return s.select("instrument_id", "offset", rnd("mean_bps", 3).alias("mean_bps"), "n")


FLAGS_CTE = f"{RULE_INPUT_CTE}, fl AS (SELECT {', '.join(f'coalesce({RULE_SQL[n]}, false) AS {n}' for n in MANY)} FROM ri)"
PAIRS = [(a, b) for a in sorted(MANY) for b in sorted(MANY) if a < b]


@query(
    "ext_09_signal_overlap",
    f"WITH {FLAGS_CTE} "
    + " UNION ALL ".join(
        f"SELECT '{a}' AS rule_a, '{b}' AS rule_b, CAST(count(*) FILTER ({a} AND {b}) AS BIGINT) AS \"both\", {R(f'1.0 * count(*) FILTER ({a} AND {b}) / count(*) FILTER ({a} OR {b})')} AS jaccard FROM fl"
        for a, b in PAIRS
    ),
)
def ext_09(spark, sf):
    flags = rules.fire_flags(rule_input(spark, sf).select("*"), KEY, {n: RULES[n] for n in MANY})
    return rounded(research.signal_overlap(flags, MANY), "jaccard")


@query(
    "ext_09_rule_overlap",
    f"""WITH f AS (SELECT DISTINCT l_partkey AS rule_id, l_shipdate AS bar FROM lineitem), s AS (SELECT rule_id, count(*) AS n FROM f GROUP BY 1),
        p AS (SELECT a.rule_id AS rule_a, b.rule_id AS rule_b, CAST(count(*) AS BIGINT) AS "both" FROM f a JOIN f b ON a.bar = b.bar AND a.rule_id < b.rule_id GROUP BY 1, 2)
        SELECT rule_a, rule_b, "both", {R('"both" / (x.n + y.n - "both")')} AS jaccard FROM p JOIN s x ON x.rule_id = rule_a JOIN s y ON y.rule_id = rule_b
        WHERE "both" >= 0.04::DOUBLE * (x.n + y.n - "both")""",
)
def ext_09_rules(spark, sf):
    # every part stands for a rule that fires on its ship dates
    fires = table(spark, sf, "lineitem").select(F.col("l_partkey").alias("rule_id"), F.col("l_shipdate").alias("bar"))
    return research.rule_overlap(fires, min_jaccard=0.04).withColumn("jaccard", rnd_many("jaccard"))


def daily_returns(spark, sf):
    d = daily_ix(spark, sf)
    return d.select(F.concat(F.lit("r"), F.substring("instrument_id", 1, 1)).alias("rule_id"), F.col("ts").alias("dt"), F.log(F.col("close") / F.col("open")).alias("ret"))


RIDS = ["r1", "r2", "r3", "r4", "r5"]


@query(
    "ext_10_return_correlations",
    f"""WITH {DAILY_CTE}, dr AS (SELECT 'r' || left(instrument_id, 1) AS rule_id, ts, ln(close / open) AS ret FROM daily)
        SELECT a.rule_id AS rule_a, b.rule_id AS rule_b, {R("corr(a.ret, b.ret)")} AS return_corr FROM dr a JOIN dr b USING (ts) WHERE a.rule_id < b.rule_id GROUP BY 1, 2""",
)
def ext_10(spark, sf):
    return rounded(research.return_correlations(daily_returns(spark, sf), RIDS), "return_corr")


@query(
    "ext_10_supplier_correlations",
    f"""WITH d AS (SELECT l_suppkey AS rule_id, l_shipdate AS dt, sum(l_discount - 0.05) AS ret FROM lineitem GROUP BY 1, 2),
        p AS (SELECT a.rule_id AS rule_a, b.rule_id AS rule_b, count(*) AS n, corr(a.ret, b.ret) AS c
          FROM d a JOIN d b ON a.dt = b.dt AND a.rule_id < b.rule_id GROUP BY 1, 2)
        SELECT rule_a, rule_b, {R("c", 5)} AS return_corr FROM p WHERE n >= 12""",
)
def ext_10_suppliers(spark, sf):
    # every supplier stands for a rule; pairs with few common days say nothing
    daily = table(spark, sf, "lineitem").groupBy(F.col("l_suppkey").alias("rule_id"), F.col("l_shipdate").alias("dt"))
    daily = daily.agg(F.sum(F.col("l_discount") - 0.05).alias("ret"))
    c = research.return_correlations(daily, min_days=12)
    return c.withColumn("return_corr", rnd_many("return_corr", 5))


@query(
    "ext_10_max_corr_with_active",
    f"""WITH {DAILY_CTE}, dr AS (SELECT 'r' || left(instrument_id, 1) AS rule_id, ts, ln(close / open) AS ret FROM daily), c AS (SELECT a.rule_id AS rule_id, b.rule_id AS o,
          corr(a.ret, b.ret) AS c FROM dr a JOIN dr b USING (ts) WHERE a.rule_id <> b.rule_id GROUP BY 1, 2)
        SELECT rule_id, {R("max(c)")} AS corr_max_active FROM c WHERE o IN ('r1', 'r2') GROUP BY 1""",
)
def ext_10_max(spark, sf):
    c = research.return_correlations(daily_returns(spark, sf), RIDS)
    return rounded(research.max_corr_with_active(c, ["r1", "r2"]), "corr_max_active")


@query(
    "ext_11_cusum",
    f"""WITH {TRADES_CTE}, s AS (SELECT rule_id, seq, sum((0.5 - ret_bps) / 28.0) OVER (PARTITION BY rule_id ORDER BY seq) AS s FROM ot),
        m AS (SELECT *, least(0, min(s) OVER (PARTITION BY rule_id ORDER BY seq)) AS lo FROM s) SELECT rule_id, seq, {R("s - lo", 9)} AS cusum, s - lo > 4 AS alarm FROM m""",
)
def ext_11(spark, sf):
    c = research.cusum(order_trades(spark, sf), ["rule_id"], "ret_bps", F.lit(0.5), F.lit(28.0))
    return c.select("rule_id", "seq", rnd("cusum", 9).alias("cusum"), "alarm")


@query(
    "ext_13_more_transforms",
    f"""WITH {HOURLY_CTE}, a AS (SELECT *, close - lag(close) OVER o AS d1, close - 2 * lag(close, 6) OVER o + lag(close, 12) OVER o AS accel,
          CASE WHEN pos >= 23 THEN regr_slope(close, volume) OVER w END AS sl, avg(close) OVER w AS ma, avg(volume) OVER w AS mv FROM hx
          WINDOW o AS (PARTITION BY instrument_id ORDER BY pos), w AS (PARTITION BY instrument_id ORDER BY pos ROWS 23 PRECEDING)),
        b AS (SELECT *, CASE WHEN d1 IS NULL THEN NULL ELSE sign(d1) END AS sg FROM a), c AS (SELECT *, CASE WHEN sg IS NOT DISTINCT FROM lag(sg) OVER
          (PARTITION BY instrument_id ORDER BY pos) AND pos > 0 THEN 0 ELSE 1 END AS nw FROM b),
        d AS (SELECT *, sum(nw) OVER (PARTITION BY instrument_id ORDER BY pos) AS grp FROM c)
        SELECT instrument_id, ts, {R("accel")} AS accel, {R("close - (ma + sl * (volume - mv))", 4)} AS divergence, {R("close * volume", 4)} AS interact, {R("close / high")} AS vol_adj,
          CAST(sg * row_number() OVER (PARTITION BY instrument_id, grp ORDER BY pos) AS BIGINT) AS sign_run FROM d""",
)
def ext_13(spark, sf):
    def cols(f):
        return {
            "d1": ft.chg(f, "close", 1),
            "accel": research.accel(f, "close", 6),
            "divergence": research.divergence(f, "close", "volume", 24),
            "interact": F.col("close") * F.col("volume"),
            "vol_adj": research.vol_adj(f, "close", "high"),
        }

    rows = add_windowed(hourly_ix(spark, sf), KEY, cols, before=24)
    out = research.sign_run(rows, KEY, "d1").select(
        "instrument_id", "ts", "accel", "divergence", "interact", "vol_adj", "sign_run"
    )
    return rounded(rounded(out, "accel", "vol_adj"), "divergence", "interact", digits=4)


@query(
    "ext_14_archive_split",
    f"""SELECT CASE WHEN o_orderdate < TIMESTAMP '1998-01-01' THEN 'archive' ELSE 'keep' END AS part, CAST(count(*) AS BIGINT) AS rows, min(epoch_us(o_orderdate) // 1000) AS min_ts,
        max(epoch_us(o_orderdate) // 1000) AS max_ts FROM orders GROUP BY 1""",
)
def ext_14(spark, sf):
    o = table(spark, sf, "orders").select("o_orderkey", "o_totalprice", ms("o_orderdate").alias("ts"))
    keep, old = lake.archive(o, "ts", 883_612_800_000)
    parts = [lake.archive_manifest(d, "ts").withColumn("part", F.lit(n)) for n, d in (("keep", keep), ("archive", old))]
    return parts[0].unionByName(parts[1]).select("part", "rows", "min_ts", "max_ts")


@query(
    "ext_14_retire",
    """SELECT CAST(year(o_orderdate) AS VARCHAR) AS part, CAST(count(*) AS BIGINT) AS rows, min(epoch_us(o_orderdate) // 1000) AS min_ts, max(epoch_us(o_orderdate) // 1000) AS max_ts,
         year(o_orderdate) < 1998 AS dropped, year(o_orderdate) < 1998 AS archived FROM orders GROUP BY year(o_orderdate)""",
)
def ext_14_retire(spark, sf):
    # old years of the orders go to an archive; what is left and what was archived are read back
    o = table(spark, sf, "orders").select("o_orderkey", "o_totalprice", ms("o_orderdate").alias("ts"), F.year("o_orderdate").alias("year"))
    source, target = run_dir(spark, "orders"), run_dir(spark, "archive")
    o.write.partitionBy("year").parquet(source)
    gone = lake.retire(spark, source, target, "year", "1998").select("part", "dropped")
    left = lake.read_table(spark, source).withColumn("archived", F.lit(False))
    kept = lake.read_table(spark, target).withColumn("archived", F.lit(True))
    both = left.unionByName(kept).groupBy(F.col("year").cast("string").alias("part"), "archived")
    found = both.agg(F.count(F.lit(1)).alias("rows"), F.min("ts").alias("min_ts"), F.max("ts").alias("max_ts"))
    return found.join(gone, "part", "left").withColumn("dropped", F.coalesce("dropped", F.lit(False)))


@query(
    "ext_15_day_of_month",
    f"WITH {HOURLY_CTE} SELECT instrument_id, ts, day(make_timestamp(ts * 1000)) IN (1, 2, 28, 29, 30) AS fired FROM hourly",
)
def ext_15(spark, sf):
    flags = rules.fire_flags(hourly_ix(spark, sf), KEY, {"fired": {"time": {"dom_in": [28, 29, 30, 1, 2]}}})
    return flags.select("instrument_id", "ts", "fired")


# ------------------------------------------------------------------ pluggable surfaces


@query(
    "udf_01_registered_feature",
    f"""WITH {HOURLY_CTE} SELECT instrument_id, ts, {R("(high - low) / lag(close, 3) OVER (PARTITION BY instrument_id ORDER BY pos)")} AS range_vs_close FROM hx""",
)
def udf_01(spark, sf):
    ft.register_feature(
        ft.Feature(
            "range_vs_close",
            ("high", "low", "close"),
            3,
            3,
            "price",
            lambda f: F.try_divide(F.col("high") - F.col("low"), f.lag("close", 3)),
        )
    )
    try:
        out = ft.compute_features(hourly_ix(spark, sf), KEY, ["range_vs_close"])
    finally:
        ft.unregister_feature("range_vs_close")
    return out.select("instrument_id", "ts", rnd("range_vs_close").alias("range_vs_close"))


@query(
    "udf_01_arrow_feature",
    f"""WITH {HOURLY_CTE} SELECT instrument_id, ts, CASE WHEN pos >= 4 THEN {R("quantile_cont(close, 0.5) OVER (PARTITION BY instrument_id ORDER BY pos ROWS 4 PRECEDING)")}
        END AS median_5 FROM hx""",
)
def udf_01_arrow(spark, sf):
    # a rolling median has no built-in frame form of constant cost
    ft.register_feature(
        ft.Feature("median_5", ("close",), 5, 4, "price", arrow=lambda pdf: pdf["close"].rolling(5, min_periods=5).median())
    )
    try:
        out = ft.compute_features(hourly_ix(spark, sf), KEY, ["median_5"])
    finally:
        ft.unregister_feature("median_5")
    return out.select("instrument_id", "ts", rnd("median_5").alias("median_5"))


@query(
    "udf_04_custom_thresholds",
    f"""WITH v AS (SELECT o_orderkey, o_totalprice / 250000 - 0.6 AS ci_hi, (o_orderkey % 40) / 100.0 AS p, 0.4 + (o_orderkey % 7) / 10.0 AS dsr,
          CASE WHEN o_orderstatus <> 'P' THEN o_totalprice / 100000 - 1 END AS rec FROM orders)
        SELECT o_orderkey, ci_hi < 0 OR p > 0.2 OR dsr < 0.7 OR coalesce(rec < 0, false) AS rejected FROM v""",
)
def udf_04(spark, sf):
    t = verdict.Thresholds(min_p_perm_reject=0.2, max_dsr_reject=0.7)
    d = verdict.decide(verdict_inputs(spark, sf), t)
    return d.select("o_orderkey", (F.col("verdict") == "REJECT").alias("rejected"))

