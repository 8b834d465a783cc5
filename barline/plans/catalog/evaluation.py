"""Catalogue: rules, labels, trade statistics, resampling, verdict."""

from __future__ import annotations

from pyspark.sql import functions as F

from barline.functions.scalar import utc_year
from barline.operators import asof, features, labels, resample, rules, splits, stats, verdict
from barline.operators.series import HOUR_MS, add_windowed
from barline.plans import evaluate as ev
from barline.plans.catalog.base import HOURLY_CTE, R, events_ms, hourly, hourly_ix, query, rnd, rounded
from barline.plans.catalog.joins import EVENT_COLS, LABELS_CTE, daily_labels
from barline.plans.catalog.scalars import cdf_sql
from barline.plans.catalog.windows import TRADES_CTE, order_trades
from barline.session import materialize

KEY = ["instrument_id"]

# ---------------------------------------------------------------------------- rules

RULES = {
    "cmp": {"cmp": [{"feature": "ret_24h"}, ">", 0]},
    "cmp_lag": {"cmp": [{"feature": "close", "lag": 3}, "<=", {"feature": "close"}]},
    "logic": {
        "and": [
            {"or": [{"cmp": [{"feature": "close"}, ">", 80]}, {"cmp": [{"feature": "close"}, "<", 10]}]},
            {"not": {"cmp": [{"feature": "ret_24h"}, ">=", 50]}},
        ]
    },
    "event": {"event": {"type": "purchase", "min_magnitude": 60}},
    "event_any": {"event": {"type": "error"}},
    "regime": {"regime": {"trend": ["up", "range"], "vol": ["low"]}},
    "time": {"time": {"utc_hour_in": [0, 1, 2, 21, 22], "dow_in": [1, 2, 3, 4, 5]}},
    "mixed": {
        "and": [
            {"cmp": [{"feature": "ret_24h"}, "<", 0]},
            {"not": {"regime": {"trend": ["down"]}}},
            {"or": [{"event": {"type": "purchase", "min_magnitude": 40}}, {"time": {"utc_hour_in": list(range(12))}}]},
        ]
    },
}

RULE_INPUT_CTE = f"""{HOURLY_CTE}, {EVENT_COLS}, {LABELS_CTE},
ri0 AS (SELECT *, (close / lag(close, 24) OVER o - 1) * 100 AS ret_24h, lag(close, 3) OVER o AS close_3,
  first_value(ts) OVER o // 3600000 + pos AS slot, strftime(make_timestamp(ts * 1000), '%Y-%m-%d') AS d,
  hour(make_timestamp(ts * 1000)) AS hr, dayofweek(make_timestamp(ts * 1000)) AS dw FROM hx
  WINDOW o AS (PARTITION BY instrument_id ORDER BY pos)),
ri AS (SELECT x.*, es.ev_purchase, es.ev_error, dl.trend, dl.vol FROM ri0 x LEFT JOIN (SELECT * FROM es WHERE phase = 0) es USING (slot)
  ASOF LEFT JOIN dl ON x.d >= dl.dt)
"""
RULE_SQL = {
    "cmp": "coalesce(ret_24h > 0, false)",
    "cmp_lag": "coalesce(close_3 <= close, false)",
    "logic": "(close > 80 OR close < 10) AND NOT coalesce(ret_24h >= 50, false)",
    "event": "coalesce(ev_purchase >= 60, false)",
    "event_any": "ev_error IS NOT NULL",
    "regime": "coalesce(trend IN ('up', 'range') AND vol IN ('low'), false)",
    "time": "hr IN (0, 1, 2, 21, 22) AND dw IN (1, 2, 3, 4, 5)",
    "mixed": "coalesce(ret_24h < 0, false) AND NOT coalesce(trend IN ('down'), false) AND (coalesce(ev_purchase >= 40, false) OR hr < 12)",
}


def rule_input(spark, sf):
    """Indexed hourly bars with ret_24h, event maxima and the regime struct."""
    b = add_windowed(hourly_ix(spark, sf), KEY, lambda f: {"ret_24h": features.pctchg(f, "close", 24)}, before=24)
    b = materialize(b, "rule_bars")
    e = events_ms(spark, sf)
    placed = asof.place_events(b, KEY, e, HOUR_MS, ["purchase", "error"], event_type="instrument_id", magnitude="value")
    packed = daily_labels(spark, sf).select("dt", F.struct("trend", "vol", "liquidity").alias("regime"))
    return asof.fill_daily(placed, packed, [], ["regime"])


def register_rule(name: str, op: str):
    @query(
        name,
        f"WITH {RULE_INPUT_CTE} SELECT instrument_id, ts, {RULE_SQL[op]} AS fired FROM ri",
    )
    def run(spark, sf):
        flags = rules.fire_flags(rule_input(spark, sf), KEY, {"fired": RULES[op]})
        return flags.select("instrument_id", "ts", "fired")

    return run


for _name, _op in [
    ("rul_01_cmp", "cmp"),
    ("rul_02_lag", "cmp_lag"),
    ("rul_03_logic", "logic"),
    ("rul_04_event", "event"),
    ("rul_04_event_any", "event_any"),
    ("rul_05_regime", "regime"),
    ("rul_06_time", "time"),
    ("rul_07_fire_series", "mixed"),
]:
    register_rule(_name, _op)


@query(
    "rul_08_dependencies",
    """SELECT 'mixed' AS rule_id, p_partkey, (p_type IN ('ECONOMY', 'SMALL')) AS used FROM part""",
)
def rul_08(spark, sf):
    # names a rule reads, used to mark the rows of a feature list it depends on
    rule = {
        "and": [
            {"cmp": [{"feature": "ECONOMY"}, ">", 1]},
            {"not": {"cmp": [{"feature": "SMALL", "lag": 2}, "<", {"feature": "ECONOMY"}]}},
        ]
    }
    names = sorted(rules.features_of(rule))
    from barline.plans.catalog.base import table

    return table(spark, sf, "part").select(
        F.lit("mixed").alias("rule_id"), "p_partkey", F.col("p_type").isin(names).alias("used")
    )


@query(
    "rul_09_fail_closed",
    """SELECT event_type, event_type = 'refund' AS ok FROM (SELECT DISTINCT event_type FROM events)""",
)
def rul_09(spark, sf):
    # a rule on an event type without rows is refused, a known feature is not
    types = events_ms(spark, sf).select(F.col("instrument_id").alias("event_type")).distinct()
    wanted = rules.event_types_of({"event": {"type": "refund"}})
    return types.select("event_type", F.col("event_type").isin(list(wanted)).alias("ok"))


SPEC_SQL = """CASE o_orderkey % 5 WHEN 0 THEN 'entry' WHEN 1 THEN 'exit' WHEN 2 THEN 'direction' WHEN 3 THEN 'when' END"""


@query(
    "rul_10_spec_report",
    f"""SELECT o_orderkey, {SPEC_SQL} AS spec_issue, ({SPEC_SQL}) IS NULL AS spec_ok FROM orders""",
)
def rul_10(spark, sf):
    # one JSON spec per order, four of five broken in a different place
    from barline.plans.catalog.base import table

    k = F.col("o_orderkey") % 5
    good_when = F.struct(F.array(F.lit("x"), F.lit(">"), F.lit("1")).alias("cmp"))
    spec = F.to_json(
        F.struct(
            F.when(k != 3, good_when).alias("when"),
            F.struct(F.when(k == 0, 0).otherwise(1).alias("delay_bars"), F.lit("open").alias("price")).alias("entry"),
            F.struct(F.when(k != 1, "4h").alias("horizon")).alias("exit"),
            F.when(k == 2, "sideways").otherwise("long").alias("direction"),
        )
    )
    o = table(spark, sf, "orders").select("o_orderkey", spec.alias("signal_spec"))
    return rules.spec_report(o).select("o_orderkey", "spec_issue", "spec_ok")


MANY = ["cmp", "cmp_lag", "logic", "event", "regime", "time", "mixed"]


@query(
    "rul_11_many_rules",
    f"WITH {RULE_INPUT_CTE} "
    + " UNION ALL ".join(
        f"SELECT '{n}' AS rule_id, instrument_id, pos, ts FROM ri WHERE {RULE_SQL[n]}" for n in MANY
    ),
)
def rul_11(spark, sf):
    return rules.fires(rule_input(spark, sf), KEY, {n: RULES[n] for n in MANY})


# --------------------------------------------------------------------------- labels

LABEL_CTE = f"""{HOURLY_CTE}, lab AS (SELECT *, lead(ts, 1) OVER o AS entry_ts, lead(ts, 5) OVER o AS exit_ts,
  (lead(close, 5) OVER o / lead(open, 1) OVER o - 1) * 10000 AS fwd_bps FROM hx
  WINDOW o AS (PARTITION BY instrument_id ORDER BY pos))"""


@query(
    "evl_01_forward_labels",
    f"""WITH {LABEL_CTE} SELECT instrument_id, ts, pos, CASE WHEN fwd_bps IS NOT NULL THEN entry_ts END AS entry_ts, exit_ts,
        {R("fwd_bps", 3)} AS fwd_bps FROM lab""",
)
def evl_01(spark, sf):
    out = labels.forward_labels(hourly_ix(spark, sf), KEY, 1, 4)
    return out.select("instrument_id", "ts", "pos", "entry_ts", "exit_ts", rnd("fwd_bps", 3).alias("fwd_bps"))


MOMENTUM = {"and": [{"cmp": [{"feature": "ret_24h"}, ">", 0]}, {"time": {"utc_hour_in": list(range(12))}}]}
MOMENTUM_CTE = f"""{HOURLY_CTE}, mt AS (SELECT *, (close / lag(close, 24) OVER o - 1) * 100 AS ret_24h, lead(ts, 1) OVER o AS entry_ts,
  lead(ts, 5) OVER o AS exit_ts, (lead(close, 5) OVER o / lead(open, 1) OVER o - 1) * 10000 AS ret_bps FROM hx
  WINDOW o AS (PARTITION BY instrument_id ORDER BY pos)),
tr AS (SELECT *, ret_bps - 10 AS ret_net_bps FROM mt WHERE ret_24h > 0 AND hour(make_timestamp(ts * 1000)) < 12
  AND ret_bps IS NOT NULL)"""
SPEC = ev.RuleSpec("momentum", MOMENTUM, "long", "4h", 3.0, 2.0)


def momentum_trades(spark, sf):
    prepared = ev.prepare_bars(hourly(spark, sf), KEY, [SPEC])
    return ev.trades_of(ev.fire_and_label(prepared, KEY, [SPEC]), KEY, [SPEC])


@query(
    "evl_02_trades",
    f"""WITH {MOMENTUM_CTE} SELECT instrument_id, pos, entry_ts, exit_ts, {R("ret_bps", 3)} AS ret_bps,
        {R("ret_net_bps", 3)} AS ret_net_bps FROM tr""",
)
def evl_02(spark, sf):
    t = momentum_trades(spark, sf)
    return t.select(
        "instrument_id", "pos", "entry_ts", "exit_ts", rnd("ret_bps", 3).alias("ret_bps"), rnd("ret_net_bps", 3).alias("ret_net_bps")
    )


@query("evl_03_evaluate_rules")
def evl_03(spark, sf):
    # the whole protocol at full rigour: fires, trades, folds, resampling, verdict
    specs = [
        SPEC,
        ev.RuleSpec("purchase_short", {"event": {"type": "purchase", "min_magnitude": 100}}, "short", "8h", 1.0, 1.0),
    ]
    events = events_ms(spark, sf).select(
        F.col("instrument_id").alias("event_type"), "ts", F.col("value").alias("magnitude")
    )
    prepared = ev.prepare_bars(hourly(spark, sf), KEY, specs, events=events, regimes=daily_labels(spark, sf))
    out = ev.evaluate(prepared, KEY, specs, ev.Config.for_kind("full"))
    return out.verdicts.select("rule_id", "instrument_id", "verdict", rnd("score").alias("score"))


TPY_SQL = """CASE WHEN count(*) < 2 THEN 252 ELSE count(*) / greatest((max(entry_ts) - min(entry_ts)) / 86400000.0 / 365.0, 1.0 / 365) END"""
STATS_CTE = f"""{TRADES_CTE},
g0 AS (SELECT *, lead(ret_net_bps) OVER (PARTITION BY rule_id ORDER BY seq) AS nx, product(1 + ret_net_bps / 10000) OVER
  (PARTITION BY rule_id ORDER BY seq) AS eq, row_number() OVER (PARTITION BY rule_id ORDER BY ret_net_bps DESC) AS rk,
  avg(ret_net_bps) OVER (PARTITION BY rule_id) AS m FROM ot),
g1 AS (SELECT *, max(eq) OVER (PARTITION BY rule_id ORDER BY seq) AS top FROM g0),
g AS (SELECT rule_id, CAST(count(*) AS BIGINT) AS n, {TPY_SQL} AS tpy, avg(ret_net_bps) AS ev, count(*) FILTER (ret_net_bps > 0) AS wins,
  sum(ret_net_bps) FILTER (ret_net_bps > 0) AS gain, -sum(ret_net_bps) FILTER (ret_net_bps < 0) AS loss,
  stddev_samp(ret_net_bps) AS sd, sqrt(avg(pow(ret_net_bps, 2)) FILTER (ret_net_bps < 0)) AS dn, min((eq - top) / top) AS dd,
  sum((ret_net_bps - m) * (nx - m)) / sum(CASE WHEN nx IS NOT NULL THEN pow(ret_net_bps - m, 2) END) AS rho,
  sum(ret_net_bps) FILTER (rk <= 5 AND ret_net_bps > 0) AS top5, avg(pow(ret_net_bps - m, 3)) / pow(stddev_pop(ret_net_bps), 3) AS skew,
  avg(pow(ret_net_bps - m, 4)) / pow(stddev_pop(ret_net_bps), 4) AS kurt FROM g1 GROUP BY 1)
"""


def stat_frame(spark, sf):
    t = order_trades(spark, sf)
    span = t.groupBy("rule_id").agg(F.count(F.lit(1)).alias("n"), F.min("entry_ts").alias("a"), F.max("entry_ts").alias("b"))
    tpy = labels.trades_per_year(F.col("n"), F.col("a"), F.col("b"))
    full = t.join(span.select("rule_id", tpy.alias("trades_per_year")), "rule_id")
    return stats.trade_stats(full, ["rule_id"], size=500)


@query(
    "evl_04_trade_stats",
    f"""WITH {STATS_CTE} SELECT rule_id, n AS trades, {R("ev")} AS ev_bps, {R("1.0 * wins / n")} AS win_rate, {R("gain / loss")} AS pf,
        {R("ev / sd * sqrt(tpy)")} AS sharpe, {R("ev / dn * sqrt(tpy)")} AS sortino, {R("ev / 10000 * tpy / abs(dd)", 4)} AS calmar,
        {R("dd")} AS max_dd FROM g""",
)
def evl_04(spark, sf):
    s = stat_frame(spark, sf).select("rule_id", "trades", "ev_bps", "win_rate", "pf", "sharpe", "sortino", "calmar", "max_dd")
    return rounded(rounded(s, "ev_bps", "win_rate", "pf", "sharpe", "sortino", "max_dd"), "calmar", digits=4)


@query(
    "evl_05_effective_n",
    f"""WITH {STATS_CTE} SELECT rule_id, {R("greatest(1, least(n * (1 - rho) / (1 + rho), n))", 4)} AS n_eff FROM g""",
)
def evl_05(spark, sf):
    return stat_frame(spark, sf).select("rule_id", rnd("n_eff", 4).alias("n_eff"))


@query("evl_06_trades_per_year", f"""WITH {STATS_CTE} SELECT rule_id, {R("tpy")} AS trades_per_year FROM g""")
def evl_06(spark, sf):
    return stat_frame(spark, sf).select("rule_id", rnd("trades_per_year").alias("trades_per_year"))


@query("top_04_top5_gain_share", f"""WITH {STATS_CTE} SELECT rule_id, {R("top5 / gain")} AS share FROM g""")
def top_04(spark, sf):
    t = stats.top_gain_share(order_trades(spark, sf), ["rule_id"], "ret_net_bps")
    return t.select("rule_id", rnd("top5_concentration").alias("share"))


# ---------------------------------------------------------------------- walk-forward

FOLDS_CTE = f"""{TRADES_CTE},
sp AS (SELECT rule_id, min(entry_ts) AS a, max(exit_ts) AS b, (max(exit_ts) - min(entry_ts)) / 6.0 AS w FROM ot GROUP BY 1),
fo AS (SELECT rule_id, f AS fold, a + f * w AS s, CASE WHEN f = 5 THEN b + 1 ELSE a + (f + 1) * w END AS e
  FROM sp, (SELECT unnest([1, 2, 3, 4, 5]) AS f))
"""


@query(
    "evl_07_walk_forward_roles",
    f"""WITH {FOLDS_CTE} SELECT rule_id, o_orderkey, CAST(fold AS BIGINT) AS fold, 'test' AS role FROM ot JOIN fo USING (rule_id)
        WHERE entry_ts >= s AND entry_ts < e UNION ALL SELECT rule_id, o_orderkey, CAST(fold AS BIGINT), 'train' FROM ot
        JOIN fo USING (rule_id) WHERE exit_ts <= s - 432000000""",
)
def evl_07(spark, sf):
    return splits.fold_roles(order_trades(spark, sf), ["rule_id"], 5).select("rule_id", "o_orderkey", "fold", "role")


@query(
    "evl_08_fold_stats",
    f"""WITH {FOLDS_CTE}, t AS (SELECT fo.rule_id, fold, avg(ret_net_bps) AS ev, CAST(count(ret_net_bps) AS BIGINT) AS n FROM fo
          LEFT JOIN ot ON ot.rule_id = fo.rule_id AND entry_ts >= s AND entry_ts < e GROUP BY 1, 2)
        SELECT rule_id, CAST(fold AS BIGINT) AS fold, {R("coalesce(ev, 0)")} AS ev_bps, n AS trades,
          {R("avg(CASE WHEN ev > 0 THEN 1.0 ELSE 0 END) OVER (PARTITION BY rule_id)")} AS fold_consistency FROM t""",
)
def evl_08(spark, sf):
    t = materialize(splits.assign_test_fold(order_trades(spark, sf), ["rule_id"], 5), "folds")
    s = splits.fold_stats(t, ["rule_id"])
    both = s.join(splits.fold_consistency(s, ["rule_id"]), "rule_id")
    return rounded(both.select("rule_id", "fold", "ev_bps", "trades", "fold_consistency"), "ev_bps", "fold_consistency")


# ------------------------------------------------------------------------ resampling


FULL = verdict.run_config("full")
PERMUTATIONS, BOOTSTRAPS = FULL["permutation_iterations"], FULL["bootstrap_iterations"]

PERMUTED_SQL = resample.shuffled_place_sql(
    f"(SELECT instrument_id, b, k, it FROM (SELECT DISTINCT instrument_id, b FROM f) JOIN n USING (instrument_id), (SELECT unnest(range({PERMUTATIONS})) AS it))",
    "it", "b", "k", 0, "nb",
)


@query(
    "evl_09_permutation_test",
    f"""WITH {LABEL_CTE}, f AS (SELECT instrument_id, pos, pos // 12 AS b, pos % 12 AS o, fwd_bps FROM lab WHERE close > 80 AND fwd_bps IS NOT NULL),
        n AS (SELECT instrument_id, (max(pos) + 12) // 12 AS k FROM lab GROUP BY 1), mv AS ({PERMUTED_SQL}),
        d AS (SELECT mv.instrument_id, it, avg(l.fwd_bps) AS nul FROM mv JOIN f USING (instrument_id, b) JOIN lab l ON
          l.instrument_id = mv.instrument_id AND l.pos = nb * 12 + o WHERE l.fwd_bps IS NOT NULL GROUP BY 1, 2),
        ob AS (SELECT instrument_id, avg(fwd_bps) AS obs, CAST(count(*) AS BIGINT) AS fires FROM f GROUP BY 1)
        SELECT ob.instrument_id, fires, {R("obs", 3)} AS observed_ev_bps,
          {R(f"(1 + count(*) FILTER (coalesce(nul, 0) >= obs)) / {PERMUTATIONS + 1}.0")} AS p_value,
          {R("avg(coalesce(nul, 0))", 3)} AS null_mean, {R("stddev_samp(coalesce(nul, 0))", 3)} AS null_std
        FROM ob CROSS JOIN (SELECT unnest(range({PERMUTATIONS})) AS it) i LEFT JOIN d ON d.instrument_id = ob.instrument_id AND d.it = i.it
        GROUP BY ob.instrument_id, fires, obs""",
)
def evl_09(spark, sf):
    lab = labels.forward_labels(hourly_ix(spark, sf), KEY, 1, 4).select("instrument_id", "pos", "close", "fwd_bps")
    lab = materialize(lab, "labels")
    fires = lab.filter(F.col("close") > 80).select("instrument_id", "pos")
    out = resample.permutation_test(fires, lab, KEY, KEY, 12, iterations=PERMUTATIONS)
    return rounded(rounded(out, "observed_ev_bps", "null_mean", "null_std", digits=3), "p_value")


RUNS_CTE = f"""{TRADES_CTE}, rx AS (SELECT rule_id, seq, ret_net_bps AS x FROM ot),
sz AS (SELECT rule_id, CAST(count(*) AS BIGINT) AS n FROM rx GROUP BY 1),
ru AS ({resample.bootstrap_runs_sql("sz", "rule_id", 12, BOOTSTRAPS)})
"""
DRAWS_CTE = f"""{RUNS_CTE}, dr AS (SELECT rule_id, it, t + k AS t, (start + k) % n AS idx FROM ru, LATERAL (SELECT unnest(range(len)) AS k) kk),
dv AS (SELECT dr.rule_id, it, t, x FROM dr JOIN rx ON rx.rule_id = dr.rule_id AND rx.seq = dr.idx)
"""


def bootstrap_sample(spark, sf):
    """The trade stand-in as one return series per rule, written once for all draws."""
    return materialize(order_trades(spark, sf).select("rule_id", "seq", "ret_net_bps"), "returns")


@query(
    "evl_10_stationary_bootstrap_draws",
    f"""WITH {RUNS_CTE} SELECT rule_id, it AS iter, CAST(count(*) AS BIGINT) AS runs, CAST(sum(len) AS BIGINT) AS n,
        CAST(sum(start * (t % 7 + 1)) AS BIGINT) AS mix FROM ru GROUP BY 1, 2""",
)
def evl_10(spark, sf):
    sizes = bootstrap_sample(spark, sf).groupBy("rule_id").agg(F.count(F.lit(1)).alias("n"))
    runs = resample.bootstrap_runs(sizes, ["rule_id"], 12, BOOTSTRAPS, 0)
    return runs.groupBy("rule_id", "iter").agg(
        F.count(F.lit(1)).alias("runs"), F.sum("len").alias("n"), F.sum(F.col("start") * (F.col("t") % 7 + 1)).alias("mix")
    )


@query(
    "evl_11_bootstrap_ci",
    f"""WITH {DRAWS_CTE}, m AS (SELECT rule_id, it, avg(x) AS s FROM dv GROUP BY 1, 2), p AS (SELECT rule_id, avg(x) AS point FROM rx GROUP BY 1)
        SELECT m.rule_id, {R("any_value(point)")} AS point, {R("quantile_cont(s, 0.025)")} AS ci_lo, {R("quantile_cont(s, 0.975)")} AS ci_hi
        FROM m JOIN p USING (rule_id) GROUP BY 1""",
)
def evl_11(spark, sf):
    s = bootstrap_sample(spark, sf)
    out = resample.bootstrap_ci(s, ["rule_id"], "ret_net_bps", resample.mean_statistic, 12, BOOTSTRAPS)
    return rounded(out, "point", "ci_lo", "ci_hi")


@query(
    "evl_12_sharpe_and_drawdown_ci",
    f"""WITH {DRAWS_CTE}, q AS (SELECT *, product(1 + x / 10000) OVER (PARTITION BY rule_id, it ORDER BY t) AS eq FROM dv),
        w AS (SELECT *, max(eq) OVER (PARTITION BY rule_id, it ORDER BY t) AS top FROM q),
        m AS (SELECT rule_id, it, avg(x) / stddev_samp(x) AS sr, min((eq - top) / top) AS dd FROM w GROUP BY 1, 2)
        SELECT rule_id, {R("quantile_cont(sr, 0.025)")} AS sharpe_lo, {R("quantile_cont(sr, 0.975)")} AS sharpe_hi,
          {R("quantile_cont(dd, 0.025)")} AS dd_lo, {R("quantile_cont(dd, 0.975)")} AS dd_hi FROM m GROUP BY 1""",
)
def evl_12(spark, sf):
    s = bootstrap_sample(spark, sf)
    sharpe = resample.bootstrap_ci(s, ["rule_id"], "ret_net_bps", resample.sharpe_statistic(), 12, BOOTSTRAPS)
    dd = resample.bootstrap_ci(s, ["rule_id"], "ret_net_bps", resample.drawdown_statistic, 12, BOOTSTRAPS)
    both = sharpe.select("rule_id", F.col("ci_lo").alias("sharpe_lo"), F.col("ci_hi").alias("sharpe_hi")).join(
        dd.select("rule_id", F.col("ci_lo").alias("dd_lo"), F.col("ci_hi").alias("dd_hi")), "rule_id"
    )
    return rounded(both, "sharpe_lo", "sharpe_hi", "dd_lo", "dd_hi")


@query(
    "udf_02_pluggable_statistic",
    f"""WITH {DRAWS_CTE}, m AS (SELECT rule_id, it, max(x) - min(x) AS s FROM dv GROUP BY 1, 2)
        SELECT rule_id, {R("(SELECT max(x) - min(x) FROM rx WHERE rx.rule_id = m.rule_id)")} AS point, {R("quantile_cont(s, 0.025)")} AS ci_lo,
          {R("quantile_cont(s, 0.975)")} AS ci_hi FROM m GROUP BY 1""",
)
def udf_02(spark, sf):
    span = resample.extremes_statistic({"hi": "max", "lo": "min"}, lambda hi, lo: hi - lo)
    out = resample.bootstrap_ci(bootstrap_sample(spark, sf), ["rule_id"], "ret_net_bps", span, 12, BOOTSTRAPS)
    return rounded(out, "point", "ci_lo", "ci_hi")


@query(
    "evl_13_sample_moments",
    f"""WITH {STATS_CTE} SELECT rule_id, n, {R("ev")} AS mean, {R("sd")} AS std, {R("ev / sd")} AS sr_hat, {R("skew")} AS skew, {R("kurt")} AS kurt FROM g""",
)
def evl_13(spark, sf):
    m = stats.sample_moments(order_trades(spark, sf), ["rule_id"], "ret_net_bps")
    return rounded(m, "mean", "std", "sr_hat", "skew", "kurt")


@query(
    "evl_14_deflated_sharpe",
    f"""WITH {STATS_CTE}, v AS (SELECT rule_id, n, (ev + 1) / sd AS sr, greatest(1 - skew * (ev + 1) / sd + (kurt - 1) / 4 * pow((ev + 1) / sd, 2), 1e-12) AS q FROM g),
        b AS (SELECT *, sqrt(q / (n - 1)) * ((1 - 0.5772156649015329) * 1.2815515655446008 + 0.5772156649015329 * 1.7892417645816279) AS sr0 FROM v),
        z AS (SELECT *, sr * sqrt(n - 1) / sqrt(q) AS z0, (sr - sr0) * sqrt(n - 1) / sqrt(q) AS z1 FROM b)
        SELECT rule_id, {R(cdf_sql("z0"))} AS psr, {R("sr0")} AS expected_max, {R(cdf_sql("z1"))} AS dsr FROM z""",
)
def evl_14(spark, sf):
    # gross returns of the stand-in, best of ten tries
    m = stats.sample_moments(order_trades(spark, sf), ["rule_id"], "ret_bps")
    a = (F.col("sr_hat"), F.col("skew"), F.col("kurt"), F.col("n"))
    return m.select(
        "rule_id",
        rnd(stats.probabilistic_sharpe(a[0], F.lit(0.0), *a[1:])).alias("psr"),
        rnd(stats.expected_max_sharpe(F.lit(10), *a)).alias("expected_max"),
        rnd(stats.deflated_sharpe(F.lit(10), *a)).alias("dsr"),
    )


# --------------------------------------------------------------- segments and verdict


@query(
    "evl_15_regime_segments",
    f"""WITH {TRADES_CTE} SELECT rule_id, o_orderstatus AS label, {R("avg(ret_net_bps)")} AS ev_bps, CAST(count(*) AS BIGINT) AS trades,
        {R("min(avg(ret_net_bps)) OVER (PARTITION BY rule_id)")} AS worst FROM ot GROUP BY 1, 2""",
)
def evl_15(spark, sf):
    seg = stats.by_label(order_trades(spark, sf), ["rule_id"], F.col("o_orderstatus"))
    worst = seg.groupBy("rule_id").agg(F.min("ev_bps").alias("worst"))
    return rounded(seg.join(worst, "rule_id"), "ev_bps", "worst")


@query(
    "evl_16_year_segments",
    f"""WITH {TRADES_CTE}, l AS (SELECT rule_id, max(entry_ts) AS last FROM ot GROUP BY 1), rc AS (SELECT rule_id, avg(ret_net_bps) AS recent
          FROM ot JOIN l USING (rule_id) WHERE entry_ts >= last - 63072000000 GROUP BY 1)
        SELECT rule_id, CAST(year(make_timestamp(entry_ts * 1000)) AS BIGINT) AS label, {R("avg(ret_net_bps)")} AS ev_bps,
        CAST(count(*) AS BIGINT) AS trades, {R("any_value(recent)")} AS recent_ev_bps FROM ot JOIN rc USING (rule_id) GROUP BY 1, 2""",
)
def evl_16(spark, sf):
    t = order_trades(spark, sf)
    seg = stats.by_label(t, ["rule_id"], utc_year("entry_ts").cast("bigint"))
    return rounded(seg.join(stats.recent_mean(t, ["rule_id"]), "rule_id"), "ev_bps", "recent_ev_bps")


@query("evl_17_zero_cost", f"WITH {TRADES_CTE} SELECT rule_id, {R('avg(ret_bps)')} AS ev_bps FROM ot GROUP BY 1")
def evl_17(spark, sf):
    return rounded(order_trades(spark, sf).groupBy("rule_id").agg(F.avg("ret_bps").alias("ev_bps")), "ev_bps")


@query(
    "evl_18_long_metrics",
    f"""WITH {STATS_CTE} SELECT rule_id, 'overall' AS segment, metric, value FROM (SELECT rule_id, {R("ev")} AS ev_bps, {R("1.0 * wins / n")} AS win_rate,
        {R("gain / loss")} AS pf, {R("ev / sd * sqrt(tpy)")} AS sharpe, CAST(n AS DOUBLE) AS trades FROM g)
        UNPIVOT (value FOR metric IN (ev_bps, win_rate, pf, sharpe, trades))""",
)
def evl_18(spark, sf):
    s = stat_frame(spark, sf)
    names = ["ev_bps", "win_rate", "pf", "sharpe", "trades"]
    wide = s.select("rule_id", *[rnd(F.col(n).cast("double")).alias(n) for n in names])
    return wide.unpivot(["rule_id"], names, "metric", "value").withColumn("segment", F.lit("overall"))


VERDICT_INPUT_SQL = """o_orderkey, o_totalprice / 250000 - 0.6 AS ci_hi, (o_orderkey % 40) / 100.0 AS p, 0.4 + (o_orderkey % 7) / 10.0 AS dsr,
  CASE WHEN o_orderstatus <> 'P' THEN o_totalprice / 100000 - 1 END AS rec, o_totalprice / 250000 - 1 AS ci_lo, o_totalprice / 150000 AS sharpe,
  10.0 + o_orderkey % 60 AS n_eff, (o_orderkey % 6) / 5.0 AS fc, o_totalprice / 100000 - 2 AS worst, (o_orderkey % 9) / 10.0 AS t5,
  CASE WHEN o_orderkey % 2 = 0 THEN (o_orderkey % 10) / 10.0 END AS corr"""


def verdict_inputs(spark, sf):
    """Plausible metric inputs derived from each order."""
    from barline.plans.catalog.base import table

    k, p = F.col("o_orderkey"), F.col("o_totalprice")
    return table(spark, sf, "orders").select(
        "o_orderkey",
        (p / 250000 - 0.6).alias("ev_bps_ci_hi"),
        (k % 40 / 100.0).alias("p_perm"),
        (0.4 + k % 7 / 10.0).alias("dsr"),
        F.when(F.col("o_orderstatus") != "P", p / 100000 - 1).alias("recent_ev_bps"),
        (p / 250000 - 1).alias("ev_bps_ci_lo"),
        (p / 150000).alias("sharpe"),
        (10.0 + k % 60).alias("n_eff"),
        (k % 6 / 5.0).alias("fold_consistency"),
        (p / 100000 - 2).alias("regime_worst_ev_bps"),
        F.lit(1.0).alias("ev_bps"),
        (k % 9 / 10.0).alias("top5_concentration"),
        F.when(k % 2 == 0, k % 10 / 10.0).alias("corr_max_active"),
    )


REJECT_SQL = "ci_hi < 0 OR p > 0.3 OR dsr < 0.5 OR coalesce(rec < 0, false)"
ADOPT_SQL = """ci_lo > 0 AND sharpe >= 1 AND dsr >= 0.9 AND p < 0.05 AND n_eff >= 30 AND fc >= 0.7 AND worst > -2 AND t5 < 0.6
  AND coalesce(corr < 0.7, true)"""


@query(
    "evl_19_verdict",
    f"""WITH v AS (SELECT {VERDICT_INPUT_SQL} FROM orders) SELECT o_orderkey, CASE WHEN {REJECT_SQL} THEN 'REJECT' WHEN {ADOPT_SQL} THEN 'ADOPT'
        ELSE 'WATCH' END AS verdict, CAST(CASE WHEN {REJECT_SQL} THEN 3 + (rec IS NOT NULL)::INT ELSE 11 + (rec IS NOT NULL)::INT + (corr IS NOT NULL)::INT
        END AS BIGINT) AS n_reasons, CASE WHEN ci_hi < 0 THEN 'reject.ci_upper_below_zero' WHEN p > 0.3 THEN 'reject.p_perm_too_high'
        WHEN dsr < 0.5 THEN 'reject.dsr_too_low' WHEN rec < 0 THEN 'reject.recent_2y_ev_negative' WHEN ci_lo <= 0 THEN 'adopt.ci_lower_above_zero'
        WHEN sharpe < 1 THEN 'adopt.sharpe' WHEN dsr < 0.9 THEN 'adopt.dsr' WHEN p >= 0.05 THEN 'adopt.p_perm' WHEN n_eff < 30 THEN 'adopt.n_eff'
        WHEN fc < 0.7 THEN 'adopt.fold_consistency' WHEN worst <= -2 THEN 'adopt.regime_worst_ev' WHEN t5 >= 0.6 THEN 'adopt.top5_concentration'
        WHEN corr >= 0.7 THEN 'adopt.corr_max_active' END AS first_failed FROM v""",
)
def evl_19(spark, sf):
    d = verdict.decide(verdict_inputs(spark, sf))
    failed = F.filter("reasons", lambda r: ~r["passed"])
    return d.select(
        "o_orderkey",
        "verdict",
        F.size("reasons").cast("bigint").alias("n_reasons"),
        F.get(failed, F.lit(0))["check"].alias("first_failed"),
    )


@query(
    "evl_20_score",
    f"""WITH v AS (SELECT {VERDICT_INPUT_SQL} FROM orders) SELECT o_orderkey, {R("40 * least(dsr, 1) + 20 * least(sharpe / 2, 1) + 15 * fc + 15 * (1 - t5) + 10")}
        AS score FROM v""",
)
def evl_20(spark, sf):
    return verdict_inputs(spark, sf).select("o_orderkey", rnd(verdict.score()).alias("score"))


@query(
    "evl_21_run_configs",
    """SELECT run_kind, CAST(count(*) AS BIGINT) AS runs, CAST(CASE run_kind WHEN '1-URGENT' THEN 3 ELSE 5 END AS BIGINT) AS n_folds,
       CAST(sum(CASE run_kind WHEN '1-URGENT' THEN 200 ELSE 1000 END) AS BIGINT) AS iterations FROM (SELECT o_orderpriority AS run_kind FROM orders) GROUP BY 1""",
)
def evl_21(spark, sf):
    # configuration joined by run kind; unknown kinds run at full rigour
    from barline.plans.catalog.base import table

    c = {k: verdict.run_config(k) for k in ("screen", "other")}
    screen = F.col("run_kind") == "1-URGENT"
    o = table(spark, sf, "orders").select(F.col("o_orderpriority").alias("run_kind"))
    pick = {n: F.when(screen, c["screen"][n]).otherwise(c["other"][n]) for n in ("n_folds", "permutation_iterations")}
    return o.groupBy("run_kind").agg(
        F.count(F.lit(1)).alias("runs"),
        F.max(pick["n_folds"]).cast("bigint").alias("n_folds"),
        F.sum(pick["permutation_iterations"]).alias("iterations"),
    )


# -------------------------------------------------------------------------- flagship

FLAGSHIP_SQL = f"""WITH {MOMENTUM_CTE} SELECT instrument_id, CAST(count(*) AS BIGINT) AS trades, {R("avg(ret_net_bps)", 3)} AS ev_bps,
  {R("avg(CASE WHEN ret_net_bps > 0 THEN 1.0 ELSE 0 END)")} AS win_rate, {R("stddev_samp(ret_net_bps)", 3)} AS sd_bps FROM tr GROUP BY 1"""


@query("flagship_rule_to_statistics", FLAGSHIP_SQL)
def flagship(spark, sf):
    """Ticks to bars to feature to rule to forward labels to statistics per series."""
    t = momentum_trades(spark, sf)
    out = t.groupBy("instrument_id").agg(
        F.count(F.lit(1)).alias("trades"),
        F.avg("ret_net_bps").alias("ev_bps"),
        F.avg(F.when(F.col("ret_net_bps") > 0, 1.0).otherwise(0.0)).alias("win_rate"),
        F.stddev_samp("ret_net_bps").alias("sd_bps"),
    )
    return rounded(rounded(out, "win_rate"), "ev_bps", "sd_bps", digits=3)

