"""Catalogue: regimes, data quality, stream health and ledger queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from barline.functions.scalar import ms
from barline.operators import ledger, quality, regimes
from barline.operators.series import DAY_MS, HOUR_MS, index_rows, time_bucket
from barline.plans.catalog.base import (
    DAILY_CTE,
    HOURLY_CTE,
    R,
    daily_ix,
    hourly_ix,
    query,
    rnd,
    rounded,
    table,
)
from barline.plans.catalog.joins import LEDGER_CTE, edges, metrics, runs, sources, verdicts, versions
from barline.plans.catalog.scalars import STREAM_ID_SQL, stream_id
from barline.plans.catalog.windows import full

KEY = ["instrument_id"]

# -------------------------------------------------------------------------- regimes

ADX_CTE = f"""{DAILY_CTE},
m AS (SELECT *, high - lag(high) OVER o AS up, lag(low) OVER o - low AS dn, lag(close) OVER o AS pc,
  ln(close) - lag(ln(close)) OVER o AS lr FROM dx WINDOW o AS (PARTITION BY instrument_id ORDER BY pos)),
t AS (SELECT *, CASE WHEN up > dn AND up > 0 THEN up ELSE 0 END AS p, CASE WHEN dn > up AND dn > 0 THEN dn ELSE 0 END AS q,
  greatest(high - low, coalesce(abs(high - pc), 0), coalesce(abs(low - pc), 0)) AS tr,
  {full("avg", "close", 200)} AS sma200, {full("stddev_samp", "lr", 30)} * sqrt(365.0) AS rv FROM m),
e AS (SELECT instrument_id, pos, tr AS a, p::DOUBLE AS p, q::DOUBLE AS q, NULL::DOUBLE AS adx, 0 AS seen FROM t WHERE pos = 0
  UNION ALL SELECT instrument_id, pos, a, p, q, CASE WHEN dx IS NULL THEN adx WHEN adx IS NULL THEN dx ELSE adx * (1 - 1.0 / 14) + dx / 14 END,
  seen + CASE WHEN dx IS NULL THEN 0 ELSE 1 END FROM (SELECT *, CASE WHEN pos >= 13 AND p + q > 0 THEN 100 * abs(p - q) / (p + q) END AS dx FROM
    (SELECT t.instrument_id, t.pos, e.a * (1 - 1.0 / 14) + t.tr / 14 AS a, e.p * (1 - 1.0 / 14) + t.p / 14 AS p,
     e.q * (1 - 1.0 / 14) + t.q / 14 AS q, e.adx, e.seen FROM e JOIN t ON t.instrument_id = e.instrument_id AND t.pos = e.pos + 1))),
rk AS (SELECT t.*, list(rv) OVER (PARTITION BY instrument_id ORDER BY pos ROWS BETWEEN 364 PRECEDING AND CURRENT ROW) AS xs,
  count(rv) OVER (PARTITION BY instrument_id ORDER BY pos ROWS BETWEEN 364 PRECEDING AND CURRENT ROW) AS seen_rv FROM t),
lb AS (SELECT instrument_id, pos, ts, CASE WHEN sma200 IS NOT NULL AND seen >= 14 THEN CASE WHEN adx >= 20 AND close > sma200 THEN 'up'
  WHEN adx >= 20 THEN 'down' ELSE 'range' END END AS trend, CASE WHEN r IS NOT NULL THEN CASE WHEN r >= 0.9 THEN 'extreme' WHEN r <= 0.33 THEN 'low'
  ELSE 'high' END END AS vol, 'normal' AS liquidity, r FROM
  (SELECT rk.*, e.adx, e.seen, CASE WHEN seen_rv >= 91 AND rv IS NOT NULL THEN 1.0 * len(list_filter(xs, lambda v: v < rv)) / least(pos + 1, 365) END AS r
   FROM rk JOIN e USING (instrument_id, pos)))
"""


def labels(spark, sf):
    return regimes.classify(daily_ix(spark, sf), KEY)


@query("reg_01_trend", f"WITH RECURSIVE {ADX_CTE} SELECT instrument_id, ts, trend FROM lb")
def reg_01(spark, sf):
    return labels(spark, sf).select("instrument_id", "ts", "trend")


@query("reg_02_vol", f"WITH RECURSIVE {ADX_CTE} SELECT instrument_id, ts, {R('r')} AS rv_rank, vol FROM lb")
def reg_02(spark, sf):
    return labels(spark, sf).select("instrument_id", "ts", rnd("rv_rank").alias("rv_rank"), "vol")


@query(
    "reg_03_liquidity",
    """SELECT o_orderkey, CASE WHEN o_orderkey % 5 = 0 AND o_orderkey % 3 = 0 AND o_orderkey % 2 = 0 THEN NULL
         WHEN coalesce(s >= 0.9, false) OR coalesce(abs(z) >= 3, false) OR coalesce(abs(p) >= 50, false) THEN 'stressed' ELSE 'normal' END AS liquidity
       FROM (SELECT o_orderkey, CASE WHEN o_orderkey % 5 <> 0 THEN (o_orderkey % 100) / 100.0 END AS s, CASE WHEN o_orderkey % 3 <> 0
         THEN o_totalprice / 100000 - 1 END AS z, CASE WHEN o_orderkey % 2 <> 0 THEN o_totalprice / 6000 - 40 END AS p FROM orders)""",
)
def reg_03(spark, sf):
    k, p = F.col("o_orderkey"), F.col("o_totalprice")
    label = regimes.liquidity_label(
        regimes.Thresholds(),
        F.when(k % 5 != 0, k % 100 / 100.0),
        F.when(k % 3 != 0, p / 100000 - 1),
        F.when(k % 2 != 0, p / 6000 - 40),
    )
    return table(spark, sf, "orders").select("o_orderkey", label.alias("liquidity"))


@query("reg_04_regime_frame", f"WITH RECURSIVE {ADX_CTE} SELECT instrument_id, ts, trend, vol, liquidity FROM lb")
def reg_04(spark, sf):
    # the spread input is constant 0, so it is never ranked stressed
    return labels(spark, sf).select("instrument_id", "ts", "trend", "vol", "liquidity")


DT_SQL = "strftime(make_timestamp(ts * 1000), '%Y-%m-%d') AS dt"


@query(
    "reg_05_history",
    f"""WITH RECURSIVE {ADX_CTE} SELECT instrument_id, {DT_SQL}, trend, vol, liquidity, 'rule-based-1.0' AS model_version FROM lb
        WHERE trend IS NOT NULL AND vol IS NOT NULL""",
)
def reg_05(spark, sf):
    return regimes.history(labels(spark, sf), KEY)


@query(
    "reg_05_current",
    f"""WITH RECURSIVE {ADX_CTE} SELECT instrument_id, {DT_SQL}, trend, vol, liquidity, 'rule-based-1.0' AS model_version FROM lb
        WHERE trend IS NOT NULL AND vol IS NOT NULL QUALIFY pos = max(pos) OVER (PARTITION BY instrument_id)""",
)
def reg_05_current(spark, sf):
    return regimes.current(labels(spark, sf), KEY)


# --------------------------------------------------------------------- data quality

STREAM_CTE = f"""
sv AS (SELECT {STREAM_ID_SQL} || (user_id % 10) AS stream_id, event_id, epoch_us(ts) // 1000 AS ts, value, value > 30 AS failed FROM events)
"""


def stream_runs(spark, sf):
    """One run per event; a value over 30 counts as a failed run, over 80 as rate limited."""
    return table(spark, sf, "events").select(
        F.concat(stream_id(), (F.col("user_id") % 10).cast("string")).alias("stream_id"),
        "event_id",
        ms("ts").alias("ts"),
        "value",
    )


@query(
    "dq_a_error_streaks",
    f"""WITH {STREAM_CTE}, g AS (SELECT *, sum(CASE WHEN failed THEN 0 ELSE 1 END) OVER (PARTITION BY stream_id ORDER BY ts, event_id) AS grp FROM sv),
        s AS (SELECT *, CASE WHEN failed THEN sum(CASE WHEN failed THEN 1 ELSE 0 END) OVER (PARTITION BY stream_id, grp ORDER BY ts, event_id) ELSE 0 END AS streak FROM g)
        SELECT stream_id, event_id, CAST(streak AS BIGINT) AS streak, CAST(CASE WHEN value > 80 THEN 6 ELSE 3 END AS BIGINT) AS threshold, 'DQ-02' AS rule_id
        FROM s WHERE streak = CASE WHEN value > 80 THEN 6 ELSE 3 END""",
)
def dq_a(spark, sf):
    r = stream_runs(spark, sf)
    text = F.when(F.col("value") > 80, "HTTP 429 too many requests").otherwise("HTTP 500")
    s = quality.error_streaks(r, "stream_id", ["ts", "event_id"], F.col("value") > 30, time_bucket("ts", DAY_MS))
    return quality.escalations(s, text).select("stream_id", "event_id", "streak", "threshold", "rule_id")


@query(
    "dq_b_auto_resolve",
    f"""WITH {STREAM_CTE}, i AS (SELECT event_id AS issue_id, stream_id, ts AS detected_at, CASE WHEN event_id % 3 = 0 THEN 'resolved' ELSE 'open' END AS status
          FROM sv WHERE value > 60), n AS (SELECT i.*, (SELECT min(ts) FROM sv WHERE sv.stream_id = i.stream_id AND sv.value <= 5 AND sv.ts > i.detected_at) AS nx FROM i)
        SELECT issue_id, stream_id, CASE WHEN status = 'open' AND nx IS NOT NULL THEN 'resolved' ELSE status END AS status,
          CASE WHEN status = 'open' THEN nx END AS resolved_at FROM n""",
)
def dq_b(spark, sf):
    r = stream_runs(spark, sf)
    issues = r.filter(F.col("value") > 60).select(
        F.col("event_id").alias("issue_id"),
        "stream_id",
        F.col("ts").alias("detected_at"),
        F.when(F.col("event_id") % 3 == 0, "resolved").otherwise("open").alias("status"),
        F.lit(None).cast("bigint").alias("resolved_at"),
    )
    ok = r.filter(F.col("value") <= 5).select("stream_id", "ts")
    return quality.auto_resolve(issues, ok).select("issue_id", "stream_id", "status", "resolved_at")


@query(
    "dq_c_quota",
    f"""WITH u AS (SELECT strftime(ts, '%Y-%m-%d') AS dt, event_type AS resource, count(*) AS value, CASE event_type WHEN 'click' THEN 'Infinity'::DOUBLE
          WHEN 'view' THEN 0 ELSE 80 END AS budget FROM events GROUP BY 1, 2)
        SELECT 'quota:' || resource || ':' || dt AS stream_id, 'DQ-10' AS rule_id, 'critical' AS severity, {R("value / budget")} AS ratio FROM u
        WHERE budget > 0 AND budget < 'Infinity'::DOUBLE AND value / budget >= 0.8 AND right(dt, 1) <> '5'""",
)
def dq_c(spark, sf):
    e = table(spark, sf, "events").select(F.date_format("ts", "yyyy-MM-dd").alias("dt"), F.col("event_type").alias("resource"))
    budget = F.when(F.col("resource") == "click", float("inf")).when(F.col("resource") == "view", 0.0).otherwise(80.0)
    usage = e.groupBy("dt", "resource").agg(F.count(F.lit(1)).alias("value")).withColumn("budget", budget)
    # days that end in 5 were reported before
    raised = usage.filter(F.col("dt").endswith("5")).select(
        F.concat_ws(":", F.lit("quota"), "resource", "dt").alias("stream_id"), F.lit("DQ-10").alias("rule_id")
    )
    return rounded(quality.quota_issues(usage, raised), "ratio")


@query(
    "dq_d_dead_tasks",
    """SELECT 'task:' || o_orderkey AS stream_id, 'DQ-TASK-DEAD' AS rule_id, 'critical' AS severity, CAST(o_orderkey % 8 + 1 AS BIGINT) AS attempts
       FROM orders WHERE o_orderkey % 8 + 1 >= 6""",
)
def dq_d(spark, sf):
    t = table(spark, sf, "orders").select(
        F.concat(F.lit("task:"), F.col("o_orderkey").cast("string")).alias("stream_id"), (F.col("o_orderkey") % 8).alias("attempts")
    )
    return quality.dead_tasks(t)


NOW = 1_706_572_800_000
HEALTH_CTE = f"""{STREAM_CTE},
stt AS (SELECT stream_id, max(ts) AS last_run_at, CAST(count(*) FILTER (value > 130) AS BIGINT) AS consecutive_errors FROM sv GROUP BY 1),
cad AS (SELECT *, CASE WHEN stream_id LIKE '%candles_1m%' OR stream_id LIKE '%open_interest%' THEN 300000 WHEN stream_id LIKE '%dvol%' THEN 3600000
  ELSE 86400000 END AS c, split_part(stream_id, ':', 1) AS source_id FROM stt),
src AS (SELECT unnest(['okx_rest', 'deribit_rest', 'other']) AS source_id, unnest(['active', 'disabled', 'active']) AS status),
iss AS (SELECT stream_id, CASE CAST(floor(value) AS BIGINT) % 3 WHEN 0 THEN 'critical' WHEN 1 THEN 'warn' ELSE 'info' END AS severity, event_id AS issue_id,
  ts AS detected_at, CASE WHEN event_id % 2 = 0 THEN 'open' ELSE 'resolved' END AS status FROM sv WHERE value > 100),
qs AS (SELECT cad.*, greatest(0, least(1, 1 - greatest({NOW} - last_run_at - c, 0) / (2.0 * c))) * greatest(0, 1 - consecutive_errors / 10.0) AS score,
  src.status AS source_status FROM cad LEFT JOIN src USING (source_id))
"""


def health(spark, sf):
    r = stream_runs(spark, sf)
    state = r.groupBy("stream_id").agg(
        F.max("ts").alias("last_run_at"), F.count(F.when(F.col("value") > 130, 1)).alias("consecutive_errors")
    )
    return quality.stream_health(state, stream_issues(spark, sf), sources(spark, sf), F.lit(NOW))


def stream_issues(spark, sf):
    sev = F.element_at(
        F.array(*[F.lit(s) for s in quality.SEVERITIES]), (F.floor("value").cast("bigint") % 3 + 1).cast("int")
    )
    return stream_runs(spark, sf).filter(F.col("value") > 100).select(
        "stream_id",
        sev.alias("severity"),
        F.col("event_id").alias("issue_id"),
        F.col("ts").alias("detected_at"),
        F.when(F.col("event_id") % 2 == 0, "open").otherwise("resolved").alias("status"),
    )


@query(
    "dq_e_stream_scores",
    f"WITH {HEALTH_CTE} SELECT stream_id, source_id, {R('score')} AS quality_score, source_status FROM qs",
)
def dq_e(spark, sf):
    h = health(spark, sf)
    return h.select("stream_id", "source_id", rnd("quality_score").alias("quality_score"), "source_status")


@query(
    "agg_09_issues_by_severity",
    f"""WITH {HEALTH_CTE} SELECT stream_id, CAST(count(*) FILTER (severity = 'critical') AS BIGINT) AS critical, CAST(count(*) FILTER (severity = 'warn') AS BIGINT)
        AS warn, CAST(count(*) FILTER (severity = 'info') AS BIGINT) AS info FROM iss WHERE status = 'open' GROUP BY 1""",
)
def agg_09(spark, sf):
    return quality.issue_counts(stream_issues(spark, sf))


@query(
    "dq_f_overall_score",
    f"""WITH {HEALTH_CTE} SELECT {R("avg(score)")} AS overall_quality_score, CAST(count(*) AS BIGINT) AS streams FROM qs
        WHERE coalesce(source_status, '') <> 'disabled'""",
)
def dq_f(spark, sf):
    return rounded(quality.overall_score(health(spark, sf)), "overall_quality_score")


@query(
    "dq_f_source_rollup",
    f"""WITH {HEALTH_CTE}, ic AS (SELECT stream_id, count(*) FILTER (severity = 'critical') AS critical FROM iss WHERE status = 'open' GROUP BY 1)
        SELECT source_id, src.status, CAST(count(*) AS BIGINT) AS streams, {R("avg(score)")} AS mean_score, CAST(sum(coalesce(critical, 0)) AS BIGINT) AS critical,
        CAST(CASE WHEN src.status = 'disabled' THEN 1 ELSE 0 END AS BIGINT) AS sort_key FROM src JOIN qs USING (source_id) LEFT JOIN ic USING (stream_id) GROUP BY 1, 2""",
)
def dq_f_sources(spark, sf):
    s = quality.source_health(health(spark, sf), sources(spark, sf))
    return s.select(
        "source_id", "status", "streams", rnd("mean_score").alias("mean_score"), "critical", F.col("sort_key").cast("bigint").alias("sort_key")
    )


@query(
    "dq_f_open_issues",
    f"""WITH {HEALTH_CTE} SELECT issue_id, stream_id, severity FROM iss WHERE status = 'open'
        AND split_part(stream_id, ':', 1) <> 'deribit_rest'""",
)
def dq_f_issues(spark, sf):
    return quality.open_issues(stream_issues(spark, sf), sources(spark, sf)).select("issue_id", "stream_id", "severity")


@query(
    "dq_g_bulk_resolve",
    f"""WITH {HEALTH_CTE} SELECT issue_id, CASE WHEN status = 'open' AND split_part(stream_id, ':', 1) IN ('okx_rest', 'other') THEN 'resolved' ELSE status END
        AS status, CASE WHEN status = 'open' AND split_part(stream_id, ':', 1) IN ('okx_rest', 'other') THEN {NOW} END AS resolved_at FROM iss""",
)
def dq_g(spark, sf):
    i = stream_issues(spark, sf).withColumn("resolved_at", F.lit(None).cast("bigint"))
    return quality.bulk_resolve(i, ["okx_rest", "other"], F.lit(NOW)).select("issue_id", "status", "resolved_at")


# --------------------------------------------------------------------------- ledger


@query(
    "qry_01_edge_list",
    f"""WITH {LEDGER_CTE}, lv AS (SELECT edge_id, verdict, score FROM verdicts JOIN er USING (run_id)
          QUALIFY row_number() OVER (PARTITION BY edge_id ORDER BY decided_at DESC, run_id DESC) = 1), tc AS (SELECT edge_id, count(*) AS n FROM er
          WHERE run_kind IN ('screen', 'full') GROUP BY 1)
        SELECT e.edge_id, e.title, e.status, lv.verdict AS latest_verdict, lv.score AS latest_score, CAST(coalesce(n, 0) AS BIGINT) AS trial_count FROM edges e
        LEFT JOIN lv USING (edge_id) LEFT JOIN tc USING (edge_id) WHERE e.category = 'BUILDING'""",
)
def qry_01(spark, sf):
    e = edges(spark, sf).filter(F.col("category") == "BUILDING")
    out = ledger.edge_list(e, versions(spark, sf), runs(spark, sf), verdicts(spark, sf))
    return out.select("edge_id", "title", "status", "latest_verdict", "latest_score", "trial_count")


@query(
    "qry_02_edge_detail_runs",
    f"""WITH {LEDGER_CTE}, p AS (SELECT r.*, v.edge_id FROM runs r JOIN versions v ON v.version_id = r.edge_version_id AND v.is_current = 1
          QUALIFY row_number() OVER (PARTITION BY edge_version_id ORDER BY coalesce(finished_at, started_at, 0) DESC, run_id DESC) <= 5),
        o AS (SELECT run_id, max(value) FILTER (metric = 'ev_bps') AS ev_bps, max(value) FILTER (metric = 'sharpe') AS sharpe, max(value) FILTER (metric = 'dsr') AS dsr,
          max(value) FILTER (metric = 'p_perm') AS p_perm FROM metrics WHERE segment = 'wf:oos' GROUP BY 1)
        SELECT p.edge_id, p.run_id, p.run_kind, v.verdict, {R("o.ev_bps")} AS ev_bps, {R("o.sharpe")} AS sharpe, {R("o.dsr")} AS dsr, {R("o.p_perm")} AS p_perm
        FROM p LEFT JOIN verdicts v USING (run_id) LEFT JOIN o USING (run_id)""",
)
def qry_02(spark, sf):
    d = ledger.edge_detail_runs(versions(spark, sf), runs(spark, sf), metrics(spark, sf), verdicts(spark, sf))
    out = d.select("edge_id", "run_id", "run_kind", "verdict", "ev_bps", "sharpe", "dsr", "p_perm")
    return rounded(out, "ev_bps", "sharpe", "dsr", "p_perm")


def signals(spark, sf):
    """Paper signals from line items: version by supplier and part, closed when flag is not N."""
    li = table(spark, sf, "lineitem")
    return li.groupBy((F.col("l_partkey") % 3000).alias("edge_version_id"), F.col("l_orderkey").alias("signal_id")).agg(
        F.max(ms("l_shipdate")).alias("ts_signal"),
        F.when(F.min("l_returnflag") == "N", "open").otherwise("closed").alias("status"),
        F.max(F.col("l_discount") * 1000 - 40).alias("ret_bps"),
        F.max(F.col("l_discount") * 1000 - 48).alias("ret_net_bps"),
    )


SIGNALS_CTE = """
sg AS (SELECT l_partkey % 3000 AS edge_version_id, l_orderkey AS signal_id, max(epoch_us(l_shipdate) // 1000) AS ts_signal,
  CASE WHEN min(l_returnflag) = 'N' THEN 'open' ELSE 'closed' END AS status, max(l_discount * 1000 - 40) AS ret_bps, max(l_discount * 1000 - 48) AS ret_net_bps
  FROM lineitem GROUP BY 1, 2)
"""


@query(
    "qry_02_recent_signals",
    f"""WITH {SIGNALS_CTE} SELECT edge_version_id, signal_id, ts_signal, status FROM sg QUALIFY row_number() OVER (PARTITION BY edge_version_id
        ORDER BY ts_signal DESC, signal_id DESC) <= 20""",
)
def qry_02_signals(spark, sf):
    return ledger.recent_signals(signals(spark, sf)).select("edge_version_id", "signal_id", "ts_signal", "status")


@query(
    "qry_03_trial_counts",
    f"WITH {LEDGER_CTE} SELECT edge_id, CAST(count(*) AS BIGINT) AS trial_count, CAST(count(*) + 1 AS BIGINT) AS n_trials FROM er WHERE run_kind IN ('screen', 'full') GROUP BY 1",
)
def qry_03(spark, sf):
    t = ledger.trial_counts(ledger.edge_runs(runs(spark, sf), versions(spark, sf)))
    return t.withColumn("n_trials", F.col("trial_count") + 1)


def rule_inputs(spark, sf):
    """Names the rule of a current version reads, derived from the version number."""
    v = versions(spark, sf).filter(F.col("is_current") == 1)
    k = F.col("edge_id")
    feats = F.array(
        F.element_at(
            F.array(*[F.lit(f) for f in ("ret_24h", "rv_24h", "funding_z_30d", "liq_notional_24h", "made_up")]), (k % 5 + 1).cast("int")
        )
    )
    evs = F.when(k % 7 == 0, F.array(F.lit("refund"))).when(k % 7 == 1, F.array(F.lit("purchase"))).otherwise(
        F.array().cast("array<string>")
    )
    return v.select("edge_id", "version_id", feats.alias("features"), evs.alias("event_types"), (k % 11 == 0).alias("uses_regime"))


READY_CTE = f"""{LEDGER_CTE},
dn AS (SELECT edge_version_id, bool_or(run_kind = 'screen') AS s, bool_or(run_kind = 'full') AS f FROM runs WHERE status = 'done' GROUP BY 1),
ri AS (SELECT edge_id, version_id, ['ret_24h','rv_24h','funding_z_30d','liq_notional_24h','made_up'][edge_id % 5 + 1] AS feat, edge_id % 7 = 0 AS miss_event,
  edge_id % 11 = 0 AS reg FROM versions WHERE is_current = 1),
rs AS (SELECT e.edge_id, e.title, e.status, CASE WHEN e.status IN ('VALIDATED','PAPER','ACTIVE','DECAYING') THEN 'VALIDATED_PLUS' WHEN coalesce(dn.f, false) THEN 'FULL_DONE'
  WHEN coalesce(dn.s, false) THEN 'SCREEN_DONE' WHEN ri.version_id IS NOT NULL AND (feat = 'liq_notional_24h' OR miss_event OR reg) THEN 'DATA_PENDING'
  WHEN ri.version_id IS NOT NULL AND feat = 'made_up' THEN 'FEATURE_PENDING' WHEN ri.version_id IS NOT NULL THEN 'READY'
  WHEN readiness_class IN ('C', 'D') THEN 'BUILD_PENDING' ELSE 'SIGNAL_SPEC_PENDING' END AS state
  FROM edges e LEFT JOIN ri USING (edge_id) LEFT JOIN dn ON dn.edge_version_id = ri.version_id)
"""


def readiness(spark, sf, of=None):
    from barline.operators.features import feature_definitions

    defs = feature_definitions(spark).withColumn("status", F.lit("active"))
    types = table(spark, sf, "events").select("event_type").distinct()
    have = ["funding_rates", "open_interest", "long_short_ratios"]
    return ledger.readiness(edges(spark, sf) if of is None else of, rule_inputs(spark, sf), runs(spark, sf), defs, types, have, False)


@query("qry_04_readiness", f"WITH {READY_CTE} SELECT edge_id, status, state FROM rs")
def qry_04(spark, sf):
    return readiness(spark, sf).select("edge_id", "status", "state")


@query(
    "qry_04_readiness_missing",
    f"""WITH {READY_CTE}, m AS (SELECT rs.edge_id, rs.state, CASE WHEN feat = 'liq_notional_24h' AND reg THEN '"liq_notional_24h","regimes_daily"'
          WHEN feat = 'liq_notional_24h' THEN '"liq_notional_24h"' WHEN reg THEN '"regimes_daily"' END AS d, miss_event,
          CASE WHEN readiness_class = 'D' THEN '"' || category || '"' ELSE '' END AS b FROM rs LEFT JOIN ri USING (edge_id) JOIN edges USING (edge_id))
        SELECT edge_id, state, CASE state WHEN 'DATA_PENDING' THEN '{{' || concat_ws(',', '"data":[' || d || ']', CASE WHEN miss_event THEN '"event":["refund"]' END) || '}}'
          WHEN 'FEATURE_PENDING' THEN '{{"feature":["made_up"]}}' WHEN 'BUILD_PENDING' THEN '{{"build":[' || b || ']}}'
          WHEN 'SIGNAL_SPEC_PENDING' THEN '{{"signalSpec":true}}' ELSE '{{}}' END AS missing FROM m""",
)
def qry_04_missing(spark, sf):
    """Readiness with what is missing, as a JSON document; a plan of class D is blocked by its category."""
    blocked = F.when(F.col("readiness_class") == "D", F.array("category")).alias("plan_blockers")
    return readiness(spark, sf, edges(spark, sf).select("*", blocked)).select("edge_id", "state", F.to_json("missing").alias("missing"))


@query(
    "agg_11_readiness_tally",
    f"""WITH {READY_CTE}, st AS (SELECT unnest(['VALIDATED_PLUS','FULL_DONE','SCREEN_DONE','READY','DATA_PENDING','FEATURE_PENDING','SIGNAL_SPEC_PENDING',
          'BUILD_PENDING','NEVER']) AS state) SELECT st.state, CAST(count(rs.state) AS BIGINT) AS n FROM st LEFT JOIN rs USING (state) GROUP BY 1""",
)
def agg_11(spark, sf):
    return ledger.state_tally(readiness(spark, sf), "state", [*ledger.READINESS_STATES, "NEVER"])


@query(
    "qry_05_action_queue",
    f"""WITH {READY_CTE}, {HEALTH_CTE}, cv AS (SELECT ve.edge_id, v.verdict FROM verdicts v JOIN runs r USING (run_id) JOIN versions ve ON ve.version_id = r.edge_version_id
          AND ve.is_current = 1 WHERE r.run_kind = 'full' QUALIFY row_number() OVER (PARTITION BY ve.edge_id ORDER BY decided_at DESC, run_id DESC) = 1)
        SELECT 'approval' AS kind, edge_id, title, NULL::BIGINT AS issue_id FROM rs JOIN cv USING (edge_id) WHERE state = 'FULL_DONE' AND verdict = 'ADOPT' AND status = 'TESTING'
        UNION ALL SELECT 'review', edge_id, title, NULL FROM rs LEFT JOIN cv USING (edge_id) WHERE state = 'FULL_DONE' AND NOT coalesce(verdict = 'ADOPT' AND status = 'TESTING', false)
        UNION ALL SELECT 'review', edge_id, title, NULL FROM rs WHERE state = 'SCREEN_DONE'
        UNION ALL SELECT 'dq', NULL, 'DQ-02', issue_id FROM iss WHERE status = 'open' AND severity = 'critical'""",
)
def qry_05(spark, sf):
    v = ledger.current_full_verdicts(versions(spark, sf), runs(spark, sf), verdicts(spark, sf))
    i = stream_issues(spark, sf).withColumn("rule_id", F.lit("DQ-02"))
    return ledger.action_queue(edges(spark, sf), readiness(spark, sf), v, i).select("kind", "edge_id", "title", "issue_id")


@query(
    "qry_06_latest_screen",
    f"""WITH {LEDGER_CTE}, n AS (SELECT edge_id, run_id FROM er WHERE run_kind = 'screen' AND status = 'done' QUALIFY row_number() OVER (PARTITION BY edge_id
          ORDER BY finished_at DESC, run_id DESC) = 1), m AS (SELECT run_id, max(value) FILTER (segment = 'overall' AND metric = 'ev_bps') AS ev,
          max(value) FILTER (segment = 'wf:oos' AND metric = 'p_perm') AS p FROM metrics GROUP BY 1)
        SELECT edge_id, run_id, {R("ev")} AS screen_ev_bps, {R("p")} AS screen_p_perm FROM n JOIN m USING (run_id) WHERE ev IS NOT NULL AND p IS NOT NULL""",
)
def qry_06(spark, sf):
    s = ledger.latest_screen(ledger.edge_runs(runs(spark, sf), versions(spark, sf)), metrics(spark, sf))
    return rounded(s, "screen_ev_bps", "screen_p_perm")


@query(
    "qry_07_latest_full_verdict",
    f"""WITH {LEDGER_CTE} SELECT edge_id, verdict AS full_verdict, decided_at FROM verdicts JOIN er USING (run_id) WHERE run_kind = 'full'
        QUALIFY row_number() OVER (PARTITION BY edge_id ORDER BY decided_at DESC, run_id DESC) = 1""",
)
def qry_07(spark, sf):
    return ledger.latest_full_verdict(ledger.edge_runs(runs(spark, sf), versions(spark, sf)), verdicts(spark, sf))


PAPER_CTE = f"""{LEDGER_CTE}, {SIGNALS_CTE},
pp AS (SELECT edge_version_id, min(ts_signal) AS t0, count(*) AS n, CASE WHEN stddev_samp(ret_net_bps) > 0 THEN avg(ret_net_bps) / stddev_samp(ret_net_bps) ELSE 0 END AS sr,
  avg(ret_bps - ret_net_bps) AS slip FROM sg WHERE status = 'closed' GROUP BY 1),
ci AS (SELECT r.edge_version_id, m.ci_lo, m.ci_hi FROM metrics m JOIN runs r USING (run_id) WHERE r.run_kind = 'full' AND m.segment = 'wf:oos' AND m.metric = 'sharpe_bootstrap'
  QUALIFY row_number() OVER (PARTITION BY r.edge_version_id ORDER BY coalesce(finished_at, -1) DESC, run_id DESC) = 1),
pf AS (SELECT v.edge_id, CAST(pp.n AS BIGINT) AS signal_count, pp.sr AS paper_sharpe, pp.slip AS avg_slippage_bps, v.cost_bps AS expected_cost_bps, ci.ci_lo, ci.ci_hi,
  ({NOW} - pp.t0) / 86400000.0 AS paper_days FROM versions v JOIN pp ON pp.edge_version_id = v.version_id JOIN ci ON ci.edge_version_id = v.version_id WHERE v.is_current = 1)
"""


@query(
    "qry_08_paper_performance",
    f"""WITH {PAPER_CTE} SELECT edge_id, signal_count, {R("paper_sharpe")} AS paper_sharpe, {R("avg_slippage_bps")} AS avg_slippage_bps,
        {R("expected_cost_bps")} AS expected_cost_bps, {R("ci_lo")} AS ci_lo, {R("ci_hi")} AS ci_hi, {R("paper_days")} AS paper_days FROM pf""",
)
def qry_08(spark, sf):
    p = ledger.paper_performance(versions(spark, sf), signals(spark, sf), runs(spark, sf), metrics(spark, sf), F.lit(NOW))
    nums = ["paper_sharpe", "avg_slippage_bps", "expected_cost_bps", "ci_lo", "ci_hi", "paper_days"]
    return rounded(p.select("edge_id", "signal_count", *nums), *nums)


GRAPH_SQL = ", ".join(f"'{a}>{b}'" for a, targets in ledger.TRANSITIONS.items() for b in targets)


@query(
    "qry_09_transition_audit",
    f"""WITH {PAPER_CTE}, sc AS (SELECT n.edge_id, m.ev, m.p FROM (SELECT edge_id, run_id FROM er WHERE run_kind = 'screen' AND status = 'done' QUALIFY row_number() OVER
          (PARTITION BY edge_id ORDER BY finished_at DESC, run_id DESC) = 1) n JOIN (SELECT run_id, max(value) FILTER (segment = 'overall' AND metric = 'ev_bps') AS ev,
          max(value) FILTER (segment = 'wf:oos' AND metric = 'p_perm') AS p FROM metrics GROUP BY 1) m USING (run_id) WHERE ev IS NOT NULL AND p IS NOT NULL),
        fv AS (SELECT edge_id, verdict FROM verdicts JOIN er USING (run_id) WHERE run_kind = 'full' QUALIFY row_number() OVER (PARTITION BY edge_id
          ORDER BY decided_at DESC, run_id DESC) = 1),
        pr AS (SELECT e.edge_id, e.status AS f, t AS t, e.edge_id % 2 = 0 AS u, sc.ev, sc.p, fv.verdict AS v, pf.* EXCLUDE (edge_id),
          e.edge_id IN (SELECT edge_id FROM versions) AS hv FROM edges e CROSS JOIN (SELECT unnest(['CANDIDATE','TESTING','VALIDATED','ACTIVE','DECAYING','REJECTED']) AS t)
          LEFT JOIN sc USING (edge_id) LEFT JOIN fv USING (edge_id) LEFT JOIN pf USING (edge_id)),
        au AS (SELECT edge_id, f, t, f || '>' || t AS mv, CASE WHEN f || '>' || t NOT IN ({GRAPH_SQL}) THEN [{{'code': 'not_in_graph', 'value': NULL::DOUBLE, 'lim': NULL::DOUBLE, 'bad': true}}]
          WHEN t = 'REJECTED' THEN [{{'code': 'no_ground', 'value': NULL, 'lim': NULL, 'bad': NOT (coalesce(v = 'REJECT', false) OR u)}}]
          ELSE CASE f || '>' || t WHEN 'IDEA>CANDIDATE' THEN [{{'code': 'version_missing', 'value': NULL, 'lim': NULL, 'bad': NOT hv}}]
            WHEN 'CANDIDATE>TESTING' THEN [{{'code': 'screen_ev_bps', 'value': ev, 'lim': 0, 'bad': NOT coalesce(ev > 0, false)}}, {{'code': 'screen_p_perm', 'value': p, 'lim': 0.2, 'bad': NOT coalesce(p < 0.2, false)}}]
            WHEN 'TESTING>VALIDATED' THEN [{{'code': 'full_run_not_adopt', 'value': NULL, 'lim': NULL, 'bad': NOT coalesce(v = 'ADOPT', false)}}]
            WHEN 'PAPER>ACTIVE' THEN [{{'code': 'paper_days', 'value': paper_days, 'lim': 30, 'bad': NOT coalesce(paper_days >= 30, false)}},
              {{'code': 'signal_count', 'value': signal_count, 'lim': 10, 'bad': NOT coalesce(signal_count >= 10, false)}},
              {{'code': 'paper_sharpe', 'value': paper_sharpe, 'lim': ci_lo, 'bad': NOT coalesce(paper_sharpe >= ci_lo, false)}},
              {{'code': 'avg_slippage_bps', 'value': avg_slippage_bps, 'lim': expected_cost_bps, 'bad': NOT coalesce(avg_slippage_bps <= expected_cost_bps, false)}}]
            WHEN 'ACTIVE>DECAYING' THEN [{{'code': 'alarm_missing', 'value': NULL, 'lim': NULL, 'bad': true}}]
            ELSE [{{'code': 'no_rule', 'value': NULL, 'lim': NULL, 'bad': f || '>' || t NOT IN ('TESTING>CANDIDATE', 'RETIRED>CANDIDATE', 'DECAYING>ACTIVE')}}] END END AS g FROM pr),
        vi AS (SELECT edge_id, f, t, list_filter(g, lambda x: x.bad) AS bad FROM au),
        one AS (SELECT edge_id, f AS from_status, t AS to_status, len(bad) = 0 AS ok,
          unnest(CASE WHEN len(bad) = 0 THEN [{{'code': NULL::VARCHAR, 'value': NULL::DOUBLE, 'lim': NULL::DOUBLE, 'bad': false}}] ELSE bad END) AS x FROM vi)
        SELECT edge_id, from_status, to_status, ok, x.code AS code, {R("x.value")} AS value, {R("x.lim")} AS "limit" FROM one""",
)
def qry_09(spark, sf):
    v, r, m = versions(spark, sf), runs(spark, sf), metrics(spark, sf)
    er = ledger.edge_runs(r, v)
    targets = F.array(*[F.lit(t) for t in ("CANDIDATE", "TESTING", "VALIDATED", "ACTIVE", "DECAYING", "REJECTED")])
    perf = ledger.paper_performance(v, signals(spark, sf), r, m, F.lit(NOW)).withColumnRenamed("ci_lo", "oos_ci_lo")
    has = v.select("edge_id").distinct().withColumn("has_version", F.lit(True))
    p = (
        edges(spark, sf)
        .select("edge_id", F.col("status").alias("from_status"), F.explode(targets).alias("to_status"))
        .join(ledger.latest_screen(er, m).drop("run_id"), "edge_id", "left")
        .join(ledger.latest_full_verdict(er, verdicts(spark, sf)).drop("decided_at"), "edge_id", "left")
        .join(perf, "edge_id", "left")
        .join(has, "edge_id", "left")
        .withColumns(
            {
                **{n: F.lit("text") for n in ("hypothesis", "rationale", "counter_evidence")},
                "user_initiated": F.col("edge_id") % 2 == 0,
                "cusum_alarm": F.lit(False),
            }
        )
    )
    audit = ledger.transition_audit(p).withColumn("v", F.explode_outer("violations"))
    columns = ["edge_id", "from_status", "to_status", "ok", "v.code", "v.value", "v.limit"]
    return rounded(audit.select(*columns), "value", "limit")


@query(
    "qry_10_reap_stuck_runs",
    f"""WITH {LEDGER_CTE} SELECT run_id, CASE WHEN status = 'running' AND started_at < 900000000000 - 21600000 THEN 'timeout' ELSE status END AS status,
        CASE WHEN status = 'running' AND started_at < 900000000000 - 21600000 THEN 900000000000 ELSE finished_at END AS finished_at FROM runs""",
)
def qry_10(spark, sf):
    return ledger.reap_stuck(runs(spark, sf), F.lit(900_000_000_000)).select("run_id", "status", "finished_at")


@query(
    "qry_11_briefing_counts",
    f"""WITH {LEDGER_CTE}, {HEALTH_CTE} SELECT 'issue' AS kind, severity AS label, CAST(count(*) AS BIGINT) AS n FROM iss WHERE status = 'open' AND detected_at >= {NOW - 5 * DAY_MS}
        GROUP BY 2 UNION ALL SELECT 'verdict', verdict, CAST(count(*) AS BIGINT) FROM verdicts JOIN er USING (run_id) WHERE decided_at >= 950000000000 GROUP BY 2""",
)
def qry_11(spark, sf):
    since = stream_issues(spark, sf).filter((F.col("status") == "open") & (F.col("detected_at") >= NOW - 5 * DAY_MS))
    i = since.groupBy(F.col("severity").alias("label")).agg(F.count(F.lit(1)).alias("n"))
    feed = ledger.verdict_feed(edges(spark, sf), versions(spark, sf), runs(spark, sf), verdicts(spark, sf), 950_000_000_000)
    v = feed.groupBy(F.col("verdict").alias("label")).agg(F.count(F.lit(1)).alias("n"))
    return i.withColumn("kind", F.lit("issue")).unionByName(v.withColumn("kind", F.lit("verdict")))


# ----------------------------------------------------------- checks over time series


@query(
    "ext_12_gaps",
    f"""WITH {HOURLY_CTE}, g AS (SELECT instrument_id, lag(ts) OVER (PARTITION BY instrument_id ORDER BY ts) AS gap_start, ts AS gap_end FROM hourly)
        SELECT instrument_id, gap_start, gap_end, (gap_end - gap_start) // 3600000 - 1 AS missing FROM g WHERE gap_end - gap_start > 3600000""",
)
def ext_12_gaps(spark, sf):
    return quality.gaps(hourly_ix(spark, sf), KEY, HOUR_MS)


@query(
    "ext_12_spikes",
    f"""WITH {HOURLY_CTE}, z AS (SELECT instrument_id, ts, CASE WHEN count(close) OVER w = 72 THEN (close - avg(close) OVER w) / stddev_pop(close) OVER w END AS z FROM hx
          WINDOW w AS (PARTITION BY instrument_id ORDER BY pos ROWS BETWEEN 72 PRECEDING AND 1 PRECEDING)) SELECT instrument_id, ts, {R("z")} AS z FROM z WHERE abs(z) > 3""",
)
def ext_12_spikes(spark, sf):
    s = quality.spikes(hourly_ix(spark, sf), KEY, "close", 72, 3.0)
    return s.select("instrument_id", "ts", rnd("z").alias("z"))


@query("ext_12_unit_range", "SELECT l_orderkey, l_partkey, l_discount FROM lineitem WHERE l_discount < 0.02 OR l_discount > 0.09")
def ext_12_range(spark, sf):
    return quality.out_of_range(table(spark, sf, "lineitem"), "l_discount", 0.02, 0.09).select("l_orderkey", "l_partkey", "l_discount")


@query(
    "ext_12_cross_source",
    f"""WITH {DAILY_CTE} SELECT instrument_id, ts, {R("abs((high - close) / close)")} AS rel_diff FROM daily WHERE abs((high - close) / close) > 0.05""",
)
def ext_12_cross(spark, sf):
    d = daily_ix(spark, sf)
    a = d.select("instrument_id", "ts", F.col("close").alias("v"))
    b = d.select("instrument_id", "ts", F.col("high").alias("v"))
    return quality.cross_source(a, b, ["instrument_id", "ts"], "v").select("instrument_id", "ts", rnd("rel_diff").alias("rel_diff"))


REVISIONS_CTE = """
rv AS (SELECT l_suppkey AS metric_id, epoch_us(o_orderdate) // 1000 AS ts, epoch_us(l_shipdate) // 1000 AS ingested_at, max(l_extendedprice) AS value
  FROM lineitem JOIN orders ON o_orderkey = l_orderkey GROUP BY 1, 2, 3)
"""


def revisions(spark, sf):
    """Bitemporal rows: metric = supplier, event time = order date, ingested = ship date."""
    li, o = table(spark, sf, "lineitem"), table(spark, sf, "orders")
    j = li.join(o, li.l_orderkey == o.o_orderkey)
    return j.groupBy(
        F.col("l_suppkey").alias("metric_id"), ms("o_orderdate").alias("ts"), ms("l_shipdate").alias("ingested_at")
    ).agg(F.max("l_extendedprice").alias("value"))


@query("ext_12_time_travel", f"WITH {REVISIONS_CTE} SELECT metric_id, ts, ingested_at FROM rv WHERE ts > ingested_at")
def ext_12_pit(spark, sf):
    return quality.time_travel(revisions(spark, sf)).select("metric_id", "ts", "ingested_at")


@query(
    "ext_12_large_revisions",
    f"""WITH {REVISIONS_CTE}, p AS (SELECT *, lag(value) OVER (PARTITION BY metric_id, ts ORDER BY ingested_at) AS pv FROM rv)
        SELECT metric_id, ts, ingested_at, {R("abs((value - pv) / pv)")} AS rel_change FROM p WHERE abs((value - pv) / pv) > 0.1""",
)
def ext_12_revisions(spark, sf):
    key = ["metric_id", "ts"]
    ix = index_rows(revisions(spark, sf), key, "ingested_at", time_bucket("ingested_at", 3650 * DAY_MS))
    out = quality.large_revisions(ix, key, "value")
    return out.select("metric_id", "ts", "ingested_at", rnd("rel_change").alias("rel_change"))

