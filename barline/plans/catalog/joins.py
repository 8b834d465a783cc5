"""Catalogue: joins, top-k, upserts and set operations."""

from __future__ import annotations

from pyspark.sql import functions as F

from barline.functions.scalar import ms, source_id
from barline.operators import asof, ledger, upserts
from barline.operators.series import DAY_MS, HOUR_MS, index_rows, time_bucket
from barline.plans.catalog.base import (
    DAILY_CTE,
    EV_CTE,
    HOURLY_CTE,
    R,
    daily,
    events_ms,
    hourly,
    hourly_ix,
    query,
    rnd,
    rounded,
    table,
)
from barline.plans.catalog.scalars import STREAM_ID_SQL, stream_id

KEY = ["instrument_id"]


@query(
    "jn_01_asof_events",
    f"""WITH {EV_CTE}, l AS (SELECT * FROM ev WHERE instrument_id = 'purchase'), r AS (SELECT user_id, ts, event_id AS view_id,
          CASE WHEN value >= 10 THEN value END AS view_value FROM ev WHERE instrument_id = 'view')
        SELECT l.event_id, l.user_id, l.ts, r.view_id, r.view_value FROM l ASOF LEFT JOIN r
        ON l.user_id = r.user_id AND l.ts >= r.ts""",
)
def jn_01(spark, sf):
    # a present right row with a NULL value wins over an older value
    e = events_ms(spark, sf)
    left = e.filter(F.col("instrument_id") == "purchase").select("user_id", "ts", "event_id")
    right = e.filter(F.col("instrument_id") == "view").select(
        "user_id",
        "ts",
        F.col("event_id").alias("view_id"),
        F.when(F.col("value") >= 10, F.col("value")).alias("view_value"),
    )
    return asof.asof_join(left, right, ["user_id"], ["view_id", "view_value"], tiebreak="view_id")


def daily_labels(spark, sf):
    """A label for every weekday with events."""
    days = events_ms(spark, sf).groupBy(F.date_format(F.timestamp_millis("ts"), "yyyy-MM-dd").alias("dt")).agg(
        F.sum("value").alias("v"), F.count(F.lit(1)).alias("n")
    )
    kept = days.filter(F.dayofweek(F.to_date("dt")).between(2, 6))
    return kept.select(
        "dt",
        F.when(F.col("n") % 3 == 0, "up").when(F.col("n") % 3 == 1, "down").otherwise("range").alias("trend"),
        F.when(F.col("n") % 2 == 0, "low").otherwise("high").alias("vol"),
        F.lit("normal").alias("liquidity"),
    )


LABELS_CTE = """
dl AS (SELECT dt, CASE n % 3 WHEN 0 THEN 'up' WHEN 1 THEN 'down' ELSE 'range' END AS trend,
  CASE n % 2 WHEN 0 THEN 'low' ELSE 'high' END AS vol, 'normal' AS liquidity FROM
  (SELECT strftime(make_timestamp(ts * 1000), '%Y-%m-%d') AS dt, count(*) AS n FROM ev GROUP BY 1)
  WHERE dayofweek(CAST(dt AS DATE)) BETWEEN 1 AND 5)
"""


@query(
    "jn_02_fill_daily_labels",
    f"""WITH {HOURLY_CTE}, {LABELS_CTE} SELECT instrument_id, ts, dl.trend, dl.vol, dl.liquidity FROM
        (SELECT *, strftime(make_timestamp(ts * 1000), '%Y-%m-%d') AS d FROM hourly) b ASOF LEFT JOIN dl ON b.d >= dl.dt""",
)
def jn_02(spark, sf):
    b = asof.fill_daily(hourly(spark, sf), daily_labels(spark, sf), [], ["trend", "vol", "liquidity"])
    return b.select("instrument_id", "ts", "trend", "vol", "liquidity")


EVENT_COLS = """
es AS (SELECT phase, (ts - phase) // 3600000 AS slot, max(value) FILTER (instrument_id = 'purchase') AS ev_purchase,
  max(value) FILTER (instrument_id = 'error') AS ev_error FROM ev, (VALUES (0), (1800000)) AS v(phase) GROUP BY 1, 2)
"""


@query(
    "jn_03_events_per_bar",
    f"""WITH {HOURLY_CTE}, {EVENT_COLS}, st AS (SELECT * REPLACE (ts + CASE WHEN length(instrument_id) % 2 = 0 THEN 1800000 ELSE 0 END AS ts) FROM hx),
        sp AS (SELECT *, first_value(ts) OVER (PARTITION BY instrument_id ORDER BY pos) % 3600000 AS phase,
          first_value(ts) OVER (PARTITION BY instrument_id ORDER BY pos) // 3600000 + pos AS slot FROM st)
        SELECT instrument_id, ts, pos, ev_purchase, ev_error FROM sp LEFT JOIN es USING (phase, slot)""",
)
def jn_03(spark, sf):
    e = events_ms(spark, sf)
    # every other series starts at half past
    late = F.when(F.length("instrument_id") % 2 == 0, HOUR_MS // 2).otherwise(0)
    b = hourly_ix(spark, sf).withColumn("ts", F.col("ts") + late)
    placed = asof.place_events(b, KEY, e, HOUR_MS, ["purchase", "error"], event_type="instrument_id", magnitude="value")
    return placed.select("instrument_id", "ts", "pos", "ev_purchase", "ev_error")


@query(
    "jn_04_left_fill_zero",
    f"""WITH {HOURLY_CTE}, q AS (SELECT instrument_id, ts // 3600000 * 3600000 AS ts, sum(value) AS v FROM ev WHERE value > 100
          GROUP BY 1, 2) SELECT instrument_id, ts, {R("coalesce(q.v, 0)")} AS liq_notional_1h, CAST(NULL AS DOUBLE) AS absent
        FROM hourly LEFT JOIN q USING (instrument_id, ts)""",
)
def jn_04(spark, sf):
    q = (
        events_ms(spark, sf)
        .filter(F.col("value") > 100)
        .groupBy("instrument_id", (F.floor(F.col("ts") / HOUR_MS) * HOUR_MS).cast("bigint").alias("ts"))
        .agg(F.sum("value").alias("liq_notional_1h"))
    )
    b = asof.left_fill_zero(hourly(spark, sf), q, ["instrument_id", "ts"], "liq_notional_1h")
    b = asof.left_fill_zero(b, None, ["instrument_id", "ts"], "absent")
    return b.select("instrument_id", "ts", rnd("liq_notional_1h").alias("liq_notional_1h"), "absent")


@query(
    "jn_05_features_onto_bars",
    f"""WITH {HOURLY_CTE}, f AS (SELECT instrument_id, ts, close - lag(close) OVER (PARTITION BY instrument_id ORDER BY pos) AS chg_1
          FROM hx WHERE true QUALIFY close > 40)
        SELECT instrument_id, ts, close, {R("chg_1")} AS chg_1 FROM hourly LEFT JOIN f USING (instrument_id, ts)""",
)
def jn_05(spark, sf):
    from barline.operators.series import add_windowed

    ix = hourly_ix(spark, sf)
    f = add_windowed(ix, KEY, lambda fr: {"chg_1": F.col("close") - fr.lag("close", 1)}, before=1)
    half = f.filter(F.col("close") > 40).select("instrument_id", "ts", "chg_1")
    return hourly(spark, sf).join(half, ["instrument_id", "ts"], "left").select(
        "instrument_id", "ts", "close", rnd("chg_1").alias("chg_1")
    )


# --------------------------------------------------------- ledger stand-ins and joins


def edges(spark, sf):
    return table(spark, sf, "customer").select(
        F.col("c_custkey").alias("edge_id"),
        F.col("c_name").alias("title"),
        F.col("c_mktsegment").alias("category"),
        F.element_at(F.array(*[F.lit(s) for s in ledger.TRANSITIONS]), (F.col("c_custkey") % 9 + 1).cast("int")).alias("status"),
        F.element_at(F.array(*[F.lit(s) for s in "ABCD"]), (F.col("c_nationkey") % 4 + 1).cast("int")).alias("readiness_class"),
        (F.col("c_custkey") * 1000).alias("updated_at"),
    )


def versions(spark, sf):
    """Two versions per customer outside the furniture segment; the second is current."""
    c = table(spark, sf, "customer").filter(F.col("c_mktsegment") != "FURNITURE")
    two = c.select("c_custkey", "c_acctbal", F.explode(F.array(F.lit(0), F.lit(1))).alias("k"))
    return two.select(
        (F.col("c_custkey") * 2 + F.col("k")).alias("version_id"),
        F.col("c_custkey").alias("edge_id"),
        F.col("k").cast("bigint").alias("is_current"),
        F.to_json(
            F.struct((F.col("c_custkey") % 7).cast("double").alias("taker_bps"), F.lit(1.5).alias("slippage_bps"))
        ).alias("cost_model"),
    )


def runs(spark, sf):
    o = table(spark, sf, "orders").withColumn("_t", ms("o_orderdate"))
    kind = F.when(F.col("o_orderpriority") == "1-URGENT", "screen").when(F.col("o_orderpriority") == "2-HIGH", "full")
    status = F.when(F.col("o_orderstatus") == "F", "done").when(F.col("o_orderstatus") == "O", "running").otherwise("failed")
    return o.select(
        F.col("o_orderkey").alias("run_id"),
        (F.col("o_custkey") * 2 + F.col("o_orderkey") % 2).alias("edge_version_id"),
        kind.otherwise("incremental").alias("run_kind"),
        status.alias("status"),
        F.col("_t").alias("started_at"),
        F.when(F.col("o_orderstatus") == "F", F.col("_t") + 60_000).alias("finished_at"),
    )


def metrics(spark, sf):
    """One value per (run, segment, metric) from the line items of an order."""
    li = table(spark, sf, "lineitem")
    seg = F.when(F.col("l_returnflag") == "A", "overall").otherwise("wf:oos")
    metric = F.element_at(
        F.array(*[F.lit(m) for m in ("ev_bps", "sharpe", "dsr", "p_perm", "sharpe_bootstrap")]),
        (F.col("l_suppkey") % 5 + 1).cast("int"),
    )
    return li.groupBy(F.col("l_orderkey").alias("run_id"), seg.alias("segment"), metric.alias("metric")).agg(
        F.max(F.col("l_discount") * 2 - 0.08).alias("value"),
        F.min(F.col("l_tax") - 0.05).alias("ci_lo"),
        F.max("l_tax").alias("ci_hi"),
    )


def verdicts(spark, sf):
    """A verdict for each finished run."""
    o = table(spark, sf, "orders").filter(F.col("o_orderstatus") == "F")
    v = F.when(F.col("o_totalprice") > 350_000, "ADOPT").when(F.col("o_totalprice") > 150_000, "WATCH").otherwise("REJECT")
    return o.select(
        F.col("o_orderkey").alias("run_id"),
        v.alias("verdict"),
        (F.col("o_totalprice") / 5000).alias("score"),
        (ms("o_orderdate") + 120_000).alias("decided_at"),
    )


STATES_SQL = "['IDEA','CANDIDATE','TESTING','VALIDATED','PAPER','ACTIVE','DECAYING','RETIRED','REJECTED']"
LEDGER_CTE = f"""
edges AS (SELECT c_custkey AS edge_id, c_name AS title, c_mktsegment AS category, {STATES_SQL}[c_custkey % 9 + 1] AS status,
  ['A','B','C','D'][c_nationkey % 4 + 1] AS readiness_class, c_custkey * 1000 AS updated_at FROM customer),
versions AS (SELECT c_custkey * 2 + k AS version_id, c_custkey AS edge_id, CAST(k AS BIGINT) AS is_current,
  ((c_custkey % 7) + 1.5) * 2 AS cost_bps FROM customer, (SELECT unnest([0, 1]) AS k) WHERE c_mktsegment <> 'FURNITURE'),
runs AS (SELECT o_orderkey AS run_id, o_custkey * 2 + o_orderkey % 2 AS edge_version_id,
  CASE o_orderpriority WHEN '1-URGENT' THEN 'screen' WHEN '2-HIGH' THEN 'full' ELSE 'incremental' END AS run_kind,
  CASE o_orderstatus WHEN 'F' THEN 'done' WHEN 'O' THEN 'running' ELSE 'failed' END AS status,
  epoch_us(o_orderdate) // 1000 AS started_at,
  CASE WHEN o_orderstatus = 'F' THEN epoch_us(o_orderdate) // 1000 + 60000 END AS finished_at FROM orders),
metrics AS (SELECT l_orderkey AS run_id, CASE WHEN l_returnflag = 'A' THEN 'overall' ELSE 'wf:oos' END AS segment,
  ['ev_bps','sharpe','dsr','p_perm','sharpe_bootstrap'][l_suppkey % 5 + 1] AS metric, max(l_discount * 2 - 0.08) AS value,
  min(l_tax - 0.05) AS ci_lo, max(l_tax) AS ci_hi FROM lineitem GROUP BY 1, 2, 3),
verdicts AS (SELECT o_orderkey AS run_id, CASE WHEN o_totalprice > 350000 THEN 'ADOPT' WHEN o_totalprice > 150000 THEN 'WATCH'
  ELSE 'REJECT' END AS verdict, o_totalprice / 5000 AS score, epoch_us(o_orderdate) // 1000 + 120000 AS decided_at
  FROM orders WHERE o_orderstatus = 'F'),
er AS (SELECT r.*, v.edge_id FROM runs r JOIN versions v ON v.version_id = r.edge_version_id)
"""


@query(
    "jn_06_verdict_feed",
    f"""WITH {LEDGER_CTE} SELECT v.run_id, v.verdict, v.decided_at, er.run_kind, e.title AS edge_title FROM verdicts v
        JOIN er USING (run_id) JOIN edges e USING (edge_id) WHERE v.decided_at >= 850000000000""",
)
def jn_06(spark, sf):
    return ledger.verdict_feed(
        edges(spark, sf), versions(spark, sf), runs(spark, sf), verdicts(spark, sf), 850_000_000_000
    )


@query(
    "jn_07_signal_with_version",
    f"""WITH {LEDGER_CTE} SELECT r.run_id, v.version_id, v.edge_id, {R("v.cost_bps")} AS cost_bps FROM runs r
        JOIN versions v ON v.version_id = r.edge_version_id WHERE r.status = 'running'""",
)
def jn_07(spark, sf):
    from barline.functions.scalar import round_trip_bps

    v = versions(spark, sf).select("version_id", "edge_id", rnd(round_trip_bps("cost_model")).alias("cost_bps"))
    r = runs(spark, sf).filter(F.col("status") == "running")
    return r.join(v, r.edge_version_id == v.version_id).select("run_id", "version_id", "edge_id", "cost_bps")


@query(
    "jn_08_semi_and_anti",
    f"""WITH {LEDGER_CTE} SELECT edge_id, 'no_version' AS kind FROM edges WHERE edge_id NOT IN (SELECT edge_id FROM versions)
        UNION ALL SELECT DISTINCT edge_id, 'has_full_run' FROM er WHERE run_kind = 'full' AND status = 'done'""",
)
def jn_08(spark, sf):
    e, v = edges(spark, sf), versions(spark, sf)
    none = e.join(v, "edge_id", "left_anti").select("edge_id", F.lit("no_version").alias("kind"))
    full = ledger.edge_runs(runs(spark, sf), v).filter((F.col("run_kind") == "full") & (F.col("status") == "done"))
    some = e.join(full, "edge_id", "left_semi").select("edge_id", F.lit("has_full_run").alias("kind"))
    return none.unionByName(some)


@query(
    "jn_09_stream_source",
    f"""WITH s AS (SELECT DISTINCT {STREAM_ID_SQL} || user_id AS stream_id FROM events), src AS (SELECT unnest(['okx_rest',
          'deribit_rest', 'other']) AS source_id, unnest(['active', 'disabled', 'active']) AS status)
        SELECT stream_id, split_part(stream_id, ':', 1) AS source_id, src.status FROM s LEFT JOIN src
        ON src.source_id = split_part(stream_id, ':', 1)""",
)
def jn_09(spark, sf):
    s = table(spark, sf, "events").select(F.concat(stream_id(), "user_id").alias("stream_id")).distinct()
    src = sources(spark, sf).select("source_id", "status")
    return s.withColumn("source_id", source_id("stream_id")).join(src, "source_id", "left")


def sources(spark, sf):
    """Sources that appear in the events, with a fixed status."""
    s = table(spark, sf, "events").select(source_id(stream_id()).alias("source_id")).distinct()
    status = F.when(F.col("source_id") == "deribit_rest", "disabled").otherwise("active")
    return s.filter(F.col("source_id") != "alternative_me").select("source_id", status.alias("status"))


@query(
    "jn_10_latest_per_edge",
    f"""WITH {LEDGER_CTE}, lv AS (SELECT edge_id, verdict, score FROM verdicts JOIN er USING (run_id)
          QUALIFY row_number() OVER (PARTITION BY edge_id ORDER BY decided_at DESC, run_id DESC) = 1)
        SELECT e.edge_id, lv.verdict AS latest_verdict, lv.score AS latest_score, (SELECT CAST(count(*) AS BIGINT) FROM er
          WHERE er.edge_id = e.edge_id AND run_kind IN ('screen', 'full')) AS trial_count
        FROM edges e LEFT JOIN lv USING (edge_id)""",
)
def jn_10(spark, sf):
    out = ledger.edge_list(edges(spark, sf), versions(spark, sf), runs(spark, sf), verdicts(spark, sf))
    return out.select("edge_id", "latest_verdict", "latest_score", "trial_count")


@query(
    "jn_11_rows_at_max",
    f"""WITH {LEDGER_CTE}, f AS (SELECT v.*, er.edge_id FROM verdicts v JOIN er USING (run_id) JOIN versions ve
          ON ve.version_id = er.edge_version_id AND ve.is_current = 1 WHERE er.run_kind = 'full')
        SELECT edge_id, run_id, verdict, decided_at FROM f QUALIFY rank() OVER (PARTITION BY edge_id ORDER BY decided_at DESC) = 1""",
)
def jn_11(spark, sf):
    out = ledger.current_full_verdicts(versions(spark, sf), runs(spark, sf), verdicts(spark, sf))
    return out.select("edge_id", "run_id", "verdict", "decided_at")


# --------------------------------------------------------------------------- top-k


@query(
    "top_01_newest_rows",
    """SELECT o_orderkey, epoch_us(o_orderdate) // 1000 AS ts FROM orders ORDER BY o_orderdate DESC, o_orderkey LIMIT 50""",
)
def top_01(spark, sf):
    o = table(spark, sf, "orders").select("o_orderkey", ms("o_orderdate").alias("ts"))
    return o.orderBy(F.col("ts").desc(), "o_orderkey").limit(50)


@query(
    "top_02_latest_per_key",
    f"""WITH {HOURLY_CTE} SELECT instrument_id, ts, open, close FROM hourly
        QUALIFY row_number() OVER (PARTITION BY instrument_id ORDER BY ts DESC) = 1""",
)
def top_02(spark, sf):
    from barline.operators.series import latest

    return latest(hourly(spark, sf), KEY, F.col("ts"), ["ts", "open", "close"])


@query(
    "top_03_recent_runs",
    f"""WITH {LEDGER_CTE} SELECT edge_version_id, run_id, status FROM runs QUALIFY row_number() OVER (PARTITION BY edge_version_id
        ORDER BY coalesce(finished_at, started_at, 0) DESC, run_id DESC) <= 5""",
)
def top_03(spark, sf):
    return ledger.recent_runs(runs(spark, sf)).select("edge_version_id", "run_id", "status")


@query(
    "top_05_keyset_page",
    """SELECT o_orderkey, o_custkey, o_totalprice FROM orders WHERE o_orderkey > 4000 ORDER BY o_orderkey LIMIT 2000""",
)
def top_05(spark, sf):
    o = table(spark, sf, "orders").select("o_orderkey", "o_custkey", "o_totalprice")
    return upserts.keyset_page(o, "o_orderkey", 4000, 2000)


# ------------------------------------------------------------------ set operations


def split_days(spark, sf):
    """Daily bars: stored = up to 2000-01-01, incoming = from 1999-01-01 with corrected closes."""
    d = daily(spark, sf).select("instrument_id", "ts", "close")
    stored = d.filter(F.col("ts") < 946_684_800_000)
    incoming = d.filter(F.col("ts") >= 915_148_800_000).withColumn("close", F.col("close") + 1)
    return stored, incoming


SPLIT_CTE = DAILY_CTE + """,
stored AS (SELECT instrument_id, ts, close FROM daily WHERE ts < 946684800000),
incoming AS (SELECT instrument_id, ts, close + 1 AS close FROM daily WHERE ts >= 915148800000),
merged AS (SELECT * FROM incoming UNION ALL SELECT * FROM stored s WHERE NOT EXISTS (SELECT 1 FROM incoming i
  WHERE i.instrument_id = s.instrument_id AND i.ts = s.ts))
"""


@query("set_01_merge_keep_last", f"""WITH {SPLIT_CTE} SELECT instrument_id, ts, {R("close")} AS close FROM merged""")
def set_01(spark, sf):
    stored, incoming = split_days(spark, sf)
    return rounded(upserts.merge_keep_last(stored, incoming, ["instrument_id", "ts"]), "close")


def keyed_events(spark, sf):
    e = events_ms(spark, sf)
    day = F.date_format(F.timestamp_millis("ts"), "yyyy-MM-dd")
    return e.select(
        F.concat_ws(":", "instrument_id", F.col("user_id").cast("string"), day).alias("dedupe_key"),
        "event_id",
        "ts",
        F.col("value").alias("magnitude"),
    )


# stored = before the middle of the month, incoming = from half a day earlier on
MID = 1_705_319_998_000
KEYED_CTE = """
ke AS (SELECT event_type || ':' || user_id || ':' || strftime(ts, '%Y-%m-%d') AS dedupe_key, event_id,
  epoch_us(ts) // 1000 AS ts, value AS magnitude FROM events)
"""


@query(
    "set_02_insert_new",
    f"""WITH {KEYED_CTE} SELECT * FROM (SELECT * FROM ke WHERE ts >= {MID - 43200000}) n WHERE NOT EXISTS (SELECT 1 FROM ke o
        WHERE o.ts < {MID} AND o.dedupe_key = n.dedupe_key)
        QUALIFY row_number() OVER (PARTITION BY dedupe_key ORDER BY ts, event_id) = 1""",
)
def set_02(spark, sf):
    k = keyed_events(spark, sf)
    return upserts.insert_new(
        k.filter(F.col("ts") < MID), k.filter(F.col("ts") >= MID - 43_200_000), "dedupe_key", ["ts", "event_id"]
    )


@query(
    "set_02_insert_counts",
    f"""WITH {KEYED_CTE}, w AS (SELECT CAST(count(DISTINCT dedupe_key) AS BIGINT) AS written FROM ke n WHERE ts >= {MID - 43200000} AND NOT EXISTS
          (SELECT 1 FROM ke o WHERE o.ts < {MID} AND o.dedupe_key = n.dedupe_key))
        SELECT written, (SELECT CAST(count(*) AS BIGINT) FROM ke WHERE ts >= {MID - 43200000}) - written AS skipped FROM w""",
)
def set_02_counts(spark, sf):
    k = keyed_events(spark, sf)
    return upserts.insert_counts(
        k.filter(F.col("ts") < MID), k.filter(F.col("ts") >= MID - 43_200_000), "dedupe_key"
    )


@query(
    "set_03_replace_upsert",
    """WITH m AS (SELECT l_orderkey AS run_id, l_returnflag AS segment, l_linestatus AS metric, l_extendedprice AS value,
         l_partkey, l_suppkey, l_linenumber, l_quantity FROM lineitem)
       SELECT run_id, segment, metric, value FROM m QUALIFY row_number() OVER (PARTITION BY run_id, segment, metric
         ORDER BY l_linenumber DESC, l_partkey DESC, value DESC) = 1""",
)
def set_03(spark, sf):
    m = table(spark, sf, "lineitem").select(
        F.col("l_orderkey").alias("run_id"),
        F.col("l_returnflag").alias("segment"),
        F.col("l_linestatus").alias("metric"),
        F.col("l_extendedprice").alias("value"),
        "l_partkey",
        "l_linenumber",
    )
    # nothing stored yet: the last row of the batch wins per key
    out = upserts.merge_keep_last(
        m.filter(F.lit(False)), m, ["run_id", "segment", "metric"], ["l_linenumber", "l_partkey", "value"]
    )
    return out.select("run_id", "segment", "metric", "value")


@query(
    "set_04_partial_upsert",
    """WITH a AS (SELECT c_custkey AS k, c_acctbal AS oi_base, c_acctbal * 2 AS oi_usd, 1::BIGINT AS ingested_at FROM customer
         WHERE c_acctbal > 3000), b AS (SELECT c_custkey AS k, c_acctbal + 5 AS oi_base, 2::BIGINT AS ingested_at FROM customer
         WHERE c_acctbal < 6000)
       SELECT coalesce(a.k, b.k) AS k, CASE WHEN b.k IS NOT NULL THEN b.oi_base ELSE a.oi_base END AS oi_base, a.oi_usd,
         CASE WHEN a.k IS NOT NULL THEN a.ingested_at ELSE b.ingested_at END AS ingested_at FROM a FULL JOIN b ON a.k = b.k""",
)
def set_04(spark, sf):
    c = table(spark, sf, "customer")
    a = c.filter(F.col("c_acctbal") > 3000).select(
        F.col("c_custkey").alias("k"),
        F.col("c_acctbal").alias("oi_base"),
        (F.col("c_acctbal") * 2).alias("oi_usd"),
        F.lit(1).cast("bigint").alias("ingested_at"),
    )
    b = c.filter(F.col("c_acctbal") < 6000).select(
        F.col("c_custkey").alias("k"), (F.col("c_acctbal") + 5).alias("oi_base"), F.lit(2).cast("bigint").alias("ingested_at")
    )
    return upserts.upsert_columns(a, b, ["k"], ["oi_base"])


@query(
    "set_05_drop_unchanged",
    f"""WITH {EV_CTE}, s AS (SELECT instrument_id, event_id, CAST(floor(value / 40) AS BIGINT) AS v, lag(CAST(floor(value / 40) AS BIGINT))
          OVER (PARTITION BY instrument_id ORDER BY ts, event_id) AS p FROM ev)
        SELECT instrument_id, event_id, v FROM s WHERE p IS NULL OR p <> v""",
)
def set_05(spark, sf):
    e = events_ms(spark, sf).select(
        "instrument_id", "event_id", "ts", F.floor(F.col("value") / 40).cast("bigint").alias("v")
    )
    ix = index_rows(e, KEY, ["ts", "event_id"], time_bucket("ts", DAY_MS))
    return upserts.drop_unchanged(ix, KEY, "v").select("instrument_id", "event_id", "v")


@query(
    "set_06_latest_board",
    f"""WITH {EV_CTE} SELECT instrument_id || ':' || user_id AS key, ts AS updated_at, value FROM ev
        QUALIFY row_number() OVER (PARTITION BY instrument_id, user_id ORDER BY ts DESC, event_id DESC) = 1""",
)
def set_06(spark, sf):
    e = events_ms(spark, sf).select(
        F.concat_ws(":", "instrument_id", F.col("user_id").cast("string")).alias("key"),
        F.col("ts").alias("updated_at"),
        "event_id",
        "value",
    )
    return upserts.latest_board(e, "key", "updated_at", ["value"], tiebreak="event_id")


@query(
    "set_07_current_version",
    """SELECT o_orderkey AS version_id, o_custkey AS edge_id, CAST(CASE WHEN row_number() OVER (PARTITION BY o_custkey
       ORDER BY o_orderdate DESC, o_orderkey DESC) = 1 THEN 1 ELSE 0 END AS BIGINT) AS is_current FROM orders""",
)
def set_07(spark, sf):
    v = table(spark, sf, "orders").select(
        F.col("o_orderkey").alias("version_id"), F.col("o_custkey").alias("edge_id"), ms("o_orderdate").alias("created_at")
    )
    return upserts.flag_current(v, "edge_id", ["created_at", "version_id"]).select("version_id", "edge_id", "is_current")


@query(
    "set_08_canonical_pairs",
    """SELECT least(l_partkey, l_suppkey) AS edge_a, greatest(l_partkey, l_suppkey) AS edge_b, max(l_discount) AS overlap
       FROM lineitem WHERE l_partkey <> l_suppkey GROUP BY 1, 2""",
)
def set_08(spark, sf):
    a, b = upserts.canonical_pair("l_partkey", "l_suppkey")
    li = table(spark, sf, "lineitem").filter(F.col("l_partkey") != F.col("l_suppkey"))
    return li.groupBy(a.alias("edge_a"), b.alias("edge_b")).agg(F.max("l_discount").alias("overlap"))


@query(
    "set_09_name_union_and_difference",
    """SELECT p_partkey, array_to_string(list_sort(list_distinct([p_type, p_brand, 'close'])), ',') AS referenced,
       array_to_string(list_sort(list_filter(list_distinct([p_type, p_brand, 'close']), lambda v: v NOT IN ('close', 'SMALL', 'Brand#1'))), ',')
       AS missing FROM part""",
)
def set_09(spark, sf):
    p = table(spark, sf, "part")
    refs = F.array_union(F.array("p_type"), F.array_union(F.array("p_brand"), F.array(F.lit("close"))))
    known = F.array(F.lit("close"), F.lit("SMALL"), F.lit("Brand#1"))
    return p.select(
        "p_partkey",
        F.array_join(F.array_sort(refs), ",").alias("referenced"),
        F.array_join(F.array_sort(F.array_except(refs, known)), ",").alias("missing"),
    )


@query(
    "agg_12_additive_counters",
    f"""WITH {EV_CTE} SELECT strftime(make_timestamp(ts * 1000), '%Y-%m-%d') AS dt, instrument_id AS resource,
        CAST(count(*) AS BIGINT) AS value FROM ev GROUP BY 1, 2""",
)
def agg_12(spark, sf):
    e = events_ms(spark, sf).select(
        F.date_format(F.timestamp_millis("ts"), "yyyy-MM-dd").alias("dt"),
        F.col("instrument_id").alias("resource"),
        F.lit(1).cast("bigint").alias("value"),
        "ts",
    )
    stored = e.filter(F.col("ts") < MID).groupBy("dt", "resource").agg(F.sum("value").alias("value"))
    return upserts.add_counters(stored, e.filter(F.col("ts") >= MID), ["dt", "resource"], "value")


