"""Registry and ledger queries over edges, versions, runs, metrics and verdicts.

Each per-edge lookup is an aggregate joined back, for all edges at once.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barline.functions.scalar import bare_feature_name, date_key, round_trip_bps
from barline.operators.series import latest
from barline.operators.upserts import rows_at_max, top_per_key

STUCK_RUNNING_MS = 6 * 3_600_000

# Lifecycle states and the moves between them.
TRANSITIONS = {
    "IDEA": ["CANDIDATE"],
    "CANDIDATE": ["TESTING", "REJECTED"],
    "TESTING": ["VALIDATED", "CANDIDATE", "REJECTED"],
    "VALIDATED": ["PAPER", "REJECTED"],
    "PAPER": ["ACTIVE", "RETIRED"],
    "ACTIVE": ["DECAYING", "RETIRED"],
    "DECAYING": ["ACTIVE", "RETIRED"],
    "RETIRED": ["CANDIDATE"],
    "REJECTED": ["CANDIDATE"],
}
READINESS_STATES = [
    "VALIDATED_PLUS",
    "FULL_DONE",
    "SCREEN_DONE",
    "READY",
    "DATA_PENDING",
    "FEATURE_PENDING",
    "SIGNAL_SPEC_PENDING",
    "BUILD_PENDING",
]
PAST_TESTING = ["VALIDATED", "PAPER", "ACTIVE", "DECAYING"]
FEATURE_BASE_TABLE = {
    "funding_z_30d": "funding_rates",
    "funding_chg_24h": "funding_rates",
    "oi_chg_24h": "open_interest",
    "oi_pctile_1y": "open_interest",
    "ls_all_account_z_30d": "long_short_ratios",
    "ls_top_trader_z_30d": "long_short_ratios",
    "liq_notional_24h": "liquidations_5m",
}


def edge_runs(runs: DataFrame, versions: DataFrame) -> DataFrame:
    """Runs with the edge of their version."""
    return runs.join(versions.select(F.col("version_id").alias("edge_version_id"), "edge_id"), "edge_version_id")


def latest_verdict(verdicts: DataFrame, runs_of_edges: DataFrame) -> DataFrame:
    """Newest verdict and score per edge."""
    joined = verdicts.join(runs_of_edges.select("run_id", "edge_id"), "run_id")
    return latest(
        joined, ["edge_id"], [F.col("decided_at"), F.col("run_id")], ["verdict", "score", "decided_at"]
    ).withColumnsRenamed({"verdict": "latest_verdict", "score": "latest_score"})


def trial_counts(runs_of_edges: DataFrame) -> DataFrame:
    """Screen and full runs per edge over all versions."""
    trials = runs_of_edges.filter(F.col("run_kind").isin("screen", "full"))
    return trials.groupBy("edge_id").agg(F.count(F.lit(1)).alias("trial_count"))


def edge_list(edges: DataFrame, versions: DataFrame, runs: DataFrame, verdicts: DataFrame) -> DataFrame:
    """Edges with latest verdict, latest score and trial count."""
    er = edge_runs(runs, versions)
    return (
        edges.join(latest_verdict(verdicts, er).drop("decided_at"), "edge_id", "left")
        .join(trial_counts(er), "edge_id", "left")
        .withColumn("trial_count", F.coalesce("trial_count", F.lit(0).cast("bigint")))
    )


def recent_runs(runs: DataFrame, k: int = 5) -> DataFrame:
    """Last k runs per version by finish, else start, else 0."""
    when = F.coalesce("finished_at", "started_at", F.lit(0))
    return top_per_key(runs, ["edge_version_id"], [when.desc(), F.col("run_id").desc()], k)


def pivot_metrics(metrics: DataFrame, segment: str, names: Sequence[str]) -> DataFrame:
    """One row per run with the named metrics of a segment as columns."""
    return (
        metrics.filter((F.col("segment") == segment) & F.col("metric").isin(list(names)))
        .groupBy("run_id")
        .agg(*[F.max(F.when(F.col("metric") == m, F.col("value"))).alias(m) for m in names])
    )


def edge_detail_runs(
    versions: DataFrame, runs: DataFrame, metrics: DataFrame, verdicts: DataFrame, k: int = 5
) -> DataFrame:
    """Last k runs of each current version with verdict and out-of-sample metrics."""
    current = versions.filter(F.col("is_current") == 1).select("edge_id", F.col("version_id").alias("edge_version_id"))
    picked = recent_runs(runs.join(current, "edge_version_id"), k)
    return picked.join(verdicts.select("run_id", "verdict"), "run_id", "left").join(
        pivot_metrics(metrics, "wf:oos", ["ev_bps", "sharpe", "dsr", "p_perm"]), "run_id", "left"
    )


def recent_signals(signals: DataFrame, k: int = 20) -> DataFrame:
    """Last k signals per version."""
    return top_per_key(signals, ["edge_version_id"], [F.col("ts_signal").desc(), F.col("signal_id").desc()], k)


def latest_screen(runs_of_edges: DataFrame, metrics: DataFrame) -> DataFrame:
    """overall ev_bps and wf:oos p_perm of the newest finished screen run per edge."""
    done = runs_of_edges.filter((F.col("run_kind") == "screen") & (F.col("status") == "done"))
    newest = latest(done, ["edge_id"], [F.col("finished_at"), F.col("run_id")], ["run_id"])
    m = metrics.groupBy("run_id").agg(
        F.max(F.when((F.col("segment") == "overall") & (F.col("metric") == "ev_bps"), F.col("value"))).alias(
            "screen_ev_bps"
        ),
        F.max(F.when((F.col("segment") == "wf:oos") & (F.col("metric") == "p_perm"), F.col("value"))).alias(
            "screen_p_perm"
        ),
    )
    both = F.col("screen_ev_bps").isNotNull() & F.col("screen_p_perm").isNotNull()
    return newest.join(m, "run_id").filter(both).select("edge_id", "run_id", "screen_ev_bps", "screen_p_perm")


def latest_full_verdict(runs_of_edges: DataFrame, verdicts: DataFrame) -> DataFrame:
    """Verdict of the newest decision over the full runs of an edge."""
    full = runs_of_edges.filter(F.col("run_kind") == "full")
    return latest_verdict(verdicts, full).select("edge_id", F.col("latest_verdict").alias("full_verdict"), "decided_at")


def current_full_verdicts(versions: DataFrame, runs: DataFrame, verdicts: DataFrame) -> DataFrame:
    """Verdict rows at the newest decision of each current version (ties kept)."""
    current = versions.filter(F.col("is_current") == 1).select("edge_id", F.col("version_id").alias("edge_version_id"))
    full = runs.filter(F.col("run_kind") == "full").join(current, "edge_version_id").select("run_id", "edge_id")
    return rows_at_max(verdicts.join(full, "run_id"), ["edge_id"], "decided_at")


def verdict_feed(edges: DataFrame, versions: DataFrame, runs: DataFrame, verdicts: DataFrame, since: int) -> DataFrame:
    """Verdicts decided since a moment with run kind and edge title."""
    recent = verdicts.filter(F.col("decided_at") >= since)
    return (
        recent.join(edge_runs(runs, versions).select("run_id", "run_kind", "edge_id"), "run_id")
        .join(edges.select("edge_id", F.col("title").alias("edge_title")), "edge_id")
        .select("run_id", "verdict", "decided_at", "run_kind", "edge_title")
    )


# ------------------------------------------------------------------------- readiness


def readiness(
    edges: DataFrame,
    rule_inputs: DataFrame,
    runs: DataFrame,
    feature_defs: DataFrame,
    event_types: DataFrame,
    tables_with_data: Sequence[str],
    has_regimes: bool,
) -> DataFrame:
    """Readiness state per edge, first match of eight.

    ``rule_inputs`` is one row per edge with a current version: edge_id, version_id,
    features array, event_types array, uses_regime. The defined features and known
    event types are joined by name, not collected. ``edges`` may have plan_blockers, an
    array of what is yet to be built for an edge of class C or D.

    ``missing`` names what keeps an edge from its next state, as a struct whose fields are
    null where they do not apply: data and event (DATA_PENDING; absent regimes count as the
    table regimes_daily), feature (FEATURE_PENDING), build (BUILD_PENDING; empty without
    blockers) and signalSpec (SIGNAL_SPEC_PENDING). From READY on it is all null.
    """
    done = runs.filter(F.col("status") == "done").groupBy("edge_version_id").agg(
        F.max(F.col("run_kind") == "screen").alias("_screen"), F.max(F.col("run_kind") == "full").alias("_full")
    )
    defined = (
        feature_defs.filter(F.col("status") == "active")
        .select(bare_feature_name("feature_id").alias("name"))
        .distinct()
        .withColumn("_def", F.lit(True))
    )
    pending_base = [f for f, t in FEATURE_BASE_TABLE.items() if t not in tables_with_data]
    feats = (
        rule_inputs.select("edge_id", F.explode("features").alias("name"))
        .join(defined, "name", "left")
        .groupBy("edge_id")
        .agg(
            F.array_sort(F.collect_set(F.when(F.col("_def").isNull(), F.col("name")))).alias("undefined_features"),
            F.array_sort(
                F.collect_set(F.when(F.col("_def").isNotNull() & F.col("name").isin(pending_base), F.col("name")))
            ).alias("pending_features"),
        )
    )
    evs = (
        rule_inputs.select("edge_id", F.explode("event_types").alias("event_type"))
        .join(event_types.select("event_type").distinct(), "event_type", "left_anti")
        .groupBy("edge_id")
        .agg(F.array_sort(F.collect_set("event_type")).alias("pending_events"))
    )
    rows = (
        edges.join(rule_inputs.select("edge_id", "version_id", "uses_regime"), "edge_id", "left")
        .join(done.withColumnRenamed("edge_version_id", "version_id"), "version_id", "left")
        .join(feats, "edge_id", "left")
        .join(evs, "edge_id", "left")
    )

    def some(name: str) -> Column:
        return F.coalesce(F.size(name) > 0, F.lit(False))

    has_version = F.col("version_id").isNotNull()
    regime_missing = F.coalesce(F.col("uses_regime"), F.lit(False)) & F.lit(not has_regimes)
    state = (
        F.when(F.col("status").isin(PAST_TESTING), "VALIDATED_PLUS")
        .when(F.coalesce("_full", F.lit(False)), "FULL_DONE")
        .when(F.coalesce("_screen", F.lit(False)), "SCREEN_DONE")
        .when(has_version & (some("pending_features") | some("pending_events") | regime_missing), "DATA_PENDING")
        .when(has_version & some("undefined_features"), "FEATURE_PENDING")
        .when(has_version, "READY")
        .when(F.col("readiness_class").isin("C", "D"), "BUILD_PENDING")
        .otherwise("SIGNAL_SPEC_PENDING")
    )
    blockers = F.col("plan_blockers") if "plan_blockers" in edges.columns else F.lit(None)
    regimes = F.when(regime_missing, F.array(F.lit("regimes_daily"))).otherwise(F.array().cast("array<string>"))
    data = F.concat(F.coalesce("pending_features", F.array().cast("array<string>")), regimes)
    is_state = lambda name: F.col("state") == name
    missing = F.struct(
        F.when(is_state("DATA_PENDING") & (F.size(data) > 0), data).alias("data"),
        F.when(is_state("DATA_PENDING") & some("pending_events"), F.col("pending_events")).alias("event"),
        F.when(is_state("FEATURE_PENDING"), F.col("undefined_features")).alias("feature"),
        F.when(is_state("BUILD_PENDING"), F.coalesce(blockers.cast("array<string>"), F.array().cast("array<string>"))).alias("build"),
        F.when(is_state("SIGNAL_SPEC_PENDING"), F.lit(True)).alias("signalSpec"),
    )
    return rows.withColumn("state", state).select(
        missing.alias("missing"),
        "edge_id",
        "status",
        "version_id",
        "state",
        "undefined_features",
        "pending_features",
        "pending_events",
        regime_missing.alias("regime_missing"),
    )


def state_tally(df: DataFrame, state: str, states: Sequence[str]) -> DataFrame:
    """Count per allowed state, absent ones as 0.

    One aggregate with a counter per state; no dimension join.
    """
    counts = df.agg(*[F.count(F.when(F.col(state) == s, 1)).alias(s) for s in states])
    pairs = F.array(*[F.struct(F.lit(s).alias("state"), F.col(s).alias("n")) for s in states])
    return counts.select(F.explode(pairs).alias("_p")).select("_p.state", "_p.n")


def action_queue(edges: DataFrame, states: DataFrame, verdicts: DataFrame, issues: DataFrame) -> DataFrame:
    """All approvals, reviews and critical issues in one list.

    ``states`` from ``readiness``, ``verdicts`` from ``current_full_verdicts``.
    """
    v = latest(verdicts, ["edge_id"], F.col("run_id"), ["verdict"])
    rows = edges.select("edge_id", "title", "status").join(states.select("edge_id", "state"), "edge_id").join(
        v, "edge_id", "left"
    )
    done = F.col("state") == "FULL_DONE"
    approve = done & F.coalesce((F.col("verdict") == "ADOPT") & (F.col("status") == "TESTING"), F.lit(False))
    detail = (
        F.when(approve, "ADOPT: TESTING to VALIDATED awaits approval")
        .when(done, F.concat(F.lit("full run ("), F.coalesce("verdict", F.lit("no verdict")), F.lit(") awaits review")))
        .otherwise("screen run awaits review")
    )
    items = rows.filter(F.col("state").isin("FULL_DONE", "SCREEN_DONE")).select(
        F.when(approve, "approval").otherwise("review").alias("kind"),
        "edge_id",
        "title",
        detail.alias("detail"),
        F.lit(None).cast("bigint").alias("issue_id"),
    )
    critical = (
        issues.filter((F.col("status") == "open") & (F.col("severity") == "critical"))
        .select(
            F.lit("dq").alias("kind"),
            F.lit(None).cast(edges.schema["edge_id"].dataType).alias("edge_id"),
            F.col("rule_id").alias("title"),
            F.concat("stream_id", F.lit(" (critical, "), date_key("detected_at"), F.lit(")")).alias("detail"),
            F.col("issue_id").cast("bigint").alias("issue_id"),
        )
    )
    return items.unionByName(critical)


def reap_stuck(runs: DataFrame, now: Column) -> DataFrame:
    """Runs still 'running' after six hours become 'timeout'."""
    stuck = (F.col("status") == "running") & F.col("started_at").isNotNull() & (
        F.col("started_at") < now - F.lit(STUCK_RUNNING_MS)
    )
    hit = F.coalesce(stuck, F.lit(False))
    return runs.withColumns(
        {
            "finished_at": F.when(hit, now).otherwise(F.col("finished_at")),
            "status": F.when(hit, "timeout").otherwise(F.col("status")),
        }
    )


def paper_performance(
    versions: DataFrame, signals: DataFrame, runs: DataFrame, metrics: DataFrame, now: Column
) -> DataFrame:
    """Closed-signal performance of each current version beside its out-of-sample CI."""
    current = versions.filter(F.col("is_current") == 1).select(
        "edge_id", F.col("version_id").alias("edge_version_id"), round_trip_bps("cost_model").alias("expected_cost_bps")
    )
    closed = signals.filter((F.col("status") == "closed") & F.col("ret_net_bps").isNotNull())
    sd = F.stddev_samp("ret_net_bps")
    perf = closed.groupBy("edge_version_id").agg(
        F.min("ts_signal").alias("_first"),
        F.count(F.lit(1)).alias("signal_count"),
        F.when(sd > 0, F.try_divide(F.avg("ret_net_bps"), sd)).otherwise(F.lit(0.0)).alias("paper_sharpe"),
        F.coalesce(F.avg(F.col("ret_bps") - F.col("ret_net_bps")), F.lit(0.0)).alias("avg_slippage_bps"),
    )
    ci_rows = metrics.filter((F.col("segment") == "wf:oos") & (F.col("metric") == "sharpe_bootstrap"))
    full = runs.filter(F.col("run_kind") == "full").select("run_id", "edge_version_id", "finished_at")
    ci = latest(
        ci_rows.join(full, "run_id"),
        ["edge_version_id"],
        [F.coalesce("finished_at", F.lit(-1).cast("bigint")), F.col("run_id")],
        ["ci_lo", "ci_hi"],
    ).filter(F.col("ci_lo").isNotNull() & F.col("ci_hi").isNotNull())
    return (
        current.join(perf, "edge_version_id")
        .join(ci, "edge_version_id")
        .withColumn("paper_days", (now - F.col("_first")) / F.lit(86_400_000.0))
        .drop("_first")
    )


# Limits of a move, and the moves that need none.
MIN_SCREEN_EV_BPS, MAX_SCREEN_P_PERM = 0.0, 0.2
MIN_PAPER_DAYS, MIN_PAPER_SIGNALS = 30.0, 10.0
FREE_MOVES = [
    "TESTING>CANDIDATE",
    "VALIDATED>PAPER",
    "RETIRED>CANDIDATE",
    "DECAYING>ACTIVE",
    "PAPER>RETIRED",
    "ACTIVE>RETIRED",
    "DECAYING>RETIRED",
]


def _guards() -> list[tuple[str, str, Column, Column | None, Column | None]]:
    """(move, code, satisfied, measured value, its limit); a value that is not known satisfies nothing."""
    c = F.col

    def filled(name: str) -> tuple[str, str, Column, None, None]:
        return ("IDEA>CANDIDATE", f"{name}_blank", F.trim(name) != "", None, None)

    def measured(move: str, name: str, holds: Column, limit: Column) -> tuple[str, str, Column, Column, Column]:
        return (move, name, holds, c(name).cast("double"), limit.cast("double"))

    ev, p, days, signals = map(F.lit, (MIN_SCREEN_EV_BPS, MAX_SCREEN_P_PERM, MIN_PAPER_DAYS, MIN_PAPER_SIGNALS))
    paper = "PAPER>ACTIVE"
    return [
        *map(filled, ("hypothesis", "rationale", "counter_evidence")),
        ("IDEA>CANDIDATE", "version_missing", c("has_version"), None, None),
        measured("CANDIDATE>TESTING", "screen_ev_bps", c("screen_ev_bps") > ev, ev),
        measured("CANDIDATE>TESTING", "screen_p_perm", c("screen_p_perm") < p, p),
        ("TESTING>VALIDATED", "full_run_not_adopt", c("full_verdict") == "ADOPT", None, None),
        measured(paper, "paper_days", c("paper_days") >= days, days),
        measured(paper, "signal_count", c("signal_count") >= signals, signals),
        measured(paper, "paper_sharpe", c("paper_sharpe") >= c("oos_ci_lo"), c("oos_ci_lo")),
        measured(paper, "avg_slippage_bps", c("avg_slippage_bps") <= c("expected_cost_bps"), c("expected_cost_bps")),
        ("ACTIVE>DECAYING", "alarm_missing", c("cusum_alarm"), None, None),
    ]


def transition_audit(proposals: DataFrame) -> DataFrame:
    """Add ``ok`` and ``violations`` to proposed (from_status, to_status) moves.

    ``violations`` lists every guard that a move fails, as (code, value, limit); value and limit are null for
    guards that measure nothing. A move outside the graph has the one code ``not_in_graph``, a rejection
    without a REJECT verdict or a user behind it ``no_ground``, a move of the graph that nothing rules ``no_rule``.

    Guard inputs are columns, NULL when unknown: hypothesis, rationale,
    counter_evidence, has_version, screen_ev_bps, screen_p_perm, full_verdict,
    user_initiated, paper_days, signal_count, paper_sharpe, oos_ci_lo,
    avg_slippage_bps, expected_cost_bps, cusum_alarm.
    """
    none = F.lit(None).cast("double")

    def violation(code: str, value: Column | None = None, limit: Column | None = None) -> Column:
        return F.struct(
            F.lit(code).alias("code"),
            (none if value is None else value).alias("value"),
            (none if limit is None else limit).alias("limit"),
        )

    move = F.concat_ws(">", "from_status", "to_status")
    graph = [f"{a}>{b}" for a, targets in TRANSITIONS.items() for b in targets]
    guards = _guards()
    ruled = [*{g[0] for g in guards}, *FREE_MOVES]
    rejection = F.col("to_status") == "REJECTED"
    ground = F.coalesce(F.col("full_verdict") == "REJECT", F.lit(False)) | F.coalesce("user_initiated", F.lit(False))
    failed = F.array(
        *(
            F.when((move == of) & ~F.coalesce(holds, F.lit(False)), violation(code, value, limit))
            for of, code, holds, value, limit in guards
        ),
        F.when(rejection & ~ground, violation("no_ground")),
        F.when(~rejection & ~move.isin(ruled), violation("no_rule")),
    )
    outside = F.array(violation("not_in_graph"))
    found = F.when(~move.isin(graph), outside).otherwise(F.array_compact(failed))
    return proposals.withColumn("violations", found).withColumn("ok", F.size("violations") == 0)
