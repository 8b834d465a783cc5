"""Data-quality rules and stream health."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barline.functions.scalar import cadence_ms, source_id
from barline.operators.series import POS, add_windowed, index_rows, running, time_bucket

# Fixed values.
ERROR_STREAK = 3
RATE_LIMIT_STREAK = 6
RATE_LIMIT_TEXT = "HTTP 429"
QUOTA_WARN_RATIO = 0.8
MAX_ATTEMPTS = 6
SEVERITIES = ("critical", "warn", "info")


def error_streaks(
    runs: DataFrame, stream: str, order: Sequence[str], failed: Column, bucket: Column
) -> DataFrame:
    """Add ``streak``: consecutive failures up to each run, 0 on success.

    Position minus the position of the last success, both found without gathering
    a stream.
    """
    flagged = runs.withColumn("_failed", failed)
    indexed = index_rows(flagged, [stream], list(order), bucket)
    last_ok = {"_ok": ("last", F.when(~F.col("_failed"), F.col(POS)))}
    marked = running(indexed, [stream], POS, F.floor(F.col(POS) / F.lit(65_536)).cast("bigint"), last_ok)
    streak = F.when(F.col("_failed"), F.col(POS) - F.coalesce(F.col("_ok"), F.lit(-1))).otherwise(F.lit(0))
    return marked.withColumn("streak", streak.cast("bigint")).drop("_failed", "_ok")


def escalations(streaks: DataFrame, error_text: Column) -> DataFrame:
    """Runs at which a streak first reaches its threshold (one issue per streak)."""
    threshold = F.when(error_text.contains(RATE_LIMIT_TEXT), RATE_LIMIT_STREAK).otherwise(ERROR_STREAK)
    return (
        streaks.withColumn("threshold", threshold.cast("bigint"))
        .filter(F.col("streak") == F.col("threshold"))
        .withColumns({"rule_id": F.lit("DQ-02"), "severity": F.lit("critical")})
    )


def auto_resolve(issues: DataFrame, successes: DataFrame, stream: str = "stream_id") -> DataFrame:
    """Close open issues at the stream's first success after detection.

    Issues and successes of a stream form one series; the next success is carried
    back to the issues by running over reversed time.
    """
    a = issues.withColumns({"_t": F.col("detected_at"), "_issue": F.lit(True)})
    b = successes.select(stream, F.col("ts").alias("_t")).withColumn("_issue", F.lit(False))
    both = a.unionByName(b, allowMissingColumns=True)
    neg = -F.col("_t")
    # at equal times the success comes later in reversed order, so it does not count
    found = running(
        both.withColumn("_neg", neg),
        [stream],
        ["_neg", F.when(F.col("_issue"), 0).otherwise(1)],
        time_bucket("_neg", 86_400_000),
        {"_next": ("last", F.when(~F.col("_issue"), F.col("_t")))},
    ).filter(F.col("_issue"))
    hit = (F.col("status") == "open") & F.col("_next").isNotNull()
    return found.withColumns(
        {
            "resolved_at": F.when(hit, F.col("_next")).otherwise(F.col("resolved_at")),
            "status": F.when(hit, "resolved").otherwise(F.col("status")),
        }
    ).drop("_t", "_issue", "_neg", "_next")


def usage_ratio() -> Column:
    """value / budget for a finite positive budget, else NULL."""
    b = F.col("budget").cast("double")
    ok = (b > 0) & (b < float("inf"))
    return F.when(ok, F.try_divide(F.col("value").cast("double"), b))


def quota_issues(usage: DataFrame, issues: DataFrame, ratio: float = QUOTA_WARN_RATIO) -> DataFrame:
    """One issue per (resource, day) over the ratio that was not raised before."""
    hot = usage.withColumn("ratio", usage_ratio()).filter(F.col("ratio") >= ratio)
    named = hot.select(
        F.concat_ws(":", F.lit("quota"), "resource", "dt").alias("stream_id"),
        F.lit("DQ-10").alias("rule_id"),
        F.lit("critical").alias("severity"),
        "ratio",
    )
    raised = issues.filter(F.col("rule_id") == "DQ-10").select("stream_id").distinct()
    return named.join(raised, "stream_id", "left_anti")


def dead_tasks(tasks: DataFrame, max_attempts: int = MAX_ATTEMPTS) -> DataFrame:
    """Issues for tasks whose next failed attempt is the last allowed one."""
    return tasks.filter(F.col("attempts") + 1 >= max_attempts).select(
        "stream_id",
        F.lit("DQ-TASK-DEAD").alias("rule_id"),
        F.lit("critical").alias("severity"),
        (F.col("attempts") + 1).cast("bigint").alias("attempts"),
    )


def quality_score(last_run_at: Column, errors: Column, cadence: Column, now: Column) -> Column:
    """Freshness (1 within one cadence, 0 from three) times success (1 - errors/10)."""
    late = F.greatest(now - last_run_at - cadence, F.lit(0))
    fresh = F.greatest(F.lit(0.0), F.least(F.lit(1.0), 1 - late / (2 * cadence)))
    ok = F.greatest(F.lit(0.0), 1 - errors / 10)
    return F.coalesce(fresh, F.lit(0.0)) * ok


def issue_counts(issues: DataFrame) -> DataFrame:
    """Open issues per stream, one column per severity."""
    return (
        issues.filter(F.col("status") == "open")
        .groupBy("stream_id")
        .agg(*[F.count(F.when(F.col("severity") == s, 1)).alias(s) for s in SEVERITIES])
    )


def stream_health(state: DataFrame, issues: DataFrame, sources: DataFrame, now: Column) -> DataFrame:
    """Per-stream score, source and open issue counts."""
    counts = issue_counts(issues)
    scored = state.withColumns(
        {
            "source_id": source_id("stream_id"),
            "quality_score": quality_score(
                F.col("last_run_at"), F.col("consecutive_errors"), cadence_ms("stream_id"), now
            ),
        }
    )
    return (
        scored.join(counts, "stream_id", "left")
        .join(sources.select("source_id", F.col("status").alias("source_status")), "source_id", "left")
        .withColumns({s: F.coalesce(F.col(s), F.lit(0).cast("bigint")) for s in SEVERITIES})
    )


def overall_score(health: DataFrame) -> DataFrame:
    """Mean score over the streams whose source is not disabled."""
    live = F.coalesce(F.col("source_status"), F.lit("")) != "disabled"
    return health.filter(live).agg(
        F.avg("quality_score").alias("overall_quality_score"), F.count(F.lit(1)).alias("streams")
    )


def source_health(health: DataFrame, sources: DataFrame) -> DataFrame:
    """Source roll-up: number of streams, mean score, open issues; disabled last.

    One row per source instead of a nested list of its streams; ``stream_health`` is
    the detail and joins on source_id.
    """
    per = health.groupBy("source_id").agg(
        F.count(F.lit(1)).alias("streams"),
        F.avg("quality_score").alias("mean_score"),
        *[F.sum(s).alias(s) for s in SEVERITIES],
    )
    return sources.join(per, "source_id", "left").withColumn(
        "sort_key", F.when(F.col("status") == "disabled", 1).otherwise(0)
    )


def open_issues(issues: DataFrame, sources: DataFrame) -> DataFrame:
    """All open issues but those of disabled sources. Order and page size are the caller's."""
    off = sources.filter(F.col("status") == "disabled").select("source_id")
    found = issues.filter(F.col("status") == "open").withColumn("source_id", source_id("stream_id"))
    return found.join(off, "source_id", "left_anti")


def bulk_resolve(issues: DataFrame, prefixes: Sequence[str], at: Column) -> DataFrame:
    """Resolve the open issues of the named sources."""
    hit = (F.col("status") == "open") & source_id("stream_id").isin(list(prefixes))
    return issues.withColumns(
        {
            "resolved_at": F.when(hit, at).otherwise(F.col("resolved_at")),
            "status": F.when(hit, "resolved").otherwise(F.col("status")),
        }
    )


# ---------------------------------------------------------- checks over time series


def gaps(indexed: DataFrame, keys: Sequence[str], cadence: int, ts: str = "ts", size: int | None = None) -> DataFrame:
    """Holes longer than the cadence: start, end and missing slots."""
    rows = add_windowed(indexed, keys, lambda f: {"_prev": f.lag(ts, 1)}, before=1, size=size)
    missing = F.floor((F.col(ts) - F.col("_prev")) / F.lit(cadence)).cast("bigint") - 1
    return rows.filter(missing > 0).select(
        *keys, F.col("_prev").alias("gap_start"), F.col(ts).alias("gap_end"), missing.alias("missing")
    )


def spikes(
    indexed: DataFrame, keys: Sequence[str], value: str, window: int, sigma: float = 8.0, size: int | None = None
) -> DataFrame:
    """Rows further than ``sigma`` deviations from the mean of the ``window`` rows before them."""

    rows = add_windowed(
        indexed,
        keys,
        [
            lambda f: {"_mean": f.roll("avg", value, window), "_sd": f.roll("std_pop", value, window)},
            lambda f: {"_pm": f.lag("_mean", 1), "_ps": f.lag("_sd", 1)},
        ],
        before=window,
        size=size,
    )
    z = F.when(F.col("_ps") > 0, (F.col(value) - F.col("_pm")) / F.col("_ps"))
    return rows.withColumn("z", z).filter(F.abs("z") > sigma).drop("_mean", "_sd", "_pm", "_ps")


def out_of_range(df: DataFrame, column: str, low: float, high: float) -> DataFrame:
    return df.filter(~F.col(column).between(low, high))


def cross_source(a: DataFrame, b: DataFrame, on: Sequence[str], value: str, tolerance: float = 0.05) -> DataFrame:
    """Rows where two sources disagree by more than ``tolerance`` of the first."""
    joined = a.select(*on, F.col(value).alias("a_value")).join(b.select(*on, F.col(value).alias("b_value")), list(on))
    diff = F.abs(F.try_divide(F.col("b_value") - F.col("a_value"), F.col("a_value")))
    return joined.withColumn("rel_diff", diff).filter(F.col("rel_diff") > tolerance)


def time_travel(df: DataFrame, ts: str = "ts", ingested_at: str = "ingested_at") -> DataFrame:
    """Rows ingested before the moment they describe."""
    return df.filter(F.col(ts) > F.col(ingested_at))


def large_revisions(
    indexed: DataFrame, keys: Sequence[str], value: str, tolerance: float = 0.10, size: int | None = None
) -> DataFrame:
    """Revisions of a key that move the value by more than ``tolerance``."""
    rows = add_windowed(indexed, keys, lambda f: {"_prev": f.lag(value, 1)}, before=1, size=size)
    change = F.abs(F.try_divide(F.col(value) - F.col("_prev"), F.col("_prev")))
    return rows.withColumn("rel_change", change).filter(F.col("rel_change") > tolerance).drop("_prev")
