"""Structured Streaming forms of ingest, buckets, dedupe, joins and stateful operators.

Every operator takes a streaming frame and gives a streaming frame; ``drain`` and
``drain_upserts`` run one to completion over the data that is there.
"""

from __future__ import annotations

from collections.abc import Sequence
from typing import Any

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from barline.functions.scalar import parse_horizon_ms
from barline.operators.rules import RuleError, event_types_of, features_of, max_lag, rule_column
from barline.operators.series import latest
from barline.session import run_dir


def landed(
    spark: SparkSession, path: str, schema: T.StructType, pattern: str | None = None, max_files: int | None = 1000
) -> DataFrame:
    """Stream of landed Parquet files; the checkpoint keeps what was read.

    ``max_files`` bounds a micro-batch, and with it what a stateful operator sorts.
    """
    reader = spark.readStream.schema(schema)
    if pattern:
        reader = reader.option("pathGlobFilter", pattern)
    if max_files:
        reader = reader.option("maxFilesPerTrigger", max_files)
    return reader.parquet(path)


def drain(stream: DataFrame, label: str, mode: str = "append", checkpoint: str | None = None, out: str | None = None) -> DataFrame:
    """Run a stream over the available files into a Parquet table and read it back."""
    spark = stream.sparkSession
    base = run_dir(spark, label)
    target, chk = out or f"{base}/data", checkpoint or f"{base}/checkpoint"
    q = (
        stream.writeStream.format("parquet")
        .outputMode(mode)
        .option("path", target)
        .option("checkpointLocation", chk)
        .trigger(availableNow=True)
        .start()
    )
    q.awaitTermination()
    return spark.read.schema(stream.schema).parquet(target)


def change_log_writer(target: str):
    """foreachBatch writer: the changed rows of a batch as one partition.

    A repeated batch overwrites its own partition, so a restart leaves no duplicates.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{target}/batch={batch_id}")

    return write


def current_rows(spark: SparkSession, target: str, schema: T.StructType, keys: Sequence[str]) -> DataFrame:
    """Newest row per key of a change log."""
    log = spark.read.schema(T.StructType([*schema.fields, T.StructField("batch", T.LongType())])).parquet(target)
    return latest(log, keys, F.col("batch"), [f.name for f in schema.fields if f.name not in keys])


def drain_upserts(stream: DataFrame, keys: Sequence[str], label: str, mode: str = "update") -> DataFrame:
    """Run a stream whose re-emitted keys replace earlier rows; the newest row per key."""
    spark = stream.sparkSession
    base = run_dir(spark, label)
    q = (
        stream.writeStream.foreachBatch(change_log_writer(f"{base}/log"))
        .outputMode(mode)
        .option("checkpointLocation", f"{base}/checkpoint")
        .trigger(availableNow=True)
        .start()
    )
    q.awaitTermination()
    return current_rows(spark, f"{base}/log", stream.schema, keys)


# ------------------------------------------------------------------------ stateless


def tumbling_side_buckets(
    fills: DataFrame,
    keys: Sequence[str],
    long_label: str,
    short_label: str,
    width: str = "5 minutes",
    delay: str = "10 minutes",
) -> DataFrame:
    """Notional per side and tumbling window; ``event_time`` is a timestamp column."""
    n = F.col("notional")
    return (
        fills.withWatermark("event_time", delay)
        .groupBy(*keys, F.window("event_time", width))
        .agg(
            F.coalesce(F.sum(F.when(F.col("side") == long_label, n)), F.lit(0.0)).alias("long_liq_usd"),
            F.coalesce(F.sum(F.when(F.col("side") == short_label, n)), F.lit(0.0)).alias("short_liq_usd"),
            F.count(F.lit(1)).alias("events"),
            F.max(n).alias("max_single_usd"),
        )
        .select(
            *keys,
            F.unix_millis("window.start").alias("ts"),
            "long_liq_usd",
            "short_liq_usd",
            "events",
            "max_single_usd",
        )
    )


def bars(ticks: DataFrame, keys: Sequence[str], price: str, tiebreak: str, width: str = "1 hour", delay: str = "1 day") -> DataFrame:
    """Bars that are re-emitted while late ticks still arrive (update mode)."""
    order = F.struct("event_time", tiebreak)
    return (
        ticks.withWatermark("event_time", delay)
        .groupBy(*keys, F.window("event_time", width))
        .agg(
            F.min_by(price, order).alias("open"),
            F.max(price).alias("high"),
            F.min(price).alias("low"),
            F.max_by(price, order).alias("close"),
            F.count(F.lit(1)).alias("trades"),
        )
        .select(*keys, F.unix_millis("window.start").alias("ts"), "open", "high", "low", "close", "trades")
    )


def dedupe(stream: DataFrame, key: str, delay: str) -> DataFrame:
    """First row per key within the watermark delay."""
    return stream.withWatermark("event_time", delay).dropDuplicatesWithinWatermark([key])


def lookback_join(ticks: DataFrame, events: DataFrame, key: str, minutes: int = 15, delay: str = "1 hour") -> DataFrame:
    """Ticks with the events of their key in the ``minutes`` before them.

    Both sides are watermarked, so the join state is dropped once it cannot match.
    """
    t = ticks.withWatermark("event_time", delay).alias("t")
    e = events.withWatermark("event_time", delay).alias("e")
    near = F.expr(
        f"t.{key} = e.{key} AND e.event_time <= t.event_time AND e.event_time >= t.event_time - INTERVAL {minutes} MINUTES"
    )
    return t.join(e, near).select(
        F.col(f"t.{key}").alias(key), F.col("t.tick_id").alias("tick_id"), F.col("e.event_id").alias("event_id"),
        F.col("e.magnitude").alias("magnitude"),
    )


def with_daily_label(stream: DataFrame, labels: DataFrame, ts: str = "ts") -> DataFrame:
    """Stream rows with the label row of their own date (static table)."""
    dt = F.date_format(F.timestamp_millis(ts), "yyyy-MM-dd")
    return stream.withColumn("dt", dt).join(labels, "dt", "left")


def live_rule(stream: DataFrame, spec: dict[str, Any], out: str = "fired") -> DataFrame:
    """Evaluate a rule row by row on a stream.

    Only rules without features and lags, with a fixed horizon and a delay of at most
    one bar can run live; event columns must be on the rows.
    """
    when = spec["when"]
    if features_of(when) or max_lag(when):
        raise RuleError("a live rule cannot read features")
    if "horizon" not in spec["exit"]:
        raise RuleError("a live rule needs a fixed horizon")
    if spec.get("entry", {}).get("delay_bars", 1) > 1:
        raise RuleError("a live rule enters at the next tick")
    missing = [t for t in event_types_of(when) if f"ev_{t}" not in stream.columns]
    if missing:
        raise RuleError(f"event columns not on the stream: {missing}")
    return stream.withColumn(out, rule_column(when))


def live_signals(
    ticks: DataFrame,
    events: DataFrame,
    spec: dict[str, Any],
    carry: Sequence[str] = (),
    regimes: DataFrame | None = None,
    minutes: int = 15,
    delay: str = "1 hour",
    out: str = "fired",
) -> DataFrame:
    """A rule at every tick, with the events of the ``minutes`` up to it and the regime row of its day.

    ``ticks`` (event_time, ts, tick_id and the columns of ``carry``) and ``events`` (event_time, event_type,
    magnitude) are streams. Steps of one query: a look-back join, watermarked on both sides; the largest magnitude
    of each event type the rule names (a missing magnitude counts 0); the daily label; the rule. A tick is given once,
    when the watermark has passed it, so events that come late by less than ``delay`` count; later ones do not.
    Ticks and events meet by slots of ``minutes``, of which a tick looks into two, whatever their number.
    """
    types = sorted(event_types_of(spec["when"]))
    slot = F.floor(F.unix_seconds("event_time") / F.lit(60 * minutes))
    t = ticks.select("event_time", "ts", "tick_id", *carry).withWatermark("event_time", delay)
    t = t.withColumn("slot", F.explode(F.array(slot, slot - 1))).alias("t")
    e = events.select("event_time", "event_type", F.coalesce("magnitude", F.lit(0.0)).alias("magnitude"))
    e = e.withWatermark("event_time", delay)
    # events of all types move the watermark: the condition names the time, so that it stays above it
    e = e.filter(F.when(F.col("event_time").isNotNull(), F.col("event_type").isin(types))).withColumn("slot", slot).alias("e")
    near = F.expr(
        f"t.slot = e.slot AND e.event_time <= t.event_time AND e.event_time >= t.event_time - INTERVAL {minutes} MINUTES"
    )
    met = t.join(e, near, "left_outer")
    largest = [F.max(F.when(F.col("e.event_type") == k, F.col("e.magnitude"))).alias(f"ev_{k}") for k in types]
    seen = met.groupBy(*[F.col(f"t.{c}") for c in ("event_time", "ts", "tick_id", *carry)]).agg(
        F.count(F.lit(1)).alias("_met"), *largest
    )
    if regimes is not None:
        parts = [c for c in regimes.columns if c != "dt"]
        seen = with_daily_label(seen, regimes).withColumn("regime", F.struct(*parts)).drop(*parts)
    return live_rule(seen, spec, out).drop("_met")


def running_moments(stream: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """n, mean and sample variance per key so far (update mode).

    A built-in streaming aggregate: every task sends one partial row per key.
    """
    return stream.groupBy(*keys).agg(
        F.count(value).alias("n"),
        F.avg(value).alias("mean"),
        F.coalesce(F.var_samp(value), F.lit(0.0)).alias("variance"),
    )


# ------------------------------------------------------------------------- stateful

POSITION_SCHEMA = "entry_ts bigint, entry_px double, exit_ts bigint, exit_px double, ret_bps double, ret_net_bps double"


def _in_order(frames, ts: str) -> pd.DataFrame:
    parts = [f for f in frames if len(f)]
    return pd.concat(parts).sort_values(ts, kind="stable") if parts else pd.DataFrame()


def positions(
    ticks: DataFrame, key: str, horizon: str, direction: str = "long", cost_bps: float = 0.0
) -> DataFrame:
    """One open position per key: closed trades of the column ``fired``.

    A fire opens at the tick's ``open`` when nothing is open; the first tick at or
    past entry + horizon closes at its ``close``. A tick settles before it enters.
    The state is one pair per key; the rows of a key in a micro-batch are read in
    time order.
    """
    hold = parse_horizon_ms(horizon)
    key_type = ticks.schema[key].dataType.simpleString()

    def step(k: tuple, frames, state: GroupState):
        entry_ts, entry_px = state.get if state.exists else (None, None)
        closed = []
        data = _in_order(frames, "ts")
        for row in data.itertuples(index=False):
            if entry_ts is not None and row.ts >= entry_ts + hold:
                ratio = row.close / entry_px if direction == "long" else entry_px / row.close
                gross = (ratio - 1.0) * 10_000
                closed.append((k[0], entry_ts, entry_px, row.ts, row.close, gross, gross - cost_bps))
                entry_ts, entry_px = None, None
            if entry_ts is None and row.fired:
                entry_ts, entry_px = int(row.ts), float(row.open)
        state.update((entry_ts, entry_px))
        names = [key, "entry_ts", "entry_px", "exit_ts", "exit_px", "ret_bps", "ret_net_bps"]
        if closed:
            yield pd.DataFrame(closed, columns=names)

    return ticks.groupBy(key).applyInPandasWithState(
        step,
        f"{key} {key_type}, {POSITION_SCHEMA}",
        "entry_ts bigint, entry_px double",
        "append",
        GroupStateTimeout.NoTimeout,
    )


def ewma(stream: DataFrame, key: str, value: str, alpha: float, row_id: str) -> DataFrame:
    """Exponential mean per key, one output per row, in time order within a batch."""
    key_type = stream.schema[key].dataType.simpleString()

    def step(k: tuple, frames, state: GroupState):
        (mean,) = state.get if state.exists else (None,)
        rows = []
        data = _in_order(frames, "ts")
        for row in data.itertuples(index=False):
            x = float(getattr(row, value))
            mean = x if mean is None else alpha * x + (1 - alpha) * mean
            rows.append((k[0], getattr(row, row_id), mean))
        if mean is not None:
            state.update((mean,))
        if rows:
            yield pd.DataFrame(rows, columns=[key, row_id, "ewma"])

    return stream.groupBy(key).applyInPandasWithState(
        step, f"{key} {key_type}, {row_id} bigint, ewma double", "mean double", "append", GroupStateTimeout.NoTimeout
    )


def event_time(ts: str) -> Column:
    """Timestamp with zone, as watermarks need it."""
    return F.col(ts).cast("timestamp")
