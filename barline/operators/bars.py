"""Bars and buckets from ticks, fills and finer rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from barline.functions.scalar import floor_to
from barline.operators.series import HOUR_MS

FIVE_MIN_MS = 300_000

# Base units per contract.
CONTRACT_FACE_VALUE = {"BTC-USDT-SWAP": 0.01, "ETH-USDT-SWAP": 0.1}


def tick_order(ticks: DataFrame, ts: str, tiebreak: str | None) -> Column:
    """Sort key of a tick. An integer tie-break is packed with the time into one decimal,
    a fixed-width value that keeps the aggregate hash-based; other types use a struct."""
    if tiebreak is None:
        return F.col(ts)
    if isinstance(ticks.schema[tiebreak].dataType, T.LongType | T.IntegerType):
        wide = F.lit("20000000000000000000").cast("decimal(20,0)")
        return F.col(ts).cast("decimal(18,0)") * wide + F.col(tiebreak)
    return F.struct(ts, tiebreak)


def ohlcv(
    ticks: DataFrame,
    keys: Sequence[str],
    interval_ms: int,
    ts: str = "ts",
    price: str = "price",
    size: str = "price",
    tiebreak: str | None = None,
) -> DataFrame:
    """One bar per (key, slot): open, high, low, close, volume, trades.

    Every aggregate is combined on the map side, so a hot key costs each task one
    row per slot in the shuffle.
    """
    order = tick_order(ticks, ts, tiebreak)
    return (
        ticks.groupBy(*keys, floor_to(ts, interval_ms).alias("_slot"))
        .agg(
            F.min_by(price, order).alias("open"),
            F.max(price).alias("high"),
            F.min(price).alias("low"),
            F.max_by(price, order).alias("close"),
            F.sum(size).alias("volume"),
            F.count(F.lit(1)).alias("trades"),
        )
        .withColumnRenamed("_slot", "ts")
    )


def fill_notional(executed_price: Column, executed_qty: Column, price: Column, qty: Column) -> Column:
    """Executed notional when positive, else price * quantity."""
    executed = executed_price * executed_qty
    return F.when(executed > 0, executed).otherwise(price * qty)


def side_buckets(
    fills: DataFrame,
    keys: Sequence[str],
    side: Column,
    notional: Column,
    long_label: str,
    short_label: str,
    interval_ms: int = FIVE_MIN_MS,
    ts: str = "ts",
) -> DataFrame:
    """Notional per side, fill count and largest fill per (key, slot)."""
    n = F.col("_notional")
    return (
        fills.withColumns({"_side": side, "_notional": notional})
        .groupBy(*keys, floor_to(ts, interval_ms).alias("_slot"))
        .agg(
            F.coalesce(F.sum(F.when(F.col("_side") == long_label, n)), F.lit(0.0)).alias("long_liq_usd"),
            F.coalesce(F.sum(F.when(F.col("_side") == short_label, n)), F.lit(0.0)).alias("short_liq_usd"),
            F.count(F.lit(1)).alias("events"),
            F.max(n).alias("max_single_usd"),
        )
        .withColumnRenamed("_slot", "ts")
    )


def hourly_notional(buckets: DataFrame, keys: Sequence[str], source_id: str | None) -> DataFrame:
    """Long + short notional per hour, from the buckets of one source."""
    if source_id is not None:
        buckets = buckets.filter(F.col("source_id") == source_id)
    return buckets.groupBy(*keys, floor_to("ts", HOUR_MS).alias("_h")).agg(
        (F.sum("long_liq_usd") + F.sum("short_liq_usd")).alias("liq_notional_1h")
    ).withColumnRenamed("_h", "ts")


def pivot_mean(
    df: DataFrame, keys: Sequence[str], name: str, value: str, columns: dict[str, str]
) -> DataFrame:
    """Long to wide with the mean on duplicates; ``columns`` fixes the names kept."""
    kept = df.filter(F.col(name).isin(list(columns)))
    return kept.groupBy(*keys).agg(
        *[F.avg(F.when(F.col(name) == old, F.col(value))).alias(new) for old, new in columns.items()]
    )


def merge_moments(parts: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Merge (n, mean, m2) rows into one row per key (pairwise-mergeable moments).

    m2 = sum(m2_i) + sum(n_i * (mean_i - mean)^2); the mean goes in as a second
    small aggregate so that large means do not cancel.
    """
    n, mean = F.col("n"), F.col("mean")
    total = parts.groupBy(*keys).agg(F.sum("n").alias("_n"), F.try_divide(F.sum(n * mean), F.sum("n")).alias("_mean"))
    return (
        parts.join(total, list(keys))
        .groupBy(*keys)
        .agg(
            F.max("_n").cast("bigint").alias("n"),
            F.max("_mean").alias("mean"),
            F.sum(F.col("m2") + n * F.pow(mean - F.col("_mean"), F.lit(2.0))).alias("m2"),
        )
    )


def moment_stats() -> dict[str, Column]:
    """variance and stddev of (n, mean, m2); zero when undefined."""
    var = F.when(F.col("n") > 1, F.col("m2") / (F.col("n") - 1)).otherwise(F.lit(0.0))
    return {"variance": var, "stddev": F.sqrt(var)}


def z_against(x: Column) -> Column:
    """z of x against columns mean/stddev, 0 while the deviation is zero."""
    return F.when(F.col("stddev") > 0, (x - F.col("mean")) / F.col("stddev")).otherwise(F.lit(0.0))
