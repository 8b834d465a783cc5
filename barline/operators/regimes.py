"""Daily regime labels: trend, volatility and liquidity."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from barline.operators.features import add_ranks, true_range
from barline.operators.series import BLK, POS, Frames, add_windowed, blocks, core_rows, latest

MIN_HISTORY_ROWS = 200
MODEL_VERSION = "rule-based-1.0"


@dataclass(frozen=True)
class Thresholds:
    adx_trend_min: float = 20.0
    vol_low_pctile: float = 0.33
    vol_extreme_pctile: float = 0.90
    spread_stressed_pctile: float = 0.90
    liq_z_stressed: float = 3.0
    peg_dev_stressed_bps: float = 50.0


def realized_vol(f: Frames, log_ret: str, w: int = 30, periods: int = 365) -> Column:
    """Annualised sample deviation of log returns."""
    return f.roll("std_samp", log_ret, w) * F.sqrt(F.lit(float(periods)))


def directional_moves(f: Frames) -> dict[str, Column]:
    """+DM, -DM and true range of a bar; 0 moves on the first row."""
    up = F.col("high") - f.lag("high", 1)
    down = f.lag("low", 1) - F.col("low")
    return {
        "_plus": F.when((up > down) & (up > 0), up).otherwise(F.lit(0.0)),
        "_minus": F.when((down > up) & (down > 0), down).otherwise(F.lit(0.0)),
        "_tr": true_range(f, "high", "low", "close"),
    }


def add_adx(indexed: DataFrame, keys: Sequence[str], window: int = 14, size: int | None = None) -> DataFrame:
    """Add ``adx``: Wilder means of moves and range, then of the directional index.

    Two recursive means in a row, each with weights that vanish (under 1e-18) within
    its halo; a block with both halos gives the value of the whole series.
    """
    alpha = 1.0 / window
    reach = int(np.ceil(np.log(1e-18) / np.log(1.0 - alpha))) + window
    moves = add_windowed(indexed, keys, directional_moves, before=1, size=size)
    parts = blocks(moves, before=2 * reach, size=size)
    schema = T.StructType([*parts.schema.fields, T.StructField("adx", T.DoubleType())])

    def adx_block(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(POS, ignore_index=True)

        def wilder(s: pd.Series) -> pd.Series:
            return s.astype(float).ewm(alpha=alpha, adjust=False, min_periods=window).mean()

        rng, plus, minus = wilder(pdf["_tr"]), wilder(pdf["_plus"]), wilder(pdf["_minus"])
        plus_di, minus_di = 100 * plus / rng, 100 * minus / rng
        total = plus_di + minus_di
        dx = 100 * (plus_di - minus_di).abs() / total.where(total != 0)
        pdf["adx"] = wilder(dx)
        return pdf

    out = core_rows(parts.groupBy(*keys, BLK).applyInPandas(adx_block, schema))
    return out.drop("_plus", "_minus", "_tr")


def trend_label(t: Thresholds) -> Column:
    sma, adx = F.col("sma200"), F.col("adx")
    strong = adx >= t.adx_trend_min
    label = F.when(strong & (F.col("close") > sma), "up").when(strong & (F.col("close") <= sma), "down")
    return F.when(sma.isNotNull() & adx.isNotNull(), label.otherwise("range"))


def vol_label(t: Thresholds, rank: str = "rv_rank") -> Column:
    r = F.col(rank)
    label = F.when(r >= t.vol_extreme_pctile, "extreme").when(r <= t.vol_low_pctile, "low").otherwise("high")
    return F.when(r.isNotNull(), label)


def liquidity_label(t: Thresholds, spread_rank: Column, liq_z: Column, peg_dev: Column) -> Column:
    def hit(cond: Column) -> Column:
        return F.coalesce(cond, F.lit(False))

    stressed = (
        hit(spread_rank >= t.spread_stressed_pctile)
        | hit(F.abs(liq_z) >= t.liq_z_stressed)
        | hit(F.abs(peg_dev) >= t.peg_dev_stressed_bps)
    )
    missing = spread_rank.isNull() & liq_z.isNull() & peg_dev.isNull()
    return F.when(~missing, F.when(stressed, "stressed").otherwise("normal"))


def classify(
    daily: DataFrame,
    keys: Sequence[str],
    thresholds: Thresholds | None = None,
    rank_window: int = 365,
    size: int | None = None,
) -> DataFrame:
    """trend / vol / liquidity of indexed daily bars.

    Liquidity inputs ``spread_bps``, ``liq_zscore``, ``peg_dev_bps`` default to 0 when
    the bars do not carry them, which labels every day 'normal' once ranked.
    """
    t = thresholds or Thresholds()
    for name in ("spread_bps", "liq_zscore", "peg_dev_bps"):
        if name not in daily.columns:
            daily = daily.withColumn(name, F.lit(0.0))
    inputs = ["ts", "close", "high", "low", "spread_bps", "liq_zscore", "peg_dev_bps"]
    daily = daily.select(*keys, POS, *inputs)
    rows = add_windowed(
        daily,
        keys,
        [
            lambda f: {
                "sma200": f.roll("avg", "close", 200),
                "_lr": F.log("close") - f.lag(F.log("close"), 1),
            },
            lambda f: {"rv": realized_vol(f, "_lr")},
        ],
        before=200,
        size=size,
    )
    min_obs = max(30, rank_window // 4)
    rows = add_ranks(
        rows,
        keys,
        {"rv_rank": ("rv", rank_window), "spread_rank": ("spread_bps", rank_window)},
        size=size,
        strict_min_obs={"rv_rank": min_obs, "spread_rank": min_obs},
    )
    rows = add_adx(rows, keys, size=size)
    liquidity = liquidity_label(t, F.col("spread_rank"), F.col("liq_zscore"), F.col("peg_dev_bps"))
    return rows.withColumns({"trend": trend_label(t), "vol": vol_label(t), "liquidity": liquidity}).select(
        *keys, POS, "ts", "close", "sma200", "adx", "rv", "rv_rank", "spread_rank", "trend", "vol", "liquidity"
    )


def history(labels: DataFrame, keys: Sequence[str], min_rows: int = MIN_HISTORY_ROWS) -> DataFrame:
    """Complete days of keys with enough history, as dt rows."""
    enough = labels.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") >= min_rows)
    return (
        labels.dropna(subset=["trend", "vol", "liquidity"])
        .join(enough, list(keys), "left_semi")
        .select(
            *keys,
            F.date_format(F.timestamp_millis("ts"), "yyyy-MM-dd").alias("dt"),
            "trend",
            "vol",
            "liquidity",
            F.lit(MODEL_VERSION).alias("model_version"),
        )
    )


def current(labels: DataFrame, keys: Sequence[str], min_rows: int = MIN_HISTORY_ROWS) -> DataFrame:
    """The last day per key; a key whose last day is incomplete gives no row."""
    last = latest(labels, keys, F.col(POS), ["ts", POS, "trend", "vol", "liquidity"])
    return (
        last.filter(F.col(POS) + 1 >= min_rows)
        .dropna(subset=["trend", "vol", "liquidity"])
        .select(
            *keys,
            F.date_format(F.timestamp_millis("ts"), "yyyy-MM-dd").alias("dt"),
            "trend",
            "vol",
            "liquidity",
            F.lit(MODEL_VERSION).alias("model_version"),
        )
    )
