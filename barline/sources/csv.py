"""Landed CSV archives: klines, funding, metrics and liquidation fills.

Files are headerless, some carry an inline header row; every column is read as text
with a fixed schema, the header row is filtered, and values are cast row by row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from barline.functions.scalar import normalize_ms
from barline.operators.bars import fill_notional
from barline.operators.series import HOUR_MS

# Column orders of the archives.
KLINE_COLUMNS = [
    "open_time",
    "open",
    "high",
    "low",
    "close",
    "volume",
    "close_time",
    "quote_asset_volume",
    "number_of_trades",
    "taker_buy_base_asset_volume",
    "taker_buy_quote_asset_volume",
    "ignore",
]
FUNDING_COLUMNS = ["calc_time", "funding_interval_hours", "last_funding_rate"]
METRICS_COLUMNS = [
    "create_time",
    "symbol",
    "sum_open_interest",
    "sum_open_interest_value",
    "count_toptrader_long_short_ratio",
    "sum_toptrader_long_short_ratio",
    "count_long_short_ratio",
    "sum_taker_long_short_vol_ratio",
]
LIQUIDATION_COLUMNS = [
    "time",
    "symbol",
    "side",
    "order_type",
    "time_in_force",
    "original_quantity",
    "price",
    "average_price",
    "order_status",
    "last_fill_quantity",
    "accumulated_fill_quantity",
]
RATIO_COLUMNS = {
    "top_trader_position": "sum_toptrader_long_short_ratio",
    "all_account": "count_long_short_ratio",
    "taker_volume": "sum_taker_long_short_vol_ratio",
}


def read_raw(spark: SparkSession, path: str | list[str], columns: list[str]) -> DataFrame:
    """All-text scan with a fixed schema, without the inline header row."""
    schema = T.StructType([T.StructField(c, T.StringType()) for c in columns])
    raw = spark.read.schema(schema).csv(path)
    first = F.lower(F.trim(columns[0]))
    return raw.filter(F.coalesce(first, F.lit("")) != columns[0])


def number(name: str) -> Column:
    return F.col(name).try_cast("double")


def whole(name: str) -> Column:
    return F.col(name).try_cast("bigint")


def candles(raw: DataFrame, instrument_id: str | Column, tf: str) -> DataFrame:
    """Kline rows to the candle layout."""
    instrument = F.lit(instrument_id) if isinstance(instrument_id, str) else instrument_id
    return raw.select(
        instrument.alias("instrument_id"),
        F.lit(tf).alias("tf"),
        normalize_ms(whole("open_time")).alias("ts"),
        number("open").alias("open"),
        number("high").alias("high"),
        number("low").alias("low"),
        number("close").alias("close"),
        number("volume").alias("volume"),
        number("quote_asset_volume").alias("quote_volume"),
        number("taker_buy_base_asset_volume").alias("taker_buy_volume"),
        whole("number_of_trades").alias("trades"),
    )


def funding(raw: DataFrame, instrument_id: str) -> DataFrame:
    return raw.select(
        F.lit(instrument_id).alias("instrument_id"),
        normalize_ms(whole("calc_time")).alias("ts"),
        number("last_funding_rate").alias("rate"),
    )


def mixed_time(name: str) -> Column:
    """Epoch (ms or us) or 'yyyy-MM-dd HH:mm:ss', decided row by row."""
    text = F.try_to_timestamp(F.col(name), F.lit("yyyy-MM-dd HH:mm:ss"))
    return F.coalesce(normalize_ms(whole(name)), F.unix_millis(text))


def metrics(raw: DataFrame, instrument_id: str | Column) -> DataFrame:
    """Metrics rows with ``ts`` and numeric columns."""
    instrument = F.lit(instrument_id) if isinstance(instrument_id, str) else instrument_id
    return raw.select(
        instrument.alias("instrument_id"),
        mixed_time("create_time").alias("ts"),
        *[number(c).alias(c) for c in METRICS_COLUMNS[2:]],
    )


def on_the_hour(df: DataFrame) -> DataFrame:
    return df.filter(F.col("ts") % HOUR_MS == 0)


def open_interest(metric_rows: DataFrame) -> DataFrame:
    return on_the_hour(metric_rows).select(
        "instrument_id",
        "ts",
        F.col("sum_open_interest").alias("oi_base"),
        F.col("sum_open_interest_value").alias("oi_usd"),
    )


def long_short_ratios(metric_rows: DataFrame) -> DataFrame:
    """Three ratio columns to rows; NULL and negative ratios are dropped."""
    hourly = on_the_hour(metric_rows).select(
        "instrument_id", "ts", *[F.col(src).alias(kind) for kind, src in RATIO_COLUMNS.items()]
    )
    long = hourly.unpivot(["instrument_id", "ts"], list(RATIO_COLUMNS), "ratio_type", "ls_ratio")
    r = F.col("ls_ratio")
    return long.filter(r >= 0).select(
        "instrument_id",
        "ratio_type",
        "ts",
        (r / (1.0 + r)).alias("long_ratio"),
        (1.0 / (1.0 + r)).alias("short_ratio"),
        r,
    )


def liquidation_fills(raw: DataFrame, instrument_id: str) -> DataFrame:
    """Fill rows with side and notional, ready for ``bars.side_buckets``."""
    return raw.select(
        F.lit(instrument_id).alias("instrument_id"),
        normalize_ms(whole("time")).alias("ts"),
        "side",
        fill_notional(
            number("average_price"), number("last_fill_quantity"), number("price"), number("original_quantity")
        ).alias("notional"),
    )
