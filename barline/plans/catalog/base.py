"""Shared inputs of the query catalogue: derived tables and their SQL twins.

Stand-in mapping onto the given tables: hourly bars per event type from ``events``,
daily bars per order priority from ``orders``, ledger rows from ``customer``,
``orders`` and ``lineitem``.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from barline.functions.scalar import ms
from barline.operators.bars import ohlcv
from barline.operators.series import DAY_MS, HOUR_MS, index_rows, time_bucket

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register a query, with the SQL any engine can check it by."""

    def add(fn: Query) -> Query:
        if name in QUERIES:
            raise ValueError(f"duplicate query {name}")
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return add


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def rnd(col: Column | str, digits: int = 6) -> Column:
    """Rounded at the query edge, since float sums differ by partition order."""
    return F.round(F.col(col) if isinstance(col, str) else col, digits) + F.lit(0.0)


def rnd_many(col: Column | str, digits: int = 6) -> Column:
    """The same as ``rnd`` for results of very many rows: only what lies near a tie, or is large, is rounded as a decimal.

    Elsewhere the nearest whole number of units is the same, and dividing it by a power of ten gives the nearest double.
    """
    x = F.col(col) if isinstance(col, str) else col
    units = x * F.lit(10.0**digits)
    plain = (F.abs(units) < 1e9) & (F.abs(units - F.rint(units)) < 0.4999)
    return F.when(plain, F.rint(units) / F.lit(10.0**digits)).otherwise(F.round(x, digits)) + F.lit(0.0)


def rounded(df: DataFrame, *names: str, digits: int = 6) -> DataFrame:
    return df.withColumns({n: rnd(n, digits) for n in names})


def R(expr: str, digits: int = 6) -> str:
    """SQL twin of ``rnd``."""
    return f"(round(CAST({expr} AS DOUBLE), {digits}) + 0.0)"


# ------------------------------------------------------------------ derived tables


def events_ms(spark: SparkSession, sf: str) -> DataFrame:
    """events with epoch-ms ts; instrument_id = event type."""
    return table(spark, sf, "events").select(
        "event_id",
        F.col("event_type").alias("instrument_id"),
        ms("ts").alias("ts"),
        "user_id",
        "value",
        "props",
    )


def hourly(spark: SparkSession, sf: str) -> DataFrame:
    """Hourly bars per event type."""
    return ohlcv(
        events_ms(spark, sf), ["instrument_id"], HOUR_MS, price="value", size="value", tiebreak="event_id"
    )


def daily(spark: SparkSession, sf: str) -> DataFrame:
    """Daily bars per order priority."""
    orders = table(spark, sf, "orders").select(
        "o_orderkey",
        F.col("o_orderpriority").alias("instrument_id"),
        ms("o_orderdate").alias("ts"),
        F.col("o_totalprice").alias("value"),
    )
    return ohlcv(orders, ["instrument_id"], DAY_MS, price="value", size="value", tiebreak="o_orderkey")


def hourly_ix(spark: SparkSession, sf: str) -> DataFrame:
    return index_rows(hourly(spark, sf), ["instrument_id"], "ts", time_bucket("ts", 365 * DAY_MS))


def daily_ix(spark: SparkSession, sf: str) -> DataFrame:
    return index_rows(daily(spark, sf), ["instrument_id"], "ts", time_bucket("ts", 3650 * DAY_MS))


EV_CTE = """
ev AS (SELECT event_id, event_type AS instrument_id, epoch_us(ts) // 1000 AS ts, user_id, value, props FROM events)
"""
HOURLY_CTE = EV_CTE + """,
hourly AS (
  SELECT instrument_id, ts // 3600000 * 3600000 AS ts, arg_min(value, (ts, event_id)) AS open, max(value) AS high,
         min(value) AS low, arg_max(value, (ts, event_id)) AS close, sum(value) AS volume,
         CAST(count(*) AS BIGINT) AS trades
  FROM ev GROUP BY 1, 2),
hx AS (SELECT *, CAST(row_number() OVER (PARTITION BY instrument_id ORDER BY ts) - 1 AS BIGINT) AS pos FROM hourly)
"""
DAILY_CTE = """
od AS (SELECT o_orderkey, o_orderpriority AS instrument_id, epoch_us(o_orderdate) // 1000 AS ts, o_totalprice AS value
       FROM orders),
daily AS (
  SELECT instrument_id, ts // 86400000 * 86400000 AS ts, arg_min(value, (ts, o_orderkey)) AS open, max(value) AS high,
         min(value) AS low, arg_max(value, (ts, o_orderkey)) AS close, sum(value) AS volume,
         CAST(count(*) AS BIGINT) AS trades
  FROM od GROUP BY 1, 2),
dx AS (SELECT *, CAST(row_number() OVER (PARTITION BY instrument_id ORDER BY ts) - 1 AS BIGINT) AS pos FROM daily)
"""
