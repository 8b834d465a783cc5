"""Ad-hoc filters, summaries and histograms over one dataset."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def where(df: DataFrame, condition: str | None) -> DataFrame:
    """Filter by SQL text; Catalyst pushes it into the scan."""
    return df.filter(F.expr(condition)) if condition and condition.strip() else df


def ts_range(df: DataFrame, start: int, end: int, ts: str = "ts") -> DataFrame:
    """Half-open [start, end)."""
    return df.filter((F.col(ts) >= start) & (F.col(ts) < end))


def date_range(df: DataFrame, start: str, end: str, dt: str = "dt") -> DataFrame:
    """Inclusive [start, end] on a date key."""
    return df.filter(F.col(dt).between(start, end))


def optional_filters(
    df: DataFrame, equals: dict[str, object | None], contains: tuple[str, str] | None = None
) -> DataFrame:
    """AND of the given conditions; absent ones are left out."""
    for name, value in equals.items():
        if value is not None:
            df = df.filter(F.col(name) == value)
    if contains and contains[1]:
        # matching ignores the case of ASCII letters, as LIKE does in the source store
        df = df.filter(F.lower(F.col(contains[0])).contains(contains[1].lower()))
    return df


def row_count(df: DataFrame, condition: str | None = None) -> DataFrame:
    return where(df, condition).agg(F.count(F.lit(1)).alias("n"))


def summary(df: DataFrame, column: str) -> DataFrame:
    """n, min, max, avg and sample stddev over the non-null values."""
    return df.filter(F.col(column).isNotNull()).agg(
        F.count(F.lit(1)).alias("n"),
        F.min(column).alias("mn"),
        F.max(column).alias("mx"),
        F.avg(column).alias("avg"),
        F.stddev_samp(column).alias("sd"),
    )


def histogram(df: DataFrame, column: str, buckets: int = 20) -> DataFrame:
    """Equal-width counts; a constant column falls into bucket 0.

    The bounds are a scalar subquery of the same plan, so no second pass is started
    from the driver and nothing is cross-joined.
    """
    rows = df.filter(F.col(column).isNotNull())
    bounds = rows.agg(F.struct(F.min(column).alias("lo"), F.max(column).alias("hi"))).scalar()
    rows = rows.select(F.col(column), bounds.alias("_bounds"))
    lo, hi = F.col("_bounds.lo"), F.col("_bounds.hi")
    slot = F.floor((F.col(column) - lo) / (hi - lo) * buckets)
    bucket = F.when(hi == lo, F.lit(0)).otherwise(F.least(F.lit(buckets - 1), slot)).cast("bigint")
    return rows.groupBy(bucket.alias("bucket")).agg(F.count(F.lit(1)).alias("c"))
