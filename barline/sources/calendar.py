"""Static calendar of scheduled events."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from barline.functions.scalar import date_key_to_ms

# Decision days of the rate-setting meetings of 2026.
CALENDAR = [
    ("fomc", "2026-01-28"),
    ("fomc", "2026-03-18"),
    ("fomc", "2026-04-29"),
    ("fomc", "2026-06-17"),
    ("fomc", "2026-07-29"),
    ("fomc", "2026-09-16"),
    ("fomc", "2026-10-28"),
    ("fomc", "2026-12-09"),
]


def dedupe_key(event_type: Column, date: Column) -> Column:
    return F.concat_ws(":", event_type, date)


def to_events(entries: DataFrame, source: str = "econ_calendar") -> DataFrame:
    """(event_type, date) entries as event rows with their dedupe key."""
    return entries.select(
        "event_type",
        date_key_to_ms("date").alias("ts"),
        F.lit(source).alias("source_id"),
        dedupe_key(F.col("event_type"), F.col("date")).alias("dedupe_key"),
    )


def calendar_events(spark: SparkSession) -> DataFrame:
    return to_events(spark.createDataFrame(CALENDAR, "event_type string, date string"))
