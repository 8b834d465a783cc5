"""Set operations: merges, idempotent inserts, upserts and version flags.

A keyed merge is a union and one aggregate per key that keeps the winner; each task
reduces its rows first, so repeated keys never pile up in one place.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from barline.operators.series import add_windowed, latest

BATCH = "_batch"


def merge_keep_last(
    existing: DataFrame, incoming: DataFrame, keys: Sequence[str], order: Sequence[str] = ()
) -> DataFrame:
    """Union where the incoming row replaces the existing one of the same key.

    ``order`` ranks rows of one key inside a batch; the last wins.
    """
    both = existing.withColumn(BATCH, F.lit(0)).unionByName(incoming.withColumn(BATCH, F.lit(1)))
    rest = [c for c in existing.columns if c not in keys]
    return latest(both, keys, [F.col(BATCH), *[F.col(o) for o in order]], rest).select(*existing.columns)


def insert_new(existing: DataFrame, incoming: DataFrame, key: str, order: Sequence[str]) -> DataFrame:
    """Rows to append: the first row per unused key of the incoming batch."""
    fresh = incoming.join(existing.select(key).distinct(), key, "left_anti")
    rest = [c for c in incoming.columns if c != key]
    picked = fresh.groupBy(key).agg(F.min_by(F.struct(*rest), F.struct(*order)).alias("_r"))
    return picked.select(key, *[F.col(f"_r.{c}").alias(c) for c in rest]).select(*incoming.columns)


def insert_counts(existing: DataFrame, incoming: DataFrame, key: str) -> DataFrame:
    """One row: written and skipped, as ``insert_new`` would do."""
    fresh = incoming.join(existing.select(key).distinct(), key, "left_anti").select(key).distinct()
    sides = fresh.agg(F.count(F.lit(1)).alias("written"), F.lit(0).cast("bigint").alias("total")).unionByName(
        incoming.agg(F.lit(0).cast("bigint").alias("written"), F.count(F.lit(1)).alias("total"))
    )
    return sides.agg(F.sum("written").alias("written"), (F.sum("total") - F.sum("written")).alias("skipped"))


def upsert_columns(
    existing: DataFrame, incoming: DataFrame, keys: Sequence[str], replace: Sequence[str]
) -> DataFrame:
    """Upsert that touches only ``replace``; other columns keep the stored value.

    A new key takes every column from the incoming row.
    """
    rest = [c for c in existing.columns if c not in keys]
    a = existing.select(*keys, F.lit(True).alias("_old"), *[F.col(c).alias(f"_a_{c}") for c in rest])
    b = incoming.select(
        *keys, F.lit(True).alias("_new"), *[(F.col(c) if c in incoming.columns else F.lit(None)).alias(f"_b_{c}") for c in rest]
    )
    joined = a.join(b, list(keys), "full")

    def pick(c: str) -> Column:
        if c in replace:
            return F.when(F.col("_new"), F.col(f"_b_{c}")).otherwise(F.col(f"_a_{c}"))
        return F.when(F.col("_old"), F.col(f"_a_{c}")).otherwise(F.col(f"_b_{c}"))

    return joined.select(*keys, *[pick(c).cast(existing.schema[c].dataType).alias(c) for c in rest]).select(
        *existing.columns
    )


def add_counters(existing: DataFrame, incoming: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """Additive upsert: the counters of equal keys are summed."""
    return (
        existing.select(*keys, value).unionByName(incoming.select(*keys, value)).groupBy(*keys).agg(F.sum(value).alias(value))
    )


def drop_unchanged(indexed: DataFrame, keys: Sequence[str], value: str, size: int | None = None) -> DataFrame:
    """Keep the first row of each run of equal values along ``pos``."""

    def cols(f):
        prev = f.lag(F.struct(value), 1)
        return {"_same": F.coalesce(prev[value].eqNullSafe(F.col(value)) & prev.isNotNull(), F.lit(False))}

    return add_windowed(indexed, keys, cols, before=1, size=size).filter(~F.col("_same")).drop("_same")


def latest_board(df: DataFrame, key: str, updated_at: str, cols: Sequence[str], tiebreak: str | None = None) -> DataFrame:
    """One row per key: the last written value."""
    order = [F.col(updated_at)] + ([F.col(tiebreak)] if tiebreak else [])
    return latest(df, [key], order, [updated_at, *cols])


def flag_current(versions: DataFrame, key: str, order: Sequence[str]) -> DataFrame:
    """Add ``is_current``: 1 on the newest version of a key, else 0.

    The newest version per key is an aggregate joined back; versions are not sorted.
    """
    top = versions.groupBy(key).agg(F.max(F.struct(*order)).alias("_top"))
    return (
        versions.join(top, key)
        .withColumn("is_current", F.when(F.struct(*order) == F.col("_top"), 1).otherwise(0).cast("bigint"))
        .drop("_top")
    )


def canonical_pair(a: str, b: str) -> tuple[Column, Column]:
    """(smaller, larger) of an unordered pair."""
    return F.least(a, b), F.greatest(a, b)


def top_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[Column], k: int) -> DataFrame:
    """First k rows per key; Spark cuts each task to k rows per key before the shuffle."""
    rank = F.row_number().over(W.partitionBy(*keys).orderBy(*order))
    return df.withColumn("_rk", rank).filter(F.col("_rk") <= k).drop("_rk")


def rows_at_max(df: DataFrame, keys: Sequence[str], order: str) -> DataFrame:
    """Every row that carries the key's greatest ``order`` (ties kept)."""
    top = df.groupBy(*keys).agg(F.max(order).alias("_top"))
    return df.join(top, list(keys)).filter(F.col(order) == F.col("_top")).drop("_top")


def keyset_page(df: DataFrame, row_id: str, after: int, limit: int) -> DataFrame:
    """The next page of rows by id."""
    return df.filter(F.col(row_id) > after).orderBy(row_id).limit(limit)
