"""Anchored walk-forward folds by wall clock, with purge and embargo."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

DEFAULT_EMBARGO_MS = 5 * 86_400_000


def fold_spans(trades: DataFrame, group: Sequence[str], n_folds: int, capped: bool = True) -> DataFrame:
    """start, block width and fold count per group.

    With ``capped`` a group with too few trades gets fewer folds, else none. No span
    or no fold gives folds = 0.
    """
    span = trades.groupBy(*group).agg(
        F.count(F.lit(1)).alias("_n"), F.min("entry_ts").alias("_start"), F.max("exit_ts").alias("_end")
    )
    want = F.least(F.lit(n_folds).cast("bigint"), F.col("_n") - 1) if capped else F.lit(n_folds).cast("bigint")
    ok = (F.col("_n") >= want + 1) & (want >= 1) & (F.col("_end") > F.col("_start"))
    folds = F.when(ok, want).otherwise(F.lit(0).cast("bigint"))
    return (
        span.withColumn("_folds", folds)
        .withColumn("_width", F.when(folds > 0, (F.col("_end") - F.col("_start")) / (folds + 1)))
        .drop("_n")
    )


def _block_of(ts: Column) -> Column:
    """Number of the equal-width block that holds ts, by the block's own bounds."""
    start, width = F.col("_start"), F.col("_width")
    i = F.floor((ts - start) / width).cast("bigint")
    return (
        i
        + F.when(ts >= start + (i + 1) * width, F.lit(1)).otherwise(F.lit(0))
        - F.when(ts < start + i * width, F.lit(1)).otherwise(F.lit(0))
    )


def assign_test_fold(trades: DataFrame, group: Sequence[str], n_folds: int, capped: bool = True) -> DataFrame:
    """Add ``fold`` (1..n, NULL for the train-only block) and ``folds``.

    Found by arithmetic from the group's span; no join per fold.
    """
    spans = fold_spans(trades, group, n_folds, capped)
    block = F.least(_block_of(F.col("entry_ts")), F.col("_folds"))
    fold = F.when((F.col("_folds") > 0) & (block >= 1), block)
    return (
        trades.join(spans, list(group))
        .withColumn("fold", fold)
        .withColumnRenamed("_folds", "folds")
        .drop("_start", "_end", "_width")
    )


def fold_roles(
    trades: DataFrame,
    group: Sequence[str],
    n_folds: int = 5,
    embargo_ms: int = DEFAULT_EMBARGO_MS,
    capped: bool = True,
) -> DataFrame:
    """One row per (trade, fold, role) with role train or test.

    A trade trains fold f when it exits by the fold's test start less the embargo,
    hence in every later fold too; trades in the gap are in neither.
    """
    spans = fold_spans(trades, group, n_folds, capped)
    start, width, folds = F.col("_start"), F.col("_width"), F.col("_folds")
    rows = trades.join(spans, list(group)).filter(folds > 0)
    block = F.least(_block_of(F.col("entry_ts")), folds)
    test = rows.filter(block >= 1).withColumn("fold", block).withColumn("role", F.lit("test"))
    train = (
        rows.withColumn("fold", F.explode(F.sequence(F.lit(1).cast("bigint"), folds)))
        .filter(F.col("exit_ts") <= start + F.col("fold") * width - F.lit(embargo_ms))
        .withColumn("role", F.lit("train"))
    )
    return test.unionByName(train).drop("_start", "_end", "_width", "_folds")


def fold_stats(assigned: DataFrame, group: Sequence[str], ret: str = "ret_net_bps") -> DataFrame:
    """Mean return and trades per fold; an empty fold counts as mean 0."""
    group = list(group)
    found = (
        assigned.filter(F.col("fold").isNotNull())
        .groupBy(*group, "fold")
        .agg(F.avg(ret).alias("ev_bps"), F.count(F.lit(1)).alias("trades"))
    )
    every = (
        assigned.groupBy(*group)
        .agg(F.max("folds").alias("_k"))
        .filter(F.col("_k") > 0)
        .select(*group, F.explode(F.sequence(F.lit(1).cast("bigint"), F.col("_k"))).alias("fold"))
    )
    return every.join(found, [*group, "fold"], "left").withColumns(
        {"ev_bps": F.coalesce("ev_bps", F.lit(0.0)), "trades": F.coalesce("trades", F.lit(0).cast("bigint"))}
    )


def fold_consistency(stats: DataFrame, group: Sequence[str]) -> DataFrame:
    """Share of folds with a positive mean."""
    return stats.groupBy(*group).agg(
        F.avg(F.when(F.col("ev_bps") > 0, 1.0).otherwise(0.0)).alias("fold_consistency")
    )
