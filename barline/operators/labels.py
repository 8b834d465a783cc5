"""Forward-return labels and trades."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barline.functions.scalar import UNIT_MS, ret_bps
from barline.operators.series import add_windowed

MIN_SPAN_YEARS = 1.0 / 365.0
YEAR_MS = 365 * UNIT_MS["d"]


def forward_labels(
    indexed: DataFrame,
    keys: Sequence[str],
    delay: int,
    horizon: int,
    direction: str = "long",
    size: int | None = None,
) -> DataFrame:
    """Add entry_pos/ts, exit_pos/ts and ``fwd_bps`` of a trade opened at each bar.

    Entry is the open ``delay`` bars on, exit the close ``horizon`` bars after it;
    NULL where the series ends first.
    """
    if delay < 1:
        raise ValueError("delay must be at least one bar")

    def cols(f):
        return {
            "entry_pos": F.when(f.lead("ts", delay + horizon).isNotNull(), F.col("pos") + delay),
            "exit_pos": F.when(f.lead("ts", delay + horizon).isNotNull(), F.col("pos") + delay + horizon),
            "entry_ts": F.when(f.lead("ts", delay + horizon).isNotNull(), f.lead("ts", delay)),
            "exit_ts": f.lead("ts", delay + horizon),
            "fwd_bps": ret_bps(direction, f.lead("open", delay), f.lead("close", delay + horizon)),
        }

    return add_windowed(indexed, keys, cols, after=delay + horizon, size=size)


def trades(labelled_fires: DataFrame, cost_bps: float | Column) -> DataFrame:
    """Fired bars that have a label, with gross and net return in bps."""
    cost = F.lit(cost_bps) if isinstance(cost_bps, int | float) else cost_bps
    return (
        labelled_fires.filter(F.col("fwd_bps").isNotNull())
        .withColumnRenamed("fwd_bps", "ret_bps")
        .withColumn("ret_net_bps", F.col("ret_bps") - cost)
    )


def multi_horizon_labels(
    indexed: DataFrame, keys: Sequence[str], horizons: Sequence[int], delay: int = 1, size: int | None = None
) -> DataFrame:
    """Gross long labels fwd_ret_<h> for several horizons from one layout."""

    def cols(f):
        return {
            f"fwd_ret_{h}": ret_bps("long", f.lead("open", delay), f.lead("close", delay + h)) for h in horizons
        }

    return add_windowed(indexed, keys, cols, after=delay + max(horizons), size=size)


def trades_per_year(n: Column, first_entry: Column, last_entry: Column) -> Column:
    """Trades per year from the entry span (at least a day); 252 under two trades."""
    span = F.greatest((last_entry - first_entry) / F.lit(float(YEAR_MS)), F.lit(MIN_SPAN_YEARS))
    return F.when(n < 2, F.lit(252.0)).otherwise(n / span)
