"""Point-in-time joins onto a time grid."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barline.operators.bars import pivot_mean
from barline.operators.series import DAY_MS, HOUR_MS, POS, running, suggest_bucket_ms, time_bucket


@dataclass(frozen=True)
class Side:
    """A right side of an as-of join: its frame, the columns it gives and what orders
    rows of equal time (default: nothing)."""

    df: DataFrame
    columns: Sequence[str]
    tiebreak: str | None = None


def asof_join_many(
    left: DataFrame,
    sides: Sequence[Side],
    keys: Sequence[str],
    ts: str = "ts",
    bucket_ms: int | None = 24 * HOUR_MS,
) -> DataFrame:
    """Backward as-of join of several right sides at once: for each the last row with
    right.ts <= left.ts, per key.

    The last right row wins even when its value is NULL. All sides are merged into one
    series and the last row of each side is carried forward by one ``running`` pass, so
    a hot key is cut into time buckets and the left side is shuffled once however many
    sides there are. Without ``bucket_ms`` the width comes from how dense all sides are together,
    at the price of one aggregate over their keys and times.
    """
    keys = list(keys)
    kept = [c for c in left.columns if c not in keys and c != ts]
    payload = F.struct(F.lit(True).alias("_present"), *kept).alias("_left")
    rows = left.select(
        *keys, F.col(ts).alias("_ts"), F.lit(1).alias("_side"), F.lit(0).cast("bigint").alias("_tie"), payload
    )
    for i, side in enumerate(sides):
        tie = F.col(side.tiebreak).cast("bigint") if side.tiebreak else F.lit(0).cast("bigint")
        rows = rows.unionByName(
            side.df.select(
                *keys,
                F.col(ts).alias("_ts"),
                F.lit(0).alias("_side"),
                tie.alias("_tie"),
                F.struct(*side.columns).alias(f"_right{i}"),
            ),
            allowMissingColumns=True,
        )
    if bucket_ms is None:
        bucket_ms = suggest_bucket_ms(rows, keys, "_ts")
    merged = running(
        rows,
        keys,
        ["_ts", "_side", "_tie"],
        time_bucket("_ts", bucket_ms),
        {f"_hit{i}": ("last", F.col(f"_right{i}")) for i in range(len(sides))},
    )
    return merged.filter(F.col("_left").isNotNull()).select(
        *keys,
        F.col("_ts").alias(ts),
        *[F.col(f"_left.{c}").alias(c) for c in kept],
        *[F.col(f"_hit{i}.{c}").alias(c) for i, side in enumerate(sides) for c in side.columns],
    )


def asof_join(
    left: DataFrame,
    right: DataFrame,
    keys: Sequence[str],
    columns: Sequence[str],
    ts: str = "ts",
    tiebreak: str | None = None,
    bucket_ms: int | None = 24 * HOUR_MS,
) -> DataFrame:
    """``asof_join_many`` with one right side."""
    return asof_join_many(left, [Side(right, columns, tiebreak)], keys, ts, bucket_ms)


def fill_daily(
    bars: DataFrame,
    labels: DataFrame,
    keys: Sequence[str],
    columns: Sequence[str],
    ts: str = "ts",
    lag_days: int = 0,
) -> DataFrame:
    """Daily labels (``dt`` as yyyy-MM-dd) carried onto finer bars.

    A bar sees the label of its own date, else the latest earlier one. With
    ``lag_days`` = 1 the label of a day is seen from the next day on. ``keys`` may be
    empty when one label table serves every series. The carry runs over the distinct
    days of the bars, not over the bars.
    """
    keys = list(keys)
    day = F.floor(F.col(ts) / F.lit(DAY_MS)).cast("bigint") * DAY_MS
    marked = bars.withColumn("_day", day)
    shifted = F.unix_millis(F.to_timestamp("dt", "yyyy-MM-dd")) + F.lit(lag_days * DAY_MS)
    dated = labels.select(*keys, shifted.alias("_day"), *columns)
    days = marked.select(*keys, "_day").distinct()
    filled = asof_join(days, dated, keys, columns, "_day", bucket_ms=365 * DAY_MS)
    return marked.join(filled, [*keys, "_day"]).drop("_day")


def event_slots(
    events: DataFrame,
    interval_ms: int,
    types: Sequence[str] | None = None,
    ts: str = "ts",
    event_type: str = "event_type",
    magnitude: str = "magnitude",
    phases: Sequence[int] = (0,),
) -> DataFrame:
    """Events reduced to one row per (phase, slot, type): count and largest magnitude.

    A slot is an interval of a grid that starts ``phase`` ms after a multiple of the interval. A rule asks only
    whether some event of a type reaches a threshold, so the largest magnitude is all a bar has to carry,
    however many events it holds. A NULL magnitude counts as 0.
    """
    if types is not None:
        events = events.filter(F.col(event_type).isin(list(types)))
    phase = F.explode(F.array(*(F.lit(int(p)).cast("bigint") for p in phases)))
    events = events.withColumn("_phase", phase)
    return events.groupBy(
        F.col("_phase").alias("phase"),
        F.floor((F.col(ts) - F.col("_phase")) / F.lit(interval_ms)).cast("bigint").alias("slot"),
        F.col(event_type).alias("event_type"),
    ).agg(
        F.count(F.lit(1)).alias("n_events"),
        F.max(F.coalesce(F.col(magnitude).cast("double"), F.lit(0.0))).alias("max_magnitude"),
    )


def place_events(
    bars: DataFrame,
    keys: Sequence[str],
    events: DataFrame,
    interval_ms: int,
    types: Sequence[str],
    ts: str = "ts",
    event_type: str = "event_type",
    magnitude: str = "magnitude",
) -> DataFrame:
    """Add one column ``ev_<type>`` per type: the largest magnitude of the events that belong to a bar.

    ``bars`` are numbered rows (``index_rows``). An event belongs to the bar whose number is (event time -
    start of the series) // interval, as the rule language defines it; on a grid without gaps this is the bar
    that it falls into, wherever in the hour the series starts. Events carry no key and are placed on every
    series, once for each different start within the interval.
    """
    keys = list(keys)
    starts = bars.groupBy(*keys).agg(F.min(ts).alias("_start")).withColumnsRenamed({k: f"_k_{k}" for k in keys})
    phase = F.pmod(F.col("_start"), F.lit(interval_ms))
    starts = starts.withColumns({"_phase": phase, "_first": (F.col("_start") - phase) / F.lit(interval_ms)})
    phases = sorted(r[0] for r in starts.select("_phase").distinct().collect() if r[0] is not None) or [0]
    slots = event_slots(events, interval_ms, types, ts, event_type, magnitude, phases)
    wide = slots.groupBy(F.col("phase").alias("_phase"), F.col("slot").alias("_slot")).agg(
        *[F.max(F.when(F.col("event_type") == t, F.col("max_magnitude"))).alias(event_column(t)) for t in types]
    )
    same = reduce(and_, (bars[k].eqNullSafe(starts[f"_k_{k}"]) for k in keys))
    placed = bars.join(starts, same, "left").withColumn("_slot", F.col("_first").cast("bigint") + F.col(POS))
    columns = [bars[c] for c in bars.columns]
    return placed.join(wide, ["_phase", "_slot"], "left").select(*columns, *(event_column(t) for t in types))


def event_column(event_type: str) -> str:
    return f"ev_{event_type}"


def left_fill_zero(
    bars: DataFrame, right: DataFrame | None, on: Sequence[str], column: str
) -> DataFrame:
    """Left equi-join with missing rows as 0; with no right table at all, NULL."""
    if right is None:
        return bars.withColumn(column, F.lit(None).cast("double"))
    return bars.join(right.select(*on, column), list(on), "left").withColumn(
        column, F.coalesce(F.col(column), F.lit(0.0))
    )


def merge_slow_series(
    bars: DataFrame,
    keys: Sequence[str],
    funding: DataFrame | None = None,
    open_interest: DataFrame | None = None,
    ratios: DataFrame | None = None,
    liquidations_hourly: DataFrame | None = None,
) -> DataFrame:
    """Bars with funding, open interest, long/short ratios and hourly liquidations.

    A table that is not there yields NULL columns.
    """
    # Ratio types kept and the column each becomes.
    ratio_columns = {"top_trader_position": "ls_top_trader_position", "all_account": "ls_all_account"}
    sides, absent = [], []
    if funding is not None:
        sides.append(Side(funding.withColumnRenamed("rate", "funding_rate"), ["funding_rate"]))
    else:
        absent.append("funding_rate")
    if open_interest is not None:
        sides.append(Side(open_interest, ["oi_base"]))
    else:
        absent.append("oi_base")
    if ratios is not None:
        wide = pivot_mean(ratios, [*keys, "ts"], "ratio_type", "ls_ratio", ratio_columns)
        sides.append(Side(wide, list(ratio_columns.values())))
    else:
        absent += list(ratio_columns.values())
    out = asof_join_many(bars, sides, keys) if sides else bars
    out = out.withColumns({c: F.lit(None).cast("double") for c in absent})
    return left_fill_zero(out, liquidations_hourly, [*keys, "ts"], "liq_notional_1h")
