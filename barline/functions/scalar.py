"""Scalar functions over time keys, horizons, returns and identifiers."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# An epoch-ms timestamp above this (2100-01-01) can only be microseconds.
MAX_PLAUSIBLE_MS = 4_102_444_800_000
UNIT_MS = {"m": 60_000, "h": 3_600_000, "d": 86_400_000}
HORIZON_PATTERN = r"^(\d+)(m|h|d)$"
# Fixed value: two-sided 95 % normal quantile.
Z95 = 1.959963984540054


def _c(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def ms(ts: Column | str) -> Column:
    """Epoch milliseconds of a timestamp (with or without zone; session zone is UTC)."""
    return F.unix_millis(_c(ts).cast("timestamp"))


def date_key(ts_ms: Column | str) -> Column:
    return F.date_format(F.timestamp_millis(_c(ts_ms)), "yyyy-MM-dd")


def date_key_to_ms(key: Column | str) -> Column:
    return F.unix_millis(F.to_timestamp(_c(key), "yyyy-MM-dd"))


def utc_hour(ts_ms: Column | str) -> Column:
    return F.hour(F.timestamp_millis(_c(ts_ms)))


def utc_dow(ts_ms: Column | str) -> Column:
    """Day of week, Sunday = 0 .. Saturday = 6."""
    return F.dayofweek(F.timestamp_millis(_c(ts_ms))) - 1


def utc_year(ts_ms: Column | str) -> Column:
    return F.year(F.timestamp_millis(_c(ts_ms)))


def floor_to(ts_ms: Column | str, interval_ms: int) -> Column:
    return _c(ts_ms) - F.pmod(_c(ts_ms), F.lit(interval_ms))


def add_days(ts_ms: Column | str, days: int) -> Column:
    return _c(ts_ms) + F.lit(days * UNIT_MS["d"])


def normalize_ms(ts: Column | str) -> Column:
    """Bring microsecond timestamps down to milliseconds; NULL stays NULL."""
    col = _c(ts).cast("bigint")
    return F.when(col > F.lit(MAX_PLAUSIBLE_MS), F.floor(col / F.lit(1000)).cast("bigint")).otherwise(col)


def horizon_ms(text: Column | str) -> Column:
    """'30m' / '72h' / '7d' to milliseconds; any other form gives NULL."""
    t = F.trim(_c(text))
    unit = F.regexp_extract(t, HORIZON_PATTERN, 2)
    factor = F.when(unit == "m", UNIT_MS["m"]).when(unit == "h", UNIT_MS["h"]).when(unit == "d", UNIT_MS["d"])
    return F.regexp_extract(t, HORIZON_PATTERN, 1).try_cast("bigint") * factor


def horizon_bars(text: Column | str, bar_ms: int) -> Column:
    """Horizon in bars, rounded up, at least one."""
    return F.greatest(F.ceil(horizon_ms(text) / F.lit(bar_ms)).cast("bigint"), F.lit(1).cast("bigint"))


def parse_horizon_ms(text: str) -> int:
    m = re.match(HORIZON_PATTERN, text.strip())
    if not m:
        raise ValueError(f"unsupported horizon format: {text!r}")
    return int(m.group(1)) * UNIT_MS[m.group(2)]


def parse_horizon_bars(text: str, bar_ms: int) -> int:
    return max(1, -(-parse_horizon_ms(text) // bar_ms))


def ret_bps(direction: Column | str, entry: Column, exit_: Column) -> Column:
    """Return in basis points; NULL on a zero price or an unknown direction."""
    if isinstance(direction, str):
        if direction not in ("long", "short"):
            raise ValueError(f"direction {direction!r} is not supported")
        ratio = F.try_divide(exit_, entry) if direction == "long" else F.try_divide(entry, exit_)
        return (ratio - 1.0) * 10_000
    long_ = (F.try_divide(exit_, entry) - 1.0) * 10_000
    short = (F.try_divide(entry, exit_) - 1.0) * 10_000
    return F.when(direction == "long", long_).when(direction == "short", short)


def round_trip_bps(cost_json: Column | str) -> Column:
    """(taker + slippage) * 2 from a JSON cost model."""
    cm = F.from_json(
        _c(cost_json),
        T.StructType([T.StructField("taker_bps", T.DoubleType()), T.StructField("slippage_bps", T.DoubleType())]),
    )
    return (cm["taker_bps"] + cm["slippage_bps"]) * 2


def slug(title: Column | str) -> Column:
    s = F.regexp_replace(F.lower(_c(title)), "[^a-z0-9]+", "-")
    return F.regexp_replace(s, "(^-|-$)", "")


# Cadence by first matching part of the stream name.
CADENCE_MS = [
    ("candles_1m", 300_000),
    ("funding_rate", 300_000),
    ("okx_rest:open_interest", 300_000),
    ("long_short_ratio", 3_600_000),
    ("liquidations", 3_600_000),
    ("dvol", 3_600_000),
    ("cme_gap", 86_400_000),
    ("usdt_mint", 86_400_000),
    ("econ_calendar", 86_400_000),
    ("fear_greed", 86_400_000),
]
DEFAULT_CADENCE_MS = 86_400_000


def cadence_ms(stream_id: Column | str, table=CADENCE_MS, default: int = DEFAULT_CADENCE_MS) -> Column:
    out = None
    for needle, width in table:
        hit = _c(stream_id).contains(needle)
        out = F.when(hit, F.lit(width)) if out is None else out.when(hit, F.lit(width))
    return (F.lit(default) if out is None else out.otherwise(F.lit(default))).cast("bigint")


def source_id(stream_id: Column | str) -> Column:
    """Text before the first ':'."""
    return F.substring_index(_c(stream_id), ":", 1)


def bare_feature_name(feature_id: Column | str) -> Column:
    """Text after the first '.', empty when there is none."""
    c = _c(feature_id)
    at = F.instr(c, ".")
    return F.when(at > 0, F.substring(c, at + 1, F.length(c))).otherwise(F.lit(""))


def wilson_low(wins: Column, n: Column) -> Column:
    return _wilson(wins, n, -1.0)


def wilson_high(wins: Column, n: Column) -> Column:
    return _wilson(wins, n, 1.0)


def _wilson(wins: Column, n: Column, sign: float) -> Column:
    nd = n.cast("double")
    p = F.try_divide(wins.cast("double"), nd)
    z2 = Z95 * Z95
    centre = p + F.try_divide(F.lit(z2), 2 * nd)
    half = Z95 * F.sqrt(F.try_divide(p * (1 - p) + F.try_divide(F.lit(z2), 4 * nd), nd))
    bound = F.try_divide(centre + sign * half, 1 + F.try_divide(F.lit(z2), nd))
    return F.when(n == 0, F.lit(0.0)).otherwise(F.least(F.greatest(bound, F.lit(0.0)), F.lit(1.0)))


def regime_label(regime: Column | str) -> Column:
    """trend_vol_liquidity, 'unknown' for a missing regime."""
    r = _c(regime)
    return F.when(r.isNull(), F.lit("unknown")).otherwise(
        F.concat_ws("_", r["trend"], r["vol"], r["liquidity"])
    )


def numeric_columns(schema: T.StructType) -> list[str]:
    """Names of the numeric columns of a schema."""
    return [f.name for f in schema.fields if isinstance(f.dataType, T.NumericType)]


def nan_to_null(*names: str) -> dict[str, Column]:
    """withColumns mapping that turns NaN into NULL."""
    return {n: F.when(~F.isnan(n), F.col(n)) for n in names}
