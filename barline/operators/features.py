"""Trailing-window features and their registry.

Common rule: frame = the last ``w`` rows including the current one, NULL until the
frame holds ``w`` non-null values. Nothing looks forward.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from barline.operators.series import BLK, BLOCK_ROWS, CORE, POS, Frames, apply_step, blocks, core_rows


def _c(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def chg(f: Frames, x, w: int) -> Column:
    return _c(x) - f.lag(x, w)


def pctchg(f: Frames, x, w: int) -> Column:
    return (F.try_divide(_c(x), f.lag(x, w)) - 1.0) * 100.0


def z(f: Frames, x, w: int) -> Column:
    sd = f.roll("std_pop", x, w)
    return F.when(sd > 0, (_c(x) - f.roll("avg", x, w)) / sd)


def ma_ratio(f: Frames, x, short: int, long: int) -> Column:
    return F.try_divide(f.roll("avg", x, short), f.roll("avg", x, long))


def log_return(f: Frames, close) -> Column:
    return F.log(F.try_divide(_c(close), f.lag(close, 1)))


def std_of_log_return(f: Frames, log_ret: str, w: int) -> Column:
    """Realized volatility from a log-return column, population form."""
    return f.roll("std_pop", log_ret, w)


def true_range(f: Frames, high, low, close) -> Column:
    prev = f.lag(close, 1)
    return F.greatest(_c(high) - _c(low), F.abs(_c(high) - prev), F.abs(_c(low) - prev))


def atr_of(f: Frames, tr: str, w: int) -> Column:
    return f.roll("avg", tr, w)


def sma_dist_pct(f: Frames, close, w: int) -> Column:
    sma = f.roll("avg", close, w)
    return F.try_divide(_c(close) - sma, sma) * 100.0


def rolling_high_dist(f: Frames, high, close, w: int) -> Column:
    top = f.roll("max", high, w)
    return F.try_divide(_c(close) - top, top) * 100.0


def rolling_ratio(f: Frames, num, den, w: int) -> Column:
    return F.try_divide(f.roll("sum", num, w), f.roll("sum", den, w))


def rolling_sum(f: Frames, x, w: int) -> Column:
    return f.roll("sum", x, w)


def pctile_expr(f: Frames, x, w: int) -> Column:
    """Share (0-100) of the frame that is <= the current value; for short frames."""
    frame = F.collect_list(x).over(f.rows(w))
    at_most = F.size(F.filter(frame, lambda v: v <= _c(x)))
    return F.when(F.count(x).over(f.rows(w)) == w, at_most / F.lit(w) * 100.0)


def _count_below(codes: np.ndarray, bits: int, lo: np.ndarray, hi: np.ndarray, bound: np.ndarray) -> np.ndarray:
    """How many of codes[lo:hi] are below ``bound``, for each query.

    A wavelet matrix: level by level, from the highest bit down, codes are split into those with a 0 and those with
    a 1, and each query follows its bound. All queries take one step a level, so n of them cost n log n.
    """
    below = np.zeros(len(lo), np.int64)
    for level in range(bits - 1, -1, -1):
        one = (codes >> level) & 1
        zeros = np.concatenate([[0], np.cumsum(one == 0)])
        lo0, hi0 = zeros[lo], zeros[hi]
        up = (bound >> level) & 1 == 1
        below += np.where(up, hi0 - lo0, 0)
        lo = np.where(up, zeros[-1] + lo - lo0, lo0)
        hi = np.where(up, zeros[-1] + hi - hi0, hi0)
        codes = np.concatenate([codes[one == 0], codes[one == 1]])
    return below


def _frame_counts(values: np.ndarray, w: int, inclusive: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of the last w rows (fewer at the start): rows, values, and values below (or up to) the current one."""
    n = len(values)
    missing = np.isnan(values)
    distinct, codes = np.unique(values[~missing], return_inverse=True)
    code = np.full(n, len(distinct), np.int64)  # what is missing is above every value
    code[~missing] = codes
    hi = np.arange(1, n + 1)
    lo = np.maximum(hi - w, 0)
    seen = np.concatenate([[0], np.cumsum(~missing)])
    bound = np.minimum(code + inclusive, len(distinct))
    return hi - lo, seen[hi] - seen[lo], _count_below(code, len(distinct).bit_length(), lo, hi, bound)


def _inclusive_rank(values: np.ndarray, w: int) -> np.ndarray:
    """100 * share of the last w values that are <= the current; NaN unless all present."""
    _, seen, below = _frame_counts(values, w, True)
    return np.where(seen == w, below / w * 100.0, np.nan)


def _strict_rank(values: np.ndarray, w: int, min_obs: int) -> np.ndarray:
    """Share of rows in the (possibly short) frame that are < the current value.

    NaN unless the frame holds min_obs values; missing rows count in the divisor. A missing current value
    is below nothing and has no values below it.
    """
    rows, seen, below = _frame_counts(values, w, False)
    return np.where(seen >= min_obs, np.where(np.isnan(values), 0, below) / rows, np.nan)


def _dealt(blocked: DataFrame, keys: Sequence[str], tasks: int | None) -> DataFrame:
    """Blocks over so many tasks, or as many as the session shuffles into."""
    return blocked if tasks is None else blocked.repartition(tasks, *keys, BLK)


def add_ranks(
    df: DataFrame,
    keys: Sequence[str],
    ranks: dict[str, tuple[str, int]],
    size: int | None = None,
    strict_min_obs: dict[str, int] | None = None,
    tasks: int | None = None,
) -> DataFrame:
    """Add trailing percentile ranks {out: (column, window)} to an indexed frame.

    Long windows (a year of hours) would need one list per row; instead each block
    goes with its halo to one Arrow batch and is ranked there in n log n, whatever the
    window. Outputs named in ``strict_min_obs`` use the strict, short-frame form.
    """
    strict = strict_min_obs or {}
    halo = max(w for _, w in ranks.values()) - 1
    parts = _dealt(blocks(df, before=halo, size=size), keys, tasks)
    schema = T.StructType([*parts.schema.fields, *[T.StructField(o, T.DoubleType()) for o in ranks]])

    def rank_block(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(POS, ignore_index=True)
        first = int(pdf[POS].iloc[0]) if len(pdf) else 0
        for out, (col, w) in ranks.items():
            values = pdf[col].to_numpy(dtype=float, na_value=np.nan)
            if out in strict:
                # the short frame exists only at the start of the series
                res = _strict_rank(values, w, strict[out])
                if first > 0:
                    res[: w - 1] = np.nan
                pdf[out] = res
            else:
                pdf[out] = _inclusive_rank(values, w)
        return pdf

    return core_rows(parts.groupBy(*keys, BLK).applyInPandas(rank_block, schema))


def _ewm_part(x: np.ndarray, decay: float) -> tuple[int, int, float, int, float, float]:
    """A block as a step of a recursive mean: rows, values, the first value, missing rows before it and after the
    last one, and (a, b) so that y at the end is a * y(first value) + b."""
    at = np.flatnonzero(~np.isnan(x))
    if not len(at):
        return len(x), 0, np.nan, len(x), np.nan, np.nan
    kept = decay ** np.diff(at).astype(float)
    kept = kept / (kept + 1.0 - decay)
    # y after each value, as a function of y at the first one
    rest = pd.Series(np.append(0.0, x[at[0] + 1 :])).ewm(alpha=1.0 - decay, adjust=False).mean()
    return int(at[0]), len(at), float(x[at[0]]), len(x) - 1 - int(at[-1]), float(np.prod(kept)), float(rest.iloc[-1])


def _enter(y: float, gap: int, x: float, lead: int, decay: float) -> float:
    """y at the first value x of a block, ``gap`` + ``lead`` missing rows after y; x itself if there was no y."""
    if np.isnan(y):
        return x
    kept = decay ** (gap + lead + 1)
    return (kept * y + (1.0 - decay) * x) / (kept + 1.0 - decay)


def add_ewm(
    df: DataFrame,
    keys: Sequence[str],
    columns: dict[str, str],
    alpha: float,
    min_periods: int = 1,
    size: int | None = None,
) -> DataFrame:
    """Add recursive means y = (1 - alpha) y + alpha x seeded with the first value.

    A missing value leaves y as it is and lets its weight fall by 1 - alpha; y is null until ``min_periods`` values
    were seen. Blocks are affine steps: each is summed up by (a, b) of y(end) = a y(first value) + b and by the
    missing rows around its values; the steps are chained over the blocks of a key, one row per block, and each
    block then starts from the y, the gap and the count that reach it. No block needs rows of another.
    """
    keys, names, decay = list(keys), list(columns), 1.0 - alpha
    parts = blocks(df, size=size)
    source = list(dict.fromkeys(columns.values()))

    def values(pdf: pd.DataFrame, col: str) -> np.ndarray:
        return pdf[col].to_numpy(dtype=float, na_value=np.nan, copy=True)

    fields = ("_lead", "_n", "_x", "_tail", "_a", "_b")

    def summary(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(POS)
        rows = [(c, *_ewm_part(values(pdf, c), decay)) for c in source]
        out = pd.DataFrame(rows, columns=["_column", *fields])
        return out.assign(**{BLK: pdf[BLK].iloc[0]}, **{k: [pdf[k].iloc[0]] * len(out) for k in keys})

    def chain(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(BLK, ignore_index=True)
        y, gap, seen, carried = np.nan, 0, 0, []
        for r in pdf[list(fields)].itertuples(index=False):
            lead, n, x, tail, a, b = r
            carried.append((y, gap, seen))
            if n:
                y, gap, seen = a * _enter(y, gap, x, int(lead), decay) + b, int(tail), seen + int(n)
            else:
                gap += int(lead)
        into = pd.DataFrame(carried, columns=["_y", "_gap", "_seen"])
        return pd.concat([pdf[[*keys, BLK, "_column"]], into], axis=1)

    def finish(pdf: pd.DataFrame, carry: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(POS, ignore_index=True)
        into = {r["_column"]: r for r in carry.to_dict("records")}
        for out, col in columns.items():
            x, c = values(pdf, col), into[col]
            before = np.nan if c["_y"] is None else c["_y"]
            at = np.flatnonzero(~np.isnan(x))
            seen = c["_seen"] + np.cumsum(~np.isnan(x))
            y = np.full(len(x), before)
            if len(at):
                x[at[0]] = _enter(before, c["_gap"], x[at[0]], int(at[0]), decay)
                y[at[0] :] = pd.Series(x[at[0] :]).ewm(alpha=alpha, adjust=False).mean()
            pdf[out] = np.where(seen >= min_periods, y, np.nan)
        return pdf

    def typed(*more: T.StructField) -> T.StructType:
        return T.StructType([*[parts.schema[k] for k in keys], parts.schema[BLK], T.StructField("_column", T.StringType()), *more])

    long, double = T.LongType(), T.DoubleType()
    kinds = (long, long, double, long, double, double)
    steps = parts.select(*keys, POS, BLK, *[c for c in source if c not in (*keys, POS)]).groupBy(*keys, BLK)
    steps = steps.applyInPandas(summary, typed(*[T.StructField(f, k) for f, k in zip(fields, kinds)]))
    carry = steps.groupBy(*keys, "_column").applyInPandas(
        chain, typed(T.StructField("_y", double), T.StructField("_gap", long), T.StructField("_seen", long))
    )
    schema = T.StructType([*parts.schema.fields, *[T.StructField(o, double) for o in names]])
    done = parts.groupBy(*keys, BLK).cogroup(carry.groupBy(*keys, BLK)).applyInPandas(finish, schema)
    return core_rows(done)


def add_arrow(
    df: DataFrame,
    keys: Sequence[str],
    functions: dict[str, Callable[[pd.DataFrame], pd.Series]],
    halo: int,
    size: int | None = None,
) -> DataFrame:
    """Add columns computed by a function over each block with its halo."""
    parts = blocks(df, before=halo, size=size)
    schema = T.StructType([*parts.schema.fields, *[T.StructField(o, T.DoubleType()) for o in functions]])

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(POS, ignore_index=True)
        made = {out: fn(pdf).astype(float) for out, fn in functions.items()}
        return pdf.assign(**made)

    return core_rows(parts.groupBy(*keys, BLK).applyInPandas(run, schema))


# --------------------------------------------------------------------------- registry

BARS_PER_DAY = 24


@dataclass(frozen=True)
class Feature:
    """A named feature.

    ``build`` gives the column from block frames. A feature over another feature
    names it in ``after`` and is added in a later step. ``rank`` marks a trailing
    percentile rank (source column, window). ``arrow`` is the way out for what columns
    cannot express: a function of one block (a time-ordered pandas frame of the base
    columns, halo included) to one value per row. ``halo`` is the number of earlier rows
    the value depends on, warm-up of its inputs included.
    """

    name: str
    base: tuple[str, ...]
    lookback: int
    halo: int
    family: str
    build: Callable[[Frames], Column] | None = None
    rank: tuple[str, int] | None = None
    arrow: Callable[[pd.DataFrame], pd.Series] | None = None
    after: tuple[str, ...] = ()
    cadence: str = "1h"


_REGISTRY: dict[str, Feature] = {}
_HELPERS: dict[str, tuple[Callable[[Frames], Column], int, tuple[str, ...]]] = {}


def register_feature(feature: Feature) -> None:
    """Add or replace a feature."""
    _REGISTRY[feature.name] = feature


def unregister_feature(name: str) -> None:
    _REGISTRY.pop(name, None)


def register_helper(name: str, build: Callable[[Frames], Column], halo: int, after: tuple[str, ...] = ()) -> None:
    """Add an intermediate column features can name in ``after``."""
    _HELPERS[name] = (build, halo, after)


def registered(names: Sequence[str] | None = None) -> list[Feature]:
    return [_REGISTRY[n] for n in (names or _REGISTRY)]


D = BARS_PER_DAY
register_helper("_lr", lambda f: log_return(f, "close"), 1)
register_helper("_tr", lambda f: true_range(f, "high", "low", "close"), 1)
register_helper("_rv_30d", lambda f: std_of_log_return(f, "_lr", 30 * D), 30 * D, ("_lr",))

for _f in [
    Feature("ret_24h", ("close",), D, D, "price", lambda f: pctchg(f, "close", D)),
    Feature("rv_24h", ("close",), D, D, "price", lambda f: std_of_log_return(f, "_lr", D), after=("_lr",)),
    Feature("rv_30d_pctile_1y", ("close",), 365 * D, 395 * D, "price", rank=("_rv_30d", 365 * D), after=("_rv_30d",)),
    Feature("atr_14d", ("high", "low", "close"), 14 * D, 14 * D, "price", lambda f: atr_of(f, "_tr", 14 * D), after=("_tr",)),
    Feature("sma200_dist_pct", ("close",), 200 * D, 200 * D, "price", lambda f: sma_dist_pct(f, "close", 200 * D)),
    Feature("high_24h_dist", ("high", "close"), D, D, "price", lambda f: rolling_high_dist(f, "high", "close", D)),
    Feature("weekly_high_dist", ("high", "close"), 7 * D, 7 * D, "price", lambda f: rolling_high_dist(f, "high", "close", 7 * D)),
    Feature("taker_buy_ratio_24h", ("taker_buy_volume", "volume"), D, D, "price", lambda f: rolling_ratio(f, "taker_buy_volume", "volume", D)),
    Feature("vol_ma_ratio_7_30", ("volume",), 30 * D, 30 * D, "price", lambda f: ma_ratio(f, "volume", 7 * D, 30 * D)),
    Feature("funding_z_30d", ("funding_rate",), 30 * D, 30 * D, "deriv", lambda f: z(f, "funding_rate", 30 * D)),
    Feature("funding_chg_24h", ("funding_rate",), D, D, "deriv", lambda f: chg(f, "funding_rate", D)),
    Feature("oi_chg_24h", ("oi_base",), D, D, "deriv", lambda f: pctchg(f, "oi_base", D)),
    Feature("oi_pctile_1y", ("oi_base",), 365 * D, 365 * D, "deriv", rank=("oi_base", 365 * D)),
    Feature("ls_all_account_z_30d", ("ls_all_account",), 30 * D, 30 * D, "deriv", lambda f: z(f, "ls_all_account", 30 * D)),
    Feature("ls_top_trader_z_30d", ("ls_top_trader_position",), 30 * D, 30 * D, "deriv", lambda f: z(f, "ls_top_trader_position", 30 * D)),
    Feature("liq_notional_24h", ("liq_notional_1h",), D, D, "deriv", lambda f: rolling_sum(f, "liq_notional_1h", D)),
]:
    register_feature(_f)


def block_tasks(indexed: DataFrame) -> int:
    """Shuffle partitions for the blocks of a table that is kept: four a block, so that few of them share a task."""
    return max(int(indexed.sparkSession.conf.get("spark.sql.shuffle.partitions")), 4 * (indexed.count() // BLOCK_ROWS + 1))


def compute_features(
    indexed: DataFrame,
    keys: Sequence[str],
    names: Sequence[str] | None = None,
    size: int | None = None,
    tasks: int | None = None,
) -> DataFrame:
    """keys, pos, ts and one column per feature, same rows as the input.

    Only the named features (default: all) and the helpers they need are planned.
    Frame features share one block layout and one sort; rank features take one more. A task sorts its blocks
    many times in memory, so ``tasks`` (see ``block_tasks``) should grow with the rows.
    """
    chosen = registered(names)
    helpers: dict[str, None] = {}

    def need(name: str) -> None:
        if name in _HELPERS and name not in helpers:
            for up in _HELPERS[name][2]:
                need(up)
            helpers[name] = None

    for feat in chosen:
        for up in feat.after:
            need(up)
    plain = [f for f in chosen if f.build is not None]
    ranks = {f.name: f.rank for f in chosen if f.rank is not None}
    rank_inputs = {col for col, _ in ranks.values()}
    halo = max(
        [f.halo for f in plain]
        + [_HELPERS[h][1] + sum(_HELPERS[u][1] for u in _HELPERS[h][2]) for h in helpers]
        + [0]
    )
    frames = Frames(keys)
    out = _dealt(blocks(indexed, before=halo, size=size), keys, tasks)
    for name in helpers:
        out = apply_step(out, keys, frames, lambda fr, name=name: {name: _HELPERS[name][0](fr)})
    out = apply_step(out, keys, frames, lambda fr: {f.name: f.build(fr) for f in plain})
    python = [f for f in chosen if f.arrow is not None]
    inputs = rank_inputs | {c for f in python for c in f.base}
    keep = [*keys, POS, "ts", *[f.name for f in plain], *sorted(inputs)]
    out = core_rows(out.select(*keep, BLK, CORE))
    if python:
        out = add_arrow(out, keys, {f.name: f.arrow for f in python}, max(f.halo for f in python), size)
    if ranks:
        out = add_ranks(out, keys, ranks, size=None if size is None else max(size, 1), tasks=tasks)
    return out.select(*keys, POS, "ts", *[f.name for f in chosen])


def feature_definitions(spark: SparkSession, version: str = "v1", names: Sequence[str] | None = None) -> DataFrame:
    """Definition rows of the registry, for the table kept beside the features."""
    rows = [
        (f"{version}.{f.name}", 1, ",".join(f.base), version, f.cadence, f"{f.lookback}bars", f.family)
        for f in registered(names)
    ]
    schema = (
        "feature_id string, version int, base string, feature_set_version string, "
        "cadence string, lookback_required string, family string"
    )
    return spark.createDataFrame(rows, schema).select(
        "feature_id",
        "version",
        F.to_json(F.struct("base", "feature_set_version")).alias("spec"),
        "cadence",
        "lookback_required",
        "family",
    )
