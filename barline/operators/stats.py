"""Statistics of trade returns per group (rule, key, segment).

Everything is keyed; sequential measures (drawdown, autocorrelation) work on blocks
of the trade sequence and are merged, so a group may be as long as it likes.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from barline.functions.normal import norm_cdf, norm_ppf
from barline.functions.scalar import wilson_high, wilson_low
from barline.operators.series import BLK, BLOCK_ROWS, Frames, blocks, core_rows

INF = float("inf")
# Fixed values.
EULER_MASCHERONI = 0.5772156649015329
E = 2.718281828459045


def equity_curve(df: DataFrame, group: Sequence[str], ret: str, seq: str = "seq", size: int = BLOCK_ROWS) -> DataFrame:
    """Add ``equity``, the running product of 1 + ret/1e4."""
    from barline.operators.series import running

    return running(
        df,
        group,
        seq,
        F.floor(F.col(seq) / F.lit(size)).cast("bigint"),
        {"equity": ("product", 1.0 + F.col(ret) / 10_000.0)},
    )


def max_drawdown(df: DataFrame, group: Sequence[str], ret: str, seq: str = "seq", size: int = BLOCK_ROWS) -> DataFrame:
    """Deepest fall of the equity curve under its running top, one row per group.

    The start value 1.0 is no top. A block of trades is summed up by its end value,
    highest and lowest point and own drawdown; blocks merge in order:
    dd(A then B) = min(dd A, dd B, end_A * low_B / top_A - 1).
    """
    group = list(group)
    rows = df.select(*group, F.col(seq).alias("_seq"), F.col(ret).alias("_ret")).withColumn(
        BLK, F.floor(F.col("_seq") / F.lit(size)).cast("bigint")
    )
    w = W.partitionBy(*group, BLK).orderBy("_seq").rowsBetween(W.unboundedPreceding, 0)
    parts = (
        rows.withColumn("_eq", F.product(1.0 + F.col("_ret") / 10_000.0).over(w))
        .withColumn("_top", F.max("_eq").over(w))
        .groupBy(*group, BLK)
        .agg(
            F.max_by("_eq", "_seq").alias("_end"),
            F.max("_eq").alias("_hi"),
            F.min("_eq").alias("_lo"),
            F.min(F.try_divide(F.col("_eq") - F.col("_top"), F.col("_top"))).alias("_dd"),
        )
    )
    return merge_drawdowns(parts, group, BLK).select(*group, F.col("_dd").alias("max_dd"))


def merge_drawdowns(parts: DataFrame, keys: Sequence[str], order: str) -> DataFrame:
    """Pieces of an equity curve put together along ``order``, one row per key of the same form.

    A piece starts at 1: ``_end`` is its last value, ``_hi`` and ``_lo`` its extremes, ``_dd`` its own drawdown.
    Pieces without a value have an end of 1 and nulls.
    """
    prev = W.partitionBy(*keys).orderBy(order).rowsBetween(W.unboundedPreceding, -1)
    chained = parts.withColumn("_in", F.coalesce(F.product("_end").over(prev), F.lit(1.0)))
    chained = chained.withColumns({"_hi": F.col("_in") * F.col("_hi"), "_lo": F.col("_in") * F.col("_lo")})
    chained = chained.withColumn("_top_in", F.max("_hi").over(prev))
    fall = F.try_divide(F.col("_lo"), F.col("_top_in")) - 1.0
    return chained.groupBy(*keys).agg(
        F.product("_end").alias("_end"), F.max("_hi").alias("_hi"), F.min("_lo").alias("_lo"), F.min(F.least("_dd", fall)).alias("_dd")
    )


def top_gain_share(df: DataFrame, group: Sequence[str], ret: str, k: int = 5) -> DataFrame:
    """Share of all gains made by the k largest; 0 with no gain.

    The rank filter is pushed below the shuffle (each task keeps k rows per group).
    """
    group = list(group)
    gains = df.filter(F.col(ret) > 0)
    total = df.groupBy(*group).agg(F.sum(F.when(F.col(ret) > 0, F.col(ret))).alias("_all"))
    rank = F.row_number().over(W.partitionBy(*group).orderBy(F.col(ret).desc()))
    top = gains.withColumn("_rk", rank).filter(F.col("_rk") <= k).groupBy(*group).agg(F.sum(ret).alias("_top"))
    share = F.coalesce(F.try_divide(F.col("_top"), F.col("_all")), F.lit(0.0))
    return total.join(top, group, "left").select(*group, share.alias("top5_concentration"))


def effective_n(n: Column, lag_sum: Column, base_sum: Column) -> Column:
    """n (1 - rho) / (1 + rho), rho clipped to +-0.999, result to [1, n]."""
    rho = F.greatest(F.least(lag_sum / base_sum, F.lit(0.999)), F.lit(-0.999))
    value = F.greatest(F.lit(1.0), F.least(n * (1 - rho) / (1 + rho), n.cast("double")))
    return F.when((n < 3) | (base_sum <= 0), n.cast("double")).otherwise(value)


def trade_stats(
    df: DataFrame,
    group: Sequence[str],
    ret: str = "ret_net_bps",
    seq: str = "seq",
    per_year: str = "trades_per_year",
    size: int = BLOCK_ROWS,
) -> DataFrame:
    """The full metric bundle, one wide row per group.

    ``seq`` orders the trades of a group without gaps; ``per_year`` holds the same
    annualisation factor on every row of a group.
    """
    group = list(group)
    frames = Frames(group, seq)
    x, nxt = F.col(ret), F.col("_next")
    rows = blocks(df.select(*group, seq, ret, per_year), after=1, size=size, pos=seq)
    rows = core_rows(rows.withColumn("_next", frames.lead(ret, 1)))
    base = rows.groupBy(*group).agg(
        F.count(F.lit(1)).alias("trades"),
        F.max(per_year).alias("_tpy"),
        F.avg(x).alias("ev_bps"),
        F.sum(F.when(x > 0, 1).otherwise(0)).alias("_wins"),
        F.coalesce(F.sum(F.when(x > 0, x)), F.lit(0.0)).alias("_gain"),
        F.coalesce(-F.sum(F.when(x < 0, x)), F.lit(0.0)).alias("_loss"),
        F.stddev_samp(x).alias("_sd"),
        F.avg(F.when(x < 0, x * x)).alias("_down2"),
        F.skewness(x).alias("_skew"),
        F.kurtosis(x).alias("_kurt"),
        F.sum(x * nxt).alias("_sxy"),
        F.sum(F.when(nxt.isNotNull(), x)).alias("_sx"),
        F.sum(nxt).alias("_sy"),
        F.sum(F.when(nxt.isNotNull(), x * x)).alias("_sxx"),
    )
    n, m, tpy, sd = F.col("trades"), F.col("ev_bps"), F.col("_tpy"), F.col("_sd")
    lag_sum = F.col("_sxy") - m * (F.col("_sx") + F.col("_sy")) + (n - 1) * m * m
    base_sum = F.col("_sxx") - 2 * m * F.col("_sx") + (n - 1) * m * m
    down = F.sqrt("_down2")
    out = (
        base.join(max_drawdown(df, group, ret, seq, size), group)
        .join(top_gain_share(df, group, ret), group)
        .withColumns(
            {
                "win_rate": F.try_divide(F.col("_wins"), n),
                "win_rate_lo": wilson_low(F.col("_wins"), n),
                "win_rate_hi": wilson_high(F.col("_wins"), n),
                "pf": F.when(
                    F.col("_loss") == 0, F.when(F.col("_gain") > 0, F.lit(INF)).otherwise(F.lit(0.0))
                ).otherwise(F.try_divide(F.col("_gain"), F.col("_loss"))),
                "sharpe": F.when((n < 2) | sd.isNull() | (sd == 0), F.lit(0.0)).otherwise(
                    F.try_divide(m, sd) * F.sqrt(tpy)
                ),
                "sortino": F.when(n < 2, F.lit(0.0))
                .when(down.isNull(), F.when(m > 0, F.lit(INF)).otherwise(F.lit(0.0)))
                .when(down == 0, F.lit(0.0))
                .otherwise(F.try_divide(m, down) * F.sqrt(tpy)),
                "calmar": F.when(F.col("max_dd") == 0, F.lit(0.0)).otherwise(
                    F.try_divide(m / 10_000.0 * tpy, F.abs("max_dd"))
                ),
                "n_eff": effective_n(n, lag_sum, base_sum),
                "sr_hat": F.when(sd > 0, F.try_divide(m, sd)).otherwise(F.lit(0.0)),
                "skew": F.when(n > 2, F.coalesce("_skew", F.lit(0.0))).otherwise(F.lit(0.0)),
                "kurt": F.when(n > 3, F.coalesce(F.col("_kurt") + 3.0, F.lit(3.0))).otherwise(F.lit(3.0)),
            }
        )
    )
    return out.select(
        *group,
        F.col("trades"),
        F.col("_tpy").alias("trades_per_year"),
        "ev_bps",
        "win_rate",
        "win_rate_lo",
        "win_rate_hi",
        "pf",
        "sharpe",
        "sortino",
        "calmar",
        "max_dd",
        "n_eff",
        "top5_concentration",
        "sr_hat",
        "skew",
        "kurt",
    )


def sample_moments(df: DataFrame, group: Sequence[str], ret: str) -> DataFrame:
    """n, mean, sample std, per-trade Sharpe, biased skew and Pearson kurtosis."""
    n, sd = F.count(ret), F.stddev_samp(ret)
    return df.groupBy(*group).agg(
        n.alias("n"),
        F.avg(ret).alias("mean"),
        F.coalesce(sd, F.lit(0.0)).alias("std"),
        F.when(sd > 0, F.try_divide(F.avg(ret), sd)).otherwise(F.lit(0.0)).alias("sr_hat"),
        F.when(n > 2, F.coalesce(F.skewness(ret), F.lit(0.0))).otherwise(F.lit(0.0)).alias("skew"),
        F.when(n > 3, F.coalesce(F.kurtosis(ret) + 3.0, F.lit(3.0))).otherwise(F.lit(3.0)).alias("kurt"),
    )


def _sharpe_variance(sr: Column, skew: Column, kurt: Column) -> Column:
    return F.greatest(1 - skew * sr + (kurt - 1) / 4 * sr * sr, F.lit(1e-12))


def probabilistic_sharpe(sr: Column, benchmark: Column, skew: Column, kurt: Column, n: Column) -> Column:
    """P(true per-trade Sharpe > benchmark); 0 under three trades."""
    score = (sr - benchmark) * F.sqrt(F.greatest(n - 1, F.lit(0))) / F.sqrt(_sharpe_variance(sr, skew, kurt))
    return F.when(n < 3, F.lit(0.0)).otherwise(norm_cdf(score))


def expected_max_sharpe(n_trials: Column, sr: Column, skew: Column, kurt: Column, n: Column) -> Column:
    """Expected best Sharpe of ``n_trials`` skill-free tries."""
    t = n_trials.cast("double")
    sigma = F.sqrt(F.try_divide(_sharpe_variance(sr, skew, kurt), (n - 1).cast("double")))
    z1, z2 = norm_ppf(1 - 1 / t), norm_ppf(1 - 1 / (t * F.lit(E)))
    value = sigma * ((1 - EULER_MASCHERONI) * z1 + EULER_MASCHERONI * z2)
    return F.when((n_trials <= 1) | (n < 3), F.lit(0.0)).otherwise(value)


def deflated_sharpe(n_trials: Column, sr: Column, skew: Column, kurt: Column, n: Column) -> Column:
    """P(true Sharpe > 0) given the best of ``n_trials`` tries."""
    trials = F.greatest(n_trials, F.lit(1))
    return probabilistic_sharpe(sr, expected_max_sharpe(trials, sr, skew, kurt, n), skew, kurt, n)


def by_label(df: DataFrame, group: Sequence[str], label: Column, ret: str = "ret_net_bps") -> DataFrame:
    """Mean and count per label of a group (regime of the signal bar, year, ...)."""
    return df.groupBy(*group, label.alias("label")).agg(
        F.avg(ret).alias("ev_bps"), F.count(F.lit(1)).alias("trades")
    )


def recent_mean(
    df: DataFrame, group: Sequence[str], years: int = 2, ts: str = "entry_ts", ret: str = "ret_net_bps"
) -> DataFrame:
    """Mean of the trades entered within ``years`` * 365 days of the group's last entry."""
    last = df.groupBy(*group).agg(F.max(ts).alias("_last"))
    kept = df.join(last, list(group)).filter(F.col(ts) >= F.col("_last") - F.lit(years * 365 * 86_400_000))
    return kept.groupBy(*group).agg(F.avg(ret).alias("recent_ev_bps"))
