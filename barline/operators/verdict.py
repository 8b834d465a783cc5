"""Threshold verdict and score over evaluated metrics."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Run configurations by kind.
RUN_CONFIG = {
    "screen": {"n_folds": 3, "permutation_iterations": 200, "bootstrap_iterations": 300},
    "full": {"n_folds": 5, "permutation_iterations": 1000, "bootstrap_iterations": 2000},
}


def run_config(kind: str) -> dict[str, int]:
    """Fold and iteration counts; any kind but 'screen' gets the full rigour."""
    return dict(RUN_CONFIG["screen" if kind == "screen" else "full"])


@dataclass(frozen=True)
class Thresholds:
    min_sharpe: float = 1.0
    min_dsr_adopt: float = 0.90
    max_dsr_reject: float = 0.50
    max_p_perm_adopt: float = 0.05
    min_p_perm_reject: float = 0.30
    min_n_eff: float = 30.0
    min_fold_consistency: float = 0.7
    max_top5_concentration: float = 0.6
    max_corr_with_active: float = 0.7


def _reason(check: str, passed: Column, value: Column, threshold: Column) -> Column:
    return F.struct(
        F.lit(check).alias("check"),
        F.coalesce(passed, F.lit(False)).alias("passed"),
        value.cast("double").alias("value"),
        threshold.cast("double").alias("threshold"),
    )


def decide(df: DataFrame, t: Thresholds | None = None) -> DataFrame:
    """Add ``verdict`` and the ordered ``reasons`` array.

    Reads ev_bps_ci_lo, ev_bps_ci_hi, sharpe, dsr, p_perm, n_eff, fold_consistency,
    regime_worst_ev_bps, ev_bps, top5_concentration, corr_max_active (NULL = not
    checked) and recent_ev_bps (NULL = not checked). Any failed reject check gives
    REJECT with only those checks listed; all adopt checks give ADOPT; else WATCH.
    """
    t = t or Thresholds()
    c = F.col

    def num(x: float) -> Column:
        return F.lit(float(x))

    reject = [
        ("reject.ci_upper_below_zero", c("ev_bps_ci_hi") >= 0, c("ev_bps_ci_hi"), num(0)),
        ("reject.p_perm_too_high", c("p_perm") <= t.min_p_perm_reject, c("p_perm"), num(t.min_p_perm_reject)),
        ("reject.dsr_too_low", c("dsr") >= t.max_dsr_reject, c("dsr"), num(t.max_dsr_reject)),
    ]
    recent = ("reject.recent_2y_ev_negative", c("recent_ev_bps") >= 0, c("recent_ev_bps"), num(0))
    adopt = [
        ("adopt.ci_lower_above_zero", c("ev_bps_ci_lo") > 0, c("ev_bps_ci_lo"), num(0)),
        ("adopt.sharpe", c("sharpe") >= t.min_sharpe, c("sharpe"), num(t.min_sharpe)),
        ("adopt.dsr", c("dsr") >= t.min_dsr_adopt, c("dsr"), num(t.min_dsr_adopt)),
        ("adopt.p_perm", c("p_perm") < t.max_p_perm_adopt, c("p_perm"), num(t.max_p_perm_adopt)),
        ("adopt.n_eff", c("n_eff") >= t.min_n_eff, c("n_eff"), num(t.min_n_eff)),
        (
            "adopt.fold_consistency",
            c("fold_consistency") >= t.min_fold_consistency,
            c("fold_consistency"),
            num(t.min_fold_consistency),
        ),
        ("adopt.regime_worst_ev", c("regime_worst_ev_bps") > -2 * c("ev_bps"), c("regime_worst_ev_bps"), -2 * c("ev_bps")),
        (
            "adopt.top5_concentration",
            c("top5_concentration") < t.max_top5_concentration,
            c("top5_concentration"),
            num(t.max_top5_concentration),
        ),
    ]
    corr = (
        "adopt.corr_max_active",
        c("corr_max_active") < t.max_corr_with_active,
        c("corr_max_active"),
        num(t.max_corr_with_active),
    )
    empty = F.array().cast(_reasons_type())
    recent_part = F.when(c("recent_ev_bps").isNotNull(), F.array(_reason(*recent))).otherwise(empty)
    corr_part = F.when(c("corr_max_active").isNotNull(), F.array(_reason(*corr))).otherwise(empty)
    reject_list = F.concat(F.array(*[_reason(*r) for r in reject]), recent_part)
    adopt_list = F.concat(F.array(*[_reason(*r) for r in adopt]), corr_part)
    out = df.withColumns({"_rej": reject_list, "_ado": adopt_list})
    rejected = F.exists("_rej", lambda r: ~r["passed"])
    adopted = F.forall("_ado", lambda r: r["passed"])
    return (
        out.withColumn("verdict", F.when(rejected, "REJECT").when(adopted, "ADOPT").otherwise("WATCH"))
        .withColumn("reasons", F.when(rejected, F.col("_rej")).otherwise(F.concat("_rej", "_ado")))
        .drop("_rej", "_ado")
    )


def _reasons_type() -> str:
    return "array<struct<check:string,passed:boolean,value:double,threshold:double>>"


def score() -> Column:
    """0-100 sort key from dsr, sharpe, fold_consistency and top5_concentration."""
    return (
        40 * F.least(F.col("dsr"), F.lit(1.0))
        + 20 * F.least(F.col("sharpe") / 2, F.lit(1.0))
        + 15 * F.col("fold_consistency")
        + 15 * (1 - F.col("top5_concentration"))
        + 10.0
    )
