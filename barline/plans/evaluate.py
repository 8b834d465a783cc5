"""Evaluate many rules over many series in one run: fires, trades, statistics, verdict."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barline.functions.scalar import parse_horizon_bars, regime_label, ret_bps, utc_year
from barline.operators import asof, features, resample, rules, splits, stats
from barline.operators.labels import trades_per_year
from barline.operators.series import HOUR_MS, Frames, blocks, core_rows, index_rows
from barline.operators.verdict import Thresholds, decide, run_config, score
from barline.session import materialize

@dataclass(frozen=True)
class RuleSpec:
    """One rule version to evaluate."""

    rule_id: str
    when: dict[str, Any]
    direction: str
    horizon: str
    taker_bps: float = 0.0
    slippage_bps: float = 0.0
    delay_bars: int = 1
    n_trials: int = 1

    @property
    def cost_bps(self) -> float:
        return (self.taker_bps + self.slippage_bps) * 2

    def __post_init__(self):
        if self.direction not in ("long", "short"):
            raise ValueError(f"direction {self.direction!r} is not supported")
        rules.validate(
            {
                "when": self.when,
                "entry": {"delay_bars": self.delay_bars},
                "exit": {"horizon": self.horizon},
                "direction": self.direction,
            }
        )


@dataclass(frozen=True)
class Config:
    n_folds: int = 5
    permutation_iterations: int = 1000
    bootstrap_iterations: int = 2000
    confidence: float = 0.95
    embargo_ms: int = splits.DEFAULT_EMBARGO_MS
    seed: int = 0
    recent_years: int = 2
    trades_per_year: float | None = None
    thresholds: Thresholds = field(default_factory=Thresholds)

    @staticmethod
    def for_kind(kind: str) -> Config:
        return Config(**run_config(kind))


@dataclass
class Evaluation:
    """Result tables of a run; ``metrics`` and ``verdicts`` are lazy over written tables."""

    trades: DataFrame
    metrics: DataFrame
    verdicts: DataFrame


def prepare_bars(
    bars: DataFrame,
    keys: Sequence[str],
    specs: Sequence[RuleSpec],
    bar_ms: int = HOUR_MS,
    events: DataFrame | None = None,
    regimes: DataFrame | None = None,
    regime_keys: Sequence[str] = (),
    size: int | None = None,
) -> DataFrame:
    """Bars with everything the rules read: position, features, events, regime.

    Only what some rule refers to is computed. Raises ``MissingInput`` when a rule
    names something that is not supplied.
    """
    keys = list(keys)
    wanted = set().union(*[rules.features_of(s.when) for s in specs])
    types = sorted(set().union(*[rules.event_types_of(s.when) for s in specs]))
    registry = {f.name for f in features.registered()}
    derived = sorted((wanted & registry) - set(bars.columns))
    if types:
        supplied = events is not None and not events.isEmpty()
    if any(rules.uses_regime(s.when) for s in specs):
        with_regime = regimes is not None and not regimes.isEmpty()
    else:
        with_regime = None
    for s in specs:
        rules.check_inputs(s.when, [*bars.columns, *derived], types if types and supplied else None, with_regime)
    # the indexed bars and their features are read by several branches below
    out = index_rows(bars, keys, "ts", F.floor(F.col("ts") / F.lit(50_000 * bar_ms)).cast("bigint"))
    out = materialize(out, "bars")
    if derived:
        missing = sorted({c for f in features.registered(derived) for c in f.base} - set(bars.columns))
        if missing:
            raise rules.MissingInput(f"base column(s) not in the bars: {missing}")
        computed = features.compute_features(out, keys, derived, size)
        out = materialize(out.join(computed.drop("ts"), [*keys, "pos"]), "features")
    if types:
        out = asof.place_events(out, keys, events, bar_ms, types)
    if regimes is not None:
        packed = regimes.select(*regime_keys, "dt", F.struct("trend", "vol", "liquidity").alias("regime"))
        out = asof.fill_daily(out, packed, regime_keys, ["regime"])
    else:
        out = out.withColumn("regime", F.lit(None).cast("struct<trend:string,vol:string,liquidity:string>"))
    return out


def label_name(spec: RuleSpec, bar_ms: int) -> str:
    return f"{spec.direction}_{spec.delay_bars}_{parse_horizon_bars(spec.horizon, bar_ms)}"


def _card(spec: RuleSpec, bar_ms: int) -> Column:
    bars = parse_horizon_bars(spec.horizon, bar_ms)
    return F.struct(
        F.lit(spec.rule_id).alias("rule_id"),
        F.lit(label_name(spec, bar_ms)).alias("shape"),
        F.lit(float(spec.cost_bps)).alias("cost_bps"),
        F.lit(3 * bars).cast("bigint").alias("block_len"),
        F.lit(spec.n_trials).cast("bigint").alias("n_trials"),
    )


def fire_and_label(
    prepared: DataFrame, keys: Sequence[str], specs: Sequence[RuleSpec], bar_ms: int = HOUR_MS, size: int | None = None
) -> DataFrame:
    """Every bar with the rules fired on it and one label per distinct trade shape.

    Rules, lags and all forward labels share one block layout and one sort. A fired rule
    carries what later steps need of it, so nothing looks rules up again.
    """
    frames = Frames(keys)
    shapes = {label_name(s, bar_ms): (s.direction, s.delay_bars, parse_horizon_bars(s.horizon, bar_ms)) for s in specs}
    before = max(rules.max_lag(s.when) for s in specs)
    after = max(d + h for _, d, h in shapes.values())
    rows = blocks(prepared, before=before, after=after, size=size)
    hits = F.filter(
        F.array(*[F.when(rules.rule_column(s.when, frames), _card(s, bar_ms)) for s in specs]), lambda h: h.isNotNull()
    )
    labels = {
        n: F.struct(
            frames.lead("ts", d).alias("entry_ts"),
            frames.lead("ts", d + h).alias("exit_ts"),
            ret_bps(direction, frames.lead("open", d), frames.lead("close", d + h)).alias("fwd_bps"),
        )
        for n, (direction, d, h) in shapes.items()
    }
    rows = core_rows(rows.withColumn("hits", hits).withColumns(labels))
    return rows.select(*keys, "pos", "ts", regime_label("regime").alias("regime_label"), "hits", *shapes)


def long_labels(labelled: DataFrame, keys: Sequence[str], shapes: Sequence[str]) -> DataFrame:
    """Labels as (keys, shape, pos, fwd_bps) rows, shared by all rules of a shape."""
    pairs = F.array(*[F.struct(F.lit(n).alias("shape"), F.col(f"{n}.fwd_bps").alias("fwd_bps")) for n in shapes])
    return labelled.select(*keys, "pos", F.explode(pairs).alias("_p")).select(*keys, "pos", "_p.shape", "_p.fwd_bps")


def trades_of(labelled: DataFrame, keys: Sequence[str], specs: Sequence[RuleSpec], bar_ms: int = HOUR_MS) -> DataFrame:
    """Trades of every rule: the fired bars with a label, gross and net."""
    shapes = sorted({label_name(s, bar_ms) for s in specs})
    label = F.coalesce(*[F.when(F.col("_h.shape") == n, F.col(n)) for n in shapes])
    fired = labelled.filter(F.size("hits") > 0).withColumn("_h", F.explode("hits"))
    rows = fired.withColumn("_s", label).filter(F.col("_s.fwd_bps").isNotNull())
    rows = rows.select(
        F.col("_h.rule_id").alias("rule_id"),
        F.col("_h.block_len").alias("block_len"),
        F.col("_h.n_trials").alias("n_trials"),
        *keys,
        "pos",
        "regime_label",
        F.col("_s.entry_ts").alias("entry_ts"),
        F.col("_s.exit_ts").alias("exit_ts"),
        F.col("_s.fwd_bps").alias("ret_bps"),
        (F.col("_s.fwd_bps") - F.col("_h.cost_bps")).alias("ret_net_bps"),
    )
    return index_rows(rows, ["rule_id", *keys], "pos", F.floor(F.col("pos") / F.lit(65_536)).cast("bigint"), "seq")


BUNDLE = ["ev_bps", "win_rate", "pf", "sharpe", "sortino", "calmar", "max_dd", "trades", "n_eff"]


def _rows(df: DataFrame, group: Sequence[str], segment: Column, values: dict[str, tuple[Column, Column, Column]]):
    none = F.lit(None).cast("double")
    items = F.array(
        *[
            F.struct(
                F.lit(m).alias("metric"),
                v.cast("double").alias("value"),
                (none if lo is None else lo).cast("double").alias("ci_lo"),
                (none if hi is None else hi).cast("double").alias("ci_hi"),
            )
            for m, (v, lo, hi) in values.items()
        ]
    )
    return df.select(*group, segment.alias("segment"), F.explode(items).alias("_m")).select(*group, "segment", "_m.*")


def evaluate(
    prepared: DataFrame,
    keys: Sequence[str],
    specs: Sequence[RuleSpec],
    config: Config | None = None,
    bar_ms: int = HOUR_MS,
    size: int | None = None,
) -> Evaluation:
    """Run the whole protocol for every (rule, series).

    ``prepared`` from ``prepare_bars``. What several branches read is written to the run
    folder first: labelled bars, trades, trades with folds, and the row per rule.
    """
    cfg = config or Config()
    keys = list(keys)
    group = ["rule_id", *keys]
    shapes = sorted({label_name(s, bar_ms) for s in specs})
    labelled = materialize(fire_and_label(prepared, keys, specs, bar_ms, size), "labelled")
    trades = materialize(trades_of(labelled, keys, specs, bar_ms), "trades")

    span = trades.groupBy(*group).agg(
        F.count(F.lit(1)).alias("_n"), F.min("entry_ts").alias("_a"), F.max("entry_ts").alias("_b")
    )
    tpy = trades_per_year(F.col("_n"), F.col("_a"), F.col("_b"))
    if cfg.trades_per_year is not None:
        tpy = F.lit(float(cfg.trades_per_year))
    folded = splits.assign_test_fold(trades, group, cfg.n_folds)
    first_oos = folded.groupBy(*group).agg(F.min(F.when(F.col("fold").isNotNull(), F.col("seq"))).alias("_first"))
    full = folded.join(span.select(*group, tpy.alias("trades_per_year")), group).join(first_oos, group)
    full = materialize(full, "folded")

    # out of sample = the trades from the first tested one on; all when no fold could be cut
    base = F.coalesce("_first", F.lit(0))
    overall = full.withColumn("segment", F.lit("overall"))
    oos = (
        full.filter(F.col("seq") >= base).withColumn("seq", F.col("seq") - base).withColumn("segment", F.lit("wf:oos"))
    )
    bundle = stats.trade_stats(overall.unionByName(oos), [*group, "segment"])
    fold_rows = splits.fold_stats(full, group)
    consistency = splits.fold_consistency(fold_rows, group)

    fired = (
        labelled.filter(F.size("hits") > 0)
        .select(*keys, "pos", F.explode("hits").alias("_h"))
        .select(*keys, "pos", "_h.rule_id", "_h.shape", "_h.block_len")
    )
    perm = resample.permutation_test(
        fired,
        long_labels(labelled, keys, shapes),
        [*group, "shape"],
        [*keys, "shape"],
        "block_len",
        cfg.permutation_iterations,
        cfg.seed,
    ).select(*group, F.col("p_value").alias("p_perm"))
    perm = materialize(perm, "permutations")

    sample = oos.select(*group, "seq", "ret_net_bps", "block_len", "trades_per_year")

    def ci(name: str, statistic: resample.Statistic, seed: int) -> DataFrame:
        out = resample.bootstrap_ci(
            sample, group, "ret_net_bps", statistic, "block_len", cfg.bootstrap_iterations, cfg.confidence, seed
        ).withColumnsRenamed({"point": f"{name}_point", "ci_lo": f"{name}_lo", "ci_hi": f"{name}_hi"})
        # each in a job of its own: in one plan the driver builds the broadcasts of all of them at once
        return materialize(out, f"{name}_interval")

    boot = (
        ci("ev", resample.mean_statistic, cfg.seed)
        .join(ci("sharpe", resample.sharpe_statistic(), cfg.seed + 1), group)
        .join(ci("dd", resample.drawdown_statistic, cfg.seed + 2), group)
    )

    regime = stats.by_label(full, group, F.col("regime_label"))
    year = stats.by_label(full, group, utc_year("entry_ts").cast("string"))
    recent = stats.recent_mean(full, group, cfg.recent_years)
    worst = regime.groupBy(*group).agg(F.min("ev_bps").alias("regime_worst_ev_bps"))
    zero_cost = trades.groupBy(*group).agg(F.avg("ret_bps").alias("gross"), F.max("n_trials").alias("n_trials"))

    root = F.sqrt("trades_per_year")
    head = (
        bundle.filter(F.col("segment") == "wf:oos")
        .join(consistency, group, "left")
        .join(perm, group, "left")
        .join(boot, group)
        .join(worst, group)
        .join(recent, group)
        .join(zero_cost, group)
        .withColumns(
            {
                "fold_consistency": F.coalesce("fold_consistency", F.lit(0.0)),
                "p_perm": F.coalesce("p_perm", F.lit(1.0)),
                # the factor is constant per group, so it scales the interval as well
                "sharpe_point": F.col("sharpe_point") * root,
                "sharpe_lo": F.col("sharpe_lo") * root,
                "sharpe_hi": F.col("sharpe_hi") * root,
                "dsr": stats.deflated_sharpe(
                    F.col("n_trials"), F.col("sr_hat"), F.col("skew"), F.col("kurt"), F.col("trades")
                ),
                "corr_max_active": F.lit(None).cast("double"),
            }
        )
        .withColumnsRenamed({"ev_lo": "ev_bps_ci_lo", "ev_hi": "ev_bps_ci_hi"})
    )
    head = materialize(head, "head")
    decided = decide(head, cfg.thresholds).withColumn("score", score())

    c = F.col
    wide = {m: (c(m), c("win_rate_lo") if m == "win_rate" else None, c("win_rate_hi") if m == "win_rate" else None) for m in BUNDLE}
    plain = {m: (c(m), None, None) for m in ("fold_consistency", "p_perm", "dsr", "top5_concentration")}
    metrics = (
        _rows(bundle, group, c("segment"), wide)
        .unionByName(_rows(head, group, F.lit("overall"), {"trades_per_year": (c("trades_per_year"), None, None)}))
        .unionByName(_rows(head, group, F.lit("cost:zero"), {"ev_bps": (c("gross"), None, None)}))
        .unionByName(
            _rows(
                head,
                group,
                F.lit("wf:oos"),
                {
                    **plain,
                    "ev_bps_bootstrap": (c("ev_point"), c("ev_bps_ci_lo"), c("ev_bps_ci_hi")),
                    "sharpe_bootstrap": (c("sharpe_point"), c("sharpe_lo"), c("sharpe_hi")),
                    "max_dd_bootstrap": (c("dd_point"), c("dd_lo"), c("dd_hi")),
                },
            )
        )
        .unionByName(
            _rows(
                fold_rows,
                group,
                F.concat(F.lit("wf:fold"), c("fold").cast("string")),
                {"ev_bps": (c("ev_bps"), None, None), "trades": (c("trades"), None, None)},
            )
        )
        .unionByName(
            _rows(
                regime,
                group,
                F.concat(F.lit("regime:"), c("label")),
                {"ev_bps": (c("ev_bps"), None, None), "trades": (c("trades"), None, None)},
            )
        )
        .unionByName(_rows(year, group, F.concat(F.lit("year:"), c("label")), {"ev_bps": (c("ev_bps"), None, None)}))
        .unionByName(
            _rows(head, group, F.lit(f"year:recent{cfg.recent_years}y"), {"ev_bps": (c("recent_ev_bps"), None, None)})
        )
    )
    # rules without a single trade: one metric row and the verdict of empty inputs
    every = labelled.select(*keys).distinct().select(
        F.explode(F.array(*[F.lit(s.rule_id) for s in specs])).alias("rule_id"), *keys
    )
    idle = every.join(span, group, "left_anti")
    metrics = metrics.unionByName(_rows(idle, group, F.lit("overall"), {"trades": (F.lit(0.0), None, None)}))
    zeros = ["ev_bps_ci_lo", "ev_bps_ci_hi", "sharpe", "dsr", "n_eff", "fold_consistency", "regime_worst_ev_bps",
             "ev_bps", "top5_concentration"]
    empty = idle.withColumns(
        {
            **{z: F.lit(0.0) for z in zeros},
            "p_perm": F.lit(1.0),
            "corr_max_active": F.lit(None).cast("double"),
            "recent_ev_bps": F.lit(None).cast("double"),
        }
    )
    keep = [*group, "verdict", "score", "reasons"]
    verdicts = decided.select(*keep).unionByName(decide(empty, cfg.thresholds).withColumn("score", score()).select(*keep))
    return Evaluation(trades, metrics, verdicts)
