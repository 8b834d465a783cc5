"""Declarative rules (a dict per rule) as boolean Spark columns.

A rule is built from seven node kinds: and, or, not, cmp, event, regime, time. It is
two-valued: a missing input makes the *leaf* false, so ``not`` over it is true.
Once a rule is a ``Column`` Catalyst folds and prunes it with the rest of the plan.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from barline.functions.scalar import utc_dow, utc_hour
from barline.operators.asof import event_column
from barline.operators.series import Frames, blocks, core_rows

Rule = dict[str, Any]

COMPARATORS = {
    ">": lambda a, b: a > b,
    "<": lambda a, b: a < b,
    ">=": lambda a, b: a >= b,
    "<=": lambda a, b: a <= b,
}
# Allowed labels per regime axis.
REGIME_VALUES = {
    "trend": ("up", "down", "range"),
    "vol": ("low", "high", "extreme"),
    "liquidity": ("normal", "stressed"),
}
NODES = ("and", "or", "not", "cmp", "event", "regime", "time")


class RuleError(ValueError):
    """The rule does not follow the grammar."""


class MissingInput(ValueError):
    """A rule names a feature, event type or regime the data does not hold."""


# ----------------------------------------------------------------- structure of a rule


def _children(node: Rule) -> list[Rule]:
    if "and" in node:
        return node["and"]
    if "or" in node:
        return node["or"]
    if "not" in node:
        return [node["not"]]
    return []


def _leaves(node: Rule):
    kids = _children(node)
    if kids:
        for kid in kids:
            yield from _leaves(kid)
    else:
        yield node


def _refs(node: Rule) -> list[Rule]:
    if "cmp" not in node:
        return []
    left, _, right = node["cmp"]
    return [left] + ([right] if isinstance(right, dict) else [])


def features_of(rule: Rule) -> set[str]:
    return {ref["feature"] for leaf in _leaves(rule) for ref in _refs(leaf)}


def event_types_of(rule: Rule) -> set[str]:
    return {leaf["event"]["type"] for leaf in _leaves(rule) if "event" in leaf}


def uses_regime(rule: Rule) -> bool:
    return any("regime" in leaf for leaf in _leaves(rule))


def max_lag(rule: Rule) -> int:
    return max([ref.get("lag", 0) for leaf in _leaves(rule) for ref in _refs(leaf)], default=0)


def problems_of(node: Any, at: str = "when") -> list[str]:
    """Grammar problems of a rule, empty when it is valid."""
    if not isinstance(node, dict):
        return [f"{at}: not an object"]
    kind = next((k for k in NODES if k in node), None)
    if kind is None:
        return [f"{at}: unknown node {sorted(node)}"]
    body, out = node[kind], []
    if kind in ("and", "or"):
        if not isinstance(body, list) or not body:
            return [f"{at}.{kind}: needs at least one member"]
        for i, kid in enumerate(body):
            out += problems_of(kid, f"{at}.{kind}[{i}]")
    elif kind == "not":
        out += problems_of(body, f"{at}.not")
    elif kind == "cmp":
        if not isinstance(body, list | tuple) or len(body) != 3:
            return [f"{at}.cmp: needs [feature, comparator, operand]"]
        if body[1] not in COMPARATORS:
            out.append(f"{at}.cmp: comparator {body[1]!r}")
        for ref in (body[0], body[2]):
            if isinstance(ref, dict):
                if not isinstance(ref.get("feature"), str) or not ref["feature"]:
                    out.append(f"{at}.cmp: feature name")
                lag = ref.get("lag", 0)
                if not isinstance(lag, int) or lag < 0:
                    out.append(f"{at}.cmp: lag {lag!r}")
            elif ref is body[0] or isinstance(ref, bool) or not isinstance(ref, int | float):
                out.append(f"{at}.cmp: operand {ref!r}")
    elif kind == "event":
        if not isinstance(body, dict) or not body.get("type"):
            out.append(f"{at}.event: type")
        elif not isinstance(body.get("min_magnitude", 0), int | float):
            out.append(f"{at}.event: min_magnitude")
    elif kind == "regime":
        for axis, allowed in REGIME_VALUES.items():
            bad = [v for v in body.get(axis) or [] if v not in allowed]
            if bad:
                out.append(f"{at}.regime.{axis}: {bad}")
    else:
        for name, low, top in (("utc_hour_in", 0, 23), ("dow_in", 0, 6), ("dom_in", 1, 31)):
            bad = [v for v in body.get(name) or [] if not isinstance(v, int) or not low <= v <= top]
            if bad:
                out.append(f"{at}.time.{name}: {bad}")
    return out


def spec_problems(spec: Any) -> list[str]:
    """Problems of a whole signal spec: when, entry, exit and direction."""
    if not isinstance(spec, dict):
        return ["spec: not an object"]
    out = problems_of(spec.get("when"))
    entry = spec.get("entry")
    if not isinstance(entry, dict):
        out.append("entry: missing")
    else:
        delay = entry.get("delay_bars", 1)
        if not isinstance(delay, int) or delay < 1:
            out.append(f"entry.delay_bars: {delay!r}")
        if entry.get("price", "open") != "open":
            out.append("entry.price: only 'open'")
    exit_ = spec.get("exit")
    if not isinstance(exit_, dict) or not (
        exit_.get("horizon") or (exit_.get("max_horizon") and not problems_of(exit_.get("cond"), "exit.cond"))
    ):
        out.append("exit: needs horizon, or cond with max_horizon")
    if spec.get("direction") not in ("long", "short", "signal_sign"):
        out.append(f"direction: {spec.get('direction')!r}")
    return out


def validate(spec: Any) -> None:
    found = spec_problems(spec)
    if found:
        raise RuleError("; ".join(found))


def spec_report(specs: DataFrame, spec_col: str = "signal_spec") -> DataFrame:
    """Shallow check of many JSON specs in a table, on the executors.

    Adds ``spec_ok`` and ``spec_issue``. Nested rule trees are checked by
    ``problems_of`` when a rule is compiled.
    """
    shape = T.StructType(
        [
            T.StructField("when", T.StringType()),
            T.StructField(
                "entry",
                T.StructType([T.StructField("delay_bars", T.LongType()), T.StructField("price", T.StringType())]),
            ),
            T.StructField(
                "exit",
                T.StructType(
                    [
                        T.StructField("horizon", T.StringType()),
                        T.StructField("max_horizon", T.StringType()),
                        T.StructField("cond", T.StringType()),
                    ]
                ),
            ),
            T.StructField("direction", T.StringType()),
        ]
    )
    s = F.col("_spec")
    issue = (
        F.when(s.isNull() | s["when"].isNull(), "when")
        .when(s["entry"].isNull() | (F.coalesce(s["entry"]["delay_bars"], F.lit(1)) < 1), "entry")
        .when(F.coalesce(s["entry"]["price"], F.lit("open")) != "open", "entry")
        .when(
            s["exit"].isNull()
            | (s["exit"]["horizon"].isNull() & (s["exit"]["max_horizon"].isNull() | s["exit"]["cond"].isNull())),
            "exit",
        )
        .when(~F.coalesce(s["direction"], F.lit("")).isin("long", "short", "signal_sign"), "direction")
    )
    parsed = specs.withColumn("_spec", F.from_json(F.col(spec_col), shape)).withColumn("spec_issue", issue)
    return parsed.withColumn("spec_ok", F.col("spec_issue").isNull()).drop("_spec")


# ------------------------------------------------------------------------ rule -> Column


def rule_column(rule: Rule, frames: Frames | None = None, ts: str = "ts", regime: str = "regime") -> Column:
    """Boolean column of a rule, never NULL.

    ``frames`` gives lag (not needed for rules without lags, for example on a
    stream). Feature columns go by name, events by ``ev_<type>``, regimes by a
    struct column.
    """

    def value(ref) -> Column:
        if isinstance(ref, dict):
            lag = ref.get("lag", 0)
            if lag and frames is None:
                raise RuleError("a lag needs an ordered series")
            col = F.col(ref["feature"]).cast("double")
            col = F.when(~F.isnan(col), col)
            return frames.lag(col, lag) if lag else col
        return F.lit(float(ref))

    def build(node: Rule) -> Column:
        if "and" in node:
            return reduce(lambda a, b: a & b, [build(n) for n in node["and"]])
        if "or" in node:
            return reduce(lambda a, b: a | b, [build(n) for n in node["or"]])
        if "not" in node:
            return ~build(node["not"])
        if "cmp" in node:
            left, op, right = node["cmp"]
            if op not in COMPARATORS:
                raise RuleError(f"unknown comparator: {op}")
            return F.coalesce(COMPARATORS[op](value(left), value(right)), F.lit(False))
        if "event" in node:
            top = F.col(event_column(node["event"]["type"]))
            floor = node["event"].get("min_magnitude")
            hit = top.isNotNull() if floor is None else top >= float(floor)
            return F.coalesce(hit, F.lit(False))
        if "regime" in node:
            conds = [
                F.col(f"{regime}.{axis}").isin(list(node["regime"][axis]))
                for axis in REGIME_VALUES
                if node["regime"].get(axis) is not None
            ]
            return F.coalesce(reduce(lambda a, b: a & b, conds, F.col(regime).isNotNull()), F.lit(False))
        if "time" in node:
            cond = F.lit(True)
            if node["time"].get("utc_hour_in") is not None:
                cond = cond & utc_hour(ts).isin(list(node["time"]["utc_hour_in"]))
            if node["time"].get("dow_in") is not None:
                cond = cond & utc_dow(ts).isin(list(node["time"]["dow_in"]))
            if node["time"].get("dom_in") is not None:
                cond = cond & F.dayofmonth(F.timestamp_millis(ts)).isin(list(node["time"]["dom_in"]))
            return F.coalesce(cond, F.lit(False))
        raise RuleError(f"unhandled node: {node!r}")

    found = problems_of(rule)
    if found:
        raise RuleError("; ".join(found))
    return build(rule)


def check_inputs(
    rule: Rule,
    columns: Sequence[str],
    event_types: Sequence[str] | None = None,
    has_regimes: bool | None = None,
) -> None:
    """Fail instead of silently never firing when an input is missing.

    ``event_types`` None means no event was supplied at all.
    """
    missing = features_of(rule) - set(columns)
    if missing:
        raise MissingInput(f"feature(s) not in the data: {sorted(missing)}")
    if event_types_of(rule) and not event_types:
        raise MissingInput(f"no events supplied for: {sorted(event_types_of(rule))}")
    if uses_regime(rule) and not has_regimes:
        raise MissingInput("the rule reads a regime but no regime data was supplied")


def fires(
    indexed: DataFrame,
    keys: Sequence[str],
    rules: dict[str, Rule],
    keep: Sequence[str] = (),
    size: int | None = None,
) -> DataFrame:
    """Fired bars of many rules in one pass: rule_id, keys, pos, ts, kept columns.

    One projection evaluates every rule; only the fired pairs are exploded, so the
    output grows with the fires and not with rules x bars.
    """
    frames = Frames(keys)
    lag = max(max_lag(r) for r in rules.values())
    rows = blocks(indexed, before=lag, size=size)
    hits = F.array(*[F.when(rule_column(r, frames), F.lit(rid)) for rid, r in rules.items()])
    rows = core_rows(rows.withColumn("_hits", F.filter(hits, lambda h: h.isNotNull())))
    return (
        rows.filter(F.size("_hits") > 0)
        .withColumn("rule_id", F.explode("_hits"))
        .select("rule_id", *keys, "pos", "ts", *keep)
    )


def fire_flags(
    indexed: DataFrame, keys: Sequence[str], rules: dict[str, Rule], size: int | None = None
) -> DataFrame:
    """The bars with one boolean column per rule."""
    frames = Frames(keys)
    lag = max(max_lag(r) for r in rules.values())
    rows = blocks(indexed, before=lag, size=size)
    return core_rows(rows.withColumns({rid: rule_column(r, frames) for rid, r in rules.items()}))


