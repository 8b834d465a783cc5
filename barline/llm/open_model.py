"""Interpolated modified Kneser-Ney over code points as they are: counts and answers are rows, met by sharded joins."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barline.llm.text import slices
from barline.session import materialize

ORDER = 4

#: what may follow a context: every code point
POINTS = 0x110000

#: a context is a number of up to three code points of so many bits
BITS = 21

LEAST_DISCOUNT = 0.1

#: characters that one group of texts of a language has; a group gets the probabilities of the runs it holds
GROUP_CHARS = 8_000_000

#: model of all languages together, for texts of any other one
ANY = ""

#: trusted texts, and those without each fold
KINDS = ("all", "not0", "not1")

_PADS = " " * (ORDER - 1)

#: up to so many different code points, four of their numbers fit into 63 bits
_NARROW = 55_000


def _mask(order: int) -> Column:
    """What a run of ``order`` keeps of a context."""
    return F.lit((1 << BITS * (order - 1)) - 1).cast("bigint")


def runs(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Context and symbol of the different runs of four that end at characters of the texts, three spaces before each
    text; the number of the run that ends at each character; and the text of each character."""
    flat = np.frombuffer((_PADS + _PADS.join(texts)).encode("utf-32-le", "surrogatepass"), "<u4").astype(np.int64)
    sizes = np.fromiter(map(len, texts), np.int64, len(texts))
    of = np.repeat(np.arange(len(texts)), sizes)
    at = np.arange(len(of)) + (ORDER - 1) * (of + 1)
    seen = np.bincount(flat)
    dense = (np.cumsum(seen > 0) - 1)[flat]
    n = int(dense.max(initial=0)) + 1
    pair, width = dense[:-1] * n + dense[1:], n * n  # at k: the characters k and k + 1
    if n > _NARROW:
        pair, width = pd.factorize(pair)[0].astype(np.int64), len(pair)
    run, distinct = pd.factorize(pair[at - 3] * width + pair[at - 1])
    first = np.zeros(len(distinct), np.int64)
    first[run[::-1]] = at[::-1]  # any place where the run ends
    context = flat[first - 3] << 2 * BITS | flat[first - 2] << BITS | flat[first - 1]
    return context, flat[first], run, of


def _by_lang(langs: list[str | None], texts: list[str | None]) -> Iterator[tuple[str | None, np.ndarray]]:
    """Rows with text, language by language, in ranges that one step works on at once."""
    held: dict[str | None, list[int]] = {}
    for k, (lang, text) in enumerate(zip(langs, texts)):
        if text:
            held.setdefault(lang, []).append(k)
    for lang, rows in held.items():
        for lo, hi in slices([len(texts[k]) for k in rows]):
            yield lang, np.array(rows[lo:hi])


def run_counts(texts: DataFrame) -> DataFrame:
    """How often each run of four occurs in (fold 0 or 1, lang, hypothesis): model (the language, or all of them), context,
    symbol and the counts ``all``, ``not0``, ``not1``."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fold, lang, hypothesis = (batch.column(k).to_pylist() for k in range(3))
            for name, rows in _by_lang(lang, hypothesis):
                context, symbol, run, of = runs([hypothesis[k] for k in rows])
                second = np.array([fold[k] for k in rows])[of] == 1
                n = [np.bincount(run[side], minlength=len(symbol)) for side in (~second, second)]
                columns = [pa.array([name] * len(symbol), pa.string()), *map(pa.array, (context, symbol, *n))]
                yield pa.RecordBatch.from_arrays(columns, names=["lang", "context", "symbol", "n0", "n1"])

    narrow = texts.select("fold", F.col("lang").cast("string"), F.col("hypothesis").cast("string"))
    counted = narrow.mapInArrow(count, "lang string, context bigint, symbol bigint, n0 bigint, n1 bigint")
    counted = counted.groupBy("lang", "context", "symbol").agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1"))
    names = F.when(F.col("lang") != ANY, F.array(F.lit(ANY), F.col("lang"))).otherwise(F.array(F.lit(ANY)))
    under = counted.select(F.explode(names).alias("model"), "context", "symbol", "n0", "n1")
    summed = under.groupBy("model", "context", "symbol").agg(F.sum("n0").alias("not1"), F.sum("n1").alias("not0"))
    return summed.select("model", "context", "symbol", (F.col("not0") + F.col("not1")).alias("all"), "not0", "not1")


def levels(texts: DataFrame) -> list[DataFrame]:
    """Counts of runs of four, three, two and one, as tables: the highest order counts occurrences, a lower one the
    different code points that its runs follow."""
    found = [materialize(run_counts(texts), "runs", release=True)]
    for order in range(ORDER - 1, 0, -1):
        shorter = F.col("context").bitwiseAND(_mask(order)).alias("context")
        counts = [F.count_if(F.col(k) > 0).alias(k) for k in KINDS]
        found.append(materialize(found[-1].groupBy("model", shorter, "symbol").agg(*counts), "runs", release=True))
    return found


def _discounts(level: DataFrame) -> DataFrame:
    """The discounts of each model: <kind>_d1, _d2 and _d3, for runs counted once, twice and more often."""
    of = [F.count_if(F.col(k) == n).cast("double").alias(f"{k}_n{n}") for k in KINDS for n in (1, 2, 3, 4)]
    types = level.groupBy("model").agg(*of)

    def discount(kind: str, k: int) -> Column:
        n = {j: F.col(f"{kind}_n{j}") for j in (1, 2, 3, 4)}
        y = F.when(n[1] > 0, n[1] / (n[1] + 2 * n[2])).otherwise(F.lit(0.5))
        # where a count of counts is missing, as much as absolute discounting takes; never nothing, so that no run is
        # impossible
        return F.greatest(F.lit(LEAST_DISCOUNT), F.when(n[k] > 0, k - (k + 1) * y * n[k + 1] / n[k]).otherwise(y))

    return types.select("model", *(discount(k, n).alias(f"{k}_d{n}") for k in KINDS for n in (1, 2, 3)))


def probabilities(asked: DataFrame, found: list[DataFrame]) -> DataFrame:
    """Add to distinct (model, context, symbol) the probabilities ``p_<kind>``, from the shortest run to the longest.

    Each order is two joins: counts by (model, context, symbol), and what they leave by (model, context).
    """
    out = asked.select("*", *(F.lit(1.0 / POINTS).alias(f"p_{k}") for k in KINDS))
    for order, level in zip(range(1, ORDER + 1), reversed(found)):
        sums = [F.sum(k).alias(f"{k}_total") for k in KINDS]
        for k in KINDS:
            sums += [F.count_if(F.col(k) == n if n < 3 else F.col(k) >= n).alias(f"{k}_c{n}") for n in (1, 2, 3)]
        contexts = level.groupBy("model", F.col("context").alias("_context")).agg(*sums)
        counts = level.withColumnRenamed("context", "_context")
        out = (
            out.withColumn("_context", F.col("context").bitwiseAND(_mask(order)))
            .join(counts, ["model", "_context", "symbol"], "left")
            .join(contexts, ["model", "_context"], "left")
            .join(_discounts(level), "model", "left")
        )

        def interpolated(kind: str) -> Column:
            n, p = F.coalesce(F.col(kind), F.lit(0)), F.col(f"p_{kind}")
            d = [F.col(f"{kind}_d{j}") for j in (1, 2, 3)]
            kept = n - F.when(n == 0, 0.0).when(n == 1, d[0]).when(n == 2, d[1]).otherwise(d[2])
            left = sum(d[j - 1] * F.col(f"{kind}_c{j}") for j in (1, 2, 3))
            # a context that was not met leaves all to the shorter one
            return F.when(F.col(f"{kind}_total") > 0, (kept + left * p) / F.col(f"{kind}_total")).otherwise(p)

        out = out.select("model", "context", "symbol", *(interpolated(k).alias(f"p_{k}") for k in KINDS))
    return out


def _answers(held: DataFrame, found: list[DataFrame]) -> DataFrame:
    """The probabilities of the runs that each group holds (model, _group, context, symbol); null for a kind that neither the
    model nor that of all languages has."""
    has = found[-1].groupBy("model").agg(*(F.max(F.col(k) > 0).alias(f"has_{k}") for k in KINDS))
    has = materialize(has, "kinds")
    asked = held.select("model", "context", "symbol").distinct().join(has, "model")
    # a language whose texts are all in one fold borrows from all languages
    both = F.array_distinct(F.array(F.col("model"), F.lit(ANY)))
    via = F.when(F.col("has_not0") & F.col("has_not1"), F.array("model")).otherwise(both)
    routes = materialize(asked.select("*", F.explode(via).alias("_via")), "asked", release=True)
    distinct = routes.select(F.col("_via").alias("model"), "context", "symbol").distinct()
    known = probabilities(distinct, found).withColumnRenamed("model", "_via")
    pooled = has.filter(F.col("model") == ANY).select(*(F.col(f"has_{k}").alias(f"any_{k}") for k in KINDS))
    rows = routes.join(known, ["_via", "context", "symbol"]).join(pooled, how="left")

    def one(kind: str) -> Column:
        own = (F.col("_via") == F.col("model")) & F.col(f"has_{kind}")
        borrowed = (F.col("_via") != F.col("model")) & ~F.col(f"has_{kind}") & F.col(f"any_{kind}")
        return F.max(F.when(own | borrowed, F.col(f"p_{kind}"))).alias(f"p_{kind}")

    answers = rows.groupBy("model", "context", "symbol").agg(*map(one, KINDS))
    return held.join(answers, ["model", "context", "symbol"])


def perplexities(edges: DataFrame, found: list[DataFrame]) -> DataFrame:
    """edge_id, lang, model (the language whose counts hold for it), perplexity and held_out of every hypothesis.

    ``found`` as from ``levels``. Texts go to (language, group), in groups of about ``GROUP_CHARS`` characters. The distinct
    runs of a group ask the counts, and the answers meet the texts by group. ``held_out`` is the perplexity under the counts of
    its language without the row's fold, or if there are none, without the fold of all languages, or else ``perplexity``.
    """

    def ask(key: tuple, texts: pa.Table) -> pa.Table:
        parts = []
        for _, rows in _by_lang([None] * len(texts), held := texts["hypothesis"].to_pylist()):
            context, symbol, _, _ = runs([held[k] for k in rows])
            parts.append(pd.DataFrame({"context": context, "symbol": symbol}))
            if len(parts) > 1:  # what was met before is not kept twice
                parts = [pd.concat(parts).drop_duplicates()]
        distinct = parts[0] if parts else pd.DataFrame({"context": [], "symbol": []}, dtype="int64")
        names = {"model": pa.array([key[0].as_py()] * len(distinct), pa.string()), "_group": pa.array([key[1].as_py()] * len(distinct), pa.int64())}
        return pa.table(names | {c: pa.array(distinct[c].to_numpy()) for c in ("context", "symbol")})

    def score(texts: pa.Table, answers: pa.Table) -> pa.Table:
        place = pd.MultiIndex.from_frame(answers.select(["context", "symbol"]).to_pandas())
        logs = [np.log(answers[f"p_{k}"].to_numpy().astype("f8")) for k in KINDS]
        hypotheses, fold = texts["hypothesis"].to_pylist(), np.array(texts["fold"].to_pylist(), np.int64)
        found = np.full((2, len(hypotheses)), np.nan)
        for _, rows in _by_lang([None] * len(hypotheses), hypotheses) if len(place) else ():
            context, symbol, run, of = runs([hypotheses[k] for k in rows])
            at = place.get_indexer(pd.MultiIndex.from_arrays([context, symbol]))
            if (at < 0).any():
                raise RuntimeError("a run was not met by the first pass: the input changed between two reads")
            at = at[run]
            sizes = np.bincount(of, minlength=len(rows))
            means = [np.bincount(of, log[at], len(rows)) / sizes for log in logs]
            out = np.where(fold[rows] == 0, means[1], means[2])
            found[:, rows] = np.exp(-means[0]), np.exp(-np.where(np.isnan(out), means[0], out))
        scores = {n: pa.array(found[k], mask=np.isnan(found[k])) for k, n in enumerate(("perplexity", "held_out"))}
        return pa.table({n: texts[n] for n in ("edge_id", "lang", "model")} | scores)

    own = found[-1].select(F.col("model").alias("_own")).distinct()
    lang, text = F.col("lang").cast("string"), F.col("hypothesis").cast("string")
    narrow = edges.select("edge_id", lang.alias("lang"), text.alias("hypothesis"), "fold")
    sizes = narrow.groupBy("lang").agg(F.sum(F.coalesce(F.length("hypothesis"), F.lit(0)) + 1).alias("_chars"))
    named = sizes.join(own, F.col("lang") == F.col("_own"), "left")
    named = materialize(named.select("lang", F.coalesce("_own", F.lit(ANY)).alias("model"), "_chars"), "languages")
    groups = named.groupBy("model").agg(F.ceil(F.sum("_chars") / GROUP_CHARS).cast("bigint").alias("_groups"))
    models = materialize(named.join(groups, "model").select(F.col("lang").alias("_lang"), "model", "_groups"), "groups")
    dealt = narrow.join(models, F.col("lang").eqNullSafe(F.col("_lang"))).select(
        "edge_id", "lang", "hypothesis", "fold", "model", F.pmod(F.xxhash64("edge_id", "hypothesis"), "_groups").alias("_group")
    )
    held = dealt.select("hypothesis", "model", "_group").groupBy("model", "_group")
    held = held.applyInArrow(ask, "model string, _group bigint, context bigint, symbol bigint")
    answers = materialize(_answers(materialize(held, "held", release=True), found), "answers", release=True)
    kind = narrow.schema["edge_id"].dataType.simpleString()
    return (
        dealt.groupBy("model", "_group")
        .cogroup(answers.groupBy("model", "_group"))
        .applyInArrow(score, f"edge_id {kind}, lang string, model string, perplexity double, held_out double")
    )
