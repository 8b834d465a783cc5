"""Quality by perplexity: an interpolated modified Kneser-Ney model of characters, trained on trusted text."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from barline.llm import open_model
from barline.session import materialize

#: symbols of the model: a-z, then classes of all other characters
SYMBOLS = 32
SPACE, DIGIT, CAPITAL, LETTER, STOP, OTHER = range(26, 32)
ORDER = 4

#: a language's texts are kept up to this quantile of its trusted texts' perplexity
KEEP_QUANTILE = 0.99

LEAST_DISCOUNT = 0.1

#: counts of so many (fold, language) pairs, 8 MB each, are held in a task before it gives them away
HELD = 16

#: characters that one group of texts of a language has; each group gets the three packed models of its language
GROUP_CHARS = 8_000_000

#: model and thresholds of all languages together, for texts of any other one
ANY = ""

_STEP = 1000  # perplexities are counted in thousandths


def _symbol_table() -> np.ndarray:
    """Symbol of every UTF-16 unit."""
    table = np.full(1 << 16, LETTER, np.uint8)
    table[:128] = OTHER
    table[[9, 10, 11, 12, 13, 32, 0xA0]] = SPACE
    table[48:58] = DIGIT
    table[65:91] = CAPITAL
    table[97:123] = np.arange(26)
    table[[ord(c) for c in ".,;:!?'\"()-"]] = STOP
    return table


def _grams(text: str, table: np.ndarray) -> np.ndarray:
    """Codes of the runs of four symbols that end at each character; three spaces stand before the text."""
    symbols = table[np.frombuffer(text.encode("utf-16-le", "surrogatepass"), "<u2")].astype(np.int32)
    padded = np.concatenate([np.full(ORDER - 1, SPACE, np.int32), symbols])
    n = len(symbols)
    return reduce(lambda code, k: code * SYMBOLS + padded[k : k + n], range(ORDER), np.zeros(n, np.int32))


def gram_counts(texts: DataFrame) -> DataFrame:
    """How often each run of four symbols occurs by fold and language of (fold, lang, hypothesis): also gram, n.

    A task adds up its texts before it gives a row for each run that it met, ``HELD`` languages and folds at a time.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, sums = _symbol_table(), {}

        def rows() -> Iterator[pa.RecordBatch]:
            for (fold, lang), counts in sums.items():
                seen = np.flatnonzero(counts)
                keys = [pa.array([fold] * len(seen), pa.int32()), pa.array([lang] * len(seen), pa.string())]
                yield pa.RecordBatch.from_arrays(
                    [*keys, pa.array(seen, pa.int64()), pa.array(counts[seen])], names=["fold", "lang", "gram", "n"]
                )

        for batch in batches:
            for fold, lang, text in zip(*(batch.column(k).to_pylist() for k in range(3))):
                if text:
                    if (fold, lang) not in sums:
                        if len(sums) == HELD:
                            yield from rows()
                            sums.clear()
                        sums[fold, lang] = np.zeros(SYMBOLS**ORDER, np.int64)
                    np.add.at(sums[fold, lang], _grams(text, table), 1)
        yield from rows()

    narrow = texts.select("fold", F.col("lang").cast("string"), F.col("hypothesis").cast("string"))
    counted = narrow.mapInArrow(run, "fold int, lang string, gram bigint, n bigint")
    return counted.groupBy("fold", "lang", "gram").agg(F.sum("n").alias("n"))


def _discounted(counts: DataFrame) -> DataFrame:
    """Add to (model, gram, n) what modified Kneser-Ney needs: ``p``, the discounted share of the gram in its
    context, and ``gamma``, the share that the context leaves to shorter ones."""
    of = lambda k: F.sum(F.when(F.col("n") == k, 1).otherwise(0)).cast("double")
    types = counts.groupBy("model").agg(*(of(k).alias(f"n{k}") for k in (1, 2, 3, 4)))
    y = F.when(F.col("n1") > 0, F.col("n1") / (F.col("n1") + 2 * F.col("n2"))).otherwise(F.lit(0.5))

    def discount(k: int) -> Column:
        # where a count of counts is missing, as much as absolute discounting takes; never nothing, so that no
        # run of symbols is impossible
        d = k - (k + 1) * y * F.col(f"n{k + 1}") / F.col(f"n{k}")
        return F.greatest(F.lit(LEAST_DISCOUNT), F.when(F.col(f"n{k}") > 0, d).otherwise(y))

    types = types.select("model", *(discount(k).alias(f"d{k}") for k in (1, 2, 3)))
    # counts and their discounts meet by model, grams and contexts by (model, context)
    rows = counts.join(types, "model").withColumn("context", F.floor(F.col("gram") / SYMBOLS))
    d = F.when(F.col("n") == 1, F.col("d1")).when(F.col("n") == 2, F.col("d2")).otherwise(F.col("d3"))
    rows = rows.withColumn("_cut", F.least(d, F.col("n").cast("double")))
    contexts = rows.groupBy("model", "context").agg(
        F.sum("n").cast("double").alias("_total"), F.sum("_cut").alias("_left")
    )
    return rows.join(contexts, ["model", "context"]).select(
        "model",
        "gram",
        "context",
        ((F.col("n") - F.col("_cut")) / F.col("_total")).alias("p"),
        (F.col("_left") / F.col("_total")).alias("gamma"),
    )


def _pack(rows: pd.DataFrame) -> pd.DataFrame:
    """The discounted shares of all orders of one model: probabilities after two symbols, what each context of
    three leaves to them, and the runs of four that were met."""
    known = np.full(SYMBOLS, 1.0 / SYMBOLS)
    for order in range(1, ORDER + 1):
        part = rows[rows["size"] == order]
        # a context that was not met leaves all to the shorter one
        gamma = np.ones(SYMBOLS ** (order - 1))
        gamma[part["context"].to_numpy(np.int64)] = part["gamma"]
        if order == ORDER:
            break
        known = np.repeat(gamma, SYMBOLS) * (known if order == 1 else np.tile(known, SYMBOLS))
        known[part["gram"].to_numpy(np.int64)] += part["p"].to_numpy()
    parts = [known.astype("<f4"), gamma.astype("<f4"), part["gram"].to_numpy("<u4"), part["p"].to_numpy("<f4")]
    return pd.DataFrame({"model": [rows["model"].iloc[0]], "table": [b"".join(x.tobytes() for x in parts)]})


def log_table(packed: bytes) -> np.ndarray:
    """Log-probabilities of all runs of four symbols of a packed model."""
    size = 4 * SYMBOLS ** (ORDER - 1)
    known, gamma = np.frombuffer(packed[:size], "<f4"), np.frombuffer(packed[size : 2 * size], "<f4")
    grams, shares = np.frombuffer(packed[2 * size :], "<u4").reshape(2, -1)
    table = np.repeat(gamma.astype("f8"), SYMBOLS) * np.tile(known.astype("f8"), SYMBOLS)
    table[grams] += shares.view("<f4")
    return np.log(table).astype("<f4")


def train(counts: DataFrame) -> DataFrame:
    """Packed models (model, table) of counts (model, gram, n).

    The highest order counts occurrences, a lower one the different symbols that its runs follow; each is a
    grouped count joined with the counts of its contexts. A packed model takes 8 MB at most, mostly below one.
    """
    level = counts.groupBy("model", "gram").agg(F.sum("n").alias("n"))
    orders = []
    for order in range(ORDER, 0, -1):
        level = materialize(level, "counts")
        orders.append(materialize(_discounted(level).withColumn("size", F.lit(order)), "shares"))
        shorter = F.col("gram") % SYMBOLS ** (order - 1)
        level = level.groupBy("model", shorter.alias("gram")).agg(F.count(F.lit(1)).alias("n"))
    shares = reduce(DataFrame.unionByName, orders)
    return shares.groupBy("model").applyInPandas(_pack, "model string, table binary")


def language_models(texts: DataFrame) -> DataFrame:
    """Models of texts (fold 0 or 1, lang, hypothesis) as rows (lang, kind, table), kept as a table.

    Every language that has text has a model "all", and "not0" and "not1" without each fold where that leaves
    any text; the language "" stands for all together.
    """
    counts = materialize(gram_counts(texts), "grams")
    lang = F.when(F.col("lang") != ANY, F.array(F.lit(ANY), F.col("lang"))).otherwise(F.array(F.lit(ANY)))
    wholes = [F.lit("all/"), F.when(F.col("fold") == 0, "not1/").otherwise("not0/")]
    under = lambda whole: F.transform(lang, lambda x: F.concat(whole, x))
    names = F.flatten(F.array(*map(under, wholes)))
    found = train(counts.select(F.explode(names).alias("model"), "gram", "n"))
    kind = F.substring_index("model", "/", 1)
    name = F.expr("substring(model, instr(model, '/') + 1)")
    return materialize(found.select(name.alias("lang"), kind.alias("kind"), "table"), "models")


def train_languages(texts: DataFrame) -> tuple[dict[str, bytes], list[dict[str, bytes]]]:
    """The ``language_models`` on the driver, for a look at them: all, and those without each fold."""
    found = [(r["kind"], r["lang"], bytes(r["table"])) for r in language_models(texts).collect()]
    part = lambda of: {lang: table for kind, lang, table in found if kind == of}
    return part("all"), [part("not0"), part("not1")]


def perplexities(edges: DataFrame, models: DataFrame) -> DataFrame:
    """edge_id, lang, model (the language whose model holds for it), perplexity and held_out of every hypothesis.

    ``models`` as from ``language_models``. Texts meet the models of their language by (language, group), in groups
    of about ``GROUP_CHARS`` characters. ``held_out`` is the perplexity under the model of its language without the
    row's fold, or if there is none, without the fold of all languages, or else ``perplexity``.
    """

    def score(texts: pa.Table, packed: pa.Table) -> pa.Table:
        symbols = _symbol_table()
        tables = {kind: log_table(table) for kind, table in zip(packed["kind"].to_pylist(), packed["table"].to_pylist())}
        found = []
        for text, fold in zip(texts["hypothesis"].to_pylist(), texts["fold"].to_pylist()):
            if not text or not tables:
                found.append((None, None))
                continue
            grams = _grams(text, symbols)
            used = (tables["all"], tables.get(f"not{fold}", tables["all"]))
            found.append([float(np.exp(-t[grams].mean(dtype=np.float64))) for t in used])
        scores = {n: pa.array([f[k] for f in found], pa.float64()) for k, n in enumerate(("perplexity", "held_out"))}
        return pa.table({n: texts[n] for n in ("edge_id", "lang", "model")} | scores)

    own = models.filter("kind = 'all'").select("lang")
    # a language whose texts are all in one fold borrows from all languages
    lacking = own.select("lang", F.explode(F.array(F.lit("not0"), F.lit("not1"))).alias("kind")).join(
        models.select("lang", "kind"), ["lang", "kind"], "left_anti"
    )
    borrowed = lacking.join(models.filter(F.col("lang") == ANY).select("kind", "table"), "kind")
    whole = models.unionByName(borrowed).withColumnRenamed("lang", "model")

    lang, text = F.col("lang").cast("string"), F.col("hypothesis").cast("string")
    narrow = edges.select("edge_id", lang.alias("lang"), text.alias("hypothesis"), "fold")
    named = narrow.join(own.select(F.col("lang").alias("_own")), F.col("lang") == F.col("_own"), "left")
    named = named.withColumn("model", F.coalesce("_own", F.lit(ANY))).drop("_own")
    chars = F.sum(F.coalesce(F.length("hypothesis"), F.lit(0)) + 1)
    groups = named.groupBy("model").agg(F.ceil(chars / GROUP_CHARS).cast("bigint").alias("_groups"))
    groups = materialize(groups, "groups")
    dealt = named.join(groups, "model").withColumn(
        "_group", F.pmod(F.xxhash64("edge_id", "hypothesis"), F.col("_groups"))
    )
    sent = whole.join(groups, "model").withColumn("_group", F.explode(F.sequence(F.lit(0), F.col("_groups") - 1)))
    kind = narrow.schema["edge_id"].dataType.simpleString()
    return (
        dealt.select("edge_id", "lang", "hypothesis", "fold", "model", "_group")
        .groupBy("model", "_group")
        .cogroup(sent.select("model", "_group", "kind", "table").groupBy("model", "_group"))
        .applyInArrow(score, f"edge_id {kind}, lang string, model string, perplexity double, held_out double")
    )


def thresholds(scored: DataFrame, quantile: float = KEEP_QUANTILE) -> DataFrame:
    """Quantile of held_out (in thousandths, rounded up) by model, and of all texts for the model ""."""
    step = F.ceil(F.col("held_out") * _STEP).alias("_step")
    counted = scored.filter("held_out IS NOT NULL").groupBy("model", step).agg(F.count(F.lit(1)).alias("_n"))
    own = counted.filter(F.col("model") != ANY)
    pooled = counted.groupBy("_step").agg(F.sum("_n").alias("_n")).select(F.lit(ANY).alias("model"), "_step", "_n")
    counted = own.unionByName(pooled)
    below = F.sum("_n").over(W.partitionBy("model").orderBy("_step"))
    total = F.sum("_n").over(W.partitionBy("model"))
    ranked = counted.select("model", "_step", below.alias("_below"), total.alias("_all"))
    reached = ranked.filter(F.col("_below") >= F.col("_all") * F.lit(quantile))
    return reached.groupBy("model").agg((F.min("_step") / _STEP).alias("threshold"))


def classify(edges: DataFrame, trusted: DataFrame, quantile: float = KEEP_QUANTILE, folded: bool = True) -> DataFrame:
    """Keep the edges whose hypothesis reads like the trusted ones.

    ``edges`` needs edge_id, lang and hypothesis, ``trusted`` edge_id; other columns are not read. One row for
    each row of ``edges``: edge_id, lang, perplexity of the hypothesis per character, threshold of its language and kept.

    A language's model comes from all its trusted texts; languages without any, and null, use that of all
    trusted texts together. Thresholds are quantiles of trusted texts, too, but each scored by a model of the
    other half of them (dealt by a hash of edge_id), as a model knows the texts it was trained on. A null or
    empty hypothesis has no perplexity and is not kept; if nothing is trusted, nothing is kept. Rows that repeat an
    edge_id are judged each; null ids are never trusted.

    ``folded`` models know the 32 symbols above. Otherwise every code point is a symbol of its own and what is counted
    grows with the texts (``open_model``).
    """
    known = trusted.select("edge_id").filter("edge_id IS NOT NULL").distinct()
    fold = F.pmod(F.xxhash64("edge_id"), F.lit(2)).cast("int").alias("fold")
    texts = edges.select("edge_id", "lang", "hypothesis", fold)
    learnt = texts.join(known, "edge_id", "left_semi")
    found = perplexities(texts, language_models(learnt)) if folded else open_model.perplexities(texts, open_model.levels(learnt))
    scored = materialize(found, "perplexity", release=True)
    limits = thresholds(scored.join(known, "edge_id", "left_semi"), quantile)
    # one row for each language at most
    joined = scored.join(limits, "model", "left")
    kept = F.coalesce(F.ceil(F.col("perplexity") * _STEP) <= F.col("threshold") * _STEP, F.lit(False))
    return joined.select("edge_id", "lang", "perplexity", "threshold", kept.alias("kept"))
