"""Language of archived payloads by Bayesian evidence: text, declared language, address suffix and host priors."""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barline.session import materialize

#: slots that the runs of three letters are hashed to
SLOTS = 1 << 15

#: share of the text's log-likelihood that counts: neighbouring runs of letters are not independent
TEXT_WEIGHT = 1 / 3

#: documents that the level above is worth in a host's or domain's prior, and in the table of a declared language or suffix
PRIOR_WEIGHT, EVIDENCE_WEIGHT = 4.0, 2.0

_HIDDEN = re.compile(r"(?is)<(script|style)\b.*?(</\1\s*>|\Z)|<!--.*?(-->|\Z)")
_TAG = re.compile(r"(?s)<[^>]*>")
_DECLARED = re.compile(r"(?is)<html\b[^>]*?\blang\s*=\s*[\"']?\s*([a-z]{2,3})\b")


def visible_text(payload: str) -> str:
    """Text of a page without scripts, styles, comments and tags."""
    return html.unescape(_TAG.sub(" ", _HIDDEN.sub(" ", payload)))


def _slots(text: str) -> np.ndarray:
    """Slots of the runs of three UTF-16 units of a lower-case text; runs without a letter are left out."""
    units = np.frombuffer((" " + text.lower() + " ").encode("utf-16-le", "surrogatepass"), "<u2").astype(np.uint64)
    letter = (units >= 97) & (units <= 122) | (units >= 0xC0)
    units = np.where(letter, units, np.uint64(32))
    a, b, c = units[:-2], units[1:-1], units[2:]
    used = (b != 32) | (a != 32) & (c != 32)
    code = ((a << np.uint64(32)) | (b << np.uint64(16)) | c)[used] * np.uint64(0x9E3779B97F4A7C15)
    return (code >> np.uint64(64 - SLOTS.bit_length() + 1)).astype(np.intp)


def _known(lang: Column) -> Column:
    code = F.lower(F.regexp_extract(F.coalesce(lang.cast("string"), F.lit("")), r"^\s*([A-Za-z]{2,3})(?![A-Za-z])", 1))
    return F.nullif(code, F.lit(""))


def train(texts: DataFrame) -> dict[str, np.ndarray]:
    """Log-probabilities of the slots in every language of (lang, hypothesis), of counts over all texts.

    Languages are codes of two or three letters (what follows a dash is left out); texts without one are not
    used. A language takes 128 KB on the driver and in each task.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        for batch in batches:
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                counts = sums.setdefault(lang, np.zeros(SLOTS, np.int64))
                counts += np.bincount(_slots(text or ""), minlength=SLOTS)
        for lang, counts in sums.items():
            seen = np.flatnonzero(counts)
            yield pa.RecordBatch.from_arrays(
                [pa.array([lang] * len(seen)), pa.array(seen, pa.int64()), pa.array(counts[seen])], names=["lang", "slot", "n"]
            )

    def pack(rows: pd.DataFrame) -> pd.DataFrame:
        counts = np.full(SLOTS, 0.5)
        counts[rows["slot"].to_numpy()] += rows["n"].to_numpy()
        table = np.log(counts / counts.sum()).astype("<f4").tobytes()
        return pd.DataFrame({"lang": [rows["lang"].iloc[0]], "table": [table]})

    named = texts.select(_known(F.col("lang")).alias("lang"), F.col("hypothesis").cast("string")).filter("lang IS NOT NULL")
    counted = named.mapInArrow(run, "lang string, slot bigint, n bigint").groupBy("lang", "slot").agg(F.sum("n").alias("n"))
    packed = counted.groupBy("lang").applyInPandas(pack, "lang string, table binary").collect()
    return {r["lang"]: np.frombuffer(r["table"], "<f4") for r in sorted(packed)}


def _evidence(captures: DataFrame, models: dict[str, np.ndarray], carry: tuple[str, ...]) -> DataFrame:
    """Text log-likelihoods (per language, the largest 0), declared language, suffix, domain and host of captures."""
    names = sorted(models)
    matrix = np.stack([models[n] for n in names])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            scores, declared = [], []
            for payload in batch.column(1).to_pylist():
                page = payload is not None and payload.lstrip()[:1] == "<"
                m = _DECLARED.search(payload) if page else None
                declared.append(m[1].lower() if m else None)
                slots = _slots(visible_text(payload) if page else payload or "")
                found = matrix[:, slots].sum(axis=1, dtype=np.float64) if len(slots) else np.zeros(len(names))
                scores.append(found - found.max())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(declared, pa.string()), pa.array(scores, pa.list_(pa.float64())), *batch.columns[2:]],
                names=["event_id", "declared", "scores", "url", *carry],
            )

    narrow = captures.select("event_id", F.col("payload").cast("string").alias("payload"), F.col("url").cast("string").alias("url"), *carry)
    kinds = {f.name: f.dataType.simpleString() for f in narrow.schema}
    extra = "".join(f", {c} {kinds[c]}" for c in carry)
    rows = narrow.mapInArrow(
        run, f"event_id {kinds['event_id']}, declared string, scores array<double>, url string{extra}"
    )
    host = F.lower(F.regexp_extract(F.coalesce("url", F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#:@]+)", 1))
    rows = rows.withColumn("host", F.nullif(host, F.lit("")))
    labels = F.split("host", r"\.")
    rows = rows.withColumn("domain", F.array_join(F.slice(labels, F.greatest(F.size(labels) - 2, F.lit(1)), 3), "."))
    suffix = F.when(F.size(labels) > 1, F.element_at(labels, -1))
    return rows.withColumn("suffix", suffix)


def _posterior(logs: Column) -> Column:
    """Probabilities that are in proportion to the exponentials."""
    top = F.array_max(logs)
    weights = F.transform(logs, lambda x: F.exp(x - top))
    total = F.aggregate(weights, F.lit(0.0), lambda acc, x: acc + x)
    return F.transform(weights, lambda x: x / total)


def identify(captures: DataFrame, models: dict[str, np.ndarray], carry: tuple[str, ...] = ()) -> DataFrame:
    """Language of archived captures.

    ``captures`` needs event_id, url and payload (HTML, or plain text); the columns named in ``carry`` go with
    the rows (their names must not be among those added), others are not read. One row for each row: event_id,
    lang (null if there is no model at all), confidence, text_lang (by the text alone, null for texts without
    letters), declared (of the html element), suffix (last label of the host) and the carried columns.

    Texts give likelihoods of runs of three letters. Their normalised likelihoods, added up by declared language, by suffix and by
    host in grouped aggregates over all captures, say how likely a declaration or suffix is in each language
    and what a host holds. A host's prior is smoothed towards its domain's (the last three labels at most),
    that towards all captures'; a capture's own share is taken out of each sum. Missing evidence counts as
    none. Ties go to the first code. Rows are judged each, whether ids repeat or are null.
    """
    names = sorted(models)
    if not names:
        none = F.lit(None).cast("string")
        return captures.select(
            "event_id", none.alias("lang"), F.lit(None).cast("double").alias("confidence"),
            none.alias("text_lang"), none.alias("declared"), none.alias("suffix"), *carry,
        )
    size = len(names)
    rows = _evidence(captures, models, carry)
    rows = rows.withColumn("own", _posterior(F.transform("scores", lambda x: x * TEXT_WEIGHT)))
    rows = materialize(rows, "evidence")

    def summed(*keys: str) -> DataFrame:
        sums = [F.sum(F.get("own", F.lit(k))).alias(f"_{k}") for k in range(size)]
        return rows.groupBy(*keys).agg(*sums).select(*keys, F.array(*(f"_{k}" for k in range(size))).alias("_sums"))

    total = rows.agg(*(F.coalesce(F.sum(F.get("own", F.lit(k))), F.lit(0.0)) for k in range(size))).first()
    total = F.array(*(F.lit(round(float(x), 6)) for x in total))
    zeros = F.array(*(F.lit(0.0) for _ in names))
    joined = rows
    for key in ("declared", "suffix", "domain", "host"):
        sums = summed(key).filter(F.col(key).isNotNull()).withColumnRenamed("_sums", f"_{key}")
        joined = joined.join(sums, key, "left")

    def others(sums: Column) -> Column:
        """What the other captures have added to a sum."""
        return F.zip_with(F.coalesce(sums, F.col("own")), "own", lambda s, o: F.greatest(s - o, F.lit(0.0)))

    def prior(sums: Column, above: Column) -> Column:
        n = F.aggregate(sums, F.lit(0.0), lambda acc, x: acc + x)
        return F.zip_with(sums, above, lambda s, a: (s + PRIOR_WEIGHT * a) / (n + PRIOR_WEIGHT))

    def likelihood(sums: Column) -> Column:
        """Of evidence, in each language: its captures with the evidence among all its captures."""
        share = F.aggregate(sums, F.lit(0.0), lambda acc, x: acc + x) / F.greatest(
            F.aggregate(others(total), F.lit(0.0), lambda acc, x: acc + x), F.lit(1.0)
        )
        return F.zip_with(
            sums, others(total), lambda s, t: (s + EVIDENCE_WEIGHT * (share + 1e-6)) / (t + EVIDENCE_WEIGHT)
        )

    flat = F.transform(zeros, lambda _: F.lit(1.0 / size))
    joined = joined.withColumn("_all", prior(others(total), flat))
    joined = joined.withColumn("_domain", prior(others(F.col("_domain")), F.col("_all")))
    joined = joined.withColumn("_host", prior(others(F.col("_host")), F.col("_domain")))
    logs = F.zip_with(
        F.transform("scores", lambda x: x * TEXT_WEIGHT), "_host", lambda x, p: x + F.log(p)
    )
    for key in ("declared", "suffix"):
        logs = F.when(F.col(key).isNull(), logs).otherwise(
            F.zip_with(logs, likelihood(others(F.col(f"_{key}"))), lambda x, p: x + F.log(p))
        )
    codes = F.array(*(F.lit(n) for n in names))
    best = lambda values: F.element_at(codes, F.array_position(values, F.array_max(values)).cast("int"))
    judged = joined.withColumn("_posterior", _posterior(logs))
    return judged.select(
        "event_id",
        best(F.col("_posterior")).alias("lang"),
        F.round(F.array_max("_posterior"), 6).alias("confidence"),
        F.when(F.array_min("scores") < 0, best(F.col("scores"))).alias("text_lang"),
        "declared",
        "suffix",
        *carry,
    )
