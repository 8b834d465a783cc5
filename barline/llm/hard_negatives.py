"""Hard negatives among feature snapshots: exact scores from matrix products modulo small primes."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from barline.session import materialize

# The largest primes below 1,024. A sum of 64 products of their balanced residues stays below 2^24, so
# float32 holds it exactly.
PRIMES = (1021, 1019, 1013, 1009, 997, 991)
RUN = 64

#: scores above are refused: a hundredfold must fit into 64 bits
MAX_SCORE = 1 << 56

#: components in a block of rows, and of anchors
BLOCK_VALUES = 1 << 22
#: scores that are held at once
STRIP_SCORES = 1 << 22

_NONE = np.iinfo(np.int64).min + 1


def primes_for(bound: int) -> tuple[int, ...]:
    """As many primes as tell all scores from -bound to bound apart."""
    product, k = 1, 0
    while product <= 2 * bound:
        if k == len(PRIMES):
            raise ValueError(f"scores up to {bound} are beyond {math.prod(PRIMES) // 2}")
        product, k = product * PRIMES[k], k + 1
    return PRIMES[:k]


def residues(x: np.ndarray, primes: tuple[int, ...]) -> list[np.ndarray]:
    """Balanced residues of an integer matrix, one float32 matrix per prime."""
    return [((x + p // 2) % p - p // 2).astype(np.float32) for p in primes]


def products(left: list[np.ndarray], right: list[np.ndarray], primes: tuple[int, ...]) -> np.ndarray:
    """Exact signed products of rows: float32 products modulo each prime, joined by Chinese remaindering."""
    score = np.zeros((len(left[0]), len(right[0])), np.int64)
    base = 1
    for k, p in enumerate(primes):
        a, b = left[k], right[k]
        total = np.zeros(score.shape, np.int64)
        for at in range(0, a.shape[1], RUN):
            total += (a[:, at : at + RUN] @ b[:, at : at + RUN].T).astype(np.int64)
        # the next digit in mixed radix, balanced
        digit = (total - score) % p * pow(base, -1, p) % p
        score += np.where(digit > p // 2, digit - p, digit) * base
        base *= p
    return score


def _first(score: np.ndarray, allowed: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, column) of the k best allowed scores of each row; on a tie the columns that come first."""
    masked = np.where(allowed, score, _NONE)
    k = min(k, masked.shape[1])
    edge = -np.partition(-masked, k - 1, axis=1)[:, k - 1 : k] if k else masked[:, :0]
    above = masked > edge
    level = (masked == edge) & allowed
    room = k - above.sum(1, keepdims=True)
    return np.nonzero(above | (level & (level.cumsum(1) <= room)))


def _matrix(column: pa.ChunkedArray, width: int) -> np.ndarray:
    lists = column.combine_chunks()
    x = np.zeros((len(lists), width), np.int64)
    counts = lists.value_lengths().to_numpy(zero_copy_only=False)
    values = lists.flatten().to_numpy(zero_copy_only=False)
    if len(values):
        x[np.repeat(np.arange(len(lists)), counts), np.arange(len(values)) - np.repeat(np.cumsum(counts) - counts, counts)] = values
    return x


def _by_key(rows: pa.Table) -> pa.Table:
    return rows.sort_by([("ts", "ascending"), ("_row", "ascending")])  # nulls come last


def _scored(width: int, primes: tuple[int, ...]):
    """Scores of the anchors of a block with its rows, strip by strip: (anchors' numbers, scores)."""

    def run(anchors: pa.Table, rows: pa.Table) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        right = residues(_matrix(rows.column("_parts"), width), primes)
        parts = anchors.column("_parts").combine_chunks()
        step = max(1, STRIP_SCORES // max(1, rows.num_rows))
        for lo in range(0, anchors.num_rows, step):
            strip = np.arange(lo, min(lo + step, anchors.num_rows))
            left = residues(_matrix(pa.chunked_array([parts.slice(lo, step)]), width), primes)
            yield strip, products(left, right, primes)

    return run


def _best_positives(width: int, primes: tuple[int, ...], n_positives: int):
    scored = _scored(width, primes)

    def run(anchors: pa.Table, rows: pa.Table) -> pa.Table:
        rows = _by_key(rows)
        labels, rows_at = rows.column("_label").to_numpy(), rows.column("_row").to_numpy()
        own, own_at = anchors.column("_label").to_numpy(), anchors.column("_row").to_numpy()
        a, b, s = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for strip, score in scored(anchors, rows) if rows.num_rows else ():
            allowed = (own[strip, None] == labels) & (own_at[strip, None] != rows_at)
            i, j = _first(score, allowed, n_positives)
            a.append(strip[i]), b.append(j), s.append(score[i, j])
        a, b, s = np.concatenate(a), np.concatenate(b), np.concatenate(s)
        return pa.table(
            {
                "_anchor": anchors.column("_row").take(pa.array(a)),
                "positive_ts": rows.column("ts").take(pa.array(b)),
                "_positive": rows.column("_row").take(pa.array(b)),
                "positive_score": pa.array(s),
            }
        )

    return run


def _windowed(width: int, primes: tuple[int, ...], n_negatives: int, low: int, high: int):
    scored = _scored(width, primes)

    def run(anchors: pa.Table, rows: pa.Table) -> pa.Table:
        rows = _by_key(rows)
        labels, own = rows.column("_label").to_numpy(), anchors.column("_label").to_numpy()
        wanted = anchors.column("_positives").to_pylist()
        out: dict[str, list] = {n: [] for n in ("_anchor", "anchor_ts", "_positive", "positive_ts", "positive_score")}
        columns, scores = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        ids, at = anchors.column("ts").to_pylist(), anchors.column("_row").to_pylist()
        for strip, score in scored(anchors, rows) if rows.num_rows else ():
            other, hundred = own[strip, None] != labels, 100 * score
            for k in range(max(len(wanted[i]) for i in strip)):
                has = np.array([len(wanted[i]) > k for i in strip])
                bar = np.array([wanted[i][k]["positive_score"] if len(wanted[i]) > k else 0 for i in strip], np.int64)[:, None]
                inside = other & has[:, None] & (hundred >= low * bar) & (hundred <= high * bar)
                i, j = _first(score, inside, n_negatives)
                columns.append(j), scores.append(score[i, j])
                for n in strip[i].tolist():
                    p = wanted[n][k]
                    for name, value in zip(out, (at[n], ids[n], p["_positive"], p["positive_ts"], p["positive_score"])):
                        out[name].append(value)
        j = pa.array(np.concatenate(columns))
        kind = anchors.schema.field("ts").type
        types = (pa.int64(), kind, pa.int64(), kind, pa.int64())
        return pa.table(
            {n: pa.array(v, t) for (n, v), t in zip(out.items(), types)}
            | {"negative_ts": rows.column("ts").take(j), "_negative": rows.column("_row").take(j), "negative_score": pa.array(np.concatenate(scores))}
        )

    return run


def hard_negatives(
    snapshots: DataFrame,
    anchor: Column,
    n_positives: int = 5,
    n_negatives: int = 3,
    low: int = 50,
    high: int = 95,
    scale: int = 256,
    block_values: int = BLOCK_VALUES,
) -> DataFrame:
    """For each anchor and positive, the snapshots of another regime that score nearly as high.

    ``snapshots`` holds a row of the feature matrix per bar: ts (any orderable key), features (numbers in a fixed
    order) and regime (its label). ``anchor`` is a condition on these columns. Each feature x becomes
    floor(``scale`` * x), as a double; a score is the integer inner product with the anchor's, exactly. Higher scores
    come first, on a tie the smaller ts. An anchor's positives are its first ``n_positives`` other rows of the same
    regime; of the rows of other regimes with low * positive_score <= 100 * negative_score <= high * positive_score
    the first ``n_negatives`` are returned: anchor_ts, positive_ts, rank (from 1), negative_ts, positive_score,
    negative_score.

    Rows are dealt into blocks, and every block of anchors meets every block of rows once for the positives and once
    for the negatives. In a block, matrices of residues modulo as many primes below 1,024 as the largest score needs
    are multiplied in float32, without rounding, and joined by Chinese remaindering. Each block gives the few best
    per anchor; a ranking window keeps the first of those.

    Rows with a null regime, null features or any null or non-finite feature take no part; a null ts comes last on
    ties and stays null. Shorter vectors count as padded with zeros. Repeated rows are rows of their own; other
    columns are ignored; an empty table, or one without anchors, gives an empty one. Scores of more than 2^56 are
    refused.
    """
    spark = snapshots.sparkSession
    value = F.col("features").cast("array<double>")
    bad = F.exists(value, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    rows = snapshots.select(
        "ts",
        F.xxhash64("regime").alias("_label"),  # compared, never shown
        F.coalesce(anchor, F.lit(False)).alias("_is_anchor"),
        F.when(F.col("regime").isNotNull() & ~bad, F.transform(value, lambda x: F.floor(F.lit(float(scale)) * x))).alias("_values"),
    ).filter("_values IS NOT NULL")
    squares = F.aggregate("_values", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double"))
    rows = materialize(rows.withColumn("_square", squares), "snapshots")
    size = rows.agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if("_is_anchor").alias("anchors"),
        F.max(F.size("_values")).alias("width"),
        F.max("_square").alias("square"),
    ).head()
    bound = math.ceil((size["square"] or 0.0) * (1 + 1e-9)) + 1
    if bound > MAX_SCORE:
        raise ValueError("scores would exceed 2^56: scale the features down")
    width, primes = size["width"] or 0, primes_for(bound)

    def blocks(n: int) -> int:
        return max(1, math.ceil(n * max(1, width) / block_values))

    cores = spark.sparkContext.defaultParallelism
    # a few blocks of rows for each core, of 1,024 rows at least, whatever the number of anchors
    n_rows = max(blocks(size["n"]), min(2 * cores, math.ceil(size["n"] / 1024)), 1)
    n_anchors = blocks(size["anchors"])
    # read back from files, a row keeps its number when a task is repeated
    rows = rows.select(
        "ts", "_label", "_is_anchor", F.col("_values").alias("_parts"), F.monotonically_increasing_id().alias("_row")
    )

    def numbers(n: int) -> Column:
        return F.explode(F.sequence(F.lit(0), F.lit(n - 1)))

    def dealt(n: int) -> Column:
        return F.pmod(F.xxhash64("_row"), F.lit(n)).cast("int")

    left = rows.filter("_is_anchor").select("ts", "_label", "_parts", "_row", dealt(n_anchors).alias("_q"))
    right = rows.select("ts", "_label", "_parts", "_row", dealt(n_rows).alias("_r"), numbers(n_anchors).alias("_q"))
    key = rows.schema["ts"].dataType.simpleString()

    def met(anchors: DataFrame, run, schema: str) -> DataFrame:
        spread = anchors.withColumn("_r", numbers(n_rows))
        return spread.groupBy("_q", "_r").cogroup(right.groupBy("_q", "_r")).applyInArrow(run, schema)

    def first(df: DataFrame, by: list[str], score: str, ts: str, at: str, n: int, rank: str) -> DataFrame:
        order = W.partitionBy(*by).orderBy(F.desc(score), F.asc_nulls_last(ts), at)
        return df.withColumn(rank, F.row_number().over(order)).filter(F.col(rank) <= n)

    found = met(left, _best_positives(width, primes, n_positives), f"_anchor bigint, positive_ts {key}, _positive bigint, positive_score bigint")
    found = first(found, ["_anchor"], "positive_score", "positive_ts", "_positive", n_positives, "_k")
    found = found.groupBy(F.col("_anchor").alias("_row")).agg(
        F.sort_array(F.collect_list(F.struct("_k", "_positive", "positive_ts", "positive_score"))).alias("_positives")
    )
    with_bars = materialize(left.join(found, "_row").select("ts", "_label", "_parts", "_row", "_q", "_positives"), "positives")
    picked = met(
        with_bars,
        _windowed(width, primes, n_negatives, low, high),
        f"_anchor bigint, anchor_ts {key}, _positive bigint, positive_ts {key}, positive_score bigint, negative_ts {key}, "
        "_negative bigint, negative_score bigint",
    )
    picked = first(picked, ["_anchor", "_positive"], "negative_score", "negative_ts", "_negative", n_negatives, "rank")
    return picked.select("anchor_ts", "positive_ts", "rank", "negative_ts", "positive_score", "negative_score")
