"""Research tables: point-in-time views, feature statistics, scans, events, overlap.

Ranks and quantiles come from positions in value order. Values are cut into pieces
at approximate quantiles first (exact positions within and across the pieces), so
neither a list of values nor a sorted group ever sits in one task.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from barline.functions.normal import norm_cdf
from barline.operators.series import (
    BLK,
    CORE,
    POS,
    Frames,
    add_windowed,
    blocks,
    core_rows,
    latest,
    running,
)
from barline.session import materialize

#: distinct values of a piece that one task sorts
PIECE_VALUES = 1 << 18


def with_value_piece(counts: DataFrame, keys: Sequence[str], value: str, piece_values: int = PIECE_VALUES) -> DataFrame:
    """Add a piece number that rises with ``value`` within a key; ``counts`` has one row per (key, value).

    Borders are approximate quantiles of the distinct values (a mergeable sketch per key); any border set gives
    exact ranks, balanced borders give even pieces. There are as many pieces as the largest key needs.
    """
    most = counts.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).agg(F.max("_n")).head()[0] or 0
    pieces = -(-most // piece_values)
    if pieces <= 1:
        return counts.withColumn("_piece", F.lit(0).cast("bigint"))
    qs = [i / pieces for i in range(1, pieces)]
    borders = counts.groupBy(*keys).agg(F.percentile_approx(value, qs, max(1000, 10 * pieces)).alias("_borders"))
    below = F.size(F.filter("_borders", lambda b: b < F.col(value))).cast("bigint")
    return counts.join(borders, list(keys)).withColumn("_piece", below).drop("_borders")


def value_places(df: DataFrame, keys: Sequence[str], value: str, piece_values: int = PIECE_VALUES) -> DataFrame:
    """(keys, value, _cnt, _upto): how often each distinct value occurs and how many values of the key are at most it.

    Values are counted before anything is sorted, so equal ones are one row however many there are. Rows without a
    value are left out; a null key is a key like any other.
    """
    keys = list(keys)
    one = F.struct(*keys).alias("_k")
    counts = df.filter(F.col(value).isNotNull()).groupBy(one, value).agg(F.count(F.lit(1)).alias("_cnt"))
    pieces = with_value_piece(materialize(counts, "value_counts"), ["_k"], value, piece_values)
    cum = running(pieces, ["_k"], value, F.col("_piece"), {"_upto": ("sum", F.col("_cnt"))})
    return cum.select("_k.*", value, "_cnt", "_upto")


def rank_table(df: DataFrame, keys: Sequence[str], value: str, out: str) -> DataFrame:
    """(keys, value, rank) for every distinct value: 1-based, ties share their mean rank."""
    return value_places(df, keys, value).select(
        *keys, value, (F.col("_upto") - F.col("_cnt") + (F.col("_cnt") + 1) / 2.0).alias(out)
    )


def exact_quantiles(
    df: DataFrame, keys: Sequence[str], value: str, qs: Sequence[float], piece_values: int = PIECE_VALUES
) -> DataFrame:
    """Linear-interpolated quantiles per key: rows (keys, q, quantile).

    A key without values has none; a null key is a key like any other.
    """
    keys = list(keys)
    places = value_places(df, keys, value, piece_values).withColumn("_k", F.struct(*keys))
    places = materialize(places.select("_k", value, "_cnt", "_upto"), "value_places")
    sizes = places.groupBy("_k").agg((F.max("_upto") - 1).alias("_m"))
    at = [F.col("_m") * F.lit(float(q)) for q in qs]
    ends = F.array(*[F.struct(F.lit(float(q)).alias("q"), a.alias("at"), end(a).alias("pos")) for q, a in zip(qs, at) for end in (F.floor, F.ceil)])
    # the wanted places of a key go along with each of its values, which keeps those that it covers
    met = places.join(sizes.select("_k", ends.alias("_ends")), "_k")
    first = F.col("_upto") - F.col("_cnt")
    covered = F.filter("_ends", lambda e: (e["pos"] >= first) & (e["pos"] < F.col("_upto")))
    found = met.select("_k", value, F.explode(covered).alias("_e"))
    frac = F.col("_e.at") - F.floor("_e.at")
    part = F.max(frac).alias("_frac")
    return (
        found.groupBy("_k", F.col("_e.q").alias("q"))
        .agg(F.min(value).alias("_lo"), F.max(value).alias("_hi"), part)
        .select("_k.*", "q", (F.col("_lo") + (F.col("_hi") - F.col("_lo")) * F.col("_frac")).alias("quantile"))
    )


# ------------------------------------------------------------------- point in time


def as_of_view(
    metrics: DataFrame, as_of: int, pit_lag_ms: Column | int = 0, keys: Sequence[str] = ("metric_id", "ts")
) -> DataFrame:
    """Newest revision per (metric, ts) known at ``as_of``; a value shows from ts + lag on."""
    lag = F.lit(pit_lag_ms) if isinstance(pit_lag_ms, int) else pit_lag_ms
    known = metrics.filter((F.col("ingested_at") <= as_of) & (F.col("ts") + lag <= as_of))
    return latest(known, list(keys), F.col("ingested_at"), ["ingested_at", "value"])


# --------------------------------------------------------------- feature statistics


def melt(df: DataFrame, ids: Sequence[str], columns: Sequence[str], name: str, value: str) -> DataFrame:
    return df.unpivot(list(ids), list(columns), name, value).filter(F.col(value).isNotNull())


#: rows of a table whose values go to their pieces together, and bits of the row numbers of a block
_DEAL_ROWS, _BLOCK_BITS = 1 << 17, 16

#: features, and labels, that are ranked together
_SIDE_COLUMNS = 16


def _cut_bytes(at: np.ndarray, *columns: np.ndarray) -> list[pa.Array]:
    """The bytes of each part of columns, which begin at the rows ``at``."""
    made = []
    for v in columns:
        width = v.nbytes // max(1, len(v))
        ends = (np.append(at, len(v)) * width).astype(np.int64)
        data = pa.Array.from_buffers(pa.large_binary(), len(at), [None, pa.py_buffer(ends), pa.py_buffer(np.ascontiguousarray(v))])
        made.append(data.cast(pa.binary()))
    return made


def _narrow(v: np.ndarray) -> np.ndarray:
    """Whole numbers in as few bytes as hold them."""
    least, most = (v.min(), v.max()) if v.size else (0, 0)
    return v.astype(next(k for k in (np.int8, np.int16, np.int32, np.int64) if np.iinfo(k).min <= least and most <= np.iinfo(k).max))


def _widened(data: pa.Scalar, count: int) -> np.ndarray:
    """``count`` whole numbers of the bytes of ``_narrow``."""
    held = memoryview(data.as_buffer())
    return np.frombuffer(held, f"i{len(held) // count}" if count else np.int8).astype(np.int64)


def _joined_bytes(column: pa.ChunkedArray | pa.Array, kind: type) -> np.ndarray:
    return np.frombuffer(b"".join(memoryview(v.as_buffer()) for v in column), kind)


def _cuts(*columns: np.ndarray) -> np.ndarray:
    """Where a run of equal rows begins."""
    new = np.zeros(len(columns[0]), bool)
    new[:1] = True
    for v in columns:
        new[1:] |= v[1:] != v[:-1]
    return np.flatnonzero(new)


def _dealt_values(rows: DataFrame, columns: Sequence[str], partners: list[int], borders: dict) -> DataFrame:
    """(_g, _col, _piece, _part, _ids, _v, _mask) of rows (_g, _id, columns): values that have a partner, in pieces in value order.

    Bit k of a mask tells that the k-th partner of the column is there. A border that comes several times is a value of
    many rows: it is a piece by itself (of an odd number), in as many parts.
    """

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def flush(held: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            table = pa.Table.from_batches(held)
            table = table.take(pc.sort_indices(table.column("_g"))).combine_chunks()
            g, ids = table.column("_g").to_numpy(), table.column("_id").to_numpy()
            there = np.stack([pc.is_valid(table.column(c)).to_numpy() for c in columns])
            for c, name in enumerate(columns):
                mask = np.zeros(len(g), np.int32)
                for bit, other in enumerate(k for k, side in enumerate(partners) if side != partners[c]):
                    mask |= there[other].astype(np.int32) << bit
                own = np.flatnonzero(there[c] & (mask != 0))
                if not len(own):
                    continue
                v = table.column(name).to_numpy()[own].astype(float)
                group, own_ids = g[own], ids[own]
                piece, part = np.zeros((2, len(own)), np.int64)
                ends = _cuts(group)
                for lo, hi in zip(ends, np.append(ends[1:], len(own))):
                    if (group[lo], c) in borders:
                        border, times = borders[group[lo], c]
                        at = np.searchsorted(border, v[lo:hi], "left")
                        near = np.minimum(at, len(border) - 1)
                        hot = (border[near] == v[lo:hi]) & (times[near] > 1)
                        piece[lo:hi] = 2 * at + hot
                        part[lo:hi] = np.where(hot, (own_ids[lo:hi] >> bits) % times[near], 0)
                order = np.lexsort((part, piece, group))
                group, piece, part = group[order], piece[order], part[order]
                at = _cuts(group, piece, part)
                parts = _cut_bytes(at, own_ids[order], v[order], mask[own][order])
                head = [pa.array(k) for k in (group[at], np.full(len(at), c), piece[at], part[at])]
                yield pa.RecordBatch.from_arrays([*head, *parts], names=names)

        held = []
        for batch in batches:
            held.append(batch)
            if sum(x.num_rows for x in held) >= limit:
                yield from flush(held)
                held = []
        if held:
            yield from flush(held)

    names, limit, bits = ["_g", "_col", "_piece", "_part", "_ids", "_v", "_mask"], _DEAL_ROWS, _BLOCK_BITS
    return rows.mapInArrow(deal, "_g bigint, _col bigint, _piece bigint, _part bigint, _ids binary, _v binary, _mask binary")


def _ranked_piece(piece: pa.Table, sides: list[int], bits: int) -> pa.Table:
    """Twice the ranks in a piece of one column, a row for each block of rows: (_block, _g, _col, _piece, _part, _ids, _v, _twice, _more, _totals).

    There is a rank for each partner, among the values whose partner is there; equal ones share their mean rank. ``_more`` has
    what that of each partner is above the one before, mostly little. A piece of one value (of an odd number) has none, since
    they follow from its total. Values go along for labels.
    """
    c = piece.column("_col")[0].as_py()
    others = sum(side != sides[c] for side in sides)
    ids, v, mask = (_joined_bytes(piece.column(n), k) for n, k in (("_ids", np.int64), ("_v", float), ("_mask", np.int32)))
    flat = piece.column("_piece")[0].as_py() % 2 == 1
    value = None if flat else np.unique(v, return_inverse=True)[1]
    twice, totals = np.empty((len(v), 0 if flat else others), np.int64), np.empty(others, np.int64)
    for k in range(others):
        there = mask >> k & 1
        if flat:
            totals[k] = there.sum()
        else:
            count = np.bincount(value, there).astype(np.int64)
            upto = np.cumsum(count)
            twice[:, k], totals[k] = (2 * upto - count + 1)[value], upto[-1]
    order = np.argsort(ids, kind="stable")
    ids = ids[order]
    at = _cuts(ids >> bits)
    twice = twice[order]
    columns = [(ids & ((1 << bits) - 1)).astype(np.int32), *([v[order]] if sides[c] else []), _narrow(twice[:, :1]), _narrow(np.diff(twice))]
    parts = _cut_bytes(at, *columns)
    if not sides[c]:
        parts.insert(1, pa.nulls(len(at), pa.binary()))
    names = ["_g", "_col", "_piece", "_part"]
    head = [pa.array(np.full(len(at), piece.column(n)[0].as_py())) for n in names]
    totals = pa.array([totals.tolist()] * len(at), pa.list_(pa.int64()))
    return pa.Table.from_arrays([pa.array(ids[at] >> bits), *head, *parts, totals], names=["_block", *names, "_ids", "_v", "_twice", "_more", "_totals"])


def _rank_sums(piece: pa.Table, sides: list[int], bits: int) -> pa.Table:
    """Sums over the rows of a block, for each key, feature and label: products of centred ranks (twice), labels of the outer fifths."""
    names, out = ["_g", "_x", "_y", "n", "_xy", "_xx", "_yy", "_low", "_n_low", "_high", "_n_high"], []
    features, labels = ([k for k, side in enumerate(sides) if side == s] for s in (0, 1))
    group = piece.column("_g").to_numpy()
    for g in np.unique(group):
        rows = np.flatnonzero(group == g)
        there, centred, fifth, y = {}, {}, {}, {}
        for r in rows:
            c = piece.column("_col")[r].as_py()
            at = np.frombuffer(piece.column("_ids")[r].as_buffer(), np.int32)
            before, t, n = (np.array(piece.column(k)[r].as_py()) for k in ("_before", "_t", "_n"))
            if piece.column("_piece")[r].as_py() % 2 == 1:
                twice = np.tile(t + 1 + 2 * before, (len(at), 1))
            else:
                first, more = (_widened(piece.column(k)[r], len(at) * m) for k, m in (("_twice", 1), ("_more", len(n) - 1)))
                twice = np.cumsum(np.concatenate([first[:, None], more.reshape(len(at), -1)], axis=1), axis=1) + 2 * before
            if c not in there:
                there[c] = np.zeros(1 << bits, bool)
                centred[c] = np.zeros((len(n), 1 << bits))
                fifth[c] = np.zeros((len(n), 1 << bits), np.int8) if sides[c] == 0 else None
                y[c] = np.zeros(1 << bits) if sides[c] == 1 else None
            there[c][at] = True
            centred[c][:, at] = (twice - (n + 1)).T
            if sides[c] == 0:
                fifth[c][:, at] = np.ceil(twice / 2.0 * 5 / np.maximum(n, 1)).T
            else:
                y[c][at] = np.frombuffer(piece.column("_v")[r].as_buffer(), float)
        for i, f in enumerate(features):
            for j, h in enumerate(labels):
                if f not in there or h not in there:
                    continue
                both = np.flatnonzero(there[f] & there[h])
                if not len(both):
                    continue
                a, b, where, label = centred[f][j][both], centred[h][i][both], fifth[f][j][both], y[h][both]
                low, high = label[where == 1], label[where == 5]
                out.append((g, f, h, len(both), a @ b, a @ a, b @ b, low.sum(), len(low), high.sum(), len(high)))
    kinds = [pa.int64()] * 4 + [pa.float64()] * 4 + [pa.int64(), pa.float64(), pa.int64()]
    return pa.Table.from_arrays([pa.array(v, k) for v, k in zip(zip(*out) if out else [[]] * len(names), kinds)], names=names)


def feature_horizon_stats(
    df: DataFrame, keys: Sequence[str], features: Sequence[str], labels: Sequence[str], min_n: int = 500, piece_values: int = PIECE_VALUES
) -> DataFrame:
    """Spearman correlation and top-minus-bottom-fifth label per (key, feature, horizon).

    ``enough`` tells whether the group has ``min_n`` rows, from which on the numbers count as evidence. Rows without a key
    are left out. ``df`` is a kept table, since it is read twice.

    Each column is sorted once, in pieces between approximate quantiles: a task has one piece and gives the ranks of its
    values among those that have a certain partner, for all partners. These go back to blocks of rows, where the products
    of ranks and the labels of the outer fifths are summed up.
    """
    # a block's ranks, one for each feature and label, are in a task at once
    if max(len(features), len(labels)) > _SIDE_COLUMNS:
        some = [[c[k : k + _SIDE_COLUMNS] for k in range(0, len(c), _SIDE_COLUMNS)] for c in (list(features), list(labels))]
        return reduce(DataFrame.unionByName, [feature_horizon_stats(df, keys, f, h, min_n, piece_values) for f in some[0] for h in some[1]])
    columns, sides = [*features, *labels], [0] * len(features) + [1] * len(labels)
    rows = df.dropna("any", subset=list(keys)).select(F.struct(*keys).alias("_k"), *[F.col(c).cast("double").alias(c) for c in columns])
    shape = rows.groupBy("_k").agg(F.count(F.lit(1)).alias("_rows")).agg(F.max("_rows").alias("most"), F.sum("_rows").alias("all")).head()
    # a sketch of as many pieces as the largest key needs; the others take some of its borders
    pieces = -(-(shape["most"] or 0) // piece_values)
    need = F.ceil(F.col("_rows") / F.lit(piece_values)).cast("int")
    take = lambda found: F.transform(F.sequence(F.lit(1), need - 1), lambda i: F.get(found, F.floor(i * F.lit(pieces) / need).cast("int") - 1))
    cut = [F.percentile_approx(c, [i / pieces for i in range(1, pieces)], max(1000, 10 * pieces)).alias(c) for c in columns if pieces > 1]
    groups = rows.groupBy("_k").agg(F.count(F.lit(1)).alias("_rows"), *cut).withColumn("_g", F.monotonically_increasing_id())
    groups = materialize(groups, "scan_groups")
    borders = {}
    for r in groups.filter(need > 1).select("_g", *[take(F.col(c)).alias(c) for c in columns]).collect() if cut else []:
        for c, name in enumerate(columns):
            if r[name] and r[name][0] is not None:
                borders[r["_g"], c] = np.unique(np.array(r[name], float), return_counts=True)
    numbered = rows.withColumn("_id", F.monotonically_increasing_id()).join(groups.select("_k", "_g"), "_k").drop("_k")
    dealt = _dealt_values(numbered, columns, sides, borders)
    # the count is explicit, as few rows hold many bytes
    parts = max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), min(2000, (shape["all"] or 0) * len(columns) >> 20))
    bits, by = _BLOCK_BITS, ("_g", "_col", "_piece", "_part")
    head = "_g bigint, _col bigint, _piece bigint, _part bigint"
    schema = f"_block bigint, {head}, _ids binary, _v binary, _twice binary, _more binary, _totals array<bigint>"
    ranked = dealt.repartition(parts, *by).groupBy(*by).applyInArrow(lambda piece: _ranked_piece(piece, sides, bits), schema)
    ranked = materialize(ranked, "ranks", release=True)
    # what a piece has for each partner, and the pieces before it
    totals = ranked.groupBy(*by).agg(F.first("_totals").alias("_totals"))
    totals = totals.select("_g", "_col", "_piece", F.posexplode("_totals").alias("_partner", "_t"))
    totals = totals.groupBy("_g", "_col", "_piece", "_partner").agg(F.sum("_t").alias("_t"))
    whole = W.partitionBy("_g", "_col", "_partner")
    earlier = whole.orderBy("_piece").rowsBetween(W.unboundedPreceding, -1)
    totals = totals.withColumns({"_before": F.coalesce(F.sum("_t").over(earlier), F.lit(0)), "_n": F.sum("_t").over(whole)})
    in_order = lambda c: F.transform(F.array_sort(F.collect_list(F.struct("_partner", c))), lambda s: s[c]).alias(c)
    totals = totals.groupBy("_g", "_col", "_piece").agg(*[in_order(c) for c in ("_t", "_before", "_n")])
    met = ranked.drop("_totals").join(totals, ["_g", "_col", "_piece"])
    schema = "_g bigint, _x bigint, _y bigint, n bigint, _xy double, _xx double, _yy double, _low double, _n_low bigint, _high double, _n_high bigint"
    sums = met.repartition(parts, "_block").groupBy("_block").applyInArrow(lambda piece: _rank_sums(piece, sides, bits), schema)
    names = ("n", "_xy", "_xx", "_yy", "_low", "_n_low", "_high", "_n_high")
    sums = sums.groupBy("_g", "_x", "_y").agg(*[F.sum(c).alias(c) for c in names]).join(groups.select("_g", "_k"), "_g")
    name = lambda c: F.get(F.array(*map(F.lit, columns)), F.col(c))
    spread = F.try_divide(F.col("_high"), F.col("_n_high")) - F.try_divide(F.col("_low"), F.col("_n_low"))
    return sums.select(
        "_k.*",
        name("_x").alias("feature"),
        name("_y").alias("horizon"),
        F.try_divide(F.col("_xy"), F.sqrt("_xx") * F.sqrt("_yy")).alias("spearman_ic"),
        spread.alias("q5_q1_spread_bps"),
        "n",
        (F.col("n") >= min_n).alias("enough"),
    )


def condition_table(
    df: DataFrame, keys: Sequence[str], condition: Column, label: str, period: Column | None = None
) -> DataFrame:
    """Conditional against unconditional mean, median, hit rate and n, per period if given."""
    keys = list(keys)
    rows = df.filter(F.col(label).isNotNull()).select(
        *keys,
        (period if period is not None else F.lit("all")).cast("string").alias("period"),
        condition.alias("_hit"),
        F.col(label).alias("_y"),
    )
    sides = F.when(F.col("_hit"), F.array(F.lit("condition"), F.lit("all"))).otherwise(F.array(F.lit("all")))
    rows = materialize(rows.withColumn("side", F.explode(sides)), "condition_rows")
    group = [*keys, "period", "side"]
    base = rows.groupBy(*group).agg(
        F.count(F.lit(1)).alias("n"),
        F.avg("_y").alias("mean"),
        F.avg(F.when(F.col("_y") > 0, 1.0).otherwise(0.0)).alias("hit_rate"),
    )
    median = exact_quantiles(rows, group, "_y", [0.5]).select(*group, F.col("quantile").alias("median"))
    return base.join(median, group)


def newey_west(df: DataFrame, group: Sequence[str], value: str, lags: int, seq: str = "seq", size: int | None = None) -> DataFrame:
    """n, mean, t and two-sided p of a mean with a Bartlett-weighted variance.

    Values are centred on the mean of their group first. A block, with the ``lags`` rows behind it, gives one number:
    its autocovariance sums over all lags, weighted. Missing values are pairs with nothing.
    """
    group = list(group)
    rows = df.select(F.struct(*group).alias("_g"), F.col(seq).alias("_seq"), F.col(value).cast("double").alias("_x"))
    base = rows.groupBy("_g").agg(F.count("_x").alias("n"), F.avg("_x").alias("mean"), F.var_pop("_x").alias("_g0"))
    centred = rows.join(base.select("_g", "mean"), "_g").select("_g", "_seq", (F.col("_x") - F.col("mean")).alias("_d"))
    parts = blocks(centred, after=lags, size=size, pos="_seq")

    def weighted(piece: pa.Table) -> pa.Table:
        piece = piece.sort_by("_seq")
        d = np.nan_to_num(piece.column("_d").to_numpy().astype(float))
        at, own = piece.column("_seq").to_numpy(), piece.column(CORE).to_numpy()
        # by place, so that rows that are left out keep their distance
        place = at - at[0]
        line = np.zeros(int(place[-1]) + 1)
        line[place] = d
        mine = np.zeros_like(line)
        mine[place[own]] = d[own]
        total = sum((1.0 - k / (lags + 1.0)) * float(mine[:-k] @ line[k:]) for k in range(1, min(lags, len(line) - 1) + 1))
        return pa.table({"_g": piece.column("_g").slice(0, 1), "_s": pa.array([total], pa.float64())})

    schema = T.StructType([rows.schema["_g"], T.StructField("_s", T.DoubleType())])
    sums = parts.groupBy("_g", BLK).applyInArrow(weighted, schema).groupBy("_g").agg(F.sum("_s").alias("_s"))
    n, m = F.col("n"), F.col("mean")
    var = F.col("_g0") + 2.0 * F.col("_s") / n
    t = F.when(var > 0, m / F.sqrt(var / n))
    out = base.join(sums, "_g").select("_g.*", "n", "mean", t.alias("t_nw"))
    return out.withColumn("p_value", 2.0 * (1.0 - norm_cdf(F.abs("t_nw"))))


def benjamini_hochberg(
    tests: DataFrame, batch: Sequence[str], p: str = "p_value", out: str = "q_value", piece_values: int = PIECE_VALUES
) -> DataFrame:
    """Add the false-discovery-rate q of each test in its batch.

    Tests of equal p share their q, so only distinct p are ranked. A test without p has no q and is not counted.
    A null batch is a batch like any other.
    """
    rows = tests.withColumn("_b", F.struct(*batch))
    places = materialize(value_places(rows.select("_b", p), ["_b"], p, piece_values), "ranked_tests")
    places = places.join(places.groupBy("_b").agg(F.max("_upto").alias("_m")), "_b")
    rev = running(
        places.withColumn("_rev", -F.col("_upto")),
        ["_b"],
        "_rev",
        F.floor(F.col("_rev") / F.lit(65_536)).cast("bigint"),
        {out: ("min", F.col(p) * F.col("_m") / F.col("_upto"))},
    )
    q = rev.select("_b", p, F.least(F.col(out), F.lit(1.0)).alias(out))
    return rows.join(q, ["_b", p], "left").select(*tests.columns, out)


# Scan points, lower ones tested as x < threshold, upper ones as x > threshold.
SCAN_POINTS = ((0.10, "<"), (0.25, "<"), (0.75, ">"), (0.90, ">"))


#: a quantile is looked for among the values at most 2 / _SKETCH of all away from its estimate
_SKETCH = 10_000


def column_quantiles(df: DataFrame, keys: Sequence[str], columns: Sequence[str], qs: Sequence[float], sketch: int = _SKETCH) -> DataFrame:
    """``exact_quantiles`` of many columns of a kept table: rows (keys, feature, q, quantile).

    A mergeable sketch of each column gives values that a quantile surely lies between; only those between are
    counted one by one, the others below as one number, so the table itself is not shuffled.
    """
    rows = df.select(F.struct(*keys).alias("_k"), *[F.col(c).cast("double").alias(c) for c in columns])
    near = 2.0 / sketch
    ends = [min(max(q + side * near, 0.0), 1.0) for q in qs for side in (-1, 1)]
    least, most = F.lit(float("-inf")), F.lit(float("inf"))

    def between(c: str) -> Column:
        # the estimates of few values may be off by a place: take all
        large, found = F.count(c) > 10 * sketch, F.percentile_approx(c, ends, sketch)
        at = lambda k, other: F.when(large, F.get(found, F.lit(k))).otherwise(other)
        points = [F.struct(F.lit(float(q)).alias("q"), at(2 * k, least).alias("lo"), at(2 * k + 1, most).alias("hi")) for k, q in enumerate(qs)]
        return F.struct(F.lit(c).alias("feature"), F.count(c).alias("_n"), F.array(*points).alias("_points"))

    found = rows.groupBy("_k").agg(*[between(c).alias(c) for c in columns])
    found = found.select("_k", F.explode(F.array(*columns)).alias("_f")).select("_k", "_f.*")
    found = materialize(found, "estimates")
    long = melt(rows, ["_k"], columns, "feature", "x").join(found, ["_k", "feature"])
    long = long.select("_k", "feature", "x", "_n", F.explode("_points").alias("_p")).filter("x <= _p.hi OR isnan(x)")
    inside = F.when(F.col("x") >= F.col("_p.lo"), F.col("x"))
    counts = long.groupBy("_k", "feature", "_n", F.col("_p.q").alias("q"), inside.alias("x")).agg(F.count(F.lit(1)).alias("_cnt"))
    order = W.partitionBy("_k", "feature", "q").orderBy(F.col("x").asc_nulls_first())
    places = counts.withColumn("_upto", F.sum("_cnt").over(order)).filter("x IS NOT NULL")
    at = (F.col("_n") - 1) * F.col("q")
    covers = lambda pos: (F.col("_upto") > pos) & (F.col("_upto") - F.col("_cnt") <= pos)
    met = places.filter(covers(F.floor(at)) | covers(F.ceil(at)))
    out = met.groupBy("_k", "feature", "q").agg(F.min("x").alias("_lo"), F.max("x").alias("_hi"), F.max(at - F.floor(at)).alias("_frac"))
    return out.select("_k.*", "feature", "q", (F.col("_lo") + (F.col("_hi") - F.col("_lo")) * F.col("_frac")).alias("quantile"))


def _lag_sum(d: np.ndarray, lags: int) -> float:
    """Bartlett-weighted sum of the products of values up to ``lags`` places apart."""
    return float(sum((1.0 - k / (lags + 1.0)) * float(d[:-k] @ d[k:]) for k in range(1, min(lags, len(d) - 1) + 1)))


def _scan_tests(bars: DataFrame, keys: Sequence[str], cuts: DataFrame, horizons: dict[str, int], size: int | None) -> DataFrame:
    """(keys, feature, q, quantile, horizon, n, mean, t_nw) of the bars beyond each cut, as ``newey_west`` has them.

    A block of bars tests all cuts and labels at once and sums each of them up: values, squares and weighted products
    of neighbours, all from the mean label of the key, and the first and last values, which neighbours in other blocks need.
    """
    low = [q for q, op in SCAN_POINTS if op == "<"]
    key = bars.select(F.struct(*keys).alias("_g")).schema["_g"]
    centres = bars.groupBy(F.struct(*keys).alias("_g")).agg(*[F.coalesce(F.avg(c), F.lit(0.0)).alias(c) for c in horizons])
    rows = blocks(bars.withColumn("_g", F.struct(*keys)).drop(*keys), size=size).drop(CORE)
    wanted = cuts.select(F.struct(*keys).alias("_g"), "feature", "q", "quantile").join(centres, "_g")
    held = rows.select(F.col("_g").alias("_of"), F.col(BLK).alias("_block")).distinct()
    wanted = materialize(wanted, "scan_cuts")
    wanted = wanted.join(held, wanted["_g"].eqNullSafe(F.col("_of"))).drop("_of").withColumnRenamed("_g", "_key")
    names = ["_g", BLK, "feature", "q", "quantile", "horizon", "_c", "n", "_s", "_ss", "_w", "_first", "_last"]
    double, long = T.DoubleType(), T.LongType()
    kinds = [key.dataType, long, T.StringType(), double, double, T.StringType(), double, long, double, double, double, T.ArrayType(double), T.ArrayType(double)]
    schema = T.StructType([T.StructField(n, k) for n, k in zip(names, kinds)])

    def sum_up(piece: pa.Table, cuts: pa.Table) -> pa.Table:
        out = {n: [] for n in names}
        piece = piece.sort_by(POS)
        column = lambda c: piece.column(c).to_numpy().astype(float)
        there = {c: pc.is_valid(piece.column(c)).to_numpy() for c in horizons} if len(piece) else {}
        labels, known = {c: column(c) for c in there}, {}
        for r in cuts.to_pylist() if there else []:
            if r["feature"] not in known:
                known[r["feature"]] = column(r["feature"])
            x = known[r["feature"]]
            hit = x < r["quantile"] if r["q"] in low else x > r["quantile"]
            for label, lags in horizons.items():
                e = labels[label][hit & there[label]] - r[label]
                if not len(e):
                    continue
                made = (r["_key"], r["_block"], r["feature"], r["q"], r["quantile"], label, r[label], len(e), float(e.sum()), float(e @ e), _lag_sum(e, lags), e[:lags].tolist(), e[-lags:].tolist())
                for n, v in zip(names, made):
                    out[n].append(v)
        return pa.table({n: pa.array(v, to_arrow_type(k)) for (n, v), k in zip(out.items(), kinds)})

    parts = rows.groupBy("_g", BLK).cogroup(wanted.groupBy("_key", "_block")).applyInArrow(sum_up, schema)
    group = ["_g", "feature", "q", "quantile", "horizon"]
    done = T.StructType([schema[n] for n in (*group, "_c", "n", "_s", "_ss")] + [T.StructField("_w", double)])

    def merge(piece: pa.Table) -> pa.Table:
        piece = piece.sort_by(BLK)
        lags = horizons[piece.column("horizon")[0].as_py()]
        total, first, last = 0.0, np.zeros(0), np.zeros(0)
        for w, head, tail, n in zip(*(piece.column(c).to_pylist() for c in ("_w", "_first", "_last", "n"))):
            head, tail = np.array(head), np.array(tail)
            total += w + _lag_sum(np.concatenate([last, head]), lags) - _lag_sum(last, lags) - _lag_sum(head, lags)
            if len(first) < lags:
                first = np.concatenate([first, head])[:lags]
            last = np.concatenate([last, tail])[-lags:]
        n, s = (pc.sum(piece.column(c)).as_py() for c in ("n", "_s"))
        k = np.arange(1, min(lags, n - 1) + 1)
        # from the key's mean label to the mean of the test
        off = s / n
        ends = 2 * s - np.cumsum(first)[: len(k)] - np.cumsum(last[::-1])[: len(k)]
        total += float((1.0 - k / (lags + 1.0)) @ ((n - k) * off * off - off * ends))
        sums = {"n": n, "_s": s, "_ss": pc.sum(piece.column("_ss")).as_py(), "_w": total}
        head = {c: piece.column(c)[:1] for c in (*group, "_c")}
        return pa.table(head | {c: pa.array([v]) for c, v in sums.items()})

    got = parts.groupBy(*group).applyInArrow(merge, done)
    n, off = F.col("n"), F.col("_s") / F.col("n")
    var = F.greatest(F.col("_ss") / n - off * off, F.lit(0.0)) + 2.0 * F.col("_w") / n
    mean = F.col("_c") + off
    return got.select("_g.*", "feature", "q", "quantile", "horizon", "n", mean.alias("mean"), F.when(var > 0, mean / F.sqrt(var / n)).alias("t_nw"))


def conditional_scan(
    df: DataFrame,
    keys: Sequence[str],
    features: Sequence[str],
    horizons: dict[str, int],
    min_n: int = 100,
    size: int | None = None,
) -> DataFrame:
    """Every (feature, threshold, horizon): n, mean label, Newey-West t, p and batch q.

    ``df`` is a kept table, since it is read several times. ``horizons`` maps label columns to their length in bars.
    Thresholds are the feature's own 10/25/75/90 % points per key. Only the tests with ``min_n`` rows (``enough``) make
    up the batch; the others have no q.
    """
    keys = list(keys)
    bars = df.select(*keys, POS, *[F.col(c).cast("double").alias(c) for c in (*features, *horizons)])
    cuts = column_quantiles(bars, keys, features, [q for q, _ in SCAN_POINTS])
    tests = _scan_tests(bars, keys, cuts, horizons, size)
    low = [q for q, op in SCAN_POINTS if op == "<"]
    tested = tests.withColumn("p_value", 2.0 * (1.0 - norm_cdf(F.abs("t_nw"))))
    tested = tested.withColumn("op", F.when(F.col("q").isin(low), "<").otherwise(">"))
    tested = materialize(tested.withColumn("enough", F.col("n") >= min_n), "scan_tests")
    batch = benjamini_hochberg(tested.filter("enough"), keys)
    return batch.unionByName(tested.filter("NOT enough"), allowMissingColumns=True)


def event_study(
    indexed: DataFrame, keys: Sequence[str], marked: Column, pre: int, post: int, size: int | None = None
) -> DataFrame:
    """Mean move in bps from the event bar's close at each offset, over the marked bars."""
    keys = list(keys)
    frames = Frames(keys)
    rows = blocks(indexed.withColumn("_mark", marked), before=pre, after=post, size=size)
    moves = []
    for o in range(-pre, post + 1):
        at = frames.lag("close", -o) if o < 0 else frames.lead("close", o)
        moves.append(F.struct(F.lit(o).cast("bigint").alias("offset"), ((F.try_divide(at, F.col("close")) - 1) * 10_000).alias("move")))
    rows = core_rows(rows.withColumn("_moves", F.array(*moves))).filter("_mark")
    return (
        rows.select(*keys, F.explode("_moves").alias("_m"))
        .select(*keys, "_m.offset", "_m.move")
        .filter(F.col("move").isNotNull())
        .groupBy(*keys, "offset")
        .agg(F.avg("move").alias("mean_bps"), F.count(F.lit(1)).alias("n"))
    )


# ------------------------------------------------------------- overlap, correlation


def signal_overlap(flags: DataFrame, rule_ids: Sequence[str]) -> DataFrame:
    """Jaccard overlap of every two rules from their boolean columns.

    Each fired (bar, rule) adds one row with the flags of all rules, summed per rule
    in the task: the output is the matrix, no pair of rows is formed.
    """
    ids = list(rule_ids)
    fired = F.filter(F.array(*[F.when(F.col(r), F.lit(r)) for r in ids]), lambda x: x.isNotNull())
    rows = flags.select(*ids, F.explode(fired).alias("rule_a"))
    sums = rows.groupBy("rule_a").agg(F.count(F.lit(1)).alias("_na"), *[F.sum(F.col(r).cast("bigint")).alias(r) for r in ids])
    sums = materialize(sums, "overlap")
    long = sums.unpivot(["rule_a", "_na"], ids, "rule_b", "both")
    sizes = sums.select(F.col("rule_a").alias("rule_b"), F.col("_na").alias("_nb"))
    return (
        long.filter(F.col("rule_a") < F.col("rule_b"))
        .join(sizes, "rule_b")
        .withColumn("jaccard", F.col("both") / (F.col("_na") + F.col("_nb") - F.col("both")))
        .select("rule_a", "rule_b", "both", "jaccard")
    )


def novelty(overlap: DataFrame, new_rules: Sequence[str]) -> DataFrame:
    """1 - largest overlap of each new rule with any other."""
    both = overlap.select("rule_a", "jaccard").unionByName(
        overlap.select(F.col("rule_b").alias("rule_a"), "jaccard")
    )
    return both.filter(F.col("rule_a").isin(list(new_rules))).groupBy(F.col("rule_a").alias("rule_id")).agg(
        (1.0 - F.max("jaccard")).alias("novelty")
    )


#: rules, and rows of rules, of a block of rules; a task has two blocks at a time
BLOCK_RULES = 1 << 16
BLOCK_FIRES = 1 << 21

#: rows of a block from which on there are more blocks, up to what keeps all cores busy
_TILE_FIRES = 1 << 15

#: rows that blocks are shuffled as, once for every other block; from there on blocks are kept and read where they meet
_DEALT_ROWS = 1 << 26

#: numbers in the matrix of a block's bars that are multiplied at once
_CELLS = 1 << 22

#: bytes of the table of bars by rules, a bit each, whose rows are added up; and of the rows that are added at once
_TABLE, _ADDED = 1 << 22, 1 << 16

#: numbers in which a task adds up, a stripe of one block's rules by the other block's
_STRIPE = 1 << 22

#: rows that a task gives away at once
_OUT_ROWS = 1 << 16

#: what a pair of a bar costs, in cells of a matrix product: blocks with few rules a bar are counted pair by pair
_PAIR_COST = 100

#: the same for counts alone, where products are cheaper: a pair (as many times more), a bit that is added, a rule's start
_COUNT_PAIR, _COUNT_BIT, _COUNT_RULE = 20, 6, 400_000


@dataclass(frozen=True)
class _Side:
    """Rules of a block by size, with their (bar, value) rows one rule after the other."""

    ids: pa.Array
    sizes: np.ndarray
    start: np.ndarray
    bars: pa.Array
    x: np.ndarray

    @staticmethod
    def of(piece: pa.Table) -> _Side:
        piece = piece.combine_chunks().sort_by([("_size", "ascending"), ("_rule", "ascending")])
        held = pa.concat_arrays(piece.column("_held").chunks) if len(piece) else pa.array([], piece.schema.field("_held").type)
        rows = held.flatten()
        lengths = pc.list_value_length(held).to_numpy(zero_copy_only=False).astype(np.int64)
        ids = pa.concat_arrays(piece.column("_rule").chunks) if len(piece) else pa.array([], piece.schema.field("_rule").type)
        x = rows.field(1).to_numpy(zero_copy_only=False) if rows.type.num_fields > 1 else np.ones(len(rows))
        return _Side(ids, piece.column("_size").to_numpy(), np.append(0, np.cumsum(lengths)), rows.field(0), x)


def _pair_sums(left, right, lo: int, hi: int, far: int, end: int, width: int, chunk: int, valued: bool, kept: dict) -> list[np.ndarray]:
    """Sums over shared bars of rules lo to hi of one side with rules far to end of the other, by matrix products.

    ``kept`` holds the matrices of lo to hi for the next call, where one chunk has all bars.
    """
    kind = float if valued else np.float32
    sums = [np.zeros((hi - lo, end - far), kind) for _ in range(6 if valued else 1)]

    def matrices(side, lo: int, hi: int, first: int) -> tuple[np.ndarray, ...]:
        col, x, start = side
        cut = slice(start[lo], start[hi])
        row = np.repeat(np.arange(hi - lo), np.diff(start[lo : hi + 1]))
        here = (col[cut] >= first) & (col[cut] < min(first + chunk, width))
        at = row[here], col[cut][here] - first
        there = np.zeros((hi - lo, min(chunk, width - first)), kind)
        there[at] = 1.0
        if not valued:
            return (there,)
        value = np.zeros_like(there)
        value[at] = x[cut][here]
        return there, value, value * value

    made = np.empty_like(sums[0])
    for first in range(0, width, chunk):
        if (lo, hi, first) not in kept:
            kept.clear()
            kept[lo, hi, first] = matrices(left, lo, hi, first)
        mine, other = kept[lo, hi, first], matrices(right, far, end, first)
        pairs = ((0, 0), (1, 0), (0, 1), (2, 0), (0, 2), (1, 1)) if valued else ((0, 0),)
        for total, (k, m) in zip(sums, pairs):
            total += np.matmul(mine[k], other[m].T, out=made)
    return sums


def _pair_counts(left, by_bar, lo: int, hi: int, far: int, end: int, most: int, valued: bool) -> list[np.ndarray]:
    """The same sums, pair by pair: each row of rules lo to hi meets the rows of its bar, ``most`` pairs at a time."""
    (col, x, start), (row_of, other_x, first, ids) = left, by_bar
    shape = (hi - lo, end - far)
    sums = [np.zeros(shape[0] * shape[1]) for _ in range(6 if valued else 1)]
    row = np.repeat(np.arange(hi - lo), np.diff(start[lo : hi + 1]))
    mine, value = col[start[lo] : start[hi]], x[start[lo] : start[hi]]
    met = first[mine + 1] - first[mine]
    upto = np.append(0, np.cumsum(met))
    at = 0
    while at < len(mine):
        to = max(at + 1, int(np.searchsorted(upto, upto[at] + most, "right")) - 1)
        n = met[at:to]
        fire = np.repeat(np.arange(at, to), n)
        place = np.arange(upto[to] - upto[at]) + np.repeat(first[mine[at:to]] - (upto[at:to] - upto[at]), n)
        j = row_of[place]
        if far > 0 or end < len(ids):
            near = (j >= far) & (j < end)
            fire, place, j = fire[near], place[near], j[near]
        code = row[fire] * shape[1] + (j - far)
        sums[0] += np.bincount(code, minlength=len(sums[0]))
        if valued:
            a, b = value[fire], other_x[place]
            for total, part in zip(sums[1:], (a, b, a * a, b * b, a * b)):
                total += np.bincount(code, part, len(total))
        at = to
    return [v.reshape(shape) for v in sums]


def _bar_bits(right, far: int, end: int, width: int) -> np.ndarray:
    """A row for each bar, and one of zeros for bars that the side has not, with a bit for each of the rules far to end."""
    col, _, start = right
    table = np.zeros((width + 1, -(-(end - far) // 64) * 8), np.uint8)
    row, rule = col[start[far] : start[end]], np.repeat(np.arange(end - far), np.diff(start[far : end + 1]))
    # rules one after the other, so that no two rows here meet in a byte at once
    for bit in range(8):
        here = rule % 8 == bit
        table[row[here], rule[here] // 8] |= np.uint8(128 >> bit)
    return table.view(np.uint64)


def _added_bits(left, table: np.ndarray, lo: int, hi: int) -> list[np.ndarray]:
    """Counts of shared bars of rules lo to hi with the rules of a table, digit by digit from the lowest.

    The table's rows of a rule's bars are added up as bits: three of a digit make one of it and one of the next.
    """
    col, _, start = left
    sizes, digits = np.diff(start[lo : hi + 1]), []

    def put(plane: np.ndarray, k: int) -> None:
        while True:
            if k == len(digits):
                digits.append([])
            digits[k].append(plane)
            if len(digits[k]) < 3:
                return
            a, b, c = digits[k]
            odd = a ^ b
            digits[k] = [odd ^ c]
            plane, k = (a & b) | (odd & c), k + 1

    # as many places at once as keeps a few rules of very many bars small
    for first in range(0, int(sizes.max()), 4096):
        place = first + np.arange(min(4096, int(sizes.max()) - first))[:, None]
        held = col[np.minimum(start[lo:hi] + place, start[hi] - 1)]
        for row in np.where(place < sizes, held, len(table) - 1):
            put(table[row], 0)
    for k in range(len(digits) + 1):
        while k < len(digits) and len(digits[k]) > 1:
            a, b = digits[k]
            digits[k] = [a ^ b]
            put(a & b, k + 1)
    return [d[0] for d in digits]


def _at_least(digits: list[np.ndarray], least: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, column, count) of the counts that are ``least`` or more, which is given for each 64 columns and does not fall."""
    enough = np.zeros((len(digits[0]), len(least)), np.uint64)
    for first, end in zip(*(lambda at: (at[:-1], at[1:]))(np.flatnonzero(np.diff(least, prepend=-1, append=-1)))):
        wanted = int(least[first])
        if not wanted >> len(digits):
            some = ~enough[:, first:end]
            for k, d in enumerate(digits):
                some = d[:, first:end] & some if wanted >> k & 1 else d[:, first:end] | some
            enough[:, first:end] = some
    held = enough.view(np.uint8).reshape(-1)
    some = np.flatnonzero(held)
    at = np.flatnonzero(np.unpackbits(held[some]).view(bool))
    byte, bit = some[at >> 3], at & 7
    shift, count = (7 - bit).astype(np.uint8), np.zeros(len(at), np.int64)
    for k, d in enumerate(digits):
        count += (d.view(np.uint8).reshape(-1)[byte] >> shift & 1).astype(np.int64) << k
    row, column = np.divmod(byte, len(least) * 8)
    return row, column * 8 + bit, count


def _tile(a: _Side, b: _Side, same: bool, valued: bool, min_ratio: float, least) -> Iterator[tuple]:
    """(rows of a, rows of b, sums of the pairs) of pairs of two blocks that share ``least(size_a, size_b)`` bars and one at least."""
    if not len(a.ids) or not len(b.ids):
        return
    known = pc.unique(b.bars)
    width = len(known)
    col_b = pc.index_in(b.bars, value_set=known).to_numpy()
    # bars that the other side has not are pairs with nothing
    col_a = pc.index_in(a.bars, value_set=known).fill_null(width).to_numpy()
    first = np.append(0, np.cumsum(np.bincount(col_b, minlength=width)))
    first = np.append(first, len(col_b))
    left, right = (col_a, a.x, a.start), (col_b, b.x, b.start)
    pairs = int((first[col_a + 1] - first[col_a]).sum())
    if not pairs:
        return
    far_step = min(len(b.ids), max(1, _TABLE // (width + 1) // 8) * 64)
    by_product = len(a.ids) * len(b.ids) * width
    by_bits = _COUNT_BIT * len(a.bars) * len(b.ids) + _COUNT_RULE * len(a.ids) * -(-len(b.ids) // far_step)
    bits = not valued and by_bits < by_product
    # a cost of 0 asks for pairs in any case, and one beyond all sums for none
    sparse = pairs * _PAIR_COST * (1 if valued else _COUNT_PAIR) < (by_bits if bits else by_product)
    stripe = max(1, _STRIPE // (6 if valued else 1))
    if sparse:
        bits, far_step, step = False, len(b.ids), max(1, stripe // len(b.ids))
        order = np.argsort(col_b, kind="stable")
        by_bar = np.repeat(np.arange(len(b.ids)), np.diff(b.start))[order], b.x[order], first, b.ids
    elif bits:
        step = max(1, 8 * _ADDED // far_step)
    else:
        far_step = step = max(1, math.isqrt(stripe))
    kept = {}

    def found(lo: int, far: int, i: np.ndarray, j: np.ndarray, sums: list[np.ndarray]) -> Iterator[tuple]:
        i, j = i + lo, j + far
        if same:
            above = i < j
            i, j, sums = i[above], j[above], [s[above] for s in sums]
        if len(i):
            yield i, j, [s.astype(float) for s in sums]

    def wanted(size_a: np.ndarray, size_b: np.ndarray) -> np.ndarray:
        return np.maximum(np.ceil(least(size_a, size_b) * (1 - 1e-9)), 1)

    def near(far: int, end: int, lo: int, hi: int) -> bool:
        # rules are by size; sizes too far apart rule a pair out
        return min_ratio <= 0 or (
            b.sizes[far] * min_ratio * (1 - 1e-9) <= a.sizes[hi - 1] and a.sizes[lo] * min_ratio * (1 - 1e-9) <= b.sizes[end - 1]
        )

    if bits:
        for far in range(0, len(b.ids), far_step):
            end = min(far + far_step, len(b.ids))
            table = _bar_bits(right, far, end, width)
            for lo in range(0, end if same else len(a.ids), step):
                hi = min(lo + step, len(a.ids))
                if near(far, end, lo, hi):
                    size = b.sizes[far:end:64]
                    few = wanted(np.full(len(size), a.sizes[lo]), size).astype(np.int64)
                    i, j, n = _at_least(_added_bits(left, table, lo, hi), few)
                    yield from found(lo, far, i, j, [n])
        return
    for lo in range(0, len(a.ids), step):
        hi = min(lo + step, len(a.ids))
        for far in range(0, len(b.ids), far_step):
            end = min(far + far_step, len(b.ids))
            if (same and end <= lo) or not near(far, end, lo, hi):
                continue
            if sparse:
                sums = _pair_counts(left, by_bar, lo, hi, far, end, stripe, valued)
            else:
                sums = _pair_sums(left, right, lo, hi, far, end, width, max(1, _CELLS // step), valued, kept)
            flat = np.flatnonzero(sums[0] >= wanted(a.sizes[lo:hi], np.full(hi - lo, b.sizes[far]))[:, None])
            yield from found(lo, far, *np.divmod(flat, end - far), [s.reshape(-1)[flat] for s in sums])


def _co_occurrence(rows: DataFrame, bar: str, valued: bool, result, fields: Sequence[T.StructField], least, min_ratio: float = 0.0) -> DataFrame:
    """``result`` of the sums over the bars that two rules share, of rows (_rule, ``bar``, _x), one row a rule and bar.

    ``result(sums, size_a, size_b)`` gives which pairs are kept, and the columns ``fields``, of arrays of pairs; it is the
    same for (b, a). Pairs that share fewer bars than ``least(size_a, size_b)``, which grows with the sizes, or whose
    sizes differ by more than ``min_ratio`` are not asked for. Rules are dealt into blocks, and every two blocks meet in a
    task, which has all bars of their rules, so that a pair's sums are made once. Blocks are shuffled to where they meet
    where that takes up to ``_DEALT_ROWS``; else each is kept once, and tasks read the two they need. A task holds two
    blocks and one stripe of sums (of kept blocks also those of one file partition); only where a single rule has more rows
    than a block are bars dealt too, and sums added up behind the tasks.
    """
    names = ("n", "sx", "sy", "sxx", "syy", "sxy") if valued else ("n",)
    rule = rows.schema["_rule"].dataType
    double, long = T.DoubleType(), T.LongType()
    both = [T.StructField(c, rule) for c in ("rule_a", "rule_b")]
    summed = T.StructType(both + [T.StructField(c, double) for c in names] + [T.StructField(c, long) for c in ("size_a", "size_b")])
    ready = T.StructType(both + list(fields))
    sizes = rows.groupBy("_rule").agg(F.count(F.lit(1)).alias("_size"))
    shape = sizes.agg(F.count(F.lit(1)).alias("rules"), F.sum("_size").alias("fires"), F.max("_size").alias("most")).head()
    rules, fires = shape["rules"], shape["fires"] or 0
    tasks = 4 * rows.sparkSession.sparkContext.defaultParallelism
    even = min(math.ceil(math.sqrt(2 * tasks)), -(-fires // _TILE_FIRES))
    count = lambda block_fires: max(1, min(rules, max(even, -(-rules // BLOCK_RULES), -(-fires // block_fires))))
    blocks = count(BLOCK_FIRES)
    slices = max(1, -(-(shape["most"] or 0) // BLOCK_FIRES))
    keep = fires * blocks > _DEALT_ROWS
    if keep:
        # smaller ones, of which a pair makes a row
        blocks = count(-(-BLOCK_FIRES // 4))
    schema = ready if slices == 1 else summed
    none = lambda size_a, size_b: np.zeros(len(size_a))
    bound, out_rows = least if slices == 1 else none, _OUT_ROWS

    def finished(sums: list[np.ndarray], size_a: np.ndarray, size_b: np.ndarray) -> tuple[np.ndarray, list[pa.Array]]:
        good, made = result(sums, size_a, size_b)
        return good, [pa.array(v, to_arrow_type(f.dataType)) for f, v in zip(fields, made)]

    def pairs_of(a: _Side, b: _Side, same: bool) -> Iterator[pa.RecordBatch]:
        for i, j, sums in _tile(a, b, same, valued, min_ratio, bound):
            if slices == 1:
                good, made = finished(sums, a.sizes[i], b.sizes[j])
                i, j = i[good], j[good]
            else:
                made = [pa.array(s) for s in (*sums, a.sizes[i], b.sizes[j])]
            for at in range(0, len(i), out_rows):
                cut = slice(at, at + out_rows)
                ids = [a.ids.take(pa.array(i[cut])), b.ids.take(pa.array(j[cut]))]
                yield pa.RecordBatch.from_arrays(ids + [v[cut] for v in made], names=schema.names)

    def met_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        piece = pa.Table.from_batches(list(batches))
        same = piece.column("_lo")[0].as_py() == piece.column("_hi")[0].as_py()
        a = _Side.of(piece.filter(piece.column("_left")))
        yield from pairs_of(a, a if same else _Side.of(piece.filter(pc.invert(piece.column("_left")))), same)

    def pack(piece: pa.Table) -> pa.Table:
        sink = pa.BufferOutputStream()
        held = piece.select(["_rule", "_size", "_held"]).combine_chunks()
        with pa.ipc.new_stream(sink, held.schema) as writer:
            writer.write_table(held)
        data = pa.array([sink.getvalue().to_pybytes()], pa.large_binary()).cast(pa.binary())
        return pa.table({**{c: piece.column(c)[:1] for c in ("_block", "_slice")}, "_data": data})

    def met_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = {}

        def side(which: str, batch: pa.RecordBatch, k: int) -> _Side:
            at = tuple(batch.column(c)[k].as_py() for c in (f"_{which}", "_slice"))
            if last.get(which, (None,))[0] != at:
                last[which] = at, _Side.of(pa.ipc.open_stream(batch.column(f"_{which}_data")[k].as_buffer()).read_all())
            return last[which][1]

        for batch in batches:
            for k in range(batch.num_rows):
                same = batch.column("_a")[k].as_py() == batch.column("_b")[k].as_py()
                a = side("a", batch, k)
                yield from pairs_of(a, a if same else side("b", batch, k), same)

    whole = lambda n: F.lit(n).cast("bigint")
    row = [F.col(bar).alias("bar"), *([F.col("_x").alias("x")] if valued else [])]
    lists = rows.groupBy("_rule", F.pmod(F.xxhash64(bar), whole(slices)).alias("_slice")).agg(F.collect_list(F.struct(*row)).alias("_held"))
    if slices > 1:
        lists = lists.join(sizes, "_rule")
    else:
        lists = lists.withColumn("_size", F.size("_held").cast("bigint"))
    lists = lists.withColumn("_block", F.pmod(F.xxhash64("_rule"), whole(blocks)))
    if keep:
        packed = lists.groupBy("_block", "_slice").applyInArrow(pack, "_block bigint, _slice bigint, _data binary")
        packed = materialize(packed, "rule_blocks", release=True)
        one = packed.select(F.col("_block").alias("_a"), "_slice", F.col("_data").alias("_a_data"))
        other = packed.select(F.col("_block").alias("_b"), F.col("_slice").alias("_of"), F.col("_data").alias("_b_data"))
        # each pair of blocks once, and as many of a partition's pairs here as in the one turned about
        once = (F.col("_a") == F.col("_b")) | ((F.col("_a") < F.col("_b")) == ((F.col("_a") + F.col("_b")) % 2 == 0))
        meet = one.join(other.hint("shuffle_replicate_nl"), once & (F.col("_slice") == F.col("_of")))
        met = meet.mapInArrow(met_blocks, schema)
    else:
        dealt = lists.withColumn("_other", F.explode(F.sequence(whole(0), whole(blocks - 1))))
        tile = [F.least("_block", "_other").alias("_lo"), F.greatest("_block", "_other").alias("_hi"), "_slice"]
        dealt = dealt.select(*tile, (F.col("_block") <= F.col("_other")).alias("_left"), "_rule", "_size", "_held")
        # the count is explicit, as few bytes make much work
        parts = min(2000, slices * blocks * (blocks + 1) // 2)
        met = dealt.repartition(parts, "_lo", "_hi", "_slice").groupBy("_lo", "_hi", "_slice").applyInArrow(met_rows, schema)
    # the smaller id comes first, whichever rule is the larger
    ids = [F.least("rule_a", "rule_b").alias("rule_a"), F.greatest("rule_a", "rule_b").alias("rule_b")]
    if slices == 1:
        return met.select(*ids, *[f.name for f in fields])
    turn = F.col("rule_a") > F.col("rule_b")
    swapped = {"sx": "sy", "sy": "sx", "sxx": "syy", "syy": "sxx", "size_a": "size_b", "size_b": "size_a"}
    columns = (*names, "size_a", "size_b")
    met = met.select(*ids, *[F.when(turn, F.col(swapped.get(c, c))).otherwise(F.col(c)).alias(c) for c in columns])
    met = met.groupBy("rule_a", "rule_b").agg(*[F.sum(c).alias(c) for c in names], *[F.max(c).alias(c) for c in ("size_a", "size_b")])

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            good, made = finished(*((lambda v: (v[:-2], *v[-2:]))([batch.column(c).to_numpy() for c in columns])))
            ids = [batch.column(c).filter(pa.array(good)) for c in ("rule_a", "rule_b")]
            yield pa.RecordBatch.from_arrays(ids + made, names=ready.names)

    return met.mapInArrow(finish, ready)


def rule_overlap(fires: DataFrame, bar: str = "bar", min_jaccard: float = 0.0) -> DataFrame:
    """Jaccard overlap of every two rules that share a bar: rule_a < rule_b, both, jaccard.

    ``fires``: one row (rule_id, bar) for each bar that a rule fired at, in any number of rules; repeated rows count
    once, rows without a rule or a bar not at all. With ``min_jaccard``, pairs whose sizes alone rule it out are
    never counted, and only pairs that reach it are returned.
    """
    rows = fires.select(F.col("rule_id").alias("_rule"), F.col(bar).alias("_bar")).dropna().distinct()
    rows = materialize(rows, "fires", release=True)

    def result(sums: list[np.ndarray], size_a: np.ndarray, size_b: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
        jaccard = sums[0] / (size_a + size_b - sums[0])
        good = jaccard >= min_jaccard
        return good, [sums[0][good].astype(np.int64), jaccard[good]]

    fields = [T.StructField("both", T.LongType()), T.StructField("jaccard", T.DoubleType())]
    least = lambda size_a, size_b: (size_a + size_b) * (min_jaccard / (1.0 + min_jaccard))
    return _co_occurrence(rows, "_bar", False, result, fields, least, min_jaccard)


def return_correlations(daily: DataFrame, rule_ids: Sequence[str] | None = None, day: str = "dt", min_days: int = 1) -> DataFrame:
    """Correlation of date-aligned returns of every two rules that share ``min_days`` days: rule_a < rule_b, return_corr.

    ``daily``: rule_id, day, ret, one row per rule and day; ``rule_ids`` narrows the rules down. Returns are centred
    on the mean of their rule, and only pairs with a common day are made. Without spread there is no correlation.
    """
    rows = daily.select(F.col("rule_id").alias("_rule"), F.col(day).alias("_bar"), F.col("ret").cast("double").alias("_x")).dropna()
    if rule_ids is not None:
        rows = rows.filter(F.col("_rule").isin(list(rule_ids)))
    rows = rows.groupBy("_rule", "_bar").agg(F.sum("_x").alias("_x"))
    means = rows.groupBy("_rule").agg(F.avg("_x").alias("_m"))
    rows = rows.join(means, "_rule").select("_rule", "_bar", (F.col("_x") - F.col("_m")).alias("_x"))
    rows = materialize(rows, "returns", release=True)

    def result(sums: list[np.ndarray], *_) -> tuple[np.ndarray, list[np.ndarray]]:
        good = sums[0] >= min_days
        n, sx, sy, sxx, syy, sxy = sums if good.all() else [s[good] for s in sums]
        cov, va, vb = sxy - sx * sy / n, sxx - sx * sx / n, syy - sy * sy / n
        with np.errstate(divide="ignore", invalid="ignore"):
            spread = np.sqrt(va * vb)
            return good, [np.ma.array(cov / spread, mask=(va <= 0) | (vb <= 0) | (spread == 0))]

    fields = [T.StructField("return_corr", T.DoubleType())]
    return _co_occurrence(rows, "_bar", True, result, fields, lambda size_a, _: np.full(len(size_a), float(min_days)))


def max_corr_with_active(corr: DataFrame, active: Sequence[str]) -> DataFrame:
    """Largest correlation of each rule with an active one."""
    both = corr.unionByName(
        corr.select(F.col("rule_b").alias("rule_a"), F.col("rule_a").alias("rule_b"), "return_corr")
    )
    hit = both.filter(F.col("rule_b").isin(list(active)))
    return hit.groupBy(F.col("rule_a").alias("rule_id")).agg(F.max("return_corr").alias("corr_max_active"))


# ---------------------------------------------------------------- decay and shapes


def cusum(df: DataFrame, group: Sequence[str], value: str, expected: Column, sigma: Column, h: float = 4.0, seq: str = "seq") -> DataFrame:
    """One-sided CUSUM of a falling mean: S - running min S, alarm at h deviations."""
    group = list(group)
    piece = F.floor(F.col(seq) / F.lit(65_536)).cast("bigint")
    dev = F.try_divide(expected - F.col(value), sigma)
    s = running(df, group, seq, piece, {"_s": ("sum", dev)})
    m = running(s, group, seq, piece, {"_m": ("min", F.least(F.col("_s"), F.lit(0.0)))})
    return m.withColumn("cusum", F.col("_s") - F.col("_m")).withColumn("alarm", F.col("cusum") > h).drop("_s", "_m")


def accel(f: Frames, x: str, w: int) -> Column:
    """Change of the change over w rows."""
    return F.col(x) - 2 * f.lag(x, w) + f.lag(x, 2 * w)


def vol_adj(f: Frames, x: str, vol: str) -> Column:
    return F.try_divide(F.col(x), F.col(vol))


def divergence(f: Frames, a: str, b: str, w: int) -> Column:
    """Residual of a on b over the last w rows (rolling regression), NULL until w values of both are there.

    Covariances of two parts of a frame merge, so a row costs the same whatever w is.
    """
    cov, sd = f.roll_cov(a, b, w), f.roll("std_pop", b, w)
    fitted = f.roll("avg", a, w) + F.try_divide(cov, sd * sd) * (F.col(b) - f.roll("avg", b, w))
    return F.when(cov.isNotNull(), F.col(a) - fitted)


def sign_run(indexed: DataFrame, keys: Sequence[str], value: str, out: str = "sign_run") -> DataFrame:
    """Add the length of the current run of equal sign, signed; 0 for zero."""
    keys = list(keys)
    sign = F.signum(F.col(value)).cast("bigint")
    marked = add_windowed(
        indexed.withColumn("_sg", sign), keys, lambda f: {"_new": ~F.col("_sg").eqNullSafe(f.lag("_sg", 1))}, before=1
    )
    start = running(
        marked,
        keys,
        POS,
        F.floor(F.col(POS) / F.lit(65_536)).cast("bigint"),
        {"_start": ("last", F.when(F.col("_new") | (F.col(POS) == 0), F.col(POS)))},
    )
    return start.withColumn(out, F.col("_sg") * (F.col(POS) - F.col("_start") + 1)).drop("_sg", "_new", "_start")


