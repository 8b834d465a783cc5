"""Ordered-series toolkit: windows and running values over keys of any size.

``Window.partitionBy(key).orderBy(ts)`` puts a whole key into one task. Here a
key is cut into pieces first, so a key that owns a third of the table is spread
over as many tasks as it has pieces:

* ``index_rows``  - row number inside the key, from per-piece counts;
* ``blocks``      - fixed-size pieces with a halo of neighbour rows, so that
  lag/lead and trailing ROWS frames are exact inside every piece;
* ``running``     - prefix values (sum, product, max, min, last non-null) as a
  local scan plus a carry-in from the small table of piece summaries.

The only per-key windows left run over the *piece summaries*: one row per
(key, time bucket) or (key, block), never one row per input row.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

POS = "pos"
BLK = "_blk"
CORE = "_core"
BUCKET = "_bucket"
KEY = "_key"

HOUR_MS = 3_600_000
DAY_MS = 86_400_000

#: rows of one block; a block is the largest unit one task has to sort
BLOCK_ROWS = 65_536


def time_bucket(ts: str | Column, width_ms: int) -> Column:
    """Time slot number of an epoch-ms column."""
    col = F.col(ts) if isinstance(ts, str) else ts
    return F.floor(col / F.lit(width_ms)).cast("bigint")


def _cols(order) -> list[Column]:
    items = order if isinstance(order, list | tuple) else [order]
    return [F.col(c) if isinstance(c, str) else c for c in items]


def _as_one(df: DataFrame, keys: Sequence[str]) -> tuple[DataFrame, list[str]]:
    """Put the keys into one struct: equal structs may hold nulls, so joins on it keep rows of a null key."""
    return (df.withColumn(KEY, F.struct(*keys)), [KEY]) if keys else (df, [])


def index_rows(
    df: DataFrame,
    keys: Sequence[str],
    order,
    bucket: Column,
    out: str = POS,
) -> DataFrame:
    """Add the 0-based position of each row inside its key.

    ``bucket`` must be non-decreasing along ``order`` (normally a time slot). Rows
    are numbered inside (key, bucket); the offset of a bucket is the running count
    of the earlier buckets. A null key is a key like any other.
    """
    df, keys = _as_one(df.withColumn(BUCKET, bucket), list(keys))
    by_key = W.partitionBy(*keys).orderBy(BUCKET).rowsBetween(W.unboundedPreceding, -1)
    offsets = (
        df.groupBy(*keys, BUCKET)
        .agg(F.count(F.lit(1)).alias("_n"))
        .select(*keys, BUCKET, F.coalesce(F.sum("_n").over(by_key), F.lit(0)).alias("_off"))
    )
    local = W.partitionBy(*keys, BUCKET).orderBy(*_cols(order))
    return (
        df.join(offsets, [*keys, BUCKET])
        .withColumn(out, F.row_number().over(local).cast("bigint") - 1 + F.col("_off"))
        .drop(BUCKET, KEY, "_off")
    )


def blocks(
    df: DataFrame,
    before: int = 0,
    after: int = 0,
    size: int | None = None,
    pos: str = POS,
) -> DataFrame:
    """Assign rows to position blocks and repeat the rows a neighbour block needs.

    A row at position p is needed by every row in [p - after, p + before]; it is
    copied to the blocks that hold those. ``_core`` marks the one block that owns
    it. With size >= 4 * halo at most every fourth row is copied.
    """
    size = size or max(BLOCK_ROWS, 4 * (before + after))
    own = F.floor(F.col(pos) / F.lit(size)).cast("bigint")
    if before == 0 and after == 0:
        return df.withColumn(BLK, own).withColumn(CORE, F.lit(True))
    lo = F.greatest(F.floor((F.col(pos) - F.lit(after)) / F.lit(size)), F.lit(0)).cast("bigint")
    hi = F.floor((F.col(pos) + F.lit(before)) / F.lit(size)).cast("bigint")
    return df.withColumn(BLK, F.explode(F.sequence(lo, hi))).withColumn(CORE, F.col(BLK) == own)


def core_rows(df: DataFrame) -> DataFrame:
    """Drop the halo copies again."""
    return df.filter(F.col(CORE)).drop(BLK, CORE)


#: up to this many rows Spark's own sliding frame is used; it re-reads the whole frame per row
SHORT_FRAME = 64


class Frames:
    """Window expressions inside a block: lag, lead and full trailing frames."""

    def __init__(self, keys: Sequence[str], pos: str = POS):
        self.w = W.partitionBy(*keys, BLK).orderBy(pos)
        self.wanted: dict[str, tuple[str, str | tuple[str, str], int]] = {}

    def lag(self, col: Column | str, n: int) -> Column:
        return F.lag(col, n).over(self.w) if n else _cols(col)[0]

    def lead(self, col: Column | str, n: int) -> Column:
        return F.lead(col, n).over(self.w) if n else _cols(col)[0]

    def rows(self, n: int):
        return self.w.rowsBetween(-(n - 1), 0)

    def full(self, agg: Column, col: Column | str, n: int) -> Column:
        """``agg`` over the last n rows, NULL until all n values are present."""
        frame = self.rows(n)
        return F.when(F.count(col).over(frame) == n, agg.over(frame))

    def roll(self, kind: str, col: str, n: int) -> Column:
        """sum, avg, std_pop, std_samp or max of the last n rows, NULL until n values are there.

        Long frames are columns that ``add_rolling`` adds before the expression is used.
        """
        if n <= SHORT_FRAME:
            return self.full(_ROLL_AGG[kind](col), col, n)
        name = f"_roll_{kind}_{col}_{n}"
        self.wanted[name] = (kind, col, n)
        return F.col(name)


    def roll_cov(self, a: str, b: str, n: int) -> Column:
        """Population covariance of two columns over the last n rows, NULL until n values of both are there."""
        name = f"_roll_cov_{a}_{b}_{n}"
        self.wanted[name] = ("cov", (a, b), n)
        return F.col(name)


_ROLL_AGG = {
    "sum": F.sum,
    "avg": F.avg,
    "std_pop": F.stddev_pop,
    "std_samp": F.stddev_samp,
    "max": F.max,
}


def add_rolling(
    blocked: DataFrame, keys: Sequence[str], wanted: dict[str, tuple[str, str, int]], pos: str = POS
) -> DataFrame:
    """Add long trailing aggregates to a blocked frame at a constant cost per row.

    Positions are cut into chunks of n rows. The last n rows are the tail of one chunk
    and the head of the next, so the aggregate is the running value from the chunk start
    up to the row, merged with the running value from n - 1 rows back down to the end of
    its chunk. Running frames are incremental, nothing is subtracted, and variances merge
    by the pairwise formula, so no digits are lost. Both runs stay in the block's task.
    """
    out = blocked
    by_row = W.partitionBy(*keys, BLK).orderBy(pos)
    for n in sorted({n for _, _, n in wanted.values()}):
        chunk = f"_chunk_{n}"
        out = out.withColumn(chunk, F.floor(F.col(pos) / F.lit(n)).cast("bigint"))
        span = W.partitionBy(*keys, BLK, chunk)
        head = span.orderBy(pos).rowsBetween(W.unboundedPreceding, 0)
        tail = span.orderBy(F.col(pos).desc()).rowsBetween(W.unboundedPreceding, 0)
        mine = {name: (kind, col) for name, (kind, col, m) in wanted.items() if m == n and kind != "cov"}
        pairs = {name: col for name, (kind, col, m) in wanted.items() if m == n and kind == "cov"}
        cols = sorted({c for _, c in mine.values()})
        kinds = {c: {k for k, c2 in mine.values() if c2 == c} for c in cols}

        def parts(c: str, frame, side: str) -> dict[str, Column]:
            got = {f"_{side}n_{c}": F.count(c).over(frame)}
            if kinds[c] & {"sum", "avg", "std_pop", "std_samp"}:
                got[f"_{side}s_{c}"] = F.sum(c).over(frame)
            if kinds[c] & {"std_pop", "std_samp"}:
                got[f"_{side}v_{c}"] = F.var_pop(c).over(frame)
            if "max" in kinds[c]:
                got[f"_{side}x_{c}"] = F.max(c).over(frame)
            return got

        def co_parts(name: str, frame, side: str) -> dict[str, Column]:
            a, b = (F.when(F.col(x).isNotNull() & F.col(y).isNotNull(), F.col(x)) for x, y in (pairs[name], pairs[name][::-1]))
            return {
                f"_{side}n{name}": F.count(a).over(frame),
                f"_{side}a{name}": F.avg(a).over(frame),
                f"_{side}b{name}": F.avg(b).over(frame),
                f"_{side}c{name}": F.covar_pop(a, b).over(frame),
            }

        heads = {k: v for c in cols for k, v in parts(c, head, "h").items()}
        tails = {k: v for c in cols for k, v in parts(c, tail, "t").items()}
        for name in pairs:
            heads |= co_parts(name, head, "h")
            tails |= co_parts(name, tail, "t")
        out = out.withColumns(heads).withColumns(tails)
        # a frame that is exactly one chunk is covered by its head alone
        one = F.col(pos) % F.lit(n) == n - 1
        out = out.withColumns({k: F.when(~one, F.lag(k, n - 1).over(by_row)) for k in tails})
        result = {}
        for name, (kind, c) in mine.items():
            hn, tn = F.col(f"_hn_{c}"), F.coalesce(F.col(f"_tn_{c}"), F.lit(0))
            ok = (hn + tn == n) & (one | F.col(f"_tn_{c}").isNotNull())
            if kind == "max":
                value = F.greatest(f"_hx_{c}", f"_tx_{c}")
            else:
                hs, ts = F.col(f"_hs_{c}"), F.coalesce(F.col(f"_ts_{c}"), F.lit(0.0))
                if kind == "sum":
                    value = hs + ts
                elif kind == "avg":
                    value = (hs + ts) / F.lit(n)
                else:
                    tv = F.coalesce(F.col(f"_tv_{c}"), F.lit(0.0))
                    gap = F.when(tn > 0, hs / hn - ts / tn).otherwise(F.lit(0.0))
                    m2 = F.col(f"_hv_{c}") * hn + tv * tn + gap * gap * hn * tn / F.lit(n)
                    value = F.sqrt(m2 / F.lit(n if kind == "std_pop" else n - 1))
            result[name] = F.when(ok, value)
        for name in pairs:
            hn, tn = F.col(f"_hn{name}"), F.coalesce(F.col(f"_tn{name}"), F.lit(0))
            gap_a, gap_b = (F.col(f"_h{k}{name}") - F.col(f"_t{k}{name}") for k in "ab")
            gap = F.when(tn > 0, gap_a * gap_b * hn * tn / F.lit(n)).otherwise(F.lit(0.0))
            held = F.col(f"_hc{name}") * hn + F.coalesce(F.col(f"_tc{name}") * tn, F.lit(0.0)) + gap
            result[name] = F.when((hn + tn == n) & (one | F.col(f"_tn{name}").isNotNull()), held / F.lit(n))
        out = out.withColumns(result).drop(chunk, *heads, *tails)
    return out


def apply_step(blocked: DataFrame, keys: Sequence[str], frames: Frames, step, pos: str = POS) -> DataFrame:
    """Add the columns of one step to a blocked frame, long aggregates first."""
    frames.wanted = {}
    columns = step(frames)
    wanted = {n: spec for n, spec in frames.wanted.items() if n not in blocked.columns}
    if wanted:
        blocked = add_rolling(blocked, keys, wanted, pos)
    return blocked.withColumns(columns)


def add_windowed(
    df: DataFrame,
    keys: Sequence[str],
    columns,
    before: int = 0,
    after: int = 0,
    pos: str = POS,
    size: int | None = None,
) -> DataFrame:
    """Add window columns to an indexed frame.

    ``columns`` is a function of ``Frames`` that returns {name: Column}, or a list
    of such functions when a later step reads the columns of an earlier one.
    """
    steps = columns if isinstance(columns, list | tuple) else [columns]
    frames = Frames(keys, pos)
    out = blocks(df, before, after, size, pos)
    for step in steps:
        out = apply_step(out, keys, frames, step, pos)
    return core_rows(out).drop(*[c for c in out.columns if c.startswith("_roll_")])


_LOCAL = {
    "sum": F.sum,
    "max": F.max,
    "min": F.min,
    "product": F.product,
    "last": lambda c: F.last(c, ignorenulls=True),
}


def _combine(kind: str, carry: Column, local: Column) -> Column:
    if kind == "sum":
        return F.when(carry.isNull(), local).when(local.isNull(), carry).otherwise(carry + local)
    if kind == "product":
        return F.when(carry.isNull(), local).when(local.isNull(), carry).otherwise(carry * local)
    if kind == "max":
        return F.greatest(carry, local)
    if kind == "min":
        return F.least(carry, local)
    return F.coalesce(local, carry)


def running(
    df: DataFrame,
    keys: Sequence[str],
    order,
    bucket: Column,
    values: dict[str, tuple[str, Column]],
    inclusive: bool = True,
) -> DataFrame:
    """Add running values {out: (kind, column)} over each key.

    Kinds: sum, product, max, min, last (last non-null; wrap a payload in a struct
    to keep null fields of a present row). Two levels: a scan inside (key, bucket)
    and the carry over the bucket summaries. ``bucket`` as in ``index_rows``.
    """
    order_cols = _cols(order)
    df, keys = _as_one(df.withColumn(BUCKET, bucket), list(keys))
    df = df.withColumns({f"_v_{o}": c for o, (_, c) in values.items()})

    def summary(out: str, kind: str) -> Column:
        if kind == "last":
            seen = F.when(F.col(f"_v_{out}").isNotNull(), F.struct(*order_cols))
            return F.max_by(f"_v_{out}", seen)
        return _LOCAL[kind](f"_v_{out}")

    sums = df.groupBy(*keys, BUCKET).agg(*[summary(o, k).alias(f"_s_{o}") for o, (k, _) in values.items()])
    prev = W.partitionBy(*keys).orderBy(BUCKET).rowsBetween(W.unboundedPreceding, -1)
    carry = sums.select(
        *keys, BUCKET, *[_LOCAL[k](F.col(f"_s_{o}")).over(prev).alias(f"_c_{o}") for o, (k, _) in values.items()]
    )
    local = W.partitionBy(*keys, BUCKET).orderBy(*order_cols).rowsBetween(
        W.unboundedPreceding, W.currentRow if inclusive else -1
    )
    out = df.join(carry, [*keys, BUCKET])
    out = out.withColumns(
        {
            o: _combine(k, F.col(f"_c_{o}"), _LOCAL[k](F.col(f"_v_{o}")).over(local))
            for o, (k, _) in values.items()
        }
    )
    return out.drop(BUCKET, KEY, *[f"_v_{o}" for o in values], *[f"_c_{o}" for o in values])


def latest(df: DataFrame, keys: Sequence[str], order: Column | Sequence[Column], cols: Sequence[str]) -> DataFrame:
    """One row per key, the one with the greatest ``order``.

    ``max_by`` keeps one candidate per key and task before the shuffle, so no key
    is ever gathered.
    """
    order = F.struct(*order) if isinstance(order, list | tuple) else order
    picked = df.groupBy(*keys).agg(F.max_by(F.struct(*cols), order).alias("_r"))
    return picked.select(*keys, *[F.col(f"_r.{c}").alias(c) for c in cols])


def suggest_bucket_ms(df: DataFrame, keys: Sequence[str], ts: str = "ts", rows: int = 1_000_000) -> int:
    """Widest of a few slot widths whose fullest (key, slot) stays under ``rows``.

    One aggregate job that returns one row; the per-minute counts are combined on
    the map side and rolled up to the wider slots.
    """
    minute = 60_000
    widths = [DAY_MS, 6 * HOUR_MS, HOUR_MS, 10 * minute, minute]
    fine = df.groupBy(*keys, time_bucket(ts, minute).alias("_m")).agg(F.count(F.lit(1)).alias("_n"))
    best = minute
    peaks = [
        fine.groupBy(*keys, F.floor(F.col("_m") / (w // minute)).alias("_w"))
        .agg(F.sum("_n").alias("_n"))
        .agg(F.lit(w).alias("w"), F.max("_n").alias("peak"))
        for w in widths
    ]
    union = peaks[0]
    for p in peaks[1:]:
        union = union.unionByName(p)
    row = union.filter(F.col("peak") <= rows).agg(F.max("w").alias("w")).first()
    if row is not None and row["w"] is not None:
        best = int(row["w"])
    return best
