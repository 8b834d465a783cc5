"""Block permutation test and stationary bootstrap, parallel over iterations.

Draws come from hashes of (iteration, index), so they do not depend on partitioning and a
retried task repeats them. Only what a draw needs is made: iterations x fired blocks for the
permutation, iterations x runs for the bootstrap. Statistics of drawn series that are mergeable
(mean, Sharpe, drawdown, extremes) are made in the task that draws: of the drawn values where runs are
short, else from a tree of summaries over the series. Only others read the drawn series as rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from barline.functions.normal import PRIME, portable_hash, portable_hash_sql, wide_hash, wide_hash_sql
from barline.operators.stats import max_drawdown, merge_drawdowns
from barline.session import materialize


def _iterations(n: int) -> Column:
    return F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(n - 1).cast("bigint"))).alias("iter")


def _spread(df: DataFrame, *cols: str) -> DataFrame:
    """Hash-partition few driver rows before each of them is exploded.

    The count is explicit because adaptive execution would merge the (still tiny)
    partitions into one task.
    """
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return df.repartition(n, *cols)


#: rounds of the block shuffle
ROUNDS = 24


def _round_seeds(seed: int, r: int) -> tuple[int, int]:
    return seed + 15_485_863 + r, seed + 32_452_843 * (r + 1)


def shuffled_place(iteration: np.ndarray, block: np.ndarray, n: np.ndarray, seed: int) -> np.ndarray:
    """Place of a block after the n blocks are shuffled: a bijection of 0 to n - 1 for each iteration.

    A swap-or-not shuffle, which fits any n: each round pairs x with key - x (mod n) and a hashed bit, the same
    for both, tells whether they change places. A place takes no knowledge of the other blocks.
    """
    iteration, x, n = (np.asarray(v, np.int64) for v in (iteration, block, n))
    for r in range(ROUNDS):
        key, bit = _round_seeds(seed, r)
        other = (wide_hash(iteration, r, key) % n - x + n) % n
        x = np.where(portable_hash(iteration, np.maximum(x, other), bit) % 2 == 1, other, x)
    return x


def shuffled_place_sql(source: str, iteration: str, block: str, n: str, seed: int, out: str) -> str:
    """``source`` (a table or subquery) with the column ``out``: the same shuffle as SQL text."""
    sql = f"SELECT *, CAST({block} AS BIGINT) AS {out} FROM {source}"
    for r in range(ROUNDS):
        key, bit = _round_seeds(seed, r)
        other = f"({wide_hash_sql(iteration, str(r), key)} % {n} - {out} + {n}) % {n}"
        swap = portable_hash_sql(iteration, f"greatest({out}, _other)", bit)
        sql = (
            f"SELECT * EXCLUDE ({out}, _other), CASE WHEN {swap} % 2 = 1 THEN _other ELSE {out} END AS {out} "
            f"FROM (SELECT *, {other} AS _other FROM ({sql}))"
        )
    return sql


def permutation_test(
    fires: DataFrame,
    labels: DataFrame,
    group: Sequence[str],
    label_group: Sequence[str],
    block_len: int | str,
    iterations: int = 1000,
    seed: int = 0,
    pos: str = "pos",
    label: str = "fwd_bps",
) -> DataFrame:
    """Is the mean label at fired bars better than at shuffled blocks of the fires?

    ``fires``: group columns and position of every fired bar. ``labels``: one row per
    bar of a series (``label_group``, a subset of ``group``) with its label, NULL = no
    label; rules that share a series share its labels. Fires are cut in blocks of
    ``block_len`` bars (a number, or a column of ``fires`` constant per group), the
    blocks are shuffled, what lands behind the end of the series is cut off, and the
    mean label at the moved fires is the null value of an iteration. The place of a
    block is computed from its number alone, so blocks without fires are never made.

    p = (1 + #{null >= observed}) / (iterations + 1). Groups none of whose fires has a
    label give no row; ``no_fire_result`` adds them. A null key is a key like any other.
    """
    blen = F.lit(block_len) if isinstance(block_len, int) else F.col(block_len)
    by, of = F.struct(*group).alias("_g"), F.struct(*label_group).alias("_s")
    marks = fires.select(by, of, F.col(pos).alias("_p"), F.greatest(blen, F.lit(1)).cast("bigint").alias("_l"))
    series = labels.select(of, F.col(pos).alias("_p"), F.col(label).alias("_y"))
    known = series.filter(F.col("_y").isNotNull())
    hits = marks.join(known, ["_s", "_p"])
    sizes = series.groupBy("_s").agg((F.max("_p") + 1).alias("_n"))
    head = hits.groupBy("_g").agg(F.avg("_y").alias("observed"), F.count(F.lit(1)).alias("fires"))

    @F.pandas_udf("bigint")
    def place(iteration: pd.Series, block: pd.Series, n: pd.Series) -> pd.Series:
        return pd.Series(shuffled_place(iteration.to_numpy(), block.to_numpy(), n.to_numpy(), seed))

    fired = hits.groupBy("_g", "_s", "_l", F.floor(F.col("_p") / F.col("_l")).cast("bigint").alias("_b")).agg(
        F.collect_list(F.col("_p") % F.col("_l")).alias("_offsets")
    )
    n_blocks = F.ceil(F.col("_n") / F.col("_l")).cast("bigint")
    moved = (
        _spread(fired.join(sizes, "_s"), "_g", "_b")
        .select("_g", "_s", "_l", "_b", "_n", "_offsets", _iterations(iterations))
        .withColumn("_at", place("iter", "_b", n_blocks) * F.col("_l"))
    )
    landed = moved.withColumn("_o", F.explode("_offsets")).withColumn("_p", F.col("_at") + F.col("_o")).filter("_p < _n")
    landed = landed.select("_g", "_s", "iter", "_p")
    # a left join, so that the landed fires are never what is broadcast; places without a label count nowhere
    drawn = landed.join(known, ["_s", "_p"], "left").groupBy("_g", "iter").agg(F.avg("_y").alias("_null"))
    nulls = (
        head.select("_g", "fires", "observed", _iterations(iterations))
        .join(drawn, ["_g", "iter"], "left")
        .withColumn("_null", F.coalesce("_null", F.lit(0.0)))
    )
    result = nulls.groupBy("_g").agg(
        F.max("fires").alias("fires"),
        F.max("observed").alias("observed_ev_bps"),
        ((F.count(F.when(F.col("_null") >= F.col("observed"), 1)) + 1) / F.lit(iterations + 1.0)).alias("p_value"),
        F.avg("_null").alias("null_mean"),
        F.coalesce(F.stddev_samp("_null"), F.lit(0.0)).alias("null_std"),
    )
    return result.select("_g.*", *[c for c in result.columns if c != "_g"])


def no_fire_result(groups: DataFrame, result: DataFrame, group: Sequence[str]) -> DataFrame:
    """The result for every group, with (0, p = 1) where nothing fired."""
    fill = {"fires": F.lit(0).cast("bigint"), "observed_ev_bps": F.lit(0.0), "p_value": F.lit(1.0),
            "null_mean": F.lit(0.0), "null_std": F.lit(0.0)}
    return groups.select(*group).join(result, list(group), "left").withColumns(
        {n: F.coalesce(F.col(n), v) for n, v in fill.items()}
    )


#: positions that are drawn together; what a task makes at once is in proportion
SEGMENT = 1 << 16

#: runs that one step makes
_STEP_RUNS = 1 << 17

_SPAN = float(PRIME) * PRIME


def _run_starts(it: np.ndarray, segment: np.ndarray, n: np.ndarray, p: np.ndarray, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, position) of the run starts in a segment of each row, in order.

    The gaps between starts are geometric, so they are drawn directly, by counter: the number of a gap in its segment
    and the segment make the hash. A gap does not remember what came before, so segments are drawn by themselves.
    """
    begin = segment * SEGMENT
    end = np.minimum(n, begin + SEGMENT)
    with np.errstate(divide="ignore"):
        decay = np.log(1.0 - p)  # -inf where every position starts a run
    rows, places = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    live, at, j = np.arange(len(it)), begin - 1, 0
    while len(live):
        width = int(np.max((end - at)[live] * p[live]) * 1.1) + 16
        count = j + np.arange(width)
        u = (wide_hash(it[live, None], begin[live, None] + count, seed) + 1.0) / _SPAN
        gap = np.floor(np.log(u) / decay[live, None]).astype(np.int64)
        # position 0 always starts one
        gap[(segment[live] == 0)[:, None] & (count == 0)] = 0
        place = at[live, None] + np.cumsum(1 + gap, axis=1)
        inside = place < end[live, None]
        rows.append(np.repeat(live, inside.sum(axis=1)))
        places.append(place[inside])
        at[live] = place[:, -1]
        live, j = live[at[live] < end[live]], j + width
    if len(rows) <= 2:
        return rows[-1], places[-1]
    rows, places = np.concatenate(rows), np.concatenate(places)
    order = np.lexsort((places, rows))
    return rows[order], places[order]


def _segment_runs(
    it: np.ndarray, segment: np.ndarray, n: np.ndarray, p: np.ndarray, seed: int, since: np.ndarray | None = None
) -> tuple[np.ndarray, ...]:
    """(row, t, len, start) of the runs of a segment; one that comes in from before goes on from the segment's border.

    ``since`` tells where that one began, if known; it gets the beginning of the last run for the next segment.
    """
    row, t = _run_starts(it, segment, n, p, seed)
    begin = segment * SEGMENT
    origin = t
    first = np.full(len(it), -1)
    first[row[::-1]] = t[::-1]
    late = np.flatnonzero(first != begin)  # never in segment 0
    if len(late):
        if since is None:
            since, rest, back = np.zeros(len(it), np.int64), late, segment[late] - 1
            while len(rest):
                r, s = _run_starts(it[rest], back, n[rest], p[rest], seed)
                found = np.full(len(rest), -1)
                found[r] = s  # the last one stays
                since[rest] = found
                rest, back = rest[found < 0], back[found < 0] - 1
        # before the first of its row
        at = np.searchsorted(row, late)
        row, t, origin = np.insert(row, at, late), np.insert(t, at, begin[late]), np.insert(origin, at, since[late])
    following = np.append(t[1:], 0)
    last = np.append(row[1:] != row[:-1], True)[: len(row)]
    if since is not None:
        since[row[last]] = origin[last]
    following[last] = np.minimum(n, begin + SEGMENT)[row[last]]
    start = (wide_hash(it[row], origin, seed + 7919) % n[row] + t - origin) % n[row]
    return row, t, following - t, start


def _nodes(
    row: np.ndarray, t: np.ndarray, length: np.ndarray, start: np.ndarray, n: np.ndarray, top: int = 62
) -> tuple[np.ndarray, ...]:
    """(row, t, level, node) of the aligned pieces that make up runs: node b of level k is [b 2^k, (b + 1) 2^k).

    Pieces are of level ``top`` at most.
    """
    wraps = np.flatnonzero(start + length > n[row])
    a = np.concatenate([start, np.zeros(len(wraps), np.int64)])
    b = np.concatenate([np.minimum(start + length, n[row]), (start + length - n[row])[wraps]])
    t = np.concatenate([t, t[wraps] + (n[row] - start)[wraps]])
    row = np.concatenate([row, row[wraps]])
    out = [[np.zeros(0, np.int64)] for _ in range(4)]
    level, lo, hi = 0, a, b
    while len(row):
        if level == top:
            each = np.repeat(np.arange(len(row)), hi - lo)
            node = lo[each] + np.arange(len(each)) - np.repeat(np.cumsum(hi - lo) - (hi - lo), hi - lo)
            for part, v in zip(out, (row[each], (t - a)[each] + (node << level), np.full(len(each), level), node)):
                part.append(v)
            break
        for here, node in ((lo % 2 == 1, lo), (hi % 2 == 1, hi - 1)):
            here = here & (lo < hi)
            for part, v in zip(out, (row[here], (t - a)[here] + (node[here] << level), np.full(here.sum(), level), node[here])):
                part.append(v)
        lo, hi, level = (lo + 1) // 2, hi // 2, level + 1
        on = lo < hi
        row, t, a, lo, hi = row[on], t[on], a[on], lo[on], hi[on]
    return tuple(np.concatenate(p) for p in out)


def _steps(it: np.ndarray, segment: np.ndarray, n: np.ndarray, p: np.ndarray) -> Iterator[slice]:
    """Cuts of the rows (iteration, segment) of which each makes a bounded number of runs."""
    step = max(1, int(_STEP_RUNS / max(1.0, (np.minimum(n, SEGMENT) * p).max(initial=1.0))))
    for lo in range(0, len(it), step):
        yield slice(lo, min(lo + step, len(it)))


def _chance(avg_block: float | str) -> Column:
    mean_len = F.lit(float(avg_block)) if isinstance(avg_block, int | float) else F.col(avg_block).cast("double")
    return 1.0 / F.greatest(mean_len, F.lit(1.0))


def bootstrap_runs(
    sizes: DataFrame, group: Sequence[str], avg_block: float | str, iterations: int, seed: int
) -> DataFrame:
    """Runs of a stationary bootstrap: (group, iter, t, n, len, start) for n positions.

    Position 0 and, with chance 1 / avg_block, any other position starts a run at a
    random index; the run then walks on (wrapping) until the next start. Gaps between
    starts are drawn, not positions: about n / avg_block rows per iteration, and one more
    at every border of 65,536 positions, where the run that comes in is cut in two.
    """
    rows = _spread(sizes.select(F.struct(*group).alias("_g"), "n", _chance(avg_block).alias("_p"), _iterations(iterations)), "_g", "iter")
    last = F.floor((F.col("n") - 1) / F.lit(SEGMENT)).cast("bigint")
    rows = rows.select("_g", "iter", "n", "_p", F.explode(F.sequence(F.lit(0).cast("bigint"), last)).alias("_segment"))

    def draw(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            it, n, p, segment = (batch.column(k).to_numpy() for k in (1, 2, 3, 4))
            for cut in _steps(it, segment, n, p):
                row, *made = _segment_runs(it[cut], segment[cut], n[cut], p[cut], seed)
                index = pa.array(row + cut.start)
                columns = [batch.column(k).take(index) for k in range(3)] + [pa.array(v) for v in made]
                yield pa.RecordBatch.from_arrays(columns, names=["_g", "iter", "n", "t", "len", "start"])

    fields = [T.StructField(c, T.LongType()) for c in ("iter", "n", "t", "len", "start")]
    runs = rows.mapInArrow(draw, T.StructType([rows.schema["_g"], *fields]))
    return runs.select("_g.*", "iter", "t", "n", "len", "start")


def bootstrap_runs_sql(sizes: str, key: str, avg_block: float, iterations: int, seed: int = 0) -> str:
    """The same runs as SQL text, of a table ``sizes`` (key, n) with n up to 65,536: (key, n, it, t, len, start)."""
    decay = repr(float(np.log(1.0 - 1.0 / avg_block)))
    gap = f"CAST(floor(ln((CAST({wide_hash_sql('it', 'j', seed)} AS DOUBLE) + 1.0::DOUBLE) / {_SPAN!r}::DOUBLE) / ({decay})::DOUBLE) AS BIGINT)"
    # a good third more gaps than are needed, and some
    return f"""SELECT {key}, n, it, t, lead(t, 1, n) OVER (PARTITION BY {key}, it ORDER BY t) - t AS len, {wide_hash_sql("it", "t", seed + 7919)} % n AS start
  FROM (SELECT {key}, n, it, CAST(sum(CASE WHEN j = 0 THEN 0 ELSE 1 + {gap} END) OVER (PARTITION BY {key}, it ORDER BY j) AS BIGINT) AS t
    FROM {sizes}, (SELECT unnest(range({iterations})) AS it) i, LATERAL (SELECT unnest(range(least(n, n * 4 // {3 * int(avg_block)} + 200))) AS j) jj)
  WHERE t < n"""


@dataclass(frozen=True)
class Summary:
    """A summary of a piece of a series, which two neighbours make one of.

    ``leaf`` gives the columns of single values (NaN = missing), ``merge`` those of left and right pieces, and
    ``finish`` the result (keys, stat) of pieces (keys, t, columns) that follow one another along t. Unless the
    order of pieces matters (``ordered``), those that do not touch are merged, too. ``fold`` is leaf and merge at once.
    """

    columns: tuple[str, ...]
    leaf: Callable[[np.ndarray], tuple[np.ndarray, ...]]
    merge: Callable[[tuple[np.ndarray, ...], tuple[np.ndarray, ...]], tuple[np.ndarray, ...]]
    finish: Callable[[DataFrame, Sequence[str]], DataFrame]
    ordered: bool = True
    #: the columns of each row of a matrix of values, all of which are ``plain``
    fold: Callable[[np.ndarray], tuple[np.ndarray, ...]] | None = None
    plain: Callable[[np.ndarray], np.ndarray] = np.isfinite


#: levels of a tree above the single values; no piece of a run is longer than a segment
_LEVELS = 16

#: positions of a series whose tree one task holds, a multiple of a segment (five numbers each for a drawdown: 640 MB)
CHUNK = 1 << 24

#: drawn positions that are worth a task of their own
_TASK_DRAWS = 1 << 24


def _tree(x: np.ndarray, summary: Summary, top: int) -> list[tuple[np.ndarray, ...]]:
    """Summaries of all aligned pieces of 2^k values that are there in full, for k from 1 to ``top``."""
    level, levels = summary.leaf(x), []
    while len(level[0]) > 1 and len(levels) < top:
        pairs = len(level[0]) // 2
        level = summary.merge(tuple(v[: 2 * pairs : 2] for v in level), tuple(v[1 : 2 * pairs : 2] for v in level))
        levels.append(level)
    return levels


def _looked_up(x: np.ndarray, levels: list[tuple[np.ndarray, ...]], level: np.ndarray, node: np.ndarray, summary: Summary):
    """The summaries of nodes (counted from the first value)."""
    out = tuple(np.empty(len(level)) for _ in summary.columns)
    for k in range(len(levels) + 1):
        here = np.flatnonzero(level == k)
        if len(here):
            found = summary.leaf(x[node[here]]) if k == 0 else tuple(v[node[here]] for v in levels[k - 1])
            for part, v in zip(out, found):
                part[here] = v
    return out


def _merged(group: np.ndarray, parts: tuple[np.ndarray, ...], summary: Summary) -> tuple[np.ndarray, ...]:
    """One summary for each group of neighbours; groups are numbered in order."""
    while len(group):
        first = np.flatnonzero(np.append(True, group[1:] != group[:-1]))
        if len(first) == len(group):
            break
        place = np.arange(len(group)) - np.repeat(first, np.diff(np.append(first, len(group))))
        left = np.flatnonzero(place % 2 == 0)
        two = np.flatnonzero(np.append(place[1:], 0)[left] % 2 == 1)
        both = summary.merge(tuple(v[left[two]] for v in parts), tuple(v[left[two] + 1] for v in parts))
        parts = tuple(v[left] for v in parts)
        for part, v in zip(parts, both):
            part[two] = v
        group = group[left]
    return parts


#: runs of up to so many positions on average are drawn value by value; longer ones are a few nodes of a tree
_SHORT_RUNS = 64

#: drawn positions that are made at once, and those that are folded together
_STEP_DRAWS, _FOLD = 1 << 18, 64


def _drawn(x: np.ndarray, mine: np.ndarray, p: float, seed: int, summary: Summary, span: int) -> Iterator[tuple]:
    """(iterations, t, summary) of each segment of the series that some iterations draw of values x, all of them plain."""
    n = len(x)
    # a run that wraps goes on behind the end
    held = np.append(x, x[: min(n, span)])
    step = max(1, _STEP_DRAWS // min(n, span))
    for lo in range(0, len(mine), step):
        it = mine[lo : lo + step]
        size, chance, since = np.full(len(it), n), np.full(len(it), p), np.zeros(len(it), np.int64)
        for segment in range((n - 1) // span + 1):
            _, _, length, start = _segment_runs(it, np.full(len(it), segment), size, chance, seed, since)
            upto = np.cumsum(length)
            index = np.repeat(start - (upto - length), length)
            index += np.arange(len(index))
            values = held[index].reshape(len(it), -1)
            whole = values.shape[1] // _FOLD * _FOLD
            parts = []
            if whole:
                folded = summary.fold(values[:, :whole].reshape(-1, _FOLD))
                parts.append(_merged(np.repeat(np.arange(len(it)), whole // _FOLD), folded, summary))
            if whole < values.shape[1]:
                parts.append(summary.fold(values[:, whole:]))
            yield it, segment * span, parts[0] if len(parts) == 1 else summary.merge(*parts)


def bootstrap_summaries(
    values: DataFrame,
    group: Sequence[str],
    value: str,
    summary: Summary,
    avg_block: float | str,
    iterations: int,
    seed: int = 0,
    seq: str = "seq",
) -> DataFrame:
    """A mergeable statistic of every resampled series, no drawn row of which is shuffled: (group, iter, stat).

    Values go to the draws, not draws to the values: a task has a series (``CHUNK`` positions of a longer one), draws the
    runs of some iterations and gives one summary for each of them and segment. Short runs are drawn value by value and
    folded. A long one is a few pieces of the series' tree, two per level at most, so its summary takes logarithmic time.
    Draws come from counters, so tasks that have other positions of a series repeat them and keep other pieces.
    """
    extra = [] if isinstance(avg_block, int | float) else [F.max(avg_block).alias(avg_block)]
    groups = values.groupBy(F.struct(*group).alias("_key")).agg(F.count(F.lit(1)).alias("n"), *extra)
    # a number for each series: what is made per draw carries no key columns
    groups = materialize(groups.withColumn("_p", _chance(avg_block)).drop(*extra and [avg_block]), "series")
    groups = groups.withColumn("_id", F.monotonically_increasing_id())
    long = lambda x: x.cast("bigint")
    segment = long(F.floor(F.col(seq) / F.lit(SEGMENT))).alias("_segment")
    rows = values.select(F.struct(*group).alias("_key"), F.col(seq).cast("bigint").alias("_t"), F.col(value).cast("double").alias("_x"), segment)
    rows = rows.join(groups.select("_key", "_id"), "_key").select("_id", "_segment", "_t", "_x")

    def pack(piece: pa.Table) -> pa.Table:
        piece = piece.sort_by("_t")
        head = {c: piece.column(c)[:1] for c in ("_id", "_segment", "_t")}
        x = piece.column("_x").to_numpy().astype(float)
        return pa.table({**head, "_values": pa.array([x.tobytes()], pa.binary())})

    packed = rows.groupBy("_id", "_segment").applyInArrow(pack, "_id bigint, _segment bigint, _t bigint, _values binary")
    chunks = groups.agg(F.sum(F.ceil(F.col("n") / CHUNK))).head()[0] or 1
    most = max(1, -(-4 * values.sparkSession.sparkContext.defaultParallelism // int(chunks)))
    worth = F.ceil(F.least(F.col("n"), F.lit(CHUNK)) * F.lit(iterations) / F.lit(_TASK_DRAWS))
    tasks = long(F.least(worth, F.lit(min(most, iterations))))
    dealt = packed.join(groups.select("_id", "n", "_p", tasks.alias("_tasks")), "_id")
    dealt = dealt.withColumn("_chunk", long(F.floor(F.col("_segment") / F.lit(CHUNK // SEGMENT))))
    dealt = dealt.filter(F.col("_chunk") * CHUNK < F.col("n")).withColumn("_task", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("_tasks") - 1)))
    columns, top = list(summary.columns), min(_LEVELS, (SEGMENT - 1).bit_length())
    step_chunk, span, short = CHUNK, SEGMENT, 1.0 / _SHORT_RUNS

    def draw(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = {}
        for batch in batches:
            if not batch.num_rows:
                continue
            head = {c: batch.column(c)[0].as_py() for c in ("_id", "n", "_p", "_tasks", "_chunk", "_task")}
            for s, t, raw in zip(batch.column("_segment").to_pylist(), batch.column("_t").to_pylist(), batch.column("_values")):
                pieces[s] = t - s * span, np.frombuffer(raw.as_buffer(), float)
        n, begin = head["n"], head["_chunk"] * step_chunk
        whole = max(-(-min(n - begin, step_chunk) // span), max(pieces) - begin // span + 1)
        missing = summary.leaf(np.array([np.nan]))
        x = np.full(whole * span, np.nan)
        mine = np.arange(head["_task"], iterations, head["_tasks"])
        if summary.fold is not None and head["_p"] >= short and n <= step_chunk:
            for s, (first, own) in pieces.items():
                x[s * span + first : s * span + first + len(own)] = own
            if summary.plain(x[:n]).all() and np.isnan(x[n:]).all():
                for it, t, parts in _drawn(x[:n], mine, head["_p"], seed, summary, span):
                    keys = [pa.array(np.full(len(it), v) if np.isscalar(v) else v) for v in (head["_id"], it, t)]
                    yield pa.RecordBatch.from_arrays([*keys, *map(pa.array, parts)], names=["_id", "iter", "t", *columns])
                return
        levels = [tuple(np.full(whole * span >> k, v[0]) for v in missing) for k in range(1, top + 1)]
        for s in sorted(pieces):
            # a segment's pieces are counted from its first row, wherever that is
            first, own = pieces.pop(s)
            at = s * span - begin
            x[at + first : at + first + len(own)] = own
            for k, made in enumerate(_tree(own, summary, top), 1):
                lo = (at >> k) + (first >> k)
                for part, v in zip(levels[k - 1], made):
                    part[lo : lo + len(v)] = v
        last = (n - 1) // span + 1
        it, at = np.repeat(mine, last), np.tile(np.arange(last), len(mine))
        size, p = np.full(len(it), n), np.full(len(it), head["_p"])
        for cut in _steps(it, at, size, p):
            row, t, level, node = _nodes(*_segment_runs(it[cut], at[cut], size[cut], p[cut], seed), size[cut], top)
            if n > step_chunk:
                here = (node << level) // step_chunk == head["_chunk"]
                row, t, level, node = row[here], t[here], level[here], node[here]
            # levels come in order already, so that this merges them
            order = np.argsort(row * n + t, kind="stable")
            row, t, level, node = row[order], t[order], level[order], node[order]
            breaks = row[1:] != row[:-1]
            if n > step_chunk and summary.ordered:
                breaks |= t[1:] != (t + (1 << level))[:-1]
            starts = np.append(True, breaks)[: len(row)]
            parts = _looked_up(x, levels, level, node - (begin >> level), summary)
            parts = _merged(np.cumsum(starts), parts, summary)
            keys = [pa.array(np.full(int(starts.sum()), head["_id"])), pa.array(it[cut][row[starts]]), pa.array(t[starts])]
            yield pa.RecordBatch.from_arrays([*keys, *(pa.array(v, from_pandas=True) for v in parts)], names=["_id", "iter", "t", *columns])

    schema = T.StructType([T.StructField(c, T.LongType()) for c in ("_id", "iter", "t")] + [T.StructField(c, T.DoubleType()) for c in columns])
    by = ("_id", "_chunk", "_task")
    # the count is explicit, as few bytes make much work
    n = max(int(chunks) * most, int(values.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    met = dealt.repartition(min(n, 2000), *by).groupBy(*by).applyInArrow(draw, schema)
    done = summary.finish(met, ["_id", "iter"])
    return done.join(groups.select("_id", "_key"), "_id").drop("_id").select("_key.*", "*").drop("_key")


def bootstrap_draws(
    values: DataFrame,
    group: Sequence[str],
    value: str,
    avg_block: float | str,
    iterations: int,
    seed: int = 0,
    seq: str = "seq",
) -> DataFrame:
    """Resampled series: (group, iter, t, value) for every iteration and position."""
    group = list(group)
    extra = [] if isinstance(avg_block, int | float) else [F.max(avg_block).alias(avg_block)]
    sizes = values.groupBy(*group).agg(F.count(F.lit(1)).alias("n"), *extra)
    runs = bootstrap_runs(sizes, group, avg_block, iterations, seed)
    k = F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("len") - 1))
    index = (
        runs.withColumn("_k", k)
        .withColumn(seq, (F.col("start") + F.col("_k")) % F.col("n"))
        .select(*group, "iter", (F.col("t") + F.col("_k")).alias("t"), seq)
    )
    return index.join(values.select(*group, seq, value), [*group, seq]).select(*group, "iter", "t", value)


def bootstrap_moments(
    values: DataFrame,
    group: Sequence[str],
    value: str,
    avg_block: float | str,
    iterations: int,
    seed: int = 0,
    seq: str = "seq",
) -> DataFrame:
    """Mean and sample deviation of every resampled series: (group, iter, mean, sd).

    Count, sum and sum of squares of a run come from the series' tree. Values count from the mean of their series,
    so no digits cancel; a variance under 1e-14 of the series' own is none. Missing values count in neither.
    """
    group = list(group)
    x = F.col(value).cast("double")
    whole = values.groupBy(*group).agg(
        F.avg(x).alias("_m"), F.min(x).alias("_lo"), F.max(x).alias("_hi"), F.var_samp(x).alias("_v")
    )
    whole = whole.select(F.struct(*group).alias("_g"), "_m", "_lo", "_hi", "_v")
    # equal values are 0 exactly, whatever their mean is rounded to
    off = F.when(F.col("_lo") < F.col("_hi"), x - F.col("_m")).otherwise(x - F.col("_lo"))
    rows = values.withColumn("_g", F.struct(*group)).join(whole, "_g").withColumn("_off", off)
    sums = bootstrap_summaries(rows, group, "_off", _SUMS, avg_block, iterations, seed, seq)
    sums = sums.select(F.struct(*group).alias("_g"), "iter", "_s0", "_s1", "_s2").join(whole, "_g")
    n, s1, s2 = F.col("_s0"), F.col("_s1"), F.col("_s2")
    var = F.when(n > 1, (s2 - s1 * s1 / n) / (n - 1))
    return sums.select(
        "_g.*",
        "iter",
        F.when(n > 0, F.col("_m") + s1 / n).alias("mean"),
        F.when(var > F.col("_v") * 1e-14, F.sqrt(var)).when(var.isNotNull(), F.lit(0.0)).alias("sd"),
    )


def _sums_leaf(x: np.ndarray) -> tuple[np.ndarray, ...]:
    there = ~np.isnan(x)
    value = np.where(there, x, 0.0)
    return there.astype(float), value, value * value


_SUMS = Summary(
    ("_s0", "_s1", "_s2"),
    _sums_leaf,
    lambda left, right: tuple(a + b for a, b in zip(left, right)),
    lambda pieces, keys: pieces.groupBy(*keys).agg(*[F.sum(c).alias(c) for c in ("_s0", "_s1", "_s2")]),
    ordered=False,
    fold=lambda x: (np.full(len(x), float(x.shape[1])), x.sum(axis=1), np.einsum("ij,ij->i", x, x)),
)

#: a statistic of drawn series. One with ``of_moments`` gives the same from their mean and deviation, one with
#: ``of_summary`` from a tree of summaries; others read the drawn rows
Statistic = Callable[[DataFrame, Sequence[str], str], DataFrame]


def mean_statistic(draws: DataFrame, group: Sequence[str], value: str) -> DataFrame:
    return draws.groupBy(*group).agg(F.avg(value).alias("stat"))


mean_statistic.of_moments = lambda: F.col("mean")


def sharpe_statistic(per_year: Column | None = None) -> Statistic:
    """mean / sample std * sqrt(per_year); 0 under two draws or without spread."""

    def stat(draws: DataFrame, group: Sequence[str], value: str) -> DataFrame:
        sd = F.stddev_samp(value)
        scale = F.sqrt(per_year) if per_year is not None else F.lit(1.0)
        ratio = F.when(sd > 0, F.try_divide(F.avg(value), sd)).otherwise(F.lit(0.0))
        return draws.groupBy(*group).agg(ratio.alias("stat")).withColumn("stat", F.col("stat") * scale)

    if per_year is None:  # else an expression over columns of the draws
        stat.of_moments = lambda: F.when(F.col("sd") > 0, F.col("mean") / F.col("sd")).otherwise(F.lit(0.0))
    return stat


def drawdown_statistic(draws: DataFrame, group: Sequence[str], value: str) -> DataFrame:
    return max_drawdown(draws, group, value, "t").withColumnRenamed("max_dd", "stat")


def _drawdown_leaf(x: np.ndarray) -> tuple[np.ndarray, ...]:
    end = 1.0 + x / 10_000.0
    return np.where(np.isnan(x), 1.0, end), end, end, np.where(np.isnan(x), np.nan, 0.0)


def _drawdown_merge(left: tuple[np.ndarray, ...], right: tuple[np.ndarray, ...]) -> tuple[np.ndarray, ...]:
    (end, hi, lo, dd), (end2, hi2, lo2, dd2) = left, right
    with np.errstate(divide="ignore", invalid="ignore"):
        fall = np.where(hi == 0, np.nan, end * lo2 / hi - 1.0)
    return end * end2, np.fmax(hi, end * hi2), np.fmin(lo, end * lo2), np.fmin(np.fmin(dd, dd2), fall)


def _drawdown_finish(pieces: DataFrame, keys: Sequence[str]) -> DataFrame:
    segment = F.floor(F.col("t") / F.lit(SEGMENT)).alias("_segment")
    parts = merge_drawdowns(pieces.select(*keys, segment, "t", "_end", "_hi", "_lo", "_dd"), [*keys, "_segment"], "t")
    return merge_drawdowns(parts, keys, "_segment").select(*keys, F.col("_dd").alias("stat"))


def _drawdown_fold(x: np.ndarray) -> tuple[np.ndarray, ...]:
    # value by value of all rows at once
    steps = np.empty(x.shape[::-1])
    np.divide(x.T, 10_000.0, out=steps)
    steps += 1.0
    end, least = steps[0].copy(), np.ones(len(x))
    hi, lo, ratio = end.copy(), end.copy(), np.empty(len(x))
    for step in steps[1:]:
        end *= step
        np.maximum(hi, end, out=hi)
        np.minimum(lo, end, out=lo)
        np.divide(end, hi, out=ratio)
        np.minimum(least, ratio, out=least)
    return end, hi, lo, least - 1.0


drawdown_statistic.of_summary = Summary(
    ("_end", "_hi", "_lo", "_dd"),
    _drawdown_leaf,
    _drawdown_merge,
    _drawdown_finish,
    fold=_drawdown_fold,
    plain=lambda x: np.isfinite(x) & (x > -10_000.0),
)

_MERGES = {"max": (np.fmax, F.max), "min": (np.fmin, F.min)}


def extremes_statistic(of: dict[str, str], result: Callable[..., Column]) -> Statistic:
    """A statistic over the largest and smallest values: {name: max or min}, and an expression of those columns."""

    def finish(pieces: DataFrame, keys: Sequence[str]) -> DataFrame:
        got = pieces.groupBy(*keys).agg(*[_MERGES[kind][1](name).alias(name) for name, kind in of.items()])
        return got.select(*keys, result(*[F.col(name) for name in of]).alias("stat"))

    def stat(draws: DataFrame, group: Sequence[str], value: str) -> DataFrame:
        return finish(draws.select(*group, *[F.col(value).cast("double").alias(name) for name in of]), group)

    def merge(left: tuple[np.ndarray, ...], right: tuple[np.ndarray, ...]) -> tuple[np.ndarray, ...]:
        return tuple(_MERGES[kind][0](a, b) for kind, a, b in zip(of.values(), left, right))

    def fold(x: np.ndarray) -> tuple[np.ndarray, ...]:
        return tuple(_MERGES[kind][0].reduce(x, axis=1) for kind in of.values())

    stat.of_summary = Summary(tuple(of), lambda x: (x,) * len(of), merge, finish, ordered=False, fold=fold)
    return stat


def aggregate_statistic(agg: Callable[[str], Column]) -> Statistic:
    """Any aggregate expression, or a grouped-aggregate pandas UDF, as a statistic."""

    def stat(draws: DataFrame, group: Sequence[str], value: str) -> DataFrame:
        return draws.groupBy(*group).agg(agg(value).alias("stat"))

    return stat


def percentile_ci(stats: DataFrame, group: Sequence[str], confidence: float = 0.95) -> DataFrame:
    """Interpolated percentile interval of the drawn statistics (iterations rows per group)."""
    a = 1.0 - confidence
    return stats.groupBy(*group).agg(
        F.percentile("stat", F.lit(a / 2)).alias("ci_lo"), F.percentile("stat", F.lit(1 - a / 2)).alias("ci_hi")
    )


def bootstrap_ci(
    values: DataFrame,
    group: Sequence[str],
    value: str,
    statistic: Statistic,
    avg_block: float | str,
    iterations: int = 2000,
    confidence: float = 0.95,
    seed: int = 0,
    seq: str = "seq",
) -> DataFrame:
    """Point estimate and percentile interval of a statistic, one row per group.

    With a single value the interval is the point itself.
    """
    group = list(group)
    point = statistic(values.withColumn("t", F.col(seq)), group, value).withColumnRenamed("stat", "point")
    counts = values.groupBy(*group).agg(F.count(F.lit(1)).alias("_cnt"))
    if hasattr(statistic, "of_moments"):
        moments = bootstrap_moments(values, group, value, avg_block, iterations, seed, seq)
        drawn = moments.select(*group, "iter", statistic.of_moments().alias("stat"))
    elif hasattr(statistic, "of_summary"):
        drawn = bootstrap_summaries(values, group, value, statistic.of_summary, avg_block, iterations, seed, seq)
    else:
        draws = bootstrap_draws(values, group, value, avg_block, iterations, seed, seq)
        drawn = statistic(draws, [*group, "iter"], value)
    ci = percentile_ci(drawn, group, confidence)
    single = F.col("_cnt") < 2
    return (
        point.join(counts, group)
        .join(ci, group, "left")
        .select(
            *group,
            "point",
            F.when(single, F.col("point")).otherwise(F.col("ci_lo")).alias("ci_lo"),
            F.when(single, F.col("point")).otherwise(F.col("ci_hi")).alias("ci_hi"),
        )
    )
