"""Batch form of the one-open-position-per-key trade list."""

from __future__ import annotations

from collections.abc import Sequence

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barline.functions.scalar import parse_horizon_ms, ret_bps
from barline.operators.asof import asof_join
from barline.operators.series import DAY_MS, add_windowed, index_rows, running, time_bucket


def one_open_position(
    ticks: DataFrame,
    keys: Sequence[str],
    horizon: str,
    direction: str = "long",
    cost_bps: float = 0.0,
    tiebreak: str = "tick_id",
    bucket_ms: int = DAY_MS,
) -> DataFrame:
    """Closed trades when at most one position per key is open.

    1. The tick that would close each fire: first tick at or past fire + horizon, an
       as-of join over reversed time.
    2. A fire at or past the close of the fire before it starts a new, independent
       cluster, because every earlier position is closed by then.
    3. Inside a cluster fires are taken greedily, streaming over sorted rows.

    Only fires travel, and a busy key is split at each of its quiet spells.
    """
    keys = list(keys)
    hold = parse_horizon_ms(horizon)
    fires = ticks.filter("fired").select(*keys, "ts", tiebreak, F.col("open").alias("entry_px"))
    # reversed time: the latest tick at or before -(ts + horizon)
    back = ticks.select(
        *keys,
        (-F.col("ts")).alias("_rev"),
        (-F.col(tiebreak)).alias("_tie"),
        F.col("ts").alias("exit_ts"),
        F.col(tiebreak).alias("exit_id"),
        F.col("close").alias("exit_px"),
    )
    ahead = fires.withColumn("_rev", -(F.col("ts") + hold))
    closed = asof_join(ahead, back, keys, ["exit_ts", "exit_id", "exit_px"], "_rev", "_tie", bucket_ms).drop("_rev")
    indexed = index_rows(closed, keys, ["ts", tiebreak], time_bucket("ts", bucket_ms))
    linked = add_windowed(
        indexed,
        keys,
        lambda f: {"_pt": f.lag("exit_ts", 1), "_pi": f.lag("exit_id", 1), "_p": f.lag("ts", 1)},
        before=1,
    )
    # an earlier fire without a closing tick stays open to the end
    fresh = F.col("_p").isNull() | (
        F.col("_pt").isNotNull()
        & ((F.col("ts") > F.col("_pt")) | ((F.col("ts") == F.col("_pt")) & (F.col(tiebreak) >= F.col("_pi"))))
    )
    marked = linked.withColumn("_new", F.when(fresh, 1).otherwise(0))
    clustered = running(
        marked, keys, "pos", F.floor(F.col("pos") / F.lit(65_536)).cast("bigint"), {"_cluster": ("sum", F.col("_new"))}
    ).select(*keys, "_cluster", "pos", "ts", tiebreak, "entry_px", "exit_ts", "exit_id", "exit_px")
    ids = [*keys, "_cluster"]
    n = int(ticks.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ordered = clustered.repartition(n, *ids).sortWithinPartitions(*ids, "pos")

    def take(batches):
        current, free_ts, free_id = None, None, None
        for pdf in batches:
            keep = []
            for row in pdf[[*ids, "ts", tiebreak, "exit_ts", "exit_id"]].itertuples(index=False):
                cluster = row[: len(ids)]
                ts, tick, exit_ts, exit_id = row[len(ids) :]
                if cluster != current:
                    current, free_ts, free_id = cluster, None, None
                    open_now = True
                else:
                    open_now = free_ts is not None and (ts, tick) >= (free_ts, free_id)
                keep.append(open_now)
                if open_now:
                    never = pd.isna(exit_ts)
                    free_ts, free_id = (None, None) if never else (exit_ts, exit_id)
            yield pdf[pd.Series(keep, index=pdf.index)] if len(pdf) else pdf

    picked = ordered.mapInPandas(take, ordered.schema).filter(F.col("exit_ts").isNotNull())
    gross = ret_bps(direction, F.col("entry_px"), F.col("exit_px"))
    return picked.select(
        *keys,
        F.col("ts").alias("entry_ts"),
        "entry_px",
        "exit_ts",
        "exit_px",
        gross.alias("ret_bps"),
        (gross - F.lit(cost_bps)).alias("ret_net_bps"),
    )
