"""Row numbers and running sums over tables of any size, in DataFrame operations only."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from barline.session import materialize

#: rows that one bucket of a running sum holds on average
BUCKET_ROWS = 512
_FAN = 1024

#: monotonically_increasing_id keeps the number within the partition in the low 33 bits
_LOCAL_BITS = 33


def global_index(df: DataFrame, order: Sequence[Column], out: str, within: Sequence[str] = ()) -> DataFrame:
    """Number all rows along ``order`` from 0, or from 0 again for each value of ``within``.

    One range exchange; ``within`` must be non-decreasing along ``order``. The rows are written once, so
    their numbers stay when a task is repeated. What is summed up has a row per partition and value.
    """
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = df.repartitionByRange(parts, *order).sortWithinPartitions(*order)
    ranged = materialize(ranged.withColumn("_at", F.monotonically_increasing_id()), "ranged")
    ranged = ranged.withColumn("_part", F.shiftright("_at", _LOCAL_BITS))
    keys = ["_part", *within]
    counts = ranged.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"), F.min("_at").alias("_first"))
    earlier = W.partitionBy(*within).orderBy("_part").rowsBetween(W.unboundedPreceding, -1)
    starts = counts.select(*keys, "_first", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_off"))
    joined = ranged.join(starts, keys)
    return joined.withColumn(out, F.col("_at") - F.col("_first") + F.col("_off")).select(*df.columns, out)


def running_sum(
    df: DataFrame, keys: Sequence[str], bucket: Column, order: Sequence[Column], value: str, out: str
) -> DataFrame:
    """Sum of ``value`` over a row and those before it, for each value of ``keys`` (which must not be null).

    ``bucket`` is a number that does not decrease along ``order``. Rows are summed in their bucket; buckets
    are summed in groups of 1,024 and those groups by key, so that no task sees a whole key.
    """
    keys = list(keys)
    df = df.withColumn("_bucket", bucket)

    def before(of: list[str], by: str) -> Column:
        return F.coalesce(F.sum("_sum").over(W.partitionBy(*of).orderBy(by).rowsBetween(W.unboundedPreceding, -1)), F.lit(0))

    fine = df.groupBy(*keys, "_bucket").agg(F.sum(value).alias("_sum"))
    fine = fine.withColumn("_coarse", F.floor(F.col("_bucket") / _FAN))
    coarse = fine.groupBy(*keys, "_coarse").agg(F.sum("_sum").alias("_sum"))
    coarse = coarse.select(*keys, "_coarse", before(keys, "_coarse").alias("_far"))
    near = fine.select(*keys, "_bucket", "_coarse", before([*keys, "_coarse"], "_bucket").alias("_near"))
    carried = near.join(coarse, [*keys, "_coarse"]).select(*keys, "_bucket", (F.col("_far") + F.col("_near")).alias("_carry"))
    own = F.sum(value).over(W.partitionBy(*keys, "_bucket").orderBy(*order).rowsBetween(W.unboundedPreceding, 0))
    return df.withColumn("_own", own).join(carried, [*keys, "_bucket"]).withColumn(
        out, F.col("_own") + F.col("_carry")
    ).drop("_bucket", "_own", "_carry")
