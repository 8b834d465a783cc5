"""Mixing categories to target weights by weighted fair queueing, in DataFrame operations only."""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barline.llm.order import BUCKET_ROWS, global_index, running_sum
from barline.llm.text import n_words
from barline.session import materialize

#: a source's target, and what the mix takes of a document, is at most so many times its size
MAX_TIMES = 3


def _exact(x) -> Column:
    return (F.col(x) if isinstance(x, str) else F.lit(Decimal(x))).cast("decimal(38,0)")


def targets(sources: DataFrame) -> DataFrame:
    """Add ``target`` to sources (``weight``, ``source_size``): all words shared by weight.

    A target stops at three times its source's size; what is cut is shared anew among the others by weight
    until none is above. Each round sums whole numbers over the sources, so reruns agree to the last digit.
    """
    total = int(sources.agg(F.sum("source_size")).first()[0] or 0)
    level = (total, int(sources.agg(F.sum("weight")).first()[0] or 1))
    while True:
        num, den = level
        capped = _exact(MAX_TIMES) * _exact("source_size") * _exact(den) < _exact(num) * _exact("weight")
        cut, rest = sources.agg(
            F.sum(F.when(capped, MAX_TIMES * F.col("source_size"))), F.sum(F.when(~capped, F.col("weight")))
        ).first()
        found = (total - int(cut or 0), int(rest or 1))
        if found == level:
            shared = (F.lit(num) * F.col("weight")).cast("double") / F.lit(float(den))
            return sources.withColumn(
                "target", F.when(capped, (MAX_TIMES * F.col("source_size")).cast("double")).otherwise(shared)
            )
        level = found


def mix(edges: DataFrame) -> DataFrame:
    """Choose a mix of edges in which every category has its share of words.

    ``edges`` needs edge_id, category and hypothesis; other columns are not read. Categories in code point
    order, null last, weigh 1, 2, 3 and so on over again, and share as many words as the table has. One row
    for each row: edge_id, category, size (words of the hypothesis, null: 0), source_size and target of the
    category, copies (how often the mix takes it, 0 to 3) and taken (copies * size).

    Each category is shuffled by a hash of edge_id and read up to three times. A document's virtual finish time is the
    words of its category read so far over the category's target; all are sorted by finish time, and taken
    until their words reach the total. Documents without words take no part (0 copies). Rows that repeat an
    edge_id stand next to each other and count each. An empty table gives an empty one.
    """
    rows = edges.select(
        "edge_id",
        F.col("category").cast("string").alias("category"),
        n_words(F.col("hypothesis").cast("string")).alias("size"),
        F.md5(F.coalesce(F.col("edge_id").cast("string"), F.lit(""))).alias("_hash"),
        F.monotonically_increasing_id().alias("_row"),
    )
    rows = materialize(rows, "sized")
    sources = rows.groupBy("category").agg(
        F.sum("size").alias("source_size"), F.count(F.when(F.col("size") > 0, 1)).alias("_filled")
    )
    sources = global_index(sources, [F.asc_nulls_last("category")], "_source")
    sources = materialize(sources.withColumn("weight", F.col("_source") % 3 + 1), "sources")
    sources = materialize(targets(sources), "targets")

    same = rows["category"].eqNullSafe(sources["category"])
    placed = rows.filter("size > 0").join(sources, same).select(
        "_row", "_hash", "size", "_source", "source_size", "target", "_filled"
    )
    # the first 32 bits of the hash are uniform: so many slots of them as give a bucket its average of rows
    slots = F.ceil(F.col("_filled") / BUCKET_ROWS)
    spot = F.floor(F.conv(F.substring("_hash", 1, 8), 16, 10).cast("bigint") * slots / F.lit(2.0**32))
    placed = running_sum(placed, ["_source"], spot, [F.col("_hash"), F.col("size"), F.col("_row")], "size", "_read")
    entries = placed.withColumn("_pass", F.explode(F.sequence(F.lit(0), F.lit(MAX_TIMES - 1)))).select(
        "_row", "_hash", "size", "_source", "_pass",
        ((F.col("_pass") * F.col("source_size") + F.col("_read")).cast("double") / F.col("target")).alias("_finish"),
    )
    entries = materialize(entries, "entries")
    # by the time that every category has read past its target, the total is reached
    late = entries.filter("_finish >= 1").groupBy("_source").agg(F.min("_finish").alias("_finish"))
    last, total = late.agg(F.max("_finish")).first()[0], rows.agg(F.sum("size")).first()[0] or 0
    if last is not None:
        entries = entries.filter(F.col("_finish") <= F.lit(last))
    slots = max(1, -(-entries.count() // BUCKET_ROWS))
    order = [F.col(c) for c in ("_finish", "_source", "_pass", "_hash", "size", "_row")]
    queue = running_sum(
        entries.withColumn("_all", F.lit(0)),
        ["_all"],
        F.floor(F.col("_finish") * F.lit(slots / max(1.0, last or 1.0))),
        order,
        "size",
        "_total",
    )
    taken = queue.filter(F.col("_total") <= F.lit(total)).groupBy("_row").agg(F.count(F.lit(1)).alias("copies"))
    copies = F.coalesce("copies", F.lit(0))
    return (
        rows.join(sources, same)
        .select(rows["edge_id"], rows["category"], "size", "source_size", "target", "_row")
        .join(taken, "_row", "left")
        .select(
            "edge_id", "category", "size", "source_size", "target",
            copies.alias("copies"), (copies * F.col("size")).alias("taken"),
        )
    )
