"""Shards of equal bytes by histogram sort, in DataFrame operations only."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barline.llm.order import global_index
from barline.session import materialize

#: bits of the sort key: 32 of the payload's CRC, then 31 of a hash of the id
_KEY_BITS, _ID_BITS = 63, 31

#: boundaries tried in each interval and round
PROBES = 256

#: accepted distance of a boundary from its place, as parts of a shard's bytes: at once, and if it keeps a group whole
TOLERANCE, GROUP_TOLERANCE = 1 / 1000, 1 / 100


@dataclass
class _Splitter:
    """Where a boundary is sought: between keys ``low`` and ``high``, with ``below`` bytes under ``low``."""

    wanted: float
    low: int = 0
    high: int = 1 << _KEY_BITS
    below: int = 0
    found: int | None = None


def _refine(splitter: _Splitter, step: int, parts: dict[int, int], slack: float) -> None:
    """Narrow a splitter by the exact bytes of the parts of its interval."""
    at, below = splitter.low, splitter.below
    for k in range(-(-(splitter.high - splitter.low) // step)):
        size = parts.get(k, 0)
        if below + size >= splitter.wanted:
            break
        at, below = at + step, below + size
    else:
        size = 0
    above = min(at + step, splitter.high)
    down, up = splitter.wanted - below, below + size - splitter.wanted
    near, off = (at, down) if down <= up else (above, up)
    whole_groups = step >= 1 << _ID_BITS
    single = step <= 1 << _ID_BITS
    if off <= slack * TOLERANCE or step == 1 or whole_groups and single and off <= slack * GROUP_TOLERANCE:
        splitter.found = near
    else:
        splitter.low, splitter.high, splitter.below = at, above, below


def boundaries(rows: DataFrame, shards: int) -> list[int]:
    """Keys that cut ``rows`` (key, size) into shards of nearly equal bytes.

    Each round counts, in one aggregate over all rows, the exact bytes in 256 parts of every interval that a
    boundary is still sought in, so the driver sees some thousand sums whatever the size of the table.
    """
    total = int(rows.agg(F.sum("size")).first()[0] or 0)
    splitters = [_Splitter(total * b / shards) for b in range(1, shards)]
    while open_ones := [s for s in splitters if s.found is None]:
        intervals = sorted({(s.low, s.high) for s in open_ones})
        steps = [max(1, -(-(high - low) // PROBES)) for low, high in intervals]
        place = F.lit(None).cast("struct<interval:int,part:bigint>")
        for k, ((low, high), step) in enumerate(zip(intervals, steps)):
            inside = f"key >= {low}L AND key <= {high - 1}L"
            part = F.expr(f"CAST((key - {low}L) DIV {step}L AS BIGINT)")
            place = F.when(F.expr(inside), F.struct(F.lit(k).alias("interval"), part.alias("part"))).otherwise(place)
        counted = rows.select(place.alias("place"), "size").filter("place IS NOT NULL")
        sums: list[dict[int, int]] = [{} for _ in intervals]
        for row in counted.groupBy("place.interval", "place.part").agg(F.sum("size").alias("bytes")).collect():
            sums[row["interval"]][row["part"]] = int(row["bytes"])
        for s in open_ones:
            k = intervals.index((s.low, s.high))
            _refine(s, steps[k], sums[k], total / shards)
    return [s.found for s in splitters]


def shard(events: DataFrame, shards: int = 8) -> DataFrame:
    """Deal events into shards of nearly equal bytes, sorted, with gapless slots.

    ``events`` needs event_id and payload; other columns are not read. One row for each row: event_id, size
    (UTF-8 bytes of the payload, null: none, plus 1), payload_crc32, shard (0 to ``shards`` - 1) and slot (from
    0 in each shard). Rows are sorted by CRC, then by a hash of the id, so equal payloads stand together; a
    group is cut only where a boundary would be off by more than a hundredth of a shard. The boundaries come from exact byte counts
    (``boundaries``); then rows are exchanged once. Null ids hash alike and repeated rows are dealt each. With
    few rows, shards may stay empty; an empty table gives an empty one.
    """
    payload = F.col("payload").cast("string")
    crc = F.crc32(F.coalesce(payload, F.lit("")).cast("binary"))
    rows = events.select(
        "event_id",
        (F.coalesce(F.octet_length(payload), F.lit(0)) + 1).cast("bigint").alias("size"),
        crc.alias("payload_crc32"),
        (F.shiftleft(crc, _ID_BITS) + F.shiftrightunsigned(F.xxhash64("event_id"), 64 - _ID_BITS)).alias("key"),
        F.monotonically_increasing_id().alias("_row"),
    )
    rows = materialize(rows, "keyed")
    number = F.lit(0)
    for cut in boundaries(rows, shards):
        # a boundary past the largest key leaves nothing above it
        number = number + (F.col("key") >= F.lit(cut) if cut < 1 << _KEY_BITS else F.lit(False)).cast("int")
    dealt = global_index(rows.withColumn("shard", number), [F.col("key"), F.col("_row")], "slot", within=["shard"])
    return dealt.select("event_id", "size", "payload_crc32", "shard", "slot")
